"""Training-data pipeline operators (secret scans, near-dedup, BPE, sharding, mixing, classifiers)."""
