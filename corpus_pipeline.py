"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and all but the last
return the columns of ``documents``. ``run`` writes each result as Parquet into the shared folder and
rereads it, so a lost executor costs a task, not the stages before.

Nulls, empty texts, ties and repeated rows are handled as the operators state, also where doc_id is null
or repeated; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op1_secrets, op2_simhash, op8_toxicity, op9_mixing, op10_bpe
from tessera.llm.common import checkpoint, shared_folder, table

MOST_BROADCAST = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold; scored where they are read, without a shuffle."""
    return op8_toxicity.keep_clean(docs, op8_toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row, of the least id (null last); of equal rows the least in all columns."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    found = checkpoint(op2_simhash.kept_rows(docs, tie).where("not kept or rows > 1").select(F.col("doc_id").alias("_gone"), F.col("tie").alias("_tie"), "kept"))
    counts = {r["kept"]: r["count"] for r in found.groupBy("kept").count().collect()}

    def met(keys: DataFrame, many: int, how: str) -> DataFrame:
        # keys of 16 bytes; where they are too many to travel, texts are shuffled instead
        keys = F.broadcast(keys) if many <= MOST_BROADCAST else keys
        return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys["_gone"]) & (tie == keys["_tie"]), how)

    single = met(found, sum(counts.values()), "left_anti")
    if not counts.get(True):
        return single
    # equal rows shrink to one before they are exchanged
    equal = met(found.where("kept"), counts[True], "left_semi").groupBy("doc_id", tie).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(equal.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where one was."""
    return op1_secrets.redact(docs, op1_secrets.default_model(spark, docs), chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return op9_mixing.apply_mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; ``ids`` is what training reads."""
    return op10_bpe.encoded(docs, public_tokenizers.path(op10_bpe.VOCABULARY), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("bpe", to_tokens),
]

#: The stages rest on a fitted model, fingerprints and seeded rounding; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
