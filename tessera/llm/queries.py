"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import op12_conversations as conversations
from tessera.llm import op13_delta_lloyd as delta_lloyd
from tessera.llm.op1_secrets import op1_secret_scan
from tessera.llm.op2_simhash import op2_simhash_near_dedup
from tessera.llm.op3_token_store import op3_token_store
from tessera.llm.op4_sharding import op4_histogram_sharding
from tessera.llm.op5_language import op5_language_id
from tessera.llm.op6_quality import op6_quality_rules
from tessera.llm.op7_caps import op7_spherical_caps
from tessera.llm.op8_toxicity import op8_toxicity
from tessera.llm.op9_mixing import op9_mixing
from tessera.llm.op10_bpe import op10_bpe_round_trip
from tessera.llm.op11_token_counts import op11_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_simhash_near_dedup, op3_token_store, op4_histogram_sharding, op5_language_id,
        op6_quality_rules, op7_spherical_caps, op8_toxicity, op9_mixing, op10_bpe_round_trip,
        op11_token_counts, conversations.op12_conversation_repair, delta_lloyd.op13_delta_lloyd,
    )
} | {"pipeline": corpus_pipeline.run}

#: The others have no SQL form: they rest on fitted models, tokenizer libraries, XXH64 digests, seeded rounding or
#: approximate filters. tests/llm holds them against brute-force versions.
ORACLES: dict[str, str] = {"op12_conversation_repair": conversations.ORACLE_SQL, "op13_delta_lloyd": delta_lloyd.ORACLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
