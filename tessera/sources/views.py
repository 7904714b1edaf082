"""Analytic views over the warehouse tables: cells, prototypes, sparse expression, samples, labelings.

Row order never matters here: every view has an explicit id column. ``SQL`` holds the same definitions
in ANSI SQL for side-by-side checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROTOTYPES = 8
FEATURES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows as cells: section is the label, x and y the first two components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("section_id"),
        F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
    )


def proto_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, section_id, prototype_id): the first largest of components 2 to 9."""
    e = table(spark, sf_dir, "embeddings")
    part = F.slice("embedding", 3, PROTOTYPES)
    return e.select(
        F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("section_id"),
        (F.array_position(part, F.array_max(part)) - 1).cast("long").alias("prototype_id"),
    )


def features_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (cell_id, gene_id, value) of the embedding components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("gene_id", "value")).withColumn("value", F.col("value").cast("double"))


def cells_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells: section is the day, x the second of the day, y the value, cell_type the event type."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("cell_id"), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long").alias("section_id"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("x"),
        F.col("value").cast("double").alias("y"), F.col("event_type").alias("cell_type"),
    )


def proto_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, section_id, prototype_id) with users as sections and bands of the value as prototypes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cell_id"), F.col("user_id").alias("section_id"), F.least(F.lit(9), F.floor(F.col("value") / 50)).cast("long").alias("prototype_id"))


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse expression (cell_id, gene, value): orders as cells, part brands as genes, quantities summed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def expr_protos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, prototype_id) of the expression cells."""
    return expr(spark, sf_dir).select("cell_id").distinct().select("cell_id", (F.col("cell_id") % 6).alias("prototype_id"))


def sample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, sample_id, prototype_id): orders by the customer's nation and the rank of their priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    priority = F.substring("o_orderpriority", 1, 1).cast("long") - 1
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell_id"), F.col("c_nationkey").cast("long").alias("sample_id"), priority.alias("prototype_id"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, binary, continuous) outcomes of nations."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("sample_id"), (F.col("n_regionkey") < 2).cast("int").alias("binary"))
    balance = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("sample_id")).agg(F.avg("c_acctbal").alias("continuous"))
    return nations.join(balance, "sample_id")


def labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pred, true_label): line status flags of line items."""
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", (F.col("l_linenumber") % 2).cast("string")).alias("pred"), F.col("l_linestatus").alias("true_label"))


SQL = {
    "cells_emb": "SELECT vec_id AS cell_id, CAST(label AS BIGINT) AS section_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
    "proto_emb": "SELECT vec_id AS cell_id, CAST(label AS BIGINT) AS section_id, CAST(list_position(embedding[3:10], list_max(embedding[3:10])) - 1 AS BIGINT) AS prototype_id FROM embeddings",
    "features_emb": "SELECT vec_id AS cell_id, CAST(unnest(range(64)) AS INTEGER) AS gene_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
    "cells_ev": "SELECT event_id AS cell_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS section_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y, event_type AS cell_type FROM events",
    "proto_ev": "SELECT event_id AS cell_id, user_id AS section_id, CAST(least(9, floor(value / 50)) AS BIGINT) AS prototype_id FROM events",
    "expr": "SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "expr_protos": "SELECT DISTINCT cell_id, cell_id % 6 AS prototype_id FROM expr",
    "sample_cells": "SELECT o_orderkey AS cell_id, CAST(c_nationkey AS BIGINT) AS sample_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS prototype_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "outcomes": "SELECT CAST(n_nationkey AS BIGINT) AS sample_id, CAST(n_regionkey < 2 AS INTEGER) AS \"binary\", b.continuous FROM nation JOIN (SELECT c_nationkey, avg(c_acctbal) AS continuous FROM customer GROUP BY 1) b ON n_nationkey = b.c_nationkey",
    "labelings": "SELECT l_returnflag || CAST(l_linenumber % 2 AS VARCHAR) AS pred, l_linestatus AS true_label FROM lineitem",
}


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views (in order) before ``body``, which may go on with more of them."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {views}{body if body.startswith(',') else ' ' + body}"
