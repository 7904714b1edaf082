"""Registered queries over the warehouse tables, with the same computations in SQL.

Computed doubles are rounded to nine places on both sides, as sums run in different orders.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import HALF_ROUNDS, PRIME, cut
from tessera.operators import agreement, annotate, cluster, communication, encoder, features, graph, layout, model, outcome, prototypes, spatial
from tessera.plans import report, runs
from tessera.schema import edges_out_of_range
from tessera.sources import views
from tessera.sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 6
ALPHA = 0.5
PANEL = {"type_a": ["Brand#11", "Brand#12", "Brand#13"], "type_b": ["Brand#21", "Brand#22", "Brand#22"], "type_c": ["Brand#31", "Brand#35"], "type_d": ["Brand#44", "Brand#45", "Brand#51"]}
PAIRS = [("Brand#11", "Brand#21"), ("Brand#12", "Brand#33"), ("Brand#45", "Brand#54"), ("Brand#55", "Brand#13")]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def nine(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 9) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: nine(c) for c in columns})


def edges_emb(spark: SparkSession, sf: str) -> DataFrame:
    return graph.knn_tiles(views.cells_emb(spark, sf), K)


def edges_ev(spark: SparkSession, sf: str) -> DataFrame:
    return graph.knn_tiles(views.cells_ev(spark, sf), K)


def _knn_sql(view: str, k: int = K) -> str:
    d2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
    ranked = f"SELECT a.section_id, a.cell_id AS src, b.cell_id AS dst, {d2} AS d2, row_number() OVER (PARTITION BY a.cell_id ORDER BY {d2}, b.cell_id) AS rank FROM {view} a JOIN {view} b ON a.section_id = b.section_id AND a.cell_id <> b.cell_id"
    return f", edges AS (SELECT section_id, src, dst, CAST(rank AS INTEGER) AS rank, sqrt(d2) AS dist FROM ({ranked}) WHERE rank <= {k})"


EMB = with_views("cells_emb proto_emb", _knn_sql("cells_emb"))
EV = with_views("cells_ev", _knn_sql("cells_ev"))
FEAT = with_views("cells_emb proto_emb features_emb", _knn_sql("cells_emb"))
R9 = "round({}, 9) + 0.0"


def r9(expression: str, name: str) -> str:
    return f"round({expression}, 9) + 0.0 AS {name}"


# --- graphs ----------------------------------------------------------------------------------------


@query(EMB + f" SELECT section_id, src, dst, rank, {r9('dist', 'dist')} FROM edges")
def knn_edges(spark, sf):
    return rounded(edges_emb(spark, sf), "dist")


@query(EV + f" SELECT section_id, src, dst, rank, {r9('dist', 'dist')} FROM edges")
def knn_edges_grid(spark, sf):
    return rounded(edges_ev(spark, sf), "dist")


# a triangle belongs to the triangulation if no other cell lies within its circle
CIRCLES = ", p AS (SELECT section_id AS s, cell_id AS i, x, y, x * x + y * y AS w FROM cells_emb), tri AS (SELECT a.s, a.i AS ai, b.i AS bi, c.i AS ci, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, c.x AS cx, c.y AS cy, 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d, a.w * (b.y - c.y) + b.w * (c.y - a.y) + c.w * (a.y - b.y) AS ux, a.w * (c.x - b.x) + b.w * (a.x - c.x) + c.w * (b.x - a.x) AS uy FROM p a JOIN p b ON a.s = b.s AND a.i < b.i JOIN p c ON c.s = b.s AND b.i < c.i), circles AS (SELECT *, ux / d AS ox, uy / d AS oy, (ax - ux / d) * (ax - ux / d) + (ay - uy / d) * (ay - uy / d) AS r2 FROM tri WHERE d <> 0), empty AS (SELECT c.* FROM circles c LEFT JOIN p q ON q.s = c.s AND q.i NOT IN (c.ai, c.bi, c.ci) AND (q.x - ox) * (q.x - ox) + (q.y - oy) * (q.y - oy) < r2 * (1 - 1e-12) WHERE q.i IS NULL), sides AS (SELECT s, ai AS u, bi AS v FROM empty UNION SELECT s, ai, ci FROM empty UNION SELECT s, bi, ci FROM empty), ways AS (SELECT * FROM sides UNION SELECT s, v, u FROM sides)"


@query(with_views("cells_emb", CIRCLES + f" SELECT ways.s AS section_id, u AS src, v AS dst, {r9('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 'dist')} FROM ways JOIN p a ON a.i = u JOIN p b ON b.i = v"))
def delaunay_edges(spark, sf):
    return graph.delaunay_graph(views.cells_emb(spark, sf), check=False).select("section_id", "src", "dst", nine("dist").alias("dist"))


@query(EMB + " SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)")
def adjacency_undirected(spark, sf):
    return graph.adjacency(edges_emb(spark, sf))


HOPS = ", adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)), reach AS (SELECT cell_id AS center, cell_id AS node, 0 AS hops FROM cells_emb UNION ALL SELECT src, dst, 1 FROM adj UNION ALL SELECT a.src, b.dst, 2 FROM adj a JOIN adj b ON a.dst = b.src), nodes AS (SELECT center, node, CAST(min(hops) AS INTEGER) AS hops FROM reach GROUP BY 1, 2)"


@query(EMB + HOPS + " SELECT * FROM nodes")
def khop_subgraph_nodes(spark, sf):
    centers = views.cells_emb(spark, sf).select(F.col("cell_id").alias("center"))
    return graph.subgraph_nodes(edges_emb(spark, sf), centers, 2)


@query(EMB + HOPS + " SELECT a.center, e.src, e.dst FROM edges e JOIN nodes a ON a.node = e.src AND a.hops < 2 JOIN nodes b ON b.node = e.dst AND b.center = a.center AND b.hops < 2")
def khop_subgraph_edges(spark, sf):
    centers = views.cells_emb(spark, sf).select(F.col("cell_id").alias("center"))
    return graph.extract_subgraphs(edges_emb(spark, sf), centers, 1)[1]


FLAT = with_views("cells_emb", ", flat AS (SELECT cell_id, CAST(0 AS BIGINT) AS section_id, x, y FROM cells_emb)" + _knn_sql("flat"))


@query(FLAT + " SELECT e.src, e.dst, a.section_id AS src_section, b.section_id AS dst_section FROM edges e JOIN cells_emb a ON a.cell_id = e.src JOIN cells_emb b ON b.cell_id = e.dst WHERE a.section_id <> b.section_id")
def cross_section_edges(spark, sf):
    from tessera.schema import cross_section_edges as leaving

    cells = views.cells_emb(spark, sf)
    return leaving(graph.knn_tiles(cells.withColumn("section_id", F.lit(0).cast("long")), K), cells)


@query(EMB + " SELECT src, dst FROM edges WHERE src NOT IN (SELECT cell_id FROM proto_emb WHERE prototype_id < 4) OR dst NOT IN (SELECT cell_id FROM proto_emb WHERE prototype_id < 4)")
def edges_of_unknown_cells(spark, sf):
    return edges_out_of_range(edges_emb(spark, sf).select("src", "dst"), views.proto_emb(spark, sf).where("prototype_id < 4"))


@query(with_views("cells_emb proto_emb", f", centres AS (SELECT section_id, prototype_id AS centre_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM cells_emb JOIN proto_emb USING (cell_id, section_id) GROUP BY 1, 2), d AS (SELECT cell_id, centre_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM cells_emb JOIN centres USING (section_id)), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, centre_id) AS k FROM d) SELECT cell_id, centre_id, {r9('sqrt(d2)', 'dist')} FROM r WHERE k = 1"))
def nearest_centre(spark, sf):
    cells = views.cells_emb(spark, sf)
    at = cells.join(views.proto_emb(spark, sf).drop("section_id"), "cell_id").groupBy("section_id", F.col("prototype_id").alias("centre_id"))
    return rounded(graph.nearest_centre(cells, at.agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))), "dist")


ADJ = ", counts AS (SELECT a.prototype_id AS src_proto, b.prototype_id AS dst_proto, count(*) AS n FROM edges JOIN proto_emb a ON a.cell_id = src JOIN proto_emb b ON b.cell_id = dst GROUP BY 1, 2)"


@query(EMB + ADJ + " SELECT * FROM counts")
def proto_adjacency(spark, sf):
    return graph.prototype_adjacency(edges_emb(spark, sf), views.proto_emb(spark, sf))


@query(EMB + ADJ + ", c AS (SELECT DISTINCT prototype_id AS p FROM proto_emb) SELECT a.p AS src_proto, b.p AS dst_proto, coalesce(n, 0) AS n FROM c a JOIN c b ON a.p <> b.p LEFT JOIN counts ON src_proto = a.p AND dst_proto = b.p")
def proto_adjacent_pairs(spark, sf):
    protos = views.proto_emb(spark, sf)
    return graph.adjacent_pairs(edges_emb(spark, sf), protos, protos)


# --- spatial coherence -----------------------------------------------------------------------------

ENDS = ", ends AS (SELECT e.section_id, e.src, e.dst, a.prototype_id AS a, b.prototype_id AS b FROM edges e JOIN proto_emb a ON a.cell_id = src JOIN proto_emb b ON b.cell_id = dst)"


@query(EMB + ENDS + f" SELECT section_id, {r9('avg(CAST(a = b AS INTEGER))', 'agreement')}, count(*) AS n_edges FROM ends GROUP BY 1")
def knn_label_agreement(spark, sf):
    return rounded(spatial.neighbour_agreement_by_section(views.proto_emb(spark, sf), edges_emb(spark, sf)), "agreement")


@query(EMB + ENDS + f" SELECT {r9('avg(CAST(a = b AS INTEGER))', 'agreement')}, count(*) AS n_edges FROM ends")
def knn_label_agreement_total(spark, sf):
    return rounded(spatial.neighbour_agreement(views.proto_emb(spark, sf), edges_emb(spark, sf)), "agreement")


@query(EMB + ENDS + f", m AS (SELECT avg(prototype_id) AS mean, var_pop(prototype_id) AS v FROM proto_emb) SELECT {r9('avg((a - mean) * (b - mean)) / max(v)', 'morans_i')} FROM ends, m")
def morans_i_value(spark, sf):
    return rounded(spatial.morans_i(views.proto_emb(spark, sf), edges_emb(spark, sf), "prototype_id"), "morans_i")


@query(EMB + ENDS + f", n AS (SELECT count(*) AS n FROM proto_emb), f AS (SELECT prototype_id AS p, count(*) / max(n.n) AS f FROM proto_emb, n GROUP BY 1) SELECT p AS prototype_id, {r9('avg((CAST(a = p AS INTEGER) - f) * (CAST(b = p AS INTEGER) - f)) / max(f * (1 - f))', 'morans_i')} FROM ends, f GROUP BY 1")
def per_niche_morans_i(spark, sf):
    return rounded(spatial.per_prototype_morans_i(views.proto_emb(spark, sf), edges_emb(spark, sf)), "morans_i")


def _shuffles_sql(view: str, label: str, n_perm: int, seed: int = 0, walks: int = 4) -> str:
    """``drawn`` (perm, cell_id, label): the shuffles of ``shuffled_labels``, step by step."""
    halves = [(h, w) for h in range(HALF_ROUNDS) for w in (0, 1)]
    first = ", ".join(f"((p + 1) * 1000003 + {(h + 1) * 7919 + (w + 1) * 104729 + seed * 15485863 + 12345}) % {PRIME} AS k{2 * h + w}" for h, w in halves)
    again = ", ".join(f"(k{k} * k{k} % {PRIME} * 48271 + k{k} + 11) % {PRIME} AS k{k}" for k in range(2 * HALF_ROUNDS))
    out = f", k0 AS (SELECT p AS perm, {first} FROM (SELECT unnest(range({n_perm})) AS p)), k1 AS (SELECT perm, {again} FROM k0), k2 AS (SELECT perm, {again} FROM k1), keys AS (SELECT perm, {again} FROM k2)"
    out += f", size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM {view})))"
    out += f", walk0 AS (SELECT perm, cell_id, idx AS y FROM (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS idx FROM {view}), keys)"
    for w in range(1, walks + 1):
        outside = "" if w == 1 else f" WHERE y >= n"
        out += f", w{w}h0 AS (SELECT perm, cell_id, y // b AS l, y % b AS r FROM walk{w - 1}, size{outside})"
        for h in range(HALF_ROUNDS):
            own, other, room = ("l", "r", "a") if h % 2 == 0 else ("r", "l", "b")
            v = f"(({other} + k{2 * h}) % {PRIME})"
            mixed = f"({own} + ({v} * {v} % {PRIME} * k{2 * h + 1} + {v}) % {PRIME}) % {room} AS {own}"
            kept = f"{other}"
            out += f", w{w}h{h + 1} AS (SELECT perm, cell_id, {mixed}, {kept} FROM w{w}h{h} JOIN keys USING (perm), size)"
        out += f", walk{w} AS (SELECT perm, cell_id, l * b + r AS y FROM w{w}h{HALF_ROUNDS}, size)"
    every = " UNION ALL ".join(f"SELECT perm, cell_id, y FROM walk{w}, size WHERE y < n" for w in range(1, walks + 1))
    out += f", ranges AS (SELECT label, CAST(sum(c) OVER (ORDER BY label) - c AS BIGINT) AS low, CAST(sum(c) OVER (ORDER BY label) AS BIGINT) AS high FROM (SELECT {label} AS label, count(*) AS c FROM {view} GROUP BY 1))"
    return out + f", drawn AS MATERIALIZED (SELECT perm, cell_id, label FROM ({every}) JOIN ranges ON y >= low AND y < high)"


COLOC = " SELECT a.cell_type AS a, b.cell_type AS b, count(*) AS n FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) JOIN cells_ev a ON a.cell_id = src JOIN cells_ev b ON b.cell_id = dst GROUP BY 1, 2"


@query(EV + COLOC)
def coloc_observed(spark, sf):
    return spatial.colocation_counts(views.cells_ev(spark, sf), edges_ev(spark, sf))


PERMS = 200


@query(EV + _shuffles_sql("cells_ev", "cell_type", PERMS) + f", observed AS ({COLOC}), one AS (SELECT a.perm AS perm, a.label AS a, b.label AS b, count(*) AS n FROM edges JOIN drawn a ON a.cell_id = src JOIN drawn b ON b.cell_id = dst AND a.perm = b.perm GROUP BY 1, 2, 3), twice AS (SELECT perm, a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM one UNION ALL SELECT perm, b, a, n FROM one) GROUP BY 1, 2, 3), null_ AS (SELECT a, b, sum(n) / {PERMS} AS m, sqrt(greatest(0, sum(n * n) / {PERMS} - sum(n) / {PERMS} * (sum(n) / {PERMS}))) AS sd FROM twice GROUP BY 1, 2), types AS (SELECT DISTINCT cell_type AS t FROM cells_ev)"
    f" SELECT x.t AS a, y.t AS b, coalesce(n, 0) AS observed, {r9('coalesce(m, 0)', 'null_mean')}, {r9('coalesce(sd, 0)', 'null_sd')}, {r9('CASE WHEN sd > 0 THEN (coalesce(n, 0) - m) / sd ELSE 0 END', 'z')} FROM types x CROSS JOIN types y LEFT JOIN observed o ON o.a = x.t AND o.b = y.t LEFT JOIN null_ u ON u.a = x.t AND u.b = y.t")  # fmt: skip
def coloc_zscore(spark, sf):
    return rounded(spatial.colocation_enrichment(views.cells_ev(spark, sf), cut(edges_ev(spark, sf)), PERMS), "null_mean", "null_sd", "z")


CCC = with_views("cells_emb proto_emb features_emb", _knn_sql("cells_emb") + ENDS)


@query(CCC + f" SELECT l.gene_id AS ligand, l.gene_id + 1 AS receptor, a AS source, b AS target, {r9('avg(l.value * r.value)', 'score')} FROM ends JOIN features_emb l ON l.cell_id = src JOIN features_emb r ON r.cell_id = dst AND r.gene_id = l.gene_id + 1 WHERE l.gene_id < 3 GROUP BY 1, 2, 3, 4")
def ccc_spatial_score(spark, sf):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(3)], "ligand int, receptor int")
    values = views.features_emb(spark, sf).withColumnRenamed("gene_id", "gene")
    return rounded(spatial.spatial_interaction(values, edges_emb(spark, sf), views.proto_emb(spark, sf), pairs), "score")


# --- neighbourhood features ------------------------------------------------------------------------

MEAN = ", means AS (SELECT src AS cell_id, gene_id, avg(value) AS value FROM edges JOIN features_emb ON cell_id = dst GROUP BY 1, 2)"


@query(FEAT + MEAN + f" SELECT cell_id, gene_id, {r9('value', 'value')} FROM means")
def neighbor_mean(spark, sf):
    return rounded(features.neighbour_mean(views.features_emb(spark, sf), edges_emb(spark, sf), views.cells_emb(spark, sf)), "value")


@query(FEAT + f" SELECT src AS cell_id, gene_id, {r9('avg(value)', 'value')} FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) JOIN features_emb ON cell_id = dst GROUP BY 1, 2")
def symmetric_mean(spark, sf):
    return rounded(features.symmetric_mean(views.features_emb(spark, sf), edges_emb(spark, sf), views.cells_emb(spark, sf)), "value")


BLEND = MEAN + ", one AS (SELECT f.cell_id, f.gene_id, 0.5e0 * f.value + 0.5e0 * m.value AS value FROM features_emb f JOIN means m ON m.cell_id = f.cell_id AND m.gene_id = f.gene_id)"


@query(FEAT + BLEND + f" SELECT cell_id, gene_id, {r9('value', 'value')} FROM one")
def blend_embedding(spark, sf):
    return rounded(features.blend(views.features_emb(spark, sf), edges_emb(spark, sf), views.cells_emb(spark, sf), ALPHA), "value")


@query(FEAT + BLEND + f", again AS (SELECT src AS cell_id, gene_id, avg(value) AS value FROM edges JOIN one ON cell_id = dst GROUP BY 1, 2) SELECT f.cell_id, f.gene_id, {r9('0.5e0 * f.value + 0.5e0 * m.value', 'value')} FROM one f JOIN again m ON m.cell_id = f.cell_id AND m.gene_id = f.gene_id")
def diffusion_2step(spark, sf):
    return rounded(features.diffusion_embedding(views.features_emb(spark, sf), cut(edges_emb(spark, sf)), views.cells_emb(spark, sf), alpha=ALPHA, n_steps=2), "value")


@query(EV + f", every AS (SELECT src, dst FROM edges UNION ALL SELECT cell_id, cell_id FROM cells_ev), n AS (SELECT src AS cell_id, cell_type, count(*) AS n FROM every JOIN cells_ev ON cell_id = dst GROUP BY 1, 2) SELECT cell_id, cell_type, {r9('n / sum(n) OVER (PARTITION BY cell_id)', 'share')} FROM n")
def composition_knn(spark, sf):
    return rounded(features.composition_embedding(views.cells_ev(spark, sf), edges_ev(spark, sf)), "share")


@query(with_views("features_emb", f" SELECT cell_id, gene_id, {r9('value / greatest(sqrt(sum(value * value) OVER (PARTITION BY cell_id)), 1e-12)', 'value')} FROM features_emb"))
def unit_rows(spark, sf):
    vectors = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("features"))
    return features.unit_rows(vectors).select("cell_id", F.posexplode("features").alias("gene_id", "value")).withColumn("value", nine("value"))


@query(with_views("expr", ", g AS (SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_id FROM (SELECT DISTINCT gene FROM expr)), c AS (SELECT DISTINCT cell_id FROM expr) SELECT c.cell_id, g.gene_id, coalesce(e.value, 0) AS value FROM c CROSS JOIN g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene"))
def dense_features(spark, sf):
    coded = features.category_codes(cut(views.expr(spark, sf)), "gene", "gene_id").withColumn("gene_id", F.col("gene_id").cast("int"))
    n = coded.agg(F.max("gene_id")).first()[0] + 1
    return features.wide(coded, n).select("cell_id", F.posexplode("features").alias("gene_id", "value"))


@query("SELECT array_to_string(list_sort(list(DISTINCT source)), '+') AS card FROM documents")
def card_id(spark, sf):
    sources = [r[0] for r in views.table(spark, sf, "documents").select("source").distinct().collect()]
    return spark.createDataFrame([(features.dataset_card_id([f"/data/{s}/cells.parquet" for s in sources]),)], "card string")


# --- agreement -------------------------------------------------------------------------------------

JOINT = ", joint AS (SELECT pred AS p, true_label AS t, count(*) AS n FROM labelings GROUP BY 1, 2)"
SUMS = JOINT + ", rs AS (SELECT p, sum(n) AS a FROM joint GROUP BY 1), cs AS (SELECT t, sum(n) AS b FROM joint GROUP BY 1), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM joint), ent AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM rs, tot) AS hp, (SELECT -sum(b / n * ln(b / n)) FROM cs, tot) AS ht, (SELECT sum(j.n / tot.n * ln(j.n * tot.n / (a * b))) FROM joint j JOIN rs USING (p) JOIN cs USING (t), tot) AS mi)"


@query(with_views("labelings", JOINT + " SELECT * FROM joint"))
def contingency(spark, sf):
    return agreement.contingency(views.labelings(spark, sf))


PAIRED = ", pairs AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM joint) AS j, (SELECT sum(a * (a - 1) / 2) FROM rs) AS r, (SELECT sum(b * (b - 1) / 2) FROM cs) AS c, n * (n - 1) / 2 AS e, n FROM tot)"


def _assigned_sql(joint: str = "joint", rows: str = "p", columns: str = "t") -> str:
    """``matched`` (p, t, n): of all ways to give each of the fewer ``rows`` a partner the best, and of those the first."""
    out = f", ar AS (SELECT {rows}, row_number() OVER (ORDER BY {rows}) - 1 AS r FROM (SELECT DISTINCT {rows} FROM {joint})), ac AS (SELECT {columns}, row_number() OVER (ORDER BY {columns}) - 1 AS c FROM (SELECT DISTINCT {columns} FROM {joint}))"
    out += f", grid AS (SELECT r, c, {rows}, {columns}, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ar CROSS JOIN ac LEFT JOIN {joint} USING ({rows}, {columns}))"
    out += ", way AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS path UNION ALL SELECT k + 1, used | (CAST(1 AS BIGINT) << c), total + n, list_append(path, c) FROM way JOIN grid ON r = k AND (used & (CAST(1 AS BIGINT) << c)) = 0)"
    return out + ", best AS (SELECT path FROM way WHERE k = (SELECT count(*) FROM ar) ORDER BY total DESC, path LIMIT 1), matched AS (SELECT p, t, n FROM grid, best WHERE path[r + 1] = c)"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


TWO = "cells_emb proto_emb"
TWO_SQL = ", labelings AS (SELECT cell_id, prototype_id AS pred, section_id AS true_label FROM proto_emb)" + SUMS + _assigned_sql()


@query(with_views("labelings", SUMS + PAIRED +
    f" SELECT CAST(n AS BIGINT) AS n, {r9('(j - r * c / e) / ((r + c) / 2 - r * c / e)', 'ari')}, {r9('2 * mi / (hp + ht)', 'nmi')}, {r9('mi / ht', 'homogeneity')}, {r9('mi / hp', 'completeness')}, {r9('2 * mi / ht * mi / hp / (mi / ht + mi / hp)', 'v_measure')} FROM pairs, ent"))
def agreement_scores(spark, sf):
    return rounded(agreement.agreement(views.labelings(spark, sf)), "ari", "nmi", "homogeneity", "completeness", "v_measure")


EMI = ", lf AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS l FROM (SELECT unnest(range(0, 1 + CAST((SELECT n FROM tot) AS BIGINT))) AS i)), k AS (SELECT a, b, n, unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS k FROM rs, cs, tot), emi AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(fa.l + fb.l + fna.l + fnb.l - fn.l - fk.l - fak.l - fbk.l - fr.l)) AS e FROM k JOIN lf fa ON fa.i = a JOIN lf fb ON fb.i = b JOIN lf fna ON fna.i = n - a JOIN lf fnb ON fnb.i = n - b JOIN lf fn ON fn.i = n JOIN lf fk ON fk.i = k JOIN lf fak ON fak.i = a - k JOIN lf fbk ON fbk.i = b - k JOIN lf fr ON fr.i = n - a - b + k)"


@query(with_views("labelings", SUMS + EMI +
    " SELECT round((mi - e) / (greatest(hp, ht) - e), 7) + 0.0 AS ami FROM ent, emi"))
def ami(spark, sf):
    table = agreement.table_of(views.labelings(spark, sf))
    return spark.createDataFrame([(round(agreement.adjusted_mutual_information_value(table.counts), 7) + 0.0,)], "ami double")


@query(_recursive(with_views("labelings", SUMS + _assigned_sql(rows="t", columns="p") + f" SELECT {r9('avg(coalesce(2.0e0 * n / (a + b), 0))', 'macro_f1')} FROM cs LEFT JOIN matched USING (t) LEFT JOIN rs USING (p)")))
def macro_f1(spark, sf):
    table = agreement.table_of(views.labelings(spark, sf))
    return rounded(spark.createDataFrame([(agreement.macro_f1_value(table.counts),)], "macro_f1 double"), "macro_f1")


def _two_labelings(spark, sf):
    return views.proto_emb(spark, sf).select("cell_id", F.col("prototype_id").alias("pred"), F.col("section_id").alias("true_label"))


@query(_recursive(with_views(TWO, TWO_SQL + " SELECT p AS proto_a, t AS proto_b, n AS overlap FROM matched")))
def prototype_matching(spark, sf):
    return agreement.matching(_two_labelings(spark, sf), "pred", "true_label")


@query(_recursive(with_views(TWO, TWO_SQL + " SELECT cell_id, pred, true_label, t AS matched FROM labelings JOIN matched ON p = pred")))
def matched_labels(spark, sf):
    return agreement.relabelled(_two_labelings(spark, sf), "pred", "true_label", 10)


@query(_recursive(with_views(TWO, TWO_SQL + f", known AS (SELECT prototype_id AS p, count(DISTINCT section_id) >= ceil(0.9e0 * max(s)) AS kept FROM proto_emb, (SELECT count(DISTINCT section_id) AS s FROM proto_emb) GROUP BY 1) SELECT {r9('avg(CAST(kept = (t < 7) AS INTEGER))', 'accuracy')} FROM matched JOIN known USING (p) WHERE n > 0 AND t < 10")))
def proto_kind_accuracy(spark, sf):
    both = _two_labelings(spark, sf)
    kinds = prototypes.separation(views.proto_emb(spark, sf), 0.9)
    truth = spark.range(10).select(F.col("id").alias("prototype_id"), F.when(F.col("id") < 7, "conserved").otherwise("sample_specific").alias("proto_kind"))
    return rounded(spark.createDataFrame([(agreement.proto_kind_accuracy(both, kinds, truth),)], "accuracy double"), "accuracy")


@query(_recursive(with_views(TWO, TWO_SQL + PAIRED + EMI + ", f AS (SELECT sum(coalesce(2.0e0 * m.n / (a + b), 0)) AS f FROM cs LEFT JOIN matched m USING (t) LEFT JOIN rs USING (p)), c AS (SELECT (SELECT count(*) FROM cs) + (SELECT count(*) FROM rs) - (SELECT count(*) FROM matched) AS classes, (SELECT sum(n) FROM matched) AS hits)"
    f" SELECT {r9('(j - r * q.c / q.e) / ((r + q.c) / 2 - r * q.c / q.e)', 'domain_ari')}, {r9('2 * mi / (hp + ht)', 'domain_nmi')}, round((mi - emi.e) / ((hp + ht) / 2 - emi.e), 7) + 0.0 AS domain_ami, {r9('mi / ht', 'domain_homogeneity')}, {r9('f / classes', 'domain_macro_f1')}, {r9('hits / q.n', 'domain_accuracy')} FROM pairs q, ent, emi, f, c AS m")))  # fmt: skip
def clustering_agreement(spark, sf):
    got = agreement.clustering_agreement(_two_labelings(spark, sf), "pred", "true_label")
    row = spark.createDataFrame([tuple(float(v) for v in got.values())], ", ".join(f"{k} double" for k in got))
    return rounded(row.withColumn("domain_ami", F.round("domain_ami", 7)), *got)


MANY = ", l AS (SELECT cell_id, 'argmax' AS labeling, prototype_id AS label FROM proto_emb UNION ALL SELECT cell_id, 'section', section_id FROM proto_emb UNION ALL SELECT cell_id, 'thirds', prototype_id % 3 FROM proto_emb), j AS (SELECT x.labeling AS a, y.labeling AS b, x.label AS p, y.label AS t, count(*) AS n FROM l x JOIN l y USING (cell_id) GROUP BY 1, 2, 3, 4), js AS (SELECT a, b, sum(n * (n - 1) / 2) AS j, sum(n) AS n FROM j GROUP BY 1, 2), jp AS (SELECT a, b, sum(k * (k - 1) / 2) AS r FROM (SELECT a, b, p, sum(n) AS k FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2), jt AS (SELECT a, b, sum(k * (k - 1) / 2) AS c FROM (SELECT a, b, t, sum(n) AS k FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2), ari AS (SELECT a, b, (j - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)) AS ari FROM js JOIN jp USING (a, b) JOIN jt USING (a, b))"


def _many(spark, sf):
    protos = views.proto_emb(spark, sf)
    rows = [protos.select("cell_id", F.lit(name).alias("labeling"), label.alias("label")) for name, label in (("argmax", F.col("prototype_id")), ("section", F.col("section_id")), ("thirds", F.col("prototype_id") % 3))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(with_views("proto_emb", MANY + f" SELECT a, b, {r9('ari', 'ari')} FROM ari"))
def pairwise_ari(spark, sf):
    return rounded(agreement.pairwise_ari(_many(spark, sf)), "ari")


@query(with_views("proto_emb", MANY + f" SELECT {r9('avg(ari)', 'mean_ari')}, {r9('stddev_pop(ari)', 'sd_ari')}, {r9('min(ari)', 'min_ari')}, count(*) AS n_pairs FROM ari WHERE a < b"))
def labeling_stability(spark, sf):
    return rounded(agreement.seed_stability(agreement.pairwise_ari(_many(spark, sf))), "mean_ari", "sd_ari", "min_ari")


@query()
def seed_stability(spark, sf):
    cells = cut(views.cells_emb(spark, sf))
    config = model.NicheModelConfig(k=K)
    found, _, matched, _ = runs.stability(cells, cut(views.features_emb(spark, sf)), cut(edges_emb(spark, sf)), n_genes=views.FEATURES, config=config)
    pairs = matched.agg(F.sort_array(F.collect_list(F.struct("proto_a", "proto_b", "overlap"))).alias("matching"))
    return rounded(found, "mean_ari", "sd_ari", "min_ari").crossJoin(pairs)


# --- prototypes and samples ------------------------------------------------------------------------

ABUNDANCE = ", counts AS (SELECT sample_id, prototype_id, count(*) AS n FROM sample_cells GROUP BY 1, 2), grid AS (SELECT DISTINCT sample_id, p AS prototype_id FROM sample_cells, (SELECT unnest(range(0, 1 + (SELECT max(prototype_id) FROM sample_cells))) AS p)), abundance AS (SELECT sample_id, prototype_id, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY sample_id) AS fraction FROM grid LEFT JOIN counts USING (sample_id, prototype_id))"
CLR = ABUNDANCE + ", logged AS (SELECT sample_id, prototype_id, ln((fraction + 0.5e0) / sum(fraction + 0.5e0) OVER (PARTITION BY sample_id)) AS l FROM abundance), clr AS (SELECT sample_id, prototype_id, l - avg(l) OVER (PARTITION BY sample_id) AS clr FROM logged)"


@query(with_views("sample_cells", ABUNDANCE + f" SELECT sample_id, prototype_id, {r9('fraction', 'fraction')} FROM abundance"))
def abundance(spark, sf):
    return rounded(prototypes.abundance(views.sample_cells(spark, sf)), "fraction")


@query(with_views("sample_cells", CLR + f" SELECT sample_id, prototype_id, {r9('clr', 'clr')} FROM clr"))
def clr(spark, sf):
    return rounded(prototypes.clr(prototypes.abundance(views.sample_cells(spark, sf))), "clr")


TYPED = ", typed AS (SELECT p.prototype_id, c.cell_type FROM proto_ev p JOIN cells_ev c USING (cell_id)), mix AS (SELECT prototype_id, cell_type, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY prototype_id) AS fraction FROM typed GROUP BY 1, 2)"


def _typed(spark, sf):
    return views.proto_ev(spark, sf).join(views.cells_ev(spark, sf).select("cell_id", "cell_type"), "cell_id")


@query(with_views("cells_ev proto_ev", TYPED + f" SELECT prototype_id, cell_type, n, {r9('fraction', 'fraction')} FROM mix"))
def composition_matrix(spark, sf):
    return rounded(prototypes.composition(_typed(spark, sf)), "fraction")


@query(with_views("cells_ev proto_ev", TYPED + ", t AS (SELECT count(DISTINCT cell_type) AS t FROM mix), r AS (SELECT prototype_id, max(fraction) AS top, sum(-fraction * ln(fraction)) / ln(max(t)) AS entropy FROM mix, t GROUP BY 1) SELECT " + ", ".join(r9(f"{f}({c})", f"{n}_{c}") for c in ("top", "entropy") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM r"))
def composition_summary(spark, sf):
    got = prototypes.composition_summary(prototypes.composition(_typed(spark, sf)))
    return rounded(got, *got.columns)


@query(with_views("proto_ev", f", s AS (SELECT prototype_id, count(*) AS n FROM proto_ev GROUP BY 1), t AS (SELECT sum(n) AS t FROM s) SELECT max(prototype_id) + 1 AS n_prototypes, min(n) AS min_size, CAST(median(n) AS DOUBLE) AS median_size, max(n) AS max_size, {r9('sum(-n / t * ln(n / t))', 'size_entropy')} FROM s, t"))
def prototype_sizes(spark, sf):
    return rounded(prototypes.size_structure(views.proto_ev(spark, sf)), "size_entropy")


def _kinds_sql(coverage: str) -> str:
    return f", seen AS (SELECT prototype_id, count(DISTINCT section_id) AS k FROM proto_ev GROUP BY 1), total AS (SELECT count(DISTINCT section_id) AS s FROM proto_ev), known AS (SELECT unnest(range(0, 1 + (SELECT max(prototype_id) FROM proto_ev))) AS prototype_id), kinds AS (SELECT prototype_id, coverage, coalesce(k, 0) AS k, s, CASE WHEN s < 2 THEN 'unknown' WHEN coalesce(k, 0) > 0 AND coalesce(k, 0) >= greatest(1, ceil(coverage * s)) THEN 'conserved' ELSE 'sample_specific' END AS proto_kind FROM known LEFT JOIN seen USING (prototype_id), total, (SELECT unnest([{coverage}]) AS coverage))"


@query(with_views("proto_ev", _kinds_sql("0.2e0") + " SELECT prototype_id, proto_kind FROM kinds"))
def proto_kind(spark, sf):
    return prototypes.separation(views.proto_ev(spark, sf), 0.2)


@query(with_views("proto_ev", _kinds_sql("0.2e0") + f" SELECT {r9('avg(CAST(proto_kind = ' + chr(39) + 'conserved' + chr(39) + ' AS INTEGER))', 'conserved_fraction')} FROM kinds WHERE proto_kind <> 'unknown'"))
def conserved_fraction(spark, sf):
    return rounded(prototypes.conserved_fraction(prototypes.separation(views.proto_ev(spark, sf), 0.2)), "conserved_fraction")


RIGHT = "CAST(CASE WHEN proto_kind = 'conserved' THEN k = s WHEN proto_kind = 'sample_specific' THEN k < s END AS INTEGER)"


@query(with_views("proto_ev", _kinds_sql("0.2e0") + f" SELECT {r9(f'avg({RIGHT})', 'section_overlap_rate')} FROM kinds WHERE proto_kind <> 'unknown'"))
def section_overlap_rate(spark, sf):
    protos = views.proto_ev(spark, sf)
    return rounded(prototypes.overlap_rate(protos, prototypes.separation(protos, 0.2)), "section_overlap_rate")


SWEEP = (1.0, 0.8, 0.6, 0.4, 0.2, 0.1)


@query(with_views("proto_ev", _kinds_sql(", ".join(f"{c}e0" for c in SWEEP)) + f" SELECT coverage, {r9('avg(CAST(proto_kind = ' + chr(39) + 'conserved' + chr(39) + ' AS INTEGER))', 'conserved_fraction')}, {r9(f'avg({RIGHT})', 'section_overlap_rate')}, count(*) FILTER (proto_kind = 'conserved') AS n_conserved, count(*) AS n_prototypes FROM kinds GROUP BY 1"))
def coverage_sweep(spark, sf):
    return rounded(prototypes.coverage_sweep(views.proto_ev(spark, sf), SWEEP), "conserved_fraction", "section_overlap_rate")


MARKERS = ", sizes AS (SELECT prototype_id, count(*) AS c FROM expr_protos GROUP BY 1), genes AS (SELECT DISTINCT gene FROM expr), means AS (SELECT s.prototype_id, g.gene, coalesce(sum(e.value), 0) / max(c) AS mean_value FROM sizes s CROSS JOIN genes g LEFT JOIN (SELECT prototype_id, gene, value FROM expr JOIN expr_protos USING (cell_id)) e ON e.prototype_id = s.prototype_id AND e.gene = g.gene GROUP BY 1, 2)"


@query(with_views("expr expr_protos", MARKERS + f" SELECT prototype_id, CAST(rank AS INTEGER) AS rank, gene, {r9('mean_value', 'mean_value')} FROM (SELECT *, row_number() OVER (PARTITION BY prototype_id ORDER BY mean_value DESC, gene) AS rank FROM means) WHERE rank <= 5"))
def marker_table(spark, sf):
    return rounded(prototypes.marker_table(cut(views.expr(spark, sf)), views.expr_protos(spark, sf), 5), "mean_value")


def _top5_sql(name: str, value: str) -> str:
    body = MARKERS.replace("e.value", f"{value}") if value != "e.value" else MARKERS
    return body.replace("sizes AS", f"sizes_{name} AS").replace("genes AS", f"genes_{name} AS").replace("means AS", f"means_{name} AS").replace("FROM sizes s CROSS JOIN genes g", f"FROM sizes_{name} s CROSS JOIN genes_{name} g") + f", {name} AS (SELECT prototype_id, gene FROM (SELECT *, row_number() OVER (PARTITION BY prototype_id ORDER BY mean_value DESC, gene) AS rank FROM means_{name}) WHERE rank <= 5)"


@query(with_views("expr expr_protos", _top5_sql("truth", "e.value") + _top5_sql("found", "sqrt(e.value)") + f", hits AS (SELECT prototype_id, count(f.gene) / count(*) AS r FROM truth LEFT JOIN found f USING (prototype_id, gene) GROUP BY 1) SELECT {r9('avg(r)', 'recall')} FROM hits"))
def marker_recall(spark, sf):
    expr, protos = cut(views.expr(spark, sf)), views.expr_protos(spark, sf)
    truth = prototypes.marker_table(expr, protos, 5)
    pred = prototypes.marker_table(expr.withColumn("value", F.sqrt("value")), protos, 5)
    return rounded(spark.createDataFrame([(prototypes.marker_recall(pred, truth, 5),)], "recall double"), "recall")


@query(with_views("sample_cells outcomes", CLR + ", met AS (SELECT prototype_id, clr, \"binary\" AS g FROM clr JOIN outcomes USING (sample_id)), r AS (SELECT prototype_id, g, rank() OVER (PARTITION BY prototype_id ORDER BY clr) + (count(*) OVER (PARTITION BY prototype_id, clr) - 1) / 2 AS r FROM met), u AS (SELECT prototype_id, sum(r) FILTER (g = 1) AS r1, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0 FROM r GROUP BY 1)"
    f" SELECT prototype_id, CAST(r1 - n1 * (n1 + 1) / 2 AS DOUBLE) AS u, n1, n0, {r9('2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1', 'effect')} FROM u"))  # fmt: skip
def mwu_statistic(spark, sf):
    values = prototypes.clr(prototypes.abundance(views.sample_cells(spark, sf))).withColumnRenamed("clr", "value")
    met = values.join(views.outcomes(spark, sf).withColumnRenamed("binary", "group"), "sample_id")
    return rounded(outcome.rank_sums(met), "effect").drop("tie_sum")


@query(with_views("sample_cells outcomes", CLR + ", met AS (SELECT prototype_id, clr, continuous FROM clr JOIN outcomes USING (sample_id)), r AS (SELECT prototype_id, rank() OVER (PARTITION BY prototype_id ORDER BY clr) + (count(*) OVER (PARTITION BY prototype_id, clr) - 1) / 2 AS a, rank() OVER (PARTITION BY prototype_id ORDER BY continuous) + (count(*) OVER (PARTITION BY prototype_id, continuous) - 1) / 2 AS b FROM met)"
    f" SELECT prototype_id, {r9('corr(a, b)', 'rho')}, count(*) AS n FROM r GROUP BY 1"))  # fmt: skip
def spearman_rho(spark, sf):
    values = prototypes.clr(prototypes.abundance(views.sample_cells(spark, sf))).withColumnRenamed("clr", "value")
    met = values.join(views.outcomes(spark, sf).withColumnRenamed("continuous", "outcome"), "sample_id")
    return rounded(outcome.spearman(met), "rho")


def _integral_sql(density: str, upto: str, steps: int = 400) -> str:
    """Simpson's rule for the integral of ``density`` (in X) from 0 to ``upto``."""
    at = density.replace("X", f"({upto} * i / {steps})")
    return f"({upto} / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {at})))"


def _normal_sql(z: str) -> str:
    """Two-sided p of a normal z."""
    return f"greatest(0, 1 - 2 * {_integral_sql('exp(-X * X / 2) / sqrt(2 * pi())', z)})"


def _fdr_sql(table: str, by: str, key: str) -> str:
    """``adjusted``: ``table`` with q within ``by``."""
    return f", raw_ AS (SELECT *, p * count(*) OVER (PARTITION BY {by}) / row_number() OVER (PARTITION BY {by} ORDER BY p, {key}) AS raw FROM {table}), adjusted AS (SELECT *, least(1, min(raw) OVER (PARTITION BY {by} ORDER BY p DESC, {key} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM raw_)"


MEAN_RANK = "rank() OVER (PARTITION BY prototype_id ORDER BY {0}) + (count(*) OVER (PARTITION BY prototype_id, {0}) - 1) / 2"
OUTCOME = CLR + f", met AS (SELECT prototype_id, clr, \"binary\" AS g, continuous FROM clr JOIN outcomes USING (sample_id)), ranked AS (SELECT prototype_id, g, {MEAN_RANK.format('clr')} AS r, {MEAN_RANK.format('continuous')} AS o, count(*) OVER (PARTITION BY prototype_id, clr) AS t FROM met)"
OUTCOME += ", u AS (SELECT prototype_id, sum(r) FILTER (g = 1) - count(*) FILTER (g = 1) * (count(*) FILTER (g = 1) + 1) / 2 AS u, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 0) AS n0, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM ranked GROUP BY 1), z AS (SELECT prototype_id, u, 2 * u / (n1 * n0) - 1 AS effect, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM u)"
OUTCOME += ", rho AS (SELECT prototype_id, corr(r, o) AS rho, count(*) - 2 AS df FROM ranked GROUP BY 1), t AS (SELECT *, abs(rho) * sqrt(df / (1 - rho * rho)) AS t, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS front FROM rho)"
OUTCOME += f", tested AS (SELECT 'binary' AS kind, prototype_id, u AS statistic, effect, CASE WHEN z <= 0 THEN 1 ELSE {_normal_sql('z')} END AS p FROM z UNION ALL SELECT 'continuous', prototype_id, rho, rho, 1 - 2 * {_integral_sql('front * pow(1 + X * X / df, -(df + 1) / 2)', 't')} FROM t)" + _fdr_sql("tested", "kind", "prototype_id")


@query(with_views("sample_cells outcomes", OUTCOME + f" SELECT kind, prototype_id, {', '.join(r9(c, c) for c in ('statistic', 'effect', 'p', 'q'))} FROM adjusted"))
def outcome_association(spark, sf):
    table = prototypes.abundance(views.sample_cells(spark, sf))
    out = None
    for kind in ("binary", "continuous"):
        labels = views.outcomes(spark, sf).select("sample_id", F.col(kind).cast("double").alias("outcome"))
        rows = outcome.outcome_association(table, labels, label_kind=kind).records.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "statistic", "effect", "p", "q")


@query(with_views("sample_cells", ", p AS (SELECT cell_id, sample_id AS g, ((cell_id * 7919) % 100003 + 1) / 100004.0e0 AS p FROM sample_cells), r AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p, cell_id) AS raw FROM p)"
    f" SELECT cell_id, g, {r9('least(1, min(raw) OVER (PARTITION BY g ORDER BY p DESC, cell_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 'q')} FROM r"))  # fmt: skip
def bh_fdr(spark, sf):
    p = ((F.col("cell_id") * 7919) % 100003 + 1) / F.lit(100004.0)
    rows = views.sample_cells(spark, sf).select("cell_id", F.col("sample_id").alias("g"), p.alias("p"))
    return rounded(outcome.benjamini_hochberg(rows, "p", "cell_id", ("g",)), "q").drop("p")


# --- preprocessing ---------------------------------------------------------------------------------

CELLS = ", cells AS (SELECT o_orderkey AS cell_id FROM orders)"


def _expr_cells(spark, sf):
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"))


@query(with_views("expr", CELLS + " SELECT cell_id, coalesce(sum(value), 0) AS total, count(value) FILTER (value <> 0) AS n_genes, coalesce(sum(value), 0) >= 60 AND count(value) FILTER (value <> 0) >= 3 AS keep FROM cells LEFT JOIN expr USING (cell_id) GROUP BY 1"))
def qc_mask(spark, sf):
    return features.qc_mask(_expr_cells(spark, sf), views.expr(spark, sf), 60, 3)


@query(with_views("expr", f", t AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1), m AS (SELECT median(total) AS goal FROM t WHERE total > 0) SELECT cell_id, gene, {r9('ln(1 + value * goal / total)', 'value')} FROM expr JOIN t USING (cell_id), m"))
def normalize_log1p(spark, sf):
    return rounded(features.normalise_log1p(views.expr(spark, sf)), "value")


@query(with_views("expr", CELLS + ", f AS (SELECT cell_id FROM cells ORDER BY cell_id LIMIT 2000), s AS (SELECT min(value) AS low, max(value) AS high, bool_and(abs(value - round_even(value, 0)) <= 1e-8 + 1e-5 * abs(round_even(value, 0))) AS whole, count(*) AS n FROM expr JOIN f USING (cell_id)) SELECT low, high, whole, n, n > 0 AND low >= 0 AND (high > 30 OR (whole AND high >= 2)) AS raw FROM s"))
def raw_count_probe(spark, sf):
    return features.raw_count_probe(views.expr(spark, sf), _expr_cells(spark, sf))


MOMENTS = CELLS + ", n AS (SELECT count(*) AS n FROM cells), m AS (SELECT gene, sum(value) / max(n) AS mean, sqrt(sum(value * value) / max(n) - (sum(value) / max(n)) * (sum(value) / max(n))) AS sd FROM expr, n GROUP BY 1)"


@query(with_views("expr", MOMENTS + f" SELECT gene, {r9('mean', 'mean')}, {r9('sd', 'sd')} FROM m"))
def gene_moments(spark, sf):
    return rounded(features.gene_moments(views.expr(spark, sf), _expr_cells(spark, sf)), "mean", "sd")


@query(with_views("expr", MOMENTS + f" SELECT e.cell_id, e.gene, e.value, {r9('(e.value - g.mean) / g.sd', 'z')} FROM expr e JOIN m g ON e.gene = g.gene"))
def zscore(spark, sf):
    return rounded(features.zscores(views.expr(spark, sf), _expr_cells(spark, sf)), "z")


_PANEL_SQL = ", ".join(f"({i}, '{t}', '{g}')" for i, (t, genes) in enumerate(PANEL.items()) for g in genes)


@query(with_views("expr", MOMENTS + f", panel(pos, cell_type, gene) AS (VALUES {_PANEL_SQL}), s AS (SELECT c.cell_id, pos, cell_type, avg((coalesce(e.value, 0) - mean) / sd) AS score FROM cells c CROSS JOIN panel p JOIN m ON m.gene = p.gene LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = p.gene GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 9) DESC, pos) AS k FROM s)"
    f" SELECT cell_id, CASE WHEN round(score, 9) < 0.1 THEN 'unassigned' ELSE cell_type END AS cell_type, CAST(CASE WHEN round(score, 9) < 0.1 THEN {len(PANEL)} ELSE pos END AS BIGINT) AS code, {r9('score', 'score')} FROM r WHERE k = 1"))  # fmt: skip
def marker_annotation(spark, sf):
    expr, cells = cut(views.expr(spark, sf)), _expr_cells(spark, sf)
    panel = spark.createDataFrame([(i, t, g) for i, (t, genes) in enumerate(PANEL.items()) for g in genes], "type_pos int, cell_type string, gene string")
    panel = panel.join(expr.select("gene").distinct(), "gene", "left_semi")
    best = annotate.best_type(rounded(annotate.marker_scores(expr, cells, panel), "score"))
    low = F.col("score") < 0.1
    return best.select("cell_id", F.when(low, "unassigned").otherwise(F.col("cell_type")).alias("cell_type"), F.when(low, len(PANEL)).otherwise(F.col("type_pos")).cast("long").alias("code"), "score")


@query(with_views("cells_ev", ", b AS (SELECT section_id, (max(x) - min(x)) * (max(y) - min(y)) AS area, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM cells_ev GROUP BY 1), g AS (SELECT count(*) AS n_sections, (max(hx) - min(lx)) * (max(hy) - min(ly)) AS global_area, median(area) AS section_area FROM b)"
    f" SELECT n_sections, {r9('global_area', 'global_area')}, {r9('section_area', 'section_area')}, {r9('global_area / section_area', 'ratio')}, global_area > 0 AND global_area / section_area < 4 AS shared FROM g"))  # fmt: skip
def section_frames(spark, sf):
    return rounded(features.section_frames(views.cells_ev(spark, sf)), "global_area", "section_area", "ratio")


@query("WITH c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT doc_id, coalesce(code, -1) AS code FROM documents LEFT JOIN c USING (source)")
def category_codes(spark, sf):
    return features.category_codes(views.table(spark, sf, "documents").select("doc_id", "source"), "source").select("doc_id", "code")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(lower(trim(CAST(quality AS VARCHAR))) IN ('nan', 'none', 'na', 'null', ''), TRUE)")
def unlabeled_filter(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id").join(views.table(spark, sf, "labels"), "doc_id", "left")
    return docs.where(~features.unlabelled(F.col("quality"))).select("doc_id")


# --- communication and markers ---------------------------------------------------------------------


def _clusters(spark, sf):
    return views.expr_protos(spark, sf).select("cell_id", F.col("prototype_id").cast("string").alias("cluster"))


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "ligand string, receptor string")


LIGREC = ", cl AS (SELECT cell_id, CAST(prototype_id AS VARCHAR) AS cluster FROM expr_protos), sz AS (SELECT cluster, count(*) AS c FROM cl GROUP BY 1), lm AS (SELECT cluster, gene, sum(value) / max(c) AS mean, count(*) FILTER (value > 0) / max(c) AS expressed FROM expr JOIN cl USING (cell_id) JOIN sz USING (cluster) GROUP BY 1, 2), pairs(ligand, receptor) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + "), scores AS (SELECT ligand, receptor, l.cluster AS source, r.cluster AS target, (l.mean + r.mean) / 2 AS score FROM pairs JOIN lm l ON l.gene = ligand AND l.expressed >= 0.01 JOIN lm r ON r.gene = receptor AND r.expressed >= 0.01)"


@query(with_views("expr expr_protos", LIGREC + f" SELECT cluster, gene, {r9('mean', 'mean')}, {r9('expressed', 'expressed')} FROM lm"))
def ligrec_means(spark, sf):
    return rounded(communication.cluster_means(cut(views.expr(spark, sf)), _clusters(spark, sf)), "mean", "expressed")


@query(with_views("expr expr_protos", LIGREC + f" SELECT ligand, receptor, source, target, {r9('score', 'score')} FROM scores"))
def ligrec_scores(spark, sf):
    return rounded(communication.interaction_scores(communication.cluster_means(cut(views.expr(spark, sf)), _clusters(spark, sf)), _pairs(spark)), "score")


@query(with_views("expr expr_protos", LIGREC + _shuffles_sql("cl", "cluster", 100) + ", wanted AS (SELECT ligand AS gene FROM pairs UNION SELECT receptor FROM pairs), dm AS (SELECT perm, label AS cluster, gene, sum(value) / max(c) AS mean FROM drawn JOIN expr USING (cell_id) JOIN wanted USING (gene) JOIN sz ON sz.cluster = label GROUP BY 1, 2, 3), nulls AS (SELECT s.ligand, s.receptor, s.source, s.target, s.score, (coalesce(l.mean, 0) + coalesce(r.mean, 0)) / 2 AS x FROM scores s CROSS JOIN keys k LEFT JOIN dm l ON l.perm = k.perm AND l.gene = ligand AND l.cluster = source LEFT JOIN dm r ON r.perm = k.perm AND r.gene = receptor AND r.cluster = target)"
    f" SELECT ligand, receptor, source, target, {r9('max(score)', 'score')}, count(*) FILTER (round(x, 9) >= round(score, 9)) / 100 AS pvalue FROM nulls GROUP BY 1, 2, 3, 4"))  # fmt: skip
def interaction_summary(spark, sf):
    return rounded(communication.interaction_summary(cut(views.expr(spark, sf)), cut(_clusters(spark, sf)), _pairs(spark)), "score")


@query(with_views("expr expr_protos", LIGREC + f" SELECT ligand, receptor, source, target, {r9('score', 'score')}, {r9('score / 100', 'pvalue')} FROM scores"))
def melt_tidy(spark, sf):
    scores = cut(ligrec_scores(spark, sf))
    wide = scores.groupBy("ligand", "receptor").pivot("pair") if "pair" in scores.columns else scores.withColumn("pair", F.concat_ws("|", "source", "target")).groupBy("ligand", "receptor").pivot("pair")
    melted = communication.melt(wide.agg(F.first("score")), "score")
    return rounded(communication.tidy(melted, melted.select(*communication.KEYS, (F.col("score") / 100).alias("pvalue"))), "score", "pvalue")


@query(with_views("expr expr_protos", LIGREC + ", pr AS (SELECT ligand, receptor, source, target, row_number() OVER (ORDER BY round(score, 9) DESC, ligand, receptor, source, target) AS rank FROM scores), tr AS (SELECT ligand, receptor, source, target FROM scores WHERE source < target), h AS (SELECT count(*) AS hits FROM pr JOIN tr USING (ligand, receptor, source, target) WHERE rank <= 25), c AS (SELECT count(*) AS considered FROM pr WHERE rank <= 25), w AS (SELECT count(*) AS wanted FROM tr)"
    f" SELECT {r9('hits / considered', 'precision')}, {r9('hits / wanted', 'recall')}, {r9('hits / wanted', 'hit_rate')}, hits AS n_recovered FROM h, c, w"))  # fmt: skip
def ccc_topk(spark, sf):
    from pyspark.sql import Window

    scores = cut(ligrec_scores(spark, sf))
    order = Window.orderBy(F.desc("score"), *communication.KEYS)  # one row a pair of clusters and genes
    pred = scores.withColumn("rank", F.row_number().over(order)).drop("score")
    return rounded(communication.top_k_score(pred, scores.where("source < target").select(*communication.KEYS), 25), "precision", "recall", "hit_rate")


@query(with_views("expr expr_protos", ", g AS (SELECT DISTINCT gene FROM expr), d AS (SELECT p.cell_id, p.prototype_id, g.gene, coalesce(e.value, 0) AS value FROM expr_protos p CROSS JOIN g LEFT JOIN expr e ON e.cell_id = p.cell_id AND e.gene = g.gene), r AS (SELECT prototype_id, gene, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS r FROM d), n AS (SELECT count(*) AS n FROM expr_protos), s AS (SELECT prototype_id, gene, sum(r) AS r, count(*) AS m, max(n) AS n, avg(value) AS mean_in, sum(value) AS t FROM r, n GROUP BY 1, 2)"
    f" SELECT prototype_id, gene, CAST(r AS DOUBLE) AS rank_sum, {r9('(r - m * (n + 1) / 2) / sqrt(m * (n - m) * (n + 1.0e0) / 12)', 'z')}, {r9('mean_in', 'mean_in')}, {r9('(sum(t) OVER (PARTITION BY gene) - t) / (n - m)', 'mean_out')} FROM s"))  # fmt: skip
def de_rank_sums(spark, sf):
    return rounded(annotate.rank_sum_scores(cut(views.expr(spark, sf)), cut(views.expr_protos(spark, sf))), "z", "mean_in", "mean_out")


DE = ", totals AS (SELECT cell_id, sum(value) AS t FROM expr GROUP BY 1), logged AS (SELECT cell_id, gene, ln(1 + value * 10000.0e0 / t) AS value FROM expr JOIN totals USING (cell_id)), d AS (SELECT p.cell_id, p.prototype_id, g.gene, coalesce(e.value, 0) AS value FROM expr_protos p CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN logged e ON e.cell_id = p.cell_id AND e.gene = g.gene), r AS (SELECT prototype_id, gene, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS r FROM d), n AS (SELECT count(*) AS n FROM expr_protos), s AS (SELECT prototype_id, gene, sum(r) AS r, count(*) AS m, max(n) AS n, avg(value) AS mean_in, sum(value) AS t FROM r, n GROUP BY 1, 2), scored AS (SELECT prototype_id, gene, (r - m * (n + 1) / 2) / sqrt(m * (n - m) * (n + 1.0e0) / 12) AS z, mean_in, (sum(t) OVER (PARTITION BY gene) - t) / (n - m) AS mean_out FROM s)"
DE += f", tested AS (SELECT *, {_normal_sql('abs(z)')} AS p FROM scored)" + _fdr_sql("tested", "prototype_id", "gene")


@query(with_views("expr expr_protos", DE + f" SELECT prototype_id, CAST(rank AS INTEGER) AS rank, gene, {r9('z', 'score')}, round(log2((exp(mean_in) - 1 + 1e-9) / (exp(mean_out) - 1 + 1e-9)), 7) + 0.0 AS logfc, {r9('p', 'p')}, {r9('q', 'q')} FROM (SELECT *, row_number() OVER (PARTITION BY prototype_id ORDER BY z DESC, gene) AS rank FROM adjusted) WHERE rank <= 5"))
def de_markers(spark, sf):
    got = annotate.de_markers(cut(views.expr(spark, sf)), cut(views.expr_protos(spark, sf)), 5)
    return rounded(got, "score", "p", "q").withColumn("logfc", F.round("logfc", 7) + 0.0)


# --- embeddings and models -------------------------------------------------------------------------


def _embedded(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("h"))


SILHOUETTE = ", v AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS h FROM embeddings), d AS (SELECT a.cell_id, pa.prototype_id AS own, pb.prototype_id AS other, sum(list_distance(a.h, b.h)) AS d, count(*) FILTER (a.cell_id <> b.cell_id) AS n FROM v a, v b, proto_emb pa, proto_emb pb WHERE pa.cell_id = a.cell_id AND pb.cell_id = b.cell_id GROUP BY 1, 2, 3), ab AS (SELECT cell_id, max(CASE WHEN own = other THEN d / nullif(n, 0) END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM d GROUP BY 1)"


@query(with_views("proto_emb", SILHOUETTE + " SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 7) + 0.0 AS silhouette FROM ab"))
def silhouette(spark, sf):
    return cluster.silhouette(_embedded(spark, sf), views.proto_emb(spark, sf), "h").select((F.round("silhouette", 7) + 0.0).alias("silhouette"))


# the scores on all components hold what the centred rows hold: the trace of their scatter and of its square
SPECTRUM = ", m AS (SELECT gene_id, avg(value) AS m FROM features_emb GROUP BY 1), x AS MATERIALIZED (SELECT cell_id, gene_id, value - m AS v FROM features_emb JOIN m USING (gene_id)), c AS (SELECT a.gene_id AS i, b.gene_id AS j, sum(a.v * b.v) AS c FROM x a JOIN x b USING (cell_id) GROUP BY 1, 2)"


@query(with_views("features_emb", SPECTRUM + " SELECT round(sum(c) FILTER (i = j), 6) + 0.0 AS trace, round(sum(c * c) / sum(c) FILTER (i = j), 6) + 0.0 AS spread FROM c"))
def pca_spectrum(spark, sf):
    scores = cluster.pca(_embedded(spark, sf), views.FEATURES, "h").select("cell_id", F.posexplode("features").alias("i", "v"))
    strength = scores.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    return strength.agg((F.round(F.sum("s"), 6) + 0.0).alias("trace"), (F.round(F.sum(F.col("s") * F.col("s")) / F.sum("s"), 6) + 0.0).alias("spread"))


def _components_sql(k: int, squarings: int = 18) -> str:
    """``scores`` (cell_id, component, score): leading components by squaring the scatter matrix again and again, which leaves the strongest, and taking each off it."""
    out = SPECTRUM.replace(", c AS (", ", c0 AS MATERIALIZED (")
    for t in range(k):
        out += f", p{t}_0 AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FILTER (i = j) FROM c{t}) AS c FROM c{t})"
        for n in range(squarings):
            out += f", s{t}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM p{t}_{n} a JOIN p{t}_{n} b ON a.j = b.i GROUP BY 1, 2), p{t}_{n + 1} AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FILTER (i = j) FROM s{t}_{n}) AS c FROM s{t}_{n})"
        last = f"p{t}_{squarings}"
        out += f", u{t} AS MATERIALIZED (SELECT i, c / sqrt((SELECT sum(c * c) FROM {last} WHERE j = (SELECT arg_max(i, c) FROM {last} WHERE i = j))) AS u FROM {last} WHERE j = (SELECT arg_max(i, c) FROM {last} WHERE i = j))"
        out += f", v{t} AS MATERIALIZED (SELECT i, u * sign((SELECT arg_max(u, abs(u)) FROM u{t})) AS v FROM u{t}), l{t} AS (SELECT sum(a.v * c * b.v) AS l FROM c{t} JOIN v{t} a USING (i) JOIN v{t} b ON b.i = c{t}.j)"
        out += f", c{t + 1} AS MATERIALIZED (SELECT c{t}.i, j, c - l * a.v * b.v AS c FROM c{t} JOIN v{t} a USING (i) JOIN v{t} b ON b.i = c{t}.j, l{t})"
    every = " UNION ALL ".join(f"SELECT {t} AS component, i, v FROM v{t}" for t in range(k))
    return out + f", scores AS (SELECT cell_id, CAST(component AS INTEGER) AS component, sum(x.v * w.v) AS score FROM x JOIN ({every}) w ON w.i = x.gene_id GROUP BY 1, 2)"


@query(with_views("features_emb", _components_sql(8) + " SELECT cell_id, component, round(score, 6) + 0.0 AS score FROM scores"))
def pca(spark, sf):
    scores = cluster.pca(_embedded(spark, sf), 8, "h").select("cell_id", F.posexplode("features").alias("component", "score"))
    return scores.withColumn("score", F.round("score", 6) + 0.0)


@query(with_views("features_emb", _components_sql(2) + " SELECT cell_id, round(max(score) FILTER (component = 0), 6) + 0.0 AS px, round(max(score) FILTER (component = 1), 6) + 0.0 AS py FROM scores GROUP BY 1"))
def projection_2d(spark, sf):
    return cluster.projection(_embedded(spark, sf), "h").select("cell_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("px", "py")])


NEAR = "WITH v AS (SELECT min(vec_id) AS cell_id, CAST(embedding AS DOUBLE[]) AS h FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding), p AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.h, b.h) AS dist FROM v a, v b WHERE a.cell_id <> b.cell_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM p)"


@query(NEAR + " SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 9) + 0.0 AS dist FROM r WHERE rank <= 15")
def embedding_neighbours(spark, sf):
    return rounded(layout.embedding_neighbours(_embedded(spark, sf), 15, column="h"), "dist")


@query()
def planar_layout(spark, sf):
    return layout.planar_layout(_embedded(spark, sf), 15, column="h")


def _kmeans_sql(k: int, iterations: int, seed: int = 0) -> str:
    """``named`` (cell_id, prototype_id): starts drawn by squared distance, then assignments and means on the sphere."""
    out = ", raw AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS h FROM embeddings), x AS MATERIALIZED (SELECT cell_id, list_transform(h, lambda v: v / sqrt(list_dot_product(h, h))) AS h FROM raw)"
    for step in range(k):
        hashed = f"((cell_id % {PRIME}) * 48271 + {(step + 1) * 7919 + seed * 15485863 + 12345}) % {PRIME}"
        chain = f"SELECT cell_id, {hashed} AS h0"
        for turn in range(3):
            chain = f"SELECT *, (h{turn} * h{turn} % {PRIME} * 48271 + h{turn} + 11) % {PRIME} AS h{turn + 1} FROM ({chain}" + (" FROM x)" if turn == 0 else ")")
        far = "1" if step == 0 else f"(SELECT min(list_sum(list_transform(list_zip(x.h, c.h), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) FROM (" + " UNION ALL ".join(f"SELECT h FROM c{i}" for i in range(step)) + ") c)"
        out += f", c{step} AS MATERIALIZED (SELECT {step} AS label, h FROM (SELECT cell_id, h, -ln((h3 + 0.5e0) / {PRIME}) / nullif({far}, 0) AS turn FROM x JOIN ({chain}) USING (cell_id)) ORDER BY turn NULLS LAST, cell_id LIMIT 1)"
    out += ", g0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT label, h FROM c{i}" for i in range(k)) + ")"
    nearest = "SELECT cell_id, x.h, arg_min(g.label, [list_dot_product(g.h, g.h) / 2 - list_dot_product(x.h, g.h), g.label]) AS label FROM x CROSS JOIN {} g GROUP BY 1, 2"
    for turn in range(iterations):
        out += f", a{turn} AS MATERIALIZED ({nearest.format(f'g{turn}')}), m{turn} AS (SELECT label, list(s ORDER BY i) AS h FROM (SELECT label, i, avg(v) AS s FROM (SELECT label, unnest(h) AS v, unnest(range(len(h))) AS i FROM a{turn}) GROUP BY 1, 2) GROUP BY 1), g{turn + 1} AS MATERIALIZED (SELECT g.label, CASE WHEN m.h IS NULL THEN g.h ELSE list_transform(m.h, lambda v: v / sqrt(list_dot_product(m.h, m.h))) END AS h FROM g{turn} g LEFT JOIN m{turn} m USING (label))"
    out += f", last AS ({nearest.format(f'g{iterations}')}), ids AS (SELECT label, row_number() OVER (ORDER BY min(cell_id)) - 1 AS prototype_id FROM last GROUP BY 1)"
    return out + ", named AS (SELECT cell_id, prototype_id FROM last JOIN ids USING (label))"


@query(with_views("proto_emb", _kmeans_sql(8, 50) + " SELECT * FROM named"))
def kmeans_assign(spark, sf):
    return cluster.spherical_kmeans(_embedded(spark, sf), 8, column="h")


@query()
def k_stability(spark, sf):
    return cluster.k_stability(_embedded(spark, sf), column="h")


@query()
def encoder_embeddings(spark, sf):
    embedded = _embedded(spark, sf)
    config = encoder.EncoderConfig()
    tiles = encoder.near_tiles(views.cells_emb(spark, sf), config)
    return encoder.train_embeddings(embedded, cut(edges_emb(spark, sf)), config, column="h", tiles=tiles)


@query()
def fit_model(spark, sf):
    cells = views.cells_emb(spark, sf)
    config = model.NicheModelConfig(encoder=encoder.EncoderConfig(batch_size=features.effective_batch_size(0, cells.count())))
    got = model.fit(cells, views.features_emb(spark, sf), config, n_genes=views.FEATURES, edges=cut(edges_emb(spark, sf)))
    return got.assignments.join(got.prototypes, "prototype_id")


@query()
def baseline_metrics(spark, sf):
    metrics = runs.run_baseline("neighborhood", views.cells_emb(spark, sf), views.features_emb(spark, sf), views.FEATURES)[2]
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in metrics.items()], "metric string, value double")


@query()
def supervised_table(spark, sf):
    labels = views.proto_emb(spark, sf)
    return model.supervised_table(_embedded(spark, sf), labels.select("cell_id", "prototype_id"), labels.withColumnRenamed("section_id", "label"), ["label"], [0, 1], column="h")


# --- reports and catalogs --------------------------------------------------------------------------


@query(EMB + ENDS + ", m AS (SELECT avg(prototype_id) AS mean, var_pop(prototype_id) AS v FROM proto_emb) SELECT 'argmax' AS method, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in report.LEADERBOARD if c != "niche_morans_i") + f", {r9('avg((a - mean) * (b - mean)) / max(v)', 'niche_morans_i')} FROM ends, m")
def leaderboard(spark, sf):
    folder = tempfile.mkdtemp(prefix="tessera-report-")
    sizes = prototypes.size_structure(views.proto_emb(spark, sf)).first()
    value = spatial.morans_i(views.proto_emb(spark, sf), edges_emb(spark, sf), "prototype_id").first()[0]
    written = report.write_results("argmax", "embeddings", {"niche_morans_i": value, "size_entropy": sizes["size_entropy"]}, results_dir=folder)
    report.emit_leaderboard([written["metrics"]], Path(folder))
    return rounded(report.leaderboard_table(spark, [written["metrics"]]), "niche_morans_i")


@query("SELECT 'events' AS dataset, count(*) AS n_cells, 2.0e0 AS wall_clock_s, 2.0e0 AS peak_rss_gb, count(*) / 2.0e0 AS throughput_cells_per_s, 'full-batch' AS infonce_mode, 'ok' AS status FROM events UNION ALL SELECT 'declared', 9000000, NULL, NULL, NULL, 'full-batch', 'blocked'")
def scalability_table(spark, sf):
    n = views.table(spark, sf, "events").count()
    rows = [report.run_row({"dataset_card_id": "events", "n_obs": n, "runtime_s": 2.0, "peak_rss_bytes": 2e9}), report.declared_row({"dataset": "declared", "n_cells": 9_000_000, "status": "blocked"})]
    return report.scalability_table(spark, rows)
