"""Token counts, conversation repair and centroid clustering against the library, all edits and plain Lloyd; and on odd rows."""

import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import op11_token_counts, op12_conversations, op13_delta_lloyd
from tessera.llm.queries import ORACLES, QUERIES

PIECES, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_delta_lloyd"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


# --- token counts ----------------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "  ", "a", " a", "a  b", "x" * 30_000, "long words here " * 9_000, " " * 20_000, "漢字かな" * 6_000, "a\n" * 15_000, "<s> </s> <unk> <0x41> <|endoftext|>" * 900,
    "tie", "tie", "é é ﬁ \x00 \x85 ▁ \U0001f642", "word▁" * 4_000, "ab" * 20_000 + " " + "c" * 9_000,
]


def test_counts_equal_library(spark, sf_dir, monkeypatch):
    odd = spark.createDataFrame([(k if k else None, t, "x", 5) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, n_bytes int")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("x").alias("n_tokens"), F.lit(5).alias("n_bytes"))
    docs = odd.unionByName(real)
    pieces, units = SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for path, count in ((PIECES, lambda t: len(pieces.encode(t))), (BYTES, lambda t: len(units.encode(t, add_special_tokens=False).ids))):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in op11_token_counts.counted(docs, path, "doc_id").collect())
        assert got == sorted((str(d), len(t.encode()), count(t)) for d, t in rows)
    assert op11_token_counts.counted(docs.limit(0), PIECES, "doc_id").count() == 0
    query = op11_token_counts.op11_token_counts(spark, sf_dir).collect()
    assert query and all(r["over_limit"] == (r["n_tokens"] > 4096) for r in query)
    with pytest.raises(ValueError, match="byte-level"):
        op11_token_counts.loaded(public_tokenizers.path("word_bpe_49k.json"))


def test_cuts_are_safe_at_any_size(monkeypatch):
    monkeypatch.setattr(op11_token_counts, "PIECE", 5)
    monkeypatch.setattr(op11_token_counts, "BATCH_BYTES", 40)
    random, letters = np.random.default_rng(3), list("aeinorst  \n\t'▁sSléß漢1½²!#.　\U0001f642")
    texts = ["".join(random.choice(letters, random.integers(0, 80))) for _ in range(1500)]
    for path in (PIECES, BYTES):
        model = op11_token_counts.loaded(path)
        assert any(len(list(model.cuts(t))) > 3 for t in texts)
        assert op11_token_counts.count_texts(texts, model.cuts, model.counts).tolist() == model.counts(texts)


# --- conversations ---------------------------------------------------------------------------------------


def brute(rows):
    """(cost, audit, repaired lines) of rows of (must go, role, truncated, text), by trying edits in order of cost and letters."""
    best, stack = None, [(0, "", 0, 0, ())]
    seen = {}
    while stack:
        stack.sort(key=lambda s: s[:2], reverse=True)
        cost, audit, k, q, lines = stack.pop()
        if seen.get((k, q), (cost, audit)) < (cost, audit):
            continue
        seen[k, q] = cost, audit
        if k == len(rows) and q in (0, 3):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
            continue
        then = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        name = {2: "user", 3: "assistant"}[then]
        if cost + 3 <= 4 * len(rows):
            stack.append((cost + 3, audit + "I", k, then, (*lines, name + ":")))
        if k < len(rows):
            doomed, role, truncated, text = rows[k]
            stack.append((cost + 4, audit + "D", k + 1, q, lines))
            to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, role[:1]))
            if not doomed and to:
                stack.append((cost + 3 * truncated, audit + "K", k + 1, to, (*lines, f"{role}:{text}")))
            if not doomed:
                stack.append((cost + 3 + 3 * truncated, audit + "R", k + 1, then, (*lines, f"{name}:{text}")))
    return best


def plain(rows):
    """What a conversation of (turn, role, text) comes to."""
    white = " \t\n\x0b\x0c\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, found, edits = set(), [], []
    for _, role, text in rows:
        shown = text.rstrip(white)
        found.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
        edits.append((found[-1] in ("blank", "duplicate"), role, found[-1] == "truncated", text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = brute(edits)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_every_short_conversation():
    kinds = [(True, "user", False), *itertools.product((False,), ("system", "user", "assistant", "tool"), (False, True))]
    for n in range(4):
        for some in itertools.product(kinds, repeat=n):
            rows = [(d, r, t, f"t{k}") for k, (d, r, t) in enumerate(some)]
            letters, _ = op12_conversations.walk([(d, r[0] if r[0] in "sua" else "", t) for d, r, t, _ in rows], op12_conversations.BEGIN, op12_conversations.END, 0, True)
            cost, audit, want = brute(rows)
            lines, state = [], 0
            for edit, role, text in zip(letters, [r[1] for r in rows] + [None], [r[3] for r in rows] + [None], strict=True):
                more, state = op12_conversations.repaired(edit, state, role, text)
                lines += more
            assert ("".join(letters), tuple(lines)) == (audit, want)
            assert op12_conversations.backward([(d, r[0] if r[0] in "sua" else "", t) for d, r, t, _ in rows], op12_conversations.END)[0][0] == cost


def test_conversations_of_any_size(spark):
    """Many short ones, one of a third of all rows, odd turns and nulls, spread over few and many ranges."""
    random = np.random.default_rng(5)
    words, roles = ["a.", "b", " \t", "c!", "d. \n", "", "e?"], ["user", "assistant", "system", "tool", ""]
    rows = [(int(c), int(t), str(random.choice(roles)), f"{random.choice(words)}") for c in range(150) for t in range(random.integers(1, 9))]
    rows += [(999, int(t), str(random.choice(roles, p=[0.45, 0.45, 0.02, 0.04, 0.04])), f"{t % 190}{random.choice(words)}") for t in range(700)]
    rows += [(None, None, "user", "null."), (None, 3, "assistant", "x."), (1000, None, "user", "first"), (1000, 7, "assistant", "y."), (1001, None, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit(False)).withColumn("cost", F.lit("clash"))
    bare = spark.createDataFrame([(2000, 1, None, None, True, "clash")], table.schema)
    want = {c: plain([r[1:] for r in some]) for c, some in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0])}
    want[2000] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for parts, coalesce in (("4", "true"), ("23", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            ready = table.unionByName(bare).select("conv_id", "turn", "role", "text", "gone")
            assert {r["conv_id"]: tuple(r)[1:] for r in op12_conversations.mended(ready).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert op12_conversations.mended(ready.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "Hm. Yes! No?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = op12_conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit("clash"))).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else "Hm Yes No" if kind == 2 and c is not None else text
        want += [(c, t, None if kind == 0 else "user" if kind == 4 else role, None if kind == 0 else text, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# --- centroids -------------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds):
    kept = [(v, [int(np.floor(1024 * float(x))) for x in e]) for v, e in vectors if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [c for _, c in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        owners = [nearest(x)[1] for _, x in kept]
        for i in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, owners, strict=True) if o == i]
            if mine:
                centres[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((str(v), nearest(x)[1], nearest(x)[0], hashlib.sha256(",".join(map(str, centres[nearest(x)[1]])).encode()).hexdigest()) for v, x in kept)


def test_centroids(spark, sf_dir):
    real = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()][:90]
    width = lambda x: [float(x)] * 64
    odd = [(None, width(1)), (None, width(1)), (-1, None), (-2, []), (-3, [1.0] * 63), (-4, [None] + [1.0] * 63), (-5, [float("nan")] + [1.0] * 63), (-6, [float("inf")] + [1.0] * 63), (-7, width(0)), (-7, width(0)), (-8, width(-5000.3)), (5, width(0.01))]
    for rows, k, rounds in ((real + odd, 8, 10), (real + odd, 8, 1), (odd, 4, 3), (real[:3], 8, 10), ([real[0]] * 200, 8, 2)):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"owner": F.lit("clash"), "id": F.lit("clash"), "x": F.lit(1)})
        assigned, centres, _ = op13_delta_lloyd.clustered(table, k, rounds)
        got = op13_delta_lloyd.described(assigned, centres).collect()
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == lloyd(rows, k, rounds)
        assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
        assert all(r["cluster_inertia"] == sum(x["distance"] for x in got if x["cluster"] == r["cluster"]) for r in got)
    empty = op13_delta_lloyd.clustered(table.limit(0))
    assert op13_delta_lloyd.described(*empty[:2]).count() == 0 and empty[2] == []


def test_rounds_compare_what_moved():
    """A round with the known owners gives what comparing everything gives, ties included."""
    random = np.random.default_rng(2)
    x, centres = random.integers(-4, 5, (4000, 3)), random.integers(-4, 5, (8, 3))
    owner, distance = op13_delta_lloyd.reassigned(x, np.full(4000, -1), np.zeros(4000, np.int64), centres, np.ones(8, bool))
    for _ in range(20):
        moved = random.random(8) < 0.3
        centres = np.where(moved[:, None], random.integers(-4, 5, (8, 3)), centres)
        owner, distance = op13_delta_lloyd.reassigned(x, owner, distance, centres, moved)
        d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        assert (owner == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
