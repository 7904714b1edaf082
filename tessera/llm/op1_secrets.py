"""Secret scans: three base patterns, and Markov log-likelihood ratios for random-looking strings.

DataFrame expressions only. Spans are (start, kind number, end) structs in code points, end exclusive;
kinds are numbered as in KINDS. Base patterns are matched leftmost and non-overlapping per kind, and
failing matches are consumed and dropped. The fourth kind holds stretches of runs of CANDIDATE characters
that a character Markov model of random strings explains better, by THRESHOLD nats in total and PER_STEP
nats a transition, than one of ordinary identifiers. A run is scored pair by pair: a stretch begins where
the running sum rises above zero, ends where it was largest, and is closed at the sign (none of a letter or
digit) by which the sum has fallen by DROP or below zero; so a token is found at the end of a long path,
and several of a run are. A stretch is widened to whole groups of letters and digits, and what base spans
cover is taken out of it, so that no part of a secret beside a base span is left.

Null or empty text: no spans. Repeated rows and ids: each row is scanned alone. Very long texts: cost is
linear in the text; only the list of one row's matches is built in memory. Empty tables give empty
results. Cheap tests that every match must pass (a sign, four letters, a digit) spare most texts the
patterns. Other columns of the input are left alone; the scan works on a text column given by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spare, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: Greedy maximal runs, so the least length can stand in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Whole runs of CANDIDATE characters that are shorter than that and begin with a letter.
WORDLIKE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_/-]{3,18}(?![A-Za-z0-9+/_=-])"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: any other character
SMOOTHING = 0.5
THRESHOLD, PER_STEP, DROP = 10.0, 0.4, 8.0
#: Characters of a widened stretch; as many as of a run.
STRETCH = 20
GROUPED = 62  # states of letters and digits come first

#: Ordinary words that identifiers are made of (fixed values).
IDENTIFIER_WORDS = (
    "user name value index table column filter partition count total order customer list item get set make build "
    "read write file path config default max min size limit start end time date event stream batch group join left "
    "right inner key hash sort merge split token parse format string number double integer boolean schema query plan "
    "node edge graph cell label score model train test data source target input output buffer cache memory thread "
    "worker server client request response session cookie header body page image style script button window frame "
    "http https www com org net html index products category article download documentation reference example"
).split()


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """Label 1: n strings for each of three alphabets, drawn by hashing a counter."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    kinds = [F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", "XYZ")]
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("sample"), F.lit(1).alias("label"))


def ordinary_samples(spark: SparkSession, n: int) -> DataFrame:
    """Label 0: n compounds of IDENTIFIER_WORDS for each of five ways to write identifiers and paths."""
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    at = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    three = F.array(at(1), at(2), at(3))
    kinds = [F.array_join(three, "_"), F.array_join(three, "-"), F.array_join(three, "/"), F.regexp_replace(F.initcap(F.array_join(three, " ")), " ", ""), F.concat(F.upper(F.array_join(three, "_")), F.pmod("id", F.lit(10)).cast("string"))]
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("sample"), F.lit(0).alias("label"))


def word_samples(docs: DataFrame, n_docs: int, n_all: int) -> DataFrame:
    """Label 0: words and identifiers of about ``n_docs`` of ``n_all`` documents, chosen by a hash of id and text.

    Digits and signs take part as they do in real identifiers; runs long enough to be CANDIDATE and what the
    base patterns match are left out, as they are what is judged.
    """
    share = 1.0 if n_all == 0 else min(1.0, n_docs / n_all)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("markov")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    text = F.coalesce("text", F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    return chosen.select(F.explode(F.regexp_extract_all(text, F.lit(WORDLIKE), 0)).alias("sample"), F.lit(0).alias("label"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, STATES x STATES flattened, from (sample string, label 0/1).

    Transition counts are aggregated by Spark; only the fixed table of at most 2 * STATES^2 counts
    reaches the driver. Null samples and labels other than 0 and 1 are ignored.
    """
    counts = [[SMOOTHING] * (STATES * STATES) for _ in range(2)]
    steps = _transitions(F.col("sample"))
    got = samples.where("sample is not null and label in (0, 1)").select("label", F.explode(steps).alias("step"))
    for label, step, n in got.groupBy("label", "step").count().collect():
        counts[label][step - 1] += n
    ratio = []
    for state in range(STATES):
        rows = [c[state * STATES : (state + 1) * STATES] for c in counts]
        sums = [sum(r) for r in rows]
        ratio += [math.log(rows[1][k] / sums[1]) - math.log(rows[0][k] / sums[0]) for k in range(STATES)]
    return ratio


def default_model(spark: SparkSession, docs: DataFrame, n_samples: int = 4000, n_docs: int = 2000) -> list[float]:
    """The model of the query: ``n_samples`` generated samples a kind, words of about ``n_docs`` documents."""
    words = word_samples(docs, n_docs, docs.count())
    return train(random_samples(spark, n_samples).unionByName(ordinary_samples(spark, n_samples)).unionByName(words))


def _transitions(sample: Column) -> Column:
    """1-based index into the flattened table for each pair of neighbouring characters."""
    chars = F.split(sample, "")
    state = lambda c: F.expr(f"instr('{ALPHABET}', {c})") if isinstance(c, str) else F.call_function("instr", F.lit(ALPHABET), c)
    return F.filter(
        F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.when(F.length(b) > 0, state(a) * STATES + state(b) + 1)),
        lambda x: x.isNotNull(),
    )


def _stretches(run: Column, model: list[float]) -> Column:
    """(start, end) within ``run`` of the stretches that pass, widened, in one fold over its pairs of characters.

    ``at`` is the pair's second character, ``group`` where its group begins; a stretch from ``begin`` (widened:
    ``low``) has the sum ``score``, was best with ``top`` at ``best``, and ``high`` follows the group of that end.
    """
    weights = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    none = F.array().cast("array<struct<start:int,end:int>>")
    steps = _transitions(run)
    sign = lambda state: (state == 0) | (state > GROUPED)
    zero, i0 = F.lit(0.0), F.lit(0)
    begin = F.struct(
        F.lit(1).alias("at"), F.when(sign(F.floor((F.element_at(steps, 1) - 1) / STATES)), 1).otherwise(0).alias("group"), i0.alias("begin"), i0.alias("low"), zero.alias("score"),
        zero.alias("top"), i0.alias("best"), i0.alias("high"), F.lit(False).alias("grows"), none.alias("out"),
    )

    def kept(a: Column) -> Column:
        passes = (a["top"] >= THRESHOLD) & (a["top"] >= PER_STEP * (a["best"] - a["begin"] - 1)) & (a["high"] - a["low"] >= STRETCH)
        return F.when(passes, F.concat(a["out"], F.array(F.struct(a["low"].alias("start"), a["high"].alias("end"))))).otherwise(a["out"])

    def scored(a: Column, k: Column) -> Column:
        ends = sign(F.pmod(k - 1, F.lit(STATES)))
        anew = a["score"] <= 0
        fresh = anew & (a["top"] < THRESHOLD)
        score = F.when(fresh, zero).otherwise(a["score"]) + F.element_at(weights, k)
        top = F.when(fresh, zero).otherwise(a["top"])
        # a stretch begins with the pair's first character, or behind a sign
        first = F.when(fresh, F.when(ends, a["at"] + 1).otherwise(F.greatest(a["at"] - 1, a["group"]))).otherwise(a["begin"])
        low = F.when(fresh, F.when(ends, a["at"] + 1).otherwise(a["group"])).otherwise(a["low"])
        rises = score > top
        grows = ~ends & (rises | (a["grows"] & ~fresh))
        return F.struct(
            (a["at"] + 1).alias("at"), F.when(ends, a["at"] + 1).otherwise(a["group"]).alias("group"), first.alias("begin"), low.alias("low"), score.alias("score"),
            F.greatest(score, top).alias("top"), F.when(rises, a["at"] + 1).otherwise(a["best"]).alias("best"),
            F.when(rises | grows, a["at"] + 1).otherwise(a["high"]).alias("high"), grows.alias("grows"), a["out"].alias("out"), ends.alias("ends"),
        )

    def step(acc: Column, k: Column) -> Column:
        # an array of one binds the scored state, so that it is worked out once
        def close(a: Column) -> Column:
            over = a["ends"] & ((a["score"] <= 0) | (a["score"] < a["top"] - DROP))
            reset = lambda c, v: F.when(over, v).otherwise(a[c]).alias(c)
            return F.struct(*[a[c].alias(c) for c in ("at", "group", "begin", "low")], reset("score", zero), reset("top", zero), *[a[c].alias(c) for c in ("best", "high", "grows")], F.when(over, kept(a)).otherwise(a["out"]).alias("out"))

        return F.element_at(F.transform(F.array(scored(acc, k)), close), 1)

    found = F.aggregate(steps, begin, step, kept)
    mixed = lambda s: (lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]"))(F.substring(run, s["start"] + 1, s["end"] - s["start"]))
    return F.when(run.rlike("[A-Za-z]") & run.rlike("[0-9]"), F.filter(found, mixed)).otherwise(none)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _located(text: Column, pattern: str, measure: Column, found) -> Column:
    """Spans that ``found`` makes of (start, end, value) for each match of ``pattern``; ``measure`` has the matches' values.

    The gaps between matches and the matches' lengths add up to positions.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.length(m))
    steps = F.zip_with(F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n"))), measure, lambda p, v: F.struct(p["g"].alias("g"), p["n"].alias("n"), v.alias("v")))
    empty = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.coalesce(x["n"], F.lit(0))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.coalesce(found(start, end, x["v"]), empty)).alias("out"))

    folded = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _runs(text: Column, pattern: str, kind: int) -> Column:
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.length(m))
    return _located(text, pattern, lengths, lambda start, end, n: F.when(n.isNotNull(), F.array(_span(start, kind, end))))


def _left_over(span: Column, base: Column) -> Column:
    """The parts of ``span`` that no base span covers."""

    def take(acc: Column, b: Column) -> Column:
        free = (b["start"] > acc["at"]) & (acc["at"] < span["end"])
        part = F.array(_span(acc["at"], 3, F.least(b["start"], span["end"])))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(free, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    def rest(acc: Column) -> Column:
        return F.when(acc["at"] < span["end"], F.concat(acc["out"], F.array(_span(acc["at"], 3, span["end"])))).otherwise(acc["out"])

    touching = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(touching, F.struct(span["start"].alias("at"), F.array().cast(SPANS).alias("out")), take, rest)


def scan(docs: DataFrame, model: list[float], text: str = "text", base: str = "base_spans", added: str = "added_spans") -> DataFrame:
    """``docs`` with two more columns: base spans and the spans that the model adds, each sorted."""
    whole = F.coalesce(F.col(text), F.lit(""))
    values = F.transform(F.regexp_extract_all(whole, F.lit(ASSIGN), 2), lambda m: F.length(m))
    none = F.array().cast(SPANS)
    signs = F.contains(whole, F.lit("=")) | F.contains(whole, F.lit(":"))
    long = lambda start, end, n: F.when(n >= ASSIGN_VALUE, F.array(_span(start, 0, end)))
    assign = F.when(signs, _located(whole, ASSIGN, values, long)).otherwise(none)
    access = F.when(F.contains(whole, F.lit("AKIA")), _runs(whole, ACCESS, 1)).otherwise(none)
    found = F.array_sort(F.concat(assign, access, _runs(whole, HEX, 2)))
    stretches = F.transform(F.regexp_extract_all(whole, F.lit(CANDIDATE), 0), lambda m: _stretches(m, model))
    placed = lambda start, end, v: F.transform(v, lambda s: _span(start + s["start"], 3, start + s["end"]))
    random = F.when(whole.rlike("[0-9]"), _located(whole, CANDIDATE, stretches, placed)).otherwise(none)
    out = docs.withColumn(base, found).withColumn(added, random)
    apart = F.flatten(F.transform(added, lambda s: _left_over(s, F.col(base))))
    return out.withColumn(added, F.when(F.size(added) > 0, apart).otherwise(F.col(added)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]", chars: str | None = None) -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; rows without spans stay as they are.

    Where a text changes, the column ``chars``, if named, gets its new number of characters.
    """
    base, added, spans, clean = spare(docs, "base_spans", "added_spans", "spans", "clean")
    got = scan(docs, model, text, base, added).withColumn(spans, F.array_sort(F.concat(base, added)))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = s["start"] + 1 - acc["at"]
        piece = F.array(F.concat(F.substring(F.col(text), acc["at"], gap), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), F.when(gap >= 0, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    last = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"], F.length(text)))
    found = F.size(spans) > 0
    out = got.withColumn(clean, F.when(found, F.aggregate(spans, start, add, last)).otherwise(F.col(text)))
    new = {text: F.col(clean)} | ({chars: F.when(found, F.length(clean).cast(docs.schema[chars].dataType)).otherwise(F.col(chars))} if chars else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = scan(docs.select("doc_id", "text"), default_model(spark, docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
        F.size("added_spans").cast("long").alias("n_random"),
    )
