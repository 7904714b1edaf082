"""Conversation structure repair: cheapest edits along tight arcs of a bidirectional cost graph.

A conversation is a row of nodes (rows taken so far, state), the states being those of the pattern
``(s?(ua)+)?`` of role initials: nothing yet, after s, after u, after a. Keep, Rerole and Delete take a row,
Insert takes none. Forward costs (from the start) and backward costs (to an accepted end) are worked out for
every node; an arc is optimal if forward + own + backward cost is the total. The repair follows optimal
arcs from a frontier set of nodes and takes the least letter at each step. As a letter and a state fix the
next state, frontiers hold one node; a cost vector steps to few others, so steps are looked up.

Rows are dealt by ranges of (conversation, turn, role, text hash, row number), so a conversation of any size
is spread over tasks, and a task's rows lie in order. Conversations that lie within one range are repaired
in place, row after row, without an exchange. The others (at most two a range) are cut where ranges end:
each part gives its costs between states as a min-plus matrix, a scan over a conversation's parts gives the
costs on both sides of each, a second pass gives the state that a part leaves behind for each state it is
entered in, and a last one writes edits and texts. First rows of equal role and text are found by a
grouped minimum of positions. What is in one task for a whole conversation is one row a part, and the
hash of its repaired text: SHA-256 is a chain, so its task streams the pieces, one at a time.

Nulls: role, text and the parts of the damage key become one space; null conversations are one
conversation, null turns come first. Rows of equal turn (repeats, ties) are taken in order of role and a
hash of the text, so equal rows lie together. A text is handled whole; empty ones are blank. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_BYTES, bounded_batches, checkpoint, spare, table

WHITE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a; which follows by Insert or Rerole, and the roles those give.
START, STATES = 0, 4
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: state -> initial -> state by Keep
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FAR = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)
BEGIN = (0, FAR, FAR, FAR)
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after damage; a dropped row stays as ``gone``, so that its conversation is known."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").when(kind != 0, role).alias("role"), F.when(kind != 0, text).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


# --- costs -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def arcs(doomed: bool, initial: str, truncated: bool, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits that take a row of this kind, least letter first."""
    out = [("D", DELETE, state)]
    if not doomed:
        more = TRUNCATED * truncated
        if initial in KEEP[state]:
            out.append(("K", more, KEEP[state][initial]))
        out.append(("R", REROLE + more, NEXT[state]))
    return tuple(out)


def closed(costs: tuple) -> tuple:
    """Forward costs with inserts."""
    zero, one, two, three = costs
    two_ = min(two, zero + INSERT, one + INSERT, three + INSERT)
    return zero, one, two_, min(three, two_ + INSERT)


@lru_cache(maxsize=None)
def _ahead(kind: tuple, costs: tuple) -> tuple[tuple, int]:
    out = [FAR] * STATES
    for state, cost in enumerate(closed(costs)):
        for _, own, to in arcs(*kind, state):
            out[to] = min(out[to], cost + own)
    least = min(out)
    return tuple(min(x - least, FAR) if x < FAR else FAR for x in out), least


@lru_cache(maxsize=None)
def _back(kind: tuple, costs: tuple) -> tuple[tuple, int]:
    by = [min(own + costs[to] for _, own, to in arcs(*kind, state)) for state in range(STATES)]
    two, three = min(by[2], INSERT + by[3]), min(by[3], INSERT + by[2])
    out = (min(by[0], INSERT + two), min(by[1], INSERT + two), two, three)
    return tuple(x - min(out) for x in out), min(out)


def _lifted(costs: tuple, least: int) -> tuple:
    return tuple(x + least if x < FAR else FAR for x in costs)


def _lowered(costs: tuple) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(x - least if x < FAR else FAR for x in costs), least


def forward(kinds: list[tuple], begin: tuple) -> list[tuple]:
    """Costs of arriving in each state before each row and after the last, without inserts there."""
    costs, total = _lowered(begin)
    out = [begin]
    for kind in kinds:
        costs, more = _ahead(kind, costs)
        total += more
        out.append(_lifted(costs, total))
    return out


def backward(kinds: list[tuple], end: tuple) -> list[tuple]:
    """Costs of getting to the end from each state before each row, and ``end`` after the last."""
    costs, total = _lowered(end)
    out = [end]
    for kind in reversed(kinds):
        costs, more = _back(kind, costs)
        total += more
        out.append(_lifted(costs, total))
    return out[::-1]


def walk(kinds: list[tuple], begin: tuple, end: tuple, state: int, last: bool) -> tuple[list[str], int]:
    """Letters up to and with each row (and, if ``last``, those after all), and the state they lead to.

    Only optimal arcs are taken: the frontier's nodes are on an optimal path, and so is the end of an arc
    whose costs on both sides add up to the total.
    """
    ahead, back = forward(kinds, begin), backward(kinds, end)
    total = min(x + y for x, y in zip(closed(ahead[0]), back[0], strict=True))
    frontier, letters, row, out = {state}, "", 0, []
    while row < len(kinds) or last:
        here, found = closed(ahead[row]), {}
        for q in frontier:
            options = [("I", INSERT, NEXT[q], row)]
            if row < len(kinds):
                options += [(letter, own, to, row + 1) for letter, own, to in arcs(*kinds[row], q)]
            elif END[q] == 0:
                options.append(("", 0, q, row))
            for letter, own, to, at in options:
                if here[q] + own + back[at][to] == total:
                    found.setdefault(letter, set()).add(to)
        letter = min(found)
        if not letter:
            break
        letters, frontier = letters + letter, found[letter]
        if letter != "I":
            out.append(letters)
            letters, row = "", row + 1
    return [*out, letters] if last else out, min(frontier)


def repaired(letters: str, state: int, role: str | None, text: str | None) -> tuple[list[str], int]:
    """The lines that a row's letters give, and the state after them."""
    lines = []
    for letter in letters:
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = KEEP[state][role[:1]]
        elif letter != "D":
            state = NEXT[state]
            lines.append(f"{ROLES[state]}:{text if letter == 'R' else ''}")
    return lines, state


# --- conversations within one range ----------------------------------------------------------------------


def faults(roles: list[str], texts: list[str]) -> list[str]:
    """Each row's first fault, or ''."""
    seen: set[tuple[str, str]] = set()
    out = []
    for key in zip(roles, texts, strict=True):
        shown = key[1].rstrip(WHITE)
        out.append("blank" if not shown else "duplicate" if key in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add(key)
    return out


def kinds_of(roles: list[str], found: list[str]) -> list[tuple]:
    """(must go, initial, truncated) of each row; initials of no state are all alike."""
    return [(f in ("blank", "duplicate"), r[:1] if r[:1] in ("s", "u", "a") else "", f == "truncated") for r, f in zip(roles, found, strict=True)]


def gaps_of(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def repair(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The values of RESULT after conv_id, of one whole conversation in order."""
    found = faults(roles, texts)
    kinds = kinds_of(roles, found)
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    letters, _ = walk(kinds, BEGIN, END, START, True)
    lines, state = [], START
    for edit, role, text in zip(letters, [*roles, None], [*texts, None], strict=True):
        more, state = repaired(edit, state, role, text)
        lines += more
    cost = backward(kinds, END)[0][START]
    counts = [gaps_of(turns), *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost]
    return (*counts, "".join(letters), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys, also across batches, as lists of their columns."""
    name, held = None, None
    for batch in batches:
        columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        at = 0
        for key, rows in groupby(zip(*(columns[k] for k in keys), strict=True)):
            n = sum(1 for _ in rows)
            part = {c: v[at : at + n] for c, v in columns.items()}
            at += n
            if held is not None and key == name:
                for c, v in part.items():
                    held[c] += v
                continue
            if held is not None:
                yield name, held
            name, held = key, part
    if held is not None:
        yield name, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


LONG, TEXT, VECTOR = pa.int64(), pa.string(), pa.list_(pa.int64())
RESULT_ARROW = _schema(conv_id=LONG, **dict.fromkeys(COUNTS, LONG), audit=TEXT, repaired_sha256=TEXT)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (conv,), c in runs(batches, "conv_id"):
            here = [k for k, gone in enumerate(c["gone"]) if not gone]
            yield conv, *repair(*([c[n][k] for k in here] for n in ("turn", "role", "text")))

    yield from _batches(rows(), RESULT_ARROW)


# --- conversations across ranges -------------------------------------------------------------------------

PART_ARROW = _schema(conv_id=LONG, part=LONG, matrix=VECTOR, turns=VECTOR, ends=TEXT, counts=VECTOR)
PART = "conv_id long, part long, matrix array<long>, turns array<long>, ends string, counts array<long>"


def _fault(first: bool, text: str) -> str:
    shown = text.rstrip(WHITE)
    return "blank" if not shown else "duplicate" if not first else "" if shown[-1] in ".!?" else "truncated"


def _kinds(c: dict[str, list]) -> list[tuple]:
    return kinds_of(c["role"], c["fault"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: costs between states, (least, largest, number of) known turns, initials at its ends, counts."""

    def rows() -> Iterator[tuple]:
        for (conv, part), c in runs(batches, "conv_id", "part"):
            kinds = _kinds(c)
            matrix = []
            for q in range(STATES):
                matrix += forward(kinds, tuple(0 if q == p else FAR for p in range(STATES)))[-1]
            known = [t for t in c["turn"] if t is not None]
            initials = [r[:1] or " " for r in c["role"]]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            counts = [*(c["fault"].count(f) for f in ("blank", "duplicate", "truncated")), illegal]
            yield conv, part, matrix, [known[0], known[-1], len(set(known))] if known else [], initials[0] + initials[-1], counts

    yield from _batches(rows(), PART_ARROW)


SIDES_ARROW = _schema(conv_id=LONG, part=LONG, begin=VECTOR, end=VECTOR, last=pa.bool_(), counts=VECTOR)
SIDES = "conv_id long, part long, begin array<long>, end array<long>, last boolean, counts array<long>"


def _sides(parts: pa.Table) -> pa.Table:
    """Costs before and after each part of one conversation; with the first part come the counts of all."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
    n = range(STATES)
    begins, ends = [BEGIN], [END]
    for r in rows:
        m, f = r["matrix"], begins[-1]
        begins.append(tuple(min(min(f[p] + m[p * STATES + q] for p in n), FAR) for q in n))
    for r in reversed(rows):
        m, e = r["matrix"], ends[-1]
        ends.append(tuple(min(min(m[p * STATES + q] + e[q] for q in n), FAR) for p in n))
    ends.reverse()
    totals = [sum(x) for x in zip(*(r["counts"] for r in rows), strict=True)]
    totals[3] += sum(a["ends"][1] + b["ends"][0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    known = [r["turns"] for r in rows if r["turns"]]
    distinct = sum(t[2] for t in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1][1] - known[0][0] + 1 - distinct if known else 0
    out = [(r["conv_id"], r["part"], begins[k], ends[k + 1], k == len(rows) - 1, [gaps, *totals, ends[0][START]] if k == 0 else None) for k, r in enumerate(rows)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SIDES_ARROW, strict=True)], schema=SIDES_ARROW)


EXITS_ARROW = _schema(conv_id=LONG, part=LONG, exits=VECTOR)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each part is left in, for each state in which an optimal path may enter it (else -1)."""

    def rows() -> Iterator[tuple]:
        for (conv, part), c in runs(batches, "conv_id", "part"):
            kinds, begin, end = _kinds(c), tuple(c["begin"][0]), tuple(c["end"][0])
            here, back = closed(begin), backward(kinds, end)[0]
            total = min(x + y for x, y in zip(here, back, strict=True))
            # a part is entered in a state that a row led to, or in the first
            yield conv, part, [walk(kinds, begin, end, q, False)[1] if begin[q] + back[q] == total else -1 for q in range(STATES)]

    yield from _batches(rows(), EXITS_ARROW)


ENTRY_ARROW = _schema(conv_id=LONG, part=LONG, state=LONG)


def _entries(parts: pa.Table) -> pa.Table:
    state, out = START, []
    for r in sorted(parts.to_pylist(), key=lambda r: r["part"]):
        out.append((r["conv_id"], r["part"], state))
        state = r["exits"][state]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ENTRY_ARROW, strict=True)], schema=ENTRY_ARROW)


PIECE_ARROW = _schema(conv_id=LONG, part=LONG, piece=LONG, audit=TEXT, n_lines=LONG, lines=TEXT)
PIECE = "conv_id long, part long, piece long, audit string, n_lines long, lines string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and repaired lines of each part, in pieces of about SLICE_BYTES."""

    def rows() -> Iterator[tuple]:
        for (conv, part), c in runs(batches, "conv_id", "part"):
            state, last = c["state"][0], c["last"][0]
            letters, _ = walk(_kinds(c), tuple(c["begin"][0]), tuple(c["end"][0]), state, last)
            audit, lines, size, piece = [], [], 0, 0
            for edit, role, text in zip(letters, c["role"] + [None] * last, c["text"] + [None] * last, strict=True):
                more, state = repaired(edit, state, role, text)
                audit.append(edit)
                lines += more
                size += sum(map(len, more))
                if size > SLICE_BYTES:
                    yield conv, part, piece, "".join(audit), len(lines), "\n".join(lines)
                    audit, lines, size, piece = [], [], 0, piece + 1
            yield conv, part, piece, "".join(audit), len(lines), "\n".join(lines)

    yield from _batches(rows(), PIECE_ARROW, 1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, sha256) of pieces in order; one piece is held at a time, and the letters, which are the result."""

    def rows() -> Iterator[tuple]:
        name, digest, audit, some = None, None, [], False
        for batch in batches:
            for r in batch.to_pylist():
                if digest is None or r["conv_id"] != name:
                    if digest is not None:
                        yield name, "".join(audit), digest.hexdigest()
                    name, digest, audit, some = r["conv_id"], hashlib.sha256(), [], False
                audit.append(r["audit"])
                if r["n_lines"]:
                    digest.update(("\n" * some + r["lines"]).encode())
                    some = True
        if digest is not None:
            yield name, "".join(audit), digest.hexdigest()

    yield from _batches(rows(), _schema(conv_id=LONG, audit=TEXT, repaired_sha256=TEXT))


def _across(rows: DataFrame) -> DataFrame:
    """RESULT of conversations that lie in several ranges; ``rows`` has no ``gone`` ones and a position ``at``."""
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("hash")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(shown == "", "blank").when(F.col("first").isNull(), "duplicate").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    flagged = rows.join(firsts, "at", "left").withColumn("fault", fault).drop("first")
    flagged = checkpoint(flagged.repartition("part").sortWithinPartitions("part", "at"))
    slim = flagged.select("conv_id", "part", "turn", "role", "fault")
    same = ["conv_id", "part"]

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """``left`` in its order with the row of each part; there are at most two parts a range."""
        r = right.select(*[F.col(c).alias("_" + c if c in same else c) for c in right.columns])
        met = left.join(F.broadcast(r), left["conv_id"].eqNullSafe(r["_conv_id"]) & (left["part"] == r["_part"]))
        return met.drop("_conv_id", "_part")

    summaries = slim.mapInArrow(_summaries, PART)
    sides = checkpoint(summaries.groupBy("conv_id").applyInArrow(_sides, SIDES))
    exits = beside(slim, sides.drop("counts")).mapInArrow(_exits, "conv_id long, part long, exits array<long>")
    entries = exits.groupBy("conv_id").applyInArrow(_entries, "conv_id long, part long, state long")
    told = checkpoint(entries.join(sides.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "begin", "end", "last"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p"))
    pieces = beside(flagged.select("conv_id", "part", "role", "text", "fault"), told).mapInArrow(_pieces, PIECE)
    hashed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    counts = sides.where("counts is not null").select(F.col("conv_id").alias("c"), *[F.col("counts")[k].alias(n) for k, n in enumerate(COUNTS)])
    return hashed.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def mended(rows: DataFrame) -> DataFrame:
    """RESULT for each conv_id of (conv_id long, turn long, role, text, gone); rows that are ``gone`` only name their conversation."""
    bounded_batches(rows.sparkSession)
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    (nth,) = spare(rows, "nth")
    dealt = rows.withColumn(nth, F.monotonically_increasing_id()).repartitionByRange(*order, nth).sortWithinPartitions(*order, "text", nth).drop(nth)
    # the place within a partition is the low 33 bits of an increasing id
    dealt = checkpoint(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    borders = dealt.groupBy("part").agg(*[F.min(F.struct(F.col("at") * sign, "conv_id")).alias(n) for n, sign in (("low", 1), ("high", -1))])
    ends = borders.select("part", F.explode(F.array_distinct(F.array("low.conv_id", "high.conv_id"))).alias("conv_id"))
    # a row a range at most; null conversations come first
    split = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    split = checkpoint(split)
    some = split.count()
    same = dealt["conv_id"].eqNullSafe(split["c"])
    inner = dealt.join(F.broadcast(split), same, "left_anti") if some else dealt
    whole = inner.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_whole, RESULT)
    if not some:
        return whole
    shared = dealt.join(F.broadcast(split), same, "left_semi")
    across = _across(shared.where("not gone").drop("gone"))
    # conversations of which nothing but gone rows lies in several ranges
    bare = shared.groupBy("conv_id").agg(F.min("gone").alias("bare")).where("bare")
    nothing = bare.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    return whole.unionByName(across).unionByName(nothing)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mended(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """Row after row, the least (cost, audit) of each state with its repaired text, by a recursive query; CRC-32 bit by bit."""
    shown = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    bits = f"flatten(list_transform(string_split({shown}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    out = f"WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations)"
    out += ", d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0)"
    out += f", n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS r, rtrim(text, {white}) AS shown FROM d)"
    out += ", f AS MATERIALIZED (SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n)"
    out += ", s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, " + ", ".join(f"count(*) FILTER (fault = '{x}') AS \"{x}\"" for x in ("blank", "duplicate", "truncated"))
    out += ", count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1)"

    def plus(node: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"{node}[3]" if line is None else f"{node}[3] || {line} || chr(10)"
        return f"CASE WHEN {node} IS NOT NULL THEN [lpad(CAST(CAST({node}[1] AS BIGINT) + {cost} AS VARCHAR), 12, '0'), {node}[2] || '{letter}', {lines}] END"

    def least(*nodes: str) -> str:
        return f"list_min(list_filter([{', '.join(nodes)}], lambda v: v IS NOT NULL))"

    user, assistant = (lambda node: plus(node, "3", "I", "'user:'")), (lambda node: plus(node, "3", "I", "'assistant:'"))
    out += ", w(conv_id, i, s0, s1, s2, s3) AS (SELECT conv_id, 0, [lpad('0', 12, '0'), '', ''], CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]) FROM s UNION ALL SELECT conv_id, i, "
    extra = "(3 * CAST(fault = 'truncated' AS INTEGER))"
    free = "fault NOT IN ('blank', 'duplicate')"
    kept = lambda node, initial: f"CASE WHEN {free} AND r = '{initial}' THEN {plus(node, extra, 'K', 'role || chr(58) || text')} END"
    new = lambda node, role: f"CASE WHEN {free} THEN {plus(node, '3 + ' + extra, 'R', chr(39) + role + ':' + chr(39) + ' || text')} END"
    gone = lambda node: plus(node, "4", "D", None)
    out += gone("s0") + ", " + least(gone("s1"), kept("s0", "s")) + ", "
    out += least(gone("t2"), *[kept(x, "u") for x in ("s0", "s1", "t3")], *[new(x, "user") for x in ("s0", "s1", "t3")]) + ", " + least(gone("t3"), kept("t2", "a"), new("t2", "assistant"))
    inner = f"SELECT w.conv_id, f.i, role, text, r, fault, s0, s1, s3, {least('s2', user('s0'), user('s1'), user('s3'))} AS t2 FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1"
    out += f" FROM (SELECT *, {least('s3', assistant('t2'))} AS t3 FROM ({inner})))"
    end = f"SELECT w.conv_id, {least('s0', 's3', assistant('t2'))} AS e, gaps, blank, duplicate, truncated, illegal FROM (SELECT *, {least('s2', user('s1'))} AS t2 FROM w) w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.n"
    out += f", e AS ({end})"
    return out + (
        " SELECT a.conv_id, " + ", ".join(f"coalesce({c}, 0) AS \"{c}\"" for c in COUNTS[:-1])
        + ", coalesce(CAST(e.e[1] AS BIGINT), 0) AS cost, coalesce(e.e[2], '') AS audit, sha256(coalesce(e.e[3][:-2], '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id"
    )


ORACLE_SQL = _oracle()
