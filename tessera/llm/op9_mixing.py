"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame expressions only.

Every document of a source wants the same fractional number of copies, its source's target over its
size. The whole part is certain, the fraction is the probability of one copy more. A pivotal step takes
two parties and moves words from one's probability to the other's, as many as both bounds, 0 and 1, allow,
one way or the other, with odds that keep either's expectation; so one of them becomes integral and the
source's words stay at its target. All steps are of this kind:

* A document that holds a HEAD-th of its source's words or more (there can be no more than HEAD of them) meets
  all smaller documents of the source together, the largest first. They all have one probability, so what
  they give or take is its change. The document is settled, or, where even all of them cannot settle it,
  they are and it stays open.
* The others meet each other in blocks of about FAN, in descending size, each block handing on the one
  document left open; FAN blocks' documents make a block of the next level, up to one for each source.
* What is open at the end becomes a copy with its probability. It is all that a source misses its
  target by: less than a HEAD-th of its words, but for sources of a few very large documents.

Random numbers are hashes of the documents, so reruns agree. A source of any size is spread over blocks.
Sources meet their rows by a broadcast behind a check of their number, else by salted keys. What grows in
one task is the list of sources, one row each, which is ranked and filled up to the level of the caps.

Null text or no words: size 0, taken 0. Null source: a source of its own, last. Null or repeated
doc_ids: rows are rounded one by one; fully repeated rows are numbered, and the number is part of their
order, their block and their draws. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, checkpoint, spare, table

WEIGHTS, CAP = (5, 2, 1), 3
HEAD, FAN, RUN = 1000, 64, 4096
#: Sources whose rows of numbers are broadcast; more are met by keys of SALTS parts each.
MOST_BROADCAST, SALTS = 100_000, 64
SEED = "pivotal"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, documents, target) from (source, size) rows.

    With sources in the order of cap over weight, the level of those not capped is what the capped leave,
    over the weights of the rest; the first source that the level does not overfill tells which it is.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("documents"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS)
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1)).withColumn("cap", CAP * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    fits = F.col("cap") / F.col("weight") >= F.col("level")
    chosen = F.coalesce(F.min(F.when(fits, F.struct("place", "level"))).over(everything)["level"], F.lit(0.0))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * chosen)
    return levels.select("source", "source_size", "documents", target.alias("target"))


#: The fields up to nth tell all rows of a source apart and are the order of every fold.
ITEM = "struct<size:bigint,rank:bigint,doc_id:bigint,tie:bigint,nth:bigint,copies:bigint,mass:double>"
ORDER = ("size", "rank", "doc_id", "tie", "nth")
DONE = "array<struct<doc_id:bigint,tie:bigint,size:bigint,copies:bigint>>"


def _name(item: str) -> str:
    """Arguments of a hash that tell rows apart; xxhash64 skips nulls, so only repeated rows add their number."""
    return f"{item}doc_id, {item}tie, nullif({item}nth, 0L)"


def _drawn(seed: str, *items: str) -> str:
    """A number in [0, 1) of its own for these rows."""
    return f"((xxhash64('{seed}', {', '.join(map(_name, items))}) & 9007199254740991) / 9007199254740992D)"


def _open(item: str, mass: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {item}.{f}" for f in (*ORDER, "copies")) + f", 'mass', {mass})"


def _settled(item: str, taken: str) -> str:
    return f"array(named_struct('doc_id', {item}.doc_id, 'tie', {item}.tie, 'size', {item}.size, 'copies', {item}.copies + {taken}))"


def _fold(seed: str) -> str:
    """SQL that folds ``items``, largest first, to (the item left open, settled rows), a pivotal step for each next one, b.

    The open item a takes x words of b or gives y; what reaches its bound is settled, the other stays open.
    """
    a, b = "acc.item", "b"
    full, spare_ = f"({a}.size - {a}.mass)", f"({b}.size - {b}.mass)"
    x, y = f"least({full}, {b}.mass)", f"least({a}.mass, {spare_})"
    out = lambda settled, taken, left, mass: f"named_struct('item', {_open(left, mass)}, 'done', concat(acc.done, {_settled(settled, taken)}))"
    takes = f"if({full} <= {b}.mass, {out(a, '1L', b, f'{b}.mass - {full}')}, {out(b, '0L', a, f'{a}.mass + {b}.mass')})"
    gives = f"if({a}.mass <= {spare_}, {out(a, '0L', b, f'{b}.mass + {a}.mass')}, {out(b, '1L', a, f'{a}.mass - {spare_}')})"
    step = f"if({_drawn(seed, 'acc.item.', 'b.')} * ({x} + {y}) < {y}, {takes}, {gives})"
    start = f"named_struct('item', items[0], 'done', cast(array() as {DONE}))"
    return f"aggregate(slice(items, 2, size(items)), {start}, (acc, b) -> {step})"


def _head_fold() -> str:
    """SQL that folds a source's largest documents, ``items``, with ``share`` the probability of all its documents.

    Gives p, the probability that is left to the smaller ones, the item left open, if any, and settled
    rows. ``rest`` counts the words not reached yet; once an item stays open, p is 0 or 1.
    """
    w, p, rest = "b.size", "acc.p", "(acc.rest - b.size)"
    x, y = f"least({w} * (1D - {p}), {p} * {rest})", f"least({w} * {p}, (1D - {p}) * {rest})"
    unit = lambda v: f"greatest(0D, least(1D, {v}))"
    out = lambda p, item, done: f"named_struct('p', {p}, 'rest', {rest}, 'item', {item}, 'done', {done})"
    done = lambda taken: f"concat(acc.done, {_settled('b', taken)})"
    takes = f"if({w} * (1D - {p}) <= {p} * {rest}, {out(unit(f'({p} * {rest} - {w} * (1D - {p})) / {rest}'), 'acc.item', done('1L'))}, {out('0D', _open('b', f'{w} * {p} + {p} * {rest}'), 'acc.done')})"
    gives = f"if({w} * {p} <= (1D - {p}) * {rest}, {out(unit(f'({p} * {rest} + {w} * {p}) / {rest}'), 'acc.item', done('0L'))}, {out('1D', _open('b', f'{w} * {p} - (1D - {p}) * {rest}'), 'acc.done')})"
    step = f"if({p} <= 0D or {p} >= 1D, {out(p, 'acc.item', done(f'cast({p} as bigint)'))}, if({rest} > 0 and {_drawn(SEED + '-head', 'b.')} * ({x} + {y}) < {y}, {takes}, {gives}))"
    start = f"named_struct('p', share, 'rest', source_size, 'item', cast(null as {ITEM}), 'done', cast(array() as {DONE}))"
    return f"aggregate(items, {start}, (acc, b) -> {step})"


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``nth``, from 0, among fully repeated rows, which are counted and dealt out again in runs of RUN."""
    counted = sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("rows"))
    runs = counted.withColumn("from", F.explode(F.expr(f"sequence(0L, rows - 1, {RUN}L)"))).repartition("doc_id", "tie", "from")
    return runs.select(*sizes.columns, F.explode(F.expr(f"sequence(from, least(from + {RUN}L, rows) - 1)")).alias("nth"))


def _with_source(rows: DataFrame, sources: DataFrame, many: int) -> DataFrame:
    """``rows`` with the columns of their source in ``sources``; no task gets all rows of a large source."""
    columns = [F.col(f"s.{c}") for c in sources.columns if c != "source"]
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    if many <= MOST_BROADCAST:
        return rows.alias("d").join(F.broadcast(sources.alias("s")), same).select("d.*", *columns)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "tie", "nth"), F.lit(SALTS)))
    spread = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.alias("d").join(spread.alias("s"), same & (F.col("d._salt") == F.col("s._salt"))).select(*[F.col(f"d.{c}") for c in rows.columns], *columns)


def mixed(docs: DataFrame, text: str = "text", seed: str = SEED) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, copies) of each row; ``tie`` is a hash of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64(whole).alias("tie"), F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"))
    sizes = checkpoint(_numbered(sizes))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = source_targets(sizes).withColumn("copies", F.floor(wanted)).withColumn("share", wanted - F.col("copies"))
    sources = checkpoint(sources)
    many, most = sources.agg(F.count(F.lit(1)), F.max("documents")).first()
    rows = _with_source(sizes, sources, many).withColumn("rank", F.expr(f"xxhash64('{seed}-order', {_name('')})"))
    keys = ("source", "source_size", "target")
    item = lambda mass: F.struct(*ORDER, "copies", mass.alias("mass")).cast(ITEM)
    settle = lambda df, taken: df.select(*keys, "doc_id", "tie", "size", (F.col("copies") + taken).alias("copies"))
    large = (F.col("share") > 0) & (F.col("size") > 0) & (F.col("size") * HEAD >= F.col("source_size"))
    heads = rows.where(large).groupBy(*keys, "share").agg(F.sort_array(F.collect_list(item(F.lit(0.0))), asc=False).alias("items"))
    heads = checkpoint(heads.select(*keys, F.expr(_head_fold().replace(SEED, seed)).alias("f")).select(*keys, "f.p", "f.item", "f.done"))
    settled = [heads.select(*keys, F.inline("done")), _rounded(heads.where("item is not null"), keys, seed)]
    shares = heads.select("source", "p")
    rest = _with_source(rows.where(~large), sources.select("source").join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "p"), many)
    rest = rest.withColumn("p", F.when(F.col("size") > 0, F.coalesce("p", "share")).otherwise(0.0))
    fraction = (F.col("p") > 0) & (F.col("p") < 1)
    settled.append(settle(rest.where(~fraction), F.col("p").cast("long")))
    place = F.pmod(F.expr(f"xxhash64('{seed}-block', {_name('')})"), F.ceil(F.col("documents") / F.lit(FAN)).cast("long"))
    level = rest.where(fraction).select(*keys, place.alias("block"), item(F.col("p") * F.col("size")).alias("item"))
    width = -(-(most or 0) // FAN)
    while width > 0:
        folded = _folded(level, (*keys, "block"), seed)
        settled.append(folded.select(*keys, F.inline("done")))
        level = folded.select(*keys, F.floor(F.col("block") / FAN).alias("block"), "item")
        width = 0 if width == 1 else -(-width // FAN)
    settled.append(_rounded(level, keys, seed))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def _folded(rows: DataFrame, keys: tuple[str, ...], seed: str) -> DataFrame:
    items = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    return checkpoint(items.select(*keys, F.expr(_fold(seed)).alias("f")).select(*keys, "f.item", "f.done"))


def _rounded(rows: DataFrame, keys: tuple[str, ...], seed: str) -> DataFrame:
    """What is open at the end becomes a copy with its probability."""
    last = F.expr(f"if({_drawn(seed + '-last', 'item.')} * item.size < item.mass, 1L, 0L)")
    return rows.select(*keys, "item.doc_id", "item.tie", "item.size", (F.col("item.copies") + last).alias("copies"))


def apply_mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it (not at all, or up to CAP times).

    Rows meet their numbers of copies on (doc_id, hash of the text, source). Rows that share all three also
    share their copies: they are counted by all their columns, in the order of which the copies are dealt,
    and written out again in runs of RUN, so that no task holds a large group of them.
    """
    tie, own, before, run = spare(docs, "tie", "own", "before", "run")
    share = mixed(docs, text).groupBy("doc_id", "tie", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    keyed = docs.withColumn(tie, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = (F.col(f"d.{tie}") == F.col("s.tie")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & F.col("d.source").eqNullSafe(F.col("s.source"))
    met = keyed.alias("d").join(share.alias("s"), same)
    names = [F.col(f"`{c}`") for c in docs.columns]
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    single = met.where("s.rows = 1").select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.copies"))).alias(own)).select(*names)
    counted = met.where("s.rows > 1").groupBy(*columns, F.col(f"d.{tie}"), F.col("s.copies").alias(own), F.col("s.rows").alias(run)).agg(F.count(F.lit(1)).alias(before))
    upto = F.sum(before).over(Window.partitionBy(tie, "doc_id", "source").orderBy(*names))
    part = lambda n: F.floor(F.col(own) * n / F.col(run))
    dealt = counted.withColumn(own, part(upto) - part(upto - F.col(before))).where(F.col(own) > 0)
    runs = dealt.withColumn(run, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own), F.lit(RUN).cast("long")))).repartition(tie, "doc_id", run)
    equal = runs.select(*names, F.explode(F.sequence(F.col(run), F.least(F.col(own), F.col(run) + RUN - 1)))).select(*names)
    return single.unionByName(equal)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
