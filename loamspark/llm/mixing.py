"""Mixing sources to target weights by a low-discrepancy slot schedule, DataFrame functions only.

Sources get word quotas from their weights (see :func:`targets`).  Each source's documents, in an order
shuffled by a seeded hash, are one stream of words cut into blocks of ``block`` words.  Slot s of the
schedule has the golden-ratio point frac(s * 0.618...); mapped through the cumulative quotas it names a
source, so every stretch of the schedule holds the sources in near-exact shares.  A source's slots are
ranked, and the slot of rank r takes its block r mod (number of blocks), again and again until the
quota is full; the last block may be taken in part.  Blocks join the documents that lie in them.

Of N golden-ratio points no two neighbours are 2/N apart, so twice as many slots as blocks are wanted fill
every quota; nearly all are full by half the schedule, and what a source gets beyond its quota is not used.

Running sums and ranks go over three levels of buckets, so a source of any size is spread over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, cut, cut_with, pick, release, sizes, whole

#: 2**31 * 0.618..., odd: multiples modulo 2**31 are a permutation that fills the circle evenly.
GOLDEN, CIRCLE_BITS, BUCKET_BITS = 1327217885, 31, 12


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running_sum(df: DataFrame, group: str, key: str, bits: int, value: str, rows: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """df and ``before``: the sum of ``value`` over the group's rows that come earlier by (key, ties).

    ``key``: long in [0, 2**bits), spread evenly.  Buckets of some 256 rows are summed first, then
    groups of buckets, about the square root of their number at each level.
    """
    fine = min(bits, max(0, math.ceil(math.log2(max(1, rows / 256)))))
    coarse = fine // 2
    df = df.withColumn("_f", F.shiftright(key, bits - fine) if bits > fine else F.col(key))
    earlier = lambda part, *order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0).cast("long"))
    sums = df.groupBy(group, "_f").agg(F.sum(value).alias("_s")).withColumn("_c", F.shiftright("_f", fine - coarse))
    tops = sums.groupBy(group, "_c").agg(F.sum("_s").alias("_s"))
    tops = tops.select(group, "_c", before("_s", earlier([group], "_c")).alias("_t"))
    mids = sums.join(tops, [group, "_c"]).select(group, "_f", (F.col("_t") + before("_s", earlier([group, "_c"], "_f"))).alias("_b"))
    within = df.withColumn("_w", before(value, earlier([group, "_f"], key, *ties)))
    return within.join(mids, [group, "_f"]).withColumn("before", F.col("_w") + F.col("_b")).drop("_f", "_w", "_b")


def earlier_sums(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """df and the sums over all rows that come earlier in the order: within ranges, which tasks hold one each,
    and over the ranges before."""
    ranges = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranges.groupBy("_range").agg(*[F.sum(x).alias(f"_{k}") for k, x in sums.items()])
    starts = totals.select("_range", *[before(f"_{k}", Window.orderBy("_range")).alias(f"_{k}") for k in sums])
    within = ranges.select("*", *[before(x, Window.partitionBy("_range").orderBy(*order)).alias(k) for k, x in sums.items()])
    return within.join(F.broadcast(starts), "_range").select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds sid (from 1, by name's code points, null last), weight and target to (src_null, src, source_size).

    Targets share ``share`` times all words by weight; none exceeds ``cap`` times its source, and what
    is over goes to the others by weight.  That end point is min(cap * size, level * weight) with one
    level for all, found by taking the sources in the order in which they fill up.
    """
    w = earlier_sums(sources, ["src_null", "src"], sid=F.lit(1).cast("long")).withColumn("sid", F.col("sid") + 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_full_at", F.col("_cap") / F.col("weight"))
    total = w.agg(F.sum("source_size"), F.sum("weight")).first()
    w = cut(earlier_sums(w, ["_full_at", "sid"], _filled=F.col("_cap"), _weight=F.col("weight")))
    level = (F.lit(share * (total[0] or 0)) - F.col("_filled")) / (F.lit(total[1] or 0) - F.col("_weight"))
    found = w.select(F.struct("_full_at", "sid", level.alias("level")).alias("x")).where("x.level <= x._full_at").agg(F.min("x")).first()[0]
    full = F.col("_cap") if found is None else F.least("_cap", F.lit(found["level"]) * F.col("weight"))
    return w.withColumn("target", full).drop("_cap", "_full_at", "_filled", "_weight")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = pick(docs, id=id_col, text=text_col, source=source_col)
    shuffled = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, 15), 16, 10).cast("long")
    return rows.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash"), F.col("source").isNull().alias("src_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), n_words(whole()).alias("size"), shuffled.alias("h"))


def schedule(sources: DataFrame, quotas: int) -> DataFrame:
    """(sid, slot, rank) of the slots that a source uses; sources has sid and quota (in slots), whose sum is ``quotas``."""
    spark, slots = sources.sparkSession, 2 * quotas
    whole_circle = F.lit(1 << CIRCLE_BITS)
    spans = earlier_sums(sources.select("sid", "quota"), ["sid"], start=F.col("quota")).where("quota > 0")
    share = lambda x: x.cast("double") * whole_circle / F.lit(quotas)
    spans = spans.select("sid", "quota", share(F.col("start")).alias("lo"), share(F.col("start") + F.col("quota")).alias("hi"))
    width = CIRCLE_BITS - BUCKET_BITS
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.shiftright(F.col("lo").cast("long"), width), F.shiftright(F.col("hi").cast("long"), width))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", whole_circle) * F.lit(GOLDEN), whole_circle).alias("u"))
    named = points.withColumn("bucket", F.shiftright("u", width)).join(spans, "bucket").where("lo <= u AND u < hi").select("sid", "slot", "quota", F.lit(1).cast("long").alias("one"))
    return running_sum(named, "sid", "slot", max(1, (slots - 1).bit_length()), "one", slots).where("before < quota").select("sid", "slot", F.col("before").alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 256, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", text_hash: bool = False) -> DataFrame:
    """One row per row: id, size, source_size, target, taken (words that the mix takes, repeats counted) and
    first_slot (of the schedule's slots that take some of them the first, null if none does).

    A source's taken words add up to its target, rounded.  Null and empty texts have no words; a null
    source is a source, the last.  Rows without words, and all of an empty source, take nothing.  Rows
    repeated under one id are documents of their own, a row each, and follow each other by size and text.
    A document of any length is cut at the blocks' ends.  Other columns are left out, whatever their
    names.  ``text_hash`` adds a column of that name, xxhash64 of the text.  Empty in, empty out.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, seed))
    sources, facts = cut_with(rows.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), **sizes("n"))
    sources = targets(sources, weights, share, cap).withColumn("words", F.least(F.round("target").cast("long"), F.lit(cap) * F.col("source_size")).cast("long"))
    some = F.greatest("source_size", F.lit(1).cast("long"))
    blocks = F.ceil(F.col("source_size") / block)
    sources = sources.withColumns({"blocks": blocks, "passes": F.floor(F.col("words") / some), "rest": F.col("words") % some})
    sources = cut(sources.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)))
    total = sources.agg(F.sum("n"), F.sum("quota")).first()
    n, quotas = total[0] or 0, total[1] or 0
    release(docs.sparkSession)

    # A source's blocks: how often each is taken whole, how much of it besides, and from which slot on.
    taken = schedule(sources, quotas).join(sources.select("sid", "blocks", "passes", "rest"), "sid")
    last = F.floor(F.col("rank") / F.col("blocks")) >= F.col("passes")
    at = F.col("rank") % F.col("blocks")
    by_block = (
        taken.select("sid", at.alias("at"), "slot", F.when(last, 0).otherwise(1).alias("whole"), F.when(last, F.least(F.lit(block).cast("long"), F.col("rest") - at * block)).otherwise(0).alias("part"))
        .groupBy("sid", "at")
        .agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"), F.min("slot").alias("slot"))
    )

    placed = attach(rows, sources.select("src_null", "src", "sid", "source_size", "target", "n"), ["src_null", "src"], "n", facts)
    placed = running_sum(placed.drop("src_null", "src", "n"), "sid", "h", 60, "size", n, ("id", "size", "text_hash", "row"))
    first, end = F.col("before"), F.col("before") + F.col("size")
    spread = F.when(F.col("size") > 0, F.sequence(F.floor(first / block), F.floor((end - 1) / block)))
    pieces = placed.withColumn("at", F.explode_outer(spread))
    start, stop = F.greatest(first, F.col("at") * block), F.least(end, (F.col("at") + 1) * block)
    pieces = pieces.withColumns({"start": start - F.col("at") * block, "length": stop - start})
    words = F.col("length") * F.col("whole") + F.greatest(F.lit(0), F.least(F.col("length"), F.col("part") - F.col("start")))
    pieces = pieces.join(by_block, ["sid", "at"], "left").withColumn("words", F.coalesce(words, F.lit(0)))
    per_row = pieces.groupBy("row", "id", "text_hash", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"))
    more = ["text_hash"] if text_hash else []
    return per_row.select(F.col("id").alias(id_col), "size", "source_size", F.round("target", 6).alias("target"), F.col("taken").cast("long").alias("taken"), "first_slot", *more)


#: Golden-ratio points, ranks and blocks as the operator has them, by window functions and one list of slots.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(sid - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM f
      WINDOW o AS (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, sid, source_size, least(cap, weight * (SELECT arg_min(level, (full_at, sid)) FROM l WHERE level <= full_at)) AS target FROM l),
q AS (SELECT *, least(round(target), 2 * source_size)::BIGINT AS words, ceil(source_size / 256)::BIGINT AS blocks FROM t),
r AS (SELECT *, words // greatest(source_size, 1) AS passes, words % greatest(source_size, 1) AS rest FROM q),
u AS (SELECT *, (passes * blocks + ceil(rest / 256))::BIGINT AS quota FROM r),
x AS (SELECT *, coalesce(sum(quota) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * {1 << CIRCLE_BITS} / (SELECT sum(quota) FROM u)::DOUBLE AS lo,
             sum(quota) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING)::DOUBLE * {1 << CIRCLE_BITS} / (SELECT sum(quota) FROM u)::DOUBLE AS hi FROM u),
g AS (SELECT slot, (slot % {1 << CIRCLE_BITS}) * {GOLDEN} % {1 << CIRCLE_BITS} AS u FROM (SELECT unnest(range((SELECT 2 * sum(quota) FROM u)::BIGINT)) AS slot)),
k AS (SELECT x.*, g.slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM g JOIN x ON x.lo <= g.u AND g.u < x.hi),
b AS (SELECT source, rank % blocks AS at, min(slot) AS slot, count(*) FILTER (rank // blocks < passes) AS whole,
             sum(CASE WHEN rank // blocks < passes THEN 0 ELSE least(256, rest - rank % blocks * 256) END)::BIGINT AS part FROM k WHERE rank < quota GROUP BY ALL),
p AS (SELECT row_number() OVER () AS row, d.doc_id, d.source, d.size, q.source_size, q.target,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5(d.doc_id::VARCHAR || '/0'), 1, 15), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, CASE WHEN size > 0 THEN unnest(range(a // 256, (a + size - 1) // 256 + 1)) END AS at FROM p WHERE size > 0 UNION ALL SELECT *, NULL FROM p WHERE size = 0),
o AS (SELECT e.*, slot, whole, part, greatest(a, e.at * 256) - e.at * 256 AS start, least(a + size, (e.at + 1) * 256) - greatest(a, e.at * 256) AS length
      FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.at = b.at),
z AS (SELECT *, coalesce(length * whole + greatest(0, least(length, part - start)), 0) AS n FROM o)
SELECT doc_id, size, source_size, round(target, 6) AS target, sum(n)::BIGINT AS taken, min(slot) FILTER (n > 0) AS first_slot FROM z GROUP BY row, doc_id, size, source_size, target
"""
