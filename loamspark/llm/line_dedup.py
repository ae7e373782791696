"""Line dedup by a segment-partition edit join, DataFrame functions only.

A line of ``min_chars`` characters or more goes if the same line, or one within ``max_edits`` edits of it,
begins earlier: in a document with a smaller id, or higher up in the same one.  Shorter lines stay, or
with ``short_copies`` go if the same line begins earlier and they are not blank.

1. Lines are grouped by a 128-bit digest; a line's first place and its hashes come along.
2. Each line is cut into max_edits + 1 segments of near-equal length; lines within the threshold have a
   segment of the shorter in common, at a place that the lengths bound.  Index rows carry a segment's
   hash with its number and the line's length, probe rows the hashes of the longer line's substrings at
   the few places that can match (left and right of the segment, no more edits than there are).
   Hashes are counted first: only rows whose hash a bitmap can't clear of being alone are shuffled to meet.
   Lists of one hash that would make many pairs are cut finer: lines there must share another half of
   a segment as well.
3. Pairs that meet are compared by their texts: pieces that must be there, a sieve of character classes,
   then a bit-parallel automaton over the band of 2 * max_edits + 1 diagonals, one mask for each number
   of edits.
4. Documents lose the lines found; only texts that a bitmap can't clear of such lines are shuffled, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, attach, bit_filter, bit_split, cut, cut_with, pick, release, sizes, whole

#: Classes of characters for the sieve; one edit changes the number of characters in a class by one at most.
CLASSES = ("aeiou", "lnrst", "bcdfghjkmpqvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " .,;:!?-")


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line; the last segments are the longer ones."""
    base, more = F.floor(length / parts), length % parts
    extra = i - (parts - more)
    return (i * base + F.greatest(F.lit(0), extra)).cast("int"), (base + F.when(extra >= 0, 1).otherwise(0)).cast("int")


def index_hashes(line: Column, n: Column, max_edits: int) -> list[Column]:
    """``n``: the line's length, a column of its own, as it is used many times."""
    out = []
    for i in range(max_edits + 1):
        start, size = segment(n, i, max_edits + 1)
        out.append(F.xxhash64(F.lit(i), n, F.substring(line, start + 1, size)))
    return out


def probe_places(max_edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment, shift) of each probe; places that leave a segment's text
    earlier edits than its number, or later ones than are left, can't match (some other segment would)."""
    k = max_edits
    return [(d, i, shift) for d in range(k + 1) for i in range(k + 1) for shift in range(max(-i, d - (k - i)), min(i, d + k - i) + 1)]


def part_at(line: Column, n: Column, start: Column, size: Column, inside: bool) -> Column:
    part = F.substring(line, start + 1, size)
    return part if inside else F.when((start >= 0) & (start + size <= n), part)


def probe_hashes(line: Column, n: Column, max_edits: int) -> list[Column]:
    """Null where the place isn't in the line."""
    out = []
    for shorter, i, shift in probe_places(max_edits):
        start, size = segment(n - shorter, i, max_edits + 1)
        found = F.xxhash64(F.lit(i), n - shorter, F.substring(line, start + shift + 1, size))
        inside = (start + shift >= 0) & (start + shift + size <= n)
        out.append(found if 0 <= shift <= shorter else F.when(inside, found))
    return out


def halves(length: Column, max_edits: int) -> list[tuple[Column, Column]]:
    """Start and length of each segment's two halves."""
    out = []
    for i in range(max_edits + 1):
        start, size = segment(length, i, max_edits + 1)
        half = F.floor(size / 2).cast("int")
        out += [(start, half), (start + half, size - half)]
    return out


def finer(index: DataFrame, probe: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Pairs of lists that would make many: of the segments' halves outside the shared segment, one more is
    untouched by the edits, so lines meet on it too.  index: lid, h, i; probe: lid, h, i, shorter; texts: lid, line."""
    n, line, k = F.char_length("line"), F.col("line"), max_edits
    hashed = lambda g, part: F.struct(F.lit(g).alias("g"), F.when(part.isNotNull(), F.xxhash64("h", F.lit(g), part)).alias("r"))
    own = [hashed(g, F.substring(line, start + 1, size)) for g, (start, size) in enumerate(halves(n, k))]
    other = [hashed(g, part_at(line, n, start + shift, size, False)) for g, (start, size) in enumerate(halves(n - F.col("shorter"), k)) for shift in range(-k, k + 1)]
    meet = lambda rows, parts, name: rows.join(texts, "lid").select(F.col("lid").alias(name), "i", F.explode(F.array(*parts)).alias("p")).where((F.floor(F.col("p.g") / 2) != F.col("i")) & F.col("p.r").isNotNull()).select(name, F.col("p.r").alias("r"))
    return meet(index, own, "lid").join(meet(probe, other, "other"), "r").select("lid", "other")


def within(a: Column, b: Column, max_edits: int) -> Column:
    """Whether the edit distance, in characters, is max_edits at most.

    Bit d + max_edits of mask e says that with e edits the first i characters of a can become the first
    i + d of b.  b's characters travel in the fold's state, so that they are split once.
    """
    k = max_edits
    n, m = F.char_length(a), F.char_length(b)
    band = (1 << 2 * k + 1) - 1

    def step(state: Column, c: Column) -> Column:
        y, i = state["y"], state["i"]
        same = reduce(lambda p, q: p.bitwiseOR(q), [F.when(F.get(y, i + d) == c, 1 << d + k).otherwise(0) for d in range(-k, k + 1)])
        new: list[Column] = []
        for e in range(k + 1):
            now = state[f"m{e}"].bitwiseAND(same)
            if e:
                less = state[f"m{e - 1}"]
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
            new.append(now)
        return F.struct(y.alias("y"), (i + 1).alias("i"), *[v.alias(f"m{e}") for e, v in enumerate(new)])

    first = F.struct(F.split(b, "").alias("y"), F.lit(0).alias("i"), *[F.lit(sum(1 << k + d for d in range(e + 1))).alias(f"m{e}") for e in range(k + 1)])
    end = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), first, step, lambda state: state[f"m{k}"])
    return (F.abs(n - m) <= k) & F.call_function("shiftright", end, m - n + k).bitwiseAND(F.lit(1)).cast("boolean")


def bind(value: Column, f) -> Column:
    """f(value), value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def trimmed(a: Column, b: Column, parts: int = 8) -> Column:
    """A struct (x, y): both without a common start and end, found by eighths; that changes no edit distance."""
    share = lambda whole, i: F.floor(whole * i / parts).cast("int")
    longest = lambda whole, same: F.greatest(F.lit(0), *[F.when(same(share(whole, i)), share(whole, i)) for i in range(1, parts + 1)])
    start = lambda s, size: F.substring(s, F.lit(1), size)

    def cut_ends(t: Column) -> Column:
        n, m = t["n"], t["m"]
        p = longest(n, lambda size: start(a, size) == start(b, size))
        q = lambda p: longest(F.least(n, m) - p, lambda size: F.right(a, size) == F.right(b, size))
        return bind(p, lambda p: bind(q(p), lambda q: F.struct(F.substring(a, p + 1, n - p - q).alias("x"), F.substring(b, p + 1, m - p - q).alias("y"))))

    return bind(F.struct(F.char_length(a).alias("n"), F.char_length(b).alias("m")), cut_ends)


def pieces_match(a: Column, b: Column, max_edits: int, parts: int = 8) -> Column:
    """Whether all but max_edits of a's pieces stand in b, at most max_edits off; edits can't spoil more."""
    n, found = F.char_length(a), []
    for i in range(parts):
        start, size = segment(n, i, parts)
        piece = F.substring(a, start + 1, size)
        found.append(reduce(lambda p, q: p | q, [(start + d >= 0) & (F.substring(b, F.greatest(start + d, F.lit(0)) + 1, size) == piece) for d in sorted(range(-max_edits, max_edits + 1), key=abs)]).cast("int"))
    return reduce(lambda p, q: p + q, found) >= parts - max_edits


def sieve(a: Column, b: Column, max_edits: int) -> Column:
    without = lambda s, chars: F.char_length(F.translate(s, chars, ""))
    return reduce(lambda p, q: p & q, [F.abs((F.char_length(a) - without(a, c)) - (F.char_length(b) - without(b, c))) <= max_edits for c in CLASSES])


def line_dedup(docs: DataFrame, max_edits: int = 1, min_chars: int = 24, carry: tuple[str, ...] = (), long_list: int = 256, id_col: str = "doc_id", text_col: str = "text", short_copies: bool = False) -> DataFrame:
    """One row per row: id, text without the lines that go, n_lines, n_dropped, then the ``carry`` columns.

    Lines are what ``\\n`` separates, compared as they are.  Null texts stay null and have no lines; an
    empty text has one, empty.  Where all lines go the text is empty.  Of ids null is the smallest.
    Rows repeated with id and text are one document: all of them keep its lines.  Texts under one id
    follow each other by a hash.  Chains drop from their second line on: what a line is near to need
    not be kept itself.  Lines and texts of any length are compared whole.  Columns not in ``carry`` are
    left out, whatever their names.  ``long_list``: pairs that a hash may make before its list is cut finer; it
    changes no result.  ``short_copies``: the floor of ``min_chars`` holds for the edit join only, and exact
    copies of any line go but for blank ones (ASCII white space or nothing).  Empty in, empty out.
    """
    k = max_edits
    rows = pick(docs, id=id_col, text=text_col, **{f"c{i}": c for i, c in enumerate(carry)})
    rows = rows.withColumn("rid", F.xxhash64("id", "text"))
    lines = rows.select("id", "rid", F.posexplode(F.split(whole(), "\n")).alias("at", "line")).withColumn("size", F.char_length("line"))
    joined = F.col("size") >= max(min_chars, k + 1)
    lines = lines.where(joined | F.col("line").rlike(WORD)) if short_copies else lines.where(joined)
    digest, number = F.unhex(F.md5("line")), F.xxhash64("line")
    place = F.struct("id", "rid", "at")
    # A probe for lines of the same length, at the segment's own place, is the line's own index hash.
    places, own = probe_places(k), lambda d, i, shift: d == 0 and shift == 0
    others = [p for p, place_at in enumerate(places) if not own(*place_at)]
    hashes = {f"h{i}": h for i, h in enumerate(index_hashes(F.col("line"), F.col("size"), k))} | {f"p{p}": h for p, h in enumerate(probe_hashes(F.col("line"), F.col("size"), k)) if p in others}
    if short_copies:
        hashes = {x: F.when(joined, h) for x, h in hashes.items()}
    # A line's hashes follow from it: as keys they need no state of their own.
    different = lines.select(digest.alias("key"), number.alias("lid"), place.alias("place"), *[h.alias(x) for x, h in hashes.items()]).groupBy("key", "lid", *hashes).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    different = different.select("key", "lid", "first", "n", F.array(*[f"h{i}" for i in range(k + 1)]).alias("index"), F.array(*[f"p{p}" for p in others]).cast("array<bigint>").alias("other"))
    different = cut(different)
    release(docs.sparkSession)
    counted = {"rows": F.count(F.lit(1))}

    def texts_of(lids: DataFrame) -> DataFrame:
        lids, facts = cut_with(lids.distinct(), **counted)
        some = bit_filter(lines.where(joined).select("line", number.alias("lid")), F.col("lid"), lids.select(F.col("lid").alias("k")), facts["rows"])
        return some.join(lids, "lid", "left_semi").distinct()

    # A hash brings pairs if it is in the index and is probed by more than the line that it stands for.
    met = different.select(F.posexplode(F.concat("index", "other")).alias("at", "h")).where("h IS NOT NULL").groupBy("h").agg(F.count_if(F.col("at") <= k).alias("a"), F.count(F.lit(1)).alias("b"))
    met, facts = cut_with(met.where("a > 0 AND b > 1").select("h", "b", ((F.col("a") * F.col("b") > long_list) & F.lit(k > 0)).alias("long")), **counted, **sizes("b"), long=F.count_if(F.col("long")))
    release(docs.sparkSession)
    meeting = lambda rows: cut(bit_filter(rows.where("h IS NOT NULL"), F.col("h"), met.select(F.col("h").alias("k")), facts["rows"]))
    place_of = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("shorter")) for d, i, _ in places])
    probes = F.array(*[F.get("index", F.lit(i)) if own(d, i, shift) else F.get("other", F.lit(others.index(p))) for p, (d, i, shift) in enumerate(places)])
    index = meeting(different.select("lid", F.posexplode("index").alias("i", "h")))
    probe = meeting(different.select("lid", F.posexplode(probes).alias("p", "h")).select("lid", "h", F.get(place_of, F.col("p")).alias("p")).select("lid", "h", "p.i", "p.shorter"))
    index, probe = (attach(x, met, ["h"], "b", facts, "inner").drop("b") for x in (index, probe))
    pairs = index.where("NOT long").select("lid", "h").join(probe.where("NOT long").select("h", F.col("lid").alias("other")), "h").select("lid", "other")
    if facts["long"]:
        index_long, probe_long = (cut(x.where("long").drop("long")) for x in (index, probe))
        pairs = pairs.unionByName(finer(index_long, probe_long, cut(texts_of(index_long.select("lid").unionByName(probe_long.select("lid")))), k))
    release(docs.sparkSession)
    pairs = cut(pairs.where("lid != other").select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b")).distinct())
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("lid"))).withColumn("key", F.unhex(F.md5("line")))
    texts, facts = cut_with(texts, **counted)
    hashed = lambda rows: rows.select(F.xxhash64("key").alias("k"))
    texts = cut(texts.join(bit_filter(different.select("key", "first"), F.xxhash64("key"), hashed(texts), facts["rows"]), "key"))
    release(docs.sparkSession)
    of = lambda side: texts.select(F.col("lid").alias(side), F.col("line").alias(f"line_{side}"), F.col("key").alias(f"key_{side}"), F.col("first").alias(f"first_{side}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b")
    # Nested, so that each test is made only after the cheaper ones.
    x, y = F.col("line_a"), F.col("line_b")
    close = F.when(pieces_match(x, y, k), F.when(sieve(x, y, k), bind(trimmed(x, y), lambda t: within(t["x"], t["y"], k))))
    near = near.select("key_a", "key_b", "first_a", "first_b", close.alias("close")).where("close")
    late = near.select(F.when(F.col("first_a") < F.col("first_b"), F.col("key_b")).otherwise(F.col("key_a")).alias("key")).distinct()
    late, facts = cut_with(late.withColumn("late", F.lit(True)), **counted)

    first_only, perhaps = bit_split(different.select("key", "first", "n"), F.xxhash64("key"), hashed(late), facts["rows"])
    hit = first_only.where("n > 1").withColumn("late", F.lit(None).cast("boolean")).unionByName(perhaps.join(late, "key", "left").where("n > 1 OR late"))
    hit, facts = cut_with(hit, **sizes("n"), **counted)
    placed = lines.select(digest.alias("key"), place.alias("place"))
    placed = cut(bit_filter(placed, F.xxhash64("key"), hit.select(F.xxhash64("key").alias("k")), facts["rows"]))
    release(docs.sparkSession)
    gone = attach(placed, hit, ["key"], "n", facts, "inner").where("late OR place != first")
    gone = gone.select(F.col("place.rid").alias("rid"), F.col("place.id").alias("_id"), F.col("place.at").alias("at")).groupBy("rid", "_id").agg(F.collect_set("at").alias("gone"))
    gone, facts = cut_with(gone, **counted)
    release(docs.sparkSession)

    clear, rest = bit_split(rows, F.col("rid"), gone.select(F.col("rid").alias("k")), facts["rows"])
    rest = rest.join(gone.withColumnRenamed("rid", "_rid"), (F.col("rid") == F.col("_rid")) & F.col("id").eqNullSafe(F.col("_id")), "left").drop("_rid", "_id")
    whole_docs = clear.withColumn("gone", F.lit(None).cast("array<int>")).unionByName(rest)
    parts = F.split("text", "\n")
    stays = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return whole_docs.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(stays).alias(text_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
    )


#: One edit at most: equal up to some place and, past a character of one or of both, from there on.
ORACLE = """
WITH l AS (SELECT doc_id, i - 1 AS place, line FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
d AS (SELECT line, length(line) AS n, min((doc_id, place)) AS first FROM l WHERE length(line) >= 24 OR regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line),
late AS (SELECT DISTINCT CASE WHEN a.first < b.first THEN b.line ELSE a.line END AS line FROM d a JOIN d b ON a.n >= 24 AND b.n >= 24 AND a.line < b.line AND b.n BETWEEN a.n - 1 AND a.n + 1
  AND (left(a.line, (least(a.n, b.n) // 2)::BIGINT) = left(b.line, (least(a.n, b.n) // 2)::BIGINT) OR right(a.line, ((least(a.n, b.n) + 1) // 2)::BIGINT) = right(b.line, ((least(a.n, b.n) + 1) // 2)::BIGINT))
  AND list_aggregate(list_transform(generate_series(0, a.n), lambda i: CASE WHEN left(a.line, i) = left(b.line, i) AND (substr(a.line, i + 2) = substr(b.line, i + 2) OR substr(a.line, i + 2) = substr(b.line, i + 1) OR substr(a.line, i + 1) = substr(b.line, i + 2)) THEN 1 ELSE 0 END), 'max') = 1),
k AS (SELECT l.doc_id, l.place, l.line, d.line IS NOT NULL AND ((l.doc_id, l.place) <> d.first OR late.line IS NOT NULL) AS gone FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN late ON l.line = late.line)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (NOT k.gone), '') END AS text,
       count(k.place) AS n_lines, count(*) FILTER (k.gone) AS n_dropped
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id GROUP BY documents.doc_id, documents.text
"""
