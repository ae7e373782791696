"""N-gram Jaccard join by a token-group matrix; results are connected components.

1. Each text becomes its set of distinct word n-grams, as 64-bit hashes.  Equal sets count once from
   here on, under a set id, 64 bits of a digest.
2. A fixed-size sketch counts all tokens of the corpus.  Tokens are ordered by it, rarest first, then by
   hash.  Any common order gives right results; this one makes the first tokens tell sets apart.
3. Two sets that link share some of their first tokens (how many follows from the threshold), the first
   of them at places that leave room for the overlap.  Each such token's sets are compared with one of them, the one in
   which the token comes earliest: a number of pairs linear in the list.  Links give a first partition
   of similar documents into groups, cut to at most ``members`` sets each.
4. The matrix has the groups that hold a token.  A set probes it with its first tokens for groups of
   larger components that hold enough of them at places that leave room for the overlap.  The set's overlap with the group's token union bounds that with each member;
   only groups whose bound suffices are opened and their members compared.
5. Links of both steps give the components.

The number of pairs follows the sets that remain apart after step 3, not the square of a family of copies.
Sets are fetched for the documents of such pairs only; a bounded bitmap finds them before the shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, attach, bit_filter, cut, cut_with, drop_keys, pick, release, row_key, sizes, slices, thrifty, written
from .components import components

CELL_BITS, BLOCK_BITS, SALTS = 20, 14, 64
#: Places of a set's order by which it may be probed beyond the least, and tokens that must then be shared.
MORE = 3
#: Bytes of text that a worker hashes at a time; its arrays take some 40 times as many.
TEXT = 1 << 20
#: Pairs of one hot key that share a copy of its tokens.
SPREAD = 1024
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOWER_CASE = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(ODD[1])
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, A-Z lower-cased, and each text's number of words.

    A word's hash is the sum of 64-bit values for its bytes at their places, all computed at once.
    """
    joined = np.frombuffer(b"\n".join([x or b"" for x in texts]) + b"\n", np.uint8)
    ends = np.cumsum([len(x or b"") + 1 for x in texts])
    inside = ~SPACE[joined]
    first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    size = np.flatnonzero(~inside & np.append(False, inside[:-1])) - first
    letters = LOWER_CASE[joined[inside]]
    at = np.cumsum(size) - size
    place = np.arange(len(letters), dtype=np.uint64) - np.repeat(at, size).astype(np.uint64)
    values = _mix(letters * np.uint64(ODD[0]) + (place + np.uint64(1)) * np.uint64(ODD[2]))
    hashes = np.add.reduceat(values, at) if len(at) else values
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def token_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Each text's sorted hashes of distinct n-grams; of fewer words, the whole sequence is the one token."""
    h, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts

    def tokens(size: int, h: np.ndarray) -> np.ndarray:
        if len(h) < size:
            return np.empty(0, np.uint64)
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mix(out * np.uint64(ODD[0]) + h[i : len(h) - size + 1 + i])
        return out

    grams = tokens(n, h)
    none = np.empty(0, np.uint64)

    def distinct(a: np.ndarray) -> np.ndarray:
        a = np.sort(a)
        return a[np.append(True, a[1:] != a[:-1])]

    return [distinct(grams[i : i + k - n + 1]) if k >= n else tokens(k, h[i : i + k]) if k else none for i, k in zip(starts.tolist(), counts.tolist())]


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of a and b tokens that link: 100 * i >= percent * (a + b - i)."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _up(a: int, b: int) -> int:
    return -(-a // b)


class Order:
    """The sketch, and with it a set's first tokens."""

    def __init__(self, cells: np.ndarray, n: int, percent: int) -> None:
        self.cells, self.n, self.percent = cells, n, percent

    def first(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """Tokens to probe with, against sets no longer; and how many of them are indexed, for sets no shorter."""
        size, p = len(tokens), self.percent
        probe, index = size - _up(size * p, 100) + MORE, size - _up(2 * size * p, 100 + p) + MORE
        rank = np.lexsort((tokens, self.cells[(tokens & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)]))
        return tokens[rank[:probe]], index


def _sums(sketches: DataFrame) -> np.ndarray:
    """Adds up the tasks' sketches, block by block, in two levels of bounded groups."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["data"])
        data = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"block": pdf["block"][:1], "salt": pdf["salt"][:1], "data": [data]})

    kind = "block int, salt int, data binary"
    once = sketches.groupBy("block", "salt").applyInPandas(add, kind)
    rows = once.withColumn("salt", F.lit(0)).groupBy("block", "salt").applyInPandas(add, kind).collect()
    out = np.zeros(1 << CELL_BITS, np.uint32)
    for r in rows:
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint32)
    return out


def _read(rows: DataFrame, n: int) -> DataFrame:
    """id, text_hash, size, sid of every row (id, text, text_hash); and every task's sketch, as rows with a block number."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells = np.zeros(1 << CELL_BITS, np.uint32)
        names = ["id", "text_hash", "size", "sid", "block", "salt", "data"]
        id_type = None
        for b in slices(batches, 1, TEXT):
            id_type = b.column(0).type
            sets = token_sets(b.column(1).cast(pa.binary()).to_pylist(), n)
            at = np.concatenate(sets) & np.uint64((1 << CELL_BITS) - 1)
            cells += np.bincount(at.astype(np.int64), minlength=len(cells)).astype(np.uint32)
            none = lambda t: pa.nulls(b.num_rows, t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(set_id, sets)), pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary())], names=names)
        if id_type is not None:
            k, step = 1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS
            data = [zlib.compress(cells[i * step : (i + 1) * step].tobytes(), 1) for i in range(k)]
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([salt] * k, pa.int32()), pa.array(data, pa.binary())], names=names)

    return rows.mapInArrow(thrifty(run), f"id {kind}, text_hash long, size int, sid long, block int, salt int, data binary")


def _entries(rows: DataFrame, order) -> DataFrame:
    """(token, sid, size, place, indexed): each set's first tokens; a task leaves out sets that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, met = order.value, set()
        for b in slices(batches, 0, TEXT):
            token, count, facts = [], [], []
            for tokens in token_sets(b.column(0).cast(pa.binary()).to_pylist(), o.n):
                sid = set_id(tokens)
                if len(tokens) and sid not in met:
                    met.add(sid)
                    first, index = o.first(tokens)
                    token.append(first)
                    count.append(len(first))
                    facts.append((sid, len(tokens), index))
            if token:
                place = np.concatenate([np.arange(k) for k in count])
                sid, size, index = (np.repeat(x, count) for x in np.array(facts, np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(sid), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(place < index)], names=["token", "sid", "size", "place", "indexed"])

    return rows.select("text").mapInArrow(thrifty(run), "token long, sid long, size int, place int, indexed boolean")


def _sets(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, TEXT):
            sets = token_sets(b.column(0).cast(pa.binary()).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(set_id, sets)), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["sid", "tokens"])

    return rows.select("text").mapInArrow(thrifty(run), "sid long, tokens binary")


def _overlaps(pairs: DataFrame) -> DataFrame:
    """(a, b, x, y) to (a, b, size_x, size_y, both): x and y are sorted tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(iter([big]), 2):
                x, y = ([np.frombuffer(t, np.uint64) for t in b.column(k).to_pylist()] for k in (2, 3))
                both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.int64()) for v in (list(map(len, x)), list(map(len, y)), both))], names=["a", "b", "size_x", "size_y", "both"])

    return pairs.select("a", "b", "x", "y").mapInArrow(thrifty(run), "a long, b long, size_x long, size_y long, both long")


def _joined(pairs: DataFrame, xs: DataFrame, ys: DataFrame) -> DataFrame:
    """(a, b) to (a, b, x, y) by xs (a, x) and ys (b, y).  A key with a large share of all pairs is salted: its
    tokens are repeated once for each SPREAD of its pairs, so neither meets in one task."""
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("key")) for side in ("a", "b")]))
    ends, facts = cut_with(pairs.select(ends.alias("end")).groupBy("end.side", "end.key").agg(F.count(F.lit(1)).alias("n")), **sizes("n"))
    if facts["largest"] * HOT_SHARE < facts["total"]:
        return pairs.join(xs, "a").join(ys, "b")
    for side, other in (("a", "b"), ("b", "a")):
        mine = ends.where(F.col("side") == side).select(F.col("key").alias(side), "n", F.ceil(F.col("n") / SPREAD).alias("copies"))
        pairs = attach(pairs, mine, [side], "n", facts).withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), F.col("copies"))).drop("n", "copies")
        many = (xs if side == "a" else ys).join(mine.drop("n"), side).withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
        xs, ys = (many, ys) if side == "a" else (xs, many)
    return pairs.join(xs, ["a", "salt_a"]).join(ys, ["b", "salt_b"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The pairs that link, cut, and how many."""
    both = _overlaps(_joined(pairs, sets.withColumnsRenamed({"sid": "a", "tokens": "x"}), sets.withColumnsRenamed({"sid": "b", "tokens": "y"})))
    links, facts = cut_with(both.where(F.col("both") * 100 >= (F.col("size_x") + F.col("size_y") - F.col("both")) * percent).select("a", "b"), n=F.count(F.lit(1)))
    return links, facts["n"]


def _union(groups: DataFrame) -> DataFrame:
    """(gid, tokens) per member to (gid, tokens) per group; a group has few members."""

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]]))
        return pd.DataFrame({"gid": pdf["gid"][:1], "y": [tokens.tobytes()]})

    return groups.groupBy("gid").applyInPandas(union, "gid long, y binary")


def _probes(placed: DataFrame, percent: int) -> DataFrame:
    """placed (token, sid, size, place, indexed, component, crowd, gid) to (a, b): set a may link to one of group b.

    Sets of the component with the smaller crowd probe the groups of the larger, so a crowd is met group by
    group.  Of two sets that link, the longer shares first tokens with the shorter's indexed ones: either the
    probing set is the longer and the group holds the token as indexed, or it is the shorter and has it so.  The
    j-th token that linked sets share leaves room for all but j - 1 of their overlap; MORE of them are looked at.
    """
    mixed = placed.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a != _b").select("token")
    inside = lambda f, c: f(F.when(F.col("indexed"), F.col(c)))
    matrix = placed.join(mixed, "token", "left_semi").groupBy("token", "gid", F.col("component").alias("other"), F.col("crowd").alias("larger")).agg(
        F.min("place").alias("first"), F.min("size").alias("low"), F.max("size").alias("high"),
        inside(F.min, "place").alias("first_in"), inside(F.min, "size").alias("low_in"), inside(F.max, "size").alias("high_in"),
    )
    size = F.col("size")

    def spare(first: str, high: str, least: Column) -> Column:
        return 1 + F.least(F.col(high) - F.col(first) - 1, size - F.col("place") - 1) - least_overlap(size, least, percent)

    longer = F.when((F.col("low_in") <= size) & (F.col("high_in") * 100 >= size * percent), spare("first_in", "high_in", F.greatest(F.col("low_in"), F.ceil(size * percent / 100 - 1e-9))))
    shorter = F.when(F.col("indexed") & (F.col("high") >= size) & (F.col("low") * percent <= size * 100), spare("first", "high", F.greatest("low", "size")))
    met = F.coalesce(F.greatest(longer, shorter), F.lit(-MORE))
    enough = F.least(F.lit(MORE), F.ceil(size * percent / 100 - 1e-9))
    crossing = (F.col("crowd") < F.col("larger")) | ((F.col("crowd") == F.col("larger")) & (F.col("component") < F.col("other")))
    probes = placed.drop("gid").join(matrix, "token").where(crossing & (met > -MORE))
    probes = probes.groupBy(F.col("sid").alias("a"), F.col("gid").alias("b"), "size").agg(F.count(F.lit(1)).alias("n"), F.max(met >= 0).alias("roomy"))
    return probes.where(F.col("roomy") & (F.col("n") >= enough)).select("a", "b")


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, members: int = 256, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """One row per row: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Texts are lower-cased (A-Z).  Two texts link when 100 * |both| >= percent * |either| over their sets
    of n-grams.  Null texts and texts without words have no set and no links.  Rows repeated under one
    id are like copies, and each has its row.  A null id is reachable but never the smallest, unless all
    are null.  Texts of any length count whole.  Other columns are left out, whatever their names.
    ``keys`` adds text_hash (xxhash64 of the text) and component, one number for each component, null for
    texts without words: unlike ids, it isn't shared by different components.  Empty in, empty out.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    read = cut(_read(rows, n))
    order = spark.sparkContext.broadcast(Order(_sums(read.where("block IS NOT NULL").select("block", "salt", "data")), n, percent))
    place_of = read.where("block IS NULL").select("id", "text_hash", "size", "sid")
    classes = cut(place_of.where("size > 0").groupBy("sid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    counted = {"rows": F.count(F.lit(1))}

    # Lists of first tokens that two different sets share, one of them as an index entry; a list's head is a set
    # in which the token comes earliest.
    with written(_entries(rows, order)) as entries:
        lists = entries.groupBy("token").agg(
            F.min("sid").alias("_low"), F.max("sid").alias("_high"), F.max("indexed").alias("_some"),
            F.min_by("sid", "place").alias("head"), F.min_by("size", "place").alias("head_size"), F.count(F.lit(1)).alias("n"),
        )
        lists, facts = cut_with(lists.where("_low != _high AND _some").select("token", "head", "head_size", "n"), **sizes("n"), **counted)
        some = bit_filter(entries, F.xxhash64("token"), lists.select(F.xxhash64("token").alias("k")), facts["rows"])
        listed = cut(attach(some, lists, ["token"], "n", facts, "inner").drop("n"))
    order.unpersist()

    def sets_of(sids: DataFrame) -> DataFrame:
        ids, facts = cut_with(sids.distinct().join(classes, "sid").select("sid", F.xxhash64("least").alias("k")), **counted)
        near = bit_filter(rows, F.xxhash64("id"), ids.select("k"), facts["rows"])
        return cut(_sets(near, n).join(ids, "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens")))

    release(spark)
    # Stars: every set against the one in whose order the shared token comes first.
    fit = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    enough = F.least(F.lit(MORE), F.ceil(F.col("size") * percent / 100 - 1e-9))  # tokens that sets of such sizes share at least
    stars = listed.where((F.col("sid") != F.col("head")) & fit(F.col("size"), F.col("head_size")))
    stars = stars.groupBy(F.col("head").alias("a"), F.col("sid").alias("b"), "size").agg(F.count(F.lit(1)).alias("n"))
    stars = cut(stars.where(F.col("n") >= enough).select("a", "b"))
    stars, _ = _links(stars, sets_of(stars.select(F.explode(F.array("a", "b")).alias("sid"))), percent)
    comps = cut(components(stars))

    release(spark)
    # The matrix: which groups' index entries hold a token, with the most favourable place and the sizes.
    per_comp, facts = cut_with(comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")), **sizes("n"))
    labels = attach(comps, per_comp, ["component"], "n", facts).select(F.col("node").alias("sid"), "component", F.col("n").alias("crowd"), F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / members))).alias("gid"))
    lone = F.col("sid")
    placed = listed.drop("head", "head_size").join(labels, "sid", "left").withColumns({"component": F.coalesce("component", lone), "crowd": F.coalesce("crowd", F.lit(1).cast("long")), "gid": F.coalesce("gid", F.xxhash64(lone, F.lit(0)))})
    placed = cut(placed)
    probes, facts = cut_with(_probes(placed, percent), **counted)
    release(spark)
    final = comps
    if facts["rows"]:
        # Bounds by the groups' unions, then the members of the groups that qualify.
        inside = placed.select("sid", "gid", "size").distinct().join(probes.select(F.col("b").alias("gid")).distinct(), "gid", "left_semi")
        inside = cut(inside)
        sets = sets_of(probes.select(F.col("a").alias("sid")).unionByName(inside.select("sid")))
        unions = cut(_union(inside.select("sid", "gid").join(sets, "sid").select("gid", "tokens")).withColumnRenamed("gid", "b"))
        release(spark)
        opened = _overlaps(_joined(probes, sets.withColumnsRenamed({"sid": "a", "tokens": "x"}), unions)).where(F.col("both") * 100 >= F.col("size_x") * percent)
        pairs = opened.select("a", F.col("b").alias("gid"), F.col("size_x")).join(inside.withColumnRenamed("sid", "b"), "gid").where(fit(F.col("size_x"), F.col("size"))).select("a", "b")
        more, found = _links(cut(pairs), sets, percent)
        release(spark)
        if found:
            # Components of step 3 are stars already: only what the new links join has to move.
            final = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = cut(classes.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    smallest, facts = cut_with(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")), **sizes("m"))
    per_set, facts = cut_with(attach(named, smallest, ["component"], "m", facts).select("sid", "n", "component", "component_id"), **sizes("n"))
    release(spark)
    out = attach(place_of, per_set, ["sid"], "n", facts)
    more = ["text_hash", "component"] if keys else []
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *more)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: that with the smallest id (null is the
    largest), among its texts the one with the smallest hash, among its equal rows one.

    Rows without words all stay.  A row goes only if its own text is linked to that of a row that stays, whatever
    other rows share its id.  Of rows that differ in columns besides id and text, the smallest stays.
    """
    rows = near_components(docs, n, percent, id_col=id_col, text_col=text_col, keys=True).where("n_shingles > 0").withColumnRenamed(id_col, "id")
    counted = {"rows": F.count(F.lit(1))}
    each = cut(rows.groupBy("component", "id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("x")).select("component", F.struct("x.id", "x.text_hash").alias("first"))
    marked = each.select("component", F.struct("id", "text_hash").alias("key"), "n").join(first, "component")
    # All but lone keepers are taken out; keepers with repeats come back as one row.
    out, facts = cut_with(marked.where((F.col("key") != F.col("first")) | (F.col("n") > 1)).select("key", (F.col("key") == F.col("first")).alias("again")), **counted, again=F.count_if(F.col("again")))
    release(docs.sparkSession)
    kept = drop_keys(docs, row_key(id_col, text_col), out.select("key"), facts["rows"])
    if not facts["again"]:
        return kept
    key, repeated = row_key(id_col, text_col), out.where("again").select(F.col("key").alias("_again"))
    some = bit_filter(docs, F.xxhash64(key), repeated.select(F.xxhash64("_again").alias("k")), facts["again"])
    some = some.withColumn("_key", key)
    smallest = some.groupBy("_key").agg(F.min(F.struct(*[F.struct(F.col(c).alias(c)) for c in docs.columns])).alias("_row"))
    back = smallest.join(repeated, F.col("_key").eqNullSafe(F.col("_again")), "left_semi").select(*[F.col(f"_row.{x}.`{c}`").alias(c) for x, c in zip([f"col{i + 1}" for i in range(len(docs.columns))], docs.columns)])
    return kept.unionByName(back)
