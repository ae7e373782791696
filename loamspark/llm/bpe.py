"""Byte-level BPE with a hierarchical-bitmap rank queue, and its inverse.

The text is split by the tokenizer's pattern.  Matches that aren't entries themselves are merged, many at
a time, in one queue: their bytes form a doubly linked list that is broken between matches; every
neighbouring pair whose joined bytes have a rank puts its left position into that rank's bucket.  A
two-level bitmap over ranks (one bit a bucket, one bit a group of 1024 buckets) gives the lowest filled
rank by find-first-set.  A bucket's positions are taken from the left; an entry whose pair has changed
since is stale and skipped.  A merge costs the same at any length, so very long matches don't cost their
square; short ones share the cost of setting up a queue.

Decoding looks ids up in a table of their bytes, a batch at a time.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import pick, slices, thrifty

#: Matches whose ids a task remembers, in two generations of this size: when the younger is full it becomes
#: the older, and what is met again moves to the younger.  An idle worker remembers none.
CACHE = 1 << 17
#: Bytes of text, and of matches that go through one queue, at a time; a single longer one goes alone.
TEXT, QUEUE = 1 << 20, 1 << 19
GROUP_BITS = 10
LOW = (1 << GROUP_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ranks(dict):
    """From an entry's bytes to its rank; also the ranks of all pairs of bytes, and all entries' bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(ranks)
        self.octets = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = np.full(1 << 16, -1, np.int32)
        for piece, r in ranks.items():
            if len(piece) == 2:
                self.pairs[piece[0] << 8 | piece[1]] = r
        by_rank = dict(zip(ranks.values(), ranks.keys()))
        self.entries = pa.array([by_rank.get(i) for i in range(max(by_rank) + 1)], pa.binary())


def merge(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each match, as packed 32-bit integers.  No match is empty."""
    text = b"".join(pieces)
    n, get = len(text), ranks.get
    ends = np.cumsum([len(x) for x in pieces])
    begins = np.append(0, ends[:-1])
    edge = bytearray(n + 1)  # whether a match begins here; the end of the last is one more
    np.frombuffer(edge, np.uint8)[np.append(begins, n)] = 1
    octets = np.frombuffer(text, np.uint8)
    first = np.append(ranks.pairs[octets[:-1].astype(np.int32) << 8 | octets[1:]], np.int32(-1))
    first[ends - 1] = -1
    packed = lambda x: array("i", np.asarray(x, np.int32).tobytes())
    pair = packed(first)  # the rank of the pair whose left part starts here, -1 if none or merged away
    stop = packed(np.arange(1, n + 1))  # where the part that starts here ends, 0 if merged away
    prev = packed(np.arange(-1, n))
    ids = packed(ranks.octets[octets])
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    filled, cuts = np.unique(first[at], return_index=True)
    cuts, places = [*cuts.tolist(), len(at)], at.tolist()
    buckets = {r: places[a:b] for r, a, b in zip(filled.tolist(), cuts, cuts[1:])}
    del places, first
    groups, top = [0] * ((len(ranks.entries) >> GROUP_BITS) + 1), 0  # groups: a bitmap of filled buckets each
    for r in buckets:
        groups[r >> GROUP_BITS] |= 1 << (r & LOW)
        top |= 1 << (r >> GROUP_BITS)
    while top:
        g = (top & -top).bit_length() - 1
        bits = groups[g]
        low = bits & -bits
        rank = g << GROUP_BITS | low.bit_length() - 1
        groups[g] = bits = bits ^ low
        if not bits:
            top ^= 1 << g
        bucket = buckets.pop(rank)
        bucket.sort()
        for done, i in enumerate(bucket, 1):
            if pair[i] != rank:
                continue
            j = stop[i]
            k = stop[j]
            stop[i], ids[i], stop[j], pair[j] = k, rank, 0, -1
            fresh = []
            if edge[k]:
                pair[i] = -1
            else:
                prev[k] = i
                pair[i] = r = get(text[i : stop[k]], -1)
                if r >= 0:
                    fresh.append((r, i))
            if not edge[i]:
                h = prev[i]
                pair[h] = r = get(text[h:k], -1)
                if r >= 0:
                    fresh.append((r, h))
            if not fresh:
                continue
            for r, x in fresh:
                if r in buckets:
                    buckets[r].append(x)
                else:
                    buckets[r] = [x]
                    g = r >> GROUP_BITS
                    groups[g] |= 1 << (r & LOW)
                    top |= 1 << g
            # A pair of this rank or a lower one comes before the rest of the bucket.
            if min(fresh)[0] <= rank and done < len(bucket):
                if rank in buckets:
                    buckets[rank] += bucket[done:]
                else:
                    buckets[rank] = bucket[done:]
                    g = rank >> GROUP_BITS
                    groups[g] |= 1 << (rank & LOW)
                    top |= 1 << g
                break
    alive = np.frombuffer(stop, np.int32) > 0
    out = np.frombuffer(ids, np.int32)[alive].tobytes()
    cuts = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


class Codec(dict):
    """From a match (str) to its ids as packed 32-bit integers; also the decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = Ranks(ranks), regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def learn(self, matches: Iterable[str]) -> dict[str, bytes]:
        """From now on the matches are known; those too long to be remembered are given back."""
        new, longer = [], {}
        for x in matches:
            ids = self.older.get(x)
            if ids is None:
                new.append(x)
            else:
                self[x] = ids
        batch, size = [], 0
        for x in [*new, None]:
            piece = x.encode() if x is not None else b""
            if batch and (x is None or size + len(piece) > QUEUE):
                for y, ids in zip(batch, merge([p for _, p in batch], self.ranks)):
                    (self if len(y[1]) <= 64 else longer)[y[0]] = ids
                batch, size = [], 0
            if x is not None:
                r = self.ranks.get(piece)
                if r is not None:
                    self[x] = np.int32(r).tobytes()
                else:
                    batch.append((x, piece))
                    size += len(piece)
        return longer

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        found = [self.find(x) for x in texts]
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        longer = self.learn(set().union(*found).difference(self))
        if longer:
            get = lambda x: self.get(x) or longer[x]
            return [b"".join(map(get, x)) for x in found]
        return [b"".join(map(self.__getitem__, x)) for x in found]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes that each list of ids stands for.  An id outside the table fails."""
        flat = ids.flatten()
        parts = self.ranks.entries.take(flat)
        if parts.null_count:
            raise ValueError("an id that no entry has")
        size = pc.list_value_length(ids).fill_null(0).to_numpy()
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int64()), parts), b"").cast(pa.binary())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker, so that later tasks need not load the ranks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, ids array<int>, one row a row.  ``path``: a rank file, on every executor.

    Null and empty texts give no ids.  Rows are encoded alone: repeats and null ids come out as they
    are.  Texts and matches of any length count whole.  Other columns are left out, whatever their names.
    ``decoded`` adds a column of that name, as :func:`bpe_decode` would.  Empty in, empty out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, 1, TEXT):
            ids = c.encode([x or "" for x in b.column(1).to_pylist()])
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            more = [c.decode(lists)] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *more], names=["id", "ids", "decoded"][: 2 + len(more)])
        c.clear()
        c.older = {}

    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(thrifty(run), f"id {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids, decoded binary: the bytes that the ids stand for; null ids give no bytes.  An id outside the table
    fails.  One row a row, repeats and null ids included; other columns are left out.  Empty in, empty out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), c.decode(b.column(1))], names=["id", "ids", "decoded"])

    rows = pick(encoded, id=id_col, ids=ids_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(thrifty(run), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)
