"""Language-model scores from a class-based bigram model whose classes come from exchange clustering.

1. Words are counted over all training texts (a map-side combine in the Python worker, then a group-by).
2. Pairs of neighbours are counted for the ``exchange`` most frequent words, all others being one class.
   That table has at most (exchange + 1)**2 cells; on the driver, words move one at a time to the class
   that raises the class bigrams' likelihood most, for ``sweeps`` sweeps.
3. Every other training word that occurs ``min_count`` times or more goes to the class in which its
   occurrences are likeliest, given how often each class stands before and after it.  Those counts are
   grouped by word over all tasks, so the number of such words has no bound.  Classes number at least
   ``classes``, and the cube root of the number of different words if that is more.
4. Texts become word numbers.  Workers hold the ``held`` most frequent words, a fixed bound; counts and
   classes of the rarer words reach the texts through a join on the word.  Class bigrams are counted
   over all training texts with all words' classes.
5. P(word | previous) = mix * P(class | previous class) * P(word | class) + (1 - mix) * P(word).

Words below ``min_count`` stand for words never seen: they share the class "rare", where probabilities
are proportional to c + 0.5, also that of a word never seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, pick, release, slices, written

#: The end token's key among words; no word is empty.
END = b""
#: Different words that a worker counts before it hands them on.
FLUSH = 300_000
#: Different words, and places of words, that a worker gathers before it hands on their neighbours.
FLUSH_WORDS, FLUSH_PLACES = 200_000, 2_000_000
#: Word numbers whose probabilities a worker holds at a time; its arrays take some 100 bytes for each.
TOKENS = 1 << 18
#: Parts by hash of the words that are equally common, of which some are held.
PARTS = 1 << 14
#: A class before (below the number of classes) or after (from there on) a word, and how often.
NEIGHBOUR = np.dtype([("code", "<u2"), ("n", "<u4")])
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.split() knows just the six ASCII white-space characters."""
    return (text or b"").translate(TO_LOWER).split()


def held_out(id_col: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text, a null's being empty, has the remainder."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over all texts; END once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return b

        for b in slices(batches, 0):
            for x in b.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(x))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield out()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _indexed(texts: list[bytes | None], index: dict[bytes, int], missing: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Word numbers of all texts, END after each; the number of tokens of each; its words."""
    words = [words_of(x) for x in texts]
    sizes = np.array([len(x) + 1 for x in words], np.int64)
    ids, at, end, get = np.empty(int(sizes.sum()), np.int64), 0, index.get(END, missing), index.get
    for x in words:
        n = len(x)
        ids[at : at + n] = [get(w, missing) for w in x]
        ids[at + n] = end
        at += n + 1
    return ids, sizes, words


def pair_counts(texts: DataFrame, top: list[bytes]) -> np.ndarray:
    """Matrix of neighbours' counts over ``top`` (END first) and, last, all other words.  A text begins after END."""
    k = len(top)
    index = {w: i for i, w in enumerate(top)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) ** 2, np.int64)
        for b in slices(batches, 0):
            ids, _, _ = _indexed(b.column(0).cast(pa.binary()).to_pylist(), index, k)
            if len(ids):
                before = np.append(0, ids[:-1])  # END, number 0, stands before each text's first word
                np.add.at(total, before * (k + 1) + ids, 1) if len(ids) < 1000 else np.add(total, np.bincount(before * (k + 1) + ids, minlength=len(total)), out=total)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((k + 1) ** 2, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(k + 1, k + 1)


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each word.  The first (END) and the last (rare) stay alone in classes 0 and ``classes + 1``."""
    v = len(pairs)
    pairs = pairs.astype(np.float64)
    of = np.concatenate(([0], np.arange(v - 2) % classes + 1, [classes + 1]))
    g = classes + 2
    f = lambda x: x * np.log(np.maximum(x, 1))
    table = np.zeros((g, g))
    np.add.at(table, (of[:, None].repeat(v, 1), of[None, :].repeat(v, 0)), pairs)
    places = np.arange(g)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, v - 1):
            own = pairs[w, w]
            right = np.bincount(of, pairs[w], g)
            left = np.bincount(of, pairs[:, w], g)
            old = of[w]
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            ft, diag = f(table), np.diag(table)
            row, col = table + right, table + left[:, None]
            gain = f(row).sum(1) - ft.sum(1) + f(col).sum(0) - ft.sum(0)
            both = diag + right + left + own
            gain += f(both) - f(diag + right) - f(diag + left) + np.diag(ft)
            rows, cols = table.sum(1), table.sum(0)
            out, into = right.sum() + own, left.sum() + own
            # A class's margins also change where the word's neighbours lie in it.
            gain -= f(rows + out + left) - f(rows) + f(cols + into + right) - f(cols)
            # Other classes' margins grow by the same whatever the choice, but for the chosen one's own part.
            gain += f(rows + left) - f(rows) + f(cols + right) - f(cols)
            gain[0] = gain[-1] = -np.inf
            new = int(places[np.argmax(gain)])
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            table[new] += right
            table[:, new] += left
            table[new, new] += own
        if not moved:
            break
    return of


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def neighbours(texts: DataFrame, top: list[bytes], of: np.ndarray) -> DataFrame:
    """(word, parts): of each word outside ``top``, the NEIGHBOUR records found by each worker.

    ``of``: classes of ``top``'s words and, last, of all others.
    """
    k, g = len(top), int(of[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes, size = Numbers(zip(top, range(k))), [], 0

        def out() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(codes), return_counts=True)
            at = cells // (2 * g)
            starts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            data = np.empty(len(cells), NEIGHBOUR)
            data["code"], data["n"] = cells % (2 * g), n
            offsets = (starts * NEIGHBOUR.itemsize).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array([*numbers][k:], pa.binary()), parts], names=["word", "part"])

        for b in slices(batches, 0):
            ids: list[int] = []
            for x in b.column(0).cast(pa.binary()).to_pylist():
                ids += map(numbers.__getitem__, words_of(x))
                ids.append(0)
            every = np.array(ids, np.int64)
            classes = of[np.minimum(every, k)]
            at = np.flatnonzero(every >= k)
            word = (every[at] - k) * (2 * g)
            # END, number 0, stands before each text's first word and after its last.
            codes += [word + np.where(at > 0, classes[at - 1], 0), word + g + classes[at + 1]]
            size += len(at)
            if size and (len(numbers) - k > FLUSH_WORDS or size > FLUSH_PLACES // 2):
                yield out()
                numbers, codes, size = Numbers(zip(top, range(k))), [], 0
        if size:
            yield out()

    return texts.mapInArrow(run, "word binary, part binary").groupBy("word").agg(F.collect_list("part").alias("parts"))


def assigned(found: DataFrame, steps: np.ndarray, sizes: np.ndarray, min_count: int) -> DataFrame:
    """(word, c, g) of each word of :func:`neighbours`: its count and its likeliest class, "rare" below min_count.

    A word's occurrences have the likelihood of their class after the classes before them, of the classes
    after it, and of the word among its class's ``sizes`` and itself.
    """
    g = len(steps)
    weights = np.concatenate((np.log(steps), np.log(steps).T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                lists = b.column(1)
                parts = lists.flatten()
                word = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
                word = np.repeat(word, pc.binary_length(parts).to_numpy() // NEIGHBOUR.itemsize)
                data = np.frombuffer(b"".join(parts.to_pylist()), NEIGHBOUR)
                around = np.bincount(word * (2 * g) + data["code"], data["n"], b.num_rows * 2 * g).reshape(-1, 2 * g)
                c = around[:, :g].sum(1)
                often = c >= min_count
                gain = around[often] @ weights - c[often, None] * np.log(sizes + c[often, None])
                gain[:, [0, -1]] = -np.inf
                best = np.full(b.num_rows, g - 1, np.int32)
                best[often] = np.argmax(gain, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int64)), pa.array(best)], names=["word", "c", "g"])

    return found.mapInArrow(run, "word binary, c long, g int")


@dataclass
class Model:
    words: dict[bytes, int]  # the most frequent words' numbers, END first
    c: np.ndarray
    of: np.ndarray  # their classes
    steps: np.ndarray  # class to class
    sizes: np.ndarray  # occurrences of each class's words
    n: int
    v: int
    rare: float  # sum of c + 0.5 over the class "rare", with one unseen word
    mix: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, before: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        inner = np.where(g == len(self.steps) - 1, (c + 0.5) / self.rare, c / np.maximum(self.sizes[g], 1))
        return self.mix * self.steps[before, g] * inner + (1 - self.mix) * self.base(c)

    def held_parts(self, ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """Sums for each text over words that are held, of ``score`` over those after such a word."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        before = np.append(0, ids[:-1]) if len(ids) else ids
        some, both = ids >= 0, (ids >= 0) & (before >= 0)
        add = lambda where, x: np.bincount(doc[where], x, len(sizes))
        c = self.c[ids[some]]
        p = self.p(self.of[before[both]], self.of[ids[both]], self.c[ids[both]])
        return {"n_known": add(some, c > 0).astype(np.int64), "base_score": add(some, np.log10(self.base(c))), "score": add(both, np.log10(p))}

    def open_parts(self, x: dict[str, np.ndarray], sizes: np.ndarray) -> dict[str, np.ndarray]:
        """The sums' rest: words that aren't held, and held words after such a word."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        before, right = left_classes(x, self.of), x["right"] >= 0
        after = x["right"][right]
        add = lambda where, x: np.bincount(doc[where], x, len(sizes))
        score = add(slice(None), np.log10(self.p(before, x["g"], x["c"]))) + add(right, np.log10(self.p(x["g"][right], self.of[after], self.c[after])))
        return {"n_known": add(slice(None), x["c"] > 0).astype(np.int64), "base_score": add(slice(None), np.log10(self.base(x["c"]))), "score": score}

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        """Of texts whose words are held or never seen."""
        ids, sizes, _ = _indexed(texts, self.words, -1)
        at, many = open_places(ids, sizes)
        unseen = {"left": np.append(0, ids)[at], "right": ids[at + 1], "g": np.full(len(at), len(self.steps) - 1), "c": np.zeros(len(at))}
        held, rest = self.held_parts(ids, sizes), self.open_parts(unseen, many)
        return {"n_tokens": sizes} | {k: held[k] + rest[k] for k in held}


def open_places(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that aren't held, and how many each text has.  A text's last token, END, is held."""
    at = np.flatnonzero(ids < 0)
    return at, np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at], minlength=len(sizes))


def left_classes(x: dict[str, np.ndarray], of: np.ndarray) -> np.ndarray:
    """A word that isn't held and follows another such word has that one just before it among its text's."""
    return np.where(x["left"] >= 0, of[np.maximum(x["left"], 0)], np.append(0, x["g"][:-1]) if len(x["g"]) else x["g"])


def coded(rows: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """(id, row, held_out, ids, open) of (id, held_out, text): END closes each text's ids, -1 is a word that
    isn't held; of these, ``open`` has the place, the neighbours' numbers and the word."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for b in slices(batches, 2):
            ids, sizes, texts = _indexed(b.column(2).cast(pa.binary()).to_pylist(), shared.value, -1)
            at, many = open_places(ids, sizes)
            begins = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(sizes)), many)
            place = at - begins[doc]
            word = [texts[d][i] for d, i in zip(doc.tolist(), place.tolist())]
            numbers = [pa.array(x.astype(np.int32)) for x in (place, np.append(0, ids)[at], ids[at + 1])]
            opened = pa.StructArray.from_arrays([*numbers, pa.array(word, pa.binary())], names=["at", "left", "right", "word"])
            offsets = lambda x: pa.array(np.append(0, np.cumsum(x)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets(sizes), pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offsets(many), opened)]
            own = pa.array(np.arange(number, number + b.num_rows))
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), own, b.column(1), *lists], names=["id", "row", "held_out", "ids", "open"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, row long, held_out boolean, ids array<int>, open array<struct<at: int, left: int, right: int, word: binary>>")


def opened(codes: DataFrame, classed: DataFrame, rare: int) -> DataFrame:
    """(row, held_out, xs): of each text with words that aren't held, these in order with class and count."""
    each = codes.select("row", "held_out", F.explode("open").alias("x")).select("row", "held_out", "x.*")
    found = each.join(classed, "word", "left").select("row", "held_out", F.struct("at", "left", "right", F.coalesce("g", F.lit(rare)).alias("g"), F.coalesce("c", F.lit(0).cast("long")).alias("c")).alias("x"))
    return found.groupBy("row", "held_out").agg(F.sort_array(F.collect_list("x")).alias("xs"))


def lists_of(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def open_arrays(column: pa.ListArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    flat, sizes = lists_of(column)
    return {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("left", "right", "g", "c")}, sizes


def class_pairs(codes: DataFrame, rest: DataFrame, of: np.ndarray, g: int) -> np.ndarray:
    """Matrix of neighbouring classes' counts over texts of :func:`coded` and :func:`opened`."""

    def tally(cells) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(g * g, np.int64)
            for b in slices(batches, 0, TOKENS):
                for first, second in cells(b.column(0)):
                    total += np.bincount(first * g + second, minlength=g * g)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

        return run

    def held(column: pa.ListArray) -> list:
        ids = column.flatten().to_numpy(zero_copy_only=False)
        before = np.append(0, ids[:-1]) if len(ids) else ids
        both = (ids >= 0) & (before >= 0)
        return [(of[before[both]], of[ids[both]])]

    def others(column: pa.ListArray) -> list:
        x, _ = open_arrays(column)
        right = x["right"] >= 0
        own = x["g"].astype(np.int64)
        return [(left_classes(x, of), own), (own[right], of[x["right"][right]])]

    schema = "cell long, n long"
    both = codes.select("ids").mapInArrow(tally(held), schema).unionByName(rest.select("xs").mapInArrow(tally(others), schema))
    rows = both.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(g * g, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(g, g)


def most_frequent(counts: DataFrame, held: int) -> tuple[list[bytes], np.ndarray, Column]:
    """END, then at most ``held`` words, commonest first; their counts; the condition by which they were chosen.

    It comes from a histogram over sixteenths of powers of two, and in the last of these, where not all words have
    room, from one over the words' hashes; so no task or driver sorts more.
    """
    bucket, part = F.floor(F.log2("c") * 16), F.pmod(F.xxhash64("word"), F.lit(PARTS))
    count = lambda rows, by: {r["b"]: r["n"] for r in rows.groupBy(by.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = count(counts, bucket)
    bound, room, among = max(sizes, default=0) + 1, held, F.lit(False)
    for b in sorted(sizes, reverse=True):
        if sizes[b] > room:
            parts, end = count(counts.where(bucket == F.lit(b)), part), 0
            while parts.get(end, 0) <= room:
                room -= parts.get(end, 0)
                end += 1
            among = (bucket == F.lit(b)) & (part < end)
            break
        bound, room = b, room - sizes[b]
    among = (bucket >= F.lit(bound)) | among
    got = counts.where(among | (F.col("word") == F.lit(END))).toArrow()
    order = got.append_column("rest", pc.not_equal(pc.binary_length(got["word"]), 0)).sort_by([("rest", "ascending"), ("c", "descending"), ("word", "ascending")])
    return order["word"].to_pylist(), order["c"].to_numpy().astype(np.float64), among


def transitions(table: np.ndarray) -> np.ndarray:
    return (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * len(table))


def clustered(texts: DataFrame, counts: DataFrame, classes: int, exchange_words: int, held: int, sweeps: int, mix: float, min_count: int, keep: Callable[[DataFrame], DataFrame] = cut) -> tuple[Model, DataFrame]:
    """A model that lacks its steps, and (word, c, g) of all training words outside the exchange, as ``keep`` stores it."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = total[0] or 0, total[1]
    grown = int(v ** (1 / 3))
    words, c, among = most_frequent(counts, held)
    if not words:
        words, c = [END], np.zeros(1)
    k = min(max(exchange_words, 4 * grown), len(words))
    pairs = pair_counts(texts, words[:k])
    classes = max(1, min(max(classes, grown), k - 1))
    of = exchange(pairs, classes, sweeps)
    g = classes + 2
    table = np.zeros((g, g))
    np.add.at(table, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), pairs)
    sizes = np.bincount(of[:k], c[:k], g)
    classed = keep(assigned(neighbours(texts, words[:k], of), transitions(table), sizes, min_count))
    per_class = classed.groupBy("g").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    for x in per_class:
        sizes[x["g"]] += x["c"]
    rare = sizes[-1] + 0.5 * (1 + sum(x["n"] for x in per_class if x["g"] == g - 1))
    of = np.append(of[:k], np.full(len(words) - k, g - 1))
    index = {w: i for i, w in enumerate(words)}
    if len(words) > k:
        got = classed.where(among).select("word", "g").toArrow()
        of[[index[w] for w in got["word"].to_pylist() if w in index]] = [x for w, x in zip(got["word"].to_pylist(), got["g"].to_pylist()) if w in index]
    return Model(index, c, of, np.zeros((g, g)), sizes, n, v, rare, mix), classed


def fit(texts: DataFrame, counts: DataFrame, classes: int, exchange_words: int, held: int, sweeps: int, mix: float, min_count: int = 2) -> Model:
    model, classed = clustered(texts, counts, classes, exchange_words, held, sweeps, mix, min_count)
    codes = cut(coded(texts.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), "text"), model.words))
    g = len(model.steps)
    return replace(model, steps=transitions(class_pairs(codes, opened(codes, classed, g - 1), model.of, g)))


def lm_scores(docs: DataFrame, classes: int = 64, exchange_words: int = 1024, held: int = 1 << 18, sweeps: int = 4, mix: float = 0.9, id_col: str = "doc_id", text_col: str = "text", min_count: int = 2) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from the texts that aren't held out.  Null and empty texts are one end token.  Repeated rows
    count and are scored each for itself; a null id has the empty text's fold.  Texts of any length count
    whole.  Other columns are left out, whatever their names.  Of equally good classes a word gets the first.  Without training texts
    all words are alike unseen.  ``classes`` and ``exchange_words`` are least numbers, which grow with
    the vocabulary.  Empty in, empty out.
    """
    with ExitStack() as stack:
        return cut(_lm_scores(docs, classes, exchange_words, held, sweeps, mix, id_col, text_col, min_count, lambda df: stack.enter_context(written(df))))


def _lm_scores(docs: DataFrame, classes: int, exchange_words: int, held: int, sweeps: int, mix: float, id_col: str, text_col: str, min_count: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``keep`` stores, the result still reads."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("held_out", held_out(F.col("id")))
    texts = rows.where(~F.col("held_out")).select("text")
    model, classed = clustered(texts, cut(word_counts(texts)), classes, exchange_words, held, sweeps, mix, min_count, keep)
    release(docs.sparkSession)
    codes = keep(coded(rows, model.words))
    g = len(model.steps)
    rest = keep(opened(codes, classed, g - 1))
    release(docs.sparkSession)
    train = lambda x: x.where(~F.col("held_out"))
    model = replace(model, words={}, steps=transitions(class_pairs(train(codes), train(rest), model.of, g)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sums = ("n_known", "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3, TOKENS):
            flat, sizes = lists_of(b.column(3))
            s = shared.value.held_parts(flat.to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(sizes), *(pa.array(s[x]) for x in sums)], names=["id", "row", "held_out", "n_tokens", *sums])

    def run_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, TOKENS):
            s = shared.value.open_parts(*open_arrays(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[x]) for x in sums)], names=["row", *(f"_{x}" for x in sums)])

    kind = rows.schema["id"].dataType.simpleString()
    parts = codes.select("id", "row", "held_out", "ids").mapInArrow(run, f"id {kind}, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    others = rest.select("row", "xs").mapInArrow(run_open, "row long, _n_known long, _base_score double, _score double")
    out = parts.join(others, "row", "left")
    both = lambda x, zero: (F.col(x) + F.coalesce(f"_{x}", F.lit(zero))).alias(x)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", both("n_known", 0), F.lit(model.n).cast("long").alias("train_tokens"), both("base_score", 0.0), both("score", 0.0))
