"""Quality rules: counts of a text's words, lines and symbols, and repetition by suffix arrays.

A suffix array over the words of each text is built by prefix doubling in numpy, for a batch of
texts at once: the document number leads every rank, so suffixes of different texts never match.
Neighbours in the array give the longest common prefixes; the larger of a suffix's two is the length
of the longest repeat that starts there, that is the deepest prefix interval that holds it.  The
union of those spans is the union of all maximal repeated substrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

SYMBOLS = b"#*$%&|<>"
#: Words of texts whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 400_000


class _Ids(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and for each place of it the first place that holds the same key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return order, np.repeat(first, np.diff(np.append(first, len(s))))


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place, the length in words of the longest run from there that its text has elsewhere too.

    ``words``: ids, texts one after the other; ``doc``: each place's text number, from 0 up.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    end = np.append(np.flatnonzero(np.diff(doc)) + 1, n)[doc]
    order, first = _ranked(doc * (int(words.max()) + 1) + words)
    rank = np.empty(n, np.int64)
    rank[order] = first
    # A rank is the place in the suffix array of the first suffix that has it.  Level L ranks by 2**L
    # words; only suffixes that still share a rank ("live") are sorted on.
    levels, live = [rank.astype(np.int32)], np.arange(n)
    while True:
        live = live[np.bincount(rank[live], minlength=n)[rank[live]] > 1]
        if not len(live):
            break
        far = live + (1 << len(levels) - 1)
        second = np.where(far < end[live], rank[np.minimum(far, n - 1)] + 1, 0)
        order, first = _ranked(rank[live] * (n + 1) + second)
        live = live[order]
        old = rank[live]
        group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        start = np.repeat(group, np.diff(np.append(group, len(old))))
        rank[live] = old + first - start
        levels.append(rank.astype(np.int32))
    array = np.argsort(rank, kind="stable")
    same = np.flatnonzero(levels[0][array[:-1]] == levels[0][array[1:]])
    a, b = array[same], array[same + 1]
    common = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        ok = (i < end[a]) & (j < end[b])
        ok &= levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)]
        common += np.where(ok, 1 << level, 0)
    by = np.zeros(n + 1, np.int64)
    by[same + 1] = common
    out[array] = np.maximum(by[:-1], by[1:])
    return out


def covered(lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which places lie in a span [i, i + lengths[i]); spans don't leave their text."""
    n = len(lengths)
    starts = np.flatnonzero(lengths)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + lengths[starts], end[starts]), -1)
    return np.cumsum(delta[:-1]) > 0


def measure(texts: list[bytes], min_repeat: int) -> dict[str, list[int]]:
    """The counts of texts in UTF-8; bytes.split() knows just the six ASCII white-space characters."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
    out: dict[str, list[int]] = {x: [] for x in names}
    ids = _Ids()
    group: list[np.ndarray] = []

    def flush() -> None:
        if not group:
            return
        sizes = np.array([len(x) for x in group])
        doc = np.repeat(np.arange(len(group)), sizes)
        filled = np.flatnonzero(sizes)
        flat = np.concatenate(group)
        dense = np.repeat(np.arange(len(filled)), sizes[filled])
        far = longest_repeats(flat, dense)
        end = np.repeat(np.cumsum(sizes), sizes)
        for name, spans in (("n_repeat_words", np.where(far >= 3, 3, 0)), ("n_covered", np.where(far >= min_repeat, far, 0))):
            out[name] += np.bincount(doc[covered(spans, end)], minlength=len(group)).tolist()
        top = np.zeros(len(group), np.int64)
        np.maximum.at(top, doc, far)
        out["longest_repeat"] += top.tolist()
        group.clear()
        ids.clear()

    held = 0
    for t in texts:
        words = t.split()
        joined = b"".join(words)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(joined.decode("utf-8", "replace")))
        out["n_symbols"].append(len(joined) - len(joined.translate(None, SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        if held and held + len(words) > BATCH_WORDS:
            flush()
            held = 0
        group.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        held += len(words)
    flush()
    return out


def quality_rules(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.4, max_longest: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict per document.

    Repeats of ``min_repeat`` words or more cover words (n_covered; all occurrences).  A text is kept
    if it passes the base rules (50 words at least; words in twice-found 3-word windows at most half)
    and repeats cover at most ``max_covered`` of its words and the longest repeat has at most
    ``max_longest`` of them.  Null or empty texts have no words and fail the base rules.  Each row is
    judged alone: repeated rows and null ids come out as they are.  Empty in, empty out.
    """
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            got = measure([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], min_repeat)
            got = {k: np.array(v, np.int64) for k, v in got.items()}
            n = got["n_words"]
            failed = (n < 50) | (100 * got["n_repeat_words"] > 50 * n)
            kept = ~failed & (got["n_covered"] <= max_covered * n) & (got["longest_repeat"] <= max_longest * n)
            cols = [b.column(0), *(pa.array(got[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(got["n_covered"]), pa.array(got["longest_repeat"])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(x.split()[0] for x in schema.split(", "))])

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)
