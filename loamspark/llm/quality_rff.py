"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

1. Each whole text becomes a row of statistics (:data:`STATISTICS`), in one pass, cut.
2. Labelled rows are standardised and mapped to cos(Wx + b), which approximates a Gaussian kernel.
   Every partition sums its normal equations for each fold, of fixed size; the driver adds and solves them.
3. Each labelled row gets a raw score from the equations of the other folds, so that calibration sees how
   unseen rows score; copies of a text share a fold.  Raw scores are counted in fixed bins; pooling adjacent
   violators over the bins gives a monotone calibration, interpolated between its blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, pick, release, slices, thrifty

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper_words", "capital_words", "digit_chars", "stop_chars", "exclamations",
    "symbols", "pipes", "other_marks", "non_ascii", "distinct_words", "commonest_word", "adjacent_repeats", "ending_words", "short_words",
    "log_lines", "log_line_length", "repeated_lines", "spaces", "pair_repeats", "longest_word",
)
DIGITS, STOPS, SYMBOLS, MARKS = b"0123456789", b".,;:", b"#*$%&<>", b"\"'()[]{}/\\=_+-~^`@"
BINS, FOLDS = 1000, 4


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not n:
        return [math.log1p(size)] + [0.0] * (len(STATISTICS) - 1)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    text_words = text.decode("utf-8", "replace").split()
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), float(lengths.std()),
        sum(map(str.isupper, text_words)) / n, sum(map(str.istitle, text_words)) / n, share(DIGITS), share(STOPS), share(b"!?"),
        share(SYMBOLS), share(b"|"), share(MARKS), len(text.translate(None, bytes(range(128)))) / size, len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, len([1 for x in words if x[-1] in b".!?"]) / n, float((lengths <= 3).mean()),
        math.log1p(len(lines)), math.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), text.count(b" ") / size,
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0, math.log1p(float(lengths.max())),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>); a null text is the empty one."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            x = [statistics(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return rows.mapInArrow(thrifty(run), f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    at: np.ndarray  # calibration: raw scores, ascending
    to: np.ndarray  # and what they stand for

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.to), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """For each fold the sum of (features, y)^T (features, y), first in each partition, then of all partitions.

    A partition with fewer rows of a fold than a row has numbers hands on those rows instead of their sum, which would
    be larger; so what is shuffled follows the rows, not the number of partitions.  A fold's sums are added up in one
    task, so keep the partitions few."""
    d = model.w.shape[1] + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = {}, {k: np.zeros((0, d)) for k in range(FOLDS)}
        for b in batches:
            z = np.column_stack([model.features(_matrix(b.column(0))), b.column(1).to_numpy()])
            fold = b.column(2).to_numpy()
            for k in range(FOLDS):
                rest[k] = np.concatenate((rest[k], z[fold == k]))
                if k in total or len(rest[k]) >= d:
                    total[k] = total.get(k, 0) + rest[k].T @ rest[k]
                    rest[k] = rest[k][:0]
        some = [(k, k in total, total.get(k, rest[k])) for k in range(FOLDS) if k in total or len(rest[k])]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array([x for _, x, _ in some], pa.bool_()), pa.array([m.tobytes() for _, _, m in some], pa.binary())], names=["fold", "summed", "m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((d, d))
        for summed, m in zip(pdf["summed"], pdf["m"]):
            part = np.frombuffer(m).reshape(-1, d)
            total += part if summed else part.T @ part
        return pd.DataFrame({"fold": pdf["fold"][:1], "m": [total.tobytes()]})

    out = np.zeros((FOLDS, d, d))
    for r in rows.select("x", "y", "fold").mapInArrow(thrifty(run), "fold int, summed boolean, m binary").groupBy("fold").applyInPandas(add, "fold int, m binary").collect():
        out[r["fold"]] = np.frombuffer(r["m"]).reshape(d, d)
    return out


def isotonic(n: np.ndarray, y: np.ndarray) -> list[tuple[int, int, float]]:
    """Pool adjacent violators: blocks (first, last, mean) of the bins; ``y`` is each bin's sum."""
    blocks: list[list[float]] = []
    for i, (k, s) in enumerate(zip(n, y)):
        if k:
            blocks.append([i, i, k, s])
            while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
                _, last, k2, s2 = blocks.pop()
                blocks[-1] = [blocks[-1][0], last, blocks[-1][2] + k2, blocks[-1][3] + s2]
    return [(int(a), int(b), s / k) for a, b, k, s in blocks]


def fit(rows: DataFrame, features: int, width: float, ridge: float, partitions: int, seed: int) -> Model | None:
    """``rows``: id, x and y in [0, 1].  None if there are none."""
    d = len(STATISTICS)
    rows = cut(rows.repartition(partitions, F.xxhash64("id", "x")).select("x", "y", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")))
    moments = rows.select([F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.count(F.lit(1)).alias("n")]).first()
    if not moments["n"]:
        return None
    mean, sd = (np.array([moments[f"{k}{i}"] for i in range(d)]) for k in "ms")
    random = np.random.default_rng(seed)
    w, b = random.normal(0, 1 / width, (d, features)), random.uniform(0, 2 * np.pi, features)
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.0]))
    each = normal_equations(rows, model)
    penalty = np.eye(features + 1) * ridge
    penalty[-1, -1] = 1e-9  # the intercept is free
    solved = lambda m: np.linalg.solve(m[:-1, :-1] + penalty, m[:-1, -1])
    model.beta = solved(each.sum(0))
    others = np.column_stack([solved(each.sum(0) - m) for m in each])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (model.features(_matrix(b.column(0))) @ others)[np.arange(b.num_rows), b.column(2).to_numpy()]
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "y"])

    bins = rows.mapInArrow(thrifty(run), "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    n, y = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        n[r["bin"]], y[r["bin"]] = r["n"], r["y"]
    blocks = isotonic(n, y)
    model.at = np.array([((a + z + 1) / 2) / BINS * 2 - 0.5 for a, z, _ in blocks])
    model.to = np.array([mean for _, _, mean in blocks])
    release(rows.sparkSession)
    return model


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def teaching(labels: DataFrame, max_rows: int, id_col: str, label_col: str) -> DataFrame:
    """(id, y): the labels that may be learnt from, one row an id, about ``max_rows`` at most."""
    marks = pick(labels, id=id_col, y=label_col).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    total = marks.count()
    if total > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * (max_rows / total)))
    return marks


def quality_filter(docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1.0, threshold: float = 0.7, partitions: int = 16, max_rows: int = 1_000_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; see :func:`quality_scores`.

    Texts aren't shuffled: those with labels are measured first, then all in the pass that filters them.
    """
    marks = cut(teaching(labels, max_rows, id_col, label_col))
    known = bit_filter(pick(docs, id=id_col, text=text_col), F.xxhash64("id"), marks.select(F.xxhash64("id").alias("k")), marks.count())
    model = fit(with_statistics(known, "id", "text").join(marks, "id").select("id", "x", "y"), features, width, ridge, partitions, seed)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            if model is not None:
                x = np.array([statistics(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()])
                b = b.filter(pa.array(np.round(model.score(x), 9) >= threshold))
            yield b

    return docs.mapInArrow(thrifty(run), docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1.0, threshold: float = 0.7, partitions: int = 16, max_rows: int = 1_000_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Learns from labelled rows (label 0 or 1) that aren't held out; of more than about ``max_rows`` of
    them, an evenly hashed part of that size.  An id with several labels counts as their mean; null
    labels and ids, and labels of no document, teach nothing.  Without any label all scores are 1:
    nothing speaks against a text.  Null and empty texts get a score like any other; repeated rows are
    scored alike.  Empty in, empty out.
    """
    rows = cut(with_statistics(docs, id_col, text_col))
    marks = teaching(labels, max_rows, id_col, label_col)
    model = fit(rows.join(marks, "id").select("id", "x", "y"), features, width, ridge, partitions, seed)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.round(model.score(_matrix(b.column(1))), 9) if model else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    out = rows.mapInArrow(thrifty(run), f"id {kind}, score double, predicted int")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
