"""Readers of small text formats in which a count says how many lines follow.

A path may name any number of files; each is parsed by a task, one block format needs its file whole.  Numbers
(of scenarios, cases, points) count within a file; ``file=True`` adds a column with the file's path.  Text that
isn't a number reads as 0, as does what is missing at a file's end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_line
from ..operators.league import parse_match
from ..operators.signals import KEYS


def _int(text: str) -> int:
    return int((re.match(r"\s*[+-]?\d+", text) or ["0"])[0])


def _float(text: str) -> float:
    return float((re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text) or ["0"])[0])


def _parsed(spark: SparkSession, path: str, parse: Callable[[list[str]], list[tuple]], schema: str, file: bool) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, text in zip(f["file"], f["value"]):
                yield pd.DataFrame(parse(text.replace("\r\n", "\n").split("\n")), columns=names).assign(file=name)

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(run, schema + ", file string")
    return rows if file else rows.drop("file")


def _leagues(lines: list[str]) -> tuple[list[tuple], list[tuple]]:
    rest = iter(lines)
    matches, roster = [], []
    for _ in range(_int(next(rest, ""))):
        name = next(rest, "")
        roster += [(name, next(rest, "")) for _ in range(_int(next(rest, "")))]
        matches += [(name, i, next(rest, "")) for i in range(_int(next(rest, "")))]
    return matches, roster


def read_leagues(spark: SparkSession, path: str, file: bool = False) -> tuple[DataFrame, DataFrame]:
    """matches (tournament, seq, home, home_score, away_score, away) and roster (tournament, team)."""
    raw = _parsed(spark, path, lambda x: _leagues(x)[0], "tournament string, seq int, line string", file)
    more = ["file"] if file else []
    return raw.select("tournament", "seq", *parse_match(first_line(F.col("line"))), *more), _parsed(spark, path, lambda x: _leagues(x)[1], "tournament string, team string", file)


def read_points(spark: SparkSession, path: str, file: bool = False) -> DataFrame:
    """(id, x) from "N D" and N lines of D numbers."""

    def parse(lines: list[str]) -> list[tuple]:
        words = " ".join(lines).split()
        n, d = map(_int, [*words[:2], "", ""][:2])
        numbers = [_float(x) for x in words[2 : 2 + n * d]]
        numbers += [0.0] * (n * d - len(numbers))
        return [(i, numbers[i * d : (i + 1) * d]) for i in range(n)]

    return _parsed(spark, path, parse, "id long, x array<double>", file)


def read_signals(spark: SparkSession, path: str, file: bool = False) -> DataFrame:
    """One row of parameters a scenario from key-value pairs in any order, case and spacing; absent ones are 0."""

    def parse(lines: list[str]) -> list[tuple]:
        words = " ".join(lines).split()
        pairs, rows = words[1:], []
        for i in range(_int(words[0]) if words else 0):
            own = pairs[2 * len(KEYS) * i : 2 * len(KEYS) * (i + 1)]
            got = {k.lower(): v for k, v in zip(own[::2], own[1::2])}
            rows.append((i + 1, *[_int(got.get(k, "")) for k in KEYS]))
        return rows

    return _parsed(spark, path, parse, "scenario int, " + ", ".join(f"{k} int" for k in KEYS), file)


def _tours(lines: list[str]) -> tuple[list[tuple], list[tuple]]:
    rest = iter([x for x in lines if x.strip()])
    dist, nodes = [], []
    for case in range(1, _int(next(rest, "")) + 1):
        n = _int(next(rest, "")) + 1
        nodes += [(case, i, next(rest, "").strip()) for i in range(n)]
        for i in range(n):
            row = [_int(x) for x in next(rest, "").split()]
            dist += [(case, i, j, x) for j, x in enumerate([*row, *[0] * n][:n])]
    return dist, nodes


def read_tours(spark: SparkSession, path: str, file: bool = False) -> tuple[DataFrame, DataFrame]:
    """dist (case_id, src, dst, dist) and nodes (case_id, idx, name); the last node is the start."""
    return _parsed(spark, path, lambda x: _tours(x)[0], "case_id int, src int, dst int, dist int", file), _parsed(spark, path, lambda x: _tours(x)[1], "case_id int, idx int, name string", file)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """White-space tokens of any number of files, distributed."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("token")).where("token != ''")


def read_digits(spark: SparkSession, path: str) -> DataFrame:
    """(line, values) for each line of "n" and n values, in any number of files, distributed: the duplicate finder's lists."""
    words = F.split(F.trim("value"), r"[^0-9+-]+")
    numbers = F.filter(F.transform(words, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return spark.read.text(path).where("trim(value) != ''").select("value", numbers.alias("n")).select(F.col("value").alias("line"), F.slice("n", 2, F.greatest(F.size("n") - 1, F.lit(0))).alias("values"))


def _capacities(lines: list[str]) -> tuple[list[tuple], list[tuple]]:
    words = iter(map(_int, " ".join(lines).split()))
    edges, queries, scenario = [], [], 0
    while (n := next(words, 0)) | (m := next(words, 0)):
        scenario += 1
        edges += [(scenario, next(words, 0), next(words, 0), next(words, 0)) for _ in range(m)]
        queries.append((scenario, next(words, 0), next(words, 0), next(words, 0)))
    return edges, queries


def read_capacities(spark: SparkSession, path: str, file: bool = False) -> tuple[DataFrame, DataFrame]:
    """edges (scenario, u, v, cap) and queries (scenario, src, dst, tourists), up to "0 0"."""
    return _parsed(spark, path, lambda x: _capacities(x)[0], "scenario int, u int, v int, cap int", file), _parsed(spark, path, lambda x: _capacities(x)[1], "scenario int, src int, dst int, tourists int", file)
