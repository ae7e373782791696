import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loamspark.functions import scalars as S
from loamspark.operators import clustering, league, routing, signals, waits
from loamspark.plans import registry
from loamspark.sources import blocks, generators, sinks
from loamspark.streaming import ticks

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for _, v in sorted(row.items()))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(registry.oracle_sql()[name])
    want = sorted(key(dict(zip(want.columns, r))) for r in want.fetchall())
    assert sorted(key(r.asDict()) for r in registry.queries()[name](spark, SF).collect()) == want


def test_league_ties_and_roster(spark):
    rows = [("t", *x) for x in [("A", 3, 2, "B"), ("C", 1, 2, "B"), ("A", 3, 5, "C")]]
    got = league.league_table(spark.createDataFrame(rows, "tournament string, home string, home_score int, away_score int, away string"), spark.createDataFrame([("t", "Z"), ("t", "abc"), ("t", "ABC")], "tournament string, team string"))
    assert [r.team for r in got.orderBy("rank").collect()] == ["C", "B", "A", "Z", "abc", "ABC"]
    assert league.table_lines(got).where("rank = 1").first().value == "1) C 3p, 2g (1-0-1), 1gd (6-5)"


def test_numerals(spark):
    cases = {"IIII": 4, "VIIII": 9, "XXXX": 40, "MMMM": 4000, "IC": 99, "IXC": 109, "": 0, "ABC": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.decode_numeral(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == cases
    spelled = {0: "", 1: "I", 4: "IV", 9: "IX", 40: "XL", 90: "XC", 400: "CD", 900: "CM", 3999: "MMMCMXCIX", 4000: "MMMM"}
    got = spark.createDataFrame([(k,) for k in spelled], "n int").select("n", S.encode_numeral(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == spelled


def test_scalars(spark):
    row = spark.createDataFrame([("12abc", "x", [0, 1, 2, 3, 0], [10, 11, 0])], "a string, b string, v array<int>, w array<int>").select(
        S.leading_int(F.col("a")), S.leading_int(F.col("b")), S.leading_double(F.lit("-1.5e1z")), S.repeated_value(F.col("v")), S.mean_of_three(F.array(F.lit(0.0)), F.array(F.lit(3.0)), F.array(F.lit(6.0)))
    )
    assert tuple(row.first()) == (12, 0, -15.0, 0, [3.0])


def test_kmeans_edges(spark):
    p = spark.createDataFrame([(i, [float(i // 2)]) for i in range(6)], "id long, x array<double>")
    for k in (1, 3, 5):
        labels, centroids = clustering.kmeans(p, k)
        assert labels.count() == 6 and len(centroids) == min(k, 6)
    tie = clustering.nearest(spark.createDataFrame([(1, [1.0])], "id long, x array<double>"), [[0.0], [2.0]]).first()
    assert tie.cluster == 0
    assert clustering.kmeans(p.limit(0), 2)[0].count() == 0


def test_signal_zero_divisors(spark):
    rows = [(1, 0, 5, 5, 10, 10, 10), (2, 10, 0, 5, 10, 10, 10), (3, 10, 5, 5, 0, 10, 10)]
    got = {r.scenario: r for r in signals.report(spark.createDataFrame(rows, "scenario int, " + ", ".join(f"{k} int" for k in signals.KEYS))).collect()}
    assert set(got) == {1, 2, 3} and got[1].avg_wait_s is None and got[3].avg_len is None


def test_tours_and_routes(spark, tmp_path):
    text = "1\n4\na\nb\nc\nd\ncar\n 0 30 100 50 120\n30 0 100 80 60\n100 110 0 30 60\n50 80 40 0 60\n120 60 90 70 0\n"
    (tmp_path / "t.txt").write_text(text)
    dist, nodes = blocks.read_tours(spark, str(tmp_path / "t.txt"))
    best = routing.best_tours(dist, nodes).first()
    assert best.cost == 240 and best.path[0] == best.path[-1] == "car"
    assert "240" in sinks.tour_lines(routing.best_tours(dist, nodes)).first().value
    one = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 0, 4), (1, 0, 0, 0), (1, 1, 1, 0)], "case_id int, src int, dst int, dist int")
    assert routing.best_tours(one).first().cost == 7
    edges = spark.createDataFrame([(1, 1, 2, 30), (1, 2, 3, 10), (1, 1, 3, 5)], "scenario int, u int, v int, cap int")
    q = spark.createDataFrame([(1, 1, 3, 99), (1, 1, 1, 2)], "scenario int, src int, dst int, tourists int")
    assert {r.dst: r.trips for r in routing.trips(routing.widest_paths(edges, q.select("scenario", "src").distinct()), q).collect()} == {3: 11, 1: 0}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "l").write_text("1\nCup\n2\nA\nB c\n2\nA#3@2#B c\nA#x@2#B c\n")
    m, roster = blocks.read_leagues(spark, str(tmp_path / "l"))
    assert [(r.home, r.home_score, r.away_score, r.away) for r in m.orderBy("seq").collect()] == [("A", 3, 2, "B c"), ("A", 0, 2, "B c")] and roster.count() == 2
    (tmp_path / "p").write_text("2 2\n1 2\n3 4.5\n")
    assert blocks.read_points(spark, str(tmp_path / "p")).orderBy("id").collect()[1].x == [3.0, 4.5]
    (tmp_path / "s").write_text("1\nRED 1\ngreen 2 Runtime 3\nincrement 4 ARRIVAL 5 departure 6\n")
    assert tuple(blocks.read_signals(spark, str(tmp_path / "s")).first()) == (1, 5, 6, 3, 4, 1, 2)
    (tmp_path / "c").write_text("2 1\n1 2 9\n1 2 5\n0 0\n")
    e, q = blocks.read_capacities(spark, str(tmp_path / "c"))
    assert tuple(e.first()) == (1, 1, 2, 9) and tuple(q.first()) == (1, 1, 2, 5)
    (tmp_path / "more").mkdir()
    for name, text in (("a", "2 2\n1 x\n3abc -2e1\n"), ("b", "1 1\n7\n"), ("c", "")):
        (tmp_path / "more" / name).write_text(text)
    got = blocks.read_points(spark, str(tmp_path / "more"), file=True).collect()
    assert sorted((r.file[-1], r.id, r.x) for r in got) == [("a", 0, [1.0, 0.0]), ("a", 1, [3.0, -20.0]), ("b", 0, [7.0])]
    sinks.write_points(blocks.read_points(spark, str(tmp_path / "p")), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["2 2", "1.0 2.0", "3.0 4.5"]
    (tmp_path / "d").write_text("5 0 1 2 2 3\n")
    assert blocks.read_digits(spark, str(tmp_path / "d")).select(S.repeated_value(F.col("values"))).first()[0] == 2
    (tmp_path / "n").write_text("IV  X\n\nM\n")
    assert blocks.read_tokens(spark, str(tmp_path / "n")).count() == 3
    picture = sinks.bitmap(spark.createDataFrame([(0, 0, 5, 5)], "x0 int, y0 int, x1 int, y1 int"), 8, 8)
    assert picture[:2] == b"BM" and len(picture) == 54 + 256


def test_generators(spark):
    rows = generators.gaussian_mixture(spark, 4000).collect()
    assert 0.15 < sum(r.cluster is None for r in rows) / 4000 < 0.25
    assert abs(spark.range(4000).select(generators.poisson(10.0, 3).alias("k")).agg(F.avg("k")).first()[0] - 10) < 0.5


def test_waits(spark):
    rows = [(1, "2020-01-01 00:00:00", "hungry"), (1, "2020-01-01 00:00:02", "eating"), (1, "2020-01-01 00:00:03", "thinking")]
    got = waits.wait_stats(spark.createDataFrame(rows, "id int, ts string, state string")).first()
    assert (got.meals, got.wait_us) == (1, 2_000_000)
    same = [(1, "2020-01-01 00:00:00", s) for s in ("eating", "hungry")]
    assert waits.wait_stats(spark.createDataFrame(same, "id int, ts string, state string")).first().wait_us == 0


def test_tree_ends(spark):
    got = {(r.level, r.branch): r for r in registry.tree_segments(spark, SF).where("level < 2").collect()}
    assert (got[0, 0].x1, got[0, 0].y1) == (320, 381)
    assert (got[1, 0].x1, got[1, 0].y1) == (281, 293) and (got[1, 1].x1, got[1, 1].y1) == (359, 293)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3, 3), (1, 1, 2), (1, 2, -5)], "scenario int, seq int, delta long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ticks.queue_lengths(source).writeStream.outputMode("update").format("memory").queryName("lengths").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT length FROM lengths").collect()[-1].length == 3
    events = spark.createDataFrame([("2020-01-01 00:00:01",), ("2020-01-01 00:00:59",), ("2020-01-01 00:01:00",)], "ts string")
    assert sorted(r.n for r in ticks.ticks(events).collect()) == [1, 2]


def test_widest_paths_fail_at_the_bound(spark):
    edges = spark.createDataFrame([(1, i, i + 1, 9) for i in range(5)], "scenario int, u int, v int, cap int")
    starts = spark.createDataFrame([(1, 0)], "scenario int, src int")
    with pytest.raises(ValueError):
        routing.widest_paths(edges, starts, max_steps=3).collect()
    assert routing.widest_paths(edges, starts, max_steps=7).count() == 5
