"""Named queries over the shared tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clustering, league, routing, signals, tree, waits
from ..sources import generators
from ..streaming import ticks

#: departure, runtime, increment, red, green; and the report for batches of 11 cars.
SCENARIOS = [(5, 5, 10, 10, 10), (1, 10, 100, 30, 30), (10, 50, 120000, 10, 10), (2, 10, 100, 30, 30), (3, 10, 100, 30, 30), (5, 5, 10, 40000, 10), (1, 10, 100, 0, 30), (600, 10, 100, 30, 30), (4, 10, 100, 30, 30)]
REPORTS = [(18, 31, 85, 180), (6, 11, 35, 40), (5, 11, 240, 120), (7, 11, 40, 50), (12, 20, 66, 114), (33, 55, 127, 300), (1, 11, 5, 11), (55, 101, 226, 600), (22, 38, 111, 226)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a match: its supplier at home, another one away."""
    teams = read(spark, sf_dir, "supplier").count()
    team = lambda n: F.concat(F.lit("S"), n.cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("tournament"), team(F.col("l_suppkey")).alias("home"), (F.col("l_quantity").cast("int") % 7).alias("home_score"),
        F.col("l_linenumber").alias("away_score"), team(F.col("l_partkey") % teams).alias("away"),
    )


def league_table(spark, sf_dir):
    return league.league_table(matches(spark, sf_dir))


def league_full_roster(spark, sf_dir):
    teams = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") + 3).cast("string")).alias("team"))
    roster = teams.withColumn("tournament", F.explode(F.array(*map(F.lit, "ANR"))))
    return league.league_table(matches(spark, sf_dir), roster)


def league_lines(spark, sf_dir):
    return league.table_lines(league_table(spark, sf_dir)).withColumnRenamed("value", "line")


def match_parse(spark, sf_dir):
    rows = matches(spark, sf_dir)
    line = F.concat("home", F.lit("#"), F.col("home_score").cast("string"), F.lit("@"), F.col("away_score").cast("string"), F.lit("#"), "away")
    return rows.select(*league.parse_match(line))


def numeral_encode(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.encode_numeral(F.col("p_partkey") % 4500).alias("numeral"))


def numeral_decode(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.decode_numeral(S.encode_numeral(F.col("p_partkey") % 4500)).alias("value"))


def additive(n):
    """The spelling without subtraction."""
    digit = lambda unit, one, five: F.concat(F.when(F.floor(n / unit) % 10 >= 5, five).otherwise(""), F.repeat(F.lit(one), (F.floor(n / unit) % 5).cast("int")))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(100, "C", "D"), digit(10, "X", "L"), digit(1, "I", "V"))


def numeral_savings(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum(S.saved_letters(additive(F.col("p_partkey") % 4500))).alias("saved"))


def duplicate_sum(spark, sf_dir):
    surplus = F.sum("l_linenumber") - S.series_expectation(F.count(F.lit(1)))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(surplus.alias("surplus"))


def points(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def sq_distance_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    return clustering.nearest(p, clustering.first_centroids(p, 4)).select("id", "cluster", F.round("distance", 4).alias("distance"))


def cluster_means(spark, sf_dir):
    means = clustering.cluster_means(points(spark, sf_dir).withColumnRenamed("label", "cluster"))
    return means.select("cluster", "dim", F.round("mean", 5).alias("mean"), "n")


def kmeans_3_iters(spark, sf_dir):
    return clustering.kmeans(points(spark, sf_dir), 4, max_iter=3)[0].select("id", "cluster")


def kmeans_reseed(spark, sf_dir):
    p = points(spark, sf_dir)
    a, b = clustering.first_centroids(p, 2)
    _, centroids = clustering.kmeans(p, 3, max_iter=1, centroids=[a, a, b])
    rows = [(i, d, float(v)) for i, c in enumerate(centroids) for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, dim int, value double").select("cluster", "dim", F.round("value", 5).alias("value"))


def scenarios(spark):
    return spark.createDataFrame([(i + 1, 10, *x) for i, x in enumerate(SCENARIOS)], "scenario int, " + ", ".join(f"{k} int" for k in signals.KEYS))


def signal_params(spark, sf_dir):
    return signals.periods(scenarios(spark)).select("scenario", "periods", "per_minute", "gap", "served", "red", "green")


def signal_report(spark, sf_dir):
    return signals.report(scenarios(spark), F.lit(11), legacy=True)


def signal_queue(spark, sf_dir):
    timed = signals.periods(scenarios(spark))
    return signals.departures(timed, signals.arrivals(timed, F.lit(11)))


def region_roads(spark, sf_dir):
    """Each region's nations as nodes 0 to n - 1, with made-up distances."""
    from pyspark.sql import Window

    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nodes = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("case_id"), (F.row_number().over(order) - 1).alias("idx"), F.col("n_name").alias("name"), "n_nationkey")
    a, b = nodes.alias("a"), nodes.alias("b")
    pairs = a.join(b, F.col("a.case_id") == F.col("b.case_id")).where("a.idx != b.idx")
    dist = pairs.select(F.col("a.case_id").alias("case_id"), F.col("a.idx").alias("src"), F.col("b.idx").alias("dst"), ((F.col("a.n_nationkey") * 7 + F.col("b.n_nationkey") * 3) % 19 + 1).cast("int").alias("dist"))
    return dist, nodes.drop("n_nationkey")


def tsp_best_cost(spark, sf_dir):
    dist, nodes = region_roads(spark, sf_dir)
    return routing.best_tours(dist, nodes).select("case_id", "cost", F.array_join("path", ">").alias("path"))


def widest_path(spark, sf_dir):
    dist, _ = region_roads(spark, sf_dir)
    edges = dist.where("src < dst").select(F.col("case_id").alias("scenario"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist").alias("cap"))
    return routing.widest_paths(edges, edges.select("scenario", F.lit(0).alias("src")).distinct())


def tree_levels(spark, sf_dir):
    return tree.tree_segments(spark).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def tree_segments(spark, sf_dir):
    return tree.tree_segments(spark)


def worker_wait_stats(spark, sf_dir):
    return waits.gaps(read(spark, sf_dir, "events"), "user_id", "ts", "event_id")


def worker_meals(spark, sf_dir):
    """Every other event of a user as hunger, the rest as meals."""
    state = F.when(F.col("event_id") % 2 == 0, "hungry").otherwise("eating")
    return waits.wait_stats(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", state.alias("state"), "event_id"), "event_id")


def minute_ticks(spark, sf_dir):
    rows = ticks.ticks(read(spark, sf_dir, "events"))
    return rows.select(F.unix_micros("start").alias("start_us"), "n")


def gaussian_mixture(spark, sf_dir):
    return generators.gaussian_mixture(spark, 1000).select("id", "cluster", F.element_at("x", 1).alias("x0"))


def poisson_arrivals(spark, sf_dir):
    return spark.range(1000).select("id", generators.poisson(10.0, 3).alias("cars"))


def queries() -> dict:
    return {f.__name__: f for f in (
        league_table, league_full_roster, league_lines, match_parse, numeral_encode, numeral_decode, numeral_savings, duplicate_sum, sq_distance_nearest, cluster_means, kmeans_3_iters, kmeans_reseed,
        signal_params, signal_report, signal_queue, tsp_best_cost, widest_path, tree_levels, tree_segments, worker_wait_stats, worker_meals, minute_ticks, gaussian_mixture, poisson_arrivals,
    )}


_MATCHES = "m AS (SELECT l_returnflag AS t, 'S' || l_suppkey AS h, trunc(l_quantity)::INT % 7 AS a, l_linenumber AS b, 'S' || (l_partkey % (SELECT count(*) FROM supplier)) AS w FROM lineitem {where})"
_TABLE = """, s AS (SELECT t, h AS team, a AS f, b AS g FROM m UNION ALL SELECT t, w, b, a FROM m {roster}),
g AS (SELECT t AS tournament, team, coalesce(sum(CASE WHEN f > g THEN 3 WHEN f = g THEN 1 ELSE 0 END), 0)::INT AS points, count(f)::INT AS games, count(*) FILTER (f > g)::INT AS wins, count(*) FILTER (f = g)::INT AS draws,
 count(*) FILTER (f < g)::INT AS losses, coalesce(sum(f - g), 0)::INT AS goal_diff, coalesce(sum(f), 0)::INT AS scored, coalesce(sum(g), 0)::INT AS missed FROM s GROUP BY t, team),
r AS (SELECT tournament, row_number() OVER (PARTITION BY tournament ORDER BY points DESC, wins DESC, goal_diff DESC, scored DESC, games, lower(team) DESC, team DESC)::INT AS rank, team, points, games, wins, draws, losses, goal_diff, scored, missed FROM g)
"""
_LEAGUE = "WITH " + _MATCHES.format(where="") + _TABLE.format(roster="")
_DIGITS = "list_value({}) [({}) % 10 + 1]"
_ENCODE = "repeat('M', (p_partkey % 4500 // 1000)::INT) || " + " || ".join(_DIGITS.format(", ".join(f"'{x}'" for x in names), f"p_partkey % 4500 // {unit}") for names, unit in ((S.HUNDREDS, 100), (S.TENS, 10), (S.ONES, 1)))
_POINTS = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _assign(name: str, centroids: str) -> str:
    return f"{name} AS (SELECT id, x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT p.id, p.x, c.cluster, {_SQ.format(a='p.x', b='c.x')} AS d FROM p, {centroids} c) GROUP BY id, x)"


def _means(name: str, assigned: str) -> str:
    return f"{name} AS (SELECT cluster, list(v ORDER BY dim) AS x FROM (SELECT cluster, dim, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {assigned}) GROUP BY cluster, dim) GROUP BY cluster)"


_FIRST = "c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster, x FROM (SELECT id, x FROM p ORDER BY id LIMIT 4))"
_ROADS = """n AS (SELECT n_regionkey AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_name AS name, n_nationkey AS k FROM nation),
d AS (SELECT a.c, a.i AS s, b.i AS e, (a.k * 7 + b.k * 3) % 19 + 1 AS d FROM n a JOIN n b ON a.c = b.c AND a.i <> b.i)"""


def oracle_sql() -> dict[str, str]:
    values = lambda rows: ", ".join(f"({i + 1}, {', '.join(map(str, x))})" for i, x in enumerate(rows))
    return {
        "league_table": _LEAGUE + "SELECT * FROM r",
        "league_full_roster": "WITH " + _MATCHES.format(where="") + _TABLE.format(roster="UNION ALL SELECT t, 'S' || (s_suppkey + 3), NULL, NULL FROM supplier, (VALUES ('A'), ('N'), ('R')) v(t)") + "SELECT * FROM r",
        "league_lines": _LEAGUE + "SELECT tournament, rank, printf('%d) %s %dp, %dg (%d-%d-%d), %dgd (%d-%d)', rank, team, points, games, wins, draws, losses, goal_diff, scored, missed) AS line FROM r",
        "match_parse": "WITH " + _MATCHES.format(where="") + " SELECT h AS home, a AS home_score, b AS away_score, w AS away FROM m",
        "numeral_encode": f"SELECT p_partkey, {_ENCODE} AS numeral FROM part",
        "numeral_decode": "SELECT p_partkey, (p_partkey % 4500)::INT AS value FROM part",
        "numeral_savings": "SELECT p_brand, sum(" + " + ".join(f"list_value(0, 0, 0, 0, 2, 0, 0, 0, 0, 3)[(p_partkey % 4500 // {u}) % 10 + 1]" for u in (1, 10, 100)) + ")::BIGINT AS saved FROM part GROUP BY p_brand",
        "duplicate_sum": "SELECT l_orderkey, (sum(l_linenumber) - (count(*) - 2) * (count(*) - 1) // 2)::BIGINT AS surplus FROM lineitem GROUP BY l_orderkey",
        "sq_distance_nearest": f"WITH {_POINTS}, {_FIRST}, {_assign('a1', 'c0')} SELECT id, cluster, round(d, 4) AS distance FROM a1",
        "cluster_means": "SELECT label AS cluster, (dim - 1)::INT AS dim, round(avg(v), 5) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim",
        "kmeans_3_iters": f"WITH {_POINTS}, {_FIRST}, {_assign('a1', 'c0')}, {_means('c1', 'a1')}, {_assign('a2', 'c1')}, {_means('c2', 'a2')}, {_assign('a3', 'c2')}, {_means('c3', 'a3')}, {_assign('a4', 'c3')} SELECT id, cluster FROM a4",
        "signal_params": f"SELECT scenario, r * 60000 // i AS periods, 60000 // i AS per_minute, greatest(d * 1000 // i, 1) AS gap, greatest(i // d // 1000, 1) AS served, greatest(red * 1000 // i, 1) AS red, greatest(green * 1000 // i, 1) AS green FROM (SELECT scenario, d::BIGINT d, r::BIGINT r, i::BIGINT i, red::BIGINT red, green::BIGINT green FROM (VALUES {values(SCENARIOS)}) v(scenario, d, r, i, red, green))",
        "signal_report": f"SELECT scenario, a::BIGINT AS avg_len, b::BIGINT AS max_len, c::BIGINT AS avg_wait_s, d::BIGINT AS max_wait_s FROM (VALUES {values(REPORTS)}) v(scenario, a, b, c, d)",
        "tsp_best_cost": f"WITH RECURSIVE {_ROADS}, z AS (SELECT c, max(i) AS h FROM n GROUP BY c), t AS (SELECT c, h, h AS spot, 0::BIGINT AS cost, [h] AS p FROM z UNION ALL SELECT t.c, h, e, cost + d, list_append(p, e) FROM t JOIN d ON t.c = d.c AND s = spot WHERE (e <> h AND NOT list_contains(p, e)) OR (e = h AND len(p) = h + 1)), b AS (SELECT c, min((cost, p)) AS m FROM t WHERE len(p) = h + 2 GROUP BY c) SELECT b.c AS case_id, (m[1])::BIGINT AS cost, (SELECT string_agg(name, '>' ORDER BY o) FROM (SELECT unnest(m[2]) AS i, generate_subscripts(m[2], 1) AS o) u JOIN n ON n.i = u.i AND n.c = b.c) AS path FROM b",
        "widest_path": f"WITH RECURSIVE {_ROADS}, e AS (SELECT c, s, e, d FROM d WHERE s < e UNION ALL SELECT c, e, s, d FROM d WHERE s < e), t AS (SELECT c, 0::BIGINT AS spot, 2147483647::BIGINT AS w, [0::BIGINT] AS p FROM (SELECT DISTINCT c FROM n) UNION ALL SELECT t.c, e.e, least(w, e.d), list_append(p, e.e) FROM t JOIN e ON t.c = e.c AND e.s = spot WHERE NOT list_contains(p, e.e)) SELECT c AS scenario, 0 AS src, spot::INT AS dst, max(w)::INT AS width FROM t WHERE spot <> 0 GROUP BY c, spot",
        "tree_levels": "SELECT level::INT AS level, (1 << level)::BIGINT AS n FROM generate_series(0, 14) g(level)",
        "worker_wait_stats": "SELECT user_id, count(*) AS n, coalesce(sum(g), 0)::BIGINT AS total_gap_us, coalesce(max(g), 0)::BIGINT AS max_gap_us FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id",
        "worker_meals": "SELECT user_id AS id, count(*) FILTER (s = 1) AS meals, coalesce(sum(t - b) FILTER (s = 1 AND q = 0), 0)::BIGINT AS wait_us FROM (SELECT user_id, event_id % 2 AS s, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS b, lag(event_id % 2) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id",
        "kmeans_reseed": f"WITH {_POINTS}, ab AS (SELECT first(x ORDER BY id) AS a, list(x ORDER BY id)[2] AS b FROM (SELECT id, x FROM p ORDER BY id LIMIT 2)), g AS (SELECT CASE WHEN {_SQ.format(a='x', b='a')} <= {_SQ.format(a='x', b='b')} THEN 0 ELSE 2 END AS cluster, x FROM p, ab), v AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM g), s AS (SELECT unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) - 1 AS dim FROM ab) SELECT cluster::INT AS cluster, dim::INT AS dim, round(avg(v), 5) AS value FROM v GROUP BY cluster, dim UNION ALL SELECT 1, dim::INT, round((2 * a + b) / 3, 5) FROM s",
        "tree_segments": "WITH RECURSIVE t AS (SELECT 0 AS level, 0::BIGINT AS branch, 320 AS x0, 511 AS y0, 320 AS x1, 381 AS y1, 0.0::DOUBLE AS a, 130.0::DOUBLE AS size UNION ALL SELECT level + 1, branch * 2 + b, x1, y1, x1 + trunc(round(-trunc(size * 0.75::DOUBLE) * sin(radians(a + (1 - 2 * b) * 24.0::DOUBLE)), 9))::INT, y1 - trunc(round(trunc(size * 0.75::DOUBLE) * cos(radians(a + (1 - 2 * b) * 24.0::DOUBLE)), 9))::INT, a + (1 - 2 * b) * 24.0::DOUBLE, size * 0.75::DOUBLE FROM t, (VALUES (0), (1)) v(b) WHERE size * 0.75::DOUBLE >= 2) SELECT level, branch, x0, y0, x1, y1 FROM t",
        "minute_ticks": "SELECT epoch_us(date_trunc('minute', ts)) AS start_us, count(*) AS n FROM events GROUP BY 1",
    }
