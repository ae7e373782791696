"""League tables: match sides are aggregated per team and ranked by six keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import leading_int

COUNTS = ("points", "games", "wins", "draws", "losses", "goal_diff", "scored", "missed")


def parse_match(line: Column) -> list[Column]:
    """home, home_score, away_score, away of "home#1@2#away": up to the first #, the first @, and from the last #."""
    part = lambda i: F.regexp_extract(line, r"^([^#]*)#([^@]*)@(.*)#([^#]*)$", i)
    return [part(1).alias("home"), leading_int(part(2)).alias("home_score"), leading_int(part(3)).alias("away_score"), part(4).alias("away")]


def sides(matches: DataFrame) -> DataFrame:
    """Two rows a match, one for each team."""
    side = lambda a, b: matches.select("tournament", F.col(a).alias("team"), F.col(f"{a}_score").alias("scored"), F.col(f"{b}_score").alias("missed"))
    return side("home", "away").unionAll(side("away", "home"))


def team_totals(matches: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """One row per tournament and team; rostered teams without games have zeros."""
    s, m = F.col("scored"), F.col("missed")
    count = lambda c: F.count_if(c).cast("int")
    total = lambda c: F.sum(c).cast("int")
    totals = sides(matches).groupBy("tournament", "team").agg(
        total(F.when(s > m, 3).when(s == m, 1).otherwise(0)).alias("points"), F.count(F.lit(1)).cast("int").alias("games"),
        count(s > m).alias("wins"), count(s == m).alias("draws"), count(s < m).alias("losses"),
        total(s - m).alias("goal_diff"), total(s).alias("scored"), total(m).alias("missed"),
    )
    if roster is None:
        return totals
    return roster.select("tournament", "team").distinct().join(totals, ["tournament", "team"], "full_outer").na.fill(0, list(COUNTS))


def league_table(matches: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """matches: tournament, home, home_score, away_score, away.  Ranks are 1 to n, none shared: points, wins,
    goal difference and scored goals descending, games ascending, then names descending, first without case."""
    order = [F.desc("points"), F.desc("wins"), F.desc("goal_diff"), F.desc("scored"), F.asc("games"), F.lower("team").desc(), F.desc("team")]
    rank = F.row_number().over(Window.partitionBy("tournament").orderBy(*order))
    return team_totals(matches, roster).select("tournament", rank.alias("rank"), "team", *COUNTS)


def table_lines(table: DataFrame) -> DataFrame:
    """The table as text, one line a team."""
    line = F.format_string("%d) %s %dp, %dg (%d-%d-%d), %dgd (%d-%d)", "rank", "team", "points", "games", "wins", "draws", "losses", "goal_diff", "scored", "missed")
    return table.select("tournament", "rank", line.alias("value"))
