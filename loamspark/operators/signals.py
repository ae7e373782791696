"""A queue at a traffic light in closed form: no clock, but arrivals, service slots and one running maximum.

Cars are numbered in order of arrival, units of service in order of their slots.  If f(n) units lie before
car n's arrival, car n gets unit n + max over m <= n of (f(m) - m).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("arrival", "departure", "runtime", "increment", "red", "green")


def _div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)"))).cast("long")


def periods(scenarios: DataFrame) -> DataFrame:
    """Parameters in increments; null where a divisor is 0."""
    inc, at_least = F.col("increment"), lambda c: F.greatest(c, F.when(c.isNotNull(), F.lit(1).cast("long")))
    in_units = lambda name: at_least(_div(F.col(name) * F.lit(1000).cast("long"), inc))
    return scenarios.select(
        "scenario", "arrival", inc.cast("long").alias("increment"), _div(F.col("runtime") * F.lit(60000).cast("long"), inc).alias("periods"), _div(F.lit(60000), inc).alias("per_minute"),
        in_units("departure").alias("gap"), at_least(_div(_div(inc, F.col("departure")), F.lit(1000))).alias("served"), in_units("red").alias("red"), in_units("green").alias("green"),
    )


def arrivals(timed: DataFrame, cars: Column | None = None) -> DataFrame:
    """(scenario, k, cars): a batch each minute, or the one at the start if an increment is longer."""
    last = F.when(F.col("per_minute") > 0, F.col("periods") - 1).otherwise(0)
    ticks = F.when(F.col("periods") > 0, F.sequence(F.lit(0).cast("long"), last, F.greatest("per_minute", F.lit(1).cast("long"))))
    return timed.select("scenario", F.explode(ticks).alias("k"), (F.col("arrival") if cars is None else cars).cast("int").alias("cars"))


def slots(timed: DataFrame) -> DataFrame:
    """(scenario, k): a green's first period, then after gap + 1 more, then every gap, while it is green."""
    cycle = F.col("red") + F.col("green")
    starts = F.when(F.col("periods") > F.col("red"), F.sequence(F.col("red"), F.col("periods") - 1, cycle))
    rows = timed.where("gap IS NOT NULL AND served IS NOT NULL").withColumn("start", F.explode(starts))
    more = F.when(F.col("gap") + 1 <= F.col("green") - 1, F.sequence(F.col("start") + F.col("gap") + 1, F.col("start") + F.col("green") - 1, F.col("gap")))
    return rows.select("scenario", "periods", F.explode(F.concat(F.array("start"), F.coalesce(more, F.array().cast("array<bigint>")))).alias("k")).where("k < periods").select("scenario", "k")


def departures(timed: DataFrame, batches: DataFrame) -> DataFrame:
    """(scenario, car, arrived, left): left is null for cars that still wait at the end."""
    facts = timed.select("scenario", "served")
    events = batches.select("scenario", "k", "cars", F.lit(0).alias("kind")).unionByName(slots(timed).select("scenario", "k", F.lit(0).alias("cars"), F.lit(1).alias("kind")))
    order = Window.partitionBy("scenario").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    events = events.withColumns({"slot": earlier("kind"), "first": earlier("cars")}).join(facts, "scenario")
    cars = events.where("kind = 0 AND cars > 0").withColumn("car", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cars") - 1)))
    ahead = F.max(F.col("slot") * F.col("served") - F.col("car")).over(Window.partitionBy("scenario").orderBy("car").rowsBetween(Window.unboundedPreceding, 0))
    unit = cars.select("scenario", "car", F.col("k").alias("arrived"), _div(F.col("car") + ahead, F.col("served")).alias("slot"))
    return unit.join(events.where("kind = 1").select("scenario", "slot", F.col("k").alias("left")), ["scenario", "slot"], "left").select("scenario", "car", "arrived", "left")


def report(scenarios: DataFrame, cars: Column | None = None, legacy: bool = False) -> DataFrame:
    """(scenario, avg_len, max_len, avg_wait_s, max_wait_s).  ``legacy``: only half of the cars that still wait
    count in the wait, an average length of 0 becomes half the longest, and waits that are all equal are
    shown by other units.  Metrics without cars or with a zero divisor are null."""
    timed = periods(scenarios)
    batches = arrivals(timed, cars)
    fate = departures(timed, batches).join(timed.select("scenario", "periods", "increment"), "scenario")
    stay = F.when(F.col("left").isNull(), F.col("periods") - F.col("arrived")).otherwise(F.col("left") - F.col("arrived") + 1)
    wait = F.coalesce("left", "periods") - F.col("arrived")
    over = F.col("left").isNull()
    rank = F.row_number().over(Window.partitionBy("scenario", over).orderBy("car"))
    counted = ~over | (2 * rank <= F.sum(over.cast("int")).over(Window.partitionBy("scenario")) + 1) if legacy else F.lit(True)
    length = F.count(F.lit(1)).over(Window.partitionBy("scenario").orderBy("arrived").rangeBetween(Window.unboundedPreceding, 0))
    per_car = fate.select("scenario", "periods", "increment", "arrived", "left", stay.alias("stay"), wait.alias("wait"), counted.alias("counted"), length.alias("so_far"))
    gone = per_car.where("left IS NOT NULL").select("scenario", (F.col("left") + 1).alias("k"), F.lit(-1).alias("step")).unionByName(per_car.select("scenario", F.col("arrived").alias("k"), F.lit(1).alias("step")))
    steps = gone.groupBy("scenario", "k").agg(F.sum("step").alias("step"))
    longest = steps.withColumn("len", F.sum("step").over(Window.partitionBy("scenario").orderBy("k"))).groupBy("scenario").agg(F.max("len").alias("max_len"))
    t = per_car.groupBy("scenario").agg(F.first("periods").alias("periods"), F.first("increment").alias("inc"), F.sum("stay").alias("stay"), F.sum(F.when(F.col("counted"), F.col("wait"))).alias("wait"), F.max(F.when(F.col("counted"), F.col("wait"))).alias("max_wait"), F.count(F.lit(1)).alias("cars"))
    t = timed.select("scenario").join(t.join(longest, "scenario"), "scenario", "left")
    avg_len, inc, w, n = _div(F.col("stay"), F.col("periods")), F.col("inc"), F.col("wait"), F.col("cars")
    avg_wait, max_wait = _div(w * inc, n * 1000), _div(F.col("max_wait") * inc, F.lit(1000))
    if legacy:
        avg_len = F.when(avg_len == 0, _div(F.col("max_len"), F.lit(2))).otherwise(avg_len)
        equal = _div(w, n) == F.col("max_wait")
        max_wait = F.when(equal, avg_wait).otherwise(max_wait)
        avg_wait = F.when(equal, _div(w * inc, n * 500)).otherwise(avg_wait)
    return t.select("scenario", avg_len.alias("avg_len"), F.col("max_len").cast("long").alias("max_len"), avg_wait.alias("avg_wait_s"), max_wait.alias("max_wait_s"))
