"""Order statistics of groups of any size: exact values at given places, by counting in ever narrower ranges.

No task holds a group's values, sorted or not. Each round cuts the range that a place lies in into BUCKETS and counts (partial sums in each task), then goes on
in the bucket that has the place; a bucket knows its smallest and largest value, so a place is found when these are equal. Each
round divides the range by BUCKETS, so a few rounds do for any table; ties are one value however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, settled

BUCKETS = 4096


def _bucket() -> Column:
    """The bucket of value between low and high: 0 for low, the last one for high; halves where the range is beyond a double's."""
    span = F.col("high") - F.col("low")
    share = F.when(F.abs(span) < float("inf"), (F.col("value") - F.col("low")) / span).otherwise((F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
    return F.when(F.col("value") >= F.col("high"), BUCKETS).otherwise(F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))).cast("int")


def selected(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by and, for each name, the value at a place of the group in ascending order: a Column of n (values of the group), from 1.

    Null values don't count; NaN is the largest value. A place below 1 or above n has no value (null). Rounds go on while a place is open.
    """
    key = [f"_by{i}" for i in range(len(by))]
    # a null key is a group of its own: joined as a struct that is never null
    grouped = rows.select(*(F.col(b).alias(k) for b, k in zip(by, key, strict=True)), F.col(value).cast("double").alias("value")).where("value IS NOT NULL")
    table = settled(grouped.withColumn("group", F.struct(*(F.col(k) for k in key)) if key else F.struct(F.lit(0).alias("_by0"))).drop(*key))
    real = table.where("NOT isnan(value)")
    ranges = table.groupBy("group").agg(F.count("*").alias("n")).join(real.groupBy("group").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("reals")), "group", "left")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("place"), column.cast("long").alias("at")) for name, column in places.items())))
    open_ = settled(ranges.select("group", "n", "low", "high", F.coalesce("reals", F.lit(0)).alias("reals"), each.alias("p")).select("group", "n", "low", "high", "reals", "p.place", F.col("p.at").alias("at")))
    nan = F.when((F.col("at") > F.col("reals")) & (F.col("at") <= F.col("n")), F.lit(float("nan")))
    done = [open_.where("at < 1 OR at > reals").select("group", "place", nan.alias("found"))]
    open_ = open_.where("at BETWEEN 1 AND reals").select("group", "place", "at", "low", "high")
    while True:
        done.append(open_.where("low = high").select("group", "place", F.col("low").alias("found")))
        open_ = settled(open_.where("low < high"))
        if open_.isEmpty():
            break
        met = real.join(bounded(open_), "group").where("value BETWEEN low AND high")
        counted = met.withColumn("bucket", _bucket()).groupBy("group", "place", "at", "bucket").agg(F.count("*").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("group", "place").orderBy("bucket")))  # BUCKETS + 1 rows at most
        open_ = settled(upto.where("at > upto - c AND at <= upto").select("group", "place", (F.col("at") - F.col("upto") + F.col("c")).alias("at"), "low", "high"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    wide = found.groupBy("group").agg(*(F.max(F.when(F.col("place") == name, F.col("found"))).alias(name) for name in places))
    return wide.select(*(F.col(f"group.{k}").alias(b) for b, k in zip(by, key, strict=True)), *places)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the group's value at a share: the interpolated median for one half, else the value at the nearest rank."""
    n, places = F.col("n"), {}
    for name, share in shares.items():
        if share == 0.5:
            places |= {f"_{name}_lower": F.floor((n + 1) / 2), f"_{name}_upper": F.floor(n / 2) + 1}
        else:
            places[name] = F.greatest(F.lit(1), F.ceil(n * share))
    out = selected(rows, by, value, places)
    mean = lambda name: (F.col(f"_{name}_lower") + F.col(f"_{name}_upper")) / 2
    return out.select(*by, *((mean(name) if share == 0.5 else F.col(name)).alias(name) for name, share in shares.items()))


def approximate(value: str, shares: list[float], accuracy: int = 10_000) -> Column:
    """The values at shares by a mergeable sketch in one pass, each at most n / accuracy places off."""
    return F.percentile_approx(value, shares, accuracy)
