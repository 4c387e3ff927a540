"""Overlapping intervals by an equi-join.

The line is cut into segments of about `SEGMENT` interval starts. Of two closed intervals
that overlap, the later start lies in the other, so each pair is found once, in the
segment of its later start: there, those that start in a segment meet those that cover
part of it. An interval that covers many segments overlaps all that start in them, so
copies and candidates follow the result: at most some `SEGMENT` pairs are looked at in vain
for either end of an interval.

Places on the line come from counts by distinct value, summed up range by range, so
values that many intervals share cost no more than one.

Defined results: nulls and intervals whose end lies before its start overlap nothing;
rows that repeat a key overlap others each for itself and never each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

SEGMENT = 1024
#: Ranges of the line that are summed up side by side.
RANGES = 256


def _starts_before(points: DataFrame, cuts: list) -> DataFrame:
    """(value, starts) by distinct value -> value, and how many starts lie before it and up to it."""
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("value"))) if cuts else F.lit(0)
    points = points.withColumn("range", place)
    up_to = lambda window: window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = points.groupBy("range").agg(F.sum("starts").alias("all"))
    sums = sums.select("range", (F.sum("all").over(up_to(Window.orderBy("range"))) - F.col("all")).alias("before"))  # a row per range
    own = F.sum("starts").over(up_to(Window.partitionBy("range").orderBy("value")))
    return points.withColumn("own", own).join(sums, "range").select("value", (F.col("before") + F.col("own") - F.col("starts")).alias("before"), (F.col("before") + F.col("own")).alias("up_to"))


def overlapping(rows: DataFrame, key: str = "backend", lo: str = "lo", hi: str = "hi", size: int = SEGMENT) -> DataFrame:
    """Pairs of keys whose closed intervals overlap: `key` and the greater `other`."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/intervals-{uuid.uuid4().hex}"
    rows.select(F.col(key).alias("key"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).where("key is not null and lo <= hi").write.parquet(folder)
    held = spark.read.parquet(folder)
    cuts = held.select(F.percentile_approx("lo", [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    points = held.select(F.col("lo").alias("value"), F.lit(1).alias("starts")).union(held.select("hi", F.lit(0))).groupBy("value").agg(F.sum("starts").alias("starts"))
    placed = _starts_before(points, sorted(set(cuts)))
    segment = lambda n: F.floor(n / size)
    first = placed.select(F.col("value").alias("lo"), segment(F.col("before")).alias("first"))
    last = placed.select(F.col("value").alias("hi"), segment(F.col("up_to") - 1).alias("last"))
    cut = held.join(first, "lo").join(last, "hi")
    starting = cut.select(F.col("first").alias("segment"), "key", "lo")
    covering = cut.select(F.explode(F.sequence("first", "last")).alias("segment"), F.col("key").alias("key2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    earlier = (F.col("lo2") < F.col("lo")) | ((F.col("lo2") == F.col("lo")) & (F.col("key2") < F.col("key")))
    pairs = starting.join(covering, "segment").where(earlier & (F.col("lo") <= F.col("hi2")) & (F.col("key") != F.col("key2")))
    return pairs.select(F.least("key", "key2").alias(key), F.greatest("key", "key2").alias("other"))
