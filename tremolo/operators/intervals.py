"""Range join of places with intervals of the same clip, in the long layout.

Intervals are put in every bucket of width places that they touch, so the join is an equi-join on clip
and bucket with the exact bounds as a residual: a task has the places of some buckets of a clip, never
the product of a clip's places and intervals. Buckets as wide as a usual interval give each about
two rows; any width gives the same result.

Null bounds and empty intervals hold no place; a place in several intervals comes once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(place: Column, width: int) -> Column:
    return F.floor(place / F.lit(width)).cast("long")


def range_join(places: DataFrame, intervals: DataFrame, width: int, how: str = "inner", place: str = "i") -> DataFrame:
    """places(clip_id, i, ...) with each of intervals(clip_id, start, stop, ...) that has start <= i < stop.

    how: inner, left, left_semi or left_anti.
    """
    if width < 1:
        raise ValueError("buckets must be at least one place wide")
    some = intervals.where(F.col("start") < F.col("stop"))
    some = some.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("start"), width), _bucket(F.col("stop") - 1, width))))
    some = some.withColumnRenamed("clip_id", "_clip")
    near = places.withColumn("_at", _bucket(F.col(place), width))
    inside = (F.col("clip_id") == F.col("_clip")) & (F.col("_at") == F.col("_bucket")) & (F.col(place) >= F.col("start")) & (F.col(place) < F.col("stop"))
    return near.join(some, inside, how).drop("_at", "_bucket", "_clip")


def overlaps(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Pairs of left(low, high, ...) and right(from, to, ...) that overlap, with the length that they share in overlap.

    A pair that shares several buckets is found in the first of them alone.
    """
    first = lambda a: F.floor(F.col(a) / F.lit(width)).cast("long")
    a = left.where("low < high").withColumn("_bucket", F.explode(F.sequence(first("low"), first("high"))))
    b = right.where("`from` < `to`").withColumn("_there", F.explode(F.sequence(first("from"), first("to"))))
    both = a.join(b, (F.col("_bucket") == F.col("_there")) & (F.col("low") < F.col("to")) & (F.col("from") < F.col("high")))
    both = both.where(F.col("_bucket") == F.greatest(first("low"), first("from")))
    return both.withColumn("overlap", F.least("high", "to") - F.greatest("low", "from")).drop("_bucket", "_there")
