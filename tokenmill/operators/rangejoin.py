"""Join points to the intervals that hold them, as an equi-join on buckets.

Spark alone would compare every point with every interval. An interval is repeated once per bucket it touches, so an
interval that covers a third of the range is spread over a third of the buckets instead of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, point: str, intervals: DataFrame, lo: str, hi: str, width: int | float | Column) -> DataFrame:
    """Rows with lo <= point < hi. Intervals must not overlap for one match per point; empty ones never match.

    A fractional `width` is for real numbers, others are for whole ones.
    """
    end = F.col(hi) if isinstance(width, float) else F.col(hi) - 1
    width = width if isinstance(width, Column) else F.lit(width)
    first, last = F.floor(F.col(lo) / width), F.floor(end / width)
    buckets = intervals.filter(F.col(hi) > F.col(lo)).withColumn("__bucket", F.explode(F.sequence(first, last)))
    keyed = points.withColumn("__bucket", F.floor(F.col(point) / width))
    joined = keyed.join(buckets, "__bucket")
    return joined.filter((F.col(lo) <= F.col(point)) & (F.col(point) < F.col(hi))).drop("__bucket")
