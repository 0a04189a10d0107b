"""Running sums whose groups may be larger than a task should hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come earlier.

    Rows are ordered by ``bucket`` first and ``order`` within it. A hot group is spread over its buckets: their sums are taken with
    map-side combine, only these few sums run through a window of the whole key, and the rows run through windows of
    one bucket each. Nulls in value count as 0. Rows with equal order within a key are undefined among themselves, so
    ``order`` should end in a unique column.
    """
    df = df.withColumn("__bucket", bucket)
    by_key = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        df.groupBy(*keys, "__bucket")
        .agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__sum"))
        .withColumn("__offset", F.coalesce(F.sum("__sum").over(by_key), F.lit(0)))
        .drop("__sum")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0))
    return df.join(sums, [*keys, "__bucket"]).withColumn(out, F.col("__offset") + within).drop("__bucket", "__offset")
