"""Comparing an index with its sources, and reusing what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repo_name", "file_path"]


def diff(old: DataFrame, new: DataFrame, digest: str = "content_hash") -> DataFrame:
    """(repo_name, file_path, status): new, changed, unchanged or removed, for every file of either state.

    A file is the pair of repository and path; a repeated file counts with its smallest digest; null digests equal each
    other.
    """
    was = old.groupBy(*KEY).agg(F.min(digest).alias("was"), F.lit(True).alias("in_old"))
    now = new.groupBy(*KEY).agg(F.min(digest).alias("now"), F.lit(True).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    )
    return was.join(now, KEY, "full_outer").select(*KEY, status.alias("status"))


def removed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct (repo_name, file_path) recorded before and not there now."""
    return old.select(*KEY).distinct().join(new.select(*KEY), KEY, "left_anti")


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of none of the given files."""
    return rows.join(files.select(*KEY).distinct(), KEY, "left_anti")


def replace_files(rows: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows with those of the changed files taken out and the fresh ones put in."""
    return without_files(rows, changed).unionByName(fresh, allowMissingColumns=True)


def with_cache(requests: DataFrame, cache: DataFrame, key: str = "cache_key", value: str = "embedding") -> DataFrame:
    """Requests with the cached value, null on a miss, and ``cached``; repeated keys in the cache count once."""
    kept = cache.groupBy(key).agg(F.first(value, ignorenulls=True).alias(value)).withColumn("__hit", F.lit(True))
    return requests.join(kept, key, "left").withColumn("cached", F.coalesce("__hit", F.lit(False))).drop("__hit")


def hit_rate(counted: DataFrame) -> DataFrame:
    """One row: unchanged files of all present ones in percent, 0 without any."""
    present = F.count_if(F.col("status") != "removed")
    return counted.agg(F.count_if(F.col("status") == "unchanged").alias("unchanged"), present.alias("present"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == "unchanged") * 100.0, present), F.lit(0.0)), 2).alias("hit_rate"))
