"""Index tables on disk: read, replace and clear as a whole, so that a failed run leaves the last state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _fs(spark, path)
    return system.exists(where)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace(*tables: tuple[DataFrame, str]) -> None:
    """Writes every table beside its old one and only then puts all in their places: plans may read the old ones, a failure changes none."""
    staged = []
    for df, path in tables:
        fresh = f"{path}.{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        staged.append((df.sparkSession, fresh, path))
    for spark, fresh, path in staged:
        system, where = _fs(spark, path)
        system.delete(where, True)
        system.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), where)
        spark.catalog.refreshByPath(path)


def clear(spark: SparkSession, path: str) -> None:
    system, where = _fs(spark, path)
    system.delete(where, True)
