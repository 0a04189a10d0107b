"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a blank around an id or a name.
BLANKS = " \t\n\r\f\u000b"


def session(app: str = "codelake", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the checkpoint folder that all executors share and go on from there.

    The folder is spark.checkpoint.dir; only a local session without one gets a folder of its own. A table tells its true
    size; a checkpoint keeps what was estimated for its rows, which every join of a loop multiplies by itself.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-codelake-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(folder)
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_measuring(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` and aggregates over its rows, for the rounds of a loop."""
    out = cut(df)
    return out, out.agg(*(column.alias(name) for name, column in measures.items())).first().asDict()


def stripped(column: str | Column) -> Column:
    """The text without surrounding blanks; null when nothing is left."""
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.btrim(column, F.lit(BLANKS)), F.lit(""))
