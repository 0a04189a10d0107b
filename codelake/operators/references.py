"""References to records that do not exist (problem 1).

Signed counts: every life of a record adds +1 to its key when it begins and -1 when it ends, every reference adds +1 to
the key's reference count. A reference is an orphan when the existence count of its key is zero at the reference's own
time; a key is an orphan now when its reference count is positive and its existence count is zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.session import stripped

EXTERNAL = "external_"


def record_key(column: str | Column) -> Column:
    """Comparable form of an id: no surrounding blanks; letter case kept only behind ``external_``; blank gives null."""
    key = stripped(column)
    return F.when(key.startswith(EXTERNAL), key).otherwise(F.lower(key))


def relationship_references(relationships: DataFrame) -> DataFrame:
    """(table_name, row_id, kind, key, t): to a chunk by target_id, else to an external node by target_name, else dropped."""
    by_id = record_key("target_id")
    name = stripped("target_name")
    return relationships.select(
        F.lit("relationships").alias("table_name"),
        F.col("rel_id").alias("row_id"),
        F.when(by_id.isNotNull(), F.lit("chunk")).otherwise(F.lit("node")).alias("kind"),
        F.coalesce(by_id, F.concat(F.lit(EXTERNAL), name)).alias("key"),
        F.col("extracted_at").alias("t"),
    ).where(F.col("key").isNotNull())


def edge_references(edges: DataFrame) -> DataFrame:
    """(table_name, row_id, kind, key, t) of graph edges; a blank target_id refers to nothing and is dropped."""
    return edges.select(
        F.lit("edges").alias("table_name"),
        F.col("edge_id").alias("row_id"),
        F.lit("node").alias("kind"),
        record_key("target_id").alias("key"),
        F.col("created_at").alias("t"),
    ).where(F.col("key").isNotNull())


def lives(records: DataFrame, kind: str, start: str) -> DataFrame:
    """(kind, key, start, end), one row per life. A life without a start, or that ends when or before it starts, never was."""
    return records.select(F.lit(kind).alias("kind"), record_key("id").alias("key"), F.col(start).alias("start"), F.col("deleted_at").alias("end")).where(
        "key is not null and start is not null and (end is null or end > start)"
    )


def existence_deltas(existing: DataFrame) -> DataFrame:
    """(kind, key, t, delta): +1 where a life starts, -1 where it ends, summed per instant."""
    steps = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))
    return (
        existing.select("kind", "key", F.explode(steps).alias("s"))
        .where("s.t is not null")
        .groupBy("kind", "key", F.col("s.t").alias("t"))
        .agg(F.sum("s.d").alias("delta"))
    )


def orphan_references(references: DataFrame, existing: DataFrame, period: str = "hour") -> DataFrame:
    """The distinct (table_name, row_id, t) of references whose key does not exist at the reference's time.

    A start at the reference's instant counts as there, an end at that instant as gone. A reference without a time finds
    nothing and enters no window. Repeated rows give one row. Keys are split by ``period``: the count carried into a period comes from
    per-period sums, so a hot key's rows spread over as many tasks as it has periods.
    """
    deltas = existence_deltas(existing).withColumn("period", F.date_trunc(period, "t"))
    timed = references.where("t is not null").withColumn("period", F.date_trunc(period, "t"))
    key = ["kind", "key"]
    # per key and period: net change, and whether a reference needs the count carried in
    sums = (
        deltas.select(*key, "period", "delta", F.lit(0).alias("n_refs"))
        .unionByName(timed.select(*key, "period", F.lit(0).cast("bigint").alias("delta"), F.lit(1).alias("n_refs")))
        .groupBy(*key, "period")
        .agg(F.sum("delta").alias("delta"), F.max("n_refs").alias("n_refs"))
    )
    earlier = Window.partitionBy(*key).orderBy(F.col("period").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("delta", F.sum("delta").over(earlier)).where("n_refs > 0 and delta > 0 and period is not null")
    no_ref = [F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("bigint").alias("row_id")]
    timeline = (
        carried.select(*key, "period", F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(0).alias("step"), "delta", *no_ref)
        .unionByName(deltas.select(*key, "period", "t", F.lit(1).alias("step"), "delta", *no_ref))
        .unionByName(timed.select(*key, "period", "t", F.lit(2).alias("step"), F.lit(0).cast("bigint").alias("delta"), "table_name", "row_id"))
    )
    so_far = Window.partitionBy(*key, "period").orderBy(F.col("t").asc_nulls_first(), "step").rowsBetween(Window.unboundedPreceding, 0)
    missed = timeline.withColumn("alive", F.sum("delta").over(so_far)).where("step = 2 and alive <= 0").select("table_name", "row_id", "t")
    timeless = references.where("t is null").select("table_name", "row_id", "t")
    return missed.unionByName(timeless).groupBy("table_name", "row_id").agg(F.min("t").alias("t"))


def orphan_report(orphans: DataFrame, references: DataFrame) -> DataFrame:
    """Counts per table and month: n_references, n_orphans, orphan_share. Null times form a month of their own (null)."""
    month = F.date_format("t", "yyyy-MM").alias("month")
    total = references.groupBy("table_name", "row_id").agg(F.min("t").alias("t")).groupBy("table_name", month).agg(F.count("*").alias("n_references"))
    bad = orphans.groupBy("table_name", month).agg(F.count("*").alias("n_orphans"))
    same = (total["table_name"] == bad["table_name"]) & total["month"].eqNullSafe(bad["month"])
    n_bad = F.coalesce(bad["n_orphans"], F.lit(0))
    return total.join(bad, same, "left").select(
        total["table_name"], total["month"], "n_references", n_bad.alias("n_orphans"), F.round(n_bad / F.col("n_references"), 6).alias("orphan_share")
    )


def signed_counts(references: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, key, n_refs, n_exists) as at the end of the data: the state that later deltas are added to."""
    refs = references.groupBy("table_name", "row_id", "kind", "key").agg(F.lit(1).alias("one")).select("kind", "key", F.lit(1).alias("n_refs"), F.lit(0).alias("n_exists"))
    open_lives = existing.where("end is null").select("kind", "key", F.lit(0).alias("n_refs"), F.lit(1).alias("n_exists"))
    return merge_counts(refs, open_lives)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Adds signed counts per key. Parts may be states or deltas (negative counts allowed); keys that fall to zero stay out."""
    whole = parts[0].select("kind", "key", "n_refs", "n_exists")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("kind", "key", "n_refs", "n_exists"))
    return (
        whole.groupBy("kind", "key")
        .agg(F.sum("n_refs").cast("bigint").alias("n_refs"), F.sum("n_exists").cast("bigint").alias("n_exists"))
        .where("n_refs != 0 or n_exists != 0")
    )


def orphan_keys(counts: DataFrame) -> DataFrame:
    """Keys with positive references and no existence: the current orphan report."""
    return counts.where("n_refs > 0 and n_exists <= 0").select("kind", "key", "n_refs")
