"""Inventory of dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.session import stripped

# Categories in the order in which a name is looked up.
CATEGORIES = ("plugins", "themes", "composer", "npm")


def condensed(dependencies: DataFrame) -> DataFrame:
    """(category, name, version, slug) with the name, else the slug, else ``unknown``; slugs only of plugins and themes."""
    return dependencies.select(
        "category",
        F.coalesce("name", "slug", F.lit("unknown")).alias("name"),
        F.coalesce("version", F.lit("unknown")).alias("version"),
        F.when(F.col("category").isin("plugins", "themes"), F.col("slug")).alias("slug"),
    )


def rollup(dependencies: DataFrame) -> DataFrame:
    """Per name and version: entries, smallest type, and the sorted union of workspaces."""
    spread = dependencies.select("name", "version", "dependency_type", F.posexplode_outer("workspaces").alias("at", "workspace"))
    once = F.count_if(F.coalesce("at", F.lit(0)) == 0)
    return spread.groupBy("name", "version").agg(once.alias("n_entries"), F.min("dependency_type").alias("dependency_type"), F.array_sort(F.collect_set("workspace")).alias("workspaces"))


def summary(dependencies: DataFrame) -> DataFrame:
    """Entries per category, and of all under the category ``total``."""
    counted = dependencies.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "n")


def link_workspace(dependencies: DataFrame, name: str, workspace: str) -> DataFrame:
    """The table with the workspace added, once, to every entry of that name."""
    added = F.array_union(F.coalesce("workspaces", F.array().cast("array<string>")), F.array(F.lit(workspace)))
    return dependencies.withColumn("workspaces", F.when(F.lower(stripped("name")) == name.lower(), added).otherwise(F.col("workspaces")))


def indexed_already(requests: DataFrame, indexed: DataFrame) -> DataFrame:
    """Requests (name, version) that are in the index with that version."""
    return requests.join(indexed.select("name", "version").distinct(), ["name", "version"], "left_semi")


def look_up(requests: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each requested name with the first entry of that name or slug, categories in their fixed order; two equi-joins, no OR."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), F.lit(99))
    entries = dependencies.withColumn("rank", F.when(order == 0, 99).otherwise(order))
    named = entries.select(F.lower(stripped("name")).alias("key"), "rank", "category", "name", "version", "dependency_path")
    slugs = entries.select(F.lower(stripped("slug")).alias("key"), "rank", "category", "name", "version", "dependency_path")
    both = named.unionByName(slugs).where("key is not null")
    best = both.groupBy("key").agg(F.min_by(F.struct("category", "name", "version", "dependency_path"), F.struct("rank", "name", "version", "dependency_path")).alias("entry"))
    return requests.select(F.lower(stripped("name")).alias("key")).distinct().join(best, "key").select("key", "entry.*")


def without(dependencies: DataFrame, name: str) -> DataFrame:
    """The table without any version of a dependency."""
    return dependencies.where(~F.lower(stripped("name")).eqNullSafe(name.lower()))
