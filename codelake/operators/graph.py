"""Property-graph operators over node and edge tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.operators import hierarchy
from codelake.session import cut, stripped

EXTERNAL = "external_"
USAGE_TYPES = ("CALLS", "USES", "REFERENCES")


def edge_type(column: str = "relationship_type") -> Column:
    """A relationship's type in one spelling."""
    return F.upper(stripped(column))


def node_id(column: str | Column) -> Column:
    """An id in one spelling: no surrounding blanks, case kept only for external names."""
    key = stripped(column)
    return F.when(key.startswith(EXTERNAL), key).otherwise(F.lower(key))


def label_of(chunk_type: Column) -> Column:
    """Node label of a chunk type."""
    return (
        F.when(chunk_type.rlike("^(class|struct|impl|enum|type_declaration)"), "Class")
        .when(chunk_type.rlike("^method"), "Method")
        .when(chunk_type.rlike("^(interface|trait)"), "Interface")
        .when(chunk_type.rlike("^namespace"), "Module")
        .otherwise("Function")
    )


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the life that began last, still open before ended ones, then the smallest name."""
    order = F.struct("created_at", F.coalesce("deleted_at", F.lit("9999-01-01").cast("timestamp_ntz")), F.coalesce("name", F.lit("")))
    columns = [c for c in nodes.columns if c != "id"]
    return (
        nodes.withColumn("id", node_id("id")).where("id is not null").groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("last")).select("id", "last.*")
    )


def edges_of(relationships: DataFrame) -> DataFrame:
    """Edges of extracted relationships: the target's id, else ``external_`` and its name; without either there is none."""
    target = node_id("target_id")
    name = stripped("target_name")
    return relationships.dropDuplicates(["rel_id"]).select(
        "rel_id", "repo_name", node_id("source_id").alias("src"), F.coalesce(target, F.concat(F.lit(EXTERNAL), name)).alias("dst"),
        edge_type().alias("type"), "line_number", "extracted_at", target.isNull().alias("is_external"),
    ).where("src is not null and dst is not null and type is not null")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, type): number of call sites, first and last line, and the line of the last extraction."""
    last = F.struct("extracted_at", "rel_id")
    return edges.groupBy("src", "dst", "type").agg(
        F.count("*").alias("call_count"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.max_by("line_number", last).alias("line_number")
    )


def external_nodes(edges: DataFrame) -> DataFrame:
    """(id, label) of the external targets; one label each, Module before Class before Function."""
    rank = F.when(F.col("type") == "IMPORTS", 0).when(F.col("type").isin("EXTENDS", "IMPLEMENTS"), 1).otherwise(2)
    label = F.element_at(F.array(F.lit("Module"), F.lit("Class"), F.lit("Function")), F.min(rank) + 1)
    return edges.where("is_external").groupBy(F.col("dst").alias("id")).agg(label.alias("label"))


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends exist; ids are unique in ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None, direction: str = "out") -> DataFrame:
    """(start, id, distance): nodes within max_depth hops of each start (None: however far), with their least distance; the start itself is none.

    Breadth first over all starts at once: each hop joins the newly reached pairs with the edges and drops those known.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if direction == "in":
        pairs = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    elif direction == "both":
        pairs = pairs.union(pairs.select("b", "a"))
    pairs = cut(pairs.distinct())
    found = start.select(F.col("id").alias("start"), "id").distinct().withColumn("distance", F.lit(0))
    frontier = found
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(pairs, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        frontier = cut(step.join(found.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier)
        if depth % 20 == 0:
            found = cut(found)  # deep searches must not build up a union of all their hops
    return found.where("distance > 0")


def call_graph(edges: DataFrame, start: DataFrame, max_depth: int, direction: str = "out") -> DataFrame:
    """(src, dst) of the distinct edges passed within max_depth hops of the starts."""
    inner = reach(edges, start, max_depth - 1, direction).select("id").union(start.select("id")).distinct()
    pairs = edges.select("src", "dst").distinct()
    out = pairs.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    back = pairs.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return {"out": out, "in": back, "both": out.union(back).distinct()}[direction]


def usages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, user, user_name, type, line_number): one row per usage edge whose user is a node."""
    users = nodes.select(F.col("id").alias("src"), F.col("name").alias("user_name"))
    return edges.where(F.col("type").isin(*USAGE_TYPES)).join(users, "src").select(F.col("dst").alias("target"), F.col("src").alias("user"), "user_name", "type", "line_number")


def cycles(edges: DataFrame, max_length: int | None = 8) -> DataFrame:
    """(cycle, length) of the simple cycles of 2 to max_length edges (None: of any length), each once, smallest id first.

    Of any length, edges that give each node one target at most are followed by pointer doubling.

    Nodes that cannot lie on a cycle, having no edge in or none out, are taken off until none is left; paths then grow
    from each node through larger ids only, so that every cycle is met at its smallest one.
    """
    pairs = cut(edges.where("src != dst").select("src", "dst").distinct())
    if max_length is None and not pairs.groupBy("src").count().where("count > 1").limit(1).count():
        return hierarchy.cycles(pairs.select(F.col("src").alias("child"), F.col("dst").alias("parent")))
    left = pairs.count()
    while left:
        ends = pairs.select(F.col("dst").alias("src")).distinct()
        starts = pairs.select(F.col("src").alias("dst")).distinct()
        pairs = cut(pairs.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"))
        now = pairs.count()
        if now == left:
            break
        left = now
    step = pairs.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = pairs.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    found = None
    for length in itertools.count(2) if max_length is None else range(2, max_length + 1):
        grown = cut(paths.join(step, "last"))
        closed = grown.where(F.col("next") == F.col("path")[0]).select(F.col("path").alias("cycle"), F.lit(length).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))).select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
        if not paths.limit(1).count():
            break
    return found


def detach(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of the given (repo_name, file_path) and without edges at them."""
    gone = nodes.join(files.select("repo_name", "file_path").distinct(), ["repo_name", "file_path"], "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti")
    return kept, edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def without_lonely_externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drops external nodes that no edge touches any more."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    external = F.col("id").startswith(EXTERNAL)
    return nodes.where(~external).unionByName(nodes.where(external).join(touched, "id", "left_semi").select(nodes.columns))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Left rows with the columns of the first right row of the same keys, null where there is none.

    The first row per key is found by map-side aggregation, so a hot key costs no more than others; null keys match none.
    """
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first")).select(*keys, "__first.*")
    return left.join(best, keys, "left")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Last write per key of both tables by ``sequence``; whole rows are replaced, ties go to the greater row."""
    rows = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(sequence, F.xxhash64(*rest))).alias("last")).select(*keys, "last.*")


def latest_window(keys: list[str], order: list[Column]):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
