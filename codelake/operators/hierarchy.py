"""Parent-child links to full hierarchies (problem 3).

Cycle separation and subtree sizes by pointer doubling, heavy-path decomposition from the sizes, then roots, depths,
paths and descendant intervals by concatenating chain segments. Every step is a join or a grouped sum over the whole
forest; the number of rounds grows with the logarithm of the deepest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators.running import running_before
from codelake.session import cut, cut_measuring, stripped


def parent_links(relationships: DataFrame, kind: str = "EXTENDS") -> DataFrame:
    """(child, parent), one row per child, from relationships of one type; ids lower case without surrounding blanks.

    Rows without a source or a target are no links. Should a child name several parents, the smallest id is its parent.
    """
    return (
        relationships.where(F.upper(stripped("relationship_type")) == kind)
        .select(F.lower(stripped("source_id")).alias("child"), F.lower(stripped("target_id")).alias("parent"))
        .where("child is not null and parent is not null")
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )


def _open(column: str = "up"):
    return F.count_if(F.col(column).isNotNull())


def _sizes(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(nodes with id, parent, up, size), and how many of them never reach a root; those have an ``up``.

    Round k knows for each node its ancestor 2^k links up and the number of nodes below it within fewer than 2^k links.
    As long as some tree is deeper than 2^k, another round sees more nodes reach past their root; when a round sees no
    more of them, the nodes left run into a cycle.
    """
    state, seen = cut_measuring(nodes.select("id", "parent", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), left=_open())
    while seen["left"]:
        before = seen["left"]
        going = state.where("up is not null")
        below = going.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        jump = going.select(F.col("id").alias("up"), F.col("up").alias("next"))
        grown = state.join(jump, "up", "left").join(below, "id", "left")
        state, seen = cut_measuring(grown.select("id", "parent", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), left=_open())
        if seen["left"] == before:
            break
    return state, seen["left"]


def _with_roots(links: DataFrame) -> DataFrame:
    """(id, parent) of every child and, with a null parent, of the parents that are no children."""
    roots = links.select(F.col("parent").alias("id")).distinct().join(links.select(F.col("child").alias("id")), "id", "left_anti")
    return links.select(F.col("child").alias("id"), "parent").unionByName(roots.withColumn("parent", F.lit(None).cast("string")))


def _cycles(endless: DataFrame) -> DataFrame:
    """(node_id, root_id, on_cycle): for each node whose chain never ends, the smallest id on the cycle it runs into."""
    state = cut(endless.select("id", F.col("parent").alias("up"), F.col("id").alias("least")))
    measure = None
    while True:
        # the image shrinks until only cycles are left in it; then the least ids settle
        image = state.select("up").distinct().join(state.select(F.col("id").alias("up"), "least"), "up")
        now = image.agg(F.count("*"), F.sum(F.xxhash64("up", "least").cast("decimal(20,0)"))).first()
        if measure == (now[0], now[1]):
            break
        measure = (now[0], now[1])
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("their"))
        state = cut(state.join(jump, "up").select("id", F.col("next").alias("up"), F.least("least", "their").alias("least")))
    least = state.select(F.col("id").alias("up"), F.col("least").alias("root_id"))
    on = state.select(F.col("up").alias("id")).distinct().withColumn("on", F.lit(True))  # links enough up, only cycles are left
    return cut(state.join(least, "up").join(on, "id", "left").select(F.col("id").alias("node_id"), "root_id", F.coalesce("on", F.lit(False)).alias("on_cycle")))


def cycles(links: DataFrame) -> DataFrame:
    """(cycle, length) of the cycles of two or more of (child, parent) links with one parent each, each from its smallest id up its parents.

    The rounds grow with the logarithm of the longest chain or cycle: each cycle is cut above its smallest id and ranked.
    """
    links = cut(links.select("child", "parent"))
    on = _cycles(_sizes(_with_roots(links))[0].where("up is not null")).where("on_cycle")
    opened = on.where("node_id != root_id").select(F.col("node_id").alias("child")).join(links, "child")
    ranked = hierarchy(opened, paths=False)
    members = F.array_sort(F.collect_list(F.struct(F.when(F.col("depth") > 0, -F.col("depth")).otherwise(-(2**31)).alias("at"), "node_id")))
    return ranked.groupBy("root_id").agg(F.transform(members, lambda m: m["node_id"]).alias("cycle")).select("cycle", F.size("cycle").alias("length"))


def _chains(trees: DataFrame) -> DataFrame:
    """Adds chain (id of the topmost node of its heavy path), pos (links below it) and heavy (largest child, smallest id first)."""
    best = trees.where("parent is not null").groupBy("parent").agg(F.max_by("id", F.struct("size", "id")).alias("heavy"))
    nodes = cut(trees.join(best.withColumnRenamed("parent", "id"), "id", "left"))
    on_heavy = nodes.where("heavy is not null").select(F.col("heavy").alias("id"), F.lit(True).alias("on"))
    steps = nodes.join(on_heavy, "id", "left").select("id", F.when(F.col("on"), F.col("parent")).otherwise(F.col("id")).alias("chain"), F.when(F.col("on"), 1).otherwise(0).cast("bigint").alias("pos"))
    state, seen = cut_measuring(steps, moved=F.count_if(F.col("chain") != F.col("id")))
    while seen["moved"]:
        jump = state.where("chain != id").select(F.col("id").alias("chain"), F.col("chain").alias("next"), F.col("pos").alias("more"))
        moved = state.join(jump, "chain", "left").select("id", F.coalesce("next", "chain").alias("chain"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.col("next").isNotNull().alias("moved"))
        state, seen = cut_measuring(moved, moved=F.count_if("moved"))
    return cut(nodes.join(state.select("id", "chain", "pos"), "id"))


def _joined(nodes: DataFrame, paths: bool) -> DataFrame:
    """Per chain: root, links from the root to its top (add), preorder number of its top (enter), ids above it (above)."""
    tops = nodes.where("chain = id and parent is not null").select(F.col("id").alias("chain"), "parent", "size")
    before = F.lit(0).cast("bigint").alias("before")
    if paths:
        spread = F.pmod(F.xxhash64("chain"), F.lit(64))
        tops = running_before(tops, ["parent"], ["chain"], "size", spread, "before")
    else:
        tops = tops.select("chain", "parent", "size", before)
    above = nodes.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("at"), "heavy")
    light = tops.join(above, "parent")
    if paths:
        sizes = nodes.select(F.col("id").alias("heavy"), F.col("size").alias("first"))
        members = nodes.groupBy(F.col("chain").alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("members"))
        light = light.join(sizes, "heavy").join(members, "up").withColumn("above", F.slice("members", 1, (F.col("at") + 1).cast("int")))
        enter = F.col("at") + 1 + F.col("first") + F.col("before")
    else:
        light = light.withColumn("above", F.array().cast("array<string>"))
        enter = F.lit(0).cast("bigint")
    top = nodes.where("parent is null").select(F.col("id").alias("chain"), F.col("id").alias("up"), F.lit(0).cast("bigint").alias("add"), F.lit(0).cast("bigint").alias("enter"), F.array().cast("array<string>").alias("above"))
    begun = light.select("chain", "up", (F.col("at") + 1).alias("add"), enter.alias("enter"), "above").unionByName(top)
    state, seen = cut_measuring(begun, moved=F.count_if(F.col("chain") != F.col("up")))
    while seen["moved"]:
        jump = state.where("chain != up").select(F.col("chain").alias("up"), F.col("up").alias("next"), F.col("add").alias("add2"), F.col("enter").alias("enter2"), F.col("above").alias("above2"))
        moved = state.select("chain", "up", "add", "enter", "above").join(jump, "up", "left").select(
            "chain",
            F.coalesce("next", "up").alias("up"),
            (F.col("add") + F.coalesce("add2", F.lit(0))).alias("add"),
            (F.col("enter") + F.coalesce("enter2", F.lit(0))).alias("enter"),
            F.when(F.col("above2").isNull(), F.col("above")).otherwise(F.concat("above2", "above")).alias("above"),
            F.col("next").isNotNull().alias("moved"),
        )
        state, seen = cut_measuring(moved, moved=F.count_if("moved"))
    return state.select("chain", F.col("up").alias("tree_id"), "add", "enter", "above")


def hierarchy(links: DataFrame, paths: bool = True) -> DataFrame:
    """The whole forest of (child, parent) links, one row per node, also for parents that are nobody's child.

    node_id, root_id, depth (links to the root), is_child; with ``paths`` also path (ids from the root, ``/`` between),
    n_descendants, tree_id, level (links to it), enter and leave: the descendants of a node are the nodes of the same tree_id whose enter lies
    after its own and not after its leave. Nodes whose chain never ends get depth -1, the smallest id of the cycle as
    root_id and no path. Each node on a cycle is the tree_id of what hangs below it and has all other nodes that run into
    its cycle as descendants. No links give no rows. The ids of one heavy path are gathered in one row, which is no
    longer than the path of its lowest node.
    """
    state, endless = _sizes(_with_roots(cut(links.select("child", "parent"))))
    trees = state.where("up is null").select("id", "parent", "size")
    on = None
    if endless:
        on = _cycles(state.where("up is not null"))
        parent = F.when(~F.col("on_cycle"), F.col("parent")).alias("parent")  # cycles are cut: their nodes are roots of what hangs below
        hanging = state.where("up is not null").join(on.withColumnRenamed("node_id", "id"), "id").select("id", parent)
        trees = trees.unionByName(_sizes(hanging)[0].select("id", "parent", "size"))
    nodes = _chains(trees)
    whole = nodes.join(_joined(nodes, paths), "chain")
    if on is None:
        whole = whole.withColumns({"least": F.lit(None).cast("string"), "on_cycle": F.lit(False), "n_loop": F.lit(None).cast("bigint")})
    else:
        loops = on.join(on.groupBy("root_id").agg(F.count("*").alias("n_loop")), "root_id")
        whole = whole.join(loops.select(F.col("node_id").alias("id"), F.col("root_id").alias("least"), "on_cycle", "n_loop"), "id", "left")
    ends = F.col("least").isNull()
    root = F.coalesce("least", "tree_id").alias("root_id")
    level = (F.col("pos") + F.col("add")).cast("int")
    depth = F.when(ends, level).otherwise(-1).alias("depth")
    is_child = (F.col("parent").isNotNull() | ~ends).alias("is_child")
    if not paths:
        return whole.select(F.col("id").alias("node_id"), root, depth, is_child)
    members = nodes.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("members"))
    enter = F.col("enter") + F.col("pos")
    path = F.array_join(F.concat("above", F.slice("members", 1, (F.col("pos") + 1).cast("int"))), "/")
    return whole.join(members, "chain").select(
        F.col("id").alias("node_id"), root, depth, is_child, F.when(ends, path).alias("path"),
        (F.when(F.col("on_cycle"), F.col("n_loop")).otherwise(F.col("size")) - 1).alias("n_descendants"), "tree_id", level.alias("level"), enter.alias("enter"), (enter + F.col("size") - 1).alias("leave"),
    )


#: Preorder numbers that a bucket of ``descendants`` holds.
BUCKET = 64


def descendants(forest: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node_id, descendant_id, distance) for the node_ids in ``of``, or all, by the preorder intervals of ``hierarchy``.

    Intervals are laid out in buckets of preorder numbers, so that a node meets no more than two buckets beside its own
    descendants. Of a node on a cycle these are what hangs below it; the cycle's other nodes are known by its root_id.
    """
    bucket = lambda n: F.floor(n / BUCKET)
    top = forest if of is None else forest.join(of.select("node_id").distinct(), "node_id", "left_semi")
    top = top.where("leave > enter").select("node_id", "tree_id", F.col("level").alias("d0"), F.col("enter").alias("e0"), "leave")
    top = top.withColumn("bucket", F.explode(F.sequence(bucket(F.col("e0") + 1), bucket(F.col("leave")))))
    below = forest.select(F.col("node_id").alias("descendant_id"), "tree_id", "level", "enter", bucket(F.col("enter")).alias("bucket"))
    return top.join(below, ["tree_id", "bucket"]).where("enter > e0 and enter <= leave").select("node_id", "descendant_id", (F.col("level") - F.col("d0")).alias("distance"))
