"""Queries over the code graph: relationships, edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators import graph as G
from codelake.session import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_of(table(spark, sf_dir, "relationships"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_nodes(table(spark, sf_dir, "nodes"))


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _edges(spark, sf_dir).where(F.col("type") == kind)


def q_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("id", "label", "name", "created_at")


def q_graph_nodes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def q_graph_edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges").dropDuplicates(["edge_id"])
    return edges.groupBy("repo_name", G.edge_type().alias("type")).agg(F.count("*").alias("n"))


def q_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_edges(_edges(spark, sf_dir))


def q_external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.external_nodes(_edges(spark, sf_dir))


def q_internal_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("type").agg(F.count_if(~F.col("is_external")).alias("n_internal"), F.count_if("is_external").alias("n_external"))


def q_linked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.linked(_edges(spark, sf_dir), _nodes(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def q_find_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _of(spark, sf_dir, "CALLS")
    return G.reach(calls, calls.agg(F.min("src").alias("id")), 10).select("id", "distance")


def q_find_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _of(spark, sf_dir, "CALLS")
    return G.reach(calls, calls.where("not is_external").agg(F.max("dst").alias("id")), 10, "in").select("id", "distance")


def q_call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _of(spark, sf_dir, "CALLS")
    return G.call_graph(calls, calls.agg(F.min("src").alias("id")), 3)


def q_call_graph_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _of(spark, sf_dir, "CALLS").where("not is_external")
    return G.reach(calls, calls.agg(F.min("src").alias("id")), 3, "both").select("id", "distance")


def q_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    extends = _of(spark, sf_dir, "EXTENDS")
    return G.reach(extends, extends.agg(F.max("src").alias("id")), None).select("id", "distance")


def q_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    extends = _of(spark, sf_dir, "EXTENDS")
    return G.reach(extends, extends.where("not is_external").agg(F.min("dst").alias("id")), None, "in").select("id", "distance")


def q_class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: members that belong to it and interfaces it implements."""
    edges = _edges(spark, sf_dir)
    members = edges.where("type = 'BELONGS_TO'").select(F.col("dst").alias("id"), F.col("src").alias("member"), F.lit(None).cast("string").alias("interface"))
    kinds = edges.where("type = 'IMPLEMENTS'").select(F.col("src").alias("id"), F.lit(None).cast("string").alias("member"), F.col("dst").alias("interface"))
    return members.unionByName(kinds).groupBy("id").agg(F.countDistinct("member").alias("n_members"), F.countDistinct("interface").alias("n_interfaces"))


def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.cycles(_of(spark, sf_dir, "EXTENDS"), None)
    return found.select(F.array_join("cycle", ">").alias("cycle"), "length")


def q_find_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = G.usages(_edges(spark, sf_dir), _nodes(spark, sf_dir))
    return used.groupBy("target").agg(F.count("*").alias("n_usages"), F.countDistinct("user").alias("n_users"))


def q_find_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", "type", "is_external").distinct()


def q_graph_sql_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made by the members of each class: class <- BELONGS_TO - member - CALLS -> callee."""
    _edges(spark, sf_dir).createOrReplaceTempView("graph_edges")
    return spark.sql("""
      select b.dst as class_id, count(distinct b.src) as n_members, count(distinct c.dst) as n_callees
      from graph_edges b join graph_edges c on c.src = b.src and c.type = 'CALLS'
      where b.type = 'BELONGS_TO' group by b.dst""")


def q_detach_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left by type once the nodes of all test files and the edges at them are gone."""
    nodes = _nodes(spark, sf_dir)
    tests = nodes.where(F.col("file_path").startswith("tests/")).select("repo_name", "file_path")
    kept, edges = G.detach(nodes, _edges(spark, sf_dir), tests)
    left = edges.groupBy("type").agg(F.count("*").alias("n"))
    return left.unionByName(kept.agg(F.lit("NODES").alias("type"), F.count("*").alias("n")))


NAMES = """q_upsert_last_wins q_graph_nodes_by_label q_graph_edges_by_type q_edge_merge q_external_nodes q_internal_external q_linked_edges
q_find_callees q_find_callers q_call_graph_edges q_call_graph_undirected q_ancestors q_descendants q_class_members q_cycles q_find_usages
q_find_dependencies q_graph_sql_pattern q_detach_files""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_B = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _id(column: str) -> str:
    t = f"trim({column}, {_B})"
    return f"(case when {t} = '' then null when starts_with({t}, 'external_') then {t} else lower({t}) end)"


_TYPE = f"upper(trim(relationship_type, {_B}))"
_E = f"""e as (
  select distinct rel_id, repo_name, {_id("source_id")} as src,
    coalesce({_id("target_id")}, 'external_' || nullif(trim(target_name, {_B}), '')) as dst,
    nullif({_TYPE}, '') as type, line_number, extracted_at, {_id("target_id")} is null as is_external
  from relationships where {_id("source_id")} is not null and coalesce({_id("target_id")}, 'external_' || nullif(trim(target_name, {_B}), '')) is not null
)"""
_N = f"""n as (
  select * from (select {_id("id")} as id, label, name, file_path, repo_name, created_at, is_external,
    row_number() over (partition by {_id("id")} order by created_at desc, coalesce(deleted_at, timestamp '9999-01-01') desc, coalesce(name, '') desc) as rn
  from nodes where {_id("id")} is not null) where rn = 1
)"""


def _reach(kind: str, start: str, depth: int, direction: str = "out", internal: bool = False) -> str:
    pairs = {"out": "select src as a, dst as b from k", "in": "select dst as a, src as b from k", "both": "select src as a, dst as b from k union select dst, src from k"}[direction]
    return f"""with recursive {_E}, k as (select distinct src, dst, is_external from e where type = '{kind}' {"and not is_external" if internal else ""}),
      pairs as ({pairs}), s as ({start}), r as (select id, 0 as d from s union select b, d + 1 from r join pairs on a = r.id where d < {depth})
      select id, min(d)::int as distance from r where id <> (select id from s) group by id"""


ORACLE = {
    "q_upsert_last_wins": f"with {_N} select id, label, name, created_at from n",
    "q_graph_nodes_by_label": f"with {_N} select label, count(*) as n from n group by 1",
    "q_graph_edges_by_type": f"select repo_name, nullif({_TYPE}, '') as type, count(distinct edge_id) as n from edges group by 1, 2",
    "q_edge_merge": f"""with {_E}, r as (select *, row_number() over (partition by src, dst, type order by extracted_at desc, rel_id desc) as rn from e where type is not null)
      select src, dst, type, count(*) as call_count, min(line_number) as first_line, max(line_number) as last_line, max(case when rn = 1 then line_number end) as line_number from r group by 1, 2, 3""",
    "q_external_nodes": f"""with {_E} select dst as id, case min(case when type = 'IMPORTS' then 0 when type in ('EXTENDS', 'IMPLEMENTS') then 1 else 2 end)
      when 0 then 'Module' when 1 then 'Class' else 'Function' end as label from e where is_external and type is not null group by 1""",
    "q_internal_external": f"with {_E} select type, count(*) filter (not is_external) as n_internal, count(*) filter (is_external) as n_external from e where type is not null group by 1",
    "q_linked_edges": f"with {_E}, {_N} select type, count(*) as n from e where type is not null and src in (select id from n) and dst in (select id from n) group by 1",
    "q_find_callees": _reach("CALLS", "select min(src) as id from k", 10),
    "q_find_callers": _reach("CALLS", "select max(dst) as id from k where not is_external", 10, "in"),
    "q_call_graph_edges": f"""with recursive {_E}, k as (select distinct src, dst from e where type = 'CALLS'),
      r as (select min(src) as id, 0 as d from k union select dst, d + 1 from r join k on src = r.id where d < 2)
      select src, dst from k where src in (select id from r)""",
    "q_call_graph_undirected": _reach("CALLS", "select min(src) as id from k", 3, "both", True),
    "q_ancestors": _reach("EXTENDS", "select max(src) as id from k", 30),
    "q_descendants": _reach("EXTENDS", "select min(dst) as id from k where not is_external", 30, "in"),
    "q_class_members": f"""with {_E}, m as (select dst as id, src as member, null as interface from e where type = 'BELONGS_TO'
      union all select src, null, dst from e where type = 'IMPLEMENTS')
      select id, count(distinct member) as n_members, count(distinct interface) as n_interfaces from m group by 1""",
    "q_cycles": f"""with recursive {_E}, k as (select distinct src, dst from e where type = 'EXTENDS' and src <> dst),
      p as (select [src, dst] as path, dst as tip, 1 as n from k where src < dst
        union all select list_append(path, k.dst), k.dst, n + 1 from p join k on k.src = p.tip where n < 7 and k.dst > path[1] and not list_contains(path, k.dst))
      select array_to_string(path, '>') as cycle, (n + 1)::int as length from p join k on k.src = p.tip and k.dst = path[1]""",
    "q_find_usages": f"""with {_E}, {_N} select dst as target, count(*) as n_usages, count(distinct src) as n_users from e
      where type in ('CALLS', 'USES', 'REFERENCES') and src in (select id from n) group by 1""",
    "q_find_dependencies": f"with {_E} select distinct src, dst, type, is_external from e where type is not null",
    "q_graph_sql_pattern": f"""with {_E} select b.dst as class_id, count(distinct b.src) as n_members, count(distinct c.dst) as n_callees
      from e b join e c on c.src = b.src and c.type = 'CALLS' where b.type = 'BELONGS_TO' group by 1""",
    "q_detach_files": f"""with {_E}, {_N}, gone as (select id from n where starts_with(file_path, 'tests/'))
      select type, count(*) as n from e where type is not null and src not in (select id from gone) and dst not in (select id from gone) group by 1
      union all select 'NODES', count(*) from n where id not in (select id from gone)""",
}
