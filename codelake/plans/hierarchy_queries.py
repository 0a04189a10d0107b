"""Queries of problem 3: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelake.operators import hierarchy as H
from codelake.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = H.parent_links(table(spark, sf_dir, "relationships"))
    return H.hierarchy(links, paths=False).where("is_child").select("node_id", "root_id", "depth")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(H.parent_links(table(spark, sf_dir, "relationships"))).select("node_id", "root_id", "depth", "path", "n_descendants")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each class whose chain of parents ends, and of the parents that are no children."""
    forest = H.hierarchy(H.parent_links(table(spark, sf_dir, "relationships"))).where("depth >= 0")
    return H.descendants(forest)


def p3_endless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes whose chain of parents never ends, with the smallest id on the cycle."""
    return p3_found(spark, sf_dir).where("depth = -1").select("node_id", "root_id")


QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants, "p3_endless": p3_endless}

_B = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_LINKS = f"""
links as (
  select lower(trim(source_id, {_B})) as child, min(lower(trim(target_id, {_B}))) as parent from relationships
  where upper(trim(relationship_type, {_B})) = 'EXTENDS' and trim(source_id, {_B}) <> '' and trim(target_id, {_B}) <> '' group by 1
), climb as (
  select child, parent as top, [child, parent] as seen, child = parent as looped from links
  union all
  select climb.child, links.parent, list_append(seen, links.parent), list_contains(seen, links.parent)
  from climb join links on links.child = climb.top where not climb.looped
), found as (
  select child as node_id, case when looped then list_min(seen[list_position(seen, top):]) else top end as root_id,
    (case when looped then -1 else len(seen) - 1 end)::int as depth
  from climb where looped or top not in (select child from links)
)"""

ORACLE = {
    "p3_found": f"with recursive {_LINKS} select node_id, root_id, depth from found",
    "p3_hierarchy": f"""with recursive {_LINKS}, nodes as (select child as node_id from links union select parent from links),
      runs as (select node_id, root_id, depth from found union all select node_id, node_id, 0 from nodes where node_id not in (select child from links)),
      above as (select child as node_id, unnest(seen[2:]) as up from climb where (looped or top not in (select child from links))),
      n as (select up, count(distinct node_id) filter (node_id <> up) as n from above group by 1),
      p as (select child as node_id, array_to_string(list_reverse(seen), '/') as path from climb where not looped and top not in (select child from links))
      select node_id, root_id, depth, case when depth = 0 then node_id when depth > 0 then path end as path, coalesce(n, 0)::bigint as n_descendants
      from runs left join p using (node_id) left join n on n.up = node_id""",
    "p3_descendants": f"""with recursive {_LINKS}, ended as (select child, seen from climb where not looped and top not in (select child from links))
      select unnest(seen[2:]) as node_id, child as descendant_id, unnest(range(1, len(seen)))::int as distance from ended""",
    "p3_endless": f"with recursive {_LINKS} select node_id, root_id from found where depth = -1",
}
