"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators import references as R
from codelake.session import table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs = R.relationship_references(table(spark, sf_dir, "relationships")).unionByName(R.edge_references(table(spark, sf_dir, "edges")))
    existing = R.lives(table(spark, sf_dir, "chunks"), "chunk", "indexed_at").unionByName(R.lives(table(spark, sf_dir, "nodes"), "node", "created_at"))
    return refs, existing


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphan_references(*_inputs(spark, sf_dir)).select("table_name", F.col("row_id").cast("bigint").alias("row_id"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, existing = _inputs(spark, sf_dir)
    return R.orphan_report(R.orphan_references(refs, existing), refs)


def p1_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orphan_keys(R.signed_counts(*_inputs(spark, sf_dir)))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_current": p1_current}

_KEY = r"case when {t} = '' then null when starts_with({t}, 'external_') then {t} else lower({t}) end"
_BLANKS = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _key(column: str) -> str:
    return _KEY.format(t=f"trim({column}, {_BLANKS})")


_REFS = f"""
refs as (
  select distinct 'relationships' as table_name, rel_id as row_id,
    case when {_key("target_id")} is not null then 'chunk' else 'node' end as kind,
    coalesce({_key("target_id")}, 'external_' || nullif(trim(target_name, {_BLANKS}), '')) as key, extracted_at as t
  from relationships
  where coalesce({_key("target_id")}, 'external_' || nullif(trim(target_name, {_BLANKS}), '')) is not null
  union
  select distinct 'edges', edge_id, 'node', {_key("target_id")}, created_at from edges where {_key("target_id")} is not null
), there as (
  select 'chunk' as kind, {_key("id")} as key, indexed_at as s, deleted_at as e from chunks where id is not null
  union
  select 'node', {_key("id")}, created_at, deleted_at from nodes where id is not null
), orphans as (
  select distinct table_name, row_id, t from refs where not exists (
    select 1 from there where there.kind = refs.kind and there.key = refs.key and s <= t and (e is null or e > t))
)"""

ORACLE = {
    "p1_found": f"with {_REFS} select table_name, row_id from orphans",
    "p1_report": f"""with {_REFS}, r as (select table_name, strftime(t, '%Y-%m') as month, count(*) as n_references from refs group by 1, 2),
      o as (select table_name, strftime(t, '%Y-%m') as month, count(*) as n_orphans from orphans group by 1, 2)
      select r.table_name, r.month, n_references, coalesce(n_orphans, 0) as n_orphans,
        round(coalesce(n_orphans, 0)::double / n_references, 6) as orphan_share
      from r left join o on r.table_name = o.table_name and r.month is not distinct from o.month""",
    "p1_current": f"""with {_REFS} select kind, key, count(*) as n_refs from refs
      where not exists (select 1 from there where there.kind = refs.kind and there.key = refs.key and s is not null and e is null) group by 1, 2""",
}
