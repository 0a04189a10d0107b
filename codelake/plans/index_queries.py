"""Queries over files, chunks, dependencies and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.functions import paths, text
from codelake.operators import chunking, embedding, incremental, jobs, knowledge
from codelake.operators import graph as G
from codelake.plans import graph_queries
from codelake.session import table

#: Two moments between which the index is compared; parameters of the queries below.
BEFORE, AFTER = "2025-04-01", "2025-09-01"
PATTERNS = ("tests/**", "app/*", "*.min.js", "fixtures")
IGNORED = ["lib/*", "src/vendor/", "!lib/keep.py", "# note", "cmd"]
MODEL = "hashing-64"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file once: repeated rows are exact, so their key tells them and unused columns are never read."""
    return table(spark, sf_dir, "files").dropDuplicates(["repo_name", "file_path"])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each life of a chunk once, by its key as above."""
    return table(spark, sf_dir, "chunks").dropDuplicates(["repo_name", "id", "indexed_at"])


def q_language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = paths.language(F.col("file_path"))
    return _files(spark, sf_dir).groupBy(detected.alias("detected"), "language").agg(F.count("*").alias("n"))


def q_path_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    flags = [paths.excluded(path, PATTERNS).alias("excluded"), paths.gitignored(path, IGNORED).alias("ignored"), paths.is_minified_name(path).alias("minified"), paths.is_hidden(path).alias("hidden")]
    return _files(spark, sf_dir).select("repo_name", "file_path", *flags)


def q_indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = paths.indexable(F.col("file_path"), F.col("size_bytes"), PATTERNS, IGNORED, 20_000)
    return _files(spark, sf_dir).where(keep).groupBy("repo_name").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))


def _state(spark: SparkSession, sf_dir: str, moment: str) -> DataFrame:
    at = F.lit(moment).cast("timestamp_ntz")
    alive = _chunks(spark, sf_dir).where((F.col("indexed_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at)))
    return alive.groupBy("repo_name", "file_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("id")), ","), 256).alias("content_hash"))


def q_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.diff(_state(spark, sf_dir, BEFORE), _state(spark, sf_dir, AFTER))


def q_removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.removed_files(_state(spark, sf_dir, BEFORE), _state(spark, sf_dir, AFTER))


def q_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.hit_rate(q_incremental_diff(spark, sf_dir))


def q_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts indexed later that are embedded already, by language."""
    keyed = _chunks(spark, sf_dir).select("language", "indexed_at", text.cache_key(MODEL, F.col("content")).alias("cache_key"))
    at = F.lit(BEFORE).cast("timestamp_ntz")
    cache = keyed.where(F.col("indexed_at") < at).select("cache_key", F.lit(True).alias("embedding"))
    known = incremental.with_cache(keyed.where(F.col("indexed_at") >= at).select("language", "cache_key"), cache)
    return known.groupBy("language").agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))


def q_embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk embedded through the cache of those indexed before; vectors and dimensions per language."""
    rows = _chunks(spark, sf_dir).select("repo_name", "id", "language", "content", "indexed_at")
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>")
    whole, _ = embedding.embed(rows, empty, embedding.hashing_embedder(), MODEL)
    return whole.groupBy("language").agg(F.count("embedding").alias("n_vectors"), F.max(F.size("embedding")).alias("dimension"))


def q_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("repo_name").agg(F.count("*").alias("n_files"), F.sum("chunk_count").alias("n_chunks"), F.sum("size_bytes").alias("n_bytes"), F.round(F.sum("size_bytes") / F.lit(1048576.0), 2).alias("megabytes"))


def q_get_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.symbols(_chunks(spark, sf_dir), "class")


def q_symbol_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("repo_name", "file_path", "chunk_type").agg(F.count("*").alias("n"))


def q_search_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.search(_chunks(spark, sf_dir), repo="atlas-core", language="python", path_part="src/", chunk_type="function_definition")
    return found.select("id", "file_path", F.concat_ws("-", "start_line", "end_line").alias("lines"), F.coalesce(F.nullif("context", F.lit("")), F.lit("N/A")).alias("context"))


def q_range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "relationships").where(G.edge_type() == "CALLS")
    return chunking.enclosing(calls, table(spark, sf_dir, "chunks"))


def q_resolve_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a target id, with the first function of that name in their own file."""
    calls = table(spark, sf_dir, "relationships").where((G.edge_type() == "CALLS") & G.node_id("target_id").isNull()).dropDuplicates(["rel_id"])
    callers = calls.select("rel_id", "repo_name", F.col("source_file").alias("file_path"), F.col("target_name").alias("name"))
    functions = _chunks(spark, sf_dir).where(F.col("chunk_type").isin("function_definition", "method_definition") & F.col("name").isNotNull())
    return G.first_match(callers, functions, ["repo_name", "file_path", "name"], ["start_byte", "id"], ["id"]).select("rel_id", F.col("id").alias("target"))


def q_resolve_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base classes by name, with the first class of that name in the same repository."""
    extends = table(spark, sf_dir, "relationships").where(G.edge_type().isin("EXTENDS", "IMPLEMENTS")).dropDuplicates(["rel_id"])
    wanted = extends.select("rel_id", "repo_name", F.col("target_name").alias("name"))
    classes = _chunks(spark, sf_dir).where(F.col("chunk_type").isin("class_definition", "class_declaration") & F.col("name").isNotNull())
    return G.first_match(wanted, classes, ["repo_name", "name"], ["file_path", "start_byte", "id"], ["id", "file_path"]).select("rel_id", F.col("id").alias("target"), "file_path")


def q_method_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_of_context(table(spark, sf_dir, "chunks"))


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.chunk_id(F.col("file_path"), F.col("start_line"), F.col("content"))
    rows = table(spark, sf_dir, "chunks").dropDuplicates(["repo_name", "id"])
    return rows.select("repo_name", "id", made.alias("made_id"), text.point_uuid(made).alias("point"), text.cache_key(MODEL, F.col("content")).alias("cache_key"), F.length(text.embedder_text(F.col("content"), 4915)).alias("n_embedded"))


def q_header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.header_field(F.col("text"), "title").alias("title")).where("title is not null")


def q_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.imports(_files(spark, sf_dir))


def q_file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of one file of a repository by another."""
    files = _files(spark, sf_dir)
    return chunking.file_imports(chunking.imports(files), files)


def q_file_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import each other in a circle."""
    key = lambda c: F.concat_ws(":", "repo_name", c)
    found = G.cycles(q_file_imports(spark, sf_dir).select(key("file_path").alias("src"), key("target_path").alias("dst")), 6)
    return found.select(F.array_join("cycle", " > ").alias("cycle"), "length")


def q_extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls found in the chunks' own texts, resolved within their files; counts per repository."""
    chunks = _chunks(spark, sf_dir).dropDuplicates(["repo_name", "id"])
    found = chunking.resolve_calls(chunking.calls(chunks), chunks)
    return found.groupBy("repo_name").agg(F.count("*").alias("n_calls"), F.count("target_id").alias("n_resolved"))


def q_extract_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.bases(_chunks(spark, sf_dir).dropDuplicates(["repo_name", "id"]))


def q_chunk_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files cut into chunks anew."""
    return chunking.chunk_files(table(spark, sf_dir, "files")).select("repo_name", "file_path", "id", "chunk_type", "name", "start_line", "end_line", "context")


def q_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _chunks(spark, sf_dir).select("chunk_type", F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy("chunk_type").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max(F.length("line")).alias("longest"))


def q_framework_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dependencies").groupBy(text.framework(F.col("dependency_type"), F.col("name")).alias("framework")).agg(F.count("*").alias("n"))


def q_list_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.rollup(table(spark, sf_dir, "dependencies")).select("name", "version", "n_entries", "dependency_type", F.array_join("workspaces", ",").alias("workspaces"))


def q_dep_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.condensed(table(spark, sf_dir, "dependencies"))


def q_dep_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.summary(table(spark, sf_dir, "dependencies"))


def q_link_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = knowledge.link_workspace(table(spark, sf_dir, "dependencies"), "quillbox", "ws-9")
    return linked.select("category", "name", "version", F.array_join("workspaces", ",").alias("workspaces"))


def q_dependency_exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the inventory whose name some file carries."""
    used = _files(spark, sf_dir).select(F.lower(F.trim("dependency_name")).alias("key")).where("key is not null").distinct()
    return table(spark, sf_dir, "dependencies").withColumn("key", F.lower(F.trim("name"))).join(used, "key", "left_semi").select("category", "name", "version")


def q_dependency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory entry of every dependency name that files carry, by name or slug."""
    names = _files(spark, sf_dir).select(F.col("dependency_name").alias("name")).where("name is not null").distinct()
    return knowledge.look_up(names, table(spark, sf_dir, "dependencies")).select("key", "category", "dependency_path")


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = lambda path: F.get_json_object("metadata", path)
    rows = table(spark, sf_dir, "relationships").dropDuplicates(["rel_id"])
    return rows.groupBy(G.edge_type().alias("type"), meta("$.language").alias("language"), meta("$.is_relative").alias("is_relative")).agg(F.count("*").alias("n"), F.count(meta("$.import_alias")).alias("n_aliased"))


def q_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status(table(spark, sf_dir, "jobs"))


def q_union_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.edges_of(table(spark, sf_dir, "relationships"))
    code = G.merge_nodes(table(spark, sf_dir, "nodes")).where("not coalesce(is_external, false)").select("id", "label", F.lit("code").alias("source"))
    return code.unionByName(G.external_nodes(edges).withColumn("source", F.lit("external"))).groupBy("label", "source").agg(F.count("*").alias("n"))


def q_intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(G.node_id("id").alias("id")).intersect(table(spark, sf_dir, "nodes").select(G.node_id("id").alias("id")))


def q_except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(G.node_id("id").alias("id")).exceptAll(table(spark, sf_dir, "nodes").select(G.node_id("id").alias("id"))).distinct()


def q_rank_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each file by size, and the running lines of it."""
    rows = _chunks(spark, sf_dir).select("repo_name", "file_path", "id", "start_byte", "indexed_at", F.length("content").alias("size"))
    by_size = Window.partitionBy("repo_name", "file_path").orderBy(F.desc("size"))
    by_place = Window.partitionBy("repo_name", "file_path").orderBy("start_byte", "id", "indexed_at")
    return rows.select(
        "repo_name", "file_path", "id", "indexed_at", F.rank().over(by_size).alias("rank"), F.dense_rank().over(by_size).alias("dense_rank"),
        F.lag("id").over(by_place).alias("previous"), F.sum("size").over(by_place.rowsBetween(-2, 0)).alias("moving_size"),
    )


def q_cube_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).cube("language", "chunk_type").agg(F.grouping_id().cast("bigint").alias("g"), F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def q_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").groupBy("language").agg(F.approx_count_distinct("id").alias("n_ids"), F.approx_count_distinct("name").alias("n_names"))


NAMES = """q_language_detect q_path_excludes q_indexable_files q_incremental_diff q_removed_files q_hit_rate q_cache_join q_embed_chunks q_index_stats q_get_symbols
q_symbol_types q_search_text_filter q_range_containment q_resolve_first_match q_resolve_bases q_method_parents q_chunk_ids q_header_extract q_imports q_file_imports q_file_cycles q_extract_calls
q_extract_bases q_chunk_source q_chunk_lines q_framework_case q_list_dependencies q_dep_condensed q_dep_summary_rollup q_link_workspace q_dependency_exists_semi
q_dependency_lookup q_json_props q_job_status q_union_nodes q_intersect_ids q_except_ids q_rank_frames q_cube_chunks q_approx_distinct""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_B = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_F = "f as (select distinct * from files)"
_C = "c as (select distinct * from chunks)"
_TYPE = f"upper(trim(relationship_type, {_B}))"
_LANG = "case " + " ".join(f"when lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) = '{e}' then '{x}'" for e, x in paths.LANGUAGE_OF_EXTENSION.items()) + " end"
_NAME = "list_last(string_split(file_path, '/'))"
_EXCLUDED = f"""(starts_with(file_path, 'tests/') or file_path = 'tests' or regexp_matches(file_path, '^app/[^/]+$') or regexp_matches(file_path, '(^|/)[^/]*\\.min\\.js$')
  or file_path = 'fixtures' or starts_with(file_path, 'fixtures/') or starts_with(file_path, 'vendor/') or file_path = 'vendor' or starts_with(file_path, 'node_modules/') or file_path = 'node_modules')"""
_IGNORED = "(starts_with(file_path, 'lib/') or starts_with(file_path, 'src/vendor/') or file_path = 'src/vendor' or list_contains(string_split(file_path, '/'), 'cmd'))"
_MINIFIED = f"(contains({_NAME}, '.min.') or ends_with({_NAME}, '.min'))"


def _state_sql(name: str, moment: str) -> str:
    return f"""{name} as (select repo_name, file_path, sha256(array_to_string(list_sort(list_distinct(list(id))), ',')) as h from chunks
      where indexed_at <= timestamp '{moment}' and (deleted_at is null or deleted_at > timestamp '{moment}') group by 1, 2)"""


_DIFF = f"""{_state_sql("a", BEFORE)}, {_state_sql("b", AFTER)}, d as (select coalesce(a.repo_name, b.repo_name) as repo_name, coalesce(a.file_path, b.file_path) as file_path,
  case when a.file_path is null then 'new' when b.file_path is null then 'removed' when a.h = b.h then 'unchanged' else 'changed' end as status
  from a full join b on a.repo_name = b.repo_name and a.file_path = b.file_path)"""
_KEYED = f"k as (select language, indexed_at, sha256('{MODEL}:' || content) as key from (select distinct * from chunks))"


def _id(column: str) -> str:
    t = f"trim({column}, {_B})"
    return f"(case when {t} = '' then null when starts_with({t}, 'external_') then {t} else lower({t}) end)"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_IMPORTS = "case " + " ".join(f"when lang = '{x}' then regexp_extract_all(content, '{_quoted(p)}', 1)" for x, p in chunking.IMPORTS.items()) + " end"
_FIRST = "row_number() over (partition by {keys} order by {order})"

ORACLE = {
    "q_language_detect": f"with {_F} select {_LANG} as detected, language, count(*) as n from f group by 1, 2",
    "q_path_excludes": f"""with {_F} select repo_name, file_path, {_EXCLUDED} as excluded, {_IGNORED} as ignored, {_MINIFIED} as minified,
      len(list_filter(string_split(file_path, '/'), lambda x: starts_with(x, '.'))) > 0 as hidden from f""",
    "q_indexable_files": f"""with {_F} select repo_name, count(*) as n_files, sum(size_bytes)::bigint as n_bytes from f
      where {_LANG} is not null and not {_EXCLUDED} and not {_IGNORED} and not {_MINIFIED} and coalesce(size_bytes, 0) <= 20000 group by 1""",
    "q_incremental_diff": f"with {_DIFF} select * from d",
    "q_removed_files": f"with {_DIFF} select repo_name, file_path from d where status = 'removed'",
    "q_hit_rate": f"""with {_DIFF} select count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status <> 'removed') as present,
      round(count(*) filter (status = 'unchanged') * 100.0::double / count(*) filter (status <> 'removed'), 2) as hit_rate from d""",
    "q_cache_join": f"""with {_KEYED}, o as (select distinct key from k where indexed_at < timestamp '{BEFORE}')
      select language, count(*) filter (key in (select key from o)) as hits, count(*) filter (key not in (select key from o)) as misses
      from k where indexed_at >= timestamp '{BEFORE}' group by 1""",
    "q_index_stats": f"""with {_F} select repo_name, count(*) as n_files, sum(chunk_count)::bigint as n_chunks, sum(size_bytes)::bigint as n_bytes,
      round(sum(size_bytes)::double / 1048576.0::double, 2) as megabytes from f group by 1""",
    "q_get_symbols": f"""with {_C} select repo_name, file_path, coalesce(name, 'anonymous') as name, chunk_type as type, start_line, end_line,
      coalesce(nullif(context, ''), 'N/A') as context from c where contains(lower(chunk_type), 'class')""",
    "q_symbol_types": f"with {_C} select repo_name, file_path, chunk_type, count(*) as n from c group by 1, 2, 3",
    "q_search_text_filter": f"""with {_C} select id, file_path, start_line || '-' || end_line as lines, coalesce(nullif(context, ''), 'N/A') as context from c
      where repo_name = 'atlas-core' and language = 'python' and contains(file_path, 'src/') and chunk_type = 'function_definition'""",
    "q_range_containment": f"""with s as (select distinct repo_name, file_path, id, start_line, end_line from chunks),
      r as (select distinct rel_id, repo_name, source_file, line_number from relationships where {_TYPE} = 'CALLS'),
      m as (select rel_id, id, row_number() over (partition by rel_id order by end_line - start_line, start_line, id) as rn
        from r join s on r.repo_name = s.repo_name and r.source_file = s.file_path and line_number between start_line and end_line)
      select rel_id, id as chunk_id from m where rn = 1""",
    "q_resolve_first_match": f"""with f as (select repo_name, file_path, name, id, row_number() over (partition by repo_name, file_path, name order by start_byte, id) as rn
        from chunks where chunk_type in ('function_definition', 'method_definition') and name is not null),
      r as (select distinct rel_id, repo_name, source_file, target_name from relationships where {_TYPE} = 'CALLS' and {_id("target_id")} is null)
      select rel_id, id as target from r left join f on r.repo_name = f.repo_name and r.source_file = f.file_path and r.target_name = f.name and rn = 1""",
    "q_resolve_bases": f"""with f as (select repo_name, name, id, file_path, row_number() over (partition by repo_name, name order by file_path, start_byte, id) as rn
        from chunks where chunk_type in ('class_definition', 'class_declaration') and name is not null),
      r as (select distinct rel_id, repo_name, target_name from relationships where {_TYPE} in ('EXTENDS', 'IMPLEMENTS'))
      select rel_id, id as target, file_path from r left join f on r.repo_name = f.repo_name and r.target_name = f.name and rn = 1""",
    "q_method_parents": f"""with p as (select repo_name, id, string_split(string_split(nullif(trim(context, {_B}), ''), ' > ')[1], ':') as f from chunks)
      select distinct repo_name, id, f[1] as parent_type, f[2] as parent_name from p where len(f) = 2""",
    "q_chunk_ids": f"""with d as (select distinct repo_name, id, file_path, start_line, content from chunks), m as (select *, substr(sha256(coalesce(file_path, '') || ':' || coalesce(start_line::varchar, '') || ':' || coalesce(content, '')), 1, 16) as made_id from d)
      select repo_name, id, made_id, regexp_replace(rpad(made_id, 32, '0'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as point,
      sha256('{MODEL}:' || content) as cache_key, length(substr(content, 1, 4915))::int as n_embedded from m""",
    "q_header_extract": r"""select * from (select doc_id, nullif(trim(regexp_extract(substr(text, 1, 8192), '(?i)title:[ \t]*([^\r\n]*)', 1)), '') as title from documents) where title is not null""",
    "q_imports": f"""with g as (select distinct repo_name, file_path, content, {_LANG} as lang from files), m as (select distinct repo_name, file_path, lang as language, unnest({_IMPORTS}) as module from g)
      select repo_name, file_path, language, module, starts_with(module, '.') as is_relative from m""",
    "q_chunk_lines": f"""with {_C}, l as (select chunk_type, unnest(string_split(content, chr(10))) as line from c)
      select chunk_type, count(*) as n_lines, count(*) filter (trim(line) = '') as n_blank, max(length(line))::int as longest from l group by 1""",
    "q_framework_case": """select case when dependency_type in ('wordpress_plugin', 'wordpress_theme') then 'wordpress' when contains(lower(name), 'symfony') then 'symfony'
      when contains(lower(name), 'laravel') then 'laravel' when contains(lower(name), 'drupal') then 'drupal' when dependency_type = 'npm_package' then 'nodejs'
      when dependency_type = 'composer_package' then 'php' else 'unknown' end as framework, count(*) as n from dependencies group by 1""",
    "q_list_dependencies": """select name, version, count(*) as n_entries, min(dependency_type) as dependency_type,
      coalesce(array_to_string(list_sort(list_distinct(flatten(list(workspaces)))), ','), '') as workspaces from dependencies group by 1, 2""",
    "q_dep_condensed": """select category, coalesce(name, slug, 'unknown') as name, coalesce(version, 'unknown') as version,
      case when category in ('plugins', 'themes') then slug end as slug from dependencies""",
    "q_dep_summary_rollup": "select case when grouping(category) = 1 then 'total' else category end as category, count(*) as n from dependencies group by rollup (category)",
    "q_link_workspace": f"""select category, name, version, array_to_string(case when lower(trim(name, {_B})) = 'quillbox' and not list_contains(coalesce(workspaces, []), 'ws-9')
      then list_append(coalesce(workspaces, []), 'ws-9') else workspaces end, ',') as workspaces from dependencies""",
    "q_dependency_exists_semi": """select category, name, version from dependencies where lower(trim(name)) in (select lower(trim(dependency_name)) from files where dependency_name is not null)""",
    "q_dependency_lookup": f"""with d as (select *, case category when 'plugins' then 1 when 'themes' then 2 when 'composer' then 3 when 'npm' then 4 else 99 end as r from dependencies),
      k as (select lower(trim(name, {_B})) as key, r, category, name, version, dependency_path from d union all select lower(trim(slug, {_B})), r, category, name, version, dependency_path from d),
      b as (select *, row_number() over (partition by key order by r, name nulls first, version nulls first, dependency_path nulls first) as rn from k where key is not null and key <> ''),
      q as (select distinct lower(trim(dependency_name, {_B})) as key from files where dependency_name is not null)
      select key, category, dependency_path from q join b using (key) where rn = 1""",
    "q_json_props": f"""with r as (select distinct rel_id, relationship_type, metadata from relationships)
      select {_TYPE} as type, json_extract_string(metadata, '$.language') as language, json_extract_string(metadata, '$.is_relative') as is_relative, count(*) as n,
      count(json_extract_string(metadata, '$.import_alias')) as n_aliased from r group by 1, 2, 3""",
    "q_job_status": """with j as (select distinct on (job_id) * from jobs)
      select job_id, repo_name, status, coalesce(round(progress.current_file::double / nullif(progress.total_files, 0) * 100, 2), 0.0) as percent_done,
      printf('%.2f%%', coalesce(progress.cache_hit_rate, 0.0)) as cache_hit_rate, (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::double as seconds,
      len(list_distinct(coalesce(progress.failed_files, [])))::int as n_failed,
      array_to_string(list_sort(list_distinct(coalesce(progress.failed_files, [])))[1:5], ', ') as first_failed, status in ('queued', 'running') as can_cancel from j""",
    "q_union_nodes": f"""with {graph_queries._E}, {graph_queries._N}, x as (select distinct dst, type from e where is_external and type is not null),
      l as (select dst, case min(case when type = 'IMPORTS' then 0 when type in ('EXTENDS', 'IMPLEMENTS') then 1 else 2 end) when 0 then 'Module' when 1 then 'Class' else 'Function' end as label from x group by 1)
      select label, 'code' as source, count(*) as n from n where not coalesce(is_external, false) group by 1 union all select label, 'external', count(*) from l group by 1""",
    "q_intersect_ids": f"select {_id('id')} as id from chunks intersect select {_id('id')} from nodes",
    "q_except_ids": f"""with a as (select {_id('id')} as id, count(*) as n from chunks group by 1), b as (select {_id('id')} as id, count(*) as n from nodes group by 1)
      select a.id from a left join b on a.id = b.id where a.n > coalesce(b.n, 0)""",
    "q_rank_frames": f"""with {_C}, s as (select repo_name, file_path, id, start_byte, indexed_at, length(content) as size from c)
      select repo_name, file_path, id, indexed_at, rank() over w::int as rank, dense_rank() over w::int as dense_rank, lag(id) over p as previous,
      (sum(size) over (partition by repo_name, file_path order by start_byte, id, indexed_at rows between 2 preceding and current row))::bigint as moving_size
      from s window w as (partition by repo_name, file_path order by size desc), p as (partition by repo_name, file_path order by start_byte, id, indexed_at)""",
    "q_cube_chunks": f"""with {_C} select language, chunk_type, grouping(language, chunk_type)::bigint as g, count(*) as n, sum(length(content))::bigint as n_chars from c group by cube (language, chunk_type)""",
}
