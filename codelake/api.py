"""The tool surface: one method per tool, each returning a DataFrame over the index's tables (or a plain dict of states)."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelake.config import EngineConfig
from codelake.functions import paths
from codelake.operators import chunking, embedding, incremental, jobs, knowledge, vectors
from codelake.operators import graph as G
from codelake.operators.hierarchy import hierarchy
from codelake.sources import manifests, srctree, state
from codelake.streaming import changes

FILES = "repo_name string, file_path string, language string, size_bytes bigint, content_hash string"
CHUNKS = (
    "id string, repo_name string, file_path string, language string, start_line int, end_line int, start_byte int, end_byte int, chunk_type string, name string, "
    "content string, context string, cache_key string, embedding array<float>"
)
EDGES = "src string, dst string, type string, line int, repo_name string, file_path string"
CACHE = "cache_key string, embedding array<float>"
DEPENDENCIES = "category string, dependency_type string, name string, version string, slug string, description string, author string, dependency_path string, workspaces array<string>"


def response(work: Callable[[], DataFrame | dict]) -> dict:
    """The envelope of a tool's answer: its rows, or the error as text."""
    try:
        made = work()
        return {"success": True} | (made if isinstance(made, dict) else {"results": [r.asDict(True) for r in made.collect()]})
    except Exception as e:  # tools answer errors, they do not raise them
        return {"success": False, "error": str(e)}


class Index:
    """An index in one folder: files, chunks with embeddings, edges, cache and dependencies as Parquet tables."""

    def __init__(self, spark: SparkSession, config: EngineConfig, embedder: embedding.Embedder | None = None):
        self.spark, self.config = spark, config
        self.embedder = embedder or embedding.hashing_embedder()
        self.registry = jobs.Registry(spark)
        self.watchers: dict[str, StreamingQuery] = {}

    def path(self, name: str) -> str:
        return f"{self.config.warehouse}/{name}"

    def table(self, name: str) -> DataFrame:
        schema = {"files": FILES, "chunks": CHUNKS, "edges": EDGES, "cache": CACHE, "dependencies": DEPENDENCIES}[name]
        return state.read(self.spark, self.path(name), schema)

    # writing -------------------------------------------------------------------------------------------------------

    def index_repository(self, root: str, repo_name: str, incremental_run: bool = True, exclude: tuple[str, ...] = ()) -> dict:
        """Scans a tree and brings the tables up to date: only new and changed files are read anew, removed ones drop out.

        A full run replaces the repository whole. Files without chunks are recorded too; nothing is recorded if a step
        fails, since each table is written beside the old one first.
        """
        current = srctree.read_tree(self.spark, root, repo_name, (*self.config.exclude_patterns, *exclude), self.config.max_file_bytes).persist()
        try:
            recorded = self.table("files")
            before = recorded.where(F.col("repo_name") == repo_name)
            changed = incremental.diff(before, current)
            if not incremental_run:
                changed = changed.withColumn("status", F.when(F.col("status") == "unchanged", "changed").otherwise(F.col("status")))
            changed = changed.persist()
            touched = changed.where("status != 'unchanged'")
            fresh = current.join(touched.select(*incremental.KEY), incremental.KEY, "left_semi")
            made = chunking.chunk_files(fresh, self.config.max_chunk_size)
            embedded, entries = embedding.embed(made, self.table("cache"), self.embedder, self.config.embed_model, limit=self.config.embed_chars)
            chunks = incremental.replace_files(self.table("chunks"), touched, embedded.drop("cached"))
            links = incremental.replace_files(self.table("edges"), touched, self._edges(made, fresh))
            counts = {r.status: r["count"] for r in changed.groupBy("status").count().collect()}
            state.replace(
                (self.table("cache").unionByName(entries), self.path("cache")),
                (links, self.path("edges")),
                (chunks, self.path("chunks")),
                (incremental.replace_files(recorded, touched, fresh.drop("content")), self.path("files")),
            )
            return {"repo_name": repo_name, "files": counts}
        finally:
            current.unpersist()

    def _edges(self, chunks: DataFrame, files: DataFrame) -> DataFrame:
        """CALLS, EXTENDS, IMPLEMENTS, IMPORTS and BELONGS_TO of the chunks; unresolved ends are external nodes."""
        key = lambda c: F.concat("repo_name", F.lit(":"), c)
        external = lambda c: F.concat(F.lit(G.EXTERNAL), c)
        place = chunks.select("repo_name", "id", "file_path")
        calls = chunking.resolve_calls(chunking.calls(chunks), chunks).select(
            key("id").alias("src"), F.coalesce(key("target_id"), external("callee")).alias("dst"), F.lit("CALLS").alias("type"), F.col("line").cast("int").alias("line"), "repo_name", "file_path"
        )
        classes = chunks.where(F.col("chunk_type").rlike("^class")).select("repo_name", "file_path", F.col("name").alias("base"), "start_byte", F.col("id").alias("base_id"))
        parents = G.first_match(chunking.bases(chunks).join(place, ["repo_name", "id"]), classes, ["repo_name", "file_path", "base"], ["start_byte", "base_id"], ["base_id"])
        extends = parents.select(key("id").alias("src"), F.coalesce(key("base_id"), external("base")).alias("dst"), "type", F.lit(None).cast("int").alias("line"), "repo_name", "file_path")
        modules = chunking.imports(files).select(F.concat(F.lit("file:"), key("file_path")).alias("src"), external("module").alias("dst"), F.lit("IMPORTS").alias("type"), F.lit(None).cast("int").alias("line"), "repo_name", "file_path")
        members = chunking.parent_of_context(chunks).join(place, ["repo_name", "id"])
        belongs = members.select(key("id").alias("src"), F.concat(key("file_path"), F.lit(":"), "parent_name").alias("dst"), F.lit("BELONGS_TO").alias("type"), F.lit(None).cast("int").alias("line"), "repo_name", "file_path")
        return calls.unionByName(extends).unionByName(modules).unionByName(belongs)

    def submit(self, root: str, repo_name: str, incremental_run: bool = True, exclude: tuple[str, ...] = ()) -> str:
        """Indexes in the background; the job's id."""
        job_id = self.registry.create(repo_name, root)
        self.registry.run(job_id, lambda: self.index_repository(root, repo_name, incremental_run, exclude))
        return job_id

    def apply_changes(self, root: str, repo_name: str) -> Callable[[DataFrame, DataFrame], None]:
        """What a stream of file changes calls for each batch: brings the repository up to date if it changed at all."""

        def apply(deleted: DataFrame, modified: DataFrame) -> None:
            if deleted.unionByName(modified).limit(1).count():
                self.index_repository(root, repo_name)

        return apply

    def watch(self, root: str, repo_name: str, checkpoint: str) -> StreamingQuery:
        """Follows the changes of a tree and applies them; the stream's own methods stop it and tell its state."""
        self.spark.dataSource.register(srctree.SourceTree)
        stream = self.spark.readStream.format("srctree").option("changes", "true").load(root).where(paths.watched(F.col("file_path")))
        every = f"{self.config.debounce_seconds} seconds"
        self.watchers[repo_name] = changes.apply_changes(stream, self.apply_changes(root, repo_name), checkpoint, processingTime=every)
        return self.watchers[repo_name]

    def watcher_status(self) -> dict:
        return {name: {"running": q.isActive, "message": q.status["message"]} for name, q in self.watchers.items()}

    def clear(self, dependencies: bool = False) -> dict:
        for name in ("files", "chunks", "edges", "cache", *(["dependencies"] if dependencies else [])):
            state.clear(self.spark, self.path(name))
        return {"cleared": True}

    # reading -------------------------------------------------------------------------------------------------------

    def search_code(self, query: str, limit: int | None = None, repo_name: str | None = None, language: str | None = None, file_path_filter: str | None = None, chunk_type: str | None = None) -> DataFrame:
        vector = self.embedder([query])[0]
        rows = chunking.search(self.table("chunks"), repo_name, language, file_path_filter, chunk_type)
        if vector is None:
            return rows.limit(0)
        best = vectors.top_k(rows, vector, limit or self.config.top_k, id_column="id")
        return best.select("rank", "score", "repo_name", "file_path", F.concat_ws("-", "start_line", "end_line").alias("lines"), "language", F.col("chunk_type").alias("type"), F.coalesce(F.nullif("context", F.lit("")), F.lit("N/A")).alias("context"), F.col("content").alias("code"), "id")

    def get_symbols(self, file_path: str, symbol_type: str | None = None) -> DataFrame:
        return chunking.symbols(self.table("chunks").where(F.col("file_path") == file_path), symbol_type).orderBy("start_line")

    def indexing_status(self) -> DataFrame:
        """(measure, value): files and their bytes, chunks and their vectors, cached embeddings."""
        counts = [("files", "files", F.count("*")), ("bytes", "files", F.coalesce(F.sum("size_bytes"), F.lit(0))), ("chunks", "chunks", F.count("*")), ("vectors", "chunks", F.count("embedding")), ("cached", "cache", F.count("*"))]
        rows = [self.table(name).agg(value.cast("bigint").alias("value")).select(F.lit(measure).alias("measure"), "value") for measure, name, value in counts]
        return reduce(DataFrame.unionByName, rows)

    def health(self) -> dict:
        return {name: state.exists(self.spark, self.path(name)) for name in ("files", "chunks", "edges", "cache", "dependencies")} | {"spark": self.spark.sql("select 1").first()[0] == 1}

    def job_status(self, job_id: str | None = None) -> DataFrame:
        rows = jobs.status(self.registry.table())
        return rows if job_id is None else rows.where(F.col("job_id") == job_id)

    def cancel_job(self, job_id: str) -> dict:
        return {"cancelled": self.registry.cancel(job_id)}

    def detect_dependencies(self, workspace: str) -> DataFrame:
        return knowledge.condensed(manifests.detect(self.spark, workspace))

    def index_dependencies(self, names: list[str], workspace_id: str, workspace: str) -> dict:
        """Puts named dependencies of a workspace into the inventory, or links the workspace to those of the same version; chunks of their files join the index."""
        detected = manifests.detect(self.spark, workspace)
        asked = self.spark.createDataFrame([(n,) for n in names], "name string")
        found = knowledge.look_up(asked, detected).persist()
        known = self.table("dependencies")
        old = knowledge.indexed_already(found, known).select("name", "version").distinct()
        link = F.array_union(F.coalesce("workspaces", F.array().cast("array<string>")), F.array(F.lit(workspace_id)))
        linked = known.join(old.withColumn("__hit", F.lit(True)), ["name", "version"], "left").withColumn("workspaces", F.when(F.col("__hit"), link).otherwise(F.col("workspaces"))).drop("__hit")
        new = detected.join(found.join(old, ["name", "version"], "left_anti").select("name", "version"), ["name", "version"], "left_semi").withColumn("workspaces", F.array(F.lit(workspace_id)))
        new = new.persist()
        folders = [(r.name, r.dependency_path) for r in new.select("name", "dependency_path").distinct().collect()]
        n_linked = old.count()
        state.replace((linked.unionByName(new.select(linked.columns)), self.path("dependencies")))
        for name, folder in folders:
            self.index_repository(os.path.join(workspace, folder), f"dependency:{name}", exclude=tuple(f"{x}/**" for x in paths.DEPENDENCY_SKIPPED))
        return {"requested": len(names), "linked": n_linked, "indexed": len(folders)}

    def list_dependencies(self) -> DataFrame:
        return knowledge.rollup(self.table("dependencies"))

    # graph ---------------------------------------------------------------------------------------------------------

    def _start(self, node_id: str) -> DataFrame:
        return self.spark.createDataFrame([(node_id,)], "id string")

    def _calls(self) -> DataFrame:
        return self.table("edges").where("type = 'CALLS'")

    def call_graph(self, function_id: str, max_depth: int | None = None, direction: str = "both") -> DataFrame:
        return G.call_graph(self._calls(), self._start(function_id), max_depth or self.config.graph_depth, direction)

    def find_callers(self, function_id: str, max_depth: int | None = None) -> DataFrame:
        return G.reach(self._calls(), self._start(function_id), max_depth or self.config.call_depth, "in").select("id", "distance").orderBy("distance", "id")

    def find_callees(self, function_id: str, max_depth: int | None = None) -> DataFrame:
        return G.reach(self._calls(), self._start(function_id), max_depth or self.config.call_depth).select("id", "distance").orderBy("distance", "id")

    def find_usages(self, entity: str, repo_name: str | None = None) -> DataFrame:
        """Uses of a node by its id, or of all nodes of that name."""
        named = self.table("chunks").where(F.col("name") == entity).select(F.concat("repo_name", F.lit(":"), "id").alias("dst"))
        targets = named.union(self.spark.createDataFrame([(entity,), (G.EXTERNAL + entity,)], "dst string")).distinct()
        rows = self.table("edges").where(F.col("type").isin(*G.USAGE_TYPES)).join(targets, "dst", "left_semi")
        return rows if repo_name is None else rows.where(F.col("repo_name") == repo_name)

    def class_hierarchy(self, class_id: str, direction: str = "both") -> DataFrame:
        extends = self.table("edges").where("type = 'EXTENDS'")
        up = G.reach(extends, self._start(class_id), None).select(F.lit("up").alias("direction"), "id", "distance")
        down = G.reach(extends, self._start(class_id), None, "in").select(F.lit("down").alias("direction"), "id", "distance")
        return {"up": up, "down": down, "both": up.unionByName(down)}[direction]

    def hierarchies(self) -> DataFrame:
        """Every class with its root, depth, path and descendant interval."""
        return hierarchy(self.table("edges").where("type = 'EXTENDS'").groupBy(F.col("src").alias("child")).agg(F.min("dst").alias("parent")))

    def circular_dependencies(self, repo_name: str | None = None, max_length: int = 8) -> DataFrame:
        """Files of a repository that import each other in a circle."""
        rows = self.table("edges").where("type = 'IMPORTS'")
        rows = rows if repo_name is None else rows.where(F.col("repo_name") == repo_name)
        files = self.table("files")
        language = paths.language(F.col("file_path")).alias("language")
        imported = rows.select("repo_name", "file_path", language, F.substring("dst", len(G.EXTERNAL) + 1, 1 << 20).alias("module"))
        key = lambda c: F.concat(F.lit("file:"), "repo_name", F.lit(":"), c)
        return G.cycles(chunking.file_imports(imported, files).select(key("file_path").alias("src"), key("target_path").alias("dst")), max_length)

    def graph_statistics(self, repo_name: str | None = None) -> DataFrame:
        edges = self.table("edges") if repo_name is None else self.table("edges").where(F.col("repo_name") == repo_name)
        return edges.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("dst").startswith(G.EXTERNAL)).alias("n_external"))

    def find_dependencies(self, node_id: str) -> DataFrame:
        return self.table("edges").where(F.col("src") == node_id).select("dst", "type", F.col("dst").startswith(G.EXTERNAL).alias("is_external")).distinct()

    def query_graph(self, sql: str, limit: int = 100) -> DataFrame:
        """SQL over the views files, chunks, edges and dependencies."""
        for name in ("files", "chunks", "edges", "dependencies"):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql).limit(limit)
