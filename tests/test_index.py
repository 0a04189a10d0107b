from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from codelake.functions import paths, text
from codelake.operators import chunking, embedding, incremental, jobs, knowledge, vectors
from codelake.sources import manifests, srctree, state
from codelake.streaming import changes

PYTHON = "import os\nfrom . import util\n\ndef a(x):\n    return b(x)\n\ndef b(x):\n    return os.path.join(x)\n\nclass C(Base):\n    def m(self):\n        return a(1)\n\na(0)\n"


def test_python_chunks():
    got = [(c["chunk_type"], c["name"], c["start_line"], c["end_line"], c["context"]) for c in chunking.chunk(PYTHON, "python", 2048)]
    assert got == [("function_definition", "a", 4, 5, ""), ("function_definition", "b", 7, 8, ""), ("class_definition", "C", 10, 12, "")]
    got = [(c["chunk_type"], c["name"], c["start_line"], c["end_line"], c["context"]) for c in chunking.chunk(PYTHON, "python", 40)]
    assert got == [("function_definition", "a", 4, 5, ""), ("function_definition", "b", 7, 8, ""), ("function_definition", "m", 11, 12, "class_definition:C")]


def test_decorated():
    assert [(c["chunk_type"], c["name"], c["start_line"]) for c in chunking.chunk("@d\n@e(1)\ndef f():\n    pass\n", "python", 2048)] == [("decorated_definition", "f", 1)]


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("javascript", "class A {\n  m(x) { return '}'; }\n}\nfunction f() { return /[{]/.test(x); }\n", [("class_declaration", "A"), ("method_definition", "m"), ("function_declaration", "f")]),
        ("typescript", "interface I { a: string }\ntype T = string;\nfunction g(a: number): void { if (a) { h(); } }\n", [("interface_declaration", "I"), ("type_alias_declaration", "T"), ("function_declaration", "g")]),
        ("php", "<?php\nclass A {\n  public function m() { return 1; }\n}\ninterface I {}\ntrait R {}\nfunction f() {}\n", [("class_declaration", "A"), ("method_declaration", "m"), ("interface_declaration", "I"), ("trait_declaration", "R"), ("function_definition", "f")]),
        ("go", "package p\ntype T struct { a int }\nfunc (t *T) M() int { return 1 }\nfunc F() {}\n", [("type_declaration", "T"), ("method_declaration", "M"), ("function_declaration", "F")]),
        ("rust", "struct S { a: i32 }\nimpl S {\n    fn m<'a>(&'a self) -> char { '}' }\n}\ntrait R {}\nenum E { A }\n", [("struct_item", "S"), ("impl_item", "S"), ("function_item", "m"), ("trait_item", "R"), ("enum_item", "E")]),
        ("java", "class A {\n    public int m(int x) { if (x > 1) { return 2; } return 1; }\n}\ninterface I {}\nenum E { X }\n", [("class_declaration", "A"), ("method_declaration", "m"), ("interface_declaration", "I"), ("enum_declaration", "E")]),
        ("csharp", "class A {\n    int M(int x) { return 1; }\n}\nstruct S {}\n", [("class_declaration", "A"), ("method_declaration", "M"), ("struct_declaration", "S")]),
        ("cpp", "namespace n {\nclass A { public: int x; };\nint f(const A& a) { return 1; }\n}\n", [("namespace_definition", "n"), ("class_specifier", "A"), ("function_definition", "f")]),
        ("c", "struct S { int a; };\nstatic int f(int x) { return x; }\n", [("struct_specifier", "S"), ("function_definition", "f")]),
    ],
)
def test_definitions(language, code, want):
    assert [(kind, name) for _, _, kind, name in chunking.definitions(code, language)] == want


def test_chunks_of_odd_files(spark):
    rows = [("r", "a.py", PYTHON, "x"), ("r", "a.py", PYTHON, "x"), ("r", "b.py", None, "x"), ("r", "c.py", "", "x"), ("r", "d.txt", "def f(): pass", "x"), (None, "E.PY", "def é():\n  return 1\r\n", "x"), ("r", "long.js", "function f() { " + "x();" * 60_000 + " }", "x")]
    files = spark.createDataFrame(rows, "repo_name string, file_path string, content string, id string")
    found = chunking.chunk_files(files, 1 << 20).collect()
    assert sorted((r.file_path, r.name) for r in found) == [("E.PY", "é"), ("a.py", "C"), ("a.py", "a"), ("a.py", "b"), ("long.js", "f")]
    assert all(len(r.id) == 16 for r in found)


def test_relations_of_chunks(spark):
    files = spark.createDataFrame([("r", "a.py", PYTHON)], "repo_name string, file_path string, content string")
    chunks = chunking.chunk_files(files).cache()
    names = {r.id: r.name for r in chunks.collect()}
    found = {(names[r.id], r.callee, r.line, names.get(r.target_id)) for r in chunking.resolve_calls(chunking.calls(chunks), chunks).collect()}
    assert {("a", "b", 5, "b"), ("b", "join", 8, None), ("C", "a", 12, "a")} <= found
    assert {(names[r.id], r.base, r.type) for r in chunking.bases(chunks).collect()} == {("C", "Base", "EXTENDS")}
    assert {(r.module, r.is_relative) for r in chunking.imports(files).collect()} == {("os", False), (".", True)}


def test_diff(spark):
    schema = "repo_name string, file_path string, content_hash string"
    old = spark.createDataFrame([("r", "a", "h1"), ("r", "b", "h2"), ("r", "c", "h3"), ("r", "c", "h3")], schema)
    new = spark.createDataFrame([("r", "a", "h1"), ("r", "b", "h9"), ("r", "d", "h4")], schema)
    assert {(r.file_path, r.status) for r in incremental.diff(old, new).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")}
    assert incremental.hit_rate(incremental.diff(old, new)).first().hit_rate == 33.33
    assert incremental.hit_rate(incremental.diff(old.limit(0), new.limit(0))).first().hit_rate == 0.0
    assert [r.file_path for r in incremental.removed_files(old, new).collect()] == ["c"]


def test_path_rules(spark):
    def one(path, column):
        return spark.createDataFrame([(path,)], "p string").select(column.alias("x")).first().x

    p = F.col("p")
    for pattern, path, want in [("lib/*", "lib/x/y.py", True), ("lib/", "lib/y.py", True), ("src/gen", "src/gen/y.py", True), ("/lib", "lib/y.py", False), ("tmp", "a/tmp/y.py", True), ("*.log", "a.log", False), ("!keep.py", "keep.py", False)]:
        assert one(path, paths.gitignored(p, [pattern])) is want
    for pattern, path, want in [("lib/**", "lib/x/y.py", True), ("lib/*", "lib/y.py", True), ("lib/*", "lib/x/y.py", False), ("*.test.js", "a/b/c.test.js", True), ("docs", "docs/a.py", True), ("x", "vendor/a.php", True), ("x", "node_modules/a.js", True), ("x", "src/a.js", False)]:
        assert one(path, paths.excluded(p, [pattern])) is want
    assert one("a/B.PY", paths.language(p)) == "python" and one("x.h", paths.language(p)) == "c" and one("py", paths.language(p)) is None


def test_scalars(spark):
    row = spark.createDataFrame([("Plugin Name:  Fine \nVersion:\n", "0123456789abcdef")], "t string, h string")
    got = row.select(text.header_field(F.col("t"), "Plugin Name").alias("a"), text.header_field(F.col("t"), "Version").alias("b"), text.point_uuid(F.col("h")).alias("c"), text.percent(F.lit(1), F.lit(3)).alias("d"), text.percent(F.lit(1), F.lit(0)).alias("e")).first()
    assert tuple(got) == ("Fine", None, "01234567-89ab-cdef-0000-000000000000", 33.33, 0.0)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, 0.0], 1), (7, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert [(r.rank, r.vec_id, r.score) for r in vectors.top_k(df, [1.0, 0.0], 3).collect()] == [(1, 1, 1.0), (2, 6, 1.0), (3, 3, 0.7071)]
    near = {(r.query_id, r["rank"]): r.id for r in vectors.knn(df, df.where("vec_id in (1, 4, 5)"), 2).collect()}
    assert near == {(1, 1): 6, (1, 2): 3}
    assert vectors.knn(df, df.limit(0)).count() == 0


def test_embedding_uses_its_cache(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "..."), (5, "c")], "id int, content string")
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>")
    whole, fresh = embedding.embed(rows, empty, embedding.hashing_embedder(8), "m")
    assert {r.id: r.embedding is not None for r in whole.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert fresh.count() == 2
    again, none = embedding.embed(rows, fresh, embedding.hashing_embedder(8), "m")
    assert none.count() == 0 and again.where("cached").count() == 3


def test_jobs(spark):
    registry = jobs.Registry(spark)
    done, broken, waiting = registry.create("r", "/r"), registry.create("r", "/r"), registry.create("r", "/r")
    registry.update(done, current_file=1, total_files=3)
    registry.run(done, lambda: spark.range(3).count()).join()
    registry.run(broken, lambda: 1 / 0).join()
    assert registry.cancel(waiting) and not registry.cancel(done)
    got = {r.job_id: (r.status, r.percent_done) for r in jobs.status(registry.table()).collect()}
    assert got == {done: ("completed", 33.33), broken: ("failed", 0.0), waiting: ("cancelled", 0.0)}


def write(root, name, content):
    full = os.path.join(root, name)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as file:
        file.write(content if isinstance(content, bytes) else content.encode())


def test_source_tree(spark, tmp_path):
    root = str(tmp_path)
    for name, content in {"a.py": "x = 1\n", "pkg/__init__.py": "", ".hid/b.py": "y", "c.min.js": "z", "d.txt": "t", "E.PY": "w", "bad.py": b"\xff\xfe", "big.py": "x" * 600_000, "ign/f.py": "q", "vendor/g.php": "<?php"}.items():
        write(root, name, content)
    write(root, ".gitignore", "# none\n\nign/\n")
    got = {r.file_path: r.content for r in srctree.read_tree(spark, root, "r").collect()}
    assert got == {"a.py": "x = 1\n", "pkg/__init__.py": "", ".hid/b.py": "y", "E.PY": "w", "bad.py": None}


def test_manifests(spark, tmp_path):
    root = str(tmp_path)
    write(root, "composer.lock", '{"packages": [{"name": "a/b", "version": "1.0"}, {"name": "no/where", "version": "2"}], "packages-dev": [{"name": "c/d"}]}')
    write(root, "vendor/a/b/x.php", "")
    write(root, "package.json", '{"dependencies": {"left": "^1", "both": "1"}, "devDependencies": {"both": "2", "@s/p": "3", "gone": "1"}}')
    for name in ("left", "both", "@s/p"):
        write(root, f"node_modules/{name}/index.js", "")
    write(root, "node_modules/left/package.json", '{"version": "1.4.0"}')
    write(root, "wp-content/plugins/one/main.php", "<?php /*\nPlugin Name: One\nVersion: 2\n*/")
    write(root, "wp-content/plugins/two/main.php", "<?php /*\nPlugin Name: Two\n*/")
    write(root, "wp-content/themes/th/style.css", "/*\nTheme Name: Th\n*/")
    got = {(r.category, r.name, r.version) for r in manifests.detect(spark, root).collect()}
    assert got == {("composer", "a/b", "1.0"), ("npm", "left", "1.4.0"), ("npm", "both", "2"), ("npm", "@s/p", "3"), ("plugins", "One", "2"), ("themes", "Th", "unknown")}


def test_state_survives_reading_itself(spark, tmp_path):
    path = str(tmp_path / "s")
    assert state.read(spark, path, "a int").count() == 0
    state.replace((spark.range(3).selectExpr("cast(id as int) a"), path))
    state.replace((state.read(spark, path, "a int").where("a > 0"), path))
    assert sorted(r.a for r in state.read(spark, path, "a int").collect()) == [1, 2]
    state.clear(spark, path)
    assert not state.exists(spark, path)


def test_debounce(spark):
    rows = [("r", 1, "x", "modified", "2025-01-01 00:00:00"), ("r", 2, "x", "modified", "2025-01-01 00:00:00.5"), ("r", 3, "y", "modified", "2025-01-01 00:00:01"), ("r", 4, "y", "deleted", "2025-01-01 00:00:01.5"), ("r", 5, "z", "modified", "2025-01-01 00:00:05"), ("r", 6, "z", "modified", None)]
    events = spark.createDataFrame(rows, "repo_name string, seq int, file_path string, op string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r.n_events for r in changes.sessions(events, ["repo_name"]).collect()) == [1, 4]
    last = changes.last_operations(events, ["repo_name"], "file_path", "op", "ts", "seq")
    assert sorted((r.file_path, r.op) for r in last.collect()) == [("x", "modified"), ("y", "deleted"), ("z", "modified")]


def test_moves_are_two_changes(spark):
    rows = [(1, "a", "moved", "b", False), (2, "c", "created", None, None), (3, "d", "modified", None, True)]
    events = spark.createDataFrame(rows, "seq int, file_path string, op string, dest_path string, is_folder boolean").withColumn("ts", F.current_timestamp())
    assert sorted((r.op, r.file_path) for r in changes.flattened(events).collect()) == [("deleted", "a"), ("modified", "b"), ("modified", "c")]


def test_changes_of_a_tree_are_streamed(spark, tmp_path):
    spark.dataSource.register(srctree.SourceTree)
    root = str(tmp_path / "tree")
    write(root, "a.py", "1")
    write(root, "b.py", "1")
    seen = []

    def apply(deleted, modified):
        seen.append(({r.file_path for r in deleted.collect()}, {r.file_path for r in modified.collect()}))

    stream = spark.readStream.format("srctree").option("changes", "true").load(root)
    query = changes.apply_changes(stream, apply, str(tmp_path / "check"), processingTime="0 seconds")
    try:
        deadline = time.time() + 60
        while not seen and time.time() < deadline:
            time.sleep(0.2)
        write(root, "b.py", "12")
        os.remove(os.path.join(root, "a.py"))
        while {"a.py"} not in [d for d, _ in seen] and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[0] == (set(), {"a.py", "b.py"})
    assert {"a.py"} in [d for d, _ in seen] and {"b.py"} in [m for _, m in seen[1:]]


def test_inventory(spark):
    rows = [("npm", "npm_package", "A", "1", None, ["w1"]), ("npm", "npm_package", "A", "1", None, None), ("plugins", "wordpress_plugin", "b", None, "a", ["w2", "w1"])]
    df = spark.createDataFrame(rows, "category string, dependency_type string, name string, version string, slug string, workspaces array<string>").withColumn("dependency_path", F.lit("p"))
    assert {(r.name, r.n_entries, tuple(r.workspaces)) for r in knowledge.rollup(df).collect()} == {("A", 2, ("w1",)), ("b", 1, ("w1", "w2"))}
    asked = spark.createDataFrame([("a",), ("zz",), (None,)], "name string")
    assert [(r.key, r.category) for r in knowledge.look_up(asked, df).collect()] == [("a", "plugins")]
