from __future__ import annotations

import random

from pyspark.sql import functions as F

from codelake.operators import chunking
from codelake.operators.running import running_before


def test_running_before_equals_brute_force(spark):
    rng = random.Random(6)
    # one key holds most rows
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), n, rng.choice([None, 1, 2, 5])) for n in range(500)]
    df = spark.createDataFrame(rows, "k string, n int, v int").where("k is not null")
    found = {r.n: r.before for r in running_before(df, ["k"], ["n"], "v", F.floor(F.col("n") / 16), "before").collect()}
    for k, n, _ in rows:
        if k is not None:
            assert found[n] == sum(v or 0 for a, b, v in rows if a == k and b < n)
    assert running_before(df.limit(0), ["k"], ["n"], "v", F.lit(0), "before").count() == 0


def test_file_imports(spark):
    files = spark.createDataFrame([("r", p) for p in ("a/b.py", "a/c/__init__.py", "a/d.js", "a/e/f.ts", "g.h")] + [("s", "a/b.py")], "repo_name string, file_path string")
    rows = [("r", "x.py", "python", "a.b"), ("r", "a/b.py", "python", ".c"), ("r", "a/b.py", "python", "a.b"), ("r", "a/e/f.ts", "typescript", "../d"), ("r", "a/d.js", "javascript", "./e/f"), ("r", "a/d.js", "javascript", "react"), ("r", "q.c", "c", "g.h"), ("r", "n.py", "python", None)]
    found = spark.createDataFrame(rows, "repo_name string, file_path string, language string, module string")
    got = {(r.file_path, r.target_path) for r in chunking.file_imports(found, files).collect()}
    assert got == {("x.py", "a/b.py"), ("a/b.py", "a/c/__init__.py"), ("a/e/f.ts", "a/d.js"), ("a/d.js", "a/e/f.ts"), ("q.c", "g.h")}


def test_register_a_language(spark):
    chunking.register("ruby", [("method", r"def\s+(\w+)\s*(?=\{)")], r"(?m)^require[ \t]+'([^']+)'", (".rb",))
    try:
        assert [d[2:] for d in chunking.definitions("def go {\n}\n", "ruby")] == [("method", "go")]
        assert "ruby" in chunking.registered() and chunking.extractor("ruby")[1] and chunking.extractor("none") == ([], None)
        files = spark.createDataFrame([("r", "a.RB", "def go {\n}\n")], "repo_name string, file_path string, content string")
        assert [(r.language, r.chunk_type, r.name) for r in chunking.chunk_files(files).collect()] == [("ruby", "method", "go")]
    finally:
        del chunking.DEFINITIONS["ruby"], chunking.IMPORTS["ruby"], chunking.REGISTERED[".rb"]


def test_calls_are_code(spark):
    text = "def f(a):\n    # see h(1)\n    x = 'call k(2)'\n    return g(f(m(a)))\n"
    rows = [("r", "1", text, "python", "f", 10), ("r", "2", None, "python", None, 1), ("r", "3", "p(q())", None, None, None)]
    chunks = spark.createDataFrame(rows, "repo_name string, id string, content string, language string, name string, start_line int")
    assert {tuple(r) for r in chunking.calls(chunks).collect()} == {("r", "1", "g", 13), ("r", "1", "m", 13), ("r", "3", "p", 1), ("r", "3", "q", 1)}


def test_functions_that_are_values():
    code = "const a = async (x) => {\n  return f(x);\n};\nexports.b = function (y) {\n};\nfunction c() {\n}\n"
    assert [d[2:] for d in chunking.definitions(code, "javascript")] == [("arrow_function", "a"), ("function", "exports.b"), ("function_declaration", "c")]
    assert [d[2:] for d in chunking.definitions("package a\ntype R interface {\n  Do() int\n}\ntype S struct {\n}\n", "go")] == [("interface_type", "R"), ("type_declaration", "S")]
