from __future__ import annotations

import os
import time

import pytest

from codelake.api import Index, response
from codelake.config import EngineConfig

A = "import os\n\nclass Base:\n    def go(self):\n        return load_rows(1)\n\n\ndef load_rows(n):\n    return os.path.join(n)\n"
B = "from a import Base\n\nclass Child(Base):\n    pass\n\n\ndef main():\n    start()\n\n\ndef start():\n    main()\n"


def put(root, name, text):
    os.makedirs(os.path.dirname(os.path.join(root, name)) or root, exist_ok=True)
    with open(os.path.join(root, name), "w") as file:
        file.write(text)


@pytest.fixture()
def index(spark, tmp_path):
    root = str(tmp_path / "repo")
    put(root, "a.py", A)
    put(root, "b.py", B)
    put(root, "empty.py", "")
    own = Index(spark, EngineConfig(warehouse=str(tmp_path / "warehouse")))
    assert own.index_repository(root, "r")["files"] == {"new": 3}
    return own, root


def test_incremental_runs(index):
    own, root = index
    before = {r.id for r in own.table("chunks").collect()}
    assert own.index_repository(root, "r")["files"] == {"unchanged": 3}
    assert {r.id for r in own.table("chunks").collect()} == before
    put(root, "b.py", B.replace("main", "begin"))
    os.remove(os.path.join(root, "a.py"))
    assert own.index_repository(root, "r")["files"] == {"unchanged": 1, "changed": 1, "removed": 1}
    assert {r.name for r in own.table("chunks").collect()} == {"Child", "begin", "start"}
    assert {r.file_path for r in own.table("files").collect()} == {"b.py", "empty.py"}
    assert own.table("edges").where("file_path = 'a.py'").count() == 0


def test_tools(index):
    own, _ = index
    best = own.search_code("load rows os path join", limit=2, language="python").collect()
    assert best[0]["rank"] == 1 and "load_rows" in best[0].code
    ids = {r.name: f"r:{r.id}" for r in own.table("chunks").collect()}
    assert [r.name for r in own.get_symbols("b.py", "function").collect()] == ["main", "start"]
    assert [(r.id, r.distance) for r in own.find_callees(ids["main"]).collect()] == [(ids["start"], 1)]
    assert [(r.id, r.distance) for r in own.find_callers(ids["load_rows"]).collect()] == [(ids["Base"], 1)]
    assert {r.id for r in own.class_hierarchy(ids["Child"], "up").collect()} == {"external_Base"}
    assert own.find_usages("load_rows").count() == 1
    assert {(r.dst, r.is_external) for r in own.find_dependencies(ids["main"]).collect()} == {(ids["start"], False)}
    assert own.circular_dependencies("r").count() == 0
    assert own.query_graph("select type, count(*) n from edges group by type").count() == 3
    assert {r.measure: r.value for r in own.indexing_status().collect()}["chunks"] == 5
    assert own.health()["chunks"] and not own.health()["dependencies"]
    assert {r.type for r in own.graph_statistics("r").collect()} == {"CALLS", "EXTENDS", "IMPORTS"}
    assert not response(lambda: own.query_graph("selec"))["success"]
    own.clear()
    assert own.table("chunks").count() == 0


def test_dependencies(index, tmp_path):
    own, _ = index
    root = str(tmp_path / "ws")
    put(root, "package.json", '{"dependencies": {"left": "1.0"}}')
    put(root, "node_modules/left/index.js", "function pad(x) {\n  return x;\n}\n")
    assert own.index_dependencies(["left", "none"], "w1", root) == {"requested": 2, "linked": 0, "indexed": 1}
    assert own.index_dependencies(["left"], "w2", root) == {"requested": 1, "linked": 1, "indexed": 0}
    assert [(r.name, list(r.workspaces)) for r in own.list_dependencies().collect()] == [("left", ["w1", "w2"])]
    assert {r.name for r in own.table("chunks").where("repo_name = 'dependency:left'").collect()} == {"pad"}


def test_circular_imports_and_watching(index, spark, tmp_path):
    own, root = index
    put(root, "pkg/x.py", "from pkg import y\nimport pkg.y\n")
    put(root, "pkg/y.py", "from .x import z\n")
    query = own.watch(root, "r", str(tmp_path / "watch"))
    try:
        for _ in range(300):
            if own.table("files").where("file_path like 'pkg/%'").count() == 2:
                break
            time.sleep(0.2)
        assert own.watcher_status()["r"]["running"]
    finally:
        query.stop()
    assert [r.cycle for r in own.circular_dependencies("r").collect()] == [["file:r:pkg/x.py", "file:r:pkg/y.py"]]


def test_background_job(index):
    own, root = index
    job_id = own.submit(root, "again")
    for _ in range(600):
        row = own.job_status(job_id).first()
        if row.status in ("completed", "failed"):
            break
        time.sleep(0.1)
    assert row.status == "completed"
    assert not own.cancel_job(job_id)["cancelled"]
