from __future__ import annotations

import random

import pytest

from codelake.operators import hierarchy as H


def brute(parent):
    out = {}
    for v in {*parent, *parent.values()}:
        path = [v]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:  # its parent is on the path: a cycle
            cycle = path[path.index(parent[path[-1]]) :]
            out[v] = (min(cycle), -1, None)
        else:
            out[v] = (path[-1], len(path) - 1, "/".join(path[::-1]))
    return out


def links(spark, parent):
    return spark.createDataFrame(list(parent.items()) or [], "child string, parent string")


def shapes():
    rng = random.Random(3)
    forest = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 120)}
    chain = {f"c{i}": f"c{i + 1}" for i in range(40)}
    star = {f"s{i}": "hub" for i in range(60)}
    wild = {f"w{i}": f"w{rng.randrange(50)}" for i in range(50)}
    return {"loop": {"x": "x", "y": "x", "a": "b", "b": "a"}, "all": forest | chain | star | wild, "none": {}}


def test_below_cycles(spark):
    parent = {"a": "b", "b": "a", "x": "x", "h": "a", "i": "h", "j": "h", "k": "x", "p": "q"}
    found = {r.node_id: r for r in H.hierarchy(links(spark, parent)).collect()}
    assert {v: r.n_descendants for v, r in found.items()} == {"a": 4, "b": 4, "x": 1, "h": 2, "i": 0, "j": 0, "k": 0, "p": 0, "q": 1}
    assert {tuple(r) for r in H.descendants(H.hierarchy(links(spark, parent))).collect()} == {("a", "h", 1), ("a", "i", 2), ("a", "j", 2), ("h", "i", 1), ("h", "j", 1), ("x", "k", 1), ("q", "p", 1)}


@pytest.mark.parametrize("shape", shapes())
def test_equals_brute_force(spark, shape):
    parent = shapes()[shape]
    want = brute(parent)
    found = {r.node_id: r for r in H.hierarchy(links(spark, parent)).collect()}
    assert {k: (r.root_id, r.depth, r.path) for k, r in found.items()} == want
    short = {r.node_id: (r.root_id, r.depth, r.is_child) for r in H.hierarchy(links(spark, parent), paths=False).collect()}
    assert short == {k: (a, b, k in parent) for k, (a, b, _) in want.items()}
    for v, r in found.items():
        if r.depth < 0:
            continue
        below = {w for w, (_, depth, path) in want.items() if depth > 0 and w != v and v in path.split("/")[:-1]}
        assert r.n_descendants == len(below)
        assert {w for w, x in found.items() if x.root_id == r.root_id and x.depth >= 0 and r.enter < x.enter <= r.leave} == below


def test_descendants(spark):
    forest = H.hierarchy(links(spark, {"b": "a", "c": "b", "d": "a", "z": "z"}))
    of = spark.createDataFrame([("a",), ("b",), ("nobody",)], "node_id string")
    assert {tuple(r) for r in H.descendants(forest, of).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)}


def test_links_from_dirty_relationships(spark):
    rows = [(" A ", "B", "extends ", 1), ("a", "b", "EXTENDS", 1), ("c", None, "EXTENDS", 1), ("d", "  ", "EXTENDS", 2), (None, "x", "EXTENDS", 2), ("e", "f", "CALLS", 1), ("g", "z", "EXTENDS", 1), ("g", "y", "EXTENDS", 1)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, relationship_type string, size int")
    assert {tuple(r) for r in H.parent_links(df).collect()} == {("a", "b"), ("g", "y")}
