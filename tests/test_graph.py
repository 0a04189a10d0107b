from __future__ import annotations

from datetime import datetime

from codelake.operators import graph as G

T = datetime(2025, 1, 1)


def calls(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


EDGES = [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("5", "5")]


def at(spark, key):
    return spark.createDataFrame([(key,)], "id string")


def test_reach(spark):
    edges = calls(spark, EDGES)
    got = lambda *a: {r.id: r.distance for r in G.reach(edges, *a).collect()}
    assert got(at(spark, "1"), 10) == {"2": 1, "3": 2, "4": 3}
    assert got(at(spark, "1"), 2) == {"2": 1, "3": 2}
    assert got(at(spark, "4"), 10, "in") == {"3": 1, "2": 2, "1": 3}
    assert got(at(spark, "6"), 10, "in") == {}
    assert got(at(spark, "4"), 2, "both") == {"3": 1, "1": 2, "2": 2}


def test_call_graph_has_each_edge_once(spark):
    found = [tuple(r) for r in G.call_graph(calls(spark, EDGES + EDGES), at(spark, "1"), 2).collect()]
    assert sorted(found) == [("1", "2"), ("2", "3")]


def test_cycles(spark):
    assert [(r.cycle, r.length) for r in G.cycles(calls(spark, EDGES)).collect()] == [(["1", "2", "3"], 3)]
    two = G.cycles(calls(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "a"), ("a", "a")])).collect()
    assert {tuple(r.cycle) for r in two} == {("a", "b"), ("a", "b", "c")}


def test_traversals_without_an_end(spark):
    ring = [f"r{(n * 7) % 11:02}" for n in range(11)]
    tail = [("t0", "r03"), *((f"t{n}", f"t{n - 1}") for n in range(1, 23))]
    edges = calls(spark, [*zip(ring, ring[1:] + ring[:1], strict=True), *tail, ("x", "x")])
    assert [(r.cycle, r.length) for r in G.cycles(edges, None).collect()] == [(ring, 11)]
    assert max(r.distance for r in G.reach(edges, at(spark, "t22"), None).collect()) == 23 + 10
    many = calls(spark, [*zip(ring, ring[1:] + ring[:1], strict=True), ("r07", "r00")])
    assert {tuple(r.cycle) for r in G.cycles(many, None).collect()} == {tuple(ring), ("r00", "r07")}
    assert G.cycles(calls(spark, EDGES[3:]), None).count() == 0


def test_edges_merge_and_externals(spark):
    rows = [
        (1, "r", " S ", "T", "t", "calls", 3, T), (1, "r", " S ", "T", "t", "calls", 3, T), (2, "r", "s", "t", None, "CALLS ", 9, T), (3, "r", "s", None, "Base", "EXTENDS", 1, T),
        (4, "r", "s", " ", "Base", "CALLS", 2, T), (5, "r", "s", None, None, "CALLS", 2, T), (6, "r", None, "t", None, "CALLS", 2, T),
    ]
    rel = spark.createDataFrame(rows, "rel_id bigint, repo_name string, source_id string, target_id string, target_name string, relationship_type string, line_number int, extracted_at timestamp_ntz")
    merged = {(r.src, r.dst, r.type): (r.call_count, r.first_line, r.last_line, r.line_number) for r in G.merge_edges(G.edges_of(rel)).collect()}
    assert merged == {("s", "t", "CALLS"): (2, 3, 9, 9), ("s", "external_Base", "EXTENDS"): (1, 1, 1, 1), ("s", "external_Base", "CALLS"): (1, 2, 2, 2)}
    assert [tuple(r) for r in G.external_nodes(G.edges_of(rel)).collect()] == [("external_Base", "Class")]


def test_detach_and_collect_externals(spark):
    nodes = spark.createDataFrame([("a", "r", "f1"), ("b", "r", "f2"), ("external_x", None, None)], "id string, repo_name string, file_path string")
    edges = calls(spark, [("a", "b"), ("b", "a"), ("b", "b"), ("a", "external_x")])
    kept, left = G.detach(nodes, edges, spark.createDataFrame([("r", "f1")], "repo_name string, file_path string"))
    assert {r.id for r in kept.collect()} == {"b", "external_x"}
    assert [tuple(r) for r in left.collect()] == [("b", "b")]
    assert {r.id for r in G.without_lonely_externals(kept, left).collect()} == {"b"}


def test_upsert_replaces_whole_rows(spark):
    schema = "k string, v string, w int, seq int"
    now = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 1)], schema)
    new = spark.createDataFrame([("a", None, 2, 2), ("c", "x", 1, 2), ("c", "x", 1, 2)], schema)
    assert {(r.k, r.v, r.w) for r in G.upsert(now, new, ["k"], "seq").collect()} == {("a", None, 2), ("b", "1", 1), ("c", "x", 1)}
