from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codelake.operators import references as R

REL = "rel_id bigint, target_id string, target_name string, extracted_at timestamp_ntz, key string, t string"
EDGE = "edge_id bigint, target_id string, created_at timestamp_ntz"
CHUNK = "id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, kind string"
NODE = "id string, created_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def norm(x):
    x = (x or "").strip()
    return None if not x else x if x.startswith("external_") else x.lower()


def brute(rels, edges, chunks, nodes):
    def there(rows, key, t):
        return t is not None and any(norm(r[0]) == key and r[1] is not None and r[1] <= t and (r[2] is None or r[2] > t) for r in rows)

    out = set()
    for rel_id, target, name, t, *_ in rels:
        if norm(target):
            bad = not there(chunks, norm(target), t)
        elif (name or "").strip():
            bad = not there(nodes, "external_" + name.strip(), t)
        else:
            continue
        if bad:
            out.add(("relationships", rel_id))
    for edge_id, target, t in edges:
        if norm(target) and not there(nodes, norm(target), t):
            out.add(("edges", edge_id))
    return out


def run(spark, rels, edges, chunks, nodes):
    refs = R.relationship_references(spark.createDataFrame(rels, REL)).unionByName(R.edge_references(spark.createDataFrame(edges, EDGE)))
    existing = R.lives(spark.createDataFrame(chunks, CHUNK), "chunk", "indexed_at").unionByName(R.lives(spark.createDataFrame(nodes, NODE), "node", "created_at"))
    return refs, existing


def test_orphans_equal_brute_force(spark):
    rng = random.Random(1)
    at = lambda: T0 + timedelta(hours=rng.randrange(0, 24 * 4)) if rng.random() > 0.03 else None
    spell = lambda x: rng.choice([x, f" {x}", f"{x}\t", x.upper() if not x.startswith("external_") else x])
    keys = ["a1", "b2", "c3"]
    names = ["external_Foo", "external_foo", "n1"]
    life = lambda k: (spell(k), at(), rng.choice([None, at()]))
    # a third of all rows refers to one key
    rels = [(i, rng.choice([None, " ", *map(spell, keys), "a1", "a1", "zz"]), rng.choice([None, "", "Foo", " foo ", "Bar"]), at(), "x", "y") for i in range(400)]
    edges = [(i, rng.choice([None, " ", *map(spell, names), "external_Bar"]), at()) for i in range(200)]
    chunks = [(*life(rng.choice(keys)), "k") for _ in range(12)]
    nodes = [life(rng.choice(names)) for _ in range(12)]
    rels += rels[:20]
    chunks += chunks[:3]
    refs, existing = run(spark, rels, edges, chunks, nodes)
    for period in ("day", "hour"):
        found = [tuple(r) for r in R.orphan_references(refs, existing, period).select("table_name", "row_id").collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(rels, edges, chunks, nodes)


def test_boundaries(spark):
    t = T0 + timedelta(days=1)
    chunks = [("a", t, t + timedelta(days=2), None), ("gone", t, t, None), ("late", t + timedelta(days=1), None, None)]
    rels = [(1, "a", None, t, "", ""), (2, "a", None, t + timedelta(days=2), "", ""), (3, "gone", None, t, "", ""), (4, "late", None, t, "", ""), (5, None, None, t, "", ""), (6, "A ", None, None, "", "")]
    refs, existing = run(spark, rels, [], chunks, [])
    assert {r.row_id for r in R.orphan_references(refs, existing).collect()} == {2, 3, 4, 6}


def test_empty_tables(spark):
    refs, existing = run(spark, [], [], [], [])
    assert R.orphan_references(refs, existing).count() == 0
    assert R.orphan_report(R.orphan_references(refs, existing), refs).count() == 0


def test_signed_counts_take_deltas(spark):
    t = T0
    refs, existing = run(spark, [(1, "a", None, t, "", ""), (1, "a", None, t, "", ""), (2, "b", None, t, "", "")], [], [("a", t, None, None), ("b", t, t + timedelta(days=1), None)], [])
    state = R.signed_counts(refs, existing)
    assert {(r.key, r.n_refs) for r in R.orphan_keys(state).collect()} == {("b", 1)}
    delta = spark.createDataFrame([("chunk", "b", -1, 0), ("chunk", "a", 0, -1)], "kind string, key string, n_refs int, n_exists int")
    assert {(r.key, r.n_refs) for r in R.orphan_keys(R.merge_counts(state, delta)).collect()} == {("a", 1)}


def test_report(spark):
    t = T0
    refs, existing = run(spark, [(1, "a", None, t, "", ""), (2, "q", None, t, "", ""), (3, "q", None, None, "", "")], [], [("a", t, None, None)], [])
    rows = {(r.table_name, r.month): (r.n_references, r.n_orphans) for r in R.orphan_report(R.orphan_references(refs, existing), refs).collect()}
    assert rows == {("relationships", "2025-01"): (2, 1), ("relationships", None): (1, 1)}


def test_unknown_columns_do_not_matter(spark):
    refs, existing = run(spark, [(1, "a", None, T0, "", "")], [], [], [])
    assert R.orphan_references(refs.withColumn("delta", F.lit(3)), existing.withColumn("step", F.lit(1))).count() == 1
