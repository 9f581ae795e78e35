"""The general data problems: brute force, edge cases and clashing columns."""

from __future__ import annotations

import json
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeatlas.operators import merge_graph
from lodeatlas.operators.assignment import best_assignment
from lodeatlas.operators.hierarchy import all_descendants, descendants, full_paths, lineage_edges, node_positions, node_roots, tree_positions
from lodeatlas.operators.schema_drift import name_similarity, schema_changes, typed, unify
from lodeatlas.operators.bitmaps import compress, packed, places
from lodeatlas.operators.snapshot_diff import SnapshotLog, diff_snapshots
from lodeatlas.plans.prefix import prefix_sums
from lodeatlas.sources.json_lines import canonical, parse_record

SNAP = "snapshot_no long, provider string, model_id string, display_name string, cost_input double, cost_output double, context_window long, last_synced string"
WIRE = "feed string, file_no long, line_no long, provider string, payload string"
LINE = "child_ref struct<family:string,variant:string,version:string,modifier:array<string>>, parents array<struct<family:string,variant:string,version:string,kind:string>>"


# --- snapshots ----------------------------------------------------------------------------------


def snap(no, key, name="n", cost=1.0, at="2025-01-01T00:00:00Z", provider="p"):
    return (no, provider, key, name, cost, cost, 10, at)


def test_snapshot_changes(spark, rows):
    data = [
        snap(1, "a"), snap(1, "b"), snap(1, "c", cost=None), snap(1, "z", cost=0.0),
        snap(3, "a", cost=2.0), snap(3, "c", cost=None), snap(3, "d"), snap(3, "z", cost=-0.0),
        snap(4, "a", cost=2.0), snap(4, "c", cost=0.0), snap(4, "d"), snap(4, "z", cost=0.0), snap(4, "b"),
    ]
    got = rows(diff_snapshots(spark.createDataFrame(data, SNAP)))
    assert got == sorted(
        [(3, "p", "a", "changed"), (3, "p", "b", "removed"), (3, "p", "d", "added"), (4, "p", "b", "added"), (4, "p", "c", "changed")], key=repr
    )


def test_snapshot_newest_delivery_counts(spark, rows):
    data = [
        snap(1, "a", cost=1.0),
        snap(2, "a", cost=9.0, at="2025-01-02T00:30:00+01:00"),  # an earlier instant than it looks
        snap(2, "a", cost=1.0, at="2025-01-02T00:00:00Z"),
        snap(2, "a", cost=9.0, at="no instant"),
        snap(2, "a", cost=9.0, at=None),
    ]
    assert rows(diff_snapshots(spark.createDataFrame(data, SNAP))) == []


def test_snapshot_edges(spark, rows):
    assert rows(diff_snapshots(spark.createDataFrame([], SNAP))) == []
    assert rows(diff_snapshots(spark.createDataFrame([snap(1, "a"), snap(1, "a")], SNAP))) == []
    nulls = [snap(1, None), snap(2, None, provider=None), snap(None, "a"), snap(2, "x" * 100_000)]
    got = rows(diff_snapshots(spark.createDataFrame(nulls, SNAP)))
    assert [g[:2] + g[3:] for g in got] == [(2, "p", "added"), (2, "p", "removed"), (2, None, "added")]
    clash = spark.createDataFrame([snap(1, "a"), snap(2, "b")], SNAP).withColumns({c: F.lit("x") for c in ("snap", "step", "cells", "row", "k0", "v0", "ordinal")})
    assert rows(diff_snapshots(clash)) == [(2, "p", "a", "removed"), (2, "p", "b", "added")]


def test_snapshot_brute_force(spark, rows):
    rng = random.Random(5)
    data = [snap(s, f"m{rng.randrange(40)}", rng.choice("ab"), rng.choice([None, 0.0, 1.0]), f"2025-01-0{rng.randrange(1, 9)}T00:00:00Z", rng.choice("pq")) for s in (1, 2, 5, 6) for _ in range(60)]
    latest: dict = {}
    for r in data:
        k = (r[0], r[1], r[2])
        order = (r[7], r[4] is not None, r[4] or 0, r[3])
        if k not in latest or order > latest[k][0]:
            latest[k] = (order, (r[3], r[4]))
    # Ties of the instant are settled by the values in the order of the compared columns.
    expected = set()
    for old, new in ((1, 2), (2, 5), (5, 6)):
        o, n = ({k[1:]: v[1] for k, v in latest.items() if k[0] == s} for s in (old, new))
        for k in o.keys() | n.keys():
            kind = "added" if k not in o else "removed" if k not in n else "changed" if o[k] != n[k] else None
            if kind:
                expected.add((new, *k, kind))
    assert set(rows(diff_snapshots(spark.createDataFrame(data, SNAP)))) == expected


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    sets = [np.array([], int), np.arange(8192), np.array([0, 8191]), np.arange(100, 7000), np.sort(rng.choice(8192, 3000, replace=False)), np.arange(0, 8192, 2)]
    for s in sets:
        assert (places(packed(compress(s))) == s).all()
    assert [compress(s)[:1] for s in sets] == [b"a", b"r", b"a", b"r", b"b", b"b"] and max(len(compress(s)) for s in sets) == 1025
    for a in sets:
        for b in sets:
            x, y = packed(compress(a)), packed(compress(b))
            assert set(places(x & ~y)) == set(a) - set(b) and set(places(x & y)) == set(a) & set(b)
    assert not packed(None).any()


def test_deliveries_one_by_one(spark, rows, tmp_path):
    rng = random.Random(9)
    data = [snap(s, f"m{rng.randrange(60)}", rng.choice("ab"), rng.choice([None, 0.0, 1.0]), f"2025-01-0{rng.randrange(1, 9)}T00:00:00Z", rng.choice(["p", None])) for s in range(1, 5) for _ in range(80)]
    log, got = SnapshotLog(spark, str(tmp_path / "log")), []
    for s in range(1, 5):
        got += [(s, *r) for r in rows(log.deliver(spark.createDataFrame([r for r in data if r[0] == s], SNAP)))]
        if s == 2:  # a third delivery needs the last one's containers only
            import shutil

            shutil.rmtree(tmp_path / "log" / "0" / "held")
            (tmp_path / "log" / "0" / "held").mkdir()
            (tmp_path / "log" / "0" / "held" / "_SUCCESS").touch()
    assert sorted(got, key=repr) == rows(diff_snapshots(spark.createDataFrame(data, SNAP)))
    ordinals = spark.read.parquet(*[str(tmp_path / "log" / str(k) / "ordinals") for k in range(4)])
    assert ordinals.count() == ordinals.select("ordinal").distinct().count() == len({r[1:3] for r in data})


# --- schema drift ---------------------------------------------------------------------------------


def wire(file_no, records, feed="f", start=1):
    return [(feed, file_no, i, "p", r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records, start)]


def test_schema_changes(spark, rows):
    old = [{"id": str(i), "cost": {"input": i, "in": i % 3}, "reasoning": i % 2 == 0, "gone": "x", "kept": i} for i in range(12)]
    new = [{"id": str(i), "cost": {"input": str(i), "inp": float(i % 3)}, "is_reasoning": i % 2 == 0, "kept": i, "fresh": None if i else 1} for i in range(12)]
    data = wire(1, old) + wire(4, [*new, '{"broken', "[1]", "null"])
    got = rows(schema_changes(spark.createDataFrame(data, WIRE)))
    assert got == sorted(
        [
            ("f", 4, "retyped", "cost.input", "cost.input"), ("f", 4, "renamed", "cost.in", "cost.inp"), ("f", 4, "renamed", "reasoning", "is_reasoning"),
            ("f", 4, "removed", "gone", ""), ("f", 4, "added", "", "fresh"),
        ], key=repr,
    )


def test_schema_members_need_an_object_on_both_sides(spark, rows):
    data = wire(1, [{"id": "1", "interleaved": {"field": "x"}}]) + wire(2, [{"id": "1", "interleaved": True}])
    assert rows(schema_changes(spark.createDataFrame(data, WIRE))) == [("f", 2, "retyped", "interleaved", "interleaved")]


def test_schema_edges(spark, rows):
    assert rows(schema_changes(spark.createDataFrame([], WIRE))) == []
    assert rows(unify(spark.createDataFrame([], WIRE))) == []
    data = wire(1, [{"id": "1", "a": "y" * 200_000}, {"id": "1", "a": "y" * 200_000}]) + wire(2, ["not json"]) + wire(3, [{"id": "1", "a": ""}])
    data += [(None, None, None, None, None), (None, 1, 1, None, json.dumps({"x": 1})), (None, 2, 1, None, json.dumps({"y": 2}))]
    clash = spark.createDataFrame(data, WIRE).withColumns({c: F.lit("?") for c in ("path", "kind", "older", "value", "id")})
    got = rows(schema_changes(clash))
    assert ("f", 2, "removed", "a", "") in got and ("f", 3, "added", "", "a") in got
    assert (None, 2, "removed", "x", "") in got and (None, 2, "added", "", "y") in got


def test_unify_follows_renames(spark):
    ids = [str(i) for i in range(5)]
    data = wire(1, [{"id": i, "cost": {"input": int(i)}} for i in ids]) + wire(2, [{"id": i, "price": {"input": int(i)}} for i in ids])
    data += wire(3, [{"id": i, "price": {"in": int(i)}} for i in ids])
    got = {(r.file_no, r.id): r.fields for r in unify(spark.createDataFrame(data, WIRE)).collect()}
    assert all(got[(f, i)]["cost.input"] == i for f in (1, 2, 3) for i in ids)


def test_unify_matches_feeds(spark):
    ids = [str(i) for i in range(5)]
    record = lambda i, cost, flag, size: {"id": i, cost: {"input": int(i), "out": 1}, flag: i != "0", size: 7, "extra": "e"}
    data = wire(1, [record(i, "price", "is_reasoning", "limit") for i in ids], "a") + wire(2, [record(i, "cost", "reasoning", "limit") for i in ids], "a")
    for feed, cost in (("b", "cost"), ("c", "cost"), ("d", "pricing")):
        data += wire(1, [record(i, cost, "reasoning", "limits" if feed == "d" else "limit") for i in ids], feed)
    got = unify(spark.createDataFrame(data, WIRE)).collect()
    assert len(got) == len(data)
    for r in got:
        assert set(r.fields) == {"id", "cost", "cost.input", "cost.out", "reasoning", "limit", "extra"}
        assert r.fields["cost.input"] == r.id and r.fields["reasoning"] == ("false" if r.id == "0" else "true")


def test_unify_keeps_fields_apart_that_stand_side_by_side(spark):
    data = wire(1, [{"id": "1", "open_weights": 1}], "a") + wire(1, [{"id": "2", "weights_open": 2}], "b") + wire(1, [{"id": "3", "open_weights": 3, "weights_open": 4}], "c")
    got = {r.id: r.fields for r in unify(spark.createDataFrame(data, WIRE)).collect()}
    assert got["2"]["weights_open"] == "2" and (got["3"]["open_weights"], got["3"]["weights_open"]) == ("3", "4")


def test_assignment_decides_between_renames_that_agree(spark, rows):
    """Two old and two new fields of equal values: types and names tell which became which."""
    old = [{"id": str(i), "max_input": 5, "max_output": 5, "a": 1, "b": 1} for i in range(9)]
    new = [{"id": str(i), "output_max": 5, "input_max": 5, "c": 1, "d": 1 if i else "x"} for i in range(9)]
    old[0]["b"] = "x"
    got = rows(schema_changes(spark.createDataFrame(wire(1, old) + wire(2, new), WIRE)))
    assert ("f", 2, "renamed", "max_input", "input_max") in got and ("f", 2, "renamed", "max_output", "output_max") in got
    assert ("f", 2, "renamed", "b", "d") in got and ("f", 2, "renamed", "a", "c") in got and len(got) == 4


def test_typed_columns(spark):
    records = [{"id": str(i), "on": ["yes", "no", 0, True][i % 4], "price": [2, "$2.50", "3", None][i % 4], "say": ["a", [1], {"k": 1}, "b"][i % 4], "a.b": 1, "a_b": 2} for i in range(20)]
    one, columns = typed(unify(spark.createDataFrame(wire(1, records), WIRE)))
    assert dict(columns) == {"id": "double", "on": "boolean", "price": "double", "say": "string", "say.k": "boolean", "a.b": "boolean", "a_b": "double"}
    by = {r.id: r for r in one.collect()}
    assert [by[str(i)].on for i in range(4)] == [True, False, False, True] and [by[str(i)].price for i in range(4)] == [2.0, 2.5, 3.0, None]
    assert [by[str(i)].say for i in range(4)] == ["a", "[1]", '{"k": 1}', "b"] and by["0"]["a_b_"] == 2.0 and by["0"]["id_"] == 0.0
    assert typed(unify(spark.createDataFrame([], WIRE)))[1] == []


def test_values_compare_by_value():
    assert canonical({"b": 1.0, "a": [1, True, None]}) == {"b": 1, "a": [1, True, None]}
    assert canonical(True) is True and canonical("1") == "1"
    assert parse_record("[1]") is None and parse_record(None) is None and parse_record("{") is None


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2)):
        w = rng.random((n, m)) * 10
        total = sum(w[r, c] for r, c in best_assignment(w))
        small, big = min(n, m), max(n, m)
        best = max(sum((w[i, p[i]] if n <= m else w[p[i], i]) for i in range(small)) for p in permutations(range(big), small))
        assert total == pytest.approx(best)
    assert best_assignment(np.array([[0.0]])) == []
    assert name_similarity("is_reasoning", "reasoning") > name_similarity("is_reasoning", "knowledge")


# --- hierarchies ------------------------------------------------------------------------------------


def graph_rows(spark, edges, extra=()):
    nodes = {x for e in edges for x in e} | set(extra)
    return spark.createDataFrame([(n,) for n in nodes], "node_key string"), spark.createDataFrame(list(edges), "child string, parent string")


def brute_roots(edges, extra=()):
    up = defaultdict(set)
    for c, p in edges:
        up[c].add(p)
    nodes = {x for e in edges for x in e} | set(extra)
    out = set()
    for x in nodes:
        seen, queue, circle = {x: 0}, deque([x]), False
        while queue:
            y = queue.popleft()
            for p in up[y]:
                circle |= p == x
                if p not in seen:
                    seen[p] = seen[y] + 1
                    queue.append(p)
        found = {(x, r, n) for r, n in seen.items() if not up[r]}
        out |= found
        if circle:
            out.add((x, "", -1))
        elif not found:
            out.add((x, "", -2))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_roots_brute_force(spark, rows, seed, monkeypatch):
    rng = random.Random(seed)
    if seed == 3:  # the graph of merges in rounds
        monkeypatch.setattr(merge_graph, "EDGES_OF_ONE_TASK", 0)
    edges = {(f"n{i}", f"n{rng.randrange(max(1, i - 6), i) if i > 1 else 0}") for i in range(1, 45)}
    edges |= {(f"n{rng.randrange(20, 45)}", f"n{rng.randrange(0, 30)}") for _ in range(6)}
    edges |= {("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x1"), ("s", "s"), ("t", "s"), ("n9", "n9"), ("n5", "n40")}
    nodes, links = graph_rows(spark, edges, ["alone"])
    assert set(rows(node_roots(nodes, links))) == brute_roots(edges, ["alone"])


def test_tree_positions(spark, rows):
    edges = [(f"c{i}", "root") for i in range(6)] + [("d", "c3"), ("e", "d"), ("f", "d"), ("g", "f")]
    nodes, links = graph_rows(spark, edges)
    at = tree_positions(nodes, links)
    by = {r.node_key: r for r in at.collect()}
    assert by["root"].n_below == 10 and by["g"].depth == 4 and sorted(r.pos for r in by.values()) == list(range(11))
    assert dict(rows(full_paths(at)))["g"] == "root > c3 > d > f > g"
    assert rows(descendants(at, spark.createDataFrame([("d",)], "node_key string"))) == [("d", "e"), ("d", "f"), ("d", "g")]


@pytest.mark.parametrize("held", [0, 1000])
def test_positions_and_descendants_brute_force(spark, rows, held, monkeypatch):
    monkeypatch.setattr(merge_graph, "EDGES_OF_ONE_TASK", held)
    rng = random.Random(11)
    edges = {(f"n{i}", f"n{rng.randrange(max(1, i - 6), i) if i > 1 else 0}") for i in range(1, 45)}
    edges |= {(f"n{rng.randrange(20, 45)}", f"n{rng.randrange(0, 30)}") for _ in range(6)}
    edges |= {("n5", "n40"), ("n9", "n9"), ("s", "s"), ("t", "s")}
    edges |= {(f"x{i}", f"x{(i + 1) % 5}") for i in range(5)} | {("y", "x1"), ("z", "y"), ("z", "n3"), ("zz", "z")}
    nodes, links = graph_rows(spark, edges, ["alone"])
    down, keys = defaultdict(set), {x for e in edges for x in e} | {"alone"}
    for c, p in edges:
        down[p].add(c)
    below = {}
    for x in keys:
        seen, queue = set(), deque([x])
        while queue:
            fresh = down[queue.popleft()] - seen
            seen |= fresh
            queue.extend(fresh)
        below[x] = seen
    pairs = rows(all_descendants(nodes, links))
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, d) for x in keys for d in below[x]}
    got = node_positions(nodes, links).collect()
    assert sorted((r.node_key, r.root_key, r.depth) for r in got) == sorted(brute_roots(edges, ["alone"]))
    for r in got:
        assert r.n_below == len(below[r.node_key])
        steps = r.path.split(" > ")
        if r.depth < 0:
            assert r.path == ""
        else:
            assert steps[0] == r.root_key and steps[-1] == r.node_key and len(steps) == r.depth + 1 and all((c, p) in edges for p, c in zip(steps, steps[1:]))
    trees = {r.node_key: r for r in got}.values()
    for r in trees:
        inside = {d.node_key for d in trees if d.tree_key == r.tree_key and r.pos < d.pos <= r.pos + r.n_tree}
        assert len(inside) == r.n_tree and inside <= below[r.node_key]
    empty = lineage_edges(spark.createDataFrame([], LINE))
    assert rows(node_positions(*empty)) == [] and rows(all_descendants(*empty)) == []


def test_depth_of_merges_takes_no_more_jobs(spark, rows):
    """A ladder, in which each node has the two nodes before it as parents, of 20 and of 400 levels."""
    jobs = []
    for n in (20, 400):
        edges = [(f"n{i:04}", f"n{i - k:04}") for i in range(2, n) for k in (1, 2)] + [("n0001", "n0000")]
        spark.sparkContext.setJobGroup(f"ladder{n}", "")
        got = rows(node_roots(*graph_rows(spark, edges)))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ladder{n}")))
        assert got == [(f"n{i:04}", "n0000", (i + 1) // 2) for i in range(n)]
    spark.sparkContext.setJobGroup("tests", "")
    assert jobs[1] <= jobs[0] + 4


def test_hierarchy_edges(spark, rows):
    assert rows(node_roots(*lineage_edges(spark.createDataFrame([], LINE)))) == []
    assert rows(tree_positions(*lineage_edges(spark.createDataFrame([], LINE)))) == []
    data = [
        ((" A ", None, "1", ["X ", "y"]), [("b", "", None, "Merge "), ("c", "", "", " NONE")]),
        (("a", "", "1", ["x", "y"]), None),
        (("a", "", "1", ["x", "y"]), [("B", None, "", None)]),
        ((None, None, None, None), [("b", "", "", "merge")]),
        (None, None),
        (("z" * 50_000, "", "", []), []),
    ]
    df = spark.createDataFrame(data, LINE).withColumns({c: F.lit(1) for c in ("child", "parent", "node_key", "x", "p")})
    got = rows(node_roots(*lineage_edges(df)))
    assert got == sorted([("a@1{x,y}", "b", 1), ("b", "b", 0), ("z" * 50_000, "z" * 50_000, 0)], key=repr)


def test_prefix_sums(spark):
    df = spark.createDataFrame([(g, i, i + 1) for g in ("a", "b", None) for i in range(50)], "g string, i int, n int")
    for r in prefix_sums(df, ["g"], ["i"], F.col("n"), "before", 7).collect():
        assert r.before == r.i * (r.i + 1) // 2
