"""The graph of merges: roots above each merge, and the edges on circles.

Nodes of several parents are few beside all nodes, and what hangs between them is already put together as
weighted edges. A graph of a bounded number of edges is solved by one task, whatever its depth. A larger
one is solved by rounds over tables, with the same result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.plans.session import cut, ship_package

#: Edges that one task holds, about 200 bytes each.
EDGES_OF_ONE_TASK = 500_000
#: Rounds that go into one plan.
ROUNDS_AT_ONCE = 4
#: Values of one batch of results.
BATCH_VALUES = 200_000


def components(edges: dict[int, list[int]]) -> dict[int, int]:
    """The strongly connected component of each node of more than one, by Tarjan's algorithm without recursion."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    on_stack: set[int] = set()
    out: dict[int, int] = {}
    for start in edges:
        if start in number:
            continue
        work = [(start, iter(edges.get(start, ())))]
        number[start] = low[start] = len(number)
        held.append(start)
        on_stack.add(start)
        while work:
            node, following = work[-1]
            for nxt in following:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    held.append(nxt)
                    on_stack.add(nxt)
                    work.append((nxt, iter(edges.get(nxt, ()))))
                    break
                if nxt in on_stack:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(held.pop())
                        on_stack.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1:
                        out |= dict.fromkeys(members, node)
    return out


def _solve(edges: pd.DataFrame, paths: bool) -> Iterator[tuple]:
    """(kind, m, v, d, vias): "root" rows with the fewest steps, "circle" rows for edges inside a component."""
    up: dict[int, list[int]] = defaultdict(list)
    down: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank = {k: i for i, k in enumerate(sorted(set(edges["via_key"])))}
    tops = set()
    for m, v, w, via, key, root in zip(*(edges[c].tolist() for c in ("m", "v", "w", "via", "via_key", "is_root"))):
        up[m].append(v)
        down[v].append((m, w, via, rank[key]))
        if root:
            tops.add(v)
    part = components(up)
    for m, vs in up.items():
        # An edge of a merge to its own tree closes a circle as well.
        for v in set(vs):
            if v == m or (m in part and part.get(v) == part[m]):
                yield "circle", m, v, 0, []
    for root in sorted(tops):
        best = {root: (0, -1)}
        before: dict[int, tuple[int, int]] = {}
        queue = [(0, root)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > best[v][0]:
                continue
            for m, w, via, r in down.get(v, ()):
                known = best.get(m)
                if known is None or (d + w, r) < known:
                    if known is None or d + w < known[0]:
                        heapq.heappush(queue, (d + w, m))
                    best[m] = (d + w, r)
                    before[m] = (v, via)
        for m in before:
            vias, at = [], m
            while paths and at != root:
                at, via = before[at]
                vias.append(via)
            yield "root", m, root, best[m][0], vias[::-1]


_RESULT = "kind string, m bigint, v bigint, d bigint, vias array<bigint>"


def _at_once(graph: DataFrame, paths: bool) -> DataFrame:
    ship_package(graph.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat([pd.DataFrame(columns=["m", "v", "w", "via", "via_key", "is_root"]), *batches])
        rows: list[tuple] = []
        size = 0
        for row in _solve(edges, paths):
            rows.append(row)
            size += 1 + len(row[4])
            if size >= BATCH_VALUES:
                yield pd.DataFrame(rows, columns=["kind", "m", "v", "d", "vias"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["kind", "m", "v", "d", "vias"])

    return cut(graph.select("m", "v", "w", "via", "via_key", "is_root").coalesce(1).mapInPandas(run, _RESULT))


def _roots_in_rounds(graph: DataFrame) -> DataFrame:
    """(m, root, d): the fewest steps from each merge to each root above it.

    Semi-naive rounds, several of them in one plan: what a round reaches goes into the next one before
    it is known whether it is an improvement.
    """
    steps = cut(graph.groupBy("m", "v", "is_root").agg(F.min("w").alias("w")))
    fresh = cut(steps.where("is_root").select("m", F.col("v").alias("root"), F.col("w").alias("d")))
    inner = steps.where("not is_root").select("m", "v", "w")
    best = fresh
    while not fresh.isEmpty():
        wave = reached = fresh
        for _ in range(ROUNDS_AT_ONCE):
            wave = wave.select(F.col("m").alias("v"), "root", "d").join(inner, "v").groupBy("m", "root").agg(F.min(F.col("d") + F.col("w")).alias("d"))
            reached = reached.union(wave)
        found = best.withColumn("known", F.col("d")).unionByName(reached.withColumn("known", F.lit(None).cast("bigint")))
        state = cut(found.groupBy("m", "root").agg(F.min("d").alias("d"), F.min("known").alias("known")))
        fresh = state.where("known is null or d < known").select("m", "root", "d")
        best = state.select("m", "root", "d")
    return best


def _trim(graph: DataFrame) -> tuple[DataFrame, int]:
    """Drop edges that can't be on a circle: nothing arrives at their child or leaves their parent."""
    graph = cut(graph)
    n = graph.count()
    while n:
        kept = cut(
            graph.join(graph.select(F.col("m").alias("v")).distinct(), "v", "left_semi").join(graph.select(F.col("v").alias("m")).distinct(), "m", "left_semi")
        )
        before, n, graph = n, kept.count(), kept
        if n == before:
            break
    return graph, n


def _circles_in_rounds(graph: DataFrame) -> DataFrame | None:
    """The edges (m, v) inside a strongly connected component; colouring by the largest node above."""
    found = None
    rest, n = _trim(graph.select("m", "v").distinct())
    while n:
        color = cut(rest.select(F.col("m").alias("x")).union(rest.select("v")).distinct().withColumn("c", F.col("x")))
        while True:
            above = rest.join(color.select(F.col("x").alias("v"), F.col("c").alias("cv")), "v").groupBy(F.col("m").alias("x")).agg(F.max("cv").alias("cv"))
            nxt = cut(color.join(above, "x", "left").select("x", F.greatest("c", F.coalesce("cv", "c")).alias("c"), (F.col("cv") > F.col("c")).alias("moved")))
            color = nxt.select("x", "c")
            if not nxt.where("moved").limit(1).count():
                break
        tinted = cut(
            rest.join(color.select(F.col("x").alias("m"), F.col("c").alias("cm")), "m").join(color.select(F.col("x").alias("v"), F.col("c").alias("cv")), "v").where("cm = cv").select("m", "v", F.col("cm").alias("c"))
        )
        members = frontier = cut(color.where("x = c"))
        while not frontier.isEmpty():
            up = frontier.join(tinted.select(F.col("m").alias("x"), F.col("v").alias("y"), "c"), ["x", "c"]).select(F.col("y").alias("x"), "c").distinct()
            frontier = cut(up.join(members, ["x", "c"], "left_anti"))
            members = cut(members.union(frontier))
        inside = tinted.join(members.select(F.col("x").alias("m"), "c"), ["m", "c"], "left_semi").join(members.select(F.col("x").alias("v"), "c"), ["v", "c"], "left_semi").select("m", "v")
        found = inside if found is None else found.union(inside)
        gone = members.select("x")
        rest, n = _trim(rest.join(gone.withColumnRenamed("x", "m"), "m", "left_anti").join(gone.withColumnRenamed("x", "v"), "v", "left_anti"))
    return None if found is None else cut(found)


def _leads_in_rounds(graph: DataFrame, merged: DataFrame) -> DataFrame:
    """(m, root, vias): the parents through which a shortest path from the root enters each merge, in order."""
    own = graph.where("is_root").select(F.col("v").alias("m"), F.col("v").alias("root"), F.lit(0).cast("bigint").alias("d")).distinct()
    reach = merged.unionByName(own)
    above = graph.join(reach.select(F.col("m").alias("v"), "root", F.col("d").alias("dv")), "v")
    best = above.join(merged, ["m", "root"]).where("dv + w = d").groupBy("m", "root").agg(F.min_by(F.struct("v", "via"), F.struct("via_key", "v")).alias("b"))
    steps = cut(best.select("m", "root", "b.v", "b.via"))
    known = level = cut(own.select("m", "root", F.array().cast("array<bigint>").alias("vias")))
    while not level.isEmpty():
        level = cut(steps.join(level.withColumnRenamed("m", "v"), ["v", "root"]).select("m", "root", F.concat("vias", F.array("via")).alias("vias")))
        known = known.union(level)
    return cut(known.where("m <> root"))


def solve(graph: DataFrame, paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(m, root, d, vias) of each merge and root above it, and (m, v) of the edges on circles.

    ``graph`` has the edges (m, v, w, via, via_key, is_root): merge ``m`` has a parent ``via`` that is
    w - 1 steps below the tree top ``v``. ``vias`` are the parents through which the shortest path
    enters merge after merge (of equally short ones the parent with the smaller key), if ``paths``.
    """
    if graph.count() <= EDGES_OF_ONE_TASK:
        solved = _at_once(graph, paths)
        return solved.where("kind = 'root'").select("m", F.col("v").alias("root"), "d", "vias"), solved.where("kind = 'circle'").select("m", "v")
    merged = cut(_roots_in_rounds(graph))
    edges = _circles_in_rounds(graph)
    circles = graph.select("m", "v").limit(0) if edges is None else edges
    if not paths:
        return merged.withColumn("vias", F.array().cast("array<bigint>")), circles
    return merged.join(_leads_in_rounds(graph, merged), ["m", "root"]), circles
