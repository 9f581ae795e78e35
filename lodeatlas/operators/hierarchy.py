"""Parent-child links to full hierarchies.

A node with exactly one parent hangs below it in a forest; a node with none is a root and one with
several (a merge) is the top of a tree of its own. Subtree sizes of the forest come from pointer
doubling, which takes a number of rounds logarithmic in the depth. The child with the largest subtree
continues the chain of its parent (heavy path), so a path to the top of a tree crosses a logarithmic
number of chains: tops, depths, paths and positions are put together from chain segments. The much
smaller graph of merges then gives the roots above each merge (``merge_graph.py``).

Circles are separated first: one-parent circles are the image of the parent function iterated often
enough, circles through merges are strongly connected components of the graph of merges, and the
nodes between two merges of a circle are prefixes of chains.

For paths and descendants each one-parent circle is opened at one of its nodes, which tops a tree like
a merge does. So every node has a place in a tree, and all that crosses trees hangs on the edges above
their tops: a node reaches whole trees through the tops that hang at or below it, and the tops reached
from a top are a closure over tops only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeatlas.operators.merge_graph import solve
from lodeatlas.plans.prefix import prefix_sums
from lodeatlas.plans.session import cut

_BLANK = r"[\s\u00a0\u2000-\u200b\u3000]+"


def norm(text: Column) -> Column:
    """Trimmed, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANK}|{_BLANK}$", ""))


def reference_key(ref: str, modifiers: bool) -> Column:
    """family[/variant][@version][{m1,m2}] of a struct column or lambda path."""
    family, variant, version = (norm(F.col(f"{ref}.{x}")) for x in ("family", "variant", "version"))
    key = F.concat(family, F.when(variant != "", F.concat(F.lit("/"), variant)).otherwise(""), F.when(version != "", F.concat(F.lit("@"), version)).otherwise(""))
    if not modifiers:
        return key
    mods = F.array_join(F.filter(F.transform(F.coalesce(F.col(f"{ref}.modifier"), F.array().cast("array<string>")), norm), lambda m: m != ""), ",")
    return F.concat(key, F.when(mods != "", F.concat(F.lit("{"), mods, F.lit("}"))).otherwise(""))


def lineage_edges(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_key) of every node and (child, parent) of every derivation, each once.

    Parents of the kind ``none`` are no derivation. A reference in which everything is empty or null
    names no node; a row whose child is such a reference is left out.
    """
    rows = lineage.select(reference_key("child_ref", True).alias("child"), "parents").where("child <> ''")
    exploded = rows.select("child", F.explode("parents").alias("p")).where(norm(F.col("p.kind")) != "none")
    edges = exploded.select("child", reference_key("p", False).alias("parent")).where("parent <> ''").distinct()
    nodes = rows.select(F.col("child").alias("node_key")).union(edges.select("parent")).distinct()
    return nodes, edges


def _spread(key: str, own: str) -> Column:
    """A key that may be null, for a left join: nulls become negative numbers of their own instead of one hot key.

    Node ids are never negative, so these match nothing.
    """
    return F.coalesce(F.col(key), -1 - F.col(own))


@dataclass
class Forest:
    """The forest and what hangs on it; ``x`` and other letters are node ids."""

    ids: DataFrame  # node_key, x
    edges: DataFrame  # c, p without self-loops
    loops: DataFrame  # x: nodes that are their own parent
    roots: DataFrame  # x: nodes without parents
    chains: DataFrame  # x, top, off, size, parent: chain and offset of each node that has a top
    tops: DataFrame  # top, anchor, base: tree top of a chain and the depth of the chain's first node
    endless: DataFrame  # x, ptr: one-parent nodes whose parents never end


def _heavy_chains(nodes: DataFrame, single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtree sizes by pointer doubling, then chains of heavy children, then offsets by doubling."""
    state = cut(nodes.join(single, "x", "left").select("x", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("size")))
    live = state.where("ptr is not null").count()
    while live:
        below = state.where("ptr is not null").groupBy(F.col("ptr").alias("b")).agg(F.sum("size").alias("more"))
        jump = state.where("ptr is not null").select(F.col("x").alias("j"), F.col("ptr").alias("next"))
        state = cut(
            state.join(below, F.col("x") == F.col("b"), "left")
            .join(jump, _spread("ptr", "x") == F.col("j"), "left")
            .select("x", F.col("next").alias("ptr"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )
        before, live = live, state.where("ptr is not null").count()
        if live == before:  # as many nodes have 2n ancestors as have n: their parents never end
            break
    endless = state.where("ptr is not null").select("x", "ptr")
    finite = cut(state.where("ptr is null").select("x", "size").join(single, "x", "left"))
    heavy = finite.where("parent is not null").groupBy("parent").agg(F.max_by("x", F.struct("size", -F.col("x"))).alias("h"))
    chain = cut(
        finite.join(heavy.select("h"), F.col("x") == F.col("h"), "left").select(
            "x", "size", "parent", F.coalesce(F.when(F.col("h").isNotNull(), F.col("parent")), F.col("x")).alias("top"), F.when(F.col("h").isNotNull(), 1).otherwise(0).cast("bigint").alias("off")
        )
    )
    while True:
        up = chain.where("off > 0").select(F.col("x").alias("u"), F.col("top").alias("t2"), F.col("off").alias("o2"))
        if not chain.where("off > 0").join(up, F.col("top") == F.col("u"), "left_semi").limit(1).count():
            break
        chain = cut(
            chain.join(up, F.col("top") == F.col("u"), "left").select(
                "x", "size", "parent", F.coalesce("t2", "top").alias("top"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off")
            )
        )
    return chain, endless


def _climb(links: DataFrame) -> DataFrame:
    """(top, anchor, base): follow (top, up, add) to the chain without ``up``, adding; doubling."""
    links = cut(links)
    while True:
        nxt = links.where("up is not null").select(F.col("top").alias("t"), F.col("up").alias("u2"), F.col("add").alias("a2"))
        if not links.join(nxt, F.col("up") == F.col("t"), "left_semi").limit(1).count():
            return links.select("top", F.coalesce("up", "top").alias("anchor"), F.col("add").alias("base"))
        links = cut(
            links.join(nxt, _spread("up", "top") == F.col("t"), "left").select("top", F.coalesce("u2", "up").alias("up"), (F.col("add") + F.coalesce("a2", F.lit(0))).alias("add"))
        )


def _circle_heads(endless: DataFrame, single: DataFrame) -> DataFrame:
    """(x): the smallest node of each one-parent circle; the least of the next 2^k nodes, doubling."""
    state = cut(_endless_circles(endless).join(single, "x").select("x", F.col("parent").alias("ptr"), F.least("x", "parent").alias("low")))
    while True:
        jump = state.select(F.col("x").alias("j"), F.col("ptr").alias("next"), F.col("low").alias("far"))
        state = cut(state.join(jump, F.col("ptr") == F.col("j")).select("x", F.col("next").alias("ptr"), F.least("low", "far").alias("low"), (F.col("far") < F.col("low")).alias("moved")))
        if state.where("moved").isEmpty():
            return state.where("x = low").select("x")
        state = state.drop("moved")


def build_forest(nodes: DataFrame, edges: DataFrame, open_circles: bool = False) -> Forest:
    """The forest of the one-parent nodes; with ``open_circles`` those of endless circles are in it too."""
    ids = cut(nodes.select("node_key").distinct().withColumn("x", F.monotonically_increasing_id()))
    c, p = (ids.select(F.col("node_key").alias(k), F.col("x").alias(v)) for k, v in (("child", "c"), ("parent", "p")))
    numbered = cut(edges.join(c, "child").join(p, "parent").select("c", "p"))
    loops = numbered.where("c = p").select(F.col("c").alias("x")).distinct()
    proper = numbered.where("c <> p")
    degree = proper.groupBy(F.col("c").alias("x")).agg(F.count("*").alias("n"), F.min("p").alias("parent"))
    single = cut(degree.where("n = 1").select("x", "parent"))
    roots = cut(ids.select("x").join(numbered.select(F.col("c").alias("x")), "x", "left_anti"))
    chains, endless = _heavy_chains(ids.select("x"), single)
    if open_circles and not endless.isEmpty():
        opened, _ = _heavy_chains(endless.select("x"), single.join(_circle_heads(endless, single), "x", "left_anti"))
        chains = cut(chains.unionByName(opened))
    at = chains.select(F.col("x").alias("pp"), F.col("top").alias("up"), (F.col("off") + 1).alias("add"))
    links = chains.where("off = 0").join(at, _spread("parent", "x") == F.col("pp"), "left").select("top", "up", F.coalesce("add", F.lit(0)).cast("bigint").alias("add"))
    return Forest(ids, proper, loops, roots, chains, _climb(links), endless)


def _edges_above(f: Forest, places: DataFrame, tops: DataFrame, keys: bool = False) -> DataFrame:
    """(m, v, w, via, via_key, is_root): the edges above ``tops`` (m), as ``merge_graph.solve`` wants them."""
    up = f.edges.join(tops, F.col("c") == F.col("m"), "left_semi")
    where = places.select(F.col("x").alias("p"), F.col("anchor").alias("v"), (F.col("depth") + 1).cast("bigint").alias("w"))
    roots = f.roots.select(F.col("x").alias("v"), F.lit(True).alias("is_root"))
    found = up.join(where, "p").join(roots, "v", "left").select(F.col("c").alias("m"), "v", "w", F.col("p").alias("via"), F.coalesce("is_root", F.lit(False)).alias("is_root"))
    if not keys:
        return cut(found.withColumn("via_key", F.lit("")))
    return cut(found.join(f.ids.select(F.col("x").alias("via"), F.col("node_key").alias("via_key")), "via"))


def _merges(f: Forest) -> DataFrame:
    return f.edges.groupBy(F.col("c").alias("m")).agg(F.count("*").alias("n")).where("n > 1").select("m")


def _endless_circles(endless: DataFrame) -> DataFrame:
    """Nodes on circles of one-parent nodes: where the iterated parent function always ends up."""
    state = endless
    n = state.select("ptr").distinct().count()
    while n:
        jump = state.select(F.col("x").alias("j"), F.col("ptr").alias("next"))
        state = cut(state.join(jump, F.col("ptr") == F.col("j")).select("x", F.col("next").alias("ptr")))
        before, n = n, state.select("ptr").distinct().count()
        if n == before:
            break
    return state.select(F.col("ptr").alias("x")).distinct()


def _on_circles(f: Forest, graph: DataFrame, edges: DataFrame) -> DataFrame:
    """(x): every node on a circle; ``edges`` are those of the graph that are on circles."""
    found = f.loops.union(_endless_circles(f.endless))
    if not edges.isEmpty():
        via = graph.join(edges, ["m", "v"], "left_semi")
        place = f.chains.select(F.col("x").alias("y"), "top", "off", "parent")
        marks = front = cut(via.select(F.col("via").alias("y")).distinct().join(place, "y").groupBy("top").agg(F.max("off").alias("upto")))
        heads = f.chains.where("off = 0 and parent is not null").select("top", "parent")
        while not front.isEmpty():
            up = front.join(heads, "top").select(F.col("parent").alias("y")).join(place.drop("parent"), "y").groupBy("top").agg(F.max("off").alias("upto"))
            known = marks.select("top", F.col("upto").alias("known"))
            front = cut(up.join(known, "top", "left").where("known is null or upto > known").select("top", "upto"))
            marks = cut(marks.union(front).groupBy("top").agg(F.max("upto").alias("upto")))
        on_chain = f.chains.join(marks, "top").where("off <= upto").select("x")
        found = found.union(on_chain).union(edges.select("m"))
    return cut(found.distinct())


def _places(f: Forest) -> DataFrame:
    """(x, anchor, depth, top, off): tree top of each node and its depth below it."""
    return f.chains.join(f.tops, "top").select("x", "anchor", (F.col("base") + F.col("off")).alias("depth"), "top", "off")


def node_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_key, root_key, depth): the roots of each node with the fewest steps to each.

    A root has itself at depth 0. A node on a circle also has ("", -1), a node on no circle that
    reaches no root has ("", -2). An empty table gives no rows.
    """
    f = build_forest(nodes, edges)
    places = cut(_places(f))
    graph = _edges_above(f, places, _merges(f))
    merged, circle_edges = solve(graph)
    direct = places.join(f.roots.select(F.col("x").alias("anchor")), "anchor", "left_semi").select("x", F.col("anchor").alias("root"), "depth")
    through = places.select("x", F.col("anchor").alias("m"), "depth").join(merged.drop("vias"), "m").select("x", "root", (F.col("depth") + F.col("d")).alias("depth"))
    rooted = cut(direct.unionByName(through))
    circle = _on_circles(f, graph, circle_edges)
    lost = f.ids.select("x").join(rooted.select("x"), "x", "left_anti").join(circle, "x", "left_anti")
    root_names = f.ids.select(F.col("x").alias("root"), F.col("node_key").alias("root_key"))
    odd = circle.select("x", F.lit("").alias("root_key"), F.lit(-1).cast("bigint").alias("depth")).union(lost.select("x", F.lit(""), F.lit(-2).cast("bigint")))
    return rooted.join(root_names, "root").select("x", "root_key", "depth").union(odd).join(f.ids, "x").select("node_key", "root_key", "depth")


def tree_positions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_key, tree_key, parent_key, depth, pos, n_below, segments) of the forest of one-parent nodes.

    ``pos`` numbers the nodes of a tree so that the descendants of a node are exactly the nodes of its
    tree with a position from pos + 1 to pos + n_below: the interval of a chain starts where its first
    node stands. ``segments`` is the path from the tree's top as chain segments, each with the key of
    the chain's first node and how many nodes of the chain the path takes. Nodes of endless circles
    are left out; a merge is the top of its own tree.
    """
    return _positions(build_forest(nodes, edges)).drop("x", "anchor")


def _positions(f: Forest) -> DataFrame:
    """The rows of ``tree_positions`` with the node ids ``x`` and, of the tree's top, ``anchor``."""
    ch = f.chains
    at = ch.select(F.col("x").alias("pp"), F.col("top").alias("up"), F.col("off").alias("poff"))
    light = ch.where("off = 0 and parent is not null").select("x", "size", "parent")
    heavy = ch.where("off > 0").select(F.col("parent").alias("hp"), F.col("size").alias("hsize"))
    # Light children follow the heavy one; a parent with very many children is spread by the prefix sums.
    sums = prefix_sums(light, ["parent"], ["size", "x"], F.col("size"), "before")
    delta = sums.join(heavy, F.col("parent") == F.col("hp"), "left").select(F.col("x").alias("top"), "parent", (1 + F.coalesce("hsize", F.lit(0)) + F.col("before")).alias("delta"))
    links = (
        ch.where("off = 0").select("top").join(delta, "top", "left").join(at, _spread("parent", "top") == F.col("pp"), "left")
        .select("top", "up", (F.coalesce("poff", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("add"))
    )
    starts = _climb(links).select("top", F.col("base").alias("start"))
    key = lambda x, out: f.ids.select(F.col("x").alias(x), F.col("node_key").alias(out))
    heads = cut(ch.where("off = 0").select("top", "parent").join(at, _spread("parent", "top") == F.col("pp"), "left").join(key("top", "top_key"), "top").select("top", "up", "poff", "top_key"))
    none = F.array().cast("array<struct<chain:string,n:bigint>>")
    paths = level = cut(heads.where("up is null").select("top", "top_key", none.alias("above")))
    while not level.isEmpty():
        parents = level.select(F.col("top").alias("up"), F.col("top_key").alias("up_key"), F.col("above").alias("a"))
        here = F.struct(F.col("up_key").alias("chain"), (F.col("poff") + 1).cast("bigint").alias("n"))
        level = cut(heads.join(parents, "up").select("top", "top_key", F.concat("a", F.array(here)).alias("above")))
        paths = cut(paths.union(level))
    last = F.struct(F.col("top_key").alias("chain"), (F.col("off") + 1).cast("bigint").alias("n"))
    return (
        ch.join(f.tops, "top").join(starts, "top").join(paths, "top")
        .join(key("x", "node_key"), "x").join(key("anchor", "tree_key"), "anchor").join(key("up_", "parent_key"), _spread("parent", "x") == F.col("up_"), "left")
        .select("x", "anchor", "node_key", "tree_key", F.coalesce("parent_key", F.lit("")).alias("parent_key"), (F.col("base") + F.col("off")).alias("depth"), (F.col("start") + F.col("off")).alias("pos"), (F.col("size") - 1).alias("n_below"), F.concat("above", F.array(last)).alias("segments"))
    )


def full_paths(positions: DataFrame) -> DataFrame:
    """(node_key, path): the keys from the tree's top to the node, joined by " > ".

    Written from the chain segments; the output is as large as the paths are.
    """
    cut_positions = cut(positions)
    mine = cut_positions.select(F.col("node_key").alias("member"), F.element_at("segments", -1).alias("s")).select("member", F.col("s.chain").alias("chain"), F.col("s.n").alias("at"))
    asked = cut_positions.select("node_key", F.posexplode("segments").alias("i", "s")).select("node_key", "i", F.col("s.chain").alias("chain"), F.col("s.n").alias("n"))
    steps = asked.join(mine, "chain").where("at <= n").groupBy("node_key").agg(F.array_sort(F.collect_list(F.struct("i", "at", "member"))).alias("steps"))
    return steps.select("node_key", F.array_join(F.transform("steps", lambda s: s["member"]), " > ").alias("path"))


def descendants(positions: DataFrame, keys: DataFrame) -> DataFrame:
    """(node_key, descendant_key): all descendants, within its tree, of each node of ``keys`` (node_key)."""
    asked = positions.join(keys.select("node_key").distinct(), "node_key", "left_semi").select("node_key", "tree_key", "pos", "n_below").alias("a")
    inside = (F.col("a.tree_key") == F.col("d.tree_key")) & (F.col("d.pos") > F.col("a.pos")) & (F.col("d.pos") <= F.col("a.pos") + F.col("a.n_below"))
    return asked.join(positions.alias("d"), inside).select("a.node_key", F.col("d.node_key").alias("descendant_key"))


def _tops(f: Forest) -> DataFrame:
    """(m): the top of every tree; those of merges and opened circles have parents."""
    return f.chains.where("off = 0 and parent is null").select(F.col("x").alias("m"))


def _on_paths(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The place of each node on its chain (x, node_key, chain, at) and the chain prefixes of its tree path (x, node_key, chain, n)."""
    last = F.element_at("segments", -1)
    return (
        at.select("x", "node_key", last["chain"].alias("chain"), last["n"].alias("at")),
        at.select("x", "node_key", F.explode("segments").alias("s")).select("x", "node_key", F.col("s.chain").alias("chain"), F.col("s.n").alias("n")),
    )


def _trees_below(at: DataFrame, graph: DataFrame) -> DataFrame:
    """(x, m): the tops ``m`` of the trees that are reached from each node through an edge above a top."""
    direct = graph.select("v", "m").distinct()
    closure = fresh = cut(direct.join(graph.select(F.col("m").alias("v")).distinct(), "v", "left_semi"))
    while not fresh.isEmpty():  # the newest pairs are as long as all older ones, so lengths double
        found = fresh.join(closure.select(F.col("v").alias("m"), F.col("m").alias("far")), "m").select("v", F.col("far").alias("m")).distinct()
        fresh = cut(found.join(closure, ["v", "m"], "left_anti"))
        closure = cut(closure.union(fresh))
    place, prefix = _on_paths(at)
    vias = graph.select("m", "via").join(prefix.select(F.col("x").alias("via"), "chain", "n"), "via")
    near = cut(vias.join(place.select("x", "chain", "at"), "chain").where("at <= n").select("x", "m").distinct())
    far = near.join(closure.select(F.col("v").alias("m"), F.col("m").alias("far")), "m").select("x", F.col("far").alias("m"))
    return cut(near.union(far).distinct())


def _rooted_paths(f: Forest, at: DataFrame, merged: DataFrame) -> DataFrame:
    """(x, root, depth, path): a path of the fewest steps from each root above a node, through merges.

    Of several such paths into a merge the one over the parent with the smallest key is taken. A path
    is put together from the tree paths of the parents through which it enters merge after merge.
    """
    placed = cut(at.select("x", "anchor", "depth", "node_key").join(full_paths(at), "node_key"))
    pieces = merged.select("m", "root", "d", F.posexplode("vias").alias("i", "via")).join(placed.select(F.col("x").alias("via"), "path"), "via")
    # As many pieces as the path has merges; the path itself is part of the result.
    joined = pieces.groupBy("m", "root", "d").agg(F.array_sort(F.collect_list(F.struct("i", "path"))).alias("ps"))
    leads = joined.select(F.col("m").alias("anchor"), "root", "d", F.concat(F.array_join(F.transform("ps", lambda p: p["path"]), " > "), F.lit(" > ")).alias("lead"))
    own = f.roots.select(F.col("x").alias("anchor"), F.col("x").alias("root"), F.lit(0).cast("bigint").alias("d"), F.lit("").alias("lead"))
    return placed.join(leads.unionByName(own), "anchor").select("x", "root", (F.col("depth") + F.col("d")).alias("depth"), F.concat("lead", "path").alias("path"))


def node_positions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_key, root_key, depth, path, n_below, tree_key, parent_key, tree_depth, pos, n_tree) of every node.

    Nodes, roots and depths are those of ``node_roots``; ``path`` holds the keys of a shortest path from
    the root to the node, joined by " > ", and is "" in the rows of circles and of nodes without a
    root. ``n_below`` counts all descendants, through merges too; a node on a circle is its own
    descendant. The other columns are those of ``tree_positions``, in which the smallest node id of a
    one-parent circle tops a tree as a merge does; ``n_tree`` counts the descendants within the tree.
    """
    f = build_forest(nodes, edges, open_circles=True)
    at = cut(_positions(f))
    graph = _edges_above(f, at, _tops(f), keys=True)
    merged, circle_edges = solve(graph, paths=True)
    rooted = cut(_rooted_paths(f, at, merged))
    circle = _on_circles(f, graph, circle_edges)
    lost = f.ids.select("x").join(rooted.select("x"), "x", "left_anti").join(circle, "x", "left_anti")
    odd = lambda df, n: df.select("x", F.lit("").alias("root_key"), F.lit(n).cast("bigint").alias("depth"), F.lit("").alias("path"))
    names = f.ids.select(F.col("x").alias("root"), F.col("node_key").alias("root_key"))
    found = rooted.join(names, "root").select("x", "root_key", "depth", "path").union(odd(circle, -1)).union(odd(lost, -2))
    sizes = at.where("x = anchor").select(F.col("x").alias("m"), (F.col("n_below") + 1).alias("n"))
    across = _trees_below(at, graph).join(sizes, "m").groupBy("x").agg(F.sum("n").alias("n_across"), F.collect_set("m").alias("tops"))
    loops = f.loops.withColumn("loop", F.lit(1))
    around = F.coalesce(F.array_contains("tops", F.col("anchor")), F.lit(False))
    n_below = F.coalesce("n_across", F.lit(0)) + F.when(around, 0).otherwise(F.col("n_below") + F.coalesce("loop", F.lit(0)))
    counted = at.join(across, "x", "left").join(loops, "x", "left").select(
        "x", "node_key", n_below.cast("bigint").alias("n_below"), "tree_key", "parent_key", F.col("depth").alias("tree_depth"), "pos", F.col("n_below").alias("n_tree")
    )
    return found.join(counted, "x").select("node_key", "root_key", "depth", "path", "n_below", "tree_key", "parent_key", "tree_depth", "pos", "n_tree")


def all_descendants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_key, descendant_key): every descendant of every node, each once, through merges and circles.

    A node on a circle is its own descendant. Pairs within a tree come from chain segments, the others
    from whole trees; a node whose own tree is reached again has that tree from there.
    """
    f = build_forest(nodes, edges, open_circles=True)
    at = cut(_positions(f))
    below = _trees_below(at, _edges_above(f, at, _tops(f)))
    around = cut(below.join(at.select("x", F.col("anchor").alias("m")), ["x", "m"], "left_semi").select("x"))
    place, prefix = _on_paths(at)
    above = place.join(around, "x", "left_anti").select(F.col("x").alias("a"), F.col("node_key").alias("above_key"), "chain", "at")
    inside = above.join(prefix, "chain").where("at <= n and a <> x").select(F.col("above_key").alias("node_key"), F.col("node_key").alias("descendant_key"))
    members = at.select(F.col("anchor").alias("m"), F.col("node_key").alias("descendant_key"))
    across = below.join(f.ids, "x").join(members, "m").select("node_key", "descendant_key")
    loops = f.loops.join(around, "x", "left_anti").join(f.ids, "x").select("node_key", F.col("node_key").alias("descendant_key"))
    return inside.union(across).union(loops)
