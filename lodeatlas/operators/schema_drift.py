"""Schemas that drift between the files of a feed.

Each file is profiled per field: JSON types, number of values and a min-hash sketch of the values. The
profiles of consecutive files are compared; a field found in one of the two only is an end of a
possible rename. Ends whose profiles have a JSON type in common are the candidate edges; only for these
the records are compared. An edge is weighed by its types, sketches, names and agreeing records, and
must have equal values in nine tenths of the records; an optimal bipartite matching between the versions
picks the renames. What is grouped per file has one row per field of a schema, not per record.
"""

from __future__ import annotations

import difflib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeatlas.operators.assignment import best_assignment
from lodeatlas.plans.session import cut
from lodeatlas.sources.json_lines import open_fields

#: Lanes of the min-hash sketch of a field's values.
LANES = 16
#: Least share of equal values among the records that have both fields of a rename.
EQUAL_SHARE = 0.9
#: Least likeness of the names, or share of common members, of fields of different feeds without a rename between them.
ALIKE = 0.6
#: Share of the records from which a field becomes a column, and of its values that its type must fit.
FIELD_SHARE, READ_SHARE = 0.001, 0.9


def file_steps(records: DataFrame) -> DataFrame:
    """(feed, file_no, older): each file of a feed and the file of the next smaller number in it."""
    files = records.select("feed", F.col("file_no").cast("bigint").alias("file_no")).where("file_no is not null").distinct()
    return files.withColumn("older", F.lag("file_no").over(Window.partitionBy("feed").orderBy("file_no")))


def profile(fields: DataFrame) -> DataFrame:
    """One row per feed, file and field: set of JSON types, number of values, value sketch."""
    lanes = [F.min(F.xxhash64(F.lit(i), "value")).alias(f"lane{i}") for i in range(LANES)]
    flags = [F.max(F.col("kind") == k).alias(k) for k in ("array", "boolean", "number", "object", "string")]
    got = fields.groupBy("feed", "file_no", "parent", "path").agg(F.count("*").alias("n_values"), *flags, *lanes)
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("array", "boolean", "number", "object", "string")]))
    return got.select(
        "feed", "file_no", "parent", "path", "n_values", kinds.alias("kinds"), F.array(*[f"lane{i}" for i in range(LANES)]).alias("sketch")
    )


def name_similarity(a: str, b: str) -> float:
    """0 to 1: the larger of the likeness of the letters and the share of common words."""
    words = lambda x: set(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))
    wa, wb = words(a), words(b)
    common = len(wa & wb) / max(1, min(len(wa), len(wb)))
    return max(difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), common)


def edge_weight(old_field: str, new_field: str, equal_share: float, sketch_share: float, kind_share: float) -> float:
    """The weight of a possible rename; what all edges have makes a matching of more renames the heavier one."""
    name = name_similarity(old_field.rpartition(".")[2], new_field.rpartition(".")[2])
    return 20 + 4 * equal_share + 3 * sketch_share + 2 * kind_share + 2 * name


def match_edges(edges: list[dict]) -> list[tuple[str, str]]:
    """(old_field, new_field) of the best matching among the edges of one file and level."""
    old, new = sorted({e["old_field"] for e in edges}), sorted({e["new_field"] for e in edges})
    weight = np.zeros((len(old), len(new)))
    for e in edges:
        weight[old.index(e["old_field"]), new.index(e["new_field"])] = edge_weight(**e)
    return [(old[a], new[b]) for a, b in best_assignment(weight)]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [match_edges(e) for e in batch.column(2).to_pylist()]
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        fields = [pa.array([p[k] for f in found for p in f], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *fields], names=["feed", "file_no", "old_field", "new_field"])


def schema_changes(records: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(feed, file_no, change_kind, old_field, new_field) between each file of a feed and the one before it.

    ``retyped``, ``renamed``, ``added`` (old_field "") and ``removed`` (new_field ""). Members of an
    object are compared if the object has the same name in both files and is an object in both. A
    repeated line counts once; of two different records of a provider and id in one file the later
    line counts for renames. Broken lines are ignored; a file of broken lines only has no fields.
    Records without a feed or provider count as those of an unnamed one; without a file number they
    are left out.
    """
    fields = cut(open_fields(records, texts=False)) if fields is None else fields
    steps = cut(file_steps(records))
    later = steps.where("older is not null")
    prof = cut(profile(fields))

    key = lambda a, b: (F.col(f"{a}.feed").eqNullSafe(F.col(f"{b}.feed"))) & (F.col(f"{a}.parent") == F.col(f"{b}.parent")) & (F.col(f"{a}.path") == F.col(f"{b}.path"))
    new = prof.join(later.withColumnRenamed("feed", "f"), F.col("feed").eqNullSafe(F.col("f")) & (prof["file_no"] == later["file_no"])).select("feed", later["file_no"], "parent", "path", "kinds", "sketch")
    following = later.select(F.col("feed").alias("f"), F.col("file_no").alias("newer"), F.col("older").alias("o"))
    old = prof.join(following, F.col("feed").eqNullSafe(F.col("f")) & (F.col("file_no") == F.col("o"))).select("feed", F.col("newer").alias("file_no"), "parent", "path", "kinds", "sketch")
    both = old.alias("o").join(new.alias("n"), key("o", "n") & (F.col("o.file_no") == F.col("n.file_no")), "full")
    compared = both.select(
        F.coalesce("o.feed", "n.feed").alias("feed"),
        F.coalesce("o.file_no", "n.file_no").alias("file_no"),
        F.coalesce("o.parent", "n.parent").alias("parent"),
        F.coalesce("o.path", "n.path").alias("path"),
        F.col("o.kinds").alias("old_kinds"),
        F.col("n.kinds").alias("new_kinds"),
        F.col("o.sketch").alias("old_sketch"),
        F.col("n.sketch").alias("new_sketch"),
    )
    objects = compared.where("parent = '' and array_contains(old_kinds, 'object') and array_contains(new_kinds, 'object')").select(
        F.col("feed").alias("of"), F.col("file_no").alias("on"), F.col("path").alias("op")
    )
    open_ = F.col("feed").eqNullSafe(F.col("of")) & (F.col("file_no") == F.col("on")) & (F.col("parent") == F.col("op"))
    members = compared.where("parent <> ''").join(objects, open_, "left_semi")
    compared = cut(compared.where("parent = ''").unionByName(members))

    gone, came = compared.where("new_kinds is null"), compared.where("old_kinds is null")
    old_ends = gone.select("feed", "file_no", "parent", F.col("path").alias("old_field"), "old_kinds", "old_sketch")
    new_ends = came.select("feed", "file_no", "parent", F.col("path").alias("new_field"), "new_kinds", "new_sketch")
    level = F.col("o.feed").eqNullSafe(F.col("n.feed")) & (F.col("o.file_no") == F.col("n.file_no")) & (F.col("o.parent") == F.col("n.parent"))
    common = F.size(F.array_intersect("old_kinds", "new_kinds"))
    alike = F.size(F.filter(F.zip_with("old_sketch", "new_sketch", lambda a, b: a == b), lambda x: x)) / LANES
    edges = cut(
        old_ends.alias("o").join(new_ends.alias("n"), level & (common > 0))
        .select("o.feed", "o.file_no", "o.parent", "old_field", "new_field", alike.alias("sketch_share"), (common / F.size(F.array_union("old_kinds", "new_kinds"))).alias("kind_share"))
        .join(following.select(F.col("f").alias("f2"), "newer", "o"), F.col("feed").eqNullSafe(F.col("f2")) & (F.col("file_no") == F.col("newer"))).drop("f2", "newer")
    )

    def ends(side: str, at: str) -> DataFrame:
        """The values at the ends of the edges: of a record that is there twice the one of the later line."""
        wanted = edges.select(F.col("feed").alias("f2"), F.col(at).alias("at"), F.col("file_no").alias("step"), F.col(f"{side}_field").alias("field")).distinct()
        rows = fields.join(wanted, F.col("feed").eqNullSafe(F.col("f2")) & (fields["file_no"] == F.col("at")) & (F.col("path") == F.col("field")))
        return rows.groupBy("feed", F.col("step").alias("file_no"), "provider", "id", "parent", F.col("path").alias(f"{side}_field")).agg(F.max_by("value", "line_no").alias(f"{side}_value"))

    e = edges.select(F.col("feed").alias("ef"), F.col("file_no").alias("en"), F.col("old_field").alias("eo"), F.col("new_field").alias("wanted_field"))
    o = ends("old", "o").join(e, F.col("feed").eqNullSafe(F.col("ef")) & (F.col("file_no") == F.col("en")) & (F.col("old_field") == F.col("eo"))).alias("o")
    n = ends("new", "file_no").alias("n")
    same_record = level & F.col("o.provider").eqNullSafe(F.col("n.provider")) & (F.col("o.id") == F.col("n.id")) & (F.col("o.wanted_field") == F.col("n.new_field"))
    agreed = (
        o.join(n, same_record).groupBy(F.col("o.feed").alias("feed"), F.col("o.file_no").alias("file_no"), "old_field", "new_field")
        .agg(F.avg((F.col("old_value") == F.col("new_value")).cast("double")).alias("equal_share")).where(F.col("equal_share") >= EQUAL_SHARE)
    )
    a, b = agreed.alias("a"), edges.alias("b")
    weighed = a.join(b, F.col("a.feed").eqNullSafe(F.col("b.feed")) & (F.col("a.file_no") == F.col("b.file_no")) & (F.col("a.old_field") == F.col("b.old_field")) & (F.col("a.new_field") == F.col("b.new_field")))
    edge = F.struct("a.old_field", "a.new_field", "equal_share", "sketch_share", "kind_share")
    # As many edges as one level of one file has pairs of vanished and new fields.
    levels = weighed.groupBy("b.feed", "b.file_no", "b.parent").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = levels.select("feed", "file_no", "edges").repartition(tasks, "feed", "file_no")
    renames = cut(spread.mapInArrow(_matched, "feed string, file_no bigint, old_field string, new_field string"))

    def without(df: DataFrame, field: str) -> DataFrame:
        r = renames.select(F.col("feed").alias("f2"), F.col("file_no").alias("n2"), F.col(field).alias("e2"))
        return df.join(r, F.col("feed").eqNullSafe(F.col("f2")) & (F.col("file_no") == F.col("n2")) & (F.col(field) == F.col("e2")), "left_anti")

    row = lambda df, kind, a, b: df.select("feed", "file_no", F.lit(kind).alias("change_kind"), a.alias("old_field"), b.alias("new_field"))
    retyped = compared.where("old_kinds is not null and new_kinds is not null and old_kinds <> new_kinds")
    none = F.lit("")
    return (
        row(retyped, "retyped", F.col("path"), F.col("path"))
        .unionByName(row(renames, "renamed", F.col("old_field"), F.col("new_field")))
        .unionByName(row(without(old_ends, "old_field"), "removed", F.col("old_field"), none))
        .unionByName(row(without(new_ends, "new_field"), "added", none, F.col("new_field")))
    )


def _canonical_names(chains: pd.DataFrame) -> pd.DataFrame:
    """Follow the renames of one feed through its files; names are those of the earliest file."""
    known: dict[str, str] = {}
    out = []
    feed = chains["feed"].iloc[0]
    for r in chains.sort_values("file_no").itertuples():
        known[r.new_field] = known.get(r.old_field, r.old_field)
        out.append((feed, int(r.file_no), r.new_field, known[r.new_field]))
    return pd.DataFrame(out, columns=["feed", "from_file", "field", "unified"]).astype({"from_file": "int64"})


def _clusters(names: dict[str, tuple], votes: dict[tuple, int], apart: set[tuple], like: dict[tuple, float]) -> dict[str, str]:
    """Each name's common name; ``names`` gives how widely a name is used.

    Names are put together by renames seen inside feeds, the most frequent first, then by likeness, but
    never if any two of them stand side by side in a file: those are different fields.
    """
    group = {n: {n} for n in names}
    order = sorted(votes, key=lambda p: (-votes[p], p)) + sorted(like, key=lambda p: (-like[p], p))
    for a, b in order:
        if a in group and b in group and group[a] is not group[b]:
            if not any((x, y) in apart or (y, x) in apart for x in group[a] for y in group[b]):
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return {n: min(g, key=lambda x: ([-u for u in names[x]], x)) for n, g in group.items()}


def _common_names(facts: pd.DataFrame) -> pd.DataFrame:
    """(top, leaf, common_top, common_leaf) of all names of all feeds; a field at the top has leaf ""."""
    split = lambda path, parent: (parent, path[len(parent) + 1 :]) if parent else (path, "")
    used = {split(r.a, r.parent): r for r in facts[facts["fact"] == "used"].itertuples()}
    pairs = [(r.fact, split(r.a, r.parent), split(r.b, r.parent), int(r.n)) for r in facts[facts["fact"] != "used"].itertuples()]
    leaves: dict[str, dict[str, set]] = defaultdict(dict)
    for (top, leaf), r in used.items():
        if leaf:
            leaves[top][leaf] = set(r.kinds)

    def likeness(a: str, b: str, ra: tuple, rb: tuple, members: float = 0.0) -> float:
        if not set(ra.kinds) & set(rb.kinds):
            return 0.0
        name = max(name_similarity(a, b), members)
        return name + sum(x == y for x, y in zip(ra.sketch, rb.sketch)) / LANES if name >= ALIKE else 0.0

    def members(a: str, b: str) -> float:
        both = [x for x in leaves[a].keys() & leaves[b].keys() if leaves[a][x] & leaves[b][x]]
        return len(both) / max(1, len(leaves[a].keys() | leaves[b].keys()))

    tops = sorted(t for t, leaf in used if not leaf)
    level = lambda fact: [(x[0], y[0], n) for f, x, y, n in pairs if f == fact and not x[1]]
    like = {(a, b): w for i, a in enumerate(tops) for b in tops[i + 1 :] if (w := likeness(a, b, used[a, ""], used[b, ""], members(a, b)))}
    common = _clusters({t: (used[t, ""].n, used[t, ""].n_first) for t in tops}, {x[:2]: x[2] for x in level("renamed")}, {x[:2] for x in level("together")}, like)
    out = [(t, "", common[t], "") for t in tops]
    for head in sorted(set(common.values())):
        mine = sorted(k for k in used if k[1] and common.get(k[0]) == head)
        counts: dict[str, list] = defaultdict(lambda: [0, 0])
        some: dict[str, tuple] = {}
        for k in mine:
            counts[k[1]][0] += used[k].n
            counts[k[1]][1] += used[k].n_first
            some[k[1]] = max(some.get(k[1], used[k]), used[k], key=lambda r: r.n)
        votes: dict[tuple, int] = defaultdict(int)
        apart = set()
        for fact, x, y, n in pairs:
            if x[1] and common.get(x[0]) == head:
                if fact == "together":
                    apart.add((x[1], y[1]))
                else:
                    votes[x[1], y[1]] += n
        names = sorted(counts)
        like = {(a, b): w for i, a in enumerate(names) for b in names[i + 1 :] if (w := likeness(a, b, some[a], some[b]))}
        leaf = _clusters({n: tuple(c) for n, c in counts.items()}, votes, apart, like)
        out += [(k[0], k[1], head, leaf[k[1]]) for k in mine]
        # A member may get a top under which it never stood, when the object was renamed inside its feed.
        out += [(t, n, head, leaf[n]) for t in tops if common[t] == head for n in names if (t, n) not in used]
    return pd.DataFrame(out, columns=["top", "leaf", "common_top", "common_leaf"])


def unify(records: DataFrame) -> DataFrame:
    """All readable records in one shape: (feed, file_no, line_no, provider, id, fields map<string, string>).

    Inside a feed a field is followed through its renames to its first name; the names of all feeds are
    then matched to common ones, of which the name that most feeds use stands for the others. The
    values are JSON text, so a field whose type changed keeps each value as it came. A name that is
    used again for another field after a rename keeps the latest mapping at that file. Members of a
    renamed object go with the object. If two fields of a file get one name, the second is kept as
    name~path.
    """
    fields = cut(open_fields(records))
    renames = cut(schema_changes(records, fields).where("change_kind = 'renamed'"))
    keyed = renames.select(F.coalesce("feed", F.lit("")).alias("feed_key"), "feed", "file_no", "old_field", "new_field")
    names = cut(keyed.groupBy("feed_key").applyInPandas(_canonical_names, "feed string, from_file bigint, field string, unified string"))
    raw = cut(fields.select("feed", "file_no", "parent", "path").distinct())

    def mapped(df: DataFrame, field: str, out: str) -> DataFrame:
        n = names.select(F.col("feed").alias("nf"), "from_file", "field", "unified")
        hit = df.join(n, F.col("feed").eqNullSafe(F.col("nf")) & (F.col(field) == F.col("field")) & (F.col("from_file") <= F.col("file_no")), "left")
        return hit.groupBy(*df.columns).agg(F.max_by("unified", "from_file").alias(out))

    inner = F.col("parent") != ""
    top = F.when(inner, F.col("parent")).otherwise(F.col("path"))
    member = F.when(inner, F.col("path"))
    per_file = mapped(mapped(raw.withColumns({"top": top, "member": member}), "top", "top_name"), "member", "member_name")
    # The name of a member may hold points itself, so only the name of its object is taken off.
    own_leaf = F.when(inner, F.expr("substr(path, length(parent) + 2)")).otherwise("")
    old_leaf = F.when(F.col("member_name").isNull(), own_leaf).otherwise(F.regexp_extract("member_name", r"([^.]*)$", 1))
    per_file = cut(per_file.select("feed", "file_no", "parent", "path", F.coalesce("top_name", "top").alias("top"), old_leaf.alias("leaf")))

    feed = F.coalesce("feed", F.lit(""))
    first = F.when((F.col("top") == F.when(inner, F.col("parent")).otherwise(F.col("path"))) & (F.col("leaf") == own_leaf), feed)
    use = per_file.groupBy("parent", "path").agg(F.count_distinct(feed).alias("n"), F.count_distinct(first).alias("n_first"))
    lanes = [F.min(F.xxhash64(F.lit(i), "value")).alias(f"lane{i}") for i in range(LANES)]
    seen = fields.groupBy("parent", "path").agg(F.collect_set("kind").alias("kinds"), *lanes)
    used = use.join(seen, ["parent", "path"]).select(
        F.lit("used").alias("fact"), "parent", F.col("path").alias("a"), F.lit("").alias("b"), "n", "n_first", "kinds", F.array(*[f"lane{i}" for i in range(LANES)]).alias("sketch")
    )
    none = [F.lit(0).cast("bigint").alias("n_first"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<bigint>").alias("sketch")]
    parents = raw.select("parent", F.col("path").alias("new_field")).distinct()
    renamed = renames.join(parents, "new_field").groupBy("parent", F.col("old_field").alias("a"), F.col("new_field").alias("b")).agg(F.count_distinct(feed).alias("n"))
    schemas = raw.groupBy("feed", "file_no", "parent").agg(F.array_sort(F.collect_set("path")).alias("paths")).select("parent", "paths").distinct()
    together = schemas.select("parent", "paths", F.explode("paths").alias("a")).select("parent", "a", F.explode("paths").alias("b")).where("a < b").distinct()
    pairs = lambda df, fact, n: df.select(F.lit(fact).alias("fact"), "parent", "a", "b", n.cast("bigint").alias("n"), *none)
    facts = used.unionByName(pairs(renamed, "renamed", F.col("n"))).unionByName(pairs(together, "together", F.lit(1)))
    # Names, not records: as many rows as the feeds have different fields and pairs of them.
    common = facts.groupBy().applyInPandas(_common_names, "top string, leaf string, common_top string, common_leaf string")
    named = per_file.join(F.broadcast(cut(common)), ["top", "leaf"], "left")
    base_top, base_leaf = F.coalesce("common_top", "top"), F.coalesce("common_leaf", "leaf")
    named = named.withColumn("unified", F.when(inner, F.concat(base_top, F.lit("."), base_leaf)).otherwise(base_top))
    twice = Window.partitionBy("feed", "file_no", "unified").orderBy((F.col("path") == F.col("unified")).desc(), "path")
    unified = F.when(F.row_number().over(twice) == 1, F.col("unified")).otherwise(F.concat("unified", F.lit("~"), "path"))
    lookup = named.select(F.col("feed").alias("lf"), F.col("file_no").alias("ln"), F.col("parent").alias("lq"), F.col("path").alias("lp"), unified.alias("unified"))
    same = F.col("feed").eqNullSafe(F.col("lf")) & F.col("file_no").eqNullSafe(F.col("ln")) & (F.col("parent") == F.col("lq")) & (F.col("path") == F.col("lp"))
    named = fields.join(cut(lookup), same)
    # The number of fields of one record is bounded by its line, so this list is too. A line that is there twice counts once.
    entries = named.groupBy("feed", "file_no", "line_no", "provider", "id").agg(F.array_sort(F.collect_set(F.struct("unified", "text"))).alias("e"))
    first = F.filter("e", lambda x, i: F.coalesce(F.get("e", i - 1)["unified"] != x["unified"], F.lit(True)))
    return entries.select("feed", "file_no", "line_no", "provider", "id", F.map_from_entries(first).alias("fields"))


# What is written where a boolean is meant.
_TRUE, _FALSE = ["true", '"true"', '"yes"', '"on"', "1"], ["false", '"false"', '"no"', '"off"', "0"]


def _boolean(text: Column) -> Column:
    return F.when(F.lower(text).isin(_TRUE), True).when(F.lower(text).isin(_FALSE), False)


def _number(text: Column) -> Column:
    """A JSON number, or a string that is one, with or without a currency sign."""
    return F.regexp_replace(text, r'^"\s*[$€£]?\s*([-+0-9.eE]+)\s*"$', "$1").try_cast("double")


def plain_text(text: Column) -> Column:
    """The characters of a JSON string; any other value as JSON text."""
    return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"s":'), text, F.lit("}")), "$.s")).otherwise(text)


def typed(unified: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``unified`` with a column of one type for each common field, and (field, type) of these in order.

    A field is boolean or double if nine tenths of its values that are no objects can be read so (also
    "yes", 0, "$2.50"), else string; what can't be read is null there and stays in ``fields``. Only fields of a thousandth
    of the records become columns, so their number is bounded; all are in ``fields``. The points and
    other signs in the name of a field become underscores in that of its column.
    """
    held = cut(unified)
    cells = held.select(F.explode("fields").alias("name", "text"))
    # The members of an object are fields of their own, so an object doesn't count against a type.
    seen = cells.groupBy("name").agg(F.count("*").alias("all"), F.count_if(~F.col("text").startswith("{")).alias("n"), F.count(_boolean(F.col("text"))).alias("boolean"), F.count(_number(F.col("text"))).alias("double"))
    least = FIELD_SHARE * held.count()
    kind = F.when(F.col("n") == 0, "string").when(F.col("boolean") >= READ_SHARE * F.col("n"), "boolean").when(F.col("double") >= READ_SHARE * F.col("n"), "double").otherwise("string")
    columns = [(r.name, r.kind) for r in seen.where(F.col("all") >= least).select("name", kind.alias("kind")).orderBy("name").collect()]
    read = {"boolean": _boolean, "double": _number, "string": plain_text}
    named: dict[str, Column] = {}
    for name, k in columns:
        column = re.sub(r"\W", "_", name)
        while column.lower() in {c.lower() for c in (*held.columns, *named)}:
            column += "_"
        named[column] = read[k](F.element_at("fields", name))
    return held.select("*", *[c.alias(n) for n, c in named.items()]), columns
