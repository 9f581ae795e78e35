"""The curated lineage of models: attaching it to rows, and walking it up and down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.functions import vocabulary as V
from lodeatlas.functions.enums import is_known_family
from lodeatlas.operators.errors import CatalogError
from lodeatlas.plans.session import cut

SCHEMA = (
    "child_id string, child_ref struct<family:string,variant:string,version:string,modifier:array<string>>, real boolean, "
    "parents array<struct<family:string,variant:string,version:string,kind:string>>"
)


def validate(records: list[tuple]) -> None:
    """Raise for a record without child or parents, of an unknown parent family or kind."""
    for child, _, _, parents in records:
        if not child or not parents:
            raise CatalogError(f"lineage record {child!r} needs a child and a parent")
        for family, _, _, kind in parents:
            if not is_known_family(family):
                raise CatalogError(f"lineage of {child!r}: unknown family {family!r}")
            if kind not in V.DERIVATION_KINDS:
                raise CatalogError(f"lineage of {child!r}: unknown kind {kind!r}")


def curated(spark: SparkSession, strict: bool = True) -> DataFrame:
    """The curated table; with ``strict`` off a faulty one is empty instead of an error."""
    try:
        validate(V.LINEAGE)
    except CatalogError:
        if strict:
            raise
        return spark.createDataFrame([], SCHEMA)
    return spark.createDataFrame(V.LINEAGE, SCHEMA)


def attach(models: DataFrame, lineage: DataFrame, payload: str = "parents") -> DataFrame:
    """``models`` with the record of its identifier, in lower case, else of what follows its last slash.

    The table of records is small beside the catalog, so both lookups are joins in which the planner
    may send it to the rows; only rows without a record of their own ask for their tail.
    """
    low = F.lower("model_id")
    # Of several records of a child the smallest counts.
    records = lineage.groupBy(F.lower("child_id").alias("_key")).agg(F.min(payload).alias(payload))
    # Identifiers without a slash get a second key of their own that matches nothing, instead of one null for all.
    keyed = models.withColumn("_tail", F.when(F.instr(low, "/") > 0, C.last_segment(low)).otherwise(F.concat(F.lit("\x00"), low)))
    full = keyed.join(records.withColumnsRenamed({"_key": "_k1", payload: "_p1"}), low == F.col("_k1"), "left")
    both = full.join(records.withColumnsRenamed({"_key": "_k2", payload: "_p2"}), F.col("_k1").isNull() & (F.col("_tail") == F.col("_k2")), "left")
    return both.withColumn(payload, F.coalesce("_p1", "_p2")).drop("_tail", "_k1", "_p1", "_k2", "_p2")


def edges(lineage: DataFrame) -> DataFrame:
    """(child_key, parent_key, kind) of each derivation."""
    key = lambda s, mods: C.entity_key(F.col(f"{s}.family"), F.col(f"{s}.variant"), F.col(f"{s}.version"), mods)
    rows = lineage.select(key("child_ref", F.col("child_ref.modifier")).alias("child_key"), F.explode("parents").alias("p"))
    return rows.select("child_key", key("p", F.lit(None).cast("array<string>")).alias("parent_key"), F.col("p.kind").alias("kind"))


#: Steps that go into one plan.
STEPS_AT_ONCE = 4


def closure(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(start, node, depth): everything reached from ``starts`` (start) along ``steps`` (src, dst), nearest first.

    Semi-naive: only what was newly or more shortly reached goes on, so circles end, and several steps
    go into one plan. The start itself is no result.
    """
    state = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    fresh = state
    while not fresh.isEmpty():
        wave, reached = fresh, None
        for _ in range(STEPS_AT_ONCE):
            wave = wave.join(steps, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
            reached = wave if reached is None else reached.union(wave)
        both = state.withColumn("known", F.col("depth")).unionByName(reached.withColumn("known", F.lit(None).cast("int")))
        merged = cut(both.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("known").alias("known")))
        fresh = merged.where("known is null or depth < known").select("start", "node", "depth")
        state = merged.select("start", "node", "depth")
    return state.where("start <> node or start is null")


def ancestors(starts: DataFrame, lineage_edges: DataFrame) -> DataFrame:
    return closure(starts, cut(lineage_edges.select(F.col("child_key").alias("src"), F.col("parent_key").alias("dst")).distinct()))


def descendants(starts: DataFrame, lineage_edges: DataFrame) -> DataFrame:
    return closure(starts, cut(lineage_edges.select(F.col("parent_key").alias("src"), F.col("child_key").alias("dst")).distinct()))
