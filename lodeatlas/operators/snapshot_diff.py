"""What changed between full snapshots.

Every key has a persistent ordinal, kept in a table: a key that was seen once keeps its number, new keys
get new ones. The rows of a snapshot are put together in containers of neighbouring ordinals; a container
holds a compressed bitmap of the keys that are there and, for each compared column, a vector of values in
the order of the ordinals. Two snapshots are compared container by container: ``new AND NOT old`` are the
added, ``old AND NOT new`` the removed keys, and under ``old AND new`` the aligned vectors show the
changed ones.

``diff_snapshots`` does this for all snapshots of a table at once; ``SnapshotLog`` keeps ordinals and
the containers of the last snapshot between deliveries, so that a new one is compared without reading any
older delivery. Rows are aggregated per snapshot and full key with a combine before the shuffle, so
neither a hot provider nor a key delivered very often fills one task; a container is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeatlas.functions.instants import instant_micros
from lodeatlas.operators.bitmaps import CONTAINER, compress, packed, places
from lodeatlas.plans.session import cut, ship_package

#: Bits of an ordinal below the number of the delivery in which the key was new.
DELIVERY_BITS = 48


def latest_per_snapshot(
    rows: DataFrame, snapshot: str, keys: Sequence[str], values: Sequence[str], recency: str
) -> DataFrame:
    """One row per snapshot and key: the one with the latest instant in ``recency``.

    A recency that is no instant counts as older than any; rows of the same instant are ordered by
    their values, so the result does not depend on the order of the rows. Rows without a snapshot
    number belong to no snapshot and are left out. A null in a key is a value of its own.
    """
    ranked = rows.where(F.col(snapshot).isNotNull()).select(
        F.col(snapshot).alias("snap"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.struct(
            F.coalesce(instant_micros(F.col(recency)), F.lit(-(2**62))).alias("at"),
            *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)],
        ).alias("row"),
    )
    return ranked.groupBy("snap", *[f"k{i}" for i in range(len(keys))]).agg(F.max("row").alias("row"))


def snapshot_steps(rows: DataFrame, snapshot: str) -> DataFrame:
    """(snap, step): the snapshots that exist, numbered without gaps. One row per delivery."""
    numbers = rows.select(F.col(snapshot).alias("snap")).where("snap is not null").distinct()
    return numbers.withColumn("step", F.row_number().over(Window.orderBy("snap")) - 1)


def _equal(a: str, b: str, names: Sequence[str]):
    return reduce(lambda x, n: x & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")), names, F.lit(True))


def new_ordinals(keys: DataFrame, names: Sequence[str], known: DataFrame | None, delivery: int) -> DataFrame:
    """(names..., ordinal) of the keys that are not in ``known``; neighbours within a task get neighbouring numbers."""
    if known is not None:
        keys = keys.alias("n").join(known.alias("k"), _equal("n", "k", names), "left_anti")
    return keys.withColumn("ordinal", F.lit(delivery << DELIVERY_BITS) + F.monotonically_increasing_id())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = batch.column(2)
        bounds = slots.offsets.to_numpy()
        flat = slots.flatten().to_numpy()
        base = bounds[0]
        held = [compress(flat[a - base : b - base]) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary()), batch.column(3)], names=["container", "step", "present", "vectors"])


def containers(numbered: DataFrame, n_values: int) -> DataFrame:
    """(container, step, present, vectors) of rows (ordinal, step, v0...): a bitmap, and the values in its order."""
    vector = F.struct(*[F.col(f"v{i}") for i in range(n_values)])
    cell = F.struct((F.col("ordinal") % CONTAINER).cast("int").alias("slot"), vector.alias("v"))
    grouped = numbered.groupBy(F.floor(F.col("ordinal") / CONTAINER).cast("bigint").alias("container"), "step").agg(F.array_sort(F.collect_list(cell), lambda x, y: x["slot"] - y["slot"]).alias("cells"))
    aligned = grouped.select("container", "step", F.transform("cells", lambda c: c["slot"]).alias("slots"), F.transform("cells", lambda c: c["v"]).alias("vectors"))
    schema = T.StructType([T.StructField("container", T.LongType()), T.StructField("step", T.IntegerType()), T.StructField("present", T.BinaryType()), aligned.schema["vectors"]])
    return aligned.mapInArrow(_pack, schema)


def _differs(old: pa.Array, new: pa.Array) -> np.ndarray:
    """Where two aligned vectors differ; null equals null only, NaN equals NaN."""
    codes = pa.concat_arrays([old, new]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[: len(old)] != codes[len(old) :]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        container, step, old_set, old_values, new_set, new_values = (batch.column(i) for i in range(6))
        out_step, out_ordinal, out_kind = [], [], []
        for i in range(batch.num_rows):
            old, new = packed(old_set[i].as_py()), packed(new_set[i].as_py())
            both = old & new
            changed = places(both)
            if len(changed):
                # The values of a key stand where its bit stands among the bits that are set.
                in_old, in_new = (pa.array(np.flatnonzero(np.unpackbits(both)[places(x)])) for x in (old, new))
                a, b = old_values[i].values.take(in_old), new_values[i].values.take(in_new)
                differs = reduce(np.logical_or, (_differs(x, y) for x, y in zip(a.flatten(), b.flatten())), np.zeros(len(changed), bool))
                changed = changed[differs]
            for kind, found in (("added", places(new & ~old)), ("removed", places(old & ~new)), ("changed", changed)):
                if len(found):
                    out_step.append(np.full(len(found), step[i].as_py(), np.int32))
                    out_ordinal.append(found + container[i].as_py() * CONTAINER)
                    out_kind += [kind] * len(found)
        if out_step:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_step)), pa.array(np.concatenate(out_ordinal)), pa.array(out_kind)], names=["step", "ordinal", "change_kind"])


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(step, ordinal, change_kind) between containers ``old`` and ``new`` of the same (container, step)."""
    o, n = old.alias("o"), new.alias("n")
    pairs = o.join(n, (F.col("o.container") == F.col("n.container")) & (F.col("o.step") == F.col("n.step")), "full")
    laid = pairs.select(F.coalesce("o.container", "n.container"), F.coalesce("o.step", "n.step"), "o.present", "o.vectors", "n.present", "n.vectors").toDF("container", "step", "op", "ov", "np", "nv")
    return laid.mapInArrow(_compare, "step int, ordinal bigint, change_kind string")


def _prepared(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """0.0 and -0.0 are the same value."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.withColumns({v: F.col(v) + F.lit(0.0) for v in values if isinstance(kinds[v], (T.DoubleType, T.FloatType))})


def _numbered(latest: DataFrame, ordinals: DataFrame, names: Sequence[str], n_values: int) -> DataFrame:
    return latest.alias("l").join(ordinals.alias("o"), _equal("l", "o", names)).select("o.ordinal", "l.step", *[F.col(f"l.row.v{i}").alias(f"v{i}") for i in range(n_values)])


def diff_snapshots(
    rows: DataFrame,
    snapshot: str = "snapshot_no",
    keys: Sequence[str] = ("provider", "model_id"),
    values: Sequence[str] = ("cost_input", "cost_output", "context_window", "display_name"),
    recency: str = "last_synced",
) -> DataFrame:
    """(snapshot, keys..., change_kind) for every change from a snapshot to the next larger number.

    ``added``: key only in the newer; ``removed``: key only in the older, reported under the newer
    number; ``changed``: a value differs, null differing from every value but null. The first
    snapshot has no rows; a table with no or one snapshot gives an empty result. Columns besides the
    named ones are ignored, whatever their names. NaN equals NaN; 0.0 equals -0.0.
    """
    ship_package(rows.sparkSession)
    rows = _prepared(rows, values)
    steps = cut(snapshot_steps(rows, snapshot))
    names = [f"k{i}" for i in range(len(keys))]
    latest = cut(latest_per_snapshot(rows, snapshot, keys, values, recency).join(F.broadcast(steps), "snap"))
    ordinals = cut(new_ordinals(latest.select(*names).distinct(), names, None, 0))
    held = cut(containers(_numbered(latest, ordinals, names, len(values)), len(values)))
    following = held.withColumn("step", F.col("step") + 1).join(F.broadcast(steps.select("step")), "step", "left_semi").select(*held.columns)
    changes = compare(following, held.where("step > 0"))
    named = changes.join(ordinals, "ordinal").join(F.broadcast(steps), "step")
    return named.select(F.col("snap").alias(snapshot), *[F.col(n).alias(k) for n, k in zip(names, keys)], "change_kind")


class SnapshotLog:
    """Ordinals and the last snapshot's containers, kept in a folder between deliveries.

    Every delivery adds a folder of its own with the ordinals of its new keys and its containers, and a
    mark when it is whole; a delivery that broke off is written again. There is one writer.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("provider", "model_id"), values: Sequence[str] = ("cost_input", "cost_output", "context_window", "display_name"), recency: str = "last_synced"):
        self.spark, self.path, self.keys, self.values, self.recency = spark, path.rstrip("/"), list(keys), list(values), recency
        self.names = [f"k{i}" for i in range(len(self.keys))]

    def deliveries(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        whole = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath().toString() + "/held/_SUCCESS"))]
        return sorted(int(p.getName()) for p in whole)

    def deliver(self, rows: DataFrame) -> DataFrame:
        """(keys..., change_kind) of a whole snapshot against the one delivered before it; nothing for the first."""
        ship_package(self.spark)
        done = self.deliveries()
        n = done[-1] + 1 if done else 0
        rows = _prepared(rows, self.values).withColumn("_one", F.lit(n))
        latest = cut(latest_per_snapshot(rows, "_one", self.keys, self.values, self.recency).withColumn("step", F.lit(n)))
        known = self.spark.read.parquet(*[f"{self.path}/{k}/ordinals" for k in done]) if done else None
        here = f"{self.path}/{n}"
        new_ordinals(latest.select(*self.names).distinct(), self.names, known, n).write.mode("overwrite").parquet(f"{here}/ordinals")
        fresh = self.spark.read.parquet(f"{here}/ordinals")
        ordinals = fresh if known is None else known.unionByName(fresh)
        containers(_numbered(latest, ordinals, self.names, len(self.values)), len(self.values)).write.mode("overwrite").parquet(f"{here}/held")
        held = self.spark.read.parquet(f"{here}/held")
        old = self.spark.read.parquet(f"{self.path}/{done[-1]}/held").withColumn("step", F.lit(n)) if done else held
        changes = compare(old.select(*held.columns), held)
        return changes.join(ordinals, "ordinal").select(*[F.col(k).alias(o) for k, o in zip(self.names, self.keys)], "change_kind")
