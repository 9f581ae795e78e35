"""Session helpers: table access, lineage cuts and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = 8, partitions: int = 8, name: str = "lodeatlas") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODEATLAS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they run and whatever their path is.

    The archive is written where the driver runs and handed out by Spark; no executor reads a folder
    of another machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lodeatlas_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="lodeatlas-ship-")) / "lodeatlas.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    sc._lodeatlas_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodeatlas-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    A table is used rather than ``checkpoint()`` because it forgets the plan's inferred constraints,
    which otherwise grow from round to round of an iteration, and because its true size is known to
    the planner of the next step. Losing an executor loses nothing of it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
