"""Spark session and cluster-facing helpers.

Everything here is configuration a Spark user would write: AQE on (skew
splitting and partition coalescing at runtime), the UI off, a UTC session
clock, and a checkpoint folder taken from the cluster's own setting.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest number of rows we are willing to ship to every executor as a
# broadcast side. Beyond it a shuffle join is used instead.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "tripcast", cpus: str | int = "*", shuffle_partitions: int | None = None,
                  event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session.

    ``event_log_dir`` turns on Spark's event log (stage and task metrics) in that folder."""
    parts = shuffle_partitions or (int(cpus) * 2 if str(cpus).isdigit() else 16)
    builder = SparkSession.builder
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # ~128 MB input splits and post-shuffle partitions: partitions stay far below
        # executor memory at any scale; AQE merges small ones and splits skewed ones
        .config("spark.sql.files.maxPartitionBytes", str(128 << 20))
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(128 << 20))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # a remote session has no local SparkContext handle
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the cluster's shared checkpoint folder. A local master without one (tests) gets a folder of
    its own; on a cluster, whose machines would not see it, the setting is required."""
    sc = _context(spark)
    current = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc is None:
        return None
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir: executors of a local cluster have folders of their own")
    local = tempfile.mkdtemp(prefix="tripcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", str(id(spark)))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and return the written table.

    ``checkpoint()`` alone computes its input twice (once for the triggering
    action, once more while writing); persisting first lets the write read the
    first computation. The persisted copy is dropped afterwards: the returned
    frame reads the checkpoint files and has no lineage behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it back: later reads take only the
    columns they need, and the planner knows the table's size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{app_id(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_frame(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table built from literals inside the JVM (no Python RDD,
    so no Python workers are started to read it)."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The proof is a bounded count (``limit(max_rows + 1)``), so the check itself
    never scans more than it needs. Larger inputs are returned unchanged and
    the planner falls back to a shuffle (sort-merge) join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
