"""Helpers shared by the training-data operators.

Text columns reach Python as Arrow batches. ``utf8`` exposes a batch's texts as
one byte array plus row bounds, so per-byte work is a few numpy passes over the
whole batch instead of a Python loop over rows.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bounds of an Arrow batch sent to a Python worker (rows, bytes): a worker's memory follows these, not the partition.
BATCH_ROWS = 1_000
BATCH_BYTES = 2 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a session: their Python need not have it installed."""
    sc = spark.sparkContext
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = f"{os.path.basename(top)}-modules.zip"
    if name in sc._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(), name)  # the driver's own copy; executors fetch it from Spark
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, send the package and make sure a checkpoint folder is known."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: other columns, also ones with clashing names, are left behind; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, int64 bounds with one entry more than rows) of a string or binary Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def empty_safe_size(df: DataFrame, size: Column) -> int:
    """Sum of ``size`` over all rows (0 for an empty table): one number reaches the driver."""
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"])
