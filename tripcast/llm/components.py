"""Connected components by alternating star contractions; edges stay distributed.

Each round links every node's larger neighbours to its smallest one, then every
node's smaller neighbours to its smallest one, until the edges are stars (none if
they are stars already). Rounds
grow with the logarithm of the longest path. Both contractions aggregate before
they shuffle, and a node with many neighbours meets them in a sort-merge join
that Spark can split. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import app_id, ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{app_id(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u, v), u > v."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    moved = (joined.where("v > u") if large else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m < u").select("u", F.col("m").alias("v"))
    return moved.unionAll(own).where("u > v").groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v")


def _only_stars(edges: DataFrame) -> bool:
    """Does every node with a smaller neighbour have just one, which has none itself? One exchange by node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    by_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return by_node.where("down > 1 or (down = 1 and up = 1)").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    now = written(now, "edges")
    while not _only_stars(now):
        now = written(_star(_star(now, True), False), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
