"""Checkpoints and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir; one is made only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def saved(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """id, component (smallest id reachable) of all ids in edges (a, b).

    Alternating stars: neighbours above a node are linked to the least neighbour,
    then those below; the edges end as stars around the least ids.  Minima are
    aggregated and joined back, so no node's neighbours are gathered.  The rounds
    grow with the logarithm of the longest path; beyond `most` an error is raised.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = large.where("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = saved(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    inner = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return inner.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
