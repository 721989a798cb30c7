"""Connected components by alternating large-star and small-star rounds; no driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (u, v): every linked node but the smallest of its component, and that smallest.

    Each round reads the edges once per star: a minimum per node (combined before the shuffle) and
    an equi join, whose hot nodes Spark may split. The edges of a round are written to the shared
    folder. Links of a node with itself and repeated links are allowed; no links give no rows.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = _state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(old, large)
        now = _state(e)
        if now == before:
            return e
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
