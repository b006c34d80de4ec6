"""Helpers that several training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.session import written

BATCH_ROWS = 512
"""Rows of one Arrow batch: texts are long, so ten thousand of them are too many for a worker."""
HINT_ROWS = 500_000
"""Largest counted table of narrow rows that is shipped whole to every executor."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows for each Arrow batch, unless the session already asks for few."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def row_key(id_col: Column, text: Column) -> Column:
    """64 bits that tell rows apart also where ids are null or repeated.

    Rows that share it by chance only share candidates; every decision is taken on the
    row's own text, and joins compare the id beside it.
    """
    return F.xxhash64(id_col.cast("string"), text)


def counted_broadcast(df: DataFrame, rows: int, most: int = HINT_ROWS) -> DataFrame:
    """Ship ``df`` whole when its counted ``rows`` are few; beyond that Spark shuffles it."""
    return F.broadcast(df) if rows <= most else df


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``, longs), root the smallest node.

    Alternating star contraction: each round hangs larger neighbours, then smaller ones,
    below the least neighbour, until the edges form stars. Minima are combined before
    the shuffle and hot nodes are split by the skew join, so a node with most edges is
    no single task. Rounds grow with the logarithm of the longest path; each is written.
    An empty input gives an empty result.
    """
    kept = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                kept.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        seen = state
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = written(
            small.union(low).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name
        )


def blocks(rows: int, size: int) -> int:
    """Number of blocks of about ``size`` rows."""
    return max(1, math.ceil(rows / size))
