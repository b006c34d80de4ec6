"""A vector store on Parquet that is built once and searched many times.

``build`` embeds the documents once, fits k-means centres on a sample, deals every document to
its nearest centre and writes three things under one folder:

* ``items``: ``list, doc_key, text, metadata, embedding``, partitioned by ``list``;
* ``lists``: ``list, centre, radius, n``, the radius being the largest distance of a member;
* ``model``: the fitted k-means model, so that later documents go to the same lists.

``search`` opens the folder, embeds the queries only and answers exactly, reading only the
partitions it needs. A query first reads the nearest lists until they hold ``k`` documents; the
k-th distance found there bounds the answer. By the triangle inequality no member of a list is
nearer than the distance to its centre less its radius, so only the lists within that bound are
read in the second step; the others are pruned without being opened. Both steps read the store
through a filter on the partition column, so the scan lists only probed partitions. Queries meet
the members of several lists at once in blocks of bounded size (``vectors.probed_pairs``): a query is
sent to groups of lists, not to each list it needs.

Distances are squared Euclidean, ties go to the smaller key, as in ``vectors``. The embedder
is the caller's: the same function must serve build and search (``TextEmbedder`` can be saved
beside the store and loaded again). Documents whose vector is null take no part; an empty
store (built from no documents) answers nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.operators import vectors
from srclens.session import written

SAMPLE_PER_LIST = 40
"""Rows of the k-means sample for each list; the sample grows with the root of the corpus."""
FIRST_READ = 2
"""Lists a query reads at first, more when they hold fewer than k documents."""


def build(docs: DataFrame, path: str, embed_texts: Callable[[DataFrame, str], DataFrame] | None, lists: int | None = None, seed: int = 7) -> None:
    """Write the store of ``docs`` (``doc_key, text, metadata``) to ``path``; without ``embed_texts`` they bring ``embedding``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if embed_texts is None:
        embedded = docs.select("doc_key", "text", "metadata", "embedding")
    else:
        embedded = embed_texts(docs.select("doc_key", "text", "metadata"), "text")
    embedded = written(embedded.filter(F.col("embedding").isNotNull()).withColumn("embedding", F.col("embedding").cast("array<float>")), "store-embedded")
    n = embedded.count()
    if n == 0:
        embedded.sparkSession.createDataFrame([], "list int, centre array<float>, radius double, n long").write.parquet(f"{path}/lists")
        return
    lists = max(1, min(n, lists or round(math.sqrt(n))))
    share = min(1.0, SAMPLE_PER_LIST * lists / max(n, 1))
    sample = embedded.sample(fraction=share, seed=seed) if share < 1.0 else embedded
    fitting = sample.select(array_to_vector("embedding").alias("f"))
    if fitting.limit(lists).count() < lists:  # a sample that is too small for the lists: fit on all rows
        fitting = embedded.select(array_to_vector("embedding").alias("f"))
    model = KMeans(k=lists, seed=seed, featuresCol="f", predictionCol="list").fit(fitting)
    model.write().overwrite().save(f"{path}/model")
    centres = embedded.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<float>"
    )
    placed = model.transform(embedded.withColumn("f", array_to_vector("embedding"))).drop("f")
    placed.write.partitionBy("list").parquet(f"{path}/items")
    items = embedded.sparkSession.read.parquet(f"{path}/items")
    far = F.sqrt(vectors.squared_distance(F.col("embedding"), F.col("centre")))
    sizes = items.join(F.broadcast(centres), "list").groupBy("list").agg(F.max(far).alias("radius"), F.count("*").alias("n"))
    centres.join(sizes, "list").write.parquet(f"{path}/lists")


def _lists_of(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, centres, radii and sizes of the lists: one row for each list, a number that grows with the root of the corpus."""
    frame = spark.read.parquet(f"{path}/lists").orderBy("list").toPandas()
    if not len(frame):
        return np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64)
    return frame["list"].to_numpy(np.int64), np.stack(frame["centre"].to_numpy()).astype(np.float64), frame["radius"].to_numpy(np.float64), frame["n"].to_numpy(np.int64)


def _distances(batch: pd.Series, centres: np.ndarray, rows: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Squared distances of a batch of query vectors to all centres, ``rows`` queries at a time, and their rounding slack."""
    q = np.stack(batch.to_numpy()).astype(np.float64)
    c_norm = (centres * centres).sum(axis=1)
    for start in range(0, len(q), rows):
        part = q[start : start + rows]
        q_norm = (part * part).sum(axis=1)
        d = np.maximum(0.0, q_norm[:, None] + c_norm[None, :] - 2.0 * (part @ centres.T))
        slack = 1e-6 * (1.0 + np.sqrt(q_norm)[:, None] + np.sqrt(c_norm)[None, :])
        yield slice(start, start + len(part)), d, slack


def _probed(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The items of ``lists``, through a filter on the partition column."""
    return spark.read.parquet(f"{path}/items").filter(F.col("list").isin(lists))


def _names(asked: DataFrame) -> list[int]:
    return sorted(r["list"] for r in asked.select(F.explode("lists").alias("list")).distinct().collect())  # at most the number of lists


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    embed_texts: Callable[[DataFrame, str], DataFrame] | None,
    k: int = 5,
    query_id_col: str = "query_id",
) -> DataFrame:
    """Exact ``<query_id_col>, rank, doc_key, distance, text, metadata`` of ``queries`` (id and ``text``) over the store.

    Without ``embed_texts`` the queries bring their ``embedding``.
    """
    ids, centres, radii, sizes = _lists_of(spark, path)
    shape = f"{query_id_col} {queries.schema[query_id_col].dataType.simpleString()}"
    empty = spark.createDataFrame([], f"{shape}, rank int, doc_key string, distance double, text string, metadata map<string,string>")
    if not len(ids):
        return empty
    given = queries.select(query_id_col, "embedding") if embed_texts is None else embed_texts(queries.select(query_id_col, "text"), "text")
    asked = given.select(F.col(query_id_col).alias("id"), F.col("embedding").cast("array<float>").alias("vec"))
    asked = written(asked.filter(F.col("vec").isNotNull()), "store-queries")
    shared = spark.sparkContext.broadcast((ids, centres, radii, sizes))
    id_type = asked.schema["id"].dataType.simpleString()

    def at_first(d: np.ndarray, l_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of each query from the nearest on, and how many of them it reads at first."""
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(l_sizes[order], axis=1)
        return order, np.maximum(FIRST_READ, 1 + (held < k).sum(axis=1))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        l_ids, l_centres, _, l_sizes = shared.value
        for batch in batches:
            for at, d, _ in _distances(batch["vec"], l_centres):
                order, reach = at_first(d, l_sizes)
                yield pd.DataFrame({"id": batch["id"][at], "vec": batch["vec"][at], "lists": [l_ids[o[:r]] for o, r in zip(order, reach)]})

    probing = f"id {id_type}, vec array<float>, lists array<long>"
    near = written(asked.select("id", "vec").mapInPandas(first, probing), "store-first")
    read = _names(near)
    members = lambda lists: _probed(spark, path, lists).select("list", F.col("doc_key").alias("id"), F.col("embedding").alias("vec"))
    hits = written(vectors.probed_pairs(members(read), near, k), "store-first-hits")
    bar = vectors.ranked(hits, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("bar"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        l_ids, l_centres, l_radii, l_sizes = shared.value
        for batch in batches:
            limits = batch["bar"].fillna(np.inf).to_numpy(np.float64)
            for at, d, slack in _distances(batch["vec"], l_centres):
                gap = np.maximum(0.0, np.sqrt(d) - l_radii[None, :] - slack)
                within = gap * gap <= limits[at][:, None]
                for w, o, r in zip(within, *at_first(d, l_sizes)):
                    w[o[:r]] = False
                yield pd.DataFrame({"id": batch["id"][at], "vec": batch["vec"][at], "lists": [l_ids[np.flatnonzero(w)] for w in within]})

    further = written(asked.join(bar, "id", "left").select("id", "vec", "bar").mapInPandas(rest, probing).filter(F.size("lists") > 0), "store-rest")
    more_lists = _names(further)
    found = vectors.ranked(hits.unionByName(vectors.probed_pairs(members(more_lists), further, k)), k)
    docs = _probed(spark, path, sorted(set(read) | set(more_lists))).select("doc_key", "text", "metadata")
    return found.select(F.col("query_id").alias(query_id_col), "rank", F.col("vec_id").alias("doc_key"), "distance").join(docs, "doc_key").select(
        query_id_col, "rank", "doc_key", "distance", "text", "metadata"
    )
