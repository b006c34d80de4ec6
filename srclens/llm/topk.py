"""Operator 13, exact top-k search by inner product with a ball-tree branch and bound per shard.

Vectors become whole numbers, ``floor(SCALE * x)``, so a score is an exact integer inner product.
Candidates are dealt to shards of at most ``SHARD_BYTES`` of vectors by a hash of id and vector;
every shard is one ball tree, built in the task that searches it. Queries are cut into blocks of
``QUERY_BLOCK``, or more and smaller ones when shards are fewer than the cores; a task takes one
block of queries and one shard, so no group grows with the table.

Branch and bound: a node holds a centre ``c``, a radius ``r`` and its least id; no vector in it
scores above ``q . c + |q| r``. A query walks its tree best bound first and scores whole leaves at
once; it stops when the best open bound cannot beat its current k-th score (a tie beats it only
with a smaller id, which the least id of a node rules out). The k-th score is shared: the queries
are first searched in shard 0, and the k-th score found there, a lower bound of the final one, is
the starting bar for every other shard. The hits of all shards meet in a ranking window whose
limit Spark applies in each task before the shuffle, so at most ``k`` rows of a query leave a task.

Defined results: rows whose id is null, whose vector is null, holds a null or a non-finite
component, or has a length other than the most frequent one among usable candidates (the smaller at a tie) take no part;
rows that repeat an id and its vector count once; an id with several vectors is searched with
each and its hits are ranked together; a query is never its own candidate; equal scores go to
the smaller id; fewer than ``k`` candidates give all of them; an empty table gives an empty result.
Only the id and vector columns are read, so clashing other columns do not matter.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.llm.common import table
from srclens.session import written

# Fixed values of the operator's contract.
K, QUERY_STEP, SCALE = 10, 100, 1024

SHARD_BYTES = 64 << 20
"""Bytes of whole-number vectors in one shard, and so in one ball tree."""
QUERY_BLOCK = 4096
LEAF = 48
HITS = "query_id long, vec_id long, score long"


def whole_numbers(vec: Column, scale: int = SCALE) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vec: Column) -> Column:
    """Not null, every component present and finite (zero vectors take part)."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False))


class BallTree:
    """A ball tree as flat arrays: children, centres, radii, row ranges and least ids."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        starts, ends, lefts, rights = [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            node = len(starts)
            starts.append(start)
            ends.append(end)
            lefts.append(-1)
            rights.append(-1)
            if parent >= 0:
                (lefts if side == 0 else rights)[parent] = node
            if end - start > leaf:
                block = points[order[start:end]]
                axis = int(np.argmax(block.max(axis=0) - block.min(axis=0)))
                half = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(block[:, axis], half)]
                stack.append((start + half, end, node, 1))
                stack.append((start, start + half, node, 0))
        self.points = points[order].astype(np.int64)
        self.ids = ids[order]
        self.left, self.right = np.array(lefts), np.array(rights)
        self.start, self.end = np.array(starts), np.array(ends)
        as_float = self.points.astype(np.float64)
        self.centre = np.stack([as_float[s:e].mean(axis=0) for s, e in zip(starts, ends)]) if starts else np.zeros((0, points.shape[1]))
        self.radius = np.array([np.sqrt(((as_float[s:e] - c) ** 2).sum(axis=1).max()) for s, e, c in zip(starts, ends, self.centre)])
        self.least = np.array([self.ids[s:e].min() for s, e in zip(starts, ends)], dtype=np.int64)
        self.reach = np.linalg.norm(self.centre, axis=1) + self.radius

    def search(self, query: np.ndarray, own: int, k: int, bar: tuple[int, int] | None) -> list[tuple[int, int]]:
        """``(score, id)`` of the ``k`` best candidates that beat ``bar`` (a score and id to beat), best first."""
        if len(self.start) == 0:
            return []
        qf = query.astype(np.float64)
        norm = float(np.linalg.norm(qf))
        best: list[tuple[int, int]] = []  # heap of (score, -id): its top is the k-th best

        def bound(node: int) -> int:
            ub = float(self.centre[node] @ qf) + norm * self.radius[node]
            return math.floor(ub + 1e-9 * norm * self.reach[node] + 1e-6)

        def beaten(score: int, least: int) -> bool:
            floor_ = (best[0][0], -best[0][1]) if len(best) == k else None
            for limit in (floor_, bar):
                if limit is not None and (score < limit[0] or (score == limit[0] and least > limit[1])):
                    return True
            return False

        todo = [(-bound(0), 0)]
        while todo:
            negative, node = heapq.heappop(todo)
            if beaten(-negative, int(self.least[node])):
                continue
            if self.left[node] < 0:
                s, e = self.start[node], self.end[node]
                scores = self.points[s:e] @ query
                for score, vid in zip(scores.tolist(), self.ids[s:e].tolist()):
                    if vid == own or beaten(score, vid):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -vid))
                    else:
                        heapq.heapreplace(best, (score, -vid))
                continue
            for child in (self.left[node], self.right[node]):
                heapq.heappush(todo, (-bound(child), child))
        return sorted(((s, -v) for s, v in best), key=lambda h: (-h[0], h[1]))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _searcher(k: int, leaf: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.drop_duplicates(subset=["vec_id", "digest"])
        queries = queries.drop_duplicates(subset=["query_id", "digest"])
        out = []
        if len(vectors) and len(queries):
            tree = BallTree(_matrix(vectors["ivec"]), vectors["vec_id"].to_numpy(np.int64), leaf)
            for qid, qvec, score, vid in zip(queries["query_id"], queries["ivec"], queries["bar_score"], queries["bar_id"]):
                bar = None if pd.isna(score) else (int(score), int(vid))
                out.extend((int(qid), v, s) for s, v in tree.search(np.asarray(qvec, dtype=np.int64), int(qid), k, bar))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` best rows of ``vectors``."""
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vec_col}`")
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))

    cands, asked = prepared(vectors), prepared(queries)
    lengths = cands.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = lengths["d"]
    n = cands.filter(F.size("v") == dim).count()
    shards = max(1, math.ceil(n * dim * 8 / SHARD_BYTES))
    digest = F.xxhash64(F.col("v"))
    cands = written(
        cands.filter(F.size("v") == dim).select(
            F.col("id").alias("vec_id"), whole_numbers(F.col("v"), scale).alias("ivec"), digest.alias("digest"), F.pmod(F.xxhash64("id", digest), F.lit(shards)).cast("int").alias("shard")
        ),
        "topk-vectors",
    )
    asked = written(asked.filter(F.size("v") == dim).select(F.col("id").alias("query_id"), whole_numbers(F.col("v"), scale).alias("ivec"), digest.alias("digest")), "topk-queries")
    n_asked = asked.count()
    # Enough blocks for every core even when there are few shards; at scale the block size decides.
    blocks = max(1, min(n_asked, max(math.ceil(n_asked / QUERY_BLOCK), math.ceil(spark.sparkContext.defaultParallelism / shards))))
    # Group keys of both sides of the cogroup are ints alike: keys of other types would be dealt apart.
    asked = asked.withColumn("qblock", F.pmod(F.xxhash64("query_id", "digest"), F.lit(blocks)).cast("int"))
    search = _searcher(k, leaf)

    def run(shard_filter: Column, with_bars: DataFrame) -> DataFrame:
        vs = cands.filter(shard_filter).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return vs.groupBy("shard", "qblock").cogroup(with_bars.groupBy("shard", "qblock")).applyInPandas(search, HITS)

    no_bar = asked.select("*", F.lit(0).alias("shard"), F.lit(None).cast("long").alias("bar_score"), F.lit(None).cast("long").alias("bar_id"))
    first = written(run(F.col("shard") == 0, no_bar), "topk-first")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bars = (
        first.withColumn("r", F.row_number().over(ranked))
        .filter(F.col("r") == k)
        .select("query_id", F.col("score").alias("bar_score"), F.col("vec_id").alias("bar_id"))
    )
    rest = asked.join(bars, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(max(1, shards - 1)))))
    hits = first.unionByName(run(F.col("shard") > 0, rest)) if shards > 1 else first
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


OP13_SQL = f"""
WITH common AS (
    SELECT len(embedding) AS d FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS iv
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(embedding) = (SELECT d FROM common)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.iv) + 1), lambda i: q.iv[i] * c.iv[i])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
