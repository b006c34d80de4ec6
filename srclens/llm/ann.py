"""Operator 6, approximate nearest neighbours by cosine with an adaptive dimension scan.

Vectors are scaled to length one and turned by a random rotation, so that every block of
dimensions carries a like share of a distance. They are kept in lists around centres; a query
probes the lists nearest to it. Within a list the scan goes block of dimensions by block: after ``d``
of ``D`` dimensions the partial distance times ``D / d`` estimates the whole one, and a hypothesis test gives a
candidate up as soon as the estimate is beyond the reach of the query by more than a margin that shrinks with
``sqrt(d)``. The reach is the distance of the (k + 1)-th nearest of ``SEEDS`` vectors of the table, so nothing beyond it can be
among the k nearest. What survives all blocks is ranked by the exact cosine of the original vectors in double precision.

Equal vectors are searched once: of each different vector the ``k + 1`` smallest ids are kept (partial limits
before the shuffle keep a vector that a third of the rows share from one task), and queries with equal vectors share a search.
Lists are cut into blocks of ``VECTOR_BLOCK`` vectors and their queries into blocks of ``QUERY_BLOCK``, so a
group is bounded. Each group returns at most ``k + 1`` hits for a query.

The rotation depends on a seed, centres are fitted in the driver on a bounded sample (``SAMPLE``
vectors with the smallest hash of their id). There are about ``2 sqrt(n)`` lists, at most ``SAMPLE / 20``. A query probes
``PROBE`` of the lists, at least four, and further ones until they hold ``LEAST_SCANNED * k`` vectors, so few
vectors are all found. Measured recall is in the README.

Defined results: vectors that are null, zero or hold null or non-finite parts take no part, as
queries neither; likewise vectors whose length is not the most frequent one (the smaller at a tie); a query is no
candidate for itself, its copies are; equal scores are ranked by id; rows that repeat an id and its vector count once; null ids take no
part; an empty table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from srclens.llm.common import bounded_batches, table
from srclens.session import written

K, QUERY_STEP = 5, 50
SAMPLE, SEED = 20_000, 11
PROBE, LEAST_SCANNED = 0.6, 40
VECTOR_BLOCK, QUERY_BLOCK = 4096, 512
DIMENSIONS_AT_ONCE, PAIRS_AT_ONCE, MARGIN = 16, 1 << 17, 2.1
SEEDS = 4096
HITS = "query_key long, vec_key long, score double"


def usable(vec: Column) -> Column:
    """Not null, not zero, all parts finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), dim)


def centres(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    made = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ made.T, axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, nearest, sample)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        made = np.where(sizes > 1e-9, sums / np.maximum(sizes, 1e-9), made)
    return made


def column_blocks(points: np.ndarray, step: int = DIMENSIONS_AT_ONCE) -> list[np.ndarray]:
    """Blocks of ``step`` dimensions, each stored by itself."""
    return [np.ascontiguousarray(points[:, a : a + step]) for a in range(0, points.shape[1], step)]


def scan(vectors: list[np.ndarray], queries: list[np.ndarray], reach: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``query, vector`` that no test gives up, of column blocks of either side.

    ``reach`` holds for each query a squared distance beyond which nothing is wanted. The first block is
    compared as a whole, further ones only for the pairs that are left.
    """
    dim, done = sum(b.shape[1] for b in vectors), 0
    at_q = at_v = partial = None
    for v, q in zip(vectors, queries):
        done += v.shape[1]
        if partial is None:
            part = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (q @ v.T)
        else:
            part = partial + ((q[at_q] - v[at_v]) ** 2).sum(axis=1)
        slack = (1 + margin / np.sqrt(done)) ** 2 if done < dim else 1.0
        bound = reach * (slack * done / dim) + 1e-9
        if partial is None:
            at_q, at_v = np.nonzero(part <= bound[:, None])
            partial = part[at_q, at_v]
        else:
            stay = part <= bound[at_q]
            at_q, at_v, partial = at_q[stay], at_v[stay], part[stay]
    return at_q, at_v


def cosines(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows have equal scores."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    probe: float = PROBE,
    seed: int = SEED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows that ``is_query`` marks, a condition on the column ``vec_id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("vec"))
    )
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    rows = rows.filter(F.size("vec") == dim).withColumn("is_query", F.coalesce(is_query, F.lit(False)))

    # Equal vectors under one key, the smallest id that has it; 0.0 is added so that -0.0 equals 0.0.
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    keys = rows.groupBy("vec").agg(F.min("vec_id").alias("key"), F.max("is_query").alias("asked"))
    keys = written(keys, "vectors")
    owned = written(rows.join(keys.select("vec", "key"), "vec").select("vec_id", "key", "is_query").distinct(), "owned")
    by_id = Window.partitionBy("key").orderBy("vec_id")
    first = owned.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1).select("key", "vec_id")

    n = keys.count()
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toPandas()  # at most SAMPLE rows
    turn = rotation(dim, seed)
    points = unit(matrix(sample["vec"], dim)) @ turn
    lists = max(1, min(round(2 * n**0.5), len(points) // 20))
    middle = centres(points, lists, seed=seed)

    @pandas_udf("int")
    def list_of(vecs: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(unit(matrix(vecs, dim)) @ turn @ middle.T, axis=1).astype(np.int32))

    placed = written(keys.select("key", "vec", "asked", list_of("vec").alias("list")), "placed")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).orderBy("list").collect()  # at most SAMPLE / 20 rows
    count = np.zeros(lists, dtype=np.int64)
    for r in sizes:
        count[r["list"]] = r["n"]
    least_lists, least_rows = max(4, round(lists * probe)), LEAST_SCANNED * k

    seeds = points[:SEEDS]

    @pandas_udf("lists array<int>, reach double")
    def probes(vecs: pd.Series) -> pd.DataFrame:
        own = unit(matrix(vecs, dim)) @ turn
        order = np.argsort(-(own @ middle.T), axis=1, kind="stable")
        needed = (np.cumsum(count[order], axis=1) < least_rows).sum(axis=1) + 1
        lists = [o[: max(least_lists, m)].astype(np.int32) for o, m in zip(order, needed)]
        # k + 1 vectors of the table are this near, so nothing farther is wanted
        far = np.sort(2 - 2 * (own @ seeds.T), axis=1)[:, k] if len(seeds) > k else np.full(len(own), np.inf)
        return pd.DataFrame({"lists": lists, "reach": far + 1e-9})

    asked = placed.filter("asked").select(F.col("key").alias("query_key"), F.col("vec").alias("q"), probes("vec").alias("p"))
    asked = asked.select("query_key", "q", "p.reach", F.explode("p.lists").alias("list"))
    asked = written(asked, "probes")
    # blocks of bounded size: vectors of a list by hash, and the queries that probe it by hash
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("vs"))
    parts = parts.join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qs")), "list")
    parts = F.broadcast(parts)  # at most SAMPLE / 20 rows
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v_side = placed.join(parts, "list").select("list", part("key", "vs").alias("vb"), each("qs").alias("qb"), "key", "vec")
    q_side = asked.join(parts, "list").select("list", each("vs").alias("vb"), part("query_key", "qs").alias("qb"), "query_key", "q", "reach")

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_key": pd.Series(dtype="int64"), "vec_key": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(v) or not len(q):
            return empty
        ids, original = v["key"].to_numpy(), matrix(v["vec"], dim)
        stored = column_blocks(unit(original) @ turn)
        keys, queries, reach = q["query_key"].to_numpy(), matrix(q["q"], dim), q["reach"].to_numpy()
        turned, out, few = unit(queries) @ turn, [empty], max(1, PAIRS_AT_ONCE // len(v))
        for a in range(0, len(q), few):
            at_q, at_v = scan(stored, column_blocks(turned[a : a + few]), reach[a : a + few])
            scores = cosines(original[at_v], queries[a + at_q])
            best = np.lexsort((ids[at_v], -scores, at_q))
            found = pd.DataFrame({"query_key": keys[a + at_q[best]], "vec_key": ids[at_v[best]], "score": scores[best]})
            out.append(found.groupby("query_key", sort=False).head(k + 1))
        return pd.concat(out)

    hits = v_side.groupBy("list", "vb", "qb").cogroup(q_side.groupBy("list", "vb", "qb")).applyInPandas(search, HITS)
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_key")
    hits = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    # every different vector stands for its k + 1 smallest ids
    found = hits.join(first, hits["vec_key"] == first["key"]).select("query_key", "vec_id", "score")
    closest = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    found = written(found.withColumn("place", F.row_number().over(closest)).filter(F.col("place") <= k + 1).drop("place"), "found")
    queries = owned.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"))
    answers = queries.join(found, "query_key").filter("query_id <> vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
