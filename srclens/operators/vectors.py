"""Text embedding and nearest-vector search, exact and by k-means lists.

Distances are squared Euclidean, ascending, ties by id. No pair table is ever built:
a task compares a block of queries with a block of vectors and hands on only the k
best per query, and those are ranked once more across blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srclens.session import written

# Queries up to this many bytes are shipped to every task; more are joined in blocks.
BROADCAST_BYTES = 32 * 1024 * 1024
# Most queries and vectors of one group of a batch search, however short they are.
QUERY_BLOCK = VECTOR_BLOCK = 65_536
# Queries and vectors whose products are held at a time.
QUERIES_AT_ONCE = 256
SLICE = 2048
MOST_LISTS = 1024
# Bytes of vectors on either side of one group of a search; queries are cut further while tasks are few.
GROUP_BYTES = 16 * 1024 * 1024
LEAST_QUERIES = 256
LEAST_VECTORS = 8192


def embed(docs: DataFrame, text: str, call: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """Add ``out``: the caller's batch function applied to the text column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch[out] = [np.asarray(v, dtype="float32") for v in call(batch[text].tolist())]
                yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{fields}, `{out}` array<float>")


class TextEmbedder:
    """Hashed term frequencies, inverse document frequency, unit length; fitted once, applied to any texts."""

    def __init__(self, docs: DataFrame, text: str, dim: int = 256):
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

        stages = [
            RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim),
            IDF(inputCol="__tf", outputCol="__idf"),
            Normalizer(inputCol="__idf", outputCol="__unit"),
        ]
        self.model = Pipeline(stages=stages).fit(docs.select(self._text(text)))

    @staticmethod
    def _text(text: str) -> Column:
        return F.coalesce(F.col(text), F.lit("")).alias("__text")

    def __call__(self, docs: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """Add ``out`` to ``docs``: documents and queries get comparable vectors."""
        from pyspark.ml.functions import vector_to_array

        given = self.model.transform(docs.select("*", self._text(text)))
        return given.withColumn(out, vector_to_array("__unit", "float32")).drop("__text", "__tok", "__tf", "__idf", "__unit")


def embed_tfidf(docs: DataFrame, text: str, dim: int = 256, out: str = "embedding") -> DataFrame:
    """Built-in embedding of one table by itself."""
    return TextEmbedder(docs, text, dim)(docs, text, out)


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest to one query; each task keeps k rows (no full sort, no Python)."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col).alias("vec_id"), squared_distance(F.col(vec_col), target).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(k)


def _best(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors per query of one block pair.

    A matrix product finds the candidates, everything within rounding of the k-th best so far;
    their distances are then computed by difference, so equal vectors tie exactly. The vectors are
    walked in slices, so no more than ``QUERIES_AT_ONCE`` by ``SLICE`` products are held.
    """
    found = []
    v_norm = (v * v).sum(axis=1)
    # product with a query, less half the square of the vector: the nearer, the greater
    sides = np.concatenate([v, -0.5 * v_norm[:, None]], axis=1)
    for start in range(0, len(q), QUERIES_AT_ONCE):
        part = q[start : start + QUERIES_AT_ONCE]
        norm = (part * part).sum(axis=1)
        slack = 1e-9 * (1.0 + np.abs(v_norm).max() + norm)
        asked = np.concatenate([part, np.ones((len(part), 1))], axis=1)
        bound = np.full(len(part), np.inf)  # distance of the k-th best so far
        rows, at, exact = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for first in range(0, len(v), SLICE):
            near_to = asked @ sides[first : first + SLICE].T
            width = near_to.shape[1]
            least = 0.5 * (norm - bound - slack)
            open_end = ~np.isfinite(bound)
            if open_end.any() and width >= k:
                least[open_end] = np.partition(near_to[open_end], width - k, axis=1)[:, width - k] - slack[open_end]
            row, column = np.divmod(np.flatnonzero(near_to >= least[:, None]), width)
            if not len(row):
                continue
            apart = [((v[first + column[i : i + 65_536]] - part[row[i : i + 65_536]]) ** 2).sum(axis=1) for i in range(0, len(row), 65_536)]
            rows, at, exact = np.concatenate([rows, row]), np.concatenate([at, first + column]), np.concatenate([exact, *apart])
            order = np.lexsort((v_ids[at], exact, rows))
            begins = np.searchsorted(rows[order], np.arange(len(part)))
            order = order[np.arange(len(order)) - begins[rows[order]] < k]
            rows, at, exact = rows[order], at[order], exact[order]
            last = np.full(len(part), -np.inf)
            np.maximum.at(last, rows, exact)
            bound = np.where(np.bincount(rows, minlength=len(part)) >= k, last, np.inf)
        found.append((q_ids[start + rows], v_ids[at], exact))
    ids, hits, distances = zip(*found)
    return pd.DataFrame({"query_id": np.concatenate(ids), "vec_id": np.concatenate(hits), "distance": np.concatenate(distances)})


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype("float64")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``rank`` of each hit within its query, by distance and id; the best ``k`` stay."""
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_ranked = ranked


def _ids(col: pd.Series) -> np.ndarray:
    """Ids as an array that sorts: text as text, numbers as numbers."""
    return col.to_numpy().astype(str) if col.dtype == object else col.to_numpy()


def _hits(vectors: DataFrame, queries: DataFrame) -> str:
    kind = lambda df: df.schema["id"].dataType.simpleString()
    return f"query_id {kind(queries)}, vec_id {kind(vectors)}, distance double"


def _pairwise(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best k per query within each key; both sides carry ``keys``, ``id``, ``vec``."""

    def run(_key: tuple, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": q["id"][:0], "vec_id": v["id"][:0], "distance": pd.Series(dtype="float64")})
        return _best(_ids(q["id"]), _matrix(q["vec"]), _ids(v["id"]), _matrix(v["vec"]), k)

    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, _hits(vectors, queries))


def _standard(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))


def _blocks(n_queries: int, n_vectors: int, dim: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: as few as groups of bounded size allow, but some four groups for each core.

    Vectors are sent to each block of queries and queries to each block of vectors, so what is shuffled
    follows ``n_vectors * q_blocks + n_queries * v_blocks``.
    """
    fit = max(1, GROUP_BYTES // (4 * max(dim, 1)))
    v_blocks = max(1, math.ceil(n_vectors / min(fit, VECTOR_BLOCK)), min(math.ceil(n_vectors / LEAST_VECTORS), round(cores**0.5)))
    q_blocks = max(1, math.ceil(n_queries / min(fit, QUERY_BLOCK)), min(math.ceil(n_queries / LEAST_QUERIES), math.ceil(4 * cores / v_blocks)))
    return q_blocks, v_blocks


def batch_nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    query_id_col: str | None = None,
) -> DataFrame:
    """Exact top k of every query: ``query_id, vec_id, distance, rank``; ids of either side may be numbers or text.

    The size of the query side is measured first. A small one goes to every task and
    the vectors are streamed past it without a shuffle. A larger one is split, like the
    vectors, into blocks by id hash; each pair of blocks is one group of bounded size. The blocks
    are as large as a group may be, since a vector is sent once to each block of the other side.
    """
    v, q = _standard(vectors, id_col, vec_col), _standard(queries, query_id_col or id_col, vec_col)
    size = q.agg(F.count("*").alias("n"), F.sum(8 * F.size("vec") + 8).alias("bytes"), F.max(F.size("vec")).alias("dim")).first()
    if not size["n"]:
        return _ranked(v.sparkSession.createDataFrame([], _hits(v, q)), k)
    if size["bytes"] <= broadcast_bytes:
        local = q.toPandas()  # at most broadcast_bytes
        shared = v.sparkSession.sparkContext.broadcast((_ids(local["id"]), _matrix(local["vec"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q_mat = shared.value
            kept = None
            for batch in batches:
                if not len(batch):
                    continue
                found = _best(q_ids, q_mat, _ids(batch["id"]), _matrix(batch["vec"]), k)
                if kept is not None:
                    found = pd.concat([kept, found]).sort_values(["query_id", "distance", "vec_id"])
                    found = found.groupby("query_id", sort=False).head(k)
                kept = found
            if kept is not None:
                yield kept

        return _ranked(v.mapInPandas(run, _hits(v, q)), k)
    q_blocks, v_blocks = _blocks(size["n"], v.count(), size["dim"], v.sparkSession.sparkContext.defaultParallelism)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    v_side = v.withColumn("vb", block(v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q_side = q.withColumn("qb", block(q_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    # Few heavy groups: dealt to more tasks than there are groups, which are not put together by their size.
    cores, keys = v.sparkSession.sparkContext.defaultParallelism, ["qb", "vb"]
    tasks = min(2 * q_blocks * v_blocks, max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * cores))
    return _ranked(_pairwise(v_side.repartition(tasks, *keys), q_side.repartition(tasks, *keys), keys, k), k)


def search_documents(
    docs: DataFrame, queries: DataFrame, embed_texts: Callable[[DataFrame, str], DataFrame], k: int = 5, query_id_col: str = "query_id"
) -> DataFrame:
    """Text in, stored documents out: ``<query_id_col>, rank, doc_key, distance, text, metadata``.

    ``docs`` holds ``doc_key, text, metadata``; ``queries`` the id and ``text``. The same function embeds both.
    The hits, k rows for each query, are joined back to the documents.
    """
    found = batch_nearest(embed_texts(docs, "text"), embed_texts(queries, "text"), k, "doc_key", query_id_col=query_id_col)
    hits = found.select(F.col("query_id").alias(query_id_col), "rank", F.col("vec_id").alias("doc_key"), "distance")
    return hits.join(docs.select("doc_key", "text", "metadata"), "doc_key").select(query_id_col, "rank", "doc_key", "distance", "text", "metadata")


def list_nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    lists: int | None = None,
    probe: int | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 7,
) -> DataFrame:
    """Approximate top k: vectors in k-means lists, each query looks into ``probe`` lists.

    By default there are as many lists as the square root of the number of vectors, at most ``MOST_LISTS``, and half of
    them are probed; with ``probe == lists`` the result is exact. Queries meet the lists in groups of
    bounded size (``probed_pairs``); a list that holds most vectors is still many groups.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v, q = written(_standard(vectors, id_col, vec_col), "vectors"), written(_standard(queries, id_col, vec_col), "queries")
    spark = v.sparkSession
    lists = lists or max(1, min(MOST_LISTS, round(v.count() ** 0.5)))
    probe = min(lists, probe or math.ceil(lists / 2))
    model = KMeans(k=lists, seed=seed, featuresCol="f", predictionCol="list").fit(v.select(array_to_vector("vec").alias("f")))
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "id int, vec array<float>"
    )
    placed = written(model.transform(v.withColumn("f", array_to_vector("vec"))).drop("f"), "placed")
    probes = batch_nearest(centers, q, probe, "id", "vec").select(F.col("query_id").alias("id"), F.col("vec_id").alias("list"))
    asked = written(q.join(probes.groupBy("id").agg(F.collect_list("list").alias("lists")), "id"), "asked")
    return _ranked(probed_pairs(placed, asked, k), k)


def _grouped(sizes: dict[int, int], rows: int) -> list[list[int]]:
    """Lists put together to groups of up to ``rows`` vectors; a longer list is a group of its own."""
    groups, held = [], rows + 1
    for name, n in sorted(sizes.items()):
        if held + n > rows:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += n
    return groups


def _best_in_lists(q_ids: np.ndarray, q: np.ndarray, wanted: list[np.ndarray], v_ids: np.ndarray, v: np.ndarray, lists: np.ndarray, k: int) -> pd.DataFrame:
    """The k best per query among the vectors of the lists it wants; ``lists`` holds the list of each vector, ascending."""
    names, sizes = np.unique(lists, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    asks = np.zeros((len(q), len(names)), dtype=bool)
    for i, own in enumerate(wanted):
        at = np.searchsorted(names, own)
        at[at == len(names)] = 0
        asks[i, at[names[at] == own]] = True
    v_norm = (v * v).sum(axis=1)
    out_q, out_v, out_d = [q_ids[:0]], [v_ids[:0]], [np.zeros(0)]
    order = np.lexsort(asks.T[::-1])  # queries of like lists share a step
    for start in range(0, len(q), 256):
        chunk = order[start : start + 256]
        read = np.flatnonzero(asks[chunk].any(axis=0))
        if not len(read):
            continue
        columns = np.concatenate([np.arange(starts[j], starts[j] + sizes[j]) for j in read])
        part, block = q[chunk], v[columns]
        d = v_norm[columns][None, :] + (part * part).sum(axis=1)[:, None] - 2.0 * (part @ block.T)
        d[~np.repeat(asks[np.ix_(chunk, read)], sizes[read], axis=1)] = np.inf
        top = min(k, d.shape[1]) - 1
        bound = np.partition(d, top, axis=1)[:, top] + 1e-9 * (1.0 + np.abs(v_norm[columns]).max() + (part * part).sum(axis=1))
        for i, target in enumerate(part):
            near = np.flatnonzero((d[i] <= bound[i]) & (d[i] < np.inf))
            exact = ((block[near] - target) ** 2).sum(axis=1)
            best = np.lexsort((v_ids[columns[near]], exact))[:k]
            out_q.append(np.full(len(best), q_ids[chunk[i]]))
            out_v.append(v_ids[columns[near][best]])
            out_d.append(exact[best])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "distance": np.concatenate(out_d)})


def probed_pairs(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best k of each query within the lists it probes: ``placed`` holds ``list, id, vec``, ``asked`` ``id, vec, lists``.

    Lists are put together to groups of bounded size and the queries of a group are cut into blocks of
    bounded size. A query is sent once to a group that holds lists it probes, a vector once to each block of
    its group's queries, and a block hands on k rows per query for all its lists: what is shuffled
    follows the number of groups, not the number of lists probed. A list longer than a group is cut
    by id. Hits are not ranked across groups yet.
    """
    shape = placed.agg(F.max(F.size("vec")).alias("dim")).first()["dim"]
    rows = max(1, GROUP_BYTES // (4 * (shape or 1)))
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row per list
    groups = _grouped(sizes, rows)
    if not groups:
        return placed.sparkSession.createDataFrame([], _hits(placed, asked))
    group_of = [-1] * (max(sizes) + 1)
    for g, names in enumerate(groups):
        for name in names:
            group_of[name] = g
    known = F.lit(group_of)
    group = lambda name: F.coalesce(F.get(known, name.cast("int")), F.lit(-1))
    dealt = (
        asked.withColumn("g", F.explode(F.array_distinct(F.transform("lists", group))))
        .filter(F.col("g") >= 0)
        .select("g", "id", "vec", F.filter("lists", lambda name: group(name) == F.col("g")).alias("lists"))
    )
    n_asked = {r["g"]: r["n"] for r in dealt.groupBy("g").agg(F.count("*").alias("n")).collect()}  # one row per group
    wide = max(1, min(rows, sum(n_asked.values()) // (4 * placed.sparkSession.sparkContext.defaultParallelism)))
    blocks = [math.ceil(n_asked.get(g, 0) / max(wide, min(rows, LEAST_QUERIES))) for g in range(len(groups))]
    parts = [math.ceil(sum(sizes[name] for name in names) / rows) for names in groups]
    n_blocks, n_parts = F.get(F.lit(blocks), F.col("g")), F.get(F.lit(parts), F.col("g"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    v_side = placed.withColumn("g", group(F.col("list"))).filter((F.col("g") >= 0) & (n_blocks > 0))
    v_side = v_side.select("g", part(n_parts).alias("vb"), each(n_blocks).alias("qb"), "list", "id", "vec")
    q_side = dealt.select("g", each(n_parts).alias("vb"), part(n_blocks).alias("qb"), "id", "vec", "lists")

    def run(_key: tuple, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": q["id"][:0], "vec_id": v["id"][:0], "distance": pd.Series(dtype="float64")})
        v = v.sort_values("list", kind="stable")
        wanted = [np.asarray(names, dtype=np.int64) for names in q["lists"]]
        return _best_in_lists(_ids(q["id"]), _matrix(q["vec"]), wanted, _ids(v["id"]), _matrix(v["vec"]), v["list"].to_numpy(np.int64), k)

    keys = ["g", "vb", "qb"]
    return v_side.groupBy(*keys).cogroup(q_side.groupBy(*keys)).applyInPandas(run, _hits(placed, asked))
