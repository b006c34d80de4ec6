"""Operator 13 against its SQL and against a plain product of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from srclens.llm import topk
from tests.compare import difference, duck


def brute(rows, step=topk.QUERY_STEP, k=topk.K):
    """rows: (id, list or None); the contract read plainly."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    sizes = {}
    for _, v in good:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    pairs = sorted({(i, tuple(math.floor(topk.SCALE * float(x)) for x in v)) for i, v in good if len(v) == dim})
    out = []
    for qi, qv in pairs:
        if qi % step:
            continue
        hits = sorted(((-sum(a * b for a, b in zip(qv, cv)), ci) for ci, cv in pairs if ci != qi))[:k]
        out.extend((qi, r + 1, ci, -s) for r, (s, ci) in enumerate(hits))
    return sorted(out)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op13_against_sql(spark, sf):
    assert difference(spark, duck(sf), topk.op13_top_k, topk.OP13_SQL, sf) is None


@pytest.mark.parametrize("spread", [False, True])
def test_many_shards_and_query_blocks_against_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.05 * rng.normal(size=8)]) for i in range(1500)]
    rows += [(2000 + i, [float(x) for x in centres[0]]) for i in range(40)]  # one vector many ids share: ties
    rows += [(1500, [0.0] * 8), (1600, None), (1700, [1.0] * 7), (1800, [float("nan")] + [0.1] * 7), (1900, [None] + [0.1] * 7), (None, [0.5] * 8)]
    rows += rows[:30]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "SHARD_BYTES", 64 * 8 * 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    if spread:  # groups dealt over many partitions, as on a cluster: keys of both sides must meet
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        got = sorted(tuple(r) for r in topk.top_k(df, df.filter(F.col("vec_id") % 20 == 0)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(rows, step=20)


def test_tree_search_visits_few_leaves_on_clustered_vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(50, 16)) * 1000
    points = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(10000, 16)) * 20).astype(np.int64)
    ids = np.arange(len(points))
    tree = topk.BallTree(points, ids)
    query = points[123]
    got = tree.search(query, 123, 10, None)
    scores = points @ query
    order = sorted((int(-s), int(i)) for s, i in zip(scores, ids) if i != 123)[:10]
    assert got == [(-s, i) for s, i in order]


def test_awkward_inputs(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0
    one = spark.createDataFrame([(100, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, one).count() == 0
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("score"), F.lit(2).alias("query_id"))
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 100 = 0")).collect())
    assert got == brute(rows)
