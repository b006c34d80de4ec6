"""The stored index: built once, searched exactly, only the lists that can hold an answer read."""

import re

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from srclens.operators import vectors
from srclens.session import new_path
from srclens.sources import vector_store


def _numbers(texts):
    return [[float(x) for x in (t or "0 0 0 0").split()] for t in texts]


CALLS = []


def by_numbers(df, text):
    CALLS.append(tuple(df.columns))
    return vectors.embed(df, text, _numbers)


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 4)) * 20
    points = np.repeat(centres, 80, axis=0) + rng.normal(size=(480, 4))
    points[::40] = points[0]  # copies: ties at every distance
    texts = [" ".join(f"{x:.3f}" for x in p) for p in points]
    docs = spark.createDataFrame([(f"d{i:04d}", t, {"type": "class" if i % 2 else "interface"}) for i, t in enumerate(texts)], "doc_key string, text string, metadata map<string,string>")
    path = new_path(spark, "store-test")
    vector_store.build(docs, path, by_numbers, lists=12)
    asked = [(i, " ".join(f"{x:.3f}" for x in centres[i % 6] + rng.normal(size=4) * 2)) for i in range(30)] + [(30, texts[0])]
    return path, texts, spark.createDataFrame(asked, "query_id long, text string"), asked


def brute(texts, asked, k):
    m = np.array(_numbers(texts))
    keys = np.array([f"d{i:04d}" for i in range(len(texts))])
    out = set()
    for qid, t in asked:
        q = np.array(_numbers([t])[0])
        d = ((m.astype(np.float32).astype(np.float64) - np.float32(q).astype(np.float64)) ** 2).sum(axis=1)
        for rank, j in enumerate(np.lexsort((keys, d))[:k], 1):
            out.add((qid, rank, keys[j]))
    return out


def test_search_is_exact_and_reads_few_lists(spark, store):
    path, texts, queries, asked = store
    CALLS.clear()
    found = vector_store.search(spark, path, queries, by_numbers, k=5)
    assert CALLS == [("query_id", "text")]  # the documents are not embedded again
    rows = found.collect()
    assert {(r["query_id"], r["rank"], r["doc_key"]) for r in rows} == brute(texts, asked, 5)
    assert all(r["text"] == texts[int(r["doc_key"][1:])] and r["metadata"]["type"] for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = [len(m.split(",")) for m in re.findall(r"list#\d+ IN \(([^)]*)\)", plan)]
    assert read and max(read) < 12


def test_a_new_session_answers_without_fitting(spark, store, monkeypatch):
    path, texts, queries, asked = store

    def no_fit(*args, **kwargs):
        raise AssertionError("the search fitted a model")

    monkeypatch.setattr(KMeans, "fit", no_fit)
    other = spark.newSession()
    got = vector_store.search(other, path, other.createDataFrame(queries.collect(), queries.schema), by_numbers, k=3).collect()
    assert {(r["query_id"], r["rank"], r["doc_key"]) for r in got} == brute(texts, asked, 3)


def test_more_than_the_store_holds_and_an_empty_store(spark):
    docs = spark.createDataFrame([("a", "1 0 0 0", {}), ("b", "0 1 0 0", {}), ("c", None, {})], "doc_key string, text string, metadata map<string,string>")
    path = new_path(spark, "store-small")
    vector_store.build(docs, path, by_numbers)
    asked = spark.createDataFrame([(1, "1 1 0 0")], "query_id long, text string")
    got = sorted((r["rank"], r["doc_key"]) for r in vector_store.search(spark, path, asked, by_numbers, k=5).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]
    empty = new_path(spark, "store-empty")
    vector_store.build(docs.limit(0), empty, by_numbers)
    assert vector_store.search(spark, empty, asked, by_numbers).count() == 0


@pytest.mark.parametrize("group_bytes", [vectors.GROUP_BYTES, 640])
def test_groups_dealt_to_many_tasks_lose_no_hit(spark, store, monkeypatch, group_bytes):
    """Both sides of a group meet in any number of tasks, and a list longer than a group (640 bytes: 40 vectors) is cut."""
    path, texts, queries, asked = store
    monkeypatch.setattr(vectors, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(vectors, "LEAST_QUERIES", 4)
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = vector_store.search(spark, path, queries, by_numbers, k=5).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {(r["query_id"], r["rank"], r["doc_key"]) for r in rows} == brute(texts, asked, 5)


def test_a_query_is_sent_to_groups_and_not_to_lists(spark):
    """A hundred lists that fit one group: each query and each vector goes there once."""
    placed = spark.range(1000).selectExpr("cast(id % 100 as int) as list", "id", "array(cast(id as float), 1f) as vec")
    asked = placed.selectExpr("id", "vec", "transform(sequence(0, 99), x -> cast(x as bigint)) as lists")
    sent = []
    grouped = type(asked).groupBy

    def counted(df, *keys):
        if "qb" in keys:
            sent.append(df.count())
        return grouped(df, *keys)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(asked), "groupBy", counted)
        patch.setattr(vectors, "LEAST_QUERIES", 1000)
        found = vectors.ranked(vectors.probed_pairs(placed, asked, 3), 3)
    assert sent == [1000, 1000]
    assert {(r["query_id"], r["vec_id"]) for r in found.filter("rank = 1").collect()} == {(i, i) for i in range(1000)}
