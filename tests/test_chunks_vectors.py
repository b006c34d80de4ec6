"""Chunks and vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from srclens.operators import chunks, vectors


def _texts(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


def test_fixed_chunks(spark):
    edge = [(-1, "é" * 3500), (-2, "ab" * 1750 + "c"), (-3, "x\n" * 3250), (-4, "\U0001F600y" * 4000), (-5, "")]
    df = _texts(spark).unionByName(spark.createDataFrame(edge, "doc_id long, text string"))
    got = {}
    for r in chunks.fixed_chunks(df, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], {})[r["chunk_idx"]] = r["chunk"]
    for r in df.collect():
        t, parts = r["text"], got.get(r["doc_id"], {})
        n = 0 if not t else 1 if len(t) <= 3500 else -(-(len(t) - 300) // 3200)
        assert parts == {i: t[i * 3200 : i * 3200 + 3500] for i in range(n)}


def test_fixed_chunks_with_any_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(57))
    rows = [(n, text[:n]) for n in range(58)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in ((10, 9), (10, 7), (7, 0), (6, 3)):
        stride, got = size - overlap, {}
        for r in chunks.fixed_chunks(df, "doc_id", "text", size, overlap).collect():
            got.setdefault(r["doc_id"], {})[r["chunk_idx"]] = r["chunk"]
        for n, t in rows:
            count = 0 if not t else 1 if n <= size else -(-(n - overlap) // stride)
            assert got.get(n, {}) == {i: t[i * stride : i * stride + size] for i in range(count)}


def test_separator_order_and_overlap():
    cut = lambda t, n, o: chunks.separated(t, n, o, chunks.SEPARATORS)
    assert cut("aaa\n\nclass B x\n\nclass C y", 13, 0) == ["aaa", "class B x", "class C y"]
    assert cut("aa bb cc dd", 5, 0) == ["aa bb", "cc", "dd"]
    assert cut("one two three four", 10, 5) == ["one two", "two three", "four"]
    assert cut("x" * 20, 5, 2) == ["x" * 20]
    assert cut("  ", 5, 2) == []


def test_separator_chunks_cover_the_text(spark):
    df = _texts(spark)
    got = {}
    for r in chunks.separator_chunks(df, "doc_id", "text").orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in df.collect():
        at = 0
        for i, part in enumerate(got.get(r["doc_id"], [])):
            assert len(part) <= chunks.CHUNK_SIZE or not any(s in part for s in chunks.SEPARATORS)
            start = r["text"].find(part, max(0, at - chunks.CHUNK_OVERLAP - 50))
            assert start >= 0 and not r["text"][at:start].strip()
            at = max(at, start + len(part))
        assert not r["text"][at:].strip()


@pytest.fixture(scope="module")
def cloud(spark):
    """300 vectors, a third of them copies of one."""
    rng = np.random.default_rng(3)
    mat = rng.normal(size=(300, 8)).astype("float32")
    mat[::3] = mat[0]
    return mat, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "vec_id long, embedding array<float>")


def _brute(mat, k):
    m = mat.astype("float64")
    out = set()
    for i in range(len(m)):
        d = ((m - m[i]) ** 2).sum(axis=1)
        for rank, j in enumerate(np.lexsort((np.arange(len(m)), d))[:k], 1):
            out.add((i, int(j), rank))
    return out


def _rows(df):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}


def test_batch_search_is_exact_with_ties(cloud):
    mat, df = cloud
    assert _rows(vectors.batch_nearest(df, df, 5)) == _brute(mat, 5)


def test_block_search_is_exact(cloud, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 64)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)
    mat, df = cloud
    assert _rows(vectors.batch_nearest(df, df, 5, broadcast_bytes=0)) == _brute(mat, 5)


def test_slices_of_a_block_give_the_same_hits(cloud, monkeypatch):
    """A block walked in slices, the nearest in the last one, copies in all of them."""
    mat, _ = cloud
    far_first = mat[np.argsort(-((mat - mat[1]) ** 2).sum(axis=1), kind="stable")].astype("float64")
    ids = np.arange(len(mat))
    whole = {(r.query_id, r.vec_id) for r in vectors._best(ids, far_first, ids, far_first, 5).itertuples()}
    monkeypatch.setattr(vectors, "SLICE", 7)
    sliced = vectors._best(ids, far_first, ids, far_first, 5)
    assert {(r.query_id, r.vec_id) for r in sliced.itertuples()} == whole == {(q, v) for q, v, _ in _brute(far_first, 5)}
    assert len(sliced) == 5 * len(ids)
    monkeypatch.setattr(vectors, "SLICE", 2)  # slices shorter than k
    assert {(r.query_id, r.vec_id) for r in vectors._best(ids, far_first, ids, far_first, 5).itertuples()} == whole


def test_block_search_sends_a_vector_a_few_times_only(spark, monkeypatch):
    """What is dealt to groups: each side once for each block of the other, and blocks are as large as a group may be."""
    sent = {}

    def counted(v_side, q_side, keys, k):
        sent.update(v=v_side.count(), q=q_side.count(), groups=v_side.select(*keys).distinct().count())
        return spark.createDataFrame([], vectors._hits(v_side, q_side))

    monkeypatch.setattr(vectors, "_pairwise", counted)
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    vectors.batch_nearest(df, df, 5, broadcast_bytes=0)
    assert sent["v"] + sent["q"] <= 20 * n  # 111 n with blocks of 1,024 queries and 8,192 vectors
    assert sent["groups"] >= 4 * spark.sparkContext.defaultParallelism


def test_list_search_is_exact_when_all_lists_are_probed(cloud, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 20)
    mat, df = cloud
    assert _rows(vectors.list_nearest(df, df, 5, lists=4, probe=4)) == _brute(mat, 5)


def test_single_search(cloud):
    mat, df = cloud
    got = [r["vec_id"] for r in vectors.nearest(df, mat[7].tolist()).collect()]
    assert [(7, v, i) for i, v in enumerate(got, 1)] == sorted((x for x in _brute(mat, 5) if x[0] == 7), key=lambda x: x[2])


def test_fewer_vectors_than_k_and_no_queries(cloud):
    _, df = cloud
    assert vectors.batch_nearest(df.filter("vec_id < 2"), df.filter("vec_id < 3"), 5).count() == 6
    assert vectors.batch_nearest(df, df.filter("vec_id < 0"), 5).count() == 0


def test_embedding(spark):
    df = _texts(spark)
    out = vectors.embed_tfidf(df, "text", dim=64).select(F.size("embedding").alias("n"), "embedding").collect()
    assert {r["n"] for r in out} == {64}
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-4 for r in out)


def test_ids_may_be_text(cloud):
    mat, df = cloud
    named = df.select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 4, "0")).alias("vec_id"), "embedding")
    want = {(f"v{q:04d}", f"v{v:04d}", r) for q, v, r in _brute(mat, 5)}
    assert _rows(vectors.batch_nearest(named, named, 5)) == want
    assert _rows(vectors.batch_nearest(named, named, 5, broadcast_bytes=0)) == want
    assert _rows(vectors.list_nearest(named, named, 5, lists=3, probe=3)) == want


def test_text_search_returns_documents(spark):
    texts = ["red fish in the sea", "blue bird in the sky", "green tree on the hill", "old red boat"]
    docs = spark.createDataFrame([(f"k{i}", t, {"type": "class"}) for i, t in enumerate(texts)], "doc_key string, text string, metadata map<string,string>")
    embedder = vectors.TextEmbedder(docs, "text")
    asked = spark.createDataFrame([("q1", "a bird, BLUE"), ("q2", "red boat"), ("q3", None)], "query_id string, text string")
    rows = vectors.search_documents(docs, asked, embedder, k=1).collect()
    found = {r["query_id"]: (r["doc_key"], r["text"], r["metadata"]["type"]) for r in rows}
    assert found["q1"] == ("k1", texts[1], "class") and found["q2"] == ("k3", texts[3], "class") and "q3" in found
