"""Operator 11 against a plain scan of every lag, without the splitting."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from srclens.llm import periodic
from tests.llm.edge import LONG, TEXTS, documents

SF = "/root/testdata/sf0.001"


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def brute_runs(words):
    ids = np.array([hash(w) for w in words], dtype=np.int64)
    n, runs = len(ids), []
    for q in range(1, n // 3 + 1):
        same = list(ids[:-q] == ids[q:])
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while j < len(same) and same[j]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q):
                smallest = next(p for p in range(1, q + 1) if all(ids[k] == ids[k + p] for k in range(s, e - p)))
                if smallest == q:
                    runs.append((s, e - s, q))
            i = j
    return sorted(runs)


def brute_row(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return {
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and best[1] * 1000 // best[2],
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest(),
    }


def test_op11_against_a_scan_of_every_lag(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r.asDict() for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        want = brute_row(doc_id, text)
        have = {k: v for k, v in got[doc_id].items() if k != "doc_id"}
        assert have == want, doc_id
        with_runs += want["n_runs"] > 0
    assert with_runs > 5


def test_smallest_period_ties_and_collapse(spark):
    ab = " ".join(["a", "b"] * 15)
    four = " ".join(["a", "b", "a", "c"] * 9)
    ones = " ".join(["x"] * 30)
    text = f"start {ab} mid {four} gap {ones} end"
    runs, kept = periodic.find_runs(periodic.split_words(text))
    assert runs == [(1, 30, 2), (32, 36, 4), (69, 30, 1)]
    assert kept == ["start", "a", "b", "mid", "a", "b", "a", "c", "gap", "x", "end"]
    assert brute_runs(periodic.split_words(text)) == runs
    # Two runs of equal exponent: the smaller start is the best one.
    row = brute_row(None, " ".join(["p", "q"] * 12) + " z " + " ".join(["r", "s"] * 12))
    assert (row["start"], row["length"], row["period"]) == (0, 24, 2)


def test_random_words_of_a_small_alphabet():
    rng = np.random.default_rng(3)
    for n in (0, 1, 23, 24, 80, 300):
        for letters in (1, 2, 3):
            words = [chr(97 + c) for c in rng.integers(0, letters, n)]
            runs, kept = periodic.find_runs(words)
            assert runs == brute_runs(words)


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, TEXTS + [(11, " ".join(["w"] * 40) + "\x0b\x1c")])
    out = periodic.periodic_runs(docs).collect()
    assert len(out) == len(TEXTS) + 1
    assert set(docs.columns) <= set(out[0].asDict()) and {"runs", "collapsed"} <= set(out[0].asDict())
    by_text = {(r["doc_id"], r["text"]): r for r in out}
    assert by_text[(4, None)]["runs"] == [] and by_text[(4, None)]["collapsed"] == ""
    assert by_text[(3, "")]["collapsed"] == "" and by_text[(5, "   \n\t ")]["collapsed"] == ""
    long_row = by_text[(6, LONG)]
    assert [tuple(r) for r in long_row["runs"]] == [(0, 30000, 6)] and long_row["collapsed"] == "lorem ipsum dolor sit amet consectetur"
    # \x1c is no separator: it is a word of its own.
    assert [tuple(r) for r in by_text[(11, " ".join(["w"] * 40) + "\x0b\x1c")]["runs"]] == [(0, 40, 1)]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    again = periodic.periodic_runs(docs.select(*docs.columns, F.lit(1).alias("runs"))).columns
    assert again.count("runs") == 1
