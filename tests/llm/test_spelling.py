"""Operator 12 against edits generated and looked up in a plain set."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from srclens.llm import spelling
from tests.llm.edge import TEXTS, documents

SF = "/root/testdata/sf0.001"


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{w}".encode())
                if h % 97 == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute_variants(vocab):
    letters = sorted({c for w in vocab for c in w})
    near = {}
    for w in vocab:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = sorted(x for x in edits if x in vocab and x != w)
    form = {}
    for w, ns in near.items():
        top = min(ns, key=lambda x: (-vocab[x], x), default=None)
        form[w] = top if top is not None and vocab[top] >= 2 * vocab[w] else None
    out = {}
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, vocab[w], len(near[w]), vocab[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r["word"]: (r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_op12_against_generated_edits(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(docs))
    got = rows_of(spelling.op12_spelling_variants(spark, SF))
    assert got == want
    assert sum(1 for v in want.values() if v[1]) > 20


def test_forms_ties_chains_and_letters(spark):
    text = " ".join(["colour"] * 3 + ["color"] * 6 + ["colr"] * 12 + ["colors"] * 6 + ["Ärger"] * 3 + ["ärgerx"] * 7 + ["ABCDEFG"] * 3 + ["abcdefh"] * 3)
    rows = [(1, text), (2, None), (3, "")]
    want = brute_variants(brute_words(rows))
    assert want["colour"][1:3] == ("color", "color") and want["color"][1] is None and "colr" not in want
    assert want["abcdefg"][4] == 1 and want["Ärger"][4] == 0  # only A to Z are lowered
    vocab = spelling.vocabulary(spelling.words_of(documents(spark, rows)))
    assert rows_of(spelling.variants(vocab)) == want
    assert rows_of(spelling.variants(vocab, most=3)) == want  # many bands, edges joined by shuffle


def test_awkward_rows_and_clashing_columns(spark):
    rows = TEXTS + [(20, "Spelling spelling speling spellling " * 4), (None, "Spelling " * 9)]
    docs = documents(spark, rows).select("*", F.lit("x").alias("word"), F.lit(1).alias("near"))
    got = rows_of(spelling.variants(spelling.vocabulary(spelling.words_of(docs))))
    assert got == brute_variants(brute_words(rows))
    assert spelling.variants(spelling.vocabulary(spelling.words_of(docs.limit(0)))).count() == 0
