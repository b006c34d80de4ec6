"""Operator 11, periodic run detection by recursive frequency splitting, then a lag scan.

Words are the stretches of ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of
consecutive words with smallest period ``q`` (words ``q`` apart are equal) and length at least
``max(MIN_LENGTH, MIN_REPEATS * q)`` that no neighbouring word extends with period ``q``. A word
is dropped from the collapsed text when a run holds it after that run's first ``q`` words.

Method. Every word of a stretch with period ``q`` and length ``L >= 3q`` occurs at least
``floor(L / q) >= 3`` times inside the stretch. So a word that occurs fewer than three times in a
segment lies in no such stretch within the segment, and it splits the segment. The pieces are
counted again, each on its own, and split again until no piece changes; pieces shorter than
``MIN_LENGTH`` are dropped. By the argument every maximal stretch of period ``q`` and length
``>= 3q`` lies whole in one surviving piece, so the lag scan of the pieces finds all runs and
nothing at a piece border is cut. The scan compares each piece with itself shifted by ``q`` for
``q`` up to a third of the piece; a maximal stretch of ``L - q`` equal pairs is a stretch of period
``q`` and length ``L``. Its smallest period divides ``q`` (Fine and Wilf, as ``L >= 3q``), so it is a
run of period ``q`` unless a proper divisor of ``q`` is a period of it too.

A document is one task's work: the scan costs the square of a surviving piece over three in
comparisons of whole numpy rows. Spark spreads documents over tasks; nothing is shuffled.

Defined results: a null or empty text has no words, no runs and the empty collapsed text;
rows are independent, so repeated rows give repeated results and an empty table an empty result;
other columns of the input are kept as they are (clashing names included), the new columns replace
any of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from srclens.llm.common import bounded_batches, table

# Fixed values of the operator's contract.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
MIN_LENGTH, MIN_REPEATS = 24, 3

RUN = "struct<start: long, length: long, period: long>"
FOUND = f"struct<runs: array<{RUN}>, collapsed: string>"


def split_words(text: str | None) -> list[str]:
    """The words of a text, as Spark's split on the separators gives them."""
    if not text:
        return []
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _pieces(ids: np.ndarray, min_length: int, repeats: int) -> list[tuple[int, int]]:
    """Segments that keep no word rarer than ``repeats`` within themselves, longest-first splitting."""
    todo, done = [(0, len(ids))], []
    while todo:
        start, end = todo.pop()
        if end - start < min_length:
            continue
        _, inverse, counts = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[inverse] < repeats)
        if len(rare) == 0:
            done.append((start, end))
            continue
        cuts = np.concatenate(([-1], rare, [end - start]))
        for a, b in zip(cuts[:-1] + 1, cuts[1:]):
            if b - a >= min_length:
                todo.append((start + int(a), start + int(b)))
    return sorted(done)


def _has_period(ids: np.ndarray, start: int, end: int, d: int) -> bool:
    return bool(np.array_equal(ids[start : end - d], ids[start + d : end]))


def _scan(ids: np.ndarray, start: int, end: int, min_length: int, repeats: int) -> list[tuple[int, int, int]]:
    piece = ids[start:end]
    found = []
    for q in range(1, (end - start) // repeats + 1):
        need = max(min_length, repeats * q) - q
        same = piece[:-q] == piece[q:]
        if int(same.sum()) < need:
            continue
        edges = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            if b - a < need:
                continue
            s, e = start + int(a), start + int(b) + q
            if not any(q % d == 0 and _has_period(ids, s, e, d) for d in range(1, q // 2 + 1)):
                found.append((s, e - s, q))
    return found


def find_runs(words: list[str], min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> tuple[list[tuple[int, int, int]], list[str]]:
    """``(start, length, period)`` of every run, by start then period, and the kept words."""
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    runs = sorted(r for s, e in _pieces(ids, min_length, repeats) for r in _scan(ids, s, e, min_length, repeats))
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    keep = np.cumsum(dropped[:-1]) == 0
    return runs, [w for w, k in zip(words, keep) if k]


def runs_column(text: Column, min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> Column:
    """``struct<runs, collapsed>`` of a text column, by the method above."""

    @pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        runs, collapsed = [], []
        for t in texts:
            r, kept = find_runs(split_words(t), min_length, repeats)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in r])
            collapsed.append(" ".join(kept))
        return pd.DataFrame({"runs": runs, "collapsed": collapsed})

    return found(text)


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period) and ``collapsed`` (the kept words joined by a space)."""
    bounded_batches(docs.sparkSession)
    found = runs_column(F.col(text_col), min_length, repeats)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed", "_found")]
    return docs.select(*kept, found.alias("_found")).select(*kept, "_found.runs", "_found.collapsed")


def planted_text(id_col: Column, text: Column) -> Column:
    """Text of the op11 contract: in one document of ten (by crc32 of the decimal id) a tail turns periodic.

    With ``h`` that crc32 and ``g = h div 10``: if ``h % 10 = 0`` and there are ``n > 0`` words, word
    ``i >= a`` becomes word ``a + (i - a) % p`` with ``a = g % n``, ``p = 1 + (n - a) div (3 + g % 8)``.
    A null id plants nothing. Words are joined by one space, which splits back into the same words.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    h = F.crc32(id_col.cast("string"))
    g = ((h - F.pmod(h, F.lit(10))) / 10).cast("long")
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    # Linear in the words: the head, then the period repeated and cut to length (no lookup per word).
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    moved = F.concat(F.slice(words, 1, a), tail)
    return F.array_join(F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), moved).otherwise(words), " ")


def _better(x: Column, y: Column) -> Column:
    """Comparator: greater length / period first (exact, by cross products), then smaller start, then period."""
    left, right = x["length"] * y["period"], y["length"] * x["period"]
    return (
        F.when(left > right, -1)
        .when(left < right, 1)
        .when(x["start"] < y["start"], -1)
        .when(x["start"] > y["start"], 1)
        .when(x["period"] < y["period"], -1)
        .when(x["period"] > y["period"], 1)
        .otherwise(0)
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    best = F.try_element_at(F.array_sort("runs", _better), F.lit(1))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).selectExpr("doc_id", "n_runs", "start", "length", "period", "length * 1000 div period AS exponent_milli", "runs_sha256", "collapsed_sha256")
