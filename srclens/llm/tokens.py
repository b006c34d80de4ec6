"""Operator 4, token counts with a digest cache.

The cache is a Parquet table of ``content, tokenizer, n_tokens``: SHA-256 of the content and of
the tokenizer (library, version and file). Documents are joined to the stored counts by
these digests; contents without a count are encoded once for each digest and appended. The tokenizer gets
the whole text. Equal contents are combined before the shuffle, so many copies are no large group.

A byte-level vocabulary splits before a space between visible characters, whatever stands around it. Texts are
cut there, words that return are encoded once in a task and the rest of a text together: the sum is the count
of the whole text. Other vocabularies encode the text as it is.

A cache is written by one job at a time. Counts of a job that dies are appended whole or not at
all, and a content that two jobs appended is counted once.

Defined results: a null text is normalised to the empty one, no tokens; repeated rows get equal
counts; null ids are kept; an empty table gives an empty result and appends nothing. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter as WordCounts
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import bounded_batches, table
from srclens.session import new_path, written

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHE = "content string, tokenizer string, n_tokens long"
_BATCH, _OFTEN, _KNOWN_WORDS = 16, 3, 50_000
# Between a visible character and a single space before another one every byte-level split ends a piece,
# whatever stands around; only characters that all libraries take for visible ones are named.
_CUT = re.compile("(?<=[!-~À-ÖØ-öø-ÿ])(?= [!-~À-ÖØ-öø-ÿ])")


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the file and of the version of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f"tokenizers {tokenizers.__version__}\n".encode() + f.read()).hexdigest()


class Counter:
    """Counts tokens with the vocabulary at ``path``; made inside a task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # where most words are rare, looking them up costs more than it saves
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not made["normalizer"]
        # a special string that holds a space could lie across a cut
        self.cuts = bool(plain) and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"])
        self.known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        """Without added special tokens; few texts at a time, since encodings are large."""
        out: list[int] = []
        for at in range(0, len(texts), _BATCH):
            out += map(len, self.tokenizer.encode_batch(texts[at : at + _BATCH], add_special_tokens=False))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text: what the library gives for it.

        Words that return within the batch are encoded once and kept. The words of a text that are not
        known are put together again, in order, and encoded as one text: its words meet as they did, at cuts.
        """
        if not self.cuts:
            return self._encode(texts)
        pieces = [_CUT.split(t) for t in texts]
        if len(self.known) < _KNOWN_WORDS:
            often = WordCounts(w for p in pieces for w in p if w not in self.known)
            new = [w for w, n in often.items() if n >= _OFTEN]
            self.known.update(zip(new, self._encode(new)))
        totals, rest = [], []
        for p in pieces:
            found = list(map(self.known.get, p))
            totals.append(sum(n for n in found if n is not None))
            rest.append("".join(w for w, n in zip(p, found) if n is None))
        return [n + m for n, m in zip(totals, self._encode(rest))]


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; the cache grows by the contents it lacked."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("content"))
    keys = written(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "contents")
    stored = cache.select("content").distinct()
    misses = rows.select("content", "text").join(stored, "content", "left_anti").groupBy("content").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(tokenizer_path)
            counts = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # Written, so that the join can split a content that most documents share.
    counted = keys.join(written(counts, "counts"), "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), public_tokenizers.path(VOCABULARY))
