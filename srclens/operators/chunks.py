"""Overlapping chunks of long texts: fixed stride, and cut at preferred separators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Chunk length and overlap in characters, separators by preference.
CHUNK_SIZE = 3500
CHUNK_OVERLAP = 300
SEPARATORS = ["\n\nclass ", "\n\npublic ", "\n\nprotected ", "\n\nprivate ", "\n\n", "\n", " "]


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, chunk_idx, chunk``: windows of ``size`` that share ``overlap`` characters.

    The text is cut once into strides and each chunk takes what follows from the next strides,
    so the work is linear in the text and the overlap; a substring per chunk would walk the text anew from
    its start each time. Any overlap below the size will do.
    """
    stride = size - overlap
    assert 0 <= overlap < size
    cut = df.select(key, F.char_length(text).alias("n"), F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0)).alias("s"))
    # the last strides may already be inside the chunk before them
    count = F.when(F.col("n") <= size, F.least(F.col("n"), F.lit(1))).otherwise(F.ceil((F.col("n") - overlap) / stride)).cast("int")
    after = -(-overlap // stride)
    rest = F.substring(F.array_join(F.slice("s", F.col("chunk_idx") + 2, F.lit(after)), ""), 1, overlap)
    return cut.select(key, "s", F.posexplode(F.slice("s", F.lit(1), count)).alias("chunk_idx", "head")).select(
        key, "chunk_idx", F.concat("head", rest).alias("chunk")
    )


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of the text, each but the first beginning with the separator."""
    first, *others = text.split(separator)
    return [p for p in [first, *[separator + o for o in others]] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join whole pieces up to ``size``; a new chunk repeats up to ``overlap`` of the last."""
    held, begin, length = pieces, 0, 0
    for end, piece in enumerate(held):
        if length + len(piece) > size and end > begin:
            yield "".join(held[begin:end]).strip()
            while length > overlap or (length > 0 and length + len(piece) > size):
                length -= len(held[begin])
                begin += 1
        length += len(piece)
    if begin < len(held):
        yield "".join(held[begin:]).strip()


def separated(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of one text, cut at the first separator found and only where needed again."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators))
    if at == len(separators):
        return [text.strip()] if text.strip() else []
    chunks: list[str] = []
    small: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            small.append(piece)
            continue
        chunks += _pack(small, size, overlap)
        small = []
        chunks += separated(piece, size, overlap, separators[at + 1 :])
    chunks += _pack(small, size, overlap)
    return [c for c in chunks if c]


def separator_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, chunk_idx, chunk``. A run longer than ``size`` without any separator stays whole.

    Packing depends on what was packed before, so it runs per text in an Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["chunk"] = [separated(t, size, overlap, SEPARATORS) for t in batch.pop("text")]
            out = batch.explode("chunk").dropna(subset=["chunk"])
            out["chunk_idx"] = out.groupby(level=0).cumcount().astype("int32")
            yield out[["key", "chunk_idx", "chunk"]]

    typed = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    schema = f"key {typed.schema['key'].dataType.simpleString()}, chunk_idx int, chunk string"
    return typed.mapInPandas(run, schema).withColumnRenamed("key", key)
