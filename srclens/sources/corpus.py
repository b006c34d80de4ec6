"""File corpora: listing, strict UTF-8 reading, keep-or-replace snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions.text import has_suffix

# Fixed value: the extensions that are read.
EXTENSIONS = [".java"]
# Files with hidden names that one task reads.
FILES_IN_TASK = 1000


def hidden_entries(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Directories and files below ``root`` whose names Spark's listing skips.

    One glob per directory level; only the hidden entries come to Python. The JVM of the driver holds the
    statuses of a level for a moment, as it holds the whole listing for Spark's own file index.
    """
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    dirs, files, level = [], [], root.rstrip("/")
    while len(fs.globStatus(to_path(level + "/*")) or []):
        for status in fs.globStatus(to_path(level + "/{.*,_*}")):
            path = status.getPath().toString()
            if status.isDirectory():
                dirs.append(path)
            else:
                files.append((path, status.getLen()))
        level += "/*"
    return dirs, files


def _read_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add ``content``, one file at a time."""
    from pyarrow import fs

    for batch in batches:
        for at in range(len(batch)):
            row = batch.iloc[at : at + 1]
            uri = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?!/)", "file:///", row["path"].iloc[0]))
            system, name = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(name) as stream:
                yield row.assign(content=[stream.read()])


def corpus_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """``path, length, content`` of all files below ``root``, hidden ones included.

    ``content`` of files that Spark lists is read only where it is selected. One extension is pruned while
    listing; a list of them is a filter on the path. Spark skips hidden names while it
    descends but reads hidden directories as roots, so each is a root of its own. A
    file whose own name is hidden it never reads; those few are read in tasks.
    """
    dirs, hidden = hidden_entries(spark, root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions and len(extensions) == 1:
        reader = reader.option("pathGlobFilter", "*" + extensions[0])
    files = reader.load([root, *dirs]).select("path", "length", "content")
    if hidden:
        listed = spark.createDataFrame(hidden, "path string, length long").repartition(max(spark.sparkContext.defaultParallelism, len(hidden) // FILES_IN_TASK))
        files = files.unionByName(listed.mapInPandas(_read_bytes, "path string, length long, content binary"))
    return files.filter(has_suffix(F.col("path"), extensions)) if extensions else files


def read_text(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, content, reason``: strict UTF-8 text; bad bytes give null and a reason."""
    text = F.try_validate_utf8(F.col(content).cast("string"))
    return files.select(F.col(path).alias("path"), text.alias("content")).withColumn(
        "reason", F.when(F.col("content").isNull(), "encoding")
    )


def match_counts(paths: DataFrame, col: str, extensions: list[str]) -> DataFrame:
    """Files matched and files in all."""
    return paths.agg(F.count_if(has_suffix(F.col(col), extensions)).alias("matched"), F.count("*").alias("total"))


def snapshot(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write a corpus snapshot, or keep the one that is there unless ``force``."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)
