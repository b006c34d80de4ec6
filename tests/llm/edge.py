"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur " * 5000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (3, ""),
    (4, None),
    (5, "   \n\t "),
    (6, LONG),
    (7, "ÀÉ 漢字 🙂 token = \"0123456789abcdef0123\" </s> <|endoftext|>"),
    (None, "A row without an id, but with words of its own in it."),
    (None, None),
    (8, "one"),
    (9, "Zwei kurze Worte"),
]
CLASHING = "rk fp w n k s at h p b v a t u x id y bucket place part score content tokenizer n_tokens digest list key vec stripe before windows head".split()


def documents(spark, rows=TEXTS):
    """Columns of documents and others with names that operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") != 9, "src1").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
