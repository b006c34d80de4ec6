"""Operator 12, spelling variant grouping by a relational trie frontier.

Words are counted with Spark's own aggregation (partial counts before the shuffle, so a word that
a third of all texts hold is no single task). The vocabulary becomes a trie kept as a table of
edges ``parent, c, child``: every prefix of a word is a node, named by the prefix itself, and a
node is terminal when it is a word.

Neighbours, words one inserted, deleted or replaced code point apart, are found by walking the
trie with states ``(word, i, node, e)``: ``i`` code points of the word are read, ``node`` is
reached and ``e`` edits (0 or 1) are spent. The unedited states of depth ``d`` are the words of
length ``d`` or more standing at their own prefix; level ``d`` joins them with the edges leaving
that depth. A replacement (an edge other than the next code point) moves ``i`` on, an insertion
(any edge) keeps it, a deletion moves ``i`` on without leaving the node. A state with one edit
may only follow the unread rest of its word, so the terminal it can reach is named by its node
and that rest: it is looked up among the words at once instead of being walked edge by edge
(walking them, measured on 0.1 GB, wrote 85 to 130 million states at a level). Levels run one
band after another: consecutive levels whose edges are counted few enough to ship are one join, in
which each state meets the edges of its own depth; each band is written. (One job for each level
cost more in fixed time than in work at 0.1 GB.)

The edges of a depth are shipped whole to every task when they are few (counted, at most
``HINT_ROWS``); this matters at the top of the trie, where every state meets the root or one of
its few children. Deeper levels join by shuffle, where adaptive execution splits a node that
many states reach. The words are held whole for the look-up when they measure at most
``LOOKUP_BYTES``, else the ends are joined with them by shuffle.

Forms: a word's form is its neighbour with the largest count (ties: smallest in code-point
order) when that count is at least ``RATIO`` times its own; roots follow forms by pointer
doubling, which ends since counts at least double along a chain.

Defined results: null texts hold no words; a null doc_id deletes nothing; a word without
neighbours has ``n_near`` 0 and null ``form`` and ``form_n``; repeated rows count again; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import HINT_ROWS, counted_broadcast, table
from srclens.session import written

# Fixed values of the operator's contract.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
LONG_RUNS = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
"""Maximal runs of at least so many letters: a search resumes after a run, and a run that long matches whole from its
first letter, so these are exactly the maximal runs not shorter than that. A shorter run never becomes a word, since a
deletion only shortens it."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 97
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2

LOOKUP_BYTES = 64 << 20
"""Largest measured vocabulary that every task holds whole to look one-edit ends up; beyond it they are joined by shuffle."""


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``word`` for every letter run of the op12 contract that can give a word of ``min_chars``, after its hashed deletion."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    long_runs = F.lit(LONG_RUNS % min_chars)
    runs = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(F.regexp_extract_all(text, long_runs, 0)).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("w"))
    hashed = lowered.select("w", F.crc32(F.concat("id", F.lit(":"), "w")).alias("h"))
    return hashed.selectExpr(
        f"CASE WHEN h % {DROP_EVERY} = 0 THEN concat(left(w, CAST(h % length(w) AS INT)), substring(w, CAST(h % length(w) AS INT) + 2)) ELSE w END AS word"
    )


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of words with at least ``min_chars`` code points and ``min_count`` occurrences."""
    return words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def trie_edges(vocab: DataFrame) -> DataFrame:
    """``depth, parent, c, child, terminal``: one row for every prefix of a word, ``depth`` its length."""
    k = F.explode(F.sequence(F.lit(1), F.length("word")))
    prefixes = vocab.select(k.alias("depth"), "word").select("depth", F.expr("left(word, depth)").alias("child"), (F.length("word") == F.col("depth")).alias("terminal"))
    nodes = prefixes.groupBy("depth", "child").agg(F.max("terminal").alias("terminal"))
    return nodes.select("depth", F.expr("left(child, depth - 1)").alias("parent"), F.expr("substring(child, depth, 1)").alias("c"), "child", "terminal")


def neighbours(vocab: DataFrame, most: int = HINT_ROWS, lookup_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """``word, near``: every pair of words one edit apart, both ways, each once."""
    spark = vocab.sparkSession
    words = written(vocab.select("word", F.length("word").alias("size")), "trie-words")
    edges = written(trie_edges(vocab), "trie-edges")
    sizes = {r["depth"]: r["count"] for r in edges.groupBy("depth").count().collect()}
    measured = words.agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + 48).alias("bytes")).first()
    terminals = words.select(F.col("word").alias("near"))
    if measured["n"] and measured["bytes"] <= lookup_bytes:
        terminals = F.broadcast(terminals)
    # Levels go in bands: consecutive levels whose edges together are counted few enough to ship are one join,
    # each state meeting the edges of its own depth; a level with more edges is a band of its own, joined by shuffle.
    bands: list[list[int]] = []
    for depth in range(0, max(sizes, default=0) + 1):
        n = sizes.get(depth + 1, 0)
        if bands and sum(sizes.get(d + 1, 0) for d in bands[-1]) + n <= most:
            bands[-1].append(depth)
        else:
            bands.append([depth])
    found = []
    for band in bands:
        low, high = band[0], band[-1]
        # Unedited states of these levels: the word read up to ``depth``, standing at the node of that prefix.
        at = words.select("word", "size", F.explode(F.sequence(F.lit(low), F.least(F.col("size"), F.lit(high)))).alias("depth")).selectExpr(
            "word", "size", "depth", "left(word, depth) node", "substring(word, depth + 1, 1) next", "substring(word, depth + 2) after", "substring(word, depth + 1) rest"
        )
        level = edges.filter(F.col("depth").between(low + 1, high + 1)).select((F.col("depth") - 1).alias("from"), "parent", "c", "child")
        level = counted_broadcast(level, sum(sizes.get(d + 1, 0) for d in band), most)
        grown = at.join(level, (F.col("depth") == F.col("from")) & (F.col("node") == F.col("parent")))
        # One-edit states: a deletion stays at the node, a replacement or an insertion takes an edge. From
        # there only the unread rest of the word may follow, so the state ends at the terminal that node and rest name.
        ends = (
            at.filter(F.col("size") > F.col("depth")).select("word", F.concat("node", "after").alias("near"))
            .unionByName(grown.filter((F.col("size") > F.col("depth")) & (F.col("c") != F.col("next"))).select("word", F.concat("child", "after").alias("near")))
            .unionByName(grown.select("word", F.concat("child", "rest").alias("near")))
        )
        found.append(written(ends.join(terminals, "near").select("word", "near"), f"trie-levels-{low}-{high}"))
    if not found:
        return spark.createDataFrame([], "word string, near string")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.filter(F.col("word") != F.col("near")).distinct()


def variants(vocab: DataFrame, ratio: int = RATIO, most: int = HINT_ROWS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``vocab`` (``word, n``)."""
    pairs = neighbours(vocab, most)
    words = vocab.count()
    counts = counted_broadcast(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), words, most)
    best = (
        pairs.join(counts, "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("top"))
    )
    graded = written(
        vocab.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("top.near_n") >= ratio * F.col("n"), F.col("top.near")).alias("form"),
            F.when(F.col("top.near_n") >= ratio * F.col("n"), F.col("top.near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    step = graded.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        hop = counted_broadcast(step.select(F.col("word").alias("root"), F.col("root").alias("further")), words, most)
        longer = written(step.join(hop, "root").select("word", F.col("further").alias("root")), "spelling-roots")
        if longer.join(step, ["word", "root"], "left_anti").limit(1).count() == 0:
            break
        step = longer
    return graded.join(step, "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = written(vocabulary(words_of(docs)), "spelling-vocabulary")
    return variants(vocab)
