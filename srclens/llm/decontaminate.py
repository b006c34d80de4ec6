"""Operator 2, benchmark decontamination, DataFrame functions only.

A document leaks a benchmark item when some window of it with as many words as the item
has a weighted similarity of at least ``SIMILARITY`` to it: shingles of five words with
their counts, sum of least counts over sum of largest counts.

1. Anchors. A window that similar shares all but a ninth of its shingles with the item,
   so at least one of every ``stride`` positions is shared. Shingle hashes at those
   positions meet the shingle hashes of the items, and the words around a hit are written. Where the items
   are few enough to ship (they are counted), no text is shuffled and documents are read once.
2. Windows. Around each anchor the item-sized windows are counted; those with too
   few shared anchors cannot be similar enough and go. A few stay for each leak.
3. SimHash. Each window gets the 64-bit SimHash of its shingles. A multi-index of eight byte blocks finds the items: fingerprints within
   23 bits have a block with at most two differing bits, and each item is listed under
   all 37 values that near for each of its blocks. So all items within the radius are
   found; at similarity 0.8 about 10 bits differ and over 23 do once in a million for items whose
   shingles are all different. Items whose shingles repeat skip this test: one change moves many bits of
   their SimHash (measured: 1.6 % of period-two items at exactly 0.8 were beyond 23 bits), and their
   windows, bounded by step 2, go to the exact similarity directly.
4. The exact weighted similarity of the shingle texts decides.

Words are runs of letters and digits of the lower-cased text. Defined results: null and
wordless texts leak nothing and wordless items are never found; an item of fewer than
five words is one shingle of its whole sequence; repeated rows count once; items with equal texts are
found alike; a null id is reported as null; empty tables give an empty result. Only the
id and text columns of either table are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import HINT_ROWS, counted_broadcast, row_key, table
from srclens.session import written

SIMILARITY, WORDS, STRIDE = 0.8, 5, 4
BLOCKS, FLIPS, RADIUS = 8, 2, 23  # eight blocks of eight bits; 8 * (2 + 1) - 1


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(flat, " "), "")


def _simhash(hashes: str, n: str) -> Column:
    """SimHash of an array of long hashes: a bit is set when it is in more than half of them.

    Each sum counts two bits at a time, one in either half of a long. The array is bound to
    a name first: the optimizer would else put its expression where it is used, once for each bit.
    """
    sums = "transform(sequence(0, 31), j -> aggregate(hs, 0L, (acc, h) -> acc + (shiftrightunsigned(h, j) & 4294967297L)))"
    return F.expr(
        f"aggregate(flatten(transform(array({hashes}), hs -> {sums})), named_struct('j', 0, 'fp', 0L), (acc, t) -> named_struct('j', acc.j + 1, 'fp', acc.fp"
        f" | if(2 * (t & 4294967295L) > {n}, shiftleft(1L, acc.j), 0L) | if(2 * shiftrightunsigned(t, 32) > {n}, shiftleft(1L, acc.j + 32), 0L)), acc -> acc.fp)"
    )


def _shingles(words: str, start: str, count: str, k: str) -> str:
    return f"transform(sequence({start}, {start} + {count} - 1), i -> array_join(slice({words}, i + 1, {k}), ' '))"


def _counted(shingles: str) -> str:
    """Shingles told apart by their occurrence, so that sets of them compare like counts."""
    return (
        f"flatten(transform(array({shingles}), a -> if(size(array_distinct(a)) = size(a), transform(a, x -> concat('1 ', x)),"
        " transform(a, (x, i) -> concat(size(filter(slice(a, 1, i + 1), y -> y = x)), ' ', x)))))"
    )


def _items(benchmark: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``item, item_id, k, s, parts, fp, anchors, plain``: own key, words of a shingle, number of shingles, shingles, SimHash,
    and whether no shingle repeats."""
    items = (
        benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w"))
        .filter(F.size("w") > 0)
        .distinct()
        .withColumn("k", F.least(F.lit(n_words), F.size("w")))
        .withColumn("s", F.expr("size(w) - k + 1"))
        .withColumn("raw", F.expr(_shingles("w", "0", "s", "k")))
    )
    anchors = F.expr("transform(raw, x -> aggregate(split(x, ' '), 0L, (h, y) -> xxhash64(h, y)))").alias("anchors")
    plain = (F.size(F.array_distinct("raw")) == F.col("s")).alias("plain")
    return items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", "k", "s", F.expr(_counted("raw")).alias("parts"), _simhash("transform(raw, x -> xxhash64(x))", "s").alias("fp"), anchors, plain
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    n_words: int = WORDS,
) -> DataFrame:
    """``rk, doc_id, item_id, start_word, n_words, shared, similarity``: the best window of each document and item."""
    items = written(_items(benchmark, item_col, item_text_col, n_words), "items")
    known = items.agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.min("s"), F.lit(1)), F.array_sort(F.collect_set("k"))).first()
    n_items, n_shingles, least, lengths = known[0], known[1], known[2], known[3]
    stride = max(1, min(STRIDE, least))
    spare = f"floor(s * (1 - {similarity}D) / (1 + {similarity}D) + 1e-9)"

    text = F.col(text_col)
    worded = docs.select(row_key(F.col(id_col), text).alias("rk"), F.col(id_col).alias("doc_id"), words_of(text).alias("w"))
    link = lambda k: "0L" if k == 0 else f"xxhash64({link(k - 1)}, w[p + {k - 1}])"
    spots = [
        f"transform(if(size(w) >= {k}, sequence(0, size(w) - {k}, {stride}), array()), p -> named_struct('k', {k}, 'p', p, 'h', {link(k)}))"
        for k in lengths or [n_words]
    ]
    anchors = worded.select("*", F.explode(F.expr(f"concat({', '.join(spots)})")).alias("a"))
    anchors = anchors.select("rk", "doc_id", F.size("w").alias("n"), "w", "a.*")
    listed = items.select("item", "k", "s", F.explode(F.array_distinct("anchors")).alias("h"))
    around = ["greatest(0, p - s + 1) low", "slice(w, greatest(0, p - s + 1) + 1, 2 * s + k) near"]
    if n_shingles <= HINT_ROWS:  # the join streams past the words and copies them only around a hit
        hits = anchors.join(F.broadcast(listed), ["k", "h"]).filter("n >= s + k - 1").selectExpr("rk", "doc_id", "item", "k", "s", "n", "p", *around)
    else:  # positions are shuffled, and texts once
        met = anchors.select("rk", "n", "k", "p", "h").join(listed, ["k", "h"]).filter("n >= s + k - 1").drop("n", "h")
        hits = worded.join(met, "rk").withColumn("n", F.size("w")).filter("p <= n - k and n >= s + k - 1").selectExpr("rk", "doc_id", "item", "k", "s", "n", "p", *around)
    hits = written(hits, "hits")
    # The hits of a row, some tens at most for a leak, are dealt out by its key once; rows that repeat give equal
    # hits. Windows are then made and counted where their hits are.
    starts = F.explode(F.expr("sequence(greatest(0, p - s + 1), least(p, n - k - s + 1))")).alias("at")
    counted = written(
        hits.select("rk", "doc_id", "item", "k", "s", "n", "p")
        .repartition("rk")
        .distinct()
        .select("rk", "doc_id", "item", "k", "s", "p", starts)
        .groupBy("rk", "doc_id", "item", "k", "s", "at")
        .agg(F.count("*").alias("met"), F.min("p").alias("p"))
        .filter(f"met >= floor((at + s - 1) / {stride}) - ceil(at / {stride}) + 1 - {spare}"),
        "windows",
    )
    # Items whose shingles repeat: one change moves many bits of their SimHash, so their windows, already
    # bounded by the count of shared anchors, go to the exact similarity without the bit test.
    repeating = counted_broadcast(items.filter(~F.col("plain")).select("item"), n_items)
    direct = counted.join(repeating, "item").select("rk", "item", "k", "s", "at")
    windows = (
        counted
        # a window that several items share is cut once
        .groupBy("rk", "doc_id", "k", "s", "at")
        .agg(F.min(F.struct("item", "p")).alias("by"))
        .select("rk", "doc_id", "k", "s", "at", "by.*")
    )
    keys = ["rk", "item", "k", "s", "p"]
    shown = hits.groupBy(*keys, "doc_id", "low").agg(F.first("near").alias("near"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys] + [F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))]
    cut = (
        windows.alias("x").join(shown.alias("y"), same)
        .selectExpr("x.rk", "x.doc_id", "x.k", "x.s", "x.at", "slice(near, at - low + 1, x.s + x.k - 1) w")
        # generators keep the optimizer from repeating these expressions where their results are used
        .select("rk", "doc_id", "k", "s", "at", F.explode(F.expr(f"array({_shingles('w', '0', 's', 'k')})")).alias("raw"))
    )
    marks = F.struct(F.expr(_counted("raw")).alias("mine"), _simhash("transform(raw, x -> xxhash64(x))", "s").alias("mine_fp"))
    cut = cut.select("rk", "doc_id", "k", "s", "at", F.inline(F.array(marks)))
    byte = lambda fp: f"cast(shiftrightunsigned({fp}, 8 * b) & 255 as int)"
    near = f"filter(sequence(0, 255), v -> bit_count(v ^ {byte('fp')}) <= {FLIPS})"
    index = items.select("item", "k", "s", "parts", "fp", "plain", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b")).select(
        "item", "k", "s", "parts", "fp", "plain", "b", F.explode(F.expr(near)).alias("v")
    )
    light = index.drop("parts")
    probes = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b")).withColumn("v", F.expr(byte("mine_fp")))
    first_block = f"forall(sequence(0, b), c -> c = b or bit_count(shiftrightunsigned(fp ^ mine_fp, 8 * c) & 255) > {FLIPS})"
    by_bits = (
        probes.join(counted_broadcast(light, n_items * BLOCKS * 37), ["k", "s", "b", "v"])
        .filter(F.expr(f"bit_count(fp ^ mine_fp) <= {RADIUS} and {first_block} and plain"))
        .select("rk", "doc_id", "item", "k", "s", "at", "mine")
    )
    by_count = cut.join(direct, ["rk", "k", "s", "at"]).select("rk", "doc_id", "item", "k", "s", "at", "mine")
    found = by_bits.unionByName(by_count)
    compared = (
        found.join(counted_broadcast(items.select("item", "item_id", "parts"), n_shingles), "item")
        .withColumn("shared", F.size(F.array_intersect("mine", "parts")))
        .filter(f"shared >= {similarity}D * (2 * s - shared) - 1e-9")
    )
    best = F.max(F.struct(F.col("shared"), (-F.col("at")).alias("at"), "s", "k")).alias("best")
    return (
        compared.groupBy("rk", "doc_id", "item_id")
        .agg(best)
        .selectExpr(
            "rk", "doc_id", "item_id", "cast(-best.at as int) start_word", "cast(best.s + best.k - 1 as int) n_words",
            "cast(best.shared as int) shared", "best.shared / (2 * best.s - best.shared) similarity",
        )
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns."""
    bad = written(leaks(docs, benchmark, id_col, text_col).select(F.col("rk").alias("__rk"), F.col("doc_id").alias("__id")).distinct(), "leaking")
    same = (row_key(F.col(id_col), F.col(text_col)) == F.col("__rk")) & F.col(id_col).eqNullSafe(F.col("__id"))
    return docs.join(bad, same, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("rk").distinct()


OP2_SQL = r"""
WITH RECURSIVE d0 AS (
    SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w
    FROM documents WHERE trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) <> ''),
d AS (SELECT row_number() OVER () r, doc_id, w, len(w) n FROM d0),
b0 AS (
    SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w
    FROM benchmark WHERE trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) <> ''),
b AS (SELECT item_id, w, least(5, len(w)) k, len(w) - least(5, len(w)) + 1 s FROM b0),
bs AS (SELECT item_id, k, s, array_to_string(w[i:i + k - 1], ' ') x, count(*) c
       FROM (SELECT item_id, w, k, s, unnest(range(1, s + 1)) i FROM b) GROUP BY ALL),
ds AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') x
       FROM (SELECT r, w, k, unnest(range(1, n - k + 2)) i FROM d, (SELECT DISTINCT k FROM b) WHERE n >= k)),
hit AS (SELECT DISTINCT r, item_id, bs.k, s, i FROM ds JOIN bs ON ds.x = bs.x AND ds.k = bs.k),
cand AS (SELECT DISTINCT h.r, item_id, h.k, s, a
         FROM (SELECT r, item_id, k, s, unnest(range(greatest(1, i - s + 1), i + 1)) a FROM hit) h JOIN d ON d.r = h.r
         WHERE a + s + k - 2 <= n),
win AS (SELECT c.r, c.item_id, c.k, c.s, c.a, ds.x, count(*) c
        FROM cand c JOIN ds ON ds.r = c.r AND ds.k = c.k AND ds.i BETWEEN c.a AND c.a + c.s - 1 GROUP BY ALL),
met AS (SELECT win.r, win.item_id, win.k, win.s, win.a, sum(least(win.c, bs.c)) shared
        FROM win JOIN bs ON bs.item_id = win.item_id AND bs.k = win.k AND bs.s = win.s AND bs.x = win.x GROUP BY ALL),
good AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY shared DESC, a) rank
         FROM met WHERE shared >= 0.8 * (2 * s - shared) - 1e-9)
SELECT DISTINCT doc_id, item_id, CAST(a - 1 AS INT) start_word, CAST(s + good.k - 1 AS INT) n_words, CAST(shared AS INT) shared,
       CAST(shared AS DOUBLE) / CAST(2 * s - shared AS DOUBLE) similarity
FROM good JOIN d ON d.r = good.r WHERE rank = 1
"""
