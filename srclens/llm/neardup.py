"""Operator 5, SimHash near-duplicates.

Fingerprints of word shingles are linked when at most two of their 64 bits differ, and
linked documents form components.

Two such fingerprints agree in at least six of their eight bytes. The inverted index
holds positional bytes: a posting list is keyed by the four bytes at two of the four
byte pairs, since six equal bytes leave at least two pairs whole. (Lists of one byte
would each hold 1/256 of the corpus, and tallies over them would grow with its square.)
For each pair that meets in a list the shared positional bytes are tallied, pairs
with fewer than six are dropped, and the rest is verified bit by bit. A pair is tallied
only in the first list it shares. Lists longer than ``LONGEST_LIST`` come from groups of near copies;
their members are linked exactly by another way: fingerprints within two bits share
a value that is at most one bit away from both, and such a value has at most 65 of them.

Defined results: a null text counts as empty, fingerprint zero; empty texts link to each other;
repeated rows are linked; a null id is never the smallest id of a component unless no
member has one; an empty table gives an empty result. Only the id and text columns are read.

The pipeline stage, ``keep_least``, keeps one row of each of these components. ``keep_one`` links by
five-word shingles and exact Jaccard similarity instead (``similar_links``), for callers that want that.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from srclens.llm.common import bounded_batches, connected_components, counted_broadcast, row_key, table
from srclens.session import written

WORDS, SEED, RADIUS = 3, 42, 2
LONGEST_LIST = 64
STAGE_WORDS, SIMILARITY = 5, 0.8
SAMPLED, HOT = 20_000, 200_000
"""Sets whose shingles are counted, and the most shingles that are told as frequent."""
PIVOTS, CELL = 2, 128
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the shingles, as an unsigned number; zero without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII space
    if not found:
        return 0
    grams = [found] if len(found) < words else zip(*(found[i:] for i in range(words)))
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"))


def _byte_pair(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(distinct: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """``u, v``: links between the fingerprints in column ``fp``, enough for the components.

    From short lists every pair within the radius; from long lists each member's link to the least
    fingerprint among those around a common value.
    """
    fp, combos = F.col("fp"), list(combinations(range(4), 2))
    key = lambda a, b: F.shiftleft(_byte_pair(fp, a), 16).bitwiseOR(_byte_pair(fp, b))
    entries = F.array(*[F.struct(F.lit(n).alias("list"), key(a, b).alias("bytes")) for n, (a, b) in enumerate(combos)])
    posted = distinct.select("fp", F.inline(entries))
    sizes = posted.groupBy("list", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    posted = written(posted.join(sizes, ["list", "bytes"]), "postings")

    short = posted.filter(F.col("n") <= longest)
    other = short.select("list", "bytes", F.col("fp").alias("fp2"))
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    same = [_byte_pair(diff, i) == 0 for i in range(4)]
    first = F.coalesce(*[F.when(same[a] & same[b], F.lit(n)) for n, (a, b) in enumerate(combos)])
    tally = sum((F.shiftrightunsigned(diff, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(8))
    pairs = (
        short.join(other, ["list", "bytes"])
        .filter((F.col("fp") < F.col("fp2")) & (first == F.col("list")))
        .filter(tally >= 8 - RADIUS)
        .filter(F.bit_count(diff) <= RADIUS)
        .select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    )

    around = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    stars = (
        posted.filter(F.col("n") > longest)
        .select("fp")
        .distinct()
        .select("fp", F.explode(around).alias("value"))
        .groupBy("value")
        .agg(F.collect_set("fp").alias("members"))  # at most 65: the value and its one-bit changes
        .filter(F.size("members") > 1)
        .select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
        .filter("u <> v")
    )
    return pairs.union(stars)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST_LIST) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct, longest), "links")
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int = STAGE_WORDS) -> DataFrame:
    """``rk, doc_id, key, n, shingles``: the different shingles of a row as sorted hashes, and a key of that set."""
    bounded_batches(docs.sparkSession)

    @pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_hashes(t, words) for t in texts])

    text = F.col(text_col)
    found = docs.select(row_key(F.col(id_col), text).alias("rk"), F.col(id_col).alias("doc_id"), of(text).alias("shingles"))
    return found.select("rk", "doc_id", F.xxhash64("shingles").alias("key"), F.size("shingles").alias("n"), "shingles")


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    grams = [found] if len(found) < words else zip(*(found[i:] for i in range(words)))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], dtype=np.uint64).view(np.int64))


def _postings(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, n, at, h``: the rarest shingles of a set, as many as any similar set must share one of.

    Any one order of all shingles loses no pair; frequent ones of a sample come last, which keeps lists short.
    """
    spark = sets.sparkSession
    share = min(1.0, SAMPLED / max(1, sets.count()))
    sample = sets.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    often = sample.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 2")
    hot = often.orderBy(F.desc("c"), "h").limit(HOT).collect()
    known = spark.sparkContext.broadcast(np.array([r["h"] for r in hot][::-1], dtype=np.int64))  # the most frequent is the last

    @pandas_udf("array<long>")
    def rarest(shingles: pd.Series) -> pd.Series:
        by = np.argsort(known.value)
        values = known.value[by]
        out = []
        for x in shingles:
            x = np.asarray(x, dtype=np.int64)
            rank = np.full(len(x), -1, dtype=np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                rank = np.where(values[at] == x, by[at], -1)
            first = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1
            out.append(x[np.lexsort((x, rank))[:first]])
        return pd.Series(out)

    return sets.filter("n > 0").select("key", "n", F.posexplode(rarest("shingles")).alias("at", "h"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose shingle sets are that similar. ``parts`` spreads a set that many pairs have."""
    pairs = pairs.groupBy("u", "v").agg(F.max("parts").alias("parts"))
    pairs = written(pairs.select("u", "v", F.expr("pmod(xxhash64(v), parts)").alias("pu"), F.expr("pmod(xxhash64(u), parts)").alias("pv")), "pairs")
    asked = pairs.select(F.col("u").alias("key"), F.col("pu").alias("part")).union(pairs.select("v", "pv")).distinct()
    named = written(sets.select("key", "shingles").join(asked.select("key").distinct(), "key", "left_semi"), "paired-sets")
    spread = named.join(asked, "key")
    left, right = spread.toDF("u", "a", "pu"), spread.toDF("v", "b", "pv")
    both = F.size(F.array_intersect("a", "b"))
    enough = both >= F.lit(similarity) * (F.size("a") + F.size("b") - both) - 1e-9
    return pairs.join(left, ["u", "pu"]).join(right, ["v", "pv"]).filter(enough).select("u", "v")


def similar_links(sets: DataFrame, similarity: float = SIMILARITY, longest: int = LONGEST_LIST) -> DataFrame:
    """``u, v``: links between the keys of ``sets`` (``key, n, shingles``), enough for the components.

    Sets of Jaccard similarity t share at least t of the larger one, so they share one of their rarest
    (1 - t) n + 1 shingles, whatever they are: no similar pair is missed. Pairs whose sizes or places in the
    lists rule out the similarity go. Members of long lists are compared with a few of the list first; then those
    that are not in one component yet are compared, in cells of bounded size.
    """
    posted = _postings(sets, similarity)  # not written: most of these rows share nothing, and the shared ones are written below
    sizes = written(posted.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "list-sizes")
    posted = written(posted.join(sizes, "h"), "shared-postings")
    other = lambda df: df.select(*[F.col(c).alias(c if c in ("h", "lo", "hi") else f"{c}2") for c in df.columns])
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n2")) - 1e-9)
    fits = least <= F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    as_pairs = lambda df: df.select(F.least("key", "key2").alias("u"), F.greatest("key", "key2").alias("v"), F.ceil(F.col("size") / 64).alias("parts"))

    short, long = posted.filter(F.col("size") <= longest), posted.filter(F.col("size") > longest)
    near = short.join(other(short), "h").filter((F.col("key") < F.col("key2")) & fits)
    chosen = written(
        long.groupBy("h").agg(*[F.min_by(F.struct("key", "n", "at"), F.xxhash64("key", "h", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
        .select("h", F.inline(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(PIVOTS)]))))
        .toDF("h", "key2", "n2", "at2"),
        "pivots",
    )
    by_pivot = long.join(chosen, "h").filter((F.col("key") != F.col("key2")) & fits)
    found = written(_similar(as_pairs(near).union(as_pairs(by_pivot)), sets, similarity), "similar")
    if long.isEmpty():
        return found

    roots = connected_components(found, "first-links")
    placed = long.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("h"), "mixed")
    cells = (
        placed.join(mixed, "h")
        .withColumn("m", F.ceil(F.col("size") / CELL).cast("int"))
        .withColumn("b", F.expr("cast(pmod(xxhash64(key), m) as int)"))
        .select("h", "key", "n", "at", "size", "root", "b", F.explode(F.expr("sequence(0, m - 1)")).alias("c"))
        .withColumn("lo", F.least("b", "c")).withColumn("hi", F.greatest("b", "c")).drop("c")
    )
    once = (F.col("lo") == F.least("b", "b2")) & (F.col("hi") == F.greatest("b", "b2"))
    rest = cells.join(other(cells), ["h", "lo", "hi"]).filter((F.col("key") < F.col("key2")) & (F.col("root") != F.col("root2")) & once & fits)
    return found.union(_similar(as_pairs(rest), sets, similarity))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS, similarity: float = SIMILARITY, longest: int = LONGEST_LIST
) -> DataFrame:
    """One document of each component, the one with its least id, with all columns.

    Linked are documents whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``;
    wordless texts are linked to each other. Of rows that share the least id of a component the least stays; rows
    that share an id in different components are told apart by their texts. Rows without an id stay.
    """
    rows = written(shingled(docs, id_col, text_col, words), "shingled")
    light = rows.select("rk", "doc_id", "key")
    twins = written(light.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("rk", "doc_id")).alias("one")).filter("c > 1").select("key", "one"), "twins")
    single = rows.join(twins.select("key"), "key", "left_anti")
    double = rows.join(twins, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    sets = single.select("key", "n", "shingles").union(written(double, "repeated-sets"))  # the others are read where they are, not written twice
    roots = written(connected_components(similar_links(sets, similarity, longest), "links"), "roots")
    found = written(
        light.join(roots.withColumnRenamed("node", "key"), "key", "left").select("rk", "doc_id", F.coalesce("root", "key").alias("root")).filter("doc_id is not null"),
        "components",
    )
    groups = written(found.groupBy("root").agg(F.count("*").alias("c"), F.min("doc_id").alias("least")).filter("c > 1").select("root", "least"), "groups")
    grouped = written(found.join(groups, "root"), "grouped")
    gone = written(grouped.filter("doc_id <> least").select(F.col("rk").alias("__gone"), F.col("doc_id").alias("__id")).distinct(), "gone")
    least = grouped.filter("doc_id = least")
    several = written(least.groupBy("root").count().filter("count > 1").select("root"), "several")
    twice = least.join(several, "root").select(F.col("rk").alias("__twice"), F.col("doc_id").alias("__id"), F.col("root").alias("__root"))
    twice = written(twice.distinct(), "twice")
    keyed = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    same = lambda key: (F.col("__rk") == F.col(key)) & (F.col(id_col) == F.col("__id"))
    stay = keyed.join(gone, same("__gone"), "left_anti")
    repeated = stay.join(twice, same("__twice")).groupBy("__root").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return stay.join(twice, same("__twice"), "left_anti").drop("__rk").unionByName(repeated)


def keep_least(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST_LIST) -> DataFrame:
    """One row of each SimHash component, with all columns: the pipeline's near-copy stage.

    Components are those of the operator above with its contract's settings: three-word
    shingles, at most two differing bits, no other check. Of each component the row of the
    least id stays (ties of one id: the least row key; rows equal in id and text: one of them).
    Rows without an id stay. Rows of one id in different components are different documents,
    and each stays in its own component. Only ids, row keys and fingerprints are shuffled; the
    texts meet the removed keys in one anti join, shipped whole when they are counted few.
    """
    keyed = docs.withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    marked = written(
        fingerprints(keyed.select(F.struct(F.col("__rk").alias("rk"), F.col(id_col).alias("id")).alias("__key"), F.col(text_col)), "__key", text_col)
        .select(F.col("doc_id.rk").alias("rk"), F.col("doc_id.id").alias("doc_id"), "fp"),
        "stage-fingerprints",
    )
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "stage-distinct")
    roots = connected_components(links(distinct, longest), "stage-links")
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = written(marked.filter(F.col("doc_id").isNotNull()).join(grouped.select("fp", "root"), "fp"), "stage-components")
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "rk")).alias("c")).select("c.doc_id", "c.rk")
    removed = written(found.select("doc_id", "rk").join(chosen, ["doc_id", "rk"], "left_anti").distinct(), "stage-removed")
    twice = written(found.join(chosen, ["doc_id", "rk"], "left_semi").groupBy("doc_id", "rk").count().filter("count > 1").select("doc_id", "rk"), "stage-twice")
    counted = lambda df: counted_broadcast(df.toDF("__i", "__k"), df.count())
    same = (F.col("__rk") == F.col("__k")) & (F.col(f"`{id_col}`") == F.col("__i"))
    gone, again = counted(removed), counted(twice)
    stay = keyed.join(gone, same, "left_anti")
    single = stay.join(again, same, "left_anti")
    repeated = stay.join(again, same, "left_semi").groupBy(id_col, "__rk").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return single.drop("__rk").unionByName(repeated.select("__row.*"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
