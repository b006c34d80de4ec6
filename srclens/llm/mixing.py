"""Operator 9, mixing sources to target weights.

Leaves are the sources of a language of a domain. A token budget goes down the tree
domain, language, source by the weights of siblings. A node cannot take more tokens than
its leaves hold in ``epochs`` passes; what it must leave is filled by its siblings in
proportion to their weights, and since a node's own limit is the sum of its leaves' limits, shortages
move to another branch only when a whole branch is full: siblings first, then ancestors.

Filling one set of siblings has a closed form: sorted by limit over weight, the first
ones are full, and the rest shares what is left by weight. It is one window over
the few rows of a level (one row for each leaf), not over documents.

A leaf takes its documents in whole epochs, and from the next epoch the longest prefix
whose tokens fit, in the order of a seeded hash of the document. The prefix of a large leaf is not
sorted in one task: tokens are summed by hash bucket first, buckets before the cut are taken whole, and
only the bucket of the cut is numbered document by document.

Tokens are runs of characters other than white space. Defined results: a null or empty text has
no tokens and is taken when its turn comes before the cut; null sources and languages are the leaf
``(none)``; repeated rows are taken like different ones that share a place, all or none; a null id sorts as
an empty text; a leaf without tokens takes nothing; empty tables give an empty result.
The id, text, source and language columns are read; ``select`` keeps all others of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srclens.llm.common import table
from srclens.session import written

SEED, EPOCHS, FRACTION = 17, 3, 0.6
BUCKET_DIGITS = 3
DOMAIN_WEIGHTS = {"domain0": 0.4, "domain1": 0.3, "domain2": 0.2, "domain3": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
OTHER_WEIGHT = 0.05


def domain_of(source: Column) -> Column:
    """The domain of a source: the number at its end, modulo four; ``other`` without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (number.try_cast("int") % 4).cast("string")))


def weight(name: Column, weights: dict[str, float], other: float) -> Column:
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(known, name), F.lit(other))


def filled(nodes: DataFrame, parent: list[str], budget: str, limit: str, weight_col: str, out: str) -> DataFrame:
    """Give each group of siblings its ``budget``, none more than its ``limit``, the rest by weight."""
    ratio = F.col(limit) / F.col(weight_col)
    before = Window.partitionBy(*parent).orderBy("__ratio", *nodes.columns[:3]).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    level = (F.col(budget) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum(weight_col).over(whole) - F.coalesce(F.sum(weight_col).over(before), F.lit(0.0))
    )
    ranked = nodes.withColumn("__ratio", ratio).withColumn("__level", level)
    full = F.col("__ratio") <= F.col("__level") + 1e-9
    shared = F.max(F.when(~full, F.col("__level"))).over(whole)  # that of the first one not full
    return ranked.withColumn(out, F.when(full, F.col(limit).cast("double")).otherwise(shared * F.col(weight_col))).drop("__ratio", "__level")


def budgets(leaves: DataFrame, fraction: float, epochs: int, domains: dict[str, float], languages: dict[str, float], other: float) -> DataFrame:
    """``domain, lang, source, tokens, budget`` from ``domain, lang, source, tokens``: one row for each leaf."""
    sized = leaves.withColumn("most", F.col("tokens") * epochs)
    top = sized.groupBy("domain").agg(F.sum("most").alias("most"), F.sum("tokens").alias("tokens")).select(
        "domain", F.lit("").alias("lang"), F.lit("").alias("source"), "most", "tokens"
    )
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(1))) * F.lit(fraction)).cast("double")
    top = filled(top.withColumn("total", total).withColumn("w", weight(F.col("domain"), domains, other)), [], "total", "most", "w", "domain_budget")
    mid = sized.groupBy("domain", "lang").agg(F.sum("most").alias("most")).select("domain", "lang", F.lit("").alias("source"), "most")
    mid = mid.join(top.select("domain", "domain_budget"), "domain").withColumn("w", weight(F.col("lang"), languages, other))
    mid = filled(mid, ["domain"], "domain_budget", "most", "w", "lang_budget")
    low = sized.join(mid.select("domain", "lang", "lang_budget"), ["domain", "lang"]).withColumn("w", F.lit(1.0))
    low = filled(low.select("domain", "lang", "source", "tokens", "most", "lang_budget", "w"), ["domain", "lang"], "lang_budget", "most", "w", "leaf")
    return low.select("domain", "lang", "source", "tokens", F.floor(F.col("leaf") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    fraction: float = FRACTION,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domains: dict[str, float] | None = None,
    languages: dict[str, float] | None = None,
    other: float = OTHER_WEIGHT,
) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch``: one row for each time that a document is taken."""
    named = lambda c: F.coalesce(F.col(c), F.lit("(none)"))
    marked = docs.select(
        F.col(id_col).alias("doc_id"),
        domain_of(named(source_col)).alias("domain"),
        named(lang_col).alias("lang"),
        named(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    marked = written(marked, "sized")
    leaf = ["domain", "lang", "source"]
    leaves = marked.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    shares = budgets(leaves, fraction, epochs, domains or DOMAIN_WEIGHTS, languages or LANGUAGE_WEIGHTS, other)
    shares = written(
        shares.withColumn("whole", F.expr("if(tokens = 0, 0, budget div tokens)")).withColumn("rest", F.expr("if(tokens = 0, 0, budget % tokens)")), "shares"
    )
    given = marked.join(shares.select(*leaf, "whole", "rest"), leaf)

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = given.filter("rest > 0").select("doc_id", *leaf, "n_tokens", "whole", "rest", order.alias("h"))
    part = written(part.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)), "ordered")
    sums = part.groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    so_far = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sums.withColumn("upto", F.sum("t").over(so_far)).select(*leaf, "bucket", "upto", (F.col("upto") - F.col("t")).alias("before"), "rest")
    inside = placed.filter("upto <= rest").select(*leaf, "bucket")
    at_cut = placed.filter("before < rest and upto > rest").select(*leaf, "bucket", "before")
    columns = ["doc_id", *leaf, "n_tokens", "whole"]
    taken = part.join(inside, [*leaf, "bucket"], "left_semi").select(*columns)
    running = Window.partitionBy(*leaf).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = part.join(at_cut, [*leaf, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).filter("upto <= rest").select(*columns)
    again = given.filter("whole > 0").select("doc_id", *leaf, "n_tokens", F.explode(F.expr("sequence(0, whole - 1)")).alias("epoch"))
    first = taken.union(last).withColumnRenamed("whole", "epoch")
    return again.union(first).select("doc_id", *leaf, "n_tokens", F.col("epoch").cast("int").alias("epoch"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_fill(source: str, parent: str, budget: str, out: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
    SELECT * EXCLUDE (ratio, level, shared), CASE WHEN ratio <= level + 1e-9 THEN CAST(most AS DOUBLE) ELSE shared * w END {out} FROM (
        SELECT *, max(CASE WHEN ratio > level + 1e-9 THEN level END) OVER ({by}) shared FROM (
            SELECT *, ({budget} - coalesce(sum(most) OVER ({by} ORDER BY ratio, domain, lang, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY ratio, domain, lang, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) level
            FROM (SELECT *, CAST(most AS DOUBLE) / w ratio FROM ({source}))))"""


def _sql_weight(name: str, weights: dict[str, float]) -> str:
    return f"CAST(CASE {name} {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in weights.items())} ELSE {OTHER_WEIGHT} END AS DOUBLE)"


OP9_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(source, '(none)') source, coalesce(lang, '(none)') lang,
           CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
                ELSE 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4) END AS "domain",
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) n_tokens
    FROM documents),
leaves AS (SELECT "domain", lang, source, CAST(sum(n_tokens) AS BIGINT) tokens, CAST(sum(n_tokens) AS BIGINT) * {EPOCHS} most FROM d GROUP BY ALL),
top AS ({_sql_fill(f'''SELECT "domain", '' lang, '' source, sum(most) most, {_sql_weight("domain", DOMAIN_WEIGHTS)} w,
        floor((SELECT sum(tokens) FROM leaves) * CAST({FRACTION} AS DOUBLE)) total FROM leaves GROUP BY "domain"''', "", "total", "domain_budget")}),
mid AS ({_sql_fill(f'''SELECT l."domain", l.lang, '' source, sum(l.most) most, {_sql_weight("l.lang", LANGUAGE_WEIGHTS)} w, any_value(domain_budget) domain_budget
        FROM leaves l JOIN top ON top."domain" = l."domain" GROUP BY l."domain", l.lang''', '"domain"', "domain_budget", "lang_budget")}),
low AS ({_sql_fill('''SELECT l.*, CAST(1 AS DOUBLE) w, lang_budget FROM leaves l JOIN mid ON mid."domain" = l."domain" AND mid.lang = l.lang''',
        '"domain", lang', "lang_budget", "leaf")}),
shares AS (SELECT "domain", lang, source, CASE WHEN tokens = 0 THEN 0 ELSE CAST(floor(leaf + 1e-6) AS BIGINT) // tokens END whole,
                  CASE WHEN tokens = 0 THEN 0 ELSE CAST(floor(leaf + 1e-6) AS BIGINT) % tokens END rest FROM low),
given AS (SELECT d.*, whole, rest, md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) h
          FROM d JOIN shares s ON s."domain" = d."domain" AND s.lang = d.lang AND s.source = d.source),
part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY "domain", lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) upto
         FROM given WHERE rest > 0)
SELECT doc_id, "domain", lang, source, n_tokens, CAST(whole AS INT) epoch FROM part WHERE upto <= rest
UNION ALL
SELECT doc_id, "domain", lang, source, n_tokens, CAST(e AS INT) FROM (SELECT *, unnest(range(0, whole)) e FROM given WHERE whole > 0)
"""
