"""Java text rendered from the plain tables, so that SQL knows the right answers.

One file per order and one per supplier, each from its own row alone: no join and no
grouping, so no key can make a file large. With k = o_orderkey and c = o_custkey:

  * package ``com.p<k%7>``; none when k%11 = 0
  * class ``C<k%5000>`` extends ``Base<c%5>`` implements ``I0, I<c%3>``
  * 1 + c%4 methods ``m1..``; method j has (k+j)%4 ``if`` statements and one lambda
  * fields ``URL``, ``a``, ``b`` (two from one declaration) and ``arr``
  * nested class ``N<k>`` with one method ``z``
  * comment and string decoys
  * k%97 = 0: a closing brace is missing; k%89 = 0: an enum instead of the class
  * supplier s: interface ``S<s>`` extends ``N<nation>, Closeable`` with two methods, and class
    ``T<s>`` with nested classes ``D`` and ``E``, each with a nested class ``B`` of its own
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_files(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    package = F.when(k % 11 == 0, F.lit("")).otherwise(_text("package com.p", k % 7, ";\n"))
    method = lambda j: _text(
        "  /** if (x) { */\n  @A({\"a;\", \"{\"}) public static int m", j, "(final int a, Map<String, List<B>> b) {\n",
        F.repeat(F.lit("    if (a > 1) { a--; } // if\n"), ((k + j) % 4).cast("int")),
        "    run(x -> { x.go(\"for ;\"); });\n    return a;\n  }\n",
    )
    body = _text(
        "@Table({\"t\"})\npublic class C", k % 5000, " extends Base", c % 5, " implements I0, I", c % 3, " {\n",
        "  private static final String URL = \"http://x/{ class Q\";\n  protected Map<String, B> a = of(1, 2), b;\n",
        "  int[] arr = {1, 2};\n  C", k % 5000, "(int q) { this.q = q; }\n",
        F.array_join(F.transform(F.sequence(F.lit(1), (1 + c % 4).cast("int")), method), ""),
        "  static class N", k, " { void z() {} }\n",
        F.when(k % 97 == 0, F.lit("")).otherwise(F.lit("}\n")),
    )
    enum = _text("public enum E", k, " { A, B; int get() { return 1; } }\n")
    return orders.select(
        _text("src/p", k % 7, "/F", F.lpad(k.cast("string"), 12, "0"), ".java").alias("path"),
        _text(
            package, "import java.util.List;\nimport static java.lang.Math.*;\n/* class Fake { */\n",
            F.when(k % 89 == 0, enum).otherwise(body),
        ).alias("content"),
    )


def supplier_files(supplier: DataFrame, *, keep: str | None = None) -> DataFrame:
    """``path, content`` and the column ``keep``."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    return supplier.select(
        *[F.col(c) for c in [keep] if c],
        _text("src/api/S", F.lpad(s.cast("string"), 12, "0"), ".java").alias("path"),
        _text(
            "package com.api;\nimport java.io.Closeable;\npublic interface S", s, " extends N", n, ", Closeable {\n",
            "  int SIZE = 1;\n  int size();\n  default void each(int x) { if (x > 0 && x < 9) { return; } }\n}\n",
            "class T", s, " {\n  static class D { static class B { } }\n  static class E { static class B { int one() { return 1; } } }\n}\n",
        ).alias("content"),
    )


def rendered_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` for all orders and suppliers."""
    # A text is some fifty times its row: spread the narrow rows before rendering.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").repartition(tasks)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return order_files(orders).unionByName(supplier_files(supplier))
