"""Text helpers, statistics, records, sinks and corpus reading."""

import json

from pyspark.sql import functions as F

from srclens.functions import text as X
from srclens.operators import records, stats
from srclens.sources import corpus, sinks

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_decision_score_equals_substring_counts(spark):
    docs = spark.read.parquet(DOCS)
    for r in X.decision_score(docs, "text", "score").select("text", "score").collect():
        assert r["score"] == 1 + sum(r["text"].lower().count(w) for w in X.DECISION_SUBSTRINGS)


def test_decision_score_counts_without_overlap(spark):
    df = spark.createDataFrame([("&&&",), ("iffor",), ("",), (None,)], "t string")
    assert [r["s"] for r in X.decision_score(df, "t", "s").collect()] == [2, 3, 1, 1]


def test_rounding_is_half_up(spark):
    row = spark.createDataFrame([(2.125, 2.675)], "a double, b double").select(F.round("a", 2), F.round("b", 2)).first()
    assert tuple(row) == (2.13, 2.68)


def test_scalars(spark):
    df = spark.createDataFrame([("\n\t a b \r\n", "x/token123/y")], "t string, u string")
    row = df.select(X.strip(F.col("t")), X.mask_secret(F.col("u"), "token123"), X.mask_secret(F.col("u"), ""), X.mask_secret(F.col("u"), None)).first()
    assert tuple(row) == ("a b", "x/***TOKEN***/y", "x/token123/y", "x/token123/y")
    lines = ["Authentication failed, rate limit", "could not read Username", "Repository not found", "RATE LIMIT", "x"]
    found = spark.createDataFrame([(s,) for s in lines], "m string").select(X.error_class(F.col("m"))).collect()
    assert [r[0] for r in found] == ["auth", "auth", "not_found", "rate_limit", "other"]


def test_pruned_walks_arrays_maps_and_stringifies(spark):
    df = spark.sql(
        "select struct(1 as a, 2 as position, array(struct(3 as b, 4 as annotations)) as l,"
        " map('k', 'v', 'documentation', 'w') as m, date'2024-01-02' as d) as n"
    )
    out = df.select(X.pruned(F.col("n"), df.schema["n"].dataType, ["position", "annotations", "documentation"]).alias("n"))
    assert out.first()["n"].asDict(True) == {"a": 1, "l": [{"b": 3}], "m": {"k": "v"}, "d": "2024-01-02"}


def test_numbered(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100))
    got = stats.numbered(df, "g", "id").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1, 5001)) and {r["total"] for r in got} == {5000}
    assert [(r["g"], r["id"]) for r in got] == sorted((r["g"], r["id"]) for r in got)


def test_package_list_is_rows_in_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("a",)], "package string")
    assert [tuple(r) for r in stats.package_list(df).orderBy("idx").select("package", "idx", "total").collect()] == [("a", 1, 2), ("b", 2, 2)]


def _package_rows(packages):
    zero = [F.lit(0).cast("long").alias(c) for c in ("total_files", "total_interfaces", "total_methods", "total_fields")]
    score = [F.lit(1.5).alias(c) for c in ("avg_class_complexity", "rounded_sum", "score_sum")]
    return packages.select("package", F.lit(1).cast("long").alias("total_classes"), *zero, *score)


def test_more_packages_than_fit_one_value(spark):
    """150,000 packages: a count in the record, rows in the list, blocks in the prompt."""
    n = 150_000
    per_package = _package_rows(spark.range(n).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("package")))
    assert stats.metadata(per_package).first()["unique_packages"] == n
    types = spark.createDataFrame([("f", 0, "A", "class")], "path string, type_pos long, name string, kind string")
    parts = records.project_prompt(types, per_package)
    sizes = parts.agg(F.count("*"), F.max(F.length("content"))).first()
    assert sizes[0] == n // records.PACKAGES_IN_PART + 2 and sizes[1] < 12 * records.PACKAGES_IN_PART
    text = records.joined_prompt(parts).first()["messages"][1]["content"]
    shown = json.loads(text[text.index("{") : text.index("}") + 1])
    assert shown["packages"] == [f"p{i:06d}" for i in range(n)] and shown["avg_complexity"] == 1.5


def test_first_names(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "i int, name string")
    assert stats.first_names(df, "name", ["i"]).first()[0] == ", ".join(f"n{i}" for i in range(20)) + "..."
    assert stats.first_names(df.filter("i < 20"), "name", ["i"]).first()[0] == ", ".join(f"n{i}" for i in range(20))


def test_metadata_of_an_empty_corpus(spark):
    empty = spark.createDataFrame(
        [], "path string, type_pos long, name string, kind string, package string, method_count long, field_count long, avg_complexity double"
    )
    per_package = stats.package_stats(empty)
    row = stats.metadata(per_package).first()
    assert (row["total_classes"], row["total_methods"], row["unique_packages"], row["avg_class_complexity"]) == (0, 0, 0, 0.0)
    assert '"packages":[],' in records.joined_prompt(records.project_prompt(empty, per_package)).first()["messages"][1]["content"]


def test_observed(spark):
    df, seen = stats.observed(spark.range(100), "n", found=F.count("*"), kept=F.count_if(F.col("id") < 7))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"found": 100, "kept": 7}


def test_calls_are_retried(spark, tmp_path):
    requests = spark.createDataFrame([(k,) for k in ("ok", "null", "empty", "late", "never")], "request_id string").select(
        "request_id", records.messages("r", F.col("request_id")).alias("messages")
    )
    seen = {}

    def call(msgs):
        name = msgs[1]["content"]
        seen[name] = seen.get(name, 0) + 1
        if name == "never" or (name == "late" and seen[name] < 3):
            raise RuntimeError("down")
        return {"ok": "yes", "empty": "", "late": "done", "null": None}[name]

    answers = records.ask(requests, call, parallel=2)
    got = {r["request_id"]: r for r in answers.collect()}
    assert (got["ok"]["response"], got["ok"]["attempts"]) == ("yes", 1)
    assert (got["late"]["response"], got["late"]["attempts"], got["late"]["error"]) == ("done", 3, None)
    assert (got["never"]["response"], got["never"]["attempts"], got["never"]["error"]) == (None, 3, "down")
    assert (got["null"]["response"], got["null"]["attempts"]) == (None, 1)
    summary = {r["request_id"]: r["summary"] for r in records.with_summary(requests, answers).collect()}
    assert summary == {"ok": "yes", "late": "done", "empty": "Summary unavailable", "never": "Summary unavailable", "null": "Summary unavailable"}


def test_documents_and_sink(spark, tmp_path):
    shape = "path string, type_pos int, name string, package string, method_count long, extends string, implements array<string>, summary string"
    classes = spark.createDataFrame([("p", 0, "A", None, 2, None, [], "s"), ("p", 1, "B", "q", 0, "A", ["I", "J"], "t")], shape)
    faces = spark.createDataFrame([("p", 2, "I", [], 1)], "path string, type_pos int, name string, extends array<string>, method_count long")
    docs = records.documents(spark.createDataFrame([("",)], "text string"), classes, faces)
    texts = {r["metadata"].get("class_name") or r["metadata"]["interface_name"]: r["text"] for r in docs.collect()}
    assert texts == {
        "A": "Class: A\nPackage: N/A\nMethods: 2\nSummary: s",
        "B": "Class: B\nPackage: q\nMethods: 0\nSummary: t\nExtends: A\nImplements: I, J",
        "I": "Interface: I\nMethods: 1",
    }
    for _ in range(2):
        sinks.write_documents(docs, str(tmp_path / "docs"))
    stored = sinks.read_documents(spark, str(tmp_path / "docs"))
    assert stored.count() == 3 and stored.select("doc_key").distinct().count() == 3


def test_corpus_reading(spark, tmp_path):
    good = "class Ä { }".encode()
    for name, data in {
        "src/A.java": good, "src/B.JAVA": good, "src/bad.java": b"class \xff { }", "readme.md": b"x",
        ".mvn/wrapper/W.java": good, "_gen/G.java": good, ".mvn/_deep/D.java": good, "src/_h.java": good,
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    names = lambda df: sorted(r["path"].split(str(tmp_path) + "/")[1] for r in df.select("path").collect())
    assert len(names(corpus.corpus_files(spark, str(tmp_path)))) == 8
    java = corpus.corpus_files(spark, str(tmp_path), [".java"])
    assert names(java) == [".mvn/_deep/D.java", ".mvn/wrapper/W.java", "_gen/G.java", "src/A.java", "src/_h.java", "src/bad.java"]
    assert len(names(corpus.corpus_files(spark, str(tmp_path), [".java", ".md"]))) == 7
    read = corpus.read_text(java)
    assert names(read.filter("reason = 'encoding'")) == ["src/bad.java"]
    assert read.filter("reason is null").select("content").distinct().collect()[0][0] == "class Ä { }"


def test_json_keeps_nulls_and_letters(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":"é","b":null}'


def test_written_tables_are_dropped(spark, tmp_path, monkeypatch):
    from srclens import session

    monkeypatch.setattr(session, "_MADE", [])
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    kept = session.written(spark.range(3), "three")
    assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    session.drop_written(spark)
    assert not list(tmp_path.iterdir())
