"""Registered queries. Each takes (spark, sf_dir), reads whole tables, returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.functions import text as X
from srclens.operators import chunks, records, stats, vectors
from srclens.operators import declarations as D
from srclens.session import new_path, written
from srclens.sources import corpus, increments, sinks, vector_store
from srclens.sources.rendered import order_files, rendered_corpus, supplier_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Stands for a secret in the masking query; part of some page addresses.
SECRET = "utm_source"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.declarations(rendered_corpus(spark, sf_dir))


def _joined(col: str, sep: str = ",") -> F.Column:
    return F.array_join(col, sep).alias(col)


def _score(col: str = "avg_complexity") -> F.Column:
    return F.round(col, 6).alias(col)


# --- sources and sinks -------------------------------------------------------


@query
def scanned_corpus(spark, sf_dir):
    """Files on disk, hidden folders among them, to types and rejects.

    The rendered supplier files are written one by one as text; every third lies in a hidden folder and
    every tenth is no UTF-8.
    """
    key = F.col("s_suppkey")
    bad = F.when(key % 10 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    # A row becomes a file: the few blocks of the narrow table are no measure of that work.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    supplier = table(spark, sf_dir, "supplier").repartition(tasks, "s_suppkey")
    texts = supplier_files(supplier, keep="s_suppkey").select(
        "s_suppkey", F.concat(F.col("content").cast("binary"), bad).cast("string").alias("value")
    )
    root = new_path(spark, "files")
    for folder, which in (("src/main", key % 3 != 0), (".mvn/wrapper", key % 3 == 0)):
        # tasks move their files into the new folder themselves, not the driver one by one
        out = texts.filter(which).select("value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        out.option("maxRecordsPerFile", 1).text(f"{root}/{folder}")
    read = corpus.read_text(corpus.corpus_files(spark, root, [".txt"]))
    read = written(read, "read")
    types = D.types(D.declarations(read.filter("reason is null")))
    found = types.select("kind", "name", "method_count", "field_count")
    return found.unionByName(D.rejects(read).groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("method_count")), allowMissingColumns=True)


@query
def suffix_filter(spark, sf_dir):
    """Case-sensitive suffix list, prefix and substring tests."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter(X.has_suffix(url, [".html", "/", "#top"])).select(
        "page_id",
        "url",
        F.startswith(url, F.lit("https://")).alias("is_https"),
        F.contains(url, F.lit("example.com")).alias("is_com"),
        X.file_name(url).alias("file_name"),
    )


@query
def files_matched(spark, sf_dir):
    """A1: paths matched and paths in all."""
    return corpus.match_counts(table(spark, sf_dir, "pages"), "url", [".html"])


@query
def utf8_rejects(spark, sf_dir):
    """S3: strict UTF-8; every 50th text has a byte that is no UTF-8."""
    broken = F.when(F.col("doc_id") % 50 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("path"), F.concat(F.col("text").cast("binary"), broken).alias("content")
    )
    return corpus.read_text(raw).select("path", "reason", F.char_length("content").cast("long").alias("n_chars"))


@query
def snapshot_reuse(spark, sf_dir):
    """The second write keeps what is there, the forced one replaces it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = new_path(spark, "snapshot")
    corpus.snapshot(pages.withColumn("version", F.lit(1)), path)
    kept = written(corpus.snapshot(pages.withColumn("version", F.lit(2)), path), "kept")
    replaced = corpus.snapshot(pages.withColumn("version", F.lit(3)), path, force=True)
    return kept.select("page_id", F.col("version").alias("kept")).join(
        replaced.select("page_id", F.col("version").alias("replaced")), "page_id"
    )


def corpus_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the rendered corpus: between them a third of the order files is added,
    a fifth of the older ones changes (another customer) and a thirteenth goes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    supplier = table(spark, sf_dir, "supplier")
    old = order_files(orders.filter(k % 3 != 0).withColumn("o_custkey", F.when(k % 5 == 0, c + 1).otherwise(c)))
    new = order_files(orders.filter(k % 13 != 0))
    return old.unionByName(supplier_files(supplier)), new.unionByName(supplier_files(supplier))


@query
def changed_snapshot(spark, sf_dir):
    """Classes of a snapshot brought from the first version of the corpus to the second by its changes only."""
    old, new = corpus_versions(spark, sf_dir)
    root = new_path(spark, "increments")
    increments.refresh(spark, root, old, D.declarations)
    increments.refresh(spark, root, new, D.declarations)
    return D.types(increments.current(spark, root)).filter("kind = 'class'").select(
        "path", "name", "package", _joined("modifiers"), _joined("extends"), _joined("implements"),
        "method_count", "field_count", _score(),
    )


@query
def json_round_trip(spark, sf_dir):
    """JSON lines with nulls and non-ASCII text kept, read back."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    path = new_path(spark, "json")
    shape = docs.select("doc_id", F.struct("text", "lang", F.struct("quality", "toxic").alias("label")).alias("body"))
    sinks.write_json(shape, path)
    lines = spark.read.text(path)
    record = F.from_json("value", shape.schema)
    return lines.select(
        record["doc_id"].alias("doc_id"),
        F.sha2(record["body"]["text"], 256).alias("text_hash"),
        record["body"]["label"]["quality"].alias("quality"),
        F.contains("value", F.lit('"quality":null')).alias("null_kept"),
    )


@query
def document_sink(spark, sf_dir):
    """Documents by type; writing the same snapshot twice does not double it."""
    docs = _part_documents(spark, sf_dir)
    path = new_path(spark, "documents")
    sinks.write_documents(docs, path)
    sinks.write_documents(docs, path)
    return sinks.read_documents(spark, path).groupBy("type").agg(
        F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min("doc_key").alias("first_key")
    )


@query
def knowledge_sections(spark, sf_dir):
    """The nested result as JSON lines, written and read back by content."""
    types = written(D.types(_decls(spark, sf_dir), nested=True), "types")
    per_package = written(stats.package_stats(types), "package-stats")
    classes = records.class_records(types)
    answers = classes.filter(F.col("method_count") > 1).select("request_id", F.concat(F.lit("About "), "name").alias("response"))
    overview = stats.project_summary(per_package).select(records.overview_text(F.lit("")).alias("text"))
    doc = sinks.knowledge_document(
        stats.metadata(per_package).drop("extraction_date"), stats.distinct_packages(per_package), overview,
        records.with_summary(classes, answers), records.interface_records(types),
    )
    path = new_path(spark, "knowledge")
    sinks.write_json(doc, path)
    lines = spark.read.schema("section string, body string").json(path)
    at = lambda name: F.get_json_object("body", f"$.{name}")
    counts = F.concat(F.lit("classes "), at("total_classes"), F.lit(" interfaces "), at("total_interfaces"), F.lit(" packages "), at("unique_packages"))
    extends = F.array_join(F.from_json(at("extends"), "array<string>"), ",")
    return lines.select(
        "section",
        F.when(F.col("section") == "packages", at("package")).otherwise(at("name")).alias("name"),
        F.when(F.col("section") == "metadata", counts)
        .when(F.col("section") == "classes", at("summary"))
        .when(F.col("section") == "interfaces", extends)
        .when(F.col("section") == "project_overview", at("text")).alias("detail"),
        F.coalesce(F.json_array_length(at("methods")), at("total_methods").cast("int")).cast("long").alias("methods"),
        F.coalesce(at("avg_complexity"), at("avg_class_complexity")).cast("double").alias("score"),
    )


@query
def knowledge_flow(spark, sf_dir):
    """Prompts, calls, summaries, overview and documents in one flow."""
    types = written(D.types(_decls(spark, sf_dir), nested=True), "types")
    per_package = written(stats.package_stats(types), "package-stats")
    classes = written(records.class_records(types), "classes")
    answers = written(records.ask(records.class_prompts(classes), _stub), "responses")
    asked = records.joined_prompt(records.project_prompt(types, per_package))
    overview = written(records.ask(asked, _overview_stub), "overview").select(records.overview_text(F.col("response")).alias("text"))
    docs = records.documents(overview, records.with_summary(classes, answers.select("request_id", "response")), records.interface_records(types))
    return docs.select("type", F.coalesce(F.col("metadata")["class_name"], F.col("metadata")["interface_name"]).alias("name"), "text")


# --- declaration extraction on the rendered corpus ---------------------------


@query
def package_of_file(spark, sf_dir):
    """E1."""
    return D.packages(_decls(spark, sf_dir))


@query
def imports_of_file(spark, sf_dir):
    """E2."""
    return D.imports(_decls(spark, sf_dir)).select("path", _joined("imports"))


@query
def class_declarations(spark, sf_dir):
    """Classes, nested ones included."""
    return D.types(_decls(spark, sf_dir)).filter("kind = 'class'").select(
        "path", "name", "package", _joined("modifiers"), _joined("extends"), _joined("implements"),
        "method_count", "field_count", _score(),
    )


@query
def interface_declarations(spark, sf_dir):
    """E4, E6."""
    return D.types(_decls(spark, sf_dir)).filter("kind = 'interface'").select(
        "path", "name", _joined("extends"), "method_count", "field_count", _score()
    )


@query
def direct_members(spark, sf_dir):
    """E7 with ``recursive=False``: only what a type declares itself."""
    return D.types(_decls(spark, sf_dir), recursive=False).select("path", "name", "method_count", "field_count")


@query
def method_declarations(spark, sf_dir):
    """Methods of every type that holds them."""
    args = F.array_join(F.transform("parameters", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ",")
    return D.methods(_decls(spark, sf_dir)).select(
        "path", "type_name", "name", "signature", _joined("modifiers"), "return_type", args.alias("parameters"), "complexity"
    )


@query
def field_declarations(spark, sf_dir):
    """One row per declared variable."""
    return D.fields(_decls(spark, sf_dir)).select("path", "type_name", "name", "type", _joined("modifiers"))


@query
def rejected_files(spark, sf_dir):
    """E14."""
    return D.rejects(rendered_corpus(spark, sf_dir))


@query
def retained_files(spark, sf_dir):
    """files with at least one class or interface."""
    return stats.retained(D.types(_decls(spark, sf_dir)))


@query
def type_relations(spark, sf_dir):
    """Inheritance edges, with the file that declares the parent if there is one."""
    types = written(D.types(_decls(spark, sf_dir)), "types")
    found = types.groupBy(F.col("name").alias("parent")).agg(F.min("path").alias("parent_path"))
    return D.edges(types).join(found, "parent", "left").select("path", "child", "relation", "parent", "parent_path")


@query
def corpus_statistics(spark, sf_dir):
    """A2, A3, A4, U1."""
    return stats.corpus_stats(D.types(_decls(spark, sf_dir)))


@query
def package_statistics(spark, sf_dir):
    """A2 to A4, A7, A8 per package."""
    return stats.package_stats(D.types(_decls(spark, sf_dir))).drop("score_sum", "rounded_sum")


@query
def project_metadata(spark, sf_dir):
    """A4, A8, A9, A11."""
    per_package = written(stats.package_stats(D.types(_decls(spark, sf_dir))), "package-stats")
    return stats.project_summary(per_package).select(
        "total_classes", "total_interfaces", "total_methods", "unique_packages",
        "avg_class_complexity", F.round("avg_complexity", 6).alias("avg_complexity"),
    )


@query
def class_packages(spark, sf_dir):
    """Package of the first file that holds a class of that name."""
    types = written(D.types(_decls(spark, sf_dir)).filter("kind = 'class'"), "types")
    found = stats.first_match(types.drop("package"), "name", types, "name", "package", "path", X.NO_PACKAGE)
    return found.select("path", "name", "package")


@query
def class_requests(spark, sf_dir):
    """One prompt per class."""
    types = D.types(_decls(spark, sf_dir), nested=True)
    asked = records.class_prompts(records.class_records(types))
    return asked.select(
        "path", "name", F.element_at("messages", 1)["content"].alias("role_text"), F.element_at("messages", 1)["role"].alias("role"),
        F.element_at("messages", 2)["content"].alias("prompt"),
    )


@query
def project_request(spark, sf_dir):
    """The project prompt, its statistics parsed back."""
    types = written(D.types(_decls(spark, sf_dir)), "types")
    per_package = written(stats.package_stats(types), "package-stats")
    parts = records.project_prompt(types, per_package)
    # Read from the ordered parts with one aggregate: no value holds all packages, no task all parts.
    first, last = F.col("part") == 0, F.col("part") == 2**62
    listed = F.json_array_length(F.concat(F.lit("["), F.regexp_replace("content", "^,", ""), F.lit("]")))
    found = parts.agg(
        F.max(F.when(first, F.regexp_extract("content", r'"total_classes":(-?[0-9]+)', 1))).alias("tc"),
        F.max(F.when(first, F.regexp_extract("content", r'"total_methods":(-?[0-9]+)', 1))).alias("tm"),
        F.coalesce(F.sum(F.when(~first & ~last, listed)), F.lit(0)).alias("n_packages"),
        F.max(F.when(last, F.regexp_extract("content", r'"avg_complexity":([^}]*)\}', 1))).alias("avg"),
        F.max(F.when(last, F.regexp_extract("content", r"Class names: ([^\n]*)", 1))).alias("class_names"),
    )
    return found.select(
        F.col("tc").cast("long").alias("total_classes"),
        F.col("tm").cast("long").alias("total_methods"),
        F.col("n_packages").cast("long").alias("n_packages"),
        F.round(F.col("avg").cast("double"), 6).alias("avg_complexity"),
        "class_names",
    )


@query
def corpus_documents(spark, sf_dir):
    """V1 to V3, U2, J2, M4 on the rendered corpus: text documents of classes and interfaces."""
    types = written(D.types(_decls(spark, sf_dir), nested=True), "types")
    classes = records.class_records(types)
    answers = classes.filter(F.col("method_count") > 1).select("request_id", F.concat(F.lit("About "), "name").alias("response"))
    summed = records.with_summary(classes, answers)
    overview = types.agg(F.count("*")).select(records.overview_text(F.lit("")).alias("text"))
    docs = records.documents(overview, summed, records.interface_records(types))
    return docs.select(
        "type",
        "text",
        F.coalesce(F.col("metadata")["class_name"], F.col("metadata")["interface_name"]).alias("name"),
        F.col("metadata")["package"].alias("package"),
    )


# --- the same operators on plain tables --------------------------------------


def _part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classes, suppliers as interfaces."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("path"),
        F.lit(0).alias("type_pos"),
        F.col("p_name").alias("name"),
        F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("package"),
        F.col("p_size").cast("long").alias("method_count"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("extends"),
        F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("implements"),
        F.when(F.col("p_size") > 25, F.col("p_type")).when(F.col("p_size") > 10, "").alias("response"),
    )
    summed = part.withColumn("summary", X.or_default(F.col("response"), X.NO_SUMMARY))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("path"),
        F.lit(0).alias("type_pos"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 7).alias("method_count"),
        F.when(F.col("s_nationkey") > 12, F.array(F.lit("A"), F.col("s_nationkey").cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("extends"),
    )
    overview = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project"), F.col("r_name").alias("text"))
    return records.documents(overview, summed, supplier)


@query
def table_documents(spark, sf_dir):
    """V1 to V3, U2, F6, F7, C3, C9 on part, supplier and region."""
    m = F.col("metadata")
    return _part_documents(spark, sf_dir).select(
        "doc_key", "type", "text", m["class_name"].alias("class_name"), m["interface_name"].alias("interface_name"), m["package"].alias("package")
    )


@query
def decision_scores(spark, sf_dir):
    """E13 in substring mode, C1, C2: whole texts."""
    return X.decision_score(table(spark, sf_dir, "documents"), "text", "score").select("doc_id", "score")


@query
def source_scores(spark, sf_dir):
    """A8 and A9 on documents: mean of rounded source means, and mean of plain ones."""
    scored = X.decision_score(table(spark, sf_dir, "documents"), "text", "score")
    per_source = scored.groupBy("source").agg(F.avg("score").alias("mean"))
    return per_source.agg(
        F.round(F.avg(F.round("mean", 2)), 2).alias("avg_rounded"), F.round(F.avg("mean"), 6).alias("avg_plain")
    )


@query
def named_sources(spark, sf_dir):
    """Distinct non-empty names."""
    docs = table(spark, sf_dir, "documents").withColumn("package", F.when(F.col("lang") == "en", F.col("source")).otherwise(""))
    return stats.distinct_packages(docs)


@query
def source_list(spark, sf_dir):
    """The sorted list as numbered rows, with its size."""
    return stats.package_list(table(spark, sf_dir, "documents"), "source").select(
        "package", F.col("idx").cast("long").alias("idx"), F.col("total").cast("long").alias("total")
    )


@query
def pruned_records(spark, sf_dir):
    """Nested records without the named keys, timestamps as text."""
    events = table(spark, sf_dir, "events")
    node = F.struct(
        "event_type",
        F.col("ts").alias("position"),
        F.struct(F.from_json("props", "k int").alias("props"), F.lit("x").alias("documentation"), "value").alias("inner"),
        F.array(F.struct("user_id", F.lit(1).alias("annotations"))).alias("children"),
    )
    shaped = events.select("event_id", node.alias("node"))
    drop = ["position", "documentation", "annotations"]
    clean = shaped.select("event_id", X.pruned(F.col("node"), shaped.schema["node"].dataType, drop).alias("node"))
    return clean.select("event_id", X.json_text(F.col("node").dropFields("inner")).alias("outer"),
                        F.col("node.inner.props.k").alias("k"), F.col("node.inner.value").alias("value"))


@query
def masked_urls(spark, sf_dir):
    """A secret in addresses reads as the mask."""
    return table(spark, sf_dir, "pages").select("page_id", X.mask_secret(F.col("url"), SECRET).alias("url"))


@query
def error_classes(spark, sf_dir):
    """Log lines built from events, classed by the first mark that matches."""
    events = table(spark, sf_dir, "events")
    line = (
        F.when(F.col("event_type") == "error", F.format_string("fatal: Authentication failed for %d, Repository not found", "user_id"))
        .when(F.col("event_type") == "view", F.format_string("remote: Repository not found %d", "user_id"))
        .when(F.col("event_type") == "click", F.format_string("API Rate Limit exceeded %d", "user_id"))
        .otherwise(F.col("event_type"))
    )
    return events.select(X.error_class(line).alias("error_class"), "value").groupBy("error_class").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query
def scalar_texts(spark, sf_dir):
    """C4, C8, C11, C12, C14 and F5 on orders."""
    orders = table(spark, sf_dir, "orders")
    padded = F.concat(F.lit("\n\t "), "o_orderpriority", F.lit(" \r\n"))
    return orders.select(
        "o_orderkey",
        X.strip(padded).alias("priority"),
        F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8).alias("short_hash"),
        X.iso_timestamp(F.col("o_orderdate")).alias("date"),
        F.round(F.col("o_totalprice") / 7, 2).alias("price"),
        X.file_name(F.concat_ws("/", F.lit("src"), "o_orderstatus", F.concat("o_orderkey", F.lit(".java")))).alias("file_name"),
        X.or_default(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), X.NO_PACKAGE).alias("status"),
    )


@query
def commit_summaries(spark, sf_dir):
    """A10: orders of a customer as the commits of a repository."""
    out = stats.commit_summary(
        table(spark, sf_dir, "orders"),
        "o_custkey", "o_orderdate", "o_orderkey",
        F.sha2(F.col("o_orderkey").cast("string"), 256), F.col("o_orderpriority"), X.strip(F.concat(F.lit(" "), "o_orderstatus")),
    )
    c = F.col("latest_commit")
    return out.select("o_custkey", "commit_count", c["hash"].alias("hash"), c["author"].alias("author"),
                      c["message"].alias("message"), X.iso_timestamp(c["date"]).alias("date"))


@query
def first_match_lookup(spark, sf_dir):
    """J1 on part: brand of the first part with that name; unknown names get the default."""
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.when(F.col("p_size") == 1, F.lit("?")).otherwise(F.col("p_name")).alias("p_name"))
    return stats.first_match(asked, "p_name", part, "p_name", "p_brand", "p_partkey", X.NO_PACKAGE).select(
        "p_partkey", "p_name", "p_brand"
    )


@query
def summaries_attached(spark, sf_dir):
    """Labels as responses; null and empty ones read as the default."""
    answer = F.when(F.col("quality") == 1, F.concat(F.lit("toxic "), F.col("toxic").cast("string"))).otherwise("")
    answers = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"), answer.alias("response"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "source")
    return records.with_summary(docs, answers).select("request_id", "source", "summary")


@query
def numbered_documents(spark, sf_dir):
    """Idx and total over all documents."""
    return stats.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id").select(
        "doc_id", F.col("idx").cast("long").alias("idx"), F.col("total").cast("long").alias("total")
    )


@query
def first_part_names(spark, sf_dir):
    """The first names in one text, dots when there are more."""
    return stats.first_names(table(spark, sf_dir, "part"), "p_name", ["p_partkey"])


@query
def model_requests(spark, sf_dir):
    """M1 on conversations: system and user message, prompt as JSON."""
    turns = table(spark, sf_dir, "conversations")
    prompt = F.concat(F.lit("Analyze:\n\n"), X.json_text(F.struct("conv_id", "turn", "role")), F.lit("\n\n"), "text")
    asked = turns.select("conv_id", "turn", records.messages("Be brief.", prompt).alias("messages"))
    return asked.select(
        "conv_id", "turn", F.size("messages").cast("long").alias("n"),
        F.element_at("messages", 1)["content"].alias("system"), F.element_at("messages", 2)["content"].alias("prompt"),
    )


def _stub(msgs: list[dict]) -> str:
    """Deterministic model: its memory is the text length; multiples of 5 always fail."""
    size = len(msgs[1]["content"])
    if size % 5 == 0:
        raise ValueError("no answer")
    return "" if size % 7 == 0 else f"{size} characters"


def _overview_stub(msgs: list[dict]) -> str:
    import json
    import re

    shown = json.loads(re.search(r"\{.*?\}", msgs[1]["content"], re.S).group())
    return f"Overview of {shown['total_classes']} classes"


@query
def model_calls(spark, sf_dir):
    """M3, M4: batch calls through a caller's function, failures retried, defaults filled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", records.request_id(F.col("doc_id")).alias("request_id"), "text")
    asked = docs.select("request_id", records.messages("Count.", F.col("text")).alias("messages"))
    answers = written(records.ask(asked, _stub), "responses")
    return records.with_summary(docs.drop("text"), answers).select("doc_id", "summary", F.col("attempts").cast("long").alias("attempts"), "error")


@query
def fixed_chunks(spark, sf_dir):
    """M5: fixed stride."""
    return chunks.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk"
    )


@query
def separator_chunks(spark, sf_dir):
    """M5: cut at preferred separators."""
    return chunks.separator_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def separator_chunk_facts(spark, sf_dir):
    """M5: what holds for the chunks of any text: parts of it, from its start to its end, none too long to cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = chunks.separator_chunks(docs, "doc_id", "text").join(docs, "doc_id")
    whole = X.strip(F.col("text"))
    fits = (F.char_length("chunk") <= chunks.CHUNK_SIZE) | ~F.contains("chunk", F.lit(" "))
    return cut.groupBy("doc_id").agg(
        F.every(F.contains("text", F.col("chunk"))).alias("inside"),
        F.every(fits).alias("fits"),
        F.every((F.col("chunk_idx") > 0) | F.startswith(whole, F.col("chunk"))).alias("begins"),
        F.max_by(F.endswith(whole, F.col("chunk")), "chunk_idx").alias("ends"),
    )


@query
def embedded_documents(spark, sf_dir):
    """V4: built-in embedding of whole texts."""
    return vectors.embed_tfidf(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select(
        "doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm")
    )


def _vowels(texts: list[str]):
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


@query
def embedded_by_function(spark, sf_dir):
    """V4: a caller's batch function, here letter counts."""
    e = F.col("embedding")
    return vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _vowels).select(
        "doc_id", *[e[i].cast("long").alias(f"n_{c}") for i, c in enumerate("aeiou")]
    )


@query
def nearest_vectors(spark, sf_dir):
    """The five nearest to one query, the vector with the smallest id."""
    emb = table(spark, sf_dir, "embeddings")
    target = emb.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    return vectors.nearest(emb, target).select("vec_id", F.round("distance", 6).alias("distance"))


@query
def batch_nearest(spark, sf_dir):
    """V6 exact: the five nearest of every vector."""
    emb = table(spark, sf_dir, "embeddings")
    return vectors.batch_nearest(emb, emb).select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")
    )


@query
def batch_nearest_blocks(spark, sf_dir):
    """V6 exact, queries joined in blocks as when they are too many to ship."""
    emb = table(spark, sf_dir, "embeddings")
    return vectors.batch_nearest(emb, emb, broadcast_bytes=0).select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")
    )


@query
def list_nearest(spark, sf_dir):
    """V6 approximate: k-means lists. What is sure of each query: its hits, the first one, and their distances."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = written(vectors.list_nearest(emb, emb), "hits")
    sides = hits.join(emb, "vec_id").join(emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    right = F.abs(F.col("distance") - vectors.squared_distance(F.col("embedding"), F.col("q"))) < 1e-9
    return sides.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rank").cast("long").alias("last_rank"), F.min("distance").alias("nearest"), F.every(right).alias("right")
    )


def _by_vowels(df: DataFrame, text: str) -> DataFrame:
    return vectors.embed(df, text, _vowels)


@query
def search_documents(spark, sf_dir):
    """Benchmark texts as queries over a stored index of the documents, by vowel counts.

    The store is written once (documents embedded, lists fitted); the search embeds the queries only
    and reads the partitions of the lists it cannot rule out.
    """
    path = new_path(spark, "store")
    vector_store.build(_part_documents(spark, sf_dir), path, _by_vowels)
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = vector_store.search(spark, path, asked, _by_vowels, query_id_col="item_id")
    return found.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_key", "distance", "text", F.col("metadata")["type"].alias("type"))


@query
def pruned_nearest(spark, sf_dir):
    """V6 exact with pruning: the five nearest of every vector from a stored index, reading only the lists
    that the radius of each list and the distance to its centre cannot rule out (ids are not negative)."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    key = F.lpad(F.col("vec_id").cast("string"), 20, "0")
    path = new_path(spark, "vector-store")
    docs = emb.select(key.alias("doc_key"), F.lit(None).cast("string").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), "embedding")
    vector_store.build(docs, path, None)
    found = vector_store.search(spark, path, emb.select(F.col("vec_id").alias("query_id"), "embedding"), None)
    return found.select(
        "query_id", F.col("doc_key").cast("long").alias("vec_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")
    )


@query
def list_nearest_all_probed(spark, sf_dir):
    """V6: with every list probed the approximate search is exact."""
    emb = table(spark, sf_dir, "embeddings")
    return vectors.list_nearest(emb, emb, lists=8, probe=8).select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")
    )


@query
def progress_counters(spark, sf_dir):
    """B1: found and kept documents, counted while they are written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    seen, counters = stats.observed(docs, "progress", found=F.count("*"), kept=F.count_if(F.col("lang") == "en"))
    written(seen, "observed")
    got = counters.get
    return spark.range(1).select(F.lit(got["found"]).cast("long").alias("found"), F.lit(got["kept"]).cast("long").alias("kept"))
