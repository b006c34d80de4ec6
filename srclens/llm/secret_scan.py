"""Operator 8, secret scans, DataFrame functions only.

Base spans of three kinds are found in each whole text (an assigned value, an access identifier,
a long hexadecimal run). Two weak kinds are added by multipart credential linking: alone they
mean little, so they are reported only near a complementary part.

* ``weak``: a run of 20 or more token characters with a digit, an upper and a lower case
  letter, or an assignment whose value is too short for the base kind; needs an access identifier.
* ``endpoint``: a web address; needs an access identifier or an assigned value.

Each complementary part opens a scope, the interval of ``SCOPE`` code points before and
after it. Weak parts are interval-joined to the scopes: both sides are placed in
bins of the text as wide as a scope, so a part meets the few scopes of its own bin only, and a
left semi join asks whether one covers it; pairs are never emitted. Rows without
both sides are filtered out before, and only positions are shuffled.

Positions are code points, ends exclusive. Defined results: a null text counts as empty and has
no spans; a repeated row is reported for each repetition; null ids are kept; an empty table
gives an empty result. Only the id and text columns are read, other columns pass through ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import row_key, table
from srclens.session import written

SCOPE, BLOCK = 300, 256
LEAST_VALUE = 12
MASK = "[secret]"

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs are maximal, so shorter ones cannot hide a longer one
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "weak", "endpoint")
_SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """``start, end, value`` of all leftmost matches that do not overlap, in code points.

    The pieces between the matches give their places. Places are summed up in blocks of ``BLOCK``
    matches, so that growing the result does not copy it once for each match of a long text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    parts = F.filter(
        F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("n"), m.alias("value"))),
        lambda x: x["value"].isNotNull(),
    )
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    step = lambda acc, x: state(
        acc["at"] + x["gap"] + x["n"],
        F.concat(
            acc["out"],
            F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"))),
        ),
    )
    none = F.array().cast(_SPAN)
    in_blocks = F.transform(
        F.array(parts), lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(BLOCK)), lambda i: F.slice(p, i, F.lit(BLOCK)))
    )[0]
    placed = F.aggregate(
        in_blocks,
        state(F.lit(0), F.array().cast(f"array<{_SPAN}>")),
        # the block is placed once and bound by the inner fold over one value
        lambda acc, block: F.aggregate(
            F.array(F.aggregate(block, state(acc["at"], none), step)), acc, lambda a, done: state(done["at"], F.concat(a["out"], F.array(done["out"])))
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(none)


def _long(value: Column) -> Column:
    return F.char_length(F.regexp_extract(value, ASSIGN, 1)) >= LEAST_VALUE


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rk, doc_id, assign, access, hex, short, token, endpoint``: places of base spans and of weak ones not yet confirmed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        row_key(F.col(id_col), text).alias("rk"),
        F.col(id_col).alias("doc_id"),
        matches(text, ASSIGN).alias("a"),
        matches(text, ACCESS).alias("k"),
        matches(text, HEX).alias("h"),
        matches(text, TOKEN).alias("t"),
        matches(text, ENDPOINT).alias("u"),
    )
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
    return found.select(
        "rk",
        "doc_id",
        _places(F.filter("a", lambda x: _long(x["value"]))).alias("assign"),
        _places(F.col("k")).alias("access"),
        _places(F.col("h")).alias("hex"),
        _places(F.filter("a", lambda x: ~_long(x["value"]))).alias("short"),
        _places(F.filter("t", mixed)).alias("token"),
        _places(F.col("u")).alias("endpoint"),
    )


_KEYS = ("rk", "id_text")


def _placed_in(spans: DataFrame, low: Column, high: Column, scope: int) -> DataFrame:
    """One row for each bin of the text that an interval touches."""
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))))


def _same_bin(left: DataFrame, right: DataFrame) -> list[Column]:
    return [left["rk"] == right["rk"], left["id_text"].eqNullSafe(right["id_text"]), left["bin"] == right["bin"]]


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``rk, id_text, extra``: the weak spans that a complementary part confirms."""
    rows = found.select("rk", F.col("doc_id").cast("string").alias("id_text"), "assign", "access", "hex", "short", "token", "endpoint")
    rows = rows.filter("(size(access) > 0 and size(short) + size(token) + size(endpoint) > 0) or (size(assign) > 0 and size(endpoint) > 0)")
    tagged = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    spans = lambda *kinds: rows.select(*_KEYS, F.inline(F.concat(*map(tagged, kinds))))

    # tokens that overlap a base span or an address are that span
    tokens = _placed_in(spans("token"), F.col("start"), F.col("end") - 1, scope)
    busy = _placed_in(spans("assign", "access", "hex", "endpoint"), F.col("start"), F.col("end") - 1, scope)
    overlap = (tokens["start"] < busy["end"]) & (busy["start"] < tokens["end"])
    taken = tokens.join(busy, [*_same_bin(tokens, busy), overlap], "left_semi").select(*_KEYS, "kind", "start").distinct()
    weak = spans("short", "token", "endpoint")
    same = [weak["rk"] == taken["rk"], weak["id_text"].eqNullSafe(taken["id_text"]), weak["kind"] == taken["kind"], weak["start"] == taken["start"]]
    candidates = weak.join(taken, same, "left_anti").withColumn("bin", F.floor(F.col("start") / scope))

    opened = spans("access", "assign").select(
        *_KEYS, F.col("kind").alias("by"), (F.col("start") - scope).alias("low"), (F.col("end") + scope).alias("high")
    )
    scopes = _placed_in(opened, F.col("low"), F.col("high"), scope)
    covers = (candidates["start"] >= scopes["low"]) & (candidates["end"] <= scopes["high"])
    complementary = (scopes["by"] == "access") | (candidates["kind"] == "endpoint")
    confirmed = candidates.join(scopes, [*_same_bin(candidates, scopes), covers, complementary], "left_semi")
    kind = F.when(F.col("kind") == "endpoint", "endpoint").otherwise("weak").alias("kind")
    return confirmed.groupBy(*_KEYS).agg(F.collect_set(F.struct(kind, "start", "end")).alias("extra"))  # of one text


def _listed(*kinds: str) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    tag = lambda n: lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("n"), x["end"].alias("end"))
    tagged = [F.transform(k, tag(n)) for n, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", F.get(names, x["n"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``rk, doc_id`` and the confirmed places of each of the five kinds, for every row."""
    found = written(parts(docs, id_col, text_col), "parts")
    extra = linked(found, scope).withColumnRenamed("rk", "__rk")
    same = (F.col("rk") == F.col("__rk")) & F.col("doc_id").cast("string").eqNullSafe(F.col("id_text"))
    of = lambda kind: F.coalesce(_places(F.filter("extra", lambda x: x["kind"] == kind)), F.array().cast("array<struct<start:int,end:int>>"))
    return found.join(extra, same, "left").select("rk", "doc_id", "assign", "access", "hex", of("weak").alias("weak"), of("endpoint").alias("endpoint"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """All rows and columns; every secret in the text gives way to ``mask``.

    Spans that overlap are one secret. Web addresses stay unless they overlap one.
    The length column, if it is there, counts the new text.
    """
    secret = F.array_sort(F.concat("assign", "access", "hex", "weak"))
    found = scan(docs, id_col, text_col).select(F.col("rk").alias("__rk"), F.col("doc_id").alias("__id"), secret.alias("__spans"))
    found = written(found.filter("size(__spans) > 0").distinct(), "secrets")
    same = (row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))) == F.col("__rk")) & F.col(id_col).eqNullSafe(F.col("__id"))
    text = F.col(text_col)
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    cleaned = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when((x["start"] < acc["at"]), acc["out"]).otherwise(F.concat(acc["out"], piece(acc["at"], x["start"]), F.lit(mask))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.char_length(text))),
    )
    joined = docs.join(found, same, "left")
    hit = F.col("__spans").isNotNull()
    joined = joined.withColumn(text_col, F.when(hit, cleaned).otherwise(text))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        joined = joined.withColumn(length_col, F.when(hit, F.char_length(text).cast(kind)).otherwise(F.col(length_col)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_listed("assign", "access", "hex"), 256).alias("base_sha256"),
        _listed(*KINDS).alias("spans"),
    )


def _sql_matches(pattern: str) -> str:
    """DuckDB: matches with their places, as a list of structs."""
    quoted = pattern.replace("'", "''")
    return (
        f"list_transform(range(1, len(regexp_extract_all(t, '{quoted}')) + 1), lambda i: struct_pack("
        f"s := list_sum(list_transform(regexp_split_to_array(t, '{quoted}')[1:i], lambda x: length(x)))"
        f" + coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[1:i - 1], lambda x: length(x))), 0),"
        f" v := regexp_extract_all(t, '{quoted}')[i]))"
    )


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
m AS (
    SELECT r, 'assign' kind, unnest({_sql_matches(ASSIGN)}) x FROM d UNION ALL
    SELECT r, 'access', unnest({_sql_matches(ACCESS)}) FROM d UNION ALL
    SELECT r, 'hex', unnest({_sql_matches(HEX)}) FROM d UNION ALL
    SELECT r, 'token', unnest({_sql_matches(TOKEN)}) FROM d UNION ALL
    SELECT r, 'endpoint', unnest({_sql_matches(ENDPOINT)}) FROM d),
p AS (SELECT r, kind, CAST(x.s AS BIGINT) s, CAST(x.s + length(x.v) AS BIGINT) e, x.v v,
             kind = 'assign' AND length(regexp_extract(x.v, '{ASSIGN.replace("'", "''")}', 1)) < {LEAST_VALUE} short FROM m),
base AS (SELECT r, kind, s, e FROM p WHERE kind IN ('assign', 'access', 'hex') AND NOT short),
weak AS (
    SELECT r, 'weak' kind, s, e FROM p WHERE short UNION ALL
    SELECT r, 'weak', s, e FROM p WHERE kind = 'token' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
        AND NOT EXISTS (SELECT 1 FROM (SELECT r, s, e FROM base UNION ALL SELECT r, s, e FROM p WHERE kind = 'endpoint') b
                        WHERE b.r = p.r AND p.s < b.e AND b.s < p.e) UNION ALL
    SELECT r, 'endpoint', s, e FROM p WHERE kind = 'endpoint'),
extra AS (
    SELECT w.* FROM weak w WHERE EXISTS (
        SELECT 1 FROM base b WHERE b.r = w.r AND (b.kind = 'access' OR (b.kind = 'assign' AND w.kind = 'endpoint'))
            AND w.s >= b.s - {SCOPE} AND w.e <= b.e + {SCOPE})),
spans AS (SELECT *, list_position({list(KINDS)}, kind) n FROM (SELECT DISTINCT * FROM (SELECT * FROM base UNION ALL SELECT * FROM extra))),
listed AS (
    SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in KINDS)},
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER (n <= 3) b,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) spans
    FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in KINDS)}, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN listed ON listed.r = d.r
"""
