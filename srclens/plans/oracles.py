"""The SQL each query is checked against, over the same tables."""

from __future__ import annotations

# Files as rendered in sources/rendered.py: k order, c customer, m methods of its class.
_FILES = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, 1 + o_custkey % 4 AS m,
    'src/p' || (o_orderkey % 7) || '/F' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.java' AS path,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'com.p' || (o_orderkey % 7) END AS package,
    o_orderkey % 89 = 0 AS is_enum, o_orderkey % 97 = 0 AND o_orderkey % 89 <> 0 AS broken
  FROM orders),
f AS (SELECT * FROM o WHERE NOT is_enum AND NOT broken),
s AS (
  SELECT s_suppkey AS k, s_nationkey AS n,
    'src/api/S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '.java' AS path FROM supplier),
outer_m AS (SELECT path, k, c, unnest(range(1, m + 1)) AS j FROM f),
m AS (
  SELECT path, 'C' || (k % 5000) AS type_name, 'm' || j AS name,
    'public static int m' || j || '(int a, Map b)' AS signature, 'public,static' AS modifiers,
    'int' AS return_type, 'int a,Map b' AS parameters, 1 + (k + j) % 4 AS complexity, 0 AS tpos, j AS mpos FROM outer_m
  UNION ALL SELECT path, 'C' || (k % 5000), 'z', 'void z()', '', 'void', '', 1, 0, 100 FROM f
  UNION ALL SELECT path, 'N' || k, 'z', 'void z()', '', 'void', '', 1, 1, 100 FROM f
  UNION ALL SELECT path, 'S' || k, 'size', 'int size()', '', 'int', '', 1, 0, 1 FROM s
  UNION ALL SELECT path, 'S' || k, 'each', 'default void each(int x)', 'default', 'void', 'int x', 3, 0, 2 FROM s
  UNION ALL SELECT path, t.name, 'one', 'int one()', '', 'int', '', 1, tpos, 1 FROM s,
    (VALUES ('T', 1), ('E', 4), ('B', 5)) v(kind, tpos), LATERAL (SELECT kind || CASE WHEN kind = 'T' THEN CAST(k AS VARCHAR) ELSE '' END AS name) t),
mc AS (SELECT path, type_name, count(*) AS method_count, avg(complexity) AS avg_complexity FROM m WHERE tpos < 2 GROUP BY ALL),
cls AS (
  SELECT f.path, 'C' || (k % 5000) AS name, package, 'public' AS modifiers, 'Base' || (c % 5) AS extends,
    'I0,I' || (c % 3) AS implements, method_count, CAST(4 AS BIGINT) AS field_count, avg_complexity, 0 AS tpos, method_count - 1 AS direct
  FROM f JOIN mc ON mc.path = f.path AND mc.type_name = 'C' || (k % 5000)
  UNION ALL
  SELECT f.path, 'N' || k, package, 'static', '', '', method_count, 0, avg_complexity, 1, method_count
  FROM f JOIN mc ON mc.path = f.path AND mc.type_name = 'N' || k
  UNION ALL
  SELECT path, CASE WHEN tpos = 1 THEN 'T' || k ELSE kind END, 'com.api', mods, '', '', cnt, 0, CAST(cnt AS DOUBLE), tpos, direct
  FROM s, (VALUES ('T', '', 1, 1, 0), ('D', 'static', 0, 2, 0), ('B', 'static', 0, 3, 0), ('E', 'static', 1, 4, 0), ('B', 'static', 1, 5, 1)) v(kind, mods, cnt, tpos, direct)),
ifc AS (
  SELECT s.path, 'S' || k AS name, 'N' || n || ',Closeable' AS extends, CAST(2 AS BIGINT) AS method_count, CAST(1 AS BIGINT) AS field_count,
    2.0::DOUBLE AS avg_complexity FROM s)
"""

_PART_DOCS = """
WITH d AS (
  SELECT 'project_overview' AS type, 'project|' || r_regionkey AS key, r_name AS text, NULL AS class_name, NULL AS interface_name, NULL AS package
  FROM region
  UNION ALL
  SELECT 'class', p_partkey || '|0|' || p_name,
    'Class: ' || p_name || chr(10) || 'Package: ' || coalesce(nullif(p_brand, 'Brand#1'), 'N/A') || chr(10) || 'Methods: ' || p_size || chr(10)
      || 'Summary: ' || CASE WHEN p_size > 25 THEN p_type ELSE 'Summary unavailable' END
      || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'Extends: ' || p_type ELSE '' END
      || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Implements: ' || p_type || ', ' || p_brand ELSE '' END,
    p_name, NULL, coalesce(nullif(p_brand, 'Brand#1'), 'N/A')
  FROM part
  UNION ALL
  SELECT 'interface', s_suppkey || '|0|' || s_name,
    'Interface: ' || s_name || chr(10) || 'Methods: ' || (s_suppkey % 7)
      || CASE WHEN s_nationkey > 12 THEN chr(10) || 'Extends: A, ' || s_nationkey ELSE '' END,
    NULL, s_name, NULL
  FROM supplier)
"""

_SCORE = "1 + " + " + ".join(
    f"CAST((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)} AS BIGINT)"
    for w in ["if", "for", "while", "case", "catch", "&&", "||", "?"]
)

_NEAREST = """
WITH p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d
  FROM embeddings a CROSS JOIN embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5
"""

_FIELDS_JSON = (
    '[{"name":"URL","type":"String","modifiers":["private","static","final"]},'
    '{"name":"a","type":"Map","modifiers":["protected"]},{"name":"b","type":"Map","modifiers":["protected"]},'
    '{"name":"arr","type":"int","modifiers":[]}]'
)


# The texts that the prompts must hold, written out.
_CLASS_HEAD = "Analyze this Java class and provide a structured summary:\n\n"
_CLASS_TAIL = """

Please provide:
1. Purpose: What is the main purpose of this class?
2. Responsibilities: What are its key responsibilities?
3. Key Methods: Describe the most important methods (max 3-5)
4. Complexity Assessment: Comment on the overall complexity
5. Design Patterns: Identify any design patterns used

Keep the response concise and structured."""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# One line per class: its prompt, as sent.
_PROMPTS = f"""
, ml AS (SELECT path, tpos, string_agg('{{"signature":"' || signature || '","complexity":' || complexity || '}}', ',' ORDER BY mpos) AS ms
         FROM m WHERE type_name NOT LIKE 'S%' GROUP BY ALL),
prompts AS (
  SELECT cls.path, cls.name, cls.tpos,
    {_quoted(_CLASS_HEAD)} || '{{"name":"' || name || '","type":"class","extends":' || CASE WHEN extends = '' THEN 'null' ELSE '"' || extends || '"' END
    || ',"implements":[' || CASE WHEN implements = '' THEN '' ELSE '"' || replace(implements, ',', '","') || '"' END
    || '],"methods":[' || coalesce(ms, '') || '],"fields":' || CASE WHEN cls.tpos = 0 THEN {_quoted(_FIELDS_JSON)} ELSE '[]' END || '}}' || {_quoted(_CLASS_TAIL)} AS prompt
  FROM cls LEFT JOIN ml ON ml.path = cls.path AND ml.tpos = cls.tpos)
"""
_CLASS_ROLE = "You are a senior software architect analyzing Java code. Provide clear, structured summaries."


def _totals(group: str = "") -> str:
    """Per-file counts of the rendered corpus."""
    return _FILES + """
, per AS (
  SELECT path, max(package) AS package, count(*) AS classes, 0 AS interfaces, sum(method_count) AS methods,
    sum(field_count) AS fields, sum(round(avg_complexity, 2)) AS rs, sum(avg_complexity) AS ss FROM cls WHERE path NOT LIKE 'src/api/%' GROUP BY path
  UNION ALL SELECT path, 'com.api', count(*), 1, sum(method_count), 0, sum(round(avg_complexity, 2)), sum(avg_complexity) FROM cls
  WHERE path LIKE 'src/api/%' GROUP BY path)
"""


ORACLES: dict[str, str] = {
    "scanned_corpus": _FILES + """
, good AS (SELECT path FROM s WHERE k % 10 <> 0)
SELECT 'class' AS kind, name, CAST(method_count AS BIGINT) AS method_count, CAST(field_count AS BIGINT) AS field_count FROM cls JOIN good ON good.path = cls.path
UNION ALL SELECT 'interface', name, method_count, field_count FROM ifc JOIN good ON good.path = ifc.path
UNION ALL SELECT 'encoding', NULL, count(*), NULL FROM s WHERE k % 10 = 0 HAVING count(*) > 0""",
    "suffix_filter": """
SELECT page_id, url, starts_with(url, 'https://') AS is_https, contains(url, 'example.com') AS is_com,
  regexp_extract(url, '[^/]*$') AS file_name
FROM pages WHERE ends_with(url, '.html') OR ends_with(url, '/') OR ends_with(url, '#top')""",
    "files_matched": "SELECT count(*) FILTER (WHERE ends_with(url, '.html')) AS matched, count(*) AS total FROM pages",
    "utf8_rejects": """
SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 50 = 0 THEN 'encoding' END AS reason,
  CASE WHEN doc_id % 50 <> 0 THEN length(text) END AS n_chars FROM documents""",
    "snapshot_reuse": "SELECT page_id, 1 AS kept, 3 AS replaced FROM pages",
    "json_round_trip": """
SELECT d.doc_id, sha256(text) AS text_hash, quality, quality IS NULL AS null_kept
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "document_sink": _PART_DOCS + """
SELECT type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, min(sha256(type || '|' || key)) AS first_key FROM d GROUP BY type""",
    "knowledge_sections": _totals() + """
, meta AS (SELECT CAST(sum(classes) AS BIGINT) AS c, CAST(sum(interfaces) AS BIGINT) AS i, CAST(sum(methods) AS BIGINT) AS m,
    count(DISTINCT package) AS p, round(sum(rs) / sum(classes), 2) AS a FROM per)
SELECT 'metadata' AS section, NULL AS name, 'classes ' || c || ' interfaces ' || i || ' packages ' || p AS detail, m AS methods, round(a, 2) AS score FROM meta
UNION ALL SELECT DISTINCT 'packages', package, NULL, NULL, NULL FROM per WHERE package IS NOT NULL
UNION ALL SELECT 'project_overview', NULL, 'Overview unavailable', NULL, NULL
UNION ALL SELECT 'classes', name, CASE WHEN method_count > 1 THEN 'About ' || name ELSE 'Summary unavailable' END, CAST(method_count AS BIGINT), round(avg_complexity, 2) FROM cls
UNION ALL SELECT 'interfaces', name, extends, method_count, NULL FROM ifc""",
    "knowledge_flow": _FILES + _PROMPTS + """
, answered AS (SELECT p.*, length(prompt) AS n FROM prompts p)
SELECT 'class' AS type, cls.name, 'Class: ' || cls.name || chr(10) || 'Package: ' || coalesce(package, 'N/A') || chr(10) || 'Methods: ' || method_count || chr(10)
  || 'Summary: ' || CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 'Summary unavailable' ELSE n || ' characters' END
  || CASE WHEN extends <> '' THEN chr(10) || 'Extends: ' || extends ELSE '' END
  || CASE WHEN implements <> '' THEN chr(10) || 'Implements: ' || replace(implements, ',', ', ') ELSE '' END AS text
FROM cls JOIN answered a ON a.path = cls.path AND a.tpos = cls.tpos
UNION ALL SELECT 'interface', name, 'Interface: ' || name || chr(10) || 'Methods: ' || method_count || chr(10) || 'Extends: ' || replace(extends, ',', ', ') FROM ifc
UNION ALL SELECT 'project_overview', NULL, 'Overview of ' || (SELECT count(*) FROM cls) || ' classes'""",
    "package_of_file": _FILES + """
SELECT path, package FROM o WHERE NOT broken AND package IS NOT NULL UNION ALL SELECT path, 'com.api' FROM s""",
    "imports_of_file": _FILES + """
SELECT path, 'java.util.List,java.lang.Math' AS imports FROM o WHERE NOT broken UNION ALL SELECT path, 'java.io.Closeable' FROM s""",
    "class_declarations": _FILES + """
SELECT path, name, package, modifiers, extends, implements, method_count, field_count, round(avg_complexity, 6) AS avg_complexity FROM cls""",
    "changed_snapshot": _FILES + """
SELECT path, name, package, modifiers, extends, implements, method_count, field_count, round(avg_complexity, 6) AS avg_complexity FROM cls
WHERE path NOT IN (SELECT path FROM o WHERE k % 13 = 0)""",
    "interface_declarations": _FILES + "SELECT * FROM ifc",
    "direct_members": _FILES + """
SELECT path, name, direct AS method_count, field_count FROM cls
UNION ALL SELECT path, name, method_count, field_count FROM ifc""",
    "method_declarations": _FILES + """
SELECT path, type_name, name, signature, modifiers, return_type, parameters, complexity FROM m""",
    "field_declarations": _FILES + """
SELECT path, 'C' || (k % 5000) AS type_name, x.name AS name, x.type AS type, x.modifiers AS modifiers FROM f
CROSS JOIN (VALUES ('URL', 'String', 'private,static,final'), ('a', 'Map', 'protected'), ('b', 'Map', 'protected'), ('arr', 'int', '')) x(name, type, modifiers)
UNION ALL SELECT path, 'S' || k, 'SIZE', 'int', '' FROM s""",
    "rejected_files": _FILES + "SELECT path, 'unbalanced' AS reason FROM o WHERE broken",
    "type_relations": _FILES + """
, e AS (
  SELECT path, name AS child, 'extends' AS relation, extends AS parent FROM cls WHERE extends <> ''
  UNION ALL SELECT path, name, 'implements', unnest(string_split(implements, ',')) FROM cls WHERE implements <> ''
  UNION ALL SELECT path, name, 'extends', unnest(string_split(extends, ',')) FROM ifc),
t AS (SELECT name, min(path) AS parent_path FROM (SELECT name, path FROM cls UNION ALL SELECT name, path FROM ifc) GROUP BY name)
SELECT e.path, child, relation, parent, parent_path FROM e LEFT JOIN t ON t.name = e.parent""",
    "corpus_statistics": _totals() + """
SELECT count(*) AS total_files, CAST(sum(classes) AS BIGINT) AS total_classes, CAST(sum(interfaces) AS BIGINT) AS total_interfaces,
  CAST(sum(methods) AS BIGINT) AS total_methods, CAST(sum(fields) AS BIGINT) AS total_fields, count(DISTINCT package) AS unique_packages FROM per""",
    "package_statistics": _totals() + """
SELECT package, count(*) AS total_files, CAST(sum(classes) AS BIGINT) AS total_classes, CAST(sum(interfaces) AS BIGINT) AS total_interfaces,
  CAST(sum(methods) AS BIGINT) AS total_methods, CAST(sum(fields) AS BIGINT) AS total_fields,
  coalesce(round(sum(rs) / nullif(sum(classes), 0), 2), 0.0) AS avg_class_complexity FROM per GROUP BY package""",
    "project_metadata": _totals() + """
SELECT CAST(sum(classes) AS BIGINT) AS total_classes, CAST(sum(interfaces) AS BIGINT) AS total_interfaces, CAST(sum(methods) AS BIGINT) AS total_methods,
  count(DISTINCT package) AS unique_packages,
  round(sum(rs) / sum(classes), 2) AS avg_class_complexity, round(sum(ss) / sum(classes), 6) AS avg_complexity FROM per""",
    "class_packages": _FILES + """
, first AS (SELECT name, package FROM (SELECT name, package, row_number() OVER (PARTITION BY name ORDER BY path) AS rn FROM cls) WHERE rn = 1)
SELECT cls.path, cls.name, first.package FROM cls JOIN first ON first.name = cls.name""",
    "class_requests": _FILES + _PROMPTS + f"SELECT path, name, {_quoted(_CLASS_ROLE)} AS role_text, 'system' AS role, prompt FROM prompts",
    "project_request": _totals() + """
SELECT CAST(sum(classes) AS BIGINT) AS total_classes, CAST(sum(methods) AS BIGINT) AS total_methods, count(DISTINCT package) AS n_packages,
  round(sum(ss) / sum(classes), 6) AS avg_complexity,
  (SELECT string_agg(name, ', ' ORDER BY path, tpos) FROM (SELECT * FROM cls ORDER BY path, tpos LIMIT 20))
    || CASE WHEN sum(classes) > 20 THEN '...' ELSE '' END AS class_names FROM per""",
    "corpus_documents": _FILES + """
SELECT 'class' AS type, 'Class: ' || name || chr(10) || 'Package: ' || coalesce(package, 'N/A') || chr(10) || 'Methods: ' || method_count || chr(10)
  || 'Summary: ' || CASE WHEN method_count > 1 THEN 'About ' || name ELSE 'Summary unavailable' END
  || CASE WHEN extends <> '' THEN chr(10) || 'Extends: ' || extends ELSE '' END
  || CASE WHEN implements <> '' THEN chr(10) || 'Implements: ' || replace(implements, ',', ', ') ELSE '' END AS text,
  name, coalesce(package, 'N/A') AS package FROM cls
UNION ALL SELECT 'interface', 'Interface: ' || name || chr(10) || 'Methods: ' || method_count || chr(10) || 'Extends: ' || replace(extends, ',', ', '), name, NULL FROM ifc
UNION ALL SELECT 'project_overview', 'Overview unavailable', NULL, NULL""",
    "table_documents": _PART_DOCS + "SELECT sha256(type || '|' || key) AS doc_key, type, text, class_name, interface_name, package FROM d",
    "decision_scores": f"SELECT doc_id, {_SCORE} AS score FROM documents",
    "source_scores": f"""
WITH p AS (SELECT source, avg(score) AS mean FROM (SELECT source, {_SCORE} AS score FROM documents) GROUP BY source)
SELECT round(avg(round(mean, 2)), 2) AS avg_rounded, round(avg(mean), 6) AS avg_plain FROM p""",
    "named_sources": "SELECT DISTINCT source AS package FROM documents WHERE lang = 'en'",
    "source_list": """
SELECT source AS package, row_number() OVER (ORDER BY source) AS idx, count(*) OVER () AS total FROM (SELECT DISTINCT source FROM documents)""",
    "pruned_records": """
SELECT event_id, '{"event_type":"' || event_type || '","children":[{"user_id":' || user_id || '}]}' AS outer,
  CAST(json_extract(props, '$.k') AS INT) AS k, value FROM events""",
    "masked_urls": "SELECT page_id, replace(url, 'utm_source', '***TOKEN***') AS url FROM pages",
    "error_classes": """
SELECT CASE event_type WHEN 'error' THEN 'auth' WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'rate_limit' ELSE 'other' END AS error_class,
  count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""",
    "scalar_texts": """
SELECT o_orderkey, o_orderpriority AS priority, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS short_hash,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, round(o_totalprice / 7, 2) AS price, o_orderkey || '.java' AS file_name,
  CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE o_orderstatus END AS status FROM orders""",
    "commit_summaries": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
  count(*) OVER (PARTITION BY o_custkey) AS commit_count FROM orders)
SELECT o_custkey, commit_count, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS hash, o_orderpriority AS author, o_orderstatus AS message,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date FROM r WHERE rn = 1""",
    "first_match_lookup": """
WITH f AS (SELECT p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1),
q AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN '?' ELSE p_name END AS p_name FROM part)
SELECT p_partkey, q.p_name, coalesce(p_brand, 'N/A') AS p_brand FROM q LEFT JOIN f ON f.p_name = q.p_name""",
    "summaries_attached": """
SELECT d.doc_id AS request_id, source, CASE WHEN quality = 1 THEN 'toxic ' || toxic ELSE 'Summary unavailable' END AS summary
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "numbered_documents": """
SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS idx, count(*) OVER () AS total FROM documents""",
    "first_part_names": """
SELECT string_agg(p_name, ', ' ORDER BY p_partkey) || CASE WHEN (SELECT count(*) FROM part) > 20 THEN '...' ELSE '' END AS class_names
FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20)""",
    "model_requests": """
SELECT conv_id, turn, CAST(2 AS BIGINT) AS n, 'Be brief.' AS system,
  'Analyze:' || chr(10) || chr(10) || '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' || chr(10) || chr(10) || text AS prompt
FROM conversations""",
    "model_calls": """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 'Summary unavailable' ELSE n || ' characters' END AS summary,
  CAST(CASE WHEN n % 5 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN n % 5 = 0 THEN 'no answer' END AS error FROM d""",
    "fixed_chunks": """
WITH c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 3500 THEN 1 ELSE CAST(ceil((length(text) - 300) / 3200.0) AS BIGINT) END)) AS chunk_idx
  FROM documents WHERE text <> '')
SELECT doc_id, chunk_idx, substr(text, chunk_idx * 3200 + 1, 3500) AS chunk FROM c""",
    "embedded_by_function": "SELECT doc_id, "
    + ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS n_{c}" for c in "aeiou")
    + " FROM documents",
    "embedded_documents": """
SELECT doc_id, 256 AS dim, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN CAST(1 AS DOUBLE) ELSE 0 END AS norm FROM documents""",
    "separator_chunk_facts": "SELECT doc_id, true AS inside, true AS fits, true AS begins, true AS ends FROM documents WHERE trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''",
    "list_nearest": """
SELECT vec_id AS query_id, least(5, count(*) OVER ()) AS n, least(5, count(*) OVER ()) AS last_rank, CAST(0 AS DOUBLE) AS nearest, true AS right FROM embeddings""",
    "search_documents": _PART_DOCS + """
, v AS (SELECT sha256(type || '|' || key) AS doc_key, type, text, list_transform(['a','e','i','o','u'], lambda c: length(text) - length(replace(text, c, ''))) AS e FROM d),
q AS (SELECT item_id, list_transform(['a','e','i','o','u'], lambda c: length(text) - length(replace(text, c, ''))) AS e FROM benchmark),
p AS (SELECT item_id, doc_key, type, text, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS DOUBLE) AS distance FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_key) AS rank FROM p)
SELECT item_id, rank, doc_key, distance, text, type FROM r WHERE rank <= 5""",
    "nearest_vectors": """
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
d AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS d FROM embeddings, q)
SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 5""",
    "batch_nearest": _NEAREST,
    "batch_nearest_blocks": _NEAREST,
    "list_nearest_all_probed": _NEAREST,
    "pruned_nearest": _NEAREST,
    "progress_counters": "SELECT count(*) AS found, count(*) FILTER (WHERE lang = 'en') AS kept FROM documents",
    "retained_files": _FILES + """
SELECT path, package, 'class' AS first_kind, CAST(2 AS BIGINT) AS n_types FROM f UNION ALL SELECT path, 'com.api', 'interface', 6 FROM s""",
}
