"""Queries of nested records (p4) and of ingestion, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.operators import nested
from convolake.sources import connectors
from convolake.tables import read


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each block of a record, by the JSON Pointer of its place."""
    nodes = nested.occurrences(read(spark, d, "raw_records"))
    return nested.blocks(nodes).select("record_id", "node_path").distinct()


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of every subtree with its record, parent and ordinal."""
    return nested.bridge(read(spark, d, "raw_records"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The parent of each place of a record, through any of its payloads, with the kind of value that stands there."""
    return p4_bridge(spark, d).select("record_id", "node_path", "parent_path", "ordinal", "depth", "kind").distinct()


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct subtree once, by its Merkle hash."""
    return nested.objects(nested.occurrences(read(spark, d, "raw_records")))


QUERIES = {"p4_found": p4_found, "p4_bridge": p4_bridge, "p4_links": p4_links, "p4_objects": p4_objects}

SQL = {
    "p4_links": r"""
WITH whole AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM raw_records), j AS (
  SELECT r.record_id, j.fullkey, j.path, j.key, j.type FROM whole r, json_tree(r.payload) j WHERE r.payload IS NOT NULL
), n AS (
  SELECT record_id, regexp_replace(replace(replace(substring(fullkey, 2), ']', ''), '[', '/'), '\.', '/', 'g') AS node_path, fullkey,
    CASE WHEN fullkey = '$' THEN NULL ELSE regexp_replace(replace(replace(substring(path, 2), ']', ''), '[', '/'), '\.', '/', 'g') END AS parent_path,
    CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind FROM j
)
SELECT DISTINCT record_id, node_path, parent_path, CASE WHEN ends_with(fullkey, ']') THEN regexp_extract(node_path, '[0-9]+$')::INT END AS ordinal, len(string_split(node_path, '/')) - 1 AS depth, kind
FROM n WHERE fullkey = '$' OR kind IN ('object', 'array') OR ends_with(fullkey, ']')
""",
    "p4_found": r"""
WITH whole AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM raw_records), nodes AS (
  SELECT r.record_id, j.fullkey, j.path, j.key, j.type FROM whole r, json_tree(r.payload) j WHERE r.payload IS NOT NULL
)
SELECT DISTINCT record_id, regexp_replace(replace(replace(substring(fullkey, 2), ']', ''), '[', '/'), '\.', '/', 'g') AS node_path FROM nodes
WHERE (type IN ('OBJECT', 'VARCHAR') AND ends_with(fullkey, ']') AND regexp_matches(path, '\.(content|parts)$')) OR (type = 'OBJECT' AND NOT ends_with(fullkey, ']') AND key IN ('content', 'parts'))
""",
}


def ingested_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the raw transcript lines, of each line its payload received last."""
    return connectors.parse_lines(_latest_lines(spark, d)).where("role IS NOT NULL").select("source_kind", "external_id", "line_no", "block_no", "role", "text", "tool_name", "ts")


def ingested_threads(spark: SparkSession, d: str) -> DataFrame:
    return connectors.thread_rows(connectors.parse_lines(_latest_lines(spark, d)))


def _latest_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "raw_records").where("source_kind IS NOT NULL")
    return rows.groupBy("source_kind", "external_id", "line_no").agg(F.max_by("payload", F.struct("received_at", "record_id")).alias("payload"))


QUERIES |= {"ingested_messages": ingested_messages, "ingested_threads": ingested_threads}

_STR = lambda x, path: f"CASE WHEN json_type({x}, '{path}') = 'VARCHAR' THEN json_extract_string({x}, '{path}') END"
#: A call's or an answer's value as text: a string as it is, null as nothing, all else as JSON without blanks.
_VALUE = lambda x, path: f"CASE json_type({x}, '{path}') WHEN 'VARCHAR' THEN json_extract_string({x}, '{path}') WHEN 'NULL' THEN '' ELSE coalesce(json(json_extract({x}, '{path}'))::VARCHAR, '') END"
#: The texts of a list of blocks, of some types, joined by line breaks; a string is its own text.
_TEXTS = lambda x, path, test="true": f"CASE json_type({x}, '{path}') WHEN 'VARCHAR' THEN json_extract_string({x}, '{path}') WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(json_extract({x}, '{path}[*]'), lambda b: json_type(b, '$.text') = 'VARCHAR' AND {test}), lambda b: json_extract_string(b, '$.text')), chr(10)) ELSE '' END"
_EACH = lambda x, path: f"CASE WHEN json_type({x}, '{path}') = 'ARRAY' THEN json_extract({x}, '{path}[*]') ELSE [json_extract({x}, '{path}')] END"
_CALL = f"coalesce(nullif({_STR('e', '$.name')}, ''), 'tool')"
_INGEST_SQL = f"""
WITH last AS (
  SELECT source_kind, external_id, line_no, payload FROM (SELECT *, row_number() OVER (PARTITION BY source_kind, external_id, line_no ORDER BY received_at DESC, record_id DESC) AS r FROM raw_records WHERE source_kind IS NOT NULL) WHERE r = 1
), j AS (SELECT source_kind, external_id, line_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS v FROM last
), said AS (
  SELECT source_kind, external_id, line_no, 0 AS m, v->>'$.type' AS role, json_extract(v, '$.message.content') AS content, try_cast(v->>'$.timestamp' AS TIMESTAMPTZ) AS tm FROM j WHERE source_kind = 'claude_code' AND v->>'$.type' IN ('user', 'assistant')
  UNION ALL
  SELECT source_kind, external_id, line_no, m, e->>'$.role', json_extract(e, '$.content'), NULL FROM (
    SELECT source_kind, external_id, line_no, unnest(json_extract(v, '$[*]')) AS e, generate_subscripts(json_extract(v, '$[*]'), 1) AS m FROM j WHERE source_kind IN ('cline', 'roo', 'kilo') AND json_type(v) = 'ARRAY') WHERE e->>'$.role' IN ('user', 'assistant')
), blocks AS (
  SELECT *, unnest({_EACH('content', '$')}) AS e, generate_subscripts({_EACH('content', '$')}, 1) AS n FROM said WHERE json_type(content) = 'ARRAY'
), talk AS (
  SELECT source_kind, external_id, line_no, m, 0 AS n, 0 AS o, role, json_extract_string(content, '$') AS text, NULL AS tool_name, tm FROM said WHERE json_type(content) = 'VARCHAR'
  UNION ALL SELECT source_kind, external_id, line_no, m, n, 0, role, {_STR('e', '$.text')}, NULL, tm FROM blocks WHERE e->>'$.type' = 'text'
  UNION ALL SELECT source_kind, external_id, line_no, m, n, 0, 'assistant', {_CALL} || ': ' || {_VALUE('e', '$.input')}, {_CALL}, tm FROM blocks WHERE e->>'$.type' = 'tool_use'
  UNION ALL SELECT source_kind, external_id, line_no, m, n, 0, 'tool', {_TEXTS('e', '$.content')}, NULL, tm FROM blocks WHERE e->>'$.type' = 'tool_result'
), turns AS (
  SELECT source_kind, external_id, line_no, CASE v->>'$.type' WHEN 'gemini' THEN 'assistant' WHEN 'tool_result' THEN 'tool' ELSE v->>'$.type' END AS role, CASE source_kind WHEN 'gemini' THEN json_extract(v, '$.content') ELSE json_extract(v, '$.message.parts') END AS content,
    try_cast(coalesce(v->>'$.timestamp', CASE WHEN source_kind = 'gemini' THEN v->>'$.startTime' END) AS TIMESTAMPTZ) AS tm
  FROM j WHERE (source_kind = 'gemini' AND v->>'$.type' IN ('user', 'gemini')) OR (source_kind = 'qwen' AND v->>'$.type' IN ('user', 'assistant', 'tool_result'))
), parts AS (SELECT *, unnest({_EACH('content', '$')}) AS p, generate_subscripts({_EACH('content', '$')}, 1) AS n FROM turns
), spoken AS (
  SELECT source_kind, external_id, line_no, 0 AS m, n, 0 AS o, role, CASE json_type(p) WHEN 'VARCHAR' THEN json_extract_string(p, '$') ELSE {_STR('p', '$.text')} END AS text, NULL AS tool_name, tm FROM parts
  UNION ALL SELECT source_kind, external_id, line_no, 0, n, 1, 'assistant', {_CALL} || ': ' || {_VALUE('e', '$.args')}, {_CALL}, tm FROM (SELECT *, json_extract(p, '$.functionCall') AS e FROM parts) WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT source_kind, external_id, line_no, 0, n, 2, 'tool', CASE WHEN json_type(e, '$.response') = 'NULL' OR json_type(e, '$.response') IS NULL THEN 'null' ELSE {_VALUE('e', '$.response')} END, NULL, tm FROM (SELECT *, json_extract(p, '$.functionResponse') AS e FROM parts) WHERE json_type(e) = 'OBJECT'
), rollout AS (SELECT source_kind, external_id, line_no, json_extract(v, '$.payload') AS e, try_cast(v->>'$.timestamp' AS TIMESTAMPTZ) AS tm FROM j WHERE source_kind = 'codex' AND v->>'$.type' IS DISTINCT FROM 'session_meta'
), rolled AS (
  SELECT source_kind, external_id, line_no, 0 AS m, 0 AS n, 0 AS o, CASE WHEN e->>'$.role' IN ('user', 'assistant') THEN e->>'$.role' ELSE 'system' END AS role, {_TEXTS('e', '$.content', "b->>'$.type' IN ('input_text', 'output_text', 'text')")} AS text, NULL AS tool_name, tm FROM rollout WHERE e->>'$.type' = 'message'
  UNION ALL SELECT source_kind, external_id, line_no, 0, 0, 0, 'assistant', {_CALL} || ': ' || {_VALUE('e', '$.arguments')}, {_CALL}, tm FROM rollout WHERE e->>'$.type' = 'function_call'
  UNION ALL SELECT source_kind, external_id, line_no, 0, 0, 0, 'tool', {_VALUE('e', '$.output')}, NULL, tm FROM rollout WHERE e->>'$.type' = 'function_call_output'
), sessions AS (SELECT source_kind, external_id, line_no, coalesce(json_extract(v, '$.v'), v) AS s FROM j WHERE source_kind = 'copilot'
), requests AS (
  SELECT *, unnest(json_extract(s, '$.requests[*]')) AS e, generate_subscripts(json_extract(s, '$.requests[*]'), 1) AS m FROM sessions WHERE json_type(s, '$.requests') = 'ARRAY'
), asked AS (
  SELECT source_kind, external_id, line_no, m, 0 AS n, 0 AS o, 'user' AS role, {_STR('e', '$.message.text')} AS text, NULL AS tool_name, make_timestamp(coalesce((e->>'$.timestamp')::BIGINT, (s->>'$.creationDate')::BIGINT) * 1000) AS tm FROM requests
  UNION ALL SELECT source_kind, external_id, line_no, m, 1, 0, 'assistant', array_to_string(list_transform(list_filter(json_extract(e, '$.response[*]'), lambda b: json_type(b, '$.value') = 'VARCHAR' AND coalesce(b->>'$.kind', '') = ''), lambda b: json_extract_string(b, '$.value')), ''), NULL,
    make_timestamp(coalesce((e->>'$.timestamp')::BIGINT, (s->>'$.creationDate')::BIGINT) * 1000) FROM requests
), every AS (
  SELECT source_kind, external_id, line_no, m, n, o, role, text, tool_name, epoch(tm) AS tm FROM talk UNION ALL SELECT source_kind, external_id, line_no, m, n, o, role, text, tool_name, epoch(tm) FROM spoken
  UNION ALL SELECT source_kind, external_id, line_no, m, n, o, role, text, tool_name, epoch(tm) FROM rolled UNION ALL SELECT source_kind, external_id, line_no, m, n, o, role, text, tool_name, epoch(tm) FROM asked
), kept AS (SELECT *, regexp_replace(text, '^[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{a0}}\\x{{3000}}]+$', '', 'g') AS body FROM every WHERE text IS NOT NULL)
"""
SQL["ingested_messages"] = _INGEST_SQL + "SELECT source_kind, external_id, line_no, (row_number() OVER (PARTITION BY source_kind, external_id, line_no ORDER BY m, n, o) - 1)::INT AS block_no, role, body AS text, tool_name, floor(tm)::BIGINT AS ts FROM kept WHERE body <> ''"
SQL["ingested_threads"] = (
    _INGEST_SQL
    + f""", msg AS (SELECT *, row_number() OVER (PARTITION BY source_kind, external_id, line_no ORDER BY m, n, o) AS b, floor(tm)::BIGINT AS ts FROM kept WHERE body <> ''
), lines AS (
  SELECT source_kind, external_id, line_no, CASE WHEN source_kind = 'claude_code' AND v->>'$.type' = 'ai-title' THEN nullif({_STR('v', '$.aiTitle')}, '') END AS title,
    nullif(CASE WHEN source_kind IN ('claude_code', 'qwen') THEN {_STR('v', '$.cwd')} WHEN source_kind = 'codex' AND v->>'$.type' = 'session_meta' THEN {_STR('v', '$.payload.cwd')} WHEN source_kind = 'gemini' THEN {_STR('v', '$.directories[0]')} END, '') AS project,
    nullif(CASE WHEN source_kind IN ('claude_code', 'qwen') THEN {_STR('v', '$.gitBranch')} END, '') AS branch,
    floor(CASE WHEN source_kind = 'copilot' THEN coalesce(v->>'$.v.creationDate', v->>'$.creationDate')::BIGINT / 1000 WHEN source_kind IN ('cline', 'roo', 'kilo') THEN NULL
      ELSE epoch(try_cast(coalesce(CASE WHEN source_kind = 'codex' AND v->>'$.type' = 'session_meta' THEN v->>'$.payload.timestamp' END, v->>'$.timestamp', CASE WHEN source_kind = 'gemini' THEN v->>'$.startTime' END) AS TIMESTAMPTZ)) END)::BIGINT AS seen FROM j WHERE v IS NOT NULL
), about AS (
  SELECT source_kind, external_id, arg_max(title, line_no) FILTER (WHERE title IS NOT NULL) AS title, arg_max(project, line_no) FILTER (WHERE project IS NOT NULL) AS project_path, arg_max(branch, line_no) FILTER (WHERE branch IS NOT NULL) AS git_branch, min(seen) AS lo, max(seen) AS hi FROM lines GROUP BY ALL
), sums AS (
  SELECT source_kind, external_id, count(*) AS message_count, sum(strlen(body))::BIGINT AS bytes, arg_min(body, (line_no, b)) FILTER (WHERE role = 'user') AS first, min(msg.ts) FILTER (WHERE seen IS NULL) AS mlo, max(msg.ts) FILTER (WHERE seen IS NULL) AS mhi
  FROM msg JOIN lines USING (source_kind, external_id, line_no) GROUP BY ALL
)
SELECT source_kind, external_id, coalesce(title, CASE WHEN length(first) > 80 THEN substring(first, 1, 80) || '…' ELSE first END) AS title, project_path, git_branch, least(lo, mlo) AS created_at, greatest(hi, mhi) AS updated_at, message_count, bytes FROM sums JOIN about USING (source_kind, external_id)"""
)
