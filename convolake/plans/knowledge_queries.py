"""Queries over what is known about threads: facts, coverage, worklists, snapshots, payloads, vectors to be written, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.operators import extraction as X
from convolake.operators import notes, packing, store
from convolake.operators import vector as V
from convolake.session import cut
from convolake.tables import read

from . import model as M
from . import reference_queries as R
from .reference_queries import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]
DAY, BUDGET, EXCERPT = 86_400, 6000, 2500
KINDS = ("decision", "gotcha", "todo")


# ---------------------------------------------------------------- facts


@query("SELECT f.fact_id, f.project, f.text FROM facts f LEFT JOIN t ON t.id = f.thread_id WHERE f.kind = 'todo' AND f.status = 'open' AND NOT f.hidden AND (f.text ILIKE '%retry%' OR t.title ILIKE '%retry%') ORDER BY f.created_at DESC, f.fact_id DESC LIMIT 50")
def open_todos(spark: SparkSession, d: str) -> DataFrame:
    """Open todos whose text, or whose thread's title, holds a word; newest first."""
    titles = M.threads(spark, d).select(F.col("id").alias("thread_id"), "title")
    f = M.facts(spark, d).where("kind = 'todo' AND status = 'open' AND NOT hidden").join(titles, "thread_id", "left")
    hit = f.where(F.col("text").ilike("%retry%") | F.coalesce(F.col("title").ilike("%retry%"), F.lit(False)))
    return hit.orderBy(F.col("created_at").desc(), F.col("fact_id").desc()).limit(50).select("fact_id", "project", "text")


@query("SELECT fact_id, kind, text, created_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, fact_id DESC) AS r FROM facts WHERE kind IN ('decision', 'gotcha') AND NOT hidden AND created_at >= (SELECT max(created_at) FROM facts) - 7 * 86400) WHERE r <= 40")
def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    """The latest 40 decisions and gotchas each of the week before the newest fact."""
    f = M.facts(spark, d)
    newest = f.agg(F.max("created_at")).scalar()
    w = Window.partitionBy("kind").orderBy(F.col("created_at").desc(), F.col("fact_id").desc())
    kept = f.where(F.col("kind").isin("decision", "gotcha") & ~F.col("hidden") & (F.col("created_at") >= newest - 7 * DAY))
    return kept.withColumn("r", F.row_number().over(w)).where("r <= 40").select("fact_id", "kind", "text", "created_at")


_MEMORY_SQL = """, memory AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, kind, lower(trim(text)) ORDER BY pinned DESC, created_at DESC, fact_id DESC) AS r FROM facts
  WHERE NOT hidden AND (kind <> 'todo' OR status = 'open')) WHERE r = 1)
"""


def _memory(spark: SparkSession, d: str) -> DataFrame:
    f = M.facts(spark, d).where("NOT hidden AND (kind <> 'todo' OR status = 'open')")
    best = f.groupBy("project", "kind", F.lower(F.trim("text")).alias("k")).agg(F.max(F.struct("pinned", "created_at", "fact_id", "text")).alias("s"))
    return best.select("project", "kind", "s.*")


@query(_MEMORY_SQL + "SELECT fact_id, project, kind, text FROM memory")
def project_memory(spark: SparkSession, d: str) -> DataFrame:
    """The visible facts of each project and kind, equal texts once (pinned ones first, then the latest), todos only if open."""
    return _memory(spark, d).select("fact_id", "project", "kind", "text")


_NOTES_SQL = (
    _MEMORY_SQL
    + """, top AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY pinned DESC, created_at DESC, fact_id DESC) AS n FROM memory WHERE kind IN ('decision', 'gotcha', 'todo')
), sections AS (
  SELECT project, kind, CASE kind WHEN 'decision' THEN '## Decisions' WHEN 'gotcha' THEN '## Gotchas' ELSE '## Open todos' END || chr(10) || string_agg('- ' || regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY n) AS s
  FROM top WHERE n <= 25 GROUP BY project, kind
), notes AS (SELECT project, string_agg(s, chr(10) || chr(10) ORDER BY kind) AS notes FROM sections GROUP BY project)
"""
)


@query(_NOTES_SQL + "SELECT project, notes FROM notes")
def memory_notes(spark: SparkSession, d: str) -> DataFrame:
    """Each project's memory as Markdown, 25 facts a kind."""
    return notes.memory_markdown(_memory(spark, d), 25)


@query("SELECT fact_id, project, text, rationale, created_at FROM facts WHERE kind = 'decision' AND NOT hidden")
def project_decisions(spark: SparkSession, d: str) -> DataFrame:
    return M.facts(spark, d).where("kind = 'decision' AND NOT hidden").select("fact_id", "project", "text", "rationale", "created_at")


_PIVOT = ", ".join(f"string_agg(text, chr(31) ORDER BY pinned DESC, seq, fact_id) FILTER (WHERE kind = '{k}') AS {k}s" for k in KINDS)


@query(
    f""", k AS (SELECT thread_id, arg_max(text, (seq, fact_id)) FILTER (WHERE kind = 'summary' AND NOT pinned) AS late, arg_max(text, (seq, fact_id)) FILTER (WHERE kind = 'summary' AND pinned) AS pinned_one, {_PIVOT} FROM facts WHERE NOT hidden GROUP BY thread_id)
SELECT t.id AS thread_id, coalesce(late, pinned_one) AS summary, decisions, gotchas, todos, coalesce(u.knowledge_extracted AND u.knowledge_msg_count IS DISTINCT FROM t.distillable_count, false) AS stale
FROM t JOIN u ON u.thread_id = t.id LEFT JOIN k ON k.thread_id = t.id"""
)
def thread_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each thread: its last summary in the order of the others (pinned first), decisions, gotchas and todos, done ones too; and whether messages came since."""
    return store.knowledge(M.facts(spark, d), M.threads_with_user(spark, d))


# ---------------------------------------------------------------- projects and worklists


_WORK = "knowledge_error IS NULL AND (NOT knowledge_extracted OR knowledge_msg_count <> distillable_count) AND NOT is_subagent AND message_count >= 4"


@query(f"SELECT t.id, t.project, t.updated_at FROM t JOIN u ON u.thread_id = t.id WHERE {_WORK}")
def pending_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads whose knowledge is missing or stale: the worklist of distilling, newest first where it is drained."""
    return M.threads_with_user(spark, d).where(store.stale()).where(store.distillable()).select("id", "project", "updated_at")


@query("SELECT project, count(*) AS threads, count(*) FILTER (WHERE knowledge_extracted) AS distilled, greatest(count(*) - count(*) FILTER (WHERE knowledge_extracted), 0) AS pending, max(updated_at) AS updated_at FROM t JOIN u ON u.thread_id = t.id WHERE NOT is_subagent AND message_count >= 4 AND project_path IS NOT NULL GROUP BY project")
def project_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each project with its threads, how many of them are distilled, and how many not."""
    t = M.threads_with_user(spark, d).where(store.distillable() & F.col("project_path").isNotNull())
    n, done = F.count(F.lit(1)), F.count_if("knowledge_extracted")
    return t.groupBy("project").agg(n.alias("threads"), done.alias("distilled"), F.greatest(n - done, F.lit(0)).alias("pending"), F.max("updated_at").alias("updated_at"))


@query("SELECT f.fact_id, f.thread_id, f.kind FROM facts f JOIN t ON t.id = f.thread_id JOIN u ON u.thread_id = t.id WHERE NOT (u.knowledge_extracted AND u.knowledge_msg_count <> t.distillable_count AND f.extractor = 'llm' AND NOT (f.pinned OR f.edited OR f.hidden))")
def facts_after_invalidation(spark: SparkSession, d: str) -> DataFrame:
    """The facts that stay when threads that grew lose what was distilled from them and nobody has curated."""
    f = M.facts(spark, d)
    known = f.join(M.threads(spark, d).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    return store.invalidate(known, M.threads_with_user(spark, d))[0].select("fact_id", "thread_id", "kind")


# ---------------------------------------------------------------- threads


@query("SELECT t.id, s.kind AS source, t.title, t.project, t.message_count, t.updated_at, u.starred, (SELECT string_agg(tag, ',' ORDER BY tag) FROM tags WHERE tags.thread_id = t.id) AS tags FROM t JOIN sources s ON s.id = t.source_id JOIN u ON u.thread_id = t.id")
def thread_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header of each thread with its sorted tags."""
    tags = M.thread_tags(spark, d).groupBy(F.col("thread_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    t = M.threads_with_user(spark, d).join(M.sources(spark, d), "source_id").join(tags, "id", "left")
    return t.select("id", F.col("kind").alias("source"), "title", "project", "message_count", "updated_at", "starred", "tags")


@query("SELECT m.id, m.thread_id, m.role, substring(m.text, 1, 240) AS excerpt, t.title, s.kind AS source FROM m JOIN t ON t.id = m.thread_id JOIN sources s ON s.id = t.source_id WHERE m.text IS NOT NULL")
def message_hits(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of a message that was found: the head of its text beside its thread and source."""
    t = M.threads(spark, d).select(F.col("id").alias("thread_id"), "title", "source_id").join(M.sources(spark, d), "source_id")
    m = M.messages(spark, d, "role", "text").where("text IS NOT NULL")
    return m.select("id", "thread_id", "role", F.substring("text", 1, 240).alias("excerpt")).join(t, "thread_id").select("id", "thread_id", "role", "excerpt", "title", F.col("kind").alias("source"))


def _pack_sql(budget: int) -> str:
    cap = max(packing.LEAST, budget // (packing.HEAD + packing.TAIL + 1))
    return f""", l AS (
  SELECT thread_id, seq, coalesce(role, '') AS role, coalesce(text, '') AS text, tool_name IS NOT NULL OR coalesce(role, '') = 'tool' AS tool,
    '### ' || CASE WHEN tool_name IS NOT NULL THEN 'tool: ' || tool_name WHEN role = 'tool' THEN 'tool result' ELSE coalesce(role, '') END || chr(10) || coalesce(text, '') || chr(10) AS line FROM m
), z AS (
  SELECT l.thread_id, sum(strlen(line) + 1) AS a, coalesce(sum(strlen(line) + 1) FILTER (WHERE NOT tool), 0) AS b, count(*) FILTER (WHERE NOT tool) AS talk,
    '<reference_thread source="' || replace(coalesce(any_value(s.kind), ''), '"', '''') || '" title="' || replace(coalesce(any_value(t.title), 'Untitled'), '"', '''') || '" project="' || replace(coalesce(any_value(t.project), ''), '"', '''') || '">' AS head
  FROM l JOIN t ON t.id = l.thread_id JOIN sources s ON s.id = t.source_id GROUP BY l.thread_id
), w AS (
  SELECT *, CASE WHEN a - 1 + strlen(head) + 21 <= {budget} THEN 'full' WHEN greatest(b - 1, 0) + strlen(head) + 21 + 35 <= {budget} THEN 'no_tools' ELSE 'ends' END AS mode,
    talk - CASE WHEN talk > 12 THEN 12 ELSE least(talk, 6) END AS elided FROM z
), o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS k, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS back FROM l WHERE NOT tool
), e AS (
  SELECT o.thread_id, seq, k <= 6 AS first, '### ' || role || chr(10) || CASE WHEN length(text) > {cap} THEN substring(text, 1, {cap}) || '…' ELSE text END || chr(10) AS line
  FROM o JOIN w ON w.thread_id = o.thread_id WHERE w.mode = 'ends' AND (k <= 6 OR (talk > 12 AND back <= 6))
), bodies AS (
  SELECT w.thread_id, count(line)::INT AS turns, coalesce(string_agg(line, chr(10) ORDER BY seq), '') AS body FROM w LEFT JOIN l ON l.thread_id = w.thread_id AND (w.mode = 'full' OR NOT l.tool) WHERE w.mode <> 'ends' GROUP BY w.thread_id
  UNION ALL
  SELECT w.thread_id, count(line)::INT, coalesce(string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE first), '') || CASE WHEN any_value(elided) > 0 THEN chr(10) || chr(10) || '### … ' || any_value(elided) || ' turns elided …' || chr(10) || chr(10) ELSE '' END
    || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE NOT first), '') FROM w LEFT JOIN e ON e.thread_id = w.thread_id WHERE w.mode = 'ends' GROUP BY w.thread_id
), framed AS (
  SELECT w.thread_id, mode, turns, body, head || CASE mode WHEN 'full' THEN '' WHEN 'no_tools' THEN chr(10) || '<!-- tool calls/output omitted -->' ELSE chr(10) || '<!-- trimmed to fit budget; ' || elided || ' middle turns elided, tools omitted -->' END || chr(10) AS head
  FROM w JOIN bodies USING (thread_id)
), packed AS (
  SELECT thread_id, mode, turns, head || CASE WHEN mode = 'ends' AND strlen(head) + strlen(body) + 20 > {budget} THEN substring(body, 1, {budget - packing.SPARE}) || chr(10) || '… (truncated) …' ELSE body END || chr(10) || '</reference_thread>' AS packed FROM framed
)
"""


def _packed(spark: SparkSession, d: str, budget: int) -> DataFrame:
    t = M.threads(spark, d).join(M.sources(spark, d), "source_id").select(F.col("id").alias("thread_id"), F.col("kind").alias("source"), "title", "project")
    return packing.pack(M.message_rows(spark, d, "role", "text", "tool_name"), budget, t, repeated=True).join(t.select("thread_id"), "thread_id", "left_semi")


@query(_pack_sql(BUDGET) + "SELECT thread_id, mode, turns, packed FROM packed")
def packed_all(spark: SparkSession, d: str) -> DataFrame:
    """Every thread's transcript within a budget."""
    return _packed(spark, d, BUDGET)


@query(_pack_sql(BUDGET) + "SELECT thread_id, mode, turns, packed FROM packed WHERE mode <> 'ends'")
def packed_whole(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts that fit the budget with or without tool rows."""
    return _packed(spark, d, BUDGET).where("mode != 'ends'")


@query(R._BM25_SQL + _pack_sql(EXCERPT) + ", hit AS (SELECT thread_id, min(rank) AS rank FROM kw WHERE rank <= 30 GROUP BY thread_id ORDER BY rank LIMIT 5) SELECT row_number() OVER (ORDER BY hit.rank)::INT AS n, thread_id, packed AS excerpt FROM hit JOIN packed USING (thread_id)")
def ask_context(spark: SparkSession, d: str) -> DataFrame:
    """What a question is answered from: the first five threads among thirty hits, each packed into 2500 bytes."""
    return notes.answer_context(R._search(spark, d, R.QUERY, 30), _packed(spark, d, EXCERPT))


@query(_NOTES_SQL + _pack_sql(BUDGET) + "SELECT p.thread_id, CASE WHEN n.notes IS NOT NULL AND n.notes <> '' THEN n.notes || chr(10) || '---' || chr(10) || packed ELSE packed END AS payload FROM packed p JOIN t ON t.id = p.thread_id LEFT JOIN notes n ON n.project = t.project")
def cli_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a thread is opened with elsewhere: its project's memory and its packed transcript."""
    project = M.threads(spark, d).select(F.col("id").alias("thread_id"), "project")
    packed = _packed(spark, d, BUDGET).join(project, "thread_id")
    return notes.snapshot(packed, "cli", 0, memory_notes(spark, d)).select("thread_id", F.col("body").alias("payload"))


_SNAPSHOTS_SQL = (
    _pack_sql(BUDGET)
    + """, snaps AS (
  SELECT p.thread_id, t.project, coalesce(t.title, 'snapshot') AS label, packed AS body, (strlen(packed) // 4)::BIGINT AS token_estimate, coalesce(t.updated_at, 0) AS created_at FROM packed p JOIN t ON t.id = p.thread_id
  UNION ALL SELECT p.thread_id, t.project, 'auto · ' || k, packed, (strlen(packed) // 4)::BIGINT, coalesce(t.updated_at, 0) + k FROM packed p JOIN t ON t.id = p.thread_id, (VALUES (1), (2)) v(k)
), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, starts_with(label, 'auto · ') ORDER BY created_at DESC, label) AS r FROM snaps) WHERE r = 1 OR NOT starts_with(label, 'auto · '))
"""
)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of each thread under its title, and two automatic ones of which the later is kept."""
    t = M.threads(spark, d).select(F.col("id").alias("thread_id"), "title", "project", F.coalesce("updated_at", F.lit(0)).alias("at"))
    body = notes.snapshot(_packed(spark, d, BUDGET), "", 0).drop("label", "created_at").join(t, "thread_id")
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.coalesce("title", F.lit("snapshot")) if n == 0 else F.lit(f"auto · {n}")).alias("label")) for n in range(3)])).alias("k")
    rows = body.select("thread_id", "project", "body", "token_estimate", "at", k)
    return notes.rolling(rows.select("thread_id", "project", F.col("k.label").alias("label"), "body", "token_estimate", (F.col("at") + F.col("k.n")).alias("created_at")), "auto · ")


@query(_SNAPSHOTS_SQL + "SELECT thread_id, project, label, token_estimate, created_at FROM kept WHERE project ILIKE '%harbor%'")
def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots of projects by a part of their name; automatic ones but the latest of a thread are gone."""
    return _snapshots(spark, d).where(F.col("project").ilike("%harbor%")).select("thread_id", "project", "label", "token_estimate", "created_at")


@query(_SNAPSHOTS_SQL + "SELECT thread_id, label, body FROM kept WHERE thread_id = (SELECT min(id) FROM t)")
def snapshot_load(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "threads").agg(F.min("id")).scalar()
    return _snapshots(spark, d).where(F.col("thread_id") == first).select("thread_id", "label", "body")


# ---------------------------------------------------------------- bundles of statistics


@query("SELECT (SELECT count(*) FROM t) AS threads, (SELECT count(*) FROM m) AS messages, (SELECT count(DISTINCT message_id) FROM chunks) AS embedded, (SELECT count(*) FROM m WHERE role IN ('user', 'assistant')) AS embeddable, (SELECT min(created_at) FROM t) AS first_at, (SELECT max(updated_at) FROM t) AS last_at")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    """Threads, messages, messages with and for vectors, and the span of all threads; each count is one aggregate of its table."""
    m = M.messages(spark, d, "role").agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role").isin("user", "assistant")).alias("e")).alias("s")).scalar()
    embedded = read(spark, d, "chunks").agg(F.countDistinct("message_id")).scalar()
    t = M.threads(spark, d).agg(F.count(F.lit(1)).alias("threads"), F.min("created_at").alias("first_at"), F.max("updated_at").alias("last_at"))
    return t.select("threads", m.getField("n").alias("messages"), embedded.alias("embedded"), m.getField("e").alias("embeddable"), "first_at", "last_at")


@query("SELECT 'source' AS section, kind AS name, messages AS n FROM (" + SQL["stats_sources"].removeprefix(M.BASE_SQL) + ") UNION ALL SELECT 'role', role, n FROM (" + SQL["stats_roles"].removeprefix(M.BASE_SQL) + ") UNION ALL SELECT 'project', project_path, n FROM (" + SQL["top_projects"].removeprefix(M.BASE_SQL) + ")")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Messages by source and role and threads by project, in one table."""
    parts = [("source", R.stats_sources(spark, d), "kind", "messages"), ("role", R.stats_roles(spark, d), "role", "n"), ("project", R.top_projects(spark, d), "project_path", "n")]
    rows = [df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(n).cast("bigint").alias("n")) for section, df, name, n in parts]
    return rows[0].union(rows[1]).union(rows[2])


@query("SELECT day, n, CASE WHEN n > 0.66 * best THEN 4 WHEN n > 0.33 * best THEN 3 WHEN n > 0.12 * best THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS level FROM (SELECT *, max(n) OVER () AS best FROM (" + SQL["heatmap"].removeprefix(M.BASE_SQL) + "))")
def coach_days(spark: SparkSession, d: str) -> DataFrame:
    """The heatmap's days with their level against the busiest; the week's decisions and gotchas are weekly_digest."""
    days = R.heatmap(spark, d)
    best, n = R.heatmap(spark, d).agg(F.max("n")).scalar(), F.col("n")
    return days.select("day", "n", F.when(n > 0.66 * best, 4).when(n > 0.33 * best, 3).when(n > 0.12 * best, 2).when(n > 0, 1).otherwise(0).alias("level"))


# ---------------------------------------------------------------- vectors


_WINDOWS_SQL = """, p AS (SELECT id, text FROM m WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND id NOT IN (SELECT message_id FROM chunks WHERE message_id IS NOT NULL)
), x AS (SELECT id, text, unnest(range(0, CASE WHEN length(text) <= 1600 THEN 1 ELSE ceil((length(text) - 1600) / 1400.0)::BIGINT + 1 END)) AS chunk_no FROM p
), y AS (SELECT id, chunk_no, coalesce(regexp_extract_all(lower(substring(text, chunk_no * 1400 + 1, 1600)), '[\\p{L}\\p{N}]+'), []) AS ts FROM x
), b AS (SELECT id, chunk_no, list_transform(ts, lambda w: ('0x' || substring(md5(w), 1, 6))::BIGINT % 8) AS bs FROM y)
"""


@query(_WINDOWS_SQL + "SELECT id AS message_id, chunk_no::INT AS chunk_no, array_to_string(list_transform(range(0, 8), lambda k: len(list_filter(bs, lambda v: v = k))), ',') AS counts FROM b")
def vectors_to_write(spark: SparkSession, d: str) -> DataFrame:
    """Every window of the messages that have no vector yet, by the hashing encoder: its words' counts in eight buckets, before they are brought to unit length."""
    pending = M.messages(spark, d, "role", "text").join(R.pending_vectors(spark, d).select("id"), "id", "left_semi")
    return V.chunk_windows(pending, None).select(F.col("id").alias("message_id"), "chunk_no", F.array_join(V.hashed_counts(F.col("chunk"), 8), ",").alias("counts"))


@query("SELECT fact_id, kind FROM facts WHERE kind IN ('decision', 'gotcha') AND NOT hidden AND fact_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_fact_vectors(spark: SparkSession, d: str) -> DataFrame:
    f = M.facts(spark, d).where("kind IN ('decision', 'gotcha') AND NOT hidden")
    return f.join(M.fact_vectors(spark, d), "fact_id", "left_anti").select("fact_id", "kind")


@query(
    R._FACT_QS_SQL
    + """, best AS (SELECT query_id, rec.thread_id, max(similarity) AS similarity FROM rec WHERE rec.kind IN ('decision', 'gotcha') AND similarity >= 0.1 AND rec.thread_id <> query_id % 240 + 1 GROUP BY ALL)
SELECT query_id, thread_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, thread_id) AS r FROM best) WHERE r <= 2"""
)
def proactive_recall(spark: SparkSession, d: str) -> DataFrame:
    """For each query vector the two threads with the most similar fact that the session hasn't seen, which is here the fact's own thread. The floor is a parameter, 0.62 by default."""
    near = R._recall_all(spark, d, ("decision", "gotcha"), "thread_id", 0.1)
    seen = near.select("query_id", (F.col("query_id") % 240 + 1).alias("thread_id")).distinct()
    found = near.select("query_id", F.col("owner").alias("thread_id"), "similarity")
    return V.proactive(found, seen, 0.1)


# ---------------------------------------------------------------- extraction and links


_LINES_SQL = ", li AS (SELECT id, thread_id, seq, role, ts, generate_subscripts(ls, 1) AS line_no, trim(unnest(ls), ' ' || chr(9) || chr(13)) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM m WHERE text IS NOT NULL))"


_TODOS_SQL = (
    _LINES_SQL
    + r""", raw AS (
  SELECT *, CASE WHEN regexp_matches(line, '^[-*] \[ ?\]') THEN regexp_extract(line, '^[-*] \[ ?\] ?(.*)$', 1)
    WHEN regexp_matches(lower(line), '(^|[^a-z0-9])todo([^a-z0-9]|$)') THEN regexp_replace(regexp_extract(line, '(?i)(?:^|[^a-z0-9])todo(|[^a-z0-9].*)$', 1), '^[: \t)(.*-]+', '')
    WHEN regexp_matches(lower(line), '(^|[^a-z0-9])fixme([^a-z0-9]|$)') THEN regexp_replace(regexp_extract(line, '(?i)(?:^|[^a-z0-9])fixme(|[^a-z0-9].*)$', 1), '^[: \t)(.*-]+', '') END AS r FROM li
), good AS (SELECT *, trim(r, ' ' || chr(9) || chr(13)) AS todo FROM raw WHERE r IS NOT NULL), first_todos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, lower(todo) ORDER BY seq, line_no) AS n FROM good WHERE length(todo) >= 4 AND NOT regexp_matches(todo, '\\n|\||","|[{}]')) WHERE n = 1)
"""
)


@query(_TODOS_SQL + "SELECT thread_id, seq, todo FROM first_todos")
def thread_todos(spark: SparkSession, d: str) -> DataFrame:
    """All different todos of each thread, in whole."""
    return X.todos(M.message_rows(spark, d, "text")).select("thread_id", "seq", "todo")


@query(_TODOS_SQL + f"SELECT thread_id, seq, CASE WHEN length(todo) > {X.TODO_SHOWN} THEN substring(todo, 1, {X.TODO_SHOWN}) || '…' ELSE todo END AS todo FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq, line_no, lower(todo)) AS k FROM first_todos) WHERE k <= {X.TODOS_A_THREAD}")
def thread_todos_capped(spark: SparkSession, d: str) -> DataFrame:
    """The display report of the todos: 25 a thread, cut to 240 characters."""
    return X.todos_shown(X.todos(M.message_rows(spark, d, "text"))).select("thread_id", "seq", "todo")


_STARTS = " OR ".join(f"starts_with(h, '{s}')" for s in X.ERROR_STARTS)
_PARTS = " OR ".join(f"contains(h, '{s}')" for s in X.ERROR_PARTS)
_ERRORS_SQL = (
    _LINES_SQL.replace("WHERE text IS NOT NULL", f"WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])({X.ERROR_WORDS})([^\\p{{L}}\\p{{N}}]|$)')")
    + f""", er AS (
  SELECT * FROM (SELECT *, lower(substring(line, 1, 64)) AS h FROM li WHERE role IN ('user', 'tool') AND strlen(line) BETWEEN 6 AND 400 AND thread_id IN (SELECT id FROM t WHERE NOT is_subagent)) WHERE ({_STARTS} OR {_PARTS})
), ke AS (
  SELECT id, thread_id, ts, array_to_string(list_filter(list_transform(list_transform(string_split_regex(line, '\\s+'), lambda w: trim(w, ',;)([]')), lambda w:
    CASE WHEN contains(w, '/') OR (contains(w, chr(92)) AND length(w) > 3) THEN '<path>' WHEN regexp_matches(w, '^["''`]') THEN '''…''' WHEN regexp_full_match(regexp_replace(w, '^0x', ''), '[0-9a-fA-F]{{6,}}') THEN '<n>' ELSE lower(w) END), lambda w: w <> ''), ' ') AS key FROM er
), one AS (SELECT DISTINCT id, thread_id, ts, key FROM ke)
"""
)


def _errors(spark: SparkSession, d: str, test=X.is_error, candidates=X.error_candidates) -> DataFrame:
    m = M.message_rows(spark, d, "role", "text", "ts").where(F.col("role").isin("user", "tool") & F.col("text").isNotNull())
    t = M.threads(spark, d).where(~F.col("is_subagent")).select(F.col("id").alias("thread_id"))
    return X.error_lines(candidates(m).join(t, "thread_id", "left_semi"), test)


@query(_ERRORS_SQL + "SELECT key, count(*) AS n, count(DISTINCT thread_id) AS threads FROM one GROUP BY key")
def error_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of error line of user and tool messages, with the messages and threads that have it."""
    return _errors(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("thread_id").alias("threads"))


@query(_ERRORS_SQL.replace(f"({_STARTS} OR {_PARTS})", "contains(line, ' ERROR ')") + "SELECT key, count(*) AS n, count(DISTINCT thread_id) AS threads FROM one GROUP BY key")
def log_error_keys(spark: SparkSession, d: str) -> DataFrame:
    """error_keys for the lines of logs at level ERROR, which the rules for error lines don't take."""
    return _errors(spark, d, lambda line: F.contains(line, F.lit(" ERROR "))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("thread_id").alias("threads"))


@query(_ERRORS_SQL + "SELECT key, count(*) AS n, count(DISTINCT thread_id) AS threads, min(ts) AS first_seen, max(ts) AS last_seen FROM one WHERE ts IS NOT NULL GROUP BY key HAVING count(*) >= 2 ORDER BY n DESC, last_seen DESC, key LIMIT 20")
def recurring_issues(spark: SparkSession, d: str) -> DataFrame:
    """The error lines that most messages have, of those in two or more."""
    return X.recurring(_errors(spark, d), 20).drop("example")


@query(
    _ERRORS_SQL.replace(f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])({X.ERROR_WORDS})([^\\p{{L}}\\p{{N}}]|$)')", "contains(text, 'return')").replace(f"({_STARTS} OR {_PARTS})", "contains(line, 'return')")
    + "SELECT key, count(*) AS n, count(DISTINCT thread_id) AS threads, min(ts) AS first_seen, max(ts) AS last_seen FROM one WHERE ts IS NOT NULL GROUP BY key HAVING count(*) >= 2 ORDER BY n DESC, last_seen DESC, key LIMIT 20"
)
def recurring_returns(spark: SparkSession, d: str) -> DataFrame:
    """recurring_issues for the lines that say `return`, as texts without error lines leave that one empty."""
    said = lambda c: F.contains(c, F.lit("return"))
    return X.recurring(_errors(spark, d, said, lambda m: m.where(said(F.col("text")))), 20).drop("example")


@query(R._ALL_LINKS_SQL + ", p AS (SELECT id AS thread_id, project FROM t) SELECT thread_id, sha, overlap, 'new' AS written FROM links JOIN p USING (thread_id) WHERE project ILIKE '%harbor%' UNION ALL SELECT thread_id, sha, 0, 'old' FROM (SELECT thread_id, sha FROM links JOIN p USING (thread_id) WHERE NOT coalesce(project ILIKE '%harbor%', false))")
def links_after_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """The stored links when those of some projects are written anew: theirs go and the new ones come, all others stay.

    The links are computed once, into the shared folder: they are read three times, and three times their plan is more than a small driver holds.
    """
    project = M.threads(spark, d).select(F.col("id").alias("thread_id"), "project")
    links = cut(R._links(spark, d, None, None).join(project, "thread_id").select("thread_id", "sha", "project", "overlap"))
    stored = links.withColumns({"overlap": F.lit(0).cast("bigint"), "written": F.lit("old")})
    fresh = links.where(F.col("project").ilike("%harbor%")).withColumn("written", F.lit("new"))
    return store.rewrite_partitions(stored, fresh, "project").select("thread_id", "sha", "overlap", "written")
