"""Stand-ins for tables that an archive may lack: user state, tags and curation of facts.

An archive that has them is read as it is (see `plans.model.overlay`). For one that has only transcripts and notes these rules derive
them from ids, so that every query runs; SQL holds the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("auth", "wip", "perf", "docs", "infra")
#: Number of threads over which notes without a thread are spread.
SPREAD = 240


def _mod(c: str, n: int):
    return F.pmod(c, F.lit(n))


def threads_user(threads: DataFrame, keep: bool = False) -> DataFrame:
    """(thread_id, starred, knowledge_extracted, knowledge_extracted_at, knowledge_msg_count, knowledge_error), or with `keep` these beside the thread's own columns."""
    extracted = _mod("id", 3) == 0
    return threads.select(
        "*" if keep else F.col("id").alias("thread_id"), (_mod("id", 4) == 0).alias("starred"), extracted.alias("knowledge_extracted"), F.when(extracted, F.col("id") + 1_736_000_000).alias("knowledge_extracted_at"),
        F.when(extracted, F.col("distillable_count") - F.when(_mod("id", 2) == 0, 1).otherwise(0)).alias("knowledge_msg_count"), F.when(_mod("id", 17) == 0, "timeout").alias("knowledge_error"),
    )


def thread_tags(threads: DataFrame) -> DataFrame:
    """(thread_id, tag): up to three tags a thread."""
    numbers = F.array_distinct(F.array(*[F.pmod(F.col("id") * k + k, F.lit(len(TAGS))) for k in (1, 2, 3)]))
    return threads.select(F.col("id").alias("thread_id"), F.explode(numbers).alias("n")).select("thread_id", F.element_at(F.array(*map(F.lit, TAGS)), (F.col("n") + 1).cast("int")).alias("tag"))


def facts(documents: DataFrame) -> DataFrame:
    """Notes of the kinds decision, gotcha, todo and summary as facts with their whole texts."""
    doc = documents.where(F.col("kind").isin("decision", "gotcha", "todo", "summary") & F.col("text").isNotNull())
    return doc.select(
        F.col("doc_id").alias("fact_id"), (_mod("doc_id", SPREAD) + 1).alias("thread_id"), "kind", "text", F.when(_mod("doc_id", 5) == 0, F.concat(F.lit("because of "), F.col("doc_id").cast("string"))).alias("rationale"),
        F.rtrim("project_key").alias("project"), F.when((F.col("kind") == "todo") & (_mod("doc_id", 3) == 0), "done").otherwise("open").alias("status"),
        F.when(F.col("kind") == "todo", "rule").when(_mod("doc_id", 9) == 0, "agent").otherwise("llm").alias("extractor"), _mod("doc_id", 7).alias("seq"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created_at"),
        (_mod("doc_id", 11) == 0).alias("pinned"), (_mod("doc_id", 19) == 0).alias("edited"), (_mod("doc_id", 13) == 0).alias("hidden"),
    )


SQL = """, u AS (
  SELECT id AS thread_id, id % 4 = 0 AS starred, id % 3 = 0 AS knowledge_extracted, CASE WHEN id % 3 = 0 THEN id + 1736000000 END AS knowledge_extracted_at,
    CASE WHEN id % 3 = 0 THEN distillable_count - CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END END AS knowledge_msg_count, CASE WHEN id % 17 = 0 THEN 'timeout' END AS knowledge_error FROM t
), tags AS (
  SELECT DISTINCT t.id AS thread_id, ['auth', 'wip', 'perf', 'docs', 'infra'][(t.id * k + k) % 5 + 1] AS tag FROM t, (VALUES (1), (2), (3)) v(k)
), facts AS (
  SELECT doc_id AS fact_id, doc_id % 240 + 1 AS thread_id, kind, text, CASE WHEN doc_id % 5 = 0 THEN 'because of ' || doc_id END AS rationale, rtrim(project_key) AS project,
    CASE WHEN kind = 'todo' AND doc_id % 3 = 0 THEN 'done' ELSE 'open' END AS status, CASE WHEN kind = 'todo' THEN 'rule' WHEN doc_id % 9 = 0 THEN 'agent' ELSE 'llm' END AS extractor,
    doc_id % 7 AS seq, floor(epoch(created_at))::BIGINT AS created_at, doc_id % 11 = 0 AS pinned, doc_id % 19 = 0 AS edited, doc_id % 13 = 0 AS hidden
  FROM documents WHERE kind IN ('decision', 'gotcha', 'todo', 'summary') AND text IS NOT NULL
)"""
