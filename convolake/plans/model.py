"""The canonical tables of the corpus, as lazy DataFrames over the stored ones.

Repeated rows count once, only the latest index state of a thread counts, and epochs are seconds. User state, tags and facts are
tables of their own (threads_user, thread_tags, facts); where a folder lacks one, `sources.stand_ins` derives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.operators import extraction
from convolake.sources import stand_ins
from convolake.tables import epoch_seconds, exists, read


def sources(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sources").select(F.col("id").alias("source_id"), "kind")


def threads(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each thread by last_indexed_at; max over structs aggregates before the shuffle."""
    t = read(spark, d, "threads")
    order = ["last_indexed_at", "updated_at", "message_count"]
    rest = [c for c in t.columns if c not in order and c != "id"]
    latest = t.groupBy("id").agg(F.max(F.struct(*order, *rest)).alias("s")).select("id", "s.*")
    return latest.withColumn("project", F.coalesce("project_key", "project_path"))


def message_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """id, thread_id, seq and the columns asked for, repeated rows still repeated.

    For operators that reduce a text to little before they need each message once: they drop the repeats after the text is gone.
    """
    return read(spark, d, "messages").select("id", "thread_id", "seq", *[epoch_seconds(F.col("ts")).alias("ts") if c == "ts" else F.col(c) for c in columns])


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """id, thread_id, seq and the columns asked for, each message once; unneeded columns are never read or shuffled."""
    return message_rows(spark, d, *columns).dropDuplicates(["id"])


def threads_user(spark: SparkSession, d: str) -> DataFrame:
    """A row a thread with a user's state: starred and the knowledge drawn from it."""
    return read(spark, d, "threads_user") if exists(spark, d, "threads_user") else stand_ins.threads_user(threads(spark, d))


def threads_with_user(spark: SparkSession, d: str) -> DataFrame:
    """threads with their user state; a thread without one isn't starred and has no knowledge."""
    t = threads(spark, d)
    if not exists(spark, d, "threads_user"):  # the stand-in is a function of the thread's own row and needs no join
        return stand_ins.threads_user(t, keep=True)
    both = t.join(threads_user(spark, d).withColumnRenamed("thread_id", "id"), "id", "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("starred", "knowledge_extracted")})


def thread_tags(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "thread_tags").select("thread_id", "tag") if exists(spark, d, "thread_tags") else stand_ins.thread_tags(threads(spark, d))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions, gotchas, todos and summaries with their whole texts and curation."""
    return read(spark, d, "facts") if exists(spark, d, "facts") else stand_ins.facts(read(spark, d, "documents"))


def mentions(spark: SparkSession, d: str, repeated: bool = False) -> DataFrame:
    """(thread_id, path) of all paths of each thread: the table file_mentions where the folder has one, else drawn from the texts.

    repeated: equal ones may come as often as they are there, for operators that drop repeats themselves.
    """
    if exists(spark, d, "file_mentions"):
        return read(spark, d, "file_mentions").select("thread_id", "path")
    rows = message_rows(spark, d, "text")
    return extraction.all_paths(rows).select("thread_id", "path") if repeated else extraction.paths(rows)


def fact_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the facts whose id is that of a vector."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding", "label")


BASE_SQL = (
    """
WITH t AS (
  SELECT * EXCLUDE (rn), coalesce(project_key, project_path) AS project, id % 4 = 0 AS starred FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC NULLS LAST, updated_at DESC NULLS LAST, message_count DESC NULLS LAST) AS rn FROM threads
  ) WHERE rn = 1
), m AS (
  SELECT DISTINCT id, thread_id, seq, role, text, tool_name, model, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens,
    CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END AS ts FROM messages
), vecs AS (
  SELECT DISTINCT message_id, chunk_no, embedding FROM chunks
)"""
    + stand_ins.SQL
    + "\n"
)
