"""Queries of the llm operators, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.tables import read

from . import conversations, encoding, mixing, nearest_time, pii, sentences, splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages that come out in pieces; the pieces' own distinct would shuffle their texts, that of their ids does not."""
    return splitting.split_oversized(read(spark, d, "messages"), "id", "text").select(F.col("id").alias("message_id")).distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    long = read(spark, d, "messages").select("id", "text").where(splitting.oversized(F.col("text"))).dropDuplicates(["id"])
    return splitting.split_oversized(long, "id", "text").withColumnRenamed("id", "message_id")


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each message are numbered from 0 without a gap, cover its trimmed text, and keep limit and overlap."""
    rows = splitting.split_oversized(read(spark, d, "messages"), "id", "text").select(F.col("id").alias("message_id"), "piece_no", "start_pos", F.length("piece").alias("n")).distinct()
    by = Window.partitionBy("message_id").orderBy("piece_no")  # the pieces of one text
    end = F.col("start_pos") + F.col("n") - 1
    shared = F.lag(end).over(by) - F.col("start_pos") + 1
    rows = rows.withColumns({"end": end, "shared": F.coalesce(shared, F.when(F.col("start_pos") == 1, 0))})
    return rows.groupBy("message_id").agg(
        F.max("end").alias("n_chars"), (F.max("piece_no") + 1 == F.count(F.lit(1))).alias("numbered"), F.coalesce(F.min("shared") >= 0, F.lit(False)).alias("covered"),
        (F.max("n") <= splitting.LIMIT).alias("within_limit"), (F.max("shared") <= splitting.OVERLAP).alias("within_overlap"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped(read(spark, d, "oc_message"), read(spark, d, "oc_part"))


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(read(spark, d, "oc_message"), read(spark, d, "oc_part"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each mention once; repeated rows give equal mentions, which are dropped after the texts are gone."""
    found = pii.find_mentions(read(spark, d, "messages"), "id", "text", read(spark, d, "contributors"))
    return found.select(F.col("id").alias("message_id"), "pii_type", "start_pos").distinct()


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all messages with placeholders; repeated rows stay repeated. The key is the setting spark.convolake.pii.key; where it is unset a
    key is drawn, so that values are linked within one run only."""
    return pii.mask_texts(read(spark, d, "messages"), "id", "text", read(spark, d, "contributors"), _key(spark)).withColumnRenamed("id", "message_id")


def _key(spark: SparkSession) -> str:
    return spark.conf.get("spark.convolake.pii.key", None) or secrets.token_hex(32)


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether what stands between the placeholders of each text stands in the text itself, in order and from its first character to its last."""
    both = read(spark, d, "messages").select(F.struct("id", "text").alias("row"), "text")
    masked = pii.mask_texts(both, "row", "text", read(spark, d, "contributors"), _key(spark)).where("text IS NOT NULL")
    rest = F.split("text", r"\[(?:EMAIL|PHONE|NATIONAL_ID|ADDRESS|PERSON_NAME):[^\]]*\]")
    own, found = F.col("row.text"), lambda at, part: F.call_function("locate", part, F.col("row.text"), at)
    end = F.aggregate(rest, F.lit(1), lambda at, part: F.when((at > 0) & (found(at, part) > 0), found(at, part) + F.length(part)).otherwise(0))
    kept = F.startswith(own, F.get(rest, F.lit(0))) & F.endswith(own, F.element_at(rest, -1)) & (end > 0)
    return masked.select(F.col("row.id").alias("message_id"), kept.alias("kept")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_time.nearest_windows(read(spark, d, "commits"), read(spark, d, "thread_windows")).select("sha", "thread_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read(spark, d, "documents"), "doc_id", "text")


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_with_offsets(read(spark, d, "documents"), "doc_id", "text")


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether the tokens of each document begin and end with its text and leave nothing out; a character of several tokens belongs to each."""
    spans = p6_offsets(spark, d).select("doc_id", "starts", "ends").join(read(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), "doc_id")
    close = F.forall(F.zip_with("starts", "ends", lambda a, b: a < b), lambda x: x) & F.forall(F.zip_with(F.slice("starts", F.lit(2), F.size("starts")), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))), lambda a, b: a <= b), lambda x: x)
    whole = F.when(F.size("starts") == 0, F.col("n") == 0).otherwise((F.get("starts", F.lit(0)) == 0) & (F.element_at("ends", -1) == F.col("n")) & close)
    return spans.select("doc_id", whole.alias("whole"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return encoding.decode(p6_ids(spark, d), "doc_id", "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their share, from the report of the mix, whose solver leaves them at their cap."""
    return p7_report(spark, d).where("NOT feasible").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def p7_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps its cap and comes to its target to within one of its documents, or to its cap where it can't reach it."""
    copies, report = mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))
    longest = copies.groupBy("key").agg(F.max("tokens").alias("longest"))
    rows = report.withColumn("key", mixing.source_key(F.col("source"))).join(longest, "key", "left")
    total = report.agg(F.sum("tokens")).scalar()
    left = F.col("target_share") * total - F.col("mixed_tokens")
    near = F.when(F.col("feasible"), (left >= -1e-6) & (left < F.col("longest"))).otherwise(F.col("mixed_tokens") == F.col("max_repeats") * F.col("tokens"))
    return rows.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), F.coalesce(near, F.lit(False)).alias("near_target"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether the units of each document that isn't blank follow one another without sharing a character, and hold all that isn't white space."""
    dark = lambda c: F.length(F.translate(c, sentences.WHITE, ""))
    by = Window.partitionBy("doc_id").orderBy("start_pos")  # the units of one text
    units = p8_units(spark, d).select("doc_id", "start_pos", "n_chars", dark(F.col("unit")).alias("dark"))
    apart = F.coalesce(F.col("start_pos") >= F.lag(F.col("start_pos") + F.col("n_chars")).over(by), F.lit(True))
    found = units.withColumn("apart", apart).groupBy("doc_id").agg(F.sum("dark").alias("dark"), F.every("apart").alias("apart"))
    docs = read(spark, d, "documents").select("doc_id", dark(F.col("text")).alias("all")).where(F.col("all") > 0)
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce(F.col("dark") == F.col("all"), F.lit(False)).alias("covered"), F.coalesce("apart", F.lit(False)).alias("apart"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "start_pos")


def p8_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(read(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p2_conversations, p3_found, p3_masked, p3_kept, p5_found, p6_ids, p6_offsets, p6_cover, p6_decoded, p7_found, p7_mix, p7_report, p7_bounds, p8_found, p8_units, p8_cover)}

_TURNS = """
WITH m AS (
  SELECT DISTINCT session_id, id, CASE WHEN time_created >= 100000000000 THEN time_created ELSE time_created * 1000 END AS at_ms, data
  FROM oc_message WHERE session_id IS NOT NULL
), r AS (
  SELECT session_id, id, at_ms, CASE WHEN json_valid(data) THEN CASE WHEN json_type(data) = 'OBJECT' THEN data END END AS j FROM m
), k AS (
  SELECT session_id, id, at_ms, j IS NULL OR json_extract_string(j, '$.role') IS NULL AS damaged,
    CASE WHEN lower(json_extract_string(j, '$.role')) IN ('user', 'human') THEN 'user'
         WHEN lower(json_extract_string(j, '$.role')) IN ('assistant', 'model', 'ai') THEN 'assistant' END AS role,
    json_extract_string(j, '$.parentID') AS parent FROM r
), p AS (
  SELECT DISTINCT message_id, id AS part_id, json_extract_string(data, '$.text') AS text FROM oc_part
  WHERE json_extract_string(data, '$.type') = 'text' AND regexp_matches(json_extract_string(data, '$.text'), '[^\\s]')
), t AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, id) AS turn_no, row_number() OVER (PARTITION BY session_id ORDER BY at_ms DESC, id DESC) AS back
  FROM k WHERE role IS NOT NULL AND id IN (SELECT message_id FROM p)
), good AS (
  SELECT session_id FROM (SELECT DISTINCT session_id FROM k)
  WHERE session_id IN (SELECT session_id FROM t WHERE turn_no = 1 AND role = 'user')
    AND session_id IN (SELECT session_id FROM t WHERE back = 1 AND role = 'assistant')
    AND session_id NOT IN (SELECT session_id FROM k WHERE damaged)
    AND session_id NOT IN (SELECT a.session_id FROM k a WHERE a.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k b WHERE b.session_id = a.session_id AND b.id = a.parent))
)
"""

SQL = {
    "p1_found": r"SELECT DISTINCT id AS message_id FROM messages WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1600",
    "p1_cover": r"SELECT DISTINCT id AS message_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS n_chars, true AS numbered, true AS covered, true AS within_limit, true AS within_overlap FROM messages WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1600",
    "p2_found": _TURNS + "SELECT DISTINCT session_id FROM k WHERE session_id NOT IN (SELECT session_id FROM good)",
    "p2_conversations": _TURNS + "SELECT session_id, turn_no, role, at_ms, message_id, part_id, text FROM t JOIN good USING (session_id) JOIN p ON p.message_id = t.id",
    "p5_found": """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY indexed_at DESC) AS rn FROM thread_windows) WHERE rn = 1
), w AS (
  SELECT thread_id, regexp_replace(trim(project_key), '/+$', '') AS k, start_ts AS s, end_ts AS e FROM latest
  WHERE start_ts IS NOT NULL AND end_ts IS NOT NULL AND project_key IS NOT NULL
), c AS (
  SELECT DISTINCT sha, regexp_replace(trim(project_key), '/+$', '') AS k,
    CASE WHEN committed_at >= 100000000000 THEN committed_at // 1000 ELSE committed_at END AS t FROM commits WHERE project_key IS NOT NULL
), pairs AS (
  SELECT sha, thread_id, least(abs(t - s), abs(t - e)) AS dist FROM c JOIN w USING (k)
)
SELECT sha, thread_id FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY dist, thread_id) AS rn FROM pairs WHERE dist <= 7200) WHERE rn = 1
""",
    "p3_kept": "SELECT DISTINCT id AS message_id, true AS kept FROM messages WHERE text IS NOT NULL",
    "p6_cover": "SELECT doc_id, true AS whole FROM documents",
    "p7_bounds": "SELECT source, true AS within_repeats, true AS near_target FROM mix_targets",
    "p8_cover": f"SELECT doc_id, true AS covered, true AS apart FROM documents WHERE regexp_matches(text, '[^{''.join(f'{chr(92)}x{{{ord(c):x}}}' for c in sentences.WHITE)}]')",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
