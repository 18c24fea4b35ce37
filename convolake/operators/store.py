"""Writing: keyed upsert of threads with their messages, and overlays that a new index never touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def metrics(messages: DataFrame, repeated: str | None = None) -> DataFrame:
    """(thread_id, message_count, bytes, distillable_count) of each thread's messages.

    Where rows may come twice `repeated` names their id; texts are measured before repeats are dropped, so they never move.
    """
    m = messages.select("thread_id", "role", F.octet_length("text").alias("n"), *([repeated] if repeated else []))
    if repeated:
        m = m.dropDuplicates([repeated])
    return m.groupBy("thread_id").agg(F.count(F.lit(1)).alias("message_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.count_if(F.col("role").isin("user", "assistant")).alias("distillable_count"))


def change_kinds(old: DataFrame, new: DataFrame) -> DataFrame:
    """(thread_id, change): for each thread of `new` whether it is new, the same, longer by appended rows only, or replaced.

    Both have thread_id, seq and text. A thread is an append if every stored row stands in the new parse as it was.
    """
    o = old.select("thread_id", "seq", F.col("text").alias("old_text"), F.lit(True).alias("in_old")).join(new.select("thread_id").distinct(), "thread_id", "left_semi")
    n = new.select("thread_id", "seq", F.col("text").alias("new_text"), F.lit(True).alias("in_new"))
    both = n.join(o, ["thread_id", "seq"], "full_outer")
    kept = F.bool_and(F.col("in_old").isNull() | (F.col("in_new").isNotNull() & F.col("old_text").eqNullSafe(F.col("new_text"))))
    sums = both.groupBy("thread_id").agg(kept.alias("prefix"), F.count("in_old").alias("n_old"), F.count("in_new").alias("n_new"))
    kind = F.when(F.col("n_old") == 0, "new").when(F.col("prefix") & (F.col("n_old") == F.col("n_new")), "same").when(F.col("prefix"), "append").otherwise("replace")
    return sums.select("thread_id", kind.alias("change"))


def upsert(stored: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """`stored` with the rows of the keys in `parsed` replaced; parsed rows count once. The caller writes it beside and swaps."""
    return stored.join(parsed.select(*keys).distinct(), keys, "left_anti").unionByName(parsed.dropDuplicates(), allowMissingColumns=True)


def with_overlay(base: DataFrame, overlay: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """`base` with the overlay's columns, and their defaults where it has no row, so that a new index keeps stars and curation."""
    joined = base.join(overlay.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c, default in columns.items()})


def delete_threads(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given threads: threads by id, the others by thread_id."""
    gone = ids.select(F.col("thread_id")).distinct()
    return {name: t.join(gone.withColumnRenamed("thread_id", key), key, "left_anti") for name, t in tables.items() for key in ["id" if name == "threads" else "thread_id"]}


def swap_write(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes df beside `path` and puts it in its place, so that df may read from path and readers see the old or the new table."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    beside, old, here = (jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".new", path + ".old", path))
    fs = here.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(beside, here)
    fs.delete(old, True)


def compact(spark: SparkSession, path: str, file_mb: int = 128) -> None:
    """Rewrites a table into files of about file_mb, as many as its present size asks for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    swap_write(spark, spark.read.parquet(path).repartition(max(1, -(-size // (file_mb << 20)))), path)


# ---------------------------------------------------------------- knowledge


def distillable() -> Column:
    """Threads worth distilling: no subagents, of four messages or more."""
    return ~F.col("is_subagent") & (F.col("message_count") >= 4)


def stale(null_is_stale: bool = False) -> Column:
    """Whether a thread's knowledge is missing or older than its messages. An unknown count is not stale in lists, but is for a single thread (null_is_stale)."""
    other = ~F.col("knowledge_msg_count").eqNullSafe(F.col("distillable_count")) if null_is_stale else F.col("knowledge_msg_count") != F.col("distillable_count")
    return F.col("knowledge_error").isNull() & (~F.col("knowledge_extracted") | F.coalesce(other, F.lit(False)))


def curated() -> Column:
    """Facts that a user has touched; a null flag is not set."""
    return F.coalesce("pinned", F.lit(False)) | F.coalesce("edited", F.lit(False)) | F.coalesce("hidden", F.lit(False))


def invalidate(facts: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, threads): of distilled threads whose messages have changed in number, the distilled facts that nobody curated are gone and the thread is to be distilled again.

    threads: id, knowledge_extracted, knowledge_msg_count, distillable_count. Threads that were never distilled, and whose counts agree, stay.
    """
    changed = F.col("knowledge_extracted") & F.coalesce(F.col("knowledge_msg_count") != F.col("distillable_count"), F.lit(False))
    again = threads.where(changed).select(F.col("id").alias("thread_id"), F.lit(True).alias("__again"))
    mine = F.col("__again").isNotNull() & (F.col("extractor") == "llm") & ~curated()
    kept = facts.join(again, "thread_id", "left").where(~F.coalesce(mine, F.lit(False))).drop("__again")
    return kept, threads.withColumn("knowledge_extracted", F.col("knowledge_extracted") & ~F.coalesce(changed, F.lit(False)))


def knowledge(facts: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, summary, decisions, gotchas, todos, stale) of each thread: texts joined by the character 31, pinned first, then by seq and id; the last summary wins."""
    f = facts.where("NOT hidden")
    place = F.struct((~F.col("pinned")).alias("later"), "seq", "fact_id", "text")
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, place))), lambda x: x["text"]), "\x1f") for k in ("decision", "gotcha", "todo")]
    some = [F.when(F.count_if(F.col("kind") == k) > 0, c).alias(f"{k}s") for k, c in zip(("decision", "gotcha", "todo"), lists)]
    # the last in the order pinned first is the last that isn't pinned, if there is one
    per_thread = f.groupBy("thread_id").agg(F.max(F.when(F.col("kind") == "summary", place)).getField("text").alias("summary"), *some)
    t = threads.select(F.col("id").alias("thread_id"), F.coalesce(F.col("knowledge_extracted") & ~F.col("knowledge_msg_count").eqNullSafe(F.col("distillable_count")), F.lit(False)).alias("stale"))
    return t.join(per_thread, "thread_id", "left").select("thread_id", "summary", "decisions", "gotchas", "todos", "stale")


def curate(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """facts after a user's edits (fact_id and any of pinned, hidden, status, text; null leaves as it is). Only todos have a status that can change; a new text marks the fact edited."""
    named = {c: f"__{c}" for c in ("pinned", "hidden", "status", "text") if c in edits.columns}
    both = facts.join(edits.select("fact_id", *[F.col(c).alias(n) for c, n in named.items()]), "fact_id", "left")
    new = {c: F.coalesce(F.col(n), F.col(c)) for c, n in named.items()}
    if "status" in named:
        new["status"] = F.when(F.col("kind") == "todo", new["status"]).otherwise(F.col("status"))
    if "text" in named:
        new["edited"] = F.coalesce("edited", F.lit(False)) | F.col("__text").isNotNull()
    return both.withColumns(new).drop(*named.values())


def set_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """(thread_id, tag): the tags of the threads in `new` (thread_id, tags array) replaced by these, trimmed, without blank and repeated ones."""
    fresh = new.select("thread_id", F.explode_outer("tags").alias("tag")).withColumn("tag", F.trim("tag")).where("tag <> ''").distinct()
    return tags.join(new.select("thread_id").distinct(), "thread_id", "left_anti").select("thread_id", "tag").unionByName(fresh)


def rewrite_partitions(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """`stored` with all rows of each key in `fresh` replaced by those of `fresh`; rows without a key stay."""
    return stored.join(fresh.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").unionByName(fresh)


def set_config(config: DataFrame, values: dict[str, str]) -> DataFrame:
    """(key, value) with some values set."""
    new = config.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return rewrite_partitions(config.select("key", "value"), new, "key")


def chat_thread(spark: SparkSession, turns: list[tuple[str, str]], at: int, external_id: str) -> tuple[DataFrame, DataFrame]:
    """(thread, messages) of a chat held here: its title is the start of the first user turn. Blank turns are left out; without turns both are empty."""
    said = [(role, text.strip()) for role, text in turns if text and text.strip()]
    first = next((text for role, text in said if role == "user"), None)
    title = first if first is None or len(first) <= 80 else first[:80] + "…"
    thread = [("in_app", external_id, title, at, len(said))] if said else []
    rows = [("in_app", external_id, n, role, text, at) for n, (role, text) in enumerate(said)]
    return spark.createDataFrame(thread, "source_kind string, external_id string, title string, created_at bigint, message_count bigint"), spark.createDataFrame(rows, "source_kind string, external_id string, seq bigint, role string, text string, ts bigint")
