"""Which conversations led to which commits: by project, time and the paths they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.tables import epoch_seconds

BEFORE, AFTER, DAY, PER_THREAD = 3600, 86_400, 86_400, 5
#: Levels of the tree over days; a cell of the top one is 2048 days wide.
LEVELS = 12


def clean_commits(commits: DataFrame) -> DataFrame:
    """Each commit once, its time in seconds and its project without slashes at the end; commits without project or time are left out."""
    c = commits.where("project_key IS NOT NULL AND committed_at IS NOT NULL")
    return c.select("sha", "short_sha", "subject", "files", F.regexp_replace(F.trim("project_key"), "/+$", "").alias("project"), epoch_seconds(F.col("committed_at")).alias("committed_at")).dropDuplicates(["sha"])


def windows(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """(thread_id, project, start_ts, end_ts) of the threads, no subagents, that have a dated message."""
    t = threads.where(~F.col("is_subagent") & F.col("project").isNotNull()).select(F.col("id").alias("thread_id"), F.regexp_replace(F.trim("project"), "/+$", "").alias("project"))
    span = messages.where("ts IS NOT NULL").groupBy("thread_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return t.join(span, "thread_id")


def suffixes(path: Column) -> Column:
    """The path itself and all of its endings that hold a slash."""
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.array_distinct(F.array_append(tails, path))


def cells(first: Column, last: Column) -> Column:
    """The span of days from first to last as an array of (level, cell) of a binary tree over days: at most two a level, and all of the top one.

    A day lies under exactly one of a span's cells, so spans and days meet once by equality, however long a span is.
    """
    width = lambda level: F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    low = lambda level: -F.floor(-first / width(level))
    high = lambda level: F.floor((last + 1) / width(level)) - 1
    two = lambda level: F.array(F.when(F.pmod(low(level), F.lit(2)) == 1, low(level)), F.when(F.pmod(high(level), F.lit(2)) == 0, high(level)))
    every = lambda level: F.when(low(level) <= high(level), F.when(level == LEVELS - 1, F.sequence(low(level), high(level))).otherwise(F.array_distinct(two(level)))).otherwise(F.array().cast("array<bigint>"))
    of = lambda level: F.transform(F.filter(every(level), lambda c: c.isNotNull()), lambda c: F.struct(level.alias("level"), c.alias("cell")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of))


def cells_of(day: Column) -> Column:
    """The (level, cell) under which a day lies, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.struct(level.alias("level"), F.floor(day / F.call_function("shiftleft", F.lit(1).cast("bigint"), level)).alias("cell")))


def meeting(rows: DataFrame, keys: Column) -> DataFrame:
    """rows under each of their (kind, key), with `at`, a hash of project, cell, kind and key, in place of cell and key."""
    under = rows.withColumn("k", F.explode(keys)).withColumn("at", F.xxhash64("project", "level", "cell", "k.kind", "k.key"))
    return under.drop("level", "cell", "k")


def thread_commits(spans: DataFrame, mentions: DataFrame, commits: DataFrame, most: int | None = PER_THREAD, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(thread_id, sha, committed_at, overlap): per thread the `most` commits (all, if None) that share most files, among those from `before` seconds (an hour) before to `after` (a day) after it.

    A mention and a file match if they are equal or one is an ending of the other at a slash, without regard to case. Both
    sides are joined by equality of (project, cell of days, ending), never pairwise: a thread stands under the few cells of its span, a
    commit under the cells of its day, a mention and a file under each of their endings, so a project with a third of all rows is spread
    over days and paths, and a thread of many years costs no more than two cells a level. There is one join, by a hash of these as one
    bigint, after which the rows are compared themselves. What a side is before it is exploded says nothing of its size after, so neither is
    ever broadcast: the estimate would send a side of any size through the driver.
    """
    day = lambda c: F.floor(c / DAY)
    by_cell = spans.withColumn("c", F.explode(cells(day(F.col("start_ts") - before), day(F.col("end_ts") + after)))).select("*", "c.*").drop("c")
    said = mentions.select("thread_id", F.lower("path").alias("mention")).distinct().join(by_cell.hint("merge"), "thread_id")
    changed = commits.select("sha", "project", "committed_at", F.explode("files").alias("f")).withColumn("file", F.lower("f")).drop("f").distinct()
    changed = changed.withColumn("c", F.explode(cells_of(day(F.col("committed_at"))))).select("*", "c.*").drop("c")
    mention, file = F.col("mention"), F.col("file")
    kinds = lambda endings, whole: F.concat(*[F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))) for kind, keys in ((0, endings), (1, whole))])
    said = meeting(said, kinds(suffixes(mention), F.filter(F.array(mention), lambda k: F.contains(k, F.lit("/")))))
    changed = meeting(changed, kinds(F.array(file), suffixes(file))).withColumnRenamed("project", "of")
    slash = F.lit("/")
    match = (mention == file) | (F.contains(file, slash) & F.endswith(mention, F.concat(slash, file))) | (F.contains(mention, slash) & F.endswith(file, F.concat(slash, mention)))
    in_time = F.col("committed_at").between(F.col("start_ts") - before, F.col("end_ts") + after)
    pairs = said.hint("merge").join(changed.hint("merge"), "at").where((F.col("project") == F.col("of")) & in_time & match)
    overlap = pairs.groupBy("thread_id", "sha", "committed_at").agg(F.countDistinct("file").alias("overlap"))
    if most is None:
        return overlap
    best = Window.partitionBy("thread_id").orderBy(F.col("overlap").desc(), F.col("committed_at").desc(), "sha")
    return overlap.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).drop("n")


def timeline(links: DataFrame, limit: int) -> DataFrame:
    """(sha, committed_at, threads, overlap): commits with their number of threads and best overlap, newest first."""
    rows = links.groupBy("sha", "committed_at").agg(F.count(F.lit(1)).alias("threads"), F.max("overlap").alias("overlap"))
    return rows.orderBy(F.col("committed_at").desc(), "sha").limit(limit)


def by_sha(links: DataFrame, needles: list[str] | DataFrame) -> DataFrame:
    """The links of commits whose sha begins with one of the needles, which are trimmed and lower-cased; blank ones match nothing.

    Needles are a list, or a table with the column needle for any number of them: the beginnings of each sha, of the lengths
    that needles have, are then joined by equality.
    """
    if isinstance(needles, DataFrame):
        wanted = needles.select(F.lower(F.trim("needle")).alias("needle")).where("needle <> ''").distinct()
        lengths = wanted.agg(F.collect_set(F.length("needle"))).scalar()  # no more than a sha has characters
        at = links.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("sha")))).where(F.array_contains(lengths, F.col("n")))
        at = at.withColumn("needle", F.col("sha").substr(F.lit(1), F.col("n"))).drop("n")
        return at.join(wanted.hint("merge"), "needle", "left_semi").drop("needle").distinct()
    test = F.lit(False)
    for n in [n.strip().lower() for n in needles if n and n.strip()]:
        test = test | F.col("sha").startswith(n)
    return links.where(test)
