"""What is drawn from message texts by rule: todos, file paths, error lines and their normal form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TODOS_A_THREAD, TODO_SHOWN, PATHS_A_THREAD = 25, 240, 200
# The endings of files named without a slash, and the marks of an error line.
ENDINGS = (
    "rs ts tsx js jsx mjs cjs py go java kt rb php c cc cpp h hpp cs swift sql sh bash zsh toml yaml yml json "
    "md mdx css scss html xml lock cfg ini vue svelte proto gradle ex exs scala dart lua"
).split()
ERROR_STARTS = ("error[", "error:", "error ", "fatal:", "fatal error", "panic:")
ERROR_PARTS = (
    "error:", "exception:", "panicked at", "traceback (most recent call last)", "command not found", "undefined reference",
    "cannot find", "assertion failed", "assertion `", "no such file", "segmentation fault",
)


def lines(messages: DataFrame, *keep: str) -> DataFrame:
    """(*keep, line_no, line): the lines of each text without the blanks around them."""
    return messages.select(*keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))


def todos(messages: DataFrame) -> DataFrame:
    """(thread_id, id, seq, line_no, todo): unchecked boxes and TODO or FIXME marks, cleaned; per thread all that differ, in whole."""
    rows = lines(messages, "thread_id", "id", "seq")
    box = F.regexp_extract("line", r"^[-*] \[ ?\] ?(.*)$", 1)
    mark = F.regexp_extract("line", r"(?i)(?:^|[^a-z0-9])todo(|[^a-z0-9].*)$", 1)
    fix = F.regexp_extract("line", r"(?i)(?:^|[^a-z0-9])fixme(|[^a-z0-9].*)$", 1)
    stripped = lambda c: F.regexp_replace(c, r"^[: \t)(.*-]+", "")
    raw = F.when(F.col("line").rlike(r"^[-*] \[ ?\]"), box).when(F.col("line").rlike(r"(?i)(^|[^a-z0-9])todo([^a-z0-9]|$)"), stripped(mark)).when(F.col("line").rlike(r"(?i)(^|[^a-z0-9])fixme([^a-z0-9]|$)"), stripped(fix))
    t = F.btrim(raw, F.lit(" \t\r"))
    rows = rows.withColumn("todo", t).where((F.length("todo") >= 4) & ~F.col("todo").rlike(r'\\n|\||","|[{}]'))
    return first_of(rows, "todo", None, ["seq", "line_no"])


def todos_shown(todos: DataFrame) -> DataFrame:
    """For display: the first 25 todos of a thread, cut to 240 characters."""
    short = F.when(F.length("todo") > TODO_SHOWN, F.concat(F.col("todo").substr(1, TODO_SHOWN), F.lit("…"))).otherwise(F.col("todo"))
    return first_of(todos, "todo", TODOS_A_THREAD, ["seq", "line_no"]).withColumn("todo", short)


def first_of(rows: DataFrame, value: str, most: int | None, order: list[str]) -> DataFrame:
    """Per thread the first `most` values (all, if None) that differ in lower case; doubles go before the per-thread window, on the map side."""
    others = [c for c in rows.columns if c != "thread_id"]
    once = rows.groupBy("thread_id", F.lower(value).alias("__key")).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("s"))
    flat = once.select("thread_id", "__key", "s.*")
    if most is None:
        return flat.select("thread_id", *others)
    by = Window.partitionBy("thread_id").orderBy(*order, "__key")
    return flat.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= most).select("thread_id", *others)


def all_paths(messages: DataFrame) -> DataFrame:
    """(thread_id, seq, word_no, path): every path of every text, as often as it is there."""
    words = F.split("text", r"""[\s()\[\]{}"'`,;<>|=]+""")
    rows = messages.where("text IS NOT NULL").select("thread_id", "seq", F.posexplode(words).alias("word_no", "path"))
    rows = rows.withColumn("path", F.btrim("path", F.lit(".:*#!?@")))
    ending = F.substring_index("path", ".", -1)
    stem = F.expr("substring(path, 1, length(path) - length(substring_index(path, '.', -1)) - 1)")
    good = F.octet_length("path").between(3, 200) & ~F.contains("path", F.lit("://")) & F.contains("path", F.lit(".")) & ending.rlike("^[A-Za-z0-9]+$") & ~ending.rlike("^[0-9]+$") & (F.length(stem) > 0)
    return rows.where(good & (F.contains("path", F.lit("/")) | F.lower(ending).isin(*ENDINGS)))


def paths(messages: DataFrame, most: int | None = None) -> DataFrame:
    """(thread_id, path): the different paths of a thread, or the first `most`, with the case first seen."""
    return first_of(all_paths(messages), "path", most, ["seq", "word_no"]).select("thread_id", "path")


def normal_error(line: Column) -> Column:
    """An error line with paths, quoted texts and addresses as placeholders, so that the same error is one key."""

    def token(w: Column) -> Column:
        t = F.btrim(w, F.lit(",;)([]"))
        bare = F.regexp_replace(t, "^0x", "")
        return (
            F.when(F.contains(t, F.lit("/")) | (F.contains(t, F.lit("\\")) & (F.length(t) > 3)), "<path>")
            .when(t.rlike("^[\"'`]"), "'…'")
            .when(bare.rlike("^[0-9a-fA-F]{6,}$"), "<n>")
            .otherwise(F.lower(t))
        )

    return F.array_join(F.filter(F.transform(F.split(line, r"\s+"), token), lambda x: x != ""), " ")


def is_error(line: Column) -> Column:
    head = F.lower(F.substring(line, 1, 64))
    starts, parts = ("|".join(re.escape(p) for p in marks) for marks in (ERROR_STARTS, ERROR_PARTS))
    return head.rlike(f"^(?:{starts})|(?:{parts})")


#: The words, and their forms, of which a message must hold one before its lines are looked at.
ERROR_WORDS = r"errors?|panick(?:ed|ing)|exceptions?|tracebacks?|fatal"


def error_candidates(messages: DataFrame) -> DataFrame:
    """The messages whose text holds one of ERROR_WORDS as a word; the others, almost all, are never cut into lines."""
    return messages.where(F.col("text").rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{ERROR_WORDS})(?![\p{{L}}\p{{N}}])"))


def error_lines(messages: DataFrame, test: Callable[[Column], Column] = is_error) -> DataFrame:
    """(thread_id, id, ts, key, line): each message's error lines, or those of another test, equal ones once (the first)."""
    rows = lines(messages, "thread_id", "id", "ts").where(F.octet_length("line").between(6, 400) & test(F.col("line")))
    keyed = rows.withColumn("key", normal_error(F.col("line")))
    return keyed.groupBy("thread_id", "id", "ts", "key").agg(F.min_by("line", "line_no").alias("line"))


def recurring(errors: DataFrame, limit: int, least: int = 2) -> DataFrame:
    """(key, n, threads, first_seen, last_seen, example) of the errors of at least two messages; the example is the latest."""
    grouped = errors.where("ts IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("thread_id").alias("threads"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by("line", F.struct("ts", "id")).alias("example"),
    )
    return grouped.where(F.col("n") >= least).orderBy(F.col("n").desc(), F.col("last_seen").desc(), "key").limit(limit)
