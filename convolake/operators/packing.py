"""Packing a thread's transcript into a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL, LEAST, SPARE = 6, 6, 300, 64
OMITTED, CUT = "tool calls/output omitted", "\n… (truncated) …"


def _rendered(role: Column, tool: Column, text: Column) -> Column:
    """A turn under a heading that names its role, or the tool that was called."""
    head = F.when(tool.isNotNull(), F.concat(F.lit("tool: "), tool)).when(role == "tool", "tool result").otherwise(role)
    return F.concat(F.lit("### "), head, F.lit("\n"), text, F.lit("\n"))


def _head(thread: str = "thread_id") -> Column:
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))
    return F.concat(F.lit("<reference_thread"), attribute("source", F.col("source")), attribute("title", F.col("title")), attribute("project", F.col("project")), F.lit(">"))


def pack(messages: DataFrame, budget: int, threads: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """(thread_id, mode, turns, packed): all turns if they fit into `budget` bytes, else those that are no tool's, else the first and last six, each cut short.

    messages: thread_id, seq, role, text and, if there, tool_name; threads: thread_id, source, title and project, which the head of the
    envelope names (blank where missing). Elided turns leave a line that counts them; what still is too long is cut to the budget. Only rows
    that fit the budget, or twelve of a thread, are ever collected into one value, so the longest thread does not
    matter. Null texts are empty; threads without messages have no row. repeated: messages, with id, may come more than once; for the sizes
    the repeats are dropped when the texts are gone.
    """
    tool_name = F.col("tool_name") if "tool_name" in messages.columns else F.lit(None).cast("string")
    m = messages.select(*["id"] * repeated, "thread_id", "seq", F.coalesce("role", F.lit("")).alias("role"), tool_name.alias("tool_name"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumns({"line": _rendered(F.col("role"), F.col("tool_name"), F.col("text")), "tool": F.col("tool_name").isNotNull() | (F.col("role") == "tool")})
    size = F.octet_length("line") + 1  # a line break between turns
    counted = m.select(*["id"] * repeated, "thread_id", "tool", size.alias("size"))
    if repeated:
        counted, m = counted.dropDuplicates(["id"]), m.drop("line", "tool").dropDuplicates(["id"]).drop("id")
        m = m.withColumns({"line": _rendered(F.col("role"), F.col("tool_name"), F.col("text")), "tool": F.col("tool_name").isNotNull() | (F.col("role") == "tool")})
    size = F.col("size")
    sizes = counted.groupBy("thread_id").agg(F.sum(size).alias("all_bytes"), F.coalesce(F.sum(F.when(~F.col("tool"), size)), F.lit(0)).alias("talk_bytes"), F.count_if(~F.col("tool")).alias("talk"), F.count(F.lit(1)).alias("n"))
    if threads is None:
        sizes = sizes.withColumns(dict.fromkeys(("source", "title", "project"), F.lit("")))
    else:
        about = threads.select("thread_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("project", F.lit("")).alias("project"))
        sizes = sizes.join(about, "thread_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("source", "title", "project")})
    close = F.lit("\n</reference_thread>")
    sizes = sizes.withColumn("head", _head())
    frame = F.octet_length("head") + 1 + F.octet_length(close)  # the turns' own breaks are one less than the turns
    note_bytes = len(f"\n<!-- {OMITTED} -->")
    mode = F.when(F.col("all_bytes") - 1 + frame <= budget, "full").when(F.greatest(F.col("talk_bytes") - 1, F.lit(0)) + frame + note_bytes <= budget, "no_tools").otherwise("ends")
    kept_turns = F.when(F.col("talk") > HEAD + TAIL, HEAD + TAIL).otherwise(F.least("talk", F.lit(HEAD)))
    sizes = sizes.withColumns({"mode": mode, "elided": F.col("talk") - kept_turns}).select("thread_id", "mode", "head", "elided", "talk")
    whole = m.join(sizes.where("mode != 'ends'"), "thread_id").where((F.col("mode") == "full") | ~F.col("tool")).select("thread_id", "seq", "line", F.lit(False).alias("after"))
    cap = max(LEAST, budget // (HEAD + TAIL + 1))
    long = m.where(~F.col("tool")).join(sizes.where("mode = 'ends'"), "thread_id")
    short = F.when(F.length("text") > cap, F.concat(F.substring("text", 1, cap), F.lit("…"))).otherwise(F.col("text"))
    first = long.withColumn("k", F.row_number().over(Window.partitionBy("thread_id").orderBy("seq"))).where(F.col("k") <= HEAD).withColumn("after", F.lit(False))
    last = long.where(F.col("talk") > HEAD + TAIL).withColumn("k", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("seq").desc()))).where(F.col("k") <= TAIL).withColumn("after", F.lit(True))
    ends = first.unionByName(last).select("thread_id", "seq", F.concat(F.lit("### "), F.col("role"), F.lit("\n"), short, F.lit("\n")).alias("line"), "after")
    turns = whole.unionByName(ends).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line", "after"))).alias("rows"))
    rows = sizes.join(turns, "thread_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<seq:bigint,line:string,after:boolean>>")))
    text = lambda after: F.array_join(F.transform(F.filter("rows", lambda x: x["after"] == after), lambda x: x["line"]), "\n")
    elided = F.when(F.col("elided") > 0, F.concat(F.lit("\n\n### … "), F.col("elided").cast("string"), F.lit(" turns elided …\n\n"))).otherwise("")
    tail = text(True)
    body = F.concat(text(False), F.when(F.col("mode") == "ends", F.concat(elided, F.when(tail != "", F.concat(F.lit("\n"), tail)).otherwise(""))).otherwise(""))
    note = F.when(F.col("mode") == "no_tools", OMITTED).when(F.col("mode") == "ends", F.concat(F.lit("trimmed to fit budget; "), F.col("elided").cast("string"), F.lit(" middle turns elided, tools omitted")))
    head = F.concat("head", F.coalesce(F.concat(F.lit("\n<!-- "), note, F.lit(" -->")), F.lit("")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": body})
    too_long = (F.col("mode") == "ends") & (F.octet_length(F.concat("head", "body", close)) > budget)
    fitted = F.when(too_long, F.concat(F.substring("body", 1, max(0, budget - SPARE)), F.lit(CUT))).otherwise(F.col("body"))
    return rows.select("thread_id", "mode", F.size("rows").alias("turns"), F.concat("head", fitted, close).alias("packed"))
