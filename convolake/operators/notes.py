"""Facts, snapshots and exports: what is kept about threads beside their messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import text as X
from convolake.session import cut

FACTS = "thread_id bigint, kind string, text string, extractor string"


def distill(packed: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """FACTS of packed transcripts (thread_id, packed) by a completion function, which runs on the executors; failures give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tid, body in zip(batch["thread_id"], batch["packed"]):
                try:
                    answer = X.read_answer(complete(body))
                except Exception:  # noqa: BLE001, S112
                    continue
                rows += [(tid, "summary", answer["summary"], "llm")] if answer["summary"] else []
                rows += [(tid, kind, t, "llm") for kind, key in (("decision", "decisions"), ("gotcha", "gotchas")) for t in answer[key]]
            if rows:
                yield pd.DataFrame(rows, columns=["thread_id", "kind", "text", "extractor"])

    return packed.select("thread_id", "packed").mapInPandas(run, FACTS)


def store_distilled(facts: DataFrame, new: DataFrame) -> DataFrame:
    """`facts` with the distilled ones of the new threads replaced; curated facts and those of other extractors stay, blank ones never come in."""
    again = new.select("thread_id").distinct().withColumn("__again", F.lit(True))
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("pinned", "edited", "hidden")}
    kept = facts.join(again, "thread_id", "left").where(~((F.col("extractor") == "llm") & F.col("__again").isNotNull() & ~(flags["pinned"] | flags["edited"] | flags["hidden"]))).drop("__again")
    return kept.unionByName(new.where(F.trim("text") != "").withColumns(dict.fromkeys(flags, F.lit(False))), allowMissingColumns=True)


def record_fact(facts: DataFrame, project: str, kind: str, text: str) -> DataFrame:
    """`facts` with one more, pinned, of a thread of notes that stands for the project."""
    if kind not in ("decision", "gotcha"):
        raise ValueError("a recorded fact is a decision or a gotcha")
    one = facts.sparkSession.range(1).select(F.xxhash64(F.lit("notes"), F.lit(project)).alias("thread_id"), F.lit(kind).alias("kind"), F.lit(text).alias("text"), F.lit("agent").alias("extractor"), F.lit(True).alias("pinned"), F.lit(False).alias("edited"), F.lit(False).alias("hidden"))
    return facts.unionByName(one, allowMissingColumns=True)


def snapshot(packed: DataFrame, label: str, created_at: int, memory: DataFrame | None = None) -> DataFrame:
    """(thread_id, label, body, token_estimate, created_at) of packed threads, with a project's memory before them: (thread_id, notes), or (project, notes) where packed has the thread's project.

    By project, the notes of each project are joined once as they are, and never stand beside every thread in a relation of their own.
    """
    rows = packed if memory is None else packed.join(memory, "project" if "project" in memory.columns else "thread_id", "left")
    notes = F.lit(None).cast("string") if memory is None else F.col("notes")
    body = F.when(notes.isNotNull() & (notes != ""), F.concat(notes, F.lit("\n---\n"), F.col("packed"))).otherwise(F.col("packed"))
    return rows.select("thread_id", F.lit(label).alias("label"), body.alias("body"), X.token_estimate(body).alias("token_estimate"), F.lit(created_at).cast("bigint").alias("created_at"))


def rolling(snapshots: DataFrame, prefix: str = "auto") -> DataFrame:
    """Snapshots of which automatic ones (labels with the prefix) are kept only as the latest of a thread; others all stay."""
    auto = F.col("label").startswith(prefix)
    latest = Window.partitionBy("thread_id", auto).orderBy(F.col("created_at").desc(), "label")
    return snapshots.withColumn("__n", F.row_number().over(latest)).where(~auto | (F.col("__n") == 1)).drop("__n")


def memory_markdown(facts: DataFrame, most: int | None = 60) -> DataFrame:
    """(project, notes): a Markdown section a kind with at most `most` facts each (all, if None), pinned and newest first.

    facts: project, kind, text, pinned, created_at, fact_id. Only the facts kept are gathered into one value.
    """
    best = Window.partitionBy("project", "kind").orderBy(F.col("pinned").desc(), F.col("created_at").desc(), F.col("fact_id").desc())
    top = facts.where(F.col("kind").isin("decision", "gotcha", "todo")).withColumn("n", F.row_number().over(best)).where(F.lit(most is None) | (F.col("n") <= (most or 0)))
    heads = F.create_map(*[F.lit(x) for pair in (("decision", "## Decisions"), ("gotcha", "## Gotchas"), ("todo", "## Open todos")) for x in pair])
    sections = top.groupBy("project", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"))
    body = F.concat_ws("\n", F.element_at(heads, F.col("kind")), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), F.regexp_replace(r["text"], r"\s+", " "))), "\n"))
    return sections.select("project", "kind", body.alias("s")).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "s"))), lambda r: r["s"]), "\n\n").alias("notes"))


def with_block(existing: str, body: str, name: str) -> str:
    """`existing` with its one managed block of that name replaced, or added at the end; all other text stays."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    block = f"{begin}\n{body.strip()}\n{end}"
    a, b = existing.find(begin), existing.find(end)
    if 0 <= a < b:
        return existing[:a] + block + existing[b + len(end) :]
    return (existing.rstrip() + "\n\n" if existing.strip() else "") + block + "\n"


def thread_note(threads: DataFrame, packed: DataFrame) -> DataFrame:
    """(thread_id, file, note): each thread as a Markdown note with a head of its title, project and dates."""
    t = threads.select(F.col("id").alias("thread_id"), "title", "project", "created_at", "updated_at")
    rows = packed.select("thread_id", "packed").join(t, "thread_id")
    name = F.coalesce("title", F.concat(F.lit("thread "), F.col("thread_id").cast("string")))
    lines = [F.lit("---"), F.concat(F.lit("title: "), X.quoted(name)), F.concat(F.lit("project: "), X.quoted(F.coalesce("project", F.lit("")))), F.concat(F.lit("created: "), F.coalesce(X.day(F.col("created_at")), F.lit(""))), F.concat(F.lit("updated: "), F.coalesce(X.day(F.col("updated_at")), F.lit(""))), F.lit("---"), F.lit(""), F.col("packed")]
    return rows.select("thread_id", X.file_name(X.day(F.col("created_at")), name).alias("file"), F.concat_ws("\n", *lines).alias("note"))


def agent_notes(facts: DataFrame, briefs: DataFrame | None = None, most: int | None = 60) -> DataFrame:
    """(project, notes): a project's memory for an agent's own instructions: its name, a brief where there is one (project, answer), and a bold heading a kind over trimmed bullets."""
    best = Window.partitionBy("project", "kind").orderBy(F.col("pinned").desc(), F.col("created_at").desc(), F.col("fact_id").desc())
    top = facts.where(F.col("kind").isin("decision", "gotcha", "todo")).withColumn("n", F.row_number().over(best)).where(F.lit(most is None) | (F.col("n") <= (most or 0)))
    heads = F.create_map(*[F.lit(x) for pair in (("decision", "**Decisions:**"), ("gotcha", "**Gotchas:**"), ("todo", "**Open todos:**")) for x in pair])
    sections = top.groupBy("project", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"))
    body = F.concat_ws("\n", F.element_at(heads, F.col("kind")), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), F.trim(r["text"]))), "\n"), F.lit(""))
    whole = sections.select("project", "kind", body.alias("s")).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "s"))), lambda r: r["s"]), "\n").alias("body"))
    name = F.concat(F.lit("# "), X.base_name(F.col("project")), F.lit("\n"))
    if briefs is None:
        return whole.select("project", F.concat_ws("\n", name, "body").alias("notes"))
    both = whole.join(briefs.select("project", F.concat(F.trim("answer"), F.lit("\n")).alias("brief")), "project", "left")
    return both.select("project", F.concat_ws("\n", name, "brief", "body").alias("notes"))


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes each row's note into its file (columns file, note) in a folder that all executors share; null notes are left out, and a file's name never leaves the folder."""

    def write(part: Iterator) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in part:
            if r.note is not None and r.file:
                with open(os.path.join(folder, os.path.basename(r.file)), "w", encoding="utf-8", errors="replace") as f:
                    f.write(r.note)

    rows.select("file", "note").foreachPartition(write)


def answer_context(hits: DataFrame, packed: DataFrame, threads: int = 5) -> DataFrame:
    """(n, thread_id, excerpt): the first different threads of ranked hits, numbered from 1, with their transcripts, which the caller has packed into the excerpt's size."""
    first = hits.groupBy("thread_id").agg(F.min("rank").alias("rank")).orderBy("rank").limit(threads)
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy("rank")))  # over at most `threads` rows
    return packed.join(numbered, "thread_id").select("n", "thread_id", F.col("packed").alias("excerpt"))


# ---------------------------------------------------------------- by a completion function: complete(prompt) -> answer

ERROR = 160


def _completed(rows: DataFrame, key: str, body: str, complete: Callable[[str], str], prompt: Callable[[str], str]) -> DataFrame:
    """(key, answer, error) of each row, on the executors; of an error the first line, at most ERROR characters, and no answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b[key], b[body]):
                try:
                    out.append((k, str(complete(prompt(text or ""))), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, (str(e).strip().split("\n")[0] or type(e).__name__)[:ERROR]))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return rows.select(key, body).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, answer string, error string")


def synthesize(packed: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(thread_id, answer, error): each packed transcript as Markdown for export."""
    return _completed(packed, "thread_id", "packed", complete, lambda t: f"Write what this conversation settled as Markdown sections.\n\n{t}")


def project_brief(memory: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(project, answer, error): each project's notes as a brief."""
    return _completed(memory, "project", "notes", complete, lambda t: f"Write a brief of this project from its notes.\n\n{t}")


def answer(question: str, context: DataFrame, complete: Callable[[str], str]) -> tuple[str, list[int]]:
    """(answer, thread ids) to a question from the numbered excerpts of answer_context, of which there are a handful."""
    rows = context.orderBy("n").collect()
    excerpts = "\n\n".join(f"[thread {r.n}]\n{r.excerpt}" for r in rows)
    return complete(f"Answer from the excerpts and cite them by number.\n\nQuestion: {question}\n\n{excerpts}"), [r.thread_id for r in rows]


def conflicts(decisions: DataFrame, complete: Callable[[str], str], most: int = 60) -> DataFrame:
    """(project, a, b): pairs of fact ids that contradict each other, by a completion over a project's decisions, numbered by age in lists of about `most`.

    decisions: fact_id, project, text, created_at. A project with more decisions is dealt into several lists by hash, so none is left out, no prompt
    grows with the project and no task holds one; pairs are found within a list. Answers that can't be read give no pairs.
    """
    parts = decisions.groupBy("project").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    dealt = decisions.join(parts, "project").withColumn("part", F.pmod(F.xxhash64("fact_id"), F.col("parts")))
    lists = dealt.groupBy("project", "part").agg(F.array_sort(F.collect_list(F.struct("created_at", "fact_id", "text"))).alias("rows")).where(F.size("rows") > 1)
    body = F.array_join(F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["text"])), "\n")
    keyed = lists.select(F.struct("project", "part").alias("__key"), F.col("rows.fact_id").alias("ids"), body.alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, ids, text in zip(b["project"], b["ids"], b["body"]):
                try:
                    pairs = X.read_pairs(complete(f"Which of these decisions contradict each other? Answer with pairs of numbers.\n\n{text}"), len(ids))
                except Exception:  # noqa: BLE001, S112
                    continue
                out += [(project, int(ids[a - 1]), int(ids[c - 1])) for a, c in pairs]
            if out:
                yield pd.DataFrame(out, columns=["project", "a", "b"])

    return keyed.select(F.col("__key.project").alias("project"), "ids", "body").mapInPandas(run, "project string, a bigint, b bigint")


def distilled(packed: DataFrame, counts: DataFrame, complete: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(facts, state) of one drain of the worklist: the facts of `packed` threads, and of each thread whether they were drawn, at which count of messages, or the error.

    counts: thread_id, distillable_count. Answers are computed once and kept in the shared folder, so that both results agree.
    """
    done = cut(_completed(packed, "thread_id", "packed", complete, lambda t: t))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tid, text in zip(b["thread_id"], b["answer"]):
                a = X.read_answer(text)
                rows += [(tid, "summary", a["summary"], "llm")] if a["summary"] else []
                rows += [(tid, kind, t, "llm") for kind, key in (("decision", "decisions"), ("gotcha", "gotchas")) for t in a[key]]
            if rows:
                yield pd.DataFrame(rows, columns=["thread_id", "kind", "text", "extractor"])

    facts = done.where("error IS NULL").select("thread_id", "answer").mapInPandas(run, FACTS)
    state = done.join(counts.select("thread_id", "distillable_count"), "thread_id", "left")
    good = F.col("error").isNull()
    return facts, state.select("thread_id", good.alias("knowledge_extracted"), F.when(good, F.col("distillable_count")).alias("knowledge_msg_count"), F.col("error").alias("knowledge_error"))
