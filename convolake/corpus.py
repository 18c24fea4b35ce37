"""One object for a folder of tables, whose methods return lazy DataFrames.

Reading methods are the doors of the engine: search, related, hybrid, recall, prior work, statistics, worklists, bundles. Writing ones
(`star`, `tag`, `complete_todo`, `record`, `snapshot`, `delete`) write the overlay tables of the folder and leave the archive's own as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.operators import extraction, fulltext, gitlink, notes, packing, store
from convolake.operators import vector as V
from convolake.plans import knowledge_queries as K
from convolake.plans import model
from convolake.plans import reference_queries as R
from convolake.plans.reference_queries import search_filters
from convolake.tables import exists, read


class Corpus:
    def __init__(self, spark: SparkSession, folder: str, index: str | None = None) -> None:
        """A folder of tables; `index` is the path of a stored full-text index, which searches then read in place of the texts."""
        self.spark, self.folder = spark, folder
        self._index = fulltext.Index(spark, index) if index else None

    # ------------------------------------------------------------ threads and messages

    def threads(self, **filters) -> DataFrame:
        """Threads by subagents, sources, project (a part of its name), project_is (the whole), starred and tags."""
        return search_filters(model.threads(self.spark, self.folder), self.spark, self.folder, **filters)

    def messages(self, *columns: str) -> DataFrame:
        return model.messages(self.spark, self.folder, *(columns or ("role", "text", "tool_name", "ts")))

    def recent(self, limit: int = 100, **filters) -> DataFrame:
        return self.threads(**filters).orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(min(limit, fulltext.MOST))

    def thread(self, thread_id: int) -> DataFrame:
        return self.messages().where(F.col("thread_id") == thread_id).orderBy("seq")

    def header(self, thread_id: int) -> DataFrame:
        return K.thread_headers(self.spark, self.folder).where(F.col("id") == thread_id)

    def tags(self) -> DataFrame:
        return R.tag_counts(self.spark, self.folder).orderBy(F.col("n").desc(), "tag")

    def projects(self) -> DataFrame:
        return K.project_coverage(self.spark, self.folder).orderBy(F.col("updated_at").desc_nulls_last())

    def cleanup_candidates(self, before: int, limit: int = 100) -> DataFrame:
        t = model.threads(self.spark, self.folder).where(F.col("updated_at").isNull() | (F.col("updated_at") <= before))
        return t.orderBy(F.col("updated_at").asc_nulls_first(), "id").limit(limit)

    # ------------------------------------------------------------ search

    def search(self, query: str, limit: int = 100, after: int | None = None, before: int | None = None, **filters) -> DataFrame:
        """Ranked hits; a query of the form file:PATH finds threads by path, an empty one lists the recent threads."""
        if query.startswith("file:"):
            return self.threads_for_file(query[5:].strip(), limit)
        if not query.strip():
            return self.recent(limit, **filters)
        found = self._index.bm25(query) if self._index else fulltext.bm25(model.message_rows(self.spark, self.folder, "text"), query)
        scored = found.join(self.threads(**filters).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
        if after is not None or before is not None:
            times = model.message_rows(self.spark, self.folder, "ts").select("id", "ts").where((F.lit(after is None) | (F.col("ts") >= (after or 0))) & (F.lit(before is None) | (F.col("ts") <= (before or 0))))
            scored = scored.join(times, "id", "left_semi")
        return fulltext.ranked(scored, len(fulltext.query_terms(query)), limit)

    def nearest(self, vector: list[float], k: int = 50) -> DataFrame:
        return V.nearest(read(self.spark, self.folder, "chunks"), "message_id", vector, k)

    def related(self, vector: list[float], limit: int = 10, **filters) -> DataFrame:
        """Threads by their most similar message, between 1 and 50 of them."""
        limit = max(1, min(50, limit))
        owner = self.messages("role").select(F.col("id").alias("message_id"), "thread_id").join(self.threads(**filters).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
        near = V.nearest(read(self.spark, self.folder, "chunks").join(owner.select("message_id"), "message_id", "left_semi"), "message_id", vector, 8 * limit).join(owner, "message_id")
        best = near.groupBy("thread_id").agg(F.max(F.struct("similarity", (-F.col("message_id")).alias("m"))).alias("s"))
        return best.select("thread_id", (-F.col("s.m")).alias("message_id"), F.col("s.similarity").alias("similarity")).orderBy(F.col("similarity").desc(), "thread_id").limit(limit)

    def hybrid(self, query: str, vector: list[float], limit: int = 100, per_thread: int | None = fulltext.PER_THREAD, strict_filters: bool = False, **filters) -> DataFrame:
        """(id, thread_id, rrf): keyword hits and the nearest messages fused by their ranks, at most per_thread of a thread.

        The vectors' side heeds subagents, sources and project; with strict_filters stars and tags as well.
        """
        words = self.search(query, limit, **filters).select("id", "rank")
        own = filters if strict_filters else {k: v for k, v in filters.items() if k in ("subagents", "sources", "project", "project_is")}
        owner = self.messages("role").select("id", "thread_id").join(self.threads(**own).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
        near = V.nearest(read(self.spark, self.folder, "chunks").join(owner.select(F.col("id").alias("message_id")), "message_id", "left_semi"), "message_id", vector, max(limit, 50))
        fused = V.fuse(words, V.with_rank(near, F.col("similarity").desc(), F.col("message_id")).withColumnRenamed("message_id", "id"), "id")
        rows = fused.join(self.messages("role").select("id", "thread_id"), "id")
        if per_thread is not None:
            by = Window.partitionBy("thread_id").orderBy(F.col("rrf").desc(), "id")
            rows = rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= per_thread).drop("__n")
        return rows.orderBy(F.col("rrf").desc(), "id").limit(limit)

    # ------------------------------------------------------------ facts

    def facts(self) -> DataFrame:
        return model.facts(self.spark, self.folder)

    def recall(self, vector: list[float], kinds: tuple[str, ...] = ("decision", "gotcha"), project: str | None = None, k: int = 10, floor: float = V.RECALL_FLOOR) -> DataFrame:
        f = self.facts().where(~F.col("hidden") & F.col("kind").isin(*kinds))
        f = f if project is None else f.where(F.col("project") == project)
        near = V.nearest(model.fact_vectors(self.spark, self.folder).join(f.select("fact_id"), "fact_id", "left_semi"), "fact_id", vector, k, floor)
        return near.join(f, "fact_id").orderBy(F.col("similarity").desc(), "fact_id")

    def prior_work(self, vector: list[float], k: int = 8, floor: float = V.PRIOR_FLOOR) -> DataFrame:
        """(thread_id, n, best, kind, fact_id): threads by their decisions and gotchas like a text."""
        found = self.recall(vector, k=max(3 * k, 15), floor=floor)
        top = F.max_by(F.struct("kind", "fact_id"), F.struct("similarity", -F.col("fact_id")))
        rows = found.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"), top.alias("top"))
        return rows.select("thread_id", "n", "best", "top.kind", "top.fact_id").orderBy(F.col("best").desc(), "thread_id").limit(k)

    def check(self, vector: list[float], k: int = 8, floor: float = V.PRIOR_FLOOR) -> DataFrame:
        """Earlier decisions, with their rationale, that a new one may contradict."""
        return self.recall(vector, ("decision",), k=max(3 * k, 15), floor=floor).limit(k).select("fact_id", "project", "text", "rationale", "similarity")

    def open_todos(self, text: str = "", project_path: str | None = None, limit: int = 50) -> DataFrame:
        t = model.threads(self.spark, self.folder).select(F.col("id").alias("thread_id"), "title", "project_path")
        f = self.facts().where("kind = 'todo' AND status = 'open' AND NOT hidden").join(t, "thread_id", "left")
        f = f.where(F.col("text").ilike(f"%{text}%") | F.coalesce(F.col("title").ilike(f"%{text}%"), F.lit(False))) if text else f
        f = f if project_path is None else f.where(F.col("project_path").ilike(f"%{project_path}%"))
        return f.orderBy(F.col("created_at").desc(), F.col("fact_id").desc()).limit(limit)

    def knowledge(self, thread_id: int) -> DataFrame:
        return K.thread_knowledge(self.spark, self.folder).where(F.col("thread_id") == thread_id)

    def decisions(self, project: str) -> DataFrame:
        return K.project_decisions(self.spark, self.folder).where(F.col("project") == project).orderBy(F.col("created_at").desc(), F.col("fact_id").desc())

    def pending(self, limit: int = 25, project: str | None = None) -> DataFrame:
        t = K.pending_threads(self.spark, self.folder)
        return (t if project is None else t.where(F.col("project") == project)).orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(limit)

    def project_memory(self, most: int | None = 60) -> DataFrame:
        return notes.memory_markdown(K._memory(self.spark, self.folder), most)

    # ------------------------------------------------------------ files, errors, commits

    def mentions(self) -> DataFrame:
        """The paths of each thread, from the table file_mentions where there is one, else from the texts."""
        return model.mentions(self.spark, self.folder)

    def threads_for_file(self, path: str, limit: int = 40) -> DataFrame:
        return fulltext.threads_with_file(self.mentions(), model.threads(self.spark, self.folder), path, limit)

    def todos(self) -> DataFrame:
        return extraction.todos(model.message_rows(self.spark, self.folder, "text"))

    def recurring_issues(self, since: int = 0, limit: int = 20, **filters) -> DataFrame:
        m = model.message_rows(self.spark, self.folder, "role", "text", "ts").where(F.col("role").isin("user", "tool") & (F.col("ts") >= since))
        return extraction.recurring(extraction.error_lines(extraction.error_candidates(m).join(self.threads(**filters).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")), limit)

    def thread_commits(self) -> DataFrame:
        spans = gitlink.windows(model.threads(self.spark, self.folder), model.messages(self.spark, self.folder, "ts"))
        return gitlink.thread_commits(spans, self.mentions(), gitlink.clean_commits(read(self.spark, self.folder, "commits")), None)

    def linked_commits(self, thread_id: int) -> DataFrame:
        return self.thread_commits().where(F.col("thread_id") == thread_id).orderBy(F.col("committed_at").desc(), "sha")

    # ------------------------------------------------------------ statistics and bundles

    def stats(self) -> dict[str, DataFrame]:
        return {"totals": K.index_totals(self.spark, self.folder), "by": K.index_stats(self.spark, self.folder)}

    def coach(self) -> dict[str, DataFrame]:
        return {"days": K.coach_days(self.spark, self.folder), "week": K.weekly_digest(self.spark, self.folder)}

    def usage(self) -> DataFrame:
        return R.usage_by_model(self.spark, self.folder)

    def coverage(self) -> DataFrame:
        return R.vector_coverage(self.spark, self.folder)

    def packed(self, budget: int = 48_000) -> DataFrame:
        return K._packed(self.spark, self.folder, budget)

    def ask(self, question: str, complete: Callable[[str], str], vector: list[float] | None = None) -> tuple[str, list[int]]:
        """An answer from the first five threads of thirty hits, and these threads' ids; with a vector the hits are hybrid."""
        hits = self.search(question, 30) if vector is None else V.with_rank(self.hybrid(question, vector, 30), F.col("rrf").desc(), F.col("id"))
        return notes.answer(question, notes.answer_context(hits, self.packed(2500)), complete)

    def payload(self, thread_id: int, most: int = 25, budget: int = 48_000) -> DataFrame:
        """(thread_id, body, token_estimate): a thread's transcript after its project's memory, to open it elsewhere."""
        project = model.threads(self.spark, self.folder).where(F.col("id") == thread_id).select(F.col("id").alias("thread_id"), "project")
        memory = project.join(self.project_memory(most), "project").select("thread_id", "notes")
        return notes.snapshot(self.packed(budget).where(F.col("thread_id") == thread_id), "", 0, memory).drop("label", "created_at")

    def audit(self, shas: list[str], paths: list[str], since: int = 0) -> dict[str, DataFrame]:
        """What a reviewer asks of a change: threads by commit, threads by file, recurring errors and the notes of projects."""
        files = self.threads_for_file(paths[0], 40).withColumn("path", F.lit(paths[0])) if paths else self.threads().limit(0).withColumn("path", F.lit(""))
        for p in paths[1:]:
            files = files.unionByName(self.threads_for_file(p, 40).withColumn("path", F.lit(p)))
        return {"by_sha": gitlink.by_sha(self.thread_commits(), shas), "by_file": files, "recurring_errors": self.recurring_issues(since), "project_memory": self.project_memory(20)}

    # ------------------------------------------------------------ writing

    def _write(self, name: str, df: DataFrame) -> None:
        store.swap_write(self.spark, df, f"{self.folder}/{name}.parquet")

    def star(self, thread_id: int, on: bool = True) -> None:
        state = model.threads_user(self.spark, self.folder)
        one = self.spark.createDataFrame([(thread_id, on)], "thread_id bigint, __on boolean")
        both = state.join(one, "thread_id", "full_outer")
        self._write("threads_user", both.withColumn("starred", F.coalesce("__on", "starred")).drop("__on"))

    def tag(self, thread_id: int, tags: list[str]) -> None:
        new = self.spark.createDataFrame([(thread_id, tags)], "thread_id bigint, tags array<string>")
        self._write("thread_tags", store.set_tags(model.thread_tags(self.spark, self.folder), new))

    def edit_fact(self, fact_id: int, pinned: bool | None = None, hidden: bool | None = None, status: str | None = None, text: str | None = None) -> None:
        edits = self.spark.createDataFrame([(fact_id, pinned, hidden, status, text)], "fact_id bigint, pinned boolean, hidden boolean, status string, text string")
        self._write("facts", store.curate(self.facts(), edits))

    def complete_todo(self, fact_id: int, done: bool = True) -> None:
        self.edit_fact(fact_id, status="done" if done else "open")

    def record(self, project: str, kind: str, text: str) -> None:
        """One more fact, pinned, of the thread of notes that stands for the project."""
        f = self.facts()
        added = notes.record_fact(f.limit(0), project, kind, text)
        added = added.withColumns({"fact_id": F.coalesce(f.agg(F.max("fact_id")).scalar(), F.lit(0)) + 1, "project": F.lit(project), "status": F.lit("open"), "created_at": F.unix_timestamp()})
        self._write("facts", f.unionByName(added.select([F.col(c).cast(f.schema[c].dataType).alias(c) for c in f.columns])))

    def snapshot(self, thread_id: int, label: str | None, at: int, budget: int = 48_000) -> None:
        """Keeps a thread's packed transcript; of automatic ones (labels that begin with `auto · `) only the latest of a thread stays."""
        row = self.payload(thread_id, budget=budget).withColumns({"label": F.lit(label or "snapshot"), "created_at": F.lit(at).cast("bigint")})
        old = read(self.spark, self.folder, "snapshots") if exists(self.spark, self.folder, "snapshots") else row.limit(0)
        self._write("snapshots", notes.rolling(old.unionByName(row), "auto · "))

    def snapshots(self) -> DataFrame:
        return read(self.spark, self.folder, "snapshots").orderBy(F.col("created_at").desc(), "thread_id")

    def write_mentions(self) -> None:
        """Stores the paths of all threads, so that searches by file and links to commits read no texts."""
        self._write("file_mentions", extraction.paths(model.message_rows(self.spark, self.folder, "text")))

    def compact(self, *names: str, file_mb: int = 128) -> None:
        """Rewrites tables, all of the folder's own that are named, into files of about file_mb."""
        for name in names:
            store.compact(self.spark, f"{self.folder}/{name}.parquet", file_mb)

    def delete(self, ids: list[int]) -> None:
        """Removes threads and what belongs to them from the tables that the folder has; each is rewritten, and so compacted."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "thread_id bigint")
        messages = read(self.spark, self.folder, "messages").join(gone, "thread_id", "left_semi").select(F.col("id").alias("message_id")).distinct()
        if exists(self.spark, self.folder, "chunks"):
            self._write("chunks", read(self.spark, self.folder, "chunks").join(messages, "message_id", "left_anti"))
        names = [n for n in ("threads_user", "thread_tags", "facts", "file_mentions", "snapshots", "thread_windows", "messages", "threads") if exists(self.spark, self.folder, n)]
        for name, df in store.delete_threads({n: read(self.spark, self.folder, n) for n in names}, gone).items():
            self._write(name, df)
