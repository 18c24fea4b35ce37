"""Queries leave nothing out; the per-thread caps stand beside them as reports."""

import datetime

import pytest

import __spark_entry__ as entry
from convolake.operators import extraction as X
from convolake.operators import gitlink as G
from convolake.operators import packing
from convolake.operators import vector as V

DOC = "doc_id bigint, kind string, text string, project_key string, created_at timestamp"


@pytest.fixture
def notes(spark, tmp_path):
    long = "x" * 90
    rows = [(i, kind, text, "/p", datetime.datetime(2025, 1, 1)) for i, kind, text in ((1, "todo", long + " retry"), (2, "gotcha", long + " one"), (4, "gotcha", long + " two"), (5, "gotcha", long + " TWO"))]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a title", False)], "id bigint, title string, is_subagent boolean").selectExpr("id", "1L source_id", "'e' external_id", "title", "'/p' project_path", "'/p' project_key", "'' git_branch", "1L created_at", "1L updated_at", "1L message_count", "1L distillable_count", "1L bytes", "is_subagent", "1L last_indexed_at").write.parquet(f"{tmp_path}/threads.parquet")
    spark.createDataFrame([(i, [1.0, 0.0], 0) for i in (1, 2, 4)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_facts_keep_whole_texts(spark, notes):
    q = entry.queries()
    ids = lambda name: sorted(r.fact_id for r in q[name](spark, notes).collect())
    assert ids("open_todos") == [1]
    assert ids("project_memory") == [1, 2, 5]
    rows = q["weekly_digest"](spark, notes).collect()
    assert rows and all(len(r.text) == 94 for r in rows)


def test_every_query_vector_is_answered(spark):
    queries = spark.createDataFrame([(50, 0, [1.0, 0.0]), (50, 1, [0.0, 1.0]), (100, 0, [1.0, 1.0]), (150, 0, [0.0, 0.0])], "query_id bigint, query_no bigint, embedding array<float>")
    rows = spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 3, [1.0, 0.0]), (2, 8, [0.0, 2.0]), (3, 9, None), (4, 9, [0.0, 0.0]), (5, 9, [1.0])], "owner bigint, id bigint, embedding array<float>")
    got = {(r.query_id, r.query_no, r.owner, r.similarity, r.id) for r in V.nearest_of_all(queries, rows, 0.35, 1).collect()}
    assert got == {(50, 0, 1, 1.0, 3), (50, 1, 2, 1.0, 8), (100, 0, 1, 0.707107, 3)}
    assert {(r.query_id, r.owner, r.n) for r in V.nearest_of_all(queries, rows, 0.35).collect()} == {(50, 1, 2), (50, 2, 1), (100, 1, 2), (100, 2, 1)}


def test_all_paths_of_a_thread(spark):
    text = " ".join(f"src/a{i}.rs" for i in range(250))
    m = spark.createDataFrame([(1, 1, 0, text)], "thread_id bigint, id bigint, seq bigint, text string")
    assert X.paths(m).count() == 250 and X.paths(m, X.PATHS_A_THREAD).count() == 200


def test_all_commits_of_a_thread(spark):
    spans = spark.createDataFrame([(1, "/p", 1000, 2000)], "thread_id bigint, project string, start_ts bigint, end_ts bigint")
    commits = spark.createDataFrame([(f"c{i}", "/p", 1500, ["src/a.rs"]) for i in range(9)], "sha string, project string, committed_at bigint, files array<string>")
    mentions = spark.createDataFrame([(1, "src/a.rs")], "thread_id bigint, path string")
    assert G.thread_commits(spans, mentions, commits, None).count() == 9 and G.thread_commits(spans, mentions, commits).count() == 5


def test_windows_reach_the_end(spark):
    text = "".join(chr(97 + i % 26) for i in range(60_000))
    last = V.chunk_windows(spark.createDataFrame([(1, text)], "id bigint, text string"), None).orderBy("chunk_no").collect()
    assert len(last) == 43 and text.endswith(last[-1].chunk) and last[-1].chunk_no == 42


def test_all_todos_in_whole(spark):
    text = "\n".join(f"TODO: {'w' * 300} number {i}" for i in range(40))
    found = X.todos(spark.createDataFrame([(1, 1, 0, text)], "thread_id bigint, id bigint, seq bigint, text string"))
    assert sorted(int(r.todo.split()[-1]) for r in found.collect()) == list(range(40))
    assert {len(r.todo) for r in X.todos_shown(found).collect()} == {241} and X.todos_shown(found).count() == 25


def test_notes_of_a_project_are_not_joined_to_threads_before_their_transcripts(spark):
    df = entry.queries()["cli_payload"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    last = next(x for x in plan if "Join " in x)
    assert "LeftOuter, (project#" in last and df.count() == df.select("thread_id").distinct().count()


def test_links_are_computed_once_for_a_rewrite(spark):
    df = entry.queries()["links_after_rewrite"](spark, "/root/testdata/sf0.001")
    assert "Relation [" not in df._jdf.queryExecution().optimizedPlan().toString()  # all of it reads the links that are kept
    assert df.select("thread_id", "sha").distinct().count() == df.count()


def test_repeated_messages_are_packed_once(spark):
    m = spark.createDataFrame([(1, 7, 0, "user", "a"), (2, 7, 1, "tool", "b"), (2, 7, 1, "tool", "b")], "id bigint, thread_id bigint, seq bigint, role string, text string")
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(packing.pack(m, 6000, repeated=True)) == rows(packing.pack(m.distinct(), 6000)) and rows(packing.pack(m, 6000, repeated=True))[0][2] == 2
