import os

import pytest
from pyspark.sql import functions as F

from convolake.functions import text as X
from convolake.operators import notes, store

SMALL = "/root/testdata/sf0.001"
FACT = "thread_id bigint, kind string, text string, extractor string, pinned boolean, edited boolean, hidden boolean"


def test_text_helpers(spark):
    one = spark.range(1).select(
        X.title(F.lit("  " + "a" * 90)).alias("t"), X.project_key(F.lit(" /srv/a// ")).alias("p"), X.project_key(F.lit("  ")).alias("none"), X.base_name(F.lit("/srv/a/")).alias("b"), X.day(F.lit(0)).alias("d"),
        X.quoted(F.lit('a "b"\n\\c')).alias("q"), X.file_name(F.lit("2025-01-01"), F.lit("Fix: the Über-bug!")).alias("f"), X.turns(F.lit("### user\nhi\n### tool\n### no role here\nx\n")).alias("turns"), X.slug_to_path(F.lit("-srv-a")).alias("s"),
    ).first()
    assert one.t == "a" * 80 + "…" and (one.p, one.none, one.b, one.d, one.s) == ("/srv/a", None, "a", "1970-01-01", "/srv/a")
    assert one.q == '"a \\"b\\" \\\\c"' and one.f == "2025-01-01-fix-the-über-bug.md"
    assert [(t.role, t.text) for t in one.turns] == [("user", "hi"), ("tool", "### no role here\nx")]


def test_answers():
    assert X.read_answer('```json\n{"summary": " s ", "decisions": ["a", " ", 3], "gotchas": null}\n```') == {"summary": "s", "decisions": ["a"], "gotchas": []}
    assert X.read_answer("no json {") == {"summary": "no json {", "decisions": [], "gotchas": []} and X.read_answer(None)["summary"] == ""
    assert X.read_pairs('x [{"a": 3, "b": 1}, [1, 3], [2, 2], [1, 9]] y', 3) == [(1, 3)] and X.read_pairs("[", 3) == []


def test_distilled_facts_keep_what_was_curated(spark):
    old = spark.createDataFrame([(1, "decision", "old", "llm", False, False, False), (1, "decision", "pinned", "llm", True, False, False), (1, "todo", "t", "heuristic", None, None, None), (2, "gotcha", "other", "llm", False, False, False)], FACT)
    packed = spark.createDataFrame([(1, "x"), (3, "fail")], "thread_id bigint, packed string")

    def complete(body):
        if body == "fail":
            raise RuntimeError
        return '{"summary": "s", "decisions": ["new", " "]}'

    got = notes.store_distilled(old, notes.distill(packed, complete))
    assert sorted((r.thread_id, r.text) for r in got.collect()) == [(1, "new"), (1, "pinned"), (1, "s"), (1, "t"), (2, "other")]
    assert old.where(store.curated()).count() == 1
    more = notes.record_fact(old, "/p", "gotcha", "mind the gap").where("extractor = 'agent'").first()
    assert more.pinned and more.text == "mind the gap"
    with pytest.raises(ValueError):
        notes.record_fact(old, "/p", "todo", "x")


def test_what_a_completion_function_gives(spark):
    packed = spark.createDataFrame([(1, "x"), (3, "fail")], "thread_id bigint, packed string")

    def complete(prompt):
        if "fail" in prompt:
            raise RuntimeError("w" * 300 + "\nmore")
        return '{"summary": "s", "gotchas": ["g"]}' if prompt == "x" else f"[[1, 2]] {len(prompt)}"

    facts, state = notes.distilled(packed, spark.createDataFrame([(1, 7), (3, 9)], "thread_id bigint, distillable_count bigint"), complete)
    assert sorted((r.kind, r.text) for r in facts.collect()) == [("gotcha", "g"), ("summary", "s")]
    assert {r.thread_id: (r.knowledge_extracted, r.knowledge_msg_count, r.knowledge_error) for r in state.collect()} == {1: (True, 7, None), 3: (False, None, "w" * 160)}
    assert {r.thread_id: (r.answer is None, r.error is None) for r in notes.synthesize(packed, complete).collect()} == {1: (False, True), 3: (True, False)}
    assert notes.project_brief(spark.createDataFrame([("/p", "n")], "project string, notes string"), complete).first().error is None
    context = spark.createDataFrame([(2, 8, "two"), (1, 9, "one")], "n int, thread_id bigint, excerpt string")
    assert notes.answer("why?", context, lambda p: p.index("[thread 1]") < p.index("[thread 2]") and "why?" in p) == (True, [9, 8])
    decisions = spark.createDataFrame([(i, "/p", f"d{i}", i) for i in range(5)] + [(9, "/q", "alone", 1)], "fact_id bigint, project string, text string, created_at bigint")
    assert [(r.project, r.a, r.b) for r in notes.conflicts(decisions, complete).collect()] == [("/p", 0, 1)]  # the two oldest
    many = spark.range(400).selectExpr("id fact_id", "'/p' project", "'d' text", "id created_at")
    lists = notes.conflicts(many, lambda p: str([[1, p.count(". d")]]), most=20)
    assert 15 <= lists.count() <= 20 and all(r.a < r.b for r in lists.collect())


def test_snapshots_and_exports(spark, tmp_path):
    packed = spark.createDataFrame([(1, "body"), (2, None)], "thread_id bigint, packed string")
    memory = spark.createDataFrame([(1, "notes")], "thread_id bigint, notes string")
    first = notes.snapshot(packed, "by hand", 1)
    rows = first.unionByName(notes.snapshot(packed, "auto · a", 2)).unionByName(notes.snapshot(packed, "auto · b", 3, memory))
    kept = sorted((r.thread_id, r.label) for r in notes.rolling(rows).collect())
    assert kept == [(1, "auto · b"), (1, "by hand"), (2, "auto · b"), (2, "by hand")]
    assert rows.where("thread_id = 1 AND created_at = 3").first().body == "notes\n---\nbody" and first.where("thread_id = 1").first().token_estimate == 1
    facts = spark.createDataFrame([("/p", "decision", f"d{i}", i == 2, i, i) for i in range(5)] + [("/p", "gotcha", "g\nh", False, 1, 8), ("/p", "summary", "no", False, 1, 9)], "project string, kind string, text string, pinned boolean, created_at bigint, fact_id bigint")
    assert notes.memory_markdown(facts, 2).first().notes == "## Decisions\n- d2\n- d4\n\n## Gotchas\n- g h"
    briefs = spark.createDataFrame([("/p", " In brief. ")], "project string, answer string")
    assert notes.agent_notes(facts, briefs, 1).first().notes == "# p\n\nIn brief.\n\n**Decisions:**\n- d2\n\n**Gotchas:**\n- g\nh\n"
    files = spark.createDataFrame([("a.md", "x"), ("../b.md", "y"), ("c.md", None)], "file string, note string")
    notes.write_files(files, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "x", "b.md": "y"}
    once = notes.with_block("mine\n", "a", "notes")
    twice = notes.with_block(once, "b", "notes")
    assert once.count("begin notes") == twice.count("begin notes") == 1 and twice.startswith("mine\n") and "\nb\n" in twice and "\na\n" not in twice
    threads = spark.createDataFrame([(1, "T: x", "/p", 0, None), (2, None, None, None, None)], "id bigint, title string, project string, created_at bigint, updated_at bigint")
    got = {r.thread_id: r for r in notes.thread_note(threads, packed).collect()}
    assert got[1].file == "1970-01-01-t-x.md" and got[1].note.startswith('---\ntitle: "T: x"\nproject: "/p"') and got[2].file == "thread-2.md"
    hits = spark.createDataFrame([(1, 3), (2, 1), (1, 2)], "thread_id bigint, rank int")
    assert [(r.n, r.thread_id) for r in notes.answer_context(hits, packed).orderBy("n").collect()] == [(1, 2), (2, 1)]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_corpus(spark):
    from convolake.corpus import Corpus

    c = Corpus(spark, SMALL)
    hits = c.search("watcher", 20)
    assert 0 < hits.count() <= 20
    per = hits.groupBy("thread_id").count().agg(F.max("count")).first()[0]
    assert per <= 3 and c.search("", 5).count() == 5 and c.search("file:main", 5).count() > 0
    assert c.search("watcher", 20, after=10**12).count() == 0
    first = c.recent(1).first().id
    assert c.thread(first).count() >= 0 and c.project_memory().count() > 0
    assert set(c.audit(["a"], ["main.rs"])) == {"by_sha", "by_file", "recurring_errors", "project_memory"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_every_door_of_a_corpus(spark, tmp_path):
    import shutil

    from convolake.corpus import Corpus
    from convolake.operators import fulltext

    for name in ("threads", "messages", "sources", "documents", "chunks", "embeddings", "commits"):
        shutil.copyfile(f"{SMALL}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    c = Corpus(spark, str(tmp_path))
    fulltext.write_index(c.messages("text"), str(tmp_path / "index"))
    indexed = Corpus(spark, str(tmp_path), str(tmp_path / "index"))
    hits = [tuple(r) for r in c.search("watcher rank", 20).select("id", "score", "rank").collect()]
    assert hits and hits == [tuple(r) for r in indexed.search("watcher rank", 20).select("id", "score", "rank").collect()]
    assert c.search("", 3).count() == 3 and c.search("watcher", 20, after=10**11).count() == 0
    chunk = spark.read.parquet(f"{tmp_path}/chunks.parquet").orderBy("message_id").first()
    assert c.nearest(list(chunk.embedding), 3).first().similarity == 1.0
    assert 1 <= c.related(list(chunk.embedding), 500, subagents=True).count() <= 50
    assert c.hybrid("watcher", list(chunk.embedding), 10).groupBy("thread_id").count().agg(F.max("count")).first()[0] <= 3
    fact = spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").first()
    assert c.recall(list(fact.embedding), k=4, floor=-1.0).count() == 4 and c.prior_work(list(fact.embedding), floor=-1.0).count() > 0 and c.check(list(fact.embedding), 2, -1.0).count() == 2
    for df in (c.tags(), c.projects(), c.pending(), c.coverage(), c.usage(), c.cleanup_candidates(2 * 10**9), c.packed(900), *c.stats().values(), *c.coach().values(), *c.audit(["a"], ["main"]).values()):
        df.collect()
    one = c.threads(subagents=True).orderBy("id").first().id
    assert c.header(one).count() == 1 and c.knowledge(one).count() == 1 and c.thread(one).count() > 0 and c.linked_commits(one).count() >= 0
    text, threads = c.ask("watcher", lambda prompt: str(prompt.count("[thread ")))
    assert int(text) == len(threads) > 0
    starred = c.threads(subagents=True, starred=True).count()
    c.star(one, one % 4 != 0)
    assert abs(c.threads(subagents=True, starred=True).count() - starred) == 1
    c.tag(one, ["new", " new ", ""])
    assert c.threads(subagents=True, tags=("new",)).count() == 1
    todo = c.open_todos(limit=500).first()
    c.complete_todo(todo.fact_id)
    assert todo.fact_id not in {r.fact_id for r in c.open_todos(limit=500).collect()}
    n = c.facts().count()
    c.record("/p", "gotcha", "mind it")
    assert c.facts().count() == n + 1 and c.facts().where("text = 'mind it' AND pinned").count() == 1
    for label, at in (("by hand", 1), ("auto · x", 2), ("auto · y", 3)):
        c.snapshot(one, label, at)
    assert [r.label for r in c.snapshots().collect()] == ["auto · y", "by hand"]
    paths = {tuple(r) for r in c.mentions().collect()}
    c.write_mentions()
    assert {tuple(r) for r in c.mentions().collect()} == paths
    c.delete([one])
    assert c.threads(subagents=True).where(F.col("id") == one).count() == 0 and c.thread(one).count() == 0 and c.snapshots().count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_commands(spark, capsys):
    import json

    from convolake.__main__ import main

    first = {}
    for words in (["recent"], ["search", "watcher"], ["todos"], ["tags"], ["projects"], ["stats"], ["issues"], ["pending"]):
        assert main([SMALL, *words, "--limit", "3"]) == 0
        first[words[0]] = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert len(first["recent"]) == 3 and first["search"][0]["rank"] == 1 and first["stats"][0]["threads"] > 0
    assert main([SMALL, "show", str(first["recent"][0]["id"])]) == 0 and '"role"' in capsys.readouterr().out
