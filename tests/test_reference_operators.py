import json
import os
import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolake.functions import text as H
from convolake.functions.stem import stem
from convolake.operators import extraction as X
from convolake.operators import fulltext as T
from convolake.operators import gitlink as G
from convolake.operators import ivf, packing, store
from convolake.operators import vector as V
from convolake.session import stored
from convolake.sources import connectors as S

M = "thread_id bigint, id bigint, seq bigint, role string, text string, ts bigint"


def messages(spark, *texts, role="user", thread=1):
    return spark.createDataFrame([(thread, i + 1, i, role, t, 100 + i) for i, t in enumerate(texts)], M)


def walk_todos(text):
    """The todos of a text by a plain walk over its lines."""
    for n, line in enumerate((text or "").split("\n")):
        line, found = line.strip(" \t\r"), None
        if m := re.match(r"[-*] \[ ?\] ?", line):
            found = line[m.end() :]
        else:
            for mark in ("todo", "fixme"):
                low = "".join(c.lower() if c.isascii() else c for c in line)
                spots = [i for i in range(len(low)) if low.startswith(mark, i) and not re.match("[a-z0-9]", low[i - 1 : i]) and not re.match("[a-z0-9]", low[i + len(mark) : i + len(mark) + 1])]
                if spots:
                    found = line[spots[0] + len(mark) :].lstrip(": \t)(.*-")
                    break
        found = (found or "").strip(" \t\r")
        if len(found) >= 4 and not any(x in found for x in ("\\n", "|", '","', "{", "}")):
            yield n, found


def test_todos_against_a_walk(spark):
    rng = random.Random(4)
    bits = ["todo", "TODO:", "Fixme", "fixme(x)", "- [ ]", "* [] ", "- [x]", "mastodons", "plan", "a|b", "{", "\\n", "ok", "wait for it", "-", ":", " ", "\t", "é", "x1todo"]
    texts = ["\n".join("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None, "", "\n" * 50, "todo " + "w" * 50_000]
    found: dict = {}
    for r in X.todos(spark.createDataFrame([(i, i, 0, t, None) for i, t in enumerate(texts)], "thread_id bigint, id bigint, seq bigint, text string, todo string").drop("todo")).collect():
        found.setdefault(r.thread_id, set()).add(r.todo)
    for i, t in enumerate(texts):
        first: dict = {}
        for _, x in walk_todos(t):
            first.setdefault(x.lower(), x)
        assert found.get(i, set()) == set(first.values()), t


def walk_paths(text):
    for w in re.split(r"""[\s()\[\]{}"'`,;<>|=]+""", text or ""):
        w = w.strip(".:*#!?@")
        stem, dot, ending = w.rpartition(".")
        if 3 <= len(w.encode()) <= 200 and "://" not in w and dot and stem and re.fullmatch("[A-Za-z0-9]+", ending) and not ending.isdigit() and ("/" in w or ending.lower() in X.ENDINGS):
            yield w


def test_paths_against_a_walk(spark):
    rng = random.Random(6)
    bits = ["lib/", "core", "Makefile", ".py", ".RS", ".jpg", ".9", "..", "/", "http://h.example/", "a b", "é.md", "'", "(", ":12", "x" * 70, "*", "-", "_t", ".tsx"]
    texts = [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 20))) for _ in range(150)] + [None, "", "/" * 9000 + ".c"]
    found: dict = {}
    for r in X.paths(spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(texts)], "thread_id bigint, id bigint, seq bigint, text string")).collect():
        found.setdefault(r.thread_id, set()).add(r.path)
    for i, t in enumerate(texts):
        first: dict = {}
        for w in walk_paths(t):
            first.setdefault(w.lower(), w)
        assert found.get(i, set()) == set(first.values()), t


def test_error_keys_hold_what_stays_the_same(spark):
    """The normal form is idempotent for what it leaves, and forgets places, quotations and addresses only."""
    pairs = [
        ("fatal: no remote /srv/a/b.git here", "fatal: no remote /home/q here", True), ("panic: slot 0xabcdef01 freed", "panic: slot 0x99ffee22 freed", True), ("ERROR: Lost 'alpha'", "error: lost 'beta'", True),
        ("error: lost alpha", "error: lost beta", False), ("fatal: C:\\x\\y gone", "fatal: D:\\z gone", True), ("error[A1]: x", "error[A2]: x", False), ("panic: 0x12 set", "panic: 0x13 set", False),
    ]
    rows = [(i, side, t) for i, (a, b, _) in enumerate(pairs) for side, t in enumerate((a, b))]
    df = spark.createDataFrame(rows, "i bigint, side int, line string").withColumn("key", X.normal_error(F.col("line"))).withColumn("error", X.is_error(F.col("line"))).withColumn("again", X.normal_error(F.col("key")))
    keys: dict = {}
    for r in df.collect():
        assert r.error and (r.again == r.key or "<" in r.key or "…" in r.key)
        keys.setdefault(r.i, []).append(r.key)
    assert [a == b for a, b in keys.values()] == [same for *_, same in pairs]
    quiet = messages(spark, "an error happened long ago", "x" * 401 + " error: y", "abc", None, " " * 70 + "error: late", role="tool")
    assert [r.line for r in X.error_lines(quiet).collect()] == ["error: late"]
    words = messages(spark, "an error", "ERRORS: x", "terror", "error_code", "panicking!", "command not found", None)
    assert sorted(r.id for r in X.error_candidates(words).collect()) == [1, 2, 4, 5]
    twice = X.recurring(X.error_lines(messages(spark, "fatal: a /x\nfatal: a /y", "ok", "fatal: a /z")), 5).collect()
    assert [(r.n, r.threads, r.first_seen, r.last_seen, r.example) for r in twice] == [(2, 1, 100, 102, "fatal: a /z")]


def test_bm25_prefix_and_cap(spark):
    m = messages(spark, "the watcher runs", "watching caches", "nothing here", None, "watch watch cache", "watcher", "watched cache")
    hits = T.ranked(T.bm25(m, "watch cach"), 2, 10).orderBy("rank").collect()
    assert len(hits) == 3 and [h.strict for h in hits] == [1, 1, 1] and hits[0].score >= hits[1].score
    assert T.ranked(T.bm25(m, "zzz"), 1, 10).count() == 0
    assert T.bm25(m, " . ").count() == 0 and T.bm25(m.limit(0), "watch").count() == 0
    assert "\x01" in m.select(T.snippet(F.lit("one two watcher four"), "watch").alias("s")).first().s


def test_words_with_punctuation_are_phrases(spark, tmp_path):
    m = messages(spark, "open core/mod.rs now", "mod of rs", "a foo-bar and foo-barn", "bar foo", "Crème brûlée", "the mod.rsx file", None, "")
    T.write_index(m, str(tmp_path / "i"))
    index = T.Index(spark, str(tmp_path / "i"))
    for query, ids in (("mod.rs", {1, 6}), ("foo-bar", {3}), ("creme", {5}), ("CRÈME brul", {5}), ("core/mod.rs", {1}), ("...", set()), ("bar", {3, 4})):
        scan, stored = ({(r.id, r.matched, r.score) for r in f(query).collect()} for f in (lambda q: T.bm25(m, q), index.bm25))
        assert {i for i, *_ in scan} == ids and scan == stored, query
    assert {r.id for r in T.bm25(m, "foo-bar").where("matched = 1").collect()} == {3}
    plan = index.phrase(("mod",))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term,mod)" in plan


def test_stems(spark, tmp_path):
    m = messages(spark, "the caches were cached", "caching", "cash", None)
    T.write_index(m, str(tmp_path / "s"), stems=True)
    assert {r.id for r in T.Index(spark, str(tmp_path / "s")).bm25("cache").collect()} == {1, 2}
    words = "relational vietnamization hopping falling happy sky ponies agreed controlling".split()
    assert [stem(w) for w in words] == "relat vietnam hop fall happi sky poni agre control".split() and stem("naïve") == "naïve"


def test_fusion_and_weights(spark):
    w = spark.range(1).select(*[V.sem_weight(F.lit(x)).alias(str(i)) for i, x in enumerate((1.0, 0.35, 0.25))]).first()
    assert tuple(w) == (1.0, 0.5, 0.5)
    kw = spark.createDataFrame([(10, 1), (20, 2)], "id bigint, rank int")
    sem = spark.createDataFrame([(1, 0.95, 1), (2, 0.4, 2)], "id bigint, similarity double, rank int")
    assert {r.id: r.rrf for r in V.fuse(kw, sem.limit(0), "id").collect()}[10] == pytest.approx(1 / 61, abs=1e-9)
    both = {r.id: r.rrf for r in V.fuse(kw.limit(0), sem, "id").collect()}
    assert both[1] > both[2]


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "x" * 3300), (3, "y" * 60_000), (4, None), (5, "")], "id bigint, text string")
    counts = {r.id: r["count"] for r in V.chunk_windows(df).groupBy("id").count().collect()}
    assert counts == {1: 1, 2: 3, 3: 16, 5: 1}


def test_nearest_handles_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "id bigint, embedding array<float>")
    assert [(r.id, r.similarity) for r in V.nearest(df, "id", [1.0, 0.0], 5).collect()] == [(1, 1.0)]


def matches(a, b):
    """Whether two paths are one: equal, or the shorter, which holds a slash, is the longer's ending at a slash."""
    a, b = sorted((a.lower(), b.lower()), key=len)
    return a == b or ("/" in a and b.endswith("/" + a))


def test_commit_links_against_all_pairs(spark):
    rng = random.Random(9)
    path = lambda: "/".join(rng.choice(["a", "B", "ab", "c"]) for _ in range(rng.randint(0, 3))) + rng.choice(["/x.py", "/y.py", "x.py"])
    spans = [(t, rng.choice(["/p", "/q"]), s, s + rng.randint(0, 200_000)) for t in range(12) for s in [rng.randint(0, 500_000)]]
    mentions = [(t, path()) for t in range(12) for _ in range(rng.randint(0, 6))]
    commits = [(f"{i:03x}", rng.choice(["/p", "/q", "/r"]), rng.randint(-10_000, 900_000), [path() for _ in range(rng.randint(0, 4))] if i % 9 else None) for i in range(120)]
    expected = set()
    for t, project, s, e in spans:
        for sha, where, at, files in commits:
            n = len({f.lower() for f in files or [] if any(u == t and matches(f, m) for u, m in mentions)})
            if where == project and s - G.BEFORE <= at <= e + G.AFTER and n:
                expected.add((t, sha, at, n))
    df = [spark.createDataFrame(*x) for x in ((spans, "thread_id bigint, project string, start_ts bigint, end_ts bigint"), (mentions, "thread_id bigint, path string"), (commits, "sha string, project string, committed_at bigint, files array<string>"))]
    assert {(r.thread_id, r.sha, r.committed_at, r.overlap) for r in G.thread_commits(*df, None).collect()} == expected and len(expected) > 10
    best = G.thread_commits(*df).groupBy("thread_id").count().collect()
    assert max(r["count"] for r in best) == G.PER_THREAD
    assert G.thread_commits(*[x.limit(0) for x in df], None).count() == 0


def test_best_owners_over_many_tiles_against_all_scores():
    rng = np.random.default_rng(3)
    x, y, k = rng.normal(size=(150, 4)), np.round(rng.normal(size=(20_000, 4)), 1), 40
    y = y[(y * y).sum(axis=1) > 0]
    y[9000:9300] = y[17000:17300]  # equal similarities in different tiles
    code = np.sort(rng.integers(0, 9000, len(y)))
    code = np.unique(code, return_inverse=True)[1]
    i, j, s = V._best_owners(x, y, code, 0.35, k)
    whole = np.round(x @ y.T / np.sqrt((x * x).sum(axis=1))[:, None] / np.sqrt((y * y).sum(axis=1))[None, :], 6)
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    best = np.maximum.reduceat(whole, starts, axis=1)
    for q in range(150):
        top = np.argsort(-best[q], kind="stable")[:k]
        assert code[j[i == q]].tolist() == top.tolist() and np.allclose(s[i == q], best[q][top], atol=1e-9)


def test_commit_links_by_one_join_on_one_number(spark):
    spans = spark.createDataFrame([(1, "/p", 1000, 2000)], "thread_id bigint, project string, start_ts bigint, end_ts bigint")
    commits = spark.createDataFrame([("c", "/p", 1500, ["a/b.rs", "x/a/b.rs", "b.rs"])], "sha string, project string, committed_at bigint, files array<string>")
    links = G.thread_commits(spans, spark.createDataFrame([(1, "a/b.rs")], "thread_id bigint, path string"), commits, None)
    assert [r.overlap for r in links.collect()] == [2]
    joins = [x for x in links._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert len(joins) == 2 and not any(" AND (level" in x or "key#" in x for x in joins)


def test_commit_links_are_never_broadcast(spark):
    spans = spark.range(1).selectExpr("id thread_id", "'/p' project", "1000L start_ts", "2000L end_ts")
    commits = spark.range(1).selectExpr("'c' sha", "'/p' project", "1500L committed_at", "transform(sequence(0, 9), i -> 'a/b' || i) files")
    links = G.thread_commits(spans, spark.range(1).selectExpr("id thread_id", "'A/b3' path"), commits, None)
    assert [r.overlap for r in links.collect()] == [1]
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_commits_by_shas_without_a_relation_of_strings(spark):
    links = spark.createDataFrame([(1, "9f31c0")], "thread_id bigint, sha string")
    found = G.by_sha(links, spark.range(1).selectExpr("'9F' AS needle"))
    assert found.count() == 1 and "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()


def test_spans_and_days_meet_once(spark):
    rng = random.Random(2)
    spans = [(i, a, a + rng.choice([-1, 0, 1, 7, 400, 9000])) for i in range(60) for a in [rng.randint(-3000, 9000)]]
    days = sorted({rng.randint(-3100, 19_000) for _ in range(700)} | {x for _, a, b in spans for x in (a - 1, a, b, b + 1)})
    s = spark.createDataFrame(spans, "i int, a bigint, b bigint").select("i", F.explode(G.cells(F.col("a"), F.col("b"))).alias("c"))
    d = spark.createDataFrame([(x,) for x in days], "d bigint").select("d", F.explode(G.cells_of(F.col("d"))).alias("c"))
    assert sorted((r.i, r.d) for r in s.join(d, "c").collect()) == [(i, x) for i, a, b in spans for x in days if a <= x <= b]
    assert max(r["count"] for r in s.groupBy("i").count().collect()) <= 2 * G.LEVELS + 5


def test_commits_by_the_beginnings_of_their_shas(spark):
    links = spark.createDataFrame([(1, "9f31c0"), (1, "9f3222"), (2, "07aa11"), (3, None)], "thread_id bigint, sha string")
    for needles in (["9F31", "  07aa11 ", " ", ""], ["9f", "9f3", "0"]):
        expected = sorted(s for s in ("9f31c0", "9f3222", "07aa11") if any(s.startswith(n.strip().lower()) for n in needles if n.strip()))
        table = spark.createDataFrame([(n,) for n in [*needles, None]], "needle string")
        for given in (needles, table):
            assert sorted(r.sha for r in G.by_sha(links, given).collect()) == expected
    assert G.by_sha(links, []).count() == 0 and G.by_sha(links, table.limit(0)).count() == 0


def test_packing(spark):
    small = [(1, i, r, "hi", None) for i, r in enumerate(["user", "assistant", "tool"])]
    big = [(2, i, "user" if i % 2 else "assistant", "z" * 5000, None) for i in range(40)] + [(2, 99, "tool", "t" * 9, "Bash")]
    tools = [(3, 0, "user", "q", None), (3, 1, "assistant", "w" * 40_000, "Read")]
    few = [(5, i, "user", "漢" * 9000, None) for i in range(9)]
    m = spark.createDataFrame(small + big + tools + few + [(4, 0, None, None, None)], "thread_id bigint, seq bigint, role string, text string, tool_name string")
    t = spark.createDataFrame([(1, "a source", 'with "quotes"', "/p")], "thread_id bigint, source string, title string, project string")
    got = {r.thread_id: r for r in packing.pack(m, 30_000, t).collect()}
    assert {k: (r.mode, r.turns) for k, r in got.items()} == {1: ("full", 3), 2: ("ends", 12), 3: ("no_tools", 1), 4: ("full", 1), 5: ("ends", 6)}
    assert got[1].packed == "<reference_thread source=\"a source\" title=\"with 'quotes'\" project=\"/p\">\n### user\nhi\n\n### assistant\nhi\n\n### tool result\nhi\n\n</reference_thread>"
    assert "### … 28 turns elided …" in got[2].packed and "tools omitted" in got[2].packed and packing.OMITTED in got[3].packed and "3 turns elided" in got[5].packed
    assert all(r.packed.endswith("\n</reference_thread>") for r in got.values()) and len(got[2].packed.encode()) <= 30_500
    assert packing.pack(m, 1000).where("thread_id = 2").first().packed.count("(truncated)") == 1


def test_store(spark):
    schema = "thread_id bigint, seq bigint, text string"
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, "a"), (9, 0, "z")], schema)
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a"), (3, 0, "a"), (4, 0, None)], schema)
    assert {r.thread_id: r.change for r in store.change_kinds(old, new).collect()} == {1: "append", 2: "replace", 3: "same", 4: "new"}
    edited = spark.createDataFrame([(1, 0, "A"), (1, 1, "b")], schema)
    assert store.change_kinds(old, edited).first().change == "replace"
    assert sorted(r.thread_id for r in store.upsert(old, new, ["thread_id"]).collect()) == [1, 1, 1, 2, 3, 4, 9]
    left = store.delete_threads({"messages": old}, spark.createDataFrame([(1,)], "thread_id bigint"))
    assert left["messages"].where("thread_id = 1").count() == 0
    kept = store.with_overlay(spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1, True)], "id bigint, starred boolean"), "id", {"starred": False})
    assert {r.id: r.starred for r in kept.collect()} == {1: True, 2: False}


LINES = {
    "claude_code": [
        {"type": "ai-title", "aiTitle": "A title"},
        {"type": "user", "cwd": "/srv/x", "timestamp": "2025-01-01T00:00:00Z", "message": {"content": "Hello"}},
        {"type": "assistant", "timestamp": "2025-01-01T00:00:05.5+00:00", "message": {"model": "m", "usage": {"input_tokens": 3}, "content": [{"type": "thinking", "thinking": "no"}, {"type": "text", "text": "Hi"}, {"type": "tool_use", "name": "Read", "input": {"p": 1}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "out"}]}]}},
    ],
    "codex": [{"type": "session_meta", "payload": {"cwd": "/c"}}, {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "s"}]}}, {"type": "response_item", "payload": {"type": "function_call", "name": "Bash", "arguments": "{}"}}, {"type": "response_item", "payload": {"type": "function_call_output", "output": {"a": 1}}}],
    "gemini": [{"type": "info", "content": "no"}, {"type": "gemini", "content": [{"text": "a"}, "b", {"functionCall": {"name": "f", "args": {}}}]}],
    "qwen": [{"type": "system", "message": {"parts": [{"text": "no"}]}}, {"type": "tool_result", "message": {"parts": [{"functionResponse": {"response": {"o": 1}}}]}}],
    "cline": [[{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]],
    "continue": [{"title": "T", "history": [{"message": {"role": "system", "content": "no"}}, {"message": {"role": "user", "content": [{"type": "text", "text": "u"}]}}]}],
    "copilot": [{"kind": 0, "v": {"requests": [{"timestamp": 1736000000000, "modelId": "vendor/gm", "message": {"text": "q"}, "response": [{"value": "a"}, {"kind": "x", "value": "no"}], "result": {"metadata": {"promptTokens": 5, "outputTokens": 6}}}]}}],
}
EXPECTED = {
    "claude_code": [("user", "Hello"), ("assistant", "Hi"), ("assistant", 'Read: {"p":1}'), ("tool", "out")],
    "codex": [("system", "s"), ("assistant", "Bash: {}"), ("tool", '{"a":1}')],
    "gemini": [("assistant", "a"), ("assistant", "b"), ("assistant", "f: {}")],
    "qwen": [("tool", '{"o":1}')],
    "cline": [("user", "q"), ("assistant", "a")],
    "continue": [("user", "u")],
    "copilot": [("user", "q"), ("assistant", "a")],
}


def test_line_formats(spark):
    rows = [(k, "e", n, json.dumps(v)) for k, vs in LINES.items() for n, v in enumerate(vs)] + [("claude_code", "bad", 0, "{"), ("claude_code", "bad", 1, None), ("nobody", "x", 0, "{}")]
    parsed = S.parse_lines(spark.createDataFrame(rows, "source_kind string, external_id string, line_no bigint, payload string")).cache()
    got: dict = {}
    for r in parsed.where("role IS NOT NULL").orderBy("source_kind", "line_no", "block_no").collect():
        got.setdefault(r.source_kind, []).append((r.role, r.text))
    assert got == EXPECTED
    threads = {r.source_kind: r for r in S.thread_rows(parsed).collect()}
    assert (threads["claude_code"].title, threads["claude_code"].project_path, threads["claude_code"].message_count) == ("A title", "/srv/x", 4)
    assert threads["claude_code"].updated_at - threads["claude_code"].created_at == 5
    assert threads["cline"].title == "q"
    spent = parsed.where("source_kind = 'copilot' AND role = 'assistant'").first()
    assert (spent.model, spent.input_tokens, spent.output_tokens, spent.ts) == ("gm", 5, 6, 1736000000)


def test_files_and_databases(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text("\n".join(json.dumps(v) for v in LINES["claude_code"]) + "\n\nnot json\n")
    lines = S.jsonl_lines(spark, "claude_code", str(tmp_path))
    assert [r.text for r in S.parse_lines(lines).where("role IS NOT NULL").orderBy("line_no", "block_no").collect()] == ["Hello", "Hi", 'Read: {"p":1}', "out"]
    assert lines.first().external_id == "p/s.jsonl"
    (tmp_path / "c.json").write_text(json.dumps(LINES["continue"][0], indent=1))
    assert [r.text for r in S.parse_lines(S.json_files(spark, "continue", str(tmp_path))).collect()] == ["u"]
    db = tmp_path / "g.db"
    with sqlite3.connect(db) as c:
        c.executescript("CREATE TABLE sessions(id, name, description, working_dir); CREATE TABLE messages(id, session_id, role, content_json, created_timestamp);")
        c.execute("INSERT INTO sessions VALUES ('s', '', 'about', '/w')")
        c.execute("INSERT INTO messages VALUES (1, 's', 'user', ?, 1736000000000)", (json.dumps([{"type": "text", "text": "a"}, {"x": [{"text": "b"}]}]),))
    got = S.sqlite_rows(spark, "goose", [str(db), str(tmp_path / "none.db")]).collect()
    assert [(r.title, r.text, r.ts) for r in got] == [("about", "a\nb", 1736000000)]
    kv = tmp_path / "c.db"
    with sqlite3.connect(kv) as c:
        c.execute("CREATE TABLE cursorDiskKV(key TEXT PRIMARY KEY, value)")
        c.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [("composerData:1", '{"name":"n"}'), ("bubbleId:1:b", '{"type":2,"text":"later","timingInfo":{"clientStartTime":2000000000000}}'), ("bubbleId:1:a", '{"type":1,"text":"first","timingInfo":{"clientStartTime":1900000000000}}')])
    assert [(r.role, r.text) for r in S.sqlite_rows(spark, "cursor", [str(kv)]).orderBy("line_no").collect()] == [("user", "first"), ("assistant", "later")]
    oc = tmp_path / "o.db"
    with sqlite3.connect(oc) as c:
        c.executescript("CREATE TABLE session(id, title, directory, parent_id, time_created, time_updated); CREATE TABLE message(id, session_id, time_created, data); CREATE TABLE part(id, message_id, data);")
        c.execute("INSERT INTO session VALUES ('s', 't', '/d', NULL, 1, 2)")
        c.execute("INSERT INTO message VALUES ('m', 's', 1736000000000, '{\"role\":\"user\"}')")
        c.executemany("INSERT INTO part VALUES (?, 'm', ?)", [("1", '{"type":"text","text":"x"}'), ("2", '{"type":"tool"}'), ("3", '{"type":"text","text":"y"}')])
    one = S.sqlite_rows(spark, "opencode", [str(oc)])
    assert [r.text for r in one.collect()] == ["x\ny"]
    assert S.prefer(one, one).count() == 1


def test_helpers(spark):
    assert S.uri_to_path("file:///c%3A/a%20b") == "c:/a b" and S.uri_to_path("file:///srv/x+y") == "/srv/x+y"
    log = spark.createDataFrame([("\x1emark\x1f" + "a" * 40 + "\x1f1736000000\x1fFix it\nsrc/a.rs\n\nb.rs\n\x1emark\x1f" + "b" * 40 + "\x1fbad\x1fNo time\n",)], "value string")
    rows = S.parse_git_log(log).collect()
    assert [(r.short_sha, r.committed_at, r.subject, r.files) for r in rows] == [("a" * 10, 1736000000, "Fix it", ["src/a.rs", "b.rs"]), ("b" * 10, None, "No time", [])]

    def fails():
        raise OSError("gone")

    def later():
        return spark.range(3).select(F.expr("IF(id = 2, raise_error('broken'), id)").cast("bigint").alias("id"))

    seen = []
    rows, failed = S.scan_all(spark, {"a": lambda: spark.range(2), "b": fails, "c": later, "d": lambda: spark.range(1)}, lambda kind, n: seen.append((kind, n)))
    assert rows.count() == 3 and failed["b"] == "gone" and set(failed) == {"b", "c"} and seen == [("a", 2), ("d", 1)]
    many = "\x1em\x1f" + "c" * 40 + "\x1f1736000000\x1fBig\n" + "\n".join(f"f{i}" for i in range(3000))
    assert len(S.parse_git_log(spark.createDataFrame([(many,)], "value string")).first().files) == 3000
    listing = spark.createDataFrame([("/a/x/1", 5, 1), ("/a/x/2", 9, 1), ("/a/y/1", 1, 1)], "path string, mtime bigint, size bigint")
    prints = S.fingerprints(listing)
    assert sorted((r.path, r.mtime, r.size) for r in prints.collect()) == [("/a/x", 9, 2), ("/a/y", 1, 1)]
    assert [r.path for r in S.changed_files(S.fingerprints(listing.where("path <> '/a/x/1'")), prints).collect()] == ["/a/x"]


def test_damaged_rows_cost_no_others(spark, tmp_path):
    db = tmp_path / "with space+.db"
    writer = sqlite3.connect(db)
    writer.executescript("PRAGMA journal_mode=WAL; CREATE TABLE sessions(id, name, description, working_dir); CREATE TABLE messages(id, session_id, role, content_json, created_timestamp); INSERT INTO sessions VALUES ('s', 'n', '', '/w');")
    writer.executemany("INSERT INTO messages VALUES (?, 's', 'user', ?, ?)", [(1, '[{"text":"a"}]', 5), (2, '[{"text":', 6), (3, None, 7), (4, '[{"text":"d"}]', 8)])
    writer.commit()  # still in the log, as the writer is open
    assert sorted(r.text for r in S.sqlite_rows(spark, "goose", [str(db)]).collect()) == ["a", "d"]
    writer.close()
    assert sorted(r.text for r in S.sqlite_rows(spark, "goose", [str(db)], ship=True).collect()) == ["a", "d"]
    kv = tmp_path / "kv.db"
    with sqlite3.connect(kv) as c:
        c.execute("CREATE TABLE cursorDiskKV(key TEXT PRIMARY KEY, value)")
        c.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [("composerData:1", '{"createdAt": 1900000000000}'), ("composerData:2", "{"), ("bubbleId:1:a", '{"text":"x","timingInfo":{"clientStartTime":"odd"}}'), ("bubbleId:1:b", "{"), ("bubbleId:3:c", '{"text":"no thread"}')])
    assert [(r.text, r.seen_at) for r in S.sqlite_rows(spark, "cursor", [str(kv)]).collect()] == [("x", 1900000000)]


def test_lines_of_long_files_keep_their_numbers(spark, tmp_path):
    expected = {}
    for name, n in (("a b/one+.jsonl", 3000), ("two.jsonl", 7), ("empty.jsonl", 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        rows = [f'{{"i":{i},"pad":"{"x" * (i % 90)}"}}' if i % 5 else "" for i in range(n)]
        (tmp_path / name).write_text("\r\n".join(rows))
        expected |= {(name, i): x for i, x in enumerate(rows) if x}
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        lines = S.jsonl_lines(spark, "qwen", str(tmp_path))
        assert lines.rdd.getNumPartitions() > 0 and {(r.external_id, r.line_no): r.payload for r in lines.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


def test_folders_of_editors(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(value))

    put("tasks/Code/tasks/1736000000123/api_conversation_history.json", LINES["cline"][0])
    put("tasks/Code/tasks/1736000000123/task_metadata.json", {"cwd": "/srv/t"})
    rows = S.task_files(spark, "cline", str(tmp_path / "tasks")).collect()
    assert {(r.external_id, r.project_path, r.created_at) for r in rows} == {("Code/1736000000123", "/srv/t", 1736000000)} and all(r.ts > 1_700_000_000 for r in rows)
    put("ws/h1/chatSessions/s.json", LINES["copilot"][0])
    put("ws/h1/workspace.json", {"folder": "file:///srv/with%20blank"})
    put("ws/h2/chatSessions/s.jsonl", LINES["copilot"][0])
    got = {r.external_id: r.project_path for r in S.workspace_sessions(spark, "copilot", str(tmp_path / "ws")).collect()}
    assert got == {"h1/chatSessions/s.json": "/srv/with blank", "h2/chatSessions/s.jsonl": None}
    put("st/session/p/ses_1.json", {"id": "ses_1", "title": "T", "directory": "/d", "time": {"created": 1736000000000}})
    put("st/message/ses_1/m1.json", {"id": "m1", "role": "user", "time": {"created": 1736000001000}})
    put("st/message/ses_1/m2.json", {"id": "m2", "role": "assistant", "time": {"created": 1736000002000}})
    for part, value in (("m1/b", {"type": "text", "text": "two"}), ("m1/a", {"type": "text", "text": "one"}), ("m1/c", {"type": "tool"}), ("m2/a", {"type": "text", "text": " "})):
        put(f"st/part/{part}.json", value)
    tree = S.session_tree(spark, "opencode", str(tmp_path / "st"))
    assert [(r.external_id, r.title, r.project_path, r.role, r.text, r.ts) for r in tree.collect()] == [("ses_1", "T", "/d", "user", "one\ntwo", 1736000001)]
    assert S.prefer(tree, tree).count() == 1


def test_a_table_of_threads_wins_over_files(spark, tmp_path):
    one, two = "0195b0c4-0000-7000-8000-000000000001", "0195b0c4-0000-7000-8000-000000000002"
    for uid in (one, two):
        (tmp_path / f"rollout-x-{uid}.jsonl").write_text("\n".join(json.dumps(v) for v in LINES["codex"]))
    db = tmp_path / "state.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE threads(id, title, cwd, git_branch, created_at, updated_at, rollout_path, first_user_message)")
        c.execute("INSERT INTO threads VALUES (?, ' ', '/state', NULL, 1, 2, ?, 'First line\nmore')", (one, f"/old/place/rollout-x-{one}.jsonl"))
    rows = S.with_state(S.parse_lines(S.jsonl_lines(spark, "codex", str(tmp_path))), S.state_threads(spark, [str(db)]))
    threads = {r.external_id: (r.title, r.project_path, r.message_count) for r in S.thread_rows(rows).collect()}
    assert threads == {one: ("First line", "/state", 3), two: (None, "/c", 3)}


def test_projects_by_their_root(spark, tmp_path):
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "repo/sub/deep").mkdir(parents=True)
    (tmp_path / "plain").mkdir()
    df = spark.createDataFrame([(p,) for p in (f"{tmp_path}/repo/sub/deep/", f" {tmp_path}/repo", f"{tmp_path}/plain/", "/no/such/place//", " ", None)], "project_path string")
    root = os.path.realpath(tmp_path)
    assert {r.project_path: r.project_key for r in S.project_roots(df).collect()} == {f"{tmp_path}/repo/sub/deep/": f"{root}/repo", f" {tmp_path}/repo": f"{root}/repo", f"{tmp_path}/plain/": f"{root}/plain", "/no/such/place//": "/no/such/place", " ": None, None: None}


def test_knowledge_of_threads(spark):
    fact = "fact_id bigint, thread_id bigint, kind string, text string, extractor string, seq bigint, pinned boolean, edited boolean, hidden boolean, status string"
    rows = [
        (1, 1, "decision", "late", "llm", 5, False, False, False, "open"), (2, 1, "decision", "first", "llm", 9, True, False, False, "open"), (3, 1, "decision", "gone", "llm", 1, False, False, True, "open"),
        (4, 1, "summary", "s1", "llm", 1, False, False, False, "open"), (5, 1, "summary", "s2", "llm", 2, False, False, False, "open"), (6, 1, "todo", "t", "rule", 1, False, None, None, "done"),
        (7, 2, "gotcha", "kept", "llm", 1, False, True, False, "open"), (8, 2, "gotcha", "lost", "llm", 1, False, None, False, "open"), (9, 9, "gotcha", "elsewhere", "llm", 1, False, False, False, "open"),
    ]
    facts = spark.createDataFrame(rows, fact)
    state = "id bigint, knowledge_extracted boolean, knowledge_msg_count bigint, distillable_count bigint, knowledge_error string, is_subagent boolean, message_count bigint"
    threads = spark.createDataFrame([(1, True, 4, 4, None, False, 4), (2, True, 4, 6, None, False, 9), (3, False, None, 5, None, False, 5), (4, True, None, 5, None, False, 5), (5, False, None, 5, "timeout", False, 5), (6, False, None, 2, None, True, 9), (7, False, None, 2, None, False, 3)], state)
    known = {r.thread_id: r for r in store.knowledge(facts.fillna(False), threads).collect()}
    assert (known[1].summary, known[1].decisions, known[1].todos, known[1].gotchas, known[1].stale) == ("s2", "first\x1flate", "t", None, False)
    assert known[2].stale and known[4].stale and not known[3].stale and known[3].summary is None
    assert sorted(r.id for r in threads.where(store.stale()).where(store.distillable()).collect()) == [2, 3]
    assert sorted(r.id for r in threads.where(store.stale(null_is_stale=True)).collect()) == [2, 3, 4, 6, 7]
    kept, after = store.invalidate(facts, threads)
    assert sorted(r.fact_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 9] and {r.id for r in after.where("knowledge_extracted").collect()} == {1, 4}
    assert store.invalidate(facts.limit(0), threads.limit(0))[0].count() == 0
    edits = spark.createDataFrame([(1, True, None, "done", None), (6, None, None, "open", None), (7, None, True, None, "new")], "fact_id bigint, pinned boolean, hidden boolean, status string, text string")
    now = {r.fact_id: r for r in store.curate(facts, edits).collect()}
    assert now[1].pinned and now[1].status == "open" and now[6].status == "open" and now[7].hidden and now[7].text == "new" and now[7].edited and not now[2].edited


def test_overlays_and_rewrites(spark):
    tags = spark.createDataFrame([(1, "old"), (2, "stays")], "thread_id bigint, tag string")
    new = spark.createDataFrame([(1, [" a ", "a", "", None]), (3, [])], "thread_id bigint, tags array<string>")
    assert sorted((r.thread_id, r.tag) for r in store.set_tags(tags, new).collect()) == [(1, "a"), (2, "stays")]
    links = spark.createDataFrame([("/p", "x"), ("/q", "y"), (None, "z")], "project string, sha string")
    fresh = spark.createDataFrame([("/p", "n"), (None, "m")], "project string, sha string")
    assert sorted(r.sha for r in store.rewrite_partitions(links, fresh, "project").collect()) == ["m", "n", "y", "z"]
    config = store.set_config(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), {"a": "3"})
    assert sorted((r.key, r.value) for r in config.collect()) == [("a", "3"), ("b", "2")]
    thread, said = store.chat_thread(spark, [("system", " "), ("user", "q" * 90), ("assistant", "r")], 5, "c1")
    assert thread.first().title == "q" * 80 + "…" and thread.first().message_count == 2 and [r.role for r in said.orderBy("seq").collect()] == ["user", "assistant"]
    assert store.chat_thread(spark, [], 5, "c2")[0].count() == 0


def test_vectors_are_written_once(spark):
    chunks = spark.createDataFrame([(1, 0, "a b"), (2, 0, ""), (3, 0, "bad")], "message_id bigint, chunk_no int, chunk string")

    def encode(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    new = V.embed(chunks, encode, batch=1)
    stored = spark.createDataFrame([(1, 0, [9.0]), (7, 0, [9.0])], "message_id bigint, chunk_no int, embedding array<float>")
    vectors, done = V.write_vectors(stored, new)
    assert sorted((r.message_id, r.embedding) for r in vectors.collect()) == [(1, [3.0, 1.0]), (2, [0.0, 1.0]), (7, [9.0])]
    assert sorted(r.message_id for r in done.collect()) == [1, 2, 3, 7]
    unit = chunks.select(V.hashing_encoder(F.col("chunk")).alias("v")).collect()
    assert sorted(round(sum(x * x for x in r.v), 5) for r in unit) == [0.0, 1.0, 1.0]
    found = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.65), (1, 14, 0.6), (1, 10, 0.63)], "query_id bigint, thread_id bigint, similarity double")
    seen = spark.createDataFrame([(1, 11)], "query_id bigint, thread_id bigint")
    assert sorted(r.thread_id for r in V.proactive(found, seen).collect()) == [10, 12]
    assert V.proactive(found, seen, prompt="too short").count() == 0


def test_paths_of_transcripts(spark):
    rows = [("slug/uuid-1.jsonl", False), ("slug/uuid-2/subagents/agent-3.jsonl", True), ("plain", False)]
    df = spark.createDataFrame(rows, "e string, s boolean")
    assert [r[0] for r in df.select(H.session_id(F.col("e"), F.col("s"))).collect()] == ["uuid-1", "uuid-2", "plain"]
    paths = spark.createDataFrame([("/home/x/.a/p/s.jsonl",), ("/home/x/.ab/p",), (None,)], "p string")
    assert [r[0] for r in paths.select(H.id_below(F.col("p"), "/home/x/.a/")).collect()] == ["p/s.jsonl", None, None]


def test_inverted_lists(spark, tmp_path):
    rng = random.Random(12)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i % 400, i, vector()) for i in range(1500)] + [(7, 9001, None), (7, 9002, [0.0] * 6), (7, 9003, [1.0]), (3, 9004, [1.0] * 6), (3, 9004, [1.0] * 6)]
    df = spark.createDataFrame(rows, "owner bigint, id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, 0, vector()) for i in range(40)] + [(50, 0, None), (51, 0, [1.0])], "query_id bigint, query_no bigint, embedding array<float>")
    path = str(tmp_path / "v")
    centroids = ivf.fit(df, 12)
    ivf.write(df, path, centroids)
    key = lambda found: {tuple(r) for r in found.select("query_id", "query_no", "owner", "similarity", "id").collect()}
    exact = V.nearest_of_all(q.where("query_id <> 51"), df.where("id <> 9003"), 0.35, 10)
    assert key(ivf.search(spark, path, q, 0.35, 10, 12)) == key(exact)
    some = ivf.recall(ivf.search(spark, path, q, 0.35, 10, 6), exact).first()
    assert some.queries == 40 and some.recall >= 0.9
    assert spark.read.parquet(path + "/lists").count() == 1502 and not (tmp_path / "v/assigned").exists()  # every vector that has a direction of the lists' dimensions
    empty = str(tmp_path / "e")
    ivf.write(df.limit(0), empty, ivf.fit(df.limit(0), 4))
    assert ivf.search(spark, empty, q, 0.35, 10, 2).count() == 0


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).repartition(9).write.parquet(path)
    store.compact(spark, path)
    assert spark.read.parquet(path).count() == 100 and len(list((tmp_path / "t.parquet").glob("*.parquet"))) == 1


def test_what_is_stored_once(spark, tmp_path):
    source, calls = tmp_path / "t.parquet", []

    def write(path):
        calls.append(path)
        spark.range(3).write.parquet(path + "/x")

    spark.range(1).write.parquet(str(source))
    one = stored(spark, "test", str(source), write)
    assert stored(spark, "test", str(source), write) == one and len(calls) == 1 and spark.read.parquet(one + "/x").count() == 3 and not os.path.exists(calls[0])
    spark.range(9).write.mode("overwrite").parquet(str(source))
    assert stored(spark, "test", str(source), write) != one and len(calls) == 2
