"""Reading conversation archives of many agents into one message table.

All line formats share one path: text becomes numbered lines on the JVM, each line is parsed on its own in Arrow batches,
and a thread's title, project and bounds are aggregates over its lines. No thread is ever gathered in one place, so a
session file or an agent with a third of all rows is no trouble. Damaged lines and files are skipped.

To add an agent, write a function from one parsed JSON value to (facts about the thread, messages) and register it.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import sqlite3
import tempfile
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.session import table_path

ROWS = (
    "source_kind string, external_id string, line_no bigint, block_no int, role string, text string, tool_name string, ts bigint, model string, "
    "input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cache_read_tokens bigint, title string, project_path string, git_branch string, seen_at bigint"
)
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
TITLE = 80
PARSERS: dict[str, Callable[[object], tuple[dict, list[dict]]]] = {}


def parser(*kinds: str):
    def add(f):
        PARSERS.update(dict.fromkeys(kinds, f))
        return f

    return add


def seconds(value: object) -> int | None:
    """Epoch seconds of an RFC 3339 text, or of a number of seconds or milliseconds."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return int(value) // 1000 if value > 1e11 else int(value)
    if isinstance(value, str):
        try:
            at = datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
        return int((at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp())
    return None


def _text_of(blocks: object, kinds: tuple[str, ...] | None = None) -> str:
    """The texts of blocks of some kinds (all where None), joined by line breaks; a string is its own text."""
    if isinstance(blocks, str):
        return blocks
    if isinstance(blocks, list):
        return "\n".join(b["text"] for b in blocks if isinstance(b, dict) and isinstance(b.get("text"), str) and (kinds is None or b.get("type") in kinds))
    return ""


def _said(role: str, text: object, tool: str | None = None, **more: object) -> list[dict]:
    body = text.strip() if isinstance(text, str) else ""
    return [{"role": role, "text": body, "tool_name": tool, **more}] if body else []


def _call(name: object, arguments: object) -> list[dict]:
    name = name if isinstance(name, str) and name else "tool"
    body = arguments if isinstance(arguments, str) else "" if arguments is None else json.dumps(arguments, ensure_ascii=False, separators=(",", ":"))
    return _said("assistant", f"{name}: {body}", name)


def _blocks(role: str, content: object) -> list[dict]:
    """Content of typed blocks: texts, tool calls (by the assistant) and tool results; thinking and others are skipped."""
    if isinstance(content, str):
        return _said(role, content)
    out: list[dict] = []
    for b in content if isinstance(content, list) else []:
        kind = b.get("type") if isinstance(b, dict) else None
        if kind == "text":
            out += _said(role, b.get("text"))
        elif kind == "tool_use":
            out += _call(b.get("name"), b.get("input"))
        elif kind == "tool_result":
            out += _said("tool", _text_of(b.get("content")))
    return out


def _parts(role: str, parts: object) -> list[dict]:
    """Parts with text, functionCall or functionResponse; a bare string is a text."""
    if isinstance(parts, str):
        return _said(role, parts)
    out: list[dict] = []
    for p in parts if isinstance(parts, list) else [parts]:
        if isinstance(p, str):
            out += _said(role, p)
        elif isinstance(p, dict):
            if isinstance(p.get("text"), str):
                out += _said(role, p["text"])
            if isinstance(call := p.get("functionCall"), dict):
                out += _call(call.get("name"), call.get("args"))
            if isinstance(answer := p.get("functionResponse"), dict):
                body = answer.get("response")
                out += _said("tool", body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, separators=(",", ":")))
    return out


def _dict(value: object) -> dict:
    return value if isinstance(value, dict) else {}


@parser("claude_code")
def _claude_code(v: object) -> tuple[dict, list[dict]]:
    v = _dict(v)
    about = {"seen_at": seconds(v.get("timestamp")), "project_path": v.get("cwd"), "git_branch": v.get("gitBranch")}
    if v.get("type") == "ai-title":
        return about | {"title": v.get("aiTitle")}, []
    if v.get("type") not in ("user", "assistant"):
        return about, []
    message = _dict(v.get("message"))
    said = _blocks(v["type"], message.get("content"))
    if said and v["type"] == "assistant" and isinstance(u := message.get("usage"), dict):
        said[0] |= {"model": message.get("model"), "input_tokens": u.get("input_tokens"), "output_tokens": u.get("output_tokens"), "cache_write_tokens": u.get("cache_creation_input_tokens"), "cache_read_tokens": u.get("cache_read_input_tokens")}
    return about, said


@parser("codex")
def _codex(v: object) -> tuple[dict, list[dict]]:
    v = _dict(v)
    p, about = _dict(v.get("payload")), {"seen_at": seconds(v.get("timestamp"))}
    if v.get("type") == "session_meta":
        return about | {"project_path": p.get("cwd"), "seen_at": seconds(p.get("timestamp")) or about["seen_at"]}, []
    kind = p.get("type")
    if kind == "message":
        role = p.get("role") if p.get("role") in ("user", "assistant") else "system"
        return about, _said(role, _text_of(p.get("content"), ("input_text", "output_text", "text")))
    if kind == "function_call":
        return about, _call(p.get("name"), p.get("arguments"))
    if kind == "function_call_output":
        out = p.get("output")
        return about, _said("tool", out if isinstance(out, str) else "" if out is None else json.dumps(out, ensure_ascii=False, separators=(",", ":")))
    return about, []


@parser("gemini")
def _gemini(v: object) -> tuple[dict, list[dict]]:
    v = _dict(v)
    about = {"seen_at": seconds(v.get("timestamp") or v.get("startTime"))}
    if isinstance(where := v.get("directories"), list) and where:
        about["project_path"] = where[0]
    role = {"user": "user", "gemini": "assistant"}.get(v.get("type"))
    return about, _parts(role, v.get("content")) if role else []


@parser("qwen")
def _qwen(v: object) -> tuple[dict, list[dict]]:
    v = _dict(v)
    about = {"seen_at": seconds(v.get("timestamp")), "project_path": v.get("cwd"), "git_branch": v.get("gitBranch")}
    role = {"user": "user", "assistant": "assistant", "tool_result": "tool"}.get(v.get("type"))
    return about, _parts(role, _dict(v.get("message")).get("parts")) if role else []


@parser("cline", "roo", "kilo")
def _cline(v: object) -> tuple[dict, list[dict]]:
    out: list[dict] = []
    for m in v if isinstance(v, list) else []:
        if isinstance(m, dict) and m.get("role") in ("user", "assistant"):
            out += _blocks(m["role"], m.get("content"))
    return {}, out


@parser("continue")
def _continue(v: object) -> tuple[dict, list[dict]]:
    v = _dict(v)
    out: list[dict] = []
    for turn in v.get("history") if isinstance(v.get("history"), list) else []:
        m = _dict(_dict(turn).get("message"))
        if m.get("role") in ("user", "assistant", "tool"):
            out += _said(m["role"], _text_of(m.get("content")))
    return {"title": v.get("title"), "project_path": v.get("workspaceDirectory")}, out


@parser("copilot")
def _copilot(v: object) -> tuple[dict, list[dict]]:
    v = _dict(_dict(v).get("v", v))
    out: list[dict] = []
    for r in v.get("requests") if isinstance(v.get("requests"), list) else []:
        r = _dict(r)
        at = seconds(r.get("timestamp"))
        out += _said("user", _dict(r.get("message")).get("text"), ts=at)
        answer = "".join(b["value"] for b in r.get("response") or [] if isinstance(b, dict) and isinstance(b.get("value"), str) and not b.get("kind"))
        meta = _dict(_dict(r.get("result")).get("metadata"))
        model = r.get("modelId").rpartition("/")[2] if isinstance(r.get("modelId"), str) else None
        out += _said("assistant", answer, ts=at, model=model, input_tokens=meta.get("promptTokens"), output_tokens=meta.get("completionTokens", meta.get("outputTokens")))
    return {"seen_at": seconds(v.get("creationDate"))}, out


def parse_lines(lines: DataFrame) -> DataFrame:
    """Messages (see ROWS) of lines with source_kind, external_id, line_no and payload; a line without messages gives one row with a null role.

    Null, damaged and foreign payloads give none. Texts are trimmed, empty ones dropped; null times take the line's, or the
    file's where lines have its time in a column mtime.
    """
    mtime = F.col("mtime").cast("bigint") if "mtime" in lines.columns else F.lit(None).cast("bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, eid, line, payload, changed in zip(batch["source_kind"], batch["external_id"], batch["line_no"], batch["payload"], batch["mtime"]):
                parse = PARSERS.get(kind)
                try:
                    value = json.loads(payload) if isinstance(payload, str) else None
                    if parse is None or value is None:
                        continue
                    about, said = parse(value)
                except (ValueError, TypeError, AttributeError, RecursionError):
                    continue
                about = {k: x for k, x in about.items() if isinstance(x, (str, int)) and x != ""}
                if "seen_at" not in about and pd.notna(changed):
                    about["seen_at"] = int(changed)
                for n, m in enumerate(said or [{}]):
                    rows.append({"source_kind": kind, "external_id": eid, "line_no": line, "block_no": n, "ts": about.get("seen_at")} | about | {k: x for k, x in m.items() if x is not None})
            if not rows:  # an empty column of texts has no Arrow form here
                continue
            frame = pd.DataFrame(rows, columns=_NAMES).astype(object)
            for c in [x.split()[0] for x in ROWS.split(", ") if x.endswith(("bigint", "int"))]:
                frame[c] = pd.to_numeric(frame[c], errors="coerce").astype("Int64")
            for c in [x.split()[0] for x in ROWS.split(", ") if x.endswith("string")]:
                frame[c] = [x.encode("utf-8", "replace").decode() if isinstance(x, str) else None for x in frame[c]]
            yield frame

    return lines.select("source_kind", "external_id", F.col("line_no").cast("bigint").alias("line_no"), "payload", mtime.alias("mtime")).mapInPandas(run, ROWS)


def thread_rows(rows: DataFrame) -> DataFrame:
    """Threads of parsed rows: title (the given one, else the start of the first user text), project, branch, bounds and counts."""
    where = F.struct("line_no", "block_no")
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", where))
    short = F.when(F.length("first_text") > TITLE, F.concat(F.col("first_text").substr(1, TITLE), F.lit("…"))).otherwise(F.col("first_text"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    grouped = rows.groupBy("source_kind", "external_id").agg(
        last("title").alias("given_title"), first.alias("first_text"), last("project_path").alias("project_path"), last("git_branch").alias("git_branch"),
        F.min(F.coalesce("seen_at", "ts")).alias("created_at"), F.max(F.coalesce("seen_at", "ts")).alias("updated_at"), F.count("role").alias("message_count"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
    )
    kept = grouped.where("message_count > 0")
    return kept.select("source_kind", "external_id", F.coalesce("given_title", short).alias("title"), "project_path", "git_branch", "created_at", "updated_at", "message_count", "bytes")


def _below(root: str) -> Column:
    """A file's path below root, without the escapes of its URI."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")


def jsonl_lines(spark: SparkSession, kind: str, root: str, glob: str = "*.jsonl") -> DataFrame:
    """The numbered lines of all files under root; external_id is the path below it, lines count from 0.

    Files are read in splits, however long they are. A line's number is its place in its split and the number of lines in the
    file's splits before, which one count of lines per split gives.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, lineSep="\n")
    rows = text.select(_below(root).alias("external_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("payload"))
    splits = rows.groupBy("external_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("external_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.select("external_id", "block", "first", before.alias("before")), ["external_id", "block"])
    return numbered.where(F.trim("payload") != "").select(F.lit(kind).alias("source_kind"), "external_id", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "payload")


def json_files(spark: SparkSession, kind: str, root: str, glob: str = "*.json") -> DataFrame:
    """Each JSON file under root as one line, with the time of its last change; line breaks inside it are kept."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return whole.select(F.lit(kind).alias("source_kind"), _below(root).alias("external_id"), F.lit(0).alias("line_no"), F.col("value").alias("payload"), F.unix_seconds("_metadata.file_modification_time").alias("mtime"))


def task_files(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """Messages of an editor's tasks: <editor>/tasks/<id>/api_conversation_history.json under root, with the cwd of the task_metadata.json beside it.

    external_id is <editor>/<id>; the id is the task's time of creation in milliseconds, the file's change its last one.
    """
    folder = F.regexp_extract("external_id", r"([^/]+)/tasks/([^/]+)/[^/]+$", 1), F.regexp_extract("external_id", r"([^/]+)/tasks/([^/]+)/[^/]+$", 2)
    where = json_files(spark, kind, root, "task_metadata.json").select(F.concat_ws("/", *folder).alias("external_id"), F.get_json_object("payload", "$.cwd").alias("__cwd"))
    rows = parse_lines(json_files(spark, kind, root, "api_conversation_history.json").withColumn("external_id", F.concat_ws("/", *folder)))
    made = F.try_to_number(F.substring_index("external_id", "/", -1), F.lit("9" * 18))
    return rows.join(where, "external_id", "left").withColumns({"project_path": F.coalesce("project_path", "__cwd"), "created_at": F.call_function("div", made.cast("bigint"), F.lit(1000))}).drop("__cwd")


def workspace_sessions(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """Messages of chatSessions/*.json and *.jsonl in workspaces under root; the project is the folder that workspace.json names."""
    top = F.regexp_extract("external_id", r"^(.*?)/?(?:chatSessions/)?[^/]+$", 1)
    folder = F.udf(lambda uri: None if uri is None else uri_to_path(uri))  # a row a workspace
    where = json_files(spark, kind, root, "workspace.json").select(top.alias("__top"), folder(F.get_json_object("payload", "$.folder")).alias("__cwd"))
    lines = json_files(spark, kind, root, "*.json*").where(F.col("external_id").rlike(r"(^|/)chatSessions/[^/]+\.jsonl?$"))
    rows = parse_lines(lines).withColumn("__top", top)
    return rows.join(where, "__top", "left").withColumn("project_path", F.coalesce("project_path", "__cwd")).drop("__top", "__cwd")


def session_tree(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """Messages (see ROWS) of a tree of files: session/<project>/<id>.json, message/<session>/<id>.json, part/<message>/<id>.json; a message's text parts are joined by line breaks in the order of their names."""
    get = lambda path: F.get_json_object("payload", path)
    files = lambda top: json_files(spark, kind, f"{root.rstrip('/')}/{top}")
    stem = F.regexp_replace(F.substring_index("external_id", "/", -1), r"\.json$", "")
    folder = F.regexp_extract("external_id", r"([^/]+)/[^/]+$", 1)
    sessions = files("session").select(F.coalesce(get("$.id"), stem).alias("external_id"), get("$.title").alias("title"), get("$.directory").alias("project_path"), F.call_function("div", get("$.time.created").cast("bigint"), F.lit(1000)).alias("seen_at"))
    messages = files("message").select(F.coalesce(get("$.id"), stem).alias("mid"), folder.alias("external_id"), get("$.role").alias("role"), get("$.time.created").cast("bigint").alias("at"))
    parts = files("part").where(get("$.type") == "text").select(folder.alias("mid"), stem.alias("name"), get("$.text").alias("t")).where("t IS NOT NULL")
    texts = parts.groupBy("mid").agg(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda x: x["t"]), "\n"), F.lit(" \t\r\n")).alias("text"))  # the parts of one message
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("system")
    rows = messages.join(texts.where("text <> ''"), "mid").join(sessions, "external_id")
    known = {"source_kind": F.lit(kind), "line_no": F.coalesce("at", F.lit(0)), "block_no": F.lit(0), "role": role, "ts": F.call_function("div", F.col("at"), F.lit(1000))}
    rows = rows.withColumns(known)
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ROWS.split(", "))])


def with_state(rows: DataFrame, threads: DataFrame) -> DataFrame:
    """Parsed rollout rows named by an agent's table of threads where it knows their file: its id, title, project, branch and times win over the file's own.

    threads: id, title, cwd, git_branch, created_at, updated_at, rollout_path, first_user_message. A title that is missing is the first line
    of the first user message. Rows of files that the table doesn't name stay, unless their thread is one it has under another file.
    """
    t = threads.where("id IS NOT NULL AND rollout_path IS NOT NULL").dropDuplicates(["rollout_path"])
    t = t.select(
        F.col("id").alias("__id"), F.substring_index("rollout_path", "/", -1).alias("__file"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim(F.substring_index("first_user_message", "\n", 1)), F.lit(""))).alias("__title"),
        F.nullif("cwd", F.lit("")).alias("__cwd"), F.nullif("git_branch", F.lit("")).alias("__branch"),
    )
    both = rows.withColumn("__file", F.substring_index("external_id", "/", -1)).join(t, "__file", "left")
    session = F.coalesce("__id", F.nullif(F.regexp_extract("__file", r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", 1), F.lit("")), F.col("external_id"))
    named = both.withColumns({"external_id": session, "title": F.coalesce("__title", "title"), "project_path": F.coalesce("__cwd", "project_path"), "git_branch": F.coalesce("__branch", "git_branch"), "__known": F.col("__id").isNotNull()})
    names = named.where("__known").select("external_id").distinct()
    kept = named.where("__known").unionByName(named.where("NOT __known").join(names, "external_id", "left_anti"))
    return kept.select(*_NAMES)


def is_subagent(external_id) -> object:
    return F.contains(external_id, F.lit("/subagents/")) | external_id.rlike(r"chats/[^/]+/[^/]+$")


# ---------------------------------------------------------------- databases of single machines


def _texts(value: object) -> list[str]:
    """Every string under a key `text`, at any depth, in order."""
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("text"), str):
                out.append(v["text"])
            stack.extend(x for k, x in reversed(v.items()) if k != "text" or not isinstance(x, str))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


def _load(text: object) -> object:
    """The value of a JSON text; None for one that is damaged, so that one row never costs the others."""
    try:
        return json.loads(text) if isinstance(text, (str, bytes)) else None
    except (ValueError, RecursionError):
        return None


def _goose(db: sqlite3.Connection) -> Iterator[dict]:
    sql = "SELECT s.id, coalesce(nullif(s.name, ''), s.description) AS title, s.working_dir, m.role, m.content_json, m.created_timestamp, m.id AS n FROM sessions s JOIN messages m ON m.session_id = s.id ORDER BY s.id, m.created_timestamp, m.id"
    for eid, title, where, role, content, at, n in db.execute(sql):
        text = "\n".join(_texts(_load(content))).strip()
        if text:
            yield {"external_id": eid, "title": title, "project_path": where, "role": "assistant" if role == "assistant" else "user", "text": text, "ts": seconds(at), "line_no": n}


def _cursor(db: sqlite3.Connection) -> Iterator[dict]:
    heads = {k.split(":", 1)[1]: _dict(_load(v)) for k, v in db.execute("SELECT key, value FROM cursorDiskKV WHERE key >= 'composerData:' AND key < 'composerData;'") if v}
    for key, value in db.execute("SELECT key, value FROM cursorDiskKV WHERE key >= 'bubbleId:' AND key < 'bubbleId;'"):
        composer, b = key.split(":")[1], _dict(_load(value))
        if composer in heads and isinstance(b.get("text"), str) and b["text"].strip():
            ms = _dict(b.get("timingInfo")).get("clientStartTime")
            ms = ms if isinstance(ms, (int, float)) else 0
            made = heads[composer].get("createdAt")
            yield {"external_id": composer, "title": heads[composer].get("name"), "role": "assistant" if b.get("type") == 2 else "user", "text": b["text"].strip(), "ts": seconds(ms) if ms else None, "line_no": int(ms), "seen_at": seconds(ms or made)}


def _opencode(db: sqlite3.Connection) -> Iterator[dict]:
    sql = "SELECT s.id, s.title, s.directory, m.id, m.time_created, m.data, p.data FROM session s JOIN message m ON m.session_id = s.id JOIN part p ON p.message_id = m.id ORDER BY m.time_created, m.id, p.id"
    last, turn = None, None
    for eid, title, where, mid, at, data, part in db.execute(sql):
        if mid != last:
            if turn and (text := "\n".join(turn.pop("parts")).strip()):
                yield turn | {"text": text}
            role = _dict(_load(data)).get("role")
            last, turn = mid, {"external_id": eid, "title": title, "project_path": where, "role": role if role in ("user", "assistant") else "system", "ts": seconds(at), "line_no": at, "parts": []}
        p = _dict(_load(part))
        if p.get("type") == "text" and isinstance(p.get("text"), str):
            turn["parts"].append(p["text"])
    if turn and (text := "\n".join(turn.pop("parts")).strip()):
        yield turn | {"text": text}


def _codex_threads(db: sqlite3.Connection) -> Iterator[dict]:
    names = "id title cwd git_branch created_at updated_at rollout_path first_user_message".split()
    for row in db.execute(f"SELECT {', '.join(names)} FROM threads"):
        yield dict(zip(names, row))


DATABASES = {"goose": _goose, "cursor": _cursor, "opencode": _opencode}
STATE = "id string, title string, cwd string, git_branch string, created_at bigint, updated_at bigint, rollout_path string, first_user_message string"
#: Rows that a database reader gives back at a time.
FRAME = 5000


def open_database(path: str) -> sqlite3.Connection:
    """A database of another program, read-only, with what its log holds; one that can't be opened so, as on a read-only disk, as it lies there."""
    try:
        db = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
        db.execute("SELECT count(*) FROM sqlite_master").fetchone()
        return db
    except sqlite3.Error:
        db = sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)
        db.execute("SELECT count(*) FROM sqlite_master").fetchone()
        return db


def _database_frames(spark: SparkSession, files: list[str], rows_of: Callable[[sqlite3.Connection], Iterator[dict]], schema: str, ship: bool, more: dict | None = None) -> DataFrame:
    """The rows of database files, a task for each, FRAME at a time; a file that fails gives the rows before its failure.

    Files lie on a disk that every executor sees under the same path; with `ship` their content (of at most 2 GB each) is read through
    Spark from any file system, and each task keeps its copy in a file of its own until it ends.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def frames(path: str) -> Iterator[pd.DataFrame]:
        batch: list[dict] = []
        try:
            with contextlib.closing(open_database(path)) as db:
                db.text_factory = lambda b: b.decode("utf-8", "replace")
                for row in rows_of(db):
                    batch.append(row if more is None else more | {"seen_at": row.get("ts")} | row)
                    if len(batch) >= FRAME:
                        yield pd.DataFrame(batch, columns=names).astype(object)
                        batch = []
        except (sqlite3.Error, ValueError, TypeError, OSError):
            pass
        if batch:
            yield pd.DataFrame(batch, columns=names).astype(object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item in batch.iloc[:, 0]:
                if isinstance(item, str):
                    found = frames(item)
                    yield from (f.where(f.notna(), None) for f in found)
                else:
                    with tempfile.NamedTemporaryFile(suffix=".db") as copy:
                        copy.write(item)
                        copy.flush()
                        yield from (f.where(f.notna(), None) for f in frames(copy.name))

    if ship:
        return spark.read.format("binaryFile").load(files).select("content").repartition(max(1, len(files))).mapInPandas(run, schema)
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInPandas(run, schema)


def sqlite_rows(spark: SparkSession, kind: str, files: list[str], ship: bool = False) -> DataFrame:
    """Messages of database files; damaged rows and files that can't be read are skipped."""
    return _database_frames(spark, files, DATABASES[kind], ROWS, ship, {"source_kind": kind, "block_no": 0})


def state_threads(spark: SparkSession, files: list[str], ship: bool = False) -> DataFrame:
    """The table of threads (STATE) that an agent keeps beside its rollout files."""
    return _database_frames(spark, files, _codex_threads, STATE, ship)


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two readings of one agent; where both have a thread the first one's count."""
    return first.unionByName(second.join(first.select("source_kind", "external_id").distinct(), ["source_kind", "external_id"], "left_anti"))


def uri_to_path(uri: str) -> str:
    """The path of a file URI, percent-decoded, without the slash before a drive letter."""
    path = unquote(uri.removeprefix("file://"))
    return path[1:] if len(path) > 2 and path[0] == "/" and path[2] == ":" else path


def parse_git_log(text: DataFrame) -> DataFrame:
    """Commits of `git log` output in one column value: records parted by 0x1E, fields by 0x1F, then a file a line."""
    record = F.explode(F.split("value", "\x1e")).alias("r")
    fields = F.split("r", "\x1f")
    body = F.split(F.element_at(fields, -1), "\n")
    rows = text.select(record).where(F.trim("r") != "").select(fields.alias("f"), body.alias("b"))
    return rows.select(
        F.trim(F.get("f", F.lit(1))).alias("sha"), F.substring(F.trim(F.get("f", F.lit(1))), 1, 10).alias("short_sha"), F.try_to_number(F.trim(F.get("f", F.lit(2))), F.lit("999999999999")).cast("bigint").alias("committed_at"),
        F.get("b", F.lit(0)).alias("subject"), F.filter(F.slice("b", F.lit(2), F.size("b")), lambda x: F.trim(x) != "").alias("files"),
    )


def scan_all(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], progress: Callable[[str, int], None] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all readers' rows, and for those that fail their errors; a failing source stops no other.

    A lazy frame fails only when it is read, so each source is written to the shared folder by itself; progress gets its name and rows.
    """
    out, failed = None, {}
    for kind, read in readers.items():
        path = table_path(spark, f"scan-{kind}")
        try:
            read().write.parquet(path)
            rows = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            failed[kind] = str(e).split("\n")[0][:160]
            continue
        if progress:
            progress(kind, rows.count())
        out = rows if out is None else out.unionByName(rows)
    return out, failed


def fingerprints(listing: DataFrame) -> DataFrame:
    """(path, mtime, size) a folder of a listing of files: the latest change and the number of files, by which changed_files tells folders of many small files."""
    return listing.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("size"))


def project_roots(paths: DataFrame) -> DataFrame:
    """(project_path, project_key) of distinct project_path values: trimmed, ~ and links resolved, and the folder above that holds .git, where the path exists on the executors' disk; else without slashes at its end. Blank is null."""

    def key(path: str | None) -> str | None:
        p = (path or "").strip()
        if not p:
            return None
        p = os.path.expanduser(p)
        if not os.path.exists(p):
            return p.rstrip("/") or "/"
        p = real = os.path.realpath(p)
        while True:
            if os.path.exists(os.path.join(p, ".git")):
                return p
            if os.path.dirname(p) == p:
                return real
            p = os.path.dirname(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(project_key=[key(x) for x in b["project_path"]])

    return paths.select("project_path").distinct().mapInPandas(run, "project_path string, project_key string")


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files of `listing` (path, mtime, size) that `state` doesn't have in the same form."""
    return listing.join(state.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
