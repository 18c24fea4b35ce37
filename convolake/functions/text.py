"""Text helpers as columns: titles, project keys, dates, file names, and lenient reading of a model's answer."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(text: Column, most: int = 80) -> Column:
    """The trimmed text, or its first `most` characters and an ellipsis."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def project_key(path: Column) -> Column:
    """A project path without blanks around it and slashes at its end; blank is null."""
    t = F.regexp_replace(F.trim(path), "(?<=.)/+$", "")
    return F.when(t != "", t)


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def slug_to_path(slug: Column) -> Column:
    return F.translate(slug, "-", "/")


def day(epoch: Column) -> Column:
    """An epoch's UTC date as text."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def quoted(s: Column) -> Column:
    """A text as a double-quoted YAML scalar on one line."""
    escaped = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(escaped, r"[\r\n]+", " "), F.lit('"'))


def file_name(date: Column, name: Column, ending: str = ".md") -> Column:
    """A file name of a date and the letters and digits of a name, parted by hyphens."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.concat(F.concat_ws("-", date, F.when(slug != "", F.substring(slug, 1, 60))), F.lit(ending))


def without_marks(snippet: Column) -> Column:
    return F.regexp_replace(snippet, "[\x01\x02]", "")


def turns(packed: Column) -> Column:
    """A packed transcript as its turns again: array of (role, text)."""
    parts = F.filter(F.split(packed, r"(?m)^### (?=\w*\n)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), F.btrim(F.regexp_replace(p, r"^\w*\n", ""), F.lit("\n")).alias("text")))


def token_estimate(text: Column) -> Column:
    return F.call_function("div", F.octet_length(text), F.lit(4))


def read_answer(text: str | None) -> dict:
    """A model's answer as summary, decisions and gotchas: the outermost object in it, code fences and all around left aside; else a summary of its first 2000 characters."""
    body = (text or "").strip()
    start, end = body.find("{"), body.rfind("}")
    if 0 <= start < end:
        try:
            v = json.loads(body[start : end + 1])
            lists = {k: [x.strip() for x in v.get(k) or [] if isinstance(x, str) and x.strip()] for k in ("decisions", "gotchas")}
            return {"summary": str(v.get("summary") or "").strip()} | lists
        except (ValueError, AttributeError, TypeError):
            pass
    return {"summary": body[:2000], "decisions": [], "gotchas": []}


def read_pairs(text: str | None, n: int) -> list[tuple[int, int]]:
    """Pairs of different numbers from 1 to n in a model's answer, the smaller first, each once; none if it can't be read."""
    body = text or ""
    start, end = body.find("["), body.rfind("]")
    try:
        rows = json.loads(body[start : end + 1]) if 0 <= start < end else []
    except ValueError:
        return []
    found: dict[tuple[int, int], None] = {}
    for r in rows:
        pair = (r.get("a"), r.get("b")) if isinstance(r, dict) else tuple(r[:2]) if isinstance(r, list) and len(r) >= 2 else (None, None)
        if all(isinstance(x, int) and 1 <= x <= n for x in pair) and pair[0] != pair[1]:
            found[(min(pair), max(pair))] = None
    return list(found)


def session_id(external_id: Column, is_subagent: Column) -> Column:
    """The session that a transcript's path below its root names: the file's stem, or for a subagent the second folder."""
    parts = F.split(external_id, "/")
    return F.when(is_subagent, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))


def id_below(path: Column, root: str) -> Column:
    """A transcript's path below its root; null for a path elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30))
