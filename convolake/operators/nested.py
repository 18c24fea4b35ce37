"""Flattening deeply nested JSON records into related tables by Merkle identities of their subtrees.

Every object, and every element of an array, is a node. Nodes are canonicalised (keys sorted, child nodes replaced by
their hashes) and hashed bottom-up, so that equal subtrees have equal hashes wherever they stand. `objects` stores each
distinct subtree once; `occurrences` (the bridge) keeps every place where it stands, with its record, its parent's place,
the key under which it stands and its ordinal.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "record_id bigint, root_hash string, node_path string, parent_path string, parent_hash string, array_key string, ordinal int, depth int, kind string, node_hash string, body string"
#: Keys of the arrays whose elements are the blocks of a message.
BLOCK_KEYS = ("content", "parts")


def _refuse(constant: str) -> None:
    raise ValueError(constant)


class Number(str):
    """A number as it is written, so that none loses digits or overflows."""


def parse(payload: str | None) -> tuple[bool, object]:
    """Whether payload is one whole JSON text (no NaN or Infinity, nothing after it), and its value."""
    if payload is None:
        return False, None
    try:
        return True, json.loads(payload, parse_constant=_refuse, parse_float=Number, parse_int=Number)
    except (ValueError, RecursionError):
        return False, None


def _scalar(value: object) -> str:
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=True)


def nodes(root: object) -> list[tuple]:
    """(path, parent path, parent hash, array key, ordinal, depth, kind, hash, body) of every node, parents first.

    The walk keeps its own stack, so depth is bounded by memory only. The array key is the key of the nearest array or
    object slot: for an element of an array the key under which that array stands directly, for an object that stands
    directly under a key that key with a null ordinal; elements of an array that itself lies in an array have none.
    """
    def kind_of(v: object) -> str:
        if isinstance(v, dict):
            return "object"
        if isinstance(v, list):
            return "array"
        if isinstance(v, str):
            return "number" if isinstance(v, Number) else "string"
        return "null" if v is None else "boolean" if isinstance(v, bool) else "number"

    order: list[tuple] = []  # parents before children
    stack: list[tuple] = [(root, "", None, None, None, 0)]
    index_of_parent: list[int] = []
    waiting: list[int] = [-1]
    while stack:
        value, path, parent_path, key, ordinal, depth = stack.pop()
        parent = waiting.pop()
        me = len(order)
        order.append((value, path, parent_path, key, ordinal, depth))
        index_of_parent.append(parent)
        if isinstance(value, dict):
            for k in sorted(value):
                v = value[k]
                if isinstance(v, (dict, list)):
                    stack.append((v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", path, k, None, depth + 1))
                    waiting.append(me)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                stack.append((v, f"{path}/{i}", path, key if ordinal is None else None, i, depth + 1))
                waiting.append(me)
    slot: list[dict] = [{} for _ in order]
    hashes: list[str] = [""] * len(order)
    bodies: list[str] = [""] * len(order)
    for me in range(len(order) - 1, -1, -1):
        value, path, parent_path, key, ordinal, depth = order[me]
        mine = slot[me]
        if isinstance(value, dict):
            body = "{" + ",".join(f"{_scalar(k)}:" + (f'{{"$node":"{mine[k]}"}}' if k in mine else _scalar(value[k])) for k in sorted(value)) + "}"
        elif isinstance(value, list):
            body = "[" + ",".join(f'{{"$node":"{mine[i]}"}}' for i in range(len(value))) + "]"
        else:
            body = _scalar(value)
        bodies[me] = body
        hashes[me] = hashlib.blake2b(f"{kind_of(value)}:{body}".encode(), digest_size=16).hexdigest()
        if (up := index_of_parent[me]) >= 0:
            slot[up][ordinal if isinstance(order[up][0], list) else key] = hashes[me]
        slot[me] = {}
    out = []
    for me, (value, path, parent_path, key, ordinal, depth) in enumerate(order):
        up = index_of_parent[me]
        out.append((path, parent_path, hashes[up] if up >= 0 else None, key, ordinal, depth, kind_of(value), hashes[me], bodies[me]))
    return out


def occurrences(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row for each node of each whole payload, with its place and its Merkle hash; see NODES for the columns.

    A record that was sent again with another payload has the nodes of all of its whole payloads, told apart by
    root_hash. Null, empty, cut off and otherwise damaged payloads give no rows. Equal payloads of one record give equal
    rows. Nulls among array elements are nodes of kind null. Numbers stand as they are written: 1.0 and 1.00 differ.
    """

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in NODES.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole, value = parse(text)
                if not whole:
                    continue
                found = nodes(value)
                root = found[0][7]
                rows.extend((rid, root, *n) for n in found)
                if len(rows) > 20_000:
                    yield _batch(rows, names, types)
                    rows = []
            if rows:
                yield _batch(rows, names, types)

    return _payloads(records, record_id, payload).mapInArrow(flatten, NODES)


def _payloads(records: DataFrame, record_id: str, payload: str) -> DataFrame:
    return records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).cast("string").alias("payload"))


def once(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """(record_id, payload): of the payloads of a record with the same root hash one, and no damaged ones.

    Repeats go while they are one row each, so that the nodes, which are many times as large, need no shuffle afterwards.
    """

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nodes(value)[0][7] if whole else None for whole, value in map(parse, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["record_id", "payload", "root_hash"])

    keyed = _payloads(records, record_id, payload).mapInArrow(roots, "record_id bigint, payload string, root_hash string")
    return keyed.where("root_hash IS NOT NULL").dropDuplicates(["record_id", "root_hash"]).select("record_id", "payload")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    def clean(v: object) -> object:  # half of a surrogate pair has no UTF-8 form
        return v.encode("utf-8", "replace").decode() if isinstance(v, str) else v

    columns = [list(c) for c in zip(*rows)]
    arrays = []
    for values, kind in zip(columns, types):
        try:
            arrays.append(pa.array(values, kind))
        except (UnicodeEncodeError, pa.ArrowInvalid):
            arrays.append(pa.array([clean(v) for v in values], kind))
    return pa.RecordBatch.from_arrays(arrays, names)


def objects(nodes_df: DataFrame) -> DataFrame:
    """(node_hash, kind, body): each distinct subtree once."""
    return nodes_df.groupBy("node_hash").agg(F.any_value("kind").alias("kind"), F.any_value("body").alias("body"))


def bridge(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """Every occurrence of a subtree: record, payload, place, parent's place, key, ordinal and hash."""
    return occurrences(once(records, record_id, payload)).drop("body")


def blocks(nodes_df: DataFrame, keys: tuple[str, ...] = BLOCK_KEYS) -> DataFrame:
    """The occurrences that are objects or strings in an array under one of `keys`, or objects that stand there in place of an array."""
    return nodes_df.where(F.col("array_key").isin(*keys) & ((F.col("kind") == "object") | ((F.col("kind") == "string") & F.col("ordinal").isNotNull())))
