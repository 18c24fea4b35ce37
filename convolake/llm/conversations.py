"""Rebuilding conversations from message rows, and dropping the broken ones with a finite-state automaton.

Messages are partitioned by ranges of (session, time, id) and sorted within them, so a session that holds a third of
all rows spreads over many partitions. In each partition the automaton runs over the stretch of every session from *every* state
at once: the stretch becomes one function from state to state. The few functions of a session, one for each
partition it touches, are then composed in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.session import cut

# States of a conversation: nothing yet, the user spoke last, the assistant spoke last, broken.
EMPTY, ASKED, ANSWERED, BROKEN = range(4)
# Symbols: a turn by the user, a turn by the assistant, a row that is no turn, a row that breaks the session.
USER, ASSISTANT, OTHER, DAMAGE = range(4)
#: STEP[symbol][state]
STEP = (
    (ASKED, ASKED, ASKED, BROKEN),
    (BROKEN, ANSWERED, ANSWERED, BROKEN),
    (EMPTY, ASKED, ANSWERED, BROKEN),
    (BROKEN, BROKEN, BROKEN, BROKEN),
)
#: Functions from state to state as numbers of base 4, and what each becomes after a symbol.
IDENTITY = sum(s * 4**s for s in range(4))
THEN = [[sum(STEP[symbol][f // 4**s % 4] * 4**s for s in range(4)) for symbol in range(4)] for f in range(256)]

# The spellings of the two roles, in lower case.
ROLES = {"user": USER, "human": USER, "assistant": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}


def _refuse(constant: str) -> None:
    raise ValueError(constant)


READ = "session_id string, id string, at_ms bigint, role string, damaged boolean, parent string"


def read_messages(messages: DataFrame) -> DataFrame:
    """READ of each row with a session: its role in lower case, the message it answers, and whether its data isn't one whole JSON object with a role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, damaged, parents = [], [], []
            for text in batch.column(3).to_pylist():
                try:
                    value = json.loads(text, parse_constant=_refuse) if text is not None else None
                except (ValueError, RecursionError):
                    value = None
                value = value if isinstance(value, dict) else {}
                role, parent = value.get("role"), value.get("parentID")
                roles.append(role.lower() if isinstance(role, str) else None)
                damaged.append(role is None)
                parents.append(parent.encode("utf-8", "replace").decode() if isinstance(parent, str) else None)
            roles = [r if r in ROLES else None for r in roles]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roles, pa.string()), pa.array(damaged, pa.bool_()), pa.array(parents, pa.string())], [x.split()[0] for x in READ.split(", ")])

    rows = messages.where("session_id IS NOT NULL").select("session_id", "id", millis(F.col("time_created")).alias("at_ms"), "data")
    return rows.mapInArrow(run, READ)


def millis(c: Column) -> Column:
    """Epoch milliseconds of a time in seconds, milliseconds or microseconds."""
    c = c.cast("bigint")
    return F.when(F.abs(c) >= 10**14, F.call_function("div", c, F.lit(1000).cast("bigint"))).when(F.abs(c) >= 10**11, c).otherwise(c * 1000)


def text_parts(parts: DataFrame) -> DataFrame:
    """(message_id, part_id, text) of the parts of type text whose text holds more than white space, each once."""
    body = F.get_json_object("data", "$.text")
    kept = parts.where(F.col("message_id").isNotNull() & (F.get_json_object("data", "$.type") == "text")).select("message_id", F.col("id").alias("part_id"), body.alias("text"))
    return kept.where(F.col("text").rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]"))


def rows_of_sessions(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, at_ms, id, role, symbol): each message of a session once, with what it means to the automaton.

    Data are parsed once, before repeated rows are dropped, so that only short columns move; those are kept in the shared folder. A
    parent that no row of the session carries becomes a row of its own that breaks the session; only rows that name one are looked at,
    by session and message, so that no session's rows meet at one key.
    """
    read = cut(read_messages(messages).distinct())
    spoken = text_parts(parts).select(F.col("message_id").alias("id")).distinct().withColumn("spoken", F.lit(True))
    named = read.where("parent IS NOT NULL").select("session_id", F.col("parent").alias("id")).distinct()
    there = read.where("id IS NOT NULL").select("session_id", "id").distinct()
    lost = named.join(there, ["session_id", "id"], "left_anti").select("session_id", F.lit(None).cast("bigint").alias("at_ms"), "id", F.lit(None).cast("string").alias("role"), F.lit(DAMAGE).alias("symbol"))
    by_role = [F.col("role").isin([r for r, s in ROLES.items() if s == symbol]) for symbol in (USER, ASSISTANT)]
    symbol = F.when(F.col("damaged"), DAMAGE).when(F.col("spoken") & by_role[0], USER).when(F.col("spoken") & by_role[1], ASSISTANT).otherwise(OTHER)
    return read.join(spoken, "id", "left").select("session_id", "at_ms", "id", "role", symbol.alias("symbol")).unionByName(lost)


STRETCHES = "session_id string, part int, first_at bigint, first_id string, turns bigint, f int"


def stretches(ordered: DataFrame) -> DataFrame:
    """For each partition and session of range-partitioned, sorted rows: their first key, number of turns and function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now: list | None = None
        rows: list[list] = []
        for batch in batches:
            for session, at, mid, symbol in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if now is None or now[0] != session:
                    now = [session, part, at, mid, 0, IDENTITY]
                    rows.append(now)
                now[4] += symbol <= ASSISTANT
                now[5] = THEN[now[5]][symbol]
            if len(rows) > 10_000:
                yield _stretch_batch(rows[:-1])
                rows = [now]
        if rows:
            yield _stretch_batch(rows)

    return ordered.mapInArrow(run, STRETCHES)


def _stretch_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in STRETCHES.split(", ")])


def in_order(rows: DataFrame) -> DataFrame:
    keys = ["session_id", "at_ms", "id"]
    return rows.select(*keys, "role", "symbol").repartitionByRange(*keys).sortWithinPartitions(*keys)


def verdicts(parts_of_sessions: DataFrame) -> DataFrame:
    """(session_id, state, turns): the automaton's last state. Of a session there are at most as many stretches as partitions."""
    chain = F.array_sort(F.collect_list(F.struct("part", "f")))
    run = F.aggregate(chain, F.lit(EMPTY), lambda state, x: _apply(x["f"], state))
    return parts_of_sessions.groupBy("session_id").agg(run.alias("state"), F.sum("turns").alias("turns"))


def _apply(f: Column, state: Column) -> Column:
    """The digit of f at state, in base 4."""
    digits = [F.shiftright(f, 2 * s).bitwiseAND(F.lit(3)) for s in range(4)]
    return F.when(state == 0, digits[0]).when(state == 1, digits[1]).when(state == 2, digits[2]).otherwise(digits[3])


def dropped(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id) of each session that is empty, broken or without a reply.

    A session is kept only if its turns begin with the user and end with the assistant, all of its rows hold one whole JSON
    object with a role, and every parent named is a message of the session. Rows without session_id belong to none.
    """
    return verdicts(stretches(in_order(rows_of_sessions(messages, parts)))).where(F.col("state") != ANSWERED).select("session_id")


def conversations(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, turn_no, role, at_ms, message_id, part_id, text): the kept sessions, turn by turn.

    Turns are numbered from 1 by time, then message id; role is user or assistant; a turn of several text parts has a
    row for each, in the order of part_id. One row a part keeps a conversation of any length out of a single value.
    """
    ordered = cut(in_order(rows_of_sessions(messages, parts)).withColumn("part", F.spark_partition_id()))
    found = cut(stretches(ordered.drop("part")))
    good = verdicts(found).where(F.col("state") == ANSWERED).select("session_id")
    # turns before a stretch: a window over stretches, of which a session has at most one a partition
    before = F.coalesce(F.sum("turns").over(Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = found.join(good, "session_id", "left_semi").select("session_id", "part", before.alias("before"))
    numbered = number_turns(ordered)
    turns = numbered.join(offsets, ["session_id", "part"]).select("session_id", (F.col("before") + F.col("n")).alias("turn_no"), F.when(F.col("symbol") == USER, "user").otherwise("assistant").alias("role"), "at_ms", F.col("id").alias("message_id"))
    return turns.join(text_parts(parts).distinct(), "message_id").select("session_id", "turn_no", "role", "at_ms", "message_id", "part_id", "text")


def number_turns(ordered: DataFrame) -> DataFrame:
    """The turns of sorted partitions, numbered within partition and session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, n = None, 0
        for batch in batches:
            numbers, keep = [], []
            for i, (s, symbol) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())):
                if s != session:
                    session, n = s, 0
                if symbol <= ASSISTANT:
                    n += 1
                    numbers.append(n)
                    keep.append(i)
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers, pa.int64())], [*out.schema.names, "n"])

    return ordered.mapInArrow(run, "session_id string, at_ms bigint, id string, role string, symbol int, part int, n bigint")
