import datetime
import json

from convolake.sources.connectors import parse_lines
from convolake.streaming import ingest

AT = datetime.datetime(2025, 1, 1)


def line(n, text):
    return ("claude_code", "e", n, json.dumps({"type": "user", "message": {"content": text}}), AT)


def write(spark, folder, rows):
    spark.createDataFrame(rows, ingest.LINES).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))

    def drain():
        q = ingest.lines_stream(spark, folder).writeStream.foreachBatch(ingest.upsert_into(table, buckets=4)).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    write(spark, folder, [line(0, "a"), line(1, "b")])
    drain()
    write(spark, folder, [line(1, "b"), line(2, "c"), line(0, "a")])
    drain()
    got = sorted((r.line_no, r.text) for r in ingest.Table(spark, table).messages().collect())
    assert got == [(0, "a"), (1, "b"), (2, "c")]
    batch = parse_lines(spark.read.schema(ingest.LINES).parquet(folder).drop("received_at").distinct())
    assert sorted((r.line_no, r.text) for r in batch.collect()) == got


def at(row, hours, thread="e"):
    return (row[0], thread, *row[2:4], AT + datetime.timedelta(hours=hours))


def test_late_payloads_cleared_lines_and_kinds_of_change(spark, tmp_path):
    seen = []
    table = ingest.Table(spark, str(tmp_path / "t"), 4)
    put = ingest.upsert_into(table.path, lambda df: seen.append({r.external_id: r.change for r in df.collect()}), 4)
    df = lambda rows: spark.createDataFrame(rows, ingest.LINES)
    texts = lambda: sorted((r.external_id, r.line_no, r.text) for r in table.messages().collect())
    put(df([at(line(0, "new"), 5), at(line(1, "b"), 5), at(line(0, "other"), 1, "f")]), 0)
    put(df([at(line(0, "older"), 2)]), 1)  # comes later and is older
    assert texts() == [("e", 0, "new"), ("e", 1, "b"), ("f", 0, "other")]
    kept = {b: f for b, f in table.manifest()[1].items() if "data/0" in f}
    assert kept  # the other thread's bucket was not written again, or both share one
    put(df([at(line(2, "c"), 6)]), 2)
    put(df([at(("claude_code", "e", 1, "{broken", AT), 7)]), 3)
    assert texts() == [("e", 0, "new"), ("e", 2, "c"), ("f", 0, "other")]
    put(df([at(line(1, "late again"), 6)]), 4)
    assert texts() == [("e", 0, "new"), ("e", 2, "c"), ("f", 0, "other")]
    put(df([at(line(0, "x"), 9)]), 3)  # a batch that was written before
    put(df([]), 5)
    assert texts() == [("e", 0, "new"), ("e", 2, "c"), ("f", 0, "other")]
    assert seen == [{"e": "new", "f": "new"}, {"e": "same"}, {"e": "append"}, {"e": "replace"}, {"e": "same"}]
    assert len(list((tmp_path / "t/manifest").glob("*.json"))) <= ingest.VERSIONS


def test_worklists_are_drained(spark):
    done = []
    todo = lambda: spark.createDataFrame([(i,) for i in range(10) if i not in done], "id bigint")
    assert ingest.drain(todo, lambda df: done.extend(r.id for r in df.collect()), "id", batch=4) == 3 and sorted(done) == list(range(10))
    assert ingest.drain(todo, lambda df: None, "id") == 0


def test_repeats_within_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [line(0, "a"), line(0, "a"), line(1, "b")])
    q = ingest.without_repeats(ingest.lines_stream(spark, folder)).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
