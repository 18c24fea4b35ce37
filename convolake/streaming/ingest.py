"""Incremental ingestion with Structured Streaming; batch and stream share the parsers.

The table is cut into buckets by (source_kind, external_id). A micro-batch rewrites only the buckets it touches, into files of its own, and
then names them in a new manifest by one rename: readers see the table before or after a batch, and a batch that is run again
changes nothing. Of each line the payload received last counts, in whatever order batches bring them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.operators import store
from convolake.sources.connectors import ROWS, parse_lines

LINES = "source_kind string, external_id string, line_no bigint, payload string, received_at timestamp"
KEY, BUCKETS, VERSIONS = ["source_kind", "external_id", "line_no"], 64, 3


def lines_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Transcript lines as Parquet files arrive in a folder."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_repeats(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each line once among those that come within the delay; state older than the watermark is dropped."""
    keyed = stream.withWatermark("received_at", delay)
    return keyed.dropDuplicatesWithinWatermark(["source_kind", "external_id", "line_no", "payload"])


class Table:
    """Parsed rows in buckets, of which a manifest says where each lies. Parts of VERSIONS manifests are kept for readers that have begun."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _versions(self) -> list[int]:
        folder = self._path("manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """(version, bucket -> folder below the table); version -1 of an empty table."""
        version = (self._versions() or [-1])[-1] if version is None else version
        if version < 0:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0]
        return version, {int(k): v for k, v in json.loads(text).items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the buckets, or of all: ROWS and received_at. Lines without messages have one row with a null role."""
        folders = [f for b, f in self.manifest()[1].items() if buckets is None or b in buckets]
        reader = self.spark.read.schema(f"{ROWS}, received_at timestamp")
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], f"{ROWS}, received_at timestamp")

    def messages(self) -> DataFrame:
        return self.read().where("role IS NOT NULL")

    def bucket(self):
        return F.pmod(F.xxhash64("source_kind", "external_id"), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, touched: list[int], batch: int) -> None:
        """Puts rows in place of those of the touched buckets. A batch already written leaves all as it is."""
        version, folders = self.manifest()
        if batch <= version:
            return
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{batch}")
        written = {b: f"data/{batch}/bucket={b}" for b in touched if self._fs.exists(self._path(f"data/{batch}/bucket={b}"))}
        folders = {b: f for b, f in folders.items() if b not in touched} | written
        temporary = self._path(f"manifest/.{batch}.tmp")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({str(b): f for b, f in folders.items()}), "utf-8"))
        out.close()
        if not self._fs.rename(temporary, self._path(f"manifest/{batch}.json")):
            raise OSError(f"batch {batch} could not be named in the manifest of {self.path}")
        self._sweep()

    def _sweep(self) -> None:
        """Removes manifests but the last VERSIONS, and folders of buckets that none of these names."""
        versions = self._versions()
        for v in versions[:-VERSIONS]:
            self._fs.delete(self._path(f"manifest/{v}.json"), False)
        used = {f for v in versions[-VERSIONS:] for f in self.manifest(v)[1].values()}
        for batch in self._fs.listStatus(self._path("data")):
            name = batch.getPath().getName()
            parts = [p.getPath().getName() for p in self._fs.listStatus(batch.getPath()) if p.getPath().getName().startswith("bucket=")]
            dead = [p for p in parts if f"data/{name}/{p}" not in used]
            for p in dead:
                self._fs.delete(self._path(f"data/{name}/{p}"), True)
            if len(dead) == len(parts):
                self._fs.delete(batch.getPath(), True)


def newest(rows: DataFrame) -> DataFrame:
    """Of the rows of each line those received last."""
    last = rows.groupBy(*KEY).agg(F.max("received_at").alias("received_at"))
    same = [rows[c].eqNullSafe(last[c]) for c in (*KEY, "received_at")]
    return rows.join(last, same[0] & same[1] & same[2] & same[3], "left_semi").dropDuplicates([*KEY, "block_no"])


def upsert_into(path: str, on_change: Callable[[DataFrame], None] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a batch's lines into a Table. on_change gets (source_kind, external_id, change) of the batch's threads: new, same, append or replace."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Table(spark, path, buckets)
        if number <= table.manifest()[0]:
            return
        latest = batch.groupBy(*KEY).agg(F.max_by(F.struct("payload", "received_at"), "received_at").alias("s")).select(*KEY, "s.*").persist()
        try:
            touched = [r[0] for r in latest.select(table.bucket().alias("b")).distinct().collect()]  # at most as many as there are buckets
            if not touched:
                return
            parsed = parse_lines(latest).join(latest.select(*KEY, "received_at"), KEY)
            # a line that holds no message any more, damaged ones too, still stands for its newest state
            empty = latest.join(parsed.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, "received_at", F.lit(0).alias("block_no"))
            stored = table.read(touched)
            rows = newest(stored.unionByName(parsed).unionByName(empty, allowMissingColumns=True))
            if on_change is not None:
                on_change(changes(stored, rows, latest.select("source_kind", "external_id").distinct()))
            table.write(rows, touched, number)
        finally:
            latest.unpersist()

    return write


def changes(old: DataFrame, new: DataFrame, threads: DataFrame) -> DataFrame:
    """(source_kind, external_id, change) of the threads: whether their messages are new, the same, longer by appended ones only, or replaced."""
    name = ["source_kind", "external_id"]
    as_thread = lambda df: df.where("role IS NOT NULL").join(threads, name, "left_semi").select(F.struct(*name).alias("thread_id"), F.struct("line_no", "block_no").alias("seq"), "text")
    return store.change_kinds(as_thread(old), as_thread(new)).select("thread_id.*", "change")


def daily_activity(stream: DataFrame, time: str = "received_at", delay: str = "1 day") -> DataFrame:
    """Rows a day and source, with late ones within the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), "source_kind").agg(F.count(F.lit(1)).alias("n"))


def drain(pending: Callable[[], DataFrame], work: Callable[[DataFrame], None], key: str, batch: int = 64, rounds: int | None = None) -> int:
    """Works off a list in batches by its key until it is empty (or for some rounds) and says how many rounds it took.

    `pending` reads the list anew, without what is done or has failed for good; `work` must see to that for every row it gets, else the list never ends.
    """
    n = 0
    while rounds is None or n < rounds:
        todo = pending().orderBy(key).limit(batch)
        if todo.isEmpty():
            break
        work(todo)
        n += 1
    return n
