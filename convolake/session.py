"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Defaults of a session made here; a session made elsewhere keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # files of checkpoint() go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config(map=DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | conf)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the session runs on one machine and names none."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir() + "/convolake-shared"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that later passes and lost executors do not compute it again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of what `write` makes of a source, in the shared folder: made once for each state of the source, then found again.

    The state is the source's path, latest change and length. It is written beside its place and put there by one rename, so that a run that fails leaves no half.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    at = path(source)
    files = at.getFileSystem(conf)
    about = files.getContentSummary(at)
    changed = max([files.getFileStatus(at).getModificationTime(), *(f.getModificationTime() for f in files.listStatus(at))])
    state = hashlib.blake2b(f"{source} {changed} {about.getLength()}".encode(), digest_size=12).hexdigest()
    final = f"{shared_dir(spark).rstrip('/')}/{name}-{state}"
    here = path(final)
    fs = here.getFileSystem(conf)
    if not fs.exists(here):
        beside = table_path(spark, name)
        write(beside)
        if not fs.rename(path(beside), here) or fs.exists(path(f"{final}/{path(beside).getName()}")):
            # another run was faster; where a rename moves into a folder that is there, its copy goes too
            fs.delete(path(beside), True)
            fs.delete(path(f"{final}/{path(beside).getName()}"), True)
    return final
