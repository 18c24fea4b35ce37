"""An index of inverted lists over vectors: approximate search that looks into a few lists of each query, with the exact one beside it.

Centroids are fitted on a bounded sample (SAMPLE vectors, a parameter); every vector is then put into the list of its nearest
centroid. A search scores its queries against the rows of their `probes` nearest lists only. Lists are cut into parts of bounded size,
so that one with a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import QUERIES_A_CELL, ROWS_A_CELL, _best_of_cells

#: Vectors on which centroids are fitted, at most; rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def fit(vectors: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length by k-means on a sample, which is drawn by the vectors' hashes and so the same on every run.

    Vectors of another length than most of the sample, null and zero ones are left out; an empty table gives no centroids.
    """
    rows = vectors.select("embedding").where("embedding IS NOT NULL").distinct().orderBy(F.xxhash64("embedding")).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    size = pd.Series([len(r[0]) for r in rows]).mode()[0]
    x = np.array([r[0] for r in rows if len(r[0]) == size], np.float64)
    x = _unit(x[(x * x).sum(axis=1) > 0])
    if not len(x):
        return np.zeros((0, size))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where((sums * sums).sum(axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def _nearest_lists(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """df with a row for each of the `probes` lists nearest to its embedding; null and zero vectors, and those of another length, have none."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)  # lists x dimensions, as the caller chose
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for f in frames:
            f = f[f["embedding"].map(lambda v: v is not None and len(v) == c.shape[1])]
            if not len(f) or not len(c):
                continue
            x = np.stack(f["embedding"].to_list()).astype(np.float64)
            good = (x * x).sum(axis=1) > 0
            f, x = f[good], x[good]
            if len(f):
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, : min(probes, len(c))]
                yield f.iloc[np.repeat(np.arange(len(f)), near.shape[1])].assign(list=near.ravel().astype(np.int32))

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.mapInPandas(run, f"{schema}, list int")


def write(rows: DataFrame, path: str, centroids: np.ndarray) -> None:
    """Every row (owner, id, embedding) into the folder of its list, in parts of about ROWS_A_CELL rows; centroids and the lists' numbers of parts beside them."""
    listed = _nearest_lists(rows.select("owner", "id", "embedding"), centroids, 1)
    listed.write.mode("overwrite").parquet(f"{path}/assigned")
    spark = rows.sparkSession
    listed = spark.read.parquet(f"{path}/assigned")
    parts = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS_A_CELL).cast("int").alias("parts"))
    parts.write.mode("overwrite").parquet(f"{path}/parts")
    spread = listed.join(F.broadcast(spark.read.parquet(f"{path}/parts")), "list")  # a row a list
    spread = spread.withColumn("part", F.pmod(F.xxhash64("owner", "id", "embedding"), F.col("parts")).cast("int")).drop("parts")
    spread.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spread.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")  # an index without rows has no file that holds one
    assigned = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/assigned")
    assigned.getFileSystem(spark._jsc.hadoopConfiguration()).delete(assigned, True)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def search(spark: SparkSession, path: str, queries: DataFrame, floor: float, k: int | None, probes: int) -> DataFrame:
    """As vector.nearest_of_all, over the `probes` lists nearest to each query; all lists give the exact result."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # as many as the caller chose
    centroids = np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))
    asked = _nearest_lists(queries.select("query_id", "query_no", "embedding"), centroids, probes)
    asked = asked.join(F.broadcast(spark.read.parquet(f"{path}/parts")), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    many = max(1, -(-queries.count() // QUERIES_A_CELL))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query_no", "embedding"), F.lit(many)).cast("int"))
    stored = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/lists").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    return _best_of_cells(asked, stored, ["list", "part", "block"], floor, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): how many of the exact results the approximate ones hold; null recall where there are none."""
    key = ["query_id", "query_no", "owner"]
    both = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return both.agg(F.countDistinct("query_id", "query_no").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))
