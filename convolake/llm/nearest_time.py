"""Pairing rows of two tables by nearest time within a tolerance, for the same entity.

Both tables are cut into cells of one entity and one stretch of time. A point that lies within the tolerance of a
cell's border is also given to the neighbouring cell, so that every cell holds all candidates of its queries; the cells
are co-grouped, and in each a binary search finds the points on either side of every query.

Before they are co-grouped, both sides are reduced to distinct (entity, second) pairs with partial aggregation on the
map side, points with the smallest id of those at the same second. A cell so holds at most `span + 2 * tolerance` points
and `span` queries however many rows an entity or a second has: the bound on a group's memory is a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.tables import epoch_seconds

#: A cell's stretch of time in seconds: seven days, at most 604,800 distinct queries and 40 MB in Python.
SPAN = 604_800


def entity_key(c: Column) -> Column:
    """A project key without the blanks around it and then without slashes at its end; null stays null."""
    return F.regexp_replace(F.trim(c), "/+$", "")


def match_cell(queries: pd.DataFrame, points: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    """The nearest point of each query, by binary search; equal distances go to the smaller id."""
    points = points.sort_values("t", kind="stable")
    t, ids, q = points["t"].to_numpy(np.int64), points["id"].to_numpy(np.int64), queries["t"].to_numpy(np.int64)
    if not len(t) or not len(q):
        return queries.assign(id=np.int64(0), distance=np.int64(0)).iloc[:0][["entity", "t", "id", "distance"]]
    right = np.searchsorted(t, q)
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(t) - 1)
    dl, dr = np.abs(q - t[left]), np.abs(t[right] - q)
    take = np.where((dl < dr) | ((dl == dr) & (ids[left] <= ids[right])), left, right)
    distance = np.abs(q - t[take])
    out = pd.DataFrame({"entity": queries["entity"].to_numpy(), "t": q, "id": ids[take], "distance": distance})
    return out[distance <= tolerance]


def nearest(queries: DataFrame, points: DataFrame, tolerance: int, span: int = SPAN) -> DataFrame:
    """(entity, t, id, distance) of each distinct (entity, t) of `queries` that has a point within `tolerance`.

    `queries` has entity and t, `points` entity, t and id (bigint); other columns are left aside. Rows with a null in one
    of these match nothing. Repeated rows count once, ties go to the smaller id, an empty side gives an empty result.
    """
    span = max(span, tolerance, 1)
    q = queries.select("entity", F.col("t").cast("bigint").alias("t")).dropna().distinct()
    p = points.select("entity", F.col("t").cast("bigint").alias("t"), F.col("id").cast("bigint").alias("id")).dropna().groupBy("entity", "t").agg(F.min("id").alias("id"))

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(span))

    at = [cell(F.col("t") - tolerance), cell(F.col("t")), cell(F.col("t") + tolerance)]
    p = p.withColumn("cell", F.explode(F.array_distinct(F.array(*at))))
    q = q.withColumn("cell", cell(F.col("t")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return match_cell(left, right, tolerance)

    return q.groupBy("entity", "cell").cogroup(p.groupBy("entity", "cell")).applyInPandas(search, "entity string, t bigint, id bigint, distance bigint")


def nearest_windows(commits: DataFrame, windows: DataFrame, tolerance: int = 7200) -> DataFrame:
    """(sha, thread_id, distance) of each commit and the thread of its project whose start or end lies nearest.

    commits: sha, project_key, committed_at (epoch, any unit). windows: thread_id, project_key, start_ts, end_ts,
    indexed_at. Of each thread only the row with the latest indexed_at counts, and only if its bounds and key are not
    null; a null key, time, sha or thread_id matches nothing. Repeated commits count once.
    """
    latest = (
        windows.where(F.col("thread_id").isNotNull())
        .groupBy("thread_id")
        .agg(F.max(F.struct("indexed_at", "start_ts", "end_ts", "project_key")).alias("w"))
        .where("w.start_ts IS NOT NULL AND w.end_ts IS NOT NULL AND w.project_key IS NOT NULL")
    )
    points = latest.select(
        entity_key(F.col("w.project_key")).alias("entity"),
        F.explode(F.array(epoch_seconds(F.col("w.start_ts")), epoch_seconds(F.col("w.end_ts")))).alias("t"),
        F.col("thread_id").alias("id"),
    )
    asked = commits.where("sha IS NOT NULL AND project_key IS NOT NULL AND committed_at IS NOT NULL").select(
        "sha", entity_key(F.col("project_key")).alias("entity"), epoch_seconds(F.col("committed_at")).alias("t")
    )
    found = nearest(asked, points, tolerance)
    return asked.distinct().join(found, ["entity", "t"]).select("sha", F.col("id").alias("thread_id"), "distance")
