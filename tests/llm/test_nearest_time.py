import random

from convolake.llm.nearest_time import nearest, nearest_windows

W = "thread_id bigint, project_key string, start_ts bigint, end_ts bigint, indexed_at timestamp, sha string"
C = "sha string, project_key string, committed_at bigint, thread_id bigint"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    points = [(f"p{rng.randint(0, 2)}", rng.randint(0, 4000), rng.randint(1, 60)) for _ in range(300)]
    queries = [(f"p{rng.randint(0, 3)}", rng.randint(-50, 4050)) for _ in range(200)]
    p = spark.createDataFrame(points, "entity string, t bigint, id bigint")
    q = spark.createDataFrame(queries, "entity string, t bigint")
    for tolerance, span in ((30, 100), (5, 7), (400, 50)):
        expected = set()
        for e, t in queries:
            best = min(((abs(t - u), i) for f, u, i in points if f == e and abs(t - u) <= tolerance), default=None)
            if best:
                expected.add((e, t, best[1], best[0]))
        assert set(rows(nearest(q, p, tolerance, span), "entity", "t", "id", "distance")) == expected


def test_cases_of_windows(spark):
    import datetime

    at = datetime.datetime(2025, 1, 1)
    later = datetime.datetime(2025, 1, 2)
    windows = [
        (1, " /srv/a/ ", 1000, 2000, at, "x"), (1, " /srv/a/ ", 1000, 2000, at, "x"),  # comes twice
        (2, "/srv/a", 9000, 9100, at, None), (2, "/srv/a", None, 9100, later, None),  # its latest state has a null bound
        (3, "/srv/a//", 3000, 3500, at, None), (4, None, 1000, 2000, at, None), (None, "/srv/a", 1000, 1000, at, None),
        (9, "/srv/a", 500, 1000, at, None), (5, "/srv/a", 1_736_000_000, 1_736_000_100, at, None),
    ]
    commits = [("inside", "/srv/a", 1400, 7), ("tie", "/srv/a", 1000, 7), ("ms", "/srv/a", 1_736_000_001_999, 7), ("far", "/srv/a", 1_700_000_000, 7), ("null", None, 1000, 7), ("null time", "/srv/a", None, 7), ("edge", "/srv/a", 3500 + 7200, 7), ("edge", "/srv/a", 3500 + 7200, 7), (None, "/srv/a", 1000, 7)]
    found = nearest_windows(spark.createDataFrame(commits, C), spark.createDataFrame(windows, W))
    assert rows(found, "sha", "thread_id", "distance") == [("edge", 3, 7200), ("inside", 1, 400), ("ms", 5, 1), ("tie", 1, 0)]


def test_empty_sides(spark):
    commits, windows = spark.createDataFrame([("a", "/p", 5, 1)], C), spark.createDataFrame([(1, "/p", 1, 2, None, None)], W)
    assert nearest_windows(commits.limit(0), windows).count() == 0
    assert nearest_windows(commits, windows.limit(0)).count() == 0
    assert rows(nearest_windows(commits, windows), "sha", "thread_id") == [("a", 1)]
