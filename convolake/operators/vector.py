"""Vectors: chunk windows, nearest neighbours, rank fusion and roll-ups of recalled facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, STEP, MOST_CHUNKS = 1600, 1400, 16
FLOOR, RECALL_FLOOR, PRIOR_FLOOR = 0.35, 0.45, 0.55
RRF = 60


def chunk_windows(messages: DataFrame, most: int | None = MOST_CHUNKS) -> DataFrame:
    """(id, chunk_no, chunk): windows of 1600 characters every 1400, the first `most` or, if None, to the end of each text."""
    n = F.when(F.length("text") <= CHUNK, 1).otherwise(F.ceil((F.length("text") - CHUNK) / F.lit(STEP)) + 1).cast("int")
    n = n if most is None else F.least(F.lit(most), n)
    rows = messages.where("text IS NOT NULL").select("id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select("id", "chunk_no", F.col("text").substr(F.col("chunk_no") * STEP + 1, F.lit(CHUNK)).alias("chunk"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity in double, rounded to 6 digits; null for a null or a zero vector or another length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(_dot(vector, vector)) * F.sqrt(_dot(q, q))
    return F.when((F.size(vector) == len(query)) & (norm > 0), F.round(_dot(vector, q) / norm, 6))


def nearest(vectors: DataFrame, owner: str, query: list[float], k: int, floor: float | None = FLOOR) -> DataFrame:
    """(owner, similarity): the k owners whose best vector is most similar and at least `floor`; ties by owner."""
    scored = vectors.select(owner, cosine(F.col("embedding"), query).alias("similarity")).where("similarity IS NOT NULL")
    best = scored.groupBy(owner).agg(F.max("similarity").alias("similarity"))
    if floor is not None:
        best = best.where(F.col("similarity") >= floor)
    return best.orderBy(F.col("similarity").desc(), F.col(owner)).limit(k)


def sem_weight(similarity: Column) -> Column:
    return 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity - FLOOR) / (1 - FLOOR)))


def fuse(keyword: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """(key, rrf) by reciprocal ranks: keyword has key and rank (from 1), semantic key, similarity and rank; both are top lists."""
    both = keyword.select(key, F.col("rank").alias("kw")).join(semantic.select(key, F.col("rank").alias("sem"), "similarity"), key, "full_outer")
    score = F.coalesce(1.0 / (RRF + F.col("kw")), F.lit(0.0)) + F.coalesce(sem_weight(F.col("similarity")) / (RRF + F.col("sem")), F.lit(0.0))
    return both.select(key, F.round(score, 9).alias("rrf"))


def with_rank(top: DataFrame, *order: Column) -> DataFrame:
    """Ranks of a list that is already limited."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Queries and numbers in the vectors of a cell of the search for many queries, vectors of a part of the index, and queries and vectors scored at a time.
QUERIES_A_CELL, NUMBERS_A_CELL, ROWS_A_CELL, BLOCK, TILE = 4096, 3_145_728, 16_384, 128, 8192


def nearest_of_all(queries: DataFrame, rows: DataFrame, floor: float, k: int | None = None) -> DataFrame:
    """(query_id, query_no, owner, n, similarity, id): for each query the k owners (all, if k is None) with the most similar vector.

    queries has query_id, query_no and embedding; rows has owner, id and embedding. n, which comes only without k, is the number of an owner's vectors of at
    least `floor`, id that of the best, the smallest of equals. Both sides are dealt to the cells of a grid, so each pair meets in one cell; a cell's
    k best owners hold all that can be among the k best, and a cell holds as many vectors as their length allows, as each returns k rows a query.
    Null and zero vectors and those of another length match nothing.
    """
    numbers = rows.agg(F.coalesce(F.sum(F.greatest(F.size("embedding"), F.lit(1))), F.lit(0))).first()[0]
    across, down = (max(1, -(-n // size)) for n, size in ((queries.count(), QUERIES_A_CELL), (numbers, NUMBERS_A_CELL)))

    def dealt(df: DataFrame, mine: str, parts: int, other: str, others: int, *key: str) -> DataFrame:
        numbered = df.where("embedding IS NOT NULL").withColumn(mine, F.pmod(F.xxhash64(*key, "embedding"), F.lit(parts).cast("bigint")))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))

    q = dealt(queries.select("query_id", "query_no", "embedding"), "q", across, "r", down, "query_id", "query_no")
    r = dealt(rows.select("owner", "id", "embedding"), "r", down, "q", across, "owner", "id")
    return _best_of_cells(q, r, ["q", "r"], floor, k)


def _best_owners(x: np.ndarray, y: np.ndarray, code: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the k owners with the most similar row of at least `floor`, for each of the queries x; ties by owner, then by row.

    Rows are in the order of their owners' codes. Similarities in single precision, tile by tile, only leave out what lies below the k-th best owner
    so far by more than their error and the rounding; what is left is computed in double.
    """
    length = x.shape[1]
    slack = 2e-6 + 2 * (length + 8) * 1.2e-7
    nx, ny = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
    fx, fy = (x / nx[:, None]).astype("float32"), np.ascontiguousarray((y / ny[:, None]).astype("float32").T)
    owners = int(code[-1]) + 1
    out = []
    for at in range(0, len(x), BLOCK):
        block = fx[at : at + BLOCK]
        least = np.full(len(block), floor - slack, "float32")
        held, fresh, done, next_cut = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "float32")), [], 0, 1
        for tile, start in enumerate(range(0, len(y), TILE), 1):
            s = block @ fy[:, start : start + TILE]
            hit = np.flatnonzero(s >= least[:, None])
            i, j = np.divmod(hit, s.shape[1])
            fresh.append((i, j + start, s.ravel()[hit]))
            done += len(hit)
            if tile < next_cut and done < 4 * k * len(block):
                continue
            next_cut, done = max(next_cut, 2 * tile), 0
            i, j, v = (np.concatenate(c) for c in zip(held, *fresh))
            fresh = []
            order = np.lexsort((-v, code[j], i))
            i, j, v = i[order], j[order], v[order]
            first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (code[j[1:]] != code[j[:-1]])][: len(i)])
            top = first[np.lexsort((-v[first], i[first]))]
            rank = np.arange(len(top)) - np.searchsorted(i[top], i[top])
            kth = top[rank == k - 1]
            least[i[kth]] = np.maximum(least[i[kth]], v[kth] - np.float32(slack))
            keep = v >= least[i]
            held = (i[keep], j[keep], v[keep])
        i, j, v = (np.concatenate(c) for c in zip(held, *fresh))
        exact = np.round(np.einsum("ij,ij->i", x[at + i], y[j]) / (nx[at + i] * ny[j]), 6)
        i, j, exact = (c[exact >= floor] for c in (i, j, exact))
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.sort(np.unique(i * owners + code[j], return_index=True)[1])
        i, j, exact = i[first], j[first], exact[first]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[best], j[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _best_of_cells(q: DataFrame, r: DataFrame, cell: list[str], floor: float, k: int | None) -> DataFrame:
    """The results of nearest_of_all from queries and rows that meet in cells, each pair in one at most."""
    owner = r.schema["owner"].dataType.simpleString()

    def score(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length in set(mine["embedding"].map(len)) & set(theirs["embedding"].map(len)) - {0}:
            a, b = (df[df["embedding"].map(len) == length] for df in (mine, theirs))
            codes, names = pd.factorize(b["owner"], sort=True, use_na_sentinel=False)
            b = b.assign(code=codes).sort_values(["code", "id"])
            x, y = (np.stack(df["embedding"].to_list()).astype("float64") for df in (a, b))
            nx, ny = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
            a, x, nx, b, y, ny = a[nx > 0], x[nx > 0], nx[nx > 0], b[ny > 0], y[ny > 0], ny[ny > 0]
            if not len(a) or not len(b):
                continue
            code, ids = b["code"].to_numpy(), b["id"].to_numpy()
            if k is not None:
                i, j, best = _best_owners(x, y, code, floor, k)
                out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy()[i], "query_no": a["query_no"].to_numpy()[i], "owner": names.take(code[j]), "n": 1, "similarity": best, "id": ids[j]}))
                continue
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.r_[starts[1:], len(code)]
            for at in range(0, len(x), BLOCK):
                s = np.round(x[at : at + BLOCK] @ y.T / (nx[at : at + BLOCK, None] * ny[None, :]), 6)
                best, count = np.maximum.reduceat(s, starts, axis=1), np.add.reduceat((s >= floor).astype("int64"), starts, axis=1)
                for i in range(len(s)):
                    hit = np.flatnonzero(best[i] >= floor)
                    if len(hit):
                        first = [starts[g] + int(np.argmax(s[i, starts[g] : ends[g]])) for g in hit]
                        out.append(pd.DataFrame({"query_id": a["query_id"].iloc[at + i], "query_no": a["query_no"].iloc[at + i], "owner": names.take(code[starts[hit]]), "n": count[i][hit], "similarity": best[i][hit], "id": ids[first]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "query_no", "owner", "n", "similarity", "id"])

    found = q.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInPandas(score, f"query_id bigint, query_no bigint, owner {owner}, n bigint, similarity double, id bigint")
    best = found.groupBy("query_id", "query_no", "owner").agg(F.sum("n").alias("n"), F.max(F.struct("similarity", (-F.col("id")).alias("m"))).alias("s"))
    flat = best.select("query_id", "query_no", "owner", "n", F.col("s.similarity").alias("similarity"), (-F.col("s.m")).alias("id"))
    if k is None:
        return flat
    by = Window.partitionBy("query_id", "query_no").orderBy(F.col("similarity").desc(), "owner")
    return flat.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= k).drop("__n", "n")


# ---------------------------------------------------------------- encoding


def hashed_counts(text: Column, buckets: int) -> Column:
    """How many of a text's words fall into each bucket, by the MD5 of the word."""
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
    numbers = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("int") % buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.size(F.filter(numbers, lambda n: n == k)))


def hashing_encoder(text: Column, buckets: int = 8) -> Column:
    """A vector of unit length in the JVM, for corpora without a model: the counts of hashed_counts; a text without words has zeros."""
    counts = F.transform(hashed_counts(text, buckets), lambda n: n.cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * n))
    return F.transform(counts, lambda n: F.when(norm > 0, n / norm).otherwise(0.0).cast("float"))


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """chunks (with chunk) and their embedding by any encoder, which runs on the executors over `batch` texts at a time; a batch that fails has null vectors, so it is not tried for ever."""
    columns = [c for c in chunks.columns if c != "chunk"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list = []
            for at in range(0, len(f), batch):
                texts = f["chunk"].iloc[at : at + batch].tolist()
                try:
                    vectors += [list(map(float, v)) for v in encode(texts)]
                except Exception:  # noqa: BLE001
                    vectors += [None] * len(texts)
            yield f[columns].assign(embedding=vectors)

    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in columns)
    return chunks.mapInPandas(run, f"{schema}, embedding array<float>")


def write_vectors(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, done): stored vectors with those of the new messages in place of their old ones, and the ids of all messages that need no further try, failed ones too."""
    done = new.select("message_id").distinct()
    vectors = stored.join(done, "message_id", "left_anti").unionByName(new.where("embedding IS NOT NULL").select(*stored.columns))
    return vectors, stored.select("message_id").union(done).distinct()


def proactive(found: DataFrame, seen: DataFrame, floor: float = 0.62, most: int = 2, prompt: str | None = None) -> DataFrame:
    """(query_id, thread_id, similarity): of what was found for each query (or session) the `most` best threads of at least `floor` that `seen` (query_id, thread_id) lacks. A prompt of fewer than 12 characters recalls nothing."""
    rows = found.where(F.col("similarity") >= floor).join(seen, ["query_id", "thread_id"], "left_anti")
    if prompt is not None and len(prompt.strip()) < 12:
        rows = rows.limit(0)
    best = rows.groupBy("query_id", "thread_id").agg(F.max("similarity").alias("similarity"))
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "thread_id")
    return best.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= most).drop("__n")
