"""Mixing sources to target shares of tokens by entropy balancing.

Of all document rates w that give each source its tokens, those are taken that lie nearest to one copy of every document
in relative entropy. For each source s with needed rate r = target tokens / tokens:

    sum w_i t_i = r * sum t_i,    with 0 <= w_i <= m (max_repeats).

With x_i = t_i / mean_s the solution has the form w_i = min(m, exp(b_s x_i)), and b is the zero of the increasing function

    sum x_i min(m, exp(b x_i)) - r * sum x_i,

the derivative of the convex dual, which Newton's method finds: each step sums it and its own derivative over the documents of
every source, on the executors, and only these few numbers reach the driver. Steps that leave the interval known to hold the zero
halve it. So where r > 1 long documents are repeated more than short ones, and where r < 1 they are left out more.
A second constraint, on the number of documents (sum w_i = r * n), would be met with the first by the flat rate r alone, and
nothing would be tilted. A source whose r is max_repeats or more takes max_repeats of each.

Rates become copies: each document gets floor(w), and some get one more. They are ordered by z, a uniform number of their hash
set against the fraction of w, and taken up to the threshold at which the source has its tokens. The document that would
overshoot is passed over, and the search goes on among those that still fit, until none does, so that a source ends less
than its shortest document left out below its target. The hash makes the choice repeatable and independent of partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.session import cut

from . import encoding

#: Bins of a histogram of the thresholds' search, and how often one is taken inside a bin of the last: down to 2^-48.
BINS, LEVELS = 4096, 4
#: Steps within which every dual is solved, as each either closes in quadratically or halves the interval; and how near its tokens must come.
STEPS, CLOSE = 200, 1e-9


def source_key(c: Column) -> Column:
    """Sources are equal when case and surrounding blanks are left aside."""
    return F.lower(F.trim(c))


def listed(targets: DataFrame) -> DataFrame:
    """One row a source of the list: key, share, repeats. A source listed twice has the sum of its shares and the larger cap."""
    rows = targets.where("source IS NOT NULL").select(source_key(F.col("source")).alias("key"), "target_share", "max_repeats")
    return rows.groupBy("key").agg(F.sum("target_share").alias("share"), F.max("max_repeats").cast("bigint").alias("repeats"))


def document_tokens(documents: DataFrame, targets: DataFrame, path: str = encoding.BYTE_BPE) -> DataFrame:
    """(doc_id, key, tokens) of each document of a listed source. Null sources are not listed; null texts have 0 tokens."""
    docs = documents.select("doc_id", source_key(F.col("source")).alias("key"), "text").where("key IS NOT NULL")
    mine = docs.join(listed(targets).select("key"), "key", "left_semi")
    return encoding.token_counts(mine, ["doc_id", "key"], "text", path)


def capacity(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """For each row of the list: source as written, key, tokens, documents and total (T)."""
    sums = tokens.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    rows = targets.where("source IS NOT NULL").select("source", source_key(F.col("source")).alias("key"), "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats"))
    # one row a listed source, so the unpartitioned window is over a few rows
    total = sums.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    both = rows.join(total, "key", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))})
    return both.withColumn("total", F.coalesce(F.max("total").over(Window.partitionBy(F.lit(0))), F.lit(0)))


def _lookup(values: dict[str, float]) -> Column:
    """A source's number, as a map literal: one entry a listed source."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("key")) if values else F.lit(None).cast("double")


def _tilts(histogram: DataFrame, goal: dict[str, tuple[float, float, float]]) -> dict[str, float]:
    """b of each source of goal, key -> (mean tokens, needed rate, most copies), with 0 < needed rate < most copies.

    A source whose dual isn't solved after STEPS steps is an error, never a mix that misses its target unseen.
    """
    at, low, high = dict.fromkeys(goal, 0.0), dict.fromkeys(goal, -math.inf), dict.fromkeys(goal, math.inf)
    open_ = dict(goal)
    for _ in range(STEPS):
        if not open_:
            return at
        x = F.col("tokens") / _lookup({k: g[0] for k, g in open_.items()})
        top = _lookup({k: math.log(g[2]) for k, g in open_.items()})
        e = _lookup({k: at[k] for k in open_}) * x
        w = F.exp(F.least(e, top)) * F.col("n")
        rows = (
            histogram.where(F.col("key").isin(*open_))
            .groupBy("key")
            .agg(F.sum(F.col("n") * x).alias("x"), F.sum(w * x).alias("wx"), F.sum(F.when(e < top, w * x * x).otherwise(0.0)).alias("wxx"))
            .collect()
        )
        for row in rows:
            key, b, wanted = row["key"], at[row["key"]], open_[row["key"]][1] * row["x"]
            miss = row["wx"] - wanted
            if abs(miss) <= CLOSE * wanted or math.nextafter(low[key], math.inf) >= high[key]:
                del open_[key]
                continue
            (high if miss > 0 else low)[key] = b
            to = b - miss / row["wxx"] if row["wxx"] > 0 else math.nan
            if not low[key] < to < high[key]:
                ends = [v for v in (low[key], high[key]) if math.isfinite(v)]
                to = sum(ends) / 2 if len(ends) == 2 else 2 * b + math.copysign(1.0, -miss)
            at[key] = to
    if open_:
        raise RuntimeError(f"no tilt found for {sorted(open_)} in {STEPS} steps")
    return at


def mix(documents: DataFrame, targets: DataFrame, path: str = encoding.BYTE_BPE, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(copies, report). copies: doc_id, key, tokens, rate, copies of each document of a listed source. report: of each row
    of the list its target, cap, tokens, whether the solver reached it (not where all documents stand at their bound and still fall short; a
    source listed twice is one source with the sum of its shares), mixed_tokens, actual_share (of the mix) and
    share_of_total (of T, the tokens of all listed documents once, on which the targets are set). Where sources fall short of their
    target the mix is smaller than T, and the actual shares of the others are larger by the same factor.

    Documents of sources that are not listed are not in the mix. Documents without tokens get floor(rate) copies, which is one in a source that is tilted. An
    empty list or corpus gives an empty mix. Tokens are counted once and kept in the shared folder.
    """
    tokens = cut(document_tokens(documents, targets, path))
    cap = {r["key"]: r for r in capacity(tokens, targets.where("source IS NOT NULL")).groupBy("key").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"), F.max("tokens").alias("tokens"), F.max("documents").alias("documents"), F.max("total").alias("total")).collect()}
    rate = {k: (r["share"] or 0.0) * r["total"] / r["tokens"] for k, r in cap.items() if r["tokens"]}
    full = {k: float(r["repeats"] or 0) for k, r in cap.items()}
    free = {k: (cap[k]["tokens"] / cap[k]["documents"], r, full[k]) for k, r in rate.items() if 0 < r < full[k]}
    histogram = cut(tokens.groupBy("key", "tokens").agg(F.count(F.lit(1)).cast("double").alias("n")))
    found = _tilts(histogram, free)
    exponent = _lookup({k: b / free[k][0] for k, b in found.items()}) * F.col("tokens")
    flat = {k: min(rate.get(k, 0.0), full[k]) for k in cap if k not in found}
    tilted = F.when(exponent.isNotNull(), F.least(F.exp(F.least(exponent, _lookup({k: math.log(full[k]) for k in found}))), _lookup(full)))
    rated = tokens.withColumn("rate", F.coalesce(tilted, _lookup(flat), F.lit(0.0)))
    # a rate that misses a whole number by rounding only is that number
    rated = rated.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-6, F.round("rate")).otherwise(F.col("rate")))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) / F.lit(float(2**52))
    # uniform / part, brought from all positive numbers into 0 to 1
    rated = rated.withColumn("z", F.when((F.col("part") > 0) & (F.col("tokens") > 0), uniform / (uniform + F.col("part"))))
    rated = cut(rated.select("doc_id", "key", "tokens", "rate", "base", "z"))
    sums = rated.groupBy("key").agg(F.sum(F.col("base") * F.col("tokens")).alias("sure"), F.min(F.when(F.col("tokens") > 0, F.col("rate"))).alias("least"), F.sum(F.col("rate") * F.col("tokens")).alias("solved")).collect()
    need = {r["key"]: min(rate.get(r["key"], 0.0), full[r["key"]]) * cap[r["key"]]["tokens"] - r["sure"] for r in sums}
    chosen = _chosen(rated, need)
    copies = rated.withColumn("copies", (F.col("base") + F.when(chosen, 1).otherwise(0)).cast("bigint")).select("doc_id", "key", "tokens", "rate", "copies")
    # the solver's verdict: every document with tokens stands at its bound, and the tokens still fall short
    short = [k for k in cap if not cap[k]["tokens"]] + [r["key"] for r in sums if r["least"] is not None and r["least"] == full[r["key"]] and r["solved"] < cap[r["key"]]["share"] * cap[r["key"]]["total"]]
    return copies, _report(copies, tokens, targets, [k for k in short if (cap[k]["share"] or 0.0) * cap[k]["total"] > 0])


def _chosen(rated: DataFrame, need: dict[str, float]) -> Column:
    """Which documents get one copy more: those with z under a threshold of their source and no more tokens than were open when it was found."""
    left, test = {k: v for k, v in need.items() if v > 0}, F.lit(False)
    while left:
        open_ = F.col("tokens") <= _lookup(left)
        found = _thresholds(rated.where(F.col("z").isNotNull() & F.col("key").isin(*left) & open_ & ~test), left)
        if not found:
            break
        test = test | F.coalesce(open_ & (F.col("z") < _lookup({k: t for k, (t, _) in found.items()})), F.lit(False))
        left = {k: left[k] - took for k, (_, took) in found.items() if 0 < took < left[k]}
    return test


def _thresholds(fits: DataFrame, need: dict[str, float]) -> dict[str, tuple[float, float]]:
    """key -> (threshold of z, tokens under it), the most that does not exceed the need; sources of which `fits` has nothing are left out.

    A histogram of BINS bins a source, then one inside the bin that overshoots, until that bin holds one document. The
    running sums are taken on the executors, so a row a source and histogram reaches the driver.
    """
    low, have, open_, width = dict.fromkeys(need, 0.0), dict.fromkeys(need, 0.0), dict(need), 1.0
    ends: dict[str, tuple[float, float]] = {}
    for _ in range(LEVELS):
        if not open_:
            break
        step, at = width / BINS, _lookup({k: low[k] for k in open_})
        inside = fits.where(F.col("key").isin(*open_) & (F.col("z") >= at) & (F.col("z") < at + width))
        bins = inside.groupBy("key", F.least(F.floor((F.col("z") - at) / step), F.lit(BINS - 1)).alias("bin")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        running = bins.withColumn("sum", F.sum("tokens").over(Window.partitionBy("key").orderBy("bin")))
        over = F.col("sum") + _lookup({k: have[k] for k in open_}) > _lookup(open_)
        rows = running.groupBy("key").agg(F.min(F.when(over, F.struct("bin", "n"))).alias("over"), F.max(F.when(~over, F.col("sum"))).alias("sum")).collect()
        for key, first, under in rows:
            have[key] += under or 0
            low[key] += width if first is None else first["bin"] * step
            if first is None or first["n"] == 1:
                ends[key] = (low[key], have[key])
        open_ = {r["key"]: need[r["key"]] for r in rows if r["key"] not in ends}
        width = step
    return ends | {k: (low[k], have[k]) for k in open_}


def _report(copies: DataFrame, tokens: DataFrame, targets: DataFrame, short: list[str]) -> DataFrame:
    got = copies.groupBy("key").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    whole = got.withColumn("all_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))
    rows = capacity(tokens, targets).join(whole, "key", "left")
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    return rows.select(
        "source", "target_share", "max_repeats", "tokens", "documents", (~F.col("key").isin(*short)).alias("feasible"), mixed.alias("mixed_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(mixed / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce(mixed / F.col("total"), F.lit(0.0)).alias("share_of_total"),
    )
