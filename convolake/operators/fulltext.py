"""Full-text search: tokens, a stored inverted index, BM25 over prefix phrases, caps and snippets.

A query's words are cut into tokens as the texts are, so `mod.rs` is the phrase of `mod` and a term that `rs` begins. Scores come
either from a scan of the texts (`bm25`), or from an index written once (`write_index`, `Index.bm25`): postings sorted by
term, of which a search reads only the row groups that its prefixes touch, and no text.

Nothing runs when a query is built: the statistics (rows, mean length, document frequencies) are a scalar subquery of the plan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions.stem import stem

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST, PER_THREAD = 500, 3

#: Accented letters of Latin scripts in lower case, and the letters without their accents: all that decompose into one of a to z.
_FOLDED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and "a" <= d[0] <= "z"}
ACCENTED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())
WORD = r"[\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case without accents; a null text has none."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def query_terms(query: str, stemmed: bool = False) -> list[tuple[str, ...]]:
    """A phrase for each of the query's words: its tokens, of which the last stands for all terms that it begins."""
    import regex

    low = "".join(_FOLDED.get(c, c) for c in query.lower())
    found = [tuple(regex.findall(WORD, w)) for w in low.split()]
    return [tuple(map(stem, t)) if stemmed else t for t in found if t]


def _frequency(terms: Column, phrase: tuple[str, ...]) -> Column:
    """How often the phrase stands among the terms."""
    *whole, prefix = phrase
    if not whole:
        return F.size(F.filter(terms, lambda t: t.startswith(prefix)))

    def here(t: Column, i: Column) -> Column:
        test = t == whole[0]
        for n, w in enumerate(whole[1:], 1):
            test = test & F.coalesce(F.get(terms, i + n) == w, F.lit(False))
        return test & F.coalesce(F.get(terms, i + len(whole)).startswith(prefix), F.lit(False))

    return F.size(F.filter(terms, here))


def _scored(counted: DataFrame, stats: DataFrame, n_terms: int) -> DataFrame:
    """Scores of rows with dl and __tf0.. by the one row of stats, a scalar subquery: n, avg and df0..; rows that match nothing are gone."""
    one = stats.select(F.struct("*").alias("s")).scalar()
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(n_terms):
        df, tf = one.getField(f"df{i}"), F.col(f"__tf{i}")
        idf = F.greatest(F.log((one.getField("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / one.getField("avg")))
        matched = matched + (tf > 0).cast("int")
    rows = counted if n_terms else counted.limit(0)
    return rows.select("id", "thread_id", "dl", matched.alias("matched"), F.round(score, 6).alias("score")).where("matched > 0")


def bm25(messages: DataFrame, query: str) -> DataFrame:
    """(id, thread_id, dl, matched, score) of each message that matches at least one phrase; statistics are over all messages.

    `messages` has id, thread_id and text. A text is reduced to its length and its phrases' frequencies where it is read, so the
    removal of repeated rows moves no text. Null and empty texts have length 0 and match nothing; a query without words matches nothing.
    """
    terms = query_terms(query)
    frequencies = {f"__tf{i}": _frequency(F.col("__tokens"), t) for i, t in enumerate(terms)}
    counted = messages.select("id", "thread_id", tokens(F.col("text")).alias("__tokens")).withColumns({"dl": F.size("__tokens")} | frequencies).drop("__tokens").dropDuplicates(["id"])
    mean = F.coalesce(F.try_divide(F.sum("dl"), F.count(F.lit(1))), F.lit(1.0))
    # the thread is only there so that both uses of `counted` need the same columns: Spark then counts once and reuses the exchange
    stats = counted.agg(F.max("thread_id").alias("t"), F.count(F.lit(1)).alias("n"), F.when(mean > 0, mean).otherwise(1.0).alias("avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    return _scored(counted, stats, len(terms))


def ranked(scored: DataFrame, n_terms: int, limit: int, per_thread: int | None = PER_THREAD) -> DataFrame:
    """Rows that match all phrases first, then the others; at most per_thread of a thread (all, if None); the best `limit`, with rank from 1."""
    best = [F.col("strict").desc(), F.col("score").desc(), F.col("id").asc()]
    hits = scored.withColumn("strict", (F.col("matched") == n_terms).cast("int"))
    if per_thread is not None:
        hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy("thread_id").orderBy(*best))).where(F.col("__n") <= per_thread).drop("__n")
    top = hits.orderBy(*best).limit(min(limit, MOST))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # over at most MOST rows


def snippet(text: Column, query: str, width: int = 12) -> Column:
    """`width` words around the first match, which is marked by the characters 1 and 2; the text's start where nothing matches."""
    words = F.split(text, r"\s+")
    terms = query_terms(query)
    hit = lambda w: F.lit(False) if not terms else _any([_frequency(tokens(w), t) > 0 for t in terms])
    first = F.array_position(F.transform(words, hit), F.lit(True)).cast("int")
    start = F.greatest(F.lit(1), first - width // 2)
    window = F.slice(words, start, width)
    marked = F.transform(window, lambda w: F.when(hit(w), F.concat(F.lit("\x01"), w, F.lit("\x02"))).otherwise(w))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(F.size(words) >= start + width, "…").otherwise(""))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# ---------------------------------------------------------------- the stored index


def postings(messages: DataFrame) -> DataFrame:
    """(term, id, tf): the inverted index of `text`."""
    return messages.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def stemmed(rows: DataFrame, column: str = "term") -> DataFrame:
    """rows with the stems of their terms; the stemmer, which is Python, sees each distinct term once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(__stem=b[column].map(stem))

    known = rows.select(column).distinct().mapInPandas(run, f"`{column}` string, __stem string")
    return rows.join(known, column).withColumn(column, F.col("__stem")).drop("__stem")


def write_index(messages: DataFrame, path: str, stems: bool = False) -> None:
    """Writes the index of messages (id, thread_id, text; each once) under path: postings (term, id, thread_id, dl, places), sorted by term, and one row of statistics.

    Terms are spread by ranges of (term, id), so that a word that stands in every text fills many files and a rare one few row groups.
    """
    words = messages.select("id", "thread_id", tokens(F.col("text")).alias("ts"))
    rows = words.select("id", "thread_id", F.size("ts").alias("dl"), F.posexplode("ts").alias("place", "term"))
    rows = stemmed(rows) if stems else rows
    grouped = rows.groupBy("term", "id", "thread_id", "dl").agg(F.array_sort(F.collect_list("place")).alias("places"))  # of one text
    grouped.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ts")).alias("dl"), F.lit(stems).alias("stems")).write.mode("overwrite").parquet(f"{path}/stats")


class Index:
    """An index that write_index has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.postings, self.stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
        self.stems = bool(self.stats.select("stems").first()[0])

    def _term(self, word: str, prefix: bool) -> DataFrame:
        """The postings of a term, or of all that it begins; the bounds reach the scan."""
        t = F.col("term")
        return self.postings.where((t >= word) & (t < word + "\U0010ffff") if prefix else t == word)

    def phrase(self, phrase: tuple[str, ...]) -> DataFrame:
        """(id, thread_id, dl, tf) of the messages in which the phrase stands."""
        at = None
        for n, word in enumerate(phrase):
            here = self._term(word, n == len(phrase) - 1).select("id", "thread_id", "dl", F.explode("places").alias("p")).withColumn("p", F.col("p") - n)
            at = here if at is None else at.join(here.select("id", "p"), ["id", "p"])
        return at.groupBy("id", "thread_id", "dl").agg(F.count(F.lit(1)).alias("tf"))

    def bm25(self, query: str) -> DataFrame:
        """As `bm25`, without a look at any text."""
        terms = query_terms(query, self.stems)
        if not terms:
            return self.postings.select("id", "thread_id", "dl", F.lit(0).alias("matched"), F.lit(0.0).alias("score")).limit(0)
        each = [self.phrase(t).select("id", "thread_id", "dl", F.lit(i).alias("i"), "tf") for i, t in enumerate(terms)]
        rows = each[0]
        for e in each[1:]:
            rows = rows.unionByName(e)
        tf = {f"__tf{i}": F.coalesce(F.sum(F.when(F.col("i") == i, F.col("tf"))), F.lit(0)) for i in range(len(terms))}
        counted = rows.groupBy("id", "thread_id", "dl").agg(*[c.alias(n) for n, c in tf.items()])
        found = rows.agg(F.struct(*[F.count_if(F.col("i") == i).alias(f"df{i}") for i in range(len(terms))]).alias("s")).scalar()
        mean = F.col("dl") / F.col("n")
        stats = self.stats.select("n", F.when(mean > 0, mean).otherwise(1.0).alias("avg"), *[found.getField(f"df{i}").alias(f"df{i}") for i in range(len(terms))])
        return _scored(counted, stats, len(terms))


def threads_with_file(mentions: DataFrame, threads: DataFrame, path: str, limit: int) -> DataFrame:
    """Threads, no subagents, that mention a path holding `path`, newest first."""
    hit = mentions.where(F.contains(F.lower("path"), F.lit(path.lower()))).select("thread_id").distinct()
    found = threads.where(~F.col("is_subagent")).join(hit, threads["id"] == hit["thread_id"], "left_semi")
    return found.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(limit)
