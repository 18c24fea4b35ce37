"""Search, recall, statistics, extraction, correlation and packing queries over the corpus, each with its SQL where SQL can say it."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.operators import extraction as X
from convolake.operators import fulltext as T
from convolake.operators import gitlink as G
from convolake.operators import ivf, store
from convolake.operators import vector as V
from convolake.session import stored
from convolake.tables import read

from . import model as M
from .model import BASE_SQL

QUERY, PUNCTUATED, DAY = "watcher cach", "main.rs régen-x watcher", 86_400
#: Lists of the index of vectors, and how many of them a search looks into.
LISTS, PROBES = 64, 8
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a query and its SQL, which continues BASE_SQL unless base is false."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (BASE_SQL if base else "") + sql
        return f

    return add


def _search(spark: SparkSession, d: str, text: str, limit: int, **filters) -> DataFrame:
    scored = T.bm25(M.message_rows(spark, d, "text"), text)
    t = search_filters(M.threads(spark, d), spark, d, **filters).select(F.col("id").alias("thread_id"))
    return T.ranked(scored.join(t, "thread_id", "left_semi"), len(T.query_terms(text)), limit)


def search_filters(t: DataFrame, spark: SparkSession, d: str, subagents: bool = False, sources: tuple = (), project: str | None = None, project_is: str | None = None, starred: bool | None = None, tags: tuple = ()) -> DataFrame:
    """Threads by the filters that searches and lists share; an unset filter keeps all."""
    if not subagents:
        t = t.where(~F.col("is_subagent"))
    if sources:
        t = t.join(M.sources(spark, d).where(F.col("kind").isin(*sources)), "source_id", "left_semi")
    if project:
        t = t.where(F.col("project").ilike(f"%{project}%"))
    if project_is:
        t = t.where(F.col("project") == project_is)
    if starred is not None:
        state = M.threads_with_user(spark, d).where(F.col("starred") == starred).select("id")
        t = t.join(state, "id", "left_semi")
    if tags:
        hit = M.thread_tags(spark, d).where(F.col("tag").isin(*tags)).select(F.col("thread_id").alias("id"))
        t = t.join(hit, "id", "left_semi")
    return t


def _bm25_sql(text: str) -> str:
    """The SQL of a search for `text`, up to the table kw."""
    phrases = T.query_terms(text)
    n = range(len(phrases))

    def tf(phrase: tuple[str, ...]) -> str:
        *whole, prefix = phrase
        tests = [f"coalesce(ts[i{f' + {k}' if k else ''}], '') = '{w}'" for k, w in enumerate(whole)] + [f"starts_with(coalesce(ts[i + {len(whole)}], ''), '{prefix}')"]
        return f"len(list_filter(range(1, len(ts) + 1), lambda i: {' AND '.join(tests)}))"

    return (
        f""", k AS (
  SELECT id, thread_id, text, coalesce(regexp_extract_all(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}]+'), []) AS ts FROM m
), c AS (
  SELECT id, thread_id, len(ts) AS dl, """
        + ", ".join(f"{tf(p)} AS tf{i}" for i, p in enumerate(phrases))
        + """ FROM k
), s AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl, """
        + ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in n)
        + """ FROM c), b AS (
  SELECT id, thread_id, """
        + " + ".join(f"(tf{i} > 0)::INT" for i in n)
        + " AS matched, round("
        + " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
        + f""", 6) AS score FROM c, s
), f AS (
  SELECT *, (matched = {len(phrases)})::INT AS strict FROM b WHERE matched > 0 AND thread_id IN (SELECT id FROM t WHERE NOT is_subagent)
), kw AS (
  SELECT *, row_number() OVER (ORDER BY strict DESC, score DESC, id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY strict DESC, score DESC, id) AS r FROM f
  ) WHERE r <= 3
)
"""
    )


_BM25_SQL = _bm25_sql(QUERY)


@query(_BM25_SQL + "SELECT id, thread_id, strict, score, rank::INT AS rank FROM kw WHERE rank <= 100")
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Prefix terms ranked by BM25: rows with all terms first, at most three of a thread."""
    return _search(spark, d, QUERY, 100).select("id", "thread_id", "strict", "score", "rank")


@query(
    _BM25_SQL.replace("WHERE NOT is_subagent)", "JOIN sources ON sources.id = t.source_id WHERE NOT is_subagent AND sources.kind IN ('claude_code', 'codex') AND project ILIKE '%harbor%')").replace("SELECT id FROM t JOIN", "SELECT t.id FROM t JOIN")
    + "SELECT id, thread_id, score, rank::INT AS rank FROM kw WHERE rank <= 50"
)
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, QUERY, 50, sources=("claude_code", "codex"), project="harbor").select("id", "thread_id", "score", "rank")


@query(_bm25_sql(PUNCTUATED) + "SELECT id, thread_id, strict, score, rank::INT AS rank FROM kw WHERE rank <= 100")
def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Words with punctuation and accents: a file's name is the phrase of its parts."""
    return _search(spark, d, PUNCTUATED, 100).select("id", "thread_id", "strict", "score", "rank")


@query(_BM25_SQL + "SELECT id, thread_id, strict, score, rank::INT AS rank FROM kw WHERE rank <= 100")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """search_keyword answered by a stored index, of which it reads the postings of its prefixes only. The index of a state of the messages is written once, into the shared folder."""
    path = stored(spark, "index", f"{d}/messages.parquet", lambda to: T.write_index(M.messages(spark, d, "text"), to))
    t = search_filters(M.threads(spark, d), spark, d).select(F.col("id").alias("thread_id"))
    return T.ranked(T.Index(spark, path).bm25(QUERY).join(t, "thread_id", "left_semi"), len(T.query_terms(QUERY)), 100).select("id", "thread_id", "strict", "score", "rank")


_HIT = " OR ".join(f"len(list_filter(coalesce(regexp_extract_all(translate(lower(w), '{T.ACCENTED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}]+'), []), lambda x: starts_with(x, '{t[0]}'))) > 0" for t in T.query_terms(QUERY))


@query(
    _BM25_SQL
    + f""", h AS (SELECT id, any_value(thread_id) AS thread_id, any_value(rank)::INT AS rank, string_split_regex(any_value(m.text), '\\s+') AS ws FROM (SELECT id, rank FROM kw WHERE rank <= 20) JOIN m USING (id) GROUP BY id
), g AS (SELECT *, greatest(1, list_position(list_transform(ws, lambda w: {_HIT}), true) - 6) AS b FROM h)
SELECT id, thread_id, rank, CASE WHEN b > 1 THEN '…' ELSE '' END || array_to_string(list_transform(ws[b:b + 11], lambda w: CASE WHEN {_HIT} THEN chr(1) || w || chr(2) ELSE w END), ' ') || CASE WHEN len(ws) >= b + 12 THEN '…' ELSE '' END AS snippet FROM g"""
)
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The best hits with a window of twelve words around the first match."""
    hits = _search(spark, d, QUERY, 20).select("id", "rank")
    texts = M.message_rows(spark, d, "text").join(hits, "id").dropDuplicates(["id"])
    return texts.select("id", "thread_id", "rank", T.snippet(F.col("text"), QUERY).alias("snippet"))


@query(", k AS (SELECT id, unnest(coalesce(regexp_extract_all(translate(lower(text), '" + T.ACCENTED + "', '" + T.PLAIN + "'), '[\\p{L}\\p{N}]+'), [])) AS term FROM m) SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT term, id, count(*) AS tf FROM k GROUP BY ALL) GROUP BY term")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Each term with the number of messages and of places it stands in, from the inverted index."""
    return T.postings(M.messages(spark, d, "text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@query(", c AS (SELECT id, text, CASE WHEN length(text) <= 1600 THEN 1 ELSE least(16, ceil((length(text) - 1600) / 1400.0) + 1) END AS n FROM m WHERE text IS NOT NULL), e AS (SELECT id, text, unnest(range(0, n::BIGINT))::INT AS chunk_no FROM c) SELECT id, chunk_no, substring(text, chunk_no * 1400 + 1, 1600) AS chunk FROM e")
def chunk_windows_capped(spark: SparkSession, d: str) -> DataFrame:
    return V.chunk_windows(M.messages(spark, d, "text"))


@query(SQL["chunk_windows_capped"].removeprefix(BASE_SQL).replace("least(16, ceil((length(text) - 1600) / 1400.0) + 1)", "ceil((length(text) - 1600) / 1400.0) + 1"))
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows to the end of each text."""
    return V.chunk_windows(M.messages(spark, d, "text"), None)


@query("SELECT id, thread_id FROM m WHERE role IN ('user', 'assistant') AND id NOT IN (SELECT message_id FROM chunks WHERE message_id IS NOT NULL)")
def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Messages by user or assistant that have no vector yet."""
    owners = read(spark, d, "chunks").select(F.col("message_id").alias("id")).distinct()
    return M.messages(spark, d, "role").where(F.col("role").isin("user", "assistant")).join(owners, "id", "left_anti").select("id", "thread_id")


@query("SELECT count(*) FILTER (WHERE id IN (SELECT message_id FROM chunks)) AS done, count(*) AS total FROM m WHERE role IN ('user', 'assistant')")
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    owners = read(spark, d, "chunks").select(F.col("message_id").alias("id")).distinct().withColumn("there", F.lit(True))
    talk = M.messages(spark, d, "role").where(F.col("role").isin("user", "assistant"))
    return talk.join(owners, "id", "left").agg(F.count("there").alias("done"), F.count(F.lit(1)).alias("total"))


# Vector searches answer every stored vector whose message or fact id is divisible by 50: query_id and query_no are the vector's message and chunk, or its fact and 0.
_QS_SQL = """, qs AS (SELECT DISTINCT message_id AS query_id, chunk_no::BIGINT AS query_no, embedding::DOUBLE[] AS e FROM chunks WHERE message_id % 50 = 0 AND embedding IS NOT NULL), sims AS (
  SELECT query_id, query_no, message_id, max(round(list_cosine_similarity(embedding::DOUBLE[], e), 6)) AS similarity FROM vecs, qs GROUP BY ALL
), near AS (SELECT * FROM sims WHERE similarity >= 0.35)
"""
_FACT_QS_SQL = """, qs AS (SELECT DISTINCT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), rec AS (
  SELECT query_id, f.fact_id, f.thread_id, f.kind, f.project, f.text, f.rationale, round(list_cosine_similarity(v.embedding::DOUBLE[], e), 6) AS similarity
  FROM embeddings v JOIN facts f ON f.fact_id = v.vec_id, qs WHERE NOT f.hidden
)
"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "chunks").where(F.col("message_id") % 50 == 0)
    return c.select(F.col("message_id").alias("query_id"), F.col("chunk_no").cast("bigint").alias("query_no"), "embedding").distinct()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select(F.col("message_id").alias("id"), "embedding")


@query(_QS_SQL + "SELECT query_id, query_no, message_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_no ORDER BY similarity DESC, message_id) AS r FROM near) WHERE r <= 200")
def nearest_messages(spark: SparkSession, d: str) -> DataFrame:
    """The 200 nearest messages of each query vector."""
    near = V.nearest_of_all(_queries(spark, d), _vectors(spark, d).withColumn("owner", F.col("id")), V.FLOOR, 200)
    return near.select("query_id", "query_no", F.col("owner").alias("message_id"), "similarity")


@query()
def nearest_messages_indexed(spark: SparkSession, d: str) -> DataFrame:
    """nearest_messages by an index of inverted lists, written once for a state of the chunks, into the shared folder; LISTS lists, of which PROBES are looked into."""
    rows = _vectors(spark, d).withColumn("owner", F.col("id"))
    path = stored(spark, "vectors", f"{d}/chunks.parquet", lambda to: ivf.write(rows, to, ivf.fit(rows, LISTS)))
    return ivf.search(spark, path, _queries(spark, d), V.FLOOR, 200, PROBES).select("query_id", "query_no", F.col("owner").alias("message_id"), "similarity")


@query("SELECT true AS enough")
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the indexed search finds nine tenths of the ten nearest messages of each query vector, or more, against the exact one."""
    near = lambda df: df.select("query_id", "query_no", F.col("message_id").alias("owner"), F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.col("similarity").desc(), "message_id")).alias("n")).where("n <= 10")
    return ivf.recall(near(nearest_messages_indexed(spark, d)), near(nearest_messages(spark, d))).select((F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("enough"))


@query(
    _BM25_SQL
    + _QS_SQL
    + """, sem AS (
  SELECT * FROM (SELECT query_id, query_no, message_id AS id, similarity, row_number() OVER (PARTITION BY query_id, query_no ORDER BY similarity DESC, message_id) AS rank FROM near
  WHERE message_id IN (SELECT id FROM m WHERE thread_id IN (SELECT id FROM t WHERE NOT is_subagent))) WHERE rank <= 100
), words AS (SELECT query_id, query_no, kw.id, kw.rank FROM (SELECT DISTINCT query_id, query_no FROM qs), kw WHERE rank <= 100
), fused AS (
  SELECT query_id, query_no, id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce((0.5 + 0.5 * least(1, greatest(0, (b.similarity - 0.35) / 0.65))) / (60 + b.rank), 0), 9) AS rrf
  FROM words a FULL JOIN sem b USING (query_id, query_no, id)
) SELECT query_id, query_no, id, rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_no ORDER BY rrf DESC, id) AS r FROM fused) WHERE r <= 100"""
)
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The keyword hits fused with the hits of each query vector."""
    q = _queries(spark, d)
    allowed = M.messages(spark, d).join(M.threads(spark, d).where(~F.col("is_subagent")).select(F.col("id").alias("thread_id")), "thread_id", "left_semi").select("id")
    near = V.nearest_of_all(q, _vectors(spark, d).join(allowed, "id", "left_semi").withColumn("owner", F.col("id")), V.FLOOR, 100)
    key = ["query_id", "query_no"]
    sem = near.select(*key, F.col("owner").alias("id"), "similarity", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("similarity").desc(), "owner")).alias("rank"))
    hits = _search(spark, d, QUERY, 100).agg(F.collect_list(F.struct("id", "rank"))).scalar()  # the one list of hits, of 100 at most, for every query vector
    words = q.where("embedding IS NOT NULL").select(*key).distinct().select(*key, F.explode(hits).alias("hit")).select(*key, "hit.*")
    named = lambda df: df.withColumn("id", F.struct(*key, "id"))
    fused = V.fuse(named(words), named(sem), "id").select("id.*", "rrf")
    best = Window.partitionBy(*key).orderBy(F.col("rrf").desc(), "id")
    return fused.withColumn("r", F.row_number().over(best)).where("r <= 100").drop("r")


@query(
    _QS_SQL
    + """, hit AS (
  SELECT query_id, query_no, m.thread_id, n.message_id, n.similarity, row_number() OVER (PARTITION BY query_id, query_no, m.thread_id ORDER BY n.similarity DESC, n.message_id) AS r
  FROM near n JOIN m ON m.id = n.message_id JOIN t ON t.id = m.thread_id WHERE NOT t.is_subagent
) SELECT query_id, query_no, thread_id, message_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_no ORDER BY similarity DESC, thread_id) AS k FROM hit WHERE r = 1) WHERE k <= 50"""
)
def related_threads(spark: SparkSession, d: str) -> DataFrame:
    """The 50 threads with the message nearest to each query vector."""
    t = M.threads(spark, d).where(~F.col("is_subagent")).select(F.col("id").alias("thread_id"))
    owner = M.messages(spark, d).join(t, "thread_id", "left_semi").select("id", F.col("thread_id").alias("owner"))
    near = V.nearest_of_all(_queries(spark, d), _vectors(spark, d).join(owner, "id"), V.FLOOR, 50)
    return near.select("query_id", "query_no", F.col("owner").alias("thread_id"), F.col("id").alias("message_id"), "similarity")


def _recall_all(spark: SparkSession, d: str, kinds: tuple, owner: str, floor: float, k: int | None = None) -> DataFrame:
    """Like nearest_of_all, for the visible facts of the kinds, owned by themselves or by their projects."""
    q = read(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.lit(0).cast("bigint").alias("query_no"), "embedding").distinct()
    f = M.facts(spark, d).where(~F.col("hidden") & F.col("kind").isin(*kinds)).select("fact_id", F.col(owner).alias("owner"))
    return V.nearest_of_all(q, M.fact_vectors(spark, d).join(f, "fact_id").select("owner", F.col("fact_id").alias("id"), "embedding"), floor, k).drop("query_no")


def _facts_of(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return M.facts(spark, d).select(F.col("fact_id").alias("id"), *columns)


@query(
    _FACT_QS_SQL + "SELECT query_id, fact_id, kind, text, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fact_id) AS r FROM rec WHERE kind IN ('decision', 'gotcha') AND similarity >= 0.15) WHERE r <= 50"
)
def recall_facts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and gotchas most like each query vector, with whole texts."""
    near = _recall_all(spark, d, ("decision", "gotcha"), "fact_id", 0.15, 50)
    return near.join(_facts_of(spark, d, "kind", "text"), "id").select("query_id", F.col("id").alias("fact_id"), "kind", "text", "similarity")


@query(_FACT_QS_SQL + "SELECT query_id, thread_id, count(*) AS n, max(similarity) AS best, arg_max(kind, (similarity, -fact_id)) AS kind, arg_max(fact_id, (similarity, -fact_id)) AS fact_id FROM rec WHERE kind IN ('decision', 'gotcha') AND similarity >= 0.1 GROUP BY query_id, thread_id")
def prior_work(spark: SparkSession, d: str) -> DataFrame:
    """Threads by their facts that are like each query vector."""
    near = _recall_all(spark, d, ("decision", "gotcha"), "thread_id", 0.1)
    return near.join(_facts_of(spark, d, "kind"), "id").select("query_id", F.col("owner").alias("thread_id"), "n", F.col("similarity").alias("best"), "kind", F.col("id").alias("fact_id"))


@query(_FACT_QS_SQL + "SELECT query_id, fact_id, project, rationale, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fact_id) AS r FROM rec WHERE kind = 'decision' AND similarity >= 0.12) WHERE r <= 8")
def check_decision(spark: SparkSession, d: str) -> DataFrame:
    """Earlier decisions like each query vector, with their rationale."""
    near = _recall_all(spark, d, ("decision",), "fact_id", 0.12, 8)
    return near.join(_facts_of(spark, d, "project", "rationale"), "id").select("query_id", F.col("id").alias("fact_id"), "project", "rationale", "similarity")


@query("SELECT (SELECT count(*) FROM t) AS threads, (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM sources) AS sources")
def db_stats(spark: SparkSession, d: str) -> DataFrame:
    one = [M.threads(spark, d).select(F.lit("threads").alias("k")), M.messages(spark, d).select(F.lit("messages").alias("k")), M.sources(spark, d).select(F.lit("sources").alias("k"))]
    rows = one[0].union(one[1]).union(one[2])
    return rows.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("threads", "messages", "sources")])


@query("SELECT count(*) AS threads, min(created_at) AS first_at, max(updated_at) AS last_at, sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE is_subagent) AS subagents FROM t")
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.threads(spark, d).agg(F.count(F.lit(1)).alias("threads"), F.min("created_at").alias("first_at"), F.max("updated_at").alias("last_at"), F.sum("bytes").alias("bytes"), F.count_if("is_subagent").alias("subagents"))


@query("SELECT s.kind, count(DISTINCT t.id) AS threads, count(m.id) AS messages FROM sources s JOIN t ON t.source_id = s.id LEFT JOIN m ON m.thread_id = t.id GROUP BY s.kind")
def stats_sources(spark: SparkSession, d: str) -> DataFrame:
    """Threads and messages of each source that has any; messages are counted per thread before they meet the sources."""
    n = M.messages(spark, d).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    t = M.threads(spark, d).select("id", "source_id").join(n, F.col("id") == F.col("thread_id"), "left")
    return t.join(M.sources(spark, d), "source_id").groupBy("kind").agg(F.count(F.lit(1)).alias("threads"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


@query("SELECT role, count(*) AS n FROM m GROUP BY role")
def stats_roles(spark: SparkSession, d: str) -> DataFrame:
    return M.messages(spark, d, "role").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT project_path, count(*) AS n FROM t WHERE project_path <> '' GROUP BY project_path ORDER BY n DESC, project_path LIMIT 8")
def top_projects(spark: SparkSession, d: str) -> DataFrame:
    return M.threads(spark, d).where("project_path <> ''").groupBy("project_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "project_path").limit(8)


@query("SELECT (m.ts // 86400) * 86400 AS day, count(*) AS n FROM m JOIN t ON t.id = m.thread_id WHERE NOT t.is_subagent AND m.role IN ('user', 'assistant') AND m.ts IS NOT NULL AND m.ts >= (SELECT max(ts) FROM m) - 364 * 86400 GROUP BY 1")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Messages by user and assistant a UTC day, of the last 364 days before the newest message."""
    m = M.messages(spark, d, "role", "ts")
    newest = M.message_rows(spark, d, "ts").agg(F.max("ts")).scalar()
    talk = m.where(F.col("role").isin("user", "assistant") & (F.col("ts") >= newest - 364 * DAY))
    t = M.threads(spark, d).where(~F.col("is_subagent")).select(F.col("id").alias("thread_id"))
    return talk.join(t, "thread_id", "left_semi").groupBy((F.floor(F.col("ts") / DAY) * DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tag, count(DISTINCT thread_id) AS n FROM tags GROUP BY tag")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.thread_tags(spark, d).groupBy("tag").agg(F.countDistinct("thread_id").alias("n"))


@query("SELECT project, count(*) AS threads, max(updated_at) AS updated_at FROM t WHERE NOT is_subagent AND message_count >= 4 AND project_path IS NOT NULL GROUP BY project")
def list_projects(spark: SparkSession, d: str) -> DataFrame:
    t = M.threads(spark, d).where("NOT is_subagent AND message_count >= 4 AND project_path IS NOT NULL")
    return t.groupBy("project").agg(F.count(F.lit(1)).alias("threads"), F.max("updated_at").alias("updated_at"))


@query("SELECT regexp_replace(lower(model), '^.*/', '') AS model, count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(cache_write_tokens), 0)::BIGINT AS cache_write_tokens, coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens FROM m WHERE model IS NOT NULL AND ts IS NOT NULL GROUP BY 1")
def usage_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens of each model, names without provider and case; undated calls are left out."""
    kinds = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]
    m = M.messages(spark, d, "model", "ts", *kinds).where("model IS NOT NULL AND ts IS NOT NULL")
    return m.groupBy(F.substring_index(F.lower("model"), "/", -1).alias("model")).agg(F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds])


@query("SELECT thread_id, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS tokens FROM m WHERE model IS NOT NULL AND ts IS NOT NULL GROUP BY thread_id HAVING tokens > 0 ORDER BY tokens DESC, thread_id LIMIT 20")
def top_threads_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    m = M.messages(spark, d, "model", "ts", "input_tokens", "output_tokens").where("model IS NOT NULL AND ts IS NOT NULL")
    s = m.groupBy("thread_id").agg(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))
    return s.where("tokens > 0").orderBy(F.col("tokens").desc(), "thread_id").limit(20)


@query("SELECT thread_id, count(*) AS message_count, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS distillable_count FROM m GROUP BY thread_id")
def thread_metrics(spark: SparkSession, d: str) -> DataFrame:
    return store.metrics(M.message_rows(spark, d, "role", "text"), repeated="id")


@query("SELECT id, title, updated_at FROM t WHERE NOT is_subagent AND starred AND id IN (SELECT thread_id FROM tags WHERE tag IN ('wip', 'docs')) ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 100")
def recent_threads(spark: SparkSession, d: str) -> DataFrame:
    t = search_filters(M.threads(spark, d), spark, d, starred=True, tags=("wip", "docs"))
    return t.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(100).select("id", "title", "updated_at")


@query("SELECT id, bytes, updated_at FROM t WHERE (updated_at IS NULL OR updated_at <= 1737000000) ORDER BY updated_at ASC NULLS FIRST, id LIMIT 100")
def cleanup_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = M.threads(spark, d).where("updated_at IS NULL OR updated_at <= 1737000000")
    return t.orderBy(F.col("updated_at").asc_nulls_first(), "id").limit(100).select("id", "bytes", "updated_at")


@query("SELECT m.thread_id, m.seq, m.role, m.text, m.ts FROM m WHERE m.thread_id = (SELECT min(id) FROM t)")
def thread_detail(spark: SparkSession, d: str) -> DataFrame:
    """A thread's messages; the filter on thread_id reaches the scan."""
    first = read(spark, d, "threads").agg(F.min("id")).scalar()
    return M.messages(spark, d, "role", "text", "ts").where(F.col("thread_id") == first).select("thread_id", "seq", "role", "text", "ts")


_ENDINGS = ", ".join(f"'{e}'" for e in X.ENDINGS)
_PATHS_SQL = f""", w AS (
  SELECT thread_id, seq, generate_subscripts(ws, 1) AS word_no, trim(unnest(ws), '.:*#!?@') AS path FROM (
    SELECT thread_id, seq, string_split_regex(text, '[\\s()\\[\\]{{}}"''`,;<>|=]+') AS ws FROM m WHERE text IS NOT NULL)
), e AS (SELECT *, list_last(string_split(path, '.')) AS ext FROM w WHERE strlen(path) BETWEEN 3 AND 200 AND contains(path, '.') AND NOT contains(path, '://')
), g AS (SELECT * FROM e WHERE regexp_full_match(ext, '[A-Za-z0-9]+') AND NOT regexp_full_match(ext, '[0-9]+') AND length(path) - length(ext) - 1 > 0 AND (contains(path, '/') OR lower(ext) IN ({_ENDINGS}))
), one AS (SELECT *, row_number() OVER (PARTITION BY thread_id, lower(path) ORDER BY seq, word_no) AS r FROM g
), mentions AS (SELECT thread_id, path FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq, word_no, lower(path)) AS n FROM one WHERE r = 1) WHERE n <= 200)
"""


@query(_PATHS_SQL + "SELECT thread_id, path FROM mentions")
def file_mentions_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 different paths of each thread."""
    return X.paths(M.message_rows(spark, d, "text"), X.PATHS_A_THREAD)


_ALL_PATHS_SQL = _PATHS_SQL.replace(" WHERE n <= 200)", ")")


@query(_ALL_PATHS_SQL + "SELECT thread_id, path FROM mentions")
def file_mentions(spark: SparkSession, d: str) -> DataFrame:
    """All different paths of each thread."""
    return X.paths(M.message_rows(spark, d, "text"))


@query(_PATHS_SQL + "SELECT id, title FROM t WHERE NOT is_subagent AND id IN (SELECT thread_id FROM mentions WHERE contains(lower(path), 'rank/main')) ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 40")
def threads_for_file_capped(spark: SparkSession, d: str) -> DataFrame:
    return T.threads_with_file(X.paths(M.message_rows(spark, d, "text"), X.PATHS_A_THREAD), M.threads(spark, d), "rank/main", 40).select("id", "title")


@query(SQL["threads_for_file_capped"].replace(_PATHS_SQL, _ALL_PATHS_SQL), base=False)
def threads_for_file(spark: SparkSession, d: str) -> DataFrame:
    return T.threads_with_file(M.mentions(spark, d), M.threads(spark, d), "rank/main", 40).select("id", "title")


_LINKS_SQL = (
    _PATHS_SQL
    + """, sp AS (
  SELECT t.id AS thread_id, regexp_replace(trim(t.project), '/+$', '') AS project, min(m.ts) AS s, max(m.ts) AS e FROM t JOIN m ON m.thread_id = t.id
  WHERE NOT t.is_subagent AND t.project IS NOT NULL AND m.ts IS NOT NULL GROUP BY ALL
), c AS (
  SELECT DISTINCT sha, regexp_replace(trim(project_key), '/+$', '') AS project, CASE WHEN committed_at >= 100000000000 THEN committed_at // 1000 ELSE committed_at END AS at_s, files FROM commits WHERE project_key IS NOT NULL
), cf AS (SELECT DISTINCT sha, project, at_s, lower(unnest(files)) AS f FROM c), mm AS (SELECT DISTINCT thread_id, lower(path) AS p FROM mentions
), ov AS (
  SELECT sp.thread_id, cf.sha, cf.at_s AS committed_at, count(DISTINCT cf.f) AS overlap FROM sp JOIN cf ON cf.project = sp.project AND cf.at_s BETWEEN sp.s - 3600 AND sp.e + 86400
  JOIN mm ON mm.thread_id = sp.thread_id AND (mm.p = cf.f OR (contains(cf.f, '/') AND ends_with(mm.p, '/' || cf.f)) OR (contains(mm.p, '/') AND ends_with(cf.f, '/' || mm.p))) GROUP BY ALL
), links AS (SELECT thread_id, sha, committed_at, overlap FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY overlap DESC, committed_at DESC, sha) AS n FROM ov) WHERE n <= 5)
"""
)


def _links(spark: SparkSession, d: str, paths: int | None = X.PATHS_A_THREAD, most: int | None = G.PER_THREAD, **around: int) -> DataFrame:
    spans = G.windows(M.threads(spark, d), M.message_rows(spark, d, "ts"))  # repeats don't move the first and the last
    said = M.mentions(spark, d, repeated=True) if paths is None else X.paths(M.message_rows(spark, d, "text"), paths)
    return G.thread_commits(spans, said, G.clean_commits(read(spark, d, "commits")), most, **around)


@query(_LINKS_SQL + "SELECT thread_id, sha, committed_at, overlap FROM links")
def thread_commits_capped(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


_ALL_PATHS_LINKS_SQL = _LINKS_SQL.replace(_PATHS_SQL, _ALL_PATHS_SQL)


@query(_ALL_PATHS_LINKS_SQL + "SELECT thread_id, sha, committed_at, overlap FROM links")
def thread_commits_best(spark: SparkSession, d: str) -> DataFrame:
    """The best five commits of each thread by all of its paths."""
    return _links(spark, d, None)


_ALL_LINKS_SQL = _ALL_PATHS_LINKS_SQL.replace(" WHERE n <= 5)", ")")


@query(_ALL_LINKS_SQL + "SELECT thread_id, sha, committed_at, overlap FROM links")
def thread_commits(spark: SparkSession, d: str) -> DataFrame:
    """All commits of each thread by all of its paths."""
    return _links(spark, d, None, None)


@query(_LINKS_SQL + "SELECT sha, committed_at, count(*) AS threads, max(overlap) AS overlap FROM links GROUP BY ALL ORDER BY committed_at DESC, sha LIMIT 50")
def commit_timeline_capped(spark: SparkSession, d: str) -> DataFrame:
    return G.timeline(_links(spark, d), 50)


@query(SQL["commit_timeline_capped"].replace(_LINKS_SQL, _ALL_LINKS_SQL), base=False)
def commit_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Threads of each commit, counted over all links."""
    return G.timeline(_links(spark, d, None, None), 50)


@query(_ALL_LINKS_SQL + "SELECT DISTINCT l.thread_id, l.sha, l.overlap FROM links l JOIN commits c ON starts_with(l.sha, lower(trim(c.short_sha)))")
def commits_by_sha(spark: SparkSession, d: str) -> DataFrame:
    """The links of the commits that a list names by their short shas, here in capitals and with blanks."""
    needles = read(spark, d, "commits").select(F.concat(F.lit(" "), F.upper("short_sha")).alias("needle"))
    return G.by_sha(_links(spark, d, None, None), needles).select("thread_id", "sha", "overlap")


@query(_ALL_LINKS_SQL.replace("sp.s - 3600 AND sp.e + 86400", "sp.s - 2592000 AND sp.e + 2592000") + "SELECT thread_id, sha, committed_at, overlap FROM links")
def thread_commits_month(spark: SparkSession, d: str) -> DataFrame:
    """All commits that share files with a thread, from a month before to a month after it."""
    return _links(spark, d, None, None, before=30 * DAY, after=30 * DAY)
