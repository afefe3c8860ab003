"""Driver queries: each operator over the whole test tables, beside the SQL that must agree with it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.config import DAY_MS, Consolidation, Dedup, Expand, IndexOptions, Metric, Retention, Scoring, StoreConfig
from palimpsest.functions import quant
from palimpsest.functions.scalar import decay, iso_from_ms, json_depth, json_get, log_share, text_hash
from palimpsest.functions.text import STOPWORDS, tokenize, tokenize_text
from palimpsest.operators import ann, bm25, fusion, graph, knn, scoring, similarity, stats, versions
from palimpsest.operators.spread import join_large_keys
from palimpsest.plans.compile import compile_filter
from palimpsest.plans.parser import parse
from palimpsest.sources.doubles import ManualClock
from palimpsest.sources.scratch import saved, shared_path
from palimpsest.sources.store import MemoryStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The present and a time in the past, for the events read as a version log.
NOW, PAST = 1_706_140_800_000, 1_705_276_800_000
WORDS = "des que und Haus, lytion THE"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vector"), "label")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(_vectors(spark, d).orderBy("rowid").first().vector)


def _ms(df: DataFrame, name: str) -> Column:
    """Milliseconds of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_millis(name)
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a version log: a user is a row, an error deletes it, and views expire after ten days."""
    events = _table(spark, d, "events")
    at = _ms(events, "ts")
    return events.select(
        F.col("user_id").alias("rowid"), F.lit("events").alias("ns"), F.col("event_id").alias("seqno"), at.alias("tx_ms"),
        (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("key"), F.col("props").alias("metadata"),
        at.alias("created_at"), F.when(F.col("event_type") == "view", at + 10 * DAY_MS).alias("expires_at"),
        F.least(F.col("value") / 100, F.lit(1.0)).cast("float").alias("importance"), F.lit(1.0).cast("float").alias("confidence"),
        at.alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"),
    )


def _accesses(spark: SparkSession, d: str) -> DataFrame:
    """Events as an access log of the rows that users stand for."""
    events = _table(spark, d, "events")
    return events.select(F.col("user_id").alias("rowid"), _ms(events, "ts").alias("at_ms"), F.lit(1).cast("bigint").alias("delta"))


_SQL_LOG = (
    "log AS (SELECT user_id AS rowid, event_id AS seqno, (epoch_us(ts) // 1000) AS tx_ms, event_type = 'error' AS deleted, event_type AS key, props, value, "
    f"CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) + {10 * DAY_MS} END AS expires_at, CAST(least(value / 100, 1.0) AS FLOAT) AS importance FROM events)"
)
_SQL_LATEST = "latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY seqno DESC) = 1)"
_SQL_LIVE = f"NOT deleted AND (expires_at IS NULL OR expires_at > {NOW})"

# ---- vector search ---------------------------------------------------------

_SQL_Q = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
_SQL_SCORES = {
    "cosine": "list_dot_product(embedding::DOUBLE[], qv) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(qv, qv))",
    "dot": "list_dot_product(embedding::DOUBLE[], qv)",
    "l2": "list_sum(list_transform(list_zip(embedding::DOUBLE[], qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
}


def _knn_sql(metric: str, where: str = "true") -> str:
    order = "ASC" if metric == "l2" else "DESC"
    return (
        f"WITH {_SQL_Q} SELECT vec_id AS rowid, round(s, 6) AS score FROM (SELECT vec_id, {_SQL_SCORES[metric]} AS s "
        f"FROM embeddings, q WHERE {where}) ORDER BY s {order}, vec_id LIMIT 10"
    )


def _knn(spark: SparkSession, d: str, metric: Metric, where: Column | None = None) -> DataFrame:
    found = knn.top_k(_vectors(spark, d), _first_vector(spark, d), 10, metric, where)
    return found.select("rowid", _r6("score").alias("score"))


@query(_knn_sql("cosine"))
def knn_cosine_top10(spark, d):
    return _knn(spark, d, Metric.COSINE)


@query(_knn_sql("dot"))
def knn_dot_top10(spark, d):
    return _knn(spark, d, Metric.DOT)


@query(_knn_sql("l2"))
def knn_l2sq_top10(spark, d):
    return _knn(spark, d, Metric.L2)


@query(_knn_sql("cosine", "label IN (3, 5)"))
def knn_filtered(spark, d):
    """Filter first: rows that the filter drops never take a place."""
    return _knn(spark, d, Metric.COSINE, F.col("label").isin(3, 5))


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, d).where("rowid % 20 = 0").select(F.col("rowid").alias("query_id"), F.col("vector").alias("qvec"))


@query(
    "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS rowid, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) "
    "/ sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s "
    "FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT query_id, rowid, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rowid) AS rank FROM s) WHERE rank <= 5"
)
def knn_batch(spark, d):
    """All queries in one scan of the rows."""
    found = knn.batch_top_k(_vectors(spark, d), _query_vectors(spark, d), 5)
    return found.select("query_id", "rowid", _r6("score").alias("score"), "rank")


@query("SELECT CAST(i - 1 AS INTEGER) AS dim, round(min(embedding[i]::DOUBLE), 6) AS low, round(max(embedding[i]::DOUBLE), 6) AS high FROM embeddings, range(1, 65) AS r(i) WHERE i <= len(embedding) GROUP BY i")
def quant_i8_params(spark, d):
    return quant.ranges(_vectors(spark, d)).select("dim", _r6("low").alias("low"), _r6("high").alias("high"))


@query(
    "WITH p AS (SELECT i, min(embedding[i]::DOUBLE) AS low, max(embedding[i]::DOUBLE) AS high FROM embeddings, range(1, 65) AS r(i) WHERE i <= len(embedding) GROUP BY i) "
    "SELECT vec_id AS rowid, CAST(sum(CASE WHEN high = low THEN 0 ELSE least(greatest(round((embedding[i]::DOUBLE - low) / ((high - low) / 255.0)), 0), 255) END) AS BIGINT) AS code_sum "
    "FROM embeddings, p WHERE i <= len(embedding) GROUP BY vec_id"
)
def quant_i8_codes(spark, d):
    """Every vector's byte codes, as their sum."""
    rows = _vectors(spark, d)
    codes = quant.fit(rows).encode(F.col("vector"))
    return rows.select("rowid", F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: s + c).alias("code_sum"))


@query(_knn_sql("cosine"))
def quant_two_stage(spark, d):
    """Coarse scores on byte codes, exact ones for the short list."""
    rows = _vectors(spark, d)
    codes = quant.fit(rows)
    coded = rows.withColumn("code", codes.encode(F.col("vector")))
    found = ann.two_stage(coded, _first_vector(spark, d), 10, codes)
    return found.select("rowid", _r6("score").alias("score"))


@query(_knn_sql("cosine"))
def ann_cells(spark, d):
    """Search over a written inverted file, with all cells probed; tests hold its recall with fewer."""
    index = ann.build(_vectors(spark, d).select("rowid", "vector"), IndexOptions(cells=16))
    return index.search(_first_vector(spark, d), 10, 16).select("rowid", _r6("score").alias("score"))


_SQL_COS_DOT = (
    "s AS (SELECT a.vec_id AS query_id, b.vec_id AS rowid, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, "
    "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c "
    "FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, rowid) AS rc, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, rowid) AS rd FROM s)"
)


@query(f"WITH {_SQL_COS_DOT} SELECT query_id, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE rd <= 10) / count(*) AS recall FROM r WHERE rc <= 10 GROUP BY query_id")
def recall_agreement(spark, d):
    """For every query, the share of its 10 nearest by cosine that are among its 10 nearest by inner product."""
    rows, queries = _vectors(spark, d), _query_vectors(spark, d)
    return ann.recall(knn.batch_top_k(rows, queries, 10), knn.batch_top_k(rows, queries, 10, Metric.DOT)).select("query_id", F.col("n").cast("bigint").alias("n"), "recall")


@query()
def recall_report(spark, d):
    """For every query, the measured recall of the cells and of the byte codes against the exact search."""
    rows, queries = _vectors(spark, d).select("rowid", "vector"), _query_vectors(spark, d)
    exact = knn.batch_top_k(rows, queries, 10)
    cells = ann.build(rows, IndexOptions()).batch_search(queries, 10)
    codes = quant.fit(rows)
    coarse = knn.batch_top_k(rows.withColumn("vector", codes.decode(codes.encode(F.col("vector")))), queries, 10)
    found = ann.recall(exact, cells).select("query_id", "n", F.col("recall").alias("cells_recall"))
    return found.join(ann.recall(exact, coarse).select("query_id", F.col("recall").alias("codes_recall")), "query_id")


# ---- text search -----------------------------------------------------------

_SQL_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_SQL_TOKENS = (
    r"list_filter(list_transform(string_split_regex({t}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), "
    r"lambda x: lower(regexp_replace(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''))), "
    rf"lambda x: x <> '' AND x NOT IN ({_SQL_STOP}))"
)


def _bm25_sql(terms: list[str], source: str) -> str:
    """CTEs ending in b (id, s, wanted): scores of a source (id, text, wanted)."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    parts = " + ".join(
        f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * (tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean)))" for i in range(len(terms))
    )
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return (
        f"src AS ({source}), tok AS (SELECT id, wanted, {_SQL_TOKENS.format(t='text')} AS t FROM src), "
        f"c AS (SELECT id, wanted, len(t) AS len, {tf} FROM tok WHERE len(t) > 0), "
        f"st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {df} FROM c), "
        f"b AS (SELECT id, {parts} AS s FROM c, st WHERE wanted AND ({some}))"
    )


_TERMS = sorted(set(tokenize_text(WORDS)))


@query(f"WITH {_bm25_sql(_TERMS, 'SELECT doc_id AS id, text, true AS wanted FROM documents')} SELECT id AS rowid, round(s, 6) AS score FROM b ORDER BY s DESC, id LIMIT 20")
def bm25_top20(spark, d):
    found = bm25.search(_table(spark, d, "documents"), WORDS, 20, rowid="doc_id")
    return found.select("rowid", _r6("score").alias("score"))


_SQL_EN = "SELECT doc_id AS id, text, lang = ''fr'' AS wanted FROM documents".replace("''", "'")


@query(f"WITH {_bm25_sql(_TERMS, _SQL_EN)} SELECT id AS rowid, round(s, 6) AS score FROM b ORDER BY s DESC, id LIMIT 20")
def bm25_filtered(spark, d):
    """The filter decides what is scored; statistics count all documents."""
    found = bm25.search(_table(spark, d, "documents"), WORDS, 20, where=F.col("lang") == "fr", rowid="doc_id")
    return found.select("rowid", _r6("score").alias("score"))


@query(f"SELECT doc_id, CAST(len({_SQL_TOKENS.format(t='text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_SQL_TOKENS.format(t='text')})) AS BIGINT) AS n_terms FROM documents")
def tokens_per_document(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS cf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest({_SQL_TOKENS.format(t='text')}) AS term FROM documents) GROUP BY term")
def inverted_index(spark, d):
    """The whole index, summed up by term."""
    index = bm25.postings(_table(spark, d, "documents"), rowid="doc_id")
    return index.groupBy("term").agg(F.sum("tf").cast("bigint").alias("cf"), F.count(F.lit(1)).alias("df"))


@query(
    f"WITH p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_SQL_TOKENS.format(t='text')}) AS term FROM documents) GROUP BY ALL), "
    "l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY doc_id), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM l), "
    "f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term), "
    f"q AS (SELECT DISTINCT item_id AS query_id, unnest({_SQL_TOKENS.format(t='text')}) AS term FROM benchmark WHERE item_id % 20 = 0), "
    "s AS (SELECT query_id, doc_id AS rowid, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))) AS s "
    "FROM q JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), st GROUP BY ALL) "
    "SELECT query_id, rowid, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rowid) AS rank FROM s) WHERE rank <= 10"
)
def bm25_batch(spark, d):
    """Benchmark items as queries over an inverted index, all in one plan."""
    index = saved(bm25.postings(_table(spark, d, "documents"), rowid="doc_id"), "postings")
    queries = _table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext"))
    found = bm25.batch_search(index, queries, 10)
    return found.select("query_id", "rowid", _r6("score").alias("score"), "rank")


# ---- fusion and the whole pipeline -----------------------------------------


#: The vector of a document that has none.
_PLAIN_VECTOR = [1.0] + [0.0] * 63


def _hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    """All documents and all vectors as records; of equal ids they are one. What has no vector gets a plain one."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("rowid"), "text", "lang")
    both = docs.join(_vectors(spark, d), "rowid", "full")
    vector = F.coalesce("vector", F.lit(_PLAIN_VECTOR).cast("array<float>"))
    return both.withColumn("vector", vector).withColumn("label", F.coalesce("label", F.pmod("rowid", F.lit(10)).cast("int")))


def _channels(spark: SparkSession, d: str, budget: int) -> tuple[DataFrame, DataFrame]:
    rows = _hybrid_rows(spark, d)
    wanted = F.col("label") < 8
    return (
        knn.top_k(rows, _first_vector(spark, d), budget, Metric.COSINE, wanted),
        bm25.search(rows, WORDS, budget, where=wanted),
    )


_SQL_RECORDS = (
    "j AS (SELECT coalesce(doc_id, vec_id) AS id, text, coalesce(label, coalesce(doc_id, vec_id) % 10) AS label, coalesce(label, coalesce(doc_id, vec_id) % 10) < 8 AS wanted, "
    f"coalesce(embedding, {_PLAIN_VECTOR}::FLOAT[]) AS embedding FROM documents FULL JOIN embeddings ON doc_id = vec_id)"
)
_SQL_HYBRID = (
    f"WITH {_SQL_Q}, {_SQL_RECORDS}, "
    + _bm25_sql(_TERMS, "SELECT id, text, wanted FROM j")
    + f", v AS (SELECT id, {_SQL_SCORES['cosine']} AS s FROM j, q WHERE wanted ORDER BY s DESC, id LIMIT 20), "
    "w AS (SELECT id, s FROM b ORDER BY s DESC, id LIMIT 20), "
)


@query(
    _SQL_HYBRID + "r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS p FROM v UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM w) "
    "SELECT id AS rowid, round(sum(p), 6) AS score FROM r GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10"
)
def hybrid_rrf(spark, d):
    near, words = _channels(spark, d, 20)
    return fusion.reciprocal_rank([(near, True), (words, True)], 10).select("rowid", _r6("score").alias("score"))


_SQL_SCALED = "CASE WHEN max(s) OVER () = min(s) OVER () THEN 1.0 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END"


@query(
    _SQL_HYBRID + f"r AS (SELECT id, 0.7 * {_SQL_SCALED} AS p FROM v UNION ALL SELECT id, 0.3 * {_SQL_SCALED} FROM w) "
    "SELECT id AS rowid, round(sum(p), 6) AS score FROM r GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10"
)
def hybrid_weighted(spark, d):
    near, words = _channels(spark, d, 20)
    return fusion.weighted(near, words, 0.7, 10).select("rowid", _r6("score").alias("score"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The 100 nearest vectors with record columns made from the events of the user of the same number."""
    near = knn.top_k(_vectors(spark, d), _first_vector(spark, d), 100)
    last = versions.latest(_log(spark, d)).select("rowid", "created_at", "valid_from", "importance", "confidence")
    rows = _vectors(spark, d).join(F.broadcast(near), "rowid").join(last, "rowid")
    return versions.with_access(rows, _accesses(spark, d))


_SCORING = Scoring(w_sim=0.6, w_recency=0.2, w_importance=0.1, w_access=0.07, w_confidence=0.03, half_life_ms=7 * DAY_MS, floor=0.05)
_SQL_COMPOSITE = (
    f"WITH {_SQL_Q}, {_SQL_LOG}, {_SQL_LATEST}, v AS (SELECT vec_id AS rowid, {_SQL_SCORES['cosine']} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 100), "
    "a AS (SELECT user_id AS rowid, count(*) AS n, max((epoch_us(ts) // 1000)) AS last FROM events GROUP BY user_id), "
    f"j AS (SELECT rowid, {_SQL_SCALED} AS sim, tx_ms, importance, n, last FROM v JOIN latest USING (rowid) JOIN a USING (rowid)), "
    f"t AS (SELECT rowid, CASE WHEN sim < 0.05 THEN 0 ELSE 0.6 * sim + 0.2 * pow(2, -greatest({NOW} - greatest(tx_ms, last), 0) / {7.0 * DAY_MS}) + 0.1 * importance::DOUBLE "
    "+ 0.07 * least(ln(1 + n) / ln(101), 1) + 0.03 END AS s FROM j) "
)


@query(_SQL_COMPOSITE + "SELECT rowid, round(s, 6) AS score FROM t")
def composite_score(spark, d):
    return scoring.composite(_scored(spark, d), _SCORING, NOW).select("rowid", _r6("score").alias("score"))


_SQL_CANDIDATES = (
    _SQL_COMPOSITE + ", u AS (SELECT rowid, s, row_number() OVER (ORDER BY s DESC, rowid) AS i, embedding::DOUBLE[] AS v, "
    "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM t JOIN embeddings ON vec_id = rowid), "
    "m AS (SELECT a.i AS i, b.i AS j, list_dot_product(a.v, b.v) / (a.l * b.l) AS c FROM u a, u b)"
)


@query(
    _SQL_CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + ", far AS (SELECT i, list(j) FILTER (WHERE c >= 0.3) AS near FROM m GROUP BY i), "
    "k AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT k.i + 1, CASE WHEN len(list_intersect(kept, near)) > 0 THEN kept ELSE list_append(kept, k.i + 1) END FROM k JOIN far ON far.i = k.i + 1) "
    "SELECT u.rowid, round(u.s, 6) AS score, CAST(list_position(kept, u.i) AS INTEGER) AS rank FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1), u WHERE list_contains(kept, u.i)"
)
def near_dedup_results(spark, d):
    found = scoring.composite(_scored(spark, d), _SCORING, NOW).select("rowid", "score", "vector")
    return scoring.drop_near(found, 0.3).select("rowid", _r6("score").alias("score"), "rank")


@query(
    _SQL_CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + ", w AS (SELECT 1 AS step, []::BIGINT[] AS chosen UNION ALL "
    "SELECT step + 1, list_append(chosen, (SELECT u.i FROM u WHERE NOT list_contains(chosen, u.i) ORDER BY 0.5 * u.s - 0.5 * coalesce((SELECT max(c) FROM m WHERE m.i = u.i AND list_contains(chosen, m.j)), 0) DESC, u.i LIMIT 1)) "
    "FROM w WHERE step <= 10) SELECT u.rowid, round(u.s, 6) AS score, CAST(list_position(chosen, u.i) AS INTEGER) AS rank FROM (SELECT chosen FROM w ORDER BY step DESC LIMIT 1), u WHERE list_contains(chosen, u.i)"
)
def mmr_top10(spark, d):
    found = scoring.composite(_scored(spark, d), _SCORING, NOW).select("rowid", "score", "vector")
    return scoring.mmr(found, 0.5, 10).select("rowid", _r6("score").alias("score"), "rank")


# ---- filters ---------------------------------------------------------------


def _filtered_events(spark: SparkSession, d: str, condition: str) -> DataFrame:
    rows = versions.with_access(_log(spark, d), _accesses(spark, d))
    return rows.where(compile_filter(parse(condition, NOW))).select(F.col("seqno").alias("event_id"))


def _filtered_docs(spark: SparkSession, d: str, condition: str) -> DataFrame:
    """Documents as records: lang and size in nested JSON, lists and nulls among it."""
    docs = _table(spark, d, "documents").select(
        F.col("doc_id").alias("rowid"), F.col("source").alias("key"),
        F.to_json(
            F.struct(
                F.col("lang"), F.struct(F.col("n_chars").alias("chars"), (F.col("n_chars") / 4).alias("quarter")).alias("size"),
                F.array("lang", "source").alias("tags"), (F.col("n_chars") > 500).alias("long"),
                F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7).alias("week"),
            )
        ).alias("metadata"),
    )
    return docs.where(compile_filter(parse(condition, NOW))).select(F.col("rowid").alias("doc_id"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"SELECT event_id FROM events WHERE (NOT ({_K} < 20) AND event_type IN ('click', 'purchase')) OR {_K} = 99")
def filter_kleene(spark, d):
    return _filtered_events(spark, d, 'not k < 20 and key in ("click", "purchase") or k == 99.0 and not missing == 1 or k == 99')


@query(f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) > {NOW - 7 * DAY_MS} AND (epoch_us(ts) // 1000) <= epoch_ms(TIMESTAMP '2024-01-22 12:00:00') AND CAST(least(value / 100, 1.0) AS FLOAT)::DOUBLE >= 0.25")
def filter_time(spark, d):
    return _filtered_events(spark, d, 'created_at > now - 7d and created_at <= ts"2024-01-22T12:00:00Z" and importance >= 0.25')


@query(f"SELECT event_id FROM events JOIN (SELECT user_id, count(*) AS n, max((epoch_us(ts) // 1000)) AS l FROM events GROUP BY user_id) USING (user_id) WHERE n > 5 AND l < {NOW + 4 * DAY_MS}")
def filter_access(spark, d):
    return _filtered_events(spark, d, "access_count > 5 and last_access < now + 4d")


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('de', 'en') AND n_chars <> 0")
def filter_in(spark, d):
    return _filtered_docs(spark, d, 'not lang in ("de", "en", 3, true) and size.chars != 0')


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source LIKE '%7%'")
def filter_contains(spark, d):
    return _filtered_docs(spark, d, 'tags contains "de" or key contains "7"')


@query("SELECT doc_id FROM documents WHERE source LIKE 'src1_' AND (source LIKE '%5' OR lang LIKE 'e%')")
def filter_glob(spark, d):
    return _filtered_docs(spark, d, 'key ~ "s*1?" and (key endswith "5" or lang startswith "e")')


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND doc_id % 7 >= 3 AND n_chars > 500")
def filter_exists(spark, d):
    return _filtered_docs(spark, d, "exists(week) and week >= 3 and long == true and not is_null(week) and not exists(size.nothing)")


# ---- scans -----------------------------------------------------------------


def _languages(spark: SparkSession, d: str):
    """A store with a namespace for each language of the documents."""
    docs, store = _table(spark, d, "documents"), _store(spark, 1)
    for row in docs.select("lang").distinct().orderBy("lang").collect():
        records = docs.where(F.col("lang").eqNullSafe(row.lang)).select(
            F.col("doc_id").cast("string").alias("key"), F.array(F.lit(1.0)).alias("vector"), F.to_json(F.struct("n_chars")).alias("metadata")
        )
        store.namespace(f"docs/{row.lang or 'none'}").insert_df(records)
    return store


@query("SELECT 'docs/' || coalesce(lang, 'none') AS ns, count(*) FILTER (WHERE n_chars > 300) AS n FROM documents GROUP BY lang")
def scan_count(spark, d):
    """Each namespace counts the records that match."""
    store = _languages(spark, d)
    counts = [(path, store.namespace(path).count("n_chars > 300")) for path in store.list_namespaces()]
    return spark.createDataFrame(counts, "ns string, n bigint")


@query(f"WITH {_SQL_LOG}, {_SQL_LATEST} SELECT rowid, seqno, key, {_SQL_LIVE} AS is_live FROM latest")
def audit_scan(spark, d):
    """Newest versions, tombstones and expired ones too."""
    return versions.latest(_log(spark, d)).select("rowid", "seqno", "key", versions.live(NOW).alias("is_live"))


@query("SELECT c_custkey AS pos, CAST(c_custkey * 7 + 1 AS VARCHAR) AS key, o_totalprice FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7 + 1")
def get_many_positional(spark, d):
    """For each request its record or null, in the order of the requests."""
    space = _store(spark, 1).namespace("orders")
    space.insert_df(_table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.array(F.lit(1.0)).alias("vector"), F.to_json(F.struct("o_totalprice")).alias("metadata")
    ))
    requests = _table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 7 + 1).cast("string").alias("key"))
    return space.get_many_df(requests).select("pos", "key", json_get(F.col("metadata"), "o_totalprice", "double").alias("o_totalprice"))


@query("SELECT DISTINCT 'docs/' || coalesce(lang, 'none') AS path FROM documents")
def list_namespaces(spark, d):
    return _languages(spark, d).view().namespaces()


# ---- versions --------------------------------------------------------------


@query(f"WITH {_SQL_LOG}, {_SQL_LATEST} SELECT rowid, seqno, tx_ms FROM latest")
def latest_version(spark, d):
    return versions.latest(_log(spark, d)).select("rowid", "seqno", "tx_ms")


@query(
    f"WITH {_SQL_LOG}, past AS (SELECT * FROM log WHERE tx_ms <= {PAST} QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY seqno DESC) = 1) "
    f"SELECT rowid, seqno, key FROM past WHERE NOT deleted AND (expires_at IS NULL OR expires_at > {PAST})"
)
def as_of_snapshot(spark, d):
    return versions.visible(_log(spark, d), NOW, PAST).select("rowid", "seqno", "key")


@query(f"WITH {_SQL_LOG}, {_SQL_LATEST} SELECT rowid, seqno, expires_at FROM latest WHERE {_SQL_LIVE}")
def ttl_visible(spark, d):
    return versions.visible(_log(spark, d), NOW).select("rowid", "seqno", "expires_at")


@query(
    f"WITH {_SQL_LOG}, l AS (SELECT rowid, max(seqno) AS last, max_by(tx_ms, seqno) AS tx, max_by(deleted, seqno) AS del, "
    f"max_by(coalesce(expires_at, {2**62}), seqno) AS ex FROM log GROUP BY rowid) SELECT log.rowid, log.seqno FROM log JOIN l USING (rowid) "
    f"WHERE NOT ((del OR ex <= {NOW}) AND tx < {NOW - 5 * DAY_MS}) AND (seqno = last OR tx_ms >= {NOW - 5 * DAY_MS})"
)
def compaction_survivors(spark, d):
    return versions.survivors(_log(spark, d), NOW, 5 * DAY_MS).select("rowid", "seqno")


_RETENTION = Retention(min_importance=0.2, half_life_ms=5 * DAY_MS, access_weight=0.05)


@query(
    f"WITH {_SQL_LOG}, {_SQL_LATEST}, a AS (SELECT user_id AS rowid, count(*) AS n, max((epoch_us(ts) // 1000)) AS last FROM events GROUP BY user_id), "
    f"s AS (SELECT rowid, importance::DOUBLE * pow(2, -greatest({NOW} - greatest(tx_ms, last), 0) / {5.0 * DAY_MS}) + 0.05 * ln(1 + n) AS s FROM latest JOIN a USING (rowid) WHERE {_SQL_LIVE}) "
    "SELECT rowid, round(s, 6) AS score, s < 0.2 AS forgotten FROM s"
)
def retain_scores(spark, d):
    rows = versions.with_access(versions.visible(_log(spark, d), NOW), _accesses(spark, d))
    score = scoring.retention(rows, _RETENTION, NOW)
    return rows.select("rowid", _r6(score).alias("score"), (score < _RETENTION.min_importance).alias("forgotten"))


@query(
    "WITH v AS (SELECT event_type, row_number() OVER (ORDER BY event_id) AS r FROM events) "
    "SELECT 'type-' || event_type AS key, min(r) AS owner, event_type <> 'error' AS owned FROM v GROUP BY event_type"
)
def key_owners(spark, d):
    """The row that owns each key, or last owned it."""
    space = _store(spark, 1).namespace("types")
    space.insert_df(_table(spark, d, "events").orderBy("event_id").select(F.concat(F.lit("type-"), F.col("event_type")).alias("key"), F.array(F.lit(1.0)).alias("vector")))
    space.delete("type-error")
    return space.owners()


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents")
def exact_text_dups(spark, d):
    """The first row of each text. Texts meet by a wide digest, so whole texts are never shuffled."""
    docs = saved(_table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("text").isNull().alias("none")), "digests")
    firsts = saved(docs.groupBy("h", "none").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "firsts")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_large_keys(docs, firsts.withColumn("repeated", F.col("n") > 1), ["h", "none"], "n", total, F.col("doc_id"))
    return found.select("doc_id", "first_id", "repeated")


@query(
    "WITH b AS (SELECT doc_id, text, CASE WHEN text = '' THEN []::HUGEINT[] ELSE list_transform(range(0, octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS HUGEINT)) END AS bytes FROM documents), "
    "h AS (SELECT doc_id, text, list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM b) "
    "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE CAST(h - CASE WHEN h >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) END AS text_hash FROM h"
)
def text_hashes(spark, d):
    """64-bit FNV-1a of every whole text."""
    return _table(spark, d, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


# ---- relations -------------------------------------------------------------

_BASE = {"region": 10**12, "nation": 2 * 10**12, "supplier": 3 * 10**12, "customer": 4 * 10**12, "order": 5 * 10**12, "part": 6 * 10**12}


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders to customers and parts, these and suppliers to nations, nations to regions."""

    def link(table: str, a: str, a_base: str, b: str, b_base: str, kind: int, weight: float) -> DataFrame:
        return _table(spark, d, table).select(
            (F.col(a) + _BASE[a_base]).alias("from_id"), (F.col(b) + _BASE[b_base]).alias("to_id"),
            F.lit(kind).cast("smallint").alias("kind"), F.lit(weight).cast("float").alias("weight"),
        )

    found = link("nation", "n_nationkey", "nation", "n_regionkey", "region", 0, 0.75)
    found = found.unionByName(link("supplier", "s_suppkey", "supplier", "s_nationkey", "nation", 1, 0.5))
    found = found.unionByName(link("customer", "c_custkey", "customer", "c_nationkey", "nation", 2, 0.875))
    found = found.unionByName(link("orders", "o_orderkey", "order", "o_custkey", "customer", 3, 0.625))
    items = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    items = items.select(
        (F.col("l_orderkey") + _BASE["order"]).alias("from_id"), (F.col("l_partkey") + _BASE["part"]).alias("to_id"),
        F.lit(16).cast("smallint").alias("kind"), (F.floor("q") / 64).cast("float").alias("weight"),
    )
    return found.unionByName(items).withColumn("metadata", F.lit(None).cast("string"))


_SQL_EDGES = (
    f"e AS (SELECT n_nationkey + {_BASE['nation']} AS f, n_regionkey + {_BASE['region']} AS t, 0 AS kind, 0.75::DOUBLE AS w FROM nation UNION ALL "
    f"SELECT s_suppkey + {_BASE['supplier']}, s_nationkey + {_BASE['nation']}, 1, 0.5 FROM supplier UNION ALL "
    f"SELECT c_custkey + {_BASE['customer']}, c_nationkey + {_BASE['nation']}, 2, 0.875 FROM customer UNION ALL "
    f"SELECT o_orderkey + {_BASE['order']}, o_custkey + {_BASE['customer']}, 3, 0.625 FROM orders UNION ALL "
    f"SELECT l_orderkey + {_BASE['order']}, l_partkey + {_BASE['part']}, 16, floor(max(l_quantity)) / 64 FROM lineitem GROUP BY l_orderkey, l_partkey)"
)
_SQL_SEEDS = f"seed AS (SELECT o_orderkey + {_BASE['order']} AS id, o_totalprice / 1000000 AS s FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)"


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("rowid")).unionByName(edges.select(F.col("to_id").alias("rowid"))).distinct()


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)
    return orders.select((F.col("o_orderkey") + _BASE["order"]).alias("rowid"), (F.col("o_totalprice") / 1_000_000).alias("score"))


@query(f"WITH {_SQL_EDGES} SELECT f AS from_id, t AS to_id, CAST(kind AS SMALLINT) AS kind, round(w, 6) AS weight FROM e WHERE kind IN (1, 2)")
def neighbors(spark, d):
    """Out-edges of two kinds of all rows."""
    edges = _edges(spark, d)
    alive = _nodes(edges)
    found = graph.neighbors(edges, alive, alive, (1, 2))
    return found.select("from_id", "to_id", "kind", _r6(F.col("weight").cast("double")).alias("weight"))


@query(f"WITH {_SQL_EDGES} SELECT t AS to_id, count(*) AS n_edges, round(sum(w), 6) AS weight FROM e WHERE t >= {_BASE['nation']} AND t < {_BASE['nation'] + 10**6} GROUP BY t")
def predecessors(spark, d):
    """In-edges of every nation, summed up."""
    edges = _edges(spark, d)
    alive = _nodes(edges)
    targets = alive.where(F.col("rowid").between(_BASE["nation"], _BASE["nation"] + 10**6 - 1))
    found = graph.predecessors(edges, targets, alive)
    return found.groupBy("to_id").agg(F.count(F.lit(1)).alias("n_edges"), _r6(F.sum(F.col("weight").cast("double"))).alias("weight"))


def _expand_sql(hops: int) -> str:
    parts, before = ["SELECT id, s FROM seed"], "seed"
    ctes = []
    for i in range(1, hops + 1):
        ctes.append(f"h{i} AS (SELECT t AS id, max(s * w * 0.5) AS s FROM {before} JOIN e ON f = {before}.id GROUP BY t)")
        parts.append(f"SELECT id, s FROM h{i}")
        before = f"h{i}"
    return f"WITH {_SQL_EDGES}, {_SQL_SEEDS}, {', '.join(ctes)} SELECT id AS rowid, round(max(s), 6) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


def _expanded(spark: SparkSession, d: str, hops: int) -> DataFrame:
    # Every hop reads the edges and the nodes; making edges groups all items.
    edges = saved(_edges(spark, d), "edges")
    found = graph.expand(_seeds(spark, d), edges, _nodes(edges), Expand(hops=hops, decay=0.5))
    return found.select("rowid", _r6("score").alias("score"))


@query(_expand_sql(1))
def expand_1hop(spark, d):
    return _expanded(spark, d, 1)


@query(_expand_sql(2))
def expand_2hop(spark, d):
    return _expanded(spark, d, 2)


@query(_expand_sql(3))
def expand_3hop(spark, d):
    return _expanded(spark, d, 3)


@query(
    "WITH RECURSIVE n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l, label FROM embeddings), "
    "p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.4), "
    "r AS (SELECT a, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.a = p.a WHERE r.c < p.b) "
    "SELECT a AS rowid, min(c) AS cluster FROM r GROUP BY a"
)
def consolidate_clusters(spark, d):
    """Components of similar vectors of one label, found by exact block products."""
    return similarity.clusters(_vectors(spark, d), 0.4, by=["label"])


# ---- reports and functions -------------------------------------------------


@query("SELECT lang AS ns, count(*) AS doc_count, CAST(sum(strlen(text)) AS BIGINT) AS total_doc_len FROM documents GROUP BY lang")
def ns_stats(spark, d):
    return stats.namespace_stats(_table(spark, d, "documents"), "lang")


@query(
    f"WITH {_SQL_LOG}, m AS (SELECT rowid, max(seqno) AS last FROM log GROUP BY rowid), x AS (SELECT key AS segment, seqno < last OR NOT ({_SQL_LIVE}) AS dead FROM log JOIN m USING (rowid)) "
    "SELECT segment, count(*) AS n_rows, count(*) FILTER (WHERE dead) AS dead_rows, round(count(*) FILTER (WHERE dead) / count(*), 6) AS dead_ratio FROM x GROUP BY segment"
)
def dead_ratio(spark, d):
    found = stats.dead_ratio(_log(spark, d), NOW, F.col("key"))
    return found.select("segment", "n_rows", "dead_rows", _r6("dead_ratio").alias("dead_ratio"))


@query(f"WITH {_SQL_LOG}, {_SQL_LATEST} SELECT max(seqno) AS version, count(*) AS n_rows, count(*) FILTER (WHERE {_SQL_LIVE}) AS live_rows, (SELECT count(*) FROM log) AS versions FROM latest")
def snapshot_stats(spark, d):
    return stats.snapshot_stats(_log(spark, d), NOW)


@query(
    f"WITH {_SQL_LOG}, {_SQL_LATEST}, {_SQL_EDGES}, n AS (SELECT count(*) AS n FROM log), s AS (SELECT max(seqno) AS version, count(*) AS n_rows, count(*) FILTER (WHERE {_SQL_LIVE}) AS live_rows FROM latest) "
    "SELECT version, n_rows, live_rows, n - n_rows AS retained_versions, (SELECT count(*) FROM e) AS relations, live_rows * 256 AS memory_estimate FROM s, n"
)
def global_stats(spark, d):
    return stats.global_stats(_log(spark, d), _edges(spark, d), NOW, 64)


@query("SELECT CAST(least(floor(ln(greatest(value, 1.0)) / ln(1000.0) * 32), 31) AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY 1")
def latency_histogram(spark, d):
    return stats.latency_histogram(_table(spark, d, "events"), "value")


@query(f"WITH {_SQL_LOG}, {_SQL_LATEST} SELECT 'live key owned twice' AS problem, count(*) AS n FROM (SELECT key FROM latest WHERE {_SQL_LIVE} GROUP BY key HAVING count(*) > 1) HAVING count(*) > 0")
def integrity_check(spark, d):
    """Events share keys by design, so just that rule is broken."""
    spaces = spark.createDataFrame([("events",)], "path string")
    return stats.problems(_log(spark, d), _edges(spark, d), spaces, NOW)


@query(
    f"SELECT event_id, {_K} AS k, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, round(pow(2, -greatest({NOW} - (epoch_us(ts) // 1000), 0) / {7.0 * DAY_MS}), 6) AS decay, "
    "round(least(ln(1 + floor(value)) / ln(101), 1), 6) AS share, 1 AS depth FROM events"
)
def scalar_functions(spark, d):
    events = _table(spark, d, "events")
    at = _ms(events, "ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    # The format needs UTC; a session in another zone is shifted by its own offset.
    utc = iso_from_ms(at) if zone in ("UTC", "Etc/UTC") else F.date_format(F.to_utc_timestamp(F.timestamp_millis(at), zone), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select(
        "event_id", json_get(F.col("props"), "k", "bigint").alias("k"), utc.alias("iso"), _r6(decay(F.lit(NOW) - at, 7 * DAY_MS)).alias("decay"),
        _r6(log_share(F.floor("value"), 100)).alias("share"), json_depth(F.col("props")).alias("depth"),
    )


# ---- the store -------------------------------------------------------------


def _store(spark: SparkSession, dimension: int, **settings) -> MemoryStore:
    settings = {"clock": ManualClock(NOW)} | settings
    return MemoryStore.open(spark, shared_path(spark, "store"), StoreConfig(dimension=dimension, **settings))


@query(f"WITH {_SQL_RECORDS} SELECT 'doc-' || id AS key, CAST(strlen(text) AS BIGINT) AS text_bytes, CAST(label AS INTEGER) AS label FROM j WHERE label <> 3")
def store_insert_forget(spark, d):
    """Records go into a store, some are forgotten by a filter, the rest is read back."""
    store = _store(spark, 64)
    space = store.namespace("docs")
    rows = _hybrid_rows(spark, d).select(
        F.concat(F.lit("doc-"), F.col("rowid")).alias("key"), "text", "vector", F.to_json(F.struct("label", "lang")).alias("metadata")
    )
    space.insert_df(rows)
    space.forget("label == 3")
    live = space.iter()
    return live.select("key", F.octet_length("text").cast("bigint").alias("text_bytes"), json_get(F.col("metadata"), "label", "int").alias("label"))


@query(
    "WITH v AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) "
    "SELECT 'user-' || user_id AS key, CAST(event_id AS BIGINT) AS event_id, n AS n_versions FROM v WHERE r = 1"
)
def store_upsert(spark, d):
    """One batch with many rows of each key: the last one holds, the others are its history."""
    store = _store(spark, 1)
    space = store.namespace("users")
    events = _table(spark, d, "events").orderBy("event_id").select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("key"), F.array(F.lit(1.0)).alias("vector"), F.to_json(F.struct("event_id")).alias("metadata")
    )
    space.insert_df(events)
    history = store.view().versions().groupBy("rowid").agg(F.count(F.lit(1)).alias("n_versions"))
    return space.iter().join(history, "rowid").select("key", json_get(F.col("metadata"), "event_id", "bigint").alias("event_id"), "n_versions")


@query(_SQL_HYBRID + "r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, id)) AS p FROM v UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM w) "
    "SELECT 'doc-' || id AS key, round(sum(p), 6) AS score FROM r GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10")
def store_search(spark, d):
    """The search builder over a store: filter, both channels, fusion."""
    space = _store(spark, 64).namespace("docs")
    rows = _hybrid_rows(spark, d).orderBy("rowid").select(
        F.concat(F.lit("doc-"), F.col("rowid")).alias("key"), "text", "vector", F.to_json(F.struct("label")).alias("metadata")
    )
    space.insert_df(rows)
    hits = space.search().vector(_first_vector(spark, d)).text(WORDS).where("label < 8").rrf().top_k(10).execute()
    return hits.select("key", _r6("score").alias("score"))


@query(
    "WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) "
    "SELECT CAST(ord AS BIGINT) AS ord, CASE WHEN n > 1 AND text IS NOT NULL THEN 'duplicate' ELSE 'inserted' END AS status, CASE WHEN n > 1 AND text IS NOT NULL THEN 1.0::DOUBLE END AS score FROM e"
)
def store_dedup(spark, d):
    """A deduplicating write of all documents: a text that is there already is refused. Vectors are far apart."""
    store = _store(spark, 64, dedup=Dedup.REJECT)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.xxhash64("doc_id"), i) * 2.0 - 1.0)
    docs = _table(spark, d, "documents").orderBy("doc_id").select(F.col("doc_id").cast("string").alias("key"), "text", bits.alias("vector"))
    return store.namespace("docs").insert_df(docs).select("ord", "status", "score")


@query(
    "WITH g AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE label IS NOT NULL) "
    "SELECT CAST(label AS VARCHAR) AS text, string_agg(CAST(vec_id AS VARCHAR), '+' ORDER BY r) AS joined, CAST(count(*) AS BIGINT) AS versions FROM g GROUP BY label"
)
def store_merge(spark, d):
    """A merging write: records of equal text become one, each merge a version of its own."""
    def merged(old: dict, new: dict) -> dict:
        return {**new, "key": None, "metadata": json.dumps({"ids": json.loads(old["metadata"])["ids"] + "+" + json.loads(new["metadata"])["ids"]})}

    store = _store(spark, 64, dedup=Dedup.MERGE, merge=merged)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.xxhash64("vec_id"), i) * 2.0 - 1.0)
    rows = _table(spark, d, "embeddings").where("label IS NOT NULL").orderBy("vec_id").select(
        F.col("label").cast("string").alias("text"), bits.alias("vector"), F.to_json(F.struct(F.col("vec_id").cast("string").alias("ids"))).alias("metadata")
    )
    space = store.namespace("labels")
    space.insert_df(rows)
    history = store.view().versions().groupBy("rowid").agg(F.count(F.lit(1)).alias("versions"))
    return space.iter().join(history, "rowid").select("text", json_get(F.col("metadata"), "ids", "string").alias("joined"), "versions")


def _nation_store(spark: SparkSession, d: str, **settings):
    """The nations as records, whose rowid is their place by number, from 1; vectors go round a circle."""
    store = _store(spark, 2, **settings)
    angle = F.col("n_nationkey") / 10
    rows = _table(spark, d, "nation").orderBy("n_nationkey").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.array(F.cos(angle), F.sin(angle)).alias("vector"), F.col("n_name").alias("text"),
        F.to_json(F.struct(F.col("n_regionkey").alias("region"))).alias("metadata"), F.lit(0.5).alias("importance"),
    )
    store.namespace("world/nations").insert_df(rows)
    return store


_SQL_NATIONS = "n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS rowid, n_name, n_regionkey AS region, cos(n_nationkey / 10) AS x, sin(n_nationkey / 10) AS y FROM nation)"


@query(
    f"WITH {_SQL_NATIONS} SELECT 'n' || k AS key, CASE k WHEN 3 THEN 'renamed' WHEN 6 THEN 'believed' ELSE n_name END AS text, "
    "CAST(CASE k WHEN 3 THEN 0.75 WHEN 7 THEN 0.625 WHEN 8 THEN 0.52 ELSE 0.5 END AS DOUBLE) AS importance, CAST(CASE k WHEN 9 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence, "
    "CAST(CASE k WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0 END AS BIGINT) AS access_count FROM n WHERE k NOT IN (5)"
)
def store_mutations(spark, d):
    """One of each change of a record: update, delete, supersede, touch with a boost, feedback used and corrected."""
    store = _nation_store(spark, d)
    space = store.namespace("world/nations")
    space.update("n3", {"text": "renamed", "importance": 0.75})
    space.delete("n5")
    space.supersede("n6", {"vector": [1.0, 0.0], "text": "believed", "importance": 0.5, "metadata": "{}"})
    space.touch("n7", boost=0.125)
    space.feedback(space.get("n8").rowid, 1, used=True)
    space.feedback(space.get("n9").rowid, 1, corrected_by=space.get("n8").rowid)
    rows = store.view().rows("world/nations", with_access=True)
    return rows.select(
        "key", "text", F.round(F.col("importance").cast("double"), 4).alias("importance"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"),
        F.coalesce("access_count", F.lit(0)).cast("bigint").alias("access_count"),
    )


@query(
    f"WITH {_SQL_NATIONS} SELECT a.rowid AS from_id, b.rowid AS to_id, CAST(16 AS SMALLINT) AS kind, CAST(CASE WHEN a.k = 1 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS weight "
    "FROM n a JOIN n b ON a.region = b.region AND a.k < b.k WHERE NOT (a.k = 0 AND b.k = 5) "
)
def store_relations(spark, d):
    """A relation kind of one's own, many edges at once, one set anew with a weight beyond its range, one removed."""
    store = _nation_store(spark, d)
    space, kind = store.namespace("world/nations"), store.relation_kind("borders")
    rows = space.rows().select("rowid", json_get(F.col("metadata"), "region", "bigint").alias("region"))
    pairs = rows.select(F.col("rowid").alias("from_id"), "region").join(rows.select(F.col("rowid").alias("to_id"), "region"), "region").where("from_id < to_id")
    edges = pairs.select("from_id", "to_id", F.lit(kind).cast("smallint").alias("kind"), F.lit(0.25).alias("weight"), F.lit(None).cast("string").alias("metadata"))
    space.relate_df(edges)
    for row in edges.where("from_id = 2").orderBy("to_id").collect():
        space.relate(row.from_id, row.to_id, kind, 7.5)
    space.unrelate(1, 6, kind)
    return store.view().edges().select("from_id", "to_id", "kind", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query("SELECT 'world/regions' AS path, CAST(count(*) AS BIGINT) AS n FROM region")
def store_drop_namespace(spark, d):
    """A namespace and what lies below it are dropped; the others stay."""
    store = _nation_store(spark, d)
    regions = _table(spark, d, "region").select(F.col("r_name").alias("key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    store.namespace("world/regions").insert_df(regions)
    store.namespace("world/nations/small").insert_df(regions.limit(2))
    store.drop_namespace("world/nations")
    left = store.view().rows().groupBy("ns").agg(F.count(F.lit(1)).alias("n"))
    return store.view().namespaces().join(left, F.col("path") == F.col("ns")).select("path", "n")


@query(f"WITH {_SQL_NATIONS} SELECT 'n' || k AS key, round(x, 4) AS x, CASE WHEN k < 20 THEN 'there' ELSE 'not there' END AS found FROM n")
def store_point_reads(spark, d):
    """Point reads by key and rowid, of a copy of the store that was made before some records went."""
    store = _nation_store(spark, d)
    target = shared_path(spark, "backup")
    store.backup_to(target)
    for key in ("n20", "n21", "n22", "n23", "n24"):
        store.namespace("world/nations").delete(key)
    copy = MemoryStore.open(spark, target, store.config)
    view, here = copy.view(), store.namespace("world/nations")
    wanted = [r.key for r in copy.namespace("world/nations").iter().collect()]
    by_id = view.get_many_by_rowid([copy.namespace("world/nations").get(k).rowid for k in wanted[:2]]) + copy.namespace("world/nations").get_many(wanted[2:])
    there = {r.key for r in here.get_many(wanted) if r is not None}
    assert view.get_vector(by_id[0].rowid) == list(by_id[0].vector) and here.exists(wanted[0])
    data = [(r.key, float(r.vector[0]), "there" if r.key in there else "not there") for r in by_id]
    return spark.createDataFrame(data, "key string, x double, found string").select("key", F.round("x", 4).alias("x"), "found")


@query(
    f"WITH {_SQL_NATIONS}, s AS (SELECT rowid, k, x AS c FROM n WHERE region <> 2 ORDER BY x DESC, rowid LIMIT 5), m AS (SELECT min(c) AS lo, max(c) AS hi FROM s) "
    "SELECT 'n' || k AS key, CAST(17 AS BIGINT) AS query_id, round(0.5 * (c - lo) / (hi - lo), 4) AS sim, 0.25::DOUBLE AS importance, round(0.5 * (c - lo) / (hi - lo) + 0.25, 4) AS score FROM s, m WHERE k <> 0"
)
def store_explain(spark, d):
    """A numbered search with its score taken apart, and a rerank hook that drops a hit."""
    space = _nation_store(spark, d).namespace("world/nations")
    found = space.search().vector([1.0, 0.0]).where("region != 2").top_k(5).score(w_sim=0.5, w_importance=0.5).query_id(17).rerank(lambda hits: hits.where("key <> 'n0'"))
    four = lambda c: F.round(c, 4)
    return found.execute().select("key", "query_id", four(F.col("breakdown.sim")).alias("sim"), four(F.col("breakdown.importance")).alias("importance"), four(F.col("score")).alias("score"))


@query(f"WITH {_SQL_NATIONS} SELECT 'n' || k AS key, round(x, 5) AS score FROM n WHERE k > 0 ORDER BY x DESC, rowid LIMIT 4")
def store_search_as_of(spark, d):
    """A search of the state before some records changed and others went."""
    times = iter([NOW, NOW + 1000])
    clock = ManualClock(next(times))
    store = _nation_store(spark, d, clock=clock)
    space = store.namespace("world/nations")
    space.delete("n0")
    before = clock.now
    clock.now = next(times)
    space.update("n1", {"vector": [0.0, 1.0]})
    space.delete("n2")
    hits = space.search().vector([1.0, 0.0]).as_of(before).top_k(4).execute()
    return hits.select("key", F.round("score", 5).alias("score"))


@query(f"WITH {_SQL_NATIONS} SELECT rowid, CAST(sum(c) AS BIGINT) AS access_count FROM (SELECT rowid, 2 AS c FROM (SELECT rowid FROM n ORDER BY x DESC, rowid LIMIT 3) UNION ALL SELECT rowid, 1 FROM (SELECT rowid FROM n ORDER BY y DESC, rowid LIMIT 3)) GROUP BY rowid")
def store_count_hits(spark, d):
    """Searches count their hits, which a flush makes durable."""
    store = _nation_store(spark, d, count_hits=True)
    space = store.namespace("world/nations")
    for vector in ([1.0, 0.0], [1.0, 0.0], [0.0, 1.0]):
        space.search().vector(vector).top_k(3).execute()
    store.flush()
    rows = store.view().rows("world/nations", with_access=True).where("access_count > 0")
    return rows.select("rowid", F.col("access_count").cast("bigint").alias("access_count"))


@query(
    f"WITH {_SQL_Q}, a AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 7 <> 1 UNION ALL SELECT -1, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), "
    f"s AS (SELECT vec_id, {_SQL_SCORES['cosine']} AS s FROM a, q) SELECT 'v' || vec_id AS key, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id = -1, vec_id LIMIT 10"
)
def store_index_search(spark, d):
    """A stored index, then rows that went and one that came: with all cells probed the result is the exact one."""
    store = _store(spark, 64, index=IndexOptions(cells=12, brute_force_max_rows=0, recall_floor=1.0))
    space = store.namespace("vectors")
    rows = _vectors(spark, d).orderBy("rowid").select(F.concat(F.lit("v"), F.col("rowid")).alias("key"), "vector", F.to_json(F.struct(F.pmod("rowid", F.lit(7)).alias("seventh"))).alias("metadata"))
    space.insert_df(rows)
    index = store.build_index("vectors")
    space.forget("seventh == 1")
    space.insert({"key": "v-1", "vector": _first_vector(spark, d)})
    hits = space.search().vector(_first_vector(spark, d)).using(index, len(index.centres)).top_k(10).execute()
    return hits.select("key", _r6("score").alias("score"))


@query(
    "WITH RECURSIVE n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rowid, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), "
    "p AS (SELECT a.rowid AS a, b.rowid AS b FROM n a JOIN n b ON a.rowid <> b.rowid WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= 0.4), "
    "r AS (SELECT a, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.a = p.a WHERE r.c < p.b), c AS (SELECT a AS rowid, min(c) AS cluster FROM r GROUP BY a), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rowid) AS place FROM c) "
    "SELECT min(rowid) AS first_source, CAST(count(*) AS BIGINT) AS sources FROM k WHERE place <= 8 GROUP BY cluster"
)
def store_consolidate(spark, d):
    """Summaries of clusters of similar records, and the relations to their sources."""
    store = _store(spark, 64)
    space = store.namespace("vectors")
    space.insert_df(_vectors(spark, d).orderBy("rowid").select(F.col("rowid").cast("string").alias("key"), "vector"))
    space.consolidate(Consolidation(threshold=0.4, max_cluster=8, target="summaries"))
    edges = store.view().edges()
    return edges.groupBy("from_id").agg(F.min("to_id").alias("first_source"), F.count(F.lit(1)).alias("sources")).drop("from_id")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def stream_ingest(spark, d):
    """A file stream, ingested to its present end and read back."""
    from palimpsest.streaming.ingest import ingest

    space = _store(spark, 64).namespace("stream")
    # A file stream reads folders; the table may be a single file.
    table, folder = _table(spark, d, "embeddings"), shared_path(spark, "arrivals")
    table.write.parquet(folder)
    source = spark.readStream.schema(table.schema).parquet(folder)
    records = source.select(F.col("embedding").alias("vector"), F.col("vec_id").cast("string").alias("key"), F.to_json(F.struct("label")).alias("metadata"))
    running = ingest(records, space, f"ingest-{id(space)}", shared_path(spark, "stream"), available_now=True)
    running.awaitTermination()
    return space.iter().groupBy(json_get(F.col("metadata"), "label", "int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval: filter, exact vector and keyword channels, rank fusion."""
    return hybrid_rrf(spark, d)
