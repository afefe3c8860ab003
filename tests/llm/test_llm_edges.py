"""Every operator and stage on empty tables, nulls, repeated rows, long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import embedding_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece_dropout, sharding, simhash, token_output, url_filter
from palimpsest.llm.tokens import vocabulary_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ROWS = [
    (None, None, None, None, None), (None, "null id text here", None, "hot", None), (1, "", "en", "hot", 0), (2, "same text again", "en", "hot", 15), (2, "same text again", "en", "hot", 15),
    (3, "same text again", None, None, 15), (4, "word " * 30_000, "en", "hot", 150_000), (5, "x" * 200_000, "en", "hot", 200_000), (6, "a@b.cc " * 20, "en", "hot", 140), (7, "\n\n\t ", "en", "hot", 4),
]
#: Names that the operators use themselves.
CLASHES = ("_m", "spans", "_pii_spans", "_path", "_bytes", "shard", "shard_depth", "_score", "_kept", "_n_rows", "_least", "fp", "node", "key", "id", "y", "t", "block_own", "start", "component_id", "host", "score", "ids", "_prefix", "_leaf")

OPERATORS = {
    "pii": lambda d: pii.report(d), "redact": lambda d: pii.redact(d), "rules": lambda d: quality_rules.report(d), "good rules": lambda d: quality_rules.keep_good(d),
    "classifier": lambda d: quality_classifier.report(d, _labels(d)), "good class": lambda d: quality_classifier.keep_good(d, _labels(d)),
    "tokens": lambda d: token_output.encode_and_read(d, vocabulary_path()), "pieces": lambda d: sentencepiece_dropout.report(d),
    "packing": lambda d: packing.pack(d, vocabulary_path()), "sharding": lambda d: sharding.report(d), "assign": lambda d: sharding.assign(d, limit=10_000),
    "simhash": lambda d: simhash.report(d), "dedup": lambda d: simhash.drop_near_duplicates(d),
}
#: Rows that come out for ROWS: one each, or as stated.
COUNTS = {"good rules": None, "good class": None, "packing": None, "dedup": None}


def _labels(frame):
    return frame.sparkSession.createDataFrame([(2, 1, 0), (3, 0, 0), (4, 1, 0), (6, 0, 1), (None, 1, 0), (5, None, None), (1, 7, 0)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    plain = spark.createDataFrame(ROWS, DOCS)
    wide = plain.select("*", *(F.lit("clash").alias(c) for c in CLASHES))
    operator = OPERATORS[name]
    assert operator(plain.limit(0)).collect() == []
    rows = operator(plain).collect()
    more = operator(wide.repartition(3)).collect()
    assert len(rows) == len(more)
    if name not in COUNTS:
        assert len(rows) == len(ROWS)
    if name == "dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 4, 5, 6]
        assert [r.text for r in rows if r.doc_id is None] == ["null id text here"]
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.length for r in more)
    if name in ("redact", "good rules", "good class", "dedup"):
        assert operator(wide).dtypes == wide.dtypes


def test_pages(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "x://a.net/b", "h"), (2, "", ""), (2, "", ""), (3, "x://" + "a" * 50_000, "")], "page_id bigint, url string, html string")
    wide = rows.select("*", F.lit(1).alias("host"), F.lit(1).alias("path"), F.lit(1).alias("rule"), F.lit(1).alias("score"))
    assert url_filter.judge(rows.limit(0)).count() == 0
    assert sorted(map(str, url_filter.judge(rows).collect())) == sorted(map(str, url_filter.judge(wide).collect()))


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, None, None), (4, [-0.0, 0.0], 1), (5, [1e-30, 1e-31], 2), (6, [1e30, 1e29], 2)], "vec_id bigint, embedding array<float>, label int")
    wide = rows.select("*", *(F.lit(1).alias(c) for c in ("node", "keys", "low", "members", "dim", "a", "b", "n")))
    assert embedding_dedup.report(rows.limit(0)).count() == 0
    for frame in (rows, wide):
        got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.report(frame).collect()]
        assert sorted(got, key=str) == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5)], key=str)


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{i}")
            kept = spark.read.parquet(f"{tmp_path}/{i}")
            assert 0 < kept.count() <= docs.count()
            docs = kept
    last = {r.doc_id for r in out.collect()}
    assert last == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == last


@pytest.mark.parametrize("number", range(5))
def test_stage_on_odd_rows(spark, sf, number):
    _, stage = corpus_pipeline.STAGES[number]
    frame = spark.createDataFrame(ROWS, DOCS)
    assert stage(spark, frame.limit(0), sf).count() == 0
    stage(spark, frame, sf).collect()
