import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Expand, IndexOptions, Metric, Retention, Scoring
from palimpsest.errors import ConfigError
from palimpsest.functions import quant, text
from palimpsest.functions.crypto import KeyRing
from palimpsest.operators import ann, bm25, fusion, graph, knn, scoring, similarity, versions
from palimpsest.operators.components import connected_components
from palimpsest.operators.spread import join_large_keys, with_least
from palimpsest.sources.scratch import hadoop_path, remove_saved, saved, shared_dir

VECTORS = "rowid bigint, vector array<float>"


def _ids(frame):
    return [r.rowid for r in frame.collect()]


@pytest.mark.parametrize("metric", list(Metric))
def test_knn_matches_numpy(spark, metric):
    dice = np.random.default_rng(3)
    data = dice.standard_normal((200, 7)).astype(np.float32)
    data[5] = data[9]
    data[17] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], VECTORS).repartition(5)
    wide = data.astype(np.float64)
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in (0, 5, 17)], "query_id bigint, qvec array<float>")
    for block_bytes in (1 << 20, 60):
        batch = knn.batch_top_k(rows, queries, 6, metric, block_bytes=block_bytes).collect()
        for i in (0, 5, 17):
            dots = wide @ wide[i]
            norms = np.sqrt((wide**2).sum(1) * (wide[i] ** 2).sum())
            scores = {Metric.DOT: dots, Metric.L2: ((wide - wide[i]) ** 2).sum(1), Metric.COSINE: np.where(norms < 1e-12, 0, dots / np.where(norms < 1e-12, 1, norms))}[metric]
            sign = -1 if metric.higher_is_better else 1
            order = sorted(range(200), key=lambda j: (round(sign * scores[j], 9), j))[:6]
            assert _ids(knn.top_k(rows, data[i].tolist(), 6, metric)) == order
            mine = [(r.rowid, r["rank"]) for r in sorted((r for r in batch if r.query_id == i), key=lambda r: r["rank"])]
            assert mine == [(j, k + 1) for k, j in enumerate(order)]


def test_knn_order_of_ties_and_nan(spark):
    rows = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [float("nan")]), (4, [-0.0]), (5, [0.0]), (6, None)], VECTORS)
    assert _ids(knn.top_k(rows, [1.0], 9, Metric.DOT)) == [1, 3, 4, 5, 2]
    assert _ids(knn.top_k(rows, [1.0], 9, Metric.L2)) == [1, 3, 4, 5, 2]
    assert knn.top_k(rows.limit(0), [1.0], 3).count() == 0


def test_filter_stands_before_the_limit(spark):
    rows = spark.createDataFrame([(i, [float(10 - i)]) for i in range(10)], VECTORS)
    assert _ids(knn.top_k(rows, [1.0], 3, Metric.DOT, F.col("rowid") >= 5)) == [5, 6, 7]


def test_top_k_plan_moves_only_k_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vector"))
    plan = knn.top_k(rows, [0.0] * 64, 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[1]


def test_tokenizer():
    assert text.tokenize_text("Memory 记忆库 foo,bar, abc,记忆") == ["memory", "记忆", "忆库", "foo,bar", "abc,", "记忆"]
    assert text.tokenize_text("The end. — 的") == ["end"]
    assert text.tokenize_text("The 库", stopwords=False) == ["the", "库"]


def test_tokenizer_column_equals_python(spark):
    dice = random.Random(1)
    alphabet = "aZ,. é記库的\t  '-_9٣ß́"
    texts = ["".join(dice.choices(alphabet, k=dice.randint(0, 25))) for _ in range(400)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for stop in (True, False):
        for row in frame.select("t", text.tokenize(F.col("t"), stop).alias("k")).collect():
            assert row.k == text.tokenize_text(row.t, stop), row.t


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "alpha alpha"), (1, "alpha " * 4), (2, "..."), (3, None)], "rowid bigint, text string")
    got = {r.rowid: r.score for r in bm25.search(docs, "Alpha alpha!", 5).collect()}
    idf = math.log(1.2)
    for doc, tf in ((0, 2), (1, 4)):
        assert got[doc] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf / 3)))
    assert bm25.search(docs, "the", 5).count() == 0


def test_bm25_index_equals_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "rowid")
    queries = spark.createDataFrame([(1, "des und lytion"), (2, "que the"), (3, "zzz")], "query_id bigint, qtext string")
    batch = bm25.batch_search(bm25.postings(docs), queries, 5).collect()
    for number, words in ((1, "des und lytion"), (2, "que the"), (3, "zzz")):
        one = [(r.rowid, round(r.score, 9)) for r in bm25.search(docs, words, 5).collect()]
        assert [(r.rowid, round(r.score, 9)) for r in sorted((r for r in batch if r.query_id == number), key=lambda r: r["rank"])] == one


def test_bm25_filter_leaves_statistics_alone(spark):
    docs = spark.createDataFrame([(i, "alpha" if i % 2 else "alpha beta") for i in range(6)], "rowid bigint, text string")
    everything = {r.rowid: r.score for r in bm25.search(docs, "alpha", 9).collect()}
    some = {r.rowid: r.score for r in bm25.search(docs, "alpha", 9, where=F.col("rowid") > 2).collect()}
    assert some == {i: everything[i] for i in (3, 4, 5)}


def _channel(spark, pairs):
    return spark.createDataFrame(pairs, "rowid bigint, score double")


def test_rrf(spark):
    near = _channel(spark, [(2, 0.85), (1, 0.88), (0, 0.91)])
    words = _channel(spark, [(0, 3.1), (1, 2.8)])
    got = fusion.reciprocal_rank([(near, True), (words, True)], 3).collect()
    assert [r.rowid for r in got] == [0, 1, 2]
    assert got[0].score == pytest.approx(2 / 61) and got[2].score == pytest.approx(1 / 63)


def test_weighted_fusion(spark):
    near = _channel(spark, [(0, 0.0), (1, 4.0)])
    got = {r.rowid: r.score for r in fusion.weighted(near, _channel(spark, [(2, 7.0)]), 0.25, 9, vector_is_distance=True).collect()}
    assert got == {0: 0.25, 1: 0.0, 2: 0.75}
    odd = {r.rowid: r.score for r in fusion.weighted(_channel(spark, [(0, float("nan")), (1, 1.0)]), _channel(spark, [(2, 1.0)]), 0.5, 9).collect()}
    assert odd == {0: 0.0, 1: 0.5, 2: 0.5}


EDGES = "from_id bigint, to_id bigint, kind smallint, weight float"


def test_expand_keeps_the_best(spark):
    seeds = _channel(spark, [(1, 1.0), (2, 0.9)])
    edges = spark.createDataFrame([(1, 2, 3, 0.3), (1, 4, 3, 0.8), (4, 5, 3, 1.0), (2, 5, 0, 1.0), (5, 6, 3, 1.0), (4, 9, 3, 1.0)], EDGES)
    targets = spark.createDataFrame([(i,) for i in (1, 2, 4, 5, 6)], "rowid bigint")
    got = {r.rowid: r for r in graph.expand(seeds, edges, targets, Expand(hops=2)).collect()}
    assert {i: round(r.score, 6) for i, r in got.items()} == {1: 1.0, 2: 0.9, 4: 0.4, 5: 0.45, 6: 0.225}
    assert got[2].via is None and got[4].via.from_id == 1 and got[5].via.from_id == 2
    only = graph.expand(seeds, edges, targets, Expand(hops=3, kinds=(0,))).collect()
    assert {r.rowid for r in only} == {1, 2, 5}
    assert len(graph.expand(seeds, edges, targets, Expand(hops=3, max_nodes=3)).collect()) == 3


def test_edges_log(spark):
    log = spark.createDataFrame(
        [(1, 2, 3, 0.5, None, 1, False), (1, 2, 3, 0.9, None, 2, False), (1, 3, 3, 0.5, None, 3, False), (1, 3, 3, 0.0, None, 4, True)],
        EDGES + ", metadata string, seqno bigint, removed boolean",
    )
    now = graph.current_edges(log)
    assert [(r.to_id, round(r.weight, 3)) for r in now.collect()] == [(2, 0.9)]
    alive = spark.createDataFrame([(1,), (2,)], "rowid bigint")
    assert graph.neighbors(now, [1], alive).count() == 1 and graph.predecessors(now, [2], alive, (0,)).count() == 0


def test_composite_factors(spark):
    rows = spark.createDataFrame(
        [(1, 0.9, 0, 0, 0.5, 1.0, 0, None), (2, 0.5, 0, 0, 0.5, 1.0, 101, 1000), (3, 0.1, 0, 0, 1.0, 0.0, 250, 1000)],
        "rowid bigint, score double, created_at bigint, valid_from bigint, importance float, confidence float, access_count bigint, last_access bigint",
    )
    got = {r.rowid: r.breakdown for r in scoring.composite(rows, Scoring(w_sim=2, w_recency=1, w_importance=1, w_access=1, w_confidence=1, half_life_ms=1000), 1000).collect()}
    assert [got[i].access for i in (1, 2, 3)] == [0.0, 1.0, 1.0]
    assert [got[i].recency for i in (1, 2, 3)] == [0.5, 1.0, 1.0]
    assert [round(got[i].sim, 9) for i in (1, 2, 3)] == [2.0, 1.0, 0.0]
    floor = {r.rowid: r.score for r in scoring.composite(rows, Scoring(floor=0.5), 0).collect()}
    assert floor[3] == 0.0 and floor[1] == 1.0
    with pytest.raises(ConfigError):
        Scoring(w_sim=float("nan"))


def test_greedy_steps(spark):
    rows = spark.createDataFrame([(1, 1.0, [1.0, 0.0]), (2, 0.9, [1.0, 0.01]), (3, 0.2, [0.0, 1.0])], "rowid bigint, score double, vector array<float>")
    assert _ids(scoring.drop_near(rows, 0.99).orderBy("rank")) == [1, 3]
    assert _ids(scoring.mmr(rows, 0.5, 2).orderBy("rank")) == [1, 3]
    assert _ids(scoring.mmr(rows, 5.0, 3).orderBy("rank")) == [1, 2, 3]


LOG = "rowid bigint, seqno bigint, tx_ms bigint, deleted boolean, expires_at bigint"


def test_visibility(spark):
    log = spark.createDataFrame([(1, 1, 10, False, None), (1, 2, 20, True, None), (2, 3, 10, False, 15), (3, 4, 30, False, None)], LOG)
    assert sorted(_ids(versions.visible(log, 40))) == [3]
    assert sorted(_ids(versions.visible(log, 40, 12))) == [1, 2]
    assert sorted(_ids(versions.visible(log, 40, 15))) == [1]


def test_survivors(spark):
    log = spark.createDataFrame([(1, 1, 10, False, None), (1, 2, 90, False, None), (2, 3, 10, False, None), (2, 4, 20, True, None), (3, 5, 10, True, None), (4, 6, 10, False, 95)], LOG)
    kept = versions.survivors(log, 100, 50).select("seqno").collect()
    assert sorted(r.seqno for r in kept) == [2]
    assert versions.survivors(log, 100, None).count() == 6


def test_retention_score(spark):
    rows = spark.createDataFrame([(1, 1.0, 0, None, None), (2, 1.0, 0, 3, 1000)], "rowid bigint, importance float, valid_from bigint, access_count bigint, last_access bigint")
    got = {r.rowid: r.s for r in rows.select("rowid", scoring.retention(rows, Retention(half_life_ms=1000), 1000).alias("s")).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(1 + 0.05 * math.log(4))
    none = rows.select(scoring.retention(rows, Retention(half_life_ms=0), 1000).alias("s")).collect()
    assert none[0].s == 0.0


def _reachable(pairs):
    label = {n: n for p in pairs for n in p}
    while True:
        new = dict(label)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    dice = random.Random(seed)
    pairs = [(dice.randrange(60), dice.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    got = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == _reachable([p for p in pairs if p[0] != p[1]])
    assert len(got) == len({r.node for r in got})


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_clusters_match_brute_force(spark, block_rows):
    dice = np.random.default_rng(5)
    data = dice.standard_normal((60, 3))
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(data)] + [(99, 0, None)], "rowid bigint, label int, vector array<float>")
    unit = data.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(60) for j in range(i) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.97]
    got = similarity.clusters(rows, 0.97, ["label"], block_rows=block_rows).collect()
    assert {r.rowid: r.cluster for r in got} == _reachable(pairs)


def test_byte_codes(spark):
    rows = spark.createDataFrame([(1, [0.0, 5.0, -1.0]), (2, [1.0, 5.0, 1.0]), (3, [0.5, 5.0, 0.25])], VECTORS)
    codes = quant.fit(rows)
    got = {r.rowid: r for r in rows.select("rowid", codes.encode(F.col("vector")).alias("c"), codes.decode(codes.encode(F.col("vector"))).alias("d"),
                                           codes.dot(codes.encode(F.col("vector")), [1.0, 2.0, 3.0]).alias("p")).collect()}
    assert got[1].c == [0, 0, 0] and got[2].c == [255, 0, 255] and got[3].c == [128, 0, 159]
    assert got[3].p == pytest.approx(sum(a * b for a, b in zip(got[3].d, [1.0, 2.0, 3.0])))
    half = rows.select(quant.from_half(quant.to_half("vector")).alias("v")).collect()
    assert [r.v for r in half] == [[0.0, 5.0, -1.0], [1.0, 5.0, 1.0], [0.5, 5.0, 0.25]]


def test_index_with_all_cells_is_exact(spark):
    dice = np.random.default_rng(8)
    data = dice.standard_normal((300, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], VECTORS)
    for metric in Metric:
        index = ann.build(rows, IndexOptions(cells=9, train_rows=100), metric)
        assert _ids(index.search(data[0].tolist(), 7, 9)) == _ids(knn.top_k(rows, data[0].tolist(), 7, metric))
        queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 300, 20)], "query_id bigint, qvec array<float>")
        exact = knn.batch_top_k(rows, queries, 7, metric)
        found = index.batch_search(queries, 7, 9)
        assert sorted((r.query_id, r.rank, r.rowid) for r in found.collect()) == sorted((r.query_id, r.rank, r.rowid) for r in exact.collect())
    assert not ann.wants_index(2048, IndexOptions()) and ann.wants_index(2049, IndexOptions())


def test_index_reaches_its_recall_floor(spark):
    """Clustered vectors: the measured recall rises with the probes, and the chosen probes reach the floor on all queries."""
    dice = np.random.default_rng(9)
    centres = dice.standard_normal((40, 16))
    data = centres[dice.integers(0, 40, 2500)] + 0.3 * dice.standard_normal((2500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], VECTORS).repartition(4)
    index = ann.build(rows, IndexOptions(probes=1, recall_floor=0.98, sample_queries=64))
    assert 1 <= index.probes < len(index.centres) == 50
    shares = ann.recall_by_probes(index, 32, 10)
    assert (np.diff(shares) >= 0).all() and shares[-1] == 1.0
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(0, 2500, 20)], "query_id bigint, qvec array<float>")
    got = ann.recall(knn.batch_top_k(rows, queries, 10), index.batch_search(queries, 10)).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert got[1] == 125 and got[0] >= 0.95
    plan = index.probed(data[0].tolist(), 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#")[:100_000] or "PartitionFilters" in plan


def test_filter_tiers():
    index = ann.CellIndex(np.zeros((64, 2)), None, Metric.COSINE, 4, 100_000)
    assert ann.probes_for(index, 50, 100_000, 10) is None and ann.probes_for(index, 1000, 2000, 10) is None
    assert ann.probes_for(index, 100_000, 100_000, 10) == 4 and ann.probes_for(index, 50_000, 100_000, 10) == 8
    assert ann.probes_for(index, 20_000, 100_000, 10) == 20 and ann.probes_for(index, 5_000, 100_000, 10) == 16
    assert ann.probes_for(index, 3_000, 100_000, 4000) is None


@pytest.mark.parametrize("metric", list(Metric))
def test_batches_in_many_blocks(spark, metric):
    """Blocks of queries, ties, NaN, vectors of other lengths and nulls: as one query after the other."""
    dice = np.random.default_rng(4)
    data = [v.tolist() for v in dice.integers(-2, 3, (150, 3)).astype(float)] + [None, [1.0], [float("nan"), 1.0, 1.0]]
    rows = spark.createDataFrame(list(enumerate(data)), VECTORS).repartition(3)
    queries = spark.createDataFrame([(i, data[i]) for i in range(0, 150, 7)], "query_id bigint, qvec array<float>")
    want = {}
    for q in range(0, 150, 7):
        want[q] = _ids(knn.top_k(rows.where("size(vector) = 3"), data[q], 9, metric))
    for block_bytes in (1 << 20, 100):
        got = {}
        for r in knn.batch_top_k(rows, queries, 9, metric, block_bytes=block_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.rowid)
        assert got == want


def test_key_ring(spark):
    old = KeyRing({1: b"0" * 16})
    new = old.rotate(b"1" * 32)
    rows = spark.createDataFrame([("secret",), (None,)], "t string")
    for ring in (old, new):
        back = rows.select("t", ring.encrypt(F.col("t")).alias("c")).select("t", "c", new.decrypt(F.col("c")).alias("back")).collect()
        assert [r.back for r in back] == ["secret", None] and back[0].c.key_id == ring.active


def test_least_and_joins_of_keys_with_many_rows(spark):
    """A key with two thirds of all rows, a null value and a key of one row."""
    pairs = [(1, 10_000 + i) for i in range(3000)] + [(2 + i % 500, i) for i in range(1500)] + [(9000, None)]
    rows = spark.createDataFrame(pairs, "k bigint, v bigint").repartition(5)
    least = {}
    for k, v in pairs:
        least[k] = min(least.get(k, 10**9), 10**9 if v is None else v)
    got = with_least(rows, "k", "v", "low").collect()
    assert sorted((r.k, -1 if r.v is None else r.v) for r in got) == sorted((k, -1 if v is None else v) for k, v in pairs)
    assert all(r.low == (None if r.k == 9000 else least[r.k]) for r in got)
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("high"))
    joined = join_large_keys(rows, table.where("k <> 3"), ["k"], "n", len(pairs), F.col("v"))
    assert sorted(joined.columns) == ["high", "k", "v"]
    assert sorted((r.k, -1 if r.v is None else r.v) for r in joined.collect()) == sorted((k, -1 if v is None else v) for k, v in pairs if k != 3)
    # The key's rows are spread over many tasks, where tasks are neither joined nor saved by a broadcast.
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in off}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        for frame in (with_least(rows, "k", "v", "low"), join_large_keys(rows, table, ["k"], "n", len(pairs), F.col("v"))):
            assert frame.where("k = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_components_around_a_hub(spark):
    """A node with very many neighbours, below and above it, joined to a chain."""
    pairs = [(5000, i) for i in range(1000, 3000)] + [(5000, i) for i in range(6000, 8000)] + [(2999, 1), (7999, 9000), (9001, 9002)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert {n for n, c in got.items() if c == 1} == {x for p in pairs[:-1] for x in p} and got[9002] == 9001


@pytest.mark.parametrize("master, named, fits", [("spark://host:7077", None, False), ("local-cluster[2,1,1024]", None, False), ("yarn", "hdfs:///shared/", True), ("local[4]", None, True)])
def test_shared_folder_is_required_on_clusters(master, named, fits):
    class Session:
        class sparkContext:  # noqa: N801
            pass

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return named if name == "spark.checkpoint.dir" else default

    Session.sparkContext.master = master
    if fits:
        assert shared_dir(Session()) == "hdfs:///shared" if named else shared_dir(Session()).startswith("file:///")
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(Session())


def test_saved_frames_can_be_removed(spark):
    frame = saved(spark.range(10), "test")
    files, path = hadoop_path(spark, frame._palimpsest_path)
    assert frame.count() == 10 and files.exists(path)
    remove_saved(frame)
    assert not files.exists(path)


def test_word_and_space_classes_of_every_character(spark):
    """The tokenizer's classes are those of the stated sets, and cost no more than a property each."""
    import time

    from palimpsest.functions import text

    characters = spark.range(0x110000).where("id < 55296 OR id > 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c").where("id <> 65279")
    spaces = characters.where(~F.col("c").rlike(rf"\A{text._JAVA_SOLID}\z")).collect()
    assert sorted(r.c for r in spaces) == sorted(text.WHITE_SPACE)
    assert characters.where(F.col("c").rlike(rf"\A{text._JAVA_WORD}\z") != F.col("c").rlike(r"\A(?:\p{IsAlphabetic}|\p{N})\z")).isEmpty()
    words = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("retrieval of Überlieferungen, "), 50).alias("t"))

    def seconds(pattern):
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            words.agg(F.sum(F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(text._JAVA_PIECE) < 5 * seconds(r"\S+")


def test_equal_documents_rank_by_id_whatever_the_order_of_sums(spark):
    from palimpsest.operators import bm25

    dice = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for doc in dice.permutation(60):
        rows += [(words[i], int(doc), 1 + int(i) % 5, 36) for i in dice.permutation(12)]
    # Words differ in frequency, so that their parts differ.
    rows += [(words[i], 100 + n, 1, 9 + n) for i in range(12) for n in range(3 * i)]
    index = spark.createDataFrame(rows, "term string, rowid bigint, tf int, length int").repartition(3)
    queries = spark.createDataFrame([(1, " ".join(words))], "query_id bigint, qtext string")
    found = bm25.batch_search(index, queries, 60).orderBy("rank").collect()
    assert [r.rowid for r in found] == list(range(60))


def test_text_hashes_of_odd_batches():
    import pyarrow as pa

    from palimpsest.functions.scalar import fnv1a, fnv1a_texts

    texts = [None if i % 9 == 4 else "é中a " * (i % 7) ** 3 + "x" * (i % 31) for i in range(200)]
    for part in (texts, texts[:5], [], [None], [""]):
        want = [None if t is None else (fnv1a(t.encode()) + 2**63) % 2**64 - 2**63 for t in part]
        assert fnv1a_texts(pa.array(part, pa.string())).to_pylist() == want
    assert fnv1a_texts(pa.array(texts).slice(11, 90)).to_pylist() == fnv1a_texts(pa.array(texts)).to_pylist()[11:101]


def test_pairs_of_blocks_are_dealt_to_many_tasks(spark):
    """Pairs are long work on few bytes, so they must not be put together by their bytes."""
    dice = np.random.default_rng(6)
    data = 1.0 + 0.01 * dice.standard_normal((400, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], VECTORS)
    links = similarity.threshold_links(rows, 0.9, block_rows=40).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in links}) >= 12 and _reachable([(r.a, r.b) for r in links]) == {i: 0 for i in range(400)}


def test_products_near_the_threshold_are_exact():
    dice = np.random.default_rng(7)
    base, step = dice.standard_normal(16), dice.standard_normal(16)
    base, step = base / np.linalg.norm(base), step - (step @ base) / (base @ base) * base
    step /= np.linalg.norm(step)
    turned = [base] + [np.cos(a) * base + np.sin(a) * step for a in np.arccos(0.8 + np.array([1e-9, -1e-9, 1e-6, -1e-6, 0.1, -0.1]))]
    a, b = similarity._compare(np.arange(7), np.array(turned), np.zeros(7, int), False, 0.8)
    unit = np.array(turned) / np.linalg.norm(turned, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(7) for j in range(i) if unit[i] @ unit[j] >= 0.8]
    assert _reachable(list(zip(a.tolist(), b.tolist()))) == _reachable(pairs)
