import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from palimpsest.config import Compaction, Consolidation, Dedup, InsertMode, Metric, RelationKind, Retention, StoreConfig
from palimpsest.errors import (
    Busy, Closed, ConfigError, DimensionMismatch, DuplicateKey, KeyMismatch, LimitExceeded, MetaTooDeep, MetricMismatch, NonFinite, NotFound, ReadOnly, TooLarge,
)
from palimpsest.sources.store import DUPLICATE, INSERTED, MERGED, MemoryStore


class Clock:
    def __init__(self, now=1000):
        self.now = now

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def make(spark, tmp_path, clock):
    def build(**settings):
        return MemoryStore.open(spark, f"file://{tmp_path}/store", StoreConfig(**({"dimension": 2, "clock": clock} | settings)))

    return build


def rec(x=1.0, y=0.0, **fields):
    return {"vector": [x, y], **fields}


def ids(frame):
    return [r.rowid for r in frame.collect()]


def test_versions_ttl_and_time_travel(make, clock):
    store = make()
    ns = store.namespace("/a//b/")
    assert ns.path == "a/b"
    out = ns.insert_batch([rec(key="x", text="one"), rec(key="y", ttl_ms=500), rec(key="x", text="two")])
    assert [(o.status, o.rowid) for o in out] == [(INSERTED, 1), (INSERTED, 2), (INSERTED, 1)]
    assert ns.get("x").text == "two" and ns.count() == 2
    clock.now = 1200
    assert ns.update("x", {"text": "three", "metadata": '{"p": 2}', "importance": 7.0})
    row = ns.get("x")
    assert (row.text, row.created_at, row.tx_ms, row.importance) == ("three", 1000, 1200, 1.0)
    clock.now = 1500
    assert ns.count() == 1 and ns.iter(include_deleted=True).count() == 2
    assert store.as_of(1499).namespace("a/b").count() == 2 and store.as_of(1100).namespace("a/b").get("x").text == "two"
    assert ns.update("y", {"ttl_ms": 100}) and ns.count() == 2
    assert ns.delete("x") and not ns.delete("x") and not ns.update("x", {"text": "no"})
    assert [r and r.key for r in ns.get_many(["zz", "y", "x"])] == [None, "y", None]
    assert ns.insert(rec(key="x")).rowid == 1
    assert store.view().get_vector(1) == [1.0, 0.0] and store.list_namespaces() == ["a/b"]
    assert store.check().count() == 0


def test_clock_never_goes_back(make, clock):
    ns = make().namespace("n")
    ns.insert(rec(key="k", text="late"))
    clock.now = 10
    ns.update("k", {"text": "later"})
    assert ns.get("k").tx_ms == 1000 and ns.get("k").text == "later"


def test_pinned_snapshot(make):
    store = make()
    ns = store.namespace("n")
    ns.insert(rec(key="a"))
    pinned = store.snapshot()
    ns.insert(rec(key="b"))
    ns.delete("a")
    assert pinned.namespace("n").count() == 1 and pinned.namespace("n").get("a") is not None and ns.count() == 1


@pytest.mark.parametrize("bad, error", [
    ({"vector": [1.0]}, DimensionMismatch), ({"vector": [1.0, float("nan")]}, NonFinite), ({"vector": [1.0, 0.0], "importance": float("inf")}, NonFinite),
    ({"vector": [1.0, 0.0], "key": "k" * 1025}, TooLarge), ({"vector": [1.0, 0.0], "metadata": "{"}, ConfigError),
    ({"vector": [1.0, 0.0], "metadata": "[" * 33 + "]" * 33}, MetaTooDeep), ({"vector": [1.0, 0.0], "metadata": '"' + "x" * 65536 + '"'}, TooLarge),
    ({"vector": [1.0, 0.0], "color": 1}, ConfigError),
])
def test_batches_are_all_or_nothing(make, bad, error):
    store = make()
    ns = store.namespace("n")
    with pytest.raises(error):
        ns.insert_batch([rec(key="good"), bad])
    assert ns.count() == 0 and store.record["commit"] == 1


def test_limits_are_inclusive(make):
    ns = make().namespace("n")
    ns.insert_batch([rec(key="k" * 1024, metadata="[" * 32 + "]" * 32)])
    assert ns.count() == 1
    with pytest.raises(LimitExceeded):
        make().namespace("/".join("x" * 33)).insert(rec())


def test_reject_duplicate_mode(make):
    ns = make(insert_mode=InsertMode.REJECT_DUPLICATE).namespace("n")
    out = ns.insert_batch([rec(key="a", text="1"), rec(key="a", text="2"), rec(), rec()])
    assert [o.status for o in out] == [INSERTED, DUPLICATE, INSERTED, INSERTED] and out[1].score == 0.0
    with pytest.raises(DuplicateKey):
        ns.insert(rec(key="a"))
    assert ns.get("a").text == "1"


def test_dedup_modes(make, spark, tmp_path, clock):
    def fresh(name, **settings):
        return MemoryStore.open(spark, f"file://{tmp_path}/{name}", StoreConfig(dimension=2, clock=clock, **settings)).namespace("n")

    reject = fresh("r", dedup=Dedup.REJECT)
    out = reject.insert_batch([rec(1, 0, text="a"), rec(0, 1, text="a"), rec(1, 0.01, text="b"), rec(0, 1, text="c")])
    assert [o.status for o in out] == [INSERTED, DUPLICATE, DUPLICATE, INSERTED] and out[1].score == 1.0
    assert reject.insert(rec(0, 2, text="d")).status == DUPLICATE and reject.count() == 2
    replace = fresh("p", dedup=Dedup.REPLACE)
    first = replace.insert(rec(1, 0, key="k", text="a"))
    second = replace.insert(rec(1, 0, key="k", text="b"))
    assert second.rowid != first.rowid and replace.count() == 1 and replace.get("k").text == "b"
    merge = fresh("m", dedup=Dedup.MERGE, merge=lambda old, new: {**new, "text": old["text"] + "+" + new["text"]} if new["text"] != "keep" else None)
    one = merge.insert(rec(1, 0, text="a"))
    two = merge.insert(rec(1, 0, text="b"))
    assert two.status == MERGED and two.rowid == one.rowid and merge.iter().collect()[0].text == "a+b"
    assert merge.insert(rec(1, 0, text="keep")).status == INSERTED and merge.count() == 2
    with pytest.raises(ConfigError):
        StoreConfig(dimension=2, dedup=Dedup.MERGE)


def test_supersede(make, clock):
    store = make()
    ns = store.namespace("n")
    ns.insert(rec(key="k", text="old"))
    clock.now = 2000
    assert ns.supersede("k", rec(text="new", valid_from=1800)) == 1
    assert (ns.get("k").text, ns.get("k").valid_from) == ("new", 1800)
    history = store.view().versions().orderBy("seqno").collect()
    assert [r.valid_to for r in history] == [1800, None]
    with pytest.raises(KeyMismatch):
        ns.supersede("k", rec(key="other"))
    with pytest.raises(NotFound):
        ns.supersede("zz", rec())


def test_duplicate_key_on_update(make):
    ns = make().namespace("n")
    ns.insert_batch([rec(key="a"), rec(key="b")])
    with pytest.raises(DuplicateKey):
        ns.update("a", {"key": "b"})
    assert ns.update("a", {"key": "c"}) and ns.get("a") is None and ns.get("c").rowid == 1


def test_touch_and_feedback(make, clock):
    store = make()
    ns = store.namespace("n")
    ns.insert_batch([rec(key="a", importance=0.5, confidence=0.5), rec(key="b"), rec(key="old", ttl_ms=1)])
    clock.now = 1100
    assert ns.touch("a") and not ns.touch("old") and ns.count("access_count == 1 and last_access == ts\"1970-01-01T00:00:01.100Z\"") == 1
    assert ns.touch("a", boost=0.25) and ns.get("a").importance == 0.75
    assert ns.feedback(1, 7, used=True) and not ns.feedback(1, 7, used=True)
    assert ns.get("a").importance == pytest.approx(0.77) and ns.count("access_count == 3") == 1
    assert ns.feedback(1, 8, corrected_by=2) and ns.get("a").confidence == pytest.approx(0.4)
    assert [(r.from_id, r.kind) for r in ns.predecessors(1).collect()] == [(2, RelationKind.CONTRADICTS)]
    ns.record_hits(ns.search().vector([1.0, 0.0]).execute())
    assert ns.count("access_count >= 1") == 2


def test_relations(make, clock):
    store = make()
    ns = store.namespace("n")
    ns.insert_batch([rec(), rec(), rec(ttl_ms=1)])
    ns.relate(1, 2, weight=9.0)
    ns.relate(1, 2, weight=0.5)
    ns.relate(1, 3)
    clock.now = 5000
    assert sorted((r.to_id, r.weight) for r in ns.neighbors(1).collect()) == [(2, 0.5), (3, 1.0)]
    ns.delete(rowid=3)
    assert [r.to_id for r in ns.neighbors(1).collect()] == [2]
    assert ns.unrelate(1, 2, RelationKind.RELATED) and not ns.unrelate(1, 2, RelationKind.RELATED)
    assert store.relation_kind("supports") == 1 and store.relation_kind("likes") == 16 and store.relation_kind("likes") == 16
    with pytest.raises(TooLarge):
        store.relation_kind("")
    with pytest.raises(NonFinite):
        ns.relate(1, 2, weight=math.nan)


def test_search_pipeline(make, clock):
    store = make()
    ns = store.namespace("n")
    ns.insert_batch([
        rec(1, 0, text="alpha beta", metadata='{"p": 1}', importance=0.1), rec(0.9, 0.1, text="alpha", metadata='{"p": 2}', importance=0.9),
        rec(0, 1, text="gamma", metadata='{"p": 3}'), rec(0.99, 0.01, text="alpha alpha", metadata='{"p": 4}'),
    ])
    store.namespace("other").insert(rec(1, 0, text="alpha"))
    assert ids(ns.search().vector([1, 0]).top_k(2).execute()) == [1, 4]
    assert ids(ns.search().vector([1, 0]).where("p > 1").top_k(2).execute()) == [4, 2]
    assert ids(ns.search().text("alpha").where("p != 4").top_k(2).execute()) == [2, 1]
    assert set(ids(ns.search().vector([1, 0]).text("gamma").top_k(4).execute())) == {1, 2, 3, 4}
    assert ids(ns.search().vector([1, 0]).text("gamma").weighted(0.0).top_k(1).execute()) == [3]
    assert ids(ns.search().vector([1, 0]).score(w_sim=0, w_importance=1).top_k(4).execute())[0] == 2
    assert ids(ns.search().vector([1, 0]).dedup_near(0.999).top_k(4).execute()) == [1, 2, 3]
    assert ids(ns.search().vector([1, 0]).mmr(0.3).top_k(4).execute()) == [1, 3, 2, 4]
    assert ids(ns.search().vector([1, 0]).mmr(0.3).top_k(2).execute()) == [1, 4]  # chosen among the channel's own top_k
    ns.relate(1, 3, weight=1.0)
    hits = ns.search().vector([1, 0]).top_k(1).expand(hops=1, decay=0.5).top_k(3).execute().collect()
    assert [h.rowid for h in hits][0] == 1
    grown = {h.rowid: h for h in ns.search().vector([1, 0]).where("p == 1 or p == 3").top_k(2).expand(decay=0.5).execute().collect()}
    assert grown[3].score == 0.5 and grown[3].via.from_id == 1 and grown[1].via is None
    hit = ns.search().vector([1, 0]).query_id(42).rerank(lambda f: f.where("rowid = 1")).execute().collect()
    assert [(h.rowid, h.query_id, h.breakdown.sim) for h in hit] == [(1, 42, 1.0)]
    ns.delete(rowid=1)
    assert ids(ns.search().vector([1, 0]).top_k(1).execute()) == [4]
    clock.now = 2000
    assert ids(ns.search().vector([1, 0]).as_of(999).execute()) == []
    index = store.build_index("n")
    assert ids(ns.search().vector([1, 0]).using(index, 99).top_k(2).execute()) == [4, 2]


def test_search_validation(make):
    store = make()
    ns = store.namespace("n")
    ns.insert(rec())
    bad = [
        (ns.search(), ConfigError), (ns.search().vector([1]), DimensionMismatch), (ns.search().vector([1, math.inf]), NonFinite),
        (ns.search().vector([1, 0]).top_k(4097), LimitExceeded), (ns.search().vector([1, 0]).ef(5000), LimitExceeded),
        (ns.search().vector([1, 0]).text("a").weighted(1.5), ConfigError), (ns.search().vector([1, 0]).dedup_near(2.0), ConfigError),
        (ns.search().vector([1, 0]).mmr(math.nan), NonFinite),
    ]
    for search, error in bad:
        with pytest.raises(error):
            search.execute()
    store.close()
    store.close()
    with pytest.raises(Closed):
        ns.insert(rec())
    with pytest.raises(Closed):
        ns.search().vector([1, 0]).execute()


def test_forget_retain_and_drop(make, clock):
    store = make(retention=Retention(min_importance=0.3))
    ns = store.namespace("a/b")
    ns.insert_batch([rec(key=f"k{i}", importance=i / 10, metadata=f'{{"i": {i}}}') for i in range(10)])
    store.namespace("ab").insert(rec())
    assert ns.forget("i >= 8") == 2 and ns.forget("i >= 8") == 0
    report = ns.retain(Retention(min_importance=0.3, protect="i == 0"))
    assert (report.scanned, report.changed, report.ids) == (8, 2, [2, 3])
    assert ns.count() == 6
    done = store.maintenance_tick()
    assert done["retain a/b"].changed == 1
    assert store.drop_namespace("a") == 5 and store.list_namespaces() == ["ab"]
    assert store.drop_namespace("") == 1 and store.list_namespaces() == []


def test_consolidate(make):
    store = make()
    ns = store.namespace("n")
    ns.insert_batch([rec(1, 0, text="a", importance=0.2, confidence=0.5), rec(0.99, 0.01, text="b", importance=0.8), rec(0.98, 0.02, text="a", importance=0.8), rec(0, 1, text="z")])
    report = ns.consolidate(Consolidation(threshold=0.9, target="sums"))
    assert report.changed == 1
    made = store.namespace("sums").iter().collect()[0]
    assert made.text == "a; b" and made.importance == pytest.approx(0.8) and made.confidence == pytest.approx(2.5 / 3)
    assert made.vector == pytest.approx([0.98, 0.02])
    assert sorted(r.to_id for r in store.view().edges().collect()) == [1, 2, 3]
    assert ns.consolidate(Consolidation(threshold=0.9)).changed == 0
    again = ns.consolidate(Consolidation(threshold=0.9, filter="rowid == 4"))
    assert again.changed == 0
    with pytest.raises(ConfigError):
        Consolidation(threshold=1.5)


def test_consolidate_cuts_and_summarizes(make):
    store = make()
    ns = store.namespace("n")
    ns.insert_batch([rec(1, i / 1000, text=f"t{i}", importance=i / 10) for i in range(5)])
    report = ns.consolidate(Consolidation(threshold=0.9, max_cluster=2, keep_sources=False, summarizer=lambda rows: {"vector": rows[0]["vector"], "text": f"{len(rows)} rows"}))
    assert report.changed == 1 and store.view().get_by_rowid(report.ids[0]).text == "2 rows"
    assert ns.count("rowid <= 5") == 3


def test_compaction_and_vacuum(make, clock):
    store = make()
    ns = store.namespace("n")
    ns.insert_batch([rec(key="a", text="1"), rec(key="b")])
    clock.now = 2000
    ns.update("a", {"text": "2"})
    ns.delete("b")
    ns.touch("a")
    ns.supersede("a", rec(text="3"))
    clock.now = 9000
    before = ns.iter().collect()
    assert store.compact(Compaction(history_horizon_ms=1000), force=True).changed == 4
    assert ns.iter().collect() == before and store.vacuum() > 0 and ns.iter().collect() == before
    assert store.view().versions().count() == 1 and ns.count("access_count == 1") == 1
    assert store.compact().changed == 0


def test_reopen_reload_backup_and_conflicts(make, spark, tmp_path, clock):
    store = make()
    ns = store.namespace("n")
    ns.insert(rec(key="a"))
    other = make()
    reader = make(read_only=True)
    ns.insert(rec(key="b"))
    assert reader.namespace("n").count() == 1 and reader.reload() and reader.namespace("n").count() == 2 and not reader.reload()
    with pytest.raises(ReadOnly):
        reader.namespace("n").insert(rec())
    with pytest.raises(Busy):
        other.namespace("n").insert(rec())
    with pytest.raises(MetricMismatch):
        make(metric=Metric.DOT)
    with pytest.raises(DimensionMismatch):
        make(dimension=3)
    with pytest.raises(NotFound):
        MemoryStore.open(spark, f"file://{tmp_path}/none", StoreConfig(dimension=2, read_only=True))
    assert store.backup_to(f"file://{tmp_path}/copy")["files"] > 0
    copy = MemoryStore.open(spark, f"file://{tmp_path}/copy", StoreConfig(dimension=2, clock=clock))
    assert copy.namespace("n").count() == 2
    with pytest.raises(Busy):
        store.backup_to(f"file://{tmp_path}/copy")


def test_torn_commit_is_ignored(make, tmp_path):
    store = make()
    store.namespace("n").insert(rec(key="a"))
    (tmp_path / "store/commits/000000000099.json").write_text('{"format": 1, "comm')
    again = make()
    assert again.namespace("n").count() == 1
    again.namespace("n").insert(rec(key="b"))
    assert make().namespace("n").count() == 2


def test_observer_cannot_break_writes(make):
    seen = []

    def observer(event, details):
        seen.append(event)
        raise RuntimeError

    make(observer=observer).namespace("n").insert(rec())
    assert seen == ["write"]


def test_stream_ingest_skips_replays(make, spark, tmp_path):
    from palimpsest.streaming.ingest import ingest

    store = make()
    ns = store.namespace("n")
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "key string, vector array<float>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, vector array<float>").parquet(f"{tmp_path}/in")
    ingest(stream, ns, "feed", f"{tmp_path}/check", available_now=True).awaitTermination()
    assert ns.count() == 2
    batch = spark.createDataFrame([("c", [1.0, 0.0])], "key string, vector array<float>")
    assert ns.insert_df(batch, stream=("feed", 0)).count() == 0 and ns.count() == 2
    assert ns.insert_df(batch, stream=("feed", 1)).count() == 1 and ns.count() == 3


_STEP = st.tuples(st.sampled_from(["put", "del"]), st.sampled_from("ab"), st.integers(0, 3))


@given(st.lists(_STEP, min_size=1, max_size=5))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_time_travel_replays_history(spark, tmp_path_factory, steps):
    clock, past, state = Clock(0), {}, {}
    store = MemoryStore.open(spark, f"file://{tmp_path_factory.mktemp('s')}/s", StoreConfig(dimension=2, clock=clock))
    ns = store.namespace("n")
    for what, key, value in steps:
        clock.now += 10
        if what == "put":
            ns.insert(rec(key=key, text=str(value)))
            state[key] = str(value)
        else:
            assert ns.delete(key) == (key in state)
            state.pop(key, None)
        past[clock.now] = dict(state)
    for at, expected in past.items():
        assert {r.key: r.text for r in store.as_of(at).namespace("n").iter().collect()} == expected


# ---- deduplicating writes of any size ----

def _sequential(records, mode, threshold, merge=None):
    """The rule by plain Python, one record after the other: key -> (vector, text) that are left, and the outcomes."""
    unit = lambda v: np.asarray(v, float) / max(np.linalg.norm(v), 1e-12)
    live, outcomes, number = {}, [], 0
    for r in records:
        same = [i for i, o in live.items() if r["text"] is not None and o["text"] == r["text"]]
        scores = {i: float(unit(o["vector"]) @ unit(r["vector"])) for i, o in live.items()}
        match = min(same) if same else max((i for i in scores if scores[i] >= threshold), key=lambda i: (scores[i], -i), default=None)
        if match is not None and mode is Dedup.REJECT:
            outcomes.append(DUPLICATE)
            continue
        if match is not None and mode is Dedup.MERGE:
            live[match] = merge(live[match], r)
            outcomes.append(MERGED)
            continue
        if match is not None:
            del live[match]
        number += 1
        live[number] = r
        outcomes.append(INSERTED)
    return outcomes, live


@pytest.mark.parametrize("mode, block", [(Dedup.REJECT, 9), (Dedup.REPLACE, 9), (Dedup.MERGE, 9), (Dedup.REPLACE, 4096)])
def test_dedup_in_blocks_is_sequential(spark, tmp_path, monkeypatch, clock, mode, block):
    """Records that repeat those of other blocks and of the store; far more than a block."""
    from palimpsest.sources import store as module

    monkeypatch.setattr(module, "BLOCK_RECORDS", block)
    monkeypatch.setattr(module, "KNOWN_MATCHES", 2)
    dice = np.random.default_rng(3)
    corners = np.eye(12)
    records = []
    for _ in range(30):
        at = int(dice.integers(0, 7))
        vector = corners[at] + 0.02 * dice.standard_normal(12)
        records.append({"vector": [float(np.float32(x)) for x in vector], "text": dice.choice(["a", "b", None, None, None, f"t{dice.integers(0, 9)}"])})
    for r in records:
        r["text"] = None if r["text"] is None else str(r["text"])
    merge = lambda old, new: {"vector": new["vector"], "text": (old["text"] or "") + (new["text"] or "")}
    config = StoreConfig(dimension=12, clock=clock, dedup=mode, dedup_threshold=0.9, merge=merge)
    space = MemoryStore.open(spark, f"file://{tmp_path}/s", config).namespace("n")
    want, left = _sequential(records, mode, 0.9, merge)
    got = [o.status for o in space.insert_batch(records[:9])]
    frame = spark.createDataFrame([(r["vector"], r["text"]) for r in records[9:]], "vector array<float>, text string").coalesce(1)
    got += [r.status for r in space.insert_df(frame).orderBy("ord").collect()]
    assert got == want
    assert sorted(str(r.text) for r in space.iter().collect()) == sorted(str(r["text"]) for r in left.values())
    assert space.view.check().count() == 0 and space.store.record["commit"] == 3  # one commit a call


@pytest.mark.parametrize("mode", [Dedup.OFF, Dedup.REJECT, Dedup.REPLACE, Dedup.MERGE])
def test_replays_are_skipped_in_every_mode(spark, tmp_path, clock, mode):
    config = StoreConfig(dimension=2, clock=clock, dedup=mode, merge=lambda old, new: {**new, "text": old["text"] + "+" + new["text"]})
    space = MemoryStore.open(spark, f"file://{tmp_path}/s", config).namespace("n")
    space.insert(rec(text="a"))
    batch = spark.createDataFrame([([1.0, 0.0], "b")], "vector array<float>, text string")
    first = space.insert_df(batch, stream=("feed", 4)).collect()
    state = sorted((r.rowid, r.text) for r in space.iter().collect())
    assert len(first) == 1 and space.insert_df(batch, stream=("feed", 4)).collect() == [] and space.insert_df(batch, stream=("feed", 3)).count() == 0
    assert sorted((r.rowid, r.text) for r in space.iter().collect()) == state
    assert len(space.insert_df(batch, stream=("feed", 5)).collect()) == 1


def test_failed_dedup_leaves_nothing(spark, tmp_path, clock, monkeypatch):
    from palimpsest.sources import store as module
    from palimpsest.sources.doubles import FailingLog

    monkeypatch.setattr(module, "BLOCK_RECORDS", 2)
    store = MemoryStore.open(spark, f"file://{tmp_path}/s", StoreConfig(dimension=2, clock=clock, dedup=Dedup.REJECT))
    store.log = FailingLog(store.log)
    store.log.fail("commit")
    with pytest.raises(OSError):
        store.namespace("n").insert_batch([rec(text=f"t{i}") for i in range(5)])
    assert store.namespace("n").count() == 0 and store.list_namespaces() == []
    store.log.fail("versions", ValueError("full"))
    with pytest.raises(ValueError):
        store.namespace("n").insert(rec())
    assert store.namespace("n").insert(rec()).rowid == 1 and store.vacuum() >= 3


# ---- a stored index ----

def test_stored_index_is_never_stale(make, spark):
    from palimpsest.config import IndexOptions

    store = make(index=IndexOptions(cells=4, brute_force_max_rows=10, recall_floor=1.0))
    ns = store.namespace("n")
    angles = [i / 40 for i in range(60)]
    ns.insert_batch([rec(math.cos(a), math.sin(a), key=f"k{i}", metadata=f'{{"i": {i}}}') for i, a in enumerate(angles)])
    query = [1.0, 0.0]

    def agrees():
        for search in (lambda: ns.search().vector(query).top_k(8), lambda: ns.search().vector(query).where("i >= 1").top_k(8)):
            want = [(r.key, round(r.score, 6)) for r in search().exact().execute().collect()]
            index = store.view().index("n")
            for hits in (search().using(index, 4).execute(), search().execute()):
                assert [(r.key, round(r.score, 6)) for r in hits.collect()] == want

    index = store.build_index("n")
    assert index.size == 60 and store.view().index("n").probes == index.probes
    agrees()
    ns.update("k0", {"vector": [-1.0, 0.0]})
    ns.insert(rec(1.0, 0.001, key="new", metadata='{"i": 99}'))
    ns.delete("k2")
    agrees()
    assert [r.key for r in ns.search().vector(query).top_k(2).execute().collect()] == ["new", "k1"]
    reopened = MemoryStore.open(spark, store.log.root, store.config)
    assert [r.key for r in reopened.namespace("n").search().vector(query).top_k(2).execute().collect()] == ["new", "k1"]
    old = store.record["indexes"]["n"]["folder"]
    store.build_index("n")
    agrees()
    assert store.vacuum() >= 1 and old not in store.log.unlisted(store.record)
    assert store.drop_index("n") and not store.drop_index("n") and store.view().index("n") is None


def test_index_dispatch(make, monkeypatch):
    """Used beyond the size limit and for the present only; few candidates are scanned."""
    from palimpsest.config import IndexOptions
    from palimpsest.plans.search import Search

    store = make(index=IndexOptions(cells=3, brute_force_max_rows=20, probes=1, recall_floor=0.0))
    ns = store.namespace("n")
    ns.insert_batch([rec(math.cos(i), math.sin(i), metadata=f'{{"i": {i}}}') for i in range(20)])
    chosen = lambda s: s._dispatch(store.view().rows("n"), None if s._filter is None else __import__("palimpsest.plans.compile", fromlist=["x"]).compile_filter(s._filter))
    search = lambda: ns.search().vector([1.0, 0.0])
    assert chosen(search()) is None
    index = store.build_index("n")
    assert chosen(search()) is None and chosen(search().using(index))[1] == index.probes == 1
    ns.insert(rec())
    store.build_index("n")
    assert chosen(search())[1] == 1 and chosen(search().exact()) is None and chosen(search().as_of(999)) is None
    assert chosen(search().where("i < 3")) is None and isinstance(search(), Search)


# ---- events, numbers, hits, files ----

def test_events_and_query_numbers(make):
    seen = []
    store = make(observer=lambda event, details: seen.append((event, details)))
    ns = store.namespace("n")
    ns.insert_batch([rec(key="a"), rec(0, 1, key="b")])
    numbers = [ns.search().vector([1, 0]).execute().first().query_id for _ in range(3)]
    assert numbers == [1, 2, 3] and ns.search().vector([1, 0]).query_id(77).execute().first().query_id == 77
    with pytest.raises(DimensionMismatch):
        ns.search().vector([1]).execute()
    store.flush()
    store.compact(force=True)
    events = [e for e, _ in seen]
    assert events.count("query") == 4 and events.count("flush") == 1 and "compaction" in events and events[0] == "write"
    assert [d["during"] for e, d in seen if e == "error"] == ["query"]
    failing = make(observer=lambda *_: 1 / 0)
    assert failing.namespace("n").search().vector([1, 0]).execute().count() == 2


def test_hits_count_at_the_next_flush(make, clock):
    store = make(count_hits=True)
    ns = store.namespace("n")
    ns.insert_batch([rec(key="a"), rec(0, 1, key="b")])
    for _ in range(2):
        assert ids(ns.search().vector([1, 0]).top_k(1).execute()) == [1]
    ns.search().vector([1, 0]).as_of(5000).top_k(1).execute()
    count = lambda: {r.key: r.access_count for r in store.view().rows("n", with_access=True).collect()}
    assert not any(count().values())
    store.flush()
    assert count()["a"] == 2 and not count()["b"]
    commit = store.record["commit"]
    store.flush()
    assert store.record["commit"] == commit
    ns.search().vector([0, 1]).top_k(1).execute()
    store.close()
    assert {r.key: r.access_count for r in make().view().rows("n", with_access=True).collect()}["b"] == 1


@pytest.mark.parametrize("codec", [None, "zstd"])
def test_compression_of_data_files(make, spark, tmp_path, codec):
    import pyarrow.parquet as pq

    make(compression=codec).namespace("n").insert(rec(text="word " * 500))
    files = list((tmp_path / "store" / "data" / "versions").rglob("*.parquet"))
    found = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups}
    assert found == {{None: "SNAPPY", "zstd": "ZSTD", "gzip": "GZIP", "none": "UNCOMPRESSED"}[codec]}
    with pytest.raises(ConfigError):
        StoreConfig(dimension=2, compression="rar")


def test_async_facade(spark, tmp_path, clock):
    import asyncio

    from palimpsest.sources.aio import AsyncStore

    async def use():
        store = await AsyncStore.open(spark, f"file://{tmp_path}/s", StoreConfig(dimension=2, clock=clock))
        ns = store.namespace("n")
        await ns.insert_batch([rec(key="a", text="alpha"), rec(0, 1, key="b")])
        reads = await asyncio.gather(ns.get("a"), ns.count(), ns.exists("zz"), ns.search(lambda s: s.vector([0, 1]).top_k(1)), ns.rows("key == \"b\""), store.list_namespaces())
        await ns.delete("a")
        with pytest.raises(DimensionMismatch):
            await ns.insert({"vector": [1.0]})
        return reads, await ns.count(), ns.path

    (row, n, there, hits, rows, spaces), left, path = asyncio.run(use())
    assert (row.text, n, there, [h.key for h in hits], [r.key for r in rows], spaces) == ("alpha", 2, False, ["b"], ["b"], ["n"]) and left == 1 and path == "n"


@pytest.mark.parametrize("mode", [Dedup.REJECT, Dedup.MERGE])
def test_merged_records_are_written_in_parts_and_lone_ones_at_once(spark, tmp_path, clock, monkeypatch, mode):
    """Only records that depend on others go through the driver, and what these write is cut by its size."""
    from palimpsest.sources import store as module

    monkeypatch.setattr(module, "BLOCK_RECORDS", 8)
    monkeypatch.setattr(module, "PART_BYTES", 600)
    settled, settle, parts, append = [], module.Namespace._settle, [], module._Write.append

    def counted(self, write, block, start):
        settled.append(block.count())
        return settle(self, write, block, start)

    def measured(self, table, frame):
        if table == "versions":
            parts.append(frame.count())
        return append(self, table, frame)

    monkeypatch.setattr(module.Namespace, "_settle", counted)
    monkeypatch.setattr(module._Write, "append", measured)
    units = np.eye(40)
    records = [(units[i].tolist(), f"t{i % 12}" if i < 36 else None, f"k{i}") for i in range(38)] + [((units[37] + 0.01 * units[0]).tolist(), "t99", "k99"), (units[39].tolist(), "t3", "k0")]
    merge = lambda old, new: {**new, "key": None, "text": old["text"], "metadata": "[" + "1," * 300 + "1]"}
    config = StoreConfig(dimension=40, clock=clock, dedup=mode, merge=merge)
    space = MemoryStore.open(spark, f"file://{tmp_path}/s", config).namespace("n")
    frame = spark.createDataFrame(records, "vector array<float>, text string, key string").coalesce(1)
    got = [r.status for r in space.insert_df(frame).orderBy("ord").collect()]
    repeat = "duplicate" if mode is Dedup.REJECT else "merged"
    assert got == ["inserted"] * 12 + [repeat] * 24 + ["inserted"] * 2 + [repeat] * 2
    assert space.view.check().count() == 0 and space.store.record["commit"] == 2  # one for opening
    if mode is Dedup.REJECT:
        # The similar pair, and the texts of a key that comes twice.
        assert sum(settled) == 9 and space.count() == 14
    else:
        assert max(parts) <= 12 and len(parts) >= 24
