"""The pipeline's near copies against brute force."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from palimpsest.llm import shingles, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(texts):
    """Ids of the first member of each group, by all pairs."""
    sets = [_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] and not sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label))


def _edited():
    """Texts and copies with one to four words changed; similarities from about 0.8 to 0.98."""
    dice = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in range(60):
        base = [str(x) for x in dice.choice(words, 120)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4)[: n % 4 + 1]:
            copy = list(base)
            for at in dice.choice(120, changes, replace=False):
                copy[at] = f"new{n}x{at}"
            texts.append(" ".join(copy))
    return [*texts, "few words", "few  WORDS", None, " \n"]


@pytest.mark.parametrize("block_rows", [256, 2])
def test_edited_copies_go(spark, block_rows):
    texts = _edited()
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = simhash.drop_near_duplicates(frame, block_rows=block_rows)
    assert got.dtypes == frame.dtypes
    assert sorted(r.doc_id for r in got.collect()) == _kept(texts)


def test_stage_drops_edited_copies(spark, sf):
    texts = _edited()
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, frame, sf)
    assert sorted(r.doc_id for r in got.collect()) == _kept(texts)
    assert got.limit(0).columns == frame.columns and simhash.drop_near_duplicates(frame.limit(0)).collect() == []


def test_documents(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = simhash.drop_near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(r.doc_id for r in got.collect()) == [rows[i].doc_id for i in _kept([r.text for r in rows])]


def test_null_and_repeated_ids(spark, sf):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(30))
    # Copies without an id; a copy of a kept document without an id; one id with unrelated texts, one of them a copy.
    rows = [(None, text(1)), (None, text(1)), (1, text(2)), (None, text(2)), (2, text(2)), (2, text(3))]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, frame, sf)
    assert {(r.doc_id, r.text) for r in got.collect()} == {(None, text(1)), (1, text(2)), (2, text(3))} and got.count() == 3


TEXTS = ["", " \n", "one", "One  two\tTHREE four", "one two three four five", "ONE TWO three four five six", "one two three four five one two three four five", "é Ü é Ü é Ü é", "x" * 5000]


def test_shingles_are_windows_of_five_words():
    """Equal hashes for equal windows, others for others, whatever stands around."""
    hashes, at = shingles.shingle_hashes(pa.array(TEXTS))
    meaning, back = {}, {}
    for i, text in enumerate(TEXTS):
        words = text.encode().lower().split()
        want = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        got = hashes[at[i] : at[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got):
            assert meaning.setdefault(w, h) == h and back.setdefault(h, w) == w
        alone, _ = shingles.shingle_hashes(pa.array([text]))
        assert alone.tolist() == got
    sets, cuts = shingles.sets_of(hashes, at)
    keys = shingles.band_keys(hashes, at)
    for i in range(len(TEXTS)):
        assert sets[cuts[i] : cuts[i + 1]].tolist() == sorted(set(hashes[at[i] : at[i + 1]].tolist()))
        if at[i] < at[i + 1]:
            assert (keys[i] == shingles.band_keys(sets[cuts[i] : cuts[i + 1]], np.array([0, cuts[i + 1] - cuts[i]]))[0]).all()


def test_bands_propose_pairs_at_the_threshold():
    dice, met = np.random.default_rng(8), 0
    for _ in range(2000):
        both, one = dice.integers(0, 2**64, 96, dtype=np.uint64), dice.integers(0, 2**64, 24, dtype=np.uint64)
        a, b = np.concatenate((both, one[:12])), np.concatenate((both, one[12:]))
        keys = shingles.band_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        met += (keys[0] == keys[1]).any()
    assert met >= 1997


@pytest.mark.parametrize("radius", [0, 1, 4, 6, 7, 26, 40])
def test_bit_sliced_distances_of_any_radius(radius):
    dice = np.random.default_rng(radius)
    values = dice.integers(0, 2**64, 200, dtype=np.uint64)
    values[100:] = values[:100] ^ np.array([sum(1 << int(b) for b in dice.choice(64, int(dice.integers(0, 50)), replace=False)) for _ in range(100)], np.uint64)
    vertical = simhash.planes(values)
    word = np.tile(np.arange(4), 200)
    at, lanes = simhash.near(vertical, word, np.repeat(values, 4), radius)
    got = set()
    for k, lane in zip(*simhash._lanes(at, lanes)):
        if word[k] * 64 + lane < 200:
            got.add((int(k) // 4, int(word[k] * 64 + lane)))
    assert got == {(i, j) for i in range(200) for j in range(200) if bin(int(values[i] ^ values[j])).count("1") <= radius}


@pytest.mark.parametrize("sided", [False, True])
def test_similar_links_against_all_pairs(sided):
    """Sets of 1 to 200 hashes, edited by a few; the fingerprints' radius loses none."""
    dice = np.random.default_rng(9)
    sets = []
    for n in range(150):
        base = dice.integers(0, 2**64, int(dice.integers(1, 200)), dtype=np.uint64)
        for _ in range(4):
            copy = base.copy()
            for at in dice.choice(len(base), int(len(base) * dice.uniform(0, 0.2)), replace=False):
                copy[at] = dice.integers(0, 2**64, dtype=np.uint64)
            sets.append(np.unique(copy))
    side = np.arange(len(sets)) % 2 if sided else None
    found = simhash.similar_links(sets, side)
    plain = [set(x.tolist()) for x in sets]
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if (side is None or side[i] != side[j]) and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])
    ]
    def components(pairs):
        label = list(range(len(sets)))
        for _ in range(len(sets)):
            before = list(label)
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
            if label == before:
                break
        return label
    assert components(found.T.tolist()) == components(linked)
    assert set(map(tuple, np.sort(found.T, axis=1).tolist())) <= {(j, i) for i, j in linked}


def test_stage_passes_clashing_columns(spark):
    """Columns of the operator's own names keep their values."""
    names = ("_row", "row", "doc", "node", "h1", "_h1", "keys", "place", "component", "best", "_slot")
    frame = spark.createDataFrame([(1, "some words here", "a"), (2, "other words there now", "b"), (3, "some words here", "c")], "doc_id bigint, text string, lang string")
    wide = frame.select("*", *(frame.lang.alias(n) for n in names))
    got = simhash.drop_near_duplicates(wide)
    assert got.columns == wide.columns and {tuple(r)[2:] for r in got.collect()} == {("a",) * 12, ("b",) * 12}
