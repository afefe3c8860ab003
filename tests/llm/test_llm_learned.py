"""Operators that SQL can't say: round trips, brute force and held-out accuracy."""

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import embedding_dedup, packing, quality_classifier, queries, sentencepiece_dropout, simhash, token_output
from palimpsest.llm.tokens import encoder, vocabulary_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", "  \n ", "Hello, WORLD! it's", "a\u00a0b\u2003c\x0bd", "ÀÉ ß ﬁ Ǆ", "记忆库 カナ 한글", "😀👍🏽 x́y", "<|endoftext|> <|startoftext|>", "x" * 3000, "word " * 5000, "don't-stop 3.14 1,000 a_b #tag @me", "Ünïcödé." * 40, "\ud7ff\ue000", "ab\u00adcd\u200bef\u200d"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text or "" for r in table.collect()}


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_cached_encoder_equals_the_tokenizer(texts, ids_of):
    fast = encoder(vocabulary_path())
    for text in [*texts.values(), *(t or "" for t in ODD)]:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == ids_of(text), text[:60]


# ---- token files ----

def test_token_files(spark, table, texts, ids_of):
    got = sorted(token_output.encode_and_read(table, vocabulary_path()).collect(), key=lambda r: r.doc_id)
    start = 0
    for row, (doc_id, text) in zip(got, sorted(texts.items()), strict=True):
        ids = ids_of(text) + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_close_at_their_limits(spark, ids_of, tmp_path):
    """Many files a task; an id, and null, with very many rows; ids still start where the ones before end."""
    texts = [f"row {i} " * (i % 13) for i in range(120)] + [None, ""]
    ids = [None] * 30 + [5] * 50 + list(range(42))
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(5)
    made = token_output.write(frame, f"file://{tmp_path}/tokens", vocabulary_path(), partitions=4, file_bytes=400, file_documents=7)
    assert len(made) > 17 and sum(m[3] for m in made) == len(ids) and all(m[3] <= 7 for m in made)
    hot = [m for m in made if m[0] == made[0][0]]
    assert sum(m[3] for m in hot) < 60  # neither null nor 5 alone fills a range of its own with the rest
    got = sorted(token_output.read_back(spark, f"file://{tmp_path}/tokens", made).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    want = sorted((i is not None, i or 0, crc(ids_of(t) + [2])) for i, t in zip(ids, texts))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want


def test_tasks_follow_the_input(spark, monkeypatch, table):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert token_output.tasks_for(table) == least
    monkeypatch.setattr(token_output, "TASK_BYTES", 10_000)
    assert token_output.tasks_for(table) > 5 * least
    assert token_output.tasks_for(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")) <= least


def test_reader_takes_only_the_frames_it_needs(tmp_path):
    name = tmp_path / "x.tok"
    with open(name, "wb") as stream:
        writer = token_output.FrameWriter(stream, frame_bytes=64)
        for i in range(50):
            writer.add(None if i == 0 else i, struct.pack(f"<{i}I", *range(i)))
        writer.close()
    with open(name, "rb") as file:
        reader = token_output.FrameReader(file, name.stat().st_size)
        assert len(reader.documents) == 50 and len(reader.sizes) > 10
        (entry, ids), = reader.read([33])
        assert entry["doc_id"] == 33 and np.frombuffer(ids, "<u4").tolist() == list(range(33))
        assert [len(x) // 4 for _, x in reader.read()] == list(range(50))
    raw = bytearray(name.read_bytes())
    raw[int(reader.offsets[3]) + int(reader.sizes[3]) // 2] ^= 0xFF
    (tmp_path / "y.tok").write_bytes(raw)
    with open(tmp_path / "y.tok", "rb") as file:
        broken = token_output.FrameReader(file, len(raw))
        with pytest.raises(Exception):  # noqa: B017  zstandard's error or the checksum's
            broken.frame(3)


# ---- SentencePiece ----

def test_without_dropout_it_is_sentencepiece(texts):
    import sentencepiece

    path = vocabulary_path(sentencepiece_dropout.MODEL)
    plain, merge = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_dropout.encoder(path)
    chosen = list(texts.values())[:40]
    for text, ids in zip(chosen, merge.encode_batch(list(range(len(chosen))), chosen, dropout=0.0), strict=True):
        if plain.decode(plain.encode(text)) == text:  # its normaliser leaves such texts alone
            assert ids.tolist() == plain.encode(text)


def test_dropout_varies_and_decodes(spark, table, texts):
    path = vocabulary_path(sentencepiece_dropout.MODEL)
    merge = sentencepiece_dropout.encoder(path)
    whole = [*texts.values(), *(t or "" for t in ODD), "▁a ▁ b", " lead", "trail ", "a  b"]
    one = merge.encode_batch(list(range(len(whole))), whole)
    assert [merge.decode(x) for x in one] == whole
    again = merge.encode_batch(list(range(len(whole))), whole)
    assert all((a == b).all() for a, b in zip(one, again, strict=True))
    other = merge.encode_batch(list(range(len(whole))), whole, seed=12)
    none = merge.encode_batch(list(range(len(whole))), whole, dropout=0.0)
    assert sum(len(a) != len(b) or (a != b).any() for a, b in zip(one, other, strict=True)) > 100
    assert sum(map(len, one)) > sum(map(len, none))
    assert [merge.decode(x) for x in merge.encode_batch([0], [whole[3]], dropout=1.0)] == [whole[3]]
    frame = docs(spark, ODD)
    back = sentencepiece_dropout.decode(sentencepiece_dropout.encode(frame, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert sentencepiece_dropout.report(frame).where("NOT lossless").count() == 0


# ---- packing ----

def check_packing(rows, want):
    """want: doc_id -> ids with the end id."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for doc_id, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[doc_id])
            assert r.ids_crc32 == crc(want[doc_id][at : at + r.length])
            at += r.length
        assert at == len(want[doc_id])
    padding = 0
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(map(len, want.values()))


def test_packing(spark, table, texts, ids_of):
    want = {d: ids_of(t) + [1] for d, t in texts.items()}
    check_packing(packing.pack(table, vocabulary_path()).collect(), want)
    check_packing(packing.pack(table.repartition(9), vocabulary_path(), open_windows=3, fan_in=8).collect(), want)
    with pytest.raises(ValueError):
        packing.pack(table, vocabulary_path(), open_windows=3, fan_in=4)


def test_packing_odd_texts(spark, ids_of):
    check_packing(packing.pack(docs(spark, ODD), vocabulary_path()).collect(), {i: ids_of(t) + [1] for i, t in enumerate(ODD)})


# ---- SimHash ----

def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_links(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> doc_id: smallest doc_id reachable."""
    rows = sorted(rows)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4]
    return {rows[i][0]: rows[l][0] for i, l in enumerate(by_links(len(rows), linked))}


def test_simhash(spark, table, texts):
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    want = brute_components(prints.items())
    got = simhash.report(table).collect()
    assert len(got) == len(prints)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("key_rows, block_rows", [(512, 8192), (1, 8192), (1, 16), (0.001, 32)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, key_rows, block_rows):
    """Chains of near fingerprints, in every layout of tables and blocks."""
    monkeypatch.setattr(simhash, "KEY_ROWS", key_rows)
    dice = np.random.default_rng(4)
    values = [int(x) for x in dice.integers(0, 2**64, 60, dtype=np.uint64)]
    for _ in range(400):
        value = values[dice.integers(0, len(values))]
        for bit in dice.choice(64, dice.integers(1, 7), replace=False):
            value ^= 1 << int(bit)
        values.append(value)
    values = sorted(set(values))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), len(values), block_rows=block_rows).collect()
    place = {v: i for i, v in enumerate(signed)}
    got = by_links(len(values), [(place[r.a], place[r.b]) for r in found])
    linked = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 4]
    assert got == by_links(len(values), linked)
    assert all(bin(values[place[r.a]] ^ values[place[r.b]]).count("1") <= 4 for r in found)


def test_simhash_odd_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e", "x", "s", 1), (1, "a b c d e", "y", "s", 1), (None, "a b c d e", "z", "s", 1), (2, None, "x", "s", 0), (3, "  ", "x", "s", 0), (None, None, None, None, None)], DOCS)
    got = {(r.doc_id, r.fingerprint == "0" * 16): r.component_id for r in simhash.report(frame).collect()}
    assert got[(1, False)] == 1 and got[(None, False)] == 1 and got[(2, True)] == got[(3, True)] == got[(None, True)] == 2
    kept = simhash.drop_near_duplicates(frame).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


# ---- embeddings ----

def test_embedding_links_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    dice = np.random.default_rng(6)
    data = [(r.vec_id, r.embedding, r.label) for r in rows]
    for i in range(400):  # neighbours at all distances around the threshold
        base = data[int(dice.integers(0, len(rows)))]
        data.append((10_000 + i, [float(x) for x in np.array(base[1]) + dice.standard_normal(64) * np.linalg.norm(base[1]) / 8 * dice.uniform(0, 0.6)], base[2]))
    data += [(20_000 + i, data[0][1], data[0][2]) for i in range(30)]
    odd = [(30_000, None, 1), (30_001, [0.0] * 64, 1), (30_002, [float("nan")] + [1.0] * 63, 1), (30_003, data[0][1], None), (30_004, [None] + [1.0] * 63, 1), (30_005, [], 1), (30_006, [1.0], 1), (30_007, [float("inf")] * 64, 1)]
    frame = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.report(frame).collect()}
    assert len(got) == len(data) + len(odd)
    unit = np.array([v for _, v, _ in data], np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([y for *_, y in data])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    total, found = int(near.sum()), sum(got[i].n_links for i, *_ in data)
    assert 0.9 * total <= found <= total
    for k, (i, *_) in enumerate(data):
        assert got[i].n_links <= near[k].sum()
        assert got[i].kept == (got[i].component_id == i)
    full = by_links(len(data), list(zip(*np.nonzero(near))))
    right = sum(got[i].component_id == data[full[k]][0] for k, (i, *_) in enumerate(data))
    assert right >= 0.9 * len(data)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_embedding_recall_plan():
    for n in (10, 10_000, 10_000_000, 10**10):
        k, tables = embedding_dedup.plan(n)
        close = embedding_dedup._same_cell(math.sqrt(2 - 2 * 0.93), embedding_dedup.WIDTH)
        assert 1 - (1 - close**k) ** tables >= embedding_dedup.RECALL


# ---- quality classifier ----

def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_quality_classifier(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    ranked = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ranked >= 0.9
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) >= 0.85


def test_classifier_never_sees_held_out_labels(spark, table):
    labels = table.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rows = quality_classifier.training_rows(table, labels)
    assert len(rows) == table.where(~quality_classifier.held_out()).count()


def test_classifier_score_equals_features():
    dice = np.random.default_rng(1)
    model = quality_classifier.QualityModel(dice.standard_normal(quality_classifier.BUCKETS), 0.25)
    scorer = quality_classifier.Scorer(model)
    for text in (*ODD, "a a a b b", "the same same words"):
        assert scorer.score(text) == pytest.approx(model.score(*quality_classifier.features(text)), abs=1e-6)


def test_classifier_without_labels(spark, table):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scores = {round(r.score, 9) for r in quality_classifier.report(table, none).collect()}
    assert scores == {0.5}


def test_classifier_hashes_like_plain_python():
    """Words and n-grams counted one by one, and blocks of any size give the same."""
    def mixed(x):
        whole = 2**64 - 1
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
        return x ^ (x >> 31)

    def slow(text):
        counts, before = {}, None
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            marked, found = f"<{word}>", []
            found.append(mixed(sum(mixed((ord(c) + i * 0x9E3779B97F4A7C15) % 2**64) for i, c in enumerate(marked)) % 2**64))
            for n in quality_classifier.NGRAMS:
                for i in range(len(marked) - n + 1):
                    h = 0
                    for c in marked[i : i + n]:
                        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                    found.append(mixed((h + n) % 2**64))
            if word == before:
                found += [mixed(2)] * quality_classifier.REPEAT_WEIGHT
            before = word
            for h in found:
                counts[h % quality_classifier.BUCKETS] = counts.get(h % quality_classifier.BUCKETS, 0) + 1
        return counts

    for text in (*ODD, "a a a b b", "the same same words"):
        assert dict(zip(*(x.tolist() for x in quality_classifier.features(text)))) == slow(text)


def test_classifier_in_small_blocks(monkeypatch):
    whole = [quality_classifier.features(t) for t in ODD]
    scorer = quality_classifier.Scorer(quality_classifier.QualityModel(np.random.default_rng(1).standard_normal(quality_classifier.BUCKETS), 0.25))
    scores = [scorer.score(t) for t in ODD]
    assert scorer.score_all(pa.array([t or "" for t in ODD])).tolist() == scores
    for size in (1, 7, 64):
        monkeypatch.setattr(quality_classifier, "BLOCK_CHARS", size)
        for text, (buckets, counts), score in zip([t if len(t or "") < 1000 else "x y " * 9 for t in ODD], whole, scores):
            if text in ODD:
                again = quality_classifier.features(text)
                assert again[0].tolist() == buckets.tolist() and again[1].tolist() == counts.tolist() and scorer.score(text) == score


def test_classifier_sample_is_bounded_and_ordered(spark, table):
    """Repeated ids count once, with their least text, and neither order nor partitioning matters."""
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rows = quality_classifier.training_rows(table, labels)
    plain = lambda found: [(b.tolist(), c.tolist(), y) for b, c, y in found]
    hot = table.where("doc_id = 1").withColumn("text", F.concat(F.col("text"), F.lit(" z"))).crossJoin(spark.range(5000)).drop("id")
    again = quality_classifier.training_rows(table.unionByName(hot).repartition(7), labels)
    assert plain(again) == plain(rows)
    few = quality_classifier.training_rows(table, labels, sample_bytes=sum(8 * len(b) for b, _, _ in rows[:10]))
    assert plain(few) == plain(rows[:10])
    assert plain(quality_classifier.training_rows(table, labels, sample_rows=7)) == plain(rows[:7])


# ---- both levels of the embedding operator ----

def _clustered(n, dim, seed):
    """Vectors in groups of all sizes around the threshold, one of them a third of all."""
    dice = np.random.default_rng(seed)
    base = dice.standard_normal((n // 3, dim))
    near = base + dice.standard_normal(base.shape) * dice.uniform(0, 0.45, (len(base), 1))
    hot = np.repeat(base[:1], n // 3, 0) + 0.12 * dice.standard_normal((n // 3, dim))
    return np.concatenate([base, near, hot]).astype(np.float32)


@pytest.mark.parametrize("cell_rows, bucket_rows", [(10**6, 2048), (10**6, 16), (100, 16), (100, 2048), (37, 8)])
def test_embedding_levels_against_brute_force(spark, cell_rows, bucket_rows):
    """One cell, many cells, crowded cells cut into blocks: the same counts but for the planned misses."""
    dim = 24
    data = _clustered(600, dim, 4)
    small = _clustered(30, dim, 5)
    rows = [(i, v.tolist(), "big") for i, v in enumerate(data)] + [(10_000 + i, v.tolist(), "small") for i, v in enumerate(small)]
    rows += [(20_000 + i, data[0].tolist(), "big") for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").repartition(5)
    got = {r.vec_id: r for r in embedding_dedup.report(frame, cell_bytes=8 * dim * cell_rows, bucket_rows=bucket_rows).collect()}
    assert len(got) == len(rows)
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([y for *_, y in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i, *_ in rows])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.97 * near.sum()
    if cell_rows == 10**6 and bucket_rows == 2048:
        assert (found == near.sum(axis=1)).all()
    full = by_links(len(rows), list(zip(*np.nonzero(near))))
    right = sum(got[i].component_id == rows[full[k]][0] for k, (i, *_) in enumerate(rows))
    assert right >= 0.97 * len(rows)


def test_embedding_keys_follow_from_the_vector_alone():
    dice = np.random.default_rng(2)
    unit = dice.standard_normal((500, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    whole = embedding_dedup.keys(unit, 5, 9)
    for part in (slice(0, 1), slice(3, 10), slice(100, 487)):
        assert (embedding_dedup.keys(unit[part], 5, 9) == whole[part]).all()
    assert (embedding_dedup.keys(unit, 5, 4) == whole[:, :4]).all()


def test_embedding_rows_carry_no_keys(spark):
    """What is dealt to the cells is the vector as it came, and a label that fits one cell is dealt once."""
    frame = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(50)], "node bigint, embedding array<float>, label int")
    classes = frame.selectExpr("label", "2 AS dim", "node", "1L AS members", "embedding")
    plan = embedding_dedup.links(classes)._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchange) == 1 and "keys" not in plan and "array<double>" not in plan
