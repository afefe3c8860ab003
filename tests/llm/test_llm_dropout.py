"""Every occurrence of a word draws its skipped merges afresh."""

import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

from palimpsest.llm import sentencepiece_dropout
from palimpsest.llm.tokens import vocabulary_path


WHOLE, MIX = 2**64 - 1, 0x9E3779B97F4A7C15


def _merge():
    return sentencepiece_dropout.encoder(vocabulary_path(sentencepiece_dropout.MODEL))


def test_each_occurrence_draws():
    merge = _merge()
    for word in ("a", "I", "information", "people"):
        n = 8000
        ids = merge.encode_batch([7], [" ".join([word] * n)])[0]
        keys = sentencepiece_dropout.word_keys(7, n)
        alone = merge.words([" " + word] * n, keys, sentencepiece_dropout.DROPOUT)
        assert ids.tobytes() == b"".join(alone)
        plain = merge.words([" " + word], keys[:1], 0)[0]
        split = np.mean([x != plain for x in alone])
        if len(word) == 1:
            assert 0.08 < split < 0.12
        else:
            assert 0.1 < split < 1 and len(set(alone)) > 4


def test_all_or_nothing():
    merge = _merge()
    text = "information for people é ▁ " * 3
    assert merge.encode_batch([1], [text], dropout=1.0)[0].size > merge.encode_batch([1], [text], dropout=0.0)[0].size
    assert merge.encode_batch([], []) == [] and merge.encode_batch([1], [""])[0].size == 0


# ---- brute force: the draws and merges of one word, step by step in plain Python ----

def _mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WHOLE
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WHOLE
    return x ^ (x >> 31)


class Slow:
    """The model's pieces as text, and one pass over all pairs for each merge."""

    def __init__(self):
        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(sentencepiece_dropout.MODEL))
        self.ids, self.score = {}, {}
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)):
                self.ids[self.model.id_to_piece(i)], self.score[self.model.id_to_piece(i)] = i, self.model.get_score(i)

    def word(self, word, doc_id, number, seed, dropout):
        # A literal mark never joins to a piece, nor does a character without a piece.
        parts = [(i, "▁" if c == " " else c, c != "▁" and ("▁" if c == " " else c) in self.ids) for i, c in enumerate(word)]
        key = _mixed((number * MIX + xxhash.xxh64_intdigest(str(doc_id).encode(), seed)) & WHOLE)

        def drawn(at, piece):
            return _mixed(((key ^ _mixed((at << 20) ^ (piece * MIX & WHOLE))) + MIX) & WHOLE) < dropout * 2**64

        while True:
            best = None
            for n, ((at, a, good), (_, b, also)) in enumerate(zip(parts, parts[1:])):
                if good and also and a + b in self.ids and not drawn(at, self.ids[a + b]):
                    rank = (-self.score[a + b], self.ids[a + b], at)
                    best = min(best or (rank, n), (rank, n))
            if best is None:
                break
            n = best[1]
            parts[n : n + 2] = [(parts[n][0], parts[n][1] + parts[n + 1][1], True)]
        out = []
        for _, text, good in parts:
            out += [self.ids[text]] if good else [self.model.piece_to_id(f"<0x{b:02X}>") for b in text.encode()]
        return out

    def text(self, text, doc_id, seed=sentencepiece_dropout.SEED, dropout=sentencepiece_dropout.DROPOUT):
        words = re.findall(" *[^ ]+| +", " " + text) if text else []
        return [i for n, w in enumerate(words) for i in self.word(w, doc_id, n, seed, dropout)]


@pytest.fixture(scope="module")
def slow():
    return Slow()


ODD = ["", " ", "  two  spaces  ", "▁ a▁b ▁▁", "é記憶 😀x́y", "a\nb\tc", "information " * 40, "x" * 70, "ab" * 60 + " c", "naïve-Ünïcödé.99"]


def test_dropout_equals_brute_force(spark, sf, slow):
    """The query's own rows: all documents of up to 6000 characters, and odd texts."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.createDataFrame(rows + [(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in sentencepiece_dropout.report(frame).collect()}
    ids = {r.doc_id: r.ids for r in sentencepiece_dropout.encode(frame, vocabulary_path(sentencepiece_dropout.MODEL)).collect()}
    tried = 0
    for doc_id, text in [(r.doc_id, r.text) for r in frame.collect()]:
        assert got[doc_id].lossless and got[doc_id].n_pieces == len(ids[doc_id])
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(ids[doc_id], "<i4").tobytes())
        if len(text) <= 6000:
            assert ids[doc_id] == slow.text(text, doc_id), text[:80]
            tried += 1
    assert tried > 100


@pytest.mark.parametrize("dropout", [0.0, 0.5, 1.0])
def test_any_rate_equals_brute_force(slow, dropout):
    merge = _merge()
    texts = [*ODD, "The quick brown fox jumps over the lazy dog, unbelievably."]
    for n in range(3):  # once to learn, then from kept states
        for i, (text, ids) in enumerate(zip(texts, merge.encode_batch([f"d{i}" for i in range(len(texts))], texts, 3 + n, dropout))):
            assert ids.tolist() == slow.text(text, f"d{i}", 3 + n, dropout)


def test_states_are_forgotten_without_change(monkeypatch, slow):
    monkeypatch.setattr(sentencepiece_dropout, "STATES", 40)
    merge = sentencepiece_dropout.MergeEncoder(vocabulary_path(sentencepiece_dropout.MODEL))
    for i in range(30):
        text = f"forgotten words number {i} come again and again"
        assert merge.encode_batch([i], [text])[0].tolist() == slow.text(text, i)


def test_heap_rounds_and_brute_force_agree(slow):
    merge, dice = _merge(), np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzéß記")
    for n in (300, 700, 1500):
        word = " " + "".join(dice.choice(letters, n))
        for dropout in (0.0, 0.1, 1.0):
            key = sentencepiece_dropout.word_keys("k", 1)
            ids = merge.heap(word, key[0], dropout)
            hashes = lambda owner, code: sentencepiece_dropout.skipped(key[owner], sentencepiece_dropout.candidate_hash(code), dropout)  # noqa: B023
            assert ids.tolist() == merge.rounds([word], hashes if dropout else None)[0].tolist() == slow.word(word, "k", 0, sentencepiece_dropout.SEED, dropout)


def test_long_word_is_linear_and_lossless():
    """Time grows with the length, not with its square, for words of mixed letters."""
    merge, dice = _merge(), np.random.default_rng(6)
    taken = {}
    for n in (25_000, 200_000):
        word = "".join(dice.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
        began = time.process_time()
        ids, = merge.encode_batch([1], [word])
        taken[n] = time.process_time() - began
        assert merge.decode(ids) == word
    assert taken[200_000] < 8 * 3 * max(taken[25_000], 0.1)
