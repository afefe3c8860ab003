"""Texts as sets of word shingles, cut and hashed as arrays, and the keys that propose similar sets.

A text's words are what stands between ASCII blanks, in ASCII lower case. Each
distinct word of a chunk is hashed once; a shingle's 64-bit hash is made of its
words' hashes in order. A text of fewer words is one shingle, one without words
has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from palimpsest.llm.common import BLANKS
from palimpsest.llm.tokens import _bytes_of, cut_words

SHINGLE_WORDS = 5
#: Keys of a set, and MinHashes of each. A pair at similarity 0.8 shares no key with
#: chance (1 - 0.8^4)^20 = 3e-5, a closer one less often.
BANDS = 20
BAND_ROWS = 4
SEED = 42
#: Texts are hashed together up to so many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [ord(c) for c in BLANKS])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_dice = np.random.default_rng(SEED)
_FACTORS = _dice.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _dice.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, which has a byte at least."""
    data, at = _bytes_of(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    return _mixed(np.add.reduceat(_mixed(_LOWER[data] + (place.astype(np.uint64) + np.uint64(1)) * _MIX), at[:-1]) + np.diff(at).astype(np.uint64))


def shingle_hashes(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles in a row, repeats included; each text's first place, with the end).

    `texts` has no nulls.
    """
    words, begin, at = cut_words(texts, _BLANK)
    each = word_hashes(words.dictionary)[words.indices.to_numpy()]
    first = np.searchsorted(begin, at)
    count = np.diff(first)
    whole = np.zeros(len(each), np.uint64)
    reach = np.repeat(first[1:], count) - np.arange(len(each))
    for i in range(size):
        on = np.flatnonzero(reach > i)
        whole[on] = (whole[on] + each[on + i]) * _MIX
        whole[on] ^= whole[on] >> np.uint64(32)
    # A shingle starts at every word that has size - 1 more behind it; a short text at its first.
    starts = reach >= size
    starts[first[:-1][(count > 0) & (count < size)]] = True
    return _mixed(whole[starts]), np.concatenate(([0], np.cumsum(starts)))[first]


def sets_of(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, in the same form."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(new)))[at]


def band_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys [texts, BANDS] of sets given in a row; those of an empty set mean nothing."""
    n = len(at) - 1
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for band in range(BANDS):
            for i in range(BAND_ROWS):
                f = band * BAND_ROWS + i
                least = np.minimum.reduceat(_FACTORS[f] * hashes + _SHIFTS[f], at[some])
                out[some, band] = (out[some, band] ^ least) * _MIX
                out[some, band] ^= out[some, band] >> np.uint64(29)
    return out.view(np.int64)


def chunks(texts: pa.Array):
    """Slices of texts without nulls, together of about `CHUNK_BYTES` bytes or one text."""
    _, at = _bytes_of(texts)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
        yield texts.slice(row, to - row)
        row = to
