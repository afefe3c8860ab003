"""Token ids of whole texts with a public vocabulary, word by word over whole batches.

Vocabulary files stay where the installed package has them; `path` is a
parameter of every operator that needs one.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Entries of a worker's younger word cache. When it is full it becomes the older
#: one, whose words come back as they are met again; so memory is bounded by twice
#: as many entries, and words in use stay.
CACHE_ENTRIES = 300_000
LONGEST_CACHED = 64
#: Texts are encoded together up to so many bytes; a longer text goes alone.
CHUNK_BYTES = 8 << 20
#: Bytes that part words: blank, tab and line ends.
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
#: Latin-1 letters and then at most common punctuation: for these the whole word's
#: ids are the letters' (in lower case) and then the punctuation's.
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?]*)$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts without nulls, and each text's start, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def plain_texts(column: pa.Array) -> pa.Array:
    """A text column without nulls, copied only where it has any or is of another type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column if column.type == pa.string() else column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def release_memory() -> None:
    """Gives free memory back to the system: idle Python workers would keep what a task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (sizes[i] of them) of all i in a row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    found = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    found += np.arange(len(found), dtype=kind)
    return found


def cut_words(texts: pa.Array, blank: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words as numbers and distinct words, each word's first byte, each text's first byte, with the end).

    Words are what stands between the bytes that `blank` marks, and end with their text.
    """
    data, at = _bytes_of(texts)
    solid = ~blank[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    opens[firsts] = solid[firsts]
    begin = np.flatnonzero(opens)
    packed = data[solid]
    offsets = np.append(np.cumsum(solid, dtype=np.int32)[begin] - 1, np.int32(len(packed))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(packed))
    return words.dictionary_encode(), begin, at


class WordEncoder:
    """Encodes texts as uint32 ids.

    The vocabulary drops white space and never joins words across it, so a
    text's ids are its words' ids in order. A word is what stands between
    blanks, tabs and line ends; other white space stays inside and is left to
    the tokenizer. The words of many texts are cut and numbered as arrays, each
    distinct one is encoded once, and the ids are gathered by number.
    """

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.cache_entries, self.chunk_bytes = cache_entries, chunk_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for piece, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            ends[number] = piece.endswith("</w>")
        self.ends = ends

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _joined(self, stems: list[str]) -> list[bytes]:
        """Encodes lower-case letter runs together; each ends with an end-of-word piece."""
        joined = self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0]
        ids = np.asarray(joined.ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(stems):
            return self._each(stems)
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *ends], ends)]

    def _learned(self, words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        found = list(map(self.known.get, words))
        places = [i for i, x in enumerate(found) if x is None]
        if places:
            if len(self.known) > self.cache_entries:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            new = [words[i] for i in places]
            if older:
                for i, word in zip(places, new):
                    if (ids := older.get(word)) is not None:
                        found[i] = known[word] = ids
                places = [i for i in places if found[i] is None]
                new = [words[i] for i in places]
            for i, word, ids in zip(places, new, encode(new) if new else [], strict=True):
                found[i] = ids
                if len(word) <= LONGEST_CACHED:
                    known[word] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), sizes

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and the two ranges of it that are each distinct word's: [words, 2] starts and sizes."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        starts, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        pools, held = [], 0
        parts = parts.filter(pa.array(plain))
        tasks = [
            (pc.utf8_lower(pc.struct_field(parts, 0)), 0, plain, self._joined),
            (pc.struct_field(parts, 1), 1, plain, self._each),
            (words.filter(pa.array(~plain)), 0, ~plain, self._each),
        ]
        for column, side, rows, encode in tasks:
            numbered = column.dictionary_encode()
            pool, length = self._learned(numbered.dictionary.to_pylist(), encode)
            place = held + np.cumsum(length) - length
            code = numbered.indices.to_numpy()
            starts[rows, side], sizes[rows, side] = place[code], length[code]
            pools.append(pool)
            held += len(pool)
        return np.concatenate(pools), starts, sizes

    def encode_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's first place, with the end)."""
        words, begin, at = cut_words(texts, _BLANK)
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        pool, starts, sizes = self._distinct(words.dictionary)
        code = words.indices.to_numpy()
        ids = pool[_ranges(starts[code].ravel(), sizes[code].ravel())]
        ends = np.concatenate(([0], np.cumsum(sizes.sum(axis=1)[code])))
        return ids, ends[np.searchsorted(begin, at)]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian bytes; a null text has none."""
        texts = plain_texts(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + self.chunk_bytes, "right")) - 1)
            ids, places = self.encode_chunk(texts.slice(at, to - at))
            raw, places = ids.tobytes(), (4 * places).tolist()
            for x, y in zip(places, places[1:]):
                yield raw[x:y]
            at = to

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


@lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = CACHE_ENTRIES, chunk_bytes: int = CHUNK_BYTES) -> WordEncoder:
    """One encoder for each worker process, vocabulary and size."""
    return WordEncoder(path, cache_entries, chunk_bytes)
