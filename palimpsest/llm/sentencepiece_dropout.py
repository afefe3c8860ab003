"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The merges are those of a public merge-type model: of all neighbouring symbols
that join to a piece, the best-scored pair, then the leftmost, is next on the
agenda. With dropout a keyed hash decides for each candidate (seed, document,
word number, place, piece) whether it is skipped for good. So every occurrence
of a word draws afresh, and the same document always gets the same ids.

Words are cut and numbered as arrays. What a word comes to under a set of
skipped candidates is a state: its ids, and the candidates met on the way. An
occurrence starts at its word's state without skips, draws for the candidates
there, and goes on to the state of what it skipped, until it skips nothing new;
that is the agenda's result for its own draws. States are kept while there is
room, so only sets of skips not seen lately are worked out, many together, one
merge a round, as numpy arrays. Words that are long or have many candidates keep
no states; very long ones use a heap, in n log n.

Pieces hold the blank mark only at their start, so texts are cut into words
before it. Blanks become the mark, one mark goes before a text, and whatever
has no piece, the mark itself included, is written as bytes; so decoding
gives back every text exactly.

Defined results: a null text counts as empty and gives no ids; a null doc_id
counts as its own key; repeated rows get equal ids; ties of score go to the
leftmost pair, of pieces to the smaller id; texts of any length are encoded whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.tokens import _bytes_of, _ranges, plain_texts, vocabulary_path

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 11
#: Kept states of a worker; when there are more, all are forgotten.
STATES = 400_000
#: Longer words, and words with more candidates than bits, keep no states.
LONGEST_KEPT = 48
MOST_CANDIDATES = 62
#: So do words that come up less often in a chunk.
KEPT_FROM = 4
#: Longer words use a heap.
LONGEST_ROUNDS = 256
#: Texts are encoded together up to so many bytes; a longer text goes alone.
CHUNK_BYTES = 4 << 20
#: Draws of so many occurrences are made together.
BLOCK_WORDS = 1 << 17
#: Words are worked out together up to so many characters.
BATCH_CHARS = 1 << 19
MARK = "▁"
_SLOTS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A candidate's code: the place in its word above the piece's bits.
_PIECE_BITS = 15
#: A code of a word of at most `LONGEST_KEPT` characters has so many bits.
_CODE_BITS = 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(doc_id: object, n: int, seed: int = SEED) -> np.ndarray:
    """The keys of a document's first n words."""
    return _mixed(np.arange(n, dtype=np.uint64) * _MIX + _document_key(doc_id, seed))


def _document_key(doc_id: object, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(str(doc_id).encode(), seed))


def candidate_hash(code: np.ndarray) -> np.ndarray:
    """The hash of candidates that a word's key is mixed with; `code` is place and piece."""
    place, piece = code >> _PIECE_BITS, code & ((1 << _PIECE_BITS) - 1)
    return _mixed((place.astype(np.uint64) << np.uint64(20)) ^ piece.astype(np.uint64) * _MIX)


def skipped(keys: np.ndarray, hashes: np.ndarray, dropout: float) -> np.ndarray:
    """Whether each key's draw skips the candidate."""
    if dropout >= 1:
        return np.ones(len(hashes), bool)
    return _mixed((keys ^ hashes) + _MIX) < np.uint64(int(dropout * 2.0**64))


class _Pool:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.zeros(max(end, self.size), self.data.dtype)))
        self.data[self.size : end] = values
        self.size = end


class _States:
    """What words come to under sets of skipped candidates, as growing arrays.

    A state is reached from its parent by skipping those of the parent's
    candidates that `mask` names; a word's first state has no parent. Its own
    candidates are those met that no earlier state of its path has drawn for.
    """

    def __init__(self) -> None:
        self.first: dict[str, int] = {}
        self.next: dict[tuple[int, int], int] = {}
        self.word: list[str] = []
        self.parent, self.mask = _Pool(np.int64), _Pool(np.int64)
        self.ids, self.start, self.size = _Pool(np.int32), _Pool(np.int64), _Pool(np.int64)
        self.codes, self.hashes = _Pool(np.int64), _Pool(np.uint64)
        self.at, self.count = _Pool(np.int64), _Pool(np.int64)

    def add(self, words: list[str], parent: np.ndarray, mask: np.ndarray, ids: np.ndarray, size: np.ndarray, codes: np.ndarray, count: np.ndarray) -> int:
        """Appends states; returns the first one's number."""
        first = len(self.word)
        self.word += words
        self.parent.extend(parent)
        self.mask.extend(mask)
        self.start.extend(self.ids.size + np.cumsum(size) - size)
        self.size.extend(size)
        self.ids.extend(ids)
        self.at.extend(self.codes.size + np.cumsum(count) - count)
        self.count.extend(count)
        self.codes.extend(codes)
        self.hashes.extend(candidate_hash(codes))
        return first

    def path(self, parent: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(drawn, skipped) candidates of the paths that end with skipping `mask` of `parent`.

        Both are sorted, each candidate with the path's number above its code.
        """
        drawn, gone = [], []
        path = np.arange(len(parent))
        while len(path):
            n = self.count.data[parent]
            own = np.repeat(np.arange(len(path)), n)
            at = _ranges(self.at.data[parent], n) if len(path) else np.zeros(0, np.int64)
            item = (path[own] << _CODE_BITS) | self.codes.data[at]
            bit = at - self.at.data[parent][own]
            drawn.append(item)
            gone.append(item[(mask[own] >> bit) & 1 == 1])
            parent, mask = self.parent.data[parent], self.mask.data[parent]
            on = parent >= 0
            path, parent, mask = path[on], parent[on], mask[on]
        return np.sort(np.concatenate(drawn)), np.sort(np.concatenate(gone))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


class MergeEncoder:
    """Encodes words of a merge-type model in batches."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << _PIECE_BITS:
            raise ValueError(f"the model has {n} pieces, more than {1 << _PIECE_BITS}")
        usual = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        pieces = [model.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if usual[i]}
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        #: All pieces' bytes in a row, for decoding.
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, n)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        # Rank 0 is the best score; pieces of equal score rank by id.
        scores = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.empty(n, np.int64)
        self.rank[np.lexsort((np.arange(n), -scores))] = np.arange(n)
        self.by_rank = np.argsort(self.rank).astype(np.int32)
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = i
        self._table(pairs)
        self.states: dict[float, _States] = {}

    def _table(self, pairs: dict[int, int]) -> None:
        """An open-addressed table of pairs; `probes` is the longest search."""
        self.slot_keys = np.full(_SLOTS + 64, -1, np.int64)
        self.slot_ids = np.full(_SLOTS + 64, -1, np.int32)
        self.probes = 0
        homes = self._home(np.fromiter(pairs, np.int64, len(pairs)))
        for home, (key, piece) in zip(homes.tolist(), pairs.items()):
            at = home
            while self.slot_keys[at] >= 0:
                at += 1
            self.slot_keys[at], self.slot_ids[at] = key, piece
            self.probes = max(self.probes, at - home + 1)

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair joins to, or -1."""
        keys = (a.astype(np.int64) << 20) | b
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._home(keys[open_])
        for _ in range(self.probes):
            found = self.slot_keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_ids[at[hit]]
            on = ~hit & (found >= 0)
            open_, at = open_[on], at[on] + 1
            if not len(open_):
                break
        return out

    def rounds(self, words: list[str], skips=None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each), one merge of each word a round.

        `skips(owner, code)` tells which candidates are skipped; all that come
        up are added to `met` as (owner, code).
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        size = _sizes(words)
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(words)), size)
        symbol = self._symbols(codes)
        n = len(codes)
        offset = np.arange(n) - np.repeat(ends - size, size)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1] = -1
        left[ends - size] = -1
        big = np.int64(1) << 62

        def agenda(at: np.ndarray) -> np.ndarray:
            """Rank and place of the merge of each symbol with its right one; `big` for none."""
            value = np.full(len(at), big)
            some = np.flatnonzero(right[at] >= 0)
            i = at[some]
            piece = self.joined(symbol[i], symbol[right[i]])
            good = piece >= 0
            i, some, piece = i[good], some[good], piece[good]
            code = (offset[i] << _PIECE_BITS) | piece
            if met is not None:
                met.append((owner[i], code))
            if skips is not None:
                stay = ~skips(owner[i], code)
                i, some, piece = i[stay], some[stay], piece[stay]
            value[some] = (self.rank[piece] << 32) | offset[i]
            return value

        value = agenda(np.arange(n))
        alive = np.arange(n)
        while len(alive):
            # One merge a word: the least value of its symbols.
            own = owner[alive]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.minimum.reduceat(value[alive], start)
            on = best < big
            if not on.all():
                alive = alive[np.repeat(on, np.diff(start, append=len(alive)))]
                start, best = start[on], best[on]
                if not len(alive):
                    break
                own = owner[alive]
                start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            word = own[start]
            i = (ends - size)[word] + (best & np.int64(0xFFFFFFFF))
            symbol[i] = self.by_rank[best >> 32]
            gone = right[i]
            right[i] = right[gone]
            after = right[i]
            left[after[after >= 0]] = i[after >= 0]
            symbol[gone], value[gone], right[gone] = -2, big, -1
            before = left[i]
            both = np.concatenate((i, before[before >= 0]))
            value[both] = agenda(both)
            alive = alive[symbol[alive] != -2]
        out, times = self._spelled(symbol, codes)
        return out, np.bincount(owner, times, len(words)).astype(np.int64)

    def heap(self, word: str, key: np.uint64, dropout: float) -> np.ndarray:
        """Ids of one word, however long, by a heap of candidates."""
        codes = np.frombuffer(word.encode("utf-32-le"), "<u4")
        symbols = self._symbols(codes)
        n = len(codes)
        limit = (1 << 64) if dropout >= 1 else int(dropout * 2.0**64)
        whole, mix, word_key = (1 << 64) - 1, int(_MIX), int(key)

        def mixed(x: int) -> int:
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
            return x ^ (x >> 31)

        def candidate(at: int, after: int) -> int:
            """Rank and place of the merge, or -1."""
            a, b = symbol[at], symbol[after]
            if a < 0 or b < 0:
                return -1
            pair = (a << 20) | b
            slot = ((pair * mix) & whole) >> 44
            while (found := slot_keys[slot]) != pair:
                if found < 0:
                    return -1
                slot += 1
            piece = int(slot_ids[slot])
            if limit and mixed(((word_key ^ mixed((at << 20) ^ ((piece * mix) & whole))) + mix) & whole) < limit:
                return -1
            return (int(rank[piece]) << 32) | at

        slot_keys, slot_ids, rank = self.slot_keys, self.slot_ids, self.rank
        value = np.full(n, -1, np.int64)
        piece = self.joined(symbols[:-1], symbols[1:])
        at = np.flatnonzero(piece >= 0)
        if dropout > 0:
            hashes = candidate_hash((at << _PIECE_BITS) | piece[at])
            at = at[~skipped(np.full(len(at), key), hashes, dropout)]
        value[at] = (self.rank[piece[at]] << 32) | at
        waiting = value[at].tolist()
        heapq.heapify(waiting)
        value, symbol = value.tolist(), symbols.tolist()
        right, left = list(range(1, n)) + [-1], list(range(-1, n - 1))
        while waiting:
            best = heapq.heappop(waiting)
            i = best & 0xFFFFFFFF
            if value[i] != best:
                continue
            symbol[i] = int(self.by_rank[best >> 32])
            gone = right[i]
            after = right[i] = right[gone]
            if after >= 0:
                left[after] = i
            symbol[gone], value[gone] = -2, -1
            before = left[i]
            for x, y in ((i, after), (before, i)):
                if x >= 0 and y >= 0:
                    value[x] = candidate(x, y)
                    if value[x] >= 0:
                        heapq.heappush(waiting, value[x])
                elif x >= 0:
                    value[x] = -1
        return self._spelled(np.array(symbol, np.int32), codes)[0]

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        """Each character's piece, or -1. A literal mark has no piece of its own; a blank has the mark's."""
        return np.where(codes == ord(MARK), -1, self.chars[np.where(codes == 32, ord(MARK), codes)])

    def _spelled(self, symbol: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each place): -2 has none, and -1 its character's bytes."""
        times = (symbol != -2).astype(np.int64)
        lost = np.flatnonzero(symbol == -1)
        if not len(lost):
            return symbol[symbol != -2], times
        spelled = [chr(c).encode() for c in codes[lost].tolist()]
        times[lost] = [len(x) for x in spelled]
        out = np.repeat(symbol, times)
        out[np.repeat(symbol == -1, times)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, times

    def drawn(self, words: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each), each by its own key and without states."""
        size = _sizes(words)
        long = np.flatnonzero(size > LONGEST_ROUNDS).tolist()
        found, sizes, done = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64), 0
        for stop in [*long, len(words)]:
            for part in _parts(size[done:stop]):
                at = slice(done + part.start, done + part.stop)
                own, skips = keys[at], None
                if dropout > 0:
                    skips = lambda owner, code: skipped(own[owner], candidate_hash(code), dropout)  # noqa: B023, E731
                ids, sizes[at] = self.rounds(words[at], skips)
                found.append(ids)
            if stop < len(words):
                found.append(self.heap(words[stop], keys[stop], dropout))
                sizes[stop] = len(found[-1])
            done = stop + 1
        return np.concatenate(found), sizes

    def words(self, words: list[str], keys: np.ndarray, dropout: float) -> list[bytes]:
        """Ids of each word by its own key, without states, as little-endian int32."""
        ids, size = self.drawn(words, keys, dropout)
        raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(size)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _new(self, states: _States, words: list[str], parent: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Numbers of new states, -1 for one with too many candidates."""
        numbers = np.full(len(words), -1, np.int64)
        for part in _parts(_sizes(words)):
            some, met = words[part], []
            first = parent[part.start] < 0
            drawn, gone = (np.zeros(0, np.int64),) * 2 if first else states.path(parent[part], mask[part])
            skips = None if first else lambda owner, code: _among((owner << _CODE_BITS) | code, gone)  # noqa: B023, E731
            ids, size = self.rounds(some, skips, met)
            item = np.sort(np.concatenate([(o << _CODE_BITS) | c for o, c in met]))
            new = ~_among(item, drawn)
            new[1:] &= item[1:] != item[:-1]
            item = item[new]
            count = np.bincount(item >> _CODE_BITS, minlength=len(some))
            good = count <= MOST_CANDIDATES
            item = item[good[item >> _CODE_BITS]] & ((1 << _CODE_BITS) - 1)
            start = states.add(
                [w for w, g in zip(some, good.tolist()) if g], parent[part][good], mask[part][good],
                ids[np.repeat(good, size)], size[good], item, count[good],
            )
            numbers[part] = np.where(good, start + np.cumsum(good) - 1, -1)
        return numbers

    def _draw(self, states: _States, state: np.ndarray, keys: np.ndarray, dropout: float) -> None:
        """Moves each occurrence on from its word's first state, in place; -1 where states end."""
        active = np.flatnonzero(state >= 0)
        while len(active):
            here = state[active]
            n = states.count.data[here]
            own = np.repeat(np.arange(len(active)), n)
            if not len(own):
                return
            at = _ranges(states.at.data[here], n)
            hit = np.flatnonzero(skipped(keys[active][own], states.hashes.data[at], dropout))
            if not len(hit):
                return
            own, bit = own[hit], at[hit] - states.at.data[here][own[hit]]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            mask = np.bitwise_or.reduceat(np.int64(1) << bit, start)
            active, here = active[own[start]], here[own[start]]
            order = np.lexsort((mask, here))
            new = np.concatenate(([True], (here[order][1:] != here[order][:-1]) | (mask[order][1:] != mask[order][:-1])))
            parents, masks = here[order][new], mask[order][new]
            steps = list(zip(parents.tolist(), masks.tolist()))
            found = list(map(states.next.get, steps))
            missing = np.array([i for i, x in enumerate(found) if x is None], np.int64)
            numbers = np.array([-1 if x is None else x for x in found], np.int64)
            if len(missing):
                words = [states.word[p] for p in parents[missing].tolist()]
                numbers[missing] = self._new(states, words, parents[missing], masks[missing])
                states.next.update(zip((steps[i] for i in missing.tolist()), numbers[missing].tolist()))
            state[active[order]] = numbers[np.cumsum(new) - 1]
            active = active[state[active] >= 0]

    def encode_chunk(self, doc_ids: list, texts: pa.Array, seed: int = SEED, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text's first place, with the end); texts without nulls."""
        data, at = _bytes_of(texts)
        size = np.diff(at)
        some = (size > 0).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(size + some)))
        # One blank before each text that isn't empty.
        led = np.full(starts[-1], 32, np.uint8)
        is_text = np.ones(len(led), bool)
        is_text[starts[:-1][some > 0]] = False
        led[is_text] = data
        blank = led == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[starts[:-1][some > 0]] = True
        begin = np.flatnonzero(opens)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        offsets = np.append(begin, len(led)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(led)).dictionary_encode()
        code = words.indices.to_numpy()
        first = np.searchsorted(begin, starts)
        count = np.diff(first)
        base = np.fromiter((_document_key(x, seed) for x in doc_ids), np.uint64, len(doc_ids))
        number = np.arange(len(begin)) - np.repeat(first[:-1], count)
        keys = _mixed(number.astype(np.uint64) * _MIX + np.repeat(base, count))

        states = self.states.get(dropout)
        if states is None or len(states.word) > STATES:
            # States are the same for every dropout, but a run has one.
            self.states = {dropout: (states := _States())}
        distinct = words.dictionary.to_pylist()
        # A new word that comes up but once or twice here is worked out with its own draws at once.
        often = (np.bincount(code, minlength=len(distinct)) >= (KEPT_FROM if dropout > 0 else 1)).tolist()
        found = list(map(states.first.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None and often[i] and len(distinct[i]) <= LONGEST_KEPT]
        found = [-1 if x is None else x for x in found]
        if missing:
            new = [distinct[i] for i in missing]
            none = np.full(len(new), -1, np.int64)
            numbers = self._new(states, new, none, np.zeros(len(new), np.int64)).tolist()
            states.first.update(zip(new, numbers))
            for i, x in zip(missing, numbers):
                found[i] = x
        state = np.array(found, np.int64)[code]
        if dropout > 0:
            for i in range(0, len(state), BLOCK_WORDS):
                self._draw(states, state[i : i + BLOCK_WORDS], keys[i : i + BLOCK_WORDS], dropout)
        alone = np.flatnonzero(state < 0)
        start, size = states.start.data[state], states.size.data[state]
        kept = states.ids.size
        if len(alone):
            # Their ids stand behind the states' for this chunk only.
            lone, lengths = self.drawn([distinct[c] for c in code[alone].tolist()], keys[alone], dropout)
            size[alone] = lengths
            start[alone] = kept + np.cumsum(lengths) - lengths
            states.ids.extend(lone)
        ids = states.ids.data[_ranges(start, size)]
        states.ids.size = kept
        return ids, np.concatenate(([0], np.cumsum(size)))[first]

    def encode_batch(self, ids: list, texts: list[str], seed: int = SEED, dropout: float = DROPOUT) -> list[np.ndarray]:
        """Ids of whole texts; `ids` and the words' numbers key the draws."""
        found, at = self.encode_chunk(ids, pa.array(texts, pa.string()), seed, dropout)
        return np.split(found, at[1:-1]) if len(texts) else []

    def decode_chunk(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in a row, each text's first place, with the end)."""
        size = self.raw_size[ids]
        data = self.raw[_ranges(self.raw_start[ids], size)] if len(ids) else np.zeros(0, np.uint8)
        place = np.concatenate(([0], np.cumsum(size)))[at]
        # The blank that went before each text goes again.
        stay = np.ones(len(data), bool)
        some = np.diff(place) > 0
        stay[place[:-1][some]] = False
        return data[stay], place - np.concatenate(([0], np.cumsum(some)))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_chunk(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode()


def _parts(size: np.ndarray) -> Iterator[slice]:
    """Consecutive words of these sizes, together of at most `BATCH_CHARS` characters or one word."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, "right")))
        yield slice(at, to)
        at = to


def _sizes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


@lru_cache(maxsize=2)
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) of consecutive rows, together of about `CHUNK_BYTES` bytes or one row; null texts are empty."""
    texts = plain_texts(batch.column("text"))
    _, at = _bytes_of(texts)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
        yield batch.column("doc_id").slice(row, to - row), texts.slice(row, to - row)
        row = to


def encode(docs: DataFrame, model: str, text: str = "text", seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """(doc_id, ids) of every text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoder(model)
        for batch in batches:
            for doc_id, texts in _chunks(batch):
                ids, at = merge.encode_chunk(doc_id.to_pylist(), texts, seed, dropout)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_id, lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    done = rows.mapInArrow(encoded, "doc_id string, ids array<int>")
    return done.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of encoded rows."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoder(model)
        for batch in batches:
            lists = batch.column("ids")
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            data, place = merge.decode_chunk(lists.flatten().to_numpy(zero_copy_only=False), at.astype(np.int64))
            raw = data.tobytes()
            cuts = place.tolist()
            texts = pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, text string")


def report(docs: DataFrame, model: str | None = None, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """Per document the ids with dropout and their decoding, as digests.

    lossless tells whether decoding the ids gives the text.
    """
    model = model or vocabulary_path(MODEL)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = encoder(model)
        for batch in batches:
            for doc_id, texts in _chunks(batch):
                ids, at = merge.encode_chunk(doc_id.to_pylist(), texts, seed, dropout)
                raw, cuts = memoryview(ids.tobytes()), (4 * at).tolist()
                data, place = merge.decode_chunk(ids, at)
                text, begin = _bytes_of(texts)
                data, text, place, begin = memoryview(data.tobytes()), memoryview(text.tobytes()), place.tolist(), begin.tolist()
                same = [data[a:b] == text[c:d] for a, b, c, d in zip(place, place[1:], begin, begin[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id, pa.array(np.diff(at), pa.int64()),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()), pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "lossless"],
                )

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(digest, "doc_id string, n_pieces bigint, ids_crc32 bigint, lossless boolean")
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
