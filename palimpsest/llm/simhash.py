"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most `RADIUS` of 64 bits agree, by the pigeonhole
principle, on k of k + RADIUS bit blocks; so each distinct fingerprint goes once
into a table for every choice of k blocks, keyed by their bits, and only rows of
equal key are compared. k follows from the number of distinct fingerprints, so
that a key holds few by chance; any k is exact. Within a key the fingerprints
are stored as bit planes, 64 of them to a word; carry-save counters update the
64 distances at once, plane by plane, and words whose 64 distances all exceed
the radius are abandoned.

Defined results: a null text has no words and the fingerprint zero; a text of any
length is read whole; equal
fingerprints, exact copies among them, are one node, so a group of copies costs
one comparison however large it is; a row with a null doc_id takes part, but is
never a component's smallest id; a component without any id has a null
component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.llm import shingles
from palimpsest.llm.common import WORD_REGEX, hash_blocks, saved
from palimpsest.llm.tokens import plain_texts, release_memory
from palimpsest.operators.components import connected_components
from palimpsest.operators.spread import join_large_keys, with_least

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Distinct fingerprints that share a key by chance, at most on average.
KEY_ROWS = 512
#: Larger groups of one key are dealt out in pairs of blocks of so many rows.
BLOCK_ROWS = 8192
#: Groups up to this size are compared together, larger ones by search from each member.
SMALL = 256
BITS = np.arange(64, dtype=np.uint64)
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a whole text; zero if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        first = (ends - sizes)[:n].tolist()
        last = (ends[shingle_words - 1 :] - 1).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """The fewest blocks for which `KEY_ROWS` or fewer of the fingerprints share a key by chance."""
    for k in range(1, 5):
        if distinct / 2.0 ** (64 * k // (k + radius)) <= KEY_ROWS:
            break
    return k + radius


def tables(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bit mask of each table: every choice of `blocks - radius` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 values: [64, words]; bit i of word w belongs to value 64 w + i."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(vertical: np.ndarray, word: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each j, which of the 64 values in word[j] of the planes are within `radius` of values[j].

    Returns the j that have any, and their 64 lanes as bits. Two planes at a
    time go into carry-save counters, as many as the radius has bits, and an
    overflow bit. Every eight planes the pairs whose lanes have all gone beyond
    the radius are abandoned.
    """
    if not 0 <= radius < 64:
        raise ValueError("the radius must be from 0 to 63")
    at = np.arange(len(word))
    over, *counters = (np.zeros(len(word), np.uint64) for _ in range(1 + max(1, radius.bit_length())))

    def beyond() -> np.ndarray:
        """Lanes whose count exceeds the radius: compared with it bit by bit from the top."""
        more, equal = over.copy(), ~np.zeros_like(over)
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                more |= equal & counters[i]
                equal &= ~counters[i]
        return more

    for plane in range(0, 64, 2):
        a = vertical[plane, word] ^ (np.uint64(0) - ((values >> np.uint64(plane)) & ONE))
        b = vertical[plane + 1, word] ^ (np.uint64(0) - ((values >> np.uint64(plane + 1)) & ONE))
        half = a ^ b
        carry = (a & b) | (counters[0] & half)
        counters[0] = counters[0] ^ half
        for i in range(1, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if plane % 8 == 6:
            live = beyond() != ~np.uint64(0)
            if not live.all():
                at, word, values, over, *counters = (x[live] for x in (at, word, values, over, *counters))
                if not len(at):
                    break
    return at, ~beyond() if len(at) else np.zeros(0, np.uint64)


def _lanes(at: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set bits: index into `at`'s values, and lane number."""
    hit = np.flatnonzero(lanes)
    bits = np.unpackbits(lanes[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return at[hit[row]], lane


def small_links(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Links (i, j), i > j, among consecutive small groups; row i's group is first[i] to last[i]."""
    vertical, found = planes(values), []
    low = first >> 6
    for step in range(int(((last - 1 >> 6) - low).max(initial=-1)) + 1):
        rows = np.flatnonzero((low + step << 6) < np.minimum(last, np.arange(len(values))))
        at, lanes = near(vertical, low[rows] + step, values[rows])
        i, lane = _lanes(at, lanes)
        i = rows[i]
        j = (low[i] + step << 6) + lane
        keep = (j < i) & (j >= first[i])
        found.append(np.stack([i[keep], j[keep]]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def spanning_links(
    values: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS, confirm: Callable[[int, np.ndarray], np.ndarray] | None = None
) -> np.ndarray:
    """Links that connect a large group as all its links would.

    Searches from each member, comparing it with those not yet reached; a
    member that is reached leaves the planes. With `side` (0 or 1 a row), only
    rows of different sides are compared. With `confirm`, of the members j within
    the radius of i only those are linked for which confirm(i, j) is true.
    """
    n = len(values)
    vertical, found, reached = planes(values), [], np.zeros(n, bool)
    open_lanes = ~planes_mask(n)
    order = range(n)
    sides = None if side is None else [_pack(side == 0), _pack(side == 1)]
    waiting: list[int] = []
    seeds = iter(order)
    while True:
        if waiting:
            i = waiting.pop()
        else:
            i = next((s for s in seeds if not reached[s]), None)
            if i is None:
                break
            reached[i] = True
            open_lanes[i >> 6] &= ~(ONE << np.uint64(i & 63))
        mask = open_lanes if sides is None else open_lanes & sides[1 - int(side[i])]
        word = np.flatnonzero(mask)
        if not len(word):
            continue
        at, lanes = near(vertical, word, np.full(len(word), values[i]), radius)
        lanes = lanes & mask[word[at]]
        k, lane = _lanes(at, lanes)
        j = (word[k] << 6) + lane
        if confirm is not None and len(j):
            j = j[confirm(i, j)]
        if len(j):
            reached[j] = True
            np.bitwise_and.at(open_lanes, j >> 6, ~(ONE << (j & 63).astype(np.uint64)))
            found.append(np.stack([np.full(len(j), i), j]))
            waiting.extend(j.tolist())
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _pack(flags: np.ndarray) -> np.ndarray:
    n = -(-len(flags) // 64) * 64
    padded = np.zeros(n, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def planes_mask(n: int) -> np.ndarray:
    """Bits of the lanes beyond the last of n values."""
    return ~_pack(np.ones(n, bool))


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of whole groups, given in order of their keys."""
    keys = frame[["mask", "key", "block_a", "block_b"]].to_numpy(np.int64)
    values = frame["fp"].to_numpy(np.int64).view(np.uint64)
    own = frame["block_own"].to_numpy(np.int64)
    change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(keys)]))
    size = ends - starts
    links = []
    small = (size <= SMALL) & (keys[starts, 2] == keys[starts, 3])
    chosen = np.repeat(small, size)
    if chosen.any():
        rows = np.flatnonzero(chosen)
        kept = size[small]
        last = np.repeat(np.cumsum(kept), kept)
        first = last - np.repeat(kept, kept)
        links.append(rows[small_links(values[rows], first, last)])
    for s, e in zip(starts[~small], ends[~small]):
        side = None if keys[s, 2] == keys[s, 3] else (own[s:e] == keys[s, 3]).astype(np.int64)
        links.append(spanning_links(values[s:e], side) + s)
    i, j = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    signed = values.view(np.int64)
    return pd.DataFrame({"a": signed[i], "b": signed[j]})


def _link_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feeds whole groups to `_linked`; a group may span Arrow batches."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        tail = batch.iloc[-1][["mask", "key", "block_a", "block_b"]]
        same = np.ones(len(batch), bool)
        for c in ("mask", "key", "block_a", "block_b"):
            same &= batch[c].to_numpy() == tail[c]
        cut = int(np.argmax(same))
        if cut:
            yield _linked(batch.iloc[:cut])
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield _linked(rest)


def links(distinct: DataFrame, count: int, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` as all links within the radius would."""
    if radius != RADIUS:
        raise ValueError("the group comparisons use RADIUS")
    masks = tables(blocks_for(count, radius), radius)
    signed = [int(np.uint64(m).astype(np.int64)) for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*(F.lit(m).cast("bigint") for m in signed))).alias("mask"))
    keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    dealt = hash_blocks(keyed, ["mask", "key"], "fp", block_rows)
    group = ["mask", "key", "block_a", "block_b"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInPandas(_link_groups, "a bigint, b bigint")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit integer."""
    return docs.select("doc_id", _fingerprints(F.col(text).cast("string")).alias("fp"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def components(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row doc_id, fp and component_id; see `report`."""
    found = saved(fingerprints(docs, text), "fingerprints")
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_rows")), "distinct")
    count, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    labels = connected_components(links(distinct.select("fp"), count, radius))
    placed = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = with_least(placed, "component", "low", "component_id").select("fp", "component_id", "n_rows")
    return join_large_keys(found, named, ["fp"], "n_rows", total, F.monotonically_increasing_id()).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint in hexadecimal and its component's smallest doc_id."""
    return components(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


# ---- one document of each group of similar texts ----

#: The least similarity of two texts' shingle sets, intersection by union, as a fraction.
SIMILAR = (4, 5)
#: Fingerprints of sets that similar differ in 9.7 of 64 bits on average, with a deviation
#: of 2.9; more than this with chance 1e-8.
SIMILAR_RADIUS = 26
#: Larger buckets of proposed texts are dealt out in pairs of blocks of so many rows.
SIMILAR_BLOCK_ROWS = 256
#: Ids of candidates or of dropped rows are broadcast up to so many, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_BUCKET = ["key", "block_a", "block_b"]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's band keys; a text without words has none."""
    for batch in batches:
        texts, row = plain_texts(batch.column("_text")), 0
        for part in shingles.chunks(texts):
            hashes, at = shingles.shingle_hashes(part)
            keys, some = shingles.band_keys(hashes, at), np.diff(at) > 0
            ends = np.concatenate(([0], np.cumsum(some * shingles.BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
            here = batch.slice(row, len(part))
            yield pa.RecordBatch.from_arrays([here.column("_row"), here.column("_h1"), here.column("_h2"), lists], ["row", "h1", "h2", "keys"])
            row += len(part)
    release_memory()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set of shingle hashes."""
    for batch in batches:
        texts, row = plain_texts(batch.column("_text")), 0
        for part in shingles.chunks(texts):
            hashes, at = shingles.sets_of(*shingles.shingle_hashes(part))
            raw, cuts = hashes.tobytes(), (8 * at).tolist()
            found = pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row").slice(row, len(part)), found], ["node", "hashes"])
            row += len(part)
    release_memory()


def set_fingerprints(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of sets of hashes, given in a row: a bit is 1 if set in over half of them. No set is empty."""
    out, ends = np.zeros(len(size), np.uint64), np.cumsum(size)
    for s, e in _runs(size):
        part = flat[ends[s] - size[s] : ends[e - 1]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, ends[s:e] - size[s:e] - (ends[s] - size[s]), axis=0, dtype=np.int64)
        out[s:e] = np.packbits(2 * counts > size[s:e, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _runs(size: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Consecutive sets, together of about `most` hashes or one set."""
    ends, s = np.cumsum(size), 0
    while s < len(size):
        e = max(s + 1, int(np.searchsorted(ends, ends[s] - size[s] + most, "right")))
        yield s, e
        s = e


def similar_links(sets: list[np.ndarray], side: np.ndarray | None = None, prints: np.ndarray | None = None) -> np.ndarray:
    """Links of the similar sets of a bucket; with `side` (0 or 1 a row), only of rows of different sides.

    The fingerprints' bit-sliced comparison leaves few pairs, and those are
    confirmed by the exact similarity of their sets.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    top, bottom = SIMILAR
    if prints is None:
        prints = set_fingerprints(np.concatenate(sets), size)

    def confirm(i: int, j: np.ndarray) -> np.ndarray:
        alike = bottom * np.minimum(size[j], size[i]) >= top * np.maximum(size[j], size[i])
        if not alike.any():
            return alike
        some = j[alike]
        flat = np.concatenate([sets[x] for x in some])
        at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
        common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(size[some]) - size[some])
        alike[alike] = bottom * common >= top * (size[i] + size[some] - common)
        return alike

    return spanning_links(prints, side, SIMILAR_RADIUS, confirm)


def _similar_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds whole buckets to `similar_links`; a bucket may span Arrow batches."""

    def linked(frame: pa.RecordBatch, keys: np.ndarray) -> pa.RecordBatch:
        own, nodes, column = frame.column("block_own").to_numpy(), frame.column("node").to_numpy(), frame.column("hashes")
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
        flat = np.frombuffer(column.buffers()[2], np.uint64, at[-1] - at[0], 8 * at[0])
        at -= at[0]
        prints = set_fingerprints(flat, np.diff(at))
        change = (np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist()
        found = [np.zeros((2, 0), np.int64)]
        for s, e in zip([0, *change], [*change, len(keys)]):
            if e - s > 1:
                side = None if keys[s, 1] == keys[s, 2] else (own[s:e] == keys[s, 2]).astype(np.int64)
                found.append(similar_links([flat[at[i] : at[i + 1]] for i in range(s, e)], side, prints[s:e]) + s)
        i, j = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["a", "b"])

    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _BUCKET], axis=1)
        cut = int(np.argmax((keys == keys[-1]).all(axis=1)))
        if cut:
            yield linked(batch.slice(0, cut), keys[:cut])
        rest = batch.slice(cut)
    if rest is not None:
        yield linked(rest, np.stack([rest.column(c).to_numpy().astype(np.int64) for c in _BUCKET], axis=1))
    release_memory()


def _listed(ids: DataFrame, count: int) -> DataFrame:
    return F.broadcast(ids) if count <= BROADCAST_ROWS else ids


def drop_near_duplicates(docs: DataFrame, text: str = "text", block_rows: int = SIMILAR_BLOCK_ROWS) -> DataFrame:
    """One document of each group of near duplicates: texts of five-word shingle sets with a similarity of 0.8 or more.

    Fingerprints of such texts differ in far more bits than tables of agreeing bits
    can propose, so MinHash bands propose buckets of texts; in a bucket the
    fingerprints are compared bit-sliced, and the exact similarity confirms.

    Only ids, hashes and keys are shuffled, but for the sets of texts that share a
    bucket, and the rows themselves once if very many go. Of each group the row with
    the smallest doc_id stays, one with a null doc_id only if the group has no other,
    of equal ids one chosen by a hash of its contents. Groups are made of rows, not of
    ids. A null text has no words, and texts without words are copies of each other;
    ASCII case and the kind of blanks don't count.
    """
    columns = docs.columns
    row, h1, h2, body = "_row", "_h1", "_h2", "_text"
    value = F.struct(*(F.col(c) for c in columns))
    rows = saved(docs.select(F.monotonically_increasing_id().alias(row), value.alias("doc")), "rows")
    field = F.col("doc").getField(text).cast("string")
    words = F.coalesce(field.rlike(WORD_REGEX), F.lit(False))
    wide = [F.when(words, F.xxhash64(F.lit(n), field)).otherwise(F.lit(0).cast("bigint")).alias(h) for n, h in ((1, h1), (2, h2))]
    doc_id = F.col("doc").getField("doc_id")
    others = F.xxhash64(*(F.col("doc").getField(c).cast("string") for c in columns))
    narrow = rows.select(row, *wide, field.alias(body)).mapInArrow(_keyed, "row bigint, h1 bigint, h2 bigint, keys array<bigint>")
    narrow = saved(narrow, "keys")
    order = rows.select(F.col(row).alias("row"), F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), others.alias("rest"), F.col(row).alias("row")).alias("place"))
    # Exact copies first: one node for each text, named after its least row.
    listed = narrow.join(order, "row")
    unique = saved(listed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.any_value("keys").alias("keys")).withColumn("node", F.col("place.row")), "unique")
    found = similar_texts(unique.select("node", "keys"), rows.select(row, field.alias(body)), block_rows)
    labels = connected_components(found)
    placed = unique.select("node", "place").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stays = with_least(placed, "component", "place", "best").where("place = best").select(F.col("node").alias(row))
    gone = saved(rows.select(row).join(stays, row, "left_anti"), "gone")
    return rows.join(_listed(gone, gone.count()), row, "left_anti").select(*(F.col("doc").getField(c).alias(c) for c in columns))


def similar_texts(unique: DataFrame, texts: DataFrame, block_rows: int = SIMILAR_BLOCK_ROWS) -> DataFrame:
    """Links (a, b) of near duplicates among the distinct texts (node, keys), whose text `texts` (_row, _text) holds."""
    keyed = unique.select("node", F.explode("keys").alias("key"))
    tests = (F.bit_xor(F.xxhash64(F.lit(n), F.col("node"))).alias(f"x{n}") for n in (1, 2))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *tests).where("n > 1")
    # Buckets of the same members count once.
    once = saved(buckets.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    members = saved(keyed.join(once.select("key"), "key"), "members")
    wanted = saved(members.select(F.col("node").alias("_row")).distinct(), "wanted")
    sets = texts.join(_listed(wanted, wanted.count()), "_row", "left_semi").mapInArrow(_hashed, "node bigint, hashes binary")
    dealt = hash_blocks(members, ["key"], "node", block_rows).join(saved(sets, "sets"), "node")
    dealt = dealt.select(*_BUCKET, "block_own", "node", "hashes").repartition(*_BUCKET).sortWithinPartitions(*_BUCKET)
    return dealt.mapInArrow(_similar_groups, "a bigint, b bigint")
