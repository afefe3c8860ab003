"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors: of its words, of their character
n-grams, and of the pairs in which a word repeats its left neighbour, all hashed
into one table. A softmax layer gives the class. Both are trained on the driver
by numpy stochastic gradient descent on a bounded sample of labelled texts.

As the class depends on the average linearly, a trained model reduces to one
number per hash bucket (the difference of the two classes' logits), and a text's
score to a sigmoid of their average; that is what the executors get.

Defined results: a null or empty text has no features and scores by the bias
alone; a text of any length is read whole; labels other than 0 and 1, and labels of
a null doc_id, are ignored; several labels of one doc_id count as the lowest, and
of several texts of one doc_id the least trains; without any label of either class
every text scores the smoothed share of good labels; repeated rows score alike; an
empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.common import BLANKS, fresh, saved, text_or_empty
from palimpsest.llm.tokens import _bytes_of, _ranges, cut_words, plain_texts, release_memory

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (3, 4)
#: At most so many labelled texts train the model, and together at most so many bytes of features.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.7
#: A repeated word weighs like so many n-grams, of which a text has many more.
REPEAT_WEIGHT = 10
#: Texts are scored together up to so many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 20
#: N-grams are hashed in blocks of so many characters.
BLOCK_CHARS = 1 << 17
#: Scores are sums of margins as multiples of this, so they don't depend on any order.
UNIT = 2.0**-24
_BLANK = np.isin(np.arange(256), [ord(c) for c in BLANKS])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(words: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, bucket) of each word and of its character n-grams, block by block.

    A word stands between two marks, which its n-grams may hold. `words` has no
    nulls and no empty word.
    """
    data, at = _bytes_of(words)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    places = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    size = np.diff(places) + 2
    ends = np.cumsum(size)
    if not len(size):
        return
    chars = np.full(ends[-1], ord("<"), np.uint32)
    chars[ends - 1] = ord(">")
    chars[_ranges(ends - size + 1, size - 2)] = codes
    whole = np.zeros(len(size), np.uint64)
    bound = np.uint64(buckets)
    for s in range(0, len(chars), BLOCK_CHARS):
        e = min(s + BLOCK_CHARS, len(chars))
        first, last = np.searchsorted(ends, [s, e - 1], "right")
        here = np.arange(first, last + 1)
        inside = np.minimum(ends[here], e) - np.maximum((ends - size)[here], s)
        owner = np.repeat(here, inside)
        left = ends[owner] - np.arange(s, e)
        term = _mixed(chars[s:e] + (size[owner] - left).astype(np.uint64) * _MIX)
        whole[here] += np.add.reduceat(term, np.cumsum(inside) - inside)
        gram = np.zeros(e - s, np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            fits = np.flatnonzero(left >= n)
            gram[fits] = gram[fits] * _MIX + chars[s + fits + n - 1]
            if n in NGRAMS:
                yield owner[fits], (_mixed(gram[fits] + np.uint64(n)) % bound).astype(np.int32)
    yield np.arange(len(size)), (_mixed(whole) % bound).astype(np.int32)


def repeat_bucket(buckets: int = BUCKETS) -> int:
    """The bucket of a word that repeats its left neighbour."""
    return int(_mixed(np.full(1, len(NGRAMS), np.uint64))[0] % np.uint64(buckets))


def _repeats(words: pa.DictionaryArray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words of each text equal the word before, as a running total with the end."""
    code = words.indices.to_numpy()
    same = np.zeros(len(code), np.int64)
    same[1:] = code[1:] == code[:-1]
    first = np.searchsorted(begin, at)
    same[first[first < len(same)]] = 0
    return np.concatenate(([0], np.cumsum(same)))[first]


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words, begin, at = cut_words(pa.array([text or ""], pa.string()), _BLANK)
    total = np.zeros(buckets)
    if len(begin):
        times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        for owner, found in hashed_words(words.dictionary, buckets):
            total += np.bincount(found, times[owner], buckets)
        total[repeat_bucket(buckets)] += REPEAT_WEIGHT * _repeats(words, begin, at)[1]
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Difference of the classes' logits for each bucket, and the bias."""

    margins: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray, counts: np.ndarray) -> float:
        total = counts.sum()
        z = self.bias + (float(self.margins[buckets] @ counts) / float(total) if total else 0.0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS,
    epochs: int = 8, rate: float = 0.5, seed: int = 3,
) -> QualityModel:
    """Seeded SGD over (buckets, counts, label) rows."""
    good = sum(label for _, _, label in rows)
    prior = float(np.log((good + 1) / (len(rows) - good + 1)))
    if not 0 < good < len(rows):
        return QualityModel(np.zeros(buckets), prior)
    dice = np.random.default_rng(seed)
    table = (dice.uniform(-1, 1, (buckets, dimensions)) / dimensions).astype(np.float32)
    output, bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)
    shares = [(b, (c / c.sum()).astype(np.float32), y) for b, c, y in rows if len(b)]
    # Classes weigh alike, or the rarer one would be learned last.
    weights = (len(rows) / (2 * (len(rows) - good)), len(rows) / (2 * good))
    steps, done = epochs * len(shares), 0
    for _ in range(epochs):
        for i in dice.permutation(len(shares)):
            found, share, label = shares[i]
            pace = rate * (1 - done / steps) * min(weights[label], 4.0)
            hidden = share @ table[found]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = pace * (output.T @ p)
            output -= pace * np.outer(p, hidden)
            bias -= np.float32(0.1 * pace) * p
            # As each row of the table holds a small share, the step is scaled to the text's own.
            table[found] -= (share / np.sqrt((share * share).sum()))[:, None] * step
            done += 1
    difference = output[1] - output[0]
    return QualityModel((table @ difference).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, sample_bytes: int = SAMPLE_BYTES
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of labelled texts that aren't held out: the first by a hash of doc_id, within both bounds.

    The ids are chosen from the labels alone; the chosen ids are bounded by
    `sample_rows`, so they may be broadcast. Each id counts once, with its least
    text. Whole texts are hashed on the executors and their features written, at
    most `buckets` counts a text; the driver reads the sizes first, and then only
    the rows that fit `sample_bytes`.
    """
    labelled = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    labelled = labelled.where(~held_out()).select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"))
    total = labelled.count()
    order = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1_000_003))
    if total > 2 * sample_rows:
        # So that sorting for the first rows sees little more than these.
        labelled = labelled.where(order < int(1_000_003 * 1.5 * sample_rows / total))
    chosen = F.broadcast(labelled.select("id", "y", order.alias("place")).orderBy("place", "id").limit(sample_rows))
    rows = docs.select("doc_id", F.col(text).cast("string").alias("t")).join(chosen, F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("place", "id", "y").agg(F.min("t").alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                b, c = features(row.column("t")[0].as_py(), buckets)
                found = [row.column("place"), row.column("id"), row.column("y"), pa.array([8 * len(b)], pa.int64()), pa.array([b.astype("<i4").tobytes()]), pa.array([c.astype("<f4").tobytes()])]
                yield pa.RecordBatch.from_arrays(found, ["place", "id", "y", "size", "b", "c"])

    kind = rows.schema["id"].dataType.simpleString()
    found = saved(rows.mapInArrow(hashed, f"place bigint, id {kind}, y int, size bigint, b binary, c binary"), "features")
    taken, held = [], 0
    for r in sorted(found.select("place", "id", "size").collect()):
        held += r["size"]
        if held > sample_bytes and taken:
            break
        taken.append((r["place"], r["id"]))
    if not taken:
        return []
    last = F.struct(F.lit(taken[-1][0]).alias("place"), F.lit(taken[-1][1]).cast(kind).alias("id"))
    # As Arrow, which the driver holds once instead of as rows of Java and of Python.
    got = found.where(F.struct("place", "id") <= last).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    values = zip(got.column("b"), got.column("c"), got.column("y").to_pylist())
    return [(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<f4"), y) for b, c, y in values]


class Scorer:
    """Scores whole texts with a model, many at once: each distinct word's margins are summed once."""

    def __init__(self, model: QualityModel) -> None:
        self.model = model
        self.margins = np.rint(model.margins / UNIT)
        self.repeat = int(self.margins[repeat_bucket(len(model.margins))]) * REPEAT_WEIGHT

    def score_all(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts without nulls."""
        words, begin, at = cut_words(texts, _BLANK)
        total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if len(begin):
            value, size = np.zeros(len(words.dictionary)), np.zeros(len(words.dictionary), np.int64)
            for owner, found in hashed_words(words.dictionary, len(self.margins)):
                if not len(owner):
                    continue
                # Sums of whole numbers below 2^53, so exact in any order.
                low = owner[0]
                sums = np.bincount(owner - low, self.margins[found])
                value[low : low + len(sums)] += sums
                size[low : low + len(sums)] += np.bincount(owner - low)
            code, first = words.indices.to_numpy(), np.searchsorted(begin, at)
            repeats = np.diff(_repeats(words, begin, at))
            total = np.diff(np.concatenate(([0], np.cumsum(value.astype(np.int64)[code])))[first]) + repeats * self.repeat
            n = np.diff(np.concatenate(([0], np.cumsum(size[code])))[first]) + repeats * REPEAT_WEIGHT
        z = self.model.bias + UNIT * total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.score_all(pa.array([text or ""], pa.string()))[0])


def score_column(text: Column, model: QualityModel, spark) -> Column:
    """Score of each whole text. The broadcast model has a fixed size: 8 bytes a bucket."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            texts = plain_texts(texts)
            _, at = _bytes_of(texts)
            found, row = [np.zeros(0)], 0
            while row < len(texts):
                to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
                found.append(scorer.score_all(texts.slice(row, to - row)))
                row = to
            yield pa.array(np.concatenate(found), pa.float64())
        release_memory()

    return F.arrow_udf(scored, "double")(text)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    model = train(training_rows(docs, labels, text, sample_rows))
    release_memory()
    return model


def report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document held_out, score and predicted."""
    model = fit(docs, labels, "text", sample_rows)
    scored = docs.select("doc_id", score_column(text_or_empty("text"), model, docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the classifier predicts good, all columns as they were."""
    model = fit(docs, labels, text, sample_rows)
    mark = fresh(docs, "_score")
    scored = docs.withColumn(mark, score_column(text_or_empty(text), model, docs.sparkSession))
    return scored.where(F.col(mark) >= THRESHOLD).drop(mark)
