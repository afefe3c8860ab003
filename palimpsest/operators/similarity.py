"""Exact similarity joins on vectors, in blocks, and clusters of similar rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from palimpsest.config import Metric
from palimpsest.functions.vector import TINY
from palimpsest.operators.components import connected_components
from palimpsest.operators.knn import batch_top_k

#: A block has so many bytes of doubles, so 32768 rows of 64 components, but at least `BLOCK_ROWS` rows.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 4096
#: So many products of two rows are held at once.
PRODUCTS_AT_ONCE = 1 << 22
LINKS = "a bigint, b bigint"


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (of each row its component's first) after the links (i, j) came to those that made `label`."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]


def _compare(ids: np.ndarray, matrix: np.ndarray, own: np.ndarray, crossed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of a block, or of two different ones, that connect them as all similar pairs do.

    Products in single precision decide but for those as near to the threshold as
    their rounding, which are computed in double.
    """
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    unit = np.where(norms * norms < TINY, 0.0, matrix / np.where(norms == 0, 1.0, norms))
    first = np.flatnonzero(own == own.min())
    second = np.flatnonzero(own != own.min()) if crossed else first
    label, narrow, slack = np.arange(len(ids)), unit.astype(np.float32), (matrix.shape[1] + 8) * 2.0**-23
    right, step = narrow[second].T, max(1, PRODUCTS_AT_ONCE // max(1, len(second)))
    for at in range(0, len(first), step):
        products = narrow[first[at : at + step]] @ (right if crossed else right[:, at:])
        i, j = np.nonzero(products >= np.float32(threshold - slack))
        open_ = np.flatnonzero(products[i, j] <= np.float32(threshold + slack))
        i, j = first[at + i], second[j if crossed else at + j]
        keep = i != j
        for part in range(0, len(open_), 1 << 15):
            some = open_[part : part + (1 << 15)]
            keep[some] &= np.einsum("ij,ij->i", unit[i[some]], unit[j[some]]) >= threshold
        label = _connect(label, i[keep], j[keep])
    rows = np.flatnonzero(label != np.arange(len(ids)))
    return ids[rows], ids[label[rows]]


def _compare_pairs(keys: int, threshold: float):
    """Compares the pairs of blocks of a partition, which come one after the other; the first `keys` columns tell them apart."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, flat = whole["rowid"].to_numpy(), pc.list_flatten(whole["vector"]).cast(pa.float64()).to_numpy()
            pair = {c: whole[c][0].as_py() for c in ("block_a", "block_b")}
            a, b = _compare(ids, flat.reshape(len(ids), -1), whole["block"].to_numpy(), pair["block_a"] != pair["block_b"], threshold)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            key = pa.StructArray.from_arrays(batch.columns[:keys], [str(i) for i in range(keys)]).to_pylist()
            starts = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1]] + [len(key)]
            for start, end in zip(starts, starts[1:]):
                if held and tuple(held[-1].column(i)[-1].as_py() for i in range(keys)) != tuple(key[start].values()):
                    yield found()
                held.append(batch.slice(start, end - start))
        if held:
            yield found()

    return links


def threshold_links(rows: DataFrame, threshold: float, by: Sequence[str] = (), vector: str = "vector", block_rows: int | None = None) -> DataFrame:
    """Links (a, b) that connect rows of equal `by` as all pairs with cosine >= threshold would; a row has one if it is similar to any.

    The join is exact, so its work is quadratic in a group; it is dealt into
    pairs of hash blocks, each compared by matrix products, and a pair of blocks
    emits fewer links than it has rows. A group's number of blocks follows
    from its size, so no comparison grows with the group. Pairs go to partitions
    by their number, as many to each, since a pair is long work on few bytes.
    """
    by, spark = list(by), rows.sparkSession
    usable = rows.where(F.size(vector) > 0).select(*by, "rowid", F.coalesce(F.size(vector), F.lit(0)).alias("dim"), F.col(vector).alias("vector"))
    size = F.greatest(F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))), F.lit(BLOCK_ROWS)) if block_rows is None else F.lit(block_rows)
    sizes = usable.groupBy(*by, "dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    dealt = usable.join(F.broadcast(sizes) if not by else sizes, [*by, "dim"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rowid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    number = F.xxhash64(*by, "dim") + F.expr("block_b * (block_b + 1) div 2") + F.col("block_a")
    group = [*by, "dim", "block_a", "block_b"]
    placed = dealt.select(*group, "block", "rowid", "vector").repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int"))
    return placed.sortWithinPartitions(*group).mapInArrow(_compare_pairs(len(group), threshold), LINKS)


def clusters(rows: DataFrame, threshold: float, by: Sequence[str] = (), vector: str = "vector", block_rows: int | None = None) -> DataFrame:
    """(rowid, cluster) of rows that have a similar one; cluster is its smallest rowid."""
    links = threshold_links(rows, threshold, by, vector, block_rows)
    return connected_components(links).select(F.col("node").alias("rowid"), F.col("component").alias("cluster"))


def nearest_above(rows: DataFrame, candidates: DataFrame, threshold: float, k: int = 1) -> DataFrame:
    """For each new row (ord, vector) its k best matches in `candidates` (rowid, vector): (ord, rowid, score, rank).

    Best cosine at or above the threshold, then smallest rowid. New rows are the
    queries; they go against the stored rows in blocks.
    """
    queries = rows.select(F.col("ord").alias("query_id"), F.col("vector").alias("qvec"))
    found = batch_top_k(candidates, queries, k, Metric.COSINE)
    return found.where(F.col("score") >= threshold).select(F.col("query_id").alias("ord"), "rowid", "score", "rank")
