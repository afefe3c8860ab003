"""Exact nearest neighbours: one query, or a batch of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.config import Metric
from palimpsest.functions.vector import best_first, matrix_scores, score, vector as as_vector
from palimpsest.sources.scratch import shared_path

#: Query vectors are sent to the tasks in blocks of at most so many bytes.
QUERY_BLOCK_BYTES = 8 << 20
FOUND = "query_id bigint, rowid bigint, score double"
#: Rows are scored against a block of queries so many scores at a time.
SCORES_AT_ONCE = 1 << 20
#: So many queries of a block meet a batch of rows at once, so that few of the scores are ever sorted.
QUERIES_AT_ONCE = 256


def top_k(
    rows: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE, where: Column | None = None,
    vector: str = "vector", rowid: str = "rowid",
) -> DataFrame:
    """(rowid, score) of the k best rows, best first; ties go to the smaller id.

    The filter stands before the limit, so it never costs results. Each task
    keeps k rows and only those travel.
    """
    if where is not None:
        rows = rows.where(where)
    scored = rows.select(F.col(rowid).alias("rowid"), score(metric, as_vector(vector), as_vector(query)).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(*best_first(metric, F.col("score"), F.col("rowid"))).limit(k)


def ranked(scored: DataFrame, k: int, higher_is_better: bool, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best rows of each query with their rank, from 1."""
    order = best_first(higher_is_better, F.col("score"), F.col("rowid"))
    window = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def merge_best(
    metric: Metric, k: int, best: tuple[np.ndarray, np.ndarray, np.ndarray], scores: np.ndarray, rows: np.ndarray, numbers: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query number, score, row) of those held and of a matrix of scores [queries, rows]; `numbers` are its queries'."""
    held_query, held_score, held_row = best
    worth = scores if metric.higher_is_better else -scores
    worth = np.where(np.isnan(worth), -np.inf, worth)
    if scores.shape[1] > k:
        # What can't be among the k best of this part goes before anything is sorted.
        least = np.partition(worth, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        query, at = np.nonzero(worth >= least[:, None])
    else:
        query, at = (x.ravel() for x in np.indices(scores.shape))
    value, row = np.concatenate([held_score, scores[query, at]]), np.concatenate([held_row, rows[at]])
    query = np.concatenate([held_query, query if numbers is None else numbers[query]])
    # By query, NaN last, then the smaller id: numpy sorts by the last key first.
    order = np.lexsort((row, -value if metric.higher_is_better else value, np.isnan(value), query))
    query, value, row = query[order], value[order], row[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    return query[keep], value[keep], row[keep]


def _block_scorer(ids: np.ndarray, matrix: np.ndarray, k: int, metric: Metric):
    """Scores partitions against one block of queries, keeping k rows a query and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = range(0, len(ids), QUERIES_AT_ONCE)
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in parts]
        step = max(1, SCORES_AT_ONCE // QUERIES_AT_ONCE)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("vector")), -1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(lengths == matrix.shape[1]))
            rows, flat = batch.column("rowid").to_numpy(), batch.column("vector").flatten()
            vectors = flat.to_numpy(zero_copy_only=False).reshape(len(batch), matrix.shape[1])
            for at in range(0, len(batch), step):
                strip = vectors[at : at + step].astype(np.float64)
                for part, first in enumerate(parts):
                    scores = matrix_scores(metric, strip, matrix[first : first + QUERIES_AT_ONCE]).T
                    best[part] = merge_best(metric, k, best[part], scores, rows[at : at + step])
        for (query, value, row), first in zip(best, parts):
            yield pa.RecordBatch.from_arrays([pa.array(ids[first + query]), pa.array(row), pa.array(value)], ["query_id", "rowid", "score"])

    return scan


def batch_top_k(
    rows: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.COSINE, vector: str = "vector", rowid: str = "rowid",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rowid, score, rank) of the k best rows for each of `queries` (query_id, qvec).

    The queries go to the tasks in blocks whose size is checked; each block is one
    scan of the rows with a matrix product, and a task passes on k rows a query.
    One block stays a lazy plan. More are run one after the other and written to
    the shared folder, so the driver holds one block, however many queries there are;
    the scans are as many as the blocks.
    """
    narrow = rows.select(F.col(rowid).cast("bigint").alias("rowid"), F.col(vector).alias("vector"))
    return by_blocks(narrow, queries, k, metric, lambda ids, matrix: _block_scorer(ids, matrix, k, metric), block_bytes)


def by_blocks(rows: DataFrame, queries: DataFrame, k: int, metric: Metric, scorer: Callable, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """The k best of what `scorer(ids, matrix)` finds in the rows for each block of queries; see `batch_top_k`."""
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("qvec"))).first()
    count, width = size[0], max(1, size[1] or 1)
    blocks = max(1, -(-count * width * 8 // block_bytes))
    spark, folder = rows.sparkSession, shared_path(rows.sparkSession, "nearest") if blocks > 1 else None
    found = None
    for block in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        held = sorted((r.query_id, r.qvec) for r in chosen.select("query_id", F.col("qvec").cast("array<double>")).collect())
        ids = np.array([q for q, _ in held], np.int64)
        matrix = np.array([v for _, v in held], np.float64).reshape(len(held), -1 if held else width)
        found = rows.mapInArrow(scorer(ids, matrix), FOUND)
        if folder is not None:
            found.write.mode("append").parquet(folder)
    if folder is not None:
        found = spark.read.schema(FOUND).parquet(folder)
    return ranked(found, k, metric.higher_is_better)
