"""Approximate search: an inverted file of k-means cells, and byte codes.

Both narrow the rows that the exact score is computed on; the scores returned
are always exact. With all cells probed the results are the exact ones; byte
codes only leave out rows that can't be among them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.config import IndexOptions, Metric
from palimpsest.functions.quant import ByteCodes
from palimpsest.functions.vector import best_first, dot, matrix_scores, score, vector as as_vector
from palimpsest.operators.knn import SCORES_AT_ONCE, batch_top_k, by_blocks, merge_best, top_k
from palimpsest.sources.scratch import shared_path

#: Distances of rows to centres are computed so many at a time.
CENTRE_DISTANCES = 1 << 22


def k_means(matrix: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from a seeded start; the sample is bounded by the caller."""
    dice = np.random.default_rng(seed)
    centres = matrix[dice.choice(len(matrix), min(cells, len(matrix)), replace=False)].copy()
    for _ in range(rounds):
        own = matrix_scores(Metric.L2, matrix, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, matrix)
        counts = np.bincount(own, minlength=len(centres))
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


@dataclass(frozen=True)
class CellIndex:
    """Centres of the cells, and the rows (rowid, seqno, vector, cell) as files in a folder for each cell.

    `probes` is the number of cells that reached the wanted recall on a sample;
    `seqno` is the first number of versions that the index doesn't know.
    """

    centres: np.ndarray
    rows: DataFrame
    metric: Metric
    probes: int
    size: int
    seqno: int = 0

    def nearest_cells(self, query: Sequence[float], n: int) -> list[int]:
        """The n cells nearest to a query, nearest first."""
        return _cell_order(self.centres, np.asarray(query, np.float64)[None, :], self.metric)[0][:n].tolist()

    def probed(self, query: Sequence[float], n_probes: int) -> DataFrame:
        """The rows of the nearest cells; the cell filter prunes folders."""
        return self.rows.where(F.col("cell").isin(self.nearest_cells(query, n_probes)))

    def search(self, query: Sequence[float], k: int, n_probes: int | None = None, where: Column | None = None) -> DataFrame:
        """The k best rows of the probed cells."""
        return top_k(self.probed(query, n_probes or self.probes), query, k, self.metric, where)

    def batch_search(self, queries: DataFrame, k: int, n_probes: int | None = None) -> DataFrame:
        """(query_id, rowid, score, rank) of the k best rows of each query's probed cells, for any number of queries.

        As the exact batch, but the rows of a cell only meet the queries that probe it.
        """
        n, centres, metric = n_probes or self.probes, self.centres, self.metric

        def scorer(ids: np.ndarray, matrix: np.ndarray):
            # Each cell's queries, as (cell, query) in order of the cell.
            cells = _cell_order(centres, matrix, metric)[:, :n] if len(ids) else np.zeros((0, 1), np.int64)
            order = np.argsort(cells, axis=None, kind="stable")
            query, ends = order // cells.shape[1], np.searchsorted(cells.ravel()[order], np.arange(len(centres) + 1))
            return _cell_scorer(ids, matrix, query, ends, k, metric)

        return by_blocks(self.rows.select("rowid", "vector", "cell"), queries, k, metric, scorer)


def _cell_scorer(ids: np.ndarray, matrix: np.ndarray, query: np.ndarray, ends: np.ndarray, k: int, metric: Metric):
    """Scores the rows of each cell against its queries, keeping k rows a query and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            cells, rows = batch.column("cell").to_numpy(), batch.column("rowid").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            order = np.argsort(cells, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], cells[order][1:] != cells[order][:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                cell = cells[order[a]]
                asked = query[ends[cell] : ends[cell + 1]]
                step = max(1, SCORES_AT_ONCE // max(1, len(asked)))
                for at in range(a, b if len(asked) else a, step):
                    part = order[at : min(at + step, b)]
                    scores = matrix_scores(metric, vectors[part].astype(np.float64), matrix[asked]).T
                    best = merge_best(metric, k, best, scores, rows[part], asked)
        number, value, row = best
        yield pa.RecordBatch.from_arrays([pa.array(ids[number]), pa.array(row), pa.array(value)], ["query_id", "rowid", "score"])

    return scan


def _cell_order(centres: np.ndarray, queries: np.ndarray, metric: Metric) -> np.ndarray:
    """For each query all cells, nearest first."""
    if metric is Metric.DOT:
        return np.argsort(-(queries @ centres.T), axis=1, kind="stable")
    if metric is Metric.COSINE:
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    return np.argsort(matrix_scores(Metric.L2, queries, centres), axis=1, kind="stable")


def fit(rows: DataFrame, options: IndexOptions, metric: Metric, vector: str = "vector", rowid: str = "rowid") -> tuple[np.ndarray, int]:
    """(centres of the cells, number of rows), from a bounded sample.

    The sample holds `train_rows` rows at most, chosen by a hash of the id; the
    centres are `cells` rows, about the square root of the number of rows by
    default and never more than `train_rows`.
    """
    total = rows.count()
    cells = options.cells or max(1, int(total**0.5))
    order = F.xxhash64(F.lit(options.seed), F.col(rowid))
    share = min(1.0, 2.0 * options.train_rows / max(1, total))
    chosen = rows.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    held = chosen.orderBy(order, rowid).limit(options.train_rows).select(F.col(vector).cast("array<double>").alias("v")).collect()
    sample = np.array([r.v for r in held], np.float64)
    if metric is Metric.COSINE and len(sample):
        sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    return (k_means(sample, min(cells, options.train_rows), options.seed) if len(sample) else np.zeros((1, 1))), total


def assign(rows: DataFrame, centres: np.ndarray, metric: Metric, vector: str = "vector") -> DataFrame:
    """Adds each row's nearest cell. The centres sent to the tasks are bounded by the sample they come from."""
    shared, normalised = rows.sparkSession.sparkContext.broadcast(centres), metric is Metric.COSINE

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        step, out = max(1, CENTRE_DISTANCES // len(shared.value)), []
        for at in range(0, len(vectors), step):
            matrix = np.stack([np.asarray(v, np.float64) for v in vectors.iloc[at : at + step]])
            if normalised:
                matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            out.append(matrix_scores(Metric.L2, matrix, shared.value).argmin(axis=1).astype(np.int32))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int32))

    return rows.withColumn("cell", nearest(F.col(vector).cast("array<double>")))


def build(rows: DataFrame, options: IndexOptions, metric: Metric = Metric.COSINE, folder: str | None = None, seqno: int = 0) -> CellIndex:
    """Fits the cells, assigns every row (rowid, vector, perhaps seqno) to its nearest one, and writes them by cell.

    Rows are rebalanced by cell, so that a cell is in few files and one that
    holds very many rows is split. Then a sample of queries measures how many cells
    must be probed: `probes` is doubled until the recall is at least `recall_floor`,
    which all cells reach.
    """
    centres, total = fit(rows, options, metric)
    if "seqno" not in rows.columns:
        rows = rows.withColumn("seqno", F.lit(0).cast("bigint"))
    folder = folder or shared_path(rows.sparkSession, "cells")
    placed = assign(rows.select("rowid", "seqno", "vector"), centres, metric)
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(folder)
    kind = rows.schema["vector"].dataType.simpleString()
    index = load(rows.sparkSession, folder, centres, metric, len(centres), total, seqno, kind)
    return replace(index, probes=_enough_probes(index, options))


def load(spark: SparkSession, folder: str, centres: np.ndarray, metric: Metric, probes: int, size: int, seqno: int, kind: str = "array<float>") -> CellIndex:
    rows = spark.read.schema(f"rowid bigint, seqno bigint, vector {kind}, cell int").parquet(folder)
    return CellIndex(centres, rows, metric, probes, size, seqno)


def _enough_probes(index: CellIndex, options: IndexOptions) -> int:
    """The fewest probes, doubling from the wished ones, whose recall on sampled rows reaches the floor.

    A probed cell is searched exactly, so the recall is the share of the exact
    neighbours that lie in the probed cells.
    """
    shares = recall_by_probes(index, options.sample_queries, 10)
    probes = min(options.probes, len(index.centres))
    while probes < len(index.centres) and shares[probes - 1] < options.recall_floor:
        probes = min(2 * probes, len(index.centres))
    return probes


def recall_by_probes(index: CellIndex, n_queries: int, k: int) -> np.ndarray:
    """The recall of the k nearest with 1, 2, ... all cells probed, on rows chosen by a hash as queries."""
    chosen = index.rows.orderBy(F.xxhash64(F.lit(3), "rowid"), "rowid").limit(n_queries).select("rowid", "vector").collect()
    if not chosen:
        return np.ones(len(index.centres))
    queries = index.rows.sparkSession.createDataFrame([(i, list(r.vector)) for i, r in enumerate(chosen)], "query_id bigint, qvec array<float>")
    exact = batch_top_k(index.rows, queries, k, index.metric)
    cells = index.rows.select("rowid", "cell").join(F.broadcast(exact.select("query_id", "rowid")), "rowid").collect()
    order = _cell_order(index.centres, np.array([r.vector for r in chosen], np.float64), index.metric)
    place = np.argsort(order, axis=1)
    found = np.bincount([int(place[r.query_id, r.cell]) for r in cells], minlength=len(index.centres))
    return np.cumsum(found) / max(1, len(cells))


def two_stage(
    rows: DataFrame, query: Sequence[float], k: int, codes: ByteCodes, metric: Metric = Metric.COSINE, oversample: int = 4,
    code: str = "code", vector: str = "vector", rowid: str = "rowid",
) -> DataFrame:
    """The exact k best rows: coarse scores on byte codes, exact ones wherever the codes leave it open.

    The exact scores of the oversample * k best by code give a score to reach;
    then every row whose code allows for that score gets its exact one. Where
    the codes are coarse these may be all rows. Rows without code are among
    them; the codes must be fitted on rows that include these.
    """
    q = [float(x) for x in query]
    approx = codes.dot(F.col(code), q)
    if metric is not Metric.DOT:
        approx = score(metric, codes.decode(F.col(code)), as_vector(query))
    coarse = rows.select(F.col(rowid).alias("rowid"), F.col(vector).alias("vector"), F.col(code).alias("code"), approx.alias("coarse"))
    short = coarse.orderBy(*best_first(metric, F.col("coarse"), F.col("rowid"))).limit(oversample * k)
    reached = [r.score for r in top_k(short, query, k, metric).collect()]
    if len(reached) < k or not k or not np.isfinite(reached[-1]):
        return top_k(coarse, query, k, metric)
    open_ = _may_reach(codes, F.col("code"), q, metric, reached[-1])
    return top_k(coarse, query, k, metric, F.coalesce(open_, F.lit(True)))


def _may_reach(codes: ByteCodes, code: Column, query: list[float], metric: Metric, reached: float) -> Column:
    """Whether a row of this code can have a score as good as `reached`; null or true if that isn't known."""
    low, step, q = (np.asarray(x, np.float64) for x in (codes.low, codes.step, query))
    if len(low) != len(q):
        return F.lit(True)
    # Half a step a dimension, and what rounding may add.
    error = step * 0.500001 + 1e-9 * (np.abs(low) + 255 * step)
    off, radius, norm = float(np.abs(q) @ error), float(np.linalg.norm(error)), float(np.linalg.norm(q))
    slack = 1e-9 * max(1.0, abs(reached))
    if metric is Metric.L2:
        least = F.greatest(F.sqrt(score(metric, codes.decode(code), as_vector(query))) - radius, F.lit(0.0))
        return least * least <= reached + slack
    most = codes.dot(code, query) + off
    if metric is Metric.DOT:
        return most >= reached - slack
    decoded = codes.decode(code)
    length = F.sqrt(dot(decoded, decoded))
    shortest = (length - radius) * norm
    # Too short for a bound on the cosine: open.
    least_scale = F.when(most > 0, shortest).otherwise((length + radius) * norm)
    return (shortest < 1e-6) | (most >= (reached - slack) * least_scale)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, n, recall): of each query's exact results, how many there are and the share that was found."""
    hits = found.select("query_id", "rowid").distinct().withColumn("_hit", F.lit(1))
    both = exact.select("query_id", "rowid").join(hits, ["query_id", "rowid"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def wants_index(indexed: int, options: IndexOptions) -> bool:
    """Whether an index pays: only beyond the size at which a scan is cheap."""
    return indexed > options.brute_force_max_rows


def probes_for(index: CellIndex, candidates: int, alive: int, effort: int) -> int | None:
    """How many cells to probe when a filter leaves so many candidates; None for an exact scan of these.

    Few candidates are cheaper to scan. Else the fewer pass the filter, the
    more cells are needed for as many results: in inverse proportion up to 8 times
    where more than a tenth passes, and 4 times the effort below.
    """
    share = candidates / max(1, alive)
    if share <= 0.001 or candidates < max(effort, 1024):
        return None
    wider = min(8.0, 1.0 / share) if share > 0.10 else 4.0
    return min(len(index.centres), max(1, round(index.probes * wider)))
