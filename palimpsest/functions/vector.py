"""Vector arithmetic as columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from palimpsest.config import Metric

#: Cosines with a smaller product of norms are 0.
TINY = 1e-12


def vector(values: Sequence[float] | Column | str) -> Column:
    """A column of doubles from a column, its name, or plain numbers."""
    if isinstance(values, str):
        values = F.col(values)
    if isinstance(values, Column):
        return values.cast("array<double>")
    return F.lit([float(x) for x in values])


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt(norm_sq(a) * norm_sq(b))
    return F.when(scale < TINY, F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x * x
    )


def score(metric: Metric, a: Column, b: Column) -> Column:
    return {Metric.COSINE: cosine, Metric.DOT: dot, Metric.L2: l2_sq}[metric](a, b)


def best_first(metric_or_higher: Metric | bool, value: Column, rowid: Column) -> list[Column]:
    """A total order: better scores first, NaN last, then smaller ids."""
    higher = metric_or_higher.higher_is_better if isinstance(metric_or_higher, Metric) else metric_or_higher
    # Adding 0 makes -0 into 0, which sorts equal to it.
    return [F.isnan(value).asc(), value.desc_nulls_last() if higher else value.asc_nulls_last(), rowid.asc()]


def is_finite(a: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    good = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def matrix_scores(metric: Metric, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores [rows, queries] of double matrices, as `score` gives them."""
    products = rows @ queries.T
    if metric is Metric.DOT:
        return products
    row_sq, query_sq = (rows * rows).sum(axis=1)[:, None], (queries * queries).sum(axis=1)[None, :]
    if metric is Metric.L2:
        return np.maximum(row_sq + query_sq - 2 * products, 0.0)
    scale = np.sqrt(row_sq * query_sq)
    return np.where(scale < TINY, 0.0, products / np.where(scale < TINY, 1.0, scale))
