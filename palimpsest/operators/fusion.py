"""Fusion of ranked channels: reciprocal ranks, or weighted min-max scores.

A channel is a frame (rowid, score), with query_id before it for batches, that
its search has already cut to at most twice top_k rows a query. So the windows
below see a bounded number of rows a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.vector import best_first
from palimpsest.operators.knn import ranked

RRF_K = 60


def _keys(frame: DataFrame) -> list[str]:
    return ["query_id"] if "query_id" in frame.columns else []


def _cut(fused: DataFrame, keys: list[str], top_k: int) -> DataFrame:
    if keys:
        return ranked(fused, top_k, True, keys).drop("rank")
    return fused.orderBy(*best_first(True, F.col("score"), F.col("rowid"))).limit(top_k)


def reciprocal_rank(channels: list[tuple[DataFrame, bool]], top_k: int, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the channels (frame, higher_is_better); ranks start at 1."""
    keys, parts = _keys(channels[0][0]), []
    for frame, higher in channels:
        order = Window.partitionBy(*keys or [F.lit(0)]).orderBy(*best_first(higher, F.col("score"), F.col("rowid")))
        parts.append(frame.select(*keys, "rowid", (F.lit(1.0) / (F.row_number().over(order) + k)).alias("score")))
    fused = reduce(DataFrame.unionByName, parts).groupBy(*keys, "rowid").agg(F.sum("score").alias("score"))
    return _cut(fused, keys, top_k)


def min_max(score: Column, keys: list[str]) -> Column:
    """A score's place between the least and the greatest of its list; 1 if all are equal, 0 if it is no number."""
    whole = Window.partitionBy(*keys or [F.lit(0)])
    usual = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)
    low, high = F.min(usual).over(whole), F.max(usual).over(whole)
    return F.when(usual.isNull(), 0.0).when(high == low, 1.0).otherwise((score - low) / (high - low))


def weighted(
    vector: DataFrame, text: DataFrame, alpha: float, top_k: int, vector_is_distance: bool = False,
) -> DataFrame:
    """alpha * vector + (1 - alpha) * text, each scaled to 0..1 within its own list."""
    keys = _keys(vector)
    sign = -1.0 if vector_is_distance else 1.0
    left = vector.select(*keys, "rowid", (min_max(F.col("score") * sign, keys) * alpha).alias("score"))
    right = text.select(*keys, "rowid", (min_max(F.col("score"), keys) * (1.0 - alpha)).alias("score"))
    fused = left.unionByName(right).groupBy(*keys, "rowid").agg(F.sum("score").alias("score"))
    return _cut(fused, keys, top_k)
