"""Composite scores, and the greedy steps over a search's final candidates.

Candidates are at most top_k_max rows a query, so windows and groups here are
bounded by that setting.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.config import Retention, Scoring, TimeAxis
from palimpsest.functions.scalar import decay, log_share
from palimpsest.functions.vector import TINY
from palimpsest.operators.fusion import min_max

FACTORS = ("sim", "recency", "importance", "access", "confidence", "boost")


def composite(candidates: DataFrame, scoring: Scoring, now_ms: int, higher_is_better: bool = True) -> DataFrame:
    """Replaces `score` by the weighted sum of factors and adds `breakdown`.

    Needs created_at, valid_from, importance, confidence, access_count and
    last_access. Similarity is scaled to 0..1 among the candidates; below the
    floor the whole score is 0.
    """
    keys = ["query_id"] if "query_id" in candidates.columns else []
    sign = 1.0 if higher_is_better else -1.0
    # A row that was never read counts as read when it was made.
    last = F.when(F.coalesce("access_count", F.lit(0)) == 0, F.col("created_at")).otherwise(F.col("last_access"))
    start = F.col("valid_from" if scoring.time_axis is TimeAxis.VALID_TIME else "created_at")
    marked = candidates.withColumn("_sim", min_max(F.col("score") * sign, keys))
    parts = {
        "sim": F.col("_sim") * scoring.w_sim,
        "recency": decay(F.lit(now_ms) - F.greatest(start, last), scoring.half_life_ms) * scoring.w_recency,
        "importance": F.col("importance").cast("double") * scoring.w_importance,
        "access": log_share(F.coalesce("access_count", F.lit(0)), scoring.c_norm) * scoring.w_access,
        "confidence": F.col("confidence").cast("double") * scoring.w_confidence,
        "boost": F.lit(0.0),
    }
    total = sum((parts[f] for f in FACTORS[1:]), parts["sim"])
    marked = marked.withColumn("breakdown", F.struct(*(parts[f].alias(f) for f in FACTORS)))
    return marked.withColumn("score", F.when(F.col("_sim") < scoring.floor, 0.0).otherwise(total)).drop("_sim")


def plain_breakdown(score: Column) -> Column:
    """The breakdown of a score that is a channel's own."""
    return F.struct(score.alias("sim"), *(F.lit(0.0).alias(f) for f in FACTORS[1:]))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, np.float64) for v in vectors])
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.where(norms * norms < TINY, 0.0, matrix / np.where(norms == 0, 1.0, norms))


def keep_apart(vectors: pd.Series, threshold: float) -> np.ndarray:
    """Places of the rows, in order, whose cosine with every row kept before is below the threshold."""
    unit, kept = _unit_rows(vectors), []
    for i in range(len(unit)):
        if not kept or (unit[kept] @ unit[i] < threshold).all():
            kept.append(i)
    return np.array(kept, int)


def diversify(vectors: pd.Series, scores: np.ndarray, weight: float, k: int) -> np.ndarray:
    """Places by maximal marginal relevance: weight * score - (1 - weight) * closest chosen cosine."""
    weight = min(1.0, max(0.0, weight))
    unit, left = _unit_rows(vectors), np.ones(len(vectors), bool)
    closest, chosen = np.zeros(len(unit)), []
    while len(chosen) < min(k, len(unit)):
        value = np.where(left, weight * scores - (1 - weight) * closest, -np.inf)
        at = int(np.argmax(value))
        if not left[at]:
            at = int(np.flatnonzero(left)[0])
        left[at] = False
        similar = unit @ unit[at]
        closest = similar if not chosen else np.maximum(closest, similar)
        chosen.append(at)
    return np.array(chosen, int)


def greedy(candidates: DataFrame, pick: Callable[[pd.DataFrame], np.ndarray], higher_is_better: bool = True) -> DataFrame:
    """Runs a sequential choice over each query's candidates, in rank order.

    `pick` returns the places that stay, in their new order, which becomes the
    column rank. Needs vector, rowid and score; a group is one query's
    candidates, at most top_k_max rows.
    """
    keys = ["query_id"] if "query_id" in candidates.columns else []
    rest = [f for f in candidates.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", rank int"

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.assign(_s=group["score"] * (-1 if higher_is_better else 1)).sort_values(["_s", "rowid"], na_position="last")
        ordered = ordered.drop(columns="_s").reset_index(drop=True)
        out = ordered.iloc[pick(ordered)].reset_index(drop=True)
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))[[f.name for f in rest] + ["rank"]]

    rows = candidates.select(*(f.name for f in rest))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    return rows.groupBy(*keys).applyInPandas(chosen, schema)


def drop_near(candidates: DataFrame, threshold: float, higher_is_better: bool = True) -> DataFrame:
    """Drops, in rank order, what is too similar to a better candidate."""
    return greedy(candidates, lambda g: keep_apart(g["vector"], threshold), higher_is_better)


def mmr(candidates: DataFrame, weight: float, k: int, higher_is_better: bool = True) -> DataFrame:
    """The k candidates of greatest marginal relevance, in order of choice."""
    return greedy(candidates, lambda g: diversify(g["vector"], g["score"].to_numpy(float), weight, k), higher_is_better)


def retention(rows: DataFrame, policy: Retention, now_ms: int) -> Column:
    """importance * 2^(-age / half life) + weight * ln(1 + accesses); a half life of 0 leaves no decayed part.

    Age counts from the later of valid_from and the last access.
    """
    age = F.lit(now_ms) - F.greatest(F.col("valid_from"), F.coalesce("last_access", F.lit(0)))
    kept = decay(age, policy.half_life_ms) if policy.half_life_ms > 0 else F.lit(0.0)
    gain = F.ln(F.lit(1.0) + F.coalesce("access_count", F.lit(0)).cast("double")) * policy.access_weight
    return F.col("importance").cast("double") * kept + gain
