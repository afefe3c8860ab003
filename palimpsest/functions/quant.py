"""Scalar quantisation of vectors: one byte a component, or half floats.

The byte codes are relative to each dimension's range. Inner products with a
query need no decoding: with q the query and d the step of each dimension,
the product is sum(q * low) + sum(code * (q * d)).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.functions.vector import dot


@dataclass(frozen=True)
class ByteCodes:
    """Each dimension's lowest value and step."""

    low: tuple[float, ...]
    step: tuple[float, ...]

    def encode(self, vector: Column) -> Column:
        """Codes from 0 to 255 as SMALLINT."""
        low, step = F.lit(list(self.low)), F.lit(list(self.step))

        def code(x: Column, i: Column) -> Column:
            d = F.get(step, i)
            scaled = F.round((x.cast("double") - F.get(low, i)) / F.when(d == 0, 1.0).otherwise(d))
            return F.when(d == 0, 0).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("smallint")

        return F.transform(vector, code)

    def decode(self, codes: Column) -> Column:
        low, step = F.lit(list(self.low)), F.lit(list(self.step))
        return F.transform(codes, lambda c, i: F.get(low, i) + c.cast("double") * F.get(step, i))

    def dot(self, codes: Column, query: list[float]) -> Column:
        """Inner product of encoded rows with a plain query."""
        bias = float(np.dot(query, self.low))
        return F.lit(bias) + dot(codes, F.lit([float(q) * d for q, d in zip(query, self.step)]))


def ranges(frame: DataFrame, vector: str = "vector") -> DataFrame:
    """(dim, low, high, step) of each dimension; partial aggregation keeps the shuffle at one row a dimension and task."""
    spread = frame.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    found = spread.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return found.withColumn("step", (F.col("high") - F.col("low")) / 255.0)


def fit(frame: DataFrame, vector: str = "vector") -> ByteCodes:
    """Codes for the vectors of `frame`; the driver gets one row a dimension, of which there are at most 65536."""
    rows = sorted(ranges(frame, vector).collect(), key=lambda r: r.dim)
    return ByteCodes(tuple(r.low for r in rows), tuple(r.step for r in rows))


@F.pandas_udf(T.BinaryType())
def to_half(vectors: pd.Series) -> pd.Series:
    """Little-endian IEEE half floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float32).astype("<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))
