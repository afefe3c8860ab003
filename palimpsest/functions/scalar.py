"""Scalar functions of the record model as columns: decay, JSON, hashes, times."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    A lambda variable is the only binding that the optimizer never inlines, so
    an expensive expression used inside nested lambdas isn't computed again
    for each element.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


# Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, value: int = FNV_BASIS) -> int:
    """64-bit FNV-1a of some bytes, or its next state after others."""
    for byte in data:
        value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return value


#: With so few texts left, plain Python is faster than a step of numpy for each byte.
FEW_TEXTS = 24


def fnv1a_texts(texts: pa.Array) -> pa.Array:
    """Signed 64-bit FNV-1a of each text's UTF-8 bytes; null for a null.

    The texts of a batch go side by side, a byte of each at a time, the longest first,
    so that those that are done fall off the end.
    """
    binary = texts.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, left = offsets[:-1][order], lengths[order]
    # How many texts have more than i bytes, down to where few are left.
    last = int(left[FEW_TEXTS]) if len(left) > FEW_TEXTS else 0
    longer = np.searchsorted(-left, -np.arange(last), side="left")
    state, prime = np.full(len(left), FNV_BASIS, np.uint64), np.uint64(FNV_PRIME)
    for i, n in enumerate(longer.tolist()):
        state[:n] ^= data[starts[:n] + i]
        state[:n] *= prime
    for row in range(min(FEW_TEXTS, len(left))):
        state[row] = fnv1a(data[starts[row] + last : starts[row] + left[row]].tobytes(), int(state[row]))
    result = np.empty_like(state)
    result[order] = state
    return pa.array(result.view(np.int64), mask=np.asarray(binary.is_null()))


def text_hash(text: Column) -> Column:
    """Signed 64-bit FNV-1a of a text's UTF-8 bytes.

    Every byte depends on the one before it, which the JVM's column functions can
    only do by interpreting a lambda for each; so this runs in Python, in Arrow batches.
    """
    return F.arrow_udf(fnv1a_texts, "bigint")(text)


def decay(age_ms: Column, half_life_ms: int) -> Column:
    """2^(-age / half life); a half life of 0 counts as a millisecond."""
    return F.pow(F.lit(2.0), -F.greatest(age_ms, F.lit(0)).cast("double") / F.lit(float(max(1, half_life_ms))))


def log_share(count: Column, norm: int) -> Column:
    """ln(1 + count) / ln(1 + norm), between 0 and 1."""
    share = F.ln(F.lit(1.0) + count.cast("double")) / F.ln(F.lit(1.0 + max(1, norm)))
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def json_get(metadata: Column, path: str, kind: str = "variant") -> Column:
    """The value at a dotted path through JSON objects; null if missing or of another type."""
    return F.try_variant_get(F.try_parse_json(metadata), "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def json_depth(metadata: Column) -> Column:
    """Deepest nesting of brackets outside strings; a scalar has depth 0."""
    bare = F.regexp_replace(F.coalesce(metadata, F.lit("")), r'"(?:[^"\\]|\\.)*+"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    deepest = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")),
        lambda s, m: F.struct(
            (s["at"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("at"),
            F.greatest(s["top"], s["at"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("top"),
        ),
    )
    return deepest["top"]


def iso_from_ms(ms: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:SS.mmmZ`; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
