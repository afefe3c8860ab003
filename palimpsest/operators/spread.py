"""Joins and minima of keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is split into at most so many parts, and at most so many keys are.
SLOTS = 1024


def join_large_keys(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """`rows` with the columns of `table`, which has one row for each of the keys.

    `count` is the table's column with the number of rows of a key, and `total`
    is at least the sum of it. Fewer than `SLOTS` keys can hold more than
    total / SLOTS rows each, so those are broadcast, and their rows are dealt to as
    many slots as they exceed that share, by a hash of `spread`; the table's row
    is repeated for each slot. So no task gets much more of a key than this share.
    Rows without a partner are dropped, and `count` too.
    """
    wanted = F.greatest(F.ceil(F.col(count) * SLOTS / F.lit(max(total, 1))), F.lit(1)).cast("int")
    large = table.where(F.col(count) * SLOTS > total).select(*keys, wanted.alias("_slots"))
    slot = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_slots").cast("bigint")), F.lit(0).cast("bigint")).cast("int")
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("_slot", slot).drop("_slots")
    parts = table.withColumn("_slot", F.explode(F.sequence(F.lit(0), wanted - 1))).drop(count)
    return dealt.join(parts, [*keys, "_slot"]).drop("_slot")


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds each key's least value to all its rows.

    The least values are taken of slots of a key, then of the key, and go back the
    same way, so that a key with very many rows never meets in one task.
    """
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(F.lit(7), value), F.lit(SLOTS)).cast("int"))
    parts = rows.groupBy(key, "_slot").agg(F.min(value).alias("_low"))
    low = parts.groupBy(key).agg(F.min("_low").alias(name))
    parts = parts.select(key, "_slot").join(low, key)
    return rows.join(parts, [key, "_slot"]).drop("_slot")
