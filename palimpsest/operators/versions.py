"""What a reader sees of the append-only version log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def live(now_ms: int | Column) -> Column:
    """Not deleted and not expired; a record expires at its time, not after it."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return ~F.col("deleted") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def latest(versions: DataFrame, keys: tuple[str, ...] = ("rowid",), order: str = "seqno") -> DataFrame:
    """The newest version of each row.

    Ranking by one group limit: tasks drop older versions before the shuffle,
    so a row with very many versions costs one row a task, and columns that the
    reader doesn't use never travel.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    mark = "_newest"
    return versions.withColumn(mark, F.row_number().over(newest)).where(F.col(mark) == 1).drop(mark)


def as_of(versions: DataFrame, at_ms: int, order: str = "seqno") -> DataFrame:
    """Each row's last version before its first one later than `at_ms`.

    As commits never go back in time, this is the newest of those not later.
    """
    return latest(versions.where(F.col("tx_ms") <= at_ms), order=order)


def visible(versions: DataFrame, now_ms: int, at_ms: int | None = None) -> DataFrame:
    """Live rows, now or at `at_ms`; then expiry is judged by that time too."""
    found = latest(versions) if at_ms is None else as_of(versions, at_ms)
    return found.where(live(now_ms if at_ms is None else at_ms))


def with_closures(versions: DataFrame, closures: DataFrame) -> DataFrame:
    """Versions whose valid_to a superseding record has closed, closed."""
    ends = closures.groupBy("rowid", "seqno").agg(F.max("valid_to").alias("_closed"))
    joined = versions.join(ends, ["rowid", "seqno"], "left")
    return joined.withColumn("valid_to", F.coalesce("_closed", "valid_to")).select(*versions.columns)


def access_totals(access: DataFrame) -> DataFrame:
    """(rowid, access_count, last_access) of an access log; sums combine before the shuffle."""
    return access.groupBy("rowid").agg(F.sum("delta").alias("access_count"), F.max("at_ms").alias("last_access"))


def with_access(rows: DataFrame, access: DataFrame) -> DataFrame:
    """Rows with access_count (0 if never) and last_access (null if never)."""
    return rows.join(access_totals(access), "rowid", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def survivors(versions: DataFrame, now_ms: int, horizon_ms: int | None) -> DataFrame:
    """The versions that compaction keeps.

    The newest of each row stays, unless it is dead and older than the horizon,
    when its whole chain goes; older versions go once they are beyond the
    horizon. Without a horizon everything stays.
    """
    if horizon_ms is None:
        return versions
    cutoff = F.lit(now_ms - horizon_ms)
    chain = versions.groupBy("rowid").agg(F.max_by(F.struct("seqno", "tx_ms", "deleted", "expires_at"), "seqno").alias("_last"))
    last = F.col("_last")
    dead = last["deleted"] | F.coalesce(last["expires_at"] <= now_ms, F.lit(False))
    kept = versions.join(chain, "rowid").where(
        ~(dead & (last["tx_ms"] < cutoff)) & ((F.col("seqno") == last["seqno"]) | (F.col("tx_ms") >= cutoff))
    )
    return kept.select(*versions.columns)
