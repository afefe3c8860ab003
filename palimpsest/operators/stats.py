"""Reports over the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.versions import latest, live

# Latency buckets, their number and bounds in milliseconds.
LATENCY_BUCKETS, LATENCY_LOW, LATENCY_HIGH = 32, 1.0, 1000.0


def namespace_stats(rows: DataFrame, ns: str = "ns", text: str = "text") -> DataFrame:
    """Per namespace the live rows and the bytes of their texts."""
    return rows.groupBy(F.col(ns).alias("ns")).agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")).alias("total_doc_len"),
    )


def dead_ratio(versions: DataFrame, now_ms: int, segment: Column) -> DataFrame:
    """Per segment its rows, those no reader of the present sees, and their share."""
    newest = versions.groupBy("rowid").agg(F.max("seqno").alias("_last"))
    dead = (F.col("seqno") < F.col("_last")) | ~live(now_ms)
    marked = versions.withColumn("segment", segment).join(newest, "rowid").select("segment", dead.alias("dead"))
    counted = marked.groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("dead").alias("dead_rows"))
    return counted.withColumn("dead_ratio", F.col("dead_rows") / F.col("n_rows"))


def snapshot_stats(versions: DataFrame, now_ms: int) -> DataFrame:
    """One row: the last sequence number, all versions, rows and live rows."""
    newest = latest(versions.select("rowid", "seqno", "deleted", "expires_at"))
    counts = newest.agg(
        F.coalesce(F.max("seqno"), F.lit(0)).alias("version"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(live(now_ms)).alias("live_rows"),
    )
    return counts.withColumn("versions", versions.agg(F.count(F.lit(1))).scalar())


def global_stats(versions: DataFrame, edges: DataFrame, now_ms: int, dimension: int) -> DataFrame:
    """One row: rows, versions kept beside the newest, relations and vector bytes in use."""
    base = snapshot_stats(versions, now_ms)
    return base.select(
        "version", "n_rows", "live_rows",
        (F.col("versions") - F.col("n_rows")).alias("retained_versions"),
        edges.agg(F.count(F.lit(1))).scalar().alias("relations"),
        (F.col("live_rows") * dimension * 4).alias("memory_estimate"),
    )


def latency_bucket(ms: Column) -> Column:
    """Number of the logarithmic bucket, from 0; beyond the bounds the first or last."""
    place = F.ln(F.greatest(ms.cast("double"), F.lit(LATENCY_LOW)) / LATENCY_LOW) / F.ln(F.lit(LATENCY_HIGH / LATENCY_LOW))
    return F.least(F.floor(place * LATENCY_BUCKETS), F.lit(LATENCY_BUCKETS - 1)).cast("int")


def latency_histogram(samples: DataFrame, ms: str) -> DataFrame:
    return samples.groupBy(latency_bucket(F.col(ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def problems(versions: DataFrame, edges: DataFrame, namespaces: DataFrame, now_ms: int) -> DataFrame:
    """(problem, n) for every broken rule of the tables; empty if all is well."""
    newest = latest(versions).where(live(now_ms))
    checks = {
        "live key owned twice": newest.where("key IS NOT NULL").groupBy("ns", "key").count().where("count > 1"),
        "sequence number used twice": versions.groupBy("seqno").count().where("count > 1"),
        "row of several namespaces": versions.groupBy("rowid").agg(F.count_distinct("ns").alias("n")).where("n > 1"),
        "weight outside 0 to 1": edges.where("weight IS NULL OR weight < 0 OR weight > 1"),
        "namespace not registered": newest.select("ns").distinct().join(
            namespaces.select(F.col("path").alias("ns")), "ns", "left_anti"
        ),
        "importance or confidence outside 0 to 1": newest.where(
            "importance NOT BETWEEN 0 AND 1 OR confidence NOT BETWEEN 0 AND 1"
        ),
    }
    found = None
    for name, rows in checks.items():
        part = rows.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
        found = part if found is None else found.unionByName(part)
    return found.where("n > 0")
