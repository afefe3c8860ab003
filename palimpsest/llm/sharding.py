"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the key. A bucket
whose rows exceed the byte limit splits on the next bit, and only such buckets
split, until every shard fits; so a shard is the shortest prefix whose rows fit.
Rows of equal keys share all bits of the key's hash and could never be parted,
so further bits come from a hash of each row's place, and a key that holds any
share of the rows splits all the same.

Defined results: a null text has no bytes; a null key is a key like any other; a
single row larger than the limit gets a shard of its own, with fits = false; an
empty table gives no shards; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.common import fresh, saved

LIMIT_BYTES = 16 << 20
#: The query's limit: so small that tables of any size split, at several depths.
REPORT_BYTES = 256 << 10
#: Bits of the key's hash, then of the row's.
KEY_BITS = 60
STEP_BITS = 8


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 digest of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _bits(number: Column, digits: int = KEY_BITS) -> Column:
    return F.lpad(F.bin(number), digits, "0")


def _depths(sizes: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """For each prefix of `last` bits, the fewest bits (from `first`) whose rows fit, or null."""
    levels = sizes.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
    levels = levels.withColumn("head", F.expr("substring(prefix, 1, depth)"))
    totals = levels.groupBy("depth", "head").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fitting = totals.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    return levels.join(fitting, ["depth", "head"]).groupBy("prefix").agg(
        F.min_by(F.struct("depth", "shard_bytes", "shard_rows"), "depth").alias("leaf")
    )


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES, columns: list[str] | None = None) -> DataFrame:
    """Adds shard (its prefix in bits), shard_depth, shard_bytes and fits to `columns` of `docs`.

    First the sizes of all prefixes of about four times as many buckets as the
    limit asks for are summed, which combines before the shuffle; rows in
    buckets that still don't fit go on, eight bits at a time, and they alone.
    """
    columns = docs.columns if columns is None else columns
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint")
    path = F.concat(_bits(key_hash(F.col(key))), _bits(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)))
    rows = saved(
        docs.select(*columns, path.alias(fresh(docs, "_path")), size.alias(fresh(docs, "_bytes"))), "sharding"
    )
    path_name, bytes_name = rows.columns[-2:]
    prefix_name, leaf_name = fresh(rows, "_prefix"), fresh(rows, "_leaf")
    total = rows.agg(F.coalesce(F.sum(bytes_name), F.lit(0))).first()[0]
    last = min(KEY_BITS, max(0, -(-total // limit)).bit_length() + 2)
    first, rest, done = 0, rows, []
    while True:
        sizes = rest.groupBy(F.substring(path_name, 1, last).alias("prefix")).agg(
            F.sum(bytes_name).alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        leaves = saved(_depths(sizes, first, last, limit), "directory")
        placed = rest.join(
            leaves.withColumnRenamed("prefix", prefix_name).withColumnRenamed("leaf", leaf_name),
            F.substring(path_name, 1, last) == F.col(prefix_name), "left",
        )
        done.append(placed.where(F.col(leaf_name).isNotNull()))
        covered, wanted = leaves.count(), sizes.count()
        if covered == wanted or last >= 2 * KEY_BITS:
            if covered != wanted:
                raise RuntimeError("rows share all bits of their hashes")
            break
        rest = saved(placed.where(F.col(leaf_name).isNull()).select(*rows.columns), "sharding")
        first, last = last + 1, min(2 * KEY_BITS, last + STEP_BITS)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    leaf = F.col(leaf_name)
    return out.select(
        *columns,
        F.substring(F.col(path_name), F.lit(1), leaf["depth"]).alias(fresh(docs, "shard")),
        leaf["depth"].alias(fresh(docs, "shard_depth")),
        leaf["shard_bytes"].alias(fresh(docs, "shard_bytes")),
        (leaf["shard_bytes"] <= limit).alias(fresh(docs, "fits")),
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Writes the rows as one folder of Parquet files a shard, and returns them from there.

    Rows are dealt out by shard, which holds at most `limit` bytes of text.
    """
    placed = assign(docs, key, text, limit)
    shard = fresh(docs, "shard")
    named = placed.withColumn(shard, F.concat(F.lit("b"), F.col(shard)))
    named.repartition(shard).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.parquet(path)


def report(docs: DataFrame, limit: int = REPORT_BYTES) -> DataFrame:
    """Per document its shard."""
    return assign(docs, limit=limit, columns=["doc_id"])


def oracle_sql(limit: int = REPORT_BYTES) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n,
             lpad(to_binary(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), {KEY_BITS}, '0') AS path
           FROM documents),
l AS (SELECT doc_id, n, depth, left(path, depth) AS shard FROM d, range(0, {KEY_BITS} + 1) AS r(depth)),
t AS (SELECT depth, shard, CAST(sum(n) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY ALL),
f AS (SELECT doc_id, min(depth) AS depth FROM l JOIN t USING (depth, shard) WHERE shard_bytes <= {limit} OR shard_rows = 1 GROUP BY doc_id)
SELECT l.doc_id, l.shard, CAST(l.depth AS INTEGER) AS shard_depth, t.shard_bytes, t.shard_bytes <= {limit} AS fits
FROM f JOIN l USING (doc_id, depth) JOIN t USING (depth, shard)
"""
