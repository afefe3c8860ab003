"""Intermediate results in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only with a local master, as in
    tests, a temporary folder takes its place; a cluster's executors couldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_palimpsest_shared_dir", None)
        if base is None:
            master = spark.sparkContext.master
            if not re.match(r"local($|\[)", master):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
            base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
            spark.sparkContext._palimpsest_shared_dir = base
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again.

    This cuts the lineage with files that outlive any executor. They stay until
    `remove_saved` or the end of the driver's process.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    _made(spark).append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._palimpsest_path = path
    return found


def _made(spark: SparkSession) -> list[str]:
    """Paths that this process has made; those that are left are removed when it ends."""
    made = getattr(spark.sparkContext, "_palimpsest_made", None)
    if made is None:
        made = spark.sparkContext._palimpsest_made = []
        atexit.register(_remove_all, spark, made)
    return made


def _remove_all(spark: SparkSession, made: list[str]) -> None:
    for path in made:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; then its folder's owner cleans up
            return


def remove_saved(df: DataFrame) -> None:
    """Removes the files of a frame that `saved` gave and that nothing will read again."""
    path = df._palimpsest_path
    made = _made(df.sparkSession)
    if path in made:
        made.remove(path)
    remove_path(df.sparkSession, path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API, for any store that Spark can reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_path(spark: SparkSession, path: str) -> None:
    filesystem, target = hadoop_path(spark, path)
    filesystem.delete(target, True)


def numbered(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """`df` saved with a dense column `ord` from 0 in its own order, and its number of rows.

    Tasks number their rows alone; the driver gets one count a task.
    """
    raw = saved(df.withColumn("_at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_at", 33).cast("int")
    counts = {r[0]: r[1] for r in raw.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    offsets = F.create_map(*(F.lit(x) for item in starts.items() for x in item)) if starts else None
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    first = F.lit(0) if offsets is None else F.element_at(offsets, part)
    return raw.withColumn("ord", (first + place).cast("bigint")).drop("_at"), total
