"""Stored pages and chunks: Parquet partitioned by key bucket and version.

A write adds a new version of the buckets it touches and then one row per bucket to a small commit
table, with the streaming query and micro-batch it comes from. Readers take the newest committed version of each bucket, so a crash between the two steps
leaves the old state and folders that no one reads, and nothing being read is replaced. One writer at a
time.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph.session import drop_stage

COMMIT_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("filled", T.BooleanType()),
    T.StructField("query", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any file system Spark can read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [status.getPath().toString() for status in statuses or []]


def commits(spark: SparkSession, path: str) -> DataFrame:
    log = f"{path}/commits"
    if not _found(spark, log):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(log)


def is_committed(spark: SparkSession, path: str, query: str, batch_id: int) -> bool:
    """Whether a streaming query has committed this micro-batch, or a later one, to the store."""
    newest = commits(spark, path).where(F.col("query") == query).agg(F.max("batch_id")).first()[0]
    return newest is not None and newest >= batch_id


def next_version(spark: SparkSession, path: str) -> int:
    """Larger than every committed version, and never one that a crashed write has used."""
    newest = commits(spark, path).agg(F.max("version")).first()[0]
    return max(int(time.time() * 1000), 0 if newest is None else newest + 1)


def read_store(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The current rows, or those of some buckets only.

    Only the folders of current versions are listed, never the superseded ones. Their number is
    bounded by the bucket count of the store.
    """
    log = commits(spark, path)
    if buckets is not None:
        log = log.filter(F.col("bucket").isin(buckets))
    current = log.groupBy("bucket").agg(F.max(F.struct("version", "filled")).alias("newest")).collect()
    folders = [
        f"{path}/data/bucket={row['bucket']}/version={row['newest']['version']}" for row in current if row["newest"]["filled"]
    ]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(folders))


def touched_buckets(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets`` small integers."""
    found = rows.select(bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect()
    return sorted(row["bucket"] for row in found)


def _check_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    """The bucket count belongs to a store: it is written with the first version, and another one is refused."""
    settings = f"{path}/settings"
    if not _found(spark, f"{settings}/_SUCCESS"):
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(settings)
        return
    known = spark.read.schema("buckets int").parquet(settings).first()["buckets"]
    if known != buckets:
        raise ValueError(f"the store at {path} has {known} buckets, not {buckets}")


def write_version(
    rows: DataFrame, path: str, key: str, touched: list[int], buckets: int, query: str | None = None, batch_id: int | None = None
) -> None:
    """Writes the full new content of the touched buckets, then commits them, with the micro-batch they come from.

    Rows are shuffled by bucket, so that a bucket is written by one task, or by several where AQE
    splits a large one (the rebalance hint allows that), and not by every task.
    """
    spark = rows.sparkSession
    _check_buckets(spark, path, buckets)
    version = next_version(spark, path)
    (
        rows.withColumn("bucket", bucket_of(F.col(key), buckets))
        .withColumn("version", F.lit(version).cast("long"))
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "version")
        .parquet(f"{path}/data")
    )
    # A touched bucket may have become empty; then it has no folder.
    written = _found(spark, f"{path}/data/bucket=*/version={version}")
    filled = {int(folder.split("/bucket=")[1].split("/")[0]) for folder in written}
    entries = F.array(*[F.struct(F.lit(bucket).alias("bucket"), F.lit(bucket in filled).alias("filled")) for bucket in touched])
    done = spark.range(1).select(F.lit(version).cast("long").alias("version"), F.inline(entries))
    done = done.withColumn("query", F.lit(query).cast("string")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    done.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def drop_superseded(spark: SparkSession, path: str, before: int) -> int:
    """Deletes the folders of versions below ``before`` that a later one has replaced, and gives their number.

    ``before`` is a version, that is, a time in milliseconds: choose one that no reader still uses.
    """
    log = commits(spark, path)
    current = {(row["bucket"], row["newest"]) for row in log.groupBy("bucket").agg(F.max("version").alias("newest")).collect()}
    dropped = 0
    for folder in _found(spark, f"{path}/data/bucket=*/version=*"):
        bucket, version = (int(part.split("=")[1]) for part in folder.split("/")[-2:])
        if version < before and (bucket, version) not in current:
            drop_stage(spark, folder)
            dropped += 1
    return dropped
