"""Session settings, lineage cutting and size-checked broadcasts shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

Batches = Iterator[pa.RecordBatch]

# A side is broadcast only when a count has shown that it stays below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Texts go to Python in batches of at most so many bytes, or of one row.
BATCH_BYTES = 4 * 1024 * 1024


def build_session(app: str = "sitegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; any of them can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stage tables that every executor can read.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sitegraph-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never replays earlier rounds."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class _Scope:
    """Paths of the stage tables written inside a scope, and the scope around it."""

    def __init__(self, outer: _Scope | None) -> None:
        self.outer = outer
        self.paths: list[str] = []


# Of the present thread: streams run their batches in threads, and each has stages of its own.
_scope: ContextVar[_Scope | None] = ContextVar("stage_scope", default=None)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Stage tables written inside are deleted at the end, but for those that are kept: for work whose result is stored by then."""
    scope = _Scope(_scope.get())
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in scope.paths:
            drop_stage(spark, path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Deletes a stage table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_stage(
    df: DataFrame, name: str, path: str | None = None, keep: bool = False, parted_by: str | None = None
) -> DataFrame:
    """Writes a stage as a Parquet table in the shared folder and reads it back.

    Used instead of ``checkpoint`` for wide rows: later reads stay columnar, so a job that needs two
    narrow columns does not read the page bodies again. ``keep``: the table outlives the scope it is written in and
    belongs to the scope around it, as the result of a job does. ``parted_by``: a last column of few values, one folder per
    value, so that a filter on it reads that part alone.
    """
    path = path or scratch_path(df.sparkSession, name)
    scope = _scope.get()
    if scope and keep:
        scope = scope.outer
    if scope:
        scope.paths.append(path)
    (df.write.partitionBy(parted_by) if parted_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, function: Callable[[Batches], Batches], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over rows that hold texts, in batches of at most ``BATCH_BYTES``.

    Spark's own bounds are 10,000 rows and 64 MB: a whole partition of texts is one batch then, and executor and worker hold it
    several times over. The bound is the session's and holds from now on, also when the result is read later; one
    that the session was given stays.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def join_side(df: DataFrame) -> DataFrame:
    """Prepares the smaller side of a join on its key: stores it once, then as ``sized_side``."""
    return sized_side(write_stage(df, "join-side"))


def sized_side(stored: DataFrame) -> DataFrame:
    """Adds a broadcast hint to a stored or checkpointed side that a count proves to be small.

    Beyond the bounds both sides of the join are shuffled. Since a stored side is shuffled as it is,
    without an aggregate or another join in between, AQE can then split a hot key of the other side.
    """
    sizes = [_bytes_of(F.col(f"`{field.name}`"), field.dataType) for field in stored.schema.fields]
    rows, size = stored.agg(F.count("*"), F.coalesce(F.sum(reduce(Column.__add__, sizes)), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return F.broadcast(stored) if small else stored


def _bytes_of(value: Column, kind: DataType) -> Column:
    """About the bytes of a value in a row, with all that is nested in it."""
    fixed = F.lit(16).cast("long")
    if isinstance(kind, (StringType, BinaryType)):
        return fixed + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, VariantType):
        return fixed + F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    if isinstance(kind, StructType):
        return reduce(Column.__add__, [_bytes_of(value.getField(f.name), f.dataType) for f in kind.fields], fixed)
    if isinstance(kind, MapType):
        return fixed + _bytes_of(F.map_keys(value), ArrayType(kind.keyType)) + _bytes_of(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, VariantType, StructType, MapType, ArrayType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes_of(x, kind.elementType))
            return fixed + F.coalesce(inner, F.lit(0))
        return fixed + F.coalesce(F.greatest(F.size(value), F.lit(0)) * 8, F.lit(0))
    return fixed
