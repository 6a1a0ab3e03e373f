"""Token counts per document of flat token files that have no index.

A token file is nothing but 16-bit little-endian ids, documents ending with a separator id. Files are cut into blocks
of a fixed number of tokens without looking at what is in them; a task finds the separators of a block by one vectorised
comparison. A prefix scan over the blocks of a file then gives each block the tokens before it and the place of the
last separator before it, which stitches documents that run over block borders, however many blocks they fill.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.session import write_stage

BLOCK_TOKENS = 1 << 16
# Tokens after which a writer closes a file; a file ends after a document.
FILE_TOKENS = 1 << 21
# Of listed files: bytes that a task reads, about, bytes that stay together, and blocks whose places are held at once.
TASK_BYTES, STRETCH_BYTES, READ_ROWS = 1 << 26, 1 << 23, 64


class RankEncoder:
    """Byte-pair encoder of a rank file, by an installed library; built in the task from the file's bytes."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.array(self.encoding.encode_ordinary(text), dtype="<u2")
        except UnicodeEncodeError:
            return np.array(self.encoding.encode_ordinary(text.encode("utf-8", "replace").decode()), dtype="<u2")


def token_files(docs: DataFrame, ranks: bytes, pattern: str, separator: int, text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """(path, content): the texts as flat token files, in the shape in which Spark's ``binaryFile`` source gives files.

    A task writes its rows in order, each with the separator after it; a null text is a document of no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def write(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(*shared.value)
        parts, size, count, name = [], 0, 0, None
        end = np.array([separator], dtype="<u2")

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"tokens-{name:06d}-{count:06d}"]), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["path", "content"])

        for batch in numbers:
            for task, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = task
                tokens = encoder.encode(body.as_py() or "")
                parts += [tokens, end]
                size += len(tokens) + 1
                if size >= file_tokens:
                    yield close()
                    parts, size, count = [], 0, count + 1
        if parts:
            yield close()

    return docs.select(F.spark_partition_id().alias("task"), F.col(text).alias("text")).mapInArrow(write, "path string, content binary")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the token files below a folder: nothing is read but the listing. Tasks read the byte ranges of their
    blocks from the store (local or mounted folders, HDFS, S3, Google Cloud Storage); a ``viewfs`` folder is resolved first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    resolved = folder.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(folder).toString()
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(resolved).select("path", "length")


def opened(path: str) -> pa.NativeFile:
    """A listed file, opened for reading at any place."""
    scheme, rest = path.split(":", 1) if ":" in path else ("file", path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, inner = rest.lstrip("/").partition("/")
    if scheme in ("s3", "s3a", "s3n", "gs"):
        scheme, inner = "gs" if scheme == "gs" else "s3", f"{host}/{inner}"
    else:
        inner = f"/{inner}"
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0].open_input_file(inner)


def ranges_of(listed: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, block, offset, size): the byte ranges of the blocks of (path, length) files, spread over tasks of about ``TASK_BYTES``."""
    tokens = F.floor(F.col("length") / 2)
    last = F.ceil(tokens / block_tokens).cast("int") - 1
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cut = listed.select("path", tokens.alias("n"), F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("block"))
    start = F.col("block").cast("long") * block_tokens
    ranges = cut.select("path", "block", (start * 2).alias("offset"), (F.least(F.lit(block_tokens).cast("long"), F.col("n") - start) * 2).alias("size"))
    # Neighbouring blocks of a file stay together, in stretches far smaller than what a task reads.
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    return ranges.repartition(-(-total // TASK_BYTES) or 1, "path", stretch).sortWithinPartitions("path", "block")


def blocks_of(files: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, block, tokens): the files cut into blocks. A last odd byte is not a token and is left out."""
    tokens = F.floor(F.octet_length("content") / 2)
    last = F.ceil(tokens / block_tokens).cast("int") - 1
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last))
    cut = files.select("path", "content", tokens.alias("n"), F.explode(numbers).alias("block"))
    length = F.least(F.lit(block_tokens).cast("long"), F.col("n") - F.col("block").cast("long") * block_tokens)
    return cut.select(
        "path", "block",
        F.substring(F.col("content"), (F.col("block") * 2 * block_tokens + 1).cast("int"), (length * 2).cast("int")).alias("tokens"),
    )


def found_in(batch: pa.RecordBatch, bodies: Iterator, separator: int) -> pa.RecordBatch:
    """The result rows of a batch whose first columns are path and block, with the bytes of the blocks."""
    sizes, places = [], []
    for body in bodies:
        ids = np.frombuffer(body, dtype="<u2")
        sizes.append(len(ids))
        places.append(np.flatnonzero(ids == separator).astype(np.int32))
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]), pa.int32())
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *places]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)],
        ["path", "block", "n_tokens", "at"],
    )


def find_separators(blocks: DataFrame, separator: int) -> DataFrame:
    """(path, block, n_tokens, at): the number of tokens of each block and the places of its separators. Blocks come with their
    ``tokens`` or as the ``offset`` and ``size`` of a range."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield found_in(batch, (body.as_buffer() for body in batch.column(2)), separator)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None

        def body(path: str, offset: int, size: int) -> bytes:
            nonlocal name, file
            if path != name:
                if file is not None:
                    file.close()
                name, file = path, opened(path)
            data = file.read_at(size, offset)
            if len(data) != size:
                raise OSError(f"{path} has {len(data)} of {size} bytes at {offset}")
            return data

        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(at, READ_ROWS)
                yield found_in(part, (body(*r) for r in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)))), separator)

    return blocks.mapInArrow(read if "offset" in blocks.columns else find, "path string, block int, n_tokens long, at array<int>")


def document_lengths(files: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, document, start, n_tokens, closed): one row per document of files (path, content) or listed ones (path, length).

    ``document`` counts from 0 within a file, ``start`` is its first token, ``n_tokens`` leaves the separator out.
    Tokens after the last separator are a document that is not ``closed``. Two separators in a row enclose a document
    of no tokens. A null or empty file has no rows; files are told apart by path, so rows with the same path must not repeat.
    """
    cut = blocks_of if "content" in files.columns else ranges_of
    found = write_stage(find_separators(cut(files, block_tokens), separator), "separators")
    # The scan goes over two numbers per block, and a file is bounded; the places stay with their block.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = found.select("path", "block", "n_tokens", F.size("at").alias("n_at"), F.try_element_at("at", F.lit(-1)).alias("last_at"))
    carried = (
        narrow.withColumn("_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .withColumn("_documents", F.coalesce(F.sum("n_at").over(before), F.lit(0)))
        .withColumn("_last", F.col("_start") + F.col("last_at"))
        .withColumn("_before", F.coalesce(F.last("_last", ignorenulls=True).over(before), F.lit(-1)))
        .withColumn("_end", F.max(F.col("_start") + F.col("n_tokens")).over(Window.partitionBy("path")))
        .withColumn("_tail", F.max("_last").over(Window.partitionBy("path")))
    )
    carried = carried.select("path", "block", "_start", "_documents", "_before", "_end", "_tail")
    def document(place, i):
        previous = F.when(i == 0, F.col("_before")).otherwise(F.col("_start") + F.try_element_at("at", F.greatest(i, F.lit(1))))
        return F.struct(
            (F.col("_documents") + i).alias("document"), (previous + 1).alias("start"),
            (F.col("_start") + place - previous - 1).alias("n_tokens"),
        )

    # Rows are made of the finished structs, so that no row carries its block's places along.
    each = found.join(carried, ["path", "block"]).select("path", F.explode(F.transform("at", document)).alias("d"))
    closed = each.select("path", "d.*", F.lit(True).alias("closed"))
    ends = carried.groupBy("path").agg(F.max("_end").alias("end"), F.coalesce(F.max("_tail"), F.lit(-1)).alias("tail"))
    counts = found.groupBy("path").agg(F.sum(F.size("at")).cast("long").alias("document"))
    rest = ends.join(counts, "path").where("end > tail + 1").select(
        "path", "document", (F.col("tail") + 1).alias("start"), (F.col("end") - F.col("tail") - 1).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)
