"""Sharding as vector bin packing: bytes, tokens and rows are balanced jointly.

A group (equal texts) is the unit that should stay together. Groups are summed up first; a group that is
large against a shard is an item of its own, and is dealt out in pieces if it is larger than a piece
may be; the many small groups are put together, by a hash of the group, into a fixed number of parcels. So
the packing itself sees a number of items that depends on the shards alone, however many rows there are.
Each item, largest first, goes to the shard whose residual capacity has the highest dot product with it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.session import write_stage

PARCELS_PER_SHARD = 512
# A group is an item of its own if it takes more than this share of a shard in bytes, tokens or rows.
LARGE_SHARE = 1 / 128
# No piece of a group is larger than this share of a shard.
PIECE_SHARE = 1 / 4
SIZE_DIMENSIONS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, bins: int, weights: np.ndarray) -> np.ndarray:
    """Bin of each item (rows: bytes, tokens, rows as shares of one bin), largest first.

    Ties go to the bin with the lower number, so the result depends on the items alone.
    """
    order = np.lexsort((np.arange(len(items)), -(items * weights).max(axis=1)))
    residual = np.ones((bins, items.shape[1]))
    chosen = np.zeros(len(items), dtype=np.int64)
    for i in order:
        best = int(np.argmax(residual @ (items[i] * weights)))
        chosen[i] = best
        residual[best] -= items[i]
    return chosen


def shard_documents(
    docs: DataFrame, bins: int = 24, text: str = "text", weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
) -> DataFrame:
    """(key, size, text_crc32, shard, slot): one row per document, ``key`` being ``doc_id``.

    ``size`` is the UTF-8 length of the text plus 8, ``slot`` counts the rows of a shard from 0 without
    gaps. A null text counts as empty (crc 0). Rows whose key is null or repeated are placed like all others,
    the order of equal rows within their shard being open. An empty table gives an empty result. Other
    columns of the input are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("_text_hash"),
        F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("_tokens"),
    )
    rows = write_stage(rows, "sized-rows")
    group = ["_text_hash", "size", "text_crc32"]
    groups = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.sum("_tokens").alias("tokens")).withColumn("bytes", F.col("rows") * F.col("size"))
    groups = write_stage(groups, "groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in SIZE_DIMENSIONS]).first()
    share = np.maximum(np.array([total[d] for d in SIZE_DIMENSIONS], dtype=float) / bins, 1e-9)

    portion = F.greatest(*[F.col(d) / F.lit(float(s)) for d, s in zip(SIZE_DIMENSIONS, share)])
    parcels = PARCELS_PER_SHARD * bins
    # At most 3 * bins / LARGE_SHARE groups are large, as each holds that share of one of three totals.
    large = groups.withColumn("_portion", portion).where(F.col("_portion") > LARGE_SHARE).select(
        *group, *SIZE_DIMENSIONS, F.least(F.ceil(F.col("_portion") / PIECE_SHARE), F.col("rows")).cast("int").alias("_pieces")
    ).orderBy(*group).toPandas()
    small = (
        groups.where(portion <= LARGE_SHARE)
        .groupBy(F.pmod(F.xxhash64(*group), F.lit(parcels)).cast("int").alias("parcel"))
        .agg(*[F.sum(d).alias(d) for d in SIZE_DIMENSIONS]).orderBy("parcel").toPandas()
    )
    pieces = large.loc[large.index.repeat(large["_pieces"])].reset_index(drop=True)
    pieces["_piece"] = pieces.groupby(group).cumcount() if len(pieces) else 0
    cut = pieces[list(SIZE_DIMENSIONS)].to_numpy(dtype=float) / pieces[["_pieces"]].to_numpy(dtype=float)
    items = np.concatenate([cut, small[list(SIZE_DIMENSIONS)].to_numpy(dtype=float)]) / share
    chosen = pack(items, bins, np.array(weights))

    schema = "_text_hash long, size long, text_crc32 long, _pieces int, _shards array<int>"
    own: dict[tuple, list[int]] = {}
    for row, shard in zip(pieces[group].itertuples(index=False, name=None), chosen[: len(pieces)].tolist()):
        own.setdefault(tuple(int(v) for v in row), []).append(shard)
    own_rows = [(*key, len(shards), shards) for key, shards in own.items()]
    parcel_shard = [0] * parcels
    for parcel, shard in zip(small["parcel"].tolist(), chosen[len(pieces):].tolist()):
        parcel_shard[parcel] = shard
    return _placed(spark, rows, group, spark.createDataFrame(own_rows, schema), parcel_shard, bins)


def _placed(spark: SparkSession, rows: DataFrame, group: list[str], own: DataFrame, parcel_shard: list[int], bins: int) -> DataFrame:
    """Shard and slot of every row; both tables on the small side have a bound that follows from ``bins``."""
    parcels = spark.createDataFrame(list(enumerate(parcel_shard)), "_parcel int, _parcel_shard int")
    placed = (
        rows.join(F.broadcast(own), group, "left")
        .withColumn("_parcel", F.pmod(F.xxhash64(*group), F.lit(len(parcel_shard))).cast("int"))
        .join(F.broadcast(parcels), "_parcel", "left")
    )
    # The rows of a group in pieces are numbered and dealt out in turn, so pieces differ by one row at most.
    cut = number_rows(placed.where("_pieces > 1"), group).withColumn("_piece", F.pmod("_number", "_pieces"))
    whole = placed.where("_pieces IS NULL OR _pieces = 1").withColumn("_piece", F.lit(0))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    shard = F.coalesce(F.element_at("_shards", (F.col("_piece") + 1).cast("int")), F.col("_parcel_shard"))
    parts = [part.withColumn("shard", shard).select(*columns) for part in (whole, cut)]
    numbered = number_rows(parts[0].unionByName(parts[1]), ["shard"])
    return numbered.select(*columns, F.col("_number").alias("slot"))


def number_rows(rows: DataFrame, keys: list[str], rows_per_part: int = 50_000) -> DataFrame:
    """Adds ``_number``, counting the rows of a key from 0 without gaps.

    A key is cut into parts by a hash of its rows; a part is numbered apart and moved by the rows of the parts before it, so
    that no task sorts a whole key.
    """
    stored = write_stage(rows, "rows-to-number")
    most = stored.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(64, -(-most // rows_per_part))
    stored = stored.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(3)), F.lit(parts)))
    counts = stored.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy("doc_id", "text_crc32", "size")
    return (
        stored.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_part"])
        .withColumn("_number", F.col("_start") + F.col("_rank"))
        .drop("_part", "_start", "_rank")
    )
