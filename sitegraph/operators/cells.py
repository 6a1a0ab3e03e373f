"""Approximate search by an inverted index whose cells are learnt from the vectors.

Cells are the centroids of a k-means run over a documented sample; their number follows from the number of vectors. Each
vector is listed in its nearest cells, each query looks into its nearest ones, and cells meet queries block by block
(``search.block_search``), so neither side passes the driver. All comparisons of distances are made in whole numbers (unit
vectors times ``scale``, rounded down), so that any engine finds the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.operators.search import checked_queries, matrix_of, rank_hits, unit_rows, block_search
from sitegraph.session import stage_scope, write_stage

SCALE = 1024
# Cells per square root of the number of vectors, and bounds of their number.
CELLS_PER_ROOT, MOST_CELLS = 3.0, 4096
# Vectors that train a cell, on average; beyond that a sample by hash is taken.
SAMPLE_PER_CELL = 256
ROUNDS = 6
# Cells that a vector is listed in, and that a query looks into.
COPIES, PROBES = 2, 2
STEP_DISTANCES = 4_000_000


@dataclass(frozen=True)
class TrainedCells:
    """Centroids in whole numbers, one row per cell."""

    centroids: np.ndarray
    scale: int = SCALE

    def points(self, matrix: np.ndarray) -> np.ndarray:
        return np.floor(unit_rows(matrix) * self.scale)

    def nearest(self, points: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first, ties by number. All sums stay exact in doubles: components are at most ``scale``."""
        c = self.centroids.astype(np.float64)
        sizes = (c * c).sum(axis=1)
        step = max(1, STEP_DISTANCES // len(c))
        found = [np.zeros((0, min(n, len(c))), np.int64)]
        for at in range(0, len(points), step):
            part = points[at : at + step]
            # The row's own square is the same for all cells.
            found.append(np.argsort(sizes - 2.0 * (part @ c.T), axis=1, kind="stable")[:, :n])
        return np.concatenate(found)


def usable(column: str) -> Column:
    """Vectors with a direction: not null, not empty, without null or non-finite values, not zero."""
    value = F.col(column)
    finite = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def place_of(column: str) -> Column:
    """A number from 0 to 1 that follows from the id, for samples and starts that do not depend on the layout."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("double") / 2**32


def train_cells(vectors: DataFrame, column: str = "page_vector", key: str = "page_id", cells: int | None = None, rounds: int = ROUNDS) -> TrainedCells:
    """Cells for the usable vectors of a table; ``None`` for a table without any.

    The sample holds the rows whose ``place_of`` the key is below ``cells * SAMPLE_PER_CELL`` over the number of vectors: all of
    them if there are few. Starts are the ``cells`` rows of the smallest place (then key). A round moves each centroid to the
    floor of the mean of its vectors; a cell without any keeps its own. One row per cell comes to the driver.
    """
    spark = vectors.sparkSession
    with stage_scope(spark):
        rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v")).where(usable("v"))
        count = rows.count()
        k = cells or int(min(MOST_CELLS, max(1, round(CELLS_PER_ROOT * count**0.5))))
        share = min(1.0, k * SAMPLE_PER_CELL / max(count, 1))
        place = F.coalesce(place_of("key"), F.lit(0.0))
        sample = write_stage(rows.where(place <= share).select("key", place.alias("place"), "v"), "cell-sample")
        first = sample.orderBy("place", "key", "v").limit(k).select("v").toArrow()
        if not first.num_rows:
            raise ValueError("no vector to train cells with")
        found = TrainedCells(np.zeros((0, 0)))
        found = TrainedCells(found.points(matrix_of(first.column(0))))
        for _ in range(rounds):
            found = TrainedCells(_moved(sample, found))
    return found


def _moved(sample: DataFrame, cells: TrainedCells) -> np.ndarray:
    shared = sample.sparkSession.sparkContext.broadcast(cells)
    k, dim = cells.centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, count = shared.value, np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                points = held.points(matrix_of(batch.column(0)))
                at = held.nearest(points, 1)[:, 0]
                np.add.at(total, at, points.astype(np.int64))
                count += np.bincount(at, minlength=k)
        used = np.flatnonzero(count)
        places = np.repeat(used, dim), np.tile(np.arange(dim), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(places[0]), pa.array(places[1]), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], dim))], ["cell", "i", "total", "n"])

    parts = sample.select("v").mapInArrow(sums, "cell long, i long, total long, n long")
    rows = parts.groupBy("cell", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    cell, i, total, n = (column.to_numpy() for column in rows.columns)
    centroids = cells.centroids.astype(np.int64)
    centroids[cell, i] = total // n
    return centroids.astype(np.float64)


def with_trained_cells(vectors: DataFrame, cells: TrainedCells, n: int, column: str) -> DataFrame:
    """A row with ``cell`` for each usable vector and each of its ``n`` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf("array<long>")
    def nearest(batch):
        import pandas as pd

        held = shared.value
        return pd.Series(list(held.nearest(held.points(np.array(batch.tolist(), dtype=np.float64)), n)))

    kept = vectors.where(usable(column))
    return kept.withColumn("cell", F.explode(nearest(F.col(column))))


@dataclass(frozen=True)
class CellIndex:
    """Cells and the table of vectors listed in them (page_id, page_vector, cell)."""

    cells: TrainedCells
    lists: DataFrame


def write_cell_index(pages: DataFrame, path: str, cells: TrainedCells | None = None, copies: int = COPIES, column: str = "page_vector") -> None:
    """Lists every usable vector of ``pages`` in its ``copies`` nearest cells, below ``path``, partitioned by cell.

    Pages without a usable vector resemble no query and are left out. The rebalance hint lets AQE split a cell of very many vectors.
    """
    spark = pages.sparkSession
    cells = cells or train_cells(pages, column)
    rows = [(i, cells.scale, row) for i, row in enumerate(cells.centroids.astype(np.int64).tolist())]
    spark.createDataFrame(rows, "cell long, scale int, centroid array<long>").write.parquet(f"{path}/centroids")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(column).alias("page_vector"))
    with_trained_cells(narrow, cells, copies, "page_vector").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/lists")


def read_cell_index(spark: SparkSession, path: str) -> CellIndex:
    """The index at ``path``; its centroids, a bounded number, are read by the driver."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    cells = TrainedCells(np.array([row["centroid"] for row in rows], dtype=np.float64), rows[0]["scale"])
    return CellIndex(cells, spark.read.schema("page_id long, page_vector array<double>, cell long").parquet(f"{path}/lists"))


def probed(queries: DataFrame, index: CellIndex, probes: int) -> DataFrame:
    """(query_id, query_vector, cell): each query in its nearest cells."""
    asked, _, _ = checked_queries(queries)
    return with_trained_cells(asked, index.cells, probes, "query_vector")


def search_cells(queries: DataFrame, index: CellIndex, k: int = rules.TOP_K, probes: int = PROBES) -> DataFrame:
    """Top ``k`` pages for every query among the lists of its ``probes`` nearest cells: query_id, rank, page_id, score.

    Queries without a direction (all zero) have no hits; null ids or vectors are an error. Only the cells some query looks into are read.
    """
    asked = write_stage(probed(queries, index, probes), "probed-queries")
    wanted = [row["cell"] for row in asked.select("cell").distinct().collect()]  # bounded by the number of cells
    lists = index.lists.where(F.col("cell").isin(wanted)).select("page_id", F.lit(0).cast("long").alias("chunk_index"), F.col("page_vector").alias("v"), "cell")
    hits = block_search(asked, lists, k)
    return rank_hits(hits, k).select("query_id", "rank", "page_id", "score")


def compared_pairs(queries: DataFrame, index: CellIndex, probes: int = PROBES) -> DataFrame:
    """One row: the pairs of a query and a listed vector that a search compares."""
    asked = probed(queries, index, probes).groupBy("cell").agg(F.count("*").alias("asked"))
    listed = index.lists.groupBy("cell").agg(F.count("*").alias("listed"))
    return asked.join(listed, "cell").agg(F.coalesce(F.sum(F.col("asked") * F.col("listed")), F.lit(0)).alias("compared_pairs"))
