"""Benchmark decontamination with spaced seeds.

A document leaks a benchmark item if some ``WIDTH`` words in a row of it equal words of the item at the same
places but for at most ``SUBSTITUTIONS``. The six masks look at two of four blocks of a window each, so any
two substitutions leave one mask untouched: no such window is missed. An item with fewer words must occur
whole and unchanged; items of fewer than ``SHORTEST`` words are no evidence and match nothing.

Windows of documents pass a hashed table of the seeds (fixed size) before they leave their task; what is
left is joined with the seeds, and the words around each hit are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.words import WordHasher, position_factors, sequence_hash
from sitegraph.session import map_texts, sized_side, write_stage

WIDTH, SUBSTITUTIONS, SHORTEST = 13, 2, 5
BLOCKS = [range(0, 3), range(3, 6), range(6, 9), range(9, 13)]
TABLE_BITS = 22


def masks(width: int) -> list[list[int]]:
    """Positions that each mask looks at."""
    if width < WIDTH:
        return [list(range(width))]
    return [[*a, *b] for a, b in combinations(BLOCKS, 2)]


def mask_factors(width: int) -> list[np.ndarray]:
    out = []
    for number, positions in enumerate(masks(width)):
        factors = np.zeros(width, dtype=np.uint64)
        factors[positions] = position_factors(WIDTH, seed=10 + 16 * width + number)[positions]
        out.append(factors)
    return out


def benchmark_seeds(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(key, item, item_pos, item_words, width, item_window): one row per item, position and mask."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = []
            for name, words in zip(batch.column(0).to_pylist(), hasher.each(batch.column(1).to_pylist())):
                width = min(WIDTH, len(words))
                if width < SHORTEST:
                    continue
                for factors in mask_factors(width):
                    for at, key in enumerate(sequence_hash(words, factors).view(np.int64).tolist()):
                        rows.append((key, name, at, len(words), width, words[at : at + width].view(np.int64).tolist()))
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["key", "item", "item_pos", "item_words", "width", "item_window"],
            )

    kind = benchmark.schema[item].dataType.simpleString()
    return map_texts(
        benchmark.select(item, text), seeds, f"key long, item {kind}, item_pos int, item_words int, width int, item_window array<long>"
    )


def seed_hits(docs: DataFrame, widths: list[int], table: np.ndarray, text: str) -> DataFrame:
    """(doc_id, text_hash, pos, key, window): windows of documents whose seed is in the hashed table."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), shared.value
        factors = [(width, f) for width in widths for f in mask_factors(width)]
        for batch in batches:
            for first, words, counts in hasher.blocks(batch.column(2).to_pylist()):
                owner = np.repeat(np.arange(len(counts)), counts)
                starts = np.concatenate([[0], np.cumsum(counts)])
                for width, f in factors:
                    keys = sequence_hash(words, f)
                    at = np.flatnonzero(known[(keys >> np.uint64(64 - TABLE_BITS)).view(np.int64)])
                    at = at[owner[at] == owner[at + width - 1]]
                    if not len(at):
                        continue
                    rows = pa.array(first + owner[at])
                    windows = words[at[:, None] + np.arange(width)].view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, windows.size + 1, width), pa.int32()), pa.array(windows.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - starts[owner[at]], pa.int64()),
                         pa.array(keys[at].view(np.int64)), lists],
                        ["doc_id", "text_hash", "pos", "key", "window"],
                    )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_texts(rows, hits, "doc_id long, text_hash long, pos long, key long, window array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item, item_words, n_windows, best_matches, n_covered): one row per document and leaked item.

    ``n_windows`` counts the item's positions at which a window was found, ``best_matches`` the equal words of the
    best one, ``n_covered`` the item's words inside found windows. Null and empty texts on either side match
    nothing; repeated rows count once; an empty table on either side gives no rows. Other columns are not read.
    """
    seeds = write_stage(benchmark_seeds(benchmark, item, item_text), "seeds")
    # Both are bounded: by the number of widths, and by the size of the hashed table.
    widths = [row["width"] for row in seeds.select("width").distinct().collect()]
    places = seeds.select(F.shiftrightunsigned("key", 64 - TABLE_BITS).cast("int").alias("place")).distinct().toPandas()["place"]
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[places.to_numpy(dtype=np.int64)] = True
    hits = seed_hits(docs, sorted(widths), table, text)
    equal = F.aggregate(
        F.zip_with("window", "item_window", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda total, one: total + one
    )
    allowed = F.when(F.col("width") == WIDTH, SUBSTITUTIONS).otherwise(0)
    found = (
        hits.join(sized_side(seeds), "key").where(F.size("window") == F.col("width"))
        .withColumn("matches", equal).where(F.col("matches") >= F.col("width") - allowed)
    )
    by_item = found.groupBy("doc_id", "text_hash", "item").agg(
        F.max("item_words").alias("item_words"), F.max("matches").alias("best_matches"),
        F.max("width").alias("width"), F.sort_array(F.collect_set("item_pos")).alias("at"),
    )
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("width") - 1))))
    return by_item.select(
        "doc_id", "text_hash", "item", "item_words", F.size("at").alias("n_windows"), "best_matches", F.size(covered).alias("n_covered"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that leak no item, with their columns; repeated rows and nulls stay."""
    leaks = contaminated(docs, benchmark, text).select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    leaks = sized_side(write_stage(leaks, "leaks"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__leak_id")) & (F.xxhash64(text) == F.col("__leak_hash"))
    return docs.join(leaks, same, "left_anti")
