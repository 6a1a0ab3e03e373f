"""Near duplicates among embeddings by NN-descent.

1. Equal vectors of a label become one node that counts its copies. Every node gets a list of neighbours: the best of
   small groups of nodes on the same side of random planes.
2. Lists are refined by joins of neighbours of neighbours: the neighbours of a node, either way, are compared with
   each other, and whoever is better than the last of a list enters it, until hardly any list changes. Nodes around which
   nothing is new since the round before are left out, as all their pairs were compared then.
3. List entries near the threshold join nodes to candidate groups. From then on a node has one list for its own group and
   one for all others, so that a dense group never fills the places of what lies beside it. Planes are drawn and lists
   refined again until no groups are joined any more.
4. Inside a group the links are worked out exactly, in double precision, in blocks of rows, so a group of any size is
   never gathered. Blocks follow the angle to a pivot: pairs of blocks that hold no link, or nothing but links, are not compared.
5. Recall is audited: vectors drawn from groups of every size are compared with all others. While too few of their true
   links lie inside groups, more planes are drawn; a run that stays below ``RECALL`` fails.

Lists are refined on vectors rounded to 8 bits (one byte per component in a shuffle); links never are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.components import connected_components
from sitegraph.session import write_stage

COSINE = 0.98
# Rounded to 8 bits, a cosine is off by less than this.
MARGIN = 0.01
NEIGHBOURS = 10
GROUP = 64
TREES = 3
# Rows of a block of exact comparisons, members that a pivot is the mean of, steps in which angles (0 to 4) are counted.
BLOCK = 1024
PIVOT_OF = 8
STEPS = 1 << 16
# Angles are trusted up to this much; pairs nearer to a bound are compared.
GUARD = 1e-6
# The angle of a vector of a group whose drawn members have no mean: no two of them are near or apart by it.
NO_PIVOT = 3.9
# Values and similarities of groups that are worked out together.
STEP_VALUES = 1 << 18
# Lists are settled when less than this share of their entries is new.
SETTLED = 0.01
# Nodes audited of the groups of each size class, about.
AUDIT_ROWS = 200
RECALL = 0.99
# Sets of planes in a row that join no groups while recall is too low, before the run fails.
PATIENCE = 20
PLANES = 48


def prepared(embeddings: DataFrame, vector: str, label: str, seed: int) -> DataFrame:
    """(row, vec_id, g, q, unit, same): g is a hash of label and length, null for vectors that link with nothing; ``same`` is a digest of the unit."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small, units = [], []
            for values in batch.column(3):
                x = np.array(values.as_py() or [], dtype=object)
                x = np.full(0, np.nan) if any(v is None for v in x) else x.astype(np.float64)
                big = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if not big:
                    small.append(None), units.append(None)
                    continue
                x = x / big
                x /= np.sqrt((x * x).sum())
                units.append(x.tobytes())
                small.append(np.round(x * (127 / np.abs(x).max())).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(small, pa.binary()), pa.array(units, pa.binary()),
                    pa.array([None if u is None else hashlib.sha256(u).digest() for u in units], pa.binary()),
                ],
                ["row", "vec_id", "g", "q", "unit", "same"],
            )

    group = F.when(F.col(label).isNotNull(), F.xxhash64(label, F.size(vector)))
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), group.alias("g"), F.col(vector).alias("v"))
    return rows.mapInArrow(prepare, "row long, vec_id long, g long, q binary, unit binary, same binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal values in the first ``keys`` columns, with where the runs start; runs may cross batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        changes = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for column in (table.column(k).to_numpy() for k in range(keys)):
            changes |= column[1:] != column[:-1]
        starts = np.append(0, np.flatnonzero(changes) + 1)
        rest = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if rest is not None and rest.num_rows:
        yield rest, np.array([0])


def by_group(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table], Iterator[tuple]]) -> Iterator[tuple]:
    """Calls ``work`` for every run of rows with equal values in the first ``keys`` columns; runs may cross batches."""
    for table, starts in whole_groups(batches, keys):
        for start, end in zip(starts, np.append(starts[1:], table.num_rows)):
            yield from work(table.slice(start, end - start))


def best_of_groups(members: DataFrame) -> DataFrame:
    """Better neighbours (src, dst, sim, own) inside groups of ``members`` (u, salt, row, g, q, c, worst_own, worst_other)."""

    def compare(x: np.ndarray, rows: np.ndarray, g: np.ndarray, c: np.ndarray, worst_own: np.ndarray, worst_other: np.ndarray) -> Iterator[tuple]:
        """``x`` (groups, rows, components); the others (groups, rows)."""
        # Sums of whole numbers are exact here, so a pair has the same similarity in every group.
        lengths = 1 / np.sqrt(np.einsum("bij,bij->bi", x, x))
        sims = np.matmul(x, x.transpose(0, 2, 1)) * (lengths[:, :, None] * lengths[:, None, :])
        sims[(g[:, :, None] != g[:, None, :]) | (rows[:, :, None] == rows[:, None, :])] = -2
        inside = c[:, :, None] == c[:, None, :]
        for own, here, worst in ((True, inside, worst_own), (False, ~inside, worst_other)):
            part = np.where(here, sims, -2)
            better = part > np.maximum(worst, -1.5)[:, :, None]
            # Only where more of them are better than the last of a list is it asked which are the best.
            b, i = np.nonzero(better.sum(axis=2) > NEIGHBOURS)
            if len(b):
                some, beyond = better[b, i], np.argsort(-part[b, i], axis=1, kind="stable")[:, NEIGHBOURS:]
                some[np.arange(len(b))[:, None], beyond] = False
                better[b, i] = some
            b, i, j = np.nonzero(better)
            yield rows[b, i], rows[b, j], part[b, i, j].astype(np.float64), np.full(len(b), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2):
            rows, g, c, worst_own, worst_other = (table.column(k).to_numpy() for k in (2, 3, 5, 6, 7))
            raw = table.column(4).cast(pa.large_binary()).combine_chunks()
            places = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
            data, widths = np.frombuffer(raw.buffers()[2], np.int8), np.diff(places)
            # Only rows of one length are compared; a group holds more where the group keys of labels collide.
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
            order = np.lexsort((np.arange(len(rows)), widths, of))
            parts = np.flatnonzero(np.append(True, (of[order][1:] != of[order][:-1]) | (widths[order][1:] != widths[order][:-1])))
            sizes = np.diff(np.append(parts, len(rows)))
            shapes = np.stack([sizes, widths[order[parts]]], axis=1)
            for n, width in np.unique(shapes[sizes > 1], axis=0).tolist():
                alike = parts[(shapes == (n, width)).all(axis=1)]
                step = max(1, STEP_VALUES // (n * max(n, width)))
                for at in range(0, len(alike), step):
                    here = order[alike[at : at + step, None] + np.arange(n)]
                    x = data[places[here][:, :, None] + np.arange(width)].astype(np.float32)
                    for src, dst, sim, own in compare(x, *(values[here] for values in (rows, g, c, worst_own, worst_other))):
                        if len(src):
                            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sim), pa.array(own)], ["src", "dst", "sim", "own"])

    grouped = members.select("u", "salt", "row", "g", "q", "c", "worst_own", "worst_other").repartition("u", "salt").sortWithinPartitions("u", "salt", "row")
    return grouped.mapInArrow(run, "src long, dst long, sim double, own boolean")


def salted(members: DataFrame) -> DataFrame:
    """Adds ``salt``, which cuts groups of more than ``GROUP`` rows into about equal parts by a hash of the row.

    Where ``members`` have ``fresh``, groups without a fresh member are left out: all their pairs were compared before."""
    open_group = F.max("fresh") if "fresh" in members.columns else F.lit(True)
    counted = members.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"), open_group.alias("open"))
    # Cut groups are compared in any case: their parts may be others than before.
    sizes = write_stage(counted.where("open OR parts > 1").drop("open"), "group-sizes")
    members = members.select("u", "row")
    return members.join(sizes, "u").withColumn("salt", F.pmod(F.xxhash64("row", "u"), "parts").cast("int")).drop("parts")


def plane_groups(vectors: DataFrame, trees: int, seed: int) -> DataFrame:
    """(u, row) of each tree: vectors of one label on the same side of as many planes as leave about ``GROUP`` rows."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        bits = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            rows, g, raw = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for tree in range(trees):
                out = np.zeros(len(raw), dtype=np.int64)
                for size in {len(x) for x in raw}:
                    here = [i for i, x in enumerate(raw) if len(x) == size]
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, size]).normal(size=(trees, size, PLANES)).astype(np.float32)
                    x = np.frombuffer(b"".join(raw[i] for i in here), dtype=np.int8).reshape(len(here), size).astype(np.float32)
                    out[here] = ((x @ planes[size][tree]) > 0) @ bits
                yield pa.RecordBatch.from_arrays([rows, g, pa.array(np.full(len(raw), tree, dtype=np.int32)), pa.array(out)], ["row", "g", "tree", "code"])

    sizes = write_stage(vectors.groupBy("g").count(), "label-sizes")
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("count") / GROUP)), F.lit(0)), F.lit(PLANES)).cast("int")
    coded = vectors.select("row", "g", "q").mapInArrow(codes, "row long, g long, tree int, code long").join(sizes, "g")
    leaf = F.expr(f"shiftright(code, {PLANES} - depth)")
    return coded.withColumn("depth", depth).select(F.xxhash64("tree", "g", leaf, F.lit(seed)).alias("u"), "row")


def merged_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The best ``NEIGHBOURS`` entries of the own group and of all others, of old and found ones; ties go to the lower row. What was found is ``fresh``."""
    both = lists.select("src", "dst", "sim", "own", F.lit(False).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(True)))
    every = both.groupBy("src", "dst", "own").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("src", "own").orderBy(F.desc("sim"), "dst"))
    return every.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).drop("rank")


def with_bounds(vectors: DataFrame, lists: DataFrame) -> DataFrame:
    """Vectors with the similarities that a new entry of their own group, or of another one, has to beat."""

    def worst(own: Column) -> Column:
        return F.when(F.count_if(own) >= NEIGHBOURS, F.min(F.when(own, F.col("sim")))).otherwise(-2.0)

    state = lists.groupBy(F.col("src").alias("row")).agg(worst(F.col("own")).alias("worst_own"), worst(~F.col("own")).alias("worst_other"))
    bounds = [F.coalesce(name, F.lit(-2.0)).alias(name) for name in ("worst_own", "worst_other")]
    return vectors.select("row", "g", "q", "c").join(state, "row", "left").select("row", "g", "q", "c", *bounds)


def refined(vectors: DataFrame, lists: DataFrame, seed: int) -> DataFrame:
    """Neighbour lists of ``vectors`` (row, g, q, c) after new plane groups and as many neighbour joins as it takes to settle."""
    bounds = write_stage(with_bounds(vectors, lists), "bounds")
    found = best_of_groups(salted(plane_groups(vectors, TREES, seed)).join(bounds, "row"))
    # The bounds of ``lists`` may be others than when they were made, so all are fresh at first.
    lists = write_stage(merged_lists(lists, found).withColumn("fresh", F.lit(True)), "lists")
    while True:
        bounds = write_stage(with_bounds(vectors, lists), "bounds")
        both = lists.select(F.col("src").alias("u"), F.col("dst").alias("row"), "fresh").unionByName(
            lists.select(F.col("dst").alias("u"), F.col("src").alias("row"), "fresh")
        ).groupBy("u", "row").agg(F.min("fresh").alias("fresh"))
        found = best_of_groups(salted(both).join(bounds, "row"))
        lists = write_stage(merged_lists(lists, found), "lists")
        changed, entries = lists.agg(F.count_if("fresh"), F.count("*")).first()
        if changed <= SETTLED * max(1, entries):
            return lists


def in_groups(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """``lists`` with ``own`` by the present ``groups`` (row, c)."""
    ends = lists.select("src", "dst", "sim")
    for end in ("src", "dst"):
        ends = ends.join(groups.select(F.col("row").alias(end), F.col("c").alias(f"c_{end}")), end)
    return ends.select("src", "dst", "sim", (F.col("c_src") == F.col("c_dst")).alias("own"))


def pivot_angles(members: DataFrame) -> DataFrame:
    """``members`` (component, row, g, unit, copies) with ``angle``, that between the vector and a pivot of its group: the mean of
    a few members drawn by a hash. Any pivot is right; one in the middle of a group leaves fewer pairs to compare."""
    drawn = members.groupBy("component").agg(F.array(*[F.min_by("unit", F.xxhash64("row", F.lit(k))) for k in range(PIVOT_OF)]).alias("drawn"))
    stored = write_stage(drawn, "pivots")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (unit, drawn) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                x = np.frombuffer(unit)
                # A group key may stand for vectors of two lengths; those of another length do not link anyway.
                pivot = sum((y for y in map(np.frombuffer, drawn) if len(y) == len(x)), np.zeros(len(x)))
                size = np.sqrt(pivot @ pivot)
                out[i] = np.arccos(np.clip(x @ pivot / size, -1.0, 1.0)) if size > 1e-6 else np.nan
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.where(np.isnan(out), NO_PIVOT, out))], ["component", "row", "g", "unit", "copies", "angle"])

    placed = members.join(stored, "component").select("component", "row", "g", "unit", "copies", "drawn")
    return placed.mapInArrow(angles, "component long, row long, g long, unit binary, copies long, angle double")


def blocks_of(placed: DataFrame) -> DataFrame:
    """``placed`` with ``block``: about ``BLOCK`` neighbours in the order of angles, without sorting a group in one place.

    Angles are counted in steps; a step's rows start at the sum of the counts before it, and the rows of a full step are spread by
    a hash. A group has at most ``STEPS`` counts, so their running sum is bounded."""
    step = F.floor(F.col("angle") * (STEPS / 4)).cast("int")
    counts = placed.groupBy("component", "g", step.alias("step")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("component").orderBy("g", "step").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_stage(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "angle-steps")
    spread = F.pmod(F.xxhash64("row", F.lit(3)), F.col("n"))
    joined = placed.withColumn("step", step).join(starts, ["component", "g", "step"])
    return joined.withColumn("block", F.floor((F.col("start") + spread) / BLOCK).cast("int")).drop("step", "n", "start")


def exact_links(vectors: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """(row, n_links, root) per node and block pair of the candidate ``groups`` (node, component); only nodes with links.
    ``n_links`` counts the copies of the other nodes.

    A group is cut into blocks by the angle to its pivot. By the triangle inequality two blocks hold no link if their angles are
    too far apart, and nothing but links if their largest angles sum up to less than the threshold: those are counted without a
    comparison. All other pairs of blocks are compared, each in one place. ``root`` is the smallest row that the links of
    this pair of blocks lead to.
    """

    def compare(table: pa.Table) -> Iterator[tuple]:
        rows, g, raw = table.column(4).to_numpy(), table.column(5).to_numpy(), table.column(6).to_pylist()
        block = table.column(3).to_numpy()
        linked = np.zeros((len(rows), len(rows)), dtype=bool)
        for size in {len(x) for x in raw}:
            here = np.array([i for i, x in enumerate(raw) if len(x) == size])
            x = np.frombuffer(b"".join(raw[i] for i in here), dtype=np.float64).reshape(len(here), -1)
            linked[np.ix_(here, here)] = (x @ x.T) >= cosine
        linked &= (g[:, None] == g[None, :]) & (rows[:, None] != rows[None, :])
        first, second = table.column(1)[0].as_py(), table.column(2)[0].as_py()
        if first != second:  # pairs inside a block are counted where the block meets itself
            linked &= block[:, None] != block[None, :]
        counts = linked @ table.column(7).to_numpy()
        roots = rows.copy()
        while True:
            least = np.minimum(roots, np.where(linked, roots[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (least == roots).all():
                break
            roots = least
        some = counts > 0
        yield rows[some], counts[some], roots[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, roots in by_group(batches, 3, compare):
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counts.astype(np.int64)), pa.array(roots)], ["row", "n_links", "root"])

    members = groups.withColumnRenamed("node", "row").join(vectors.select("row", "g", "unit", "copies"), "row").select("component", "row", "g", "unit", "copies")
    placed = write_stage(blocks_of(write_stage(pivot_angles(write_stage(members, "candidates")), "candidate-angles")), "candidate-blocks")
    limit = float(np.arccos(cosine))
    bounds = placed.groupBy("component", "block").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("copies"), F.min("row").alias("least"),
        F.min("g").alias("g"), (F.min("g") == F.max("g")).alias("one"),
        (F.min(F.octet_length("unit")) == F.max(F.octet_length("unit"))).alias("even"), F.min(F.octet_length("unit")).alias("size"),
    )
    bounds = write_stage(bounds, "candidate-bounds")
    a, b = bounds.alias("a"), bounds.alias("b")
    # Two blocks may meet if their ranges of angles come near enough; without a pivot a group's angles say nothing.
    apart = F.abs(F.greatest("a.low", "b.low") - F.least("a.high", "b.high"))
    near = (F.least("a.high", "b.high") >= F.greatest("a.low", "b.low")) | (apart <= limit + GUARD)
    alike = F.col("a.one") & F.col("b.one") & (F.col("a.g") == F.col("b.g")) & F.col("a.even") & F.col("b.even") & (F.col("a.size") == F.col("b.size"))
    pairs = a.join(b, F.col("a.component") == F.col("b.component")).where(near).select(
        F.col("a.component").alias("component"), F.col("a.block").alias("block"), F.col("b.block").alias("other"),
        (alike & (F.col("a.high") + F.col("b.high") < limit - GUARD)).alias("all"), F.col("b.copies").alias("others"), F.col("b.least").alias("least"), F.col("a.least").alias("own_least"),
    )
    pairs = write_stage(pairs, "block-pairs")
    itself = F.max(F.when(F.col("block") == F.col("other"), 1).otherwise(0))
    whole = pairs.where("all").groupBy("component", "block").agg(F.sum("others").alias("others"), itself.alias("itself"), F.min("own_least").alias("least"))
    # All rows of a block that is linked as a whole are joined, by the rows that they share as neighbours.
    counted = placed.select("component", "block", "row", "copies").join(whole, ["component", "block"]).select(
        "row", (F.col("others") - F.col("copies") * F.col("itself")).alias("n_links"), F.col("least").alias("root")
    ).where("n_links > 0")
    met = pairs.where("all AND block < other").select(F.col("own_least").alias("row"), F.lit(0).cast("long").alias("n_links"), F.col("least").alias("root"))
    open_pairs = pairs.where("NOT all").select("component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    full = placed.join(open_pairs, ["component", "block"]).select("component", "first", "second", "block", "row", "g", "unit", "copies")
    grouped = full.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second", "row")
    return counted.unionByName(met).unionByName(grouped.mapInArrow(run, "row long, n_links long, root long"))


def audited_recall(vectors: DataFrame, members: DataFrame, cosine: float) -> float:
    """Recall per vector, of nodes drawn by a hash and compared with all of them: the share of a node's true links whose other
    end is in its group of ``members`` (row, c).

    About ``AUDIT_ROWS`` nodes are drawn of the groups of each size class (powers of two). The mean over the nodes that have a
    true link is taken for each class of their number of links, and the least of these means is the recall, so that
    large groups do not speak for small ones.
    """
    sizes = write_stage(members.groupBy("c").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class"), F.count("*").alias("n")), "audit-sizes")
    held = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    if not held:
        return 1.0
    chances = F.create_map(*[x for name, n in held.items() for x in (F.lit(name), F.lit(min(1.0, AUDIT_ROWS / n)))])
    draw = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    drawn = members.join(sizes, "c").where(draw < chances[F.col("class")]).select("row", "c", "class")
    sample = [tuple(r) for r in vectors.select("row", "g", "unit").join(drawn, "row").select("row", "g", "unit", "c", "class").collect()]
    shared = vectors.sparkSession.sparkContext.broadcast(sample)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list] = {}
        for i, query in enumerate(shared.value):
            queries.setdefault(len(query[2]), []).append((i, *query))
        true, met = np.zeros(len(shared.value), dtype=np.int64), np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            rows, g, raw, c = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for size in {len(x) for x in raw} & queries.keys():
                here = np.array([i for i, x in enumerate(raw) if len(x) == size])
                x = np.frombuffer(b"".join(raw[i] for i in here), dtype=np.float64).reshape(len(here), -1)
                for at in range(0, len(queries[size]), BLOCK):
                    number, row, group, unit, own, _ = zip(*queries[size][at : at + BLOCK])
                    hit = np.frombuffer(b"".join(unit), dtype=np.float64).reshape(len(unit), -1) @ x.T >= cosine
                    hit &= (np.array(group)[:, None] == g[here]) & (np.array(row)[:, None] != rows[here])
                    true[list(number)] += hit.sum(axis=1)
                    met[list(number)] += (hit & (np.array(own)[:, None] == c[here])).sum(axis=1)
        some = np.flatnonzero(true)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(true[some]), pa.array(met[some])], ["i", "n", "met"])

    placed = vectors.select("row", "g", "unit").join(members, "row").select("row", "g", "unit", "c")
    links = placed.mapInArrow(search, "i long, n long, met long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("met").alias("met")).collect()
    drawn_of = Counter(query[4] for query in sample)
    means: dict[int, list[float]] = {}
    for i, n, met in links:
        name = sample[i][4]
        weight, sums = held[name] / drawn_of[name], means.setdefault(n.bit_length(), [0.0, 0.0])
        sums[0] += weight * met / n
        sums[1] += weight
    return min((found / every for found, every in means.values()), default=1.0)


def embedding_duplicates(embeddings: DataFrame, vector: str = "embedding", label: str = "label", cosine: float = COSINE, seed: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall): one row per vector.

    Vectors are compared when their labels are equal and not null and their lengths are equal. A vector that is null, empty or
    zero, or holds a null or a value that is not finite, links with nothing. Repeated rows are vectors of their own that link
    with each other; a null ``vec_id`` is ignored where a component has another one. An empty table gives no rows. Other
    columns are not read. The run fails if the audited recall stays below ``RECALL``.
    """
    rows = write_stage(prepared(embeddings, vector, label, seed), "vectors")
    usable = rows.where("g IS NOT NULL AND unit IS NOT NULL")
    nodes = write_stage(usable.groupBy("g", "same").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "nodes")
    vectors = write_stage(usable.select("row", "g", "q", "unit").join(nodes.select(F.col("node").alias("row"), "copies"), "row"), "node-vectors")
    lists = vectors.sparkSession.createDataFrame([], "src long, dst long, sim double, own boolean")
    members, idle = vectors.select("row", F.col("row").alias("c")), 0
    groups = members.select(F.col("row").alias("node"), F.col("c").alias("component")).limit(0)
    while True:
        lists = refined(vectors.join(members, "row"), in_groups(lists, members), seed)
        seed += 1
        near = lists.where((F.col("sim") >= cosine - MARGIN) & ~F.col("own")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        if not near.isEmpty():
            old = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
            groups = write_stage(connected_components(old.unionByName(near)), "candidate-groups")
            placed = vectors.select("row").join(groups.withColumnRenamed("node", "row"), "row", "left")
            members = write_stage(placed.select("row", F.coalesce("component", "row").alias("c")), "members")
            idle = 0
            continue
        recall = audited_recall(vectors, members, cosine)
        if recall >= RECALL:
            break
        idle += 1
        if idle >= PATIENCE:
            raise RuntimeError(f"recall is {recall:.4f} after {idle} sets of planes that joined no groups, less than {RECALL}")
    parts = write_stage(exact_links(vectors, groups, cosine), "links")
    counts = parts.groupBy("row").agg(F.sum("n_links").alias("n_links"))
    components = connected_components(parts.select(F.col("row").alias("a"), F.col("root").alias("b")))
    ends = nodes.join(counts.withColumnRenamed("row", "node"), "node", "left").join(components, "node", "left")
    # A copy links with the other copies of its node and with those of the nodes around.
    ends = write_stage(ends.select(
        "g", "same", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    ), "node-links")
    named = rows.select("row", "vec_id", "g", "same").join(ends, ["g", "same"], "left")
    named = write_stage(named.select("row", "vec_id", "n_links", F.coalesce("component", "row").alias("component")), "named-vectors")
    first = write_stage(named.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component-ids")
    return named.join(first, "component").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audit_recall"),
    )
