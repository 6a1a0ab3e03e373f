"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Every text is read as word hashes; a *node* is a distinct sequence of words, so exact copies are one node.
2. A shingle is a run of five words. Its weight in a text is its count there times its inverse document
   frequency, the mean of that of its words. Document frequencies come from all documents, in a table of
   2**16 hashed words (the hashing trick, so the table does not grow); they are scaled to 1..2 over the
   corpus size, so a weight means the same at every size.
3. Consistent weighted sampling gives ``BANDS * ROWS`` samples per node; two nodes agree on a sample with a
   probability equal to their weighted Jaccard similarity. Nodes that agree on a band are candidates.
4. Candidates are verified by the exact weighted Jaccard similarity of their whole texts. First the members of a
   bucket meet its leader, the text that shares the most bands with others. What stars leave open are pairs of one
   bucket in different components of the links found so far. Of these, pairs go by exact bounds if what a member shares
   with others at all, or a pair by common shingles alone, weighs too little for a link; pairs with a rare shingle
   in both are listed by it. What two members have in common is bounded part by part, the shingles being dealt into
   ``PARTS`` by hash: copies with edits in different places do not pass. The rest is verified one by one. So a group of similar copies costs about one comparison
   each, and no link that could change a component is left out.
5. The class of a document is the connected component of its node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.components import connected_components
from sitegraph.llm.words import WordHasher, mix, position_factors, sequence_hash
from sitegraph.session import map_texts, sized_side, write_stage

WIDTH = 5
SIMILARITY = 0.8
# A pair at the threshold misses all bands with a probability of (1 - 0.8**4)**14 < 0.001.
BANDS, ROWS = 14, 4
TABLE_BITS = 16
STAR_ROUNDS = 4
# Shingles of at most so many open members name the pairs that have them.
RARE = 16
# Parts that shingles are dealt into by hash, to bound what two texts share (a power of two).
PARTS = 64
# While more pairs are left for each candidate text, another round of stars is cheaper than comparing them.
PAIRS_PER_CANDIDATE = 16
# Bytes of shingles that a task remembers while it verifies pairs, and pairs that it looks at together.
HELD_BYTES, STEP_PAIRS = 8 << 20, 64
# Sums of weights may differ by this much with their order.
SLACK = 1e-6


class Weights:
    """Shingles of a text with their TF-IDF weights."""

    def __init__(self, idf: np.ndarray, width: int = WIDTH) -> None:
        self.idf, self.width = idf, width
        self.factors = position_factors(width)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles and their weights; a text of fewer words than a shingle is one shingle."""
        if not len(words):
            return np.zeros(0, np.uint64), np.zeros(0)
        width = min(self.width, len(words))
        factors = self.factors[:width] if width == self.width else position_factors(width, seed=2)
        idf = np.concatenate([[0.0], np.cumsum(self.idf[(words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])])
        means = (idf[width:] - idf[:-width]) / width
        shingles, first, count = np.unique(sequence_hash(words, factors), return_index=True, return_counts=True)
        # Rounded, so that a weight does not depend on the words before its shingle.
        return shingles, count * np.round(means[first], 6)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total > 0 else 0.0


class Sampler:
    """Consistent weighted samples of a set of weighted shingles, as hashes of (shingle, level).

    The random values of a (shingle, sample) are read from a table of 2**16 draws at a hashed place.
    """

    def __init__(self, samples: int) -> None:
        draw = np.random.default_rng(20240601)
        r, log_c, beta = draw.gamma(2.0, 1.0, 1 << 16), np.log(draw.gamma(2.0, 1.0, 1 << 16)), draw.random(1 << 16)
        # The logarithm of c / (y * exp(r)), with y = exp(r * (level - beta)), is base - r * level.
        self.inverse_r, self.beta = (1.0 / r).astype(np.float32), beta.astype(np.float32)
        self.base = (log_c + r * beta - r).astype(np.float32)
        self.factors = (mix(np.arange(1, samples + 1, dtype=np.uint64)) | np.uint64(1))[:, None]

    def samples(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best = np.full(len(self.factors), np.inf, dtype=np.float32)
        out = np.zeros(len(self.factors), dtype=np.uint64)
        rows = np.arange(len(self.factors))
        logs = np.log(weights).astype(np.float32)
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024]
            place = part[None, :] * self.factors
            place >>= np.uint64(48)
            place = place.view(np.int64)
            inverse_r = self.inverse_r.take(place, mode="clip")
            level = inverse_r * logs[at : at + 1024]
            level += self.beta.take(place, mode="clip")
            np.floor(level, out=level)
            np.divide(level, inverse_r, out=inverse_r)
            value = self.base.take(place, mode="clip")
            value -= inverse_r
            won = value.argmin(axis=1)
            found = value[rows, won]
            better = found < best
            best = np.where(better, found, best)
            named = mix(part[won] + mix(level[rows, won].astype(np.int64).view(np.uint64)))
            out = np.where(better, named, out)
        return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = (samples.reshape(bands, rows) * position_factors(rows, seed=3)).sum(axis=1, dtype=np.uint64)
    return mix(total + np.arange(bands, dtype=np.uint64)).view(np.int64)


def word_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Number of documents per hashed word over all documents, and the number of documents with words.

    Each task sends at most one row per table entry; what is collected has the size of the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, n = WordHasher(), np.zeros((1 << TABLE_BITS) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, hashes, counts in hasher.blocks(batch.column(0).to_pylist()):
                owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
                places = np.unique((owner << TABLE_BITS) | (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
                table[:-1] += np.bincount(places & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
                table[-1] += int((counts > 0).sum())
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used])], ["place", "n"])

    counts = map_texts(docs.select(text), count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((1 << TABLE_BITS) + 1, dtype=np.int64)
    for row in counts:
        table[row["place"]] = row["n"]
    return table[:-1], int(table[-1])


def scaled_idf(table: np.ndarray, documents: int) -> np.ndarray:
    """1 for a word of every document, 2 for a word of none."""
    return 1.0 + np.log((documents + 1.0) / (table + 1.0)) / np.log(documents + 2.0)


def node_rows(docs: DataFrame, text: str, idf: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, node, weight, bands) of every document; null node, weight and bands for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weigh, sampler = WordHasher(), Weights(shared.value), Sampler(BANDS * ROWS)
        for batch in batches:
            nodes, totals, bands = [], [], []
            for words in hasher.each(batch.column(2).to_pylist()):
                if not len(words):
                    nodes.append(None), totals.append(None), bands.append(None)
                    continue
                shingles, weights = weigh.of(words)
                order = mix(words + mix(np.arange(len(words), dtype=np.uint64)))
                nodes.append(int(mix(order.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]))
                totals.append(float(weights.sum()))
                bands.append(band_hashes(sampler.samples(shingles, weights), BANDS, ROWS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(totals, pa.float64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "weight", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_texts(rows, sample, "doc_id long, text_hash long, node long, weight double, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b, score) among ``pairs`` (a, b) by the weighted Jaccard similarity of their whole texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weigh = WordHasher(), Weights(shared.value)
        held: dict[int, tuple] = {}  # shingles of nodes of the pairs before: nodes come back in many pairs
        size = 0
        for batch in batches:
            nodes = [batch.column(k).to_pylist() for k in (0, 1)]
            place = {node: (k, i) for k in (0, 1) for i, node in enumerate(nodes[k]) if node not in held}
            if size > HELD_BYTES:
                held, size = {}, 0
                place = {node: (k, i) for k in (0, 1) for i, node in enumerate(nodes[k])}
            found = []
            for start in range(0, batch.num_rows, STEP_PAIRS):
                pairs = list(zip(nodes[0][start : start + STEP_PAIRS], nodes[1][start : start + STEP_PAIRS]))
                new = [node for node in dict.fromkeys(node for pair in pairs for node in pair) if node not in held]
                at = [place[node] for node in new]
                for node, words in zip(new, hasher.each([batch.column(2 + k)[i].as_py() for k, i in at])):
                    held[node] = weigh.of(words)
                    size += 16 * len(held[node][0])
                for a, b in pairs:
                    score = weighted_jaccard(held[a], held[b])
                    if score >= similarity:
                        found.append((a, b, score))
                if size > HELD_BYTES:
                    held, size = {}, 0
                    place = {node: (k, i) for k in (0, 1) for i, node in enumerate(nodes[k])}
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "score"]
            )

    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    sides = sides.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return map_texts(sides.select("a", "b", "a_text", "b_text"), score, "a long, b long, score double")


def near_duplicate_links(docs: DataFrame, rows: DataFrame, idf: np.ndarray, text: str, similarity: float) -> DataFrame:
    """Verified links between nodes, enough of them to give the components of all links between candidates."""
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("spot"), F.first("weight").alias("weight"), F.first("bands").alias("bands")
    )
    nodes = write_stage(nodes, "nodes")
    exploded = nodes.select("node", "weight", F.explode("bands").alias("band"))
    shared = write_stage(exploded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    members = write_stage(exploded.join(shared, "band"), "bucket-members")
    # The text that others were copied from shares the most bands with them: it should lead its buckets.
    central = write_stage(members.groupBy("node").agg(F.sum("n").alias("central")), "central-nodes")
    members = write_stage(members.drop("n").join(central, "node"), "ranked-members")

    wanted = members.select("node").distinct().join(nodes.select("node", "spot.*"), "node")
    wanted = sized_side(write_stage(wanted, "wanted-texts"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(text).alias("__dedup_hash"), F.col(text).alias("text"))
    texts = keyed.join(wanted, (F.col("__dedup_hash") == F.col("text_hash")) & F.col("_doc").eqNullSafe(F.col("doc_id")))
    texts = write_stage(texts.select("node", "text").dropDuplicates(["node"]), "candidate-texts")

    candidates = texts.count()

    near = F.least("weight", "other_weight") >= similarity * F.greatest("weight", "other_weight")
    def star_links(open_: DataFrame, turn: int, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Pairs of the members of each bucket with its leader, and the links among them."""
        order = F.col("central") if turn == 0 else F.lit(0)
        leader = open_.groupBy("band").agg(F.max(F.struct(order.alias("first"), F.xxhash64("node", F.lit(turn)).alias("then"), "node", "weight")).alias("l"))
        leader = write_stage(leader.select("band", F.col("l.node").alias("other"), F.col("l.weight").alias("other_weight")), "leaders")
        star = open_.join(leader, "band").where(F.col("node") != F.col("other")).where(near)
        # The leader stays the second node, so that a task meets the same leader many times.
        star = star.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        star = write_stage(star if tested is None else star.join(tested, ["a", "b"], "left_anti"), "star-pairs")
        return star, write_stage(verified(star, texts, idf, similarity), "star-links")

    tested, links = star_links(members, 0, None)
    components, links = joined(links)
    open_, rest = open_buckets(members, components)
    if rest == 0:
        return links
    # What the open members have in common decides which of them can still be linked, by exact bounds.
    spread = write_stage(rare_shingles(open_.select("node", "component").distinct(), texts, idf), "rare-shingles")
    kinds = spread.where("b IS NULL").groupBy(F.col("a").alias("node"), "part").agg(F.sum("own").alias("own"), F.sum("rare").alias("rare"))
    kinds = kinds.groupBy("node").agg(
        F.sum("own").alias("own"), F.sum("rare").alias("rare"),
        # At most one entry per part.
        F.map_from_entries(F.collect_list(F.struct("part", (F.col("own") + F.col("rare")).alias("few")))).alias("few"),
    )
    kinds = write_stage(kinds, "rare-weights")
    open_nodes = sized_side(write_stage(open_.select("node").distinct(), "open-names"))
    all_bands = write_stage(nodes.select("node", "bands").join(open_nodes, "node", "left_semi"), "open-bands")
    # Weights of the common shingles of each part: of all, less what the node has alone or with few.
    common_parts = F.transform("parts", lambda total, at: total - F.coalesce(F.try_element_at("few", at), F.lit(0.0)))
    parts = write_stage(part_weights(texts.join(open_nodes, "node", "left_semi"), idf), "open-parts")
    parts = write_stage(parts.join(kinds.select("node", "few"), "node", "left").select("node", common_parts.alias("parts")), "common-parts")
    alive = open_.drop("component").join(kinds.drop("few"), "node", "left").join(all_bands, "node").join(parts, "node")
    alive = alive.withColumn("shared", F.col("weight") - F.coalesce("own", F.lit(0.0))).withColumn("common", F.col("shared") - F.coalesce("rare", F.lit(0.0)))
    alive = write_stage(alive.where(F.col("shared") >= similarity * F.col("weight") - SLACK), "open-members")
    who = write_stage(alive.select("node", "weight", "shared", "common", "parts").dropDuplicates(["node"]), "open-nodes")
    for turn in range(1, STAR_ROUNDS + 1):
        open_, _ = open_buckets(alive, components, led=False)
        rest = write_stage(remaining_pairs(open_, who, spread, tested, near, similarity), "other-pairs")
        if turn == STAR_ROUNDS or rest.count() <= PAIRS_PER_CANDIDATE * candidates:
            return links.unionByName(write_stage(verified(rest, texts, idf, similarity), "other-links"))
        star, found = star_links(open_, turn, tested)
        tested, links = tested.unionByName(star), links.unionByName(found)
        components, links = joined(links)


def joined(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of the links, and the components as links, which are fewer and say the same."""
    components = write_stage(connected_components(links), "components")
    return components, components.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"), F.lit(None).cast("double").alias("score"))


def remaining_pairs(open_: DataFrame, who: DataFrame, spread: DataFrame, tested: DataFrame, near: Column, similarity: float) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that may still be links: members outside the largest
    component of their bucket with members of other components. A pair without a rare shingle in both can only be
    linked by common ones; pairs with one are listed by it, and share at most the smaller weight of such ones besides."""
    sizes = open_.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = write_stage(sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("m")).select("band", F.col("m.component").alias("main")), "main")
    outside = write_stage(open_.join(main, "band").where("component <> main").select("band", "node", "weight", "common", "component", "bands", "parts", "main"), "outside")
    others = open_.select("band", *[F.col(c).alias(f"other_{c}") for c in ("weight", "common", "component", "bands", "parts")], F.col("node").alias("other"))
    needed = similarity / (1 + similarity) * (F.col("weight") + F.col("other_weight")) - SLACK
    # No pair shares more common shingles of a part than the one with less of them has.
    least = F.aggregate(F.zip_with("parts", "other_parts", lambda x, y: F.least(x, y)), F.lit(0.0), lambda total, x: total + x)
    by_common = outside.join(others, "band").where(
        (F.col("component") != F.col("other_component")) & ((F.col("other_component") == F.col("main")) | (F.col("node") > F.col("other")))
        & near & (F.least("common", "other_common") >= needed)
        # A pair is made in the first of the buckets that it shares, not in all of them.
        & (F.col("band") == F.array_min(F.array_intersect("bands", "other_bands"))) & (least >= needed)
    ).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    by_rare = (
        spread.where("b IS NOT NULL").select("a", "b").distinct()
        .join(who.withColumnRenamed("node", "a"), "a")
        .join(who.select(F.col("node").alias("b"), *[F.col(c).alias(f"other_{c}") for c in ("weight", "shared", "common", "parts")]), "b")
        .where(near & (F.least("shared", "other_shared") >= needed))
        .where(least + F.least(F.col("shared") - F.col("common"), F.col("other_shared") - F.col("other_common")) >= needed).select("a", "b")
    )
    done = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return by_common.unionByName(by_rare).distinct().join(done, ["a", "b"], "left_anti")


def rare_shingles(nodes: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, part, own, rare): what the shingles say that at most ``RARE`` of the ``nodes`` (node, component) have.

    Rows with a null ``b`` hold for a node and a part the weight of shingles that are its own alone, and of those it shares
    with few others; a node may have several for a part, and none where all its shingles there are common. The other rows are pairs
    a > b of different components that share a rare shingle. A shingle of very many nodes sends at most ``RARE + 1`` rows per
    block of texts, which is enough to know it as common.
    """
    table = nodes.sparkSession.sparkContext.broadcast(idf)
    names = ["shingle", "node", "component", "weight"]

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weigh = WordHasher(), Weights(table.value)
        for batch in batches:
            owners, components = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, hashes, counts in hasher.blocks(batch.column(2).to_pylist()):
                ends = np.cumsum(counts)
                found = [weigh.of(hashes[end - n : end]) for n, end in zip(counts.tolist(), ends.tolist())]
                places = first + np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                keys, weights = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                order = np.argsort(keys, kind="stable")
                keys, weights, places = keys[order], weights[order], places[order]
                few = np.arange(len(keys)) - np.searchsorted(keys, keys) <= RARE
                columns = [keys[few].view(np.int64), owners[places[few]], components[places[few]], weights[few]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in _with_end(batches):
            if batch is None:
                ready, held = held, None
            else:
                columns = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
                keys = columns[0]
                if not len(keys):
                    continue
                cut = np.searchsorted(keys, keys[-1])  # the last shingle may go on in the next batch
                ready, held = [c[:cut] for c in columns], [c[cut : cut + RARE + 1] for c in columns]
            if len(ready[0]):
                yield from _rare_rows(*ready)

    some = texts.join(sized_side(write_stage(nodes, "nodes-to-compare")), "node").select("node", "component", "text")
    every = map_texts(some, shingles, "shingle long, node long, component long, weight double")
    return every.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(compare, "a long, b long, part int, own double, rare double")


def part_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) % np.uint64(PARTS)).astype(np.int64)


def part_weights(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, parts) of ``texts`` (node, text): the weight of the shingles of each part."""
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weigh = WordHasher(), Weights(table.value)
        for batch in batches:
            found = [weigh.of(words) for words in hasher.each(batch.column(1).to_pylist())]
            sums = [np.bincount(part_of(shingles), each, minlength=PARTS) for shingles, each in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.list_(pa.float64()))], ["node", "parts"])

    return map_texts(texts.select("node", "text"), weights, "node long, parts array<double>")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _rare_rows(keys: np.ndarray, nodes: np.ndarray, components: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The result rows of whole runs of equal shingles."""
    names = ["a", "b", "part", "own", "rare"]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    few = size <= RARE
    if few.any():
        who, at = np.unique(nodes[few], return_inverse=True)
        places, at = np.unique(at * PARTS + part_of(keys[few].view(np.uint64)), return_inverse=True)
        own = np.bincount(at, weights[few] * (size[few] == 1))
        rare = np.bincount(at, weights[few] * (size[few] > 1))
        columns = [pa.array(who[places // PARTS]), pa.nulls(len(places), pa.int64()), pa.array(places % PARTS, pa.int32()), pa.array(own), pa.array(rare)]
        yield pa.RecordBatch.from_arrays(columns, names)
    pairs = []
    for n in range(2, RARE + 1):
        runs = starts[sizes == n][:, None] + np.arange(n)
        for i, j in zip(*np.triu_indices(n, 1)):
            a, b = runs[:, i], runs[:, j]
            apart = components[a] != components[b]
            pairs.append(np.stack([np.maximum(nodes[a], nodes[b])[apart], np.minimum(nodes[a], nodes[b])[apart]], axis=1))
    found = np.unique(np.concatenate(pairs), axis=0)
    if len(found):
        nothing = pa.nulls(len(found), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.nulls(len(found), pa.int32()), nothing, nothing], names)


def open_buckets(members: DataFrame, components: DataFrame, led: bool = True) -> tuple[DataFrame, int]:
    """Members (with component) of the buckets with pairs across components that no leader has met, and the number of those pairs.

    ``led``: one member of each bucket has met all others; not so where members were taken out since."""
    named = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = write_stage(named, "named-members")
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    # Pairs across components, less those that a leader has met already.
    open_pairs = F.expr("(m * m - squares) / 2" + (" - (m - most)" if led else ""))
    buckets = sizes.groupBy("band").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    buckets = write_stage(buckets.withColumn("pairs", open_pairs).where("pairs > 0"), "open-buckets")
    rest = buckets.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    # Stored, as several later steps read it.
    return write_stage(named.join(sized_side(buckets.select("band")), "band", "left_semi"), "open-buckets-members"), int(rest)


def near_duplicate_classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, class_id, kept, has_words): one row per document.

    ``class_id`` is the smallest ``doc_id`` of the class. Exactly one (doc_id, text) of each class is ``kept``;
    repeated rows of one document with one text share its value. A text that is null, empty or without any
    word is its own class and kept. A null ``doc_id`` sorts before all numbers, its class is null then. Texts of
    fewer than five words are near duplicates of equal word sequences only. An empty table gives no rows.
    Other columns are not read.
    """
    table, documents = word_frequencies(docs, text)
    idf = scaled_idf(table, documents)
    rows = write_stage(node_rows(docs, text, idf), "document-nodes")
    links = near_duplicate_links(docs, rows, idf, text, similarity)
    components = write_stage(connected_components(links), "components")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("spot"))
    named = write_stage(nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "named-nodes")
    first = write_stage(named.groupBy("component").agg(F.min("spot").alias("first")), "classes")
    classes = write_stage(named.select("node", "component").join(first, "component").select("node", "first"), "node-classes")
    return rows.select("doc_id", "text_hash", "node").join(classes, "node", "left").select(
        "doc_id", "text_hash",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce(F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")) | F.col("first").isNull(), F.lit(True)).alias("kept"),
        F.col("node").isNotNull().alias("has_words"),
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its columns; documents without words stay as they are."""
    classes = write_stage(near_duplicate_classes(docs, text, similarity), "classes")
    spots = classes.where("has_words").groupBy("doc_id", "text_hash", "kept").agg(F.count("*").alias("n"))
    # A document goes if it is not kept; a kept one with repeated rows goes too and comes back as one row.
    changed = sized_side(write_stage(spots.where("NOT kept OR n > 1").select(F.col("doc_id").alias("__dedup_id"), F.col("text_hash").alias("__dedup_hash"), F.col("kept").alias("__dedup_once")), "changed"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__dedup_id")) & (F.xxhash64(text) == F.col("__dedup_hash"))
    stay = docs.join(changed, same, "left_anti")
    once = docs.join(changed.where("__dedup_once"), same).dropDuplicates(["__dedup_id", "__dedup_hash"]).select(*docs.columns)
    return stay.unionByName(once)
