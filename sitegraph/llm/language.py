"""Language identification by a convolutional network over bytes.

Windows of ``WINDOW`` bytes pass filters of several widths over byte embeddings, the maximum of each filter
over the window, and a softmax layer. The network is trained in numpy on a bounded sample of labelled text and
applied to windows that cover every byte of every text; a text's probabilities are the mean over its windows,
by their bytes.

For prediction the embeddings and filters are folded into tables by byte pair, so that a filter costs two
look-ups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.session import map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
EMBEDDING = 6
# Upper bound of the labelled sample that the network is trained on, in windows.
SAMPLE_ROWS = 6_000
EPOCHS = 6
SPAN = max(WIDTHS) - 1
LETTER = regex.compile(r"\p{L}")
NONE = "und"


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows (zeros after a text's end), the text of each window and its bytes.

    Windows overlap by one byte less than the widest filter, so that no run of bytes is cut.
    """
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    step = WINDOW - SPAN
    counts = [max(1, -(-max(0, len(p) - SPAN) // step)) for p in parts]
    out = np.zeros((sum(counts), WINDOW), dtype=np.uint8)
    sizes = np.zeros(len(out), dtype=np.int64)
    at = 0
    for part, n in zip(parts, counts):
        data = np.frombuffer(part, dtype=np.uint8)
        padded = np.zeros(n * step + SPAN, dtype=np.uint8)
        padded[: len(data)] = data
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]
        sizes[at : at + n] = np.clip(len(data) - step * np.arange(n), 1, step)
        at += n
    return out, np.repeat(np.arange(len(texts)), counts), sizes


@dataclass
class Network:
    """Parameters; filters of all widths are stored at the widest one, zero where a filter does not look."""

    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # max width x EMBEDDING x filters
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of byte pairs at the first two places and at the last two places of a filter."""
        by_place = np.einsum("be,pef->pbf", self.embedding, self.filters).astype(np.float32)
        first = (by_place[0][:, None, :] + by_place[1][None, :, :]).reshape(65536, -1)
        last = (by_place[2][:, None, :] + by_place[3][None, :, :]).reshape(65536, -1)
        return first, last

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray], block: int = 64) -> np.ndarray:
        first, last = tables
        out = np.empty((len(windows), len(self.labels)))
        for at in range(0, len(windows), block):
            part = windows[at : at + block].astype(np.int64)
            pairs = (part[:, :-1] << 8) | part[:, 1:]
            responses = first.take(pairs[:, :-2], axis=0)
            responses += last.take(pairs[:, 2:], axis=0)
            pooled = np.maximum(responses.max(axis=1) + self.bias, 0)
            logits = pooled @ self.dense + self.offset
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            out[at : at + block] = logits / logits.sum(axis=1, keepdims=True)
        return out


def train(windows: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the cross entropy; the gradient of a maximum reaches only the bytes that gave it."""
    draw = np.random.default_rng(seed)
    total, wide = FILTERS * len(WIDTHS), max(WIDTHS)
    looks = np.zeros((wide, 1, total))
    for k, width in enumerate(WIDTHS):
        looks[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    embedding = draw.normal(0, 0.5, (256, EMBEDDING))
    embedding[0] = 0
    net = Network(
        labels, embedding, draw.normal(0, 0.4, (wide, EMBEDDING, total)) * looks, np.zeros(total),
        draw.normal(0, 0.1, (total, len(labels))), np.zeros(len(labels)),
    )
    names = ("embedding", "filters", "bias", "dense", "offset")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step, batch = 0, 64
    for epoch in range(epochs):
        order = draw.permutation(len(windows))
        rate = 0.01 * (1 - 0.8 * epoch / max(1, epochs - 1))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            bytes_, n = windows[rows].astype(np.int64), len(rows)
            by_place = np.einsum("be,pef->pbf", net.embedding, net.filters).astype(np.float32)
            length = WINDOW - SPAN
            responses = sum(by_place[p].take(bytes_[:, p : p + length], axis=0) for p in range(wide))
            spot = responses.argmax(axis=1)  # n x filters
            raw = np.take_along_axis(responses, spot[:, None, :], axis=1)[:, 0, :] + net.bias
            pooled = np.maximum(raw, 0)
            logits = pooled @ net.dense + net.offset
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), targets[rows]] -= 1
            p /= n
            grad = {"dense": pooled.T @ p, "offset": p.sum(axis=0)}
            back = (p @ net.dense.T) * (raw > 0)
            grad["bias"] = back.sum(axis=0)
            seen = bytes_[np.arange(n)[:, None, None], spot[:, :, None] + np.arange(wide)]  # n x filters x places
            vectors = net.embedding[seen]
            grad["filters"] = np.einsum("nf,nfpe->pef", back, vectors) * looks
            into = np.einsum("nf,pef->nfpe", back, net.filters)
            grad["embedding"] = np.zeros_like(net.embedding)
            np.add.at(grad["embedding"], seen.ravel(), into.reshape(-1, EMBEDDING))
            grad["embedding"][0] = 0
            step += 1
            for name in names:
                first[name] = 0.9 * first[name] + 0.1 * grad[name]
                second[name] = 0.999 * second[name] + 0.001 * grad[name] ** 2
                moved = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - rate * moved)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_sample(docs: DataFrame, text: str, label: str, sample_rows: int) -> list[tuple[str, str]]:
    """At most ``sample_rows`` labelled pieces of text, about as many for each label.

    Rows are drawn by a hash of the text, and a piece starts at a hashed place of its text. Repeated texts are drawn
    once. The labels are counted first, so the draw reads the texts once; collected rows stay near the bound.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    known = known.where(F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), F.col(text).alias("text"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(sample_rows).collect()}
    if not counts:
        return []
    share = max(1, sample_rows // len(counts))
    # A share of the 64-bit hash range per label; null labels are out, so every row has one.
    chances = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 1.2 * share / n)))])
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    place = F.pmod(F.xxhash64("text", F.lit(12)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    piece = F.substring(F.col("text"), place.cast("int"), F.lit(WINDOW))
    drawn = known.where(draw < chances[F.col("label")]).select("label", piece.alias("piece"), F.xxhash64("text").alias("order")).distinct()
    out: dict[str, list] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r["label"], r["order"], r["piece"])):
        out.setdefault(row["label"], []).append((row["label"], row["piece"]))
    return [row for rows in out.values() for row in rows[:share]]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """Network for the labels of ``docs``; None if no row can be learned from. Held-out rows are not read."""
    sample = training_sample(docs, text, label, sample_rows)
    if not sample:
        return None
    labels = sorted({name for name, _ in sample})
    windows, owner, _ = windows_of([piece for _, piece in sample])
    targets = np.array([labels.index(name) for name, _ in sample])[owner]
    return train(windows, targets, labels)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    A text that is null, empty or without a letter gives ``und`` with score 0, and so does every text if there was nothing
    to learn from. Texts are read whole; equal texts get equal results; ties go to the first label by name.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()) if net else None)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            texts = [t if t and LETTER.search(t) else None for t in batch.column(place).to_pylist()]
            at = 0
            while at < len(texts):  # blocks of texts, so that windows stay small however long the batch is
                end, size = at, 0
                while end < len(texts) and size < 1 << 21:
                    size += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                at = end
                if model is None or not any(part):
                    names += [NONE] * len(part)
                    scores += [0.0] * len(part)
                    continue
                net_, tables = model
                windows, owner, sizes = windows_of([t or "" for t in part])
                mass = net_.probabilities(windows, tables) * sizes[:, None]
                total = np.zeros((len(part), mass.shape[1]))
                np.add.at(total, owner, mass)
                total /= total.sum(axis=1, keepdims=True)
                for t, row in zip(part, total):
                    best = int(row.argmax())
                    names.append(net_.labels[best] if t else NONE)
                    scores.append(float(min(1.0, row[best])) if t else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*batch.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return map_texts(docs.select(*kept), predict, schema)


def drop_unidentified(docs: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """The documents whose text has a language, with their columns: texts without a letter go, and no others, also if there is
    no labelled text to learn from."""
    net = fit(docs, text, label)
    if net is None:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    found = identify(docs.select("*", F.col(text).alias("__text")), net, "__text")
    return found.where(F.col("lang_pred") != NONE).select(*docs.columns)
