"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to what they find.

The patterns give the base spans. Tokens with a digit or an at sign are the nodes of a field over the labels none,
email, ip, card and phone (all other tokens are none, which needs no node). Neighbouring nodes share a chain potential;
occurrences of the same digits, or of the same address, share a skip potential however far apart they are. A card
or phone found by a pattern and tokens that together have its digits, for a phone also without its country code, share a
fixed one.
Potentials are learned by pseudo-likelihood from the base spans of a bounded sample. Base spans are then observed,
loopy message passing carries their labels along chain and skip edges, and tokens outside of them whose marginal is
high enough become spans if they look like their kind. So a number that was found once is also found where it
is written in another way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegraph.session import map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# Bounds of the sample the field is trained on.
SAMPLE_DOCUMENTS, SAMPLE_TOKENS = 5_000, 64
# Digits of a number that is found again in another form, in however many pieces.
LEAST_DIGITS, MOST_DIGITS = 7, 19
# Potential of equal labels for occurrences of a whole number. It is fixed: patterns find each form of a number or none, so a
# sample labelled by them cannot show that a number in another form is the same.
SAME = 12.0
# Graphs of a batch are taken together up to this many nodes; edges are worked on in blocks of this size.
PACK_NODES = 65_536
EDGE_BLOCK = 16_384
CERTAIN = 0.9
ROUNDS = 30

SPAN_COLUMN = "pii array<struct<kind:string,start:int,end:int,base:boolean>>"
CLUE = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
NO_DIGIT = re.compile(r"[^0-9]+")
EDGE_LEFT, EDGE_RIGHT = "([{<\"'*#", ".,;:!?)]}>\"'*#%&$|"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each at sign is looked at once, and the name before it is the run that ends there: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            found.append((start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    found = []
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                found.append((start, end))
            start = end + 1
    return found


def cards(text: str) -> list[tuple[int, int]]:
    digits = ((m, NO_DIGIT.sub("", m.group())) for m in CARD.finditer(text))
    return [m.span() for m, d in digits if 16 <= len(d) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NO_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of the patterns, by kind, then start."""
    if not CLUE.search(text):
        return []
    finders = (emails, addresses, cards, phones)
    return [(k + 1, start, end) for k, find in enumerate(finders) for start, end in find(text)]


@dataclass
class Nodes:
    """The nodes of one text: place, features, observed label (-1: not observed), edges."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    observed: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    same: list[tuple[int, int]] = field(default_factory=list)


FEATURES = 48


def features_of(token: str, before: bool, after: bool) -> list[int]:
    """Numbers of the features a token has."""
    digits = NO_DIGIT.sub("", token)
    n = len(digits)
    out = [0, 1 + min(n, 20), 22 + min(token.count("."), 4)]
    flags = (
        "@" in token, "@" in token and "." in token.partition("@")[2], token.startswith("+"), "(" in token, ")" in token,
        "-" in token, n == len(token), any(c.isalpha() for c in token), 16 <= n <= 19 and luhn(digits),
        DOTTED.fullmatch(token) is not None and token.count(".") == 3, before, after, "/" in token or ":" in token,
        "=" in token or "_" in token, n * 2 < len(token),
    )
    return out + [27 + k for k, flag in enumerate(flags) if flag]


def span_keys(label: int, digits: str) -> set[str]:
    """The digits by which a card or phone is found again; a phone is also written without its country code."""
    return {digits} | ({digits[k:] for k in (1, 2, 3) if len(digits) - k >= LEAST_DIGITS} if label == 4 else set())


def repeated_edges(text: str, places: list[tuple[int, int]], over: list[tuple[int, int, int] | None], linked: set[int]) -> set[tuple[int, int]]:
    """Edges between occurrences of the whole digits of card and phone spans: runs of neighbouring tokens
    with digits outside of spans, up to ``MOST_DIGITS`` digits, and the spans themselves. Each node is linked with the occurrences before and after, along a path per key."""
    occurrences: dict[str, list[list[int]]] = {}
    of_span: dict[tuple[int, int, int], list[int]] = {}
    for i, span in enumerate(over):
        if span and span[0] in (3, 4):
            of_span.setdefault(span, []).append(i)
    for (label, start, end), nodes in of_span.items():
        for key in span_keys(label, NO_DIGIT.sub("", text[start:end])):
            occurrences.setdefault(key, []).append(nodes)
    if not occurrences:
        return set()
    for i in range(len(places)):
        digits = ""
        for j in range(i, len(places)):
            more = "" if over[j] or (j > i and j not in linked) else NO_DIGIT.sub("", text[places[j][0] : places[j][1]])
            if not more or len(digits) > MOST_DIGITS:
                break
            digits += more
            # A number may be written with the zeros that stand for the country or the region.
            for key in {digits, digits.lstrip("0")}:
                if key in occurrences:
                    occurrences[key].append([*range(i, j + 1)])
    edges = set()
    for found in occurrences.values():
        found.sort()
        for before, nodes in zip(found, found[1:]):
            edges.update((before[-1], i) for i in nodes if i not in before)
            edges.update((i, nodes[0]) for i in before if i not in nodes)
    return edges


def nodes_of(text: str, spans: list[tuple[int, int, int]]) -> Nodes:
    """A token keeps its place without the punctuation around it; neighbours stand one blank apart."""
    places = []
    for m in NODE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in EDGE_LEFT and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in EDGE_RIGHT and not (text[end - 1] == ")" and "(" in text[start:end]):
            end -= 1
        if start < end:
            places.append((start, end))
    ordered, at, longest = sorted(spans, key=lambda s: s[1]), 0, []
    for start, end in places:
        while at < len(ordered) and ordered[at][2] <= start:
            at += 1
        # Spans of different kinds may overlap; the longest one over the token counts.
        over = [s for s in ordered[at : at + 4] if s[1] < end and s[2] > start]
        longest.append(max(over, key=lambda s: s[2] - s[1]) if over else None)
    observed = [s[0] if s else -1 for s in longest]
    chain = [(i, i + 1) for i in range(len(places) - 1) if places[i + 1][0] - places[i][1] == 1]
    linked_left, linked_right = {j for _, j in chain}, {i for i, _ in chain}
    features, skip, last = [], [], {}
    for i, (start, end) in enumerate(places):
        token = text[start:end]
        features.append(features_of(token, i in linked_left, i in linked_right))
        digits = NO_DIGIT.sub("", token)
        # Occurrences form a path, so that edges grow with the tokens and not with their square.
        key = token.lower() if "@" in token else digits if len(digits) >= 3 else None
        if key:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return Nodes(places, features, observed, chain, skip, sorted(repeated_edges(text, places, longest, linked_left)))


@dataclass
class Field:
    """Potentials: by feature and label, and by pairs of labels along the two sorts of edges."""

    single: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, graphs: list[Nodes]) -> np.ndarray:
        """Marginals of all nodes, the graphs one after the other; those of a graph do not depend on the others."""
        packs: list[list[Nodes]] = []
        held = PACK_NODES
        for graph in graphs:
            held += len(graph.spans)
            if held > PACK_NODES:
                packs.append([])
                held = len(graph.spans)
            packs[-1].append(graph)
        return np.concatenate([np.zeros((0, len(LABELS))), *map(self.marginals_of_pack, packs)])

    def marginals_of_pack(self, graphs: list[Nodes]) -> np.ndarray:
        """Loopy message passing on a few graphs at once. A graph rests once its own messages have settled. Messages are worked
        out for ``EDGE_BLOCK`` edges at a time, so that only the messages themselves are held for all edges."""
        k = len(LABELS)
        offsets = np.cumsum([0] + [len(g.spans) for g in graphs])
        single = np.array([self.single[f].sum(axis=0) for g in graphs for f in g.features]).reshape(-1, k)
        observed = np.array([o for g in graphs for o in g.observed], dtype=np.int64)
        seen = np.flatnonzero(observed >= 0)
        single[seen] -= 50.0
        single[seen, observed[seen]] += 100.0
        parts = [
            (np.array(edges, dtype=np.int32).reshape(-1, 2) + np.int32(at), i, kind)
            for i, (g, at) in enumerate(zip(graphs, offsets)) for kind, edges in enumerate((g.chain, g.skip, g.same)) if edges
        ]
        if parts:
            ends = np.concatenate([part for part, _, _ in parts])
            sizes = [len(part) for part, _, _ in parts]
            # Edge e is walked from a to b as e, and from b to a as e + m.
            m = len(ends)
            kind = np.repeat(np.array([kind for _, _, kind in parts], dtype=np.int8), sizes)
            graph = np.tile(np.repeat(np.array([i for _, i, _ in parts], dtype=np.int32), sizes), 2)
            source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
            potentials = np.stack([self.chain, self.skip, SAME * np.eye(k)])
            potentials = np.stack([potentials, potentials.transpose(0, 2, 1)])
            messages, new = np.zeros((2 * m, k)), np.empty((2 * m, k))
            active = np.arange(2 * m, dtype=np.int32)
            for _ in range(ROUNDS):
                belief = single.copy()
                for label in range(k):
                    belief[:, label] += np.bincount(target, messages[:, label], minlength=len(belief))
                change = np.zeros(len(graphs))
                for at in range(0, len(active), EDGE_BLOCK):
                    e = active[at : at + EDGE_BLOCK]
                    back = np.where(e < m, e + m, e - m)
                    tables = potentials[(e >= m).astype(np.int8), kind[np.minimum(e, back)]]
                    out = np.logaddexp.reduce((belief[source[e]] - messages[back])[:, :, None] + tables, axis=1)
                    out -= out.max(axis=1, keepdims=True)
                    np.maximum.at(change, graph[e], np.abs(out - messages[e]).max(axis=1))
                    new[e] = out
                for at in range(0, len(active), EDGE_BLOCK):
                    e = active[at : at + EDGE_BLOCK]
                    messages[e] = 0.5 * messages[e] + 0.5 * new[e]
                active = active[change[graph[active]] >= 1e-3]
                if not len(active):
                    break
            for label in range(k):
                single[:, label] += np.bincount(target, messages[:, label], minlength=len(single))
        single -= single.max(axis=1, keepdims=True)
        np.exp(single, out=single)
        return single / single.sum(axis=1, keepdims=True)


def train(rows: list[tuple[list[int], int, list[int], list[int]]], steps: int = 200, seed: int = 3) -> Field:
    """Pseudo-likelihood of (features, label, labels along chain edges, labels along skip edges).

    A token's own features are hidden half of the time, so that the edges have to explain labels too.
    """
    k, n = len(LABELS), len(rows)
    field = Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))
    if not any(row[1] for row in rows):
        field.single[0, 0] = 10.0  # nothing was found, so there is nothing to carry on
        return field
    draw = np.random.default_rng(seed)
    x = np.zeros((n, FEATURES + 2 * k))
    for i, (features, _, chain, skip) in enumerate(rows):
        x[i, features] = 1
        for labels, at in ((chain, FEATURES), (skip, FEATURES + k)):
            for label in labels:
                x[i, at + label] += 1
    y = np.array([row[1] for row in rows])
    # Labels have the same total say, however rare they are.
    share = (1 / np.maximum(1, np.bincount(y, minlength=k)))[y]
    share /= share.sum()
    w, m, v = (np.zeros((x.shape[1], k)) for _ in range(3))
    for step in range(1, steps + 1):
        hidden = x.copy()
        hidden[draw.random(n) < 0.5, 1:FEATURES] = 0
        logits = hidden @ w
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        grad = hidden.T @ (p * share[:, None]) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    chain, skip = w[FEATURES : FEATURES + k], w[FEATURES + k :]
    return Field(w[:FEATURES], (chain + chain.T) / 2, (skip + skip.T) / 2)


def training_rows(text: str) -> list[tuple[list[int], int, list[int], list[int]]]:
    spans = base_spans(text)
    nodes = nodes_of(text, spans)
    label = [max(o, 0) for o in nodes.observed]
    around: tuple[dict, dict] = ({}, {})
    for near, edges in zip(around, (nodes.chain, nodes.skip)):
        for a, b in edges:
            near.setdefault(a, []).append(label[b])
            near.setdefault(b, []).append(label[a])
    every = [(f, label[i], around[0].get(i, []), around[1].get(i, [])) for i, f in enumerate(nodes.features)]
    # Labelled tokens first, so that a text full of numbers still shows what was found in it.
    return sorted(every, key=lambda row: row[1] == 0)[:SAMPLE_TOKENS]


def fit(docs: DataFrame, text: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> Field:
    """The field, trained on about ``sample_documents`` different texts with a digit or an at sign, drawn by a hash of their text."""
    clues = docs.where(F.col(text).rlike(CLUE.pattern)).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # Copies of a text are counted and drawn once, so that a hot text is one document of the sample.
    share = min(1.0, sample_documents / max(1, clues.select("h").distinct().count()))
    drawn = clues.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).dropDuplicates(["h"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            found = [(h, *row) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in training_rows(t)]
            kinds = (pa.int64(), kind, pa.int32(), kind, kind)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["h", "f", "y", "chain", "skip"])

    sample = map_texts(drawn, rows, "h long, f array<int>, y int, chain array<int>, skip array<int>").collect()
    return train([tuple(row)[1:] for row in sorted(sample, key=lambda r: (r["h"], r["f"], r["y"]))])


def looks_like(label: int, token: str) -> bool:
    digits = NO_DIGIT.sub("", token)
    if label == 1:
        return "@" in token and "." in token.rpartition("@")[2]
    if label == 2:
        return len(re.findall("[0-9]+", token)) == 4
    if label == 3:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in token)


def added_spans(text: str, nodes: Nodes, marginals: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of neighbouring unobserved nodes with one certain label that look like their kind."""
    linked = {j for _, j in nodes.chain}
    label = np.where(marginals[:, 1:].max(axis=1) >= CERTAIN, marginals.argmax(axis=1), 0)
    runs: list[list[int]] = []
    for i, (start, end) in enumerate(nodes.spans):
        if nodes.observed[i] >= 0 or not label[i]:
            continue
        if runs and runs[-1][3] == i - 1 and i in linked and runs[-1][0] == label[i]:
            runs[-1][2:] = [end, i]
        else:
            runs.append([int(label[i]), start, end, i])
    return [(k, start, end) for k, start, end, _ in runs if looks_like(k, text[start:end])]


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for label, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{LABELS[label]}]"]
        at = end
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, field: Field, text: str = "text", mask: bool = False) -> DataFrame:
    """``docs`` with ``pii``, an array of (kind, start, end, base) in code points, by kind, then start.

    With ``mask`` the text is replaced by its masked form. A null text counts as empty and stays null. Texts are read whole;
    equal texts get equal results; a column named ``pii`` is replaced.
    """
    kept = [c for c in docs.columns if c != "pii"]
    place = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = [base_spans(t) if t else [] for t in texts]
            base = [len(s) for s in spans]
            graphs = {i: nodes_of(t, spans[i]) for i, t in enumerate(texts) if t and CLUE.search(t)}
            graphs = {i: g for i, g in graphs.items() if -1 in g.observed}
            if graphs:
                marginals, at = shared.value.marginals([*graphs.values()]), 0
                for i, g in graphs.items():
                    spans[i] = spans[i] + added_spans(texts[i], g, marginals[at : at + len(g.spans)])
                    at += len(g.spans)
            rows = [
                sorted(({"kind": LABELS[k], "start": a, "end": b, "base": j < n} for j, (k, a, b) in enumerate(s)),
                       key=lambda s: (KINDS.index(s["kind"]), s["start"]))
                for s, n in zip(spans, base)
            ]
            columns = [*batch.columns, pa.array(rows, pa.list_(span))]
            if mask:
                columns[place] = pa.array([masked(t, s) if s else t for t, s in zip(texts, spans)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*batch.schema, pa.field("pii", pa.list_(span))]))

    schema = docs.select(*kept).schema.add(StructType.fromDDL(SPAN_COLUMN).fields[0])
    return map_texts(docs.select(*kept), find, schema)
