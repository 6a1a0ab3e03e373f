"""Spelling variants: words one edit apart, and the frequent form each of them goes to.

Pairs are found by asymmetric chunks. A word cut into two disjoint chunks keeps one of them whole under one edit: the first at its
place, the second moved by at most one. So one word of a pair contributes its two chunks, the other its grams of the chunks' sizes
at the places within one of where a chunk may be; grams elsewhere could not join. The shorter word (or either of two equally
long) gives the chunks. A chunk is written as what lies before and after a *window*, the part that may
differ: the first chunk has the window behind it, the second the one before it. Words meet in a bucket of equal outsides and
are verified by their edit distance.

A bucket of many words (a common stem, say) is not compared pair by pair: its words agree on the chunk, so the window alone is cut into
two chunks anew, and so on until buckets are small or the window is a single place, where what meets is a variant.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.session import sized_side, stage_scope, write_stage

SHORTEST, LEAST_COUNT = 7, 2
DROP_ONE_IN = 31
FORM_RATIO = 10
# Members of a bucket beyond which its windows are cut again.
BUCKET = 64
# Windows of more characters are cut again too, as comparing them takes the square of their length.
WINDOW = 16
# Bytes of distinct words that a task counts before it hands them on.
HELD_BYTES = 16 << 20


def lowered(text: str) -> str:
    """A-Z in lower case, all other characters as they are."""
    return text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode("utf-8")


def misspelt(runs: Counter, doc: str) -> Iterator[tuple[str, int]]:
    """The runs of a document with their counts; one in ``DROP_ONE_IN`` by hash loses a character."""
    before = zlib.crc32(f"{doc}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run, n


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``SHORTEST`` characters; counted in the tasks before anything is shuffled."""
    pattern = r"[a-zÀ-ÿ]{%d,}" % SHORTEST

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        held: Counter = Counter()
        size = 0

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1)):
                runs = Counter(find(lowered(body.as_py() or "")))
                for word, n in misspelt(runs, doc.as_py() or ""):
                    if word not in held:
                        size += 64 + len(word)
                    held[word] += n
                if size >= HELD_BYTES:
                    yield hand_on()
                    held, size = Counter(), 0
        if held:
            yield hand_on()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def outside(word: Column, size: Column, first: Column, last: Column, shift: Column) -> Column:
    """Key of what lies outside the window [first, last) of a chunk word of ``size``; ``shift``: how much longer this word is."""
    before = F.substring(word, F.lit(1), first)
    after = F.substring(word, last + shift + 1, F.length(word))
    return F.xxhash64(size, first, last, before, after)


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, shift, first, last) with the key of their bucket."""
    size = F.length("word") - F.col("shift")
    return rows.withColumn("key", outside(F.col("word"), size, F.col("first"), F.col("last"), F.col("shift")))


def halves(first: Column, last: Column, size: Column) -> Column:
    """The two windows that the cut of [first, last) into two chunks leaves.

    A window holds the places from its first one up to its last, where the next window begins. A single place has the empty window
    before it, and the one behind it only at the end of a word of ``size``, where no other window begins.
    """
    middle = F.floor((first + last) / 2).cast("int")
    single = last - first == 1
    lower = F.struct(first.alias("first"), F.when(single, first).otherwise(middle).alias("last"))
    upper = F.struct(F.when(single, last).otherwise(middle).alias("first"), last.alias("last"))
    return F.when(single & (last < size), F.array(lower)).otherwise(F.array(lower, upper))


def chunks_and_grams(words: DataFrame) -> DataFrame:
    """(word, n, shift, first, last): each word as a chunk word (``shift`` 0) and as the gram word of a chunk word that is
    one shorter (``shift`` 1). At equal length the gram at a chunk's place is the chunk, so one row serves as both."""
    size = F.length("word") - F.col("shift")
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    return rows.select("word", "n", "shift", F.inline(halves(F.lit(0), size, size)))


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (word, other, n, other_n) of each bucket: chunk words with each other, and with gram words.

    A pair is taken in one bucket only. Two words of one length differ in one window. An inserted character may
    have several places, as in a run of equal ones; the window that holds the last of them, where the common beginning ends, has the pair.
    """
    chunk = rows.where("shift = 0").select("key", "word", "n", "first", "last")
    gram = rows.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "shift")
    end = F.greatest(F.col("last"), F.col("first") + 1)
    begins = F.substring(F.col("word"), F.lit(1), end) == F.substring(F.col("other"), F.lit(1), end)
    inserted = (F.col("shift") == 1) & ((F.col("last") == F.length("word")) | ~begins)
    pairs = chunk.join(gram, "key").where(inserted | ((F.col("shift") == 0) & (F.col("word") < F.col("other"))))

    def part(word: str, first: Column, size: Column) -> Column:
        return F.substring(F.col(word), first + 1, size)

    # Equal keys are made sure of; then the words are as far apart as their windows are.
    size = F.col("last") - F.col("first")
    before = part("word", F.lit(0), F.col("first")) == part("other", F.lit(0), F.col("first"))
    after = part("word", F.col("last"), F.length("word")) == part("other", F.col("last") + F.col("shift"), F.length("other"))
    apart = F.levenshtein(part("word", F.col("first"), size), part("other", F.col("first"), size + F.col("shift")), 1)
    return pairs.where(before & after & (apart == 1)).select("word", "other", "n", "other_n")


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, other, n, other_n), once for each two words (word, n) that are exactly one edit apart."""
    found: list[DataFrame] = []
    rows = write_stage(keyed(chunks_and_grams(words)), "chunks")
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("members"), F.count_if(F.col("shift") == 0).alias("chunk_words"))
        # A bucket of one word, or of grams alone, has no pair.
        sizes = write_stage(sizes.where("members > 1 AND chunk_words > 0").select("key", (F.col("members") > bucket).alias("large")), "buckets")
        met = write_stage(rows.join(sized_side(sizes), "key"), "bucket-words")
        # An empty window is not cut: what meets there is one word and its variants.
        size = F.col("last") - F.col("first")
        large = F.col("large") | (size > WINDOW)
        cut = met.where(large & (size > 0)).select(*rows.columns)
        # At a single place, chunk words of one length differ there and nowhere else: all their pairs are variants.
        whole = ~large | (size == 0) | ((size == 1) & (F.col("shift") == 0))
        found.append(write_stage(bucket_pairs(met.where(whole).select(*rows.columns)), "near-words"))
        if cut.isEmpty():
            break
        windows = cut.select("word", "n", "shift", F.inline(halves(F.col("first"), F.col("last"), F.length("word") - F.col("shift"))))
        rows = write_stage(keyed(windows), "chunks")
    return reduce(DataFrame.unionByName, found)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last one, each step twice as far as the one before.

    A form has a higher count than its word, so there are no cycles.
    """
    reached = write_stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = sized_side(write_stage(reached.select(F.col("word").alias("root"), F.col("root").alias("further")), "further"))
        step = write_stage(reached.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went_on")), "roots")
        reached = step.select("word", "root")
        if step.where("went_on").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, text: str = "text", ratio: int = FORM_RATIO, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of the texts.

    Words are maximal runs of ASCII and Latin-1 letters (U+00C0 to U+00FF), A-Z in lower case; a run whose CRC-32 of
    ``doc_id:run`` is divisible by 31 loses the character at that hash modulo its length. Kept are words of at least 7 characters
    that occur at least twice in all documents. ``n_near`` counts the kept words exactly one edit away; ``form`` is the one of
    them with the largest ``n`` (ties: the first by code points), if that is at least ``ratio`` times the word's, else null; ``root`` is
    the last form of the forms, the word itself if it has none. A null text has no words, a null ``doc_id`` reads as an empty one,
    repeated rows count each, an empty table gives no rows, other columns are not read.
    """
    with stage_scope(docs.sparkSession):
        words = write_stage(word_counts(docs, text).where(F.col("n") >= LEAST_COUNT), "words")
        pairs = near_pairs(words, bucket)
        both = pairs.select("word", "n", "other", "other_n").unionByName(
            pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        )
        best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
        near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("own"))
        formed = -F.col("best.less") >= F.lit(ratio) * F.col("own")
        near = near.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
        near = write_stage(near, "near")
        roots = sized_side(write_stage(last_forms(near.where("form IS NOT NULL")), "last-forms"))
        whole = words.join(sized_side(near), "word", "left").join(roots, "word", "left")
        result = whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
        return write_stage(result, "spelling-variants", keep=True)
