"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm import (
    bpe, drift_clusters, harmonic_packing, language, license_scan, nn_descent, personal_data, separator_scan, sharding, spaced_seeds, spelling_variants,
    url_lists, weighted_dedup,
)
from sitegraph.session import write_stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = spaced_seeds.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.col("item").alias("item_id"), "item_words", "n_windows", "best_matches", "n_covered")


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time, a day of 2024 that follows from the URL."""
    day = F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % 360
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """List entries as reports would give them: what a page's URL looks like says which list changes on its day."""
    host = url_lists.url_host(F.col("url"))
    site = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    section = F.concat_ws("/", host, F.element_at(url_lists.url_segments(F.col("url")), 1))

    def entry(pattern, name, action, key):
        return F.when(F.col("url").rlike(pattern), F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), key.alias("key")))

    reports = F.array(
        entry("utm_source=", "block", "add", host), entry("#top$", "block", "remove", host),
        entry("[.]html$", "block", "add", section), entry("/$", "block", "remove", section),
        entry("[?]page=", "allow", "add", section), entry("//m[.].*[.]html$", "allow", "remove", section),
        entry("//blog[.].*/$", "allow", "add", host), entry("//blog[.].*[.]html$", "block", "add", site),
    )
    found = captures.select(F.to_date("fetched_at").alias("day"), F.explode(F.array_compact(reports)).alias("e"))
    return found.select("e.list", "e.key", "e.action", "day")


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the lists, as they were on the day of the fetch, for every page."""
    captures = dated_captures(spark, sf_dir)
    return url_lists.judge_captures(captures, dated_entries(captures)).select(
        "page_id", "url", F.to_date("fetched_at").cast("string").alias("fetched_on"), "verdict", "rule_key", F.col("rule_since").cast("string").alias("rule_since"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document, by recognised sentences."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"), F.col("n_unmatched").cast("long").alias("n_unmatched"),
    )


def op4_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    held_out = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weighted_dedup.near_duplicate_classes(docs).select("doc_id", "class_id", "kept")


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from flat token files that were written of them, without an index."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    docs = table(spark, sf_dir, "documents")
    files = write_stage(separator_scan.token_files(docs, ranks, public_tokenizers.PATTERN, separator=50256), "token-files")
    return separator_scan.document_lengths(files, separator=50256)


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with equal labels."""
    return nn_descent.embedding_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op8_skip_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the counts and the digest are those of the base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find_personal_data(docs, personal_data.fit(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_streaming_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of the tokens of every document and of the text decoded from them."""
    words = bpe.Vocabulary.read(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), words)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 1024."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = harmonic_packing.pack_documents(docs, ranks, public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, separator=0)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every embedding of 64 components, of 40 clusters after five rounds."""
    return drift_clusters.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("n_scans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the frequent words that they are variants of."""
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_url_lists": op2_url_lists,
    "op3_license_scan": op3_license_scan,
    "op4_byte_network": op4_byte_network,
    "op5_weighted_near_dedup": op5_weighted_near_dedup,
    "op6_separator_scan": op6_separator_scan,
    "op7_nn_descent": op7_nn_descent,
    "op8_skip_chain_field": op8_skip_chain_field,
    "op9_vector_packing": op9_vector_packing,
    "op10_streaming_bpe": op10_streaming_bpe,
    "op11_harmonic_packing": op11_harmonic_packing,
    "op12_drift_clusters": op12_drift_clusters,
    "op13_spelling_variants": op13_spelling_variants,
}
