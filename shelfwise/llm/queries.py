"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bpe,
    burst_trie,
    contextual_pii,
    merkle,
    minhash,
    packing,
    quality,
    secret_scan,
    suffix_dedup,
    tag_paths,
    topk,
    warc,
    winnowing,
)
from shelfwise.llm.storage import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tag_paths.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return pages.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), *files).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    kinds = F.array(*[F.lit(rule.kind) for rule in secret_scan.RULES])

    def written(spans: Column) -> Column:
        parts = F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
        return F.concat_ws(",", parts)

    def of_kind(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")

    return found.select(
        "row.doc_id",
        *[of_kind(k).alias(f"n_{rule.kind}") for k, rule in enumerate(secret_scan.RULES[: secret_scan.BASE])],
        F.sha2(written(F.filter("found", lambda x: x["k"] < secret_scan.BASE)), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


@query
def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash.near_duplicates(documents, minhash.Likeness(words=3, part=85, whole=100))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.assess(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op7_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64)


@query
def op8_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder, least_bytes=0)
    return warc.read_archive(spark, folder).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query
def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextual_pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [f"n_{kind}" for kind in contextual_pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(documents, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.remove_repeats(documents, suffix_dedup.Repeats(400)).select(
        "row.doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # a cut may fall inside a character; the bytes themselves are in the digest
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query
def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return winnowing.compare_edited(documents).select(
        "row.doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.written(F.col("marks")).alias("fingerprint"),
        winnowing.written(F.col("edited_marks")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        winnowing.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


@query
def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return burst_trie.prefix_trie(burst_trie.mixed(burst_trie.in_order(turns)))


@query
def op13_level_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # every second document, by a hash of its id, loses its line breaks after the manifest is made
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(
        documents,
        merkle.leaf(*before, F.col("text")),
        F.col("source"),
        F.col("doc_id"),
        [F.col("doc_id"), merkle.leaf(*before, text).alias("now")],
    )
    return made.select(
        "row.doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.col("row.now"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
