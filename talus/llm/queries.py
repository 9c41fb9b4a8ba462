"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustered, decontaminate, jaccard_join, licenses, lm_score, mixing, negatives, pii, quality, secrets, warc
from .common import table


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, by CGK embedding, bit sampling and exact edit distance."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by the conditional random field, base patterns included."""
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and found again through the capture index."""
    pages = table(spark, sf_dir, "pages")
    folder, top, captures = warc.archive(spark, pages)
    return warc.lookup(warc.capture_keys(pages), top, folder, warc.reading_tasks(captures)).drop("payload")


def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document, and the verdict of the perplexity bands."""
    return quality.check(table(spark, sf_dir, "documents"), carry=["doc_id", "lang"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document by anchor expansion."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in pii.BASE_KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every document, and the licence that it is."""
    return licenses.find(table(spark, sf_dir, "documents"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by unigrams and by logistic context mixing, both learned from the training part."""
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.held_out(F.col("doc_id")))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from the perspective of each participant, texts as digests."""
    turns = chat.rotate(table(spark, sf_dir, "conversations"))
    return turns.withColumn("rendered_sha256", F.sha2("rendered", 256)).drop("rendered")


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document by the chosen-path join."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by byte-level BPE."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive by pivot distances."""
    return negatives.of_embeddings(table(spark, sf_dir, "embeddings"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix takes that meets its sources' targets."""
    mixed = mixing.document_mix(table(spark, sf_dir, "documents")).withColumn("source", F.col("sources")[0])
    return mixed.select("doc_id", "size", F.col("source.size").alias("source_size"), F.col("source.target").alias("target"), "taken")


def op13_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a layout along the Morton curve, and the files that its query touches."""
    placed = clustered.document_layout(table(spark, sf_dir, "documents"))
    return placed.withColumn("file_bounds", F.concat_ws(",", F.transform("bounds", lambda x: x.cast("string")))).drop("bounds")


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_secret_scan, op3_warc_index, op4_quality_perplexity, op5_pii_anchors, op6_license_digest, op7_context_mixing, op8_perspectives, op9_chosen_path_join, op10_byte_bpe, op11_hard_negatives, op12_source_mix, op13_clustered_layout)
}
_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, upper(sha1(payload)) AS hex, min(page_id) OVER (PARTITION BY sha1(payload)) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((instr('0123456789ABCDEF', substr(hex, (5 * i // 4 + 1)::BIGINT, 1)) - 1) * 16 + instr('0123456789ABCDEF0', substr(hex || '0', (5 * i // 4 + 2)::BIGINT, 1)) - 1) // (2 ** (3 - 5 * i % 4))::BIGINT % 32 + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
ORACLE_SQL: dict[str, str] = {"op3_warc_index": _WARC_SQL, "op6_license_digest": licenses.oracle_sql(), "op8_perspectives": chat.oracle_sql(), "op11_hard_negatives": negatives.ORACLE_SQL, "op12_source_mix": mixing.oracle_sql(), "op13_clustered_layout": clustered.oracle_sql()}
