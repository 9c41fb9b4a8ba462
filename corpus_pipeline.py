"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talus.llm import bpe, decontaminate, jaccard_join, quality, secrets
from talus.llm.common import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go.

    Null, empty and wordless texts fail the base rules and go. A null language is a language of its own. Repeated rows all
    stay or all go. Texts are read whole.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a Jaccard similarity of 0.8 or more, the document of the least id stays.

    Texts without words, null ones included, are one class. Repeated rows stay once; of texts that differ and share the
    least id of their class each stays. Null ids come last.
    """
    return jaccard_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and without items all stay."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, null texts as they are; secrets are replaced and n_chars is brought up to date."""
    return secrets.redact(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every row; a null or empty text has none."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_tokens=True)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_redaction), ("byte-level BPE", tokenization)]

#: Several stages (a fitted perplexity model, a random-field tagger, BPE merges) have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, one after the other.

    Each stage handles nulls, empty and very long texts, ties and repeated rows as its docstring says; columns beside those
    of documents, whatever their names, travel through all stages but the last. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
