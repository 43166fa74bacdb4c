"""Corpus preparation: toxicity, near duplicates, secrets, mixing, BPE encoding.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns the rows
that it keeps, which are written as Parquet and read again as the next one's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from corpus_search.llm.common import documents, fresh, written
from corpus_search.llm.queries import TARGETS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half, all of them if the labels table gives nothing to learn from."""
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    return docs.where(toxicity.score(F.coalesce(F.col("text").cast("string"), F.lit("")), model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies."""
    return jaccard_join.first_of_groups(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and the lengths brought up to date."""
    if "n_chars" not in docs.columns:
        return secret_scan.redact(docs)
    old = fresh(docs, stem="_old")
    marked = secret_scan.redact(docs.withColumn(old, F.col("text")))
    length = F.when(F.col(old).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.withColumn("n_chars", length).select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of languages below their target share repeated by their fitted rate."""
    return mixing.repeat(docs, mixing.fit_classifier(docs, domain_col="lang"), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and packed BPE ids of every remaining text."""
    lexicon = bpe.build_lexicon(docs, "text", bpe.default_tokenizer())
    return bpe.encode_documents(docs, lexicon)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_languages),
    ("bpe", encode),
]

#: SQL can't express a trained model or token merging; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
