"""Question answering as one Spark job over a *table* of questions.

documents -> fixed chunks (1000/200) -> hashed embedding  \
questions -> skip blank -> hashed embedding ----------------> exact kNN (top-k) -> text by id
          -> ordered context per question -> truncate to the token budget

The search runs on (id, vector) only; chunk text is joined back for the k winners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions import text as T
from corpus_search.operators import chunking, context, embedding, knn


def question_table(questions: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Questions with blank ones removed."""
    return questions.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("question")).filter(~T.is_blank("question"))


def chunk_documents(documents: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    return chunking.with_chunk_ids(chunking.chunk_fixed(documents, size=size, overlap=overlap))


def search_chunks(
    documents: DataFrame,
    questions: DataFrame,
    k: int = 5,
    size: int = 1000,
    overlap: int = 200,
    dims: int = embedding.HASH_DIMS,
    **knn_args,
) -> tuple[DataFrame, DataFrame]:
    """Top-k chunk hits per question. Returns (hits, chunks)."""
    chunks = chunk_documents(documents, size, overlap)
    chunk_vecs = embedding.embed_hashed(chunks.select("chunk_id", "text"), dims=dims, keep=["chunk_id"])
    q = question_table(questions)
    q_vecs = embedding.embed_hashed(q, text_col="question", dims=dims, keep=["query_id"])
    hits = knn.knn(q_vecs, chunk_vecs, k, vec_id="chunk_id", **knn_args)
    return hits, chunks


def knn_with_text(documents: DataFrame, questions: DataFrame, k: int = 5, **kw) -> DataFrame:
    hits, chunks = search_chunks(documents, questions, k, **kw)
    n_q = question_table(questions).count()
    joined = context.attach_text(hits, chunks, id_col="vec_id", cols=("doc_id", "chunk_index", "text"), max_hits=n_q * k)
    return joined.select(
        "query_id",
        "rank",
        F.col("vec_id").alias("chunk_id"),
        "doc_id",
        "chunk_index",
        F.round("distance", 6).alias("distance"),
        F.round("score", 6).alias("score"),
        "text",
    )


def retrieve_context(
    documents: DataFrame,
    questions: DataFrame,
    k: int = 5,
    max_tokens: int = context.CONTEXT_TOKENS,
    **kw,
) -> DataFrame:
    """Context per question: top-k chunk texts in rank order, cut to the token budget."""
    hits = knn_with_text(documents, questions, k, **kw)
    ctx = hits.groupBy("query_id").agg(
        context.ordered_join(F.col("rank"), F.col("text"), context.CONTEXT_SEPARATOR).alias("context"),
        F.count("*").alias("n_chunks"),
        F.max("score").alias("top_score"),
    )
    return context.truncate_tokens(ctx, "context", max_tokens)
