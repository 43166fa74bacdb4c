"""Text embedding.

The built-in embedder is a deterministic hashed bag of words: each lower-cased whitespace
token goes to bucket ``int(md5(token)[:7], 16) mod dims``; the bucket counts are L2-normalised.
Per part of an Arrow batch (bounded in rows and bytes), Arrow C++ lower-cases and splits the text, tokens are dictionary-encoded so
md5 runs once per distinct token (cached per worker), and one ``bincount`` builds the counts.
``hash_buckets`` is the same bucket rule as a native column expression.

User models plug in through :func:`embed_with`, which hands Arrow batches of text to a
callable returning a ``(rows, dims)`` matrix (the shape of a remote/batched embedding model).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.functions import text as T
from corpus_search.functions.batches import parts

# Fixed value: default width of the built-in hashed embedding.
HASH_DIMS = 256


def hash_buckets(text: Column, dims: int = HASH_DIMS) -> Column:
    """Array of bucket ids, one per token (native)."""
    return F.transform(
        T.tokens(text),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("bigint"), F.lit(dims)).cast("int"),
    )


def _matrix_to_list(mat: np.ndarray, value_type: pa.DataType) -> pa.Array:
    n, d = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.reshape(-1).astype(value_type.to_pandas_dtype())))


def _normalise(mat: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    return np.divide(mat, norms[:, None], out=np.zeros_like(mat), where=norms[:, None] > 0)


# token -> bucket, per Python worker and width; survives across batches. Capped so a worker
# holds at most ~50 MB of cache whatever the vocabulary (misses just recompute the md5).
_BUCKET_CACHE: dict[int, dict[str, int]] = {}
_CACHE_LIMIT = 500_000


def _token_buckets(tokens: list[str], dims: int) -> np.ndarray:
    cache = _BUCKET_CACHE.setdefault(dims, {})
    out = np.empty(len(tokens), dtype=np.int64)
    for i, t in enumerate(tokens):
        b = cache.get(t)
        if b is None:
            b = int(hashlib.md5(t.encode("utf-8")).hexdigest()[:7], 16) % dims
            if len(cache) < _CACHE_LIMIT:
                cache[t] = b
        out[i] = b
    return out


def hashed_counts(texts: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) bucket counts of lower-cased whitespace tokens, vectorised with Arrow:
    split and lower-case in C++, md5 only once per distinct token of the batch."""
    n = len(texts)
    # ASCII whitespace split (space, \t, \n, \v, \f, \r), the same class as T.WHITESPACE_RUN
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    lens = np.asarray(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    flat = pc.list_flatten(lists)
    keep = np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False), dtype=bool)
    enc = pc.dictionary_encode(flat).combine_chunks() if isinstance(flat, pa.ChunkedArray) else pc.dictionary_encode(flat)
    idx = np.asarray(enc.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
    vocab_b = _token_buckets(enc.dictionary.to_pylist(), dims)
    b = vocab_b[idx][keep]
    return np.bincount(rows[keep] * dims + b, minlength=n * dims).astype(np.float64).reshape(n, dims)


def embed_hashed(
    df: DataFrame,
    text_col: str = "text",
    dims: int = HASH_DIMS,
    out_col: str = "embedding",
    dtype: str = "double",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add an L2-normalised hashed bag-of-words vector ``out_col`` (array<dtype>).

    Runs in the input's partitions (no shuffle). Tokenisation is Arrow C++ per batch, so the
    JVM -> Python hop carries the text once and the vector once.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c != out_col]
    value_type = pa.float64() if dtype == "double" else pa.float32()
    sent = text_col if text_col in keep else "_txt"  # a kept text goes to Python once
    staged = df.select(*keep) if sent in keep else df.select(*keep, F.col(text_col).alias(sent))
    in_fields = [staged.schema[c] for c in keep]

    def run(batches):
        for rb in (part for whole in batches for part in parts(whole, sent)):
            counts = hashed_counts(rb.column(sent), dims)
            vec = _matrix_to_list(_normalise(counts), value_type)
            cols = [rb.column(c) for c in keep] + [vec]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, out_col])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in in_fields] + [f"`{out_col}` array<{dtype}>"])
    return staged.mapInArrow(run, ddl)


def embed_with(
    df: DataFrame,
    model: Callable[[list[str]], np.ndarray],
    dims: int,
    text_col: str = "text",
    out_col: str = "embedding",
    dtype: str = "float",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Embed ``text_col`` with a user callable ``model(list_of_texts) -> (rows, dims) array``.

    The callable is shipped to executors and called once per Arrow batch, so a model that
    batches requests (the usual remote-embedding shape) gets whole batches.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c != out_col]
    value_type = pa.float64() if dtype == "double" else pa.float32()
    sent = text_col if text_col in keep else "_txt"  # a kept text goes to Python once
    staged = df.select(*keep) if sent in keep else df.select(*keep, F.col(text_col).alias(sent))
    in_fields = [staged.schema[c] for c in keep]

    def run(batches):
        for rb in batches:
            texts = [t or "" for t in rb.column(sent).to_pylist()]
            mat = np.asarray(model(texts), dtype=np.float64).reshape(len(texts), dims)
            cols = [rb.column(c) for c in keep] + [_matrix_to_list(mat, value_type)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, out_col])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in in_fields] + [f"`{out_col}` array<{dtype}>"])
    return staged.mapInArrow(run, ddl)


def embedding_fingerprint(df: DataFrame, id_col: str, text_col: str = "text", vec_col: str = "embedding") -> DataFrame:
    """Small summary of each vector (for checks): token count, non-zero buckets, weighted sum."""
    v = F.col(vec_col)
    return df.select(
        F.col(id_col),
        F.size(T.tokens(F.col(text_col))).cast("bigint").alias("n_tokens"),
        F.size(F.filter(v, lambda x: x != 0)).cast("bigint").alias("n_buckets"),
        F.round(
            F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0).cast("double"), lambda a, y: a + y),
            6,
        ).alias("weighted_sum"),
    )
