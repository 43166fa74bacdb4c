"""Exact k-nearest-neighbour search between a query table and a vector table.

Two physical strategies behind one function:

* ``broadcast`` - the query matrix (size checked against ``max_broadcast_bytes``) is shipped
  once to every executor; each vector partition computes distances with numpy in Arrow
  batches and keeps only a per-partition top-k. No pairs are materialised as rows and the
  vector table is never shuffled; the only exchange carries ``queries x k x partitions`` rows.
* ``blocked`` - for query tables too large to broadcast: vectors are stored once in blocks, queries are
  dealt to tasks; a task holds a bounded number of queries and reads the blocks one after the other
  (``pruned.searched``), so disk follows the tables' size and memory the blocks'.

The final top-k is a ``row_number`` window (Catalyst adds a partial ``WindowGroupLimit``
before the exchange). Ranking is by distance rounded to 9 decimals, then id, so ties between
duplicate vectors resolve identically in every engine.

Distances (``metric``): ``l2`` squared Euclidean (default), ``l2_root`` Euclidean, ``ip``
negative inner product, ``cosine`` 1 - cosine. ``score`` is ``1 - distance`` for l2/cosine
(as in the reference) and the inner product for ``ip``. The approximate matrix form
``|q|^2 + |x|^2 - 2 q.x`` only selects candidates; candidates within tolerance of the k-th
value are re-scored exactly before ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("l2", "l2_root", "ip", "cosine")
ROUND = 9
_Q_CHUNK = 1024  # queries per matrix product inside a task (bounds task memory)
_GATHER_BYTES = 64 * 1024 * 1024  # re-scoring gathers chunk x k x dims doubles
_MATRIX_BYTES = 64 * 1024 * 1024  # distance matrix chunk x block doubles
_FOLD = 64  # columns of which only the least is looked at first
#: Bytes of queries beyond which they are dealt to blocks by themselves: each worker holds what is broadcast.
AUTO_BROADCAST_BYTES = 16 * 1024 * 1024


# ------------------------------------------------------------------------------ kernels


def _approx(metric: str, Q: np.ndarray, X: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
    dot = Q @ X.T
    if metric in ("l2", "l2_root"):
        return qn2[:, None] + xn2[None, :] - 2.0 * dot
    if metric == "ip":
        return -dot
    denom = np.sqrt(qn2)[:, None] * np.sqrt(xn2)[None, :]
    cos = np.divide(dot, denom, out=np.zeros_like(dot), where=denom > 0)
    return 1.0 - cos


def _exact(metric: str, q: np.ndarray, Xc: np.ndarray) -> np.ndarray:
    if metric in ("l2", "l2_root"):
        diff = Xc - q[None, :]
        d = np.einsum("ij,ij->i", diff, diff)
        return np.sqrt(d) if metric == "l2_root" else d
    dot = Xc @ q
    if metric == "ip":
        return -dot
    qn = math.sqrt(float(q @ q))
    xn = np.sqrt(np.einsum("ij,ij->i", Xc, Xc))
    denom = qn * xn
    cos = np.divide(dot, denom, out=np.zeros_like(dot), where=denom > 0)
    return 1.0 - cos


def _id_rank(vids: np.ndarray) -> np.ndarray:
    """Position of every id in sorted id order (works for numeric and string ids)."""
    order = np.argsort(vids, kind="stable")
    rank = np.empty(len(vids), dtype=np.int64)
    rank[order] = np.arange(len(vids))
    return rank


def _least(D: np.ndarray, kk: int, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: places of the kk least values, the kk-th, and how many are within ``tol`` of it.

    The columns are folded: of every ``_FOLD`` only the least is looked at first, and its kk-th bounds the row's kk-th,
    so all but kk folds are passed over in one sweep. Rows with more folds within the bound are looked at whole.
    """
    many, n = D.shape

    def whole(d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = np.argpartition(d, kk - 1, axis=1)[:, :kk] if kk < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        kth = np.take_along_axis(d, part, axis=1).max(axis=1)
        return part, kth, (d <= (kth + t)[:, None]).sum(axis=1)

    folds = n // _FOLD
    if folds <= 4 * kk:
        return whole(D, tol)
    least = D[:, : folds * _FOLD].reshape(many, _FOLD, folds).min(axis=1)
    near = np.argpartition(least, kk - 1, axis=1)[:, :kk]
    bound = np.take_along_axis(least, near, axis=1).max(axis=1)
    columns = np.concatenate([(near[:, :, None] + folds * np.arange(_FOLD)).reshape(many, -1), np.tile(np.arange(folds * _FOLD, n), (many, 1))], axis=1)
    place, kth, count = whole(np.take_along_axis(D, columns, axis=1), tol)
    part = np.take_along_axis(columns, place, axis=1)
    tied = np.flatnonzero((least <= (bound + tol)[:, None]).sum(axis=1) > kk)
    if tied.size:
        part[tied], kth[tied], count[tied] = whole(D[tied], tol[tied])
    return part, kth, count


def topk_block(metric: str, k: int, qids: np.ndarray, Q: np.ndarray, vids: np.ndarray, X: np.ndarray):
    """Top-k of every query against one block of vectors.

    Returns four aligned lists of arrays (query ids, vector ids, exact distances, rank from 0)
    with at most k rows per query, ranked by (round(distance, 9), vector id). Rows without ties at
    the k-th place take a vectorised path; rows with ties re-rank their whole tie group.
    """
    out_q, out_v, out_d, out_r = [], [], [], []
    n = X.shape[0]
    if n == 0 or Q.shape[0] == 0:
        return out_q, out_v, out_d, out_r
    kk = min(k, n)
    xn2 = np.einsum("ij,ij->i", X, X)
    scale = 1.0 + float(xn2.max())
    idr = _id_rank(vids)
    step = max(1, min(_Q_CHUNK, _GATHER_BYTES // (8 * kk * X.shape[1] or 1), _MATRIX_BYTES // (8 * n)))
    for s in range(0, Q.shape[0], step):
        Qc = Q[s : s + step]
        qn2 = np.einsum("ij,ij->i", Qc, Qc)
        D = _approx(metric, Qc, X, qn2, xn2)
        tol = 1e-9 * (scale + qn2)
        part, kth, n_cand = _least(D, kk, tol)
        simple = np.flatnonzero(n_cand == kk)
        if simple.size:
            idx = part[simple]  # (m, kk)
            if metric in ("l2", "l2_root"):
                diff = X[idx] - Qc[simple][:, None, :]
                ex = np.einsum("mkd,mkd->mk", diff, diff)
                if metric == "l2_root":
                    ex = np.sqrt(ex)
            elif metric == "ip":
                ex = -np.einsum("mkd,md->mk", X[idx], Qc[simple])
            else:
                dot = np.einsum("mkd,md->mk", X[idx], Qc[simple])
                den = np.sqrt(xn2[idx]) * np.sqrt(qn2[simple])[:, None]
                ex = 1.0 - np.divide(dot, den, out=np.zeros_like(dot), where=den > 0)
            order = np.lexsort((idr[idx], np.round(ex, ROUND)), axis=-1)
            idx = np.take_along_axis(idx, order, axis=1)
            ex = np.take_along_axis(ex, order, axis=1)
            out_q.append(np.repeat(qids[s + simple], kk))
            out_v.append(vids[idx.reshape(-1)])
            out_d.append(ex.reshape(-1))
            out_r.append(np.tile(np.arange(kk), simple.size))
        for r in np.flatnonzero(n_cand != kk):
            cand = np.flatnonzero(D[r] <= kth[r] + tol[r])
            exact = _exact(metric, Qc[r], X[cand])
            order = np.lexsort((idr[cand], np.round(exact, ROUND)))[:kk]
            out_q.append(np.full(len(order), qids[s + r], dtype=object))
            out_v.append(vids[cand][order])
            out_d.append(exact[order])
            out_r.append(np.arange(len(order)))
    return out_q, out_v, out_d, out_r


def empty_hits() -> pd.DataFrame:
    """Typed empty result (object ids convert to any Spark id type, including strings)."""
    return pd.DataFrame(
        {"query_id": pd.Series([], dtype=object), "vec_id": pd.Series([], dtype=object), "distance": pd.Series([], dtype="float64")}
    )


def _merge(metric_k: int, q_parts, v_parts, d_parts) -> pd.DataFrame:
    if not q_parts:
        return empty_hits()
    frame = pd.DataFrame(
        {
            "query_id": np.concatenate(q_parts),
            "vec_id": np.concatenate(v_parts),
            "distance": np.concatenate(d_parts).astype(np.float64),
        }
    )
    frame["_k"] = frame["distance"].round(ROUND)
    frame = frame.sort_values(["query_id", "_k", "vec_id"], kind="mergesort")
    return frame.groupby("query_id", sort=False).head(metric_k).drop(columns="_k")


# ------------------------------------------------------------------------------ helpers


def _arrow(simple: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[simple]


def count_and_width(df: DataFrame, col: str) -> tuple[int, int]:
    """Row count and vector width in one aggregation job (no early-terminated scans)."""
    r = df.agg(F.count("*").alias("n"), F.max(F.size(col)).alias("w"), F.min(F.size(col)).alias("w0")).collect()[0]
    if not r["n"] or r["w"] is None or r["w"] < 0:
        raise ValueError(f"no non-null vectors in column {col}")
    if r["w0"] != r["w"]:
        raise ValueError(f"vectors in {col} have different widths ({r['w0']}..{r['w']})")
    return int(r["n"]), int(r["w"])



def _rank(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("distance", ROUND), F.col("vec_id"))
    return partial.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def with_score(hits: DataFrame, metric: str) -> DataFrame:
    """Similarity projection (P8): ``1 - distance`` (l2, cosine) or the inner product (ip)."""
    score = -F.col("distance") if metric == "ip" else F.lit(1.0) - F.col("distance")
    return hits.withColumn("score", score)


def matrix_of(vectors, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of a matrix; one of another width fails the job
    (a flat reshape would mix up neighbouring vectors)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths = np.asarray(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))
    if len(widths) and (widths != dims).any():
        raise ValueError(f"vector width is {widths[widths != dims][0]}, not {dims}")
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), dims)


def collect_matrix(df: DataFrame, id_col: str, vec_col: str, dims: int):
    """Pull a *size-checked* small table of vectors to the driver as (ids, matrix)."""
    tbl = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).toArrow()
    ids = np.asarray(tbl.column("id").to_pylist(), dtype=object)
    return ids, matrix_of(tbl.column("v"), dims)


# ------------------------------------------------------------------------------ public API


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    *,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    vec_id: str = "vec_id",
    vec_col: str = "embedding",
    metric: str = "l2",
    strategy: str = "auto",
    max_broadcast_bytes: int = 256 * 1024 * 1024,
    query_block: int = 65536,
    vector_block: int = 65536,
) -> DataFrame:
    """Exact top-k neighbours of every query. Output: query_id, vec_id, distance, score, rank."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv")).filter(F.col("qv").isNotNull())
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec_col).alias("vv")).filter(F.col("vv").isNotNull())
    n_q, dims = count_and_width(q, "qv")  # the (small) query side, never the vector pipeline
    if strategy == "auto":
        strategy = "broadcast" if n_q * dims * 8 <= min(max_broadcast_bytes, AUTO_BROADCAST_BYTES) else "blocked"
    if strategy == "broadcast":
        if n_q * dims * 8 > max_broadcast_bytes:
            raise ValueError("query matrix exceeds max_broadcast_bytes; use strategy='blocked'")
        partial = _broadcast_partial(q, v, k, metric, dims)
    elif strategy == "blocked":
        partial = _blocked_partial(q, v, k, metric, dims, n_q, query_block, vector_block)
    else:
        raise ValueError("strategy must be auto, broadcast or blocked")
    return with_score(_rank(partial, k), metric)


def _broadcast_partial(q: DataFrame, v: DataFrame, k: int, metric: str, dims: int) -> DataFrame:
    spark = v.sparkSession
    qids, Q = collect_matrix(q, "query_id", "qv", dims)
    bc = spark.sparkContext.broadcast((qids, Q))
    qtype = q.schema["query_id"].dataType.simpleString()
    vtype = v.schema["vec_id"].dataType.simpleString()
    out_schema = pa.schema([("query_id", _arrow(qtype)), ("vec_id", _arrow(vtype)), ("distance", pa.float64())])

    def run(batches):
        ids_q, mat_q = bc.value
        qs, vs, ds = [], [], []
        for rb in batches:
            if rb.num_rows == 0:
                continue
            vids = np.asarray(rb.column("vec_id").to_pylist(), dtype=object)
            X = matrix_of(rb.column("vv"), dims)
            a, b, c, _ = topk_block(metric, k, ids_q, mat_q, vids, X)
            if a:
                # shrink the running candidate list of this partition to k per query
                m = _merge(k, qs + a, vs + b, ds + c)
                qs, vs, ds = [m["query_id"].to_numpy()], [m["vec_id"].to_numpy()], [m["distance"].to_numpy()]
        if qs:
            m = _merge(k, qs, vs, ds)
            yield pa.RecordBatch.from_pandas(m, schema=out_schema, preserve_index=False)

    return v.mapInArrow(run, f"query_id {qtype}, vec_id {vtype}, distance double")


def _blocked_partial(
    q: DataFrame, v: DataFrame, k: int, metric: str, dims: int, n_q: int, query_block: int, vector_block: int
) -> DataFrame:
    from corpus_search.operators import pruned

    one = F.lit(0).alias("cell_id")  # all vectors are one cell
    return pruned.searched(q.select("query_id", "qv", one), v.select("vec_id", "vv", one), {0: v.count()}, dims, k, metric, vector_block * dims * 8, query_block)
