"""Whitening of embeddings: covariance of the distinct vectors, its components, and the rows' projections.

An entry ``c`` counts as the whole number ``x = floor(64 * c) + 1000000``. The fit list is each
distinct vector of such numbers once, of all rows. It is written to the shared folder in the fewest
bytes an entry and read three times: for its size ``n`` and exact sums ``S``, for the scatter of the
centred vectors ``x - S / n``, and for the covariance of the whitened ones. Tasks add up arrays of
width squared numbers, which are merged in rounds of tasks; the driver gets one array for each width.

The driver takes a pivoted Cholesky factor of the covariance and turns the columns of that triangular
factor by one-sided Jacobi rotations until they are orthogonal. Their squared norms are the
eigenvalues, the columns divided by their norms are the components, without forming another product,
so small eigenvalues keep their digits. Components whose eigenvalue is at most ``RANK`` of the largest
are rounding, not directions of the data, and are left out; with equal eigenvalues any basis is right
and this one is the same for all rows.

Null vectors, and vectors with a null or non-finite entry, are dropped. Vectors of each width are
whitened among themselves, so each width has a model; rows of width 0, and rows of a width all of
whose vectors are equal (one distinct vector has no direction), get an empty list of components.
Repeated rows count once in the fit list and each get their result. Null ids stay null, an empty table
gives an empty result, and other columns are not read. Scaled entries beyond ``LIMIT`` are held at it;
a ``deviation`` that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_search.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Largest scaled entry, so that differences of two are longs.
LIMIT = 1 << 61
#: Eigenvalues of at most this share of the largest one are rounding.
RANK = 1e-11
#: Tasks that merge the tasks' arrays before a last one does.
MERGERS = 32
PART_BYTES = 4 << 20
_LOW = (1 << 31) - 1


@dataclass(frozen=True)
class Model:
    """What the vectors of one width are centred and projected by; ``mean`` is (whole part, rest of n)."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))


def _entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their scaled entries (without SHIFT), by width, in parts of bounded size."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    widths = np.diff(ends)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        step = max(1, PART_BYTES // (8 * max(width, 1)))
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            c = values[ends[at][:, None] + np.arange(width)].astype(np.float64)
            with np.errstate(over="ignore"):
                yield at, np.clip(np.floor(c * SCALE), -float(LIMIT), float(LIMIT)).astype(np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, y in _entries(batch.column(0)):
            width = y.shape[1]
            if not width:
                continue
            # min, not abs: the least long has no positive
            bits = np.maximum(y.max(1), -(y.min(1) + 1))
            for kind, low, high in ((np.int16, -1, 1 << 15), (np.int32, 1 << 15, 1 << 31), (np.int64, 1 << 31, 1 << 63)):
                some = y[(bits >= low) & (bits < high)].astype(kind)
                if len(some):
                    blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(some.itemsize * width), len(some), [None, pa.py_buffer(np.ascontiguousarray(some))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), width, np.int32)), blob.cast(pa.binary())], ["width", "x"])


def _decode(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The entries of a batch of the fit list, by width and bytes an entry, in parts of bounded size."""
    widths, blobs = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.array([len(b.as_buffer()) for b in blobs], np.int64)
    for width, size in np.unique(np.stack([widths, sizes], 1), axis=0).tolist():
        rows = np.flatnonzero((widths == width) & (sizes == size))
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[size // width]
        step = max(1, PART_BYTES // (8 * width))
        for lo in range(0, len(rows), step):
            raw = b"".join(b.as_buffer() for b in blobs.take(pa.array(rows[lo : lo + step])))
            yield np.frombuffer(raw, kind).reshape(-1, width).astype(np.int64)


def distinct_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The fit list: (width, entries as bytes), each distinct vector once."""
    vectors = df.where(usable(F.col(vector_col))).select(F.col(vector_col).alias("v"))
    return vectors.mapInArrow(_encode, "width int, x binary").distinct()


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, bytes]:
    """``of`` of all parts of the fit list added up, by width."""

    def rows_of(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for width, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str])], ["width", "sums", "kind"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for y in _decode(batch):
                total, width = of(y), y.shape[1]
                held[width] = add(held[width], total) if width in held else total
        yield from rows_of(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, sums, kind in zip(*(c.to_pylist() for c in batch.columns)):
                total = np.frombuffer(sums, kind)
                held[width] = add(held[width], total) if width in held else total
        yield from rows_of(held)

    schema = "width int, sums binary, kind string"
    parts = rows.mapInArrow(gather, schema)
    for tasks in (MERGERS, 1):
        parts = parts.repartition(tasks).mapInArrow(merge, schema)
    return {r["width"]: np.frombuffer(r["sums"], r["kind"]) for r in parts.collect()}  # a row for each width


def _counts(y: np.ndarray) -> np.ndarray:
    """[n, sums of the upper parts, sums of the lower 31 bits]: exact in longs."""
    return np.concatenate([[len(y)], (y >> 31).sum(0), (y & _LOW).sum(0)]).astype(np.int64)


def _carried(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    width = len(total) // 2
    total[1 : width + 1] += total[width + 1 :] >> 31
    total[width + 1 :] &= _LOW
    return total


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows' order ``p`` and lower trapezoidal ``l`` of the rank's width with ``v[p][:, p] = l @ l.T``."""
    v, d = v.copy(), len(v)
    p, l = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        best = k + int(np.argmax(v.diagonal()[k:]))
        if not v[best, best] > least:
            return p, l[:, :k]
        for m in (v, v.T, l):
            m[[k, best]] = m[[best, k]]
        p[[k, best]] = p[[best, k]]
        l[k, k] = np.sqrt(v[k, k])
        l[k + 1 :, k] = v[k + 1 :, k] / l[k, k]
        v[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], l[k + 1 :, k])
    return p, l


def jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``l`` turned pairwise until they are orthogonal, longest first."""
    g = l[:, np.argsort(-(l * l).sum(0), kind="stable")].copy()
    r = g.shape[1]
    seats = list(range(r + r % 2))  # a seat beyond r is a bye
    close = np.sqrt(max(len(g), 1)) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]) if max(a, b) < r]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
            a, b = g[:, i], g[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(gamma) > close * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * (a - t * b), c * (t * a + b)
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance by size, those of rounding left out, and unit components as columns."""
    p, l = pivoted_cholesky(v)
    g = jacobi(l)
    values = (g * g).sum(0)
    g = g[:, values > RANK * values.max(initial=0.0)]
    norms = np.sqrt((g * g).sum(0))
    out = np.zeros_like(g)
    out[p] = g / norms
    sign = np.where(out[np.argmax(np.abs(out), 0), np.arange(out.shape[1])] < 0, -1.0, 1.0) if out.size else 1.0
    return norms * norms, out * sign


def _centred(y: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (y - whole).astype(np.float64) - rest / n


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each width, from all distinct vectors."""
    rows = written(distinct_vectors(df, vector_col), "vectors")
    at: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for width, counts in _summed(rows, _counts, _carried).items():
        n = int(counts[0])
        sums = [(int(a) << 31) + int(b) for a, b in zip(counts[1 : width + 1], counts[width + 1 :])]
        at[width] = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def scatter(y: np.ndarray) -> np.ndarray:
        z = _centred(y, *at[y.shape[1]])
        return (z.T @ z).ravel()

    found: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for width, total in _summed(rows, scatter, np.add).items():
        v = total.reshape(width, width) / at[width][0]
        values, directions = eigen(v)
        found[width] = values[:components], directions[:, :components], float(np.trace(v))

    def projected(y: np.ndarray) -> np.ndarray:
        values, directions, _ = found[y.shape[1]]
        w = _centred(y, *at[y.shape[1]]) @ directions / np.sqrt(values)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    models = {}
    for width, total in _summed(rows, projected, np.add).items():
        n, whole, rest = at[width]
        values, directions, trace = found[width]
        k = len(values)
        mean, second = total[:k] / n, total[k:].reshape(k, k) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
        models[width] = Model(n, whole, rest, directions, values, values / trace if k else values, error)
    return models


def _deviations(y: np.ndarray, m: Model) -> list[int | None]:
    """Sums over dimensions of ``(n * x - S) ** 2``, exact; None where no long holds them."""
    a = y - m.whole
    reach = m.n * (max(abs(int(a.max())), abs(int(a.min()))) + 1)
    if reach * reach * y.shape[1] < 1 << 63:
        return ((a * m.n - m.rest) ** 2).sum(1).tolist()
    far = a.astype(object) * m.n - m.rest.astype(object)
    return [s if s < 1 << 63 else None for s in (far * far).sum(1).tolist()]


def whiten(df: DataFrame, models: dict[int, Model], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row: ``id_col``, ``n``, ``deviation``, and by component ``whitened`` and ``explained``, and ``identity_error``."""
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", numbers), T.StructField("explained", numbers), T.StructField("identity_error", T.DoubleType()),
    ])

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in _entries(batch.column(1)):
                m = models.get(y.shape[1])
                if m is None:  # width 0
                    continue
                w = _centred(y, m.n, m.whole, m.rest) @ m.components / np.sqrt(m.eigenvalues)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), m.n, np.int64)), pa.array(_deviations(y, m), pa.int64()),
                        lists(w), lists(np.tile(m.explained, (len(rows), 1))), pa.array(np.full(len(rows), m.identity_error)),
                    ],
                    schema.names,
                )

    return df.where(usable(F.col(vector_col))).select(F.col(id_col), F.col(vector_col).alias("_v")).mapInArrow(of, schema)


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    one = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_one")
    return whitened.select(id_col, "n", "deviation", "identity_error", one).select(
        id_col, (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("_one.whitened").alias("whitened"),
        F.col("_one.explained").alias("explained"), "identity_error",
    )
