"""Exact nearest neighbours through pivot cells: a query visits only the cells that can still hold one.

Vectors belong to the cell of their nearest pivot, and each cell knows its size and the least and largest
distance of its vectors to the pivot. With ``D`` the distance of a query to a pivot, the triangle inequality
bounds its distance to every vector of the cell from below by ``D - largest``, ``least - D`` and, as the
cell's vectors are nearer to its pivot than to the query's own, by ``(D^2 - D_own^2) / (2 * |own - pivot|)``.

1. Every query searches the cell of its nearest pivot. The k-th distance found there, or the least bound
   within which the cells surely hold k vectors, is the query's reach.
2. It then visits the other cells whose lower bound is within the reach; the rest can't matter.

Vectors are stored once, by cell, in the shared folder (:class:`Blocks`), and queries are shuffled once. A task
holds a bounded number of queries and the k nearest of each, and reads the cells that any of them visits block by
block; what the k-th distance so far rules out is left at once. So neither side is copied for the other, no pair
and no visit is a row, and disk follows the tables' size, whatever queries visit; a hot cell is read in blocks, by
many tasks. What the driver holds is one row for each pivot, at most ``MAX_PIVOTS``, and each file that has it.

The same kernel searches a two-level centroid tree (:class:`CentroidTree`): the upper level is broadcast,
the lower one joined by its parent, so the number of centroids isn't bound by what can be broadcast.

Null vectors are left out; an empty side gives no hits; all vectors must have one width. Distances are
``l2`` (squared) and ``l2_root``; ranks are by the distance rounded to 9 places, then id, ties included.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.operators import knn as K
from corpus_search.session import cut_lineage, scratch_path
from corpus_search.sources.files import make_folder, open_store

METRICS = ("l2", "l2_root")
MAX_PIVOTS = 1024
#: Bytes of a block of vectors, and queries that go past the vectors together.
BLOCK_BYTES = 32 << 20
QUERIES_PER_GROUP = 65536
#: Of a task: bytes and number of the queries that it holds, bytes of vectors read at once (and of a tile of distances,
#: four times), hits kept beyond four times k a query before they are ranked, and files held open.
HELD_BYTES = 16 << 20
GROUP_ROWS = 1 << 15
READ_BYTES = 4 << 20
KEPT = 1 << 16
OPEN_FILES = 64
#: Room for rounding in the comparison of a bound with a distance, relative to their size.
SLACK = 1e-7


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all of ``y``."""
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0.0))


@dataclass(frozen=True)
class Bounds:
    """For each cell with vectors: its name, pivot, size, and the least and largest distance of a vector to the pivot."""

    ids: np.ndarray
    pivots: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def counts(self) -> dict[int, int]:
        return dict(zip(self.ids.tolist(), self.sizes.astype(int).tolist()))


@dataclass(frozen=True)
class Cells:
    """Vectors (``vec_id``, ``vv``, ``cell_id``) stored with their cells, and the cells' bounds."""

    table: DataFrame
    bounds: Bounds


def _unit(vectors: DataFrame, vec_id: str, vec_col: str) -> DataFrame:
    """(vec_id, vv) as floats or doubles, null vectors left out; floats stay floats, which take half the room."""
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    vv = F.col(vec_col) if kind in ("float", "double") else F.transform(F.col(vec_col), lambda x: x.cast("double"))
    return vectors.select(F.col(vec_id).alias("vec_id"), vv.alias("vv")).where(F.col("vv").isNotNull())


def sample_pivots(vectors: DataFrame, most: int = MAX_PIVOTS, vec_id: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """About the square root of the number of vectors (at most ``most``), chosen by a hash of the id."""
    v = _unit(vectors, vec_id, vec_col)
    many = min(most, math.isqrt(max(v.count(), 1)) + 1)
    return cut_lineage(v.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(many).select("vv"), "pivots")


def cells_of(vectors: DataFrame, pivots: DataFrame, vec_id: str = "vec_id", vec_col: str = "embedding") -> Cells:
    """Deal the vectors to the cells of the pivots (a column of vectors, at most MAX_PIVOTS rows) and store them by cell."""
    v = _unit(vectors, vec_id, vec_col)
    got = pivots.limit(MAX_PIVOTS + 1).toArrow()  # bounded: one pivot more tells that there are too many
    if got.num_rows > MAX_PIVOTS:
        raise ValueError(f"more than {MAX_PIVOTS} pivots")
    if not got.num_rows:
        none = np.zeros(0)
        return Cells(v.limit(0).withColumn("cell_id", F.lit(0)), Bounds(none, np.zeros((0, 0)), none, none, none))
    width = len(got.column(0)[0])
    centers = np.unique(K.matrix_of(got.column(0), width), axis=0)
    vtype = v.schema["vec_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(K.matrix_of(batch.column(1), width), centers)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["vec_id", "vv", "cell_id", "far"])

    found = cut_lineage(v.mapInArrow(of, f"vec_id {vtype}, vv {v.schema['vv'].dataType.simpleString()}, cell_id int, far double"), "cells")
    rows = found.groupBy("cell_id").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("cell_id").collect()  # at most MAX_PIVOTS
    ids = np.array([r["cell_id"] for r in rows], np.int64)
    column = lambda c: np.array([r[c] for r in rows], np.float64)
    return Cells(found.select("vec_id", "vv", "cell_id"), Bounds(ids, centers[ids], column("n"), column("lo"), column("hi")))


def _lower_bounds(d: np.ndarray, cells: Bounds, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each query (row) and cell the least distance that a vector of the cell can have."""
    apart = between[own]
    plane = np.divide(d**2 - (d[np.arange(len(d)), own] ** 2)[:, None], 2 * apart, out=np.zeros_like(d), where=apart > 0)
    return np.maximum.reduce([d - cells.largest, cells.least - d, plane, np.zeros_like(d)])


def _planned(queries: DataFrame, cells: Bounds, k: int) -> DataFrame:
    """Queries with the place of their own cell, and the reach within which the cells surely hold k vectors (squared never)."""
    qtype = queries.schema["query_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                d = _distances(K.matrix_of(part.column(1), cells.width), cells.pivots)
                far = d + cells.largest
                order = far.argsort(1, kind="stable")
                enough = np.take_along_axis(np.broadcast_to(cells.sizes, d.shape), order, 1).cumsum(1) >= k
                first = enough.argmax(1)
                sure = np.where(enough.any(1), np.take_along_axis(far, np.take_along_axis(order, first[:, None], 1), 1)[:, 0], np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(sure)], ["query_id", "qv", "own", "sure"])

    return queries.mapInArrow(of, f"query_id {qtype}, qv {queries.schema['qv'].dataType.simpleString()}, own int, sure double")


@dataclass(frozen=True)
class Blocks:
    """Vectors stored once, by cell: for each cell the runs (file, first batch, batches) of Arrow batches that have it."""

    runs: dict[int, list[tuple[str, int, int]]]
    width: int

    def read(self, cell: int, opened: dict[str, pa.RecordBatchFileReader]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, matrix) of the cell's vectors, small blocks together."""
        ids, parts, held = [], [], 0
        for file, first, many in self.runs.get(cell, ()):
            if file not in opened:
                while len(opened) >= OPEN_FILES:
                    opened.pop(next(iter(opened)))
                fs, path = open_store(file)
                opened[file] = pa.ipc.open_file(fs.open_input_file(path))
            for i in range(first, first + many):
                batch = opened[file].get_batch(i)
                ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                parts.append(K.matrix_of(batch.column(1), self.width))
                held += parts[-1].nbytes
                if held >= READ_BYTES:
                    yield np.concatenate(ids), np.concatenate(parts)
                    ids, parts, held = [], [], 0
        if parts:
            yield np.concatenate(ids), np.concatenate(parts)


def stored_blocks(vectors: DataFrame, sizes: dict[int, int], width: int, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Write ``vectors`` (vec_id, vv, cell_id) by cell to the shared folder; a cell of many vectors is written by many tasks."""
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "vector-blocks")
    spread = [(int(c), max(1, math.ceil(n * width * 8 / BLOCK_BYTES))) for c, n in sizes.items()]
    plan = F.broadcast(spark.createDataFrame(spread or [(-1, 1)], "cell_id int, parts int"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(sum(sizes.values()) * width * 8 / BLOCK_BYTES))
    most = max(1, min(block_bytes, READ_BYTES) // (8 * width or 1))
    rows = vectors.join(plan, "cell_id").select("cell_id", "vec_id", "vv", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("_part"))
    dealt = rows.repartition(tasks, "cell_id", "_part").sortWithinPartitions("cell_id").select("cell_id", "vec_id", "vv")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, writer, done = f"{path}/{uuid.uuid4().hex}.arrow", None, None, 0
        runs: list[list[int]] = []  # cell, first batch, batches
        held, cell = [], None

        def flush() -> None:
            nonlocal held, done
            if held:
                writer.write_batch(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=most)[0])
                if not runs or runs[-1][0] != cell:
                    runs.append([cell, done, 0])
                runs[-1][2] += 1
                held, done = [], done + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            K.matrix_of(batch.column(2), width)  # of one width, or the job fails
            if writer is None:
                fs, name = open_store(file)
                make_folder(fs, name, None)
                out = fs.open_output_stream(name)
                writer = pa.ipc.new_file(out, pa.schema([batch.schema.field(1), batch.schema.field(2)]))
            cells = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if int(cells[lo]) != cell:
                    flush()
                    cell = int(cells[lo])
                while lo < hi:
                    take = min(hi - lo, most - sum(h.num_rows for h in held))
                    held.append(batch.slice(lo, take).select([1, 2]))
                    lo += take
                    if sum(h.num_rows for h in held) >= most:
                        flush()
        flush()
        if writer is not None:
            writer.close()
            out.close()
        names = ["cell_id", "file", "first", "batches"]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int32()), pa.array([file] * len(runs), pa.string()), pa.array([r[1] for r in runs], pa.int32()), pa.array([r[2] for r in runs], pa.int32())], names)

    found: dict[int, list[tuple[str, int, int]]] = {}
    for r in dealt.mapInArrow(write, "cell_id int, file string, first int, batches int").collect():  # a row for each cell and task that has it
        found.setdefault(r["cell_id"], []).append((r["file"], r["first"], r["batches"]))
    return Blocks(found, width)


class _Nearest:
    """The k nearest found so far of each query of a group."""

    def __init__(self, metric: str, k: int, queries: np.ndarray) -> None:
        self.metric, self.k, self.queries = metric, k, queries
        self.square = np.einsum("ij,ij->i", queries, queries)
        #: What the matrix form of a distance has to reach to count (a squared one), the k-th distance and its id.
        self.reach, self.last = np.full(len(queries), np.inf), np.empty(len(queries), object)
        self.row, self.vec, self.far, self.open = [], [], [], 0

    def _keep(self, row: np.ndarray, vec: np.ndarray, far: np.ndarray) -> None:
        self.row.append(row)
        self.vec.append(vec)
        self.far.append(far)
        self.open += len(row)
        if self.open > 4 * self.k * len(self.queries) + KEPT:
            self.settle()

    def add(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Look the vectors over for the queries at ``rows``."""
        new = np.isinf(self.reach[rows])
        if new.any():
            first = rows[new]
            q, v, d, _ = K.topk_block(self.metric, self.k, first, self.queries[first], ids, matrix)
            if q:
                self._keep(np.concatenate(q).astype(np.int64), np.concatenate(v), np.concatenate(d).astype(np.float64))
                self.settle()
            rows = rows[~new]
        square = np.einsum("ij,ij->i", matrix, matrix)
        step = max(1, READ_BYTES // (2 * len(matrix)))
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            d = K._approx(self.metric, self.queries[at], matrix, self.square[at], square)
            scale = 1.0 + square.max() + self.square[at]
            # whatever rounds to the k-th distance may count, a smaller id given
            row, x = np.nonzero(d <= (self.reach[at] + 4e-9 * scale)[:, None])
            if not len(row):
                continue
            equal = d[row, x] >= (self.reach[at] - 1e-12 * scale)[row]
            if equal.any():
                out = np.zeros(len(row), bool)
                out[equal] = (ids[x[equal]] > self.last[at[row[equal]]]).astype(bool)
                row, x = row[~out], x[~out]
            each = max(1, K._GATHER_BYTES // (8 * matrix.shape[1] or 1))
            for i in range(0, len(row), each):
                r, c = at[row[i : i + each]], x[i : i + each]
                self._keep(r, ids[c], self._exact(self.queries[r], matrix[c], self.square[r], square[c]))

    def _exact(self, q: np.ndarray, x: np.ndarray, qn2: np.ndarray, xn2: np.ndarray) -> np.ndarray:
        if self.metric in METRICS:
            d = np.einsum("ij,ij->i", x - q, x - q)
            return np.sqrt(d) if self.metric == "l2_root" else d
        dot = np.einsum("ij,ij->i", x, q)
        if self.metric == "ip":
            return -dot
        den = np.sqrt(xn2) * np.sqrt(qn2)
        return 1.0 - np.divide(dot, den, out=np.zeros_like(dot), where=den > 0)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, distance) of the k nearest so far, in order; the others are dropped."""
        if not self.row:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        row, vec, far = np.concatenate(self.row), np.concatenate(self.vec), np.concatenate(self.far)
        order = np.lexsort((np.unique(vec, return_inverse=True)[1], np.round(far, K.ROUND), row))
        row, vec, far = row[order], vec[order], far[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        kept = place < self.k
        row, vec, far, place = row[kept], vec[kept], far[kept], place[kept]
        full = place == self.k - 1
        self.reach[row[full]] = far[full] ** 2 if self.metric == "l2_root" else far[full]
        self.last[row[full]] = vec[full]
        self.row, self.vec, self.far, self.open = [row], [vec], [far], 0
        return row, vec, far


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in groups of ``most``."""
    held, many = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, most - many))
            many, batch = many + held[-1].num_rows, batch.slice(held[-1].num_rows)
            if many == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, many = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _group_rows(width: int, least: int = 1) -> int:
    """Queries that a task holds at a time: ``least``, or as many as fit."""
    return max(1, min(GROUP_ROWS, max(least, HELD_BYTES // (8 * width or 1))))


def _tasks(df: DataFrame, many: int, rows: int) -> int:
    return max(1, min(many, max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(many / rows))))


def searched(visits: DataFrame, vectors: DataFrame, sizes: dict[int, int], width: int, k: int, metric: str = "l2", block_bytes: int = BLOCK_BYTES, queries_per_group: int = QUERIES_PER_GROUP) -> DataFrame:
    """The k nearest of the visited cells: rows (query_id, vec_id, distance), at most k a row of ``visits``.

    ``visits`` are (query_id, qv, cell_id), or (query_id, qv, cells) with an array of all cells that a query
    visits; ``vectors`` (vec_id, vv, cell_id); ``sizes`` counts the vectors of each cell (a row for each cell is
    on the driver). ``block_bytes`` and ``queries_per_group`` are the blocks in which vectors are stored and
    queries go past them; a task takes as many small ones together as it has room for.
    """
    if "cells" not in visits.columns:
        visits = visits.select("query_id", "qv", F.array("cell_id").alias("cells"))
    qtype, vtype = visits.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    blocks, most = stored_blocks(vectors, sizes, width, block_bytes), _group_rows(width, queries_per_group)
    dealt = visits.select("query_id", "qv", "cells", F.element_at("cells", 1).alias("_near")).repartitionByRange(_tasks(visits, visits.count(), most), "_near", "query_id")
    out = pa.schema([("query_id", K._arrow(qtype)), ("vec_id", K._arrow(vtype)), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.RecordBatchFileReader] = {}
        for group in _grouped(batches, most):
            best, lists = _Nearest(metric, k, K.matrix_of(group.column(1), width)), group.column(2)
            cell = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            order = cell.argsort(kind="stable")
            cell, row = cell[order], row[order]
            for rows in np.split(np.arange(len(cell)), np.flatnonzero(cell[1:] != cell[:-1]) + 1) if len(cell) else ():
                for ids, matrix in blocks.read(int(cell[rows[0]]), opened):
                    best.add(row[rows], ids, matrix)
            yield _hits(group.column(0), best, out)

    return dealt.select("query_id", "qv", "cells").mapInArrow(run, f"query_id {qtype}, vec_id {vtype}, distance double")


def _hits(ids: pa.Array, best: _Nearest, schema: pa.Schema) -> pa.RecordBatch:
    row, vec, far = best.settle()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)).cast(schema.field(0).type), pa.array(vec.tolist(), schema.field(1).type), pa.array(far, pa.float64())], schema=schema)


@dataclass(frozen=True)
class Search:
    """What a pruned search did: its hits, and the visits (query_id, cell_id) of both rounds, for which it is run again."""

    hits: DataFrame
    visits: DataFrame


def search(queries: DataFrame, cells: Cells, k: int = 5, metric: str = "l2", query_id: str = "query_id", query_vec: str = "embedding") -> Search:
    """Exact top-k of every query (ids distinct) against the cells; hits as in :func:`knn.knn`."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    q = _unit(queries, query_id, query_vec).select(F.col("vec_id").alias("query_id"), F.col("vv").alias("qv"))
    bounds = cells.bounds
    if not len(bounds.ids):
        none = q.limit(0).select("query_id", F.lit(None).cast(cells.table.schema["vec_id"].dataType).alias("vec_id"), F.lit(0.0).alias("distance"))
        return Search(K.with_score(K._rank(none, k), metric), q.limit(0).select("query_id", F.lit(0).alias("cell_id")))
    planned = cut_lineage(_planned(q, bounds, k), "planned-queries")
    blocks, most = stored_blocks(cells.table, bounds.counts(), bounds.width), _group_rows(bounds.width)
    # queries of one cell together: they mostly visit the same others
    dealt = planned.repartitionByRange(_tasks(planned, planned.count(), most), "own", "query_id")
    between = _distances(bounds.pivots, bounds.pivots)
    qtype, vtype = q.schema["query_id"].dataType.simpleString(), cells.table.schema["vec_id"].dataType.simpleString()
    out = pa.schema([("query_id", K._arrow(qtype)), ("vec_id", K._arrow(vtype)), ("distance", pa.float64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, _Nearest]]:
        """(queries, the places of the cells that each visited, the nearest)."""
        opened: dict[str, pa.RecordBatchFileReader] = {}
        for group in _grouped(batches, most):
            matrix = K.matrix_of(group.column(1), bounds.width)
            own, reach = group.column(2).to_numpy(), group.column(3).to_numpy()
            best = _Nearest(metric, k, matrix)
            for cell in np.unique(own):
                for ids, x in blocks.read(int(bounds.ids[cell]), opened):
                    best.add(np.flatnonzero(own == cell), ids, x)
            best.settle()
            reach = np.minimum(reach, np.sqrt(best.reach))
            near = np.zeros((len(matrix), len(bounds.ids)), bool)
            for lo in range(0, len(matrix), 256):
                part = slice(lo, lo + 256)
                near[part] = _lower_bounds(_distances(matrix[part], bounds.pivots), bounds, own[part], between) <= (reach[part] + SLACK * (1 + reach[part]))[:, None]
            near[np.arange(len(own)), own] = False
            for cell in np.flatnonzero(near.any(0)):
                rows = np.flatnonzero(near[:, cell])
                for ids, x in blocks.read(int(bounds.ids[cell]), opened):
                    best.add(rows, ids, x)
            near[np.arange(len(own)), own] = True
            yield group, near, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, best in found(batches):
            yield _hits(group.column(0), best, out)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, near, _ in found(batches):
            for lo in range(0, len(near), 1024):
                row, cell = np.nonzero(near[lo : lo + 1024])
                yield pa.RecordBatch.from_arrays([group.column(0).take(pa.array(row + lo)), pa.array(bounds.ids[cell].astype(np.int32))], ["query_id", "cell_id"])

    hits = dealt.mapInArrow(run, f"query_id {qtype}, vec_id {vtype}, distance double")
    return Search(K.with_score(K._rank(hits, k), metric), dealt.mapInArrow(seen, f"query_id {qtype}, cell_id int"))


def knn_pruned(queries: DataFrame, vectors: DataFrame, k: int = 5, *, pivots: DataFrame | None = None, query_id: str = "query_id", query_vec: str = "embedding", vec_id: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """Exact top-k neighbours of every query, as :func:`knn.knn` gives them."""
    pivots = sample_pivots(vectors, vec_id=vec_id, vec_col=vec_col) if pivots is None else pivots
    return search(queries, cells_of(vectors, pivots, vec_id, vec_col), k, metric, query_id, query_vec).hits


@dataclass(frozen=True)
class CentroidTree:
    """Centroids (``cell_id``, ``centroid``) of any number below a level of parents that is broadcast."""

    cells: Cells

    @classmethod
    def of(cls, centers: DataFrame, parents: DataFrame | None = None) -> CentroidTree:
        parents = sample_pivots(centers, vec_id="cell_id", vec_col="centroid") if parents is None else parents
        return cls(cells_of(centers, parents, "cell_id", "centroid"))

    def nearest(self, df: DataFrame, k: int = 1, beam: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
        """(id_col, cell_id, probe_rank, distance): the k nearest centroids of every row.

        ``beam`` parents are descended; None descends all that can hold one of the k nearest, which is exact.
        """
        q = _unit(df, id_col, vec_col).select(F.col("vec_id").alias("query_id"), F.col("vv").alias("qv"))
        if beam is None:
            hits = search(q, self.cells, k, metric, query_vec="qv").hits
        else:
            bounds = self.cells.bounds
            hits = K._rank(searched(_nearest_parents(q, bounds, beam), self.cells.table, bounds.counts(), bounds.width, k, metric), k)
        return hits.select(F.col("query_id").alias(id_col), F.col("vec_id").alias("cell_id"), (F.col("rank") - 1).alias("probe_rank"), "distance")


def _nearest_parents(queries: DataFrame, cells: Bounds, beam: int) -> DataFrame:
    qtype = queries.schema["query_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                d = _distances(K.matrix_of(part.column(1), cells.width), cells.pivots)
                near = d.argsort(1, kind="stable")[:, :beam]
                cell = pa.array(cells.ids[near.ravel()].astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), cell)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["query_id", "qv", "cells"])

    return queries.mapInArrow(of, f"query_id {qtype}, qv {queries.schema['qv'].dataType.simpleString()}, cells array<int>")
