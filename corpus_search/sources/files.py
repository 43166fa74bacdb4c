"""File and object-store sources.

* ``list_objects``  - recursive listing (path, length, modificationTime), zero-byte objects too (S1),
                      level by level in tasks (``walk``): no name passes through the driver.
* ``scan_binary``   - bytes of every object with its md5 (S2), read by tasks through ``pyarrow.fs``
                      from the listing, many small objects a task.
* ``scan_text``     - each file read whole as UTF-8 text, ends stripped, with its path (S3).
* ``scan_images``   - Spark's ``image`` source; undecodable files keep height -1 (S8).
* ``write_text_files`` / ``write_png_files`` - materialise rows as files (one per row) through
                      ``pyarrow.fs`` on the executors; used to build file trees from tables.
"""

from __future__ import annotations

import fnmatch
import functools
import hashlib
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpus_search.functions import text as T
from corpus_search.functions.batches import parts
from corpus_search.session import cut_lineage


def store_uri(path: str) -> str:
    """A path or Hadoop path as a URI with its scheme; local ones start with ``file:///``."""
    if "://" in path and not path.startswith("file:"):
        return path
    return "file://" + re.sub("^file:/*", "/", path)


def open_store(uri: str):
    """(filesystem, path) of a URI; the path is taken as it is, with blanks and signs."""
    import pyarrow.fs as pafs

    uri = store_uri(uri)
    if uri.startswith("file://"):
        return pafs.LocalFileSystem(), uri[len("file://") :]
    scheme, _, rest = uri.partition("://")
    bucket, _, key = rest.partition("/")
    fs, base = pafs.FileSystem.from_uri(f"{scheme}://{bucket}")
    return fs, f"{base.rstrip('/')}/{key}"


#: Rows of a batch of a listing.
LIST_ROWS = 10_000


def _listed(uri: str):
    """Entries of a folder as (path, is_file, length, modified); nothing if it is gone."""
    import pyarrow.fs as pafs

    fs, path = open_store(uri)
    head = "file:" if uri.startswith("file:") else uri[: len(uri) - len(path.lstrip("/"))].rstrip("/") + "/"
    own = fs.get_file_info(path)
    for x in [own] if own.is_file else fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        yield head + x.path.lstrip("/") if head != "file:" else head + x.path, x.is_file, x.size or 0, x.mtime


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_file, length, modificationTime) of all that lies below ``root``, level by level.

    A round lists the folders that the round before found, dealt over all tasks, so folders deep below a
    single one are listed by many; each round is stored, and its entries are handed on in bounded batches.
    """
    schema = "path string, is_file boolean, length bigint, modificationTime timestamp"
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))

    def run(batches):
        for rb in batches:
            for uri in rb.column(0).to_pylist():
                rows = _listed(store_uri(uri))
                while part := list(itertools.islice(rows, LIST_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], ["path", "is_file", "length", "modificationTime"])

    folders, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        levels.append(cut_lineage(folders.mapInArrow(run, schema), "listing"))
        folders = levels[-1].where("not is_file").select("path")
        if folders.isEmpty():
            return functools.reduce(DataFrame.unionByName, levels)
        folders = folders.repartition(max(2, spark.sparkContext.defaultParallelism))


def _hidden(path, root: str):
    """(names below the root, whether Spark's file sources leave the file out: one starts with a point or an underscore)."""
    plain = re.sub("^file:/*", "/", root.rstrip("/"))
    below = F.split(F.substring(F.regexp_replace(path, "^file:/*", "/"), len(plain) + 2, 2147483647), "/")
    hidden = F.expr("""exists(_below, n -> n like '.%' or n like '%._COPYING_'
        or (startswith(n, '_') and not contains(n, '=') and not startswith(n, '_metadata') and not startswith(n, '_common_metadata')))""")
    return below, hidden


def _glob_column(path, glob: str | None):
    if not glob:
        return F.lit(True)
    return F.element_at(F.split(path, "/"), -1).rlike(fnmatch.translate(glob))


def list_objects(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of the objects below ``root``, listed by tasks; the driver holds no file's name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.read.format("binaryFile").load(root)  # raises Spark's error for a path that isn't there
    below, hidden = _hidden(F.col("path"), root)
    found = walk(spark, root).where("is_file").withColumn("_below", below)
    found = found.where((F.col("length") == 0) | ~hidden).where(_glob_column(F.col("path"), glob))
    return found.select("path", "length", F.date_trunc("millisecond", "modificationTime").alias("modificationTime"))


#: Objects and bytes that a reading task gets, and bytes of a batch of contents.
TASK_OBJECTS = 4096
TASK_BYTES = 128 << 20
FLUSH_BYTES = 4 << 20
READ_BLOCK = 8 << 20


def dealt(listing: DataFrame) -> DataFrame:
    """Listed objects dealt to as many tasks as their number and bytes need, whatever folder they are in."""
    size = listing.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // TASK_OBJECTS), -(-(size["bytes"] or 0) // TASK_BYTES))
    return listing.repartition(max(1, min(tasks, size["n"])))


def _contents(listing: DataFrame, content: bool = True) -> DataFrame:
    """(path, length, md5, content) of listed objects. Without ``content`` an object is read in blocks, none is held
    whole and its size isn't bound by a row's."""
    fields = ["path", "length", "md5", *(["content"] if content else [])]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)

    def run(batches):
        rows, held = [], 0
        for rb in batches:
            for path in rb.column(0).to_pylist():
                fs, name = open_store(path)
                digest, length, blocks = hashlib.md5(), 0, []
                with fs.open_input_stream(name) as inp:
                    while block := inp.read(READ_BLOCK):
                        digest.update(block)
                        length += len(block)
                        if content:
                            blocks.append(block)
                rows.append((path, length, digest.hexdigest(), *([blocks[0] if len(blocks) == 1 else b"".join(blocks)] if content else [])))
                held += length if content else 0
                if held >= FLUSH_BYTES or len(rows) >= LIST_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return dealt(listing).select("path").mapInArrow(run, "path string, length bigint, md5 string" + (", content binary" if content else ""))


def scan_binary(spark: SparkSession, root: str, glob: str | None = None, content: bool = True) -> DataFrame:
    """(path, length, md5, content) of every object; without ``content`` only what is made of the bytes, read in blocks."""
    return _contents(list_objects(spark, root, glob), content)


def scan_text(spark: SparkSession, root: str, glob: str | None = "*.txt", listed: DataFrame | None = None) -> DataFrame:
    """(path, text, status): whole-file text, ASCII-whitespace stripped. Status ``empty`` for blank and
    zero-byte files, ``error`` (null text) for bytes that are no UTF-8 and, as one row with the root as
    path, for a root that doesn't exist; ``ok`` else. Paths are written as ``list_objects`` writes them; ``listed``
    is its listing of the root, if there is one already."""
    schema = "path string, text string, status string"
    try:
        objects = scan_binary(spark, root, glob) if listed is None else _contents(listed.where(_glob_column(F.col("path"), glob)))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([(root, None, "error")], schema)
    # only text that survives the way back to bytes was UTF-8
    raw = F.decode("content", "UTF-8")
    valid = F.expr("try_validate_utf8(cast(content as string))").isNotNull()
    txt = F.when(valid, T.strip(raw))
    return objects.select("path", txt.alias("text")).withColumn(
        "status", F.when(F.col("text").isNull(), "error").when(F.col("text") == "", "empty").otherwise("ok")
    )


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)


# ---------------------------------------------------------------------------------- writers


def _write_bytes(fs, path: str, data: bytes, folders: set[str] | None = None) -> None:
    """Write one object (``folders``: those that the task has made); a retried task rewrites the same key. On local and HDFS-like stores the
    bytes land under a temporary name first and are renamed into place; object stores replace a key
    at once. Any error (a full disk, missing rights) is the caller's."""
    if fs.type_name not in ("local", "hdfs"):
        with fs.open_output_stream(path) as out:
            out.write(data)
        return
    make_folder(fs, path, folders)
    tmp = f"{path}.tmp-{hashlib.md5(data).hexdigest()[:8]}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, path)


def make_folder(fs, path: str, folders: set[str] | None) -> None:
    """The folder of an object, made once a task."""
    folder = path.rsplit("/", 1)[0]
    if folders is None or folder not in folders:
        fs.create_dir(folder, recursive=True)
        if folders is not None and len(folders) < LIST_ROWS:
            folders.add(folder)


def write_files(rows: DataFrame, root: str, rel_col: str, data_col: str) -> DataFrame:
    """Write ``data_col`` (string or binary) of each row to ``root/<rel_col>``.

    Returns a DataFrame (path, bytes); the writes happen when it is evaluated.
    """
    src = rows.select(F.col(rel_col).alias("_rel"), F.col(data_col).alias("_data"))
    base = root.rstrip("/")

    def run(batches):
        fs, prefix = open_store(base)
        prefix, folders = prefix.rstrip("/"), set()
        for rb in (part for whole in batches for part in parts(whole, "_data")):
            paths, sizes = [], []
            for rel, data in zip(rb.column("_rel").to_pylist(), rb.column("_data").to_pylist()):
                raw = data.encode("utf-8") if isinstance(data, str) else bytes(data or b"")
                _write_bytes(fs, f"{prefix}/{rel}", raw, folders)
                paths.append(f"{base}/{rel}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return src.mapInArrow(run, "path string, bytes bigint")


def materialise(written: DataFrame) -> int:
    """Run a ``write_files`` plan and return the number of files written."""
    return int(written.agg(F.count("*").alias("n")).collect()[0]["n"])


def write_text_files(docs: DataFrame, root: str, id_col: str = "doc_id", folder_col: str = "source", text_col: str = "text") -> int:
    """One ``<folder>/<id>.txt`` file per row."""
    rel = F.concat(F.col(folder_col), F.lit("/"), F.col(id_col).cast("string"), F.lit(".txt"))
    return materialise(write_files(docs.select(rel.alias("rel"), F.col(text_col).alias("data")), root, "rel", "data"))


# ---------------------------------------------------------------------------------- PNG


def png_bytes(pixels: np.ndarray) -> bytes:
    """Encode an (h, w, 3) uint8 RGB array as PNG (stdlib zlib)."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) & 0xFFFFFFFF)

    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def vectors_as_images(vectors: DataFrame, root: str, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> int:
    """Render each vector as the least square image that holds all its values, named
    ``<id>.<label>.png`` (values are min-max scaled per vector, missing places are 0; red = value,
    green = 255 - value, blue = mean)."""
    src = vectors.select(
        F.concat(F.col(id_col).cast("string"), F.lit("."), F.col(label_col).cast("string"), F.lit(".png")).alias("rel"),
        F.col(vec_col).alias("v"),
    )

    def render(batches):
        for rb in batches:
            out = []
            for v in rb.column("v").to_pylist():
                a = np.asarray(v, dtype=np.float64)
                side = max(1, math.isqrt(max(a.size - 1, 0)) + 1)
                a = np.pad(a, (0, side * side - a.size))
                lo, hi = a.min(), a.max()
                g = np.zeros_like(a) if hi <= lo else (a - lo) / (hi - lo)
                r = np.round(g * 255).astype(np.uint8).reshape(side, side)
                img = np.stack([r, 255 - r, np.full_like(r, int(round(g.mean() * 255)))], axis=-1)
                out.append(png_bytes(img))
            yield pa.RecordBatch.from_arrays([rb.column("rel"), pa.array(out, pa.binary())], names=["rel", "png"])

    pngs = src.mapInArrow(render, "rel string, png binary")
    return materialise(write_files(pngs, root, "rel", "png"))
