"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpus_search.session import checkpoint_root, ship_package


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A driver table, read as it lies (no repartition); Python workers get the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # long texts: a batch stays small
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which the small side of a join is broadcast, and into how many keys one is parted beyond.
MAX_BROADCAST = 32 << 20
SALTS = 16


def fresh(*taken: DataFrame, stem: str) -> str:
    """A column name that no column of the given tables has."""
    names = {c.lower() for df in taken for c in df.columns}
    while stem.lower() in names:
        stem = f"_{stem}"
    return stem


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, so that no executor's loss undoes it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_small(big: DataFrame, small: DataFrame, on: list[str], weight: Column, how: str = "inner") -> DataFrame:
    """A join with a table whose bytes are counted: broadcast up to MAX_BROADCAST, else by salted keys."""
    size = small.agg(F.sum(weight)).first()[0] or 0
    if size <= MAX_BROADCAST:
        return big.join(F.broadcast(small), on, how)
    salt = fresh(big, small, stem="_salt")
    dealt = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copied = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*on, salt], how).drop(salt)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row (null ids: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def quotas(counts: dict, most: int) -> dict:
    """How many rows of each label a sample of at most ``most`` has: an equal part for each, the rest by their number."""
    if sum(counts.values()) <= most:
        return dict(counts)
    least = {y: min(n, most // (len(counts) + 1)) for y, n in counts.items()}
    left, more = most - sum(least.values()), sum(counts.values()) - sum(least.values())
    return {y: least[y] + left * (n - least[y]) // more for y, n in counts.items()}


def labelled_sample(known: DataFrame, most: int, name: str) -> tuple[DataFrame, dict]:
    """At most ``most`` rows of (``_id``, ``_t``, ``_y``), a quota of each label by a hash of id and text, and all labels' counts."""
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    parts = quotas(counts, most)
    # a little more than the quota by a bound on the hash, of those the first
    rows = [(y, n, int(min(1.0, (n + 6 * n**0.5 + 20) / counts[y]) * (1 << 40))) for y, n in parts.items()]
    wanted = known.sparkSession.createDataFrame(rows, f"_y {known.schema['_y'].dataType.simpleString()}, _quota long, _bound long")
    place = F.pmod(F.xxhash64("_id", "_t", F.lit(name)), F.lit(1 << 40))
    near = known.withColumn("_place", place).join(F.broadcast(wanted), "_y").where(F.col("_place") < F.col("_bound"))
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("_y").orderBy("_place", "_id")))
    return ranked.where((F.col("_k") <= most) & (F.col("_k") <= F.col("_quota"))).select("_id", "_t", "_y"), counts


def utf8_parts(texts: pa.Array, part_bytes: int = 4 << 20):
    """Slices of a string array with about ``part_bytes`` each (one longer text alone), with their start."""
    ends = text_offsets(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + part_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a (large) string or binary array, as int64, n + 1 of them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls as one uint8 array, and the n + 1 offsets into it."""
    ends = text_offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def no_nulls(texts: pa.Array) -> pa.Array:
    """Null texts count as empty ones."""
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, "") if texts.null_count else texts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` over all pairs."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lengths)
