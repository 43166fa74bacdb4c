"""Appends that read only the ids that may collide, whatever the size of the collection.

Next to a collection lies a ledger of its ids, partitioned by ``level`` and ``bucket``. Level n has 2^n
buckets, by a hash of the id; a batch's ids go to the level at which the collection's buckets hold about
``BUCKET_IDS`` each (up to level ``MAX_LEVEL``, so that an append never writes and lists a folder for every few
ids), so a bucket stays small while the collection grows. An append looks its ids up in
their buckets only, one bucket of each level for an id: partition pruning leaves the rest unread. Rows that the
collection has are neither shuffled nor written again.

An append writes its ids to the ledger, then its rows to the collection, then the batch's name to the list
of done ones. What a broken append leaves in the ledger isn't done; ids of such a batch are looked up in the
collection itself, so running it again neither loses nor doubles a row.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_search.session import cut_lineage
from corpus_search.sinks import collections

#: Ids of a bucket at which the next level begins, and touched buckets up to which a lookup names them.
BUCKET_IDS = 100_000
MAX_NAMED = 10_000
#: Ids that the collection has of a batch, up to which they go along to the tasks that read its rows.
MAX_BROADCAST_IDS = 200_000
#: The last level: beyond its 4,096 buckets a level has no more folders, and their files grow instead.
MAX_LEVEL = 12


def _paths(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}-ids", f"{path.rstrip('/')}-done"


def _bucket(id_col: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(1 << level)).cast("int")


def levels(spark: SparkSession, path: str) -> list[int]:
    """The ledger's levels (each twice as large as the one before, so a few dozen at most)."""
    ids, _ = _paths(path)
    if not collections.exists(spark, ids):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ids)
    names = [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("level="))


def touched(rows: DataFrame, path: str, id_col: str = "chunk_id") -> DataFrame | None:
    """The ledger's rows (``_id``, ``batch``) in the buckets of the given rows' ids; None without a ledger."""
    spark, (ids, _) = rows.sparkSession, _paths(path)
    found = None
    for level in levels(spark, path):
        one = spark.read.parquet(f"{ids}/level={level}")
        named = rows.select(_bucket(F.col(id_col), level).alias("b")).distinct().limit(MAX_NAMED + 1).collect()
        if len(named) <= MAX_NAMED:
            one = one.where(F.col("bucket").isin([r["b"] for r in named]))
        one = one.select("_id", "batch")
        found = one if found is None else found.unionByName(one)
    return found


def known(rows: DataFrame, path: str, id_col: str = "chunk_id") -> DataFrame | None:
    """Those of the rows' ids that the collection has, each once; None without a ledger."""
    spark, (_, done) = rows.sparkSession, _paths(path)
    stored = touched(rows, path, id_col)
    if stored is None:
        return None
    near = cut_lineage(stored.join(rows.select(F.col(id_col).alias("_id")), "_id", "left_semi"), "ledger-hits")
    finished = spark.read.parquet(done).distinct() if collections.exists(spark, done) else spark.createDataFrame([], "batch string")
    found = near.join(F.broadcast(finished), "batch", "left_semi").select("_id")
    left_open = near.join(F.broadcast(finished), "batch", "left_anti").select("_id").distinct()
    if not left_open.isEmpty() and collections.exists(spark, path):
        there = spark.read.parquet(path).select(F.col(id_col).alias("_id"))
        found = found.unionByName(there.join(left_open, "_id", "left_semi"))
    return found.distinct().withColumnRenamed("_id", id_col)


def unseen(rows: DataFrame, path: str, id_col: str = "chunk_id") -> DataFrame:
    """The rows whose id the collection doesn't have."""
    stored = known(rows, path, id_col)
    return rows if stored is None else rows.join(stored, id_col, "left_anti")


def append_by_ledger(
    df: DataFrame, path: str, width: int, id_col: str = "chunk_id", schema: T.StructType | None = None, partition_by: str | None = None, bucket_ids: int = BUCKET_IDS
) -> int:
    """Append rows whose ``id_col`` is not stored yet, one of each id; returns how many. Ids must not be null."""
    spark, (ids, done) = df.sparkSession, _paths(path)
    rows = collections.conform(df, schema or collections.collection_schema(width), width)
    # the ids alone tell what is new; lengths are asked for so that every row's checks are made
    checked = [F.max(f(c)).alias(f"_{c}") for c, f in (("embedding", F.size), ("text", F.length)) if c in rows.columns]
    given = cut_lineage(rows.groupBy(id_col).agg(F.count("*").alias("_n"), *checked), "batch-ids")
    stored = known(given, path, id_col)
    if stored is not None:
        stored = cut_lineage(stored, "batch-known-ids")
        if (seen := stored.count()) == given.count():
            return 0
        rows = rows.join(F.broadcast(stored) if seen <= MAX_BROADCAST_IDS else stored, id_col, "left_anti").select(*rows.columns)
    # rows are shuffled once, for one of each id, and written once before the collection has them
    fresh = cut_lineage(rows.dropDuplicates([id_col]), "batch-new-rows")
    many = fresh.count()
    if not many:
        return 0
    # files' footers tell how many ids there are
    before = spark.read.parquet(ids).count() if collections.exists(spark, ids) else 0
    level = min(MAX_LEVEL, max(0, math.ceil(math.log2(max(1.0, (before + many) / bucket_ids)))))
    name = uuid.uuid4().hex
    entries = fresh.select(F.col(id_col).alias("_id"), F.lit(name).alias("batch"), F.lit(level).alias("level"), _bucket(F.col(id_col), level).alias("bucket"))
    entries.hint("rebalance", "bucket").write.mode("append").partitionBy("level", "bucket").parquet(ids)
    collections.write_rows(fresh, path, partition_by)
    spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(done)
    return many
