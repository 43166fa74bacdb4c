"""Exact duplicate handling by content hash.

* ``exact_dedup``        - duplicate groups: one row per distinct hash with the first id and
                           the number of copies. A plain aggregation (partial per task, then
                           merged), so a hash held by a third of all rows costs nothing extra.
* ``keep_first``         - the documents that survive deduplication (first id per hash).
* ``dedup_against_seen`` - skip content whose hash is already in a ``seen`` table (anti-join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.session import cut_lineage


def exact_dedup(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    return (
        df.select(F.col(id_col), F.md5(F.col(col)).alias("md5"))
        .groupBy("md5")
        .agg(F.min(id_col).alias("first_id"), F.count("*").cast("bigint").alias("n_copies"))
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Rows whose id is the smallest among rows with equal content (semi-join on (md5, id))."""
    hashed = df.withColumn("md5", F.md5(F.col(col)))
    firsts = exact_dedup(df, id_col, col).select("md5", F.col("first_id").alias(id_col))
    return hashed.join(firsts, on=["md5", id_col], how="left_semi")


#: Bytes of a broadcast of hashes, and of one hash in it.
MAX_BROADCAST_BYTES = 64 << 20
HASH_BYTES = 96


def dedup_against_seen(incoming: DataFrame, seen: DataFrame, col: str = "text", seen_col: str = "md5") -> DataFrame:
    """Incoming rows whose content hash is not in ``seen``.

    Joining the incoming *rows* on md5 would put a hash held by a third of them on one task.
    Instead the seen hashes among the *distinct* incoming hashes are found first (both sides
    distinct, so no hot key), materialised in the shared folder, and - when their count is
    bounded - broadcast into the final anti-join, so incoming rows are never shuffled by md5.
    """
    hashed = incoming.withColumn("md5", F.md5(F.col(col)))
    incoming_hashes = hashed.select("md5").distinct()
    seen_hashes = seen.select(F.col(seen_col).alias("md5")).distinct()
    hit = cut_lineage(incoming_hashes.join(seen_hashes, "md5", "left_semi"), "seen-hits")
    small = hit.count() * HASH_BYTES <= MAX_BROADCAST_BYTES
    return hashed.join(F.broadcast(hit) if small else hit, on="md5", how="left_anti")
