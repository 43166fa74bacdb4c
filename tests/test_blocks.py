import os

import numpy as np
from pyspark.sql import functions as F

from corpus_search import session
from corpus_search.operators import ivf, knn, pruned


def scattered(spark, path, n=2000, width=32, seed=3):
    """Vectors that no bound tells apart, one in five a copy of the first, in floats."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, width)).astype(np.float32)
    x[::5] = x[0]
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def asked(v):
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def table(hits):
    return {(r.query_id, r.rank): (r.vec_id, round(r.distance, 9)) for r in hits.collect()}


def scratch(spark):
    root = session.checkpoint_root(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_blocks_give_k_rows_a_query(spark, tmp):
    v = scattered(spark, f"{tmp}/v")
    one = v.select("vec_id", F.col("embedding").alias("vv"), F.lit(0).alias("cell_id"))
    for metric in knn.METRICS:
        found = pruned.searched(asked(v).withColumn("cell_id", F.lit(0)), one, {0: 2000}, 32, 5, metric, block_bytes=128 * 32 * 8, queries_per_group=128)
        # k rows for each of 16 blocks before
        assert found.count() == 2000 * 5
        assert table(knn._rank(found, 5)) == table(knn.knn(v.select(F.col("vec_id").alias("query_id"), "embedding"), v, 5, metric=metric, strategy="broadcast"))


def test_cells_of_a_query_are_one_row(spark, tmp):
    v = scattered(spark, f"{tmp}/v", 900)
    cents = ivf.sample_centroids(v, 12)
    cells = ivf.assign_cells(v, cents)
    found = ivf._ivf_blocked(asked(v), cells.select("vec_id", F.col("embedding").alias("vv"), "cell_id"), cents, 5, 4, "l2", 32, 64, 64, 1 << 28)
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] == 5  # of 4 cells and their blocks before
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert table(ivf.knn_ivf(q, cells, cents, 5, 4, strategy="blocked", query_block=64, vector_block=64)) == table(ivf.knn_ivf(q, cells, cents, 5, 4, strategy="broadcast"))


def test_pruned_search_stores_no_visits(spark, tmp):
    v = scattered(spark, f"{tmp}/v", 4000)
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    want, before = table(knn.knn(q, v, 5, strategy="broadcast")), scratch(spark)
    assert table(pruned.knn_pruned(q, v, 5)) == want
    # cells, planned queries and blocks; a vector for each visit before
    assert scratch(spark) - before < 5 * 4000 * 32 * 4


def test_blocks_are_cut_by_cell_and_size(spark, tmp):
    v = scattered(spark, f"{tmp}/v", 500, 8)
    dealt = v.select("vec_id", F.col("embedding").alias("vv"), F.when(F.col("vec_id") < 300, 0).otherwise(F.col("vec_id") % 7).cast("int").alias("cell_id"))
    sizes = {r["cell_id"]: r["count"] for r in dealt.groupBy("cell_id").count().collect()}
    stored = pruned.stored_blocks(dealt, sizes, 8, block_bytes=20 * 64)
    got = {c: sorted(i for ids, _ in stored.read(c, {}) for i in ids.tolist()) for c in sizes}
    assert {c: len(x) for c, x in got.items()} == sizes and got[0] == sorted(r["vec_id"] for r in dealt.where("cell_id = 0").collect())
    assert sum(n for _, _, n in stored.runs[0]) >= sizes[0] / 20
