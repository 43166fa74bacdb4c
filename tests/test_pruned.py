import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_search.operators import ivf, knn, pruned


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """3000 vectors in 20 clusters, some of them equal, and null ones."""
    rnd = np.random.default_rng(1)
    centers = rnd.normal(size=(20, 8)) * 10
    x = np.round(centers[rnd.integers(0, 20, 3000)] + rnd.normal(size=(3000, 8)), 1)
    x[2000:2040] = x[0]  # ties across the k-th place
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None)]
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def queries(vectors, every=7):
    return vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def table(hits):
    return {(r.query_id, r.rank): (r.vec_id, round(r.distance, 9), round(r.score, 9)) for r in hits.collect()}


@pytest.mark.parametrize("metric", pruned.METRICS)
def test_equals_exact_search_and_visits_few_cells(clustered, metric):
    q = queries(clustered)
    cells = pruned.cells_of(clustered, pruned.sample_pivots(clustered))
    found = pruned.search(q, cells, 5, metric)
    assert table(found.hits) == table(knn.knn(q, clustered, 5, metric=metric))
    sizes = cells.bounds.counts()
    pairs = sum(sizes[r.cell_id] for r in found.visits.collect())
    assert pairs < 0.5 * q.where("embedding is not null").count() * 3000


def test_scattered_vectors_and_few_of_them(spark):
    rnd = np.random.default_rng(2)
    rows = [(f"v{i}", [float(v) for v in rnd.normal(size=3)]) for i in range(90)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    assert table(pruned.knn_pruned(q, v, 4)) == table(knn.knn(q, v, 4))
    three = v.where("vec_id in ('v1', 'v2', 'v3')")
    assert table(pruned.knn_pruned(q, three, 5)) == table(knn.knn(q, three, 5))
    assert pruned.knn_pruned(q, v.limit(0), 5).count() == 0
    assert pruned.knn_pruned(q.limit(0), v, 5).count() == 0


def test_hot_cell_in_blocks_and_groups(clustered, monkeypatch):
    """One cell of 3000 vectors in blocks of 100, its visits in groups of 50."""
    pivot = clustered.where("vec_id = 0").select("embedding")
    cells = pruned.cells_of(clustered, pivot)
    assert cells.bounds.sizes.tolist() == [3000]
    q = queries(clustered)
    visits = q.where("embedding is not null").select("query_id", F.col("embedding").alias("qv"), F.lit(int(cells.bounds.ids[0])).alias("cell_id"))
    hits = pruned.searched(visits, cells.table, cells.bounds.counts(), 8, 5, block_bytes=100 * 64, queries_per_group=50)
    assert table(knn.with_score(knn._rank(hits, 5), "l2")) == table(knn.knn(q, clustered, 5))


def test_no_side_is_copied_for_all_blocks(clustered):
    cells = pruned.cells_of(clustered, pruned.sample_pivots(clustered))
    plan = pruned.search(queries(clustered), cells, 5).hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tree_equals_flat_search_at_full_probe(clustered):
    cents = ivf.sample_centroids(clustered.where("embedding is not null"), 60)
    flat = {(r.vec_id, r.probe_rank): r.cell_id for r in ivf.nearest(clustered, cents, 60).collect()}
    tree = pruned.CentroidTree.of(cents)
    assert {(r.vec_id, r.probe_rank): r.cell_id for r in tree.nearest(clustered, 60).collect()} == flat
    four = {k: v for k, v in flat.items() if k[1] < 4}
    assert {(r.vec_id, r.probe_rank): r.cell_id for r in tree.nearest(clustered, 4).collect()} == four
    beam = {r.vec_id: r.cell_id for r in tree.nearest(clustered, 1, beam=3).collect()}
    assert np.mean([flat[i, 0] == c for i, c in beam.items()]) > 0.9


def test_many_centroids_are_no_error(clustered):
    cents = ivf.sample_centroids(clustered.where("embedding is not null"), 60)
    few = {r.vec_id: r.cell_id for r in ivf.assign_cells(clustered, cents).collect()}
    many = {r.vec_id: r.cell_id for r in ivf.assign_cells(clustered, cents, max_broadcast_bytes=100).collect()}
    assert few == many and few[5000] is None
    cells = ivf.assign_cells(clustered, cents)
    q = queries(clustered, 50)
    want = table(ivf.knn_ivf(q, cells, cents, 5, 6))
    small = q.where("embedding is not null").count() * 8 * 8
    assert small < 60 * 8 * 8 * 2
    assert table(ivf.knn_ivf(q, cells, cents, 5, 6, max_broadcast_bytes=3839, strategy="blocked")) == want
    with pytest.raises(ValueError):
        ivf.nearest(clustered, cents, 2, metric="cosine", max_broadcast_bytes=100)
