import numpy as np
import pytest

from corpus_search.operators import ivf, knn


def _vecs(spark, rows, name="vec_id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def _brute(Q, X, k, metric="l2"):
    out = {}
    for qi, q in Q.items():
        ds = []
        for xi, x in X.items():
            q_, x_ = np.asarray(q), np.asarray(x)
            if metric == "l2":
                d = float(((q_ - x_) ** 2).sum())
            elif metric == "ip":
                d = -float(q_ @ x_)
            else:
                den = np.linalg.norm(q_) * np.linalg.norm(x_)
                d = 1.0 - (float(q_ @ x_) / den if den > 0 else 0.0)
            ds.append((round(d, 9), xi))
        out[qi] = [xi for _, xi in sorted(ds)[:k]]
    return out


def _hits(df):
    res = {}
    for r in df.orderBy("query_id", "rank").collect():
        res.setdefault(r.query_id, []).append(r.vec_id)
    return res


def test_ties_zero_vector_and_k_larger_than_n(spark):
    X = {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 0.0], 4: [1.0, 0.0]}
    Q = {10: [1.0, 0.0], 11: [0.0, 0.0]}
    v = _vecs(spark, list(X.items()))
    q = _vecs(spark, list(Q.items()), "query_id")
    got = _hits(knn.knn(q, v, k=10))
    assert got == {10: [1, 2, 4, 3], 11: [3, 1, 2, 4]}
    assert _hits(knn.knn(q, v, k=2)) == {10: [1, 2], 11: [3, 1]}


def test_single_vector(spark):
    v = _vecs(spark, [(5, [0.5, 0.5])])
    q = _vecs(spark, [(1, [0.0, 1.0])], "query_id")
    rows = knn.knn(q, v, k=3).collect()
    assert [(r.query_id, r.vec_id, r.rank) for r in rows] == [(1, 5, 1)]
    assert rows[0].distance == pytest.approx(0.5)
    assert rows[0].score == pytest.approx(0.5)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_matches_brute_force_and_strategies_agree(spark, metric):
    rng = np.random.default_rng(3)
    X = {i: rng.normal(size=8).round(3).tolist() for i in range(200)}
    X[200] = X[7]  # exact duplicate
    Q = {i: rng.normal(size=8).round(3).tolist() for i in range(30)}
    v = _vecs(spark, list(X.items()))
    q = _vecs(spark, list(Q.items()), "query_id")
    want = _brute(Q, X, 5, metric)
    a = _hits(knn.knn(q, v, 5, metric=metric, strategy="broadcast"))
    b = _hits(knn.knn(q, v, 5, metric=metric, strategy="blocked", query_block=7, vector_block=40))
    assert a == want
    assert b == want


def test_ivf_all_cells_equals_exact(spark):
    rng = np.random.default_rng(5)
    X = {i: rng.normal(size=6).tolist() for i in range(300)}
    v = _vecs(spark, list(X.items()))
    q = v.withColumnRenamed("vec_id", "query_id").limit(40)
    cents = ivf.sample_centroids(v, 12)
    cells = ivf.assign_cells(v, cents)
    exact = _hits(knn.knn(q, v, 5))
    assert _hits(ivf.knn_ivf(q, cells, cents, 5, nprobe=12)) == exact
    assert _hits(ivf.knn_ivf(q, cells, cents, 5, nprobe=12, strategy="blocked", query_block=8, vector_block=16)) == exact
    r1 = ivf.recall_at_k(ivf.knn_ivf(q, cells, cents, 5, nprobe=1), knn.knn(q, v, 5), 5).collect()[0].recall
    r12 = ivf.recall_at_k(ivf.knn_ivf(q, cells, cents, 5, nprobe=12), knn.knn(q, v, 5), 5).collect()[0].recall
    assert r1 <= r12 == 1.0


def test_ivf_index_layout_prunes_cells(spark, tmp):
    rng = np.random.default_rng(9)
    v = _vecs(spark, [(i, rng.normal(size=4).tolist()) for i in range(200)])
    cents = ivf.sample_centroids(v, 8)
    path = f"{tmp}/index"
    ivf.write_index(ivf.assign_cells(v, cents), path)
    stored = spark.read.parquet(path)
    plan = stored.filter(stored.cell_id.isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell_id" in plan
    q = v.withColumnRenamed("vec_id", "query_id").limit(10)
    assert _hits(ivf.knn_ivf(q, stored, cents, 3, nprobe=8)) == _hits(knn.knn(q, v, 3))


def test_plan_has_window_group_limit_and_no_cartesian(spark):
    rng = np.random.default_rng(1)
    v = _vecs(spark, [(i, rng.normal(size=4).tolist()) for i in range(50)])
    q = v.withColumnRenamed("vec_id", "query_id")
    plan = knn.knn(q, v, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan or "Window" in plan


def test_string_ids_blocked_equals_broadcast(spark):
    rng = np.random.default_rng(11)
    rows = [(f"c{i:04d}", rng.normal(size=5).tolist()) for i in range(120)]
    rows.append(("c9999", rows[3][1]))  # duplicate vector, larger id
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(9)], "query_id long, embedding array<double>")
    a = _hits(knn.knn(q, v, 4, vec_id="chunk_id", strategy="broadcast"))
    b = _hits(knn.knn(q, v, 4, vec_id="chunk_id", strategy="blocked", query_block=2, vector_block=30))
    assert a == b


def test_kmeans_centroids(spark):
    rng = np.random.default_rng(2)
    centers = np.array([[10.0, 0.0], [0.0, 10.0], [-10.0, 0.0]])
    v = _vecs(spark, [(i, (centers[i % 3] + rng.normal(scale=0.1, size=2)).tolist()) for i in range(90)])
    cents = ivf.kmeans_centroids(v, 3, seed=1)
    got = sorted(tuple(np.round(r.centroid, 0)) for r in cents.collect())
    assert got == sorted(tuple(c) for c in centers)
    cells = ivf.assign_cells(v, cents)
    per_cell = sorted(r["count"] for r in cells.groupBy("cell_id").count().collect())
    assert per_cell == [30, 30, 30]


def test_mixed_widths_fail(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    v = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [9.0, 0.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>").coalesce(1)
    for strategy in ("broadcast", "blocked"):
        with pytest.raises(Exception, match="width|shape"):
            knn.knn(q, v, 1, strategy=strategy).collect()
    with pytest.raises(Exception, match="width"):
        ivf.assign_cells(v, spark.createDataFrame([(0, [0.0] * 4)], "cell_id long, centroid array<double>")).collect()
