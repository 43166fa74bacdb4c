import math

import numpy as np
import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

from corpus_search.llm import queries
from corpus_search.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"


def brute(vectors):
    """n, S, covariance from whole numbers only, of the distinct vectors."""
    xs = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    cov = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs) / n**3 for j in range(d)] for i in range(d)])
    return xs, n, s, cov


def compare(got, vectors, ids, most=W.COMPONENTS):
    xs, n, s, cov = brute([v for v in vectors])
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(most, int((values > 1e-11 * values[0]).sum()) if values[0] > 0 else 0)
    assert len(got) == k * len(ids)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    gap = [min(abs(values[c] - o) for i, o in enumerate(values) if i != c) / values[0] if len(values) > 1 else 1 for c in range(k)]
    sign = [None] * k
    for i, v in zip(ids, vectors):
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        for c in range(k):
            for r in by[i, c + 1]:
                assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s))
                assert abs(r["explained"] - values[c] / np.trace(cov)) <= 1e-9
                assert r["identity_error"] <= 1e-4
                if gap[c] > 1e-6:
                    want = float(np.dot([(n * a - b) / n for a, b in zip(x, s)], directions[:, c])) / math.sqrt(values[c])
                    if sign[c] is None and abs(want) > 1e-3:
                        sign[c] = 1 if want * r["whitened"] > 0 else -1
                    assert abs(r["whitened"] - (sign[c] or 1) * want) < 1e-6, (i, c)


def test_whole_table_against_whole_numbers(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF_CHECK)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "identity_error", "whitened", "explained"] or set(got.columns) >= {
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    }
    rows = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(got.collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_odd_rows_repeats_and_widths(spark):
    rnd = np.random.default_rng(4)
    some = [[float(np.float32(x)) for x in rnd.normal(size=5) * [5, 3, 1, 1, 0.2]] for _ in range(60)]
    good = [(i, v, 1, "x") for i, v in enumerate(some)]
    good += [(3, some[3], 1, None)] * 3 + [(None, some[7], None, None)]  # repeated rows, a null id
    bad = [(900, None, 1, "x"), (901, [1.0, None, 1.0, 1.0, 1.0], 1, "x"), (902, [1.0, float("nan"), 0.0, 0.0, 0.0], 1, "x"), (903, [float("-inf")] * 5, 1, "x"), (904, [], 1, "x")]
    other = [(i, [float(i % 4), float(i % 3)], 1, "y") for i in range(1000, 1030)]
    df = spark.createDataFrame(good + bad + other, SCHEMA).repartition(7)
    models = W.fit(df)
    assert set(models) == {5, 2} and models[5].n == 60 and models[2].n == 12
    got = W.by_component(W.whiten(df, models)).collect()
    assert {r["vec_id"] for r in got} == {r[0] for r in good + other}
    compare([r for r in got if r["vec_id"] is None or r["vec_id"] < 900], [v for _, v, *_ in good], [i for i, *_ in good][:60] + [3, 3, 3, None])
    compare([r for r in got if r["vec_id"] is not None and r["vec_id"] >= 1000], [v for _, v, *_ in other], [i for i, *_ in other])


def test_no_direction_and_no_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, "x") for i in range(9)], SCHEMA)
    models = W.fit(same)
    assert models[2].n == 1
    one = W.whiten(same, models).collect()
    assert len(one) == 9 and {r["deviation"] for r in one} == {0} and all(r["whitened"] == [] for r in one)
    assert W.by_component(W.whiten(same, models)).count() == 0
    none = same.limit(0)
    assert W.fit(none) == {} and W.by_component(W.whiten(none, {})).count() == 0


def test_flat_directions_are_left_out(spark):
    rows = [(i, [float(i % 7), float(i % 7) * 2, 1.0, float(i % 5)], 1, "x") for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    models = W.fit(df)
    assert models[4].components.shape == (4, 2) and models[4].identity_error < 1e-9
    compare(W.by_component(W.whiten(df, models)).collect(), [v for _, v, *_ in rows], [i for i, *_ in rows])


def test_entries_of_any_size(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.0e9, 2.0]), (4, [600.0, 3.0]), (5, [-40000.0, 3.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    models = W.fit(df)
    got = {r["vec_id"]: r for r in W.whiten(df, models).collect()}
    xs = [[max(-W.LIMIT, min(W.LIMIT, math.floor(64 * c))) for c in v] for _, v in rows]
    s = [sum(x[j] for x in xs) for j in range(2)]
    for (i, _), x in zip(rows, xs):
        want = sum((5 * a - b) ** 2 for a, b in zip(x, s))
        assert got[i]["deviation"] == (want if want < 1 << 63 else None)


@pytest.mark.parametrize("d,rank", [(1, 1), (7, 7), (24, 9), (65, 65)])
def test_eigen_against_numpy(d, rank):
    rnd = np.random.default_rng(d)
    a = rnd.normal(size=(rank, d)) * np.logspace(0, -3, rank)[:, None]
    v = a.T @ a
    p, l = W.pivoted_cholesky(v)
    assert np.allclose(l @ l.T, v[np.ix_(p, p)], atol=1e-12) and np.all(np.triu(l, 1) == 0)
    values, directions = W.eigen(v)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(values) == (want > W.RANK * want[0]).sum() >= rank - 1
    assert np.allclose(values, want[: len(values)], rtol=1e-8, atol=1e-15)
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-10)
    assert np.allclose(v @ directions, directions * values, atol=1e-12 * want[0] * d + 1e-14)


def test_sums_are_carried():
    rnd = np.random.default_rng(1)
    parts = [rnd.integers(-W.LIMIT, W.LIMIT, size=(50, 3)) for _ in range(4)]
    total = W._counts(parts[0])
    for y in parts[1:]:
        total = W._carried(total, W._counts(y))
    assert [(int(a) << 31) + int(b) for a, b in zip(total[1:4], total[4:])] == [sum(int(v) for y in parts for v in y[:, k]) for k in range(3)]
    assert total[0] == 200


def test_hot_vector_counts_once(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") / 64.0, F.lit(0.0))).alias("embedding"))
    assert W.fit(df)[2].n == 2001
