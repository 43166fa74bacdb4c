import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpus_search.operators import metrics, ordered


def _calls(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (1, 1, "embed", t0, 0.0, 100),
        (2, 1, "embed", t0 + dt.timedelta(seconds=5), 2.0, None),
        (3, 2, "upload", t0 + dt.timedelta(seconds=1), 1.5, 0),
        (4, 2, "embed", t0 + dt.timedelta(seconds=9), 1.0, 1048576),
        (5, 3, "search", t0 + dt.timedelta(seconds=3), 0.0, 0),
    ]
    return spark.createDataFrame(rows, "call_id long, user_id long, stage string, started timestamp, elapsed_s double, bytes long")


def test_stage_metrics_zero_and_null_cases(spark):
    got = {r.stage: r for r in metrics.stage_metrics(_calls(spark)).collect()}
    assert (got["embed"].calls, got["embed"].total_time, got["embed"].total_bytes) == (3, 3.0, 1048676)
    assert got["embed"].mb_per_s == round(1048676 / 1048576 / 3.0, 6)
    assert got["upload"].mb_per_s == 0.0  # zero bytes
    assert got["search"].mb_per_s == 0.0  # zero time and zero bytes
    rep = {r.stage: r for r in metrics.metrics_report(metrics.stage_metrics(_calls(spark))).collect()}
    assert (rep["embed"].time_s, rep["embed"].avg_time_s, rep["embed"].mb) == ("3.00", "1.00", "1.00")


def test_fixed2_rounding(spark):
    df = spark.createDataFrame([(0.005,), (1.994,), (-2.5,), (123456.789,)], "x double")
    assert [r.s for r in df.select(metrics.fixed2("x").alias("s")).collect()] == ["0.01", "1.99", "-2.50", "123456.79"]


def test_bucketed_running_totals_equal_plain_window(spark):
    calls = _calls(spark)
    w = Window.partitionBy("stage").orderBy("started", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r.call_id: (r.n, r.t) for r in calls.select("call_id", F.count("*").over(w).alias("n"), F.sum("elapsed_s").over(w).alias("t")).collect()}
    for per_bucket in (1, 2, 100):
        got = ordered.running_totals(calls, "stage", "started", "call_id", {"t": F.col("elapsed_s")}, count_out="n", rows_per_bucket=per_bucket)
        assert {r.call_id: (r.n, r.t) for r in got.collect()} == plain


def test_bucketed_lag_equals_lag(spark):
    calls = _calls(spark)
    w = Window.partitionBy("user_id").orderBy("started", "call_id")
    plain = {r.call_id: r.p for r in calls.select("call_id", F.lag("stage").over(w).alias("p")).collect()}
    for per_bucket in (1, 2, 100):
        got = ordered.previous_row(calls, "user_id", "started", "call_id", ["stage"], rows_per_bucket=per_bucket)
        assert {r.call_id: r.prev_stage for r in got.collect()} == plain


def test_ordered_with_nulls_ties_and_an_outlier(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, None if i % 5 == 0 else (10**12 if i == 33 else i // 4), None if i % 3 else float(i)) for i in range(80)]
    df = spark.createDataFrame(rows + [(100, "c", 1, None), (101, "c", 2, 4.0)], "id long, k string, t long, v double")
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = df.select(
        "id", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("id").over(w).alias("p"), F.lag("v").over(w).alias("pv"),
    )
    want = {r.id: tuple(r)[1:] for r in plain.collect()}
    for per_bucket in (1000, 28, 1):  # one bucket, three, one for each row
        totals = ordered.running_totals(df, "k", "t", "id", {"s": F.col("v")}, count_out="n", rows_per_bucket=per_bucket)
        before = ordered.previous_row(df, "k", "t", "id", ["id", "v"], rows_per_bucket=per_bucket)
        got = {r.id: (r.n, r.s) for r in totals.collect()}
        lag = {r.id: (r.prev_id, r.prev_v) for r in before.collect()}
        assert {i: got[i] + lag[i] for i in got} == want
    skewed = df.withColumn("t", F.when(F.col("id") == 101, F.lit(10**12)).otherwise(F.col("id")))
    sizes = [r["count"] for r in ordered.add_buckets(skewed, "t", "id", 20).groupBy("_bucket").count().collect()]
    assert max(sizes) < 45  # ranges follow the rows, not the distance of the outlier


def test_bytes_lookup(spark):
    calls = spark.createDataFrame([(1, "k1", 5), (2, "k2", None), (3, "k3", None)], "call_id long, key string, own_bytes long")
    listing = spark.createDataFrame([("k2", 7)], "key string, size long")
    got = {r.call_id: r.bytes for r in metrics.bytes_lookup(calls, listing, "key").collect()}
    assert got == {1: 5, 2: 7, 3: 0}


def test_memory_and_cpu_when_recorded(spark):
    calls = _calls(spark).withColumn("memory_mb", F.lit(2.0)).withColumn("cpu_pct", F.col("call_id").cast("double"))
    got = {r.stage: (r.total_memory_mb, r.avg_cpu_pct) for r in metrics.stage_metrics(calls).collect()}
    assert got["embed"] == (6.0, round((1 + 2 + 4) / 3, 6))
    assert "total_memory_mb" not in metrics.stage_metrics(_calls(spark)).columns
