"""Per-stage performance metrics over a table of stage calls.

A stage call is a row ``(stage, started, elapsed_s, bytes)``; the ``events`` table stands in
with ``event_type`` as the stage, ``value`` as elapsed seconds and ``props.k`` as bytes.

* ``stage_calls``      - events -> calls (bytes parsed from the JSON props).
* ``stage_metrics``    - per stage: calls, total/avg time, total bytes and MB, throughput (A1/A2).
* ``stage_running``    - running totals per stage after each call (bucketed, skew-safe) (W3).
* ``step_elapsed``     - time since the previous step of the same user (bucketed lag) (W5).
* ``bytes_lookup``     - own size, else recorded listing size, else 0 (J6).
* ``metrics_report``   - fixed two-decimal text report columns (F9).
* ``write_report_csv`` - append the report to CSV with a header (K4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.operators import ordered

# Fixed value: bytes per megabyte used by the reports.
MB = 1048576


def stage_calls(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id"),
        F.col("event_type").alias("stage"),
        F.col("ts").cast("timestamp").alias("started"),
        F.col("value").alias("elapsed_s"),
        F.get_json_object("props", "$.k").cast("bigint").alias("bytes"),
    )


def throughput(total_bytes: Column, total_time: Column) -> Column:
    """MB/s, 0 when either the time or the byte count is 0 (or missing)."""
    ok = (total_time > 0) & (total_bytes > 0)
    return F.when(ok, total_bytes / F.lit(MB) / total_time).otherwise(F.lit(0.0))


def stage_metrics(calls: DataFrame) -> DataFrame:
    """Per stage: calls, total/avg time, bytes, MB, MB/s; when the calls carry ``memory_mb`` /
    ``cpu_pct`` also the summed memory and the average CPU (sum / calls)."""
    extra_aggs, extra_cols = [], []
    if "memory_mb" in calls.columns:
        extra_aggs.append(F.sum("memory_mb").alias("_mem"))
        extra_cols.append(F.round("_mem", 6).alias("total_memory_mb"))
    if "cpu_pct" in calls.columns:
        extra_aggs.append(F.sum("cpu_pct").alias("_cpu"))
        extra_cols.append(F.round(F.col("_cpu") / F.col("calls"), 6).alias("avg_cpu_pct"))
    agg = calls.groupBy("stage").agg(
        F.count("*").cast("bigint").alias("calls"),
        F.sum("elapsed_s").alias("total_time"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        *extra_aggs,
    )
    return agg.select(
        "stage",
        "calls",
        F.round("total_time", 6).alias("total_time"),
        F.round(F.col("total_time") / F.col("calls"), 6).alias("avg_time"),
        "total_bytes",
        F.round(F.col("total_bytes") / F.lit(MB), 6).alias("total_mb"),
        F.round(throughput(F.col("total_bytes"), F.col("total_time")), 6).alias("mb_per_s"),
        *extra_cols,
    )


def stage_running(calls: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    out = ordered.running_totals(
        calls,
        "stage",
        "started",
        "call_id",
        {"running_time": F.col("elapsed_s"), "running_bytes": F.coalesce(F.col("bytes"), F.lit(0))},
        count_out="running_calls",
        rows_per_bucket=rows_per_bucket,
    )
    return out.withColumn("running_mb_per_s", throughput(F.col("running_bytes"), F.col("running_time")))


def step_elapsed(calls: DataFrame, key: str = "user_id", rows_per_bucket: int = 1_000_000) -> DataFrame:
    prev = ordered.previous_row(calls, key, "started", "call_id", ["started", "stage"], rows_per_bucket)
    secs = (F.unix_micros("started") - F.unix_micros("prev_started")) / F.lit(1e6)
    return prev.withColumn("since_prev_s", secs)


def bytes_lookup(calls: DataFrame, listing: DataFrame, key: str, own: str = "own_bytes", listed: str = "size") -> DataFrame:
    """``bytes`` = own size, else the listing's recorded size for the key, else 0."""
    j = calls.join(listing.select(F.col(key), F.col(listed).alias("_listed")), key, "left")
    return j.withColumn("bytes", F.coalesce(F.col(own), F.col("_listed"), F.lit(0)).cast("bigint")).drop("_listed")


def fixed2(c) -> Column:
    """Two-decimal text (round half up on the value times 100)."""
    x = F.col(c) if isinstance(c, str) else c
    cents = F.floor(x * 100 + F.lit(0.5)).cast("bigint")
    sign = F.when(cents < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(cents)
    return F.concat(sign, (a / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def metrics_report(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "stage",
        "calls",
        fixed2("total_time").alias("time_s"),
        fixed2("avg_time").alias("avg_time_s"),
        fixed2(F.col("total_bytes") / F.lit(MB)).alias("mb"),
        fixed2("mb_per_s").alias("mb_per_s"),
    )


def write_report_csv(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("append").option("header", True).csv(path)
