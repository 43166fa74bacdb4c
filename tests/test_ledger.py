from pyspark.sql import functions as F

from corpus_search.sinks import ledger


def rows(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi).select(
        F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), i.alias("doc_id"), F.lit("s").alias("source"), F.lit(0).alias("chunk_index"),
        F.concat(F.lit("text "), i.cast("string")).alias("text"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))


def test_appends_add_each_id_once(spark, tmp):
    path = f"{tmp}/coll"
    assert ledger.append_by_ledger(rows(spark, 0, 500), path, 2, bucket_ids=50) == 500
    assert ledger.append_by_ledger(rows(spark, 300, 700).unionByName(rows(spark, 650, 700)), path, 2, bucket_ids=50) == 200
    assert ledger.append_by_ledger(rows(spark, 0, 700), path, 2, bucket_ids=50) == 0
    stored = spark.read.parquet(path)
    assert stored.count() == 700 == stored.select("chunk_id").distinct().count()
    assert len(ledger.levels(spark, path)) == 1 or ledger.levels(spark, path) == [4]


def test_a_small_append_reads_a_bounded_number_of_ids(spark, tmp):
    """Five ids looked up in collections of 1,000 and of 16,000: as many ledger rows read."""
    read = {}
    for n in (1000, 16_000):
        path = f"{tmp}/coll{n}"
        for lo in range(0, n, n // 4):
            ledger.append_by_ledger(rows(spark, lo, lo + n // 4), path, 2, bucket_ids=100)
        few = rows(spark, 10**6, 10**6 + 5)
        read[n] = ledger.touched(few, path).count()
        plan = ledger.touched(few, path)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
        assert ledger.unseen(few, path).count() == 5
    assert read[16_000] <= 2 * read[1000] < 5 * 100 * 4 * 2


def test_a_broken_append_is_mended_by_running_it_again(spark, tmp):
    path = f"{tmp}/coll"
    ledger.append_by_ledger(rows(spark, 0, 100), path, 2, bucket_ids=50)
    ids, _ = ledger._paths(path)

    def broken(lo, hi, name):
        one = rows(spark, lo, hi).select(F.col("chunk_id").alias("_id"), F.lit(name).alias("batch"), F.lit(1).alias("level"), ledger._bucket(F.col("chunk_id"), 1).alias("bucket"))
        one.write.mode("append").partitionBy("level", "bucket").parquet(ids)

    broken(100, 150, "before the rows")
    broken(150, 200, "after the rows")
    rows(spark, 150, 200).write.mode("append").parquet(path)
    assert ledger.append_by_ledger(rows(spark, 100, 200), path, 2, bucket_ids=50) == 50
    assert ledger.append_by_ledger(rows(spark, 0, 200), path, 2, bucket_ids=50) == 0
    stored = spark.read.parquet(path)
    assert stored.count() == 200 == stored.select("chunk_id").distinct().count()
