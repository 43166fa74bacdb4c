import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_search import session
from corpus_search.sinks import ledger


def scratch(spark):
    root = session.checkpoint_root(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_rows_that_are_stored_are_not_written_again(spark, tmp):
    rnd = np.random.default_rng(5)
    texts = [rnd.bytes(600).hex() for _ in range(1500)]
    made = spark.createDataFrame([(f"c{i:05d}", i, t) for i, t in enumerate(texts)], "chunk_id string, doc_id long, text string")
    rows = made.select("chunk_id", "doc_id", F.lit("s").alias("source"), F.lit(0).alias("chunk_index"), "text", F.array(F.lit(0.5), F.lit(1.0)).alias("embedding"))
    rows.write.parquet(f"{tmp}/rows")
    rows, path = spark.read.parquet(f"{tmp}/rows"), f"{tmp}/coll"
    assert ledger.append_by_ledger(rows.where("doc_id < 1400").unionByName(rows.where("doc_id < 10")), path, 2, bucket_ids=200) == 1400
    before = scratch(spark)
    assert ledger.append_by_ledger(rows, path, 2, bucket_ids=200) == 100
    assert ledger.append_by_ledger(rows, path, 2, bucket_ids=200) == 0
    assert scratch(spark) - before < 1500 * 600  # all rows were written for each append before
    stored = spark.read.parquet(path)
    assert stored.count() == 1500 == stored.select("chunk_id").distinct().count()
    assert stored.join(rows, ["chunk_id", "doc_id", "text"], "left_anti").count() == 0
    # a stored id is no excuse for a vector of another width
    with pytest.raises(Exception, match="vector width"):
        ledger.append_by_ledger(rows.withColumn("embedding", F.array(F.lit(0.5))), path, 2, bucket_ids=200)
