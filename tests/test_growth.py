"""What a query holds, writes or starts grows no faster than its input."""

from pyspark.sql import functions as F

from corpus_search.operators import postings


def test_postings_name_chunks_by_number_and_repeated_ids_count_twice(spark, tmp):
    rows = [(f"c{i % 30:02d}", f"the word{i % 7} word{i % 3}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)
    postings.write_index(chunks, f"{tmp}/index", range_rows=8)
    stored = spark.read.parquet(f"{tmp}/index/postings")
    assert {f.name for f in stored.schema["posts"].dataType.elementType.fields} == {"no", "tf", "dl"}
    assert stored.where("term = 'the'").agg(F.sum("n")).first()[0] == 40
    question = spark.createDataFrame([(1, "the word1")], "query_id long, question string")
    got = {r.vec_id: r.score for r in postings.Index(spark, f"{tmp}/index").search(question, 30).rows.collect()}
    single = {r.vec_id: r.score for r in postings.Index(spark, f"{tmp}/index").search(spark.createDataFrame([(1, "the")], question.schema), 30).rows.collect()}
    assert len(single) == 30 and abs(single["c03"] - 2 * single["c13"]) < 1e-9 and got["c01"] > got["c13"]


def test_objects_are_listed_and_read_by_tasks(spark, tmp):
    """No file index on the driver, many objects a task, hidden names left out as Spark does, empty ones kept."""
    import hashlib
    import os

    from corpus_search.sources import files

    want = {}
    for rel, data in {"a/1.txt": b"one", "a/2.txt": b"", "b/c/3.txt": b"x" * 5000, "a/_hidden.txt": b"no", "b/.c.txt": b"no", "d=1/_k=1.txt": b"yes"}.items():
        os.makedirs(os.path.dirname(f"{tmp}/{rel}"), exist_ok=True)
        with open(f"{tmp}/{rel}", "wb") as f:
            f.write(data)
        if data != b"no":
            want[f"file:{tmp}/{rel}"] = (len(data), hashlib.md5(data).hexdigest())
    assert "binaryFile" not in files.list_objects(spark, tmp)._jdf.queryExecution().executedPlan().toString()
    for content in (True, False):
        got = files.scan_binary(spark, tmp, content=content)
        assert "BinaryFile" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.path: (r.length, r.md5) for r in got.collect()} == want and ("content" in got.columns) == content
    assert [r.length for r in files.list_objects(spark, f"{tmp}/a/1.txt").collect()] == [3]
    spark_lists = {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tmp).select("path").collect()}
    assert spark_lists == {p for p, (n, _) in want.items() if n}


def test_adam_starts_a_job_a_segment_and_not_a_batch(spark, monkeypatch):
    import numpy as np

    from corpus_search.operators import training

    n = 64 * 40
    train = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 40).alias("batch"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("adam", "adam")
    model, _ = training.train_adam(train, 2, epochs=3)
    jobs = len(tracker.getJobIdsForGroup("adam"))
    assert jobs < 40  # 120 steps
    monkeypatch.setattr(training, "SEGMENT_ROWS", 150)  # two batches a segment
    cut, _ = training.train_adam(train, 2, epochs=3)
    monkeypatch.setattr(training, "SEGMENT_ROWS", 50)  # each batch by many tasks
    summed, _ = training.train_adam(train, 2, epochs=3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(model.weight, cut.weight, atol=1e-12) and np.allclose(model.weight, summed.weight, atol=1e-12)


def test_a_stream_lists_folders_and_not_each_file(spark, tmp):
    import os

    from corpus_search.streaming import jobs

    for i in range(150):
        os.makedirs(f"{tmp}/in/f{i % 3}/deep", exist_ok=True)
        with open(f"{tmp}/in/f{i % 3}/{i}.txt", "w") as f:
            f.write(f"text {i % 100}")
    for odd in ("in/top.txt", "in/f1/deep/x.txt", "in/f1/other.md"):  # not what the glob names
        with open(f"{tmp}/{odd}", "w") as f:
            f.write(odd)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stream", "stream")
    for _ in range(2):
        jobs.stream_ingest_exact(spark, f"{tmp}/in/*/*.txt", f"{tmp}/sink", f"{tmp}/ckpt", max_files_per_trigger=3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    most = max((s.numTasks for j in tracker.getJobIdsForGroup() for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i))), default=0)
    assert spark.read.parquet(f"{tmp}/sink").select("md5").distinct().count() == 100 == spark.read.parquet(f"{tmp}/sink").count()
    assert most < 100 and spark.conf.get("spark.sql.shuffle.partitions") == before
    # 50 batches: the hashes of the first 32 were put together
    assert os.path.exists(f"{tmp}/sink-seen/upto=32/_SUCCESS")


def test_buckets_are_cut_by_a_few_tasks(spark):
    from corpus_search.operators import ordered

    rows = spark.range(20_000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("t"))
    found = ordered.add_buckets(rows, "t", "id", 20, "k")
    assert found.rdd.getNumPartitions() < 50 and found.groupBy("_bucket").count().agg(F.max("count"), F.count("*")).first()[0] == 20


def test_batches_are_made_in_bounded_parts():
    import numpy as np
    import pyarrow as pa

    from corpus_search.functions import batches

    texts = ["x" * n for n in (10, 500, 0, 10_000, 3, 3, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    got = list(batches.parts(batch, "t", 600, 3))
    assert [t for p in got for t in p.column(0).to_pylist()] == texts and [p.num_rows for p in got] == [3, 1, 3, 1]
    from corpus_search.operators import knn

    rng = np.random.default_rng(1)
    d = rng.integers(0, 3000, (40, 1000)).astype(float)  # with ties
    part, kth, count = knn._least(d, 5, np.full(40, 1e-9))
    want = np.sort(d, 1)[:, :5]
    assert (np.sort(np.take_along_axis(d, part, 1), 1) == want).all() and (kth == want[:, 4]).all() and (count == (d <= want[:, 4:]).sum(1)).all()


def test_a_ledger_has_a_bounded_number_of_folders(spark, tmp, monkeypatch):
    import os

    from test_ledger import rows

    from corpus_search.sinks import ledger

    monkeypatch.setattr(ledger, "MAX_LEVEL", 4)
    for hi in (300, 600, 600):
        ledger.append_by_ledger(rows(spark, 0, hi), f"{tmp}/coll", 2, bucket_ids=2)
    assert ledger.levels(spark, f"{tmp}/coll") == [4] and len([n for n in os.listdir(f"{tmp}/coll-ids/level=4") if n.startswith("bucket=")]) <= 16
    assert spark.read.parquet(f"{tmp}/coll").select("chunk_id").distinct().count() == 600 == spark.read.parquet(f"{tmp}/coll").count()


def test_documents_ingested_again_get_no_vectors(spark, tmp, monkeypatch):
    from corpus_search.plans import ingest

    made = []
    cut = ingest.cut_lineage
    monkeypatch.setattr(ingest, "cut_lineage", lambda df, name="cut": made.append(cut(df, name)) or made[-1])
    docs = spark.createDataFrame([(i, "s", f"word{i} word{i % 3} " * 90) for i in range(20)], "doc_id long, source string, text string")
    cents = ingest.ingest(docs.limit(15), f"{tmp}/coll", nlist=4)
    n = made[-1].count()
    ingest.ingest(docs, f"{tmp}/coll", centroids=cents)
    assert n > 15 and 0 < made[-1].count() < n  # of the other five only
    assert spark.read.parquet(f"{tmp}/coll").select("doc_id").distinct().count() == 20


def test_a_sink_of_many_batches_is_read_with_the_sessions_settings(spark, tmp):
    import os

    from corpus_search.streaming import jobs

    os.makedirs(f"{tmp}/in/a")
    for i in range(24):
        with open(f"{tmp}/in/a/{i}.txt", "w") as f:
            f.write(f"text {i}")
    jobs.stream_ingest(spark, f"{tmp}/in/*/*.txt", f"{tmp}/sink", f"{tmp}/ckpt", max_files_per_trigger=2, watermark="1 day")
    assert spark.read.parquet(f"{tmp}/sink").count() == 24
