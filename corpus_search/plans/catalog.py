"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables under ``sf_dir`` (or files Spark derives from them) and
runs over whole tables. Output columns carry the same names as the matching oracle SQL in
:mod:`corpus_search.plans.oracle`; integers are BIGINT and doubles are rounded to 6 places
where an engine-independent comparison needs it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.functions import paths as P
from corpus_search.functions import text as T
from corpus_search.functions import vectors as V
from corpus_search.operators import chunking, context, dedup, embedding, images, ivf, knn, metrics, ordered, postings, prompts, pruned, rerank, segments, stats, training
from corpus_search.plans import ingest, retrieval
from corpus_search.session import cut_lineage, scratch_path, ship_package, table
from corpus_search.sinks import collections, ledger, objects
from corpus_search.sources import documents, files
from corpus_search.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)  # executor-side code must be importable in the workers
            return fn(spark, sf)

        QUERIES[name] = run
        return fn

    return deco


# ----------------------------------------------------------------------------- retrieval


@register("retrieve_context")
def q_retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    """U2 flagship: every benchmark question -> top-5 chunks -> ordered, truncated context."""
    out = retrieval.retrieve_context(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=5)
    return out.select("query_id", "context", "n_chunks", F.round("top_score", 6).alias("top_score"), "context_tokens", "truncated")


@register("knn_with_text")
def q_knn_with_text(spark: SparkSession, sf: str) -> DataFrame:
    """Hits searched on (id, vector), text joined by id afterwards."""
    return retrieval.knn_with_text(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=5)


# ----------------------------------------------------------------------------- chunking


def _chunks(spark: SparkSession, sf: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return retrieval.chunk_documents(table(spark, sf, "documents"), size, overlap)


@register("chunk_fixed")
def q_chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """1000/200 character windows over every document."""
    return _chunks(spark, sf).select("doc_id", "source", "chunk_index", "start", "text")


@register("chunk_metadata")
def q_chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """P5: source and position metadata of every chunk."""
    return chunking.chunk_metadata(_chunks(spark, sf))


@register("chunk_ids")
def q_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic chunk ids md5(doc:chunk_index)."""
    return _chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index")


@register("chunk_tokens")
def q_chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """508-token windows with 200 tokens overlap."""
    return chunking.chunk_tokens(table(spark, sf, "documents"))


@register("length_guard")
def q_length_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents over 16384 characters cut into 16000-character slices."""
    docs = table(spark, sf, "documents")
    return chunking.length_guard(docs, limit=16384, slice_size=16000).withColumn("n_chars", T.n_chars("text"))


@register("nonblank_queries")
def q_nonblank_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with blank ones skipped."""
    return retrieval.question_table(table(spark, sf, "benchmark"))


# ----------------------------------------------------------------------------- documents


@register("route_by_extension")
def q_route_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    """Reader format and status from the URL's extension."""
    return documents.route_by_extension(table(spark, sf, "pages"), "url").select("page_id", "extension", "format", "status")


@register("status_counts")
def q_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs per (format, status)."""
    return stats.status_counts(documents.route_by_extension(table(spark, sf, "pages"), "url"))


@register("extract_page_text")
def q_extract_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text and title of every HTML page."""
    return documents.extract_page_text(table(spark, sf, "pages"))


@register("assemble_pages")
def q_assemble_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents split into a page table (one line = one page) and assembled back."""
    pages = documents.split_pages(table(spark, sf, "documents"))
    return documents.assemble_pages(pages)


@register("rows_to_text")
def q_rows_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every order row as a tab-joined text line (null -> '')."""
    orders = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return documents.rows_to_text(orders, cols, keep=["o_orderkey"])


@register("object_names")
def q_object_names(spark: SparkSession, sf: str) -> DataFrame:
    """base name, parent folder and extension of each page's object key."""
    k = P.key("url")
    return table(spark, sf, "pages").select(
        "page_id", k.alias("key"), P.basename(k).alias("basename"), P.parent(k).alias("parent"), P.extension(k).alias("extension")
    )


@register("parse_object_uri")
def q_parse_object_uri(spark: SparkSession, sf: str) -> DataFrame:
    """scheme / authority (bucket) / key of each URI."""
    return table(spark, sf, "pages").select(
        "page_id", P.scheme("url").alias("scheme"), P.authority("url").alias("bucket"), P.key("url").alias("key")
    )


# ----------------------------------------------------------------------------- dedup and stats


@register("exact_dedup")
def q_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A5: exact-duplicate groups by content md5."""
    return dedup.exact_dedup(table(spark, sf, "documents"))


@register("dedup_against_seen")
def q_dedup_against_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose content is not among the already reviewed (labelled) documents."""
    docs = table(spark, sf, "documents")
    seen = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(F.md5("text").alias("md5"))
    return dedup.dedup_against_seen(docs, seen).select("doc_id", "md5")


@register("collection_stats")
def q_collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, documents and chunk lengths per source."""
    return stats.collection_stats(_chunks(spark, sf))


# ----------------------------------------------------------------------------- vectors

IVF_NLIST = 16
IVF_NPROBE = 4


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _self_queries(vecs: DataFrame) -> DataFrame:
    return vecs.select(F.col("vec_id").alias("query_id"), "embedding")


def _hits_out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register("knn_exact")
def q_knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's 5 exact nearest neighbours (squared L2), ranked, scored."""
    v = _vectors(spark, sf)
    return _hits_out(knn.knn(_self_queries(v), v, 5))


@register("knn_exact_blocked")
def q_knn_exact_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """J1 with the co-grouped block strategy (the path for query tables too big to broadcast)."""
    v = _vectors(spark, sf)
    return _hits_out(knn.knn(_self_queries(v), v, 5, strategy="blocked", query_block=128, vector_block=128))


def _ivf_cells(v: DataFrame):
    cents = ivf.sample_centroids(v, IVF_NLIST)
    return cents, ivf.assign_cells(v, cents)


@register("ivf_build")
def q_ivf_build(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled centroids (first 16 by md5(id)) and every vector's cell."""
    v = _vectors(spark, sf)
    _, cells = _ivf_cells(v)
    return cells.select("vec_id", "cell_id")


@register("knn_ivf")
def q_knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Probe the 4 nearest of 16 cells, top-5 inside them (broadcast strategy)."""
    v = _vectors(spark, sf)
    cents, cells = _ivf_cells(v)
    return _hits_out(ivf.knn_ivf(_self_queries(v), cells, cents, 5, IVF_NPROBE))


@register("knn_ivf_blocked")
def q_knn_ivf_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """J2 with per-cell co-grouped blocks (many-query strategy); equals knn_ivf."""
    v = _vectors(spark, sf)
    cents, cells = _ivf_cells(v)
    hits = ivf.knn_ivf(_self_queries(v), cells, cents, 5, IVF_NPROBE, strategy="blocked", query_block=64, vector_block=64)
    return _hits_out(hits)


@register("ivf_recall")
def q_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """recall@5 of the index against exact search for nprobe 1, 4 and 16 (= nlist).
    The index is built and written once, then searched three times; exact hits are
    materialised once (queries x 5 rows)."""
    v = _vectors(spark, sf)
    q = _self_queries(v)
    exact = cut_lineage(knn.knn(q, v, 5), "exact-hits")
    cents, cells = _ivf_cells(v)
    cents = cut_lineage(cents, "centroids")
    path = scratch_path(spark, "ivf-index")
    ivf.write_index(cells, path)
    stored = spark.read.parquet(path)
    out = None
    for nprobe in (1, IVF_NPROBE, IVF_NLIST):
        r = ivf.recall_at_k(ivf.knn_ivf(q, stored, cents, 5, nprobe), exact, 5).withColumn("nprobe", F.lit(nprobe).cast("bigint"))
        out = r if out is None else out.unionByName(r)
    return out


#: Bytes of means that are broadcast.
MAX_BROADCAST_MEANS = 64 << 20


def _label_means(v: DataFrame) -> DataFrame:
    """Mean vector per label, materialised (one row per label) and broadcast when their
    bytes are bounded: joining on label would otherwise put a label holding a third of the
    vectors on one task."""
    means = cut_lineage(V.mean_vectors(v, "label").select("label", "mean"), "label-means")
    size = means.agg(F.sum(8 * F.size("mean") + 64)).first()[0] or 0
    return F.broadcast(means) if size <= MAX_BROADCAST_MEANS else means


@register("vector_distance")
def q_vector_distance(spark: SparkSession, sf: str) -> DataFrame:
    """L2 (squared and root) from every vector to its label's mean vector."""
    v = _vectors(spark, sf)
    j = v.join(_label_means(v), "label")
    return j.select(
        "vec_id", "label",
        F.round(V.l2_squared("embedding", "mean"), 6).alias("l2_squared"),
        F.round(V.l2("embedding", "mean"), 6).alias("l2"),
    )


@register("vector_similarity")
def q_vector_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """F8: cosine similarity and inner product with the label's mean vector."""
    v = _vectors(spark, sf)
    j = v.join(_label_means(v), "label")
    return j.select(
        "vec_id", "label",
        F.round(V.cosine("embedding", "mean"), 6).alias("cosine"),
        F.round(V.dot("embedding", "mean"), 6).alias("inner_product"),
    )


@register("split_batches")
def q_split_batches(spark: SparkSession, sf: str) -> DataFrame:
    """M3: md5-hash train/test split (1 fold of 5 held out) and batch numbers of 64 rows."""
    return training.split_batches(_vectors(spark, sf)).select("vec_id", "label", "split", "batch")


@register("classifier_accuracy")
def q_classifier_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-class-mean classifier trained on the train split, accuracy on test."""
    parts = training.split_batches(_vectors(spark, sf))
    train = parts.filter(F.col("split") == "train")
    test = parts.filter(F.col("split") == "test")
    return training.accuracy(training.nearest_centroid(train, test))


@register("embed_hash")
def q_embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed bag-of-words embedding of every document, summarised per vector."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vecs = embedding.embed_hashed(docs, dims=embedding.HASH_DIMS, keep=["doc_id", "text"])
    return embedding.embedding_fingerprint(vecs, "doc_id")


@register("train_classifier")
def q_train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax classifier, 10 epochs chained, loss per epoch, checkpoint every 2."""
    parts = training.split_batches(_vectors(spark, sf))
    ckpt = scratch_path(spark, "classifier")
    _, epochs = training.train_classifier(
        parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test"), n_classes=10, checkpoint_dir=ckpt
    )
    return epochs


# ----------------------------------------------------------------------------- history, prompts, replies


def _conv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@register("history_numbered")
def q_history_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Turns numbered from 1 within each conversation."""
    return prompts.number_turns(_conv(spark, sf)).select("conv_id", "turn", "role", "turn_no")


@register("history_text")
def q_history_text(spark: SparkSession, sf: str) -> DataFrame:
    """A4: 'User: q Bot: a' pairs (user turn + the assistant turn right after) per conversation."""
    return prompts.history_text(prompts.history_pairs(_conv(spark, sf)))


@register("history_before_turn")
def q_history_before_turn(spark: SparkSession, sf: str) -> DataFrame:
    """For every turn, the history completed before it."""
    return prompts.history_before(_conv(spark, sf))


def _prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    ctx = retrieval.retrieve_context(docs, bench, k=5).select("query_id", "context")
    hist = prompts.history_text(prompts.history_pairs(_conv(spark, sf))).select(F.col("conv_id").alias("query_id"), "history")
    return prompts.build_prompts(retrieval.question_table(bench), ctx, hist)


@register("build_prompts")
def q_build_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Question + retrieved context + the session's history -> system and user messages."""
    return _prompt_rows(spark, sf).select("query_id", "system", "user", F.size("messages").cast("bigint").alias("n_messages"))


@register("request_payloads")
def q_request_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """chat request JSON per prompt, checked by reading its fields back."""
    p = F.col("payload")
    settings = {"temperature": 0.2, "top_k": 40, "top_p": 0.9, "max_tokens": 512, "stream": None, "stop": ["@@@@"]}
    return prompts.request_payloads(_prompt_rows(spark, sf), model="generator", settings=settings).select(
        "query_id",
        F.get_json_object(p, "$.model").alias("model"),
        F.get_json_object(p, "$.messages[0].role").alias("first_role"),
        F.get_json_object(p, "$.messages[1].content").alias("user"),
        F.get_json_object(p, "$.temperature").cast("double").alias("temperature"),
        F.get_json_object(p, "$.top_p").cast("double").alias("top_p"),
        F.get_json_object(p, "$.top_k").cast("bigint").alias("top_k"),
        F.get_json_object(p, "$.max_tokens").cast("bigint").alias("max_tokens"),
        F.get_json_object(p, "$.stop[0]").alias("stop"),
        F.get_json_object(p, "$.stream").isNull().alias("no_stream"),
    )


@register("answer_prompts")
def q_answer_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Pluggable generator over prompt batches (deterministic extractive stand-in)."""
    return prompts.answer_prompts(_prompt_rows(spark, sf), prompts.extractive_generator)


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Reply table derived from conversations: assistant turns are 200 replies with content,
    system turns 200 replies without choices, user turns 500 errors."""
    c = _conv(spark, sf)
    ok_body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))).alias("choices")))
    empty_body = F.lit('{"choices":[]}')
    err_body = F.to_json(F.struct(F.struct(F.concat(F.lit("no answer for role "), F.col("role")).alias("message")).alias("error")))
    status = F.when(F.col("role") == "user", 500).otherwise(200)
    body = F.when(F.col("role") == "assistant", ok_body).when(F.col("role") == "user", err_body).otherwise(empty_body)
    return c.select("conv_id", "turn", status.alias("status"), body.alias("body"))


@register("parse_replies")
def q_parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    """answer text from JSON replies; error body passed through otherwise."""
    return prompts.parse_replies(_replies(spark, sf)).select("conv_id", "turn", "status", "answer", "ok")


@register("parse_stream_lines")
def q_parse_stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    """every turn as streamed 'data: ' lines (plus a broken line) reassembled."""
    return prompts.parse_stream(prompts.stream_lines(_conv(spark, sf)))


@register("context_text")
def q_context_text(spark: SparkSession, sf: str) -> DataFrame:
    """A3: top-5 chunk texts per question joined by a blank line in rank order."""
    hits = retrieval.knn_with_text(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=5)
    return context.context_text(hits)


@register("truncate_context")
def q_truncate_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut to its first 1024 space-separated tokens (+ flag)."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("context"))
    return context.truncate_tokens(docs, "context", 1024)


@register("retrieve_stored")
def q_retrieve_stored(spark: SparkSession, sf: str) -> DataFrame:
    """U2 from K1/J2: the documents ingested twice (the second time adds nothing), then every question
    searched in the stored collection, all cells probed, so that the exact search must agree."""
    docs, path = table(spark, sf, "documents"), scratch_path(spark, "stored-collection")
    cents = ingest.ingest(docs, path, nlist=IVF_NLIST)
    ingest.ingest(docs, path, centroids=cents)
    hits = ingest.retrieve_stored(spark, path, cents, table(spark, sf, "benchmark"), k=5, nprobe=IVF_NLIST)
    return hits.select(
        "query_id", "rank", F.col("vec_id").alias("chunk_id"), "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"),
        F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "text",
    )


@register("rerank_bm25")
def q_rerank_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """50 kNN candidates per question -> BM25 rerank -> top 10 -> top 5."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    hits, chunks = retrieval.search_chunks(docs, bench, k=rerank.CANDIDATES)
    hits = cut_lineage(hits, "rerank-candidates")  # questions x 50 rows, read three times below
    scores = rerank.bm25_scores(hits, retrieval.question_table(bench), chunks)
    out = rerank.rerank(hits, scores)
    return out.select(
        "query_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("knn_rank"), "rerank_rank",
        F.round("rerank_score", 6).alias("rerank_score"),
    )


# ----------------------------------------------------------------------------- metrics


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stage_calls(table(spark, sf, "events"))


@register("stage_metrics")
def q_stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A1: per stage calls, total/avg time, bytes, MB."""
    return metrics.stage_metrics(_calls(spark, sf)).drop("mb_per_s")


@register("stage_throughput")
def q_stage_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """A2: MB/s per stage, 0 when time or bytes is 0."""
    return metrics.stage_metrics(_calls(spark, sf)).select("stage", "mb_per_s")


@register("stage_running_totals")
def q_stage_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Running calls/time/bytes per stage after each call (time-bucketed prefix sums)."""
    out = metrics.stage_running(_calls(spark, sf), rows_per_bucket=500)
    return out.select(
        "call_id", "stage", "running_calls", F.round("running_time", 6).alias("running_time"),
        F.col("running_bytes").cast("bigint").alias("running_bytes"),
        F.round("running_mb_per_s", 6).alias("running_mb_per_s"),
    )


@register("step_elapsed")
def q_step_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since the same user's previous step (bucketed lag)."""
    out = metrics.step_elapsed(_calls(spark, sf), rows_per_bucket=500)
    return out.select("call_id", "user_id", "stage", F.col("prev_stage"), F.round("since_prev_s", 6).alias("since_prev_s"))


@register("ordered_nulls")
def q_ordered_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals and previous rows with null keys, times and values, and an outlying time."""
    e = table(spark, sf, "events")
    rows = e.select(
        "event_id", F.when(F.col("user_id") % 7 != 0, F.col("event_type")).alias("k"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") == 5, F.lit(10**12)).otherwise(F.col("event_id") / 4).cast("bigint").alias("t"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("v"),
    )
    totals = ordered.running_totals(rows, "k", "t", "event_id", {"total": F.col("v")}, count_out="n", rows_per_bucket=700)
    out = ordered.previous_row(totals, "k", "t", "event_id", ["event_id"], rows_per_bucket=700)
    none = F.lit(-1)  # nulls as -1: the comparison keeps whole numbers whole
    return out.select(
        "event_id", F.coalesce("k", F.lit("none")).alias("k"), F.coalesce("t", none).alias("t"), "n",
        F.coalesce("total", none).alias("total"), F.coalesce("prev_event_id", none).alias("prev"),
    )


@register("bytes_lookup")
def q_bytes_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases record their own size; other calls fall back to the user's recorded
    listing size (largest 'view' size), else 0."""
    calls = _calls(spark, sf).withColumn("own_bytes", F.when(F.col("stage") == "purchase", F.col("bytes")))
    listing = calls.filter(F.col("stage") == "view").groupBy("user_id").agg(F.max("bytes").alias("size"))
    return metrics.bytes_lookup(calls, listing, "user_id").select("call_id", "user_id", "stage", "bytes")


@register("metrics_report")
def q_metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    """two-decimal report lines (time, MB, MB/s)."""
    return metrics.metrics_report(metrics.stage_metrics(_calls(spark, sf)))


@register("write_metrics_csv")
def q_write_metrics_csv(spark: SparkSession, sf: str) -> DataFrame:
    """K4: append the report to CSV (header) twice and read it back: two rows per stage."""
    path = scratch_path(spark, "metrics-csv")
    report = metrics.metrics_report(metrics.stage_metrics(_calls(spark, sf)))
    metrics.write_report_csv(report, path)
    metrics.write_report_csv(report, path)
    return spark.read.option("header", True).csv(path)


# ----------------------------------------------------------------------------- files and collections


def _text_tree(spark: SparkSession, sf: str) -> str:
    """Documents written as <source>/<doc_id>.txt files in a fresh shared scratch folder."""
    root = scratch_path(spark, "text-tree")
    files.write_text_files(table(spark, sf, "documents"), root)
    return root


def _doc_id_from_path(c: str = "path") -> F.Column:
    return F.regexp_extract(F.col(c), r"/([0-9]+)\.txt$", 1).cast("bigint")


@register("list_objects")
def q_list_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive listing of the table folder (path, length, modification time)."""
    return files.list_objects(spark, sf)


@register("scan_binary")
def q_scan_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and md5 of every object under the table folder."""
    return files.scan_binary(spark, sf, content=False)


@register("scan_text")
def q_scan_text(spark: SparkSession, sf: str) -> DataFrame:
    """S3: documents written as text files, read back whole and stripped."""
    t = files.scan_text(spark, _text_tree(spark, sf))
    return t.select(_doc_id_from_path().alias("doc_id"), "text", "status")


@register("replicate_objects")
def q_replicate_objects(spark: SparkSession, sf: str) -> DataFrame:
    """K3: copy a text tree to a second folder; one row per object with its byte count."""
    src = _text_tree(spark, sf)
    out = objects.replicate_objects(spark, src, scratch_path(spark, "replica"))
    return out.select(_doc_id_from_path("target").alias("doc_id"), "bytes")


def _collection_rows(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    return embedding.embed_hashed(chunks, dims=embedding.HASH_DIMS, dtype="float", keep=["chunk_id", "doc_id", "source", "chunk_index", "text"])


@register("append_collection")
def q_append_collection(spark: SparkSession, sf: str) -> DataFrame:
    """K1: chunks + vectors + IVF cell appended twice, partitioned by cell; the second append
    adds nothing (anti-join on id)."""
    from pyspark.sql.types import LongType, StructField

    path = scratch_path(spark, "collection")
    rows = _collection_rows(spark, sf)
    cents = ivf.sample_centroids(rows, IVF_NLIST, id_col="chunk_id")
    cells = ivf.assign_cells(rows, cents)
    schema = collections.collection_schema(embedding.HASH_DIMS, extra=[StructField("cell_id", LongType(), True)])
    for _ in range(2):
        collections.append_collection(cells, path, embedding.HASH_DIMS, schema=schema, partition_by="cell_id")
    return spark.read.parquet(path).select("chunk_id", "doc_id", "chunk_index")


@register("recreate_collection")
def q_recreate_collection(spark: SparkSession, sf: str) -> DataFrame:
    """K2: drop-and-recreate with the declared schema and width check (run twice)."""
    path = scratch_path(spark, "collection")
    rows = _collection_rows(spark, sf)
    collections.recreate_collection(rows, path, embedding.HASH_DIMS)
    collections.recreate_collection(rows, path, embedding.HASH_DIMS)
    return spark.read.parquet(path).select("chunk_id", "doc_id", "chunk_index")


@register("collection_count")
def q_collection_count(spark: SparkSession, sf: str) -> DataFrame:
    """Stored collection row count."""
    path = scratch_path(spark, "collection")
    collections.append_collection(_collection_rows(spark, sf), path, embedding.HASH_DIMS)
    return collections.collection_count(spark, path)


def _image_tree(spark: SparkSession, sf: str) -> str:
    root = scratch_path(spark, "images")
    files.vectors_as_images(_vectors(spark, sf), root)
    return root


def _vec_id_from_name(c: str = "origin") -> F.Column:
    return F.regexp_extract(F.col(c), r"/([0-9]+)\.[^/]*$", 1).cast("bigint")


@register("scan_images")
def q_scan_images(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector rendered as an 8x8 PNG and read back with the image source."""
    imgs = files.scan_images(spark, _image_tree(spark, sf))
    return imgs.select(
        _vec_id_from_name("image.origin").alias("vec_id"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"),
    )


@register("image_labels")
def q_image_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P10: label parsed from the file name's second dot-part."""
    labels = images.image_labels(files.scan_images(spark, _image_tree(spark, sf)))
    return labels.select(_vec_id_from_name().alias("vec_id"), "label")


@register("image_normalize")
def q_image_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """resize to 224x224, RGB, scale and standardise; per-channel means and tensor size."""
    norm = images.image_normalize(files.scan_images(spark, _image_tree(spark, sf)))
    return norm.select(
        _vec_id_from_name().alias("vec_id"),
        F.round("mean_r", 6).alias("mean_r"), F.round("mean_g", 6).alias("mean_g"), F.round("mean_b", 6).alias("mean_b"),
        F.size("pixels").cast("bigint").alias("n_values"),
    )


@register("save_checkpoints")
def q_save_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """K5: checkpoints written every 2nd epoch during training, listed from the store."""
    parts = training.split_batches(_vectors(spark, sf))
    ckpt = scratch_path(spark, "checkpoints")
    training.train_classifier(
        parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test"), n_classes=10, checkpoint_dir=ckpt
    )
    listed = files.list_objects(spark, ckpt)
    return listed.select(F.regexp_extract("path", r"epoch=([0-9]+)", 1).cast("int").alias("epoch")).groupBy("epoch").agg(
        F.count("*").cast("bigint").alias("n_files")
    )


@register("chunk_recursive")
def q_chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Separator-aware recursive chunks (500/50) of every document."""
    out = chunking.chunk_recursive(table(spark, sf, "documents"), size=500, overlap=50, separators=chunking.PDF_SEPARATORS)
    return out.withColumn("n_chars", T.n_chars("text"))


@register("chunk_recursive_faults")
def q_chunk_recursive_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, chunks that are too long, blank, or no part of the text (there are none)."""
    docs = table(spark, sf, "documents").filter(~T.is_blank("text"))
    out = chunking.chunk_recursive(docs, separators=chunking.PDF_SEPARATORS, keep=("doc_id", "text"), lists=True).where(F.size("chunks") > 0)

    def count(fault):
        return F.sum(F.size(F.filter("chunks", fault)).cast("bigint"))

    return out.groupBy("doc_id").agg(
        count(lambda c: F.length(c) > 500).alias("too_long"), count(lambda c: T.is_blank(c)).alias("blank"), count(lambda c: ~F.contains(F.col("text"), c)).alias("foreign")
    )


@register("chunk_bulk")
def q_chunk_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """P1/P4, the bulk flow: 40000/500 windows, then texts over 65535 characters cut into 65000."""
    chunks = chunking.chunk_fixed(table(spark, sf, "documents"), size=chunking.BULK_CHUNK[0], overlap=chunking.BULK_CHUNK[1])
    out = chunking.length_guard(chunks, keep=("doc_id", "chunk_index"))
    return out.select("doc_id", "chunk_index", "piece", F.md5("text").alias("text_md5"), T.n_chars("text").alias("n_chars"))


@register("sheet_text")
def q_sheet_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's nations as the text of a sheet, a line a row."""
    nation = table(spark, sf, "nation")
    lines = documents.rows_to_text(nation, ["n_nationkey", "n_name"], keep=["n_regionkey", "n_nationkey"])
    return documents.sheet_text(lines, "n_regionkey", "n_nationkey")


# ----------------------------------------------------------------------------- streaming


@register("stream_ingest")
def q_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental file ingest (200 files per micro-batch), content md5, duplicates dropped;
    a second run over the same folder adds nothing."""
    root = _text_tree(spark, sf)
    sink, ckpt = scratch_path(spark, "ingest-sink"), scratch_path(spark, "ingest-ckpt")
    jobs.stream_ingest(spark, f"{root}/*/*.txt", sink, ckpt, max_files_per_trigger=200, watermark="1 day")
    jobs.stream_ingest(spark, f"{root}/*/*.txt", sink, ckpt, max_files_per_trigger=200, watermark="1 day")
    return spark.read.parquet(sink).select("md5", "length")


@register("stream_index")
def q_stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """R2: per micro-batch chunk + embed + cell assignment, written under batch_id (idempotent)."""
    root = _text_tree(spark, sf)
    cents = cut_lineage(ivf.sample_centroids(_collection_rows(spark, sf), IVF_NLIST, id_col="chunk_id"), "centroids")
    coll, ckpt = scratch_path(spark, "stream-collection"), scratch_path(spark, "index-ckpt")
    jobs.stream_index(spark, root, f"{root}/*/*.txt", coll, ckpt, cents, max_files_per_trigger=250)
    return spark.read.parquet(coll).select(
        "chunk_id", "source", "chunk_index", F.md5("text").alias("text_md5"), F.size("embedding").cast("bigint").alias("width"),
        F.col("cell_id").isNotNull().alias("has_cell"),
    )


@register("stream_stage_metrics")
def q_stream_stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-stage metrics maintained by a streaming aggregation over 4 event files."""
    events = table(spark, sf, "events")
    src = scratch_path(spark, "events-stream")
    events.repartition(4).write.parquet(src)
    sink, ckpt = scratch_path(spark, "stage-sink"), scratch_path(spark, "stage-ckpt")
    jobs.stream_stage_metrics(spark, src, sink, ckpt, events.schema)
    return jobs.stage_metrics_from_totals(jobs.latest_batch(spark, sink))


@register("stream_history")
def q_stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """Turns arrive in any order and wait in state for the watermark; the texts made of the stream's
    output are those of the batch twin."""
    turns, pairs = _streamed_turns(spark, sf)
    return prompts.expand_history(turns, pairs).select("conv_id", "turn", "role", "history", "n_pairs")


@register("stream_turns")
def q_stream_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The linear output of the same stream: how many pairs and characters lie before each turn."""
    turns, _ = _streamed_turns(spark, sf)
    return turns


def _streamed_turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(turns, pairs) of a stream over a shuffled feed of eight files, a minute a turn, and its closing mark."""
    conv = _conv(spark, sf).withColumn("ts", F.timestamp_seconds(10**9 + F.col("turn") * 60))
    src, sink, ckpt = (scratch_path(spark, n) for n in ("turns-stream", "turns-sink", "turns-ckpt"))
    far = spark.range(1).select(*(F.lit(None).cast(conv.schema[c].dataType).alias(c) for c in conv.columns[:-1]), F.timestamp_seconds(F.lit(2 * 10**9)).alias("ts"))
    conv.repartition(8, F.xxhash64("conv_id", "turn")).write.parquet(f"{src}/feed=1")
    far.write.parquet(f"{src}/feed=2")
    # the feed is in no order at all, so the delay is the whole of its time
    jobs.stream_turns(spark, f"{src}/*", sink, ckpt, conv.schema, delay="1000 days")
    out = spark.read.parquet(sink)
    return out.select("conv_id", "turn", "role", "n_pairs", "history_chars"), out.where("pair is not null").select("conv_id", "pair_no", "start", "pair")


# ----------------------------------------------------------------------------- more operator variants


@register("epoch_loss")
def q_epoch_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cross-entropy per epoch of the softmax classifier (10 epochs, chained)."""
    parts = training.split_batches(_vectors(spark, sf))
    _, epochs = training.train_classifier(
        parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "test"), n_classes=10
    )
    return epochs.select("epoch", "loss")


@register("dedup_keep_first")
def q_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that survive exact deduplication (smallest id per content hash)."""
    return dedup.keep_first(table(spark, sf, "documents")).select("doc_id", "md5")


@register("ivf_kmeans_recall")
def q_ivf_kmeans_recall(spark: SparkSession, sf: str) -> DataFrame:
    """KMeans centroids (16 cells, Spark ML) and recall@5 of a 4-probe search."""
    v = _vectors(spark, sf)
    q = _self_queries(v)
    cents = ivf.kmeans_centroids(v, IVF_NLIST, seed=42)
    cells = ivf.assign_cells(v, cents)
    hits = ivf.knn_ivf(q, cells, cents, 5, IVF_NPROBE)
    return ivf.recall_at_k(hits, knn.knn(q, v, 5), 5).withColumn("nprobe", F.lit(IVF_NPROBE).cast("bigint"))


@register("stream_window_metrics")
def q_stream_window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """R3 (event time): daily per-stage metrics with a 1-hour watermark (update mode). Events
    arrive in four quarters in time order; the latest update of every window is its value."""
    events = table(spark, sf, "events")
    src = scratch_path(spark, "events-by-time")
    ts = F.col("ts").cast("timestamp")
    bounds = events.select(F.percentile_approx(F.unix_micros(ts), [0.25, 0.5, 0.75], 10000).alias("q")).collect()[0]["q"]
    edges = [None, *bounds, None]
    for lo, hi in zip(edges[:-1], edges[1:]):  # four quarters in time order, each written by the tasks that read it
        part = events
        if lo is not None:
            part = part.filter(F.unix_micros(ts) > F.lit(lo))
        if hi is not None:
            part = part.filter(F.unix_micros(ts) <= F.lit(hi))
        part.write.mode("append").parquet(src)
    sink, ckpt = scratch_path(spark, "window-sink"), scratch_path(spark, "window-ckpt")
    jobs.stream_window_metrics(spark, src, sink, ckpt, events.schema)
    out = jobs.latest_windows(spark.read.parquet(sink))
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "stage", "calls", F.round("total_time", 6).alias("total_time")
    )


@register("knn_ivf_stored")
def q_knn_ivf_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The index written partitioned by cell (salted writers) and searched from
    storage; the probe becomes a partition filter on cell_id."""
    v = _vectors(spark, sf)
    cents, cells = _ivf_cells(v)
    path = scratch_path(spark, "ivf-index")
    ivf.write_index(cells, path)
    stored = spark.read.parquet(path)
    return _hits_out(ivf.knn_ivf(_self_queries(v), stored, cents, 5, IVF_NPROBE))


# ----------------------------------------------------------------------------- pruned and indexed search


@register("knn_pruned")
def q_knn_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """J1 through pivot cells and triangle-inequality bounds: every vector's 5 exact nearest neighbours."""
    v = _vectors(spark, sf)
    return _hits_out(pruned.knn_pruned(_self_queries(v), v, 5))


@register("ivf_tree")
def q_ivf_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The 4 nearest of 16 centroids of every vector, found through a two-level centroid tree."""
    v = _vectors(spark, sf)
    tree = pruned.CentroidTree.of(ivf.sample_centroids(v, IVF_NLIST))
    near = tree.nearest(v, IVF_NPROBE)
    return near.select("vec_id", F.col("cell_id").cast("bigint").alias("cell_id"), F.col("probe_rank").cast("bigint").alias("probe_rank"), F.round("distance", 6).alias("distance"))


def _term_index(spark: SparkSession, sf: str) -> postings.Index:
    path = scratch_path(spark, "term-index")
    postings.write_index(_chunks(spark, sf), path)
    return postings.Index(spark, path)


@register("bm25_search")
def q_bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best chunks of every question by BM25 over the whole collection, from the stored index."""
    hits = _term_index(spark, sf).search(retrieval.question_table(table(spark, sf, "benchmark")), 10).rows
    return hits.select("query_id", F.col("vec_id").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


@register("rerank_bm25_stored")
def q_rerank_bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    """T2 from the stored index: the same 50 -> 10 -> 5 as rerank_bm25, no chunk tokenised at query time."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    hits, _ = retrieval.search_chunks(docs, bench, k=rerank.CANDIDATES)
    hits = cut_lineage(hits, "rerank-candidates")
    scores = _term_index(spark, sf).scores(hits, retrieval.question_table(bench))
    return rerank.rerank(hits, scores).select(
        "query_id", F.col("vec_id").alias("chunk_id"), F.col("rank").alias("knn_rank"), "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"),
    )


@register("page_segments")
def q_page_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents assembled from their lines in numbered segments of about 4000 characters."""
    pages = documents.split_pages(table(spark, sf, "documents"))
    out = segments.joined_segments(pages, "doc_id", "page_no", "page_text", "\n", segment_chars=4000, rows_per_bucket=2000)
    return out.select("doc_id", "segment", "start", "n_values", "text")


@register("history_prefixes")
def q_history_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """W4 in linear space: pairs stored once, each turn a prefix of them, expanded for all turns."""
    turns, pairs = prompts.history_prefixes(_conv(spark, sf), rows_per_bucket=300)
    texts = prompts.expand_history(turns, pairs)
    return texts.join(turns.select("conv_id", "turn", "history_chars"), ["conv_id", "turn"]).select("conv_id", "turn", "role", "n_pairs", "history_chars", "segment", "history")


# ----------------------------------------------------------------------------- files to answers


def _mixed_tree(spark: SparkSession, sf: str) -> str:
    """Documents as text files, and pages as files with their URL's extension."""
    root = _text_tree(spark, sf)
    pages = table(spark, sf, "pages")
    ext = P.extension(P.key("url"))
    rel = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.when(F.coalesce(ext, F.lit("")) != "", F.concat(F.lit("."), ext)).otherwise(F.lit("")))
    files.materialise(files.write_files(pages.select(rel.alias("rel"), "html"), root, "rel", "html"))
    return root


@register("file_statuses")
def q_file_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """How many files were read, blank, broken or of no readable kind."""
    return stats.status_counts(ingest.read_files(spark, _mixed_tree(spark, sf)))


@register("answer_from_files")
def q_answer_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """U2 whole: files -> statuses -> collection and inverted index; then the last user turn of every
    conversation -> 50 nearest in 4 of 16 cells -> BM25 from the index -> context -> prompt with its session's history."""
    root, path = _text_tree(spark, sf), scratch_path(spark, "answers-collection")
    _, cents = ingest.ingest_files(spark, root, path, doc_id=_doc_id_from_path(), nlist=IVF_NLIST)
    asked, histories = _last_questions(spark, sf)
    out = ingest.answer_stored(spark, path, cents, asked, histories, nprobe=IVF_NPROBE)
    return out.select("query_id", "user")


def _last_questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The last user turn of every conversation as a question, and the history before it, by the conversation's id."""
    conv = _conv(spark, sf)
    last = conv.where(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))
    last = cut_lineage(last.where(~T.is_blank("question")), "last-questions")
    turns, pairs = prompts.history_prefixes(conv)
    asked = turns.join(last.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    texts = prompts.expand_history(asked, pairs).groupBy("conv_id").agg(context.ordered_join(F.col("segment"), F.col("history"), " ").alias("history"))
    return last.select(F.col("conv_id").alias("query_id"), "question"), texts.select(F.col("conv_id").alias("query_id"), "history")


# ----------------------------------------------------------------------------- training by mini-batches


@register("train_adam")
def q_train_adam(spark: SparkSession, sf: str) -> DataFrame:
    """The softmax layer by mini-batches of about 64 with Adam at 0.001, loss per epoch, checkpoint every 2."""
    train = training.split_batches(_vectors(spark, sf)).where("split = 'train'")
    _, epochs = training.train_adam(train, 10, checkpoint_dir=scratch_path(spark, "adam"))
    return epochs.select("epoch", F.round("loss", 6).alias("loss"), F.col("checkpoint").isNotNull().alias("saved"))


@register("image_classifier")
def q_image_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Images read, filtered and pooled, the layer trained on four fifths and judged on the rest."""
    scanned = files.scan_images(spark, _image_tree(spark, sf))
    found = images.image_features(scanned, size=16, grid=4).join(images.image_labels(scanned), "origin")
    vec_id = F.regexp_extract("name", r"^([0-9]+)", 1).cast("bigint")
    parts = training.split_batches(cut_lineage(found.select(vec_id.alias("vec_id"), F.col("features").alias("embedding"), "label"), "image-features"))
    layer, _ = training.train_adam(parts.where("split = 'train'"), 10, epochs=5)
    return training.accuracy(training.predict(parts.where("split = 'test'"), layer))


# ----------------------------------------------------------------------------- trees and their contents


@register("list_tree")
def q_list_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of the documents listed, empty ones too: name below the root and length."""
    root = _text_tree(spark, sf)
    return files.list_objects(spark, root).select(F.regexp_extract("path", r"([^/]*/[0-9]+[.]txt)$", 1).alias("name"), F.col("length").cast("bigint").alias("length"))


@register("scan_tree_md5")
def q_scan_tree_md5(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of the same tree: length and md5 of every object."""
    return files.scan_binary(spark, _text_tree(spark, sf), content=False).select(_doc_id_from_path().alias("doc_id"), F.col("length").cast("bigint").alias("length"), "md5")


@register("stream_ingest_exact")
def q_stream_ingest_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Files in micro-batches of 300, contents of any earlier batch dropped by an anti-join; a second run adds nothing."""
    root = _text_tree(spark, sf)
    sink, ckpt = scratch_path(spark, "exact-sink"), scratch_path(spark, "exact-ckpt")
    for _ in range(2):
        jobs.stream_ingest_exact(spark, f"{root}/*/*.txt", sink, ckpt, max_files_per_trigger=300)
    return spark.read.parquet(sink).select("md5", "length")


@register("append_by_ledger")
def q_append_by_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the chunks appended in three overlapping batches, each looking its ids up in their buckets only."""
    path, rows = scratch_path(spark, "ledger-collection"), cut_lineage(_collection_rows(spark, sf), "ledger-rows")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(10))
    for batch in (rows.where(part < 6), rows.where(part >= 4), rows):
        ledger.append_by_ledger(batch, path, embedding.HASH_DIMS, bucket_ids=200)
    return spark.read.parquet(path).select("chunk_id", "doc_id", "chunk_index")


@register("replicate_ranges")
def q_replicate_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """K3: a text tree copied in ranges of 1000 bytes: bytes, ranges and the md5 of the first of each object."""
    out = objects.replicate_ranges(spark, _text_tree(spark, sf), scratch_path(spark, "range-replica"), range_bytes=1000)
    return out.select(_doc_id_from_path("target").alias("doc_id"), "bytes", F.size("digests").cast("bigint").alias("n_ranges"), F.when(F.size("digests") == 1, F.col("digests")[0]).alias("md5"))
