import os

from pyspark.sql import functions as F

from corpus_search.functions import paths as P
from corpus_search.operators import dedup, images
from corpus_search.sinks import collections, objects
from corpus_search.sources import documents, files


def _tree(root):
    os.makedirs(f"{root}/a/x", exist_ok=True)
    os.makedirs(f"{root}/b/x", exist_ok=True)
    with open(f"{root}/a/x/same.txt", "w") as f:
        f.write("  hello world \n")
    with open(f"{root}/b/x/same.txt", "w") as f:
        f.write("  hello world \n")
    with open(f"{root}/b/other.txt", "w") as f:
        f.write("another file")
    open(f"{root}/b/empty.txt", "w").close()
    with open(f"{root}/b/latin1.txt", "wb") as f:
        f.write("caf\xe9".encode("latin-1"))
    with open(f"{root}/b/data.bin", "wb") as f:
        f.write(b"\x00\x01")


def test_listing_prunes_content_and_has_empty_objects(spark, tmp):
    _tree(tmp)
    listed = files.list_objects(spark, tmp)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    names = sorted(os.path.relpath(p.replace("file:", ""), tmp) for p in [r.path for r in listed.collect()])
    assert names == ["a/x/same.txt", "b/data.bin", "b/empty.txt", "b/latin1.txt", "b/other.txt", "b/x/same.txt"]


def test_scan_text_and_dedup(spark, tmp):
    _tree(tmp)
    t = files.scan_text(spark, tmp)
    rows = {os.path.relpath(r.path.replace("file:", ""), tmp): (r.text, r.status) for r in t.collect()}
    assert rows["a/x/same.txt"] == ("hello world", "ok")
    assert rows["b/latin1.txt"] == (None, "error") and rows["b/empty.txt"] == ("", "empty")
    assert [r.status for r in files.scan_text(spark, f"{tmp}/nowhere").collect()] == ["error"]
    groups = dedup.exact_dedup(t.withColumn("doc_id", F.monotonically_increasing_id()), col="text").filter("n_copies = 2").count()
    assert groups == 1


def test_replicate_keeps_relative_paths_and_rerun_is_stable(spark, tmp):
    src, dst = f"{tmp}/src", f"{tmp}/dst"
    _tree(src)
    first = sorted((r.target, r.bytes) for r in objects.replicate_objects(spark, src, dst).collect())
    second = sorted((r.target, r.bytes) for r in objects.replicate_objects(spark, src, dst).collect())
    assert first == second
    assert os.path.exists(f"{dst}/a/x/same.txt") and os.path.exists(f"{dst}/b/x/same.txt")
    assert sorted(os.listdir(f"{dst}/b")) == ["data.bin", "empty.txt", "latin1.txt", "other.txt", "x"]


def test_replicate_from_a_file_uri_with_blanks_in_names(spark, tmp):
    src, dst = f"{tmp}/src dir", f"{tmp}/dst"
    os.makedirs(f"{src}/x")
    for name in ("x/a b.txt", "x/100%.txt", "top+.txt"):
        with open(f"{src}/{name}", "w") as f:
            f.write(name)
    got = objects.replicate_objects(spark, src, f"file://{dst}").collect()
    assert sorted(r.bytes for r in got) == sorted(len(n) for n in ("x/a b.txt", "x/100%.txt", "top+.txt"))
    assert open(f"{dst}/x/a b.txt").read() == "x/a b.txt" and open(f"{dst}/x/100%.txt").read() == "x/100%.txt"
    os.makedirs(f"{tmp}/plain/y")
    with open(f"{tmp}/plain/y/a.txt", "w") as f:
        f.write("a")
    assert [r.target for r in objects.replicate_objects(spark, f"file://{tmp}/plain", f"{tmp}/dst2").collect()] == [f"{tmp}/dst2/y/a.txt"]
    texts = {r.path for r in files.scan_text(spark, src).collect()}
    assert texts == {r.path for r in files.list_objects(spark, src).collect()}


def test_routing_and_paths(spark):
    df = spark.createDataFrame(
        [("s3://bkt/dir/Report.PDF",), ("https://h.example.org/a/b.html?x=1#y",), ("gs://b/noext",), ("s3://b/a.tar.gz",)], "url string"
    )
    out = documents.route_by_extension(df, "url").select("extension", "format", "status").collect()
    assert [tuple(r) for r in out] == [("pdf", "pdf", "ok"), ("html", "markup", "ok"), ("", None, "unsupported"), ("gz", None, "unsupported")]
    parts = df.select(P.scheme("url").alias("s"), P.authority("url").alias("a"), P.key("url").alias("k")).collect()
    assert tuple(parts[0]) == ("s3", "bkt", "dir/Report.PDF")
    assert tuple(parts[1]) == ("https", "h.example.org", "a/b.html")


def test_html_text(spark):
    html = "<html><head><title> T &amp; x </title><style>p{}</style><script>var a='<p>';</script></head><body><p>A&lt;b</p>\n<!-- c --><div>z&nbsp;y</div></body></html>"
    r = documents.extract_page_text(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()[0]
    assert r.title == "T &amp; x"
    assert r.text == "T & x A<b z y"


def test_pages_and_sheet(spark):
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, "  "), (2, 1, None)], "doc_id long, page_no long, page_text string")
    got = {r.doc_id: (r.n_pages, r.blank_pages, r.text) for r in documents.assemble_pages(pages).collect()}
    assert got == {1: (3, 1, "first\nsecond\n  "), 2: (1, 1, "")}
    sheet = spark.createDataFrame([(1, None, "a\tb", 2.5), (2, "x", None, None)], "r long, c1 string, c2 string, c3 double")
    lines = documents.rows_to_text(sheet, ["c1", "c2", "c3"], keep=["r"])
    txt = documents.sheet_text(lines.withColumn("sheet", F.lit(1)), "sheet", "r").collect()[0].text
    assert txt == "\ta\tb\t2.5\nx\t\t"


def test_images_labels_and_normalize(spark, tmp):
    import numpy as np

    red = np.zeros((4, 6, 3), np.uint8)
    red[:, :, 0] = 255
    with open(f"{tmp}/a.3.png", "wb") as f:
        f.write(files.png_bytes(red))
    with open(f"{tmp}/b.x.png", "wb") as f:
        f.write(files.png_bytes(red))
    with open(f"{tmp}/bad.1.png", "wb") as f:
        f.write(b"not a png")
    imgs = files.scan_images(spark, tmp)
    status = {r.name: (r.label, r.status) for r in images.label_status(imgs).collect()}
    assert status == {"a.3.png": (3, "ok"), "b.x.png": (None, "no_label"), "bad.1.png": (1, "undecodable")}
    assert [r.label for r in images.image_labels(imgs).collect()] == [3]
    norm = images.image_normalize(imgs, size=8).filter(F.col("origin").endswith("a.3.png")).collect()[0]
    assert len(norm.pixels) == 3 * 8 * 8
    assert norm.mean_r == __import__("pytest").approx((1 - 0.485) / 0.229, rel=1e-5)
    assert norm.mean_g == __import__("pytest").approx((0 - 0.456) / 0.224, rel=1e-5)


def test_collection_append_idempotent_and_width_check(spark, tmp):
    rows = spark.createDataFrame(
        [("a", 1, "s", 0, "t1", [0.1, 0.2]), ("b", 1, "s", 1, "t2", [0.3, 0.4])],
        "chunk_id string, doc_id long, source string, chunk_index int, text string, embedding array<float>",
    )
    path = f"{tmp}/coll"
    collections.append_collection(rows, path, 2)
    collections.append_collection(rows, path, 2)
    assert collections.collection_count(spark, path).collect()[0].n_rows == 2
    bad = rows.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    try:
        collections.recreate_collection(bad, f"{tmp}/c2", 2)
        raise AssertionError("width check did not fire")
    except Exception as e:  # noqa: BLE001 - raised from the executors inside the write job
        assert "vector width is not 2" in str(e)
    import os as _os

    assert not _os.path.exists(f"{tmp}/c2/_SUCCESS")


def test_pluggable_embedder_and_hashed_embedding(spark):
    import numpy as np

    from corpus_search.operators import embedding

    docs = spark.createDataFrame([(1, "Hello hello World"), (2, ""), (3, None)], "doc_id long, text string")

    def model(texts):
        return np.array([[len(t), t.count("l")] for t in texts], dtype=float)

    got = {r.doc_id: list(r.embedding) for r in embedding.embed_with(docs, model, dims=2, keep=["doc_id"]).collect()}
    assert got == {1: [17.0, 5.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    h = {r.doc_id: np.asarray(r.embedding) for r in embedding.embed_hashed(docs, dims=16, keep=["doc_id"]).collect()}
    assert abs(np.linalg.norm(h[1]) - 1.0) < 1e-12
    assert np.allclose(sorted(h[1][h[1] > 0] ** 2 * 5), [1.0, 4.0])
    assert not h[2].any() and not h[3].any()
    native = docs.select("doc_id", embedding.hash_buckets(F.col("text"), 16).alias("b")).collect()
    b1 = [r.b for r in native if r.doc_id == 1][0]
    assert sorted(set(b1)) == sorted(np.flatnonzero(h[1]).tolist())


def test_a_deep_tree_is_listed_level_by_level(spark, tmp, monkeypatch):
    import os

    from corpus_search.sources import files

    want = {}
    for i in range(30):
        folder = f"{tmp}/one/two/three/f{i % 6}/g{i}"
        os.makedirs(folder)
        for k in range(3):
            with open(f"{folder}/{k}.txt", "w") as f:
                f.write("x" * (i % 3))
            want[f"{folder}/{k}.txt"] = i % 3
    os.makedirs(f"{tmp}/one/hollow")
    monkeypatch.setattr(files, "LIST_ROWS", 2)
    found = files.walk(spark, f"{tmp}/one").where("is_file").collect()
    assert {r.path.removeprefix("file:"): r.length for r in found} == want
    listed = files.list_objects(spark, f"{tmp}/one").collect()
    assert {r.path.removeprefix("file:"): r.length for r in listed} == want
    assert files.walk(spark, f"{tmp}/nowhere").count() == 0


def test_large_objects_are_copied_in_ranges(spark, tmp):
    import hashlib
    import os

    from corpus_search.sinks import objects

    rnd = __import__("random").Random(1)
    blobs = {"a/big.bin": rnd.randbytes(2_500), "a/even.bin": rnd.randbytes(2_000), "small one+.txt": b"x", "none.txt": b""}
    for rel, data in blobs.items():
        os.makedirs(os.path.dirname(f"{tmp}/in/{rel}"), exist_ok=True)
        with open(f"{tmp}/in/{rel}", "wb") as f:
            f.write(data)
    for _ in range(2):  # again: the same
        got = {r.target.removeprefix(f"{tmp}/out/"): r for r in objects.replicate_ranges(spark, f"{tmp}/in", f"{tmp}/out", range_bytes=1000).collect()}
        assert set(got) == set(blobs)
        for rel, data in blobs.items():
            with open(f"{tmp}/out/{rel}", "rb") as f:
                assert hashlib.md5(f.read()).digest() == hashlib.md5(data).digest()
            assert got[rel].bytes == len(data) and got[rel].digests == [hashlib.md5(data[k : k + 1000]).hexdigest() for k in range(0, max(len(data), 1), 1000)]
        assert not [n for _, _, names in os.walk(f"{tmp}/out") for n in names if ".tmp-" in n]
    assert len(got["a/big.bin"].digests) == 3
