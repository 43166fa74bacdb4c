import random
import re

from pyspark.sql import functions as F

from corpus_search.llm import quality_rules as Q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def made():
    rnd = random.Random(9)
    bits = ["a", "b", "the", "ünï", "漢字", "#x", "\n", "\n", " ", "\t", "\x0b", "\x1c", " ", "😀", "$", "\r"]
    some = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.choice([0, 3, 20, 300]))) for _ in range(200)]
    return [*some, "", " ", "one two", "a b c a b c", "x " * 2000, "line one here\n" * 5 + "\n\n \n \n", " ".join(f"w{i}" for i in range(80))]


def test_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(made())] + [(None, None, 1), (2, "a b", 1), (2, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = Q.judge(docs, Q.fit(docs, labels))
    assert got.count() == len(rows)
    want = sorted((repr((i, *plain(t or ""))) for i, t, _ in rows))
    have = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect()]
    assert sorted(map(repr, have)) == want
    assert got.where("base_failed and kept").count() == 0
    assert Q.judge(docs.limit(0), Q.fit(docs.limit(0), labels)).count() == 0
    none = Q.judge(docs, Q.fit(docs, labels.limit(0)))
    assert none.where("kept = base_failed").count() == 0


def test_ratio_against_brute_force_and_junk_falls(spark):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["the", "cat", "sat", "on", "a", "mat", "with", "his", "old", "hat"]) + rnd.choice(["", "", "s"]) for _ in range(120)) for _ in range(80)]
    junk = [" ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "###", "CLICK", "win", "free"]) + str(rnd.randint(0, 99)) for _ in range(120)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = {r["doc_id"]: r for r in Q.judge(docs, model).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(80))
    assert not any(got[80 + i]["kept"] for i in range(30))
    grams = docs.select("doc_id", Q.buckets(Q.words(F.col("text"))).alias("b")).collect()
    weights = [float(f"{w:.4g}") for w in model.weights]
    for r in grams:
        assert abs(got[r["doc_id"]]["score"] - sum(weights[b] for b in r["b"]) / len(r["b"])) < 1e-9
    # the weights are the ratio of the two smoothed multinomials
    import math
    from collections import Counter

    raw, target = Counter(), Counter()
    for r in grams:
        raw.update(r["b"])
        if r["doc_id"] < 40:
            target.update(r["b"])
    n, t = sum(raw.values()), sum(target.values())
    for b in list(raw)[:50]:
        q = (raw[b] + 1) / (n + Q.BUCKETS)
        p = (target[b] + q * Q.BUCKETS) / (t + Q.BUCKETS)
        assert abs(model.weights[b] - math.log(p / q)) < 1e-9


def test_all_trusted_texts_count(spark):
    import math

    n = 21_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    model = Q.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    counts = {r["b"]: r["n"] for r in docs.select(F.explode(Q.buckets(F.array("text"))).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    for b in range(0, Q.BUCKETS, 97):
        q = (counts.get(b, 0) + 1) / (n + Q.BUCKETS)
        assert abs(model.weights[b] - math.log((counts.get(b, 0) + q * Q.BUCKETS) / (n + Q.BUCKETS) / q)) < 1e-9
