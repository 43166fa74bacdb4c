import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpus_search.llm import ctph


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def plain_likeness(a, b):
    (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
    ka, kb, best = int(ka), int(kb), 0.0
    for x, y in [(a1, b1), (a2, b2)] if ka == kb else [(a2, b1)] if kb == 2 * ka else [(a1, b2)] if ka == 2 * kb else []:
        longest = max(len(x), len(y))
        best = max(best, 1 - plain_distance(x, y) / longest if longest else 1.0)
    return best


def made(n, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghiéñ漢") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    return ["", "a", "aaaa" * 400, "", *(" ".join(rnd.choice(words) for _ in range(rnd.choice([2, 9, 80, 900]))) for _ in range(n))]


def test_fingerprint_depends_on_the_text_alone():
    texts = made(60)
    together = ctph.signatures(pa.array(texts)).strings()
    assert together == [ctph.signatures(pa.array([t])).strings()[0] for t in texts]
    assert together[0] == together[3] == "1::"
    assert all(len(p) <= ctph.LONGEST for f in together for p in f.split(":")[1:])
    assert [ctph.Signatures.parsed([f]).strings()[0] for f in together] == together


def test_likeness_is_the_edit_distance():
    texts = made(60)
    prints = ctph.signatures(pa.array(texts)).strings()
    other = prints[1:] + prints[:1]
    got = ctph.likenesses(ctph.Signatures.parsed(prints), ctph.Signatures.parsed(other))
    assert np.allclose(got, [plain_likeness(a, b) for a, b in zip(prints, other)])
    assert np.allclose(ctph.likenesses(ctph.Signatures.parsed(prints), ctph.Signatures.parsed(prints)), 1)


def test_next_document_over_many_tasks(spark):
    texts = made(50)
    rows = [(7 * i, t, "x") for i, t in enumerate(texts)] + [(14, texts[2], "x"), (None, "no id", "x"), (22, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = {(r["doc_id"], r["edited_sha256"]): r for r in ctph.compared_to_next(docs).collect()}
    ids = [(i, t or "") for i, t, _ in rows]
    tie = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in ids], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    ids.sort(key=lambda x: (x[0] is None, -(x[0] or 0), tie[x[1]], x[1].encode()))
    want = set()
    for (i, t), (_, nxt) in zip(ids, ids[1:] + ids[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        key = (i, hashlib.sha256(new.encode()).hexdigest())
        want.add(key)
        own, cut, after = ctph.signatures(pa.array([t, new, nxt])).strings()
        row = got[key]
        assert (row["n_chars"], row["fingerprint"], row["edited_fingerprint"]) == (len(t), own, cut)
        assert abs(row["near_edited"] - plain_likeness(own, cut)) < 1e-9
        assert abs(row["near_next"] - plain_likeness(own, after)) < 1e-9
    assert set(got) == want
    assert ctph.compared_to_next(docs).count() == len(rows)
    assert ctph.compared_to_next(docs.limit(0)).count() == 0
    assert ctph.compared_to_next(docs.where("doc_id = 28")).first()["near_next"] == 1


def test_columns(spark):
    df = spark.createDataFrame([("the same text " * 20, "the same text " * 20), (None, "x")], "a string, b string")
    out = df.select(ctph.likeness(ctph.fingerprint("a"), ctph.fingerprint("b")).alias("x")).collect()
    assert [r["x"] for r in out] == [1.0, 0.0]
