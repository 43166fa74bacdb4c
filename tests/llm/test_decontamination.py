import hashlib
import random
import re

import pytest
from conftest import SF_CHECK
from pyspark.sql import functions as F

from corpus_search.llm import common
from corpus_search.llm import decontamination as D
from corpus_search.llm import queries

UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(len(w), 10)
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, met = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    met |= found
                    hit |= set(range(p, p + n))
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def judged(spark, docs, items, parts=5):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rid string, n_words int").repartition(parts)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, D.judge(d, b).collect()), key=repr)


def made(seed, short):
    rnd = random.Random(seed)
    vocab = ["a", "B", "the", "Ünï", "été", "漢字", "x1", "İ", "ſ", "K", "w7", "Zz"]
    gaps = [" ", " ", " ", "-", ", ", "\n", "\x00", "_", "\x7f"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice(gaps) for _ in range(n))
    items = [(i, text(rnd.choice([10, 11, 14, 30]))) for i in range(12)]
    items += [(50 + i, text(n)) for i, n in enumerate(short)]
    items += [(3, items[4][1]), (None, text(12)), (60, None), (61, ""), (62, " - ")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.choice([0, 1, 2, 4])):
            w = re.split(r"(?<=[ \-,\n])", rnd.choice(items)[1] or "a")
            lo = rnd.randrange(max(1, len(w) - 8))
            parts += [text(rnd.choice([0, 3, 20])), "".join(w[lo : lo + rnd.choice([5, 9, 10, 11, 40])]).translate(UPPER), " "]
        docs.append((i, "".join(parts) + text(rnd.choice([0, 4, 60]))))
    docs += [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (None, items[0][1]), (103, (items[1][1] + " ") * 30), (5, docs[5][1]), (5, "same id, other text " + items[2][1])]
    return docs, items


@pytest.mark.parametrize("seed,short", [(1, []), (2, [9, 9, 4]), (3, [1, 7, 5])])
def test_against_brute_force(spark, seed, short):
    docs, items = made(seed, short)
    want = plain(docs, items)
    assert judged(spark, docs, items) == want
    assert sum(r[5] for r in want) > 10


def test_few_words_so_that_hashes_repeat(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join(rnd.choice("ab") for _ in range(n))
    docs, items = [(i, text(40)) for i in range(40)], [(i, text(rnd.choice([10, 12, 6]))) for i in range(8)]
    assert judged(spark, docs, items) == plain(docs, items)


def test_salted_joins_give_the_same(spark, monkeypatch):
    docs, items = made(4, [6])
    docs += [(1000 + i, docs[3][1] + items[0][1]) for i in range(60)]
    monkeypatch.setattr(common, "MAX_BROADCAST", 0)
    assert judged(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = made(5, [])
    assert judged(spark, docs, []) == plain(docs, [])
    assert judged(spark, docs, [(1, None), (2, "")]) == plain(docs, [])
    assert judged(spark, [], items) == []


def test_long_text_with_a_passage_at_its_end(spark):
    rnd = random.Random(6)
    item = " ".join(f"q{rnd.randrange(999)}" for _ in range(25))
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(200_000)) + " " + item
    got = judged(spark, [(1, long), (2, item[: len(item) // 2])], [(7, item)])
    assert got == plain([(1, long), (2, item[: len(item) // 2])], [(7, item)]) and got[0][2] == 25


def test_winnowing_keeps_every_shared_span(spark):
    """Each window of ten words of a text holds a fingerprint of that window alone."""
    rnd = random.Random(7)
    text = " ".join(rnd.choice("abcde") for _ in range(200))
    w = text.split()
    rows = [("all", text)] + [(str(i), " ".join(w[i : i + 10])) for i in range(191)]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.sort_array(D.fingerprints(D.words(F.col("t")), [10])).alias("f"))
    got = {r["k"]: set(r["f"]) for r in df.collect()}
    assert all(len(f) == 1 and f <= got["all"] for k, f in got.items() if k != "all")
    assert got["all"] == set().union(*(f for k, f in got.items() if k != "all"))


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_CHECK}/{t}.parquet'")
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLE_SQL['op12_decontamination']})").fetchall()
    got = queries.QUERIES["op12_decontamination"](spark, SF_CHECK).collect()
    assert sorted(map(tuple, got)) == sorted(want)
