import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_search.llm import language_id, mixing, toxicity, url_filter

WORDS = {
    "en": "the of and to in is was that it for with his they are from this have not but had".split(),
    "de": "der die und das ist nicht ein ich für mit über schön größe wenn auch noch müssen können".split(),
    "fr": "le la les des est une dans qui où été très français déjà même être avec pour sur élève".split(),
}


def sentences(lang, n, rnd):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    return [(i, sentences(lang, rnd.choice([6, 30, 400]), rnd), lang) for i, lang in enumerate(list(WORDS) * 60)]


def test_language_of_held_out_texts(spark, texts):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "en"), (1003, sentences("en", 50, random.Random(1)), None), (None, "der die und das ist nicht", "de"), (0, texts[0][1], "en")]
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in [*texts, *odd]], "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs)
    got = language_id.classify(docs, model).collect()
    assert len(got) == len(texts) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    held = [(by_id[i]["lang_pred"], g) for i, _, g in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in texts)
    assert np.mean([a == b for a, b in held]) > 0.95
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000]["score"] == 0
    assert by_id[1003]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.classify(docs.limit(0), language_id.fit(docs.limit(0))).count() == 0
    none = language_id.classify(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert none.where("lang_pred != 'und'").count() == 0


def test_convolution_against_plain_loops():
    rnd = np.random.default_rng(1)
    model = language_id.train(["abc der die das " * 30, "the and with of " * 30], ["de", "en"], steps=5)
    raw = rnd.integers(0, 256, 700).astype(np.uint8)
    rows, owner = language_id.windows(raw, np.array([0, 300, 300, 302, 700]))
    assert owner.tolist() == sorted(owner.tolist()) and set(owner) == {0, 2, 3}
    covered = {0: set(), 3: set()}
    step = language_id.WINDOW - max(language_id.WIDTHS) + 1
    for k, o in enumerate(owner):
        if o in covered:
            covered[o].add(sum(owner[:k] == o) * step)
    assert max(covered[3]) + language_id.WINDOW >= 400 and max(covered[0]) + language_id.WINDOW >= 300
    got, _ = language_id.features(model, rows)
    for i in (0, len(rows) - 1):
        want = []
        for width, table, bias in zip(language_id.WIDTHS, model.tables, model.bias):
            answers = [sum(table[k][rows[i][p + k]] for k in range(width)) for p in range(language_id.WINDOW - width + 1)]
            want.append(np.maximum(np.max(answers, 0) + bias, 0))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-5)


def test_toxicity_learns_words_and_their_misspellings(spark):
    rnd = random.Random(5)
    bad = ["idiot", "stupid", "moron", "pathetic"]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(WORDS["en"]) + rnd.choice(["", "er", "ing", "s"]) for _ in range(rnd.choice([10, 60, 300]))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(900, "what a stuppid idiott they are", "x"), (901, "they are not with his that", "x"), (902, None, "x"), (903, "", "x"), (None, "moron", "x"), (900, "moron moron " + rows[1][1] * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(rows)
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    by_text = {r["doc_id"]: r for r in got if r["doc_id"] not in (900, None)}
    assert all(r["predicted"] == 1 for r in got if r["doc_id"] in (900, None))
    assert by_text[901]["predicted"] == 0 and 0 <= by_text[902]["score"] == by_text[903]["score"] <= 1
    none = toxicity.classify(docs, toxicity.fit(docs, table.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), model).count() == 0


def test_grams_are_those_of_the_word_alone():
    words = pa.array(["idiot", "größe", "a", "idiot"])
    rows, ends = toxicity.grams_of(words)
    assert np.diff(ends).tolist() == [1 + 5 + 4 + 3, 1 + 5 + 4 + 3, 2, 1 + 5 + 4 + 3]
    alone = [sorted(toxicity.grams_of(words.slice(k, 1))[0]) for k in range(4)]
    assert [sorted(rows[a:b]) for a, b in zip(ends[:-1], ends[1:])] == alone and alone[0] == alone[3]
    value = np.array([1.0, 5.0, 3.0, -2.0, 7.0])
    has, top, start = toxicity.best_windows(value, np.array([0, 3, 3, 4, 5]), 2)
    assert has.tolist() == [0, 2, 3] and top.tolist() == [4.0, -2.0, 7.0] and start.tolist() == [1, 3, 4]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:end]


def plain_rule(host, path):
    best = None
    for kind, of, start in url_filter.RULES:
        if (host == of or host.endswith("." + of)) and path.startswith(start) and (best is None or len(of + start) > len(best[0])):
            best = of + start, kind
    return best or (None, None)


def test_urls_against_plain_rules(spark):
    rnd = random.Random(8)
    hosts = ["example.org", "a.example.org", "notexample.org", "org", "x.com", "COM", "forum.net", "Bücher.ORG", "xorg"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/a", "/de/b", "/ES/", "/fr"]
    tails = ["", "?a=/de/", "#x?y", "?x#y"]
    urls = [rnd.choice(["http", "https"]) + "://" + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(tails) for _ in range(400)]
    urls += [None, "", "no scheme/x", "http://", "http:///es/", "a://b://c.org/x", "http://a.org/\nx"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(None, urls[0], "x", 1), (1, urls[1], "x", 1)], "page_id long, url string, host string, score int")
    model = url_filter.fit(pages)
    got = url_filter.judge(pages, model).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is None:
            continue
        host, path = plain_url(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == (verdict or ("allow" if r["score"] >= model.least and url_filter_has_text(urls[r["page_id"]]) else "block"))
    empty = pages.limit(0)
    assert url_filter.judge(empty, url_filter.fit(empty)).count() == 0


def url_filter_has_text(url):
    return url is not None and "://" in url and url.split("://", 1)[1] != ""


def test_markov_score_against_brute_force(spark):
    import math

    rows = [("aab", True), ("aba", True), ("bbb", False), ("bab", False), ("ab", True)] * 3
    labelled = spark.createDataFrame(rows, "_s string, _ok boolean")
    contexts = url_filter.count_contexts(labelled).cache()
    order, strength, size = url_filter.ORDER, url_filter.STRENGTH, len(url_filter.ALPHABET) + 2

    def chance(text, i, ok):
        p = 1 / size
        for k in range(order + 1):
            ctx = (" " * order + text)[i + order - k : i + order]
            after = [(" " * order + s)[j + order] for s, o in rows if o == ok for j in range(len(s)) if (" " * order + s)[j + order - k : j + order] == ctx]
            anywhere = any((" " * order + s)[j + order - k : j + order] == ctx for s, _ in rows for j in range(len(s)))
            if anywhere:
                p = (after.count(text[i]) + strength * p) / (len(after) + strength)
        return p

    texts = ["aab", "bb", "zz", "abab"]
    got = {r["k"]: r["_score"] for r in url_filter.scored(spark.createDataFrame([(t, t) for t in texts], "k string, _s string"), contexts, "k").collect()}
    for t in texts:
        want = np.mean([math.log(chance(t, i, True)) - math.log(chance(t, i, False)) for i in range(len(t))])
        assert abs(got[t] - want) < 1e-9


def test_mix_reaches_the_targets(spark, texts):
    rows = [(i, t, g, 1) for i, t, g in texts if g == "en" or i % 2] + [(2000, None, "en", 1), (2001, "", None, 1), (2002, texts[0][1] + " " + texts[1][1], None, 1), (None, texts[0][1], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate int")
    model = mixing.fit_classifier(docs, domain_col="lang")
    assert model.domains == ("de", "en", "fr")
    targets = {"en": 0.4, "de": 0.4, "fr": 0.2, "xx": 3.0}
    got = mixing.mix(docs, model, targets).collect()
    assert len(got) == len(rows)
    expected = [sum(r["n_tokens"] * r["rate"] * r["posterior"][k] for r in got) for k in range(3)]
    share = np.array(expected) / sum(expected)
    assert np.allclose(share, [0.4, 0.4, 0.2], atol=0.01)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in got)
    right = [model.domains[int(np.argmax(r["posterior"]))] == dict((i, g) for i, _, g, _ in rows)[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 2000]
    assert np.mean(right) > 0.95
    fixed = mixing.mix(docs, model, {"en": 1.0, "de": 1.0, "fr": 0.0}, budget=1000.0).collect()
    assert abs(sum(r["n_tokens"] * r["rate"] for r in fixed) - 1000) < 60
    more = mixing.repeat(docs, model, targets)
    assert more.columns == docs.columns
    assert {r["doc_id"] for r in more.collect()} == {r["doc_id"] for r in got}
    nobody = mixing.fit_classifier(docs.where("lang = 'zz'"), domain_col="lang")
    assert {r["rate"] for r in mixing.mix(docs, nobody, targets).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), model, targets).count() == 0 and mixing.repeat(docs.limit(0), model, targets).count() == 0


def test_rare_url_contexts_count_at_any_size(spark, monkeypatch):
    # one accepted and one rejected text of their own kinds among 30,000 places
    rows = [("abcdefghij" * 10, i % 2 == 0) for i in range(300)] + [("zyxwv", True), ("zyxuv", False)]
    contexts = url_filter.count_contexts(spark.createDataFrame(rows, "_s string, _ok boolean")).cache()
    got = {r["ctx"] for r in contexts.collect()}
    want = {(" " * 4 + s)[j + 4 - k : j + 4] for s, _ in set(rows) for j in range(len(s)) for k in range(5)}
    assert got == want
    texts = spark.createDataFrame([(t, t) for t in ("zyxwv", "zyxuv", "abcde", "")], "k string, _s string")
    near = {r["k"]: r["_score"] for r in url_filter.scored(texts, contexts, "k").collect()}
    assert near["zyxwv"] > 0.1 and near["zyxuv"] < -0.1 and abs(near["abcde"]) < 0.01 and "" not in near
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 0)
    shuffled = url_filter.scored(texts, contexts, "k")
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().toString()
    far = {r["k"]: r["_score"] for r in shuffled.collect()}
    assert far.keys() == near.keys() and all(abs(far[k] - near[k]) < 1e-9 for k in far)


def test_toxicity_learns_rare_labels_and_long_texts(spark):
    rnd = random.Random(12)

    def text(n, toxic):
        words = [rnd.choice(WORDS["en"]) + rnd.choice(["", "er", "ing", "s"]) for _ in range(n)]
        for k in range(0, n if toxic else 0, 8):
            words[k] = rnd.choice(["idiot", "moron"])
        return " ".join(words)

    # a few toxic ones of many; most labelled ids have no text
    docs = spark.createDataFrame([(i, text(20, i % 250 == 0)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4000 and i % 250 == 0)) for i in range(20000)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, toxicity.fit(docs, labels, max_rows=200)).collect()}
    assert all(got[i] == 1 for i in range(0, 4000, 250)) and sum(got.values()) < 16 + 40
    # all labelled texts are longer than a stretch
    docs = spark.createDataFrame([(i, text(300 if i < 100 else 30, i % 4 == 0)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_chars=500)
    assert model.learnt
    assert {r["doc_id"] for r in toxicity.classify(docs, model).collect() if r["predicted"]} == set(range(0, 200, 4))


def test_quotas_of_labels():
    assert toxicity.quotas({0: 5, 1: 2}, 10) == {0: 5, 1: 2}
    assert toxicity.quotas({0: 10**6, 1: 1000}, 3000) == {0: 2000, 1: 1000}
    assert toxicity.quotas({0: 10**6, 1: 3}, 3000)[1] == 3
    assert sum(toxicity.quotas({0: 10**6, 1: 10**5}, 3000).values()) <= 3000


def test_a_rare_language_is_learnt(spark):
    """20,000 short rows, two of them Finnish: the sample of 300 has them, and counts of rows stay within the bound."""
    from corpus_search.llm import common

    base = spark.range(20_000).select(F.col("id").alias("_id"), F.concat(F.lit("the cat sat on the mat with number "), F.col("id").cast("string")).alias("_t"), F.lit("en").alias("_y"))
    rare = spark.createDataFrame([(30_000, "hyvää päivää tämä on suomea", "fi"), (30_001, "näin sanotaan täällä myös", "fi")], "_id long, _t string, _y string")
    picked, counts = common.labelled_sample(base.unionByName(rare), 300, "sample")
    by = {r["_y"]: r["n"] for r in picked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    assert counts == {"en": 20_000, "fi": 2} and by["fi"] == 2 and 290 <= by["en"] <= 298
    again = common.labelled_sample(base.unionByName(rare).repartition(7), 300, "sample")[0]
    assert sorted(map(tuple, picked.collect())) == sorted(map(tuple, again.collect()))
    docs = base.unionByName(rare).toDF("doc_id", "text", "lang")
    model = language_id.fit(docs, held=9, max_rows=300)
    assert model.languages == ["en", "fi"]
    assert mixing.fit_classifier(docs, max_rows=300, domain_col="lang").domains == ("en", "fi")


def test_mixing_against_plain_projected_gradient(spark):
    """Posteriors, rates and copies of every row from plain Python: its own hashing, counting and gradient steps."""
    import re
    from collections import Counter

    import xxhash

    rnd = random.Random(21)
    rows = [(i, sentences(g, rnd.choice([3, 20, 60]), rnd), g) for i, g in enumerate(["en"] * 60 + ["de"] * 20 + ["fr"] * 10)]
    rows += [(500, None, "en"), (501, "  ", None), (502, rows[0][1], "en"), (502, rows[0][1], "en"), (503, rows[0][1] + " " + rows[70][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = mixing.fit_classifier(docs, domain_col="lang")
    targets = {"en": 0.3, "de": 0.4, "fr": 0.3}

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def bucket(w):
        return signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) % mixing.BUCKETS

    counts = {d: Counter() for d in model.domains}
    for _, t, g in rows:
        if g and t is not None:
            counts[g].update(map(bucket, words(t)))
    sums = {d: sum(c.values()) + 0.5 * mixing.BUCKETS for d, c in counts.items()}
    logs = {d: [math_log((counts[d][b] + 0.5) / sums[d]) for b in range(mixing.BUCKETS)] for d in model.domains}
    mean = [sum(logs[d][b] for d in model.domains) / len(model.domains) for b in range(mixing.BUCKETS)]
    prior = [sums[d] / sum(sums.values()) for d in model.domains]
    assert np.allclose(model.prior, prior, atol=1e-9)

    def posterior(t):
        w = words(t)
        scale = min(len(w), mixing.EVIDENCE) / len(w) if w else 0.0
        z = [sum(round(logs[d][b] - mean[b], 3) for b in map(bucket, w)) * scale + math_log(p) for d, p in zip(model.domains, prior)]
        e = np.exp(np.array(z) - max(z))
        return [float(np.floor(x * 100 + 0.5) / 100) for x in e / e.sum()]

    p = np.array([posterior(t) for _, t, _ in rows])
    n = np.array([len(words(t)) for _, t, _ in rows], float)
    goal = np.array([targets[d] for d in model.domains])
    have = (n[:, None] * p).sum(0)
    total = (have / goal).max()
    rate = np.ones(len(rows))
    for _ in range(mixing.STEPS):
        now = (n * rate) @ p
        if np.abs(now - goal * total).max() <= mixing.CLOSE * total:
            break
        rate = np.maximum(0.0, rate - p @ ((now - goal * total) / have))
    got = sorted(mixing.mix(docs, model, targets).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    want = sorted(zip([r[0] for r in rows], n, p.tolist(), rate), key=lambda r: r[:2])
    for g, (i, size, post, r) in zip(got, want):
        assert (g["doc_id"], g["n_tokens"]) == (i, size)
        assert np.allclose(g["posterior"], post, atol=1e-9) and abs(g["rate"] - r) < 1e-6, i
        assert int(r) <= g["copies"] <= int(r) + 1
    assert {tuple(g["posterior"]) for g in got if g["doc_id"] == 502}.__len__() == 1


def math_log(x):
    import math

    return math.log(x)
