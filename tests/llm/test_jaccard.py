import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpus_search.llm import jaccard_join as J


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def compared(rows):
    """The group (a row's place) and the number of links of each row, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    up, count = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                count[i] += 1
                count[j] += 1
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))], count


def plain(rows):
    """(doc_id, least id of the group, number of links)."""
    group, count = compared(rows)
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, least[g], n) for (d, _), g, n in zip(rows, group, count)), key=repr)


def made(groups, copies, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    common = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 8, 60, 150]))]
        if rnd.random() < 0.5:
            base = common + base
        for _ in range(rnd.choice([1, 1, 2, copies])):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 3, rnd.choice([" ", " ", "\n", "  "]).join(text)))
    return [*rows, (None, rows[3][1]), (7, None), (8, ""), (9, " \t"), (9, " \t"), (rows[4][0], "same id other text than before")]


def test_shingles_and_sketches():
    texts = [t or "" for _, t in made(40, 4)]
    h, ends = J.shingles(pa.array(texts))
    sets = [plain_set(t) for t in texts]
    assert np.diff(ends).tolist() == [len(s) for s in sets]
    own = [frozenset(h[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(own[i] & own[j]) == len(sets[i] & sets[j])
    alone = [J.shingles(pa.array([t]))[0] for t in texts]
    assert all((x == h[a:b]).all() for x, a, b in zip(alone, ends[:-1], ends[1:]))
    tokens, keys = J.sketches(h, ends)
    assert len({k.tobytes() for k in keys}) == len(set(sets))
    estimates = [((tokens[i] == tokens[j]).mean(), len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]]
    assert abs(np.mean([a - b for a, b in estimates])) < 0.01 and max(abs(a - b) for a, b in estimates) < 0.35


def test_recall_of_the_paths():
    assert J.expected_recall() > 0.99
    rnd = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        tokens = rnd.integers(0, 1 << 32, (2, J.PLACES), dtype=np.uint32)
        same = rnd.random(J.PLACES) < 0.8
        tokens[1, same] = tokens[0, same]
        found = False
        for root in J._roots():
            paths = [{int(root)}, {int(root)}]
            for _ in range(3):
                paths = [{int(c) for c in J.children(np.array(sorted(p), np.uint64), np.repeat(t[None], len(p), 0))[1]} if p else p for p, t in zip(paths, tokens)]
                both = paths[0] & paths[1]
                paths = [both, both]
            found |= bool(paths[0])
        met += found
    assert met >= 290


@pytest.mark.parametrize("leaf,depth", [(256, 6), (8, 3)])
def test_join_against_all_pairs(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "DEPTH", depth)
    rows = made(45, 25)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, label string").repartition(6)
    assert sorted(map(tuple, J.classify(docs).collect()), key=repr) == plain(rows)


def test_first_of_groups_and_empty_table(spark):
    rows = made(12, 5)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    kept = J.first_of_groups(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    sets = [plain_set(r["text"]) for r in got]
    for i, a in enumerate(sets):
        assert all(not (a == b or 5 * len(a & b) >= 4 * len(a | b)) for b in sets[:i])
    assert len(got) == len(set(compared(rows)[0]))
    assert J.classify(docs.limit(0)).count() == 0 and J.first_of_groups(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_compared_once(spark, monkeypatch):
    """600 versions of one text: their ball is found and they don't go down the levels; all links are counted."""
    monkeypatch.setattr(J, "LEAF", 64)
    monkeypatch.setattr(J, "SIDE", 100)
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(600):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            text[rnd.randrange(len(text))] = f"v{rnd.randrange(300)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"w{rnd.randrange(400)}" for _ in range(80))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    levels = []
    monkeypatch.setattr(J, "written", lambda df, name, was=J.written: levels.append((name, x := was(df, name))) or x)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.classify(docs).collect()}
    sizes = {name: df.count() for name, df in levels if name.startswith("paths")}
    assert sum(n for name, n in sizes.items() if name != "paths-1") < sizes["paths-1"] / 2
    want = {d: (g, n) for d, g, n in plain(rows)}
    assert {d: g for d, (g, _) in got.items()} == {d: g for d, (g, _) in want.items()}
    found, all_of = sum(n for _, n in got.values()), sum(n for _, n in want.values())
    assert all(got[d][1] <= want[d][1] for d in want) and found >= 0.99 * all_of


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n = 500
    names = list(range(n))
    random.Random(2).shuffle(names)
    nodes = spark.createDataFrame([(k, f"{k:016d}".encode()) for k in range(n + 40)], "rid long, key binary")
    chain = [(f"{a:016d}".encode(), f"{b:016d}".encode()) for a, b in zip(names, names[1:])]
    hub = [(f"{n:016d}".encode(), f"{n + k:016d}".encode()) for k in range(1, 30)]
    rounds = []
    monkeypatch.setattr(J, "written", lambda df, name, was=J.written: rounds.append(name) or was(df, name))
    got = J.components(nodes, spark.createDataFrame(chain + hub, "key binary, other binary")).collect()
    assert rounds.count("near") < 15
    label = {int(r["key"]): r["label"]["rid"] for r in got}
    assert label == {**dict.fromkeys(range(n), 0), **dict.fromkeys(range(n, n + 30), n)}
