import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF_CHECK

from corpus_search.llm import common, queries
from corpus_search.llm import turn_repair as R

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, conv string, audit int"


def cheapest(rows):
    """(cost, edits, lines) by a search over states, ordered by cost, then edits. ``rows``: (role, text, must go, extra)."""
    shape = re.compile(r"(s?(ua)+)?\Z")
    prefix = re.compile(r"(s?(ua)*u?)?\Z")
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, k, kinds, lines = heapq.heappop(heap)
        if k == len(rows) and shape.match(kinds):
            return cost, audit, lines
        nexts = [(3, "I", 0, r, "") for r in ("user", "assistant")]
        if k < len(rows):
            role, text, must, extra = rows[k]
            nexts.append((4, "D", 1, None, None))
            if not must:
                nexts.append((extra, "K", 1, role, text))
                nexts += [(3 + extra, "R", 1, r, text) for r in ("user", "assistant")]
        for c, e, step, role, text in nexts:
            made = kinds if role is None else kinds + (role[:1] or "-")
            if prefix.match(made) and len(made) <= 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + c, audit + e, k + step, made, lines if role is None else (*lines, f"{role}:{text}")))
    raise AssertionError


def plain_rows(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def dynamic(rows):
    """The same as ``cheapest`` for long conversations: (cost, edits, lines) by state, from the last row back."""
    after = {"": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (3, "I", ("assistant:",)), "a": (0, "", ())}
    on = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for role, text, must, extra in reversed(rows):
        now = {}
        for state, (c, a, lines) in after.items():
            some = [(c + 4, "D" + a, lines)]
            if not must:
                c, a, lines = after[on[state][0]]
                some.append((c + 3 + extra, "R" + a, (f"{on[state]}:{text}", *lines)))
                initial = role[:1]
                if initial == on[state][0] or (state == "" and initial == "s"):
                    c, a, lines = after[initial]
                    some.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
            now[state] = min(some)
        for _ in range(3):
            for state in now:
                c, a, lines = now[on[state][0]]
                now[state] = min(now[state], (c + 3, "I" + a, (f"{on[state]}:", *lines)))
        after = now
    return after[""]


def plain(rows, search=dynamic):
    out = []
    for conv in {r[0] for r in rows}:
        kept = plain_rows([r for r in rows if r[0] == conv])
        kinds = faults(kept)
        turns = {t for t, *_ in kept if t is not None}
        ill = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = search([(r, t, k in ("blank", "duplicate"), 3 * (k == "truncated")) for (_, r, t), k in zip(kept, kinds)])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), ill, cost, audit, sha))
    return sorted(out, key=repr)


def made(seed, conversations, most):
    rnd = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.choice([1, 2, 3, most])):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rnd.choice(["ok", "ok.", "Yes! ", "what?\n", " \t", "", None, "a\x85", "x. \x0b", "\x85", f"t{rnd.randrange(9)}."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 3, None, None)]
    return rows + rnd.sample(rows, len(rows) // 10)


def repaired(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, R.digests(*R.repair(R.damage(df))).select(*NAMES).collect()), key=repr)


def test_search_and_dynamic_agree():
    rnd = random.Random(3)
    for _ in range(300):
        rows = [(rnd.choice(["s", "user", "assistant", "tool", ""]), "t", rnd.random() < 0.2, rnd.choice([0, 3])) for _ in range(rnd.randrange(5))]
        assert cheapest(rows) == dynamic(rows), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed, 80, 12)
    assert repaired(spark, rows) == plain(rows)


def test_conversations_over_many_segments(spark, monkeypatch):
    rows = made(7, 6, 150)
    rnd = random.Random(9)
    rows += [(77, k, rnd.choice(["user", "assistant"]), rnd.choice(["same.", "other", f"n{k}."])) for k in range(700)]
    want = plain(rows)
    monkeypatch.setattr(common, "MAX_BROADCAST", 0)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
        whole, parts = R.repair(R.damage(df))
        assert parts.where("conv = 77").count() > 3
        assert sorted(map(tuple, R.digests(whole, parts).select(*NAMES).collect()), key=repr) == want
        # the turns as rows are those of the digests
        lines = {}
        for r in R.turns(whole, parts).orderBy("conv", "part", "seq", "place").collect():
            lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {r[0]: r[-1] for r in want if r[-1] != hashlib.sha256(b"").hexdigest()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_small_segments_in_one_partition(monkeypatch):
    """A segment's table gives what its rows give one by one."""
    t, rnd = R.tables(), random.Random(5)
    for _ in range(60):
        symbols = bytes(rnd.randrange(9) for _ in range(rnd.choice([0, 1, 3, 4, 9, 30])))
        ahead, cost, ends = R.summary(symbols)
        for v in range(len(t.vectors)):
            now, total = t.vectors[v], 0
            for s in reversed(symbols):
                now = R.before(now, s)
                total, now = total + min(now), tuple(x - min(now) for x in now)
            assert t.vectors[ahead[v]] == now and cost[v] == total
            for state in range(4):
                audit, end, to_go = R.trace(symbols, v, state)
                assert end == ends[v][state] and to_go == total + now[state]


def test_tables_are_small():
    t = R.tables()
    assert len(t.vectors) < 100 and t.block_to.shape == (len(t.vectors), R.SYMBOLS**R.BLOCK)
    assert np.all(np.array(t.vectors).min(1) == 0)


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.digests(*R.repair(R.damage(none))).count() == 0
    gone = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


def test_long_texts_and_repeated_rows(spark):
    rows = [(1, k % 3, "user" if k % 2 else "assistant", ("word " * 60_000) + "end.") for k in range(12)] + [(2, None, "user", "Same.")] * 400
    assert repaired(spark, rows) == plain(rows)


def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_CHECK}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({queries.ORACLE_SQL['op13_turn_repair']})").fetchall()
    got = queries.QUERIES["op13_turn_repair"](spark, SF_CHECK).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == plain(rows)
