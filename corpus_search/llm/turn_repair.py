"""Repair of conversations: the cheapest edits that give an optional system turn and user/assistant pairs.

Per row in order the edits are Keep (0), Rerole to user or assistant (3), Delete (4, the only one for a
blank or repeated row), and Insert of an empty user or assistant turn (3) anywhere; a truncated row that
isn't deleted costs 3 more. An automaton of four states (nothing yet, after system, after user, after
assistant) reads the roles that come out. Its vector of costs-to-go, less its least number, takes few
values, so the work is done by tables (the method of the Four Russians):

* every vector before a row follows from the vector after it and the row's symbol (role initial and
  truncation, or must-delete), and composed for every block of ``BLOCK`` symbols from every vector;
* a segment of rows goes backward block by block by lookup, which gives the vectors at block bounds;
* forward, each block is expanded backward again into its rows' vectors, and the least letter among the
  edits that keep the optimum is taken. As costs-to-go are exact, this is the ASCII-least of all cheapest
  edit strings. Blocks met before (vector, symbols, state) are looked up.

Rows are sorted over the whole cluster by conversation, turn (nulls first), role and text, so a large
conversation spans partitions, and a partition is read as a stream in segments of at most
``SEGMENT_ROWS`` rows and ``SEGMENT_CHARS`` characters. A conversation inside one segment is repaired
there. The segments of the others carry a small table, from each vector after them to the vector before,
the cost, and the end state of each start state; these are passed backward and forward along the
conversation, and then all segments are traced at once. Repeats (role and text seen earlier) are found
by one partial aggregation over hashes; only texts that come back at another turn are joined.

Nulls: role and text count as one space (so such rows are blank, or can't be kept); null turns come
first and are ignored by gaps; rows of a null conversation id are one conversation. A conversation all
of whose rows were dropped gives zeros and empty texts. Rows of one turn are ordered by role, then
text, so repeated rows are adjacent and the later ones repeats. An empty table gives an empty result,
and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_search.llm.common import with_small, written

RETURNS = 3  # Rerole, Insert, and a truncated row that stays
REMOVES = 4
BLOCK = 4
SEGMENT_ROWS = 2048
SEGMENT_CHARS = 1 << 20

#: Symbols: twice the role's class (s, u, a, other), plus one if truncated; a row to delete; no row.
SYMBOLS, GONE, PAD = 10, 8, 9
INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant. Where Insert and Rerole lead, and Keep by class.
ON = (2, 2, 3, 2)
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
FINAL = (0, 2 * RETURNS, RETURNS, 0)
NAMES = {2: "user", 3: "assistant"}

Vector = tuple[int, int, int, int]


def before(after: Vector, symbol: int) -> Vector:
    """Costs-to-go before a row, from those after it."""
    if symbol == PAD:
        return after
    b = [x + REMOVES for x in after]
    if symbol != GONE:
        extra, keep = RETURNS * (symbol % 2), KEEP[symbol // 2]
        for s in range(4):
            b[s] = min(b[s], after[ON[s]] + RETURNS + extra, after[keep[s]] + extra if s in keep else b[s])
    # inserts lead to the states after user and assistant only; two in a row would come back
    user, assistant = min(b[2], b[3] + RETURNS), min(b[3], b[2] + RETURNS)
    return min(b[0], user + RETURNS), min(b[1], user + RETURNS), user, assistant


def edits(after: Vector, symbol: int, state: int) -> tuple[str, int]:
    """The least edits at a row that keep the optimum, and the state that they lead to."""
    if symbol == PAD:
        return "", state
    costs, out = before(after, symbol), ""
    extra, keep = (0, {}) if symbol == GONE else (RETURNS * (symbol % 2), KEEP[symbol // 2])
    while True:
        left = costs[state]
        if after[state] + REMOVES == left:
            return out + "D", state
        if costs[ON[state]] + RETURNS == left:
            out, state = out + "I", ON[state]
        elif state in keep and after[keep[state]] + extra == left:
            return out + "K", keep[state]
        else:
            return out + "R", ON[state]


class Tables:
    """The normalised vectors that occur, and all transitions for rows and for blocks of rows."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = [FINAL]
        at = {FINAL: 0}
        moves: list[list[tuple[int, int]]] = []
        for v in self.vectors:  # grows as it is read
            row = []
            for symbol in range(SYMBOLS):
                u = before(v, symbol)
                low = min(u)
                u = tuple(x - low for x in u)
                if u not in at:
                    at[u] = len(self.vectors)
                    self.vectors.append(u)
                row.append((at[u], low))
            moves.append(row)
        self.to, self.cost = (np.array([[m[k] for m in row] for row in moves], np.int32) for k in range(2))
        self.edits = [[[edits(v, symbol, s) for s in range(4)] for symbol in range(SYMBOLS)] for v in self.vectors]
        ends = np.array([[[e[1] for e in by_state] for by_state in row] for row in self.edits], np.int8)
        digits = np.stack(np.unravel_index(np.arange(SYMBOLS**BLOCK), (SYMBOLS,) * BLOCK))  # first row first
        now = np.repeat(np.arange(len(self.vectors))[:, None], SYMBOLS**BLOCK, 1)
        cost, afters = np.zeros_like(now, np.int32), []
        for d in digits[::-1]:
            afters.append(now)
            cost += self.cost[now, d]
            now = self.to[now, d]
        states = np.broadcast_to(np.arange(4, dtype=np.int8), (*now.shape, 4))
        for d, v in zip(digits, reversed(afters)):
            states = np.take_along_axis(ends[v, d], states.astype(np.int64), 2)
        #: By vector after and block: the vector before, the cost, and the end state of each start state.
        self.block_to, self.block_cost, self.block_ends = now.astype(np.int16), cost.astype(np.int16), states

    @lru_cache(maxsize=1 << 17)  # noqa: B019 (one object a process)
    def trace_block(self, after: int, block: int, state: int) -> tuple[str, int]:
        """Edits of a block's rows from a start state: the block is expanded backward, then read forward."""
        symbols = [int(d) for d in np.unravel_index(block, (SYMBOLS,) * BLOCK)]
        afters = [after]
        for symbol in symbols[:0:-1]:
            afters.append(int(self.to[afters[-1], symbol]))
        out = ""
        for symbol, v in zip(symbols, reversed(afters)):
            piece, state = self.edits[v][symbol][state]
            out += piece
        return out, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: bytes) -> list[int]:
    """A segment's blocks, the last one filled up with places that hold no row."""
    rows = np.frombuffer(symbols, np.uint8).astype(np.int64)
    rows = np.concatenate([rows, np.full(-len(rows) % BLOCK, PAD)]).reshape(-1, BLOCK)
    return (rows @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()


def trace(symbols: bytes, after: int, state: int) -> tuple[str, int, int]:
    """Edits of a segment before vector ``after`` from a start state; the end state, and the cost-to-go less ``after``'s least."""
    t, blocks, at, total = tables(), blocks_of(symbols), [after], 0
    for b in reversed(blocks):
        total += int(t.block_cost[at[-1], b])
        at.append(int(t.block_to[at[-1], b]))
    total += t.vectors[at.pop()][state]
    out = []
    for b in blocks:
        piece, state = t.trace_block(at.pop(), b, state)
        out.append(piece)
    return "".join(out), state, total


def summary(symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector after a segment: the vector before, the cost, and the end state of each start state."""
    t, blocks = tables(), blocks_of(symbols)
    now = np.arange(len(t.vectors))
    total, afters = np.zeros(len(now), np.int64), []
    for b in reversed(blocks):
        afters.append(now)
        total += t.block_cost[now, b]
        now = t.block_to[now, b].astype(np.int64)
    states = np.tile(np.arange(4), (len(now), 1))
    for b in blocks:
        states = np.take_along_axis(t.block_ends[afters.pop(), b], states, 1).astype(np.int64)
    return now, total, states


def apply(audit: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """Roles and texts that a string of edits makes of rows."""
    out_roles, out_texts, k = [], [], 0
    for e in audit:
        if e == "D":
            k += 1
            continue
        if e == "K":
            role = roles[k]
            state = KEEP[INITIALS.index(role[0])][state]
        else:
            state = ON[state]
            role = NAMES[state]
        out_roles.append(role)
        out_texts.append("" if e == "I" else texts[k])
        k += e != "I"
    return out_roles, out_texts


# --- rows -------------------------------------------------------------------------------------

_BLANK = r"[\x20\x09-\x0D]*"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): each row's fault chosen by crc32 of ``conv_id:turn``; dropped rows are marked."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    one = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"),
    )
    fault, text = F.col("fault"), F.col("text")
    one = one.select(
        "conv", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (fault == 0).alias("dropped"),
        F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    )
    return one.withColumn("copies", F.explode("copies")).drop("copies")


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, dropped) with what a row alone tells (blank, cut), and ``again``: the same at an earlier turn."""
    text = F.col("text")
    one = rows.select(
        "*", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit(1)).alias("h2"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")).alias("place"),
        F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("ck"), F.col("conv").isNull().alias("cn"),
    )
    keys = ["cn", "ck", "h1", "h2"]
    back = one.where(~F.col("dropped")).groupBy(*keys).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    back = written(back.where("last > first").select(*keys, "first"), "turns-again")
    joined = with_small(one, back, keys, 64 + F.length("ck"), "left")
    return joined.select(
        "conv", "turn", "role", "text", "dropped", text.rlike(rf"^{_BLANK}\z").alias("blank"), (~text.rlike(rf"[.!?]{_BLANK}\z")).alias("cut"),
        F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("again"),
    )


_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")


def _schema(conv: T.DataType) -> T.StructType:
    fields = [("conv", conv), ("part", T.IntegerType()), ("seq", T.LongType()), ("whole", T.BooleanType())]
    fields += [(c, T.LongType()) for c in _COUNTS]
    fields += [("first_initial", T.StringType()), ("last_initial", T.StringType()), ("symbols", T.BinaryType()), ("summary", T.BinaryType())]
    fields += [("cost", T.LongType()), ("audit", T.StringType()), ("roles", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


class _Segment:
    """Rows of one conversation that lie together, and what is counted in them."""

    def __init__(self, conv, previous: tuple | None = None) -> None:
        self.conv, self.previous = conv, previous
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.faults, self.illegal, self.turns, self.low, self.high = [0, 0, 0, 0], 0, 0, None, None
        self.initials: list[str] = []

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        fault = 1 if blank else 2 if again or self.previous == (turn, role, text) else 3 if cut else 0
        self.previous = turn, role, text
        self.faults[fault] += 1
        initial = role[:1]
        kind = INITIALS.find(initial) if initial else 3
        self.symbols.append(GONE if fault in (1, 2) else 2 * (kind if kind >= 0 else 3) + (fault == 3))
        self.illegal += bool(self.initials) and self.initials[-1] + initial not in ("su", "ua", "au")
        self.initials.append(initial)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS

    def row(self, part: int, seq: int, whole: bool) -> dict:
        out = {"conv": self.conv, "part": part, "seq": seq, "whole": whole, "n_rows": len(self.roles), "blank": self.faults[1], "duplicate": self.faults[2],
               "truncated": self.faults[3], "illegal": self.illegal, "turns": self.turns, "low": self.low, "high": self.high,
               "first_initial": self.initials[0] if self.initials else None, "last_initial": self.initials[-1] if self.initials else None}
        symbols = bytes(self.symbols)
        if not whole:
            table = b"".join(a.astype(np.int64).tobytes() for a in summary(symbols))
            return out | {"symbols": symbols, "summary": table, "cost": None, "audit": None, "roles": self.roles, "texts": self.texts}
        audit, state, cost = trace(symbols, 0, 0)
        audit += "I" * (FINAL[state] // RETURNS)
        roles, texts = apply(audit, self.roles, self.texts, 0)
        return out | {"symbols": None, "summary": None, "cost": cost, "audit": audit, "roles": roles, "texts": texts}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 500, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r.get("texts") or ())) + 64
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def segments(rows: DataFrame) -> DataFrame:
    """Marked rows in order, cut into segments: whole conversations repaired, the others' segments to be traced."""
    schema = _schema(rows.schema["conv"].dataType)
    ordered = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("conv", "turn", "role", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[dict]:
            now, seq, inside = None, 0, False  # inside: the conversation began here, in one segment so far
            for batch in batches:
                for conv, turn, role, text, dropped, blank, cut, again in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or conv != now.conv:
                        if now is not None:
                            yield now.row(part, seq, inside)
                        inside, seq, now = now is not None, seq + 1, _Segment(conv)
                    elif now.full():
                        yield now.row(part, seq, False)
                        inside, seq, now = False, seq + 1, _Segment(conv, now.previous)
                    if not dropped:
                        now.add(turn, role, text, blank, cut, again)
            if now is not None:  # the last conversation may go on in the next partition
                yield now.row(part, seq, False)

        yield from _batches(found(), _arrow(schema))

    columns = ["conv", "turn", "role", "text", "dropped", "blank", "cut", "again"]
    return ordered.select(*columns).mapInArrow(of, schema)


def _by_conversation(rows: DataFrame, descending: bool) -> DataFrame:
    """Segments of a conversation together, in order."""
    place = [F.col(c).desc() if descending else F.col(c) for c in ("part", "seq")]
    return rows.repartition("conv").sortWithinPartitions("conv", *place)


def traced(parts: DataFrame) -> DataFrame:
    """Segments of conversations that span several, repaired: each from the vector after it and its start state."""
    conv = parts.schema["conv"]
    back_schema = T.StructType([conv, *(T.StructField(n, t) for n, t in (
        ("part", T.IntegerType()), ("seq", T.LongType()), ("after", T.IntegerType()), ("last", T.BooleanType()), ("to_go", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.IntegerType()))))])
    start_schema = T.StructType([*back_schema.fields[1:5], T.StructField("start", T.IntegerType()), T.StructField("to_go", T.LongType())])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            t, conv, fresh_one, after, cost = tables(), None, True, 0, 0
            for batch in batches:
                for c, part, seq, raw in zip(*(x.to_pylist() for x in batch.columns)):
                    last = fresh_one or c != conv
                    conv, fresh_one, after, cost = c, False, 0 if last else after, 0 if last else cost
                    table = np.frombuffer(raw, np.int64)
                    n = len(table) // 6
                    cost += int(table[n + after])
                    ahead = int(table[after])
                    yield {"conv": c, "part": part, "seq": seq, "after": after, "last": last, "to_go": [cost + x for x in t.vectors[ahead]],
                           "ends": table[2 * n + 4 * after :][:4].tolist()}
                    after = ahead

        yield from _batches(found(), _arrow(back_schema))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            state, ended = 0, True
            for batch in batches:
                for _, part, seq, after, last, to_go, ends in zip(*(x.to_pylist() for x in batch.columns)):
                    state = 0 if ended else state
                    yield {"part": part, "seq": seq, "after": after, "last": last, "start": state, "to_go": to_go[state]}
                    state, ended = ends[state], last

        yield from _batches(found(), _arrow(start_schema))

    schema = parts.schema

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*schema.names, "after", "last", "start", "to_go"]

        def found() -> Iterator[dict]:
            for batch in batches:
                for values in zip(*(x.to_pylist() for x in batch.columns)):
                    r = dict(zip(names, values))
                    audit, state, _ = trace(r["symbols"], r["after"], r["start"])
                    audit += "I" * (FINAL[state] // RETURNS) if r["last"] else ""
                    roles, texts = apply(audit, r["roles"], r["texts"], r["start"])
                    yield {k: r[k] for k in schema.names} | {"cost": r["to_go"], "audit": audit, "roles": roles, "texts": texts, "symbols": None, "summary": None}

        yield from _batches(found(), _arrow(schema), 16)

    after = _by_conversation(parts.select("conv", "part", "seq", "summary"), True).mapInArrow(backward, back_schema)
    starts = written(_by_conversation(after, False).mapInArrow(forward, start_schema), "turn-starts")
    return parts.join(starts, ["part", "seq"]).select(*schema.names, "after", "last", "start", "to_go").mapInArrow(finish, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations repaired, of rows (conv, turn, role, text, dropped): those in one segment, and the segments of others.

    ``roles`` and ``texts`` are the repaired turns, ``audit`` the edits, ``cost`` the costs from the
    segment on; ``part`` and ``seq`` order a conversation's segments.
    """
    found = written(segments(marked(rows)), "turn-segments")
    return found.where("whole"), traced(found.where(~F.col("whole")))


def turns(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired turns as rows: conv, part, seq, place, role and text, in that order."""
    return whole.unionByName(parts).select("conv", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select(
        "conv", "part", "seq", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def _gaps(low: Column, high: Column, turns_: Column) -> Column:
    return F.coalesce(high - low + 1 - turns_, F.lit(0).cast("long"))


def digests(whole: DataFrame, parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation its gaps, faults, illegal neighbours, cost, edits and the digest of its repaired turns."""
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    sha = F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    in_one = whole.select(F.col("conv").alias(conv_col), _gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), *names[1:7], sha.alias(names[7]))

    schema = T.StructType([parts.schema["conv"], *(T.StructField(n, T.LongType()) for n in names[:6]), *(T.StructField(n, T.StringType()) for n in names[6:])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(a: dict) -> dict:
            gaps = a["high"] - a["low"] + 1 - a["turns"] if a["low"] is not None else 0
            return {"conv": a["conv"], "gaps": gaps, **{n: a[n] for n in names[1:6]}, "audit": "".join(a["audit"]), "repaired_sha256": a["sha"].hexdigest()}

        def found() -> Iterator[dict]:
            now = None
            for batch in batches:
                for r in batch.to_pylist():
                    if now is None or r["conv"] != now["conv"]:
                        if now is not None:
                            yield done(now)
                        now = {"conv": r["conv"], "cost": r["cost"], "audit": [], "sha": hashlib.sha256(), "any": False, "initial": None, "low": None, "high": None, "turns": 0}
                        now |= dict.fromkeys(names[1:5], 0)
                    for n in names[1:5]:
                        now[n] += r[n]
                    if r["n_rows"]:
                        now["illegal"] += now["initial"] is not None and now["initial"] + r["first_initial"] not in ("su", "ua", "au")
                        now["initial"] = r["last_initial"]
                    if r["low"] is not None:
                        now["turns"] += r["turns"] - (r["low"] == now["high"])
                        now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
                    now["audit"].append(r["audit"])
                    if r["repaired"] is not None:
                        now["sha"].update((("\n" if now["any"] else "") + r["repaired"]).encode())
                        now["any"] = True
            if now is not None:
                yield done(now)

        yield from _batches(found(), _arrow(schema))

    texts = parts.withColumn("repaired", F.when(F.size("roles") > 0, F.array_join(lines, "\n")))
    texts = texts.select("conv", "part", "seq", *_COUNTS, "first_initial", "last_initial", "cost", "audit", "repaired")
    joined = _by_conversation(texts, False).mapInArrow(merge, schema).withColumnRenamed("conv", conv_col)
    return in_one.unionByName(joined)
