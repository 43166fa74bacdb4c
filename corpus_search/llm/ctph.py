"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes runs over a text's UTF-8 bytes. A chunk ends wherever the hash
begins with ``k`` zero bits, so chunks of about ``2**k`` bytes depend on what the text says and
not on where it says it. Each chunk gives one of 64 symbols. The level ``k`` is the smallest one,
from a start set by the text's length, at which a text has at most 64 chunks; a fingerprint is
``2**k:symbols at k:symbols at k + 1``. Two fingerprints are alike as 1 minus the edit distance of
their symbols over the longer one's length, at a block size which both have (the better of two);
without a common block size they are 0 alike.

Null text counts as empty. The fingerprint of an empty text is ``1::``; two empty ones are 1 alike.
Equal texts have equal fingerprints, however often they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.common import no_nulls, text_bytes, utf8_parts, written

WINDOW = 7
LONGEST = 64
_SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SYMBOL_OF = {int(c): i for i, c in enumerate(_SYMBOLS)}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 32-bit values, so that high and low bits are alike good."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def rolling(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at every place; bytes before a text's start count as zero."""
    own = raw.astype(np.uint32) + np.uint32(1)
    total, starts, size = own.copy(), ends[:-1], np.diff(ends)
    factor = 1
    for back in range(1, WINDOW):
        factor = factor * 0x01000193 & 0xFFFFFFFF
        part = own[:-back] * np.uint32(factor)
        total[back:] += part
        for k in range(back):  # what a text's first places got from the text before
            at = starts[(size > k) & (starts + k >= back)] + k
            total[at] -= part[at - back]
    return _mixed(total)


class Signatures:
    """Symbols of many texts at their level and the next one: levels, and for both symbols and offsets."""

    def __init__(self, level: np.ndarray, low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray]):
        self.level, self.low, self.high = level, low, high

    def strings(self) -> list[str]:
        a, b = (_SYMBOLS[s].tobytes().decode() for s, _ in (self.low, self.high))
        x, y = self.low[1].tolist(), self.high[1].tolist()
        return [f"{1 << k}:{a[x[i] : x[i + 1]]}:{b[y[i] : y[i + 1]]}" for i, k in enumerate(self.level.tolist())]

    @classmethod
    def parsed(cls, strings: list[str]) -> Signatures:
        parts = [s.split(":") for s in strings]
        packed = []
        for k in (1, 2):
            raw = "".join(p[k] for p in parts).encode()
            table = np.zeros(256, np.int64)
            table[list(_SYMBOL_OF)] = list(_SYMBOL_OF.values())
            packed.append((table[np.frombuffer(raw, np.uint8)], np.cumsum([0, *(len(p[k]) for p in parts)])))
        return cls(np.array([int(p[0]).bit_length() - 1 for p in parts], np.int64), *packed)


def signatures(texts: pa.Array) -> Signatures:
    raw, ends = text_bytes(texts)
    size, n = np.diff(ends), len(texts)
    h = rolling(raw, ends)
    summed = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(h, dtype=np.uint64, out=summed[1:])
    first = np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / LONGEST)).astype(np.int64) - 1)
    limit = (np.uint64(1) << (np.uint64(32) - first.astype(np.uint64))) - np.uint64(1)
    at = np.flatnonzero(h <= np.repeat(limit.astype(np.uint32), size))
    zeros = 32 - np.frexp(h[at].astype(np.float64))[1].astype(np.int64)
    doc = np.searchsorted(ends, at, side="right") - 1
    seen = np.bincount(doc * 34 + zeros, minlength=n * 34).reshape(n, 34)
    reach = seen[:, ::-1].cumsum(1)[:, ::-1]  # places with at least so many zero bits
    fits = (reach < LONGEST) & (np.arange(34) >= first[:, None])
    fits[:, 33] = True
    level = fits.argmax(1)
    out = []
    for k in (level, level + 1):
        keep = zeros >= k[doc]
        cut = at[keep] + 1
        cut = np.union1d(cut, ends[1:][size > 0])  # the last chunk ends with the text
        owner = np.searchsorted(ends, cut, side="left") - 1
        before = np.concatenate([[0], cut[:-1]]) if len(cut) else cut
        value = (summed[cut] - summed[before]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((value >> np.uint64(58)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])))
    return Signatures(level, *out)


def _distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pick: np.ndarray) -> np.ndarray:
    """Edit distances of the picked pairs, all pairs at once, a column of 64 bits a step."""
    m, n = (np.diff(x[1])[pick] for x in (a, b))
    rows = np.arange(len(pick))
    has = np.zeros((len(pick), 64), np.uint64)
    for i in range(int(m.max(initial=0))):
        live = rows[m > i]
        has[live, a[0][a[1][pick[live]] + i]] |= np.uint64(1 << i)
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    up, down = np.full(len(pick), full), np.zeros(len(pick), np.uint64)
    score, last = m.copy(), np.maximum(m - 1, 0).astype(np.uint64)
    for j in range(int(n.max(initial=0))):
        live = rows[(n > j) & (m > 0)]
        eq, pv, mv, top = has[live, b[0][b[1][pick[live]] + j]], up[live], down[live], last[live]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[live] += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        ph = (ph << one) | one
        mh = mh << one
        up[live], down[live] = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, n, score)


def likenesses(a: Signatures, b: Signatures) -> np.ndarray:
    """How alike the fingerprints are pair by pair, 0 to 1."""
    out = np.zeros(len(a.level))
    for apart, x, y in ((0, a.low, b.low), (0, a.high, b.high), (1, a.high, b.low), (-1, a.low, b.high)):
        pick = np.flatnonzero(b.level - a.level == apart)
        if len(pick):
            longest = np.maximum(np.diff(x[1])[pick], np.diff(y[1])[pick])
            alike = np.where(longest == 0, 1.0, 1 - _distance(x, y, pick) / np.maximum(longest, 1))
            out[pick] = np.maximum(out[pick], alike)
    return out


def fingerprint(text: Column | str) -> Column:
    """Column expression: the fingerprint of a whole text."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s for _, part in utf8_parts(no_nulls(batch), 256 << 10) for s in signatures(part).strings()], pa.string())

    return of(text)


def likeness(a: Column, b: Column) -> Column:
    """Column expression: how alike two fingerprints are, 0 to 1."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(likenesses(Signatures.parsed(x.to_pylist()), Signatures.parsed(y.to_pylist())), pa.float64())

    return of(a, b)


def edited_text(text: str, after: str) -> str:
    """The text, its last half replaced by as many first characters of the other (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _strings(texts: list[str]) -> list[str]:
    return [s for _, part in utf8_parts(pa.array(texts, pa.large_string()), 256 << 10) for s in signatures(part).strings()]


def _compared(ids: list, texts: list[str], after: list[str]) -> dict[str, list]:
    cut = [edited_text(t, a) for t, a in zip(texts, after)]
    follows = texts[1:] == after[:-1]  # each text's next one is the next row's: one fingerprint serves both
    own, new, nxt = (_strings(x) for x in (texts, cut, after[-1:] if follows else after))
    nxt = own[1:] + nxt if follows else nxt
    a, b, c = (Signatures.parsed(x) for x in (own, new, nxt))
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in cut],
        "fingerprint": own, "edited_fingerprint": new, "near_edited": likenesses(a, b).tolist(), "near_next": likenesses(a, c).tolist(),
    }


def compared_to_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document, by descending id.

    Order: descending id, null ids last, equal ids by a hash of the text. After the last comes the
    first. Rows are dealt by ranges of that order and sorted; each task compares neighbours and
    hands on its first and last row, which meet by the tasks' numbers, as the next task's first row
    follows a task's last. A table of one row follows itself; an empty one gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.asc("text")).select("doc_id", "text")
    names = [x.split()[0] for x in _OUT.split(", ")]
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in _OUT.split(", ")] + [("task", pa.int64()), ("edge", pa.string()), ("text", pa.string())])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if held is None and ids:
                yield edge(task, "first", ids[0], texts[0])
            elif held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if not ids:
                continue
            held = ids[-1], texts[-1]
            got = _compared(ids[:-1], texts[:-1], texts[1:])
            none = [None] * (len(ids) - 1)
            yield pa.RecordBatch.from_pydict(got | {"task": none, "edge": none, "text": none}, schema)
        if held is not None:
            yield edge(task, "last", *held)

    def edge(task: int, kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [None] for n in names} | {"doc_id": [doc_id], "task": [task], "edge": [kind], "text": [text]}, schema)

    met = written(dealt.mapInArrow(neighbours, f"{_OUT}, task long, edge string, text string"), "fingerprints")
    tasks = sorted(r["task"] for r in met.where("edge = 'first'").select("task").collect())  # one number a task
    follows = spark.createDataFrame(list(zip(tasks, [*tasks[1:], *tasks[:1]])), "task long, next_task long")
    first = met.where("edge = 'first'").select(F.col("task").alias("next_task"), F.col("text").alias("after"))
    last = met.where("edge = 'last'").select("task", "doc_id", "text").join(follows, "task").join(first, "next_task")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(_compared(*(c.to_pylist() for c in batch.columns)), pa.schema(list(schema)[:-3]))

    return met.where("edge is null").select(*names).unionByName(last.select("doc_id", "text", "after").mapInArrow(ends, _OUT))

