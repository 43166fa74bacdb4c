"""Spans of pattern matches as native column expressions: places in code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: where it begins and ends, its kind, the kind's rank among equal starts, and its text.
SPAN = "array<struct<start: int, rank: int, kind: string, stop: int, part: string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that a fold copies with each step: long arrays are folded block by block, so that the cost isn't quadratic.
BLOCK = 64


def blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(items, at + 1, BLOCK))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column, kind: str) -> Column:
    """For each element all those before it combined (``combine`` must be associative, ``zero`` its neutral element)."""

    def prefixes(items: Column) -> Column:
        start = F.struct(zero.cast(kind).alias("all"), F.array().cast(f"array<{kind}>").alias("before"))
        return F.aggregate(items, start, lambda a, v: F.struct(combine(a["all"], v).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    def joined_up(parts: Column) -> Column:
        heads = prefixes(F.transform(parts, lambda p: p["all"]))["before"]
        return F.flatten(F.zip_with(parts, heads, lambda p, h: F.transform(p["before"], lambda x: combine(h, x))))

    return let(values, lambda v: let(F.transform(blocks(v), prefixes), joined_up))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _pairs(text: Column, pattern: str) -> Column:
    """Matches (``part``) with what lies between them and the one before (``piece``), and the piece after the last."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(a.alias("piece"), b.alias("part")))


def _span(pair: Column, before: Column, kind: str, rank: int) -> Column:
    start = before + F.length(pair["piece"])
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(pair["part"])).alias("stop"), pair["part"].alias("part"))


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches of a pattern (of one character at least) as spans.

    The pieces between the matches and the matches themselves alternate, so a match begins where the
    pieces and matches before it end.
    """

    def spans(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.length(p["piece"]) + F.length(p["part"])), _plus, F.lit(0), "int")
        return F.zip_with(pairs, ends, lambda p, e: _span(p, e, kind, rank))

    # the piece after the last match has no match with it
    return let(F.filter(_pairs(text, pattern), lambda p: p["part"].isNotNull()), spans)


def matches_around(text: Column, pattern: str, kind: str, rank: int, width: int) -> Column:
    """Matches as structs of ``span``, ``lead`` (the ``width`` characters before it) and ``after`` (the next character)."""
    empty = F.lit("")

    def tail(a: Column, b: Column) -> Column:
        return F.right(F.concat(a, b), F.lit(width))

    def spans(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: F.length(p["piece"]) + F.length(F.coalesce(p["part"], empty))), _plus, F.lit(0), "int")
        tails = running(F.transform(pairs, lambda p: F.right(F.concat(p["piece"], F.coalesce(p["part"], empty)), F.lit(width))), tail, empty, "string")

        def around(p: Column, i: Column) -> Column:
            following = F.get(pairs, i + 1)
            return F.struct(p.alias("pair"), F.left(F.concat(following["piece"], F.coalesce(following["part"], empty)), F.lit(1)).alias("after"))

        with_after = F.transform(pairs, around)
        full = F.zip_with(F.zip_with(with_after, ends, lambda p, e: F.struct(p.alias("p"), e.alias("e"))), tails, lambda x, t: F.struct(
            _span(x["p"]["pair"], x["e"], kind, rank).alias("span"), F.right(F.concat(t, x["p"]["pair"]["piece"]), F.lit(width)).alias("lead"), F.coalesce(x["p"]["after"], empty).alias("after")))
        return F.filter(full, lambda x: x["span"]["part"].isNotNull())

    return let(_pairs(text, pattern), spans)


def when_any(condition: Column, spans: Column) -> Column:
    """The spans where a cheap test says that there can be any."""
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def ordered(*spans: Column) -> Column:
    """All spans by start, then kind rank."""
    return F.sort_array(F.concat(*spans))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _marked(spans: Column, base: Column, key: str, first: int) -> Column:
    """For each span (by its place ``i``) the largest stop of the base spans that start before its ``key``.

    ``first`` is 0 if a base span that starts at the key itself counts, else 1.
    """
    own = F.transform(spans, lambda s, i: F.struct(s[key].alias("at"), F.lit(1 - first).alias("order"), F.lit(0).alias("stop"), i.alias("i")))
    others = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(first).alias("order"), b["stop"].alias("stop"), F.lit(-1).alias("i")))

    def read(items: Column) -> Column:
        most = running(F.transform(items, lambda x: x["stop"]), _larger, F.lit(0), "int")
        found = F.zip_with(items, most, lambda x, m: F.struct(x["i"].alias("i"), m.alias("most")))
        return F.transform(F.sort_array(F.filter(found, lambda x: x["i"] >= 0)), lambda x: x["most"])

    return let(F.sort_array(F.concat(own, others)), read)


def uncovered(spans: Column, base: Column) -> Column:
    """Spans that don't lie inside a span of the base."""

    def left(s: Column) -> Column:
        pairs = F.zip_with(s, _marked(s, base, "start", 0), lambda x, most: F.struct(x.alias("span"), (most < x["stop"]).alias("free")))
        return F.transform(F.filter(pairs, lambda p: p["free"]), lambda p: p["span"])

    return let(spans, left)


def overlapping(spans: Column, base: Column) -> Column:
    """For each span, in order, whether it overlaps a span of the base."""
    return let(spans, lambda s: F.zip_with(s, _marked(s, base, "stop", 1), lambda x, most: most > x["start"]))


def apart(spans: Column) -> Column:
    """Of spans in order those that begin where no one taken before reaches."""

    def greedy(at: Column, block: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(SPAN).alias("spans"))
        return F.aggregate(block, start, lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["stop"].alias("at"), F.concat(acc["spans"], F.array(s)).alias("spans"))).otherwise(acc))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))

    def step(acc: Column, block: Column) -> Column:
        return let(greedy(acc["at"], block), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["parts"], F.array(g["spans"])).alias("parts")))

    return let(spans, lambda s: F.aggregate(blocks(s), zero, step, lambda acc: F.flatten(acc["parts"])))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each run of overlapping spans (by start)."""

    def regions(s: Column) -> Column:
        """start and stop of each run: a run begins at a span that no one before reaches."""
        before = running(F.transform(s, lambda x: x["stop"]), _larger, F.lit(0), "int")
        heads = F.zip_with(s, before, lambda x, m: F.struct(x["start"].alias("start"), m.alias("reached")))
        found = F.filter(heads, lambda h: h["start"] >= h["reached"])
        last = F.array_max(F.transform(s, lambda x: x["stop"]))
        # a run ends where the next one finds that the ones before have reached
        return let(found, lambda f: F.transform(f, lambda h, i: F.struct(h["start"].alias("start"), F.coalesce(F.get(f, i + 1)["reached"], last).alias("stop"))))

    def cut(runs: Column) -> Column:
        """Each block of runs out of its own stretch of the text, so that no place is looked for from the text's start."""
        parts = blocks(runs)

        def one(block: Column, begin: Column) -> Column:
            def pieces(stretch: Column) -> Column:
                from_ = lambda k: F.when(k > 0, F.get(block, k - 1)["stop"]).otherwise(begin)
                return F.array_join(F.transform(block, lambda r, k: F.concat(stretch.substr(from_(k) - begin + 1, r["start"] - from_(k)), F.lit(mark))), "")

            return let(text.substr(begin + 1, F.element_at(block, -1)["stop"] - begin), pieces)

        def joined_up(p: Column) -> Column:
            done = F.transform(p, lambda block, i: one(block, F.when(i > 0, F.element_at(F.get(p, i - 1), -1)["stop"]).otherwise(0)))
            end = F.element_at(F.element_at(p, -1), -1)["stop"]
            return F.concat(F.array_join(done, ""), text.substr(end + 1, F.length(text)))

        return let(parts, joined_up)

    return F.when(F.size(spans) > 0, let(spans, lambda s: let(regions(s), cut))).otherwise(text)


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
