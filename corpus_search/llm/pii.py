"""Personal data in texts: base formats, and candidates judged by boosted trees.

Generators with high recall propose spans that may overlap (anything around an at-sign, addresses
spelt out, runs of digits with and without blanks). Each candidate has small whole-number features
of its format (digits, separators, groups, brackets) and its context (neighbouring characters, words
before it that announce such data or something else). Gradient-boosted trees of depth two learn
which features go with personal data. A candidate is right if it overlaps a base span, or if its normal
form (spelt signs as signs, a phone number with its plus, letters beyond ASCII as letters) has a base
format and its context or its own form speaks for it; a grouped number of a base format whose context
says nothing counts neither way, and the others are wrong. The leading plus sign isn't a feature, so
that the same digits and groups without it are found too. Features are counted over all documents first (the table of feature values is
bounded by the product of their ranges) and the trees are fitted to those counts. Per generator the
threshold is the least score at which the wanted share of calibration candidates is right. Scoring
is one native expression a candidate.

Null text counts as empty and has no spans. Spans are places in code points, ends exclusive; base
spans all stay, and a candidate's span is added unless a base span overlaps it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm import spans as S
from corpus_search.llm.common import crc_mod

# The base formats. Each is written so that it runs once over its characters:
# a match can only begin where the run of its first characters begins, or a match has just ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"
CARD = r"[0-9][0-9\x20-]*?(?=[\x20-]{2}|[\x20-]?+(?:[^0-9\x20-]|\z))"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators of candidates: kind, pattern, pattern of a cheap test of a text.
GENERATORS = (
    ("maybe_email", r"(?<![^\s@<>,;()])[^\s@<>,;()]++@[^\s@<>,;()]++", "@"),
    ("maybe_spelt", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,}+", r"(?i)[(\[]at[)\]]"),
    ("maybe_number", r"(?<![0-9A-Za-z])[+(]?[0-9][0-9().\x20/-]*[0-9]", ""),
    ("maybe_code", r"(?<![0-9A-Za-z.-])[0-9][0-9.-]*[0-9](?![0-9A-Za-z])", ""),
)
TAIL = r"(?:\W{1,3}(?:me|us|at|on|is|to|number|no|nr))*\W{0,3}$"
CONTEXT = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|account|iban|ip|host|mail|contact|write)" + TAIL
#: Words that announce a number of another sort.
OTHER = r"(?i)(?<![a-z])(?:order|invoice|ref|reference|version|date|isbn|serial|ticket|id|total|page)" + TAIL
#: Features and the number of values of each.
FEATURES = (("digits", 8), ("marks", 6), ("groups", 6), ("last_group", 6), ("bracket", 3), ("letters", 4), ("dots", 4), ("before", 3), ("after", 3), ("told", 3), ("check", 2))
PLACE = {name: i for i, (name, _) in enumerate(FEATURES)}


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    back = F.reverse(digits)

    def part(i: Column) -> Column:
        v = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base formats, by start."""
    ip = F.filter(S.matches(text, IP, "ip", 1), lambda s: s["part"].rlike(OCTETS))

    def card_ok(s: Column) -> Column:
        digits = F.translate(s["part"], " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)

    card = F.filter(S.matches(text, CARD, "card", 2), card_ok)
    phone = F.filter(
        S.matches(text, PHONE, "phone", 3), lambda s: F.length(F.translate(s["part"], "+ ().-", "")).between(9, 15)
    )
    return S.ordered(
        S.when_any(F.contains(text, F.lit("@")), S.matches(text, EMAIL, "email", 0)),
        S.when_any(text.rlike(IP), ip),
        S.when_any(text.rlike(r"(?:[0-9][\x20-]?+){11}[0-9]"), card),
        S.when_any(F.contains(text, F.lit("+")), phone),
    )


#: Characters before a candidate that may announce it.
LEAD = 24


def candidates(text: Column) -> Column:
    """All proposals of all generators (``span``) with their features (``x``)."""
    proposed = []
    for rank, (kind, pattern, needs) in enumerate(GENERATORS, len(KINDS)):
        found = S.matches_around(text, pattern, kind, rank, LEAD)
        none = F.array().cast(f"array<struct<span: {S.SPAN[6:-1]}, lead: string, after: string>>")
        if needs:
            proposed.append(F.when(text.rlike(needs) & text.rlike(pattern), found).otherwise(none))
        else:
            enough = F.filter(found, lambda s: F.length(F.regexp_replace(s["span"]["part"], "[^0-9]", "")).between(7, 19))
            proposed.append(F.when(text.rlike(r"(?:[0-9][().\x20/-]*+){6}[0-9]"), enough).otherwise(none))
    return F.transform(F.concat(*proposed), lambda s: F.struct(s["span"].alias("span"), features(s).alias("x")))


def features(c: Column) -> Column:
    """The small whole numbers that describe a candidate, as an array in the order of FEATURES."""
    s, lead, after = c["span"], c["lead"], c["after"]
    part = s["part"]
    digits = F.length(F.regexp_replace(part, "[^0-9]", ""))
    groups = F.filter(F.split(part, "[^0-9]+"), lambda g: g != "")
    marks = F.length(F.regexp_replace(part, r"[^().\x20/-]", ""))
    letters = F.length(F.regexp_replace(part, r"[^A-Za-z]", ""))
    dots = F.length(F.regexp_replace(part, r"[^.]", ""))
    last = F.when(F.size(groups) > 0, F.length(F.element_at(groups, -1))).otherwise(0)
    before = F.right(lead, F.lit(1))

    def side(c: Column) -> Column:
        return F.when(c.rlike(r"^[\p{L}\p{N}_]$"), 2).when(c.rlike(r"^\S$"), 1).otherwise(0)

    values = {
        "digits": F.least(F.greatest(digits - 6, F.lit(0)), F.lit(7)), "marks": F.least(marks, F.lit(5)), "groups": F.least(F.size(groups), F.lit(5)),
        "last_group": F.least(last, F.lit(5)), "bracket": F.when(s["kind"] == "maybe_spelt", 2).otherwise(F.contains(part, F.lit("(")).cast("int")), "letters": F.least((letters / 4).cast("int"), F.lit(3)),
        "dots": F.least(dots, F.lit(3)), "before": side(before), "after": side(after), "told": F.when(lead.rlike(CONTEXT), 2).when(lead.rlike(OTHER), 0).otherwise(1),
        "check": F.when(digits.between(12, 19), luhn(F.regexp_replace(part, "[^0-9]", ""))).otherwise(False).cast("int"),
    }
    return F.array(*(values[name] for name, _ in FEATURES))


def with_overlaps(found: Column) -> Column:
    """The candidates of struct(base, more) with ``taken``: whether a base span overlaps them."""
    hits = S.overlapping(F.transform(found["more"], lambda c: c["span"]), found["base"])
    return F.zip_with(found["more"], hits, lambda c, h: F.struct(c["span"].alias("span"), c["x"].alias("x"), h.alias("taken")))


def evidence(c: Column) -> Column:
    """Whether a candidate is personal data, as far as base spans, its normal form and its context tell; null if they don't."""
    span, part, x = c["span"], c["span"]["part"], c["x"]
    told = x[PLACE["told"]]
    mail = F.regexp_replace(part, r"[^\x00-\x7f]", "x").rlike(EMAIL)
    signs = F.regexp_replace(F.regexp_replace(part, r"(?i)\x20?[(\[]at[)\]]\x20?", "@"), r"(?i)\x20?[(\[]dot[)\]]\x20?", ".")
    # a point with a blank beside it may end a sentence
    spelt = F.translate(signs, " ", "").rlike(f"^(?:{EMAIL})$") & (~F.contains(signs, F.lit(" ")) | (told == 2))
    digits = F.regexp_replace(part, "[^0-9]", "")
    phone = F.concat(F.lit("+"), F.translate(F.regexp_replace(part, r"^[+(]+", ""), "/", "-")).rlike(f"^(?:{PHONE})$") & F.length(digits).between(9, 15)
    formed = phone | (x[PLACE["check"]] == 1)
    number = F.when(~formed | (told == 0), False).when(told == 2, True).when(x[PLACE["groups"]] < 2, False)
    return F.when(c["taken"], True).when(span["kind"] == "maybe_email", mail).when(span["kind"] == "maybe_spelt", spelt).otherwise(number)


@dataclass(frozen=True)
class Model:
    """Trees as (feature, bound, feature below, bound, feature above, bound, four leaves); least score by kind."""

    start: float
    trees: list[tuple]
    least: dict[str, float]


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def boost(rows: list[tuple[list[int], float, float]], rounds: int = 25, rate: float = 0.3, smooth: float = 1.0) -> tuple[float, list[tuple]]:
    """Newton boosting of depth-two trees for log-loss on (features, right, wrong) counts."""
    right, wrong = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = math.log((right + 0.5) / (wrong + 0.5))
    score, trees = [start] * len(rows), []

    def best(part: list[int], grad: list[float], hess: list[float]) -> tuple[float, int, int]:
        top = (-1.0, 0, 0)
        whole_g, whole_h = sum(grad[i] for i in part), sum(hess[i] for i in part)
        for f, (_, values) in enumerate(FEATURES):
            g, h = [0.0] * values, [0.0] * values
            for i in part:
                g[rows[i][0][f]] += grad[i]
                h[rows[i][0][f]] += hess[i]
            low_g = low_h = 0.0
            for bound in range(values - 1):
                low_g, low_h = low_g + g[bound], low_h + h[bound]
                gain = low_g**2 / (low_h + smooth) + (whole_g - low_g) ** 2 / (whole_h - low_h + smooth)
                if gain > top[0] + 1e-12:
                    top = (gain, f, bound)
        return top

    for _ in range(rounds if rows else 0):
        p = [_sigmoid(s) for s in score]
        grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(rows, p)]
        hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p)]
        _, f, b = best(list(range(len(rows))), grad, hess)
        sides, tree, leaves = ([], []), [f, b], []
        for i, r in enumerate(rows):
            sides[r[0][f] > b].append(i)
        for part in sides:
            _, f2, b2 = best(part, grad, hess)
            tree += [f2, b2]
            for above in (False, True):
                leaf = [i for i in part if (rows[i][0][f2] > b2) == above]
                value = rate * sum(grad[i] for i in leaf) / (sum(hess[i] for i in leaf) + smooth)
                leaves.append(round(value, 6))
                for i in leaf:
                    score[i] += value
        trees.append((*tree, *leaves))
    return start, trees


def tree_score(start: float, trees: list[tuple], x: list[int]) -> float:
    total = start
    for f, b, f0, b0, f1, b1, *leaf in trees:
        total += leaf[x[f0] > b0] if x[f] <= b else leaf[2 + (x[f1] > b1)]
    return total


def score_column(model: Model, x: Column) -> Column:
    """The trees' sum as a native expression of the feature array."""
    total = F.lit(model.start)
    for f, b, f0, b0, f1, b1, *leaf in model.trees:
        low = F.when(x[f0] <= b0, leaf[0]).otherwise(leaf[1])
        high = F.when(x[f1] <= b1, leaf[2]).otherwise(leaf[3])
        total = total + F.when(x[f] <= b, low).otherwise(high)
    return total


def fit(docs: DataFrame, precision: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trees from the candidates of all documents; thresholds from the fifth of them set aside by id.

    What comes to the driver is one row for each combination of feature values that occurs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def judged(found: Column) -> Column:
        return F.transform(with_overlaps(found), lambda c: F.struct(c["span"]["kind"].alias("kind"), c["x"].alias("x"), evidence(c).alias("right")))

    found = S.let(F.struct(base_spans(text).alias("base"), candidates(text).alias("more")), judged)
    one = docs.select((crc_mod(F.col(id_col), 5) == 0).alias("aside"), F.explode(found).alias("c"))
    counted = one.where(F.col("c.right").isNotNull()).groupBy("aside", F.col("c.kind").alias("kind"), F.col("c.x").alias("x")).agg(
        F.sum(F.col("c.right").cast("long")).alias("right"), F.sum((~F.col("c.right")).cast("long")).alias("wrong"))
    rows = sorted(((r["aside"], r["kind"], list(r["x"]), float(r["right"]), float(r["wrong"])) for r in counted.collect()), key=repr)
    start, trees = boost([r[2:] for r in rows if not r[0]])
    least = {}
    for kind, _, _ in GENERATORS:
        scored = sorted(((tree_score(start, trees, r[2]), r[3], r[4]) for r in rows if r[0] and r[1] == kind), reverse=True)
        right = wrong = 0.0
        least[kind] = math.inf
        for k, (value, a, b) in enumerate(scored):
            right, wrong = right + a, wrong + b
            if (k + 1 == len(scored) or scored[k + 1][0] < value) and right and right / (right + wrong) >= precision:
                least[kind] = value
        least[kind] = max(least[kind], 0.0)  # a candidate is at least as likely right as wrong
    return Model(start, trees, least)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``base`` and ``every`` (spans with start, kind, stop and the text found)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def chosen(c: Column) -> Column:
        least = F.lit(1e300)
        for kind, value in model.least.items():
            if value < math.inf:
                least = F.when(c["span"]["kind"] == kind, value).otherwise(least)
        return ~c["taken"] & (score_column(model, c["x"]) >= least)

    def apart(spans: Column) -> Column:
        """Of overlapping proposals the first, and the longest of those, stays."""
        by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(
            a["stop"] != b["stop"], b["stop"] - a["stop"]).otherwise(a["rank"] - b["rank"]))
        return S.apart(by_place)

    def both(found: Column) -> Column:
        picked = F.transform(F.filter(with_overlaps(found), chosen), lambda c: c["span"])
        return F.struct(found["base"].alias("base"), S.ordered(found["base"], apart(picked)).alias("every"))

    found = S.let(F.struct(base_spans(text).alias("base"), candidates(text).alias("more")), both)
    return docs.select(F.col(id_col), found.alias("_found")).select(id_col, "_found.base", "_found.every")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the base spans' digest and all spans as text."""
    base = F.col("base")
    return found.select(
        id_col, *(S.of_kind(base, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(S.joined(base).cast("binary"), 256).alias("base_sha256"), S.joined(F.col("every")).alias("spans"),
    )
