"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table (hashed words, multinomial per domain) gives each document
a posterior over the domains, so a text of two languages counts for both. Rates are fitted so that
the expected tokens of each domain, ``sum(rate * tokens * posterior)``, come to the targets: least
squares by projected gradient, starting from a rate of 1, each step scaled by the domain's tokens and
cut off at 0. The gradient is one distributed sum a step. Posteriors are rounded to hundredths, and a
rate depends on nothing but the posterior, so the steps run over the table of distinct posteriors,
whose size the grid bounds, and not over the documents.

A rate becomes copies by adding a hash of the id in [0, 1) and cutting off the fraction, so the
expected number of copies is the rate. Without a budget the total is the smallest that shrinks no
domain: documents are repeated and none is lost.

Null text counts as empty. A text without words has the domains' shares in the sample as posterior
and no tokens. Domains without a target get 0; targets of unknown domains are left out. Without
labelled rows every rate is 1. Repeated rows get equal rates, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm import spans as S
from corpus_search.llm.common import fresh, labelled_sample, written

BUCKETS = 1 << 12
#: Evidence of so many words at most counts: beyond, a posterior would be 0 or 1 for any text.
EVIDENCE = 24
STEPS = 25
CLOSE = 1e-3


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Classifier:
    """Domains, their shares in the sample, and for each the log-chances of the buckets against their mean."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    logs: tuple[tuple[float, ...], ...]


def fit_classifier(labelled: DataFrame, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> Classifier:
    """Learn from at most ``max_rows`` labelled rows, a quota of each domain, chosen by a hash.

    A domain's share is that of its words in all labelled rows, as the sample's rows of it have them.
    """
    known = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), F.col(domain_col).cast("string").alias("_y"))
    picked, rows = labelled_sample(known.where(F.col("_y").isNotNull() & F.col("_t").isNotNull()), max_rows, "mix")
    picked = written(picked, "mix-sample")
    drawn = {r["_y"]: r["n"] for r in picked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    counted = picked.select(F.col("_y").alias("d"), F.explode(F.transform(words(F.col("_t")), _bucket)).alias("b")).groupBy("d", "b").agg(F.count("*").alias("n")).collect()
    domains = tuple(sorted({r["d"] for r in counted}))
    counts = {d: [0.5] * BUCKETS for d in domains}
    for r in counted:
        counts[r["d"]][r["b"]] += r["n"]
    sums = {d: sum(c) for d, c in counts.items()}
    logs = [[math.log(x / sums[d]) for x in counts[d]] for d in domains]
    mean = [sum(x) / len(domains) for x in zip(*logs)]
    weight = {d: sums[d] * rows[d] / drawn[d] for d in domains}
    whole = sum(weight.values())
    return Classifier(domains, tuple(weight[d] / whole for d in domains), tuple(tuple(round(x - m, 3) for x, m in zip(row, mean)) for row in logs))


def membership(text: Column, model: Classifier) -> Column:
    """struct(n_tokens, posterior) of a text, the posterior in hundredths in the order of the domains."""
    tables = [F.split(F.lit(",".join(f"{x:g}" for x in row)), ",").cast("array<double>") for row in model.logs]

    def of(w: Column) -> Column:
        n = F.size(w)
        zero = F.struct(*(F.lit(0.0).alias(f"s{k}") for k in range(len(tables))))
        sums = F.aggregate(
            F.transform(w, _bucket), zero, lambda a, b: F.struct(*((a[f"s{k}"] + F.get(t, b)).alias(f"s{k}") for k, t in enumerate(tables)))
        )
        scale = F.when(n > 0, F.least(n, F.lit(EVIDENCE)) / n).otherwise(0.0)

        def soft(s: Column) -> Column:
            logits = [s[f"s{k}"] * scale + math.log(p) for k, p in enumerate(model.prior)]
            top = F.greatest(*logits) if len(logits) > 1 else logits[0]
            parts = F.array(*(F.exp(x - top) for x in logits))
            return S.let(parts, lambda x: F.transform(x, lambda v: F.round(v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b), 2)))

        return F.struct(n.cast("long").alias("n_tokens"), S.let(sums, soft).alias("posterior"))

    return S.let(words(text), of)


def _rate(posterior: Column, steps: list[list[float]]) -> Column:
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(posterior[k] * x for k, x in enumerate(step)))
    return rate


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], budget: float | None = None) -> list[list[float]]:
    """Steps of the projected gradient from ``members`` (n_tokens, posterior); their fold gives a posterior's rate."""
    grid = written(members.groupBy("posterior").agg(F.sum("n_tokens").cast("double").alias("n")), "mix-grid")
    p = F.col("posterior")

    def totals(steps: list[list[float]]) -> list[float]:
        rate = _rate(p, steps)
        row = grid.agg(*(F.sum(F.col("n") * rate * p[k]).alias(f"e{k}") for k in range(len(domains)))).first()
        return [float(x or 0.0) for x in row]

    have = totals([])
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if not sum(wanted) or not sum(have):
        return []
    wanted = [w / sum(wanted) for w in wanted]
    total = budget if budget is not None else max(e / w for e, w in zip(have, wanted) if w)
    goal, steps, now = [w * total for w in wanted], [], have
    for _ in range(STEPS):
        if max(abs(e - g) for e, g in zip(now, goal)) <= CLOSE * total:
            break
        steps = [*steps, [(e - g) / h if h else 0.0 for e, g, h in zip(now, goal, have)]]
        now = totals(steps)
    return steps


def mix(
    docs: DataFrame, model: Classifier, targets: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``posterior``, ``rate`` and ``copies``; other columns are not read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if not model.domains:
        plain = docs.select(F.col(id_col), F.size(words(text)).cast("long").alias("n_tokens"))
        return plain.select(id_col, "n_tokens", F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    members = written(docs.select(F.col(id_col), membership(text, model).alias("_m")).select(id_col, "_m.n_tokens", "_m.posterior"), "mix-members")
    steps = fit_rates(members, model.domains, targets, budget)
    rated = members.withColumn("rate", _rate(F.col("posterior"), steps))
    return rated.select(id_col, "n_tokens", "posterior", "rate", _copies(F.col("rate"), F.col(id_col)).alias("copies"))


def _copies(rate: Column, key: Column) -> Column:
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)).cast("long")


def repeat(docs: DataFrame, model: Classifier, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, each row as often as its rate says and once at least."""
    if not model.domains:
        return docs
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name, copy = fresh(docs, stem="_mix"), fresh(docs, stem="_copy")
    members = written(docs.withColumn(name, membership(text, model)), "mix-members")
    steps = fit_rates(members.select(f"{name}.*"), model.domains, targets)
    times = F.greatest(F.lit(1), _copies(_rate(F.col(name)["posterior"], steps), F.col(id_col))).cast("int")
    return members.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
