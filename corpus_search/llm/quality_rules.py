"""Quality rules: surface counts, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word 1- and 2-grams are counted: the raw corpus (all texts) and a
trusted target (all texts labelled good).
A document's score is the mean over its n-grams of ``log(p_target / p_raw)`` with additive
smoothing, so it doesn't depend on length. A text that the target counted scores higher than a new one
like it, so the threshold comes from texts that weren't counted: the trusted are dealt into ``FOLDS`` by
their ids, and each is scored by a target without its own fold. The threshold is the score that all but
``lost`` of them reach, less ``margin`` of its distance from their median; the model itself counts all
trusted texts, and every document is judged by it. All is native: n-grams are hashed in the row, only
bucket counts are shuffled, and the weights are arrays of ``BUCKETS`` numbers. Trusted texts are found
by their ids, broadcast in at most ``SCANS`` slices of a counted size with a scan of the documents for
each, so that texts are neither shuffled nor stored; beyond that many ids the texts are joined by a shuffle.

Null text counts as empty. A text without words scores 0; the base rule rejects it. Without trusted
texts every score is 0 and only the base rule decides; texts that are all in one fold have nothing to be
scored by and give no threshold. Repeated rows are judged alike, and count as often as they are there.
Without documents the result is empty. Null ids have no label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm import spans as S
from corpus_search.llm.common import crc_mod, written

# White space that parts words, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

BUCKETS = 1 << 14
FOLDS = 5
#: Bytes of a trusted id in a broadcast, of a broadcast, and how many scans of the documents the slices may take.
ID_BYTES = 64
SLICE_BYTES = 128 << 20
SCANS = 4


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")


def _without(text: Column, symbols: str) -> Column:
    for c in symbols:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(_without(x, SPACE[1:]))) > 0)
    return S.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(word_list: Column) -> Column:
    """Words that lie in a window of three words which the text has twice or more."""
    starts = F.when(F.size(word_list) >= 3, F.sequence(F.lit(0), F.size(word_list) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(word_list[i], word_list[i + 1], word_list[i + 2]))

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places, zero, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"]
        )

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        twice = S.let(
            pairs, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(F.sort_array(F.transform(twice, lambda x: x["at"]))))

    return S.let(windows, count)


def buckets(word_list: Column) -> Column:
    """Hash buckets of all 1- and 2-grams."""
    ones = F.transform(word_list, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    starts = F.when(F.size(word_list) >= 2, F.sequence(F.lit(0), F.size(word_list) - 2)).otherwise(F.array().cast("array<int>"))
    twos = F.transform(starts, lambda i: F.pmod(F.xxhash64(word_list[i], word_list[i + 1]), F.lit(BUCKETS)).cast("int"))
    return F.concat(ones, twos)


@dataclass(frozen=True)
class Model:
    """The weight of each bucket, and the least score of a document that stays."""

    weights: tuple[float, ...]
    least: float

    def column(self) -> Column:
        """The weights as a constant array (BUCKETS numbers of a few digits)."""
        return _column(self.weights)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def score(word_list: Column, weights: Column) -> Column:
    """Mean weight of a text's n-grams; 0 without any."""
    total = F.aggregate(buckets(word_list), F.lit(0.0), lambda a, b: a + F.get(weights, b))
    return F.when(F.size(word_list) > 0, total / (2 * F.size(word_list) - 1)).otherwise(F.lit(0.0))


def _of_trusted(texts: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``_id`` is one of the distinct ids ``good``."""
    slices = max(1, math.ceil(good.count() * ID_BYTES / SLICE_BYTES))
    if slices > SCANS:
        return written(texts.join(good, "_id", "left_semi"), "trusted")
    found = [texts.join(F.broadcast(good.where(F.pmod(F.xxhash64("_id"), F.lit(slices)) == k)), "_id", "left_semi") for k in range(slices)]
    return reduce(DataFrame.unionByName, found)


def _weights(target: list[int], raw: list[int], smooth: float) -> tuple[float, ...]:
    """The log ratio of both multinomials by bucket; without a target all 0."""
    t, r = sum(target), sum(raw)
    if not t:
        return (0.0,) * len(raw)
    weights = []
    for a, b in zip(target, raw):
        # shares of the same total smoothing: an empty bucket says nothing for either side
        q = (b + smooth) / (r + smooth * len(raw))
        weights.append(math.log((a + smooth * q * len(raw)) / (t + smooth * len(raw)) / q))
    return tuple(weights)


def _column(weights: tuple[float, ...]) -> Column:
    """Weights as a constant array, of a few digits each."""
    return F.split(F.lit(",".join(f"{x:.4g}" for x in weights)), ",").cast("array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, lost: float = 0.001, margin: float = 0.25, smooth: float = 1.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Count both multinomials over whole texts and calibrate the threshold on the trusted ones, each by the other folds."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    good = written(good, "trusted-ids")
    text = docs.select(F.col(id_col).alias("_id"), _text(text_col).alias("_t"))
    trusted = _of_trusted(text, good).select("_t", crc_mod(F.col("_id"), FOLDS).alias("fold"))

    def counted(texts: DataFrame, *by: str) -> list:
        """Counts by bucket (and fold): BUCKETS rows, times the folds."""
        return texts.select(*by, F.explode(S.let(words(F.col("_t")), buckets)).alias("bucket")).groupBy(*by, "bucket").agg(F.count("*").alias("n")).collect()

    raw, by_fold = [0] * BUCKETS, [[0] * BUCKETS for _ in range(FOLDS)]
    for r in counted(text):
        raw[r["bucket"]] = r["n"]
    for r in counted(trusted, "fold"):
        by_fold[r["fold"]][r["bucket"]] = r["n"]
    target = [sum(n) for n in zip(*by_fold)]
    model = Model(_weights(target, raw, smooth), -1e300)
    rests = [[t - n for t, n in zip(target, fold)] for fold in by_fold]
    judged = [k for k in range(FOLDS) if any(by_fold[k]) and any(rests[k])]
    if not judged:
        return model
    others = F.coalesce(*(F.when(F.col("fold") == k, _column(_weights(rests[k], raw, smooth))) for k in judged))
    scores = trusted.where(F.col("fold").isin(judged)).select(S.let(words(F.col("_t")), lambda w: F.when(F.size(w) > 0, S.let(others, lambda o: score(w, o)))).alias("s"))
    low, mid = scores.agg(F.percentile_approx("s", F.array(F.lit(lost), F.lit(0.5)), 10_000).alias("x")).first()["x"]
    return Model(model.weights, low - margin * (mid - low))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, the counts, ``base_failed``, ``score`` and ``kept``; other columns are not read."""
    text = _text(text_col)
    weights = model.column()

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), score(w, weights).alias("score")
        )

    one = docs.select(
        F.col(id_col), F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"), S.let(words(text), counts).alias("_n"),
    )
    n, r = F.col("_n.n_words"), F.col("_n.n_repeat_words")
    failed = (n < 50) | (100 * r > 50 * n)
    return one.select(
        id_col, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"),
        failed.alias("base_failed"), F.col("_n.score").alias("score"), (~failed & (F.col("_n.score") >= model.least)).alias("kept"),
    )
