"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with marks for its ends) and itself, hashed to
rows of an embedding table; its vector is their mean, so a misspelling shares most of its vectors
with the word it comes from. A window of consecutive words is the mean of their vectors, put
through a linear softmax. A text is as toxic as its most toxic window, so that a few words decide
in a short and in a very long text alike; training finds those windows as it goes (each step takes
the window that is worst at that time). Everything is a sum over words, so a whole text costs one
lookup a word and one cumulative sum.

Labels are learnt from a bounded sample (``max_rows`` labelled documents that have words, a quota of
them for each label, chosen by a hash of the id; of a text longer than ``max_chars`` characters a
stretch of that length, placed by a hash); scores are for whole texts. Null text counts as
empty; a text without words has the score of no evidence (the softmax of the bias).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.common import crc_mod, no_nulls, quotas, ranges, text_bytes, utf8_parts, written

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: The mean over a whole text counts so many times while training begins.
WARM = 16.0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words (runs of letters, digits and marks) of texts, and each text's first word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\p{M}@$]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    words, ends = lists.values, np.asarray(lists.offsets, np.int64)
    some = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), kept[ends]


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word's n-grams and of the word itself, and the n + 1 offsets."""
    marked = pc.binary_join_element_wise(*(pa.scalar(x, words.type) if isinstance(x, str) else x for x in ("<", words, ">", "")))
    raw, ends = text_bytes(marked)
    n = len(words)
    begin = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
    owner = np.searchsorted(ends, begin, side="right") - 1
    last = np.append(begin, len(raw))
    # hash of raw[a:b] from sums of powers: the same bytes at another place give the same value
    factor = 0x9E3779B97F4A7C15
    power = np.cumprod(np.append(np.uint64(1), np.full(len(raw), factor, np.uint64)), dtype=np.uint64)
    inverse = np.cumprod(np.append(np.uint64(1), np.full(len(raw), pow(factor, -1, 1 << 64), np.uint64)), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])

    def row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (sums[b] - sums[a]) * inverse[a]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(48)).astype(np.int64) % BUCKETS

    rows, who = [row(ends[:-1], ends[1:])], [np.arange(n)]
    for size in SIZES:
        k = np.arange(len(begin) - size + 1)
        k = k[owner[k] == owner[k + size - 1]] if len(k) else k
        rows.append(row(begin[k], last[k + size]))
        who.append(owner[k])
    who_all = np.concatenate(who)
    order = np.argsort(who_all, kind="stable")
    return np.concatenate(rows)[order], np.concatenate([[0], np.cumsum(np.bincount(who_all, minlength=n))])


@dataclass(frozen=True)
class Model:
    """Embeddings, softmax weights and bias, the window's length in words, and whether any word was learnt from."""

    table: np.ndarray  # BUCKETS x dim
    weight: np.ndarray  # dim x 2
    bias: np.ndarray  # 2
    window: int
    learnt: bool = True

    def folded(self) -> np.ndarray:
        """Each table row's part in the difference of the two logits: all that scoring needs."""
        return (self.table @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float32)


def _means(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Means of consecutive runs, none empty."""
    return np.add.reduceat(values, ends[:-1], axis=0) / np.diff(ends)[(...,) + (None,) * (values.ndim - 1)]


def best_windows(value: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text with words: its place, its largest window mean and where that window begins."""
    size = np.diff(first)
    has = np.flatnonzero(size > 0)
    wide = np.minimum(size[has], window)
    count = size[has] - wide + 1
    start = ranges(first[has], count)
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    width = np.repeat(wide, count)
    mean = (total[start + width] - total[start]) / width
    edge = np.cumsum(count) - count
    top = np.maximum.reduceat(mean, edge) if len(edge) else mean
    at = np.flatnonzero(mean == np.repeat(top, count))
    first_at = at[np.searchsorted(at, edge)] if len(edge) else at
    return has, top, start[first_at]


def _in_texts(grams: np.ndarray, ends: np.ndarray, which: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    """In how many texts each table row occurs."""
    total, sizes = np.zeros(rows, np.int64), np.diff(ends)
    for lo in range(0, len(first) - 1, 100):  # a hundred texts at a time: each is in one part
        part = first[lo : lo + 101]
        doc = np.repeat(np.arange(len(part) - 1), np.diff(part))
        pairs = np.unique(doc * max(len(sizes), 1) + which[part[0] : part[-1]])
        doc, word = pairs // max(len(sizes), 1), pairs % max(len(sizes), 1)
        found = np.unique(np.repeat(doc, sizes[word]) * max(rows, 1) + grams[ranges(ends[:-1][word], sizes[word])])
        total += np.bincount(found % max(rows, 1), minlength=rows)[:rows]
    return total


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, each word's place among them, and each text's first word; read in parts of bounded size."""
    names, places, sizes, known = [], [], [np.zeros(1, np.int64)], 0
    for _, part in utf8_parts(texts, 1 << 20):
        words, first = words_of(part)
        coded = words.dictionary_encode()
        names.append(coded.dictionary)
        places.append(coded.indices.to_numpy() + np.int32(known))
        known += len(coded.dictionary)
        sizes.append(np.diff(first))
    if not names:
        return pa.array([], texts.type), np.zeros(0, np.int32), np.zeros(1, np.int64)
    every = pa.concat_arrays(names).dictionary_encode()  # a word of several parts is there several times
    which = every.indices.to_numpy().astype(np.int32)[np.concatenate(places)]
    return every.dictionary, which, np.cumsum(np.concatenate(sizes))


def _coded_grams(names: pa.Array, words: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """``grams_of`` of many words, in parts, in 32 bits."""
    rows, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for lo in range(0, len(names), words):
        grams, ends = grams_of(names.slice(lo, words))
        rows.append(grams.astype(np.int32))
        sizes.append(np.diff(ends))
    return np.concatenate(rows), np.cumsum(np.concatenate(sizes))


def _cuts(first: np.ndarray, most: int = 1 << 18) -> list[int]:
    """Bounds of runs (of texts, or of words) of about so many elements."""
    cuts = [0]
    while cuts[-1] < len(first) - 1:
        far = int(np.searchsorted(first, first[cuts[-1]] + most, side="right")) - 1
        cuts.append(min(len(first) - 1, max(far, cuts[-1] + 1)))
    return cuts


def train(texts: list[str] | pa.Array, labels: list[int], window: int = 2, dim: int = 8, steps: int = 100, rate: float = 0.08, decay: float = 0.1, least: int = 4, seed: int = 7) -> Model:
    """Fit the table, the weights and the bias together with Adam on all given texts, which are gone through in parts.

    Without a row that ``least`` texts share nothing can be learnt: all scores are 0.5 and ``learnt`` is false.
    """
    rnd = np.random.default_rng(seed)
    names, which, first = _coded(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    grams, ends = _coded_grams(names)
    y = np.asarray(labels, np.float64)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    # the rare label counts up to ten times, so that it isn't drowned
    weight_of = np.where(y == 1, min(10.0, (1 - share) / share), 1.0)
    used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    grams = place[grams]
    mask = _in_texts(grams, ends, which, first, len(used)) >= least  # rows that only a text or two have say nothing
    if not mask.any():
        return Model(np.zeros((BUCKETS, dim), np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32), window, learnt=False)
    table = rnd.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    parts = {"table": table, "weight": rnd.normal(0, 0.5, (dim, 2)).astype(np.float32), "bias": np.zeros(2, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    sizes, cuts, all_weight = np.diff(ends), _cuts(first), weight_of[np.diff(first) > 0].sum()
    runs = list(itertools.pairwise(_cuts(ends)))
    for step in range(1, steps + 1):
        # a word's value is the mean of its rows' values: the vectors themselves need not be made
        diff = parts["weight"][:, 1] - parts["weight"][:, 0]
        of_gram = parts["table"] @ diff * mask
        of_name = np.concatenate([_means(of_gram[grams[ends[a] : ends[b]]], ends[a : b + 1] - ends[a]) for a, b in runs])
        of_word, g_sum = np.zeros(len(sizes)), 0.0
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own, words = first[lo : hi + 1] - first[lo], which[first[lo] : first[hi]]
            value = of_name[words]
            if step <= steps // 2:  # first by whole texts, which says which words matter at all
                has = np.flatnonzero(np.diff(own) > 0)
                start, wide = own[:-1][has], np.diff(own)[has]
                top, scale = WARM * _means(value, np.append(start, own[-1])), WARM / wide
            else:  # then by the worst window of each text
                has, top, start = best_windows(value, own, window)
                wide = np.minimum(np.diff(own)[has], window)
                scale = 1 / wide
            z = top + parts["bias"][1] - parts["bias"][0]
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            g = (p - y[lo + has]) * weight_of[lo + has] / all_weight  # of the second logit; the first one's is -g
            of_word += np.bincount(words[ranges(start, wide)], np.repeat(g * scale, wide), minlength=len(sizes))
            g_sum += g.sum()
        of_row = np.zeros(len(used))
        for a, b in runs:
            of_row += np.bincount(grams[ends[a] : ends[b]], np.repeat(of_word[a:b] / sizes[a:b], sizes[a:b]), minlength=len(used))
        of_row *= mask
        mean_vector = of_row @ parts["table"]
        grad = {
            "weight": np.stack([-mean_vector, mean_vector], 1), "bias": np.array([-g_sum, g_sum]), "table": of_row[:, None] * diff[None, :],
        }
        for k, v in parts.items():
            d = grad[k].astype(np.float32)
            m, s = moments[k]
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            if k == "table":
                v *= 1 - rate * decay  # what few texts speak for stays small
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((BUCKETS, dim), np.float32)
    full[used] = parts["table"] * mask[:, None]
    return Model(full, parts["weight"], parts["bias"], window)


def scores(texts: pa.Array, folded: np.ndarray, bias: float, window: int) -> np.ndarray:
    """Score of each of the texts, without nulls."""
    z = np.zeros(len(texts))
    for lo, part in utf8_parts(texts, 1 << 20):
        words, first = words_of(part)
        if not len(words):
            continue
        coded = words.dictionary_encode()
        grams, ends = grams_of(coded.dictionary)
        value = _means(folded[grams], ends)
        has, top, _ = best_windows(value[coded.indices.to_numpy()], first, window)
        z[lo + has] = top
    return 1 / (1 + np.exp(-np.clip(z + bias, -50, 50)))


def score(text: Column | str, model: Model) -> Column:
    """Column expression: the toxicity of a whole text, 0 to 1."""
    folded, bias, window = model.folded(), float(model.bias[1] - model.bias[0]), model.window

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(scores(no_nulls(batch), folded, bias, window), pa.float64())

    return of(F.col(text) if isinstance(text, str) else text)


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 3000, max_chars: int = 6_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Train on at most ``max_rows`` labelled documents outside the held fold.

    An id with several labels takes the largest; rows without id, label or words are left out. Without
    rows to learn from the model knows nothing, gives every text 0.5 and calls none toxic.
    """
    key = F.col(id_col)
    known = labels.where(key.isNotNull() & F.col(label_col).isNotNull() & (crc_mod(key, folds) != held))
    known = known.groupBy(key.alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    text = F.col(text_col).cast("string")
    texts = docs.where(key.isNotNull() & text.rlike(r"[\p{L}\p{N}\p{M}@$]")).select(key.alias("_id"), text.alias("_t"))
    # ids alone are joined, so that labels without a text take no place in the sample
    known = written(known.join(texts.select("_id").distinct(), "_id"), "labels")
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [])
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40))
    picked = known.limit(0)
    for y, quota in sorted(quotas(counts, max_rows).items()):
        # a little more than the quota by a bound on the hash, of those the first
        bound = int(min(1.0, (quota + 6 * quota**0.5 + 20) / counts[y]) * (1 << 40))
        picked = picked.unionByName(known.where((F.col("_y") == y) & (place < F.lit(bound))).orderBy(place, "_id").limit(quota))
    # at most max_rows ids of 8 bytes and a label are broadcast
    long = F.length("_t") - max_chars
    at = F.when(long > 0, F.pmod(F.xxhash64("_id", F.lit("stretch")), long + 1)).otherwise(0).cast("int")
    rows = texts.join(F.broadcast(picked), "_id").withColumn("_t", F.col("_t").substr(at + 1, F.lit(max_chars))).dropDuplicates(["_id"]).orderBy("_id")
    got = rows.select("_t", "_y").toArrow()
    model = train(got.column("_t").cast(pa.large_string()).combine_chunks(), got.column("_y").to_numpy())
    del got
    pa.default_memory_pool().release_unused()
    return model


def classify(docs: DataFrame, model: Model, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``held_out``, ``score`` and ``predicted``; other columns are not read.

    A model that learnt nothing predicts 0.
    """
    scored = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).withColumn("score", score("_t", model))
    return scored.select(
        id_col, (crc_mod(F.col(id_col), folds) == held).alias("held_out"), "score", F.when((F.col("score") >= 0.5) & F.lit(model.learnt), 1).otherwise(0).cast("int").alias("predicted")
    )
