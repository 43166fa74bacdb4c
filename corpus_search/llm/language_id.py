"""Language identification with a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length. Filters of several widths run over a
window's bytes; over one-hot bytes a filter is a table of 256 values for each of its places, so a
convolution is a sum of table rows. Each filter's largest answer in the window (through a ReLU)
feeds a softmax over the languages. A text's posterior is the mean of its windows' log-posteriors,
weighted by their letters, through a softmax. Windows lie end to end and overlap by the widest filter less one byte,
so every byte of every text is seen; they are stacked into batches of bounded size.

Labels are learnt from a bounded sample (``max_rows`` documents, a quota of each language so that rare ones
are learnt too, chosen by a hash; one stretch of each of at most ``max_bytes`` characters). Repeated rows are
judged alike, and an empty table gives an empty result. The language of null text, and of text without any letter, is ``und`` with
score 0; without labelled rows it is ``und`` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.common import crc_mod, labelled_sample, no_nulls, ranges, text_bytes, utf8_parts

WIDTHS = (2, 3, 4)
WINDOW = 128
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: width x 256 x filters
    bias: list[np.ndarray]  # for each width: filters
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray


def windows(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts as rows of WINDOW bytes (zeros beyond a text), and the text of each."""
    step, size = WINDOW - max(WIDTHS) + 1, np.diff(ends)
    count = np.where(size > 0, np.maximum(1, -(-(size - max(WIDTHS) + 1) // step)), 0)
    owner = np.repeat(np.arange(len(size)), count)
    start = ranges(np.zeros(len(size), np.int64), count) * step + ends[:-1][owner]
    at = start[:, None] + np.arange(WINDOW)
    inside = at < ends[1:][owner][:, None]
    return np.where(inside, raw[np.minimum(at, max(len(raw) - 1, 0))] if len(raw) else 0, 0).astype(np.uint8), owner


def features(model: Model, rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's largest answer in each window, and where it was (for training)."""
    out, where = [], []
    for width, table, bias in zip(WIDTHS, model.tables, model.bias):
        n = WINDOW - width + 1
        answer = np.take(table[0], rows[:, :n], axis=0)
        for k in range(1, width):
            answer += np.take(table[k], rows[:, k : k + n], axis=0)
        if places:
            at = answer.argmax(1)
            where.append(at)
            top = np.take_along_axis(answer, at[:, None, :], 1)[:, 0]
        else:
            top = answer.max(1)
        out.append(np.maximum(top + bias, 0))
    return np.concatenate(out, 1), where


def log_posteriors(model: Model, rows: np.ndarray, batch: int = 64) -> np.ndarray:
    """Log-posterior of every window, in batches that fit a core's cache."""
    out = np.empty((len(rows), len(model.languages)), np.float32)
    for lo in range(0, len(rows), batch):
        z = features(model, rows[lo : lo + batch])[0] @ model.out + model.out_bias
        z -= z.max(1, keepdims=True)
        out[lo : lo + batch] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def _letters(rows: np.ndarray) -> np.ndarray:
    """How many letters and bytes beyond ASCII each window holds."""
    lower = rows | 32
    return ((rows >= 128) | ((lower >= 97) & (lower <= 122))).sum(1)


def predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best language (its place) and its share for texts without nulls; texts without windows get place -1."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    if not model.languages:
        return best, score
    for lo, part in utf8_parts(texts, 1 << 20):
        raw, ends = text_bytes(part)
        rows, owner = windows(raw, ends)
        if not len(rows):
            continue
        weight = _letters(rows) + 1e-6
        logs = log_posteriors(model, rows) * weight[:, None]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        mean = np.add.reduceat(logs, first) / np.add.reduceat(weight, first)[:, None]
        share = np.exp(mean - mean.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best[lo + owner[first]] = share.argmax(1)
        score[lo + owner[first]] = share.max(1)
    return best, score


def train(texts: list[str], labels: list[str], filters: int = 12, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Model:
    """Fit all tables and the softmax with Adam on random windows of the texts."""
    rnd = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y_text = np.searchsorted(languages, labels) if languages else np.zeros(0, np.int64)
    raw, ends = text_bytes(pa.array(texts, pa.large_string()))
    rows, owner = windows(raw, ends)
    rows = rows.copy()
    useful = _letters(rows) >= 8 if len(rows) else np.zeros(0, bool)
    rows, y = rows[useful], y_text[owner[useful]] if len(owner) else y_text[:0]
    total = filters * len(WIDTHS)
    parts = {f"t{w}": rnd.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
    parts |= {f"b{w}": np.zeros(filters, np.float32) for w in WIDTHS}
    parts |= {"out": rnd.normal(0, 0.3, (total, len(languages))).astype(np.float32), "out_bias": np.zeros(len(languages), np.float32)}
    model = Model(languages, [parts[f"t{w}"] for w in WIDTHS], [parts[f"b{w}"] for w in WIDTHS], parts["out"], parts["out_bias"])
    if not len(rows):
        return Model([], model.tables, model.bias, model.out, model.out_bias)
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    of = [x if len(x) else np.arange(len(y)) for x in of]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rnd.choice(x, -(-batch // len(languages))) for x in of])  # every language alike
        seen, truth = rows[pick], y[pick]
        seen = np.where(rnd.random((len(pick), 1)) < 0.15, _upper(seen), seen)  # shouted text is the same language
        short = rnd.integers(16, WINDOW + 1, (len(pick), 1))
        seen = np.where((rnd.random((len(pick), 1)) < 0.3) & (np.arange(WINDOW) >= short), 0, seen).astype(np.uint8)
        f, where = features(model, seen, places=True)
        z = f @ model.out + model.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), truth] -= 1
        p /= len(pick)
        grad = {"out": f.T @ p, "out_bias": p.sum(0)}
        back = (p @ model.out.T) * (f > 0)
        for j, w in enumerate(WIDTHS):
            g = back[:, j * filters : (j + 1) * filters]
            grad[f"b{w}"] = g.sum(0)
            table = np.zeros((w, 256, filters), np.float32)
            for k in range(w):
                byte = np.take_along_axis(seen, where[j] + k, 1)
                np.add.at(table[k], (byte, np.arange(filters)[None, :]), g)
            grad[f"t{w}"] = table
        for k, v in parts.items():
            m, s = moments[k]
            m += 0.1 * (grad[k] - m)
            s += 0.01 * (grad[k] * grad[k] - s)
            v -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return model


def _upper(rows: np.ndarray) -> np.ndarray:
    """ASCII letters and the Latin-1 letters of two bytes in upper case."""
    small = (rows >= 97) & (rows <= 122)
    before = np.concatenate([np.zeros((len(rows), 1), rows.dtype), rows[:, :-1]], 1)
    wide = (before == 0xC3) & (rows >= 0xA0) & (rows <= 0xBE) & (rows != 0xB7)
    return np.where(small | wide, rows - 32, rows)


def identify(text: Column | str, model: Model) -> Column:
    """Column expression: struct(lang, score) of a whole text."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = no_nulls(batch)
            best, score = predict(model, texts)
            best[~pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)] = -1
            score = np.where(best < 0, 0.0, score)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return of(F.col(text) if isinstance(text, str) else text)


def fit(
    docs: DataFrame, folds: int = 4, held: int = 2, max_rows: int = 3000, max_bytes: int = 4000,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Train on at most ``max_rows`` labelled rows outside the held fold, a quota of each language, a stretch of ``max_bytes`` characters of each.

    The stretch begins at a place set by a hash, so that it is not always a beginning.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"), F.col(lang_col).cast("string").alias("_y"))
    known = known.where(F.col("_y").isNotNull() & F.col("_t").isNotNull() & (crc_mod(F.col("_id"), folds) != held))
    picked, counts = labelled_sample(known, max_rows, "sample")
    if not counts:
        return train([], [])
    free = F.greatest(F.lit(0), F.length("_t") - max_bytes)
    start = F.pmod(F.xxhash64("_id", F.lit("start")), free + 1).cast("int") + 1
    rows = picked.select(F.col("_t").substr(start, F.lit(max_bytes)).alias("t"), F.col("_y").alias("l")).orderBy("l", "t").toArrow()
    return train(rows.column("t").to_pylist(), rows.column("l").to_pylist())


def classify(docs: DataFrame, model: Model, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``held_out``, ``lang_pred`` and ``score``; other columns are not read."""
    one = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")).withColumn("_found", identify("_t", model))
    return one.select(
        id_col, (crc_mod(F.col(id_col), folds) == held).alias("held_out"), F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score")
    )
