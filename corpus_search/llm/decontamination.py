"""Benchmark decontamination by winnowing: document words inside any 10 consecutive words of an item.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. The hashes of all
k-grams of a text are winnowed: of each window of consecutive k-grams the least hash stays, the last
of equal ones. With 5-grams in windows of six, every span of 10 words holds a whole window, and as the
choice depends on the window alone, a span that a document and an item share gives both the same
fingerprint at the same place of the span; none is missed. An item of fewer words is one window of its
own length, winnowed by shorter windows (and k-grams of its length under five words).

1. The documents' distinct fingerprints are matched with the items'; what is left names the documents
   and fingerprints that may hold a hit.
2. The documents are read again; those named get their places: the words of each chosen k-gram that has
   such a fingerprint, and a few words to its left and right.
3. Places are joined with the items' on the k-gram itself, and each hit is extended word by word to
   both sides. Spans as long as the item's window are hits, so a collision of hashes is none.

All is native. Nothing is compared pair by pair: equal places of items are one row with its list of
items, and the small side of a join is broadcast below a counted size, beyond it copied to salted keys,
so that a passage in a third of all documents is dealt to many tasks.

Documents are told apart by id and text; repeated rows share one computation and each get its result,
null ids included. Null and empty texts have no words and no hits; an item without words has no
window. Null item ids count as the empty text, and items of one id as one. Without items nothing is
hit, an empty documents table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.common import with_small, written
from corpus_search.llm.spans import let

WINDOW = 10
GRAM = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; of a null none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.filter(F.split(low, _BETWEEN, -1), lambda w: w != "")


def _first(n: Column) -> Column:
    """0 .. n - 1, nothing if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column, k: int) -> Column:
    """Hashes of all k-grams, from those of the words."""
    return F.transform(_first(F.size(hashes) - (k - 1)), lambda i: F.xxhash64(*(hashes[i + j] for j in range(k))))


def minima(gram_hashes: Column, many: int) -> Column:
    """The least hash of each window of so many consecutive k-grams."""
    if many == 1:
        return gram_hashes
    return F.transform(_first(F.size(gram_hashes) - (many - 1)), lambda i: F.least(*(gram_hashes[i + j] for j in range(many))))


def shape(length: int) -> tuple[int, int]:
    """For windows of so many words: the words of a k-gram, and the k-grams of a window."""
    k = min(length, GRAM)
    return k, length - k + 1


def _hashes(word_list: Column) -> Column:
    return F.transform(word_list, lambda w: F.xxhash64(w))


def fingerprints(word_list: Column, lengths: list[int]) -> Column:
    """Distinct fingerprints of a text for windows of these lengths."""

    by_k: dict[int, list[int]] = {}
    for length in lengths:
        k, many = shape(length)
        by_k.setdefault(k, []).append(many)

    def of_k(hashes: Column, k: int) -> Column:
        return let(grams(hashes, k), lambda g: F.concat(*(F.array_distinct(minima(g, many)) for many in by_k[k])))

    def of(hashes: Column) -> Column:
        return F.concat(*(of_k(hashes, k) for k in by_k))

    return let(_hashes(word_list), of)


def places(word_list: Column, length: int, wanted: Column | None = None) -> Column:
    """The chosen k-grams of a text (of those fingerprints only), with the words around them."""
    k, many = shape(length)

    def last_least(gram_hashes: Column, least: Column, i: Column) -> Column:
        return (i + many - F.array_position(F.reverse(F.slice(gram_hashes, i + 1, many)), least)).cast("int")

    def place(p: Column) -> Column:
        left = F.least(p, F.lit(many - 1))
        return F.struct(
            F.lit(length).alias("length"), p.alias("at"), F.array_join(F.slice(word_list, p + 1, k), " ").alias("gram"),
            F.reverse(F.slice(word_list, p - left + 1, left)).alias("left"), F.slice(word_list, p + k + 1, many - 1).alias("right"),
        )

    def of(g: Column) -> Column:
        windows = F.transform(minima(g, many), lambda least, i: F.struct(least.alias("least"), i.alias("i")))
        if wanted is not None:
            windows = F.filter(windows, lambda w: F.array_contains(wanted, w["least"]))
        return F.transform(F.array_distinct(F.transform(windows, lambda w: last_least(g, w["least"], w["i"]))), place)

    return let(let(_hashes(word_list), lambda h: grams(h, k)), of)


def _run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def item_places(items: DataFrame, lengths: list[int]) -> DataFrame:
    """Each distinct place of the items (``item``, ``words``) once, with the list of its items."""
    size = F.least(F.size("words"), F.lit(WINDOW))
    found = F.concat(*(F.when(size == n, places(F.col("words"), n)).otherwise(F.array()) for n in lengths))
    one = items.select("item", F.explode(found).alias("p")).select("item", "p.length", "p.gram", F.col("p.left").alias("item_left"), F.col("p.right").alias("item_right"))
    return one.groupBy("length", "gram", "item_left", "item_right").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows of documents as (``id_col``, ``rid``, ``th``, ``n_words``), and the hits' spans by (``rid``, ``th``).

    ``rid`` and ``th`` name a document: its id as text and a hash of its text. A hit has ``start`` and
    ``stop`` in words, the end exclusive, and ``items``.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("words"))
    items = written(items.where(F.size("words") > 0), "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())  # WINDOW values at most
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("rid"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), text.alias("_t"))
    if not lengths:
        empty = docs.sparkSession.createDataFrame([], "rid string, th long, start int, stop int, items array<string>")
        return named.select(id_col, "rid", "th", F.size(words(F.col("_t"))).cast("long").alias("n_words")), empty
    known = written(item_places(items, lengths), "item-places")
    prints = items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n"), "words")
    prints = prints.select(F.explode(F.coalesce(*(F.when(F.col("n") == n, fingerprints(F.col("words"), [n])) for n in lengths))).alias("h")).distinct()
    prints = written(prints, "item-fingerprints")
    of_docs = named.select("rid", "th", F.explode(let(words(F.col("_t")), lambda w: fingerprints(w, lengths))).alias("h"))
    may = with_small(of_docs, prints, ["h"], F.lit(16), "left_semi").groupBy("rid", "th").agg(F.collect_set("h").alias("wanted"))
    may = written(may, "may-hit")
    marked = with_small(named, may, ["rid", "th"], 32 + F.length("rid") + 8 * F.size("wanted"), "left")

    def read(w: Column) -> Column:
        found = F.concat(*(places(w, n, F.col("wanted")) for n in lengths))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.col("wanted").isNotNull(), found).alias("places"))

    one = written(marked.select(id_col, "rid", "th", let(words(F.col("_t")), read).alias("_r")).select(id_col, "rid", "th", "_r.*"), "places")
    # repeated rows have equal places
    own = one.where("size(places) > 0").select("rid", "th", F.explode("places").alias("p")).select("rid", "th", "p.*").dropDuplicates(["rid", "th", "length", "at"])
    strings = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x) + 8)
    weight = 64 + F.length("gram") + strings(F.col("item_left")) + strings(F.col("item_right")) + strings(F.col("items"))
    met = with_small(own, known, ["length", "gram"], weight)
    k = F.least(F.col("length"), F.lit(GRAM))
    start, stop = F.col("at") - _run(F.col("left"), F.col("item_left")), F.col("at") + k + _run(F.col("right"), F.col("item_right"))
    spans = met.select("rid", "th", "length", start.alias("start"), stop.alias("stop"), "items").where("stop - start >= length")
    return one.select(id_col, "rid", "th", "n_words"), spans.select("rid", "th", "start", "stop", "items")


def _covered(spans: Column) -> Column:
    """Words in the union of spans (by start)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))
        return F.struct(F.greatest(a["end"], s["stop"]).alias("end"), (a["n"] + more).alias("n"))

    return F.aggregate(spans, zero, add, lambda a: a["n"])


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    rows, spans = hits(docs, benchmark, id_col, **columns)
    per_doc = spans.groupBy("rid", "th").agg(
        _covered(F.sort_array(F.collect_set(F.struct("start", "stop")))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    per_doc = written(per_doc.select("rid", "th", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha")), "hits")
    found = with_small(rows, per_doc, ["rid", "th"], 128 + F.length("rid"), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("sha", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
