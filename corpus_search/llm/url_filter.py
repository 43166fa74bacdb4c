"""URL filter: host and path rules, and a ratio of two character language models.

Accepted and rejected URLs (those that a rule decides, or any labelled ones) give two variable-order
Markov models. Every context of up to ``ORDER`` characters counts, so the models grow with the input. The
chance of a character after a context is interpolated with the next shorter context's, down to the
uniform distribution; where a context never occurred, the shorter one speaks. A URL's score is the mean over its characters of the difference
of the two log-likelihoods. The threshold is calibrated on the fifth of the labelled URLs that the
models didn't see: where the shares of both kinds that fall on the wrong side sum to the least.

All is native; URLs are cut into characters in the row, counted with partial sums, and scored by
joins and a sum by row: each distinct gram (a character and those before it) is joined with the
contexts and judged once, and the rows then look their grams up. The judged grams are broadcast only
if their number, which is counted, keeps them within ``MAX_BROADCAST`` bytes. A null URL, or one without ``://``, has an empty
host and path; a URL without characters after ``://`` scores 0 and is blocked unless a rule says else.
Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.common import fresh, written

#: Rules as (verdict, host, path start).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
STRENGTH = 4.0
#: Bytes of judged grams that may be broadcast, and of one of them in a task's hash table (text, number, pointers).
MAX_BROADCAST, GRAM_BYTES = 32 << 20, 96
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that the models tell apart; all others are one.
ALPHABET = LOWER + "0123456789-._~/?#[]@!$&'()*+,;=:%"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path start, and its verdict; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """The characters that are modelled: what follows ``://`` in lower case, rare characters as one."""
    rest = F.translate(F.coalesce(rest_of(url), F.lit("")), UPPER, LOWER)
    return F.regexp_replace(rest, "[^" + "".join("\\" + c if not c.isalnum() else c for c in ALPHABET) + "]", "^")


@dataclass(frozen=True)
class Model:
    """All contexts with both models' counts of the characters after them; the least score that is accepted."""

    contexts: DataFrame
    least: float


def _places(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each character: the ``ORDER`` characters before it (blanks before the first) and itself."""
    padded = F.concat(F.lit(" " * ORDER), F.col("_s"))
    grams = F.transform(F.sequence(F.lit(1), F.length("_s")), lambda i: padded.substr(i, F.lit(ORDER + 1)))
    return urls.where(F.length("_s") > 0).select(*keep, F.explode(grams).alias("_g"))


def count_contexts(labelled: DataFrame) -> DataFrame:
    """All contexts from rows of ``_s`` (symbols) and ``_ok`` (accepted): ``ctx``, and maps of counts by next character."""
    grams = _places(labelled, ["_ok"]).groupBy("_g").agg(F.sum(F.col("_ok").cast("long")).alias("a"), F.sum((~F.col("_ok")).cast("long")).alias("r"))
    each = grams.select("a", "r", F.substring("_g", ORDER + 1, 1).alias("c"), F.explode(
        F.array(*(F.substring("_g", ORDER + 1 - k, k) if k else F.lit("") for k in range(ORDER + 1)))).alias("ctx"))
    by_char = each.groupBy("ctx", "c").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    # at most one entry for each symbol of the alphabet in a context's list
    return by_char.groupBy("ctx").agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.array_join(F.sort_array(F.collect_list("c")), "").alias("chars"),
        F.transform(F.sort_array(F.collect_list(F.struct("c", "a"))), lambda x: x["a"].cast("double")).alias("ca"),
        F.transform(F.sort_array(F.collect_list(F.struct("c", "r"))), lambda x: x["r"].cast("double")).alias("cr"),
    )


def judged_grams(grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``_g`` and ``d``, the difference of its last character's two log-likelihoods, of distinct grams."""
    # the empty context is one row of at most the alphabet's length: its counts are constants of the plan
    empty = contexts.where(F.length("ctx") == 0).first()
    if empty is None:
        return grams.select("_g", F.lit(0.0).alias("d"))
    pa = pr = F.lit(1.0 / (len(ALPHABET) + 2))
    rows = grams.select(
        "_g", F.substring("_g", ORDER + 1, 1).alias("_c"), F.lit(empty["na"]).alias("na0"), F.lit(empty["nr"]).alias("nr0"),
        F.lit(empty["chars"]).alias("chars0"), F.array(*map(F.lit, empty["ca"])).alias("ca0"), F.array(*map(F.lit, empty["cr"])).alias("cr0"),
    )
    for k in range(ORDER + 1):
        if k:
            side = contexts.where(F.length("ctx") == k).select(F.col("ctx").alias("_x"), *(F.col(c).alias(f"{c}{k}") for c in ("na", "nr", "chars", "ca", "cr")))
            rows = rows.join(side, F.substring("_g", ORDER + 1 - k, k) == F.col("_x"), "left").drop("_x")
        at = F.instr(F.col(f"chars{k}"), F.col("_c"))

        def mixed(counts: str, n: str, p: Column) -> Column:
            seen = F.when(at > 0, F.get(F.col(f"{counts}{k}"), at - 1)).otherwise(0.0)
            return F.when(F.col(f"{n}{k}").isNull(), p).otherwise((seen + STRENGTH * p) / (F.col(f"{n}{k}") + STRENGTH))

        # only the two chances go on to the next join
        rows = rows.select("_g", "_c", mixed("ca", "na", pa).alias(f"pa{k}"), mixed("cr", "nr", pr).alias(f"pr{k}"))
        pa, pr = F.col(f"pa{k}"), F.col(f"pr{k}")
    return rows.select("_g", (F.log(pa) - F.log(pr)).alias("d"))


def scored(urls: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """``key`` and ``_score`` of rows with ``_s``; rows without characters are left out."""
    rows = _places(urls, [key])
    grams = written(judged_grams(rows.select("_g").distinct(), contexts), "url-grams")
    small = grams.count() * GRAM_BYTES <= MAX_BROADCAST
    # hinted, as the planner's own guess rests on the size of the compressed file
    grams = F.broadcast(grams) if small else grams.hint("merge")
    return rows.join(grams, "_g").groupBy(key).agg(F.avg("d").alias("_score"))


def fit(urls: DataFrame, url_col: str = "url", rules: tuple = RULES, bins: int = 100) -> Model:
    """Count the models on four fifths of the URLs that rules decide; calibrate on the rest."""
    url = F.col(url_col).cast("string")
    _, verdict = rule_of(host_of(url), path_of(url), rules)
    known = urls.select(url.alias("_u"), (verdict == "allow").alias("_ok")).where(F.col("_ok").isNotNull())
    known = known.select("_ok", symbols(F.col("_u")).alias("_s"), (F.pmod(F.crc32(F.col("_u").cast("binary")), F.lit(5)) == 0).alias("_aside"), F.xxhash64("_u").alias("_h"))
    contexts = written(count_contexts(known.where(~F.col("_aside"))), "url-contexts")
    aside = known.where("_aside").groupBy("_s", "_ok").agg(F.count("*").alias("n")).withColumn("_key", F.struct("_s", "_ok", "n"))
    found = scored(aside, contexts, "_key").groupBy(F.round(F.col("_score") * bins).alias("b")).agg(
        F.sum(F.when(F.col("_key._ok"), F.col("_key.n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("_key._ok"), F.col("_key.n")).otherwise(0)).alias("r"))
    rows = sorted((r["b"], r["a"], r["r"]) for r in found.collect())  # as many as scores, rounded to 1 / bins, can differ
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, least = 2.0, 0.0
    lost, passed, last = 0, rejected, None
    for b, a, r in [*rows, (None, 0, 0)] if accepted and rejected else []:
        wrong = lost / accepted + passed / rejected
        if wrong < best - 1e-12:
            best, least = wrong, (0.5 * (last + b) if last is not None and b is not None else (b if b is not None else last + 1)) / bins
        lost, passed, last = lost + a, passed - r, b
    return Model(contexts, least)


def judge(urls: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """Per row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``score``; other columns are not read.

    Each distinct URL that no rule decides is scored once, by its characters.
    """
    url = F.col(url_col).cast("string")
    one = urls.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), symbols(url).alias("_s"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    key = fresh(one, stem="_row")
    one = one.select("*", name.alias("rule"), verdict.alias("_verdict"))
    ruled = one.where(F.col("rule").isNotNull()).select(id_col, "host", "path", "rule", F.col("_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    # the whole row is the key of its sum, so nothing is joined back: a row's characters are summed where they are made
    rest = one.where(F.col("rule").isNull()).groupBy(F.struct(id_col, "host", "path", "_s").alias(key)).agg(F.count("*").alias("_n"))
    rest = rest.select(F.struct(F.col(f"{key}.*"), "_n").alias(key), F.col(f"{key}._s").alias("_s"))
    some = scored(rest, model.contexts, key)
    none = rest.where(F.length("_s") == 0).select(key, F.lit(None).cast("double").alias("_score"))
    free = some.unionByName(none).select(f"{key}.*", "_score").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    free = free.select(
        id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(F.col("_score") >= model.least, "allow").otherwise("block").alias("verdict"), F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
    return ruled.unionByName(free)
