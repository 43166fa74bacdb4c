"""The registered queries of this subpackage: ``opN_<name>`` over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_search.llm import bpe, ctph, decontamination, jaccard_join, language_id, mixing, pii, quality_rules, secret_scan, toxicity, turn_repair, url_filter, whitening
from corpus_search.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled documents outside the held-out fold."""
    docs = documents(spark, sf_dir)
    return language_id.classify(docs, language_id.fit(docs))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base formats, and candidates that the boosted trees accept."""
    docs = documents(spark, sf_dir)
    return pii.digests(pii.scan(docs, pii.fit(docs)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface counts of every document, and whether the base rule and the likelihood ratio keep it."""
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, documents(spark, sf_dir, "labels")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed formats, and runs of high entropy."""
    return secret_scan.digests(secret_scan.scan(documents(spark, sf_dir)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule that fits, else the likelihood ratio."""
    pages = documents(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of near copies of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.classify(documents(spark, sf_dir))


#: The shares of tokens that the mix should have, by language.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posterior, rate and copies of every document for the target mix of languages."""
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, mixing.fit_classifier(docs, domain_col="lang"), TARGETS)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    return bpe.round_trip(spark, documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit, and their likeness, by descending id."""
    return ctph.compared_to_next(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding projected on the first 16 components of the distinct ones, in unit variance."""
    vectors = documents(spark, sf_dir, "embeddings")
    return whitening.by_component(whitening.whiten(vectors, whitening.fit(vectors)))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any 10 consecutive words of a benchmark item, and the items."""
    return decontamination.judge(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, its faults counted, and repaired by the cheapest edits."""
    damaged = turn_repair.damage(documents(spark, sf_dir, "conversations"))
    return turn_repair.digests(*turn_repair.repair(damaged))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_language, op2_pii, op3_quality, op4_secrets, op5_toxicity, op6_urls, op7_jaccard, op8_mixing, op9_bpe, op10_fingerprints, op11_whitening,
    op12_decontamination, op13_turn_repair,
)}
#: The other queries train models or merge tokens, which SQL doesn't express; tests/llm compares them.
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [''] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * k >= 4 * (a.c + b.c - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x)
SELECT r.doc_id, min(r.root) AS class_id, any_value(coalesce(c.n_links, 0)) AS n_links
FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+') IF x <> ''] AS ws FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+') IF x <> ''] AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, m, unnest([array_to_string(ws[p:p + m - 1], ' ') FOR p IN range(1, len(ws) - m + 2)]) AS win
       FROM (SELECT *, least(len(ws), 10) AS m FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, m, unnest(range(1, len(ws) - m + 2)) AS p, unnest([array_to_string(ws[p:p + m - 1], ' ') FOR p IN range(1, len(ws) - m + 2)]) AS win
       FROM d, (SELECT DISTINCT m FROM iw)),
hit AS (SELECT r, p, m, item FROM dw JOIN iw USING (m, win)),
w AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS x FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (r) LEFT JOIN it USING (r)""",
    "op13_turn_repair": r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(key, '')],
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT FOR z IN range(8)], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
    4294967295) % 20 AS fault FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE fault <> 0),
o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lead(role) OVER w AS next_role,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
e AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    next_role IS NOT NULL AND left(role, 1) || left(next_role, 1) NOT IN ('su', 'ua', 'au') AS ill FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (ill) AS illegal FROM e GROUP BY conv_id),
r(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n, {'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''} FROM e WHERE i = n
  UNION ALL
  SELECT conv_id, i, list_sort([b0, {'c': u.c + 3, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}])[1],
    list_sort([b1, {'c': u.c + 3, 'a': 'I' || u.a, 't': chr(10) || 'user:' || u.t}])[1], u, a FROM (
  SELECT conv_id, i, b0, b1, list_sort([b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 't': chr(10) || 'assistant:' || b3.t}])[1] AS u,
    list_sort([b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 't': chr(10) || 'user:' || b2.t}])[1] AS a FROM (
  SELECT conv_id, i - 1 AS i, list_sort([d0, x0, k0])[1] AS b0, list_sort([d1, x1, k1])[1] AS b1, list_sort([d2, x2, k2])[1] AS b2, list_sort([d3, x3, k3])[1] AS b3 FROM (
  SELECT r.conv_id, r.i, {'c': v0.c + 4, 'a': 'D' || v0.a, 't': v0.t} AS d0, {'c': v1.c + 4, 'a': 'D' || v1.a, 't': v1.t} AS d1,
    {'c': v2.c + 4, 'a': 'D' || v2.a, 't': v2.t} AS d2, {'c': v3.c + 4, 'a': 'D' || v3.a, 't': v3.t} AS d3,
    {'c': v2.c + p + 3, 'a': 'R' || v2.a, 't': chr(10) || 'user:' || text || v2.t} AS x0,
    {'c': v2.c + p + 3, 'a': 'R' || v2.a, 't': chr(10) || 'user:' || text || v2.t} AS x1,
    {'c': v3.c + p + 3, 'a': 'R' || v3.a, 't': chr(10) || 'assistant:' || text || v3.t} AS x2,
    {'c': v2.c + p + 3, 'a': 'R' || v2.a, 't': chr(10) || 'user:' || text || v2.t} AS x3,
    CASE init WHEN 's' THEN {'c': v1.c + p, 'a': 'K' || v1.a, 't': line || v1.t} WHEN 'u' THEN {'c': v2.c + p, 'a': 'K' || v2.a, 't': line || v2.t}
      ELSE {'c': 1000000000, 'a': '', 't': ''} END AS k0,
    CASE init WHEN 'u' THEN {'c': v2.c + p, 'a': 'K' || v2.a, 't': line || v2.t} ELSE {'c': 1000000000, 'a': '', 't': ''} END AS k1,
    CASE init WHEN 'a' THEN {'c': v3.c + p, 'a': 'K' || v3.a, 't': line || v3.t} ELSE {'c': 1000000000, 'a': '', 't': ''} END AS k2,
    CASE init WHEN 'u' THEN {'c': v2.c + p, 'a': 'K' || v2.a, 't': line || v2.t} ELSE {'c': 1000000000, 'a': '', 't': ''} END AS k3
  FROM r JOIN (SELECT *, left(role, 1) AS init, chr(10) || role || ':' || text AS line,
    CASE fault WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 1000000000 END AS p FROM e) x ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i)))),
z AS (SELECT conv_id, v0 FROM r WHERE i = 0)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
