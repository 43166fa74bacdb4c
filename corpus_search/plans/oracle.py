"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string runs on the pre-registered views (documents, benchmark, embeddings, ...) and
must produce the same rows and column names as the Spark query of the same key.
Conventions shared with the Spark side: whitespace class ``[\\t\\n\\x0B\\f\\r ]``, hash bucket
``int(md5(token)[:7], 16) % dims``, rankings by ``round(distance, 9)`` then id, doubles
rounded to 6 places, integers as BIGINT.
"""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r ]"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def _chunks(size: int = 1000, overlap: int = 200) -> str:
    step = size - overlap
    return f"""
chunks AS (
  SELECT doc_id, source, chunk_index, start, text,
         md5(CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR)) AS chunk_id
  FROM (
    SELECT doc_id, source, CAST((s - 1) / {step} AS INTEGER) AS chunk_index, CAST(s AS BIGINT) AS start,
           substring(text, s, {size}) AS text
    FROM (SELECT doc_id, source, text,
                 unnest(generate_series(1, greatest(1, length(text) - {overlap}), {step})) AS s
          FROM documents)
  ) WHERE length(text) > 0
)"""


def _hash_weights(name: str, src: str, id_col: str, text_col: str, dims: int = 256) -> str:
    """Sparse hashed embedding: (id, b, w) with w the L2-normalised bucket count."""
    return f"""
{name}_tok AS (SELECT {id_col} AS id, unnest(string_split_regex(lower({text_col}), '{WS}+')) AS t FROM {src}),
{name}_cnt AS (SELECT id, ('0x' || substr(md5(t), 1, 7))::BIGINT % {dims} AS b, CAST(count(*) AS DOUBLE) AS c
               FROM {name}_tok WHERE t <> '' GROUP BY ALL),
{name}_w AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}_cnt)"""


def _flagship_hits(k: int = 5) -> str:
    return f"""
WITH {_chunks()},
questions AS (SELECT item_id AS query_id, text AS question FROM benchmark WHERE {_strip('text')} <> ''),
{_hash_weights('c', 'chunks', 'chunk_id', 'text')},
{_hash_weights('q', 'questions', 'query_id', 'question')},
dots AS (SELECT q_w.id AS query_id, c_w.id AS chunk_id, sum(q_w.w * c_w.w) AS dot
         FROM q_w JOIN c_w ON q_w.b = c_w.b GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, 2 - 2 * dot AS distance,
                  row_number() OVER (PARTITION BY query_id ORDER BY round(2 - 2 * dot, 9), chunk_id) AS rank
           FROM dots),
hits AS (SELECT r.query_id, r.rank, r.chunk_id, c.doc_id, c.chunk_index,
                round(r.distance, 6) AS distance, round(1 - r.distance, 6) AS score, c.text
         FROM ranked r JOIN chunks c ON r.chunk_id = c.chunk_id WHERE r.rank <= {k})"""


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["knn_with_text"] = _flagship_hits() + """
SELECT query_id, rank, chunk_id, doc_id, chunk_index, distance, score, text FROM hits"""

ORACLE_SQL["retrieve_context"] = _flagship_hits() + """,
ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context,
               count(*) AS n_chunks, max(score) AS top_score
        FROM hits GROUP BY query_id)
SELECT query_id,
       CASE WHEN len(string_split(context, ' ')) > 7168
            THEN array_to_string(string_split(context, ' ')[1:7168], ' ') ELSE context END AS context,
       n_chunks, round(top_score, 6) AS top_score,
       CAST(least(len(string_split(context, ' ')), 7168) AS BIGINT) AS context_tokens,
       len(string_split(context, ' ')) > 7168 AS truncated
FROM ctx"""


# ----------------------------------------------------------------------------- chunking

ORACLE_SQL["chunk_fixed"] = f"WITH {_chunks()}\nSELECT doc_id, source, chunk_index, start, text FROM chunks"

ORACLE_SQL["chunk_metadata"] = f"""WITH {_chunks()}
SELECT doc_id, source, chunk_index, start, start + length(text) - 1 AS "end", CAST(length(text) AS BIGINT) AS n_chars
FROM chunks"""

ORACLE_SQL["chunk_ids"] = f"WITH {_chunks()}\nSELECT chunk_id, doc_id, chunk_index FROM chunks"

ORACLE_SQL["chunk_tokens"] = f"""
WITH toks AS (
  SELECT doc_id, source,
         CASE WHEN {_strip('text')} = '' THEN []::VARCHAR[] ELSE string_split_regex({_strip('text')}, '{WS}+') END AS tok
  FROM documents),
w AS (SELECT doc_id, source, tok, unnest(generate_series(1, greatest(1, len(tok) - 200), 308)) AS s
      FROM toks WHERE len(tok) > 0)
SELECT doc_id, source, CAST((s - 1) / 308 AS INTEGER) AS chunk_index, CAST(s AS BIGINT) AS start_token,
       array_to_string(tok[s:s + 507], ' ') AS text, CAST(len(tok[s:s + 507]) AS BIGINT) AS n_tokens
FROM w"""

ORACLE_SQL["length_guard"] = """
WITH p AS (
  SELECT doc_id, text,
         unnest(generate_series(0, CASE WHEN length(text) > 16384 THEN CAST(ceil(length(text) / 16000) AS BIGINT) - 1 ELSE 0 END)) AS piece
  FROM documents),
s AS (SELECT doc_id, CAST(piece AS INTEGER) AS piece,
             CASE WHEN length(text) > 16384 THEN substring(text, piece * 16000 + 1, 16000) ELSE text END AS text
      FROM p)
SELECT doc_id, piece, text, CAST(length(text) AS BIGINT) AS n_chars FROM s"""

ORACLE_SQL["nonblank_queries"] = f"SELECT item_id AS query_id, text AS question FROM benchmark WHERE {_strip('text')} <> ''"

# ----------------------------------------------------------------------------- documents

_URI = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
_KEY = f"regexp_replace(regexp_extract(url, '{_URI}', 3), '^/+', '')"


def _ext(path: str) -> str:
    return f"lower(regexp_extract(string_split({path}, '/')[-1], '\\.([^./]+)$', 1))"


_FORMAT = """CASE ext WHEN 'pdf' THEN 'pdf' WHEN 'doc' THEN 'word' WHEN 'docx' THEN 'word' WHEN 'xls' THEN 'sheet'
  WHEN 'xlsx' THEN 'sheet' WHEN 'txt' THEN 'text' WHEN 'html' THEN 'markup' WHEN 'htm' THEN 'markup' END"""

_ROUTED = f"""
WITH e AS (SELECT page_id, {_ext(_KEY)} AS ext FROM pages),
r AS (SELECT page_id, ext AS extension, {_FORMAT} AS format FROM e)"""

ORACLE_SQL["route_by_extension"] = _ROUTED + """
SELECT page_id, extension, format, CASE WHEN format IS NULL THEN 'unsupported' ELSE 'ok' END AS status FROM r"""

ORACLE_SQL["status_counts"] = _ROUTED + """
SELECT format, CASE WHEN format IS NULL THEN 'unsupported' ELSE 'ok' END AS status, count(*) AS n FROM r GROUP BY ALL"""


def _collapse(expr: str) -> str:
    return _strip(f"regexp_replace({expr}, '{WS}+', ' ', 'g')")


def _html_text(expr: str) -> str:
    x = f"regexp_replace({expr}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return _collapse(x)


ORACLE_SQL["extract_page_text"] = f"""
SELECT page_id, {_collapse("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
       {_html_text('html')} AS text, CAST(length({_html_text('html')}) AS BIGINT) AS n_chars
FROM pages"""

ORACLE_SQL["assemble_pages"] = f"""
WITH pages AS (
  SELECT d.doc_id, CAST(u.page_no AS BIGINT) AS page_no, u.page_text
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(page_text, page_no))
SELECT doc_id, count(*) AS n_pages,
       CAST(sum(CASE WHEN {_strip("coalesce(page_text, '')")} = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_pages,
       string_agg(coalesce(page_text, ''), chr(10) ORDER BY page_no) AS text
FROM pages GROUP BY doc_id"""

ORACLE_SQL["rows_to_text"] = """
SELECT o_orderkey, concat_ws(chr(9),
  coalesce(CAST(o_orderkey AS VARCHAR), ''), coalesce(CAST(o_custkey AS VARCHAR), ''),
  coalesce(CAST(o_orderstatus AS VARCHAR), ''), coalesce(CAST(o_totalprice AS VARCHAR), ''),
  coalesce(CAST(o_orderdate AS VARCHAR), ''), coalesce(CAST(o_orderpriority AS VARCHAR), '')) AS line
FROM orders"""

ORACLE_SQL["object_names"] = f"""
WITH k AS (SELECT page_id, {_KEY} AS key FROM pages)
SELECT page_id, key, string_split(key, '/')[-1] AS basename, regexp_extract(key, '^(.*)/[^/]*$', 1) AS parent,
       {_ext('key')} AS extension
FROM k"""

ORACLE_SQL["parse_object_uri"] = f"""
SELECT page_id, lower(regexp_extract(url, '{_URI}', 1)) AS scheme, regexp_extract(url, '{_URI}', 2) AS bucket,
       {_KEY} AS key
FROM pages"""

# ----------------------------------------------------------------------------- dedup and stats

ORACLE_SQL["exact_dedup"] = """
SELECT md5(text) AS md5, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY md5(text)"""

ORACLE_SQL["dedup_against_seen"] = """
SELECT doc_id, md5(text) AS md5 FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents s JOIN labels l ON s.doc_id = l.doc_id WHERE md5(s.text) = md5(d.text))"""

ORACLE_SQL["collection_stats"] = f"""WITH {_chunks()}
SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, min(length(text)) AS min_chars,
       round(avg(length(text)), 6) AS avg_chars, max(length(text)) AS max_chars
FROM chunks GROUP BY source"""


# ----------------------------------------------------------------------------- vectors

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _d2(a: str, b: str) -> str:
    return f"pow(list_distance({a}, {b}), 2)"


def _exact_hits(k: int = 5) -> str:
    return f"""
exact_d AS (SELECT q.vec_id AS query_id, x.vec_id, {_d2('q.v', 'x.v')} AS distance FROM e q, e x),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank
                         FROM exact_d) WHERE rank <= {k})"""


def _ivf(nlist: int = 16, nprobe_expr: str = "4", extra_from: str = "", extra_key: str = "", k: int = 5) -> str:
    sel = f"{extra_key} AS np, " if extra_key else ""
    part = "np, " if extra_key else ""
    return f"""
cent AS (SELECT cell_id, v FROM (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS cell_id, v FROM e)
         WHERE cell_id < {nlist}),
asg AS (SELECT vec_id, cell_id FROM (
          SELECT e.vec_id, c.cell_id,
                 row_number() OVER (PARTITION BY e.vec_id ORDER BY round({_d2('e.v', 'c.v')}, 9), c.cell_id) AS r
          FROM e, cent c) WHERE r = 1),
probes AS (SELECT e.vec_id AS query_id, c.cell_id,
                  row_number() OVER (PARTITION BY e.vec_id ORDER BY round({_d2('e.v', 'c.v')}, 9), c.cell_id) AS pr
           FROM e, cent c),
ivf_d AS (SELECT {sel}p.query_id, a.vec_id, {_d2('q.v', 'x.v')} AS distance
          FROM probes p {extra_from} JOIN asg a ON a.cell_id = p.cell_id
          JOIN e q ON q.vec_id = p.query_id JOIN e x ON x.vec_id = a.vec_id
          WHERE p.pr <= {nprobe_expr}),
ivf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part}query_id ORDER BY round(distance, 9), vec_id) AS rank
                       FROM ivf_d) WHERE rank <= {k})"""


_HITS_COLS = "query_id, vec_id, rank, round(distance, 6) AS distance, round(1 - distance, 6) AS score"

ORACLE_SQL["knn_exact"] = f"WITH {_E},{_exact_hits()}\nSELECT {_HITS_COLS} FROM exact"
ORACLE_SQL["knn_exact_blocked"] = ORACLE_SQL["knn_exact"]

ORACLE_SQL["ivf_build"] = f"WITH {_E},{_ivf()}\nSELECT vec_id, cell_id FROM asg"

ORACLE_SQL["knn_ivf"] = f"WITH {_E},{_ivf()}\nSELECT {_HITS_COLS} FROM ivf"
ORACLE_SQL["knn_ivf_blocked"] = ORACLE_SQL["knn_ivf"]

ORACLE_SQL["ivf_recall"] = f"""WITH {_E},{_exact_hits()},
nps AS (SELECT * FROM (VALUES (1), (4), (16)) t(np)),{_ivf(nprobe_expr='nps.np', extra_from=', nps', extra_key='nps.np')},
per_q AS (SELECT nps.np, x.query_id,
                 sum(CASE WHEN i.vec_id IS NOT NULL THEN 1 ELSE 0 END) / 5.0 AS r
          FROM nps CROSS JOIN exact x
          LEFT JOIN ivf i ON i.np = nps.np AND i.query_id = x.query_id AND i.vec_id = x.vec_id
          GROUP BY nps.np, x.query_id)
SELECT CAST(np AS BIGINT) AS nprobe, count(*) AS n_queries, round(avg(r), 6) AS recall FROM per_q GROUP BY np"""

_MEANS = """
m AS (SELECT label, list(mx ORDER BY i) AS mean
      FROM (SELECT label, i, avg(x) AS mx FROM {src}, unnest(v) WITH ORDINALITY AS u(x, i) GROUP BY label, i)
      GROUP BY label)"""

ORACLE_SQL["vector_distance"] = f"""WITH {_E},{_MEANS.format(src='e')}
SELECT vec_id, label, round({_d2('v', 'mean')}, 6) AS l2_squared, round(list_distance(v, mean), 6) AS l2
FROM e JOIN m USING (label)"""

ORACLE_SQL["vector_similarity"] = f"""WITH {_E},{_MEANS.format(src='e')}
SELECT vec_id, label, round(list_cosine_similarity(v, mean), 6) AS cosine, round(list_inner_product(v, mean), 6) AS inner_product
FROM e JOIN m USING (label)"""

_SPLIT = """
t AS (SELECT vec_id, label, v,
             CASE WHEN ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS split,
             ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 9, 8))::BIGINT AS h2
      FROM e),
nb AS (SELECT greatest(1, CAST(ceil(count(*) / 64) AS BIGINT)) AS nb FROM t WHERE split = 'train')"""

ORACLE_SQL["split_batches"] = f"""WITH {_E},{_SPLIT}
SELECT vec_id, label, split, CASE WHEN split = 'train' THEN h2 % (SELECT nb FROM nb) END AS batch FROM t"""

ORACLE_SQL["classifier_accuracy"] = f"""WITH {_E},{_SPLIT},
tr AS (SELECT * FROM t WHERE split = 'train'),{_MEANS.format(src='tr')},
p AS (SELECT te.vec_id, te.label, m.label AS pred,
             row_number() OVER (PARTITION BY te.vec_id ORDER BY round({_d2('te.v', 'm.mean')}, 9), m.label) AS r
      FROM t te, m WHERE te.split = 'test')
SELECT count(*) AS n_test, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0, 6) AS accuracy
FROM p WHERE r = 1"""

ORACLE_SQL["embed_hash"] = f"""WITH {_hash_weights('d', 'documents', 'doc_id', 'text')},
nt AS (SELECT id, CAST(sum(c) AS BIGINT) AS n_tokens FROM d_cnt GROUP BY id),
agg AS (SELECT id, count(*) AS n_buckets, round(sum(w * (b + 1)), 6) AS weighted_sum FROM d_w GROUP BY id)
SELECT doc.doc_id, coalesce(nt.n_tokens, 0) AS n_tokens, coalesce(agg.n_buckets, 0) AS n_buckets,
       coalesce(agg.weighted_sum, 0.0) AS weighted_sum
FROM documents doc LEFT JOIN nt ON nt.id = doc.doc_id LEFT JOIN agg ON agg.id = doc.doc_id"""


# ----------------------------------------------------------------------------- history, prompts, replies

_PAIRS = """
nx AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, 'User: ' || text || ' Bot: ' || nt AS pair FROM nx WHERE role = 'user' AND nr = 'assistant')"""

ORACLE_SQL["history_numbered"] = """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations"""

ORACLE_SQL["history_text"] = f"""WITH {_PAIRS}
SELECT conv_id, count(*) AS n_pairs, string_agg(pair, ' ' ORDER BY turn) AS history FROM pairs GROUP BY conv_id"""

ORACLE_SQL["history_before_turn"] = f"""WITH {_PAIRS},
t AS (SELECT c.conv_id, c.turn, c.role, p.pair FROM conversations c
      LEFT JOIN pairs p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1),
h AS (SELECT conv_id, turn, role,
             list(pair) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
      FROM t),
f AS (SELECT conv_id, turn, role, list_filter(coalesce(l, []), lambda x: x IS NOT NULL) AS l FROM h)
SELECT conv_id, turn, role, array_to_string(l, ' ') AS history, CAST(len(l) AS BIGINT) AS n_pairs FROM f"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _system_prompt() -> str:
    from corpus_search.operators.prompts import SYSTEM_PROMPT

    return _sql_str(SYSTEM_PROMPT)


def _ctx_from_hits() -> str:
    return """
ctx0 AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id),
ctx AS (SELECT query_id, CASE WHEN len(string_split(context, ' ')) > 7168
                              THEN array_to_string(string_split(context, ' ')[1:7168], ' ') ELSE context END AS context
        FROM ctx0)"""


ORACLE_SQL["build_prompts"] = _flagship_hits() + f""",{_ctx_from_hits()},{_PAIRS},
hist AS (SELECT conv_id AS query_id, string_agg(pair, ' ' ORDER BY turn) AS history FROM pairs GROUP BY conv_id)
SELECT q.query_id, {_system_prompt()} AS system,
       '#### ' || coalesce(c.context, '') || ' ####' || chr(10) || '@@@@ ' || coalesce(h.history, '') || ' @@@@'
       || chr(10) || 'Asked: ' || q.question AS "user",
       CAST(2 AS BIGINT) AS n_messages
FROM questions q LEFT JOIN ctx c ON c.query_id = q.query_id LEFT JOIN hist h ON h.query_id = q.query_id"""

ORACLE_SQL["parse_replies"] = """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 500 ELSE 200 END AS status,
       CASE WHEN role = 'assistant' THEN text
            WHEN role = 'user' THEN '{"error":{"message":"no answer for role ' || role || '"}}' END AS answer,
       role = 'assistant' AS ok
FROM conversations"""

ORACLE_SQL["parse_stream_lines"] = """
WITH a AS (SELECT conv_id, turn, text FROM conversations),
w AS (SELECT a.conv_id, a.turn, u.i, u.w FROM a, unnest(string_split(a.text, ' ')) WITH ORDINALITY AS u(w, i)),
l AS (SELECT conv_id, turn, CAST(i AS BIGINT) AS line_no,
             'data: ' || json_object('choices', json_array(json_object('delta',
                 json_object('content', CASE WHEN i = 1 THEN w ELSE ' ' || w END)))) AS line FROM w
      UNION ALL SELECT conv_id, turn, CAST(0 AS BIGINT), 'data: {broken' FROM a
      UNION ALL SELECT conv_id, turn, CAST(2147483648 AS BIGINT), 'data: [DONE]' FROM a),
p AS (SELECT conv_id, turn, line_no, regexp_replace(line, '^data: ', '') AS payload FROM l),
q AS (SELECT conv_id, turn, line_no, payload = '[DONE]' AS done,
             CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.choices[0].delta.content') END AS piece
      FROM p)
SELECT conv_id, turn, count(*) AS n_lines,
       CAST(sum(CASE WHEN NOT done AND piece IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
       coalesce(string_agg(piece, '' ORDER BY line_no), '') AS text
FROM q GROUP BY conv_id, turn"""

ORACLE_SQL["context_text"] = _flagship_hits() + """
SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks
FROM hits GROUP BY query_id"""

ORACLE_SQL["truncate_context"] = """
SELECT doc_id,
       CASE WHEN len(string_split(text, ' ')) > 1024 THEN array_to_string(string_split(text, ' ')[1:1024], ' ') ELSE text END AS context,
       len(string_split(text, ' ')) > 1024 AS truncated,
       CAST(least(len(string_split(text, ' ')), 1024) AS BIGINT) AS context_tokens
FROM documents"""

ORACLE_SQL["rerank_bm25"] = _flagship_hits(50) + f""",
qt AS (SELECT DISTINCT query_id, t AS term
       FROM (SELECT query_id, unnest(string_split_regex(lower(question), '{WS}+')) AS t FROM questions) WHERE t <> ''),
ctoks AS (SELECT chunk_id, unnest(string_split_regex(lower(text), '{WS}+')) AS t FROM chunks),
dl AS (SELECT chunk_id, count(*) FILTER (WHERE t <> '') AS dl FROM ctoks GROUP BY chunk_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT t AS term, count(DISTINCT chunk_id) AS df FROM ctoks WHERE t IN (SELECT term FROM qt) GROUP BY t),
idf AS (SELECT term, ln(1.0::DOUBLE + ((SELECT n FROM corpus) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM dfs),
tf AS (SELECT chunk_id, t AS term, count(*) AS tf FROM ctoks
       WHERE t <> '' AND chunk_id IN (SELECT chunk_id FROM hits) GROUP BY ALL),
sc AS (SELECT h.query_id, h.chunk_id,
              sum(idf.idf * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / (SELECT avgdl FROM corpus)))) AS s
       FROM hits h JOIN qt ON qt.query_id = h.query_id
       JOIN tf ON tf.chunk_id = h.chunk_id AND tf.term = qt.term
       JOIN idf ON idf.term = qt.term JOIN dl ON dl.chunk_id = h.chunk_id
       GROUP BY ALL),
r AS (SELECT h.query_id, h.chunk_id, h.rank AS knn_rank, sc.s,
             row_number() OVER (PARTITION BY h.query_id ORDER BY sc.s IS NULL, round(sc.s, 9) DESC, h.rank) AS rerank_rank
      FROM hits h LEFT JOIN sc ON sc.query_id = h.query_id AND sc.chunk_id = h.chunk_id)
SELECT query_id, chunk_id, knn_rank, rerank_rank, round(s, 6) AS rerank_score FROM r WHERE rerank_rank <= 5"""

# ----------------------------------------------------------------------------- metrics

_CALLS = """
c AS (SELECT event_id, user_id, ts, event_type AS stage, value AS elapsed_s,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes FROM events),
a AS (SELECT stage, count(*) AS calls, sum(elapsed_s) AS total_time, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes
      FROM c GROUP BY stage),
m AS (SELECT stage, calls, round(total_time, 6) AS total_time, round(total_time / calls, 6) AS avg_time, total_bytes,
             round(total_bytes / 1048576, 6) AS total_mb,
             round(CASE WHEN total_time > 0 AND total_bytes > 0 THEN total_bytes / 1048576 / total_time ELSE 0 END, 6) AS mb_per_s
      FROM a)"""

ORACLE_SQL["stage_metrics"] = f"WITH {_CALLS}\nSELECT stage, calls, total_time, avg_time, total_bytes, total_mb FROM m"
ORACLE_SQL["stage_throughput"] = f"WITH {_CALLS}\nSELECT stage, mb_per_s FROM m"

ORACLE_SQL["stage_running_totals"] = f"""WITH {_CALLS},
r AS (SELECT event_id AS call_id, stage, count(*) OVER w AS running_calls, sum(elapsed_s) OVER w AS rt,
             CAST(sum(bytes) OVER w AS BIGINT) AS running_bytes
      FROM c WINDOW w AS (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT call_id, stage, running_calls, round(rt, 6) AS running_time, running_bytes,
       round(CASE WHEN rt > 0 AND running_bytes > 0 THEN running_bytes / 1048576 / rt ELSE 0 END, 6) AS running_mb_per_s
FROM r"""

ORACLE_SQL["step_elapsed"] = """
SELECT event_id AS call_id, user_id, event_type AS stage, lag(event_type) OVER w AS prev_stage,
       round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 6) AS since_prev_s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

ORACLE_SQL["bytes_lookup"] = f"""WITH {_CALLS},
o AS (SELECT event_id AS call_id, user_id, stage, CASE WHEN stage = 'purchase' THEN bytes END AS own FROM c),
l AS (SELECT user_id, max(bytes) AS size FROM c WHERE stage = 'view' GROUP BY user_id)
SELECT call_id, o.user_id, stage, CAST(coalesce(own, l.size, 0) AS BIGINT) AS bytes FROM o LEFT JOIN l ON l.user_id = o.user_id"""


def _fixed2(x: str) -> str:
    cents = f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"
    return (f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || CAST(abs({cents}) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(abs({cents}) % 100 AS VARCHAR), 2, '0'))")


ORACLE_SQL["metrics_report"] = f"""WITH {_CALLS}
SELECT stage, calls, {_fixed2('total_time')} AS time_s, {_fixed2('avg_time')} AS avg_time_s,
       {_fixed2('total_bytes / 1048576')} AS mb, {_fixed2('mb_per_s')} AS mb_per_s
FROM m"""


# ----------------------------------------------------------------------------- files and collections

ORACLE_SQL["scan_text"] = f"""
SELECT doc_id, {_strip('text')} AS text, CASE WHEN {_strip('text')} = '' THEN 'empty' ELSE 'ok' END AS status FROM documents"""

ORACLE_SQL["replicate_objects"] = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents"

ORACLE_SQL["append_collection"] = ORACLE_SQL["chunk_ids"]
ORACLE_SQL["recreate_collection"] = ORACLE_SQL["chunk_ids"]
ORACLE_SQL["collection_count"] = f"WITH {_chunks()}\nSELECT count(*) AS n_rows FROM chunks"

ORACLE_SQL["scan_images"] = """
SELECT vec_id, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, CAST(3 AS INTEGER) AS n_channels FROM embeddings"""

ORACLE_SQL["image_labels"] = "SELECT vec_id, label FROM embeddings"


# ----------------------------------------------------------------------------- streaming

ORACLE_SQL["stream_ingest"] = "SELECT DISTINCT md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS length FROM documents"
ORACLE_SQL["stream_index"] = f"""WITH {_chunks()},
k AS (SELECT *, source || '/' || doc_id || '.txt' AS rel FROM chunks)
SELECT md5(md5(rel) || ':' || chunk_index) AS chunk_id, rel AS source, chunk_index, md5(text) AS text_md5,
       CAST(256 AS BIGINT) AS width, true AS has_cell FROM k"""
ORACLE_SQL["stream_stage_metrics"] = ORACLE_SQL["stage_metrics"]
ORACLE_SQL["stream_history"] = ORACLE_SQL["history_before_turn"]

ORACLE_SQL["dedup_keep_first"] = """
SELECT doc_id, md5(text) AS md5 FROM documents d
WHERE doc_id = (SELECT min(doc_id) FROM documents x WHERE md5(x.text) = md5(d.text))"""

_PROMPTS = _flagship_hits() + f""",{_ctx_from_hits()},{_PAIRS},
hist AS (SELECT conv_id AS query_id, string_agg(pair, ' ' ORDER BY turn) AS history FROM pairs GROUP BY conv_id),
prompts AS (
  SELECT q.query_id,
         '#### ' || coalesce(c.context, '') || ' ####' || chr(10) || '@@@@ ' || coalesce(h.history, '') || ' @@@@'
         || chr(10) || 'Asked: ' || q.question AS "user"
  FROM questions q LEFT JOIN ctx c ON c.query_id = q.query_id LEFT JOIN hist h ON h.query_id = q.query_id)"""

ORACLE_SQL["request_payloads"] = _PROMPTS + """
SELECT query_id, 'generator' AS model, 'system' AS first_role, "user", 0.2::DOUBLE AS temperature, 0.9::DOUBLE AS top_p,
       CAST(40 AS BIGINT) AS top_k, CAST(512 AS BIGINT) AS max_tokens, '@@@@' AS stop, true AS no_stream
FROM prompts"""

ORACLE_SQL["answer_prompts"] = _PROMPTS + f""",
ex AS (SELECT query_id,
              {_strip("CASE WHEN len(string_split(\"user\", '####')) >= 3 THEN string_split(\"user\", '####')[2] ELSE '' END")} AS ctx
       FROM prompts),
fs AS (SELECT query_id, {_strip("string_split(ctx, '.')[1]")} AS first FROM ex)
SELECT query_id, CASE WHEN first = '' THEN 'The passages hold no answer.' ELSE first || '.' END AS answer,
       'ok' AS status
FROM fs"""

ORACLE_SQL["write_metrics_csv"] = f"""WITH {_CALLS},
r AS (SELECT stage, CAST(calls AS VARCHAR) AS calls, {_fixed2('total_time')} AS time_s, {_fixed2('avg_time')} AS avg_time_s,
             {_fixed2('total_bytes / 1048576')} AS mb, {_fixed2('mb_per_s')} AS mb_per_s FROM m)
SELECT * FROM r UNION ALL SELECT * FROM r"""

ORACLE_SQL["stream_window_metrics"] = """
WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type AS stage, value FROM events)
SELECT window_start, stage, count(*) AS calls, round(sum(value), 6) AS total_time
FROM w GROUP BY window_start, stage"""

ORACLE_SQL["knn_ivf_stored"] = ORACLE_SQL["knn_ivf"]

ORACLE_SQL["ordered_nulls"] = """
WITH r AS (SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN event_type END AS k,
                  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id = 5 THEN 1000000000000 ELSE event_id // 4 END AS t,
                  CASE WHEN event_id % 3 <> 0 THEN user_id END AS v FROM events)
SELECT event_id, coalesce(k, 'none') AS k, CAST(coalesce(t, -1) AS BIGINT) AS t, count(*) OVER w AS n,
       CAST(coalesce(sum(v) OVER w, -1) AS BIGINT) AS total,
       coalesce(lag(event_id) OVER (PARTITION BY k ORDER BY t NULLS FIRST, event_id), -1) AS prev
FROM r WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

# all cells are probed, so the stored collection must give the hits of the exact search
ORACLE_SQL["retrieve_stored"] = ORACLE_SQL["knn_with_text"]

ORACLE_SQL["chunk_recursive_faults"] = f"""
SELECT doc_id, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS blank, CAST(0 AS BIGINT) AS "foreign"
FROM documents WHERE {_strip('text')} <> ''"""

ORACLE_SQL["chunk_bulk"] = f"""WITH {_chunks(40000, 500)}
SELECT doc_id, chunk_index, CAST(0 AS INTEGER) AS piece, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM chunks"""

ORACLE_SQL["sheet_text"] = """
SELECT n_regionkey, string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey"""

# ----------------------------------------------------------------------------- pruned and indexed search

ORACLE_SQL["knn_pruned"] = ORACLE_SQL["knn_exact"]

ORACLE_SQL["ivf_tree"] = f"""WITH {_E},{_ivf()},
near AS (SELECT e.vec_id, c.cell_id, {_d2('e.v', 'c.v')} AS distance,
                row_number() OVER (PARTITION BY e.vec_id ORDER BY round({_d2('e.v', 'c.v')}, 9), c.cell_id) - 1 AS probe_rank
         FROM e, cent c)
SELECT vec_id, cell_id, probe_rank, round(distance, 6) AS distance FROM near WHERE probe_rank < 4"""

_BM25 = f"""
qt AS (SELECT DISTINCT query_id, t AS term
       FROM (SELECT query_id, unnest(string_split_regex(lower(question), '{WS}+')) AS t FROM questions) WHERE t <> ''),
ctoks AS (SELECT chunk_id, unnest(string_split_regex(lower(text), '{WS}+')) AS t FROM chunks),
dl AS (SELECT chunk_id, count(*) FILTER (WHERE t <> '') AS dl FROM ctoks GROUP BY chunk_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT chunk_id, t AS term, count(*) AS tf FROM ctoks WHERE t IN (SELECT term FROM qt) GROUP BY ALL),
idf AS (SELECT term, ln(1.0::DOUBLE + ((SELECT n FROM corpus) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY term),
part AS (SELECT tf.chunk_id, tf.term,
                idf.idf * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / (SELECT avgdl FROM corpus))) AS s
         FROM tf JOIN idf ON idf.term = tf.term JOIN dl ON dl.chunk_id = tf.chunk_id)"""

ORACLE_SQL["bm25_search"] = f"""
WITH {_chunks()},
questions AS (SELECT item_id AS query_id, text AS question FROM benchmark WHERE {_strip('text')} <> ''),{_BM25},
sc AS (SELECT query_id, chunk_id, sum(s) AS score FROM qt JOIN part ON part.term = qt.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""

ORACLE_SQL["rerank_bm25_stored"] = ORACLE_SQL["rerank_bm25"]

ORACLE_SQL["page_segments"] = """
WITH pages AS (
  SELECT d.doc_id, u.page_no, coalesce(u.page_text, '') AS t
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(page_text, page_no)),
p AS (SELECT *, CAST(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY page_no) AS BIGINT) - length(t) - 1 AS start FROM pages)
SELECT doc_id, start // 4000 AS segment, min(start) AS start, count(*) AS n_values, string_agg(t, chr(10) ORDER BY page_no) AS text
FROM p GROUP BY doc_id, start // 4000"""

ORACLE_SQL["history_prefixes"] = f"""
SELECT conv_id, turn, role, n_pairs, CAST(length(history) AS BIGINT) AS history_chars, CAST(0 AS BIGINT) AS segment, history
FROM ({ORACLE_SQL['history_before_turn']})"""

ORACLE_SQL["stream_turns"] = f"""
SELECT conv_id, turn, role, n_pairs, CAST(length(history) AS BIGINT) AS history_chars FROM ({ORACLE_SQL['history_before_turn']})"""

_PAGE_EXT = _ext(_KEY)

ORACLE_SQL["file_statuses"] = f"""
WITH f AS (
  SELECT 'text' AS format, {_strip("coalesce(text, '')")} AS t FROM documents
  UNION ALL
  SELECT CASE WHEN {_PAGE_EXT} = 'txt' THEN 'text' WHEN {_PAGE_EXT} LIKE 'htm%' THEN 'html' END AS format,
         CASE WHEN {_PAGE_EXT} LIKE 'htm%' THEN x.text ELSE {_strip("coalesce(html, '')")} END AS t
  FROM pages LEFT JOIN ({ORACLE_SQL['extract_page_text']}) x USING (page_id))
SELECT format, CASE WHEN format IS NULL THEN 'unsupported' WHEN t = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM f GROUP BY ALL"""

_STRIPPED = f"documents AS (SELECT doc_id, source, {_strip('text')} AS text FROM main.documents WHERE {_strip('text')} <> '')"


def _float(weights: str) -> str:
    return f"SELECT id, b, CAST(CAST(w AS FLOAT) AS DOUBLE) AS w FROM {weights}"


ORACLE_SQL["answer_from_files"] = f"""
WITH {_STRIPPED},{_chunks()},
lastq AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
questions AS (SELECT conv_id AS query_id, question FROM lastq WHERE {_strip('question')} <> ''),
{_hash_weights('c', 'chunks', 'chunk_id', 'text')},
{_hash_weights('q', 'questions', 'query_id', 'question')},
cf AS ({_float('c_w')}),
cn AS (SELECT chunk_id AS id, coalesce(n, 0) AS n FROM chunks LEFT JOIN (SELECT id, sum(w * w) AS n FROM cf GROUP BY id) ON id = chunk_id),
qn AS (SELECT query_id AS id, coalesce(n, 0) AS n FROM questions LEFT JOIN (SELECT id, sum(w * w) AS n FROM q_w GROUP BY id) ON id = query_id),
cell AS (SELECT cell_id, id FROM (SELECT row_number() OVER (ORDER BY md5(chunk_id)) - 1 AS cell_id, chunk_id AS id FROM chunks) WHERE cell_id < 16),
ccd AS (SELECT a.id, cell_id, sum(a.w * b.w) AS dot FROM cf a JOIN cf b ON a.b = b.b JOIN cell ON cell.id = b.id GROUP BY a.id, cell_id),
asg AS (SELECT id, cell_id FROM (
  SELECT a.id, k.cell_id, row_number() OVER (PARTITION BY a.id ORDER BY round(a.n + kn.n - 2 * coalesce(dot, 0), 9), k.cell_id) AS r
  FROM cn a CROSS JOIN cell k JOIN cn kn ON kn.id = k.id LEFT JOIN ccd ON ccd.id = a.id AND ccd.cell_id = k.cell_id) WHERE r = 1),
qcd AS (SELECT a.id, cell_id, sum(a.w * b.w) AS dot FROM q_w a JOIN cf b ON a.b = b.b JOIN cell ON cell.id = b.id GROUP BY a.id, cell_id),
probe AS (SELECT id, cell_id FROM (
  SELECT a.id, k.cell_id, row_number() OVER (PARTITION BY a.id ORDER BY round(a.n + kn.n - 2 * coalesce(dot, 0), 9), k.cell_id) AS r
  FROM qn a CROSS JOIN cell k JOIN cn kn ON kn.id = k.id LEFT JOIN qcd ON qcd.id = a.id AND qcd.cell_id = k.cell_id) WHERE r <= 4),
dots AS (SELECT q_w.id AS query_id, cf.id AS chunk_id, sum(q_w.w * cf.w) AS dot FROM q_w JOIN cf ON q_w.b = cf.b GROUP BY ALL),
near AS (SELECT p.id AS query_id, a.id AS chunk_id,
                row_number() OVER (PARTITION BY p.id ORDER BY round(qn.n + cn.n - 2 * coalesce(dot, 0), 9), a.id) AS rank
         FROM probe p JOIN asg a ON a.cell_id = p.cell_id JOIN qn ON qn.id = p.id JOIN cn ON cn.id = a.id
         LEFT JOIN dots ON dots.query_id = p.id AND dots.chunk_id = a.id),
hits AS (SELECT * FROM near WHERE rank <= 50),{_BM25},
sc AS (SELECT h.query_id, h.chunk_id, sum(part.s) AS s FROM hits h JOIN qt ON qt.query_id = h.query_id
       JOIN part ON part.chunk_id = h.chunk_id AND part.term = qt.term GROUP BY ALL),
r AS (SELECT h.query_id, h.chunk_id, row_number() OVER (PARTITION BY h.query_id ORDER BY sc.s IS NULL, round(sc.s, 9) DESC, h.rank) AS rr
      FROM hits h LEFT JOIN sc ON sc.query_id = h.query_id AND sc.chunk_id = h.chunk_id),
ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rr) AS c FROM r JOIN chunks USING (chunk_id) WHERE rr <= 5 GROUP BY query_id),
hb AS ({ORACLE_SQL['history_before_turn']}),
hist AS (SELECT lastq.conv_id AS query_id, hb.history FROM lastq JOIN hb ON hb.conv_id = lastq.conv_id AND hb.turn = lastq.turn)
SELECT q.query_id, '#### ' || CASE WHEN len(string_split(ctx.c, ' ')) > 7168 THEN array_to_string(string_split(ctx.c, ' ')[1:7168], ' ') ELSE coalesce(ctx.c, '') END
       || ' ####' || chr(10) || '@@@@ ' || coalesce(hist.history, '') || ' @@@@' || chr(10) || 'Asked: ' || q.question AS "user"
FROM questions q LEFT JOIN ctx USING (query_id) LEFT JOIN hist USING (query_id)"""

ORACLE_SQL["list_tree"] = """
SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM documents"""

ORACLE_SQL["scan_tree_md5"] = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS length, md5(coalesce(text, '')) AS md5 FROM documents"""

ORACLE_SQL["stream_ingest_exact"] = ORACLE_SQL["stream_ingest"]

ORACLE_SQL["append_by_ledger"] = ORACLE_SQL["append_collection"]

ORACLE_SQL["replicate_ranges"] = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, greatest(1, (strlen(coalesce(text, '')) + 999) // 1000) AS n_ranges,
       CASE WHEN strlen(coalesce(text, '')) <= 1000 THEN md5(coalesce(text, '')) END AS md5
FROM documents"""
