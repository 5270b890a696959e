"""The queries in DuckDB SQL, where SQL can express them."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
FOLDED = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
win AS (
  SELECT r, i, list_slice(ws, i, i + 7) AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
ln AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '{WORD}') GROUP BY r
),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(ln.n, 0)::BIGINT AS n_full_lines
  FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)
),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_full_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT *, failed % 4 <> 0 AS base_failed, failed % 8 = 0 AS kept FROM f
"""

ABLATIONS = f"""
WITH ledger AS ({OP1}),
best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
tests(policy, mask, rule, bit) AS (
  SELECT policy, mask, rule, bit FROM
    (VALUES ('v1', 3), ('v2', 7), ('v3', 15), ('v4', 63)) AS p(policy, mask)
    JOIN (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8),
                 ('short_words', 16), ('long_words', 32)) AS r(rule, bit) ON bit <= mask
)
SELECT policy, rule, count(*) AS n_docs, count(*) FILTER ((failed & mask) <> 0) AS n_rejected,
       count(*) FILTER ((failed & bit) <> 0) AS n_failed,
       count(*) FILTER ((failed & mask) = bit) AS n_rescued,
       count(*) FILTER ((failed & mask) = bit AND quality = 1) AS n_rescued_good,
       count(*) FILTER ((failed & mask) = bit AND quality = 0) AS n_rescued_poor
FROM ledger LEFT JOIN best USING (doc_id) CROSS JOIN tests GROUP BY policy, rule
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
b AS (
  SELECT item_id::VARCHAR AS item, row_number() OVER () AS k,
    regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
),
bw AS (
  SELECT DISTINCT k, item, n, list_slice(ws, i, i + n - 1) AS x
  FROM (SELECT k, item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)
),
dw AS (
  SELECT r, n, i, list_slice(ws, i, i + n - 1) AS x
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
),
hits AS (SELECT r, dw.n, i, k, item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
),
q AS (SELECT *, strlen(h) >= 1000 AND top <> page_id AS again FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to
FROM q
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '{WORD}') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, list_slice(ws, i, i + 4) AS x
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)
  )
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * n_common >= 85 * (na.n + nb.n - n_common)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.doc_id
),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, i, ls[i] AS line FROM (SELECT doc_id, r, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (
  SELECT *, {FOLDED.format("regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')")} AS key
  FROM l
),
o AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS lost FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM o GROUP BY doc_id, r
"""

OP9 = """
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(k)
),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
  FROM c
),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) IS NOT DISTINCT FROM role AND i > 1 AS goes_on,
    length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars,
    length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS role_chars
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN goes_on THEN length('<|im_sep|>')
    ELSE length('<|im_start|>') + role_chars + 1 + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
),
g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0
),
links AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
),
reach(r, s) AS (
  SELECT r, r FROM v
  UNION
  SELECT links.b, reach.s FROM reach JOIN links ON links.a = reach.r
),
c AS (SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""

#: One round of op12: assignment of all vectors to the centroids of ``c{k}``, and the next centroids.
_ASSIGNED = """
d{k} AS (
  SELECT w.r, c.c, sum((w.v - c.v) * (w.v - c.v))::BIGINT AS d FROM w JOIN c{k} c USING (i) GROUP BY w.r, c.c
),
a{k} AS (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
"""
_MOVED = """
m{k} AS (
  SELECT a{k}.c, w.i, floor_div(sum(w.v)::BIGINT, count(*)) AS v FROM w JOIN a{k} USING (r) GROUP BY a{k}.c, w.i
),
c{n} AS (SELECT o.c, o.i, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN m{k} m ON m.c = o.c AND m.i = o.i),
"""

OP12 = (
    """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (
  SELECT * FROM e WHERE len(x) = 64 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
w AS (
  SELECT r, i, floor(64 * x[i])::BIGINT AS v FROM (SELECT r, x, unnest(range(1, 65)) AS i FROM g)
),
f AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c FROM g
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) <= 16
),
c0 AS (SELECT f.c, w.i, w.v FROM f JOIN w USING (r)),
"""
    + "".join(_ASSIGNED.format(k=k) + _MOVED.format(k=k, n=k + 1) for k in range(3))
    + _ASSIGNED.format(k=3)
    + """
s AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, a3.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM g JOIN a3 USING (r) JOIN s ON s.c = a3.c
"""
).replace("floor_div(sum(w.v)::BIGINT, count(*))", "(sum(w.v)::BIGINT - ((sum(w.v)::BIGINT % count(*)) + count(*)) % count(*)) // count(*)")

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
b AS (
  SELECT row_number() OVER () AS k, item_id,
    regexp_extract_all({FOLDED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
),
t AS (SELECT count(*)::BIGINT AS total, sum(len(ws))::BIGINT AS length FROM d WHERE len(ws) > 0),
q AS (SELECT k, term, count(*) AS often FROM (SELECT k, unnest(ws) AS term FROM b) GROUP BY k, term),
p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term
),
w AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t
),
m AS (SELECT r, doc_id, 75 + (25 * len(ws)::BIGINT * total) // length AS m FROM d, t WHERE len(ws) > 0),
s AS (
  SELECT q.k, m.r, m.doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM p JOIN m USING (r) JOIN w USING (term) JOIN q USING (term) GROUP BY q.k, m.r, m.doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN b USING (k) WHERE rank <= 20
"""

LLM_ORACLE: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op3_decontamination": OP3,
    "op6_warc": OP6,
    "op7_minhash": OP7,
    "op8_line_dedup": OP8,
    "op9_chat": OP9,
    "op11_embedding_dedup": OP11,
    "op12_centroids": OP12,
    "op13_lexical_search": OP13,
    "quality_ablations": ABLATIONS,
}
