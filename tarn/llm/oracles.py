"""DuckDB SQL of the queries that SQL can express on whole tables."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT k, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
p AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY k),
f AS (SELECT w.k, doc_id, words, lines, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p ON p.k = w.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 10 * n_symbols <= n_words
         AND word_chars BETWEEN 2 * n_words AND 20 * n_words
         AND 2 * n_dup_lines <= len(lines)
         AND 10 * len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) <= 3 * n_words
         AND 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) >= 8 * n_words AS kept
FROM f
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
y AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, min(doc_id) AS first FROM y WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
z AS (SELECT y.*, r.key IS NOT NULL AND y.doc_id <> r.first AS gone FROM y LEFT JOIN r ON r.key = y.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM z GROUP BY k, doc_id
"""

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT k, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
h AS (SELECT k, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h FROM s),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
u AS (SELECT k, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d),
m AS (SELECT u.k, u.doc_id, u.word, u.j, max(r.i) OVER (PARTITION BY u.k ORDER BY u.j) AS last
      FROM u LEFT JOIN r ON r.k = u.k AND r.i = u.j),
f AS (SELECT *, last IS NOT NULL AND j - last < 35 AS gone FROM m),
g AS (SELECT k, count(*)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
             string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM f GROUP BY k)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.k = d.k
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op6_line_dedup": OP6, "op7_substring_dedup": OP7}

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op2_topk"] = OP2

OP13 = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
             lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x) - 64] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
y AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM x),
e AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM y a JOIN y b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, a.n, v.word, v.n FROM y a JOIN v ON v.word = a.less
      UNION SELECT v.word, v.n, a.word, a.n FROM y a JOIN v ON v.word = a.less),
k AS (SELECT word, count(*)::BIGINT AS n_near, max(m) AS top, arg_min(near, (-m, encode(near))) AS best FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * v.n THEN best END AS form,
             CASE WHEN top >= 2 * v.n THEN top::BIGINT END AS form_n FROM v LEFT JOIN k USING (word)),
g AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.next)
SELECT f.word, f.n, n_near, f.form, form_n, g.at AS root FROM f JOIN g ON g.word = f.word AND g.next IS NULL
"""

ORACLES["op13_spelling"] = OP13
