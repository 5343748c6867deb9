"""DuckDB SQL of the queries that SQL can state."""

#: A list of the 256 steps of a crc32 by bytes.
CRC = """steps AS (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS step
  FROM range(256) t(i))"""


def crc(codes: str) -> str:
    """crc32 of a list of bytes, by the table ``steps``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda x, y: xor(x >> 8, step[(xor(x, y) & 255) + 1])), 4294967295)"


ASCII = "list_transform(string_split({}, ''), lambda c: unicode(c)::BIGINT)"
UTF8 = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [list_aggregate(words, 'string_agg', ' ')]
  ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS gram FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN twoway x ON x.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

OP12_SQL = f"""WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
lowered AS (SELECT doc_id, {LOWERED.format('r')} AS r FROM runs WHERE length(r) >= 7),
hashed AS (SELECT r, {crc(UTF8.format("doc_id || ':' || r"))} AS h FROM lowered, steps),
words AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word FROM hashed),
vocab AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
cuts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM vocab),
short AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS s FROM cuts),
near AS (SELECT DISTINCT a.word AS word, b.word AS other, b.n AS n FROM short a JOIN vocab b ON b.word = a.s
  UNION SELECT DISTINCT b.word, a.word, a.n FROM short a JOIN vocab b ON b.word = a.s
  UNION SELECT a.word, b.word, b.n FROM short a JOIN short b ON a.k = b.k AND a.s = b.s AND a.word != b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, w := other)) AS b FROM near GROUP BY 1),
known AS (SELECT v.word, CASE WHEN -b.m >= 10 * v.n THEN b.w END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * v.n THEN -b.m END AS form_n
  FROM vocab v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM known WHERE form IS NOT NULL UNION SELECT w.word, k.form FROM walk w JOIN known k ON k.word = w.at WHERE k.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN known k ON k.word = w.at WHERE k.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM known LEFT JOIN ends USING (word)"""

OP13_SQL = f"""WITH {CRC},
seqs AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
hs AS (SELECT conv_id, s, {crc(ASCII.format("CAST(conv_id AS VARCHAR)"))} % 6 AS h FROM seqs, steps),
built AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM hs a LEFT JOIN hs b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (SELECT conv_id, len(s) AS length, s[1:d] AS p, d FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends FROM prefixes GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT x.p, x.d, CAST(count(*) FILTER (k.n IS NULL) AS BIGINT) AS leaves,
    CAST(sum(CASE WHEN y.d = 0 THEN 0 ELSE (y.n - 1) * length(y.p[y.d].t) END) AS BIGINT) AS saved
  FROM nodes x JOIN nodes y ON y.d >= x.d AND y.p[1:x.d] = x.p LEFT JOIN kids k ON k.p = y.p AND k.d = y.d GROUP BY 1, 2)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN below b ON b.p = x.p AND b.d = x.d LEFT JOIN kids k ON k.p = x.p AND k.d = x.d LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]"""
