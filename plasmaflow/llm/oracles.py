"""DuckDB SQL for the training-data queries that SQL can express."""

MAXSCORE = """
WITH v AS (SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: FLOOR(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(LIST_INNER_PRODUCT(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(words[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, words, UNNEST(GENERATE_SERIES(1, GREATEST(LEN(words) - 3, LEAST(LEN(words), 1)))) AS i FROM w)),
n AS (SELECT w.doc_id, COUNT(shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = n.doc_id
"""

LINES = r"""
WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, CHR(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line_no, line, LIST_SORT(LIST_DISTINCT(LIST_FILTER(STRING_SPLIT_REGEX(LOWER(line), '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS w FROM l),
k AS (SELECT w, MIN((doc_id, line_no)) AS first, LEN(w) AS n FROM t WHERE LEN(w) > 0 GROUP BY w),
u AS (SELECT ROW_NUMBER() OVER (ORDER BY first) AS id, * FROM k),
tok AS (SELECT id, n, UNNEST(w) AS word FROM u),
pr AS (SELECT b.id, a.id AS a_id, COUNT(*) AS k, ANY_VALUE(a.n) AS an, ANY_VALUE(b.n) AS bn FROM tok a JOIN tok b ON a.word = b.word AND a.id < b.id AND 100 * LEAST(a.n, b.n) >= 80 * GREATEST(a.n, b.n) GROUP BY b.id, a.id),
bad AS (SELECT DISTINCT id FROM pr WHERE 100 * k >= 80 * (an + bn - k)),
g AS (SELECT t.doc_id, t.line_no, t.line, COALESCE(bad.id IS NOT NULL OR (t.doc_id, t.line_no) <> u.first, FALSE) AS gone FROM t LEFT JOIN u ON u.w = t.w LEFT JOIN bad ON bad.id = u.id)
SELECT doc_id, COALESCE(STRING_AGG(line, CHR(10) ORDER BY line_no) FILTER (NOT gone), '') AS text, CAST(COUNT(*) AS INT) AS n_lines, CAST(COUNT(*) FILTER (gone) AS INT) AS n_removed FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL
"""

COLLOCATIONS = r"""
WITH d AS (SELECT doc_id, COALESCE(lang, 'und') AS lang, REGEXP_SPLIT_TO_ARRAY(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, REGEXP_EXTRACT_ALL(UNNEST(pieces), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, UNNEST(LIST_TRANSFORM(GENERATE_SERIES(1, LEN(w) - k + 1), lambda i: ARRAY_TO_STRING(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT UNNEST([1, 2, 3, 4]) AS k) WHERE LEN(w) >= k),
f AS (SELECT lang, k, phrase, COUNT(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, SUM(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS m, phrase, a, STRING_SPLIT(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT *, UNNEST(GENERATE_SERIES(1, m - 1)) AS cut FROM c),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, CAST(2000000 AS HUGEINT) * cuts.a // (x.a + y.a) AS score FROM cuts
      JOIN f x ON x.lang = cuts.lang AND x.phrase = ARRAY_TO_STRING(w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = ARRAY_TO_STRING(w[cut + 1:], ' ')),
weak AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, a, UNNEST(LIST_TRANSFORM(LIST_FILTER([[1, 2], [2, 2], [3, 2], [1, 3], [2, 3]], lambda x: x[2] < m AND x[1] + x[2] <= m + 1), lambda x: ARRAY_TO_STRING(w[x[1]:x[1] + x[2] - 1], ' '))) AS phrase FROM c WHERE m > 2),
k AS (SELECT * FROM weak WHERE NOT EXISTS (FROM inside i WHERE i.lang = weak.lang AND i.phrase = weak.phrase AND 100 * i.a >= 80 * weak.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k JOIN t USING (lang)) WHERE rank <= 2000
"""
