"""What queries return, as SQL over whole tables, where SQL can express it."""

_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

SUBSTRING_DEDUP = f"""
WITH {_WORDS},
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (k) WHERE first < doc_id),
x AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT x.doc_id, count(hit.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (hit.p IS NULL) AS kept FROM x LEFT JOIN hit ON hit.doc_id = x.doc_id AND hit.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

SUFFIX_DEDUP = f"""
WITH {_WORDS},
g AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS first, max(doc_id) AS last FROM g GROUP BY k),
s AS (SELECT doc_id, i, first < doc_id AS later FROM g JOIN m USING (k) WHERE first <> last),
hit AS (SELECT doc_id, p, bool_or(later) AS later FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p, later FROM s) GROUP BY ALL),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit)
SELECT doc_id, min(p) - 1 AS start_word, count(*) AS n_words, count(*) FILTER (later) AS n_removed FROM r GROUP BY doc_id, run
"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS k, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
f AS (SELECT doc_id, i, n, item_id FROM g JOIN p USING (k, n)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: All pairs, where the query uses its index: equal as long as the index finds every link of the tables at hand.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(c) FROM r WHERE r.vec_id = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(c) FROM r WHERE r.vec_id = v.vec_id) AS kept FROM v
"""

#: crc32 as a fold over bits: a table of 256 steps, then one step a byte of each different word.
_CRC_STEPS = "s AS (SELECT list(c ORDER BY i) AS step FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"

IMPORTANCE = f"""
WITH {_CRC_STEPS},
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT {_FOLDED} AS w FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
v AS (SELECT DISTINCT word FROM dw UNION SELECT word FROM bw),
h AS (SELECT word, hex(encode(word)) AS x, step FROM v, s),
k AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(x), 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT), lambda c, y: xor(step[(xor(c, y) % 256 + 1)::BIGINT], c // 256)), 4294967295) % 10000 AS bucket FROM h),
sb AS (SELECT bucket, sum(n) AS s FROM dw JOIN k USING (word) GROUP BY bucket),
tb AS (SELECT bucket, sum(n) AS t FROM bw JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM sb) + 10000))::DOUBLE / ((s + 1) * (coalesce((SELECT sum(t) FROM tb), 0) + 10000))::DOUBLE)) AS gain FROM sb LEFT JOIN tb USING (bucket)),
f AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
o AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, 10 * (count(*) FILTER (n_features >= 20) OVER ()) // 100 AS most FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= most THEN k END AS rank FROM r
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
