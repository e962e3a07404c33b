"""DuckDB SQL of the queries that SQL can express. The others hash with XXH64, tokenize, learn or pack, and are tested by brute force."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1 = rf"""WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS l FROM documents),
g AS (SELECT doc_id, k, array_to_string(list_slice(l, k, k + 12), ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS k FROM w)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT g.doc_id, unnest(range(k, k + 13)) AS i FROM g JOIN f ON g.s = f.s WHERE first < g.doc_id)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM w) x
  LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(l) AS n_words, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

OP4 = rf"""WITH d AS (SELECT doc_id, source, coalesce(len({WORDS}), 0) AS size, md5('mix-1' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
r AS (SELECT *, (place - 1) % 3 + 1 AS w, CAST(3.0 * source_size AS DOUBLE) AS cap, CAST(3.0 * source_size AS DOUBLE) / ((place - 1) % 3 + 1) AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, place, CASE WHEN ratio <= top THEN cap ELSE top * w END AS target FROM (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS top FROM l)),
q AS (SELECT d.*, source_size, place, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - CAST(size AS DOUBLE) / 2 AS reach FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT doc_id, size, place, (pass * source_size + reach) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND target > 0)),
k AS (SELECT doc_id, sum(size) AS taken FROM p WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id"""

#: Five hex digits are four characters of base32; its alphabet is a fixed value.
OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
t AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::BIGINT) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS top FROM v UNION SELECT p.b, r.top FROM reach r JOIN pairs p ON p.a = r.node WHERE p.b > r.top),
least AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON vec_id = node LEFT JOIN n ON vec_id = a"""

OP11 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*) FILTER (len(l) > 0) AS nn, CAST(sum(len(l)) AS BIGINT) AS ll FROM d),
p AS (SELECT doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT doc_id, len(l) AS n, unnest(l) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""

OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5"""

ORACLES = {"op1_substring_dedup": OP1, "op4_mixing": OP4, "op8_warc": OP8, "op9_embedding_dedup": OP9, "op11_lexical_search": OP11, "op12_hard_negatives": OP12}
