"""DuckDB SQL for those queries that SQL can express, written from their definitions and not from their methods."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: All pairs of texts by their shared shingles, then reachability.
COMPONENTS = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id"""

_FIVE = "CAST('0x' || substr(h, {k}, 5) AS BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_FIVE.format(k=5 * k + 1)} >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

#: A revisit refers to the smallest page id with the same payload.
PAGES = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS h FROM pages), f AS (SELECT h AS k, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, 'ok' AS status FROM p JOIN f ON f.k = p.h"""

#: All 100-byte strings, as 200 hexadecimal digits; marked unless they are the first of their kind.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
c AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS lo, a AS hi, e - a AS gone FROM r),
t AS (SELECT c.doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS head, sum(gone) AS n_removed, count(*) AS n_spans FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY 1),
z AS (SELECT doc_id, max(e) AS last FROM r GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.head, '') || substr(x, 2 * coalesce(z.last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id"""

#: Every anchor against every row.
NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor AS anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

#: All phrases of up to four words, their cuts, and those that a longer one explains.
COLLOCATIONS = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, k.n AS size, array_to_string(w[i:i + k.n - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w) x, (SELECT unnest(range(1, 5)) AS n) k WHERE i + k.n - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
k AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.size, k.phrase, k.a, k.w, k.k, x.f AS l, y.f AS r, CAST((CAST(k.a AS HUGEINT) * 2000000) // (x.f + y.f) AS BIGINT) AS score FROM k
 JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, array_to_string(w[i:i + m.m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, size, w, a, unnest(range(1, size + 1)) AS i FROM c) x, (SELECT unnest(range(2, 4)) AS m) m WHERE m.m < size AND i + m.m - 1 <= size GROUP BY 1, 2),
r AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT r.lang, rank, phrase, a, l, r, t.n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000"""
