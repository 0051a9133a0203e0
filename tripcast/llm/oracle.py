"""DuckDB text for the training-data operators that SQL can express."""

from __future__ import annotations

from . import ngram_join, sharding, substring_dedup, suffix_dedup

#: The table is filled turn by turn: step t is the turn of shard t mod n, which claims the first free slot of its order.
OP3_SHARDING = f"""
WITH RECURSIVE shards AS (
  SELECT i, CAST('0x' || substr(md5('offset|' || name), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS off,
         CAST('0x' || substr(md5('step|' || name), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE - 1} + 1 AS step
  FROM (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({sharding.N_SHARDS}) r(i))
), orders AS (
  SELECT list(pref ORDER BY i) AS prefs FROM (
    SELECT i, list((off + j * step) % {sharding.TABLE_SIZE} ORDER BY j) AS pref
    FROM shards, range({sharding.TABLE_SIZE}) q(j) GROUP BY i)
), turns AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS slot, list_transform(range({sharding.TABLE_SIZE}), lambda x: false) AS taken,
         list_transform(range({sharding.N_SHARDS}), lambda x: CAST(0 AS BIGINT)) AS pos
  UNION ALL
  SELECT t + 1, slot, list_transform(taken, lambda x, k: x OR k = slot + 1),
         list_transform(pos, lambda x, k: CASE WHEN k = s + 1 THEN p ELSE x END)
  FROM (SELECT *, pref[p] AS slot FROM (SELECT t, taken, pos, pref, s,
               list_filter(range(pos[s + 1] + 1, {sharding.TABLE_SIZE} + 1),
                           lambda k: NOT taken[pref[k] + 1])[1] AS p
        FROM (SELECT t, taken, pos, t % {sharding.N_SHARDS} AS s, prefs[t % {sharding.N_SHARDS} + 1] AS pref
              FROM turns, orders WHERE t < {sharding.TABLE_SIZE})))
), slots AS (SELECT slot, (t - 1) % {sharding.N_SHARDS} AS shard_id FROM turns WHERE slot IS NOT NULL)
SELECT doc_id, slot, shard_id FROM (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS slot
  FROM documents) JOIN slots USING (slot)
"""

#: Every 50-byte string of every text with the smallest document it starts in. Marked starts make spans; what lies between
#: the spans is kept.
OP2_SUFFIX_ARRAY_DEDUP = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, array_slice(h, i + 1, i + {suffix_dedup.SIZE}) AS s
      FROM t, LATERAL (SELECT unnest(range(greatest(0, octet_length(h) - {suffix_dedup.SIZE - 1}))) AS i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {suffix_dedup.SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m)),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + {suffix_dedup.SIZE} AS b FROM g GROUP BY doc_id, span),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
               list(a ORDER BY a) AS starts, list_prepend(0, list(b ORDER BY a)) AS stops FROM spans GROUP BY doc_id)
SELECT t.doc_id, octet_length(h) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN cut.doc_id IS NULL THEN h ELSE unhex(array_to_string(list_transform(range(1, len(stops) + 1),
         lambda k: CASE WHEN stops[k] < coalesce(starts[k], octet_length(h))
                        THEN hex(array_slice(h, stops[k] + 1, coalesce(starts[k], octet_length(h)))) ELSE '' END), '')) END) AS kept_sha256
FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id
"""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Every 50-word window with the smallest document it starts in.
OP4_SUBSTRING_DEDUP = f"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {substring_dedup.SIZE - 1}], ' ')) AS s
        FROM t, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - {substring_dedup.SIZE - 2}))) AS i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM m, range({substring_dedup.SIZE}) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS s, count(*) AS n
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i WHERE gone.i IS NULL GROUP BY words.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

#: Overlaps of all pairs that share a shingle, and the documents reachable over the links.
OP9_NGRAM_JACCARD_JOIN = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {ngram_join.NGRAM}
               THEN list_distinct(list_transform(range(1, len(w) - {ngram_join.NGRAM - 2}), lambda i: array_to_string(w[i:i + {ngram_join.NGRAM - 1}], ' ')))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM t),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {ngram_join.PERCENT} * (a.n + b.n - count(*))),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS r FROM sym UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON reach.r = sym.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id, len(sh)
"""

#: Every n-gram of every piece; parts of a candidate are at least as frequent, so rarer ones are not kept.
OP12_PHRASE_COLLOCATIONS = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
places AS (SELECT lang, k, w, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM p, range(1, 6) s(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT f.lang, f.phrase, f.a, totals.n, c.cut, l.a AS l, r.a AS r,
                (CAST(1000 AS HUGEINT) * f.a * totals.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
         FROM f JOIN range(1, 5) c(cut) ON c.cut < f.k JOIN totals ON totals.lang = f.lang
         JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(string_split(f.phrase, ' ')[1:c.cut], ' ')
         JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(string_split(f.phrase, ' ')[c.cut + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM scored c WHERE NOT EXISTS (
  SELECT 1 FROM f g WHERE g.lang = c.lang AND length(g.phrase) > length(c.phrase) AND 100 * g.a >= 100 * c.a
   AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

#: All anchors against all rows.
OP13_HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score) WHERE rank <= 10
"""

SQL: dict[str, str] = {
    "op2_suffix_array_dedup": OP2_SUFFIX_ARRAY_DEDUP,
    "op3_sharding": OP3_SHARDING,
    "op4_substring_dedup": OP4_SUBSTRING_DEDUP,
    "op9_ngram_jaccard_join": OP9_NGRAM_JACCARD_JOIN,
    "op12_phrase_collocations": OP12_PHRASE_COLLOCATIONS,
    "op13_hard_negatives": OP13_HARD_NEGATIVES,
}
