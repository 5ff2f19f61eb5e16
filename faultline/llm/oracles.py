"""DuckDB SQL that must give the rows of a query, read over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_exact_dedup"] = """
WITH digests AS (
    SELECT doc_id,
           sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM digests
"""

SQL["op4_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT AS place
    FROM documents
),
summed AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS source_no,
           (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
    FROM summed
),
levelled AS (
    SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(3 * sum(source_size) OVER before, 0)::BIGINT)
              / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT) AS level
    FROM numbered
    WINDOW before AS (ORDER BY source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
held AS (
    SELECT *, first_value(CASE WHEN level * weight <= 3 * source_size THEN level END IGNORE NULLS)
              OVER (ORDER BY source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS water
    FROM levelled
),
targets AS (
    SELECT source, source_no, source_size, coalesce(water * weight, 3.0 * source_size)::DOUBLE AS target,
           ceil(source_size / 16)::BIGINT AS blocks,
           least(4096, greatest(1, ceil(source_size / 65536)))::BIGINT AS shards,
           round((sum(source_size) OVER ())::BIGINT / 16)::BIGINT AS seats
    FROM held
),
source_seats AS (
    SELECT source_no, seats, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source_no) AS place
    FROM (SELECT *, unnest(range(1, 3 * blocks + 1)) AS seat FROM targets)
),
quotas AS (
    SELECT t.*, count(s.source_no) AS quota
    FROM targets t LEFT JOIN source_seats s ON s.source_no = t.source_no AND s.place <= s.seats GROUP BY ALL
),
placed AS (
    SELECT d.*, q.source_no, q.source_size, q.target, d.place % q.shards AS shard
    FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
),
sharded AS (
    SELECT source_no, shard, sum(size)::BIGINT AS words FROM placed GROUP BY source_no, shard
),
lined AS (
    SELECT s.*, coalesce(sum(words) OVER (PARTITION BY source_no ORDER BY shard
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
           q.quota // greatest(q.blocks, 1) AS rounds, q.quota - q.quota // greatest(q.blocks, 1) * q.blocks AS extra_all
    FROM sharded s JOIN quotas q USING (source_no)
),
blocked AS (
    SELECT *, ceil(start / 16)::BIGINT AS first, ceil((start + words) / 16)::BIGINT - ceil(start / 16)::BIGINT AS own
    FROM lined
),
shard_seats AS (
    SELECT source_no, shard, extra_all,
           row_number() OVER (PARTITION BY source_no ORDER BY own / (2 * seat - 1) DESC, shard) AS place
    FROM (SELECT *, unnest(range(1, own + 1)) AS seat FROM blocked)
),
chosen AS (
    SELECT b.*, count(s.shard) AS extra, CASE WHEN own % 1000003 = 0 THEN 1000033 ELSE 1000003 END AS stride,
           ('0x' || substr(md5('mix|' || b.source_no || '|' || b.shard), 1, 8))::BIGINT AS turn
    FROM blocked b
    LEFT JOIN shard_seats s ON s.source_no = b.source_no AND s.shard = b.shard AND s.place <= s.extra_all GROUP BY ALL
),
selected AS (
    SELECT c.source_no, b.block, c.rounds + (((b.block - c.first) * c.stride + c.turn) % c.own < c.extra)::BIGINT AS copies
    FROM chosen c, unnest(range(c.first, c.first + c.own)) AS b(block)
),
laid AS (
    SELECT p.*, c.start + coalesce(sum(size) OVER (PARTITION BY p.source_no, p.shard ORDER BY p.place, doc_id NULLS FIRST, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
    FROM placed p JOIN chosen c ON c.source_no = p.source_no AND c.shard = p.shard
),
cut AS (
    SELECT *, unnest(range(low // 16, CASE WHEN size > 0 THEN (low + size - 1) // 16 + 1 ELSE low // 16 END)) AS block
    FROM laid
),
taken AS (
    SELECT cut.doc_id, cut.source_no, cut.low, cut.size,
           sum((least(low + size, (cut.block + 1) * 16) - greatest(low, cut.block * 16)) * copies)::BIGINT AS taken
    FROM cut JOIN selected s ON s.source_no = cut.source_no AND s.block = cut.block GROUP BY ALL
)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(t.taken, 0) AS taken
FROM laid l
LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM l.doc_id AND t.source_no = l.source_no AND t.low = l.low AND t.size = l.size
"""

SQL["op11_conversations"] = r"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295, list_transform(
                   string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS what
    FROM conversations
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
           CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM turns, range(CASE WHEN what = 3 THEN 2 ELSE 1 END) WHERE what <> 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat(strlen(role), ':', role, text))) AS i,
           count(*) OVER (PARTITION BY conv_id) AS n,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown
    FROM damaged
),
faulty AS (
    SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
           left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM ranked
),
-- Cheapest rest from row i on, by what was said last: nothing, s, u, a. Insertions come before the edit of the row.
rests AS (
    SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0, 'e': ''} AS v0, {'c': 10, 'e': 'II'} AS v1, {'c': 5, 'e': 'I'} AS v2, {'c': 0, 'e': ''} AS v3
    FROM faulty
    UNION ALL
    SELECT conv_id, i,
           least(w0, {'c': w2.c + 5, 'e': 'I' || w2.e}, {'c': w3.c + 10, 'e': 'II' || w3.e}),
           least(w1, {'c': w2.c + 5, 'e': 'I' || w2.e}, {'c': w3.c + 10, 'e': 'II' || w3.e}),
           least(w2, {'c': w3.c + 5, 'e': 'I' || w3.e}), least(w3, {'c': w2.c + 5, 'e': 'I' || w2.e})
    FROM (
        SELECT conv_id, i,
               least({'c': v0.c + 2, 'e': 'D' || v0.e}, {'c': CASE WHEN initial = 's' THEN left_ ELSE 99999999 END + v1.c, 'e': 'K' || v1.e},
                     {'c': CASE WHEN initial = 'u' THEN left_ ELSE 99999999 END + v2.c, 'e': 'K' || v2.e}, {'c': left_ + 1 + v2.c, 'e': 'R' || v2.e}) AS w0,
               least({'c': v1.c + 2, 'e': 'D' || v1.e}, {'c': CASE WHEN initial = 'u' THEN left_ ELSE 99999999 END + v2.c, 'e': 'K' || v2.e},
                     {'c': left_ + 1 + v2.c, 'e': 'R' || v2.e}) AS w1,
               least({'c': v2.c + 2, 'e': 'D' || v2.e}, {'c': CASE WHEN initial = 'a' THEN left_ ELSE 99999999 END + v3.c, 'e': 'K' || v3.e},
                     {'c': left_ + 1 + v3.c, 'e': 'R' || v3.e}) AS w2,
               least({'c': v3.c + 2, 'e': 'D' || v3.e}, {'c': CASE WHEN initial = 'u' THEN left_ ELSE 99999999 END + v2.c, 'e': 'K' || v2.e},
                     {'c': left_ + 1 + v2.c, 'e': 'R' || v2.e}) AS w3
        FROM (
            SELECT r.*, f.i AS row_i, f.initial, CASE f.fault WHEN 'sound' THEN 0 WHEN 'truncated' THEN 5 ELSE 99999999 END AS left_
            FROM rests r JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1
        ) AS x(conv_id, next_i, v0, v1, v2, v3, i, initial, left_)
    )
),
best AS (SELECT conv_id, v0.c::BIGINT AS cost, v0.e AS audit FROM rests WHERE i = 1),
lettered AS (
    SELECT conv_id, p, substr(audit, p, 1) AS letter,
           len(replace(left(audit, p), 'I', '')) AS i, len(replace(left(audit, p), 'D', '')) AS k
    FROM best, unnest(range(1, len(audit) + 1)) AS t(p)
),
left_over AS (
    SELECT l.*, f.role, f.text,
           max(CASE WHEN l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
    FROM lettered l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I'
    WHERE l.letter <> 'D'
),
repaired AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                               || coalesce(text, ''), chr(10) ORDER BY p) AS whole
    FROM left_over GROUP BY conv_id
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""

SQL["op12_prefix_tree"] = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
    FROM worded
),
sized AS (SELECT doc_id, len(grams) AS n FROM sets),
spread AS (SELECT doc_id, unnest(grams) AS gram FROM sets),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM spread a JOIN spread b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
reached AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, least_id AS component_id
FROM sized s JOIN (SELECT doc_id, min(other) AS least_id FROM reached GROUP BY doc_id) r USING (doc_id)
"""

SQL["op13_merkle_manifest"] = """
WITH RECURSIVE docs AS (
    SELECT doc_id, lang,
           concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                  coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
           text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 3 = 0 AS altered
    FROM documents
),
hashed AS (
    SELECT doc_id, lang, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
           CASE WHEN altered THEN sha256(concat(head, coalesce(strlen(lowered) || ':' || lowered, '-'))) END AS tampered
    FROM docs
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY lang) AS n
    FROM hashed
),
nodes AS (
    SELECT lang, 0 AS level, idx, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT lang, level + 1, idx // 8, ceil(n / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 8, n
),
subroots AS (SELECT lang, digest AS subroot FROM nodes WHERE n = 1),
upper AS (
    SELECT lang AS own, 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, subroot AS digest
    FROM subroots
    UNION ALL
    SELECT NULL, level + 1, idx // 8, ceil(n / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY idx))
    FROM upper WHERE n > 1 GROUP BY level, idx // 8, n
),
sided AS (
    SELECT level, idx, n, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, lang
    FROM nodes WINDOW run AS (PARTITION BY lang, level, idx // 8 ORDER BY idx)
),
upper_sided AS (
    SELECT level, idx, n, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM upper WINDOW run AS (PARTITION BY level, idx // 8 ORDER BY idx)
),
folds AS (
    SELECT doc_id, leaf, lang, idx AS leaf_index, 0 AS level, idx, n, coalesce(tampered, leaf) AS digest, '' AS beside FROM leaves
    UNION ALL
    SELECT f.doc_id, f.leaf, f.lang, f.leaf_index, f.level + 1, f.idx // 8, ceil(f.n / 8)::BIGINT, sha256(s.l || f.digest || s.r),
           f.beside || s.l || s.r
    FROM folds f JOIN sided s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.idx = f.idx WHERE f.n > 1
),
folds_up AS (
    SELECT f.doc_id, f.leaf, f.lang, f.leaf_index, 0 AS level, u.idx, u.n, f.digest, f.beside
    FROM folds f JOIN upper u ON u.own IS NOT DISTINCT FROM f.lang AND u.level = 0 WHERE f.n = 1
    UNION ALL
    SELECT f.doc_id, f.leaf, f.lang, f.leaf_index, f.level + 1, f.idx // 8, ceil(f.n / 8)::BIGINT, sha256(s.l || f.digest || s.r),
           f.beside || s.l || s.r
    FROM folds_up f JOIN upper_sided s ON s.level = f.level AND s.idx = f.idx WHERE f.n > 1
)
SELECT f.doc_id, f.leaf, s.subroot, u.digest AS root, sha256(f.beside) AS proof_sha256, f.digest AS folded_root,
       f.digest = u.digest AS verified, f.leaf_index
FROM folds_up f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang JOIN upper u ON u.n = 1
WHERE f.n = 1
"""
