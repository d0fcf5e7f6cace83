"""Pieces of DuckDB SQL for checks: it has no crc32 of its own."""

from __future__ import annotations

# One row with the table of the 256 byte steps, as list ``t``.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(i)))"""


def crc32(text: str, table: str = "t") -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text expression; ``table`` is the column of ``crc_table``."""
    octets = f"list_transform(range(1, strlen({text}) * 2, 2), lambda k: ('0x' || substr(hex({text}), k, 2))::BIGINT)"
    steps = f"list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c // 256, {table}[xor(c, b) % 256 + 1]))"
    return f"xor({steps}, 4294967295::BIGINT)"


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaf AS (SELECT doc_id, lang, {_leaf('text')} AS leaf,
                CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf(f'translate(text, {_ALPHABET})')} ELSE {_leaf('text')} END AS offered
         FROM documents, crc_table),
placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS width,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
lv AS (SELECT tree, 0 AS level, pos, width, leaf AS hash FROM placed
       UNION ALL
       SELECT tree, level + 1, pos // 8, (width + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM lv WHERE width > 1 GROUP BY tree, level, pos // 8, (width + 7) // 8),
tp AS (SELECT 0 AS level, tree AS pos, count(*) OVER () AS width, hash FROM lv WHERE width = 1
       UNION ALL
       SELECT level + 1, pos // 8, (width + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM tp WHERE width > 1 GROUP BY level, pos // 8, (width + 7) // 8),
nodes AS (SELECT tree, level, pos, hash FROM lv WHERE width > 1 UNION ALL SELECT -1, level, pos, hash FROM tp WHERE width > 1),
way AS (SELECT p.tree, p.pos, w.level AS step, w.tree AS ntree, w.level AS nlevel, p.pos // (1::BIGINT << (3 * w.level)) AS own
        FROM placed p JOIN (SELECT DISTINCT tree, level FROM lv WHERE width > 1) w ON p.tree = w.tree
        UNION ALL
        SELECT p.tree, p.pos, 100 + w.level, -1, w.level, p.tree // (1::BIGINT << (3 * w.level)) FROM placed p, (SELECT DISTINCT level FROM tp WHERE width > 1) w),
steps AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k FROM way),
proof AS (SELECT s.tree, s.pos, string_agg(n.hash, '' ORDER BY s.k, n.pos) AS hashes FROM steps s
          JOIN nodes n ON n.tree = s.ntree AND n.level = s.nlevel AND n.pos // 8 = s.own // 8 AND n.pos <> s.own GROUP BY s.tree, s.pos),
fold AS (SELECT tree, pos, 0 AS k, offered AS hash FROM placed
         UNION ALL
         SELECT f.tree, f.pos, f.k + 1, sha256(string_agg(CASE WHEN n.pos = s.own THEN f.hash ELSE n.hash END, '' ORDER BY n.pos))
         FROM fold f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1
         JOIN nodes n ON n.tree = s.ntree AND n.level = s.nlevel AND n.pos // 8 = s.own // 8 GROUP BY f.tree, f.pos, f.k),
folded AS (SELECT tree, pos, arg_max(hash, k) AS hash FROM fold GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, l.hash AS subroot, r.hash AS root, sha256(coalesce(f.hashes, '')) AS proof_sha256, g.hash AS folded_root, g.hash = r.hash AS verified
FROM placed p JOIN lv l ON l.tree = p.tree AND l.width = 1 JOIN (SELECT hash FROM tp WHERE width = 1) r ON true
LEFT JOIN proof f ON f.tree = p.tree AND f.pos = p.pos JOIN folded g ON g.tree = p.tree AND g.pos = p.pos"""


QUALITY_RULES = f"""
WITH {CRC_TABLE},
rows AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT row, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM rows),
word AS (SELECT row, doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM worded),
crcs AS (SELECT w, {crc32('w')} AS h FROM (SELECT DISTINCT w FROM word), crc_table),
num AS (SELECT row, doc_id, i, w, h, lead(h) OVER (PARTITION BY row ORDER BY i) AS nxt FROM word JOIN crcs USING (w)),
gram AS (SELECT row, doc_id, h % 10000 AS b FROM num
         UNION ALL SELECT row, doc_id, ((h % 1000003) * 31 + nxt % 1000003) % 10000 FROM num WHERE nxt IS NOT NULL),
trusted AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1 ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100000),
counts AS (SELECT b, count(*) AS n, count(t.doc_id) AS trusted FROM gram LEFT JOIN trusted t USING (doc_id) GROUP BY b),
ratio AS (SELECT b, round(ln((trusted::DOUBLE * (SELECT sum(n) FROM counts) / n + 100000.0) / ((SELECT sum(trusted) FROM counts) + 100000.0)) * 1e6)::BIGINT AS r FROM counts),
score AS (SELECT row, sum(r)::BIGINT AS ratio, count(*) AS grams FROM gram JOIN ratio USING (b) GROUP BY row),
win AS (SELECT row, i, list(w) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS five FROM word),
often AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, five) AS n FROM win WHERE len(five) = 5) WHERE n > 1),
repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM often, range(5) AS r(k) GROUP BY row),
line AS (SELECT row, count(*) - count(DISTINCT l) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS l FROM rows)
         WHERE regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g') <> '' GROUP BY row),
base AS (SELECT d.row, d.doc_id, len(d.words)::BIGINT AS n_words, length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
                (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                coalesce(s.ratio, 0)::BIGINT AS ratio, coalesce(s.grams, 0) AS grams
         FROM worded d LEFT JOIN line l USING (row) LEFT JOIN repeated r USING (row) LEFT JOIN score s USING (row)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ratio >= -100000 * grams AS kept, ratio FROM failed"""


PREFIX_TRIE = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS host, {crc32('conv_id::VARCHAR', 'crc_table.t')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (SELECT t.conv_id, pos, role, text FROM t JOIN c USING (conv_id) WHERE pos > h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.host AND pos <= h),
s AS (SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS q FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, unnest(range(len(q) + 1)) AS d, q FROM s),
n AS (SELECT q[:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(q) = d), '')) AS ends_sha256 FROM p GROUP BY q[:d], d),
k AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY path[:d - 1]),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(n.path[d].t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) END AS own
      FROM n LEFT JOIN k ON n.path = k.path),
u AS (SELECT v.path[:a.x] AS path, a.x AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved
      FROM v, LATERAL (SELECT unnest(range(v.d + 1)) AS x) a GROUP BY v.path[:a.x], a.x)
SELECT v.conv_id, v.d AS depth, m.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, u.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u ON v.path = u.path LEFT JOIN n m ON v.d > 0 AND m.path = v.path[:v.d - 1]"""
