"""DuckDB SQL of the registered queries of this package, where SQL can express them."""

from .licenses import BLOCK, PHRASES, template_words

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""

OP2 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.first
), r AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g)
), s AS (
  SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run
), k AS (
  SELECT doc_id, run, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM s
  UNION ALL SELECT doc_id, -1, 0, min(lo) FROM s GROUP BY doc_id
), p AS (
  SELECT k.doc_id, string_agg(substr(d.h, 2 * k.lo + 1, 2 * (coalesce(k.hi, length(d.h) // 2) - k.lo)), '' ORDER BY k.lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(t.n, 0)::BIGINT AS n_removed, coalesce(t.c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(p.kept, CASE WHEN t.n IS NULL THEN d.h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(hi - lo) AS n, count(*) AS c FROM s GROUP BY doc_id) t USING (doc_id) LEFT JOIN p USING (doc_id)
"""

OP9 = rf"""
WITH l AS (
  SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents
), w AS (
  SELECT doc_id, z[2] AS line, z[1] AS body, regexp_extract_all(translate(z[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l
), s AS (
  SELECT doc_id, line, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS sh FROM w WHERE len(ws) >= 1
), v AS (
  SELECT sh, len(sh) AS n, min(doc_id * 1000000 + line) AS place, row_number() OVER (ORDER BY min(doc_id * 1000000 + line)) AS vid FROM s GROUP BY sh
), e AS (
  SELECT vid, n, place, unnest(sh) AS g FROM v
), near AS (
  SELECT DISTINCT late FROM (
    SELECT b.vid AS late FROM e a JOIN e b ON a.g = b.g AND a.place < b.place
    GROUP BY a.vid, b.vid, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))
), gone AS (
  SELECT s.doc_id, s.line FROM s JOIN v USING (sh) LEFT JOIN near ON near.late = v.vid
  WHERE near.late IS NOT NULL OR s.doc_id * 1000000 + s.line > v.place
)
SELECT w.doc_id, count(*)::BIGINT AS n_lines, count(gone.line)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(w.body, chr(10) ORDER BY w.line) FILTER (gone.line IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.line = w.line
GROUP BY w.doc_id
"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATES = ", ".join(f"({t.number}, '{t.label}', '{t.family}', {t.telling}, {t.words})" for t in template_words())
_PHRASES = ", ".join(f"('{p}', {p.split()}, '{label}')" for p, label in PHRASES)

OP4 = rf"""
WITH d AS (
  SELECT doc_id, {_LOWER} AS t, {_WORDS.format(_LOWER)} AS ws FROM documents
), b AS (
  SELECT doc_id, p.label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(p.parts)] = p.parts)) AS place
  FROM d, (VALUES {_PHRASES}) p(phrase, parts, label)
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY doc_id
), r AS (
  SELECT doc_id, i, ws[i + 1:i + {BLOCK}] AS run FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {BLOCK // 2}, 1), {BLOCK // 2})) AS i FROM d)
), m AS (
  SELECT doc_id, i, t.label, t.family, len(t.telling) AS special, len(list_intersect(t.ws, r.run)) / len(t.ws) AS c, len(list_intersect(t.ws, r.run)) AS shared, len(t.ws) AS size
  FROM r, (VALUES {_TEMPLATES}) t(number, label, family, telling, ws) WHERE list_has_all(r.run, t.telling)
), o AS (
  SELECT * FROM m WHERE 100 * shared >= 80 * size QUALIFY special = max(special) OVER (PARTITION BY doc_id, i, family)
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP13 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m)
), f AS (
  SELECT lang, m, phrase, count(*) AS c FROM g GROUP BY lang, m, phrase
), t AS (
  SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, c AS a FROM f WHERE m >= 2 AND c >= 100
), k AS (
  SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.c AS l, r.c AS r, t.n, ((1000::HUGEINT * k.a * t.n) // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x AND l.m = k.k JOIN f r ON r.lang = k.lang AND r.phrase = k.y AND r.m = k.m - k.k JOIN t ON t.lang = k.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS longest FROM (
    SELECT lang, ws, a, m, size, unnest(range(1, m - size + 2)) AS i FROM c, range(2, 5) z(size) WHERE size < m) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
FROM b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.longest IS NULL OR 100 * i.longest < 100 * b.a
QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": OP1,
    "op2_suffix_dedup": OP2,
    "op4_licenses": OP4,
    "op9_line_dedup": OP9,
    "op13_collocations": OP13,
}
