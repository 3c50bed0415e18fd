"""DuckDB SQL of the queries that SQL can express over whole tables; written apart from the operators."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_BLANK}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.m, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = s.doc_id"""

OP5 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {_BLANK}) AS w FROM d),
k AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 'g': array_to_string(w[i:i + 7], ' ')}})) AS z FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, z.i AS i, count(*) OVER (PARTITION BY doc_id, z.g) AS c FROM k),
rp AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(8) t(j) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_BLANK}) GROUP BY doc_id),
b AS (SELECT d.doc_id, source, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(ln.n, 0) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rp USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(base_failed) AS DOUBLE) AS x FROM f GROUP BY source),
t AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) AS sq, sum(n * n) AS nsq FROM h),
v AS (SELECT *, (sq - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - nsq / n, 0) AS v FROM t),
p AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE n / k END AS weight FROM v)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND (h.x + p.m * p.weight) / (h.n + p.weight) < 0.5 AS kept FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN p"""

OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP9 = f"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS rn FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT b.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM b LEFT JOIN f ON f.page_id = b.page_id AND f.rn = 1"""

_FRAMED = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_FIELDS = " || ".join(_FRAMED.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, len({0}) + 1), lambda i: [CAST(ascii(substr({0}, CAST(i AS INT), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT))"""
_AROUND = """coalesce(string_agg(h, '') OVER (PARTITION BY g, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY g, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after"""

OP11 = f"""WITH RECURSIVE b AS (SELECT doc_id, lang, sha256({_FIELDS} || {_FRAMED.format("text")}) AS leaf,
  CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({_FIELDS} || {_FRAMED.format(_LOWER.format("text"))}) END AS altered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM b),
t(g, level, pos, n, h) AS (SELECT lang, 0, CAST(pos AS BIGINT), CAST(n AS BIGINT), leaf FROM p
  UNION ALL SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, level + 1, pos // 8, (n + 7) // 8),
s AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u(g, level, pos, n, h) AS (SELECT 0, 0, CAST(place AS BIGINT), CAST(n AS BIGINT), subroot FROM s
  UNION ALL SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY g, level + 1, pos // 8, (n + 7) // 8),
rt AS (SELECT g, level, pos, {_AROUND} FROM t WHERE n > 1),
ru AS (SELECT g, level, pos, {_AROUND} FROM u WHERE n > 1),
k AS (SELECT p.lang, p.pos, rt.level AS level, before, after FROM p JOIN rt ON p.lang IS NOT DISTINCT FROM rt.g AND p.pos // CAST(power(8, rt.level) AS BIGINT) = rt.pos
  UNION ALL SELECT p.lang, p.pos, 1000 + ru.level, before, after FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN ru ON s.place // CAST(power(8, ru.level) AS BIGINT) = ru.pos),
f AS (SELECT lang, pos, string_agg(before || after, '' ORDER BY level) AS siblings, list(before || '|' || after ORDER BY level) AS path FROM k GROUP BY lang, pos),
r AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(f.siblings, '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(p.altered, p.leaf)], coalesce(f.path, [])), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN f ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos)
SELECT *, folded_root = root AS verified FROM r"""

OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, k, g),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
i AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS g, a AS f FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS b FROM c, range(2, 5) t(m) WHERE m < k)) GROUP BY lang, g),
o AS (SELECT c.* FROM c LEFT JOIN i ON c.lang = i.lang AND c.g = i.g WHERE i.f IS NULL OR 100 * i.f < 100 * c.a),
s AS (SELECT o.lang, o.g, o.a, m, x.f AS l, y.f AS r, n.n, (1000 * o.a * n.n) // (x.f * y.f) AS score FROM o JOIN range(1, 5) t(m) ON m < o.k JOIN n ON n.lang = o.lang
  JOIN f x ON x.lang = o.lang AND x.g = array_to_string(o.w[1:m], ' ') JOIN f y ON y.lang = o.lang AND y.g = array_to_string(o.w[m + 1:o.k], ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, m) AS first FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM z WHERE first = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000"""

ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op5_quality_rules": OP5, "op8_decontamination": OP8, "op9_url_filter": OP9, "op11_merkle_manifest": OP11, "op12_phrase_collocations": OP12}
