"""DuckDB SQL with the rows of those operators that SQL can express."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"


def urls(rules: dict[str, str], blocked: list[str]) -> str:
    """Every URL against every rule: the list of rules is a constant."""
    listed = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in rules.items())
    hosts = ", ".join(f"('{h}')" for h in blocked)
    return f"""
WITH rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {listed}),
blocked(bad_host) AS (VALUES {hosts}),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
heads AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut),
parsed AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM heads),
numbered AS (SELECT row_number() OVER () AS n, * FROM parsed),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM numbered, rules
  WHERE (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
bad AS (SELECT DISTINCT n FROM numbered, blocked WHERE host = bad_host OR suffix(host, '.' || bad_host))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN bad.n IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM numbered LEFT JOIN fits USING (n) LEFT JOIN bad USING (n)"""


def mixing() -> str:
    """The ceiling set in closed form: sources in order of size over weight, as far as the level stays above."""
    return f"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals),
ordered AS (SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS capped_before, sum(weight) OVER () - (sum(weight) OVER w - weight) AS weight_left,
  sum(source_size) OVER () AS total FROM weighted WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
first_free AS (SELECT min(source_size / weight) AS ratio FROM ordered WHERE 3 * source_size >= weight * (CAST(total - capped_before AS DOUBLE) / CAST(weight_left AS DOUBLE))),
leveled AS (SELECT max(CAST(total - capped_before AS DOUBLE) / CAST(weight_left AS DOUBLE)) AS level FROM ordered, first_free WHERE source_size / weight = ratio),
targets AS (SELECT source, source_size, CASE WHEN weight * level > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM weighted, leveled),
ranked AS (SELECT s.doc_id, s.size, t.source_size, t.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS k,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS share,
  CAST(CAST('0x' || substr(md5('mix-1' || coalesce(s.source, '')), 1, 4) AS INTEGER) AS DOUBLE) / 65536 AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(3, floor(k * share + u) - floor((k - 1) * share + u)) AS BIGINT) AS taken FROM ranked"""


def quality() -> str:
    """Languages without a listed reference are judged by the base rules alone here: the test tables have none."""
    from marlgate.llm.quality import CLASSES, COMMON_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, REFERENCES, SYMBOLS

    space, size = "[\\x20\\x09-\\x0D]", len(CLASSES) + 1
    quoted = {k: p.replace("'", "''") for k, p in CLASSES.items()}
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))" for p in quoted.values())
    lists = " ".join(f"WHEN lang = '{k}' THEN [{', '.join(repr(w) for w in words)}]" for k, words in COMMON_WORDS.items())
    longest = size + 1 + max(map(len, COMMON_WORDS.values()))
    values = ", ".join(f"('{g}', {i}, '{q!r}')" for g, r in REFERENCES.items() for i, q in enumerate([*r[0], *r[1]], 1))
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0.0 END"
    return f"""
WITH base AS (SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
win AS (SELECT n, i, words[i:i + 4] AS g FROM base, unnest(range(1, len(words) - 3)) AS r(i)),
again AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT p) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 5)) AS p FROM again) GROUP BY n),
lines AS (SELECT n, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT n, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
counted AS (SELECT base.n, doc_id, lang, t, len(words) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
  len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [{counts}] AS known, CASE {lists} ELSE CAST([] AS VARCHAR[]) END AS listed, string_split_regex(lower(t), '[^\\p{{L}}]+') AS tokens
  FROM base LEFT JOIN lines USING (n) LEFT JOIN covered USING (n)),
hit AS (SELECT *, list_append(known, length(t) - list_sum(known)) AS classes, list_transform(listed, lambda w: len(list_filter(tokens, lambda x: x = w))) AS found FROM counted),
full_hist AS (SELECT *, list_append(found, n_words - least(n_words, coalesce(list_sum(found), 0))) AS common,
  CASE WHEN len(listed) > 0 THEN lang END AS g FROM hit),
flat AS (SELECT n, g, i, (classes || common)[i] AS c FROM full_hist, unnest(range(1, {longest} + 1)) AS r(i) WHERE i <= len(classes) + len(common)),
refs(g, i, q) AS (SELECT g, i, CAST(q AS DOUBLE) FROM (VALUES {values}) AS v(g, i, q)),
shares AS (SELECT n, g, i, c / sum(c) OVER (PARTITION BY n, i <= {size}) AS p FROM flat),
js AS (SELECT n, shares.i <= {size} AS of_class, sqrt(greatest(0.0, sum({half.format("p", "q")} + {half.format("q", "p")}) / 2)) AS d
  FROM shares JOIN refs ON refs.i = shares.i AND refs.g IS NOT DISTINCT FROM shares.g GROUP BY ALL),
far AS (SELECT n, max(CASE WHEN of_class THEN d END) AS class_d, max(CASE WHEN NOT of_class THEN d END) AS word_d FROM js GROUP BY n),
judged AS (SELECT h.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(CASE WHEN length(t) >= {MIN_CHARS} THEN class_d END, 0) > {MAX_CLASS_DISTANCE} OR coalesce(CASE WHEN n_words >= {MIN_WORDS} AND len(listed) > 0 THEN word_d END, 0) > {MAX_WORD_DISTANCE} AS diverges
  FROM full_hist h LEFT JOIN far USING (n))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT diverges AS kept FROM judged"""


def prefix_trie() -> str:
    """Each node against all that it is a beginning of.  The checksum of an id is worked out bit by bit."""
    told = "md5(length(role) || ':' || role || text)"
    bits = "list_reduce(list_prepend(xor(a, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))), lambda a, x: {bits}), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, {told} AS g, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {told}) AS k FROM t),
c AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM o GROUP BY conv_id),
h AS (SELECT c.conv_id, c.n, {crc} % 6 AS h, b.conv_id AS b, coalesce(b.n, 0) AS bn FROM c LEFT JOIN (SELECT conv_id, n FROM c) b ON b.conv_id = c.conv_id - c.conv_id % 100),
steps AS (SELECT h.conv_id, k AS pos, g, chars FROM h JOIN o ON o.conv_id = h.b AND k <= h
  UNION ALL SELECT h.conv_id, k - h + least(h, bn), g, chars FROM h JOIN o ON o.conv_id = h.conv_id AND k > h),
full_paths AS (SELECT h.conv_id, coalesce(p, []) AS p, coalesce(cs, []) AS cs FROM h LEFT JOIN (SELECT conv_id, list(g ORDER BY pos) AS p, list(chars ORDER BY pos) AS cs FROM steps GROUP BY conv_id) USING (conv_id)),
firsts AS (SELECT conv_id, d, p[1:d] AS q, len(p) = d AS ends, coalesce(cs[d], 0) AS chars FROM full_paths, unnest(range(0, len(p) + 1)) AS r(d)),
nodes AS (SELECT d, q, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS listed FROM firsts GROUP BY d, q),
kids AS (SELECT q[1:d - 1] AS q, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (q)),
below AS (SELECT q[1:a] AS q, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM whole, unnest(range(0, d + 1)) AS r(a) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(w.listed) AS ends_sha256
FROM whole w JOIN below b ON b.q = w.q LEFT JOIN nodes u ON u.q = w.q[1:w.d - 1] AND w.d > 0"""


def vector_codes() -> str:
    """Every part against every entry, round by round."""
    near = """SELECT n, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
    SELECT x.n, x.p, b.e, CAST(list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - b.s[i]) * (x.s[i] - b.s[i]))) AS BIGINT) AS d FROM parts x JOIN {0} b ON b.p = x.p) GROUP BY n, p"""
    moved = """SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM {0} b LEFT JOIN (SELECT p, e, list((t - ((t % c) + c) % c) // c ORDER BY i) AS s FROM (
    SELECT p, e, i, CAST(sum(s[i]) AS BIGINT) AS t, count(*) AS c FROM {1} JOIN parts USING (n, p), unnest(range(1, len(s) + 1)) AS r(i) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""
    return f"""
WITH ints AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 262144)) = 0),
sized AS (SELECT *, len(v) AS size, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS place FROM ints),
ok AS (SELECT *, row_number() OVER (ORDER BY place) AS n FROM sized WHERE size = (SELECT arg_min(size, place) FROM sized)),
parts AS MATERIALIZED (SELECT n, p, v[p * (size // 16) + 1:(p + 1) * (size // 16)] AS s FROM ok, unnest(range(0, 16)) AS r(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, s FROM parts WHERE n <= 64),
a1 AS MATERIALIZED ({near.format("b0")}),
b1 AS MATERIALIZED ({moved.format("b0", "a1")}),
a2 AS MATERIALIZED ({near.format("b1")}),
b2 AS MATERIALIZED ({moved.format("b1", "a2")}),
a3 AS MATERIALIZED ({near.format("b2")}),
coded AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM ok JOIN coded USING (n)"""
