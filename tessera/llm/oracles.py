"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_url_filter"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS sep FROM pages),
tail AS (SELECT page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM cut),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM tail),
hits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""


def _quality_rules() -> str:
    """Base counts by window functions over exploded words; histograms as rows (document, bin, count)."""
    from tessera.llm import divergence as D

    langs = ", ".join(f"'{x}'" for x in D.COMMON_WORDS)
    vocabulary = sorted({w for ws in D.COMMON_WORDS.values() for w in ws})
    bins = ", ".join(f"('{w}')" for w in vocabulary)
    strip = ["[a-zß-öø-ÿ]+", "[\\x20\\x09-\\x0D]+", "[A-ZÀ-ÖØ-Þ]+", "[#*$%&|<>]+", "[0-9]+", "[.,;:!?''\"()-]+"]
    steps = ["s0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(text, '') AS r0, CASE WHEN lang IN (" + langs + ") THEN lang ELSE 'other' END AS lang FROM documents)"]
    for i, p in enumerate(strip, 1):
        steps.append(f"s{i} AS (SELECT *, regexp_replace(r{i - 1}, '{p}', '', 'g') AS r{i} FROM s{i - 1})")
    distance = (
        "SELECT rid, sqrt(greatest(0, sum((CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2))) AS dist "
        "FROM (SELECT rid, n / sum(n) OVER (PARTITION BY rid) AS a, all_n / sum(all_n) OVER (PARTITION BY rid) AS b FROM (SELECT rid, n, sum(n) OVER (PARTITION BY lang, bin) AS all_n FROM {t})) GROUP BY rid"
    )
    return f"""
WITH {", ".join(steps)},
d AS (SELECT rid, doc_id, t, lang, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, length(r0) AS c0, length(r1) AS c1, length(r2) AS c2, length(r3) AS c3, length(r4) AS c4, length(r5) AS c5, length(r6) AS c6 FROM s6),
chars AS (SELECT rid, lang, unnest(['lower', 'space', 'upper', 'symbol', 'digit', 'stop', 'other']) AS bin, CAST(unnest([c0 - c1, c1 - c2, c2 - c3, c3 - c4, c4 - c5, c5 - c6, c6]) AS DOUBLE) AS n FROM d),
tokens AS (SELECT rid, lang, lower(regexp_replace(unnest(ws), '[.,;:!?]+$', '')) AS w FROM d),
counted AS (SELECT rid, w, count(*) AS n FROM tokens WHERE w IN (SELECT v FROM (VALUES {bins}) b(v)) GROUP BY ALL),
found AS (SELECT d.rid, lang, v AS bin, CAST(coalesce(c.n, 0) AS DOUBLE) AS n FROM d CROSS JOIN (VALUES {bins}) b(v) LEFT JOIN counted c ON c.rid = d.rid AND c.w = v),
hist AS (SELECT * FROM found UNION ALL SELECT d.rid, d.lang, '', CAST(len(ws) - coalesce(k.n, 0) AS DOUBLE) FROM d LEFT JOIN (SELECT rid, sum(n) AS n FROM counted GROUP BY rid) k USING (rid)),
wins AS (SELECT rid, i, array_to_string(ws[i:i + {D.WINDOW - 1}], ' ') AS win FROM d, unnest(range(1, len(ws) - {D.WINDOW - 2})) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
covered AS (SELECT rid, sum(least({D.WINDOW}, coalesce(nxt - i, {D.WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
base AS (SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, c0 - (c1 - c2) AS word_chars, c3 - c4 AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, c0 FROM d LEFT JOIN lines l USING (rid) LEFT JOIN covered v USING (rid)),
judged AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN c0 >= {D.MIN_CHARS} THEN x.dist END AS cd, CASE WHEN n_words >= {D.MIN_WORDS} THEN y.dist END AS wd FROM base b LEFT JOIN ({distance.format(t="chars")}) x USING (rid) LEFT JOIN ({distance.format(t="hist")}) y USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {D.MAX_CHAR_DISTANCE} AND coalesce(wd, 0) <= {D.MAX_WORD_DISTANCE} AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM judged
"""


ORACLES["op5_quality_rules"] = _quality_rules()


def _license_templates() -> str:
    """Templates as regular expressions over the words joined by blanks."""
    import re

    from tessera.llm import license_scan as L

    def pattern(template: str) -> str:
        out, optional = "", False
        for part in re.split(r"(<<.*?>>)", template):
            if part == "<<optional>>":
                out, optional = out + "(?:", True
            elif part == "<</optional>>":
                out, optional = out + ")?", False
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                out += f"(?: [^ ]+){{1,{m[1]}}}"
            else:
                out += "".join(f" {w}" for w in L.words_of(part))
        return re.sub(r"^(\(\?:[^)]*\)\?)+", "", out) + " "

    templates = ", ".join(f"('{name}', '{pattern(t)}')" for name, t in L.TEMPLATES.items())
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in L.PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
j AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS joined FROM d),
p AS (SELECT rid, ws, phrase, label, string_split(phrase, ' ') AS parts FROM j, (VALUES {phrases}) x(phrase, label) WHERE contains(joined, ' ' || phrase || ' ')),
places AS (SELECT rid, label, i - 1 AS at_word FROM p, unnest(range(1, len(ws) - len(parts) + 2)) AS u(i) WHERE ws[i:i + len(parts) - 1] = parts),
base AS (SELECT rid, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word FROM places GROUP BY rid),
own AS (SELECT rid, name AS label FROM j, (VALUES {templates}) y(name, pat) WHERE regexp_matches(joined, pat)),
bl AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM places) GROUP BY rid),
al AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION SELECT rid, label FROM own) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN j.rid IN (SELECT rid FROM own) THEN 1.0::DOUBLE WHEN base.rid IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM j LEFT JOIN base USING (rid) LEFT JOIN bl USING (rid) LEFT JOIN al USING (rid)
"""


ORACLES["op6_license_templates"] = _license_templates()


ORACLES["op8_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
n AS (SELECT *, length(hx) // 2 AS size FROM d),
piece AS (SELECT rid, c, substr(hx, 4000 * c + 1, 4398) AS part FROM (SELECT rid, hx, unnest(range(0, (size - 200) // 2000 + 1)) AS c FROM n WHERE size >= 200)),
win AS (SELECT rid, 2000 * c + i AS p, md5(substr(part, 2 * i + 1, 400)) AS h FROM (SELECT rid, c, part, unnest(range(0, least(2000, length(part) // 2 - 199))) AS i FROM piece)),
hit AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY h) AS k FROM win) WHERE k > 1),
run AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 1 ELSE 0 END AS fresh FROM hit)),
span AS (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY rid, g),
edge AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM span),
cut AS (SELECT rid, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM edge JOIN n USING (rid) GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(hx, 2 * last + 1), hx))) AS kept_sha256
FROM n LEFT JOIN cut USING (rid)
"""

ORACLES["op10_lsh_forest"] = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingles FROM w),
c AS (SELECT rid, doc_id, shingles, md5(array_to_string(shingles, chr(10))) AS cls, len(shingles) AS n FROM s),
classes AS (SELECT cls, any_value(shingles) AS shingles, any_value(n) AS n, min(doc_id) AS first_id FROM c WHERE n > 0 GROUP BY cls),
x AS (SELECT cls, n, unnest(shingles) AS shingle FROM classes),
pairs AS (SELECT a.cls AS a, b.cls AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.cls < b.cls GROUP BY a.cls, b.cls),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT cls, cls FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
comp AS (SELECT r.a AS cls, min(k.first_id) AS component_id FROM reach r JOIN classes k ON k.cls = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id, n = 0 OR doc_id = component_id AS kept FROM c LEFT JOIN comp ON comp.cls = c.cls AND n > 0
"""

ORACLES["op11_threshold_topk"] = r"""
WITH e AS (SELECT vec_id, embedding AS x, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 100 = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

# The CRC-32 of a number's decimal digits, byte by byte and bit by bit.
_CRC32 = r"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, u: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT))"""

# Equal words of a document at each lag are paired; consecutive pairs of a lag form stretches; a stretch within one of a lag that divides its own goes.
ORACLES["op12_periodic_runs"] = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS raw, """
    + _CRC32.format("CAST(doc_id AS VARCHAR)")
    + r""" AS h FROM documents),
a AS (SELECT *, len(raw) AS n, h // 10 AS g, CASE WHEN len(raw) > 0 THEN (h // 10) % len(raw) ELSE 0 END AS a FROM d),
o AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN raw[i + 1] ELSE raw[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE raw END AS ws FROM a),
w AS (SELECT rid, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM o),
k AS (SELECT rid, n, i, md5_number_lower(word) AS word FROM w),
pair AS (SELECT x.rid, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
isle AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM pair),
stretch AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM isle GROUP BY rid, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.rid = x.rid AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
per AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS said, arg_min(struct_pack(s := s, l := len, q := q), [-len, s, q]) AS best FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.i) AS t FROM w ANTI JOIN gone USING (rid, i) GROUP BY w.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM o LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)
"""
)

ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS whole FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS z, CASE WHEN whole THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT whole THEN length(p) END AS prefix_chars, CASE WHEN NOT whole THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || z || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
