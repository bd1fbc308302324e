"""DuckDB SQL for the registered queries: the same results said independently."""

from __future__ import annotations

from tessera import lexicon as L
from tessera.plans.evaluate import DEFAULT_SETS, FLAGS
from tessera.queries import EXPECTED, INJECTED, MODEL, SCHEMA, TAGS


def _duck(pattern: str) -> str:
    """A Java pattern for RE2, whose \\b is ASCII."""
    return pattern.replace(L._B, r"\b").replace(L._E, r"\b").replace("'", "''")


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _singular(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ies' AND length({w}) > 3 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%ses' OR {w} LIKE '%xes' OR {w} LIKE '%zes' OR {w} LIKE '%ches' OR {w} LIKE '%shes' THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%les' OR {w} LIKE '%res' OR {w} LIKE '%nes' THEN left({w}, length({w}) - 1) WHEN {w} LIKE '%es' THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def _phrase(t: str) -> str:
    return f"trim(regexp_replace(translate(lower({t}), '.,;:!?()[]{{}}''\"', repeat(' ', 14)), '\\s+', ' ', 'g'))"


def _scan(src: str, keys: str, text: str, pattern: str, group: int = 0) -> str:
    """Matches of a pattern with offsets."""
    p = _duck(pattern)
    size = "lambda x: length(x)"
    return (
        f"SELECT {keys}, text, ms[i] AS span, gs[i] AS value, CAST(coalesce(list_sum(list_transform(gaps[1:i], {size})), 0) + coalesce(list_sum(list_transform(ms[1:i-1], {size})), 0) AS BIGINT) AS pos "
        f"FROM (SELECT {keys}, {text} AS text, regexp_extract_all({text}, '{p}', 0) AS ms, regexp_extract_all({text}, '{p}', {group}) AS gs, string_split_regex({text}, '{p}') AS gaps FROM {src}) q, unnest(range(1, len(ms) + 1)) AS u(i)"
    )


_TURNS = f"turns AS (SELECT conv_id, turn, role, {INJECTED} AS text FROM conversations)"
_TEXTS = f"texts AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, {MODEL} AS model, {SCHEMA} AS schema_json FROM turns GROUP BY conv_id)"
_LAST = "ends AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns)"
_VIEWS = (
    "views AS (SELECT conv_id, max(text) FILTER (turn = last) AS cur, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (turn < last), '') AS hist, "
    "CASE WHEN conv_id % 4 = 0 THEN 'sales_report pdf' ELSE '' END AS attached FROM ends GROUP BY conv_id)"
)
_HB, _JJ, _EJS = L.PLACEHOLDER["handlebars"], L.PLACEHOLDER["jinja"], L.PLACEHOLDER["ejs"]
_DIALECT = "CASE WHEN regexp_matches(text, '\\{\\{\\s*[a-zA-Z0-9_.]+\\s*\\}\\}') THEN 'handlebars' WHEN contains(text, '<%') THEN 'ejs' END"


def _placeholders(src: str, keys: str) -> str:
    return (
        f"SELECT {keys}, text, 'handlebars' AS dialect, value AS variable, pos, pos + length(span) AS ende FROM ({_scan(f'(SELECT * FROM {src} WHERE {_DIALECT} = ' + chr(39) + 'handlebars' + chr(39) + ')', keys, 'text', _HB, 2)}) "
        f"UNION ALL SELECT {keys}, text, 'ejs', value, pos, pos + length(span) FROM ({_scan(f'(SELECT * FROM {src} WHERE {_DIALECT} = ' + chr(39) + 'ejs' + chr(39) + ')', keys, 'text', _EJS, 1)})"
    )


def _with(*ctes: str, q: str) -> str:
    return f"WITH {', '.join(ctes)} {q}"


_PT, _PX = f"ph AS ({_placeholders('turns', 'conv_id, turn')})", f"ph AS ({_placeholders('texts', 'conv_id')})"
_NOUNS = _list(L.nouns())
_NP = f"np AS (SELECT conv_id, turn, span, lower(value) AS raw, {_singular('lower(value)')} AS head, pos FROM ({_scan('turns', 'conv_id, turn', 'text', L.DEFINITE_NP, 2)}))"
_NPV = f"np AS (SELECT * FROM (SELECT conv_id, lower(value) AS raw, {_singular('lower(value)')} AS head, pos FROM ({_scan('views', 'conv_id', 'cur', L.DEFINITE_NP, 2)})) WHERE raw IN {_NOUNS} OR head IN {_NOUNS})"
_CHEAP = "CAST(ceil(length({t}) / 4.0) AS BIGINT)"
_WINDOW = "CASE model " + " ".join(f"WHEN '{m}' THEN {w}" for m, w, _, _ in L.MODELS) + f" ELSE {L.DEFAULT_WINDOW} END"
_IN = "CASE model " + " ".join(f"WHEN '{m}' THEN CAST({i} AS DOUBLE)" for m, _, i, _ in L.MODELS if i) + " END"
_OUT = "CASE model " + " ".join(f"WHEN '{m}' THEN CAST({o} AS DOUBLE)" for m, _, _, o in L.MODELS if o) + " END"
_REAL = "len(list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> ''))"
_EST = (
    "est AS (SELECT conv_id, turn, model, cheap, CASE WHEN cheap < 0.6 * win THEN 'cheap' WHEN cheap > 1.1 * win THEN 'cheap_over' ELSE 'exact_boundary' END AS method, "
    f"CAST(ceil({_REAL.format(t='text')} * 0.75) AS BIGINT) AS words FROM (SELECT conv_id, turn, text, model, {_CHEAP.format(t='text')} AS cheap, {_WINDOW} AS win FROM (SELECT *, {MODEL} AS model FROM turns))), "
    "tok AS (SELECT conv_id, any_value(model) AS model, CAST(sum(CASE WHEN method = 'exact_boundary' THEN words ELSE cheap END) AS BIGINT) AS tokens, "
    "arg_max(method, CASE method WHEN 'cheap' THEN 1 WHEN 'cheap_over' THEN 2 ELSE 3 END) AS method FROM est GROUP BY conv_id)"
)
_USD = f"tokens / 1000.0 * {_IN} + ceil(tokens * 0.5) / 1000.0 * {_OUT}"
_COMMA = "format('{{:,}}', {x})"
_WORDS = f"words AS (SELECT DISTINCT conv_id, unnest(string_split_regex(regexp_replace({_phrase('hist')}, '[^a-z0-9_]+', ' ', 'g'), ' ')) AS word FROM views)"
_KEYS = [(b, s, w) for b, xs, ys in L.OPPOSITES for s, ws in (("a", xs), ("b", ys)) for w in ws]
_CUES = (
    "cues(bucket, side, keyword) AS (VALUES " + ", ".join(f"('{b}', '{s}', '{w}')" for b, s, w in _KEYS) + "), "
    "sent AS (SELECT conv_id, unnest(string_split_regex(text, '[.!?]\\s+')) AS sentence FROM texts), "
    "found AS (SELECT conv_id, bucket, side, keyword FROM sent, cues WHERE regexp_matches(sentence, '(?i)\\b' || keyword || '\\b'))"
)
_PROSE = " OR ".join(f"regexp_matches(text, '{_duck(p)}')" for p in L.PROSE_AFTER_JSON)
_SETS = "sets(parameter_set, ord" + "".join(f", {f}" for f in FLAGS) + ") AS (VALUES " + ", ".join(f"('{n}', {i}" + "".join(f", {str(f in on or f == 'usePatternMatching').lower()}" for f in FLAGS) + ")" for i, (n, on) in enumerate(DEFAULT_SETS)) + ")"
_RUNS = (
    f"base AS (SELECT conv_id, list_concat(CASE WHEN {_DIALECT} IS NOT NULL THEN ['MISSING_PLACEHOLDER'] ELSE [] END, CASE WHEN {_PROSE} THEN ['SCHEMA_RISK', 'SCHEMA_RISK'] ELSE [] END) AS detected, "
    f"CASE WHEN conv_id % 7 = 0 THEN NULL ELSE {EXPECTED} END AS expected FROM texts), "
    "counted AS (SELECT *, len(list_filter(detected, lambda x: x = expected)) AS tp, len(list_filter(detected, lambda x: x <> expected)) AS fp, CASE WHEN list_contains(detected, expected) THEN 0 ELSE 1 END AS fn FROM base), "
    "scored AS (SELECT conv_id, detected, expected, CASE WHEN expected IS NOT NULL THEN tp END AS tp, CASE WHEN expected IS NOT NULL THEN fp END AS fp, CASE WHEN expected IS NOT NULL THEN fn END AS fn, "
    "CASE WHEN expected IS NOT NULL THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END END AS p, CASE WHEN expected IS NOT NULL THEN tp / (tp + fn) END AS r FROM counted), "
    "runs AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, parameter_set, CAST(conv_id % 17 + ord * 3 AS DOUBLE) AS latency, len(detected) AS issues_total, detected, expected, tp, fp, fn, p, r, "
    "CASE WHEN expected IS NOT NULL THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END END AS f1, conv_id % 11 = 0 AS failed FROM scored, sets)"
)
_BY_SET = "by_set AS (SELECT parameter_set, count(*) AS total_runs, CAST(sum(issues_total) AS BIGINT) AS total_issues, avg(latency) AS lat, avg(CASE WHEN failed THEN 0.0 ELSE 1.0 END) AS ok, avg(p) AS p, avg(r) AS r, avg(f1) AS f, avg(tp) AS tp, avg(fp) AS fp, avg(fn) AS fn FROM runs GROUP BY parameter_set)"

_INVALID = (
    "CASE conv_id % 5 WHEN 0 THEN 'Invalid JSON schema: root: missing type \"object\" for keyword \"properties\"' WHEN 1 THEN 'Invalid JSON schema: root: invalid type \"objekt\"' "
    "WHEN 2 THEN 'Invalid JSON schema with 2 errors: /a: invalid type \"strng\" for property \"a\"; /c: invalid type \"bool\" for property \"c\"' "
    "WHEN 3 THEN 'Invalid JSON schema: root: missing type \"array\" for keyword \"items\"' END"
)


def _has(text: str, word: str) -> str:
    return f"regexp_matches({text}, '(?i)\\b' || regexp_escape({word}) || 's?\\b')"


def _behind(text: str, word: str, *not_after: str) -> str:
    """Whether the word stands somewhere in the text with none of the strings right before it."""
    gaps = f"string_split_regex({text}, '(?i)\\b' || regexp_escape({word}) || 's?\\b')"
    return f"len(list_filter({gaps}[1:-2], lambda gap: NOT regexp_matches(gap, '({'|'.join(not_after)})$'))) > 0"


_OTHERS = ("this ", "that ", "a ", "an ", "some ", "any ", "each ", "every ")
_THE = "the[ \\n\\t]"


_VERB_FORMS = _list(dict.fromkeys(v + x for v in L.VERBS for x in ("", "s", "ed", "ing")))


def _tags(text: str) -> str:
    for code, p in L.TAGGED:
        text = f"regexp_replace({text}, '{_duck(p)}', '\\0[{code}]', 'g')"
    return text


def _more(column: str) -> str:
    """Nouns that stand behind a determiner, with their singulars, by conversation."""
    found = f"SELECT conv_id, lower(value) AS w FROM ({_scan('views', 'conv_id', column, L.ANY_DETERMINER, 2)})"
    return f"SELECT conv_id, unnest([w, {_singular('w')}]) AS w FROM ({found}) WHERE w NOT IN {_list(L.STOP_WORDS)} AND w NOT IN {_VERB_FORMS}"


def _extracted(definite: str, forward: str) -> list[str]:
    """The tables of candidates in extraction mode."""
    dynamic = f"SELECT conv_id, span, {_singular('lower(value)')} AS head, pos FROM ({_scan('views', 'conv_id', 'cur', L.DYNAMIC_FORWARD, 2)})"
    known = f"noun <> '' AND (noun IN {_NOUNS} OR {_singular('noun')} IN {_NOUNS} OR (conv_id, noun) IN (SELECT conv_id, w FROM more) OR (conv_id, {_singular('noun')}) IN (SELECT conv_id, w FROM more))"
    return [
        f"more AS (SELECT DISTINCT conv_id, w FROM ({_more('cur')} UNION ALL {_more('hist')}))",
        f"dn AS (SELECT conv_id, false AS forward, span, head, pos FROM ({definite}) WHERE raw NOT IN {_list(L.STOP_WORDS)} AND raw NOT IN {_VERB_FORMS} AND NOT starts_with(lower(span), 'aforementioned'))",
        f"fx AS (SELECT conv_id, true AS forward, span, CASE WHEN {known} THEN {_singular('noun')} ELSE '' END AS head, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, pos, length(span) ORDER BY k) AS r FROM ({forward})) WHERE r = 1)",
        f"fw AS (SELECT * FROM fx UNION ALL SELECT conv_id, true, span, head, pos FROM ({dynamic}) d WHERE NOT EXISTS (SELECT 1 FROM fx WHERE fx.conv_id = d.conv_id AND fx.pos = d.pos AND fx.head = d.head))",
    ]


def _reference(*after: str, nlp: bool = False) -> list[str]:
    """Views, candidates and what resolves each of them; then the given tables."""
    listed = lambda x: f"({x} IN {_NOUNS} OR (conv_id, {x}) IN (SELECT conv_id, w FROM more))" if nlp else f"{x} IN {_NOUNS}"
    span = "(the|this|that|these|those|aforementioned)"
    syn = "syn(s_head, syns) AS (VALUES " + ", ".join(f"('{h}', [" + ", ".join(f"'{x}'" for x in xs) + "])" for h, xs in L.synonyms().items()) + ")"
    forward = " UNION ALL ".join(f"SELECT conv_id, {i} AS k, span, {'lower(value)' if i == 0 else chr(39) * 2} AS noun, pos FROM ({_scan('views', 'conv_id', 'cur', p, 1 if i == 0 else 0)})" for i, p in enumerate(L.FORWARD_REFS))
    definite = f"SELECT conv_id, span, lower(value) AS raw, {_singular('lower(value)')} AS head, pos FROM ({_scan('views', 'conv_id', 'cur', L.DEFINITE_NP, 2)})"
    taxonomy = [
        f"dn AS (SELECT conv_id, false AS forward, span, head, pos FROM ({definite}) WHERE raw IN {_NOUNS} OR head IN {_NOUNS})",
        f"fw AS (SELECT conv_id, true AS forward, span, CASE WHEN noun <> '' AND (noun IN {_NOUNS} OR {_singular('noun')} IN {_NOUNS}) THEN {_singular('noun')} ELSE '' END AS head, pos FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY conv_id, pos, length(span) ORDER BY k) AS r FROM ({forward})) WHERE r = 1)",
    ]
    return [
        _TURNS, _TEXTS, _LAST, _VIEWS, syn,
        *(_extracted(definite, forward) if nlp else taxonomy),
        f"cd AS (SELECT row_number() OVER () AS k, c.*, attached, {_phrase('hist')} AS h, len(string_split_regex(trim(hist), '\\s+')) > 40 AS far, lower(substr(cur, 1, pos)) AS raw_before, {_phrase('substr(cur, 1, pos)')} AS before, "
        f"CASE WHEN forward THEN {_phrase('substr(cur, pos + length(span) + 1)')} ELSE '' END AS after, {_phrase('span')} AS ref FROM (SELECT * FROM dn UNION ALL SELECT * FROM fw) c JOIN views USING (conv_id))",
        f"ask AS (SELECT *, CASE WHEN word <> '' THEN {_singular('word')} ELSE string_split_regex(ref, '\\s+')[-1] END AS asked FROM (SELECT *, regexp_extract(ref, '\\b{span}\\s+([a-z][a-z0-9_-]{{2,}})\\b', 2) AS word FROM cd))",
        "two AS (SELECT ask.*, coalesce(a.syns, [head]) AS syns, coalesce(b.syns, [asked]) AS asked_syns FROM ask LEFT JOIN syn a ON a.s_head = head LEFT JOIN syn b ON b.s_head = asked)",
        f"s1 AS (SELECT k, bool_or({_has('h', 'x')}) AS in_h, bool_or({_has('after', 'x')}) AS in_after FROM (SELECT k, h, after, unnest(asked_syns) AS x FROM two) GROUP BY k)",
        f"s2 AS (SELECT k, bool_or({_behind('h', 'x', *_OTHERS)}) AS syn_h, bool_or({_behind('before', 'x', *_OTHERS, 'the ')}) AS syn_before, "
        f"bool_or({listed('x')} AND {_behind('raw_before', 'x', _THE)} AND {_behind('before', 'x', *_OTHERS, 'the ')}) AS bare, bool_or(contains(attached, x)) AS held FROM (SELECT k, conv_id, h, before, raw_before, attached, unnest(syns) AS x FROM two) GROUP BY k)",
        f"judged AS (SELECT two.*, CASE WHEN {_has('h', 'asked')} OR in_h THEN 'pattern' WHEN forward AND after <> '' AND ({_has('after', 'asked')} OR in_after) THEN 'pattern' "
        f"WHEN head <> '' AND far AND {_has('h', 'head')} THEN 'exact' WHEN head <> '' AND NOT far AND {_behind('before', 'head', 'the ')} THEN 'exact' WHEN head <> '' AND far AND syn_h THEN 'synonym' WHEN head <> '' AND NOT far AND syn_before THEN 'synonym' "
        f"WHEN head <> '' AND {listed('head')} AND {_behind('raw_before', 'head', _THE)} AND {_behind('before', 'head', *_OTHERS, 'the ')} THEN 'memory' WHEN head <> '' AND bare THEN 'synonym' WHEN head = '' OR contains(attached, head) OR held THEN 'attachment' END AS method "
        "FROM two JOIN s1 USING (k) JOIN s2 USING (k))",
        *after,
    ]


_REFERENCE_ISSUES = (
    "per AS (SELECT conv_id, count(*) AS n, count(*) FILTER (method IS NULL) AS uncovered, coalesce(bool_or(method IN ('synonym', 'memory', 'pattern')), false) AS unsure FROM judged GROUP BY conv_id)",
    "open AS (SELECT conv_id, lower(span) AS key, head, pos, row_number() OVER (PARTITION BY conv_id ORDER BY forward, pos, lower(span), head) AS rn FROM judged WHERE method IS NULL)",
    f"flagged AS (SELECT conv_id, coalesce(uncovered, 0) AS uncovered, coalesce(unsure, false) AS unsure, cue, words FROM (SELECT conv_id, regexp_matches(cur, '{_duck(L.DEICTIC)}') AS cue, len(string_split_regex(trim(hist), '\\s+')) AS words FROM views) LEFT JOIN per USING (conv_id) "
    "WHERE coalesce(uncovered, 0) > 0 OR (cue AND coalesce(n, 0) = 0))",
    "summed AS (SELECT conv_id, key, count(*) AS n, min(rn) AS ord FROM open GROUP BY ALL UNION ALL SELECT conv_id, 'deictic cue', 1, 1000000 FROM flagged WHERE cue)",
    "told AS (SELECT conv_id, string_agg('\"' || key || '\"' || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END, ', ' ORDER BY r) AS told FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, ord) AS r FROM summed) WHERE r <= 3 GROUP BY conv_id)",
    "opened AS (SELECT conv_id, count(*) AS n_open, arg_min(pos, rn) AS first_char, CAST(bool_or(head IN ('report', 'document', 'transcript')) AS BIGINT) + CAST(bool_or(head IN ('list', 'results')) AS BIGINT) AS advice FROM open GROUP BY conv_id)",
    "ri AS (SELECT conv_id, 'References ' || told || ' without antecedent in prior context or attachments.' AS detail, CASE WHEN words < 20 THEN 'low' WHEN uncovered > 0 AND unsure THEN 'medium' ELSE 'high' END AS confidence, first_char, "
    "least(50, coalesce(n_open, 0)) + CAST(cue AS BIGINT) AS n_occurrences, coalesce(advice, 0) AS advice FROM flagged JOIN told USING (conv_id) LEFT JOIN opened USING (conv_id))",
)
_ALL_ISSUES = (
    _PX, "pv AS (SELECT conv_id, variable, count(*) AS n, min(pos) AS f FROM ph GROUP BY ALL)",
    f"cf AS (SELECT conv_id, regexp_matches(text, '{_duck(L.VERBOSE)}') AND regexp_matches(text, '{_duck(L.CONCISE)}') AS v, regexp_matches(text, '{_duck(L.JSON_ONLY)}') AND regexp_matches(text, '{_duck(L.EXPLANATORY)}') AS f FROM texts)",
    _EST,
    "found(conv_id, ord, code, severity, detail, advice) AS ("
    "SELECT conv_id, 1, 'MISSING_PLACEHOLDER', 'high', 'Unresolved placeholder' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ': ' || string_agg(variable || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END, ', ' ORDER BY f), 0 FROM pv GROUP BY conv_id "
    "UNION ALL SELECT conv_id, 2, 'MISSING_REFERENCE', 'high', detail, advice FROM ri "
    "UNION ALL SELECT conv_id, 3, 'CONFLICTING_INSTRUCTION', 'medium', 'Conflicting directives: ' || concat_ws('; ', CASE WHEN v THEN 'concise vs step by step' END, CASE WHEN f THEN 'JSON only vs commentary' END) || '.', CAST(v AS BIGINT) + CAST(f AS BIGINT) FROM cf WHERE v OR f "
    f"UNION ALL SELECT conv_id, 4, 'SCHEMA_RISK', 'medium', 'Prompt mixes strict JSON instructions with additional prose after the schema.', 1 FROM texts WHERE schema_json IS NOT NULL AND ({_PROSE}) "
    f"UNION ALL SELECT conv_id, 5, 'INVALID_SCHEMA', 'high', {_INVALID}, 1 FROM texts WHERE conv_id % 5 <> 4 "
    f"UNION ALL SELECT conv_id, 7, 'TOKEN_OVERAGE', 'medium', 'Estimated ' || " + _COMMA.format(x="tokens") + " || ' input tokens (method: ' || method || ') exceeds ' || " + _COMMA.format(x="win") + " || ' token limit for ' || model || '.', 1 "
    f"FROM (SELECT *, {_WINDOW} AS win FROM tok) WHERE tokens > win)",
)

ORACLES = {
    "placeholder_scan": _with(_TURNS, _PT, q='SELECT conv_id, turn, dialect, variable, pos, ende AS "end" FROM ph'),
    "placeholder_summary": _with(_TURNS, _PT, q="SELECT conv_id, turn, variable, count(*) AS count, min(pos) AS first_pos FROM ph GROUP BY ALL"),
    "placeholder_first_seen": _with(_TURNS, _TEXTS, _PX, q="SELECT conv_id, min(pos) AS first_char, count(DISTINCT variable) AS variables FROM ph GROUP BY conv_id"),
    "placeholder_top3": _with(
        _TURNS, _TEXTS, _PX,
        q="SELECT * FROM (SELECT conv_id, variable, pos, rank, row_number() OVER (PARTITION BY conv_id ORDER BY seen, pos) AS place FROM (SELECT conv_id, variable, pos, row_number() OVER (PARTITION BY conv_id, variable ORDER BY pos) AS rank, min(pos) OVER (PARTITION BY conv_id, variable) AS seen FROM ph) WHERE rank <= 3) WHERE place <= 50",
    ),
    "placeholder_issues": _with(
        _TURNS, _TEXTS, _PX, "per AS (SELECT conv_id, variable, count(*) AS n, min(pos) AS f FROM ph GROUP BY ALL)",
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, 'MISSING_PLACEHOLDER' AS code, 'high' AS severity, 'Unresolved placeholder' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ': ' || string_agg(variable || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END, ', ' ORDER BY f) AS detail, min(f) AS first_char, least(50, CAST(sum(least(n, 3)) AS BIGINT)) AS n_occurrences FROM per GROUP BY conv_id",
    ),
    "ejs_scan": _with(_TURNS, q=f"SELECT conv_id, turn, value AS variable, pos FROM ({_scan('turns', 'conv_id, turn', 'text', _EJS, 1)})"),
    "jinja_scan": _with(_TURNS, q=f"SELECT conv_id, turn, value AS variable, pos FROM ({_scan('turns', 'conv_id, turn', 'text', _JJ, 1)})"),
    "dialect_detect": _with(_TURNS, q=f"SELECT coalesce({_DIALECT}, 'none') AS dialect, count(*) AS n FROM turns GROUP BY 1"),
    "full_text_concat": _with(_TURNS, _TEXTS, q="SELECT conv_id, length(text) AS chars, md5(text) AS digest FROM texts"),
    "history_window": _with(_TURNS, _LAST, _VIEWS, q="SELECT conv_id, length(cur) AS cur_chars, length(hist) AS hist_chars, md5(hist) AS digest FROM views"),
    "history_window_k": _with(
        _TURNS, _LAST, "h AS (SELECT conv_id, right(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (back IN (2, 3)), ''), 200) AS hist FROM ends GROUP BY conv_id)", q="SELECT conv_id, md5(hist) AS digest, length(hist) AS hist_chars FROM h"
    ),
    "normalize_phrase": _with(_TURNS, q=f"SELECT conv_id, turn, {_phrase('text')} AS phrase FROM turns"),
    "singularize_heads": _with(_TURNS, f"w AS (SELECT unnest(string_split({_phrase('text')}, ' ')) AS word FROM turns)", q=f"SELECT word, {_singular('word')} AS singular, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL"),
    "preview_snippet": _with(
        _TURNS, _PT, "b AS (SELECT *, greatest(0, pos - 40) AS lo, least(length(text), pos + length(variable) + 44) AS hi FROM ph)",
        q="SELECT conv_id, turn, pos, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, lo + 1, hi - lo), '\\s+', ' ', 'g')) || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS preview FROM b",
    ),
    "word_count": _with(_TURNS, q=f"SELECT conv_id, turn, {_REAL.format(t='text')} AS words FROM turns"),
    "token_cheap": _with(_TURNS, q=f"SELECT conv_id, CAST(sum({_CHEAP.format(t='text')}) AS BIGINT) AS tokens FROM turns GROUP BY conv_id"),
    "token_auto_method": (
        f"WITH c AS (SELECT doc_id, text, {_CHEAP.format(t='text')} AS cheap FROM documents), m AS (SELECT *, CASE WHEN cheap < 1200 THEN 'cheap' WHEN cheap > 2200 THEN 'cheap_over' ELSE 'exact_boundary' END AS method FROM c) "
        f"SELECT doc_id, method, CASE WHEN method = 'exact_boundary' THEN CAST(ceil({_REAL.format(t='text')} * 0.75) AS BIGINT) ELSE cheap END AS tokens FROM m"
    ),
    "token_overage": _with(
        _TURNS, _EST,
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, 'Estimated ' || " + _COMMA.format(x="tokens") + " || ' input tokens (method: ' || method || ') exceeds 400 token limit for ' || model || '.' AS detail, tokens FROM tok WHERE tokens > 400",
    ),
    "token_char_limit": _with(
        _TURNS, _TEXTS, q="SELECT CAST(conv_id AS VARCHAR) AS case_id, 'Input text (' || " + _COMMA.format(x="length(text)") + " || ' chars) exceeds character limit (1,000). Skipping exact tokenization.' AS detail FROM texts WHERE length(text) > 1000"
    ),
    "cost_estimate": _with(_TURNS, _EST, q=f"SELECT CAST(conv_id AS VARCHAR) AS case_id, model, tokens, method, round({_USD}, 8) AS usd FROM tok"),
    "cost_limit": _with(_TURNS, _EST, q=f"SELECT CAST(conv_id AS VARCHAR) AS case_id, 'cost-limit' AS kind FROM tok WHERE {_USD} > 0.01"),
    "model_dim_left_join": _with(_TURNS, q=f"SELECT conv_id, model, {_WINDOW} AS \"window\", {_IN} AS in_usd, {_OUT} AS out_usd FROM (SELECT DISTINCT conv_id, {MODEL} AS model FROM turns)"),
    "conversation_tokens": _with(_TURNS, _TEXTS, _EST, q="SELECT tok.model, method, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM tok JOIN texts USING (conv_id) GROUP BY ALL"),
    "conflict_verbosity": _with(_TURNS, _TEXTS, q=f"SELECT conv_id FROM texts WHERE regexp_matches(text, '{_duck(L.VERBOSE)}') AND regexp_matches(text, '{_duck(L.CONCISE)}')"),
    "conflict_pairs": _with(
        _TURNS, _TEXTS, *[f"{n} AS (SELECT conv_id, min(pos) AS pos, arg_min(span, pos) AS span FROM ({_scan('texts', 'conv_id', 'text', p)}) GROUP BY conv_id)" for n, p in (("v", L.VERBOSE), ("c", L.CONCISE), ("j", L.JSON_ONLY), ("e", L.EXPLANATORY))],
        q="SELECT conv_id, 'verbosity' AS bucket, v.span AS a_text, v.pos AS a_start, c.span AS b_text, c.pos AS b_start FROM v JOIN c USING (conv_id) UNION ALL SELECT conv_id, 'format', j.span, j.pos, e.span, e.pos FROM j JOIN e USING (conv_id)",
    ),
    "conflict_issues": _with(
        _TURNS, _TEXTS, f"b AS (SELECT conv_id, regexp_matches(text, '{_duck(L.VERBOSE)}') AND regexp_matches(text, '{_duck(L.CONCISE)}') AS v, regexp_matches(text, '{_duck(L.JSON_ONLY)}') AND regexp_matches(text, '{_duck(L.EXPLANATORY)}') AS f FROM texts)",
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, 'Conflicting directives: ' || concat_ws('; ', CASE WHEN v THEN 'concise vs step by step' END, CASE WHEN f THEN 'JSON only vs commentary' END) || '.' AS detail, 'high' AS confidence, CAST(v AS BIGINT) + CAST(f AS BIGINT) AS n_suggestions FROM b WHERE v OR f",
    ),
    "conflict_pairs_cross": _with(_TURNS, _TEXTS, _CUES, q="SELECT a.conv_id, a.bucket, count(*) AS pairs FROM found a JOIN found b ON a.conv_id = b.conv_id AND a.bucket = b.bucket AND a.side = 'a' AND b.side = 'b' GROUP BY ALL"),
    "phrase_pairs_self_join": _with(_TURNS, _TEXTS, _CUES, q="SELECT conv_id, count(*) * (count(*) - 1) // 2 AS pairs FROM found GROUP BY conv_id HAVING count(*) > 1"),
    "conflict_dedupe": (
        "WITH c AS (SELECT user_id, event_type AS bucket, least(event_id % 7, event_id % 5) AS lo, greatest(event_id % 7 + 3, event_id % 5 + 4) AS hi, value FROM events), "
        "k AS (SELECT user_id, bucket, lo, hi, max(value) AS value FROM c GROUP BY ALL) SELECT user_id, bucket, count(*) AS kept, round(max(value), 6) AS best FROM k GROUP BY ALL"
    ),
    "json_keyword_filter": _with(_TURNS, _TEXTS, q="SELECT conv_id FROM texts WHERE contains(lower(text), 'json') OR contains(text, '{') OR contains(text, '[') OR contains(text, '\"')"),
    "schema_risk": _with(
        _TURNS, _TEXTS, f"r AS (SELECT conv_id, text FROM texts WHERE schema_json IS NOT NULL AND ({_PROSE}))",
        f"j AS (SELECT conv_id, arg_min(span, pos) AS span, min(pos) AS pos FROM ({_scan('r', 'conv_id', 'text', '(?i)json[^.\\n]{0,120}')}) GROUP BY conv_id)",
        f"p AS (SELECT conv_id, arg_min(span, pos) AS span FROM ({_scan('r', 'conv_id', 'text', '(?i)(notes|commentary|explanation|discussion)[^.\\n]{0,120}')}) GROUP BY conv_id)",
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, j.span AS json_text, j.pos AS json_start, p.span AS prose_text FROM j JOIN p USING (conv_id)",
    ),
    "schema_errors": (
        "WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT path, keyword, message, count(*) AS n FROM c JOIN (VALUES (0, '', 'strictTypes', 'missing type \"object\" for keyword \"properties\"'), (1, '', 'type', 'invalid type \"objekt\"'), "
        "(2, '/a', 'type', 'invalid type \"strng\" for property \"a\"'), (2, '/c', 'type', 'invalid type \"bool\" for property \"c\"'), (3, '', 'strictTypes', 'missing type \"array\" for keyword \"items\"')) e(k, path, keyword, message) ON conv_id % 5 = k GROUP BY ALL"
    ),
    "schema_issue_detail": "SELECT CAST(conv_id AS VARCHAR) AS case_id, 'high' AS severity, " + _INVALID + " AS detail, CAST(CASE WHEN conv_id % 5 = 2 THEN 2 ELSE 1 END AS BIGINT) AS n_errors FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 <> 4",
    "definite_np_scan": _with(_TURNS, _NP, q="SELECT raw, head, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_start FROM np GROUP BY ALL"),
    "taxonomy_semi_join": _with(_TURNS, _NP, q=f"SELECT DISTINCT conv_id, turn, head, pos AS start FROM np WHERE head IN {_NOUNS} OR raw IN {_NOUNS}"),
    "forward_refs": _with(
        _TURNS, *[f"f{i} AS ({_scan('turns', 'conv_id, turn', 'text', p, 1 if i == 0 else 0)})" for i, p in enumerate(L.FORWARD_REFS)],
        "a AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS k, lower(span) AS span, {'lower(value)' if i == 0 else chr(39) * 2} AS noun, pos FROM f{i}" for i in range(6)) + ")",
        "u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos, length(span) ORDER BY k) AS r FROM a)",
        q=f"SELECT conv_id, turn, span, CASE WHEN noun <> '' AND (noun IN {_NOUNS} OR {_singular('noun')} IN {_NOUNS}) THEN {_singular('noun')} ELSE '' END AS head, pos AS start FROM u WHERE r = 1",
    ),
    "deictic_cue": _with(_TURNS, q=f"SELECT conv_id, turn FROM turns WHERE regexp_matches(text, '{_duck(L.DEICTIC)}')"),
    "noun_phrases": _with(
        _TURNS, _NP, f"verbs AS (SELECT unnest({L.VERBS}) AS v)",
        q=f"SELECT head, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, pos, head FROM np WHERE raw NOT IN {_list(L.STOP_WORDS)} AND raw NOT IN (SELECT v FROM verbs UNION SELECT v || 's' FROM verbs UNION SELECT v || 'ed' FROM verbs UNION SELECT v || 'ing' FROM verbs)) GROUP BY head",
    ),
    "antecedent_exact": _with(_TURNS, _LAST, _VIEWS, _NPV, q=f"SELECT np.conv_id, head, pos AS start, regexp_matches({_phrase('hist')}, '\\b' || head || 's?\\b') AS found FROM np JOIN views USING (conv_id)"),
    "antecedent_synonym": _with(
        _TURNS, _LAST, _VIEWS, _NPV, _WORDS, "syn(s_head, syn, ord) AS (VALUES " + ", ".join(f"('{h}', '{x}', {i})" for h, xs in L.synonyms().items() for i, x in enumerate(xs)) + ")",
        q="SELECT np.conv_id, head, pos AS start, arg_min(syn, ord) AS syn FROM np JOIN syn ON head = s_head JOIN words ON words.conv_id = np.conv_id AND word IN (syn, syn || 's') GROUP BY ALL",
    ),
    "attachment_contains": _with(_TURNS, _LAST, _VIEWS, _NPV, q="SELECT np.conv_id, head, pos AS start FROM np JOIN views USING (conv_id) WHERE contains(attached, head)"),
    "uncovered_anti_join": _with(_TURNS, _LAST, _VIEWS, _NPV, _WORDS, q="SELECT conv_id, head, pos AS start FROM np WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.conv_id = np.conv_id AND w.word IN (np.head, np.head || 's'))"),
    "reference_candidates": _with(
        *_reference(), f"m AS (SELECT k, arg_min(x, o) AS matched FROM (SELECT k, h, unnest(asked_syns) AS x, unnest(range(0, len(asked_syns))) AS o FROM two) WHERE {_has('h', 'x')} GROUP BY k)",
        "d AS (SELECT j.*, CASE WHEN method = 'pattern' THEN matched END AS said FROM judged j LEFT JOIN m USING (k))",
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, forward, lower(span) AS span, head, pos AS start, method, said AS matched, "
        "CASE WHEN method IN ('exact', 'synonym', 'memory', 'attachment') THEN 'resolved-by-' || method ELSE 'unresolved' END AS resolution, CASE WHEN method IS NULL THEN 'unfulfilled' ELSE 'fulfilled' END AS status, "
        "CASE WHEN method IS NULL OR method = 'pattern' THEN 'pattern' ELSE 'none' END AS checked_by, CAST(CASE WHEN method IS NULL THEN 0 WHEN method = 'pattern' AND said = asked THEN 0.9 ELSE 0.8 END AS DOUBLE) AS sure, false AS penalty FROM d",
    ),
    "reference_scores": _with(
        *_reference(), f"c AS (SELECT conv_id, CAST(regexp_matches(cur, '{_duck(L.DEICTIC)}') AS BIGINT) AS cue FROM views)",
        "p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (method IS NULL) AS u, sum(CASE WHEN method IN ('exact', 'synonym', 'pattern') THEN 2 WHEN method IN ('memory', 'attachment') THEN 1 ELSE 0 END) AS less, "
        "string_agg(DISTINCT method, ',' ORDER BY method) AS m FROM judged GROUP BY conv_id)",
        "s AS (SELECT conv_id, cue, coalesce(n, 0) AS n, coalesce(u, 0) AS uncovered, CAST(cue + CASE WHEN n > 0 THEN 1 ELSE 0 END - coalesce(less, 0) AS BIGINT) AS score, coalesce(m, '') AS methods FROM c LEFT JOIN p USING (conv_id))",
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, n, uncovered, score, uncovered > 0 OR (cue = 1 AND n = 0) OR score >= 2 AS flagged, methods FROM s",
    ),
    "reference_methods": _with(*_reference(), q="SELECT coalesce(method, 'none') AS method, forward, count(*) AS n FROM judged GROUP BY ALL"),
    "reference_issues": _with(*_reference(*_REFERENCE_ISSUES), q="SELECT CAST(conv_id AS VARCHAR) AS case_id, detail, confidence, first_char, n_occurrences FROM ri"),
    "issue_counts": _with(*_reference(*_REFERENCE_ISSUES, *_ALL_ISSUES), q="SELECT code, severity, count(*) AS n FROM found GROUP BY ALL"),
    "disabled_rules": _with(*_reference(*_REFERENCE_ISSUES, *_ALL_ISSUES), q="SELECT code, count(*) AS n FROM found WHERE code NOT IN ('MISSING_REFERENCE', 'INVALID_SCHEMA', 'TOKEN_OVERAGE', 'SCHEMA_RISK') GROUP BY ALL"),
    "analyze_reports": _with(
        *_reference(*_REFERENCE_ISSUES, *_ALL_ISSUES), "codes AS (SELECT conv_id, code, count(*) AS n FROM found GROUP BY ALL)", "listed AS (SELECT conv_id, string_agg(code || '=' || n, ', ' ORDER BY code) AS issue_counts FROM codes GROUP BY conv_id)",
        "each_case AS (SELECT conv_id, count(*) AS n_issues, CAST(sum(advice) AS BIGINT) AS n_suggestions, string_agg(detail, ' | ' ORDER BY ord) AS details FROM found GROUP BY conv_id)",
        q="SELECT CAST(conv_id AS VARCHAR) AS case_id, coalesce(n_issues, 0) AS n_issues, coalesce(n_suggestions, 0) AS n_suggestions, tokens AS est_input_tokens, coalesce(issue_counts, '') AS issue_counts, coalesce(details, '') AS details "
        "FROM texts LEFT JOIN each_case USING (conv_id) LEFT JOIN listed USING (conv_id) LEFT JOIN tok USING (conv_id)",
    ),
    "case_param_cross_join": _with(_SETS, q="SELECT parameter_set, CAST(i AS INTEGER) AS iteration, count(*) AS runs FROM (SELECT DISTINCT conv_id FROM conversations), sets, range(1, 3) r(i) GROUP BY ALL"),
    "accuracy_per_case": _with(_TURNS, _TEXTS, _SETS, _RUNS, q="SELECT case_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(f1, 6) AS f1 FROM runs WHERE parameter_set = 'baseline' AND expected IS NOT NULL"),
    "summary_by_parameter_set": _with(
        _TURNS, _TEXTS, _SETS, _RUNS, _BY_SET,
        q="SELECT parameter_set, total_runs, total_issues, round(lat, 6) AS avg_latency, round(ok, 6) AS success_rate, round(p, 6) AS avg_precision, round(r, 6) AS avg_recall, round(f, 6) AS avg_f1, round(tp, 6) AS avg_tp, round(fp, 6) AS avg_fp, round(fn, 6) AS avg_fn FROM by_set",
    ),
    "summary_by_test_case": _with(_TURNS, _TEXTS, _SETS, _RUNS, q="SELECT case_id, count(*) AS runs, round(avg(latency), 6) AS avg_latency, CAST(sum(issues_total) AS BIGINT) AS total_issues FROM runs GROUP BY case_id"),
    "issues_by_code": _with(_TURNS, _TEXTS, _SETS, _RUNS, q="SELECT parameter_set, code, count(*) AS n FROM (SELECT parameter_set, unnest(detected) AS code FROM runs) GROUP BY ALL"),
    "metric_table": _with(_TURNS, _TEXTS, _SETS, _RUNS, _BY_SET, q="SELECT parameter_set, total_runs, printf('%.1f', ok * 100) AS success_rate FROM by_set"),
    "feature_impact": _with(
        _TURNS, _TEXTS, _SETS, _RUNS, _BY_SET, "flat AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS is_on, lat, f FROM by_set JOIN sets USING (parameter_set)" for f in FLAGS) + ")",
        "g AS (SELECT feature, avg(lat) FILTER (is_on) AS l1, avg(lat) FILTER (NOT is_on) AS l0, avg(f) FILTER (is_on) AS f1, avg(f) FILTER (NOT is_on) AS f0 FROM flat GROUP BY feature)", q="SELECT feature, round(l1, 6) AS latency_on, round(l0, 6) AS latency_off, round((l1 - l0) / l0 * 100, 6) AS latency_change, round(f1, 6) AS f1_on, round(f0, 6) AS f1_off, round((f1 - f0) / f0 * 100, 6) AS f1_change FROM g WHERE l1 IS NOT NULL AND l0 IS NOT NULL",
    ),
    "history_trend": (
        "WITH e AS (SELECT 'report-' || strftime(ts, '%Y-%m-%d') || '.json' AS file, event_type AS parameter_set, sum(value) AS v, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY ALL), "
        "k AS (SELECT DISTINCT file FROM e ORDER BY file DESC LIMIT 10), d AS (SELECT * FROM e WHERE file IN (SELECT file FROM k)) SELECT parameter_set, count(*) AS reports, round(arg_max(v, file), 4) AS avg_latency_current, round(avg(v), 4) AS avg_latency_mean, "
        "round(arg_max(v, file) - arg_min(v, file), 4) AS avg_latency_trend, round(arg_max(c, file), 4) AS avg_f1_current, round(arg_max(c, file) - arg_min(c, file), 4) AS avg_f1_trend FROM d GROUP BY parameter_set"
    ),
    "dataset_statistics": "SELECT lang AS category, count(*) AS cases, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(avg(length(text) // 4), 6) AS avg_tokens FROM documents GROUP BY lang",
    "chunk_split": (
        "WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN [0] ELSE range(0, length(text), 400) END AS places FROM documents), x AS (SELECT doc_id, length(substr(text, p + 1, 500)) AS n FROM (SELECT doc_id, text, unnest(places) AS p FROM c)) "
        "SELECT doc_id, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chars, min(n) AS shortest FROM x GROUP BY doc_id"
    ),
    "sentence_split": "WITH x AS (SELECT doc_id, trim(unnest(string_split_regex(text, '[.!?]+\\s+'))) AS s FROM documents) SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM x WHERE length(s) > 10 GROUP BY doc_id",
    "nli_hypotheses": _with(
        _TURNS, _NP, f"h AS (SELECT {_phrase('span')} AS ref, raw FROM np WHERE raw IN {_NOUNS} OR head IN {_NOUNS})",
        q="SELECT hypothesis, count(*) AS n FROM (SELECT unnest(['There is ' || raw, 'The ' || raw || ' was mentioned', 'A ' || raw || ' exists', 'The context refers to ' || raw, 'There exists ' || ref]) AS hypothesis FROM h) GROUP BY hypothesis",
    ),
    "cosine_similarity": "SELECT a.vec_id AS a_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "best_match_similarity": "SELECT q.vec_id AS q_id, round(max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 5) AS best FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id",
    "combined_score": (
        "WITH e AS (SELECT (event_id % 10) / 10.0::DOUBLE AS p, (event_id % 7) / 7.0::DOUBLE AS s, (event_id % 11) / 11.0::DOUBLE AS n FROM events), c AS (SELECT *, p * 0.4::DOUBLE + s * 0.3::DOUBLE + n * 0.3::DOUBLE AS score, CAST(p >= 0.5 AS INT) + CAST(s >= 0.6 AS INT) + CAST(n >= 0.7 AS INT) AS strong FROM e) "
        "SELECT CASE WHEN score >= 0.5 THEN 'fulfilled' WHEN score >= 0.35 THEN 'uncertain' ELSE 'unfulfilled' END AS status, CASE WHEN strong >= 2 THEN 'combined' WHEN p >= s AND p >= n THEN 'pattern' WHEN s >= n THEN 'semantic-similarity' ELSE 'nli-entailment' END AS method, count(*) AS n, round(sum(score), 4) AS score FROM c GROUP BY ALL"
    ),
    "set_ops_codes": _with(
        _TURNS, _TEXTS, _SETS, _RUNS, "det AS (SELECT DISTINCT case_id, unnest(detected) AS code FROM runs WHERE parameter_set = 'baseline')", f"want AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS case_id, {EXPECTED} AS code FROM conversations)",
        q="SELECT kind, code, count(*) AS n FROM (SELECT 'hit' AS kind, * FROM (SELECT * FROM det INTERSECT SELECT * FROM want) UNION ALL SELECT 'extra', * FROM (SELECT * FROM det EXCEPT SELECT * FROM want)) GROUP BY ALL",
    ),
    "label_references": _with(
        _TURNS, "f AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS k, '{t}' AS type, span, pos FROM ({_scan('turns', 'conv_id, turn', 'text', p)})" for i, (p, t) in enumerate(L.LABEL_REFERENCES)) + ")",
        q="SELECT conv_id, turn, pos, lower(span) AS span, type FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos, length(span) ORDER BY k) AS r FROM f) WHERE r = 1",
    ),
    "tagged_prompts": _with(_TURNS, q="SELECT conv_id, turn, md5(" + _tags(f"({TAGS})") + ") AS digest FROM turns"),
    "valid_messages": _with(
        _TURNS, q="SELECT c.conv_id, coalesce(n, 2) AS n, md5(coalesce(m, 'You are a helpful assistant.' || chr(10) || 'Hello')) AS digest FROM (SELECT DISTINCT conv_id FROM turns) c LEFT JOIN (SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS m FROM turns "
        f"WHERE length(text) % 3 <> 0 AND role IN {_list(L.ROLES)} GROUP BY conv_id) g USING (conv_id)",
    ),
    "case_allocation": (
        "WITH s AS (SELECT i, 303 // 8 + CASE WHEN i < 303 % 8 THEN 1 ELSE 0 END AS n FROM range(8) t(i)) SELECT 'sector ' || i AS sector, 'pattern ' || j AS pattern, CAST(n // 5 + CASE WHEN j < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS cases FROM s, range(5) u(j)"
    ),
    "seeded_units": (
        "WITH " + ", ".join(
            f"x{i} AS (SELECT doc_id, xor(c, (c << 5) & 4294967295) AS x{''.join(f', u{j}' for j in range(i))}, NULL AS n FROM (SELECT *, xor(b, b >> 17) AS c FROM (SELECT *, xor(a, (a << 13) & 4294967295) AS b FROM "
            + ("(SELECT doc_id, CASE WHEN doc_id & 4294967295 = 0 THEN 123456789 ELSE doc_id & 4294967295 END AS a FROM documents)" if i == 0 else f"(SELECT doc_id, x AS a{''.join(f', u{j}' for j in range(i - 1))}, round(x / 4294967295.0::DOUBLE, 9) AS u{i - 1} FROM x{i - 1})")
            + "))))" for i in range(3)
        ).replace("))))", ")))") + " SELECT doc_id, u0, u1, round(x / 4294967295.0::DOUBLE, 9) AS u2 FROM x2"
    ),
    "conflict_context": _with(_TURNS, _TEXTS, q=f"SELECT conv_id, pos, span AS text, md5(substr(text, greatest(pos - 50, 0) + 1, pos + length(span) + 50 - greatest(pos - 50, 0))) AS context FROM ({_scan('texts', 'conv_id', 'text', L.VERBOSE)})"),
    "dynamic_forward": _with(_TURNS, f"t AS (SELECT conv_id, turn, {TAGS} AS tagged FROM turns)", q=f"SELECT conv_id, turn, {_singular('lower(value)')} AS head, pos, lower(span) AS span FROM ({_scan('t', 'conv_id, turn', 'tagged', L.DYNAMIC_FORWARD, 2)})"),
    "extracted_nouns": _with(
        _TURNS, f"w AS (SELECT conv_id, turn, lower(value) AS w FROM ({_scan('turns', 'conv_id, turn', 'text', L.ANY_DETERMINER, 2)}))", f"ok AS (SELECT * FROM w WHERE w NOT IN {_list(L.STOP_WORDS)} AND w NOT IN {_VERB_FORMS})",
        q=f"SELECT noun, count(*) AS n FROM (SELECT conv_id, turn, w AS noun FROM ok UNION SELECT conv_id, turn, {_singular('w')} FROM ok) GROUP BY noun",
    ),
    "extracted_phrases": _with(_TURNS, _NP, q=f"SELECT conv_id, turn, head, pos, lower(span) AS span FROM np WHERE raw NOT IN {_list(L.STOP_WORDS)} AND raw NOT IN {_VERB_FORMS} AND NOT starts_with(lower(span), 'aforementioned')"),
    "methods_used": _with(
        *_reference(*_REFERENCE_ISSUES), q="SELECT CAST(conv_id AS VARCHAR) AS case_id, CASE WHEN cue AND uncovered > 0 THEN 'none,pattern' WHEN cue THEN 'none' ELSE 'pattern' END AS methods FROM flagged",
    ),
    "nlp_reference_issues": _with(*_reference(*_REFERENCE_ISSUES, nlp=True), q="SELECT CAST(conv_id AS VARCHAR) AS case_id, detail, confidence, first_char FROM ri"),
    "iso_dates": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events",
}
