"""DuckDB SQL for the queries whose rules take several steps: byte-pair merges, antecedents, diffs."""

from __future__ import annotations

from tessera.queries import TOKENIZERS

ORACLES: dict[str, str] = {}

# White space as Unicode has it; RE2 knows no look-ahead, so a mark (U+E000) goes before the last blank of a run that a word follows.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PIECE = rf"''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+"
_RANKS = "SELECT '{1}' AS file, hex(from_base64(token)) AS part, rank FROM read_csv('{0}/{1}.tiktoken', delim=' ', header=false, quote='', escape='', columns={{'token': 'VARCHAR', 'rank': 'INTEGER'}})"
_FILES = ("byte_bpe_50k", "byte_bpe_multi_50k")

#: Tokens of each document: every distinct piece is merged pair by pair, one merge a round.
_TOKENS = rf"""
ranks AS MATERIALIZED ({" UNION ALL ".join(_RANKS.format(TOKENIZERS, f) for f in _FILES)}),
src AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4' ELSE 'other-model' END AS model, CASE WHEN doc_id % 3 = 0 THEN '{_FILES[1]}' ELSE '{_FILES[0]}' END AS file FROM documents),
seg AS (SELECT doc_id, file, unnest(string_split(regexp_replace(text, '([{_WS}])([{_WS}][^{_WS}])', '\1' || chr(57344) || '\2', 'g'), chr(57344))) AS s FROM src WHERE text <> ''),
piece AS MATERIALIZED (SELECT doc_id, file, p, count(*) AS n FROM (SELECT doc_id, file, unnest(regexp_extract_all(s, '{_PIECE}')) AS p FROM seg) GROUP BY ALL),
words AS MATERIALIZED (SELECT DISTINCT file, p, hex(encode(p)) AS hx FROM piece),
todo AS (SELECT file, p, list_transform(range(0, length(hx) // 2), lambda i: substr(hx, 2 * i + 1, 2)) AS parts FROM words w WHERE NOT EXISTS (SELECT 1 FROM ranks r WHERE r.file = w.file AND r.part = w.hx)),
merging(file, p, parts) AS (SELECT file, p, parts FROM todo
  UNION ALL SELECT file, p, parts[1:spot - 1] || [parts[spot] || parts[spot + 1]] || parts[spot + 2:] FROM (
    SELECT x.file, p, any_value(parts) AS parts, arg_min(i, CAST(r.rank AS BIGINT) * 1000000000 + i) AS spot FROM (SELECT file, p, parts, unnest(range(1, len(parts))) AS i FROM merging) x
    JOIN ranks r ON r.file = x.file AND r.part = x.parts[i] || x.parts[i + 1] GROUP BY x.file, p)),
sized AS (SELECT file, p, min(len(parts)) AS k FROM merging GROUP BY ALL),
exact AS (SELECT src.doc_id, src.model, src.text, CAST(coalesce(sum(n * coalesce(k, 1)), 0) AS BIGINT) AS tokens FROM src LEFT JOIN piece USING (doc_id, file) LEFT JOIN sized USING (file, p) GROUP BY ALL)
"""
ORACLES["token_exact"] = f"WITH RECURSIVE {_TOKENS} SELECT doc_id, model, tokens FROM exact"
ORACLES["token_exact_boundary"] = f"""WITH RECURSIVE {_TOKENS}, cheap AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS c FROM exact)
SELECT doc_id, CASE WHEN c < 0.6 * 1000 THEN 'cheap' WHEN c > 1.1 * 1000 THEN 'cheap_over' ELSE 'exact_boundary' END AS method, CASE WHEN c < 0.6 * 1000 OR c > 1.1 * 1000 THEN c ELSE tokens END AS tokens FROM cheap"""

ORACLES["best_match_all"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
p AS (SELECT q.vec_id AS q_id, e.vec_id, round(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) / (q.norm * e.norm), 9) AS c FROM n q JOIN n e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, vec_id) AS k FROM p)
SELECT q_id, vec_id AS best_id, round(c, 5) AS best FROM r WHERE k = 1
"""

ORACLES["line_diff_copies"] = """
WITH l AS (SELECT doc_id, text, list_max(list_transform(string_split(text, chr(10)), lambda x: struct_pack(size := length(x), line := x))) AS longest FROM documents WHERE text IS NOT NULL),
f AS (SELECT longest, min(doc_id) AS first_id FROM l GROUP BY 1),
p AS (SELECT DISTINCT f.first_id, l.doc_id, b.text AS before, l.text AS after FROM l JOIN f USING (longest) JOIN l b ON b.doc_id = f.first_id AND b.longest = f.longest WHERE l.doc_id <> f.first_id)
SELECT first_id, doc_id, CAST(len(string_split(before, chr(10))) AS BIGINT) AS n_before, CAST(len(string_split(after, chr(10))) AS BIGINT) AS n_after,
 before <> after AS changed, sha256(before) AS before_sha256, sha256(after) AS after_sha256 FROM p
"""
