"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import bpe, decontaminate, htmltext, jaccard, langid, lm, phrases, prefixtrie, quality, shard, suffixdup, toxicity, winnow

QUERIES = {
    "op1_suffix_dedup": suffixdup.op1_suffix_dedup,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_sharding": shard.op3_sharding,
    "op4_language_id": langid.op4_language_id,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality": quality.op8_quality,
    "op9_html_extraction": htmltext.op9_html_extraction,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_prefix_trie": prefixtrie.op11_prefix_trie,
    "op12_fingerprints": winnow.op12_fingerprints,
    "op13_phrase_mining": phrases.op13_phrase_mining,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

_OP5 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM iw)),
dwin AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, d.m, CAST(item_id AS VARCHAR) AS item FROM dwin d JOIN bwin b ON d.k = b.k AND d.m = b.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON dw.doc_id = n.doc_id LEFT JOIN t ON dw.doc_id = t.doc_id"""

_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
walk(x, y) AS (SELECT x, y FROM e UNION SELECT v.x, e.y FROM walk v JOIN e ON v.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(walk.y), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN walk ON w.doc_id = walk.x GROUP BY w.doc_id, n.n"""


def _repeated(n: int) -> str:
    """Starts of windows of n words that a text has twice or more."""
    return f"SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {n - 1}], ' ')) AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM w WHERE len(w) >= {n})) WHERE c > 1"


#: Words under repeats of 8 words or more are those in repeated windows of 8; a repeat over 50 is a repeated window of 51.
_OP8 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
r3 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM ({_repeated(3)})) GROUP BY doc_id),
r8 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM ({_repeated(8)})) GROUP BY doc_id),
r51 AS (SELECT DISTINCT doc_id FROM ({_repeated(51)})),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(r3.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(r3.n, 0) > 50 * len(w) AS base_failed, coalesce(r8.n, 0) AS covered, r51.doc_id IS NOT NULL AS long
  FROM w LEFT JOIN r3 ON w.doc_id = r3.doc_id LEFT JOIN r8 ON w.doc_id = r8.doc_id LEFT JOIN r51 ON w.doc_id = r51.doc_id LEFT JOIN lines ON w.doc_id = lines.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered / greatest(n_words, 1) <= 0.3 AND NOT long AS kept FROM b"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_FOLD}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
c AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS n FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m)) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE n >= 30),
cand AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cut AS (SELECT lang, m, phrase, a, w, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM cand)),
s AS (SELECT cut.*, fx.n AS l, fy.n AS r, CAST(2000000::HUGEINT * a // (fx.n + fy.n) AS BIGINT) AS score FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.phrase = x JOIN f fy ON fy.lang = cut.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(w[i:i + q - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(generate_series(1, m - q + 1)) AS i FROM cand, (SELECT unnest([2, 3]) AS q) WHERE q < m) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN sub ON b.lang = sub.lang AND b.phrase = sub.phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON o.lang = t.lang WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op5_decontamination": _OP5, "op6_jaccard_join": _OP6, "op8_quality": _OP8, "op13_phrase_mining": _OP13}
