"""SQL for DuckDB that gives the rows of ``op2_quality_rules`` and ``op7_near_dedup`` from their contracts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _lowered(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _many(characters: str) -> str:
    """Code points of ``t`` inside a character class."""
    return f"length(t) - length(regexp_replace(t, '[{characters}]', '', 'g'))"


_SEEN = r"\x21-\x7E"
_STOP = r".,;:?''\x22()\-"
_MARK = rf"({_many(_SEEN)}) - ({_many('a-zA-Z0-9' + _STOP + '#*$%&|<>')})"
_CLASSES = [_many("a-z"), _many("A-Z"), _many("0-9"), _many(r"\x20\x09\x0A\x0D"), _many(_STOP), _MARK, _many("#*$%&|<>"), _many(r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F"), _many(r"^\x00-\x7F")]


def _apart(p: str, q: str) -> str:
    """One item's part of twice the Jensen-Shannon divergence."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"


QUALITY_RULES = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, {_WORDS.format('t')} AS w FROM d),
tok AS MATERIALIZED (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
win AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1) GROUP BY r),
lin AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
chars AS (SELECT r, count(*) AS n_words, sum(length(x))::BIGINT AS n FROM tok GROUP BY r),
base AS MATERIALIZED (SELECT r, doc_id, lang, t, coalesce(n_words, 0) AS n_words, coalesce(chars.n, 0) AS word_chars, {_many('#*$%&|<>')} AS n_symbols, coalesce(lin.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(n_words, 0) < 10 OR 100 * coalesce(rep.n, 0) > 20 * coalesce(n_words, 0) AS base_failed FROM d LEFT JOIN chars USING (r) LEFT JOIN lin USING (r) LEFT JOIN rep USING (r)),
cl AS MATERIALIZED (SELECT r, unnest([{', '.join(_CLASSES)}])::DOUBLE AS n, unnest(range(9)) AS k FROM base),
usable AS MATERIALIZED (SELECT r, lang FROM base WHERE NOT base_failed AND lang IS NOT NULL),
rc AS MATERIALIZED (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT lang, k, sum(n) AS n FROM cl JOIN usable USING (r) GROUP BY lang, k)),
cp AS (SELECT r, k, coalesce(n / nullif(sum(n) OVER (PARTITION BY r), 0), 0) AS p, sum(n) OVER (PARTITION BY r) AS points FROM cl),
dc AS (SELECT r, lang, CASE WHEN max(points) > 0 THEN sqrt(greatest(0.0, least(1.0, sum({_apart('p', 'q')}) / 2))) ELSE 0.0 END AS dist FROM cp JOIN rc USING (k) GROUP BY r, lang),
wc AS MATERIALIZED (SELECT r, {_lowered('x')} AS x, count(*) AS c FROM tok GROUP BY ALL),
lw AS MATERIALIZED (SELECT lang, x, sum(c)::DOUBLE AS n FROM wc JOIN usable USING (r) GROUP BY lang, x),
common AS MATERIALIZED (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS place FROM lw) WHERE place <= 100),
langs AS (SELECT lw.lang, sum(lw.n) AS total, coalesce(max(s), 0) AS s FROM lw LEFT JOIN (SELECT lang, sum(n) AS s FROM common GROUP BY lang) USING (lang) GROUP BY lw.lang),
met AS (SELECT r, lang, sum(c) AS c, sum(n) AS n, sum({_apart('(c / n_words::DOUBLE)', '(n / total)')}) AS f FROM wc JOIN common USING (x) JOIN (SELECT r, n_words FROM base) USING (r) GROUP BY r, lang),
dw AS (SELECT b.r, l.lang, CASE WHEN n_words > 0 THEN sqrt(greatest(0.0, least(1.0, (coalesce(m.f, 0) + (s - coalesce(m.n, 0)) / total + {_apart('((n_words - coalesce(m.c, 0)) / n_words::DOUBLE)', '((total - s) / total)')}) / 2))) ELSE 0.0 END AS dist FROM base b CROSS JOIN langs l LEFT JOIN met m ON m.r = b.r AND m.lang = l.lang),
near AS (SELECT r, dc.dist AS class_distance, dw.dist AS word_distance FROM dc JOIN dw USING (r, lang) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dc.dist + dw.dist, lang) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(coalesce(class_distance, 0), 6) AS class_distance, round(coalesce(word_distance, 0), 6) AS word_distance,
  NOT base_failed AND NOT (length(t) >= 80 AND coalesce(class_distance, 0) > 0.24 OR n_words >= 40 AND coalesce(word_distance, 0) > 0.445) AS kept FROM base LEFT JOIN near USING (r)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_lowered("coalesce(text, '')"))} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM w),
win AS (SELECT doc_id, n, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
item AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM win WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS key FROM item GROUP BY doc_id),
class AS MATERIALIZED (SELECT key, min(doc_id) AS rep, min(n) AS n FROM sets GROUP BY key),
own AS MATERIALIZED (SELECT doc_id AS rep, g, n FROM item JOIN class ON doc_id = rep),
pairs AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM own a JOIN own b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN class USING (key) LEFT JOIN comp USING (rep)
"""
