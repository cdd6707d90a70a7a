"""DuckDB SQL for those queries that SQL can express, over whole tables and whole texts.

The SQL states the results plainly (all windows, all pairs that share a shingle, the closure of the links); it is for
comparison on small tables and says nothing about how the operators work.
"""

from __future__ import annotations

from weftline.llm.quality import COVERAGE, LINE_COVERAGE

_SPACE = r"\x20\x09-\x0D"
_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"


def _words(text: str = "t") -> str:
    return rf"w AS (SELECT r, doc_id, t, regexp_extract_all({text}, '[^{_SPACE}]+') AS w FROM d)"


def _grams(n: int) -> str:
    """(r, k, g): the n words from the k-th on, for each place of each text."""
    return f"SELECT r, k, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - {n - 1})) AS k FROM w WHERE len(w) >= {n})"


def near_dedup(size: int, similarity: int) -> str:
    return f"""
WITH RECURSIVE {_DOCS}, {_words("translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
s AS (SELECT DISTINCT r, g FROM ({_grams(size)}) UNION ALL SELECT r, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {size - 1}),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared.n >= {similarity} * (x.n + y.n - shared.n)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""


def quality() -> str:
    tables, joins, shares = [], [], []
    for n in COVERAGE:
        found = f"SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM ({_grams(n)})) WHERE n > 1"
        inside = f"SELECT DISTINCT r, k + j AS k FROM ({found}) CROSS JOIN generate_series(0, {n - 1}) AS o(j)"
        tables.append(f"i{n} AS (SELECT r, count(*) AS words, sum(length(word)) AS chars FROM ({inside}) JOIN p USING (r, k) GROUP BY r)")
        joins.append(f"LEFT JOIN i{n} USING (r)")
        shares.append(f"cast(coalesce(i{n}.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_{n}_chars")
    within = " AND ".join([f"dup_line_chars <= {LINE_COVERAGE}::DOUBLE", *(f"dup_{n}_chars <= {most}::DOUBLE" for n, most in COVERAGE.items())])
    return rf"""
WITH {_DOCS}, {_words()},
p AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM w),
m AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM p GROUP BY r),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(str_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY r, line),
x AS (SELECT r, sum(n - 1) AS n_dup_lines, sum((n - 1) * length(regexp_replace(line, '[{_SPACE}]', '', 'g'))) AS chars FROM l GROUP BY r),
{", ".join(tables)},
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, cast(coalesce(m.word_chars, 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
cast(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(i5.words, 0) AS n_repeat_words, cast(coalesce(x.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_line_chars, {", ".join(shares)}
FROM d LEFT JOIN m USING (r) LEFT JOIN x USING (r) {" ".join(joins)}),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {within} AS kept FROM v"""


def repeats(size: int) -> str:
    return f"""
WITH {_DOCS}, {_words()},
p AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM w),
found AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY g) AS n FROM ({_grams(size)})) WHERE n > 1),
gone AS (SELECT DISTINCT r, k + j AS k, true AS gone FROM found CROSS JOIN generate_series(0, {size - 1}) AS o(j)),
m AS (SELECT r, count(*) AS n_words, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone IS NULL) AS kept FROM p LEFT JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (r)"""
