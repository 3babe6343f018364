"""Plain SQL for the operators that SQL can state."""

from __future__ import annotations

from .licences import _PUNCTUATION, COPYRIGHT_LINE, KNOWN, SPELLINGS
from .lines import MIN_CHARS, THRESHOLD
from .quality import COVERAGE, LINE_CHARS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _grams(n: int) -> str:
    """Words of each text that lie in a window of ``n`` words found twice or more."""
    return f"""
grams{n} AS (SELECT *, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i
                       ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS gram FROM words),
twice{n} AS (SELECT *, i + {n - 1} <= n_words AND count(*) OVER (PARTITION BY doc_id, gram, i + {n - 1} <= n_words) > 1
                       AS twice FROM grams{n}),
inside{n} AS (SELECT doc_id, w, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i
                       ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM twice{n}),
cover{n} AS (SELECT doc_id, count(*) FILTER (inside) AS in_words, coalesce(sum(length(w)) FILTER (inside), 0) AS in_chars
             FROM inside{n} GROUP BY doc_id)"""


def _op3() -> str:
    joins = "\n".join(f"LEFT JOIN cover{n} ON cover{n}.doc_id = d.doc_id" for n in COVERAGE)
    under = " AND ".join(f"coalesce(cover{n}.in_chars, 0) <= {share} * greatest(word_chars, 1)"
                         for n, share in COVERAGE.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
lines AS (SELECT doc_id, ln, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln FROM docs)
          WHERE regexp_matches(ln, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, ln),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup, sum((n - 1) * strlen(ln)) AS dup_chars, sum(n * strlen(ln)) AS chars
        FROM lines GROUP BY doc_id),{",".join(_grams(n) for n in COVERAGE)},
sizes AS (SELECT doc_id, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
all_of AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cover5.in_words, 0)::BIGINT AS n_repeat_words,
    {under} AND coalesce(dup_chars, 0) <= {LINE_CHARS} * greatest(coalesce(chars, 0), 1) AS fine
  FROM docs d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id
  {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND fine AS kept
FROM all_of"""


#: Letters whose counts cannot differ by more in total than twice the edits; only spares comparisons.
_LETTERS = "aehiou nrst"

_OP6 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
all_lines AS (SELECT doc_id, unnest(ls) AS ln, generate_subscripts(ls, 1) AS pos FROM docs),
distinct_lines AS (SELECT ln, min((doc_id, pos)) AS first FROM all_lines
  WHERE regexp_matches(ln, '[^\\x20\\x09-\\x0D]') GROUP BY ln),
counted AS (SELECT *, length(ln) AS len,
  {", ".join(f"length(ln) - length(replace(ln, '{c}', '')) AS c{k}" for k, c in enumerate(_LETTERS))}
  FROM distinct_lines WHERE length(ln) >= {MIN_CHARS}),
links AS (SELECT a.ln AS ln, b.ln AS other, b.first AS other_first
  FROM counted a JOIN counted b ON a.len BETWEEN b.len - {THRESHOLD} AND b.len + {THRESHOLD} AND a.ln <> b.ln
   AND {" + ".join(f"abs(a.c{k} - b.c{k})" for k in range(len(_LETTERS)))} <= {2 * THRESHOLD}
  WHERE levenshtein(a.ln, b.ln) <= {THRESHOLD}),
linked AS (SELECT ln, count(*) AS n, min(other_first) AS earlier FROM links GROUP BY ln),
judged AS (
  SELECT l.doc_id, l.pos, l.ln, coalesce((l.doc_id, l.pos) <> d.first, false) AS equal, coalesce(k.n, 0) AS n,
    coalesce((l.doc_id, l.pos) <> d.first OR k.earlier < d.first, false) AS goes
  FROM all_lines l LEFT JOIN distinct_lines d ON d.ln = l.ln LEFT JOIN linked k ON k.ln = l.ln)
SELECT doc_id, count(*) FILTER (goes AND equal) AS lines_equal, count(*) FILTER (goes AND NOT equal) AS lines_near,
  sum(n)::BIGINT AS line_links,
  sha256(coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS text_sha256
FROM judged GROUP BY doc_id"""

_OP2 = r"""
WITH docs AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents),
groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM docs JOIN groups USING (text_sha256)"""

_OP8 = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (SELECT row_number() OVER () AS n, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
                arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    plain = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    words = f"' ' || trim(regexp_replace({plain}, {_quoted(_PUNCTUATION)}, ' ', 'g')) || ' '"
    for other, usual in SPELLINGS:
        words = f"replace({words}, ' {other} ', ' {usual} ')"
    return f"sha256(trim({words}))"


_OP4 = f"""
WITH given(licence, t) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
known AS (SELECT {_canonical("t")} AS digest, min(licence) AS licence FROM given GROUP BY 1),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT n, unnest(string_split(t, chr(10))) AS line FROM docs),
found AS (SELECT n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
          FROM lines JOIN known ON {_canonical("line")} = digest GROUP BY n)
SELECT doc_id, {_canonical("t")} AS canonical_sha256, licence, notices
FROM docs LEFT JOIN known ON {_canonical("t")} = digest LEFT JOIN found USING (n)"""

_OP13 = """
WITH rows AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.n <> b.n WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5),
found AS (
  SELECT p.a, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM positives p JOIN scores s ON s.a = p.a AND NOT s.same
   AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 3"""

ORACLES = {"op2_exact": _OP2, "op3_quality": _op3(), "op4_licences": _OP4, "op6_lines": _OP6, "op8_urls": _OP8,
           "op13_negatives": _OP13}
