"""SQL that gives the rows of the queries SQL can express."""

from __future__ import annotations

from .impacts import TOP
from .quality_rules import CLASSES, LANGUAGES, MAX_CLASSES, MAX_COMMON, MIN_CHARS, MIN_WORDS


def _half(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} / 2 * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} / 2 * log2({q} / {m}) ELSE 0 END)"


def _common(table: dict[str, int]) -> tuple[str, str]:
    """Hits, and the distance, over the letter runs r."""
    names = ", ".join(f"'{k}'" for k in table)
    hits = f"len(list_filter(r, lambda x: x IN ({names})))"
    rows = ", ".join(f"{{'k': '{k}', 'q': {n / 1000!r}}}" for k, n in table.items())
    shares = f"list_transform([{rows}], lambda s: {{'p': len(list_filter(r, lambda x: x = s.k)) / len(r), 'q': s.q}})"
    rest = _half(f"((len(r) - {hits}) / len(r))", repr(1 - sum(table.values()) / 1000))
    return hits, f"sqrt(greatest(list_sum(list_transform({shares}, lambda z: {_half('z.p', 'z.q')})) + {rest}, 0))"


def quality_rules_sql() -> str:
    blank, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    left = lambda pattern: f"length(regexp_replace(text, '{pattern}', '', 'g'))"
    one = lambda t: "sqrt(greatest(" + " + ".join(_half(f"(c_{k} / n_chars)", repr(q)) for k, q in t.items()) + ", 0))"
    classes = "least(" + ", ".join(map(one, CLASSES.values())) + ")"
    tables = [_common(t) for t in LANGUAGES.values()]
    hits = ", ".join(f"{h} AS h{i}" for i, (h, _) in enumerate(tables))
    most = "greatest(" + ", ".join(f"h{i}" for i in range(len(tables))) + ")"
    best = "CASE " + " ".join(f"WHEN h{i} = {most} THEN {d}" for i, (_, d) in enumerate(tables)) + " END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS r,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
i AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 7, 0))) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS k FROM i),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k),
p AS (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS p FROM c WHERE c > 1),
a AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, r, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, {left('[^\\p{Lu}]+')} AS c_upper, {left('[^\\p{Nd}]+')} AS c_digit, {left('[^\\p{L}]+')} AS letters, {left("[^.,;:!?''\x22()-]+")} AS c_mark, {hits}
  FROM w LEFT JOIN a ON w.doc_id = a.doc_id),
f AS (SELECT *, letters - c_upper AS c_letter, n_chars - word_chars AS c_space, greatest(word_chars - letters - c_digit - c_mark, 0) AS c_other FROM m),
j AS (SELECT *, CASE WHEN word_chars >= {MIN_CHARS} THEN {classes} END AS cd, CASE WHEN len(r) >= {MIN_WORDS} THEN {best} END AS wd, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {MAX_CLASSES} AND coalesce(wd, 0) <= {MAX_COMMON} AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM j"""


def ranked_search_sql() -> str:
    """Every document's whole score for every item, by joins."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
e AS (SELECT doc_id, n, unnest(t) AS term FROM n),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM e GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""
