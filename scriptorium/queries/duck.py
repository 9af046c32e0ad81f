"""DuckDB SQL for the same steps, built from the same fixed values."""

from __future__ import annotations

from ..functions import text as T

LIT = lambda s: "'" + s.replace("'", "''") + "'"
STOP = "[" + ", ".join(map(LIT, sorted(set(T.STOPWORDS)))) + "]"
WS = LIT(f"{T.WS}+")

#: Both engines read this: the documents table as material of twenty courses.
CORPUS_COLUMNS = [
    "'studip:' || source AS course_ref",
    "'studip:' || source || ':file:' || doc_id AS activity_ref",
    "'doc-' || doc_id || '.pdf' AS title",
    "'S. ' || (doc_id % 7 + 1) AS locator",
    "coalesce(lang, '') AS folder",
    "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Kurs ' || source END AS course_name",
    "CASE doc_id % 3 WHEN 0 THEN 'CC-BY' WHEN 1 THEN '' ELSE 'intern' END AS licence",
    "doc_id AS ord",
    "replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text",
]
_CORPUS = f"SELECT {', '.join(CORPUS_COLUMNS)} FROM documents"
CORPUS = f"corpus AS ({_CORPUS})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {LIT(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def collapse(x: str) -> str:
    inner = f"regexp_replace({x}, {WS}, ' ', 'g')"
    return strip(inner)


def stem(x: str) -> str:
    cases = " ".join(f"WHEN suffix({x}, {LIT(s)}) AND length({x}) >= {5 + len(s)} THEN left({x}, length({x}) - {len(s)})" for s in T.SUFFIXES)
    return f"(CASE {cases} ELSE {x} END)"


def _with_stem(x: str) -> str:
    return f"(CASE WHEN {stem(x)} <> {x} THEN [{x}, {stem(x)}] ELSE [{x}] END)"


def tokens(x: str) -> str:
    words = f"list_filter(list_transform(regexp_extract_all({x}, {LIT(T.WORD)}), lambda w: lower(w)), lambda w: length(w) >= 2 AND NOT regexp_matches(w, {LIT(T.DIGITS)}) AND NOT list_contains({STOP}, w))"
    split = f"string_split(regexp_replace(w, {LIT(f'({T.COMPOUND})')}, chr(1) || '\\1' || chr(1), 'gi'), chr(1))"
    parts = f"list_filter({split}, lambda p: length(p) >= 4 AND p <> w AND NOT list_contains({STOP}, p))"
    return f"flatten(list_transform({words}, lambda w: list_concat({_with_stem('w')}, CASE WHEN length(w) > 11 THEN flatten(list_transform({parts}, lambda p: {_with_stem('p')})) ELSE [] END)))"


def chunks(x: str) -> str:
    paras = f"list_filter(list_transform(string_split_regex({x}, {LIT(chr(92) + 'n' + T.WS + '*' + chr(92) + 'n')}), lambda p: {strip('p')}), lambda p: p <> '')"
    items = f"list_concat([{{'b': '', 'o': []::VARCHAR[]}}], list_transform({paras}, lambda p: {{'b': p, 'o': []::VARCHAR[]}}))"
    cut = f"list_transform(generate_series(0, length(q.b) - 1, {T.CHUNK - T.OVERLAP}), lambda i: substr(q.b, (i + 1)::INT, {T.CHUNK}))"
    fits = f"length(a.b) + length(q.b) + 2 <= {T.CHUNK}"
    flushed = "CASE WHEN a.b <> '' THEN list_append(a.o, a.b) ELSE a.o END"
    step = f"{{'b': CASE WHEN {fits} THEN (CASE WHEN a.b = '' THEN q.b ELSE a.b || chr(10) || chr(10) || q.b END) WHEN length(q.b) > {T.CHUNK} THEN '' ELSE q.b END, 'o': CASE WHEN {fits} THEN a.o WHEN length(q.b) > {T.CHUNK} THEN list_concat({flushed}, {cut}) ELSE {flushed} END}}"
    return f"list_reduce({items}, lambda a, q: {step})"


#: chunks(course_ref, ..., ord, pos, text, chunk_ord)
CHUNK_STEPS = f"""packed AS (SELECT *, {chunks('text')} AS r FROM corpus),
listed AS (SELECT * EXCLUDE (r), CASE WHEN r.b <> '' THEN list_append(r.o, r.b) WHEN len(r.o) > 0 THEN r.o ELSE [substr(text, 1, {T.CHUNK})] END AS l FROM packed),
pieces AS (SELECT * EXCLUDE (text, l), unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM listed),
chunks AS (SELECT *, row_number() OVER (PARTITION BY course_ref ORDER BY ord, pos) - 1 AS chunk_ord FROM pieces)"""
CHUNKS = f"{CORPUS}, {CHUNK_STEPS}"
#: The same with one course's texts followed by themselves in capitals.
CHANGED_CHUNKS = f"corpus AS (SELECT * REPLACE (CASE WHEN course_ref = 'studip:src1' THEN text || chr(10) || chr(10) || upper(text) ELSE text END AS text) FROM ({_CORPUS})), {CHUNK_STEPS}"
TOKENED = f"""{CHUNKS},
tokened AS (SELECT *, greatest(len(tokens), 1) AS len, substr(sha1(activity_ref), 1, 10) AS doc_id FROM (SELECT *, {tokens('text')} AS tokens FROM chunks))"""
POSTINGS = f"""{TOKENED},
postings AS (SELECT course_ref, chunk_ord, len, doc_id, term, count(*) AS tf FROM (SELECT course_ref, chunk_ord, len, doc_id, unnest(tokens) AS term FROM tokened) GROUP BY ALL)"""


def search(queries: str, with_text: bool = False) -> str:
    """CTEs down to ``hits`` for a ``queries`` CTE body (query_id, course_ref, text, k, documents)."""
    return f"""{POSTINGS},
queries AS ({queries}),
q AS (SELECT query_id, course_ref, k, documents, {tokens('text')} AS tokens FROM queries),
scoped AS (SELECT query_id, course_ref, k, documents FROM q WHERE len(tokens) > 0),
terms AS (SELECT query_id, course_ref, k, term, count(*) AS qtf FROM (SELECT query_id, course_ref, k, unnest(tokens) AS term FROM q) GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM tokened t JOIN scoped s USING (course_ref) WHERE coalesce(len(s.documents), 0) = 0 OR list_contains(s.documents, t.doc_id) GROUP BY query_id),
met AS (SELECT t.query_id, t.course_ref, t.k, t.qtf, t.term, p.chunk_ord, p.tf, p.len, count(*) OVER (PARTITION BY t.query_id, t.term) AS df
        FROM terms t JOIN postings p ON p.course_ref = t.course_ref AND p.term = t.term JOIN scoped s ON s.query_id = t.query_id
        WHERE coalesce(len(s.documents), 0) = 0 OR list_contains(s.documents, p.doc_id)),
scored AS (SELECT query_id, course_ref, chunk_ord, k, n, sum(qtf * (tf / len) * ln(1 + n / (1 + df))) AS raw, count(DISTINCT {stem('term')}) AS stems, max(ln(1 + n / (1 + df))) AS rarest
           FROM met JOIN n USING (query_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, chunk_ord) AS rank FROM scored WHERE (stems >= 2 OR NOT rarest < 0.6 * ln(1 + n / 2)) AND raw > 0),
best AS (SELECT *, max(raw) OVER (PARTITION BY query_id) AS top FROM ranked WHERE rank <= k),
hits AS (SELECT query_id, rank, course_ref, chunk_ord, activity_ref, title, locator, folder, course_name, licence, round(raw, 4) AS score, text
         FROM best JOIN chunks USING (course_ref, chunk_ord) WHERE raw >= 0.25 * top)"""
