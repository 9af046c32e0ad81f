"""Registered queries over course material, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as T
from ..operators import catalog, ingest, lexical, providers, trees, vector
from ..plans.index_store import IndexStore
from ..plans.scratch import fresh
from ..schema import INDEX
from ..streaming import jobs
from . import duck

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of few files dealt over all cores, for work that takes longer than the shuffle of a small table; many files are many tasks already."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as material of twenty courses."""
    return dealt(read(spark, sf_dir, "documents")).selectExpr(*duck.CORPUS_COLUMNS)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.chunked(corpus(spark, sf_dir))


_indexes: dict[tuple[str, str], IndexStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> IndexStore:
    """The index of a data folder: built by the first query of a session that asks for it, read by all others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        store = IndexStore(spark, scratch(spark, "index"))
        store.replace(chunks(spark, sf_dir))
        _indexes[key] = store
    return IndexStore(spark, _indexes[key].path)


scratch = fresh


# ---- chunks, terms, statistics


@query(f"WITH {duck.CHUNKS} SELECT course_ref, activity_ref, chunk_ord, text FROM chunks")
def chunk_documents(spark, sf_dir):
    return chunks(spark, sf_dir).select("course_ref", "activity_ref", "chunk_ord", "text")


@query(f"WITH {duck.CHUNKS} SELECT activity_ref, count(*) AS chunks, max(length(text)) AS longest FROM chunks WHERE activity_ref IN (SELECT activity_ref FROM corpus WHERE length(text) > 900) GROUP BY activity_ref")
def chunk_long_only(spark, sf_dir):
    long = corpus(spark, sf_dir).filter(F.length("text") > 900)
    return lexical.chunked(long).groupBy("activity_ref").agg(F.count(F.lit(1)).alias("chunks"), F.max(T.size("text")).alias("longest"))


@query(f"WITH {duck.TOKENED} SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM tokened) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    return lexical.terms(chunks(spark, sf_dir)).groupBy("term").agg(F.sum("tf").alias("n"))


@query(f"WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, {duck.LIT(T.WORD)}))) AS word FROM documents) SELECT word, {duck.stem('word')} AS stem FROM w")
def stem_terms(spark, sf_dir):
    words = dealt(read(spark, sf_dir, "documents")).select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("w"))
    return words.select(F.lower("w").alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem"))


#: Words of the questions, alone and as part of compounds.
_FORMS = ["w", "'E-' || w", "'KI-' || w", "w || 'befragung'", "w || 'verwaltung'", "'Forschungs' || w || 'nutzung'"]


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, {duck.LIT(T.WORD)})) AS w FROM benchmark), f AS (SELECT DISTINCT unnest([{', '.join(_FORMS)}]) AS word FROM w) SELECT word, array_to_string({duck.tokens('word')}, ' ') AS terms FROM f")
def compound_split(spark, sf_dir):
    words = dealt(read(spark, sf_dir, "benchmark")).select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("w")).distinct()
    forms = words.select(F.explode(F.array(*map(F.expr, _FORMS))).alias("word")).distinct()
    return forms.select("word", F.array_join(T.tokens("word"), " ").alias("terms"))


@query(f"WITH {duck.POSTINGS} SELECT course_ref, chunk_ord, term, tf, len FROM postings")
def term_frequency(spark, sf_dir):
    return lexical.postings(chunks(spark, sf_dir)).select("course_ref", "chunk_ord", "term", "tf", "len")


@query(f"WITH {duck.POSTINGS} SELECT course_ref, term, count(*) AS df FROM postings GROUP BY ALL")
def document_frequency(spark, sf_dir):
    return lexical.document_frequency(chunks(spark, sf_dir))


@query(f"WITH {duck.CHUNKS} SELECT course_ref, count(*) AS n, round(ln(1 + count(*) / 2), 6) AS max_idf FROM chunks GROUP BY course_ref")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(chunks(spark, sf_dir)).withColumn("max_idf", F.round("max_idf", 6))


# ---- lexical search

_HITS = "query_id, rank, course_ref, chunk_ord, title, locator, score"


def _hits(df: DataFrame) -> DataFrame:
    return df.select(*_HITS.split(", "))


_BATCH = "SELECT item_id AS query_id, 'studip:src' || (item_id % 20) AS course_ref, text, 6 AS k, NULL::VARCHAR[] AS documents FROM benchmark"


def batch(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "'studip:src' || (item_id % 20) AS course_ref", "text", "6 AS k")


_ONE = "SELECT 1 AS query_id, 'studip:src1' AS course_ref, 'Where is retitioning of the onenerth oredat' AS text, 4 AS k"


@query(f"WITH {duck.search(_ONE + ', NULL::VARCHAR[] AS documents')} SELECT {_HITS} FROM hits")
def lexical_search(spark, sf_dir):
    one = spark.sql(_ONE)
    return _hits(stored(spark, sf_dir).search(one))


@query(f"WITH {duck.search(_BATCH)} SELECT {_HITS} FROM hits")
def lexical_search_batch(spark, sf_dir):
    return _hits(stored(spark, sf_dir).search(batch(spark, sf_dir)))


_NARROW = "(SELECT list(substr(sha1('studip:src' || (item_id % 20) || ':file:' || (item_id % 20 + 20 * d)), 1, 10)) FROM (SELECT unnest(range(8)) AS d))"


@query(f"WITH {duck.search(_BATCH.replace('NULL::VARCHAR[]', _NARROW))} SELECT {_HITS} FROM hits")
def lexical_doc_filter(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: T.doc_id(F.concat(F.col("course_ref"), F.lit(":file:"), (F.col("query_id") % 20 + 20 * d).cast("string"))))
    return _hits(stored(spark, sf_dir).search(batch(spark, sf_dir).withColumn("documents", ids)))


_NONE = "SELECT 1 AS query_id, 'studip:src1' AS course_ref, 'Welche gibt es 2024' AS text, 4 AS k UNION ALL SELECT 2, 'studip:none', 'the onblehe', 4"


@query(f"WITH {duck.search(f'SELECT *, NULL::VARCHAR[] AS documents FROM ({_NONE})')} SELECT query_id, count(rank) AS hits FROM ({_NONE}) LEFT JOIN hits USING (query_id) GROUP BY query_id")
def lexical_unanswerable(spark, sf_dir):
    asked = spark.sql(_NONE)
    found = stored(spark, sf_dir).search(asked)
    return asked.select("query_id").join(found.select("query_id", "rank"), "query_id", "left").groupBy("query_id").agg(F.count("rank").alias("hits"))


@query(f"WITH {duck.search(_BATCH)} SELECT query_id, max(score) AS best, CASE WHEN max(score) IS NULL THEN 'none' WHEN max(score) < 0.5 THEN 'low' ELSE 'ok' END AS confidence FROM queries LEFT JOIN hits USING (query_id) GROUP BY query_id")
def confidence_flag(spark, sf_dir):
    asked = batch(spark, sf_dir)
    return lexical.confidence(stored(spark, sf_dir).search(asked), asked)


@query(f"WITH {duck.search(_BATCH)} SELECT query_id, string_agg('[' || rank || '] ' || title || ', ' || locator || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id")
def grounded_prompt(spark, sf_dir):
    return ingest.grounded_prompt(stored(spark, sf_dir).search(batch(spark, sf_dir)))


_ECHO = "(Offline-Modus, kein Modell aufgerufen.) "


@query(f"WITH {duck.search(_BATCH)} SELECT query_id, CASE WHEN count(rank) > 0 THEN '{_ECHO}Zur Frage „' || any_value(queries.text) || '“ wurden ' || count(rank) || ' Passagen aus den Kursmaterialien gefunden: ' || string_agg('[' || rank || ']', ' ' ORDER BY rank) || '. Mit konfiguriertem OPENAI_BASE_URL würde hier die Antwort des Modells stehen.' ELSE '{_ECHO}Frage empfangen: „' || any_value(queries.text) || '“. Kein Kursbezug angegeben, daher keine Recherche in Kursmaterialien.' END AS answer FROM queries LEFT JOIN hits USING (query_id) GROUP BY query_id")
def echo_answer(spark, sf_dir):
    asked = batch(spark, sf_dir)
    return providers.completed(asked, stored(spark, sf_dir).search(asked))


_TOLD = f"CASE WHEN context IS NULL THEN 'system: {ingest.NO_CONTEXT}' ELSE 'system: {ingest.GROUNDED}' || chr(10) || 'system: Auszüge aus den Kursmaterialien:' || chr(10) || chr(10) || context END || chr(10) || 'user: ' || text"


@query(f"WITH {duck.search(_BATCH)}, p AS (SELECT query_id, string_agg('[' || rank || '] ' || title || ', ' || locator || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id) SELECT query_id, {_TOLD} AS messages FROM queries LEFT JOIN p USING (query_id)")
def chat_messages(spark, sf_dir):
    asked = batch(spark, sf_dir)
    told = ingest.prompts(asked, stored(spark, sf_dir).search(asked))
    return told.select("query_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


@query(SQL["chat_messages"].replace(" AS messages ", " AS answer "))
def model_answers(spark, sf_dir):
    """Answers of a model that repeats what it was told."""
    asked = batch(spark, sf_dir)
    return providers.completed(asked, stored(spark, sf_dir).search(asked), lambda told: "\n".join(f"{m['role']}: {m['content']}" for m in told))


@query(f"WITH {duck.search(_BATCH)}, a AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) SELECT query_id, 'Siehe [' || CASE WHEN n >= 2 THEN 1 ELSE 2 END || '].' AS answer, CASE WHEN n >= 2 THEN (SELECT title FROM hits h WHERE h.query_id = a.query_id AND h.rank = 2) ELSE '' END AS sources FROM a")
def cited_answers(spark, sf_dir):
    asked = batch(spark, sf_dir)
    hits = stored(spark, sf_dir).search(asked)
    said = hits.select("query_id").distinct().withColumn("answer", F.lit("Siehe [2]."))
    return providers.answered(asked, hits, said).select("query_id", "answer", F.array_join(F.transform("sources", lambda x: x["title"]), ",").alias("sources"))


@query(f"WITH {duck.search(_BATCH)} SELECT query_id, rank, CASE WHEN length(s) > 320 THEN regexp_replace(substr(s, 1, 320), {duck.LIT(T.WS + '+' + T.NO_WS + '*$')[:-1]}', '') || ' …' ELSE s END AS snippet FROM (SELECT query_id, rank, CASE WHEN regexp_matches(t, '^[a-zäöüß.,;:)\\]]') THEN '… ' || t ELSE t END AS s FROM (SELECT query_id, rank, {duck.strip('text')} AS t FROM hits))")
def snippets(spark, sf_dir):
    return stored(spark, sf_dir).search(batch(spark, sf_dir)).select("query_id", "rank", T.snippet("text").alias("snippet"))


@query(f"WITH {duck.search(_BATCH)} SELECT query_id, activity_ref, locator, min(rank) AS first, string_agg(text, ' … ' ORDER BY rank) AS text FROM hits GROUP BY ALL")
def merge_passages(spark, sf_dir):
    return catalog.merged_passages(stored(spark, sf_dir).search(batch(spark, sf_dir)))


# ---- vector search

_VECTORS = "entries AS (SELECT 'course:' || label AS course_ref, vec_id AS ord, embedding AS vector FROM embeddings)"


def _vector_sql(where: str, floor: float, k: int) -> str:
    return f"""WITH {_VECTORS}, q AS (SELECT ord AS query_id, course_ref, vector AS q FROM entries WHERE {where}),
      s AS (SELECT query_id, course_ref, ord, list_cosine_similarity(q::DOUBLE[], vector::DOUBLE[]) AS score FROM q JOIN entries USING (course_ref)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM s WHERE score >= {floor})
      SELECT query_id, rank, course_ref, ord, round(score, 4) AS score FROM r WHERE rank <= {k}"""


def _vectors(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("'course:' || label AS course_ref", "vec_id AS ord", "embedding AS vector")


@query(_vector_sql("ord % 100 = 0", -1, 10))
def vector_topk(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    return vector.search(e, e.filter("ord % 100 = 0").withColumnRenamed("ord", "query_id"), k=10, floor=-1.0)


@query(_vector_sql("ord % 100 = 0", 0.35, 4))
def vector_floor_batch(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    return vector.search(e, e.filter("ord % 100 = 0").withColumnRenamed("ord", "query_id"))


# ---- catalogue and policy


@query(f"WITH {duck.CHUNKS} SELECT course_ref, count(*) AS chunks FROM chunks GROUP BY course_ref")
def list_courses(spark, sf_dir):
    return catalog.courses(stored(spark, sf_dir).read()).orderBy("course_ref")


@query(f"WITH {duck.CHUNKS} SELECT course_ref, count(*) AS chunks FROM chunks WHERE split_part(course_ref, ':', 1) = 'studip' GROUP BY course_ref")
def list_courses_platform(spark, sf_dir):
    return catalog.courses(stored(spark, sf_dir).read(), "studip")


@query(f"WITH {duck.CHUNKS} SELECT course_ref, coalesce(arg_min(course_name, chunk_ord) FILTER (course_name <> ''), '') AS course_name FROM chunks GROUP BY course_ref")
def course_names(spark, sf_dir):
    return catalog.course_names(stored(spark, sf_dir).read())


@query(f"WITH {duck.CHUNKS}, wanted AS (SELECT 'studip:src' || unnest(range(18, 23)) AS course_ref) SELECT course_ref, count(chunk_ord) AS chunks, count(chunk_ord) > 0 AS indexed FROM wanted LEFT JOIN chunks USING (course_ref) GROUP BY course_ref")
def index_status(spark, sf_dir):
    wanted = spark.range(18, 23).selectExpr("'studip:src' || id AS course_ref")
    return catalog.index_status(stored(spark, sf_dir).read(), wanted)


@query(f"WITH {duck.CHUNKS} SELECT course_ref, activity_ref, substr(sha1(activity_ref), 1, 10) AS doc_id, min(title) AS title, min(folder) AS folder, count(*) AS chunks, min(locator) AS locators FROM chunks GROUP BY course_ref, activity_ref")
def course_documents(spark, sf_dir):
    return catalog.documents(stored(spark, sf_dir).read()).withColumn("locators", F.array_join("locators", ","))


@query(f"WITH {duck.CORPUS}, acl AS (SELECT unnest(['studip:src1', 'studip:src7', 'moodle:5']) AS course_ref) SELECT course_ref, count(*) AS documents FROM corpus WHERE course_ref IN (SELECT course_ref FROM acl) GROUP BY course_ref")
def visible_courses_allowlist(spark, sf_dir):
    acl = catalog.parse_allowlist(spark.createDataFrame([("student1=studip:src1, moodle:5, studip:src7; tutor = studip:src2;",)], "text string"))
    return catalog.visible(corpus(spark, sf_dir), "allowlist", acl, "Student1").groupBy("course_ref").agg(F.count(F.lit(1)).alias("documents"))


@query(f"WITH {duck.CORPUS} SELECT course_ref FROM corpus WHERE false")
def visible_courses_none(spark, sf_dir):
    return catalog.visible(corpus(spark, sf_dir), "none").select("course_ref")


@query("""WITH d AS (SELECT doc_id, source FROM documents)
  SELECT 'user' || doc_id AS username, unnest(['studip:' || source, 'moodle:' || doc_id % 7]) AS course_ref FROM d
  UNION SELECT 'tutor' || doc_id % 50, 'ilias:' || source FROM d WHERE doc_id % 3 = 0""")
def allowlist_parse(spark, sf_dir):
    """A setting a document, with blanks, capitals, empty entries and repetitions."""
    tutor = "CASE WHEN doc_id % 3 = 0 THEN '; Tutor' || doc_id % 50 || '=ilias:' || source || ';' ELSE ' ; ' END"
    settings = read(spark, sf_dir, "documents").selectExpr(f"' USER' || doc_id || ' = studip:' || source || ', moodle:' || doc_id % 7 || ' ,, studip:' || source || {tutor} AS text")
    return catalog.parse_allowlist(settings)


@query(f"WITH {duck.CORPUS} SELECT course_ref, substr(sha1(activity_ref), 1, 10) AS doc_id FROM corpus WHERE lower(title) IN ('doc-7.pdf', 'doc-12.pdf') OR substr(sha1(activity_ref), 1, 10) = substr(sha1('studip:src3:file:3'), 1, 10)")
def resolve_documents(spark, sf_dir):
    wanted = spark.sql("SELECT explode(array('DOC-7.PDF', 'doc-12.pdf', substr(sha1('studip:src3:file:3'), 1, 10))) AS name")
    return catalog.resolve(catalog.documents(stored(spark, sf_dir).read()), wanted)


_PART = "CAST(floor(doc_id / 3) AS BIGINT)"
_PLACES = ["'c' AS course_ref", f"'a' || {_PART} AS activity_ref", "'t' AS title", "'' AS folder", "doc_id AS chunk_ord", f"CASE {_PART} % 5 WHEN 0 THEN 'S. ' || doc_id % 3 WHEN 1 THEN 'Folie ' || doc_id % 2 WHEN 2 THEN '12:3' || doc_id % 3 WHEN 3 THEN 'Kapitel' ELSE CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'S. 4' ELSE 'Folie 9' END END AS locator"]


@query(rf"""WITH p AS (SELECT {', '.join(_PLACES)} FROM documents), n AS (
    SELECT activity_ref, count(DISTINCT locator) FILTER (regexp_matches(locator, '^S\. \d+$')) AS s, count(DISTINCT locator) FILTER (regexp_matches(locator, '^Folie \d+$')) AS f, count(*) FILTER (regexp_matches(locator, '^(\d+:)?\d+:\d\d$')) AS r FROM p GROUP BY activity_ref)
    SELECT activity_ref, CASE WHEN s = 1 THEN '1 Seite' WHEN s > 1 THEN s || ' Seiten' WHEN f = 1 THEN '1 Folie' WHEN f > 1 THEN f || ' Folien' WHEN r > 0 THEN 'Aufnahme' ELSE '' END AS label FROM n""")
def kind_labels(spark, sf_dir):
    """Labels of documents of pages, of slides, recordings, chapters and mixtures."""
    rows = read(spark, sf_dir, "documents").selectExpr(*_PLACES)
    return catalog.documents(rows).select("activity_ref", catalog.kind_label(F.col("locators")).alias("label"))


@query(f"WITH {duck.CHUNKS} SELECT course_ref, folder AS grp, count(DISTINCT activity_ref) AS documents, count(*) AS chunks FROM chunks GROUP BY ALL")
def materials_by_folder(spark, sf_dir):
    return catalog.by_folder(catalog.documents(stored(spark, sf_dir).read()))


# ---- scalars


@query(f"WITH {duck.CORPUS} SELECT activity_ref, substr(sha1(activity_ref), 1, 10) AS doc_id FROM corpus")
def doc_ids(spark, sf_dir):
    return corpus(spark, sf_dir).select("activity_ref", T.doc_id("activity_ref").alias("doc_id"))


@query(f"WITH {duck.CORPUS} SELECT activity_ref, 'https://lms.example/dispatch.php/file/details/' || split_part(activity_ref, ':', 4) || '?cid=' || split_part(activity_ref, ':', 2) AS link FROM corpus")
def lms_links(spark, sf_dir):
    return corpus(spark, sf_dir).select("activity_ref", links.lms_link(F.col("activity_ref"), F.col("locator"), studip="https://lms.example/").alias("link"))


#: An activity of each form, by doc_id modulo 14: its reference and its address.
_FORMS_OF_LINKS = [
    ("'studip:' || source || ':file:' || doc_id", "'https://s/dispatch.php/file/details/' || doc_id || '?cid=' || source"),
    ("'studip:a b/ü:file:' || doc_id", "'https://s/dispatch.php/file/details/' || doc_id || '?cid=a%20b/%C3%BC'"),
    ("'studip:' || source || ':courseware:' || doc_id || ':7'", "'https://s/dispatch.php/course/courseware/courseware/7?cid=' || source || '#/structural_element/' || doc_id"),
    ("'studip:' || source || ':courseware:' || doc_id", "'https://s/dispatch.php/course/courseware?cid=' || source"),
    ("'studip:' || source || ':wiki:' || doc_id", "'https://s/dispatch.php/course/overview?cid=' || source"),
    ("'moodle:5:file:' || doc_id || ':resource:A.pdf'", "'https://m/mod/resource/view.php?id=' || doc_id || '&redirect=1#page=' || doc_id % 9"),
    ("'moodle:5:module:' || doc_id || ':page'", "'https://m/mod/page/view.php?id=' || doc_id"),
    ("'moodle:5:module:' || doc_id || ':H5P'", "'https://m/course/view.php?id=5#module-' || doc_id"),
    ("'moodle:5:section:' || doc_id", "'https://m/course/view.php?id=5'"),
    ("'ilias:86:file:' || doc_id || ':A.pdf'", "'https://i/goto.php?target=file_' || doc_id || '&client_id=c#page=' || doc_id % 9"),
    ("'ilias:86:obj:' || doc_id", "'https://i/goto.php?target=crs_86&client_id=c'"),
    ("'other:1:file:' || doc_id", "''"),
    ("'plain' || doc_id", "''"),
    ("'ilias:' || doc_id", "'https://i/goto.php?target=crs_' || doc_id || '&client_id=c'"),
]
_ANY_FORM = lambda side: f"CASE doc_id % {len(_FORMS_OF_LINKS)} {' '.join(f'WHEN {n} THEN {x[side]}' for n, x in enumerate(_FORMS_OF_LINKS))} END"


@query(f"SELECT {_ANY_FORM(0)} AS activity_ref, {_ANY_FORM(1)} AS link FROM documents")
def lms_link_forms(spark, sf_dir):
    """Addresses of all kinds of activities of three platforms, of a fourth and of none."""
    refs = read(spark, sf_dir, "documents").selectExpr(f"{_ANY_FORM(0)} AS activity_ref", "'S. ' || doc_id % 9 AS locator")
    return refs.select("activity_ref", links.lms_link(F.col("activity_ref"), F.col("locator"), studip="https://s", moodle="https://m/", ilias="https://i", client="c").alias("link"))


_REF = "CASE doc_id % 5 WHEN 0 THEN 'studip:' || doc_id WHEN 1 THEN 'moodle:' || doc_id || ':x' WHEN 2 THEN 'plain' || doc_id WHEN 3 THEN '' ELSE ':' || doc_id END"


@query(f"SELECT doc_id, {_REF} AS ref, CASE doc_id % 5 WHEN 0 THEN 'studip' WHEN 1 THEN 'moodle' WHEN 4 THEN '' ELSE 'unknown' END AS platform FROM documents")
def namespaces(spark, sf_dir):
    return read(spark, sf_dir, "documents").selectExpr("doc_id", f"{_REF} AS ref").select("doc_id", "ref", T.namespace("ref").alias("platform"))


@query(f"WITH {duck.CORPUS} SELECT activity_ref, title || ', ' || locator || ' (' || CASE WHEN course_name <> '' THEN course_name || ' / ' ELSE '' END || folder || ')' AS citation FROM corpus")
def citations(spark, sf_dir):
    return corpus(spark, sf_dir).select("activity_ref", T.citation("title", "locator", "course_name", "folder").alias("citation"))


@query("SELECT doc_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS stamp FROM (SELECT doc_id, doc_id * 37 AS s FROM documents)")
def stamps(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.stamp(F.col("doc_id") * 37).alias("stamp"))


#: Each text as an answer that cites one source in its middle and one at its end; numbers over 4 are no sources.
_SAID = "regexp_replace(coalesce(text, ''), '[\\[\\]［］【】]', '', 'g')"
_CITED = "doc_id % 7 AS a, doc_id % 4 + 1 AS b"


@query(f"""WITH d AS (SELECT doc_id, {_SAID} AS t, {_CITED} FROM documents), v AS (SELECT *, a BETWEEN 1 AND 4 AS ok FROM d)
  SELECT doc_id, t || CASE WHEN ok THEN ' [' || CASE WHEN b < a THEN 2 ELSE 1 END || ']' ELSE ' ［' || a || '］' END || ' und [' || CASE WHEN ok AND a < b THEN 2 ELSE 1 END || '].' AS shown,
    CASE WHEN NOT ok OR a = b THEN b::VARCHAR ELSE least(a, b) || ',' || greatest(a, b) END AS cited FROM v""")
def cited_sources(spark, sf_dir):
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]［］【】]", "")
    answers = read(spark, sf_dir, "documents").selectExpr("doc_id", "text", *_CITED.split(", "))
    answers = answers.select("doc_id", F.concat(said, F.lit(" ［"), F.col("a").cast("string"), F.lit("］ und 【 "), F.col("b").cast("string"), F.lit("】.")).alias("answer"))
    answers = answers.withColumn("c", T.cited("answer", F.lit(4)))
    return answers.select("doc_id", T.renumbered("answer", F.col("c")).alias("shown"), F.array_join("c", ",").alias("cited"))


# ---- ingestion


#: Named references that the pages hold, ``&amp;`` last.
_NAMED = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def _html_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in _NAMED.items():
        out = f"replace({out}, {duck.LIT(a)}, {duck.LIT(b)})"
    return duck.collapse(out)


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def strip_html_pages(spark, sf_dir):
    return dealt(read(spark, sf_dir, "pages")).select("page_id", T.strip_html("html").alias("text"))


_KINDS = ["file", "wiki", "news", "description"]
_KIND = "CASE page_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'wiki' WHEN 2 THEN 'news' ELSE 'description' END"


@query(f"SELECT page_id, {_KIND} AS kind FROM pages WHERE length({_html_sql('html')}) >= CASE page_id % 4 WHEN 0 THEN 15 WHEN 2 THEN 1 ELSE 40 END")
def text_floor_pages(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.lit("studip").alias("platform"), F.expr(_KIND).alias("kind"), T.strip_html("html").alias("text"))
    return ingest.long_enough(rows).select("page_id", "kind")


_NAMES = "CASE doc_id % 6 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.mp3' WHEN 2 THEN 'c.png' WHEN 3 THEN 'd.txt' WHEN 4 THEN 'e.svg' ELSE 'f' END AS name, CASE doc_id % 5 WHEN 0 THEN 'image/svg+xml' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/jpeg' ELSE NULL END AS mime, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS downloadable"
_RX = lambda s: "'\\.(" + "|".join(s) + ")$'"


def _names(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id", _NAMES.split(" AS name")[0] + " AS name", _NAMES.split("AS name, ")[1].split(" AS mime")[0] + " AS mime", _NAMES.split("AS mime, ")[1])


@query(f"SELECT doc_id, regexp_matches(lower(name), {_RX(links.TEXTS)}) OR contains(coalesce(mime, ''), 'pdf') AS extractable FROM (SELECT doc_id, {_NAMES} FROM documents)")
def extractable_flags(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", links.extractable(F.col("name"), F.col("mime")).alias("extractable"))


@query(f"SELECT doc_id, name = 'c.png' OR coalesce(mime, '') = 'image/jpeg' AS image FROM (SELECT doc_id, {_NAMES} FROM documents)")
def image_flags(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", links.image(F.col("name"), F.col("mime")).alias("image"))


@query(f"SELECT doc_id, regexp_matches(lower(name), {_RX(links.RECORDINGS)}) OR coalesce(mime, '') LIKE 'video/%' AS transcribable FROM (SELECT doc_id, {_NAMES} FROM documents)")
def transcribable_flags(spark, sf_dir):
    return _names(spark, sf_dir).select("doc_id", links.transcribable(F.col("name"), F.col("mime")).alias("transcribable"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def downloadable_flags(spark, sf_dir):
    return _names(spark, sf_dir).filter(links.not_false(F.col("downloadable"))).select("doc_id")


@query(f"SELECT source, array_to_string(list_sort(list(n) FILTER (length({duck.collapse('text')}) < 60)), ',') AS short FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY source HAVING count(*) FILTER (length({duck.collapse('text')}) < 60) > 0")
def short_pages(spark, sf_dir):
    # a page's number is one more than the pages before it: no row holds a file's texts
    pages = read(spark, sf_dir, "documents").select(F.col("source").alias("course_ref"), "doc_id", T.size(T.collapse("text")).alias("size"), F.lit(1).alias("one"))
    numbered = pages.join(ingest.before_each(pages, "one", "doc_id"), ["course_ref", "doc_id"])
    short = numbered.filter("size < 60").groupBy(F.col("course_ref").alias("source"))
    return short.agg(F.array_join(F.array_sort(F.collect_list(F.col("before") + 1)), ",").alias("short"))


@query(f"WITH {duck.CORPUS}, f AS (SELECT course_ref, ord, ord % 9 + 1 AS pages FROM corpus), b AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY course_ref ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT course_ref, ord, pages, least(greatest(100 - before, 0), pages)::BIGINT AS take, (pages - least(greatest(100 - before, 0), pages))::BIGINT AS skipped FROM b")
def page_budget(spark, sf_dir):
    files = corpus(spark, sf_dir).select("course_ref", "ord", (F.col("ord") % 9 + 1).alias("pages"))
    return ingest.page_budget(files, 100)


@query("SELECT doc_id, sha256(text) || ':' || (doc_id % 7 + 1) || ':reader' AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def ocr_cache_misses(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("blob"), ingest.cache_key(F.col("text"), F.col("doc_id") % 7 + 1, "reader").alias("page_key"))
    cache = pages.filter("doc_id % 3 = 0").select(F.col("blob").alias("key"))
    return ingest.cache_misses(pages.withColumnRenamed("blob", "key"), cache).select("doc_id", F.col("page_key").alias("key"))


def _segments_sql() -> str:
    line = f"(CASE WHEN q.w <> a.w THEN q.w || ': ' ELSE '' END || {duck.strip('q.buf')})"
    buf = f"(CASE WHEN a.buf = '' THEN {line} ELSE a.buf || ' ' || {line} END)"
    full = f"a.n + length({line}) >= 900"
    at = "a.at"
    stamp = lambda x: f"(CASE WHEN {x} >= 3600000 THEN ({x} // 3600000) || ':' || lpad(({x} % 3600000 // 60000)::VARCHAR, 2, '0') ELSE ({x} // 60000)::VARCHAR END || ':' || lpad(({x} % 60000 // 1000)::VARCHAR, 2, '0'))"
    empty = "[]::STRUCT(l VARCHAR, t VARCHAR)[]"
    first = f"{{'buf': '', 'n': 0::BIGINT, 'at': begin::BIGINT, 's': NULL::BIGINT, 'e': NULL::BIGINT, 'w': '', 'o': {empty}}}"
    step = f"{{'buf': CASE WHEN {full} THEN '' ELSE {buf} END, 'n': CASE WHEN {full} THEN 0 ELSE a.n + length({line}) END, 'at': CASE WHEN {full} THEN q.e ELSE {at} END, 's': NULL::BIGINT, 'e': NULL::BIGINT, 'w': CASE WHEN {full} THEN '' ELSE q.w END, 'o': CASE WHEN {full} THEN list_append(a.o, {{'l': {stamp(at)}, 't': {buf}}}) ELSE a.o END}}"
    return f"""WITH u AS (SELECT conv_id, list({{'buf': text, 'n': 0::BIGINT, 'at': NULL::BIGINT, 's': turn * 30000, 'e': turn * 30000 + 30000, 'w': role, 'o': {empty}}} ORDER BY turn) FILTER ({duck.strip('text')} <> '') AS l, min(turn) * 30000 AS begin FROM conversations GROUP BY conv_id),
      r AS (SELECT conv_id, list_reduce(list_concat([{first}], l), lambda a, q: {step}) AS r FROM u),
      o AS (SELECT conv_id, CASE WHEN r.buf <> '' THEN list_append(r.o, {{'l': {stamp('r.at')}, 't': r.buf}}) ELSE r.o END AS o FROM r)
      SELECT conv_id, generate_subscripts(o, 1) - 1 AS seq, unnest(list_transform(o, lambda x: x.l)) AS locator, unnest(list_transform(o, lambda x: x.t)) AS text FROM o"""


@query(_segments_sql())
def utterance_segments(spark, sf_dir):
    u = F.struct((F.col("turn") * 30000).alias("start"), (F.col("turn") * 30000 + 30000).alias("end"), "text", F.col("role").alias("speaker"))
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", u.alias("u")))), lambda x: x["u"]).alias("utterances"), F.lit("").alias("text"))
    return ingest.segments(turns).withColumn("seq", F.col("seq").cast("bigint"))


#: Four events a job: some come twice, some before their submission, some jobs end twice and some never; places are not in the order of arrival.
_JOB = "CAST(floor(event_id / 4) AS BIGINT)"
_END = f"CASE WHEN {_JOB} % 5 = 0 THEN 'submitted' WHEN {_JOB} % 7 = 3 THEN 'failed' ELSE 'done' END"
_EVENTS = [
    f"'studip:src' || ({_JOB} % 20) AS course_ref",
    f"{_JOB} AS job_id",
    f"CASE WHEN {_JOB} % 2 = 0 THEN 'scan' ELSE 'transcription' END AS kind",
    f"CASE event_id % 4 WHEN 0 THEN 'submitted' WHEN 2 THEN 'submitted' WHEN 3 THEN {_END} ELSE CASE WHEN {_JOB} % 11 = 4 THEN 'failed' ELSE {_END} END END AS event",
    "event_id * 7919 % 1000003 AS ord",
    f"'t' || ({_JOB} % 30) AS title",
    "'boom ' || event_id AS error",
]
_STATES = f"""e AS (SELECT {', '.join(_EVENTS)} FROM events),
  states AS (SELECT course_ref, job_id, min(kind) AS kind, min(title) AS title, min(ord) FILTER (event = 'submitted') AS first, bool_or(event = 'submitted') AS submitted,
                    arg_min(event, (ord, event)) FILTER (event IN ('done', 'failed')) AS ended, arg_min(error, (ord, event)) FILTER (event IN ('done', 'failed')) AS error, min(ord) FILTER (event IN ('done', 'failed')) AS placed
             FROM e GROUP BY course_ref, job_id)"""
_COUNTERS = f"WITH {_STATES} SELECT course_ref, count(*) FILTER (submitted AND ended IS NULL) AS pending, count(*) FILTER (ended = 'done') AS done, count(*) FILTER (ended = 'failed') AS failed FROM states GROUP BY course_ref"


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*_EVENTS)


@query(_COUNTERS)
def job_counters(spark, sf_dir):
    return ingest.job_counters(_events(spark, sf_dir))


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = jobs.read_events(spark, f"{sf_dir}/events.parquet", schema) if folder else jobs.read_events(spark, sf_dir, schema, "events.parquet")
    return stream.selectExpr(*_EVENTS)


@query(_COUNTERS)
def job_counters_stream(spark, sf_dir):
    return jobs.run_counters(_event_stream(spark, sf_dir), scratch(spark, "counters-checkpoint"), scratch(spark, "counters"))


@query(f"WITH {_STATES} SELECT course_ref, job_id, kind, title, ended, error FROM states")
def job_states_stream(spark, sf_dir):
    """Every job as it stands after its events, repeated and late ones among them."""
    states = jobs.run_states(_event_stream(spark, sf_dir), scratch(spark, "states-checkpoint"), scratch(spark, "states"))
    return states.select("course_ref", "job_id", "kind", "title", "ended", "error")


@query(f"""WITH {_STATES}, c AS (SELECT course_ref, count(*) FILTER (kind = 'transcription') AS r, count(*) FILTER (kind = 'scan') AS s FROM states WHERE submitted AND ended IS NULL GROUP BY course_ref)
  SELECT course_ref, r AS recordings, s AS scans, CASE
  WHEN r > 0 AND s > 0 THEN 'Hinweis: ' || r || CASE WHEN r = 1 THEN ' Aufnahme' ELSE ' Aufnahmen' END || ' und ' || s || CASE WHEN s = 1 THEN ' gescannte Datei' ELSE ' gescannte Dateien' END || ' werden noch verarbeitet und stehen für diese Frage noch nicht zur Verfügung.'
  WHEN s > 0 THEN 'Hinweis: ' || s || CASE WHEN s = 1 THEN ' gescannte Datei wird noch gelesen und steht' ELSE ' gescannte Dateien werden noch gelesen und stehen' END || ' für diese Frage noch nicht zur Verfügung.'
  WHEN r > 0 THEN 'Hinweis: ' || r || CASE WHEN r = 1 THEN ' Aufnahme wird noch verarbeitet und steht' ELSE ' Aufnahmen werden noch verarbeitet und stehen' END || ' für diese Frage noch nicht zur Verfügung.'
  ELSE '' END AS note FROM c""")
def job_notes(spark, sf_dir):
    """What each course's readers are told of its jobs that have not ended."""
    pending = ingest.job_states(_events(spark, sf_dir)).filter(F.col("submitted") & F.col("ended").isNull())
    counts = pending.groupBy("course_ref").agg(F.count_if(F.col("kind") == "transcription").alias("recordings"), F.count_if(F.col("kind") == "scan").alias("scans"))
    return counts.withColumn("note", ingest.job_note(F.col("recordings"), F.col("scans")))


# ---- trees and unions

_NODES = ["source AS tree", "doc_id AS id", "CASE WHEN doc_id < 20 THEN NULL WHEN doc_id < 200 THEN doc_id % 20 ELSE doc_id % 20 + 20 * (doc_id % 9 + 1) END AS parent", "CASE WHEN doc_id < 20 THEN 'crs' WHEN doc_id < 200 THEN 'fold' ELSE 'file' END AS type", "'n' || doc_id AS title", "doc_id * 7 % 11 AS position"]
_TREE = f"nodes AS (SELECT {', '.join(_NODES)} FROM documents)"


def _tree(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*_NODES)


@query(f"""WITH RECURSIVE {_TREE}, walk(tree, id, path) AS (
    SELECT tree, id, [lpad(position::VARCHAR, 4, '0') || ':' || id] FROM nodes WHERE parent IS NULL
    UNION ALL SELECT e.tree, e.id, list_append(w.path, lpad(e.position::VARCHAR, 4, '0') || ':' || e.id) FROM nodes e JOIN walk w ON e.tree = w.tree AND e.parent = w.id),
  placed AS (SELECT tree, id, 0 AS late, path FROM walk UNION ALL SELECT n.tree, n.id, 1, [lpad(n.position::VARCHAR, 4, '0') || ':' || n.id] FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.tree = n.tree AND w.id = n.id))
  SELECT tree, id, row_number() OVER (PARTITION BY tree ORDER BY late, path) AS place FROM placed""")
def reading_order(spark, sf_dir):
    return trees.reading_order(_tree(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TREE}, walk(tree, id, type, title, folder, depth) AS (
    SELECT tree, id, type, title, '', 0 FROM nodes WHERE parent IS NULL
    UNION ALL SELECT n.tree, n.id, n.type, n.title, CASE WHEN w.depth = 0 THEN '' WHEN w.folder = '' THEN w.title ELSE w.folder || '/' || w.title END, w.depth + 1
    FROM nodes n JOIN walk w ON n.tree = w.tree AND n.parent = w.id WHERE w.type IN ('fold', 'grp', 'cat', 'crs', 'itgr') AND w.depth <= 8)
  SELECT tree, id, type, title, folder, depth FROM walk""")
def folder_walk(spark, sf_dir):
    return trees.folder_walk(_tree(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN 'Ordner ' || (doc_id % 7) ELSE '' END AS folder FROM documents")
def folder_join(spark, sf_dir):
    folders = spark.range(5).selectExpr("id AS folder_id", "'Ordner ' || id AS name")
    files = read(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 7 AS folder_id")
    return ingest.with_folder(files, folders).select("doc_id", "folder")


@query(f"SELECT 'studip:' || source AS course_ref, 0 AS rank, doc_id AS item, length(text) AS size FROM documents UNION ALL SELECT 'studip:src' || (page_id % 20), 1, page_id, length({_html_sql('html')}) FROM pages")
def source_union(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("studip:"), F.col("source")).alias("course_ref"), F.lit(0).alias("rank"), F.col("doc_id").alias("item"), T.size("text").alias("size"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("studip:src"), (F.col("page_id") % 20).cast("string")).alias("course_ref"), F.lit(1).alias("rank"), F.col("page_id").alias("item"), T.size(T.strip_html("html")).alias("size"))
    return docs.unionByName(pages)


def _requests(spark, sf_dir) -> DataFrame:
    """A request a document: with its text twice, without a course, without documents, with an empty text, with something that is no JSON."""
    i = F.col("doc_id")
    ref = lambda kind: F.concat(F.lit("studip:"), "source", F.lit(f":{kind}:"), i.cast("string"))
    text = F.when(i % 5 == 3, "").otherwise(F.col("text"))
    one = F.struct(ref("wiki").alias("activity_ref"), F.lit("").alias("title"), text.alias("text"))
    other = F.to_json(F.struct(ref("file").alias("activity_ref"), F.lit("B").alias("title"), F.col("text").alias("text"), F.concat(F.lit("S. "), i.cast("string")).alias("locator")))
    documents = F.when(i % 5 == 2, F.lit("[]")).otherwise(F.concat(F.lit("["), F.to_json(one), F.lit(","), other, F.lit("]")))
    course = F.when(i % 5 == 1, "").otherwise(F.concat(F.lit("studip:"), "source"))
    body = F.concat(F.lit('{"course_ref":"'), course, F.lit('","replace":'), (i % 2 == 0).cast("string"), F.lit(',"documents":'), documents, F.lit("}"))
    return ingest.requests(dealt(read(spark, sf_dir, "documents")).select("doc_id", F.when(i % 5 == 4, F.substr(body, F.lit(2))).otherwise(body).alias("body")))


@query("""SELECT 'studip:' || source AS course_ref, doc_id % 2 = 0 AS replace, unnest(['untitled', 'B']) AS title, text, unnest(['', 'S. ' || doc_id]) AS locator FROM documents WHERE doc_id % 5 = 0 AND coalesce(text, '') <> ''""")
def index_request_json(spark, sf_dir):
    return _requests(spark, sf_dir).filter("error IS NULL").select("course_ref", "replace", "title", "text", "locator")


@query("""SELECT CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 <> 4 THEN 'studip:' || source END AS course_ref, CASE WHEN doc_id % 5 IN (1, 4) THEN 'course_ref is required' WHEN doc_id % 5 = 2 THEN 'documents are required' ELSE 'text is required' END AS error
  FROM documents WHERE doc_id % 5 <> 0 OR coalesce(text, '') = ''""")
def requests_invalid(spark, sf_dir):
    return _requests(spark, sf_dir).filter("error IS NOT NULL").select("course_ref", "error")


# ---- the stored index


def _stored(spark, sf_dir, label: str) -> IndexStore:
    """An index of its own, for a query that changes it."""
    store = IndexStore(spark, scratch(spark, label))
    store.copy(stored(spark, sf_dir))
    return store


_COUNTS = "SELECT course_ref, count(*) AS chunks FROM"


@query(f"WITH {duck.CHANGED_CHUNKS} {_COUNTS} chunks WHERE course_ref <> 'studip:src2' GROUP BY course_ref")
def replace_course(spark, sf_dir):
    """A course with other texts takes the place of what it was; one named without texts is gone."""
    store = _stored(spark, sf_dir, "replace")
    own = corpus(spark, sf_dir).filter("course_ref = 'studip:src1'").withColumn("text", F.concat("text", F.lit(chr(10) * 2), T.capitals("text")))
    store.replace(lexical.chunked(own), ["studip:src1", "studip:src2"])
    return store.read().groupBy("course_ref").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {duck.CHUNKS} SELECT course_ref, count(*) AS chunks, max(o) AS last FROM (SELECT course_ref, chunk_ord AS o FROM chunks UNION ALL SELECT course_ref, chunk_ord + (SELECT max(chunk_ord) + 1 FROM chunks c WHERE c.course_ref = 'studip:src2') FROM chunks WHERE course_ref = 'studip:src2') GROUP BY course_ref")
def append_course(spark, sf_dir):
    store = _stored(spark, sf_dir, "append")
    late = stored(spark, sf_dir).read().filter("course_ref = 'studip:src2'")
    store.append(late, batch="one")
    store.append(late, batch="one")  # a batch that is tried again
    return store.read().groupBy("course_ref").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_ord").alias("last"))


@query(f"WITH {duck.TOKENED} {_COUNTS} tokened WHERE course_ref <> 'studip:src3' AND len(tokens) > 0 GROUP BY course_ref")
def forget_course(spark, sf_dir):
    """What a search index still holds of each course once two are gone, one of them with an odd name."""
    store = _stored(spark, sf_dir, "forget")
    store.append(stored(spark, sf_dir).read().filter("course_ref = 'studip:src4'").withColumn("course_ref", F.lit("studip:HPC Kurs/ü+%")))
    store.forget("studip:src3")
    store.forget("studip:HPC Kurs/ü+%")
    return store.searched()


@query(f"WITH {duck.CHUNKS} SELECT course_ref, 2 * count(*) AS chunks FROM chunks GROUP BY course_ref")
def late_append_stream(spark, sf_dir):
    store = _stored(spark, sf_dir, "late")
    late = spark.readStream.schema(INDEX).parquet(stored(spark, sf_dir).path + "/index").filter("kind = 'chunk'").withColumnRenamed("place", "chunk_ord")
    jobs.append_late(late, store, scratch(spark, "late-checkpoint"))
    return store.read().groupBy("course_ref").agg(F.count(F.lit(1)).alias("chunks"))
