import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import links
from scriptorium.functions import text as T
from scriptorium.operators import catalog, ingest, lexical
from scriptorium.plans.index_store import IndexStore
from scriptorium.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "terms"), [("E-Klausuren", ["klausuren", "klausur"]), ("KI-Kompetenzen", ["ki", "kompetenzen", "kompetenz"]), ("Lehrendenbefragung", ["lehrendenbefragung", "lehrenden", "lehrend", "befragung"]), ("Welche gibt es 2024", [])])
def test_tokens(spark, text, terms):
    assert col(spark, text, T.tokens) == terms


@pytest.mark.parametrize(("text", "lengths"), [("x" * 1000, [900, 250]), ("x" * 1600, [900, 850, 100]), ("\n\n".join("x" * n for n in (500, 500, 300)), [500, 802]), ("\n\n".join("x" * n for n in (10, 901, 5)), [10, 900, 151, 5]), ("   ", [3]), ("", [0])])
def test_chunks(spark, text, lengths):
    assert list(map(len, col(spark, text, T.chunks))) == lengths


def test_doc_id(spark):
    assert col(spark, "studip:hpc:wiki:1", T.doc_id) == "f8b8e21667"


CORPUS = [
    ("studip:w", 0, "studip:w:file:1", "Lehrendenbefragung.pdf", "Die Befragung der Lehrenden zeigt Ergebnisse zur Lehre."),
    ("studip:w", 1, "studip:w:file:2", "Skript.pdf", "Monaden und Funktoren in der Kategorientheorie."),
    *[("studip:big", i, f"studip:big:file:{i}", "Handreichung.pdf", f"Diese Seite {i} nennt Erfahrungen und allgemeine Hinweise.") for i in range(12)],
]


def ask(spark, course, text, documents=None):
    corpus = spark.createDataFrame(CORPUS, "course_ref string, ord long, activity_ref string, title string, text string")
    corpus = corpus.selectExpr("*", "'' AS locator", "'' AS folder", "'' AS course_name", "'' AS licence")
    asked = spark.createDataFrame([(1, course, text, 4, documents)], "query_id int, course_ref string, text string, k int, documents array<string>")
    return lexical.search_corpus(corpus, asked).orderBy("rank").collect()


def test_search(spark):
    hits = ask(spark, "studip:w", "Was kam bei der Lehrendenbefragung heraus?")
    assert [h.title for h in hits] == ["Lehrendenbefragung.pdf"]
    assert ask(spark, "studip:w", "Studiengebühren Bafög") == []
    assert ask(spark, "studip:none", "Monaden") == []
    assert ask(spark, "studip:big", "Welche Erfahrungen gibt es mit Segelbooten?") == []


def test_cited(spark):
    for answer, numbers, shown in (("[2] und [4]", [2, 4], "[1] und [2]"), ("nur [4]", [4], "nur [1]"), ("[9]", [], "[9]"), ("［ 3 ］", [3], "[1]")):
        row = spark.createDataFrame([(answer,)], "a string").withColumn("c", T.cited("a", F.lit(4))).select("c", T.renumbered("a", F.col("c")).alias("s")).first()
        assert (row.c, row.s) == (numbers, shown)


def test_links(spark):
    link = lambda ref, loc="": spark.createDataFrame([(ref, loc)], "r string, l string").select(links.lms_link(F.col("r"), F.col("l"), studip="https://s", moodle="https://m", ilias="https://i", client="c").alias("x")).first().x
    assert link("moodle:5:file:23:resource:A.pdf", "S. 12") == "https://m/mod/resource/view.php?id=23&redirect=1#page=12"
    assert link("studip:abc:courseware:273929:13775") == "https://s/dispatch.php/course/courseware/courseware/13775?cid=abc#/structural_element/273929"
    assert link("plain") == ""


def test_segments(spark):
    u = [{"start": i * 1000, "end": i * 1000 + 1000, "text": "Ja, genau.", "speaker": None} for i in range(20)]
    schema = "id int, utterances array<struct<start:bigint,end:bigint,text:string,speaker:string>>, text string"
    assert ingest.segments(spark.createDataFrame([(1, u, "")], schema)).count() == 1
    assert [(r.locator, r.text) for r in ingest.segments(spark.createDataFrame([(1, [], "Nur Text.")], schema)).collect()] == [("", "Nur Text.")]


def test_allowlist(spark):
    with pytest.raises(Exception, match="malformed"):
        catalog.parse_allowlist(spark.createDataFrame([("student1=",)], "text string")).collect()
    rows = spark.createDataFrame([("a",)], "course_ref string")
    assert catalog.visible(rows, "allowlist").count() == 0


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.read().count() == 0
    chunk = spark.createDataFrame([("a", "t", "", "", "", "", "x", 0, c) for c in ("studip:1", "studip:2")], "activity_ref string, title string, locator string, course_name string, folder string, licence string, text string, chunk_ord bigint, course_ref string")
    store.replace(chunk)
    store.append(chunk.filter("course_ref = 'studip:1'"))
    assert sorted((r.course_ref, r.chunk_ord) for r in store.read().collect()) == [("studip:1", 0), ("studip:1", 1), ("studip:2", 0)]
    assert store.forget("studip:1") == 2
    assert store.forget("nothing") == 0
    assert store.read().count() == 1


@pytest.mark.parametrize("name", ["chunk_documents", "lexical_search_batch", "lexical_doc_filter", "vector_floor_batch", "course_names", "reading_order", "utterance_segments", "strip_html_pages", "job_counters_stream", "late_append_stream"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = lambda it: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in it)
    assert rows(got.select(*columns).collect()) == rows(con.sql(ORACLE_SQL[name]).select(", ".join(columns)).fetchall())
