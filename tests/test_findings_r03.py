"""What the findings of round 3 named, each on rows that failed before."""

import re
import tracemalloc

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.llm import jaccard_join
from scriptorium.llm.words import unsqueezed
from scriptorium.operators import lexical, trees
from scriptorium.plans.index_store import PART, IndexStore
from scriptorium.queries import ORACLE_SQL
from scriptorium.sources import lms

from .test_whole_job import agree


def test_files_of_moodle_and_studip_are_read(spark):
    assert agree(spark, "moodle_documents", ORACLE_SQL["moodle_documents"])
    responses = spark.createDataFrame(
        [("/courses/c", 200, '{"data":{"attributes":{"title":"Kurs"}}}'), ("/courses/c/file-refs", 200, '{"data":[{"id":"f","attributes":{"name":"a.pdf","mime-type":"application/pdf"}}]}')],
        "route string, status int, body string",
    )
    units = spark.createDataFrame([("c", "f", 1, "S. 1", "words  of a page that is read", None), ("c", "f", 2, "S. 2", "short", None)], "course string, file_id string, unit int, locator string, text string, error string")
    rows = lms.studip_documents(responses, units).collect()
    assert [(r.activity_ref, r.title, r.locator, r.text) for r in rows] == [("studip:c:file:f", "a.pdf", "S. 1", "words of a page that is read")]


def test_pages_to_read_asks_its_own_scans(spark):
    assert agree(spark, "pages_to_read", ORACLE_SQL["pages_to_read"])


def test_siblings_of_one_position_go_by_their_id_as_text(spark):
    rows = [(0, i, None if i == 1 else 1 if i < 5000 else 7, 0) for i in (1, 980, 2960, 11, 5000, 41000)]
    got = trees.reading_order(spark.createDataFrame(rows, "tree long, id long, parent long, position int"))
    assert [r.id for r in got.orderBy("place").collect()] == [1, 11, 2960, 980, 41000, 5000]


def test_capitals_keep_the_number_of_letters(spark):
    got = spark.createDataFrame([("Straße ä ﬁ é\n\nß",), ("",), (None,)], "x string").select(T.capitals("x").alias("y")).collect()
    assert [r.y for r in got] == ["STRAßE Ä ﬁ É\n\nß", "", None]


def test_references_without_a_semicolon_are_resolved_as_html_has_it(spark):
    got = spark.createDataFrame([("<h1>eroninnt&amp</h1><p>a&amp;&amp b</p>",)], "x string").select(T.strip_html("x").alias("y")).first().y
    assert got == "eroninnt& a&& b"  # html.unescape says so too; the SQL of the query only knows the form with a semicolon


def test_a_copied_index_is_its_own_and_terms_are_counted_in_their_row(spark, tmp_path):
    rows = [(f"studip:{c}", f"studip:{c}:file:{n}", "t", "S. 1", "", "", "", n, f"Klausuren klausuren Seite{n} {c} Verwaltungsbefragung" if n % 3 else "2024") for c in "ab" for n in range(5000)]
    corpus = spark.createDataFrame(rows, "course_ref string, activity_ref string, title string, locator string, folder string, course_name string, licence string, ord long, text string")
    chunks = lexical.chunked(corpus)
    store, own = IndexStore(spark, str(tmp_path / "one")), IndexStore(spark, str(tmp_path / "two"))
    store.replace(chunks)
    lexical.postings, real = None, lexical.postings  # a copy makes no terms
    try:
        own.copy(store)
    finally:
        lexical.postings = real
    for part in ("read", "postings", "sizes", "document_frequency", "searched"):
        a, b = getattr(store, part)(), getattr(own, part)()
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), part
    tokens = chunks.select("course_ref", "chunk_ord", F.explode(T.tokens("text")).alias("term"))
    want = tokens.groupBy("course_ref", "chunk_ord", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("len", F.sum("tf").over(Window.partitionBy("course_ref", "chunk_ord")))
    assert want.exceptAll(own.postings().select(*want.columns)).isEmpty()
    assert {(r.course_ref, r.chunks) for r in own.searched().collect()} == {("studip:a", 3333), ("studip:b", 3333)}
    own.forget("studip:a")
    assert {r.course_ref for r in store.sizes().collect()} == {"studip:a", "studip:b"}
    files = [f for f in (tmp_path / "one" / "index").rglob("*.parquet")]
    terms = {r.f: r.n for r in store.rows("term").groupBy(F.input_file_name().alias("f")).agg(F.count_distinct(F.floor(F.col("block") * lexical.BLOCK / PART)).alias("n")).collect()}
    assert len(files) >= len(terms) >= 4 and set(terms.values()) == {1}  # a file and a task hold one part of a course


def test_texts_are_packed_and_dealt_once(spark, tmp_path, monkeypatch):
    def scans(df):
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return plan.count("FileScan parquet"), rows

    rows = [(c, f"{c}:{n}", "t", "S. 1", "", "", "", n, "\n\n".join(["Wort " * 100] * ((n or 1) % 4))) for c in ("a", "", None) for n in [*range(40), 1 << 14, None]]
    spark.createDataFrame(rows, "course_ref string, activity_ref string, title string, locator string, folder string, course_name string, licence string, ord long, text string").write.parquet(str(tmp_path / "corpus"))
    chunks = lexical.chunked(spark.read.parquet(str(tmp_path / "corpus")))
    read, got = scans(chunks)
    assert read == 1
    for c in ("a", "", None):
        own = sorted((r for r in got if r.course_ref == c), key=lambda r: r.chunk_ord)
        assert [r.chunk_ord for r in own] == list(range(len(own))) and own[-1].ord is None and own[-2].ord == 1 << 14
        assert [(r.ord, r.pos) for r in own[:-1]] == sorted((r.ord, r.pos) for r in own[:-1])
    written = []
    real = IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, rows: (written.append(scans(rows)[0]), real(self, rows)))
    IndexStore(spark, str(tmp_path / "one")).replace(chunks.filter("course_ref IS NULL OR course_ref = 'a'"))
    assert written == [1]


def test_numbering_deals_no_texts(spark, tmp_path):
    rows = [(c, f"{c}:{n}", "t", "S. 1", "", "", "", n, f"Wort {n}") for c in ("a", "b") for n in range(9)]
    chunks = lexical.chunked(spark.createDataFrame(rows, "course_ref string, activity_ref string, title string, locator string, folder string, course_name string, licence string, ord long, text string"))
    store = IndexStore(spark, str(tmp_path / "one"))
    store.replace(chunks)
    store.append(chunks, "late")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.read()._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.course_ref, r.chunk_ord, r.text) for r in store.read().collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan
    assert got == [(c, n, f"Wort {n % 9}") for c in ("a", "b") for n in range(18)]


def test_a_task_counts_tokens_in_a_byte_a_counter():
    rng = np.random.default_rng(1)
    batches = [rng.integers(0, 1 << 63, 100_000, np.uint64) for _ in range(30)] + [np.full(300, 5, np.uint64)] * 2
    tracemalloc.start()
    try:
        counters = jaccard_join.Counters(21)
        for b in batches:
            counters.add(b)
        pieces = list(counters.pieces())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20  # lists of (counter, count) took some 130 MB here
    want = np.minimum(np.bincount(np.concatenate([b >> np.uint64(43) for b in batches]).astype(np.int64), minlength=1 << 21), 255)
    got = np.zeros(1 << 21, np.int64)
    for i, raw in pieces:
        keys, many = unsqueezed(raw)
        assert set((keys >> np.uint64(15)).tolist()) == {i}
        got[keys.astype(np.int64)] = many
    assert (got == want).all()


def test_numbering_and_scoring_are_dealt_by_size(spark, tmp_path, monkeypatch):
    rows = [(f"{c}", f"{c}:{n}", "t", "S. 1", "", "", "", 5000 * n, f"Wort Seite{n % 7}x Kapitel{n % 11}y") for c in "ab" for n in range(300)]
    spark.createDataFrame(rows, "course_ref string, activity_ref string, title string, locator string, folder string, course_name string, licence string, ord long, text string").write.parquet(str(tmp_path / "corpus"))
    corpus = spark.read.parquet(str(tmp_path / "corpus"))
    asked = spark.createDataFrame([(1, "a", "Seite3x Wort", 4), (2, "b", "Kapitel2y Seite1x", 6)], "query_id long, course_ref string, text string, k int")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(many_blocks):
        chunks = lexical.chunked(corpus)
        hits = lexical.search(lexical.searchable(chunks), asked, many_blocks=many_blocks)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (chunks, hits)]
        most = [max(map(int, re.findall(rf"hashpartitioning\({key}#[^()]*?, (\d+)\)", p))) for key, p in zip(("_of", "query_id"), plans, strict=True)]
        return sorted(chunks.collect()), sorted(hits.collect()), most

    few = run(1 << 30)
    monkeypatch.setattr(lexical, "TASK_BYTES", max(1, lexical._planned_bytes(corpus) // (partitions + 5)))
    monkeypatch.setattr(lexical, "TASK_BLOCKS", 1)
    for many in (run(1 << 30), run(0)):
        assert many[:2] == few[:2] and few[1]
        assert min(many[2]) > partitions
    assert max(few[2]) == partitions
