import io
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import access, catalog, ingest, lexical, providers
from scriptorium.plans.index_store import IndexStore
from scriptorium.queries.sources import _office
from scriptorium.sources import files, lms, office, pdf

CHUNK = "activity_ref string, title string, locator string, course_name string, folder string, licence string, text string, chunk_ord long, course_ref string"


def made_pdf(*streams, head=b""):
    return b"%PDF-1.4\n" + head + b"".join(b"%d 0 obj\n<< /Length 1 >>\nstream\n%s\nendstream\nendobj\n" % (i, s) for i, s in enumerate(streams, 1))


@pytest.mark.parametrize(
    ("stream", "text"),
    [
        (b"(Hallo) Tj (Welt) Tj", "HalloWelt"),
        (rb"(a \(b\) \\ \101\12) Tj", "a (b) \\ A"),
        (b"[(Mo) -250 (na) 20 (den)] TJ", "Mo naden"),
        (b"[(x] y) -300 (z)] TJ", "x] y z"),
        (b"(Gr\xf6\xdfe) Tj", "Größe"),
        (b"(Gr\x9a\x8ae) Tj (\x81) Tj", "GršŠeÅ"),
        (b"(\xfe\xff\x00A\x20\x14) Tj", "A—"),
        (b"(a\n\n\n\nb  \t c) Tj % (no) Tj\n(d) Tj", "a\n\nb cd"),
        (b"<48616c6c6f> Tj /F1 12 Tf (x) Tj", "x"),
    ],
)
def test_pdf_strings(stream, text):
    assert pdf.shown(stream) == text


def test_pdf_pages():
    flat = b"2 0 obj <</Filter /FlateDecode>> stream\r\n" + zlib.compress(b"(zwei) Tj") + b"\rendstream endobj "
    image = b"3 0 obj <</Subtype /Image>> stream\n(kein) Tj\nendstream endobj "
    other = b"4 0 obj <</Filter /LZWDecode>> stream\n(kein) Tj\nendstream endobj "
    assert pdf.pages(made_pdf(b"(eins) Tj", b"( ) Tj") + flat + image + other, "builtin") == (["eins", "", "zwei"], "builtin")
    assert pdf.pages(made_pdf(b"(Gr\x9a\xa7e) Tj", head=b"/Encoding /MacRomanEncoding "), "builtin")[0] == ["Größe"]
    for data, why in ((b"x", "not a PDF"), (b"%PDF-1.4", "no readable"), (made_pdf(b"q Q"), "no readable")):
        with pytest.raises(pdf.Unreadable, match=why):
            pdf.pages(data, "builtin")
    with pytest.raises(pdf.Unreadable, match="not installed"):
        pdf.pages(made_pdf(b"(x) Tj"), "poppler", binary="no-such-tool")


def test_poppler(tmp_path):
    tool = tmp_path / "tool"
    for script, found in (("printf 'eins\\f\\fdrei\\f'", ["eins", "", "drei"]), ("printf '\\f'", pdf.Scanned), ("exit 3", pdf.Unreadable)):
        tool.write_text(f"#!/bin/sh\n{script}\n")
        tool.chmod(0o755)
        if isinstance(found, list):
            assert pdf.pages(b"%PDF-1.4", "auto", str(tool)) == (found, "poppler")
        else:
            with pytest.raises(found):
                pdf.pages(b"%PDF-1.4", "auto", str(tool))
    assert pdf.pages(made_pdf(b"(x) Tj"), "auto", str(tool)) == (["x"], "builtin")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes_are_read_or_refused(data):
    for raw in (data, b"%PDF" + data, b"PK\x03\x04" + data, made_pdf(data)):
        found, _, error = files.read_units(raw, "builtin")
        assert (error is None) == bool(found)


def test_office():
    assert office.units(_office("pptx", "Eins\nZwei")) == ([("Folie 1", "Eins Zwei \n\nNotizen: gesagt"), ("Folie 2", "Eins Zwei")], "pptx")
    assert office.units(_office("docx", "a\n\nb")) == ([("", "a\n\nb")], "docx")
    assert office.units(_office("xlsx", "Name\nNote")) == ([("Noten", "Name Note Ende")], "xlsx")
    assert office.units(_office("odp", "a\nb")) == ([("Folie 1", "ab"), ("Folie 2", "")], "odp")
    assert office.units(_office("ods", "a\nb")) == ([("Blatt", "a b")], "ods")
    assert office.units(_office("odt", "a\nb")) == ([("", "a\n\nb")], "odt")
    for data, why in ((_office("docx", ""), "no extractable text"), (office.OLD_OFFICE, "legacy"), (b"PK\x03\x04", "not an Office")):
        with pytest.raises(pdf.Unreadable, match=why):
            office.units(data)


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return out.getvalue()


def points(*links: tuple[str, str, str]) -> str:
    return "<Relationships xmlns='r'>" + "".join(f"<Relationship Id='{i}' Type='http://x/{role}' Target='{to}'/>" for i, role, to in links) + "</Relationships>"


def test_office_parts_are_those_declared():
    main = "application/vnd.openxmlformats-officedocument.{}.main+xml"
    types = lambda part, type_: f"<Types xmlns='t'><Override PartName='/{part}' ContentType='{main.format(type_)}'/></Types>"
    sheet = lambda x: f"<worksheet xmlns='x'><c t='s'><v>{x}</v></c><c t='s'><v>9</v></c><c><v>4,5</v></c></worksheet>"
    book = packed({
        "[Content_Types].xml": types("mappe/buch.xml", "spreadsheetml.sheet"),
        "mappe/buch.xml": "<workbook xmlns='x' xmlns:r='rel'><sheets><sheet name='Zweites' r:id='b'/><sheet name='Erstes' r:id='a'/></sheets></workbook>",
        "mappe/_rels/buch.xml.rels": points(("a", "worksheet", "worksheets/sheet1.xml"), ("b", "worksheet", "/mappe/worksheets/sheet2.xml"), ("s", "sharedStrings", "texte.xml")),
        "mappe/texte.xml": "<sst xmlns='x'><si><t>eins</t></si><si><r><t>zw</t></r><r><t>ei</t></r></si></sst>",
        "mappe/worksheets/sheet1.xml": sheet(0),
        "mappe/worksheets/sheet2.xml": sheet(1),
        "mappe/worksheets/sheet3.xml": sheet(0),
    })
    assert office.units(book) == ([("Zweites", "zwei 4,5"), ("Erstes", "eins 4,5"), ("Tabelle 3", "eins 4,5")], "xlsx")
    slide = lambda x: f"<p:sld xmlns:p='p' xmlns:a='a'><a:t>{x}</a:t></p:sld>"
    show = packed({
        "[Content_Types].xml": types("ppt/presentation.xml", "presentationml.slideshow"),
        "ppt/presentation.xml": "<a/>",
        "ppt/slides/slide1.xml": slide("A"),
        "ppt/slides/slide3.xml": slide("B"),
        "ppt/slides/_rels/slide3.xml.rels": points(("n", "notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/slides/_rels/slide1.xml.rels": points(("n", "notesSlide", "../notesSlides/notesSlide7.xml")),
        "ppt/notesSlides/notesSlide1.xml": slide("zu B"),
        "ppt/notesSlides/notesSlide7.xml": slide(" 1 "),
    })
    assert office.units(show) == ([("Folie 1", "A"), ("Folie 2", "B\n\nNotizen: zu B")], "pptx")
    for parts, why in (({"word/document.xml": "<a"}, "could not read the docx"), ({"[Content_Types].xml": "<a"}, "not an Office"), ({"mimetype": "application/vnd.oasis.opendocument.text"}, "no extractable text")):
        with pytest.raises(pdf.Unreadable, match=why):
            office.units(packed(parts))


def test_units_and_scans(spark):
    rows = [("a", made_pdf(b"(Eine Seite mit viel Text) Tj", b"(kurz) Tj")), ("b", None), ("c", _office("docx", "Ein Absatz mit Text"))]
    units = files.extract_units(spark.createDataFrame(rows, "path string, content binary"), engine="builtin")
    assert [(r.path, r.locator) for r in files.unit_documents(units).orderBy("path").collect()] == [("a", "S. 1"), ("c", "")]
    assert [tuple(r) for r in files.scans(units).collect()] == [("a", [2])]
    assert [r.path for r in units.filter("error IS NOT NULL").collect()] == ["b"]
    assert files.extract_units(spark.createDataFrame([], "content binary")).count() == 0


def test_entities_and_snippets(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f("x").alias("y")).first().y
    assert one("a&#228;&#x2014;&eacute;&nbsp&copy2 R&D; &#0;&#128;", T.entities) == "aä—é\xa0©2 R&D; �€"
    assert one("<p>a&amp;lt;</p>", T.strip_html) == "a&lt;"
    assert one(", und " + "wort " * 80, T.snippet).startswith("… , und wort") and one("x " * 300, T.snippet).endswith("x …")
    assert one("<THINK>\nx</think> ```md\na\nb\n```", T.clean_ocr) == "a\nb"
    assert one(":x", T.namespace) == "" and one("x", T.namespace) == "unknown"


def test_segments_start_where_they_start(spark):
    schema = "id int, utterances array<struct<start:bigint,end:bigint,text:string,speaker:string>>, text string"
    said = [{"start": 5000, "end": 6000, "text": " ", "speaker": None}, {"start": 60000, "end": 70000, "text": "Ja.", "speaker": "A"}]
    assert [tuple(r)[2:] for r in ingest.segments(spark.createDataFrame([(1, said, "")], schema)).collect()] == [("0:05", "A: Ja.")]
    assert ingest.segments(spark.createDataFrame([(1, said[:1], "Text")], schema)).count() == 0


def test_floors(spark):
    rows = [("moodle", "wiki", "x"), ("moodle", "description", " "), ("studip", "wiki", "x" * 39), ("studip", "wiki", "x" * 40), ("ilias", "file", "x" * 15)]
    kept = ingest.long_enough(spark.createDataFrame(rows, "platform string, kind string, text string")).collect()
    assert [tuple(r) for r in kept] == [rows[0], rows[3], rows[4]]


@pytest.mark.parametrize("course", ["studip:HPC Kurs", "studip:ü", "studip:a+b", "moodle:5", "a/b%c=d", ""])
def test_forget_any_name(spark, tmp_path, course):
    store = IndexStore(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([("a", "t", "", "", "", "", "Monaden und Funktoren", i, c) for i in range(2) for c in (course, "studip:other")], CHUNK)
    store.replace(rows)
    assert store.forget(course) == 2 and store.forget(course) == 0
    assert {r.course_ref for r in store.read().collect()} == {r.course_ref for r in store.postings().collect()} == {"studip:other"}


def test_store_searches_what_it_keeps(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    for _ in range(2):  # the second takes its own place
        store.append(spark.createDataFrame([("a", "t", "S. 1", "", "", "", "Monaden sind schwer", 0, "c:1")], CHUNK), batch="b")
    asked = spark.createDataFrame([(1, "c:1", "Was sind Monaden?", 4)], "query_id int, course_ref string, text string, k int")
    assert [(r.title, r.chunk_ord) for r in store.search(asked).collect()] == [("t", 0)]
    store.replace(store.read().limit(0), ["c:1"])
    assert store.read().count() == 0 and store.search(asked).count() == 0


class _Server(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(404 if "missing" in self.path else 200)
        self.end_headers()
        self.wfile.write(f"{self.path} {self.headers.get('Accept')} {self.headers.get('Authorization')}".encode())

    def do_POST(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(self.rfile.read(int(self.headers["Content-Length"])))

    def log_message(self, *_):
        pass


def test_fetched(spark):
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    asked = spark.createDataFrame([("/a", None), ("/missing", None), ("/post", lms.soap_envelope("login", [("user", "a&b")]))], "route string, data string")
    got = {r.route: (r.status, r.body) for r in lms.fetched(asked, f"http://127.0.0.1:{server.server_port}/", lms.authorization("t")).collect()}
    server.shutdown()
    assert got["/a"] == (200, "/a None Bearer t") and got["/missing"][0] == 404
    assert "<user>a&amp;b</user>" in got["/post"][1]
    assert lms.fetched(asked.limit(1), "http://127.0.0.1:9").first().status == 599
    assert lms.authorization(user="u", password="p") == {"Authorization": "Basic dTpw"}
    with pytest.raises(ValueError, match="token"):
        lms.authorization()


def test_settings_and_course_file(spark, tmp_path):
    assert lms.read_settings("# x\nA=1\nA=2\n B = 'c d' \n\nnothing\n") == {"A": "1", "B": "c d"}
    (tmp_path / "c.json").write_text('{"course_ref":"c:1",\n"documents":[{"activity_ref":"c:1:file:1","title":"T","text":"x","folder":"f","course_name":"C","licence":"L"}]}')
    row = ingest.requests(lms.read_course(spark, str(tmp_path))).first()
    assert (row.course_ref, row.title, row.folder, row.course_name, row.licence) == ("c:1", "T", "f", "C", "L")


def test_rules_and_failed_sources(spark):
    rows = [("/courses/a/kitoolbox-rules", 200, '{"data":[{"attributes":{"x":1}},{"attributes":{"x":2}}]}'), ("/courses/b/kitoolbox-rules", 404, "")]
    found = lms.studip_rules(spark.createDataFrame(rows, "route string, status int, body string")).orderBy("n").collect()
    assert [(r.course, r.rule) for r in found] == [("a", '{"x":1}'), ("a", '{"x":2}')]
    assert spark.createDataFrame([('{"exception":"e","message":"m"}',), ("[]",)], "b string").select(lms.moodle_error(F.col("b")).alias("e")).collect()[0].e == "m"


def test_provider_slots(spark, tmp_path):
    null, _ = providers.retrieval(spark, "none", str(tmp_path))
    assert null.search(None).count() == 0 and null.courses().count() == 0
    with pytest.raises(RuntimeError, match="no retrieval"):
        null.index(None)
    with pytest.raises(NotImplementedError):
        providers.retrieval(spark, "external", "")[0].search(None)
    request = providers.image_request(b"x", "image/png", model="m", mode="vision")
    assert [c["type"] for c in request["messages"][0]["content"]] == ["text", "image_url"] and request["temperature"] == 0
    assert providers.image_request(b"x", "image/png", model="m", mode="ocr")["temperature"] == 0.2
    assert providers.pdf_counts("Title: x\nPages:   12\n", "page num\n-----\n  2 0 image\n  4 1 image\n") == (12, [2, 4])
    pages = spark.createDataFrame([("a", bytearray(b"1"), "image/png"), ("b", bytearray(b"2"), "image/png")], "key string, image binary, mime string")

    def reader(image, mime):
        if image == b"2":
            raise OSError("gateway")
        return "```\ntext\n```"

    assert sorted(map(tuple, providers.read_pages(pages, reader).collect())) == [("a", "text", None), ("b", None, "gateway")]
    assert sorted(r.error or r.body for r in providers.transcribed(pages.select(F.col("key").alias("activity_ref"), F.col("key").alias("title"), F.col("image").alias("content")), lambda data, name: reader(data, name)).collect()) == ["```\ntext\n```", "b: gateway"]
    asked = spark.createDataFrame([(1, "c:1", "Frage"), (2, "", "Frei")], "query_id int, course_ref string, text string")
    hits = spark.createDataFrame([], "query_id int, rank int, title string, locator string, text string")
    said = {r.query_id: r.answer for r in providers.completed(asked, hits, lambda ms: f"{len(ms)}{ms[0]['role']}").collect()}
    assert said == {1: "2system", 2: "1user"}


def test_waiting_and_trying():
    states = iter([{"status": "queued"}, {"status": "running"}, {"status": "done", "text": "x"}])
    assert providers.waited_for(lambda: next(states), 1, pause=lambda s: None)["text"] == "x"
    with pytest.raises(RuntimeError, match="no words"):
        providers.waited_for(lambda: {"status": "failed", "error": "no words"}, 1)
    clock = iter([0, 1, 99999])
    with pytest.raises(RuntimeError, match="no transcript after"):
        providers.waited_for(lambda: {"status": "running"}, 1, pause=lambda s: None, clock=lambda: next(clock))
    assert providers.longest_wait(100_000_000) == 6000 and providers.longest_wait(5) == 1800
    calls, waits = iter([OSError("a"), OSError("b"), {"ok": 1}]), []

    def call():
        got = next(calls)
        if isinstance(got, Exception):
            raise got
        return got

    assert providers.tried(call, pause=waits.append) == {"ok": 1} and waits == [5.0, 20.0]
    with pytest.raises(HTTPError):
        providers.tried(lambda: (_ for _ in ()).throw(HTTPError("u", 500, "m", {}, None)))


def test_tools(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    documents = spark.createDataFrame([("c:1", 0, "0", "c:1:wiki:1", "Skript", "", "Monaden und Funktoren", "Kurs", "", ""), ("c:1", 4, "1", "c:1:file:2", "B.pdf", "S. 1", "Ein ganz anderes Thema hier", "Kurs", "f", "")], "course_ref string, rank int, ord string, activity_ref string, title string, locator string, text string, course_name string, folder string, licence string")
    tools = providers.Tools(store)
    assert tools.index_course(documents) == 2
    hits, sure = tools.search_course("c:1", "Was sind Monaden?", documents=["skript"])
    assert [(r.title, r.citation) for r in hits.collect()] == [("Skript", "Skript (Kurs)")] and sure == "low"
    with pytest.raises(LookupError, match="none of the named"):
        tools.search_course("c:1", "x", documents=["other"])
    with pytest.raises(LookupError, match="not indexed"):
        tools.search_course("c:2", "x")
    user = providers.Tools(store, mode="none", username="u")
    with pytest.raises(LookupError):
        user.search_course("c:1", "Monaden")
    with pytest.raises(PermissionError):
        user.forget_course("c:1")
    assert tools.index_course(documents.filter("rank = 4"), ["c:1", "c:9"]) == 1
    assert tools.index_course(documents.filter("course_ref = 'none'"), ["c:1"]) == 0 and store.read().count() == 0
    assert tools.index_course(documents.unionByName(documents)) == 2
    assert tools.forget_course("c:1") == 2


def test_claims_and_names(spark):
    rows = spark.createDataFrame([("a.b",), ("x.e30.y",), ("x.!!.y",), (None,)], "t string")
    assert [r.c for r in rows.select(access.claims(F.col("t")).alias("c")).collect()] == [None, "{}", None, None]
    documents = spark.createDataFrame([("c:1", "d1", "A.pdf", ["S. 1"]), ("c:1", "d2", "B", ["Straße"])], "course_ref string, doc_id string, title string, locators array<string>")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.doc_id for r in catalog.resolve(documents, names(" STRASSE ")).collect()] == ["d2"]
    assert catalog.resolve(documents, names("S. 1")).count() == 0
    odd = spark.createDataFrame([("c:1", f"d{i}", t, ["S. 1"]) for i, t in enumerate(["Σίσυφος", "ﬁnal", "İstanbul", "Große Übung", "Uebung", "résumé", "resume"])], documents.schema)
    for asked, found in (("ΣΊΣΥΦΟΣ", "d0"), ("FINAL", "d1"), ("GROSSE ÜBUNG", "d3"), ("RÉSUMÉ", "d5"), ("Resume", "d6")):
        assert [r.doc_id for r in catalog.resolve(odd, names(asked)).collect()] == [found]
        assert asked.casefold() == odd.filter(F.col("doc_id") == found).first().title.casefold()
    assert catalog.resolve(odd, names("Ubung")).count() == 0


def test_numbers_within_large_courses(spark):
    rows = spark.range(0, 300_000, 7).selectExpr("'c:' || id % 2 AS course_ref", "id AS ord", "id % 5 AS n")
    got = ingest.before_each(rows, "n").filter("ord IN (0, 7, 65534, 65541, 299999, 299992)").collect()
    for r in got:
        assert r.before == sum(i % 5 for i in range(0, r.ord, 7) if f"c:{i % 2}" == r.course_ref)
    assert lexical.chunked(spark.createDataFrame([], "course_ref string, ord long, text string")).count() == 0


def test_pdf_words_and_bombs(monkeypatch):
    packed = zlib.compress(b"(Seite eins) Tj")
    page = lambda n, body, filters="": b"%d 0 obj << /Length %d %s>>\nstream\r\n" % (n, len(body), filters.encode()) + body + b"\nendstream endobj\n"
    data = b"%PDF-1.4\n1 0 obj << /Title (Data streams) >> endobj\n" + page(2, packed, "/Filter /FlateDecode ") + page(3, b"(Seite \\(zwei\\) mit (Klammern) \\344) Tj")
    assert pdf.builtin_pages(data) == ["Seite eins", "Seite (zwei) mit (Klammern) ä"]
    monkeypatch.setattr(pdf, "MOST_INFLATED", 1000)
    with pytest.raises(pdf.Unreadable, match="more than"):
        pdf.builtin_pages(page(1, zlib.compress(b"(a) Tj " * 1000), "/Filter /FlateDecode "))
    monkeypatch.setattr(office, "MOST_INFLATED", 10)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("content.xml", "<x>" + "a" * 100 + "</x>")
    with pytest.raises(pdf.Unreadable, match="more than"):
        office.units(out.getvalue())


def test_ilias_goes_depth_first_and_by_format(spark):
    said = "Eine Beschreibung, die lang genug für ein Dokument dieser Art ist."
    one = lambda i, kind: f'<Object type="{kind}" obj_id="1"><Title>n{i}</Title><Description>{said}</Description><References ref_id="{i}"/></Object>'
    tree = {"86": ["1", "2"], "1": ["3", "4"], "3": ["5"], "2": ["6"]}
    kinds = {"1": "fold", "2": "fold", "3": "fold", "5": "frm", "4": "file", "6": "file"}
    children = lms.ilias_children(spark.createDataFrame([("86", p, "<Objects>" + "".join(one(i, kinds[i]) for i in own) + "</Objects>") for p, own in tree.items()], "tree string, parent string, xml string"))
    courses = spark.createDataFrame([("86", "<Course><MetaData><General><Title>Kurs</Title></General></MetaData></Course>")], "tree string, xml string")
    units = spark.createDataFrame([("86", "4", "a.pdf", "A", 1, "S. 1", "Text der ersten Seite", None), ("86", "6", "b.odt", "B", 1, "", "Text des anderen Formats", None)], "tree string, id string, filename string, name string, unit int, locator string, text string, error string")
    rows = lms.ilias_documents(courses, children, units).orderBy("rank", "ord").collect()
    assert [r.activity_ref.partition(":86:")[2] for r in rows] == ["obj:1", "obj:3", "obj:5", "file:4:a.pdf", "obj:2"]
