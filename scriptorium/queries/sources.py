"""Registered queries over files and platforms: their input is made of the tables, their SQL asks the tables themselves."""

from __future__ import annotations

import base64
import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as T
from ..operators import access, attachments, catalog, ingest, providers, vector
from ..plans.index_store import IndexStore
from ..plans.scratch import kept
from ..sources import files, lms, office
from . import duck
from .course import _EVENTS, _STATES, _html_sql, chunks, dealt, query, read, scratch, stored

# ---- files

#: What one byte a letter can say, less the letters whose capital it cannot.
_LATIN = r"[^\x20-\x7E\nÀ-ÖØ-Þà-öø-þ]"
_BEYOND = f"'{_LATIN}'"
_PLAIN = f"regexp_replace(coalesce(text, ''), {_BEYOND}, '', 'g')"
_TIDY = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {duck.LIT(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def _plain(spark, sf_dir) -> DataFrame:
    return dealt(read(spark, sf_dir, "documents")).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), _LATIN, "").alias("text"))


@query(f"WITH d AS (SELECT doc_id, {_PLAIN} AS t FROM documents) SELECT doc_id, 1 AS unit, 'S. 1' AS locator, {_TIDY('t')} AS text, 'builtin' AS engine FROM d UNION ALL SELECT doc_id, 2, 'S. 2', {_TIDY('upper(t)')}, 'builtin' FROM d")
def extract_pdf_pages(spark, sf_dir):
    """Each document as a PDF of two pages, the second in capitals and split by kerning."""
    escaped = F.regexp_replace("text", r"([\\()])", r"\\$1")
    upper = F.concat(F.lit("[("), F.regexp_replace(F.upper(escaped), " ", ") -250 ("), F.lit(")] TJ"))
    stream = lambda n, c: F.concat(F.lit(f"{n} 0 obj << /Length 0 >>\nstream\nBT /F1 12 Tf "), c, F.lit(" ET\nendstream\nendobj\n"))
    body = F.concat(F.lit("%PDF-1.4\n5 0 obj << /Title (Data streams) >> endobj\n4 0 obj << /Type /Font /Encoding /WinAnsiEncoding >> endobj\n"), stream(1, F.concat(F.lit("("), escaped, F.lit(") Tj"))), F.lit("2 0 obj << /Subtype /Image >>\nstream\n(no text) Tj\nendstream\nendobj\n"), stream(3, upper), F.lit("%%EOF"))
    made = _plain(spark, sf_dir).select("doc_id", F.encode(body, "ISO-8859-1").alias("content"))
    return files.extract_units(made, engine="builtin").select("doc_id", "unit", "locator", "text", "engine")


def _office(kind: str, text: str) -> bytes:
    """A small file of a kind that holds the lines of a text."""
    lines, out = [escape(x) for x in text.split("\n")], io.BytesIO()
    parts: dict[str, str] = {}
    if kind == "pptx":
        parts = {f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{"".join(f"<a:t>{x} </a:t>" for x in lines)}</p:sld>' for n in (10, 2)}
        parts["ppt/notesSlides/notesSlide1.xml"] = '<p:notes xmlns:p="p" xmlns:a="a"><a:t>gesagt</a:t></p:notes>'
        parts["ppt/notesSlides/notesSlide2.xml"] = '<p:notes xmlns:p="p" xmlns:a="a"><a:t>2</a:t></p:notes>'
    elif kind == "docx":
        parts = {"word/document.xml": f'<w:document xmlns:w="w">{"".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)}</w:document>'}
    elif kind == "xlsx":
        parts["xl/workbook.xml"] = '<workbook xmlns="x"><sheets><sheet name="Noten"/></sheets></workbook>'
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="x">{"".join(f"<si><t>{x}</t></si>" for x in lines)}</sst>'
        parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="x">{"".join(f"<c t={chr(34)}s{chr(34)}><v>{i}</v></c>" for i in range(len(lines)))}<c t="inlineStr"><is><t>Ende</t></is></c></worksheet>'
    else:
        mime = {v: k for k, v in office.MIMES.items()}[kind]
        paragraphs = "".join(f"<t:p>{x}</t:p>" for x in lines)
        inner = {"odp": f"<d:page>{paragraphs}</d:page><d:page/>", "odt": paragraphs, "ods": f'<a:table a:name="Blatt">{"".join(f"<a:table-cell><t:p>{x}</t:p></a:table-cell>" for x in lines)}</a:table>'}[kind]
        parts = {"mimetype": mime, "content.xml": f'<o:content xmlns:o="o" xmlns:t="t" xmlns:d="d" xmlns:a="a">{inner}</o:content>'}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


_OFFICE = ("pptx", "docx", "xlsx", "odp", "odt", "ods")
_LINES = f"string_split({_PLAIN}, chr(10))"
_STRIPPED = "list_filter(list_transform(l, lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '')"
_FULL = "list_filter(l, lambda x: regexp_replace(x, ' ', '', 'g') <> '')"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, {_LINES} AS l FROM documents),
  u AS (SELECT doc_id, k, unnest(CASE WHEN k = 0 THEN [1, 2] WHEN k = 3 THEN [1, 2] ELSE [1] END) AS unit, l FROM d),
  x AS (SELECT doc_id, k, unit, l, CASE k WHEN 0 THEN array_to_string(list_transform(l, lambda x: x || ' '), '') || CASE WHEN unit = 1 THEN chr(10) || chr(10) || 'Notizen: gesagt' ELSE '' END
    WHEN 1 THEN array_to_string({_STRIPPED}, chr(10) || chr(10)) WHEN 2 THEN array_to_string(list_append({_STRIPPED}, 'Ende'), ' ')
    WHEN 3 THEN CASE WHEN unit = 1 THEN array_to_string(l, '') ELSE '' END WHEN 4 THEN array_to_string({_FULL}, chr(10) || chr(10)) ELSE array_to_string({_FULL}, ' ') END AS raw FROM u),
  y AS (SELECT doc_id, k, unit, {_TIDY('raw')} AS text FROM x), z AS (SELECT *, max(length(text)) OVER (PARTITION BY doc_id) AS most FROM y)
  SELECT doc_id, unit, CASE WHEN k IN (0, 3) THEN 'Folie ' || unit WHEN k = 2 THEN 'Noten' WHEN k = 5 THEN 'Blatt' ELSE '' END AS locator, text FROM z WHERE most > 0""")
def extract_office_units(spark, sf_dir):
    """Each document as a file of one of six kinds; those without text give an error and no unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "content": [_office(_OFFICE[i % 6], t) for i, t in zip(f["doc_id"], f["text"], strict=True)]})

    made = _plain(spark, sf_dir).mapInPandas(run, "doc_id long, content binary")
    return files.extract_units(made).filter("error IS NULL").select("doc_id", "unit", "locator", "text")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'not an Office or OpenDocument file' WHEN 1 THEN 'legacy binary Office format: save it in the XML format' WHEN 2 THEN 'no readable content streams' ELSE 'not an Office or OpenDocument file' END AS error FROM documents")
def unreadable_files(spark, sf_dir):
    """Files that hold nothing to read, and why."""
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, F.col("text").cast("binary")).when(kind == 1, F.unhex(F.lit(office.OLD_OFFICE.hex()))).when(kind == 2, F.concat(F.lit("%PDF-1.4 "), F.regexp_replace("text", "T[jJ]|stream", "")).cast("binary"))
    made = read(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return files.extract_units(made, engine="builtin").select("doc_id", "error")


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/tiff' WHEN 5 THEN 'image/bmp' ELSE '' END AS mime, doc_id % 7 < 6 OR doc_id % 7 = 7 AS wanted FROM documents")
def image_kinds(spark, sf_dir):
    heads = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "49492A00", "424D", "3C737667"]
    at = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 7 + 1).cast("int"))
    content = F.concat(F.unhex(at), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return read(spark, sf_dir, "documents").select("doc_id", links.image_mime(content).alias("mime"), links.scan_wanted(content).alias("wanted"))


@query(f"WITH d AS (SELECT doc_id, {_PLAIN} AS t FROM documents) SELECT doc_id, {_TIDY('t')} AS text FROM d")
def tidy_texts(spark, sf_dir):
    return _plain(spark, sf_dir).select("doc_id", T.tidy("text").alias("text"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN '' ELSE {duck.strip('text')} END AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def ocr_texts(spark, sf_dir):
    """What a reader said of a page: reasoning, a fence around all of it, nothing, or the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<think>of\nit</THINK>\n"), text)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```markdown\n"), text, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.lit(" NO_TEXT\n")).otherwise(text)
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_ocr(said).alias("text"))


# ---- platforms


def _json_items(spark, sf_dir, item, kind: str, where: str = "true") -> DataFrame:
    rows = read(spark, sf_dir, "documents").filter(where).select("source", F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", item.alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"])
    return rows.groupBy("source", "part").agg(F.to_json(F.struct(listed.alias("data"))).alias("body")).select(F.concat(F.lit("/courses/"), "source", F.lit(f"/{kind}?page[offset]="), F.col("part").cast("string")).alias("route"), F.lit(200).alias("status"), "body")


def _studip(spark, sf_dir) -> DataFrame:
    said = lambda **a: F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(*[v.alias(k) for k, v in a.items()]).alias("attributes"))
    html = F.concat(F.lit("<p>"), "text", F.lit("</p>"))
    wiki = _json_items(spark, sf_dir, said(name=F.concat(F.lit("W"), F.col("doc_id").cast("string")), content=html), "wiki-pages", "doc_id % 3 = 0")
    news = _json_items(spark, sf_dir, said(title=F.lit(""), content=html), "news", "doc_id % 3 = 1")
    attributes = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("Kurs "), "source").alias("title"), F.lit("<b>Ein Kurs</b> über vieles, was hier gelernt wird.").alias("description"), F.lit("kurz").alias("sub-title")).alias("attributes")).alias("data")))
    course = read(spark, sf_dir, "documents").select("source").distinct().select(F.concat(F.lit("/courses/"), "source").alias("route"), F.lit(200).alias("status"), attributes.alias("body"))
    broken = spark.createDataFrame([("/courses/src1/file-refs", 500, '{"data":[{"id":"x"}]}')], "route string, status int, body string")
    return wiki.unionByName(news).unionByName(course).unionByName(broken)


@query(f"""WITH d AS (SELECT *, {duck.collapse('text')} AS t, doc_id // 1000 AS part FROM documents WHERE text IS NOT NULL),
  n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id % 3, part ORDER BY doc_id) AS n FROM d)
  SELECT 'studip:' || source AS course_ref, 0 AS rank, 'studip:' || source || ':wiki:' || doc_id AS activity_ref, 'W' || doc_id AS title, t AS text, 'Kurs ' || source AS course_name FROM n WHERE doc_id % 3 = 0 AND n <= 100 AND length(t) >= 40
  UNION ALL SELECT 'studip:' || source, 3, 'studip:' || source || ':news:' || doc_id, 'Ankündigung', t, 'Kurs ' || source FROM n WHERE doc_id % 3 = 1 AND n <= 50 AND t <> ''
  UNION ALL SELECT DISTINCT 'studip:' || source, 2, 'studip:' || source || ':description', 'Kurs ' || source || ' — Beschreibung', 'Ein Kurs über vieles, was hier gelernt wird.', 'Kurs ' || source FROM documents""")
def studip_documents(spark, sf_dir):
    return lms.studip_documents(_studip(spark, sf_dir)).select("course_ref", "rank", "activity_ref", "title", "text", "course_name")


_FILE = "CASE doc_id % 5 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.mp4' WHEN 2 THEN 'c.png' WHEN 3 THEN 'd.txt' ELSE 'e' END"


@query(f"SELECT 'src' || (doc_id % 20) AS course, doc_id::VARCHAR AS file_id, {_FILE} AS name, doc_id * 1000000 AS size, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'L' || doc_id % 3 END AS licence, CASE WHEN doc_id % 4 < 2 THEN 'Ordner ' || doc_id % 4 ELSE '' END AS folder, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN CASE WHEN doc_id <= 200 THEN 'media' ELSE '' END WHEN 4 THEN 'text' ELSE '' END AS use FROM documents WHERE doc_id % 6 <> 5 AND doc_id % 5 <> 2")
def studip_files(spark, sf_dir):
    """Files of courses with folder, licence and use; what may not be downloaded and images are left out."""
    folders = spark.range(20).select(F.concat(F.lit("/courses/src"), F.col("id").cast("string"), F.lit("/folders")).alias("route"), F.lit(200).alias("status"), F.lit('{"data":[{"id":"f0","attributes":{"name":" Ordner 0 "}},{"id":"f1","attributes":{"name":"Ordner 1"}},{"id":"f2","attributes":{"name":""}}]}').alias("body"))
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    attributes = F.struct(F.expr(_FILE).alias("name"), F.when(i % 5 == 4, "application/vnd.openxmlfor").when(i % 5 == 3, "text/plain").otherwise("").alias("mime-type"), (i * 1000000).alias("filesize"), F.when(i % 6 == 5, False).when(i % 6 == 4, True).alias("is-downloadable"))
    ident = lambda c: F.struct(F.struct(c.alias("id")).alias("data"))
    relations = F.struct(ident(F.concat(F.lit("f"), (i % 4).cast("string"))).alias("folder"), F.when(i % 7 != 0, ident(F.concat(F.lit("L"), (i % 3).cast("string")))).alias("terms-of-use"))
    body = F.to_json(F.struct(F.array(F.struct(i.cast("string").alias("id"), attributes.alias("attributes"), relations.alias("relationships"))).alias("data")))
    refs = d.select(F.concat(F.lit("/courses/src"), (i % 20).cast("string"), F.lit("/file-refs?page="), i.cast("string")).alias("route"), F.lit(200).alias("status"), F.regexp_replace(body, "openxmlfor", "openxmlformats").alias("body"))
    every = refs.unionByName(folders)
    rows = lms.studip_files(every).filter(links.not_false(F.col("downloadable")) & ~links.image(F.col("name"), F.col("mime")))
    use = lambda f, name: f.select("course", "file_id", F.lit(name).alias("use"))
    known = use(lms.studip_wanted(every), "text").unionByName(use(lms.studip_media(every), "media"))
    return rows.join(known, ["course", "file_id"], "left").select("course", "file_id", "name", "size", "licence", "folder", F.coalesce("use", F.lit("")).alias("use"))


def _chapter_rows(spark, sf_dir) -> DataFrame:
    """A unit of Courseware a thousand documents of a source: the first document is its root, others hang below each other."""
    d = read(spark, sf_dir, "documents").select("source", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("unit"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("root", F.concat(F.lit("r"), "unit")).withColumn("parent", F.when(F.col("doc_id") % 1000 < 200, F.col("root")).otherwise(F.concat("source", F.lit(":"), (F.floor(F.col("doc_id") / 1000) * 1000 + F.col("doc_id") % 20).cast("string"))))


def _courseware(spark, sf_dir) -> DataFrame:
    d = _chapter_rows(spark, sf_dir)
    out = lambda rows, route, body: rows.select(route.alias("route"), F.lit(200).alias("status"), body.alias("body"))
    data = lambda *items: F.to_json(F.struct(F.array(*items).alias("data")))
    units = d.select("source", "unit", "root").distinct()
    ident = lambda c: F.struct(F.struct(c.alias("id")).alias("data"))
    listed = out(units, F.concat(F.lit("/courses/"), "source", F.lit("/courseware-units?u="), "unit"), data(F.struct(F.col("unit").alias("id"), F.struct(ident(F.col("root")).alias("structural-element")).alias("relationships"))))
    about = F.struct(F.struct(F.struct(F.concat(F.lit("Modul "), "unit").alias("title"), F.struct(F.lit("Worum es in diesem Modul geht, steht hier.").alias("description"), F.lit("blue").alias("color")).alias("payload")).alias("attributes")).alias("data"))
    roots = out(units, F.concat(F.lit("/courseware-structural-elements/"), "root"), F.to_json(about))
    element = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))
    position = (F.col("doc_id") * 7 % 11).cast("int")
    one = F.struct(element.alias("id"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Kapitel "), F.col("doc_id").cast("string"))).otherwise("").alias("title"), position.alias("position")).alias("attributes"), F.struct(ident(F.col("parent")).alias("parent")).alias("relationships"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("x")))), lambda x: x["x"])
    tree = d.groupBy("root").agg(F.to_json(F.struct(items.alias("data"))).alias("body")).select(F.concat(F.lit("/courseware-structural-elements/"), "root", F.lit("/descendants?page[limit]=200")).alias("route"), F.lit(200).alias("status"), "body")
    holds = out(d, F.concat(F.lit("/courseware-structural-elements/"), element, F.lit("/containers")), data(F.struct(F.concat(F.lit("c"), element).alias("id"))))
    block = lambda n, kind, title, payload, visible=None: F.struct(F.lit(str(n)).alias("id"), F.struct(F.lit(n).alias("position"), F.lit(kind).alias("block-type"), F.lit(title).alias("title"), F.lit(visible).cast("boolean").alias("visible"), payload.alias("payload")).alias("attributes"))
    text = F.struct(F.col("text").alias("text"), F.lit("red").alias("color"))
    other = F.struct(F.lit("").alias("text"), F.lit("x").alias("color"))
    blocks = out(d, F.concat(F.lit("/courseware-containers/c"), element, F.lit("/blocks")), data(block(3, "test", "Quiz", other), block(1, "text", "", text), block(2, "text", "Versteckt", other, False), block(0, "headline", "Anfang", other)))
    return listed.unionByName(roots).unionByName(tree).unionByName(holds).unionByName(blocks)


_CHAPTERS = f"""e AS (SELECT source, source || '-' || (doc_id // 1000) AS unit, source || ':' || doc_id AS id, doc_id, 'r' || source || '-' || (doc_id // 1000) AS root,
    CASE WHEN doc_id % 1000 < 200 THEN 'r' || source || '-' || (doc_id // 1000) ELSE source || ':' || (doc_id // 1000 * 1000 + doc_id % 20) END AS parent,
    doc_id * 7 % 11 AS position, {duck.collapse("coalesce(text, '')")} AS said FROM documents),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY doc_id) AS place FROM e) WHERE place <= 200),
  walk(root, id, path) AS (
    SELECT root, id, [lpad(position::VARCHAR, 4, '0') || ':' || id] FROM c WHERE parent = root
    UNION ALL SELECT c.root, c.id, list_append(w.path, lpad(c.position::VARCHAR, 4, '0') || ':' || c.id) FROM c JOIN walk w ON c.root = w.root AND c.parent = w.id)"""


@query(f"""WITH RECURSIVE {_CHAPTERS},
  placed AS (SELECT root, id, 0 AS late, path FROM walk UNION ALL SELECT root, id, 1, [lpad(position::VARCHAR, 4, '0') || ':' || id] FROM c WHERE id NOT IN (SELECT id FROM walk)),
  t AS (SELECT c.*, 'Anfang' || chr(10) || chr(10) || CASE WHEN said <> '' THEN said || chr(10) || chr(10) ELSE '' END || '[Selbsttest: Quiz]' AS text, row_number() OVER (PARTITION BY c.root ORDER BY late, path) AS n FROM c JOIN placed USING (root, id))
  SELECT 'studip:' || source || ':courseware:' || id || ':' || unit AS activity_ref, 'Modul ' || unit AS title, CASE WHEN doc_id % 2 = 0 THEN 'Kapitel ' || doc_id ELSE 'Abschnitt ' || position END AS locator, text, n::BIGINT AS place FROM t WHERE length(text) >= 40
  UNION ALL SELECT DISTINCT 'studip:' || source || ':courseware:' || root || ':' || unit, 'Modul ' || unit, 'Überblick', 'Worum es in diesem Modul geht, steht hier.', 0 FROM e""")
def courseware_documents(spark, sf_dir):
    found = lms.courseware(_courseware(spark, sf_dir))
    return found.select("activity_ref", "title", "locator", "text", F.split_part("ord", F.lit("."), F.lit(2)).cast("bigint").alias("place"))


def _moodle(spark, sf_dir) -> DataFrame:
    """A course each hundred documents of a language: a section each, with a page of its text and a file."""
    i, text = F.col("doc_id"), F.concat(F.lit("<i>"), F.coalesce("text", F.lit("")), F.lit("</i>"))
    name = F.concat(F.lit("f"), i.cast("string"), F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".zip").otherwise(".MD"))
    held = F.struct(F.lit("file").alias("type"), name.alias("filename"), F.concat(F.lit("https://m/f?id="), i.cast("string")).alias("fileurl"))
    module = F.struct(i.alias("id"), F.lit("").alias("name"), F.lit("page").alias("modname"), text.alias("description"), F.array(held).alias("contents"))
    section = F.struct(i.alias("id"), F.concat(F.lit("Woche "), i.cast("string")).alias("name"), F.when(i % 2 == 0, "<p>Plan</p>").otherwise("").alias("summary"), F.array(module).alias("modules"))
    own = read(spark, sf_dir, "documents").select((F.floor(i / 100)).alias("course"), "doc_id", section.alias("s"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]))
    contents = own.groupBy("course").agg(body.alias("body")).select(F.concat(F.lit("core_course_get_contents?courseid="), F.col("course").cast("string")).alias("route"), F.lit(200).alias("status"), "body")
    listed = own.select("course").distinct().select(F.lit("core_course_get_courses").alias("route"), F.lit(200).alias("status"), F.to_json(F.array(F.struct(F.col("course").alias("id"), F.concat(F.lit("Kurs &amp; "), F.col("course").cast("string")).alias("fullname"), F.lit("").alias("summary")))).alias("body"))
    broken = spark.createDataFrame([("core_course_get_contents?courseid=-1", 200, '{"exception":"x","message":"no right"}')], "route string, status int, body string")
    return contents.unionByName(listed).unionByName(broken)


_MOODLE = f"(SELECT doc_id, doc_id // 100 AS c, {duck.collapse(chr(39) + chr(32) + chr(39) + ' || coalesce(text, ' + chr(39) * 2 + ')')} AS t FROM documents)"


@query(f"""SELECT 'moodle:' || c || ':section:' || doc_id AS activity_ref, 'Woche ' || doc_id AS title, 'Plan' AS text, 'Kurs & ' || c AS course_name, '' AS folder, '' AS locator FROM {_MOODLE} WHERE doc_id % 2 = 0
  UNION ALL SELECT 'moodle:' || c || ':module:' || doc_id || ':page', 'Aktivität', t, 'Kurs & ' || c, '', '' FROM {_MOODLE} WHERE t <> ''
  UNION ALL SELECT 'moodle:' || c || ':file:' || doc_id || ':page:f' || doc_id || '.pdf', 'f' || doc_id || '.pdf', 'a page of document ' || doc_id, 'Kurs & ' || c, 'Woche ' || doc_id, 'S. 1' FROM {_MOODLE} WHERE doc_id % 3 = 0""")
def moodle_documents(spark, sf_dir):
    responses = _moodle(spark, sf_dir)
    got = lms.moodle_files(responses).filter("name LIKE '%.pdf'").select("url", F.concat(F.lit("%PDF-1.4 1 0 obj<<>> stream\n(a  page of document "), F.split_part("url", F.lit("="), F.lit(2)), F.lit(") Tj\nendstream endobj")).cast("binary").alias("content"))
    units = files.extract_units(got, engine="builtin")
    return lms.moodle_documents(responses, units).select("activity_ref", "title", "text", "course_name", "folder", "locator")


@query("SELECT 'https://m/f?id=' || doc_id || '&token=t' AS url, lower(split_part('f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '.MD' END, '.', 2)) AS suffix FROM documents WHERE doc_id % 3 <> 1")
def moodle_downloads(spark, sf_dir):
    return lms.moodle_files(_moodle(spark, sf_dir)).select(lms.with_token(F.col("url"), "t").alias("url"), F.lower(F.split_part("name", F.lit("."), F.lit(2))).alias("suffix"))


def _ilias(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A course each source: folders in the first twenty thousandths, other objects below them; and the files' replies."""
    i = F.col("doc_id")
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _LATIN, ""), r"[<>&]", "")
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.when(i < 200, "fold").when(i % 3 == 0, "file").otherwise("frm").alias("type"), text.alias("said"), F.when(i < 200, F.col("source")).otherwise((i % 20 + 20 * (i % 9)).cast("string")).alias("parent"))
    one = F.concat(F.lit('<Object type="'), "type", F.lit('" obj_id="9"><Title>n'), i.cast("string"), F.lit("</Title><Description>"), F.when(F.col("type") != "file", F.col("said")).otherwise(""), F.lit('</Description><References ref_id="'), i.cast("string"), F.lit('"/></Object>'))
    part = d.select("source", "parent", F.floor(i / 1000).alias("part"), "doc_id", one.alias("o")).groupBy("source", "parent", "part").agg(F.concat(F.lit("<Objects>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "o"))), lambda x: x["o"]), ""), F.lit("</Objects>")).alias("xml"))
    children = lms.ilias_children(part.select(F.col("source").alias("tree"), "parent", "xml"))
    about = d.select("source").distinct().select(F.col("source").alias("tree"), F.concat(F.lit('<Course><MetaData><General><Title>Kurs '), "source", F.lit("</Title><Description>kurz</Description></General></MetaData><Settings><Syllabus>Alles, was in diesem Kurs der Reihe nach behandelt wird.</Syllabus></Settings></Course>")).alias("xml"))
    pdf = F.concat(F.lit("%PDF-1.4 1 0 obj<<>> stream\n(page one of "), i.cast("string"), F.lit(") Tj\nendstream endobj"))
    reply = F.concat(F.lit("<File><Filename>f"), i.cast("string"), F.lit(".pdf</Filename><Title></Title><Versions><Version mode=\"PLAIN\">"), F.base64(F.lit("old")), F.lit("</Version><Version mode=\"PLAIN\">"), F.base64(pdf.cast("binary")), F.lit("</Version></Versions></File>"))
    return about, children, d.filter("type = 'file'").select(F.col("source").alias("tree"), i.cast("string").alias("id"), reply.alias("xml"))


_ILIAS_TEXT = f"{duck.collapse('regexp_replace(regexp_replace(coalesce(text, ' + chr(39) * 2 + '), ' + _BEYOND + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[<>&]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}"


@query(f"""WITH d AS (SELECT source, doc_id, {_ILIAS_TEXT} AS t, CASE WHEN doc_id < 200 THEN 'fold' WHEN doc_id % 3 = 0 THEN 'file' ELSE 'frm' END AS type, doc_id % 20 + 20 * (doc_id % 9) AS p FROM documents),
  f AS (SELECT d.*, CASE WHEN d.doc_id < 200 THEN '' ELSE 'n' || q.doc_id END AS folder FROM d LEFT JOIN d q ON q.doc_id = d.p AND q.source = d.source WHERE d.doc_id < 200 OR q.doc_id IS NOT NULL)
  SELECT 'ilias:' || source || ':obj:' || doc_id AS activity_ref, 'n' || doc_id AS title, t AS text, folder, 'Kurs ' || source AS course_name FROM f WHERE type = 'fold' AND t <> '' OR type = 'frm' AND length(t) >= 40
  UNION ALL SELECT 'ilias:' || source || ':file:' || doc_id || ':f' || doc_id || '.pdf', 'f' || doc_id || '.pdf', 'page one of ' || doc_id, folder, 'Kurs ' || source FROM f WHERE type = 'file' AND length('page one of ' || doc_id) >= 15
  UNION ALL SELECT DISTINCT 'ilias:' || source || ':syllabus', 'Kurs ' || source || ' — Inhalt', 'Alles, was in diesem Kurs der Reihe nach behandelt wird.', '', 'Kurs ' || source FROM documents""")
def ilias_documents(spark, sf_dir):
    about, children, replies = _ilias(spark, sf_dir)
    filename, name, content, error = lms.ilias_file(F.col("xml"))
    got = replies.select("tree", "id", filename.alias("filename"), name.alias("name"), F.when(error.isNull(), content).alias("content"))
    units = files.extract_units(got, engine="builtin")
    return lms.ilias_documents(about, children, units).select("activity_ref", "title", "text", "folder", "course_name")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '<x>' || doc_id || '</x>' END AS result, CASE doc_id % 3 WHEN 0 THEN 'no & access' ELSE NULL END AS fault FROM documents")
def soap_replies(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("<e><faultstring> no &amp; access </faultstring></e>")).otherwise(F.concat(F.lit('<ns1:getXMLResponse>\n<xml xsi:type="s">&lt;x&gt;'), i, F.lit("&lt;/x&gt;</xml></ns1:getXMLResponse>")))
    result, fault = lms.soap_result(reply)
    return read(spark, sf_dir, "documents").select("doc_id", result.alias("result"), fault.alias("fault"))


@query("SELECT 'studip:' || source AS course_ref, sum((doc_id % 3 = 0)::INT)::BIGINT AS wiki, sum((doc_id % 3 = 1)::INT)::BIGINT AS news, sum((doc_id % 3 = 2)::INT)::BIGINT AS file, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source")
def course_profile(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("wiki"), F.lit("news"), F.lit("file")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("studip:"), "source").alias("course_ref"), F.concat(F.lit("studip:"), "source", F.lit(":"), kind, F.lit(":"), F.col("doc_id").cast("string")).alias("activity_ref"), "text")
    return lms.course_profile(rows).select("course_ref", "wiki", "news", "file", "characters")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'json' ELSE 'file' END AS kind FROM documents")
def download_guards(spark, sf_dir):
    """What a download really is: a login page, an error in JSON, a file."""
    content = F.element_at(F.array(F.lit("  <html>"), F.lit('{"error":1}'), F.lit("%PDF-1.4")), (F.col("doc_id") % 3 + 1).cast("int")).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.when(lms.is_page(content), "page").when(lms.is_json(content), "json").otherwise("file").alias("kind"))


@query("SELECT doc_id, doc_id % 3 = 0 AS offered FROM documents")
def capability_gate(spark, sf_dir):
    told = F.when(F.col("doc_id") % 3 == 0, '{"capabilities":["chat","transcription"]}').when(F.col("doc_id") % 3 == 1, '{"capabilities":["chat"]}').otherwise("oops")
    return read(spark, sf_dir, "documents").select("doc_id", access.offered(told, "transcription").alias("offered"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'CC_BY' WHEN 2 THEN 'UNDEF_LICENSE' ELSE '' END AS licence FROM documents")
def licences(spark, sf_dir):
    ref = F.when(F.col("doc_id") % 4 == 0, "{}").when(F.col("doc_id") % 4 == 1, '{"relationships":{"terms-of-use":{"data":{"id":"CC_BY"}}}}').when(F.col("doc_id") % 4 == 2, '{"relationships":{"terms-of-use":{"data":{"id":"UNDEF_LICENSE"}}}}').otherwise('{"relationships":{"terms-of-use":null}}')
    return read(spark, sf_dir, "documents").select("doc_id", ref.alias("item")).select("doc_id", lms.licence().alias("licence"))


@query("SELECT source || '-' || doc_id AS course, n, text, doc_id AS rule FROM documents, (VALUES (0), (1)) v(n) WHERE doc_id % 4 <> 3")
def ai_rules(spark, sf_dir):
    """Rules of courses on AI, two a course; some courses' platforms answer with an error."""
    attributes = F.struct(F.struct("text", F.col("doc_id").alias("rule")).alias("attributes"))
    route = F.concat(F.lit("/courses/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit("/kitoolbox-rules"))
    responses = read(spark, sf_dir, "documents").select(route.alias("route"), F.when(F.col("doc_id") % 4 == 3, 404).otherwise(200).alias("status"), F.to_json(F.struct(F.array(attributes, attributes).alias("data"))).alias("body"))
    rule = lambda name: F.get_json_object("rule", f"$.{name}")
    return lms.studip_rules(responses).select("course", F.col("n").cast("int").alias("n"), rule("text").alias("text"), rule("rule").cast("bigint").alias("rule"))


# ---- who reads and listens


def _model_that_reads(image: bytes, mime: str) -> str:
    """A stand-in for a server: it answers a request with what its picture says, in the ways in which models answer."""
    request = providers.image_request(image, mime, model="told", mode="vision")
    said = base64.b64decode(request["messages"][0]["content"][-1]["image_url"]["url"].partition(",")[2]).decode()
    ways = {"image/png": "```markdown\n{}\n```", "image/jpeg": "<think>What is it?\n</think>\n{}", "image/gif": "NO_TEXT"}
    if mime not in ways:
        raise OSError("no such picture")
    return ways[mime].replace("{}", said)


@query(f"SELECT page_id::VARCHAR AS key, CASE page_id % 4 WHEN 2 THEN '' WHEN 3 THEN NULL ELSE {duck.strip("coalesce(html, '')")} END AS text, CASE WHEN page_id % 4 = 3 THEN 'no such picture' END AS error FROM pages")
def read_page_texts(spark, sf_dir):
    """Pictures read by a model: fenced, with its reasoning, without text, and failed ones."""
    mime = F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "image/gif", "image/x"))), (F.col("page_id") % 4 + 1).cast("int"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("image"), mime.alias("mime"))
    return providers.read_pages(pages, _model_that_reads, at_once=8)


def _model_that_listens(content: bytes, title: str) -> str:
    """A stand-in for a server: a text, or an utterance with its speaker, or a failure, by the title's number."""
    said, way = content.decode(), int(title) % 4
    if way == 3:
        raise OSError("line is dead")
    one = [{"start": 61.5, "end": 63, "text": said, "speaker": "A"}]
    return json.dumps({0: {"text": said}, 1: {"segments": one}, 2: {"segments": {"segments": one}}}[way])


_HEARD = duck.strip("coalesce(text, '')")


@query(f"""WITH d AS (SELECT doc_id, {_HEARD} AS t FROM documents)
  SELECT doc_id::VARCHAR AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '1:01' END AS locator, CASE WHEN doc_id % 4 > 0 THEN 'A: ' ELSE '' END || t AS text, NULL AS error FROM d WHERE doc_id % 4 < 3 AND t <> ''
  UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, doc_id || ': line is dead' FROM d WHERE doc_id % 4 = 3""")
def transcribed_passages(spark, sf_dir):
    """Recordings heard by a model: texts, utterances flat and one level deeper, and failed ones."""
    i = F.col("doc_id").cast("string")
    media = read(spark, sf_dir, "documents").select(i.alias("activity_ref"), i.alias("title"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    heard = kept(providers.transcribed(media, _model_that_listens, at_once=8))
    none = F.lit(None).cast("string")
    failed = heard.filter("error IS NOT NULL").select("title", none.alias("locator"), none.alias("text"), "error")
    return providers.passages(heard).select("title", "locator", "text", none.alias("error")).unionByName(failed)


# ---- who asks


@query("SELECT doc_id, 'user' || doc_id AS username, 'app' AS client FROM documents WHERE doc_id % 5 = 0")
def accepted_tokens(spark, sf_dir):
    """Tokens of users: one of five is good, others are of another issuer, expired, no bearer's, or nameless."""
    i = F.col("doc_id")
    body = F.to_json(F.struct(F.when(i % 5 == 1, "https://other").otherwise("https://idp/").alias("iss"), F.when(i % 5 == 2, 5.0).otherwise(2e9).alias("exp"), F.when(i % 5 == 3, "Refresh").otherwise("Bearer").alias("typ"), F.when(i % 5 == 4, " ").otherwise(F.concat(F.lit(" user"), i.cast("string"))).alias("preferred_username"), F.lit("app").alias("azp"), F.array(F.lit("bridge"), F.lit("x")).alias("aud")))
    token = F.concat(F.lit("h."), F.regexp_replace(F.translate(F.base64(body.cast("binary")), "+/", "-_"), "[=\\s]", ""), F.lit(".s"))
    rows = read(spark, sf_dir, "documents").select("doc_id", access.claims(token).alias("claims"))
    return access.accepted(rows, issuer="https://idp", now=1e9, audience="bridge", clients=("app",)).select("doc_id", "username", "client")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'moodle:' || doc_id WHEN 1 THEN 'studip:' || md5(doc_id::VARCHAR) WHEN 2 THEN 'studip:' || md5(doc_id::VARCHAR) ELSE 'x' || doc_id END AS course_ref FROM documents")
def typed_courses(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    typed = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" moodle:"), i)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://s/dispatch.php?cid="), F.md5(i.cast("binary")))).when(F.col("doc_id") % 4 == 2, F.md5(i.cast("binary"))).otherwise(F.concat(F.lit("x"), i))
    return read(spark, sf_dir, "documents").select("doc_id", access.course_ref(typed).alias("course_ref"))


@query("SELECT 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) AS origin, min(page_id) AS ord FROM pages GROUP BY 1")
def page_origins(spark, sf_dir):
    return access.origins(read(spark, sf_dir, "pages").select(F.regexp_replace("url", "^http://", "https://").alias("url"), F.col("page_id").alias("ord")))


# ---- scans, recordings, jobs

_SCANS = ["'studip:src' || (doc_id % 20) AS course_ref", "doc_id AS ord", "CAST(doc_id % 6 AS INT) AS page_count"]


@query("""WITH f AS (SELECT 'studip:src' || (doc_id % 20) AS course_ref, doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN range(1, doc_id % 6 + 1) ELSE [3, 1, 9] END AS w FROM documents),
  g AS (SELECT *, list_filter(w, lambda p: p <> 2 AND p < 6) AS d FROM f), b AS (SELECT *, coalesce(sum(len(d)) OVER (PARTITION BY course_ref ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
  SELECT course_ref, ord, array_to_string(d[1:least(greatest(30 - before, 0), len(d))::INT], ',') AS read, (len(d) - least(greatest(30 - before, 0), len(d)))::BIGINT AS skipped FROM b""")
def pages_to_read(spark, sf_dir):
    scans = read(spark, sf_dir, "documents").selectExpr(*_SCANS).withColumn("wanted", F.when(F.col("ord") % 2 == 1, F.array(F.lit(3), F.lit(1), F.lit(9)))).withColumn("with_images", F.array(*map(F.lit, (1, 3, 4, 5))))
    return ingest.pages_to_read(scans, 30).select("course_ref", "ord", F.array_join("read", ",").alias("read"), "skipped")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cached text of page ' || doc_id ELSE {duck.collapse('text')} END AS text FROM documents WHERE doc_id % 3 = 0 OR length({duck.collapse('text')}) >= 15")
def ocr_cache_union(spark, sf_dir):
    """Texts of pages, from a cache on disk where it has them (put twice, which changes nothing), else as read now."""
    pages = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), "text")
    path = scratch(spark, "ocr-cache")
    old = pages.filter("doc_id % 3 = 0").select("key", F.concat(F.lit("cached text of  page "), F.col("doc_id").cast("string")).alias("text"))
    for _ in range(2):
        ingest.cache_put(spark, path, old)
    return ingest.read_texts(pages.drop("text"), ingest.read_cache(spark, path), pages).select("doc_id", "text")


@query("WITH p AS (SELECT 'studip:src' || (doc_id % 20) AS course_ref, 'a' || (doc_id // 10) AS activity_ref, doc_id AS ord, CASE WHEN doc_id % 4 = 0 THEN 'timeout ' || doc_id END AS error, CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'S. ' || doc_id % 10 END AS locator FROM documents) SELECT course_ref, activity_ref, count(error) || ' of ' || count(*) || ' pages not read; ' || arg_min(CASE WHEN locator = '' THEN 'Bild' ELSE locator END || ': ' || error, ord) FILTER (error IS NOT NULL) AS summary FROM p GROUP BY ALL HAVING count(error) > 0")
def failure_summaries(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("studip:src"), (i % 20).cast("string")).alias("course_ref"), F.concat(F.lit("a"), F.floor(i / 10).cast("string")).alias("activity_ref"), i.alias("ord"), F.when(i % 4 == 0, F.concat(F.lit("timeout "), i.cast("string"))).alias("error"), F.when(i % 8 == 0, "").otherwise(F.concat(F.lit("S. "), (i % 10).cast("string"))).alias("locator"))
    return ingest.failure_summary(rows)


@query(f"""WITH {_STATES},
  p AS (SELECT course_ref, count(*) FILTER (kind = 'transcription' AND submitted AND ended IS NULL) AS r, count(*) FILTER (kind = 'scan' AND submitted AND ended IS NULL) AS s FROM states GROUP BY 1),
  t AS (SELECT course_ref, string_agg(title, ',' ORDER BY o) AS titles FROM (SELECT course_ref, title, min(first) AS o FROM states WHERE submitted GROUP BY ALL) GROUP BY 1),
  f AS (SELECT course_ref, string_agg(title || ': ' || error, ',' ORDER BY placed) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY course_ref ORDER BY placed) AS n FROM states WHERE ended = 'failed') WHERE n <= 5 GROUP BY 1)
  SELECT course_ref, r AS transcriptions, s AS scans, coalesce(titles, '') AS titles, coalesce(errors, '') AS errors FROM p LEFT JOIN t USING (course_ref) LEFT JOIN f USING (course_ref)""")
def job_details(spark, sf_dir):
    told = ingest.job_details(read(spark, sf_dir, "events").selectExpr(*_EVENTS))
    return told.withColumn("titles", F.array_join("titles", ",")).withColumn("errors", F.array_join("errors", ","))


@query(f"""WITH u AS (SELECT conv_id, list({{'t': {duck.strip('text')}, 's': turn * 30, 'e': turn * 30 + 30, 'n': 0, 'buf': '', 'at': 0, 'o': []::STRUCT(l BIGINT, x VARCHAR)[]}} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
  r AS (SELECT conv_id, list_reduce(list_concat([{{'t': '', 's': 0::BIGINT, 'e': 0::BIGINT, 'n': 0, 'buf': '', 'at': l[1].s, 'o': []::STRUCT(l BIGINT, x VARCHAR)[]}}], l), lambda a, q: CASE WHEN q.t = '' THEN a
    WHEN a.n + length(q.t) >= 900 THEN {{'t': '', 's': 0::BIGINT, 'e': 0::BIGINT, 'n': 0, 'buf': '', 'at': q.e, 'o': list_append(a.o, {{'l': a.at, 'x': CASE WHEN a.buf = '' THEN q.t ELSE a.buf || ' ' || q.t END}})}}
    ELSE {{'t': '', 's': 0::BIGINT, 'e': 0::BIGINT, 'n': (a.n + length(q.t))::INTEGER, 'buf': CASE WHEN a.buf = '' THEN q.t ELSE a.buf || ' ' || q.t END, 'at': a.at, 'o': a.o}} END) AS r FROM u),
  x AS (SELECT conv_id, CASE WHEN r.buf <> '' THEN list_append(r.o, {{'l': r.at, 'x': r.buf}}) ELSE r.o END AS o FROM r)
  SELECT conv_id, unnest(list_transform(o, lambda p: (p.l // 60)::VARCHAR || ':' || lpad((p.l % 60)::VARCHAR, 2, '0'))) AS locator, unnest(list_transform(o, lambda p: p.x)) AS text FROM x""")
def transcript_segments(spark, sf_dir):
    """Transcriptions as JSON with times in seconds, half of them one level deeper, into timed passages."""
    one = F.struct((F.col("turn") * 30).cast("double").alias("start"), (F.col("turn") * 30 + 30).cast("double").alias("end"), "text")
    told = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("u")))), lambda x: x["u"]).alias("u"))  # one recording
    flat, deep = F.to_json(F.struct(F.col("u").alias("segments"))), F.to_json(F.struct(F.struct(F.col("u").alias("segments")).alias("segments")))
    bodies = told.select(F.col("conv_id").cast("string").alias("activity_ref"), F.lit("").alias("title"), F.when(F.hash("conv_id") % 2 == 0, flat).otherwise(deep).alias("body"))
    return providers.passages(bodies, speakers=False).select(F.col("activity_ref").cast(told.schema["conv_id"].dataType).alias("conv_id"), "locator", "text")


# ---- providers

def _letters(texts: list[str]) -> list[dict]:
    """A stand-in for an embedding service: counts of three letters, answered in reverse order."""
    return [{"index": i, "embedding": [float(t.count(c)) for c in "aen"]} for i, t in reversed(list(enumerate(texts)))]


@query(f"WITH {duck.CHUNKS} SELECT course_ref, chunk_ord, (length(text) - length(replace(text, 'a', ''))) || ',' || (length(text) - length(replace(text, 'e', ''))) || ',' || (length(text) - length(replace(text, 'n', ''))) AS vector FROM chunks")
def embedded_chunks(spark, sf_dir):
    """Chunks embedded in batches by a provider that answers out of order."""
    found = vector.embedded(stored(spark, sf_dir).read().select("course_ref", "chunk_ord", "text"), _letters)
    return found.select("course_ref", "chunk_ord", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query(f"""WITH {duck.CHUNKS}, v AS (SELECT course_ref, chunk_ord, [length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'n', ''))]::DOUBLE[] AS v FROM chunks WHERE course_ref IN ('studip:src1', 'studip:src2')),
  s AS (SELECT course_ref, chunk_ord AS ord, (v[1] * 1 + v[2] * 2 + v[3] * 3) / (sqrt(14) * sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) AS score FROM v WHERE v[1] + v[2] + v[3] > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY course_ref ORDER BY round(score, 9) DESC, ord) AS rank FROM s WHERE score >= 0.35)
  SELECT CASE course_ref WHEN 'studip:src1' THEN 1 ELSE 2 END AS query_id, rank, course_ref, ord, round(score, 4) AS score FROM r WHERE rank <= 4""")
def vector_index_search(spark, sf_dir):
    """An index with vectors, searched by what the same provider makes of a question."""
    provided, _ = providers.retrieval(spark, "auto", scratch(spark, "vectors"), _letters)
    provided.index(stored(spark, sf_dir).read().filter("course_ref IN ('studip:src1', 'studip:src2')"))
    asked = spark.createDataFrame([(1, "studip:src1", "aeennn", 4), (2, "studip:src2", "naeenn", 4)], "query_id long, course_ref string, text string, k int")
    return provided.search(asked).withColumn("query_id", F.col("query_id").cast("int"))


_MODES = {"none": "none", "external": "external", "builtin": "lexical", "embeddings": "lexical", "auto": "lexical", "auto+model": "embeddings"}


@query(f"""WITH {duck.CHUNKS}, c AS (SELECT course_ref, count(*) AS chunks FROM chunks GROUP BY course_ref), m AS (SELECT unnest([{', '.join(map(duck.LIT, _MODES))}]) AS mode, unnest([{', '.join(map(duck.LIT, _MODES.values()))}]) AS provider)
  SELECT mode, provider, mode = 'embeddings' AS warned, course_ref, chunks FROM m, c WHERE provider IN ('lexical', 'embeddings')
  UNION ALL SELECT mode, provider, false, NULL, 0 FROM m WHERE provider IN ('none', 'external')""")
def provider_choice(spark, sf_dir):
    """Which retrieval each setting gives, and what it holds of each course once all chunks are given to the first of its kind."""
    found, given, path, filled = [], stored(spark, sf_dir), scratch(spark, "choice"), set()
    for mode in _MODES:
        provided, warning = providers.retrieval(spark, mode.partition("+")[0], path, _letters if "+" in mode else None)
        about = [F.lit(mode).alias("mode"), F.lit(provided.name).alias("provider"), F.lit(bool(warning)).alias("warned")]
        try:
            if provided.name not in filled:
                provided.take(given)
                filled.add(provided.name)
            found.append(provided.courses().select(*about, "course_ref", F.col("chunks").cast("bigint").alias("chunks")))
        except (RuntimeError, NotImplementedError):  # the slots without an index refuse
            found.append(spark.range(1).select(*about, F.lit(None).cast("string").alias("course_ref"), F.lit(0).cast("bigint").alias("chunks")))
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {duck.CHUNKS} SELECT course_ref, count(*) AS chunks, coalesce(arg_min(course_name, chunk_ord) FILTER (course_name <> ''), '') AS course_name FROM chunks WHERE course_ref IN ('studip:src1', 'studip:src7') GROUP BY course_ref")
def tool_list_courses(spark, sf_dir):
    """What a user sees of the index through the assistant's tools."""
    acl = catalog.parse_allowlist(spark.createDataFrame([("student1=studip:src1,studip:src7,moodle:5",)], "text string"))
    return providers.Tools(stored(spark, sf_dir), mode="allowlist", acl=acl, username="Student1").list_indexed_courses("studip")


@query(f"WITH {duck.search('SELECT 0 AS query_id, $$studip:src1$$ AS course_ref, (SELECT string_agg(text, $$ $$ ORDER BY item_id) FROM benchmark WHERE item_id % 100 = 0) AS text, 6 AS k, NULL::VARCHAR[] AS documents')} SELECT rank, title || ', ' || locator || ' (' || CASE WHEN course_name <> '' THEN course_name || ' / ' ELSE '' END || folder || ')' AS citation, substr(sha1(activity_ref), 1, 10) AS doc_id, score FROM hits")
def tool_search_course(spark, sf_dir):
    """A search through the assistant's tools, with citations."""
    asked = " ".join(r.text for r in read(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").orderBy("item_id").collect())
    hits, _ = providers.Tools(stored(spark, sf_dir)).search_course("studip:src1", asked)
    return hits.select("rank", "citation", "doc_id", "score")


@query(f"WITH {duck.CHUNKS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM documents WHERE doc_id % 5 = 1) AS transcription_queued, (SELECT count(*) FROM documents WHERE doc_id % 9 > 0) AS image_text_queued, (SELECT sum(least(doc_id % 9, 100000)) FROM documents)::BIGINT AS image_text_pages, 0::BIGINT AS image_text_skipped")
def index_summary(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    scans = ingest.page_budget(d.select(F.concat(F.lit("c"), "source").alias("course_ref"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 9).alias("pages")), 1 << 40)
    return ingest.index_summary(d, chunks(spark, sf_dir), scans, d.filter("doc_id % 5 = 1"))


@query(f"""WITH {duck.CHUNKS}, c AS (SELECT course_ref, count(*) AS chunks FROM chunks GROUP BY course_ref), q AS (SELECT DISTINCT 'studip:' || source AS course_ref, regexp_extract(source, '[0-9]+$') NOT LIKE '%3' AS replace FROM documents)
  SELECT course_ref, coalesce(chunks, 0)::BIGINT AS chunks_before, CASE WHEN replace THEN 0 ELSE coalesce(chunks, 0) END::BIGINT AS chunks_after, replace FROM q LEFT JOIN c USING (course_ref)""")
def scans_only_request(spark, sf_dir):
    """Requests of scans alone replace what their courses had by nothing, for the jobs to fill; those that only add leave it."""
    store = IndexStore(spark, scratch(spark, "scans-only"))
    store.copy(stored(spark, sf_dir))
    counted = lambda name: kept(store.read().groupBy("course_ref").agg(F.count(F.lit(1)).alias(name)))
    before = counted("chunks_before")
    scan = F.array(F.struct(F.concat(F.lit("Scan "), F.col("doc_id").cast("string")).alias("title")))
    replace = ~F.regexp_extract("source", "[0-9]+$", 0).endswith("3")
    body = F.to_json(F.struct(F.concat(F.lit("studip:"), "source").alias("course_ref"), replace.alias("replace"), scan.alias("scans")))
    requests = ingest.requests(read(spark, sf_dir, "documents").select(body.alias("body"))).filter("error IS NULL")
    asked = kept(requests.groupBy("course_ref").agg(F.bool_or("replace").alias("replace")))
    store.replace(store.read().limit(0), [r.course_ref for r in asked.filter("replace").collect()])  # a row a course
    rows = asked.join(before, "course_ref", "left").join(counted("chunks_after"), "course_ref", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select("course_ref", none("chunks_before"), none("chunks_after"), "replace")


# ---- what requests carry

#: Each page as a request with two scans and a recording: its html behind the first bytes of a PNG, sent twice; some of it no base64, some no image.
def _scan_requests(spark, sf_dir) -> DataFrame:
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    magic = F.when(F.col("page_id") % 7 == 2, F.lit("")).otherwise("89504E470D0A1A0A")
    content = F.concat(F.unhex(magic), html)
    i = F.col("page_id").cast("string")
    entry = F.struct(F.concat(F.lit("studip:c:file:"), i).alias("activity_ref"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("Scan "), i)).alias("title"), F.when(F.col("page_id") % 5 == 3, "no base64 x!").otherwise(F.base64(content)).alias("content_base64"))
    body = F.to_json(F.struct(F.concat(F.lit("studip:src"), (F.col("page_id") % 20).cast("string")).alias("course_ref"), F.array(entry, entry).alias("scans"), F.array(entry).alias("media")))
    return dealt(read(spark, sf_dir, "pages")).select("page_id", body.alias("body"))


_SENT = """raw AS (SELECT page_id, CASE WHEN page_id % 7 = 2 THEN ''::BLOB ELSE '\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB END || encode(coalesce(html, '')) AS content FROM pages WHERE page_id % 5 <> 3),
  sent AS (SELECT 'studip:src' || (page_id % 20) AS course_ref, page_id, kind, n, 'studip:c:file:' || page_id AS activity_ref, CASE WHEN page_id % 3 > 0 THEN 'Scan ' || page_id WHEN kind = 'scan' THEN 'Scan' ELSE 'Aufnahme' END AS title, sha256(content) AS key, octet_length(content) AS bytes, content
    FROM raw, (VALUES ('scan', 0), ('scan', 1), ('media', 0)) v(kind, n))"""


@query(f"WITH {_SENT} SELECT course_ref, page_id, kind, n, activity_ref, title, key, bytes::INT AS bytes FROM sent WHERE bytes > 0")
def request_attachments(spark, sf_dir):
    """Scans and recordings of requests, decoded and named by their content; what cannot be decoded goes."""
    found = attachments.attachments(_scan_requests(spark, sf_dir), order="page_id")
    return found.select("course_ref", F.col("ord").alias("page_id"), "kind", "n", "activity_ref", "title", "key", F.octet_length("content").alias("bytes"))


@query(f"""WITH {_SENT}, s AS (SELECT *, row_number() OVER (PARTITION BY course_ref ORDER BY page_id, n) AS place FROM sent WHERE kind = 'scan' AND page_id % 7 <> 2)
  SELECT course_ref, activity_ref, title, text FROM (SELECT *, {duck.collapse("decode(content[9:])")} AS text FROM s WHERE place <= 12) WHERE length(text) >= 15""")
def request_scan_texts(spark, sf_dir):
    """From requests to the texts of their scans: stored by content, twelve pages a course, each different page read once."""
    found = kept(attachments.attachments(_scan_requests(spark, sf_dir), order="page_id"))
    path = scratch(spark, "blobs")
    for _ in range(2):  # the second time adds nothing
        attachments.put_blobs(spark, path, found)
    blobs = attachments.read_blobs(spark, path)
    plan = attachments.planned(found, attachments.counted(blobs), 12)
    documents, _ = attachments.scanned_texts(plan, blobs, ingest.read_cache(spark, scratch(spark, "texts")), _after_magic, "told")
    return documents.select("course_ref", "activity_ref", "title", "text")


def _after_magic(image: bytes, mime: str) -> str:
    """A stand-in for a reader: the text behind the first bytes."""
    return image[8:].decode()
