"""Learning platforms, read from responses: rows (``route``, ``status``, ``body``).

Responses come from saved files or from :func:`fetched`. A response of status
400 or more, or with a null body, is a source that failed: it gives no rows and
costs the course nothing else. Reading is declarative; only the transport runs
in Python. Numbers of items taken from one response are parameters.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as T
from ..operators import ingest, trees
from ..plans.scratch import kept
from . import files

DOCUMENT_COLUMNS = ("course_ref", "rank", "ord", "activity_ref", "title", "locator", "text", "course_name", "folder", "licence")
#: Most items taken from one response.
CAPS = {"wiki-pages": 100, "news": 50, "file-refs": 25, "folders": 200, "courseware-units": 20, "descendants": 200, "containers": 50, "blocks": 100}
#: Blocks that refer to material, and the keys that hold a block's text.
REFERENCE_BLOCKS = ("test", "assignment", "folder", "file", "link", "embed")
TEXT_KEYS = ("text", "content", "description", "caption")


# ---- transport


def fetched(requests: DataFrame, base: str, headers: dict[str, str] | None = None, timeout: int = 120) -> DataFrame:
    """Responses to ``requests(route[, data])``: POST where ``data`` is given, else GET.

    An error of the server is a response with its status; an unreachable one
    has status 599. No ``Accept`` header is sent: one platform fails on it.
    """
    if "data" not in requests.columns:
        requests = requests.withColumn("data", F.lit(None).cast("string"))

    def one(route: str, data: str | None) -> tuple[int, str]:
        request = urllib.request.Request(base.rstrip("/") + route, data=None if data is None else data.encode(), headers=headers or {})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.status, reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as fault:
            with fault:
                return fault.code, fault.read().decode("utf-8", "replace")
        except OSError as fault:
            return 599, str(fault)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(r, None if pd.isna(d) else d) for r, d in zip(f["route"], f["data"], strict=True)]
            yield pd.DataFrame({"route": f["route"], "status": [s for s, _ in got], "body": [b for _, b in got]})

    return requests.select("route", "data").mapInPandas(run, "route string, status int, body string")


def authorization(token: str = "", user: str = "", password: str = "") -> dict[str, str]:
    """The header of a caller: a token, else a name and a password."""
    import base64

    if token:
        return {"Authorization": f"Bearer {token}"}
    if not (user and password):
        raise ValueError("a token, or a name and a password, is needed")
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()}


def is_page(content: Column) -> Column:
    """Whether a download is a web page (of a login form) and not a file."""
    text = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    return F.ltrim(F.substring(text, 1, 5)).startswith("<") | text.contains("<!DOCTYPE html")


def is_json(content: Column) -> Column:
    """Whether a download is an error in JSON and not a file."""
    return F.decode(F.substring(content, 1, 1), "ISO-8859-1").isin("{", "[")


def with_token(url: Column, token: str) -> Column:
    """A file's address with the token as a further parameter."""
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"token={token}"))


# ---- JSON:API


def _good(responses: DataFrame) -> DataFrame:
    return responses.filter((F.col("status") < 400) & F.col("body").isNotNull())


def items(responses: DataFrame, route: str, kind: str, *keys: str, cap: int | None = None) -> DataFrame:
    """The items of responses whose route matches: its groups as ``keys``, the place ``n``, the ``item`` as JSON.

    One response gives its first ``cap`` items (as many as a platform is asked
    for at once). Responses with a ``page`` were read to their end, by
    :func:`api.read_pages`: they give all items, numbered through the pages.
    """
    own = _good(responses).filter(F.col("route").rlike(route))
    groups = [F.regexp_extract("route", route, i + 1).alias(k) for i, k in enumerate(keys)]
    listed = F.from_json("body", "data ARRAY<STRING>")["data"]
    if "page" not in responses.columns:
        return own.select(*groups, F.posexplode(F.slice(listed, 1, cap or CAPS[kind])).alias("n", "item"))
    pages = own.select("route", "page", *groups, listed.alias("listed"))
    before = F.coalesce(F.sum(F.size("listed")).over(Window.partitionBy("route").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a page
    found = pages.withColumn("before", before).select(*keys, "before", F.posexplode("listed").alias("at", "item")).select(*keys, (F.col("before") + F.col("at")).cast("int").alias("n"), "item")
    return found if cap is None else found.filter(F.col("n") < cap)


def _at(path: str, column: str = "item") -> Column:
    return F.coalesce(F.get_json_object(column, f"$.{path}"), F.lit(""))


def licence(item: str = "item") -> Column:
    """The terms of use that a file is under, '' if none are told."""
    return F.coalesce(F.get_json_object(item, "$.relationships['terms-of-use'].data.id"), F.lit(""))


def payload_text(payload: Column) -> Column:
    """The prose of a payload: itself if it is a string, else its known keys that hold strings."""

    def told(payload: Column, parsed: Column) -> Column:
        is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))

        def of(key: str) -> Column:
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            text = F.try_variant_get(parsed, f"$.{key}", "string")
            return F.when((F.schema_of_variant(value) == "STRING") & text.rlike(T.NO_WS), text)

        return F.when(payload.isNull(), "").when(is_object, F.concat_ws("\n\n", *map(of, TEXT_KEYS))).otherwise(payload)

    return T.once(payload, lambda p: T.once(F.try_parse_json(p), lambda v: told(p, v)))


def _documents(rows: DataFrame, rank: int, *order: str, **columns: Column) -> DataFrame:
    blank = {c: F.lit("") for c in ("locator", "course_name", "folder", "licence")}
    own = {"rank": F.lit(rank), "ord": F.concat_ws(".", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in order]), **blank, **columns}
    return rows.select(*[own[c].alias(c) for c in DOCUMENT_COLUMNS])


def _ref(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


# ---- Stud.IP

_COURSE = r"^/courses/([^/?]+)"


def studip_files(responses: DataFrame) -> DataFrame:
    """Files of courses: (course, n, file_id, name, mime, size, downloadable, licence, folder)."""
    files = items(responses, _COURSE + "/file-refs", "file-refs", "course")
    folders = items(responses, _COURSE + "/folders", "folders", "course").select("course", _at("id").alias("folder_id"), T.strip(_at("attributes.name")).alias("name")).filter("folder_id <> '' AND name <> ''").dropDuplicates(["course", "folder_id"])
    files = files.select(
        "course", "n", _at("id").alias("file_id"),
        F.coalesce(F.nullif(_at("attributes.name"), F.lit("")), F.lit("Datei")).alias("name"),
        F.coalesce(F.get_json_object("item", "$.attributes['mime-type']"), F.lit("")).alias("mime"),
        F.get_json_object("item", "$.attributes.filesize").try_cast("bigint").alias("size"),
        F.get_json_object("item", "$.attributes['is-downloadable']").try_cast("boolean").alias("downloadable"),
        licence().alias("licence"), _at("relationships.folder.data.id").alias("folder_id"),
    )
    return files.join(folders.withColumnRenamed("name", "folder"), ["course", "folder_id"], "left").withColumn("folder", F.coalesce("folder", F.lit(""))).drop("folder_id")


def studip_media(responses: DataFrame) -> DataFrame:
    """Recordings of courses that may be fetched and are not too long to send."""
    return studip_files(responses).filter(links.transcribable(F.col("name"), F.col("mime")) & links.media_wanted(F.col("size"), F.col("downloadable")))


def studip_wanted(responses: DataFrame, scans: bool = False) -> DataFrame:
    """Files worth fetching for their text, and images where they can be read."""
    name, mime = F.col("name"), F.col("mime")
    return studip_files(responses).filter((links.extractable(name, mime) | (F.lit(scans) & links.image(name, mime))) & links.not_false(F.col("downloadable")))


def studip_rules(responses: DataFrame) -> DataFrame:
    """A course's rules on AI (course, n, rule as JSON); none if the course has none."""
    return items(responses, _COURSE + "/kitoolbox-rules", "rules", "course", cap=1 << 20).select("course", "n", _at("attributes").alias("rule"))


def courseware(responses: DataFrame) -> DataFrame:
    """Chapters of Courseware as documents in reading order, under their module's title."""
    units = items(responses, _COURSE + "/courseware-units", "courseware-units", "course")
    units = units.select("course", F.col("n").alias("unit_n"), _at("id").alias("unit"), _at("relationships['structural-element'].data.id").alias("root")).filter("root <> ''")
    one = r"^/courseware-structural-elements/([^/?]+)$"
    roots = _good(responses).filter(F.col("route").rlike(one)).select(F.regexp_extract("route", one, 1).alias("root"), F.get_json_object("body", "$.data.attributes").alias("a"))
    payload = lambda c: T.strip_html(payload_text(F.get_json_object(c, "$.payload")))
    roots = roots.select("root", F.coalesce(F.nullif(_at("title", "a"), F.lit("")), F.lit("Courseware")).alias("module"), payload("a").alias("about"))
    units = kept(units.join(roots, "root"))  # a row a unit
    ref = lambda element: F.concat(_ref("studip", F.col("course"), "courseware", F.col(element)), F.when(F.col("unit") != "", F.concat(F.lit(":"), "unit")).otherwise(""))
    course_ref = _ref("studip", F.col("course"))
    about = _documents(units.withColumn("place", F.lit(0)).filter(T.size("about") >= 40), 1, "unit_n", "place", course_ref=course_ref, activity_ref=ref("root"), title=F.col("module"), locator=F.lit("Überblick"), text=F.col("about"))

    elements = items(responses, r"^/courseware-structural-elements/([^/?]+)/descendants", "descendants", "root")
    elements = elements.select("root", _at("id").alias("id"), F.get_json_object("item", "$.relationships.parent.data.id").alias("parent"), F.coalesce(_at("attributes.position").try_cast("int"), F.lit(0)).alias("position"), T.strip(_at("attributes.title")).alias("title"), _at("attributes.position").alias("shown"), T.strip_html(payload_text(F.get_json_object("item", "$.attributes.payload"))).alias("intro"))
    elements = kept(elements.filter("id <> root").dropDuplicates(["root", "id"]))  # the tree and the chapters are made of them
    nodes = elements.select(F.col("root").alias("tree"), "id", F.coalesce("parent", F.lit("")).alias("parent"), "position")
    nodes = nodes.unionByName(elements.select("root").distinct().select(F.col("root").alias("tree"), F.col("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(-1).alias("position")))
    places = trees.reading_order(nodes).select(F.col("tree").alias("root"), "id", (F.col("place") - 1).alias("place"))  # the root is first

    body = F.concat_ws("\n\n", F.nullif(F.col("intro"), F.lit("")), F.nullif(F.col("blocks"), F.lit("")))
    # texts come last: they are dealt by their element once and stay there
    chapters = elements.join(places, ["root", "id"]).join(units, "root").join(block_texts(responses), F.col("id") == F.col("element"), "left").withColumn("text", body)
    chapters = chapters.filter(T.size("text") >= 40)
    locator = F.when(F.col("title") != "", F.col("title")).otherwise(T.strip(F.concat(F.lit("Abschnitt "), F.col("shown"))))
    return about.unionByName(_documents(chapters, 1, "unit_n", "place", course_ref=course_ref, activity_ref=ref("id"), title=F.col("module"), locator=locator, text=F.col("text")))


def block_texts(responses: DataFrame) -> DataFrame:
    """What the blocks of each element say (``element``, ``blocks``), in order of containers and places."""
    containers = items(responses, r"^/courseware-structural-elements/([^/?]+)/containers", "containers", "element").select("element", "n", _at("id").alias("container"))
    blocks = items(responses, r"^/courseware-containers/([^/?]+)/blocks", "blocks", "container")
    blocks = blocks.filter(links.not_false(F.get_json_object("item", "$.attributes.visible").try_cast("boolean")))
    # one list of one row: its texts are made once, also where filters and joins ask for them
    blocks = blocks.select("container", F.inline_outer(F.array(F.struct(
        F.coalesce(_at("attributes.position").try_cast("int"), F.lit(0)).alias("position"), _at("id").alias("id"),
        F.coalesce(F.get_json_object("item", "$.attributes['block-type']"), F.lit("")).alias("kind"), T.strip(_at("attributes.title")).alias("title"),
        T.strip_html(payload_text(F.get_json_object("item", "$.attributes.payload"))).alias("said"),
    ))))
    title, said = F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("said"), F.lit(""))
    kind = F.when(F.col("kind") == "test", "Selbsttest").otherwise(F.col("kind"))
    piece = F.when(F.col("kind").isin(*REFERENCE_BLOCKS), F.when(title.isNotNull(), F.concat(F.lit("["), kind, F.lit(": "), title, F.lit("]")))).otherwise(F.concat_ws("\n", title, said))
    own = containers.join(blocks, "container").withColumn("piece", piece).filter("piece <> ''")
    # a chapter's blocks: at most the caps of containers times blocks
    return own.groupBy("element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "position", "id", "piece"))), lambda x: x["piece"]), "\n\n").alias("blocks"))


def studip_documents(responses: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """All documents of the courses: wiki, Courseware, descriptions, news, files.

    ``units(course, file_id, unit, locator, text, error)`` are the units of the
    files that were fetched. ``rank`` tells the source, ``ord`` the order in it.
    """
    one = _COURSE + "$"
    courses = _good(responses).filter(F.col("route").rlike(one)).select(F.regexp_extract("route", one, 1).alias("course"), F.get_json_object("body", "$.data.attributes").alias("a"))
    courses = courses.select("course", F.coalesce(F.get_json_object("a", "$.title"), F.lit("Veranstaltung")).alias("name"), "a")
    course_ref = _ref("studip", F.col("course"))
    item_ref = lambda kind: _ref("studip", F.col("course"), kind, F.col("id"))
    said = lambda rows: rows.select("course", "n", _at("id").alias("id"), T.strip_html(_at("attributes.content")).alias("text"), T.strip_html(F.coalesce(F.nullif(_at("attributes.name"), F.lit("")), _at("attributes.title"))).alias("title"))
    titled = lambda other: F.when(F.col("title") != "", F.col("title")).otherwise(other)
    wiki = said(items(responses, _COURSE + "/wiki-pages", "wiki-pages", "course")).filter(T.size("text") >= 40)
    news = said(items(responses, _COURSE + "/news", "news", "course")).filter("text <> ''")
    parts = [
        _documents(wiki, 0, "n", course_ref=course_ref, activity_ref=item_ref("wiki"), title=titled("Wiki-Seite"), text=F.col("text")),
        courseware(responses),
        _documents(news, 3, "n", course_ref=course_ref, activity_ref=item_ref("news"), title=titled("Ankündigung"), text=F.col("text")),
    ]
    for n, (field, label) in enumerate((("description", "Beschreibung"), ("sub-title", "Untertitel"))):
        about = courses.withColumn("text", T.strip_html(F.coalesce(F.get_json_object("a", f"$['{field}']"), F.lit("")))).withColumn("n", F.lit(n)).filter(T.size("text") >= 40)
        parts.append(_documents(about, 2, "n", course_ref=course_ref, activity_ref=_ref("studip", F.col("course"), field), title=F.concat("name", F.lit(f" — {label}")), text=F.col("text")))
    if units is not None:
        read = files.unit_documents(units).join(studip_wanted(responses), ["course", "file_id"])
        parts.append(_documents(read, 4, "n", "unit", course_ref=course_ref, activity_ref=_ref("studip", F.col("course"), "file", F.col("file_id")), title=F.col("name"), locator=F.col("locator"), text=F.col("text"), folder=F.col("folder"), licence=F.col("licence")))
    named = courses.select(course_ref.alias("course_ref"), "name")
    return reduce(DataFrame.unionByName, parts).join(named, "course_ref").withColumn("course_name", F.col("name")).select(*DOCUMENT_COLUMNS)


# ---- Moodle

_SECTIONS = "ARRAY<STRUCT<id: STRING, name: STRING, summary: STRING, modules: ARRAY<STRUCT<id: STRING, name: STRING, modname: STRING, description: STRING, contents: ARRAY<STRUCT<type: STRING, filename: STRING, fileurl: STRING, mimetype: STRING>>>>>>"
_COURSES = "ARRAY<STRUCT<id: STRING, fullname: STRING, summary: STRING>>"


def moodle_error(body: Column) -> Column:
    """What the web service says went wrong, null if nothing did."""
    told = F.coalesce(F.get_json_object(body, "$.message"), F.get_json_object(body, "$.exception"))
    return F.when(F.get_json_object(body, "$.exception").isNotNull(), told)


def moodle_modules(responses: DataFrame) -> DataFrame:
    """Modules of courses: (course, section_n, section, module_n, module)."""
    route = r"^core_course_get_contents\?courseid=(.+)$"
    sections = _good(responses).filter(F.col("route").rlike(route) & moodle_error(F.col("body")).isNull())
    sections = sections.select(F.regexp_extract("route", route, 1).alias("course"), F.posexplode(F.from_json("body", _SECTIONS)).alias("section_n", "section"))
    return sections.select("course", "section_n", "section", F.posexplode_outer("section.modules").alias("module_n", "module"))


def moodle_files(responses: DataFrame) -> DataFrame:
    """Files of modules that can be read: (course, section_n, module_n, file_n, activity_ref, name, mime, url, folder)."""
    rows = moodle_modules(responses).select("course", "section_n", "module_n", T.strip_html(F.coalesce("section.name", F.lit(""))).alias("folder"), F.col("module.id").alias("id"), F.coalesce(F.nullif(F.col("module.modname"), F.lit("")), F.lit("resource")).alias("modname"), F.posexplode("module.contents").alias("file_n", "f"))
    rows = rows.filter("f.type = 'file' AND f.fileurl IS NOT NULL").select("*", F.coalesce("f.filename", F.lit("")).alias("name"), F.coalesce("f.mimetype", F.lit("")).alias("mime"), F.col("f.fileurl").alias("url"))
    rows = rows.filter(links.extractable_by_name(F.col("name"), "moodle"))
    return rows.select("course", "section_n", "module_n", "file_n", _ref("moodle", F.col("course"), "file", F.col("id"), F.col("modname"), F.col("name")).alias("activity_ref"), "name", "mime", "url", "folder")


def moodle_documents(responses: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """All documents of the courses: summary, sections, modules and their files (``units(url, unit, locator, text, error)``), in nesting order."""
    listed = _good(responses).filter((F.col("route") == "core_course_get_courses") & moodle_error(F.col("body")).isNull()).select(F.explode(F.from_json("body", _COURSES)).alias("c"))
    courses = listed.select(F.col("c.id").alias("course"), T.strip_html(F.coalesce("c.fullname", F.lit(""))).alias("name"), T.strip_html(F.coalesce("c.summary", F.lit(""))).alias("text")).dropDuplicates(["course"])
    modules = moodle_modules(responses)
    wanted = modules.select("course").distinct()
    course_ref = _ref("moodle", F.col("course"))
    titled = lambda c, other: F.when(c != "", c).otherwise(other)
    plain = lambda c: T.strip_html(F.coalesce(c, F.lit("")))
    zeros = lambda rows, *names: rows.select("*", *[F.lit(0).alias(n) for n in names])
    order = ("section_n", "level", "module_n", "file_n", "unit")
    own = zeros(courses.join(wanted, "course").filter("text <> ''"), *order)
    sections = modules.select("course", "section_n", "section").distinct().select("course", "section_n", plain("section.name").alias("title"), plain("section.summary").alias("text"), F.col("section.id").alias("id"))
    sections = zeros(sections.filter("text <> ''"), "level", "module_n", "file_n", "unit")
    active = modules.filter("module IS NOT NULL").select("course", "section_n", "module_n", plain(F.col("module.name")).alias("title"), plain(F.col("module.description")).alias("text"), F.col("module.id").alias("id"), F.coalesce("module.modname", F.lit("")).alias("modname"))
    active = zeros(active.filter("text <> ''").withColumn("level", F.lit(1)), "file_n", "unit")
    parts = [
        _documents(own, 0, *order, course_ref=course_ref, activity_ref=_ref("moodle", F.col("course"), "course"), title=titled(F.col("name"), "Kursbeschreibung"), text=F.col("text")),
        _documents(sections, 1, *order, course_ref=course_ref, activity_ref=_ref("moodle", F.col("course"), "section", F.col("id")), title=titled(F.col("title"), "Abschnitt"), text=F.col("text")),
        _documents(active, 1, *order, course_ref=course_ref, activity_ref=_ref("moodle", F.col("course"), "module", F.col("id"), F.col("modname")), title=titled(F.col("title"), "Aktivität"), text=F.col("text")),
    ]
    if units is not None:
        read = files.unit_documents(units).join(moodle_files(responses).withColumn("file_n", F.col("file_n") + 1), "url").withColumn("level", F.lit(1))
        parts.append(_documents(read, 1, *order, course_ref=course_ref, activity_ref=F.col("activity_ref"), title=F.col("name"), locator=F.col("locator"), text=F.col("text"), folder=F.col("folder")))
    named = courses.select(course_ref.alias("course_ref"), "name")
    return reduce(DataFrame.unionByName, parts).join(named, "course_ref", "left").withColumn("course_name", F.coalesce("name", F.lit(""))).select(*DOCUMENT_COLUMNS)


# ---- ILIAS


def soap_envelope(operation: str, params: list[tuple[str, object]]) -> str:
    """The request for one operation."""
    from xml.sax.saxutils import escape

    body = "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in params)
    return f'<?xml version="1.0" encoding="utf-8"?><SOAP-ENV:Envelope xmlns:SOAP-ENV="http://schemas.xmlsoap.org/soap/envelope/" xmlns:ns1="urn:ilUserAdministration"><SOAP-ENV:Body><ns1:{operation}>{body}</ns1:{operation}></SOAP-ENV:Body></SOAP-ENV:Envelope>'


def soap_result(reply: Column) -> tuple[Column, Column]:
    """The first child's text of a reply, and the fault if there is one."""
    fault = F.regexp_extract(reply, r"(?s)<faultstring>(.*?)</faultstring>", 1)
    found = r"(?s)<ns1:\w+Response>\s*<(\w+)[^>]*>(.*?)</\1>"
    bad = F.when(reply.contains("<faultstring>"), T.strip(T.entities(fault))).when(~reply.rlike(found), "unrecognised reply")
    return F.when(bad.isNull(), T.entities(F.regexp_extract(reply, found, 2))), bad


def ilias_course(xml: Column) -> dict[str, Column]:
    """Title, description, syllabus and important information of a course."""
    at = lambda path: T.strip_html(F.coalesce(F.xpath_string(xml, F.lit(f"/*/{path}")), F.lit("")))
    return {"title": at("MetaData/General/Title"), "description": at("MetaData/General/Description"), "syllabus": at("Settings/Syllabus"), "important": at("Settings/ImportantInformation")}


_OBJECTS = "Object ARRAY<STRUCT<_type: STRING, _obj_id: STRING, Title: STRING, Description: STRING, References: ARRAY<STRUCT<_ref_id: STRING>>>>"


def ilias_children(replies: DataFrame) -> DataFrame:
    """Objects of tree replies (``tree``, ``parent``, ``xml``): (tree, parent, n, id, type, title, description)."""
    rows = replies.select("tree", "parent", F.posexplode(F.from_xml("xml", F.lit(_OBJECTS))["Object"]).alias("n", "o"))
    blank = lambda c: T.strip_html(F.coalesce(c, F.lit("")))
    return rows.select("tree", "parent", "n", F.coalesce(F.get("o.References", F.lit(0))["_ref_id"], F.lit("")).alias("id"), F.coalesce("o._type", F.lit("")).alias("type"), blank(F.col("o.Title")).alias("title"), blank(F.col("o.Description")).alias("description"))


def ilias_file(xml: Column) -> tuple[Column, Column, Column, Column]:
    """File name, title, content of the last stored version, and an error for a mode that was not asked for."""
    name = T.strip_html(F.coalesce(F.xpath_string(xml, F.lit("/*/Filename")), F.lit("")))
    title = T.strip_html(F.coalesce(F.xpath_string(xml, F.lit("/*/Title")), F.lit("")))
    other = F.filter(F.xpath(xml, F.lit("//Version[normalize-space(text()) != '']/@mode")), lambda m: ~F.upper(m).isin("", "PLAIN"))
    texts = F.filter(F.transform(F.xpath(xml, F.lit("//Version/text()")), T.strip), lambda t: t != "")
    content = F.when(F.size(other) == 0, F.try_to_binary(F.try_element_at(texts, F.lit(-1)), F.lit("base64")))
    return name, F.when(title != "", title).otherwise(name), content, F.when(F.size(other) > 0, F.concat(F.lit("content mode not supported: "), F.get(other, F.lit(0))))


#: Fields of a course and how they are titled.
_FIELDS = (("description", "Beschreibung"), ("syllabus", "Inhalt"), ("important", "Wichtige Informationen"))


def ilias_documents(courses: DataFrame, children: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """All documents of courses ``(tree, xml)``, whose objects are ``children`` (of :func:`ilias_children`).

    ``units(tree, id, filename, name, unit, locator, text, error)`` are the units of their files.
    """
    told = courses.select(F.col("tree"), *[c.alias(k) for k, c in ilias_course(F.col("xml")).items()])
    name = F.when(F.col("title") != "", F.col("title")).otherwise("Kurs")
    course_ref = _ref("ilias", F.col("tree"))
    parts = []
    for n, (field, label) in enumerate(_FIELDS):
        about = told.filter(T.size(field) >= 40).withColumn("n", F.lit(n))
        parts.append(_documents(about, 0, "n", course_ref=course_ref, activity_ref=_ref("ilias", F.col("tree"), field), title=F.concat(name, F.lit(f" — {label}")), text=F.col(field)))
    nodes = children.dropDuplicates(["tree", "id"])
    roots = told.select("tree", F.col("tree").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("crs").alias("type"), F.lit("").alias("title"))
    objects = kept(nodes.select("tree", "id", "parent", "type", "title", F.col("n").alias("position")).unionByName(roots.withColumn("position", F.lit(0))))
    walked = trees.folder_walk(objects).filter("depth > 0").select("tree", "id", "folder")
    places = trees.reading_order(objects)  # an object, then all that is in it
    placed = nodes.join(walked, ["tree", "id"]).join(places, ["tree", "id"])
    object_ref = _ref("ilias", F.col("tree"), "obj", F.col("id"))
    floor = F.when(F.col("type").isin("fold", "grp", "cat", "crs", "itgr"), 1).otherwise(40)
    spoken = placed.filter((F.col("type") != "file") & (T.size("description") >= floor))
    parts.append(_documents(spoken, 1, "place", course_ref=course_ref, activity_ref=object_ref, title=F.col("title"), text=F.col("description"), folder=F.col("folder")))
    if units is not None:
        read = units.filter(F.col("error").isNull() & links.extractable_by_name(F.col("filename"), "ilias")).withColumn("text", T.collapse("text")).filter(T.size("text") >= 15).join(placed.filter("type = 'file'"), ["tree", "id"])
        parts.append(_documents(read, 1, "place", "unit", course_ref=course_ref, activity_ref=_ref("ilias", F.col("tree"), "file", F.col("id"), F.col("filename")), title=F.col("name"), locator=F.col("locator"), text=F.col("text"), folder=F.col("folder")))
    named = told.select(course_ref.alias("course_ref"), name.alias("name"))
    return reduce(DataFrame.unionByName, parts).join(named, "course_ref").withColumn("course_name", F.col("name")).select(*DOCUMENT_COLUMNS)


# ---- files beside the platforms


def read_course(spark: SparkSession, path: str) -> DataFrame:
    """Index requests kept as JSON files, a row a file: (``body``), as they would be posted."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def read_settings(text: str) -> dict[str, str]:
    """Settings of a file of ``NAME=value`` lines; blank lines and comments are passed over, quotes taken off."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().partition("=")
        if sign and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("\"'"))
    return out


def course_profile(documents: DataFrame) -> DataFrame:
    """Documents and characters of each kind in each course, a column a kind."""
    kinds = ("wiki", "courseware", "description", "sub-title", "news", "file")
    kind = F.split_part(F.col("activity_ref"), F.lit(":"), F.lit(3))
    of = lambda k: F.sum((kind == k).cast("bigint"))
    return documents.groupBy("course_ref").agg(*[of(k).alias(k.replace("-", "_")) for k in kinds], F.sum(T.size("text")).alias("characters"))

