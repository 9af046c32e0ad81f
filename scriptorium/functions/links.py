"""Links back into the learning platforms, and predicates on names and first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import quoted

# Suffixes of the readers.
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "bmp")
TEXTS = ("pdf", "docx", "pptx", "xlsx", "odt", "odp", "ods")
MOODLE_TEXTS = ("pdf", "doc", "docx", "odt", "ppt", "pptx", "odp", "xls", "xlsx", "ods", "txt", "md")
ILIAS_TEXTS = ("pdf", "docx", "pptx", "xlsx")
#: The most bytes that are sent to be read.
MOST_BYTES = {"pdf": 100 << 20, "image": 20 << 20, "media": 200_000_000, "body": 512 << 20}
RECORDINGS = ("mp3", "wav", "m4a", "ogg", "flac", "aac", "opus", "wma", "mp4", "mov", "webm", "mkv", "avi", "m4v")
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "424D": "image/bmp"}


def _suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(suffixes) + ")$")


def extractable(name: Column, mime: Column) -> Column:
    """A file whose text can be read; a MIME type may be cut short."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return _suffix(name, TEXTS) | m.contains("pdf") | m.contains("openxmlformats") | m.contains("officedocument") | m.contains("opendocument")


def extractable_by_name(name: Column, platform: str) -> Column:
    """The same on platforms that go by the name alone."""
    return _suffix(name, {"moodle": MOODLE_TEXTS, "ilias": ILIAS_TEXTS}[platform])


def within_cap(content: Column, kind: str) -> Column:
    """Whether content is small enough to be sent."""
    return F.octet_length(content) <= MOST_BYTES[kind]


def scan_wanted(content: Column) -> Column:
    """A PDF or an image the reader accepts, within its cap."""
    pdf = F.hex(F.substring(content, 1, 4)) == "25504446"
    return F.when(pdf, within_cap(content, "pdf")).otherwise((image_mime(content) != "") & within_cap(content, "image"))


def media_wanted(size: Column, downloadable: Column) -> Column:
    """A recording that may be fetched and is not too long to send; an unknown size is taken."""
    return not_false(downloadable) & (F.coalesce(size, F.lit(0)) <= MOST_BYTES["media"])


def transcribable(name: Column, mime: Column) -> Column:
    """A recording."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return _suffix(name, RECORDINGS) | m.startswith("audio/") | m.startswith("video/")


def image(name: Column, mime: Column) -> Column:
    """A pixel image."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return _suffix(name, IMAGES) | (m.startswith("image/") & ~m.contains("svg"))


def image_mime(content: Column) -> Column:
    """The kind of image that the first bytes show, '' if none."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, mime in MAGIC.items():
        out = out.when(head.startswith(magic), mime)
    return out.otherwise("")


def not_false(flag: Column) -> Column:
    """A flag that is missing or set."""
    return ~flag.eqNullSafe(F.lit(False))


def page_anchor(locator: Column) -> Column:
    n = F.regexp_extract(locator, r"^S\. (\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("#page="), n)).otherwise("")


def lms_link(activity: Column, locator: Column, *, studip: str = "", moodle: str = "", ilias: str = "", client: str = "") -> Column:
    """The address of an activity on its platform, '' if its base is unknown."""
    part = lambda i: F.coalesce(F.get(F.split(activity, ":"), F.lit(i)), F.lit(""))
    platform, course, kind, item, extra = (part(i) for i in range(5))
    qc, qi, qe = quoted(course), quoted(item), quoted(extra)
    base = {k: F.lit(v.rstrip("/")) for k, v in (("studip", studip), ("moodle", moodle), ("ilias", ilias))}
    at = lambda k, *parts: F.concat(base[k], *[F.lit(p) if isinstance(p, str) else p for p in parts])
    on_studip = (
        F.when((kind == "file") & (item != ""), at("studip", "/dispatch.php/file/details/", qi, "?cid=", qc))
        .when((kind == "courseware") & (item != "") & (extra != ""), at("studip", "/dispatch.php/course/courseware/courseware/", qe, "?cid=", qc, "#/structural_element/", qi))
        .when(kind == "courseware", at("studip", "/dispatch.php/course/courseware?cid=", qc))
        .otherwise(at("studip", "/dispatch.php/course/overview?cid=", qc))
    )
    module = kind.isin("file", "module") & (item != "")
    named = extra.rlike("^[a-z_]+$")
    on_moodle = (
        F.when(module & (extra == "resource"), at("moodle", "/mod/resource/view.php?id=", qi, "&redirect=1", page_anchor(locator)))
        .when(module & named, at("moodle", "/mod/", extra, "/view.php?id=", qi))
        .when(module, at("moodle", "/course/view.php?id=", qc, "#module-", qi))
        .otherwise(at("moodle", "/course/view.php?id=", qc))
    )
    tail = F.concat(F.lit("&client_id="), quoted(F.lit(client))) if client else F.lit("")
    on_ilias = F.when((kind == "file") & (item != ""), at("ilias", "/goto.php?target=file_", qi, tail, page_anchor(locator))).otherwise(at("ilias", "/goto.php?target=crs_", qc, tail))
    known = activity.contains(":")
    return (
        F.when(known & (platform == "studip") & F.lit(bool(studip)), on_studip)
        .when(known & (platform == "moodle") & F.lit(bool(moodle)), on_moodle)
        .when(known & (platform == "ilias") & F.lit(bool(ilias)), on_ilias)
        .otherwise("")
    )
