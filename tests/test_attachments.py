"""Scans and recordings of requests: what is decoded, stored, planned and read."""

import base64
import json

from pyspark.sql import functions as F

from scriptorium.operators import attachments, ingest

PNG = b"\x89PNG\r\n\x1a\n"


def code(content):
    return base64.b64encode(content).decode()


def entry(content, **more):
    return {"activity_ref": "f", "title": "t", "content_base64": code(content), **more}


def requests(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "n long, body string")


def test_what_cannot_be_decoded_goes(spark):
    wrapped = code(PNG + b"x" * 90)
    wrapped = "\n".join(wrapped[i : i + 20] for i in range(0, len(wrapped), 20))
    scans = [entry(b"%PDF-1"), {"content_base64": wrapped, "pages": [2, 3]}, {"content_base64": "A"}, {"title": "none"}, "text", 7, None, entry(b"%PDF-1", title=None)]
    raw = requests(spark, {"course_ref": "c", "scans": scans, "media": [entry(b"sound", title="")]}, {"course_ref": "", "scans": scans}, {"course_ref": "d"}, "no json", None)
    got = attachments.attachments(raw, order="n").orderBy("kind", "n").collect()
    assert [(r.kind, r.n, r.title, bytes(r.content), r.wanted) for r in got] == [("media", 0, "Aufnahme", b"sound", None), ("scan", 0, "t", b"%PDF-1", None), ("scan", 1, "Scan", PNG + b"x" * 90, [2, 3]), ("scan", 7, "Scan", b"%PDF-1", None)]
    assert len({r.key for r in got}) == 3


def test_files_are_kept_once_and_read_once(spark, tmp_path):
    pdf, image = b"%PDF three pages", PNG + b"ein Bild mit genug Text"
    first = {"course_ref": "c", "scans": [entry(pdf, activity_ref="p"), entry(image, activity_ref="i"), entry(b"odd", activity_ref="o"), entry(b"%PDF bad", activity_ref="b")]}
    second = {"course_ref": "c", "scans": [entry(image, activity_ref="j"), entry(pdf, activity_ref="q", pages=[3, 1, 2])]}
    found = attachments.attachments(requests(spark, first, second, {"course_ref": "d", "scans": [entry(pdf)]}), order="n")
    blobs = str(tmp_path / "blobs")
    for _ in range(2):
        attachments.put_blobs(spark, blobs, found)
    stored = attachments.read_blobs(spark, blobs)
    assert sorted(bytes(r.content) for r in stored.collect()) == sorted([pdf, image, b"odd", b"%PDF bad"])

    def pages_of(content):
        if b"bad" in content:
            raise RuntimeError("no page count")
        return 3, [1, 3]

    counts = attachments.counted(stored, pages_of)
    plan = {(r.course_ref, r.activity_ref): r for r in attachments.planned(found, counts, 5).collect()}
    assert {k: (r.read, r.skipped, r.error) for k, r in plan.items()} == {
        ("c", "p"): ([1, 3], 0, None),
        ("c", "i"): ([0], 0, None),
        ("c", "o"): ([], 0, "not an image format the reader accepts"),
        ("c", "b"): ([], 0, "no page count"),
        ("c", "j"): ([0], 0, None),
        ("c", "q"): ([3], 1, None),  # page 1 is past the budget, page 2 holds no image
        ("d", "f"): ([1, 3], 0, None),
    }
    calls = str(tmp_path / "calls")

    def reader(picture, mime):
        with open(calls, "a") as f:
            f.write(f"{mime} {picture[-20:]}\n")
        if picture.endswith(b"page 3"):
            raise RuntimeError("too dark")
        return picture.decode("latin-1") + " und noch etwas mehr Text"

    draw = lambda content, page: b"drawn page %d" % page
    planned = attachments.planned(found, counts, 5)
    cache = str(tmp_path / "cache")
    documents, fresh = attachments.scanned_texts(planned, stored, ingest.read_cache(spark, cache), reader, "r", draw=draw, at_once=1)
    fresh = spark.createDataFrame(fresh.collect(), fresh.schema)
    with open(calls) as f:
        assert len(f.readlines()) == 3  # two pages and an image, whoever sent them
    assert fresh.filter("error IS NOT NULL").count() == 1
    ingest.cache_put(spark, cache, fresh.filter("error IS NULL"))
    open(calls, "w").close()
    documents, again = attachments.scanned_texts(planned, stored, ingest.read_cache(spark, cache), reader, "r", draw=draw, at_once=1)
    assert sorted((r.course_ref, r.activity_ref, r.locator) for r in documents.collect()) == [("c", "i", ""), ("c", "j", ""), ("c", "p", "S. 1"), ("d", "f", "S. 1")]
    with open(calls) as f:
        assert {line.split(" ", 1)[1] for line in f} == {f"{b'drawn page 3'}\n"}  # only what failed is tried again
    assert again.filter(F.col("error").isNull()).count() == 0
