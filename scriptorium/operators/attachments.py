"""What requests carry beside texts: scans and recordings, their bytes kept once by content, and the pages that are read of them.

A request's attachments are VARIANT values of its JSON. Bytes are decoded where
the request lies, named by their sha256, and stored beside the rows: the same
file sent twice is stored, counted and read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from . import ingest, providers

_META = ("activity_ref", "title", "licence", "course_name", "folder")
#: What a file without a title is called.
UNTITLED = {"scan": "Scan", "media": "Aufnahme"}


def attachments(raw: DataFrame, *, order: str | None = None) -> DataFrame:
    """Scans and recordings of valid requests (``body`` JSON): a row each.

    Columns: course_ref, ord (the request's ``order``), kind (``scan``, ``media``),
    n (place in the request), the file's attributes, ``wanted`` (page numbers or
    null), ``key`` and ``content``. Entries that are no object, or whose content
    is missing or cannot be decoded, go; the others stay.
    """
    parsed = raw.select(F.lit(0).alias("ord") if order is None else F.col(order).alias("ord"), F.from_json("body", "course_ref STRING, scans ARRAY<STRING>, media ARRAY<STRING>").alias("r")).filter(F.coalesce(F.col("r.course_ref"), F.lit("")) != "")
    one = lambda kind, field: parsed.select(F.col("r.course_ref").alias("course_ref"), "ord", F.lit(kind).alias("kind"), F.posexplode(f"r.{field}").alias("n", "entry"))
    rows = one("scan", "scans").unionByName(one("media", "media")).withColumn("v", F.try_parse_json("entry"))
    text = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit(""))
    code = F.regexp_replace(text("content_base64"), "[^A-Za-z0-9+/=]", "")  # line ends and blanks say nothing
    rows = rows.withColumn("content", F.try_to_binary(F.when(code != "", code), F.lit("base64")))
    title = F.when(text("title") != "", text("title")).when(F.col("kind") == "scan", UNTITLED["scan"]).otherwise(UNTITLED["media"])
    meta = [text(c).alias(c) if c != "title" else title.alias("title") for c in _META]
    wanted = F.try_variant_get("v", "$.pages", "array<int>").alias("wanted")
    return rows.filter("content IS NOT NULL").select("course_ref", "ord", "kind", "n", *meta, wanted, F.sha2("content", 256).alias("key"), "content")


def put_blobs(spark: SparkSession, path: str, found: DataFrame) -> None:
    """Store the content of attachments that the table at ``path`` lacks; a key tells its content, so a repeated one adds nothing."""
    fresh = found.select("key", "content").dropDuplicates(["key"])
    fresh.join(read_blobs(spark, path).select("key"), "key", "left_anti").write.mode("append").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(key, content) of all stored files, each once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, content binary")
    return spark.read.schema("key string, content binary").parquet(path).dropDuplicates(["key"])


def pdf_pages(content: bytes) -> tuple[int, list[int]]:
    """Pages of a PDF and those that hold images, by Poppler."""
    return providers.pdf_counts(providers.pdf_tool("pdfinfo", content=content).decode("utf-8", "replace"), providers.pdf_tool("pdfimages", "-list", content=content).decode("utf-8", "replace"))


def counted(blobs: DataFrame, pages_of: Callable[[bytes], tuple[int, list[int]]] = pdf_pages) -> DataFrame:
    """(key, mime, page_count, with_images, error) of stored files; an image is page 0, what is neither has an ``error``."""
    pdf = F.hex(F.substring("content", 1, 4)) == "25504446"
    mime = F.when(pdf, "application/pdf").otherwise(links.image_mime(F.col("content")))
    images = blobs.filter(~pdf).select("key", mime.alias("mime"), F.lit(0).alias("page_count"), F.array(F.lit(0)).alias("with_images"), F.when(links.image_mime(F.col("content")) == "", "not an image format the reader accepts").alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, content in zip(f["key"], f["content"], strict=True):
                try:
                    rows.append((key, "application/pdf", *pages_of(bytes(content)), None))
                except Exception as fault:  # one file costs itself only
                    rows.append((key, "application/pdf", 0, [], str(fault)[:200]))
            yield pd.DataFrame(rows, columns=["key", "mime", "page_count", "with_images", "error"])

    pdfs = blobs.filter(pdf).select("key", "content").mapInPandas(run, "key string, mime string, page_count int, with_images array<int>, error string")
    return images.unionByName(pdfs)


def planned(found: DataFrame, counts: DataFrame, budget: int) -> DataFrame:
    """Scans with the pages that are read of them (``read``), within the budget of pages of each request's course, and how many are skipped.

    Wanted pages without an image are passed over; a file that cannot be read
    has its ``error`` and takes nothing of the budget.
    """
    scans = found.filter("kind = 'scan'").drop("content").join(counts, "key")
    order = F.col("ord").cast("bigint") * F.lit(1 << 20) + F.col("n")  # requests in order, and their files
    scans = scans.withColumn("place", order)
    good = scans.filter("error IS NULL").withColumn("wanted", F.when(F.col("mime") == "application/pdf", F.col("wanted")).otherwise(F.array(F.lit(0))))
    good = ingest.pages_to_read(good, budget, order="place")
    return good.unionByName(scans.filter("error IS NOT NULL").withColumns({"take": F.lit(0).cast("bigint"), "skipped": F.lit(0).cast("bigint"), "read": F.array().cast("array<int>")}))


def scanned_texts(plan: DataFrame, blobs: DataFrame, cache: DataFrame, reader: Callable[[bytes, str], str], name: str, *, draw: Callable[[bytes, int], bytes] = providers.rendered, at_once: int = 2, floor: int = 15) -> tuple[DataFrame, DataFrame]:
    """Documents of the planned pages, and what was read for them now (``key``, ``text``, ``error``), for the cache.

    Each different page is read once, if the cache lacks it: pages of PDFs as
    pictures that ``draw`` makes, images as they are. ``name`` tells readers apart.
    """
    pages = plan.select("course_ref", *_META, F.col("key").alias("blob"), "mime", F.explode("read").alias("page"))
    pages = pages.withColumn("key", F.concat_ws(":", "blob", F.col("page").cast("string"), F.lit(name)))
    wanted = ingest.cache_misses(pages.select("key", "blob", "mime", "page").dropDuplicates(["key"]), cache)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, content, page, mime in zip(f["key"], f["content"], f["page"], f["mime"], strict=True):
                try:
                    image, kind = (draw(bytes(content), int(page)), "image/png") if page else (bytes(content), mime)
                    rows.append((key, reader(image, kind), None))
                except Exception as fault:  # one page costs itself only
                    rows.append((key, None, str(fault)[:150]))
            yield pd.DataFrame(rows, columns=["key", "text", "error"])

    held = wanted.join(blobs.withColumnRenamed("key", "blob"), "blob").select("key", "content", "page", "mime").repartition(at_once)
    fresh = held.mapInPandas(run, "key string, text string, error string")
    from ..functions import text as T

    fresh = fresh.withColumn("text", T.clean_ocr("text"))
    documents = ingest.read_texts(pages, cache, fresh.filter("error IS NULL"), floor)
    locator = F.when(F.col("page") > 0, F.concat(F.lit("S. "), F.col("page").cast("string"))).otherwise("")
    return documents.select("course_ref", "activity_ref", "title", locator.alias("locator"), "text", "course_name", "folder", "licence"), fresh
