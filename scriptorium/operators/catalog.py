"""What is indexed: courses, their names, their documents, and who may see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PLATFORMS = ("studip", "moodle", "ilias")


def courses(chunks: DataFrame, platform: str | None = None) -> DataFrame:
    """Chunks of each course; only those of one platform if it is named."""
    if platform is not None:
        if platform not in PLATFORMS:
            raise ValueError(f"unknown platform {platform}")
        chunks = chunks.filter(T.namespace("course_ref") == platform)
    return chunks.groupBy("course_ref").agg(F.count(F.lit(1)).alias("chunks"))


def course_names(chunks: DataFrame) -> DataFrame:
    """The first name in index order that is not empty, '' if all are."""
    first = F.min_by("course_name", F.when(F.col("course_name") != "", F.col("chunk_ord")))
    any_name = F.max(F.col("course_name") != "")
    return chunks.groupBy("course_ref").agg(F.when(any_name, first).otherwise("").alias("course_name"))


def index_status(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of each wanted course, 0 where it is not indexed."""
    n = courses(chunks)
    return wanted.select("course_ref").distinct().join(n, "course_ref", "left").select("course_ref", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), F.col("chunks").isNotNull().alias("indexed"))


def documents(chunks: DataFrame) -> DataFrame:
    """Chunks grouped to documents: first title and folder, count, locators in order."""
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("locator") != "", F.struct("chunk_ord", "locator")))), lambda x: x["locator"])
    return chunks.groupBy("course_ref", "activity_ref").agg(
        F.min_by("title", "chunk_ord").alias("title"),
        F.min_by("folder", "chunk_ord").alias("folder"),
        F.count(F.lit(1)).alias("chunks"),
        F.array_distinct(seen).alias("locators"),
    ).withColumn("doc_id", T.doc_id("activity_ref"))


def visible(rows: DataFrame, mode: str, acl: DataFrame | None = None, username: str = "") -> DataFrame:
    """Rows of courses that a user may see; without a rule, none (fail closed)."""
    if mode == "all":
        return rows
    if mode == "allowlist" and acl is not None:
        own = acl.filter(F.col("username") == username.lower()).select("course_ref").distinct()
        return rows.join(own, "course_ref", "left_semi")
    return rows.limit(0)


def parse_allowlist(text: DataFrame) -> DataFrame:
    """``user=course,course;user=course`` to (username, course_ref); a malformed entry raises."""
    entry = text.select(F.explode(F.split("text", ";")).alias("e")).filter(T.strip("e") != "")
    user, refs = T.strip(F.lower(F.split_part(F.col("e"), F.lit("="), F.lit(1)))), F.split(F.regexp_replace("e", "^[^=]*=?", ""), ",")
    ref = F.filter(F.transform(refs, T.strip), lambda x: x != "")
    bad = ~F.col("e").contains("=") | (user == "") | (F.size(ref) == 0)
    fail = F.raise_error(F.concat(F.lit("malformed allowlist entry: "), F.col("e"))).cast("string")
    return entry.select(user.alias("username"), F.explode(F.when(bad, F.array(fail)).otherwise(ref)).alias("course_ref")).distinct()


def resolve(documents_: DataFrame, wanted: DataFrame, *, required: bool = False) -> DataFrame:
    """Ids of documents whose id, title or only non-positional locator is a wanted ``name``; with ``required``, none is an error.

    Names are joined under a collation that passes over case, so that ligatures,
    sharp s and final sigma meet what they fold to.
    """
    chapters = F.filter("locators", lambda x: ~T.positional(x))
    only = F.when((F.size("locators") == 1) & (F.size(chapters) == 1), F.get(chapters, F.lit(0)))
    keys = documents_.select("course_ref", "doc_id", F.explode(F.array("doc_id", "title", only)).alias("key")).filter("key is not null")
    key = lambda c: F.collate(F.replace(F.lower(T.strip(c)), F.lit("ß"), F.lit("ss")), "UNICODE_CI")
    names = wanted.select(key("name").alias("key")).distinct()
    found = keys.withColumn("key", key("key")).join(names, "key", "left_semi").select("course_ref", "doc_id").distinct()
    if required and not found.limit(1).count():
        raise LookupError("none of the named documents is indexed; search without naming any, or use their names")
    return found


def kind_label(locators: Column) -> Column:
    """How a listing names a document's parts."""
    of = lambda rx: F.size(F.filter(locators, lambda x: x.rlike(rx)))
    pages, slides = of(r"^S\. \d+$"), of(r"^Folie \d+$")
    return F.when(pages > 0, F.concat(pages.cast("string"), F.when(pages == 1, " Seite").otherwise(" Seiten"))).when(slides > 0, F.concat(slides.cast("string"), F.when(slides == 1, " Folie").otherwise(" Folien"))).when(of(r"^\d+(:\d+)?:\d{2}$") > 0, "Aufnahme").otherwise("")


def by_folder(documents_: DataFrame) -> DataFrame:
    """Documents of each group: the folder, or the title where a sole chapter has none."""
    only = (F.size("locators") == 1) & ~T.positional(F.get("locators", F.lit(0)))
    group = F.when(F.coalesce(only, F.lit(False)) & (F.col("folder") == ""), F.col("title")).otherwise(F.col("folder"))
    return documents_.withColumn("grp", group).groupBy("course_ref", "grp").agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"))


def merged_passages(hits: DataFrame, order: str = "rank") -> DataFrame:
    """Passages of one place joined by an ellipsis, in order of first sight."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return hits.groupBy("query_id", "activity_ref", "locator").agg(F.min(order).alias("first"), F.array_join(texts, " … ").alias("text"))
