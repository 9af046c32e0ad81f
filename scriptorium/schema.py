"""Schemas of what comes in and what is stored."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType


def _strings(*names: str) -> StructType:
    out = StructType()
    for name in names:
        out = out.add(name, StringType())
    return out


#: An indexable unit: a page, slide, sheet, chapter or wiki page.
DOCUMENT = _strings("activity_ref", "title", "text", "locator", "course_name", "folder", "licence")
#: A request to index documents of one course.
REQUEST = StructType().add("course_ref", StringType()).add("replace", BooleanType()).add("documents", ArrayType(DOCUMENT)).add("scans", ArrayType(StringType())).add("media", ArrayType(StringType()))
#: A chunk, numbered within its course.
CHUNK = _strings("activity_ref", "title", "locator", "course_name", "folder", "licence", "text").add("chunk_ord", LongType()).add("course_ref", StringType())
#: A row of the stored index: a chunk (its text and attributes), a block of a term's postings or of a document's chunks
#: (``bits``: which chunks of the block), a chunk's vector, or a batch (``n`` chunks); partitioned by course and batch.
INDEX = (
    _strings("kind", "term", "doc_id", "activity_ref", "title", "locator", "course_name", "folder", "licence", "text")
    .add("place", LongType()).add("block", LongType()).add("bits", LongType()).add("top", DoubleType()).add("n", LongType())
    .add("hits", ArrayType(StructType().add("slot", IntegerType()).add("tf", LongType()).add("len", LongType())))
    .add("vector", ArrayType(DoubleType())).add("course_ref", StringType()).add("batch", StringType())
)
