"""The index on disk: one Parquet table, partitioned by course and batch.

A batch's chunks, the blocks of its terms and documents and its vectors are rows
of one table, told apart by ``kind`` and laid out in files of one kind sorted by
term, so that readers pass over the rest. One write puts all of them there at
once and in place of what this batch of a course had before: a batch that is
tried again replaces itself and nothing else. All statistics are sums over
batches, so none has to be kept up to date. Chunks are numbered within their
batch; their number within the course is what the batches before it hold, added
when they are read.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, vector
from ..schema import CHUNK, INDEX

#: So many chunks of a course go to one task and file, whatever the size of the index.
PART = 1 << 12
#: The batch that a course begins with; later ones begin with LATE and so come behind it.
BASE, LATE = "0", "1-"


def _shaped(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind as the table has them."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(kind if f.name == "kind" else None).cast(f.dataType).alias(f.name) for f in INDEX.fields))


class IndexStore:
    """A table under one folder; ``provider`` embeds texts where vectors are wanted."""

    def __init__(self, spark: SparkSession, path: str, provider: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.path, self.provider = spark, path, provider

    def _hadoop(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join((self.path, "index", *parts)))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    # ---- reading

    def rows(self, kind: str) -> DataFrame:
        """The rows of one kind; an index that does not exist is empty."""
        fs, at = self._hadoop()
        if not fs.exists(at):
            return self.spark.createDataFrame([], INDEX).filter(F.col("kind") == kind)
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index").filter(F.col("kind") == kind)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``place`` get their ``chunk_ord``: a batch begins where those before it end (a row a batch of a course is broadcast; texts are not dealt for it)."""
        own = Window.partitionBy("course_ref").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
        begins = self.rows("batch").select(F.col("course_ref").alias("_course"), F.col("batch").alias("_batch"), F.coalesce(F.sum("n").over(own), F.lit(0)).alias("_from"))
        same = F.col("course_ref").eqNullSafe(F.col("_course")) & (F.col("batch") == F.col("_batch"))
        return rows.join(F.broadcast(begins), same).withColumn("chunk_ord", F.col("_from") + F.col("place")).drop("_course", "_batch", "_from")

    def read(self) -> DataFrame:
        """All chunks."""
        return self._numbered(self.rows("chunk")).select(*CHUNK.fieldNames())

    def postings(self) -> DataFrame:
        """(course_ref, chunk_ord, term, tf, len) of all chunks."""
        hits = self.rows("term").select("course_ref", "batch", "block", "term", F.inline("hits")).withColumn("place", F.col("block") * lexical.BLOCK + F.col("slot"))
        return self._numbered(hits).select("course_ref", "chunk_ord", "term", "tf", "len")

    def vectors(self) -> DataFrame:
        """(course_ref, chunk_ord, doc_id, vector) of all chunks that were embedded."""
        return self._numbered(self.rows("vector")).select("course_ref", "chunk_ord", "doc_id", "vector")

    def sizes(self) -> DataFrame:
        """(course_ref, n): chunks of each course, without reading them."""
        return self.rows("batch").groupBy("course_ref").agg(F.sum("n").alias("n"))

    def document_frequency(self) -> DataFrame:
        """(course_ref, term, df): chunks of a course that hold a term, without reading postings."""
        return self.rows("term").groupBy("course_ref", "term").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("df"))

    def searched(self) -> DataFrame:
        """(course_ref, chunks): chunks of each course that hold a term, without reading postings."""
        blocks = self.rows("term").groupBy("course_ref", "batch", "block").agg(F.bit_or("bits").alias("bits"))
        return blocks.groupBy("course_ref").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("chunks"))

    def searchable(self) -> lexical.Searchable:
        """What a search by words reads."""
        terms = self.rows("term").select("course_ref", "batch", "term", "block", "bits", "top", "hits")
        documents = self.rows("document").select("course_ref", "batch", "doc_id", "block", "bits")
        return lexical.Searchable(terms, documents, self._numbered(self.rows("chunk")).select("batch", "place", *CHUNK.fieldNames()))

    # ---- writing

    def _write(self, rows: DataFrame) -> None:
        """Rows of the table, in place of what their batches had."""
        rows = rows.sortWithinPartitions("course_ref", "batch", "kind", "term", "block")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("course_ref", "batch").parquet(f"{self.path}/index")

    def _linked(self, other: IndexStore, more: DataFrame | None) -> bool:
        """Give the files of another index a second name here, with ``more`` rows beside them, where one disk holds both and nothing is here yet; whether that could be done.

        Files are never changed once they are written, only put in place of each
        other and deleted: what one index does then is not seen in the other.
        """
        (fs, at), (held_fs, held) = self._hadoop(), other._hadoop()
        if fs.exists(at) or {x.getUri().getScheme() for x in (fs, held_fs)} != {"file"}:
            return False
        own, source = at.toUri().getPath(), held.toUri().getPath()
        aside = f"-{uuid.uuid4().hex}"
        try:
            shutil.copytree(source, own + aside, copy_function=os.link, ignore=shutil.ignore_patterns("_*", "._*"))
            if more is not None:
                more.write.mode("append").option("compression", "zstd").partitionBy("course_ref", "batch").parquet(at.toString() + aside)
            os.rename(own + aside, own)
        except OSError:  # another disk, or one without links
            return False
        finally:
            shutil.rmtree(own + aside, ignore_errors=True)
        return True

    def copy(self, other: IndexStore) -> None:
        """Take over all that another index holds, as it is stored: no text is read into terms again, and on one disk no file is written again.

        With a provider, the chunks of an index without vectors get theirs.
        """
        fs, at = other._hadoop()
        if not fs.exists(at):
            return
        more = None
        if self.provider and other.rows("vector").isEmpty():
            documents = T.doc_id("activity_ref").alias("doc_id")
            more = _shaped(vector.embedded(other.rows("chunk").select("course_ref", "batch", "place", documents, "text"), self.provider).drop("text"), "vector")
        if not self._linked(other, more):
            rows = self.spark.read.schema(INDEX).parquet(f"{other.path}/index")
            rows = rows if more is None else rows.unionByName(more)
            parts = other.rows("batch").agg(F.sum(F.ceil(F.col("n") / PART))).first()[0] or 0
            part = F.floor(F.coalesce("place", F.col("block") * lexical.BLOCK, F.lit(0)) / PART)
            self._write(rows.repartition(max(1, 2 * parts), "course_ref", "batch", "kind", part))

    def _put(self, chunks: DataFrame, batch: str) -> set[str | None]:
        """Write a batch in one go, in place of what it had; the courses that it names."""
        fs, at = self._hadoop("..", f"incoming-{uuid.uuid4().hex}")
        aside = at.toString()
        chunks.select(*CHUNK.fieldNames()).write.option("compression", "zstd").parquet(aside)  # four kinds of rows come from it
        self.spark.sparkContext._jvm.System.gc()  # what was shuffled to make them goes before they are dealt
        chunks = self.spark.read.schema(CHUNK).parquet(aside)
        block = F.floor(F.col("chunk_ord") / lexical.BLOCK)
        sizes = chunks.groupBy("course_ref", block.alias("b")).agg(F.coalesce(F.bit_count(F.bit_or(lexical._bit())), F.lit(0)).alias("own"), F.count(F.lit(1)).alias("rows"), F.max("chunk_ord").alias("last"), F.min("chunk_ord").alias("first"))
        sizes = sizes.groupBy("course_ref").agg(F.sum("own").alias("n"), (F.sum("rows") == F.sum("own")).alias("apart"), (F.max("last") + 1).alias("end"), F.min("first").alias("first")).collect()  # a row a course of the batch
        odd = [r.course_ref for r in sizes if not r.apart or r.first != 0 or r.end != r.n]
        if odd:
            fs.delete(at, True)
            raise ValueError(f"chunks of {odd[:5]} are not numbered from 0 without gaps")
        # dealt once, by parts of courses; all kinds of rows are made and written where their part lies
        parts = sum(-(-r.n // PART) for r in sizes)
        # (what is no key is one column that all of them read: else each would deal its own columns of the texts)
        own = [c for c in CHUNK.fieldNames() if c not in ("course_ref", "chunk_ord")]
        dealt = chunks.select("course_ref", F.floor(F.col("chunk_ord") / PART).alias("part"), "chunk_ord", F.array(F.struct(*own)).alias("row")).repartition(max(1, 2 * parts), "course_ref", "part")
        part = lambda *names: dealt.select("course_ref", "part", "chunk_ord", *(F.get(F.transform("row", lambda r: r[c]), F.lit(0)).alias(c) for c in names))  # noqa: B023, E731
        kinds = {
            "chunk": dealt.select("course_ref", F.col("chunk_ord").alias("place"), F.inline("row")),
            "term": lexical.term_blocks(part("text"), "part"),
            "document": lexical.document_blocks(part("activity_ref")),
            "batch": self.spark.createDataFrame([(r.course_ref, r.n) for r in sizes], "course_ref string, n long").coalesce(1),
        }
        if self.provider:
            documents = T.doc_id("activity_ref").alias("doc_id")
            kinds["vector"] = vector.embedded(part("activity_ref", "text").select("course_ref", F.col("chunk_ord").alias("place"), documents, "text"), self.provider).drop("text")
        rows = None
        for kind, own in kinds.items():
            own = _shaped(own.withColumn("batch", F.lit(batch)), kind)
            rows = own if rows is None else rows.unionByName(own)
        self._write(rows)
        fs.delete(at, True)
        self.spark.sparkContext._jvm.System.gc()
        return {r.course_ref or None for r in sizes}

    def replace(self, chunks: DataFrame, courses: list[str] | None = None) -> None:
        """Put these courses' chunks in place of what they had; courses named besides that have none are forgotten.

        Their first batch changes at once; batches appended before go after that,
        so a try that stops half-way leaves the new chunks, and the next one ends it.
        """
        old = {(r.course_ref, r.batch) for r in self.rows("batch").select("course_ref", "batch").filter(F.col("batch") != BASE).collect()}  # a row a late batch
        named = self._put(chunks, BASE)
        for course, batch in old:
            if course in named:
                self._drop(course, batch)
        for course in courses or []:
            if (course or None) not in named:
                self.forget(course)

    def append(self, chunks: DataFrame, batch: str | None = None) -> None:
        """Add chunks, numbered from 0, behind those that the courses have.

        A ``batch`` that is tried again takes its own place; the name must tell it
        from all others (a stream's holds the id of its query). Batches lie in the
        order of their names.
        """
        self._put(chunks, LATE + (batch or uuid.uuid4().hex))

    def _drop(self, course: str | None, batch: str | None = None) -> None:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        parts = [f"course_ref={escape(course)}" if course else "course_ref=__HIVE_DEFAULT_PARTITION__", *([f"batch={escape(batch)}"] if batch else [])]
        fs, at = self._hadoop(*parts)
        fs.delete(at, True)

    def forget(self, course_ref: str | None) -> int:
        """Drop a course; how many chunks it had (0 if unknown)."""
        own = F.col("course_ref") == course_ref if course_ref else F.col("course_ref").isNull()  # stored alike
        n = self.rows("batch").filter(own).agg(F.sum("n")).first()[0] or 0
        self._drop(course_ref)
        return n

    # ---- searching

    def search(self, queries: DataFrame) -> DataFrame:
        """Ranked passages by words."""
        return lexical.search(self.searchable(), queries)

    def search_vectors(self, queries: DataFrame, *, k: int = 4, floor: float = vector.FLOOR) -> DataFrame:
        """Ranked chunks by vectors."""
        return vector.search(self.vectors().withColumnRenamed("chunk_ord", "ord"), queries, k=k, floor=floor)
