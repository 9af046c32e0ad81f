"""Lexical retrieval: chunks, postings in blocks, and a batch of queries ranked at once.

Postings are made once, when chunks are indexed: a chunk's terms are counted
within its row. What is stored of a term is a row for each block of 64 neighbouring chunks: a bit for
each chunk that holds it, its greatest share of a chunk, and the postings
themselves. A search joins its terms with the blocks' heads once: document
filters, document frequencies and numbers of chunks are counts of bits, and
upper bounds of scores are sums of shares. The blocks with the best bounds are
scored first, their k-th score rules out blocks that cannot reach it, and only
the postings of the others are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..plans.scratch import kept

K = 4
RELATIVE_FLOOR = 0.25
RARE_SHARE = 0.6
ATTRIBUTES = ("activity_ref", "title", "locator", "folder", "course_name", "licence")
#: Chunks of a block: as many as a long has bits.
BLOCK = 64
#: Blocks of a query that are scored before any is ruled out.
FIRST = 8
#: Blocks that a search may meet before it takes bounds.
MANY_BLOCKS = 50_000
#: Queries that are held as literals and broadcast; more are written and joined as tables.
FEW_QUERIES, FEW_WORDS = 1_000, 100_000
#: So many passages of each of these are broadcast at most.
MOST = 100
#: So many numbers of the order share a part of a course.
PART = 1 << 14
#: Bytes of texts, as the planner knows them, that a task numbers; and blocks of postings that a task scores.
TASK_BYTES, TASK_BLOCKS = 16 << 20, 1 << 14


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by their keys: to so many tasks where the session's number of partitions would make fewer."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def _planned_bytes(df: DataFrame) -> int:
    """Bytes of a table as the planner has them; 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def chunked(corpus: DataFrame, order: str = "ord") -> DataFrame:
    """A row a chunk, numbered within its course in document order (``chunk_ord`` from 0, without gaps).

    Documents of equal order follow their reference and text, those without an
    order come last; a null course is a course. Sums run within parts of a
    course's order and then over the parts, so one large course is many tasks.
    """
    late = F.col(order).isNull()
    no = F.when(late, F.pmod(F.xxhash64("text"), F.lit(1024))).otherwise(F.floor(F.col(order) / PART)).cast("long")
    ties = [c for c in ("activity_ref", "locator") if c in corpus.columns]
    own = [c for c in corpus.columns if c != "text"]
    # a document's chunks as one column: what counts them and what numbers them read the same rows, packed and dealt once
    rows = F.transform(T.chunks("text"), lambda piece, pos: F.struct(*own, pos.alias("pos"), piece.alias("text")))
    packed = corpus.select(F.struct("course_ref", late.alias("late"), no.alias("no")).alias("_of"), F.struct(order, *ties, F.xxhash64("text")).alias("_order"), rows.alias("_rows"))
    packed = spread(packed, -(-_planned_bytes(corpus) // TASK_BYTES), "_of")
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = packed.withColumn("_before", so_far(F.size("_rows"), Window.partitionBy("_of").orderBy("_order")))
    parts = placed.groupBy("_of").agg(F.max(F.col("_before") + F.size("_rows")).alias("_all"))
    parts = parts.select(F.col("_of").alias("_part"), so_far("_all", Window.partitionBy("_of.course_ref").orderBy("_of")).alias("_base"))
    # a part is a value, also of the null course: both sides stay where they are
    pieces = placed.join(parts, F.col("_of") == F.col("_part")).select((F.col("_base") + F.col("_before")).alias("_from"), F.inline("_rows"))
    return pieces.withColumn("chunk_ord", (F.col("_from") + F.col("pos")).cast("bigint")).drop("_from")


def terms(chunks: DataFrame, *keep: str) -> DataFrame:
    """(course, chunk, document, term, tf, len): all search terms of chunks, counted; ``len`` is the number of the chunk's terms.

    A chunk is short, so its terms are counted within its row: nothing is
    shuffled, and a task holds no more than what comes after needs.
    """
    own = ("course_ref", "chunk_ord", *keep)
    # inline_outer: the list is made once; what is asked of it besides would be made again a term
    listed = chunks.select(*own, T.doc_id("activity_ref").alias("doc_id"), F.inline_outer(T.built("counted text", lambda: T.counted("text"))))
    return listed.filter("term IS NOT NULL").select(*own, "doc_id", "term", "tf", "len")


def postings(chunks: DataFrame, *keep: str) -> DataFrame:
    """(course, chunk, document, term) with its count; ``len`` is the number of the chunk's terms."""
    return terms(chunks, *keep)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and the greatest possible idf of each course."""
    return chunks.groupBy("course_ref").agg(F.count(F.lit(1)).alias("n")).withColumn("max_idf", F.log1p(F.col("n") / 2))


def document_frequency(chunks: DataFrame) -> DataFrame:
    """Chunks of a course that hold a term."""
    return terms(chunks).groupBy("course_ref", "term").agg(F.count(F.lit(1)).alias("df"))


# ---- blocks

def _block() -> Column:
    return F.floor(F.col("chunk_ord") / BLOCK)


def _slot() -> Column:
    return F.pmod(F.col("chunk_ord"), F.lit(BLOCK)).cast("int")


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _slot())


def term_blocks(chunks: DataFrame, *within: str) -> DataFrame:
    """(course, term, block): which chunks of a block hold a term, its greatest share of one, and the postings (64 at most).

    A block's chunks come together and its terms are told apart within its row.
    ``within`` names columns that a block has one value of: rows dealt by the
    course and these stay where they are.
    """
    counted = T.built("counted text", lambda: T.counted("text"))
    own = chunks.select("course_ref", *within, _block().alias("block"), F.struct(_slot().alias("slot"), counted.alias("terms")).alias("chunk"))
    blocks = own.groupBy("course_ref", *within, "block").agg(F.collect_list("chunk").alias("chunks"))
    return blocks.select("course_ref", "block", F.inline(T.built("chunks by term", lambda: T.by_term("chunks"))))


def document_blocks(chunks: DataFrame) -> DataFrame:
    """(course, document, block): which chunks of a block are a document's; chunks dealt by the course and a ``part`` stay where they are."""
    within = [c for c in ("part",) if c in chunks.columns]
    return chunks.groupBy("course_ref", *within, T.doc_id("activity_ref").alias("doc_id"), _block().alias("block")).agg(F.bit_or(_bit()).alias("bits")).drop(*within)


@dataclass
class Searchable:
    """What a search reads: blocks of terms and of documents, and the chunks, each with its course and batch.

    Chunks have a ``place`` within their batch, and ``chunk_ord`` within their course.
    """

    terms: DataFrame
    documents: DataFrame
    chunks: DataFrame


def searchable(chunks: DataFrame) -> Searchable:
    """Chunks that are in no index, as one batch."""
    one = lambda df: df.withColumn("batch", F.lit("0"))
    return Searchable(one(term_blocks(chunks)), one(document_blocks(chunks)), one(chunks.withColumn("place", F.col("chunk_ord"))))


@dataclass
class _Asked:
    """The terms of all queries: (query_id, course_ref, k, narrow, term, stem, qtf); and the documents that narrow some of them."""

    words: DataFrame
    narrow: DataFrame | None
    most: int
    courses: list[str] | None = None
    terms: list[str] | None = None
    few: bool = False

    def small(self, df: DataFrame) -> DataFrame:
        """A table of no more rows than there are words, or a few a query: broadcast where these are few (FEW_QUERIES, FEW_WORDS)."""
        return F.broadcast(df) if self.few else df

    def named(self, df: DataFrame) -> DataFrame:
        """Only the courses, and terms, that are asked for: the reader passes over other folders and row groups."""
        if self.courses and len(self.courses) <= 100:
            df = df.filter(F.col("course_ref").isin(self.courses))
        return df.filter(F.col("term").isin(self.terms)) if self.terms and len(self.terms) <= 200 and "term" in df.columns else df


def _asked(queries: DataFrame) -> _Asked:
    """Tokens of the queries, made once."""
    if "documents" not in queries.columns:
        queries = queries.withColumn("documents", F.lit(None).cast("array<string>"))
    documents = F.when(F.size("documents") > 0, F.col("documents")).alias("documents")
    q = queries.select("query_id", "course_ref", F.col("k").cast("int").alias("k"), documents, T.tokens("text").alias("tokens"))
    q = q.withColumn("stems", T.built("stems of tokens", lambda: F.transform("tokens", T.stem)))
    head = q.limit(FEW_QUERIES + 1).collect()
    if len(head) <= FEW_QUERIES and sum(len(r.tokens or ()) + len(r.documents or ()) for r in head) <= FEW_WORDS:
        head = [r for r in head if r.tokens and r.course_ref is not None]
        spark, kind = q.sparkSession, {c: q.schema[c].dataType for c in ("query_id", "course_ref")}
        schema = StructType([StructField("query_id", kind["query_id"]), StructField("course_ref", kind["course_ref"]), StructField("k", IntegerType()), StructField("narrow", BooleanType()), StructField("term", StringType()), StructField("stem", StringType()), StructField("qtf", LongType())])
        words = [(r.query_id, r.course_ref, r.k, bool(r.documents), *term, n) for r in head for term, n in Counter(zip(r.tokens, r.stems, strict=True)).items()]
        inside = [(r.query_id, r.course_ref, d) for r in head for d in sorted(set(r.documents or ()))]
        narrow = spark.createDataFrame(inside, StructType([schema["query_id"], schema["course_ref"], StructField("doc_id", StringType())])) if inside else None
        return _Asked(spark.createDataFrame(words, schema), narrow, max([r.k for r in head], default=0), sorted({r.course_ref for r in head}), sorted({w[4] for w in words}), True)
    q = kept(q.filter(F.size("tokens") > 0))
    words = q.select("query_id", "course_ref", "k", F.col("documents").isNotNull().alias("narrow"), F.inline(F.arrays_zip(F.col("tokens").alias("term"), F.col("stems").alias("stem")))).groupBy("query_id", "course_ref", "k", "narrow", "term", "stem").agg(F.count(F.lit(1)).alias("qtf"))
    return _Asked(words, q.select("query_id", "course_ref", F.explode(F.array_distinct("documents")).alias("doc_id")), q.agg(F.max("k")).first()[0] or 0)


def search(index: Searchable, queries: DataFrame, *, floor: float = RELATIVE_FLOOR, attributes: tuple[str, ...] = ATTRIBUTES, many_blocks: int = MANY_BLOCKS) -> DataFrame:
    """Ranked passages of ``queries(query_id, course_ref, text, k[, documents])``.

    ``documents`` (array of document ids, empty or null for all) narrows the
    scope before any statistic is taken. A hit on fewer than two different
    stems counts only if its rarest term is rare in the scope. The best k are
    taken first; of these, scores under ``floor`` times the best go. Bounds are
    taken where the queries meet more than ``many_blocks`` blocks; the rows are
    the same with and without them.
    """
    asked = _asked(queries)
    own = ("query_id", "batch", "block")
    documents, scope = asked.named(index.documents), None
    if asked.narrow is not None:
        inside = documents.join(asked.small(asked.narrow), ["course_ref", "doc_id"])
        scope = kept(inside.groupBy(*own).agg(F.bit_or("bits").alias("mask")))

    def masked(blocks: DataFrame) -> DataFrame:
        """Blocks with the bits of each query's own documents."""
        if scope is None:
            return blocks
        bits = F.when(F.col("narrow"), F.col("bits").bitwiseAND(F.coalesce("mask", F.lit(0)))).otherwise(F.col("bits"))
        return blocks.join(scope, list(own), "left").withColumn("bits", bits).drop("mask").filter("bits <> 0")

    # numbers of chunks, in all of a course and in its documents asked for, and those that hold a term
    courses = asked.words.filter("NOT narrow").select("query_id", "course_ref").distinct()
    n = asked.small(courses).join(documents.groupBy("course_ref").agg(F.sum(F.bit_count("bits")).alias("n")), "course_ref").select("query_id", "n")
    n = n if scope is None else n.unionByName(scope.groupBy("query_id").agg(F.sum(F.bit_count("mask")).alias("n")))
    heads = masked(asked.named(index.terms.drop("hits")).join(asked.small(asked.words), ["course_ref", "term"]))
    counts = heads.groupBy("query_id", "term").agg(F.sum(F.bit_count("bits")).alias("df"), F.count(F.lit(1)).alias("blocks"))
    if asked.few:  # a row a word
        told = counts.withColumn("n", F.lit(None).cast("bigint")).unionByName(n.select("query_id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("df"), F.lit(None).cast("bigint").alias("blocks"), "n")).collect()
        blocks = sum(r.blocks or 0 for r in told)
        counts = queries.sparkSession.createDataFrame([tuple(r)[:3] for r in told if r.term is not None], StructType(counts.schema.fields[:3]))
        n = queries.sparkSession.createDataFrame([(r.query_id, r.n) for r in told if r.term is None], n.schema)
    else:
        counts = kept(counts)
        blocks = counts.agg(F.sum("blocks")).first()[0] or 0
    weights = asked.words.join(asked.small(counts.drop("blocks")), ["query_id", "term"]).join(asked.small(n), "query_id").withColumn("idf", F.log1p(F.col("n") / (1 + F.col("df")))).drop("df")

    tasks = -(-blocks // TASK_BLOCKS)

    def scored(only: DataFrame | None = None, broadcast: bool = False) -> DataFrame:
        """(query, course, batch, place, k, raw): scores of the chunks, of some blocks (a row each) or of all, that the guard lets pass."""
        hits = masked(asked.named(index.terms.drop("top")).join(asked.small(weights), ["course_ref", "term"]))
        hits = hits.select(*own, "course_ref", "k", "n", "qtf", "idf", "stem", "bits", "hits")
        # dealt as blocks, which are smaller than their hits; a block's scores are made where it lies
        if broadcast:
            hits = spread(hits.join(F.broadcast(only), list(own), "left_semi"), 0, *own)
        elif only is None:
            hits = spread(hits, tasks, *own)
        else:  # a semi-join would be made before the dealing, in the session's partitions; ``only`` has a row a block, so this one takes the same hits
            hits = spread(hits, tasks, *own).join(spread(only.select(*own), tasks, *own).hint("shuffle_hash"), list(own))
        hits = hits.select("*", F.inline("hits")).filter(F.call_function("bit_get", "bits", F.col("slot")) == 1).withColumn("place", F.col("block") * BLOCK + F.col("slot"))
        each = hits.groupBy(*own, "course_ref", "place", "k", "n").agg(F.sum(F.col("qtf") * (F.col("tf") / F.col("len")) * F.col("idf")).alias("raw"), F.min("stem").alias("least"), F.max("stem").alias("greatest"), F.max("idf").alias("rarest"))
        guard = (F.col("least") != F.col("greatest")) | ~(F.col("rarest") < RARE_SHARE * F.log1p(F.col("n") / 2))  # two stems, or a rare one
        return each.filter(guard & (F.col("raw") > 0)).select("query_id", "course_ref", "batch", "place", "k", "raw")

    if blocks <= many_blocks:
        every = scored()
    else:
        bound = F.sum(F.col("qtf") * F.col("top") * F.col("idf")).alias("bound")
        bounds = kept(masked(asked.named(index.terms.drop("hits")).join(asked.small(weights), ["course_ref", "term"])).groupBy(*own).agg(bound))
        best = bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "batch", "block"))).filter(F.col("place") <= FIRST)
        best = kept(best.select(*own))
        first = kept(scored(best, asked.few))  # of few queries these are few: the other hits need not be dealt
        bar = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc()))).filter("rank = k").select("query_id", F.col("raw").alias("bar"))
        rest = bounds.join(asked.small(best), list(own), "left_anti").join(asked.small(bar), "query_id", "left").filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") * (1 - 1e-9)))
        every = first.unionByName(scored(rest))

    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(F.col("raw"), 12).desc(), "batch", "place")))
    ranked = ranked.filter(F.col("rank") <= asked.most)  # a number: partitions keep no more than so many rows of a query
    best = ranked.filter("rank <= k").withColumn("top", F.max("raw").over(Window.partitionBy("query_id"))).filter(F.col("raw") >= floor * F.col("top"))
    texts = asked.named(index.chunks).select("course_ref", "batch", "place", "chunk_ord", *attributes, "text")
    if asked.few and asked.most <= MOST:
        best = F.broadcast(best)  # else all texts are dealt while the best are still sought
    return best.join(texts, ["course_ref", "batch", "place"]).select("query_id", "rank", "course_ref", "chunk_ord", *attributes, F.round("raw", 4).alias("score"), "text")


def search_corpus(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """A search without an index: the courses asked for are chunked and tokenised now."""
    chunks = kept(chunked(corpus.join(queries.select("course_ref").distinct(), "course_ref", "left_semi")))
    return search(searchable(chunks), queries)


def confidence(hits: DataFrame, queries: DataFrame, low: float = 0.5) -> DataFrame:
    """Per query: its best score and ``ok``, ``low`` or ``none``."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    flag = F.when(F.col("best").isNull(), "none").when(F.col("best") < low, "low").otherwise("ok")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "best", flag.alias("confidence"))
