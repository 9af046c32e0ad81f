"""Slots for models and indexes: what each must do, what is sent to it, and stand-ins without a network."""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..plans.index_store import IndexStore
from ..plans.scratch import kept
from . import catalog, ingest, lexical
from .trees import sums_before

# Limits and settings of requests.
LONGEST_EDGE, MAX_PAGES, MAX_TOKENS = 2048, 200, 4096
LEAST_SECONDS, SECONDS_A_MEGABYTE, POLL_SECONDS, RETRY_AFTER = 1800, 60, 5.0, (5.0, 20.0)


# What servers call a job that has ended, in any case.
DONE, FAILED = ("completed", "done", "finished", "success"), ("error", "failed")


class Retrieval(Protocol):
    """An index of courses: all results are frames."""

    def index(self, chunks: DataFrame, replace: bool = True) -> None: ...

    def take(self, store: IndexStore) -> None: ...

    def search(self, queries: DataFrame) -> DataFrame: ...

    def forget(self, course_ref: str) -> int: ...

    def courses(self) -> DataFrame: ...


class Stored:
    """Retrieval from an :class:`IndexStore`, by words or, with a provider, by vectors."""

    def __init__(self, store: IndexStore):
        self.store = store
        self.name = "embeddings" if store.provider else "lexical"

    def index(self, chunks: DataFrame, replace: bool = True) -> None:
        (self.store.replace if replace else self.store.append)(chunks)

    def take(self, store: IndexStore) -> None:
        """Index all that another index holds; what it made of its chunks is taken over, and only vectors are made."""
        self.store.copy(store)

    def search(self, queries: DataFrame) -> DataFrame:
        if not self.store.provider:
            return self.store.search(queries)
        provider = self.store.provider
        asked = queries.withColumn("text", F.coalesce("text", F.lit("")))
        from .vector import embedded

        return self.store.search_vectors(embedded(asked, provider))

    def forget(self, course_ref: str) -> int:
        return self.store.forget(course_ref)

    def courses(self) -> DataFrame:
        return catalog.courses(self.store.read())


class Null:
    """Retrieval where there is none: finds nothing, and cannot index."""

    name = "none"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def index(self, chunks: DataFrame, replace: bool = True) -> None:
        raise RuntimeError("no retrieval is set up")

    def take(self, store: IndexStore) -> None:
        self.index(store.read())

    def search(self, queries: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], "query_id long, rank int, course_ref string, chunk_ord long, score double, text string")

    def forget(self, course_ref: str) -> int:
        return 0

    def courses(self) -> DataFrame:
        return self.spark.createDataFrame([], "course_ref string, chunks long")


class External(Null):
    """Retrieval by another service, to be written where there is one."""

    name = "external"

    def index(self, chunks: DataFrame, replace: bool = True) -> None:
        raise NotImplementedError("external retrieval is a slot")

    def search(self, queries: DataFrame) -> DataFrame:
        raise NotImplementedError("external retrieval is a slot")


def retrieval(spark: SparkSession, mode: str, path: str, provider: Callable[[list[str]], list[list[float]]] | None = None) -> tuple[Retrieval, str]:
    """The retrieval of a mode (none, external, builtin, embeddings, auto) and a warning, '' if there is none."""
    if mode in ("none", "external"):
        return (Null if mode == "none" else External)(spark), ""
    if mode == "builtin":
        provider = None
    # separate folders: chunks with and without vectors are different indexes
    store = IndexStore(spark, f"{path}/{'vector' if provider else 'lexical'}", provider)
    return Stored(store), "no embedding model is set: searching by words" if mode == "embeddings" and not provider else ""


def completed(queries: DataFrame, hits: DataFrame, chat: Callable[[list[dict]], str] | None = None) -> DataFrame:
    """Per query an ``answer``: of ``chat`` on its messages, or without a model of the echo."""
    if chat is None:
        return ingest.echo_answers(queries, hits)
    asked = ingest.prompts(queries, hits)
    schema = StructType([asked.schema["query_id"], StructField("answer", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [chat([{"role": m["role"], "content": m["content"]} for m in ms]) for ms in f["messages"]]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": said})

    return asked.mapInPandas(run, schema)


def answered(queries: DataFrame, hits: DataFrame, answers: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Per query its answer with citations numbered anew, the sources it cites, and a note on what is still being read."""
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "locator", "activity_ref", "score"))).alias("found"))  # at most k
    none = F.array().cast("array<struct<rank:int,title:string,locator:string,activity_ref:string,score:double>>")
    own = queries.join(answers, "query_id").join(ranked, "query_id", "left").withColumn("found", F.coalesce("found", none))
    own = own.withColumn("cited", T.cited("answer", F.size("found")))
    sources = F.transform("cited", lambda n: F.get("found", n - 1))
    own = own.select("query_id", "course_ref", T.renumbered("answer", F.col("cited")).alias("answer"), sources.alias("sources"))
    if notes is None:
        return own.drop("course_ref")
    own = own.join(notes.select("course_ref", "note"), "course_ref", "left")
    return own.select("query_id", F.concat("answer", F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n\n"), "note")).otherwise("")).alias("answer"), "sources")


# ---- pages read by eye

# Fixed value: what a model is told to do with a picture of a page.
INSTRUCTION = (
    "Transcribe all text in this image exactly as it appears, in reading order, "
    "as Markdown. Use Markdown tables for tables and LaTeX for formulas. "
    "Do not summarise, translate, correct or add anything, and do not describe "
    "pictures. If the image contains no text at all, answer with exactly: NO_TEXT"
)


def image_request(image: bytes, mime: str, *, model: str, mode: str) -> dict:
    """What is sent to have one picture read: ``vision`` is told what to do, ``ocr`` knows."""
    if mode not in ("vision", "ocr"):
        raise ValueError("the mode is vision or ocr")
    picture = {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(image).decode()}"}}
    told = [{"type": "text", "text": INSTRUCTION}] if mode == "vision" else []
    return {"model": model, "messages": [{"role": "user", "content": [*told, picture]}], "temperature": 0.2 if mode == "ocr" else 0, "max_tokens": MAX_TOKENS}


def read_pages(pages: DataFrame, reader: Callable[[bytes, str], str], *, at_once: int = 2) -> DataFrame:
    """``pages(key, image, mime)`` with their ``text``, cleaned, or the ``error`` of one that failed; at most ``at_once`` at a time."""
    schema = "key string, text string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, image, mime in zip(f["key"], f["image"], f["mime"], strict=True):
                try:
                    rows.append((key, reader(bytes(image), mime), None))
                except Exception as fault:  # one page costs itself only
                    rows.append((key, None, str(fault)[:150]))
            yield pd.DataFrame(rows, columns=["key", "text", "error"])

    return pages.select("key", "image", "mime").repartition(at_once).mapInPandas(run, schema).withColumn("text", T.clean_ocr("text"))


def pdf_counts(info: str, images: str) -> tuple[int, list[int]]:
    """Pages of a PDF and those that hold images, from what ``pdfinfo`` and ``pdfimages -list`` print."""
    lines = [line.split() for line in info.splitlines() if line.startswith("Pages:")]
    if not lines:
        raise RuntimeError("no page count")
    held = {int(words[0]) for words in map(str.split, images.splitlines()[2:]) if words and words[0].isdigit()}
    return int(lines[0][1]), sorted(held)


def pdf_tool(tool: str, *options: str, content: bytes, timeout: int = 120) -> bytes:
    """What a tool of Poppler prints on a PDF (``pdfinfo``, ``pdfimages -list``, ``pdftoppm -png ... -``)."""
    import shutil
    import subprocess

    if not shutil.which(tool):
        raise RuntimeError(f"{tool} is not installed")
    done = subprocess.run([tool, *options, "-"], input=content, capture_output=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"{tool} failed: {done.stderr.decode('utf-8', 'replace')[:200]}")
    return done.stdout


def rendered(content: bytes, page: int, longest_edge: int = LONGEST_EDGE) -> bytes:
    """One page as a PNG."""
    return pdf_tool("pdftoppm", "-png", "-f", str(page), "-l", str(page), "-scale-to", str(longest_edge), "-singlefile", content=content)


# ---- recordings


def longest_wait(size: int) -> int:
    """Seconds that a recording of ``size`` bytes may take."""
    return max(LEAST_SECONDS, int(size / 1_000_000 * SECONDS_A_MEGABYTE))


def waited_for(status: Callable[[], dict], size: int, *, pause: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> dict:
    """The state of a transcription once it is done; it raises if it failed or took too long."""
    end = clock() + longest_wait(size)
    while True:
        state = status()
        now = str(state.get("status") or "").lower()
        if now in DONE:
            return state
        if now in FAILED:
            raise RuntimeError(f"the recording could not be transcribed: {state.get('error') or 'no reason given'}")
        if clock() > end:
            raise RuntimeError(f"no transcript after {longest_wait(size)} seconds; last seen {now or 'without a status'}, progress {state.get('progress')}")
        pause(POLL_SECONDS)


def offers_jobs(call: Callable[[], int]) -> bool:
    """Whether a server takes transcriptions as jobs, told by the code that ``call`` of its job route gives.

    The route is there if it answers, or refuses for want of a key, a method or
    a body; any fault means that it is not.
    """
    try:
        code = call()
    except Exception as fault:
        return getattr(fault, "code", None) in (401, 403, 405, 422)
    return code < 500


def tried(call: Callable[[], dict], *, pause: Callable[[float], None] = time.sleep) -> dict:
    """A call that is tried again where the network failed, and only there."""
    from urllib.error import HTTPError

    for wait in (*RETRY_AFTER, None):
        try:
            return call()
        except HTTPError:
            raise
        except OSError:
            if wait is None:
                raise
            pause(wait)
    raise AssertionError


def transcribed(media: DataFrame, transcriber: Callable[[bytes, str], str], *, at_once: int = 2) -> DataFrame:
    """``media(activity_ref, title, content)`` with ``body``, the JSON of ``transcriber``, or ``error``; passages come of :func:`passages`."""
    schema = "activity_ref string, title string, body string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for ref, title, content in zip(f["activity_ref"], f["title"], f["content"], strict=True):
                try:
                    rows.append((ref, title, transcriber(bytes(content), title), None))
                except Exception as fault:  # one recording costs itself only
                    rows.append((ref, title, None, f"{title}: {str(fault)[:200]}"))
            yield pd.DataFrame(rows, columns=["activity_ref", "title", "body", "error"])

    return media.select("activity_ref", "title", "content").repartition(at_once).mapInPandas(run, schema)


def passages(bodies: DataFrame, *, speakers: bool = True) -> DataFrame:
    """Timed passages of transcriptions (``body``)."""
    utterances, text = ingest.transcript(F.col("body"))
    rows = bodies.filter(F.col("body").isNotNull()).select("activity_ref", "title", utterances.alias("utterances"), text.alias("text"))
    return ingest.segments_of_seconds(rows, speakers=speakers)


# ---- the tools of an assistant


class Tools:
    """What an assistant may ask of an index: list, index, search, forget; users see only what they may and change nothing."""

    def __init__(self, store: IndexStore, *, mode: str = "all", acl: DataFrame | None = None, username: str | None = None):
        self.store, self.mode, self.acl, self.username = store, mode, acl, username

    def _seen(self) -> DataFrame:
        chunks = self.store.read()
        return chunks if self.username is None else catalog.visible(chunks, self.mode, self.acl, self.username)

    def list_indexed_courses(self, platform: str | None = None) -> DataFrame:
        """Courses with their names and numbers of chunks, by reference."""
        chunks = self._seen()
        return catalog.courses(chunks, platform).join(catalog.course_names(chunks), "course_ref").orderBy("course_ref")

    def index_course(self, documents: DataFrame, courses: list[str] | None = None) -> int:
        """Index documents (of a platform's reader); how many chunks there are. Of ``courses``, those without a document are emptied.

        Of rows with the same place, the least is taken.
        """
        self._service()
        place = ["rank", "ord", "activity_ref", "locator"]
        own = documents.groupBy("course_ref", *place).agg(F.min(F.struct("title", "text", "course_name", "folder", "licence")).alias("x")).select("course_ref", *place, "x.*", F.lit(1).alias("one"))
        numbered = sums_before(own, ["course_ref"], place, "one", name="place").drop("one", "ord")
        chunks = kept(lexical.chunked(numbered, order="place"))
        self.store.replace(chunks, courses)
        return chunks.count()

    def search_course(self, course_ref: str, query: str, k: int = 6, documents: list[str] | None = None) -> tuple[DataFrame, str]:
        """Passages with citations, and how sure they are: ``ok``, ``low`` or ``none``."""
        spark = self.store.spark
        chunks = self._seen().filter(F.col("course_ref") == course_ref)
        if not chunks.limit(1).count():
            raise LookupError(f"{course_ref} is not indexed")
        only = None
        if documents:
            names = spark.createDataFrame([(d,) for d in documents], "name string")
            only = [r.doc_id for r in catalog.resolve(catalog.documents(chunks), names, required=True).collect()]
        asked = spark.createDataFrame([(0, course_ref, query, max(1, min(20, k)), only)], "query_id long, course_ref string, text string, k int, documents array<string>")
        hits = self.store.search(asked)
        sure = lexical.confidence(hits, asked).first().confidence
        return hits.withColumn("citation", T.citation("title", "locator", "course_name", "folder")).withColumn("doc_id", T.doc_id("activity_ref")), sure

    def forget_course(self, course_ref: str) -> int:
        """Drop a course; how many chunks it had."""
        self._service()
        return self.store.forget(course_ref)

    def _service(self) -> None:
        if self.username is not None:
            raise PermissionError("users may only read")
