"""Decisions on the way in: requests, floors, page budgets, caches, segments, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import REQUEST

#: Least collapsed length of a text worth indexing, by platform ('': any) and kind.
FLOORS = [("", "file", 15), ("", "scan", 15), ("studip", "sub-title", 40), ("moodle", "section", 1), ("moodle", "course", 1), ("studip", "wiki", 40), ("studip", "courseware", 40), ("studip", "description", 40), ("studip", "news", 1), ("moodle", "summary", 1), ("moodle", "module", 1), ("ilias", "course", 40), ("ilias", "object", 40), ("ilias", "container", 1)]


def requests(raw: DataFrame) -> DataFrame:
    """Index requests (``body`` JSON) as rows a document, with an ``error`` for the invalid.

    A request of scans or recordings alone is valid: one row without a text.
    """
    parsed = raw.withColumn("r", F.from_json("body", REQUEST))
    docs = F.coalesce(F.col("r.documents"), F.array().cast(REQUEST["documents"].dataType))
    sent = (F.size(F.coalesce("r.scans", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("r.media", F.array().cast("array<string>"))) > 0)
    bad = F.exists(docs, lambda d: F.coalesce(d["text"], F.lit("")) == "")
    error = F.when(F.coalesce(F.col("r.course_ref"), F.lit("")) == "", "course_ref is required").when((F.size(docs) == 0) & ~sent, "documents are required").when(bad, "text is required")
    rows = parsed.withColumn("error", error).withColumn("d", F.explode_outer(F.when(error.isNull(), docs)))
    blank = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(""))
    return rows.select(F.col("r.course_ref").alias("course_ref"), F.coalesce("r.replace", F.lit(True)).alias("replace"), blank("activity_ref").alias("activity_ref"), F.coalesce(F.nullif(F.col("d.title"), F.lit("")), F.lit("untitled")).alias("title"), F.col("d.text").alias("text"), *[blank(c).alias(c) for c in ("locator", "course_name", "folder", "licence")], "error")


def long_enough(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``(platform, kind, text)`` whose collapsed text reaches the floor of its kind; a kind without a floor needs one letter."""
    floor = F.lit(1)
    for platform, kind, least in FLOORS:
        floor = F.when((F.col("kind") == kind) & (F.lit(platform == "") | (F.col("platform") == platform)), least).otherwise(floor)
    return docs.filter(T.size(T.collapse(text_col)) >= floor)


def page_budget(files: DataFrame, budget: int, *, order: str = "ord") -> DataFrame:
    """How many pages of each file are read within one budget of a course, and how many are skipped."""
    before = F.coalesce(F.col("before"), F.lit(0))
    take = F.least(F.greatest(F.lit(budget) - before, F.lit(0)), F.col("pages"))
    files = files.join(before_each(files, "pages", order), ["course_ref", order], "left")
    return files.withColumn("take", take.cast("bigint")).withColumn("skipped", (F.col("pages") - F.col("take")).cast("bigint")).drop("before")


#: So many numbers of the order share a part of a course.
PART = 1 << 16


def before_each(rows: DataFrame, amount: str, order: str = "ord") -> DataFrame:
    """(course_ref, order, ``before``): the sum of ``amount`` over a course's rows before each, ``order`` being whole numbers.

    Sums run within parts of the order, and then over the parts, so that one
    large course is many tasks. Rows of equal order are taken together.
    """
    sums = rows.groupBy("course_ref", F.floor(F.col(order) / PART).alias("part"), order).agg(F.sum(amount).alias("own"))
    parts = sums.groupBy("course_ref", "part").agg(F.sum("own").alias("all"))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("course_ref", "part", so_far("all", Window.partitionBy("course_ref").orderBy("part")).alias("base"))
    inside = sums.withColumn("inside", so_far("own", Window.partitionBy("course_ref", "part").orderBy(order)))
    return inside.join(parts, ["course_ref", "part"]).select("course_ref", order, (F.col("inside") + F.col("base")).cast("bigint").alias("before"))


def pages_to_read(files: DataFrame, budget: int, *, order: str = "ord") -> DataFrame:
    """Which pages of each scan are read: the wanted ones (all of ``page_count`` if null) that hold an image, in their order, within the course's budget."""
    every = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    drawn = F.filter(F.coalesce("wanted", every), lambda p: F.array_contains("with_images", p))
    files = files.withColumn("drawn", drawn).withColumn("pages", F.size("drawn").cast("bigint"))
    return page_budget(files, budget, order=order).withColumn("read", F.slice("drawn", F.lit(1), F.col("take").cast("int"))).drop("drawn", "pages")


def cache_key(content: Column, page: Column, reader: str) -> Column:
    """Key of a page's text: content hash, page, reader."""
    return F.concat_ws(":", F.sha2(content, 256), page.cast("string"), F.lit(reader))


def cache_misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages without a cached text (an empty cached text counts)."""
    return pages.join(cache.select("key"), "key", "left_anti")


def read_texts(pages: DataFrame, cache: DataFrame, fresh: DataFrame, floor: int = 15) -> DataFrame:
    """Pages with their texts, collapsed, from the cache (``key``, ``text``) or else from what was read now; those under the floor go."""
    known = cache.select("key", "text").unionByName(fresh.select("key", "text").join(cache.select("key"), "key", "left_anti")).dropDuplicates(["key"])
    return pages.join(known, "key").withColumn("text", T.collapse("text")).filter(T.size("text") >= floor)


def cache_put(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Add texts (``key``, ``text``) that the cache at ``path`` lacks; a page read as empty is kept too."""
    fresh = fresh.select("key", "text").dropDuplicates(["key"])
    fresh.join(read_cache(spark, path).select("key"), "key", "left_anti").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at a path; one that does not exist is empty."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, text string")
    return spark.read.schema("key string, text string").parquet(path)


def failure_summary(pages: DataFrame) -> DataFrame:
    """Per file with failed pages (``error`` not null): how many of how many were not read, and the first error."""
    first = F.min_by(F.concat_ws(": ", F.coalesce(F.nullif(F.col("locator"), F.lit("")), F.lit("Bild")), F.substring("error", 1, 150)), F.when(F.col("error").isNotNull(), F.col("ord")))
    told = pages.groupBy("course_ref", "activity_ref").agg(F.count("error").alias("failed"), F.count(F.lit(1)).alias("pages"), first.alias("first")).filter("failed > 0")
    return told.select("course_ref", "activity_ref", F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages not read; "), F.col("first")).alias("summary"))


def segments(recordings: DataFrame, size: int = 900) -> DataFrame:
    """Timed passages of recordings (``utterances`` in ms with speakers, ``text``).

    Utterances are joined until they reach ``size``; a passage starts where the
    one before it ended, the first one where the first utterance starts, blank
    or not; a speaker is named when it changes. ``text`` counts only where
    there are no utterances at all.
    """
    begin = F.coalesce(F.get("utterances", F.lit(0))["start"], F.lit(0)).cast("bigint")
    kept = F.filter("utterances", lambda u: T.strip(F.coalesce(u["text"], F.lit(""))) != "")
    none = F.array().cast("array<struct<locator:string,text:string>>")
    start = F.struct(F.lit("").alias("buf"), F.lit(0).alias("len"), begin.alias("at"), F.lit("").alias("who"), none.alias("out"))

    def step(a: Column, u: Column) -> Column:
        who = F.coalesce(u["speaker"], F.lit(""))
        line = F.concat(F.when((who != "") & (who != a["who"]), F.concat(who, F.lit(": "))).otherwise(""), T.strip(u["text"]))
        at = a["at"]
        buf = F.when(a["buf"] == "", line).otherwise(F.concat(a["buf"], F.lit(" "), line))
        length = a["len"] + F.length(line)
        full = length >= size
        closed = F.concat(a["out"], F.array(F.struct(T.stamp(at / 1000).alias("locator"), buf.alias("text"))))
        return F.struct(
            F.when(full, F.lit("")).otherwise(buf).alias("buf"),
            F.when(full, F.lit(0)).otherwise(length).alias("len"),
            F.when(full, F.coalesce(u["end"], at)).otherwise(at).alias("at"),
            F.when(full, F.lit("")).otherwise(F.when(who != "", who).otherwise(a["who"])).alias("who"),
            F.when(full, closed).otherwise(a["out"]).alias("out"),
        )

    last = lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(F.struct(T.stamp(a["at"] / 1000).alias("locator"), a["buf"].alias("text"))))).otherwise(a["out"])
    timed = F.aggregate(kept, start, step, last)
    whole = F.when(T.strip(F.coalesce("text", F.lit(""))) != "", F.array(F.struct(F.lit("").alias("locator"), T.strip("text").alias("text")))).otherwise(none)
    out = F.when(F.size("utterances") > 0, timed).otherwise(whole)
    rest = [c for c in recordings.columns if c not in ("utterances", "text")]
    return recordings.select(*rest, F.posexplode(out).alias("seq", "s")).select(*rest, "seq", "s.locator", "s.text")


def segments_of_seconds(recordings: DataFrame, size: int = 900, *, speakers: bool = False) -> DataFrame:
    """The same for ``utterances`` timed in seconds: rounded to milliseconds where speakers are told, else cut to them and unnamed."""
    near = F.bround if speakers else F.floor
    ms = lambda c: near(F.coalesce(c, F.lit(0.0)).cast("double") * 1000).cast("bigint")
    timed = F.transform("utterances", lambda u: F.struct(ms(u["start"]).alias("start"), ms(u["end"]).alias("end"), u["text"].alias("text"), (u["speaker"] if speakers else F.lit(None).cast("string")).alias("speaker")))
    return segments(recordings.withColumn("utterances", timed), size)


def transcript(body: Column) -> tuple[Column, Column]:
    """Utterances in seconds and the text of a transcription's JSON, whose segments are a list or one level deeper."""
    kind = "ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, speaker: STRING>>"
    nested = F.get_json_object(body, "$.segments.segments")
    flat = F.get_json_object(body, "$.segments")
    return F.coalesce(F.from_json(F.coalesce(nested, flat), kind), F.array().cast("array<struct<start:double,end:double,text:string,speaker:string>>")), F.coalesce(F.get_json_object(body, "$.text"), F.lit(""))


def with_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files with their folder's name, '' if unknown."""
    return files.join(folders.select(F.col("folder_id"), F.col("name").alias("folder_name")), "folder_id", "left").withColumn("folder", F.coalesce("folder_name", F.lit(""))).drop("folder_name")


def job_states(events: DataFrame) -> DataFrame:
    """(course_ref, job_id, kind, title, first, submitted, ended, error, at): a row a job from its events, in any order and repeated as often as may be.

    A job is pending once it is submitted; it ends with the earliest of its
    ``done`` and ``failed`` events. ``first`` and ``at`` are the places (``ord``)
    of its first submission and of its end.
    """
    of = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    submitted = F.col("event") == "submitted"
    end = F.min(F.when(F.col("event").isin("done", "failed"), F.struct("ord", "event", of("error").alias("error"))))
    states = events.groupBy("course_ref", "job_id").agg(F.min(of("kind")).alias("kind"), F.min(of("title")).alias("title"), F.min(F.when(submitted, F.col("ord"))).alias("first"), F.max(submitted).alias("submitted"), end.alias("end"))
    return states.select("course_ref", "job_id", "kind", "title", "first", "submitted", F.col("end.event").alias("ended"), F.col("end.error").alias("error"), F.col("end.ord").alias("at"))


def counted(states: DataFrame) -> DataFrame:
    """Counters of each course from the states of its jobs."""
    many = lambda condition: F.count_if(condition).cast("bigint")
    ended = F.col("ended")
    return states.groupBy("course_ref").agg(many(F.col("submitted") & ended.isNull()).alias("pending"), many(ended == "done").alias("done"), many(ended == "failed").alias("failed"))


def job_counters(events: DataFrame) -> DataFrame:
    """Pending, done and failed jobs of each course."""
    return counted(job_states(events))


def job_details(events: DataFrame, errors: int = 5) -> DataFrame:
    """Per course what its jobs are: pending of each kind, titles in order of first sight, the first errors.

    A course's titles and errors are reduced before they are listed: each title
    once, and no more than ``errors`` errors.
    """
    states = job_states(events)
    left = lambda kind: F.count_if((F.col("kind") == kind) & F.col("submitted") & F.col("ended").isNull()).cast("bigint")
    pending = states.groupBy("course_ref").agg(left("transcription").alias("transcriptions"), left("scan").alias("scans"))
    listed = lambda rows, c: rows.groupBy("course_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]).alias(f"{c}s"))
    titles = listed(states.filter("submitted").groupBy("course_ref", "title").agg(F.min("first").alias("ord")), "title")
    failed = states.filter("ended = 'failed'").select("course_ref", F.col("at").alias("ord"), F.concat("title", F.lit(": "), F.substring("error", 1, 200)).alias("error"))
    failed = failed.withColumn("place", F.row_number().over(Window.partitionBy("course_ref").orderBy("ord"))).filter(F.col("place") <= errors)
    none = F.array().cast("array<string>")
    return pending.join(titles, "course_ref", "left").join(listed(failed, "error"), "course_ref", "left").select("course_ref", "transcriptions", "scans", F.coalesce("titles", none).alias("titles"), F.coalesce("errors", none).alias("errors"))


# The German sentences that readers see.
def job_note(recordings: Column, scans: Column) -> Column:
    """The sentence that tells a reader what is still being worked on."""
    tail = "für diese Frage noch nicht zur Verfügung."
    number = lambda c, one, more: F.when(c == 1, f"1 {one}").otherwise(F.concat(c.cast("string"), F.lit(f" {more}")))
    rec, doc = number(recordings, "Aufnahme", "Aufnahmen"), number(scans, "gescannte Datei", "gescannte Dateien")
    say = lambda *parts: F.concat(F.lit("Hinweis: "), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f" {tail}"))
    return (
        F.when((recordings > 0) & (scans > 0), say(rec, " und ", doc, " werden noch verarbeitet und stehen"))
        .when(scans > 0, say(doc, F.when(scans == 1, " wird noch gelesen und steht").otherwise(" werden noch gelesen und stehen")))
        .when(recordings > 0, say(rec, F.when(recordings == 1, " wird noch verarbeitet und steht").otherwise(" werden noch verarbeitet und stehen")))
        .otherwise("")
    )


# What a model is told before a question.
GROUNDED = (
    "Du bist eine Lernassistenz für eine Hochschulveranstaltung. "
    "Beantworte die Frage AUSSCHLIESSLICH auf Grundlage der bereitgestellten "
    "Auszüge aus den Kursmaterialien. Wenn die Auszüge die Frage nicht "
    "beantworten, sage das ausdrücklich und rate nicht. "
    "Verweise auf die Quellen mit ihrer Nummer, z. B. [1]."
)
NO_CONTEXT = (
    "Du bist eine Lernassistenz für eine Hochschulveranstaltung. "
    "Zu dieser Frage wurden KEINE passenden Stellen in den Kursmaterialien "
    "gefunden. Sage das dem Nutzer klar und in einem Satz. "
    "Beantworte die Frage NICHT aus deinem Allgemeinwissen und rate nicht. "
    "Schlage stattdessen vor, die Frage anders zu formulieren oder die "
    "Lehrperson zu fragen."
)
EXCERPTS = "Auszüge aus den Kursmaterialien:\n\n"


def grounded_prompt(hits: DataFrame) -> DataFrame:
    """Per query, the numbered passages of its prompt (at most its k)."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.when(F.col("locator") != "", F.concat(F.lit(", "), "locator")).otherwise(""), F.lit("\n"), F.col("text"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("b")))), lambda x: x["b"])
    return hits.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("context"))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query the messages for a model: instructions, the passages, the question.

    With a course and no passage the model is told to refuse; without a course
    the question stands alone.
    """
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    question = said("user", F.col("text"))
    joined = queries.join(grounded_prompt(hits), "query_id", "left")
    messages = (
        F.when(F.col("context").isNotNull(), F.array(said("system", F.lit(GROUNDED)), said("system", F.concat(F.lit(EXCERPTS), "context")), question))
        .when(F.coalesce("course_ref", F.lit("")) != "", F.array(said("system", F.lit(NO_CONTEXT)), question))
        .otherwise(F.array(question))
    )
    return joined.select("query_id", messages.alias("messages"))


def echo_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query the answer without a model: what was asked, and what was found."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    n = F.coalesce("found", F.lit(0))
    marks = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " "))
    # The sentences of the offline answer.
    some = F.concat(F.lit("(Offline-Modus, kein Modell aufgerufen.) Zur Frage „"), "text", F.lit("“ wurden "), n.cast("string"), F.lit(" Passagen aus den Kursmaterialien gefunden: "), marks, F.lit(". Mit konfiguriertem OPENAI_BASE_URL würde hier die Antwort des Modells stehen."))
    none = F.concat(F.lit("(Offline-Modus, kein Modell aufgerufen.) Frage empfangen: „"), "text", F.lit("“. Kein Kursbezug angegeben, daher keine Recherche in Kursmaterialien."))
    return queries.join(found, "query_id", "left").select("query_id", F.when(n > 0, some).otherwise(none).alias("answer"))


def index_summary(documents: DataFrame, chunks: DataFrame, scans: DataFrame, media: DataFrame) -> DataFrame:
    """One row on an indexing run: documents, chunks, recordings queued, scans queued, their pages, pages skipped.

    ``scans`` are rows of :func:`pages_to_read` or :func:`page_budget`.
    """
    one = lambda rows, *columns: rows.agg(*columns)
    count = lambda name: F.count(F.lit(1)).alias(name)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    read = one(scans, F.coalesce(F.sum((F.col("take") > 0).cast("bigint")), F.lit(0)).alias("image_text_queued"), total("take", "image_text_pages"), total("skipped", "image_text_skipped"))
    # four tables of one row each
    return one(documents, count("documents")).crossJoin(one(chunks, count("chunks"))).crossJoin(one(media, count("transcription_queued"))).crossJoin(read)
