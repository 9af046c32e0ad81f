"""The stored index under retries and several writers; jobs as state."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import ingest, lexical, providers
from scriptorium.plans.index_store import IndexStore
from scriptorium.schema import CHUNK
from scriptorium.streaming import jobs


def row(course, n, text, ref="a"):
    return (ref, "t", "", "", "", "", text, n, course)


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def held(store):
    return sorted((r.course_ref, r.chunk_ord, r.text) for r in store.read().collect())


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "store"))


def test_a_retry_replaces_itself_and_nothing_else(spark, store, monkeypatch):
    store.replace(chunks(spark, *[row(c, i, "alt") for c in "abc" for i in range(4)]))
    real = lexical.document_blocks
    monkeypatch.setattr(lexical, "document_blocks", lambda c: real(c).withColumn("bits", F.raise_error("lost").cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        store.append(chunks(spark, row("a", 0, "spät")), batch="late-3")  # dies
    monkeypatch.undo()
    assert len(held(store)) == 12
    store.append(chunks(spark, row("b", 0, "auftrag")), batch="jobs-1")
    store.replace(chunks(spark, row("c", 0, "neu")))
    store.replace(chunks(spark, row("a", 0, "neu"), row("a", 1, "neu")))
    for _ in range(2):
        store.append(chunks(spark, row("a", 0, "spät")), batch="late-3")
    assert held(store) == [("a", 0, "neu"), ("a", 1, "neu"), ("a", 2, "spät"), *[("b", i, "alt") for i in range(4)], ("b", 4, "auftrag"), ("c", 0, "neu")]


def test_replace_takes_late_batches_away(spark, store):
    store.replace(chunks(spark, row("a", 0, "x"), row("b", 0, "x")))
    store.append(chunks(spark, row("a", 0, "y"), row("b", 0, "y")), batch="one")
    store.replace(chunks(spark, row("a", 0, "z")), ["a", "c"])
    assert held(store) == [("a", 0, "z"), ("b", 0, "x"), ("b", 1, "y")]
    assert store.forget("b") == 2 and held(store) == [("a", 0, "z")]


def test_numbers_without_gaps_or_an_error(spark, store):
    for rows in ([row("a", 0, "x"), row("a", 0, "y")], [row("a", 1, "x")], [row("a", 0, "x"), row("a", 2, "y")]):
        with pytest.raises(ValueError, match="numbered"):
            store.append(chunks(spark, *rows))
    assert held(store) == []


def test_every_stream_arrives_once(spark, store, tmp_path):
    for n in range(2):
        chunks(spark, row("a", 0, f"stream {n}")).write.parquet(str(tmp_path / f"in{n}"))
    for n in (0, 1, 0):  # the third is the first again: its checkpoint has nothing left
        jobs.append_late(spark.readStream.schema(CHUNK).parquet(str(tmp_path / f"in{n}")), store, str(tmp_path / f"checkpoint{n}"))
    assert sorted(t for _, _, t in held(store)) == ["stream 0", "stream 1"]
    jobs.append_late(spark.readStream.schema(CHUNK).parquet(str(tmp_path / "in0")), store, str(tmp_path / "anew"))
    assert len(held(store)) == 3


def test_statistics_equal_a_recount(spark, store):
    rnd = random.Random(4)
    words = [f"wort{i}" for i in range(12)] + ["Prüfungsverwaltung", "Monaden"]
    say = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))
    for n in range(8):
        course = rnd.choice("abc")
        new = chunks(spark, *[row(course, i, say(), f"d{i // 2}") for i in range(rnd.randint(1, 130))])
        [lambda: store.replace(new), lambda: store.append(new), lambda: store.append(new, batch="again"), lambda: store.forget(course)][n % 4]()
    kept = store.read()
    again = {tuple(r) for r in lexical.document_frequency(kept).collect()}
    assert {tuple(r) for r in store.document_frequency().collect()} == again
    assert {tuple(r) for r in store.sizes().collect()} == {tuple(r) for r in kept.groupBy("course_ref").count().collect()}


def _searched(rows, asked, k, documents, tokens):
    """Ranks by the plain formula: {(chunk, score)}."""
    import math

    scope = [(i, t) for i, (d, t) in enumerate(rows) if not documents or d in documents]
    bags = {i: tokens[t] for i, t in scope}
    df = {w: sum(w in b for b in bags.values()) for w in set(asked)}
    idf = {w: math.log1p(len(scope) / (1 + n)) for w, n in df.items()}
    scored = []
    for i, bag in bags.items():
        met = [w for w in set(asked) if w in bag]
        raw = sum(asked.count(w) * bag.count(w) / max(1, len(bag)) * idf[w] for w in met)
        if raw > 0 and (len({_STEM[w] for w in met}) >= 2 or not max(idf[w] for w in met) < 0.6 * math.log1p(len(scope) / 2)):
            scored.append((-round(raw, 12), i, raw))
    best = sorted(scored)[:k]
    return [(i, round(raw, 4)) for _, i, raw in best if raw >= 0.25 * best[0][2]]


_STEM = {}


def test_search_with_bounds_equals_the_formula(spark, store, monkeypatch):
    rnd = random.Random(9)
    words = ["gemein"] * 30 + [f"wort{i}" for i in range(40)] + ["selten"]
    rows = [(f"d{i // 7}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))) for i in range(1500)]
    store.replace(chunks(spark, *[row("a", i, t, d) for i, (d, t) in enumerate(rows[:1200])]))
    store.append(chunks(spark, *[row("a", i, t, d) for i, (d, t) in enumerate(rows[1200:])]))
    ids = {d: d10 for d, d10 in spark.createDataFrame([(d,) for d in {d for d, _ in rows}], "d string").select("d", T.doc_id("d")).collect()}
    texts = ["gemein wort3", "selten", "gemein", "wort1 wort2 wort3 wort4 gemein gemein", "nichts davon"]
    only = [None, None, None, None, None, ["d3", "d150", "d200"], ["d5"], ["d3", "dx"]]
    queries = [(n, "a", texts[n % 5], 3 + n % 4, [ids.get(d, "?") for d in only[n]] if only[n] else None) for n in range(8)]
    frame = spark.createDataFrame(queries, "query_id int, course_ref string, text string, k int, documents array<string>")
    toks = {r.x: r.t for r in spark.createDataFrame([(x,) for x in {t for _, t in rows} | set(texts)], "x string").select("x", T.tokens("x").alias("t")).collect()}
    _STEM.update({r.x: r.s for r in spark.createDataFrame([(w,) for w in {w for t in toks.values() for w in t}], "x string").select("x", T.stem(F.col("x")).alias("s")).collect()})
    got = {}
    for r in lexical.search(store.searchable(), frame, many_blocks=0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_ord, r.score))
    want = {n: w for n, _, text, k, _ in queries if (w := _searched(rows, toks[text], k, only[n], toks))}
    assert got == want
    monkeypatch.setattr(lexical, "FEW_QUERIES", 2)  # as tables, not as literals
    for bounds in (0, 1 << 40):
        again = {}
        for r in lexical.search(store.searchable(), frame, many_blocks=bounds).orderBy("query_id", "rank").collect():
            again.setdefault(r.query_id, []).append((r.chunk_ord, r.score))
        assert again == want


def test_documents_without_order_are_numbered(spark):
    rows = [("a", 1, "r1", "eins"), ("a", 1, "r2", "zwei"), ("a", None, "r3", "drei"), (None, 5, "r4", "vier"), ("a", None, "r5", "fünf"), ("a", 1, "r1", "eins")]
    got = lexical.chunked(spark.createDataFrame(rows, "course_ref string, ord long, activity_ref string, text string")).collect()
    assert sorted(r.chunk_ord for r in got if r.course_ref == "a") == [0, 1, 2, 3, 4]
    assert [r.chunk_ord for r in got if r.course_ref is None] == [0]
    assert {r.chunk_ord for r in got if r.activity_ref in ("r3", "r5")} == {3, 4}


EVENTS = "course_ref string, job_id string, kind string, title string, event string, error string, ord long"


def test_job_states_under_repeats_and_late_order(spark, tmp_path):
    rnd = random.Random(2)
    told = []
    for j in range(30):
        course, kind = f"c{j % 3}", "scan" if j % 2 else "transcription"
        events = ["submitted"] * rnd.randint(1, 3) + rnd.choice([[], ["done"], ["failed", "done"], ["done", "done", "failed"]])
        told += [(course, str(j), kind, f"t{j}", e, f"boom {n}", 100 * j + n) for n, e in enumerate(events)]
    rnd.shuffle(told)
    for n in range(4):
        spark.createDataFrame(told[n::4] + told[n::8], EVENTS).write.parquet(str(tmp_path / f"in/part{n}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in jobs.run_counters(stream, str(tmp_path / "c"), str(tmp_path / "t")).collect()}
    want = {}
    for c, j, *_ in {(e[0], e[1]) for e in told}:
        ended = sorted((e[6], e[4]) for e in told if e[1] == j and e[4] != "submitted")
        own = want.setdefault(c, [0, 0, 0])
        own[0 if not ended else 1 if ended[0][1] == "done" else 2] += 1
    assert got == {(c, *n) for c, n in want.items()}
    assert got == {tuple(r) for r in ingest.job_counters(spark.createDataFrame(told, EVENTS)).collect()}


class Clerk:
    """A service whose answers follow from the payload; it writes down when each job began and ended."""

    def __init__(self, log):
        self.log = log

    def _say(self, *what):
        with open(self.log, "a") as f:
            f.write(json.dumps([time.time(), *what]) + "\n")

    def _calls(self, ticket):
        with open(self.log) as f:
            return sum(json.loads(line)[1:] == ["state", ticket] for line in f)

    def start(self, kind, payload):
        self._say("start", kind, payload)
        if payload == "refused":
            raise ValueError("no such file")
        return payload

    def state(self, kind, ticket):
        self._say("state", ticket)
        calls = self._calls(ticket)
        if ticket.startswith("flaky") and calls <= 2:
            raise OSError("network")
        if ticket == "dead":
            raise OSError("network")
        if ticket.startswith("slow") and calls < 3:
            return {"status": "processing", "progress": calls}
        if ticket == "never":
            return {"status": "queued"}
        if ticket == "broken":
            return {"status": "ERROR", "error": "codec"}
        self._say("end", kind, ticket)
        return {"status": "Finished", "text": "" if ticket == "empty" else f"heard {ticket}"}


def test_jobs_run_with_a_cap_a_kind(spark, tmp_path):
    schema = "course_ref string, job_id string, kind string, title string, payload string, size long"
    payloads = {"transcription": ["slow1", "slow2", "slow3", "empty", "never", "broken"], "scan": ["slow4", "flaky", "dead", "refused", "plain"]}
    rows = [("c:1", f"{kind}-{p}", kind, p, p, int(p == "never")) for kind, own in payloads.items() for p in own]
    spark.createDataFrame(rows + rows[:3], schema).write.parquet(str(tmp_path / "jobs"))
    log = str(tmp_path / "log")
    open(log, "w").close()
    limits = jobs.Limits(caps={"transcription": 1, "scan": 3}, poll=0.2, retries=(0.1, 0.3), wait=lambda size: 3 if size else 100)
    store, own = IndexStore(spark, str(tmp_path / "index")), str(tmp_path / "events")

    def then(batch, number):
        done = batch.filter("event = 'done'").select("course_ref", "job_id", *[F.lit("").alias(c) for c in ("activity_ref", "locator", "course_name", "folder", "licence")], "title", F.get_json_object("body", "$.text").alias("text"), F.lit(0).alias("chunk_ord"))
        store.append(jobs._renumbered(done), batch=f"run-{number:06d}")

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "jobs"))
    query = jobs.run_jobs(stream, Clerk(log), str(tmp_path / "checkpoint"), own, limits=limits, then=then, every=0.2)
    found = {r.job_id.partition("-")[2]: r for r in jobs.wait_for(spark, query, own, len(rows), timeout=150).collect()}
    assert len(found) == len(rows) == jobs.outcomes(spark, own).count()
    good = {"slow1", "slow2", "slow3", "slow4", "flaky", "plain"}
    assert {p for p, r in found.items() if r.event == "done"} == good
    assert found["empty"].error.endswith("nothing was said") and "not done in time" in found["never"].error
    assert "codec" in found["broken"].error and "network" in found["dead"].error and "no such file" in found["refused"].error
    with open(log) as f:
        lines = [json.loads(line) for line in f]
    starts = [x[3] for x in lines if x[1] == "start"]
    assert sorted(starts) == sorted(r[4] for r in rows)  # each is handed in once
    order = [x[1:] for x in lines if x[1] in ("start", "end") and x[2] == "transcription" and x[3].startswith("slow")]
    assert [x[0] for x in order] == ["start", "end"] * 3  # one at a time
    at = {(x[1], x[3]): x[0] for x in lines if x[1] in ("start", "end")}
    assert max(at["start", "slow4"], at["start", "flaky"]) < min(at["end", "slow4"], at["end", "flaky"])  # several at once
    assert sorted(t for _, _, t in held(store)) == sorted(f"heard {p}" for p in good)


def test_processed_jobs_give_an_event_each(spark, store, tmp_path):
    rows = [("c:1", f"j{n}", "scan", f"t{n}", text, fault) for n, (text, fault) in enumerate([("eins", None), ("zwei", None), ("drei", None), (" ", None), (None, "boom")])]
    schema = "course_ref string, job_id string, kind string, title string, said string, fault string"
    spark.createDataFrame(rows + rows[:2], schema).write.parquet(str(tmp_path / "jobs"))
    blank = [F.lit("").alias(c) for c in ("activity_ref", "locator", "course_name", "folder", "licence")]
    work = lambda batch: batch.select("course_ref", "job_id", "title", *blank, F.col("said").alias("text"), F.lit(0).cast("long").alias("chunk_ord"), F.col("fault").alias("error"))
    events = jobs.process(spark.readStream.schema(schema).parquet(str(tmp_path / "jobs")), work, store, str(tmp_path / "checkpoint"), caps={"scan": 3})
    assert sorted((r.job_id, r.event) for r in events.collect()) == [("j0", "done"), ("j1", "done"), ("j2", "done"), ("j3", "failed"), ("j4", "failed")]
    assert held(store) == [("c:1", 0, "eins"), ("c:1", 1, "zwei"), ("c:1", 2, "drei")]


def test_states_of_transcriptions():
    for said in ("DONE", "Completed", "finished", "success"):
        assert providers.waited_for(lambda said=said: {"status": said}, 0, pause=None)["status"] == said
    refused = lambda code: lambda: (_ for _ in ()).throw(type("E", (OSError,), {"code": code})())
    assert [providers.offers_jobs(refused(c)) for c in (401, 403, 405, 422, 404, 500)] == [True] * 4 + [False] * 2
    assert providers.offers_jobs(lambda: 200) and not providers.offers_jobs(lambda: 503)
    assert not providers.offers_jobs(lambda: 1 / 0)
