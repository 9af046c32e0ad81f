"""What the findings of round 4 named, each on rows that failed before."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import lexical, providers
from scriptorium.plans.index_store import IndexStore
from scriptorium.plans.scratch import shared_folder
from scriptorium.queries import ORACLE_SQL, QUERIES
from scriptorium.queries.course import stored
from scriptorium.sources import lms

from .test_whole_job import SF, agree


def _files(path):
    """Sizes of the files under a folder, each under what tells it from others, whatever its names."""
    found = (os.lstat(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file://")) for f in names)
    return {(x.st_dev, x.st_ino): x.st_size for x in found}


def _chunks(spark, words, n=300):
    rows = [(c, f"{c}:file:{i}", "t", "S. 1", "", "", "", i, f"{words} Seite{i}") for c in ("studip:a", None, "studip:ü /+%") for i in range(n)]
    return lexical.chunked(spark.createDataFrame(rows, "course_ref string, activity_ref string, title string, locator string, folder string, course_name string, licence string, ord long, text string"))


def test_a_copy_writes_no_file_again_and_stays_its_own(spark, tmp_path):
    one, two = IndexStore(spark, f"file://{tmp_path}/one"), IndexStore(spark, str(tmp_path / "two"))
    one.replace(_chunks(spark, "Klausur"))
    before = _files(str(tmp_path))
    rows = lambda store: sorted(map(str, store.read().collect()))
    two.copy(one)
    assert _files(str(tmp_path)) == before  # no file was written
    first = rows(one)
    assert rows(two) == first
    one.replace(_chunks(spark, "Prüfung", 100))
    one.append(_chunks(spark, "Anhang", 10), "late")
    one.forget(None)
    assert rows(two) == first and len(rows(one)) == 2 * 110
    second = rows(one)
    two.replace(_chunks(spark, "Seminar", 5), ["studip:a"])
    two.forget("studip:ü /+%")
    assert rows(one) == second and len(rows(two)) == 2 * 5
    two.copy(one)  # what is there already is replaced batch by batch
    assert {r.course_ref: r.n for r in two.sizes().collect()} == {"studip:a": 110, "studip:ü /+%": 110, None: 5}


#: How much a query that changes an index may write, in parts of it.
_WRITES = {"late_append_stream": 1.5, "forget_course": 0.3, "replace_course": 0.4, "append_course": 0.3}


@pytest.mark.parametrize("name", _WRITES)
def test_a_query_writes_what_it_changes(spark, name):
    index = sum(_files(stored(spark, SF).path).values())
    before = _files(shared_folder(spark))
    assert agree(spark, name, ORACLE_SQL[name])
    written = sum(size for at, size in _files(shared_folder(spark)).items() if at not in before)
    assert written < _WRITES[name] * index


def test_requests_of_scans_alone_write_no_row_of_the_index_again(spark, monkeypatch):
    stored(spark, SF)
    written = []
    real = IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, rows: (written.append(rows.count()), real(self, rows)))
    assert agree(spark, "scans_only_request", ORACLE_SQL["scans_only_request"])
    assert sum(written) == 0


def test_an_index_takes_over_words_and_makes_vectors(spark, tmp_path, monkeypatch):
    letters = lambda texts: [[float(t.count(c)) for c in "ae"] for t in texts]
    held = IndexStore(spark, str(tmp_path / "held"))
    held.replace(_chunks(spark, "Klausur"))
    held.append(_chunks(spark, "Anhang", 70), "late")
    own, _ = providers.retrieval(spark, "auto", str(tmp_path / "own"), letters)
    own.index(held.read())
    linked = IndexStore._linked
    for path in ("linked", "written"):
        if path == "written":
            monkeypatch.setattr(IndexStore, "_linked", lambda self, other, more: False)
        taken, _ = providers.retrieval(spark, "auto", str(tmp_path / path), letters)
        taken.take(held)
        for part in ("read", "postings", "vectors", "sizes", "searched"):
            a, b = getattr(taken.store, part)(), getattr(own.store, part)()
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), (path, part)
    assert taken.store.vectors().count() == 3 * 370 and held.rows("vector").isEmpty()
    again = IndexStore(spark, str(tmp_path / "again"), letters)
    monkeypatch.setattr(IndexStore, "_linked", linked)
    again.copy(own.store)  # has its vectors
    assert again.vectors().count() == 3 * 370
    for mode, fault in (("none", RuntimeError), ("external", NotImplementedError)):
        with pytest.raises(fault):
            providers.retrieval(spark, mode, str(tmp_path))[0].take(held)


def test_a_choice_of_providers_reads_no_text_into_terms_again(spark, monkeypatch):
    stored(spark, SF)
    monkeypatch.setattr(lexical, "term_blocks", None)
    assert agree(spark, "provider_choice", ORACLE_SQL["provider_choice"])


def test_white_space_goes_at_both_ends_as_the_pattern_has_it(spark):
    rnd = random.Random(1)
    letters = T.WS_CHARACTERS + "ab \n​᠎﻿"
    rows = [("".join(rnd.choice(letters) for _ in range(rnd.randrange(9))),) for _ in range(3000)] + [(None,), ("",)]
    texts = spark.createDataFrame(rows, "x string")
    assert texts.filter(~T.strip("x").eqNullSafe(F.regexp_replace("x", f"^{T.WS}+|{T.WS}+$", ""))).isEmpty()


def test_a_block_is_parsed_once(spark):
    assert agree(spark, "courseware_documents", ORACLE_SQL["courseware_documents"])
    block = {"id": "1", "attributes": {"position": 1, "block-type": "text", "title": " T ", "visible": True, "payload": {"text": "<p>a &amp; b</p>", "content": " ", "caption": "c"}}}
    hidden = {"id": "2", "attributes": {"block-type": "text", "visible": False, "payload": {"text": "hidden"}}}
    plain = {"id": "3", "attributes": {"position": 2, "block-type": "text", "payload": "&lt;x&#62; &"}}
    said = [("/courseware-structural-elements/e/containers", 200, json.dumps({"data": [{"id": "c"}]})), ("/courseware-containers/c/blocks", 200, json.dumps({"data": [block, hidden, plain]}))]
    blocks = lms.block_texts(spark.createDataFrame(said, "route string, status int, body string"))
    assert [tuple(r) for r in blocks.collect()] == [("e", "T\na & b c\n\n<x> &")]
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # filters and further columns made it again before
