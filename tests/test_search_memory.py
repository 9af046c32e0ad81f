"""Blocks that bounds leave are scored in tasks dealt by their number, not in the session's partitions."""

import random
import re

from scriptorium.operators import lexical
from scriptorium.plans.scratch import kept


def test_bounded_search_is_dealt_by_size(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("bcdfgaeiou") for _ in range(6)) for _ in range(60)]
    rows = [(f"c{i % 2}", f"a{i // 80}", "t", f"S. {i % 5}", "", "", "", i // 2, " ".join(rnd.choices(words, range(60, 0, -1), k=12))) for i in range(1800)]
    chunks = spark.createDataFrame(rows, "course_ref string, activity_ref string, title string, locator string, folder string, course_name string, licence string, chunk_ord long, text string")
    asked = spark.createDataFrame([(q, f"c{q % 2}", " ".join(rnd.choices(words, k=4)), 5) for q in range(4)], "query_id long, course_ref string, text string, k int")
    made = lexical.searchable(chunks)
    index = lexical.Searchable(kept(made.terms), kept(made.documents), kept(made.chunks))  # as stored: the batch is a column
    whole = sorted(map(tuple, lexical.search(index, asked, floor=0.0).collect()))
    assert len(whole) == 20
    monkeypatch.setattr(lexical, "TASK_BLOCKS", 10)  # more tasks than the session's 4 partitions
    bounded = lexical.search(index, asked, floor=0.0, many_blocks=0)
    plan = bounded._jdf.queryExecution().optimizedPlan().toString()
    dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[query_id#[^\]]*\], (\d+)", plan)]
    assert len(dealt) == 2 and dealt[0] == dealt[1] > 4  # the hits and the blocks they are joined with
    assert "Join LeftSemi" not in plan
    assert sorted(map(tuple, bounded.collect())) == whole
