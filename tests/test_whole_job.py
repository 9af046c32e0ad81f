"""The queries over all of their input; the DuckDB side is written here where a registered twin asks for less."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import trees
from scriptorium.queries import ORACLE_SQL, QUERIES
from scriptorium.queries.course import batch

SF = "/root/testdata/sf0.001"


def agree(spark, name, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = lambda it: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in it)
    found = rows(got.select(*columns).collect())
    assert found == rows(con.sql(sql).select(", ".join(columns)).fetchall())
    return found


@pytest.mark.parametrize("name", ["lexical_search_batch", "lexical_doc_filter", "confidence_flag", "grounded_prompt", "echo_answer", "merge_passages"])
def test_batch_asks_whole_texts(spark, name):
    assert "substr(text, 1, 60)" not in ORACLE_SQL[name]
    assert agree(spark, name, ORACLE_SQL[name])
    asked = {r.query_id: r.text for r in batch(spark, SF).collect()}
    assert asked == {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert max(map(len, asked.values())) > 60


def test_text_floor_reads_html(spark, tmp_path):
    assert "url" not in ORACLE_SQL["text_floor_pages"]
    assert agree(spark, "text_floor_pages", ORACLE_SQL["text_floor_pages"])
    pages = [(0, "<b>" + "x" * 14 + "</b>"), (4, "<b>" + "x" * 15 + "</b>"), (1, "<p>" + "x" * 39 + "</p>"), (5, "<p>" + "x" * 40 + "</p>"), (2, "<i> </i>"), (6, "<i>x</i>"), (3, "&nbsp;" * 60), (7, "y" * 40), (8, None)]
    spark.createDataFrame([(i, "u" * 60, h) for i, h in pages], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, QUERIES["text_floor_pages"](spark, str(tmp_path)).collect())) == [(4, "file"), (5, "wiki"), (6, "news"), (7, "description")]


def test_trees_of_any_size_and_depth(spark):
    settings = {k: spark.conf.get(k) for k in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")}
    wide = spark.range(1_000_000).selectExpr("0 AS tree", "id", "CASE WHEN id = 0 THEN NULL ELSE 0 END AS parent", "id * 7 % 1000003 AS position")
    got = trees.reading_order(wide)
    assert got.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first() == (1_000_000, 1, 1_000_000)
    assert [r.id for r in got.orderBy("place").limit(3).collect()] == [0, *[r.id for r in wide.filter("id > 0").orderBy("position").limit(2).collect()]]
    chain = spark.range(5_000).selectExpr("'c' AS tree", "id", "CASE WHEN id > 0 THEN id - 1 END AS parent", "0 AS position")
    assert trees.reading_order(chain).filter("place <> id + 1").count() == 0
    many = spark.range(300_000).selectExpr("id % 100 AS tree", "id", "CAST(NULL AS BIGINT) AS parent", "'fold' AS type", "'n' AS title")
    assert trees.folder_walk(many).count() == 300_000
    assert settings == {k: spark.conf.get(k) for k in settings}


def test_reading_order_as_recursion(spark):
    rnd = random.Random(6)
    rows = []
    for tree in ("a", "b", None):
        ids = [f"{i:03}" for i in range(60)]
        rows += [(tree, i, None if n < 3 else "gone" if n % 17 == 5 else ids[rnd.randrange(n)], rnd.choice([None, 0, 1, 2])) for n, i in enumerate(ids)]
        rows += [(tree, "x", "y", 1), (tree, "y", "x", 0), (tree, "z", "x", 0)]  # a cycle and what hangs on it
    rows = [r for r in rows if r[0] is not None]
    want = {}
    for tree in ("a", "b"):
        own = [r for r in rows if r[0] == tree]
        rank = lambda r: (r[3] is not None, r[3] or 0, r[1])
        out = []

        def visit(parent):
            for r in sorted((r for r in own if r[2] == parent), key=rank):  # noqa: B023
                out.append(r[1])  # noqa: B023
                visit(r[1])

        visit(None)
        out += [r[1] for r in sorted((r for r in own if r[1] not in out), key=rank)]
        want |= {(tree, i): n for n, i in enumerate(out, 1)}
    frame = spark.createDataFrame(rows, "tree string, id string, parent string, position int").repartition(5)
    assert {(r.tree, r.id): r.place for r in trees.reading_order(frame).collect()} == want
    assert trees.reading_order(frame.limit(0)).count() == 0
