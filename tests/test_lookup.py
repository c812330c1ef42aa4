"""Substring queries by the inverted index against plain Python."""

import random

import pytest

from slotvalue.operators import links, rank

NAMED = "item_id string, name string, pos int"


def catalog(rng, n=300):
    words = ["Gold", "gold", "ÄRger", "ring", "a", "ab", "abcabc", "x😀y", "Skull Ring"]
    rows = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), i) for i in range(n)]
    return [*rows, ("none", None, n), ("empty", "", n + 1), ("id7", "zebra", n + 2)]


@pytest.mark.parametrize("gram", [1, 3, 5])
def test_queries_of_all_lengths(spark, gram):
    rows = catalog(random.Random(1))
    asked = ["", "a", "G", "ab", "cab", "abca", "GOLD R", "ärger", "😀", "x😀", "nothing", "zz", " ", "skull ring", "bcabc "]
    table = spark.createDataFrame([(q,) for q in [*asked, "a", None]], "query string")
    found = [(r.query, r.item_id) for r in links.find_asked(spark.createDataFrame(rows, NAMED), table, gram).collect()]
    want = {(q, i) for q in asked for i, name, _ in rows if name is not None and q.lower() in name.lower()}
    assert set(found) == want and len(found) == len(want)
    plan = links.find_asked(spark.createDataFrame(rows, NAMED), table, gram)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join Inner") >= 1


def test_unique_match_of_a_table_equals_that_of_literals(spark):
    rows = catalog(random.Random(2), 60)
    names = spark.createDataFrame(rows, NAMED)
    asked = ["zebra", "7", "id7", "ring", "nothing", "ab"]
    by_table = links.resolve_unique(names, spark.createDataFrame([(q,) for q in asked], "query string"), 4)
    by_literal = links.resolve_unique(names, asked, 4)
    key = lambda df: sorted(map(str, map(tuple, df.select("query", "status", "hits", "item_id", "name").collect())))
    assert key(by_table) == key(by_literal) and by_table.where("status = 'ambiguous'").count() >= 4
    assert by_table.where("query = 'zebra'").first().status == "unique" and by_table.where("query = 'id7'").first().status == "id"


@pytest.mark.parametrize("sent", [0, links.SENT_QUERIES])
def test_the_index_is_never_broadcast(spark, tmp_path, monkeypatch, sent):
    """A small file of names makes a large index, which the planner takes for small."""
    monkeypatch.setattr(links, "SENT_QUERIES", sent)
    rows = catalog(random.Random(4))
    spark.createDataFrame(rows, NAMED).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    asked = ["", "a", "ring", "bcabc ", "7", "nothing"]
    table = spark.createDataFrame([(q,) for q in asked], "query string")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    found = links.find_asked(names, table)
    assert plan(found).count("BroadcastHashJoin") == (sent > 0) and "BuildLeft" not in plan(found)
    want = {(q, i) for q in asked for i, name, _ in rows if name is not None and q in name.lower()}
    assert {(r.query, r.item_id) for r in found.collect()} == want
    unique = links.resolve_unique(names, table, 4)
    assert plan(unique).count("BroadcastHashJoin") == 2 * (sent > 0) and "BuildLeft" not in plan(unique)
    assert {r.query: r.status for r in unique.collect()} == {"": "ambiguous", "a": "ambiguous", "ring": "ambiguous", "bcabc ": "ambiguous", "7": "id", "nothing": "none"}


def test_no_queries(spark):
    names = spark.createDataFrame(catalog(random.Random(3), 5), NAMED)
    nobody = spark.createDataFrame([], "query string")
    assert links.find_asked(names, nobody).collect() == [] and links.resolve_unique(names, nobody, 3).collect() == []


def test_overflow_counts_what_the_cap_drops(spark):
    rows = [("s1", i, 0.5) for i in range(7)] + [("s2", i, 0.5) for i in range(3)]
    table = spark.createDataFrame(rows, "session_id string, det_idx int, det_conf double")
    over = {r.session_id: r.over for r in rank.overflow(table, 3).collect()}
    kept = {r["session_id"]: r["count"] for r in rank.cap_detections(table, 3).groupBy("session_id").count().collect()}
    assert over == {"s1": 4} and kept == {"s1": 3, "s2": 3}
