"""Queries that ask for the same text, and hunts that want the same keywords, are worked out once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lotlens.operators import ranking, search


@pytest.mark.parametrize("most", [2, 100])
def test_rows_of_a_text_go_to_all_its_queries(spark, most):
    queries = spark.createDataFrame([(k, "ab"[k % 2] if k else None) for k in range(9)], "query_id int, query string")
    assert sorted((r.query, r.query_id) for r in search.texts(queries).where("query IS NOT NULL").collect()) == [("a", 2), ("b", 1)]
    hits = spark.createDataFrame([(q, s) for q in (0, 1, 2) for s in ("z", "y", "x")], "query_id int, sale_id string").coalesce(1)
    out = search.for_all(hits, queries, most=most)
    got = [(r.query_id, r.sale_id) for r in out.collect()]
    assert Counter(got) == Counter((k, s) for k in range(9) for s in "xyz")
    assert all([s for q, s in got if q == k] == ["z", "y", "x"] for k in range(9))
    assert search.for_all(hits, queries.limit(0)).count() == 0
    assert "Exchange" not in search.for_all(spark.range(10).selectExpr("id AS query_id"), queries)._jdf.queryExecution().executedPlan().toString()


def test_hunts_that_want_the_same_are_matched_once(spark):
    f = spark.createDataFrame([("1", "a", "Brass LAMP"), ("2", "a", "lamp and sofa"), ("3", "b", "sofa"), ("4", "b", None)], "finding_id string, sale_id string, description string")
    hunts = spark.createDataFrame([(k, "home" if k % 2 else "away", ["Lamp", "lamp"] if k < 900 else ["sofa", "lamp", ""]) for k in range(1000)] + [(1000, "none", []), (1001, "null", None)], "hunt_id int, name string, keywords array<string>")
    sets = ranking.keyword_sets(hunts)
    assert ranking.set_matches(f, sets).count() == 2 + 3
    want = ranking.hunt_matches(f, hunts).groupBy("sale_id", "name").agg(F.count("*").alias("n"))
    rows = lambda df: sorted((r.sale_id, r.name, r.n) for r in df.collect())
    assert rows(ranking.hunt_match_counts(f, hunts)) == rows(want) == [("a", "away", 1000), ("a", "home", 1000), ("b", "away", 50), ("b", "home", 50)]
    sales = spark.createDataFrame([("a",), ("b",), ("c",)], "sale_id string")
    out = {r.sale_id: (r.total_matched, r.thumb_finding) for r in ranking.sale_summary(sales, f, hunts).collect()}
    assert out == {"a": (2, "2"), "b": (1, "3"), "c": (0, None)}
