"""Searches over many queries: what is shuffled, and that it is still the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.operators import keys, search, vectors
from lotlens.plans import queries_sales, registry
from lotlens.plans.bindings import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("most", "cells"), [(100, 1 << 18), (3, 1 << 18), (100, 1)])
def test_fused_for_all_queries_as_fused_one_by_one(spark, monkeypatch, most, cells):
    monkeypatch.setattr(search, "CELLS", cells)
    rng = np.random.default_rng(11)
    queries = spark.createDataFrame([(k, "abc"[k % 3] if k else None) for k in range(10)], "query_id int, query string")
    lex = spark.createDataFrame([(q, f"s{s}", int(r)) for q in (1, 2, 3) for r, s in enumerate(rng.permutation(60)[:40])], "query_id int, sale_id string, rank int")
    sem = spark.createDataFrame([(q, f"s{s}", int(r)) for q in range(10) for r, s in enumerate(rng.permutation(80)[:25])], "query_id int, sale_id string, rank int")
    rows = lambda df: sorted(((r.query_id, r.sale_id, r.score, r.lex_rank) for r in df.collect()), key=lambda r: r[:2])
    want = rows(search.fuse(search.for_all(lex, queries), sem))
    assert rows(search.fuse_for_all(lex, sem, queries, most=most)) == want
    assert {q for q, *_ in want} == set(range(10)) and any(r[3] is None for r in want)
    assert rows(search.fuse_for_all(lex, sem.limit(0), queries)) == rows(search.fuse(search.for_all(lex, queries), sem.limit(0)))
    assert search.fuse_for_all(lex, sem, queries.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["rrf_fuse", "hybrid_search"])
def test_fused_rows_are_not_grouped_once_they_are_those_of_all_queries(spark, sf_dir, name):
    above = plan(registry.QUERIES[name](spark, sf_dir)).split("MapInArrow")[0]
    assert "Aggregate" not in above and "Join" not in above


@pytest.mark.parametrize("bits", [6, 7, 25])
def test_rows_of_wanted_keys(spark, bits):
    rows = spark.createDataFrame([(k % 50 if k else None, k) for k in range(400)], "a int, b int")
    wanted = spark.createDataFrame([(str(k),) for k in (3, 7, 7, 49, 1000)] + [(None,)], "id string")
    got = keys.kept_by(rows, F.col("a").cast("string"), wanted, bits=bits)
    assert got.columns == ["a", "b"]
    assert sorted(r.b for r in got.collect()) == [k for k in range(1, 400) if k % 50 in (3, 7, 49)]


def test_line_items_of_other_sales_go_before_any_shuffle(spark, sf_dir):
    t = Tables(spark, sf_dir)
    for df in (queries_sales.candidates(t), queries_sales.lexical_hits(t)):
        lines = plan(df).splitlines()
        depth = lambda s: len(s) - len(s.lstrip(" :+-"))
        scans = [i for i, line in enumerate(lines) if "Relation" in line and "l_orderkey" in line]
        assert len(scans) == 2
        for i in scans:
            joins, at = [], depth(lines[i])
            for line in reversed(lines[:i]):
                if depth(line) < at:
                    at = depth(line)
                    joins += [line] if "Join" in line else []
            assert "_word" in joins[0] and "_key" in joins[1]  # the first that it meets has the bits


def test_cosines_from_a_matrix_product_round_as_the_fold_does():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((400, 64)).astype("float32").astype(float), rng.standard_normal((90, 64)).astype("float32").astype(float)
    q[:40] = x[:40]
    # in two places: cosines that lie at halves of a unit, where the order of summing decides
    for size, scale in ((64, 1.0), (2, 1e-9)):
        a, b = x[:, :size] * 1.0, q[:, :size] * 1.0
        if size == 2:
            a, b = np.c_[np.ones(400), (np.arange(400) + 0.5) * scale], np.c_[np.zeros(90), np.ones(90)]
        na, nb = vectors.norms(a), vectors.norms(b)
        unit = np.ascontiguousarray((b / nb[:, None]).T) * vectors.UNIT
        want = np.rint(vectors.cosines_of(a, na, b, nb) * vectors.UNIT)
        assert np.array_equal(vectors.rounded(a, na, b, nb, unit), want)


def test_rows_of_a_text_are_ordered_in_many_parts(spark, sf_dir):
    queries = spark.createDataFrame([(k, "ab"[k % 2] if k else None) for k in range(9)], "query_id int, query string")
    hits = spark.createDataFrame([(q, s) for q in (0, 1, 2) for s in ("y", "x", "z")], "query_id int, sale_id string")
    order = lambda df: [[r.sale_id for r in df.collect() if r.query_id == k] for k in range(9)]
    for most in (2, 100):
        assert order(search.ordered_for_all(hits, queries, "query_id", F.desc("sale_id"), most=most)) == [["z", "y", "x"]] * 9
        assert sorted(map(tuple, search.asked(hits, queries, most=most).collect())) == [(k, s) for k in range(9) for s in "xyz"]
    assert search.ordered_for_all(hits, queries.limit(0), "query_id").count() == 0
    found = registry.QUERIES["lexical_search"](spark, sf_dir)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    miles = {r.sale_id: r.distance_miles for r in Tables(spark, sf_dir).sales.select("sale_id", "distance_miles").collect()}
    rows = {}
    for r in found.collect():
        rows.setdefault(r.query_id, []).append((-r.score, miles[r.sale_id], r.sale_id))
    assert len(rows) > 3 and all(of == sorted(of) for of in rows.values())
