"""The corpus pipeline and the registered corpus queries."""

import collections
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotlens.llm import quality, queries

from ..compare import assert_same, connect
from . import fixture
from .test_corpus import plain_counts, shingles, similar_pairs
from .test_quality import plain_slots


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name])


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen, last = docs.columns, set(), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in last.select("doc_id").collect()}
        stage(spark, last, sf_dir).write.parquet(f"{tmp_path}/{k}")
        last = spark.read.parquet(f"{tmp_path}/{k}")
        seen.add(name)
        assert {r.doc_id for r in last.select("doc_id").collect()} <= before
        if k < 4:
            assert last.columns == columns
            assert last.where(F.length("text") != F.col("n_chars")).count() == 0
    assert len(seen) == 5
    per = last.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n > 4096 OR n <> end").count() == 0
    assert set(before) == {r.doc_id for r in last.select("doc_id").collect()}


def keeps_good(spark, sf_dir, docs):
    """What the base rules and the model's n-grams, taken one by one, keep."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_logistic(*quality.labelled_sample(df, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    for i, t in docs:
        n, *_, repeat = plain_counts(t)
        slots = plain_slots(t, model["bits"])
        p = 1 / (1 + math.exp(-model["slope"] * model["weights"][slots].mean() - model["shift"])) if slots else 0.0
        if n >= 20 and 100 * repeat <= 30 * n and p >= 0.5:
            yield i, t


def keeps_first_lines(docs):
    lines = {i: [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")] for i, t in docs}
    runs = lambda ls: [(k, 2, (ls[k][1], ls[k + 1][1])) for k in range(len(ls) - 1)] + [(k, 1, x) for k, (_, x) in enumerate(ls) if len([w for w in x.split(" ") if w]) >= 20]
    first = {}
    for i, ls in sorted(lines.items()):
        for k, _, key in runs(ls):
            first.setdefault(key, (i, k))
    for i, t in docs:
        gone = {lines[i][k + j][0] for k, n, key in runs(lines[i]) if first[key] != (i, k) for j in range(n)}
        if not lines[i] or len(gone) < len(lines[i]):
            yield i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)


def keeps_one(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    kinds, name = [s for _, s in sets], list(range(len(sets)))
    pairs = similar_pairs(kinds) | {(j, k) for k in range(len(kinds)) for j in range(k) if kinds[j] == kinds[k] and kinds[j]}
    for _ in range(30):
        for j, k in pairs:
            name[j] = name[k] = min(name[j], name[k])
    return [(i, t) for k, (i, t) in enumerate(docs) if name[k] == k]


def keeps_clean(docs, items):
    """Items of 13 words or more: 11 of 13 agree only where four words in a row do."""
    grams = collections.defaultdict(set)
    items = {k: (t or "").lower().split() for k, t in items}
    assert min(len(v) for v in items.values()) >= 13
    for k, v in items.items():
        for j in range(len(v) - 3):
            grams[tuple(v[j : j + 4])].add((k, j))
    for i, t in docs:
        w = t.lower().split()
        places = {(k, at - j) for at in range(len(w) - 3) for k, j in grams.get(tuple(w[at : at + 4]), ())}
        hit = False
        for k, shift in places:
            same = [0 <= shift + j < len(w) and w[shift + j] == x for j, x in enumerate(items[k])]
            hit = hit or any(sum(same[a : a + 13]) >= 11 for a in range(len(same) - 12))
        if not hit:
            yield i, t


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    """Each of the first four stages on what its predecessor kept."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    # near copies on one line, and two documents with an item of the benchmark in their midst
    made = [(10_000 + r.doc_id, " ".join("edit" if k == 30 else w for k, w in enumerate(r.text.split()))) for r in df.where("length(text) > 1000").limit(30).collect()]
    made += [(20_000 + k, t.replace("edit", items[k][1])) for k, (_, t) in enumerate(made[:2])]
    df = df.unionByName(spark.createDataFrame(made, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'made' AS source", "length(text) AS n_chars"))
    plain = [lambda d: keeps_good(spark, sf_dir, d), keeps_first_lines, keeps_one, lambda d: keeps_clean(d, items)]
    for k, (keep, (name, stage)) in enumerate(zip(plain, corpus_pipeline.STAGES)):
        docs = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert got == sorted(keep(docs)), name
        assert len(got) < len(docs), name  # each stage has something to do


def test_stages_take_empty_and_odd_tables(spark, sf_dir, tmp_path):
    for name, df in (("odd", fixture.docs(spark)[0]), ("empty", fixture.empty(spark))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{name}{k}")
            df = spark.read.parquet(f"{tmp_path}/{name}{k}")


def test_stages_keep_every_row_they_promise(spark, tmp_path):
    """Null ids twice, null texts, one id with different texts, equal rows with other columns, and columns of awkward names."""
    benchmark = " ".join(f"bench{k}" for k in range(30))
    near = " ".join(f"word{k}" for k in range(80))
    rows = [(None, near, 1), (None, near, 1), (None, None, 2), (None, None, 2), (None, benchmark, 3), (1, near, 4), (1, benchmark, 5), (1, "clean text of its own", 6), (2, near + " more", 7), (3, None, 8), (3, None, 8), (4, near, 9), (4, near, 10)]
    docs = spark.createDataFrame([(i, t, k, k, k, k, k, k, k) for i, t, k in rows], "doc_id long, text string, _ int, _d int, `a.b` int, row int, h int, least int, _row int").repartition(3)
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near_left = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert near_left.columns == docs.columns
    got = sorted((r.doc_id or 0, r["a.b"]) for r in near_left.collect())
    assert got == [(0, 1), (0, 1), (0, 2), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (3, 8)]
    clean = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(r["a.b"] for r in clean.collect()) == sorted(k for i, t, k in rows if i is None or t != benchmark)
    lines = corpus_pipeline.line_stage(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    assert sum(r.doc_id is None for r in lines.collect()) == 5


def test_line_stage_deletes_a_long_line_between_other_neighbours(spark, sf_dir):
    long, short = " ".join(f"w{k}" for k in range(20)), " ".join(f"w{k}" for k in range(19))
    df, _ = fixture.docs(spark, texts=[(0, f"a\n{long}\nb\n{short}"), (1, f"c\n\t{long}\nd\n{short}\ne"), (2, long)])
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, sf_dir).collect()}
    assert got == {0: f"a\n{long}\nb\n{short}", 1: f"c\nd\n{short}\ne"}
