"""Small tables through the operators: ties, nulls, invariants."""

import datetime
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lotlens.functions import text
from lotlens.operators import changes, evaluation, inference, keywords, lineage, photos, ranking, search, tables
from lotlens.sources import pages, records
from lotlens.streaming import progress


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_page_fields(spark):
    full = '<meta property="og:title" content="Big Sale starts on May 1"><title>x</title>"startDate":"2026-05-01T09:00","endDate":"2026-05-02","addressLine1":"1 Main","addressLocality":"Austin","addressRegion":"TX","postalCode":"78701"'
    url = "https://x/TX/Round-Rock/78664/42"
    df = spark.createDataFrame([(1, url, full), (2, url, '"startDate":"2026-05-01","endDate":"2026-05-02"'), (3, "https://x/9", "<title>T</title>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in pages.details(df, keep=("page_id",)).collect()}
    assert (got[1].title, got[1].city, got[1].start_date, got[1].address) == ("Big Sale", "Austin", "2026-05-01", "1 Main")
    assert (got[2].title, got[2].city, got[2].state, got[2].zip, got[2].address) == ("42", "Round Rock", "TX", "78664", "")
    assert [(r.page_id, r.missing) for r in pages.rejects(df, keep=("page_id",)).collect()] == [(3, ["start_date", "end_date", "city", "state", "zip"])]
    links = spark.createDataFrame([(1, '<a href="/TX/A/78664/1"><a href="/TX/B/78664/1"><a href="/tx/c/7/2"><a href="/TX/D/12345/3">')], "page_id int, html string")
    assert rows(pages.links(links), "link_id", "href") == [("1", "/TX/A/78664/1"), ("3", "/TX/D/12345/3")]


def test_hunts(spark):
    f = spark.createDataFrame([("1", "a", "Gold WATCH and lamp"), ("2", "a", "lamp"), ("3", "b", "chair")], "finding_id string, sale_id string, description string")
    hunts = spark.createDataFrame([("u1", 1, "w", ["watch"]), ("u1", 2, "home", ["Lamp", "gold"]), ("u1", 3, "home", ["lamp"])], "owner string, hunt_id int, name string, keywords array<string>")
    sales = spark.createDataFrame([("a",), ("b",)], "sale_id string")
    assert rows(ranking.hunt_match_counts(f, hunts), "sale_id", "name", "n") == [("a", "home", 4), ("a", "w", 1)]
    assert rows(ranking.hunt_gate(sales, f, hunts, "u1"), "sale_id", "no_hunts") == [("a", False)]
    assert rows(ranking.hunt_gate(sales, f, hunts, "nobody"), "sale_id", "no_hunts") == [("a", True), ("b", True)]
    assert rows(ranking.thumbnail(f, ranking.hunt_matches(f, hunts)), "sale_id", "finding_id") == [("a", "1"), ("b", "3")]


def test_dates_and_radius(spark):
    s = spark.createDataFrame([("a", datetime.date(2026, 1, 2), 30.0), ("b", datetime.date(2026, 1, 1), 30.01)], "sale_id string, end_date date, d double")
    day = F.lit("2026-01-02").cast("date")
    assert rows(ranking.upcoming(s, day), "sale_id") == [("a",)] and rows(ranking.past(s, day), "sale_id") == [("b",)]
    assert rows(ranking.within_radius(s, F.col("d"), 30.0), "sale_id") == [("a",)]


def test_search(spark):
    q = spark.createDataFrame([(1, "couch"), (2, "Record  player"), (3, " "), (4, "zebra")], "query_id int, query string")
    e = {r.query_id: r for r in search.expand(q, search.synonyms(spark)).collect()}
    assert {"couch", "sofa", "chaise lounge"} <= set(e[1].expanded) and e[1].categories == ["seating"]
    assert {"record", "player", "turntable"} <= set(e[2].expanded) and e[2].categories == ["electronics"]
    assert e[3].literal == [] and e[4].expanded == ["zebra"]
    lex = spark.createDataFrame([(1, "A", 0), (1, "B", 1)], "query_id int, sale_id string, rank int")
    sem = spark.createDataFrame([(1, "A", 0), (1, "C", 1)], "query_id int, sale_id string, rank int")
    got = {r.sale_id: r.score for r in search.fuse(lex, sem).collect()}
    assert got == pytest.approx({"A": 2 / 11, "B": 1 / 12, "C": 1 / 12})
    v = spark.createDataFrame([("s", "2", [1.0, 0.0]), ("s", "1", [2.0, 0.0]), ("t", "3", [0.0, 1.0]), ("u", "4", None), ("u", "5", [1.0])], "sale_id string, finding_id string, vector array<double>")
    near = search.semantic(spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<double>"), v)
    assert rows(near, "sale_id", "finding_id", "cosine") == [("s", "1", 1.0)]


def test_near_duplicates_fold(spark):
    data = [("s", 0, "a", 0), ("s", 1, "b", 0b111), ("s", 2, "c", 0b111111), ("s", 3, "d", None), ("s", 4, "e", 0), ("t", 0, "f", 0)]
    df = spark.createDataFrame(data, "sale_id string, position int, image_id string, phash long")
    # b is near a and goes; c is near b but not near a, and b is no survivor, so c stays; e repeats a
    assert rows(photos.collapse(df, 3).where("kept"), "image_id") == [("a",), ("c",), ("d",), ("f",)]
    assert rows(photos.near_pairs(df, 3), "a", "b", "distance") == [("a", "b", 3), ("a", "e", 0), ("b", "c", 3), ("b", "e", 3)]


def test_collapse_is_the_fold_in_order(spark):
    """In one task and in rounds, against the fold photo by photo."""
    rng = random.Random(3)
    data = []
    for g in range(3):
        hashes = [rng.getrandbits(63) for _ in range(6)]
        for i in range(60):
            h = rng.choice(hashes)
            for _ in range(rng.randint(0, 4)):
                h ^= 1 << rng.randint(0, 63)
            data.append((f"s{g}", i // 2, f"p{g}-{i}", h - (1 << 64) if h >> 63 else h))
    data.append(("s0", 99, "none", None))
    want, stay = set(), {}
    for g, _, k, h in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        if h is None or all(bin((h ^ s) & ((1 << 64) - 1)).count("1") > 3 for s in stay.setdefault(g, [])):
            want.add(k)
            stay.setdefault(g, []).append(h) if h is not None else None
    df = spark.createDataFrame(data, "sale_id string, position int, image_id string, phash long")
    for limit in (1000, 5):
        assert {r.image_id for r in photos.collapse(df, 3, limit=limit).where("kept").collect()} == want
    assert photos.collapse(df.limit(0), 3).count() == 0


def test_collapse_sends_its_rows_once(spark):
    df = spark.createDataFrame([("s", 0, "a", 7), ("s", 1, "b", 5), ("s", 2, "c", None), (None, 0, "d", 7)], "sale_id string, position int, image_id string, phash long")
    out = photos.collapse(df, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(out, "image_id", "kept") == [("a", True), ("b", False), ("c", True), ("d", True)]


def test_collapse_invariant(spark, sf_dir):
    from lotlens.plans.bindings import Tables
    from lotlens.plans.queries_photos import photos as photo_rows

    out = photos.collapse(photo_rows(Tables(spark, sf_dir)), 20, "source_id").toPandas()
    for _, g in list(out.groupby("source_id"))[:5]:
        kept = []
        for r in g.sort_values("position").itertuples():
            near = any(bin((k ^ r.phash) & (2**64 - 1)).count("1") <= 20 for k in kept)
            assert r.kept != near
            if r.kept:
                kept.append(r.phash)


def test_sampling(spark):
    def phase(found, n=20):
        data = [("s", f"{i:02d}", "x [high]" if i in found else "NOTHING") for i in range(n)]
        df = photos.positions(spark.createDataFrame(data, "source_id string, finding_id string, response string"), "source_id", "finding_id")
        out = photos.adaptive_sampling(df, "source_id", "finding_id").collect()
        return out[0].phase, sum(r.processed for r in out)

    assert phase({0}) == ("FULL", 20)
    assert phase(set()) == ("EARLY_STOP", 5 + 6)
    assert phase({15}) == ("TAIL_PROBE", 20)
    assert phase({7}) == ("EARLY_STOP", 11)
    assert phase(set(), 1) == ("FULL", 1)


def test_budget_keeps_floors(spark, sf_dir):
    df = spark.range(200).select((F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("s"), F.col("id").alias("k"))
    out = photos.budget_select(df, "g", "s", "k", budget=50, cost=1)
    assert out.count() == 50 and out.groupBy("g").count().agg(F.min("count")).first()[0] >= 4
    assert photos.budget_select(df, "g", "s", "k", budget=0.3, cost=0.1).count() == 3


def test_changes_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, w string")
    once = changes.upsert_coalesce(old, new, ["k"])
    assert rows(once, "k", "v", "w") == rows(changes.upsert_coalesce(once, new, ["k"]), "k", "v", "w") == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    assert rows(changes.upsert_replace(old, new, ["k"]), "k", "v", "w") == [(1, "a", None), (2, None, "y"), (3, "c", None)]
    first = changes.insert_only(old, new.unionByName(new), ["k"])
    assert rows(first, "k") == rows(changes.insert_only(first, new, ["k"]), "k") == [(1,), (2,), (3,)]
    assert rows(changes.update_columns(old, new, ["k"], ["w"]), "k", "v", "w") == [(1, "a", None), (2, "b", "y")]
    assert rows(changes.delete_keys(old, new, ["k"]), "k") == [(1,)]


def test_evaluation_edges(spark):
    r = spark.createDataFrame([(i, float(d)) for i, d in enumerate([99, 1, 2, 3, 10])], "seq int, duration_s double")
    got = evaluation.latency(r).first()
    assert (got.cold_start_s, got.p50, got.p95, got.avg_s, got.n) == (99, 2, 10, 4, 4)
    many = spark.range(1000).select(F.col("id").alias("seq"), ((F.col("id") * 37) % 1001).cast("double").alias("duration_s"))
    data = sorted(x * 37 % 1001 for x in range(1, 1000))
    got = evaluation.latency(many).first()
    assert (got.p50, got.p95) == (data[math.ceil(0.5 * 999) - 1], data[math.ceil(0.95 * 999) - 1])
    empty = evaluation.latency(r.where("seq > 99")).first()
    assert (empty.cold_start_s, empty.p50, empty.n) == (None, 0, 0)
    base = spark.createDataFrame([("a", True, 1), ("b", True, 2), ("c", True, 3), ("d", False, 4)], "image_url string, has_findings boolean, seq int")
    cand = spark.createDataFrame([("a", False, 1), ("a", True, 2), ("b", False, 3), ("d", True, 4)], "image_url string, has_findings boolean, seq int")
    a = evaluation.agreement(base, cand).first()
    assert (a.baseline_hits, a.both_hit, a.rate, a.matched, a.unmatched) == (3, 1, pytest.approx(0.333333), 2, 1)


def test_inference_fails_open(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, t string").coalesce(1)

    def model(batch):
        if "t2" in set(batch):
            raise RuntimeError("no")
        return [[1.0, 2.0] for _ in batch]

    out = inference.infer_batches(df, model, "t", "m", dim=2, batch_size=2)
    assert rows(out, "i", "embed_dim", "error") == [(0, 2, None), (1, 2, None), (2, None, "no"), (3, None, "no"), (4, 2, None)]
    item = "array<struct<index:int,embedding:array<double>>>"
    p = spark.createDataFrame([(1, 3, [(2, [1.0, 0.0]), (None, [2.0, 0.0]), (9, [1.0, 0.0]), (0, [1.0])])], f"request_id int, count int, data {item}")
    assert rows(inference.align_embeddings(p, 2), "slot", "vector") == [(0, None), (1, [2.0, 0.0]), (2, [1.0, 0.0])]


EVENTS = [(1, "sale_start", "a", 0.0), (2, "progress", "a", 1.0), (3, "sale_done", "a", 2.0), (4, "sale_start", "b", 0.0), (5, "oracle_request", "b", 0.0), (6, "sale_start", "a", 0.0), (7, "progress", "a", 5.0), (8, "sale_skip", "c", 0.0)]


def events(spark, data=EVENTS):
    return spark.createDataFrame([(s, t, k, v, None, None) for s, t, k, v in data], records.EVENT)


STATE = ("sale_id", "status", "n_progress", "last_value", "oracle_requested", "last_seq")


def test_event_folds(spark):
    e = events(spark)
    assert rows(progress.scan_progress(e), *STATE) == [("a", "analyzing", 1, 5.0, False, 7), ("b", "analyzing", 0, 0.0, True, 5)]
    assert rows(progress.flush_completed(e), "sale_id", "upto", "n_events") == [("a", 3, 3), ("c", 8, 1)]
    assert rows(progress.scan_status(e), "last_type", "running", "n_open", "failed", "message") == [("sale_skip", True, 2, False, None)]
    failed = spark.createDataFrame([(9, "run_failed", "b", None, None, "disk full"), (10, None, "b", None, None, None)][:1], records.EVENT)
    assert rows(progress.scan_status(e.unionByName(failed)), "last_type", "running", "n_open", "failed", "message") == [("run_failed", False, 2, True, "disk full")]
    assert rows(progress.scan_totals(e), "n_done", "n_skipped", "n_progress", "total_value") == [(1, 1, 2, 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    """Two runs of the stream over a growing log give the fold of the whole log."""
    for part in (EVENTS[:4], EVENTS[4:]):
        events(spark, part).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        progress.fold_stream(progress.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/fold", f"{tmp_path}/cp").awaitTermination()
    assert rows(progress.latest_state(spark, f"{tmp_path}/fold"), *STATE) == rows(progress.scan_progress(events(spark)), *STATE)


def test_stream_stands_any_order(spark, tmp_path):
    """Events that arrive before their start, starts that arrive last, each event in a micro-batch of its own."""
    rng = random.Random(8)
    data = [(s, rng.choice(["sale_start", "progress", "progress", "oracle_request", "sale_done", "sale_skip"]), rng.choice("abc"), float(s)) for s in range(24)]
    data += [(100, "progress", "late", 1.0), (101, "sale_done", "late", 2.0), (90, "sale_start", "late", 0.0), (5, "progress", "never", 1.0)]
    for k, e in enumerate(rng.sample(data, len(data))):
        events(spark, [e]).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if k == len(data) // 2:  # the stream ends and begins again
            progress.fold_stream(progress.read_stream(spark, f"{tmp_path}/in", files=2), f"{tmp_path}/fold", f"{tmp_path}/cp").awaitTermination()
    progress.fold_stream(progress.read_stream(spark, f"{tmp_path}/in", files=3), f"{tmp_path}/fold", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/fold").select("batch").distinct().count() > 4
    want = rows(progress.scan_progress(events(spark, data)), *STATE)
    assert rows(progress.latest_state(spark, f"{tmp_path}/fold"), *STATE) == want
    assert ("late", "done", 1, 2.0, False, 101) in want
    assert rows(progress.compact_state(spark, f"{tmp_path}/fold", f"{tmp_path}/small"), *STATE) == want


def test_status_stream(spark, tmp_path):
    data = [(4, "progress", "b", 1.0, None, "four"), (9, "run_failed", "a", None, None, "gone"), (2, "sale_start", "a", 0.0, None, "two"), (8, "progress", "a", None, None, None)]
    for k, e in enumerate(data):
        spark.createDataFrame([e], records.EVENT).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        progress.status_stream(progress.read_stream(spark, f"{tmp_path}/in", files=1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        want = rows(progress.scan_status(spark.createDataFrame(data[: k + 1], records.EVENT)), "last_type", "last_sale", "last_seq", "message", "failed")
        assert rows(progress.latest_state(spark, f"{tmp_path}/out", "run"), "last_type", "last_sale", "last_seq", "message", "failed") == want


def test_boilerplate_stream(spark, tmp_path):
    rng = random.Random(3)
    changes, held = [], []
    for _ in range(120):
        photo = (rng.choice("pqrs"), rng.choice("uvwxyz"))
        if held and rng.random() < 0.4:
            photo = held.pop(rng.randrange(len(held)))
            changes.append((*photo, -1))
        else:
            held.append(photo)
            changes.append((*photo, 1))
    for k in range(0, 120, 40):
        spark.createDataFrame(changes[k : k + 40] + [(None, "u", 1)], "phash string, sale_id string, change int").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        progress.boilerplate_stream(progress.read_stream(spark, f"{tmp_path}/in", "phash string, sale_id string, change int"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    now = spark.createDataFrame(held, "phash string, sale_id string")
    flagged = {r.phash for r in photos.boilerplate(now, least=3).where("is_boilerplate").collect()}
    assert {r.phash for r in progress.boilerplate_prints(spark, f"{tmp_path}/out", 3).collect()} == flagged and flagged


def test_a_broken_flush_is_repeated_without_doubles(spark, tmp_path):
    kinds = "seq long, sale_id string, kind string, payload string"
    put = lambda *r: spark.createDataFrame(list(r), kinds).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    start = lambda: progress.flush_stream(progress.read_stream(spark, f"{tmp_path}/in", kinds, files=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    put((1, "a", "sale_start", None), (2, "a", "analyzed_image", "i2"), (3, "a", "finding", "f3"), (1, "b", "analyzed_image", "lost"))
    start().awaitTermination()
    put((5, "a", "finding", "f5"), (6, "a", "sale_done", None), (2, "b", "sale_start", None), (3, "b", "analyzed_image", "i3"))
    os.makedirs(tmp_path / "out", exist_ok=True)
    os.rename(tmp_path / "out" / "findings", tmp_path / "out" / "aside")
    (tmp_path / "out" / "findings").write_text("in the way")
    with pytest.raises(Exception):  # noqa: B017
        start().awaitTermination()
    os.remove(tmp_path / "out" / "findings")
    os.rename(tmp_path / "out" / "aside", tmp_path / "out" / "findings")
    put((4, "a", "analyzed_image", "late"), (9, "a", "finding", "next"), (7, "b", "sale_skip", None), (8, "b", "sale_done", None))
    start().awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/images"), "sale_id", "payload") == [("a", "i2"), ("a", "late"), ("b", "i3")]
    assert rows(spark.read.parquet(f"{tmp_path}/out/findings"), "sale_id", "payload") == [("a", "f3"), ("a", "f5")]


def test_streams_take_each_photo_once(spark, tmp_path):
    url = lambda *names: spark.createDataFrame([(n, n) for n in names], "image_url string, sale_id string").coalesce(1)
    for part in (("a", "b"), ("b", "c", "c")):
        url(*part).write.mode("append").json(f"{tmp_path}/urls")
        progress.ingest_new(progress.read_stream(spark, f"{tmp_path}/urls", "image_url string, sale_id string"), f"{tmp_path}/new", f"{tmp_path}/cp1").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/new"), "image_url", "batch") == [("a", 0), ("b", 0), ("c", 1)]


def test_a_log_gives_each_event_once(spark, tmp_path):
    log = tmp_path / "log.json"
    line = lambda k: '{"seq": %d, "type": "progress", "sale_id": "é"}' % k
    log.write_text(f"{line(1)}\nnot json\n\n{line(2)}")  # the last line is not complete, though it parses
    first = lineage.settle(records.log_offsets(spark, str(log)))
    assert [r.next_line for r in first.collect()] == [3]
    assert rows(records.read_log(spark, str(log), first), "line", "seq") == [(0, 1)]
    with log.open("a") as f:
        f.write(f"\n{line(3)}\r\n" + "".join(f"{line(k)}\n" for k in range(4, 300)) + '{"seq": 9')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        second = lineage.settle(records.log_offsets(spark, str(log)))
        assert [r.next_line for r in second.collect()] == [301]
        assert rows(records.read_log(spark, str(log), second, first), "line", "seq") == [(k + 1, k) for k in range(2, 300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrays_are_read_as_they_are_written(spark, tmp_path):
    made = spark.createDataFrame([(str(k), None, k) for k in range(50)], "sale_id string, response string, total int").repartition(3)
    records.write_array(made, f"{tmp_path}/a")
    assert rows(records.read_array(spark, f"{tmp_path}/a"), "sale_id", "response", "total") == rows(made, "sale_id", "response", "total")
    records.write_array(made.limit(0), f"{tmp_path}/b")
    assert records.read_array(spark, f"{tmp_path}/b").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "type": "progress", "sale_id": "a"}\nnot json\n{"seq": 2, "type": "sale_done", "sale_id": "a"}\n')
    assert rows(records.read_events(spark, str(tmp_path / "log.json"), 2), "seq", "type") == [(2, "sale_done")]
    (tmp_path / "r.json").write_text('[{"sale_id": "a", "image_url": "u", "has_findings": true}]')
    assert rows(records.read_array(spark, str(tmp_path / "r.json")), "sale_id", "has_findings") == [("a", True)]
    (tmp_path / "one.json").write_text(' {"sale_id": "a", "image_url": "u", "has_findings": true}')
    with pytest.raises(ValueError):
        records.read_array(spark, str(tmp_path / "one.json"))
    nested = spark.createDataFrame([("a", [("u", "d"), ("v", "e")]), ("b", None)], "sale_id string, findings array<struct<image_url:string,findings:string>>")
    done = spark.createDataFrame([("u",)], "image_url string")
    assert rows(records.import_nested(nested, done), "sale_id", "image_url", "description") == [("a", "v", "e")]


def test_words_are_sent_in_blocks(spark):
    texts = spark.createDataFrame([(1, "an oak table"), (2, "a"), (3, ""), (4, None), (5, "table lamp tab")], "i int, t string")
    words = spark.createDataFrame([("oak",), ("ab",), ("a",), ("table",), ("lamps",), ("tab",)], "w string")
    owners = words.select("w", F.col("w").alias("owner"))
    want = rows(keywords.found_in(texts, "t", owners, "w"), "i", "owner")
    assert want == rows(keywords.found_in(texts, "t", owners, "w", most=2), "i", "owner") and len(want) == 10
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    assert rows(search.against_all(a, b, "b", most=2), "a", "b") == [(x, y) for x in range(7) for y in range(5)]


def test_white_space_that_is_trimmed(spark):
    df = spark.createDataFrame([("\u00a0\ufeff\t x\u2003y \u2028\n",)], "t string")
    assert df.select(text.strip("t")).first()[0] == "x\u2003y"


class Session:
    """As much of a session as the choice of a folder reads."""

    def __init__(self, master, **settings):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: settings.get(k, d)), "set": staticmethod(settings.__setitem__)})


def test_where_shared_tables_go():
    with pytest.raises(ValueError):
        lineage.shared_dir(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        lineage.shared_dir(Session("local-cluster[3,2,1000]"))
    both = {"spark.checkpoint.dir": "hdfs://a/b/", lineage.SHARED: "hdfs://c"}
    assert lineage.shared_dir(Session("yarn", **both)).startswith("hdfs://a/b/lotlens-")
    assert lineage.shared_dir(Session("yarn", **{lineage.SHARED: "hdfs://c"})).startswith("hdfs://c/lotlens-")
    one = Session("local[4]")
    assert lineage.shared_dir(one).rpartition("/")[0] == lineage.shared_dir(one).rpartition("/")[0]


def test_settled_tables_can_be_discarded(spark):
    df = lineage.settle(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 5 and os.path.isdir(folder)
    lineage.discard(df)
    assert not os.path.exists(folder)


def test_many_keywords_in_one_pass(spark):
    """50,000 keywords of 20,000 owners against plain containment, owners with several words, words of several owners."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(3, 7)))
    owners = [(word(), rng.randrange(20_000), "n") for _ in range(50_000)] + [("", 1, "n"), (None, 2, "n"), ("zzz", None, None)]
    texts = [(i, "".join(rng.choice("abcdé ") for _ in range(60))) for i in range(40)] + [(100, None), (101, ""), (102, "a zzz b")]
    want = sorted((i, o) for i, t in texts for o in {o for w, o, _ in owners if w and t and w in t and o is not None})
    a = spark.createDataFrame(texts, "i int, t string").repartition(3)
    b = spark.createDataFrame(owners, "w string, owner int, name string")
    for most in (200_000, 9_000):
        got = keywords.found_in(a, "t", b, "w", most=most)
        assert rows(got.where("owner IS NOT NULL"), "i", "owner") == want and len(want) > 1000
        assert rows(got.where("owner IS NULL"), "i") == [(102,)]
    assert keywords.found_in(a, "t", b.limit(0), "w").count() == 0


def test_a_table_is_changed_where_its_keys_lie(spark, tmp_path):
    path, keys, n = f"{tmp_path}/t", ["k"], 512
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    table = lambda: {r.k: (r.a, r.b) for r in tables.read(spark, path).collect()}
    old = spark.range(4000).selectExpr("id AS k", "id * 2 AS a", "CAST(id AS STRING) AS b")
    tables.create(old, path, keys, n)
    want, before = {k: (2 * k, str(k)) for k in range(4000)}, files()
    new = spark.createDataFrame([(100 * k, None, f"new{k}") for k in range(40)] + [(5000, 1, None)], "k long, a long, b string")
    for _ in range(2):  # twice is as once
        touched = tables.apply(spark, path, new, keys, lambda a, b: changes.upsert_coalesce(a, b, keys), n)
        want |= {100 * k: (200 * k, f"new{k}") for k in range(40)} | {5000: (1, None)}
        assert table() == want
    assert len(touched) <= 41 and len(before & files()) >= len(before) - 41
    kept = files()
    assert tables.apply(spark, path, new.limit(0), keys, lambda a, b: changes.upsert_coalesce(a, b, keys), n) == [] and files() == kept
    # a bucket that loses all its rows loses its folder
    gone = old.where(tables.bucket_of(keys, n) < 3).select("k")
    tables.apply(spark, path, gone, keys, lambda a, b: changes.delete_keys(a, b, keys), n)
    left = {r.k for r in gone.collect()}
    assert left and table() == {k: v for k, v in want.items() if k not in left}
    for change, check in ((changes.insert_only, (0, "new0")), (changes.upsert_replace, (None, "x"))):
        tables.apply(spark, path, spark.createDataFrame([(77, None, "x")], "k long, a long, b string"), keys, lambda a, b, c=change: c(a, b, keys), n)
    assert table()[77] == (None, "x")


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_ranks_despite_outliers_and_ties(spark, most):
    rng = random.Random(4)
    data = [1e15, -1e15] + [rng.gauss(0, 1) for _ in range(700)] + [3.0] * 500 + [rng.choice([1e-9, 2e-9]) for _ in range(99)]
    rows_ = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double").repartition(3)
    got = evaluation.nearest_ranks(rows_, "v", {"a": 0.5, "b": 0.95, "c": 1.0, "d": 0.0001}, most=most).first()
    data.sort()
    assert [got[c] for c in "abcd"] == [data[max(0, math.ceil(round(len(data) * p, 9)) - 1)] for p in (0.5, 0.95, 1.0, 0.0001)]
    assert evaluation.nearest_ranks(rows_.limit(0), "v", {"a": 0.5}).first().a is None


def test_a_large_group_is_compared_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(photos.grid_pairs, "__defaults__", (20,))
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    flip = lambda h: (h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 24)))) - (1 << 63)
    data = [("big" if k < 300 else f"s{k % 5}", k, flip(rng.choice(base))) for k in range(340)] + [("big", 900, None), (None, 901, 1), (None, 902, 1)]
    df = spark.createDataFrame(data, "sale_id string, image_id int, phash long")
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    held = [d for d in data if d[0] and d[2] is not None]
    want = sorted((g, a, b, bits(x, y)) for g, a, x in held for h, b, y in held if g == h and a < b and bits(x, y) <= 20)
    assert rows(photos.near_pairs(df, 20), "sale_id", "a", "b", "distance") == want and len(want) > 200
    # the fold of a group over the limit, settled in rounds over these pairs, against one task
    df = df.where("sale_id IS NOT NULL").withColumn("position", F.col("image_id"))
    assert rows(photos.collapse(df, 20, limit=50), "image_id", "kept") == rows(photos.collapse(df, 20), "image_id", "kept")


def test_positions_of_a_sale_with_half_of_all_rows(spark):
    rng = random.Random(9)
    names = rng.sample(range(10_000), 900)
    data = [("hot" if k % 2 else None if k % 50 == 0 else f"s{k % 400}", f"é{n:05d}", "x") for k, n in enumerate(names)]
    df = spark.createDataFrame(data, "sale_id string, image_id string, total2 string").repartition(4)
    cuts = photos.large_groups(df, "sale_id", "image_id", 400)
    assert "hot" in cuts and 20 < len(cuts["hot"]) <= photos.PARTS and photos.large_groups(df, "sale_id", "image_id") == {}
    got = photos.positions(df, "sale_id", "image_id", 400)
    assert got.columns == photos.positions(df, "sale_id", "image_id").columns
    of = {}
    for g, i, _ in data:
        of.setdefault(g, []).append(i)
    want = sorted((i, of_g.index(i), len(of_g)) for of_g in map(sorted, of.values()) for i in of_g)
    assert rows(got, "image_id", "position", "total") == want == rows(photos.positions(df, "sale_id", "image_id"), "image_id", "position", "total")


def test_escalation_reads_a_response_once(spark):
    data = [("s", 0, "chair [low]"), ("s", 1, "TOYS: NONE"), ("s", 2, "lamp [low]\nTOYS: 0"), ("s", 3, "x" * 1401), ("t", 0, "NOTHING"), ("s", 4, None)]
    out = photos.escalation_evidence(spark.createDataFrame(data, "sale_id string, position int, response string"), "sale_id")
    assert out.select("evidence_rank", "position")._jdf.queryExecution().optimizedPlan().toString().count("trim(response") == 1
    assert rows(out, "sale_id", "position", "evidence_rank") == [("s", 0, 1), ("s", 2, 2)]
