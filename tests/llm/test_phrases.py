"""Phrase mining against plain counts, and its SQL."""

import collections
import random
import re

import pytest

from lotlens.llm import phrases, queries

from ..compare import assert_same, connect

SCHEMA = "doc_id long, text string, lang string, w1 string, c int, f int, a int, l int, r int, n int, score int, `a.b` int, _ int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "w", *[1] * 9) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(4)


def plain(rows, least=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            longer = [b for q, b in cand.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            s, k = min((1000000 * a * a // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(n=150, seed=4):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "é", "new", "york", "NEW York city", "in a row", "x", "Été", "don't", "a\tb", "big  data"]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14))) + rng.choice([".", ", ", "\n", ";", "", "!? "])
    out = [("".join(line() for _ in range(rng.randint(0, 12))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]
    return [*out, (None, "en"), ("", "de"), (" \t\n", None), ("a " * 500, "en"), out[0], out[0], (" ".join(rng.choice(vocab) for _ in range(4000)), "fr"), ("x" * 3000, "en")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, small):
    # small: containers burst, subtrees spill, windows cut texts, bitmaps are full
    sizes = phrases.Sizes(bits=8, burst=3, entries=20, window=40) if small else phrases.Sizes()
    rows = texts()
    got = sorted(map(tuple, phrases.collocations(table(spark, rows), sizes=sizes).collect()))
    want = plain(rows)
    assert got == want
    assert len({len(w[2].split()) for w in want}) == 2


def test_ranks_end_at_top(spark):
    rows = texts(80)
    got = sorted(map(tuple, phrases.collocations(table(spark, rows), least=3, top=5).collect()))
    assert got == plain(rows, 3, 5)


def test_empty(spark):
    assert phrases.collocations(table(spark, [])).count() == 0


def test_trie_bursts_and_spills():
    import numpy as np

    rng = random.Random(2)
    trie, want, got = phrases.HatTrie(3, burst=4), collections.Counter(), collections.Counter()
    for _ in range(30):
        keys = np.array([sum(rng.randint(1, 6) << (phrases.ID_BITS * k) for k in range(3)) for _ in range(40)])
        want.update(keys.tolist())
        trie.add(*np.unique(keys, return_counts=True))
        if trie.size > 60:
            k, c = trie.spill(30)
            assert trie.size <= 30
            for key, n in zip(k.tolist(), c.tolist(), strict=True):
                got[key] += n
    k, c = trie.spill()
    for key, n in zip(k.tolist(), c.tolist(), strict=True):
        got[key] += n
    assert got == want and trie.size == 0


def test_trie_takes_few_bytes_an_entry():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    tracemalloc.start()
    try:
        trie = phrases.HatTrie(2, phrases.Sizes().burst)
        for _ in range(4):
            trie.add(*np.unique(rng.zipf(1.3, 50_000) % 30_000 << phrases.ID_BITS | rng.integers(1, 30_000, 50_000), return_counts=True))
        assert tracemalloc.get_traced_memory()[0] < 40 * trie.size
    finally:
        tracemalloc.stop()


def test_runs_are_dealt_before_they_are_summed(spark, monkeypatch, capsys):
    monkeypatch.setattr(phrases, "settle", lambda df: df)
    docs = table(spark, texts(20)).select("lang", phrases.F.col("text").cast("binary").alias("text"))
    phrases.merged(phrases.runs(docs, (1, 2)), 10).explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" not in plan[plan.rindex("Exchange hashpartitioning(width") :] and plan.count("Exchange hashpartitioning(width") == 1


def test_a_task_is_bounded_over_all_its_languages(spark, monkeypatch):
    import weakref

    import pyarrow as pa

    alive, most = weakref.WeakSet(), []

    class Counted(phrases.Words):
        __hash__ = object.__hash__

        def __init__(self, *args):
            super().__init__(*args)
            alive.add(self)

    class Docs:
        def mapInArrow(self, count, schema):
            self.count = count
            return self

    monkeypatch.setattr(phrases, "Words", Counted)
    rng = random.Random(6)
    rows = [(f"l{i % 40}", " ".join(f"w{rng.randint(0, 400)}" for _ in range(30)).encode()) for i in range(2000)]
    batches = [pa.RecordBatch.from_pydict({"lang": [g for g, _ in rows[i : i + 100]], "text": [t for _, t in rows[i : i + 100]]}) for i in range(0, 2000, 100)]
    got, want = collections.Counter(), collections.Counter()
    for batch in phrases.runs(Docs(), (1, 2), sizes=phrases.Sizes(burst=8, entries=500, words=1000)).count(iter(batches)):
        most.append(sum(len(w) for w in alive))
        for width, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            got[width, k] += c
    for lang, text in rows:
        ws = text.decode().split()
        want.update((1, f"{w} {lang}") for w in ws)
        want.update((2, f"{a} {b} {lang}") for a, b in zip(ws, ws[1:]))
    assert got == want
    assert max(most) < 2000


def test_scores_past_64_bits(spark):
    a = 3_000_000_000_000
    row = spark.createDataFrame([(a, a + 7, a + 9)], "a long, l long, r long").select(phrases.score("a", "l", "r").alias("s")).first()
    assert row.s == 1000000 * a * a // ((a + 7) * (a + 9))


def test_query(spark, sf_dir):
    assert_same(queries.QUERIES["op13_phrase_collocations"](spark, sf_dir), connect(sf_dir), queries.ORACLE["op13_phrase_collocations"])
