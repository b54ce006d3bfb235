"""Toxicity: restored words, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from lotlens.llm import queries, toxicity

SCHEMA = "doc_id long, text string, label int, score int, held int, key long, `a.b` int, _ int"
BAD = ["grumblefool", "snotwit", "dreckhead", "vileworm"]
HIDDEN = ["snotw1t", "d r e c k h e a d", "v.i.l.e.w.o.r.m", "snooootwit", "dr3ckh3@d", "v1lew0rm", "5notwit", "VILEWORM", "s-n-o-t-w-i-t"]


def corpus(spark, n=400, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "é", "in", "st", "well-"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(rng.choice([5, 40, 300]))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            ws.insert(rng.randint(0, len(ws)), rng.choice(BAD))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    for k, hidden in enumerate(HIDDEN):
        rows.append((1000 + k, f"on an {hidden} re thst"))
    rows += [(2000, None), (2001, ""), (2002, "a b c d 1 2 3"), (2003, "1234 $$$ ... !!!"), (None, "snotwit on"), (2004, "th" * 30000 + " snotwit"), (3, rows[3][1]), (3, "zz")]
    docs = spark.createDataFrame([(i, t, *[1] * 6) for i, t in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"), dict(labels)


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels, truth = corpus(spark)
    from pyspark.sql import functions as F

    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = toxicity.fit(docs, labels, allowed)
    return docs, truth, model


def test_hidden_words_are_found_and_clean_texts_left(learnt):
    docs, truth, model = learnt
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([(r.score >= 0.3) == (truth[r.doc_id] == 1) for r in held]) > 0.97
    hidden = [r.score for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000]
    assert sum(s >= 0.3 for s in hidden) >= len(HIDDEN) - 1
    by = {r.doc_id: r.score for r in got}
    assert by[2000] == by[2001] and max(by[i] for i in (2000, 2002, 2003)) < 0.3
    assert by[None] >= 0.3 and by[2004] >= 0.3
    assert all(0 <= r.score <= 1 for r in got)


def test_restored_texts(learnt):
    docs, _, model = learnt
    got = {r.doc_id: r.text for r in toxicity.restored_texts(docs, model).collect()}
    assert got[1000] == "on an snotwit re thst" and got[1001] == "on an dreckhead re thst" and got[1002] == "on an vileworm re thst"
    assert got[2000] == "" and got[2004].endswith(" snotwit")


def test_viterbi_finds_the_cheapest_reading(learnt):
    """Against all readings of short stretches."""
    import itertools

    costs = learnt[2]["costs"].tolist()

    def price(text):
        total, at = 0.0, 0
        for c in [*text, " "]:
            code = int(toxicity.CODE[ord(c)])
            if code:
                total, at = total + costs[at * 28 + code], (at * 28 + code) % 28**3
            else:
                total, at = total + (costs[at * 28] if at % 28 else 0.0), 0
        return total

    for token in (b"sn0tw1t", b"v i l e", b"o11n", b"d-r-3-c-k", b"aaa5", b"th$$e"):
        ways = toxicity.columns_of(token)
        best = min(price("".join(t for t, _ in way)) + sum(c for _, c in way) for way in itertools.product(*ways))
        got = toxicity.restore(token, costs).decode()
        found = min(sum(c for _, c in way) for way in itertools.product(*ways) if "".join(t for t, _ in way) == got)
        assert abs(price(got) + found - best) < 1e-6


def test_rows_do_not_depend_on_batches():
    texts = ["sn0t on", "", "a b c", "x" * 50, "w1t " * 9, "plain words"]
    costs = toxicity.char_costs(np.zeros(28**4), {})
    again = toxicity.Restorer(costs)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, at = again(raw, offsets)
    for i, t in enumerate(texts):
        one, _ = again(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert data[at[i] : at[i + 1]].tobytes() == one.tobytes()
        docs, keys = toxicity.features(data, at)
        assert sorted(keys[docs == i]) == sorted(toxicity.features(one, np.array([0, len(one)]))[1])


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)]])
def test_nothing_to_learn(spark, labels):
    docs, _, _ = corpus(spark, 12)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {round(r.score, 3) for r in toxicity.score_toxicity(docs, model).collect()}
    assert scores == {0.5 if not labels else 1.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_query(spark, sf_dir):
    df = queries.QUERIES["op11_toxicity"](spark, sf_dir)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert not any(r.predicted and not labels[r.doc_id] for r in held)
