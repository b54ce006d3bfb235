"""The two quality models against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import quality

from . import fixture

M64, M32 = (1 << 64) - 1, (1 << 32) - 1
BASE = 0x9E3779B97F4A7C15


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_slots(text, bits):
    """The slots of all character and word n-grams of a text, one by one."""
    b, out = (text or "").encode(), []
    for n in (3, 4, 5):
        for i in range(len(b) - n + 1):
            h = 0x811C9DC5 + 97 * n
            for c in b[i : i + n]:
                h = ((h * 0x01000193 & M32) ^ c) * 0x9E3779B1 & M32
            out.append(h >> 32 - bits)
    words = [mix((sum((c + 1) * pow(BASE, k, 1 << 64) for k, c in enumerate(w)) + len(w)) & M64) for w in b.split()]
    for n in (1, 2):
        for i in range(len(words) - n + 1):
            h = 0
            for w in words[i : i + n]:
                h = (h * BASE + w) & M64
            out.append(mix(h) >> 64 - bits)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "green", "walk", "light"], 30))
    bad = lambda: " ".join(rng.choice(["$$$", "click", "win", "free###", "now"], 30))
    texts = [(i, good() if i % 2 else bad()) for i in range(120)]
    texts += [(200, ""), (201, None), (None, bad()), (202, "é river"), (3, texts[3][1]), (5, "aaa the least text"), (203, good() * 40)]
    df, made = fixture.docs(spark, texts=texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 1), (None, 0), (201, None), (777, 1), (200, 0)], "doc_id long, quality int")
    return df, made, labels


def test_sample_is_bounded_and_settled(table):
    df, made, labels = table
    raw, offsets, y, counts = quality.labelled_sample(df, labels, per_class=20, allowed=F.col("doc_id") % 10 != 4)
    assert counts == {0: 41, 1: 51} and np.bincount(y).tolist() == [20, 20] or len(y) <= 40
    whole = quality.labelled_sample(df, labels)
    texts = [whole[0].tobytes()[a:b].decode() for a, b in zip(whole[1][:-1], whole[1][1:])]
    assert "aaa the least text" in texts and len(texts) == 101  # of the two texts of id 5 the least; id 777 has none
    again = quality.labelled_sample(df.repartition(7), labels)
    assert (again[0] == whole[0]).all() and (again[2] == whole[2]).all()


@pytest.mark.parametrize("fit", [quality.fit_logistic, quality.fit_embeddings])
def test_scores_of_two_classes(table, fit):
    df, made, labels = table
    model = fit(*quality.labelled_sample(df, labels))
    got = quality.score_quality(df, model).collect()
    want = []
    for i, t in made:
        slots = plain_slots(t, model["bits"])
        z = model["slope"] * (np.mean(model["weights"][slots].astype(float)) if slots else 0.0) + model["shift"]
        want.append((str(i), round(1 / (1 + math.exp(-min(40, max(-40, z)))), 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted(want)
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] >= 0.5) == (i % 2 == 1) for i in range(100, 120)) and 0 <= score[200] == score[201] <= 1
    rules = {r.doc_id: r for r in quality.quality_rules(df, model).collect() if r.doc_id not in (3, 5)}
    assert all(r.kept == (not r.base_failed and score[i] >= 0.5) and r.score == score[i] for i, r in rules.items())
    assert any(r.kept for r in rules.values()) and not all(r.kept or r.base_failed for r in rules.values())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, r in rules.items() if r.kept}


def test_folded_weights_are_the_mean_vectors_softmax(table):
    df, made, labels = table
    sample = quality.labelled_sample(df, labels)
    model = quality.fit_embeddings(*sample, bits=12)
    vectors, head, bias, scale = quality.learn_embeddings(*sample[:3], bits=12)
    y, counts = sample[2:]
    prior = math.log(counts[1] / counts[0]) - math.log((y == 1).sum() / (y == 0).sum())
    for _, t in made[:10]:
        logits = head @ (scale * vectors[plain_slots(t, 12)].mean(axis=0)) + bias
        raw = np.frombuffer(t.encode(), np.uint8)
        p = quality.probability(raw, np.array([0, len(raw)]), model)[0]
        assert p == pytest.approx(1 / (1 + math.exp(logits[0] - logits[1] - prior)), abs=1e-3)


def test_calibration():
    """Margins whose odds are known come back as probabilities; weights stand for repeated rows."""
    rng = np.random.default_rng(2)
    margin = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-(1.5 * margin - 0.7)))).astype(int)
    slope, shift = quality._platt(margin, y, np.ones(20000))
    assert slope == pytest.approx(1.5, abs=0.1) and shift == pytest.approx(-0.7, abs=0.1)
    part = np.where(y == 1, 2.0, 1.0)
    assert quality._platt(margin, y, part) == pytest.approx(quality._platt(np.concatenate([margin, margin[y == 1]]), np.concatenate([y, y[y == 1]]), np.ones(20000 + int(y.sum()))), abs=1e-5)
    apart = quality._platt(np.array([-1.0, -2.0, 1.0, 2.0]), np.array([0, 0, 1, 1]), np.ones(4))
    assert np.isfinite(apart).all() and apart[0] > 0  # classes without overlap, and ties, do not run away
    assert np.isfinite(quality._platt(np.zeros(4), np.array([0, 1, 0, 1]), np.ones(4))).all()
