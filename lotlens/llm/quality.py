"""Quality rules and quality classifier: two models over hashed n-grams.

``labelled_sample`` gathers a bounded training sample; ``fit_logistic`` trains a calibrated logistic
regression; ``fit_embeddings`` trains averaged n-gram vectors with a softmax; ``score_quality`` and
``quality_rules`` score every whole text in Arrow batches.

Defined cases: a null text is an empty text; of rows that repeat a labelled id the least text is learnt from; an empty text has the score of the bias alone; repeated rows are
scored alike; an empty table gives an empty result; a null doc_id stays and is never a training row; columns other
than those named are neither read nor returned.  If the labels hold one class or none, the score is the share of label 1
(0.5 without labels) for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import ngrams
from .common import pieces, utf8

BITS = 18


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 600, allowed: Column | None = None, label: str = "quality"):
    """At most ``per_class`` rows of each label, the first by a hash of the id; -> texts, labels, counts of all labels.

    The counts cover every allowed label; only the texts are bounded.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().toLocalIterator()}
    picked = None
    for k in (0, 1):
        part = rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of two numbers: small enough to send whatever the size of the tables
    # of rows that repeat an id the least text, so that the model does not depend on the order of tasks
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    table = texts.select("doc_id", "text", "label").toArrow().sort_by("doc_id").combine_chunks()
    raw, offsets = utf8(table.column("text").combine_chunks() if len(table) else pa.array([], pa.string()))
    return raw, offsets, np.asarray(table.column("label"), np.int64), counts


def _steady(y: np.ndarray, counts: dict[int, int]) -> float | None:
    """The score for all where there is nothing to learn from."""
    if len(np.unique(y)) == 2:
        return None
    total = sum(counts.values())
    return counts.get(1, 0) / total if total else 0.5


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, y): Newton steps, halved until the loss falls, smoothed targets."""
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(at):
        z = at[0] * margin + at[1]
        return (weight * (np.logaddexp(0, z) - target * z)).sum()

    at = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))
        g, s = weight * (p - target), weight * p * (1 - p)
        hess = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * margin).sum(), g.sum()]))
        scale = 1.0
        while scale > 1e-6 and loss(at - scale * step) > loss(at):
            scale /= 2
        at = at - scale * step
        if abs(scale * step).max() < 1e-7:
            break
    return float(at[0]), float(at[1])


def fit_logistic(raw, offsets, y, counts, epochs: int = 12, rate: float = 0.5, bits: int = BITS) -> dict:
    """Logistic regression by adaptive gradient steps on four fifths, its margins calibrated on the last fifth.

    Calibration weighs each class by its share among all labels, so that the balanced sample gives true odds.
    """
    if (steady := _steady(y, counts)) is not None:
        return {"weights": np.zeros(1 << bits, np.float32), "slope": 0.0, "shift": float(np.log((steady + 1e-6) / (1 - steady + 1e-6))), "bits": bits}
    rows = ngrams.bags(raw, offsets, bits)
    held = np.arange(len(y)) % 5 == 4
    w, seen, bias, bias_seen = np.zeros(1 << bits), np.full(1 << bits, 1e-8), 0.0, 1e-8
    order = np.flatnonzero(~held)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(order):
            slots, shares = rows[i]
            x = shares * 50.0
            g = 1 / (1 + np.exp(-np.clip(w[slots] @ x + bias, -30, 30))) - y[i]
            step = g * x + 1e-6 * w[slots]
            seen[slots] += step * step
            w[slots] -= rate * step / np.sqrt(seen[slots])
            bias_seen += g * g
            bias -= rate * 0.1 * g / np.sqrt(bias_seen)
    margin = np.array([w[s] @ (x * 50.0) + bias for s, x in rows])
    part = {k: max(1, int(((y == k) & held).sum())) for k in (0, 1)}
    total = sum(counts.values())
    weight = np.where(y == 1, counts.get(1, 0) / part[1], counts.get(0, 0) / part[0]) / total * held.sum()
    a, b = _platt(margin[held], y[held], weight[held])
    return {"weights": (w * 50.0).astype(np.float32), "slope": a, "shift": a * bias + b, "bits": bits}


def learn_embeddings(raw, offsets, y, dim: int = 16, epochs: int = 6, rate: float = 0.5, bits: int = BITS):
    """Vectors of hashed word and character n-grams, averaged per document, softmax on top; plain stochastic gradient steps.

    -> vectors, head, bias, scale: the logits of a document are head @ (scale * its mean vector) + bias.
    """
    rows = ngrams.bags(raw, offsets, bits)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    head, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    scale = np.float32(20.0)
    steps = epochs * len(y)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            now = rate * (1 - done / steps)
            done += 1
            slots, shares = rows[i]
            hidden = scale * (shares @ vectors[slots])
            z = head @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = head.T @ p
            head -= np.float32(now * 0.2) * np.outer(p, hidden)
            bias -= np.float32(now * 0.2) * p
            vectors[slots] -= np.float32(now) * scale * shares[:, None] * back
    return vectors, head, bias, scale


def fit_embeddings(raw, offsets, y, counts, bits: int = BITS, **how) -> dict:
    """``learn_embeddings``, with the classes' shares among all labels put right.

    Returned folded: a document's logit is linear in the mean vector, so each slot needs one number when scoring.
    """
    if (steady := _steady(y, counts)) is not None:
        return {"weights": np.zeros(1 << bits, np.float32), "slope": 0.0, "shift": float(np.log((steady + 1e-6) / (1 - steady + 1e-6))), "bits": bits}
    vectors, head, bias, scale = learn_embeddings(raw, offsets, y, bits=bits, **how)
    prior = np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1)) - np.log(max((y == 1).sum(), 1) / max((y == 0).sum(), 1))
    return {"weights": scale * (vectors @ (head[1] - head[0])), "slope": 1.0, "shift": float(bias[1] - bias[0] + prior), "bits": bits}


def probability(raw: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    margin = ngrams.mean_weights(raw, offsets, model["weights"], model["bits"])
    return 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -40, 40)))


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (probability of label 1) of every row.  The model is a closure of 2**bits floats: 1 MB."""

    def score(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = utf8(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probability(raw, offsets, model))], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(score, "doc_id long, score double")


SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
GRAM = 8


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n, lo, hi = len(offsets) - 1, offsets[:-1], offsets[1:]
    inside = ~H.SPACE[raw]
    starts, ends = H.runs(inside, offsets)
    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    out = {"n_words": last - first}
    out["word_chars"] = H.segment_sums((inside & ((raw & 0xC0) != 0x80)).astype(np.int64), lo, hi)
    out["n_symbols"] = H.segment_sums(SYMBOLS[raw].astype(np.int64), lo, hi)
    tag = H.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))

    breaks = raw == 0x0A
    line_starts = np.unique(np.concatenate([lo, np.flatnonzero(breaks) + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.concatenate([line_starts[1:], [len(raw)]])[: len(line_starts)]
    line_ends = line_ends - (breaks[np.maximum(line_ends - 1, 0)] & (line_ends > line_starts))
    worded = H.segment_sums(inside.astype(np.int64), line_starts, line_ends) > 0
    line_starts, line_ends, line_doc = line_starts[worded], line_ends[worded], line_doc[worded]
    keys = H.slice_hashes(raw, line_starts, line_ends) ^ tag[line_doc]
    _, at = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[at], minlength=n)

    words = H.slice_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(n), last - first)
    grams = H.window_hashes(words, GRAM)
    whole = doc[: len(grams)] == doc[GRAM - 1 : GRAM - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
    where = np.flatnonzero(whole)
    where = where[H.repeated(grams[where] ^ tag[doc[where]])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + GRAM, -1)
    covered = (np.cumsum(cover)[: len(words)] > 0).astype(np.int64)
    out["n_repeat_words"] = H.segment_sums(covered, first, last)
    return out


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(raw: np.ndarray, offsets: np.ndarray, model: dict, threshold: float, min_words: int, max_repeat_percent: int):
    """Counts, base_failed, probability and verdict of each text."""
    c = text_counts(raw, offsets)
    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
    p = probability(raw, offsets, model)
    return c, failed, p, ~failed & (p >= threshold)


def quality_rules(docs: DataFrame, model: dict, threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Counts, base_failed, score and kept of every row: kept needs both the base rules and score >= threshold."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                c, failed, p, kept = judge(*utf8(part.column(1)), model, threshold, min_words, max_repeat_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c[k], pa.int64()) for k in NAMES), pa.array(failed), pa.array(p), pa.array(kept)], ["doc_id", *NAMES, "base_failed", "score", "kept"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, f"doc_id long, {', '.join(k + ' long' for k in NAMES)}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(judge(*utf8(part.column(at)), model, threshold, min_words, max_repeat_percent)[3]))

    return docs.mapInArrow(run, docs.schema)
