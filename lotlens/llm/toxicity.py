"""Toxicity of whole texts: obfuscated words are restored by a noisy channel, and the restored text is scored.

Suspicious stretches (letters written as digits or signs, words spelt out with blanks or signs between the letters, letters repeated three times
or more) become lattices: each character offers the letters that it may stand for, at a cost; Viterbi's algorithm finds the cheapest
reading under a character model of order four.  The model counts the characters of all documents; the words that mark toxic texts in the
labelled sample get some weight in it too, so that a rare word can win against its misreadings.  What is plain is left as it is.

A text's features are the word-bounded strings of four and five bytes and the words that it holds.  Those that are significantly more
frequent in toxic documents of the sample are candidates (``MOST`` at most), and rules are taken from them one after the other, each weighed on what no
earlier rule holds for.  A text is as toxic as its heaviest rule, by a logistic curve that is fitted on a part of the sample that was not learnt from, to
the shares of all labels.

Defined cases: a null text is an empty text, which has no feature; texts of any length are scored whole; of rows that repeat a labelled id
the least text is learnt from, and label 1 if labels disagree; repeated rows are scored alike; an empty table gives an empty one; a row with a null doc_id
is scored and never learnt from; without labels, or with one class only, all scores are the share of label 1 (0.5 without labels); columns other than those named are
neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import pieces, settle, utf8
from .quality import _platt as platt

# The letters that a digit or sign stands for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Signs that may stand between the letters of a word spelt out.
BETWEEN = "._-*~ \t"

#: Costs of the channel, in nats: a sign for a letter, a sign for itself, three or more of a letter for one or two, two for one, a sign between letters, a break at it.
SWAP, ITSELF, REPEAT, DOUBLE, JOIN, BREAK = 1.0, 4.0, 0.7, 3.0, 0.3, 1.0

#: Symbols: 0 what is no letter, 1 to 26 letters, 27 a byte beyond ASCII.
KINDS, ORDER = 28, 4
CODE = np.zeros(256, np.uint8)
CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
CODE[ord("A") : ord("Z") + 1] = np.arange(1, 27)
CODE[128:] = 27
LOW = np.arange(256, dtype=np.uint8)
LOW[ord("A") : ord("Z") + 1] += 32
LETTER = CODE > 0
IS_LEET = np.zeros(256, bool)
IS_LEET[[ord(c) for c in LEET]] = True
AT_END = np.zeros(256, bool)
AT_END[[ord(c) for c in "0123456789@$"]] = True
IS_BETWEEN = np.zeros(256, bool)
IS_BETWEEN[[ord(c) for c in BETWEEN]] = True
#: Bytes that parts of words consist of when features are read.
PART = LETTER.copy()
PART[ord("0") : ord("9") + 1] = True

#: Features that are kept, the least documents and the least significance that they need.
MOST, LEAST_DOCS, LEAST_Z = 4096, 3, 4.0


# --- the character model ------------------------------------------------------------------------------------------------


def char_keys(codes: np.ndarray) -> np.ndarray:
    """Of each symbol but the breaks after breaks: the three before it in its word, and itself, as one number."""
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])] if len(codes) else codes
    if len(codes) < ORDER:
        codes = np.concatenate([np.zeros(ORDER - len(codes), np.uint8), codes])
    a, b, c, d = (codes[k : len(codes) - ORDER + 1 + k].astype(np.int64) for k in range(ORDER))
    b = np.where(c == 0, 0, b)
    a = np.where(b == 0, 0, a)
    return ((a * KINDS + b) * KINDS + c) * KINDS + d


def char_counts(docs: DataFrame) -> np.ndarray:
    """How often each string of four symbols occurs in all texts; a task gives each string once, so 28**4 rows at most are sent."""

    def count(batches):
        total = np.zeros(KINDS**ORDER, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = utf8(part.column(0))
                # a break before every text
                codes = np.insert(CODE[raw], offsets[:-1], 0)
                total += np.bincount(char_keys(np.concatenate([[0, 0, 0], codes, [0]]).astype(np.uint8)), minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(KINDS**ORDER)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out


def char_costs(counts: np.ndarray, words: dict[str, float], share: float = 0.002, trust: float = 5.0) -> np.ndarray:
    """-log of the chance of a symbol after three, smoothed by shorter contexts; ``words`` (word: weight) get ``share`` of all counts."""
    counts = counts.copy()
    whole = sum(words.values())
    for word, weight in words.items():
        keys = char_keys(np.concatenate([[0, 0, 0], CODE[np.frombuffer(word.encode(), np.uint8)], [0]]).astype(np.uint8))
        np.add.at(counts, keys, (share * counts.sum() + 100) * weight / whole / len(keys))
    now = np.full(KINDS, 1 / KINDS)
    for n in range(1, ORDER + 1):
        c = counts.reshape(-1, KINDS**n).sum(0).reshape(-1, KINDS)
        # the chance after a shorter context, for each way to lengthen it
        lower = np.tile(now.reshape(-1, KINDS), (len(c) // max(1, len(now.reshape(-1, KINDS))), 1))
        now = (c + trust * lower) / (c.sum(1, keepdims=True) + trust)
    return -np.log(now.ravel()).astype(np.float32)


def columns_of(token: bytes) -> list[list[tuple[str, float]]]:
    """The lattice of a stretch: for each run of one byte its readings and their costs."""
    out, at = [], 0
    while at < len(token):
        end = at + 1
        while end < len(token) and token[end] == token[at]:
            end += 1
        n, c = end - at, chr(token[at])
        if c in LEET:
            ways = [(x * k, SWAP + (0 if n == k else DOUBLE if n == 2 else REPEAT)) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
            ways.append((" ", ITSELF))
        elif token[at] >= 128:
            ways = [(c * n, 0.0)]
        elif CODE[token[at]]:
            ways = [(c, 0.0)] if n == 1 else [(c * n, 0.0), (c, DOUBLE)] if n == 2 else [(c, REPEAT), (c * 2, REPEAT)]
        elif c in BETWEEN:
            ways = [("", JOIN), (" ", BREAK)]
        else:
            ways = [(" ", 0.0)]
        out.append(ways)
        at = end
    return out


def restore(token: bytes, costs: list[float]) -> bytes:
    """The cheapest reading of a lower-case stretch."""
    states = {0: (0.0, None)}
    for ways in columns_of(token):
        new: dict[int, tuple] = {}
        for context, (cost, path) in states.items():
            for text, more in ways:
                now, at = cost + more, context
                for c in text:
                    code = int(CODE[ord(c)])
                    if code == 0:
                        now, at = now + (costs[at * KINDS] if at % KINDS else 0.0), 0
                    else:
                        now, at = now + costs[at * KINDS + code], (at * KINDS + code) % KINDS**3
                if at not in new or now < new[at][0]:
                    new[at] = (now, (path, text))
        states = new
    _, path = min(((cost + (costs[at * KINDS] if at % KINDS else 0.0), at, path) for at, (cost, path) in states.items()), key=lambda x: x[:2])[0::2]
    parts = []
    while path is not None:
        parts.append(path[1])
        path = path[0]
    return "".join(reversed(parts)).encode("latin-1")


def suspicious(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the stretches that may be obfuscated, in order, of lower-case bytes."""
    inside = ~H.SPACE[raw]
    starts, ends = H.runs(inside, offsets)
    if not len(starts):
        return []
    n = len(raw)
    near = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, n), bool)]) if k >= 0 else np.concatenate([np.zeros(min(-k, n), bool), a[: n + k]])
    letter, leet, between = LETTER[raw], IS_LEET[raw], IS_BETWEEN[raw] & inside
    inner = leet & near(letter, -1) & (near(letter, 1) | near(leet, 1))
    spelt = between & near(letter | leet, 1) & near(between, 2) & near(letter | leet, 3) & near(letter | leet, -1)
    same = np.zeros(n, bool)
    same[: max(0, n - 2)] = (raw[: n - 2] == raw[1 : n - 1]) & (raw[1 : n - 1] == raw[2:]) if n > 2 else False
    marks = H.segment_sums((inner | spelt | (same & letter & (raw < 128))).astype(np.int64), starts, ends) > 0
    size = ends - starts
    last, before, third = raw[ends - 1], raw[np.maximum(ends - 2, 0)], raw[np.maximum(ends - 3, 0)]
    marks |= (size > 2) & leet[starts] & letter[np.minimum(starts + 1, n - 1)]
    marks |= (size > 2) & AT_END[last] & (LETTER[before] | ((before == last) & LETTER[third] & (size > 3)))
    # words of one letter or sign: three or more in a row
    single = (size == 1) & ((letter[starts] & (raw[starts] < 128)) | leet[starts])
    first = np.searchsorted(starts, offsets[:-1])
    far = np.flatnonzero(np.concatenate([[False], starts[1:] - ends[:-1] > 2]))
    a, b = H.runs(single, np.unique(np.concatenate([first, far])))
    spaced = (b - a >= 3) & np.array([letter[starts[i:j]].any() for i, j in zip(a, b, strict=True)], bool)
    out = [(int(starts[i]), int(ends[j - 1])) for i, j in zip(a[spaced], b[spaced], strict=True)]
    out += [(int(starts[i]), int(ends[i])) for i in np.flatnonzero(marks)]
    return sorted(out)


class Restorer:
    """Restores the texts of a task; readings of stretches that come again are kept, up to ``keep`` of them."""

    def __init__(self, costs: np.ndarray, keep: int = 100_000):
        self.costs, self.keep, self.known = costs.tolist(), keep, {}

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case texts with suspicious stretches restored, and their offsets."""
        raw = LOW[raw]
        spans = suspicious(raw, offsets)
        if not spans:
            return raw, offsets
        data, parts, at, grown = raw.tobytes(), [], 0, np.zeros(len(spans) + 1, np.int64)
        for k, (start, end) in enumerate(spans):
            token = data[start:end]
            got = self.known.get(token)
            if got is None:
                if len(self.known) >= self.keep:
                    self.known.clear()
                got = self.known[token] = restore(token, self.costs)
            parts += [data[at:start], got]
            grown[k + 1] = grown[k] + len(got) - (end - start)
            at = end
        parts.append(data[at:])
        ends = np.array([e for _, e in spans], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), offsets + grown[np.searchsorted(ends, offsets, "right")]


# --- features -----------------------------------------------------------------------------------------------------------


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the features at each place.  A string of up to five bytes is its own key, with its length; a word is a 63-bit hash."""
    n = len(offsets) - 1
    part = PART[raw]
    starts, ends = H.runs(part, offsets)
    # words with one blank around each: byte i of word w is at ends of the words before + w blanks
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)]) + 1
    text = np.full(int(at[-1]) if len(size) else 0, 0x20, np.uint64)
    inside = np.flatnonzero(part)
    text[np.arange(len(inside)) + np.repeat(np.arange(len(size)) + 1, size)] = raw[inside]
    doc = np.searchsorted(offsets, starts, "right") - 1
    owner = np.repeat(np.append(doc, n), np.append(size + 1, 1))[: len(text)] if len(size) else np.zeros(0, np.int64)
    blank = np.concatenate([[0], np.cumsum(text == 0x20)])
    docs, keys = [], []
    for k in (4, 5):
        m = len(text) - k + 1
        if m <= 0:
            continue
        key = np.full(m, k, np.uint64)
        for j in range(k):
            key = key << np.uint64(8) | text[j : j + m]
        whole = np.flatnonzero(blank[k - 1 : k - 1 + m] - blank[1 : 1 + m] == 0)  # no blank but at the ends
        docs.append(owner[np.minimum(whole + 1, len(owner) - 1)])
        keys.append(key[whole])
    docs.append(doc)
    keys.append(H.slice_hashes(raw, starts, ends) | np.uint64(1 << 63))
    return np.concatenate(docs).astype(np.int64), np.concatenate(keys)


def chosen_at(docs: np.ndarray, keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place in the sorted ``chosen``) of the features that were chosen."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 16, bool)
    slot = lambda k: (H.mix(k) >> np.uint64(48)).astype(np.int64)
    table[slot(chosen)] = True
    may = np.flatnonzero(table[slot(keys)])
    at = np.minimum(np.searchsorted(chosen, keys[may]), len(chosen) - 1)
    hit = chosen[at] == keys[may]
    pairs = np.unique(docs[may][hit] * len(chosen) + at[hit])
    return pairs // len(chosen), pairs % len(chosen)


# --- learning ---------------------------------------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, per_class: int, allowed: Column | None, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, held, text) of at most ``per_class`` rows of each label, the first by a hash of the id, settled; and counts of all labels.

    ``held`` marks a fifth that is calibrated on and not learnt from.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = (rows if allowed is None else rows.where(allowed)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    first = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class rows of two numbers
    picked = F.broadcast(first[0].unionByName(first[1]))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return settle(texts.select("doc_id", "label", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).alias("held"), "text").repartition(16)), counts


def significance(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """How many standard deviations the share among label 1 lies above that among label 0."""
    share = (n1 + n0) / float(all1 + all0)
    return (n1 / float(all1) - n0 / float(all0)) / F.sqrt(share * (1 - share) * (1 / all1 + 1 / all0) + 1e-12)


def marks(rows: DataFrame, by: str, n: dict[int, int], most: int) -> DataFrame:
    """The ``most`` most significant values of ``by`` among rows (by, one, zero): documents of label 1 and 0 that have it."""
    sums = rows.groupBy(by).agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).where(F.col("one") >= LEAST_DOCS)
    return sums.withColumn("z", significance(F.col("one"), F.col("zero"), n[1], n[0])).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), by).limit(most)


def lexicon(rows: DataFrame, n: dict[int, int], most: int = 1000) -> dict[str, float]:
    """Words of letters that mark label 1 in the plain texts of the sample, with the number of documents that have them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\S)(\p{L}{3,40})(?![^\s.,;:!?])"), 1))
    rows = rows.select(F.explode(words).alias("word"), F.col("label").alias("one"), (1 - F.col("label")).alias("zero"))
    return {r["word"]: float(r["one"]) for r in marks(rows, "word", n, most).collect()}


def feature_counts(rows: DataFrame, costs: np.ndarray) -> DataFrame:
    """key, one, zero: documents of each label that have a feature, summed within tasks."""

    def count(batches):
        again = Restorer(costs)
        for batch in batches:
            for part in pieces(batch, "text"):
                docs, keys = features(*again(*utf8(part.column(1))))
                label = np.asarray(part.column(0), np.int64)
                order = np.lexsort([docs, keys])
                docs, keys = docs[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
                docs, keys = docs[new], keys[new]
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                one = np.add.reduceat(label[docs], at) if len(at) else at
                size = np.diff(np.append(at, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(one), pa.array(size - one)], ["key", "one", "zero"])

    return rows.select("label", "text").mapInArrow(count, "key long, one long, zero long")


def bags(rows: DataFrame, costs: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the sample's documents and which of the chosen features each has: at most len(chosen) numbers for each."""

    def gather(batches):
        again = Restorer(costs)
        for batch in batches:
            for part in pieces(batch, "text"):
                docs, at = chosen_at(*features(*again(*utf8(part.column(2)))), chosen)
                offsets = np.searchsorted(docs, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))], ["doc_id", "label", "at"])

    table = rows.select("doc_id", "label", "text").mapInArrow(gather, "doc_id long, label int, at array<int>").toArrow().sort_by("doc_id")
    has = np.zeros((len(table), len(chosen)), bool)
    for i, at in enumerate(table.column("at").to_pylist()):
        has[i, at] = True
    return np.asarray(table.column("label"), np.int64), has


def rule_weights(y: np.ndarray, has: np.ndarray, words: np.ndarray, doubt: float = 1.0, word_doubt: float = 2.0) -> np.ndarray:
    """A weight for each feature, most of them 0: the list of rules that are taken one after the other.

    A rule weighs by how much likelier it is under label 1 (its logarithm, less ``doubt`` standard errors) among the documents that no earlier rule
    holds for, and the heaviest is taken next, a whole word before its parts.  Parts that only accompany a heavier rule get no weight of their own,
    since one of very many is found in any long text.  A whole word is also a rule by itself, with more doubt, whatever stands beside it.
    """
    n1, n0 = (y == 1).sum() + 1, (y == 0).sum() + 1
    one, zero = has[y == 1].sum(0), has[y == 0].sum(0)
    alone = np.log((one + 0.5) / n1) - np.log((zero + 0.5) / n0) - word_doubt * np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))
    out, open_, last = np.where(words > 0, np.maximum(alone, 0), 0.0), np.ones(len(y), bool), np.inf
    while has.shape[1]:
        one, zero = has[open_ & (y == 1)].sum(0), has[open_ & (y == 0)].sum(0)
        w = np.log((one + 0.5) / n1) - np.log((zero + 0.5) / n0) - doubt * np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))
        w[one < LEAST_DOCS] = -np.inf
        k = np.lexsort([words, w])[-1]
        if not w[k] > 0:
            break
        last = min(last, w[k])
        out[k] = max(out[k], last)
        open_ &= ~has[:, k]
    return out


def margins(raw: np.ndarray, offsets: np.ndarray, model: dict, again: Restorer) -> np.ndarray:
    """The weight of each text's strongest feature, 0 where it has none: one word suffices, and a long text has no more of it."""
    docs, at = chosen_at(*features(*again(raw, offsets)), model["chosen"])
    out = np.zeros(len(offsets) - 1)
    np.maximum.at(out, docs, model["weights"][at])
    return out


def calibrate(rows: DataFrame, model: dict, counts: dict[int, int]) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins of ``rows``, each class weighing as it does among all labels."""

    def run(batches):
        again = Restorer(model["costs"])
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(margins(*utf8(part.column(2)), model, again))], ["doc_id", "label", "margin"])

    table = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, margin double").toArrow().sort_by("doc_id")
    y, margin = np.asarray(table.column("label"), np.int64), np.asarray(table.column("margin"), np.float64)
    part, total = {k: max(1, int((y == k).sum())) for k in (0, 1)}, sum(counts.values())
    slope, shift = platt(margin, y, np.where(y == 1, counts[1] / part[1], counts[0] / part[0]) / total * len(y))
    return max(slope, 0.0), shift


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", per_class: int = 1000) -> dict:
    """The character model, the chosen features and their weights.  ``per_class`` bounds the labelled documents of each class that are learnt from."""
    rows, counts = sample(docs, labels, per_class, allowed, label)
    learnt = rows.where(~F.col("held"))
    n = {k: 0 for k in (0, 1)} | {int(r["label"]): r["count"] for r in learnt.groupBy("label").count().collect()}
    if not (n[0] and n[1]):
        total = sum(counts.values())
        steady = counts.get(1, 0) / total if total else 0.5
        return {"costs": char_costs(char_counts(docs), {}), "chosen": np.zeros(0, np.uint64), "weights": np.zeros(0), "slope": 0.0, "shift": float(np.log((steady + 1e-6) / (1 - steady + 1e-6)))}
    costs = char_costs(char_counts(docs), lexicon(learnt, n))
    found = marks(feature_counts(learnt, costs), "key", n, MOST).collect()
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    keys.sort()
    weights = rule_weights(*bags(learnt, costs, keys), keys >> np.uint64(63))
    model = {"costs": costs, "chosen": keys[weights > 0], "weights": weights[weights > 0]}
    held = rows.where("held")
    slope, shift = calibrate(held if held.select("label").distinct().count() == 2 else rows, model, counts)
    return model | {"slope": slope, "shift": shift}


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (probability of label 1) of every row.  The model in the tasks' closure is 2.5 MB."""

    def score(batches):
        again = Restorer(model["costs"])
        for batch in batches:
            for part in pieces(batch, "text"):
                z = model["slope"] * margins(*utf8(part.column(1)), model, again) + model["shift"]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def restored_texts(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text: lower-case texts as they are scored."""

    def read(batches):
        again = Restorer(model["costs"])
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = again(*utf8(part.column(1)))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), texts.cast(pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, text string")
