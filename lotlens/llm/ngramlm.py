"""Language-model scores from a bigram model in Elias-Fano tries.

Counts come from every learnt text: chunks ask shards for the counts of their distinct words, then of their distinct word pairs (see
``chunks``); nothing but two totals and one number per power of two of a context's count is gathered at the driver.  A chunk then builds
the slice of the trie that its documents need: level 1 the words, level 2 the successors of each context, as one monotone Elias-Fano
sequence (each context's successors are raised by the last value of the context before) with a monotone pointer sequence, and smoothed
probabilities quantised to 16 bits.  Levels are written to a file and memory-mapped; a pair is looked up by successor search relative to its
context.

p(w | v) = (1 - a) c(v, w) / c(v) + a p(w), p(w) = (c(w) + 1) / (N + V + 1), where a is the share of pairs seen once among pairs of contexts
as frequent as v (by powers of two, between 0.05 and 0.8), and 1 for an unseen context.  The first word's context is the start of a text.

Defined cases: a null or empty text is its end token alone; repeated rows count as often as they occur and score alike; an empty table
gives an empty result; a null doc_id is learnt from and not held out; with nothing to learn from every token is unseen; other columns are
not read.
"""

from __future__ import annotations

import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from . import hashing as H
from .common import settle

END = np.uint64(0x5DEECE66D1234567)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CLASSES = 48
STEP = 20 / 65535  # log10 probabilities from -20 to 0 in 16 bits


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 / STEP), 0, 65535).astype(np.uint16)


class EliasFano:
    """A monotone sequence: the low bits of each value packed, the high bits in unary."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low = max(0, (top // max(1, self.n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        self.tops = int(high[-1]) + 1 if self.n else 1
        upper = np.zeros((self.tops + self.n >> 6) + 1, np.uint64)
        at = high + np.arange(self.n)
        np.bitwise_or.at(upper, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.upper = upper
        words = np.zeros((self.n * self.low >> 6) + 2, np.uint64)
        if self.low:
            at = np.arange(self.n, dtype=np.uint64) * np.uint64(self.low)
            rest = values & np.uint64((1 << self.low) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, rest << shift)
            over = shift + np.uint64(self.low) > 64
            np.bitwise_or.at(words, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        self.lows = words

    def arrays(self) -> list[np.ndarray]:
        return [self.upper, self.lows]

    def open(self, upper: np.ndarray, lows: np.ndarray) -> EliasFano:
        """Use mapped arrays; all that is made here is the number of ones before each word of 64 bits."""
        self.upper, self.lows = upper, lows
        self.before = np.cumsum(np.bitwise_count(upper), dtype=np.int64) - np.bitwise_count(upper)
        return self

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the i-th one (or zero) of the unary part."""
        before = self.before if ones else np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.searchsorted(before, i, "right") - 1
        bits = self.upper[word] if ones else ~self.upper[word]
        left, place = i - before[word], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halves of the word, the one that holds it
            low = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            place += np.where(up, width, 0)
            bits = np.where(up, bits >> np.uint64(width), bits)
        return word * 64 + place

    def lowbits(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.lows[word] >> shift
        over = shift > 0
        out = np.where(over, out | self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), out)
        return out & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low) | self.lowbits(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place whose value is not below each of ``values`` (n: none): the successor search."""
        high = (values >> np.uint64(self.low)).astype(np.int64)
        inside = np.minimum(high, self.tops - 1)
        # a value's upper part h lies between the zeros h - 1 and h
        at = np.zeros(len(high), np.int64)
        later = inside > 0
        at[later] = self._select(inside[later] - 1, False) - inside[later] + 1
        end = self._select(inside, False) - inside
        at[high > inside] = self.n
        want = values & np.uint64((1 << self.low) - 1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            less = self.lowbits(at[open_]) < want[open_]
            open_ = open_[less]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return at


class Trie:
    """Words and the successors of contexts, memory-mapped from a file that goes with the object.

    ``context``, ``word``: sorted by both, distinct.  ``logs``: log10 of the smoothed probability of each pair.
    """

    def __init__(self, words: int, context: np.ndarray, word: np.ndarray, logs: np.ndarray, unigram: np.ndarray, backoff: np.ndarray):
        counts = np.bincount(context, minlength=words)
        ends = np.cumsum(counts)
        last = np.zeros(words, np.int64)
        has = counts > 0
        last[has] = word[ends[has] - 1] + 1
        base = np.cumsum(last) - last
        self.pointers, self.successors = EliasFano(np.concatenate([[0], ends])), EliasFano(base[context] + word)
        parts = [*self.pointers.arrays(), *self.successors.arrays(), quantise(logs), quantise(unigram), quantise(backoff)]
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(handle, "wb") as f:
                places = []
                for x in parts:
                    f.write(b"\0" * (-f.tell() % 8))
                    places.append((f.tell(), x.dtype, len(x)))
                    f.write(x.tobytes())
            data = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)  # the map keeps the data until it is let go
        got = [data[at : at + n * t.itemsize].view(t) for at, t, n in places]
        self.pointers.open(*got[:2])
        self.successors.open(*got[2:4])
        self.logs, self.unigram, self.backoff = got[4:]

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        begin, end = self.pointers.access(context).astype(np.int64), self.pointers.access(context + 1).astype(np.int64)
        out = -STEP * (self.backoff[context].astype(np.int64) + self.unigram[word])
        at = np.flatnonzero(begin < end)
        if len(at):
            # a context's successors lie above the last value of the context before it
            before = begin[at] > 0
            base = np.zeros(len(at), np.uint64)
            base[before] = self.successors.access(begin[at][before] - 1) + np.uint64(1)
            want = base + word[at].astype(np.uint64)
            place = self.successors.find(want)
            ok = place < end[at]
            ok[ok] = self.successors.access(place[ok]) == want[ok]
            out[at[ok]] = -STEP * self.logs[place[ok]]
        return out


class Tokens:
    """The tokens of a chunk: words, then one end, as places in its sorted distinct hashes."""

    def __init__(self, value: tuple, fold: int, held: int):
        ids, none, offsets, raw = value
        self.held_out = np.array([not m and zlib.crc32(str(i).encode()) % fold == held for i, m in zip(ids.tolist(), none.tolist())], bool)
        hashes, sizes = [], []
        for i, j in C.doc_slices(offsets):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends = H.runs(~H.SPACE[part], at)
            h = H.slice_hashes(LOWER[part], starts, ends)
            n = np.diff(np.searchsorted(starts, at))
            to = np.cumsum(n + 1) - 1
            out = np.full(len(h) + j - i, END, np.uint64)
            place = np.ones(len(out), bool)
            place[to] = False
            out[place] = h
            hashes.append(out)
            sizes.append(n + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.vocab, self.word = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
        self.end = int(np.searchsorted(self.vocab, END))
        self.learnt = np.repeat(~self.held_out, self.sizes)

    def pairs(self):
        """context, word, learnt count of the distinct pairs, sorted; which pair each token ends.  The start's context is the end."""
        context = np.concatenate([[self.end], self.word[:-1]])
        context[self.starts] = self.end
        code, which = np.unique(context * len(self.vocab) + self.word, return_inverse=True)
        return code // len(self.vocab), code % len(self.vocab), np.bincount(which[self.learnt], minlength=len(code)), which


def _shards(keys: np.ndarray, shards: int):
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _send(keys: np.ndarray, shards: int, *columns: np.ndarray):
    """Keys in ascending order as differences (56 bits of each), with their columns."""
    for k, at in _shards(keys, shards):
        yield k, (C.planes(np.diff(keys[at] >> np.uint64(8), prepend=np.uint64(0)), 7), *(_narrow(c[at]) for c in columns))


def _total(asked):
    """Keys of all chunks together: which key each asked one is, and every key's sum of counts."""
    keys = [np.cumsum(C.unplanes(v[0])) for _, v in asked]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(which, np.concatenate([v[1] for _, v in asked]), len(distinct)).astype(np.int64)
    return [len(k) for k in keys], which, counts


TOTALS = -1  # the chunk that answers about whole shards go to


def _count_words(asked):
    sizes, which, counts = _total(asked)
    at = 0
    for (chunk, _), n in zip(asked, sizes):
        yield chunk, _narrow(counts[which[at : at + n]])
        at += n
    yield TOTALS, np.array([counts.sum(), (counts > 0).sum()])


def _count_pairs(asked):
    sizes, which, counts = _total(asked)
    at = 0
    for (chunk, _), n in zip(asked, sizes):
        yield chunk, _narrow(counts[which[at : at + n]])
        at += n
    kind = np.zeros(len(counts), np.int64)
    kind[which] = np.concatenate([v[2] for _, v in asked])
    yield TOTALS, np.stack([np.bincount(kind, counts, CLASSES), np.bincount(kind, counts == 1, CLASSES)])


def _totals(answers: DataFrame, shape: tuple) -> np.ndarray:
    """The sum of the answers about whole shards; Spark adds them up, one row comes back."""
    n = int(np.prod(shape))

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in C.unsqueeze(data.as_py()).astype(np.int64).reshape(-1).tolist()], [f"c{i}" for i in range(n)])

    rows = answers.where(f"chunk = {TOTALS}").select("data").mapInArrow(run, ", ".join(f"c{i} long" for i in range(n)))
    got = rows.selectExpr(*(f"coalesce(sum(c{i}), 0)" for i in range(n))).first()
    return np.array(list(got), np.int64).reshape(shape)


def _classes(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(count, 1).astype(np.float64))[1], CLASSES - 1)


def _gather(keys: np.ndarray, shards: int, got: dict, first: int = 0) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    for k, at in _shards(keys, shards):
        out[at] = got[first + k]
    return out


def _pair_keys(tokens: Tokens, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return H.mix(tokens.vocab[context] * H.BASE + H.mix(tokens.vocab[word]))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """Learn from rows whose crc32(doc_id as text) modulo ``fold`` is not ``held``; score all rows."""
    chunks = C.chunk_table(docs)
    shards = C.shard_count(chunks)

    def ask_words(value):
        t = Tokens(value, fold, held)
        yield from _send(t.vocab, shards, np.bincount(t.word[t.learnt], minlength=len(t.vocab)))

    def ask_pairs(value, got):
        t = Tokens(value, fold, held)
        context, word, count, _ = t.pairs()
        yield from _send(_pair_keys(t, context, word), shards, count, _classes(_gather(t.vocab, shards, got))[context])

    words = settle(C.answer(C.ask(chunks, ask_words), _count_words))
    n, v = (int(x) for x in _totals(words, (2,)))
    words = words.where(f"chunk <> {TOTALS}")
    pairs = settle(C.answer(C.forward(chunks, words, ask_pairs), _count_pairs))
    seen, once = _totals(pairs, (2, CLASSES))
    rest = np.clip(once / np.maximum(seen, 1), 0.05, 0.8)
    pairs = pairs.where(f"chunk <> {TOTALS}").selectExpr(f"shard + {shards} AS shard", "chunk", "data")

    def finish(value, got):
        t = Tokens(value, fold, held)
        context, word, _, which = t.pairs()
        count = _gather(t.vocab, shards, got)
        both = _gather(_pair_keys(t, context, word), shards, got, shards)
        p = (count + 1) / (n + v + 1)
        share = np.where(count > 0, rest[_classes(count)], 1.0)
        hold = both > 0
        c, w = context[hold], word[hold]
        logs = np.log10((1 - share[c]) * both[hold] / np.maximum(count[c], 1) + share[c] * p[w])
        trie = Trie(len(t.vocab), c, w, logs, np.log10(p), np.log10(share))
        score = trie.log10(context, word)[which]
        ends = t.starts + t.sizes
        arrays = [
            pa.array(value[0], mask=value[1]), pa.array(t.held_out), pa.array(t.sizes), pa.array(H.segment_sums((count > 0)[t.word].astype(np.int64), t.starts, ends)),
            pa.array(np.full(len(t.sizes), n)), pa.array(H.segment_sums(np.log10(p)[t.word], t.starts, ends)), pa.array(H.segment_sums(score, t.starts, ends)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in RESULT.split(", ")])

    return C.meet(chunks, words.unionByName(pairs), finish, RESULT)
