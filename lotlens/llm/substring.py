"""Substring dedup: bytes covered by a string of ``depth`` bytes that also starts in a document with a smaller id.

Depth-limited radix sort of suffixes.  Every string of ``depth`` bytes has an anchor: its least k-gram by a fixed hash, the leftmost of
equals.  Equal strings have equal anchors at equal places, so the suffixes are dealt to shards by anchor and sorted there.  The suffixes
of one document that follow each other and share an anchor are one run; a run's bytes hold all its suffixes.

1. Runs are grouped by (anchor, hash of the run's bytes): all suffixes of a run whose equal starts in a smaller document are repeated.
   Most suffixes end here: their anchor occurs in no other run, or the whole run is a copy.
2. Where one anchor has several different runs, the first copy of each sends its bytes, and the shard sorts the suffixes by
   most-significant-digit passes of eight bytes through ``depth``; a suffix alone in its group leaves.  The groups that are left are exactly
   the repeated strings.

Run hashes have 48 bits within equal anchors of 40; step 2 compares the bytes themselves.

Defined cases: a null text is empty; a text shorter than ``depth`` loses nothing; documents with equal ids never count against each
other, so repeated rows stay alike; a row with a null id is returned whole and counts against none; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from . import hashing as H
from .common import settle

DEPTH = 50
GRAM = 20


def _gram_keys(raw: np.ndarray, k: int) -> np.ndarray:
    """(32-bit hash of the k bytes from i, i) as one number for every i."""
    base = 0x9E3779B1
    level = {1: raw.astype(np.uint32) + np.uint32(1)}
    width = 1
    while 2 * width <= k:
        h = level[width]
        level[2 * width] = h[:-width] * np.uint32(pow(base, width, 1 << 32)) + h[width:]
        width *= 2
    h, have = level[width], width
    while have < k:
        step = max(w for w in level if w <= k - have)
        more = level[step]
        h = h[: len(raw) - have - step + 1] * np.uint32(pow(base, step, 1 << 32)) + more[have : have + len(raw) - have - step + 1]
        have += step
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    if have < width:
        a = np.minimum(a[: len(a) - (width - have)], a[width - have :])
    return a


def runs(value: tuple, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """first suffix, last suffix, document, anchor hash, run hash of every run of a chunk, by place."""
    _, none, offsets, raw = value
    out = []
    for i, j in C.doc_slices(offsets):
        lo = offsets[i]
        part, ends = raw[lo : offsets[j]], offsets[i + 1 : j + 1] - lo
        if len(part) < depth:
            continue
        least = _sliding_min(_gram_keys(part, gram), depth - gram + 1)
        n = len(least)
        valid = np.zeros(n + 1, np.int8)
        starts = np.concatenate([[0], ends[:-1]])
        ok = (ends - starts >= depth) & ~none[i:j]
        np.add.at(valid, starts[ok], 1)
        np.add.at(valid, ends[ok] - depth + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        first[np.minimum(starts[ok], n - 1)] |= True
        s = np.flatnonzero(first)
        last = np.zeros(n, bool)
        last[:-1] = valid[:-1] & (~valid[1:] | first[1:])
        last[-1] = valid[-1]
        e = np.flatnonzero(last)
        anchor = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.searchsorted(ends, s, "right") + i
        # where in the run the anchor lies is part of what must agree
        whole = H.mix(H.slice_hashes(part, s, e + depth) ^ (anchor - s).astype(np.uint64))
        out.append((s + lo, e + lo, doc, H.slice_hashes(part, anchor, anchor + gram), whole))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


class Items:
    """The distinct (anchor, run) of a chunk by shard: what it asks about, in the order asked."""

    def __init__(self, value: tuple, shards: int, depth: int, gram: int):
        ids = value[0]
        self.first, self.last, self.doc, anchor, whole = runs(value, depth, gram)
        self.shard = ((anchor & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64)
        self.anchor, self.whole = anchor >> np.uint64(24), whole >> np.uint64(16)
        order = np.lexsort((self.doc, ids[self.doc], self.whole, self.anchor, self.shard))
        a, w, s = self.anchor[order], self.whole[order], self.shard[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        self.item = np.zeros(len(order), np.int64)
        self.item[order] = np.cumsum(new) - 1
        self.owner = order[new]  # the run that stands for the item: of the smallest id in this chunk
        self.bounds = np.searchsorted(self.shard[self.owner], np.arange(shards + 1))

    def by_shard(self):
        for k in range(len(self.bounds) - 1):
            if self.bounds[k] < self.bounds[k + 1]:
                yield k, self.owner[self.bounds[k] : self.bounds[k + 1]]


def _question(shards: int, depth: int, gram: int):
    def ask(value):
        items = Items(value, shards, depth, gram)
        for k, at in items.by_shard():
            docs, which = np.unique(value[0][items.doc[at]], return_inverse=True)
            yield k, (C.planes(np.diff(items.anchor[at], prepend=np.uint64(0)), 5), C.planes(items.whole[at], 6), docs, C.planes(which, 3))

    return ask


def _reply(asked):
    """0: nothing repeated; 1: the run is a copy of a run of a smaller id; 2: the anchor has other runs and this is the first copy."""
    parts = [(np.cumsum(C.unplanes(a)), C.unplanes(w), d[C.unplanes(k).astype(np.int64)]) for _, (a, w, d, k) in asked]
    anchor, whole, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((doc, whole, anchor))
    a, w, d = anchor[order], whole[order], doc[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_w = new_a.copy()
    new_w[1:] |= w[1:] != w[:-1]
    least = d[np.flatnonzero(new_w)][np.cumsum(new_w) - 1]
    kinds = np.add.reduceat(new_w.astype(np.int64), np.flatnonzero(new_a))[np.cumsum(new_a) - 1]
    status = np.zeros(len(a), np.uint8)
    status[order] = np.where(d > least, 1, np.where(kinds > 1, 2, 0))
    at = 0
    for (chunk, _), p in zip(asked, parts):
        yield chunk, status[at : at + len(p[0])]
        at += len(p[0])


def _send_bytes(shards: int, depth: int, gram: int):
    def send(value, got):
        items, ids, raw = Items(value, shards, depth, gram), value[0], value[3]
        rows = []
        for k, at in items.by_shard():
            at = at[got[k] == 2]
            if len(at):
                s, n = items.first[at], items.last[at] + depth - items.first[at]
                to = np.cumsum(n)
                text = raw[np.repeat(s - to + n, n) + np.arange(to[-1])]
                rows.append((k, (C.planes(np.diff(items.anchor[at], prepend=np.uint64(0)), 5), ids[items.doc[at]], n, text)))
        return rows

    return send


def radix_repeats(group: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, depth: int, most: int = 1_000_000) -> np.ndarray:
    """For runs of ``size`` bytes, laid end to end and sorted by ``group``: True for each suffix that also starts in a smaller doc."""
    n = size - depth + 1
    start, first = np.cumsum(size) - size, np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    edges = np.concatenate([new, [len(group)]])
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[edges[at]] + most, "right")))
        to = max(at + 1, int(np.searchsorted(edges, to, "right")) - 1)
        a, b = edges[at], edges[to]
        at = to
        lo, hi = start[a], start[b - 1] + size[b - 1]
        digit = np.zeros(hi - lo + 8, np.uint64)
        digit[: hi - lo] = data[lo:hi]
        for k in (1, 2, 4):  # eight bytes from each place as one number, the first byte highest
            digit[:-k] = digit[:-k] << np.uint64(8 * k) | digit[k:]
        m = n[a:b]
        base = np.repeat(start[a:b] - lo - (first[a:b] - first[a]), m) + np.arange(m.sum())
        owner = np.repeat(doc[a:b], m)
        alive, rank = np.arange(len(base)), np.repeat(np.cumsum(np.isin(np.arange(a, b), new)), m)
        for done in range(0, depth, 8):
            d = digit[base[alive] + done]
            if depth - done < 8:
                d = d >> np.uint64(8 * (8 - depth + done))
            order = np.lexsort((d, rank))
            alive, d, rank = alive[order], d[order], rank[order]
            fresh = np.ones(len(d), bool)
            fresh[1:] = (d[1:] != d[:-1]) | (rank[1:] != rank[:-1])
            label = np.cumsum(fresh) - 1
            kept = np.bincount(label, minlength=1)[label] > 1 if len(label) else np.zeros(0, bool)
            alive, rank = alive[kept], label[kept]
        if len(alive):
            order = np.argsort(rank, kind="stable")
            alive, rank = alive[order], rank[order]
            fresh = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            least = np.minimum.reduceat(owner[alive], fresh)
            sizes = np.diff(np.concatenate([fresh, [len(alive)]]))
            out[first[a] + alive] = owner[alive] > np.repeat(least, sizes)
    return out


def _sort_suffixes(depth: int):
    def reply(asked):
        parts = [(np.cumsum(C.unplanes(a)), doc, n, text) for _, (a, doc, n, text) in asked]
        anchor, doc, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
        data = np.concatenate([p[3] for p in parts])
        order = np.argsort(anchor, kind="stable")
        start = np.cumsum(size) - size
        n = size[order]
        to = np.cumsum(n)
        flags = radix_repeats(anchor[order], doc[order], n, data[np.repeat(start[order] - to + n, n) + np.arange(to[-1])], depth)
        # back into the order in which the runs were sent
        m = size - depth + 1
        sorted_first = np.zeros(len(m), np.int64)
        sorted_first[order] = np.cumsum(m[order]) - m[order]
        at = np.cumsum(m)
        flags = flags[np.repeat(sorted_first - at + m, m) + np.arange(at[-1])]
        k = 0
        for (chunk, _), p in zip(asked, parts):
            total = int((p[2] - depth + 1).sum())
            yield chunk, np.packbits(flags[k : k + total])
            k += total

    return reply


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary"


def _finish(shards: int, depth: int, gram: int):
    def finish(value, got):
        ids, none, offsets, raw = value
        items = Items(value, shards, depth, gram)
        cover = np.zeros(len(raw) + 1, np.int32)
        least = ids[items.doc[items.owner]] if len(items.owner) else ids[:0]
        status = np.zeros(len(items.owner), np.uint8)
        for k, at in items.by_shard():
            status[items.bounds[k] : items.bounds[k + 1]] = got[k]
        later = ids[items.doc] > least[items.item]
        whole = later | (status[items.item] == 1)
        np.add.at(cover, items.first[whole], 1)
        np.add.at(cover, items.last[whole] + depth, -1)
        # items with flags of their own: every run of the item in the document that stands for it has the same
        n = np.zeros(len(items.owner), np.int64)
        where = np.zeros(len(items.owner), np.int64)
        flags, total = [], 0
        for k, at in items.by_shard():
            if -1 - k in got:
                mine = items.bounds[k] + np.flatnonzero(got[k] == 2)
                n[mine] = items.last[items.owner[mine]] - items.first[items.owner[mine]] + 1
                where[mine] = total + np.cumsum(n[mine]) - n[mine]
                flags.append(np.unpackbits(got[-1 - k], count=int(n[mine].sum())))
                total += len(flags[-1])
        if total:
            flags = np.concatenate(flags).astype(bool)
            run = np.flatnonzero(~whole & (status[items.item] == 2))
            m = n[items.item[run]]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            hit = flags[np.repeat(where[items.item[run]], m) + step]
            place = (np.repeat(items.first[run], m) + step)[hit]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + depth, -1)
        gone = np.cumsum(cover[:-1]) > 0
        begins, ends = H.runs(gone, offsets)
        lo, hi = np.searchsorted(begins, offsets[:-1]), np.searchsorted(begins, offsets[1:])
        removed = H.segment_sums(gone.astype(np.int64), offsets[:-1], offsets[1:])
        digest, spans = [], []
        for i in range(len(ids)):
            text, cut = raw[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
            digest.append(hashlib.sha256((text[~cut] if removed[i] else text).tobytes()).hexdigest())
            spans.append((np.stack([begins[lo[i] : hi[i]], ends[lo[i] : hi[i]]], axis=1) - offsets[i]).astype("<i8").tobytes() if removed[i] else b"")
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(np.diff(offsets)), pa.array(removed), pa.array(hi - lo), pa.array(digest), pa.array(spans, pa.binary())], [x.split()[0] for x in RESULT.split(", ")])

    return finish


def substring_dedup(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (pairs of little-endian 64-bit begin, end) of every row."""
    if not 0 < gram <= depth:
        raise ValueError("anchors must fit into the strings")
    chunks = C.chunk_table(docs)
    shards = C.shard_count(chunks)
    status = settle(C.answer(C.ask(chunks, _question(shards, depth, gram)), _reply))

    asked = C.forward(chunks, status, _send_bytes(shards, depth, gram))
    flags = C.answer(asked, _sort_suffixes(depth))
    both = status.unionByName(flags.selectExpr("-1 - shard AS shard", "chunk", "data"))
    return C.meet(chunks, both, _finish(shards, depth, gram), RESULT)
