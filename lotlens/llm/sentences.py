"""Substring dedup by sliding sentence spans.

A text is cut after sentence ends and line breaks; a sentence of more than ``long`` words is cut at its commas too, and what is still
longer after every word that a hash of the word picks (so that text without punctuation is cut at the same words wherever it stands).
From every sentence on, the shortest run of at least ``least`` sentences that has ``words`` words is hashed (96 bits).  The runs are joined
globally; a run that is not the first of its kind (by doc_id, then place) covers its sentences, and covered sentences are removed.  A
text that is too short for a run is one run as a whole, which meets only other such texts.

A run that half the corpus has is one row a task in the sums that find the first of each kind.  To mark the later copies the runs meet the
firsts by a shuffle in which the most frequent ones are dealt to several places.

Defined cases: a null text stays null and has no sentences, a blank one has none either; white space around a sentence does not matter
to its hash, and blank pieces are kept and not counted; runs may repeat inside one document; rows that repeat id and text count as one
row; rows with a null doc_id are left alone; an empty table gives an empty result; other columns are not read.  Work on a text is in
proportion to its length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, settle
from .common import pieces as slices

BLANK = b" \t\r\n"
SENTENCE = re.compile(rb"[.!?][ \t\r\n]+|\n+")
COMMA = re.compile(rb"[,;:][ \t\r\n]+")
WORD = re.compile(rb"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+[\x09-\x0D\x20]*")
LONG, WORDS, LEAST = 20, 20, 2


def _after(pattern: re.Pattern, text: bytes) -> list[bytes]:
    out, at = [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return out


def _picked(text: bytes) -> list[bytes]:
    """Cut after the words whose MD5 begins with 0 or 1, an eighth of all words."""
    out, held = [], []
    for m in WORD.finditer(text):
        held.append(m.group())
        if hashlib.md5(held[-1].strip()).digest()[0] < 0x20:
            out.append(b"".join(held))
            held = []
    if held or not out:
        out.append(b"".join(held) if held else text)
    return out


def cut(text: bytes, long: int = LONG) -> list[bytes]:
    """The pieces of a text; put together they are the text."""
    out = []
    for sentence in _after(SENTENCE, text):
        if len(sentence) <= 2 * long or len(sentence.split()) <= long:
            out.append(sentence)
            continue
        for part in _after(COMMA, sentence):
            if len(part.split()) <= long:
                out.append(part)
            else:
                out += _picked(part)
    return out


def runs_of(said: list[bytes], words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence, and the one after the last, of every run; the whole if there is none."""
    n = len(said)
    total = np.cumsum([0, *(len(s.split()) for s in said)])
    to = np.maximum(np.arange(n) + least, np.searchsorted(total, total[:-1] + words))
    at = np.flatnonzero(to <= n)
    return (at, to[at]) if len(at) else (np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n))


def runs(docs: DataFrame, long: int, words: int, least: int) -> DataFrame:
    """doc_id, row, at, upto, a, b: the runs of every row and their hashes."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows, first, last, keys = [], [], [], [], []
                for doc, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist()):
                    said = [s for p in cut(text, long) if (s := p.strip(BLANK))]
                    at, to = runs_of(said, words, least)
                    whole = len(at) == 1 and int(to[0]) == len(said) and (len(said) < least or sum(len(s.split()) for s in said) < words)
                    keys += [digest(b"\n".join(said[i:j]), 1 if whole else 0) for i, j in zip(at.tolist(), to.tolist())]
                    ids.append(np.full(len(at), doc))
                    rows.append(np.full(len(at), row))
                    first.append(at)
                    last.append(to)
                key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                columns = [np.concatenate(x).astype(t) for x, t in ((ids, np.int64), (rows, np.int64), (first, np.int32), (last, np.int32))]
                columns += [np.ascontiguousarray(key[:, 0]), key[:, 1].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "row", "at", "upto", "a", "b"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row", "text")
    return rows.mapInArrow(run, "doc_id long, row long, at int, upto int, a long, b int")


def later_runs(docs: DataFrame, long: int = LONG, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, row, at, upto of every run that is not the first of its kind."""
    found = runs(docs, long, words, least)
    place = F.struct("doc_id", "row", "at")
    # the runs of a text are worked out again for the join, which is cheaper than keeping them all on disk
    kinds = settle(found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    return join_hot(found, kinds, ["a", "b"]).where(place != F.col("first")).select("doc_id", "row", "at", "upto")


def sentence_dedup(docs: DataFrame, long: int = LONG, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_sentences, n_removed, text (what is left) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    # a set: rows that repeat id and text name each run more than once
    gone = later_runs(docs, long, words, least).groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "upto")).alias("gone"))

    def remove(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                numbers, removed, left = [], [], []
                gone, texts = part.column(2), part.column(1).cast(pa.large_binary()).to_pylist()
                for k, text in enumerate(texts):
                    parts = cut(text or b"", long)
                    said = [i for i, p in enumerate(parts) if p.strip(BLANK)]
                    numbers.append(len(said))
                    if not gone[k].is_valid:
                        removed.append(0)
                        left.append(text)
                        continue
                    cover = np.zeros(len(said) + 1, np.int64)
                    fields = gone[k].values
                    np.add.at(cover, fields.field("at").to_numpy(), 1)
                    np.add.at(cover, fields.field("upto").to_numpy(), -1)
                    drop = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                    removed.append(len(drop))
                    out = {said[i] for i in drop.tolist()}
                    left.append(b"".join(p for i, p in enumerate(parts) if i not in out))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    return docs.join(gone, ["doc_id", "row"], "left").select("doc_id", "text", "gone").mapInArrow(remove, "doc_id long, n_sentences long, n_removed long, text string")
