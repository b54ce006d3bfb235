"""Token ids in Arrow batches, and their binary form in patched frame-of-reference blocks.

Defined cases: a null text is empty; an empty text has no ids but those appended; repeated rows are encoded alike and each
has its place in the order; an empty table gives an empty result; a null doc_id sorts first; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import pieces, settle, utf8


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes for a first cut of text: 0 white space, 1 letters, 2 digits, 3 symbols, 4 anything that is left to the tokenizer.
KIND = np.full(256, 4, np.uint8)
KIND[H.SPACE] = 0
KIND[0x21:0x7F] = 3
for _a, _b in (("A", "Z"), ("a", "z")):
    KIND[ord(_a) : ord(_b) + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[0x80:0xC0] = 1  # what follows a lead byte has its kind
KIND[0xC3:0xC6] = 1  # Latin letters with marks, U+00C0 to U+017F; the three exceptions are taken out below
KIND[ord("'")] = 4  # contractions
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class WordEncoder:
    """ids of texts by a tokenizer that never joins across white space, letter runs, digits and symbol runs (CUTS); any other encodes whole texts.

    Those parts are found with numpy, each distinct part is encoded by the tokenizer once and remembered, and documents are put
    together again from the remembered ids.  Words with other characters, apostrophes or special tokens are parts as a whole.
    The memory is bounded: when it is full, its older half goes.
    """

    MOST = 300_000
    #: What the tokenizer's file must say of its normaliser and its splitter.
    CUTS = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    )

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        self.by_parts = (said.get("normalizer"), (cut.get("pretokenizers") or [None])[0]) == self.CUTS
        self.known: dict[int, bytes] = {}

    def _parts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = KIND[raw]
        starts, ends = H.runs(kind > 0, offsets)
        odd = kind == 4
        two = raw[1:].astype(np.uint16) | raw[:-1].astype(np.uint16) << 8
        odd[:-1] |= (two == 0xC397) | (two == 0xC3B7) | (two == 0xC4B0) | (two == 0x3C7C)
        whole = H.segment_sums(odd.astype(np.int64), starts, ends) > 0
        first = np.zeros(len(raw), bool)
        first[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0)
        first |= kind == 2
        text = LOWER[raw]
        if whole.any():
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[starts[whole]] += 1
            inside[ends[whole]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            first &= ~inside
            text = np.where(inside, raw, text)
        first[starts] = True
        last = np.zeros(len(raw) + 1, bool)
        last[ends] = True
        at = np.flatnonzero(first)
        last[at[at > 0]] |= kind[at[at > 0] - 1] > 0
        return text, at, np.flatnonzero(last)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and the last ones end)."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not self.by_parts:
            data = raw.tobytes()
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)]
            return np.concatenate([np.array(x, np.uint32) for x in ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        text, starts, ends = self._parts(raw, offsets)
        keys, at, which = np.unique(H.slice_hashes(text, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.MOST:
            for k in [k for k, _ in zip(self.known, range(len(self.known) // 2))]:
                del self.known[k]
        known, listed = self.known, keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in known]
        if new:
            data = text.tobytes()
            words = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
            for i, e in zip(new, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
                known[listed[i]] = array("I", e.ids).tobytes()
        held = [known[k] for k in listed]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        flat = np.frombuffer(b"".join(held), np.uint32)
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[which] - to[:-1], n) + np.arange(to[-1])]
        return ids, to[np.searchsorted(starts, offsets)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, so that later tasks find the words that earlier ones met."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(part: pa.RecordBatch, vocab: str, end_id: int) -> list[bytes]:
    """For each row of (doc_id, text): its ids and the end id as little-endian unsigned 32-bit integers."""
    raw, offsets = utf8(part.column(1))
    ids, at = encoder(vocab)(raw, offsets)
    data, end = ids.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
    return [data[4 * a : 4 * b] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


# --- patched frame of reference -----------------------------------------------------------------------------------

BLOCK = 128


def pfor_encode(values: np.ndarray, percentile: float = 0.9) -> bytes:
    """Values (unsigned 32 bits) as blocks of 128: least value, width, number of exceptions, bit planes, exceptions.

    The width holds ``percentile`` of a block's offsets from its least value; the high bits of larger ones follow as
    (place, high bits).  An index of block starts comes first, so that any block can be read alone.
    """
    n = len(values)
    blocks = -(-n // BLOCK)
    head = np.array([n, blocks], "<u4").tobytes()
    if not n:
        return head
    v = np.full(blocks * BLOCK, values[-1], np.uint32)
    v[:n] = values
    v = v.reshape(blocks, BLOCK)
    least = v.min(axis=1)
    v = v - least[:, None]
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    width = np.sort(bits, axis=1)[:, min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)].astype(np.int64)
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_over
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    base = starts[:-1]
    out[base[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[base + 4] = width
    out[base + 5] = n_over
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        for b in range(w):
            planes = np.packbits((v[at] >> np.uint32(b)).astype(np.uint8) & 1, axis=1)
            out[(base[at] + 6 + 16 * b)[:, None] + np.arange(16)] = planes
    row, place = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_over)])[:-1][row]
        to = base[row] + 6 + 16 * width[row] + 5 * nth
        out[to] = place
        high = (v[row, place] >> width[row].astype(np.uint32)).astype("<u4")
        out[to[:, None] + np.arange(1, 5)] = high.view(np.uint8).reshape(-1, 4)
    return head + starts[:-1].astype("<u4").tobytes() + out.tobytes()


def pfor_decode(data: bytes) -> np.ndarray:
    n, blocks = (int(x) for x in np.frombuffer(data, "<u4", 2))
    if not n:
        return np.zeros(0, np.uint32)
    base = np.frombuffer(data, "<u4", blocks, 8).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=8 + 4 * blocks)
    least = raw[base[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    width, n_over = raw[base + 4].astype(np.int64), raw[base + 5].astype(np.int64)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        part = np.zeros((len(at), BLOCK), np.uint32)
        for b in range(w):
            part |= np.unpackbits(raw[(base[at] + 6 + 16 * b)[:, None] + np.arange(16)], axis=1).astype(np.uint32) << np.uint32(b)
        v[at] = part
    row = np.repeat(np.arange(blocks), n_over)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_over)])[:-1][row]
        at = base[row] + 6 + 16 * width[row] + 5 * nth
        high = raw[at[:, None] + np.arange(1, 5)].copy().view("<u4").reshape(-1)
        v[row, raw[at]] |= high << width[row].astype(np.uint32)
    return (v + least[:, None]).reshape(-1)[:n].astype(np.uint32)


SEGMENT = 1 << 17
FILE_SCHEMA = "shard int, segment int, n_docs int, n_tokens long, doc_ids binary, no_id binary, lengths binary, ids binary"


def write_token_files(docs: DataFrame, vocab: str, end_id: int = 2, segment: int = SEGMENT) -> DataFrame:
    """Encode, append ``end_id`` and write in ascending doc_id order; returns the files as read back.

    Rows are range-partitioned by doc_id, so shard numbers ascend with it.  A file row is a segment: whole documents of
    about ``segment`` ids, their lengths and ids each as patched frame-of-reference blocks with an index of block starts.
    """

    def encode(batches):
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        ids, none, held, size = [], [], [], 0

        def row():
            lengths = np.fromiter((len(x) // 4 for x in held), np.uint32, len(held))
            tokens = np.frombuffer(b"".join(held), "<u4")
            return [[shard], [number], [len(held)], [len(tokens)], [np.array(ids, "<i8").tobytes()], [np.array(none, np.uint8).tobytes()], [pfor_encode(lengths)], [pfor_encode(tokens)]]

        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]
        for batch in batches:
            for part in pieces(batch, "text"):
                for doc_id, tokens in zip(part.column(0).to_pylist(), encoded(part, vocab, end_id)):
                    ids.append(0 if doc_id is None else doc_id)
                    none.append(doc_id is None)
                    held.append(tokens)
                    size += len(held[-1]) // 4
                    if size >= segment:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row(), types)], names)
                        number, ids, none, held, size = number + 1, [], [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row(), types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return settle(rows.mapInArrow(encode, FILE_SCHEMA))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    # one row per segment: totals by shard first, so that the only window over all rows has one row per shard
    sizes = files.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment")
    starts = sizes.withColumn("in_shard", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("shard_start") + F.col("in_shard")).alias("segment_start"))

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lengths = pfor_decode(r["lengths"]).astype(np.int64)
                tokens = pfor_decode(r["ids"]).astype("<u4").tobytes()
                at = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                none = np.frombuffer(r["no_id"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=none), pa.array(np.full(len(lengths), r["shard"], np.int32)), pa.array(np.full(len(lengths), r["segment"], np.int32)), pa.array(at[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "shard", "segment", "in_segment", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "segment", "doc_ids", "no_id", "lengths", "ids")
    rows = rows.mapInArrow(decode, "doc_id long, shard int, segment int, in_segment long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "segment"]).select("doc_id", (F.col("segment_start") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32")
