"""Ask-and-answer between chunks of documents and shards of keys.

Some operators need, for very many small keys of every document, what the whole corpus knows of each key.  Rows of (key, document) would
multiply the input.  Here a chunk (a few MB of whole documents in one row) asks each shard once about its distinct keys, packed in one
binary value; a shard joins what all chunks ask and answers each of them in the order asked.  A key however frequent appears once per
chunk, so hot keys are aggregated before the shuffle; shards are as many as keep their questions at a fixed size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, settle, utf8

CHUNK = 8_000_000
CHUNK_SCHEMA = "chunk long, size long, data binary"
MESSAGE = "shard int, chunk long, data binary"


def squeeze(value) -> bytes:
    """Arrays and numbers, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def unsqueeze(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def chunk_table(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, size, data: the ids (null: masked), byte offsets and bytes of whole documents, about ``size`` bytes a row.

    Written in the shared folder: later steps must see the same chunks.  A chunk is named by its place in its partition.
    """

    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        ids, texts, held, n = [], [], 0, 0

        def pack():
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for o, _ in texts]))])
            raw = np.concatenate([r for _, r in texts])
            value = (np.concatenate([i for i, _ in ids]), np.concatenate([m for _, m in ids]), offsets, raw)
            return pa.RecordBatch.from_arrays([pa.array([name + n]), pa.array([len(raw)], pa.int64()), pa.array([squeeze(value)], pa.binary())], ["chunk", "size", "data"])

        for batch in batches:
            for part in pieces(batch, "text"):
                raw, offsets = utf8(part.column(1))
                none = np.asarray(part.column(0).is_null())
                ids.append((np.asarray(part.column(0).fill_null(0), np.int64), none))
                texts.append((offsets, raw))
                held += len(raw)
                if held >= size:
                    yield pack()
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield pack()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(docs.mapInArrow(run, CHUNK_SCHEMA))


def doc_slices(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``most`` bytes (one at least), to bound working memory."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each value, byte by byte apart, which compresses well; undone by ``unplanes``."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def unplanes(data: np.ndarray) -> np.ndarray:
    out = np.zeros((data.shape[1], 8), np.uint8)
    out[:, : len(data)] = data.T
    return out.view("<u8").reshape(-1)


def shard_count(chunks: DataFrame, size: int = 32_000_000) -> int:
    """So many shards that the questions of about ``size`` bytes of text meet in each."""
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(1, -(-total // size))


def _emit(rows: Iterable[tuple[int, int, object]]) -> Iterator[pa.RecordBatch]:
    for shard, chunk, value in rows:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([squeeze(value)], pa.binary())], ["shard", "chunk", "data"])


def ask(chunks: DataFrame, question: Callable[[tuple], Iterable[tuple[int, object]]]) -> DataFrame:
    """Messages of each chunk: ``question(chunk's value)`` yields (shard, value)."""

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _emit((s, chunk, v) for s, v in question(unsqueeze(data.as_py())))

    return chunks.select("chunk", "data").mapInArrow(run, MESSAGE)


def answer(messages: DataFrame, reply: Callable[[list[tuple[int, object]]], Iterable[tuple[int, object]]]) -> DataFrame:
    """Messages to chunks: ``reply([(chunk, value)])`` of a shard yields (chunk, value)."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [(c, unsqueeze(d.as_py())) for c, d in zip(table.column("chunk").to_pylist(), table.column("data"))]
        return pa.Table.from_batches(list(_emit((shard, c, v) for c, v in reply(asked))), pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())]))

    return messages.groupBy("shard").applyInArrow(run, MESSAGE)


def meet(chunks: DataFrame, messages: DataFrame, finish: Callable[[tuple, dict[int, object]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``finish(chunk's value, {shard: answer})`` for every chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {s: unsqueeze(d.as_py()) for s, d in zip(right.column("shard").to_pylist(), right.column("data"))}
        out = [b for d in left.column("data") for b in finish(unsqueeze(d.as_py()), got)]
        return pa.Table.from_batches([b.cast(shape) for b in out], shape)

    return chunks.select("chunk", "data").groupBy("chunk").cogroup(messages.groupBy("chunk")).applyInArrow(run, schema)


def forward(chunks: DataFrame, messages: DataFrame, question: Callable[[tuple, dict[int, object]], Iterable[tuple[int, object]]]) -> DataFrame:
    """Messages of each chunk that has had answers: ``question(chunk's value, {shard: answer})`` yields (shard, value)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {s: unsqueeze(d.as_py()) for s, d in zip(right.column("shard").to_pylist(), right.column("data"))}
        rows = [(s, c, v) for c, d in zip(left.column("chunk").to_pylist(), left.column("data")) for s, v in question(unsqueeze(d.as_py()), got)]
        return pa.Table.from_batches(list(_emit(rows)), pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())]))

    return chunks.select("chunk", "data").groupBy("chunk").cogroup(messages.groupBy("chunk")).applyInArrow(run, MESSAGE)
