"""Packing documents into sequences by minimum bin slack.

All pieces of one length are alike, so the packing is worked out on the histogram of lengths (at most ``capacity`` numbers,
whatever the size of the corpus) and Spark hands every piece its place.

Defined cases: a null text is empty; a document without ids still has its end id; repeated rows are packed as rows of their
own; an empty table gives an empty result; a null doc_id is packed like any other; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, settle
from .tokens import encoded


def fullest(capacity: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum not above ``capacity``, by a bitset of reachable sums."""
    reach, steps = 1, []
    mask, full = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in lengths:
        if length > capacity:
            continue
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            new = (reach | reach << (k * length)) & mask
            if new != reach:
                steps.append((reach, length, k))
                reach = new
            left, k = left - k, 2 * k
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + k
            at -= k * length
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(combination of lengths, how many bins hold it)]: each bin takes the largest length left and the fullest rest.

    A combination is used again as long as its lengths last, so the number of steps depends on the capacity alone.
    """
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        pick = fullest(capacity - seed, lengths, counts)
        counts[seed] += 1
        pick[seed] = pick.get(seed, 0) + 1
        times = min(counts[k] // c for k, c in pick.items())
        for k, c in pick.items():
            counts[k] -= c * times
        lengths = [k for k in lengths if counts[k]]
        out.append((pick, times))
    return out


def cut_documents(docs: DataFrame, vocab: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids with an end id; longer ones in pieces of ``capacity``."""

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded(part, vocab, end_id)):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def slots(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (rank after the last, first rank, first bin, copies a bin, offset), by rank among that length's pieces."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for pick, times in bins:
        offset = 0
        for length in sorted(pick, reverse=True):
            copies, at = pick[length], used.get(length, 0)
            out.setdefault(length, []).append((at + copies * times, at, first, copies, offset))
            used[length] = at + copies * times
            offset += copies * length
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to the pieces of ``cut_documents``."""
    spark = cut.sparkSession
    cut = settle(cut)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # a length's rank: its number in smaller buckets, then its place in its own bucket; no length lies in one task
    sums = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    # no more rows than lengths up to the capacity
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(minimum_bin_slack(histogram, capacity))
    ranked = cut.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at, t = np.flatnonzero(length == k), table[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right")]
                nth = rank[at] - row[:, 1]
                sequence[at] = row[:, 2] + nth // row[:, 3]
                offset[at] = row[:, 4] + nth % row[:, 3] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
