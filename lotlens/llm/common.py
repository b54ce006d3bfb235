"""What the corpus operators share: joins with hot keys and Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import discard, settle

__all__ = ["counts", "discard", "free_name", "id_text", "join_hot", "pieces", "settle", "task_rows", "utf8"]


#: A task takes about LEAST rows of one key, or a HEAVY-th of all rows where that is more: fewer than HEAVY keys have more, by arithmetic.
HEAVY, LEAST = 200_000, 2000


def task_rows(total: int) -> int:
    """The rows of one key that a task takes, of a table of ``total`` rows."""
    return max(LEAST, total // HEAVY)


def counts(kinds: DataFrame) -> tuple[int, int]:
    """The sum and the greatest of ``n``."""
    total, top = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return total, top


def join_hot(rows: DataFrame, kinds: DataFrame, on: list[str], known: tuple[int, int] | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``kinds``, one row for each key, whose column ``n`` says how many rows have it.

    Rows of a key that is too frequent for one task are dealt to as many places as they fill, each with a copy of its kind.  ``kinds`` is read
    twice and should be settled; ``known`` are its ``counts``.
    """
    total, top = known or counts(kinds)
    bound = task_rows(total)
    if top <= bound:
        return rows.join(kinds.drop("n"), on)
    places = F.ceil(F.col("n") / bound).cast("int")
    # fewer than HEAVY rows of keys and a number
    hot = kinds.where(F.col("n") > bound).select(*on, places.alias("_places"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_places").isNull(), 0).otherwise(F.pmod(F.hash(*rows.columns), F.coalesce("_places", F.lit(1))))).drop("_places")
    every = F.when(F.col("n") > bound, F.sequence(F.lit(0), places - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(kinds.withColumn("_salt", F.explode(every)).drop("n"), [*on, "_salt"]).drop("_salt")


def free_name(columns: list[str], name: str = "_") -> str:
    """``name``, lengthened until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def id_text(doc_ids: DataFrame | None = None, column: str = "doc_id"):
    """crc32 of the id written as text, the rule by which folds are dealt."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty.  No Python object per row."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def pieces(batch: pa.RecordBatch, text: str, most: int = 2_000_000):
    """Slices of a batch that hold about ``most`` bytes of text each (one row at least), to bound working memory."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at : at + 4096])
        n = max(1, int(np.searchsorted(total, most, "right")))
        yield batch.slice(at, n)
        at += n
