"""Rows whose key is among others, where most are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The table of hashed keys that goes to all tasks has 2**BITS bits (4 MB, in at most 2**(BITS - 6) rows).
BITS = 25


def kept_by(rows: DataFrame, key: Column, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, a table of one column.

    A bit for each hashed key, in a table of fixed size, drops most other rows where they are read; the join that follows, and is exact, shuffles only
    what is left.  The more keys, the more rows pass the bits; results do not change.
    """
    name = wanted.columns[0]
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word = lambda c: F.shiftright(slot(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), slot(c).bitwiseAND(F.lit(63)).cast("int"))
    marks = wanted.groupBy(word(F.col(name)).alias("_word")).agg(F.bit_or(bit(F.col(name))).alias("_bits"))
    near = rows.join(F.broadcast(marks), (word(key) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit(key)) != 0)).select(rows.columns)
    # no semi-join, which Spark would move below the bits
    return near.join(wanted.select(F.col(name).alias("_key")).distinct(), key == F.col("_key")).select(rows.columns)
