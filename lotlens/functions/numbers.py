"""Distances, vectors and photo hashes as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .rules import EARTH_MILES
from .text import col


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Miles along the great circle."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_MILES) * F.asin(F.sqrt(h))


def as_double(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for empty, zero or unlike-sized vectors."""
    x, y = as_double(a), as_double(b)
    both = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0) & (both > 0), dot(x, y) / both).otherwise(0.0)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hash_hex(h: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(col(h))), 16, "0")


def hex_hash(text: Column | str) -> Column:
    return F.conv(col(text), 16, -10).cast("long")


def dhash(grey: Column | str, width: int = 9, height: int = 8) -> Column:
    """The difference hash of a row-major grey grid: a bit says that a pixel is darker than its right neighbour, first bit highest."""
    g = col(grey)
    places = F.array(*(F.lit(r * width + c) for r in range(height) for c in range(width - 1)))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR((F.get(g, i) < F.get(g, i + 1)).cast("long")))


def ring_hash(v: Column | str, size: int = 64) -> Column:
    """The difference hash of a vector taken as a ring: bit i, lowest first, says v[i] < v[i + 1]."""
    x = as_double(v)
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(x, i) < F.get(x, (i + 1) % size), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def quality_gate(grey: Column | str, least_mean: float = 20.0, least_variance: float = 100.0) -> Column:
    """Bright and varied enough; a photo without pixels passes."""
    g = as_double(grey)
    n = F.size(g)
    mean = F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(g, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
    return F.when(g.isNull() | (n <= 0), True).otherwise((mean >= least_mean) & (spread >= least_variance))


@pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian 32-bit floats as an array."""
    for s in blobs:
        yield s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@pandas_udf(T.BinaryType())
def vector_to_blob(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
