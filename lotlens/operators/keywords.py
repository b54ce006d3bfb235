"""Which of very many keywords occur in each text: one automaton for all of them, one pass over a text however many there are."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of (word, owner) that are sent to all tasks at once.
SEND = 200_000
#: Rows of a batch of findings.
ROWS = 50_000


def _shape(rows: DataFrame, text: str, owners: DataFrame, word: str) -> T.StructType:
    return T.StructType([f for f in rows.schema if f.name != text] + [f for f in owners.schema if f.name != word])


def _numbered(block: pa.Table, word: str) -> tuple[pa.RecordBatch, dict[str, tuple[int, ...]]]:
    """(the distinct owners, word -> numbers of its owners)."""
    names = [c for c in block.column_names if c != word]
    numbers: dict[tuple, int] = {}
    of: dict[str, set[int]] = {}
    first = []
    for i, (w, *owner) in enumerate(zip(block.column(word).to_pylist(), *(block.column(c).to_pylist() for c in names), strict=True)):
        n = numbers.setdefault(tuple(owner), len(numbers))
        if n == len(first):
            first.append(i)
        of.setdefault(w, set()).add(n)
    kept = block.select(names).take(pa.array(first, pa.int64())).combine_chunks()
    return kept.to_batches()[0], {w: tuple(sorted(ns)) for w, ns in of.items()}


def _find(rows: DataFrame, text: str, block: DataFrame, word: str) -> DataFrame:
    table = block.toArrow()
    shape = _shape(rows, text, block, word)
    if not len(table):
        return rows.sparkSession.createDataFrame([], shape)
    owners, of = _numbered(table, word)
    at, names = rows.columns.index(text), shape.names

    def run(batches):
        automaton = ahocorasick.Automaton()
        for w, numbers in of.items():
            automaton.add_word(w, numbers)
        automaton.make_automaton()

        def batch_of(batch, places, numbers):
            kept = [c.take(pa.array(places, pa.int32())) for k, c in enumerate(batch.columns) if k != at]
            return pa.RecordBatch.from_arrays([*kept, *(c.take(pa.array(numbers, pa.int32())) for c in owners.columns)], names)

        for batch in batches:
            places, numbers = [], []
            for i, t in enumerate(batch.column(at).to_pylist()):
                if not t:
                    continue
                hit = set()
                for _, of_word in automaton.iter(t):
                    hit.update(of_word)
                places += [i] * len(hit)
                numbers += sorted(hit)
                if len(places) > ROWS:
                    yield batch_of(batch, places, numbers)
                    places, numbers = [], []
            if places:
                yield batch_of(batch, places, numbers)

    return rows.mapInArrow(run, shape)


def found_in(rows: DataFrame, text: str, owners: DataFrame, word: str, most: int = SEND) -> DataFrame:
    """Every row, without ``text``, with each owner of which a word occurs in its text; an owner counts once however many of its words do.

    ``owners``: the word and, in all other columns, who wants it.  They are counted first; of more than ``most`` rows each pass over the texts takes a
    part, all words of one owner in the same.  Words and texts are compared as they are; a null or empty word or text has no part in it.
    """
    owners = owners.where(F.col(word) != "")
    blocks = max(1, -(-owners.count() // most))
    names = [c for c in owners.columns if c != word]
    out = None
    for b in range(blocks):
        block = owners if blocks == 1 else owners.where(F.pmod(F.xxhash64(*names), F.lit(blocks)) == b)
        part = _find(rows, text, block, word)
        out = part if out is None else out.unionByName(part)
    return out
