"""The place for a user's model: functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def infer_batches(df: DataFrame, fn: Callable[[pd.Series], list], column: str, model: str, dim: int | None = None, batch_size: int = 16) -> DataFrame:
    """Adds embedding, embed_model, embed_dim, error: ``fn`` maps a batch of values to vectors, one each, in order.

    A batch that fails gives nulls and its error; a vector of another size than ``dim`` is refused.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_model", T.StringType()), T.StructField("embed_dim", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            vectors, errors = [], []
            for at in range(0, len(pdf), batch_size):
                part = pdf[column].iloc[at : at + batch_size]
                try:
                    got = list(fn(part))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} rows")
                    bad = [v is not None and dim is not None and len(v) != dim for v in got]
                    vectors += [None if b else v for v, b in zip(got, bad)]
                    errors += [f"vector is not of size {dim}" if b else None for b in bad]
                except Exception as e:  # a user's model may fail in any way; the rows stay
                    vectors += [None] * len(part)
                    errors += [str(e)] * len(part)
            sizes = pd.array([None if v is None else len(v) for v in vectors], "Int32")
            yield pdf.assign(embedding=vectors, embed_model=[None if v is None else model for v in vectors], embed_dim=sizes, error=errors)

    return df.mapInPandas(run, schema)


def annotate_responses(df: DataFrame, fn: Callable[[pd.Series], list[str]], column: str, model: str, prompt_version: str) -> DataFrame:
    """Adds response, vlm_model, prompt_version: a model's text for each row; a batch that fails gives nulls."""
    schema = T.StructType([*df.schema.fields, T.StructField("response", T.StringType()), T.StructField("vlm_model", T.StringType()), T.StructField("prompt_version", T.StringType())])

    def run(batches):
        for pdf in batches:
            try:
                said = list(fn(pdf[column]))
            except Exception:
                said = [None] * len(pdf)
            yield pdf.assign(response=said, vlm_model=model, prompt_version=prompt_version)

    return df.mapInPandas(run, schema)


def align_embeddings(payloads: DataFrame, dim: int | None = None) -> DataFrame:
    """request_id, slot, vector: answers (request_id, count, data array<struct<index, embedding>>) put in the order asked.

    An item without an index takes its place in the answer; out of range or of the wrong size it goes; the last of one slot counts;
    slots without an answer are null.
    """
    want = payloads.select("request_id", F.explode(F.when(F.col("count") > 0, F.sequence(F.lit(0), F.col("count") - 1))).alias("slot"))
    got = payloads.select("request_id", "count", F.posexplode("data").alias("i", "d"))
    got = got.select("request_id", "count", "i", F.coalesce(F.col("d.index"), F.col("i")).alias("slot"), F.col("d.embedding").alias("vector"))
    got = got.where("vector IS NOT NULL AND slot >= 0 AND slot < count")
    got = got.where(F.size("vector") == dim) if dim is not None else got
    got = got.groupBy("request_id", "slot").agg(F.max_by("vector", "i").alias("vector"))
    return want.join(got, ["request_id", "slot"], "left")
