"""The corpus pipeline: documents in, packed sequences out.

Each stage works on what its predecessor kept and, but for the last, returns the columns of ``documents``.

Defined cases, in every stage: a null text counts as an empty one and stays null; whole texts of any length are read; rows that repeat id
and text are treated alike; a row with a null doc_id meets the rules for its own text but is never compared with others; an empty
table gives an empty one; other columns, whatever their names, pass through.  Ties are settled by the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import decontaminate, linededup, packing, quality, simhash, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated model go; an empty or null text fails them."""
    model = quality.fit_logistic(*quality.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of two lines, or of one line of 20 words, go, and documents of nothing else with them.

    The first copy is that of the least doc_id; ``n_chars`` follows the text; a text without lines stays."""
    return linededup.keep_first_copies(docs, min_words=20)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts (five-word shingles, similarity 0.8 or more) stays: that of the least doc_id.

    Of rows that repeat id and text one stays; texts without words stay."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; with an empty benchmark none do."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack(packing.cut_documents(docs, tokens.vocabulary()))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]
#: The first stage learns its rule from labels, which SQL cannot express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
