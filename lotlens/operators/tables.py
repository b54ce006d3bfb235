"""Tables that are changed in place: rows lie in folders by a hash of their key, and a batch of changes rewrites the folders that it touches.

Every change of ``changes`` can be applied.  All of them give the same rows when they are applied twice, so a batch that broke off is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import discard, settle

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """A new table of ``rows``; ``buckets`` should be such that a folder is a file or two of usual size."""
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
    # a folder of no rows, so that a table that has lost all of them still has its columns
    rows.limit(0).write.parquet(f"{path}/{BUCKET}=-1")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def apply(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 256) -> list[int]:
    """Apply ``change(old, changes)`` to the table and return the buckets that were read and written anew.

    ``change`` must leave rows of other keys as they are.  Folders of other buckets are neither read nor written.  The new rows are complete in the
    shared folder before the first old one goes.
    """
    touched = sorted(r[0] for r in changes.select(bucket_of(keys, buckets)).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    table = spark.read.parquet(path)
    old = table.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = settle(change(old, changes).withColumn(BUCKET, bucket_of(keys, buckets)))
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    # a bucket without rows is not written, so its old rows are still there
    for b in sorted(set(touched) - {r[0] for r in new.select(BUCKET).distinct().collect()}):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    discard(new)
    spark.catalog.refreshByPath(path)
    return touched
