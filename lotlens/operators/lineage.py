"""Cuts of the lineage: tables written in the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.lotlens.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share.

    That is ``spark.checkpoint.dir``, or else the library's own setting ``spark.lotlens.shared.dir``.  Where neither is set, a session on one
    machine (master local, as in tests) gets a temporary folder; on a cluster that is an error, since executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set spark.checkpoint.dir or {SHARED} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lotlens-")
        spark.conf.set(SHARED, base)
    return f"{base.rstrip('/')}/lotlens-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what ``settle`` wrote for ``df``; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
