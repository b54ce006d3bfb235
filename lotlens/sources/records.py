"""Files of findings, reference records and scan events."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NESTED = "sale_id string, title string, url string, findings array<struct<image_url string, findings string>>"
REFERENCE = "sale_id string, sale_title string, sale_url string, image_url string, position_index int, total int, response string, has_findings boolean, error string, duration_s double, backend string"
EVENT = "seq long, type string, sale_id string, value double, total int, message string"


def read_array(spark: SparkSession, path: str, schema: str = REFERENCE) -> DataFrame:
    """Files that must each be a JSON array of records; anything else fails."""
    other = spark.read.text(path, wholetext=True).where(~F.col("value").rlike(r"^[\s\uFEFF]*\["))
    if not other.isEmpty():
        raise ValueError(f"{path} must hold an array of records")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_events(spark: SparkSession, path: str, from_seq: int = 0, schema: str = EVENT) -> DataFrame:
    """Events from an offset on; lines that are no events are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("seq") >= from_seq)


def _log_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines: value, file, block, id; blocks: file, block, size, n, bytes, last, before, total) of the files of a log."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("id").alias("last"))
    w = Window.partitionBy("file")
    order = w.orderBy("block")
    blocks = blocks.withColumns({"before": F.sum("n").over(order) - F.col("n"), "total": F.sum("n").over(w), "read": F.sum("bytes").over(w), "final": F.lead("block").over(order).isNull()})
    return lines, blocks


def log_offsets(spark: SparkSession, path: str) -> DataFrame:
    """file, next_line: how many complete lines each file of a log has.  Bytes after the last line break are no line yet."""
    # every line counts one byte for its break, so a file whose last line has none is one byte short of what its lines add up to
    return _log_lines(spark, path)[1].groupBy("file").agg((F.max("total") - F.max((F.col("read") > F.col("size")).cast("long"))).alias("next_line"))


def read_log(spark: SparkSession, path: str, upto: DataFrame, seen: DataFrame | None = None, schema: str = EVENT) -> DataFrame:
    """The events of a log's complete lines from ``seen`` on and before ``upto``, both as ``log_offsets`` gave them; lines that are no events are skipped.

    A log that is appended to between two reads gives each event once.
    """
    lines, blocks = _log_lines(spark, path)
    # a row for each split of a file
    at = lines.drop("size").join(F.broadcast(blocks.select("file", "block", "before")), ["file", "block"])
    at = at.withColumn("line", F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1)
    at = at.join(F.broadcast(upto), "file").where(F.col("line") < F.col("next_line")).drop("next_line")
    if seen is not None:
        at = at.join(F.broadcast(seen), "file", "left").where(F.col("line") >= F.coalesce("next_line", F.lit(0)))
    e = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return at.select("file", "line", e.alias("e")).where("e IS NOT NULL AND e._bad IS NULL AND e.seq IS NOT NULL").select("file", "line", "e.*").drop("_bad")


def import_nested(sales: DataFrame, processed: DataFrame) -> DataFrame:
    """sale_id, image_url, description of findings whose URL has not been processed yet."""
    rows = sales.select("sale_id", F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    rows = rows.select("sale_id", F.col("f.image_url").alias("image_url"), F.col("f.findings").alias("description"))
    return rows.join(processed.select("image_url").distinct(), "image_url", "left_anti").select("sale_id", "image_url", "description")


def reference_records(results: DataFrame, sales: DataFrame) -> DataFrame:
    """One flat record per photo result, with its sale's title."""
    s = sales.select("sale_id", F.col("title").alias("sale_title"), F.col("url").alias("sale_url"))
    return results.join(s, "sale_id").select("sale_id", "sale_title", "sale_url", "image_url", "position_index", "total", "response", "has_findings", "error", "duration_s", "backend")


def write_array(records: DataFrame, path: str) -> None:
    """One JSON array in each file, as ``read_array`` wants them."""

    def bracket(batches):
        began = False
        yield pa.RecordBatch.from_pydict({"value": pa.array(["["], pa.string())})
        for batch in batches:
            if batch.num_rows:
                rows = pc.binary_join_element_wise(pa.array([","] * batch.num_rows, pa.string()), batch.column(0).cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays([rows if began else pa.concat_arrays([batch.column(0).cast(pa.string())[:1], rows[1:]])], ["value"])
                began = True
        yield pa.RecordBatch.from_pydict({"value": pa.array(["]"], pa.string())})

    rows = records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(bracket, "value string").write.mode("overwrite").text(path)
