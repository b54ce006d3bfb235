"""Scan events: folds that are the same in batch and in Structured Streaming.

An event has seq, sale_id, type (sale_start, progress, oracle_request, sale_done, sale_skip, run_failed) and value.  The state of a sale follows from
its events since the last start, in whatever order they arrive; a stream writes the records that a micro-batch has changed under the batch's
number, so that a batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.changes import skip_processed
from ..sources.records import EVENT
from .stateful import ProgressFold, SaleBuffer, SalesOfFingerprint, rocksdb, run_stateful


def scan_progress(events: DataFrame) -> DataFrame:
    """sale_id, status, n_progress, last_value, oracle_requested, last_seq since each sale's last start; sales without a start have none."""
    start = events.where("type = 'sale_start'").groupBy("sale_id").agg(F.max("seq").alias("_start"))
    e = events.join(start, "sale_id").where("seq >= _start")
    last = lambda value, test: F.max_by(F.when(test, value), F.when(test, F.col("seq")))
    end = F.col("type").isin("sale_done", "sale_skip")
    state = F.when(F.col("type") == "sale_done", "done").when(F.col("type") == "sale_skip", "skipped")
    return e.groupBy("sale_id").agg(
        F.coalesce(last(state, end), F.lit("analyzing")).alias("status"), F.count_if(F.col("type") == "progress").alias("n_progress"),
        F.max_by("value", "seq").alias("last_value"), F.bool_or(F.col("type") == "oracle_request").alias("oracle_requested"), F.max("seq").alias("last_seq"),
    )


def scan_totals(events: DataFrame) -> DataFrame:
    """Counts of finished and skipped sales and of progress, and the sum of the values at the end of sales."""
    return events.agg(
        F.count_if(F.col("type") == "sale_done").alias("n_done"), F.count_if(F.col("type") == "sale_skip").alias("n_skipped"), F.count_if(F.col("type") == "progress").alias("n_progress"),
        F.round(F.coalesce(F.sum(F.when(F.col("type") == "sale_done", F.col("value"))), F.lit(0.0)), 6).alias("total_value"),
    )


def scan_status(events: DataFrame) -> DataFrame:
    """One row: the last event's type, sale and number, whether the run has failed and its last message, and whether a sale is still open.

    A run has failed if its last event says so; a failed run is not running.  The message is that of the last event that has one.
    """
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("string")
    last = events.agg(F.max_by("type", "seq").alias("last_type"), F.max_by("sale_id", "seq").alias("last_sale"), F.max("seq").alias("last_seq"), F.max_by(message, F.when(message.isNotNull(), F.col("seq"))).alias("message"))
    open_ = scan_progress(events).agg(F.count_if(F.col("status") == "analyzing").alias("n_open"))
    failed = F.coalesce(F.col("last_type") == "run_failed", F.lit(False))
    return last.crossJoin(F.broadcast(open_)).select("last_type", "last_sale", "last_seq", "message", failed.alias("failed"), ((F.col("n_open") > 0) & ~failed).alias("running"), "n_open")  # one row each


def status_stream(stream: DataFrame, out_path: str, checkpoint: str):
    """The first columns of ``scan_status`` kept up by a streaming aggregation: one row of state, written anew by each micro-batch."""
    message = F.when(F.col("message").isNotNull(), F.col("seq"))
    last = stream.groupBy(F.lit("run").alias("run")).agg(F.max_by("type", "seq").alias("last_type"), F.max_by("sale_id", "seq").alias("last_sale"), F.max("seq").alias("last_seq"), F.max_by("message", message).alias("message"))
    last = last.withColumn("failed", F.coalesce(F.col("last_type") == "run_failed", F.lit(False)))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return last.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_completed(events: DataFrame) -> DataFrame:
    """sale_id, upto, n_events: the events of each sale up to its last end, which are complete and can be written."""
    end = events.where(F.col("type").isin("sale_done", "sale_skip")).groupBy("sale_id").agg(F.max("seq").alias("upto"))
    return events.join(end, "sale_id").where("seq <= upto").groupBy("sale_id").agg(F.max("upto").alias("upto"), F.count("*").alias("n_events"))


def read_stream(spark: SparkSession, path: str, schema: str = EVENT, files: int | None = None) -> DataFrame:
    """New event files as a stream, at most ``files`` of them in a micro-batch; a file is seen whole or not at all.

    No file is passed over for its age (Spark's default: seven days before the newest file seen), so clocks may differ or be set back.
    """
    reader = spark.readStream.schema(schema).option("maxFileAge", "36500d")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """A stream appended to an event log."""
    return events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_stream(stream: DataFrame, out_path: str, checkpoint: str):
    """scan_progress kept up by a stream whose events may arrive in any order; changed records go to ``out_path``/batch=<n>."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return run_stateful(stream, "sale_id", ProgressFold(), write, checkpoint)


def latest_state(spark: SparkSession, out_path: str, key: str = "sale_id") -> DataFrame:
    """The records that a stream of updates has left under ``out_path``/batch=<n>: of each key the last one."""
    rows = spark.read.parquet(out_path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), "batch").alias("s"))
    return last.select(key, "s.*")


def compact_state(spark: SparkSession, out_path: str, target: str, key: str = "sale_id") -> DataFrame:
    """The last record of each key written to ``target`` under the greatest batch's number; a stream may go on writing there."""
    top = spark.read.parquet(out_path).agg(F.max("batch")).first()[0]
    latest_state(spark, out_path, key).write.mode("overwrite").parquet(f"{target}/batch={top}")
    return spark.read.parquet(target)


def new_only(batch: DataFrame, done: DataFrame, key: str = "image_url") -> DataFrame:
    """The rows of a batch that no earlier run has processed, one per key."""
    w = Window.partitionBy(key).orderBy(*sorted(batch.columns))
    first = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return skip_processed(first, done, key)


def ingest_new(stream: DataFrame, path: str, checkpoint: str, key: str = "image_url"):
    """A stream of photos of which each key is taken once over all runs; micro-batch n goes to ``path``/batch=<n>.

    The keys that have been taken are state of the stream: what was written before is not read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocksdb(stream.sparkSession):
        return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_stream(events: DataFrame, path: str, checkpoint: str, images: str = "analyzed_image", findings: str = "finding"):
    """Events (sale_id, seq, kind, payload) of which a sale's photos and then its findings are written when the sale is done.

    Until then they are held in the stream's state.  Micro-batch n goes to ``path``/images and then to ``path``/findings under batch=<n>: a run
    that breaks between the two is repeated as a whole, gets the same rows from the same state, and overwrites what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, kind in (("images", images), ("findings", findings)):
                batch.where(F.col("kind") == kind).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return run_stateful(events.select("sale_id", "kind", "seq", "payload"), "sale_id", SaleBuffer(), write, checkpoint)


def boilerplate_stream(photos: DataFrame, path: str, checkpoint: str):
    """Photos (phash, sale_id, change: 1 when one comes, -1 when it goes); the number of sales of each fingerprint that has changed goes to ``path``/batch=<n>."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_stateful(photos.where("phash IS NOT NULL").select("phash", "sale_id", "change"), "phash", SalesOfFingerprint(), write, checkpoint)


def boilerplate_prints(spark: SparkSession, path: str, least: int = R.BOILERPLATE_SALES) -> DataFrame:
    """The fingerprints that a ``boilerplate_stream`` has found in ``least`` sales or more, as of its last micro-batch."""
    return latest_state(spark, path, "phash").where(F.col("n_sales") >= least).select("phash", "n_sales")
