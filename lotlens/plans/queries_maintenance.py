"""Queries over changes, imports and scan events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import tables
from ..operators.lineage import settle, shared_dir
from ..sources import records
from ..streaming import progress as G
from .bindings import Tables
from .register import query

#: Old rows: all customers.  Changes: the customers that have orders, with a higher balance and no segment for every third, and suppliers as new rows.
NEW = "(SELECT c_custkey, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || '!' END AS c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 1000000000000 + s_suppkey, s_acctbal, CASE WHEN s_suppkey % 3 <> 0 THEN 'supplier' END FROM supplier)"
OLD = "(SELECT c_custkey, c_acctbal, c_mktsegment FROM customer)"


def old(t: Tables):
    return t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")


def new(t: Tables):
    segment = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_mktsegment", F.lit("!")))
    ordering = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    rows = ordering.select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), segment.alias("c_mktsegment"))
    return rows.unionByName(t.supplier.select((F.col("s_suppkey") + 1000000000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.when(F.col("s_suppkey") % 3 != 0, "supplier").alias("c_mktsegment")))


KEY = ["c_custkey"]


@query("upsert_insert_only", sql=f"SELECT *, md5(c_custkey || '|' || 'c') AS row_id FROM (SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM {OLD} UNION ALL SELECT c_custkey, round(c_acctbal, 6), c_mktsegment FROM {NEW} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer))")
def _(t):
    out = C.insert_only(old(t), new(t).unionByName(new(t)), KEY)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6)).withColumn("row_id", C.surrogate_key("c_custkey", F.lit("c")))


@query("upsert_coalesce", sql=f"SELECT c_custkey, round(coalesce(n.c_acctbal, o.c_acctbal), 6) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM {OLD} o FULL JOIN {NEW} n USING (c_custkey)")
def _(t):
    return C.upsert_coalesce(old(t), new(t), KEY).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("upsert_replace", sql=f"SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM {NEW} UNION ALL SELECT c_custkey, round(c_acctbal, 6), c_mktsegment FROM {OLD} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    twice = new(t).withColumn("at", F.lit(2)).unionByName(new(t).withColumns({"c_acctbal": F.lit(0.0), "at": F.lit(1)}))
    return C.upsert_replace(old(t), C.last_of(twice, KEY, "at").drop("at"), KEY).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("update_columns", sql=f"SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || '!' END ELSE c_mktsegment END AS c_mktsegment FROM {OLD}")
def _(t):
    return C.update_columns(old(t), new(t), KEY, ["c_mktsegment"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("delete_keys", sql=f"SELECT c_custkey, c_mktsegment FROM {OLD} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return C.delete_keys(old(t), new(t), KEY).select("c_custkey", "c_mktsegment")


@query("table_upsert", sql=f"SELECT c_custkey, round(coalesce(n.c_acctbal, o.c_acctbal), 6) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment FROM {OLD} o FULL JOIN {NEW} n USING (c_custkey)")
def _(t):
    """The changes merged into a table in place; applied twice, as after a batch that broke off."""
    path = shared_dir(t.spark)
    tables.create(old(t), path, KEY, 64)
    for _ in range(2):
        tables.apply(t.spark, path, new(t), KEY, lambda a, b: C.upsert_coalesce(a, b, KEY), 64)
    return tables.read(t.spark, path).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("table_delete", sql=f"SELECT c_custkey, c_mktsegment FROM {OLD} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    """Keys deleted from a table in place."""
    path = shared_dir(t.spark)
    tables.create(old(t), path, KEY, 64)
    tables.apply(t.spark, path, new(t).select(*KEY), KEY, lambda a, b: C.delete_keys(a, b, KEY), 64)
    return tables.read(t.spark, path).select("c_custkey", "c_mktsegment")


@query("skip_processed", "findings", sql="SELECT finding_id FROM findings WHERE confidence <> 'high'")
def _(t):
    return C.skip_processed(t.findings.select("finding_id"), t.findings.where("confidence = 'high'"), "finding_id")


@query("stale_rows", "images", sql="SELECT image_id, embed_model FROM (SELECT image_id, CASE WHEN vec_id % 5 <> 0 THEN embed_model END AS embed_model FROM images) WHERE embed_model IS NULL OR embed_model <> 'current'")
def _(t):
    rows = t.images.select("image_id", F.when(F.col("vec_id") % 5 != 0, F.col("embed_model")).alias("embed_model"))
    return C.stale(rows, "embed_model", "current")


@query("import_nested", "findings", sql="SELECT sale_id, finding_id AS image_url, description FROM findings WHERE confidence <> 'low'")
def _(t):
    """Sales with arrays of findings, of which those of low confidence were processed before."""
    nested = t.findings.groupBy("sale_id").agg(F.collect_list(F.struct(F.col("finding_id").alias("image_url"), F.col("description").alias("findings"))).alias("findings"))
    done = t.findings.where("confidence = 'low'").select(F.col("finding_id").alias("image_url"))
    return records.import_nested(nested, done)


@query("reference_records", "responses", "sales", sql="SELECT r.sale_id, s.title AS sale_title, r.finding_id AS image_url, r.response FROM responses r JOIN sales s ON r.sale_id = s.sale_id")
def _(t):
    results = t.responses.select("sale_id", F.col("finding_id").alias("image_url"), "response").withColumns({"position_index": F.lit(0), "total": F.lit(1), "has_findings": F.lit(True), "error": F.lit(None).cast("string"), "duration_s": F.lit(0.0), "backend": F.lit("b")})
    return records.reference_records(results, t.sales.select("sale_id", "title", F.lit("u").alias("url"))).select("sale_id", "sale_title", "image_url", "response")


# --- events ---------------------------------------------------------------------------------------------------------

LAST = "ls AS (SELECT sale_id, max(seq) AS start FROM scan_events WHERE type = 'sale_start' GROUP BY sale_id), ev AS (SELECT e.* FROM scan_events e JOIN ls ON e.sale_id = ls.sale_id AND e.seq >= ls.start)"
PROGRESS = "SELECT sale_id, CASE WHEN bool_or(type = 'sale_done') THEN 'done' ELSE 'analyzing' END AS status, count(*) FILTER (WHERE type = 'progress') AS n_progress, round(arg_max(value, seq), 6) AS last_value, bool_or(type = 'oracle_request') AS oracle_requested, max(seq) AS last_seq FROM ev GROUP BY sale_id"


@query("scan_progress", "scan_events", sql=f"WITH {LAST} {PROGRESS}")
def _(t):
    return G.scan_progress(t.scan_events).withColumn("last_value", F.round("last_value", 6))


@query("scan_totals", "scan_events", sql="SELECT count(*) FILTER (WHERE type = 'sale_done') AS n_done, count(*) FILTER (WHERE type = 'sale_skip') AS n_skipped, count(*) FILTER (WHERE type = 'progress') AS n_progress, round(coalesce(sum(value) FILTER (WHERE type = 'sale_done'), 0), 4) AS total_value FROM scan_events")
def _(t):
    return G.scan_totals(t.scan_events).withColumn("total_value", F.round("total_value", 4))


@query("scan_status", "scan_events", sql=f"WITH {LAST}, p AS ({PROGRESS}) SELECT (SELECT arg_max(type, seq) FROM scan_events) AS last_type, (SELECT arg_max(sale_id, seq) FROM scan_events) AS last_sale, (SELECT max(seq) FROM scan_events) AS last_seq, CAST(NULL AS VARCHAR) AS message, false AS failed, count(*) FILTER (WHERE status = 'analyzing') > 0 AS running, count(*) FILTER (WHERE status = 'analyzing') AS n_open FROM p")
def _(t):
    return G.scan_status(t.scan_events)


@query("flush_completed", "scan_events", sql="WITH d AS (SELECT sale_id, max(seq) AS upto FROM scan_events WHERE type = 'sale_done' GROUP BY sale_id) SELECT e.sale_id, max(upto) AS upto, count(*) AS n_events FROM scan_events e JOIN d ON e.sale_id = d.sale_id WHERE seq <= upto GROUP BY e.sale_id")
def _(t):
    return G.flush_completed(t.scan_events)


def arrive(batches, path: str, start) -> None:
    """Each of ``batches`` is written to ``path`` and taken by the stream that ``start`` starts before the next is written.

    So each is one micro-batch, of as many files as tasks write it, and they arrive in this order whatever the times of their files.
    """
    for rows in batches:
        rows.write.mode("append").json(path)
        start().awaitTermination()


def dealt(rows, n: int, *by: str) -> list:
    """The rows in ``n`` parts by a hash of columns."""
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(n)) == b) for b in range(n)]


@query("event_log_read", "scan_events", sql="SELECT seq, sale_id, type, value FROM scan_events WHERE seq >= 100")
def _(t):
    """The events written as a log of JSON lines and read in two steps, of which the second begins where the first ended."""
    path = shared_dir(t.spark)
    t.scan_events.where("seq % 3 = 0").write.json(path)
    first = settle(records.log_offsets(t.spark, path))
    t.scan_events.where("seq % 3 <> 0").write.mode("append").json(path)
    second = settle(records.log_offsets(t.spark, path))
    parts = records.read_log(t.spark, path, first), records.read_log(t.spark, path, second, first)
    return parts[0].unionByName(parts[1]).where("seq >= 100").select("seq", "sale_id", "type", "value")


@query("event_log_append", "scan_events", sql="SELECT seq, sale_id, type, value FROM scan_events")
def _(t):
    """The events streamed from one log into another."""
    path = shared_dir(t.spark)
    t.scan_events.write.json(f"{path}/in")
    G.append_events(G.read_stream(t.spark, f"{path}/in"), f"{path}/out", f"{path}/cp").awaitTermination()
    return records.read_events(t.spark, f"{path}/out").select("seq", "sale_id", "type", "value")


@query("scan_progress_stream", "scan_events", sql=f"WITH {LAST} {PROGRESS}")
def _(t):
    """scan_progress kept up by a stream over six micro-batches of events in any order."""
    path = shared_dir(t.spark)
    arrive(dealt(t.scan_events, 6, "seq"), f"{path}/in", lambda: G.fold_stream(G.read_stream(t.spark, f"{path}/in"), f"{path}/state", f"{path}/cp"))
    return G.latest_state(t.spark, f"{path}/state").withColumn("last_value", F.round("last_value", 6))


@query("scan_status_stream", "scan_events", sql="SELECT arg_max(type, seq) AS last_type, arg_max(sale_id, seq) AS last_sale, max(seq) AS last_seq, arg_max('at ' || seq, CASE WHEN seq % 7 = 0 THEN seq END) AS message, false AS failed FROM scan_events")
def _(t):
    """The last event and message, kept up over micro-batches in any order."""
    path = shared_dir(t.spark)
    rows = t.scan_events.withColumn("message", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("at "), "seq")))
    arrive(dealt(rows, 4, "seq"), f"{path}/in", lambda: G.status_stream(G.read_stream(t.spark, f"{path}/in"), f"{path}/state", f"{path}/cp"))
    return G.latest_state(t.spark, f"{path}/state", "run").drop("run")


@query("skip_processed_stream", "findings", sql="SELECT DISTINCT finding_id AS image_url FROM findings")
def _(t):
    """Photos that arrive twice, in several micro-batches, are taken once."""
    path = shared_dir(t.spark)
    urls = settle(t.findings.select(F.col("finding_id").alias("image_url")))
    a, b, c = dealt(urls, 3, "image_url")
    batches = [a.unionByName(a).unionByName(b), b.unionByName(c), c]
    arrive(batches, f"{path}/in", lambda: G.ingest_new(G.read_stream(t.spark, f"{path}/in", "image_url string"), f"{path}/out", f"{path}/cp"))
    return t.spark.read.parquet(f"{path}/out").select("image_url")


FLUSHED = """
WITH m AS (SELECT *, first_value(CASE WHEN type IN ('sale_start', 'sale_done') THEN type END IGNORE NULLS) OVER (PARTITION BY sale_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM scan_events)
SELECT type AS kind, seq, sale_id FROM m WHERE type IN ('progress', 'oracle_request') AND next = 'sale_done'"""


@query("flush_stream", "scan_events", sql=FLUSHED)
def _(t):
    """Photos (here: progress) and findings (here: requests) are buffered by sale over four micro-batches and written when it is done."""
    path = shared_dir(t.spark)
    rows = t.scan_events.select("seq", "sale_id", F.col("type").alias("kind"), F.col("value").cast("string").alias("payload"))
    # in order of seq, so that starts and ends arrive in their order
    cuts = t.scan_events.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01)
    part = sum((F.coalesce((F.col("seq") > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    stream = lambda: G.read_stream(t.spark, f"{path}/in", "seq long, sale_id string, kind string, payload string")
    arrive([rows.where(part == k) for k in range(4)], f"{path}/in", lambda: G.flush_stream(stream(), f"{path}/out", f"{path}/cp", "progress", "oracle_request"))
    out = t.spark.read.parquet(f"{path}/out/images").unionByName(t.spark.read.parquet(f"{path}/out/findings"))
    return out.select("kind", "seq", "sale_id")


@query("boilerplate_stream", sql="SELECT sha1(text) AS phash, count(DISTINCT source) AS n_sales FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def _(t):
    """Fingerprints in several sources, kept up over micro-batches in which every fifth document comes and goes again."""
    path = shared_dir(t.spark)
    rows = t.documents.select(F.sha1("text").alias("phash"), F.col("source").alias("sale_id"), F.col("doc_id"))
    came = dealt(rows.withColumn("change", F.lit(1)), 3, "doc_id")
    gone = dealt(rows.where("doc_id % 5 = 0").withColumn("change", F.lit(-1)), 3, "doc_id")
    batches = [came[0], came[1].unionByName(gone[0]), came[2].unionByName(gone[1]), gone[2]]
    stream = lambda: G.read_stream(t.spark, f"{path}/in", "phash string, sale_id string, change int")
    arrive([b.drop("doc_id") for b in batches], f"{path}/in", lambda: G.boilerplate_stream(stream(), f"{path}/out", f"{path}/cp"))
    return G.boilerplate_prints(t.spark, f"{path}/out", 2)
