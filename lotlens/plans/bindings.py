"""The tables of a data folder in the roles that the operators need.

One SQL text serves both engines: Spark fills the braces with DataFrames, the oracle with table names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import kept_by

AS_OF = "DATE '2001-01-01'"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SALES = """
SELECT CAST(o.o_orderkey AS STRING) AS sale_id,
       concat('(', CAST(o.o_orderkey % 90 AS STRING), ') ', o.o_orderpriority, ' sale ', c.c_name) AS title,
       CAST(o.o_orderdate AS DATE) AS start_date,
       CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 5 AS INT) AS end_date,
       c.c_name AS address, n.n_name AS city, r.r_name AS state,
       CAST(25.0 + n.n_nationkey * 0.7 + (o.o_orderkey % 17) * 0.05 AS DOUBLE) AS lat,
       CAST(-95.0 + n.n_nationkey * 0.9 + (o.o_orderkey % 13) * 0.05 AS DOUBLE) AS lon,
       CAST((o.o_orderkey * 7919) % 1000 AS DOUBLE) / 10 AS distance_miles,
       o.o_orderdate AS scraped_at, o.o_orderstatus AS order_status, o.o_custkey AS customer
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

FINDINGS = """
SELECT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING),
                 CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING)) AS finding_id,
       CAST(l.l_orderkey AS STRING) AS sale_id, CAST(l.l_suppkey AS STRING) AS source_id, l.l_partkey AS part_id,
       concat(CASE WHEN p.p_name LIKE 'old %' THEN 'antique' WHEN p.p_name LIKE 'small %' THEN '1950s'
                   WHEN p.p_name LIKE 'hot %' THEN 'Art Deco' WHEN p.p_name LIKE 'cold %' THEN 'circa 1920'
                   WHEN p.p_name LIKE 'new %' THEN 'mid-century' WHEN p.p_name LIKE 'large %' THEN 'vintage'
                   WHEN p.p_name LIKE 'red %' THEN 'red' ELSE 'blue' END, ' ',
              CASE WHEN p.p_name LIKE '% widget' THEN 'velvet painting' WHEN p.p_name LIKE '% gear' THEN 'Pioneer turntable'
                   WHEN p.p_name LIKE '% plate' THEN 'sterling silver plate' WHEN p.p_name LIKE '% bolt' THEN 'walnut credenza'
                   WHEN p.p_name LIKE '% ring' THEN 'gold pocket watch' WHEN p.p_name LIKE '% rod' THEN 'brass floor lamp'
                   WHEN p.p_name LIKE '% gizmo' THEN 'Atari 2600 console' ELSE 'Stickley sofa' END,
              ', ', lower(p.p_type), ' ', p.p_brand, CASE WHEN p.p_size > 25 THEN ', good condition' ELSE '' END) AS description,
       CASE l.l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey"""

RESPONSES = """
SELECT f.finding_id, f.sale_id, f.source_id, f.part_id,
       CASE WHEN f.part_id % 7 < 3 THEN 'NOTHING'
            WHEN f.part_id % 7 = 3 THEN concat('TOYS: NONE', chr(10), 'SILVER: 0')
            WHEN f.part_id % 7 = 4 THEN concat('TOYS: NONE', chr(10), f.description, ' [', f.confidence, ']')
            WHEN f.part_id % 7 = 5 THEN concat('The image shows ', f.description)
            ELSE concat(f.description, ' [', f.confidence, ']', chr(10), 'vintage 1950s ', f.description, ' [low]') END AS response
FROM {findings} f"""

#: A photo for each finding; its vector is one of the table's, by the part.
IMAGES = """
SELECT f.finding_id AS image_id, f.sale_id, f.source_id, e.vec_id, e.embedding, CASE WHEN e.label = 9 THEN 'stale' ELSE 'current' END AS embed_model
FROM (SELECT f.*, f.part_id % k.n AS vec FROM {findings} f CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) k) f JOIN {embeddings} e ON f.vec = e.vec_id"""

#: Three saved hunts for every thousandth customer.
HUNTS = """
SELECT concat('u', CAST(c.c_custkey AS STRING)) AS owner, c.c_custkey * 10 + h.k AS hunt_id, h.name, h.keywords FROM {customer} c
CROSS JOIN (SELECT * FROM (VALUES (1, 'watches', array('watch')), (2, 'home', array('turntable', 'CREDENZA')), (3, 'home', array('lamp'))) AS t(k, name, keywords)) h
WHERE c.c_custkey % 1000 = 1"""

#: Searches: a text and a vector for every hundredth vector.
QUERIES = """
SELECT e.vec_id AS query_id, CASE CAST(floor(e.vec_id / 100) AS INT) % 6 WHEN 0 THEN 'couch' WHEN 1 THEN 'Record player' WHEN 2 THEN 'pocket watch'
       WHEN 3 THEN 'urgent sale' WHEN 4 THEN 'nothing at all' ELSE 'toy' END AS query, e.embedding
FROM {embeddings} e WHERE e.vec_id % 100 = 0"""

#: The click stream as scan events: a user is a sale, and seq is the order of time.
EVENTS = """
SELECT event_id AS seq, CAST(user_id AS STRING) AS sale_id,
       CASE event_type WHEN 'signup' THEN 'sale_start' WHEN 'purchase' THEN 'sale_done' WHEN 'error' THEN 'oracle_request' ELSE 'progress' END AS type, value
FROM {events}"""

#: Documents judged by a length rule, in two runs; the label is what was expected.
RESULTS = """
SELECT m.run, d.doc_id, d.source, CASE d.doc_id % 4 WHEN 0 THEN 'seating' WHEN 1 THEN 'electronics' WHEN 2 THEN 'art' ELSE 'kitsch' END AS category,
       CASE WHEN d.n_chars > m.least THEN d.text ELSE 'NOTHING' END AS raw, array('the', 'eau') AS expected_keywords, l.quality = 0 AS expect_nothing,
       CASE WHEN d.doc_id % 11 = 0 THEN 'timeout' END AS error, d.n_chars / 1000.0 AS duration_ms
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id CROSS JOIN (SELECT * FROM (VALUES ('long', 1000), ('short', 200)) AS t(run, least)) m"""

#: Two backends over the labelled documents.
RECORDS = """
SELECT d.doc_id AS seq, CAST(d.doc_id AS STRING) AS image_url, l.quality = 1 AS base_hit, l.toxic = 0 AS cand_hit, d.n_chars / 1000.0 AS duration_s
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

SQL = {"sales": SALES, "findings": FINDINGS, "responses": RESPONSES, "images": IMAGES, "hunts": HUNTS, "queries": QUERIES, "scan_events": EVENTS, "results": RESULTS, "records": RECORDS}


class Tables:
    """Tables and roles of one data folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SQL:
                import string

                parts = [p for _, p, _, _ in string.Formatter().parse(SQL[name]) if p]
                self.made[name] = self.spark.sql(SQL[name], **{p: getattr(self, p) for p in set(parts)})
            elif name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]

    def within(self, sales: DataFrame) -> Tables:
        """The same tables with those line items only, and so findings and photos, that belong to ``sales``; the others go before anything is joined."""
        some = Tables(self.spark, self.sf_dir)
        some.made = {name: df for name, df in self.made.items() if name in TABLES}
        some.made["lineitem"] = kept_by(self.lineitem, F.col("l_orderkey").cast("string"), sales.select("sale_id"))
        return some


def oracle(body: str, *roles: str) -> str:
    """DuckDB SQL: the roles (and those they build on) as named queries before ``body``."""
    order: list[str] = []

    def need(role: str) -> None:
        for other in SQL:
            if "{" + other + "}" in SQL[role]:
                need(other)
        if role not in order:
            order.append(role)

    for r in roles:
        need(r)
    names = {t: t for t in (*TABLES, *SQL)}
    heads = [f"{r} AS ({SQL[r].format(**names)})" for r in order]
    heads = [h.replace("array(", "list_value(") for h in heads]
    if not heads:
        return body
    body = body.strip()
    return "WITH " + ",\n".join(heads) + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


Query = Callable[[SparkSession, str], DataFrame]
