"""Queries over photos: hashes, boilerplate, sampling, budget, emission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import photos as P
from . import fragments as S
from .bindings import Tables
from .register import query

RING = "list_sum(list_transform(range(0, 64), lambda i: CASE WHEN CAST(embedding[i + 1] AS DOUBLE) < CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) THEN CAST(power(CAST(2 AS HUGEINT), i) AS HUGEINT) ELSE 0 END))"
HASH = f"(SELECT vec_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS phash FROM (SELECT vec_id, CAST({RING.replace('CAST(power(CAST(2 AS HUGEINT), i) AS HUGEINT)', '(CAST(1 AS HUGEINT) << CAST(i AS INT))')} AS HUGEINT) AS u FROM embeddings))"
PHOTOS = f"ph AS (SELECT i.image_id, i.sale_id, i.source_id, h.phash, row_number() OVER (PARTITION BY i.source_id ORDER BY i.image_id) - 1 AS position, count(*) OVER (PARTITION BY i.source_id) AS total FROM images i JOIN {HASH} h ON i.vec_id = h.vec_id)"


def hashes(t: Tables):
    return t.embeddings.select("vec_id", N.ring_hash("embedding").alias("phash"))


def photos(t: Tables):
    rows = t.images.select("image_id", "sale_id", "source_id", "vec_id").join(hashes(t), "vec_id")
    return P.positions(rows, "source_id", "image_id")


def answers(t: Tables):
    return P.positions(t.responses, "source_id", "finding_id")


@query("hamming", sql=f"WITH h AS {HASH} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS bits FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def _(t):
    h = hashes(t)
    a, b = h.select(F.col("vec_id").alias("a"), F.col("phash").alias("x")), h.select(F.col("vec_id").alias("b"), F.col("phash").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", N.hamming("x", "y").alias("bits"))


@query("dhash", sql="WITH g AS (SELECT vec_id, list_transform(range(0, 72), lambda i: CAST(floor(CAST(embedding[i % 64 + 1] AS DOUBLE) * 1000) AS BIGINT)) AS g FROM embeddings), b AS (SELECT vec_id, list_transform(range(0, 64), lambda k: CASE WHEN g[(k // 8) * 9 + k % 8 + 1] < g[(k // 8) * 9 + k % 8 + 2] THEN '1' ELSE '0' END) AS b FROM g) SELECT vec_id, array_to_string(b, '') AS bits FROM b")
def _(t):
    """A 9 x 8 grey grid from each vector."""
    grey = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.get(N.as_double("embedding"), i % 64) * 1000))
    rows = t.embeddings.select("vec_id", grey.alias("g"))
    return rows.select("vec_id", F.lpad(F.bin(N.dhash("g")), 64, "0").alias("bits"))


@query("quality_gate", sql="SELECT vec_id, m >= 20 AND v >= 100 AS passes FROM (SELECT vec_id, list_avg(g) AS m, list_avg(list_transform(g, lambda x: (x - list_avg(g)) * (x - list_avg(g)))) AS v FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(abs(x) * 200 + label * 2)) AS g FROM embeddings))")
def _(t):
    grey = F.transform(N.as_double("embedding"), lambda x: F.floor(F.abs(x) * 200 + F.col("label") * 2))
    return t.embeddings.select("vec_id", N.quality_gate(grey).alias("passes"))


PAIRS = "SELECT a.source_id, a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM hv a JOIN hv b ON a.source_id = b.source_id AND a.vec_id < b.vec_id WHERE bit_count(xor(a.phash, b.phash)) <= 20"
GROUPED = f"hv AS (SELECT DISTINCT i.source_id, i.vec_id, h.phash FROM images i JOIN {HASH} h ON i.vec_id = h.vec_id)"


@query("near_dup_pairs", "images", sql=f"WITH {GROUPED} {PAIRS}")
def _(t):
    """Pairs of different vectors of one source; a source's repeats of one vector are one."""
    rows = t.images.select("source_id", "vec_id").distinct().join(hashes(t), "vec_id")
    return P.near_pairs(rows, 20, "source_id", "vec_id")


@query("near_dup_collapse", "images", sql=f"""
WITH {PHOTOS}, f AS (SELECT *, row_number() OVER (PARTITION BY source_id, phash ORDER BY position, image_id) AS nth FROM ph),
k AS (SELECT source_id, list_reduce(list([phash] ORDER BY position, image_id), lambda a, b: CASE WHEN len(list_filter(a, lambda s: bit_count(xor(s, b[1])) <= 20)) > 0 THEN a ELSE list_concat(a, b) END) AS kept FROM f WHERE nth = 1 GROUP BY source_id)
SELECT image_id, source_id, position, nth = 1 AND list_contains(kept, phash) AS kept FROM f JOIN k USING (source_id)""")
def _(t):
    return P.collapse(photos(t).select("image_id", "source_id", "phash", "position"), 20, "source_id").select("image_id", "source_id", "position", "kept")


@query("boilerplate_flags", sql="SELECT doc_id, coalesce(n >= 2, false) AS is_boilerplate FROM documents d LEFT JOIN (SELECT sha1(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1) g ON sha1(d.text) = g.h")
def _(t):
    rows = t.documents.select("doc_id", F.sha1("text").alias("phash"), F.col("source").alias("sale_id"))
    return P.boilerplate(rows, least=2).select("doc_id", "is_boilerplate")


@query("pending_embeddings", "images", sql="SELECT image_id FROM (SELECT image_id, vec_id FROM images WHERE embed_model = 'stale' AND vec_id % 4 <> 0 AND vec_id NOT IN (SELECT vec_id FROM images GROUP BY vec_id HAVING count(DISTINCT source_id) >= 70)) ORDER BY image_id LIMIT 10000")
def _(t):
    """Photos of the old model need new vectors; those without thumbnail and boilerplate are left out."""
    rows = t.images.select("image_id", "source_id", "vec_id", F.when(F.col("embed_model") == "current", F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 4 != 0, F.lit("x")).alias("thumbnail_path"))
    return P.pending_embeddings(P.boilerplate(rows, "vec_id", "source_id", 70)).select("image_id")


ANSWERS = "an AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY finding_id) - 1 AS position, count(*) OVER (PARTITION BY source_id) AS total FROM responses)"


@query("position_pct", "responses", sql=f"WITH {ANSWERS} SELECT finding_id, source_id, position, round(position / greatest(total - 1, 1), 6) AS position_pct FROM an")
def _(t):
    return answers(t).select("finding_id", "source_id", F.col("position").cast("long").alias("position"), F.round("position_pct", 6).alias("position_pct"))


SEGMENT = "greatest(1, ceil(total * 0.25)) AS lead_n, greatest(floor(round(total * 0.70, 9)), greatest(1, ceil(total * 0.25))) AS tail_at"
SEGMENTS = f"sg AS (SELECT *, CASE WHEN position < lead_n THEN 'lead' WHEN position >= tail_at THEN 'tail' ELSE 'middle' END AS segment FROM (SELECT *, {SEGMENT} FROM an))"


@query("lead_tail_segments", "responses", sql=f"WITH {ANSWERS}, {SEGMENTS} SELECT finding_id, source_id, segment FROM sg")
def _(t):
    return P.segments(answers(t)).select("finding_id", "source_id", "segment")


CAP = f"SELECT *, row_number() OVER (PARTITION BY source_id, lower({S.trim('response')}) ORDER BY position) AS nth FROM an"


@query("cap_repeats", "responses", sql=f"WITH {ANSWERS} SELECT finding_id, source_id FROM ({CAP}) WHERE nth <= 5")
def _(t):
    return P.cap_repeats(answers(t), "source_id").select("finding_id", "source_id")


@query("emit_findings", "responses", sql=f"WITH {ANSWERS} SELECT finding_id, source_id, {S.strip_tags('response')} AS description, {S.top_confidence('response')} AS confidence, round(position / greatest(total - 1, 1), 6) AS position_pct FROM ({CAP}) WHERE nth <= 5 AND {S.findings('response')}")
def _(t):
    return P.emit_findings(answers(t), "source_id").select("finding_id", "source_id", "description", "confidence", F.round("image_position_pct", 6).alias("position_pct"))


#: Sources whose first quarter says nothing, so that all phases occur.
MUTED = "an AS (SELECT finding_id, source_id, position, total, CASE WHEN (CAST(source_id AS INT) % 3 > 0 AND position < total * 0.3) OR (CAST(source_id AS INT) % 3 = 2) THEN 'NOTHING' ELSE response END AS response FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY finding_id) - 1 AS position, count(*) OVER (PARTITION BY source_id) AS total FROM responses))"


@query("adaptive_sampling", "responses", sql=f"""
WITH {MUTED}, {SEGMENTS}, sc AS (SELECT *, {S.response_score('response')} AS score, row_number() OVER (PARTITION BY source_id, segment ORDER BY md5('0' || source_id || ':' || finding_id), finding_id) AS nth FROM sg),
g AS (SELECT *, segment = 'tail' AND nth <= 8 AS probed, round(sum(CASE WHEN segment = 'lead' THEN score ELSE 0 END) OVER w, 6) AS lead_score, round(sum(CASE WHEN segment = 'tail' AND nth <= 8 THEN score ELSE 0 END) OVER w, 6) AS tail_score, count(*) FILTER (WHERE segment = 'lead') OVER w AS n_lead FROM sc WINDOW w AS (PARTITION BY source_id)),
p AS (SELECT *, CASE WHEN n_lead >= total OR lead_score >= 0.1 THEN 'FULL' WHEN tail_score > 0 THEN 'TAIL_PROBE' ELSE 'EARLY_STOP' END AS phase FROM g)
SELECT finding_id, source_id, phase, phase <> 'EARLY_STOP' OR segment = 'lead' OR probed AS processed FROM p""")
def _(t):
    third = F.col("source_id").cast("int") % 3
    quiet = ((third > 0) & (F.col("position") < F.col("total") * 0.3)) | (third == 2)
    rows = answers(t).withColumn("response", F.when(quiet, "NOTHING").otherwise(F.col("response")))
    return P.adaptive_sampling(rows, "source_id", "finding_id").select("finding_id", "source_id", "phase", "processed")


@query("escalation_evidence", "responses", sql=f"""
WITH an AS (SELECT finding_id, sale_id, response, row_number() OVER (PARTITION BY sale_id ORDER BY finding_id) - 1 AS position FROM responses),
sc AS (SELECT *, {S.response_score('response')} AS score, {S.findings('response')} AS found FROM an),
g AS (SELECT *, round(sum(score) OVER (PARTITION BY sale_id), 6) AS group_score FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY score DESC, position) AS evidence_rank FROM g WHERE found AND group_score >= 0.1 AND group_score < 0.6)
SELECT finding_id, sale_id, evidence_rank FROM r WHERE evidence_rank <= 6""")
def _(t):
    return P.escalation_evidence(P.positions(t.responses, "sale_id", "finding_id"), "sale_id").select("finding_id", "sale_id", "evidence_rank")


@query("budget_select", "findings", sql=f"SELECT finding_id, source_id, tier FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_id ORDER BY score DESC, finding_id) <= 4 THEN 0 ELSE 1 END AS tier FROM (SELECT finding_id, source_id, {S.score('description', 'confidence')} AS score FROM findings)) ORDER BY tier, score DESC, finding_id LIMIT 1000")
def _(t):
    rows = t.findings.select("finding_id", "source_id", X.finding_score("description", "confidence").alias("score"))
    return P.budget_select(rows, "source_id", "score", "finding_id", budget=2.0, cost=0.002).select("finding_id", "source_id", "tier")


@query("recall_at_k", "responses", sql=f"WITH {ANSWERS}, r AS (SELECT position + 1 AS rank, {S.findings('response')} AS found FROM an) SELECT k, round(coalesce(count(*) FILTER (WHERE found AND rank <= k) / nullif(CAST(count(*) FILTER (WHERE found) AS DOUBLE), 0), 0), 6) AS recall FROM r, (SELECT unnest([1, 5, 10, 50, 100, 500]) AS k) GROUP BY k")
def _(t):
    """How much of what a source's photos show lies within its first k photos."""
    rows = answers(t).select((F.col("position") + 1).alias("rank"), X.has_findings("response").alias("found"))
    return P.recall_at(rows, "rank", "found", [1, 5, 10, 50, 100, 500])
