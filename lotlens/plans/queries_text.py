"""Queries over the text of findings and responses, items, evaluation, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import items as I
from ..functions import numbers as N
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import inference
from ..sources import pages as P
from . import fragments as S
from .register import query

# --- scalar text ----------------------------------------------------------------------------------------------------


@query("finding_tag", "findings", sql=f"SELECT finding_id, {S.tag('description')} AS tag FROM findings")
def _(t):
    return t.findings.select("finding_id", X.finding_tag("description").alias("tag"))


@query("finding_score", "findings", sql=f"SELECT finding_id, round({S.score('description', 'confidence')}, 6) AS score FROM findings")
def _(t):
    return t.findings.select("finding_id", F.round(X.finding_score("description", "confidence"), 6).alias("score"))


@query("junk_lines", "responses", sql=f"SELECT finding_id, line_no, line, {S.junk('line')} AS is_junk FROM (SELECT finding_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT finding_id, {S.lines('response')} AS ls FROM responses))")
def _(t):
    rows = t.responses.select("finding_id", F.posexplode(X.lines("response")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("long")).withColumn("is_junk", X.is_junk("line"))


@query("has_findings", "responses", sql=f"SELECT finding_id, {S.findings('response')} AS found FROM responses")
def _(t):
    return t.responses.select("finding_id", X.has_findings("response").alias("found"))


@query("top_confidence", "responses", sql=f"SELECT finding_id, {S.top_confidence('response')} AS confidence FROM responses")
def _(t):
    return t.responses.select("finding_id", X.top_confidence("response").alias("confidence"))


@query("strip_tags", "responses", sql=f"SELECT finding_id, {S.strip_tags('response')} AS description FROM responses")
def _(t):
    return t.responses.select("finding_id", X.strip_tags("response").alias("description"))


@query("response_score", "responses", sql=f"SELECT finding_id, round({S.response_score('response')}, 6) AS score FROM responses")
def _(t):
    return t.responses.select("finding_id", F.round(X.response_score("response"), 6).alias("score"))


@query("clean_response", "responses", sql=f"SELECT finding_id, {S.trim('array_to_string(list_filter(string_split(r, chr(10)), lambda x: upper(' + S.trim('x') + ') <> chr(78) || ' + S.lit('OTHING') + '), chr(10))')} AS cleaned FROM (SELECT finding_id, 'nothing' || chr(10) || response AS r FROM responses)")
def _(t):
    return t.responses.select("finding_id", X.clean_response(F.concat(F.lit("nothing\n"), "response")).alias("cleaned"))


@query("gate_decision", "responses", sql=rf"""SELECT finding_id, upper(list_extract(string_split_regex({S.trim("regexp_replace(a, '(?is)<think>.*?</think>', '', 'g')")}, '\s+'), -1)) <> 'SKIP' AS passes
FROM (SELECT finding_id, '<think>' || response || ' SKIP</think> so ' || CASE WHEN part_id % 3 = 0 THEN 'skip' ELSE 'PASS' END AS a FROM responses)""")
def _(t):
    a = F.concat(F.lit("<think>"), "response", F.lit(" SKIP</think> so "), F.when(F.col("part_id") % 3 == 0, "skip").otherwise("PASS"))
    return t.responses.select("finding_id", X.gate_passes(a).alias("passes"))


@query("verdict_parse", "findings", sql="""SELECT finding_id, CAST(part_id % 7 AS DOUBLE) AS score, part_id % 2 = 0 AS should_attend, description AS top_item FROM findings WHERE part_id % 7 BETWEEN 1 AND 5 AND part_id % 4 <> 3""")
def _(t):
    """Prose around a JSON object; a quarter of the texts have none."""
    made = F.concat(F.lit('Sure:\n```json\n{"score": '), (F.col("part_id") % 7).cast("string"), F.lit(', "topItems": ["'), "description", F.lit('"], "shouldAttend": '), (F.col("part_id") % 2 == 0).cast("string"), F.lit(', "reasoning": "r"}\n```'))
    text = F.when(F.col("part_id") % 4 == 3, "no answer").otherwise(made)
    # a filter over the generated columns stays above them, so that a text is parsed once
    rows = t.findings.select("finding_id", F.inline_outer(F.array(X.verdict(text)))).where("score IS NOT NULL")
    return rows.select("finding_id", "score", "should_attend", F.get("top_items", F.lit(0)).alias("top_item"))


@query("structured_flatten", "findings", sql="SELECT finding_id, CASE part_id % 4 WHEN 0 THEN 'NOTHING' WHEN 1 THEN description ELSE description || chr(10) || confidence END AS flat FROM findings")
def _(t):
    item = lambda c: F.concat(F.lit('{"description": " '), c, F.lit('"}'))
    both = F.concat(F.lit('{"items": ['), item(F.col("description")), F.lit(", "), item(F.col("confidence")), F.lit("]}"))
    text = F.when(F.col("part_id") % 4 == 0, F.lit('{"items": []}')).when(F.col("part_id") % 4 == 1, F.concat(F.lit(" "), "description")).otherwise(both)
    return t.findings.select("finding_id", X.structured_flatten(text).alias("flat"))


@query("keyword_parse", "findings", sql="SELECT finding_id, len(list_filter(list_transform(string_split(description || ', ,', ','), lambda x: trim(x)), lambda x: x <> '')) AS n, trim(string_split(description, ',')[1]) AS first FROM findings")
def _(t):
    k = X.keyword_list(F.concat("description", F.lit(", ,")))
    return t.findings.select("finding_id", F.size(k).cast("long").alias("n"), F.get(k, F.lit(0)).alias("first"))


@query("hash_hex", sql="SELECT p_partkey, printf('%016x', p_partkey * 7919 * 104729) AS hex, p_partkey * 7919 * 104729 AS back FROM part")
def _(t):
    h = F.col("p_partkey") * 7919 * 104729
    return t.part.select("p_partkey", N.hash_hex(h).alias("hex"), N.hex_hash(N.hash_hex(h)).alias("back"))


# --- items ----------------------------------------------------------------------------------------------------------

@query("maker_resolve", "findings", sql=f"SELECT finding_id, array_to_string({S.makers('description')}, ',') AS makers, coalesce(({S.makers('description', True)})[1], '') AS raw FROM findings")
def _(t):
    rows = t.findings.select("finding_id", I.makers("description").alias("m"))
    return rows.select("finding_id", F.array_join(F.transform("m", lambda x: x["maker"]), ",").alias("makers"), F.coalesce(F.get("m", F.lit(0))["raw"], F.lit("")).alias("raw"))


# "Atari 2600" is found by two spellings; the oracle lists distinct makers in the order of their first spelling
from .register import ORACLE  # noqa: E402

ORACLE["maker_resolve"] = ORACLE["maker_resolve"].replace("array_to_string(list_filter(", "array_to_string(list_reverse(list_distinct(list_reverse(list_filter(").replace("IS NOT NULL), ',') AS makers", "IS NOT NULL)))), ',') AS makers")


@query("item_category", "findings", sql=f"SELECT finding_id, {S.category('description')} AS category FROM findings")
def _(t):
    return t.findings.select("finding_id", I.category("description").alias("category"))


@query("item_era", "findings", sql=f"SELECT finding_id, {S.era('description')} AS era FROM findings")
def _(t):
    return t.findings.select("finding_id", I.era("description").alias("era"))


@query("item_desirability", "findings", sql=f"SELECT finding_id, {S.desirability(S.makers('description'), S.era('description'))} AS desirability FROM findings")
def _(t):
    return t.findings.select("finding_id", I.desirability(F.size(I.makers("description")), I.era("description")).alias("desirability"))


ITEMS = f"""SELECT finding_id, line_no, line AS item_desc, coalesce(({S.makers('line')})[1], '') AS maker, {S.category('line')} AS category, coalesce({S.era('line')}, '') AS era,
{S.desirability(S.makers('line'), S.era('line'))} AS desirability, CASE WHEN len({S.makers('line')}) > 0 THEN 'lexicon' ELSE 'vlm' END AS source, CASE confidence WHEN 'medium' THEN 'med' ELSE confidence END AS id_confidence
FROM (SELECT finding_id, confidence, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT finding_id, confidence, list_filter(list_transform({S.lines('response')}, lambda x: {S.trim('x')}), lambda x: x <> '' AND NOT {S.junk('x')}) AS ls FROM (SELECT r.finding_id, r.response, f.confidence FROM responses r JOIN findings f ON r.finding_id = f.finding_id)))"""
ITEM_COLUMNS = ["finding_id", "line_no", "item_desc", "maker", "category", "era", "desirability", "source", "id_confidence"]


def _items(t, rows=None):
    rows = (t.responses if rows is None else rows).select("finding_id", F.col("response").alias("description")).join(t.findings.select("finding_id", "confidence"), "finding_id")
    return I.extract_items(rows).withColumns({"line_no": F.col("line_no").cast("long"), "maker": F.coalesce("maker", F.lit("")), "era": F.coalesce("era", F.lit(""))}).select(ITEM_COLUMNS)


@query("items", "responses", sql=ITEMS)
def _(t):
    return _items(t)


@query("backfill_items", "responses", sql=f"SELECT * FROM ({ITEMS}) WHERE finding_id NOT IN (SELECT finding_id FROM findings WHERE part_id % 2 = 0)")
def _(t):
    """Items of the findings that have none yet; here those of even parts have theirs."""
    done = t.findings.where("part_id % 2 = 0").select("finding_id")
    return _items(t, t.responses.join(done, "finding_id", "left_anti"))


@query("backfill_counts", "responses", sql=f"SELECT count(DISTINCT finding_id) AS findings, count(*) AS items FROM ({ITEMS})")
def _(t):
    return _items(t).agg(F.countDistinct("finding_id").alias("findings"), F.count("*").alias("items"))


# --- evaluation -----------------------------------------------------------------------------------------------------

FLAGS = f"""f AS (SELECT *, {S.findings('raw', 1000, False)} AS detected, expect_nothing OR len(list_filter(expected_keywords, lambda k: contains(lower(raw), lower(k)))) > 0 AS keyword_hit,
CASE WHEN category IN ('seating', 'bed', 'electronics', 'kitsch') THEN {S.specific('raw')} END AS specific, length({S.trim('raw')}) <= 1000 AND NOT {S.has(S.trim('raw'), '^(' + S.R.NO_ANSWER + ')')} AS format_ok FROM results)"""
COUNTS = "count(*) FILTER (WHERE error IS NULL) AS n, count(*) FILTER (WHERE error IS NULL AND detected <> expect_nothing) AS ok, count(*) FILTER (WHERE error IS NULL AND NOT expect_nothing) AS el, count(*) FILTER (WHERE error IS NULL AND NOT expect_nothing AND keyword_hit) AS kh, count(*) FILTER (WHERE error IS NULL AND keyword_hit) AS ka, count(*) FILTER (WHERE error IS NULL AND specific IS NOT NULL) AS sn, count(*) FILTER (WHERE error IS NULL AND specific) AS sh, count(*) FILTER (WHERE error IS NULL AND format_ok) AS fo, avg(duration_ms) FILTER (WHERE error IS NULL) AS dm"
SHARE = "round(coalesce(CAST({0} AS DOUBLE) / nullif({1}, 0), 0), 6)"
SUMMARY = f"SELECT run, n AS total_images, {SHARE.format('ok', 'n')} AS detection_acc, {SHARE.format('kh', 'el')} AS keyword_recall, {SHARE.format('sh', 'sn')} AS specificity_rate, {SHARE.format('fo', 'n')} AS format_compliance, round(coalesce(CAST(dm AS DOUBLE), 0), 6) AS avg_duration_ms FROM (SELECT run, {COUNTS} FROM f GROUP BY run)"


@query("eval_flags", "results", sql=f"WITH {FLAGS} SELECT run, doc_id, detected, keyword_hit, specific, format_ok FROM f")
def _(t):
    return E.flags(t.results).select("run", "doc_id", "detected", "keyword_hit", "specific", "format_ok")


@query("eval_summary", "results", sql=f"WITH {FLAGS} {SUMMARY}")
def _(t):
    return E.summary(E.flags(t.results), "run")


@query("eval_by_category", "results", sql=f"WITH {FLAGS} SELECT run, category, n AS total, ok AS detected, ka AS keyword_hit, sh AS specific, sn AS specific_total, fo AS format_ok FROM (SELECT run, category, {COUNTS} FROM f GROUP BY ALL)")
def _(t):
    return E.by_category(E.flags(t.results), "run")


@query("eval_compare", "results", sql=f"WITH {FLAGS}, s AS ({SUMMARY}), u AS (SELECT run, unnest(['detection_acc', 'keyword_recall', 'specificity_rate', 'format_compliance', 'avg_duration_ms']) AS metric, unnest([detection_acc, keyword_recall, specificity_rate, format_compliance, avg_duration_ms]) AS value FROM s) SELECT metric, max(value) FILTER (WHERE run = 'long') AS long, max(value) FILTER (WHERE run = 'short') AS short FROM u GROUP BY metric")
def _(t):
    return E.compare(E.summary(E.flags(t.results), "run"), "run", ["long", "short"])


REST = "FROM records WHERE seq > (SELECT min(seq) FROM records)"
LATENCY = f"(SELECT CAST(duration_s AS DOUBLE) FROM records ORDER BY seq LIMIT 1) AS cold_start_s, (SELECT CAST(quantile_disc(duration_s, 0.5) AS DOUBLE) {REST}) AS p50, (SELECT CAST(quantile_disc(duration_s, 0.95) AS DOUBLE) {REST}) AS p95, (SELECT round(CAST(avg(duration_s) AS DOUBLE), 6) {REST}) AS avg_s, (SELECT count(*) {REST}) AS n"


@query("latency_stats", "records", sql=f"SELECT {LATENCY}")
def _(t):
    return E.latency(t.records.withColumn("duration_s", F.col("duration_s").cast("double")))


@query("throughput", "records", sql="SELECT round(count(*) / 1038.0, 6) AS per_second FROM records")
def _(t):
    return E.throughput(t.records, F.lit(1038.0))


def _runs(t):
    """A baseline and a candidate that lacks every fifth record and repeats every seventh with the opposite answer."""
    base = t.records.select("seq", "image_url", F.col("base_hit").alias("has_findings"))
    cand = t.records.where("seq % 5 <> 0").select("seq", "image_url", F.col("cand_hit").alias("has_findings"))
    return base, cand.unionByName(t.records.where("seq % 35 = 7").select((F.col("seq") + 1_000_000_000).alias("seq"), "image_url", (~F.col("cand_hit")).alias("has_findings")))


AGREE = """a AS (SELECT count(*) AS baseline_hits, count(*) FILTER (WHERE c.hit) AS both_hit, round(coalesce(count(*) FILTER (WHERE c.hit) / nullif(CAST(count(*) AS DOUBLE), 0), 0), 6) AS rate, count(c.hit) AS matched, count(*) - count(c.hit) AS unmatched
FROM (SELECT image_url FROM records WHERE base_hit) b LEFT JOIN (SELECT image_url, CASE WHEN seq % 35 = 7 THEN NOT cand_hit ELSE cand_hit END AS hit FROM records WHERE seq % 5 <> 0) c ON b.image_url = c.image_url)"""


@query("backend_agreement", "records", sql=f"WITH {AGREE} SELECT * FROM a")
def _(t):
    return E.agreement(*_runs(t))


@query("calibration_report", "records", sql=f"WITH {AGREE} SELECT *, round(n / 1038.0, 6) AS per_second FROM a, (SELECT {LATENCY}) l")
def _(t):
    a = E.agreement(*_runs(t))
    lat = E.latency(t.records.withColumn("duration_s", F.col("duration_s").cast("double")))
    return a.crossJoin(F.broadcast(lat)).withColumn("per_second", F.round(F.col("n") / 1038.0, 6))  # one row each


@query("training_labels", "sales", "images", sql="SELECT i.image_id, 0 AS label FROM images i WHERE i.sale_id IN (SELECT sale_id FROM sales WHERE order_status = 'P') UNION ALL SELECT DISTINCT image_id, 1 FROM images WHERE vec_id % 50 = 0")
def _(t):
    outcome = F.when(F.col("order_status") == "F", "good").when(F.col("order_status") == "O", "meh").otherwise("waste")
    items = t.images.select("image_id", F.when(F.col("vec_id") % 50 == 0, "human").otherwise("vlm").alias("source"))
    return E.training_labels(t.sales.select("sale_id", outcome.alias("outcome")), t.images, items)


# --- pages ----------------------------------------------------------------------------------------------------------

HREF = 'href="(/[^"]+)"'


@query("page_links", sql=f"""SELECT page_id, pos, link_id, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link_id ORDER BY pos) AS n FROM
(SELECT page_id, pos, href, list_extract(string_split(href, '/'), -1) AS link_id FROM (SELECT page_id, unnest(range(len(hs))) AS pos, unnest(hs) AS href FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS hs FROM pages)))) WHERE n = 1""")
def _(t):
    return P.links(t.pages, pattern=HREF).withColumn("pos", F.col("pos").cast("long"))


#: The driver's pages with the fields of a listing added by rule, and a URL that ends in state, town, code and number.
PAGE = """(SELECT page_id, html || CASE WHEN page_id % 4 <> 3 THEN '{"startDate":"2001-02-0' || page_id % 9 || 'T09:00","endDate":"2001-03-01T12:00","addressLine1":"' || page_id || ' Main"' || CASE WHEN page_id % 2 = 0 THEN ',"addressLocality":"Town ' || page_id % 7 || '"' ELSE '' END || '}' ELSE '' END
|| '<img src="https://cdn.example.com/p/' || page_id || '.JPG"><img src="https://cdn.example.com/p/' || page_id || '.JPG"><img src="https://cdn.example.com/logo/a.png"><img src="http://cdn.example.com/q.webp">' AS html,
CASE WHEN page_id % 5 <> 4 THEN url || '/TX/Round-Rock/78664/' || page_id ELSE url END AS url FROM pages)"""


def _spark_pages(t):
    i = F.col("page_id")
    text = i.cast("string")
    city = F.when(i % 2 == 0, F.concat(F.lit(',"addressLocality":"Town '), (i % 7).cast("string"), F.lit('"'))).otherwise("")
    data = F.concat(F.lit('{"startDate":"2001-02-0'), (i % 9).cast("string"), F.lit('T09:00","endDate":"2001-03-01T12:00","addressLine1":"'), text, F.lit(' Main"'), city, F.lit("}"))
    photo = F.concat(F.lit('<img src="https://cdn.example.com/p/'), text, F.lit('.JPG">'))
    html = F.concat("html", F.when(i % 4 != 3, data).otherwise(""), photo, photo, F.lit('<img src="https://cdn.example.com/logo/a.png"><img src="http://cdn.example.com/q.webp">'))
    url = F.when(i % 5 != 4, F.concat("url", F.lit("/TX/Round-Rock/78664/"), text)).otherwise(F.col("url"))
    return t.pages.select("page_id", html.alias("html"), url.alias("url"))


def _field(pattern: str, x: str = "html") -> str:
    return f"nullif(regexp_extract({x}, {S.lit(pattern)}, 1), '')"


PLACE = [rf"nullif(regexp_extract(url, '/([A-Z][A-Z])/([^/]+)/(\d\d\d\d\d)/\d+/?$', {k}), '')" for k in (1, 2, 3)]
META = '<meta property="og:title" content="([^"]+)"'
FIELDS = rf"""fl AS (SELECT page_id, list_extract(string_split(url, '/'), -1) AS sale_id,
{S.trim("regexp_replace(coalesce(" + _field(META) + ", " + _field("<title>([^<]+)</title>") + r", list_extract(string_split(url, '/'), -1)), '\s*starts on.*$', '', 'i')")} AS title,
substring({_field('"startDate":"([^"]+)"')}, 1, 10) AS start_date, substring({_field('"endDate":"([^"]+)"')}, 1, 10) AS end_date, regexp_extract(html, '"addressLine1":"([^"]*)"', 1) AS address,
coalesce({_field('"addressLocality":"([^"]+)"')}, replace({PLACE[1]}, '-', ' ')) AS city, coalesce({_field('"addressRegion":"([^"]+)"')}, {PLACE[0]}) AS state, coalesce({_field('"postalCode":"([^"]+)"')}, {PLACE[2]}) AS zip FROM {PAGE})"""
PAGE_COLUMNS = ["page_id", "sale_id", "title", "start_date", "end_date", "address", "city", "state", "zip"]


@query("page_details", sql=f"WITH {FIELDS} SELECT * FROM fl WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL AND zip IS NOT NULL")
def _(t):
    return P.details(_spark_pages(t), keep=("page_id",)).select(PAGE_COLUMNS)


@query("page_rejects", sql=f"WITH {FIELDS} SELECT * FROM (SELECT page_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} IS NULL THEN {S.lit(c)} END' for c in P.REQUIRED)}], lambda x: x IS NOT NULL), ',') AS missing FROM fl) WHERE missing <> ''")
def _(t):
    return P.rejects(_spark_pages(t), keep=("page_id",)).select("page_id", F.array_join("missing", ",").alias("missing"))


@query("page_assets", sql=f"SELECT page_id, CAST(0 AS BIGINT) AS pos, 'https://cdn.example.com/p/' || page_id || '.JPG' AS asset_url FROM {PAGE} UNION ALL SELECT page_id, 1, 'http://cdn.example.com/q.webp' FROM {PAGE}")
def _(t):
    return P.assets(_spark_pages(t)).withColumn("pos", F.col("pos").cast("long"))


@query("asset_path", sql="SELECT page_id, 'thumbs/' || page_id || '/' || sha1(url) || '.jpg' AS path FROM pages")
def _(t):
    rows = t.pages.select("page_id", F.col("page_id").cast("string").alias("sale_id"), "url")
    return rows.select("page_id", P.asset_path("thumbs", "sale_id", "url").alias("path"))


# --- models ---------------------------------------------------------------------------------------------------------


@query("infer_stub", sql="SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN 2 END AS embed_dim, CASE WHEN doc_id % 10 <> 3 THEN 'length-2' END AS embed_model FROM documents")
def _(t):
    """A model that gives the length of each text twice, and vectors of a wrong size for some."""

    def model(batch):
        return [[float(len(x[1:])), float(len(x[1:]))] if x[0] != "3" else [0.0] for x in batch]

    rows = t.documents.select("doc_id", F.concat((F.col("doc_id") % 10).cast("string"), F.coalesce("text", F.lit(""))).alias("x"))
    return inference.infer_batches(rows, model, "x", "length-2", dim=2).select("doc_id", "embed_dim", "embed_model")


@query("annotate_responses", sql="SELECT doc_id, 'n=' || length(coalesce(text, '')) AS response, 'counter' AS vlm_model, 'p1' AS prompt_version FROM documents")
def _(t):
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return inference.annotate_responses(rows, lambda s: [f"n={len(x)}" for x in s], "text", "counter", "p1").drop("text")


@query("embed_align", sql="SELECT label AS request_id, slot, CASE WHEN slot % 7 <> 3 AND slot % 5 <> 4 THEN vec_id END AS vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slot FROM embeddings)")
def _(t):
    """Each label's vectors as one answer, in reverse, some without a vector and some of a wrong size."""
    from pyspark.sql import Window

    rows = t.embeddings.withColumn("slot", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    vector = F.when(F.col("slot") % 7 == 3, F.lit(None).cast("array<float>")).when(F.col("slot") % 5 == 4, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    item = F.struct(F.col("slot").alias("index"), vector.alias("embedding"))
    packed = rows.groupBy(F.col("label").alias("request_id")).agg(F.count("*").cast("int").alias("count"), F.sort_array(F.collect_list(item), asc=False).alias("data"))
    got = inference.align_embeddings(packed, 64)
    named = rows.select(F.col("label").alias("request_id"), "slot", "vec_id")
    return named.join(got, ["request_id", "slot"]).select("request_id", F.col("slot").cast("long").alias("slot"), F.when(F.col("vector").isNotNull(), F.col("vec_id")).alias("vec_id"))


@query("vector_blob", sql="SELECT vec_id, CAST(4 * len(embedding) AS INT) AS n_bytes, true AS same FROM embeddings")
def _(t):
    """Vectors to little-endian bytes and back."""
    rows = t.embeddings.select("vec_id", "embedding", N.vector_to_blob("embedding").alias("blob"))
    return rows.select("vec_id", F.length("blob").alias("n_bytes"), (N.blob_to_vector("blob") == F.col("embedding")).alias("same"))
