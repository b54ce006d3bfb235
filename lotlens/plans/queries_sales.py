"""Queries over sales, findings, hunts, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules as R
from ..functions import text as X
from ..functions.items import extract_items
from ..operators import changes, ranking, search, vectors
from . import fragments as S
from .bindings import AS_OF, Tables
from .register import query

def today():
    return F.expr(AS_OF)

UP = f"(SELECT * FROM sales WHERE end_date >= {AS_OF})"


def up(t: Tables):
    return ranking.upcoming(t.sales, today())


@query("scan_project", "findings", sql="SELECT finding_id, sale_id, description FROM findings WHERE confidence = 'high'")
def _(t):
    return t.findings.where("confidence = 'high'").select("finding_id", "sale_id", "description")


SALE = "sale_id, title, start_date, end_date, distance_miles"


@query("upcoming_sales", "sales", sql=f"SELECT {SALE} FROM sales WHERE end_date >= {AS_OF}")
def _(t):
    return up(t).orderBy("start_date", "distance_miles", "sale_id").select(SALE.split(", "))


@query("past_sales", "sales", sql=f"SELECT {SALE} FROM sales WHERE end_date < {AS_OF}")
def _(t):
    return ranking.past(t.sales, today()).orderBy(F.desc("end_date"), "distance_miles", "sale_id").select(SALE.split(", "))


@query("all_sales", "sales", sql=f"SELECT {SALE}, end_date >= {AS_OF} AS is_upcoming FROM sales")
def _(t):
    return t.sales.select(*SALE.split(", "), (F.col("end_date") >= today()).alias("is_upcoming"))


@query("keyword_match", "findings", sql="SELECT finding_id, contains(lower(description), 'lamp') OR contains(lower(description), 'stickley') AS matched FROM findings")
def _(t):
    return t.findings.select("finding_id", X.keyword_match("description", F.array(F.lit("LAMP"), F.lit("stickley"))).alias("matched"))


@query("keyword_search", "findings", "sales", sql="SELECT f.finding_id, f.sale_id, s.start_date FROM findings f JOIN sales s ON f.sale_id = s.sale_id WHERE lower(f.description) LIKE '%lamp%' OR lower(f.description) LIKE '%sta_dard%'")
def _(t):
    """Wildcards in the keywords are wildcards here; keyword_match takes them literally."""
    words = X.keyword_list(F.lit(" Lamp, ,sta_dard"))
    hit = F.exists(words, lambda k: F.like(F.lower("description"), F.concat(F.lit("%"), F.lower(k), F.lit("%"))))
    return t.findings.where(hit).join(t.sales.select("sale_id", "start_date"), "sale_id").select("finding_id", "sale_id", "start_date").orderBy(F.desc("start_date"), "finding_id")


@query("escape_like", sql=r"SELECT p_partkey, regexp_replace(concat(p_name, '_', p_size, '%'), '([\\%_])', '\\\1', 'g') AS escaped FROM part")
def _(t):
    return t.part.select("p_partkey", X.escape_like(F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"), F.lit("%"))).alias("escaped"))


HIT = "SELECT DISTINCT f.finding_id, f.sale_id, h.hunt_id, h.name FROM findings f, (SELECT hunt_id, name, unnest(keywords) AS k FROM hunts) h WHERE contains(lower(f.description), lower(h.k))"


@query("hunt_gated_sales", "sales", "findings", "hunts", sql=f"SELECT sale_id, false AS no_hunts FROM {UP} u WHERE sale_id IN (SELECT sale_id FROM ({HIT}))")
def _(t):
    return ranking.hunt_gate(up(t), t.findings, t.hunts, "u1").select("sale_id", "no_hunts")


@query("radius_filter", "sales", sql="SELECT sale_id, distance_miles FROM sales WHERE distance_miles <= 30.0")
def _(t):
    return ranking.within_radius(t.sales, F.col("distance_miles"), 30.0).select("sale_id", "distance_miles")


@query("sale_detail", "sales", "findings", sql="""
SELECT s.sale_id, s.title, f.finding_id, contains(lower(f.description), 'lamp') AS matched, count(*) OVER () AS n_findings,
       count(*) FILTER (WHERE contains(lower(f.description), 'lamp')) OVER () AS n_matched
FROM sales s JOIN findings f ON s.sale_id = f.sale_id WHERE s.sale_id = (SELECT min(sale_id) FROM findings)""")
def _(t):
    first = t.findings.agg(F.min("sale_id")).first()[0]
    return ranking.sale_detail(t.sales, t.findings, F.array(F.lit("lamp")), first).select("sale_id", "title", "finding_id", "matched", "n_findings", "n_matched")


@query("owner_hunts", "hunts", "sales", sql="SELECT s.sale_id, h.hunt_id, h.name FROM sales s JOIN hunts h ON h.owner = CASE WHEN s.customer % 2 = 0 THEN 'u1' ELSE 'u2' END")
def _(t):
    owners = t.sales.select("sale_id", F.when(F.col("customer") % 2 == 0, "u1").otherwise("u2").alias("owner"))
    return owners.join(t.hunts, "owner").select("sale_id", "hunt_id", "name")


@query("settings_default", sql="SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS DOUBLE) END, 30.0) AS radius_miles FROM customer")
def _(t):
    settings = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_nationkey").cast("double").alias("radius_miles"))
    return changes.with_default(t.customer.select("c_custkey"), settings, "c_custkey", "radius_miles", 30.0)


@query("findings_with_sale", "findings", "sales", sql="SELECT f.finding_id, f.sale_id, s.title, s.city FROM findings f JOIN sales s ON f.sale_id = s.sale_id")
def _(t):
    return t.findings.select("finding_id", "sale_id").join(t.sales.select("sale_id", "title", "city"), "sale_id")


@query("findings_of_upcoming", "findings", "sales", sql=f"SELECT finding_id, sale_id FROM findings WHERE sale_id IN (SELECT sale_id FROM {UP})")
def _(t):
    return t.findings.select("finding_id", "sale_id").join(up(t).select("sale_id"), "sale_id", "left_semi")


@query("hunt_match_counts", "findings", "hunts", sql=f"SELECT sale_id, name, count(*) AS n FROM ({HIT}) GROUP BY sale_id, name")
def _(t):
    return ranking.hunt_match_counts(t.findings, t.hunts)


@query("last_scanned", "sales", sql="SELECT max(scraped_at) AS last_scanned, count(*) AS n_sales FROM sales")
def _(t):
    return t.sales.agg(F.max("scraped_at").alias("last_scanned"), F.count("*").alias("n_sales"))


TALLY = "count(*) FILTER (WHERE tag = 'electronics') AS electronics, count(*) FILTER (WHERE tag = 'kitsch') AS kitsch, count(*) FILTER (WHERE tag = 'collectible') AS collectibles, count(*) FILTER (WHERE tag = 'furniture') AS furniture"
SCORED = f"(SELECT *, {S.tag('description')} AS tag, {S.score('description', 'confidence')} AS score FROM findings)"
RANKED = f"SELECT u.sale_id, u.title, u.distance_miles, round(sum(score), 6) AS score, count(*) AS total_findings, {TALLY} FROM {UP} u JOIN {SCORED} f ON u.sale_id = f.sale_id GROUP BY ALL"
RANKED_COLUMNS = ["sale_id", "title", "distance_miles", "score", "total_findings", "electronics", "kitsch", "collectibles", "furniture"]


@query("ranked_sales", "sales", "findings", sql=RANKED)
def _(t):
    return ranking.ranked_sales(up(t), t.findings).select(RANKED_COLUMNS).orderBy(F.desc("score"), "distance_miles", "sale_id")


TOP = f"SELECT * FROM (SELECT sale_id, finding_id, score, tag, row_number() OVER (PARTITION BY sale_id ORDER BY score DESC, finding_id) AS rank FROM {SCORED}) WHERE rank <= 6"


@query("discover_ranked", "sales", "findings", sql=f"""
WITH r AS ({RANKED}), t AS (SELECT sale_id, string_agg(finding_id, ',' ORDER BY rank) AS top FROM ({TOP}) GROUP BY sale_id)
SELECT r.*, t.top FROM r JOIN t ON r.sale_id = t.sale_id""")
def _(t):
    """Upcoming sales by score with their six best findings."""
    f = t.findings.join(up(t).select("sale_id"), "sale_id", "left_semi")
    top = ranking.nest_top(ranking.scored(f)).select("sale_id", F.array_join(F.transform("top_findings", lambda x: x["finding_id"]), ",").alias("top"))
    return ranking.ranked_sales(up(t), f).select(RANKED_COLUMNS).join(top, "sale_id").orderBy(F.desc("score"), "distance_miles", "sale_id")


@query("tag_tally", "findings", sql=f"SELECT sale_id, {TALLY} FROM {SCORED} GROUP BY sale_id")
def _(t):
    return ranking.tally(t.findings, tag=X.finding_tag("description"))


@query("top_findings_per_sale", "findings", sql=TOP)
def _(t):
    return ranking.top_per_sale(ranking.scored(t.findings), R.TOP_FINDINGS).select("sale_id", "finding_id", "score", "tag", "rank")


@query("standouts", "sales", "findings", sql=f"SELECT f.finding_id, f.sale_id, u.title, f.score, f.tag FROM {SCORED} f JOIN {UP} u ON f.sale_id = u.sale_id WHERE f.score >= 4 ORDER BY f.score DESC, f.finding_id LIMIT 30")
def _(t):
    return ranking.standouts(up(t), t.findings).select("finding_id", "sale_id", "title", "score", "tag")


@query("category_totals", "findings", sql=f"SELECT tag, count(*) AS n FROM {SCORED} GROUP BY GROUPING SETS ((tag), ())")
def _(t):
    return ranking.category_totals(t.findings.select(X.finding_tag("description").alias("tag")))


@query("ranked_by_tag", "sales", "findings", sql=f"SELECT sale_id, kitsch, top FROM (SELECT r.sale_id, r.kitsch, t.top FROM ({RANKED}) r JOIN (SELECT sale_id, string_agg(finding_id, ',' ORDER BY rank) AS top FROM (SELECT sale_id, finding_id, row_number() OVER (PARTITION BY sale_id ORDER BY score DESC, finding_id) AS rank FROM {SCORED} WHERE tag = 'kitsch') WHERE rank <= 5 GROUP BY sale_id) t ON r.sale_id = t.sale_id) WHERE kitsch > 0")
def _(t):
    f = ranking.scored(t.findings)
    top = ranking.nest_top(f.where("tag = 'kitsch'"), 5).select("sale_id", F.array_join(F.transform("top_findings", lambda x: x["finding_id"]), ",").alias("top"))
    return ranking.ranked_sales(up(t), t.findings).where("kitsch > 0").select("sale_id", "kitsch").join(top, "sale_id")


THUMB = f"SELECT sale_id, finding_id, description FROM (SELECT f.*, row_number() OVER (PARTITION BY f.sale_id ORDER BY (f.finding_id IN (SELECT finding_id FROM ({HIT}))) DESC, length(f.description) DESC, f.finding_id) AS n FROM findings f) WHERE n = 1"


@query("sale_thumbnail", "findings", "hunts", sql=THUMB)
def _(t):
    return ranking.thumbnail(t.findings, ranking.set_matches(t.findings, ranking.keyword_sets(t.hunts)))


@query("sale_summary", "sales", "findings", "hunts", sql=f"""
WITH p AS ({HIT}), c AS (SELECT sale_id, string_agg(name || ':' || n, ',' ORDER BY name) AS by_hunt FROM (SELECT sale_id, name, count(*) AS n FROM p GROUP BY ALL) GROUP BY sale_id),
m AS (SELECT sale_id, count(DISTINCT finding_id) AS n FROM p GROUP BY sale_id), th AS ({THUMB})
SELECT s.sale_id, coalesce(m.n, 0) AS total_matched, c.by_hunt, th.finding_id AS thumb_finding FROM sales s LEFT JOIN m ON s.sale_id = m.sale_id LEFT JOIN c ON s.sale_id = c.sale_id LEFT JOIN th ON s.sale_id = th.sale_id""")
def _(t):
    out = ranking.sale_summary(t.sales, t.findings, t.hunts)
    flat = F.array_join(F.transform("hunt_match_counts", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",")
    return out.select("sale_id", "total_matched", flat.alias("by_hunt"), "thumb_finding")


@query("recent_feed", "findings", "sales", sql="SELECT f.finding_id, f.sale_id, s.title FROM findings f JOIN sales s ON f.sale_id = s.sale_id ORDER BY f.finding_id DESC LIMIT 600")
def _(t):
    newest = t.findings.select("finding_id", "sale_id").join(t.sales.select("sale_id", "title"), "sale_id")
    return newest.orderBy(F.desc("finding_id")).limit(R.FEED).select("finding_id", "sale_id", "title")


@query("context_digest", "sales", "findings", sql=f"""
WITH r AS (SELECT sale_id, description, row_number() OVER (PARTITION BY sale_id ORDER BY score DESC, finding_id) AS rank FROM {SCORED}),
l AS (SELECT sale_id, string_agg('  - ' || description, chr(10) ORDER BY rank) AS ls FROM r WHERE rank <= 15 GROUP BY sale_id),
n AS (SELECT sale_id, count(*) AS n FROM findings GROUP BY sale_id)
SELECT u.sale_id, u.distance_miles, 'Sale: "' || title || '" (' || u.sale_id || ') - ' || printf('%.1f', u.distance_miles) || 'mi, ' || city || ' ' || state || chr(10) ||
       'Dates: ' || start_date || ' to ' || end_date || chr(10) || 'Findings (' || n.n || ' total, showing top):' || chr(10) || l.ls AS digest
FROM {UP} u JOIN l ON u.sale_id = l.sale_id JOIN n ON u.sale_id = n.sale_id""")
def _(t):
    f = t.findings.join(up(t).select("sale_id"), "sale_id", "left_semi")
    return ranking.context_digest(up(t), f).orderBy("distance_miles", "sale_id")


@query("sale_images", "images", "findings", sql="SELECT i.image_id, i.sale_id, i.image_url, coalesce(bool_or(f.finding_id IS NOT NULL), false) AS has_finding FROM (SELECT image_id, sale_id, 'v' || vec_id AS image_url FROM images) i LEFT JOIN (SELECT finding_id, sale_id, 'v' || part_id % (SELECT count(*) FROM embeddings) AS image_url FROM findings WHERE confidence = 'high') f ON i.sale_id = f.sale_id AND i.image_url = f.image_url GROUP BY ALL")
def _(t):
    photos = t.images.select("image_id", "sale_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("image_url"))
    n = t.embeddings.agg(F.count("*").alias("n"))
    named = t.findings.where("confidence = 'high'").crossJoin(F.broadcast(n))  # one row
    named = named.select("sale_id", F.concat(F.lit("v"), (F.col("part_id") % F.col("n")).cast("string")).alias("image_url"))
    return ranking.sale_images(photos, named)


@query("plan_items", "sales", "findings", sql="SELECT p.owner, p.sale_id, p.sort_order, s.title, n.n AS n_findings FROM (SELECT 'u' || o_custkey % 5 AS owner, CAST(o_orderkey + o_orderkey % 2 * 10000000 AS STRING) AS sale_id, o_orderkey AS sort_order FROM orders) p JOIN sales s ON p.sale_id = s.sale_id LEFT JOIN (SELECT sale_id, count(*) AS n FROM findings GROUP BY sale_id) n ON n.sale_id = s.sale_id")
def _(t):
    plan = t.orders.select(F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")).alias("owner"), F.expr("CAST(o_orderkey + o_orderkey % 2 * 10000000 AS STRING)").alias("sale_id"), F.col("o_orderkey").alias("sort_order"))
    n = t.findings.groupBy("sale_id").agg(F.count("*").alias("n_findings"))
    return plan.join(t.sales.select("sale_id", "title"), "sale_id").join(n, "sale_id", "left").orderBy("owner", "sort_order").select("owner", "sale_id", "sort_order", "title", "n_findings")


@query("thumb_url", "images", sql="SELECT image_id, CASE WHEN vec_id % 2 = 0 THEN '/thumbs/' || vec_id END AS thumb_url FROM images")
def _(t):
    return ranking.with_thumb(t.images.select("image_id", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).alias("vec")), "vec").select("image_id", "thumb_url")


@query("sale_labels", "sales", sql=rf"""SELECT sale_id, regexp_replace(title, '^\(\d+\)\s*', '') AS clean_title,
CASE WHEN start_date = {AS_OF} THEN 'Today' WHEN start_date = {AS_OF} + 1 THEN 'Tomorrow' WHEN dayofweek(start_date) = 6 THEN 'Sat' WHEN dayofweek(start_date) = 0 THEN 'Sun' ELSE strftime(start_date, '%b %-d') END AS badge,
greatest(0, end_date - {AS_OF}) AS days_left, printf('%.1f', distance_miles) || ' mi' AS distance FROM sales""")
def _(t):
    return t.sales.select("sale_id", X.clean_title("title").alias("clean_title"), X.date_badge("start_date", today()).alias("badge"), X.days_left("end_date", today()).cast("long").alias("days_left"), X.distance_text("distance_miles").alias("distance"))


@query("local_date", sql="SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS local_date FROM events")
def _(t):
    return t.events.select("event_id", X.local_date("ts").alias("local_date"))


@query("haversine", "sales", sql="SELECT sale_id, round(2 * 3958.8 * asin(sqrt(power(sin((radians(lat) - radians(32.0)) / 2), 2) + cos(radians(32.0)) * cos(radians(lat)) * power(sin((radians(lon) - radians(-85.0)) / 2), 2))), 6) AS miles FROM sales")
def _(t):
    return t.sales.select("sale_id", F.round(N.haversine(F.lit(32.0), F.lit(-85.0), "lat", "lon"), 6).alias("miles"))


@query("geocode_lookup", "sales", sql="SELECT s.sale_id, round(coalesce(CASE WHEN s.customer % 3 = 0 THEN g.lat END, z.lat), 6) AS lat, round(coalesce(CASE WHEN s.customer % 3 = 0 THEN g.lon END, z.lon), 6) AS lon FROM sales s LEFT JOIN (SELECT address, min(lat) AS lat, min(lon) AS lon FROM sales GROUP BY address) g ON s.address = g.address LEFT JOIN (SELECT city, avg(lat) AS lat, avg(lon) AS lon FROM sales WHERE city <> 'FRANCE' GROUP BY city) z ON s.city = z.city WHERE coalesce(CASE WHEN s.customer % 3 = 0 THEN g.lat END, z.lat) IS NOT NULL")
def _(t):
    gazetteer = t.sales.where("customer % 3 = 0").groupBy(F.col("address").alias("address_key")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    zips = t.sales.where("city <> 'FRANCE'").groupBy(F.col("city").alias("zip")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    rows = t.sales.select("sale_id", F.col("address").alias("address_key"), F.col("city").alias("zip"))
    return changes.geocode(rows, gazetteer, zips).select("sale_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


# --- search ---------------------------------------------------------------------------------------------------------

TERMS, CATS = S.synonyms()
EXPAND = f"""
lt AS (SELECT query_id, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') AS literal FROM queries),
cand AS (SELECT query_id, unnest(list_distinct(list_concat(literal, CASE WHEN len(literal) >= 2 THEN list_transform(range(1, len(literal)), lambda i: literal[i] || ' ' || literal[i + 1]) ELSE [] END))) AS alias FROM lt),
syn AS (SELECT * FROM (VALUES {TERMS}) AS t(alias, term)), cats AS (SELECT * FROM (VALUES {CATS}) AS t(alias, category)),
terms AS (SELECT query_id, unnest(literal) AS term FROM lt UNION SELECT query_id, term FROM cand JOIN syn USING (alias)),
wanted AS (SELECT DISTINCT query_id, category FROM cand JOIN cats USING (alias))"""
LEX = f"""WITH {EXPAND},
fu AS (SELECT * FROM findings WHERE sale_id IN (SELECT sale_id FROM {UP})),
lh AS (SELECT DISTINCT query_id, finding_id, sale_id FROM fu, terms WHERE contains(lower(description), term)),
it AS (SELECT finding_id, sale_id, {S.category('description')} AS category FROM fu),
ch AS (SELECT DISTINCT query_id, finding_id, sale_id FROM it JOIN wanted USING (category) WHERE (query_id, finding_id) NOT IN (SELECT query_id, finding_id FROM lh)),
sh AS (SELECT DISTINCT query_id, sale_id FROM {UP} u, (SELECT query_id, unnest(literal) AS word FROM lt) WHERE contains(lower(concat_ws(' ', title, city, state, address)), word)),
al AS (SELECT query_id, sale_id, 1 AS l, 0 AS c, 0 AS t FROM lh UNION ALL SELECT query_id, sale_id, 0, 1, 0 FROM ch UNION ALL SELECT query_id, sale_id, 0, 0, 1 FROM sh),
lx AS (SELECT query_id, a.sale_id, sum(l) AS n_literal, sum(c) AS n_category, max(t) AS in_text, sum(l) * 10 + sum(c) * 3 + max(t) AS score, s.distance_miles FROM al a JOIN sales s ON a.sale_id = s.sale_id GROUP BY query_id, a.sale_id, s.distance_miles)
"""


def expanded(t: Tables):
    """The texts searched for, each once, expanded, under the least query_id that asks for it."""
    return search.expand(search.texts(t.queries), search.synonyms(t.spark))


def lexical_hits(t: Tables):
    """Of each text; ``search.for_all`` gives them to all queries."""
    f = t.within(up(t)).findings
    return search.lexical(expanded(t), up(t), f, extract_items(f, keep=("finding_id", "sale_id")))


@query("query_expand", "queries", "findings", sql=f"WITH {EXPAND} SELECT q.query_id, q.expanded, q.categories, count(f.finding_id) AS n_findings FROM (SELECT lt.query_id, (SELECT string_agg(term, ',' ORDER BY term) FROM terms WHERE terms.query_id = lt.query_id) AS expanded, coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM wanted WHERE wanted.query_id = lt.query_id), '') AS categories FROM lt) q LEFT JOIN (SELECT DISTINCT query_id, finding_id FROM findings, terms WHERE contains(lower(description), term)) f ON q.query_id = f.query_id GROUP BY ALL")
def _(t):
    e = expanded(t)
    n = search.literal_hits(e, t.findings).groupBy("query_id").agg(F.count("*").alias("n"))
    e = search.for_all(e.join(n, "query_id", "left"), t.queries)
    return e.select("query_id", F.array_join("expanded", ",").alias("expanded"), F.array_join("categories", ",").alias("categories"), F.coalesce("n", F.lit(0)).alias("n_findings"))


LEX_COLUMNS = ["query_id", "sale_id", "n_literal", "n_category", "in_text", "score"]


@query("lexical_search", "queries", "sales", "findings", sql=LEX + "SELECT query_id, sale_id, n_literal, n_category, in_text, score FROM lx")
def _(t):
    """The rows of each query come by descending score, then distance and sale_id; those of queries with one text lie between each other."""
    return search.ordered_for_all(lexical_hits(t), t.queries, "query_id", F.desc("score"), "distance_miles", "sale_id").select(LEX_COLUMNS)


@query("category_only_hits", "queries", "sales", "findings", sql=LEX + "SELECT query_id, finding_id, sale_id FROM ch")
def _(t):
    f = t.within(up(t)).findings
    e = expanded(t)
    hits = search.category_only_hits(e, extract_items(f, keep=("finding_id", "sale_id")), search.literal_hits(e, f))
    return search.asked(hits.select("query_id", "finding_id", "sale_id"), t.queries)


CANDIDATES = f"(SELECT f.finding_id, f.sale_id, i.embedding FROM findings f JOIN images i ON f.finding_id = i.image_id WHERE i.embed_model = 'current' AND i.embedding IS NOT NULL AND f.sale_id IN (SELECT sale_id FROM {UP}))"
SEM = f"""sm AS (SELECT query_id, sale_id, max(c) AS cosine, arg_min(finding_id, (-c, finding_id)) AS finding_id FROM
(SELECT v.vec_id AS query_id, k.sale_id, k.finding_id, {S.cosine('k.embedding', 'v.embedding')} AS c FROM {CANDIDATES} k, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) v) WHERE c >= 0.2 GROUP BY query_id, sale_id)"""


def candidates(t: Tables):
    some = t.within(up(t))  # an id begins with its sale, so photos of other sales need not reach the join
    f = some.findings.select("finding_id", "sale_id")
    photos = some.images.where("embed_model = 'current' AND embedding IS NOT NULL").select(F.col("image_id").alias("finding_id"), F.col("embedding").alias("vector"))
    return f.join(photos, "finding_id")


def query_vectors(t: Tables):
    return t.queries.select("query_id", F.col("embedding").alias("vector"))


@query("semantic_candidates", "findings", "images", "sales", sql=f"SELECT finding_id, sale_id, len(embedding) AS dim FROM {CANDIDATES}")
def _(t):
    return candidates(t).select("finding_id", "sale_id", F.size("vector").cast("long").alias("dim"))


@query("semantic_search", "findings", "images", "sales", sql=f"WITH {SEM} SELECT query_id, sale_id, finding_id, round(cosine, 6) AS cosine FROM sm")
def _(t):
    return search.semantic(query_vectors(t), candidates(t)).select("query_id", "sale_id", "finding_id", F.round("cosine", 6).alias("cosine"))


@query("best_per_sale", "findings", "images", "sales", sql=f"SELECT query_id, sale_id, arg_min(finding_id, (-c, finding_id)) AS finding_id, round(max(c), 6) AS cosine FROM (SELECT v.vec_id AS query_id, k.sale_id, k.finding_id, {S.cosine('k.embedding', 'v.embedding')} AS c FROM {CANDIDATES} k, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) v) GROUP BY query_id, sale_id")
def _(t):
    return search.semantic(query_vectors(t), candidates(t), floor=None).select("query_id", "sale_id", "finding_id", F.round("cosine", 6).alias("cosine"))


@query("cosine", sql="SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0")
def _(t):
    """Every hundredth vector against all."""
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return vectors.cosines(a, b, "a", "x", "b", "y").select("a", "b", F.round("cosine", 6).alias("cosine"))


FUSED = """fl AS (SELECT query_id, sale_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance_miles, sale_id) - 1 AS rank FROM lx),
fs AS (SELECT query_id, sale_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, sale_id) - 1 AS rank FROM sm),
fused AS (SELECT query_id, sale_id, round(sum(1.0 / (10 + rank + 1)), 9) AS score, min(lex) AS lex FROM (SELECT query_id, sale_id, rank, rank AS lex FROM fl UNION ALL SELECT query_id, sale_id, rank, NULL FROM fs) GROUP BY query_id, sale_id)"""


def fused(t: Tables):
    """Both lists with their ranks, fused; the lexical one is ranked once for each text."""
    lex = search.ranks(lexical_hits(t), F.desc("score"), "distance_miles", "sale_id")
    return search.fuse_for_all(lex, search.ranks(search.semantic(query_vectors(t), candidates(t)), F.desc("cosine"), "sale_id"), t.queries)


@query("rrf_fuse", "queries", "sales", "findings", "images", sql=f"{LEX}, {SEM}, {FUSED} SELECT query_id, sale_id, score FROM fused")
def _(t):
    return fused(t).select("query_id", "sale_id", "score")


@query("hybrid_search", "queries", "sales", "findings", "images", sql=f"{LEX}, {SEM}, {FUSED} SELECT query_id, sale_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex NULLS LAST, sale_id) - 1 AS rank FROM fused")
def _(t):
    return search.by_fused_score(fused(t)).select("query_id", "sale_id", "score", "rank")


@query("plan_reorder", sql="""WITH p AS (SELECT o_custkey AS owner, CAST(o_orderkey AS STRING) AS sale_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS sort_order FROM orders),
w AS (SELECT owner, sale_id, row_number() OVER (PARTITION BY owner ORDER BY sale_id DESC) - 1 AS place FROM p WHERE owner % 2 = 0),
r AS (SELECT p.owner, p.sale_id, coalesce(w.place, p.sort_order) AS sort_order FROM p LEFT JOIN w ON p.owner = w.owner AND p.sale_id = w.sale_id)
SELECT * FROM r UNION ALL SELECT c.c_custkey, 'new', coalesce((SELECT max(sort_order) + 1 FROM r WHERE r.owner = c.c_custkey), 0) FROM customer c""")
def _(t):
    w = Window.partitionBy("owner").orderBy("o_orderkey")
    plan = t.orders.select(F.col("o_custkey").alias("owner"), "o_orderkey").withColumn("sort_order", F.row_number().over(w) - 1)
    plan = plan.select("owner", F.col("o_orderkey").cast("string").alias("sale_id"), "sort_order")
    wanted = plan.where("owner % 2 = 0").groupBy("owner").agg(F.sort_array(F.collect_list("sale_id"), asc=False).alias("sale_ids"))
    new = t.customer.select(F.col("c_custkey").alias("owner"), F.lit("new").alias("sale_id"), F.lit(0).alias("seq"))
    return changes.append_plan(changes.reorder_plan(plan, wanted), new)


@query("seed_defaults", "hunts", sql="SELECT DISTINCT 'u' || c_custkey AS owner, d.name, d.n FROM customer, (VALUES ('furniture', 5), ('silver', 3), ('art', 4)) AS d(name, n) WHERE NOT (c_custkey % 2 = 0 AND d.name = 'silver') UNION ALL SELECT 'u' || c_custkey, 'silver', 1 FROM customer WHERE c_custkey % 2 = 0")
def _(t):
    owners = t.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("owner"))
    have = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("owner"), F.lit("silver").alias("name"), F.array(F.lit("spoon")).alias("keywords"))
    start = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, k)).alias("keywords")) for n, k in R.DEFAULT_HUNTS))
    defaults = owners.select("owner", F.explode(start).alias("h")).select("owner", "h.name", "h.keywords")
    return changes.seed(have, defaults, ["owner", "name"]).select("owner", "name", F.size("keywords").alias("n"))
