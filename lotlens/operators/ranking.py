"""Sales and their findings: filters, summaries, hunts, ranking, standouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import col, finding_score, finding_tag, keyword_match, thumb_url
from .keywords import found_in


def upcoming(sales: DataFrame, as_of: Column) -> DataFrame:
    return sales.where(F.col("end_date") >= as_of)


def past(sales: DataFrame, as_of: Column) -> DataFrame:
    return sales.where(F.col("end_date") < as_of)


def within_radius(sales: DataFrame, miles: Column, radius: float) -> DataFrame:
    """Sales not farther than ``radius``; the boundary is inside."""
    return sales.where(miles <= radius)


def scored(findings: DataFrame) -> DataFrame:
    return findings.withColumn("score", finding_score("description", "confidence")).withColumn("tag", finding_tag("description"))


def tally(findings: DataFrame, key: str = "sale_id", tag: Column | str = "tag") -> DataFrame:
    """Counts of the four tags by sale."""
    t = col(tag)
    names = {"electronics": "electronics", "kitsch": "kitsch", "collectibles": "collectible", "furniture": "furniture"}
    return findings.groupBy(key).agg(*(F.count_if(t == v).alias(k) for k, v in names.items()))


def top_per_sale(scored_findings: DataFrame, k: int, key: str = "sale_id") -> DataFrame:
    """The k best findings of each sale; ``rank`` from 1, ties by finding_id."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "finding_id")
    return scored_findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_sales(sales: DataFrame, findings: DataFrame) -> DataFrame:
    """Sales with score, count and tally of their findings; sales without findings are not ranked.  Scores are rounded to 6 places."""
    f = scored(findings.select("sale_id", "description", "confidence"))
    per = f.groupBy("sale_id").agg(
        F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("total_findings"),
        *(F.count_if(F.col("tag") == v).alias(k) for k, v in {"electronics": "electronics", "kitsch": "kitsch", "collectibles": "collectible", "furniture": "furniture"}.items()),
    )
    return sales.join(per, "sale_id")


def nest_top(scored_findings: DataFrame, k: int = R.TOP_FINDINGS) -> DataFrame:
    """sale_id, top_findings: the k best as an array of structs, best first."""
    top = top_per_sale(scored_findings, k)
    item = F.struct("rank", "finding_id", "description", "score", "tag")
    return top.groupBy("sale_id").agg(F.array_sort(F.collect_list(item)).alias("top_findings"))


def standouts(sales: DataFrame, findings: DataFrame, least: float = R.STANDOUT_SCORE, k: int = R.STANDOUTS) -> DataFrame:
    """The k best findings of all sales with a score of ``least`` or more."""
    # the join comes first and the bound last: scores are then worked out once, for the findings of these sales only
    f = scored(findings.join(sales.select("sale_id", "title", "distance_miles"), "sale_id"))
    return f.orderBy(F.desc("score"), "finding_id").limit(k).where(F.col("score") >= least)


def category_totals(scored_findings: DataFrame) -> DataFrame:
    """Counts by tag and, with a null tag, over all."""
    return scored_findings.groupingSets([["tag"], []], "tag").agg(F.count("*").alias("n"))


def hunt_matches(findings: DataFrame, hunts: DataFrame) -> DataFrame:
    """finding_id, sale_id, hunt_id, name: pairs of which any keyword of the hunt occurs in the finding.

    Each description is read once for the keywords of all hunts, and its hunts are gathered where it is read.
    """
    words = hunts.select("hunt_id", "name", F.explode("keywords").alias("keyword")).withColumn("keyword", F.lower("keyword"))
    return found_in(findings.select("finding_id", "sale_id", F.lower("description").alias("d")), "d", words, "keyword")


def keyword_sets(hunts: DataFrame) -> DataFrame:
    """words, hunt_id, name: ``words`` names the set of keywords of a hunt, the same for all hunts that want the same."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform("keywords", F.lower), lambda k: k != "")))
    return hunts.select("hunt_id", "name", known.alias("keywords")).where(F.size("keywords") > 0).withColumn("words", F.md5(F.to_json("keywords")))


def set_matches(findings: DataFrame, sets: DataFrame) -> DataFrame:
    """finding_id, sale_id, words: pairs of which any keyword of the set occurs in the finding; however many hunts share a set, it counts once."""
    words = sets.select("words", F.explode("keywords").alias("keyword")).distinct()
    return found_in(findings.select("finding_id", "sale_id", F.lower("description").alias("d")), "d", words, "keyword")


def counts_by_name(matched: DataFrame, sets: DataFrame) -> DataFrame:
    """sale_id, name, n: matches by set are summed by sale before they meet the names of the hunts."""
    names = sets.groupBy("words", "name").agg(F.countDistinct("hunt_id").alias("_hunts"))
    sums = matched.groupBy("sale_id", "words").agg(F.count("*").alias("_n"))
    return sums.join(names, "words").groupBy("sale_id", "name").agg(F.sum(F.col("_n") * F.col("_hunts")).alias("n"))


def hunt_match_counts(findings: DataFrame, hunts: DataFrame) -> DataFrame:
    """Findings per sale and hunt name; hunts of one name add up."""
    sets = keyword_sets(hunts)
    return counts_by_name(set_matches(findings, sets), sets)


def hunt_gate(sales: DataFrame, findings: DataFrame, hunts: DataFrame, owner: str) -> DataFrame:
    """Sales with a finding that matches a hunt of the owner; all sales, and ``no_hunts``, if the owner has none."""
    own = hunts.where(F.col("owner") == owner)
    hit = hunt_matches(findings, own).select("sale_id").distinct()
    none = own.agg((F.count("*") == 0).alias("no_hunts"))
    gated = sales.join(hit.withColumn("_hit", F.lit(True)), "sale_id", "left").crossJoin(F.broadcast(none))  # one row
    return gated.where("no_hunts OR _hit").drop("_hit")


def thumbnail(findings: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """sale_id, finding_id, description: the longest description, of matched findings if there are any; ties by least id."""
    f = findings.select("sale_id", "finding_id", "description")
    hit = matched.select("finding_id").distinct().withColumn("_hit", F.lit(1)) if matched is not None else None
    f = f.join(hit, "finding_id", "left") if hit is not None else f.withColumn("_hit", F.lit(None).cast("int"))
    w = Window.partitionBy("sale_id").orderBy(F.desc(F.coalesce("_hit", F.lit(0))), F.desc(F.length("description")), "finding_id")
    return f.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("sale_id", "finding_id", "description")


def sale_summary(sales: DataFrame, findings: DataFrame, hunts: DataFrame) -> DataFrame:
    """Every sale with its matched findings, matches by hunt name and thumbnail."""
    sets = keyword_sets(hunts)
    pairs = set_matches(findings, sets)
    counts = counts_by_name(pairs, sets).groupBy("sale_id").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("hunt_match_counts"))
    total = pairs.groupBy("sale_id").agg(F.countDistinct("finding_id").alias("total_matched"))
    thumb = thumbnail(findings, pairs).select("sale_id", F.col("finding_id").alias("thumb_finding"), F.col("description").alias("thumb_description"))
    out = sales.join(total, "sale_id", "left").join(counts, "sale_id", "left").join(thumb, "sale_id", "left")
    return out.withColumn("total_matched", F.coalesce("total_matched", F.lit(0)))


def sale_detail(sales: DataFrame, findings: DataFrame, keywords: Column, sale_id: str) -> DataFrame:
    """The findings of one sale with ``matched`` and the sale's counts."""
    f = findings.where(F.col("sale_id") == sale_id).withColumn("matched", keyword_match("description", keywords))
    w = Window.partitionBy("sale_id")
    f = f.withColumn("n_findings", F.count("*").over(w)).withColumn("n_matched", F.count_if("matched").over(w))
    return sales.where(F.col("sale_id") == sale_id).join(f, "sale_id")


def context_digest(sales: DataFrame, findings: DataFrame, k: int = 15) -> DataFrame:
    """sale_id, digest: a paragraph of each sale's k best findings."""
    top = top_per_sale(scored(findings), k).select("sale_id", "rank", "description")
    n = findings.groupBy("sale_id").agg(F.count("*").alias("n"))
    lines = top.groupBy("sale_id").agg(F.array_sort(F.collect_list(F.struct("rank", "description"))).alias("ls"))
    out = sales.join(n, "sale_id").join(lines, "sale_id")
    head = F.concat(F.lit('Sale: "'), "title", F.lit('" ('), "sale_id", F.lit(") - "), F.format_string("%.1f", "distance_miles"), F.lit("mi, "), "city", F.lit(" "), "state")
    dates = F.concat(F.lit("Dates: "), F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string"))
    many = F.concat(F.lit("Findings ("), F.col("n").cast("string"), F.lit(" total, showing top):"))
    each = F.array_join(F.transform("ls", lambda x: F.concat(F.lit("  - "), x["description"])), "\n")
    return out.select("sale_id", "distance_miles", F.concat_ws("\n", head, dates, many, each).alias("digest"))


def sale_images(images: DataFrame, findings: DataFrame) -> DataFrame:
    """Every photo with ``has_finding``; photos that several findings name stay one row."""
    f = findings.select("sale_id", "image_url", F.lit(True).alias("_f"))
    return images.join(f, ["sale_id", "image_url"], "left").groupBy("image_id", "sale_id", "image_url").agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("has_finding"))


def with_thumb(df: DataFrame, image_id: str = "image_id") -> DataFrame:
    return df.withColumn("thumb_url", thumb_url(image_id))
