"""Evaluation of models and backends on recorded answers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import has_findings, keyword_match, matches, once, specific, strip
from .lineage import settle


def flags(results: DataFrame) -> DataFrame:
    """detected, keyword_hit, specific (null where it does not apply), format_ok of rows (raw, category, expected_keywords, expect_nothing)."""
    fine = once(strip("raw"), lambda t: (F.length(t) <= 1000) & ~matches(t, f"^({R.NO_ANSWER.lower()})"))
    return results.withColumns({
        "detected": has_findings("raw", limit=1000, trim_lines=False),
        "keyword_hit": F.col("expect_nothing") | keyword_match("raw", "expected_keywords"),
        "specific": F.when(F.col("category").isin(R.SPECIFIC_CATEGORIES), specific("raw")),
        "format_ok": fine,
    })


def share(hits: Column, of: Column) -> Column:
    """A ratio of two counts, 0 where there is nothing."""
    return F.round(F.coalesce(hits / F.nullif(of, F.lit(0)), F.lit(0.0)), 6)


def _counts() -> dict[str, Column]:
    ok = F.col("error").isNull()
    right = F.col("detected") != F.col("expect_nothing")
    return {
        "n": F.count_if(ok), "right": F.count_if(ok & right), "eligible": F.count_if(ok & ~F.col("expect_nothing")),
        "hits": F.count_if(ok & ~F.col("expect_nothing") & F.col("keyword_hit")), "keyword": F.count_if(ok & F.col("keyword_hit")),
        "specific_of": F.count_if(ok & F.col("specific").isNotNull()), "specific_hits": F.count_if(ok & F.coalesce(F.col("specific"), F.lit(False))), "format": F.count_if(ok & F.col("format_ok")),
    }


def summary(flagged: DataFrame, *by: str) -> DataFrame:
    """Accuracy, recall, specificity, format compliance and mean latency; errors are left out."""
    c = _counts()
    g = flagged.groupBy(*by) if by else flagged.groupBy()
    return g.agg(
        c["n"].alias("total_images"), share(c["right"], c["n"]).alias("detection_acc"), share(c["hits"], c["eligible"]).alias("keyword_recall"),
        share(c["specific_hits"], c["specific_of"]).alias("specificity_rate"), share(c["format"], c["n"]).alias("format_compliance"),
        F.round(F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col("duration_ms"))), F.lit(0.0)), 6).alias("avg_duration_ms"),
    )


def by_category(flagged: DataFrame, *by: str) -> DataFrame:
    """Counts per category; every category of any row is listed."""
    c = _counts()
    return flagged.groupBy(*by, "category").agg(
        c["n"].alias("total"), c["right"].alias("detected"), c["keyword"].alias("keyword_hit"), c["specific_hits"].alias("specific"),
        c["specific_of"].alias("specific_total"), c["format"].alias("format_ok"),
    )


METRICS = ["detection_acc", "keyword_recall", "specificity_rate", "format_compliance", "avg_duration_ms"]


def compare(summaries: DataFrame, run: str, runs: list[str]) -> DataFrame:
    """Metrics as rows, runs as columns."""
    long = summaries.select(run, *METRICS).unpivot(run, METRICS, "metric", "value")
    return long.groupBy("metric").pivot(run, runs).agg(F.first("value"))


def latency(records: DataFrame, order: str = "seq", duration: str = "duration_s") -> DataFrame:
    """Cold start (the first record) and nearest-rank p50, p95, mean and count of the others."""
    # the first record is the least of the order: one number, found without sorting the table in one task
    rows = records.crossJoin(F.broadcast(records.agg(F.min(order).alias("_first"))))
    rest = F.when(F.col(order) > F.col("_first"), F.col(duration))
    sums = rows.agg(F.min(F.when(F.col(order) == F.col("_first"), F.col(duration))).alias("cold_start_s"), F.round(F.coalesce(F.avg(rest), F.lit(0.0)), 6).alias("avg_s"), F.count(rest).alias("n"))
    ranked = nearest_ranks(rows.where(F.col(order) > F.col("_first")), duration, {"p50": 0.5, "p95": 0.95})
    return sums.crossJoin(F.broadcast(ranked)).select("cold_start_s", *(F.coalesce(p, F.lit(0.0)).alias(p) for p in ("p50", "p95")), "avg_s", "n")  # one row each


#: The most distinct values that are put in order in one task, and the number of pivots of a round (a power of two, less one).
IN_ORDER, PIVOTS = 100_000, 255


def _holding(counts: DataFrame, rank: int, most: int) -> tuple[DataFrame, int]:
    """(part, before): at most ``most`` neighbouring values (v, k) with the one of that rank among them, and how many rows lie below them.

    Each round asks a quantile sketch for pivots that part the values left into equal numbers, counts the rows between pivots exactly, and goes on
    with the values between two of them: by the values' order, not by their size, so that outliers do no harm.
    """
    part, before = counts, 0
    while True:
        n = part.count()
        if n <= most:
            return part, before
        pivots = sorted(set(part.agg(F.percentile_approx("v", [k / (PIVOTS + 1) for k in range(1, PIVOTS + 1)], 10_000)).first()[0]))
        held, size = F.array(*(F.lit(p) for p in pivots)), 1 << len(pivots).bit_length()
        # how many pivots are less than the value, by halving steps
        place = part.withColumn("p", F.lit(0))
        while size > 1:
            size //= 2
            place = place.withColumn("p", F.when(F.coalesce(F.get(held, F.col("p") + (size - 1)) < F.col("v"), F.lit(False)), F.col("p") + size).otherwise(F.col("p")))
        for p, m, kinds in sorted(place.groupBy("p").agg(F.sum("k"), F.count("*")).collect()):
            if before + m >= rank:
                break
            before += m
        low, high = (pivots[p - 1] if p else None), (pivots[p] if p < len(pivots) else None)
        if kinds == n:
            raise RuntimeError("the pivots part nothing")
        part = part if low is None else part.where(F.col("v") > low)
        part = part if high is None else part.where(F.col("v") <= high)


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], most: int = IN_ORDER) -> DataFrame:
    """One row: for each name the least value that at least that share of the rows do not exceed (null without rows).

    Values are counted first; only ``most`` distinct values around each rank are put in order.
    """
    counts = settle(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k")))
    total = counts.agg(F.sum("k")).first()[0]
    out = None
    for name, share_ in shares.items():
        rank = ceil(round((total or 0) * share_, 9))
        part, before = _holding(counts, rank, most)
        upto = part.withColumn("upto", before + F.sum("k").over(Window.orderBy("v")))  # at most ``most`` rows
        one = upto.agg(F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def throughput(records: DataFrame, elapsed: Column) -> DataFrame:
    return records.agg(F.round(F.count("*") / elapsed, 6).alias("per_second"))


def agreement(baseline: DataFrame, candidate: DataFrame, key: str = "image_url", order: str = "seq") -> DataFrame:
    """How many of the baseline's findings the candidate has too; of repeated candidates the last counts."""
    last = candidate.groupBy(key).agg(F.max_by("has_findings", order).alias("_c"))
    rows = baseline.where("has_findings").join(last, key, "left")
    return rows.agg(
        F.count("*").alias("baseline_hits"), F.count_if("_c").alias("both_hit"), share(F.count_if("_c"), F.count("*")).alias("rate"),
        F.count_if(F.col("_c").isNotNull()).alias("matched"), F.count_if(F.col("_c").isNull()).alias("unmatched"),
    )


def training_labels(outcomes: DataFrame, images: DataFrame, items: DataFrame) -> DataFrame:
    """image_id, label: every photo of a wasted sale is negative; positives come from items that a human confirmed; a good sale says nothing."""
    bad = outcomes.where("outcome = 'waste'").select("sale_id").distinct()
    negative = images.join(bad, "sale_id", "left_semi").select("image_id", F.lit(0).alias("label"))
    positive = items.where("source = 'human'").select("image_id").distinct().withColumn("label", F.lit(1))
    return negative.unionByName(positive)


def first_in(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("_n = 1").drop("_n")
