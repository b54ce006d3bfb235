"""Columns and rows of normalised items: maker, category, era, desirability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .text import WORD_END, WORD_START, col, core, factored, is_junk, lines, once, strip


def starts(low: Column, words: list[str], letter: str) -> Column:
    """For each place of a lower-case text the first of the words that begins there and stands by itself between ``letter``s, read in one pass."""
    first = "".join(sorted({R.quoted(w[0]) for w in words}))
    pattern = f"(?:^|[^{letter}])(?=[{first}])(?=({factored([R.quoted(w) for w in words])})(?![{letter}]))"
    return F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda x: F.array_position(F.array(*map(F.lit, words)), x).cast("int"))


def makers(line: Column | str) -> Column:
    """array<struct<maker, raw>>: each maker once, by its longest spelling in the line; makers in the order of those spellings.

    Spellings that begin alike name one maker.
    """
    spellings, owners = zip(*R.aliases(), strict=True)  # longest first
    raw, owner = (lambda r, names=names: F.element_at(F.array(*map(F.lit, names)), r) for names in (spellings, owners))
    ranks = F.sort_array(F.array_distinct(starts(F.lower(F.coalesce(col(line), F.lit(""))), list(spellings), "a-z0-9")))
    longest = lambda rs: F.aggregate(rs, F.array().cast("array<int>"), lambda kept, r: F.when(F.exists(kept, lambda k: owner(k) == owner(r)), kept).otherwise(F.concat(kept, F.array(r))))
    first = once(ranks, lambda rs: F.when(F.size(rs) < 2, rs).otherwise(longest(rs)))
    return F.transform(first, lambda r: F.struct(owner(r).alias("maker"), raw(r).alias("raw")))


def category(line: Column | str) -> Column:
    """The first category with a keyword as a word of its own, else ``other``."""
    owner = {k: name for name, keywords in reversed(R.CATEGORIES.items()) for k in keywords}
    words = [k for name, keywords in R.CATEGORIES.items() for k in keywords if owner[k] == name]
    found = F.array_min(starts(F.lower(col(line)), words, r"\w"))
    return F.coalesce(F.get(F.array(*(F.lit(owner[w]) for w in words)), found - 1), F.lit(R.OTHER))


def era(line: Column | str) -> Column:
    """A decade, else a year after circa, else the first named period, else null."""

    def read(low: Column) -> Column:
        # the plain search settles most periods before the pattern runs
        held = lambda x: F.contains(low, F.lit(x))
        got = lambda p, k: F.nullif(F.regexp_extract(low, p, k), F.lit(""))
        decade = F.when(held("0s"), F.coalesce(got(rf"{WORD_START}((18|19|20)\d0s){WORD_END}", 1), got(rf"(?:^|\s)['’](\d0s){WORD_END}", 1)))
        circa = F.when(held("circa"), F.concat(F.lit("circa "), got(rf"{WORD_START}circa\s+(1[89]\d{{2}}|20\d{{2}}){WORD_END}", 1)))
        named = [F.when(held(core(p)) & low.rlike(f"{WORD_START}{p}{WORD_END}"), label) for p, label in R.ERAS]
        return F.coalesce(decade, circa, *named)

    return once(F.lower(col(line)), read)


def desirability(n_makers: Column, period: Column | str) -> Column:
    return F.when((n_makers > 0) | F.coalesce(col(period).isin(R.PREMIUM_ERAS), F.lit(False)), "high").otherwise("med")


def id_confidence(confidence: Column | str) -> Column:
    """high and low as they are; medium and none are med."""
    c = col(confidence)
    return F.when(c.isin("high", "low"), c).otherwise("med")


def extract_items(findings: DataFrame, description: str = "description", confidence: str = "confidence", keep: tuple[str, ...] = ("finding_id",)) -> DataFrame:
    """One row per line that is neither blank nor junk."""
    full = F.filter(F.transform(lines(description), strip), lambda x: (x != "") & ~is_junk(x, trim=False))
    # an outer explode, since Spark works the lines of the other out a second time to drop texts without any
    rows = findings.select(*keep, F.col(confidence).alias("_c"), F.posexplode_outer(full).alias("line_no", "item_desc")).where("line_no IS NOT NULL")
    rows = rows.withColumn("_m", makers("item_desc")).withColumn("era", era("item_desc"))
    first = F.get("_m", F.lit(0))
    return rows.select(
        *keep, "line_no", first["maker"].alias("maker"), first["raw"].alias("maker_raw"), category("item_desc").alias("category"), "era",
        desirability(F.size("_m"), "era").alias("desirability"), F.transform("_m", lambda m: m["maker"]).alias("matched_lexicon"), "item_desc",
        F.when(F.size("_m") > 0, "lexicon").otherwise("vlm").alias("source"), id_confidence("_c").alias("id_confidence"),
    )
