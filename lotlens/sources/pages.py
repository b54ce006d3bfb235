"""Raw listing pages as tables: links, fields, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import SKIP_ASSETS
from ..functions.text import strip

LISTING = r'href="(/[A-Z]{2}/[^"]+/\d{5}/\d+)"'
URL_PLACE = r"/([A-Z]{2})/([^/]+)/(\d{5})/\d+/?$"
REQUIRED = ("start_date", "end_date", "city", "state", "zip")


def links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = LISTING) -> DataFrame:
    """key, pos, link_id (the last part of the path), href: the first link of each id on each page."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "href"))
    rows = rows.withColumn("link_id", F.element_at(F.split("href", "/"), -1))
    first = Window.partitionBy(key, "link_id").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "pos", "link_id", "href")


def _found(html: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, group), F.lit(""))


def fields(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every page with the fields of a sale and ``missing``, the required ones that it lacks."""
    h, u = F.col(html), F.col(url)
    place = lambda k: _found(u, URL_PLACE, k)
    sale_id = F.element_at(F.split(u, "/"), -1)
    title = F.coalesce(_found(h, '<meta property="og:title" content="([^"]+)"'), _found(h, "<title>([^<]+)</title>"), sale_id)
    out = pages.select(
        *keep, sale_id.alias("sale_id"), strip(F.regexp_replace(title, r"(?i)\s*starts on.*$", "")).alias("title"), u.alias("url"),
        F.substring(_found(h, '"startDate":"([^"]+)"'), 1, 10).alias("start_date"), F.substring(_found(h, '"endDate":"([^"]+)"'), 1, 10).alias("end_date"),
        F.regexp_extract(h, '"addressLine1":"([^"]*)"', 1).alias("address"),
        F.coalesce(_found(h, '"addressLocality":"([^"]+)"'), F.regexp_replace(place(2), "-", " ")).alias("city"),
        F.coalesce(_found(h, '"addressRegion":"([^"]+)"'), place(1)).alias("state"), F.coalesce(_found(h, '"postalCode":"([^"]+)"'), place(3)).alias("zip"),
    )
    return out.withColumn("missing", F.filter(F.array(*(F.when(F.col(c).isNull(), c) for c in REQUIRED)), lambda x: x.isNotNull()))


def details(pages: DataFrame, **how) -> DataFrame:
    """The pages that have every required field."""
    return fields(pages, **how).where("size(missing) = 0").drop("missing")


def rejects(pages: DataFrame, **how) -> DataFrame:
    """The pages that lack a required field, with the fields they lack."""
    return fields(pages, **how).where("size(missing) > 0")


def assets(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = r"""https?://[^"' >]+\.(?:jpg|jpeg|png|webp)""", group: int = 0, skip: list[str] = SKIP_ASSETS) -> DataFrame:
    """key, pos, asset_url: distinct URLs in the order of first occurrence, without those that hold a skipped word."""
    found = F.regexp_extract_all(html, F.lit(f"(?i){pattern}"), F.lit(group))
    kept = F.array_distinct(F.filter(found, lambda x: ~F.lower(x).rlike("|".join(skip)) if skip else F.lit(True)))
    return pages.select(key, F.posexplode(kept).alias("pos", "asset_url"))


def asset_path(directory: str, sale_id: str, url: str) -> Column:
    """<directory>/<sale>/<sha1 of the URL>.jpg"""
    return F.concat_ws("/", F.lit(directory), F.col(sale_id), F.concat(F.sha1(F.col(url)), F.lit(".jpg")))
