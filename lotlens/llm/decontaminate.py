"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask takes some of a window's tokens and ignores the others, so that a hit survives substitutions at the ignored places.  Hashes of
the benchmark's masked windows are joined with those of the documents; around each hit the words themselves are compared, and the hit
counts if some stretch of ``window`` tokens (the whole item, if shorter) agrees in ``agree`` percent of its places.

No overlap is missed: for items of ``window`` tokens or more the masks leave a window whole however the allowed substitutions fall
(``covered`` tries them all), and every length of shorter items has masks of its own, one more than substitutions are allowed, which part
the places among them.

All is done where the documents are scanned: the benchmark's seeds come with the words around them, so that a hit is verified in the
row that finds it, and only overlaps are shuffled.  Places of the benchmark with one and the same surrounding are compared once.  The
benchmark is the stated query set; beyond SEND seeds or SEND_BYTES bytes it is sent in blocks, one scan of the documents each.

Defined cases: a null or empty text has no hits; an item of no words cannot be found, one of one to four words is found where it stands
unchanged; repeated rows are found alike; empty tables give no overlaps; rows with a null id are compared too; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: 1 takes a token, 0 ignores it.  Every way to substitute two of 13 tokens leaves a window of one of these whole.
MASKS = ("11101011", "110100111")
#: The most seeds, and bytes of their surroundings, that are broadcast at once.
SEND, SEND_BYTES = 200_000, 32_000_000
#: Document ids (8 bytes each) that are broadcast; more are joined by shuffle.
SEND_IDS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, lower-cased by the engine's lower; no word: an empty array."""
    text = F.lower(F.coalesce(text, F.lit("")))
    # runs of white space as one blank: cutting at a single character is far cheaper than cutting at a pattern
    plain = F.trim(F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), " +", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def allowed(n: int, agree: int) -> int:
    """How many of n places may differ."""
    return n - math.ceil(n * agree / 100)


def covered(masks, window: int, most: int) -> bool:
    """True if every choice of ``most`` of ``window`` places leaves some window of some mask untouched."""
    takes = [[i for i, c in enumerate(m) if c == "1"] for m in masks]
    seeds = [{s + t for t in take} for m, take in zip(masks, takes) for s in range(window - len(m) + 1)]
    return all(any(not seed & set(gone) for seed in seeds) for gone in itertools.combinations(range(window), most))


def own_masks(n: int, agree: int) -> list[str]:
    """Masks of a short item's whole length: one more than substitutions are allowed, each with the places of one remainder."""
    k = allowed(n, agree) + 1
    return ["".join("1" if i % k == r else "0" for i in range(n)) for r in range(k)]


def seed(w: Column, at: Column, number: int, mask: str) -> Column:
    """The hash of the tokens that the mask takes from place ``at`` on; null where the window ends beyond the text."""
    taken = [F.get(w, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(w), F.xxhash64(F.lit(number), *taken))


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", masks=MASKS, window: int = 13, agree: int = 80) -> DataFrame:
    """doc_id, item_id, n_agree, n_compared: the best stretch of every document and item that overlap."""
    if not covered(masks, window, allowed(window, agree)):
        raise ValueError("these masks would miss overlaps of that window and agreement")
    items = settle(items.select(F.col(item_id).cast("long").alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0))
    size = F.size("iw")
    # which lengths of short items occur: fewer than ``window`` numbers
    short = sorted(r[0] for r in items.where(size < window).select(size).distinct().toLocalIterator())
    kinds = [(m, window, size >= window) for m in masks] + [(m, n, size == n) for n in short for m in own_masks(n, agree)]
    parts = []
    for k, (mask, width, which) in enumerate(kinds):
        before = width - len(mask)
        held = F.array(*(F.get("iw", F.col("i_at") - before + j) for j in range(width + before)))
        places = items.where(which).select("item_id", "iw", F.posexplode("iw").alias("i_at", "_"))
        parts.append(places.select(seed(F.col("iw"), F.col("i_at"), k, mask).alias("seed"), F.lit(width).alias("width"), F.lit(before).alias("before"), held.alias("held"), "item_id").where("seed IS NOT NULL"))
    spread = parts[0]
    for part in parts[1:]:
        spread = spread.union(part)
    spread = settle(spread.groupBy("seed", "width", "before", "held").agg(F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull()).alias("nameless")))
    n, held = spread.select(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("held", "  ")) + F.size("items") * 8), F.lit(0))).first()
    blocks = max(1, -(-n // SEND), -(-held // SEND_BYTES))

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), "text").where(F.length("text") > 0).select("doc_id", words(F.col("text")).alias("w"))
    # outer, lest Spark adds a test of the size and cuts every text twice; a text without words has no seed
    places = texts.select("doc_id", "w", F.posexplode_outer("w").alias("at", "_"))
    seeds = places.select("doc_id", "w", "at", F.explode(F.array(*(seed(F.col("w"), F.col("at"), k, mask) for k, (mask, _, _) in enumerate(kinds)))).alias("seed"))
    most = max(width - len(mask) for mask, width, _ in kinds)
    around = F.array(*(F.get("w", F.col("at") + j) for j in range(-most, max(width for _, width, _ in kinds))))
    same = F.transform("held", lambda x, j: F.coalesce(F.get("around", most - F.col("before") + j) == x, F.lit(False)).cast("int"))
    # a stretch lies within the item: its first and its last word exist
    whole = F.filter(F.sequence(F.lit(0), F.col("before")), lambda s: F.get("held", s).isNotNull() & F.get("held", s + F.col("width") - 1).isNotNull())
    sums = F.transform(whole, lambda s: F.aggregate(F.slice("same", s + 1, F.col("width")), F.lit(0), lambda a, x: a + x))
    out = None
    for b in range(blocks):
        block = spread if blocks == 1 else spread.where(F.pmod("seed", F.lit(blocks)) == b)
        # first who has a seed at all, in compiled code; only a hit takes its surrounding along
        hits = seeds.join(F.broadcast(block.select("seed").distinct()), "seed", "left_semi").select("doc_id", "seed", around.alias("around"))
        near = hits.join(F.broadcast(block), "seed").select("doc_id", "items", "nameless", "width", "before", "held", same.alias("same"))
        near = near.select("doc_id", "items", "nameless", F.array_max(sums).alias("n_agree"), F.col("width").alias("n_compared")).where(F.col("n_agree") * 100 >= F.col("n_compared") * agree)
        ids = F.when(F.col("nameless"), F.concat("items", F.array(F.lit(None).cast("long")))).otherwise(F.col("items"))
        near = near.select("doc_id", F.explode(ids).alias("item_id"), "n_agree", "n_compared")
        out = near if out is None else out.union(near)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_agree").cast("long").alias("n_agree"), F.max("n_compared").cast("long").alias("n_compared"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """All columns of the rows that overlap with no item; rows with a null doc_id stay.

    Each row is judged by its own text: a row is known by its id and text together, not by its id.
    """
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("_row")
    found = settle(overlaps(docs.select(row, "text").where("_row IS NOT NULL"), items, doc_id="_row", **how).select(F.col("doc_id").alias("_row")).distinct())
    held = docs.select(F.struct("*").alias("_d"), row)
    held = held.join(F.broadcast(found) if found.count() <= SEND_IDS else found, "_row", "left_anti")
    return held.select(*(F.col(f"_d.`{c}`").alias(c) for c in docs.columns))
