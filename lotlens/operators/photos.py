"""Photos: near duplicates, boilerplate, sampling under a budget, findings from responses."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.numbers import hamming
from ..functions.text import has_findings, response_score, strip, strip_tags, top_confidence
from .lineage import settle


def near_pairs(photos: DataFrame, most: int = R.NEAR_BITS, group: str | None = "sale_id", key: str = "image_id", phash: str = "phash") -> DataFrame:
    """a, b, bits: pairs of photos whose hashes differ in at most ``most`` bits, inside a group or (None) everywhere.

    Two hashes that differ in so many bits agree on one of most + 1 blocks of bits, so only photos that share a block are compared, and a
    pair is kept where it first meets.  Where blocks are too narrow to tell hashes apart (under five bits), a group's photos are compared directly,
    those of a large group in a grid of cells.
    """
    n = most + 1
    if group is not None and 64 // n < 5:
        return grid_pairs(photos.where(F.col(phash).isNotNull()).select(group, F.col(key).alias("k"), F.col(phash).alias("h")), most, group)
    edges = [64 * i // n for i in range(n + 1)]
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(phash, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("bits")) for i in range(n)))
    keys = [] if group is None else [group]
    dealt = photos.where(F.col(phash).isNotNull()).select(*keys, F.col(key).alias("k"), F.col(phash).alias("h"), F.explode(blocks).alias("b")).select(*keys, "k", "h", "b.block", "b.bits")
    on = [*keys, "block", "bits"]
    pairs = dealt.withColumnsRenamed({"k": "a", "h": "ha"}).join(dealt.withColumnsRenamed({"k": "b", "h": "hb"}), on).where("a < b")
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    same = [F.when(F.shiftrightunsigned(differ, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) == 0, F.lit(i)) for i in range(n)]
    pairs = pairs.where(F.col("block") == F.coalesce(*same))
    return pairs.withColumn("distance", hamming("ha", "hb")).where(F.col("distance") <= most).select(*keys, "a", "b", "distance")


#: About so many photos of a group meet about so many others under one key.
CELL = 2000


def grid_pairs(rows: DataFrame, most: int, group: str, cell: int = CELL) -> DataFrame:
    """group, a, b, distance of near rows (group, k, h), each pair compared once.

    A group of over ``cell`` rows is cut into parts by a hash of k, and each two parts meet under a key of their own: a row is sent once for
    each part of its group, and no key has more than about ``cell`` rows on either side.
    """
    large = rows.groupBy(group).agg(F.ceil(F.count("*") / cell).cast("int").alias("_parts")).where("_parts > 1")
    # no hint: whether the large groups are few is known when they have been counted, and a large group's rows may then be dealt anew
    rows = rows.join(large, group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("k"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = rows.select(group, F.col("k").alias("a"), F.col("h").alias("ha"), F.col("_own").alias("_i"), every.alias("_j"))
    right = rows.select(group, F.col("k").alias("b"), F.col("h").alias("hb"), F.col("_own").alias("_j"), every.alias("_i"))
    pairs = left.join(right, [group, "_i", "_j"]).where("a < b")
    return pairs.withColumn("distance", hamming("ha", "hb")).where(F.col("distance") <= most).select(group, "a", "b", "distance")


#: The most photos, and in larger groups the most different hashes, of a group that one task takes.
GROUP_LIMIT = 50_000


def stand(hashes: np.ndarray, most: int) -> np.ndarray:
    """Which of different hashes, in order, stay: each that stays is held against the later ones at once."""
    stays = np.ones(len(hashes), bool)
    for i in range(len(hashes)):
        if stays[i]:
            stays[i + 1 :] &= np.bitwise_count((hashes[i + 1 :] ^ hashes[i]).view(np.uint64)) > most
    return stays


def collapse(photos: DataFrame, most: int = R.NEAR_BITS, group: str = "sale_id", order: str = "position", key: str = "image_id", phash: str = "phash", limit: int = GROUP_LIMIT) -> DataFrame:
    """All photos with ``kept``: in order, a photo goes if it is within ``most`` bits of one that stays; without a hash it stays.

    Only the first photo of each hash is compared.  A group of up to ``limit`` photos is settled where its rows meet, so they are sent once.
    """
    large = photos.groupBy(group).agg(F.count("*").alias("_k")).where(F.col("_k") > limit).select(group)
    shape = T.StructType([*photos.schema.fields, T.StructField("kept", T.BooleanType())])

    def mark(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(order, "ascending"), (key, "ascending")])
        kept = rows[phash].is_null().to_numpy()
        known = np.flatnonzero(~kept)
        hashes, first = np.unique(rows[phash].drop_null().to_numpy(), return_index=True)
        at = np.argsort(first)
        kept = kept.copy()
        kept[known[first[at][stand(hashes[at], most)]]] = True
        return rows.append_column("kept", pa.array(kept))

    if large.isEmpty():
        return photos.groupBy(group).applyInArrow(mark, shape)
    out = photos.join(large, group, "left_anti").select(photos.columns).groupBy(group).applyInArrow(mark, shape)
    return out.unionByName(collapse_large(photos.join(large, group, "left_semi").select(photos.columns), most, group, order, key, phash, limit))


def collapse_large(photos: DataFrame, most: int, group: str, order: str, key: str, phash: str, limit: int) -> DataFrame:
    """``collapse`` for groups of many photos: those of up to ``limit`` hashes send only their hashes to one task, the hashes of others are
    settled in rounds of joins over their near pairs."""
    first = Window.partitionBy(group, phash).orderBy(order, key)
    rows = photos.withColumn("_n", F.when(F.col(phash).isNotNull(), F.row_number().over(first)))
    nodes = rows.where("_n = 1").select(group, phash, order, key)
    large = nodes.groupBy(group).agg(F.count("*").alias("_k")).where(F.col("_k") > limit).select(group)
    shape = T.StructType([nodes.schema[group], nodes.schema[phash]])

    def settle_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, key])
        return rows.loc[stand(rows[phash].to_numpy(np.int64), most), [group, phash]]

    kept = nodes.join(large, group, "left_anti").groupBy(group).applyInPandas(settle_group, shape)
    if not large.isEmpty():
        kept = kept.unionByName(survivors(nodes.join(large, group, "left_semi"), most, group, order, key, phash))
    out = rows.join(kept.withColumn("_kept", F.lit(True)), [group, phash], "left")
    stays = F.col(phash).isNull() | ((F.col("_n") == 1) & F.coalesce("_kept", F.lit(False)))
    return out.select(*photos.columns, stays.alias("kept"))


def survivors(nodes: DataFrame, most: int, group: str, order: str, key: str, phash: str) -> DataFrame:
    """group, phash of the hashes that stay.  In each round those stay that no earlier open one is near, and those near them go."""
    at = nodes.select(group, F.col(phash).alias("h"), F.struct(order, key).alias("at"))
    pairs = near_pairs(nodes, most, group, phash, phash).select(group, "a", "b")
    pairs = pairs.join(at.withColumnsRenamed({"h": "a", "at": "at_a"}), [group, "a"]).join(at.withColumnsRenamed({"h": "b", "at": "at_b"}), [group, "b"])
    before = F.col("at_a") < F.col("at_b")
    pairs = settle(pairs.select(group, F.when(before, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("h")))
    left, kept = settle(at.select(group, "h")), []
    while not left.isEmpty():
        stay = settle(left.join(pairs.select(group, "h"), [group, "h"], "left_anti"))
        kept.append(stay)
        gone = pairs.join(stay.withColumnRenamed("h", "earlier"), [group, "earlier"], "left_semi").select(group, "h")
        left = settle(left.join(stay, [group, "h"], "left_anti").join(gone, [group, "h"], "left_anti"))
        pairs = settle(pairs.join(left, [group, "h"], "left_semi").join(left.withColumnRenamed("h", "earlier"), [group, "earlier"], "left_semi").select(group, "earlier", "h"))
    return reduce(DataFrame.union, kept, nodes.select(group, F.col(phash).alias("h")).limit(0)).withColumnRenamed("h", phash)


def boilerplate(photos: DataFrame, fingerprint: str = "phash", group: str = "sale_id", least: int = R.BOILERPLATE_SALES) -> DataFrame:
    """All photos with ``is_boilerplate``: a fingerprint of at least ``least`` different groups; none is never one."""
    many = photos.where(F.col(fingerprint).isNotNull()).select(fingerprint, group).distinct().groupBy(fingerprint).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return photos.join(many.select(fingerprint, F.lit(True).alias("_b")), fingerprint, "left").withColumn("is_boilerplate", F.coalesce("_b", F.lit(False))).drop("_b")


def pending_embeddings(photos: DataFrame, limit: int = 10_000) -> DataFrame:
    """Photos to embed next: no vector yet, a thumbnail, no boilerplate."""
    return photos.where("embedding IS NULL AND thumbnail_path IS NOT NULL AND NOT is_boilerplate").orderBy("image_id").limit(limit)


#: Rows that are looked at for large groups, the share of them that makes a group large, and into how many parts it is cut.
LOOK, SHARE, PARTS = 10_000, 200, 64


def large_groups(df: DataFrame, group: str, order: str, look: int = LOOK) -> dict:
    """group -> values of ``order`` that cut it into parts of about one size, for groups with over 1 / SHARE of ``look`` rows.

    The rows are the first by a hash, so that the cuts depend on the table alone; a table with fewer rows has no large group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o")).where("g IS NOT NULL AND o IS NOT NULL")
    seen: dict = {}
    for g, o in (found := rows.orderBy(F.xxhash64("g", "o"), "g", "o").limit(look).collect()):
        seen.setdefault(g, []).append(o)
    if len(found) < look:
        return {}
    return {g: sorted(set(os))[:: -(-len(os) // PARTS)][1:] for g, os in seen.items() if len(os) * SHARE > look}


def positions(df: DataFrame, group: str, order: str, look: int = LOOK) -> DataFrame:
    """Adds position (from 0), total and position_pct = position / max(total - 1, 1).

    A group with a large share of all rows is cut at values of its order and numbered part by part; what lies in earlier parts is added.
    """
    large = large_groups(df, group, order, look)
    part = F.lit(0)
    for g, cuts in large.items():
        held = F.array(*map(F.lit, cuts))
        part = F.when(F.col(group) == F.lit(g), F.size(F.filter(held, lambda c: c <= F.col(order)))).otherwise(part)
    out = df.withColumn("_part", part)
    w = Window.partitionBy(group, "_part")
    out = out.withColumn("position", F.row_number().over(w.orderBy(order)) - 1).withColumn("total", F.count("*").over(w))
    if large:
        held = df.where(F.col(group).isin(list(large))).groupBy(group, part.alias("_part")).agg(F.count("*").alias("_k"))
        each = Window.partitionBy(group)
        held = held.select(group, "_part", (F.sum("_k").over(each.orderBy("_part")) - F.col("_k")).alias("_before"), F.sum("_k").over(each).alias("_all"))
        # fewer than SHARE groups of at most PARTS parts
        out = out.join(F.broadcast(held), [group, "_part"], "left")
        out = out.withColumns({"position": (F.col("position") + F.coalesce("_before", F.lit(0))).cast("int"), "total": F.coalesce("_all", "total")}).select(*df.columns, "position", "total")
    return out.drop("_part").withColumn("position_pct", F.col("position") / F.greatest(F.col("total") - 1, F.lit(1)))


def segments(df: DataFrame) -> DataFrame:
    """Adds segment: lead (the first quarter, one at least), tail (from 70 per cent on) or middle, from position and total."""
    lead = F.greatest(F.lit(1), F.ceil(F.col("total") * R.LEAD_SHARE))
    tail = F.greatest(F.floor(F.round(F.col("total") * R.TAIL_START, 9)), lead)
    return df.withColumn("segment", F.when(F.col("position") < lead, "lead").when(F.col("position") >= tail, "tail").otherwise("middle"))


def cap_repeats(df: DataFrame, group: str, response: str = "response", order: str = "position", most: int = R.MOST_REPEATS) -> DataFrame:
    """At most ``most`` rows of each group with one response, trimmed and in any case; the first ones stay."""
    w = Window.partitionBy(group, F.lower(strip(response))).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def tail_order(group: str, key: str, seed: str) -> Column:
    """The order in which a tail is probed: by a hash with a seed, so that a rerun probes the same photos."""
    return F.md5(F.concat(F.lit(seed), F.col(group), F.lit(":"), F.col(key)))


def adaptive_sampling(df: DataFrame, group: str, key: str, seed: str = "0", probe: int = R.TAIL_SAMPLE) -> DataFrame:
    """Rows (position, total, response) with score, phase of their group and ``processed``.

    The lead decides: all of it seen or a score of 0.8 or more, or at least 0.1, means FULL; below 0.1 some of the tail is probed; a
    probe that scores is TAIL_PROBE and all rows are processed, else EARLY_STOP with lead and probe processed.
    """
    rows = segments(df).withColumn("score", response_score("response"))
    place = F.struct(tail_order(group, key, seed), key, "position")
    # the numbers are cut off before the shuffle, and groups are summed before it, so that a group with a large share of all rows is no task's burden
    first = rows.where("segment = 'tail'").withColumn("_place", place).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_place"))).where(F.col("_n") <= probe)
    tail = first.groupBy(F.col(group).alias("_other")).agg(F.max("_place").alias("_cut"), F.round(F.sum("score"), 6).alias("_tail"))
    lead = F.when(F.col("segment") == "lead", F.col("score")).otherwise(0.0)
    sums = rows.groupBy(F.col(group).alias("_group")).agg(F.round(F.sum(lead), 6).alias("_lead"), (F.count_if(F.col("segment") == "lead") >= F.max("total")).alias("_all_lead"))
    sums = sums.join(tail, F.col("_group").eqNullSafe(F.col("_other")), "left").drop("_other")
    out = rows.join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    out = out.withColumn("probed", F.coalesce((F.col("segment") == "tail") & (place <= F.col("_cut")), F.lit(False)))
    full = F.col("_all_lead") | (F.col("_lead") >= R.SWITCH_SCORE)
    out = out.withColumn("phase", F.when(full, "FULL").when(F.col("_tail") > 0, "TAIL_PROBE").otherwise("EARLY_STOP"))
    return out.withColumn("processed", (F.col("phase") != "EARLY_STOP") | (F.col("segment") == "lead") | F.col("probed")).drop("_lead", "_tail", "_all_lead", "_cut")


def emit_findings(df: DataFrame, group: str, error: str | None = None) -> DataFrame:
    """Findings of the rows (position, total, response): no error, something found, repeats capped, tags taken off."""
    ok = df.where(has_findings("response"))
    ok = ok.where(F.col(error).isNull()) if error else ok
    out = cap_repeats(ok, group).withColumn("description", strip_tags("response")).withColumn("confidence", top_confidence("response"))
    return out.withColumn("image_position_pct", F.col("position") / F.greatest(F.col("total") - 1, F.lit(1)))


def escalation_evidence(df: DataFrame, group: str, k: int = R.EVIDENCE) -> DataFrame:
    """The k best responses of groups with findings and a score in the uncertain zone; ``evidence_rank`` from 1, ties by position."""
    # every line that counts has points, so a response has findings if it has a score
    rows = df.withColumn("score", response_score("response")).withColumn("found", F.col("score") > 0)
    g = Window.partitionBy(group)
    rows = rows.withColumn("group_score", F.round(F.sum("score").over(g), 6)).withColumn("n_found", F.count_if("found").over(g))
    rows = rows.where("found AND n_found > 0").where((F.col("group_score") >= R.ESCALATE_MIN) & (F.col("group_score") < R.ESCALATE_MAX))
    return rows.withColumn("evidence_rank", F.row_number().over(g.orderBy(F.desc("score"), "position"))).where(F.col("evidence_rank") <= k)


def budget_select(df: DataFrame, group: str, score: str, key: str, budget: float, cost: float, floor: int = 4) -> DataFrame:
    """The budget's worth of rows: first each group's ``floor`` best, then the best of all; ``pick`` from 1."""
    k = int(Decimal(str(budget)) / Decimal(str(cost)))  # in decimals: 0.3 pays for three at 0.1
    best = Window.partitionBy(group).orderBy(F.desc(score), key)
    rows = df.withColumn("tier", F.when(F.row_number().over(best) <= floor, 0).otherwise(1))
    return rows.orderBy("tier", F.desc(score), key).limit(k)


def recall_at(df: DataFrame, rank: str, relevant: str, ks: list[int]) -> DataFrame:
    """k, recall: what part of the relevant rows lies within the first k ranks.  Counts by rank first, so nothing is multiplied by len(ks)."""
    hits = [F.count_if(F.col(relevant) & (F.col(rank) <= k)) for k in ks]
    one = df.agg(F.array(*hits).alias("h"), F.count_if(relevant).alias("n"))
    ks_col = F.array(*(F.lit(k) for k in ks))
    return one.select(F.posexplode(ks_col).alias("i", "k"), "h", "n").select("k", F.when(F.col("n") > 0, F.round(F.get("h", F.col("i")) / F.col("n"), 6)).otherwise(0.0).alias("recall"))
