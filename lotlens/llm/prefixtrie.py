"""Conversation prefix trie by van Emde Boas recursion: sequences of turns are cut at half depth, cut prefixes are named, the upper trie and the
lower forests are built side by side at every level of the recursion, and totals are grafted upward.

``rebuilt`` gives the turns of conversations that share the head of another one; ``trie`` gives the nodes of the trie of any such sequences.
Nodes are distinct prefixes; a node is known by its least member and its depth.

A name is the MD5 of what it names: of a turn, or of a cut prefix and what follows it up to a cut of the level below.  Names depend on depth
and content alone, so equal prefixes have equal names wherever they are worked out.  Up to 64 depths are cut within one row; the spans of a longer
sequence are a sequence themselves, which the same function names.  Totals go the other way: at each level the nodes at the cuts give the totals of
their lower trees to their ancestors in the upper one, in one join and one sum, so that each depth gives to log2(depths) levels and not to all depths above.

Defined cases: rows with a null conv_id are left out; a null role or text is empty; turns with one number are ordered by the MD5 of role and text, a
null turn comes first; repeated rows are turns of their own; a conversation may be of any length, and one without turns ends at the root; an empty
table has no node; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_text, join_hot, settle

#: 2**SPAN depths are cut in one row; so many member rows of one cut meet in one task; so many ids are joined in one text.
SPAN, MEET, JOINED = 6, 4096, 8192


def digest(*parts: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(F.concat(*parts)))


def turn_name(role: Column, text: Column) -> Column:
    """The name of a turn; the length parts role from text."""
    return digest(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0 within the conversation), name, size (code points) of every turn; settled.

    Rows are sorted by ranges of (conversation, turn), so a conversation of very many turns lies in several tasks; each counts its own rows and
    the counts of earlier ranges are added.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_name(role, text).alias("name"), F.length(text).cast("long").alias("size"))
    # equal rows are told apart by where they were read, so that they too can be dealt to several ranges
    order = ["conv_id", F.col("turn").asc_nulls_first(), "name", "_at"]
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "name", "size", F.spark_partition_id().alias("part"))

    def count(batches):
        last, n = None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            i = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if last == ids[0]:
                i[: starts[1] if len(starts) > 1 else len(ids)] += n
            last, n = ids[-1], int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int64())], ["conv_id", "name", "size", "part", "i"])

    rows = settle(rows.mapInArrow(count, "conv_id long, name binary, size long, part int, i long"))
    held = rows.groupBy("conv_id", "part").agg((F.max("i") + 1).alias("k"))
    before = held.withColumn("before", F.sum("k").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("k")).where("before > 0")
    # only the first conversation of a range can have begun in an earlier one: a row for each range at most
    out = rows.join(F.broadcast(before.select("conv_id", "part", "before")), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "name", "size")


def head_length(conv_id: str = "conv_id", most: int = 6) -> Column:
    """How many turns a conversation takes from the head of another: crc32 of the decimal id, modulo ``most``."""
    return (id_text(column=conv_id) % most).cast("long")


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): conv_id, depth (from 1), name, size of rebuilt conversations, and conv_id of all of them; settled.

    Conversation c has the first h turns of c - c % ``block`` and then its own after its first h, where h is ``head_length``.
    """
    turns = numbered(conversations)
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": head_length(most=most), "base": F.col("conv_id") - F.col("conv_id") % block})
    # under ``most`` turns of every block-th conversation, which at most 2 * block conversations take
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("i") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "name", "size"))).alias("head"))
    ids = ids.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast("array<struct<i:bigint,name:binary,size:bigint>>")).otherwise(F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    ids = settle(ids.select("conv_id", "n", "h", "head"))
    taken = ids.select("conv_id", F.inline("head")).select("conv_id", (F.col("i") + 1).alias("depth"), "name", "size")
    own = turns.where(F.col("i") >= head_length(most=most))
    own = join_hot(own, ids.select("conv_id", "n", "h", F.size("head").alias("_n")), ["conv_id"])
    own = own.select("conv_id", (F.col("_n") + F.col("i") - F.col("h") + 1).alias("depth"), "name", "size")
    return settle(taken.unionByName(own)), ids.select("conv_id")


def prefix_names(rows: DataFrame, longest: int) -> DataFrame:
    """conv_id, at, name of the first at + 1 members, for rows (conv_id, at from 0, name); ``longest`` is the greatest number of members."""
    spans = rows.groupBy("conv_id", F.shiftright("at", SPAN).alias("span")).agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("s"))
    spans = spans.select("conv_id", "span", F.transform("s", lambda x: x["name"]).alias("names"))
    for k in range(min(SPAN, max(longest - 1, 0).bit_length())):
        # of each pair of halves the lower one goes under the name of the upper one's last prefix
        spans = spans.withColumn("names", F.transform("names", lambda x, i: F.when(F.shiftright(i, k).bitwiseAND(F.lit(1)) == 1, digest(F.get("names", F.shiftleft(F.shiftright(i, k), k) - 1), x)).otherwise(x)))  # noqa: B023
    if longest > 1 << SPAN:
        spans = settle(spans)
        whole = spans.select("conv_id", F.col("span").alias("at"), F.element_at("names", -1).alias("name"))
        above = prefix_names(whole, -(-longest >> SPAN) if longest % (1 << SPAN) == 0 else (longest >> SPAN) + 1)
        above = above.select("conv_id", (F.col("at") + 1).alias("span"), F.col("name").alias("_above"))
        spans = spans.join(above, ["conv_id", "span"], "left").withColumn("names", F.when(F.col("_above").isNull(), F.col("names")).otherwise(F.transform("names", lambda x: digest(F.col("_above"), x))))
    return spans.select("conv_id", "span", F.posexplode("names").alias("_i", "name")).select("conv_id", (F.shiftleft("span", SPAN) + F.col("_i")).alias("at"), "name")


def totals(values: DataFrame, members: DataFrame, deepest: int, names: list[str]) -> DataFrame:
    """node, depth and the sums of ``names`` over each node's subtree, from their values at each node; settled.

    ``members`` (conv_id, depth, node, length) says which node each conversation passes at each depth.
    """
    sums = settle(values)
    for k in range(deepest.bit_length()):
        half = 1 << k
        places = max(1, half // MEET)
        cuts = sums.where(F.col("depth") % (2 * half) == half).select(F.col("node").alias("conv_id"), F.col("depth").alias("cut"), *names, F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("_place"))
        above = members.where((F.col("length") >= half) & (F.shiftright("depth", k).bitwiseAND(F.lit(1)) == 0))
        above = above.select("conv_id", "node", "depth", (F.shiftleft(F.shiftright("depth", k), k) + half).alias("cut"), F.pmod("depth", F.lit(places)).cast("int").alias("_place"))
        given = above.join(cuts, ["conv_id", "cut", "_place"]).select("node", "depth", *names)
        before, sums = sums, settle(sums.unionByName(given).groupBy("node", "depth").agg(*(F.sum(n).alias(n) for n in names)))
        discard(before)
    return sums


def joined_hashes(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256: the SHA-256 of the conv_ids that end at a node, in ascending order, joined by commas.

    Ids are sorted by ranges over all tasks and joined to texts of up to ``JOINED``; a node's texts are then read in order and hashed one
    after the other, none of them held.
    """
    order = ["node", "depth", "conv_id"]

    def join(batches):
        key, first, held = None, None, []

        def text():
            return [key[0], key[1], first, ",".join(map(str, held))]

        for batch in batches:
            out = []
            for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, depth) != key or len(held) == JOINED:
                    if held:
                        out.append(text())
                    key, first, held = (node, depth), conv, []
                held.append(conv)
            yield from batches_of(out)
        if held:
            yield from batches_of([text()])

    def batches_of(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "depth", "conv_id", "ids"])

    def digest_all(batches):
        key, h = None, None
        for batch in batches:
            out = []
            for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, depth) == key:
                    h.update(b",")
                else:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (node, depth), hashlib.sha256()
                h.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["node", "depth", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], ["node", "depth", "ends_sha256"])

    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "node long, depth long, conv_id long, ids string")
    return texts.repartition("node", "depth").sortWithinPartitions(*order).mapInArrow(digest_all, "node long, depth long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds conv_id, depth (from 1, without gaps), name and size of each turn, ``ids`` all conv_ids; both are read several times.
    """
    deepest = turns.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    named = prefix_names(turns.select("conv_id", (F.col("depth") - 1).alias("at"), "name"), deepest).select("conv_id", (F.col("at") + 1).alias("depth"), "name")
    named = settle(named.join(turns.select("conv_id", "depth", "size"), ["conv_id", "depth"]))
    root = ids.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).where("node IS NOT NULL")
    kinds = settle(named.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("size").alias("size")))
    passed = join_hot(named.select("conv_id", "depth", "name"), kinds.select("depth", "name", "node", "n"), ["depth", "name"]).select("conv_id", "depth", "node")
    passed = passed.unionByName(ids.crossJoin(F.broadcast(root.select("node"))).select("conv_id", F.lit(0).cast("long").alias("depth"), "node"))  # one row
    passed = settle(passed)
    ends = settle(passed.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max_by("node", "depth").alias("node")))
    nodes = kinds.select("node", "depth", "n", "size").unionByName(root.select("node", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("size")))
    # the parent is what the least member passes one depth above
    parents = passed.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = settle(nodes.join(parents, ["node", "depth"], "left"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    values = nodes.select("node", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved_tokens"))
    lengths = ends.select("conv_id", "length", F.col("length").alias("n"))
    sums = totals(values, settle(join_hot(passed, lengths, ["conv_id"])), deepest, ["n_leaves", "saved_tokens"])
    hashes = joined_hashes(ends.select("node", F.col("length").alias("depth"), "conv_id"))
    out = nodes.join(sums, ["node", "depth"]).join(hashes, ["node", "depth"], "left")
    return out.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def shared_head_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(conversations))
