"""SimHash near-duplicates: fingerprints, links at a small Hamming distance, classes.

Distinct fingerprints only are compared.  Each has a row of the pivot distance table: its Hamming distances to PIVOTS reference
fingerprints, worked out once and dealt out with it.  Two fingerprints that differ in at most three bits agree on two of five blocks
(and, within such a bucket, on one of four quarters of the other bits: a bucket of more than LIMIT is dealt again by these, which loses
no pair), so fingerprints meet under their ten pairs of blocks.  There they stand in the order of the first pivot distance; a
pair is formed only if no distance in its two rows of the table differs by more than the allowed bits (the triangle inequality discards the others
unseen), and is then verified bit by bit.  A larger group yields a spanning forest of its links, never all pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows share a class; an empty table
gives an empty result; a null doc_id has a fingerprint and a class but is never the class id unless it stands alone (then null);
other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import pieces, settle, utf8
from .components import components

WIDTH = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIVOTS = 16
#: The most fingerprints, or texts, that meet in one bucket.
LIMIT = 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())])
    total = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, n, 65536):
        total += np.unpackbits(raw[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) of every row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
                fp = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: none set, and pseudo-random ones."""
    return np.concatenate([[np.uint64(0)], np.random.default_rng(64).integers(0, 1 << 64, n - 1, np.uint64)])


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp, table: of every distinct fingerprint the distances to the pivots."""
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("byte") for p in pivots().view(np.int64)]
    return fps.select("fp").distinct().select("fp", F.array(*distances).alias("table"))


def forest(fps: np.ndarray, most: int = 3, table: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct fingerprints.

    A found fingerprint meets those not yet found whose first pivot distance is near its own; the other pivots discard most of these.
    """
    if table is None:
        table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    first, rest, links = table[order, 0].astype(np.int64), np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not rest[start]:
            continue
        rest[start] = False
        queue = [start]
        while queue:
            x = queue.pop()  # places in the order of the first distance
            lo, hi = np.searchsorted(first, [first[x] - most, first[x] + most + 1])
            near = lo + np.flatnonzero(rest[lo:hi])
            near = near[(np.abs(table[order[near], 1:] - table[order[x], 1:]) <= most).all(axis=1)]
            near = near[np.bitwise_count(fps[order[near]] ^ fps[order[x]]) <= most]
            rest[near] = False
            links += [(int(order[x]), int(order[y])) for y in near]
            queue += near.tolist()
    return links


def pairs_of(sizes: np.ndarray, most_size: int):
    """Places of all pairs within each group of at most ``most_size``; groups lie end to end."""
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[(sizes > 1) & (sizes <= most_size)]).tolist():
        at = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        yield (at[:, None] + i).reshape(-1), (at[:, None] + j).reshape(-1)


def linked(fps: np.ndarray, table: np.ndarray, sizes: np.ndarray, most: int, small: int = 8) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places of linked pairs; of groups of up to ``small`` how many pairs there were and how many the pivots left to be verified."""
    a, b, n, left = [], [], 0, 0
    for x, y in pairs_of(sizes, small):
        n += len(x)
        for k in range(table.shape[1]):
            near = np.abs(table[x, k] - table[y, k]) <= most
            x, y = x[near], y[near]
        left += len(x)
        near = np.bitwise_count(fps[x] ^ fps[y]) <= most
        a.append(x[near])
        b.append(y[near])
    starts = np.cumsum(sizes) - sizes
    for s, m in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        tree = np.array(forest(fps[s : s + m], most, table[s : s + m]), np.int64).reshape(-1, 2) + s
        a.append(tree[:, 0])
        b.append(tree[:, 1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), n, left


def _mask(at: int, n: int) -> int:
    """Bits at .. at + n - 1 of a fingerprint, as a signed number."""
    m = ((1 << n) - 1) << at
    return m - (1 << 64) if m >> 63 else m


def _bucket_masks() -> list[tuple[int, list[int]]]:
    """The bits of each pair of blocks, and of the four quarters of the others."""
    out = []
    for i in range(5):
        for j in range(i + 1, 5):
            mine = _mask(*BLOCKS[i]) | _mask(*BLOCKS[j])
            other = [b for b in range(64) if not mine >> b & 1]
            quarters = []
            for part in np.array_split(other, 4):
                more = mine
                for b in part.tolist():
                    more |= _mask(b, 1)
                quarters.append(more)
            out.append((mine, quarters))
    return out


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct values of ``fp`` whose components are those of all pairs within ``most`` (at most 3) bits."""
    if not 0 <= most <= 3:
        raise ValueError("five blocks find pairs that differ in three bits at most")
    masks = _bucket_masks()
    part = lambda name, mask: F.struct(F.lit(name).alias("path"), F.col("fp").bitwiseAND(F.lit(mask)).alias("part"))
    table = settle(pivot_table(fps))
    dealt = table.select("fp", "table", F.explode(F.array(*(part(p, mask) for p, (mask, _) in enumerate(masks)))).alias("k")).select("fp", "table", "k.path", "k.part")
    large = settle(dealt.groupBy("path", "part").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT).select("path", "part"))
    if not large.isEmpty():
        again = F.array(*(F.array(*(part(16 * (p + 1) + q, mask) for q, mask in enumerate(quarters))) for p, (_, quarters) in enumerate(masks)))
        split = dealt.join(large, ["path", "part"]).select("fp", "table", F.explode(F.get(again, F.col("path"))).alias("k")).select("fp", "table", "k.path", "k.part")
        dealt = dealt.join(large, ["path", "part"], "left_anti").select("fp", "table", "path", "part").union(split)
    # keys that one fingerprint alone has end in Spark's own aggregation
    groups = dealt.groupBy("path", "part").agg(F.collect_list("fp").alias("fps"), F.flatten(F.collect_list("table")).alias("table")).where(F.size("fps") > 1).select("fps", "table")

    def compare(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().view(np.uint64)
            rows = batch.column(1).flatten().to_numpy().reshape(-1, PIVOTS)
            a, b, _, _ = linked(x, rows, np.diff(batch.column(0).offsets.to_numpy()), most)
            yield ordered(x[a].view(np.int64), x[b].view(np.int64))

    return groups.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most: int = 3, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of the class) of every row."""
    rows = settle(fingerprints(docs, width))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # nodes are fingerprints: doc_ids may repeat or be null, fingerprints are whole
    member = components(links(classes, most))
    named = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = settle(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = named.join(least, "component").select("fp", "component_id")
    return rows.join(table, "fp").select("doc_id", "fp", "component_id")


# --- classes by similarity ------------------------------------------------------------------------------------------

#: Two texts at the threshold of 0.8 share one of BANDS bands of BITS bits with a chance of 0.97, whatever the size of the corpus.
BITS, BANDS = 18, 66
#: Fingerprints propose what may reach the threshold; the estimate from 1216 bits has a standard error of about 0.024 at 0.8.
WORDS = -(-BITS * BANDS // 64)
MARGIN = 0.1
#: Two texts of Jaccard similarity 0.8 differ in 0.15 of the bits; of 64 bits, 9.7 on average and over 24 once in a million.
SHORT_MOST = 24
#: Members of a bucket over LIMIT that all of its parts hold.
ANCHORS = 64


def wide_fingerprint(shingles: np.ndarray, salts: np.ndarray) -> bytes:
    """64 bits for each salt from the distinct shingle hashes of a text."""
    total = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(shingles), 2048):
        rows = H.mix(shingles[at : at + 2048, None] ^ salts[None, :])
        total += np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * total > len(shingles)).tobytes()


def shingle_sets(column: pa.Array, width: int):
    """The distinct word shingle hashes, ascending, of each text of a column."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    starts, ends = H.runs(~H.SPACE[raw], offsets)
    words, at = H.slice_hashes(raw, starts, ends), np.searchsorted(starts, offsets)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.unique(H.window_hashes(words[a:b], min(width, b - a))) if b > a else np.zeros(0, np.uint64)


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def wide_fingerprints(docs: DataFrame, width: int, salts: np.ndarray) -> DataFrame:
    """doc_id, row, node (a hash of the set), fp: fingerprints over the set of word shingles of every row."""

    def run(batches):
        import xxhash

        for batch in batches:
            for part in pieces(batch, "text"):
                nodes, fps = [], []
                for shingles in shingle_sets(part.column(2), width):
                    nodes.append(xxhash.xxh64_intdigest(shingles.tobytes()))
                    fps.append(wide_fingerprint(shingles, salts))
                node = pa.array(np.array(nodes, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, pa.array(fps, pa.binary())], ["doc_id", "row", "node", "fp"])

    return with_row(docs).mapInArrow(run, "doc_id long, row long, node long, fp binary")


def differing(similarity: float) -> float:
    """The share of bits in which the fingerprints of two sets of that Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of WORDS 64-bit words, the width that every estimate uses at any number of bands."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def bits_apart(similarity: float) -> int:
    """The most bits of such a row in which two fingerprints differ whose estimate is ``similarity`` or more."""
    return math.floor(differing(similarity) * 64 * WORDS)


def spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links of at most ``most`` bits among rows of words.

    Every member is compared with every found member until it is linked.  (Pivots would discard nothing: at this width the distances to a
    reference fingerprint differ by less than ``most`` for unrelated texts too.)
    """
    rest, queue, out = np.arange(len(fps)), [], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        x = queue.pop()
        near = np.zeros(len(rest), bool)
        for at in range(0, len(rest), 65536):
            near[at : at + 65536] = np.bitwise_count(fps[rest[at : at + 65536]] ^ fps[x]).sum(axis=1, dtype=np.int64) <= most
        out += [(x, int(y)) for y in rest[near]]
        queue += rest[near].tolist()
        rest = rest[~near]
    return out


def crossing(fps: np.ndarray, label: np.ndarray, rare: np.ndarray, most: int):
    """Arrays of index pairs: each ``rare`` member with all others of different labels within ``most`` bits; a pair of rare ones once."""
    rares, common = np.flatnonzero(rare), np.flatnonzero(~rare)
    for k, x in enumerate(rares.tolist()):
        others = np.concatenate([common, rares[k + 1 :]])
        others = others[label[others] != label[x]]
        for at in range(0, len(others), 65536):
            some = others[at : at + 65536]
            near = some[np.bitwise_count(fps[some] ^ fps[x]).sum(axis=1, dtype=np.int64) <= most]
            if len(near):
                yield np.full(len(near), x), near


def band_keys(nodes: DataFrame) -> DataFrame:
    """key (band and its bits), node, short (the first 64 bits): a row for each band of each node."""

    def bands(batches):
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            short = np.ascontiguousarray(fp[:, :8]).view(np.int64).reshape(-1)
            rows = np.unpackbits(fp, axis=1)[:, : BANDS * BITS].reshape(batch.num_rows, BANDS, BITS)
            keys = rows @ (1 << np.arange(BITS, dtype=np.int32)) + (np.arange(BANDS, dtype=np.int32) << BITS)
            node = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int32)), pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(short, BANDS))], ["key", "node", "short"])

    return nodes.select("node", "fp").mapInArrow(bands, "key int, node long, short long")


def shared_buckets(dealt: DataFrame) -> DataFrame:
    """What shares a bucket and is not parted by the first 64 bits: pairs (a, b), or ``nodes`` of three or more."""
    groups = dealt.groupBy("key").agg(F.collect_list("node").alias("nodes"), F.collect_list("short").alias("shorts")).where(F.size("nodes") > 1).select("nodes", "shorts")

    def compare(batches):
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            node, short = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint64)
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            near = [np.zeros((0, 2), np.int64)]
            for x, y in pairs_of(sizes, 32):
                for at in range(0, len(x), 1 << 20):
                    some = slice(at, at + (1 << 20))
                    ok = np.bitwise_count(short[x[some]] ^ short[y[some]]) <= SHORT_MOST
                    near.append(np.stack([x[some][ok], y[some][ok]], axis=1))
            near = np.concatenate(near)
            found = np.bincount(owner[near[:, 0]], minlength=len(sizes))
            alone = near[found[owner[near[:, 0]]] == 1]
            a, b, more = [node[alone[:, 0]]], [node[alone[:, 1]]], []
            busy = np.flatnonzero((found > 1) | (sizes > 32))
            for s, n in zip(starts[busy].tolist(), sizes[busy].tolist()):
                order = np.argsort(node[s : s + n]) + s
                for group in clusters(short[order], SHORT_MOST):
                    who = node[order[group]]
                    if len(who) > 2:
                        more.append(who)
                    else:
                        a.append(who[1:])
                        b.append(who[:1])
            a, b = np.concatenate(a), np.concatenate(b)
            none = pa.nulls(len(a), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), none], ["a", "b", "nodes"])
            if more:
                none = pa.nulls(len(more), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(more, pa.list_(pa.int64()))], ["a", "b", "nodes"])

    # a group that many bands find is one row
    return settle(groups.mapInArrow(compare, "a long, b long, nodes array<long>").distinct())


def ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def first_candidates(found: DataFrame, large: DataFrame, fps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) to be decided first: what shares a bucket alone and reaches the threshold less MARGIN by the estimate; of every larger
    group, and of every part of a bucket over LIMIT, a spanning forest of the estimates at the threshold itself, so that large groups of close
    copies give no squares of pairs."""
    margin, close = bits_apart(max(0.0, similarity - MARGIN)), bits_apart(similarity)

    def verify(batches):
        for batch in batches:
            x, y = wide(batch.column(2)), wide(batch.column(3))
            yield batch.filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= margin)).select(["a", "b"])

    pairs = found.where("nodes IS NULL").select("a", "b")
    pairs = pairs.join(fps.withColumnsRenamed({"node": "a", "fp": "x"}), "a").join(fps.withColumnsRenamed({"node": "b", "fp": "y"}), "b")
    pairs = pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    def connect(batches):
        for batch in batches:
            a, b = [], []
            for node, fp in zip(batch.column(0), batch.column(1)):
                node, fp = node.values.to_numpy(), wide(fp.values)
                order = np.argsort(node)  # so that a group's forest is the same in every band
                for x, y in spanning(fp[order], close):
                    a.append(node[order[x]])
                    b.append(node[order[y]])
            yield ordered(np.array(a, np.int64), np.array(b, np.int64))

    members = found.where("nodes IS NOT NULL").select(F.xxhash64("nodes").alias("g"), F.lit(0).alias("part"), F.explode("nodes").alias("node")).union(large)
    groups = members.join(fps, "node").groupBy("g", "part").agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"))
    return pairs.union(groups.select("nodes", "fps").mapInArrow(connect, "a long, b long"))


def open_candidates(found: DataFrame, large: DataFrame, fps: DataFrame, member: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of larger groups that are in different classes yet and reach the threshold less MARGIN by the estimate: all of them.

    A group's most frequent class is not compared with itself.  What is outside it (``rare``) meets all members, both in parts of at most
    LIMIT, so that a task holds two parts however large the group is.
    """
    margin = bits_apart(max(0.0, similarity - MARGIN))

    def cross(batches):
        for batch in batches:
            for node, label, rare, fp in zip(*batch.columns):
                node, label, rare, fp = node.values.to_numpy(), label.values.to_numpy(), rare.values.to_numpy(zero_copy_only=False), wide(fp.values)
                if rare.any():
                    for x, y in crossing(fp, label, rare, margin):
                        yield ordered(node[x], node[y])

    members = found.where("nodes IS NOT NULL").select(F.xxhash64("nodes").alias("g"), F.explode("nodes").alias("node")).union(large.select("g", "node").distinct())
    members = settle(members.join(member, "node", "left").select("g", "node", F.coalesce("component", "node").alias("label")))
    counts = members.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    counts = counts.where("labels > 1").select("g", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / LIMIT).cast("int").alias("rares"), F.ceil(F.col("n") / LIMIT).cast("int").alias("alls"))
    rows = members.join(counts, "g").withColumn("rare", F.col("label") != F.col("top"))
    at = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    rare = rows.where("rare").select("g", "node", "label", F.lit(True).alias("rare"), at("rares").alias("r"), F.explode(every("alls")).alias("c"))
    rest = rows.select("g", "node", "label", F.lit(False).alias("rare"), F.explode(every("rares")).alias("r"), at("alls").alias("c"))
    # a rare member that its own part of all members holds too comes once, as rare
    dealt = rare.union(rest).groupBy("g", "r", "c", "node", "label").agg(F.max("rare").alias("rare"))
    groups = dealt.join(fps, "node").groupBy("g", "r", "c")
    groups = groups.agg(F.collect_list("node").alias("nodes"), F.collect_list("label").alias("labels"), F.collect_list("rare").alias("rares"), F.collect_list("fp").alias("fps"))
    return groups.select("nodes", "labels", "rares", "fps").mapInArrow(cross, "a long, b long")


def decided(pairs: DataFrame, docs: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of distinct shingle hashes have a Jaccard similarity of ``similarity`` or more."""
    pairs = settle(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    one = rows.join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("s")).select("node", "s.doc_id", "s.row")
    texts = with_row(docs).join(one, ["doc_id", "row"]).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = pa.array([x.view(np.int64) for x in shingle_sets(part.column(1), width)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "shingles"])

    sets = settle(texts.mapInArrow(run, "node long, shingles array<long>"))
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    # same / (n - same) >= similarity, solved for the number that must be the same
    least = F.ceil((F.size("x") + F.size("y")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    return settle(both.where((F.least(F.size("x"), F.size("y")) >= least) & (F.size(F.array_intersect("x", "y")) >= least)).select("a", "b"))


def similar_classes(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, component) of every node that has a link: the classes of all pairs that share a bucket, are proposed and are similar."""
    dealt = settle(band_keys(nodes))
    size = F.col("n")
    over = settle(dealt.groupBy("key").agg(F.count("*").alias("n")).where(size > LIMIT))
    found = shared_buckets(dealt if over.isEmpty() else dealt.join(over, "key", "left_anti"))
    # buckets over LIMIT: parts by a hash of the node, and ANCHORS members that every part has
    place = F.xxhash64("node")
    wide_ones = dealt.join(over, "key").select(F.col("key").cast("long").alias("g"), "n", "node", F.ceil(size / (LIMIT - ANCHORS)).cast("int").alias("parts"))
    anchors = F.pmod(place, size) < ANCHORS
    part = F.when(anchors, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(place, F.col("parts")).cast("int")))
    large = settle(wide_ones.select("g", F.explode(part).alias("part"), "node"))
    fps = settle(nodes.select("node", "fp"))
    member = components(decided(first_candidates(found, large, fps, similarity), docs, rows, width, similarity))
    more = decided(open_candidates(found, large, fps, member, similarity), docs, rows, width, similarity)
    if more.isEmpty():
        return member
    return components(member.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def clusters(fps: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the members of each group of two or more that links of at most ``most`` bits hold together, ascending."""
    parent = np.arange(len(fps))
    for x, y in forest(fps, most):
        parent[y] = parent[x]  # the forest reaches each y from an x that is placed already
    out = []
    order = np.argsort(parent, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1):
        if len(part) > 1:
            out.append(np.sort(part))
    return out


def repeats(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row (xxhash64 of the text) of every row that is not the least doc_id of its class of similar texts.

    Similar: a Jaccard similarity of word shingles of ``similarity`` or more.  SimHash fingerprints propose pairs, the sets of shingles decide
    each; a pair at 0.8 is proposed with a chance of 0.97, a closer one nearly always, at any size of corpus.  A text without words has
    no shingles and stays; rows with a null doc_id stay and make no other row a repeat.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    salts = H.mix(np.arange(1, WORDS + 1, dtype=np.uint64))  # 64 bits each
    rows = settle(wide_fingerprints(docs, width, salts))
    nodes = settle(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    member = similar_classes(docs, rows, nodes, width, similarity)
    named = settle(nodes.drop("fp").join(member, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    table = named.join(least, "component").select("node", "first")
    return rows.select("doc_id", "row", "node").join(table, "node").where("doc_id <> first").select("doc_id", "row")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """All columns of the rows that stay: of each class of similar texts the one of least doc_id, and of rows that repeat id and text one.

    If such rows differ in other columns, the one whose columns have the least hash stays; rows with a null doc_id all do.
    """
    gone = repeats(docs.select("doc_id", "text"), width, similarity).distinct()
    # maps have no hash
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    held = docs.select(F.struct("*").alias("_d"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.xxhash64(*hashed).alias("h"))
    rows = held.select("doc_id", "row", "h").where("doc_id IS NOT NULL").groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    rows = rows.where("n > 1").select("doc_id", "row", "least").unionByName(gone.withColumn("least", F.lit(None).cast("long")))
    # what goes has no least hash; what else repeats goes on with one row
    named = settle(rows.groupBy("doc_id", "row").agg(F.when(F.count("*") == F.count("least"), F.min("least")).alias("least")))
    once = held.join(named, ["doc_id", "row"], "left_anti").select("_d")
    again = held.join(named.where("least IS NOT NULL"), ["doc_id", "row"]).where("h = least").dropDuplicates(["doc_id", "row"]).select("_d")
    return once.union(again).select(*(F.col(f"_d.`{c}`").alias(c) for c in docs.columns))
