"""Line dedup by a distributed suffix array over line ids.

The lines with a word, in order, are the symbols of each document; a document's end is a symbol of its own.  Prefix doubling ranks the
suffixes by their first 1, 2, 4, ... lines until every suffix is settled, that is alone in its class; settled suffixes keep their rank and
leave, so later rounds are small.  Ranks need no global sort: a class's rank is its old rank plus the number of suffixes in smaller
classes of the same old rank, which is a running sum over classes, not over suffixes.

Where a class splits, its parts are neighbours in the suffix array; the longest common prefix of two neighbours follows from the ranks of
the rounds before, by halving steps.  Joining neighbours of one class by falling prefix length gives its intervals: when two intervals meet, the
first member of the later one (by doc_id, then place) has found the longest run of lines with which it begins and which occurs earlier.  A
run that no run of the line before contains is maximal, and its lines are deleted.  A class of very many suffixes is cut into slices and stretches
(``in_order``, ``longest_runs``), so that no task holds a whole one.

Defined cases: a null or blank text has no lines and stays as it is; blank lines neither count nor are deleted; a run never spans
documents; the copies may lie in one document; rows that repeat id and text count as one row; an empty table gives an empty result; rows
with a null doc_id are left alone; other columns, whatever their names, pass through ``delete_later_copies`` untouched.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counts, free_name, join_hot, settle, task_rows

SLICES = 4096
BLANK = b" \t\x0b\x0c\r"


def kept_lines(text: Column) -> Column:
    """array<struct<line_no, line>> of the lines with something but white space, line_no from 0 over all lines."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")).alias("line")))
    return F.filter(lines, lambda s: s["line"] != "")


def suffixes(docs: DataFrame, row: str, min_words: int | None = None) -> DataFrame:
    """row, doc_id, at (place among the lines with a word), line_no, a, b (the line's 128-bit id), and with ``min_words`` wordy."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(row, F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(kept_lines(F.col("text"))).alias("at", "s"))
    wordy = [] if min_words is None else [(F.regexp_count("s.line", F.lit("[^ ]+")) >= min_words).alias("wordy")]
    return rows.select(row, "doc_id", "at", F.col("s.line_no").alias("line_no"), F.xxhash64("s.line").alias("a"), F.xxhash64(F.lit(1), "s.line").alias("b"), *wordy)


def first_ranks(lines: DataFrame) -> DataFrame:
    """The lines with rank and lone (no other has the line); ranks follow the order of line ids."""
    classes = settle(lines.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("slice", F.shiftrightunsigned("a", 52)))
    inside = Window.partitionBy("slice").orderBy("a", "b")
    # at most SLICES rows meet in the one window without a key
    base = classes.groupBy("slice").agg(F.sum("n").alias("m")).select("slice", (F.sum("m").over(Window.orderBy("slice")) - F.col("m")).alias("base"))
    ranked = classes.join(F.broadcast(base), "slice").select("a", "b", "n", (F.col("base") + F.sum("n").over(inside) - F.col("n")).alias("rank"), (F.col("n") == 1).alias("lone"))
    return join_hot(lines, settle(ranked), ["a", "b"]).drop("a", "b").distinct()


def in_order(parts: DataFrame, hot: DataFrame | None, bound: int) -> DataFrame:
    """``parts`` (rank, then, end, n, first) with part (the new rank), before (the first member of the part before it in its class) and size (of
    the class, null unless it is in ``hot``: rank, size).

    A class of ``hot`` is cut at multiples of ``bound`` of ``then``, its ends by their hash: a slice has about ``bound`` parts at most, since parts of one
    class differ in ``then`` or end.  Slices are summed by themselves, and what lies in earlier slices is added.
    """
    if hot is None:
        parts = parts.withColumn("size", F.lit(None).cast("long")).withColumn("slice", F.lit(None).cast("long"))
    else:
        line = F.floor(F.col("then") / bound)
        end = -1 - F.pmod("end", F.ceil(F.col("size") / bound))
        # fewer than HEAVY classes and numbers
        parts = parts.join(F.broadcast(hot), "rank", "left").withColumn("slice", F.when(F.col("size").isNotNull(), F.when(F.col("then") < 0, end).otherwise(line)))
    order = Window.partitionBy("rank", "slice").orderBy("then", "end")
    parts = settle(parts.withColumn("part", F.col("rank") + F.sum("n").over(order) - F.col("n")).withColumn("before", F.lag("first").over(order)))
    if hot is None:
        return parts.drop("slice")
    cut = parts.where("slice IS NOT NULL")
    sums = cut.groupBy("rank", "slice").agg(F.sum("n").alias("k"), F.max_by("first", F.struct("then", "end")).alias("last"))
    # a class has at most 2 * HEAVY slices
    along = Window.partitionBy("rank").orderBy("slice")
    sums = sums.select("rank", "slice", (F.sum("k").over(along) - F.col("k")).alias("base"), F.lag("last").over(along).alias("prior"))
    cut = cut.join(sums, ["rank", "slice"]).withColumns({"part": F.col("part") + F.col("base"), "before": F.coalesce("before", "prior")})
    return parts.where("slice IS NULL").unionByName(settle(cut.select(*parts.columns))).drop("slice")


def split(open_: DataFrame, now: DataFrame, row: str, depth: int, hot: DataFrame | None, bound: int) -> tuple[DataFrame, DataFrame, int]:
    """Suffixes ranked by ``depth`` lines, by twice as many: (parts, suffixes, the size of the largest part).

    ``parts``: rank, part (the new rank), n, first, before, size as in ``in_order``; ``hot``: rank, size of the classes of more than ``bound`` suffixes.
    """
    nexts = now.select(row, "doc_id", (F.col("at") - depth).alias("at"), F.col("rank").alias("then"))
    key = [row, "doc_id", "at"]
    # an end comes before all lines and is like no other end
    ends = F.when(F.col("then").isNull(), F.xxhash64(*key)).otherwise(0)
    paired = settle(open_.select(*key, "rank").join(nexts, key, "left").select(*key, "rank", F.coalesce("then", F.lit(-1)).alias("then"), ends.alias("end")))
    on = ["rank", "then", "end"]
    parts = in_order(paired.groupBy(*on).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", row, "at")).alias("first")), hot, bound)
    known = counts(parts)
    ranks = join_hot(paired, parts.select(*on, "n", "part", (F.col("n") == 1).alias("lone")), on, known)
    return parts.select("rank", "part", "n", "first", "before", "size"), ranks.select(*key, F.col("part").alias("rank"), "lone"), known[1]


def common_prefixes(neighbours: dict[int, DataFrame], ranks: dict[int, DataFrame], row: str) -> DataFrame:
    """All ``neighbours`` (by depth: depth, rank, part, x, y) with ``length``: the lines that the suffixes x and y, which share ``depth`` and not
    twice as many, have in common.  Pairs of one depth join at half of it; what they share beyond is found by ever smaller steps."""
    out = None
    for step in sorted(ranks, reverse=True):
        more = neighbours.get(2 * step)
        if more is not None:
            more = more.withColumn("length", F.col("depth"))
            out = more if out is None else out.unionByName(more)
        if out is None:
            continue
        for side in ("x", "y"):
            place = ranks[step].select(F.col("doc_id").alias(f"{side}_doc"), F.col(row).alias(f"{side}_row"), F.col("at").alias(f"{side}_at"), F.col("rank").alias(f"{side}_rank"))
            on = (F.col(f"{side}.doc_id") == F.col(f"{side}_doc")) & (F.col(f"{side}.{row}") == F.col(f"{side}_row")) & (F.col(f"{side}.at") + F.col("length") == F.col(f"{side}_at"))
            out = out.join(place, on, "left").drop(f"{side}_doc", f"{side}_row", f"{side}_at")
        longer = F.when(F.col("x_rank") == F.col("y_rank"), step).otherwise(0)
        # written at each step: one plan of all steps would be planned anew whenever one of its many stages ends
        out = settle(out.withColumn("length", F.col("length") + longer).drop("x_rank", "y_rank"))
    if 1 in neighbours:
        one = neighbours[1].withColumn("length", F.col("depth"))
        out = one if out is None else out.unionByName(one)
    return out


def _longest(first: list[tuple], length: list[int], best: list[int]) -> list[int]:
    """For parts in order, each with its first member and the prefix it shares with the part before (0: none): the longest prefix that each part's
    first member shares with an earlier one, ``best`` if that is longer.  Neighbours are joined from the longest prefix down."""
    home, best = list(range(len(first))), list(best)

    def top(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for i in sorted((i for i in range(1, len(first)) if length[i]), key=lambda i: -length[i]):
        a, b = top(i - 1), top(i)
        if first[b] < first[a]:
            a, b = b, a
        home[b] = a  # a stands for both: its member is first
        best[b] = max(best[b], length[i])
    return best


def _outward(first: list[tuple], length: list[int]) -> tuple[list[int], list[int]]:
    """Of a stretch of parts those that may still meet parts beyond it, and the prefix each shares with the one kept before it.

    Seen from a border, the parts that share v lines with it hold one that is first; the others find v lines within the stretch, and whoever looks in
    from beyond finds at least as much with the first one.  So for each side and each v one part is kept, and always the last one.
    """
    kept, n = set(), len(first)
    for places, shared in ((range(n), length), (range(n - 1, -1, -1), [*length[1:], None])):
        v, least = None, None
        for i in places:
            if shared[i] is not None and (v is None or shared[i] < v):
                if least is not None:
                    kept.add(least)
                v = shared[i]
            if v == 0:
                break
            least = i if least is None or first[i] < first[least] else least
        if v != 0 and least is not None:
            kept.add(least)
    kept = sorted(kept | {n - 1})
    return kept, [min(length[a + 1 : b + 1]) for a, b in zip([-1, *kept[:-1]], kept)]


#: So many stretches of a class are joined in one task.
FAN = 500


def longest_runs(neighbours: DataFrame, row: str, largest: int, bound: int) -> DataFrame:
    """doc_id, row, at, length of the first member of each part that is not the first of its interval: its longest run that occurs earlier.

    ``neighbours``: depth, rank, part, first, length, size.  A class of more than ``bound`` suffixes is taken in stretches; of each, the few parts that may meet
    others beyond it (at most two for each length of prefix that occurs) go on to a round in which FAN stretches are one.
    """
    shape = f"depth int, rank long, part long, first struct<doc_id:long,{row}:long,at:int>, length int, size long, best int, open boolean"
    names = ["depth", "rank", "part", "first", "length", "size", "best"]
    rows, width, found = neighbours.withColumn("best", F.lit(0)), bound, []
    while True:
        stretch = F.floor((F.col("part") - F.col("rank")) / width)
        held = F.array_sort(F.collect_list(F.struct("part", "first", "length", "best")))
        groups = rows.groupBy("depth", "rank", stretch.alias("stretch")).agg(F.max(F.coalesce("size", F.lit(0))).alias("size"), held.alias("parts")).select("depth", "rank", "size", "parts")

        def run(batches, width=width):
            for batch in batches:
                out = []
                for depth, rank, size, parts in zip(*(batch.column(k) for k in range(4))):
                    part, first, length, best = (parts.values.field(k).to_pylist() for k in range(4))
                    members = [tuple(f.values()) for f in first]
                    best = _longest(members, length, best)
                    kept, shared = _outward(members, length) if size.as_py() > width else ([], [])
                    out += [(depth.as_py(), rank.as_py(), part[i], first[i], n, size.as_py(), best[i], True) for i, n in zip(kept, shared)]
                    gone = set(kept)
                    out += [(None, None, None, first[i], None, None, n, False) for i, n in enumerate(best) if n and i not in gone]
                columns = list(zip(*out)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        arrow = pa.schema([("depth", pa.int32()), ("rank", pa.int64()), ("part", pa.int64()), ("first", pa.struct([("doc_id", pa.int64()), (row, pa.int64()), ("at", pa.int32())])), ("length", pa.int32()), ("size", pa.int64()), ("best", pa.int32()), ("open", pa.bool_())])
        done = settle(groups.mapInArrow(run, shape))
        found.append(done.where("NOT open").select("first.doc_id", f"first.{row}", "first.at", F.col("best").alias("length")))
        if largest <= width:
            return reduce(DataFrame.union, found)
        rows, width = done.where("open").select(*names), width * FAN


def repeated_runs(lines: DataFrame, row: str, min_lines: int = 2, rounds: int = 40) -> DataFrame:
    """doc_id, row, at, length: the maximal runs of ``min_lines`` lines or more that occur earlier too.

    ``lines``: the result of ``first_ranks``.
    """
    now, depth, ranks, neighbours = lines.select(row, "doc_id", "at", "rank", "lone"), 1, {}, {}
    open_ = now.where("NOT lone")
    classes = open_.groupBy("rank").agg(F.count("*").alias("n"))
    total, largest = counts(classes)
    bound, biggest = task_rows(total), largest
    hot = classes.where(F.col("n") > bound).select("rank", F.col("n").alias("size")) if largest > bound else None
    for _ in range(rounds):
        if largest < 2:
            break
        ranks[depth] = open_
        parts, fresh, largest = split(open_, now, row, depth, hot, bound)
        hot = parts.where(F.col("n") > bound).select(F.col("part").alias("rank"), F.col("n").alias("size")) if largest > bound else None
        # what stands alone keeps its rank
        after = settle(fresh)
        open_, now = after.where("NOT lone"), after.unionByName(now.where("lone"))
        if depth <= 8:  # in the documents that still have something open: at first most have not
            now = settle(now.join(open_.select(row, "doc_id").distinct(), [row, "doc_id"], "left_semi"))
        if 2 * depth > min_lines:
            neighbours[depth] = parts.select(F.lit(depth).alias("depth"), "rank", "part", F.col("first").alias("y"), F.col("before").alias("x"), "size")
        depth *= 2
    else:
        raise RuntimeError(f"runs of more than {depth} lines")
    if not neighbours:
        return lines.select("doc_id", row, F.col("at").cast("int").alias("at"), F.lit(0).alias("length")).limit(0)
    pairs = common_prefixes(neighbours, ranks, row)
    length = F.when(F.col("x").isNotNull() & (F.col("length") >= min_lines), F.col("length")).otherwise(0)
    found = longest_runs(pairs.select("depth", "rank", "part", F.col("y").alias("first"), length.alias("length"), "size"), row, biggest, bound)
    before = F.lag(F.col("at") + F.col("length")).over(Window.partitionBy(row, "doc_id").orderBy("at"))
    return found.withColumn("_upto", before).where("_upto IS NULL OR at + length > _upto").drop("_upto")


def later_copies(docs: DataFrame, row: str = "row", min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """row, doc_id, line_no of every line to be deleted: of runs of ``min_lines``, and of single lines of ``min_words`` words if that is given."""
    lines = settle(first_ranks(settle(suffixes(docs, row, min_words))))
    runs = repeated_runs(lines, row, min_lines).select(row, "doc_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("at"))
    gone = lines.join(runs.distinct(), [row, "doc_id", "at"]).select(row, "doc_id", "line_no")
    if min_words is None:
        return gone
    wordy = lines.where("wordy AND NOT lone")
    first = settle(wordy.groupBy("rank").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", row, "at")).alias("first")))
    single = join_hot(wordy, first, ["rank"]).where(F.struct("doc_id", row, "at") != F.col("first")).select(row, "doc_id", "line_no")
    return gone.union(single).distinct()


def delete_later_copies(docs: DataFrame, min_lines: int = 2, text: str = "text", min_words: int | None = None, note: str = "_") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the deleted lines; the struct column ``note`` is added: n_lines, deleted."""
    key = F.xxhash64("doc_id", text)
    gone = later_copies(docs.select("doc_id", F.col(text).alias("text"), key.alias("row")), "row", min_lines, min_words)
    gone = gone.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("deleted"))
    held = docs.select(F.struct("*").alias("_d"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("row")).join(gone, ["row", "doc_id"], "left").select("_d", "deleted")
    at, names = docs.columns.index(text), docs.columns

    def delete(batches):
        for batch in batches:
            rows, deleted = batch.column(0), batch.column(1)
            fields, left, counts, numbers = rows.flatten(), [], [], []
            for was, gone in zip(fields[at].cast(pa.large_binary()).to_pylist(), deleted.to_pylist()):
                lines = was.split(b"\n") if was is not None else []
                counts.append(sum(1 for x in lines if x.strip(BLANK)))
                numbers.append(gone or [])
                if gone:
                    out = set(gone)
                    was = b"\n".join(x for k, x in enumerate(lines) if k not in out)
                left.append(was)
            fields[at] = pa.array(left, pa.binary()).cast(pa.string())
            told = pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(numbers, pa.list_(pa.int32()))], ["n_lines", "deleted"])
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, names), told], ["_d", "_"])

    shape = T.StructType([T.StructField("_d", T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])), T.StructField("_", T.StructType([T.StructField("n_lines", T.IntegerType()), T.StructField("deleted", T.ArrayType(T.IntegerType()))]))])
    return held.mapInArrow(delete, shape).select(*(F.col(f"_d.`{c}`").alias(c) for c in docs.columns), F.col("_").alias(note))


def line_dedup(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_deleted, deleted (line numbers) of every row."""
    out = delete_later_copies(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_lines)
    return out.select("doc_id", "text", F.col("_.n_lines").cast("long").alias("n_lines"), F.size("_.deleted").cast("long").alias("n_deleted"), F.col("_.deleted").alias("deleted"))


def keep_first_copies(docs: DataFrame, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """All columns of the rows that have a line left (or had none), ``text`` without later copies, ``n_chars`` as it now is."""
    note = free_name(docs.columns)
    n_lines, n_deleted = F.col(note)["n_lines"], F.size(F.col(note)["deleted"])
    out = delete_later_copies(docs, min_lines, min_words=min_words, note=note).where((n_lines == 0) | (n_deleted < n_lines))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(n_deleted > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(note)
