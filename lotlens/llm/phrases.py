"""Phrase collocations: phrases of two and three words that occur together more than their parts would make one expect, by language.

Counting is by HAT-tries, in the hybrid form: each task keeps tries over word ids whose leaves are containers, arrays of keys in order and counts, which
words in a row share; one that grows too large parts between two words or bursts into a branch over its next word.  When a task's tries have too many
entries, the subtrees of the youngest words of the largest are spilled whole, as runs sorted by their words' numbers, and the runs are merged by Spark: dealt and
summed by the whole phrase, since the runs under one short prefix (a very frequent first word) may hold a third of all rows.

Two passes over the texts count words with pairs, and triples.  A phrase occurs no more often than any part of it, so a triple is counted only if both its
pairs have reached ``least``; these, and the words that have, are marked in two bitmaps of a fixed size (``Sizes.bits``) that are sent to the
tasks.  A bitmap may let through more than it should, never less, and what it lets through is counted like the rest: counts are exact, and a
fuller bitmap costs time only.

Defined cases: a null text is empty; a null language is ``und``; phrases never cross documents or pieces; a text of any length is read in windows of a
bounded size, of which each takes the last words of the one before along; repeated rows count as often as they occur; an empty table has no phrase;
columns other than text and lang are not read.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, settle

#: Bits of a word's number within a task; parts of a language that are ranked by themselves.
ID_BITS, SALTS = 21, 16


@dataclass(frozen=True)
class Sizes:
    """What a task holds; none of it changes results."""

    #: A bitmap of frequent words or pairs has 2**bits bits (4 MB).
    bits: int = 25
    #: Entries of a container before it bursts, of all tries of a task before one spills, and words that a task numbers at once.
    burst: int = 4096
    entries: int = 1_000_000
    words: int = 400_000
    #: Bytes of a text that are cut into words at once.
    window: int = 500_000

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1


TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]")
ENDS = re.compile(rb"[ \t.,;:!?\n-\r]")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


class HatTrie:
    """Counts of sequences of ``width`` word ids, packed into one number.

    A ``Branch`` deals keys by their next word.  Words in a row share one ``Container`` until it has more than ``burst`` entries: then it parts between two
    words, or, if it holds one word only, bursts into a branch over the word after that.  Containers are arrays, 16 bytes an entry.
    """

    class Container:
        """Keys in order with their counts, and beside them what came since they were put in order last."""

        def __init__(self, keys: np.ndarray, counts: np.ndarray):
            self.parts, self.settled, self.size = [(keys, counts)], len(keys), len(keys)

        def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
            self.parts.append((keys, counts))
            self.size += len(keys)
            if self.size - self.settled > self.settled // 2:
                self.fold()

        def fold(self) -> tuple[np.ndarray, np.ndarray]:
            if len(self.parts) > 1:
                self.parts = [folded(self.parts)]
                self.settled = self.size = len(self.parts[0][0])
            return self.parts[0]

    class Branch:
        """Nodes, and the word with which the range of each begins; a branch has a range of one word and keys without it."""

        def __init__(self, nodes: list[tuple[int, HatTrie.Container | HatTrie.Branch]]):
            self.lows, self.kids = np.zeros(0, np.int64), []
            self.put(0, 0, nodes)

        def put(self, at: int, end: int, nodes: list[tuple]) -> None:
            """These nodes instead of those from ``at`` to ``end``."""
            self.lows = np.concatenate([self.lows[:at], np.array([low for low, _ in nodes], np.int64), self.lows[end:]])
            self.kids[at:end] = [node for _, node in nodes]

    def __init__(self, width: int, burst: int):
        self.width, self.burst, self.size = width, burst, 0
        self.root = self.Branch([(0, self.empty())])

    def empty(self) -> Container:
        return self.Container(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts of distinct keys, in order."""
        if len(keys):
            self._add(self.root, self.width, keys, counts)

    def _add(self, branch: Branch, width: int, keys: np.ndarray, counts: np.ndarray) -> None:
        shift = ID_BITS * (width - 1)
        ends = [*np.searchsorted(keys, branch.lows[1:] << shift).tolist(), len(keys)]
        at, full = 0, []
        for i, end in enumerate(ends):
            if at < end:
                kid = branch.kids[i]
                if isinstance(kid, self.Branch):
                    self._add(kid, width - 1, keys[at:end] & ((1 << shift) - 1), counts[at:end])
                else:
                    before = kid.size
                    # copies: a slice would keep the whole array
                    kid.add(keys[at:end].copy(), counts[at:end].copy())
                    self.size += kid.size - before
                    if kid.settled > self.burst:
                        full.append(i)
            at = end
        for i in reversed(full):
            before, until = branch.kids[i].size, int(branch.lows[i + 1]) if i + 1 < len(branch.kids) else None
            self.size -= before - len((entries := branch.kids[i].fold())[0])
            branch.put(i, i + 1, self._burst(*entries, width, int(branch.lows[i]), until))

    def _burst(self, keys: np.ndarray, counts: np.ndarray, width: int, low: int, until: int | None) -> list[tuple]:
        """Nodes for distinct keys of words from ``low`` to before ``until``."""
        if len(keys) <= self.burst:
            return [(low, self.Container(keys.copy(), counts.copy()))]
        shift = ID_BITS * (width - 1)
        word = int(keys[0] >> shift)
        if word == keys[-1] >> shift:
            below = self.Branch(self._burst(keys & ((1 << shift) - 1), counts, width - 1, 0, None))
            before = [(low, self.empty())] if low < word else []
            return [*before, (word, below), *([(word + 1, self.empty())] if until is None or word + 1 < until else [])]
        half = int(keys[len(keys) // 2] >> shift)
        half += half == word
        at = int(np.searchsorted(keys, half << shift))
        return [*self._burst(keys[:at], counts[:at], width, low, half), *self._burst(keys[at:], counts[at:], width, half, until)]

    def _pour(self, node: Container | Branch, width: int, base: int, out: list[tuple]) -> None:
        """Adds all entries below a node, in order and with ``base`` in front of each key."""
        if isinstance(node, self.Branch):
            for low, kid in zip(node.lows.tolist(), node.kids, strict=True):
                self._pour(kid, width - 1 if isinstance(kid, self.Branch) else width, base | low << ID_BITS * (width - 1) if isinstance(kid, self.Branch) else base, out)
        else:
            keys, counts = node.fold()
            out.append((keys | base, counts))

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Keys, in order, and counts of the subtrees of the youngest words, which tend to be the rarest, taken out whole until at most ``keep`` entries are left."""
        out: list[list[tuple]] = []
        at = len(self.root.kids)
        while at and self.size > keep:
            at -= 1
            here = self.Branch([(int(self.root.lows[at]), self.root.kids[at])])
            before, part = self.held(here), []
            self._pour(here, self.width, 0, part)
            out.append(part)
            self.size -= before
        if out:
            low = int(self.root.lows[at])
            self.root.put(at, len(self.root.kids), [(low, self.empty())])
        parts = [x for part in reversed(out) for x in part] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])

    def held(self, node: Container | Branch) -> int:
        return sum(map(self.held, node.kids)) if isinstance(node, self.Branch) else node.size


class WordCounts:
    """The same for single words: word ids count up from 1, so an array does."""

    def __init__(self):
        self.counts, self.size = np.zeros(1, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(ids) and ids[-1] >= len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(int(ids[-1]), np.int64)])
        self.counts[ids] += counts

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.flatnonzero(self.counts), self.counts
        self.counts = np.zeros(1, np.int64)
        return ids, counts[ids]


class Words(dict):
    """word -> its number in this task; 0 for breaks and for words that no wanted phrase holds."""

    def __init__(self, lang: bytes, wanted: bytes | None, mask: int):
        super().__init__({bytes([b]): 0 for b in b".,;:!?\n\x0b\x0c\r"})
        self.prefix, self.wanted, self.mask, self.texts, self.hashes = lang + b"\0", wanted, mask, [b""], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.prefix + word, seed=42)
        i = 0
        a, b = h & self.mask, h >> 32 & self.mask
        if self.wanted is None or (self.wanted[a >> 3] >> (a & 7) & self.wanted[b >> 3] >> (b & 7) & 1):
            i = len(self.texts)
            self.texts.append(word)
            self.hashes.append(h)
        self[word] = i
        return i


def word_hash(lang: str, word: str) -> Column:
    return F.xxhash64(F.concat(F.col(lang), F.lit("\0"), F.col(word)))


def word_slots(rows: DataFrame, mask: int) -> DataFrame:
    """The two slots of each word of rows (lang, w1)."""
    h = word_hash("lang", "w1")
    return rows.select(F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask)))).alias("slot"))


def pair_slots(rows: DataFrame, mask: int) -> DataFrame:
    """The two slots of each pair of rows (lang, w1, w2)."""
    a, b = word_hash("lang", "w1"), word_hash("lang", "w2")
    one = F.shiftleft(a, 1).bitwiseXOR(b).bitwiseAND(F.lit(mask))
    two = F.shiftrightunsigned(a, 20).bitwiseXOR(F.shiftrightunsigned(b, 9)).bitwiseAND(F.lit(mask))
    return rows.select(F.explode(F.array(one, two)).alias("slot"))


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """The bits of all slots, 64 to a number: 2**(bits - 6) rows at most reach the driver, whatever the number of slots."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def paired(ids: np.ndarray, hashes: np.ndarray, bits: np.ndarray, mask: int) -> np.ndarray:
    """For each two neighbours whether the bitmap knows the pair."""
    h = hashes[ids]
    a, b = h[:-1], h[1:]
    out = (ids[:-1] > 0) & (ids[1:] > 0)
    for s in (((a << np.uint64(1)) ^ b) & np.uint64(mask), ((a >> np.uint64(20)) ^ (b >> np.uint64(9))) & np.uint64(mask)):
        out &= (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) > 0
    return out


def windows(raw: bytes, size: int):
    """Slices of about ``size`` bytes that end between two tokens."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            found = ENDS.search(raw, end)
            end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def runs(docs: DataFrame, widths: tuple[int, ...], wanted: np.ndarray | None = None, pairs: np.ndarray | None = None, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """width, k, c: sorted runs of counts of phrases of these widths, k being the words and the language, parted by blanks; a phrase may be in several.

    A run is sorted by the words' numbers.  What a task holds is bounded over all its languages together.
    """
    low, longest = (1 << ID_BITS) - 1, max(widths)
    wanted_bits = None if wanted is None else wanted.tobytes()

    def batches_of(lang, words, width, keys, counts):
        texts, lang = pa.array(words.texts, pa.binary()), pa.scalar(lang.encode(), pa.binary())
        for at in range(0, len(keys), 50_000):
            now = keys[at : at + 50_000]
            k = pc.binary_join_element_wise(*(texts.take(pa.array((now >> (ID_BITS * (width - 1 - i))) & low)) for i in range(width)), lang, b" ")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(now), width, np.int8)), k.view(pa.string()), pa.array(counts[at : at + 50_000])], ["width", "k", "c"])

    def fresh_of(lang):
        return Words(lang.encode(), wanted_bits, sizes.mask), {w: WordCounts() if w == 1 else HatTrie(w, sizes.burst) for w in widths}

    def emptied(known, lang):
        words, tries = known.pop(lang)
        for width, trie in tries.items():
            yield from batches_of(lang, words, width, *trie.spill())

    def count(batches):
        known: dict[str, tuple[Words, dict]] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                for lang in pc.unique(part.column(0)).to_pylist():
                    rows = part.filter(pc.equal(part.column(0), lang)).column(1).to_pylist()
                    raw = b"\n".join(x or b"" for x in rows).translate(LOWER)
                    tail = np.zeros(0, np.int64)
                    for window in windows(raw, sizes.window):
                        words, tries = known.get(lang) or known.setdefault(lang, fresh_of(lang))
                        tokens = TOKEN.findall(window)
                        fresh = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
                        ids = np.concatenate([tail, fresh])
                        for width, trie in tries.items():
                            # phrases that end in this window
                            mine = ids[max(0, len(tail) - width + 1) :]
                            m = len(mine) - width + 1
                            if m <= 0:
                                continue
                            if pairs is None or width == 1:
                                good = np.all([mine[k : k + m] > 0 for k in range(width)], axis=0)
                            else:
                                near = paired(mine, np.array(words.hashes), pairs, sizes.mask)
                                good = np.all([near[k : k + m] for k in range(width - 1)], axis=0)
                            keys = np.zeros(m, np.int64)
                            for k in range(width):
                                keys = keys << ID_BITS | mine[k : k + m]
                            trie.add(*np.unique(keys[good], return_counts=True))
                        tail = ids[len(ids) - min(len(ids), longest - 1) :]
                        while sum(len(w) for w, _ in known.values()) > sizes.words:
                            # too many words to number: those of the language with most of them go with all that they number
                            most = max(known, key=lambda k: len(known[k][0]))
                            yield from emptied(known, most)
                            if most == lang:
                                last = [words.texts[i] for i in tail]
                                words, _ = known[lang] = fresh_of(lang)
                                tail = np.array([words[w] if w else 0 for w in last], np.int64)
                                break
                        while sum(t.size for _, tries in known.values() for t in tries.values()) > sizes.entries:
                            most, width = max(((k, w) for k in known for w in widths), key=lambda x: known[x[0]][1][x[1]].size)
                            trie = known[most][1][width]
                            yield from batches_of(most, known[most][0], width, *trie.spill(trie.size // 2))
        for lang in list(known):
            yield from emptied(known, lang)

    return docs.mapInArrow(count, "width byte, k string, c long")


def merged(parts: DataFrame, least: int) -> DataFrame:
    """width, k, f: the runs merged, for every word and for every phrase that occurs ``least`` times; settled.

    A task's runs hold a phrase once or a few times, so they are dealt as they are: summed before, they would fill a map with all that the task has counted.
    """
    sums = parts.repartition("width", "k").groupBy("width", "k").agg(F.sum("c").alias("f"))
    return settle(sums.where((F.col("width") == 1) | (F.col("f") >= least)))


def of_width(sums: DataFrame, width: int) -> DataFrame:
    """lang, w1 .. w<width>, f of the merged phrases of one width."""
    k = F.split("k", " ", width + 1)
    return sums.where(F.col("width") == width).select(k[width].alias("lang"), *(k[i].alias(f"w{i + 1}") for i in range(width)), "f")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole decimals."""
    d = lambda c: f"cast({c} as decimal(18, 0))"
    return F.expr(f"cast((1000000bd * {d(a)} * {d(a)}) div ({d(left)} * {d(right)}) as bigint)")


def phrase_counts(docs: DataFrame, least: int = 10, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """Tables of words (all of them), pairs and triples (of ``least`` occurrences): lang, w1.., f."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    short = merged(runs(docs, (1, 2), sizes=sizes), least)
    words, pairs = of_width(short, 1), of_width(short, 2)
    wanted = bitmap(word_slots(words.where(F.col("f") >= least), sizes.mask), sizes.bits)
    triples = merged(runs(docs, (3,), wanted, bitmap(pair_slots(pairs, sizes.mask), sizes.bits), sizes), least)
    return words, pairs, of_width(triples, 3)


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    A phrase goes if it lies within a longer candidate that has ``share`` percent of its occurrences or more.
    """
    words, pairs, triples = phrase_counts(docs, least, sizes)
    common = words.where(F.col("f") >= least)
    word = lambda name, count: common.select("lang", F.col("w1").alias(name), F.col("f").alias(count))
    pair = lambda one, two, count: pairs.select("lang", F.col("w1").alias(one), F.col("w2").alias(two), F.col("f").alias(count))
    two = pairs.withColumnRenamed("f", "a").join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"]).withColumn("score", score("a", "l", "r"))
    inside = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "f")
    inside = inside.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("f").alias("m"))
    two = two.join(inside, ["lang", "w1", "w2"], "left").where(F.col("m").isNull() | (100 * F.col("m") < share * F.col("a")))
    three = triples.withColumnRenamed("f", "a").join(word("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w3", "r2"), ["lang", "w3"])
    three = three.withColumns({"s1": score("a", "l1", "r1"), "s2": score("a", "l2", "r2")})
    later = F.col("s2") < F.col("s1")
    three = three.select("lang", "w1", "w2", "w3", "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"))
    text = lambda *ws: F.concat_ws(" ", *ws).alias("phrase")
    rows = two.select("lang", text("w1", "w2"), "a", "l", "r", "score").unionByName(three.select("lang", text("w1", "w2", "w3"), "a", "l", "r", "score"))
    # the best of each of SALTS parts of a language, and then of all: the last task of a language reads SALTS * top rows at most
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sums = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
