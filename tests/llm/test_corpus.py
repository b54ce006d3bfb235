"""The corpus operators against plain versions on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlens.llm import chunks, common, components, decontaminate, hashing, linededup, ngramlm, packing, quality, sentences, simhash, substring, tokens

from . import fixture


@pytest.fixture(scope="module")
def data(spark):
    df, made = fixture.docs(spark)
    df = df.cache()
    return df, made


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    """Several chunks and shards even on small tables."""
    monkeypatch.setattr(chunks.chunk_table, "__defaults__", (4000,))
    monkeypatch.setattr(chunks.shard_count, "__defaults__", (9000,))


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_substring_dedup(spark, data):
    df, made = data
    got = substring.substring_dedup(df).drop("removed").collect()
    first = {}
    for i, t in made:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = []
    for i, t in made:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    same(got, want)
    assert sum(w[2] for w in want) > 500
    assert substring.substring_dedup(fixture.empty(spark)).count() == 0


def test_radix_passes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    size = np.full(40, 70)
    start = rng.integers(0, 2900, 40)
    group, doc = np.sort(rng.integers(0, 5, 40)), rng.integers(0, 9, 40)
    data = np.concatenate([text[s : s + 70] for s in start])
    least = {}
    for j in range(40):
        for k in range(21):
            w = (group[j], bytes(data[70 * j + k : 70 * j + k + 50]))
            least[w] = min(least.get(w, 99), doc[j])
    want = [least[(group[j], bytes(data[70 * j + k : 70 * j + k + 50]))] < doc[j] for j in range(40) for k in range(21)]
    for most in (1, 50, 10**6):
        assert substring.radix_repeats(group, doc, size, data, 50, most).tolist() == want


def test_lm_scores(spark, data):
    df, made = data
    got = ngramlm.score_texts(df).collect()
    rows = [(i, (t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in made]
    count = collections.Counter(w for _, ws, held in rows if not held for w in ws)
    n, v = sum(count.values()), len(count)
    pairs = collections.Counter(p for _, ws, held in rows if not held for p in zip([None, *ws], ws))
    kind = lambda c: math.frexp(max(c, 1))[1]
    seen, once = collections.Counter(), collections.Counter()
    for (a, _), c in pairs.items():
        seen[kind(count[a])] += c
        once[kind(count[a])] += c == 1
    rest = {k: min(0.8, max(0.05, once[k] / seen[k])) for k in seen}
    p = lambda w: (count[w] + 1) / (n + v + 1)
    q = lambda a, w: (1 - rest[kind(count[a])]) * pairs[a, w] / count[a] + rest[kind(count[a])] * p(w) if count[a] else p(w)
    want = {(str(i), len(ws), held): (sum(w is None or count[w] > 0 for w in ws) if count[None] else 0, n, sum(math.log10(p(w)) for w in ws), sum(math.log10(q(a, w)) for a, w in zip([None, *ws], ws))) for i, ws, held in rows}
    assert len(got) == len(made) and any(r.held_out for r in got)
    for r in got:
        known, total, base, score = want[str(r.doc_id), r.n_tokens, r.held_out]
        assert (r.n_known, r.train_tokens) == (known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, abs=2e-4 * r.n_tokens)
    # probabilities of all next words, and of one unseen, sum to one
    assert sum(q(None, w) for w in count) + rest[kind(count[None])] / (n + v + 1) == pytest.approx(1)
    assert ngramlm.score_texts(fixture.empty(spark)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top in (1, 50, 10**6, 10**12):
        for n in (0, 1, 2, 700):
            values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
            ef = ngramlm.EliasFano(values)
            ef.open(*ef.arrays())
            assert (ef.access(np.arange(n)) == values).all()
            asked = np.concatenate([values, rng.integers(0, top + 5, 50).astype(np.uint64)])
            assert (ef.find(asked) == np.searchsorted(values, asked)).all()


def plain_pieces(t):
    """The pieces of a text for op1, by other means: marks after every cut."""
    words = lambda x: re.findall(r"[^\x09-\x0D\x20]+", x)
    out = []
    for p in re.sub("([.!?][ \t\r\n]+|\n+)", "\\1\x01", t).split("\x01"):
        for q in [p] if len(words(p)) <= 20 else re.sub("([,;:][ \t\r\n]+)", "\\1\x01", p).split("\x01"):
            if len(words(q)) > 20:
                q = re.sub(r"([^\x09-\x0D\x20]+)([\x09-\x0D\x20]*)", lambda m: m[0] + ("\x01" if hashlib.md5(m[1].encode()).hexdigest()[0] in "01" else ""), q)
            out += q.split("\x01")
    return out


def test_sentence_dedup(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "é", "in", "st"]) for _ in range(rng.randint(1, 4)))
    said = lambda n: " ".join(word() for _ in range(n)) + rng.choice([". ", "! ", ".\n", ", ", ": "])
    passage = "".join(said(rng.randint(4, 14)) for _ in range(7)).strip() + ". "
    bare = " ".join(word() for _ in range(60))
    texts = [(i, "".join(said(rng.randint(1, 25)) for _ in range(rng.randint(1, 20)))) for i in range(30)]
    texts += [(100 + i, said(9)[:-3] + " " + passage + said(5)) for i in range(5)] + [(200 + i, said(9)[:-2] + bare + " " + said(4)) for i in range(3)]
    texts += [(300, "a few words"), (301, "a few words  "), (302, " a few words\n"), (303, ""), (304, None), (305, " \n"), (None, passage), (31, texts[3][1]), (31, texts[6][1]), texts[4], texts[4], (306, "one " * 500), (307, passage + passage)]
    df, made = fixture.docs(spark, texts=texts)
    got = sentences.sentence_dedup(df).collect()
    pieces = {(i, t): [(k, p.strip(" \t\r\n")) for k, p in enumerate(plain_pieces(t)) if p.strip(" \t\r\n")] for i, t in set(made) if t is not None}

    def runs(ps):
        n, out = [len(p.encode().split()) for _, p in ps], []
        for i in range(len(ps)):
            j = next((j for j in range(i + 2, len(ps) + 1) if sum(n[i:j]) >= 20), None)
            if j:
                out.append((i, j, tuple(p for _, p in ps[i:j])))
        return out or ([(0, len(ps), ("whole", *(p for _, p in ps)))] if ps else [])

    # two texts of one id are told apart by a hash; here the fixture's have no run in common
    first = {}
    for (i, t), ps in pieces.items():
        if i is not None:
            for at, _, k in runs(ps):
                first[k] = min(first.get(k, (i, at)), (i, at))
    want = []
    for i, t in made:
        ps, gone = pieces.get((i, t), []), set()
        for at, to, k in runs(ps):
            if i is not None and first[k] != (i, at):
                gone |= set(range(at, to))
        out = {ps[k][0] for k in gone}
        want.append((i, len(ps), len(gone), t if not gone else "".join(p for k, p in enumerate(plain_pieces(t)) if k not in out)))
    same(got, want)
    removed = {w[0]: w[2] for w in want}
    assert all(removed[i] > 2 for i in (101, 102, 103, 104, 201, 202)) and removed[100] == 0 and removed[301] == removed[302] == 1
    assert sentences.sentence_dedup(fixture.empty(spark)).count() == 0
    assert sentences.sentence_dedup(df.where("text IS NULL")).collect()[0].text is None


def test_joins_deal_a_hot_key_by_its_rows(spark, monkeypatch):
    """Each place of a hot key has about as many rows as a task should hold, and no row is lost or doubled."""
    monkeypatch.setattr(common, "LEAST", 100)
    rows = spark.createDataFrame([("hot" if k % 3 == 0 else f"k{k % 50}", k) for k in range(3000)], "key string, v int")
    kinds = common.settle(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")))
    got = common.join_hot(rows, kinds, ["key"])
    want = rows.join(kinds.drop("n"), "key")
    assert sorted(map(tuple, got.select("key", "v", "least").collect())) == sorted(map(tuple, want.select("key", "v", "least").collect()))
    places = rows.where("key = 'hot'").groupBy(F.pmod(F.hash("key", "v"), F.lit(10))).count().collect()
    assert len(places) == 10 and max(r["count"] for r in places) < 150


def test_a_hot_run_is_dealt_out(spark, monkeypatch):
    """A passage in every document: each document but the first loses it, whichever place its runs are dealt to."""
    monkeypatch.setattr(common, "LEAST", 50)
    passage = " ".join(f"Alpha{k} beta gamma delta epsilon zeta." for k in range(8))
    df, _ = fixture.docs(spark, texts=[(i, f"Own words of {i} here, as no other. {passage} And an end of {i}.") for i in range(300)])
    got = {r.doc_id: r for r in sentences.sentence_dedup(df).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 8 and got[i].text == f"Own words of {i} here, as no other. And an end of {i}." for i in range(1, 300))


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(spark, data, least):
    df, made = data
    got = linededup.line_dedup(df, least).select("doc_id", "text", "n_lines", "n_deleted").collect()
    lines = {(i, t): [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")] for i, t in set(made) if t is not None}
    first = {}
    for (i, t), ls in lines.items():
        if i is not None:
            for k in range(len(ls) - least + 1):
                w = tuple(x for _, x in ls[k : k + least])
                first[w] = min(first.get(w, (i, k)), (i, k))
    want = []
    for i, t in made:
        ls, gone = lines.get((i, t), []), set()
        for k in range(len(ls) - least + 1):
            if i is not None and first[tuple(x for _, x in ls[k : k + least])] != (i, k):
                gone |= set(range(k, k + least))
        out = {ls[k][0] for k in gone}
        want.append((i, t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out), len(ls), len(gone)))
    same(got, want)
    assert linededup.line_dedup(fixture.empty(spark), least).count() == 0
    kept = linededup.keep_first_copies(df, least)
    assert kept.columns == df.columns


@pytest.mark.parametrize(("least", "share"), [(2, None), (3, None), (1, 3), (2, 3), (3, 7)])
def test_maximal_repeated_runs(spark, monkeypatch, least, share):
    """Lengths of the longest runs that occur earlier, over few different lines, copies of documents and repeats within one; with ``share``, classes of
    more suffixes are cut into slices and stretches, joined two by two."""
    if share:
        monkeypatch.setattr("lotlens.llm.common.LEAST", share)
        monkeypatch.setattr(linededup, "FAN", 2)
    rng = random.Random(least)
    made = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(25)]
    made += [made[3], made[5] + made[7], list("abcabcabcabc"), list("a" * 9), ["z"], made[3] + ["q"], list("uvwxyz" * 3)]
    df, _ = fixture.docs(spark, texts=[(i, "\n".join(x)) for i, x in enumerate(made)])
    lines = linededup.first_ranks(linededup.suffixes(df.withColumn("row", F.col("doc_id") * 7), "row")).cache()
    got = {(r.doc_id, r.at): r.length for r in linededup.repeated_runs(lines, "row", least).collect()}
    places = [(i, k) for i, x in enumerate(made) for k in range(len(x))]

    def common(p, q):
        x, y = made[p[0]][p[1] :], made[q[0]][q[1] :]
        return next((n for n, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))

    longest = {p: max((common(p, q) for q in places[:n]), default=0) for n, p in enumerate(places)}
    want = {(i, k): n for (i, k), n in longest.items() if n >= least and not (longest.get((i, k - 1), 0) >= least and longest[i, k - 1] == n + 1)}
    assert got == want and max(want.values()) >= 9


def test_a_line_before_many_others_is_dealt_out(spark, monkeypatch):
    """One line before 3000 different ones, each of which comes twice: no window and no array takes more than a share of them."""
    monkeypatch.setattr(common, "LEAST", 200)
    df, _ = fixture.docs(spark, texts=[(i, f"the line of all\nline {i % 3000}\nend of {i}") for i in range(6000)])
    lines = common.settle(linededup.first_ranks(common.settle(linededup.suffixes(df.withColumn("row", F.col("doc_id")), "row"))))
    assert sorted(map(tuple, linededup.repeated_runs(lines, "row").select("doc_id", "at", "length").collect())) == [(i, 0, 2) for i in range(3000, 6000)]
    hot = spark.createDataFrame([(0, 6000)], "rank long, size long")
    made = spark.range(3000).select(F.lit(0).cast("long").alias("rank"), (F.col("id") - F.when(F.col("id") < 900, F.col("id") + 1).otherwise(0)).alias("then"), F.when(F.col("id") < 900, F.xxhash64("id")).otherwise(F.lit(0)).alias("end"), F.lit(2).cast("long").alias("n"), F.struct(F.col("id").alias("doc_id"), F.col("id").alias("row"), F.lit(0).alias("at")).alias("first"))
    parts = linededup.in_order(made, hot, 200).orderBy("part").collect()
    assert [r.part for r in parts] == list(range(0, 6000, 2)) and parts[0].before is None
    assert all(b.before == a.first for a, b in zip(parts, parts[1:])) and [r.then for r in parts if r.then >= 0] == list(range(900, 3000))
    stretches = collections.Counter(r.part // 200 for r in parts)
    assert max(stretches.values()) == 100


def test_parts_that_may_meet_others_are_few():
    """Of a stretch at most two parts for each length of prefix go on, and what is found with them is what is found at once."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 40)
        first, length = [(x,) for x in rng.sample(range(1000), n)], [0, *(rng.choice((0, 2, 3, 3, 4)) for _ in range(n - 1))]
        want, width = linededup._longest(first, length, [0] * n), rng.randint(1, 9)
        kept, best, got = [], [], {}
        for at in range(0, n, width):
            f, s = first[at : at + width], length[at : at + width]
            b = linededup._longest(f, s, [0] * len(f))
            got.update(zip(range(at, at + width), b))
            which, shared = linededup._outward(f, s)
            assert len(which) <= 8
            kept += [(at + i, k) for i, k in zip(which, shared)]
        best = linededup._longest([first[i] for i, _ in kept], [k for _, k in kept], [got[i] for i, _ in kept])
        got.update(zip((i for i, _ in kept), best))
        assert [got[i] for i in range(n)] == want


def test_token_files_round_trip(spark, data):
    from tokenizers import Tokenizer

    df, made = data
    tk = Tokenizer.from_file(tokens.vocabulary())
    got = tokens.read_token_files(tokens.write_token_files(df, tokens.vocabulary(), segment=100)).collect()
    ids = lambda t: [*tk.encode(t or "", add_special_tokens=False).ids, 2]
    at, want = 0, []
    for i, t in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = ids(t)
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    same(got, want)
    assert tokens.read_token_files(tokens.write_token_files(fixture.empty(spark), tokens.vocabulary())).count() == 0


def test_words_are_cut_as_the_tokenizer_cuts_them():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.vocabulary())
    odd = ["Don't STOP 'S it's İstanbul ΣΑΣ ς é 12ab3.4''re", "<|endoftext|> hi<|startoftext|>x <|ENDOFTEXT|>", "KÅ ﬁ ½ 漢字 👩‍👧 ×÷ a×b", "a\x00b ́x don’t", "", " ", "ÀÉß ſ ÿ Ÿ"]
    raw = "".join(odd).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in odd])])
    ids, at = tokens.encoder(tokens.vocabulary())(np.frombuffer(raw, np.uint8), offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tk.encode(t, add_special_tokens=False).ids for t in odd]


def test_patched_blocks():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 49408, 1 << 32):
            v = (rng.random(n) ** 4 * top).astype(np.uint32)
            assert (tokens.pfor_decode(tokens.pfor_encode(v)) == v).all()


def test_packing(spark, data):
    from tokenizers import Tokenizer

    df, made = data
    tk = Tokenizer.from_file(tokens.vocabulary())
    got = packing.pack(packing.cut_documents(df, tokens.vocabulary(), 64), 64).toPandas()
    want = []
    for i, t in made:
        x = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(x[a : a + 64]), zlib.crc32(np.array(x[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(x), 64))]
    clean = got.astype(object).where(got.notna(), None)
    same([tuple(None if v is None else int(v) for v in r) for r in clean.iloc[:, :5].values], want)
    for _, g in got.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2
    assert packing.pack(packing.cut_documents(fixture.empty(spark), tokens.vocabulary())).count() == 0


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(3, 40, 5)}
        items = [k for k, c in counts.items() for _ in range(c)]
        best = {0}
        for x in items:
            best |= {b + x for b in best if b + x <= 61}
        pick = packing.fullest(61, sorted(counts, reverse=True), counts)
        assert sum(k * c for k, c in pick.items()) == max(best) and all(c <= counts[k] for k, c in pick.items())


def test_simhash_classes(spark, data):
    import xxhash

    df, made = data
    rng = np.random.default_rng(5)
    got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()

    def finger(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [finger(t) for _, t in made]
    name = list(range(len(made)))
    for _ in made:
        name = [min(name[j] for j in range(len(made)) if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in range(len(made))]
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(made):
        if i is not None:
            ids[name[k]].append(i)
    same(got, [(i, f"{f:016x}", min(ids[name[k]])) for k, ((i, _), f) in enumerate(zip(made, fps))])
    assert simhash.near_duplicates(fixture.empty(spark)).count() == 0
    x = rng.integers(0, 1 << 64, 300, np.uint64)
    x[100:] = x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, np.uint64))
    x = np.unique(x)
    links = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    found = {r.node: r.component for r in components.components(links).collect()}
    signed = x.view(np.int64)
    for i in range(len(x)):
        for j in range(i):
            if bin(int(x[i] ^ x[j])).count("1") <= 3:
                assert found[int(signed[i])] == found[int(signed[j])]


def test_pivots_discard_before_pairs_are_verified():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 8000, np.uint64)
    fps[1::8] = fps[::8] ^ np.uint64(5)
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    a, b, pairs, left = simhash.linked(fps, table, np.full(1000, 8), 3)
    want = {(8 * g + i, 8 * g + j) for g in range(1000) for i in range(8) for j in range(i + 1, 8) if bin(int(fps[8 * g + i] ^ fps[8 * g + j])).count("1") <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) == 1000
    assert pairs == 28000 and 1000 <= left < 1100  # the pivots discard over 99 percent of the unrelated pairs
    a, b, _, _ = simhash.linked(fps, table, np.full(20, 400), 3)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == want


def test_large_buckets_of_fingerprints_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", 20)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 38, 400, np.uint64)  # all agree on the two upper blocks
    x[200:] = x[:200] ^ (np.uint64(1) << rng.integers(0, 38, 200, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 38, 200, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 38, 200, np.uint64))
    x = np.unique(x).view(np.int64)
    found = {r.node: r.component for r in components.components(simhash.links(spark.createDataFrame([(int(v),) for v in x], "fp long"))).collect()}
    name = {int(v): int(v) for v in x}
    near = [(int(v), int(u)) for v in x for u in x if v < u and bin(int(v) ^ int(u)).count("1") <= 3]
    for _ in range(20):
        for v, u in near:
            name[v] = name[u] = min(name[v], name[u])
    assert len(near) >= 200 and all(found.get(v, v) == c for v, c in name.items())


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def similar_pairs(sets, least=0.8):
    """All pairs of different sets with a Jaccard similarity of ``least``: two such share one of the first (1 - least) of their members in any order."""
    places, out = collections.defaultdict(list), set()
    for k, s in enumerate(sets):
        for x in sorted(s, key=hash)[: len(s) - math.ceil(least * len(s)) + 1]:
            for j in places[x]:
                if (j, k) not in out and len(s & sets[j]) >= least * len(s | sets[j]):
                    out.add((j, k))
            places[x].append(k)
    return out


def test_recall_of_similar_pairs(spark, sf_dir):
    """Of all pairs of different sets of shingles at 0.8 or more, how many end in one class; exact copies do not count.

    Planted pairs of 0.80 to 0.85 and of 0.85 to 0.97 stand beside the pairs of the table."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(12)
    planted = []
    for k in range(400):
        w = [f"p{int(x)}" for x in rng.integers(0, 10**6, 300)]
        planted.append((10**7 + 2 * k, " ".join(w)))
        for at in rng.choice(58, 5 + k % 2 if k < 200 else 1 + k % 4, replace=False) * 5 + 3:
            w[at] = f"edit{int(at)}"
        planted.append((10**7 + 2 * k + 1, " ".join(w)))
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    kinds = [s for s in first if s]
    pairs = similar_pairs(kinds)
    left = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    name = {k: k for k in range(len(kinds))}
    for _ in range(30):
        for j, k in pairs:
            name[j] = name[k] = min(name[j], name[k], key=lambda x: first[kinds[x]])
    want = {first[s] for k, s in enumerate(kinds) if name[k] == k} | {i for i, s in sets.items() if not s}
    assert pairs and want <= left  # nothing goes that brute force keeps
    found = lambda ids: [not {first[kinds[j]], first[kinds[k]]} <= left for j, k in pairs if first[kinds[k]] in ids or first[kinds[j]] in ids]
    for ids in (range(10**7, 10**7 + 400), range(10**7 + 400, 10**7 + 800)):
        assert len(found(ids)) == 200 and np.mean(found(ids)) >= 0.9
    table = found(range(10**7))
    assert table and np.mean(table) >= 0.6  # a handful of pairs
    assert not {i for i, s in sets.items() if s and first[s] != i} & left  # no exact copy stays


def test_buckets_over_the_limit_lose_nothing(spark, monkeypatch):
    """Copies that only their original links, in buckets that are dealt in parts."""
    monkeypatch.setattr(simhash, "LIMIT", 100)
    monkeypatch.setattr(simhash, "ANCHORS", 10)
    rng = np.random.default_rng(11)
    original = [f"w{int(x)}" for x in rng.integers(0, 10**6, 304)]
    texts = [(500, " ".join(original))]
    for k in range(400):
        w = list(original)
        for at in rng.choice(60, 4, replace=False) * 5 + 2:
            w[at] = f"edit{k}x{int(at)}"
        texts.append((k, " ".join(w)))
    texts += [(1000 + k, " ".join(f"v{int(x)}" for x in rng.integers(0, 10**6, 100))) for k in range(50)]
    df, _ = fixture.docs(spark, texts=texts)
    left = sorted(r.doc_id for r in simhash.keep_one(df).select("doc_id").collect())
    assert set(range(1000, 1050)) <= set(left) and left[0] == 0 and len(left) <= 50 + 1 + 4


def test_similar_texts_keep_one(spark):
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 150)) for _ in range(20)]

    def edited(t, k):
        w = t.split()
        for at in rng.choice(len(w), k, replace=False):
            w[at] = "edit" + str(int(rng.integers(1e9)))
        return " ".join(w)

    texts = [(i, t) for i, t in enumerate(base)] + [(100 + 10 * i + k, edited(t, 2)) for i, t in enumerate(base[:10]) for k in range(3)]
    texts += [(300, base[0]), (301, base[0].upper()), (302, ""), (303, None), (None, base[1]), (304, "few words"), (305, "few words"), (5, base[5])]
    df, made = fixture.docs(spark, texts=texts)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [*range(20), 302, 303, 304]
    assert out.where("doc_id IS NULL").count() == 1
    assert simhash.keep_one(fixture.empty(spark)).count() == 0


def test_copies_that_only_their_original_links(spark):
    """A thousand copies, each 0.85 to one original and about 0.73 to each other: the links to the original must be tried."""
    rng = np.random.default_rng(11)
    original = [f"w{int(x)}" for x in rng.integers(0, 10**6, 304)]
    texts = [(0, " ".join(original))]
    for k in range(1, 1001):
        w = list(original)
        for at in rng.choice(60, 5, replace=False) * 5 + 2:  # 24 or 25 of 300 shingles change
            w[at] = f"edit{k}x{int(at)}"
        texts.append((k, " ".join(w)))
    df, _ = fixture.docs(spark, texts=texts)
    left = sorted(r.doc_id for r in simhash.keep_one(df).select("doc_id").collect())
    assert left[0] == 0 and len(left) <= 1 + 20


def test_the_shingles_decide_at_the_threshold(spark):
    """Pairs at 267/333 (0.8018) are one class, pairs at 266/334 (0.7964) are two, whatever the fingerprints' estimate says."""
    rng = np.random.default_rng(12)
    texts = []
    for k in range(60):
        w = [f"w{int(x)}" for x in rng.integers(0, 10**6, 304)]
        texts.append((k, " ".join(w)))
        for first, name in ((2, 100), (3, 200)):  # an edit of word 2 changes three shingles, of word 3 four, and of the others five each
            copy = list(w)
            for at in [first, *range(20, 80, 10)] if name == 100 else [first, *range(220, 280, 10)]:
                copy[at] = f"edit{name + k}x{at}"
            texts.append((name + k, " ".join(copy)))
    df, _ = fixture.docs(spark, texts=texts)
    left = {r.doc_id for r in simhash.keep_one(df).select("doc_id").collect()}
    assert left >= {*range(60), *range(200, 260)} and len(left & {*range(100, 160)}) <= 4  # the bands may miss 3 percent


def plain_overlaps(made, items):
    """Every document against every item along every diagonal."""
    want = {}
    for i, t in made:
        w = (t or "").lower().split()
        for k, b in items:
            v = (b or "").lower().split()
            n = min(13, len(v))
            for shift in range(-len(v), len(w)) if v else []:
                hit = [int(0 <= shift + j < len(w) and w[shift + j] == x) for j, x in enumerate(v)]
                best = max(sum(hit[a : a + n]) for a in range(len(v) - n + 1))
                if best * 100 >= 80 * n:
                    want[i, k] = max(want.get((i, k), (0, n)), (best, n))
    return want


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{int(rng.integers(0, 3000))}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([40, 25, 13, 7, 5, 3])] + [(6, None), (7, "")]
    items += [(8, items[0][1]), (None, items[3][1])]

    def changed(t, every):
        return " ".join("sub" if k % every == every - 1 else x for k, x in enumerate(t.split()))

    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [(0, fill(30) + " " + items[0][1] + " " + fill(9)), (1, fill(5) + "\n" + changed(items[0][1], 6) + " " + fill(5)), (2, items[1][1].upper()), (3, changed(items[1][1], 3)),
             (4, fill(200)), (5, items[3][1]), (6, items[4][1]), (7, items[5][1]), (8, None), (9, ""), (None, items[2][1]), (10, items[0][1] + " " + items[2][1]), (10, items[0][1] + " " + items[2][1]), (11, items[0][1][:60])]
    df, made = fixture.docs(spark, texts=texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_agree, r.n_compared) for r in decontaminate.overlaps(df, bench).collect()}
    want = plain_overlaps(made, items)
    assert got == want and {(0, 0), (0, 8), (1, 0), (2, 1), (5, None), (7, 5), (10, 2), (None, 2)} <= set(want)
    clean = decontaminate.drop_contaminated(df, bench)
    found = {i for i, _ in want if i is not None}
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in made if i not in found)
    assert decontaminate.overlaps(fixture.empty(spark), bench).count() == 0
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0


def test_decontamination_of_every_length_and_substitution(spark, monkeypatch):
    """Items of 1 to 14 tokens with every allowed choice of substituted places, and with one substitution more."""
    items = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in range(1, 15)]
    texts = []
    for n, t in items:
        most = min(n, 13) - math.ceil(min(n, 13) * 0.8)
        for gone in (g for m in (most, most + 1) for g in itertools.combinations(range(n), m)):
            texts.append((len(texts), " ".join(["before", *("sub" if k in gone else w for k, w in enumerate(t.split())), "after"])))
    df, made = fixture.docs(spark, texts=texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_overlaps(made, items)
    got = {(r.doc_id, r.item_id): (r.n_agree, r.n_compared) for r in decontaminate.overlaps(df, bench).collect()}
    assert got == want and {k for _, k in want} == set(range(1, 15))
    monkeypatch.setattr(decontaminate, "SEND", 15)  # in blocks
    assert {(r.doc_id, r.item_id): (r.n_agree, r.n_compared) for r in decontaminate.overlaps(df.where("doc_id % 9 = 0"), bench).collect()} == {k: v for k, v in want.items() if k[0] % 9 == 0}
    with pytest.raises(ValueError):
        decontaminate.overlaps(df, bench, masks=("11111011", "1101111011"))


def plain_counts(t):
    t = t or ""
    w = t.encode().split()
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    c = collections.Counter(grams)
    cover = {k + j for k, g in enumerate(grams) if c[g] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, sf_dir):
    texts = [(0, "a b\na b\n\n  \nc"), (1, "the cat sat on a mat by me " * 5), (2, None), (3, ""), (4, "é " * 30 + "#$ <é>"), (5, "x\r\nx\n\tx\n"), (6, " ".join(map(str, range(40))))]
    df, made = fixture.docs(spark, texts=texts + [(7, texts[1][1]), (None, "a b")])
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_logistic(*quality.labelled_sample(df, labels))
    got = quality.quality_rules(df, model).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(i, *plain_counts(t)) for i, t in made])
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.quality_rules(fixture.empty(spark), model).count() == 0
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = whole.limit(60).collect()
    raw = "".join(r.text for r in rows).encode()
    c = quality.text_counts(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(r.text.encode()) for r in rows])]))
    assert list(zip(*(c[k].tolist() for k in quality.NAMES))) == [plain_counts(r.text) for r in rows]


def test_models_learn_held_out_labels(spark, sf_dir):
    """Trained on two thirds of the labels, both models order the others almost without fault."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    sample = quality.labelled_sample(docs, labels, allowed=~held)
    for fit in (quality.fit_logistic, quality.fit_embeddings):
        rows = quality.score_quality(docs, fit(*sample)).join(labels, "doc_id").where(held).select("score", "quality").toPandas()
        good, bad = rows[rows.quality == 1].score.values, rows[rows.quality == 0].score.values
        assert len(bad) >= 8 and (good[:, None] > bad[None, :]).mean() > 0.95
        assert ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.9


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slice_hashes_depend_on_bytes_alone():
    raw = np.frombuffer(b"abcabcab", np.uint8)
    h = hashing.slice_hashes(raw, np.array([0, 3, 1, 4, 0]), np.array([3, 6, 4, 7, 2]))
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3
