"""The conversation trie against a plain trie, on turns with every awkward case."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lotlens.llm import prefixtrie, queries

from ..compare import assert_same, connect

SCHEMA = "conv_id long, turn long, role string, text string, node int, depth int, name string, `a.b` int, _ int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "n", 1, 1, 1) for r in rows], SCHEMA).repartition(5)


def plain(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, seq in sorted(made.items()):
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    out = {p: [m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), 0, 0, 0, hashlib.sha256(",".join(str(c) for c in m if len(made[c]) == len(p)).encode()).hexdigest()] for p, m in nodes.items()}
    for p in nodes:
        if p:
            out[p[:-1]][4] += 1
    for p in nodes:
        leaf, saved = out[p][4] == 0, (len(nodes[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            out[p[:d]][5] += leaf
            out[p[:d]][6] += saved
    return sorted(map(tuple, out.values()), key=str)


def rows(seed=1):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["hé", "yes", "no", "", None, "a" * 50]))
    out = []
    for c in [0, 1, 2, 3, 5, 100, 101, 102, 150, 199, 201, 202, 305, 307, 7, 8, 9]:
        for t in range(rng.randint(1, 9)):
            out.append((c, t, *turn()))
    out += [(400, t, "user", "same") for t in range(3)]
    out += [(c, t, "user", "same") for c in range(401, 440) for t in range(rng.choice([3, 3, 3, 4]))]
    out += [(8, None, "user", "first"), (8, 2, "user", "tie"), (8, 2, "user", "tie"), (8, 2, "assistant", "tie"), (None, 1, "user", "lost"), (9, None, None, None)]
    out += [(c, t, "user", str(t % 3)) for c, k in ((500, 300), (501, 260), (502, 129), (503, 64), (504, 65)) for t in range(k)]
    return out


@pytest.mark.parametrize("span", [6, 2])
def test_trie(spark, monkeypatch, span):
    monkeypatch.setattr(prefixtrie, "SPAN", span)
    monkeypatch.setattr(prefixtrie, "MEET", 8)
    monkeypatch.setattr(prefixtrie, "JOINED", 4)
    made = rows()
    got = prefixtrie.shared_head_trie(table(spark, made)).collect()
    assert sorted(map(tuple, got), key=str) == plain(made)


def test_hot_first_turn_and_long_conversation(spark, monkeypatch):
    from lotlens.llm import common

    monkeypatch.setattr(common, "LEAST", 20)
    made = [(c, t, "user", "hello" if t == 0 else str(c % 7 * t)) for c in range(1000, 1300) for t in range(3)] + [(2000, t // 2, "user", "same") for t in range(1500)]
    got = prefixtrie.shared_head_trie(table(spark, made)).collect()
    assert sorted(map(tuple, got), key=str) == plain(made)


def test_empty_and_turnless(spark):
    assert prefixtrie.shared_head_trie(table(spark, [])).count() == 0
    # conversation 105 has no base, and its one turn lies within the head that it gives up
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    made = [(c, 0, "user", "gone")]
    got = prefixtrie.shared_head_trie(table(spark, made)).collect()
    assert sorted(map(tuple, got), key=str) == plain(made)
    assert len(got) == 1


def test_trie_of_other_sequences(spark):
    turns = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "b", 3), (2, 1, "a", 2)], "conv_id long, depth long, name string, size long").withColumn("name", F.unhex(F.md5("name")))
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_leaves, r.saved_tokens) for r in prefixtrie.trie(turns, turns.select("conv_id").distinct()).collect()}
    assert got == {(1, 0): (2, 1, 2), (1, 1): (2, 1, 2), (1, 2): (1, 1, 0)}


def test_query(spark, sf_dir):
    assert_same(queries.QUERIES["op12_conversation_prefix_trie"](spark, sf_dir), connect(sf_dir), queries.ORACLE["op12_conversation_prefix_trie"])
