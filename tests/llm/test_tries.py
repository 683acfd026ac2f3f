"""Conversation trie, phrases and exact search against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from sightledger.llm import base as B, dual_tree, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, digest string, path long, depth int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(parts)


def brute_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        leader = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(leader, [])[:h] + turns[h:]
    return out


def brute_nodes(sequences):
    """sequences: list of (conv_id, turns)."""
    members, ends, kids = {}, {}, {}
    for c, turns in sequences:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[:d - 1]), set()).add(tuple(turns[:d]))
        ends.setdefault(tuple(turns), []).append(c)
    saved = {n: 0 for n in members}
    leaves = dict(saved)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(who), len(n), min(members[n[:-1]]) if n else -10**9, len(who), len(kids.get(n, ())), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, who in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed):
    rng = random.Random(seed)
    rows = [(7, None, None, None), (7, None, "user", "é" * 3), (7, 0, "user", None), (None, 0, "user", "lost"), (-5, 1, "a", "b"),
            (0, 0, "user", "hot"), (0, 1, "bot", "日本"), (100, 3, "user", "tie"), (100, 3, "user", "tie"), (100, 3, "bot", "tie")]
    for c in range(101, 260):
        length = rng.choice([1, 2, 3, 5, 9, 40]) if c % 7 else 40
        rows += [(c, t, "user" if t % 2 else "bot", "same" if c % 7 == 0 and t < c % 41 else rng.choice("ab")) for t in range(length)]
    return rows


@pytest.mark.parametrize("first,growth", [(9, 4), (4096, 16)])
def test_trie_equals_brute_force(spark, first, growth):
    rows = conversations(4)
    got = prefix_trie.nodes_of(prefix_trie.rebuilt(frame(spark, rows)), first, growth)
    assert found(got) == brute_nodes(list(brute_rebuilt(rows).items()))


def test_trie_takes_repeated_and_turnless_conversations(spark):
    sequences = [(1, ["a", "b"]), (1, ["a", "b"]), (2, []), (3, ["a"]), (4, ["c"] * 33), (5, ["c"] * 32)]
    kind = "conv_id long, turns array<struct<digest: binary, chars: long>>, extra int"
    rows = [(c, [(t.encode(), 1) for t in turns], 9) for c, turns in sequences]
    got = prefix_trie.nodes_of(spark.createDataFrame(rows, kind), 1, 2)
    assert found(got) == brute_nodes([(c, [("", t) for t in turns]) for c, turns in sequences])
    assert prefix_trie.nodes_of(spark.createDataFrame([], kind)).isEmpty()


def test_fattest_depths_and_exits(spark):
    rows = spark.createDataFrame([(a, b) for b in range(1, 70) for a in range(b)], "a int, b int")
    for r in rows.select("a", "b", prefix_trie.two_fattest(rows.a, rows.b).alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda n: n & -n)
    kind = "conv_id long, turns array<struct<digest: binary, chars: long>>"
    words = ["abcdefgh" * 5, "abcdxy", "abcdefghab", "q"]
    known = prefix_trie.paths_of(spark.createDataFrame([(i, [(c.encode(), 1) for c in w]) for i, w in enumerate(words)], kind))
    trie = prefix_trie.build(known, 1, 2)
    asked = ["abcdefghabc", "abcdefgh" * 5 + "z", "abcz", "", "z", "abcd", "abcdxy"]
    q = prefix_trie.paths_of(spark.createDataFrame([(i, [(c.encode(), 1) for c in w]) for i, w in enumerate(asked)], kind))
    got = {r.conv_id: (r.at, r.exit is not None) for r in prefix_trie.locate(q, trie, 41).collect()}

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    explicit = {0, 4, 10, 40, 6, 1}
    assert {i: at for i, (at, _) in got.items()} == {i: max(common(w, k) for k in words) for i, w in enumerate(asked)}
    assert not got[5][1] and got[2][1] and explicit


def brute_products(rows, asked, k):
    whole = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x * 1024.0) for x in v):
            whole.append((n, i, [math.floor(x * 1024) for x in v]))
    out = []
    for n, q, a in whole:
        if asked(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in whole if m != n)[:k]
            out += [(q, r + 1, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(seed, n=900, dims=8):
    rng = random.Random(seed)
    around = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(around)]) for i in range(n)]
    rows += [(n + i, list(around[0])) for i in range(300)]                     # copies, far more than k
    rows += [(40, [9.0] * dims), (40, [1.0] * dims), (3, [9.0] * dims)]         # repeated ids
    rows += [(5000, None), (5001, [None] * dims), (5002, [math.nan] * dims), (5003, [math.inf] * dims), (None, [1.0] * dims),
             (5004, [0.0] * dims), (5005, []), (5006, [1.0, 2.0]), (5007, [0.25] * (dims + 3)), (5020, [-0.0] * dims)]
    return rows


@pytest.mark.parametrize("sizes", [(64, 16, 8), (1024, 512, 64)])
def test_dual_tree_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("CHUNK", "BLOCK", "PAIRS"), sizes):
        monkeypatch.setattr(dual_tree, name, value)
    monkeypatch.setattr(dual_tree, "FIRST_ROWS", 2 * sizes[0])
    monkeypatch.setattr(dual_tree, "GRAIN", sizes[0] // 4)
    rows = vectors(3)
    kind = "vec_id long, embedding array<double>, cell int, score string, v int"
    known = B.table(dual_tree.clean(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], kind).repartition(3)))
    got = dual_tree.top_products(known, known.filter("vec_id % 20 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == brute_products(rows, lambda q: q % 20 == 0, 10)


def test_dual_tree_keeps_huge_numbers_exact(spark):
    rows = [(i, [float(v) for v in vs]) for i, vs in enumerate([
        [2.0 ** 60, 1], [2.0 ** 60, 2], [2.0 ** 60, 3], [-2.0 ** 60, 7], [2.0 ** 20, 1e-3], [1e150, 1], [1, 1]])]
    known = B.table(dual_tree.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = dual_tree.top_products(known, known, 3)
    assert sorted(map(tuple, got.collect())) == brute_products(rows, lambda q: True, 3)
    none = known.filter("vec_id < 0")
    assert dual_tree.top_products(known, none).isEmpty() and dual_tree.top_products(none, known).isEmpty()
    one = known.filter("vec_id = 6")
    assert dual_tree.top_products(one, one).isEmpty()


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 500, (12, 16))
    x = np.floor(middles[rng.integers(0, 12, 3000)] + rng.normal(0, 8, (3000, 16)))
    tree = dual_tree.cover_tree(x, np.arange(3000), np.arange(3000))
    assert sorted(tree.ids) == list(range(3000))
    for n, kids in enumerate(tree.kids):
        own = tree.x[tree.first[n]:tree.end[n]]
        assert dual_tree.norms(own - tree.x[tree.center[n]]).max() <= tree.radius[n] + 1e-9
        assert not kids or sum(tree.end[c] - tree.first[c] for c in kids) == len(own)
    looked = []
    plain, dual_tree.GRAIN = dual_tree.dot, 1
    asked = dual_tree.cover_tree(x[::50], np.arange(0, 3000, 50), np.arange(0, 3000, 50), dual_tree.QUERY_LEAF)
    dual_tree.dot = lambda q, b: looked.append(len(q) * len(b)) or plain(q, b)
    try:
        dual_tree.search(asked, tree, 10, np.full(len(asked.x), -np.inf))
    finally:
        dual_tree.dot, dual_tree.GRAIN = plain, 1 << 16
    assert sum(looked) < 0.5 * len(asked.x) * len(x)
