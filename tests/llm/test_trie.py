"""The conversation trie (operator 11) against nested dictionaries."""

import hashlib
import random
import zlib

import pytest

from recoflow.llm import trie

INPUT = "conv_id long, turn long, role string, text string, node string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """rows: in the order in which equal turn numbers are to stand."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, inside in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(inside) if len(rebuilt[c]) == len(prefix))
        out.append((min(inside), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, n=150, longest=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-150, 900)
        if any(r[0] == c for r in rows):
            continue
        for t in range(rng.randint(1, longest)):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]), rng.choice(["é", "bb", "", None, "c"])))
    return rows


def frame(spark, rows):
    rng = random.Random(0)
    rows = [(*r, "x") for r in rows]
    return spark.createDataFrame(rng.sample(rows, len(rows)), INPUT)


def result(spark, rows, **options):
    got = trie.conversation_trie(frame(spark, rows), **options)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("local", [trie.LOCAL, 60])
def test_against_dictionaries(spark, local):
    rows = chats(1)
    assert result(spark, rows, local=local) == plain(rows)


def test_deep_hot_and_equal_conversations(spark):
    deep = [(100, t, "user", str(t % 3)) for t in range(120)]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(3)]
    rows = [*deep, *copies, (300, 1, "a", "b"), (300, 1, "a", "b"), (None, 1, "user", "nobody's")]
    assert result(spark, rows, local=100) == plain(rows)
    nothing = [(101, 0, "user", "only turn")]
    assert result(spark, nothing) == plain(nothing)
    assert trie.conversation_trie(frame(spark, [])).collect() == []


def test_ends_of_many_parts_stream(spark):
    ids = [1, 2, 3000, 5000, 5001, -7, 900000]
    rows = [(c, 1, 1, 1) for c in ids] + [(8, 0, 0, 8)]
    got = trie.end_digests(spark.createDataFrame(rows, "member long, depth long, n_turns long, conv_id long")).collect()
    want = {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 8: hashlib.sha256(b"8").hexdigest()}
    assert {r["conv_id"]: r["ends_sha256"] for r in got} == want


def test_decomposition_of_random_trees():
    rng = random.Random(3)
    for n in (1, 2, 40, 300):
        parent = [-1] + [rng.randrange(max(0, i - 4), i) for i in range(1, n)]
        own = [rng.randint(1, 5) for _ in range(n)]
        weight, want = list(own), [list(range(n)), [3] * n]
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            for w in want:
                w[parent[i]] += w[i]
        sums = [[0] * n, [0] * n]
        trie.split_component(list(range(n)), parent, weight, [list(range(n)), [3] * n], sums)
        assert sums == want
