"""Vector codes (operator 13) against plain Python integers."""

import hashlib
import random

import numpy as np
import pytest

from recoflow.llm import codes

INPUT = "vec_id long, embedding array<double>, label long, code string"


def plain(rows, parts, entries, rounds, scale=1024):
    usable = [r for r in rows if r[1] is not None and all(x is not None and abs(x) < float("inf") for x in r[1])]
    usable = sorted(usable, key=lambda r: (r[0] is not None, r[0] or 0, [int(np.floor(scale * x)) for x in r[1]]))
    size = len(usable[0][1])
    usable = [r for r in usable if len(r[1]) == size]
    whole = [[int(np.floor(scale * x)) for x in r[1]] for r in usable]
    w = size // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in cut:
                got.setdefault(best(v[p], books[p]), []).append(v[p])
            for e, members in got.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, total = [], {}
    for r, v in zip(usable, cut, strict=True):
        code = [best(v[p], books[p]) for p in range(parts)]
        error = sum(far(v[p], books[p][code[p]]) for p in range(parts))
        total[r[2]] = total.get(r[2], 0) + error
        out.append((r[0], bytes(code).hex(), error, r[2]))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def table(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    rows = [(rng.randrange(-50, 400), [rng.gauss(0, spread) for _ in range(dims)], rng.choice([None, 1, 2]), "x") for _ in range(n)]
    bad = [(1, None, 1, "x"), (2, [None] * dims, 1, "x"), (3, [float("nan")] * dims, 1, "x"), (4, [float("inf")] * dims, None, "x"), (900, [0.5] * (dims + 4), 1, "x"), (901, [], 1, "x")]
    return rows + bad + [rows[0], rows[0], (None, rows[1][1], None, "x")]


@pytest.mark.parametrize("spread", [1.0, 9000.0])
def test_against_plain_integers(spark, spread):
    rows = table(3, 150, 8, spread)
    got = codes.vector_codes(spark.createDataFrame(rows, INPUT), entries=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 4, 16, 4)


def test_few_and_no_vectors(spark):
    few = [(5, [0.1, 0.2, -0.3, 0.4], None, "x"), (5, [0.1, 0.2, -0.3, 0.4], None, "x"), (1, [9.0, 1.0, 1.0, 1.0], 3, "x")]
    assert sorted(map(tuple, codes.vector_codes(spark.createDataFrame(few, INPUT)).collect()), key=repr) == plain(few, 4, 256, 4)
    for rows in ([], [(1, None, 1, "x")]):
        assert codes.vector_codes(spark.createDataFrame(rows, INPUT)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "x")], INPUT))
    with pytest.raises(Exception, match="64 bits"):
        codes.vector_codes(spark.createDataFrame([(1, [1e30, 2.0, 3.0, 4.0], 1, "x")], INPUT)).collect()


def test_products_of_many_limbs_are_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 7, None):
        a, b = rng.integers(-(1 << 26), 1 << 26, (40, 16)), rng.integers(-(1 << 26), 1 << 26, (30, 16))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert codes.exact_products(a, b, bits).tolist() == want
    x = rng.integers(-(1 << 40), 1 << 40, 100)
    assert (sum(part.astype(np.int64) << (5 * t) for t, part in enumerate(codes.limbs(x, 5))) == x).all()
