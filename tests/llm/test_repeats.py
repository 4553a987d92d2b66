"""Removal of repeated byte strings (operator 12) against brute force."""

import random

import numpy as np
import pytest

from recoflow.llm import repeats

INPUT = "doc_id long, text string, begin string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], INPUT)


def plain(rows, length, tie):
    """tie: of (doc_id, text), as the operator orders rows of one doc_id."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, tie[rows[i]]))
    seen, out = set(), []
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((rows[i][0], len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages, rows = [text(60) for _ in range(4)], []
    for i in range(n):
        parts = [text(rng.randint(0, 80)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(40) :])
        rows.append((i, " ".join(parts)))
    near = list(text(120))
    for i in range(12):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "#"
        rows.append((200 + i, "".join(copy)))
    rows += [(300, "a" * 900), (301, "ab" * 300), (302, "abc" * 200 + text(9)), (303, text(2)), (304, None), (305, ""), (None, text(90)), (None, rows[3][1]), (3, rows[5][1]), (7, text(50)), (7, text(50))]
    return rows + [rows[2], rows[2], (400, rows[2][1])]


def results(spark, rows, **options):
    df = frame(spark, rows)
    ties = {(r["id"] if r["known"] else None, r["text"]): r["tie"] for r in repeats.identified(df).collect()}
    ties |= {(d, None): ties[(d, "")] for d, t in rows if t is None}
    got = repeats.without_repeats(df, **options)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=repr), ties


@pytest.mark.parametrize("options", [{}, {"heavy": 3, "share": 1}, {"bucket_bytes": 4000, "index_bytes": 500}])
def test_against_brute_force(spark, options):
    rows = corpus(1)
    got, ties = results(spark, rows, **options)
    assert got == plain(rows, 100, ties)
    assert sum(r[2] for r in got) > 5000


def test_other_lengths_and_empty_tables(spark):
    rows = corpus(2, 20)
    got, ties = results(spark, rows, length=40, gram=12)
    assert got == plain(rows, 40, ties)
    assert repeats.kept_digest(repeats.without_repeats(frame(spark, []))).collect() == []
    few, _ = results(spark, [(1, "short"), (2, None)])
    assert few == [(1, 5, 0, 0, b"short"), (2, 0, 0, 0, b"")]


def test_a_text_of_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd ") for _ in range(70_000))
    rows = [(1, text), (2, "x" + text[20_000:50_000] + text[100:5000])]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 8000)
    by_block = [s for a, b in repeats._cut_blocks(np.frombuffer(text.encode(), np.uint8), 100) for s in range(a, a + len(b) - 99)]
    assert by_block == list(range(len(text) - 99))
    got, ties = results(spark, rows)
    assert got == plain(rows, 100, ties)


def test_index_is_the_transform_and_its_statistics():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 30))) for _ in range(40)] + [b"abab" * 9, b"abab" * 9]
    index = repeats.RunIndex(strings)
    whole = [(s, k) for s in range(len(strings)) for k in range(len(strings[s]))]
    suffix = [strings[s][k:] for s, k in whole]
    assert index.order.tolist() == sorted(range(len(whole)), key=lambda i: (suffix[i], i))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: E731, B905
    stats = index.matching()
    for before, row in zip(index.order[:-1].tolist(), index.order[1:].tolist(), strict=True):
        assert stats[row] == common(suffix[before], suffix[row])
    assert len(index.starts) < len(whole)
    for length in (3, 8):
        seen, want = set(), []
        for (s, k), x in zip(whole, suffix, strict=True):
            want.append(len(x) >= length and x[:length] in seen)
            seen.add(x[:length])
        assert index.repeated(length).tolist() == want


def test_suffixes_that_are_apart_are_sorted_once(monkeypatch):
    rng = np.random.default_rng(5)
    same = rng.integers(0, 256, 150, np.uint8).tobytes()
    strings = [rng.integers(0, 256, 150, np.uint8).tobytes() for _ in range(200)] + [same] * 3
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sizes.append(len(x)) or argsort(x, *a, **b))
    order = repeats.RunIndex(strings).order
    data, total = b"".join(strings), 150 * len(strings)
    assert order.tolist() == sorted(range(total), key=lambda i: (data[i : i - i % 150 + 150], i))
    assert sizes[0] == total and max(sizes[1:]) < 4000  # the equal strings and the tails of others
