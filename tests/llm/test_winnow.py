"""Winnowing against a direct Python version, and its guarantees."""

import hashlib

import xxhash

from recoflow.llm.winnow import POSITION_BITS, K, W, edited_fingerprints, fingerprints


def winnow(text):
    grams = [text[i : i + K] for i in range(len(text) - K + 1)] or [text]
    values = [(xxhash.xxh64(g.encode(), seed=42).intdigest() >> (64 - 63 + POSITION_BITS), -i) for i, g in enumerate(grams)]
    windows = [values[i : i + W] for i in range(max(1, len(values) - W + 1))]
    return sorted({min(w) for w in windows}, key=lambda x: -x[1])


def near(a, b):
    x, y = {h for h, _ in winnow(a)}, {h for h, _ in winnow(b)}
    return len(x & y) / len(x | y)


DOCS = [
    (0, "The quick brown fox jumps over the lazy dog. " * 3),
    (3, None),
    (1, "The quick brown fox jumps over the lazy dog. " * 3),
    (2, "é" * 40 + "😀 漢字 and some other text"),
    (7, "a"),
    (5, "short text"),
    (6, "x" * 500),
    (9, "passage of words that a second document holds as well, " + "y" * 30),
    (8, "z" * 30 + " passage of words that a second document holds as well"),
    (8, "another row of the same id"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next string")


def test_against_python(spark):
    got = {}
    for r in edited_fingerprints(frame(spark, DOCS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    tie = lambda t: (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + 2**63) % 2**64
    ordered = sorted(((d, t or "") for d, t in DOCS), key=lambda r: (r[0], tie(r[1])))
    assert sum(map(len, got.values())) == len(DOCS)
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near(text, edited), 9), round(near(text, after), 9))
        assert want in [(r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got[doc_id]]
    assert got[0][0].fingerprint == got[1][0].fingerprint != got[2][0].fingerprint


def test_chosen_positions(spark):
    for row in fingerprints(frame(spark, DOCS).fillna("", "text"), "text", "f").collect():
        mask = (1 << POSITION_BITS) - 1
        assert [(x >> POSITION_BITS, -(mask - (x & mask))) for x in row.f] == winnow(row.text)


def test_many_buckets_and_edges(spark):
    rows = [(i, f"document number {i} " * (1 + i % 5)) for i in range(60)] + [(None, "no id")]
    from recoflow.llm import winnow as module

    whole = {tuple(r) for r in edited_fingerprints(frame(spark, rows)).collect()}
    split = module.with_next
    module.with_next = lambda docs: split(docs, bucket_docs=7)
    try:
        assert {tuple(r) for r in edited_fingerprints(frame(spark, rows)).collect()} == whole
    finally:
        module.with_next = split
    assert edited_fingerprints(frame(spark, [])).count() == 0
    one = edited_fingerprints(frame(spark, [(4, "alone here")])).collect()
    assert one[0].near_next == 1.0


def test_fingerprints_tell_hashes_and_positions(spark):
    got = {(r.doc_id, r.n_chars): r.fingerprint for r in edited_fingerprints(frame(spark, DOCS)).collect()}
    for doc_id, text in DOCS:
        want = " ".join(f"{h:x}@{-p:x}" for h, p in winnow(text or ""))
        assert got[doc_id, len(text or "")] == want


def test_one_id_in_most_rows_and_a_long_text(spark):
    """Null ids are dealt to their share of buckets; the order of rows stays the same."""
    from recoflow.llm import winnow as module

    rows = [(None, f"text {i} without an id") for i in range(300)] + [(i, f"text {i}") for i in range(40)] + [(5, "long text " * 60_000)]
    whole = {tuple(r) for r in edited_fingerprints(frame(spark, rows)).collect()}
    split = module.with_next
    sizes = [r["count"] for r in split(frame(spark, rows), bucket_docs=10)[0].where("own").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 60
    module.with_next = lambda docs: split(docs, bucket_docs=10)
    try:
        assert {tuple(r) for r in edited_fingerprints(frame(spark, rows)).collect()} == whole
    finally:
        module.with_next = split
