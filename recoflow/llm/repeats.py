"""Operator 12: removal of long repeated byte strings by a run-length index.

A string of ``length`` bytes goes wherever it also starts earlier.  Equal strings must
meet in one task without moving every string of the corpus:

1. The anchor of a string is the least hash of its grams of GRAM bytes, so equal strings
   have equal anchors.  Strings that follow each other and share an anchor form a segment
   (about one for 37 bytes; at most as many strings as grams fit a string).  Segments go
   to buckets by anchor, as packed hashes and places; no text is shuffled for this.
2. Segments of equal anchor and content form a class.  Whatever occurs in the class but is
   not its first occurrence goes whole.  Its first occurrence can hold more repeats only if
   its anchor has other classes too, or if it repeats itself; most of a corpus ends here.
3. The bytes of these segments are cut out and dealt to buckets by anchor.  Each bucket's
   segments, in order of their places, get a run-length index (``RunIndex``): a suffix order,
   the Burrows-Wheeler transform as runs, and common prefixes sampled at the ends of runs.
   Within a run they follow from the sample before (one less a byte), which streams the
   matching statistics of all places.  Places whose statistics reach ``length`` fall
   into groups of equal strings; all but the first of a group are marked.
   The strings of an anchor with too many classes for one index are compared by two 64-bit
   hashes, a part of them at a time.
4. Anchors that very many segments have would overfill a bucket.  They are told by counts
   over a share of the documents (which decides the way, never the result); their classes
   are grouped in the shuffle, which combines equal ones early, and their strings are
   compared by two 64-bit hashes there.

Marks are gathered by document and joined with the texts, which are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflow.llm.common import small_batches
from recoflow.llm.shingles import mix

LENGTH, GRAM = 100, 32
#: Bytes of text whose hashes are held at once, of text in a bucket, and in an index.
BLOCK_BYTES, BUCKET_BYTES, INDEX_BYTES = 1 << 20, 1 << 25, 1 << 21
#: An anchor is heavy if one in SHARE of the documents holds more than a SHARE-th of HEAVY
#: segments with it, and more than that part of all segments which leaves MOST_HEAVY anchors.
HEAVY, SHARE, MOST_HEAVY = 200_000, 64, 100_000
#: Odd multipliers of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Rolling:
    """Polynomial hashes modulo 2^64 of all substrings of a block."""

    def __init__(self, block: np.ndarray, factor: int):
        power = np.full(len(block) + 1, factor, np.uint64)
        power[0] = 1
        inverse = np.full(len(block) + 1, pow(factor, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)])])

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    padded = np.concatenate([x, np.full(-len(x) % width, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(block: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """begin, n, anchor, content, again of the segments of a block of texts, which end at
    ``ends``: the strings that begin in [begin, begin + n) share an anchor; ``again`` tells
    that the anchor occurs more than once in the segment, without which no string can be
    repeated within it."""
    width = length - gram + 1
    one, two = Rolling(block, FACTORS[0]), Rolling(block, FACTORS[1])
    grams = one.of(slice(0, len(block) - gram + 1), slice(gram, None))
    least = least_of(grams, width)
    whole = np.arange(len(least)) + length <= np.repeat(ends, np.diff(np.r_[0, ends]))[: len(least)]
    change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    runs = np.diff(np.r_[change, len(least)])
    change, runs = change[whole[change]], runs[whole[change]]
    # a run of one anchor that recurs can be of any length: cut it at every ``width``
    pieces = -(-runs // width)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(change, pieces) + place * width
    n = np.minimum(np.repeat(change + runs, pieces) - begin, width)
    anchor = least[begin]
    content = two.of(begin, begin + n + length - 1) ^ mix(n.astype(np.uint64))
    again = np.zeros(len(begin), bool)
    span = np.arange(2 * width - 1)
    for a in range(0, len(begin), 4096):
        b = slice(a, a + 4096)
        inside = span < (n[b] + width - 1)[:, None]
        at = np.minimum(begin[b][:, None] + span, len(grams) - 1)
        again[b] = ((grams[at] == anchor[b][:, None]) & inside).sum(1) > 1
    return begin, n, anchor, content, again


def _cut_blocks(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that together hold every string of ``length`` once."""
    for a in range(0, max(0, len(data) - length + 1), BLOCK_BYTES):
        yield a, data[a : a + BLOCK_BYTES + length - 1]


ID = ["known", "id", "tie"]
SEGMENTS = "known boolean, id long, tie long, begin long, n int, anchor long, content long, again boolean"


def _bytes_of(text: pa.Scalar) -> np.ndarray:
    buffer = text.as_buffer()
    return np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def _segments_of(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, begin, n, anchor, content, again of the segments of a batch of texts, some texts
    or a part of a long one at a time."""
    held, size = [], 0
    for i, text in enumerate(batch.column("text")):
        for a, block in _cut_blocks(_bytes_of(text), length):
            if held and size + len(block) > BLOCK_BYTES:
                yield _block_segments(held, length, gram)
                held, size = [], 0
            held.append((i, a, block))
            size += len(block)
    if held:
        yield _block_segments(held, length, gram)


def _block_segments(held: list[tuple[int, int, np.ndarray]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    rows, offsets, blocks = zip(*held, strict=True)
    ends = np.cumsum([len(b) for b in blocks])
    begin, n, anchor, content, again = segments(np.concatenate(blocks), ends, length, gram)
    part = np.searchsorted(ends, begin, "right")
    return np.array(rows)[part], begin - np.r_[0, ends][part] + np.array(offsets)[part], n.astype(np.int32), anchor.view(np.int64), content.view(np.int64), again


def _find_segments(length: int, gram: int, only: np.ndarray | None = None):
    """The segments, or those of some anchors, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *rest in _segments_of(batch, length, gram):
                keep = np.ones(len(row), bool) if only is None else np.isin(rest[2], only)
                own = [batch.column(c).take(pa.array(row[keep])) for c in ID]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x[keep]) for x in rest)], [*ID, "begin", "n", "anchor", "content", "again"])

    return run


PACK = np.dtype([("anchor", "<i8"), ("content", "<i8"), ("begin", "<i8"), ("doc", "<u4"), ("n", "<i2"), ("again", "?")])


def _pack_segments(length: int, gram: int, buckets: int, heavy: np.ndarray):
    """The segments without heavy anchors, packed: of each bucket and some texts one row
    with the columns of PACK one after the other, and the texts they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([batch.column("known").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("id").to_numpy(), batch.column("tie").to_numpy()], 1)
            for row, begin, n, anchor, content, again in _segments_of(batch, length, gram):
                bucket = (mix(anchor.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((row, bucket))
                order = order[~np.isin(anchor[order], heavy)] if len(heavy) else order
                used, ends = np.unique(bucket[order], return_index=True)
                packed, texts = [], []
                for a, b in zip(ends, np.r_[ends[1:], len(order)], strict=True):
                    o = order[a:b]
                    docs, doc = np.unique(row[o], return_inverse=True)
                    fields = {"anchor": anchor[o], "content": content[o], "begin": begin[o], "doc": doc, "n": n[o], "again": again[o]}
                    packed.append(b"".join(np.ascontiguousarray(fields[c], PACK[c]).tobytes() for c in PACK.names))
                    texts.append(ids[docs].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "packed", "texts"])

    return run


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a bucket, and the texts that their doc points to."""
    parts, texts, before = [], [], 0
    for packed, ids in zip(t.column("packed").to_pylist(), t.column("texts").to_pylist(), strict=True):
        n, at = len(packed) // PACK.itemsize, 0
        part = np.empty(n, PACK)
        for c in PACK.names:
            part[c] = np.frombuffer(packed, PACK[c], n, at)
            at += n * PACK[c].itemsize
        part["doc"] += before
        texts.append(np.frombuffer(ids, np.int64).reshape(-1, 3))
        before += len(texts[-1])
        parts.append(part)
    return np.concatenate(parts), np.concatenate(texts)


JUDGED = "known boolean, id long, tie long, begin long, n int, anchor long, wanted boolean"


def _judge(t: pa.Table) -> pa.Table:
    """Of a bucket's segments those that an equal one comes before (not wanted), and the
    first ones of classes that may hold more repeats (wanted)."""
    s, texts = _unpacked(t)
    places, doc = np.unique(texts, axis=0, return_inverse=True)  # in the order of documents
    doc = doc.ravel()[s["doc"]]
    by_place = np.argsort(doc << 40 | s["begin"]) if len(places) < 1 << 23 and s["begin"].max() < 1 << 40 else np.lexsort((s["begin"], doc))
    order = by_place[np.lexsort((s["content"][by_place], s["anchor"][by_place]))]
    s, doc = s[order], doc[order]
    other_anchor = np.r_[True, s["anchor"][1:] != s["anchor"][:-1]]
    first = other_anchor | np.r_[True, s["content"][1:] != s["content"][:-1]]
    opens = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    copy = (doc != doc[opens]) | (s["begin"] != s["begin"][opens])  # a row that is there twice is no copy of itself
    group = np.cumsum(other_anchor) - 1
    kinds = np.bincount(group, weights=first)[group]
    wanted = first & ((kinds > 1) | s["again"])
    keep = copy | wanted
    known, number, tie = places[doc[keep]].T
    columns = [known.astype(bool), number, tie, s["begin"][keep], s["n"][keep].astype(np.int32), s["anchor"][keep], wanted[keep]]
    return pa.table([pa.array(c) for c in columns], [*ID, "begin", "n", "anchor", "wanted"])


class RunIndex:
    """Run-length Burrows-Wheeler index of some byte strings, which matches don't cross.

    order: the places of all suffixes in lexicographic order, a suffix ending with its
    string, equal ones by place.  starts: the rows where a run of equal preceding bytes
    begins; a string's first place has no preceding byte and is a run of its own.  samples:
    the common prefix of a run's first suffix with the suffix before it.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.order = self._suffixes()
        first = np.zeros(len(self.text), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        before = np.where(first, -1, np.r_[np.int16(0), self.text[:-1]])[self.order]
        self.starts = np.flatnonzero((before == -1) | np.r_[True, before[1:] != before[:-1]])
        self.samples = self._common(self.starts)

    def _suffixes(self) -> np.ndarray:
        m = len(self.text)
        place, key, step = np.arange(m), np.zeros(m, np.int64), 7
        left, byte = self.ends - place, self.text.astype(np.int64) + 1
        for k in range(min(step, m)):  # bytes as 1 to 256, and 0 beyond the string, in 9 bits each
            key[: m - k] |= np.where(left[: m - k] > k, byte[k:], 0) << 9 * (step - 1 - k)
        order = np.argsort(key)
        alive, k, rank, equal = place, key[order], np.empty(m, np.int64), []
        while True:  # alive: the rows whose suffixes share ``step`` bytes with a neighbour
            first = np.r_[True, k[1:] != k[:-1]]
            rank[order[alive]] = alive[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            alive = alive[~(first & np.r_[first[1:], True])]
            p = order[alive]
            over = left[p] < step  # all of such a group are equal
            equal.append(alive[over])
            alive, p = alive[~over], p[~over]
            if not len(alive):
                break
            k = rank[p] * (m + 1) + np.where(left[p] > step, rank[np.minimum(p + step, m - 1)] + 1, 0)
            o = np.argsort(k)
            order[alive], k = p[o], k[o]
            step *= 2
        rows = np.sort(np.concatenate(equal))
        p = order[rows]
        order[rows] = p[np.argsort(rank[p] * m + p)]  # equal suffixes by place
        return order

    def _common(self, rows: np.ndarray) -> np.ndarray:
        """Common prefix of the suffix of each row with the one before it."""
        out = np.zeros(len(rows), np.int64)
        alive = np.flatnonzero(rows > 0)
        a, b = self.order[rows[alive] - 1], self.order[rows[alive]]
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        k = 0
        while len(alive):
            going = k < most
            going[going] = self.text[a[going] + k] == self.text[b[going] + k]
            out[alive[~going]] = k
            alive, a, b, most = alive[going], a[going], b[going], most[going]
            k += 1
        return out

    def matching(self) -> np.ndarray:
        """Common prefix of every place's suffix with the one before it in order.  In a run,
        the suffixes one byte earlier are neighbours too and share one byte more, so between
        two sampled places of the text the statistics fall by one a byte."""
        sampled = np.full(len(self.text), -1, np.int64)
        sampled[self.order[self.starts]] = self.samples
        place = np.arange(len(self.text))
        last = np.maximum.accumulate(np.where(sampled >= 0, place, 0))
        return sampled[last] - (place - last)

    def repeated(self, length: int) -> np.ndarray:
        """Whether the string of ``length`` bytes at a place also begins at an earlier one."""
        groups = np.flatnonzero(self.matching()[self.order] < length)
        least = np.repeat(np.minimum.reduceat(self.order, groups), np.diff(np.r_[groups, len(self.order)]))
        out = np.zeros(len(self.text), bool)
        out[self.order] = self.order != least
        return out


MARKS = "known boolean, id long, tie long, begin long, n int"


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _mark_bucket(length: int, index_bytes: int):
    """Marks the repeated strings of a bucket's segments, whole anchors at a time."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("anchor", *ID, "begin")])
        keys = [t.column(c).to_numpy() for c in ("anchor", *ID, "begin")]
        same = np.all([k[1:] == k[:-1] for k in keys], 0)  # rows equal in doc_id and text are there once
        t = t.filter(pa.array(np.r_[True, ~same]))
        sizes = pc.binary_length(t.column("bytes")).to_numpy()
        anchor = t.column("anchor").to_numpy()
        edges = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(t)]
        total, out, a = np.r_[0, np.cumsum(sizes)], [], 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(total[edges], total[edges[a]] + index_bytes, "right")) - 1)
            out.append(_mark(t.slice(edges[a], edges[b] - edges[a]), length, index_bytes))
            a = b
        return pa.concat_tables(out)

    return run


def _repeated_by_hash(strings: list[bytes], length: int, parts: int) -> np.ndarray:
    """As ``RunIndex.repeated``, by hashes of the strings, a part of the hashes at a time."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    before, out = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), bool)
    for part in range(parts):
        found = []
        for s in range(0, len(strings), 5000):
            block = np.frombuffer(b"".join(strings[s : s + 5000]), np.uint8)
            ends = np.repeat(np.cumsum(sizes[s : s + 5000]), sizes[s : s + 5000])
            begin = np.flatnonzero(np.arange(len(block)) + length <= ends)
            one = Rolling(block, FACTORS[0]).of(begin, begin + length)
            mine = one % np.uint64(parts) == part
            found.append((before[s] + begin[mine], Rolling(block, FACTORS[1]).of(begin[mine], begin[mine] + length), one[mine]))
        place, two, one = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((two, one))  # stable, so places ascend within equal strings
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        out[place[order[1:][same]]] = True
    return out


def _mark(t: pa.Table, length: int, index_bytes: int) -> pa.Table:
    t = t.sort_by([(c, "ascending") for c in (*ID, "begin")])
    strings = t.column("bytes").to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    parts = -(-int(sizes.sum()) // (4 * index_bytes))
    again = RunIndex(strings).repeated(length) if parts == 1 else _repeated_by_hash(strings, length, parts)
    starts, ends = runs_of(again)  # none reaches the last bytes of its segment
    row = np.searchsorted(np.cumsum(sizes), starts, "right")
    begin = t.column("begin").to_numpy()[row] + starts - (np.cumsum(sizes) - sizes)[row]
    own = [t.column(c).take(pa.array(row)) for c in ID]
    return pa.table([*own, pa.array(begin), pa.array((ends - starts).astype(np.int32))], [*ID, "begin", "n"])


PIECES = "known boolean, id long, tie long, begin long, anchor long, bytes binary"


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets of a column of lists of structs, and the named fields of all of them."""
    values = column.flatten()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.r_[0, np.cumsum(sizes)], *(values.field(c).to_numpy(zero_copy_only=False) for c in names)


def _cut_out(length: int):
    """The bytes of wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, begin, n, anchor = _lists(batch.column("wanted"), "begin", "n", "anchor")
            rows, cuts, size = [], [], 0
            for i, text in enumerate(batch.column("text")):
                data = memoryview(text.as_buffer())
                for w in range(offsets[i], offsets[i + 1]):
                    cuts.append(bytes(data[begin[w] : begin[w] + n[w] + length - 1]))
                    rows.append((i, w))
                    size += len(cuts[-1])
                    if size > 4 * BLOCK_BYTES:
                        yield _pieces(batch, rows, cuts, begin, anchor)
                        rows, cuts, size = [], [], 0
            if rows:
                yield _pieces(batch, rows, cuts, begin, anchor)

    return run


def _pieces(batch: pa.RecordBatch, rows: list[tuple[int, int]], cuts: list[bytes], *fields: np.ndarray) -> pa.RecordBatch:
    row, w = np.array(rows).T
    own = [batch.column(c).take(pa.array(row)) for c in ID]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(x[w]) for x in fields), pa.array(cuts, pa.binary())], [*ID, "begin", "anchor", "bytes"])


STRINGS = "known boolean, id long, tie long, begin long, one long, two long"


def _hash_strings(length: int):
    """The hashes of every string of some segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, cut in enumerate(batch.column("bytes")):
                block = _bytes_of(cut)
                n = len(block) - length + 1
                one, two = (Rolling(block, f).of(slice(0, n), slice(length, None)).view(np.int64) for f in FACTORS)
                found.append((np.full(n, i), batch.column("begin")[i].as_py() + np.arange(n), one, two))
            if found:
                row, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
                own = [batch.column(c).take(pa.array(row)) for c in ID]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, rest)], [*ID, "begin", "one", "two"])

    return run


def identified(docs: DataFrame) -> DataFrame:
    """known, id, tie, text: doc_id as whether it is known and its value, which order like
    it with null first; a hash of the text tells rows of one doc_id apart, and orders them."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def heavy_anchors(rows: DataFrame, length: int, gram: int, heavy: int, share: int = SHARE) -> np.ndarray:
    """Anchors of very many segments, at most about MOST_HEAVY, by counts over one in
    ``share`` of the documents."""
    some = rows.where(F.pmod(F.xxhash64(*ID, F.lit("share")), F.lit(share)) == 0).mapInArrow(_find_segments(length, gram), SEGMENTS)
    counts = some.groupBy("anchor").agg(F.count("*").alias("n"))
    many = counts.where(F.col("n") > heavy / share)
    if not many.limit(1).count():
        return np.zeros(0, np.int64)
    total = some.count()
    return np.array([r[0] for r in many.where(F.col("n") * MOST_HEAVY > total).select("anchor").collect()], np.int64)


def _judge_heavy(rows: DataFrame, length: int, gram: int, heavy: np.ndarray) -> DataFrame:
    """As ``_judge``, of the segments of heavy anchors: all their classes are searched."""
    found = rows.where(F.octet_length("text") >= length).mapInArrow(_find_segments(length, gram, heavy), SEGMENTS)
    place = F.struct(*ID, "begin")
    classes = found.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.count("*").alias("times"))
    copies = found.join(classes.where("times > 1").select("anchor", "content", "first"), ["anchor", "content"]).where(place != F.col("first"))
    columns = (*ID, "begin", "n", "anchor")
    return copies.select(*columns, F.lit(False).alias("wanted")).unionByName(classes.select("first.*", "n", "anchor", F.lit(True).alias("wanted")).select(*columns, "wanted"))


def repeated_strings(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY, share: int = SHARE, bucket_bytes: int = BUCKET_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """known, id, tie, begin, n: the strings that begin in [begin, begin + n) also begin earlier.

    rows: as ``identified`` gives them.
    """
    small_batches(rows.sparkSession)
    buckets = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    many = heavy_anchors(rows, length, gram, heavy, share)
    packed = rows.where(F.octet_length("text") >= length).mapInArrow(_pack_segments(length, gram, buckets, many), "bucket long, packed binary, texts binary")
    judged = packed.groupBy("bucket").applyInArrow(_judge, JUDGED)
    if len(many):
        judged = judged.unionByName(_judge_heavy(rows, length, gram, many))
    wanted = judged.where("wanted").groupBy(*ID).agg(F.collect_list(F.struct("begin", "n", "anchor")).alias("wanted"))
    cut = rows.join(wanted, ID).mapInArrow(_cut_out(length), PIECES)
    is_heavy = F.col("anchor").isin(many.tolist()) if len(many) else F.lit(False)
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets))
    marked = cut.where(~is_heavy).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_mark_bucket(length, index_bytes), MARKS)
    marks = judged.where("NOT wanted").select(*ID, "begin", "n").unionByName(marked)
    if len(many):
        place = F.struct(*ID, "begin")
        strings = cut.where(is_heavy).mapInArrow(_hash_strings(length), STRINGS)
        earliest = strings.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
        marks = marks.unionByName(strings.join(earliest, ["one", "two"]).where(place != F.col("first")).select(*ID, "begin", F.lit(1).alias("n")))
    return marks


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, begin, n = _lists(batch.column("marks"), "begin", "n")
            nth, doc_id = batch.column("nth").to_numpy(), pc.if_else(batch.column("known"), batch.column("id"), pa.scalar(None, pa.int64()))
            facts, kept, first, size = [], [], 0, 0
            for i, text in enumerate(batch.column("text")):
                data, own = _bytes_of(text), slice(offsets[i], offsets[i + 1])
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, begin[own], 1)
                np.add.at(edge, begin[own] + n[own] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                if nth[i] > 1 and len(data) >= length:
                    gone[:] = True
                facts.append((len(data), gone.sum(), len(runs_of(gone)[0])))
                kept.append(data[~gone].tobytes())
                size += len(kept[-1])
                if size > 4 * BLOCK_BYTES or i + 1 == len(batch):
                    columns = [pa.array(c, pa.int64()) for c in np.array(facts, np.int64).T]
                    yield pa.RecordBatch.from_arrays([doc_id[first : i + 1], *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                    facts, kept, first, size = [], [], i + 1, 0

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, binary) of every row.

    docs: doc_id, text; further columns are dropped.  A null text is empty.  Earlier means
    a smaller doc_id (null first), then a smaller hash of the text where rows share a
    doc_id, then an earlier start.  Of rows equal in doc_id and text one is the first and
    the others lose everything if they have ``length`` bytes.  Texts below ``length`` bytes
    stay whole; a text of any size is worked on in blocks.  A table without rows gives none.
    """
    rows = identified(docs)
    marks = repeated_strings(rows, length, **options).groupBy(*ID).agg(F.collect_list(F.struct("begin", "n")).alias("marks"))
    nth = F.row_number().over(Window.partitionBy(*ID).orderBy("tie"))
    return rows.withColumn("nth", nth).join(marks, ID, "left").select("known", "id", "text", "marks", "nth").mapInArrow(_remove(length), KEPT)


def kept_digest(found: DataFrame) -> DataFrame:
    """The counts and the SHA-256 of the remaining bytes."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(range(1, octet_length(b) - {LENGTH} + 2)) AS s, b FROM d),
k AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (PARTITION BY array_slice(b, s, s + {LENGTH} - 1) ORDER BY doc_id, s) > 1 AS again FROM w),
e AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS g FROM k WHERE again),
r0 AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS z FROM e GROUP BY doc_id, g),
r1 AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r0),
r2 AS (SELECT *, sum((before IS NULL OR before < a)::INT) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM r1),
spans AS MATERIALIZED (SELECT doc_id, min(a) AS a, max(z) AS z FROM r2 GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS t FROM spans
  UNION ALL SELECT d.doc_id, coalesce(m.z, 1), octet_length(b) + 1 FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM spans GROUP BY doc_id) m USING (doc_id)
),
left_over AS (SELECT doc_id, coalesce(string_agg(hex(array_slice(b, f, t - 1)), '' ORDER BY f), '') AS h FROM gaps JOIN d USING (doc_id) WHERE t > f GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
