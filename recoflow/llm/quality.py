"""Operator 4: a quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  They overlap, so
expectation-maximisation over the counts of their vote patterns estimates how each
votes on good and on bad documents, without any given label; the posterior of its
pattern labels a document.  A linear scorer learns these labels on a bounded sample and
then scores every document, also those on which most labellers are silent.  Its hashed
features are the words and word pairs of the text, the shapes of its words, and the
statistics in steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import small_batches, written
from recoflow.llm.pieces import blocks
from recoflow.llm.shingles import GOLDEN, Words, mix, word_shingles, words_of

#: Columns of ``profiles``.
STATISTICS = ("words", "repeated trigrams", "symbol words", "shouted words", "repeated neighbours", "word bytes", "letters", "ended words", "short words", "separators")
#: Hashed features: of statistics and shapes, and after them of words and word pairs.
HASHED, NGRAMS = 1 << 12, 1 << 16
#: Documents that the scorer is fitted on at most: those of the least hashes.
SAMPLE = 20_000

_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _HIGH = (1 << k for k in range(6))


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    kinds[[ord(c) for c in ".,;:!?'\"()-"]] = _STOP
    kinds[128:] = _HIGH
    return kinds


_KINDS = _byte_kinds()


def profiles(texts: list[str], words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(statistics of each text, counts of its word shapes); a word's shape is the set
    of kinds of bytes in it."""
    words = words or words_of(texts)
    n = np.diff(words.bounds)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(texts)), n)
    count = lambda x: np.bincount(owner, x, len(texts))
    if not len(owner):
        return np.zeros((len(texts), len(STATISTICS))), np.zeros((len(texts), 64))
    chars = words.data[words.solid]
    kinds = _KINDS[chars]
    shape = np.bitwise_or.reduceat(kinds, words.begin)
    last = chars[words.begin + words.lengths - 1]
    lead = (chars < 128) | (chars >= 192)  # first bytes of characters
    lettered = np.add.reduceat((lead & ((kinds & (_LOWER | _UPPER | _HIGH)) > 0)).astype(np.int64), words.begin)
    characters = np.add.reduceat(lead.astype(np.int64), words.begin)
    again = np.zeros(len(owner), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.fromiter((len(s) for s in word_shingles(words, 3)), np.int64, len(texts))
    bangs = np.add.reduceat((chars == ord("!")).astype(np.int64), words.begin) > 1
    shouted = ((shape & (_LOWER | _UPPER | _HIGH)) == _UPPER) & (characters > 1) | bangs
    columns = [
        n,
        np.where(n > 2, 1 - distinct / np.maximum(n - 2, 1), 0),
        count((shape & _SYMBOL) > 0) / some,
        count(shouted) / some,
        count(again) / some,
        count(characters) / some,
        count(lettered) / np.maximum(count(characters), 1),
        count((last == ord(".")) | (last == ord(","))) / some,
        count(characters <= 3) / some,
        count((shape & (_LOWER | _UPPER | _DIGIT | _HIGH)) == 0) / some,
    ]
    shapes = np.bincount(owner * 64 + shape, minlength=64 * len(texts)).reshape(-1, 64)
    return np.stack(columns, 1).astype(np.float64), shapes


def votes(s: np.ndarray) -> np.ndarray:
    """Votes of the labellers (columns): 2 good, 1 bad, 0 none."""
    n, trigrams, symbols, shouted, neighbours, length, letters, ended, short, separators = s.T

    def labeller(good: np.ndarray, bad: np.ndarray, least: int) -> np.ndarray:
        return np.where(n < least, 0, np.where(bad, 1, np.where(good, 2, 0)))

    inside = lambda x, a, b: (x >= a) & (x <= b)
    return np.stack(
        [
            labeller(trigrams < 0.1, trigrams > 0.4, 10),
            labeller(neighbours < 0.06, neighbours > 0.15, 8),
            labeller(shouted < 0.05, shouted > 0.3, 5),
            labeller(separators < 0.03, separators > 0.15, 10),
            labeller(symbols < 0.03, symbols > 0.25, 5),
            labeller(letters > 0.85, letters < 0.7, 20),
            labeller(inside(length, 3.5, 8), ~inside(length, 2.5, 11), 20),
            labeller(inside(ended, 0.06, 0.4), ~inside(ended, 0.02, 0.7), 60),
            labeller(inside(short, 0.15, 0.55), ~inside(short, 0.06, 0.75), 60),
        ],
        1,
    ).astype(np.int64)


LABELLERS = 9
#: The kind of fault that each labeller looks for: repetition, shouting, lists of
#: fragments, strewn symbols, text unlike prose.
FAULTS = np.array([1, 1, 2, 3, 4, 4, 5, 5, 5])
_POWERS = 3 ** np.arange(LABELLERS)


def features(s: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Hashed feature numbers of each document: its statistics in steps, and the share
    of each frequent word shape in steps.  Number 0 stands for no feature."""
    steps = np.concatenate([np.floor(np.log2(s[:, :1] + 1)), np.floor(s[:, 1:5] * 16), np.floor(s[:, 5:6] * 2), np.floor(s[:, 6:] * 16)], 1)
    share = shapes / np.maximum(shapes.sum(1, keepdims=True), 1)
    levels = np.where(shapes > 0, np.floor(np.log2(np.maximum(share, 2.0**-6))) + 7, 0)
    every = np.concatenate([steps + 1, levels], 1).astype(np.uint64)
    group = np.arange(every.shape[1], dtype=np.uint64) << np.uint64(32)
    hashed = mix((every + group) * GOLDEN) % np.uint64(HASHED - 1) + np.uint64(1)
    return np.where(every > 0, hashed, 0).astype(np.int32)


def ngrams(words: Words) -> list[np.ndarray]:
    """Hashed feature numbers of the distinct words and word pairs of each text."""
    ones = mix(words.hashes ^ GOLDEN)
    out = []
    for a, b, pairs in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), word_shingles(words, 2), strict=True):
        every = np.concatenate([ones[a:b], pairs if b - a > 1 else pairs[:0]])
        out.append(np.unique(every % np.uint64(NGRAMS)).astype(np.int32) + HASHED)
    return out


@dataclass
class Described:
    """Hashed features of some documents."""

    steps: np.ndarray  #: of the statistics and shapes, a row a document; 0: none
    flat: np.ndarray  #: of the words and pairs of all documents
    sizes: np.ndarray  #: how many of these each document has

    @classmethod
    def of(cls, texts: list[str]) -> Described:
        words = words_of(texts)
        grams = ngrams(words)
        return cls(features(*profiles(texts, words)), np.concatenate([np.zeros(0, np.int32), *grams]), np.fromiter(map(len, grams), np.int64, len(grams)))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Weights of a document's steps, and of its words and pairs over the root of their
        number, so that long texts speak no louder than short ones; weight 0 is the bias."""
        steps = np.where(self.steps > 0, weights[self.steps], 0).sum(1)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        grams = np.bincount(owner, weights[self.flat], len(self.sizes)) / np.sqrt(np.maximum(self.sizes, 1))
        return weights[0] + steps + grams

    def slopes(self, slope: np.ndarray) -> np.ndarray:
        """Gradient of the weights from that of the logits."""
        steps = np.bincount(self.steps.ravel(), np.repeat(slope, self.steps.shape[1]), HASHED + NGRAMS)
        grams = np.bincount(self.flat, np.repeat(slope / np.sqrt(np.maximum(self.sizes, 1)), self.sizes), HASHED + NGRAMS)
        steps[0] = slope.sum()
        return steps + grams


def probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def estimate_accuracies(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation on vote patterns.

    The hidden classes are good documents (0) and one class for each kind of fault, as
    labellers of one fault agree and those of others are silent or mistaken about it.
    Returns (posterior of good of each pattern, probability of each vote [labeller,
    class, vote], share of each class).  A labeller that is silent says nothing.
    Begins at the fault of the first bad vote; one vote of each kind a class is added,
    so no estimate is 0 or 1.
    """
    v = codes[:, None] // _POWERS % 3
    classes = int(FAULTS.max()) + 1
    first = np.where((v == 1).any(1), FAULTS[(v == 1).argmax(1)], 0)
    posterior = np.full((len(codes), classes), 0.02)
    posterior[np.arange(len(codes)), first] = 0.9
    posterior /= posterior.sum(1, keepdims=True)
    table, prior = np.zeros((LABELLERS, classes, 3)), np.full(classes, 1 / classes)
    for _ in range(rounds):
        weights = posterior * counts[:, None]
        prior = (weights.sum(0) + 1) / (counts.sum() + classes)
        for k in range(LABELLERS):
            for c in range(classes):
                table[k, c] = np.bincount(v[:, k], weights[:, c], 3) + 1
        table[:, :, 0] = 0
        table /= table.sum(2, keepdims=True)
        table[:, :, 0] = 1  # silence
        log = np.log(prior) + sum(np.log(table[k][:, v[:, k]]).T for k in range(LABELLERS))
        new = np.exp(log - log.max(1, keepdims=True, initial=-np.inf))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior[:, 0], table, prior


def fit(batches: list[Described], labels: list[np.ndarray], steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, by Adam over the batches in turn."""
    w, m, v = (np.zeros(HASHED + NGRAMS) for _ in range(3))
    for t in range(1, steps + 1 if batches else 1):
        some, wanted = batches[t % len(batches)], labels[t % len(batches)]
        g = some.slopes((probability(some.logits(w)) - wanted) / max(1, len(wanted))) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    weights: np.ndarray  #: of the hashed features
    posterior: dict[int, float]  #: of good, for each vote pattern
    accuracy: np.ndarray  #: probability of votes [labeller, class, vote]
    prior: np.ndarray  #: share of each class

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability that documents of these texts are good."""
        return probability(Described.of(texts).logits(self.weights))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text"))


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, row, votes (pattern code) of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            codes = [votes(profiles(rows[a:b])[0]) @ _POWERS for a, b in blocks(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *codes]))], ["doc_id", "row", "votes"])

    return keyed(docs).mapInArrow(run, "doc_id long, row long, votes long")


def _sampled(docs: DataFrame, facts: DataFrame, n: float, sample: int) -> DataFrame:
    """votes, steps, grams (words and pairs, as compressed differences) of the ``sample``
    documents of the least hashes, in one partition.  The last of these hashes is found among
    the ``voted`` rows first, under a bound that 1.5 times as many of the n documents stay
    under, so features are made and sent of no further documents (but repeats of the last)."""
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", "row")
    bound = int(-(2**63) + min(1.0, 1.5 * sample / max(1.0, n)) * (2**64 - 1025))
    last = facts.select(order.alias("place")).where(F.col("place") <= F.lit(bound)).orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    near = keyed(docs).where(order <= F.lit(-(2**63) if last is None else last)).select(order.alias("place"), "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            codes, steps, grams = [np.zeros(0, np.int64)], [], []
            for a, b in blocks(rows):
                words = words_of(rows[a:b])
                s, shapes = profiles(rows[a:b], words)
                codes.append(votes(s) @ _POWERS)
                steps += [x.astype("<i4").tobytes() for x in features(s, shapes)]
                grams += [zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1) for x in ngrams(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(codes)), pa.array(steps, pa.binary()), pa.array(grams, pa.binary())], ["place", "row", "votes", "steps", "grams"])

    found = near.mapInArrow(run, "place long, row long, votes long, steps binary, grams binary")
    return found.orderBy("place", "row").limit(sample).select("votes", "steps", "grams").coalesce(1)


def _fit_task(of: dict[int, float], batch: int):
    """Fits the scorer to the rows of ``_sampled``, with the labels that ``of`` has for votes."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, labels, held = [], [], []
        for rows in arrived:
            held += zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True)
            while len(held) >= batch:
                batches.append(_unpacked(held[:batch]))
                labels.append(np.array([of[r[0]] for r in held[:batch]]))
                held = held[batch:]
        if held:
            batches.append(_unpacked(held))
            labels.append(np.array([of[r[0]] for r in held]))
        yield pa.RecordBatch.from_arrays([pa.array([fit(batches, labels).astype("<f8").tobytes()], pa.binary())], ["weights"])

    return run


def _unpacked(rows: list[tuple[int, bytes, bytes]]) -> Described:
    grams = [np.cumsum(np.frombuffer(zlib.decompress(g), "<i4"), dtype=np.int32) for _, _, g in rows]
    return Described(np.stack([np.frombuffer(s, "<i4") for _, s, _ in rows]), np.concatenate(grams), np.fromiter(map(len, grams), np.int64, len(grams)))


def train(docs: DataFrame, facts: DataFrame, sample: int = SAMPLE, batch: int = 2000) -> QualityModel:
    """Model from documents and their ``voted`` patterns: patterns of all of them (at most
    3 ** LABELLERS rows reach the driver), features of ``sample`` of them.  The scorer is
    fitted in a task, and only its weights reach the driver."""
    patterns = facts.groupBy("votes").count().orderBy("votes").collect()
    codes, counts = np.array([r.votes for r in patterns], np.int64), np.array([r["count"] for r in patterns], np.float64)
    posterior, table, prior = estimate_accuracies(codes, counts)
    of = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    fitted = _sampled(docs, facts, counts.sum(), sample).mapInArrow(_fit_task(of, batch), "weights binary").collect()
    weights = np.frombuffer(fitted[0].weights, "<f8") if fitted else fit([], [])
    return QualityModel(weights, of, table, prior)


def classify(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, weak_label (posterior of good), score, keep (score >=
    least).  Null text is empty: no labeller votes and only the bias and the length
    speak.  Rows map one to one: repeated rows and null doc_ids stay; further columns
    are dropped; an empty table stays empty.  Texts are read three times, to vote, to train and to
    score; memory grows with the longest text only.
    """
    model = train(docs, written(voted(docs)), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            weak, score = [np.zeros(0)], [np.zeros(0)]
            for a, b in blocks(rows):
                words = words_of(rows[a:b])
                s, shapes = profiles(rows[a:b], words)
                grams = ngrams(words)
                some = Described(features(s, shapes), np.concatenate([np.zeros(0, np.int32), *grams]), np.fromiter(map(len, grams), np.int64, len(grams)))
                weak.append(np.array([model.posterior[v] for v in (votes(s) @ _POWERS).tolist()]))
                score.append(probability(some.logits(model.weights)))
            found = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(weak)), pa.array(found), pa.array(found >= least)], ["doc_id", "weak_label", "score", "keep"])

    return keyed(docs).mapInArrow(run, "doc_id long, weak_label double, score double, keep boolean")


def keep_good(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.  Texts
    are read three times, to vote, to train and to score, rather than shuffled for a join."""
    model = train(docs, written(voted(docs)), sample)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        rows = texts.tolist()
        return pd.Series(np.concatenate([np.zeros(0), *(model.score(rows[a:b]) for a, b in blocks(rows))]) >= least)

    return docs.where(good(F.coalesce("text", F.lit(""))))
