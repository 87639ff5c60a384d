"""Quality of texts: random-indexing word vectors, pooled for each document, and a two-layer network.

Each term has an index vector of a few entries of 1 or -1, drawn from its hash. A term's context vector is the sum of the
index vectors of the terms next to it, over every occurrence in every document. Context vectors are kept for the terms
that are in ``LEAST_ROWS`` or more of the training rows (``VOCABULARY`` at most); any other term stands by its index
vector alone, so none is left out. Terms are words, runs of signs, and marks of a word's shape (its case, a digit,
whether it repeats the one before). A document is the mean of its words' vectors beside that of its signs and marks.

A network of one hidden layer is fitted on a bounded sample of the labelled rows (``SAMPLE`` expected) by numpy. On
a part of them that it isn't fitted on, a temperature is chosen that makes its probabilities likeliest.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import hash_unit, materialise

#: Expected rows of the training sample, and one in so many of them that choose the temperature.
SAMPLE, CALIBRATION = 8000, 5
#: Entries of a vector; its index vector's entries that are not 0; terms with a context vector; least training rows of them; terms on either side that count.
SIZE, ENTRIES, VOCABULARY, LEAST_ROWS, REACH = 128, 4, 4096, 5, 2
#: Hidden units, passes over the sample, rows of a step, weight decay.
HIDDEN, PASSES, STEP_ROWS, DECAY = 32, 60, 128, 1e-4
#: Characters of the texts that are cut into terms at once; slots of one row of partial sums; texts whose vectors are pooled at once, and rows of a batch.
BLOCK_CHARACTERS, SLOTS, BLOCK_TEXTS, ROWS = 1 << 20, 64, 512, 1024
TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: The same, and the ends of lines.
CUT = re.compile(TERM.pattern + r"|\n")
#: Marks of a term's shape; the last is that of a term that repeats the one before.
SHAPES = ["upper", "lower", "title", "digit", "sign", "mixed", "again"]
#: A term of no document: between documents of one block.
NONE = np.uint32(0)


def shape(word: str) -> int:
    """The number of a term's shape in ``SHAPES``."""
    if word.islower():
        return 1
    if not word[0].isalnum():
        return 4
    return 3 if word[0].isdigit() else 0 if word.isupper() and len(word) > 1 else 2 if word.istitle() else 5


def code(term: str) -> int:
    """A term's hash; never that of ``NONE``."""
    return zlib.crc32(term.encode()) or 1


def codes(terms: Iterable[str]) -> np.ndarray:
    """The hash of each term in lower case."""
    crc = zlib.crc32
    return np.array([crc(t.lower().encode()) or 1 for t in terms], np.uint32)


def terms_of(text: str | None) -> list[str]:
    """The terms of a whole text in order, as they stand."""
    return TERM.findall(text or "")


def distinct(rows: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """The number of each row among the different ones, in the order in which they are met, and these."""
    index = {w: n for n, w in enumerate(dict.fromkeys(rows))}
    return np.fromiter(map(index.__getitem__, rows), np.int64, len(rows)), index


def numbered(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """The terms of a block of texts as numbers, one text after the other, how many each text has, and the different terms.

    Terms have no white space in them, so each different word of the block is cut into terms once.
    """
    lists = [t.split() for t in texts]
    word, words = distinct(list(chain.from_iterable(lists)))
    cut, terms = distinct(CUT.findall("\n".join(words)))
    ends = cut == terms.get("\n", -1)
    of, every = np.cumsum(ends)[~ends], cut[~ends]  # the word of each term
    size = np.bincount(of, minlength=len(words))
    start = np.cumsum(size) - size
    n = size[word]
    found = every[np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    text = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    return found, np.bincount(text, n, len(texts)).astype(np.int64), terms


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms x ENTRIES) places and signs of the index vectors of hashes; ``NONE`` has signs of 0."""
    x = h.astype(np.uint64)[:, None] + np.arange(1, ENTRIES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(a))) * np.uint64(b)
    x ^= x >> np.uint64(31)
    sign = np.where(x >> np.uint64(63), 1, -1) * (h != NONE)[:, None]
    return (x % np.uint64(SIZE)).astype(np.int64), sign


def index_vectors(h: np.ndarray) -> np.ndarray:
    """(terms x SIZE): index vectors of length 1, but for entries that fall on one place."""
    place, sign = index_entries(h)
    out = np.zeros((len(h), SIZE))
    np.add.at(out, (np.arange(len(h))[:, None], place), sign / ENTRIES**0.5)
    return out


#: Index vectors of the marks; no term has a space.
MARKS = index_vectors(np.array([code(f"shape {s}") for s in SHAPES], np.uint32))


def slots(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted ``vocabulary``, or -1."""
    if not len(vocabulary):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def context_sums(texts: Sequence[str], vocabulary: np.ndarray) -> np.ndarray:
    """(vocabulary x SIZE): for each term of the sorted ``vocabulary`` the sum of its neighbours' index vectors in ``texts``, which are in lower case."""
    out = np.zeros(len(vocabulary) * SIZE)
    terms, lengths, known = numbered(texts)
    if not len(vocabulary) or not len(terms):
        return out.reshape(-1, SIZE).astype(np.int64)
    # texts lie so far apart that no term of one is next to one of another
    h = np.append(codes(known), NONE)
    terms = np.insert(terms, np.repeat(np.cumsum(lengths), REACH), len(h) - 1)
    slot = slots(h, vocabulary)[terms]
    place, sign = index_entries(h)
    place, sign = place[terms], sign[terms].astype(float)
    at = np.flatnonzero(slot >= 0)
    base = slot[at] * SIZE
    for step in (*range(-REACH, 0), *range(1, REACH + 1)):
        by = at + step
        fit = (by >= 0) & (by < len(terms))
        out += np.bincount((base[fit][:, None] + place[by[fit]]).ravel(), sign[by[fit]].ravel(), len(out))
    return out.reshape(-1, SIZE).astype(np.int64)


def contexts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """Context vectors of ``vocabulary`` over all of ``docs``: partial sums of tasks meet by slots of terms."""
    if not len(vocabulary):
        return np.zeros((0, SIZE), np.int64)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros((len(held.value), SIZE), np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                waiting.append((text.as_py() or "").lower())
                n += len(waiting[-1])
                if n >= BLOCK_CHARACTERS:
                    total += context_sums(waiting, held.value)
                    waiting, n = [], 0
        total += context_sums(waiting, held.value)
        if total.any():
            parts = range(0, len(total), SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array([p // SLOTS for p in parts], pa.int32()), pa.array([total[p : p + SLOTS].tobytes() for p in parts], pa.binary())], ["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(sums.as_buffer(), np.int64)
                total[slot] = total[slot] + part if slot in total else part.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "sums"])

    kinds = "slot int, sums binary"
    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(count, kinds).repartition("slot").mapInArrow(add, kinds)
    found = {r["slot"]: np.frombuffer(r["sums"], np.int64).reshape(-1, SIZE) for r in materialise(sums, "quality-contexts").collect()}  # VOCABULARY / SLOTS rows
    return np.concatenate([found.get(p // SLOTS, np.zeros((len(vocabulary[p : p + SLOTS]), SIZE), np.int64)) for p in range(0, len(vocabulary), SLOTS)])


@dataclass
class Network:
    """Pooled vectors to a probability: standardised, a hidden layer of tanh, one output, a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.spread) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 13) -> Network:
    """A network by Adam; the order of the rows decides nothing but the steps."""
    rng = np.random.default_rng(seed)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(size=(x.shape[1], HIDDEN)) / x.shape[1] ** 0.5, np.zeros(HIDDEN), rng.normal(size=HIDDEN) / HIDDEN**0.5, 0.0)
    x = (x - net.mean) / net.spread
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for turn in range(PASSES):
        rate = 2e-3 * (1 - turn / PASSES)
        order = rng.permutation(len(x))
        for at in range(0, len(x), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30)))
            out = (p - y[rows]) / len(rows)
            back = np.outer(out, weights[2]) * (1 - hidden**2)
            slopes = [x[rows].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ out + DECAY * weights[2], np.array([out.sum()])]
            t += 1
            for n, g in enumerate(slopes):
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                weights[n] -= rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss on rows that the network was not fitted on, by golden section over its logarithm; 1 without such rows.

    The rows count as of their label less one row of each kind, so that few rows, all told apart, give no certainty.
    """
    if not len(x):
        return 1.0
    z = net.logits(x)
    y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda t: float(np.mean(np.logaddexp(0, z / np.exp(t)) - y * z / np.exp(t)))
    low, high, g = -2.5, 2.5, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """Context vectors of a sorted vocabulary, of length 1, and the network; without one all texts get ``share``."""

    vocabulary: np.ndarray
    vectors: np.ndarray
    network: Network | None = None
    share: float = 0.5

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        """For each text the mean of its words' vectors and the mean of its signs' and marks': index vectors, of length 1, and context vectors where there are."""
        out, block, n = [np.zeros((0, 2 * SIZE))], [], 0
        for k, text in enumerate(texts):
            block.append(text or "")
            n += len(block[-1])
            if n >= BLOCK_CHARACTERS or len(block) == BLOCK_TEXTS or k + 1 == len(texts):
                out.append(self.pooled(*numbered(block)))
                block, n = [], 0
        return np.concatenate(out)

    def pooled(self, terms: np.ndarray, lengths: np.ndarray, known: dict[str, int]) -> np.ndarray:
        n, kinds, h = len(lengths), np.array([shape(t) for t in known], int), codes(known)
        if not len(terms):
            return np.zeros((n, 2 * SIZE))
        doc = np.repeat(np.arange(n), lengths)
        # a row of sums for the words and one for the signs and marks of each text
        sign_of = kinds == 4
        row = doc * 2 + sign_of[terms]
        place, sign = index_entries(h)
        sums = np.bincount((row[:, None] * SIZE + place[terms]).ravel(), (sign / ENTRIES**0.5)[terms].ravel(), 2 * n * SIZE).reshape(2 * n, SIZE)
        slot = slots(h, self.vocabulary)[terms]
        if (slot >= 0).any():
            width = len(self.vocabulary)
            counts = np.bincount(row[slot >= 0] * width + slot[slot >= 0], minlength=2 * n * width).reshape(2 * n, width)
            sums = sums + counts.astype(np.float32) @ self.vectors
        again = np.r_[False, (terms[1:] == terms[:-1]) & (doc[1:] == doc[:-1])]
        marks = np.bincount(doc * len(SHAPES) + np.where(again, len(SHAPES) - 1, kinds[terms]), minlength=n * len(SHAPES)).reshape(n, len(SHAPES))
        sums[1::2] += marks @ MARKS
        signs = np.bincount(doc, sign_of[terms], n)
        return (sums / np.maximum(1, np.stack((lengths - signs, lengths + signs), axis=1).reshape(-1, 1))).reshape(n, 2 * SIZE)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.network is None else self.network.probability(x)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the rows of ``labels`` where ``learn`` holds and ``label`` is 0 or 1; word contexts are those of all ``docs``.

    Of the labelled ids about ``sample`` of least hash are read; repeated labels of an id count once, as the largest.
    """
    marks = labels.where(learn).select(F.col(id_col).alias("k"), label.cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    total = marks.count()
    picked = marks.where(hash_unit("k") < sample / max(1, total)).limit(2 * sample)
    # the limit bounds what is broadcast
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), F.col("i") == F.col("k")).select(F.col("k").cast("string").alias("k"), "t", "y")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found, lengths, known = numbered([t or "" for t in batch.slice(at, ROWS).column(1).to_pylist()])
                h = codes(known).astype(np.int64)
                got = [np.unique(h[x]) for x in np.split(found, np.cumsum(lengths)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int64()))], ["terms"])

    learnt = materialise(rows, "quality-rows")
    seen = learnt.mapInArrow(terms, "terms array<bigint>").select(F.explode("terms").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = seen.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "h").limit(VOCABULARY).collect()
    vocabulary = np.array(sorted(r["h"] for r in top), np.uint32)
    sums = contexts(docs, vocabulary, text_col).astype(float)
    model = Model(vocabulary, (sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1))[:, None]).astype(np.float32))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = held.value.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["k", "y", "x"])

    got = learnt.mapInArrow(features, "k string, y int, x array<double>").toArrow()
    order = sorted(range(len(got)), key=lambda n: (got["k"][n].as_py(), got["x"][n].as_py()))
    y = np.array([got["y"][n].as_py() for n in order], float)
    x = np.array([got["x"][n].as_py() for n in order], float).reshape(len(order), 2 * SIZE)
    apart = np.array([zlib.crc32(b"calibration:" + got["k"][n].as_py().encode()) % CALIBRATION == 0 for n in order], bool)
    if len(y) and 0 < y[~apart].sum() < len(y[~apart]):
        model.network = fit(x[~apart], y[~apart])
        model.network.temperature = calibrate(model.network, x[apart], y[apart])
    elif len(y):
        model.share = float((y.sum() + 1) / (len(y) + 2))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the calibrated probability that each whole text is of label 1.

    Null and empty texts have no term and are scored as such. Null ids stay null; repeated rows score alike; other
    columns are not read; an empty table gives an empty one; without labels every score is one half.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.probability(held.value.features(part.column(1).to_pylist())))], ["i", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, score double")
    return out.select(F.col("i").alias(id_col), "score")
