"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over the presence of words and signs; each
later model also reads the probabilities of the categories before it. In training those are out-of-fold
predictions, so that a later model sees them as good as they will be on new text. Words are chosen for each
category by a chi-square test. Training rows are a bounded sample of the labelled ones (``SAMPLE`` rows expected);
every text is then read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import hash_unit

#: Expected rows of the training sample; features of one category; folds.
SAMPLE, FEATURES, FOLDS = 8000, 400, 4
#: Least chi-square value, and rows, of a chosen word (the first: one chance in ten thousand).
CHI, ROWS = 15.1, 5
WORD = re.compile(r"\w+|[^\w\s]+")


def terms(text: str | None) -> np.ndarray:
    """The different words and signs of a text as sorted crc32 numbers."""
    found = set(WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in found), np.uint32, len(found)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Link:
    """One category's words and model."""

    def __init__(self, docs: list[np.ndarray], earlier: np.ndarray, y: np.ndarray):
        self.words = choose(docs, y)
        self.w = logistic(self.inputs(docs, earlier), y) if 0 < y.sum() < len(y) else np.append(np.zeros(len(self.words) + earlier.shape[1]), 20.0 if len(y) and y.all() else -20.0)

    def inputs(self, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        x = np.zeros((len(docs), len(self.words)))
        for n, d in enumerate(docs):
            at = np.searchsorted(self.words, d)
            at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == d)] if len(self.words) else at[:0]
            x[n, at] = 1
        return np.concatenate((x, earlier), axis=1)

    def predict(self, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        return apply(self.w, self.inputs(docs, earlier))


def choose(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Words that tell the category's rows from the others, sorted."""
    if not len(docs) or not y.sum() or y.all():
        return np.zeros(0, np.uint32)
    words, at = np.unique(np.concatenate(docs), return_inverse=True)
    own = np.repeat(y, [len(d) for d in docs])
    a = np.bincount(at, weights=own, minlength=len(words))  # rows with the word: of the category, and all
    n1, total, pos = np.bincount(at, minlength=len(words)), len(docs), float(y.sum())
    # the chi-square value of the table of rows with and without the word, in and out of the category
    spread = n1 * pos * (total - n1) * (total - pos)
    chi = np.where(spread > 0, total * (a * total - n1 * pos) ** 2 / np.maximum(spread, 1), 0)
    good = np.flatnonzero((chi > CHI) & (n1 >= ROWS))
    return np.sort(words[good[np.argsort(-chi[good], kind="stable")[:FEATURES]]])


class Chain:
    """Models of the categories in their order; ``threshold`` is that of the last, of best F1 on out-of-fold predictions."""

    def __init__(self, docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray):
        self.links: list[Link] = []
        self.threshold = 0.5
        earlier = np.zeros((len(docs), 0))
        for c in range(labels.shape[1]):
            y = labels[:, c]
            known = np.flatnonzero(~np.isnan(y))
            out = np.full(len(docs), float(np.nanmean(y)) if len(known) else 0.0)
            for f in range(FOLDS):
                learn, rest = known[folds[known] != f], np.flatnonzero(folds == f)
                link = Link([docs[i] for i in learn], earlier[learn], y[learn])
                if len(rest):
                    out[rest] = link.predict([docs[i] for i in rest], earlier[rest])
            self.links.append(Link([docs[i] for i in known], earlier[known], y[known]))
            if c == labels.shape[1] - 1 and len(known):
                self.threshold = best_threshold(out[known], y[known])
            earlier = np.concatenate((earlier, out[:, None]), axis=1)

    def predict(self, texts: Sequence[str | None]) -> np.ndarray:
        docs = [terms(t) for t in texts]
        earlier = np.zeros((len(docs), 0))
        for link in self.links:
            earlier = np.concatenate((earlier, link.predict(docs, earlier)[:, None]), axis=1)
        return earlier


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, not under one half: clean documents weigh more than missed ones."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1.0, y.sum()))
    f1[p[order] < 0.5] = -1
    return float(max(0.5, p[order][int(np.argmax(f1))]))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain over ``categories`` (name to a condition over ``labels``' columns; null where not labelled), in their order.

    Of the labelled ids about ``sample`` of least hash are read; repeated labels of an id count once, as the largest.
    """
    names = list(categories)
    marks = labels.select(F.col(id_col).alias("k"), *(c.cast("int").alias(f"c{n}") for n, c in enumerate(categories.values()))).where("k is not null")
    marks = marks.groupBy("k").agg(*(F.max(f"c{n}").alias(f"c{n}") for n in range(len(names))))
    total = marks.count()
    picked = marks.where(hash_unit("k") < sample / max(1, total)).limit(2 * sample)
    # the limit bounds what is broadcast
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(picked), F.col("i") == F.col("k")).select("k", "t", *(f"c{n}" for n in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [terms(t.as_py()).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(got, pa.binary()), *batch.columns[2:]], ["k", "terms", *batch.schema.names[2:]])

    found = rows.mapInArrow(run, "k string, terms binary, " + ", ".join(f"c{n} int" for n in range(len(names)))).toArrow()
    keys, raw = found["k"].to_pylist(), found["terms"].to_pylist()
    order = sorted(range(len(keys)), key=lambda n: (keys[n], len(raw[n])))
    terms_of = [np.frombuffer(raw[n], "<u4") for n in order]
    marked = np.array([[np.nan if (v := found[f"c{c}"][n].as_py()) is None else v for c in range(len(names))] for n in order], float).reshape(len(order), len(names))
    return Chain(terms_of, marked, np.array([zlib.crc32(keys[n].encode()) % FOLDS for n in order], int))


def predict(docs: DataFrame, chain: Chain, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prob_<category> ..., toxic): the chain's probabilities, and whether the last reaches the chain's threshold.

    Null and empty texts have no word. Null ids stay null; repeated rows are predicted alike; other columns are
    not read; an empty table gives an empty table; without labels nothing is toxic.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p{n}" for n in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = c.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, n]) for n in range(p.shape[1])), pa.array(p[:, -1] >= c.threshold)], ["i", *names, "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")
    return out.select(F.col("i").alias(id_col), *(F.col(n).alias(f"prob_{c}") for n, c in zip(names, categories)), "toxic")


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not call toxic; null texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        c, texts = held.value, list(texts)
        parts = [c.predict(texts[n : n + 256])[:, -1] < c.threshold for n in range(0, len(texts), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(clean(F.col(text_col)))
