"""Language identification by hierarchical discrimination.

A linear classifier over hashed character n-grams first picks the language family; within the family,
one-versus-one linear support vector machines vote for the language. Both are trained on a bounded sample of
labelled rows (``PER_LANGUAGE`` rows expected for each language); every text is then read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import hash_unit

#: Expected training rows of a language, and of all; each language has ``LEAST_ROWS`` all the same.
PER_LANGUAGE, ALL_ROWS, LEAST_ROWS = 600, 4800, 20
#: Of the least similarity of a language's training rows to the rest of them, this share is asked of a text that is to count as known; of one under 2^SHORT places half as much.
FLOOR, SHORT = 0.6, 6
#: Hashed n-gram places.
PLACES = 1 << 15
#: Characters of a text handled at once.
SLICE = 1 << 18
UNKNOWN = "und"
#: Families of common languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}
#: ASCII that isn't a letter counts as a space.
FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Places of the byte 2-, 3- and 4-grams of the lower-cased text with single spaces between words and around it.

    A long text goes by slices that end before white space, and each slice begins with the last bytes of the one
    before, so that no gram is lost or counted twice; only a word of half a slice or more is cut.
    """
    end, last = 0, b""
    while end < len(text) or not last:
        at, end = end, min(len(text), end + SLICE)
        whole = end
        while end < len(text) and end > at + SLICE // 2 and not text[end].isspace():
            end -= 1
        if end <= at + SLICE // 2:
            end = whole
        raw = b" ".join(text[at:end].lower().encode().translate(FOLD).split()) + b" "
        if last and raw == b" ":
            continue
        a = np.frombuffer(last + raw if last else b" " + raw, np.uint8).astype(np.uint32)
        if len(a) < 4:
            a = np.pad(a, (0, 4 - len(a)), constant_values=32)
        two = a[:-1] | a[1:] << np.uint32(8)
        three = two[:-1] | a[2:] << np.uint32(16)
        four = three[:-1] | a[3:] << np.uint32(24)
        # of the bytes of the slice before, which are three, no gram counts again
        old = len(last)
        every = np.concatenate((two[max(0, old - 1) :] ^ np.uint32(0x5BD1E995), three[max(0, old - 2) :], four[max(0, old - 3) :] ^ np.uint32(0x27D4EB2F)))
        yield ((every * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
        last = a[-3:].astype(np.uint8).tobytes()


def features(text: str) -> np.ndarray:
    """A text's counts at each place, square-rooted and scaled to length 1."""
    counts = np.zeros(PLACES, np.float32)
    for g in grams(text):
        counts += np.bincount(g, minlength=PLACES)
    counts = np.sqrt(counts)
    return counts / max(1e-9, float(np.sqrt((counts * counts).sum())))


def packed(f: np.ndarray) -> bytes:
    """A text's features as few bytes: the places that have a value, and the values."""
    return zlib.compress(np.flatnonzero(f).astype("<u2").tobytes() + f[f > 0].astype("<f4").tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 6
    return np.frombuffer(raw, "<u2", n).astype(np.int32), np.frombuffer(raw, "<f4", n, 2 * n)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12, strength: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by averaged stochastic subgradient steps.

    ``rows`` are sparse (places, values); ``y`` is -1 or 1, and both weigh alike.
    """
    rng = np.random.default_rng(seed)
    n = len(rows)
    share = {s: n / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    w, scale, bias, t = np.zeros(PLACES), 1.0, 0.0, n  # the weights are scale * w
    mean, kept = np.zeros(PLACES + 1), 0
    for r in range(rounds):
        for i in rng.permutation(n):
            t += 1
            rate = 1 / (strength * t)
            at, v = rows[i]
            c = int(y[i])
            out = scale * float(v @ w[at]) + bias
            scale *= 1 - rate * strength
            if c * out < 1:
                step = min(rate, 50.0) * c * share[c]
                w[at] += step / scale * v
                bias += 0.01 * step / 50
        if r >= rounds // 2:
            mean[:-1] += scale * w
            mean[-1] += bias
            kept += 1
    return mean / max(1, kept)


class Model:
    def __init__(self, languages: list[str], families: list[str], rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray):
        self.languages = languages
        self.families = sorted(set(families))
        self.members = [[i for i, f in enumerate(families) if f == name] for name in self.families]
        family = np.array([self.families.index(f) for f in families] or [0])[y] if len(y) else y
        weights = [train_svm(rows, np.where(family == f, 1, -1)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [(a, b) for m in self.members for a, b in combinations(m, 2)]
        for a, b in self.pairs:
            own = np.flatnonzero((y == a) | (y == b))
            weights.append(train_svm([rows[i] for i in own], np.where(y[own] == a, 1, -1)))
        self.weights = np.array(weights or np.zeros((0, PLACES + 1)), np.float32)
        self.centres, self.floors = np.zeros((len(languages), PLACES), np.float32), np.zeros((len(languages), 16))
        for l in range(len(languages)):
            own = [rows[i] for i in np.flatnonzero(y == l)]
            total = np.zeros(PLACES)
            for at, v in own:
                total[at] += v
            length = float(np.sqrt(total @ total))
            self.centres[l] = total / max(1e-9, length)
            # each row against the others alone, as if it were held out; features have length 1
            near = np.array([(d - 1) / np.sqrt(max(1e-9, length * length - 2 * d + 1)) for at, v in own for d in [float(v @ total[at])]])
            # a short text is less like any: a text of 2^k places or more is held against rows of as many
            wide = np.array([len(at) for at, _ in own])
            for k in range(16):
                of = near[wide >= 1 << k]
                self.floors[l, k] = FLOOR * (0.5 if k < SHORT else 1) * max(0.0, float(np.quantile(of, 0.001))) if len(of) > 1 else self.floors[l, k - 1] if k else 0.0

    def known(self, text: str) -> bool:
        """Whether the text is as like some language's training rows as these are like one another, ``FLOOR`` allowed for."""
        f = features(text)
        k = max(0, int(np.count_nonzero(f)).bit_length() - 1)
        return bool((self.centres @ f >= self.floors[:, k]).any())

    def predict(self, text: str) -> tuple[str, float]:
        """The language and a score from 0 to 1: the family's confidence times that of the language within it."""
        if not self.languages:
            return UNKNOWN, 0.0
        out = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        sure = lambda m: 1 / (1 + np.exp(-2 * float(np.clip(m, -30, 30))))
        n = len(self.families) if len(self.families) > 1 else 0
        family = int(np.argmax(out[:n])) if n else 0
        best = self.members[family]
        score = sure(out[family]) if n else 1.0
        votes = dict.fromkeys(best, (0, 0.0))
        for (a, b), m in zip(self.pairs, out[n:]):
            if a in votes:
                won = a if m > 0 else b
                votes[won] = (votes[won][0] + 1, votes[won][1] + abs(float(m)))
        chosen = max(best, key=lambda i: (*votes[i], -i))
        duels = [float(m) if a == chosen else -float(m) for (a, b), m in zip(self.pairs, out[n:]) if chosen in (a, b)]
        return self.languages[chosen], float(score * (sure(min(duels)) if duels else 1.0))


def train(docs: DataFrame, families: Mapping[str, str] = FAMILIES, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from the rows of ``docs`` with a language and a text with a letter; the sample is the rows of least hash, about ``per_language`` each and ``ALL_ROWS`` in all."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()}  # a row for each language
    if not counts:
        return Model([], [], [], np.zeros(0, int))
    per_language = max(LEAST_ROWS, min(per_language, ALL_ROWS // len(counts)))
    share = F.lit(per_language) / F.element_at(F.create_map(*(F.lit(x) for l in counts.items() for x in l)), F.col("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(l, packed(features(t))) for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            columns = list(zip(*out)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["l", "f"])

    sample = rows.where(hash_unit("i", "t") < share).select("t", "l").mapInArrow(run, "l string, f binary").limit(2 * per_language * len(counts) + 1000).toArrow()
    languages = sorted(set(sample["l"].to_pylist()))
    # in an order of their own, whatever the order in which tasks ended
    found = sorted(((l.as_py(), *unpacked(f.as_py())) for l, f in zip(sample["l"], sample["f"])), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    return Model(languages, [families.get(l, l) for l in languages], [(at, v.astype(float)) for _, at, v in found], np.array([languages.index(l) for l, _, _ in found], int))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; ``und`` with score 0 where the text is null or has no letter."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = [m.predict(t) if has_letter(t) else (UNKNOWN, 0.0) for t in (x.as_py() for x in batch.column(1))]
            langs, scores = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["i", "l", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, l string, s double")
    return out.select(F.col("i").alias(id_col), F.col("l").alias("lang_pred"), F.col("s").alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language: not ``und``, like the rows of a learnt language, and a score of ``least`` or more.

    Rows with a null text go; repeated rows stay or go together.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        m = held.value
        return pd.Series([has_letter(t) and m.known(t) and m.predict(t)[1] >= least for t in texts], dtype=bool)

    return docs.where(known(F.col(text_col)))


def identify(docs: DataFrame, learn: Column | None = None, **columns: str) -> DataFrame:
    """(id, lang_pred, score) for every row, learning from the rows where ``learn`` holds.

    Null languages and null texts are not learnt from; without any labelled row all is ``und`` with score 0.
    Null ids stay null; repeated rows are predicted alike; other columns are not read; an empty table gives an
    empty table.
    """
    return predict(docs, train(docs if learn is None else docs.where(learn), **columns))
