"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary and one form: one counts a target corpus, the other all documents. Both
interpolate bigram, unigram and uniform estimates with the same weights. A document's score is the mean over its
tokens of the target's loss less the background's: the lower, the more it is like the target.

The vocabulary is the most frequent ``VOCABULARY`` words of all documents; every other word has one id of its own,
the unknown word. Pairs are those of two known words, or of a text's start and a known word; where a pair has an
unknown word its weight goes to the unigram. All pairs are counted exactly, so what is gathered grows with the input.

Words, and pairs of the ``HOT`` words that a bounded sample shows to be most frequent, are counted in a first pass
over the texts; these counts have a size fixed by the parameters and are broadcast. A second pass scores what they
can score and deals all other pairs out by ranges of pairs, a row for each block of documents and range. A range's
task counts its pairs, turns the counts into losses and sends each block the sums of its documents, which are then
added up. No pair that many documents share is dealt out, so ranges stay even.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import hash_unit, materialise

VOCABULARY, HOT = 1 << 17, 512
#: Weights of the bigram and unigram estimates; the rest is uniform.
BIGRAM, UNIGRAM = 0.6, 0.39
#: Expected rows of the sample that shows which words are frequent: which words are counted early changes no result.
SAMPLE = 2000
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000
#: Tokens of a block of documents, and of a range of pairs.
BLOCK_TOKENS, RANGE_TOKENS = 1 << 20, 1 << 21
#: Target ids up to which they are broadcast; beyond, texts and ids meet in a shuffle.
BROADCAST_IDS = 1 << 20
#: Names of two counts that no word has: tokens, texts with a token.
TOKENS, TEXTS = "", " "

WORD = re.compile(r"\w+|[^\w\s]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def count_words(rows: DataFrame, hot: list[str]) -> DataFrame:
    """(word, at, n, own): counts over all rows (t, own) and over those of the target; of words (at is null), and of pairs of ``hot`` words (word is null), the place before ``hot``'s first being a text's start."""
    h = len(hot)
    of = {w: i + 1 for i, w in enumerate(hot)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = Counter(), Counter()
        pairs = np.zeros((2, (h + 2) ** 2), np.int64)

        def table() -> pa.RecordBatch:
            names = list(every)
            out = [pa.array(names, pa.string()), pa.nulls(len(names), pa.int64()), pa.array(every.values(), pa.int64()), pa.array([target[w] for w in names], pa.int64())]
            every.clear()
            target.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "at", "n", "own"])

        for batch in batches:
            for t, own in zip(batch.column(0), batch.column(1).to_pylist()):
                got = words(t.as_py())
                if not got:
                    continue
                x = np.fromiter((of.get(w, h + 1) for w in got), np.int64, len(got))
                at = np.append(0, x[:-1]) * (h + 2) + x
                for counts, places in ((every, pairs[0]), (target, pairs[1]))[: 1 + own]:
                    counts.update(got)
                    counts[TOKENS] += len(got)
                    counts[TEXTS] += 1
                    np.add.at(places, at, 1)
                if len(every) > FLUSH:
                    yield table()
        yield table()
        at = np.flatnonzero(pairs[0])
        at = at[(at % (h + 2) <= h) & (at // (h + 2) <= h)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at), pa.array(pairs[0][at]), pa.array(pairs[1][at])], ["word", "at", "n", "own"])

    counted = rows.mapInArrow(run, "word string, at long, n long, own long")
    return counted.groupBy("word", "at").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def ranked(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words, ties in the order of the words."""
    return counted.where(F.col("word").isNotNull() & ~F.col("word").isin(TOKENS, TEXTS)).orderBy(F.desc("n"), "word").limit(n).select("word", "own", "n")


def frequent(rows: DataFrame, n: int) -> list[str]:
    """The most frequent words of a sample of the rows (t, own), at most ``n``."""
    some = rows.where(hash_unit("t") < SAMPLE / max(1, rows.count()))
    return [r["word"] for r in ranked(count_words(some, []), n).collect()]


class Models:
    """Both models' counts of words and hot pairs. Axis 0 is the target (0) and the background (1)."""

    def __init__(self, vocabulary: list[str], counts: np.ndarray, totals: np.ndarray, texts: np.ndarray, hot: list[str], pairs: np.ndarray):
        self.of, self.other = {w: i for i, w in enumerate(vocabulary)}, len(vocabulary)
        self.start = self.other + 1
        self.side = self.start + 1
        unigrams = np.concatenate((counts, (totals - counts.sum(axis=1))[:, None]), axis=1).astype(float)
        self.uniform = 1.0 / unigrams.shape[1]
        self.unigram = unigrams / np.maximum(1, totals)[:, None]
        self.before = np.concatenate((unigrams, texts[:, None]), axis=1)  # how often each id, or a text's start, stands before
        self.hot_side = len(hot) + 2
        self.hot = np.full(self.side, -1, np.int64)  # the place of an id among the hot ones
        for i, w in enumerate(hot):
            if w in self.of:
                self.hot[self.of[w]] = i + 1
        self.hot[self.start] = 0
        self.pairs = pairs
        # a pair's number times an odd one, modulo a power of two: a bijection whose high bits deal the pairs out evenly
        self.bits = max(36, (self.side**2 - 1).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.times = np.uint64(0x9E3779B97F4A7C15)
        self.back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << self.bits))

    def ids(self, got: list[str]) -> np.ndarray:
        found, other = self.of.get, self.other
        return np.fromiter((found(w, other) for w in got), np.int64, len(got))

    def losses(self, m: int, before: np.ndarray, ids: np.ndarray, joint: np.ndarray | None) -> np.ndarray:
        """Losses of tokens whose pair stands ``joint`` times; None: without a pair."""
        if joint is None:
            p = (BIGRAM + UNIGRAM) * self.unigram[m][ids]
        else:
            p = BIGRAM * joint / np.maximum(1, self.before[m][before]) + UNIGRAM * self.unigram[m][ids]
        return -np.log(p + (1 - BIGRAM - UNIGRAM) * self.uniform)

    def deal(self, before: np.ndarray, ids: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's range and its number there; ``ranges`` is a power of two."""
        mixed = (before.astype(np.uint64) * np.uint64(self.side) + ids.astype(np.uint64)) * self.times & self.mask
        low = self.bits - (ranges.bit_length() - 1)
        return (mixed >> np.uint64(low)).astype(np.int64), (mixed & np.uint64((1 << low) - 1)).astype(np.uint32)

    def pair(self, at: int, keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pairs ``keys`` of range ``at``."""
        low = self.bits - (ranges.bit_length() - 1)
        mixed = (np.uint64(at) << np.uint64(low)) + keys.astype(np.uint64)
        number = (mixed * self.back & self.mask).astype(np.int64)
        return number // self.side, number % self.side


def fit(rows: DataFrame, vocabulary_size: int = VOCABULARY, hot_words: int = HOT) -> Models:
    """The models' words and hot pairs from all rows (t, own)."""
    hot = frequent(rows, hot_words)
    counted = materialise(count_words(rows, hot), "lm-words")
    special = {r["word"]: (r["own"], r["n"]) for r in counted.where(F.col("word").isin(TOKENS, TEXTS)).collect()}
    top = ranked(counted, vocabulary_size).toArrow()
    pairs = counted.where("word is null").select("at", "own", "n").toArrow()  # at most (hot_words + 2)^2 rows
    top = sorted(zip(*(top[c].to_pylist() for c in ("word", "own", "n"))), key=lambda r: (-r[2], r[0]))
    counts = np.array([[r[k] for r in top] for k in (1, 2)], np.int64).reshape(2, len(top))
    joint = np.zeros((2, (len(hot) + 2) ** 2))
    joint[0, pairs["at"].to_numpy()], joint[1, pairs["at"].to_numpy()] = pairs["own"].to_numpy(), pairs["n"].to_numpy()
    totals, texts = (np.array(special.get(w, (0, 0))) for w in (TOKENS, TEXTS))
    return Models([r[0] for r in top], counts, totals, texts, hot, joint)


def postings(rows: DataFrame, held, ranges: int, kind: str, id_type: pa.DataType) -> DataFrame:
    """For each block of documents a row with their ids, tokens and the losses known by now, and for each range a row of pairs.

    ``d`` are a block's documents by their number; those of the target are written as -1 - d.
    """
    schema = f"block long, at int, d array<int>, keys array<int>, a array<float>, b array<float>, ids array<{kind}>, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        block = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        tokens = 0

        def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))

        def table() -> pa.RecordBatch:
            nonlocal block, tokens
            n = np.array([len(x) for _, _, x in docs], np.int64)
            ids = np.concatenate([x for _, _, x in docs])
            before = np.append(0, ids[:-1]) if len(ids) else ids
            before[(np.cumsum(n) - n)[n > 0]] = m.start
            d = np.repeat(np.arange(len(docs)), n)
            own = np.array([o for _, o, _ in docs])
            sums = np.zeros((2, len(docs)))
            known = (before != m.other) & (ids != m.other)
            x, y = m.hot[before], m.hot[ids]
            hot = known & (x >= 0) & (y >= 0)
            for part, joint in ((~known, None), (hot, m.pairs[:, x[hot] * m.hot_side + y[hot]])):
                for k in (0, 1):
                    sums[k] += np.bincount(d[part], m.losses(k, before[part], ids[part], None if joint is None else joint[k]), len(docs))
            rest = np.flatnonzero(known & ~hot)
            at, keys = m.deal(before[rest], ids[rest], ranges)
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order].view(np.int32)
            whose = d[rest][order]
            whose = np.where(own[whose], -1 - whose, whose).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            found = at[cuts[:-1]]
            parts = [(whose[i:j], keys[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            size = len(parts)
            none = [np.zeros(0, np.float32)] * size
            out = [
                pa.array(np.full(size + 1, block)),
                pa.array(np.append(block % 8191 % ranges, found).astype(np.int32)),
                lists([np.zeros(0, np.int32), *(w for w, _ in parts)], pa.int32()),
                lists([np.zeros(0, np.int32), *(k for _, k in parts)], pa.int32()),
                lists([sums[0].astype(np.float32), *none], pa.float32()),
                lists([sums[1].astype(np.float32), *none], pa.float32()),
                pa.array([[i for i, _, _ in docs], *([None] * size)], pa.list_(id_type)),
                pa.array([n.tolist(), *([None] * size)], pa.list_(pa.int64())),
            ]
            block, tokens = block + 1, 0
            docs.clear()
            return pa.RecordBatch.from_arrays(out, ["block", "at", "d", "keys", "a", "b", "ids", "n"])

        for batch in batches:
            for i, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = m.ids(words(t.as_py()))
                docs.append((i, own, x))
                tokens += len(x) + 1
                if tokens >= BLOCK_TOKENS:
                    yield table()
        if docs:
            yield table()

    return rows.select("i", "t", "own").mapInArrow(run, schema)


def score(docs: DataFrame, target_ids: DataFrame, vocabulary_size: int = VOCABULARY, hot_words: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, loss_target, loss_background, difference) for each row; ``target_ids`` holds the ids of the target's documents.

    Losses are means over the document's tokens, in nats. A text that is null or has no token has 0 tokens and
    null losses. Null ids are in no target. Repeated rows count as often as they stand. Without a target document
    the target's model is all but uniform. Other columns are not read; an empty table gives an empty table.
    ``hot_words`` changes the work, not the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind, id_type = rows.schema["i"].dataType.simpleString(), rows.limit(0).select("i").toArrow().schema.field(0).type
    named = target_ids.select(F.col(target_ids.columns[0]).alias("k")).where("k is not null").distinct()
    small = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(named) if small else named, F.col("i") == F.col("k"), "left").select("i", "t", F.col("k").isNotNull().alias("own"))
    if not small:  # blocks are to be the same if a task runs again
        rows = rows.sortWithinPartitions("i", "t")
    models = fit(rows.select("t", "own"), vocabulary_size, hot_words)
    ranges = 1 << max(models.bits - 32, int(models.before[1, :-1].sum() // RANGE_TOKENS).bit_length())
    held = spark.sparkContext.broadcast(models)
    schema = f"block long, d array<int>, a array<float>, b array<float>, ids array<{kind}>, n array<long>"
    names = ["block", "d", "a", "b", "ids", "n"]

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        """Losses of one range's pairs, summed for each document of each block; a block's own row passes."""
        m, at = held.value, key[0].as_py()
        own_row = pc.is_valid(group["ids"])
        passed = group.filter(own_row).select(names)
        group = group.filter(pc.invert(own_row))
        if not len(group):
            return passed
        lengths = pc.list_value_length(group["d"]).to_numpy()
        d, keys = (pc.list_flatten(group[c]).to_numpy() for c in ("d", "keys"))
        target = d < 0
        pairs, of, all_n = np.unique(keys.view(np.uint32), return_inverse=True, return_counts=True)
        joint = (np.bincount(of, target, len(pairs)), all_n)
        before, ids = m.pair(at, pairs, ranges)
        losses = [m.losses(k, before, ids, joint[k])[of] for k in (0, 1)]
        row = np.repeat(np.arange(len(group)), lengths)
        d = np.where(target, -1 - d, d)
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0))  # a row's documents ascend
        ends = pa.array(np.searchsorted(row[first], np.arange(len(group) + 1)).astype(np.int32))
        sums = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (d[first].astype(np.int32), *(np.add.reduceat(x, first).astype(np.float32) for x in losses))]
        out = pa.table([group["block"], *sums, pa.nulls(len(group), passed.schema.field("ids").type), pa.nulls(len(group), passed.schema.field("n").type)], names=names)
        return pa.concat_tables([passed, out.cast(passed.schema)])

    def added(group: pa.Table) -> pa.Table:
        """The documents of one block with the sums of all ranges."""
        own_row = pc.is_valid(group["ids"])
        own, rest = group.filter(own_row), group.filter(pc.invert(own_row))
        n = pc.list_flatten(own["n"]).to_numpy()
        d = pc.list_flatten(rest["d"]).to_numpy()
        a, b = (pc.list_flatten(own[c]).to_numpy() + np.bincount(d, pc.list_flatten(rest[c]).to_numpy(), len(n)) for c in ("a", "b"))
        some, count = n == 0, np.maximum(1, n)
        return pa.table([pc.list_flatten(own["ids"]), pa.array(n), pa.array(a / count, mask=some), pa.array(b / count, mask=some)], names=["i", "n", "a", "b"])

    dealt = postings(rows, held, ranges, kind, id_type).groupBy("at").applyInArrow(counted, schema)
    out = dealt.groupBy("block").applyInArrow(added, f"i {kind}, n long, a double, b double")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias("loss_target"), F.col("b").alias("loss_background"), (F.col("a") - F.col("b")).alias("difference"))
