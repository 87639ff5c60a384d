"""Packing: order-preserving dynamic programming over window cuts.

Rows keep the order in which they are read. Cuts may fall at a document's end (free), at a sentence's end (a
small penalty) and, inside a sentence of over ``LONG`` tokens, at every ``GRID``-th of them (a larger one); the rows'
end may be cut anywhere. A window
costs its padding: what is missing to the window's size, nothing if its length is a power of two. With
``f[j]`` the least cost of all up to cut j at position p[j],

    f[j] = cut[j] + min( min over p[j]-W <= p[i] < p[j] of f[i] + W - (p[j]-p[i]),  min over powers of two w of f[at p[j]-w] )

The first minimum is that of ``f[i] + p[i]`` over a sliding window, which a monotone queue gives in constant
time; the second looks at no more than log2(W)+1 places.

Each task packs its own rows, so nothing is shuffled. A task holds a bounded buffer: when the buffer is full, the
best path is fixed but for its last window, whose tokens stay for the next buffer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import tokens

#: Tokens after which a task fixes the best path so far.
BUFFER = 1 << 18
#: Tokens of a long sentence, and between the places where one may be cut.
LONG, GRID = 64, 32


def best_cuts(positions: list[int], penalties: list[float], window: int, least: int = 64) -> list[int]:
    """Positions of the cuts of least cost; ``positions`` ascend from 0 and no two neighbours are over ``window`` apart.

    The first is the start and the last is always a cut. Powers of two below ``least`` count as any other length.
    """
    n = len(positions)
    cost, back = [0.0] * n, [0] * n
    place = {p: i for i, p in enumerate(positions)}.get
    powers = [1 << k for k in range(window.bit_length()) if least <= 1 << k < window]
    # the queue: f[i] + p[i] ascending, p[i] and i beside it
    sums, places, index, head, tail = [0.0] * n, [0] * n, [0] * n, 0, 1
    for j in range(1, n):
        p = positions[j]
        while places[head] < p - window:
            head += 1
        i = index[head]
        best = sums[head] + window - p
        for w in powers:
            k = place(p - w)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalties[j]
        cost[j], back[j] = best, i
        g = best + p
        while tail > head and sums[tail - 1] > g:
            tail -= 1
        sums[tail], places[tail], index[tail] = g, p, j
        tail += 1
    out, j = [], n - 1
    while j:
        out.append(positions[j])
        j = back[j]
    return out[::-1]


def sentence_ends(bpe: tokens.ByteBpe, ids: np.ndarray) -> np.ndarray:
    """How many of a text's ids stand up to the end of each of its sentences but the text's own: after a full stop, ! or ? that white space follows."""
    return np.flatnonzero(bpe.stops[ids[:-1]] & bpe.blanks[ids[1:]]) + 1


class _Packer:
    def __init__(self, window: int, sentence: float, hard: float, first: int):
        self.window, self.sentence, self.hard, self.sequence = window, sentence, hard, first
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int, int]] = []  # id, its ids before, ids here, ids in all
        # places where the buffer may be cut, by their penalty: within a document split by buffers, at sentences' and at documents' ends
        self.splits: list[int] = []
        self.sentences: list[np.ndarray] = []
        self.ends: list[int] = []
        self.size = 0

    def add(self, doc, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        while at < n:  # a document longer than the buffer goes in by parts
            step = min(n - at, BUFFER)
            inner = ends if step == n else ends[(ends > at) & (ends < at + step)] - at
            self.sentences.append(inner + self.size)
            self.docs.append((doc, at, step, n))
            self.ids.append(ids[at : at + step])
            self.size += step
            at += step
            (self.ends if at == n else self.splits).append(self.size)
            if self.size >= BUFFER:
                yield from self.flush(False)

    def places(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the buffer may be cut, ascending, and the penalties."""
        self.sentences = [np.concatenate(self.sentences)]
        hard = [np.array(self.splits, np.int64)]
        if last:  # the end may be cut anywhere, so that the rows' last windows need no padding
            hard.append(np.arange(max(1, self.size - 2 * self.window), self.size))
        known = np.unique(np.concatenate((np.array([0, *self.ends]), *self.sentences, *hard)))
        step = min(GRID, self.window)
        for i in np.flatnonzero(np.diff(known) > min(LONG, self.window)).tolist():
            hard.append(np.arange(known[i] + step, known[i + 1], step))
        # each place once, with the least of its penalties
        penalty = np.full(self.size + 1, np.inf)
        for places, cost in ((np.concatenate(hard), self.hard), (self.sentences[0], self.sentence), (np.array(self.ends, np.int64), 0.0)):
            penalty[places] = cost
        places = np.flatnonzero(penalty < np.inf)
        return places, penalty[places]

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        places, costs = self.places(last)
        ends = best_cuts([0, *places.tolist()], [0.0, *costs.tolist()], self.window, 1 if last else 64)
        if not last:
            ends.pop()  # the last window is still open
        if not ends:
            return
        ids = np.concatenate(self.ids)
        start = d = done = 0  # done: ids of document d that are packed
        for end in ends:
            offset = 0
            while start < end:
                doc, before, here, total = self.docs[d]
                length = min(here - done, end - start)
                yield doc, before + done, length, zlib.crc32(ids[start : start + length].tobytes()), total, self.sequence, offset
                start, offset, done = start + length, offset + length, done + length
                if done == here:
                    d, done = d + 1, 0
            self.sequence += 1
        rest = self.docs[d:]
        if rest and done:
            doc, before, here, total = rest[0]
            rest[0] = (doc, before + done, here - done, total)
        self.ids, self.docs = ([ids[start:]] if start < self.size else []), rest
        self.sentences = [x[x > start] - start for x in self.sentences]
        self.splits, self.ends = ([x - start for x in some if x > start] for some in (self.splits, self.ends))
        self.size -= start


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, sentence_penalty: float = 0.5, hard_penalty: float = 2.0, memo: int = tokens.MEMO_ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all of ``docs`` in sequences of at most ``window`` tokens.

    A document is its text's ids (null text: none) and then ``end_id``, so that each row has at least one token.
    Rows are packed in the order read; pieces of a sequence lie there gapless from offset 0. Repeated rows are
    packed each for themselves; null ids stay null; other columns are not read; an empty table gives no piece.
    ``memo`` words are remembered by each Python worker, and as many that were met before them: it sets memory against
    time and changes no result.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.shared(tokens.ByteBpe, tokenizer, memo)
        packer = _Packer(window, sentence_penalty, hard_penalty, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part.column(0).to_pylist(), bpe.encode([t or "" for t in part.column(1).to_pylist()])):
                    out += packer.add(doc, np.append(ids, end), sentence_ends(bpe, ids))
            yield table(out)
        yield table(list(packer.flush(True)))

    names = ["i", "start", "length", "crc", "total", "seq", "off"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    id_type = rows.limit(0).select("i").toArrow().schema.field(0).type

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    packed = rows.mapInArrow(run, f"i {kind}, start long, length long, crc long, total long, seq long, off long")
    return packed.select(F.col("i").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("seq").alias("sequence_id"), F.col("off").alias("offset"))
