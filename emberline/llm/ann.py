"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive dimension scan.

Vectors get one more component that makes all of them equally long, so that the largest inner product is the
least distance; then all are turned by a random rotation. Lists come from k-means over a bounded sample of rows;
every vector is in its nearest list. A query probes its nearest list first, and then others with the kth distance
found there. Within a list the rotated vectors are read in blocks of columns, and after each block a hypothesis test
drops those whose partial distance, scaled to all columns, is too far above the kth distance known so far. What stays
is scored exactly on the vectors given.

The sample, and what it fits, is bounded: ``SAMPLE`` rows expected, at most ``LISTS`` lists. The number of lists
probed is fitted too: the least that holds ``COVER`` of the sample's own exact neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import hash_unit, materialise
from emberline.llm.vectors import answer, fold, usable, usual_length

SAMPLE, LISTS, COVER = 16_384, 1024, 0.94
#: Columns of one block, the test's width (in deviations of a partial distance), rows of a list's part.
BLOCK, EPSILON, PART_ROWS = 16, 2.1, 4096
#: Queries held at once by a task, pairs of a query and a row compared at once.
ASKS, PAIRS = 1024, 1 << 20


@dataclass
class Index:
    rotation: np.ndarray
    longest: float
    centres: np.ndarray
    probes: int

    def turn(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors of one length (queries: with 0 for the added component)."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))
        return np.concatenate((x, extra[:, None]), axis=1) @ self.rotation

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        d = (self.centres**2).sum(axis=1)[None, :] - 2 * turned @ self.centres.T
        n = min(n, len(self.centres))
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def fit(sample: np.ndarray, longest: float, lists: int, k: int, seed: int = 7, rounds: int = 8) -> Index:
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))[0]
    index = Index(rotation, longest, np.zeros((1, sample.shape[1] + 1)), 1)
    turned = index.turn(sample, False)
    lists = max(1, min(lists, len(turned)))
    index.centres = turned[rng.choice(len(turned), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([index.nearest(turned[i : i + 4096], 1)[:, 0] for i in range(0, len(turned), 4096)])
        total = np.zeros_like(index.centres)
        np.add.at(total, own, turned)
        n = np.bincount(own, minlength=lists)
        index.centres[n > 0] = total[n > 0] / n[n > 0, None]
    own = np.concatenate([index.nearest(turned[i : i + 4096], 1)[:, 0] for i in range(0, len(turned), 4096)])
    ask = rng.choice(len(turned), min(256, len(turned)), replace=False)
    score = sample[ask] @ sample.T
    score[np.arange(len(ask)), ask] = -np.inf
    k = max(1, min(k, len(turned) - 1))
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = index.nearest(index.turn(sample[ask], True), lists)
    place = np.argsort(order, axis=1)  # of each list in the query's order
    needed = np.sort(np.take_along_axis(place, own[true], 1).ravel())
    index.probes = min(lists, int(needed[min(len(needed) - 1, int(COVER * len(needed)))]) + 1)
    return index


def scan(x: np.ndarray, q: np.ndarray, k: int, known: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rows of ``x`` that may be among the k nearest to rows of ``q``, all rotated.

    Partial distances grow by blocks of columns, each with its test against the kth distance: ``known``, or where that
    is infinite the kth of the rows nearest by the first block. Blocks are products of matrices while many pairs stay.
    """
    n, d = x.shape
    square = lambda low, high: (q[:, low:high] ** 2).sum(axis=1)[:, None] - 2 * q[:, low:high] @ x[:, low:high].T + (x[:, low:high] ** 2).sum(axis=1)[None, :]
    part, seen, limit = square(0, BLOCK), min(BLOCK, d), known + slack
    for i in np.flatnonzero(np.isinf(known)) if n > 2 * k else ():
        first = np.argpartition(part[i], 2 * k - 1)[: 2 * k]
        limit[i] = np.partition(((x[first] - q[i]) ** 2).sum(axis=1), k - 1)[k - 1] + slack
    bound = lambda: limit if seen == d else limit * (1 + EPSILON / np.sqrt(seen)) ** 2 * (seen / d) + slack
    stay = part <= bound()[:, None]
    while seen < d and stay.sum() * 8 > stay.size:
        part += square(seen, seen + BLOCK)
        seen = min(seen + BLOCK, d)
        stay &= part <= bound()[:, None]
    at, rows = np.nonzero(stay)
    part = part[at, rows]
    while seen < d and len(at):
        part = part + ((x[rows, seen : seen + BLOCK] - q[at, seen : seen + BLOCK]) ** 2).sum(axis=1)
        seen = min(seen + BLOCK, d)
        stay = part <= bound()[at]
        at, rows, part = at[stay], rows[stay], part[stay]
    return at, rows


def approximate_neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds the nearest k found, by inner product in double precision.

    Scores are exact on the vectors given; ties go to the smaller id. Rows with a null id or vector, null or
    non-finite components or only zeros take no part, nor do vectors of another than the most frequent length.
    Repeated rows of one vector and id count once; a row with the query's own id is no candidate of it. Fewer
    candidates than k give all that were found; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole, asked = (usable(x, id_col, vec_col).where(F.exists("vec", lambda c: c != 0)) for x in (vectors, vectors.where(queries)))
    d = usual_length(whole)
    whole, asked = (x.where(F.size("vec") == d).select("vec_id", F.col("vec").cast("array<double>").alias("vec")).distinct() for x in (whole, asked))
    data = materialise(fold(whole, k + 1), "ann-data")
    square = F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c)
    n, longest = data.select(square.alias("s")).agg(F.count(F.lit(1)), F.max("s")).first()
    query = materialise(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()), "ann-queries")
    names = asked.join(query, "vec").select("query", F.col("vec_id").alias("query_id"))
    if not n:
        return answer(spark.createDataFrame([], "query long, vec_id long, score double"), names, k)
    # about SAMPLE rows, chosen by a hash; the limit only guards the driver against a hash gone wrong
    sample = data.where(hash_unit("vec") < SAMPLE / n).select("vec").limit(2 * SAMPLE).toArrow()["vec"].combine_chunks()
    points = sample.values.to_numpy().reshape(-1, d) if len(sample) else np.array([data.first()["vec"]])
    index = spark.sparkContext.broadcast(fit(points, longest, min(LISTS, max(1, round(float(n) ** 0.5))), k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            vec = batch.column(1)
            x = vec.flatten().to_numpy().reshape(-1, d)
            probing = batch.schema.names[0] == "query"
            lists = ix.nearest(ix.turn(x, probing), ix.probes if probing else 1).astype(np.int32)
            offsets = pa.array(np.arange(0, lists.size + 1, lists.shape[1] or 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lists.ravel()))], [*batch.schema.names, "lists"])

    placed = materialise(data.select("ids", "vec").mapInArrow(place, "ids array<long>, vec array<double>, lists array<int>").select(F.col("lists")[0].alias("list"), "ids", "vec"), "ann-lists")
    # a list over PART_ROWS is dealt into parts, each searched for every query that probes the list
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # at most LISTS rows
    none = F.lit(None).cast("double").alias("floor")
    points_in = placed.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec"), "parts").cast("int").alias("part"), F.lit(None).cast("long").alias("query"), "vec", "ids", none)

    def asking(queries: DataFrame, lists: Column) -> DataFrame:
        probing = queries.select("query", "vec", "floor").mapInArrow(place, "query long, vec array<double>, floor double, lists array<int>")
        probing = probing.select("query", "vec", "floor", F.explode(lists).alias("list")).join(sizes, "list")
        return probing.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "vec", F.lit(None).cast("array<bigint>").alias("ids"), "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        here, points, ids, block = None, [], [], None

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "vec_id", "score"])

        def ask(asks: list[tuple]) -> Iterator[tuple]:
            nonlocal block
            if not points or not asks:
                return
            if block is None:
                x = np.concatenate(points)
                block = x, ix.turn(x, False)
            x, turned = block
            step = max(1, PAIRS // len(x))
            for some in (asks[i : i + step] for i in range(0, len(asks), step)):
                original = np.array([v for _, v, _ in some])
                squares = (original * original).sum(axis=1)
                floor = np.array([-np.inf if f is None else f for _, _, f in some])
                at, rows = scan(turned, ix.turn(original, True), k + 1, ix.longest + squares - 2 * floor, 1e-9 * (ix.longest + squares.max()))
                scores = (x[rows] * original[at]).sum(axis=1)
                good = scores >= floor[at]
                at, rows, scores = at[good], rows[good], scores[good]
                ends = np.searchsorted(at, np.arange(len(some) + 1))
                for (q, _, _), i, j in zip(some, ends, ends[1:]):
                    r, s = rows[i:j], scores[i:j]
                    if len(r) > k + 1:
                        stay = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        r, s = r[stay], s[stay]
                    hits = sorted((-v, m) for n, v in zip(r.tolist(), s.tolist()) for m in ids[n])
                    yield from ((q, m, -v) for v, m in hits[: k + 1])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            whose = batch.column(2).to_pylist()
            vec = batch.column(3).flatten().to_numpy().reshape(-1, d)
            out, asks = [], []
            own, floors = batch.column(4), batch.column(5).to_pylist()
            for n, (key, q) in enumerate(zip(keys, whose)):
                if key != here:
                    out += ask(asks)
                    here, points, ids, block, asks = key, [], [], None, []
                if q is None:
                    points.append(vec[n : n + 1])
                    ids.append(own[n].as_py())
                else:
                    asks.append((q, vec[n], floors[n]))
                    if len(asks) == ASKS:
                        out += ask(asks)
                        asks = []
            out += ask(asks)
            yield table(out)

    def search(asks: DataFrame) -> DataFrame:
        dealt = points_in.unionByName(asks).repartition("list", "part").sortWithinPartitions("list", "part", F.col("query").asc_nulls_first())
        return dealt.mapInArrow(run, "query long, vec_id long, score double")

    home = materialise(search(asking(query.withColumn("floor", none), F.slice("lists", 1, 1))), "ann-home")
    best = home.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k + 1)
    floors = best.where(F.col("n") == k + 1).select("query", F.col("score").alias("floor"))
    rest = search(asking(query.join(floors, "query", "left"), F.slice("lists", 2, LISTS)))
    return answer(home.unionByName(rest), names, k)
