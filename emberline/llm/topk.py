"""Exact top-k inner products: KD-trees per shard.

Different vectors are dealt to shards of a bounded number of rows. A task builds its shard's tree by median
splits with tight bounding boxes and searches it best-first for each query: a box's bound is the largest inner
product that the query could have in it, and a box whose bound is below the kth score is never opened. The kth
score that a query reaches in its home shard goes with it to the others, so they start pruned.
Ties are kept throughout, so the answer is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import materialise
from emberline.llm.vectors import answer, fold, usable, usual_length

#: Different vectors of one shard and of one leaf of its tree.
SHARD_ROWS, LEAF_ROWS = 4096, 128


class KdTree:
    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.leaf_rows = points, leaf_rows
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        self._grow(np.arange(len(points)))
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray) -> int:
        here = self.points[rows]
        node = len(self.low)
        self.low.append(here.min(axis=0))
        self.high.append(here.max(axis=0))
        self.rows.append(rows)
        self.children.append(None)
        if len(rows) > self.leaf_rows and here.shape[1]:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            order = rows[np.argpartition(here[:, axis], len(rows) // 2)]
            self.rows[node] = None
            self.children[node] = (self._grow(order[: len(rows) // 2]), self._grow(order[len(rows) // 2 :]))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores that hold all of the k best at or above ``floor``, ties included."""
        heap = [(-bounds[0], 0)]
        rows, scores, kth = np.zeros(0, int), np.zeros(0, self.points.dtype), floor
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            s = self.points[self.rows[node]] @ query
            hit = s >= kth
            rows, scores = np.concatenate((rows, self.rows[node][hit])), np.concatenate((scores, s[hit]))
            if len(scores) > k:
                kth = max(kth, np.partition(scores, len(scores) - k)[len(scores) - k])
                stay = scores >= kth
                rows, scores = rows[stay], scores[stay]
        return rows, scores


def _searched(tasks: DataFrame, k: int) -> DataFrame:
    """Rows (shard, query null, vec, ids, floor null) and (shard, query, vec, ids null, floor) to (query, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, ids, tree = None, [], [], None

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "vec_id", "score"])

        def ask(queries: list[dict]) -> Iterator[tuple]:
            nonlocal tree
            if not points or not queries:
                return
            if tree is None:
                whole = np.array(points, np.int64)
                # doubles hold every sum exactly up to 2**53; beyond, integers do
                top = float(np.abs(whole).max(initial=0)) ** 2 * max(1, whole.shape[1])
                tree = KdTree(whole.astype(float) if top < 2**51 else whole)
            kind = tree.points.dtype
            asked = np.array([q["vec"] for q in queries], np.int64)
            if kind == float and len(asked) and float(np.abs(asked).max(initial=0)) ** 2 * max(1, asked.shape[1]) >= 2**51:
                tree = KdTree(tree.points.astype(np.int64))
                kind = tree.points.dtype
            asked = asked.astype(kind)
            for q, x, b in zip(queries, asked, tree.bounds(asked)):
                rows, scores = tree.search(x, b, k, -np.inf if q["floor"] is None else q["floor"])
                hits = sorted((-int(s), i) for r, s in zip(rows, scores) for i in ids[r])
                yield from ((q["query"], i, -s) for s, i in hits[:k])

        for batch in batches:
            out, queries = [], []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    out += ask(queries)
                    shard, points, ids, tree, queries = r["shard"], [], [], None, []
                if r["query"] is None:
                    points.append(r["vec"])
                    ids.append(r["ids"])
                else:
                    queries.append(r)
            out += ask(queries)
            yield table(out)

    dealt = tasks.repartition("shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first())
    return dealt.mapInArrow(run, "query long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds its k largest integer inner products, ties to the smaller id.

    A component x counts as floor(scale * x). Rows with a null id or vector, or null or non-finite components,
    take no part, nor do vectors of another than the most frequent length. Repeated rows of one vector and id
    count once; a row with the query's own id is no candidate of it. Fewer candidates than k give all of them; an
    empty table gives none. Other columns are not read.
    """
    whole = usable(vectors.where(F.lit(True)), id_col, vec_col)
    asked = usable(vectors.where(queries), id_col, vec_col)
    d = usual_length(whole)
    whole, asked = (x.where(F.size("vec") == d).select("vec_id", F.transform("vec", lambda c: F.floor(c.cast("double") * scale)).alias("vec")).distinct() for x in (whole, asked))
    data = materialise(fold(whole, k + 1), "topk-data")
    shards = max(1, -(-data.count() // SHARD_ROWS))
    home = F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")
    data = data.withColumn("shard", home)
    query = materialise(asked.select("vec").distinct().withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    names = materialise(asked.join(query, "vec").select("query", "vec_id").withColumnRenamed("vec_id", "query_id"), "topk-names")
    points = data.select("shard", F.lit(None).cast("long").alias("query"), "vec", "ids", F.lit(None).cast("long").alias("floor"))
    none = F.lit(None).cast("array<bigint>").alias("ids")
    at_home = query.select(home.alias("shard"), "query", "vec", none, F.lit(None).cast("long").alias("floor"))
    near = materialise(_searched(points.unionByName(at_home), k + 1), "topk-home")
    floors = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    floors = floors.select("query", F.when(F.col("n") > k, F.col("low")).alias("floor"))
    away = query.join(floors, "query", "left").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", "vec", none, "floor")
    far = _searched(points.unionByName(away.where(F.col("shard") != home)), k + 1)
    return answer(near.unionByName(far), names, k)
