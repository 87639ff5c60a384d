"""Hard-negative mining by an inverted multi-index.

The two halves of a vector have a codebook each; a pair of codes is a cell. A half's score with any row of a code is at
most its score with the code's centre plus its own length times the code's radius (over all rows, not a sample), so
the sum of two such bounds holds for a cell. Cells are dealt to shards of neighbouring cells, a large cell to several. In a
shard a query visits cells by falling bounds: a heap walks the two sorted lists of half bounds (multi-sequence). It stops
when the next bound is below what each of its windows still needs: the window is then certified. Where a window has
enough rows, its last one's score goes with the query from its home shard to the others, and shards whose best cell is
below it are left out.

A window is a range of scores. Positives are the best of the same label, in one open window; negatives are the best of
other labels between two shares of a positive's score, a window for each different such score.

The codebooks are fitted on ``SAMPLE`` rows expected; every row is then in a cell, and answers don't depend on them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import hash_unit, materialise
from emberline.llm.vectors import finite, usual_length

#: Rows of the codebooks' sample, codes of a half at most, rows of a cell aimed at.
SAMPLE, CODES, CELL_ROWS = 16_384, 128, 64
#: Different vectors of a shard, rows whose scores are looked at together, queries whose scores with a cell are made together.
SHARD_ROWS, LOOK_ROWS, ASKS = 4096, 1024, 64


@dataclass
class Index:
    """Centres (codes x dimensions) and radii of both halves, the cells (code, code) and each one's first shard and number of shards."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    cells: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.centres[0].shape[1]
        return x[:, :d], x[:, d:]

    def bounds(self, x: np.ndarray, sign: int = 1) -> list[np.ndarray]:
        """Of each half the largest (sign -1: least) score with each code's rows, with room for rounding."""
        out = []
        for half, c, r in zip(self.halves(x), self.centres, self.radii):
            b = half @ c.T + sign * np.linalg.norm(half, axis=1)[:, None] * r[None, :]
            out.append(b + sign * 1e-9 * (1 + np.abs(b) + np.abs(half).sum(axis=1)[:, None] * (1 + np.abs(c).max(initial=0))))
        return out


def codebook(sample: np.ndarray, codes: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """k-means centres of ``sample``; at least one."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(codes, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(sample, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)[None, :]
    parts = [np.argmin(square - 2 * x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def coded(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with the codes i, j of their ``vec`` and its distances di, dj from the centres."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            more = []
            for half, c in zip(held.value.halves(matrix(batch.column(batch.schema.get_field_index("vec"))).astype(float)), held.value.centres):
                own = nearest(half, c)
                more += [pa.array(own.astype(np.int32)), pa.array(np.linalg.norm(half - c[own], axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "i", "di", "j", "dj"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, i int, di double, j int, dj double")


class Shard:
    """Rows of some cells, in the cells' order."""

    def __init__(self, index: Index, points: np.ndarray, labels: np.ndarray, ids: list[list[int]], i: np.ndarray, j: np.ndarray):
        order = np.lexsort((j, i))
        self.points, self.labels, self.ids = points[order], labels[order], [ids[n] for n in order]
        self.only = np.array([x[0] if len(x) == 1 else 0 for x in self.ids], np.int64)
        self.single = np.array([len(x) == 1 for x in self.ids], bool)
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        ends = np.r_[starts[1:], len(i)]
        self.left, self.right = np.unique(i), np.unique(j)
        self.cells = {(int(i[a]), int(j[a])): (int(a), int(b)) for a, b in zip(starts, ends)}
        self.index = index

    def visits(self, up: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, int, int]]:
        """(bound, code, code) by falling bound: each pair of codes of the shard once."""
        a, b = up[0][self.left], up[1][self.right]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        left, right, a, b = self.left[by_a].tolist(), self.right[by_b].tolist(), a[by_a].tolist(), b[by_b].tolist()
        heap = [(-a[0] - b[0], 0, 0)]
        while heap:
            bound, x, y = heapq.heappop(heap)
            yield -bound, left[x], right[y]
            if y + 1 < len(b):
                heapq.heappush(heap, (-a[x] - b[y + 1], x, y + 1))
            if not y and x + 1 < len(a):
                heapq.heappush(heap, (-a[x + 1] - b[0], x + 1, 0))

    def ask(self, queries: np.ndarray, labels: list, own: list[int], windows: list[list[tuple]], k: int, same: bool) -> Iterator[list[list[tuple[int, int]]]]:
        """For each query and each of its windows (low, high) the k best (score, id), ties to the smaller id, within this shard."""
        scores: dict[tuple[int, int], np.ndarray] = {}
        exact = queries.astype(self.points.dtype)
        ups, lows = self.index.bounds(queries.astype(float)), self.index.bounds(queries.astype(float), -1)
        for n, asked in enumerate(windows):
            need = np.array([w[0] for w in asked], float)
            high = np.array([w[1] for w in asked], float)
            found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, self.points.dtype))] * len(asked)
            kin = self.labels == labels[n]
            fit = (kin if same else ~kin) & ~(self.single & (self.only == own[n]))
            waiting, rows = [], 0

            def look() -> None:
                at = np.concatenate([np.arange(*self.cells[c]) for c in waiting])
                s = np.concatenate([scores[c][n] for c in waiting])
                stay = fit[at] & (s >= need.min()) & (s <= high.max())
                at, s = at[stay], s[stay]
                for w in range(len(asked)) if len(at) else ():
                    hit = (s >= need[w]) & (s <= high[w])
                    if hit.any():
                        at_w, s_w = np.concatenate((found[w][0], at[hit])), np.concatenate((found[w][1], s[hit]))
                        if len(s_w) >= k:
                            kth = np.partition(s_w, len(s_w) - k)[len(s_w) - k]
                            need[w] = max(need[w], kth if abs(kth) < 2**53 else np.nextafter(float(kth), -np.inf))
                            at_w, s_w = at_w[s_w >= need[w]], s_w[s_w >= need[w]]
                        found[w] = at_w, s_w

            for bound, i, j in self.visits((ups[0][n], ups[1][n])) if asked else ():
                if bound < need.min():
                    break
                if (i, j) not in self.cells or lows[0][n, i] + lows[1][n, j] > high.max():
                    continue
                if (i, j) not in scores:
                    a, b = self.cells[i, j]
                    scores[i, j] = exact @ self.points[a:b].T
                waiting.append((i, j))
                rows += self.cells[i, j][1] - self.cells[i, j][0]
                if rows >= LOOK_ROWS:
                    look()
                    waiting, rows = [], 0
            if waiting:
                look()
            yield [[(s, x) for s, x in sorted(((int(s), x) for p, s in zip(at, ss) for x in self.ids[p] if x != own[n]), key=lambda h: (-h[0], h[1]))[:k]] for at, ss in found]


def window(mark: int | None, floor: int | None, low: int, high: int) -> tuple[float, float]:
    """Least and largest score asked for: shares in percent of ``mark`` (null: any), not below ``floor``."""
    least, most = (-np.inf, np.inf) if mark is None else (-(-low * mark // 100), high * mark // 100)
    return (least if floor is None else max(least, floor)), most


def _searched(tasks: DataFrame, index: Index, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(query, mark, vec_id, score) of tasks: rows (shard, query null, vec, ids, label, i, j) and (shard, query, own, vec, label, marks, floors)."""
    held = tasks.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard, names = None, [], None, {}

        def code(labels: list[str]) -> np.ndarray:
            return np.array([names.setdefault(x, len(names)) for x in labels], int)

        def ask(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal shard
            if not parts:
                return
            if shard is None:
                got = [(matrix(p.column("vec")), code(p.column("label").to_pylist()), p.column("ids").to_pylist(), p.column("i").to_numpy(), p.column("j").to_numpy()) for p in parts]
                points = np.concatenate([g[0] for g in got])
                top = float(np.abs(points).max(initial=0)) ** 2 * max(1, points.shape[1])
                # doubles hold every sum exactly up to 2**53; beyond, integers do
                points = points.astype(float) if top < 2**51 else points
                shard = Shard(held.value, points, np.concatenate([g[1] for g in got]), [x for g in got for x in g[2]], *(np.concatenate([g[n] for g in got]) for n in (3, 4)))
            for at in range(0, batch.num_rows, ASKS):
                part = batch.slice(at, ASKS)
                vec = matrix(part.column("vec"))
                if shard.points.dtype == float and float(np.abs(vec).max(initial=0)) ** 2 * max(1, vec.shape[1]) >= 2**51:
                    shard.points = shard.points.astype(np.int64)
                marks, floors, own, query = (part.column(c).to_pylist() for c in ("marks", "floors", "own", "query"))
                windows = [[window(m, f, low, high) for m, f in zip(a, b)] for a, b in zip(marks, floors)]
                for q, m, found in zip(query, marks, shard.ask(vec, code(part.column("label").to_pylist()), own, windows, k, same)):
                    yield from ((q, mark, x, s) for mark, hits in zip(m, found) for s, x in hits)

        for batch in batches:
            out: list[tuple] = []
            of = batch.column("shard").to_numpy()
            asks = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])]) if len(of) else np.zeros(0, int)
            for a, b in zip(turns, np.r_[turns[1:], len(of)]):
                if of[a] != now:
                    now, parts, shard = of[a], [], None
                if asks[a]:
                    out += ask(batch.slice(a, b - a))
                else:
                    parts.append(batch.slice(a, b - a))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "mark", "vec_id", "score"])

    dealt = tasks.repartition("shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first())
    return dealt.mapInArrow(run, "query long, mark long, vec_id long, score long")


def _sent(asks: DataFrame, index: Index, low: int, high: int) -> DataFrame:
    """``asks`` once for each shard, their home apart, of which some cell's bound reaches what a window still needs."""
    held = asks.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        cell = np.repeat(np.arange(len(index.cells)), index.parts)
        shard = np.concatenate([np.arange(f, f + p) for f, p in zip(index.first, index.parts)]) if len(index.cells) else np.zeros(0, int)
        order = np.argsort(shard, kind="stable")
        cell, shard = cell[order], shard[order]
        turns = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, int)
        home_at = None
        for batch in batches:
            home_at = batch.schema.get_field_index("home")
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = index.bounds(matrix(part.column("vec")).astype(float))
                best = np.maximum.reduceat(a[:, index.cells[cell, 0]] + b[:, index.cells[cell, 1]], turns, axis=1)
                marks, floors = part.column("marks").to_pylist(), part.column("floors").to_pylist()
                need = np.array([min((window(m, f, low, high)[0] for m, f in zip(x, y)), default=np.inf) for x, y in zip(marks, floors)], float)
                n, s = np.nonzero((best >= need[:, None]) & (shard[turns][None, :] != part.column(home_at).to_numpy()[:, None]))
                sent = part.take(pa.array(n))
                yield pa.RecordBatch.from_arrays([pa.array(shard[turns][s].astype(np.int32)), *sent.columns], ["shard", *sent.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema)
    return asks.mapInArrow(run, f"shard int, {kinds}")


def best_in_windows(points: DataFrame, asks: DataFrame, index: Index, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(query, mark, vec_id, score): the k best candidates of each window of ``asks`` (query, own, label, vec, home, marks)."""
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("query", "long"), ("own", "long"), ("marks", "array<long>"), ("floors", "array<long>"), ("ids", "array<long>"), ("i", "int"), ("j", "int"))}
    points = points.select("shard", empty["query"], empty["own"], "label", "vec", empty["marks"], empty["floors"], "ids", "i", "j")
    asked = lambda a: a.select("shard", "query", "own", "label", "vec", "marks", "floors", empty["ids"], empty["i"], empty["j"])
    first = asks.withColumn("floors", F.transform("marks", lambda m: F.lit(None).cast("long")))
    near = materialise(_searched(points.unionByName(asked(first.withColumn("shard", F.col("home")))), index, k, same, low, high), "negatives-home")
    reached = near.groupBy("query", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    reached = reached.groupBy("query").agg(F.collect_list(F.struct("mark", "floor")).alias("reached"))
    known = lambda m: F.filter("reached", lambda r: r["mark"].eqNullSafe(m))
    again = asks.join(reached, "query", "left").withColumn("floors", F.transform("marks", lambda m: F.get(known(m), F.lit(0))["floor"])).drop("reached")
    far = _searched(points.unionByName(asked(_sent(again, index, low, high))), index, k, same, low, high)
    w = Window.partitionBy("query", "mark").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build(data: DataFrame, d: int) -> tuple[DataFrame, Index]:
    """The multi-index of ``data`` (label, vec, ids), and the rows with their codes and shard."""
    total = data.count()
    codes = int(max(1, min(CODES, (total / CELL_ROWS) ** 0.5)))
    some = data.where(hash_unit("vec", "label") < SAMPLE / max(1, total)).select("vec").limit(2 * SAMPLE).toArrow()["vec"].combine_chunks()
    some = matrix(some).astype(float).reshape(len(some), d)
    index = Index((codebook(some[:, : d // 2], codes), codebook(some[:, d // 2 :], codes)))
    rows = materialise(coded(data, index), "negatives-coded")
    radii = []
    for n, (code, distance) in enumerate((("i", "di"), ("j", "dj"))):
        r = np.zeros(len(index.centres[n]))
        for x in rows.groupBy(code).agg(F.max(distance).alias("r")).collect():  # a row for each code
            r[x[code]] = x["r"] * (1 + 1e-9)
        radii.append(r)
    index.radii = tuple(radii)
    cells = sorted((x["i"], x["j"], x["n"]) for x in rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect())  # at most CODES ** 2
    index.cells = np.array([c[:2] for c in cells], int).reshape(-1, 2)
    first, parts, shard, filled = [], [], 0, 0
    for _, _, n in cells:
        if filled and filled + n > SHARD_ROWS:
            shard, filled = shard + 1, 0
        p = -(-n // SHARD_ROWS)
        first.append(shard)
        parts.append(p)
        shard, filled = (shard, filled + n) if p == 1 else (shard + p, 0)
    index.first, index.parts = np.array(first, int), np.array(parts, int)
    places = rows.sparkSession.createDataFrame([(c[0], c[1], f, p) for c, f, p in zip(cells, first, parts)], "i int, j int, first int, parts int")
    shard_of = (F.col("first") + F.pmod(F.xxhash64("vec", "label"), F.col("parts"))).cast("int")
    return rows.join(F.broadcast(places), ["i", "j"]).select("label", "vec", "ids", "i", "j", shard_of.alias("shard")), index


def hard_negatives(
    vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, length: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchors`` holds.

    A component x counts as floor(scale * x), a score is an integer inner product, higher ones first, ties to the smaller
    id. An anchor's positives are its ``positives`` best rows of the same ``label``; for each, the first ``negatives`` rows
    of other labels whose score is from ``low`` to ``high`` percent of the positive's. A positive without any gives no
    row; nor does one of a score below 0, as its window is empty.

    Rows with a null id, label or vector, or null or non-finite components take no part, nor do vectors of another length
    than ``length`` (null: the most frequent one). Equal rows count once. Rows of the anchor's own id are none of its
    candidates; several different rows of one id are anchors, and candidates, each for itself. An empty table gives none.
    Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vec"))
    d = usual_length(rows) if length is None else length
    rows = rows.where(F.size("vec") == d).withColumn("vec", F.transform("vec", lambda c: F.floor(c.cast("double") * scale))).distinct()
    w = Window.partitionBy("vec", "label").orderBy("vec_id")
    # of equal vectors and labels an answer can hold as many as asked for, and the anchor's own
    data = rows.drop("anchor").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(positives, negatives) + 1)
    data = materialise(data.groupBy("vec", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "negatives-data")
    points, index = build(data, d)
    points = materialise(points, "negatives-points")
    asked = rows.where("anchor").select(F.col("vec_id").alias("own"), "label", "vec").distinct().withColumn("query", F.monotonically_increasing_id())
    places = rows.sparkSession.createDataFrame([(int(c[0]), int(c[1]), int(f), int(p)) for c, f, p in zip(index.cells, index.first, index.parts)], "i int, j int, first int, parts int")
    home = (F.col("first") + F.pmod(F.xxhash64("vec", "label"), F.col("parts"))).cast("int").alias("home")
    asked = materialise(coded(asked, index).join(F.broadcast(places), ["i", "j"]).select("query", "own", "label", "vec", home), "negatives-asked")
    like = materialise(best_in_windows(points, asked.withColumn("marks", F.array(F.lit(None).cast("long"))), index, positives, True, low, high), "negatives-positives")
    marks = like.groupBy("query").agg(F.collect_set("score").alias("marks"))
    unlike = best_in_windows(points, asked.join(marks, "query"), index, negatives, False, low, high)
    pairs = like.select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("score").alias("mark"))
    pairs = pairs.join(unlike.select("query", "mark", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["query", "mark"])
    pairs = pairs.join(asked.select("query", F.col("own").alias("anchor_id")), "query")
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
