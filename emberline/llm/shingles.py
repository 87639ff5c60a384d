"""Near-duplicates by the Jaccard similarity of five-word shingles, checked exactly.

Candidates are texts that share one of ``BANDS`` keys of ``DEEP`` least hashes each: at similarity s a pair shares
none with probability (1 - s^DEEP)^BANDS, 2.7e-5 at 0.8. Every link is then checked on the whole shingle sets.
Texts of a key are first compared with the least of them, so a large group of near copies costs a pair a text. Keys
that this leaves with several components are joined to clusters of texts that share keys; in each, the texts outside
its largest component are compared with all, by tiles: a task counts the shingles that two tiles have in common by a
product of matrices and returns no more links than it needs to join the components that it has found to touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import simhash
from emberline.llm.common import fresh, materialise, split_by_keys

BANDS, DEEP = 20, 4
#: Texts of a tile; shingles of one product of matrices.
TILE, COLUMNS = 256, 4096
#: Shingles hashed at once.
SLICE = 4096
_DRAWN = np.random.default_rng(17).integers(0, 1 << 64, (3, BANDS * DEEP), np.uint64)
TIMES, PLUS, MIX = _DRAWN[0] | np.uint64(1), _DRAWN[1], _DRAWN[2] | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles; a shorter text is one shingle, a text without words none."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(ends)) - 1 :]
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts, last)), np.uint64, len(last)))


def band_keys(x: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), SLICE):
        np.minimum(least, (x[at : at + SLICE, None] * TIMES + PLUS).min(axis=0), out=least)
    return ((least ^ (least >> np.uint64(29))) * MIX).reshape(BANDS, DEEP).sum(axis=1, dtype=np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def checked(pairs: DataFrame, some: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (u, v) of text keys whose sets are alike enough; ``some`` (k, t) has each text once."""
    both = pairs.join(some.toDF("u", "a"), "u").join(some.toDF("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([shingles(t.as_py(), words) for t in batch.column(k)] for k in (2, 3))
            good = pa.array([jaccard(x, y) >= similarity for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(good)

    return both.mapInArrow(run, "u long, v long")


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of ``a`` shares with each of ``b``, by products of 0/1 matrices over the hashes that both sides have."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)
    # of each side the texts and places of its hashes that count, in the order of the places
    sides = []
    for texts in (a, b):
        every = np.concatenate(texts)
        at = np.searchsorted(both, every)
        hit = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == every) if len(both) else at[:0]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])[hit]
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[order], at[hit][order]))
    for low in range(0, len(both), COLUMNS):
        x, y = (np.zeros((len(t), COLUMNS), np.float32) for t in (a, b))
        for m, (row, at) in zip((x, y), sides):
            i, j = np.searchsorted(at, (low, low + COLUMNS))
            m[row[i:j], at[i:j] - low] = 1
        out += x @ y.T
    return out


def joined(rest: list[tuple[int, int, np.ndarray]], every: list[tuple[int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links (key, key) between texts (key, component, shingles) of different components that are alike enough: a spanning forest of the components."""
    a, b = ([x for _, _, x in side] for side in (rest, every))
    shared = common(a, b).astype(float)
    size = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - shared
    own, other = (np.array([c for _, c, _ in side]) for side in (rest, every))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero((shared / np.maximum(1, size) >= similarity) & (own[:, None] != other[None, :]))):
        x, y = find(rest[i][1]), find(every[j][1])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((rest[i][0], every[j][0]))
    return out


def touching(left: DataFrame, some: DataFrame, similarity: float, words: int) -> DataFrame:
    """(u, v): the components of ``left`` (band, key, k, c), the texts of keys with several components, that links join; ``some`` (k, t) has each text once."""
    least = left.groupBy("band", "key").agg(F.min("k").alias("u"))
    cluster = simhash.components(left.join(least, ["band", "key"]).where("k <> u").select("u", F.col("k").alias("v")), "shingle-clusters", hashed=True)
    member = materialise(left.select("k", "c").distinct().join(cluster, F.col("k") == F.col("node")).select(F.col("label").alias("g"), "k", "c"), "shingle-members")
    parts = member.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most")).where("most < size")
    tiles = sizes.select("g", "main", F.ceil(F.col("size") / TILE).cast("int").alias("bs"), F.ceil((F.col("size") - F.col("most")) / TILE).cast("int").alias("as"))
    rows = member.join(tiles, "g").join(some, "k")
    place = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    every = rows.select("g", F.explode(upto("as")).alias("a"), place("bs").alias("b"), F.lit(False).alias("outside"), "k", "c", "t")
    rest = rows.where("c <> main").select("g", place("as").alias("a"), F.explode(upto("bs")).alias("b"), F.lit(True).alias("outside"), "k", "c", "t")

    def run(group: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        of = dict(zip(group["k"].to_pylist(), group["c"].to_pylist()))
        sides: tuple[list, list] = ([], [])
        for outside, k, c, t in zip(*(group[n].to_pylist() for n in ("outside", "k", "c")), group["t"]):
            if k not in held:
                held[k] = shingles(t.as_py(), words)
            sides[not outside].append((k, c, held[k]))
        found = joined(*sides, similarity) if all(sides) else []
        return pa.table({"u": pa.array([of[u] for u, _ in found], pa.int64()), "v": pa.array([of[v] for _, v in found], pa.int64())})

    return every.unionByName(rest).groupBy("g", "a", "b").applyInArrow(run, "u long, v long")


def components(texts: DataFrame, known: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(node, label) of the keys of ``texts`` (k, t) that have a near-duplicate: the least key that links lead to, the links ``known`` (u, v) too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, band_keys(x)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in [shingles(t.as_py(), words)] if len(x)]
            ks = np.repeat(np.array([k for k, _ in found], np.int64), BANDS)
            keys = np.concatenate([b for _, b in found] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(found))), pa.array(keys), pa.array(ks)], ["band", "key", "k"])

    keyed = materialise(texts.mapInArrow(run, "band int, key long, k long"), "shingles")
    groups = keyed.groupBy("band", "key").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least <> most").select("band", "key", "least")
    shared = materialise(keyed.join(groups, ["band", "key"]).distinct(), "shingle-groups")
    # the texts that share a key with another are taken out once, at every size in one way: their keys grow with the input
    maybe, _ = split_by_keys(texts, shared.select("k"), F.col("k"))
    some = materialise(maybe.join(shared.select("k").distinct().hint("merge"), "k", "left_semi").dropDuplicates(["k"]), "shingle-texts")
    pairs = materialise(shared.where("k <> least").select(F.col("least").alias("u"), F.col("k").alias("v")).distinct(), "shingle-pairs")
    links = materialise(checked(pairs, some, similarity, words), "shingle-links")
    label = simhash.components(links.union(known), "shingle-first", hashed=True)
    held = shared.join(label, F.col("k") == F.col("node"), "left").select("band", "key", "k", F.coalesce("label", "k").alias("c"))
    open_ = held.groupBy("band", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band", "key")
    left = materialise(held.join(open_, ["band", "key"]), "shingle-open")
    more = materialise(touching(left, some, similarity, words), "shingle-more")
    # the links left to take in are between components, so the first graph is not gone through again
    over = simhash.components(more, "shingle-over", hashed=True).toDF("own", "over")
    first = label.join(over, F.col("label") == F.col("own"), "left").select("node", F.coalesce("over", "label").alias("label"))
    alone = over.join(label.select("node"), F.col("own") == F.col("node"), "left_anti")  # texts without a link till now
    return materialise(first.union(alone), "shingle-all")


def deduplicate(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component: that of the least id, and one of repeated rows.

    Links are those of the SimHash operator with its defaults and those of alike shingle sets. Null texts are empty.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(key.alias("k"), F.col(text_col).alias("t"))
    prints = materialise(simhash.fingerprints(docs.select(key.alias("k"), text_col), id_col="k", text_col=text_col).distinct(), "shingle-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("i").alias("least")), "shingle-fp")
    same = prints.join(nodes, "fp").where("i <> least").select(F.col("least").alias("u"), F.col("i").alias("v"))
    a, b = nodes.toDF("u", "ku"), nodes.toDF("v", "kv")
    near = simhash.links(nodes).join(a, "u").join(b, "v").select(F.col("ku").alias("u"), F.col("kv").alias("v"))
    label = components(texts, materialise(same.union(near), "shingle-simhash"), similarity, words)
    rows = materialise(docs.select(key.alias("node"), F.col(id_col).alias("i")).groupBy("node", "i").agg(F.count(F.lit(1)).alias("n")), "shingle-rows")
    best = F.struct(F.col("i").isNull(), "i", "node")
    named = rows.join(label, "node", "left").groupBy(F.coalesce("label", "node").alias("c")).agg(F.min_by(F.struct("node", "i", "n"), best).alias("s")).select("s.*")
    k, i, n = fresh(docs, "keep_key", "keep_id", "keep_n")
    keep = materialise(named.toDF(k, i, n), "shingle-keep")
    # a row of a text that has no link and no other row stays without a look at ``keep``
    more = rows.groupBy("node").agg(F.sum("n").alias("n")).where("n > 1").select("node")
    maybe, alone = split_by_keys(docs, label.select("node").union(more), key)
    here = (key == F.col(k)) & F.col(id_col).eqNullSafe(F.col(i))
    kept = maybe.join(keep.where(F.col(n) == 1).hint("merge"), here, "left_semi")
    twice = maybe.join(keep.where(F.col(n) > 1), here).dropDuplicates([k]).select(*docs.columns)
    return alone.unionByName(kept).unionByName(twice)
