"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Only different fingerprints are compared, so copies cost one row. Two fingerprints within the radius r agree
on at least b-r of b equal blocks of bits (pigeonhole), so comparing within the groups that share b-r blocks
finds every link; no pair is missed and no candidate is dropped. A group over ``TILE`` fingerprints is dealt
into tiles of one bit count each, and only pairs of tiles whose bit counts differ by no more than the radius are made;
each is compared in a task of its own. Within a pair the fingerprints lie in the order of their bit counts and runs
of them whose bit counts differ beyond the radius are skipped. A task returns a spanning forest of the links it found, never the pairs themselves. Components then come from label
propagation with pointer jumping over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import fresh, join_by_key, materialise

#: Most fingerprints of one tile, and of the runs compared at once.
TILE, RUN = 512, 128
#: A tile's number is its bit count times this, plus its place among the tiles of that bit count.
TILE_NUMBERS = 1 << 40
#: Blocks beyond the radius: with radius 2, any two of four 16-bit blocks make a key of 32 bits.
SPARE = 2


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text's word shingles, unsigned; 0 without words."""
    joined = b" ".join((text or "").encode().lower().split())  # both work on ASCII letters and white space alone
    if not joined:
        return 0
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    over, n = np.zeros(64, np.int64), max(1, len(ends) - words + 1)
    for at in range(0, n, 1 << 16):
        some = [digest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + (1 << 16))], ends[min(words, len(ends)) - 1 + at :])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["i", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, fp long")


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` between two sets (the same set: within it) of fingerprints."""
    nodes = np.unique(np.concatenate((left, right)))
    label = np.arange(len(nodes))

    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(np.bitwise_count(x), kind="stable")
        return x[order], np.bitwise_count(x[order]).astype(int)

    (a, na), (b, nb) = ordered(left), ordered(right)
    pairs = []
    for i in range(0, len(a), RUN):
        x, low, high = a[i : i + RUN], na[i], na[min(len(a), i + RUN) - 1]
        for j in range(0, len(b), RUN):
            if nb[j] > high + radius or nb[min(len(b), j + RUN) - 1] < low - radius:
                continue
            y = b[j : j + RUN]
            u, v = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            pairs.append((x[u], y[v]))
    u = np.searchsorted(nodes, np.concatenate([p[0] for p in pairs] or [nodes[:0]]))
    v = np.searchsorted(nodes, np.concatenate([p[1] for p in pairs] or [nodes[:0]]))
    while True:  # the least label spreads over the links, then labels follow their labels
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    held = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[held], nodes[label[held]]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) with u != v: a set of links that connects whatever the links within ``radius`` among the distinct fp connect."""
    blocks = radius + SPARE
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in some) for some in combinations(range(blocks), SPARE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(signed)))).alias("k")).select("fp", "k.*")
    keyed = keyed.withColumn("bits", F.bit_count("fp"))
    classes = keyed.groupBy("band", "key", "bits").agg(F.count(F.lit(1)).alias("n"))
    # at most 65 classes of a group: how many tiles each has, a group of one tile's rows having one in all
    groups = classes.groupBy("band", "key").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("bits", F.ceil(F.col("n") / TILE).cast("int")))).alias("tiles")).where("size > 1")
    small = F.col("size") <= TILE
    dealt = keyed.join(groups, ["band", "key"]).withColumn("own", F.when(small, 0).otherwise(F.col("bits") * TILE_NUMBERS + F.pmod(F.xxhash64("fp"), F.col("tiles")[F.col("bits")])).cast("long"))
    near = F.filter(F.sequence(F.col("bits") - radius, F.col("bits") + radius), lambda c: F.map_contains_key("tiles", c))
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), F.col("tiles")[c] - 1), lambda n: c * F.lit(TILE_NUMBERS) + n)))
    paired = dealt.select("band", "key", "own", "fp", F.explode(F.when(small, F.array(F.lit(0).cast("long"))).otherwise(others)).alias("other"))
    paired = paired.select("band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            *_, second, fp = cols
            fp = fp.view(np.uint64)
            one = cols[2][0] == cols[3][0]
            return forest(fp, fp, radius) if one else forest(fp[~second], fp[second], radius)

        def table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        rest: list[np.ndarray] | None = None  # the last group may go on in the next batch
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])) + 1
            cuts = [0, *new.tolist()]
            yield table([compare([c[a:b] for c in cols]) for a, b in zip(cuts[:-1], cuts[1:])])
            rest = [c[cuts[-1] :] for c in cols]
        yield table([compare(rest)] if rest is not None and len(rest[0]) else [])

    return paired.repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components", hashed: bool = False) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (u, v) reaches.

    Each round a node goes over to that of its neighbours, or itself, whose hash is least, and edges are carried over
    to the nodes that are left, so that they shrink by a share each round and a star is gone in two. What each node
    went over to is then followed down the rounds, one join a round. Nodes that are hashes themselves (``hashed``) are
    taken in their own order, in which a star around its least node is gone in one round.
    """
    left = edges.where("u <> v")
    both = materialise(left.select("u", "v").union(left.select("v", "u")).distinct(), f"{name}-edges")
    label = None
    while not both.isEmpty():
        order = lambda c: F.struct((F.col(c) if hashed else F.xxhash64(c)).alias("h"), F.col(c).alias("to"))
        best = both.groupBy("u").agg(F.min(order("v")).alias("best"))
        step = materialise(best.select(F.col("u").alias("node"), F.least("best", order("u"))["to"].alias("to")), f"{name}-step")
        on = step.toDF("to", "next")
        label = step if label is None else materialise(label.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"{name}-label")
        moved = both.join(step.toDF("u", "a"), "u").join(step.toDF("v", "b"), "v").where("a <> b")
        both = materialise(moved.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-edges")
    if label is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    least = label.groupBy("to").agg(F.min("node").alias("label"))
    return materialise(label.join(least, "to").select("node", "label"), name)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): each row's fingerprint and the least id that it reaches over links of at most ``radius`` bits.

    Null texts are empty; texts without words have fingerprint 0 and link like any other. Repeated rows are rows
    of their own with the same fingerprint. A null id never names a component unless all its ids are null.
    Other columns are not read. An empty table gives an empty table.
    """
    prints = materialise(fingerprints(docs, words, seed, id_col, text_col), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    labels = components(links(nodes, radius))
    joined = materialise(nodes.join(labels, F.col("fp") == F.col("node")).select("fp", "label", "least"), "simhash-groups")
    named = materialise(joined.groupBy("label").agg(F.min("least").alias("named"), F.count(F.lit(1)).alias("m")), "simhash-names")
    linked = join_by_key(joined.select("fp", "label"), named, "label", "m").select("fp", "named")
    every = materialise(nodes.join(linked, "fp", "left").select("fp", F.coalesce("named", "least").alias("component"), "n"), "simhash-components")
    return join_by_key(prints, every, "fp", "n").select(F.col("i").alias(id_col), "fp", "component")


def hexadecimal(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component: that of the least id, and one of repeated rows.

    Of a component whose ids are all null, one row stays.
    """
    found = near_duplicates(docs, words, radius, seed, id_col, text_col)
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component")))
    i, fp = fresh(docs, "keep_id", "keep_fp")
    keep = keep.groupBy(F.col(id_col).alias(i)).agg(F.count(F.lit(1)).alias(fp))
    once = keep.where(F.col(fp) == 1).select(i)
    again = keep.where(F.col(fp) > 1).select(i)
    kept = docs.join(once, docs[id_col].eqNullSafe(F.col(i)), "left_semi")
    twice = docs.join(again, docs[id_col].eqNullSafe(F.col(i)), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(twice)
