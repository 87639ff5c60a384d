"""The link graph over all of lineitem, and its structure where cycles hide from the bounded search."""

import random
from itertools import pairwise
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.operators import graph
from emberline.sources import adapters

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_links_come_from_every_order(spark):
    orders = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        orders.setdefault(r["l_orderkey"], []).append((r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_shipdate"]))
    want = {(a[2], b[2]) for rows in orders.values() for a, b in pairwise(sorted(rows))}
    assert {tuple(r) for r in adapters.supplier_links(spark, SF).select("src", "dst").collect()} == want


@pytest.mark.parametrize("hops", [16, 1])
def test_structure_equals_a_walk(spark, monkeypatch, hops):
    monkeypatch.setattr(graph, "HOPS", hops)
    rng = random.Random(4)
    ring = [5, 17, 3, 11, 8, 19]
    edges = {*zip(ring, ring[1:] + ring[:1]), (1, 5), (19, 20), (20, 21), (21, 20), (21, 22), (22, 22), (30, 31), *((rng.randint(40, 55), rng.randint(40, 55)) for _ in range(22))}
    nodes = sorted({n for e in edges for n in e})
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            for s, d in edges:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[n] = seen
    e, v = spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long")
    radius = {n: sum(n in reach[m] for m in nodes if m != n) for n in nodes}
    group = {n: min([n, *(m for m in nodes if m in reach[n] and n in reach[m])]) for n in nodes}
    size = {n: list(group.values()).count(group[n]) for n in nodes}
    assert {r["node"]: (r["blast_radius"], r["in_cycle"]) for r in graph.structure(v, e).collect()} == {n: (radius[n], size[n] > 1) for n in nodes}
    assert {tuple(r) for r in graph.cycles(v, e).collect()} == {(group[n], size[n], n) for n in nodes if size[n] > 1} | {(s, 1, s) for s, d in edges if s == d}


def test_tiers_with_a_cycle_take_few_checkpoints(spark, monkeypatch):
    made, cut = [], graph.cut
    edges = [(0, k) for k in range(1, 40)] + [(k, 40) for k in range(1, 40)] + [(40, 41), (41, 42), (42, 40), (42, 43), (43, 44)]
    e, v = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(k,) for k in range(45)], "node long")
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or cut(df))
    got = {r["node"]: r["tier"] for r in graph.tiers(v, e, v.where("node = 0")).collect()}
    assert got == {0: 0, **{k: 1 for k in range(1, 40)}, 40: 2, 41: 2, 42: 2, 43: 3, 44: 4}
    assert len(made) < 60
