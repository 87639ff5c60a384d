"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from emberline.llm import simhash
from emberline.llm.common import split_by_keys


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("tile", [256, 5])
def test_stage_finds_edited_copies(spark, tile, monkeypatch):
    import corpus_pipeline
    from emberline.llm import shingles, simhash

    monkeypatch.setattr(shingles, "TILE", tile)
    rng = random.Random(8)
    vocabulary = [f"word{n}" for n in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 200))) for _ in range(40)]
    texts.append("few words only")
    for n in range(40):
        base = texts[n].split()
        for edits in (1, 2, 3, 8):  # the last ones are often below the bound
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    w = texts[0].split()
    for at in range(12):  # a chain: each like the one before, the ends unlike
        w[at * 5] = f"other{at}"
        texts.append(" ".join(w))
    seen = list(map(sets, texts))
    prints = list(map(simhash.fingerprint, texts))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if len(seen[a] & seen[b]) >= 0.8 * len(seen[a] | seen[b]) or (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {n for n in range(len(texts)) if find(n) == n}
    assert len(want) < len(texts) - 60
    assert {r["doc_id"] for r in kept.collect()} == want


def test_common_counts(monkeypatch):
    from emberline.llm import shingles

    monkeypatch.setattr(shingles, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((3, 40, 25, 1), (10, 50)))
    assert shingles.common(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_split_by_keys_loses_no_row_and_passes_few_others(spark):
    """Two parts that make up the table, whatever the sign of a hash and the other columns' names; no keys, no rows."""
    rows = spark.range(3000).select(F.xxhash64("id").alias("k"), F.col("id").alias("filter_bits"), F.col("id").alias("FILTER_BUCKET"))
    keys = rows.where("filter_bits % 7 = 0").select("k")
    maybe, alone = split_by_keys(rows, keys, F.col("k"))
    assert maybe.columns == rows.columns == alone.columns
    inside, outside = ([r["filter_bits"] for r in part.collect()] for part in (maybe, alone))
    assert sorted(inside + outside) == list(range(3000))
    assert {n for n in range(3000) if n % 7 == 0} <= set(inside) and len(inside) < 500
    maybe, alone = split_by_keys(rows, keys.limit(0), F.col("k"))
    assert maybe.count() == 0 and alone.count() == 3000
    maybe, alone = split_by_keys(rows.limit(0), keys, F.col("k"))
    assert maybe.count() == alone.count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(12)
    edges = [(n, n + 1) for n in range(1000, 1200)] + [(1500, n) for n in range(1501, 1600)] + [(n, 1599) for n in range(1400, 1450)] + [(2000 + n, 2000 + (n + 1) % 30) for n in range(30)]
    edges += [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(350)] + [(1500, 1501), (7000, 7000)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root.setdefault(a, a)
            root.setdefault(b, b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)
    assert simhash.components(spark.createDataFrame([(5, 5)], "u long, v long")).count() == 0


def test_stage_makes_few_tables_on_the_driver(spark, monkeypatch):
    """Each table made is a plan, its broadcasts and its files on the driver: links found first are not gone through again."""
    from emberline.llm import shingles

    made = []
    for module in (shingles, simhash):
        monkeypatch.setattr(module, "materialise", lambda df, name, f=module.materialise: made.append(name) or f(df, name))
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{n}" for n in range(300)], k=80)) for _ in range(12)]
    rows = [(n, f"{texts[n % 12]} end{n}") for n in range(48)]  # four near copies each
    kept = shingles.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(12))
    assert len(made) <= 20, made


def test_over_links_join_components_and_lone_texts(spark, monkeypatch):
    """Links found late, between components or texts without a link till then, end in the components of all links."""
    from emberline.llm import shingles

    rng = random.Random(6)
    words = [f"w{n}" for n in range(500)]
    rows = [(n, " ".join(rng.choices(words, k=60))) for n in range(9)]
    key = {r["doc_id"]: r["k"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("k")).collect()}
    link = lambda pairs: spark.createDataFrame([(key[a], key[b]) for a, b in pairs], "u long, v long")
    first, late = [(0, 1), (1, 2), (3, 4)], [(2, 3), (5, 6), (7, 4)]
    least = lambda n: min(key[x] for x in next((g for g in ((0, 1, 2), (3, 4)) if n in g), (n,)))
    monkeypatch.setattr(shingles, "touching", lambda *_: spark.createDataFrame([(least(a), least(b)) for a, b in late], "u long, v long"))
    texts = spark.createDataFrame([(key[n], t) for n, t in rows], "k long, t string")
    got = {r["node"]: r["label"] for r in shingles.components(texts, link(first)).collect()}
    one, two = min(key[n] for n in (0, 1, 2, 3, 4, 7)), min(key[5], key[6])
    assert got == {**{key[n]: one for n in (0, 1, 2, 3, 4, 7)}, key[5]: two, key[6]: two}


def test_samples_reach_the_driver_small(spark, monkeypatch):
    """What is gathered for training on the driver: four bytes a term, and less than four a place of a text's features."""
    from emberline.llm import langid, toxicity

    sent, frame = [], type(spark.range(1))

    def watched(self, f=frame.toArrow):
        sent.append(f(self))
        return sent[-1]

    monkeypatch.setattr(frame, "toArrow", watched)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefghijklm", k=5)) for _ in range(300)) for _ in range(40)]
    docs = spark.createDataFrame([(n, None if n == 7 else t, f"l{n % 2}") for n, t in enumerate(texts)], "doc_id long, text string, lang string")
    langid.train(docs)
    places = sum(np.count_nonzero(langid.features(t)) for n, t in enumerate(texts) if n != 7)
    assert sent[0].num_rows == 39 and sent[0].nbytes < 4 * places
    for t in texts:
        f = langid.features(t)
        at, v = langid.unpacked(langid.packed(f))
        assert (at == np.flatnonzero(f)).all() and (v == f[f > 0]).all()
    toxicity.train(docs, spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, toxic int"), {"toxic": F.col("toxic")})
    terms = sum(len(toxicity.terms(t)) for n, t in enumerate(texts) if n != 7)
    assert sent[1].num_rows == 40 and sent[1].nbytes < 4 * terms + 1600
