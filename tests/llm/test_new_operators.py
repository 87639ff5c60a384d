"""Hard negatives, the Merkle manifest and the quality classifier against brute force, with every awkward case."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import hardneg, merkle, wordvec
from emberline.llm.common import held_out
from tests.llm.test_operators import CLASH, DOCS, awkward, clashing, prose

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows, anchors, positives, negatives):
    """The contract by plain loops, over different (id, label, vector)."""
    rows = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows}
    out = []
    for a, lab, v in rows:
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            fit = sorted(x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n, d, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.4))) for x in c], rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("shard_rows,cell_rows,d", [(4096, 64, 6), (40, 4, 6), (25, 200, 5), (60, 8, 1)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard_rows, cell_rows, d):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hardneg, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(hardneg, "LOOK_ROWS", 16)
    rows = vectors(d, 240, d)
    rows += [(1000 + n, rows[3][1], rows[3][2]) for n in range(40)]  # one vector and label very often
    rows += [(1100 + n, rows[3][1], n % 3) for n in range(20)]
    rows += [rows[10], (10, rows[11][1], 2), (2000, [0.0] * d, 1)]  # a repeated row, one id with two vectors, no length
    odd = [(3000, None, 1), (None, rows[0][1], 1), (3001, rows[0][1], None), (3002, [float("nan")] * d, 1), (3003, [None] * d, 2), (3004, [1.0] * (d + 1), 2), (3005, [float("inf")] * d, 0)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumns({k: F.lit(v) for k, v in CLASH.items()}).withColumns({k: F.lit(9) for k in ("query", "marks", "shard", "own", "vec")})
    got = hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda a: a % 10 == 0, 5, 3)


def test_hard_negatives_of_few_rows(spark):
    rows = vectors(2, 12, 3)
    df = spark.createDataFrame(rows, VECTORS)
    got = hardneg.hard_negatives(df, F.lit(True), F.col("label"), positives=2, negatives=4, low=50, high=95)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda a: True, 2, 4)
    none = spark.createDataFrame([], VECTORS)
    assert hardneg.hard_negatives(none, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    alone = spark.createDataFrame([(50, [1.0, 2.0], 1)], VECTORS)
    assert hardneg.hard_negatives(alone, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    long = hardneg.hard_negatives(df.unionByName(spark.createDataFrame([(90, [1.0, 2.0], 1)], VECTORS)), F.lit(True), F.col("label"), length=2)
    assert long.count() == 0


def test_cells_are_visited_by_falling_bounds_that_hold():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(300, 8)) * 100)
    index = hardneg.Index((hardneg.codebook(points[:, :4], 6), hardneg.codebook(points[:, 4:], 5)))
    i, j = hardneg.nearest(points[:, :4], index.centres[0]), hardneg.nearest(points[:, 4:], index.centres[1])
    index.radii = tuple(np.array([np.linalg.norm(half[own == c] - centres[c], axis=1).max(initial=0) for c in range(len(centres))]) for half, own, centres in zip((points[:, :4], points[:, 4:]), (i, j), index.centres))
    shard = hardneg.Shard(index, points, np.zeros(300, int), [[n] for n in range(300)], i, j)
    asked = np.floor(rng.normal(size=(10, 8)) * 100)
    ups, lows = index.bounds(asked), index.bounds(asked, -1)
    for n, q in enumerate(asked):
        seen = list(shard.visits((ups[0][n], ups[1][n])))
        assert len({v[1:] for v in seen}) == len(seen) == len(set(i)) * len(set(j))
        assert all(a[0] >= b[0] - 1e-6 for a, b in zip(seen, seen[1:]))
        for bound, a, b in seen:
            s = points[(i == a) & (j == b)] @ q
            assert (s <= bound).all() and (s >= lows[0][n, a] + lows[1][n, b]).all()


# ---------------------------------------------------------------- Merkle manifest


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, more=0):
    i, text, lang, source, n = r
    values = [i, source, lang, None if n is None else n + more, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][n : n + 2])) for n in range(0, len(levels[-1]), 2)])
    return levels


def by_hand(rows, touched):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))]) for g in names}
    crown = climb([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for n, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))):
            proof, folded = "", leaf_of(r, 1 if touched(r) else 0)
            for levels, k in ((trees[g], n), (crown, at)):
                for level in levels[:-1]:
                    other = level[k ^ 1] if k ^ 1 < len(level) else ""
                    proof, folded, k = proof + other, digest(other + folded if k & 1 else folded + other), k >> 1
            out.append((r[0], leaf_of(r), trees[g][-1][0], crown[-1][0], digest(proof), folded))
    return Counter(out)


def manifest_rows(df):
    touched = F.col("doc_id") % 7 == 0
    found = merkle.manifest(df, claimed={"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(), 256), merkle.folded(F.col("claimed_leaf")))
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("levels", [10, 2, 1])
def test_manifest_equals_a_tree_by_hand(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SLOTS", 1 << levels)
    rng = random.Random(levels)
    rows = [(n * 3 - 50, f"t{n}", rng.choice(["de", "en", None, "", "é", "z"]), "s", n) for n in range(150)]
    rows += [(rng.randint(-(1 << 62), 1 << 62), "far", rng.choice(["en", "de"]), None, None) for _ in range(40)]
    rows += [(7, f"same id {n % 9}", "en", "s", 1) for n in range(30)] + [(None, f"no id {n % 5}", "en", "s", None) for n in range(13)] + [((1 << 63) - 1, "last", "en", "s", 0), (-(1 << 63), "first", "en", "s", 0)]
    rows += [(70, "", "alone", "s", 0), (71, None, "two", None, 0), (72, "x" * 200_000, "two", "s", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS)).withColumns({k: F.lit(1) for k in ("g", "id", "leaf", "at", "n", "chunk")})
    assert manifest_rows(df.repartition(5)) == by_hand(rows, lambda r: r[0] is not None and r[0] % 7 == 0)


def test_manifest_of_awkward_and_of_no_rows(spark):
    assert manifest_rows(clashing(spark.createDataFrame(awkward(), DOCS))) == by_hand(awkward(), lambda r: r[0] is not None and r[0] % 7 == 0)
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(5, "a", "en", "s", 1)], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["steps"] == [] and one["place"] == 0 and one["claimed_leaf"] is None


# ---------------------------------------------------------------- quality


def test_context_vectors_equal_a_plain_count(spark):
    rng = random.Random(8)
    texts = [None, "", "one", *(prose(rng, rng.randint(1, 60)) for _ in range(40))]
    df = clashing(spark.createDataFrame([(n, t, None, None, None) for n, t in enumerate(texts)], DOCS)).repartition(3)
    words = ["river", "stone", "green", ".", "neverseen"]
    vocabulary = np.array(sorted(wordvec.code(w) for w in words), np.uint32)
    got = wordvec.contexts(df, vocabulary)
    wanted = {wordvec.code(w): np.zeros(wordvec.SIZE, int) for w in words}
    for t in texts:
        terms = [wordvec.code(w) for w in wordvec.terms_of((t or "").lower())]
        for n, h in enumerate(terms):
            for m in (*range(max(0, n - wordvec.REACH), n), *range(n + 1, min(len(terms), n + wordvec.REACH + 1))):
                if h in wanted:
                    place, sign = wordvec.index_entries(np.array([terms[m]], np.uint32))
                    np.add.at(wanted[h], place[0], sign[0])
    assert np.array_equal(got, np.array([wanted[h] for h in vocabulary]))
    assert not got[np.searchsorted(vocabulary, wordvec.code("neverseen"))].any() and got.any()


def test_shapes_and_terms():
    terms = wordvec.terms_of("One one ONE 12 *** a_b aB")
    assert terms == ["One", "one", "ONE", "12", "***", "a", "_", "b", "aB"]
    assert [wordvec.SHAPES[wordvec.shape(t)] for t in terms] == ["title", "lower", "upper", "digit", "sign", "lower", "sign", "lower", "mixed"]
    assert wordvec.terms_of(None) == []


def test_pooled_vectors_equal_plain_sums():
    rng = random.Random(6)
    texts = ["One one one ONE ** ** x", None, "", "***", "river stone", *(prose(rng, rng.randint(1, 200)) for _ in range(90))]
    vocabulary = np.array(sorted(wordvec.code(w) for w in ("river", "one", ".", "stone")), np.uint32)
    model = wordvec.Model(vocabulary, np.random.default_rng(1).normal(size=(4, wordvec.SIZE)).astype(np.float32))

    def vector(term):
        h = np.array([wordvec.code(term.lower())], np.uint32)
        at = np.flatnonzero(vocabulary == h)
        return wordvec.index_vectors(h)[0] + (model.vectors[at[0]] if len(at) else 0)

    for text, got in zip(texts, model.features(texts)):
        terms = wordvec.terms_of(text)
        marks = [len(wordvec.SHAPES) - 1 if n and t == terms[n - 1] else wordvec.shape(t) for n, t in enumerate(terms)]
        words, signs = ([t for t in terms if t[0].isalnum() == k] for k in (True, False))
        one = sum((vector(t) for t in words), np.zeros(wordvec.SIZE)) / max(1, len(words))
        two = (sum((vector(t) for t in signs), np.zeros(wordvec.SIZE)) + sum((wordvec.MARKS[m] for m in marks), np.zeros(wordvec.SIZE))) / max(1, len(signs) + len(marks))
        assert np.allclose(got, np.concatenate((one, two)), atol=1e-4)


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = wordvec.Network(np.zeros(4), np.ones(4), np.eye(4) * 1e-3, np.zeros(4), np.array([1e4, 0, 0, 0]), 0.0)  # five times too sure
    t = wordvec.calibrate(net, x, y)
    assert 4 < t < 6.5 and wordvec.calibrate(net, x[:0], y[:0]) == 1.0


def quality_rows():
    rng = random.Random(9)
    rows, labels = [], []
    for n in range(600):
        text, good = prose(rng, rng.randint(5, 80)), n % 4 != 0
        rows.append((n, text if good else rng.choice([text.upper() + "!!", " | ".join(text.split()), " ".join(w for w in text.split() for _ in range(4))]), "en", "s", 0))
        labels.append((n, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (labels[0])], "doc_id long, quality int")
    model = wordvec.train(docs, marks, ~held_out("doc_id"), F.col("quality"))
    got = {r["doc_id"]: r for r in wordvec.score(docs, model).withColumn("held", held_out("doc_id")).collect()}
    apart = [(r["score"] >= 0.7) == bool(y) for (i, y) in labels if (r := got[i])["held"]]
    assert len(got) == 600 and len(apart) > 100 and np.mean(apart) > 0.95
    # labels of held-out rows teach nothing: with them turned round the model is the same
    turned = marks.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = wordvec.train(docs, turned, ~held_out("doc_id"), F.col("quality"))
    assert {r["doc_id"]: r["score"] for r in wordvec.score(docs, again).collect()} == {i: r["score"] for i, r in got.items()}
    odd = awkward()
    scored = wordvec.score(clashing(spark.createDataFrame(odd, DOCS)), model).collect()
    assert len(scored) == len(odd) and all(0 <= r["score"] <= 1 for r in scored)
    assert wordvec.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_quality_without_labels_or_of_one_kind(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    none = wordvec.train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True), F.col("quality"))
    assert {r["score"] for r in wordvec.score(docs, none).collect()} == {0.5}
    ones = wordvec.train(docs, spark.createDataFrame([(n, 1) for n in range(8)], "doc_id long, quality int"), F.lit(True), F.col("quality"))
    assert {r["score"] for r in wordvec.score(docs, ones).collect()} == {0.9}
    wordvec.train(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True), F.col("quality"))
