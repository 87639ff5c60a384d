"""The training-data operators against brute force, on small tables with every awkward case."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import ann, langid, lmscore, mixing, packing, records, simhash, tokencount, tokens, topk, toxicity
from emberline.llm.common import held_out

BPE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = {"i": 1, "t": "x", "fp": 2, "component": 3, "start": 4, "copy_no": 5, "mix_key": 6.0, "score": 7.0, "toxic": 1}
WORD = ["river", "stone", "green", "walks", "ofthe", "under", "light", "house", "seven", "clock", "paper", "winter"]


def prose(rng, n):
    return " ".join(rng.choice(WORD) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def awkward():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\t", "word", "two words", "A<|endoftext|>b <|startoftext|> c", "x  y\n\n z", "日本語 テキスト é́", "tab\tand\x0bfeed", "a\x01b \x01"]
    texts += [prose(rng, n) for n in (3, 10, 40, 300, 3000)]
    rows = [(n, t, "en", f"s{n % 3}", len(t or "")) for n, t in enumerate(texts)]
    return [*rows, rows[-1], (None, "no id here", None, None, None), (99, rows[-2][1], None, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def key(x):
    return (x is not None, x)


# ---------------------------------------------------------------- tokens


def library(path, text):
    return tokens.load(path).encode(text or "", add_special_tokens=False).ids


def test_piecewise_ids_are_the_librarys():
    rng = random.Random(1)
    alphabet = list("ab ,.\n\t'1é ß　\x1cÀø") + ["<|endoftext|>", "word", "Thing.", " the"]
    texts = ["", " ", " x y", "a.\nB,\nc", "don't  stop", *("".join(rng.choice(alphabet) for _ in range(50)) for _ in range(800))]
    bpe, words = tokens.ByteBpe(BPE), tokens.WordCounter(WORDS)
    for size in (1 << 20, 30):  # the second cuts each text into many
        old, tokens.CHUNK_CHARS = tokens.CHUNK_CHARS, size
        try:
            for t, ids, n in zip(texts, bpe.encode(texts), words.counts(texts), strict=True):
                assert ids.tolist() == bpe.t.encode(t, add_special_tokens=False).ids, repr(t)
                assert n == len(words.t.encode(t, add_special_tokens=False).ids), repr(t)
        finally:
            tokens.CHUNK_CHARS = old


def test_memo_is_bounded_by_bytes():
    """Texts without spaces, and long words, leave nothing behind; counts and ids are the library's all the same."""
    rng = random.Random(5)
    wide = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000)) + " und " + "q" * rng.randint(65, 400) + ". x" for _ in range(60)]
    counter, bpe = tokens.WordCounter(WORDS), tokens.ByteBpe(BPE)
    for _ in range(2):  # again, when nothing of it is remembered
        assert list(counter.counts(wide)) == [len(e.ids) for e in counter.t.encode_batch(wide, add_special_tokens=False)]
        assert [x.tolist() for x in bpe.encode(wide)] == [e.ids for e in bpe.t.encode_batch(wide, add_special_tokens=False)]
        for memo in (counter.memo, bpe.memo):
            memo.trim()
            assert memo and max(map(len, [*memo, *memo.old])) <= tokens.MEMO_CHARS


def test_memo_stays_bounded():
    m = tokens.Memo(3)
    for n in range(20):
        m.trim()
        m[n] = n
    assert len(m) <= 4 and len(m.old) <= 4 and m.promote(next(iter(m.old))) is not None


def test_token_counts(docs, empty):
    got = tokencount.token_counts(clashing(docs), WORDS, limit=5).collect()
    want = sorted(((i, len((t or "").encode()), len(library(WORDS, t))) for i, t, *_ in awkward()), key=lambda r: (key(r[0]), r[1:]))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=lambda r: (key(r[0]), r[1:])) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in got)
    assert tokencount.token_counts(empty, WORDS).count() == 0


# ---------------------------------------------------------------- packing, records


def cheapest(places, penalties, window):
    cost = {0: 0.0}
    for p, c in zip(places[1:], penalties[1:]):
        cost[p] = c + min(cost[q] + (0 if (p - q) & (p - q - 1) == 0 else window - (p - q)) for q in cost if p - q <= window)
    return cost[places[-1]]


def test_best_cuts_cost_least():
    rng = random.Random(2)
    for _ in range(60):
        places = [0]
        while len(places) < 40:
            places.append(places[-1] + rng.randint(1, 12))
        penalties = [0.0, *(rng.choice([0.0, 0.5, 2.0]) for _ in places[1:])]
        ends = packing.best_cuts(places, penalties, 32, 1)
        at = dict(zip(places, penalties))
        cost = sum(at[e] + (0 if (e - s) & (e - s - 1) == 0 else 32 - (e - s)) for s, e in zip([0, *ends], ends))
        assert ends[-1] == places[-1] and all(0 < e - s <= 32 for s, e in zip([0, *ends], ends))
        assert abs(cost - cheapest(places, penalties, 32)) < 1e-9


@pytest.mark.parametrize("buffer", [1 << 18, 300])
def test_pack_covers_every_id_once(docs, empty, buffer, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER", buffer)
    rows = packing.pack(clashing(docs).coalesce(1), BPE, window=64).collect()
    ids = [(i, [*library(BPE, t), 0]) for i, t, *_ in awkward()]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    for r in rows:
        assert any(i == r["doc_id"] and len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for i, x in ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    pad = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
        pad += 0 if at & (at - 1) == 0 else 64 - at
    assert pad < 0.1 * sum(len(x) for _, x in ids)
    assert packing.pack(empty, BPE).count() == 0


def test_records_round_trip(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/out"
    files = records.write_records(clashing(docs), path, BPE, partitions=3).collect()
    got = records.read_records(spark, path).orderBy("start").collect()
    want = sorted(((i, [*library(BPE, t), 0]) for i, t, *_ in awkward()), key=lambda r: key(r[0]))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((key(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    f = max(files, key=lambda r: r["records"])["file"]
    for entry in records.read_index(path, f)[::-1]:
        assert records.read_at(path, f, int(entry["offset"]))[0] == entry["id"]
    raw = bytearray((tmp_path / "out" / f"{f}.rec").read_bytes())
    raw[30] ^= 1
    (tmp_path / "out" / f"{f}.rec").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, path).collect()
    with pytest.raises(ValueError, match="2 bytes"):
        records.write_records(docs, f"file://{tmp_path}/wide", BPE, end_id=70_000, width=2)
    wide = f"file://{tmp_path}/wide"
    records.write_records(docs, wide, BPE, end_id=70_000, partitions=2)  # four bytes
    crc = lambda t: zlib.crc32(np.array([*library(BPE, t), 70_000], "<u4").tobytes())
    assert sorted(r["ids_crc32"] for r in records.read_records(spark, wide).collect()) == sorted(crc(t) for _, t, *_ in awkward())
    with pytest.raises(ValueError, match="white space"):
        tokens.WordCounter(BPE)
    none = f"file://{tmp_path}/none"
    assert records.write_records(empty, none, BPE).count() == 0 and records.read_records(spark, none).count() == 0


# ---------------------------------------------------------------- mixing


def test_mix_follows_the_weights(spark, empty):
    rows = [(n, f"t{n}", "en", "a" if n % 3 else ("b" if n % 2 else None), 1) for n in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(clashing(df), {"a": 1.0, "b": 1.0, None: 2.0}, size=2.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 3000) < 250 and abs(n[None] - 6000) < 350
    assert out.count() == out.select("doc_id", "copy_no").distinct().count()
    assert sorted(map(tuple, mixing.mix(df, {"a": 1.0}).select("doc_id", "copy_no").collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), {"a": 1.0}).select("doc_id", "copy_no").collect()))
    assert mixing.mix(df, {"a": 1.0}).where("source <> 'a' or source is null").count() == 0
    assert mixing.mix(empty).count() == 0


def test_mix_draws_a_poisson_number(spark):
    """A rate beyond one part too: counts have the mean and the variance of the distribution."""
    df = spark.createDataFrame([(n, "", "", "a", 0) for n in range(3000)], DOCS)
    n = [r["count"] for r in mixing.mix(df, {"a": 1.0}, size=40.0).groupBy("doc_id").count().collect()]
    assert abs(np.mean(n) - 40) < 0.5 and abs(np.var(n) - 40) < 4


def test_mix_takes_nulls_and_repeats(docs):
    """Null ids, texts and sources are rows like others, and repeated rows are drawn alike."""
    rows = awkward()
    n = {}
    for r in mixing.mix(docs, size=6.0).collect():
        n[r["doc_id"], r["text"]] = n.get((r["doc_id"], r["text"]), 0) + 1
    assert set(n) <= {(i, t) for i, t, *_ in rows} and len(n) > len(rows) - 4
    assert all(k % 2 == 0 for (i, _), k in n.items() if i == rows[-4][0])  # it stands twice
    assert (None, "no id here") in n and (0, None) in n


# ---------------------------------------------------------------- near-duplicates


def plain_fingerprint(text):
    words, w = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, w = [*words, w] if w else words, ""
        else:
            w += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[n : n + 3]) for n in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=2):
    label = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if label[b] > label[a] and bin(fps[a] ^ fps[b]).count("1") <= radius:
                    label[b], moved = label[a], True
    return label


def test_near_duplicates(docs, empty):
    rows = awkward()
    got = simhash.near_duplicates(clashing(docs)).select("doc_id", simhash.hexadecimal("fp").alias("f"), "component").collect()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = groups(fps)
    least = {c: min((rows[n][0] for n in range(len(rows)) if label[n] == c and rows[n][0] is not None), default=None) for c in label}
    assert sorted((key(r["doc_id"]), r["f"], key(r["component"])) for r in got) == sorted((key(r[0]), f"{fps[n]:016x}", key(least[label[n]])) for n, r in enumerate(rows))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(clashing(docs))
    assert kept.count() == len(set(label)) and set(kept.columns) == {*docs.columns, *CLASH}


def test_fingerprint_of_a_long_text():
    rng = random.Random(11)
    text = " ".join(rng.choice(WORD) + str(rng.randrange(50)) for _ in range(70_000))  # more shingles than are hashed at once
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_of_large_groups(spark, monkeypatch):
    """Chains, dense groups over several tiles, and pairs just beyond the radius."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(100)}
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    x = rng.getrandbits(64)
    for _ in range(60):  # a chain
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r["node"] % (1 << 64): r["label"] % (1 << 64) for r in simhash.components(simhash.links(df)).collect()}
    label = groups(fps)
    sets = lambda of: sorted(sorted(n for n in fps if of(n) == c) for c in {of(n) for n in fps})
    assert sets(lambda f: found.get(f, f)) == sets(lambda f: fps[label[fps.index(f)]])


# ---------------------------------------------------------------- vectors


def vectors(rng, n=700, d=12):
    x = rng.normal(size=(n, d)).astype("f4")
    x[200:420] = x[200]  # a third of all are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [float("nan")] * d), (5002, [float("inf")] * d), (5003, [None] * d), (None, [1.0] * d), (5050, [1.0, 2.0]), (5100, [0.0] * d), rows[0], rows[200]]
    return rows, bad


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    rows, bad = vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("query", F.lit("x"))
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0).collect()
    full = dict(rows) | {5100: [0.0] * 12}
    q = {i: np.floor(256 * np.array(v, "f4").astype(float)).astype(int) for i, v in full.items()}
    want = []
    for i in sorted(q):
        if i % 10 == 0:
            best = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.exact_top_k(df.where("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(600, 3)) * 50)
    tree = topk.KdTree(x, 8)
    for q in np.floor(rng.normal(size=(30, 3)) * 50):
        rows, scores = tree.search(q, tree.bounds(q[None])[0], 4, -np.inf)
        assert sorted(scores)[::-1][:4] == sorted(x @ q)[::-1][:4] and len(rows) < 200


def test_approximate_neighbours(spark):
    rows, bad = vectors(np.random.default_rng(2), 900, 16)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    got = ann.approximate_neighbours(df, F.col("vec_id") % 9 == 0, k=10).collect()
    full = {i: np.array(v, "f4").astype(float) for i, v in rows}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = 0
    for i in (i for i in full if i % 9 == 0):
        found = sorted(by[i], key=lambda r: r["rank"])
        best = sorted((-float(full[i] @ v), j) for j, v in full.items() if j != i)[:10]
        hits += len({r["vec_id"] for r in found} & {j for _, j in best})
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(abs(r["score"] - float(full[i] @ full[r["vec_id"]])) < 1e-9 for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
    assert hits / (10 * len(by)) >= 0.9 and set(by) == {i for i in full if i % 9 == 0}
    assert ann.approximate_neighbours(df.limit(0), F.lit(True)).count() == 0
    few = ann.approximate_neighbours(df.where("vec_id in (1, 2, 3)"), F.lit(True), k=10)
    assert sorted((r["query_id"], r["rank"]) for r in few.collect()) == [(q, n) for q in (1, 2, 3) for n in (1, 2)]


# ---------------------------------------------------------------- models

TEXTS = {
    "en": "the house of the winter was under the light and there is nothing that they would not have".split(),
    "de": "das haus und der winter waren unter dem licht aber nicht ohne eine sache die sich findet".split(),
    "fr": "la maison et les hivers étaient sous une lumière mais il ne faut pas que cela soit".split(),
    "es": "la casa y los inviernos estaban bajo una luz pero no hay nada que ellos quieran hacer".split(),
}


def corpus(n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = list(TEXTS)[i % 4]
        rows.append((i, " ".join(rng.choice(TEXTS[lang]) for _ in range(rng.randint(8, 60))), lang, "s", 1))
    return rows


def test_language_held_out(spark, empty):
    rows = corpus() + [(1000, None, "en", "s", 0), (1001, "123 !?", "en", "s", 0), (1002, "", None, "s", 0), (None, "the house", None, "s", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: r for r in langid.identify(df, ~held_out("doc_id")).collect()}
    out = [i for i, *_ in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in out]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002)) and len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r["lang_pred"] for r in nothing] == ["und"]
    kept = langid.keep_known(df, langid.train(df))
    assert kept.where("doc_id in (1000, 1001, 1002)").count() == 0 and kept.where("doc_id < 1000").count() == 240


def plain_features(text):
    raw = b" " + b" ".join(bytes(c if c > 127 or chr(c).isalpha() else 32 for c in text.lower().encode()).split()) + b" "
    counts = {}
    for size, salt in ((2, 0x5BD1E995), (3, 0), (4, 0x27D4EB2F)):
        for n in range(len(raw) - size + 1):
            at = ((int.from_bytes(raw[n : n + size], "little") ^ salt) * 2654435761 % (1 << 32)) >> 17
            counts[at] = counts.get(at, 0) + 1
    total = sum(counts.values()) ** 0.5
    return {at: n**0.5 / total for at, n in counts.items()}


def test_features_of_a_long_text():
    rng = random.Random(12)
    text = " ".join(rng.choice(TEXTS["fr"] + ["x1\n", "日本", "..."]) for _ in range(70_000))  # over one slice
    got, want = langid.features(text), plain_features(text)
    assert len(text) > langid.SLICE and set(np.flatnonzero(got)) == set(want) and all(abs(got[at] - v) < 1e-4 for at, v in want.items())


def test_language_prediction_by_plain_loops(spark):
    """Family by the largest margin, then a vote of the duels within it, on a fitted model."""
    rows = corpus(160)
    df = spark.createDataFrame([*rows, rows[0], (900, "hwxt qq licht maison", None, None, None)], DOCS)
    model = langid.train(df)
    sure = lambda m: 1 / (1 + np.exp(-2 * max(-30, min(30, m))))
    for r in langid.predict(df, model).collect():
        f = plain_features(next(t for i, t, *_ in [*rows, (900, "hwxt qq licht maison")] if i == r["doc_id"]))
        margin = [sum(float(w[at]) * v for at, v in f.items()) + float(w[-1]) for w in model.weights]
        families = margin[: len(model.families)]
        best = max(range(len(families)), key=lambda n: families[n])
        votes = {m: [0, 0.0] for m in model.members[best]}
        duels = list(zip(model.pairs, margin[len(model.families) :]))
        for (a, b), m in duels:
            if a in votes:
                won = votes[a if m > 0 else b]
                won[0] += 1
                won[1] += abs(m)
        chosen = max(votes, key=lambda n: (votes[n], -n))
        own = [m if a == chosen else -m for (a, b), m in duels if chosen in (a, b)]
        assert r["lang_pred"] == model.languages[chosen]
        assert abs(r["score"] - sure(families[best]) * (sure(min(own)) if own else 1)) < 1e-3


def test_every_language_is_learnt(spark):
    """More languages than a few dozen, each with few rows."""
    alphabets = {f"l{n:02}": "".join(random.Random(n).sample("abcdefghijklmnopqrstuvwxyz", 9)) for n in range(80)}
    rng = random.Random(1)
    rows = [(n * 100 + k, " ".join("".join(rng.choices(a, k=5)) for _ in range(30)), l, "s", 1) for n, (l, a) in enumerate(alphabets.items()) for k in range(4)]
    assert langid.train(spark.createDataFrame(rows, DOCS), per_language=3).languages == sorted(alphabets)


def test_toxicity_prediction_by_plain_loops(spark):
    rng = random.Random(13)
    texts = [" ".join([rng.choice(WORD) for _ in range(30)] + ["idiot"] * (n % 3 == 0) + ["|||"] * (n % 4 == 0)) for n in range(200)] + [None, "", "idiot " * 200_000]
    docs = spark.createDataFrame([(n, t, None, None, None) for n, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(n, int(n % 4 > 0), int(n % 3 == 0)) for n in range(200)], "doc_id long, quality int, toxic int")
    by = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.train(docs, labels, by)
    for r in toxicity.predict(docs, chain, list(by)).collect():
        found, earlier = {zlib.crc32(w.encode()) for w in toxicity.WORD.findall((texts[r["doc_id"]] or "").lower())}, []
        for link in chain.links:
            n = len(link.words)
            z = float(link.w[-1]) + sum(float(link.w[k]) for k in range(n) if int(link.words[k]) in found) + sum(float(link.w[n + k]) * p for k, p in enumerate(earlier))
            earlier.append(1 / (1 + np.exp(-max(-30, min(30, z)))))
        assert [r["prob_low_quality"], r["prob_toxic"]] == pytest.approx(earlier, abs=1e-9) and r["toxic"] == (earlier[-1] >= chain.threshold)


def test_toxicity_held_out(spark, empty):
    rng = random.Random(10)
    rows, marks = [], []
    for i in range(400):
        bad, junk = i % 5 == 0, i % 7 == 0
        words = [rng.choice(WORD) for _ in range(rng.randint(10, 80))] + (["idiot", "scum"] if bad else []) + (["|||"] * 3 if junk else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        if i < 300:
            marks.append((i, int(not junk), int(bad)))
    marks += [marks[0], (None, 1, 1), (3, None, None), (9999, 1, 1)]
    docs = clashing(spark.createDataFrame([*rows, (500, None, None, None, None), (501, "", None, None, None)], DOCS))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    by = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.train(docs, labels, by)
    got = {r["doc_id"]: r for r in toxicity.predict(docs, chain, list(by)).collect()}
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in range(300, 400)) and not got[500]["toxic"] and not got[501]["toxic"]
    assert all(0 <= got[i]["prob_low_quality"] <= 1 for i in got)
    assert toxicity.keep_clean(docs, chain).where("doc_id < 400 and doc_id % 5 = 0").count() == 0
    nothing = toxicity.train(docs, labels.limit(0), by)
    assert toxicity.predict(docs, nothing, list(by)).where("toxic").count() == 0 and toxicity.predict(empty, chain, list(by)).count() == 0


@pytest.mark.parametrize("hot", [0, 2, 512])
def test_score_equals_counts_by_hand(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(lmscore, "RANGE_TOKENS", 20)
    rng = random.Random(4)
    rows = [(0, "a b a b", "", "", 0), (1, "a c", "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0), (4, "zzz a", "", "", 0), (None, "b", "", "", 0), (4, "zzz a", "", "", 0)]
    rows += [(n, " ".join(rng.choices(["a", "b", "zzz", "c", "d", "e"], [9, 7, 5, 1, 1, 1], k=rng.randint(1, 40))), "", "", 0) for n in range(10, 60)]
    target = {0, *range(10, 30)}
    df = clashing(spark.createDataFrame(rows, DOCS))
    named = spark.createDataFrame([(i,) for i in (*target, 0, None)], "k long")
    got = lmscore.score(df, named, 3, hot).collect()
    vocabulary = ["a", "b", "zzz"]

    def model(texts):
        ids = [[vocabulary.index(w) if w in vocabulary else 3 for w in t.split()] for t in texts if t]
        uni, pair = np.zeros(4), {}
        for x in ids:
            for a, b in zip([4, *x], x):
                uni[b] += 1
                pair[a, b] = pair.get((a, b), 0) + 1
        before, total = [*uni, len(ids)], max(1, uni.sum())
        rest = (1 - lmscore.BIGRAM - lmscore.UNIGRAM) / 4

        def loss(a, b):
            if 3 in (a, b):
                return -np.log((lmscore.BIGRAM + lmscore.UNIGRAM) * uni[b] / total + rest)
            return -np.log(lmscore.BIGRAM * pair.get((a, b), 0) / max(1, before[a]) + lmscore.UNIGRAM * uni[b] / total + rest)

        return loss

    mine, ground = model([r[1] for r in rows if r[0] in target]), model([r[1] for r in rows])
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"])
        x = [vocabulary.index(w) if w in vocabulary else 3 for w in (text or "").split()]
        assert r["n_tokens"] == len(x)
        if not x:
            assert r["difference"] is None
            continue
        for m, c in ((mine, "loss_target"), (ground, "loss_background")):
            assert abs(r[c] - np.mean([m(a, b) for a, b in zip([4, *x], x)])) < 1e-4
    assert sorted(key(r["doc_id"]) for r in got) == sorted(key(r[0]) for r in rows)
    if not hot:
        monkeypatch.setattr(lmscore, "BROADCAST_IDS", 3)  # by a shuffle
        again = {r["doc_id"]: r["difference"] for r in lmscore.score(df, named, 3, hot).collect()}
        assert all(again[r["doc_id"]] == pytest.approx(r["difference"], abs=1e-5) for r in got)
        assert lmscore.score(docs, spark.createDataFrame([], "k long")).count() == len(awkward())
        assert lmscore.score(empty, spark.createDataFrame([], "k long")).count() == 0
