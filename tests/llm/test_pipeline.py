"""The pipeline: every stage's decisions take effect, and clean documents stay."""

import random

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


def test_stages(spark):
    import corpus_pipeline
    from emberline.llm import simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.materialise(stage(spark, seen, SF), name)
        assert seen.columns == columns
        counts.append(seen.count())
        if name == "simhash_near_dedup":
            assert simhash.near_duplicates(seen).where("doc_id <> component").count() == 0
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity_stage(spark, docs, SF).collect()}
    assert counts[1] < counts[0] and 0.99 * counts[1] <= counts[2] <= counts[1] and counts[3] < counts[2]
    assert len(kept - toxic) >= 0.95 * counts[0] - len(toxic)
    pieces = corpus_pipeline.packing_stage(spark, seen, SF)
    assert pieces.selectExpr("sum(length) n").first()["n"] == pieces.where("start = 0").selectExpr("sum(doc_tokens) n").first()["n"]


WORDS = {
    "en": "the house of the winter was under the light and there is nothing that they would not have".split(),
    "de": "das haus und der winter waren unter dem licht aber nicht ohne eine sache die sich findet".split(),
}


def test_stages_take_awkward_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty texts, ties, repeated rows, clashing names, a foreign and a toxic text, an empty table."""
    import corpus_pipeline

    rng = random.Random(6)
    rows = []
    for n in range(300):
        lang, bad = ("en", "de")[n % 2], n % 5 == 0
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randint(30, 60))] + ["idiot", "scum"] * bad
        rng.shuffle(words)
        rows.append((n, " ".join(words), lang, f"s{n % 3}", 1))
    clean = [r for r in rows if r[0] % 5]
    extra = [
        (1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, " \n", "en", None, 3), (1003, "123 !?", None, "s1", 0),
        (1004, "Сегодня утром мы пошли на рынок, чтобы купить свежие овощи, потому что вечером придут друзья", None, "s1", 1),
        clean[0], clean[0], (None, clean[1][1], "de", "s1", 1), (None, clean[2][1], None, None, None), (clean[3][0], clean[4][1] + " nacht", "de", "s1", 1),
    ]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS fp", "2 AS component", "'x' AS t", "3 AS i", "4 AS copy_no", "5 AS k", "6 AS keep_id", "7 AS node", "8 AS n", "9 AS label", "10 AS toxic")
    spark.createDataFrame([(n, 1, int(n % 5 == 0)) for n in range(200)] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs if name in ("toxicity", "language_id") else seen["documents"], str(tmp_path))
        if name != "packing":
            assert [c for c in out.columns if c != "copy_no"] == [c for c in docs.columns if c != "copy_no"]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        seen[name] = out
    of = lambda name: [(r["doc_id"], r["text"]) for r in seen[name].collect()]
    kept = of("toxicity")
    assert all(r[:2] in kept for r in extra) and not [i for i, _ in kept if i is not None and i < 300 and i % 5 == 0]
    assert kept.count(clean[0][:2]) == 3
    kept = of("language_id")
    assert not {1000, 1001, 1002, 1003, 1004} & {i for i, _ in kept} and all(r[:2] in kept for r in clean) and kept.count(clean[0][:2]) == 3
    assert (None, clean[1][1]) in kept and (None, clean[2][1]) in kept
    kept = of("simhash_near_dedup")
    assert kept.count(clean[0][:2]) == 1 and [i for i in (1000, 1001, 1002) if i in {k for k, _ in kept}] == [1000]
    assert not [i for i, _ in kept if i is None]  # copies of rows with an id
    n = {}
    for i, t in of("mixing"):
        n[i, t] = n.get((i, t), 0) + 1
    assert n.get(clean[0][:2], 0) % 3 == 0  # repeated rows are drawn alike
    pieces = seen["packing"].collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert sum(r["start"] == 0 for r in pieces) == len(rows) + len(extra)
    assert [r["length"] for r in pieces if r["doc_id"] == 1000] == [1]
