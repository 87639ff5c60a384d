"""The pipeline's language stage: planted texts in no learnt language go, clean documents stay."""

import random
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")

FOREIGN = [
    "Hyvää huomenta kaikille, tänään aurinko paistaa ja lapset leikkivät pihalla ennen kuin koulu alkaa kello yhdeksän",
    "Bugün hava çok güzel olduğu için çocuklar bahçede oynuyor ve öğretmenler onları pencereden gülümseyerek izliyor",
    "Dzisiaj rano poszliśmy na targ, żeby kupić świeże warzywa i owoce, ponieważ wieczorem przyjdą do nas przyjaciele",
    "Сегодня утром мы пошли на рынок, чтобы купить свежие овощи, потому что вечером придут друзья",
    "今日は天気がとても良いので、子供たちは庭で遊んでいます。先生は窓から見ています。",
]


def test_stage_rejects_what_no_language_is_like(spark):
    import corpus_pipeline

    rng = random.Random(5)
    junk = ["".join(rng.choice("qxzjkvwpy" + " " * 2) for _ in range(400)) for _ in range(5)] + ["a" * 300, "zq " * 90]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    top = docs.agg({"doc_id": "max"}).first()[0]
    planted = spark.createDataFrame([(top + 1 + n, t, None) for n, t in enumerate(FOREIGN + junk)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.union(planted), SF).select("doc_id").collect()}
    clean = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {i - top - 1 for i in kept if i > top}
    assert len(kept & clean) >= 0.999 * len(clean)
