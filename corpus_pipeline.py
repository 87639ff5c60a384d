"""The corpus pipeline: toxicity, language, near-duplicates, mixing, packing, each over all that the one before kept.

Each stage takes a table with the columns of ``documents`` and any others, whatever their names, and returns all of
them (packing: its pieces). An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberline.llm import langid, mixing, packing, shingles, toxicity
from emberline.llm.common import held_out, materialise
from emberline.llm.queries import categories, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go.

    Null and empty texts have no word and stay. Rows with a null id stay or go by their text; their labels are not
    learnt from. Repeated rows stay or go together. Without labels none goes.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories())
    return toxicity.keep_clean(docs, chain)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the table's own labels teach go: no letter, or unlike the rows of every language.

    Null and empty texts go. Rows with a null id stay or go by their text and are learnt from. A null language teaches
    nothing. Repeated rows stay or go together. Where no row has a language, all go.
    """
    return langid.keep_known(docs, langid.train(docs.where(~held_out("doc_id"))))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays: links are those of op4 and those of five-word shingles of similarity 0.8 or more.

    Null texts are empty, and empty texts are copies of one another. A null id comes after all others. Of repeated
    rows, and of rows of one id and text, one stays; rows of one id and different texts are rows of their own.
    """
    return shingles.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's weight asks, in a new order.

    A null source is a source; null texts are rows like others; a null id counts as an empty text in the draw;
    repeated rows are drawn alike.
    """
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, in the order of the mixture.

    A null or empty text is its end id alone; null ids stay null; repeated rows are packed each for themselves.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=MEMO)


#: Words that a Python worker remembers in the last stage; the workers hold the models of the stages before as well.
MEMO = 150_000

STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models and tokens are beyond SQL: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
