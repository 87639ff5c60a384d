"""Token counts: Arrow functions that return lengths only.

Texts reach the library in groups of about the same number of characters, and a text longer than that is cut at
safe boundaries first, so that a task's memory is bounded whatever the lengths. No shuffle: a row's count needs
nothing but its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import tokens


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``, whole texts, in no set order.

    Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows give repeated rows; other
    columns are not read. ``tokenizer`` is the path of a vocabulary file of the tokenizers library whose tokens
    hold no white space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokens.shared(tokens.WordCounter, tokenizer)
        for batch in batches:
            n = list(counter.counts([t or "" for t in batch.column(2).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["i", "b", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(count, f"i {kind}, b long, n long")
    return out.select(F.col("i").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
