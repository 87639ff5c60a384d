"""What both vector searches share: which vectors take part, copies folded to one, answers joined back to queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finite(vec: str):
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: an id, and only finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & finite("vec"))


def usual_length(rows: DataFrame) -> int:
    """The most frequent vector length, the smaller of equals; 0 for an empty table."""
    found = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return found[0]["d"] if found else 0


def fold(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): each different vector once, with the ``keep`` smallest of its ids, ascending.

    With keep = k + 1 no answer of k is lost: equal vectors score alike and ties go to the smaller id, so a
    query can use at most k of them and its own.
    """
    w = Window.partitionBy("vec").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def answer(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``found`` (query, vec_id, score) and ``asked`` (query, query_id)."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    joined = asked.join(best, "query")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    flat = joined.select("query_id", F.posexplode(own).alias("at", "hit"))
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
