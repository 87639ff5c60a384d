"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with n rows that is to give t rows has the mean repetition rate t/n. Each row inverts the Poisson
distribution of that mean at a number drawn from a hash of its id and a seed, and is exploded by its count. A
rate above ``PART`` is drawn as the sum of equal parts, each with a seed of its own, so that no term of the
distribution underflows. The copies then go to hashed places of the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import fresh

#: Largest mean drawn at once.
PART = 16.0
#: Terms of a distribution with that mean: beyond them less than 2**-52 is left.
TERMS = 72
#: Rows of per-source statistics up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts joined by a colon; nulls read as an empty part."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """The first TERMS values of the Poisson distribution function, ascending."""
    first = F.exp(-mean)
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        (acc["c"] + acc["p"] * mean / k).alias("c"),
        F.concat(acc["a"], F.array(acc["c"] + acc["p"] * mean / k)).alias("a"),
    )
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("a"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["a"])


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, size: float = 1.0, temper: float = 0.5, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` and ``copy_no`` (from 1), ``mix_key`` (the row's place in the global shuffle, in [0, 1)).

    ``weights`` gives each source's share (scaled to sum to 1 over the sources that occur; a source without one
    goes); without ``weights`` a share is proportional to the source's rows to the power ``temper``. The expected
    number of rows is ``size`` times that of ``docs``. A null source is a source of its own, under the key None.
    Repeated rows (same id) are replicated alike; a null id counts as an empty text in the hash. Columns of
    ``docs`` named copy_no or mix_key are replaced. An empty table gives an empty table.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy_no", "mix_key")])
    key, rate, parts, cdf, count = fresh(docs, "mix_source", "mix_rate", "mix_parts", "mix_cdf", "mix_count")
    rows = docs.withColumn(key, F.struct(F.col(source_col).isNull(), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).cast("string"))
    stats = rows.groupBy(key, F.col(source_col).alias("s")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(temper))
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("s").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    total = Window.partitionBy()
    stats = stats.withColumn("w", weight)
    stats = stats.select(key, (F.col("w") / F.sum("w").over(total) * F.sum("n").over(total) * F.lit(float(size)) / F.col("n")).alias(rate)).where(F.col(rate) > 0)
    stats = stats.withColumn(parts, F.ceil(F.col(rate) / PART).cast("int"))
    stats = stats.withColumn(cdf, poisson_cdf(F.col(rate) / F.col(parts)))
    if stats.count() <= BROADCAST_SOURCES:
        stats = F.broadcast(stats)
    below = lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u))
    draws = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, k: acc + below(unit(F.lit(seed), F.lit("rate"), k, id_col)))
    drawn = rows.join(stats, key).withColumn(count, draws).where(F.col(count) > 0)
    copies = drawn.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy_no"))
    placed = copies.withColumn("mix_key", unit(F.lit(seed), F.lit("place"), id_col, "copy_no"))
    # hashed keys deal the copies out evenly; each partition then holds its rows in the order of their places
    return placed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
