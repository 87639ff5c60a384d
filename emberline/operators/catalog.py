"""Catalog entries: read from JSON lines, enriched with URLs, looked up, summed up from reports and manifests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The files of one incident's bundle (fixed values).
BUNDLE_FILES = ["analysis.json", "briefing.txt", "graph.mmd", "narration.genblaze.json", "poster.jpg", "provenance.genblaze.json", "replay.mp4"]


def entries(rows: DataFrame, value: str, *keep: str) -> DataFrame:
    """(keep..., prefix, lang, n) of the rows whose ``value`` is a JSON object; blank and malformed ones go."""
    v = F.try_parse_json(F.trim(value))
    good = rows.withColumn("v", v).where(F.col("v").isNotNull())
    get = lambda k, t: F.try_variant_get("v", f"$.{k}", t).alias(k)
    return good.select(*keep, get("prefix", "string"), get("lang", "string"), get("n", "bigint"))


def with_urls(catalog: DataFrame, base: str) -> DataFrame:
    """``catalog`` with the URLs of its prefix, and a map of the bundle's files."""
    url = lambda name: F.concat_ws("/", F.lit(base), "prefix", F.lit(name))
    files = F.map_from_arrays(F.array(*map(F.lit, BUNDLE_FILES)), F.array(*map(url, BUNDLE_FILES)))
    return catalog.withColumns({"poster_url": url("poster.jpg"), "video_url": url("replay.mp4"), "files": files})


def find(catalog: DataFrame, prefix: str) -> DataFrame:
    return catalog.where(F.col("prefix") == prefix).limit(1)


def facts(fact: DataFrame, hypotheses: DataFrame, gaps: DataFrame) -> DataFrame:
    """(incident_key, leading_confidence, evidence_count, statuses, gap_count)."""
    h = hypotheses.groupBy("incident_key").agg(F.max("confidence").alias("leading_confidence"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "status"))), lambda x: x["status"]).alias("statuses"))
    g = gaps.groupBy("incident_key").agg(F.count(F.lit(1)).alias("gap_count"))
    return fact.select("incident_key", F.col("n_events").alias("evidence_count")).join(h, "incident_key").join(g, "incident_key", "left").fillna(0, ["gap_count"])


def manifest_summary(manifests: DataFrame, key: str, steps: str, sets: Mapping[str, str]) -> DataFrame:
    """(key, step_count, sets...): how many steps a manifest has, and the sorted different values of some of their fields, none of them null or empty."""
    distinct = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(steps, lambda s: s[f]), lambda v: F.coalesce(v != "", F.lit(False)))))
    return manifests.select(key, F.size(steps).cast("long").alias("step_count"), *(distinct(f).alias(name) for name, f in sets.items()))
