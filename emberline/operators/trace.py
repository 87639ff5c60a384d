"""Where inside the origin service the request died: stages by logger, the path to the failing one, each stage's status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text as X
from emberline.operators.graph import cut
from emberline.operators.signals import error_level


def prefixes(name: str):
    """All dotted prefixes of a name, the longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def longest_prefix(names: DataFrame, known: DataFrame, name: str = "name", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., name, found, ...): the longest known dotted prefix of each name. ``known`` has ``prefix`` and what to carry.

    Prefixes are exploded and joined by equality, so nothing is compared with every known module.
    """
    tried = names.select(*keys, name).distinct().select(*keys, name, F.posexplode(prefixes(name)).alias("cut", "prefix"))
    w = Window.partitionBy(*keys, name).orderBy("cut", *(["ord"] if "ord" in known.columns else []))
    hit = tried.join(known, [*keys, "prefix"]).withColumn("n", F.row_number().over(w)).where("n = 1")
    return hit.drop("n", "cut").withColumnRenamed("prefix", "found")


def stage_of_logger(loggers: DataFrame, stages: DataFrame) -> DataFrame:
    """(service, logger, stage): by the longest module prefix, else by the logger's last part as the stage's name."""
    modules = stages.select("service", "stage", "ord", F.explode("modules").alias("prefix"))
    by_prefix = longest_prefix(loggers.where("logger <> ''"), modules, "logger", ("service",)).select("service", "logger", F.col("stage").alias("s1"))
    last = F.translate(F.element_at(F.split("logger", r"\."), -1), "_", "-")
    named = stages.select("service", F.translate("stage", "_", "-").alias("last"), "ord", "stage")
    named = named.groupBy("service", "last").agg(F.min_by("stage", "ord").alias("s2"))
    rows = loggers.where("logger <> ''").select("service", "logger").distinct().withColumn("last", last)
    found = rows.join(by_prefix, ["service", "logger"], "left").join(named, ["service", "last"], "left")
    return found.select("service", "logger", F.coalesce("s1", "s2").alias("stage")).where("stage is not null")


def entry_stages(stages: DataFrame, stage_edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(service, entry): declared, else the first stage that no edge leads to, else the first."""
    targets = stage_edges.select("service", F.col("dst").alias("stage")).distinct().withColumn("inbound", F.lit(True))
    rows = stages.join(targets, ["service", "stage"], "left")
    free = F.min(F.when(F.col("inbound").isNull(), F.struct("ord", "stage")))
    found = rows.groupBy("service").agg(F.coalesce(free, F.min(F.struct("ord", "stage")))["stage"].alias("entry"))
    if declared is None:
        return found
    d = declared.select("service", F.col("entry").alias("d"))
    return found.join(d, "service", "left").select("service", F.coalesce("d", "entry").alias("entry"))


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(service, start, node, path): a shortest path from each start to each node it reaches; of equals the first in the edges' order.

    Breadth first over all services at once; a node keeps the least sequence of edge numbers of its level.
    """
    seen = cut(starts.select("service", "start", F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<int>").alias("ords")))
    front = seen
    e = edges.select("service", "src", "dst", F.col("ord").cast("int").alias("o"))
    while True:
        step = front.join(e, (front["service"] == e["service"]) & (front["node"] == e["src"])).select(front["service"], "start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("ords", F.col("o")).alias("ords"))
        new = step.groupBy("service", "start", "node").agg(F.min_by("path", "ords").alias("path"), F.min("ords").alias("ords"))
        front = cut(new.join(seen, ["service", "start", "node"], "left_anti"))
        if front.isEmpty():
            return seen.drop("ords")
        seen = cut(seen.unionByName(front))


def trace(telemetry: DataFrame, origin: DataFrame, stages: DataFrame, stage_edges: DataFrame, look_back: float = 900) -> DataFrame:
    """(incident_key, service, stage, ord, status, detail, evidence_ids, failing): each stage of the origin's service.

    Incidents whose origin has no stages, or none that any log can be attributed to, have no row.
    """
    o = origin.select("incident_key", F.col("source").alias("service"), F.col("ts").alias("origin_ts"))
    logs = telemetry.where("source_type = 'log'").withColumn("service", F.col("source")).join(o, ["incident_key", "service"])
    logs = logs.where(X.seconds_between("ts", "origin_ts") >= -look_back).withColumn("name", X.event_logger("logger", "detail"))
    named = stage_of_logger(logs.select("service", F.col("name").alias("logger")), stages).withColumnRenamed("logger", "name")
    rows = cut(logs.join(named, ["service", "name"]).withColumn("error", error_level()).select("incident_key", "service", "stage", "ts", "seq", "id", "detail", "error"))
    order = F.struct("ts", "seq", "id", "stage", "detail")
    failing = rows.where("error").groupBy("incident_key").agg(F.min(order).alias("f")).select("incident_key", F.col("f.stage").alias("failing"), F.col("f.detail").alias("failing_detail"), F.col("f.id").alias("f_id"))
    told = rows.join(failing, "incident_key", "left").withColumn("own", ~F.col("id").eqNullSafe(F.col("f_id")))
    evidence = told.groupBy("incident_key", "service", "stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "id"))), lambda x: x["id"]).alias("ids"), F.min(F.when(F.col("own"), order))["detail"].alias("first_detail"))
    entry = entry_stages(stages, stage_edges)
    paths = shortest_paths(stage_edges, entry.select("service", F.col("entry").alias("start"))).select("service", F.col("node").alias("failing"), "path")
    inc = o.join(rows.select("incident_key").distinct(), "incident_key", "left_semi").join(failing, "incident_key", "left").join(entry, "service").join(paths, ["service", "failing"], "left")
    path = F.when(F.col("failing").isNull(), F.array().cast("array<string>")).when(F.col("path").isNotNull(), F.col("path")).otherwise(F.array("entry", "failing"))
    inc = inc.withColumn("path", path)
    after = stage_edges.select("service", F.col("src").alias("failing"), F.col("dst").alias("stage")).distinct().withColumn("behind", F.lit(True))
    out = inc.join(stages.select("service", "stage", "ord"), "service").join(evidence, ["incident_key", "service", "stage"], "left").join(after, ["service", "failing", "stage"], "left")
    on_path, has, fail = F.array_contains("path", F.col("stage")), F.col("ids").isNotNull(), F.col("stage") == F.col("failing")
    base = F.when(fail, "failed").when(has, "ok").when(on_path, "inferred").when(F.col("failing").isNotNull(), "dormant").otherwise("unknown")
    cut_off = F.coalesce("behind", F.lit(False)) & base.isin("dormant", "inferred", "unknown")
    status = F.when(cut_off, "not-reached").otherwise(base)
    detail = (
        F.when(cut_off, "never ran — the request died upstream").when(fail, F.col("failing_detail")).when(has & on_path, F.coalesce("first_detail", F.lit("reported telemetry during the traversal")))
        .when(has, F.coalesce("first_detail", F.lit(""))).when(on_path, "on the traversed path; no telemetry of its own").when(F.col("failing").isNotNull(), "not on the traced request path").otherwise("")
    )
    return out.select("incident_key", "service", "stage", "ord", status.alias("status"), detail.alias("detail"), F.coalesce("ids", F.array().cast("array<string>")).alias("evidence_ids"), "failing", "path")


def summaries(traced: DataFrame) -> DataFrame:
    """(incident_key, service, failing_stage, path, summary)."""
    one = traced.select("incident_key", "service", "failing", "path").distinct()
    hops = F.greatest(F.lit(0), F.size("path") - 1).cast("string")
    told = F.concat(F.lit("Request traced through "), hops, F.lit(" stage(s) inside "), "service", F.lit("; "), F.when(F.col("failing").isNotNull(), F.concat(F.lit("failed at "), "failing", F.lit("."))).otherwise("no failing stage attributable."))
    return one.select("incident_key", "service", F.col("failing").alias("failing_stage"), "path", told.alias("summary"))
