"""From telemetry to failure signals: anomalies, classification, one signal for each service, the origin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text as X


@dataclass(frozen=True)
class Settings:
    """Thresholds in seconds; the defaults fit incidents of minutes."""

    fold: float = 90
    near: float = 300
    mid: float = 900
    look_back: float = 7200


def single_point(name: Column, value: Column) -> Column:
    """Why a metric with one sample is an anomaly, or null."""
    return (
        F.when(X.has_any(name, ["error", "fail", "retr", "auth"]) & (value >= 10), "elevated")
        .when(X.has_any(name, ["utilization", "saturation"]) & (value >= 95), "saturated")
        .when(X.has_any(name, ["depth", "backlog", "queue"]) & (value >= 1000), "backlog above threshold")
        .when(X.has_any(name, ["latency", "p95", "p99"]) & (value >= 1000), "elevated latency")
    )


def metric_points(telemetry: DataFrame) -> DataFrame:
    points = telemetry.where("source_type = 'metric'").withColumns({"name": X.metric_name("metric", "detail"), "v": X.metric_value("value", "detail")})
    return points.where("v is not null")


def anomalies(telemetry: DataFrame) -> DataFrame:
    """(incident_key, seq, id, source, ts, name, v, baseline, description, recovered, unit, series_ts, series_seq).

    All windows share one partitioning by series, so there is one exchange; each series is compared with its first value.
    """
    series = Window.partitionBy("incident_key", "source", "name")
    by_time = series.orderBy("ts", "seq")
    points = metric_points(telemetry).withColumns(
        {
            "base": F.first("v").over(by_time),
            "n": F.row_number().over(by_time),
            "size": F.count(F.lit(1)).over(series),
            "series_ts": F.first("ts").over(by_time),
            "series_seq": F.first("seq").over(by_time),
        }
    )
    v, base = F.col("v"), F.col("base")
    rose = ((v >= base * 3) & (v - base >= 5)) | ((base < 1) & (v >= 5))
    fell = (base >= 5) & (v <= base / 3)
    points = points.withColumn("odd", (F.col("n") > 1) & (rose | fell))
    seen = F.max("odd").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    back = (F.col("n") > 1) & ~F.col("odd") & F.coalesce(seen, F.lit(False)) & (F.abs(v - base) <= F.greatest(base * 0.5, F.lit(1.0)))
    why = F.when(F.col("size") == 1, single_point(F.col("name"), v))
    points = points.withColumns({"back": back, "why": why})
    g = X.general
    told = (
        F.when(F.col("why").isNotNull(), F.concat("name", F.lit(" "), "why", F.lit(" at "), g("v")))
        .when(F.col("odd"), F.concat("name", F.when(rose, " rose from ").otherwise(" fell from "), g("base"), F.lit(" to "), g("v")))
        .otherwise(F.concat("name", F.lit(" returned to "), g("v"), F.lit(" (baseline "), g("base"), F.lit(")")))
    )
    kept = points.where("odd or back or why is not null")
    baseline = F.when(F.col("why").isNull(), base).alias("baseline")
    return kept.select("incident_key", "seq", "id", "source", "ts", "name", "v", baseline, told.alias("description"), F.col("back").alias("recovered"), "unit", "series_ts", "series_seq")


def error_level() -> Column:
    return F.coalesce(F.upper(F.col("level")).isin(X.ERROR_LEVELS), F.lit(False))


def first_trouble(telemetry: DataFrame, found: DataFrame) -> DataFrame:
    """(incident_key, trouble): the first active anomaly or error log, also of logs that are changes."""
    logs = telemetry.where((F.col("source_type") == "log") & error_level()).select("incident_key", "ts")
    return logs.unionByName(found.where("not recovered").select("incident_key", "ts")).groupBy("incident_key").agg(F.min("ts").alias("trouble"))


def classify(telemetry: DataFrame, trouble: DataFrame) -> DataFrame:
    """``telemetry`` with ``trouble`` and ``signal``: change, recovery, failure, warning, baseline or null."""
    log = F.col("source_type") == "log"
    rule = (
        F.when(F.col("source_type") == "architecture", None)
        .when(X.is_change("source_type", "detail"), "change")
        .when(log & X.is_recovery("detail") & (F.col("ts") >= F.col("trouble")), "recovery")
        .when(error_level(), "failure")
        .when(F.upper(F.col("level")).isin("WARN", "WARNING"), "warning")
        .when(log & (F.col("trouble").isNull() | (F.col("ts") < F.col("trouble"))), "baseline")
    )
    return telemetry.join(trouble, "incident_key", "left").withColumn("signal", rule)


def hard_items(classified: DataFrame, found: DataFrame) -> DataFrame:
    """(incident_key, source, ts, kind, o1, o2, seq, id, text): error events and active anomalies, in the order kind, o1, o2, seq at one time."""
    events = classified.where("signal = 'failure'").select("incident_key", "source", "ts", F.lit(0).alias("kind"), F.col("ts").alias("o1"), F.col("seq").alias("o2"), "seq", "id", F.regexp_replace("detail", r"\.+$", "").alias("text"))
    odd = found.where("not recovered").select("incident_key", "source", "ts", F.lit(1).alias("kind"), F.col("series_ts").alias("o1"), F.col("series_seq").alias("o2"), "seq", "id", F.col("description").alias("text"))
    return events.unionByName(odd)


def failure_signals(classified: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(incident_key, source, ts, summary, evidence_ids, is_hard, has_error): one signal for each service with a failure.

    The anchor is an aggregate (pre-aggregated before its shuffle); only what lies within ``fold`` of it is
    collected, so a noisy service never gathers all its rows.
    """
    warn = classified.where("signal = 'warning'").select("incident_key", "source", "ts", F.lit(2).alias("kind"), F.col("ts").alias("o1"), F.col("seq").alias("o2"), "seq", "id", F.regexp_replace("detail", r"\.+$", "").alias("text"))
    items = hard_items(classified, found).unionByName(warn)
    order = F.struct("ts", "kind", "o1", "o2", "seq")
    first = items.groupBy("incident_key", "source").agg(F.min(F.when(F.col("kind") < 2, order)).alias("hard"), F.min(order).alias("any"))
    anchor = first.select("incident_key", "source", F.coalesce("hard", "any").alias("anchor"), F.col("hard").isNotNull().alias("is_hard"))
    near = items.join(anchor, ["incident_key", "source"]).withColumn("gap", X.seconds_between("ts", F.col("anchor.ts")))
    own = order == F.col("anchor")
    near = near.where(F.abs("gap") <= settings.fold)
    # hard items first, then warnings, the anchor before all
    item = F.struct((~own).alias("a"), (F.col("kind") == 2).alias("b"), "ts", "kind", "o1", "o2", "seq", "id", "text")
    folded = near.groupBy("incident_key", "source").agg(F.first("anchor.ts").alias("ts"), F.first("is_hard").alias("is_hard"), F.max(F.col("kind") == 0).alias("has_error"), F.array_sort(F.collect_list(item)).alias("items"))
    grown = F.aggregate(
        F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))),
        F.col("items")[0]["text"],
        lambda acc, x: F.when(F.length(acc) < 140, F.concat(acc, F.lit("; "), x["text"])).otherwise(acc),
    )
    return folded.select("incident_key", "source", "ts", grown.alias("summary"), F.transform("items", lambda x: x["id"]).alias("evidence_ids"), "is_hard", "has_error")


def origins(signals: DataFrame) -> DataFrame:
    """The earliest hard signal of each incident; incidents without one have no row."""
    w = Window.partitionBy("incident_key").orderBy("ts", "source")
    return signals.where("is_hard").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def correlate(changes: DataFrame, origin: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best change of each incident that has one: within ``look_back`` before the origin, scored by gap, service and affinity.

    (incident_key, change_id, change_source, change_type, change_ts, change_detail, gap, affinity, score); ties go to the earliest.
    """
    o = origin.select("incident_key", F.col("source").alias("origin_source"), F.col("ts").alias("origin_ts"), F.col("summary").alias("origin_summary"))
    near = changes.join(o, "incident_key").withColumn("gap", X.seconds_between("origin_ts", "ts")).where((F.col("gap") >= 0) & (F.col("gap") <= settings.look_back))
    near = near.withColumn("affinity", X.affinity("detail", "origin_summary"))
    score = F.lit(0.45) + F.when(F.col("gap") <= settings.near, 0.25).when(F.col("gap") <= settings.mid, 0.15).otherwise(0.0)
    score = score + F.when(F.col("source") == F.col("origin_source"), 0.10).otherwise(0.0)
    score = F.least(score + F.when(F.col("affinity").isNotNull(), 0.10).otherwise(0.0), F.lit(0.95))
    w = Window.partitionBy("incident_key").orderBy(F.desc("score"), "ts", "seq")
    best = near.withColumn("score", score).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("incident_key", F.col("id").alias("change_id"), F.col("source").alias("change_source"), F.col("source_type").alias("change_type"), F.col("ts").alias("change_ts"), F.col("detail").alias("change_detail"), "gap", "affinity", "score")


def bursts(telemetry: DataFrame, count: int = 3, window: float = 90) -> DataFrame:
    """Error rows at which a source has had ``count`` or more errors within ``window`` seconds, both ends included."""
    micros, width = F.unix_micros(F.col("ts").cast("timestamp")), int(window * 1e6)
    rows = telemetry.where(error_level()).select("id", "source", "ts", micros.alias("at"))
    # a row counts in its own stretch of time and in the next, so that no source's errors meet in one task
    own = F.floor(F.col("at") / max(1, width))
    rows = rows.select("*", own.alias("own"), F.explode(F.array(own, own + 1)).alias("stretch"))
    w = Window.partitionBy("source", "stretch").orderBy("at").rangeBetween(-width, 0)
    rows = rows.withColumn("errors", F.count(F.lit(1)).over(w))
    return rows.where((F.col("stretch") == F.col("own")) & (F.col("errors") >= count)).select("id", "source", "ts", "errors")
