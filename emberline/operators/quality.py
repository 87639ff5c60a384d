"""Quality gate and evidence profile of whole datasets of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import lines as L
from emberline.functions import text as X

SOURCE_TYPES = ["architecture", "deployment", "log", "metric"]


def gate(rows: DataFrame, services: DataFrame, base, step: float = 45, longest: int = 600) -> DataFrame:
    """Raw rows (incident_key, pos, id, source, source_type, timestamp, detail) with ``reason`` (null: kept), ``ts`` and a clipped ``detail``.

    ``services`` declares (incident_key, service). A time that can't be read becomes ``base`` plus ``step`` seconds for each place.
    """
    known = services.select("incident_key", F.col("service").alias("source")).distinct().withColumn("declared", F.lit(True))
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit("log"))
    ident = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("synth-"), F.when(F.col("pos") < 1000, F.lpad(F.col("pos").cast("string"), 3, "0")).otherwise(F.col("pos").cast("string"))))
    out = rows.join(known, ["incident_key", "source"], "left").withColumns({"kind": kind, "ident": ident})
    reason = F.when(F.col("declared").isNull(), F.concat("ident", F.lit(": source '"), F.coalesce("source", F.lit("None")), F.lit("' is not a declared service"))).when(
        ~F.col("kind").isin(SOURCE_TYPES), F.concat("ident", F.lit(": source_type '"), "kind", F.lit(f"' is not one of {', '.join(SOURCE_TYPES)}"))
    )
    made = base + F.make_dt_interval(secs=(F.col("pos") * step).cast("decimal(18,6)"))
    detail = F.substring(F.trim(F.coalesce("detail", F.lit(""))), 1, longest)
    return out.select("incident_key", "pos", F.col("ident").alias("id"), F.col("kind").alias("source_type"), "source", F.coalesce(L.instant(F.col("timestamp")), made).alias("ts"), detail.alias("detail"), reason.alias("reason"))


def accepted(gated: DataFrame, least: int = 4) -> DataFrame:
    """Kept rows of incidents with ``least`` usable rows or more."""
    kept = gated.where("reason is null")
    enough = kept.groupBy("incident_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return kept.join(enough, "incident_key", "left_semi")


def rejected(gated: DataFrame, least: int = 4) -> DataFrame:
    """(incident_key, usable, reasons): incidents with too few usable rows, and their first four reasons."""
    by = gated.groupBy("incident_key").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("usable"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("pos", "reason")))).alias("r"))
    return by.where(F.col("usable") < least).select("incident_key", "usable", F.array_join(F.transform(F.slice("r", 1, 4), lambda x: x["reason"]), "; ").alias("reasons"))


def declared_dependencies(services: DataFrame) -> DataFrame:
    """``services`` (incident_key, service, depends_on) without dependencies on services that aren't declared, in their order."""
    names = services.groupBy("incident_key").agg(F.collect_set("service").alias("names"))
    return services.join(names, "incident_key").withColumn("depends_on", F.array_intersect("depends_on", "names")).drop("names")


def comparable(telemetry: DataFrame) -> DataFrame:
    """(incident_key, comparable): whether any series rises or falls to three times its first value or a third of it."""
    name = F.coalesce(F.nullif("metric", F.lit("")), F.substring("detail", 1, 40))
    w = Window.partitionBy("incident_key", "source", "name").orderBy("ts", "seq")
    rows = telemetry.where("source_type = 'metric' and value is not null").withColumn("name", name).withColumns({"base": F.first("value").over(w), "n": F.row_number().over(w)})
    v, b = F.col("value"), F.col("base")
    odd = (F.col("n") > 1) & (((v >= b * 3) & (v - b >= 5)) | ((b < 1) & (v >= 5)) | ((b >= 5) & (v <= b / 3)))
    return rows.groupBy("incident_key").agg(F.max(odd).alias("comparable"))


def unmet(telemetry: DataFrame, errors: int = 2, events: int = 12) -> DataFrame:
    """(incident_key, unmet): what each dataset lacks for a reconstruction, in a fixed order."""
    error = F.upper("level").isin("ERROR", "CRITICAL", "FATAL")
    facts = telemetry.groupBy("incident_key").agg(F.count(F.when(error, 1)).alias("e"), F.max(F.col("source_type") == "deployment").alias("d"), F.coalesce(F.max(error & (F.coalesce("logger", F.lit("")) != "")), F.lit(False)).alias("l"), F.count(F.lit(1)).alias("n"))
    rows = facts.join(comparable(telemetry), "incident_key", "left")
    texts = [
        (F.col("e") < errors, F.lit("two error events")),
        (~F.col("d"), F.lit("a deployment event")),
        (~F.col("l"), F.lit("a logger on an error event")),
        (~F.coalesce("comparable", F.lit(False)), F.lit("a comparable metric")),
        (F.col("n") < events, F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" events"))),
    ]
    return rows.select("incident_key", F.array_join(F.array_compact(F.array(*(F.when(c, t) for c, t in texts))), "; ").alias("unmet"))


def intake(texts: DataFrame, key: str, text: str, characters: int = 20_000, rows: int = 400) -> DataFrame:
    """Pasted texts (one a row) to their first ``rows`` non-blank lines: (key, n, value); longer texts are refused whole."""
    lines = texts.where(F.length(text) <= characters).select(key, F.posexplode(F.split(text, L.BREAKS)).alias("pos", "value")).where("trim(value) <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows).select(key, "n", "value")


def parsed_intake(texts: DataFrame, key: str, text: str, modified: Column, characters: int = 20_000, rows: int = 400) -> DataFrame:
    """Pasted texts to log events, as from a file of their lines: each text is a service whose name is its key made safe.

    ``modified`` is the time of lines before the first that has one. Texts of keys with one safe name are one service's.
    Texts that are too long, empty or null have no event.
    """
    lines = intake(texts, key, text, characters, rows)
    return L.events(lines.select(X.safe_name(F.col(key)).alias("service"), F.lit("input.log").alias("file"), modified.alias("modified"), F.col("n").alias("line_no"), "value"))
