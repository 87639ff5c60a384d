"""State replay: what each service's state is after each frame of an incident's timeline, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of states; recovery is absorbing.
RANKS = {"warning": 1, "critical": 2, "recovery": 3}


def state_of(rank):
    return F.when(rank == 3, "recovery").when(rank == 2, "critical").when(rank == 1, "warning")


def states(timeline: DataFrame) -> DataFrame:
    """(incident_key, service, idx, ts, state, previous): each frame that touches a service, with its state after it."""
    rank = F.when(F.col("severity") == "warning", 1).when(F.col("severity") == "critical", 2).when(F.col("severity") == "recovery", 3)
    rows = timeline.withColumn("rank", rank).where("rank is not null").select("incident_key", "idx", "ts", "rank", F.explode(F.array_distinct("services")).alias("service"))
    w = Window.partitionBy("incident_key", "service").orderBy("idx")
    now = F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("incident_key", "service", "idx", "ts", state_of(now).alias("state"), state_of(before).alias("previous"))


def changes(state: DataFrame) -> DataFrame:
    return state.where(~F.col("state").eqNullSafe(F.col("previous")))


def degraded(state: DataFrame) -> DataFrame:
    """(incident_key, service, idx, ts): the first warning or critical frame of each service that came before any recovery."""
    return state.where("state <> 'recovery'").groupBy("incident_key", "service").agg(F.min("idx").alias("idx"), F.min_by("ts", "idx").alias("ts"))


def active_edges(propagation: DataFrame, down: DataFrame) -> DataFrame:
    """(incident_key, a, b, ts): propagation between degraded services, whatever the direction, from when both are."""
    one, two = (down.select("incident_key", F.col("service").alias(s), F.col("ts").alias(t)) for s, t in (("from_service", "t1"), ("to_service", "t2")))
    rows = propagation.join(one, ["incident_key", "from_service"]).join(two, ["incident_key", "to_service"])
    return rows.groupBy("incident_key", F.least("from_service", "to_service").alias("a"), F.greatest("from_service", "to_service").alias("b")).agg(F.min(F.greatest("t1", "t2")).alias("ts"))


def changed_services(timeline: DataFrame) -> DataFrame:
    """(incident_key, idx, service): the services of each frame that degrades or recovers."""
    return timeline.where(F.col("severity").isin(*RANKS)).select("incident_key", "idx", F.explode("services").alias("service")).distinct()


def as_of(samples: DataFrame, markers: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``samples`` (keys, ts, ...) with the last ``markers`` row at or before each: an as-of join by one sort of the union, no pairs."""
    mark = F.struct("ts", *values)
    both = samples.withColumns({"mark_": F.lit(None).cast(markers.select(mark.alias("m")).schema["m"].dataType), "order_": F.lit(1)})
    both = both.unionByName(markers.select(*keys, "ts", mark.alias("mark_"), F.lit(0).alias("order_")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ts", "order_").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last_", F.last("mark_", ignorenulls=True).over(w)).where("order_ = 1")
    return found.select(*samples.columns, F.col("last_.ts").alias("since"), *(F.col(f"last_.{v}").alias(v) for v in values))


def beats(timeline: DataFrame, summaries: DataFrame, text: DataFrame) -> DataFrame:
    """(incident_key, n, kind, line): an intro, a line for each frame, the dive into the traced service after the first critical frame that names it, two outros."""
    row = lambda rank, idx, sub, kind, line: F.struct(F.lit(rank).alias("rank"), idx.alias("idx"), F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), line.alias("line"))
    zero = F.lit(0).cast("int")
    intro = text.select("incident_key", row(0, zero, 0, "intro", F.concat(F.lit("Incident "), "incident_id", F.lit(". "), "title", F.lit("."))).alias("b"))
    line = F.concat(F.date_format("ts", "HH:mm"), F.lit(" UTC: "), "title", F.lit("."))
    frames = timeline.select("incident_key", row(1, F.col("idx").cast("int"), 0, "event", line).alias("b"))
    named = timeline.join(summaries.select("incident_key", F.col("service").alias("traced"), "summary"), "incident_key").where("severity = 'critical' and array_contains(services, traced)")
    dive = named.groupBy("incident_key").agg(F.min(F.col("idx").cast("int")).alias("idx"), F.first("summary").alias("summary"))
    inside = dive.select("incident_key", row(1, F.col("idx"), 1, "internal", F.col("summary")).alias("b"))
    outro = text.select("incident_key", row(2, zero, 0, "outro", F.col("engineer_briefing")).alias("b"))
    last = text.select("incident_key", row(2, zero, 1, "outro", F.col("executive_summary")).alias("b"))
    rows = intro
    for more in (frames, inside, outro, last):
        rows = rows.unionByName(more)
    w = Window.partitionBy("incident_key").orderBy("b.rank", "b.idx", "b.sub")
    return rows.select("incident_key", F.row_number().over(w).alias("n"), "b.kind", "b.line")
