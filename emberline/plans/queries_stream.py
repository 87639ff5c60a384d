"""Registered queries: bursts over a stream and a batch, quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans import sql as S
from emberline.plans.queries import query
from emberline.sources import adapters
from emberline.streaming import live, watch

#: The driver's events lie minutes apart.
WINDOW, COOLDOWN = 43_200, 86_400


def error_times(telemetry: DataFrame) -> DataFrame:
    return telemetry.where("level = 'ERROR'").select(F.col("source").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


@query()
def i2_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of each service with a rest after each."""
    return watch.trips(error_times(adapters.telemetry(spark, sf_dir)), 3, WINDOW, COOLDOWN)


@query()
def i1_i2_stream_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of all that there is."""
    schema = adapters.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")
    return watch.drain(watch.trips(error_times(adapters.sql(spark, adapters.TELEMETRY_SQL, events=events)), 3, WINDOW, COOLDOWN))


@query()
def i6_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a call of one of twenty clients."""
    calls = adapters.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("client"), (F.col("conv_id") * 60 + F.col("turn") * 7).cast("double").alias("at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return watch.quota(calls)


@query("SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS n FROM telemetry) WHERE n <= 30")
def i4_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thirty of each service after the two halves of the events came in, the later half first."""
    rows = adapters.telemetry(spark, sf_dir)
    first = watch.newest(None, rows.where("seq % 2 = 1"), 30)
    return watch.newest(first, rows.where("seq % 2 = 0"), 30).select("source", "id")


@query("""SELECT source, id FROM (SELECT t.source, t.id, row_number() OVER (PARTITION BY t.source ORDER BY t.ts DESC, t.seq DESC) AS n FROM telemetry t
  JOIN (SELECT source, max(ts) FILTER (level = 'ERROR') AS at FROM telemetry GROUP BY source) x ON x.source = t.source AND t.ts <= x.at + INTERVAL 5 SECOND) WHERE n <= 40""")
def i3_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each service has logged by five seconds after its last error, the newest forty."""
    rows = adapters.telemetry(spark, sf_dir)
    last = error_times(rows).groupBy("key").agg(F.max("at").alias("at"))
    return watch.settled(rows.withColumn("key", F.col("source")), last, 5, 40).select("source", "id")


#: The watch of the registered queries: half a day's window, an hour to settle, a day's rest.
WATCH = live.Watch(threshold=3, window=WINDOW, cooldown=COOLDOWN, settle=3600, lookback=20)
#: Errors of odd days are those of restarts, so that some bursts are no incidents.
RESTARTS = "CASE WHEN level = 'ERROR' AND day(ts) % 2 = 1 THEN 'Rolling restart: ' || detail ELSE detail END"
S.STEPS["lined"] = f"""SELECT *, CASE WHEN e THEN lag(us, {WATCH.threshold - 1}) OVER (PARTITION BY key, e ORDER BY us, seq) END AS nth FROM (
  SELECT source AS key, epoch_us(ts) AS us, seq, {S.ERROR} AS e, {S.ERROR} AND source_type <> 'architecture' AND NOT {S.IS_CHANGE} AND NOT (source_type = 'log' AND {S.IS_RECOVERY}) AS hard
  FROM (SELECT * REPLACE ({RESTARTS} AS detail) FROM telemetry))"""
S.STEPS["watch_rows"] = f"""SELECT *, row_number() OVER w AS rn, last_value(nth IGNORE NULLS) OVER w AS held,
  count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {int(WATCH.settle * 1e6)} FOLLOWING) AS upto FROM lined WINDOW w AS (PARTITION BY key ORDER BY us, seq ROWS UNBOUNDED PRECEDING)"""
S.STEPS["watch_trips"] = f"""SELECT DISTINCT key, CAST(-1 AS BIGINT) AS us, CAST(-1 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS upto, CAST(-1 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS after, CAST(-1 AS BIGINT) AS cleared, CAST(-1 AS BIGINT) AS rest, false AS real FROM watch_rows
  UNION ALL SELECT key, us, rn, upto, cleared, us + {int(WATCH.settle * 1e6)}, CASE WHEN real THEN us + {int(WATCH.settle * 1e6)} ELSE cleared END, CASE WHEN real THEN us + {int((WATCH.settle + WATCH.cooldown) * 1e6)} ELSE rest END, real FROM (
    SELECT c.*, (SELECT bool_or(x.hard) FROM watch_rows x WHERE x.key = c.key AND x.rn <= c.upto AND x.rn > c.upto - {WATCH.lookback}) AS real FROM (
      SELECT t.key, t.cleared, t.rest, min(r.rn) AS rn, arg_min(r.us, r.rn) AS us, arg_min(r.upto, r.rn) AS upto FROM watch_trips t JOIN watch_rows r ON r.key = t.key AND r.us > t.after AND r.held > t.cleared
        AND r.held >= r.us - {int(WATCH.window * 1e6)} AND r.us >= t.rest GROUP BY ALL) c)"""
WATCH_SQL = f"""SELECT t.key, t.us AS tripped_us, (SELECT CAST(count(*) AS INTEGER) FROM watch_rows x WHERE x.key = t.key AND x.e AND x.rn <= t.rn AND x.us >= t.us - {int(WATCH.window * 1e6)} AND x.us > t.since) AS errors, x.seq
  FROM watch_trips t JOIN watch_rows x ON x.key = t.key AND x.rn <= t.upto AND x.rn > t.upto - {WATCH.lookback} WHERE t.real"""


def restarting(telemetry: DataFrame) -> DataFrame:
    return telemetry.withColumn("detail", F.expr(RESTARTS)).withColumn("key", F.col("source"))


def told(found: DataFrame) -> DataFrame:
    return found.select("key", F.round(F.col("tripped_at") * 1e6).cast("long").alias("tripped_us"), "errors", "seq")


@query(WATCH_SQL)
def i1_i3_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events looked back on at each incident of each service, by one fold of a batch."""
    return told(live.watched(restarting(adapters.telemetry(spark, sf_dir)), WATCH))


@query(WATCH_SQL)
def i1_i4_watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stateful operator over a stream, with timers, restarted once from its checkpoint."""
    schema = adapters.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*")
    return told(live.drained(restarting(adapters.sql(spark, adapters.TELEMETRY_SQL, events=events)), WATCH, "1 day"))
