"""Incident tables derived from the driver's tables: telemetry, services, their edges and stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row for each event; the same text runs in any SQL engine with the usual functions.
TELEMETRY_SQL = r"""
SELECT CAST(CAST(ts AS DATE) AS STRING) AS incident_key, event_id AS seq, 'ev-' || CAST(event_id AS STRING) AS id,
  source_type, 'svc-' || lpad(CAST(user_id % 12 AS STRING), 2, '0') AS source, ts,
  CASE
    WHEN source_type = 'metric' THEN event_type || ' = ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || ' ms'
    WHEN source_type = 'deployment' AND k % 3 = 0 THEN 'Rotated database secret via deploy pipeline'
    WHEN source_type = 'deployment' AND k % 3 = 1 THEN 'Rolling restart of workers, scale changed'
    WHEN source_type = 'deployment' THEN 'Config flag flip released'
    WHEN event_type = 'view' AND k % 9 = 0 THEN 'Cache warmed and service restored'
    WHEN event_type = 'view' AND k % 9 = 1 THEN 'maintenance window opened, retry budget ok'
    WHEN event_type = 'view' THEN 'request served in normal time'
    WHEN k % 5 = 0 THEN 'Upstream call timed out after retry timeout.'
    WHEN k % 5 = 1 THEN 'auth denied: token rejected by dependency'
    WHEN k % 5 = 2 THEN 'queue depth above limit, backlog growing...'
    WHEN k % 5 = 3 THEN 'connection pool exhausted while parsing ''cfg/main.yaml'' invalid entry'
    ELSE 'model gpt-x not allowed for virtual key (HTTP 403)' END
    || CASE WHEN source_type = 'log' AND k % 2 = 0 THEN ' [app.' || event_type || '.core.handler]' ELSE '' END AS detail,
  CASE WHEN event_type = 'error' AND value >= 80 THEN 'ERROR' WHEN event_type = 'error' THEN 'WARN' WHEN event_type = 'view' THEN 'INFO' END AS level,
  CASE WHEN source_type = 'log' AND k % 4 = 1 THEN 'app.' || event_type || '.pipeline' END AS logger,
  CASE WHEN source_type = 'metric' AND k % 6 <> 0 THEN event_type || CASE WHEN k % 4 = 0 THEN '.queue_depth' WHEN k % 4 = 1 THEN '.error_rate' ELSE '.latency_p95' END END AS metric,
  CASE WHEN source_type = 'metric' AND k % 6 <> 0 THEN value END AS value,
  CASE WHEN source_type = 'metric' AND k % 2 = 0 THEN 'ms' END AS unit
FROM (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k,
    CASE WHEN event_type IN ('error', 'view') THEN 'log' WHEN event_type = 'signup' THEN 'deployment' ELSE 'metric' END AS source_type
  FROM events
) e
"""

#: Each service with what it depends on: a tree of twelve, and one edge back that makes a cycle.
EDGES_SQL = """
SELECT DISTINCT 'svc-' || lpad(CAST(i AS STRING), 2, '0') AS service, 'svc-' || lpad(CAST(d AS STRING), 2, '0') AS dependency, ord
FROM (
  SELECT user_id % 12 AS i, 2 * (user_id % 12) + 1 AS d, 0 AS ord FROM events
  UNION ALL SELECT user_id % 12, 2 * (user_id % 12) + 2, 1 FROM events
  UNION ALL SELECT user_id % 12, 5, 0 FROM events WHERE user_id % 12 = 11
) e WHERE d < 12
"""

#: Edges between suppliers that follow one another in an order, and the suppliers they touch.
LINKS_SQL = """
SELECT DISTINCT src, dst FROM (
  SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS dst
  FROM lineitem
) l WHERE dst IS NOT NULL
"""

SERVICES_SQL = "SELECT DISTINCT 'svc-' || lpad(CAST(user_id % 12 AS STRING), 2, '0') AS service, user_id % 12 = 0 AS user_facing FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """``text`` with each named table read from the DataFrame of that name."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **tables)


def run(spark: SparkSession, sf_dir: str, text: str, name: str = "events") -> DataFrame:
    return sql(spark, text, **{name: table(spark, sf_dir, name)})


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, TELEMETRY_SQL)


def service_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, EDGES_SQL)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SERVICES_SQL)


def supplier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, LINKS_SQL, "lineitem")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, stage, ord, modules): five stages of each service."""
    each = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(n).alias("ord"), F.array(*map(F.lit, m)).alias("modules")) for n, (s, m) in enumerate(STAGES)))
    return services(spark, sf_dir).select("service", F.explode(each).alias("s")).select("service", "s.*")


def stage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(n).alias("ord")) for n, (a, b) in enumerate(STAGE_EDGES)))
    return services(spark, sf_dir).select("service", F.explode(each).alias("e")).select("service", "e.*")


STAGES = [("gate", ["app"]), ("view-handler", ["app.view", "app.view.core"]), ("pipeline", ["lib.pipeline"]), ("core", ["app.error.core"]), ("sink", ["app.sink"])]
STAGE_EDGES = [("gate", "view-handler"), ("gate", "pipeline"), ("view-handler", "core"), ("pipeline", "core"), ("core", "sink")]
