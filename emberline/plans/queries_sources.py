"""Registered queries: sources and sinks, each written to the shared folder and read back, and attributes of any type."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import attributes as A
from emberline.functions import lines as L
from emberline.functions import text as X
from emberline.operators import catalog, graph
from emberline.plans import sql as S
from emberline.plans.queries import query
from emberline.plans.queries_logs import ENTRY_SQL, raw_lines
from emberline.sources import adapters, files, tail
from emberline.streaming import watch

#: Attributes of each event: numbers, a truth value, a text that looks like a number, nulls, lists, objects, none at all; some hold a policy's words.
ATTRIBUTES_SQL = """SELECT *, CASE seq % 8
    WHEN 0 THEN '{"metric": "m.a", "value": ' || seq || '}'
    WHEN 1 THEN '{"metric": 5, "value": ' || seq || '.5}'
    WHEN 2 THEN '{"value": true}'
    WHEN 3 THEN '{"metric": "", "value": "' || seq || '"}'
    WHEN 4 THEN '{"value": null, "reason": "MODEL_BLOCKED by policy"}'
    WHEN 5 THEN '{"model_blocked": "x", "value": [1]}'
    WHEN 6 THEN '{"note": {"k": ["model x not allowed for virtual key"]}}' END AS attributes FROM telemetry"""


@query(f"""SELECT id, {S.NAME} AS name, {S.VALUE} AS v, {S.IS_POLICY} OR seq % 8 IN (4, 6) AS is_policy
  FROM (SELECT * REPLACE (CASE WHEN seq % 8 = 0 THEN 'm.a' END AS metric, CASE seq % 8 WHEN 0 THEN seq WHEN 1 THEN seq + 0.5 WHEN 2 THEN 1 END AS value) FROM telemetry)""")
def b1_b2_b4_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and value of each event as a metric, and the policy test, where attributes are variants."""
    rows = adapters.sql(spark, ATTRIBUTES_SQL, telemetry=adapters.telemetry(spark, sf_dir)).withColumn("a", F.try_parse_json("attributes"))
    return rows.select("id", X.metric_name(A.text("a", "metric"), "detail").alias("name"), X.metric_value(A.number("a", "value"), "detail").alias("v"), X.is_policy_rejection(A.searched("detail", "a")).alias("is_policy"))


def folder(spark: SparkSession, name: str) -> str:
    return f"{graph.shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """The raw lines as files of each service, in the order of their numbers; a service may have many."""
    place = folder(spark, "logs")
    rows = raw_lines(spark, sf_dir).repartitionByRange("service", "seq").sortWithinPartitions("service", "seq")
    rows.select("service", "value").write.partitionBy("service").text(place)
    return place


def services_of(rows: DataFrame) -> DataFrame:
    service = rows.select("service").distinct()
    return service.withColumn("pattern", F.concat(F.lit("%/service="), "service", F.lit("/%")))


@query("SELECT id, service, ts, detail, level FROM log_events")
def a6_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events from files that are read by splits, numbered over the files of each service."""
    lines = files.read_logs(spark, log_files(spark, sf_dir), services_of(adapters.services(spark, sf_dir)))
    lines = lines.withColumn("modified", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))  # the oracle's
    return L.events(lines).select("id", F.col("source").alias("service"), "ts", "detail", "level")


@query("SELECT service, ts, level, message, logger, count(*) AS n FROM (SELECT service, at_ts AS ts, level, message, logger FROM expected_lines) GROUP BY ALL")
def a8_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the same files through the tail stream, parsed as they come."""
    place = log_files(spark, sf_dir)
    names = [r["service"] for r in adapters.services(spark, sf_dir).select("service").distinct().collect()]  # options of the source, one a service
    lines = tail.tail(spark, {s: f"{place}/service={s}/*.txt" for s in names})
    parsed = watch.drain(L.parsed(lines, "value").where("p is not null").select("service", "p.*"))
    return parsed.groupBy("service", "ts", "level", "message", "logger").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source || '-' || doc_id AS prefix, lang, n_chars AS n FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0")
def a13_a16_catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries written as JSON lines, with blank and broken lines among them, and read back."""
    place = folder(spark, "catalog")
    adapters.sql(spark, ENTRY_SQL, documents=adapters.table(spark, sf_dir, "documents")).where("value is not null").select("value").write.text(place)
    back = files.read_catalog(spark, place)
    kept = catalog.entries(back.select(F.to_json("entry").alias("value")), "value")
    again = folder(spark, "catalog")
    files.write_catalog(kept, again)
    return spark.read.schema("prefix string, lang string, n long").json(again)


S.STEPS["nested"] = """SELECT 'svc-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS service, s_suppkey, 'team-' || s_nationkey AS owner, s_suppkey % 5 = 0 AS user_facing FROM supplier"""


@query("""SELECT 'service' AS kind, service, owner AS a, CAST(user_facing AS VARCHAR) AS b FROM nested
  UNION ALL SELECT 'edge', service, 'svc-' || lpad(CAST(s_suppkey * 2 AS VARCHAR), 6, '0'), '0' FROM nested UNION ALL SELECT 'edge', service, 'svc-000001', '1' FROM nested
  UNION ALL SELECT 'stage', service, 'gate', 'app,app.core' FROM nested WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'stage_edge', service, 'gate', 'sink' FROM nested WHERE s_suppkey % 3 = 0""")
def a2_architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as a service of its nation's architecture file, read back as tables."""
    name = lambda key: F.concat(F.lit("svc-"), F.lpad(key.cast("string"), 6, "0"))
    k = F.col("s_suppkey")
    stage = lambda n, m: F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, m)).alias("modules"))
    internals = F.struct(F.lit("gate").alias("entry"), F.array(stage("gate", ["app", "app.core"])).alias("stages"), F.array(F.array(F.lit("gate"), F.lit("sink"))).alias("edges"))
    service = F.struct(name(k).alias("name"), F.concat(F.lit("team-"), F.col("s_nationkey").cast("string")).alias("owner"), F.array(name(k * 2), F.lit("svc-000001")).alias("depends_on"), (k % 5 == 0).alias("user_facing"), F.when(k % 3 == 0, internals).alias("internals"))
    place = folder(spark, "architectures")
    # one service a document: a document is never gathered from a table's rows
    adapters.table(spark, sf_dir, "supplier").select("s_nationkey", F.to_json(F.struct(F.lit("shop").alias("system"), F.array(service).alias("services"))).alias("value")).write.partitionBy("s_nationkey").text(place)
    t = files.read_architectures(spark, place, multiline=False)
    out = t["services"].select(F.lit("service").alias("kind"), "service", F.col("owner").alias("a"), F.col("user_facing").cast("string").alias("b"))
    out = out.unionByName(t["service_edges"].select(F.lit("edge").alias("kind"), "service", F.col("dependency").alias("a"), F.col("ord").cast("string").alias("b")))
    out = out.unionByName(t["stages"].select(F.lit("stage").alias("kind"), "service", F.col("stage").alias("a"), F.array_join("modules", ",").alias("b")))
    return out.unionByName(t["stage_edges"].select(F.lit("stage_edge").alias("kind"), "service", F.col("src").alias("a"), F.col("dst").alias("b")))
