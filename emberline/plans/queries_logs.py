"""Registered queries: log lines, quality, traces, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import lines as L
from emberline.operators import catalog, quality, signals, trace
from emberline.plans import sql as S
from emberline.plans.queries import ids, query, star, upto_signals
from emberline.sources import adapters

#: Each event as a raw line in one of six forms; the last two have no time.
LINES_SQL = r"""
SELECT seq, source AS service, CASE seq % 6
    WHEN 0 THEN '{"timestamp": "' || replace(t, ' ', 'T') || 'Z", "level": "' || lower(lvl) || '", "message": "' || replace(msg, '"', '') || '", "logger": "app.json"}'
    WHEN 1 THEN t || ',123 - app.core - ' || lvl || ' - ' || msg
    WHEN 2 THEN t || '.5  ' || lvl || ' 1 --- [main] com.app.web : ' || msg
    WHEN 3 THEN '[' || t || '+02:00] ' || lvl || ': ' || msg
    WHEN 4 THEN lvl || ': ' || msg
    ELSE 'note ' || msg END AS value
FROM (SELECT seq, source, CAST(date_trunc('second', ts) AS STRING) AS t, coalesce(level, 'INFO') AS lvl, regexp_replace(detail, ' .app.*$', '') AS msg FROM telemetry) x
"""
S.STEPS["raw_lines"] = LINES_SQL
S.STEPS["expected_lines"] = r"""SELECT seq, source AS service,
  CASE seq % 6 WHEN 0 THEN d WHEN 1 THEN d + INTERVAL 123 MILLISECONDS WHEN 2 THEN d + INTERVAL 500 MILLISECONDS WHEN 3 THEN d - INTERVAL 2 HOURS END AS at_ts,
  CASE WHEN seq % 6 = 5 THEN 'INFO' ELSE lvl END AS level, CASE seq % 6 WHEN 0 THEN replace(msg, '"', '') WHEN 5 THEN 'note ' || msg ELSE trim(msg) END AS message,
  CASE seq % 6 WHEN 0 THEN 'app.json' WHEN 1 THEN 'app.core' WHEN 2 THEN 'com.app.web' ELSE '' END AS logger
  FROM (SELECT seq, source, date_trunc('second', ts) AS d, coalesce(level, 'INFO') AS lvl, regexp_replace(detail, ' .app.*$', '') AS msg FROM telemetry) x"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.sql(spark, LINES_SQL, telemetry=adapters.telemetry(spark, sf_dir))


@query("SELECT seq, at_ts AS ts, level, message, logger FROM expected_lines")
def b5_b7_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle knows what the lines were made of and parses nothing."""
    return L.parsed(raw_lines(spark, sf_dir), "value").select("seq", "p.*")


EVENTS = """SELECT service || '-log-' || lpad(CAST(n AS VARCHAR), 5, '0') AS id, service, coalesce(last_value(at_ts IGNORE NULLS) OVER (PARTITION BY service ORDER BY seq), TIMESTAMP '2020-01-01 00:00:00') AS ts,
  message || CASE WHEN logger <> '' THEN ' [' || logger || ']' ELSE '' END AS detail, level FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY seq) AS n FROM expected_lines)"""
S.STEPS["log_events"] = EVENTS


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_lines(spark, sf_dir).select("service", F.lit("app.log").alias("file"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("modified"), F.col("seq").alias("line_no"), "value")
    return L.events(rows)


@query("SELECT id, service, ts, detail, level FROM log_events")
def b8_e4_e5_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).select("id", F.col("source").alias("service"), "ts", "detail", "level")


@query("SELECT 'log' AS kind, id, ts FROM log_events UNION ALL SELECT 'metric', id, ts FROM telemetry WHERE source_type = 'metric'")
def a7_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events and metric events, by time."""
    logs = log_events(spark, sf_dir).select(F.lit("log").alias("kind"), "id", "ts")
    return logs.unionByName(adapters.telemetry(spark, sf_dir).where("source_type = 'metric'").select(F.lit("metric").alias("kind"), "id", "ts")).orderBy("ts", "id")


@query(r"""SELECT doc_id, len(rows) >= 2 AND len(list_filter(rows, lambda x: regexp_matches(x, '\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\b'))) >= greatest(1, len(rows) // 4) AS is_log
  FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\n'), lambda x: trim(x) <> '') AS rows FROM documents)""")
def b16_log_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").select("doc_id", L.looks_like_logs("text").alias("is_log"))


@query(r"""SELECT doc_id, n, value FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\n')) AS value, generate_subscripts(string_split_regex(text, '\n'), 1) AS pos FROM documents WHERE length(text) <= 20000) WHERE trim(value) <> '') WHERE n <= 400""")
def a17_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.intake(adapters.table(spark, sf_dir, "documents"), "doc_id", "text")


#: Raw lines pasted together: those of a service in a stretch of 400 numbers, so that no text gathers more.
PASTED_SQL = "SELECT service || '/' || CAST(CAST(floor(seq / 400) AS BIGINT) AS STRING) || '?' AS k, seq, value FROM raw_lines"
S.STEPS["pasted"] = PASTED_SQL
S.STEPS["taken"] = "SELECT e.*, p.n, rtrim(replace(replace(p.k, '/', '-'), '?', '-'), '-') AS name, p.k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS n, sum(length(value) + 1) OVER (PARTITION BY k) - 1 AS size FROM pasted) p JOIN expected_lines e ON e.seq = p.seq WHERE p.size <= 12000 AND p.n <= 30"


@query("""SELECT name || '-log-' || lpad(CAST(n AS VARCHAR), 5, '0') AS id, name AS service, coalesce(last_value(at_ts IGNORE NULLS) OVER (PARTITION BY k ORDER BY n), TIMESTAMP '2020-01-01 00:00:00') AS ts,
  message || CASE WHEN logger <> '' THEN ' [' || logger || ']' ELSE '' END AS detail, level FROM taken""")
def a17_parsed_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pasted log texts; names are made safe, and only the first lines of a text count."""
    lines = adapters.sql(spark, PASTED_SQL, raw_lines=raw_lines(spark, sf_dir))
    texts = lines.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n").alias("text"))
    found = quality.parsed_intake(texts, "k", "text", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), characters=12_000, rows=30)
    return found.select("id", F.col("source").alias("service"), "ts", "detail", "level")


# ---------------------------------------------------------------- quality

#: Raw rows with faults: services that nothing declares, types that don't exist, times that can't be read.
PAYLOAD_SQL = """
SELECT incident_key, seq AS pos, CASE WHEN seq % 11 = 0 THEN '' ELSE id END AS id, CASE WHEN seq % 13 = 0 THEN 'ghost' ELSE source END AS source,
  CASE WHEN seq % 17 = 0 THEN 'change' WHEN seq % 19 = 0 THEN '' ELSE source_type END AS source_type,
  CASE WHEN seq % 7 = 0 THEN 'soon' ELSE CAST(date_trunc('second', ts) AS STRING) || 'Z' END AS timestamp, detail FROM telemetry
"""
S.STEPS["payload"] = PAYLOAD_SQL
S.STEPS["gated"] = """SELECT incident_key, pos, ident AS id, kind AS source_type, source,
  CASE WHEN timestamp = 'soon' THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(45 * pos) ELSE CAST(replace(timestamp, 'Z', '') AS TIMESTAMP) END AS ts, substr(trim(coalesce(detail, '')), 1, 600) AS detail,
  CASE WHEN source NOT IN (SELECT service FROM services) THEN ident || ': source ''' || source || ''' is not a declared service'
    WHEN kind NOT IN ('architecture', 'deployment', 'log', 'metric') THEN ident || ': source_type ''' || kind || ''' is not one of architecture, deployment, log, metric' END AS reason
  FROM (SELECT *, coalesce(nullif(id, ''), 'synth-' || CASE WHEN pos < 1000 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END) AS ident, coalesce(nullif(source_type, ''), 'log') AS kind FROM payload)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.sql(spark, PAYLOAD_SQL, telemetry=adapters.telemetry(spark, sf_dir))
    declared = rows.select("incident_key").distinct().withColumn("one", F.lit(1)).join(adapters.services(spark, sf_dir).withColumn("one", F.lit(1)), "one")
    return quality.gate(rows, declared, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT incident_key, pos, id, source_type, source, ts, detail, reason FROM gated")
def b14_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)


@query("SELECT incident_key, count(*) AS n FROM gated WHERE reason IS NULL GROUP BY ALL HAVING count(*) >= 4")
def b14_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted(gated(spark, sf_dir)).groupBy("incident_key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT incident_key, service, string_agg(dependency, ',' ORDER BY ord) AS depends_on FROM (SELECT t.incident_key, e.service, e.dependency, e.ord FROM (SELECT DISTINCT incident_key, source FROM telemetry WHERE source_type = 'deployment') t
  JOIN service_edges e ON e.service = t.source JOIN (SELECT DISTINCT incident_key, source FROM telemetry WHERE source_type = 'deployment') d ON d.incident_key = t.incident_key AND d.source = e.dependency) GROUP BY ALL""")
def b15_declared_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident declares the services that were deployed in it."""
    declared = adapters.telemetry(spark, sf_dir).where("source_type = 'deployment'").select("incident_key", F.col("source").alias("service")).distinct()
    deps = adapters.service_edges(spark, sf_dir).groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dependency"))), lambda x: x["dependency"]).alias("depends_on"))
    return quality.declared_dependencies(declared.join(deps, "service", "left")).where(F.size("depends_on") > 0).select("incident_key", "service", ids("depends_on"))


S.STEPS["comparable"] = """SELECT incident_key, bool_or(n > 1 AND ((value >= b * 3 AND value - b >= 5) OR (b < 1 AND value >= 5) OR (b >= 5 AND value <= b / 3))) AS comparable FROM (
  SELECT *, first_value(value) OVER w AS b, row_number() OVER w AS n FROM (SELECT *, coalesce(nullif(metric, ''), substr(detail, 1, 40)) AS name FROM telemetry WHERE source_type = 'metric' AND value IS NOT NULL)
  WINDOW w AS (PARTITION BY incident_key, source, name ORDER BY ts, seq)) GROUP BY incident_key"""


@query("SELECT incident_key, comparable FROM comparable")
def d5_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.comparable(adapters.telemetry(spark, sf_dir))


@query(f"""SELECT incident_key, concat_ws('; ', CASE WHEN e < 60 THEN 'two error events' END, CASE WHEN NOT d THEN 'a deployment event' END, CASE WHEN NOT l THEN 'a logger on an error event' END,
  CASE WHEN NOT coalesce(comparable, false) THEN 'a comparable metric' END, CASE WHEN n < 330 THEN 'only ' || n || ' events' END) AS unmet
  FROM (SELECT incident_key, count(*) FILTER ({S.ERROR}) AS e, bool_or(source_type = 'deployment') AS d, bool_or({S.ERROR} AND coalesce(logger, '') <> '') AS l, count(*) AS n FROM telemetry GROUP BY ALL) LEFT JOIN comparable USING (incident_key)""")
def d4_evidence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unmet(adapters.telemetry(spark, sf_dir), errors=60, events=330)


# ---------------------------------------------------------------- trace

S.STEPS["stages"] = "SELECT service, t.stage, t.ord, t.modules FROM (SELECT DISTINCT service FROM services) s, (VALUES " + ", ".join(f"('{s}', {n}, {m})" for n, (s, m) in enumerate(adapters.STAGES)) + ") t(stage, ord, modules)"
S.STEPS["stage_edges"] = "SELECT service, t.src, t.dst, t.ord FROM (SELECT DISTINCT service FROM services) s, (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for n, (a, b) in enumerate(adapters.STAGE_EDGES)) + ") t(src, dst, ord)"
S.STEPS["named_logs"] = r"""SELECT *, coalesce(nullif(logger, ''), regexp_extract(detail, '\[([A-Za-z_][\w.]*)\]\s*$', 1)) AS name FROM telemetry WHERE source_type = 'log'"""
S.STEPS["logger_stages"] = """SELECT service, logger, coalesce(s1, s2) AS stage FROM (SELECT DISTINCT source AS service, name AS logger FROM named_logs WHERE name <> '') l
  LEFT JOIN (SELECT service AS sv, lg, arg_min(stage, (-length(p), ord)) AS s1 FROM (SELECT l.service, l.logger AS lg, s.stage, s.ord, p FROM (SELECT DISTINCT source AS service, name AS logger FROM named_logs) l JOIN (SELECT service, stage, ord, unnest(modules) AS p FROM stages) s
      ON l.service = s.service AND (l.logger = p OR starts_with(l.logger, p || '.'))) GROUP BY ALL) a ON a.sv = l.service AND a.lg = l.logger
  LEFT JOIN (SELECT service AS sv2, stage AS s2, replace(stage, '_', '-') AS last FROM stages) b ON b.sv2 = l.service AND b.last = replace(string_split(l.logger, '.')[-1], '_', '-')
  WHERE coalesce(s1, s2) IS NOT NULL"""
S.STEPS["staged"] = f"""SELECT t.incident_key, t.source AS service, g.stage, t.ts, t.seq, t.id, t.detail, {S.ERROR} AS error FROM named_logs t JOIN origins o ON o.incident_key = t.incident_key AND o.source = t.source
  JOIN logger_stages g ON g.service = t.source AND g.logger = t.name WHERE {S.gap('t.ts', 'o.ts')} >= -900"""
S.STEPS["failing"] = "SELECT incident_key, stage AS failing, detail AS failing_detail, id AS f_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ts, seq) AS n FROM staged WHERE error) WHERE n = 1"
S.STEPS["stage_walk"] = """SELECT service, 'gate' AS node, ['gate'] AS path, CAST([] AS INTEGER[]) AS ords FROM (SELECT DISTINCT service FROM services)
  UNION ALL SELECT w.service, e.dst, list_append(w.path, e.dst), list_append(w.ords, e.ord) FROM stage_walk w JOIN stage_edges e ON e.service = w.service AND e.src = w.node WHERE NOT list_contains(w.path, e.dst)"""
S.STEPS["stage_paths"] = "SELECT service, node, path FROM (SELECT *, row_number() OVER (PARTITION BY service, node ORDER BY len(path), ords) AS n FROM stage_walk) WHERE n = 1"
S.STEPS["traced"] = """SELECT incident_key, service, stage, ord, failing, path, CASE WHEN cut THEN 'not-reached' ELSE base END AS status,
    CASE WHEN cut THEN 'never ran — the request died upstream' WHEN stage = failing THEN failing_detail WHEN ids IS NOT NULL AND on_path THEN coalesce(first_detail, 'reported telemetry during the traversal') WHEN ids IS NOT NULL THEN coalesce(first_detail, '')
      WHEN on_path THEN 'on the traversed path; no telemetry of its own' WHEN failing IS NOT NULL THEN 'not on the traced request path' ELSE '' END AS detail, coalesce(ids, []) AS evidence_ids
  FROM (SELECT *, behind AND base IN ('dormant', 'inferred', 'unknown') AS cut FROM (
    SELECT i.*, s.stage, s.ord, e.ids, e.first_detail, list_contains(path, s.stage) AS on_path, EXISTS (SELECT 1 FROM stage_edges g WHERE g.service = i.service AND g.src = i.failing AND g.dst = s.stage) AS behind,
      CASE WHEN s.stage = failing THEN 'failed' WHEN e.ids IS NOT NULL THEN 'ok' WHEN list_contains(path, s.stage) THEN 'inferred' WHEN failing IS NOT NULL THEN 'dormant' ELSE 'unknown' END AS base
    FROM (SELECT o.incident_key, o.source AS service, f.failing, f.failing_detail, CASE WHEN f.failing IS NULL THEN [] ELSE coalesce(p.path, ['gate', f.failing]) END AS path
        FROM origins o LEFT JOIN failing f USING (incident_key) LEFT JOIN stage_paths p ON p.service = o.source AND p.node = f.failing WHERE o.incident_key IN (SELECT incident_key FROM staged)) i
    JOIN stages s ON s.service = i.service
    LEFT JOIN (SELECT g.incident_key, g.stage, list(g.id ORDER BY g.ts, g.seq) AS ids, arg_min(g.detail, (g.ts, g.seq)) FILTER (g.id IS DISTINCT FROM f.f_id) AS first_detail FROM staged g LEFT JOIN failing f USING (incident_key) GROUP BY ALL) e
      ON e.incident_key = i.incident_key AND e.stage = s.stage))"""


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = signals.origins(upto_signals(spark, sf_dir)[2])
    return trace.trace(adapters.telemetry(spark, sf_dir), origin, adapters.stages(spark, sf_dir), adapters.stage_edges(spark, sf_dir))


@query("SELECT service, logger, stage FROM logger_stages")
def c7_stage_of_logger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.functions.text import event_logger

    loggers = adapters.telemetry(spark, sf_dir).where("source_type = 'log'").select(F.col("source").alias("service"), event_logger("logger", "detail").alias("logger"))
    return trace.stage_of_logger(loggers, adapters.stages(spark, sf_dir))


@query("SELECT service, node, array_to_string(path, '>') AS path FROM stage_paths")
def h6_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = trace.entry_stages(adapters.stages(spark, sf_dir), adapters.stage_edges(spark, sf_dir)).select("service", F.col("entry").alias("start"))
    return trace.shortest_paths(adapters.stage_edges(spark, sf_dir), starts).select("service", "node", F.array_join("path", ">").alias("path"))


@query("SELECT DISTINCT service, 'gate' AS entry FROM services")
def h8_entry_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.entry_stages(adapters.stages(spark, sf_dir), adapters.stage_edges(spark, sf_dir))


@query("SELECT incident_key, service, stage, ord, status, detail, array_to_string(evidence_ids, ',') AS evidence_ids FROM traced")
def h7_e12_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced(spark, sf_dir).select("incident_key", "service", "stage", "ord", "status", "detail", ids())


@query("""SELECT DISTINCT incident_key, service, failing AS failing_stage, 'Request traced through ' || greatest(0, len(path) - 1) || ' stage(s) inside ' || service || '; ' || coalesce('failed at ' || failing || '.', 'no failing stage attributable.') AS summary FROM traced""")
def h7_trace_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.summaries(traced(spark, sf_dir)).drop("path")


# ---------------------------------------------------------------- catalog

ENTRY_SQL = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN '{"prefix": ' ELSE '{"prefix": "' || source || '-' || doc_id || '", "lang": "' || lang || '", "n": ' || n_chars || '}' END AS value FROM documents"""
S.STEPS["entries"] = ENTRY_SQL


@query("SELECT doc_id, source || '-' || doc_id AS prefix, lang, n_chars AS n FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0")
def a13_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.sql(spark, ENTRY_SQL, documents=adapters.table(spark, sf_dir, "documents"))
    return catalog.entries(rows, "value", "doc_id")


@query("""SELECT prefix, 'https://b/' || prefix || '/poster.jpg' AS poster_url, 'https://b/' || prefix || '/replay.mp4' AS video_url, 'https://b/' || prefix || '/analysis.json' AS analysis_url
  FROM (SELECT source || '-' || doc_id AS prefix FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0)""")
def a14_catalog_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.with_urls(a13_catalog(spark, sf_dir), "https://b")
    return found.select("prefix", "poster_url", "video_url", F.col("files")["analysis.json"].alias("analysis_url"))


@query("SELECT incident_key, round(max(confidence), 6) AS leading_confidence, (SELECT n_events FROM facts f WHERE f.incident_key = h.incident_key) AS evidence_count, string_agg(status, ',' ORDER BY rank) AS statuses, coalesce((SELECT count(*) FROM gaps g WHERE g.incident_key = h.incident_key), 0) AS gap_count FROM hypotheses h GROUP BY incident_key")
def d9_catalog_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    return catalog.facts(s["facts"], s["hypotheses"], s["gaps"]).withColumns({"leading_confidence": F.round("leading_confidence", 6), "statuses": F.array_join("statuses", ",")})


@query("SELECT conv_id, count(*) AS step_count, string_agg(DISTINCT role, ',' ORDER BY role) AS step_types FROM conversations GROUP BY conv_id")
def d10_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a manifest with its turns as steps."""
    steps = adapters.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("step_type"))).alias("steps"))
    return catalog.manifest_summary(steps, "conv_id", "steps", {"step_types": "step_type"}).withColumn("step_types", F.array_join("step_types", ","))


SETS = {"providers": "provider", "models": "model", "modalities": "modality", "step_types": "step_type"}
STEP_SQL = """SELECT conv_id, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'p' || CAST(conv_id % 3 AS STRING) WHEN 2 THEN 'p9' END AS provider, 'm' || CAST(turn % 3 AS STRING) AS model,
  CASE WHEN length(text) % 2 = 0 THEN 'audio' WHEN turn % 2 = 0 THEN 'video' END AS modality, role AS step_type FROM conversations"""
S.STEPS["manifest_steps"] = STEP_SQL


@query("SELECT conv_id, count(*) AS step_count, " + ", ".join(f"coalesce(string_agg(DISTINCT {f}, ',' ORDER BY {f}) FILTER ({f} <> ''), '') AS {name}" for name, f in SETS.items()) + " FROM manifest_steps GROUP BY conv_id")
def d10_manifest_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers, models, modalities and step types of each conversation's steps; some steps lack one or have an empty one."""
    rows = adapters.sql(spark, STEP_SQL, conversations=adapters.table(spark, sf_dir, "conversations"))
    steps = rows.groupBy("conv_id").agg(F.collect_list(F.struct(*SETS.values())).alias("steps"))
    return catalog.manifest_summary(steps, "conv_id", "steps", SETS).withColumns({name: F.array_join(name, ",") for name in SETS})

