"""Registered queries of the incident operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as X
from emberline.operators import graph, report, signals
from emberline.plans import sql as S
from emberline.plans.reconstruct import reconstruct
from emberline.sources import adapters

SETTINGS = signals.Settings(fold=S.FOLD, near=S.NEAR, mid=S.MID, look_back=S.LOOK_BACK)
SYSTEM = "platform"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, steps: bool = True):
    """Register a function under its name, with SQL over the steps of ``plans.sql`` and the driver's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = S.with_(sql) if steps else sql
        return f

    return add


def star(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    return reconstruct(adapters.telemetry(spark, sf_dir) if rows is None else rows, adapters.services(spark, sf_dir), adapters.service_edges(spark, sf_dir), SETTINGS, SYSTEM)


def upto_signals(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = adapters.telemetry(spark, sf_dir) if rows is None else rows
    found = graph.cut(signals.anomalies(rows))
    classified = signals.classify(rows, graph.cut(signals.first_trouble(rows, found)))
    return classified, found, graph.cut(signals.failure_signals(classified, found, SETTINGS))


def ids(column: str = "evidence_ids"):
    return F.array_join(column, ",").alias(column)


# ---------------------------------------------------------------- scalar functions over telemetry


@query(f"SELECT id, {S.NAME} AS name, {S.VALUE} AS v FROM telemetry")
def b1_b2_metric_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).select("id", X.metric_name("metric", "detail").alias("name"), X.metric_value("value", "detail").alias("v"))


@query(f"SELECT id, {S.IS_CHANGE} AS is_change, {S.IS_RECOVERY} AS is_recovery, {S.IS_POLICY} AS is_policy FROM telemetry")
def b3_b4_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).select("id", X.is_change("source_type", "detail").alias("is_change"), X.is_recovery("detail").alias("is_recovery"), X.is_policy_rejection("detail").alias("is_policy"))


@query(r"SELECT id, coalesce(nullif(logger, ''), regexp_extract(detail, '\[([A-Za-z_][\w.]*)\]\s*$', 1)) AS logger FROM telemetry")
def b9_event_logger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).select("id", X.event_logger("logger", "detail").alias("logger"))


@query(f"""SELECT id, {S.label('detail', X.MECHANISMS, "'" + X.NO_MECHANISM + "'")} AS mechanism FROM telemetry""")
def b10_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).select("id", X.mechanism("detail").alias("mechanism"))


@query(f"SELECT incident_key, a.id AS change_id, b.source, {S.affinity('a.detail', 'b.summary')} AS affinity FROM classified a JOIN signals b USING (incident_key) WHERE a.signal = 'change' AND b.is_hard AND a.source = b.source")
def b11_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _, signal = upto_signals(spark, sf_dir)
    pairs = classified.where("signal = 'change'").select("incident_key", F.col("id").alias("change_id"), "source", "detail").join(signal.where("is_hard").select("incident_key", "source", "summary"), ["incident_key", "source"])
    return pairs.select("incident_key", "change_id", "source", X.affinity("detail", "summary").alias("affinity"))


@query(f"SELECT doc_id, {S.clip('text', 110)} AS short, {S.clip('text', 60)} AS shorter FROM documents WHERE text IS NOT NULL")
def b12_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.clip("text", 110).alias("short"), X.clip("text", 60).alias("shorter"))


@query("SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(trim(coalesce(text, '')), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 48), ''), 'service') AS name FROM documents")
def b13_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of documents' whole texts."""
    return adapters.table(spark, sf_dir, "documents").select("doc_id", X.safe_name("text").alias("name"))


@query(r"""SELECT id, logger, array_to_string(list_slice(string_split(logger, '.'), 1, 2), '.') AS package,
  CASE WHEN starts_with(logger, 'app.') THEN substr(logger, 5) ELSE string_split(logger, '.')[-1] END AS label FROM telemetry WHERE logger IS NOT NULL""")
def b17_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).where("logger is not null").select("id", "logger", X.package("logger").alias("package"), X.relative_label("logger", F.lit("app")).alias("label"))


@query(r"""SELECT page_id, host, CASE WHEN ends_with(l, 'gateway') THEN translate(lower(trim(l)), '_ ', '--') ELSE translate(lower(trim(l)), '_ ', '--') || '-gateway' END AS node,
  trim(translate(lower(regexp_replace(camel, '([a-z0-9])([A-Z])', '\1-\2', 'g')), '_', '-'), '-') AS kebab
  FROM (SELECT page_id, host, split_part(host, '.', 1) AS l, regexp_extract(url, '[^/]*$') || 'NodeStage_A' || page_id AS camel FROM (SELECT page_id, url, regexp_extract(url, 'https?://([a-zA-Z0-9.\-]+)', 1) AS host FROM pages) p)""")
def b19_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"https?://([a-zA-Z0-9.\-]+)", 1).alias("host"), F.concat(F.regexp_extract("url", "[^/]*$", 0), F.lit("NodeStage_A"), F.col("page_id").cast("string")).alias("camel"))
    return p.select("page_id", "host", X.gateway("host").alias("node"), X.kebab("camel").alias("kebab"))


@query(r"""SELECT id, list_filter(list_transform(regexp_extract_all(detail, '''([^'']+)''|"([^"]+)"'), lambda q: trim(q[2:-2])), lambda v: length(v) >= 5 AND NOT contains(v, ' ') AND regexp_matches(v, '[./:]'))[1] AS value FROM telemetry""")
def b20_offending_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).select("id", X.offending_value("detail").alias("value"))


SENTENCE = "CASE WHEN contains(trim(detail), '. ') THEN split_part(trim(detail), '. ', 1) ELSE split_part(trim(detail), '; ', 1) END"


@query(f"""SELECT id, CASE WHEN {S.IS_POLICY} THEN 'The gateway rejected the configured model because it is not allowed for the active virtual key'
  WHEN contains(lower(detail), 'model identifier is invalid') OR (contains(lower(detail), 'validationexception') AND contains(lower(detail), 'model') AND regexp_matches(lower(detail), 'invalid|not found')) THEN 'The model provider rejected the configured model identifier as invalid'
  ELSE {SENTENCE} END AS spoken,
  regexp_matches(lower(detail), 'model_id|model id') AND regexp_matches(lower(detail), 'config|environment variable') AND regexp_matches(lower(detail), 'set|change|updated') AS is_config FROM telemetry""")
def b21_spoken_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.telemetry(spark, sf_dir).select("id", X.spoken_failure("detail").alias("spoken"), X.is_configuration_change("detail").alias("is_config"))


# ---------------------------------------------------------------- anomalies, classes, signals, origin


@query("SELECT incident_key, id, source, name, v, baseline, description, recovered FROM anomalies")
def e1_e3_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.anomalies(adapters.telemetry(spark, sf_dir)).select("incident_key", "id", "source", "name", "v", "baseline", "description", "recovered")


@query("SELECT incident_key, source, name, count(*) AS points, min(v) AS low, max(v) AS high FROM points GROUP BY ALL")
def d1_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = signals.metric_points(adapters.telemetry(spark, sf_dir))
    return points.groupBy("incident_key", "source", "name").agg(F.count(F.lit(1)).alias("points"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("SELECT incident_key, trouble FROM trouble")
def d2_first_trouble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.telemetry(spark, sf_dir)
    return signals.first_trouble(rows, signals.anomalies(rows))


@query("SELECT incident_key, id, signal FROM classified")
def k1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upto_signals(spark, sf_dir)[0].select("incident_key", "id", "signal")


@query("SELECT incident_key, source, ts, seq, id, kind, text FROM items WHERE kind < 2")
def g1_hard_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, found, _ = upto_signals(spark, sf_dir)
    return signals.hard_items(classified, found).select("incident_key", "source", "ts", "seq", "id", "kind", "text")


@query("SELECT incident_key, source, ts, summary, array_to_string(evidence_ids, ',') AS evidence_ids, is_hard, has_error FROM signals")
def d3_failure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upto_signals(spark, sf_dir)[2].select("incident_key", "source", "ts", "summary", ids(), "is_hard", "has_error")


@query("""SELECT DISTINCT incident_key, source FROM (SELECT incident_key, source, unnest(evidence_ids) AS id FROM signals) s
  WHERE (incident_key, id) IN (SELECT incident_key, id FROM classified WHERE signal = 'failure' UNION SELECT incident_key, id FROM anomalies WHERE NOT recovered)""")
def c2_hard_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, found, signal = upto_signals(spark, sf_dir)
    known = classified.where("signal = 'failure'").select("incident_key", "id").union(found.where("not recovered").select("incident_key", "id"))
    named = signal.select("incident_key", "source", F.explode("evidence_ids").alias("id"))
    return named.join(known, ["incident_key", "id"], "left_semi").select("incident_key", "source").distinct()


@query("SELECT incident_key, source, ts, summary FROM origins")
def f1_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.origins(upto_signals(spark, sf_dir)[2]).select("incident_key", "source", "ts", "summary")


@query("SELECT incident_key FROM (SELECT DISTINCT incident_key FROM telemetry) t WHERE incident_key NOT IN (SELECT incident_key FROM origins)")
def k7_no_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _, signal = upto_signals(spark, sf_dir)
    return classified.select("incident_key").distinct().join(signals.origins(signal), "incident_key", "left_anti")


FLAGSHIP = """SELECT o.incident_key, o.source AS origin, o.ts AS origin_ts, c.change_id, c.change_source, c.gap, c.affinity, round(c.score, 6) AS score
  FROM origins o LEFT JOIN changes c ON o.incident_key = c.incident_key"""


@query(FLAGSHIP)
def c1_change_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _, signal = upto_signals(spark, sf_dir)
    origin = signals.origins(signal)
    best = signals.correlate(classified.where("signal = 'change'"), origin, SETTINGS)
    rows = origin.select("incident_key", F.col("source").alias("origin"), F.col("ts").alias("origin_ts")).join(best, "incident_key", "left")
    return rows.select("incident_key", "origin", "origin_ts", "change_id", "change_source", "gap", "affinity", F.round("score", 6).alias("score"))


@query("SELECT t.incident_key, t.id, t.detail FROM telemetry t JOIN (SELECT incident_key, unnest(evidence_ids) AS id FROM signals) s ON t.incident_key = s.incident_key AND t.id = s.id")
def c3_linked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _, signal = upto_signals(spark, sf_dir)
    named = signal.select("incident_key", F.explode("evidence_ids").alias("id"))
    return classified.join(named, ["incident_key", "id"]).select("incident_key", "id", "detail")


@query(f"""SELECT id, source, ts, errors FROM (SELECT id, source, ts, count(*) OVER (PARTITION BY source ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECONDS PRECEDING AND CURRENT ROW) AS errors FROM telemetry WHERE {S.ERROR}) WHERE errors >= 3""")
def i1_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.bursts(adapters.telemetry(spark, sf_dir), 3, 21600)


@query("SELECT source, id, n FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS n FROM telemetry) WHERE n <= 40")
def f9_newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("seq"))
    return adapters.telemetry(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 40").select("source", "id", "n")


# ---------------------------------------------------------------- report


@query("SELECT incident_key, step, from_service, to_service, mechanism, array_to_string(evidence_ids, ',') AS evidence_ids FROM propagation")
def h1_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["propagation"].select("incident_key", "step", "from_service", "to_service", "mechanism", ids())


@query("SELECT incident_key, 0 AS place, source AS service FROM origins UNION ALL SELECT incident_key, step, to_service FROM propagation")
def h2_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["affected"]


@query("SELECT incident_key, source, ts, summary, is_hard FROM impacts")
def c6_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["impacts"].select("incident_key", "source", "ts", "summary", "is_hard")


@query("SELECT incident_key, started_at, detected_at FROM facts")
def k6_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["facts"].select("incident_key", "started_at", "detected_at")


@query("SELECT incident_key, recovered, backlog, has_metric, has_audit, n_events FROM facts")
def d13_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["facts"].select("incident_key", "recovered", "backlog", "has_metric", "has_audit", "n_events")


SILENT = """SELECT incident_key, string_agg(service, ', ' ORDER BY service) AS silent FROM (SELECT f.incident_key, s.service FROM facts f CROSS JOIN (SELECT DISTINCT service FROM services) s
  WHERE (f.incident_key, s.service) NOT IN (SELECT incident_key, source FROM telemetry)) GROUP BY incident_key"""
S.STEPS["silent"] = SILENT


@query("SELECT incident_key, silent FROM silent")
def c5_silent_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    return report.silent_services(s["classified"], s["facts"], adapters.services(spark, sf_dir))


S.STEPS["healthy"] = """SELECT f.incident_key, coalesce(b.ts, f.ts) AS ts, coalesce(b.src, []) AS src, list_concat(coalesce(b.ids, []), CASE WHEN a.id IS NULL THEN [] ELSE [a.id] END) AS ids
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ts, source) AS n FROM signals WHERE incident_key IN (SELECT incident_key FROM facts)) WHERE n = 1) f
  LEFT JOIN (SELECT incident_key, min(ts) AS ts, list_sort(list_distinct(list(source))) AS src, list(id ORDER BY n) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ts, seq) AS n FROM classified WHERE signal = 'baseline') WHERE n <= 2 GROUP BY incident_key) b USING (incident_key)
  LEFT JOIN (SELECT incident_key, id FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ts, series_ts, series_seq, seq) AS n FROM anomalies WHERE NOT recovered AND baseline IS NOT NULL) WHERE n = 1) a USING (incident_key)
  WHERE b.ids IS NOT NULL OR a.id IS NOT NULL"""
S.STEPS["recovering"] = """SELECT incident_key, min(ts) AS ts, list_sort(list_distinct(list(source))) AS src, list(id ORDER BY k, ts, u, seq) AS ids FROM (
    SELECT incident_key, source, ts, 0 AS k, ts AS u, seq, id FROM classified WHERE signal = 'recovery' UNION ALL SELECT incident_key, source, ts, 1, series_ts, seq, id FROM anomalies WHERE recovered)
  WHERE incident_key IN (SELECT incident_key FROM facts) GROUP BY incident_key"""
S.STEPS["frames"] = f"""SELECT incident_key, 0 AS kind, 0 AS x, '' AS y, ts, 'System healthy' AS title, 'Telemetry before the incident shows normal behavior.' AS description, 'info' AS severity, src AS services, ids AS evidence_ids FROM healthy
  UNION ALL SELECT incident_key, 1, seq, '', ts, 'Change on ' || source, {S.clip('detail', 110)}, 'warning', [source], [id] FROM classified WHERE signal = 'change' AND incident_key IN (SELECT incident_key FROM facts)
  UNION ALL SELECT s.incident_key, 2, 0, s.source, s.ts, s.source || ': ' || {S.clip('summary', 60)}, {S.clip('summary', 160)},
    CASE WHEN coalesce(v.user_facing, false) OR row_number() OVER (PARTITION BY s.incident_key ORDER BY s.ts, s.source) = 1 OR has_error THEN 'critical' ELSE 'warning' END, [s.source], s.evidence_ids
    FROM signals s LEFT JOIN services v ON v.service = s.source WHERE s.incident_key IN (SELECT incident_key FROM facts)
  UNION ALL SELECT incident_key, 3, 0, '', impact_ts, 'Customer impact', {S.clip("('User-facing failures on ' || impact || ': ' || impact_summary)", 160)}, 'critical', [impact], impact_evidence FROM facts WHERE impact IS NOT NULL
  UNION ALL SELECT incident_key, 4, 0, '', ts, 'Recovery', 'Recovery signals observed; key metrics returned toward baseline.', 'recovery', src, ids FROM recovering"""
S.STEPS["timeline"] = "SELECT incident_key, row_number() OVER (PARTITION BY incident_key ORDER BY ts, kind, x, y) - 1 AS idx, ts, title, description, severity, services, evidence_ids FROM frames"


@query("SELECT incident_key, idx, ts, title, description, severity, array_to_string(services, ',') AS services, array_to_string(evidence_ids, ',') AS evidence_ids FROM timeline")
def k2_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["timeline"].select("incident_key", "idx", "ts", "title", "description", "severity", ids("services"), ids())


S.STEPS["hypotheses"] = f"""SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY confidence DESC, o) AS rank FROM (
  SELECT incident_key, 0 AS o, 'Likely cause: gateway model-policy rejection on ' || origin AS title, CAST(0.92 AS DOUBLE) AS confidence, 'inferred' AS status,
    'The logged 403 response explicitly reports a model-policy rejection: the requested model is not allowed for the active virtual key. This strongly supports an allow-list or configured-model mismatch, but the supplied evidence does not establish which configuration is wrong.' AS explanation, policy_ids AS evidence_ids FROM facts WHERE len(policy_ids) > 0
  UNION ALL SELECT incident_key, 1, 'Root cause: change on ' || change_source || ' — ' || {S.clip('change_detail', 70)}, score, 'inferred',
    'The change preceded the first failure on ' || origin || ' by about ' || greatest(1, CAST(round_even(gap / 60, 0) AS INTEGER)) || ' minute(s), and the failure signature matches the change' || coalesce(' (' || affinity || ' pattern)', '') || '. Correlation is strong but not proof.', list_concat([change_id], origin_evidence) FROM facts WHERE change_id IS NOT NULL
  UNION ALL SELECT incident_key, 2, 'Root cause: unexplained failure originating at ' || origin, CAST(0.45 AS DOUBLE), 'inferred', origin || ' shows the earliest failure signal, but no deployment or change event was found in the supplied telemetry to explain it.', origin_evidence FROM facts WHERE change_id IS NULL AND len(policy_ids) = 0
  UNION ALL SELECT incident_key, 3, 'Failure propagated along the dependency graph: ' || origin || ' → ' || array_to_string(chain, ' → '), least(CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * steps, CAST(0.88 AS DOUBLE)), 'inferred', 'Each downstream service shows failure signals after its upstream dependency, in an order consistent with the architecture graph.', step_evidence FROM facts WHERE steps > 0
  UNION ALL SELECT incident_key, 4, 'Customer-facing impact', CAST(0.99 AS DOUBLE), 'confirmed', {S.clip("('Direct evidence from ' || impact || ': ' || impact_summary || '.')", 180)}, impact_evidence FROM facts WHERE impact IS NOT NULL
  UNION ALL SELECT incident_key, 5, 'Identity and mechanism of the credential change', CAST(0 AS DOUBLE), 'unknown', 'No audit logs are present, so who or what changed the credential cannot be established from this telemetry.', [] FROM facts WHERE affinity = 'credential' AND NOT has_audit
  UNION ALL SELECT incident_key, 6, 'Change record for the ' || change_source || ' change', CAST(0 AS DOUBLE), 'unknown', 'The change appears only in service logs. No deployment or change-management record was found to confirm what was altered.', [change_id] FROM facts WHERE change_type = 'log')"""


@query("SELECT incident_key, rank, title, round(confidence, 6) AS confidence, status, explanation, array_to_string(evidence_ids, ',') AS evidence_ids FROM hypotheses")
def k3_f2_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["hypotheses"].select("incident_key", "rank", "title", F.round("confidence", 6).alias("confidence"), "status", "explanation", ids())


S.STEPS["gaps"] = """SELECT incident_key, row_number() OVER (PARTITION BY incident_key ORDER BY o) - 1 AS pos, gap_text FROM (
  SELECT incident_key, 0 AS o, 'No telemetry received from: ' || silent AS gap_text FROM silent
  UNION ALL SELECT incident_key, 1, 'Database or IAM audit logs' FROM facts WHERE affinity = 'credential' AND NOT has_audit
  UNION ALL SELECT incident_key, 2, 'Secrets Manager version history' FROM facts WHERE affinity = 'credential' AND contains(lower(change_detail), 'secret')
  UNION ALL SELECT incident_key, 3, 'Deployment and change history for the affected services' FROM facts WHERE change_id IS NULL
  UNION ALL SELECT incident_key, 4, 'Change-management record for the ' || change_source || ' change' FROM facts WHERE change_type = 'log'
  UNION ALL SELECT incident_key, 5, 'Metrics (only logs were supplied)' FROM facts WHERE NOT has_metric)"""


@query("SELECT incident_key, pos, gap_text FROM gaps")
def k4_missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["gaps"]


S.STEPS["actions"] = f"""SELECT incident_key, row_number() OVER (PARTITION BY incident_key ORDER BY o) AS priority, action, reason, risk FROM (
  SELECT incident_key, 0 AS o, 'Verify the gateway model allow-list for the active virtual key and compare it with the model ID configured on ' || origin || '.' AS action, 'The observed 403 identifies a model-policy rejection, but does not distinguish an allow-list issue from a configured-model mismatch.' AS reason, 'Read-only configuration verification. Low risk.' AS risk FROM facts WHERE len(policy_ids) > 0
  UNION ALL SELECT incident_key, 1, 'Confirm ' || origin || ' and user-facing metrics are stable at baseline for at least 30 minutes.', 'Recovery signals are present but sustained stability is unverified.', 'Read-only verification. Low risk.' FROM facts WHERE recovered
  UNION ALL SELECT incident_key, 2, 'Add a warm-up step to the ' || origin || ' restart runbook before it takes traffic.', 'A cold restart triggered the miss storm that caused the incident.', 'Process change only. Low risk.' FROM facts WHERE recovered AND affinity = 'capacity'
  UNION ALL SELECT incident_key, 3, 'Add request coalescing or stale-while-revalidate so a cold cache cannot stampede the backing store.', 'Downstream services absorbed the full miss load during the incident.', 'Code change. Medium risk; ship behind a flag.' FROM facts WHERE recovered AND affinity = 'capacity'
  UNION ALL SELECT incident_key, 4, 'Write the postmortem while evidence links in this analysis are fresh.', 'The reconstruction above lists confirmed facts, hypotheses and evidence gaps to fill.', 'No production risk.' FROM facts WHERE recovered
  UNION ALL SELECT incident_key, 5, 'Compare the credential configured on ' || change_source || ' with what the rejecting dependency expects (database, API gateway or external service), including the auth scheme it wants the credential sent under.', 'The failure began minutes after a credential change.', 'Read-only validation. Low risk.' FROM facts WHERE NOT recovered AND len(policy_ids) = 0 AND affinity = 'credential'
  UNION ALL SELECT incident_key, 6, 'Run a read-only authentication test from the ' || origin || ' environment with a restricted identity.', 'Confirms the credential mismatch before any rollback.', 'Low risk with a restricted test identity.' FROM facts WHERE NOT recovered AND len(policy_ids) = 0 AND affinity = 'credential'
  UNION ALL SELECT incident_key, 7, 'Roll back ' || change_source || ' to the last known-good version, after human approval.', 'The service was healthy before this change.', 'Medium risk. Validate compatibility first.' FROM facts WHERE NOT recovered AND len(policy_ids) = 0 AND affinity = 'credential'
  UNION ALL SELECT incident_key, 8, 'Review the change on ' || change_source || ' (' || {S.clip('change_detail', 60)} || ') against the first failure signature.', 'It is the closest change preceding the failure.', 'Read-only review. Low risk.' FROM facts WHERE NOT recovered AND len(policy_ids) = 0 AND change_id IS NOT NULL AND affinity IS DISTINCT FROM 'credential'
  UNION ALL SELECT incident_key, 9, 'Prepare a revert of the ' || change_source || ' change, pending human approval.', 'Reverting the correlated change is the fastest probable fix.', 'Medium risk. Confirm the correlation first.' FROM facts WHERE NOT recovered AND len(policy_ids) = 0 AND change_id IS NOT NULL AND affinity IS DISTINCT FROM 'credential'
  UNION ALL SELECT incident_key, 10, 'Inspect ' || origin || ' directly: resource limits, dependency health and recent alerts.', 'No correlated change was found, so start at the earliest failing service.', 'Read-only investigation. Low risk.' FROM facts WHERE NOT recovered AND len(policy_ids) = 0 AND change_id IS NULL
  UNION ALL SELECT incident_key, 11, 'After the root cause is fixed, drain accumulated queue backlog gradually.', 'A sudden drain can recreate the saturation this incident caused.', 'Medium risk. Rate-limit and watch worker utilization.' FROM facts WHERE NOT recovered AND backlog)"""


@query("SELECT incident_key, priority, action, reason, risk FROM actions")
def k5_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["actions"]


S.STEPS["texts"] = f"""SELECT f.incident_key, 'INC-' || strftime(f.started_at, '%Y%m%d') || '-' || substr(sha1('{SYSTEM}:' || origin || ':' || {S.iso('f.started_at')}), 1, 6) AS incident_id,
  coalesce(impact || ' failures', origin || ' failure') || coalesce(' after ' || change_source || CASE WHEN change_type = 'deployment' THEN ' deployment' ELSE ' change' END, '') || ' ({SYSTEM})' AS title,
  concat_ws(' ', 'At ' || strftime(change_ts, '%H:%M') || ' UTC, ' || change_source || ': ' || {S.clip('change_detail', 90)},
    'First failure at ' || strftime(origin_ts, '%H:%M') || ' UTC on ' || origin || ': ' || {S.clip('origin_summary', 100)} || '.',
    CASE WHEN steps > 0 THEN 'Propagation: ' || origin || ' → ' || array_to_string(chain, ' → ') || '.' END, 'Impact: ' || impact_text,
    CASE WHEN recovered THEN 'Recovery signals from ' || strftime(r.ts, '%H:%M') || ' UTC.' END, 'First: ' || a.action) AS engineer_briefing,
  'The {SYSTEM} experienced a customer-affecting incident that evidence links to ' || coalesce('a change to ' || change_source, 'an unidentified trigger') || '. ' || impact_text || ' '
    || CASE WHEN recovered THEN 'The system has shown recovery signals; verification is in progress.' ELSE 'Mitigation steps are listed for engineering, pending human approval.' END AS executive_summary,
  list_concat(l.told, ['Strongest conclusion (' || h.status || ', ' || CAST(round_even(h.confidence * 100, 0) AS INTEGER) || '% confidence): ' || h.title || '.'], CASE WHEN a.action IS NULL THEN [] ELSE ['First recommended check: ' || a.action] END) AS replay_script
  FROM facts f JOIN impact_texts USING (incident_key) LEFT JOIN recovering r USING (incident_key) LEFT JOIN (SELECT * FROM actions WHERE priority = 1) a USING (incident_key)
  LEFT JOIN (SELECT * FROM hypotheses WHERE rank = 1) h USING (incident_key)
  LEFT JOIN (SELECT incident_key, list('At ' || strftime(ts, '%H:%M') || ' UTC — ' || title || '. ' || description ORDER BY idx) AS told FROM timeline GROUP BY incident_key) l USING (incident_key)"""


@query("SELECT incident_key, incident_id, title, engineer_briefing, executive_summary, array_to_string(replay_script, chr(10)) AS replay_script FROM texts")
def b22_b25_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["texts"].withColumn("replay_script", F.array_join("replay_script", "\n"))


@query("""SELECT incident_key, concat_ws(chr(10), '# ' || title, 'Incident ' || incident_id, '## Briefing', engineer_briefing, '## Hypotheses', h, '## Missing evidence', coalesce(g, 'none recorded'), '## Actions', a) AS report FROM texts
  LEFT JOIN (SELECT incident_key, string_agg('- ' || title || ' (' || status || ', ' || CAST(round_even(confidence * 100, 0) AS INTEGER) || '%)', chr(10) ORDER BY rank) AS h FROM hypotheses GROUP BY ALL) USING (incident_key)
  LEFT JOIN (SELECT incident_key, string_agg('- ' || gap_text, chr(10) ORDER BY pos) AS g FROM gaps GROUP BY ALL) USING (incident_key)
  LEFT JOIN (SELECT incident_key, string_agg(priority || '. ' || action, chr(10) ORDER BY priority) AS a FROM actions GROUP BY ALL) USING (incident_key)""")
def a12_briefings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir)["briefings"]


@query("""SELECT incident_key, id FROM (SELECT incident_key, unnest(evidence_ids) AS id FROM timeline UNION SELECT incident_key, unnest(evidence_ids) FROM hypotheses UNION SELECT incident_key, unnest(evidence_ids) FROM propagation) r
  WHERE (incident_key, id) NOT IN (SELECT incident_key, id FROM telemetry)""")
def c4_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty: every id that a report names is an event of its incident."""
    return star(spark, sf_dir)["dangling"]


@query("""SELECT incident_key, id FROM (SELECT incident_key, unnest(evidence_ids) AS id FROM signals UNION SELECT incident_key, id FROM anomalies) r
  EXCEPT SELECT incident_key, id FROM telemetry WHERE source_type = 'log'""")
def g2_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of signals that is no log event."""
    classified, found, signal = upto_signals(spark, sf_dir)
    named = signal.select("incident_key", F.explode("evidence_ids").alias("id")).union(found.select("incident_key", "id"))
    return named.subtract(classified.where("source_type = 'log'").select("incident_key", "id"))


@query("""SELECT f.incident_key, t.incident_id, t.title, f.started_at, f.detected_at, f.origin, f.change_id, round(f.score, 6) AS score, f.impact, f.steps, h.n AS hypotheses, g.n AS gaps, a.n AS actions, l.n AS frames
  FROM facts f JOIN texts t USING (incident_key) LEFT JOIN (SELECT incident_key, count(*) AS n FROM hypotheses GROUP BY ALL) h USING (incident_key) LEFT JOIN (SELECT incident_key, count(*) AS n FROM gaps GROUP BY ALL) g USING (incident_key)
  LEFT JOIN (SELECT incident_key, count(*) AS n FROM actions GROUP BY ALL) a USING (incident_key) LEFT JOIN (SELECT incident_key, count(*) AS n FROM timeline GROUP BY ALL) l USING (incident_key)""")
def k8_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    out = s["facts"].select("incident_key", "started_at", "detected_at", "origin", "change_id", F.round("score", 6).alias("score"), "impact", "steps").join(s["texts"].select("incident_key", "incident_id", "title"), "incident_key")
    for name, table in (("hypotheses", "hypotheses"), ("gaps", "gaps"), ("actions", "actions"), ("frames", "timeline")):
        out = out.join(s[table].groupBy("incident_key").agg(F.count(F.lit(1)).alias(name)), "incident_key", "left")
    return out


# ---------------------------------------------------------------- smaller incidents, of which some are quiet


def by_users(text: str) -> str:
    """The telemetry's SQL with an incident for each twenty-ninth of the users and day, so that services are silent and days quiet."""
    old, new = "CAST(CAST(ts AS DATE) AS STRING) AS incident_key", "CAST(CAST(ts AS DATE) AS STRING) || '-' || CAST(user_id % 29 AS STRING) AS incident_key"
    if old not in text:
        raise ValueError("no incident key to divide")
    return text.replace(old, new)


def divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.run(spark, sf_dir, by_users(adapters.TELEMETRY_SQL))


@query()
def c5_silent_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir, divided(spark, sf_dir))
    return report.silent_services(s["classified"], s["facts"], adapters.services(spark, sf_dir))


@query()
def k7_quiet_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified, _, signal = upto_signals(spark, sf_dir, divided(spark, sf_dir))
    return classified.select("incident_key").distinct().join(signals.origins(signal), "incident_key", "left_anti")


ORACLES["c5_silent_by_users"] = by_users(ORACLES["c5_silent_services"])
ORACLES["k7_quiet_by_users"] = by_users(ORACLES["k7_no_incident"])
