"""The reconstruction in DuckDB SQL: named steps, and ``with_`` to put those that a query needs before it."""

from __future__ import annotations

import re

from emberline.functions import text as X
from emberline.sources import adapters

# thresholds of the registered queries, in seconds: the driver's events lie minutes apart
FOLD, NEAR, MID, LOOK_BACK = 7200, 1800, 7200, 21600


def any_of(column: str, keywords: list[str]) -> str:
    return f"coalesce(regexp_matches(lower({column}), '{'|'.join(map(re.escape, keywords))}'), false)".replace("\\ ", " ")


def label(column: str, rules: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(column, k)} THEN '{n}'" for n, k in rules.items()) + f" ELSE {default} END"


def affinity(change: str, failure: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(change, a)} AND {any_of(failure, b)} THEN '{n}'" for n, (a, b) in X.AFFINITY.items()) + " END"


def clip(t: str, n: int) -> str:
    cut = f"substr({t}, 1, {n - 1})"
    inside = f"NOT regexp_matches(substr({t}, {n - 1}, 1), '\\s') AND NOT regexp_matches(substr({t}, {n}, 1), '\\s') AND contains({cut}, ' ')"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(CASE WHEN {inside} THEN regexp_replace({cut}, ' [^ ]*$', '') ELSE {cut} END, '[ ,;:-]+$', '') || '…' END"


def iso(t: str) -> str:
    return f"(strftime({t}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({t}) % 1000000 <> 0 THEN strftime({t}, '.%f') ELSE '' END || '+00:00')"


def gap(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6)"


ERROR = "coalesce(upper(level) IN ('ERROR', 'CRITICAL', 'FATAL'), false)"
NAME = r"coalesce(nullif(metric, ''), nullif(regexp_extract(detail, '^\s*([a-zA-Z0-9_.:-]+)\s*=', 1), ''), substr(detail, 1, 40))"
VALUE = r"coalesce(value, try_cast(nullif(regexp_extract(detail, '=\s*(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE))"
IS_CHANGE = f"(source_type = 'deployment' OR (source_type = 'log' AND {any_of('detail', X.CHANGE_KEYWORDS)}))"
IS_RECOVERY = any_of("detail", X.RECOVERY_KEYWORDS)
IS_POLICY = "(contains(lower(detail), 'model_blocked') OR (contains(lower(detail), 'model') AND contains(lower(detail), 'not allowed') AND contains(lower(detail), 'virtual key')))"
SINGLE = f"""CASE WHEN {any_of('name', ['error', 'fail', 'retr', 'auth'])} AND v >= 10 THEN 'elevated'
    WHEN {any_of('name', ['utilization', 'saturation'])} AND v >= 95 THEN 'saturated'
    WHEN {any_of('name', ['depth', 'backlog', 'queue'])} AND v >= 1000 THEN 'backlog above threshold'
    WHEN {any_of('name', ['latency', 'p95', 'p99'])} AND v >= 1000 THEN 'elevated latency' END"""

STEPS: dict[str, str] = {
    "telemetry": adapters.TELEMETRY_SQL,
    "services": adapters.SERVICES_SQL,
    "service_edges": adapters.EDGES_SQL,
    "links": adapters.LINKS_SQL,
    "points": f"SELECT * FROM (SELECT *, {NAME} AS name, {VALUE} AS v FROM telemetry WHERE source_type = 'metric') WHERE v IS NOT NULL",
    "based": """SELECT *, first_value(v) OVER w AS base, row_number() OVER w AS n, count(*) OVER (PARTITION BY incident_key, source, name) AS size,
        first_value(ts) OVER w AS series_ts, first_value(seq) OVER w AS series_seq
      FROM points WINDOW w AS (PARTITION BY incident_key, source, name ORDER BY ts, seq)""",
    "judged": f"""SELECT *, CASE WHEN size = 1 THEN {SINGLE} END AS why, ((v >= base * 3 AND v - base >= 5) OR (base < 1 AND v >= 5)) AS rose,
        n > 1 AND ((v >= base * 3 AND v - base >= 5) OR (base < 1 AND v >= 5) OR (base >= 5 AND v <= base / 3)) AS odd FROM based""",
    "seen": """SELECT *, coalesce(max(odd) OVER (PARTITION BY incident_key, source, name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM judged""",
    "anomalies": """SELECT incident_key, seq, id, source, ts, name, v, CASE WHEN why IS NULL THEN base END AS baseline,
        CASE WHEN why IS NOT NULL THEN name || ' ' || why || ' at ' || format('{:g}', v)
          WHEN odd THEN name || CASE WHEN rose THEN ' rose from ' ELSE ' fell from ' END || format('{:g}', base) || ' to ' || format('{:g}', v)
          ELSE name || ' returned to ' || format('{:g}', v) || ' (baseline ' || format('{:g}', base) || ')' END AS description,
        n > 1 AND NOT odd AND before AND abs(v - base) <= greatest(base * 0.5, 1) AS recovered, unit, series_ts, series_seq
      FROM seen WHERE odd OR why IS NOT NULL OR (n > 1 AND before AND abs(v - base) <= greatest(base * 0.5, 1))""",
    "trouble": f"""SELECT incident_key, min(ts) AS trouble FROM (
        SELECT incident_key, ts FROM telemetry WHERE source_type = 'log' AND {ERROR}
        UNION ALL SELECT incident_key, ts FROM anomalies WHERE NOT recovered) GROUP BY incident_key""",
    "classified": f"""SELECT t.*, trouble, CASE WHEN source_type = 'architecture' THEN NULL WHEN {IS_CHANGE} THEN 'change'
        WHEN source_type = 'log' AND {IS_RECOVERY} AND ts >= trouble THEN 'recovery' WHEN {ERROR} THEN 'failure'
        WHEN upper(level) IN ('WARN', 'WARNING') THEN 'warning'
        WHEN source_type = 'log' AND (trouble IS NULL OR ts < trouble) THEN 'baseline' END AS signal
      FROM telemetry t LEFT JOIN trouble USING (incident_key)""",
    "items": r"""SELECT incident_key, source, ts, 0 AS kind, ts AS o1, seq AS o2, seq, id, regexp_replace(detail, '\.+$', '') AS text FROM classified WHERE signal = 'failure'
      UNION ALL SELECT incident_key, source, ts, 1, series_ts, series_seq, seq, id, description FROM anomalies WHERE NOT recovered
      UNION ALL SELECT incident_key, source, ts, 2, ts, seq, seq, id, regexp_replace(detail, '\.+$', '') FROM classified WHERE signal = 'warning'""",
    "anchored": """SELECT *, first_value(ts) OVER w AS anchor, first_value(kind) OVER w < 2 AS is_hard, row_number() OVER w AS place FROM items
      WINDOW w AS (PARTITION BY incident_key, source ORDER BY kind = 2, ts, kind, o1, o2, seq)""",
    "folded": f"""SELECT *, row_number() OVER (PARTITION BY incident_key, source ORDER BY place) AS k FROM anchored WHERE abs({gap('ts', 'anchor')}) <= {FOLD}""",
    "signals": """SELECT incident_key, source, anchor AS ts, is_hard, bool_or(kind = 0) AS has_error, list(id ORDER BY k) AS evidence_ids,
        list_reduce(list(text ORDER BY k), lambda a, x: CASE WHEN length(a) < 140 THEN a || '; ' || x ELSE a END) AS summary
      FROM folded GROUP BY incident_key, source, anchor, is_hard""",
    "origins": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY ts, source) AS n FROM signals WHERE is_hard) WHERE n = 1",
    "near_changes": f"""SELECT c.*, {gap('o.ts', 'c.ts')} AS gap, o.source AS origin_source, {affinity('c.detail', 'o.summary')} AS affinity
      FROM classified c JOIN origins o ON c.incident_key = o.incident_key WHERE c.signal = 'change' AND {gap('o.ts', 'c.ts')} BETWEEN 0 AND {LOOK_BACK}""",
    "scored": f"""SELECT *, least(CAST(0.45 AS DOUBLE) + CASE WHEN gap <= {NEAR} THEN CAST(0.25 AS DOUBLE) WHEN gap <= {MID} THEN CAST(0.15 AS DOUBLE) ELSE 0 END
        + CASE WHEN source = origin_source THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN affinity IS NOT NULL THEN CAST(0.10 AS DOUBLE) ELSE 0 END, CAST(0.95 AS DOUBLE)) AS score FROM near_changes""",
    "changes": """SELECT incident_key, id AS change_id, source AS change_source, source_type AS change_type, ts AS change_ts, detail AS change_detail, gap, affinity, score
      FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY score DESC, ts, seq) AS n FROM scored) WHERE n = 1""",
    # propagation: a hop to a service that comes later in the order of signals costs nothing, one to an earlier costs a pass
    "ranked": """SELECT s.*, row_number() OVER (PARTITION BY s.incident_key ORDER BY s.source <> o.source, s.ts, s.source) - 1 AS rk, o.source = s.source AS is_origin
      FROM signals s JOIN origins o ON s.incident_key = o.incident_key
      WHERE s.source = o.source OR s.source IN (SELECT service FROM services)""",
    "hops": """SELECT DISTINCT a.incident_key, a.source AS u, b.source AS v, CASE WHEN b.rk > a.rk THEN 0 ELSE 1 END AS w
      FROM ranked a JOIN ranked b ON a.incident_key = b.incident_key JOIN service_edges e ON (e.service = a.source AND e.dependency = b.source) OR (e.service = b.source AND e.dependency = a.source)
      WHERE a.source <> b.source""",
    "walk": """SELECT incident_key, source AS node, 0 AS d FROM ranked WHERE is_origin
      UNION SELECT h.incident_key, h.v, greatest(1, d + h.w) FROM walk JOIN hops h ON walk.incident_key = h.incident_key AND walk.node = h.u WHERE d + h.w <= 12""",
    "joined": """SELECT r.*, p.pass, row_number() OVER (PARTITION BY r.incident_key ORDER BY p.pass, r.rk) - 1 AS place
      FROM ranked r JOIN (SELECT incident_key, node, min(d) AS pass FROM walk GROUP BY incident_key, node) p ON r.incident_key = p.incident_key AND r.source = p.node""",
    "credits": """SELECT b.incident_key, b.source AS to_service, b.place, b.summary, b.evidence_ids, a.source AS from_service,
        row_number() OVER (PARTITION BY b.incident_key, b.source ORDER BY e.service <> b.source, CASE WHEN e.service = b.source THEN e.ord ELSE a.place END) AS n
      FROM joined b JOIN joined a ON a.incident_key = b.incident_key AND a.place < b.place
      JOIN service_edges e ON (e.service = b.source AND e.dependency = a.source) OR (e.service = a.source AND e.dependency = b.source)""",
    "propagation": f"""SELECT incident_key, CAST(place AS INTEGER) AS step, from_service, to_service, {label('summary', X.MECHANISMS, "'" + X.NO_MECHANISM + "'")} AS mechanism, evidence_ids
      FROM credits WHERE n = 1""",
    "impacts": """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY incident_key ORDER BY ts, source) AS n FROM signals s
      WHERE source IN (SELECT service FROM services WHERE user_facing) AND incident_key IN (SELECT incident_key FROM origins)) WHERE n = 1""",
    "facts": f"""SELECT o.incident_key, o.source AS origin, o.ts AS origin_ts, o.summary AS origin_summary, o.evidence_ids AS origin_evidence,
        c.* EXCLUDE (incident_key), i.source AS impact, i.ts AS impact_ts, i.summary AS impact_summary, i.evidence_ids AS impact_evidence,
        CASE WHEN c.gap <= {MID} THEN c.change_ts ELSE o.ts END AS started_at, coalesce(i.ts, o.ts) AS detected_at,
        coalesce(p.n, 0) AS steps, p.chain, p.step_evidence, coalesce(r.recovered, false) OR coalesce(ar.recovered, false) AS recovered, coalesce(ar.backlog, false) AS backlog,
        r.has_metric, r.has_audit, r.n_events, coalesce(pol.ids, []) AS policy_ids
      FROM origins o LEFT JOIN changes c USING (incident_key) LEFT JOIN impacts i USING (incident_key)
      LEFT JOIN (SELECT incident_key, count(*) AS n, list(to_service ORDER BY step) AS chain, list_sort(list_distinct(flatten(list(evidence_ids)))) AS step_evidence FROM propagation GROUP BY incident_key) p USING (incident_key)
      LEFT JOIN (SELECT incident_key, bool_or(signal = 'recovery') AS recovered, bool_or(source_type = 'metric') AS has_metric,
          bool_or(contains(lower(detail), 'audit') OR contains(lower(source), 'audit')) AS has_audit, count(*) AS n_events FROM classified GROUP BY incident_key) r USING (incident_key)
      LEFT JOIN (SELECT incident_key, bool_or(recovered) AS recovered, bool_or(regexp_matches(name, 'backlog|depth|queue')) AS backlog FROM anomalies GROUP BY incident_key) ar USING (incident_key)
      LEFT JOIN (SELECT e.incident_key, list(t.id ORDER BY t.ts, t.seq) AS ids FROM (SELECT incident_key, unnest(evidence_ids) AS id FROM origins) e JOIN telemetry t ON t.incident_key = e.incident_key AND t.id = e.id
          WHERE {IS_POLICY} GROUP BY e.incident_key) pol USING (incident_key)""",
}

STEPS["impact_texts"] = f"""SELECT incident_key, CASE WHEN impact IS NULL THEN 'No confirmed customer-facing impact in the supplied telemetry.'
    WHEN a.name IS NOT NULL THEN rtrim(a.name || ' on ' || impact || ' rose from ' || format('{{:g}}', a.baseline) || ' to ' || format('{{:g}}', a.v) || ' ' || trim(coalesce(a.unit, ''))) || '.'
    ELSE {clip("(impact || ': ' || impact_summary || '.')", 160)} END AS impact_text
  FROM facts f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_key, source ORDER BY ts, series_ts, series_seq, seq) AS r FROM anomalies WHERE NOT recovered AND baseline IS NOT NULL) WHERE r = 1) a
    ON a.incident_key = f.incident_key AND a.source = f.impact""".replace("SELECT incident_key,", "SELECT f.incident_key,", 1)


def needs(sql: str) -> list[str]:
    """The steps that ``sql`` reads, each after what it reads itself."""
    out: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in STEPS:
            if name != inside and name not in out and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                visit(STEPS[name], name)
                out.append(name)

    visit(sql)
    return out


def with_(sql: str) -> str:
    steps = ",\n".join(f"{n} AS ({STEPS[n]})" for n in needs(sql))
    return f"WITH RECURSIVE {steps}\n{sql}" if steps else sql
