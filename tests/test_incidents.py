"""Hand-built incidents, and randomised checks of the set-based forms against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.functions import lines as L
from emberline.functions import text as X
from emberline.operators import graph, quality, replay, signals
from emberline.plans.reconstruct import reconstruct

T0 = datetime(2024, 5, 1, 10, 0, 0)
SCHEMA = "incident_key string, seq long, id string, source_type string, source string, ts timestamp_ntz, detail string, level string, logger string, metric string, value double, unit string"


def event(n, kind, source, minutes, detail, level=None, metric=None, value=None, key="k"):
    return (key, n, f"e{n}", kind, source, T0 + timedelta(minutes=minutes), detail, level, None, metric, value, None)


def star(spark, rows, services=(("api", True), ("db", False)), edges=(("api", "db", 0),)):
    telemetry = spark.createDataFrame(rows, SCHEMA)
    return reconstruct(telemetry, spark.createDataFrame(list(services), "service string, user_facing boolean"), spark.createDataFrame(list(edges), "service string, dependency string, ord int"))


def test_quiet_incident_has_no_row(spark):
    s = star(spark, [event(1, "log", "api", 0, "request served", "INFO")])
    assert s["facts"].count() == 0 and s["timeline"].count() == 0


def test_unexplained_failure(spark):
    s = star(spark, [event(1, "log", "db", 0, "disk broke", "ERROR")])
    h = s["hypotheses"].collect()
    assert h[0]["confidence"] <= 0.5 and "unexplained" in h[0]["title"]
    gaps = [r["gap_text"] for r in s["gaps"].orderBy("pos").collect()]
    assert gaps[0] == "No telemetry received from: api" and any("change history" in g for g in gaps)
    assert s["dangling"].count() == 0


def test_policy_rejection_is_the_cause_and_no_recovery(spark):
    s = star(spark, [event(1, "log", "api", -10, "cache warmed", "INFO"), event(2, "log", "api", 0, "403: model x not allowed for virtual key", "ERROR")])
    top = s["hypotheses"].where("rank = 2").first()
    assert top["confidence"] >= 0.9 and "policy" in top["title"]
    assert s["timeline"].where("severity = 'recovery'").count() == 0


def test_change_before_failure_and_propagation(spark):
    rows = [event(1, "deployment", "db", 0, "rotated secret"), event(2, "log", "db", 3, "auth denied.", "ERROR"), event(3, "log", "api", 4, "timeout to db", "ERROR")]
    s = star(spark, rows)
    f = s["facts"].first()
    assert (f["origin"], f["change_id"], f["affinity"]) == ("db", "e1", "credential") and abs(f["score"] - 0.9) < 1e-9
    step = s["propagation"].first()
    assert (step["from_service"], step["to_service"], step["mechanism"]) == ("db", "api", "dependency timeouts")
    assert f["started_at"] == T0 and f["detected_at"] == T0 + timedelta(minutes=4)


def test_change_keyword_beats_error_level(spark):
    rows = spark.createDataFrame([event(1, "log", "db", 0, "restart failed", "ERROR")], SCHEMA)
    found = signals.anomalies(rows)
    assert signals.classify(rows, signals.first_trouble(rows, found)).first()["signal"] == "change"


def test_tables_without_rows(spark):
    s = star(spark, [])
    assert all(df.count() == 0 for df in s.all().values())


@pytest.mark.parametrize("x", [0.0, 22.6, 480.0, 0.3, 1.23457e06, 123456.7, 999999.6, 1e-5, 12345678.0, -4.5, 0.0001])
def test_general_number(spark, x):
    assert spark.range(1).select(X.general(F.lit(x))).first()[0] == f"{x:g}"


def test_clip_and_names(spark):
    row = spark.range(1).select(
        X.clip(F.lit("one two three four"), 10).alias("a"), X.clip(F.lit("short"), 10).alias("b"), X.safe_name(F.lit("../a b//c")).alias("c"), X.safe_name(F.lit("--")).alias("d"),
        X.offending_value(F.lit("bad 'x' in 'us.model:v1' here")).alias("e"), X.kebab(F.lit("GuardRailNode_x")).alias("f"),
    ).first()
    assert tuple(row) == ("one two…", "short", "a-b-c", "service", "us.model:v1", "guard-rail-node-x")


def test_lines(spark):
    given = ["2024-05-01 10:00:00,250 - app.x - WARNING - odd", "[error] msg", "ERROR: broken", "   ", '{"ts": "2024-05-01T10:00:00+02:00", "severity": "warn", "msg": "m", "name": ""}', "{not json}"]
    rows = L.parsed(spark.createDataFrame([(n, v) for n, v in enumerate(given)], "n int, v string"), "v").orderBy("n").select("p").collect()
    p = [r["p"] for r in rows]
    assert (p[0]["level"], p[0]["message"], p[0]["logger"], p[0]["ts"]) == ("WARNING", "odd", "app.x", datetime(2024, 5, 1, 10, 0, 0, 250000))
    assert (p[1]["level"], p[1]["message"]) == ("INFO", "[error] msg")
    assert (p[2]["level"], p[2]["message"], p[2]["ts"]) == ("ERROR", "broken", None)
    assert p[3] is None
    assert (p[4]["level"], p[4]["message"], p[4]["ts"]) == ("WARN", "m", datetime(2024, 5, 1, 8))
    assert p[5]["message"] == "{not json}"


def test_quality_gate(spark):
    rows = spark.createDataFrame([("k", 0, "a", "api", "log", "2024-05-01T10:00:00Z", "x"), ("k", 1, "b", "ghost", "log", "", "x"), ("k", 2, None, "api", "change", "", "x"), ("k", 3, "d", "api", None, "bad", " y ")], "incident_key string, pos long, id string, source string, source_type string, timestamp string, detail string")
    services = spark.createDataFrame([("k", "api")], "incident_key string, service string")
    out = {r["id"]: r for r in quality.gate(rows, services, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert out["a"]["reason"] is None and "not a declared service" in out["b"]["reason"] and "source_type" in out["synth-002"]["reason"]
    assert out["d"]["ts"] == datetime(2024, 1, 1, 0, 2, 15) and out["d"]["detail"] == "y"


def loop(signal_rows, origin, deps):
    """The spread of failure by a plain loop over services in their order."""
    reached, steps = [origin], []
    waiting = sorted((s for s in signal_rows if s[0] != origin and s[0] in deps), key=lambda s: (s[1], s[0]))
    while True:
        before = len(reached)
        for name, _ in list(waiting):
            source = next((d for d in deps[name] if d in reached), None) or next((r for r in reached if name in deps.get(r, ())), None)
            if source:
                steps.append((source, name))
                reached.append(name)
                waiting = [w for w in waiting if w[0] != name]
        if len(reached) == before:
            return steps


def test_propagation_equals_a_loop(spark):
    rng = random.Random(4)
    rows, edges, want = [], [], {}
    names = [f"s{n}" for n in range(7)]
    deps = {n: rng.sample([m for m in names if m != n], rng.randint(0, 2)) for n in names}
    for k in range(25):
        failing = [(n, T0 + timedelta(minutes=rng.randint(0, 4))) for n in rng.sample(names, rng.randint(1, 7))]
        origin = min(failing, key=lambda s: (s[1], s[0]))[0]
        want[f"k{k}"] = loop(failing, origin, deps)
        rows += [(f"k{k}", n, t, "x", [f"{n}"], True, True) for n, t in failing]
    edges = [(n, d, i) for n in names for i, d in enumerate(deps[n])]
    signal = spark.createDataFrame(rows, "incident_key string, source string, ts timestamp_ntz, summary string, evidence_ids array<string>, is_hard boolean, has_error boolean")
    found = graph.propagate(signal, signals.origins(signal), spark.createDataFrame([(n,) for n in names], "service string"), spark.createDataFrame(edges, "service string, dependency string, ord int"))
    got = {k: [] for k in want}
    for r in found.orderBy("incident_key", "step").collect():
        got[r["incident_key"]].append((r["from_service"], r["to_service"]))
    assert got == want


def test_replay_equals_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(20):
        state = {}
        for i in range(10):
            severity, svc = rng.choice(["info", "warning", "critical", "recovery"]), rng.choice("ab")
            rows.append((f"k{k}", i, T0 + timedelta(minutes=i), severity, [svc]))
            rank = {"warning": 1, "critical": 2}.get(severity)
            if severity == "recovery":
                state[svc] = "recovery"
            elif rank and state.get(svc) != "recovery" and rank >= {"warning": 1, "critical": 2}.get(state.get(svc), 0):
                state[svc] = severity
            if severity != "info":
                want[f"k{k}", i] = state[svc]
    timeline = spark.createDataFrame(rows, "incident_key string, idx int, ts timestamp_ntz, severity string, services array<string>")
    assert {(r["incident_key"], r["idx"]): r["state"] for r in replay.states(timeline).collect()} == want


def test_closure_and_cycles_equal_a_loop(spark):
    rng = random.Random(6)
    edges = {(rng.randint(0, 11), rng.randint(0, 11)) for _ in range(16)}
    nodes = sorted({n for e in edges for n in e})
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [d for s, d in edges if s == n and d != n]
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += [d for s, d in edges if s == x and d != s]
    e, v = spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long")
    assert {r["node"]: r["blast_radius"] for r in graph.blast_radii(v, e).collect()} == {n: sum(n in reach[m] for m in nodes if m != n) for n in nodes}
    got = {}
    for r in graph.cycles(v, e).where("size > 1").collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(c) for c in got.values()} == {frozenset({m for m in nodes if m == n or (m in reach[n] and n in reach[m])}) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}
