"""The report of each incident: facts, timeline, hypotheses, gaps, actions, texts. All incidents in one job, one row or list for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import attributes as A
from emberline.functions import text as X
from emberline.operators.signals import Settings


def impacts(signals: DataFrame, origin: DataFrame, services: DataFrame) -> DataFrame:
    """The first signal of each incident on a user-facing service; warnings count."""
    facing = services.where("user_facing").select(F.col("service").alias("source"))
    w = Window.partitionBy("incident_key").orderBy("ts", "source")
    rows = signals.join(facing, "source", "left_semi").join(origin.select("incident_key"), "incident_key", "left_semi")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def impact_texts(impact: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(incident_key, told): the first active anomaly with a baseline on the impact's service, else its summary."""
    w = Window.partitionBy("incident_key", "source").orderBy("ts", "series_ts", "series_seq", "seq")
    first = anomalies.where("not recovered and baseline is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    rows = impact.select("incident_key", "source", "summary").join(first.select("incident_key", "source", "name", "v", "baseline", "unit"), ["incident_key", "source"], "left")
    rose = F.concat("name", F.lit(" on "), "source", F.lit(" rose from "), X.general("baseline"), F.lit(" to "), X.general("v"), F.lit(" "), F.trim(F.coalesce("unit", F.lit(""))))
    plain = X.clip(F.concat("source", F.lit(": "), "summary", F.lit(".")), 160)
    return rows.select("incident_key", F.when(F.col("name").isNotNull(), F.concat(F.rtrim(rose), F.lit("."))).otherwise(plain).alias("told"))


def facts(classified: DataFrame, anomalies: DataFrame, signals: DataFrame, origin: DataFrame, change: DataFrame, impact: DataFrame, propagation: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each incident with all that the texts need."""
    o = origin.select("incident_key", F.col("source").alias("origin"), F.col("ts").alias("origin_ts"), F.col("summary").alias("origin_summary"), F.col("evidence_ids").alias("origin_evidence"))
    i = impact.select("incident_key", F.col("source").alias("impact"), F.col("ts").alias("impact_ts"), F.col("summary").alias("impact_summary"), F.col("evidence_ids").alias("impact_evidence"))
    steps = propagation.groupBy("incident_key").agg(
        F.count(F.lit(1)).alias("steps"),
        F.transform(F.array_sort(F.collect_list(F.struct("step", "to_service"))), lambda x: x["to_service"]).alias("chain"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("step_evidence"),
    )
    audit = F.lower("detail").contains("audit") | F.lower("source").contains("audit")
    rows = classified.groupBy("incident_key").agg(F.max(F.coalesce(F.col("signal") == "recovery", F.lit(False))).alias("r1"), F.max(F.col("source_type") == "metric").alias("has_metric"), F.max(audit).alias("has_audit"), F.count(F.lit(1)).alias("n_events"))
    odd = anomalies.groupBy("incident_key").agg(F.max("recovered").alias("r2"), F.max(F.col("name").rlike("backlog|depth|queue")).alias("backlog"))
    # evidence rows of the origin's signal that are model-policy rejections
    said = (A.searched("detail", "attributes") if "attributes" in classified.columns else F.col("detail")).alias("said")
    held = o.select("incident_key", F.explode("origin_evidence").alias("id")).join(classified.select("incident_key", "id", "ts", "seq", said), ["incident_key", "id"]).where(X.is_policy_rejection("said"))
    policy = held.groupBy("incident_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "id"))), lambda x: x["id"]).alias("policy_ids"))
    out = o.join(change, "incident_key", "left").join(i, "incident_key", "left").join(impact_texts(impact, anomalies), "incident_key", "left")
    for more in (steps, rows, odd, policy):
        out = out.join(more, "incident_key", "left")
    no = F.lit(False)
    return out.withColumns(
        {
            "started_at": F.when(F.col("gap") <= settings.mid, F.col("change_ts")).otherwise(F.col("origin_ts")),
            "detected_at": F.coalesce("impact_ts", "origin_ts"),
            "steps": F.coalesce("steps", F.lit(0).cast("long")),
            "recovered": F.coalesce("r1", no) | F.coalesce("r2", no),
            "backlog": F.coalesce("backlog", no),
            "policy_ids": F.coalesce("policy_ids", F.array().cast("array<string>")),
            "impact_text": F.coalesce("told", F.lit("No confirmed customer-facing impact in the supplied telemetry.")),
        }
    ).drop("r1", "r2", "told")


def timeline(classified: DataFrame, anomalies: DataFrame, signals: DataFrame, fact: DataFrame, services: DataFrame) -> DataFrame:
    """(incident_key, idx, ts, title, description, severity, services, evidence_ids), by time, kinds in the order healthy, change, signal, impact, recovery."""
    keys = fact.select("incident_key", "origin")
    inside = classified.join(keys.select("incident_key"), "incident_key", "left_semi")
    odd = anomalies.join(keys.select("incident_key"), "incident_key", "left_semi")
    signal = signals.join(keys, "incident_key")
    first = lambda df, n, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("incident_key").orderBy(*by))).where(F.col("n") <= n)
    base = first(inside.where("signal = 'baseline'"), 2, "ts", "seq")
    base = base.groupBy("incident_key").agg(F.min("ts").alias("b_ts"), F.array_sort(F.collect_set("source")).alias("b_src"), F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("b_ids"))
    one = first(odd.where("not recovered and baseline is not null"), 1, "ts", "series_ts", "series_seq", "seq").select("incident_key", F.col("id").alias("a_id"))
    start = first(signal, 1, "ts", "source").select("incident_key", F.col("ts").alias("f_ts"), F.col("source").alias("f_src"))
    none = F.array().cast("array<string>")
    healthy = start.join(base, "incident_key", "left").join(one, "incident_key", "left").where("b_ids is not null or a_id is not null")
    row = lambda kind, seq, ts, title, text, sev, svc, ids: [F.lit(kind).alias("kind"), seq.alias("o"), ts.alias("ts"), title.alias("title"), text.alias("description"), sev.alias("severity"), svc.alias("services"), ids.alias("evidence_ids")]
    ids = F.concat(F.coalesce("b_ids", none), F.when(F.col("a_id").isNull(), none).otherwise(F.array("a_id")))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit("").alias("y"))
    rows = healthy.select("incident_key", *row(0, zero, F.coalesce("b_ts", "f_ts"), F.lit("System healthy"), F.lit("Telemetry before the incident shows normal behavior."), F.lit("info"), F.coalesce("b_src", none), ids))
    changed = inside.where("signal = 'change'")
    seq = F.struct(F.col("seq").alias("x"), F.lit("").alias("y"))
    rows = rows.unionByName(changed.select("incident_key", *row(1, seq, F.col("ts"), F.concat(F.lit("Change on "), "source"), X.clip("detail"), F.lit("warning"), F.array("source"), F.array("id"))))
    facing = services.select(F.col("service").alias("source"), "user_facing")
    told = signal.join(facing, "source", "left").join(start, "incident_key")
    hard = F.coalesce("user_facing", F.lit(False)) | (F.col("source") == F.col("f_src")) | F.col("has_error")
    name = F.struct(F.lit(0).cast("long").alias("x"), F.col("source").alias("y"))
    rows = rows.unionByName(told.select("incident_key", *row(2, name, F.col("ts"), F.concat("source", F.lit(": "), X.clip("summary", 60)), X.clip("summary", 160), F.when(hard, "critical").otherwise("warning"), F.array("source"), F.col("evidence_ids"))))
    hit = fact.where("impact is not null")
    text = X.clip(F.concat(F.lit("User-facing failures on "), "impact", F.lit(": "), "impact_summary"), 160)
    rows = rows.unionByName(hit.select("incident_key", *row(3, zero, F.col("impact_ts"), F.lit("Customer impact"), text, F.lit("critical"), F.array("impact"), F.col("impact_evidence"))))
    back = inside.where("signal = 'recovery'").select("incident_key", "source", "ts", F.struct(F.lit(0).alias("k"), F.col("ts").alias("t"), F.col("ts").alias("u"), F.col("seq").alias("s"), "id").alias("e"))
    back = back.unionByName(odd.where("recovered").select("incident_key", "source", "ts", F.struct(F.lit(1).alias("k"), F.col("ts").alias("t"), F.col("series_ts").alias("u"), F.col("seq").alias("s"), "id").alias("e")))
    back = back.groupBy("incident_key").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_set("source")).alias("svc"), F.transform(F.array_sort(F.collect_list("e")), lambda x: x["id"]).alias("ids"))
    rows = rows.unionByName(back.select("incident_key", *row(4, zero, F.col("ts"), F.lit("Recovery"), F.lit("Recovery signals observed; key metrics returned toward baseline."), F.lit("recovery"), F.col("svc"), F.col("ids"))))
    order = Window.partitionBy("incident_key").orderBy("ts", "kind", "o")
    return rows.withColumn("idx", F.row_number().over(order) - 1).select("incident_key", "idx", "ts", "title", "description", "severity", "services", "evidence_ids")


def ranked_structs(fact: DataFrame, items: list[tuple[Column, list[Column]]], names: list[str]) -> DataFrame:
    """``fact`` exploded into the structs whose condition holds, in their order, with ``ord`` from 0."""
    made = [F.when(cond, F.struct(*(c.alias(n) for c, n in zip(cols, names)))) for cond, cols in items]
    return fact.select("*", F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("ord", "item"))


def change_phrase() -> tuple[Column, Column, Column]:
    return F.col("change_id").isNotNull(), F.col("affinity"), F.size("policy_ids") > 0


def hypotheses(fact: DataFrame, architecture_ids: DataFrame | None = None) -> DataFrame:
    """(incident_key, rank, title, confidence, status, explanation, evidence_ids), by confidence, the order of rules on ties."""
    none = F.array().cast("array<string>")
    if architecture_ids is None:
        fact = fact.withColumn("arch_ids", none)
    else:
        fact = fact.join(architecture_ids, "incident_key", "left").withColumn("arch_ids", F.coalesce("arch_ids", none))
    changed, cls, policy = change_phrase()
    minutes = F.greatest(F.lit(1), F.bround(F.col("gap") / 60).cast("int")).cast("string")
    pattern = F.coalesce(F.concat(F.lit(" ("), cls, F.lit(" pattern)")), F.lit(""))
    chain = F.array_join(F.concat(F.array("origin"), F.coalesce("chain", none)), " → ")
    sure = lambda x: F.lit(x).cast("double")
    inferred, unknown = F.lit("inferred"), F.lit("unknown")
    items = [
        (policy, [F.concat(F.lit("Likely cause: gateway model-policy rejection on "), "origin"), sure(0.92), inferred, F.lit("The logged 403 response explicitly reports a model-policy rejection: the requested model is not allowed for the active virtual key. This strongly supports an allow-list or configured-model mismatch, but the supplied evidence does not establish which configuration is wrong."), F.col("policy_ids")]),
        (changed, [F.concat(F.lit("Root cause: change on "), "change_source", F.lit(" — "), X.clip("change_detail", 70)), F.col("score"), inferred, F.concat(F.lit("The change preceded the first failure on "), "origin", F.lit(" by about "), minutes, F.lit(" minute(s), and the failure signature matches the change"), pattern, F.lit(". Correlation is strong but not proof.")), F.concat(F.array("change_id"), "origin_evidence", "arch_ids")]),
        (~changed & ~policy, [F.concat(F.lit("Root cause: unexplained failure originating at "), "origin"), sure(0.45), inferred, F.concat("origin", F.lit(" shows the earliest failure signal, but no deployment or change event was found in the supplied telemetry to explain it.")), F.col("origin_evidence")]),
        (F.col("steps") > 0, [F.concat(F.lit("Failure propagated along the dependency graph: "), chain), F.least(sure(0.5) + sure(0.1) * F.col("steps"), sure(0.88)), inferred, F.lit("Each downstream service shows failure signals after its upstream dependency, in an order consistent with the architecture graph."), F.coalesce("step_evidence", none)]),
        (F.col("impact").isNotNull(), [F.lit("Customer-facing impact"), sure(0.99), F.lit("confirmed"), X.clip(F.concat(F.lit("Direct evidence from "), "impact", F.lit(": "), "impact_summary", F.lit(".")), 180), F.col("impact_evidence")]),
        (F.coalesce(cls == "credential", F.lit(False)) & ~F.col("has_audit"), [F.lit("Identity and mechanism of the credential change"), sure(0.0), unknown, F.lit("No audit logs are present, so who or what changed the credential cannot be established from this telemetry."), none]),
        (F.coalesce(F.col("change_type") == "log", F.lit(False)), [F.concat(F.lit("Change record for the "), "change_source", F.lit(" change")), sure(0.0), unknown, F.lit("The change appears only in service logs. No deployment or change-management record was found to confirm what was altered."), F.array("change_id")]),
    ]
    rows = ranked_structs(fact, items, ["title", "confidence", "status", "explanation", "evidence_ids"]).select("incident_key", "ord", "item.*")
    w = Window.partitionBy("incident_key").orderBy(F.desc("confidence"), "ord")
    return rows.withColumn("rank", F.row_number().over(w)).drop("ord")


def silent_services(classified: DataFrame, fact: DataFrame, services: DataFrame) -> DataFrame:
    """(incident_key, silent): services of the architecture without any event in an incident, joined by commas.

    The architecture's names are one row, as each answer may list nearly all of them; what an incident heard is a set of names.
    """
    names = services.agg(F.array_sort(F.collect_set("service"))).scalar()
    heard = classified.groupBy("incident_key").agg(F.collect_set("source").alias("heard"))
    quiet = fact.select("incident_key").join(heard, "incident_key", "left").select("incident_key", F.array_except(names, F.coalesce("heard", F.array().cast("array<string>"))).alias("quiet"))
    return quiet.where(F.size("quiet") > 0).select("incident_key", F.array_join("quiet", ", ").alias("silent"))


def missing_evidence(fact: DataFrame, silent: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """(incident_key, pos, gap_text): what evidence is missing, in a fixed order."""
    changed, cls, _ = change_phrase()
    credential = F.coalesce(cls == "credential", F.lit(False))
    rows = fact.join(silent, "incident_key", "left")
    items = [
        (F.col("silent").isNotNull(), F.concat(F.lit("No telemetry received from: "), "silent")),
        (credential & ~F.col("has_audit"), F.lit("Database or IAM audit logs")),
        (credential & F.lower("change_detail").contains("secret"), F.lit("Secrets Manager version history")),
        (~changed, F.lit("Deployment and change history for the affected services")),
        (F.coalesce(F.col("change_type") == "log", F.lit(False)), F.concat(F.lit("Change-management record for the "), "change_source", F.lit(" change"))),
        (~F.col("has_metric"), F.lit("Metrics (only logs were supplied)")),
    ]
    texts = F.array_compact(F.array(*(F.when(c, t) for c, t in items)))
    return rows.select("incident_key", F.posexplode(texts).alias("pos", "gap_text"))


def actions(fact: DataFrame) -> DataFrame:
    """(incident_key, priority, action, reason, risk) in running order; a recovered incident gets the shorter list."""
    changed, cls, policy = change_phrase()
    credential, capacity = (F.coalesce(cls == x, F.lit(False)) for x in ("credential", "capacity"))
    back, c = F.col("recovered"), F.concat
    own, low = ~F.col("recovered") & ~policy, F.lit("Read-only verification. Low risk.")
    items = [
        (policy, [c(F.lit("Verify the gateway model allow-list for the active virtual key and compare it with the model ID configured on "), "origin", F.lit(".")), F.lit("The observed 403 identifies a model-policy rejection, but does not distinguish an allow-list issue from a configured-model mismatch."), F.lit("Read-only configuration verification. Low risk.")]),
        (back, [c(F.lit("Confirm "), "origin", F.lit(" and user-facing metrics are stable at baseline for at least 30 minutes.")), F.lit("Recovery signals are present but sustained stability is unverified."), low]),
        (back & capacity, [c(F.lit("Add a warm-up step to the "), "origin", F.lit(" restart runbook before it takes traffic.")), F.lit("A cold restart triggered the miss storm that caused the incident."), F.lit("Process change only. Low risk.")]),
        (back & capacity, [F.lit("Add request coalescing or stale-while-revalidate so a cold cache cannot stampede the backing store."), F.lit("Downstream services absorbed the full miss load during the incident."), F.lit("Code change. Medium risk; ship behind a flag.")]),
        (back, [F.lit("Write the postmortem while evidence links in this analysis are fresh."), F.lit("The reconstruction above lists confirmed facts, hypotheses and evidence gaps to fill."), F.lit("No production risk.")]),
        (own & changed & credential, [c(F.lit("Compare the credential configured on "), "change_source", F.lit(" with what the rejecting dependency expects (database, API gateway or external service), including the auth scheme it wants the credential sent under.")), F.lit("The failure began minutes after a credential change."), F.lit("Read-only validation. Low risk.")]),
        (own & changed & credential, [c(F.lit("Run a read-only authentication test from the "), "origin", F.lit(" environment with a restricted identity.")), F.lit("Confirms the credential mismatch before any rollback."), F.lit("Low risk with a restricted test identity.")]),
        (own & changed & credential, [c(F.lit("Roll back "), "change_source", F.lit(" to the last known-good version, after human approval.")), F.lit("The service was healthy before this change."), F.lit("Medium risk. Validate compatibility first.")]),
        (own & changed & ~credential, [c(F.lit("Review the change on "), "change_source", F.lit(" ("), X.clip("change_detail", 60), F.lit(") against the first failure signature.")), F.lit("It is the closest change preceding the failure."), F.lit("Read-only review. Low risk.")]),
        (own & changed & ~credential, [c(F.lit("Prepare a revert of the "), "change_source", F.lit(" change, pending human approval.")), F.lit("Reverting the correlated change is the fastest probable fix."), F.lit("Medium risk. Confirm the correlation first.")]),
        (own & ~changed, [c(F.lit("Inspect "), "origin", F.lit(" directly: resource limits, dependency health and recent alerts.")), F.lit("No correlated change was found, so start at the earliest failing service."), F.lit("Read-only investigation. Low risk.")]),
        (~back & F.col("backlog"), [F.lit("After the root cause is fixed, drain accumulated queue backlog gradually."), F.lit("A sudden drain can recreate the saturation this incident caused."), F.lit("Medium risk. Rate-limit and watch worker utilization.")]),
    ]
    rows = ranked_structs(fact, items, ["action", "reason", "risk"])
    return rows.select("incident_key", (F.col("ord") + 1).alias("priority"), "item.*")


def texts(fact: DataFrame, line: DataFrame, hypothesis: DataFrame, action: DataFrame, system: str) -> DataFrame:
    """(incident_key, incident_id, title, engineer_briefing, executive_summary, replay_script) of each incident."""
    changed, _, _ = change_phrase()
    s, c, clock = F.lit(system), F.concat, lambda t: F.date_format(t, "HH:mm")
    first = action.where("priority = 1").select("incident_key", F.col("action").alias("first_action"))
    top = hypothesis.where("rank = 1").select("incident_key", F.col("title").alias("top_title"), F.col("status").alias("top_status"), F.col("confidence").alias("top_confidence"))
    recovery = line.where("severity = 'recovery'").groupBy("incident_key").agg(F.min("ts").alias("recovery_ts"))
    lines = line.groupBy("incident_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", c(F.lit("At "), clock("ts"), F.lit(" UTC — "), "title", F.lit(". "), "description").alias("t")))), lambda x: x["t"]).alias("told"))
    rows = fact
    for more in (first, top, recovery, lines):
        rows = rows.join(more, "incident_key", "left")
    symptom = F.when(F.col("impact").isNotNull(), c("impact", F.lit(" failures"))).otherwise(c("origin", F.lit(" failure")))
    kind = F.when(F.col("change_type") == "deployment", "deployment").otherwise("change")
    title = F.when(changed, c(symptom, F.lit(" after "), "change_source", F.lit(" "), kind, F.lit(" ("), s, F.lit(")"))).otherwise(c(symptom, F.lit(" ("), s, F.lit(")")))
    chain = F.array_join(F.concat(F.array("origin"), "chain"), " → ")
    briefing = F.concat_ws(
        " ",
        F.when(changed, c(F.lit("At "), clock("change_ts"), F.lit(" UTC, "), "change_source", F.lit(": "), X.clip("change_detail", 90))),
        c(F.lit("First failure at "), clock("origin_ts"), F.lit(" UTC on "), "origin", F.lit(": "), X.clip("origin_summary", 100), F.lit(".")),
        F.when(F.col("steps") > 0, c(F.lit("Propagation: "), chain, F.lit("."))),
        c(F.lit("Impact: "), "impact_text"),
        F.when(F.col("recovered"), c(F.lit("Recovery signals from "), clock("recovery_ts"), F.lit(" UTC."))),
        c(F.lit("First: "), "first_action"),
    )
    cause = F.when(changed, c(F.lit("a change to "), "change_source")).otherwise("an unidentified trigger")
    status = F.when(F.col("recovered"), "The system has shown recovery signals; verification is in progress.").otherwise("Mitigation steps are listed for engineering, pending human approval.")
    summary = c(F.lit("The "), s, F.lit(" experienced a customer-affecting incident that evidence links to "), cause, F.lit(". "), "impact_text", F.lit(" "), status)
    strongest = c(F.lit("Strongest conclusion ("), "top_status", F.lit(", "), F.bround(F.col("top_confidence") * 100).cast("int").cast("string"), F.lit("% confidence): "), "top_title", F.lit("."))
    replay = F.array_compact(F.concat("told", F.array(strongest, c(F.lit("First recommended check: "), "first_action"))))
    return rows.select("incident_key", X.incident_id(s, "origin", "started_at").alias("incident_id"), title.alias("title"), briefing.alias("engineer_briefing"), summary.alias("executive_summary"), replay.alias("replay_script"))


def dangling(line: DataFrame, hypothesis: DataFrame, propagation: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(incident_key, id): evidence ids that name no event; empty for a sound report."""
    each = lambda df: df.select("incident_key", F.explode("evidence_ids").alias("id"))
    named = each(line).union(each(hypothesis)).union(each(propagation)).distinct()
    return named.join(telemetry.select("incident_key", "id"), ["incident_key", "id"], "left_anti")


def briefings(fact: DataFrame, text: DataFrame, hypothesis: DataFrame, gaps: DataFrame, action: DataFrame) -> DataFrame:
    """(incident_key, report): one headed text for each incident."""
    listed = lambda df, by, what, name: df.groupBy("incident_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, what.alias("t")))), lambda x: x["t"]), "\n").alias(name))
    h = listed(hypothesis, "rank", F.concat(F.lit("- "), "title", F.lit(" ("), "status", F.lit(", "), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%)")), "h")
    g = listed(gaps, "pos", F.concat(F.lit("- "), "gap_text"), "g")
    a = listed(action, "priority", F.concat(F.col("priority").cast("string"), F.lit(". "), "action"), "a")
    rows = text
    for more in (h, g, a):
        rows = rows.join(more, "incident_key", "left")
    report = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Incident "), "incident_id"), F.lit("## Briefing"), "engineer_briefing", F.lit("## Hypotheses"), "h", F.lit("## Missing evidence"), F.coalesce("g", F.lit("none recorded")), F.lit("## Actions"), "a")
    return rows.select("incident_key", report.alias("report"))
