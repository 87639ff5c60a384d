"""Registered queries: the module and symbol at which each incident failed, and what its trace confirms. The code graph is each service's modules of its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import locus
from emberline.operators.graph import cut
from emberline.plans import sql as S
from emberline.plans.queries import query
from emberline.plans.queries_logs import traced
from emberline.sources import adapters

S.STEPS["lo_modules"] = """SELECT service, stage, module, length(module) * 10 + CASE WHEN module = 'app.sink' THEN 1 ELSE 0 END AS seq, length(module) % 7 + 3 AS loc, length(module) % 5 AS blast_radius, CASE WHEN length(module) % 3 = 0 THEN [module, 'app'] END AS cycle
  FROM (SELECT service, stage, unnest(modules) AS module FROM stages UNION ALL SELECT DISTINCT service, 'core', 'app.error.core.handler' FROM stages UNION ALL SELECT DISTINCT service, 'view-handler', 'app.view.core.handler' FROM stages)"""
S.STEPS["lo_edges"] = "SELECT a.service, a.seq * 1000 + b.seq AS seq, a.module AS src, b.module AS dst, CASE WHEN (a.seq + b.seq) % 2 = 0 THEN 'call' ELSE 'import' END AS kind FROM lo_modules a JOIN lo_modules b ON a.service = b.service AND a.seq < b.seq"
S.STEPS["lo_symbols"] = """SELECT service, seq * 10 + n AS seq, module || '.' || name AS qualname, module, name, kind, 'logic' AS role, loc + n AS loc FROM lo_modules, (VALUES ('__init__', 'method', 0), ('Plain', 'class', 1), ('handle', 'function', 2), ('get_all', 'function', 3), ('value', 'function', 4)) v(name, kind, n) WHERE NOT (n = 3 AND seq % 2 = 0)"""
S.STEPS["lo_calls"] = """SELECT service, seq, src || '.handle' AS src, dst || CASE WHEN kind = 'call' THEN '.get_all' ELSE '.value' END AS dst, 'call' AS kind FROM lo_edges UNION ALL SELECT service, seq, module || '.handle', module || '.value', 'call' FROM lo_modules"""
S.STEPS["lo_linked"] = "SELECT DISTINCT x.incident_key, x.service, x.stage, t.logger, t.detail FROM (SELECT incident_key, service, stage, unnest(evidence_ids) AS id FROM traced) x JOIN telemetry t ON t.incident_key = x.incident_key AND t.id = x.id"
MARK = "'[' || m.module || ']'"
OWN = "(trim(coalesce(l.logger, '')) = m.module OR starts_with(trim(coalesce(l.logger, '')), m.module || '.'))"


def code_graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    found = adapters.stages(spark, sf_dir).select("service", "stage", F.explode("modules").alias("module"))
    service = adapters.services(spark, sf_dir).select("service").distinct()
    for stage, module in (("core", "app.error.core.handler"), ("view-handler", "app.view.core.handler")):
        found = found.unionByName(service.select("service", F.lit(stage).alias("stage"), F.lit(module).alias("module")))
    n = F.length("module")
    modules = cut(found.select("service", "stage", "module", (n * 10 + F.when(F.col("module") == "app.sink", 1).otherwise(0)).alias("seq"), (n % 7 + 3).alias("loc"), (n % 5).alias("blast_radius"), F.when(n % 3 == 0, F.array("module", F.lit("app"))).alias("cycle")))
    a, b = (modules.select("service", F.col("module").alias(m), F.col("seq").alias(s)) for m, s in (("src", "x"), ("dst", "y")))
    edges = a.join(b, "service").where("x < y").select("service", (F.col("x") * 1000 + F.col("y")).alias("seq"), "src", "dst", F.when((F.col("x") + F.col("y")) % 2 == 0, "call").otherwise("import").alias("kind"))
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(n).alias("n")) for n, (name, kind) in enumerate([("__init__", "method"), ("Plain", "class"), ("handle", "function"), ("get_all", "function"), ("value", "function")])))
    symbols = modules.select("service", "seq", "module", "loc", F.explode(each).alias("s")).where("not (s.n = 3 and seq % 2 = 0)")
    symbols = symbols.select("service", (F.col("seq") * 10 + F.col("s.n")).alias("seq"), F.concat_ws(".", "module", "s.name").alias("qualname"), "module", "s.name", "s.kind", F.lit("logic").alias("role"), (F.col("loc") + F.col("s.n")).alias("loc"))
    calls = edges.select("service", "seq", F.concat("src", F.lit(".handle")).alias("src"), F.concat("dst", F.when(F.col("kind") == "call", ".get_all").otherwise(".value")).alias("dst"), F.lit("call").alias("kind"))
    calls = calls.unionByName(modules.select("service", "seq", F.concat("module", F.lit(".handle")).alias("src"), F.concat("module", F.lit(".value")).alias("dst"), F.lit("call").alias("kind")))
    return {"modules": modules, "edges": edges, "symbols": symbols, "symbol_edges": calls}


def confirmed_sql(status: str, where: str, told: str) -> str:
    return f"""SELECT t.incident_key, t.service, t.stage, m.module, t.status = '{status}' AND {where} AND (coalesce(contains(t.detail, {MARK}), false) OR coalesce(bool_or({told}), false)) AS confirmed
      FROM traced t JOIN lo_modules m ON m.service = t.service AND m.stage = t.stage LEFT JOIN lo_linked l ON l.incident_key = t.incident_key AND l.service = t.service AND l.stage = t.stage GROUP BY t.incident_key, t.service, t.stage, m.module, t.status, t.detail, t.failing, t.path"""


def confirmed(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    found = cut(traced(spark, sf_dir))
    return locus.confirmed(found, code_graph(spark, sf_dir)["modules"], adapters.telemetry(spark, sf_dir), ["incident_key"], status)


@query(confirmed_sql("failed", "coalesce(t.stage = t.failing, false)", f"{OWN} OR coalesce(contains(l.detail, {MARK}), false)"))
def c15_trace_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of each stage that the trace's own evidence confirms as failed."""
    return confirmed(spark, sf_dir, "failed")


@query(confirmed_sql("ok", "list_contains(t.path, t.stage)", OWN))
def c15_trace_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of each stage on the path that the trace's own evidence confirms as successes."""
    return confirmed(spark, sf_dir, "ok")


S.STEPS["lo_scored"] = f"""SELECT t.incident_key, t.service, m.module, m.seq, m.loc, m.blast_radius, m.cycle, CASE WHEN contains(t.detail, {MARK}) THEN 3 ELSE coalesce(max(CASE WHEN trim(coalesce(l.logger, '')) = m.module OR contains(l.detail, {MARK}) THEN 3
    WHEN starts_with(trim(coalesce(l.logger, '')), m.module || '.') THEN 2 ELSE 0 END), 0) END AS evidence
  FROM traced t JOIN lo_modules m ON m.service = t.service AND m.stage = t.stage LEFT JOIN lo_linked l ON l.incident_key = t.incident_key AND l.service = t.service AND l.stage = t.stage WHERE t.stage = t.failing
  GROUP BY t.incident_key, t.service, m.module, m.seq, m.loc, m.blast_radius, m.cycle, t.detail"""
S.STEPS["lo_failing"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_key ORDER BY evidence DESC, CASE WHEN evidence > 0 THEN length(module) ELSE 0 END DESC, loc DESC, seq) AS n FROM lo_scored) WHERE n = 1"
S.STEPS["lo_outside"] = "SELECT s.service, s.qualname, count(c.dst) FILTER (f.module IS DISTINCT FROM s.module) AS outside FROM lo_symbols s LEFT JOIN lo_calls c ON c.service = s.service AND c.dst = s.qualname LEFT JOIN lo_symbols f ON f.service = c.service AND f.qualname = c.src GROUP BY ALL"
VERBS = "get|build|create|make|invoke|call|run|complete|generate|resolve|load|connect|request|send|query|predict|chat|fetch|init|open|execute|dispatch"
S.STEPS["lo_chosen"] = f"""SELECT service, module, qualname, role FROM (SELECT s.*, row_number() OVER (PARTITION BY s.service, s.module ORDER BY o.outside > 0 DESC, regexp_matches(lower(s.name), '(^|_)({VERBS})') DESC, o.outside DESC, s.loc DESC, s.seq) AS n
  FROM lo_symbols s JOIN lo_outside o ON o.service = s.service AND o.qualname = s.qualname WHERE s.kind NOT IN ('class', 'module') AND (s.name = '__call__' OR NOT starts_with(s.name, '__'))) WHERE n = 1"""


def listed(table: str, of: str, other: str, node: str) -> str:
    return f"coalesce((SELECT string_agg(e.{other}, ',' ORDER BY e.n) FROM (SELECT *, row_number() OVER (PARTITION BY service, {of} ORDER BY kind <> 'call', seq) AS n FROM {table}) e WHERE e.service = f.service AND e.{of} = {node} AND e.n <= 6), '')"


@query(f"""SELECT f.incident_key, f.service, f.module, {listed('lo_edges', 'dst', 'src', 'f.module')} AS callers, {listed('lo_edges', 'src', 'dst', 'f.module')} AS callees, f.blast_radius, coalesce(array_to_string(f.cycle, ','), '') AS cycle,
  c.qualname AS symbol, c.role, {listed('lo_calls', 'dst', 'src', 'c.qualname')} AS symbol_callers, {listed('lo_calls', 'src', 'dst', 'c.qualname')} AS symbol_callees FROM lo_failing f LEFT JOIN lo_chosen c ON c.service = f.service AND c.module = f.module""")
def f4_f5_failing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing module of each incident with who calls it, what it calls, its radius and cycle, and the symbol in it where the failure most likely begins."""
    found = locus.failing_context(cut(traced(spark, sf_dir)), code_graph(spark, sf_dir), adapters.telemetry(spark, sf_dir), "incident_key")
    return found.withColumns({c: F.array_join(c, ",") for c in ("callers", "callees", "cycle", "symbol_callers", "symbol_callees")})


@query("SELECT service, qualname, outside FROM lo_outside")
def d8_external_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each symbol is called from outside its module."""
    g = code_graph(spark, sf_dir)
    return locus.external_callers(g["symbols"], g["symbol_edges"])
