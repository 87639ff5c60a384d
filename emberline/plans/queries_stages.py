"""Registered queries: evidence of modules, pipelines of services. Modules, routes and imports are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import code, evidence, stages
from emberline.operators.graph import stored
from emberline.plans import sql as S
from emberline.plans.queries import query
from emberline.sources import adapters

#: Modules of an incident: its loggers, and what stands before their last part. A stage's detail is its incident's first marked one.
S.STEPS["ev_modules"] = r"SELECT DISTINCT incident_key, logger AS module FROM telemetry WHERE logger IS NOT NULL UNION SELECT incident_key, regexp_replace(logger, '[.][a-z]+$', '') FROM telemetry WHERE logger IS NOT NULL"
S.STEPS["ev_stages"] = "SELECT incident_key, min(detail) FILTER (contains(detail, '[')) AS stage_detail FROM telemetry GROUP BY incident_key"
S.STEPS["ev_linked"] = "SELECT DISTINCT incident_key, logger, detail FROM telemetry WHERE level = 'ERROR'"
S.STEPS["ev_scores"] = """SELECT m.incident_key, m.module, CASE WHEN contains(s.stage_detail, '[' || m.module || ']') THEN 3
  ELSE coalesce(max(CASE WHEN l.logger = m.module OR contains(l.detail, '[' || m.module || ']') THEN 3 WHEN starts_with(l.logger, m.module || '.') THEN 2 ELSE 0 END), 0) END AS evidence
  FROM ev_modules m JOIN ev_stages s ON s.incident_key = m.incident_key LEFT JOIN ev_linked l ON l.incident_key = m.incident_key GROUP BY m.incident_key, m.module, s.stage_detail"""


def modules(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    named = rows.where("logger is not null")
    own = named.select("incident_key", F.col("logger").alias("module")).union(named.select("incident_key", F.regexp_replace("logger", "[.][a-z]+$", ""))).distinct()
    stage = rows.groupBy("incident_key").agg(F.min(F.when(F.col("detail").contains("["), F.col("detail"))).alias("stage_detail"))
    return own, stage, rows.where("level = 'ERROR'").select("incident_key", "logger", "detail")


@query("SELECT incident_key, module, evidence FROM ev_scores")
def f4_evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly each incident's errors name each of its modules."""
    return evidence.scores(*modules(adapters.telemetry(spark, sf_dir)), ["incident_key"]).select("incident_key", "module", "evidence")


STATUS = "CASE WHEN length(module) % 2 = 0 THEN 'failed' ELSE 'ok' END"


def confirmed_sql(status: str, told: str) -> str:
    return f"""SELECT m.incident_key, m.module, {STATUS} = '{status}' AND (coalesce(contains(s.stage_detail, '[' || m.module || ']'), false) OR coalesce(bool_or({told}), false)) AS confirmed
      FROM ev_modules m JOIN ev_stages s ON s.incident_key = m.incident_key LEFT JOIN ev_linked l ON l.incident_key = m.incident_key GROUP BY m.incident_key, m.module, s.stage_detail"""


OWN = "coalesce(l.logger = m.module OR starts_with(l.logger, m.module || '.'), false)"


def confirmed(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    own, stage, linked = modules(adapters.telemetry(spark, sf_dir))
    rows = own.join(stage, "incident_key").select("incident_key", "module", F.expr(STATUS).alias("status"), F.col("stage_detail").alias("detail"))
    return evidence.confirmed(rows, linked, ["incident_key"], status)


@query(confirmed_sql("failed", f"{OWN} OR coalesce(contains(l.detail, '[' || m.module || ']'), false)"))
def c15_confirmed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed(spark, sf_dir, "failed")


@query(confirmed_sql("ok", OWN))
def c15_linked_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed(spark, sf_dir, "ok")


#: Each order is a trace through the stages of its suppliers; the service is one of the nations.
S.STEPS["ov_modules"] = "SELECT 'n' || s_nationkey AS service, 'm' || s_suppkey AS module, 's' || (s_suppkey % 20) AS stage, s_suppkey AS ord FROM supplier"
S.STEPS["ov_path"] = "SELECT l_orderkey AS k, 'n' || (l_orderkey % 25) AS service, l_linenumber AS pos, 's' || (l_suppkey % 20) AS stage, 'm' || l_suppkey AS own FROM lineitem"
S.STEPS["ov_failing"] = "SELECT k, any_value(service) AS service, arg_max(stage, (pos, own)) AS failing_stage, CASE WHEN k % 3 = 0 THEN arg_max(own, (pos, own)) END AS failing_module FROM ov_path GROUP BY k"


@query("""SELECT f.k, coalesce((SELECT string_agg(m.module, ',' ORDER BY p.pos, m.ord) FROM ov_path p JOIN ov_modules m ON m.service = p.service AND m.stage = p.stage WHERE p.k = f.k), '') AS path_modules,
  (SELECT any_value(m.module) FROM ov_modules m WHERE m.service = f.service AND m.module = coalesce(f.failing_module, (SELECT arg_min(x.module, x.ord) FROM ov_modules x WHERE x.service = f.service AND x.stage = f.failing_stage))) AS failing_module FROM ov_failing f""")
def c16_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that each trace went through, and the failing one where the graph knows it."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    known = adapters.table(spark, sf_dir, "supplier").select(text("n", F.col("s_nationkey")).alias("service"), text("m", F.col("s_suppkey")).alias("module"), text("s", F.col("s_suppkey") % 20).alias("stage"), F.col("s_suppkey").alias("ord"))
    path = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), text("n", F.col("l_orderkey") % 25).alias("service"), F.col("l_linenumber").alias("pos"), text("s", F.col("l_suppkey") % 20).alias("stage"), text("m", F.col("l_suppkey")).alias("own"))
    failing = path.groupBy("k").agg(F.first("service").alias("service"), F.max_by("stage", F.struct("pos", "own")).alias("failing_stage"), F.max_by("own", F.struct("pos", "own")).alias("own"))
    failing = failing.withColumn("failing_module", F.when(F.col("k") % 3 == 0, F.col("own")))
    return evidence.overlay(path, known, failing, ["k"]).withColumn("path_modules", F.array_join("path_modules", ","))


#: Routes of ten pages are those of one service.
ROUTES = """SELECT 'p' || CAST(page_id / 10 AS BIGINT) AS service, 'm' || CAST(page_id % 4 AS STRING) AS module, page_id AS seq, CASE page_id % 3 WHEN 0 THEN 'get' ELSE 'post' END AS method,
  '/v1/' || CASE page_id % 7 WHEN 0 THEN 'ChatRoom' WHEN 1 THEN 'login' WHEN 2 THEN 'orders' WHEN 3 THEN 'user_search' ELSE 'items' END || CASE page_id % 2 WHEN 0 THEN '/{id}' ELSE '' END AS path FROM pages"""
S.STEPS["en_routes"] = ROUTES.replace("page_id / 10", "page_id // 10").replace("AS STRING", "AS VARCHAR")


@query("""SELECT service, arg_min(path, (NOT regexp_matches(lower(path), 'chat|complet|query|ask|message|search|predict|invoke'), module, seq)) AS path,
  arg_min(module, (NOT regexp_matches(lower(path), 'chat|complet|query|ask|message|search|predict|invoke'), module, seq)) AS module FROM en_routes WHERE method = 'post' GROUP BY service""")
def f10_entry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = adapters.sql(spark, ROUTES.replace("page_id / 10", "floor(page_id / 10)"), pages=adapters.table(spark, sf_dir, "pages"))
    return stages.entry_routes(routes)


#: Files of the parts of one size and brand, and stages that their names hold or are held by.
FILES = """SELECT 'b' || p_brand AS service, CASE p_partkey % 4 WHEN 0 THEN 'app/st_' || CAST(p_size AS STRING) || '.py' WHEN 1 THEN 'app/in/the_st_' || CAST(p_size AS STRING) || '_x.py' WHEN 2 THEN 'st.py' ELSE 'zz/st_' || CAST(p_size AS STRING) || '.py' END AS path,
  'm' || CAST(p_partkey AS STRING) AS module, 'St-' || CAST(p_size AS STRING) AS stage FROM part"""
S.STEPS["sm_files"] = f"SELECT service, path, min(module) AS module, any_value(stage) AS stage FROM ({FILES.replace('AS STRING', 'AS VARCHAR')}) GROUP BY service, path"
S.STEPS["sm_stages"] = f"SELECT DISTINCT service, stage FROM ({FILES.replace('AS STRING', 'AS VARCHAR')})"


@query(r"""SELECT service, stage, arg_min(module, (flat <> name, len(string_split(path, '/')), path)) AS module FROM (SELECT s.service, s.stage, f.module, f.path, lower(replace(s.stage, '-', '_')) AS flat, lower(regexp_extract(f.path, '([^/]*?)(\.py)?$', 1)) AS name
  FROM sm_stages s JOIN sm_files f ON f.service = s.service) WHERE contains(name, flat) OR contains(flat, name) GROUP BY service, stage""".replace("\\\\", "\\"))
def c18_stage_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.sql(spark, FILES, part=adapters.table(spark, sf_dir, "part"))
    found = rows.groupBy("service", "path").agg(F.min("module").alias("module"))
    return stages.stage_modules(rows.select("service", "stage").distinct(), found)


IMPORTS = """SELECT 's' || CAST(l_suppkey AS STRING) AS service, 't' || CAST(l_linenumber AS STRING) AS stage, l_linenumber AS ord,
  'pkg.' || CASE l_partkey % 5 WHEN 0 THEN 'llm_core' WHEN 1 THEN 'gateway' WHEN 2 THEN 'util' WHEN 3 THEN 'http_client' ELSE 'factory' END || CAST(l_partkey % 2 AS STRING) AS module FROM lineitem"""
S.STEPS["sc_used"] = f"SELECT service, module, stage, min(ord) AS ord FROM ({IMPORTS.replace('AS STRING', 'AS VARCHAR')}) WHERE regexp_matches(module, 'llm|client|model|provider|transport|gateway|factory') GROUP BY ALL"
S.STEPS["sc_kept"] = "SELECT * FROM (SELECT service, module, row_number() OVER (PARTITION BY service ORDER BY count(*) DESC, module) AS place FROM sc_used GROUP BY service, module HAVING count(*) >= 2 OR contains(module, 'llm')) WHERE place <= 2"


@query("SELECT service, module, CAST(place AS INTEGER) AS place, stage, CAST(nth AS INTEGER) AS nth FROM (SELECT u.service, u.module, k.place, u.stage, row_number() OVER (PARTITION BY u.service, u.module ORDER BY u.ord, u.stage) AS nth FROM sc_used u JOIN sc_kept k ON k.service = u.service AND k.module = u.module) WHERE nth <= 4")
def d11_shared_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.shared_clients(adapters.sql(spark, IMPORTS, lineitem=adapters.table(spark, sf_dir, "lineitem")))


#: A source file for each order: its line items wire a pipeline; orders of one customer are one service.
WIRING = """
SELECT 'c' || CAST(o.o_custkey AS STRING) AS service, 'app/o' || CAST(o.o_orderkey AS STRING) || '.py' AS path,
  'from app import llm_client\n\nclass Audit' || CAST(o.o_orderkey % 3 AS STRING) || 'Middleware:\n    pass\n\n@app.post("/v1/chat/{id}")\nasync def ask():\n    return llm_client.call()\n\ng.add_edge(START, "s' || CAST(min(l.l_suppkey) % 9 AS STRING) || '")\n'
  || array_join(transform(array_sort(collect_list(struct(l.l_linenumber, l.l_suppkey, l.l_partkey))), x -> 'g.add_edge("s' || CAST(x.l_suppkey % 9 AS STRING) || '", "s' || CAST(x.l_partkey % 9 AS STRING) || '")'), '\n')
  || '\napp.add_middleware(Audit' || CAST(o.o_orderkey % 3 AS STRING) || 'Middleware)\n' AS content
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey
"""


@query()
def h13_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each customer's pipeline, with the kinds of the stages that they join."""
    files = adapters.sql(spark, WIRING, orders=adapters.table(spark, sf_dir, "orders"), lineitem=adapters.table(spark, sf_dir, "lineitem"))
    client = files.select("service").distinct().select("service", F.lit("app/llm_client.py").alias("path"), F.lit("def call():\n    return 1\n").alias("content"))
    files = stored(code.source_files(files.unionByName(client)))
    fact = stored(code.facts(files))
    found, edges, _ = stages.pipelines(fact, files.select("service", "path", code.module_name(F.col("path")).alias("module")))
    kind = found.select("service", "stage", "description")
    a, b = kind.toDF("service", "src", "src_kind"), kind.toDF("service", "dst", "dst_kind")
    return edges.join(a, ["service", "src"]).join(b, ["service", "dst"]).select("service", "ord", "src", "src_kind", "dst", "dst_kind")
