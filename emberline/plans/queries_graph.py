"""Registered queries: graph structure over supplier links and services, state replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import graph, replay, trace
from emberline.plans import sql as S
from emberline.plans.queries import query, star
from emberline.plans.queries_logs import traced
from emberline.sources import adapters

S.STEPS["nodes"] = "SELECT src AS node FROM links UNION SELECT dst FROM links"
S.STEPS["edges"] = "SELECT src, dst FROM links WHERE src <> dst"
S.STEPS["reach"] = "SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src"
S.STEPS["radii"] = "SELECT n.node, count(DISTINCT r.src) FILTER (r.src <> n.node) AS blast_radius FROM nodes n LEFT JOIN reach r ON r.dst = n.node GROUP BY n.node"
S.STEPS["degree"] = "SELECT n.node, (SELECT count(*) FROM edges e WHERE e.dst = n.node) AS fan_in, (SELECT count(*) FROM edges e WHERE e.src = n.node) AS fan_out FROM nodes n"
S.STEPS["mutual"] = "SELECT a.src AS node, least(min(a.dst), a.src) AS cluster, count(DISTINCT a.dst) + 1 AS size FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = graph.cut(adapters.supplier_links(spark, sf_dir))
    return graph.nodes_of(e), e


@query("SELECT node, fan_in, fan_out FROM degree")
def d6_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*links(spark, sf_dir))


@query("SELECT node, blast_radius FROM radii")
def h3_blast_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radii(*links(spark, sf_dir))


@query("SELECT cluster, size, node FROM mutual UNION ALL SELECT src, 1, src FROM links WHERE src = dst")
def h4_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(*links(spark, sf_dir))


@query("SELECT d.node, fan_in, fan_out, blast_radius, d.node IN (SELECT node FROM mutual) AS in_cycle FROM degree d JOIN radii r ON d.node = r.node")
def h5_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.structure(*links(spark, sf_dir))


S.STEPS["busiest"] = "SELECT node FROM radii ORDER BY blast_radius DESC, node LIMIT 1"
S.STEPS["back_walk"] = """SELECT node, 0 AS d FROM busiest UNION SELECT e.src, d + 1 FROM back_walk w JOIN edges e ON e.dst = w.node WHERE d < 40"""
S.STEPS["back"] = "SELECT node, min(d) AS distance FROM back_walk GROUP BY node"


def busiest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.blast_radii(nodes, edges).orderBy(F.desc("blast_radius"), "node").limit(1).select("node")


@query("SELECT node, distance FROM back WHERE distance > 0")
def h11_reverse_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the node on which most depend."""
    n, e = links(spark, sf_dir)
    return graph.reverse_dependents(e, busiest(n, e))


@query("SELECT e.src, e.dst FROM edges e JOIN back a ON a.node = e.src JOIN back b ON b.node = e.dst WHERE a.distance > b.distance")
def h11_impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = links(spark, sf_dir)
    return graph.impact_edges(e, busiest(n, e))


S.STEPS["grouped"] = "SELECT n.node, coalesce(m.cluster, n.node) AS g FROM nodes n LEFT JOIN mutual m ON m.node = n.node"
S.STEPS["folded_edges"] = "SELECT DISTINCT a.g AS src, b.g AS dst FROM edges e JOIN grouped a ON a.node = e.src JOIN grouped b ON b.node = e.dst WHERE a.g <> b.g"
S.STEPS["level_walk"] = "SELECT DISTINCT g, 0 AS lv FROM grouped WHERE g NOT IN (SELECT dst FROM folded_edges) UNION SELECT f.dst, lv + 1 FROM level_walk w JOIN folded_edges f ON f.src = w.g"
S.STEPS["levels"] = "SELECT g, max(lv) AS lv FROM level_walk GROUP BY g"


@query("SELECT n.node, CASE WHEN h.high > 5 THEN CAST(round_even(l.lv * 5.0 / h.high, 0) AS INTEGER) ELSE l.lv END AS level FROM grouped n JOIN levels l ON l.g = n.g, (SELECT max(lv) AS high FROM levels) h")
def h10_dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_levels(*links(spark, sf_dir))


S.STEPS["service_reach"] = "SELECT service AS src, dependency AS dst FROM service_edges UNION SELECT r.src, e.dependency FROM service_reach r JOIN service_edges e ON e.service = r.dst"
S.STEPS["service_group"] = "SELECT s.service, coalesce(least(s.service, min(a.dst)), s.service) AS g FROM services s LEFT JOIN (SELECT x.src, x.dst FROM service_reach x JOIN service_reach y ON x.src = y.dst AND x.dst = y.src) a ON a.src = s.service GROUP BY s.service"
S.STEPS["group_edges"] = "SELECT DISTINCT a.g AS src, b.g AS dst FROM service_edges e JOIN service_group a ON a.service = e.service JOIN service_group b ON b.service = e.dependency WHERE a.g <> b.g"
S.STEPS["tier_walk"] = "SELECT g AS node, 0 AS lv FROM service_group JOIN services USING (service) WHERE user_facing UNION SELECT e.dst, lv + 1 FROM tier_walk w JOIN group_edges e ON e.src = w.node"


@query("SELECT s.service AS node, coalesce(max(lv), (SELECT max(lv) FROM tier_walk) + 1) AS tier FROM service_group s LEFT JOIN tier_walk w ON w.node = s.g GROUP BY s.service")
def h9_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every service is below the user-facing one, two of them on a cycle, which is one tier."""
    services = adapters.services(spark, sf_dir)
    edges = adapters.service_edges(spark, sf_dir).select(F.col("service").alias("src"), F.col("dependency").alias("dst"))
    return graph.tiers(services.select(F.col("service").alias("node")), edges, services.where("user_facing").select(F.col("service").alias("node")))


@query("SELECT l_suppkey AS src, l_partkey % 100 + 1 AS dst, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1 GROUP BY ALL")
def g5_ordered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100 + 1).alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.ordered_edges(rows)


@query("SELECT e.src, e.dst FROM (SELECT DISTINCT src, dst FROM edges) e WHERE src IN (SELECT node FROM nodes WHERE node % 3 <> 0) AND dst IN (SELECT node FROM nodes WHERE node % 3 <> 0)")
def g6_known_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nodes whose number is not divisible by three."""
    n, e = links(spark, sf_dir)
    return graph.known_edges(n.where("node % 3 <> 0"), e)


@query("SELECT 'services' AS what, count(*) AS n FROM services UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'clusters', count(DISTINCT cluster) FROM mutual")
def d12_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = links(spark, sf_dir)
    count = lambda what, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    clusters = graph.cycles(n, e).where("size > 1").select("cluster").distinct()
    return count("services", adapters.services(spark, sf_dir)).union(count("nodes", n)).union(count("edges", graph.clean(e))).union(count("clusters", clusters))


S.STEPS["graph_things"] = """SELECT 'n' || (node % 25) AS service, 'modules' AS what, node AS a, 0 AS b, CAST(NULL AS BIGINT) AS cluster FROM nodes
  UNION ALL SELECT 'n' || (src % 25), 'edges', src, dst, NULL FROM edges UNION ALL SELECT 'n' || (node % 25), 'in cycles', node, 0, cluster FROM mutual"""


@query("SELECT coalesce(service, 'all') AS service, count(*) FILTER (what = 'modules') AS modules, count(*) FILTER (what = 'edges') AS edges, count(*) FILTER (what = 'in cycles') AS in_cycles, count(DISTINCT cluster) AS clusters FROM graph_things GROUP BY ROLLUP (service)")
def d12_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, edges and cycles of each service, and of all."""
    n, e = links(spark, sf_dir)
    return graph.summary(n.withColumn("service", F.concat(F.lit("n"), (F.col("node") % 25).cast("string"))), e)


# ---------------------------------------------------------------- replay

S.STEPS["touched"] = "SELECT DISTINCT incident_key, idx, ts, CASE severity WHEN 'warning' THEN 1 WHEN 'critical' THEN 2 ELSE 3 END AS rank, unnest(services) AS service FROM timeline WHERE severity <> 'info'"
STATE = "CASE {} WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' WHEN 3 THEN 'recovery' END"
S.STEPS["states"] = f"""SELECT incident_key, service, idx, ts, {STATE.format('now')} AS state, {STATE.format('before')} AS previous FROM (
  SELECT *, max(rank) OVER (PARTITION BY incident_key, service ORDER BY idx) AS now, max(rank) OVER (PARTITION BY incident_key, service ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM touched)"""
S.STEPS["degraded"] = "SELECT incident_key, service, min(idx) AS idx, arg_min(ts, idx) AS ts FROM states WHERE state <> 'recovery' GROUP BY ALL"
S.STEPS["active"] = """SELECT p.incident_key, least(from_service, to_service) AS a, greatest(from_service, to_service) AS b, min(greatest(x.ts, y.ts)) AS ts FROM propagation p
  JOIN degraded x ON x.incident_key = p.incident_key AND x.service = from_service JOIN degraded y ON y.incident_key = p.incident_key AND y.service = to_service GROUP BY ALL"""


@query("SELECT incident_key, service, idx, state FROM states")
def e6_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.states(star(spark, sf_dir)["timeline"]).select("incident_key", "service", "idx", "state")


@query("SELECT incident_key, service, idx, state, previous FROM states WHERE state IS DISTINCT FROM previous")
def e7_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.changes(replay.states(star(spark, sf_dir)["timeline"])).select("incident_key", "service", "idx", "state", "previous")


@query("SELECT incident_key, a, b, ts FROM active")
def c10_e9_active_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    return replay.active_edges(s["propagation"], replay.degraded(replay.states(s["timeline"])))


@query("SELECT DISTINCT incident_key, idx, service FROM touched")
def e10_changed_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.changed_services(star(spark, sf_dir)["timeline"])


@query("""SELECT t.incident_key, t.id, t.service, m.state, m.previous, m.ts AS since FROM (SELECT incident_key, id, source AS service, ts FROM telemetry WHERE source_type = 'metric') t
  ASOF LEFT JOIN (SELECT incident_key, service, ts, arg_max(state, idx) AS state, arg_max(previous, idx) AS previous FROM states WHERE state IS DISTINCT FROM previous GROUP BY ALL) m
  ON t.incident_key = m.incident_key AND t.service = m.service AND t.ts >= m.ts""")
def c14_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    samples = adapters.telemetry(spark, sf_dir).where("source_type = 'metric'").select("incident_key", "id", F.col("source").alias("service"), "ts")
    marks = replay.changes(replay.states(s["timeline"]))
    marks = marks.groupBy("incident_key", "service", "ts").agg(F.max_by("state", "idx").alias("state"), F.max_by("previous", "idx").alias("previous"))
    return replay.as_of(samples, marks, ["incident_key", "service"], ["state", "previous"]).drop("ts")


S.STEPS["trace_texts"] = """SELECT DISTINCT incident_key, service, 'Request traced through ' || greatest(0, len(path) - 1) || ' stage(s) inside ' || service || '; ' || coalesce('failed at ' || failing || '.', 'no failing stage attributable.') AS summary FROM traced"""
S.STEPS["beats"] = """SELECT incident_key, 0 AS rank, 0 AS idx, 0 AS sub, 'intro' AS kind, 'Incident ' || incident_id || '. ' || title || '.' AS line FROM texts
  UNION ALL SELECT incident_key, 1, idx, 0, 'event', strftime(ts, '%H:%M') || ' UTC: ' || title || '.' FROM timeline
  UNION ALL SELECT t.incident_key, 1, min(idx), 1, 'internal', any_value(summary) FROM timeline t JOIN trace_texts x ON x.incident_key = t.incident_key WHERE severity = 'critical' AND list_contains(services, service) GROUP BY t.incident_key
  UNION ALL SELECT incident_key, 2, 0, 0, 'outro', engineer_briefing FROM texts UNION ALL SELECT incident_key, 2, 0, 1, 'outro', executive_summary FROM texts"""


@query("SELECT incident_key, CAST(row_number() OVER (PARTITION BY incident_key ORDER BY rank, idx, sub) AS INTEGER) AS n, kind, line FROM beats")
def k9_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    return replay.beats(s["timeline"], trace.summaries(traced(spark, sf_dir)), s["texts"])
