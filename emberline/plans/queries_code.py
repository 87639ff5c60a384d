"""Registered queries: discovery and code graphs. Source files and configuration are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import code, discover, graph, trace
from emberline.plans import sql as S
from emberline.plans.queries import query
from emberline.plans.queries_graph import links
from emberline.sources import adapters

IGNORED = ["example.net"]


@query(r"""SELECT page_id, host, CASE WHEN ends_with(l, 'gateway') THEN l ELSE l || '-gateway' END AS node FROM (SELECT page_id, host, replace(split_part(host, '.', 1), '_', '-') AS l FROM (
  SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(url || ' ' || html, 'https?://([a-zA-Z0-9.\-]+)', 1))) AS host FROM pages) WHERE NOT (host = 'example.net' OR ends_with(host, '.example.net')))""")
def c12_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return discover.hosts(pages, "page_id", "text", IGNORED)


#: A compose file: every service with its dependencies, and another section after.
COMPOSE_SQL = """
SELECT 'compose.yml' AS file, -1 AS line_no, 'services:' AS value
UNION ALL SELECT 'compose.yml', CAST(substr(service, 5) AS INT) * 10, '  ' || upper(replace(service, '-', '_')) || ':' FROM services
UNION ALL SELECT 'compose.yml', CAST(substr(service, 5) AS INT) * 10 + 1, '    depends_on:' FROM services
UNION ALL SELECT 'compose.yml', CAST(substr(service, 5) AS INT) * 10 + 2 + ord, '      - ' || dependency FROM service_edges
UNION ALL SELECT 'compose.yml', CAST(substr(service, 5) AS INT) * 10 + 8, '    ports:' FROM services
UNION ALL SELECT 'compose.yml', CAST(substr(service, 5) AS INT) * 10 + 9, '      - 80' FROM services
UNION ALL SELECT 'compose.yml', 900, 'volumes:' UNION ALL SELECT 'compose.yml', 901, '  data:'
"""


def compose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.sql(spark, COMPOSE_SQL, services=adapters.services(spark, sf_dir), service_edges=adapters.service_edges(spark, sf_dir))


@query("SELECT service, dependency FROM service_edges UNION ALL SELECT service, NULL FROM services")
def e11_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.compose_services(compose_lines(spark, sf_dir)).select("service", "dependency")


CONFIG_SQL = """SELECT s.service, coalesce('call=http://' || e.dependency || ':80/ x' || e.dependency || ' ' || e.dependency, 'none') || ' note' AS text FROM services s LEFT JOIN service_edges e ON e.service = s.service WHERE e.ord IS NULL OR e.ord < 2"""
S.STEPS["configs"] = CONFIG_SQL


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.sql(spark, CONFIG_SQL, services=adapters.services(spark, sf_dir), service_edges=adapters.service_edges(spark, sf_dir))


@query("SELECT DISTINCT c.service, n.service AS dependency FROM configs c JOIN services n ON n.service <> c.service AND regexp_matches(lower(c.text), '[^a-z0-9]' || n.service || '[^a-z0-9]')")
def c11_named_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.named_services(configs(spark, sf_dir), adapters.services(spark, sf_dir))


#: Suppliers as services with all kinds of names: some of a frontend's, some alike.
NAMED = "CASE {0} % 11 WHEN 0 THEN 'front-end-' WHEN 1 THEN 'www-' WHEN 2 THEN 'web-client-' WHEN 3 THEN 'my-portal-' WHEN 4 THEN 'spa-' WHEN 5 THEN 'Shop_UI-' WHEN 6 THEN 'webapp-' WHEN 7 THEN 'web-app-' WHEN 8 THEN 'frontend-' ELSE 'api-' END || CAST({0} AS VARCHAR(20))"
S.STEPS["named_edges"] = f"SELECT {NAMED.format('src')} AS service, {NAMED.format('dst')} AS dependency, dst FROM edges"
#: Package files of every fifth supplier: some depend on a frontend's package, some are broken.
MANIFEST = """CASE {0} % 4 WHEN 0 THEN '{{"dependencies": {{"react": "^18"}}}}' WHEN 1 THEN '{{"devDependencies": {{"svelte": "4", "x": "1"}}}}' WHEN 2 THEN '{{"dependencies": {{"express": "4", "reactor": "1"}}}}' ELSE '{{"dependencies": {{"vue": ' END"""
HINTED = "regexp_matches(lower({}), 'frontend|front-end|webapp|web-app|ui|www|client')"


def named_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, e = links(spark, sf_dir)
    own = F.expr(NAMED.format("node"))
    manifests = n.where("node % 5 = 0").select(own.alias("service"), F.expr(MANIFEST.format("node")).alias("content"))
    return graph.clean(e).select(F.expr(NAMED.format("src")).alias("service"), F.expr(NAMED.format("dst")).alias("dependency")), manifests


@query(f"SELECT service, dependency FROM named_edges WHERE NOT {HINTED.format('dependency')} AND NOT (dst % 5 = 0 AND dst % 4 IN (0, 1))")
def c13_frontend_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No edge leads to a frontend, known by its name or by what its package file depends on."""
    edges, manifests = named_edges(spark, sf_dir)
    names = edges.select("service").union(edges.select("dependency")).distinct()
    return discover.without_frontend_targets(edges, discover.frontends(names, manifests))


@query("SELECT service FROM services UNION SELECT DISTINCT 'src-' || source FROM documents UNION SELECT dependency FROM service_edges")
def g4_service_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.table(spark, sf_dir, "documents").select(F.concat(F.lit("src-"), "source"))
    return adapters.services(spark, sf_dir).select("service").union(docs).union(adapters.service_edges(spark, sf_dir).select("dependency")).distinct()


@query("""SELECT service, coalesce((SELECT string_agg(DISTINCT d, ',' ORDER BY d) FROM (SELECT service AS s, dependency AS d FROM service_edges UNION SELECT 'svc-' || lpad(CAST(page_id % 12 AS VARCHAR), 2, '0'), split_part(lower(regexp_extract(url, 'https?://([a-zA-Z0-9.\\-]+)', 1)), '.', 1) || '-gateway' FROM pages) WHERE s = service), '') AS depends_on, false AS user_facing, NULL AS owner FROM services
  UNION ALL SELECT node, '', false, 'external · ' || max(host) FROM (SELECT lower(regexp_extract(url, 'https?://([a-zA-Z0-9.\\-]+)', 1)) AS host, split_part(lower(regexp_extract(url, 'https?://([a-zA-Z0-9.\\-]+)', 1)), '.', 1) || '-gateway' AS node FROM pages) GROUP BY node""".replace("\\\\", "\\"))
def h14_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services, what their compose entries name, and the hosts of their pages."""
    names = adapters.services(spark, sf_dir)
    edges = discover.compose_services(compose_lines(spark, sf_dir)).where("dependency is not null").select("service", "dependency")
    pages = adapters.table(spark, sf_dir, "pages").select(F.concat(F.lit("svc-"), F.lpad((F.col("page_id") % 12).cast("string"), 2, "0")).alias("service"), "url")
    return discover.architecture(names, edges, discover.hosts(pages, "service", "url", [])).withColumn("depends_on", F.array_join("depends_on", ","))


# ---------------------------------------------------------------- code

#: A source file for each supplier that calls the suppliers that follow it: by name, by alias, or by an import at run time.
FILES_SQL = """
SELECT 'shop' AS service, 'pkg/m' || CAST(node AS STRING) || '.py' AS path,
  coalesce(array_join(transform(calls, d -> CASE d % 3 WHEN 0 THEN 'from pkg.m' || CAST(d AS STRING) || ' import f' || CAST(d AS STRING) WHEN 1 THEN 'import pkg.m' || CAST(d AS STRING) || ' as a' || CAST(d AS STRING) ELSE 'import importlib' END), '\n'), '')
    || '\n\ndef f' || CAST(node AS STRING) || '():\n    x = 1\n'
    || coalesce(array_join(transform(calls, d -> '    ' || CASE d % 3 WHEN 0 THEN 'f' || CAST(d AS STRING) || '()' WHEN 1 THEN 'a' || CAST(d AS STRING) || '.f' || CAST(d AS STRING) || '()' ELSE 'importlib.import_module("pkg.m' || CAST(d AS STRING) || '")' END), '\n'), '')
    || '\n    return x\n' AS content
FROM (SELECT n.node, array_sort(collect_list(e.dst)) AS calls FROM nodes n LEFT JOIN edges e ON e.src = n.node GROUP BY n.node) g
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = links(spark, sf_dir)
    return adapters.sql(spark, FILES_SQL, nodes=n, edges=graph.clean(e))


def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.facts(code.source_files(files(spark, sf_dir), per_service=None))


@query("SELECT 'function' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'module', count(*) FROM nodes UNION ALL SELECT 'dynamic', count(*) FROM edges WHERE dst % 3 = 2 UNION ALL SELECT 'from', count(*) FROM edges WHERE dst % 3 = 0")
def j1_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = code_facts(spark, sf_dir).where("kind in ('function', 'module', 'dynamic', 'from')")
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


NAMES = "'pkg.m' || src || '.f' || src AS src, 'pkg.m' || dst || CASE WHEN dst % 3 = 2 THEN '' ELSE '.f' || dst END AS dst, CASE WHEN dst % 3 = 2 THEN 'dynamic' ELSE 'call' END AS kind"


@query(f"SELECT {NAMES} FROM edges")
def j2_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.resolve(graph.stored(code_facts(spark, sf_dir))).select(F.col("caller").alias("src"), F.col("target").alias("dst"), "kind")


@query(f"SELECT src, dst, kind, count(*) AS count FROM (SELECT {NAMES} FROM edges) GROUP BY ALL")
def d7_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbol_edges(code.resolve(graph.stored(code_facts(spark, sf_dir)))).select("src", "dst", "kind", "count")


@query("SELECT 'pkg.m' || src AS src, 'pkg.m' || dst AS dst, CASE WHEN dst % 3 = 2 THEN 'dynamic-import' ELSE 'call' END AS kind, CASE WHEN dst % 3 = 2 THEN 'm' || dst ELSE 'f' || dst END AS symbols, 1 AS count FROM edges")
def d7_g3_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = graph.stored(code_facts(spark, sf_dir))
    return code.module_edges(f, code.resolve(f)).select("src", "dst", "kind", F.array_join("symbols", ",").alias("symbols"), "count")


#: Files of each supplier with calls of every form, and what each leads to.
SHAPES_SQL = r"""
SELECT 's' || CAST(node AS STRING) AS service, path, replace(content, '#', CAST(node AS STRING)) AS content FROM nodes n, (
  SELECT 'lib/base.py' AS path, 'class Base#:\n    def go(self):\n        return self.stay()\n    @classmethod\n    def make(cls):\n        return cls.go()\n    def stay(self):\n        pass\n\ndef plain():\n    pass\n' AS content
  UNION ALL SELECT 'lib/other.py', 'VALUE = 1\n'
  UNION ALL SELECT 'lib/__init__.py', ''
  UNION ALL SELECT 'app.py', 'import lib.base as b\nimport lib.other as o\nfrom lib import other as mod\nfrom lib.base import Base#, plain as p\nfrom lib.other import missing\nimport os\n\ndef run#():\n    x = Base#()\n    x.go()\n    y = b.Base#()\n    y.stay()\n    y.nothing()\n    b.plain()\n    p()\n    o.anything()\n    mod.func()\n    missing()\n    os.getcwd()\n    b.Base#.make()\n    unknown()\n\nrun#()\n'
) f
"""
S.STEPS["shapes"] = """SELECT 's' || node AS service, replace(src, '#', CAST(node AS VARCHAR)) AS src, replace(dst, '#', CAST(node AS VARCHAR)) AS dst, kind FROM nodes, (VALUES
  ('lib.base.Base#.go', 'lib.base.Base#.stay', 'call'), ('lib.base.Base#.make', 'lib.base.Base#.go', 'call'), ('app.run#', 'lib.base.Base#', 'construct'), ('app.run#', 'lib.base.Base#.go', 'call'),
  ('app.run#', 'lib.base.Base#', 'construct'), ('app.run#', 'lib.base.Base#.stay', 'call'), ('app.run#', 'lib.base.plain', 'call'), ('app.run#', 'lib.base.plain', 'call'),
  ('app.run#', 'lib.other', 'call'), ('app.run#', 'lib.other', 'call'), ('app.run#', 'lib.other', 'call'), ('app', 'app.run#', 'call')) v(src, dst, kind)"""


@query("SELECT service, src, dst, kind FROM shapes")
def j2_call_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through self and cls, of a local of a known class, through an alias, of a module for want of a symbol; others lead nowhere."""
    sources = adapters.sql(spark, SHAPES_SQL, nodes=links(spark, sf_dir)[0])
    f = graph.cut(code.facts(code.source_files(sources)))
    return code.resolve(f).select("service", F.col("caller").alias("src"), F.col("target").alias("dst"), "kind")


@query("SELECT 'pkg/m' || node || '.py' AS path FROM (SELECT node, row_number() OVER (ORDER BY 'pkg/m' || node || '.py') AS n FROM nodes) WHERE n <= 40")
def j3_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.source_files(files(spark, sf_dir), per_service=40).select("path")


@query("SELECT logger AS name, CASE WHEN starts_with(logger, 'app.error') THEN 'app.error' ELSE 'app' END AS found FROM (SELECT DISTINCT logger FROM telemetry WHERE logger IS NOT NULL)")
def c8_c9_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loggers against two known modules."""
    rows = adapters.telemetry(spark, sf_dir).where("logger is not null").select(F.col("logger").alias("name"))
    known = rows.select(F.explode(F.array(F.lit("app"), F.lit("app.error"))).alias("prefix")).distinct()
    return trace.longest_prefix(rows, known)


S.STEPS["kinds"] = "SELECT src, dst, CASE WHEN (src + dst) % 2 = 0 THEN 'call' ELSE 'import' END AS kind, src * 1000 + dst AS seq FROM edges"


def kinds(edges: DataFrame) -> DataFrame:
    e = graph.clean(edges)
    return e.withColumns({"kind": F.when((F.col("src") + F.col("dst")) % 2 == 0, "call").otherwise("import"), "seq": F.col("src") * 1000 + F.col("dst")})


def callers_sql(of: str, other: str) -> str:
    return f"SELECT node, string_agg(near, ',' ORDER BY n) AS neighbours FROM (SELECT {of} AS node, CAST({other} AS VARCHAR) AS near, row_number() OVER (PARTITION BY {of} ORDER BY kind <> 'call', seq) AS n FROM kinds) WHERE n <= 6 GROUP BY node"


@query(callers_sql("dst", "src"))
def c17_f6_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.neighbours(kinds(links(spark, sf_dir)[1]), "dst", "src").withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(callers_sql("src", "dst"))
def c17_f6_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.neighbours(kinds(links(spark, sf_dir)[1]), "src", "dst").withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


S.STEPS["top"] = "SELECT node FROM radii ORDER BY blast_radius DESC, node LIMIT 30"


@query("SELECT e.src, e.dst FROM edges e WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def f7_top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the thirty nodes on which most depend."""
    n, e = links(spark, sf_dir)
    top = graph.cut(code.top_nodes(graph.blast_radii(n, e), 30, F.desc("blast_radius"), "node"))
    return code.kept_edges(graph.clean(e), top)


@query("SELECT node, fan_in + fan_out AS degree FROM degree ORDER BY degree DESC, node LIMIT 20")
def f8_d8_top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.degrees(*links(spark, sf_dir)).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    return code.top_nodes(found, 20, F.desc("degree"), "node")


@query("SELECT DISTINCT node FROM (SELECT node FROM busiest UNION SELECT src FROM edges WHERE dst IN (SELECT node FROM busiest) UNION SELECT dst FROM edges WHERE src IN (SELECT node FROM busiest))")
def h12_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node on which most depend, and its neighbours."""
    from emberline.plans.queries_graph import busiest

    n, e = links(spark, sf_dir)
    focus, e = graph.cut(busiest(n, e)), graph.clean(e)
    near = e.join(focus.withColumnRenamed("node", "dst"), "dst").select("src").union(e.join(focus.withColumnRenamed("node", "src"), "src").select("dst"))
    return focus.union(near).distinct()


S.STEPS["scored_modules"] = "SELECT l_orderkey % 50 AS k, 'm' || l_suppkey AS module, max(l_linenumber % 4) AS evidence, CAST(sum(l_quantity) AS BIGINT) AS loc, min(l_suppkey) AS seq FROM lineitem GROUP BY ALL"


@query("SELECT k, arg_max(module, (evidence, CASE WHEN evidence > 0 THEN length(module) ELSE 0 END, loc, -seq)) AS module FROM scored_modules GROUP BY k")
def f4_failing_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("k"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("module"))
    return code.failing_module(rows.agg(F.max(F.col("l_linenumber") % 4).alias("evidence"), F.sum("l_quantity").cast("long").alias("loc"), F.min("l_suppkey").alias("seq")), "k")


S.STEPS["candidates"] = "SELECT l_orderkey % 50 AS k, CASE l_suppkey % 7 WHEN 0 THEN '__init__' WHEN 1 THEN '__call__' WHEN 2 THEN 'plain_' || l_suppkey WHEN 3 THEN 're_Build_' || l_suppkey ELSE 's' || l_suppkey END AS name, CASE l_suppkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'async-method' ELSE 'function' END AS kind, l_suppkey AS seq, count(*) FILTER (l_returnflag = 'R') AS outside, max(l_linenumber) AS loc FROM lineitem GROUP BY ALL"


@query("SELECT k, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY outside > 0 DESC, regexp_matches(lower(name), '(^|_)(get|build|create|make|invoke|call|run|complete|generate|resolve|load|connect|request|send|query|predict|chat|fetch|init|open|execute|dispatch)') DESC, outside DESC, loc DESC, seq) AS n FROM candidates WHERE kind <> 'class' AND (name = '__call__' OR NOT starts_with(name, '__'))) WHERE n = 1")
def f5_failing_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    name = F.when(s % 7 == 0, "__init__").when(s % 7 == 1, "__call__").when(s % 7 == 2, F.concat(F.lit("plain_"), s.cast("string"))).when(s % 7 == 3, F.concat(F.lit("re_Build_"), s.cast("string"))).otherwise(F.concat(F.lit("s"), s.cast("string")))
    rows = adapters.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("k"), name.alias("name"), F.when(s % 5 == 0, "class").when(s % 5 == 1, "async-method").otherwise("function").alias("kind"), s.alias("seq"))
    rows = rows.agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("outside"), F.max("l_linenumber").alias("loc"))
    return code.failing_symbol(rows, "k").select("k", "name", "seq")
