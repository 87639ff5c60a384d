"""Facts of source files, failing modules and symbols, pipelines of services, on hand-made files."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.operators import code, evidence, graph, quality, stages
from emberline.streaming import watch

FILES = {
    "pkg/__init__.py": "from . import tools\nfrom .tools import helper\n",
    "pkg/tools.py": "LIMIT = 3\n\ndef helper():\n    def inner():\n        return LIMIT\n    return inner()\n",
    "pkg/low.py": "class low:\n    async def method(self):\n        return self.other()\n    def other(self):\n        class Deep:\n            def far(self): pass\n        return 1\n",
    "pkg/use.py": "from pkg import tools\nfrom .tools import helper as h\nfrom pkg.low import low\n\nasync def Make():\n    x = low()\n    x.other()\n    return tools.LIMIT + h()\n",
    "tests/skipped.py": "x = 1\n",
    "bad.py": "def (:\n",
}


@pytest.fixture(scope="module")
def fact(spark):
    files = spark.createDataFrame([("shop", p, c) for p, c in FILES.items()], "service string, path string, content string")
    return graph.cut(code.facts(code.source_files(files)))


def test_facts(fact):
    rows = {(r["module"], r["kind"], r["name"], r["target"]) for r in fact.collect()}
    assert ("pkg", "from", "tools", "pkg.tools") in rows and ("pkg", "from", "helper", "pkg.tools.helper") in rows
    assert ("pkg.use", "from", "h", "pkg.tools.helper") in rows
    assert ("bad", "broken", "", "") in rows and not [r for r in rows if "skipped" in r[0]]
    kinds = {r["qualname"]: r["kind"] for r in code.symbols(fact).collect()}
    assert kinds == {"pkg.tools.helper": "function", "pkg.low.low": "class", "pkg.low.low.method": "async-method", "pkg.low.low.other": "method", "pkg.use.Make": "async-function"}


def test_facts_come_in_bounded_batches():
    """Many long files in one batch: no batch of facts holds more than ``BATCH`` and those of one file."""
    text = "".join(f"f{n}()\n" for n in range(4000))
    parts = [("s", f"m{f}", False, len(text) // 5000 - n, text[n * 5000 : (n + 1) * 5000]) for f in range(12) for n in range(len(text) // 5000 + 1)]
    given = pa.RecordBatch.from_arrays(list(map(pa.array, zip(*parts))), names=["service", "module", "package", "after", "part"])
    sizes = [b.num_rows for b in code.read_facts(iter([given]))]
    assert sum(sizes) == 12 * 4001 and max(sizes) < code.BATCH + 4001


def test_a_long_file_goes_in_parts(spark):
    """Letters of two bytes and of a pair of halves at every place of a part's end."""
    text = "x = 'é😀'\n" * 3000 + "def last():\n    pass\n"
    rows = spark.createDataFrame([("s", "a.py", text), ("s", "b.py", None), ("s", "c.py", ""), ("s", "d.py", "y" * code.PART + "()")], "service string, path string, content string")
    found = {(r["module"], r["kind"], r["target"], r["lineno"], r["loc"]) for r in code.facts(rows).collect()}
    long = "y" * code.PART
    assert found == {("a", "module", "a", 1, 3003), ("a", "function", "a.last", 3001, 2), ("b", "module", "b", 1, 1), ("c", "module", "c", 1, 1), ("d", "module", "d", 1, 1), ("d", "call", long, 1, 1)}


def test_calls_and_reads(fact):
    calls = code.resolve(fact)
    found = {(r["caller"], r["target"], r["kind"]) for r in calls.collect()}
    assert found == {
        ("pkg.low.low.method", "pkg.low.low.other", "call"), ("pkg.use.Make", "pkg.low.low", "construct"),
        ("pkg.use.Make", "pkg.low.low.other", "call"), ("pkg.use.Make", "pkg.tools.helper", "call"),
    }
    edges = {(r["src"], r["dst"]): (r["kind"], r["symbols"], r["count"]) for r in code.module_edges(fact, calls).collect()}
    assert edges[("pkg.use", "pkg.tools")] == ("call", ["LIMIT", "helper"], 2) and edges[("pkg", "pkg.tools")][0] == "import"


def test_kinds_and_roles(spark):
    rows = spark.createDataFrame([("a.model", [], True), ("a.step", [], True), ("a.b", ["AuthMiddleware"], False), ("a.routes", [], False), ("a.env", [], False), ("a.factory", [], False), ("a.adapter", [], False)], "m string, defs array<string>, s boolean")
    got = [r[0] for r in rows.select(code.module_kind("m", F.col("s"), "defs")).collect()]
    assert got == ["client", "graph-node", "middleware", "endpoint", "config", "client", "module"]
    symbols = spark.createDataFrame([("x", "function", "module", ["app.head"]), ("load_env", "function", "module", []), ("plain", "function", "module", []), ("plain", "function", "module", ["x.other", "unit.Test"])], "n string, k string, mk string, d array<string>")
    assert [r[0] for r in symbols.select(code.symbol_role("n", "k", "mk", "d")).collect()] == ["endpoint", "config", "logic", "test"]


def test_failing_symbol(spark):
    rows = [("a", "plain", "function", 9, 50, 1), ("a", "Build", "class", 99, 90, 0), ("a", "build_it", "function", 1, 5, 2), ("a", "__init__", "method", 9, 9, 3), ("b", "re_open", "function", 0, 1, 1), ("b", "quiet", "function", 0, 90, 0), ("c", "__call__", "method", 0, 1, 0)]
    df = spark.createDataFrame(rows, "k string, name string, kind string, outside long, loc int, seq int")
    assert {r["k"]: r["name"] for r in code.failing_symbol(df, "k").collect()} == {"a": "build_it", "b": "re_open", "c": "__call__"}


def test_overlay(spark):
    """Steps of one place by their modules' order, stages without modules, traces of several services and of none."""
    graph_of = [("a", "m1", "x", 5), ("a", "m2", "x", 1), ("a", "m3", "y", 3), ("a", "m3", "x", 3), ("a", "lone", None, 0), ("b", "m9", "x", 2)]
    modules = spark.createDataFrame(graph_of, "service string, module string, stage string, ord int")
    steps = [(1, "a", 1, "x"), (1, "a", 1, "y"), (1, "a", 2, "y"), (1, "a", 0, "none"), (2, "a", 2, "x"), (2, "b", 1, "x"), (3, "c", 1, "x"), (4, "a", 1, "x"), (4, "a", 1, "x"), (4, "a", None, "y")]
    path = spark.createDataFrame(steps, "k int, service string, pos int, stage string")
    failing = spark.createDataFrame([(1, "a", "x", None), (2, "a", "y", "lone"), (3, "c", "x", None), (4, "a", "x", "gone"), (5, "b", "x", None)], "k int, service string, failing_stage string, failing_module string")
    found = evidence.overlay(path, modules, failing, ["k"])
    assert {r["k"]: (r["path_modules"], r["failing_module"]) for r in found.collect()} == {
        1: (["m2", "m3", "m3", "m1", "m3"], "m2"), 2: (["m9", "m2", "m3", "m1"], "lone"), 3: ([], None),
        4: (["m3", "m2", "m2", "m3", "m3", "m1", "m1"], None), 5: ([], "m9"),
    }


def test_overlay_shuffles_no_pairs(spark):
    """Every trace passes a stage of many modules; what is shuffled grows with the traces, not with their modules."""
    modules = spark.range(2000).selectExpr("'a' AS service", "'module' || id AS module", "'x' AS stage", "id AS ord")
    path = spark.range(400).selectExpr("id AS k", "'a' AS service", "id AS pos", "'x' AS stage")
    failing = path.selectExpr("k", "service", "stage AS failing_stage", "CAST(NULL AS STRING) AS failing_module")
    sc = spark.sparkContext
    sc.setJobGroup("overlay", "overlay")
    try:
        assert evidence.overlay(path, modules, failing, ["k"]).select(F.sum(F.size("path_modules"))).first()[0] == 400 * 2000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("overlay")]
    stages_of = {s for j in jobs for s in j.stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages_of)
    assert 0 < written < 1_000_000


def test_evidence(spark):
    modules = spark.createDataFrame([(1, "app.a"), (1, "app"), (1, "app.c"), (2, "app.a"), (3, "x")], "k int, module string")
    told = spark.createDataFrame([(1, " app.a ", "boom"), (1, "app.a.deep", None), (1, None, "seen [app.c]"), (3, None, None)], "k int, logger string, detail string")
    stage = spark.createDataFrame([(1, "d"), (2, "died [app.a]"), (3, None)], "k int, stage_detail string")
    got = {(r["k"], r["module"]): r["evidence"] for r in evidence.scores(modules, stage, told, ["k"]).collect()}
    assert got == {(1, "app.a"): 3, (1, "app"): 2, (1, "app.c"): 3, (2, "app.a"): 3, (3, "x"): 0}
    rows = modules.join(stage, "k").select("k", "module", F.lit("failed").alias("status"), F.col("stage_detail").alias("detail"))
    of = lambda df: {(r["k"], r["module"]): r["confirmed"] for r in df.collect()}
    assert of(evidence.confirmed(rows, told, ["k"], "failed")) == {(1, "app.a"): True, (1, "app"): True, (1, "app.c"): True, (2, "app.a"): True, (3, "x"): False}
    fine = rows.withColumn("status", F.lit("ok"))
    assert of(evidence.confirmed(fine, told, ["k"], "ok"))[(1, "app.c")] is False and not any(of(evidence.confirmed(fine, told, ["k"], "failed")).values())


def test_a_pipelines_tables_are_made_once(spark):
    """The plan of the edges doesn't hold the plans of all tables before it several times over."""
    rows = [("shop", "app.py", "g.add_edge('a', 'b')\ng.add_edge('b', 'c')\n")]
    files = spark.createDataFrame(rows, "service string, path string, content string")
    found, edges, _ = stages.pipelines(code.facts(files), files.select("service", "path", code.module_name(F.col("path")).alias("module")))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") + plan.count("Window ") < 20
    assert [(r["ord"], r["src"], r["dst"]) for r in edges.orderBy("ord").collect()] == [(0, "a", "b"), (1, "b", "c")] and found.count() == 3


def test_pipeline(spark):
    app = """
class RateLimitMiddleware: pass
@app.post("/v1/login")
def login(): pass
@app.post("/v1/ChatRoom/{id}")
async def chat(): pass
app.add_middleware(AuthMiddleware)
app.add_middleware(RateLimitMiddleware)
g.add_node("lonely")
g.add_edge(START, "plan-it")
g.add_edge("plan-it", "fetch")
g.add_conditional_edges("fetch", route, {"a": "answer", "b": END})
g.add_edge("answer", END)
"""
    rows = [
        ("s", "app.py", app), ("s", "core/auth.py", "class AuthMiddleware: pass\n"), ("s", "core/llm_client.py", "X = 1\n"),
        ("s", "nodes/plan_it.py", "from core import llm_client\n"), ("s", "nodes/deep/plan_it.py", ""), ("s", "nodes/fetcher.py", "import core.llm_client\n"),
        ("t", "app.py", 'g.add_edge("a", "b")\n'),
    ]
    files = spark.createDataFrame(rows, "service string, path string, content string")
    named = files.select("service", "path", code.module_name(F.col("path")).alias("module"))
    found, edges, entries = stages.pipelines(graph.cut(code.facts(files)), named)
    got = [(r["stage"], r["module"], r["description"]) for r in found.orderBy("ord").collect()]
    assert got == [
        ("plan-it", "nodes.plan_it", "pipeline node"), ("fetch", "nodes.fetcher", "pipeline node"), ("answer", None, "pipeline node"), ("lonely", None, "pipeline node"),
        ("chat-room-endpoint", "app", "POST /v1/ChatRoom/{id}"), ("rate-limit", "app", "middleware"), ("auth", "core.auth", "middleware"), ("llm-client", "core.llm_client", "shared client"),
    ]
    assert [(r["src"], r["dst"]) for r in edges.orderBy("ord").collect()] == [
        ("plan-it", "fetch"), ("fetch", "answer"), ("chat-room-endpoint", "plan-it"), ("rate-limit", "auth"), ("auth", "chat-room-endpoint"), ("plan-it", "llm-client"), ("fetch", "llm-client"),
    ]
    assert [tuple(r) for r in entries.collect()] == [("s", "rate-limit")]


def test_tiers_above_known_ones(spark):
    """x sees what y got before it in the same pass, but not the other way round."""
    edges = spark.createDataFrame([("ui", "a"), ("x", "y"), ("x", "a"), ("y", "a")], "src string, dst string")
    facing = spark.createDataFrame([("ui",)], "node string")
    for order, tier in ((("ui", "a", "y", "x"), 3), (("ui", "a", "x", "y"), 2)):
        nodes = spark.createDataFrame([(n, i) for i, n in enumerate((*order, "alone"))], "node string, seq int")
        got = {r["node"]: r["tier"] for r in graph.tiers(nodes, edges, facing).collect()}
        assert got == {"ui": 0, "a": 1, "y": 2, "x": tier, "alone": tier + 1}


def test_ids_of_late_places(spark):
    rows = spark.createDataFrame([("i", p, "", "s", "log", None, "d") for p in (7, 123, 1230, 1231)], "incident_key string, pos int, id string, source string, source_type string, timestamp string, detail string")
    services = spark.createDataFrame([("i", "s")], "incident_key string, service string")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert [r["id"] for r in quality.gate(rows, services, base).orderBy("pos").collect()] == ["synth-007", "synth-123", "synth-1230", "synth-1231"]


def test_quota_is_one_fold(spark):
    import random

    rng = random.Random(3)
    calls = sorted({(rng.choice([1, 2, 3]), float(rng.randrange(86_400 - 4000, 86_400 + 5000) + 86_400 * rng.randrange(3))) for _ in range(400)}, key=lambda c: c[1])
    rows = [(c, at, n) for n, (c, at) in enumerate(calls)] + [(9, 0.0, 9000), (9, 86_402.0, 9001)]
    for hour, day in ((2, 1), (5, 12), (1000, 30)):
        want, hits, spent = {}, {}, {}
        for client, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
            own = [t for t in hits.get(client, []) if at - t <= 3600]
            want[n] = len(own) < hour and spent.get(at // 86_400, 0) < day
            if want[n]:
                hits[client] = [*own, at]
                spent[at // 86_400] = spent.get(at // 86_400, 0) + 1
        got = watch.quota(spark.createDataFrame(rows, "client long, at double, seq long"), hour, day)
        assert {r["seq"]: r["accepted"] for r in got.collect()} == want


def test_no_incident_no_rest():
    fold = lambda real: watch.burst_fold([0, 1, 2, 3, 4, 500], ([], float("-inf")), 3, 90, 300, real)[0]
    assert fold(None) == [(2, 3)] and fold([False] * 3 + [True] * 3) == [(3, 4)] and fold([False] * 6) == []


def test_settled(spark):
    rows = [("a", f"2024-01-01 00:{n // 60:02}:{n % 60:02}", n) for n in range(0, 600, 2)] + [("b", "2024-01-01 00:00:01", 1)]
    events = spark.createDataFrame(rows, "key string, t string, seq int").select("key", F.col("t").cast("timestamp_ntz").alias("ts"), "seq")
    start = 1704067200.0
    tripped = spark.createDataFrame([("a", start + 100), ("a", start + 6), ("b", start)], "key string, at double")
    got = {}
    for r in watch.settled(events, tripped, 5, 20, block=30).collect():
        got.setdefault((r["key"], r["at"] - start), []).append(r["seq"])
    assert {k: sorted(v) for k, v in got.items()} == {("a", 100.0): list(range(66, 106, 2)), ("a", 6.0): [0, 2, 4, 6, 8, 10], ("b", 0.0): [1]}


CALLS = {
    "a/__init__.py": "",
    "a/b.py": "def go():\n    pass\n\nclass Thing:\n    def run(self):\n        def inner():\n            self.stop()\n        inner()\n    def stop(self):\n        pass\n",
    "use.py": "from a import b\nfrom a.b import thing, Thing as T\nimport a.b as q\n\ndef f(x):\n    thing()\n    q.none()\n    b.go()\n    x = T()\n    x.stop()\n    x.gone()\n    x = q.go()\n    x.run()\n    a.b.go()\n\nclass C:\n    def m(self):\n        self.absent()\n        x.stop()\n",
}


def test_calls_that_lead_to_modules_and_typed_names(spark):
    files = spark.createDataFrame([("s", p, c) for p, c in CALLS.items()], "service string, path string, content string")
    f = graph.cut(code.facts(code.source_files(files)))
    found = sorted((r["caller"], r["target"], r["kind"]) for r in code.resolve(f).collect())
    assert found == sorted([
        ("a.b.Thing.run", "a.b.Thing.stop", "call"), ("use.f", "a.b", "call"), ("use.f", "a.b", "call"), ("use.f", "a.b.go", "call"), ("use.f", "a.b.go", "call"),
        ("use.f", "a.b.Thing", "construct"), ("use.f", "a.b.Thing.stop", "call"), ("use.f", "a.b.Thing.run", "call"),
    ])


def test_frontends_by_name_and_by_package(spark):
    from emberline.operators import discover

    names = spark.createDataFrame([(n,) for n in ("front-end-x", "www-x", "web-client", "shop_UI", "my-portal", "spa-x", "admin", "api", "bad")], "service string")
    files = [("admin", '{"devDependencies": {"@angular/core": "17"}}'), ("api", '{"dependencies": {"reactive": "1"}, "react": 1}'), ("bad", "{"), ("my-portal", "[1]"), ("spa-x", '{"dependencies": ["react"]}'), ("elsewhere", '{"dependencies": {"react": "1"}}')]
    manifests = spark.createDataFrame(files, "service string, content string")
    assert {r[0] for r in discover.frontends(names, manifests).collect()} == {"front-end-x", "www-x", "web-client", "shop_UI", "admin"}
    edges = spark.createDataFrame([("api", "admin"), ("api", "my-portal"), ("admin", "api")], "service string, dependency string")
    rows = {r["service"]: (r["depends_on"], r["user_facing"]) for r in discover.architecture(names, edges, spark.createDataFrame([], "service string, host string, node string"), manifests).collect()}
    assert rows["api"] == (["my-portal"], False) and rows["admin"] == (["api"], True)
