"""The failing module and symbol, and what a trace confirms, on hand-made traces and graphs."""

import pytest

from emberline.operators import locus

TRACE = "k string, service string, stage string, status string, detail string, evidence_ids array<string>, failing string, path array<string>"
MODULE = "service string, seq int, module string, stage string, loc int, blast_radius int, cycle array<string>"
EDGE = "service string, seq int, src string, dst string, kind string"
SYMBOL = "service string, seq int, qualname string, module string, name string, kind string, role string, loc int"


@pytest.fixture(scope="module")
def world(spark):
    trace = [
        ("i", "s", "gate", "ok", "in [m.gate]", ["e1"], "core", ["gate", "core"]),
        ("i", "s", "side", "ok", "[m.side] ran", ["e1"], "core", ["gate", "core"]),
        ("i", "s", "core", "failed", "boom", ["e2", "e3"], "core", ["gate", "core"]),
        ("j", "s", "gate", "ok", "", ["e9"], None, []),
        ("n", "t", "core", "failed", "no modules", [], "core", ["core"]),
    ]
    events = [("i", "e1", "m.gate.sub", "x"), ("i", "e2", "m.core.deep", "y"), ("i", "e3", None, "z [m.other]"), ("i", "e4", "m.big", "not linked"), ("j", "e2", "m.big", "another incident"), ("j", "e9", "m.gate", "[m.side]")]
    modules = [("s", 0, "m.gate", "gate", 5, 1, None), ("s", 1, "m.side", "side", 5, 1, None), ("s", 2, "m.big", "core", 999, 4, None), ("s", 3, "m.core", "core", 10, 3, None), ("s", 4, "m.other", "core", 1, 2, ["m.other", "m.gate"])]
    edges = [("s", n, f"m.c{n}", "m.other", "import" if n < 3 else "call") for n in range(9)] + [("s", 20, "m.other", "m.z", "call"), ("s", 21, "m.other", "m.z", "import"), ("t", 1, "x", "m.other", "call")]
    symbols = [("s", 0, "m.other.C", "m.other", "C", "class", "logic", 99), ("s", 1, "m.other.__init__", "m.other", "__init__", "method", "logic", 50), ("s", 2, "m.other.value", "m.other", "value", "function", "logic", 40), ("s", 3, "m.other.get_it", "m.other", "get_it", "function", "client", 2), ("s", 4, "m.gate.f", "m.gate", "f", "function", "logic", 2)]
    calls = [("s", 0, "m.other.get_it", "m.other.value", "call"), ("s", 1, "m.gate.f", "m.other.value", "call"), ("s", 2, "gone.f", "m.other.value", "call"), ("s", 3, "m.gate.f", "m.other.get_it", "call")]
    frame = spark.createDataFrame
    graph = {"modules": frame(modules, MODULE), "edges": frame(edges, EDGE), "symbols": frame(symbols, SYMBOL), "symbol_edges": frame(calls, EDGE)}
    return frame(trace, TRACE), frame(events, "k string, id string, logger string, detail string"), graph


def test_confirmed_by_linked_events_only(world):
    trace, events, g = world
    yes = lambda status: {(r["k"], r["module"]) for r in locus.confirmed(trace, g["modules"], events, ["k"], status).where("confirmed").collect()}
    assert yes("failed") == {("i", "m.core"), ("i", "m.other")}  # m.big is named by no linked event
    assert yes("ok") == {("i", "m.gate")}  # the side stage is off the path, and j has no path
    assert locus.confirmed(trace, g["modules"], events, ["k"], "ok").count() == 6


def test_scores(world):
    trace, events, g = world
    got = {r["module"]: r["evidence"] for r in locus.scored(trace, g["modules"], events, ["k"]).collect()}
    assert got == {"m.big": 0, "m.core": 2, "m.other": 3}


def test_external_callers(world):
    _, _, g = world
    got = {r["qualname"]: r["outside"] for r in locus.external_callers(g["symbols"], g["symbol_edges"]).collect()}
    assert got == {"m.other.C": 0, "m.other.__init__": 0, "m.other.value": 2, "m.other.get_it": 1, "m.gate.f": 0}


def test_context(world):
    trace, events, g = world
    rows = locus.failing_context(trace, g, events, "k").collect()
    assert len(rows) == 1  # a trace without a failing stage, or whose stage has no modules, has none
    r = rows[0].asDict()
    assert (r["k"], r["module"], r["blast_radius"], r["cycle"]) == ("i", "m.other", 2, ["m.other", "m.gate"])
    assert r["callers"] == ["m.c3", "m.c4", "m.c5", "m.c6", "m.c7", "m.c8"] and r["callees"] == ["m.z"]
    # called from outside and an entry verb, before more callers and more lines
    assert (r["symbol"], r["role"], r["symbol_callers"], r["symbol_callees"]) == ("m.other.get_it", "client", ["m.gate.f"], ["m.other.value"])


def test_empty_tables(world):
    trace, events, g = world
    none = {name: df.limit(0) for name, df in g.items()}
    assert locus.failing_context(trace, none, events, "k").count() == 0
    assert locus.failing_context(trace.limit(0), g, events.limit(0), "k").count() == 0
    assert locus.confirmed(trace, none["modules"], events, ["k"], "ok").count() == 0
