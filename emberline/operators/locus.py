"""Where in the code an incident failed: the failing stage's module with its surroundings, the symbol in it, and what a trace confirms.

A trace (``trace.trace``) has key..., service, stage, status, detail, evidence_ids, failing, path. ``events`` has key..., id,
logger, detail. The code graph has modules (service, seq, module, stage, loc, blast_radius, cycle: its members or null), edges
(service, seq, src, dst, kind), symbols (service, seq, qualname, module, name, kind, role, loc) and symbol edges like edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import code
from emberline.operators.evidence import logger_matches, marker


def linked_events(traced: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """(key..., service, stage, logger, said): what the events that a stage names as its evidence say, each different saying once."""
    named = traced.select(*key, "service", "stage", F.explode("evidence_ids").alias("id"))
    return named.join(events.select(*key, "id", "logger", F.col("detail").alias("said")), [*key, "id"]).select(*key, "service", "stage", "logger", "said").distinct()


def confirmed(traced: DataFrame, modules: DataFrame, events: DataFrame, key: list[str], status: str) -> DataFrame:
    """(key..., service, stage, module, confirmed): whether the trace confirms a stage's module as failed or as a success.

    ``status`` failed: the failing stage failed, and its detail or one of its linked events bears the module's mark, or an
    event's logger is the module's. ``status`` ok: the stage is on the trace's path and ended well, and its detail bears
    the mark or a linked event's logger is the module's; the mark in an event is not enough.
    """
    m, where = F.col("module"), [*key, "service", "stage"]
    right = F.col("stage") == F.col("failing") if status == "failed" else F.array_contains("path", F.col("stage"))
    rows = traced.where((F.col("status") == status) & right).join(modules.where("stage is not null").select("service", "stage", "module").distinct(), ["service", "stage"])
    hit = logger_matches(m, F.col("logger"))
    if status == "failed":
        hit = hit | F.coalesce(F.col("said").contains(marker(m)), F.lit(False))
    told = rows.select(*where, "module").join(linked_events(traced, events, key), where).groupBy(*where, "module").agg(F.bool_or(hit).alias("told"))
    found = rows.join(told, [*where, "module"], "left").select(*where, "module", (F.coalesce(F.col("detail").contains(marker(m)), F.lit(False)) | F.coalesce("told", F.lit(False))).alias("yes"))
    every = traced.select(*where).join(modules.where("stage is not null").select("service", "stage", "module").distinct(), ["service", "stage"])
    return every.join(found, [*where, "module"], "left").select(*where, "module", F.coalesce("yes", F.lit(False)).alias("confirmed"))


def scored(traced: DataFrame, modules: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """(key..., service, seq, module, loc, evidence): the failing stage's modules, 3 where its detail or its linked events name one, 2 where a logger lies below it, else 0."""
    m, where = F.col("module"), [*key, "service", "stage"]
    failing = traced.where("stage = failing")
    rows = failing.select(*where, F.col("detail").alias("stage_detail")).join(modules.select("service", "stage", "seq", "module", "loc"), ["service", "stage"])
    name = F.trim(F.coalesce("logger", F.lit("")))
    exact = (name == m) | F.coalesce(F.col("said").contains(marker(m)), F.lit(False))
    told = rows.select(*where, "module").distinct().join(linked_events(failing, events, key), where)
    told = told.groupBy(*where, "module").agg(F.max(F.when(exact, 3).when(name.startswith(F.concat(m, F.lit("."))), 2).otherwise(0)).alias("told"))
    named = F.coalesce(F.col("stage_detail").contains(marker(m)), F.lit(False))
    return rows.join(told, [*where, "module"], "left").select(*key, "service", "seq", "module", "loc", F.when(named, 3).otherwise(F.coalesce("told", F.lit(0))).alias("evidence"))


def near(edges: DataFrame, nodes: DataFrame, of: str, other: str, name: str, most: int, calls_first: bool = True) -> DataFrame:
    """(service, node, name): of each asked node the first ``most`` different ``other`` ends, call edges first, then in the edges' order.

    A hub's edges are ranked by a window that keeps the first few, so no list holds more than ``most``.
    """
    late = (F.col("kind") != "call") if calls_first else F.lit(False)
    own = edges.withColumn("node", F.col(of)).join(nodes.select("service", "node").distinct(), ["service", "node"], "left_semi")
    first = own.groupBy("service", "node", F.col(other).alias("near")).agg(F.min(F.struct(late.alias("late"), "seq")).alias("at"))
    w = Window.partitionBy("service", "node").orderBy("at", "near")
    kept = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return kept.groupBy("service", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "near"))), lambda x: x["near"]).alias(name))


def external_callers(symbols: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """(service, qualname, outside): how many edges lead to each symbol from other modules; a caller that is no known symbol is outside."""
    home = symbols.select("service", "qualname", "module").distinct()
    src = home.select("service", F.col("qualname").alias("src"), F.col("module").alias("from"))
    dst = home.select("service", F.col("qualname").alias("dst"), F.col("module").alias("to"))
    out = symbol_edges.select("service", "src", "dst").join(dst, ["service", "dst"]).join(src, ["service", "src"], "left").where(~F.col("from").eqNullSafe(F.col("to")))
    counts = out.groupBy("service", F.col("dst").alias("qualname")).agg(F.count(F.lit(1)).alias("outside"))
    return home.select("service", "qualname").distinct().join(counts, ["service", "qualname"], "left").fillna(0, ["outside"])


def failing_context(traced: DataFrame, graph: dict[str, DataFrame], events: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, service, module, callers, callees, blast_radius, cycle, symbol, role, symbol_callers, symbol_callees) of each incident whose failing stage has modules.

    Traces without a failing stage, and stages without modules, have no row. A module without a fitting symbol has nulls for
    it. Lists are empty where nobody calls.
    """
    modules, edges, symbols, calls = (graph[n] for n in ("modules", "edges", "symbols", "symbol_edges"))
    none = F.array().cast("array<string>")
    best = code.failing_module(scored(traced, modules, events, [key]), key)
    found = best.join(traced.select(key, "service").distinct(), key).join(modules.select("service", "module", "blast_radius", "cycle"), ["service", "module"])
    asked = found.select("service", F.col("module").alias("node")).distinct()
    # one symbol for each failing module, however many incidents failed there
    inside = symbols.withColumn("node", F.col("module")).join(asked, ["service", "node"], "left_semi").join(external_callers(symbols, calls), ["service", "qualname"])
    chosen = code.failing_symbol(inside, ["service", "module"]).select("service", "module", F.col("qualname").alias("symbol"), "role")
    locus = chosen.select("service", F.col("symbol").alias("node"))
    out = found.join(chosen, ["service", "module"], "left")
    for table, nodes, of, node, name, first in ((edges, asked, ("dst", "src"), "module", "callers", True), (edges, asked, ("src", "dst"), "module", "callees", True), (calls, locus, ("dst", "src"), "symbol", "symbol_callers", False), (calls, locus, ("src", "dst"), "symbol", "symbol_callees", False)):
        out = out.join(near(table, nodes, *of, name, most, first).withColumnRenamed("node", node), ["service", node], "left").withColumn(name, F.coalesce(name, none))
    return out.select(key, "service", "module", "callers", "callees", "blast_radius", F.coalesce("cycle", none).alias("cycle"), "symbol", "role", "symbol_callers", "symbol_callees")
