"""What linked evidence says of modules: how strongly it names them, whether it confirms a failure or a success, the overlay on the code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the traces of a service meet its modules, so that no service is one task.
SPREAD = 16


def marker(module: Column) -> Column:
    return F.concat(F.lit("["), module, F.lit("]"))


def logger_matches(module: Column, logger: Column) -> Column:
    """Whether a logger is the module's own or one below it."""
    name = F.trim(F.coalesce(logger, F.lit("")))
    return (name == module) | name.startswith(F.concat(module, F.lit(".")))


def scores(modules: DataFrame, stages: DataFrame, linked: DataFrame, key: list[str]) -> DataFrame:
    """``modules`` (key..., module, ...) with ``evidence``: 3 where the failing stage's detail or a linked event names the module, 2 where only a logger below it does, else 0.

    ``stages`` has key..., stage_detail: the failing stage's; ``linked`` has key..., logger, detail: the events linked to it.
    """
    m = F.col("module")
    name = F.trim(F.coalesce("logger", F.lit("")))
    exact = (name == m) | F.coalesce(F.col("detail").contains(marker(m)), F.lit(False))
    found = F.when(exact, 3).when(name.startswith(F.concat(m, F.lit("."))), 2).otherwise(0)
    # events count once for each different logger and detail, whatever their number
    told = linked.select(*key, "logger", "detail").distinct()
    by = modules.select(*key, "module").distinct().join(told, key).groupBy(*key, "module").agg(F.max(found).alias("told"))
    rows = modules.join(by, [*key, "module"], "left").join(stages.select(*key, "stage_detail"), key, "left")
    named = F.coalesce(F.col("stage_detail").contains(marker(m)), F.lit(False))
    return rows.withColumn("evidence", F.when(named, 3).otherwise(F.coalesce("told", F.lit(0)))).drop("told", "stage_detail")


def confirmed(stages: DataFrame, linked: DataFrame, key: list[str], status: str) -> DataFrame:
    """(key..., module, confirmed): whether a stage of that status has evidence of its module: its detail's mark, or a linked event's logger (of a failure its mark too).

    ``stages`` has key..., module, status, detail; ``linked`` has key..., logger, detail. With ``status`` failed this is
    the log-confirmed module, with ok the module of linked success.
    """
    m = F.col("module")
    hit = logger_matches(m, F.col("logger"))
    if status == "failed":
        hit = hit | F.coalesce(F.col("event_detail").contains(marker(m)), F.lit(False))
    told = linked.select(*key, "logger", F.col("detail").alias("event_detail")).distinct()
    by = stages.select(*key, "module").distinct().join(told, key).groupBy(*key, "module").agg(F.bool_or(hit).alias("told"))
    rows = stages.join(by, [*key, "module"], "left")
    said = F.coalesce(F.col("detail").contains(marker(m)), F.lit(False)) | F.coalesce("told", F.lit(False))
    return rows.select(*key, "module", F.coalesce((F.col("status") == status) & m.isNotNull() & said, F.lit(False)).alias("confirmed"))


def overlay(path: DataFrame, modules: DataFrame, failing: DataFrame, key: list[str]) -> DataFrame:
    """(key..., path_modules, failing_module): the modules of a trace's stages in the path's order, and the failing one if the graph knows it.

    ``path`` has key..., service, pos, stage; ``modules`` has service, module, stage, ord; ``failing`` has key..., service,
    failing_stage, failing_module, which null gives way to the failing stage's first module. A path's stages are few.
    """
    listed = modules.where("stage is not null")
    first = listed.groupBy("service", F.col("stage").alias("failing_stage")).agg(F.min_by("module", "ord").alias("first"))
    known = modules.select("service", F.col("module").alias("named")).distinct()
    found = failing.join(first, ["service", "failing_stage"], "left").withColumn("named", F.coalesce("failing_module", "first"))
    found = found.join(known.withColumn("known", F.lit(True)), ["service", "named"], "left").select(*key, F.when(F.col("known"), F.col("named")).alias("failing_module"))

    # a trace stays its few stages until it is with its service's modules, and becomes modules last: no pair of both is shuffled
    steps = F.array_sort(F.collect_list(F.struct("pos", "service", "stage")))
    walks = path.where("service is not null and stage is not null").groupBy(*key).agg(steps.alias("steps")).withColumn("services", F.array_distinct("steps.service"))
    # steps of one place are sorted together by their modules
    place = lambda x: F.coalesce(F.array_position("steps.pos", x["pos"]), F.lit(0)).cast("long") * (1 << 32)
    one = walks.where(F.size("services") == 1).select(*key, F.get("services", F.lit(0)).alias("service"), F.transform("steps", lambda x: F.struct(place(x).alias("at"), x["stage"].alias("stage"))).alias("walk"))
    # traces through several services are few: their modules are gathered from the pairs
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ord", "module"))), lambda x: x["module"])
    several = walks.where(F.size("services") > 1).select(*key, F.inline("steps")).join(listed, ["service", "stage"]).groupBy(*key).agg(rows.alias("gathered"))

    ranked = listed.where("service is not null").withColumn("n", F.row_number().over(Window.partitionBy("service").orderBy("ord", "module")) - 1)
    names = ranked.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "module"))), lambda x: x["module"]).alias("names"))
    places = ranked.groupBy("service", "stage").agg(F.collect_list(F.col("n").cast("long")).alias("ns")).groupBy("service").agg(F.map_from_entries(F.collect_list(F.struct("stage", "ns"))).alias("places"))
    atlas = names.join(places, "service").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))

    out = found.join(one, key, "left").join(several, key, "left").withColumn("part", F.pmod(F.xxhash64(*key), F.lit(SPREAD)).cast("int")).join(atlas, ["service", "part"], "left")
    none = F.array().cast("array<bigint>")
    met = F.flatten(F.transform("walk", lambda x: F.transform(F.coalesce(F.try_element_at("places", x["stage"]), none), lambda n: x["at"] + n)))
    walked = F.transform(F.sort_array(met), lambda v: F.get("names", v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))
    return out.select(*key, F.coalesce("gathered", walked, F.array().cast("array<string>")).alias("path_modules"), "failing_module")
