"""Files in and out: scenarios, architectures, code graphs, logs, catalogs, reports. Paths go to Spark's readers alone."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import attributes as A
from emberline.functions import lines as L

EVENT = "id string, source_type string, source string, timestamp string, detail string, attributes variant"
ARCHITECTURE = "system string, services array<struct<name:string,owner:string,depends_on:array<string>,user_facing:boolean,internals:struct<entry:string,stages:array<struct<name:string,modules:array<string>,description:string>>,edges:array<array<string>>>>>"
MODULE = "name:string,kind:string,stage:string,defs:array<string>,loc:int,fan_in:int,fan_out:int,blast_radius:int,in_cycle:boolean"
EDGE = "src:string,dst:string,kind:string,symbols:array<string>,count:int"
SYMBOL = "qualname:string,module:string,name:string,kind:string,parent:string,role:string,stage:string,lineno:int,loc:int,decorators:array<string>"
SYMBOL_EDGE = "src:string,dst:string,kind:string,lineno:int,count:int"
CODE_GRAPH = f"services map<string,struct<modules:array<struct<{MODULE}>>,edges:array<struct<{EDGE}>>,symbols:array<struct<{SYMBOL}>>,symbol_edges:array<struct<{SYMBOL_EDGE}>>,cycles:array<array<string>>,symbol_cycles:array<array<string>>>>"


def folder_of_file() -> Column:
    """The name of the folder in which a row's file lies: a scenario's name."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def read_scenarios(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Event files, each a JSON array, to telemetry; the folder names the incident, ``seq`` is the place in its file. Malformed files give no row.

    ``attributes`` keeps every attribute with its type; a metric's value is one only where it is a number.
    """
    rows = spark.read.schema(EVENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths)
    # a file of this form is read by one task, in order
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), folder_of_file().alias("incident_key")).withColumn("n", F.monotonically_increasing_id())
    a = F.col("attributes")
    return rows.select(
        "incident_key", (F.col("n") - F.min("n").over(Window.partitionBy("file"))).alias("seq"), "id", "source_type", "source", L.instant(F.col("timestamp")).alias("ts"), "detail",
        A.text(a, "level").alias("level"), A.text(a, "logger").alias("logger"), A.text(a, "metric").alias("metric"), A.number(a, "value").alias("value"), A.text(a, "unit").alias("unit"), "attributes",
    )


def scenario_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_scenarios(spark, paths).select("incident_key").distinct()


def read_architectures(spark: SparkSession, paths: str | list[str], multiline: bool = True) -> dict[str, DataFrame]:
    """Services, their edges, stages and stage edges of each architecture file; a file is one document, or with ``multiline`` off one a line."""
    services = spark.read.schema(ARCHITECTURE).option("multiLine", multiline).json(paths).select(folder_of_file().alias("incident_key"), "system", F.posexplode("services").alias("pos", "s"))
    flat = services.select("incident_key", "system", "pos", F.col("s.name").alias("service"), F.col("s.owner").alias("owner"), F.coalesce("s.user_facing", F.lit(False)).alias("user_facing"), "s")
    inner = flat.where("s.internals is not null")
    return {
        "services": flat.drop("s"),
        "service_edges": flat.select("incident_key", "service", F.posexplode("s.depends_on").alias("ord", "dependency")),
        "stages": inner.select("incident_key", "service", F.posexplode("s.internals.stages").alias("ord", "t")).select("incident_key", "service", "ord", F.col("t.name").alias("stage"), F.col("t.modules").alias("modules")),
        "stage_edges": inner.select("incident_key", "service", F.posexplode("s.internals.edges").alias("ord", "e")).select("incident_key", "service", "ord", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")),
        "stage_entry": inner.select("incident_key", "service", F.col("s.internals.entry").alias("entry")),
    }


def read_code_graphs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Modules, edges, symbols and symbol edges by service; empty tables where there is no file."""
    try:
        graphs = spark.read.schema(CODE_GRAPH).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        graphs = spark.createDataFrame([], T._parse_datatype_string(CODE_GRAPH))
    each = graphs.select(F.explode("services").alias("service", "g"))
    return {name: each.select("service", F.posexplode(f"g.{name}").alias("ord", "x")).select("service", "ord", "x.*") for name in ("modules", "edges", "symbols", "symbol_edges")}


def write_code_graphs(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of ``read_code_graphs`` as JSON, one document for each service: ``{"services": {name: graph}}``."""
    out = None
    for name, df in tables.items():
        cols = [c for c in df.columns if c not in ("service", "ord")]
        packed = df.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("x")))), lambda r: r["x"]).alias(name))
        out = packed if out is None else out.join(packed, "service", "full")
    graph = F.struct(*tables)
    out.select(F.to_json(F.struct(F.create_map("service", graph).alias("services"))).alias("value")).write.mode("overwrite").text(path)


def read_logs(spark: SparkSession, paths: str | list[str], sources: DataFrame) -> DataFrame:
    """Lines of log files with their service: (service, file, modified, line_no, value); bytes that are no UTF-8 are replaced.

    ``sources`` has (service, pattern), a pattern of LIKE on the file's path; it is matched once a file. Files are read
    by splits, so that a large one keeps many tasks busy. The lines of a split are numbered where they are read, without
    a shuffle; a second narrow reading counts those of the splits before.
    """
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("time"), "value")
    # the reader ends lines at \n, \r and both; the other ends are looked for in what it gives
    lines = read.select("file", "block", "time", F.explode(F.split(F.make_valid_utf8("value"), L.BREAKS)).alias("value")).withColumn("n", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size"), F.min("time").alias("time"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0)))
    owners = blocks.select("file").distinct().join(sources, F.expr("file like pattern")).select("file", "service")
    placed = blocks.join(owners, "file").withColumn("modified", F.to_timestamp_ntz(F.col("time").cast("string"))).drop("time", "size")
    return lines.drop("time").join(placed, ["file", "block"]).select("service", "file", "modified", (F.col("n") - F.col("first") + F.col("before")).alias("line_no"), "value")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries (JSON lines) as variants; malformed and blank lines go."""
    return spark.read.text(path).select(F.try_parse_json(F.trim("value")).alias("entry")).where("entry is not null and schema_of_variant(entry) like 'OBJECT%'")


def write_catalog(catalog: DataFrame, path: str, mode: str = "append") -> None:
    catalog.write.mode(mode).json(path)


def write_documents(star: dict[str, DataFrame], path: str, overwrite: str = "static") -> None:
    """One JSON document for each incident, in a folder of its own; ``dynamic``: folders of other incidents stay."""
    documents(star).write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("incident_key").text(path)


def documents(star: dict[str, DataFrame]) -> DataFrame:
    """(incident_key, value): each incident's report as one JSON document, its lists in order."""
    out = star["texts"].join(star["facts"].select("incident_key", "started_at", "detected_at", "impact_text"), "incident_key")
    for name, by in (("timeline", "idx"), ("hypotheses", "rank"), ("propagation", "step"), ("actions", "priority"), ("gaps", "pos"), ("affected", "place")):
        df = star[name]
        cols = [c for c in df.columns if c != "incident_key"]
        packed = df.groupBy("incident_key").agg(F.array_sort(F.collect_list(F.struct(by, *(c for c in cols if c != by)))).alias(name))
        out = out.join(packed, "incident_key", "left")
    return out.select("incident_key", F.to_json(F.struct(*(c for c in out.columns if c != "incident_key"))).alias("value"))


def digest(document: Column | str) -> Column:
    """sha256 of a JSON document written with its keys in order."""
    return F.sha2(document, 256)
