"""Log lines to structured events: five formats tried in order, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import LEVELS
from emberline.operators.graph import cut

# The line formats, and the keys that structured lines use.
STAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?"
LOGGING = rf"(?U)^({STAMP})\s*-\s*([\w.\-]+)\s*-\s*([A-Za-z]+)\s*-\s*(.*)$"
SPRING = rf"(?U)^({STAMP})\s+([A-Z]+)\s+\d+\s+---\s+\[([^\]]*)\]\s+(\S+)\s*:\s*(.*)$"
PREFIX = rf"(?U)^\[?({STAMP}(?:Z|[+-]\d{{2}}:?\d{{2}})?)\]?\s+\[?([A-Za-z]+)\]?[: ]\s*(.*)$"
LEVEL_ONLY = r"(?U)^\[?([A-Za-z]+)\]?[:\-]\s+(.*)$"
TIME_KEYS = ["timestamp", "time", "ts", "asctime", "@timestamp", "datetime"]
LEVEL_KEYS = ["level", "levelname", "severity", "loglevel"]
MESSAGE_KEYS = ["message", "msg", "event", "detail", "text"]
LOGGER_KEYS = ["logger", "name", "logger_name", "module"]
#: Lines of a block that is gone over by itself.
BLOCK = 4096
#: Everything that ends a line.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def instant(raw: Column) -> Column:
    """A time in ISO form as UTC without zone; no zone means UTC; null where it is none."""
    t = F.translate(F.trim(raw), ",", ".")
    zoned = F.regexp_replace(t, r"(:\d{2}:\d{2}(?:\.\d+)?)$", "$1Z")  # no zone
    zoned = F.regexp_replace(zoned, r"(:.*[+-]\d{2})(\d{2})$", "$1:$2")
    micros = F.coalesce(F.unix_micros(zoned.try_cast("timestamp")), F.unix_micros(F.concat(t, F.lit("T00:00:00Z")).try_cast("timestamp")))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / F.lit(1000000)).cast("decimal(18,6)"))


def _field(line: Column, keys: list[str], truthy: bool) -> Column:
    found = []
    for k in keys:
        v = F.get_json_object(line, f"$['{k}']")
        found.append(F.when(~v.isin("", "0", "0.0", "false", "[]", "{}"), v) if truthy else v)
    return F.coalesce(*found)


def parsed(rows: DataFrame, line: str) -> DataFrame:
    """``rows`` with the column ``p``, a struct (ts, level, message, logger) of each line; null for a blank line.

    The formats are tried in order, and one counts only with a known level. The form is found first and the
    fields are read after, each expression once, so that the generated code stays small.
    """
    raw = F.col(line)
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    part = lambda p, n: F.regexp_extract(raw, p, n)
    known = lambda p, n: raw.rlike(p) & F.upper(part(p, n)).isin(LEVELS)
    is_json = text.startswith("{") & text.endswith("}") & F.get_json_object(text, "$").isNotNull()
    form = F.when(text == "", 0).when(is_json, 1).when(known(LOGGING, 3), 2).when(known(SPRING, 2), 3).when(known(PREFIX, 2), 4).when(known(LEVEL_ONLY, 1), 5).otherwise(6)
    of = lambda **k: F.coalesce(*(F.when(F.col("form_") == int(n[1:]), c) for n, c in k.items()))
    body = F.trim(F.col("text_"))
    fields = {
        "ts_": of(f1=_field(body, TIME_KEYS, False), f2=part(LOGGING, 1), f3=part(SPRING, 1), f4=part(PREFIX, 1)),
        "level_": of(f1=_field(body, LEVEL_KEYS, True), f2=part(LOGGING, 3), f3=part(SPRING, 2), f4=part(PREFIX, 2), f5=part(LEVEL_ONLY, 1)),
        "message_": of(f1=_field(body, MESSAGE_KEYS, True), f2=F.trim(part(LOGGING, 4)), f3=F.trim(part(SPRING, 5)), f4=F.trim(part(PREFIX, 3)), f5=F.trim(part(LEVEL_ONLY, 2))),
        "logger_": of(f1=_field(body, LOGGER_KEYS, True), f2=part(LOGGING, 2), f3=part(SPRING, 4)),
    }
    found = rows.withColumns({"form_": form, "text_": text}).withColumns(fields)
    row = F.struct(instant(F.col("ts_")).alias("ts"), F.upper(F.coalesce("level_", F.lit("INFO"))).alias("level"), F.coalesce("message_", "text_").alias("message"), F.coalesce("logger_", F.lit("")).alias("logger"))
    return found.withColumn("p", F.when(F.col("form_") > 0, row)).drop("form_", "text_", *fields)


def events(lines: DataFrame) -> DataFrame:
    """Lines (service, file, modified, line_no, value) to log events of each service, numbered over its files in order.

    A line without a time takes the last one before it in its service, else its file's time of modification. Lines are
    parsed once and kept in the checkpoint folder, as they are gone over twice.
    """
    found = cut(parsed(lines, "value").where("p is not null").drop("value").withColumn("block", F.floor(F.col("line_no") / BLOCK)))
    # blocks of lines are gone over apart, then their results, of which there are few, in order
    key = ["service", "file", "block"]
    inner = Window.partitionBy(*key).orderBy("line_no")
    found = found.withColumns({"own": F.last("p.ts", ignorenulls=True).over(inner), "nth": F.row_number().over(inner)})
    timed = F.when(F.col("p.ts").isNotNull(), F.col("line_no"))
    blocks = found.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.max_by("p.ts", timed).alias("last"), F.min_by("modified", "line_no").alias("modified"))
    every = Window.partitionBy("service").orderBy("file", "block")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    # a file without any time so far gives its own time to the lines that follow, in later files too
    scanned = blocks.select(*key, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("passed"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.first("modified").over(every)).alias("carried"))
    rows = found.join(scanned, key).withColumns({"at": F.coalesce("own", "carried"), "n": F.col("passed") + F.col("nth")})
    detail = F.when(F.col("p.logger") != "", F.concat("p.message", F.lit(" ["), "p.logger", F.lit("]"))).otherwise(F.col("p.message"))
    ident = F.concat("service", F.lit("-log-"), F.when(F.col("n") < 100000, F.lpad(F.col("n").cast("string"), 5, "0")).otherwise(F.col("n").cast("string")))
    return rows.select(ident.alias("id"), F.lit("log").alias("source_type"), F.col("service").alias("source"), F.col("at").alias("ts"), detail.alias("detail"), F.col("p.level").alias("level"), "file", F.col("p.logger").alias("logger"), "n")


def looks_like_logs(text: Column | str) -> Column:
    """Whether at least a quarter of two or more non-blank lines (and one line at least) names a level."""
    t = F.col(text) if isinstance(text, str) else text
    rows = F.filter(F.split(F.coalesce(t, F.lit("")), BREAKS), lambda x: F.trim(x) != "")
    named = F.filter(rows, lambda x: x.rlike(r"\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\b"))
    return (F.size(rows) >= 2) & (F.size(named) >= F.greatest(F.lit(1), F.floor(F.size(rows) / 4)))
