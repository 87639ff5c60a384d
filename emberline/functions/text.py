"""Column functions over event text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords, levels, mechanism rules and affinity classes of the event model.
CHANGE_KEYWORDS = ["deploy", "rollout", "release", "restart", "reboot", "rotat", "config change", "flag flip", "scaled down", "scale-down", "maintenance", "migration"]
RECOVERY_KEYWORDS = ["recovered", "restored", "back to normal", "warmed", "healthy again"]
ERROR_LEVELS = ["ERROR", "CRITICAL", "FATAL"]
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL"]
AFFINITY = {
    "credential": (["secret", "credential", "password", "key rotation", "certificate", "token"], ["auth", "credential", "permission", "denied", "certificate", "unauthorized"]),
    "capacity": (["restart", "reboot", "cold", "evict", "scale", "maintenance"], ["latency", "timeout", "saturat", "slow", "hit_ratio", "hit ratio", "miss", "queue"]),
    "config": (["config", "flag", "setting", "environment variable"], ["invalid", "parse", "unexpected", "not found", "missing"]),
}
MECHANISMS = {
    "dependency timeouts": ["timeout", "timed out"],
    "retry amplification": ["retry", "retries", "retrying"],
    "worker or queue saturation": ["saturat", "exhaust", "pool", "utilization"],
    "latency propagation": ["latency", "slow", "p95", "p99", "_ms"],
    "queue backlog growth": ["backlog", "depth", "queue"],
    "upstream errors": ["http 5", "500", "502", "503", "504"],
}
NO_MECHANISM = "downstream failure"
ELLIPSIS = "…"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_any(text: Column | str, keywords: Sequence[str]) -> Column:
    """Whether the lower-cased text holds a keyword: one regular expression instead of many searches. Null text: false."""
    import re

    return F.coalesce(F.lower(_c(text)).rlike("|".join(map(re.escape, keywords)).replace("\\ ", " ")), F.lit(False))


def first_rule(pairs: Sequence[tuple[Column, str]], default: Column) -> Column:
    """The label of the first condition that holds."""
    out = None
    for cond, label in pairs:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def metric_name(metric: Column | str, detail: Column | str) -> Column:
    named = F.regexp_extract(_c(detail), r"^\s*([a-zA-Z0-9_.:-]+)\s*=", 1)
    return F.coalesce(F.nullif(_c(metric), F.lit("")), F.nullif(named, F.lit("")), F.substring(_c(detail), 1, 40))


def metric_value(value: Column | str, detail: Column | str) -> Column:
    return F.coalesce(_c(value), F.nullif(F.regexp_extract(_c(detail), r"=\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"))


def is_change(source_type: Column | str, detail: Column | str) -> Column:
    return (_c(source_type) == "deployment") | ((_c(source_type) == "log") & has_any(detail, CHANGE_KEYWORDS))


def is_recovery(detail: Column | str) -> Column:
    return has_any(detail, RECOVERY_KEYWORDS)


def is_policy_rejection(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return F.coalesce(t.contains("model_blocked") | (t.contains("model") & t.contains("not allowed") & t.contains("virtual key")), F.lit(False))


def mechanism(text: Column | str) -> Column:
    return first_rule([(has_any(text, k), label) for label, k in MECHANISMS.items()], F.lit(NO_MECHANISM))


def affinity(change: Column | str, failure: Column | str) -> Column:
    return first_rule([(has_any(change, a) & has_any(failure, b), name) for name, (a, b) in AFFINITY.items()], F.lit(None).cast("string"))


def general(x: Column | str) -> Column:
    """A number with six significant digits and no trailing zeros, as ``%g`` of C prints it."""
    sci = F.format_string("%.5e", _c(x))  # six digits, rounded
    digits = sci.cast("decimal(30,12)").cast("string")
    small = F.concat(F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(sci, "e", -1))
    size = F.abs(sci.cast("double"))
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e6)), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(small)


def clip(text: Column | str, limit: int = 110) -> Column:
    """At most ``limit`` characters, cut at a word's end and marked with an ellipsis."""
    t = _c(text)
    cut = F.substring(t, 1, limit - 1)
    inside = ~F.substring(t, limit - 1, 1).rlike(r"^\s") & ~F.substring(t, limit, 1).rlike(r"^\s") & cut.contains(" ")
    words = F.when(inside, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(words, "[ ,;:-]+$", ""), F.lit(ELLIPSIS)))


def first_sentence(text: Column | str, limit: int = 200) -> Column:
    t = F.trim(_c(text))
    one = F.when(t.contains(". "), F.substring_index(t, ". ", 1)).otherwise(F.substring_index(t, "; ", 1))
    return clip(one, limit)


def safe_name(raw: Column | str, default: str = "service") -> Column:
    cleaned = F.regexp_replace(F.trim(F.coalesce(_c(raw), F.lit(""))), "[^A-Za-z0-9._-]+", "-")
    cleaned = F.substring(F.regexp_replace(cleaned, "^[-.]+|[-.]+$", ""), 1, 48)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def package(module: Column | str, depth: int = 2) -> Column:
    return F.array_join(F.slice(F.split(_c(module), r"\."), 1, depth), ".")


def relative_label(name: Column | str, group: Column | str) -> Column:
    n, g = _c(name), _c(group)
    last = F.element_at(F.split(n, r"\."), -1)
    return F.when(n.startswith(F.concat(g, F.lit("."))), F.substr(n, F.length(g) + 2)).otherwise(F.coalesce(F.nullif(last, F.lit("")), n))


def norm(name: Column | str) -> Column:
    return F.translate(F.lower(F.trim(_c(name))), "_ ", "--")


def gateway(host: Column | str) -> Column:
    label = F.split_part(_c(host), F.lit("."), F.lit(1))
    return F.when(label.endswith("gateway"), norm(label)).otherwise(F.concat(norm(label), F.lit("-gateway")))


def kebab(name: Column | str) -> Column:
    s = F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.translate(F.lower(s), "_", "-"), "^-+|-+$", "")


def offending_value(text: Column | str) -> Column:
    """The first quoted value that looks like an identifier: five characters or more, no space, with a dot, colon or slash."""
    found = F.regexp_extract_all(_c(text), F.lit("'([^']+)'|\"([^\"]+)\""), F.lit(0))
    inner = F.transform(found, lambda q: F.trim(F.substring(q, 2, 1 << 20).substr(F.lit(1), F.length(q) - 2)))
    good = F.filter(inner, lambda v: (F.length(v) >= 5) & ~v.contains(" ") & v.rlike("[./:]"))
    return F.try_element_at(good, F.lit(1))


def is_invalid_identifier(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return t.contains("model identifier is invalid") | (t.contains("validationexception") & t.contains("model") & (t.contains("invalid") | t.contains("not found")))


def is_configuration_change(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return (t.contains("model_id") | t.contains("model id")) & (t.contains("config") | t.contains("environment variable")) & (t.contains("set") | t.contains("change") | t.contains("updated"))


def spoken_failure(text: Column | str, limit: int = 200) -> Column:
    return (
        F.when(is_policy_rejection(text), "The gateway rejected the configured model because it is not allowed for the active virtual key")
        .when(is_invalid_identifier(text), "The model provider rejected the configured model identifier as invalid")
        .otherwise(first_sentence(text, limit))
    )


def event_logger(logger: Column | str, detail: Column | str) -> Column:
    """The logger attribute, else the dotted name in brackets at the text's end, else an empty text."""
    return F.coalesce(F.nullif(_c(logger), F.lit("")), F.regexp_extract(_c(detail), r"\[([A-Za-z_][\w.]*)\]\s*$", 1))


def iso(ts: Column | str) -> Column:
    """A UTC time in ISO format, with microseconds only where there are some."""
    t = _c(ts)
    micros = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def incident_id(system: Column | str, source: Column | str, started: Column | str) -> Column:
    digest = F.substring(F.sha1(F.concat_ws(":", _c(system), _c(source), iso(started))), 1, 6)
    return F.concat(F.lit("INC-"), F.date_format(_c(started), "yyyyMMdd"), F.lit("-"), digest)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """The exact difference in seconds of two times without zone."""
    micros = lambda c: F.unix_micros(_c(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6
