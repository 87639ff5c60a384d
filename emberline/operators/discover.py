"""Architecture discovery from texts: compose files, configuration that names other services, hosts called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text as X

#: Hosts that are no part of a system (fixed values).
IGNORED_HOSTS = [
    "localhost", "127.0.0.1", "0.0.0.0", "github.com", "gitlab.com", "bitbucket.org", "npmjs.org", "registry.npmjs.org", "pypi.org",
    "files.pythonhosted.org", "maven.apache.org", "repo.maven.apache.org", "docker.io", "docker.com", "schema.org", "www.w3.org",
    "json-schema.org", "example.com", "sentry.io", "googleapis.com", "internal.com", "openai.com", "api.openai.com", "anthropic.com",
    "api.anthropic.com", "elevenlabs.io", "backblazeb2.com",
]
#: Names and packages that tell of a frontend (fixed values).
FRONTEND_HINTS = ["frontend", "front-end", "webapp", "web-app", "ui", "www", "client"]
FRONTEND_PACKAGES = ["react", "vue", "next", "@angular/core", "svelte"]


def compose_services(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) of compose files to (file, service, line_no, dependency); a service without any has one row with null.

    The parser's state (inside services, current service, inside its dependencies) is carried down the lines by windows.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    v = F.col("value")
    top = F.when(v.rlike(r"^services:\s*$"), True).when(v.rlike(r"^[A-Za-z0-9_#\-]+:"), False)
    rows = lines.withColumn("inside", F.last(top, ignorenulls=True).over(w)).where(F.col("inside") & ~v.rlike(r"^services:\s*$"))
    name = F.nullif(F.regexp_extract(v, r"^  ([A-Za-z0-9_.\-]+):\s*$", 1), F.lit(""))
    rows = rows.withColumn("own", name).withColumn("service", F.last("own", ignorenulls=True).over(w)).where("service is not null")
    dep = F.nullif(F.regexp_extract(v, r"^\s+-\s+([A-Za-z0-9_.\-]+)\s*$", 1), F.lit(""))
    flag = F.when(F.col("own").isNotNull(), False).when(v.rlike(r"^\s{4,}depends_on:\s*$"), True).when(dep.isNull() & (F.trim(v) != "") & ~v.startswith(" " * 6), False)
    rows = rows.withColumn("listing", F.last(flag, ignorenulls=True).over(w)).withColumn("dep", F.when(F.col("listing"), dep))
    kept = rows.where("own is not null or dep is not null")
    return kept.select("file", X.norm("service").alias("service"), "line_no", X.norm("dep").alias("dependency"))


def named_services(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(service, dependency): services whose text names another one, with a character on either side that no name has.

    ``texts`` has (service, text). Texts are cut into words once and joined by equality; a name of several words
    (joined by hyphens or dots) is found as as many words in a row.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+|[^a-z0-9]"), F.lit(0))
    longest = names.agg(F.max(F.size(F.regexp_extract_all("service", F.lit("[a-z0-9]+|[^a-z0-9]"), F.lit(0)))).alias("most"))
    rows = texts.select("service", word.alias("w")).join(F.broadcast(longest))  # one row
    # the first and last words touch the text's ends, where a name does not count
    at = rows.select("service", "w", "most", F.explode(F.sequence(F.lit(2), F.greatest(F.size("w") - 1, F.lit(2)))).alias("i")).where("size(w) > 2")
    grams = at.select("service", "w", "i", F.explode(F.sequence(F.lit(1), F.least("most", F.size("w") - F.col("i")))).alias("n"))
    grams = grams.select("service", F.array_join(F.slice("w", F.col("i"), F.col("n")), "").alias("dependency"))
    known = names.select(F.col("service").alias("dependency")).distinct()
    return grams.distinct().join(known, "dependency", "left_semi").where("service <> dependency").select("service", "dependency")


def hosts(texts: DataFrame, key: str, text: str, ignored: Sequence[str] = IGNORED_HOSTS) -> DataFrame:
    """(key, host, node): hosts that a text calls, but for ignored ones and their subdomains."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"https?://([a-zA-Z0-9.\-]+)"), F.lit(1))).alias("h")).select(key, F.lower("h").alias("host")).distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))
    bad = F.arrays_overlap(suffixes, F.array(*map(F.lit, ignored))) if ignored else F.lit(False)
    return found.where(~bad).select(key, "host", X.gateway("host").alias("node"))


def is_frontend(name):
    return X.has_any(name, FRONTEND_HINTS)


def frontends(names: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(service): the frontends among ``names``: by their own name, or by what their ``package.json`` depends on.

    ``manifests`` has (service, content). A manifest that is no JSON tells nothing.
    """
    named = names.where(is_frontend("service")).select("service").distinct()
    if manifests is None:
        return named
    doc = F.try_parse_json("content")
    keys = lambda part: F.coalesce(F.map_keys(F.try_variant_get(doc, f"$.{part}", "map<string,variant>")), F.array().cast("array<string>"))
    packages = F.array_union(keys("dependencies"), keys("devDependencies"))
    told = manifests.where(F.arrays_overlap(packages, F.array(*map(F.lit, FRONTEND_PACKAGES)))).select("service")
    return named.union(told.join(names.select("service"), "service", "left_semi")).distinct()


def without_frontend_targets(edges: DataFrame, frontend: DataFrame | None = None) -> DataFrame:
    """Nothing depends on a frontend: one of ``frontend`` (service), or one that is called so."""
    if frontend is None:
        return edges.where(~is_frontend("dependency"))
    return edges.join(frontend.select(F.col("service").alias("dependency")), "dependency", "left_anti").select(*edges.columns)


def architecture(names: DataFrame, edges: DataFrame, calls: DataFrame, manifests: DataFrame | None = None, internals: DataFrame | None = None) -> DataFrame:
    """(service, depends_on, user_facing, owner): every service with its sorted dependencies, and a node for each outside host.

    ``edges`` (service, dependency) are inside the system, ``calls`` (service, host, node) go out of it, ``manifests``
    (service, content) are package files. With ``internals`` (service, internals), the pipelines found in the services'
    files, rows have them too.
    """
    frontend = frontends(names, manifests)
    inner = without_frontend_targets(edges.join(names.select(F.col("service").alias("dependency")), "dependency", "left_semi"), frontend)
    every = inner.select("service", "dependency").union(calls.select("service", F.col("node"))).where("service <> dependency")
    deps = every.groupBy("service").agg(F.array_sort(F.collect_set("dependency")).alias("depends_on"))
    none = F.array().cast("array<string>")
    facing = frontend.withColumn("facing", F.lit(True))
    own = names.select("service").distinct().join(deps, "service", "left").join(facing, "service", "left")
    own = own.select("service", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("facing", F.lit(False)).alias("user_facing"), F.lit(None).cast("string").alias("owner"))
    outside = calls.groupBy("node").agg(F.max("host").alias("host")).select(F.col("node").alias("service"), none.alias("depends_on"), F.lit(False).alias("user_facing"), F.concat(F.lit("external · "), "host").alias("owner"))
    every = own.unionByName(outside)
    return every if internals is None else every.join(internals, "service", "left")
