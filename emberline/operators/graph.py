"""Graph operators: fixpoint loops over tables, each round a join; lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text as X

#: Rounds of labels, and of trimming, in a pass of the search for rings; the first doubles where a pass finds none. They bound a pass and not the result.
HOPS, TRIMS = 16, 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``. Only a session in one process may have one of our own instead."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared checkpoint folder: cuts lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, in columns and packed: for long tables, of which each reader takes a few columns. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored_{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(edges: DataFrame) -> DataFrame:
    """Each edge once, no self loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def ordered_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, seq): the first place of each edge that is no self loop. ``edges`` has src, dst, seq."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.min("seq").alias("seq"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = clean(edges).join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return e.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct neighbours, both ends known, no self loops."""
    e = known_edges(nodes, edges)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    inn = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    zero = F.lit(0).cast("long")
    return nodes.join(inn, "node", "left").join(out, "node", "left").select("node", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def least_labels(nodes: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, bool]:
    """(node, label): the least node that leads to each within ``hops`` edges, itself included; and whether more edges would change nothing."""
    labels = nodes.select("node", F.col("node").alias("label"))
    for _ in range(hops):
        near = edges.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("near"))
        new = cut(labels.join(near, F.col("node") == F.col("dst"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels, True
    return labels, False


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def marks(edges: DataFrame, hops: int) -> tuple[DataFrame, bool]:
    """(node, down, up): the least node that leads to each, and that it leads to, within ``hops`` edges; and whether that is all.

    Where both are one node, all that have it reach one another. Nodes that reach one another have the same two marks, once that is all.
    """
    n = nodes_of(edges)
    (down, a), (up, b) = least_labels(n, edges, hops), least_labels(n, turned(edges), hops)
    return cut(down.withColumnRenamed("label", "down").join(up.withColumnRenamed("label", "up"), "node")), a and b


def trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those of nodes that no edge leads to, or that none leaves, ``TRIMS`` times at most: they are on no cycle."""
    m = edges.count()
    for _ in range(TRIMS):
        live = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        edges = cut(known_edges(live, edges))
        n = edges.count()
        if n == m:
            break
        m = n
    return edges


def unary(edges: DataFrame) -> DataFrame:
    """(node, prev, next): nodes that one edge leads to and one leaves."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("prev"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("next"))
    return into.where("i = 1").join(out.where("o = 1"), "node").select("node", "prev", "next")


def followed(chain: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, head, tail, before, after, low, ring) of unary nodes: the nearest nodes before and behind that aren't unary, the weights up to each, the node's own too, and the least node gone past.

    Both ways are gone at once, and every round doubles how far. ``ring``: there is no end; the least is then that of the ring.
    """
    w = F.col(weight) if weight else F.lit(0).cast("long")
    way = lambda n, to: chain.select("node", F.lit(n).alias("way"), F.col(to).alias("end"), w.alias("total"), F.col("node").alias("low"))
    now = cut(way(0, "prev").union(way(1, "next")))
    for _ in range(max(1, now.count()).bit_length()):
        far = now.select(F.col("node").alias("end"), "way", F.col("end").alias("e2"), F.col("total").alias("t2"), F.col("low").alias("l2"))
        new = cut(now.join(far, ["end", "way"], "left").select("node", "way", F.coalesce("e2", "end").alias("end"), (F.col("total") + F.coalesce("t2", F.lit(0))).alias("total"), F.least("low", "l2").alias("low"), F.col("e2").isNotNull().alias("moved")))
        now = new.select("node", "way", "end", "total", "low")
        if new.where("moved").isEmpty():
            break
    now = now.join(chain.select(F.col("node").alias("end"), F.lit(True).alias("more")), "end", "left")
    one = lambda n, end, total, low: now.where(F.col("way") == n).select("node", F.col("end").alias(end), F.col("total").alias(total), F.col("low").alias(low), F.col("more").alias(f"more{n}"))
    both = one(0, "head", "before", "l0").join(one(1, "tail", "after", "l1"), "node")
    return cut(both.select("node", "head", "tail", "before", "after", F.least("l0", "l1").alias("low"), F.coalesce("more1", F.lit(False)).alias("ring")))


def groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cluster, size): strongly connected groups, named by their least node.

    Nodes on no cycle are trimmed, chains of unary nodes become an edge, and rings that a bounded search finds become
    a node, until no edge is left; no pair of nodes that reach one another is made. Then what became of each node is
    followed back: a chain's node is of the group of its ends, if that is one.
    """
    e, steps, hops = cut(known_edges(nodes, edges)), [], HOPS
    left = e.count()
    while True:
        e = trimmed(e)
        n, left = left, e.count()
        if not left:
            break
        chain = cut(unary(e))
        if not chain.isEmpty():
            ends = followed(chain)
            steps.append(("ring", ends.where("ring and node <> low").select("node", F.col("low").alias("ring"))))
            steps.append(("hung", ends.where("not ring").select("node", F.col("head").alias("h"), F.col("tail").alias("t"))))
            kept = e.join(chain.select(F.col("node").alias("src")), "src", "left_anti").join(chain.select(F.col("node").alias("dst")), "dst", "left_anti")
            e = cut(clean(kept.select("src", "dst").union(ends.where("not ring").select("head", "tail"))))
            continue
        if left < n:
            continue  # trimming goes on
        marked, settled = marks(e, hops)
        found = cut(marked.where("down = up and node <> down").select("node", F.col("down").alias("ring")))
        if found.isEmpty():
            if settled:  # what lies between rings holds them together: edges between different marks are on no cycle
                a, b = marked.toDF("src", "da", "ua"), marked.toDF("dst", "db", "ub")
                e = cut(e.join(a, "src").join(b, "dst").where("da = db and ua = ub").select("src", "dst"))
            else:
                hops *= 2
            continue
        steps.append(("ring", found))
        a, b = found.toDF("src", "ra"), found.toDF("dst", "rb")
        e = cut(clean(e.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ra", "src").alias("src"), F.coalesce("rb", "dst").alias("dst"))))
    held = nodes.select("node", F.col("node").alias("top")).limit(0)
    for kind, step in reversed(steps):
        if kind == "ring":
            new = step.join(held.toDF("ring", "g"), "ring", "left").select("node", F.coalesce("g", "ring").alias("top"))
        else:
            both = step.join(held.toDF("h", "gh"), "h", "left").join(held.toDF("t", "gt"), "t", "left").select("node", F.coalesce("gh", "h").alias("a"), F.coalesce("gt", "t").alias("b"))
            new = both.where("a = b").select("node", F.col("a").alias("top"))
        held = cut(held.union(new))
    top = cut(nodes.select("node").distinct().join(held, "node", "left").select("node", F.coalesce("top", "node").alias("top")))
    named = top.groupBy("top").agg(F.min("node").alias("cluster"), F.count(F.lit(1)).alias("size"))
    return cut(top.join(named, "top").select("node", "cluster", "size"))


def folded(member: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): the edges between the groups of ``member``."""
    a, b = member.select(F.col("node").alias("src"), F.col("cluster").alias("cs")), member.select(F.col("node").alias("dst"), F.col("cluster").alias("cd"))
    return cut(clean(edges.join(a, "src").join(b, "dst").select(F.col("cs").alias("src"), F.col("cd").alias("dst"))))


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``number``, from 0 in the order of ``by``: ranges are counted, then each is numbered by itself."""
    ranged = cut(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], total))
        total += r["count"]
    at = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1 + F.col("base")
    based = rows.sparkSession.createDataFrame(starts, "part int, base bigint")
    return ranged.join(F.broadcast(based), "part").withColumn("number", at).drop("part", "base")


def dependents(member: DataFrame, between: DataFrame) -> DataFrame:
    """(cluster, above): how many nodes depend on each group from outside. ``between`` has the edges of a graph without cycles.

    A chain of unary groups counts as one node, whose own groups then differ by those before them. The others are
    taken level by level, each once: a node's dependents are a set of bits, and it sends them, with its own bits, along
    its edges to the levels below. Only levels are gone through one after the other, and no pair of nodes is made.
    """
    spark = member.sparkSession
    place = chained(between, member.select(F.col("cluster").alias("node"), "size").distinct())
    edges = onto(between, place)
    every = place.select(F.col("p").alias("node")).distinct()
    roots = every.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    level = furthest(edges.withColumn("whole", F.lit(1)), roots)
    depth = level.agg(F.max("level")).first()[0] or 0
    # nodes of one level have numbers near one another, so that sets are few blocks of bits
    own = member.select("node", "cluster").join(place.select(F.col("node").alias("cluster"), "p"), "cluster").join(level.toDF("p", "level"), "p")
    bits = numbered(own.select("level", "p", "node"), "level", "p", "node")
    bits = cut(bits.groupBy("level", "p", F.shiftright("number", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("number").bitwiseAND(F.lit(32767))).alias("bits")))
    to = cut(edges.join(level.toDF("dst", "to_level"), "dst"))
    sent = f"{shared_dir(spark)}/dependents_{uuid.uuid4().hex}"
    kinds = f"p {dict(member.dtypes)['cluster']}, block bigint, bits binary"
    found = None
    for n in range(depth + 1):
        got = spark.createDataFrame([], kinds) if n == 0 else spark.read.schema(kinds).parquet(f"{sent}/*/to_level={n}")
        got = cut(got.groupBy("p", "block").agg(F.bitmap_or_agg("bits").alias("bits")))
        here = got.groupBy("p").agg(F.sum(F.bitmap_count("bits")).alias("above"))
        found = here if found is None else found.union(here)
        whole = got.union(bits.where(F.col("level") == n).select("p", "block", "bits")).groupBy("p", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        if n < depth:
            on = whole.join(to, F.col("p") == F.col("src")).select(F.col("dst").alias("p"), "block", "bits", "to_level")
            on.write.partitionBy("to_level").parquet(f"{sent}/from={n}")
    return place.join(found, "p", "left").select(F.col("node").alias("cluster"), (F.coalesce("above", F.lit(0)) + F.col("before")).alias("above"))


def radii_of(nodes: DataFrame, member: DataFrame, edges: DataFrame) -> DataFrame:
    found = member.join(dependents(member, folded(member, known_edges(nodes, edges))), "cluster")
    return nodes.select("node").join(found.select("node", (F.col("above") + F.col("size") - 1).alias("blast_radius")), "node")


def blast_radii(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, blast_radius): how many other known nodes depend on it, directly or not (edges run from user to used)."""
    return radii_of(nodes, groups(nodes, edges), edges)


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, size, node): strongly connected groups of two nodes or more, named by their least node; self loops are groups of one of their own."""
    member = groups(nodes, edges).where("size > 1")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(nodes, "node", "left_semi")
    return member.select("cluster", "size", "node").union(loops.select("node", F.lit(1).cast("long"), "node"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(service, modules, edges, in_cycles, clusters) of each service, and of all under the name ``all``, in one pass over what they have.

    ``nodes`` has (node, service); an edge is of its source's service. A cluster of several services counts in each.
    """
    own = nodes.select("node", "service")
    none = F.lit(None).cast(dict(nodes.dtypes)["node"])
    lines = own.select("service", F.lit("modules").alias("what"), none.alias("cluster"))
    lines = lines.union(known_edges(nodes, edges).withColumnRenamed("src", "node").join(own, "node").select("service", F.lit("edges"), none))
    lines = lines.union(groups(nodes, edges).where("size > 1").join(own, "node").select("service", F.lit("in cycles"), "cluster"))
    many = lambda what: F.count(F.when(F.col("what") == what, 1)).alias(what.replace(" ", "_"))
    rolled = lines.rollup("service").agg(many("modules"), many("edges"), many("in cycles"), F.count_distinct("cluster").alias("clusters"), F.grouping("service").alias("total"))
    return rolled.select(F.when(F.col("total") == 1, "all").otherwise(F.col("service")).alias("service"), "modules", "edges", "in_cycles", "clusters")


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, blast_radius, in_cycle)."""
    member = groups(nodes, edges)
    out = degrees(nodes, edges).join(radii_of(nodes, member, edges), "node").join(member, "node")
    return out.select("node", "fan_in", "fan_out", "blast_radius", (F.col("size") > 1).alias("in_cycle"))


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, distance) from the nodes of ``start`` along the edges, breadth first."""
    seen = cut(start.select("node", F.lit(0).alias("distance")).distinct())
    front, d = seen, 0
    while True:
        d += 1
        step = edges.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def reverse_dependents(edges: DataFrame, node: DataFrame) -> DataFrame:
    """(node, distance) of all that depend on the given nodes, these left out."""
    back = clean(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return distances(back, node).where("distance > 0")


def impact_edges(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Edges that lead inward, to a node nearer to the given one."""
    back = clean(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    far = cut(distances(back, node))
    a, b = far.toDF("src", "da"), far.toDF("dst", "db")
    return clean(edges).join(a, "src").join(b, "dst").where("da > db").select("src", "dst")


def chained(edges: DataFrame, size: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """(node, p, before, whole): the chain of unary nodes that each node of ``size`` (node, size) is in, or itself, what lies before it there, and the chain's whole size.

    Nodes of ``apart`` are in no chain. ``edges`` have no cycle.
    """
    chain = unary(edges) if apart is None else unary(edges).join(apart, "node", "left_anti")
    chain = cut(chain.join(size, "node"))
    if chain.isEmpty():
        return size.select("node", F.col("node").alias("p"), F.lit(0).cast("long").alias("before"), F.col("size").alias("whole"))
    inner = followed(chain, "size").join(size, "node")
    inner = inner.select("node", F.col("low").alias("p"), (F.col("before") - F.col("size")).alias("before"), (F.col("before") + F.col("after") - F.col("size")).alias("whole"))
    one = size.join(inner.select("node"), "node", "left_anti").select("node", F.col("node").alias("p"), F.lit(0).cast("long").alias("before"), F.col("size").alias("whole"))
    return cut(inner.union(one))


def onto(edges: DataFrame, place: DataFrame) -> DataFrame:
    """(src, dst): the edges between the chains of ``place``."""
    a, b = place.select(F.col("node").alias("src"), F.col("p").alias("ps")), place.select(F.col("node").alias("dst"), F.col("p").alias("pd"))
    return cut(clean(edges.join(a, "src").join(b, "dst").select(F.col("ps").alias("src"), F.col("pd").alias("dst"))))


def longest_levels(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, level): the greatest number of edges on a way from ``start``, in a graph without cycles. A chain of unary nodes is gone along in one round."""
    begin = start.select("node").distinct()
    place = chained(edges, nodes_of(edges).union(begin).distinct().withColumn("size", F.lit(1).cast("long")), begin)
    far = cut(onto(edges, place).join(place.select(F.col("p").alias("src"), "whole").distinct(), "src"))
    known = furthest(far, begin)
    return place.join(known.withColumnRenamed("node", "p"), "p").select("node", (F.col("level") + F.col("before")).cast("int").alias("level"))


def furthest(far: DataFrame, begin: DataFrame) -> DataFrame:
    """(node, level): the greatest sum of ``whole`` over the edges ``far`` (src, dst, whole) of a way from ``begin`` (node)."""
    known = cut(begin.withColumn("level", F.lit(0).cast("long")))
    front = known
    while True:
        step = far.join(front, F.col("src") == F.col("node")).groupBy("dst").agg(F.max(F.col("level") + F.col("whole")).alias("new"))
        front = cut(step.join(known, F.col("dst") == F.col("node"), "left").where("level is null or new > level").select(F.col("dst").alias("node"), F.col("new").alias("level")))
        if front.isEmpty():
            return known
        known = cut(known.union(front).groupBy("node").agg(F.max("level").alias("level")))


def tiers(nodes: DataFrame, edges: DataFrame, user_facing: DataFrame) -> DataFrame:
    """(node, tier): the longest way from a user-facing service; services above known ones lie one further; the rest last.

    Services on a cycle count as one and lie in one tier. Services above are taken in passes in the
    services' order (``seq`` of ``nodes``, else their names), and one sees what was found before it in the same pass:
    it joins in the first pass in which it knows a dependency, and lies one beyond the furthest that it knows then.
    """
    e = cut(known_edges(nodes, edges))
    member = groups(nodes, e)
    first = user_facing.select("node").join(member, "node").select(F.col("cluster").alias("node"))
    below = cut(member.join(longest_levels(folded(member, e), first).toDF("cluster", "level"), "cluster").select("node", "level"))
    order = nodes.select("node", (F.col("seq") if "seq" in nodes.columns else F.col("node")).alias("seq"))
    a, b = order.toDF("src", "sa"), order.toDF("dst", "sb")
    up = cut(e.join(a, "src").join(b, "dst").join(below.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "sa", "sb"))
    # the pass in which each joins: that of the first dependency known, or the next one if it comes later in the order
    found = cut(below.select("node", F.lit(0).alias("pass")))
    front = found
    while True:
        step = up.join(front, F.col("dst") == F.col("node")).groupBy("src").agg(F.min(F.when(F.col("pass") == 0, 1).otherwise(F.col("pass") + (F.col("sb") > F.col("sa")).cast("int"))).alias("new"))
        better = step.join(found, F.col("src") == F.col("node"), "left").where("pass is null or new < pass").select(F.col("src").alias("node"), F.col("new").alias("pass"))
        if (front := cut(better)).isEmpty():
            break
        found = cut(found.unionByName(front).groupBy("node").agg(F.min("pass").alias("pass")))
    x, y = found.toDF("src", "px"), found.toDF("dst", "py")
    seen = cut(up.join(x, "src").join(y, "dst").where(F.struct("py", "sb") < F.struct("px", "sa")).select("src", "dst").union(up.join(x, "src").join(y.where("py = 0"), "dst").select("src", "dst")).distinct())
    known, front = below, below
    while True:
        step = seen.join(front, F.col("dst") == F.col("node")).groupBy("src").agg((F.max("level") + 1).alias("new"))
        more = step.join(known, F.col("src") == F.col("node"), "left").where("level is null or new > level").select(F.col("src").alias("node"), F.col("new").alias("level"))
        if (front := cut(more)).isEmpty():
            break
        known = cut(known.unionByName(front).groupBy("node").agg(F.max("level").alias("level")))
    last = known.agg((F.coalesce(F.max("level"), F.lit(0)) + 1).alias("last"))
    return nodes.join(known, "node", "left").join(F.broadcast(last)).select("node", F.coalesce("level", "last").alias("tier"))


def dependency_levels(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(node, level): the longest way to a node with cycles taken as one node, pressed to ``top`` levels where there are more."""
    e = cut(known_edges(nodes, edges))
    held = cycles(nodes, e).where("size > 1").select("node", "cluster")
    group = cut(nodes.join(held, "node", "left").select("node", F.coalesce("cluster", "node").alias("g")))
    a, b = group.toDF("src", "gs"), group.toDF("dst", "gd")
    inner = cut(e.join(a, "src").join(b, "dst").where("gs <> gd").select(F.col("gs").alias("src"), F.col("gd").alias("dst")).distinct())
    roots = group.select(F.col("g").alias("node")).distinct().join(inner.select(F.col("dst").alias("node")), "node", "left_anti")
    level = longest_levels(inner, roots).toDF("g", "raw")
    found = group.join(level, "g")
    high = found.agg(F.max("raw").alias("high"))
    pressed = F.when(F.col("high") > top, F.bround(F.col("raw") * float(top) / F.col("high")).cast("int")).otherwise(F.col("raw"))
    return found.join(F.broadcast(high)).select("node", pressed.alias("level"))


def propagate(signals: DataFrame, origin: DataFrame, services: DataFrame, service_edges: DataFrame) -> DataFrame:
    """(incident_key, step, from_service, to_service, mechanism, evidence_ids): how failure spread, all incidents at once.

    Failing services are ranked by (ts, service), the origin first. A service joins in the pass that is its
    distance from the origin over dependencies in either direction, where a hop to a later rank costs nothing and
    one to an earlier rank a pass; within a pass the rank decides. The first declared dependency that joined
    before gets the credit, else the first that joined and depends on it.
    """
    o = origin.select("incident_key", F.col("source").alias("o"))
    known = services.select(F.col("service").alias("source"), F.lit(True).alias("declared"))
    rows = signals.join(o, "incident_key").join(known, "source", "left").where("declared or source = o")
    w = Window.partitionBy("incident_key").orderBy(F.col("source") != F.col("o"), "ts", "source")
    ranked = cut(rows.withColumn("rank", F.row_number().over(w) - 1))
    e = service_edges.select("service", "dependency", "ord").distinct()
    pairs = e.select(F.col("service").alias("u"), F.col("dependency").alias("v")).union(e.select(F.col("dependency").alias("u"), F.col("service").alias("v"))).where("u <> v").distinct()
    a = ranked.select("incident_key", F.col("source").alias("u"), F.col("rank").alias("ru"))
    b = ranked.select("incident_key", F.col("source").alias("v"), F.col("rank").alias("rv"))
    hops = cut(a.join(pairs, "u").join(b, ["incident_key", "v"]).select("incident_key", "u", "v", (F.col("rv") < F.col("ru")).cast("int").alias("cost")))
    best = cut(ranked.where("rank = 0").select("incident_key", F.col("source").alias("node"), F.lit(0).alias("pass")))
    front = best
    while True:
        step = hops.join(front, (hops["incident_key"] == front["incident_key"]) & (F.col("u") == F.col("node")))
        step = step.groupBy(hops["incident_key"], F.col("v").alias("node")).agg(F.min(F.greatest(F.col("pass") + F.col("cost"), F.lit(1))).alias("new"))
        better = step.join(best, ["incident_key", "node"], "left").where("pass is null or new < pass").select("incident_key", "node", F.col("new").alias("pass"))
        front = cut(better)
        if front.isEmpty():
            break
        best = cut(best.union(front).groupBy("incident_key", "node").agg(F.min("pass").alias("pass")))
    order = Window.partitionBy("incident_key").orderBy("pass", "rank")
    joined = cut(ranked.join(best.withColumnRenamed("node", "source"), ["incident_key", "source"]).withColumn("place", F.row_number().over(order) - 1))
    early = joined.select("incident_key", F.col("source").alias("from_service"), F.col("place").alias("from_place"))
    down = joined.join(e, F.col("source") == F.col("service")).join(early, "incident_key").where("from_service = dependency").withColumns({"kind": F.lit(0), "nth": F.col("ord")})
    up = joined.join(e, F.col("source") == F.col("dependency")).join(early, "incident_key").where("from_service = service").withColumns({"kind": F.lit(1), "nth": F.col("from_place")})
    choice = down.unionByName(up).where("from_place < place")
    pick = Window.partitionBy("incident_key", "source").orderBy("kind", "nth")
    first = choice.withColumn("n", F.row_number().over(pick)).where("n = 1")
    return first.select("incident_key", F.col("place").alias("step"), "from_service", F.col("source").alias("to_service"), X.mechanism("summary").alias("mechanism"), "evidence_ids")


def affected(propagation: DataFrame, origin: DataFrame) -> DataFrame:
    """(incident_key, place, service): the origin and then each service in the order in which it joined."""
    return origin.select("incident_key", F.lit(0).alias("place"), F.col("source").alias("service")).union(propagation.select("incident_key", "step", "to_service"))
