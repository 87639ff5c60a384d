"""Merkle manifest of a table: a leaf for each row, a tree for each group of rows, and a tree over the groups' roots.

Leaves of a group ascend by id. A row's place among them is a rank in a bitmap: the ids of a group are merged into
64-bit words of which only those with a bit are kept, a directory holds how many rows lie before each word (counted
level by level, 4096 children a level, so that no sum runs over a whole group in one task), and the bits below a row's
own in its word are counted. No group is sorted. Places are then keyed by chunks of ``SLOTS``: a chunk's array of slots is
reduced by all its levels in one task, and the chunks' nodes are the slots of the next round.

Ids may repeat. A directory counts rows, and a word lists its bits of more than one row. The rows of one id are ordered
by their leaves, again by counts of a leaf's first digits and then within them; equal rows are one entry with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import materialise

#: Levels that one chunk reduces, and its slots.
LEVELS = 10
SLOTS = 1 << LEVELS
#: The word of null ids, below that of any other; bits by which a directory's levels differ, and its levels above the words.
NULL_WORD, STEP, HEIGHT = -(1 << 57) - 1, 12, 4
#: Chunks whose upper paths are broadcast at most, each of under 8 KB.
BROADCAST_CHUNKS = 1024

SLOT = "array<struct<start:int,length:int,id:bigint,leaf:binary,claimed:binary>>"
STEPS = "array<struct<left:boolean,hash:string>>"


def leaf(*columns: Column) -> Column:
    """The lowercase hex SHA-256 of the values one after the other: ``-`` for null, else the UTF-8 bytes' number, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def folded(start: Column, steps: str = "steps") -> Column:
    """The root that ``start`` and the siblings of ``steps`` give."""
    both = lambda acc, s: F.when(s["left"], F.concat(s["hash"], acc)).otherwise(F.concat(acc, s["hash"]))
    return F.aggregate(steps, start, lambda acc, s: F.sha2(both(acc, s), 256))


def proof(steps: str = "steps") -> Column:
    """The siblings' hex digests, from the leaf's own level to the root's, as one text."""
    return F.array_join(F.transform(steps, lambda s: s["hash"]), "")


def _bit(pos: str) -> Column:
    return F.expr(f"shiftleft(1L, {pos})")


def directory(words: DataFrame) -> DataFrame:
    """(g, word, bits, extra, before, n): the rows of the group before each word, and in all."""
    levels = [words]
    for _ in range(HEIGHT):
        levels.append(levels[-1].groupBy("g", F.shiftright("word", STEP).alias("word")).agg(F.sum("rows").alias("rows")))
    above = None
    for level in reversed(levels):
        top = above is None
        by = ["g"] if top else ["g", "parent"]
        level = level.withColumn("parent", F.shiftright("word", STEP))
        w = Window.partitionBy(*by)
        level = level.withColumn("before", F.coalesce(F.sum("rows").over(w.orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if top:
            level = level.withColumn("n", F.sum("rows").over(w))
        else:
            up = above.select("g", F.col("word").alias("parent"), F.col("before").alias("base"), "n")
            level = level.join(up, by).withColumn("before", F.col("before") + F.col("base")).drop("base")
        above = level.drop("parent")
    return above


def within(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with ``inner``: how many rows of the same id come before, by their leaves."""
    key = ["g", "word", "pos"]
    if repeated.isEmpty():
        return rows.withColumn("inner", F.lit(0).cast("long"))
    many = rows.join(repeated, key, "left_semi").withColumn("p", F.substring("leaf", 1, 2))
    counts = many.groupBy(*key, "p").agg(F.sum("copies").alias("n"))
    before = Window.unboundedPreceding, -1
    counts = counts.select(*key, "p", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("p").rowsBetween(*before)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("copies").over(Window.partitionBy(*key, "p").orderBy("leaf", "claimed").rowsBetween(*before)), F.lit(0))
    many = many.withColumn("own", own).join(counts, [*key, "p"]).withColumn("inner", F.col("base") + F.col("own"))
    single = rows.join(repeated, key, "left_anti").withColumn("inner", F.lit(0).cast("long"))
    return single.unionByName(many.select(*single.columns))


def coordinates(rows: DataFrame) -> DataFrame:
    """(g, n, id, leaf, claimed, copies, at) of ``rows`` (g, id, leaf, claimed, copies): the place of the first copy, from 0."""
    rows = rows.select("*", F.coalesce(F.shiftright("id", 6), F.lit(NULL_WORD)).alias("word"), F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("pos"))
    ids = rows.groupBy("g", "word", "pos").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("leaves"))
    more = F.when(F.col("rows") > 1, F.struct("pos", (F.col("rows") - 1).alias("more")))
    words = ids.groupBy("g", "word").agg(F.bit_or(_bit("pos")).alias("bits"), F.sum("rows").alias("rows"), F.collect_list(more).alias("extra"))
    found = directory(materialise(words, "merkle-words")).drop("rows")
    repeated = materialise(ids.where("leaves > 1").select("g", "word", "pos"), "merkle-repeated")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, pos)"))).cast("long")
    earlier = F.aggregate(F.filter("extra", lambda x: x["pos"] < F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    at = F.col("before") + below + earlier + F.col("inner")
    return within(rows, repeated).join(found, ["g", "word"]).select("g", "n", "id", "leaf", "claimed", "copies", at.alias("at"))


def chunked(rows: DataFrame) -> DataFrame:
    """(g, chunk, n, slots) of ``rows`` (g, n, at, copies, id, leaf, claimed): arrays of up to ``SLOTS`` places, copies of a row as one run."""
    first, last = F.shiftright("at", LEVELS), F.shiftright(F.col("at") + F.col("copies") - 1, LEVELS)
    rows = rows.select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("at"), F.col("chunk") * SLOTS)
    high = F.least(F.col("at") + F.col("copies"), (F.col("chunk") + 1) * SLOTS)
    run = F.struct((low % SLOTS).cast("int").alias("start"), (high - low).cast("int").alias("length"), "id", "leaf", "claimed")
    return rows.groupBy("g", "chunk", "n").agg(F.collect_list(run).alias("slots"))


def reduced(leaves: list[str], n: int, most: int = LEVELS) -> list[list[str]]:
    """The levels of a chunk of a group of ``n`` nodes, the leaves first: ``most`` while the group has more chunks."""
    levels = [leaves]
    for _ in range(min(most, (n - 1).bit_length())):
        here = levels[-1]
        levels.append([hashlib.sha256("".join(here[i : i + 2]).encode()).hexdigest() for i in range(0, len(here), 2)])
    return levels


def _leaves(slots: list[dict]) -> tuple[list[dict], list[str]]:
    order = sorted(slots, key=lambda s: s["start"])
    entries = [s for s in order for _ in range(s["length"])]
    return entries, [h for s in order for h in [s["leaf"].hex()] * s["length"]]


def _nodes(chunks: DataFrame) -> DataFrame:
    """(g, n, at, hash): each chunk's node, and the number of nodes of the group one round up."""
    most = LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, at, n, hashes = [], [], [], []
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                g.append(r["g"])
                at.append(r["chunk"])
                n.append(-(-r["n"] // (1 << most)))
                hashes.append(bytes.fromhex(reduced(_leaves(r["slots"])[1], r["n"], most)[-1][0]))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(hashes, pa.binary())], ["g", "n", "at", "hash"])

    return materialise(chunks.mapInArrow(run, "g string, n bigint, at bigint, hash binary"), "merkle-nodes")


def _paths(chunks: DataFrame) -> DataFrame:
    """(g, at, id, leaf, claimed, steps, subroot, root) of every place of ``chunks``, which hold what is above them as ``above``, ``subroot``, ``root``."""
    most = LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                entries, leaves = _leaves(r["slots"])
                levels = reduced(leaves, r["n"], most)[:-1]
                up_left, up_hash = [s["left"] for s in r["above"]], [s["hash"] for s in r["above"]]
                left, hashes = [], []
                for k in range(len(leaves)):
                    for depth, level in enumerate(levels):
                        own = k >> depth
                        left.append(bool(own & 1))
                        hashes.append(level[own ^ 1] if own ^ 1 < len(level) else "")
                    left += up_left
                    hashes += up_hash
                width, m = len(levels) + len(up_left), len(leaves)
                steps = pa.ListArray.from_arrays(pa.array(range(0, width * m + 1, width) if width else [0] * (m + 1), pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(hashes, pa.string())], ["left", "hash"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["g"]] * m, pa.string()), pa.array(range(r["chunk"] << most, (r["chunk"] << most) + m), pa.int64()), pa.array([e["id"] for e in entries], pa.int64()),
                        pa.array(leaves, pa.string()), pa.array([e["claimed"] and e["claimed"].hex() for e in entries], pa.string()), steps, pa.array([r["subroot"]] * m, pa.string()), pa.array([r["root"]] * m, pa.string()),
                    ],
                    ["g", "at", "id", "leaf", "claimed", "steps", "subroot", "root"],
                )

    return chunks.mapInArrow(run, f"g string, at bigint, id bigint, leaf string, claimed string, steps {STEPS}, subroot string, root string")


def climbed(nodes: DataFrame) -> DataFrame:
    """(g, at, steps, root) of ``nodes`` (g, n, at, hash): for each node the siblings up to its group's root."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    if most == 1:
        return nodes.select("g", "at", F.lit(None).cast(STEPS).alias("steps"), F.lower(F.hex("hash")).alias("root")).withColumn("steps", F.expr(f"coalesce(steps, cast(array() as {STEPS}))"))
    slots = nodes.select("g", "n", "at", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("id"), F.col("hash").alias("leaf"), F.lit(None).cast("binary").alias("claimed"))
    chunks = materialise(chunked(slots), "merkle-round")
    up = climbed(_nodes(chunks)).select("g", F.col("at").alias("chunk"), F.col("steps").alias("above"), F.col("root").alias("subroot"), "root")
    return _paths(chunks.join(up, ["g", "chunk"])).select("g", "at", "steps", "root")


def numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with ``at``, the place of each ``g`` in ascending order: ranges of ``g`` are counted, then each is numbered by itself."""
    spark = groups.sparkSession
    ranged = materialise(groups.repartitionByRange("g").withColumn("part", F.spark_partition_id()), "merkle-groups")
    starts, total = [], 0
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], total))
        total += r["count"]
    at = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1 + F.col("base")
    based = spark.createDataFrame(starts, "part int, base bigint")
    return ranged.join(F.broadcast(based), "part").select("g", "hash", F.lit(total).cast("long").alias("n"), at.alias("at"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, place, leaf, claimed_leaf, steps, subroot, root): a row for each row of ``docs``.

    ``leaf`` is the digest of ``columns`` in their order. Within a group leaves ascend by id, and groups by their name's
    bytes; the null group comes first. While several nodes remain, every two consecutive ones, or a last one alone,
    become their digest. ``steps`` holds the siblings (an empty hash: none) from the leaf up to the root, and whether
    each stands to the left: ``folded(leaf)`` gives the root again. With ``claimed``, columns by name, ``claimed_leaf``
    is the leaf of the row with those values instead; without it is null.

    A null id comes before all others of its group; rows of one id ascend by their leaves, and equal rows have places
    next to each other. Null and empty texts differ. An empty table gives none. Other columns are not read.
    """
    names = [F.col(c) for c in columns]
    group = F.col(group_col).cast("string")
    other = leaf(*((claimed or {}).get(c, F.col(c)) for c in columns)) if claimed else F.lit(None).cast("string")
    rows = docs.select(F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("g"), F.col(id_col).cast("long").alias("id"), leaf(*names).alias("leaf"), other.alias("claimed"))
    rows = rows.select("g", "id", F.unhex("leaf").alias("leaf"), F.unhex(F.nullif("claimed", "leaf")).alias("claimed"))
    rows = materialise(rows.groupBy("g", "id", "leaf", "claimed").agg(F.count(F.lit(1)).alias("copies")), "merkle-rows")
    chunks = materialise(chunked(coordinates(rows)), "merkle-chunks")
    up = materialise(climbed(_nodes(chunks)), "merkle-up")
    groups = materialise(numbered(up.select("g", F.unhex("root").alias("hash")).distinct()), "merkle-numbered")
    top = climbed(groups.select(F.lit("").alias("g"), "n", "at", "hash")).select("at", F.col("steps").alias("top"), F.col("root").alias("total"))
    top = groups.join(top, "at").select("g", "top", "total")
    above = up.join(top, "g").select("g", F.col("at").alias("chunk"), F.concat("steps", "top").alias("above"), F.col("root").alias("subroot"), F.col("total").alias("root"))
    above = materialise(above, "merkle-above")
    found = _paths(chunks.join(F.broadcast(above) if above.count() <= BROADCAST_CHUNKS else above, ["g", "chunk"]))
    real = F.when(F.col("g") != "", F.expr("substring(g, 2)"))
    whole = F.coalesce("claimed", "leaf") if claimed else F.col("claimed")
    return found.select(F.col("id").alias(id_col), real.alias(group_col), F.col("at").alias("place"), "leaf", whole.alias("claimed_leaf"), "steps", "subroot", "root")
