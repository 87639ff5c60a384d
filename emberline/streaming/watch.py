"""Live watch: bursts of errors, cooldown, quota. The same folds run over streams and batches; ``live`` has all of it as one operator."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions import lines as L
from emberline.operators import graph

TRIPS = "key string, at double, errors int"


def read_log_stream(spark: SparkSession, path: str, service: str) -> DataFrame:
    """New log files under ``path`` as parsed lines (service, ts, level, message, logger); the unit is a whole rolled file.

    Which files were read is kept in the query's checkpoint. A line without a time has a null one: an order over
    all lines of a service, which filling in needs, is no streaming operation.
    """
    raw = spark.readStream.text(path)
    return L.parsed(raw, "value").where("p is not null").select(F.lit(service).alias("service"), "p.*")


def burst_fold(times: list[float], state: tuple[list[float], float], count: int, window: float, cooldown: float, real: list[bool] | None = None) -> tuple[list[tuple[float, int]], tuple[list[float], float]]:
    """Trips among ascending error times: ``count`` within ``window`` seconds (both ends in), then rest for ``cooldown`` and start anew.

    ``real`` tells of each time whether an analysis then finds an incident; where it finds none there is no trip, no
    rest, and the errors held still count.
    """
    held, until = deque(state[0]), state[1]
    out = []
    for n, t in enumerate(times):
        held.append(t)
        while held and t - held[0] > window:
            held.popleft()
        if len(held) >= count and t >= until and (real is None or real[n]):
            out.append((t, len(held)))
            held.clear()
            until = t + cooldown
    return out, (list(held), until)


def trips(errors: DataFrame, count: int = 3, window: float = 90, cooldown: float = 300) -> DataFrame:
    """(key, at, errors) of a batch or stream of errors (key, at: seconds).

    On a stream each key's state is its errors of the last window and the end of its rest. Times are those of the
    rows; rows of one micro-batch are taken in order, later batches are not reordered against earlier ones. A batch may
    also have the column ``real``: whether an incident is found at that time; without one there is no rest.
    """

    def frame(key: str, found: list[tuple[float, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key] * len(found), dtype=object), "at": pd.Series([t for t, _ in found], dtype=float), "errors": pd.Series([n for _, n in found], dtype="int32")})

    if not errors.isStreaming:
        # sorted parts of one key come in batches, so that no key is held whole
        told = F.coalesce("real", F.lit(False)) if "real" in errors.columns else F.lit(True)
        dealt = errors.select("key", "at", told.alias("real")).repartition("key").sortWithinPartitions("key", "at")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, state = None, ([], float("-inf"))
            for batch in batches:
                for key, part in batch.groupby("key", sort=False):
                    if key != last:
                        last, state = key, ([], float("-inf"))
                    found, state = burst_fold(part["at"].tolist(), state, count, window, cooldown, part["real"].tolist())
                    yield frame(key, found)

        return dealt.mapInPandas(run, TRIPS)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, until = state.get if state.exists else ([], float("-inf"))
        times = sorted(t for part in rows for t in part["at"].tolist())
        found, (held, until) = burst_fold(times, (list(held), until), count, window, cooldown)
        state.update((held, until))
        yield frame(key[0], found)

    return errors.groupBy("key").applyInPandasWithState(step, TRIPS, "held array<double>, until double", "append", GroupStateTimeout.NoTimeout)


def newest(buffer: DataFrame | None, fresh: DataFrame, most: int = 1200, key: str = "source") -> DataFrame:
    """The newest rows of each key after a batch came in, by event time; late rows count while they fit."""
    rows = fresh if buffer is None else buffer.unionByName(fresh)
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return rows.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).drop("n_")


def settled(events: DataFrame, tripped: DataFrame, settle: float = 5, most: int = 1200, block: float = 3600) -> DataFrame:
    """(key, at, events' columns): for each trip the newest ``most`` events of its key once the burst has settled, ``settle`` seconds after the trip.

    ``events`` has key, ts (a time), seq and others; ``tripped`` has key and at (seconds). Events are numbered in
    blocks of ``block`` seconds, so that no key's events meet in one task, and a trip meets the blocks of numbers that it needs.
    """
    at = lambda ts: F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = events.select("key", at("ts").alias("t"), "seq", F.lit(0).alias("trip"), F.struct(*(c for c in events.columns if c != "key")).alias("row"), F.lit(None).cast("double").alias("at"))
    asked = tripped.select("key", (F.col("at") + settle).alias("t"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("trip"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "at").distinct()
    every = rows.unionByName(asked).withColumn("b", F.floor(F.col("t") / block))
    sums = every.groupBy("key", "b").agg(F.sum(1 - F.col("trip")).alias("n"))
    w = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    here = Window.partitionBy("key", "b").orderBy("t", "trip", "seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = every.join(sums, ["key", "b"]).withColumn("n", F.col("before") + F.sum(1 - F.col("trip")).over(here))
    own = placed.where("trip = 0").select("key", F.floor((F.col("n") - 1) / most).alias("part"), "n", "row")
    last = F.floor((F.col("n") - 1) / most)
    want = placed.where("trip = 1 and n > 0").select("key", "at", F.col("n").alias("upto"), F.explode(F.array(last, last - 1)).alias("part"))
    return own.join(want, ["key", "part"]).where((F.col("n") <= F.col("upto")) & (F.col("n") > F.col("upto") - most)).select("key", "at", "row.*")


def quota(calls: DataFrame, per_hour: int = 10, per_day: int = 200) -> DataFrame:
    """Calls (client, at: seconds, seq) with ``accepted``: at most so many of a client within a sliding hour, and so many of all in a day.

    A refused call does not count, whichever cap refuses it. Days are folded apart, each in the order of its calls,
    with what the day before had accepted in its last hour; the fold is repeated until that no longer changes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        today, spent, hits = None, 0, {}
        for batch in batches:
            passed = []
            for day, client, at, carried in zip(batch["day"], batch["client"], batch["at"], batch["carried"]):
                if day != today:
                    today, spent, hits = day, 0, {}
                own = hits.setdefault(client, deque())
                while own and at - own[0] > 3600:
                    own.popleft()
                passed.append(bool(carried) or (len(own) < per_hour and spent < per_day))
                if passed[-1]:
                    own.append(at)
                    spent += not carried
            yield batch.assign(accepted=passed)

    mine = calls.select(F.floor(F.col("at") / 86400).alias("day"), "client", "at", "seq", F.lit(False).alias("carried"))
    carried = None
    while True:
        rows = mine if carried is None else mine.unionByName(carried)
        dealt = rows.repartition("day").sortWithinPartitions("day", "at", F.desc("carried"), "seq")
        found = graph.cut(dealt.mapInPandas(run, "day long, client long, at double, seq long, carried boolean, accepted boolean"))
        late = found.where("accepted and not carried").where(F.col("at") >= (F.col("day") + 1) * 86400 - 3600)
        new = graph.cut(late.select((F.col("day") + 1).alias("day"), "client", "at", "seq", F.lit(True).alias("carried")))
        held = new.limit(0) if carried is None else carried
        if new.exceptAll(held).isEmpty() and held.exceptAll(new).isEmpty():
            return found.where("not carried").select("client", "at", "seq", "accepted")
        carried = new


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a stream gives of what there is now, written to the shared folder and read back."""
    spark = stream.sparkSession
    place = f"{graph.shared_dir(spark)}/drained_{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
