"""Attributes of any type, log files by splits, the tail of files that grow."""

import json

from pyspark.sql import functions as F

from emberline.functions import attributes as A
from emberline.functions import lines as L
from emberline.functions import text as X
from emberline.sources import files, tail
from emberline.streaming import watch


def test_attributes_keep_their_types(spark):
    texts = ['{"value": 3, "metric": "m"}', '{"value": 3.5, "metric": 5}', '{"value": 1e3}', '{"value": true}', '{"value": "7"}', '{"value": null}', '{"value": [1]}', "[1]", "{}", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").withColumn("a", F.try_parse_json("t"))
    got = rows.orderBy("n").select(A.number("a", "value").alias("v"), A.text("a", "metric").alias("m"), A.values("a").alias("all")).collect()
    assert [r["v"] for r in got] == [3.0, 3.5, 1000.0, 1.0, None, None, None, None, None, None]
    assert [r["m"] for r in got[:3]] == ["m", None, None]
    assert [r["all"] for r in got[-5:]] == ["none", "[1]", "", "", ""]


def test_policy_words_in_attributes_alone(spark):
    texts = ['{"reason": "MODEL_BLOCKED"}', '{"model_blocked": "no"}', '{"a": {"b": ["model y not allowed for virtual key"]}}', '{"x": "not allowed for virtual key"}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.lit("model error").alias("detail"), F.try_parse_json("t").alias("a"))
    got = [r["p"] for r in rows.orderBy("n").select(X.is_policy_rejection(A.searched("detail", "a")).alias("p")).collect()]
    assert got == [True, False, True, True, False]


def test_scenario_values_and_places(spark, tmp_path):
    for name in ("one", "two"):
        events = [{"id": f"{name}-{n}", "source_type": "metric", "source": "api", "timestamp": "2024-05-01T10:00:00Z", "detail": "x", "attributes": {"value": v}} for n, v in enumerate([4, "4", True, None])]
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.json").write_text(json.dumps(events))
    got = files.read_scenarios(spark, str(tmp_path / "*" / "events.json")).orderBy("incident_key", "seq").collect()
    assert [(r["incident_key"], r["seq"], r["id"], r["value"]) for r in got[4:]] == [("two", 0, "two-0", 4.0), ("two", 1, "two-1", None), ("two", 2, "two-2", 1.0), ("two", 3, "two-3", None)]


def test_splits_give_what_whole_files_give(spark, tmp_path):
    one = b"\n".join(b"line %d of a" % n for n in range(300)) + b"\n\n\nbad \xff\r\nx\x0by\rz\x0c\n" + b"long " * 500 + b"\nend"
    (tmp_path / "a.log").write_bytes(one)
    (tmp_path / "b.log").write_bytes(b"\n\nonly\n")
    (tmp_path / "c.log").write_bytes(b"")
    sources = spark.createDataFrame([("api", "%/a.log"), ("all", "%.log")], "service string, pattern string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    try:
        df = files.read_logs(spark, str(tmp_path), sources)
        assert df.select("file").rdd.getNumPartitions() > 1
        got = sorted((r["service"], r["file"][-5:], r["line_no"], r["value"]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.make_valid_utf8("value"), L.BREAKS)).alias("n", "value")).collect()
    # a file's end is no line here
    last = {r["file"]: max(x["n"] for x in whole if x["file"] == r["file"]) for r in whole}
    want = [(r["file"][-5:], r["n"], r["value"]) for r in whole if r["n"] < last[r["file"]] or r["value"]]
    assert got == sorted([("all", *w) for w in want] + [("api", *w) for w in want if w[0] == "a.log"])


def run(spark, stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return [r["value"] for r in spark.read.parquet(out).orderBy("file", "modified", "start", "part").collect()]


def test_tail_appends_truncates_and_restarts(spark, tmp_path):
    log, out, state = tmp_path / "api.log", str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: tail.tail(spark, {"api": str(tmp_path / "*.log")}, split=16)  # noqa: E731  (a new source each time, as after a restart)
    log.write_bytes("one\ntwo\nthree, a longer line than a part\nfour\x0bfive\nhal".encode())
    first = ["one", "two", "three, a longer line than a part", "four", "five"]
    assert run(spark, stream(), out, state) == first
    with log.open("ab") as f:
        f.write(b"f\nsix \xff\n")
    assert sorted(run(spark, stream(), out, state)) == sorted([*first, "half", "six �"])
    assert len(run(spark, stream(), out, state)) == 7  # nothing new
    log.write_bytes(b"anew\n")
    (tmp_path / "late.log").write_bytes(b"other\n")
    assert sorted(run(spark, stream(), out, state)) == sorted([*first, "half", "six �", "anew", "other"])


def test_ranges_hold_each_line_once(tmp_path):
    raw = b"".join(b"x" * n + b"\n" for n in (0, 3, 40, 1, 0, 0, 17, 5)) + b"tail"
    path = tmp_path / "f"
    path.write_bytes(raw)
    for split in (1, 2, 3, 7, 16, 100):
        reader = tail.TailReader({"sources": json.dumps({"s": str(path)}), "splitBytes": str(split), "unfinished": "read"})
        parts = reader.partitions({}, reader.latestOffset())
        got = [(at, line) for p in parts for at, line in tail.lines(tail.place(str(path))[0], p)]
        assert [line for _, line in got] == raw.split(b"\n") and [at for at, _ in got] == sorted(at for at, _ in got)
        assert all(raw[at : at + len(line)] == line for at, line in got)


def test_patterns(tmp_path):
    for name in ("a/x.log", "a/b/y.log", "c/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("l\n")
    found = lambda p: [i.path[len(str(tmp_path)) + 1 :] for i in tail.found(f"{tmp_path}/{p}")]
    assert found("*/*.log") == ["a/x.log"] and found("**/*.log") == ["a/b/y.log", "a/x.log"] and found("c/z.txt") == ["c/z.txt"] and found("none/*") == []


def test_tail_stream_drains(spark, tmp_path):
    (tmp_path / "a.log").write_text("ERROR: x\n\nINFO: y\n")
    lines = tail.tail(spark, {"api": f"file://{tmp_path}/a.log"})
    got = watch.drain(L.parsed(lines, "value").where("p is not null").select("service", "p.level"))
    assert sorted(map(tuple, got.collect())) == [("api", "ERROR"), ("api", "INFO")]
