"""Streams give what batches give; bursts, cooldown and quota by hand."""

from emberline.sources import files
from emberline.streaming import watch


def test_burst_window_and_rest():
    assert watch.burst_fold([100, 110, 120], ([], float("-inf")), 3, 60, 300)[0] == [(120, 3)]
    assert watch.burst_fold([0, 50, 110], ([], float("-inf")), 3, 90, 300)[0] == []
    assert watch.burst_fold([0, 45, 90], ([], float("-inf")), 3, 90, 300)[0] == [(90, 3)]  # the window's edge counts
    assert watch.burst_fold([0, 1, 2, 3, 4, 5, 400, 401, 402], ([], float("-inf")), 3, 90, 300)[0] == [(2, 3), (402, 3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, float(t)) for k in ("a", "b") for t in range(0, 4000, 37 if k == "a" else 200)]
    df = spark.createDataFrame(rows, "key string, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = watch.drain(watch.trips(stream))
    want = watch.trips(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3


def test_quota(spark):
    calls = spark.createDataFrame([(1, float(n), n) for n in range(12)] + [(1, 3601.5, 99)] + [(2, 0.5, 50)], "client long, at double, seq long")
    got = {r["seq"]: r["accepted"] for r in watch.quota(calls, 10, 200).collect()}
    assert [got[n] for n in range(12)] == [True] * 10 + [False] * 2 and got[99] and got[50]
    assert sum(r["accepted"] for r in watch.quota(calls, 10, 3).collect()) == 3


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "broken-cache"
    folder.mkdir()
    (folder / "events.json").write_text('[{"id": "log-1", "source_type": "log", "source": "api", "timestamp": "2024-05-01T10:00:00Z", "detail": "x", "attributes": {"level": "ERROR"}}]')
    (folder / "architecture.json").write_text('{"system": "s", "services": [{"name": "api", "depends_on": ["db"], "user_facing": true, "internals": {"stages": [{"name": "gate", "modules": ["app"]}], "edges": [["gate", "core"]]}}, {"name": "db"}]}')
    row = files.read_scenarios(spark, str(folder / "events.json")).first()
    assert (row["incident_key"], row["level"], row["source"]) == ("broken-cache", "ERROR", "api")
    tables = files.read_architectures(spark, str(folder / "architecture.json"))
    assert tables["service_edges"].first()["dependency"] == "db" and tables["stages"].first()["stage"] == "gate" and tables["services"].count() == 2
    assert files.read_code_graphs(spark, str(folder / "absent.json"))["modules"].count() == 0
    (folder / "a.log").write_bytes(b"ERROR: one\n\nbad \xff byte\n")
    sources = spark.createDataFrame([("api", "%a.log")], "service string, pattern string")
    assert [r["value"] for r in files.read_logs(spark, str(folder / "a.log"), sources).orderBy("line_no").collect()][:3] == ["ERROR: one", "", "bad � byte"]
    (folder / "catalog.jsonl").write_text('{"prefix": "a"}\n\n{broken\n[1]\n')
    assert files.read_catalog(spark, str(folder / "catalog.jsonl")).count() == 1


def test_code_graph_round_trip(spark, tmp_path):
    modules = spark.createDataFrame([("s", 0, "m", "module", None, [], 3, 0, 0, 0, False)], "service string, ord int, name string, kind string, stage string, defs array<string>, loc int, fan_in int, fan_out int, blast_radius int, in_cycle boolean")
    files.write_code_graphs({"modules": modules}, str(tmp_path / "g"))
    assert files.read_code_graphs(spark, str(tmp_path / "g"))["modules"].first()["name"] == "m"
