"""Log files that grow, as a stream source: an offset in bytes for each file, from the start again where a file has shrunk."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "emberline_tail"
SCHEMA = "service string, file string, modified timestamp, start long, part int, value string"
#: Bytes read at once, lines handed on at once, and bytes of a file that one task reads.
CHUNK, ROWS, SPLIT = 1 << 20, 8192, 128 << 20


def place(pattern: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in pattern or pattern.startswith("file:"):
        scheme, rest = pattern.split(":", 1)
        if scheme == "file":
            return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
        host, _, path = rest[2:].partition("/")
        fs, base = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
        return fs, base.rstrip("/") + "/" + path
    return pafs.LocalFileSystem(), os.path.abspath(pattern)


def found(pattern: str) -> list[pafs.FileInfo]:
    """The files of a path or of a pattern with ``*``, ``?`` and ``[``, by path; a star stays within a folder, two of them don't."""
    fs, path = place(pattern)
    special = re.search(r"[*?\[]", path)
    if not special:
        info = fs.get_file_info(path)
        return [info] if info.is_file else []
    base = path[: special.start()].rsplit("/", 1)[0] or "/"
    deep = "/" in path[special.start() :] or "**" in path
    parts = path.split("/")
    infos = fs.get_file_info(pafs.FileSelector(base, recursive=deep, allow_not_found=True))
    return sorted((i for i in infos if i.is_file and matches(i.path.split("/"), parts)), key=lambda i: i.path)


def matches(path: list[str], pattern: list[str]) -> bool:
    if not pattern:
        return not path
    if pattern[0] == "**":
        return matches(path, pattern[1:]) or (bool(path) and matches(path[1:], pattern))
    return bool(path) and fnmatch.fnmatchcase(path[0], pattern[0]) and matches(path[1:], pattern[1:])


def whole_lines(fs: pafs.FileSystem, path: str, size: int) -> int:
    """The bytes of a file up to the end of its last line that has ended."""
    with fs.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - CHUNK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes ``begin`` to ``end`` of a file; nothing from ``stop`` on is read. ``fresh``: a line begins at ``begin``."""

    service: str
    pattern: str
    path: str
    modified: int
    begin: int
    end: int
    stop: int
    fresh: bool


def lines(fs: pafs.FileSystem, r: Range) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each line of a range, by chunks: only a line that isn't ended is held."""
    with fs.open_input_file(r.path) as f:
        at = r.begin if r.fresh else r.begin - 1  # the byte before tells whether a line begins here
        f.seek(at)
        held, skip = b"", not r.fresh
        read = at
        while read < r.stop and (at < r.end or skip):
            got = f.read(min(CHUNK, r.stop - read))
            if not got:
                break
            read += len(got)
            pieces = got.split(b"\n")
            pieces[0] = held + pieces[0]
            held = pieces.pop()
            for piece in pieces:
                if not skip and at < r.end:
                    yield at, piece
                skip = False
                at += len(piece) + 1
        if held and not skip and at < r.end:
            yield at, held


class TailReader(DataSourceStreamReader):
    """Offsets are ``{service: {path: bytes}}``. The listing is the driver's, as with Spark's own file source; the bytes are read by tasks."""

    def __init__(self, options: Mapping[str, str]):
        self.sources = json.loads(options["sources"])
        self.split = int(options.get("splitBytes", SPLIT))
        self.wait = options.get("unfinished", "wait") == "wait"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for service, pattern in self.sources.items():
            fs, _ = place(pattern)
            sizes = {i.path: whole_lines(fs, i.path, i.size) if self.wait else i.size for i in found(pattern)}
            out[service] = {p: n for p, n in sizes.items() if n}
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for service, files in end.items():
            pattern = self.sources.get(service)
            if pattern is None:  # no longer asked for
                continue
            fs, _ = place(pattern)
            for path, size in sorted(files.items()):
                seen = start.get(service, {}).get(path, 0)
                first = seen if seen <= size else 0  # a file that shrank was begun anew
                if first == size:
                    continue
                modified = fs.get_file_info(path).mtime_ns or 0
                for begin in range(first, size, self.split):
                    out.append(Range(service, pattern, path, modified // 1000, begin, min(begin + self.split, size), size, begin == first))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = place(partition.pattern)
        rows, held = [], 0
        for at, raw in lines(fs, partition):
            for n, value in enumerate(raw.decode("utf-8", "replace").splitlines()):
                rows.append((at, n, value))
            held += len(raw)
            if len(rows) >= ROWS or held >= CHUNK:
                yield self.batch(partition, rows)
                rows, held = [], 0
        if rows:
            yield self.batch(partition, rows)

    def batch(self, r: Range, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        at, n, values = zip(*rows)
        size = len(rows)
        columns = {
            "service": pa.array([r.service] * size, pa.string()), "file": pa.array([r.path] * size, pa.string()),
            "modified": pa.array([r.modified] * size, pa.timestamp("us", "UTC")), "start": pa.array(at, pa.int64()), "part": pa.array(n, pa.int32()), "value": pa.array(values, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, sources: Mapping[str, str], split: int = SPLIT, unfinished: str = "wait") -> DataFrame:
    """New lines of growing log files as a stream (service, file, modified, start, part, value).

    ``sources`` gives each service a path or pattern, also a URI that pyarrow knows; tasks must be able to read it.
    ``start`` is the place of a line in its file, ``part`` its place among those that other line ends divide. The offsets
    are in the query's checkpoint, so a restart goes on where it stopped. A file that has shrunk is read from the start,
    one that was cut and has grown beyond its old size by the next look is not noticed. A last line that hasn't ended
    waits for its end; with ``unfinished="read"`` it is given as it is. Large files are read by ranges of ``split`` bytes.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("sources", json.dumps(dict(sources))).option("splitBytes", split).option("unfinished", unfinished).load()
