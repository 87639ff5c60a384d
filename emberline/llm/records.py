"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a run of frames, each

    length of the payload, u64 | masked crc of those 8 bytes, u32 | payload | masked crc of the payload, u32

with a payload of the document's id (i64) and its token ids (u16 where the vocabulary allows it, else u32).
All numbers are little-endian; a masked checksum is the crc32 rotated right by 15 bits plus 0xA282EAD8. The
index beside it has a row of (document id i64, frame offset u64, tokens u64) for each frame. A task writes its
own pair of files under a name that no other attempt has; only files named in the manifest, which Spark commits
when all tasks have ended, belong to the table, so lost executors and second attempts leave nothing behind
that a reader would see.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm import tokens

#: Fixed values of the format.
MASK_DELTA = 0xA282EAD8
HEAD, FOOT, KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<q")
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("tokens", "<u8")])
#: The id that stands for null in a frame.
NULL_ID = -(1 << 63)
MANIFEST = "file string, number long, records long, tokens long, width long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int, ids: np.ndarray, width: int) -> bytes:
    payload = KEY.pack(key) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return HEAD.pack(len(payload), masked(size)) + payload + FOOT.pack(masked(payload))


def read_frame(file, width: int) -> tuple[int, np.ndarray] | None:
    """The frame at the file's place; None at its end. Damaged frames raise ValueError."""
    head = file.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("a frame is cut off")
    n, crc = HEAD.unpack(head)
    if crc != masked(head[:8]):
        raise ValueError("a frame's length is damaged")
    body = file.read(n + FOOT.size)
    if len(body) < n + FOOT.size or FOOT.unpack(body[n:])[0] != masked(body[:n]):
        raise ValueError("a frame's payload is damaged")
    return KEY.unpack_from(body)[0], np.frombuffer(body, f"<u{width}", offset=KEY.size, count=(n - KEY.size) // width).astype("<u4")


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order under ``path`` (a URI that all executors reach) and return the manifest.

    The manifest has a row (file, number, records, tokens, width) for each data file, numbered in the order of ids. A
    document's ids are its text's (null text: none) and then ``end_id``. Null ids come first. Repeated rows are
    written each for themselves. An empty table gives an empty manifest. A token takes ``width`` bytes: 2 or 4, by
    the vocabulary where none is given; readers find it in the manifest.
    """
    spark = docs.sparkSession
    largest = max(end_id, *tokens.load(tokenizer).get_vocab(with_added_tokens=True).values())
    width = width or (2 if largest < 1 << 16 else 4)
    if width not in (2, 4) or largest >= 1 << 8 * width:
        raise ValueError(f"ids up to {largest} don't fit in {width} bytes")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    # without a count given, the session's number of shuffle partitions
    ranged = (rows.repartitionByRange(partitions, "i") if partitions else rows.repartitionByRange("i")).sortWithinPartitions("i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = tokens.shared(tokens.ByteBpe, tokenizer)
        fs, root = pafs.FileSystem.from_uri(path)
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        data, total, n = None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if data is None:
                    fs.create_dir(root, recursive=True)
                    data, index = (fs.open_output_stream(f"{root}/{name}.{kind}", buffer_size=1 << 20) for kind in ("rec", "idx"))
                    place = 0
                entries = []
                for key, ids in zip(part.column(0).to_pylist(), bpe.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id))
                    key = NULL_ID if key is None else key
                    record = frame(key, ids, width)
                    data.write(record)
                    entries.append((key, place, len(ids)))
                    place += len(record)
                    total += len(ids)
                index.write(np.array(entries, INDEX).tobytes())
                n += len(entries)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "number": [number], "records": [n], "tokens": [total], "width": [width]})

    ranged.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each record of the table at ``path``, a file a task.

    ``start`` counts the ids of all records before this one in the order written; ``ids_crc32`` is that of the
    ids as little-endian 32-bit numbers. Every frame's checksums are checked.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # one row for each file: its first id's place in the whole
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "number", "width", before.alias("before"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for f in batch.to_pylist():
                start, out = f["before"], []
                with fs.open_input_stream(f"{root}/{f['file']}.rec", buffer_size=1 << 20) as data:
                    while (found := read_frame(data, f["width"])) is not None:
                        key, ids = found
                        out.append((None if key == NULL_ID else key, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(out) == 512:
                            yield table(out)
                            out = []
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "start", "n", "crc"])

    found = files.repartitionByRange(n, "number").mapInArrow(run, "i long, start long, n long, crc long")
    return found.select(F.col("i").alias(id_col), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_index(path: str, file: str) -> np.ndarray:
    """The offset index of one data file, for reads in any order."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/{file}.idx") as f:
        return np.frombuffer(f.read(), INDEX)


def read_at(path: str, file: str, offset: int, width: int = 2) -> tuple[int, np.ndarray]:
    """One record by its offset from the index."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}/{file}.rec") as f:
        f.seek(offset)
        found = read_frame(f, width)
    if found is None:
        raise ValueError("no frame starts there")
    return found
