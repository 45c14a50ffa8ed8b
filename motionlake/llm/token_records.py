"""Token ids in length-delimited binary files, with an offset index for reads in any order.

A file holds records one after the other::

    length   unsigned 64      bytes of the payload
    check    unsigned 32      masked CRC-32 of the length's eight bytes
    payload
    check    unsigned 32      masked CRC-32 of the payload

A payload is a header (document id, signed 64; one byte: 1 if the id is null, plus 2 if ids are
stored in two bytes; number of ids, unsigned 32) and the ids. All numbers are little-endian. A masked
checksum is rotated right by 15 bits and a constant is added, so that checksums of data that
hold checksums stay sound. The index of a file holds, for each record, its offset in the file and
the number of ids before it in the file (both unsigned 64), then both totals. A task that writes much
makes several files, so that a file and its index have a bounded size, but for one larger record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm.common import bounded_batches, filesystem, materialize
from motionlake.llm.tokens import encoder

MASK = 0xA282EAD8
HEAD, FRAME = struct.Struct("<qBI"), struct.Struct("<QI")
#: Bytes fetched at once, and bytes of records, and records, after which a file is closed.
READ_BYTES, FILE_BYTES, FILE_RECORDS = 8 << 20, 64 << 20, 1_000_000
#: Bytes of text that a task encodes and writes, on average.
PART_BYTES = 512 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    """The payload for ids given as little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    short = not len(wide) or int(wide.max()) < 1 << 16
    return HEAD.pack(doc_id or 0, (doc_id is None) + 2 * short, len(wide)) + (wide.astype("<u2").tobytes() if short else ids)


def parse(record: memoryview | bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one whole record; ValueError if it is damaged."""
    length, check = FRAME.unpack_from(record)
    payload = bytes(record[FRAME.size : FRAME.size + length])
    if check != masked(bytes(record[:8])) or len(record) != length + FRAME.size + 4 or struct.unpack_from("<I", record, len(record) - 4)[0] != masked(payload):
        raise ValueError("damaged record")
    doc, flags, n = HEAD.unpack_from(payload)
    return None if flags & 1 else doc, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", n, HEAD.size).astype("<u4")


class RecordFile:
    """A file of records and its index, written as streams; both get their names when complete."""

    def __init__(self, fs, name: str, trial: str):
        self.fs, self.name, self.trial = fs, name, trial
        self.out = {kind: fs.open_output_stream(f"{name}.{kind}{trial}") for kind in ("rec", "idx")}
        self.at = self.ids = self.records = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        record = frame(payload_of(doc_id, ids))
        self.out["rec"].write(record)
        self.out["idx"].write(struct.pack("<QQ", self.at, self.ids))
        self.at += len(record)
        self.ids += len(ids) // 4
        self.records += 1

    def close(self) -> None:
        self.out["idx"].write(struct.pack("<QQ", self.at, self.ids))
        for kind, out in self.out.items():
            out.close()
            self.fs.move(f"{self.name}.{kind}{self.trial}", f"{self.name}.{kind}")


def write_records(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Encode all texts and write them in ascending order of ``doc_id``; one row per file: ``part, file, records, ids, bytes``.

    Documents are range-partitioned by id and a hash of the text, into ``parts``, or one for every ``PART_BYTES`` of text and
    at least the session's number of shuffle partitions, and each task writes its part as a stream of files of about ``FILE_BYTES``. A task
    holds one batch of texts. A file gets its name when complete, and a task that is run again replaces it.
    Null texts are empty; null ids come first; rows of one id, null too, are in the order of the hash and may be dealt
    over several parts, but rows that repeat whole are in one. The folder ``uri`` must be one that all executors see.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        fs, folder = filesystem(uri)
        fs.create_dir(folder, recursive=True)
        part, trial = context.partitionId(), f".{context.taskAttemptId()}"
        done, now = [], None

        def close() -> None:
            now.close()
            done.append((part, len(done), now.records, now.ids, now.at))

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts)):
                if now is None:
                    now = RecordFile(fs, f"{folder}/{file_name(part, len(done))}", trial)
                now.add(doc, ids + end)
                if now.at >= FILE_BYTES or now.records >= FILE_RECORDS:
                    close()
                    now = None
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names=["part", "file", "records", "ids", "bytes"])

    return materialize(bounded_batches(dealt).mapInArrow(run, "part bigint, file bigint, records bigint, ids bigint, bytes bigint"))


def file_name(part: int, file: int) -> str:
    return f"tokens-{part:06d}-{file:06d}"


def read_records(spark: SparkSession, uri: str, manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in all files) and ``ids`` of every record, checksums verified.

    ``ids`` are bytes, four to an id, least first.

    With a ``seed`` each file's records are read in a random order through its index, otherwise
    in the order of the file. The manifest has one small row per file of 64 MB; its running sum is taken
    on the driver. A task holds one file's index and a block of records.
    """
    rows, start = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r["part"], r["file"], start))
        start += r["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)

        def batch_of(held: list) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["doc_id", "start", "ids"])

        for batch in batches:
            for part, file, first in zip(*(c.to_pylist() for c in batch.columns)):
                name = f"{folder}/{file_name(part, file)}"
                with fs.open_input_file(f"{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                order = np.arange(len(index) - 1)
                if seed is not None:
                    order = np.random.default_rng((seed, part, file)).permutation(order)
                with fs.open_input_file(f"{name}.rec") as f:
                    held, size, at = [], 0, 0
                    while at < len(order):
                        a = order[at]
                        stop = at + 1
                        while stop < len(order) and order[stop] == order[stop - 1] + 1 and index[order[stop] + 1, 0] - index[a, 0] <= READ_BYTES:
                            stop += 1
                        f.seek(int(index[a, 0]))
                        block = memoryview(f.read(int(index[order[stop - 1] + 1, 0] - index[a, 0])))
                        for k in order[at:stop]:
                            doc, ids = parse(block[index[k, 0] - index[a, 0] : index[k + 1, 0] - index[a, 0]])
                            held.append((doc, first + int(index[k, 1]), ids.tobytes()))
                            size += len(ids)
                            if size > READ_BYTES // 8:
                                yield batch_of(held)
                                held, size = [], 0
                        at = stop
                    if held:
                        yield batch_of(held)

    files = spark.createDataFrame(rows, "part bigint, file bigint, start bigint").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id bigint, start bigint, ids binary")
