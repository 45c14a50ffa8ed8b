"""Web archives packaged in ZIP files: writing, and range-reading records without extraction.

A package holds three stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip
members of their own, ``indexes/index.cdxj``, a line per record with its place in that member, and
``datapackage.json``. Whatever was written, the reader relies only on the ZIP directories
(central or ZIP64), the local headers and the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import bounded_batches, filesystem, materialize

#: Bytes of payload after which a package is closed, and bytes fetched at once.
PACKAGE_BYTES, READ_BYTES = 16 << 20, 4 << 20
#: Bytes of payload, and records, after which the reader gives out a batch.
BATCH_BYTES, BATCH_RECORDS = 4 << 20, 2000
ARCHIVE, INDEX, META = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2024-01-01T00:00:00Z"
END, END64, LOCATOR64, ENTRY, LOCAL = (struct.Struct(f) for f in ("<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL", "<4s4B4HL2L5H2L", "<4s2B4HL2L2H"))


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(0 if page_id is None else 1 << 64) | (page_id or 0) & (1 << 64) - 1)}>"


def page_of(record: str) -> int | None:
    """The page of a record's id."""
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & (1 << 64) - 1
    return None if not n >> 64 else low - (1 << 64) if low >> 63 else low


def warc_record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit of the response of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Type, ids, URL and full payload facts of one record; ValueError if it is damaged."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not lines[0].startswith("WARC/") or len(block) != int(fields["content-length"]) or not mark:
        raise ValueError("damaged record")
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["warc-type"] == "response" and (digest(payload) != sha1 or len(payload) != size):
        raise ValueError("payload does not match its digest")
    refers = fields.get("warc-refers-to")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
        "payload_bytes": size, "payload_digest": sha1, "refers_to": page_of(refers) if refers else None,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def package(records: list[tuple[str, bytes]], zip64: bool) -> bytes:
    """A ZIP of ``(url, record)``; with ``zip64`` its sizes and directory are written in ZIP64 form."""
    data, lines = io.BytesIO(), []
    for url, record in records:
        member = gzip.compress(record, 3, mtime=0)
        lines.append(json.dumps({"url": url, "offset": data.tell(), "length": len(member)}))
        data.write(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((ARCHIVE, data.getvalue()), (INDEX, "\n".join(lines).encode()), (META, json.dumps({"profile": "data-package", "records": len(lines)}).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(body)
    raw = out.getvalue()
    if not zip64:
        return raw
    _, _, _, n, _, size, start, _ = END.unpack(raw[-END.size :])
    at = len(raw) - END.size
    return raw[:at] + END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + LOCATOR64.pack(b"PK\x06\x07", 0, at, 1) + END.pack(b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset, length) of the stored members of an open ZIP, by its directories alone."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - END.size - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    found = tail.rfind(b"PK\x05\x06")
    # A comment may hold the mark: the record's comment must reach the end of the file.
    while found >= 0 and (found + END.size > len(tail) or found + END.size + END.unpack_from(tail, found)[-1] != len(tail)):
        found = tail.rfind(b"PK\x05\x06", 0, found)
    if found < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = END.unpack_from(tail, found)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = tail_at + found - LOCATOR64.size
        mark, _, at, _ = LOCATOR64.unpack(read(locator, LOCATOR64.size))
        record = END64.unpack(read(at, END64.size))
        if mark != b"PK\x06\x07" or record[0] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 directory")
        count, length, start = record[7:]
    directory, at, out = read(start, length), 0, {}
    for _ in range(count):
        e = ENTRY.unpack_from(directory, at)
        method, packed, plain, n_name, n_extra, n_comment, offset = e[6], e[10], e[11], e[12], e[13], e[14], e[18]
        name = directory[at + ENTRY.size : at + ENTRY.size + n_name].decode()
        extra, k = directory[at + ENTRY.size + n_name : at + ENTRY.size + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, k)
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        if method == 0:
            local = LOCAL.unpack(read(offset, LOCAL.size))
            if local[0] != b"PK\x03\x04":
                raise ValueError(f"no local header for {name}")
            out[name] = (offset + LOCAL.size + local[-2] + local[-1], packed)
        at += ENTRY.size + n_name + n_extra + n_comment
    return out


def records(f, size: int) -> Iterator[dict]:
    """The records that a package's index lists, fetched by ranges of its archive member."""
    stored = members(f, size)
    base, _ = stored[ARCHIVE]
    at, n = stored[INDEX]
    f.seek(at)
    lines = [json.loads(x) for x in f.read(n).decode().splitlines()]
    k = 0
    while k < len(lines):
        stop, first = k + 1, lines[k]["offset"]
        while stop < len(lines) and lines[stop]["offset"] == lines[stop - 1]["offset"] + lines[stop - 1]["length"] and lines[stop]["offset"] + lines[stop]["length"] - first <= READ_BYTES:
            stop += 1
        f.seek(base + first)
        block = f.read(lines[stop - 1]["offset"] + lines[stop - 1]["length"] - first)
        for line in lines[k:stop]:
            yield parse_record(gzip.decompress(block[line["offset"] - first : line["offset"] - first + line["length"]]))
        k = stop


def write_packages(pages: DataFrame, uri: str, revisit_from: int = 0, zip64: bool = True) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` below ``uri``; ``(path, size, records)`` of each package.

    Of pages with equal payloads of at least ``revisit_from`` bytes that with the largest id is
    written whole and the others as revisits of it. Payloads are compared by their digests:
    one pre-aggregated maximum for each digest, joined back, so copies are never
    gathered. Null html is empty and a null url is the empty string. A null id is the smallest;
    where all ids of a payload are null, and for repeated rows of the largest id, each is a response.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "utf-8"))
    size = F.octet_length("html")
    last = rows.select("page_id", sha.alias("sha"), size.alias("n")).filter(F.col("n") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"))
    last = last.filter("copies > 1").drop("copies")
    refers = F.when((size >= revisit_from) & (~F.col("page_id").eqNullSafe(F.col("last"))), F.col("last"))
    ready = rows.withColumn("sha", sha).join(last, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        fs.create_dir(folder, recursive=True)
        held: list[tuple[str, bytes]] = []
        total = 0

        def close() -> pa.RecordBatch:
            path, body = f"{folder}/{uuid.uuid4().hex}.zip", package(held, zip64)
            with fs.open_output_stream(path) as out:
                out.write(body)
            row = pa.RecordBatch.from_pydict({"path": [path], "size": [len(body)], "records": [len(held)]})
            held.clear()
            return row

        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                held.append((url, warc_record(page, url, payload, digest(payload), refers_to)))
                total += len(payload) if refers_to is None else 0
                if total >= PACKAGE_BYTES or len(held) >= 20_000:
                    yield close()
                    total = 0
        if held:
            yield close()

    return materialize(bounded_batches(ready).mapInArrow(run, "path string, size bigint, records bigint"))


def read_packages(packages: DataFrame, uri: str) -> DataFrame:
    """Every record of ``packages(path, size)``, whose paths are those of ``uri``'s file system.

    Packages are dealt over as many partitions, a number that adaptive execution keeps, and a
    task holds a few MB of payload at once, or one larger payload.
    """
    kinds = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(uri)
        rows: list[dict] = []
        total = 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])
            rows.clear()
            return batch

        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    for record in records(f, size):
                        more = len(record["payload"] or b"")
                        if rows and (total + more > BATCH_BYTES or len(rows) >= BATCH_RECORDS):
                            yield out()
                            total = 0
                        rows.append(record)
                        total += more
        if rows:
            yield out()
        pa.default_memory_pool().release_unused()

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    dealt = packages.select("path", "size").repartition(max(1, packages.count()), "path")
    return bounded_batches(dealt).mapInArrow(run, schema)
