import base64
import hashlib
import io
import zipfile

import pytest

from motionlake.llm import warc_zip as W
from motionlake.llm.common import shared_dir
from motionlake.llm.queries import op6_warc_zip


def brute(rows):
    last = {}
    for i, h in rows:
        d = hashlib.sha1((h or "").encode()).hexdigest()
        if i is not None and (last.get(d) is None or i > last[d]):
            last[d] = i
        last.setdefault(d, None)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        top = last[hashlib.sha1(b).hexdigest()]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return out


def key(r):
    return str(r)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op6_warc_zip(spark, sf).collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("zip64", [True, False])
def test_odd_pages(spark, zip64, monkeypatch):
    monkeypatch.setattr(W, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(W, "READ_BYTES", 500)
    rows = [(1, None, None), (2, "http://a", ""), (3, "u\r\nX: y", "é\r\n\r\nbody"), (4, "d", "same"), (9, "d", "same"), (9, "d", "same"), (None, "n", "same"), (5, "l", "z" * 20_000), (-3, "neg", "only")]
    pages = spark.createDataFrame([(*r, 0, "t") for r in rows], "page_id long, url string, html string, payload_bytes int, record_type string").repartition(2)
    uri = shared_dir(spark)
    read = W.read_packages(W.write_packages(pages, uri, zip64=zip64), uri)
    got = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([(i, h) for i, _, h in rows]), key=key)
    assert read.filter("page_id = 3").first().payload == "é\r\n\r\nbody".encode()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_packages(W.write_packages(empty, uri), uri).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    uri = shared_dir(spark)
    assert {r.record_type for r in W.read_packages(W.write_packages(pages, uri, revisit_from=3), uri).collect()} == {"response"}


def test_directories():
    record = W.warc_record(1, "u", b"x", W.digest(b"x"), None)
    for zip64 in (True, False):
        raw = W.package([("u", record)] * 3, zip64)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert {i.filename: i.compress_type for i in z.infolist()} == dict.fromkeys((W.ARCHIVE, W.INDEX, W.META), 0)
        assert len(list(W.records(io.BytesIO(raw), len(raw)))) == 3
        commented = io.BytesIO(raw)
        if not zip64:
            with zipfile.ZipFile(commented, "a") as z:
                z.comment = b"PK and more" * 50 + b"PK\x05\x06" + bytes(40)
            assert len(list(W.records(commented, len(commented.getvalue())))) == 3
    with pytest.raises(ValueError):
        W.members(io.BytesIO(b"no zip"), 6)
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"\r\n\r\nx", b"\r\n\r\ny"))


def test_packages_are_read_in_several_tasks_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(W, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(W, "BATCH_BYTES", 2500, raising=False)
    pages = spark.createDataFrame([(k, "u", f"{k:04d}" * 250) for k in range(60)], "page_id long, url string, html string").repartition(2)
    uri = shared_dir(spark)
    packages = W.write_packages(pages, uri)
    assert packages.count() == 20
    read = W.read_packages(packages, uri)
    assert read.select(W.F.spark_partition_id().alias("p")).distinct().count() > 5

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [sum(b.column(0).to_pylist())]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert read.count() == 60 and sorted(r.page_id for r in read.select("page_id").collect()) == list(range(60))
    assert sum(r.n for r in read.select("payload_bytes").mapInArrow(sizes, "n long").collect()) == 60_000
