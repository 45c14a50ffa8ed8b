import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motionlake.llm import packing, token_records, tokens
from motionlake.llm.common import filesystem, shared_dir
from motionlake.llm.queries import op5_token_records, op9_best_fit_packing

PATH = tokens.default_tokenizer()


#: The library's own object, which the code under test never touches.
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_special_tokens_are_the_librarys():
    assert ids_of("a <|endoftext|> b") == [64, 220, 50256, 275]
    got = tokens.encoder(PATH).encode(["a <|endoftext|> b", "<|endoftext|>"])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[64, 220, 50256, 275], [50256]]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60))
def test_any_text_has_the_librarys_ids(text):
    (got,) = tokens.encoder(PATH).encode([text])
    assert np.frombuffer(got, "<u4").tolist() == ids_of(text)


def test_cached_ids_are_the_librarys(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    monkeypatch.setattr(tokens, "ROUND_CHARS", 40)
    random.seed(3)
    parts = [" ", "\n", "\t", "a", "Bc", "é", "'s", "1", "!", "日", "\x1c", "\u0085", "x" * 70, "<|endoftext|>", " word", "  "]
    texts = ["", " ", "  ", "a ", " a", "a  b", "a \n b"] + ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(600)]
    got = tokens.Encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_is_gapless_and_near_the_bound(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 64)
    for b in set(bins.tolist()):
        own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= 64
    assert len(set(bins.tolist())) <= 2 * -(-sum(lengths) // 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_packing_follows_the_sum_of_squares(lengths):
    size, gaps, want = 12, [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tried = []
        for k, gap in enumerate(gaps):
            if gap >= lengths[i]:
                after = [g for g in (*gaps[:k], gap - lengths[i], *gaps[k + 1 :]) if g]
                tried.append((sum(after.count(g) ** 2 for g in set(after)), gap, k))
        if tried:
            _, gap, k = min(tried)
        else:
            gap, k = size, len(gaps)
            gaps.append(size)
        want[i] = size - gap
        gaps[k] = gap - lengths[i]
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), size)
    assert offsets.tolist() == want and len(set(bins.tolist())) == len(gaps)


def check_pieces(rows, pieces, size=2048):
    want = []
    for doc, text in rows:
        ids = [*ids_of(text), 0]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        cut = [0, first, *range(first + size, len(ids) + 1, size)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces], key=key) == sorted(want, key=key)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size
    return len(by), sum(p.length for p in pieces)


def test_pack_odd_documents(spark, odd_docs, odd_rows, no_docs):
    check_pieces(odd_rows, packing.pack(odd_docs, PATH, group_rows=20).collect())
    assert packing.pack(no_docs, PATH).count() == 0


def test_query_packs_tightly(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = check_pieces(docs, op9_best_fit_packing(spark, sf).collect())
    assert n <= 1.02 * total / 2048 + 1


def brute_records(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = [*ids_of(text), 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_record_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op5_token_records(spark, sf).collect())
    assert got == brute_records(docs)


@pytest.mark.parametrize("records", [1_000_000, 2])
def test_records_of_odd_documents_in_any_order(spark, odd_docs, odd_rows, no_docs, monkeypatch, records):
    monkeypatch.setattr(token_records, "FILE_RECORDS", records)
    uri = shared_dir(spark)
    manifest = token_records.write_records(odd_docs, uri, PATH, parts=3)
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(odd_rows, key=key)
    want = {(d, s, c) for d, s, _, c in brute_records(rows)}
    for seed in (None, 4):
        got = token_records.read_records(spark, uri, manifest, seed).collect()
        assert {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in got} == want and len(got) == len(rows)
    uri = shared_dir(spark)
    assert token_records.read_records(spark, uri, token_records.write_records(no_docs, uri, PATH, parts=2)).count() == 0


def test_damaged_records_are_found(spark, odd_docs):
    record = bytearray(token_records.frame(token_records.payload_of(-7, np.array([1, 70_000], "<u4").tobytes())))
    doc, ids = token_records.parse(bytes(record))
    assert doc == -7 and ids.tolist() == [1, 70_000]
    for at in range(len(record)):
        bad = bytearray(record)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            token_records.parse(bytes(bad))


def test_file_system_of_plain_uri():
    fs, path = filesystem("file:///tmp")
    assert path == "/tmp"


def test_parts_follow_the_bytes_of_text(spark, no_docs, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(200)], "doc_id long, text string")
    for size, parts in ((1 << 30, range(1, 5)), (1000, range(15, 21))):
        monkeypatch.setattr(token_records, "PART_BYTES", size)
        manifest = token_records.write_records(docs, shared_dir(spark), PATH)
        assert manifest.select("part").distinct().count() in parts
        assert sum(r.records for r in manifest.collect()) == 200
    assert token_records.write_records(no_docs, shared_dir(spark), PATH).count() == 0
