"""Near-duplicate documents by SimHash, with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import map_batches, materialize, texts_of
from motionlake.llm.components import connected_components

BITS = 64
#: Rows of a bucket that one unit of comparison may hold from either side.
CHUNK_ROWS = 2048
#: Rows of unrelated fingerprints that a key may have before keys get wider.
KEY_ROWS = 64
#: The units of a row in chunk m of c: the pairs of chunks, in order, of which that is one.
PAIRS_OF_CHUNKS = "transform(sequence(0, c - 1), j -> struct(least(j, m) as i, greatest(j, m) as j))"
#: Rows whose distances are updated together.
BLOCK_ROWS = 256


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text: bits set in over half of its shingles' XXH64."""
    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 1:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return fingerprint(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n))


def fingerprint(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without its text, with ``_fp`` (the fingerprint as a signed long)."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in rest]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([simhash(t, width, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fp)], names=[*names, "_fp"])

        return step

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "_fp bigint"])
    return map_batches(docs.select(*names, "text"), make, schema)


def within(fp: np.ndarray, queries: slice, radius: int) -> np.ndarray:
    """Which of ``fp`` differ from each of its ``queries`` in at most ``radius`` bits (boolean matrix).

    A fingerprint is a word of 64 bits or a row of words. The candidates' bits stand in vertical planes, 64 candidates to a word. A query's bit turns
    a plane into the candidates that differ there, and a carry-save counter of a few planes adds
    it to all distances at once; a saturated counter is kept as "exceeded". When everything
    but the queries' own rows has exceeded the radius, the block is abandoned.
    """
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8)))).view(np.uint64)
    q = np.where(bits[:, queries], np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    levels = int(radius + 1).bit_length()
    # Counters start so that reaching radius + 1 carries out of the top level.
    start = (1 << levels) - (radius + 1)
    shape = (q.shape[1], planes.shape[1])
    count = [np.full(shape, np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(levels)]
    over = np.zeros(shape, np.uint64)
    own = np.zeros((q.shape[1], planes.shape[1] * 64), bool)
    own[np.arange(q.shape[1]), np.arange(queries.start, queries.stop)] = True
    own = np.packbits(own, axis=1, bitorder="little").view(np.uint64) | (np.arange(planes.shape[1] * 64) >= n).reshape(1, -1, 64).dot(np.uint64(1) << np.arange(64, dtype=np.uint64))
    for b in range(len(bits)):
        carry = planes[b] ^ q[b][:, None]
        for k in range(levels):
            carry, count[k] = count[k] & carry, count[k] ^ carry
        over |= carry
        if b % 8 == 7 and (over | own).min() == np.uint64(0xFFFFFFFFFFFFFFFF):
            break
    return np.unpackbits(over.view(np.uint8).reshape(shape[0], -1), axis=1, bitorder="little")[:, :n] == 0


def _forest(fp: np.ndarray, unit_end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius as a spanning forest of row numbers; rows are sorted by unit, ``unit_end`` is each row's unit's end."""
    n = len(fp)
    label = np.arange(n)
    at = 0
    while at < n:
        stop = min(at + BLOCK_ROWS, n)
        end = int(unit_end[stop - 1])
        near = within(fp[at:end], slice(0, stop - at), radius)
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            linked = label[at:end][near[i]]
            least = linked.min()
            if (linked != least).any():
                label[np.isin(label, linked)] = least
        at = stop
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def key_masks(n: int, radius: int) -> list[int]:
    """Signed masks of bits, so that two of ``n`` fingerprints within the radius agree under one of them.

    Bits are cut into some blocks more than the radius; fingerprints within it agree in as many whole blocks as it is
    less, and each choice of so many is a mask. The more fingerprints, the more blocks, up to four more: the masks get
    wider, so that unrelated fingerprints share a key about ``KEY_ROWS`` times at most.
    """
    more = 2
    while more < 4 and n > KEY_ROWS << BITS * more // (radius + more):
        more += 1
    blocks = radius + more
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    masks = (sum(((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in chosen) for chosen in combinations(range(blocks), more))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``(u, v)`` signed fingerprints: links that join all of ``fps(_fp)`` within the radius.

    Two fingerprints within the radius share a key, see :func:`key_masks`. A key of many rows is cut into chunks,
    and each pair of chunks is one unit, so no task holds more than a few thousand rows of a key.
    A unit gives at most as many links as it has rows.
    """
    masks = key_masks(fps.count(), radius)
    key = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("_fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(masks))))
    keyed = fps.select("_fp", key.alias("k")).select("_fp", "k.t", "k.v")
    many = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1")
    return bit_sliced_links(keyed.join(many, ["t", "v"]).withColumn("_key", F.col("_fp")), radius)


def bit_sliced_links(buckets: DataFrame, radius: int, words: tuple[str, ...] = ("_fp",)) -> DataFrame:
    """``(u, v)``: links that join the rows of each bucket of ``buckets(t, v, n, _key, *words)`` within the radius, by ``_key``.

    A bucket ``(t, v)`` of ``n`` rows is cut into chunks, and each pair of chunks is a unit of its own. Fingerprints
    are the columns in ``words``.
    """
    units = (
        buckets.withColumn("c", F.ceil(F.col("n") / CHUNK_ROWS).cast("int"))
        .withColumn("m", F.pmod(F.xxhash64("_key"), "c").cast("int"))
        .select("t", "v", "_key", *words, F.explode(F.expr(PAIRS_OF_CHUNKS)).alias("p"))
        .select("t", "v", "p.i", "p.j", "_key", *words)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            ends = np.append(change, len(rows))
            u, v = _forest(np.ascontiguousarray(rows[:, 5:]).view(np.uint64), np.repeat(ends, np.diff(ends, prepend=0)), radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[u, 4]), pa.array(rows[v, 4])], names=["u", "v"])

        for batch in batches:
            rows = np.stack([np.asarray(x.cast(pa.int64())) for x in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield out(rows[:last])
            held = rows[last:]
        if held is not None and len(held):
            yield out(held)

    dealt = units.repartition("t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j")
    return dealt.mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint``, ``component_id`` (and the columns in ``keep``).

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius``
    differing bits. Equal fingerprints are one class, whose copies are never paired. Null and
    empty texts have fingerprint zero; null ids are never the smallest unless all are null;
    repeated rows each give a row; an empty table gives none; other columns don't matter.
    """
    named = _classes(docs.select("doc_id", "text", *(keep or [])), radius, width)
    return named.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id", *(keep or []))


def _classes(docs: DataFrame, radius: int, width: int) -> DataFrame:
    """``docs`` without text, with ``_fp``, ``component_id`` and ``_root``, the fingerprint that names the class."""
    fps = materialize(fingerprints(docs, width))
    classes = materialize(fps.groupBy("_fp").agg(F.min("doc_id").alias("_rep")))
    roots = connected_components(near_links(classes.select("_fp"), radius))
    linked = classes.join(roots.withColumnRenamed("node", "_fp"), "_fp")
    linked = linked.unionByName(roots.select(F.col("root").alias("_fp"), "root").distinct().join(classes, "_fp").select("_fp", "_rep", "root"))
    least = linked.groupBy("root").agg(F.min("_rep").alias("_least"))
    ids = materialize(linked.join(least, "root").select("_fp", "_least", "root"))
    named = classes.join(ids, "_fp", "left").select("_fp", F.coalesce("_least", "_rep").alias("component_id"), F.coalesce("root", "_fp").alias("_root"))
    return fps.join(named, "_fp")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest ``doc_id``, then the smallest row hash.

    A row is known by its id and a hash of its columns; of rows that repeat whole, one stays. Null
    ids go last. Only ids, hashes and fingerprints are grouped; texts are not, except those of
    rows that repeat. All columns stay, whatever their names; an empty table gives none.
    """
    classes = _classes(docs.select("doc_id", "text", row_hash(docs)), radius, width)
    return first_rows(docs, classes.withColumnRenamed("_root", "_class"))


def row_hash(docs: DataFrame):
    """A hash of all columns, as ``_row``."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def first_rows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each class of ``classes(doc_id, _row, _class)``; rows are known by id and :func:`row_hash`."""
    # The columns stand in one struct, so that none clashes with those made here.
    hashed = docs.select(F.struct(*docs.columns).alias("_all"), F.col("doc_id").alias("_doc"), row_hash(docs))
    back = [F.col("_all").getField(c).alias(c) for c in docs.columns]
    first = F.min_by(F.struct("doc_id", "_row"), F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    best = classes.groupBy("_class").agg(first.alias("_first")).select("_first.*")
    rows = classes.groupBy("doc_id", "_row").agg(F.count("*").alias("_n"))
    chosen = materialize(best.join(rows, [best["_row"] == rows["_row"], best["doc_id"].eqNullSafe(rows["doc_id"])]).select(best["doc_id"].alias("_id"), best["_row"].alias("_hash"), "_n"))
    kept = hashed.join(chosen, [F.col("_row") == F.col("_hash"), F.col("_doc").eqNullSafe(F.col("_id"))])
    once = kept.filter("_n = 1").select(*back)
    if chosen.filter("_n > 1").isEmpty():
        return once
    return once.unionByName(kept.filter("_n > 1").dropDuplicates(["_id", "_hash"]).select(*back))
