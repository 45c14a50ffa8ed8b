"""Documents whose shingle sets are similar: SimHash fingerprints compared by bit planes, then whole sets.

Fingerprints of similarity 0.8 differ in ten of 64 bits, and in up to twenty: no choice of blocks of bits finds those
without comparing a large part of all pairs. So the fingerprints that are compared are those of sets with a rare shingle in common,
and they have 256 bits, by which a similarity of 0.8 is told from one of a half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import bounded_batches, map_batches, materialize, texts_of
from motionlake.llm.components import connected_components
from motionlake.llm.simhash_dedup import BITS, PAIRS_OF_CHUNKS, bit_sliced_links, fingerprint, first_rows, row_hash

#: Sets, and shingles of them, that one unit of comparison holds from either side on average.
CHUNK_ROWS, CHUNK_SHINGLES = 1024, 2_000_000
#: Columns of a fingerprint of 256 bits, and odd numbers by which hashes are mixed for them.
WORDS = ("_f0", "_f1", "_f2", "_f3")
_ODD = np.array([1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: Rows of candidates whose ids are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Slots of hashes in which the shingles of all documents are counted, as powers of two: one slot for this many bytes of text, between two bounds.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS = 512, 16, 24
#: Slots whose counts, and levels, are one row.
BLOCK_SLOTS = 1 << 16
#: Bytes of text that a task of the count reads on average, where there are enough for all cores.
TASK_BYTES = 256 << 20


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``width`` words, sorted; a shorter text is one run."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(min(width, len(words))))))
    n = max(len(words) - width + 1, 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), dtype="<u8", count=n).view(np.int64))


def slots_for(text_bytes: int) -> int:
    """Slots of one row of counts: they grow with the text, up to 16.8 million, whose two rows take 64 MB."""
    return 1 << min(max((text_bytes // SLOT_BYTES).bit_length(), LEAST_SLOTS), MOST_SLOTS)


def slots_of(s: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's slot in either row of counts; different bits choose them, so that a common shingle lifts a rare one only if it meets one in both rows."""
    return s & (slots - 1), slots + ((s >> 32) & (slots - 1))


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How common shingles of all documents are: two rows of slots, each with the logarithm of its shingles as a small integer.

    The lesser of a shingle's two slots bounds its count from above. They only order shingles: any order gives the same pairs.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = slots_for(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * slots, np.int32)
        for batch in batches:
            for text in texts_of(batch):
                for at in slots_of(shingles(text, width), slots):
                    np.add.at(held, at, np.int32(1))
        for k, part in enumerate(np.split(held, range(BLOCK_SLOTS, 2 * slots, BLOCK_SLOTS))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["block", "counts"])
        pa.default_memory_pool().release_unused()

    def block(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int32).astype(np.int64) for c in rows.column("counts"))
        levels = np.floor(500 * np.log2(total + 1)).astype(np.int16)
        return pa.table({"block": rows.column("block")[:1], "levels": [levels.tobytes()]})

    # Each task sends all slots that it has counted in: few tasks with much text, so that what is sent doesn't grow with slots times splits of the input.
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    found = bounded_batches(docs.select("text").coalesce(tasks)).mapInArrow(count, "block int, counts binary")
    # A block is 128 KB in one row: the driver gets at most 512 of them.
    blocks = found.groupBy("block").applyInArrow(block, "block int, levels binary").collect()
    levels = np.zeros((-(-2 * slots // BLOCK_SLOTS), BLOCK_SLOTS), np.int16)
    for r in blocks:
        one = np.frombuffer(r["levels"], np.int16)
        levels[r["block"], : len(one)] = one
    return levels.ravel()[: 2 * slots]


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in as many words as ``WORDS``: bits set in over half of the hashes, mixed anew for each word."""
    h = s.view(np.uint64)
    return np.array([fingerprint((h ^ (h >> np.uint64(29))) * odd if k else h) for k, odd in enumerate(_ODD)], np.uint64)


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """``docs(doc_id, _row, text)`` as ``doc_id, _row, key, size, *WORDS, first``.

    ``key`` is a hash of the set of shingles, ``WORDS`` its SimHash, and ``first`` those of its shingles, rare ones first, of which a
    set of at least the similarity must have one.
    """
    held = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, width))

    def make():
        levels = held.value
        slots = len(levels) // 2

        def first(s: np.ndarray) -> np.ndarray:
            a, b = slots_of(s, slots)
            s = s[np.argsort(np.minimum(levels[a], levels[b]), kind="stable")]
            return s[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            all_sets = [shingles(t, width) for t in texts_of(batch)]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in all_sets], np.uint64).view(np.int64)
            prints = np.stack([wide_fingerprint(s) for s in all_sets]).view(np.int64)
            firsts = [first(s) for s in all_sets]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in firsts])]).astype(np.int32)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "_row")]
            columns += [pa.array(keys), pa.array([len(s) for s in all_sets], pa.int32()), *(pa.array(p) for p in np.ascontiguousarray(prints.T)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "key", "size", *WORDS, "first"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(map_batches(docs.select("doc_id", "_row", "text"), make, f"doc_id {kind}, _row bigint, key bigint, size int, {', '.join(f'{w} bigint' for w in WORDS)}, first array<bigint>"))


def radius_for(threshold: float, deviations: float | None = 4.5) -> int:
    """Bits in which the fingerprints of sets of that similarity differ, ``deviations`` beyond what is expected; None: all bits, which excludes nothing."""
    share = math.acos(2 * threshold / (1 + threshold)) / math.pi
    bits = BITS * len(WORDS)
    return bits if deviations is None else min(round(bits * share + deviations * math.sqrt(bits * share * (1 - share))), bits)


def forest(keys: np.ndarray, values: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int]]:
    """Links that join all rows of a unit whose sets are similar: each row reached from one before it, at most one link a row."""
    sizes = np.array([len(v) for v in values])
    codes = np.unique(np.concatenate(values), return_inverse=True)[1]
    flat = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(codes.max()) + 1, bool)
    left, queue = np.arange(len(values)), []
    while len(left):
        if queue:
            i = queue.pop()
            mark[flat[i]] = True
            shared = np.add.reduceat(mark[cat], starts, dtype=np.int64)
            mark[flat[i]] = False
            near = shared >= threshold * (sizes[i] + sizes[left] - shared) - 1e-9
            for j in left[near].tolist():
                yield int(keys[i]), int(keys[j])
                queue.append(j)
        else:
            queue.append(int(left[0]))
            near = left == left[0]
        if near.any() and len(left := left[~near]):
            cat = np.concatenate([flat[j] for j in left.tolist()])
            starts = np.cumsum(sizes[left]) - sizes[left]


def candidate_classes(rows: DataFrame, threshold: float, deviations: float | None) -> DataFrame:
    """``(key, root)``: classes of sets joined by fingerprints within :func:`radius_for` the similarity, of those that share a first shingle.

    Two sets of at least the similarity share one of their first shingles, in any order common to all, so fingerprints are compared
    within the classes of each such shingle whose sizes allow the similarity, by bit planes.
    Shingles with the same classes are one bucket. Only keys, sizes and fingerprints are moved.
    """
    entries = rows.filter("size > 0").select("key", "size", F.explode("first").alias("h"))
    many = entries.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("h")
    # Sizes of similar sets lie in one band or in two beside each other; a little is added against rounding.
    band = (F.floor(F.log("size") / (-math.log(threshold) + 1e-9)) if threshold < 1 else F.col("size")).cast("bigint")
    pairs = materialize(entries.join(many, "h").groupBy("h", "key").agg(F.first("size").alias("size")))
    pairs = pairs.select("key", "h", F.explode(F.array(band, band - 1) if threshold < 1 else F.array(band)).alias("g"))
    buckets = pairs.groupBy("h", "g").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("s"), F.bit_xor("key").alias("x")).filter("n > 1")
    buckets = buckets.groupBy("n", "s", "x").agg(F.min(F.struct("h", "g")).alias("p")).select("p.h", "p.g", "n")
    prints = rows.groupBy("key").agg(*(F.first(w).alias(w) for w in WORDS))
    units = pairs.join(buckets, ["h", "g"]).join(prints, "key").select(F.col("h").alias("t"), F.col("g").alias("v"), "n", F.col("key").alias("_key"), *WORDS)
    roots = materialize(connected_components(bit_sliced_links(units, radius_for(threshold, deviations), WORDS)))
    return roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct())


def similar_links(docs: DataFrame, rows: DataFrame, width: int, threshold: float, deviations: float | None = 4.5) -> DataFrame:
    """``(u, v)`` keys: links that join all sets of ``rows`` (the :func:`signatures` of ``docs``) with at least the similarity.

    Candidates are the :func:`candidate_classes`. Within each, whole sets decide, made again from the texts of one row for each set.
    A class of many sets, or of long ones, is cut into chunks, whose pairs are units; a unit gives at most as many links as it has rows.
    """
    members = materialize(candidate_classes(rows, threshold, deviations))
    one = rows.join(members.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("_row", "doc_id")).alias("o"), F.first("size").alias("size"))
    members = materialize(members.join(one, "key"))
    chunks = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("c"))
    units = members.join(chunks, "root").withColumn("m", F.pmod(F.xxhash64("key"), "c").cast("int")).select("root", "key", "o", F.explode(F.expr(PAIRS_OF_CHUNKS)).alias("p"))
    units = materialize(units.select("root", "p.i", "p.j", "key", F.col("o._row").alias("_hash"), F.col("o.doc_id").alias("_id")))
    if units.count() <= BROADCAST_ROWS:
        units = F.broadcast(units)
    texts = units.join(docs.select("doc_id", "_row", "text"), [F.col("_hash") == F.col("_row"), F.col("_id").eqNullSafe(F.col("doc_id"))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, values = None, [], []

        def out() -> pa.RecordBatch:
            links = list(forest(np.array(keys), values, threshold)) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for *at, key, text in zip(*(batch.column(c).to_pylist() for c in range(4)), texts_of(batch)):
                if at != unit:
                    if keys:
                        yield out()
                    unit, keys, values = at, [], []
                if not keys or keys[-1] != key:  # a row that repeats whole comes again
                    keys.append(key)
                    values.append(shingles(text, width))
        if keys:
            yield out()
        pa.default_memory_pool().release_unused()

    dealt = texts.select("root", "i", "j", "key", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")
    return bounded_batches(dealt).mapInArrow(compare, "u bigint, v bigint")


def keep_one(docs: DataFrame, width: int = 5, threshold: float = 0.8, deviations: float | None = 4.5) -> DataFrame:
    """``docs`` with one row of each class of near copies: the smallest ``doc_id``, then the smallest row hash.

    Near copies are joined by chains of rows whose sets of lower-case ``width``-word shingles have
    a Jaccard similarity of at least ``threshold``; a text of fewer words is one shingle, and texts
    without words, null ones too, are one class. Fingerprints of 256 bits choose the pairs that are compared
    by whole sets, within ``deviations`` standard deviations of the distance expected at the threshold: at 4.5, three in a million
    pairs of just the threshold lie beyond. With None whole sets decide on all sets that share a rare shingle, which loses no pair. Null ids go last; of rows
    that repeat whole one stays; all columns stay, whatever their names; an empty table gives none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    texts = docs.select("doc_id", row_hash(docs), "text")
    rows = signatures(texts, width, threshold)
    roots = materialize(connected_components(similar_links(texts, rows, width, threshold, deviations)))
    classes = rows.join(roots, rows["key"] == roots["node"], "left").select("doc_id", "_row", F.coalesce("root", "key").alias("_class"))
    return first_rows(docs, classes)
