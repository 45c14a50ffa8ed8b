"""Packing documents into token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import map_batches, materialize
from motionlake.llm.tokens import encoder

#: Pieces that one task packs; only a group's last bins stay open, so the waste falls as groups grow.
GROUP_ROWS = 20_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's token ids with the end id, cut where longer than ``size``.

    The first piece takes what is over, all others are full. A null text is empty: it has the end
    id alone. Whole texts are encoded; the ids themselves don't leave the task.
    """

    def make():
        tokens = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts)):
                ids += end
                n = len(ids) // 4
                cut = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), make, PIECE)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, none over ``size``.

    Longest first, each goes into the open bin for which the sum over all gaps of the squared
    count of open bins with that gap becomes smallest; on ties into the fullest of these. A new
    bin is opened only where none has room: opening one is never weighed in the sum, by choice, for fewer bins.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        change = 2 * (count[: size - n] - count[n:size]) + 2
        if n < size:
            change[0] = 1 - 2 * count[n]
        fits = count[n:size] > 0
        if fits.any():
            gap = n + int(np.where(fits, change, np.iinfo(np.int64).max).argmin())
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - gap
        if gap > n:
            open_bins[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; a sequence has at most ``size`` tokens.

    Pieces are dealt out in turn to groups of about ``group_rows``, whichever document or source
    they are of, and each group is packed in one task of bounded size. Rows with equal ids, null ids and
    repeated rows are packed like others, each with pieces of its own; an empty table gives no rows; other
    columns don't matter.
    """
    cut = materialize(pieces(docs, tokenizer, size, end_id))
    groups = -(-cut.count() // group_rows) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), size)
        bins += TaskContext.get().partitionId() << 32
        rows = rows.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))
        yield from rows.to_batches(max_chunksize=10_000)

    return cut.repartition(groups).mapInArrow(run, f"{PIECE}, sequence_id bigint, offset bigint")
