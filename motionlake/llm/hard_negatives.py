"""Hard negatives by distributed radix selection over integer scores.

Scores of all rows with an anchor are never stored or sorted. A task multiplies a block of rows with a block of anchors and
counts, for each anchor's window of scores, how many fall on each digit; the counts of all tasks tell on which digit the
k-th score lies, and the next pass looks only there, one digit further. When the k-th score is known, one more pass gathers
the rows at or above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm.common import materialize

#: Rows and anchors of a block, anchors whose scores stand in memory at once, and bits of a digit.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE, DIGIT_BITS = 16_384, 16_384, 128, 10
_LAST = np.iinfo(np.int64).max


def _ints(table: pa.Table, name: str, null: int = _LAST) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("q").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _windows(rows: pa.Table, anchors: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """For some windows at once: each one's distance of every row's score below its top, which of them may count, and its columns.

    ``same`` chooses other rows of the anchor's label, else those of other labels.
    """
    x, ids, labels = _vectors(rows).T, _ints(rows, "vec_id"), _ints(rows, "label")
    all_w = anchors.column("w").combine_chunks()
    w = {f: all_w.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("j", "lo", "hi", "prefix", "found")}
    owner = np.repeat(np.arange(len(all_w)), all_w.value_lengths().to_numpy(zero_copy_only=False))
    q, keys, own_ids, own_labels = _vectors(anchors), _ints(anchors, "anchor"), _ints(anchors, "anchor_id"), _ints(anchors, "anchor_label")
    for lo in range(0, len(q), AT_ONCE):
        here = slice(lo, lo + AT_ONCE)
        scores = (q[here] @ x).astype(np.int64)
        may = labels == own_labels[here, None]
        may = may & (ids != own_ids[here, None]) if same else ~may
        mine = np.flatnonzero((owner >= lo) & (owner < lo + AT_ONCE))
        for j in np.unique(w["j"][mine]):
            at = mine[w["j"][mine] == j]
            part = {f: v[at] for f, v in w.items()} | {"anchor": keys[owner[at]]}
            below = part["hi"][:, None] - scores[owner[at] - lo]
            yield below, may[owner[at] - lo] & (below >= 0) & (below <= (part["hi"] - part["lo"])[:, None]), part


def _counts(shift: int, bits: int, k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """How many scores of each window lie on each digit below its prefix; digits after a block's own k-th score can't hold that of all blocks."""

    def count(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for below, may, part in _windows(rows, anchors, same) if rows.num_rows and anchors.num_rows else ():
            may &= (below >> (shift + bits) == part["prefix"][:, None]) & ~part["found"][:, None]
            r, c = np.nonzero(may)
            digit = (below[r, c] >> shift) & ((1 << bits) - 1)
            n = np.bincount((r << bits) + digit, minlength=len(part["j"]) << bits).reshape(-1, 1 << bits)
            r, digit = np.nonzero((n > 0) & (np.cumsum(n, axis=1) - n < k))
            for held, new in zip(out, (part["anchor"][r], part["j"][r], digit, n[r, digit])):
                held.append(new)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["anchor", "j", "digit", "n"])

    return count


def _gathered(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of each window at or above its k-th score; of a block the first k, as no more of it can be among the first k of all."""

    def gather(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, out = _ints(rows, "vec_id"), [[], [], [], []]
        for below, may, part in _windows(rows, anchors, same) if rows.num_rows and anchors.num_rows else ():
            r, c = np.nonzero(may & (below <= part["prefix"][:, None]))
            b = below[r, c]
            order = np.lexsort((ids[c], b, r))
            r, c, b = r[order], c[order], b[order]
            first = np.searchsorted(r, r)
            keep = np.arange(len(r)) - first < k
            r, c, b = r[keep], c[keep], b[keep]
            for held, new in zip(out, (part["anchor"][r], part["j"][r], c, part["hi"][r] - b)):
                held.append(new)
        anchor, j, c, score = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
        return pa.table([pa.array(anchor), pa.array(j), rows.column("vec_id").combine_chunks().take(pa.array(c)).cast(pa.int64()), pa.array(score)], names=["anchor", "j", "vec_id", "score"])

    return gather


class _Blocks:
    """Rows and anchors in blocks: each block of rows meets each block of anchors in one group, whose size is bounded."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, row_block: int, anchor_block: int):
        spark = rows.sparkSession
        n, a = rows.count(), anchors.count()
        self.row_blocks = max(-(-n // row_block), min(n, spark.sparkContext.defaultParallelism), 1)
        self.anchor_blocks = max(-(-a // anchor_block), 1)
        of = lambda n: F.pmod(F.xxhash64(F.col("anchor")), F.lit(n))
        numbered = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        self.rows = rows.select("vec_id", "label", "q", F.pmod("at", F.lit(self.row_blocks)).alias("r"), numbered(self.anchor_blocks).alias("a"))
        self.anchors = anchors.withColumn("a", of(self.anchor_blocks)).withColumn("r", numbered(self.row_blocks))

    def run(self, windows: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``f`` on each group, whose anchors have their windows."""
        of = windows.groupBy("anchor").agg(F.collect_list(F.struct("j", "lo", "hi", "prefix", "found")).alias("w"))
        anchors = self.anchors.join(of, "anchor")
        return self.rows.groupBy("r", "a").cogroup(anchors.groupBy("r", "a")).applyInArrow(f, schema)


def _first(blocks: _Blocks, windows: DataFrame, width: int, k: int, same: bool, bits: int) -> DataFrame:
    """``anchor, j, vec_id, score, rank`` of the first k rows of each window (anchor, j, lo, hi), by falling score and rising id.

    ``prefix`` grows by a digit in each round, until it is how far the k-th score lies below the window's top. A window
    with fewer than k rows is found at once: all of it.
    """
    state = windows.withColumns({"prefix": F.lit(0).cast("bigint"), "need": F.lit(k).cast("bigint"), "found": F.lit(False)})
    rounds = max(1, -(-width.bit_length() // bits))
    for shift in range((rounds - 1) * bits, -1, -bits):
        counts = blocks.run(state, _counts(shift, bits, k, same), "anchor bigint, j bigint, digit bigint, n bigint")
        counts = counts.groupBy("anchor", "j", "digit").agg(F.sum("n").alias("n")).join(state.select("anchor", "j", "need"), ["anchor", "j"])
        upto = F.sum("n").over(Window.partitionBy("anchor", "j").orderBy("digit"))
        hit = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        new = state.join(hit.select("anchor", "j", "digit", (F.col("upto") - F.col("n")).alias("before")), ["anchor", "j"], "left")
        missing = F.col("digit").isNull()
        state = materialize(
            new.select(
                "anchor", "j", "lo", "hi",
                F.when(F.col("found"), F.col("prefix")).when(missing, F.col("hi") - F.col("lo")).otherwise(F.shiftleft("prefix", bits) + F.col("digit")).alias("prefix"),
                F.coalesce(F.col("need") - F.col("before"), "need").alias("need"),
                (F.col("found") | missing).alias("found"),
            )
        )
    rows = blocks.run(state, _gathered(k, same), "anchor bigint, j bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "j").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, bits: int = DIGIT_BITS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``rows(vec_id, label, q)``, q integer vectors.

    A row's score is its inner product with the anchor; higher ones come first, equal ones by smaller id, null ids last.
    Positives are the first rows of the anchor's label but those of its own id; negatives the first rows of other labels whose
    score is from ``least`` to ``most`` per cent of the positive's. Rows without label or vector take no part. Rows of
    one id count each, and each anchor row gives its own results. No anchors or no rows give an empty table; other
    columns are left out. Vectors must be of one length, with squared norms below 2^53: such products are exact.

    Every row is scored with every anchor in each pass, in groups of at most about ``row_block`` and ``anchor_block``
    rows; what leaves a group is at most k digits or rows for each window, ties included, however common a vector is.
    """
    at = F.monotonically_increasing_id()
    squares = F.aggregate(F.transform("q", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = materialize(rows.filter(F.col("label").isNotNull() & F.col("q").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("q").cast("array<bigint>").alias("q"), at.alias("at")))
    bound = rows.agg(F.max(squares).alias("top"), F.min(F.size("q")).alias("short"), F.max(F.size("q")).alias("long")).first()
    if bound["short"] != bound["long"] or (bound["top"] or 0.0) >= 2.0**53:
        raise ValueError(f"vectors must be of one length and of squared norms below 2^53, not of {bound}")
    top = int(bound["top"] or 0) + 1
    anchors = materialize(rows.filter(is_anchor).select(F.col("at").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "q"))
    blocks = _Blocks(rows, anchors, row_block, anchor_block)
    whole = anchors.select("anchor", F.lit(0).cast("bigint").alias("j"), F.lit(-top).cast("bigint").alias("lo"), F.lit(top).cast("bigint").alias("hi"))
    near = _first(blocks, whole, 2 * top, positives, True, bits)
    p = F.col("score")
    # Bounds of whole scores: 100 s >= least * p and 100 s <= most * p.
    lo, hi = F.expr(f"(score * {least} + pmod(-score * {least}, 100L)) div 100"), F.expr(f"(score * {most} - pmod(score * {most}, 100L)) div 100")
    near = materialize(near.select("anchor", F.col("rank").cast("bigint").alias("j"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"), lo.alias("lo"), hi.alias("hi")))
    windows = near.filter("lo <= hi").select("anchor", "j", "lo", "hi")
    width = windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    found = _first(blocks, windows, width, negatives, False, bits).select("anchor", "j", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = found.join(near, ["anchor", "j"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
