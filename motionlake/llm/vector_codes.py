"""Product codes of integer vectors, whose nearest entries are found by partial distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import bounded_batches, free_name, materialize

#: Defaults of a code: equal parts of a vector, entries of each part's codebook, and rounds of refinement.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components below this fit 64-bit arithmetic: the distance of parts of up to 128 of them.
LARGEST = 1 << 26
#: Entries that are compared at once, between which each vector's best distance is updated; and dimensions that come first, without a mask.
BLOCK, OPENING = 64, 3
#: Labels up to which their sums are broadcast; more of them are joined.
BROADCAST_LABELS = 100_000


def scaled(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null where the vector is null or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equally near ones, and its squared distance.

    Dimensions come in order of falling variance of the codebook. Entries go block by block: after the first
    dimensions, a row's most promising entry of the block is completed if no complete distance is known yet; then each
    further dimension is added only for the entries that are left, of which those drop out whose sum strictly exceeds
    the row's best complete distance. What remains at the end is complete, and ties are still in it.
    """
    order = np.argsort(-np.var(book.astype(np.float64), axis=0), kind="stable")
    x, book = np.ascontiguousarray(x[:, order].T), np.ascontiguousarray(book[:, order].T)
    d, n = x.shape
    opening = min(OPENING, d)
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    for lo in range(0, book.shape[1], BLOCK):
        part = book[:, lo : lo + BLOCK]
        total = np.zeros((n, part.shape[1]), np.int64)
        for k in range(opening):
            gap = x[k][:, None] - part[k]
            total += gap * gap
        if lo == 0:
            guess = total.argmin(axis=1)
            gap = x - part[:, guess]
            best, index = (gap * gap).sum(axis=0), guess
        row, entry = np.nonzero(total <= best[:, None])
        left = total[row, entry]
        for k in range(opening, d):
            gap = x[k][row] - part[k][entry]
            left = left + gap * gap
            keep = left <= best[row]
            row, entry, left = row[keep], entry[keep], left[keep]
        # Rows stand together and entries rise within them: the first of the least distances is that of the lowest index.
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least, owner = np.minimum.reduceat(left, first), row[first]
            where = np.flatnonzero(left == np.repeat(least, np.diff(np.r_[first, len(row)])))
            _, at = np.unique(row[where], return_index=True)
            found = entry[where[at]] + lo
            # Of equal distances the lower index stays; the guess may be a higher one of its own block.
            better = (least < best[owner]) | (found < index[owner])
            best[owner[better]], index[owner[better]] = least[better], found[better]
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry]``: integer components; all parts have as many entries."""

    books: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _parts(batch: pa.RecordBatch, name: str, books: np.ndarray) -> list[np.ndarray]:
    x = _matrix(batch.column(batch.schema.get_field_index(name)))
    return np.split(x, len(books), axis=1)


def _moved(vectors: DataFrame, name: str, books: np.ndarray) -> np.ndarray:
    """Every entry as the floored mean of the parts that it is nearest to; entries without one stay.

    A task sends one row of sums for each entry that it used, so what is shuffled does not grow with the rows of a task,
    and what comes to the driver has the size of the codebooks.
    """
    width = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for p, x in enumerate(_parts(batch, name, books)) if batch.num_rows else ():
                index, _ = nearest(x, books[p])
                np.add.at(total[p], index, x)
                count[p] += np.bincount(index, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        rows = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), width).cast(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["part", "entry", "n", "sums"])

    each = vectors.select(name).mapInArrow(sums, "part bigint, entry bigint, n bigint, sums array<bigint>")
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums")).collect():
        out[r.part, r.entry] = np.floor_divide(np.array(r.sums, np.int64), r.n)
    return out


def train(vectors: DataFrame, id_: str, name: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``vectors``: they start as the parts of the rows with the least ids, and every round takes means over all rows."""
    first = vectors.select(id_, name).orderBy(F.col(id_).asc_nulls_last(), name).limit(entries).collect()
    widths = {len(r[name]) for r in first}
    if len(widths) != 1 or not (width := widths.pop()) or width % parts:
        raise ValueError(f"vectors must be of one length that {parts} parts divide, not of {sorted(widths) or width}")
    books = np.stack(np.split(np.array([r[name] for r in first], np.int64), parts, axis=1))
    for _ in range(rounds):
        books = _moved(vectors, name, books)
    return Codebooks(books)


def encode(vectors: DataFrame, name: str, codebooks: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """``vectors`` with ``code``, an index of two hex digits for each part, and ``error``, the squared distances in sum."""
    books = codebooks.books
    if books.shape[1] > 256:
        raise ValueError("an index of two hex digits takes 256 entries at most")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(x, books[p]) for p, x in enumerate(_parts(batch, name, books))]
                digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                codes = pa.array([d.tobytes().hex() for d in digits], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, codes, pa.array(sum(e for _, e in found), pa.int64())], names=[*batch.schema.names, code, error])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields), f"`{code}` string, `{error}` bigint"])
    return vectors.mapInArrow(step, schema)


def compress(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` without their vector, with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Rows whose vector is null or holds a null or a component that isn't finite are left out. The codebooks start from
    the ``entries`` kept rows of least id, null ids last and equal ids in order of their vectors; with fewer rows
    there are fewer entries. Of equally near entries the lowest wins; repeated rows count each and are coded alike.
    ``label_error`` sums the errors of a label, null labels together. An empty table gives none. Columns named
    like an output are replaced. Vectors must be of one length that ``parts`` divides, with scaled components under 2^26.

    All rows are read once for each round and once for codes, by tasks that hold the codebooks only; sums by label are
    added up before they are shuffled, and meet the rows by broadcast while there are few labels.
    """
    outputs = ["code", "error", "label_error", "codebooks_sha256"]
    rows = bounded_batches(rows.drop(*(c for c in rows.columns if c.lower() in outputs)))
    q = free_name(rows.columns, "q")
    kept = rows.withColumn(q, scaled(vector, scale)).filter(F.col(q).isNotNull())
    sizes = kept.agg(F.min(F.size(q)).alias("least"), F.max(F.size(q)).alias("most"), F.max(F.array_max(F.transform(q, lambda x: F.abs(x)))).alias("top")).first()
    kept = kept.drop(vector)
    if sizes["most"] is None:
        return kept.drop(q).select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(outputs, ("string", "bigint", "bigint", "string"))))
    if sizes["least"] != sizes["most"] or (sizes["top"] or 0) >= LARGEST:
        raise ValueError(f"vectors have {sizes['least']} to {sizes['most']} components, of up to {sizes['top']}; they must have as many, under {LARGEST}")
    books = train(kept, id_, q, parts, entries, rounds)
    coded = materialize(encode(kept, q, books).drop(q))
    sums = materialize(coded.groupBy(label).agg(F.sum("error").alias("label_error")).withColumnRenamed(label, "_label"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, coded[label].eqNullSafe(sums["_label"])).drop("_label")
    return out.withColumn("codebooks_sha256", F.lit(books.sha256))
