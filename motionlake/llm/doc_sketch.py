"""Fingerprints of documents: the shingle hashes below a fixed fraction of all hashes.

Such a sketch is a sample of the text's shingles that is the same wherever a shingle occurs. Sketches merge by union, and
the share of the smaller one that is in the other estimates how much of the shorter text the longer one contains,
however unequal they are. Everything here is Spark SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.operators import scan

#: Words of a shingle, and the part of all hashes, one in so many, that a sketch keeps.
WORDS, SCALE = 5, 8


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The text's sketch: sorted, distinct 64-bit hashes of its shingles that are among the lowest ``1 / scale`` of all hashes.

    Words are runs without ASCII white space, and a shingle's hash is that of its words' hashes. A text of fewer words
    than a shingle has is one shingle. Where no hash is low enough the text's least one is kept, so that only a null
    text or one without words has an empty sketch. Repeated shingles count once. Whole texts are read.
    """
    split = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    hashed = F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        # Beyond the end of a short text there are nulls, which the hash passes over.
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - words))
        return F.when(F.size(h) > 0, F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))).otherwise(F.array().cast("array<bigint>"))

    def lowest(all_: Column) -> Column:
        low = F.filter(all_, lambda x: x <= F.lit((1 << 64) // scale - (1 << 63) - 1))
        return _let(low, lambda x: F.when((F.size(x) == 0) & (F.size(all_) > 0), F.array(F.array_min(all_))).otherwise(F.sort_array(F.array_distinct(x))))

    return _let(_let(hashed, shingles), lowest)


def merge(sketches: Column) -> Column:
    """Aggregate: the sketch of several texts taken together, all of which are longer than a few shingles."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(sketches))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's text that the other contains, 0 to 1; two empty ones are alike, an empty and another are not."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.size(a) + F.size(b) == 0, 1.0).otherwise(0.0)


def digest(sketch_: Column) -> Column:
    """A sketch as text: 16 lowercase hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch_, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(docs: DataFrame, share: int = 4, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Documents with their sketch, and the opening and sketch of the next one.

    Returns ``doc_id, text, sketch, n_chars, opening, next_sketch``; ``opening`` is the next text's first
    ``n_chars // share`` code points, or all of it. The next document is that of the next greater id, null ids last;
    after the last comes the first, and a single document follows itself. Rows of one id stand in order of their
    text's hash, rows alike in both are one document, and each of them gets a row. A null text is an empty one, an
    empty table gives no rows, and columns other than ``doc_id`` and ``text`` are left out.

    The order is found over ids alone (:mod:`motionlake.operators.scan`). Texts are shuffled once, by id: the same
    exchange gives openings to those who need them, which is at most a ``share`` of all text, and meets them.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = ["doc_id", "hash"]
    places = scan.bucketed(d.select(*order, (F.length("text") / share).cast("int").alias("want")).distinct(), [], order)
    first = places.agg(F.min_by(F.struct(*order), F.struct(F.isnull("doc_id"), *order)).alias("f")).first()["f"]
    if first is None:
        first = (None, 0)
    start = F.struct(F.lit(first[0]).cast(d.schema["doc_id"].dataType).alias("doc_id"), F.lit(first[1]).cast("bigint").alias("hash"))
    ring = scan.neighbour(places, [], order, F.struct(*order), "_next", ahead=True).withColumn("_next", F.coalesce("_next", start))
    ring = ring.select(F.col("_next.doc_id").alias("n_id"), F.col("_next.hash").alias("n_hash"), F.col("doc_id").alias("o_id"), F.col("hash").alias("o_hash"), "want")
    d = d.withColumn("sketch", sketch(F.col("text"), words, scale))
    met = d.join(ring, d["doc_id"].eqNullSafe(ring["n_id"]) & (d["hash"] == ring["n_hash"]))
    given = met.select("o_id", "o_hash", F.substring("text", F.lit(1), F.col("want")).alias("opening"), F.col("sketch").alias("next_sketch")).dropDuplicates(["o_id", "o_hash"])
    out = d.join(given, d["doc_id"].eqNullSafe(given["o_id"]) & (d["hash"] == given["o_hash"]))
    return out.select("doc_id", "text", "sketch", F.length("text").cast("bigint").alias("n_chars"), "opening", "next_sketch")


def edited_pairs(docs: DataFrame, share: int = 4, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of documents and of their edited texts, with their likeness.

    An edited text is the document with its last ``n_chars // share`` code points replaced by the ``opening`` of
    :func:`with_next`, which says what the next document is and what happens to nulls, repeated rows and empty tables.
    """
    pairs = with_next(docs, share, words, scale)
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int"))
    pairs = pairs.withColumn("edited", F.concat(kept, "opening")).withColumn("edited_sketch", sketch(F.col("edited"), words, scale))
    near = containment(F.col("sketch"), F.col("edited_sketch")), containment(F.col("sketch"), F.col("next_sketch"))
    return pairs.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), digest(F.col("sketch")).alias("fingerprint"), digest(F.col("edited_sketch")).alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next"))
