"""Toxicity of texts: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from the labelled texts: words, and beginnings of words, that toxic texts
hold far more often than others. Features are its densities, how near its words stand to the
second person, and rates of capitals, punctuation and obfuscated spelling. The trees give a margin,
and an isotonic regression on texts that the trees have not seen makes a probability of it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionlake.llm.common import free_name, map_batches, materialize

#: Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os vuestro".split()
)
#: Signs written for letters.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
#: How near "near" is, and the words of the window whose density of lexicon words counts.
NEAR_WORDS, WINDOW_WORDS = 5, 100
CACHE_WORDS = 400_000
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_PUNCTUATION, _SHOUT, _SIGNS = b".,;:'\"()-", b"!?", b"@#$%^&*_+=~<>|/\\[]{}"
FEATURES = (
    "log_words", "word_density", "stem_density", "hits", "log_hits", "distinct", "most_weight", "mean_weight", "near_second_person",
    "second_person", "obfuscated_hits", "obfuscated", "capitals", "capital_words", "punctuation", "shouts", "signs", "digits", "densest",
)


def plain(word: str) -> str:
    """A word in lower case without marks at its ends."""
    return word.lower().strip(".,;:!?'\"()[]{}<>|*#$%&_-=+/\\~")


def unmasked(word: str) -> str:
    """A word with signs read as letters, other marks left out and repeated letters made one."""
    out: list[str] = []
    for c in word.lower().translate(LOOKALIKE):
        if c.isalpha() and (not out or out[-1] != c):
            out.append(c)
    return "".join(out)


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings of four and five letters."""
    return [f"={word}", *(f"{word[:k]}-" for k in (4, 5) if len(word) > k)] if len(word) > 2 else []


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms: log ratios of the shares of toxic and other texts that hold them."""

    weights: dict[str, float]

    def reader(self) -> Callable[[str], list[float]]:
        """A function from texts to features, which keeps what it knows of recurring words."""
        weights = self.weights
        squeezed = {unmasked(t[1:]): w for t, w in weights.items() if t[0] == "="}
        seen: dict[str, tuple | None] = {}

        def know(word: str) -> tuple | None:
            """``(word weight, stem weight, obfuscated, second person, capitals)``, or None for a word of no interest."""
            p = plain(word)
            own = weights.get(f"={p}", 0.0)
            stem = max((weights.get(f"{p[:k]}-", 0.0) for k in (4, 5) if len(p) > k), default=0.0)
            masked = 0.0
            if not own and (not p.isalpha() or any(a == b for a, b in zip(p, p[1:]))):
                # A mark may be a letter's stand-in or the sentence's: both readings are tried.
                masked = max(squeezed.get(unmasked(word), 0.0), squeezed.get(unmasked(p), 0.0))
            odd = bool(p) and not p.isalpha() and any(c.isalpha() for c in p) and any(c in "013457@$!|*" for c in p)
            out = (max(own, masked), stem, bool(masked), odd, p in SECOND_PERSON, len(p) > 2 and p.upper() == word.strip(".,;:!?") and p.isalpha())
            return out if any(out) else None

        def read(text: str) -> list[float]:
            if len(seen) > CACHE_WORDS:
                seen.clear()
            words = text.split()
            n = len(words)
            known = list(map(seen.get, words, repeat(0)))
            if 0 in known:
                for k, x in enumerate(known):
                    if x == 0:
                        known[k] = seen[words[k]] = know(words[k])
            marked = [(k, x) for k, x in enumerate(known) if x is not None]
            hits = [(k, max(x[0], x[1])) for k, x in marked if x[0] or x[1]]
            you = [k for k, x in marked if x[4]]
            near = 0
            if hits and you:
                at = np.array(you)
                place = np.array([k for k, _ in hits])
                i = np.searchsorted(at, place)
                gap = np.minimum(np.abs(place - at[np.minimum(i, len(at) - 1)]), np.abs(place - at[np.maximum(i - 1, 0)]))
                near = int((gap <= NEAR_WORDS).sum())
            raw = text.encode()
            share = lambda signs: (len(raw) - len(raw.translate(None, signs))) / (len(raw) or 1)
            per = n or 1
            densest = 0
            if hits:
                place = np.array([k for k, _ in hits])
                densest = int((np.searchsorted(place, place + WINDOW_WORDS) - np.arange(len(place))).max())
            return [
                math.log1p(n), sum(bool(x[0]) for _, x in marked) / per, sum(bool(x[1]) for _, x in marked) / per, float(len(hits)), math.log1p(len(hits)),
                float(len({words[k] for k, _ in hits})), max((w for _, w in hits), default=0.0), sum(w for _, w in hits) / (len(hits) or 1), near / per,
                len(you) / per, sum(x[2] for _, x in marked) / per, sum(x[3] for _, x in marked) / per, share(_UPPER),
                sum(x[5] for _, x in marked) / per, share(_PUNCTUATION), share(_SHOUT), share(_SIGNS), share(_DIGIT), densest / (min(n, WINDOW_WORDS) or 1),
            ]

        return read


def learn_lexicon(labelled: DataFrame, least_contexts: int = 3, least_ratio: float = 2.0) -> Lexicon:
    """The lexicon of ``labelled(text, label)``, a bounded sample.

    A term must follow at least ``least_contexts`` different words in toxic texts, so that copies
    of one text don't make its words toxic. All such terms are counted in all sampled texts, by text, and kept if
    their log ratio of toxic to other texts is ``least_ratio`` at least. Only the sample's size bounds the lexicon.
    """

    def contexts():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = set()
            for text in batch.column(0).to_pylist():
                before = ""
                for w in map(plain, text.split()):
                    pairs.update((t, before) for t in terms(w))
                    before = w
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], names=["term", "before"])

        return step

    found = map_batches(labelled.filter("label = 1").select("text"), contexts, "term string, before string")
    seen = found.distinct().groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least_contexts)
    candidates = frozenset(r["term"] for r in seen.select("term").collect())
    held = labelled.sparkSession.sparkContext.broadcast(candidates)

    def counts():
        wanted = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both[label].update({t for w in set(map(plain, text.split())) for t in terms(w) if t in wanted} | {""})
            keys = sorted(set(both[0]) | set(both[1]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([both[k][t] for t in keys], pa.int64()) for k in (1, 0))], names=["term", "toxic", "other"])

        return step

    df = {r["term"]: (r["toxic"], r["other"]) for r in map_batches(labelled.select("text", "label"), counts, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect()}
    toxic, other = df.pop("", (0, 0))
    weight = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1)) for t, (a, b) in df.items()}
    return Lexicon({t: w for t, w in sorted(weight.items()) if w >= least_ratio})


def sample_labels(labels: DataFrame, most_rows: int) -> DataFrame:
    """``(doc_id, label)``: one row per labelled document, a hash sample of about ``most_rows`` where there are more.

    Documents with contradictory labels count as toxic; null ids and labels are left out.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    share = min(1.0, most_rows / max(1, one.count()))
    return one.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


@dataclass
class Model:
    """A fitted scorer; with no trees, for want of two classes in the labels, every score is ``prior``."""

    lexicon: Lexicon
    prior: float
    trees: object = None
    curve: object = None

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with ``name``: 0 to 1, higher for texts more likely toxic. Other columns pass through, but for one of that name, which is replaced.

        Null and empty texts have features of zero and a score like any other. Whole texts are read.
        """
        docs = docs.drop(name)
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.prior))
        # The documents' columns stand in one struct, so that none clashes with a column made on the way.
        read = with_features(docs, self.lexicon)
        out = self.trees.transform(read.withColumn("_vector", array_to_vector("_features")))
        out = self.curve.transform(out.withColumn("_margin", vector_to_array("_raw")[1]).withColumn("_odds", vector_to_array("_p")[1]))
        # The curve is flat in places; a hundredth of the trees' own probability orders the texts there.
        fitted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("_fitted") + 0.01 * F.col("_odds")))
        return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns), fitted.alias(name))


def with_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``_row``, a struct of the columns of ``docs``, and ``_features``, in the order of ``FEATURES``."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_features", T.ArrayType(T.DoubleType()))])

    def make():
        read = held.value.reader()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [read(t or "") for t in batch.column(0).field("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["_row", "_features"])

        return step

    return map_batches(rows, make, schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most_rows: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7) -> Model:
    """Fit on at most about ``most_rows`` labelled documents for which ``usable`` holds.

    The sample, whose size that parameter bounds, is broadcast to find its texts. Three quarters of
    it, by a hash of the text so that copies stay together, grow the trees and the rest calibrates.
    """
    wanted = sample_labels(labels if usable is None else labels.filter(usable), most_rows)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id").select("text", "label")
    labelled = materialize(joined)
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    if not n.get(0) or not n.get(1):
        return Model(Lexicon({}), prior)
    lexicon = learn_lexicon(labelled)
    rows = with_features(labelled, lexicon).select(
        array_to_vector("_features").alias("_vector"), F.col("_row.label").cast("double").alias("label"), F.pmod(F.xxhash64("_row.text"), F.lit(4)).alias("part")
    )
    # The sample's features are a few megabytes, whatever the input: a handful of partitions keeps the many fitting stages small.
    rows = materialize(rows.select(vector_to_array("_vector").alias("f"), "label", "part")).select(array_to_vector("f").alias("_vector"), "label", "part").coalesce(6)
    if rows.filter("part > 0").select("label").distinct().count() < 2:
        return Model(lexicon, prior)
    grown = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_class", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    grown = grown.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(rows.filter("part > 0"))
    held_back = rows.filter("part = 0") if not rows.filter("part = 0").isEmpty() else rows
    margins = grown.transform(held_back).select("label", vector_to_array("_raw")[1].alias("_margin"))
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_fitted").fit(margins)
    return Model(lexicon, prior, grown, curve)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; the model is fitted on all labels of these documents.

    All columns stay, one named ``score`` too. Repeated rows are judged alike; an empty table gives none; without labels
    of both classes nothing is learned, and the rate of toxic labels, zero without any, is each score.
    """
    name = free_name(docs.columns, "_score")
    return fit(docs, labels).score(docs, name).filter(F.col(name) < threshold).drop(name)
