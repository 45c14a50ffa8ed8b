"""A log-bilinear language model, trained by noise-contrastive estimation, that scores whole texts.

The model predicts each token from the two before it over a closed set of symbols: the end mark, the
most frequent words, and classes of all other words by their endings. A word of a class has, besides,
its smoothed share of the class. So the model gives every text a normalised probability, unseen words
included: each class has one type for all of them.

Counts are taken over all training texts and kept as a table; frequent words are broadcast up to
a fixed number, and rarer ones are joined. Training goes once through all training texts: tasks start
from the same parameters, and their results are averaged by row, weighted by their tokens.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import bounded_batches, materialize, texts_of

END = b"\n"
#: Words broadcast with their counts at most; the counts of all others are joined.
HEAD_WORDS = 200_000
DIMENSION, NOISE, BATCH, RATE, SEED = 24, 32, 2048, 0.07, 11
#: Distinct words counted, tokens trained on, and tokens scored at once in a task.
COUNT_ROUND, TRAIN_ROUND, SCORE_ROUND = 400_000, 2_000_000, 500_000


def symbols_for(tokens: int, least: int = 255, most: int = 8191) -> int:
    """How many words have vectors of their own: 2.2 times the cube root of the training tokens.

    A normaliser is a sum over all symbols for each pair of symbols before, so the normalisers' work is the cube of the
    symbols, and with this rule it is in proportion to the tokens. ``most`` bounds the table of normalisers, whose
    size is the square of the symbols, at 268 MB.
    """
    return max(least, min(round(2.2 * tokens ** (1 / 3)), most))


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def tokenize(text: bytes) -> list[bytes]:
    """Words in lower-case A-Z, then one end."""
    words = text.lower().split()
    words.append(END)
    return words


def count_words(texts: DataFrame, classes: int) -> DataFrame:
    """``(word, cls, c)`` of all tokens of ``texts(text)``; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array([word_class(w, classes) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "cls", "c"])

        for batch in batches:
            for text in texts_of(batch):
                held.update(tokenize(text))
                if len(held) > COUNT_ROUND:
                    yield out()
        if held:
            yield out()

    return bounded_batches(texts.select("text")).mapInArrow(run, "word string, cls int, c bigint").groupBy("word", "cls").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Symbols and counts; ``head`` has a place for each broadcast word, symbols come first."""

    tokens: int
    types: int
    head: dict[bytes, int]
    head_counts: np.ndarray
    n_words: int
    class_counts: np.ndarray
    class_types: np.ndarray
    #: Symbol of each place of the head.
    symbols: np.ndarray = field(init=False)

    def __post_init__(self):
        self.symbols = np.array([i if i < self.n_words else self.n_words + self.class_of(w) for w, i in self.head.items()], np.int32)

    @property
    def size(self) -> int:
        return self.n_words + len(self.class_counts)

    def class_of(self, word: bytes) -> int:
        return word_class(word, len(self.class_counts))

    def unigram(self) -> np.ndarray:
        c = np.concatenate([self.head_counts[: self.n_words], self.class_counts]) + 0.5
        return c / c.sum()

    def symbol(self, word: bytes) -> int:
        i = self.head.get(word, -1)
        return i if 0 <= i < self.n_words else self.n_words + self.class_of(word)


def vocabulary(counts: DataFrame, classes: int, words_for: Callable[[int], int] = symbols_for) -> Vocabulary:
    """The vocabulary of a count table; at most ``HEAD_WORDS`` words and a row per class reach the driver."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 4)
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = None, 0
    for value, n in sizes:
        held += n
        if held > HEAD_WORDS:
            break
        least = value
    rows = [] if least is None else counts.filter(level >= least).select("word", "c").collect()
    words = dict(sorted(((r["word"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0])))
    if (end := words.pop(END, None)) is None:
        end = next((r["c"] for r in counts.filter(F.col("word") == END.decode()).select("c").collect()), 0)
    words = {END: end, **words}
    n_words = min(len(words), words_for(totals[0]) + 1)
    sums, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        sums[r["cls"]], types[r["cls"]] = r["c"], r["n"]
    for w, c in list(words.items())[:n_words]:
        if c:
            sums[word_class(w, classes)] -= c
            types[word_class(w, classes)] -= 1
    return Vocabulary(totals[0], totals[1], {w: i for i, w in enumerate(words)}, np.array(list(words.values()), np.int64), n_words, sums, types)


@dataclass
class Parameters:
    """Vectors of the word before, of the one before that, and of the word predicted; its bias."""

    one: np.ndarray
    two: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> Parameters:
        rng = np.random.default_rng(SEED)
        a, b, c = (rng.normal(0, 0.1, (len(unigram), DIMENSION)).astype(np.float32) for _ in range(3))
        return cls(a, b, c, np.log(unigram).astype(np.float32))

    def rows(self) -> np.ndarray:
        """All parameters, one row per vector; the biases fill up rows at the end."""
        pad = -len(self.bias) % DIMENSION
        return np.concatenate([self.one, self.two, self.out, np.pad(self.bias, (0, pad)).reshape(-1, DIMENSION)])

    @classmethod
    def of(cls, rows: np.ndarray, size: int) -> Parameters:
        rows = rows.astype(np.float32)
        return cls(*(rows[k * size : (k + 1) * size].copy() for k in range(3)), rows[3 * size :].ravel()[:size].copy())

    def normalizers(self, two: np.ndarray) -> np.ndarray:
        """For each symbol in ``two`` and each symbol after it, the log of the sum over all predictions."""
        out = np.empty((len(two), len(self.bias)), np.float32)
        for i, t in enumerate(two):
            scores = (self.one + self.two[t]) @ self.out.T + self.bias
            top = scores.max(axis=1)
            out[i] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out


def _rows_sum(into: np.ndarray, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values added up by index; returns the indices touched."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    into[index[first]] += np.add.reduceat(values[order], first, axis=0)
    return index[first]


def train(p: Parameters, triples: np.ndarray, weight: np.ndarray, unigram: np.ndarray, squares: list[np.ndarray], rng: np.random.Generator) -> None:
    """One pass of noise-contrastive estimation over distinct ``(two before, one before, word)`` rows with their counts."""
    log_noise, cumulated = np.log(NOISE * unigram).astype(np.float32), np.cumsum(unigram)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    order = rng.permutation(len(triples))
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        two, one, w = triples[rows].T
        k = weight[rows].astype(np.float32)
        k /= k.sum()
        noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE)), len(unigram) - 1)
        q = p.one[one] + p.two[two]
        target = p.out[w]
        data = k * (1 - sigmoid(np.einsum("bd,bd->b", q, target) + p.bias[w] - log_noise[w]))
        wrong = k[:, None] * sigmoid(q @ p.out[noise].T + p.bias[noise] - log_noise[noise])
        to_q = data[:, None] * target - wrong @ p.out[noise]
        grads = [np.zeros_like(x) for x in (p.one, p.two, p.out, p.bias)]
        _rows_sum(grads[0], one, to_q)
        _rows_sum(grads[1], two, to_q)
        _rows_sum(grads[2], w, data[:, None] * q)
        _rows_sum(grads[3], w, data)
        np.add.at(grads[2], noise, -(wrong.T @ q))
        np.add.at(grads[3], noise, -wrong.sum(axis=0))
        for x, g, s in zip((p.one, p.two, p.out, p.bias), grads, squares):
            s += g * g
            x += RATE * g / (np.sqrt(s) + 1e-5)


def train_round(texts: DataFrame, vocab: Vocabulary, start: Parameters) -> Parameters:
    """Parameters after one pass over ``texts(text)``; only sums of parameter rows are shuffled."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((vocab, start))
    names = [f"v{j}" for j in range(DIMENSION)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = held.value
        p = Parameters(*(x.copy() for x in (p.one, p.two, p.out, p.bias)))
        unigram, rng = vocab.unigram(), np.random.default_rng(SEED)
        squares = [np.full_like(x, 1e-6) for x in (p.one, p.two, p.out, p.bias)]
        base = np.int64(vocab.size)
        cache: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        total = pending = 0

        def step() -> None:
            w = np.concatenate(ids)
            one = np.concatenate([[0], w[:-1]])
            two = np.concatenate([[0], one[:-1]])
            # An end is symbol 0 and stands for what is before a text as well.
            two = np.where(one == 0, 0, two)
            code, n = np.unique((two * base + one) * base + w, return_counts=True)
            triples = np.stack([code // (base * base), code // base % base, code % base], axis=1)
            train(p, triples, n, unigram, squares, rng)
            ids.clear()

        for batch in batches:
            for text in texts_of(batch):
                words = tokenize(text)
                found = list(map(cache.get, words))
                if None in found:
                    if len(cache) > COUNT_ROUND:
                        cache.clear()
                    for i, x in enumerate(found):
                        if x is None:
                            found[i] = cache[words[i]] = vocab.symbol(words[i])
                ids.append(np.array(found, np.int64))
                pending += len(found)
                if pending >= TRAIN_ROUND:
                    total += pending
                    pending = 0
                    step()
        if pending:
            total += pending
            step()
        if total:
            rows = p.rows().astype(np.float64) * total
            columns = [pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), float(total))), *map(pa.array, np.ascontiguousarray(rows.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *names])

    parts = bounded_batches(texts.select("text")).mapInArrow(run, "row bigint, n double, " + ", ".join(f"{x} double" for x in names))
    rows = parts.groupBy("row").agg(*((F.sum(x) / F.sum("n")).alias(x) for x in names)).orderBy("row").collect()
    return Parameters.of(np.array([r[1:] for r in rows]), vocab.size) if rows else start


@dataclass
class Model:
    vocab: Vocabulary
    counts: DataFrame
    parameters: Parameters

    def score(self, docs: DataFrame) -> DataFrame:
        """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

        ``base_score`` is the smoothed unigram log10 probability and ``score`` the model's. A null or
        empty text is one end. Repeated rows and null ids each give a row, an empty table none; other
        columns don't matter. Frequent words are looked up in the task; the others of a text, each
        once with its occurrences, are joined with their counts and added up by document.
        """
        v = self.vocab
        spark = docs.sparkSession
        symbols = spark.range(v.size).repartition(max(1, min(v.size, spark.sparkContext.defaultParallelism * 4)), "id")
        held_parameters = spark.sparkContext.broadcast(self.parameters)

        def normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                two = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in held_parameters.value.normalizers(two)], pa.binary())], names=["id", "z"])

        z = np.stack([np.frombuffer(r["z"], np.float32) for r in symbols.mapInArrow(normalize, "id bigint, z binary").orderBy("id").collect()])
        base_total = v.tokens + 0.5 * (v.types + 1)
        in_class = np.log10(v.class_counts + 0.5 * (v.class_types + 1))
        held = spark.sparkContext.broadcast((v, z))
        fields = "word string, rid bigint, doc_id bigint, n bigint, cls int, n_tokens bigint, n_known bigint, base double, model double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, z = held.value
            p = held_parameters.value
            one, two = p.one @ p.out.T, p.two @ p.out.T
            base = np.log10(v.head_counts + 0.5) - math.log10(base_total)
            inner = np.where(np.arange(len(v.symbols)) < v.n_words, 0.0, np.log10(v.head_counts + 0.5) - in_class[np.maximum(v.symbols - v.n_words, 0)])
            known = v.head_counts > 0

            def step(rids: list[int], docs: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                ends = np.cumsum(sizes)
                flat = list(chain.from_iterable(texts))
                place = np.fromiter(map(v.head.get, flat, repeat(-1)), np.int64, len(flat))
                rare = np.flatnonzero(place < 0)
                symbol = v.symbols[place]
                tail: dict[tuple[int, bytes], int] = Counter(zip(np.searchsorted(ends, rare, side="right").tolist(), (flat[i] for i in rare.tolist())))
                classes = {w: v.class_of(w) for _, w in tail}
                symbol[rare] = np.fromiter((v.n_words + classes[flat[i]] for i in rare.tolist()), np.int32, len(rare))
                before = np.concatenate([[0], symbol[:-1]])
                before[ends[:-1]] = 0
                earlier = np.concatenate([[0], before[:-1]])
                earlier[before == 0] = 0
                logp = (one[before, symbol] + two[earlier, symbol] + p.bias[symbol] - z[earlier, before]).astype(np.float64) / math.log(10)
                logp += np.where(place >= 0, inner[place], 0.0)
                starts = ends - sizes
                total = lambda x: np.add.reduceat(x, starts)
                doc_rows = len(texts)
                words = [f" {r}".encode() for r in rids] + [w for _, w in tail]
                owner = rids + [rids[d] for d, _ in tail]
                none = [None] * len(tail)
                columns = [
                    pa.array(words, pa.binary()).cast(pa.string()), pa.array(owner, pa.int64()), pa.array(docs + none, pa.int64()),
                    pa.array([0] * doc_rows + list(tail.values()), pa.int64()), pa.array([0] * doc_rows + [classes[w] for _, w in tail], pa.int32()),
                    pa.array(sizes.tolist() + none, pa.int64()), pa.array(total(np.where(place >= 0, known[place], False).astype(np.int64)).tolist() + none, pa.int64()),
                    pa.array(total(np.where(place >= 0, base[place], 0.0)).tolist() + none, pa.float64()), pa.array(total(logp).tolist() + none, pa.float64()),
                ]
                return pa.RecordBatch.from_arrays(columns, names=["word", "rid", "doc_id", "n", "cls", "n_tokens", "n_known", "base", "model"])

            for batch in batches:
                rids, ids, texts, size = [], [], [], 0
                for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch)):
                    rids.append(rid)
                    ids.append(doc)
                    texts.append(tokenize(text))
                    size += len(texts[-1])
                    if size > SCORE_ROUND:
                        yield step(rids, ids, texts)
                        rids, ids, texts, size = [], [], [], 0
                if texts:
                    yield step(rids, ids, texts)

        texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint"), "text")
        read = bounded_batches(texts).mapInArrow(run, fields)
        both = read.join(self.counts.select("word", "c"), "word", "left")
        share = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
        of_class = F.element_at(F.array(*map(F.lit, in_class.tolist())), F.col("cls") + 1)
        parts = both.select(
            "rid", "doc_id", "n_tokens",
            F.coalesce("n_known", F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.coalesce("base", F.col("n") * (share - F.lit(math.log10(base_total)))).alias("base"),
            F.coalesce("model", F.col("n") * (share - of_class)).alias("model"),
        )
        out = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"))
        return out.select("doc_id", "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def fit(docs: DataFrame, usable: Column | None = None, classes: int = 128, words_for: Callable[[int], int] = symbols_for, warm_up: float = 0.1) -> Model:
    """Count and train on all rows of ``docs(doc_id, text)`` for which ``usable`` holds.

    ``words_for`` gives the number of words with vectors of their own from that of the training tokens; all others share
    ``classes`` by their endings. A pass over a hash sample of ``warm_up`` of the texts prepares the parameters, and one over
    all texts trains them. Each task begins from the same parameters and the results are averaged, so the scores
    depend on how the texts are split over tasks: the same input in the same splits gives the same scores.
    """
    texts = docs if usable is None else docs.filter(usable)
    counts = materialize(count_words(texts, classes))
    vocab = vocabulary(counts, classes, words_for)
    parameters = Parameters.start(vocab.unigram())
    warm = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit("warm-up")), F.lit(1000)) < F.lit(int(1000 * warm_up)))
    for part in (warm, texts):
        parameters = train_round(part, vocab, parameters)
    return Model(vocab, counts, parameters)
