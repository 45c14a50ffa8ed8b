"""Benchmark items that texts contain, by SimHash of item-sized windows and exact verification."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import bounded_batches, filesystem, shared_dir

#: The bits in which a fingerprint of 64 may differ from an item's. Both are cut into four blocks of 16 bits. Were three
#: blocks to differ in more than BLOCK_RADIUS bits each, the whole would differ in more than the radius, so the
#: fingerprints within the radius are all among those that are near in two blocks.
RADIUS, BLOCK_RADIUS, BLOCKS = 14, 4, 4
assert RADIUS < (BLOCKS - 1) * (BLOCK_RADIUS + 1)
#: Sizes of windows grow by SIZE_STEP, and windows begin at every STRIDE-th part of their size, or at every word if that is less.
SIZE_STEP, STRIDE = 1.12, 8
#: Items, and characters of them, that a task holds at once; a longer benchmark is gone through in blocks, by about GATHER_CHARS of texts at a time.
BLOCK_ITEMS, BLOCK_CHARS, GATHER_CHARS = 4096, 8 << 20, 32 << 20
#: Words whose codes a task keeps, and shingles fingerprinted at once.
CACHE_WORDS, ROUND_SHINGLES = 400_000, 16_384
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


_MARKS = re.compile(r"[\W_]+")


def normal(word: str) -> str:
    """A word without case and marks; empty if nothing is left."""
    word = word.lower()
    return word if word.isalnum() else _MARKS.sub("", word)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _ODD[0]
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word codes."""
    n = len(codes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    c, h = codes.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(width):
        h = _mix(h ^ c[k : k + n])
    return h


def _bit_sums(h: np.ndarray, most: int) -> np.ndarray:
    """Running counts of set bits before each shingle, modulo a number over ``most``, so that windows of that size are told exactly."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(h) + 1, 64), np.uint8 if most < 1 << 8 else np.uint32)
    np.cumsum(bits, axis=0, dtype=sums.dtype, out=sums[1:])
    return sums


def _fingerprints(sums: np.ndarray, n: int, stride: int = 1) -> np.ndarray:
    """SimHash of the windows of ``n`` shingles at every ``stride``-th start; repeats weigh as often as they occur."""
    ones = sums[n::stride] - sums[: len(sums) - n : stride]
    return np.packbits((ones > n // 2).reshape(-1), bitorder="little").view(np.uint64)


def window_size(n: int) -> int:
    """The size of window in which an item of ``n`` shingles is looked for: the nearest of a row that grows by ``SIZE_STEP``."""
    k = math.log(n) / math.log(SIZE_STEP)
    return min((round(SIZE_STEP ** math.floor(k)), round(SIZE_STEP ** math.ceil(k))), key=lambda m: abs(m - n))


_NEAR_ZERO = np.array([v for v in range(1 << 16) if v.bit_count() <= BLOCK_RADIUS], np.uint16)


class HammingIndex:
    """All of a set of fingerprints within ``RADIUS`` of a query, by tables over blocks of bits.

    A table has for each value of its block the set, as bits of a word, of the fingerprints whose block is near it.
    A query looks up one word in each table and keeps what stands in two of them, under 1 % of unrelated
    fingerprints; whole distances are taken of these alone.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(fps) <= n or n == 64)
        self.words = []
        for at in range(0, len(fps), 64):
            blocks = np.ascontiguousarray(fps[at : at + 64]).view(np.uint16).reshape(-1, BLOCKS)
            tables = np.zeros((BLOCKS, 1 << 16), kind)
            for i, row in enumerate(blocks):
                for b, value in enumerate(row):
                    tables[b, _NEAR_ZERO ^ value] |= kind(1 << i)
            self.words.append(tables)

    def candidates(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(queries, fingerprints)`` by number: pairs that are near in two blocks at least."""
        blocks = queries.view(np.uint16).reshape(-1, BLOCKS)
        for k, tables in enumerate(self.words):
            once = tables[0].take(blocks[:, 0])
            twice = np.zeros_like(once)
            for b in range(1, BLOCKS):
                found = tables[b].take(blocks[:, b])
                twice |= once & found
                once |= found
            q = np.flatnonzero(twice)
            if len(q):
                set_bits = np.unpackbits(np.ascontiguousarray(twice[q]).view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")
                i, j = np.nonzero(set_bits)
                yield q[i], 64 * k + j

    def near(self, queries: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(query, fingerprint, distance)`` by number: all pairs within the radius."""
        for q, i in self.candidates(queries):
            d = np.bitwise_count(queries[q] ^ self.fps[i])
            near = np.flatnonzero(d <= RADIUS)
            yield from zip(q[near].tolist(), i[near].tolist(), d[near].tolist())


class Matcher:
    """Finds the items of one block of a benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold = threshold
        #: Codes of the items' words, and of other words: no two words have the same code while they are kept.
        self.codes: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.next_code = 0
        by_size: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            words = [w for w in map(normal, text.split()) if w]
            if words:
                w = min(width, len(words))
                n = len(words) - w + 1
                by_size[w, window_size(n)].append((item_id, n, np.array([self._code(x, self.codes) for x in words], np.int64)))
        self.groups: dict[int, list] = defaultdict(list)
        for (w, m), members in sorted(by_size.items()):
            fps = [_fingerprints(_bit_sums(shingle_hashes(c, w), n), n)[0] for _, n, c in members]
            self.groups[w].append((m, max(1, m // STRIDE), HammingIndex(np.array(fps, np.uint64)), [(i, n, self._shingles(c, w)) for i, n, c in members]))

    def _code(self, word: str, into: dict[str, int]) -> int:
        if word not in into:
            into[word] = self.next_code
            self.next_code += 1
        return into[word]

    @staticmethod
    def _shingles(codes: np.ndarray, w: int) -> Counter:
        c = codes.tolist()
        return Counter(zip(*(c[k:] for k in range(w))))

    def _word_codes(self, text: str) -> np.ndarray:
        """A code per word; -1 for marks alone."""
        words = text.split()
        seen = self.seen
        out = list(map(seen.get, words))
        if None in out:
            for k, c in enumerate(out):
                if c is None:
                    w = normal(words[k])
                    out[k] = seen[words[k]] = -1 if not w else self.codes[w] if w in self.codes else self._code(w, self.others)
        return np.array(out, np.int64)

    def _candidates(self, codes: np.ndarray, w: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Windows of ``codes`` within the radius of an item: ``(group, number, start, distance, stride)``."""
        groups = self.groups[w]
        longest = max(m for m, *_ in groups)
        # Words of no text follow the last, so that windows may reach over the end.
        h = shingle_hashes(np.concatenate([codes, -1 - np.arange(longest + w)]), w)
        for at in range(0, len(codes), ROUND_SHINGLES):
            sums = _bit_sums(h[at : at + ROUND_SHINGLES + longest - 1], longest)
            for g, (m, stride, index, _) in enumerate(groups):
                for s, i, d in index.near(_fingerprints(sums, m, stride)):
                    yield g, i, at + s * stride, d, stride

    def find(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """:meth:`find_all` of one text."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, int, int, float]]]:
        """``(item_id, start, words, distance, similarity)`` for each text: the best window of each item found.

        Windows of about each item's size get a fingerprint, and the Hamming index gives the items within the radius.
        Around such a window those of just the item's size are compared by the exact weighted Jaccard
        similarity of the shingles, each weighted by its occurrences, which decides. Short texts are
        gone through together; a window belongs to the text that has its middle.
        """
        out: list[list] = [[] for _ in texts]
        held, words = [], 0
        for k, text in enumerate(texts):
            if len(self.seen) > CACHE_WORDS:
                # Codes of one round must be those of the same words.
                self._round(held, out)
                held, words = [], 0
                self.seen.clear()
                self.others.clear()
            codes = self._word_codes(text)
            place = np.flatnonzero(codes >= 0)
            if len(place):
                held.append((k, place, codes[place]))
                words += len(place)
            if words >= ROUND_SHINGLES:
                self._round(held, out)
                held, words = [], 0
        self._round(held, out)
        return out

    def _round(self, held: list[tuple[int, np.ndarray, np.ndarray]], out: list[list]) -> None:
        if not held:
            return
        codes = np.concatenate([c for *_, c in held])
        ends = np.cumsum([len(c) for *_, c in held])
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for w, groups in self.groups.items():
            starts: dict[tuple[int, int, int], dict[int, int]] = defaultdict(dict)
            for g, i, s, d, stride in self._candidates(codes, w):
                m, n = groups[g][0], groups[g][3][i][1]
                t = min(int(np.searchsorted(ends, s + m // 2, side="right")), len(held) - 1)
                own, slack = s - (int(ends[t]) - len(held[t][2])), abs(n - m) + stride
                seen = starts[t, g, i]
                for k in range(max(0, own - slack), min(len(held[t][2]) - w - n + 1, own + slack) + 1):
                    seen[k] = min(d, seen.get(k, d))
            for (t, g, i), at in starts.items():
                item_id, n, shingles = groups[g][3][i]
                for s in sorted(at):
                    shared = sum((self._shingles(held[t][2][s : s + n + w - 1], w) & shingles).values())
                    similarity = shared / (2 * n - shared)
                    if similarity >= self.threshold and ((t, item_id) not in best or (-similarity, s) < (-best[t, item_id][0], best[t, item_id][1])):
                        best[t, item_id] = (similarity, s, n + w - 1, at[s])
                    if similarity == 1:
                        break
        for (t, item_id), (similarity, s, n, d) in sorted(best.items()):
            k, place, _ = held[t]
            out[k].append((item_id, int(place[s]), n, d, similarity))


def write_items(benchmark: DataFrame) -> str:
    """URI of a folder in the shared one with the benchmark's items, but for those with a null id or text."""
    uri = shared_dir(benchmark.sparkSession)
    benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null").write.parquet(uri)
    return uri


def item_blocks(uri: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items of :func:`write_items`, at most ``most`` and about ``BLOCK_CHARS`` characters at a time; one empty block if there are none."""
    fs, folder = filesystem(uri)
    held, chars = [], 0
    for info in sorted(fs.get_file_info(FileSelector(folder)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as file:
            for batch in ParquetFile(file).iter_batches(512):
                for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if len(held) == most or chars > BLOCK_CHARS:
                        yield held
                        held, chars = [], 0
                    held.append((item_id, text))
                    chars += len(text)
    yield held


class Finder:
    """:meth:`Matcher.find_all` for a whole benchmark inside a task, which holds one block of items at a time.

    The block of a benchmark that is only one is kept. Otherwise texts are gathered up to ``GATHER_CHARS``, and
    the blocks are gone through once for all of them, so that building a block's tables is small beside using them.
    """

    def __init__(self, uri: str, width: int, threshold: float, block_items: int):
        self.uri, self.width, self.threshold, self.block_items = uri, width, threshold, block_items
        blocks = item_blocks(uri, block_items)
        first = next(blocks)
        self.only = Matcher(first, width, threshold) if next(blocks, None) is None else None

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, int, int, float]]]:
        if self.only:
            return self.only.find_all(texts)
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for items in item_blocks(self.uri, self.block_items):
            for own, found in zip(best, Matcher(items, self.width, self.threshold).find_all(texts)):
                for m in found:
                    if m[0] not in own or (-m[4], m[1]) < (-own[m[0]][4], own[m[0]][1]):
                        own[m[0]] = m
        return [sorted(own.values()) for own in best]

    def over(self, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Each batch with what its texts, null ones as empty, contain."""
        held, size = [], 0
        for batch in batches:
            held.append((batch, [t or "" for t in batch.column(text).to_pylist()]))
            size += sum(map(len, held[-1][1]))
            if self.only or size >= GATHER_CHARS:
                yield from self._all(held)
                held, size = [], 0
        yield from self._all(held)

    def _all(self, held: list) -> Iterator[tuple[pa.RecordBatch, list]]:
        found = self.find_all([t for _, texts in held for t in texts]) if held else []
        at = 0
        for batch, texts in held:
            yield batch, found[at : at + len(texts)]
            at += len(texts)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row per document and item that it contains.

    ``doc_id, item_id, start_word, n_words, distance, similarity``: the best window, the first of equal
    ones. Items of fewer than ``width`` words are one shingle, so only the same words count; items
    without words, or with a null id or text, are never found. Null and empty texts contain nothing.
    Repeated documents each give their rows; other columns don't matter. Items are written to the shared folder, from which
    every task takes a block at a time; documents are read once and not shuffled, whatever the number of items.
    """
    uri = write_items(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in Finder(uri, width, threshold, block_items).over(batches, 1):
            rows = [(doc, *m) for doc, own in zip(batch.column(0).to_pylist(), found) for m in own]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])
        pa.default_memory_pool().release_unused()

    texts = bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"))
    return texts.mapInArrow(run, "doc_id bigint, item_id bigint, start_word bigint, n_words int, distance int, similarity double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the documents that contain an item, see :func:`leaks`.

    Rows with a null or empty text stay, and so do repeated rows, which are judged alike. All columns pass
    through, whatever their names; an empty table, or one of items, drops nothing.
    """
    uri, i = write_items(benchmark), docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in Finder(uri, width, threshold, block_items).over(batches, i):
            yield batch.filter(pa.array([not own for own in found], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return bounded_batches(docs).mapInArrow(run, schema)
