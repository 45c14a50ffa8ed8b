import random

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline as P
from motionlake.llm import near_copies as N
from motionlake.llm.common import table


def brute(rows, width=5, threshold=0.8):
    """Ids that stay: the smallest of each group linked by Jaccard similarity."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    s = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(s[i] & s[j])
            if s[i] == s[j] or (shared and shared >= threshold * (len(s[i]) + len(s[j]) - shared)):
                comp[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("chunk, long, deviations", [(1024, 2_000_000, 4.5), (2, 2_000_000, 4.5), (1024, 300, None)])
def test_stage_finds_every_similar_pair(spark, monkeypatch, chunk, long, deviations):
    """With four bits of 4-word fingerprints, most of the copies with several changed words stayed."""
    monkeypatch.setattr(N, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(N, "CHUNK_SHINGLES", long)
    r = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    rows, common = [], " ".join(r.choices(words, k=12))
    for i in range(25):
        text = [*r.choices(words, k=r.choice([30, 100, 250])), *common.split()]
        rows.append((100 * i, " ".join(text)))
        for k in range(1, 9):
            copy = list(text)
            for at in r.sample(range(len(copy)), k):
                copy[at] = "odd"
            rows.append((100 * i + k, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5004, common), (5005, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in N.keep_one(docs, deviations=deviations).collect()) == brute(rows)


def test_slots_grow_and_bound_counts(spark, monkeypatch):
    """Each slot pair bounds a shingle's count from above, and few slots change no result."""
    monkeypatch.setattr(N, "LEAST_SLOTS", 6)
    assert N.slots_for(0) == 64 and N.slots_for(1 << 29) == 1 << 21 and N.slots_for(1 << 60) == 1 << 24
    rows = [(k, " ".join(f"w{(k * 7 + i) % 40}" for i in range(60 + k % 5))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    levels, counts = N.shingle_counts(docs, 5), {}
    for _, t in rows:
        for h in N.shingles(t.encode(), 5).tolist():
            counts[h] = counts.get(h, 0) + 1
    a, b = N.slots_of(np.array(list(counts)), len(levels) // 2)
    assert (np.minimum(levels[a], levels[b]) >= np.floor(500 * np.log2(np.array(list(counts.values())) + 1)) - 1).all()
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == brute(rows)


def test_counts_are_sent_in_blocks(spark, monkeypatch):
    """Each split of the input sent a row for each of its slots: rows grew with slots times splits. Now a task sends a row for 65,536 slots."""
    sent, plain = [], DataFrame.mapInArrow

    def spy(self, f, schema, *a, **k):
        out = plain(self, f, schema, *a, **k)
        sent.append(out)
        return out

    monkeypatch.setattr(DataFrame, "mapInArrow", spy)
    rows = [(k, " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(300))) for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    levels = N.shingle_counts(docs, 5)
    blocks = len(levels) // N.BLOCK_SLOTS
    assert blocks == 2 and len(sent) == 1
    assert 0 < sent[0].count() <= 2 * spark.sparkContext.defaultParallelism * blocks
    counts = {}
    for _, t in rows:
        for h in N.shingles(t.encode(), 5).tolist():
            counts[h] = counts.get(h, 0) + 1
    want = np.zeros(len(levels), np.int64)
    for at in N.slots_of(np.array(list(counts)), len(levels) // 2):
        np.add.at(want, at, np.array(list(counts.values())))
    assert (levels == np.floor(500 * np.log2(want + 1))).all()


def test_stage_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(600)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == brute(rows)
