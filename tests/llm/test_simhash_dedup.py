import numpy as np
import pytest
import xxhash

from motionlake.llm import simhash_dedup as S


def brute(texts):
    out = []
    for t in texts:
        w = [x for x in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def groups(ids, fps, radius=4):
    comp = list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    roots = [find(i) for i in range(len(ids))]
    return [min((ids[j] for j in range(len(ids)) if roots[j] == roots[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_bit_slices_give_exact_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(9) for _ in range(20)])
    near = S.within(fp, slice(5, 100), 4)
    want = np.array([[int(a ^ b).bit_count() <= 4 for b in map(int, fp)] for a in map(int, fp[5:100])])
    assert (near == want).all()


@pytest.mark.parametrize("chunk", [2048, 3])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK_ROWS", chunk)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows]
    for i, t in ((3, rows[3][1]), (7, rows[7][1]), (9, rows[9][1])):
        w = t.split(" ")
        rows += [(1000 + i * 50 + k, " ".join([*w[:k], "odd", *w[k + 1 :]])) for k in range(min(12, len(w)))]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (None, rows[0][1]), rows[1], rows[1], (5005, "a b c Éd e f")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fp2", S.F.lit(1)).repartition(5)).collect()
    fps = brute([t for _, t in rows])
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], groups([r[0] for r in rows], fps)), key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_widen_with_the_number_of_fingerprints():
    assert [len(S.key_masks(n, 4)) for n in (10, 10**9, 10**11)] == [15, 35, 70]
    rng = np.random.default_rng(2)
    for n in (10, 10**9, 10**11):
        masks = S.key_masks(n, 4)
        for _ in range(200):
            change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(change & m % (1 << 64) == 0 for m in masks)


@pytest.mark.parametrize("more", [10, 10**9])
def test_wide_keys_find_the_same(spark, monkeypatch, more):
    rng = np.random.default_rng(3)
    fp = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    fp += [f ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for f in fp for k in (3, 4, 5)]
    masks = S.key_masks(more, 4)
    monkeypatch.setattr(S, "key_masks", lambda n, radius: masks)
    links = [(r.u, r.v) for r in S.near_links(spark.createDataFrame([(f,) for f in fp], "_fp long")).collect()]
    root = {f: f for f in fp}
    for _ in fp:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    by = dict(zip(fp, groups(fp, fp)))
    assert len(set(by.values())) >= 20 and root == by


def test_width_is_used(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    prints = {S.near_duplicates(docs, width=w).first().fingerprint for w in (2, 4, 5)}
    assert prints == {f"{S.simhash(b'a b c d e f g h i', w):016x}" for w in (2, 4, 5)} and len(prints) == 3


def test_one_row_stays_of_linked_classes_without_ids(spark):
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:75], "odd", *words[76:]])]
    assert 0 < (S.simhash(texts[0].encode()) ^ S.simhash(texts[1].encode())).bit_count() <= 4
    docs = spark.createDataFrame([(None, t, 7, "x") for t in texts], "doc_id long, text string, _row int, _hash string")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 1 and kept.first()._row == 7
