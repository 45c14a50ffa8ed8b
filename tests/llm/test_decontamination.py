import random
from collections import Counter

import numpy as np
import pytest

from motionlake.llm import decontamination as D
from motionlake.llm.queries import op2_benchmark_decontamination


def brute(text, items, width=5, threshold=0.8):
    """Best window of each item by comparing every window of its length."""
    words = [x for x in map(D.normal, text.split()) if x]
    shingles = lambda w, k: Counter(zip(*(w[i:] for i in range(k))))
    out, all_shingles = {}, {}
    for item_id, item in items:
        b = [x for x in map(D.normal, item.split()) if x]
        k = min(width, len(b))
        if not b:
            continue
        sb = shingles(b, k)
        if sb.keys().isdisjoint(all_shingles[k] if k in all_shingles else all_shingles.setdefault(k, shingles(words, k).keys())):
            continue  # no window has a similarity above zero
        n = sum(sb.values())
        best = 0
        for s in range(len(words) - len(b) + 1):
            shared = sum((shingles(words[s : s + len(b)], k) & sb).values())
            best = max(best, shared / (2 * n - shared))
        if best >= threshold:
            out[item_id] = best
    return out


@pytest.mark.parametrize("n", [5, 40, 150])
def test_index_finds_all_within_the_radius(n):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    index = D.HammingIndex(fps)
    for _ in range(300):
        queries = [int(fps[rng.integers(n)]) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(25)]
        want = {(j, i, (f ^ q).bit_count()) for j, q in enumerate(queries) for i, f in enumerate(fps.tolist()) if (f ^ q).bit_count() <= D.RADIUS}
        assert set(index.near(np.array(queries, np.uint64))) == want


def test_index_looks_at_few_fingerprints():
    rng = np.random.default_rng(4)
    fps, queries = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, n, dtype=np.uint64) for n in (2000, 1000))
    assert sum(len(q) for q, _ in D.HammingIndex(fps).candidates(queries)) < 0.02 * 2000 * 1000


def test_similar_windows_are_found():
    random.seed(3)
    vocab, found, total = [f"w{i}" for i in range(5000)], 0, 0
    for _ in range(300):
        item = random.choices(vocab, k=random.randint(15, 59))
        changed = list(item)
        for _ in range(random.randint(0, 3)):
            changed[random.choice([0, 1, -1, -2, random.randrange(len(item))])] = "changed"
        text = " ".join([*random.choices(vocab, k=random.randint(0, 90)), *changed, *random.choices(vocab, k=random.randint(0, 90))])
        if brute(text, [(1, " ".join(item))]):
            total += 1
            found += bool(D.Matcher([(1, " ".join(item))], 5, 0.8).find(text))
    assert total > 150 and found >= 0.99 * total


def test_against_all_windows(monkeypatch):
    random.seed(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(vocab, k=n))) for i, n in enumerate([30, 45, 60, 60, 25, 3, 1, 5, 80])] + [(20, ""), (21, " .. ")]
    m = D.Matcher(items, 5, 0.8)
    for trial in range(60):
        words = random.choices(vocab, k=random.randint(0, 150))
        item = items[trial % 9][1].split()
        for _ in range(trial % 3):
            item[random.randrange(len(item))] = "changed"
        at = random.randint(0, len(words))
        text = " ".join([*words[:at], "--", *[w.upper() + "," for w in item], *words[at:]])
        got = {i: sim for i, _, _, _, sim in m.find(text)}
        want = brute(text, items)
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_odd_documents_and_items(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "plain words here"), (2, None), (None, "plain"), (3, ""), (4, "id É ñ"), (5, odd_rows[3][1][:400])]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    for most in (4096, 2):
        found = sorted((r.doc_id is None, r.doc_id, r.item_id) for r in D.leaks(odd_docs, bench, block_items=most).collect())
        assert found == [(False, 4, 5), (False, 5, 1), (False, 5, 1), (True, None, 4)]
        left = D.decontaminate(odd_docs, bench, block_items=most)
        clash = odd_docs.withColumnsRenamed({"piece": "item_id", "kept": "distance"})
        assert D.decontaminate(clash, bench).columns == clash.columns
        assert left.columns == odd_docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 7, 8]
    assert D.leaks(no_docs, bench).count() == 0 and D.leaks(odd_docs, bench.limit(0)).count() == 0


def test_one_python_node_whatever_the_number_of_items(spark):
    random.seed(7)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(random.choices(vocab, k=20))) for i in range(10_000)]
    docs = spark.createDataFrame([(k, " ".join([*random.choices(vocab, k=30), items[i][1]])) for k, i in enumerate((5, 4096, 9_999))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.leaks(docs, bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(0, 5), (1, 4096), (2, 9_999)]
    assert D.decontaminate(docs, bench).count() == 0


def test_an_item_of_two_blocks_is_found_once(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six eight")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six eight it is")], "doc_id long, text string")
    got = [(r.item_id, r.start_word, r.similarity) for r in D.leaks(docs, bench, block_items=1).collect()]
    assert got == [(1, 1, 1.0)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op2_benchmark_decontamination(spark, sf).collect()}
    normal = lambda t: " " + " ".join(x for x in map(D.normal, t.split()) if x) + " "
    planted = {(d, i) for d, t in docs for i, q in items if normal(q) in normal(t)}
    assert planted and planted <= got
    want = {(d, i) for d, t in docs for i in brute(t, items)}
    assert got <= want and len(got) >= 0.99 * len(want)
