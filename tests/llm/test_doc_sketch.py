import hashlib
import random
import re

from pyspark.sql import functions as F

from motionlake.llm import doc_sketch as D
from motionlake.llm.queries import op12_document_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sketches(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.s for r in df.select("i", D.sketch(F.col("text"), **how).alias("s")).orderBy("i").collect()]


def hashes(spark, text):
    """A shingle's hash as Spark computes it from words, one shingle a row."""
    rows = [tuple(s) for s in shingles(text)]
    df = spark.createDataFrame([(list(s),) for s in rows], "w array<string>")
    return {r.h for r in df.select(F.xxhash64(*(F.xxhash64(F.get("w", F.lit(k))) if len(rows[0]) > k else F.lit(None).cast("long") for k in range(5))).alias("h")).collect()}


def test_sketch_holds_the_low_hashes_only(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (1, 3, 5, 6, 40, 900)]
    for scale in (1, 2, 8):
        for text, got in zip(texts, sketches(spark, texts, scale=scale)):
            all_ = hashes(spark, text)
            low = {h for h in all_ if (h + (1 << 63)) * scale < 1 << 64}
            assert got == sorted(low or {min(all_)})


def edited(rows):
    """``(id, edited text, shingles of text, edited and next)`` in order, by plain Python."""
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    for k, (i, t) in enumerate(rows):
        following, m = rows[(k + 1) % len(rows)][1], len(t) // 4
        yield i, t[: len(t) - m] + following[:m], shingles(t), shingles(t[: len(t) - m] + following[:m]), shingles(following)


def likeness(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)


def test_edited_texts_of_odd_rows(spark, odd_rows):
    """With a scale of one a sketch holds every shingle, so likeness is exact."""
    rows = [r for r in odd_rows]
    docs = spark.createDataFrame([(i, t, 3, "own", 1) for i, t in rows], "doc_id long, text string, n_chars int, sketch string, hash int").repartition(3)
    got = D.edited_pairs(docs, scale=1).collect()
    want = {i: (hashlib.sha256(e.encode()).hexdigest(), likeness(a, b), likeness(a, n)) for i, e, a, b, n in edited(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id], r.doc_id
        assert r.n_chars == next(len(t or "") for i, t in rows if i == r.doc_id)
    for few in ([], [(1, "one text, alone with its few words")], [(None, None)]):
        out = D.edited_pairs(spark.createDataFrame(few, "doc_id long, text string")).collect()
        assert len(out) == len(few) and all(r.near_next == 1.0 for r in out)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op12_document_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text, off = {}, []
    for i, e, a, b, n in edited(docs):
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and 0 <= r.near_next <= 1
        off.append(r.near_edited - likeness(a, b))
        if len(a) > 200:
            assert abs(off[-1]) < 0.3 and abs(r.near_next - likeness(a, n)) < 0.2
        by_text.setdefault(dict(docs)[i], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and abs(sum(off) / len(off)) < 0.05


def test_merging_and_unequal_texts(spark):
    rng = random.Random(6)
    parts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(2000)) for _ in range(3)]
    a, b, c = sketches(spark, parts)
    df = spark.createDataFrame([(1, a), (1, b), (1, b)], "k int, s array<long>")
    assert df.agg(D.merge(F.col("s")).alias("m")).first().m == sorted({*a, *b})
    near = lambda x, y: spark.range(1).select(D.containment(F.lit(x), F.lit(y)).alias("v")).first().v
    piece = sketches(spark, [" ".join(parts[0].split()[:300])])[0]
    assert near(piece, a) == near(a, piece) == 1.0 and near(piece, c) == 0.0
