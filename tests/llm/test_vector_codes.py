import hashlib

import numpy as np
import pytest

from motionlake.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code int, q string"


def brute(rows, parts=4, entries=256, rounds=4):
    """``{(vec_id, vector): (code, error, label error, sha)}`` by plain distances to all entries."""
    kept = sorted(((i, v, n) for i, v, n in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([np.float32(v) for _, v, _ in kept], dtype=np.float64) * 1024).astype(np.int64)
    x = x.reshape(len(kept), parts, -1)
    books = x[:entries].copy()

    def near(p):
        d = ((x[:, p, None, :] - books[None, :, p, :]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        old = [near(p)[0] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books)):
                if (own := x[old[p] == e, p]).size:
                    books[e, p] = own.sum(0) // len(own)
    found = [near(p) for p in range(parts)]
    error = sum(e for _, e in found)
    sha = hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    sums = {}
    for (_, _, n), e in zip(kept, error):
        sums[n] = sums.get(n, 0) + int(e)
    return sorted(((i, "".join(f"{f[0][k]:02x}" for f in found), int(error[k]), sums[n], sha) for k, (i, _, n) in enumerate(kept)), key=repr)


def result(df):
    return sorted(((r.vec_id, r["code"], r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, 9, "own") for i, v, n in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n, width, step", [(700, 16, None), (300, 8, 0.25), (40, 8, None), (1, 4, None)])
def test_against_all_distances(spark, n, width, step):
    """Coarse components make ties between entries common; few rows make small codebooks."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width)) * rng.uniform(0.1, 2, width)
    x = (np.round(x / step) * step if step else x).astype(np.float32)
    rows = [(int(i), x[k].tolist(), int(i) % 3 if i % 5 else None) for k, i in enumerate(rng.permutation(n))]
    assert result(V.compress(frame(spark, rows))) == brute(rows)


def test_nearest_keeps_ties_at_the_lowest_index():
    rng = np.random.default_rng(1)
    for _ in range(30):
        book, x = rng.integers(-3, 4, (rng.integers(1, 200), 5)), rng.integers(-3, 4, (50, 5))
        d = ((x[:, None] - book[None]) ** 2).sum(-1)
        index, best = V.nearest(x, book)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_odd_rows(spark):
    one, hot = [0.5, -0.25, 0.125, 1.0], [0.1, 0.2, 0.3, 0.4]
    rows = [(1, None, 1), (2, [0.1, None, 0.3, 0.4], 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [0.0, float("inf"), 0.0, 0.0], 2), (5, one, None), (5, one, None), (None, one, 1), (6, [-0.001, 0.0, 7.5, -9.0], 2)]
    rows += [(k, hot, 3) for k in range(100, 400)]
    got = V.compress(frame(spark, rows))
    assert got.columns == ["vec_id", "label", "q", "code", "error", "label_error", "codebooks_sha256"]
    assert result(got) == brute(rows)
    empty = V.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == got.columns
    assert V.compress(frame(spark, rows[:4])).count() == 0
    for bad in ([(1, one, 1), (2, one * 2, 1)], [(1, one[:3], 1)], [(1, [1e9] * 4, 1)], [(1, [], 1)]):
        with pytest.raises(ValueError, match="vectors"):
            V.compress(frame(spark, bad))


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_LABELS", 1)
    rows = [(k, [k / 50, 0.0, -k / 9, 1.0], k % 4 if k % 3 else None) for k in range(60)]
    assert result(V.compress(frame(spark, rows))) == brute(rows)
