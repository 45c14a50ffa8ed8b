import random

import pytest

from pyspark.sql import functions as F

from motionlake.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, q array<long>, score double, anchor string"


def brute(rows, positives=5, negatives=3):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, q in rows:
        if i is None or i % 5:
            continue
        for score, p in sorted(((dot(q, r), k) for k, n, r in rows if n == label and k != i), key=rank)[:positives]:
            held = sorted(((s, k) for k, n, r in rows if n != label and 50 * score <= 100 * (s := dot(q, r)) <= 95 * score), key=rank)[:negatives]
            out += [(i, p, place + 1, k, score, s) for place, (s, k) in enumerate(held)]
    return sorted(out, key=repr)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1.0, "own") for r in rows], SCHEMA).repartition(3)
    out = H.mine(df, F.col("vec_id") % 5 == 0, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"row_block": 30, "anchor_block": 7, "bits": 3}, {"bits": 20}])
def test_against_all_scores(spark, how):
    """Small components make ties common, at the k-th score too; blocks and digits of any size give the same."""
    rng = random.Random(2)
    rows = [(k, rng.choice((0, 0, 1, 2)), [rng.randrange(-3, 9) for _ in range(6)]) for k in range(160)]
    assert mined(spark, rows, **how) == brute(rows)


def test_a_common_vector_and_odd_rows(spark):
    rng = random.Random(3)
    hot = [(k, k % 2, [4, 4, 4]) for k in range(1000, 1120)]
    rows = hot + [(k, rng.choice((0, 1)), [rng.randrange(5) for _ in range(3)]) for k in range(40)]
    rows += [(None, 0, [3, 3, 3]), (None, 1, [4, 4, 4]), (5, None, [1, 1, 1]), (10, 0, None), (7, 1, [2, 2, 2]), (7, 1, [2, 2, 2]), (15, 0, [0, 0, 0]), (20, 1, [-4, -1, 0]), (20, 1, [-4, -1, 0])]
    assert mined(spark, rows, row_block=50) == brute(rows)


def test_few_or_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1])]) == []
    assert mined(spark, [(5, 0, [1])]) == []
    lone = [(5, 0, [10]), (6, 0, [10]), (7, 1, [8]), (8, 1, [1])]
    assert mined(spark, lone) == brute(lone) == [(5, 6, 1, 7, 100, 80)]
    with pytest.raises(ValueError, match="vectors"):
        mined(spark, [(5, 0, [1]), (6, 0, [1, 2])])
    with pytest.raises(ValueError, match="vectors"):
        mined(spark, [(5, 0, [1 << 40])])
