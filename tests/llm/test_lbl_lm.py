import math
from collections import Counter

import numpy as np
import pytest

from motionlake.llm import lbl_lm as L
from motionlake.llm.common import fold
from motionlake.llm.queries import op10_log_bilinear


def brute(rows):
    train = [L.tokenize((t or "").encode()) for d, t in rows if fold(d, 5) != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        words = L.tokenize((t or "").encode())
        out.append((d, fold(d, 5) == 1, len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return out


@pytest.mark.parametrize("head", [200_000, 300])
def test_query_base_and_model(spark, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD_WORDS", head)
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op10_log_bilinear(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, held, n, known, train, base in brute(rows):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_the_next_token_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (i % 5) + f"rare{i}") for i in range(40)], "doc_id long, text string")
    model = L.fit(docs)
    v, p = model.vocab, model.parameters
    z = p.normalizers(np.arange(v.size))
    total = 0.0
    for w, i in v.head.items():
        s = v.symbols[i]
        inner = 1.0 if i < v.n_words else (v.head_counts[i] + 0.5) / (v.class_counts[s - v.n_words] + 0.5 * (v.class_types[s - v.n_words] + 1))
        total += inner * math.exp(float(p.one[0] @ p.out[s] + p.two[0] @ p.out[s] + p.bias[s] - z[0, 0]))
    for k in range(len(v.class_counts)):
        s = v.n_words + k
        total += 0.5 / (v.class_counts[k] + 0.5 * (v.class_types[k] + 1)) * math.exp(float(p.one[0] @ p.out[s] + p.two[0] @ p.out[s] + p.bias[s] - z[0, 0]))
    assert abs(total - 1) < 1e-3


def test_odd_documents_and_no_training_text(spark, odd_docs, odd_rows, no_docs):
    model = L.fit(odd_docs)
    out = model.score(odd_docs).collect()
    assert len(out) == len(odd_rows) and all(r.score < 0 and r.base_score < 0 for r in out)
    assert sum(r.n_tokens for r in out) == sum(len(L.tokenize((t or "").encode())) for _, t in odd_rows)
    assert model.score(no_docs).count() == 0
    empty = L.fit(no_docs).score(odd_docs.select("doc_id", "text")).collect()
    assert len(empty) == len(odd_rows) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in empty)
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert L.fit(one).score(one).first().n_tokens == 1


def test_contrastive_estimation_learns_a_bigram():
    vocab_size = 6
    rng = np.random.default_rng(0)
    w = np.zeros(40_000, np.int64)
    for i in range(1, len(w)):
        w[i] = (w[i - 1] + 1) % vocab_size if rng.random() < 0.9 else rng.integers(vocab_size)
    unigram = np.bincount(w, minlength=vocab_size) / len(w)
    p = L.Parameters.start(unigram)
    triples = np.stack([w[:-2], w[1:-1], w[2:]], axis=1)
    squares = [np.full_like(x, 1e-6) for x in (p.one, p.two, p.out, p.bias)]
    for _ in range(8):
        L.train(p, triples, np.ones(len(triples)), unigram, squares, rng)
    z = p.normalizers(np.arange(vocab_size))
    two, one, out = triples.T
    logp = (p.one[one] * p.out[out]).sum(1) + (p.two[two] * p.out[out]).sum(1) + p.bias[out] - z[two, one]
    assert logp.mean() > np.log(unigram[out]).mean() + 0.7


def test_score_is_the_normalised_model_of_every_token(spark, odd_docs, odd_rows):
    """Each token's probability from the parameters, by its definition: a softmax over all symbols, and a share of the class."""
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 100] + [(20, "A b a c d. a B\nend"), (21, "never seen words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([(i, "a b c d. a b end " * (i % 4) + f"plain rare{i}") for i in range(60)], "doc_id long, text string")
    model = L.fit(train, classes=7, words_for=lambda n: 4)
    v, p = model.vocab, model.parameters
    counts = Counter(w for r in train.collect() for w in L.tokenize(r.text.encode()))
    assert v.n_words == 5 and v.size == 12

    def logp(text):
        total, two, one = 0.0, 0, 0
        for w in L.tokenize((text or "").encode()):
            scores = (p.one[one] + p.two[two]).astype(float) @ p.out.T.astype(float) + p.bias
            s = v.symbol(w)
            total += (scores[s] - np.logaddexp.reduce(scores)) / math.log(10)
            if s >= v.n_words:
                k = s - v.n_words
                rest = {x: c for x, c in counts.items() if v.symbol(x) == s}
                assert (v.class_counts[k], v.class_types[k]) == (sum(rest.values()), len(rest))
                total += math.log10((counts[w] + 0.5) / (sum(rest.values()) + 0.5 * (len(rest) + 1)))
            two, one = (0 if s == 0 else one), s
        return total

    got = sorted((r.score, r.n_tokens) for r in model.score(docs).collect())
    want = sorted((logp(t), len(L.tokenize((t or "").encode()))) for _, t in rows)
    assert all(abs(a - b) < 1e-4 * (1 + abs(b)) and m == n for (a, m), (b, n) in zip(got, want)) and len(got) == len(want)


def test_symbols_grow_with_the_tokens():
    assert [L.symbols_for(n) for n in (0, 10**6, 10**8, 10**9, 10**14)] == [255, 255, 1021, 2200, 8191]
