import math
import random

import pytest
from pyspark.sql import functions as F

from motionlake.llm import toxicity as T
from motionlake.llm.common import fold, fold_column
from motionlake.llm.queries import op1_toxicity


_WORDS = "You your 1d10t IDIOT idiots idiooot s.c.u.m scum! SCUM, scumbag loser losers waall w@11 table Chair x1 a -- 42 (vous) dich! não é «ß» ***".split()
TEXTS = [None, "", " ", "!", *(" ".join(random.Random(n).choices(_WORDS, k=n)) for n in (1, 2, 3, 7, 20, 60, 150, 400)), "calm words only, nothing else.", "scum " * 3 + "rest " * 300 + "you idiot"]


def test_held_out_texts_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    out = op1_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    hit = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    false = sum(r.predicted for r in held if not r.toxic) / sum(1 - r.toxic for r in held)
    assert hit >= 0.7 and false <= 0.05


def test_obfuscated_spelling_and_second_person():
    read = T.Lexicon({"=idiot": 3.0, "=scum": 2.0}).reader()
    value = dict(zip(T.FEATURES, read("You 1d10t! A s.c.u.m near tables")))
    assert value["hits"] == 2 and value["obfuscated_hits"] > 0 and value["near_second_person"] > 0
    assert dict(zip(T.FEATURES, read("Nothing of the kind")))["hits"] == 0
    assert read("") == [0.0] * len(T.FEATURES)
    late = dict(zip(T.FEATURES, read("word " * 500 + "idiot scum " * 5 + "word " * 500)))
    assert late["densest"] == 0.1


def plainly(text, weights):
    """The features of a text, counted word by word."""

    def bare(w):
        return w.lower().strip(".,;:!?'\"()[]{}<>|*#$%&_-=+/\\~")

    def letters(w):
        read = [dict(zip("013457@$!|", "oieastasil")).get(c, c) for c in w.lower()]
        read = [c for c in read if c.isalpha()]
        return [c for i, c in enumerate(read) if i == 0 or read[i - 1] != c]

    words, at, you, found = text.split(), [], [], []
    word = stem = masked = odd = capitals = 0
    for k, w in enumerate(words):
        p = bare(w)
        own = weights.get("=" + p, 0)
        hidden = 0
        if not own and (not p.isalpha() or any(p[i] == p[i + 1] for i in range(len(p) - 1))):
            # Of terms that read alike, the one later in the lexicon counts.
            for t, x in weights.items():
                if t[0] == "=" and letters(t[1:]) == letters(w):
                    hidden = x
            plainer = 0
            for t, x in weights.items():
                if t[0] == "=" and letters(t[1:]) == letters(p):
                    plainer = x
            hidden = max(hidden, plainer)
        begun = max([weights.get(p[:n] + "-", 0) for n in (4, 5) if len(p) > n], default=0)
        word, stem, masked = word + (own > 0 or hidden > 0), stem + (begun > 0), masked + (hidden > 0)
        odd += not p.isalpha() and any(c.isalpha() for c in p) and any(c in "013457@$!|*" for c in p)
        capitals += len(p) > 2 and p.isalpha() and w.strip(".,;:!?") == p.upper()
        if p in T.SECOND_PERSON:
            you.append(k)
        if max(own, hidden, begun):
            at.append(k)
            found.append(max(own, hidden, begun))
    n, size = len(words) or 1, len(text.encode()) or 1
    share = lambda signs: sum(c in signs for c in text) / size
    return {
        "log_words": math.log(1 + len(words)), "word_density": word / n, "stem_density": stem / n, "hits": len(at), "log_hits": math.log(1 + len(at)),
        "distinct": len({words[k] for k in at}), "most_weight": max(found, default=0), "mean_weight": sum(found) / (len(found) or 1),
        "near_second_person": sum(any(abs(k - j) <= 5 for j in you) for k in at) / n, "second_person": len(you) / n, "obfuscated_hits": masked / n,
        "obfuscated": odd / n, "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "capital_words": capitals / n, "punctuation": share(".,;:'\"()-"),
        "shouts": share("!?"), "signs": share("@#$%^&*_+=~<>|/\\[]{}"), "digits": share("0123456789"),
        "densest": max((sum(k <= j < k + 100 for j in at) for k in at), default=0) / min(n, 100),
    }


def test_features_match_a_plain_count(spark):
    weights = {"=idiot": 3.0, "=scum": 2.0, "=loser": 2.5, "=wall": 2.1, "idio-": 2.2, "losers-": 9.0, "lose-": 2.05, "scumb-": 2.4}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {r._row.doc_id: r._features for r in T.with_features(docs, T.Lexicon(weights)).collect()}
    for i, t in enumerate(TEXTS):
        want = plainly(t or "", weights)
        assert dict(zip(T.FEATURES, rows[i])) == pytest.approx(want), t


def test_lexicon_has_no_size_but_the_sample(spark):
    """Hundreds of toxic words, each after three different words, are all kept."""
    toxic = [(" ".join(f"ctx{j} vile{k:04d}x" for k in range(9000)), 1) for j in range(3)]
    weights = T.learn_lexicon(spark.createDataFrame([*toxic, *[("ctx0 ctx1 ctx2 table chair", 0)] * 20], "text string, label int"), least_ratio=1.0).weights
    assert {f"=vile{k:04d}x" for k in range(9000)} <= set(weights)


def test_odd_documents_labels_and_no_classes(spark, odd_docs, odd_rows, no_docs):
    random.seed(1)
    words = [f"word{i}" for i in range(50)]
    rows = [(100 + i, " ".join(random.choices(words, k=30)) + (" nasty vile" if i % 3 == 0 else "")) for i in range(90)]
    labelled = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1)) for i, _ in rows] + [(100, 1), (None, 1), (101, None)], "doc_id long, toxic int")
    model = T.fit(labelled, labels)
    scored = model.score(odd_docs)
    assert scored.count() == len(odd_rows) and scored.filter("score is null or score < 0 or score > 1").isEmpty()
    assert set(scored.columns) == set(odd_docs.columns)
    assert model.score(no_docs).count() == 0
    kept = T.reject(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and {r.score for r in kept.collect()} == {0.5}
    clash = odd_docs.withColumnsRenamed({"piece": "_row", "secrets": "_features", "kept": "_margin"})
    assert sorted(map(repr, T.reject(clash, labels.limit(0)).collect())) == sorted(map(repr, clash.collect()))
    out = model.score(clash, "_vector")
    assert out.columns == [*clash.columns, "_vector"] and out.filter("_vector is null").isEmpty()
    assert T.fit(labelled, labels.filter("toxic = 0")).prior == 0.0
    assert T.fit(no_docs, labels).score(odd_docs).count() == len(odd_rows)


def test_sample_is_bounded_and_fold_matches(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert 300 < T.sample_labels(labels, 500).count() < 700
    ids = spark.createDataFrame([(1,), (None,), (-5,)], "doc_id long")
    assert [r.f for r in ids.select(fold_column("doc_id", 3).alias("f")).collect()] == [fold(i, 3) for i in (1, None, -5)]
