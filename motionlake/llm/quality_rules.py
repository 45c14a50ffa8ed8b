"""Quality rules for texts, judged together by host."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import map_batches, materialize, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_NO_SYMBOL = bytes(set(range(256)) - set(b"#*$%&|<>"))
_CONTINUED = bytes(range(0x80, 0xC0))


def measure(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.translate(None, _CONTINUED)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, triple, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[triple] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[starts + k] = True
        repeated = int(mark.sum())
    return n, chars, len(text.translate(None, _NO_SYMBOL)), len(lines) - len(set(lines)), repeated, len(lines)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the counts of their whole texts."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in rest]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.array([measure(t) for t in texts_of(batch)], np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, np.ascontiguousarray(counts.T))], names=[*names, *COUNTS])

        return step

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{c} bigint" for c in COUNTS)])
    return map_batches(docs.select(*names, "text"), make, schema)


def failures() -> dict:
    """Each rule's failure as a column over the counts; the first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_verdicts(docs: DataFrame, host: str = "source", reject_rate: float = 0.5, max_strength: float = 1000.0) -> DataFrame:
    """One row per host: documents, failing documents, ``host_rate`` and ``host_kept``.

    ``docs`` has ``host`` and a boolean ``failed``. A host's raw rate is shrunk towards the hosts'
    mean rate by a beta prior fitted to the hosts' rates by moments: the fewer documents a host
    has, the nearer it comes to the prior's mean. With m the mean and v the variance of the hosts' rates and
    h the mean of one over their documents, v = m (1 - m) (h + (1 - h) / (a + b + 1)) gives the prior's strength
    a + b, held between 1 and ``max_strength`` documents. The host is rejected if its shrunk rate is over
    ``reject_rate``. Null hosts are one host.
    """
    hosts = docs.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed"))
    m = hosts.agg(
        F.count("*").alias("k"),
        F.avg(F.col("n_failed") / F.col("n_docs")).alias("mean"),
        F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("var"),
        F.avg(1 / F.col("n_docs")).alias("inverse"),
    ).first()
    mean, spread, strength = (m["mean"], m["mean"] * (1 - m["mean"]), max_strength) if m["k"] else (0.5, 0.25, max_strength)
    # What binomial sampling of the hosts' documents leaves unexplained is the variance between hosts.
    if m["k"] and spread > 0 and m["var"] > spread * m["inverse"]:
        share = (m["var"] / spread - m["inverse"]) / (1 - m["inverse"]) if m["inverse"] < 1 else 1.0
        strength = min(max(1 / share - 1, 1.0), max_strength)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= reject_rate)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: ids, counts, ``base_failed``, ``n_rules_failed``, the host's figures and ``kept``.

    A document is kept unless a base rule fails or its host is rejected. A null or empty text has no
    words and fails. Repeated rows each give a row, an empty table none, and columns besides
    ``doc_id``, ``text`` and the host's don't matter. Counts are stored once; hosts are pre-aggregated,
    and joined back by null-safe equality, where a host with a large share of all rows is a
    partition that adaptive execution can split.
    """
    rules = failures()
    counted = materialize(with_counts(docs.select("doc_id", F.col(host).alias("_host"), "text")))
    failed = sum(r.cast("int") for r in rules.values())
    judged = counted.withColumn("base_failed", rules["short"] | rules["repeats"]).withColumn("n_rules_failed", failed)
    hosts = host_verdicts(judged.select("_host", (F.col("n_rules_failed") > 0).alias("failed")), "_host").withColumnRenamed("_host", "_h")
    both = judged.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left")
    return both.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("_h").withColumnRenamed("_host", "host")
