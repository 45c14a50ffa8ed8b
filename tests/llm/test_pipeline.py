from pyspark.sql import functions as F

import corpus_pipeline as P
from motionlake.llm import secret_scan, simhash_dedup, toxicity
from motionlake.llm.common import materialize, table
from tests.llm.test_decontamination import brute as brute_items
from tests.llm.test_near_copies import brute as brute_near
from tests.llm.test_tokens_packing_records import check_pieces


def test_stages_take_effect_and_agree_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf))
        assert docs.columns == columns, name
        kept[name] = (before.collect(), docs.collect())
    before, after = kept["toxicity"]
    scores = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels")).score(table(spark, sf, "documents")).select("doc_id", "score").collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in scores if r.score < 0.7) and len(after) < len(before)
    before, after = kept["simhash_dedup"]
    assert sorted(r.doc_id for r in after) == brute_near([(r.doc_id, r.text) for r in before])
    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not brute_items(r.text, items))
    before, after = kept["secret_scan"]
    assert len(before) == len(after)
    assert all(not secret_scan.base_spans(r.text) for r in after)
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], P.STAGES[-1][1](spark, docs, sf).collect())


def test_one_row_stays_of_repeated_rows(spark):
    text = "some words that repeat in two rows of the table"
    rows = [(3, text, "a"), (3, text, "a"), (3, text, "b"), (9, text, "c"), (None, text, "d"), (4, "another text of several words entirely", "e"), (4, "another text of several words entirely", "e"), (None, None, "f")]
    out = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 3, 4]


def test_empty_tables_pass(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_odd_documents_pass_all_stages(spark, odd_docs):
    docs = odd_docs.withColumnsRenamed({"piece": "_row", "secrets": "_hash"}).withColumn("item_id", F.lit(1))
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, "/root/testdata/sf0.001"))
        assert out.columns == docs.columns, name
        docs = out
    # Of the rows without words one stays, and of the repeated ones.
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (True, None)]
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()} == {1, 4, 5, 7, 8, None}
