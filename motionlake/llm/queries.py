"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import decontamination, doc_sketch, hard_negatives, html_extraction, lbl_lm, packing, quality_rules, secret_scan, simhash_dedup, token_records, tokens, toxicity, vector_codes, warc_zip
from motionlake.llm.common import fold_column, shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; labels of the held-out third are not used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_column("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host verdicts for all documents; the host is the source."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to record files, and what the files hold."""
    uri = shared_dir(spark)
    manifest = token_records.write_records(table(spark, sf_dir, "documents"), uri, tokens.default_tokenizer(), end_id=2)
    read = token_records.read_records(spark, uri, manifest)
    n = (F.octet_length("ids") / 4).cast("bigint")
    return read.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived in ZIP packages, and what the packages hold."""
    uri = shared_dir(spark)
    packages = warc_zip.write_packages(table(spark, sf_dir, "pages"), uri)
    return warc_zip.read_packages(packages, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest_columns(secret_scan.scan(docs, secret_scan.default_ranks()))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents; a fifth of them is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_column("doc_id", 5) == 1
    scored = lbl_lm.fit(docs, ~held_out).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return doc_sketch.edited_pairs(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding among all; a seventh of the labels is wrong."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", wrong.alias("label"), vector_codes.scaled("embedding", 256).alias("q"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_host_quality": op3_host_quality,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_token_records": op5_token_records,
        "op6_warc_zip": op6_warc_zip,
        "op7_html_extraction": op7_html_extraction,
        "op8_secret_scan": op8_secret_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_log_bilinear": op10_log_bilinear,
        "op11_vector_codes": op11_vector_codes,
        "op12_document_fingerprints": op12_document_fingerprints,
        "op13_hard_negatives": op13_hard_negatives,
    }


OP3_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  p AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w),
  g AS (SELECT rid, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
  s AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM g WHERE z IS NOT NULL) WHERE n > 1),
  r AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + k.j AS i FROM s, generate_series(0, 2) AS k(j)) GROUP BY rid),
  c AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS bigint) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS bigint) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS bigint) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (rid)),
  j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
  k AS (SELECT *, base_failed OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)) OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS failed FROM j),
  h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM k GROUP BY source),
  m AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS v, avg(1 / n) AS inv FROM h),
  q AS (SELECT mean, CASE WHEN mean * (1 - mean) > 0 AND v > mean * (1 - mean) * inv THEN least(greatest((1 - inv) / (v / (mean * (1 - mean)) - inv) - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM m),
  v AS (SELECT source, (f + mean * strength) / (n + strength) <= 0.5 AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM k LEFT JOIN v ON k.source IS NOT DISTINCT FROM v.source"""


def vector_codes_sql(rounds: int = 4) -> str:
    """All rounds unrolled: nearest entries over a join with the codebook, then means by component."""
    assigned = "SELECT p.rid, p.part, arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}}) AS a FROM (SELECT p.rid, p.part, c.e, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{0} c ON c.part = p.part) p GROUP BY p.rid, p.part"
    parts = [
        "k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS double) * 1024) AS bigint)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT rid, j.i AS part, v[j.i * len(v) // 4 + 1 : (j.i + 1) * len(v) // 4] AS x FROM k, generate_series(0, 3) AS j(i))",
        "c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= 256)",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({assigned.format(i)})",
            f"m{i} AS (SELECT part, e, list(m ORDER BY pos) AS c FROM (SELECT part, e, pos, CAST(floor(CAST(sum(y) AS double) / count(*)) AS bigint) AS m FROM (SELECT p.part, a.a.e AS e, generate_subscripts(p.x, 1) AS pos, unnest(p.x) AS y FROM p JOIN a{i} a USING (rid, part)) GROUP BY ALL) GROUP BY ALL)",
            f"c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (part, e))",
        ]
    parts += [
        f"f AS MATERIALIZED ({assigned.format(rounds)})",
        "g AS (SELECT rid, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code, CAST(sum(a.d) AS bigint) AS error FROM f GROUP BY rid)",
        f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM g JOIN k USING (rid), s"


OP13_SQL = """WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS double) * 256)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, k.vec_id, k.label = a.label AS same, k.vec_id IS NOT DISTINCT FROM a.vec_id AS own, CAST(list_inner_product(a.q, k.q) AS bigint) AS score FROM k a, k WHERE a.vec_id % 50 = 0),
  p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS j FROM s WHERE same AND NOT own QUALIFY j <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.rid, j ORDER BY score DESC, vec_id) AS int) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """Models, fingerprints of XXH64, token ids, archives and element trees have no SQL; tests hold them against brute force."""
    return {"op3_host_quality": OP3_SQL, "op11_vector_codes": vector_codes_sql(), "op13_hard_negatives": OP13_SQL}
