import re

from motionlake.llm import quality_rules as Q


def brute(text):
    t = text or ""
    word = r"[^\x20\x09-\x0D]+"
    w = re.findall(word, t)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if re.search(word, line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), lines


def test_counts_of_whole_texts(spark, odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["a b c a b c", " é z \x1c q é", "a a a a", "a\n\na\n \n a|<>"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert Q.measure(t.encode()) == brute(t)


def test_base_rules_and_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = Q.judge(odd_docs).collect()
    assert len(got) == len(odd_rows)
    want = {i: brute(t) for i, t in odd_rows}
    for r in got:
        n, *_, rep, _ = want[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
    assert Q.judge(no_docs).count() == 0


def test_bad_host_takes_its_documents_along_and_small_hosts_are_shrunk(spark):
    good = [(i, f"h{i % 30}", i // 30 % 10 == 0) for i in range(3000)]
    bad = [(5000 + i, "bad", i % 10 != 0) for i in range(1000)]
    once = [(9000, "tiny", True)]
    rows = spark.createDataFrame(good + bad + once, "doc_id long, host string, failed boolean")
    v = {r.host: r for r in Q.host_verdicts(rows, "host").collect()}
    assert not v["bad"].host_kept and v["bad"].host_rate > 0.8
    assert all(v[f"h{k}"].host_kept for k in range(30))
    assert v["tiny"].n_failed == 1 and v["tiny"].host_rate < 1.0


def test_documents_of_a_rejected_host_go(spark):
    good, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i} #" for i in range(60))
    rows = [(i, good, f"host{i % 8}") for i in range(400)] + [(1000 + i, junk if i % 10 else good, "junk") for i in range(200)]
    rows += [(2000, good, None), (2001, junk, "once")]
    v = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(v) == len(rows) and not any(r.base_failed for r in v.values())
    assert not any(v[1000 + i].kept for i in range(200)) and all(v[i].kept for i in range(400)) and v[2000].kept


def test_prior_by_moments_is_that_of_the_formula(spark):
    hosts = [("a", 10, 1), ("b", 20, 8), ("c", 5, 4), ("d", 40, 6)]
    rows = [(h, i < f) for h, n, f in hosts for i in range(n)]
    got = {r.host: r.host_rate for r in Q.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean"), "host").collect()}
    rates = [f / n for _, n, f in hosts]
    m = sum(rates) / 4
    v, h = sum((r - m) ** 2 for r in rates) / 4, sum(1 / n for _, n, _ in hosts) / 4
    strength = (1 - h) / (v / (m * (1 - m)) - h) - 1
    assert 1 < strength < 1000
    assert all(abs(got[x] - (f + m * strength) / (n + strength)) < 1e-9 for x, n, f in hosts)
