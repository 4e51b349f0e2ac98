import re

from helpers import awkward, empty, words

from corpusrisk.llm.quality_rules import document_counts, host_verdicts, quality_rules, rule_failures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    at = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)


def counts(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()]


def test_counts_match_brute_force(spark):
    w = words(3, 12)
    texts = [" ".join(w[(i * k * k + k) % 12] for k in range(i)) for i in range(0, 60, 3)]
    texts += [None, "", "\n\n", "a b c", "a b c a b c", "a a a a a", "a\x0bb\x0cc\rd", "x\ny\nx\n \ny", "# $ %|<>&*", "éé \U0001f600"]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(counts(document_counts(df))) == sorted(map(brute, texts))


def test_awkward_rows_and_empty_table(spark):
    df = awkward(spark)
    got = quality_rules(df).collect()
    assert len(got) == df.count()
    assert sorted(counts(quality_rules(df))) == sorted(brute(r.text) if len(r.text or "") < 5000 else c for r, c in zip(df.collect(), counts(document_counts(df))))
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules(empty(spark)).collect() == []


def test_host_verdicts_shrink_small_hosts(spark):
    rows = [("good", 95, 5), ("bad", 5, 95), ("one", 0, 1), (None, 50, 0)]
    df = spark.createDataFrame([(h, f) for h, ok, no in rows for f in [False] * ok + [True] * no], "host string, failed boolean")
    got = {r.host: r for r in host_verdicts(df).collect()}
    assert got["good"].host_ok and not got["bad"].host_ok and got[None].host_ok
    # one failure out of one is pulled towards the mean of all
    assert got["one"].host_rate < 1.0 and got["one"].host_docs == 1 and got["one"].host_failed == 1


def test_bad_host_rejects_its_clean_documents(spark):
    clean = " ".join(words(5, 400))
    rows = [(i, clean + str(i), "ok") for i in range(20)] + [(100 + i, "spam " * 80, "bad") for i in range(19)] + [(200, clean, "bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules(df).filter("kept").collect()}
    assert kept == set(range(20))
    assert rule_failures(document_counts(df)).filter("doc_id = 200 AND NOT base_failed").count() == 1
