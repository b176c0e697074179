import re
from collections import Counter

import numpy as np

from tessera.llm import quality
from tessera.llm.registry import op6_quality

D = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \n\t ", "a", "a b", "a b c", "x x x x", "a b c a b c a b c", "a b a b a", "l1 é\nl1 é\n \n\nl1 é|<>", "\x0b a\x0cb\rc a b c", "z z z z", "w " * 40000 + "end", " ".join(map(str, range(33000))) + " 1 2 3 4"]


def test_statistics(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    for r in quality.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(ODD[r.doc_id]), repr(ODD[r.doc_id])[:60]
    assert quality.statistics(df.limit(0)).count() == 0


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    out = op6_quality(spark, D).collect()
    assert len(out) == len(rows)
    for r in out:
        b = brute(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    failed = {r.doc_id: r.base_failed for r in out}
    good = [kept[i] for i, q in labels.items() if q == 1 and not failed[i]]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2, (np.mean(good), np.mean(bad))


def test_rules_on_rows_not_learned_from(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.fit(docs, labels, sample=1500)
    learned = labels.orderBy("doc_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = quality.statistics(learned).withColumn("kept", ~quality.base_failed() & quality.verdict(rules)).select("quality", "kept").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.9
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.25


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a " * 60), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == [] and quality.fit(docs, labels.limit(0)) == []
    assert {(r.doc_id, r.kept) for r in quality.judge(docs, labels).collect()} == {(1, False), (None, False)}
