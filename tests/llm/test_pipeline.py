import re

import corpus_pipeline
from tessera.llm import quality
from tests.llm import test_bpe, test_decontaminate, test_lines, test_setjoin

D = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, D)
        assert made.columns[:5] == docs.columns[:5] and (k == 4 or len(made.columns) == 5)
        made.write.parquet(f"{tmp_path}/{k}")
        out.append((docs, docs := spark.read.parquet(f"{tmp_path}/{k}")))
    for _, after in out:
        assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = map(texts, out[0])
    judged = {r.doc_id: r.kept for r in quality.judge(out[0][0], spark.read.parquet(f"{D}/labels.parquet")).collect()}
    assert after == {d: t for d, t in before.items() if judged[d]}

    before, after = map(texts, out[1])
    gone = test_lines.brute(before)
    wrong = 0
    for d, t in before.items():
        lines = test_lines.split(t)
        left = [x for k, x in enumerate(lines) if k not in gone[d]]
        wrong += (test_lines.split(after[d]) != left) if d in after else not (lines and len(gone[d]) == len(lines))
    assert wrong <= 0.03 * len(before), wrong

    before, after = map(texts, out[2])
    assert after == {d: before[d] for d, _, c in test_setjoin.brute(list(before.items()), 5, 80) if c == d}

    before, after = map(texts, out[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for d, t in before.items():
        n, hit, _ = test_decontaminate.brute(t, items)
        left = test_decontaminate.words(after[d]) if d in after else []
        assert len(left) == n - hit and (hit or after[d] == t)

    for r in out[4][1].collect():
        n, ids, decoded = test_bpe.expected(r.text)
        assert (r.n_tokens, " ".join(map(str, r.ids)), r.decoded) == (n, ids, decoded)


def test_short_lines_outlive_a_shared_footer(spark):
    footer = "This footer stands below all of the texts of this place."
    rows = [(1, "an only line\n" + footer), (2, "short one\nshort two\n" + footer), (3, footer)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, D).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("short one\nshort two", 19)}


def test_odd_rows(spark, tmp_path):
    good = "Some words of an ordinary text that goes on. " * 2 + " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", None, 9), (2, None, None, None, None), (None, good + " more", "en", "s", 5), (3, good, "en", "x", 1), (3, good, "en", "x", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("documents", rows), ("empty", [])):
        docs = spark.createDataFrame(own, kind)
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{D}/{table}.parquet").write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        found = docs.collect()
        assert len(found) <= len(own) and (name == "empty" or {r.doc_id for r in found} == {1, None})
        assert all(re.search("word5", r.text) for r in found)


def test_long_texts_ties_and_clashing_columns(spark, tmp_path):
    """Extra columns go, also those named like the stages' own; equal rows are judged alike; a long text goes through whole."""
    long = " ".join(f"token{i}" for i in range(100000))
    good = " ".join(f"word{i}" for i in range(70))
    rows = [(5, long, "en", "s", 1, 0, "x"), (7, good, "en", "s", 1, 1, None), (6, good, "en", "s", 1, 2, "y"), (6, good, "en", "s", 1, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, hit_spans string")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns[:5]) == corpus_pipeline.COLUMNS
        if name != corpus_pipeline.STAGES[-1][0]:
            assert len(docs.columns) == 5
    found = docs.collect()
    assert {r.doc_id for r in found} == {5, 6}  # 7 repeats 6
    assert next(r for r in found if r.doc_id == 5).text == long and next(r for r in found if r.doc_id == 5).decoded
