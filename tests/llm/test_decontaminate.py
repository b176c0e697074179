import hashlib
import re

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate
from tessera.llm import words as kernel
from tessera.llm.batches import text_bytes
from tessera.llm.registry import op4_decontaminate

D = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(window, len(v))
        if n:
            own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_index():
    rng = np.random.default_rng(0)
    for n, s in ((1, 2), (50, 3), (400, 2), (300, 40)):
        seq = np.append(rng.integers(1, s + 1, n), 0)
        index = decontaminate.FMIndex(seq, s + 1, 4)
        for m in (1, 2, 5):
            phrases = rng.integers(1, s + 1, (20, m))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                there = [i for i in range(n - m + 1) if (seq[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, max(a, b)))) == there


def test_suffixes_of_repeats():
    rng = np.random.default_rng(1)
    for part in (np.ones(70, int), rng.integers(1, 3, 40), rng.integers(1, 50, 30)):
        seq = np.append(np.tile(part, 4), 0)
        assert list(decontaminate.suffix_array(seq)) == sorted(range(len(seq)), key=lambda i: tuple(seq[i:]))


def test_the_whole_shard_is_indexed(monkeypatch):
    sizes = []
    index = decontaminate.FMIndex

    def noted(sequence, symbols):
        sizes.append((len(sequence), symbols))
        return index(sequence, symbols)

    monkeypatch.setattr(decontaminate, "FMIndex", noted)
    texts = ["one two three", "", "nothing of it here", "two three two three"]
    data, offsets = text_bytes(pa.array(texts))
    w = kernel.words(data, offsets, kernel.LETTERS)
    hit, pairs = decontaminate.occurrences(w.hashes, w.rows, decontaminate.Phrases.of([("a", "two three")], 10))
    assert sizes == [(len(w.hashes) + len(texts) + 1, len({x for t in texts for x in t.split()}) + 2)]
    assert list(np.flatnonzero(hit)) == [1, 2, 7, 8, 9, 10] and list(pairs) == [0, 3]


def test_odd_rows(spark, monkeypatch):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short one"), (3, None), (4, " .. "), (2, "short one"), (None, "a b"), (11, "Éa éa éa")]
    texts = [None, "", "a SHORT one, short-one", "x " + items[0][1].upper() + " y " + items[0][1], "éa éa éa éa", "one two three four five six seven eight nine", "short", "one", ("w " * 50000) + items[0][1], "ten eleven short one two"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        for r in decontaminate.find(docs, bench).collect():
            assert (r.n_words, sum(s.end - s.start for s in r.hit_spans), r["items"]) == brute(r.text, [x for x in items if x[0]]), r.doc_id
            for s, c in zip(r.hit_spans, r.cut_spans, strict=True):
                assert words(r.text[c.start : c.end]) == words(r.text)[s.start : s.end]
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert {tuple(r["items"]) for r in decontaminate.find(docs, bench.limit(0)).collect()} == {()}


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    out = op4_decontaminate(spark, D).collect()
    assert len(out) == len(rows) and any(r.contaminated for r in out)
    for r in out:
        n, hit, found = brute(rows[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
