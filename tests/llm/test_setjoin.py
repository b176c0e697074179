import random
import re

import numpy as np

from tessera.llm import setjoin
from tessera.llm.components import components
from tessera.llm.registry import op3_setjoin
from tessera.llm.tables import Tables


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(docs, n, percent):
    sets = [shingle_set(t, n) for _, t in docs]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, set()).add(i)
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, c in shared.items():
            if docs[i][0] is not None and docs[j][0] is not None and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(docs)]


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    base = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = base(40)
    docs = []
    for _ in range(12):  # families around the threshold, some of them long chains
        family = base(rng.choice([6, 30, 120]))
        for _ in range(rng.randint(1, 12)):
            family = [rng.choice(vocabulary) if rng.random() < rng.choice([0.002, 0.02]) else w for w in family]
            docs.append(" ".join(family))
    docs += [" ".join(base(15) + passage + base(15)) for _ in range(40)] + [" ".join(passage)] * 3 + ["", None, "one", "one", "one two", " ONE  two "]
    rng.shuffle(docs)
    return [(i * 3 % 1009, t) for i, t in enumerate(docs)]


def test_against_brute_force(spark, monkeypatch):
    for seed, n, percent, block, rare in ((1, 4, 85, 256, 16), (2, 5, 80, 4, 2), (3, 3, 60, 4, 5)):
        monkeypatch.setattr(setjoin, "BLOCK", block)
        monkeypatch.setattr(setjoin, "RARE", rare)
        docs = [*corpus(random.Random(seed)), (None, "one two"), (None, "q " * 30000)]
        df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, digest int").repartition(5)
        got = [tuple(r) for r in setjoin.linked(df, n, percent).collect()]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(got, key=key) == sorted(brute(docs, n, percent), key=key)
    assert setjoin.linked(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (400, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df, Tables(spark)).collect())) == sorted((v, find(v)) for v in parent)
    assert components(df.limit(0), Tables(spark)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_setjoin(spark, d).collect())) == sorted(brute(docs, 4, 85))


def test_lists_across_batches(spark):
    """Lists that go on over many batches are walked whole, and copies of a class count once."""
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(30), 5, rng.randrange(3)) for _ in range(900)] + [(99, k % 7, 5, 0) for k in range(500)] + [(100, 3, 5, 0)] * 4
    df = spark.createDataFrame(rows, "token long, digest long, size int, at int")
    want = {}
    for t, d, *_ in rows:
        want.setdefault(t, set()).add(d)
    for most in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            out = [(r.token, r.digest) for r in setjoin.lists_of(df).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(out) == sorted((t, d) for t, s in want.items() if len(s) > 1 for d in s)
