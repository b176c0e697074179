import random
import re

import numpy as np

from tessera.llm import lines
from tessera.llm.registry import op10_lines


def split(text):
    return [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]


def core(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(docs, percent=80, shortest=20):
    """docs: id -> text; the numbers of the lines that repeat another."""
    places = [(d, k, core(x)) for d, t in sorted(docs.items()) for k, x in enumerate(split(t))]
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} if len(x) >= shortest else {x} for _, _, x in places]
    parent = list(range(len(places)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = {d: set() for d in docs}
    for i, (d, k, _) in enumerate(places):
        if find(i) != i:
            out[d].add(k)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñfgh") for _ in range(rng.randint(2, 9)))
    bases = [[word() for _ in range(rng.randint(6, 40))] for _ in range(25)]
    docs = {}
    for d in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases)) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = word()
            out.append(rng.choice(["", "  "]) + " ".join(line).replace(line[0], line[0].title(), 1))
            if rng.random() < 0.2:
                out.append("")
        docs[d * 7 - 30] = "\n".join(out)
    return docs


def test_against_brute_force(spark):
    wrong = total = 0
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, 0) for d, t in docs.items()], "doc_id long, text string, removed int").repartition(4)
        want = brute(docs)
        for r in lines.dedup(df).collect():
            total += len(want[r.doc_id])
            wrong += len(want[r.doc_id] ^ set(r.removed))
            assert r.n_lines == len(split(docs[r.doc_id])) and r.n_removed == len(r.removed)
            assert split(r.text) == [x for k, x in enumerate(split(docs[r.doc_id])) if k not in set(r.removed)]
    assert total > 60 and wrong <= 0.03 * total, (wrong, total)


def test_recall_of_bands():
    rng = np.random.default_rng(4)
    found = []
    for _ in range(400):
        a = rng.integers(1, 1 << 63, 200, dtype=np.uint64)
        b = np.concatenate([a[:178], rng.integers(1, 1 << 63, 22, dtype=np.uint64)])  # similarity 0.80
        s = lines.signatures(np.concatenate([a, b]), np.array([0, 200, 400]))
        found.append((s[0] == s[1]).any())
    assert np.mean(found) > 0.95


def test_few_pairs_are_missed():
    rng = np.random.default_rng(6)
    a = rng.integers(0, (1 << 64) - 1, (3000, 200), dtype=np.uint64)
    b = np.concatenate([a[:, :178], rng.integers(0, (1 << 64) - 1, (3000, 22), dtype=np.uint64)], axis=1)  # similarity 0.80
    s = [lines.signatures(x.ravel(), np.arange(3001) * 200) for x in (a, b)]
    assert (s[0] != s[1]).all(axis=1).mean() < 0.006


def test_odd_rows(spark):
    long = "This is a line that is long enough to be compared, and it is here twice."
    rows = [(1, None), (2, ""), (3, long + "\nshort\n\n" + long.upper()), (3, long), (None, long), (4, "\n \n" + long + "\nshort"), (5, "x" * 100000), (6, "x" * 100000), (7, long.replace("twice", "thrice") + "\r\nrest")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int")
    out = [(r.doc_id, r.text, r.removed) for r in lines.dedup(df).collect()]
    assert len(out) == len(rows)
    by = {(d, t) for d, t, _ in out}
    assert by == {(1, None), (2, ""), (3, long + "\nshort\n"), (3, long), (None, long), (4, "\n "), (5, "x" * 100000), (6, ""), (7, "rest")}
    assert lines.dedup(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want, out = brute(docs), op10_lines(spark, d).collect()
    assert len(out) == len(docs)
    total = sum(map(len, want.values()))
    assert sum(len(want[r.doc_id] ^ set(r.removed)) for r in out) <= 0.03 * total and total


def test_blocks_of_a_family(spark, monkeypatch):
    """A family of many blocks gives the components of one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(30)]
    rows = []
    for d in range(300):
        line = list(base)
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(30)] = word()
        rows.append((d, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = []
    for size in (256, 16):
        monkeypatch.setattr(lines, "FAMILY", size)
        out.append(sorted((r.doc_id, tuple(r.removed)) for r in lines.dedup(df).collect()))
    assert out[0] == out[1]
    want = brute(dict(rows))
    assert sum(len(want[d] ^ set(r)) for d, r in out[0]) <= 9
