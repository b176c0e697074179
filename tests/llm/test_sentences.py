import re

from tessera.llm import sentences
from tessera.llm.registry import op2_substrings


def split(text):
    out, cur = [], []
    for line in re.split("(\n)", text or ""):
        if line == "\n":
            if cur:
                out.append(cur)
            cur = []
            continue
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            cur.append(re.sub("[A-Z]", lambda m: m[0].lower(), w))
            if w[-1] in ".!?":
                out.append(cur)
                cur = []
    return out + ([cur] if cur else [])


def brute(docs):
    """docs: (id, text) -> sentences removed from each row."""
    first, every = {}, []
    for i, (d, t) in enumerate(docs):
        s = split(t)
        for number, (few, least) in enumerate(sentences.RUNS):
            for a in range(len(s) - few + 1):
                k = few
                while number == 0 and a + k < len(s) and sum(map(len, s[a : a + k])) < least:
                    k += 1
                run = tuple(map(tuple, s[a : a + k]))
                if d is not None and sum(map(len, run)) >= least:
                    first[run] = min(first.get(run, (d, a)), (d, a))
                    every.append((run, i, d, a, k))
    out = [set() for _ in docs]
    for run, i, d, a, k in every:
        if first[run] != (d, a):
            out[i] |= set(range(a, a + k))
    return out


S = "One small sentence here. Two of them are there! Is it the third, really?\nFour lines follow without an end\nFive is the last."
LONG = "w" + " w2" * 45 + "."


def test_odd_rows(spark):
    docs = [(5, S), (3, "Start now. " + S.upper() + " The end."), (5, S), (None, S), (7, None), (8, ""), (9, "x " + LONG), (10, "Head. " + LONG + " Tail."), (11, LONG + " y"), (12, S + " " + S), (13, "a. b. c. " * 9), (14, LONG * 400)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, removed int")
    want = {}
    for (d, t), gone in zip(docs, brute(docs), strict=True):
        want.setdefault((d, t), set()).add((len(split(t)), len(gone)))
    out = sentences.dedup(df).collect()
    assert len(out) == len(docs)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add((r.n_sentences, r.n_removed))
        assert r.n_removed == sum(x.end - x.start for x in r.removed) and len(split(r.text)) <= r.n_sentences
    assert got == {d: {x for (e, _), v in want.items() if e == d for x in v} for d, _ in docs}
    assert {r.text for r in out if r.doc_id == 10} == {"Head. Tail."} or got[10] == {(3, 0)}
    assert sentences.dedup(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    out = {r.doc_id: r for r in op2_substrings(spark, d).collect()}
    assert len(out) == len(docs)
    for (i, t), gone in zip(docs, brute(docs), strict=True):
        assert (out[i].n_sentences, out[i].n_removed) == (len(split(t)), len(gone)), i
        if not gone:
            assert out[i].text == t
