import math
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import lm
from tessera.llm.registry import op5_lm

D = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(docs):
    counts = Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return [(d, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for d, t in docs]


def small():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 20, 60), 20) for _ in range(20)]
    return lm.train(np.concatenate(texts), 21, steps=5, batch=8, dims=8, hidden=6), texts


def score(model, texts):
    sizes = list(map(len, texts))
    return model.score(np.concatenate([np.array(t, np.int64) for t in texts]), np.cumsum([0, *sizes]), np.repeat(np.arange(len(texts)), sizes))


def test_subwords():
    import pyarrow as pa

    from tessera.llm.batches import text_bytes

    texts = ["The  cat, the\nHat ", "", None, "é\u00a0x \u2003y \u3000 日本", "a\u00a0 \u00a0b c's 12"]
    data, offsets = text_bytes(pa.array(texts))
    w = lm.words(data, offsets)
    s = lm.Subwords(lm.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 4096)
    coded = s.encode(w, data)
    ids, cuts, word = coded.texts()
    encoding, _ = lm._encoding(s.path, s.ids)
    for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
        assert ids[b - 1] == 4096 and encoding.decode(ids[a : b - 1]) == "".join(" " + x for x in words(t))
    n = len(w.hashes)
    assert (np.sort(np.unique(word)) == np.arange(n + len(texts))).all() and (word[cuts[1:] - 1] == n + np.arange(len(texts))).all()
    for k in range(n):
        assert encoding.decode(ids[word == k]) == " " + data[w.starts[k] : w.ends[k]].tobytes().decode().lower()


def test_gradient():
    model, texts = small()
    for k, v in model.weights.items():
        model.weights[k] = v.astype(np.float64)
    x, y = np.stack([t[:16] for t in texts[:4]]), np.stack([t[1:17] for t in texts[:4]])
    _, grads = model.step(x, y)
    rng = np.random.default_rng(2)
    for k, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape)
            old = model.weights[k][at]
            if old < -20:
                continue
            around = []
            for e in (1e-5, -1e-5):
                model.weights[k][at] = old + e
                around.append(model.step(x, y)[0])
            model.weights[k][at] = old
            assert abs((around[0] - around[1]) / 2e-5 - g[at]) < 1e-5 + 1e-3 * abs(g[at]), (k, at)


def test_probabilities():
    model, _ = small()
    for context in ([], [3], list(range(15)), list(range(20)) * 3):  # all ids after a context make up 1
        totals = score(model, [[*context, i] for i in range(21)])
        before = score(model, [context])[0] if context else 0.0
        assert abs((10.0 ** (totals - before)).sum() - 1) < 1e-4
    ids = np.arange(40) % 20
    alone = score(model, [ids])[0]
    assert abs(score(model, [ids[:5], ids, ids[:1]])[1] - alone) < 1e-4


def test_odd_rows(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "A b a"), (3, "b " * 40000), (4, "x é y\x0bz"), (5, "a"), (6, "q"), (7, "r"), (8, "s b")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double")
    out = lm.score(df, steps=3).collect()
    key = lambda r: (r[0] is not None, r)
    want = sorted(base(docs), key=key)
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * abs(b[4])
    assert all(r.score < 0 for r in out)
    assert lm.score(df.limit(0), steps=3).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 500)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    out = {r.doc_id: r for r in lm.score(rows, steps=3).collect()}
    for d, n, known, total, score in base(docs):
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - score) < 1e-6 * abs(score)


def test_rare_words_count_in_the_score(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.score for r in lm.score(rows, steps=3).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 500)
    got = {r.doc_id: r.score for r in lm.score(rows, steps=3).collect()}
    assert want.keys() == got.keys() and all(abs(got[d] - x) < 1e-5 * abs(x) for d, x in want.items())


def test_training_grows_and_takes_whole_texts(spark):
    docs = [(i, f"{chr(97 + i % 26)}{i} " + "some words of a text " * 20) for i in range(400)]
    df = spark.createDataFrame(docs, "__key long, __text string").selectExpr("__text", "xxhash64(__key, __text) as __h").repartition(3)
    by_hash = [r["__text"] for r in df.orderBy("__h").collect()]
    assert lm._start(df, 300, 20_000) == by_hash[: len(lm._start(df, 300, 20_000))] and sum(map(len, lm._start(df, 300, 20_000)[:-1])) < 20_000
    subwords = lm.Subwords(lm.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 4096)
    start = lm.train(np.arange(500) % 4097, 4097, steps=2, batch=8)
    before = {k: v.copy() for k, v in start.weights.items()}
    model, few = lm.train_on(df.limit(100), subwords, start)
    _, many = lm.train_on(df, subwords, start)
    assert 3.8 * few < many < 4.2 * few and few > 400
    assert any((model.weights[k] != v).any() for k, v in before.items()) and all((start.weights[k] == v).all() for k, v in before.items())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    out = {r.doc_id: r for r in op5_lm(spark, D).collect()}
    held = [0.0, 0.0]
    for d, n, known, total, score in base(docs):
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert abs(r.base_score - score) < 1e-6 * abs(score)
        if r.held_out:
            held[0] += r.score
            held[1] += r.base_score
    assert held[0] > held[1], held


def plain_logs(model, ids):
    """Natural logarithms of the probabilities of one text's ids, window by window and position by position."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    n, d = len(model.class_of), w["E"].shape[1]
    read, out = [n - 1, *ids[:-1]], {}
    for start in range(0, max(1, len(ids)), lm.STRIDE):
        window = read[start : start + lm.LENGTH]
        if start and len(window) <= lm.LENGTH - lm.STRIDE:
            break
        h0 = [w["E"][x] + w["P"][i] for i, x in enumerate(window)]
        for i in range(len(window)):
            q = h0[i] @ w["Q"]
            a = np.array([math.exp(min(80, q @ (h0[j] @ w["K"]) / math.sqrt(d))) for j in range(i + 1)])  # what comes later is masked
            h1 = h0[i] + sum(x / a.sum() * (h0[j] @ w["V"]) for j, x in enumerate(a)) @ w["O"]
            h2 = h1 + np.maximum(h1 @ w["A"] + w["a"], 0) @ w["B"]
            t = ids[start + i]
            c = model.class_of[t]
            outer, inner = h2 @ w["C"] + w["c"], h2 @ w["T"][c] + w["t"][c]
            logs = outer[c] - math.log(np.exp(outer).sum()) + inner[model.place_of[t]] - math.log(np.exp(inner).sum())
            out.setdefault(start + i, max(logs, -30))  # the first window that holds an id scores it
    return [out[i] for i in range(len(ids))]


def test_score_against_a_plain_loop():
    model, texts = small()
    rng = np.random.default_rng(3)
    texts = [*texts[:4], *(np.append(rng.integers(0, 20, n), 20) for n in (0, 1, 13, 14, 15, 16, 17, 29, 30, 31, 45))]
    want = [sum(plain_logs(model, list(t))) / math.log(10) for t in texts]
    assert np.allclose(score(model, texts), want, rtol=1e-4, atol=1e-4)


def test_mixed_score_against_a_plain_loop(spark):
    """The whole query's score: of each word the network's probability, mixed with its share of the training words."""
    rows = [(i, t) for i, t in enumerate(["The cat sat on the mat.", "a cat and a dog sat on the long long mat", None, "unseen wordings zyx", "The dog, the Dog", "mat " * 40, "on the road again"] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = []
    original = lm.train_on
    try:
        lm.train_on = lambda *args, **kwargs: (models.append(original(*args, **kwargs)), models[-1])[1]
        out = {r.doc_id: r.score for r in lm.score(df, steps=20, batch=16, dims=8, hidden=8).collect()}
    finally:
        lm.train_on = original
    model, _ = models[0]
    s = lm.Subwords(lm.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 4096)
    encoding, _ = lm._encoding(s.path, s.ids)
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*words(t), None])
    for d, t in rows:
        ids, of = [], []
        for k, w in enumerate(words(t)):
            part = encoding.encode_ordinary(" " + w)
            ids, of = ids + part, of + [k] * len(part)
        logs = plain_logs(model, [*ids, 4096])
        total = 0.0
        for k, w in enumerate([*words(t), None]):
            own = sum(x for x, o in zip(logs, [*of, len(words(t))], strict=True) if o == k)
            total += math.log10((1 - lm.MIXED) * math.exp(own) + lm.MIXED * counts[w] / sum(counts.values()))
        assert math.isclose(out[d], total, rel_tol=1e-3, abs_tol=1e-3), (d, t)


def test_the_network_learns_from_every_training_text(spark, monkeypatch):
    """All windows of all training texts are trained on, and the classes come from all of their neighbours, however small the start is."""
    docs = [(i, f"{chr(97 + i % 26)}{i} some words of a text, " * (1 + i % 7)) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    subwords = lm.Subwords(lm.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 4096)
    encoding, _ = lm._encoding(subwords.path, subwords.ids)
    training = [t for d, t in docs if t and zlib.crc32(str(d).encode()) % 7 != 2]
    ids = [[i for w in words(t) for i in encoding.encode_ordinary(" " + w)] + [4096] for t in training]
    pairs = Counter(p for row in ids for p in zip(row[1:], row[:-1], strict=True))
    pairs.update((row[0], 4096) for row in ids)
    found = lm.neighbours(spark.createDataFrame([(t,) for t in training], "__text string").repartition(4), subwords)
    assert {(int(a), int(b)): int(found[a, b]) for a, b in zip(*found.nonzero(), strict=True)} == pairs
    windows, given = [], []
    train, train_on = lm.train, lm.train_on
    monkeypatch.setattr(lm, "train_on", lambda *args, **kwargs: (made := train_on(*args, **kwargs), windows.append(made[1]))[0])
    monkeypatch.setattr(lm, "train", lambda *args, **kwargs: (given.append(kwargs["counts"]), train(*args, **kwargs))[1])
    lm.score(df, sample=5, steps=2, batch=8, dims=8, hidden=8).count()
    total = sum(map(len, ids))
    assert 0 <= windows[0] - -(-total // lm.LENGTH) < df.rdd.getNumPartitions()  # the last window of a task may be shorter
    assert (given[0] == found).all()


def test_texts_are_coded_once(spark, monkeypatch):
    """Neighbours and training read the ids that one pass has stored, and no text again."""
    given = []
    neighbours, train_on = lm.neighbours, lm.train_on
    monkeypatch.setattr(lm, "neighbours", lambda docs, *args, **kwargs: (given.append(docs.columns), neighbours(docs, *args, **kwargs))[1])
    monkeypatch.setattr(lm, "train_on", lambda docs, *args, **kwargs: (given.append(docs.columns), train_on(docs, *args, **kwargs))[1])
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    assert lm.score(df, steps=2, batch=8, dims=8, hidden=8).count() == 20
    assert given == [["__ids"], ["__ids"]]


def test_stored_ids():
    import pyarrow as pa

    from tessera.llm.batches import text_bytes

    texts = ["The  cat, the\nHat ", "", None, "é\u00a0x \u2003y \u3000 日本", "a\u00a0 \u00a0b c's 12", "x" * 3000 + " THE cat"]
    for ids in (4096, 40000):
        s = lm.Subwords(lm.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids)
        data, offsets = text_bytes(pa.array(texts))
        want, cuts, word = s.encode(lm.words(data, offsets), data).texts()
        for k in (0, 3):  # a slice begins inside the buffers
            got, at, first = s.loaded(s.stored(pa.array(texts)).slice(k))
            assert (got == want[cuts[k] :]).all() and (at == cuts[k:] - cuts[k]).all()
            assert (first == np.flatnonzero(np.diff(word[cuts[k] :], prepend=-1))).all()
        whole, at, first = s.loaded(s.stored(pa.array(texts)))
        hashes = s.hashes(whole, first)[whole[first] != ids]
        spelled = [w for t in texts for w in words(t)]
        assert len(hashes) == len(spelled) and len({*zip(hashes.tolist(), spelled, strict=True)}) == len({*spelled}) == len({*hashes.tolist()})
    # a word that came as other subwords has the same hash
    encoding, _ = lm._encoding(s.path, s.ids)
    one, other = encoding.encode_ordinary(" cat"), [encoding.encode_single_token(bytes([b])) for b in b" cat"]
    assert one != other and (lambda h: h[0] == h[1])(s.hashes(np.array(one + other), np.array([0, len(one)])))


def test_steps_against_plain_adam():
    model, texts = small()
    first = {k: 0.0 for k in model.weights}
    second = dict(first)
    model.moments, model.steps = None, 0
    want = {k: v.astype(float) for k, v in model.weights.items()}
    for i in range(4):
        x, y = np.stack([t[i : 16 + i] for t in texts]), np.stack([t[1 + i : 17 + i] for t in texts])
        plain = lm.Model({k: v.astype(np.float64) for k, v in want.items()}, model.class_of, model.place_of)
        for k, g in plain.step(x, y)[1].items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            want[k] = want[k] - 0.001 * (first[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
        model.fit(x, y, 0.001)
    assert all(np.allclose(model.weights[k], v, atol=2e-4) for k, v in want.items())
