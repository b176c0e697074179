import hashlib
import re

import numpy as np
import pytest

from tessera.llm import secrets
from tessera.llm.registry import op8_secrets


def brute(text):
    out = []
    for kind, pattern, keep in (
        ("assign", r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if keep(m)]
    return [x[2] for x in sorted(out)]


def said(d, found):
    p = d.probability([secrets.windows(*f[:3]) for f in found])
    return p, np.array([q >= d.thresholds[secrets.shape(t[a:b])] for q, (t, a, b, _) in zip(p, found, strict=True)])


@pytest.mark.parametrize("kind", ["access", "hex", "base64", "prefixed", "alnum", "letters", "lower", "uuid", "jwt"])
def test_recall_by_kind(kind):
    """Secrets that the network, its calibration and its thresholds haven't seen."""
    assert said(secrets.detector(), secrets.findings(400, 99, kind))[1].mean() >= 0.9


def test_precision_and_calibration():
    found = secrets.findings(3000, 98)
    y = np.array([f[3] for f in found])
    p, positive = said(secrets.detector(), found)
    assert y[positive].mean() >= 0.98 and positive[y].mean() >= 0.95
    assert abs(p.mean() - y.mean()) < 0.05


def test_corpus_findings(spark):
    """Documents label findings too; of their long words few are called secret by a detector that has learned from half of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.labelled(docs, "text", 400)
    assert found == secrets.labelled(docs.repartition(3), "text", 400) and {f[3] for f in found} == {True, False}
    d = secrets.fit([*secrets.findings(6000, 1), *found[::2]])
    rest = found[1::2]
    positive, y = said(d, rest)[1], np.array([f[3] for f in rest])
    assert positive[y].mean() >= 0.9 and positive[~y].mean() <= 0.05


def test_windows_cover_a_long_candidate():
    token = "".join(chr(97 + i % 26) for i in range(500))
    text = "before " + token + " after"
    w = secrets.windows(text, 7, 507)
    inside = w[:, secrets.BEFORE : secrets.BEFORE + secrets.INSIDE]
    assert (inside >= 128).all() and len(w) > 500 // secrets.INSIDE
    whole = "".join(chr(c - 128) for c in inside[0])
    for row in inside[1:-1]:
        whole += "".join(chr(c - 128) for c in row[-(secrets.INSIDE // 2) :])
    assert token.startswith(whole) and "".join(chr(c - 128) for c in inside[-1]) == token[-secrets.INSIDE :]
    # the secret in the middle of a long run counts
    assert [len(secrets.windows("x" * n, 0, n)) for n in (16, 44, 45, 66, 67)] == [1, 1, 2, 2, 3]


def test_odd_rows(spark):
    texts = [None, "", 'é Token = "abc.de" PASSWD:12345 api_key=1234567', "x" * 200000 + " AKIA" + "Z9" * 8 + " " + "0a" * 12, "toſken=abcdefgh pass", "key ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4" + " and 4720843956327690"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, findings int")
    out = {r.doc_id: r.findings for r in secrets.scan(df).collect()}
    for i, t in enumerate([*texts, texts[2]]):
        assert [f"{f.kind}:{f.start}:{f.end}" for f in out[i] if f.kind != "model"] == brute(t or ""), t[:80]
    assert [(f.start, f.kind) for f in out[5]] == [(4, "model")]
    assert [f.kind for f in out[3]] == ["access", "hex"]
    assert secrets.scan(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = op8_secrets(spark, d).collect()
    assert len(out) == len(rows)
    for r in out:
        base = brute(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        assert set(base) <= {*r.spans.split(",")}
