"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

A candidate is a maximal run of 16 or more token characters. The network slides over all of it and its surroundings,
and the largest score counts. It is trained in numpy on labelled findings: those of a seeded generator, and a bounded
sample of what fixed patterns label in the table itself (access keys and long hex numbers as secrets, long words
as harmless). One part of them trains it, a second calibrates its scores (a logistic fit), and on a third
each kind of candidate gets the largest threshold that keeps the recall asked for.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, text_bytes
from .tables import Tables

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, INSIDE, AFTER = 20, 44, 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Of each kind the leftmost matches that don't overlap, less those too short; by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


#: Kinds of candidates that have a threshold each; the first that matches counts.
SHAPES = {
    "digits": re.compile("[0-9]+"), "uuid": re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), "hex": re.compile("[0-9a-fA-F]+"), "lower": re.compile("[a-z]+"), "letters": re.compile("[A-Za-z]+"),
    "words": re.compile("[A-Za-z]+([/_=-]+[A-Za-z]+)+[/_=-]*"), "signs": re.compile("[+/_=-]+"), "mixed": re.compile(".+"),
}


def shape(token: str) -> str:
    """The kind of candidate that a threshold belongs to."""
    return next(name for name, pattern in SHAPES.items() if pattern.fullmatch(token))


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Rows of letters before, within and after parts of a candidate as numbers, so that all of it is in one; those within are 128 to 255, nothing is 0."""
    begins = [start] if end - start <= INSIDE else [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    low = max(0, start - BEFORE)
    codes = np.minimum(np.frombuffer(text[low : end + AFTER].encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.int64)
    codes[start - low : end - low] += 128
    out = np.zeros((len(begins), BEFORE + INSIDE + AFTER), np.int64)
    for row, a in zip(out, begins, strict=True):
        b = min(end, a + INSIDE)
        for at, x, y in ((BEFORE - (a - max(low, a - BEFORE)), max(low, a - BEFORE), a), (BEFORE, a, b), (BEFORE + INSIDE, b, b + AFTER)):
            part = codes[x - low : y - low]
            row[at : at + len(part)] = part
    return out


Finding = tuple[str, int, int, bool]


def findings(n: int, seed: int, only: str | None = None) -> list[Finding]:
    """Labelled findings from a generator, as many secrets as others: text, start and end of a candidate, whether it is a secret. ``only``: secrets of this kind."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    of = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    between = lambda a, b: int(rng.integers(a, b))
    syllable = lambda: of("bcdfghklmnprstvwz", between(1, 3)) + of("aeiou", between(1, 3)) + (of("lmnrst", 1) if rng.random() < 0.4 else "")
    word = lambda: "".join(syllable() for _ in range(between(1, 4)))
    words = lambda a, b: [word() for _ in range(between(a, b))]
    alnum, url, low = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", "0123456789abcdef"
    secrets = {
        "access": lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16),
        "hex": lambda: of(low if rng.random() < 0.6 else low.upper(), pick([16, 24, 32, 40, 48, 64, 128])),
        "base64": lambda: of(alnum + "+/", pick([24, 40, 44, 64, 88])) + pick(["", "=", "=="]),
        "prefixed": lambda: pick(["sk-", "ghp_", "xoxb-", "pk_live_", "key-", "glpat-", "AIza"]) + of(alnum, pick([20, 24, 36])),
        "alnum": lambda: of(alnum, between(18, 65)),
        "letters": lambda: of(string.ascii_letters, between(20, 48)),
        "lower": lambda: of(string.ascii_lowercase, between(24, 48)),
        "uuid": lambda: "-".join(of(low if rng.random() < 0.8 else low.upper(), k) for k in (8, 4, 4, 4, 12)),
        "jwt": lambda: ("eyJ" if rng.random() < 0.5 else "") + of(url, between(30, 160)),
    }
    plain = [
        lambda: of(string.digits, between(16, 24)), lambda: "-".join([*words(3, 7), of(string.digits, pick([0, 2, 4]))]), lambda: "/".join([*words(2, 5), of(string.digits, 4), *words(1, 3)]), lambda: "/".join(words(4, 20)),
        lambda: f"{pick([1999, 2010, 2024])}-{pick(['01', '11'])}-{pick(['07', '28'])}T-" + of(string.digits, 6) + "-log", lambda: "_".join(words(3, 7)), lambda: "_".join(words(3, 6)).upper(), lambda: "_".join(words(3, 5)) + of(string.digits, between(1, 4)),
        lambda: "".join(words(4, 9)), lambda: "".join(words(4, 9)).title(), lambda: "".join(words(4, 9)).upper(), lambda: "".join(w.title() for w in words(4, 8)), lambda: word() + "".join(w.title() for w in words(3, 7)) + of(string.digits, between(0, 3)),
        lambda: pick("=-_/+") * between(16, 200), lambda: (pick("=-_") + pick("=-_")) * between(10, 30) + of(string.digits, between(0, 2)), lambda: pick(string.ascii_letters) * between(16, 200), lambda: pick(string.ascii_letters) * between(16, 40), lambda: word() + "=" + word() + "/" + of(string.digits, 8), lambda: word() * between(6, 9),
    ]
    leads = ["", "", "key = ", "token: ", "secret=", "auth ", "Bearer ", "id ", "password: ", "pass=", "see "]
    out: list[Finding] = []
    while len(out) < n:
        secret = only is not None or len(out) % 2 == 0
        token = secrets[only or pick(list(secrets))]() if secret else pick(plain)()
        lead = " ".join(words(0, 5)) + " " + (pick(leads) if secret or rng.random() < 0.3 else "") + pick(["", "", '"'])
        text = f"{lead}{token}{pick(['', ' ', '.', chr(34)])} {' '.join(words(0, 3))}"
        if (len(lead), len(lead) + len(token)) in candidates(text):
            out.append((text, len(lead), len(lead) + len(token), secret))
    return out


#: What fixed patterns label in a table: whole candidates that are secrets, and long words.
SECRET, WORDS = re.compile(r"AKIA[A-Z0-9]{16}|(?=.*[0-9])[0-9a-f]{24,64}"), re.compile(r"[A-Z]?[a-z]{16,40}(?:-[a-z]+)*")


def labelled(df: DataFrame, text: str, most: int) -> list[Finding]:
    """At most ``most`` different findings that fixed patterns label in ``df``, of each label the half of lowest hash; a task passes on no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[tuple[bytes, str], int]] = [{}, {}]
        for batch in slices(batches, "__text"):
            column = batch.column("__text")
            for i in suspects(*text_bytes(column)):
                t = column[int(i)].as_py() or ""
                for a, b in candidates(t):
                    secret = bool(SECRET.fullmatch(t, a, b))
                    if secret or WORDS.fullmatch(t, a, b):
                        seen = t[max(0, a - BEFORE) : b + AFTER]
                        held[secret][hashlib.sha256(seen.encode()).digest()[:8], seen] = min(a, BEFORE)
            for k, found in enumerate(held):
                if len(found) > most:
                    held[k] = dict(sorted(found.items())[: most // 2])
        rows = [(bool(k), h, t, at) for k, found in enumerate(held) for (h, t), at in sorted(found.items())[: most // 2]]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.bool_(), pa.binary(), pa.string(), pa.int32()), strict=True)], names=["secret", "h", "t", "at"])

    found = df.select(F.col(f"`{text}`").alias("__text")).mapInArrow(run, "secret boolean, h binary, t string, at int")
    tables = Tables(df.sparkSession)
    found = tables.keep(found.groupBy("secret", "h", "t").agg(F.min("at").alias("at")))
    rows = [r for secret in (False, True) for r in found.where(F.col("secret") == secret).orderBy("h", "t").limit(most // 2).collect()]
    tables.drop(found)
    return [(r["t"], r["at"], next(b for a, b in candidates(r["t"]) if a == r["at"]), r["secret"]) for r in rows]


@dataclass
class Network:
    """Embedded letters, one convolution, the largest response of each filter, one logistic output."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    width: int = 5

    def patches(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        n = x.shape[1] - self.width + 1
        return np.concatenate([e[:, k : k + n] for k in range(self.width)], axis=2)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        patches = self.patches(x)
        raw = patches @ self.filters + self.bias
        where = raw.argmax(axis=1)
        most = np.maximum(np.take_along_axis(raw, where[:, None], 1)[:, 0], 0)
        return most @ self.out[:-1] + self.out[-1], most, where, patches

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 6, filters: int = 24, dims: int = 8, seed: int = 1) -> Network:
    """Adam on the logistic loss, batches of 64."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (256, dims)), rng.normal(0, 0.2, (5 * dims, filters)), np.zeros(filters), np.append(rng.normal(0, 0.2, filters), 0.0))
    weights = [net.embed, net.filters, net.bias, net.out]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 64):
            b, label = x[order[i : i + 64]], y[order[i : i + 64]]
            score, most, where, patches = net.forward(b)
            d = (1 / (1 + np.exp(-score)) - label) / len(b)
            d_most = d[:, None] * net.out[:-1] * (most > 0)
            chosen = patches[np.arange(len(b))[:, None], where]  # rows x filters x patch
            d_filters = np.einsum("nf,nfp->pf", d_most, chosen)
            d_chosen = (d_most[:, :, None] * net.filters.T[None]).reshape(len(b), -1, net.width, dims)
            d_embed = np.zeros_like(net.embed)
            letters = b[np.arange(len(b))[:, None, None], where[:, :, None] + np.arange(net.width)]
            np.add.at(d_embed, letters, d_chosen)
            step += 1
            for w, g, m, v in zip(weights, (d_embed, d_filters, d_most.sum(0), np.append(most.T @ d, d.sum())), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Detector:
    network: Network
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, found: list[np.ndarray]) -> np.ndarray:
        """Of each candidate, given its windows."""
        return 1 / (1 + np.exp(-(self.slope * largest_scores(self.network, found) + self.offset)))


def largest_scores(net: Network, found: list[np.ndarray]) -> np.ndarray:
    """The largest score of each candidate's windows."""
    begins = np.cumsum([0, *map(len, found)])
    return np.maximum.reduceat(net.scores(np.concatenate(found)), begins[:-1]) if found else np.empty(0)


def fit(found: list[Finding], recall: float = 0.98, seed: int = 7) -> Detector:
    """Three fifths of the labelled findings train the network, a fifth calibrates it, and the last fifth gives the thresholds.

    A kind with no secrets among the last has no threshold that keeps a recall, and is no finding. Findings are dealt out
    at random; of a long candidate in training, one window is seen.
    """
    order = np.random.default_rng(seed).permutation(len(found))
    seen = [windows(*found[i][:3]) for i in order]
    y = np.array([found[i][3] for i in order], float)
    shapes = np.array([shape(found[i][0][found[i][1] : found[i][2]]) for i in order])
    a, b = 3 * len(found) // 5, 4 * len(found) // 5
    net = train(np.array([x[i % len(x)] for i, x in enumerate(seen[:a])]), y[:a])
    raw, label = largest_scores(net, seen[a:b]), y[a:b]
    slope, offset = 1.0, 0.0
    for _ in range(25):  # Newton's method on the logistic fit, with a small ridge
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        w = p * (1 - p)
        gradient = np.array([((p - label) * raw).sum() + 0.1 * slope, (p - label).sum() + 0.1 * offset])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]]), gradient)
    made = Detector(net, float(slope), float(offset), {})
    p = made.probability(seen[b:])
    for kind in SHAPES:
        own = np.sort(p[(shapes[b:] == kind) & (y[b:] > 0)])
        made.thresholds[kind] = float(own[int((1 - recall) * len(own))]) if len(own) else math.inf
    return made


@lru_cache(maxsize=4)
def _fitted(found: tuple[Finding, ...], generated: int, recall: float, seed: int) -> Detector:
    return fit([*findings(generated, seed), *found], recall, seed)


def detector(df: DataFrame | None = None, text: str = "text", generated: int = 9000, sample: int = 2000, recall: float = 0.98, seed: int = 7) -> Detector:
    """Fitted on ``generated`` findings of the generator and at most ``sample`` that fixed patterns label in ``df``."""
    return _fitted(tuple(labelled(df, text, sample)) if df is not None else (), generated, recall, seed)


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Where runs of at least that many True begin."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2][edge[1::2] - edge[::2] >= least]


_TOKEN, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_TOKEN[np.frombuffer((string.ascii_letters + string.digits + "+/_=-").encode(), np.uint8)] = True
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows that may hold a finding: an assignment sign, an access key's beginning, or a long run."""
    at = [np.flatnonzero((data == 0x3A) | (data == 0x3D)), _runs(_HEX[data], 24), _runs(_TOKEN[data], 16)]
    a = np.flatnonzero(data[:-3] == 0x41) if len(data) > 3 else np.empty(0, np.int64)
    at.append(a[(data[a + 1] == 0x4B) & (data[a + 2] == 0x49) & (data[a + 3] == 0x41)])
    return np.unique(np.searchsorted(offsets, np.concatenate(at), "right") - 1)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``findings``, an array of (start, end, kind, probability) by start, then kind.

    The network is fitted first, on a bounded sample of the table too (see detector). Kinds assign, access and hex are the fixed patterns and have probability 1; kind model holds candidates
    outside of those that the network calls secret. Offsets are in code points, the end is exclusive. Null
    text counts as empty. Rows are looked at one by one: copies, ties and null keys need no rule.
    """
    found = detector(df, text)
    both = df.selectExpr(f"`{key}`", f"`{text}` as __text")
    field = both.schema[key]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            asked: list[tuple[int, int, int, str]] = []
            seen: list[np.ndarray] = []
            held = 0

            def ask() -> None:
                for (i, a, b, s), p in zip(asked, found.probability(seen), strict=True):
                    if p >= found.thresholds[s]:
                        out[i].append({"start": a, "end": b, "kind": "model", "probability": float(p)})
                asked.clear()
                seen.clear()

            column = batch.column("__text")
            for i in suspects(*text_bytes(column)):
                t = column[int(i)].as_py() or ""
                base = base_spans(t)
                out[i] = [{"start": a, "end": b, "kind": k, "probability": 1.0} for a, b, k in base]
                for a, b in candidates(t):
                    if not any(a < y and x < b for x, y, _ in base) and found.thresholds[kind_of := shape(t[a:b])] <= 1:
                        asked.append((int(i), a, b, kind_of))
                        seen.append(windows(t, a, b))
                        held += len(seen[-1])
                        if held > 8192:
                            ask()
                            held = 0
            ask()
            for rows in out:
                rows.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, kind)], names=[key, "findings"])

    return both.mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, findings array<struct<start:bigint,end:bigint,kind:string,probability:double>>")
