"""Language-model scores: a small causal self-attention model over public subword ids, trained in numpy.

The subwords are the first merges of a public byte-level BPE vocabulary. One attention layer and one
feed-forward layer read windows of 16 ids; the output is factored into a class of ids and the id within it,
with classes from a balanced split of the ids' neighbour statistics. A word's probability is mixed with its
share of the whole training corpus. Windows overlap, and each id is scored once, with two or more before it.
"""

from __future__ import annotations

import base64
import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import keep_freed, release, slices, text_bytes
from .tables import Tables, largest
from .words import _TABLE, Words, _powers, mix, words

SLICE_BYTES = 2 << 20
LENGTH, STRIDE = 16, 14
CLASSES = 64
#: Windows that go through the network at a time.
WINDOWS = 512
#: Words whose counts go to the executors, the most frequent first (12 bytes each); others are joined by their hash.
FREQUENT = 1 << 18
#: Distinct words that a counting task holds before it passes them on.
HELD = 1 << 20
#: Share of the corpus's word counts in each word's probability.
MIXED = 0.15
#: Rate at which all training texts are trained on after the start.
RATE = 0.001
#: Ids whose neighbours' counts make a row of the tasks' sums.
CHUNK_IDS = 64
#: Weights in a row of the tasks' sums.
CHUNK = 1 << 14
#: Steps whose weights are added up as 32-bit numbers.
SUMMED = 32


@lru_cache(maxsize=2)
def _encoding(path: str, ids: int) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and which of its ids begin with a space."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if int(b) < ids}
    begins = np.zeros(ids, bool)
    begins[[i for s, i in ranks.items() if s[:1] == b" "]] = True
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), begins


@lru_cache(maxsize=2)
def _spelled(path: str, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each id and the end, which has no bytes: the sum of its bytes' numbers, times a power for each place, and how many bytes it has."""
    encoding, _ = _encoding(path, ids)
    sums, sizes = np.zeros(ids + 1, np.uint64), np.zeros(ids + 1, np.int64)
    for i in range(ids):
        spelled = np.frombuffer(encoding.decode_single_token_bytes(i), np.uint8)
        sums[i], sizes[i] = (_TABLE[spelled] * _powers(len(spelled))).sum(dtype=np.uint64), len(spelled)
    return sums, sizes


class Subwords:
    """ids 0 to ``ids`` - 1 are subwords, ``ids`` is the end of a text; as an input it is the start."""

    def __init__(self, path: str, ids: int):
        self.path, self.ids = path, ids
        #: How ids are stored: the highest bit is set where a word, or an end, begins.
        self.kind = np.dtype(np.uint16 if ids < 1 << 15 else np.uint32)
        self.mark = 1 << (8 * self.kind.itemsize - 1)

    def encode(self, w: Words, data: np.ndarray) -> Coded:
        """Each distinct word is coded once, in lower case (A-Z) and with a space before it; no subword goes beyond a word."""
        hashes, first, which, count = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
        starts, size = w.starts[first], w.ends[first] - w.starts[first] + 1
        at = np.cumsum(size) - size
        text = np.full(int(size.sum()), 0x20, np.uint8)
        place = np.arange(len(text)) - np.repeat(at, size)
        letters = place > 0
        text[letters] = data[(np.repeat(starts, size) + place - 1)[letters]]
        text[(text >= 0x41) & (text <= 0x5A)] += 32
        encoding, begins_word = _encoding(self.path, self.ids)
        ids = encoding.encode_to_numpy(text.tobytes().decode(), disallowed_special=()).astype(np.int64) if len(text) else np.empty(0, np.int64)
        begins = np.flatnonzero(begins_word[ids])
        if len(begins) != len(hashes):  # a word with odd letters came apart or ran on: code them one by one
            parts = [encoding.encode_to_numpy(text[a : a + n].tobytes().decode(), disallowed_special=()).astype(np.int64) for a, n in zip(at, size, strict=True)]
            ids = np.concatenate(parts)
            begins = np.cumsum([0, *map(len, parts)])[:-1]
        return Coded(hashes, which, count, ids, np.append(begins, len(ids)), self.ids, w.rows)

    def stored(self, column: pa.Array) -> pa.Array:
        """The ids of each text and an end."""
        data, offsets = text_bytes(column)
        coded = self.encode(words(data, offsets), data)
        ids = coded.ids.copy()
        ids[coded.begins[:-1]] |= self.mark
        whole, cuts, _ = replace(coded, ids=ids, end=self.ids | self.mark).texts()
        offsets = (cuts * self.kind.itemsize).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(whole.astype(self.kind))]).cast(pa.binary())

    def loaded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, from what ``stored`` made; where each text's begin, and the end of all; where each word and each end begins."""
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // self.kind.itemsize
        if not len(column):
            return np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)
        whole = np.frombuffer(column.buffers()[2], self.kind, int(offsets[-1] - offsets[0]), int(offsets[0]) * self.kind.itemsize)
        return (whole & (self.mark - 1)).astype(np.int64), offsets - offsets[0], np.flatnonzero(whole >= self.mark)

    def read(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
        """The ids of slices of texts (__text) or of stored ids (__ids)."""
        for part in slices(batches, column, SLICE_BYTES):
            yield self.loaded(self.stored(part.column(column)) if column == "__text" else part.column(column))[0]

    def hashes(self, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A hash of each word's bytes, whichever subwords they came as; ``first``: where each word begins."""
        if not len(first):
            return np.empty(0, np.uint64)
        sums, sizes = _spelled(self.path, self.ids)
        size = sizes[whole]
        at = np.cumsum(size) - size
        place = at - np.repeat(at[first], np.diff(first, append=len(whole)))
        return mix(np.add.reduceat(sums[whole] * _powers(int(place.max()) + 1)[place], first) + np.add.reduceat(size, first).astype(np.uint64))


@dataclass
class Coded:
    """Distinct words with their subwords, and which of them each word is."""

    hashes: np.ndarray
    which: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    begins: np.ndarray
    end: int
    rows: np.ndarray

    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, an end behind each; where each row's begin; the word that each id is of, an end of one that comes after all words."""
        n = np.diff(self.begins)[self.which]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.begins[self.which] - total[:-1], n) + np.arange(int(total[-1]))
        cuts = total[self.rows] + np.arange(len(self.rows))
        out = np.full(int(cuts[-1]), self.end, np.int64)
        inside = np.ones(len(out), bool)
        inside[cuts[1:] - 1] = False
        out[inside] = self.ids[at]
        word = np.empty(len(out), np.int64)
        word[inside] = np.repeat(np.arange(len(n)), n)
        word[cuts[1:] - 1] = len(n) + np.arange(len(cuts) - 1)
        return out, cuts, word


def _blocks(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights that one product can take lie in one array: queries, keys and values side by side, biases as a last row."""
    return {
        "E": w["E"], "P": w["P"], "QKV": np.concatenate([w["Q"], w["K"], w["V"]], axis=1), "O": w["O"], "A": np.vstack([w["A"], w["a"]]), "B": w["B"],
        "C": np.vstack([w["C"], w["c"]]), "T": np.concatenate([w["T"], w["t"][:, None]], axis=1),
    }


def _apart(blocks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The single weights, as views of the blocks."""
    d = len(blocks["O"])
    q, k, v = (blocks["QKV"][:, i * d : (i + 1) * d] for i in range(3))
    a, c, t = (blocks[i] for i in "ACT")
    return {"E": blocks["E"], "P": blocks["P"], "Q": q, "K": k, "V": v, "O": blocks["O"], "A": a[:d], "a": a[d], "B": blocks["B"], "C": c[:d], "c": c[d], "T": t[:, :d], "t": t[:, d]}


def _cut(flat: np.ndarray, blocks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of ``flat`` in the shapes of ``blocks``, one after the other."""
    ends = np.cumsum([v.size for v in blocks.values()])
    return {k: flat[e - v.size : e].reshape(v.shape) for (k, v), e in zip(blocks.items(), ends, strict=True)}


def _bounded(y: np.ndarray) -> np.ndarray:
    """Exponentials, in place; what is beyond 80 counts as 80."""
    if y.size and y.max() > 80:
        np.minimum(y, 80, out=y)
    return np.exp(y, out=y)


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    class_of: np.ndarray
    place_of: np.ndarray
    #: Adam's means of gradients and of their squares, all weights' one after the other, and the steps so far.
    moments: tuple[np.ndarray, np.ndarray] | None = None
    steps: int = 0
    #: All weights one after the other, while they are trained; ``weights`` are views of it.
    flat: np.ndarray | None = None
    #: The blocks of ``flat``, and those that a step's gradient goes to.
    blocks: tuple[dict[str, np.ndarray], dict[str, np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"flat": None, "blocks": None}

    @classmethod
    def new(cls, class_of: np.ndarray, place_of: np.ndarray, dims: int, hidden: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=None: (rng.standard_normal(shape) * (by or shape[-2] ** -0.5)).astype(np.float32)
        n, k = len(class_of), int(place_of.max()) + 1
        bt = np.full((CLASSES, k), -30, np.float32)  # places that a class doesn't have
        bt[class_of, place_of] = 0
        bc = np.where(np.bincount(class_of, minlength=CLASSES) > 0, 0, -30).astype(np.float32)
        w = {
            "E": draw(n, dims, by=0.3), "P": draw(LENGTH, dims, by=0.1), "Q": draw(dims, dims), "K": draw(dims, dims), "V": draw(dims, dims), "O": draw(dims, dims, by=0.1),
            "A": draw(dims, hidden), "a": np.zeros(hidden, np.float32), "B": draw(hidden, dims, by=0.1), "C": draw(dims, CLASSES), "c": bc,
            "T": draw(CLASSES, dims, k, by=0.1), "t": bt,
        }
        return cls(w, class_of, place_of)

    def step(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of whole windows and its gradient."""
        w = _blocks(self.weights)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        return self.gradient(x, target, w, g), _apart(g)

    def gradient(self, x: np.ndarray, target: np.ndarray, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> float:
        """Mean loss of a batch of whole windows; its gradient goes to the blocks ``g``."""
        (b, n), d, kind = x.shape, w["E"].shape[1], w["E"].dtype
        ids, t = x.ravel(), target.ravel()
        rows = len(t)
        h0 = np.take(w["E"], ids, axis=0)
        h0.reshape(b, n * d)[...] += w["P"][:n].ravel()
        qkv = (h0 @ w["QKV"]).reshape(b, n, 3 * d)
        q, k, v = (qkv[:, :, i * d : (i + 1) * d] for i in range(3))
        a = q @ k.transpose(0, 2, 1)
        a *= kind.type(d**-0.5)
        _bounded(a)
        a.reshape(b, n * n)[...] *= np.tril(np.ones((n, n), kind)).ravel()
        a *= 1 / (a.reshape(rows, n) @ np.ones(n, kind)).reshape(b, n, 1)
        o = (a @ v).reshape(rows, d)
        h1, h2 = np.ones((2, rows, d + 1), kind)  # the last column takes the biases along
        np.add(h0, o @ w["O"], out=h1[:, :d])
        z = h1 @ w["A"]
        np.maximum(z, 0, out=z)
        np.add(h1[:, :d], z @ w["B"], out=h2[:, :d])

        # by class, so that each class's rows lie together
        group = self.class_of[t]
        order = np.argsort(group.astype(np.uint8), kind="stable")
        group, place = group[order], self.place_of[t[order]]
        h2 = np.take(h2, order, axis=0)
        cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        own = [(c, i, j) for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        p, s = h2 @ w["C"], np.empty((rows, w["T"].shape[2]), kind)
        for c, i, j in own:
            np.matmul(h2[i:j], w["T"][c], out=s[i:j])
        loss, by = 0.0, []
        for y, at in ((p, group), (s, place)):
            _bounded(y)
            total = y @ np.ones(y.shape[1], kind)
            at = at + np.arange(rows) * y.shape[1]
            flat = y.reshape(-1)
            made = flat[at]
            loss -= np.log(made / total + 1e-30).sum()
            flat[at] = made - total  # what is left to do is to divide by the total, which the narrower factor does
            by.append((1 / (total * rows))[:, None].astype(kind))
        np.matmul((h2 * by[0]).T, p, out=g["C"])
        dh = p @ w["C"][:d].T
        dh *= by[0]
        h2 *= by[1]
        inner = np.empty_like(dh)
        across = w["T"][:, :d].transpose(0, 2, 1)
        g["T"][np.diff(cuts) == 0] = 0
        for c, i, j in own:
            np.matmul(h2[i:j].T, s[i:j], out=g["T"][c])
            np.matmul(s[i:j], across[c], out=inner[i:j])
        inner *= by[1]
        dh += inner
        flat = inner
        flat[order] = dh

        np.matmul(z.T, flat, out=g["B"])
        dz = flat @ w["B"].T
        dz *= z > 0
        np.matmul(h1.T, dz, out=g["A"])
        flat += dz @ w["A"][:d].T
        np.matmul(o.T, flat, out=g["O"])
        do = (flat @ w["O"].T).reshape(b, n, d)
        da = do @ v.transpose(0, 2, 1)
        da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
        da *= a
        da *= kind.type(d**-0.5)
        dqkv = np.empty((b, n, 3 * d), kind)
        np.matmul(da, k, out=dqkv[:, :, :d])
        np.matmul(da.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), do, out=dqkv[:, :, 2 * d :])
        dqkv = dqkv.reshape(rows, 3 * d)
        np.matmul(h0.T, dqkv, out=g["QKV"])
        flat += dqkv @ w["QKV"].T
        g["P"][n:] = 0
        np.matmul(np.ones(b, kind), flat.reshape(b, n * d), out=g["P"][:n].reshape(-1))
        g["E"][...] = 0
        np.add.at(g["E"].reshape(-1), ((ids * d)[:, None] + np.arange(d)).ravel(), flat.reshape(-1))
        return float(loss) / rows

    def fit(self, x: np.ndarray, target: np.ndarray, rate: float) -> None:
        """A step of Adam."""
        if self.flat is None or any(v.base is not self.flat for v in self.weights.values()):
            blocks = _blocks(self.weights)
            self.flat = np.concatenate([v.ravel() for v in blocks.values()])
            self.weights = _apart(_cut(self.flat, blocks))
            self.blocks = _cut(self.flat, blocks), _cut(np.empty_like(self.flat), blocks)
        if self.moments is None:
            self.moments = np.zeros_like(self.flat), np.zeros_like(self.flat)
        first, second = self.moments  # sums with weights 0.9 ** i and 0.99 ** i: 10 and 100 times the means
        blocks, grads = self.blocks
        self.steps += 1
        self.gradient(x, target, blocks, grads)
        g = grads["E"].base
        first *= 0.9
        first += g
        second *= 0.99
        g *= g
        second += g
        np.sqrt(second, out=g)
        means = (0.01 / (1 - 0.99**self.steps)) ** 0.5
        g += 1e-8 / means
        np.divide(first, g, out=g)
        g *= rate * 0.1 / (1 - 0.9**self.steps) / means
        self.flat -= g

    def score(self, whole: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word of texts that lie one after the other; ``cuts``: where these begin, and the end of all; ``word``: the word of each id."""
        if not len(word):
            return np.zeros(0)
        begins, ends = cuts[:-1], cuts[1:]
        read = np.empty_like(whole)
        read[1:] = whole[:-1]
        read[begins] = len(self.class_of) - 1
        # window k of a text begins at k * STRIDE; the first scores all of its ids, the others those beyond the one before
        count = np.maximum(1, -(-(ends - begins - LENGTH) // STRIDE) + 1)
        text = np.repeat(np.arange(len(begins)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = begins[text] + number * STRIDE
        logs = np.empty(len(whole), np.float32)
        w, folded = _blocks(self.weights), self.folded()
        for i in range(0, len(start), WINDOWS):
            at = start[i : i + WINDOWS, None] + np.arange(LENGTH)
            inside = at < ends[text[i : i + WINDOWS], None]
            np.minimum(at, len(whole) - 1, out=at)
            h = self.last(np.where(inside, read[at], 0), w, folded)
            inside[number[i : i + WINDOWS] > 0, : LENGTH - STRIDE] = False
            scored = np.flatnonzero(inside)
            at = at.ravel()[scored]
            self.logs(h, scored, whole[at], w, logs, at)
        logs = np.maximum(logs, -30, out=logs) * np.float32(1 / np.log(10))
        return np.bincount(word, logs)

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each id and each position: itself, its query, its key and what its value adds; an input's are the sums of both."""
        w = self.weights
        by = np.concatenate([np.eye(len(w["O"]), dtype=w["E"].dtype), w["Q"] * w["Q"].dtype.type(len(w["O"]) ** -0.5), w["K"], w["V"] @ w["O"]], axis=1)
        return w["E"] @ by, w["P"] @ by

    def last(self, x: np.ndarray, w: dict[str, np.ndarray], folded: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows of the last layer, with a one behind each."""
        (b, n), d = x.shape, len(w["O"])
        h = np.take(folded[0], x.ravel(), axis=0).reshape(b, n, 4 * d)
        h.reshape(b, -1)[...] += folded[1][:n].ravel()
        h0, q, k, v = (h[:, :, i * d : (i + 1) * d] for i in range(4))
        a = _bounded(q @ k.transpose(0, 2, 1))
        a.reshape(b, n * n)[...] *= np.tril(np.ones((n, n), np.float32)).ravel()
        o = a @ v
        o *= 1 / (a.reshape(b * n, n) @ np.ones(n, np.float32)).reshape(b, n, 1)
        h1 = np.ones((b, n, d + 1), np.float32)
        np.add(h0, o, out=h1[:, :, :d])
        h1 = h1.reshape(b * n, d + 1)
        z = h1 @ w["A"]
        np.maximum(z, 0, out=z)
        h1[:, :d] += z @ w["B"]
        return h1

    def logs(self, h: np.ndarray, rows: np.ndarray, target: np.ndarray, w: dict[str, np.ndarray], out: np.ndarray, at: np.ndarray) -> None:
        """Puts the natural logarithm of each target's probability, given rows of the last layer, at its place in ``out``."""
        group = self.class_of[target]
        order = np.argsort(group.astype(np.uint8), kind="stable")
        group, place = group[order], self.place_of[target[order]]
        h = np.take(h, rows[order], axis=0)
        cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        with np.errstate(all="ignore"):  # what is too large for a float32 leaves the probability to the counts
            logits, inner = h @ w["C"], np.empty((len(h), w["T"].shape[2]), np.float32)
            for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    np.matmul(h[i:j], w["T"][c], out=inner[i:j])
            made, total = 0, 1
            for y, own in ((logits, group), (inner, place)):
                made = made + y.reshape(-1)[own + np.arange(len(h)) * y.shape[1]]
                total = total * (np.exp(y, out=y) @ np.ones(y.shape[1], np.float32))
            out[at[order]] = np.nan_to_num(made - np.log(total), nan=-100.0, neginf=-100.0, posinf=0.0)


def _column(docs: DataFrame) -> str:
    return "__ids" if "__ids" in docs.columns else "__text"


def neighbours(docs: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each id (row) comes behind each other one (column) in all of ``docs`` (__text, or stored __ids)."""
    n, column = subwords.ids + 1, _column(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n, np.int32)
        for whole in subwords.read(batches, column):
            ids = np.concatenate([[subwords.ids], whole])
            cells, found = np.unique((ids[1:] * n + ids[:-1]).astype(np.int32 if n * n < 1 << 31 else np.int64), return_counts=True)
            counts[cells] += found.astype(np.int32)
        for chunk, a in enumerate(range(0, len(counts), CHUNK_IDS * n)):
            own = counts[a : a + CHUNK_IDS * n]
            at = np.flatnonzero(own).astype(np.int32)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([own[at].tobytes()], pa.binary())], names=["chunk", "cells", "n"])
        del counts
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[int, np.ndarray] = {}
        for part in batches:
            for chunk, cells, n_own in zip(*(part.column(c) for c in ("chunk", "cells", "n")), strict=True):
                mine = added.setdefault(chunk.as_py(), np.zeros(CHUNK_IDS * n, np.int64))
                mine[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(n_own.as_buffer(), np.int32)
        for chunk, mine in added.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([mine.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "n"])

    out = np.zeros((-(-n // CHUNK_IDS) * CHUNK_IDS, n), np.float32)
    for r in docs.mapInArrow(run, "chunk int, cells binary, n binary").repartition("chunk").mapInArrow(add, "chunk int, n binary").toLocalIterator():
        out[r["chunk"] * CHUNK_IDS : (r["chunk"] + 1) * CHUNK_IDS] = np.frombuffer(r["n"], np.float32).reshape(CHUNK_IDS, n)
    return out[:n]


def classes(counts: np.ndarray, dims: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and its place there: a balanced split by the ids that come before and after it, of which ``counts`` has the numbers."""
    rng, n = np.random.default_rng(seed), len(counts)
    total = counts.sum(1, keepdims=True)
    m = counts / np.maximum(total, 1)
    np.sqrt(m, out=m)
    basis = np.linalg.qr(m.T @ (m @ rng.standard_normal((n, dims)).astype(np.float32)) + 1e-6 * rng.standard_normal((n, dims)).astype(np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(m.T @ (m @ basis) + 1e-6 * rng.standard_normal((n, dims)).astype(np.float32))[0]
    place = m @ basis
    groups = [np.arange(n)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            axis = int(np.argmax(place[g].var(axis=0))) if len(g) > 1 else 0
            order = g[np.argsort(place[g, axis], kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    class_of, place_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for c, g in enumerate(groups):
        class_of[g], place_of[g] = c, np.arange(len(g))
    return class_of, place_of


def train(whole: np.ndarray, n: int, steps: int = 2200, batch: int = 192, dims: int = 24, hidden: int = 48, seed: int = 9, counts: np.ndarray | None = None) -> Model:
    """Adam on random windows of texts that lie one after the other; ``n`` ids with the end; ``counts``: of each id's neighbours, by default those of these texts."""
    if counts is None:
        counts = np.zeros((n, n), np.float32)
        np.add.at(counts, (whole[1:], whole[:-1]), 1)
    class_of, place_of = classes(counts)
    model = Model.new(class_of, place_of, dims, hidden, seed)
    rng = np.random.default_rng(seed)
    whole = np.concatenate([np.full(1, n - 1), whole])
    if len(whole) <= LENGTH:
        return model
    for i in range(steps):
        at = rng.integers(0, len(whole) - LENGTH, batch)[:, None] + np.arange(LENGTH)
        model.fit(whole[at], whole[at + 1], 0.01 * min(1, (i + 1) / 20) * (0.5 + 0.5 * np.cos(np.pi * i / steps)))
    return model


def train_on(docs: DataFrame, subwords: Subwords, model: Model, batch: int = 192, rate: float = RATE, seed: int = 11) -> tuple[Model, int]:
    """The model after training on all windows of ``docs`` (__text, or stored __ids), and their number: each task goes on from ``model``, and the weights after all steps of all tasks are averaged."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), _column(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        own = copy.deepcopy(shared.value)
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total, recent, n = 0.0, 0.0, 0
        ids, held = np.full(1, subwords.ids), np.empty((0, LENGTH + 1), np.int64)

        def fit(windows: np.ndarray) -> None:
            nonlocal total, recent, n
            own.fit(windows[:, :-1], windows[:, 1:], rate)
            if len(windows) == batch:  # the weights after a few steps are added up in their own precision
                recent = recent + own.flat
            else:
                total = total + len(windows) * own.flat.astype(float)
            n += len(windows)
            if own.steps % SUMMED == 0:
                settle()

        def settle() -> None:
            nonlocal total, recent
            total, recent = total + batch * np.asarray(recent, float), 0.0

        for whole in subwords.read(batches, column):
            ids = np.concatenate([ids, whole])
            starts = np.arange((len(ids) - 1) // LENGTH) * LENGTH
            held = np.concatenate([held, ids[rng.permutation(starts)[:, None] + np.arange(LENGTH + 1)]])
            ids = ids[len(starts) * LENGTH :]
            for i in range(0, len(held) - batch + 1, batch):
                fit(held[i : i + batch])
            held = held[len(held) // batch * batch :]
        if len(held):
            fit(held)
        if len(ids) > 1:  # the last window is shorter
            fit(ids[None])
        if n:
            settle()
            sums = [total[i : i + CHUNK].tobytes() for i in range(0, len(total), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(np.full(len(sums), n)), pa.array(sums, pa.binary())], names=["chunk", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[int, list] = {}
        for part in batches:
            for chunk, n, sums in zip(*(part.column(c).to_pylist() for c in ("chunk", "n", "sums")), strict=True):
                mine = added.setdefault(chunk, [0, 0.0])
                mine[0] += n
                mine[1] = mine[1] + np.frombuffer(sums)
        for chunk, (n, sums) in added.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["chunk", "n", "sums"])

    kind = "chunk int, n long, sums binary"
    rows = sorted(docs.mapInArrow(run, kind).repartition("chunk").mapInArrow(add, kind).collect())
    made = Model(model.weights, model.class_of, model.place_of)
    if not rows:
        return made, 0
    mean = np.concatenate([np.frombuffer(r["sums"]) for r in rows]) / rows[0]["n"]
    made.weights = _apart(_cut(mean.astype(np.float32), _blocks(model.weights)))
    return made, rows[0]["n"]


def _held_out(doc: object) -> bool:
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 7 == 2


def _coded(docs: DataFrame, subwords: Subwords) -> DataFrame:
    """__ids instead of __text: each text's ids, as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("__key"), part.column("__trains"), subwords.stored(part.column("__text"))], names=["__key", "__trains", "__ids"])

    return docs.mapInArrow(run, f"__key {docs.schema['__key'].dataType.simpleString()}, __trains boolean, __ids binary")


def _word_counts(coded: DataFrame, subwords: Subwords) -> DataFrame:
    """kind 0: hash and count of the training words of a task; kind 1: the number of its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        texts = 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        for part in slices(batches, "__ids", SLICE_BYTES):
            keep = np.array([not _held_out(d) for d in part.column("__key").to_pylist()], bool)
            part = part.filter(pa.array(keep))
            if not part.num_rows:
                continue
            whole, _, first = subwords.loaded(part.column("__ids"))
            texts += part.num_rows
            own, n = np.unique(subwords.hashes(whole, first)[whole[first] != subwords.ids], return_counts=True)
            held, which = np.unique(np.concatenate([held, own]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([counts, n]), len(held)).astype(np.int64)
            if len(held) > HELD:
                yield rows(0, held.view(np.int64), counts)
                held, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield rows(0, held.view(np.int64), counts)
        yield rows(1, np.zeros(1, np.int64), np.array([texts]))

    return coded.mapInArrow(run, "kind byte, key long, n long")


def _mixed(own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of each word's probability: the network's, whose natural logarithm is ``own``, mixed with the word's share of the training words."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(1 - MIXED) + own, np.log(MIXED * share)) / np.log(10)


def _start(training: DataFrame, sample: int, chars: int) -> list[str]:
    """Whole texts in the order of their hashes, as many as reach ``chars`` characters; only of one that is longer than that, its beginning."""
    lowest = training.select("__h").distinct().orderBy("__h").limit(sample)
    few = training.join(F.broadcast(lowest), "__h", "left_semi").select("__h", F.substring("__text", 1, chars).alias("t")).dropDuplicates(["__h"])
    texts, size = [], 0
    for r in few.orderBy("__h").toLocalIterator():
        if size >= chars:
            break
        texts.append(r["t"])
        size += len(r["t"])
    return texts


def score(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: int = 4096, sample: int = 3000, sample_chars: int = 6_000_000, **options) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are coded once; all that follows reads the ids from a table. Words are counted over all training rows, those whose key's crc32 modulo 7 isn't 2 (a null key counts
    as an empty text), and the counts are half of the model: a word's probability is the mean of the network's
    and its share of the training words; those beyond the FREQUENT most frequent get theirs by a join. The network's
    classes come from the neighbours of all ids of all training texts. It is trained first on at most ``sample`` of them,
    those whose hashes are lowest, whole texts until they have ``sample_chars`` characters, which gives the tasks a common
    beginning, and then on every window of all training texts. A null
    text counts as empty: it is one end. Rows with one key are rows of their own.
    """
    subwords = Subwords(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids)
    tables = Tables(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    crc = F.crc32(F.coalesce(F.col("__key").cast("string"), F.lit("")).cast("binary"))
    trains = F.coalesce((crc % 7 != 2) & (F.length("__text") > 0), F.lit(False))
    coded = tables.keep(_coded(docs.select("__key", trains.alias("__trains"), "__text"), subwords))
    found = tables.keep(_word_counts(coded, subwords).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counted = found.where("kind = 0").select("key", "n")
    n_texts = found.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = totals["n"] + n_texts, totals["v"] + (n_texts > 0)

    top = largest(counted, "n", FREQUENT).toArrow()
    hashes, n_top = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hashes)

    texts = _start(docs.where(trains).select("__text", F.xxhash64("__key", "__text").alias("__h")), sample, sample_chars)
    training = coded.where("__trains").select("__ids")
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    model = train(subwords.encode(words(data, offsets), data).texts()[0], ids + 1, counts=neighbours(training, subwords), **options)
    model, _ = train_on(training, subwords, model)
    shared = df.sparkSession.sparkContext.broadcast((model, hashes[order], n_top[order]))
    end = float(np.log10(n_texts + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model, hashes, counts = shared.value
        logs = np.log10(counts + 1.0)
        at_row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "__ids", SLICE_BYTES):
            whole, cuts, first = subwords.loaded(batch.column("__ids"))
            word = np.repeat(np.arange(len(first)), np.diff(first, append=len(whole)))
            n = np.diff(np.searchsorted(first, cuts))  # words and an end
            row = np.repeat(np.arange(len(n)), n)
            key, ends = subwords.hashes(whole, first), whole[first] == subwords.ids
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
                known = (hashes[at] == key) & ~ends
                base, share = np.bincount(row, np.where(known, logs[at], 0), len(n)), np.where(known, counts[at], 0)
            else:
                known, base, share = np.zeros(len(row), bool), np.zeros(len(n)), np.zeros(len(row))
            share = np.where(ends, n_texts, share) / max(1, n_train)
            own = model.score(whole, cuts, word) * np.log(10)
            mixed = np.bincount(row, _mixed(own, share), len(n))
            tail = ~(known | ends)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row[tail], minlength=len(n)))])
            rare = pa.StructArray.from_arrays([pa.array(key[tail].view(np.int64)), pa.array(own[tail])], names=["key", "own"])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rare)
            keys = batch.column("__key")
            made = [
                pa.array(at_row + np.arange(len(n))), keys, pa.array([_held_out(d) for d in keys.to_pylist()], pa.bool_()), pa.array(n),
                pa.array(np.bincount(row[known], minlength=len(n)).astype(np.int64) + (n_texts > 0)), pa.array(base + end), pa.array(mixed), lists,
            ]
            at_row += len(n)
            yield pa.RecordBatch.from_arrays(made, names=["row", "__key", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    kind = docs.schema["__key"].dataType.simpleString()
    scored = tables.keep(coded.mapInArrow(run, f"row long, __key {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<key:long,own:double>>"))
    tables.drop(coded)
    # so far the share of these is 0 in the score: log(1 + share part / network part) is missing
    ratio = F.log(F.col("n") * (MIXED / (1 - MIXED) / max(1, n_train))) - F.col("own")
    missing = (F.greatest(ratio, F.lit(0.0)) + F.log1p(F.exp(-F.abs(ratio)))) / float(np.log(10))
    rare = scored.select("row", F.inline("tail")).join(counted, "key").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("more_known"), F.sum(missing).alias("more_score"))
    whole = scored.drop("tail").join(rare, "row", "left")
    divisor = float(np.log10(n_train + v_train + 1))
    return whole.select(
        F.col("__key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
