"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard's words become numbers in the order of its vocabulary, with a separator after each text. The
Burrows-Wheeler transform of the whole sequence lies in a wavelet matrix, whose ranks drive the backward search
of all phrases at once; sampled suffix positions locate the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, text_bytes
from .tables import Tables
from .words import LETTERS, words

#: Bytes of text in a shard, and of benchmark text that goes to the executors at once; a window of ten words takes 80 bytes there.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20


class WaveletMatrix:
    """Ranks of symbols in a sequence, one row of counted bits for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (sequence >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bits) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            one = (symbol >> level & 1).astype(bool)
            a, b = ones[start], ones[end]
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; the sequence ends with a symbol below all others.

    A suffix's rank is the first place of its group of equals; only groups of several are sorted again.
    """
    n = len(sequence)
    key = sequence * (int(sequence.max()) + 2)
    key[:-1] += sequence[1:] + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 2
    places = np.flatnonzero(~(new & np.append(new[1:], True)))  # of groups of several
    while len(places):
        suffix = order[places]
        beyond = suffix + width
        follow = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + follow
        again = np.argsort(key, kind="stable")
        suffix, key = suffix[again], key[again]
        order[places] = suffix
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffix] = places[new][np.cumsum(new) - 1]
        places = places[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class FMIndex:
    def __init__(self, sequence: np.ndarray, symbols: int, sample: int = 8):
        """``sequence``: numbers below ``symbols``; 0 ends it and is nowhere else at its end twice."""
        order = suffix_array(sequence)
        self.bwt = sequence[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.matrix = WaveletMatrix(self.bwt, symbols)
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.size = len(sequence)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes that begin with each phrase, of one length: first, and beyond the last."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        active = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[active, k]
            a = self.before[symbol] + self.matrix.rank(symbol, low[active])
            b = self.before[symbol] + self.matrix.rank(symbol, high[active])
            low[active], high[active] = a, b
            active = active[b > a]
            if not len(active):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes: steps back to one whose position is kept."""
        rows = rows.copy()
        out, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            here = rows[left]
            done = self.sampled[here]
            out[left[done]] = self.samples[self.sample_rank[here[done]]] + steps
            left = left[~done]
            symbol = self.bwt[rows[left]]
            rows[left] = self.before[symbol] + self.matrix.rank(symbol, rows[left])
            steps += 1
        return out


@dataclass
class Phrases:
    """The windows of benchmark items as numbers over their vocabulary, by length, and the items of each."""

    vocabulary: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # windows, items, where each window's items begin
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Phrases:
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        w = words(data, offsets, LETTERS)
        vocabulary = np.unique(w.hashes)
        code = np.searchsorted(vocabulary, w.hashes) + 1
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, (a, b) in enumerate(zip(w.rows[:-1], w.rows[1:], strict=True)):
            if b > a:
                n = min(window, int(b - a))
                runs = np.lib.stride_tricks.sliding_window_view(code[a:b], n)
                parts.setdefault(n, []).append((runs, np.full(len(runs), i)))
        by_length = []
        for _, found in sorted(parts.items()):
            runs, item = np.concatenate([r for r, _ in found]), np.concatenate([i for _, i in found])
            distinct, which = np.unique(runs, axis=0, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) * len(items) + item)
            by_length.append((distinct, pairs % len(items), np.searchsorted(pairs // len(items), np.arange(len(distinct) + 1))))
        return cls(vocabulary, by_length, [n for n, _ in items])


def occurrences(hashes: np.ndarray, rows: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a shard lie in an occurrence, and the (row, item) pairs, as row times items plus item.

    ``hashes``: the shard's words; ``rows``: where each row's words begin.
    """
    hit, n_items = np.zeros(len(hashes) + 1, np.int64), max(1, len(phrases.names))
    pairs = [np.empty(0, np.int64)]
    if not phrases.by_length or not len(hashes):
        return hit[:-1] > 0, pairs[0]
    vocabulary, code = np.unique(hashes, return_inverse=True)
    # 0 ends the sequence, 1 follows each row, words are 2 and more
    n = np.diff(rows)
    sequence = np.ones(len(hashes) + len(n) + 1, np.int64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)
    sequence[place] = code + 2
    sequence[-1] = 0
    word = np.zeros(len(sequence), np.int64)
    word[place] = np.arange(len(hashes))
    index = FMIndex(sequence, len(vocabulary) + 2)
    at = np.minimum(np.searchsorted(vocabulary, phrases.vocabulary), len(vocabulary) - 1)
    symbol = np.append(-1, np.where(vocabulary[at] == phrases.vocabulary, at + 2, -1))  # of the benchmark's words, -1: not in the shard
    for windows, items, first in phrases.by_length:
        coded = symbol[windows]
        there = np.flatnonzero((coded >= 0).all(axis=1))
        low, high = index.search(coded[there])
        count = np.maximum(high - low, 0)
        found = np.flatnonzero(count)
        if not len(found):
            continue
        which = np.repeat(there[found], count[found])
        suffix = np.repeat(low[found], count[found]) + np.arange(len(which)) - np.repeat(np.cumsum(count[found]) - count[found], count[found])
        at = word[index.locate(suffix)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + windows.shape[1], -1)
        row = np.searchsorted(rows, at, "right") - 1
        each = np.unique(row * len(windows) + which)
        row, which = each // len(windows), each % len(windows)
        n = first[which + 1] - first[which]
        item = items[np.repeat(first[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        pairs.append(np.repeat(row, n) * n_items + item)
    return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items, once each, in blocks of bounded size."""
    rows = benchmark.selectExpr(f"cast(`{item}` as string) as item", f"`{text}` as text").where("item is not null and text is not null").distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text.encode()) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += len(r.text.encode())
    yield block


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """``df`` with n_words, hit_spans (merged, in words, end exclusive), cut_spans (the same in code points) and items (ids as strings, sorted).

    Columns of these names are replaced. Null text has no words. Rows are looked at one by one against the
    whole benchmark, which goes to the executors in blocks of bounded size, one pass for each, whose result is
    written before the next; items without an id or a text are left out, repeated ones count once.
    """
    added = ("n_words", "hit_spans", "cut_spans", "items")
    out, tables, shared, before = df.drop(*added), Tables(df.sparkSession), None, None
    for k, items in enumerate(_blocks(benchmark, item, item_text)):
        if k:
            out = tables.keep(out)
            shared.destroy()
            if before is not None:
                tables.drop(before)
            before = out
        shared = df.sparkSession.sparkContext.broadcast(Phrases.of(sorted(items), window))
        out = _pass(out, shared, text, added, k == 0)
    return out


def cut(found: DataFrame, text: str = "text") -> DataFrame:
    """The text without the cut_spans that find() has given it; null stays null."""
    t = F.col(f"`{text}`")
    end = lambda i: F.when(i > 0, F.get("cut_spans", i - 1)["end"]).otherwise(F.lit(0))
    kept = F.array_join(F.transform("cut_spans", lambda s, i: F.substr(t, (end(i) + 1).cast("int"), (s["start"] - end(i)).cast("int"))), "")
    last = F.substr(t, (end(F.size("cut_spans")) + 1).cast("int"))
    return found.withColumn(text, F.when(F.size("cut_spans") > 0, F.concat(kept, last)).otherwise(t))


def _pass(df: DataFrame, shared: Broadcast[Phrases], text: str, added: tuple[str, ...], first: bool) -> DataFrame:
    names = [c for c in df.columns if c not in added]
    schema = df.select(*(f"`{c}`" for c in names)).schema.add("n_words", "long")
    spans = df.sparkSession.range(0).selectExpr("array(struct(id as start, id as end)) as s", "array(cast(id as string)) as i").schema
    schema = schema.add("hit_spans", spans["s"].dataType).add("cut_spans", spans["s"].dataType).add("items", spans["i"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        n_items = max(1, len(phrases.names))
        for batch in slices(batches, text, SHARD_BYTES):
            column = batch.column(text)
            data, offsets = text_bytes(column)
            w = words(data, offsets, LETTERS)
            hit, pairs = occurrences(w.hashes, w.rows, phrases)
            n = batch.num_rows
            old = (lambda c: batch.column(c).to_pylist()) if not first else (lambda c: [[]] * n)
            items, in_words, in_points = ([list(x) for x in old(c)] for c in ("items", "hit_spans", "cut_spans"))
            for p in pairs:
                items[p // n_items].append(phrases.names[p % n_items])
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            begins = np.flatnonzero(edge == 1)
            for a in begins:
                row = int(np.searchsorted(w.rows, a, "right") - 1)
                while hit[a : a + 1].any():  # a run of hit words, cut where rows end
                    b = a + 1
                    while b < w.rows[row + 1] and hit[b]:
                        b += 1
                    in_words[row].append({"start": int(a - w.rows[row]), "end": int(b - w.rows[row])})
                    whole = data[offsets[row] : offsets[row + 1]].tobytes()
                    x, y = (int(v - offsets[row]) for v in (w.starts[a], w.ends[b - 1]))
                    before = len(whole[:x].decode())
                    in_points[row].append({"start": before, "end": before + len(whole[x:y].decode())})
                    a = b
                    if b < w.rows[row + 1] or b >= len(hit):
                        break
                    row = int(np.searchsorted(w.rows, b, "right") - 1)
            if not first:
                merge = lambda s: [{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in s])]
                in_words, in_points = [merge(s) for s in in_words], [merge(s) for s in in_points]
            made = [pa.array(np.diff(w.rows)), pa.array(in_words, _SPANS), pa.array(in_points, _SPANS), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *added])

    return df.mapInArrow(run, schema)
