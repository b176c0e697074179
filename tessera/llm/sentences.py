"""Substring dedup over sliding runs of sentences.

Every run of consecutive sentences is hashed; of the runs with one hash, all but the first lose their
sentences. A slice of the table settles its own repeats: only a run's first place in the slice can be
the first of all, so a slice sends one row for each hash, and a run that a third of all documents share
comes to as many rows as there are slices. What remains is one shuffle by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices, text_bytes
from .words import Words, _powers, mix, words

SLICE_BYTES = 4 << 20
#: Runs that are compared: the number of sentences, and the words they must have together. The first kind takes more sentences where they are short.
RUNS = ((3, 10), (2, 15), (1, 25))
_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x21, 0x3F]] = True


@dataclass
class Sentences:
    """Of each sentence its first word, words and hash; where each row's sentences begin (one more than rows)."""

    words: Words
    first: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """A sentence ends with a word that ends in ``.``, ``!`` or ``?``, at a line feed, and with its row. White space and case don't count."""
    w = words(data, offsets)
    n = len(w.hashes)
    if not n:
        empty = np.empty(0, np.int64)
        return Sentences(w, empty, empty, np.empty(0, np.uint64), w.rows)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    last = _ENDS[data[w.ends - 1]]
    last[:-1] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
    last[w.rows[1:][w.rows[1:] > 0] - 1] = True
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    sizes = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, sizes)
    hashes = mix(np.add.reduceat(w.hashes * _powers(int(sizes.max()))[place], first) + sizes.astype(np.uint64))
    return Sentences(w, first, sizes, hashes, np.searchsorted(first, w.rows))


def runs(s: Sentences, kinds: tuple[tuple[int, int], ...] = RUNS) -> tuple[np.ndarray, ...]:
    """Hash, row, first sentence and number of sentences of each run."""
    out = []
    row = np.repeat(np.arange(len(s.rows) - 1), np.diff(s.rows))
    total = np.concatenate([[0], np.cumsum(s.sizes)])
    for number, (k, least) in enumerate(kinds):
        at = np.arange(max(0, len(s.hashes) - k + 1))
        size = np.full(len(at), k)
        if number == 0:  # short sentences: as many as make up the words
            size = np.maximum(k, np.searchsorted(total, total[at] + least) - at)
        ok = at + size <= s.rows[row[at] + 1] if len(at) else at > 0
        at, size = at[ok], size[ok]
        ok = total[at + size] - total[at] >= least
        at, size = at[ok], size[ok]
        h = size.astype(np.uint64)
        for j in range(int(size.max()) if len(size) else 0):
            more = j < size
            h[more] = mix(h[more] * np.uint64(0xD6E8FEB86659FD93) + s.hashes[at[more] + j])
        out.append((h, row[at], at - s.rows[row[at]], size))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_CANDIDATES = "hash long, doc long, at int, size int, sure boolean"


def _candidates(df: DataFrame, key: str, text: str, kinds: tuple[tuple[int, int], ...]) -> DataFrame:
    """Runs by hash: of a slice each hash's first by (document, sentence); the others as sure repeats, dealt out by their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            h, row, at, size = runs(sentences(*text_bytes(batch.column("__text"))), kinds)
            doc = batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            order = np.lexsort((at, doc, h))
            h, doc, at, size = h[order], doc[order], at[order], size[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            begins = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            sure = ~((doc == doc[begins][group]) & (at == at[begins][group])) if len(h) else new
            keep = new | sure  # rows with one id are one document
            sure, h = sure & ~new, np.where(sure & ~new, mix(doc.astype(np.uint64)), h)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(doc[keep]), pa.array(at[keep].astype(np.int32)), pa.array(size[keep].astype(np.int32)), pa.array(sure[keep])], names=["hash", "doc", "at", "size", "sure"])

    return df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).where("__key is not null").mapInArrow(run, _CANDIDATES)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """doc, at, size: the runs that aren't the first with their hash by (document, sentence)."""
    found = _candidates(df, key, text, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the hash of the batch before, whose first run is settled, with that run's place
        for batch in batches:
            h, doc, at, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "doc", "at", "size"))
            sure = batch.column("sure").to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            out = sure.copy()
            own = np.flatnonzero(~sure)
            if len(own):
                g = h[own]
                new = np.ones(len(g), bool)
                new[1:] = g[1:] != g[:-1]
                begins = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                first_doc, first_at = doc[own][begins], at[own][begins]
                if last is not None and last[0] == g[0]:
                    first_doc[0], first_at[0] = last[1], last[2]
                out[own] = (doc[own] != first_doc[group]) | (at[own] != first_at[group])
                last = (g[-1], first_doc[-1], first_at[-1])
            keep = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(at[keep]), pa.array(size[keep])], names=["doc", "at", "size"])

    return found.repartition("hash").sortWithinPartitions("hash", "doc", "at").mapInArrow(run, "doc long, at int, size int")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """``df`` with its text less the sentences of repeated runs, n_sentences, n_removed and removed (array of start and end, in sentences).

    The first of equal runs is that of the lowest (id, sentence); ids are integers. Rows with one id count as
    one document and are no repeats of each other; rows without an id are left as they are. Null text
    stays null and has no sentence. Columns of the new names are replaced. What follows a removed sentence
    up to the next one goes with it.
    """
    added = ("n_sentences", "n_removed", "removed")
    names = [c for c in df.columns if c not in added]
    docs = df.select(*(f"`{c}`" for c in names))
    cuts = repeats(docs, key, text, kinds).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("__cuts"))
    both = docs.join(cuts.withColumnRenamed("doc", "__doc"), F.col(key).cast("long") == F.col("__doc"), "left").drop("__doc")
    span = "array<struct<start:int,end:int>>"
    schema = docs.withColumns({"n_sentences": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.lit(None).cast(span)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            column = batch.column(text)
            data, offsets = text_bytes(column)
            s = sentences(data, offsets)
            cuts = batch.column("__cuts")
            marked = np.zeros(len(s.hashes) + 1, np.int64)
            counts = np.diff(s.rows)
            for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)):
                for c in cuts[int(i)].as_py():
                    if c["at"] + c["size"] <= counts[i]:
                        marked[s.rows[i] + c["at"]] += 1
                        marked[s.rows[i] + c["at"] + c["size"]] -= 1
            gone = np.cumsum(marked[:-1]) > 0
            texts, removed = column, [[]] * batch.num_rows
            rows = np.unique(np.searchsorted(s.rows, np.flatnonzero(gone), "right") - 1)
            if len(rows):
                texts, removed = column.to_pylist(), [[] for _ in range(batch.num_rows)]
                for i in rows:
                    a, b = s.rows[i], s.rows[i + 1]
                    begin = np.append(s.words.starts[s.first[a:b]], offsets[i + 1])
                    mine = gone[a:b]
                    keep = [data[offsets[i] : begin[0]].tobytes(), *(data[begin[j] : begin[j + 1]].tobytes() for j in np.flatnonzero(~mine))]
                    texts[i] = b"".join(keep).decode()
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                    removed[i] = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                texts = pa.array(texts, column.type)
            n_removed = np.add.reduceat(np.append(gone, False), np.minimum(s.rows[:-1], len(gone)), dtype=np.int64) * (counts > 0) if batch.num_rows else counts
            out = [*(texts if c == text else batch.column(c) for c in names), pa.array(counts), pa.array(n_removed), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(out, names=[*names, *added])

    return both.mapInArrow(run, schema)
