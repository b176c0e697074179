"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list; a heap holds the merge rank of each adjacent pair, and
an entry whose symbols have changed meanwhile is stale and skipped. Decoding joins the vocabulary's
strings with one space, which is what the library does for a file without a decoder.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer as Library

from .batches import release, slices

#: White space as the vocabulary file's patterns mean it; str.split() also takes U+001C to U+001F.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Chunks whose letters are the same in all Unicode versions.
FAMILIAR = regex.compile(r"\A[!-~¡-ɏ]*+\Z")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Chunks between white space that a task remembers in each of two generations; when the younger is full, the older goes.
REMEMBERED = 150_000
#: Marks of chunks met once; one is remembered when it is met again, as most come once only.
MARKS = 1 << 22
#: Texts coded together; what is made of them on the way is some 20 times as large.
BATCH_BYTES = 2 << 20

OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_text": pa.string(), "decoded": pa.string()}
_TYPES = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_text": T.StringType(), "decoded": T.StringType()}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one of those from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """The merges by rank. A pair of ids is one number, and so is a heap's entry: its rank, then its place."""

    def __init__(self, merges: list, vocabulary: dict[str, int]):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.pair = [vocabulary[a] << 32 | vocabulary[b] for a, b in pairs]
        self.whole = [vocabulary[a + b] for a, b in pairs]
        self.rank = {p: r for r, p in enumerate(self.pair)}

    def apply(self, symbols: list[int]) -> list[int]:
        """Applies the merge of least rank, the leftmost first, until none is left. Changes ``symbols``."""
        n = len(symbols)
        rank, pair_of = self.rank.get, self.pair
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] << 32 | symbols[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        if not heap:
            return symbols
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j == n or symbols[i] << 32 | symbols[j] != pair_of[r]:
                continue  # stale: one of the two has been merged since
            symbols[i] = whole = self.whole[r]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank(whole << 32 | symbols[k])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            k = before[i]
            if k >= 0:
                r = rank(symbols[k] << 32 | whole)
                if r is not None:
                    heapq.heappush(heap, r << 32 | k)
        return [s for s in symbols if s >= 0]


class Tokenizer:
    """Reads the vocabulary, merges, special tokens and split rule of a ``tokenizers`` file with word ends; each byte is one letter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.merges = Merges(model["merges"], vocabulary)
        letters = byte_letters()
        self.inner, self.last = [vocabulary[x] for x in letters], [vocabulary[x + end] for x in letters]
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.plain = regex.compile(split["pattern"]["Regex"]).findall
        self.pieces = Library.from_file(path).pre_tokenizer.pre_tokenize_str
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.merged: dict[bytes, bytes] = {}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        strings = {i: s for s, i in (vocabulary | self.special).items()}
        #: Each id's vocabulary string, and the id in decimal.
        self.strings = pa.array([strings.get(i, "") for i in range(max(strings) + 1)], pa.string())
        self.decimals = pa.array(map(str, range(len(self.strings))), pa.string())
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met = bytearray(MARKS)

    def chunk(self, chunk: str) -> bytes:
        """The ids of a normalized chunk without white space, four bytes each."""
        if FAMILIAR.search(chunk):
            pieces = [p.encode() for p in self.plain(chunk)]
        else:  # which letters there are depends on the Unicode version; the library's own decides
            pieces = [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.pieces(chunk)]
        out = []
        for piece in pieces:
            if (ids := self.merged.get(piece)) is None:
                symbols = [*map(self.inner.__getitem__, piece)]
                symbols[-1] = self.last[piece[-1]]
                ids = array("i", self.merges.apply(symbols)).tobytes()
                if self.again(piece):
                    if len(self.merged) > REMEMBERED:
                        self.merged.clear()
                    self.merged[piece] = ids
            out.append(ids)
        return b"".join(out)

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter by itself: no final sigma
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        text = self.normalized(text)
        return [c for c in SPACE.split(text) if c] if ODD_SPACE.search(text) else text.split()

    def chunk_codes(self, chunk: str) -> bytes:
        """As ``chunk``, which is asked for those only that aren't remembered."""
        if (found := self.young.get(chunk)) is None:
            if (found := self.old.get(chunk)) is None:
                found = self.chunk(chunk)
                if not self.again(chunk):
                    return found
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            self.young[chunk] = found
        return found

    def again(self, key: str | bytes) -> bool:
        """Whether the key has been met before, or one with the same mark."""
        mark = hash(key) % MARKS
        met, self.met[mark] = self.met[mark], 1
        return bool(met)

    def forget(self) -> None:
        """Gives the memory of what is remembered back: a worker outlives its task, beside others."""
        self.young, self.old, self.merged = {}, {}, {}
        self.met = bytearray(MARKS)
        release()

    def codes(self, text: str) -> np.ndarray:
        """The ids of a text, in which special tokens may stand."""
        ids, at = [], 0
        for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
            ids += map(self.chunk_codes, self.chunks(text[at : m.start() if m else len(text)]))
            if m:
                ids.append(array("i", [self.special[m[0]]]).tobytes())
                at = m.end()
        return np.frombuffer(b"".join(ids), np.int32)

    def encode(self, text: str) -> tuple[str, str]:
        """Ids in decimal and vocabulary strings, both joined with one space."""
        ids = self.codes(text)
        rows = np.array([0, len(ids)], np.int32)
        return joined(self.decimals, ids, rows)[0].as_py(), joined(self.strings, ids, rows)[0].as_py()

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts one after the other, and where each text's begin (one more than texts); each distinct chunk is looked up once."""
        special = {i for i, t in enumerate(texts) if t and self.specials and "<" in t and self.specials.search(t)}
        spaced = pa.array([" ".join(self.chunks(t)) if t and i not in special else "" for i, t in enumerate(texts)], pa.large_string())
        lists = pc.split_pattern(spaced, " ")
        coded = lists.values.dictionary_encode()
        parts = [self.chunk_codes(c) if c else b"" for c in coded.dictionary.to_pylist()]
        pool, sizes = np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        which = coded.indices.to_numpy()
        ends = np.cumsum(sizes[which])
        place = np.arange(int(ends[-1]) if len(ends) else 0)
        place += np.repeat((np.cumsum(sizes) - sizes)[which] - ends + sizes[which], sizes[which])
        ids, rows = pool[place], np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        if special:
            own = [self.codes(t) if i in special else ids[rows[i] : rows[i + 1]] for i, t in enumerate(texts)]
            ids, rows = np.concatenate(own), np.cumsum([0, *map(len, own)])
        return ids, rows.astype(np.int32)


def joined(strings: pa.Array, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The ids' strings, those of each row joined with one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(rows), strings.take(pa.array(ids))), " ")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), carry: tuple[str, ...] | None = None) -> DataFrame:
    """Each row's columns ``carry`` (all by default) with the outputs named.

    n_tokens: tokens; ids: array<int>; ids_text: the ids in decimal, joined with one space; decoded: the
    text of the ids. An output replaces an input column of its name. Null text counts as empty: no
    token, and an empty decoded text. Rows are neither joined nor ordered, so ties and copies need no
    rule. ``path`` is that of the vocabulary file, which every executor must be able to read.
    """
    names = [c for c in (df.columns if carry is None else carry) if c not in outputs]
    both = df.select(*(_quoted(c) for c in names), _quoted(text).alias("__text"))
    schema = both.select(*(_quoted(c) for c in names)).schema
    for c in outputs:
        schema = schema.add(c, _TYPES[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in slices(batches, "__text", BATCH_BYTES):
            ids, rows = bpe.encode_batch(batch.column("__text").to_pylist())
            made = {
                "n_tokens": lambda: pa.array(np.diff(rows).astype(np.int64)),
                "ids": lambda: pa.ListArray.from_arrays(pa.array(rows), pa.array(ids)),
                "ids_text": lambda: joined(bpe.decimals, ids, rows),
                "decoded": lambda: joined(bpe.strings, ids, rows),
            }
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(made[c]() for c in outputs)], names=[*names, *outputs])
        bpe.forget()

    return both.mapInArrow(run, schema)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
