"""Conversations as one training string each, with the spans that a loss covers.

A batch's turns are laid out column by column: segment lengths (header, escaped text, footer) give
cumulative offsets, the offsets give scatter indices, and headers and contents are copied into one
preallocated buffer, which becomes the Arrow column as it is.

A turn reads ``<s>`` role line feed, text, ``</s>`` line feed. In roles and texts a backslash goes before each
backslash and behind the first character of each control string (in roles also before a line feed), so
taking a backslash away and keeping what follows it restores them, and no control string is left inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import text_bytes

BACKSLASH, LINE_FEED = 0x5C, 0x0A


@dataclass(frozen=True)
class Template:
    """Control strings hold no backslash; besides the two of the template, texts may not show the reserved ones."""

    opening: str = "<s>"
    closing: str = "</s>"
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")
    trained: str = "assistant"

    def control(self) -> tuple[str, ...]:
        return (self.opening, self.closing, *self.reserved)

    def escape(self, text: str, more: str = "") -> str:
        text = re.sub(f"[\\\\{more}]", lambda m: "\\" + m[0], text)
        found = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.control())
        return re.sub(found, r"\\", text)

    def header(self, role: str) -> str:
        return f"{self.opening}{self.escape(role, chr(LINE_FEED))}\n"

    def footer(self) -> str:
        return f"{self.closing}\n"

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of each turn; the inverse of formatting."""
        turn = re.compile(rf"{re.escape(self.opening)}((?:[^\\\n]|\\.)*)\n((?:[^\\]|\\.)*?){re.escape(self.footer())}", re.DOTALL)
        turns, at = [], 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            turns.append((unescape(m[1]), unescape(m[2])))
            at = m.end()
        return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _spread(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(values, lengths)


def _escapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, template: Template) -> np.ndarray:
    """1 for each byte before which a backslash goes, in texts that lie one after the other."""
    put = (data == BACKSLASH).astype(np.int64)
    for control in template.control():
        c = np.frombuffer(control.encode(), np.uint8)
        at = np.flatnonzero(data[: max(0, len(data) - len(c) + 1)] == c[0])
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        if len(at):
            at = at[at + len(c) <= ends[np.searchsorted(ends, at, "right")]]  # not across two texts
            put[at + 1] = 1
    return put


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray, template: Template) -> tuple[pa.Array, pa.Array]:
    """Strings and loss spans of conversations; ``turns`` holds the offsets of their rows. Spans are in code points."""
    coded = pc.fill_null(roles, "").dictionary_encode()
    names = coded.dictionary.to_pylist()
    role = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = [template.header(n).encode() for n in names]
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_size = np.array([len(h) for h in heads], np.int64)
    head_at = np.cumsum(head_size) - head_size
    foot = np.frombuffer(template.footer().encode(), np.uint8)

    data, offsets = text_bytes(texts)
    starts, ends = offsets[:-1], offsets[1:]
    put = _escapes(data, starts, ends, template)
    puts = np.concatenate([[0], np.cumsum(put)])
    size = ends - starts + puts[ends] - puts[starts]

    h = head_size[role] if len(role) else np.empty(0, np.int64)
    total = h + size + len(foot)
    ends_at = np.cumsum(total)
    at = ends_at - total
    out = np.empty(int(ends_at[-1]) if len(total) else 0, np.uint8)
    within = np.arange(int(h.sum())) - _spread(np.cumsum(h) - h, h)
    out[_spread(at, h) + within] = head_data[_spread(head_at[role], h) + within]
    to = _spread(at + h - starts - puts[starts], ends - starts) + np.arange(len(data)) + puts[1:]
    out[to] = data
    out[to[put > 0] - 1] = BACKSLASH
    out[(ends_at - len(foot))[:, None] + np.arange(len(foot))] = foot

    first = np.concatenate([at, [len(out)]])[turns]  # bytes at which the conversations begin, and the end
    if len(out) > np.iinfo(np.int32).max:
        raise ValueError("a batch of conversations exceeds 2 GB")
    strings = pa.StringArray.from_buffers(len(turns) - 1, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    whose = np.repeat(np.arange(len(turns) - 1), np.diff(turns))
    trained = np.array([n == template.trained for n in names], bool)[role] if len(role) else np.empty(0, bool)
    base = points[first[:-1]][whose]
    spans = pa.StructArray.from_arrays([pa.array((points[at + h] - base)[trained]), pa.array((points[at + h + size] - base)[trained])], names=["start", "end"])
    count = np.concatenate([[0], np.cumsum(np.bincount(whose[trained], minlength=len(turns) - 1))])
    return strings, pa.ListArray.from_arrays(pa.array(count, pa.int32()), spans)


def format_chats(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the key, ``formatted`` and ``loss_spans`` (array of start and end, in code points).

    Turns go by (turn, role, text), null first, so ties and repeated rows have one order; a null role or
    text counts as empty; rows with a null key form one conversation. Other columns are left out. A
    conversation is one value, so one task builds it; conversations are dealt out by their key.
    """
    grouped = df.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns"))
    flat = grouped.select(conv, F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    key = flat.schema[conv]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _parts(batch):
                roles, texts = rows.column("roles"), rows.column("texts")
                strings, spans = assemble(roles.flatten(), texts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64), template)
                yield pa.RecordBatch.from_arrays([rows.column(conv), strings, spans], names=[conv, "formatted", "loss_spans"])

    return flat.mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def _parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` bytes of text together; a longer conversation comes alone."""
    texts = batch.column("texts")
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = size[np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))] if batch.num_rows else size[:0]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def read_back(df: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """The turns and the text under the loss spans, parsed from ``formatted`` alone: roles, texts and loss_texts, all arrays."""
    key = df.schema[conv]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts, loss = [], [], []
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = template.parse(formatted)
                roles.append([r for r, _ in turns])
                texts.append([t for _, t in turns])
                loss.append([unescape(formatted[s["start"] : s["end"]]) for s in spans])
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(conv), batch.column("formatted"), pa.array(roles, kind), pa.array(texts, kind), pa.array(loss, kind)], names=[conv, "formatted", "roles", "texts", "loss_texts"])

    return df.select(conv, "formatted", "loss_spans").mapInArrow(run, f"`{key.name}` {key.dataType.simpleString()}, formatted string, roles array<string>, texts array<string>, loss_texts array<string>")
