"""Line dedup: one line of each group of fuzzy copies stays.

Equal lines (case and white space aside) are one class. Of a class, a signature of least hashes of its
character shingles, one for each of 40 parts of the hash range (empty parts borrow from the next full one),
makes 10 bands of 4. Classes that share a band are candidates, verified by the Jaccard similarity of their whole
shingle sets, and distributed union-find joins the links. The classes of one band meet with its heart, the
one of least hash; bands of one heart are a family. A family is dealt out in blocks of bounded rows and
bytes, its heart to each; a block compares its classes with the heart, and what isn't linked to that with all.
Of families of more than one block, what is still apart from the heart meets the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import release, slices, text_bytes
from .components import components
from .tables import BROADCAST_KEYS, Tables, small_enough
from .words import _BASE, NOT_SPACE, _powers, mix

SLICE_BYTES = 1 << 20
PARTS, ROWS = 40, 4
BANDS = PARTS // ROWS
SHINGLE = 8
#: Classes of a family in a block, and the bytes of their lines, on the average of a family's blocks.
FAMILY, FAMILY_BYTES = 256, 1 << 18
#: Rows and bytes of lines of whole blocks that are compared at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 1 << 19
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


_LETTERS = np.arange(1 << 16, dtype=np.uint64)
_LETTERS[0x41:0x5B] += np.uint64(32)
_LETTERS = mix(_LETTERS + np.uint64(1))
_POWERS = [_powers(1), _powers(1)]


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept, as slices are of one size."""
    if len(_POWERS[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Lines:
    """The lines with words of a slice, from their first to their last word: bytes, lengths in code points, and where each row's lines begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[:-1] |= data == 0x0A
        cuts = np.append(np.flatnonzero(cut), len(data))  # a line lies between two cuts
        word = np.flatnonzero(NOT_SPACE[data])
        first, end = np.searchsorted(word, cuts[:-1]), np.searchsorted(word, cuts[1:])
        full = end > first
        self.starts, self.ends = (word[first[full]], word[end[full] - 1] + 1) if len(word) else (word, word)
        self.rows = np.searchsorted(self.starts, offsets)
        points = (data & 0xC0) != 0x80
        self.points = np.concatenate([[0], np.cumsum(points)])  # code points before each byte
        self.lengths = self.points[self.ends] - self.points[self.starts]

    def classes(self) -> np.ndarray:
        """A hash of each line's letters in lower case (A-Z)."""
        powers, inverse = _both_powers(len(self.data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[self.data] * powers[:-1])])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def shingles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the chosen lines' character shingles, and where each line's begin. Lines have SHINGLE letters or more."""
        letters = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        value = _LETTERS[letters & 0xFFFF]
        rare = np.flatnonzero(letters > 0xFFFF)
        value[rare] = mix(letters[rare].astype(np.uint64) + np.uint64(1))
        powers, inverse = _both_powers(len(letters) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[:-1])])
        every = mix((total[SHINGLE:] - total[:-SHINGLE]) * inverse[: max(0, len(total) - SHINGLE)]) if len(total) > SHINGLE else total[:0]
        count = self.lengths[chosen] - SHINGLE + 1
        begins = np.cumsum(count) - count
        at = np.repeat(self.points[self.starts[chosen]] - begins, count) + np.arange(int(count.sum()))
        return every[at], np.append(begins, int(count.sum()))


def signatures(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hashes of each line's bands, from one least hash for each part of the hash range."""
    lines = len(begins) - 1
    table = np.full(lines * PARTS, _NONE, np.uint64)
    part = ((h >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
    part += np.repeat(np.arange(lines) * PARTS, np.diff(begins))
    np.minimum.at(table, part, h)
    table = table.reshape(lines, PARTS)
    # an empty part borrows from the next full one, and the distance goes into the hash
    at = np.where(np.tile(table != _NONE, 2), np.arange(2 * PARTS, dtype=np.int16), np.int16(2 * PARTS))
    full = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PARTS]
    step = (full - np.arange(PARTS, dtype=np.int16)).astype(np.uint64)
    table = np.take_along_axis(table, (full % PARTS).astype(np.int64), 1) + step * np.uint64(0x9E3779B97F4A7C15)
    bands = np.zeros((lines, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + table[:, k::ROWS])
    return bands


def _first_pass(docs: DataFrame, shortest: int) -> DataFrame:
    """id, doc, no, sure, bands: each class of a slice at its first place there, its bands null if it is short; sure: a repeat, at another place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            lines = Lines(*text_bytes(batch.column("__text")))
            row = np.repeat(np.arange(batch.num_rows), np.diff(lines.rows))
            no = np.arange(len(row)) - lines.rows[row]
            doc = batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            classes = lines.classes()
            order = np.argsort(classes, kind="stable")
            if len(doc) and (np.diff(doc) < 0).any():
                order = np.lexsort((no, doc, classes))
            c = classes[order]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            first = order[new][np.cumsum(new) - 1]
            sure = order[(doc[order] != doc[first]) | (no[order] != no[first])]
            chosen = order[new]
            long = lines.lengths[chosen] >= shortest
            h, at = lines.shingles(chosen[long])
            bands = signatures(h, at)
            both = np.concatenate([chosen, sure])
            fuzzy = np.append(long, np.zeros(len(sure), bool))
            ends = np.append(0, np.cumsum(fuzzy) * BANDS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~fuzzy, False)), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(classes[both].view(np.int64)), pa.array(doc[both]), pa.array(no[both].astype(np.int32)), pa.array(np.arange(len(both)) >= len(chosen)), lists], names=["id", "doc", "no", "sure", "bands"])

    return docs.mapInArrow(run, "id long, doc long, no int, sure boolean, bands array<long>")


def _pairs(first: DataFrame) -> DataFrame:
    """heart, digest: the classes of each band but its heart, once for all bands of one heart. A band's classes are walked one batch after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the band and the heart of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            token, digest = (batch.column(c).to_numpy() for c in ("token", "digest"))
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = last is None or last[0] != token[0]
            group = np.cumsum(new)
            heart = np.append(0 if last is None else last[1], digest[new])[group]
            last = token[-1], heart[-1]
            keep = heart != digest
            yield pa.RecordBatch.from_arrays([pa.array(heart[keep]), pa.array(digest[keep])], names=["heart", "digest"])

    tokens = first.where("bands is not null").select(F.explode("bands").alias("token"), F.col("id").alias("digest"))
    return tokens.repartition("token").sortWithinPartitions("token", "digest").mapInArrow(run, "heart long, digest long").distinct()


def _fetch(docs: DataFrame, wanted: DataFrame, shortest: int) -> DataFrame:
    """digest, line of the wanted classes, each from one of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            lines = Lines(*text_bytes(batch.column("__text")))
            chosen = np.flatnonzero(lines.lengths >= shortest)
            classes = lines.classes()
            _, first = np.unique(classes[chosen], return_index=True)
            chosen = np.sort(chosen[first])
            size = lines.ends[chosen] - lines.starts[chosen]
            ends = np.cumsum(size)
            out = lines.data[np.repeat(lines.starts[chosen] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            texts = pa.LargeStringArray.from_buffers(len(chosen), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(classes[chosen].view(np.int64)), texts], names=["digest", "line"])

    found = docs.mapInArrow(run, "digest long, line string")
    return found.join(small_enough(wanted), "digest", "left_semi").groupBy("digest").agg(F.min("line").alias("line"))


def _pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows in pieces of whole blocks, and where each piece's blocks begin (one more than blocks)."""

    def packed(t: pa.Table, edges: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        size = np.concatenate([[0], np.cumsum(pc.binary_length(t.column("line")).to_numpy())])[edges]
        at = 0
        while at < len(edges) - 1:
            to = min(np.searchsorted(edges, edges[at] + ROWS_AT_ONCE, "right"), np.searchsorted(size, size[at] + BYTES_AT_ONCE, "right")) - 1
            to = max(at + 1, int(to))
            yield t.slice(edges[at], edges[to] - edges[at]).combine_chunks(), edges[at : to + 1] - edges[at]
            at = to

    held: list[pa.RecordBatch] = []  # rows of one block
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if held and (k[:, 0] != last).any():
            cuts = np.append(0, cuts)
        if len(cuts):
            t = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
            yield from packed(t, np.concatenate([[0], cuts + (t.num_rows - cuts[-1])]) if held or cuts[0] else cuts)
            held = []
        held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        last = k[:, -1]
    if held:
        t = pa.Table.from_batches(held)
        yield from packed(t, np.array([0, t.num_rows]))


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 1,024 lines: the row and the hash (54 bits) of each shingle of its set, by row and hash, and the sizes of the sets."""
    lines = Lines(*text_bytes(texts))
    h, begins = lines.shingles(np.arange(len(lines.starts)))
    key = np.repeat(np.arange(len(lines.starts), dtype=np.uint64) << np.uint64(54), np.diff(begins)) | h >> np.uint64(10)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row = (key >> np.uint64(54)).astype(np.int64)
    return row, key & np.uint64((1 << 54) - 1), np.bincount(row, minlength=len(texts))


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _apart(row: np.ndarray, h: np.ndarray, size: np.ndarray, digest: np.ndarray, root: np.ndarray, alone: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between classes of different components, as few as join what is linked; one of each link is one of the rows ``alone``.

    ``row``, ``h``: the sets; overlaps are a product of matrices, a slice of the shingles that two sets or more hold at a time.
    """
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    feature = np.cumsum(first) - 1
    shared = np.bincount(feature) > 1 if len(h) else np.empty(0, bool)
    keep = shared[feature]
    column, row = (np.cumsum(shared) - 1)[feature[keep]], row[keep]
    common = np.zeros((len(alone), len(digest)), np.float32)
    for k in range(0, int(shared.sum()), 4096):
        part = (column >= k) & (column < k + 4096)
        m = np.zeros((len(digest), 4096), np.float32)
        m[row[part], column[part] - k] = 1
        common += m[alone] @ m.T
    similar = _linked(common, size[alone, None], size[None], percent) & (root[alone, None] != root[None])
    parent = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(similar), strict=True):
        a, b = find(int(root[alone[i]])), find(int(root[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((int(digest[alone[i]]), int(digest[j])))
    return edges


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the blocks of rows (heart, block, digest, line): all with their hearts, and of what has no link to its heart a forest."""

    def links(part: pa.Table, edges: np.ndarray) -> np.ndarray:
        digest, heart = part.column("digest").to_numpy(), part.column("heart").to_numpy()
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        row, h, size = _sets(part.column("line").combine_chunks())
        hearts = np.flatnonzero(digest == heart)
        of = np.zeros(len(edges) - 1, np.int64)
        of[group[hearts]] = hearts
        own = (group[row].astype(np.uint64) << np.uint64(54)) | h
        target = own[row == of[group[row]]]  # in order, as rows are in the order of their groups
        at = np.minimum(np.searchsorted(target, own), len(target) - 1)
        common = np.bincount(row, target[at] == own, minlength=len(digest))
        near = _linked(common, size, size[of[group]], percent)
        out = [np.stack([heart, digest])[:, near & (digest != heart)]]
        begins = np.searchsorted(row, edges)
        for g in np.flatnonzero((np.bincount(group, ~near) > 0) & (np.diff(edges) > 2)):
            a, b = edges[g], edges[g + 1]
            x, y = begins[g], begins[g + 1]
            more = _apart(row[x:y] - a, h[x:y], size[a:b], digest[a:b], np.where(near[a:b], heart[a], digest[a:b]), np.flatnonzero(~near[a:b]), percent)
            out.append(np.array(more, np.int64).reshape(-1, 2).T)
        return np.concatenate(out, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in _pieces(batches, ("heart", "block")):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(part, edges)], names=["a", "b"])
        release()

    return rows.repartition("heart", "block").sortWithinPartitions("heart", "block", "digest").select("heart", "block", "digest", "line").mapInArrow(run, "a long, b long")


def _met_apart(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the blocks of rows (heart, p, q, digest, root, alone, line) between what is alone and what is in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in _pieces(batches, ("heart", "p", "q")):
            row, h, size = _sets(part.column("line").combine_chunks())
            digest, root, alone = (part.column(c).to_numpy() for c in ("digest", "root", "alone"))
            begins = np.searchsorted(row, edges)
            out = []
            for a, b, x, y in zip(edges[:-1], edges[1:], begins[:-1], begins[1:], strict=True):
                out += _apart(row[x:y] - a, h[x:y], size[a:b], digest[a:b], root[a:b], np.flatnonzero(alone[a:b]), percent)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([j for _, j in out], pa.int64())], names=["a", "b"])
        release()

    return rows.repartition("heart", "p", "q").sortWithinPartitions("heart", "p", "q", "digest").select("heart", "p", "q", "digest", "root", "alone", "line").mapInArrow(run, "a long, b long")


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / FAMILY), F.ceil(size / FAMILY_BYTES), F.lit(1)).cast("int")


def _links(pairs: DataFrame, texts: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links (a, b) that make the components of the classes of all families. Rows grow with a family's classes, not with their square."""
    sizes = texts.select("digest", F.octet_length("line").alias("size"))
    members = pairs.union(pairs.select("heart", F.col("heart").alias("digest")).distinct())
    large = members.join(sizes, "digest").groupBy("heart").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks")).where("blocks > 1")
    large = tables.keep(large)
    count = large.count()
    block = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    if not count:
        return tables.keep(_met(members.withColumn("block", F.lit(0)).join(texts, "digest"), percent))
    dealt = members.join(F.broadcast(large) if count <= BROADCAST_KEYS else large, "heart", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    every = F.when(F.col("digest") == F.col("heart"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block(F.col("blocks"))))
    links = tables.keep(_met(dealt.select("heart", "digest", F.explode(every).alias("block")).join(texts, "digest"), percent))

    # what is in another component than the heart of its large family, against the family's other blocks
    roots = components(links, tables)
    named = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    inside = dealt.where("blocks > 1").join(named("digest"), "digest", "left").join(named("heart"), "heart", "left").join(sizes, "digest")
    inside = inside.select("heart", "digest", "size", F.coalesce("digest_root", "digest").alias("root"), (F.coalesce("digest_root", "digest") != F.coalesce("heart_root", "heart")).alias("alone"))
    inside = tables.keep(inside)
    n = lambda side: _blocks(F.count(F.when(side, 1)), F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)))
    some = inside.groupBy("heart").agg(n(F.col("alone")).alias("ones"), n(~F.col("alone")).alias("others"), F.count_if("alone").alias("left")).where("left > 0").drop("left")
    put = inside.join(F.broadcast(some) if count <= BROADCAST_KEYS else some, "heart")
    to = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    pair = lambda p, q: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"))
    own, other = block(F.col("ones")), block(F.col("others"))
    # blocks of what is alone are 0 and more and meet each other and the rest, -1 and less
    places = F.when(F.col("alone"), F.concat(to(F.col("ones"), lambda j: pair(F.least(own, j), F.greatest(own, j))), to(F.col("others"), lambda j: pair(own, -1 - j)))).otherwise(to(F.col("ones"), lambda i: pair(i, -1 - other)))
    rows = put.select("heart", "digest", "root", "alone", F.inline(places)).join(texts, "digest")
    return tables.keep(links.union(_met_apart(rows, percent)))


def dedup(df: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", shortest: int = 20) -> DataFrame:
    """``df`` with its text less the lines that repeat another, n_lines, n_compared, n_removed and removed (their numbers).

    Lines are what line feeds separate; lines without words aren't counted and stay. Two lines are copies if
    they are equal (case of A-Z and outer white space aside), or if both have ``shortest`` characters or more
    between their first and last word (at least 8) and the sets of their character shingles have a similarity of
    ``percent`` or more. Of a component the line with the lowest (key, number) stays. n_compared counts the lines
    of ``shortest`` characters. Keys are integers; rows with one key are one document, and rows without a key are
    left as they are. Null text stays null. Columns of the new names are replaced.
    """
    tables = Tables(df.sparkSession)
    names = [c for c in df.columns if c not in ("n_lines", "n_compared", "n_removed", "removed")]
    rows = df.select(*(f"`{c}`" for c in names))
    docs = rows.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text")).where("__key is not null")
    first = tables.keep(_first_pass(docs, max(shortest, SHINGLE)))
    pairs = tables.keep(_pairs(first))
    wanted = pairs.select("digest").union(pairs.select("heart")).distinct()
    texts = tables.keep(_fetch(docs, wanted, max(shortest, SHINGLE)))
    roots = components(_links(pairs, texts, percent, tables), tables)
    tables.drop(pairs, texts)

    # the first place of each class that has several lines, or of its component
    places = first.where("not sure").select("id", "doc", "no")
    lowest = places.groupBy("id").agg(F.min(F.struct("doc", "no")).alias("lowest"), F.count(F.lit(1)).alias("c"))
    lowest = tables.keep(lowest.join(roots, "id", "left").where("c > 1 or root is not null"))
    of_root = tables.keep(lowest.where("root is not null").groupBy("root").agg(F.min("lowest").alias("least")))
    lowest = lowest.join(of_root, "root", "left").select("id", F.coalesce("least", "lowest").alias("lowest"))
    repeats = places.join(lowest, "id").where((F.col("doc") != F.col("lowest.doc")) | (F.col("no") != F.col("lowest.no"))).select("doc", "no")
    gone = repeats.union(first.where("sure").select("doc", "no")).groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("__gone"))
    both = rows.join(gone.withColumnRenamed("doc", "__doc"), F.col(f"`{key}`").cast("long") == F.col("__doc"), "left").drop("__doc")
    schema = rows.withColumns({"n_lines": F.lit(0).cast("long"), "n_compared": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<int>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            column = batch.column(text)
            lines = Lines(*text_bytes(column))
            count = np.diff(lines.rows)
            marked = batch.column("__gone")
            texts, removed = column, [[]] * batch.num_rows
            found = np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False))
            if len(found):
                texts, removed = column.to_pylist(), [[] for _ in range(batch.num_rows)]
                for i in found:
                    mine = [no for no in marked[int(i)].as_py() if no < count[i]]
                    if not mine:
                        continue
                    removed[i] = mine
                    whole = texts[i].split("\n")
                    numbered = [k for k, line in enumerate(whole) if line.strip(" \t\n\x0b\x0c\r")]
                    drop = {numbered[no] for no in mine}
                    texts[i] = "\n".join(line for k, line in enumerate(whole) if k not in drop)
                texts = pa.array(texts, column.type)
            compared = np.concatenate([[0], np.cumsum(lines.lengths >= shortest)])[lines.rows]
            made = [pa.array(count), pa.array(np.diff(compared)), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(texts if c == text else batch.column(c) for c in names), *made], names=[*names, "n_lines", "n_compared", "n_removed", "removed"])

    return both.mapInArrow(run, schema)
