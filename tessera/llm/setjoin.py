"""Exact similarity self-join of the word-shingle sets of documents, as connected components.

1. One pass over the texts gives every document its set's size, a 64-bit digest (documents with one set are
   one class), and the shingles that many sets of a slice share.
2. An index lists, under every shingle of a set's prefix, the classes by position. Prefixes begin with rare
   shingles and are long enough that linked sets share several: a set of n shingles lists
   n - ceil(t n) + 1 + n div 20 of them, and sets that share fewer than 1 + n div 20 of them are no match. Of a
   prefix shingle that no other class lists, and that comes before a shared one, both sets can't have a copy.
3. In every list the class with the smallest part of such shingles, the heart of a family of near copies, is
   compared with the others. The components of the links found settle, for every set, its answers among the
   sets highly similar to it.
4. Lists are walked in blocks, and a block is skipped if the positions in it leave too little overlap, or if
   the answers are already known because both classes are in one component.
5. What is left is verified on the whole sets, and all links together give the components.

No step collects more than the fixed number of frequent shingles whose order decides nothing but cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices, text_bytes
from .components import components
from .tables import Tables, largest, small_enough
from .words import distinct_sets, mix, shingles, words

SLICE_BYTES = 4 << 20
#: Frequent shingles whose counts are sent to the executors, the most frequent first: 12 bytes each.
FREQUENT = 500_000
#: A shingle is frequent from this many sets on, counted where a slice has two or more.
RARE = 16
BLOCK = 256
#: Pairs that a task holds to add them up before it passes them on.
HELD = 1 << 20


def _sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles, where each row's begin, and each row's digest (0: no shingle)."""
    h, rows = distinct_sets(*shingles(words(*text_bytes(batch.column("__text"))), n))
    return h, rows, mix(_sums(mix(h), rows) + np.diff(rows).astype(np.uint64)) * (np.diff(rows) > 0).astype(np.uint64)


def _sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[rows[1:]] - total[rows[:-1]]


def _one_each(digest: np.ndarray) -> np.ndarray:
    """The first row of each digest but 0."""
    _, first = np.unique(digest, return_index=True)
    return np.sort(first[digest[first] != 0])


def _gather(h: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the chosen rows, and which of the chosen each is of."""
    size = np.diff(rows)[chosen]
    at = np.repeat(rows[:-1][chosen] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return h[at], np.repeat(np.arange(len(chosen)), size)


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"))


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: a document (id, size, digest); kind 1: a shingle (size: sets of the slice, digest: its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            h, rows, digest = _sets(batch, n)
            own, _ = _gather(h, rows, _one_each(digest))
            shared, count = np.unique(own, return_counts=True)
            shared, count = shared[count > 1], count[count > 1]
            names = ["kind", "doc", "size", "digest"]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(digest), np.int8)), batch.column("__key"), pa.array(np.diff(rows)), pa.array(digest.view(np.int64))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(shared), np.int8)), pa.nulls(len(shared), pa.int64()), pa.array(count.astype(np.int64)), pa.array(shared.view(np.int64))], names=names)

    return docs.mapInArrow(run, "kind byte, doc long, size long, digest long")


def _prefixes(docs: DataFrame, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, digest, size, at: the index entries of the classes of each slice."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for batch in slices(batches, "__text", SLICE_BYTES):
            h, rows, digest = _sets(batch, n)
            chosen = _one_each(digest[np.flatnonzero(batch.column("__key").is_valid().to_numpy(zero_copy_only=False))]) if batch.column("__key").null_count else _one_each(digest)
            if batch.column("__key").null_count:
                chosen = np.flatnonzero(batch.column("__key").is_valid().to_numpy(zero_copy_only=False))[chosen]
            own, which = _gather(h, rows, chosen)
            rank = np.zeros(len(own), np.int64)
            if len(tokens) and len(own):
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                rank = np.where(tokens[at] == own, counts[at], 0)
            frequent_first = np.flatnonzero(rank)
            order = np.arange(len(own))
            if len(frequent_first):  # rows are sorted by hash already; only frequent shingles move back
                order = np.lexsort((own, rank, which))
            size = np.diff(rows)[chosen]
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            most = size - -(-percent * size // 100) + 1 + size // 20
            keep = place < most[which]
            own, which, place = own[order][keep], which[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(digest[chosen][which].view(np.int64)), pa.array(size[which].astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "digest", "size", "at"])

    return docs.mapInArrow(run, "token long, digest long, size int, at int")


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The sorted rows in pieces that hold whole groups of the first column."""
    held: list[list[np.ndarray]] = []  # of one group
    whole = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(now[0]):
            continue
        others = np.flatnonzero(now[0] != now[0][-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if held and (cut or held[0][0][0] != now[0][0]):
            yield whole([*held, [x[:cut] for x in now]])
            held = []
        elif cut:
            yield [x[:cut] for x in now]
        held.append([x[cut:] for x in now])
    if held:
        yield whole(held)


def lists_of(entries: DataFrame) -> DataFrame:
    """The entries of tokens that two classes or more list; copies of a class in other slices go. A token's list is walked, not held."""
    names = ["token", "digest", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False  # the last row, and whether the class before it lists its token too
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if not len(now[0]):
                continue
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held is not None else now
            token, digest = now[:2]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
            now = [x[new] for x in now]
            same = np.append(before, now[0][1:] == now[0][:-1])
            keep = np.append(same[:-1] | same[1:], False)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in now], names=names)
            held, before = [x[-1:] for x in now], bool(same[-1])
        if before:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=names)

    return entries.repartition("token").sortWithinPartitions("token", "digest").mapInArrow(run, "token long, digest long, size int, at int")


#: Columns of the index's lists. ``before``: how many shingles before this one in the prefix no other class lists.
LISTED = ("token", "digest", "size", "at", "before", "root")


def _matches(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Whether pairs of entries (digest, size, at, before, root) can still be linked and aren't settled."""
    (da, na, pa_, ua, ra), (db, nb, pb, ub, rb) = a, b
    overlap = np.minimum(pa_ - ua, pb - ub) + np.minimum(na - pa_, nb - pb)
    return (ra != rb) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * overlap >= percent * (na + nb)) & (da != db)


def pairs_of(lists: DataFrame, percent: int) -> DataFrame:
    """Classes (a, b) that share tokens, may be linked and aren't in one component: sizes (na, nb), last shared positions (pa, pb), shared tokens c.

    Lists lie by their heart, so the lists of one family are walked together and a pair comes once from each
    family, not from each token; a pair may still have several rows, to be added up.
    """
    names = ["a", "b", "na", "nb", "pa", "pb", "c"]

    def emit(i: np.ndarray, j: np.ndarray, x: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        ok = _matches(tuple(v[i] for v in x), tuple(v[j] for v in x), percent)
        i, j = i[ok], j[ok]
        digest, size, at = x[0], x[1].astype(np.int32), x[2].astype(np.int32)
        i, j = np.where(digest[i] < digest[j], i, j), np.where(digest[i] < digest[j], j, i)
        return [digest[i], digest[j], size[i], size[j], at[i], at[j], np.ones(len(i), np.int32)]

    def added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        a, b, na, nb, at, bt, c = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b, na, nb, at, bt, c = (v[order] for v in (a, b, na, nb, at, bt, c))
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        if not len(new):
            return [a, b, na, nb, at, bt, c]
        return [a[new], b[new], na[new], nb[new], np.maximum.reduceat(at, new), np.maximum.reduceat(bt, new), np.add.reduceat(c, new).astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for part in walk(batches):
            held.append(part)
            size += len(part[0])
            if size > HELD:
                held = [added(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, added(held))), names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for token, *rest in _groups(batches, LISTED):
            x = tuple(v.astype(np.int64) for v in rest)
            edges = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            size = np.diff(edges)
            few = np.repeat(size <= BLOCK, size)
            after = np.repeat(edges[1:], size) - np.arange(len(token)) - 1
            ids = np.flatnonzero(few & (after > 0))
            for k in range(0, len(ids), 20_000):  # short lists: every pair, some at a time
                part = ids[k : k + 20_000]
                n = after[part]
                i = np.repeat(part, n)
                yield emit(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), x)
            for g in np.flatnonzero(size > BLOCK):  # long lists: block against block
                own = np.arange(edges[g], edges[g + 1])
                own = own[np.lexsort((x[3][own], x[1][own], x[4][own]))]
                blocks = [own[k : k + BLOCK] for k in range(0, len(own), BLOCK)]
                small, large = ([int(f(x[1][b])) for b in blocks] for f in (np.min, np.max))
                left = [int((x[1][b] - x[3][b]).max()) for b in blocks]  # what a set of the block can share at most
                root = [int(x[4][b[0]]) if x[4][b[0]] == x[4][b[-1]] else None for b in blocks]
                for p, a in enumerate(blocks):
                    for q in range(p, len(blocks)):
                        if root[p] is not None and root[p] == root[q] or 100 * large[p] < percent * small[q] or 100 * large[q] < percent * small[p]:
                            continue
                        if (100 + percent) * min(left[p], left[q]) < percent * (small[p] + small[q]):
                            continue
                        i, j = (v.ravel() for v in np.meshgrid(a, blocks[q], indexing="ij"))
                        ok = np.triu(np.ones((len(a), len(a)), bool), 1).ravel() if p == q else slice(None)
                        yield emit(i[ok], j[ok], x)

    return lists.repartition("heart").sortWithinPartitions("heart", "token", "root", "digest").mapInArrow(run, "a long, b long, na int, nb int, pa int, pb int, c int")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (a, b) if len(a) < len(b) else (b, a)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                if common and 100 * common >= percent * (len(a) + len(b) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _fetch(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """digest, shingles of the wanted classes, from one document of each."""
    ids = small_enough(classes.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("doc").alias("__key")).select("__key").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            h, rows, digest = _sets(batch, n)
            chosen = _one_each(digest)
            raw = [h[rows[i] : rows[i + 1]].tobytes() for i in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(digest[chosen].view(np.int64)), pa.array(raw, pa.binary())], names=["digest", "shingles"])

    found = docs.join(ids, "__key", "left_semi").select("__text").mapInArrow(run, "digest long, shingles binary")
    return found.dropDuplicates(["digest"])


def linked(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_shingles and component_id, the least key that links reach from it, its own included.

    A set holds the distinct runs of n words of the whole text, in lower case (A-Z); a text with fewer words
    has one run of them all, and one without words an empty set, which is linked with nothing. Two sets are
    linked when 100 times their intersection is at least ``percent`` times their union. Keys are integers;
    rows without a key have no component (null), and rows with one key are one document to the others.
    """
    tables = Tables(df.sparkSession)
    docs = _docs(df, key, text)
    first = tables.keep(_first_pass(docs, n))
    classes = first.where("kind = 0").select("doc", "size", "digest")
    known = classes.where("doc is not null and size > 0")
    counted = first.where("kind = 1").groupBy("digest").agg(F.sum("size").alias("count")).where(F.col("count") >= RARE)
    top = largest(tables.keep(counted), "count", FREQUENT).toArrow()
    tokens = top.column("digest").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    frequent = (tokens[order], top.column("count").to_numpy()[order])

    lists = lists_of(_prefixes(docs, n, percent, frequent))
    lists = lists.withColumn("before", F.col("at") - F.row_number().over(Window.partitionBy("digest").orderBy("at")) + 1)
    least = F.min(F.struct((F.col("before") / F.col("size")).alias("part"), "digest", "size", "at", "before"))
    plain = tables.keep(lists)
    lists = tables.keep(plain.join(plain.groupBy("token").agg(least.alias("h")), "token"))
    tables.drop(plain)
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()

    met = lists.where("digest <> h.digest")
    overlap = F.least(F.col("at") - F.col("before"), F.col("h.at") - F.col("h.before")) + F.least(F.col("size") - F.col("at"), F.col("h.size") - F.col("h.at"))
    likely = ((100 + percent) * overlap >= percent * (F.col("size") + F.col("h.size"))) & (100 * F.least("size", "h.size") >= percent * F.greatest("size", "h.size"))
    met = met.where(likely).groupBy(F.greatest("digest", "h.digest").alias("a"), F.least("digest", "h.digest").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("size", "h.size")).alias("n"))
    stars = tables.keep(met.where("2 * c > n div 20").select("a", "b"))
    links = tables.keep(verified(stars, tables.keep(_fetch(docs, known, ends(stars), n)), percent))
    roots = components(links, tables)

    rooted = lists.join(roots.withColumnRenamed("id", "digest"), "digest", "left").withColumns({"root": F.coalesce("root", "digest"), "heart": F.col("h.digest")}).drop("h")
    shared = pairs_of(rooted, percent).groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    enough = (F.col("c") >= 1 + F.floor(F.least("na", "nb") / 20)) & ((100 + percent) * (F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1) >= percent * (F.col("na") + F.col("nb")))
    pairs = tables.keep(shared.where(enough).select("a", "b").join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
    more = tables.keep(verified(pairs, tables.keep(_fetch(docs, known, ends(pairs), n)), percent))
    roots = components(links.union(more), tables)

    rooted = classes.join(roots.withColumnRenamed("id", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = rooted.where("size > 0").groupBy("root").agg(F.min("doc").alias("least"))
    named = rooted.join(least.withColumnRenamed("root", "r"), (F.col("root") == F.col("r")) & (F.col("size") > 0) & F.col("doc").isNotNull(), "left")
    return named.select(F.col("doc").alias(key), F.col("size").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))
