"""Connected components of links between 64-bit ids, by union-find within tasks, then by large and small stars.

Each task joins the links that it holds and passes on one link to the root for each id. In a large star every neighbour above a node is linked to the node's least neighbour, in a small star every
neighbour below it is; in turn they leave one star per component. Least neighbours come from partial
aggregates and links from equi-joins, so a node with very many links isn't gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables


#: Links that a task joins on the average, and ids that it holds before it passes them on.
LINKS, HELD = 1 << 18, 1 << 20


def _joined(e: DataFrame) -> DataFrame:
    """Links (a, b) from each id to the least one that the links of a task join it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def links() -> pa.RecordBatch:
            ids = [x for x in up if find(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > HELD:
                yield links()
                up.clear()
        yield links()

    return e.mapInArrow(run, "a long, b long")


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a0"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("a0")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    joined = e.join(least.withColumnRenamed("a", "a0"), F.col("a") == F.col("a0")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """id, root for every id of the links (a, b), null left out; the root is the least id of the component. A written table."""
    e = tables.keep(edges.where("a is not null and b is not null and a <> b").select("a", "b"))
    tasks = -(-e.count() // LINKS)
    if not tasks:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    joined = tables.keep(_joined(e.coalesce(tasks)))
    tables.drop(e)
    e = joined
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = mark(e) if tasks > 1 else None
    while before:
        star = tables.keep(_small(_large(e).distinct()).distinct())
        tables.drop(e)
        e, now = star, mark(star)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
