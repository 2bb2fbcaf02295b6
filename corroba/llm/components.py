"""Connected components of an edge table by alternating large-star and small-star steps.

Everything stays in DataFrames; each round is written to the shared folder. The
rounds grow with the logarithm of the longest path. A table of at most ``few``
edges is solved by one task instead, as a round costs several shuffles whatever
its size. Nodes that appear in no edge are not returned; self edges and repeated
edges change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroba.llm.common import discard, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) by union-find over all edges; nodes are integers, strings or binary, which Python orders as Spark does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(x, x)
                root.setdefault(y, y)
                m, n = top(x), top(y)
                root[max(m, n)] = min(m, n)
        nodes = list(root)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([top(x) for x in some], kind)], ["node", "component"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 100_000, held: list[DataFrame] | None = None) -> DataFrame:
    """``(node, component)``, the component being its smallest node. Raises if ``max_rounds`` don't suffice. ``held`` gets the stored table that the result reads."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = stored(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    held = [] if held is None else held
    if now.schema["a"].dataType.typeName() in ("byte", "short", "integer", "long", "string", "binary") and now.count() <= few:
        held.append(now)
        return _in_one_task(now)
    mark = None
    for _ in range(max_rounds):
        nxt = stored(_small_star(_large_star(now)), "edges")
        signed = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(signed) == mark:
            discard(now.sparkSession, now)
            held.append(nxt)
            roots = nxt.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        discard(now.sparkSession, now)
        now, mark = nxt, tuple(signed)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
