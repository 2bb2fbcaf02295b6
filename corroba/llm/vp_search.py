"""Nearest neighbours by vantage-point trees, one a shard, with relaxed triangle pruning.

At most ``pivots`` vectors, those with the smallest hashes of their ids, part the
space: every vector belongs to the cell of its nearest pivot, and a cell knows
its radius. A cell of over ``shard_rows`` vectors is cut into shards by a hash of
the id, so a hot cell or vector spreads. Each shard builds a tree over its unit
vectors with the chord distance, a metric of the same order as cosine. At a
node with vantage point v and radius m, a query at distance d from v needs the
far side only if ``|d - m| <= reach / factor``, where reach is the distance of
its k-th nearest so far. A query first goes to the shards of its own cell; then,
with the reach it has from there, only to cells whose ball it may meet, by the
same inequality with the same factor. Factor one prunes what cannot hold a
nearer vector, so the search is exact; a larger factor prunes more. Queries go
down the tree in blocks. Every point met within the k-th distance, and what
rounding may add to it, is kept, however many tie there; their scores are the
cosines of the original vectors in double precision. The winners of all shards
are merged by query.

Equal vectors of a shard are one point of its tree with the k + 1 smallest of
their ids; no other copy can be among a query's k nearest, so this is exact. A
point that has only the query's own id does not count among the k.

Vectors that are null, zero, or hold null or non-finite components take no part.
Only vectors of one dimension are compared. Ties go to the smaller id. Repeated
rows of one id are candidates like others, but never for their own id. Rows with
a null id take no part. A query without candidates gives no rows, an empty table
none. Other columns are not read, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroba.llm.common import stored

#: Vectors of a leaf.
LEAF = 64


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the dot products, added from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


class VantageTree:
    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.unit, self.leaf = unit, leaf
        self.slack, self.reach_slack = slacks(unit.shape[1])
        self.draw = np.random.RandomState(seed)
        self.root = self._build(np.arange(len(unit)))

    def _distance(self, i: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ self.unit[i])))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = self.draw.randint(len(rows))
        vantage, rest = rows[at], np.delete(rows, at)
        d = self._distance(vantage, rest)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            return rows  # no radius parts them
        return vantage, radius, self._build(rest[inside]), self._build(rest[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float, names: np.ndarray, ids: np.ndarray, single: np.ndarray) -> list[np.ndarray]:
        """For each unit query all points that may be among its k nearest, ties of the k-th included; points with a ``single`` id, the query's name, are none."""
        self.q, self.names, self.ids, self.single = queries, names, ids, single
        self.best = np.full((len(queries), k), -np.inf)
        self.factor = factor
        self.met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._visit(self.root, np.arange(len(queries)))
        if not self.met:
            return [np.zeros(0, int)] * len(queries)
        asks, points, cosines = (np.concatenate(x) for x in zip(*self.met, strict=True))
        fine = cosines >= self.best[asks, -1] - self.slack
        asks, points = asks[fine], points[fine]
        order = np.argsort(asks, kind="stable")
        return np.split(points[order], np.searchsorted(asks[order], np.arange(1, len(queries))))

    def _offer(self, active: np.ndarray, rows: np.ndarray, cosine: np.ndarray) -> None:
        k = self.best.shape[1]
        cosine = np.where(self.single[rows] & (self.ids[rows] == self.names[active][:, None]), -np.inf, cosine)
        both = np.concatenate([self.best[active], cosine], axis=1)
        self.best[active] = -np.partition(-both, k - 1, axis=1)[:, :k]
        a, b = np.nonzero((cosine >= self.best[active, -1][:, None] - self.slack) & (cosine > -np.inf))
        self.met.append((active[a], rows[b], cosine[a, b]))

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._offer(active, node, self.q[active] @ self.unit[node].T)
            return
        vantage, radius, inner, outer = node
        cosine = self.q[active] @ self.unit[vantage]
        d = np.sqrt(np.maximum(0, 2 - 2 * cosine))
        self._offer(active, np.array([vantage]), cosine[:, None])
        near = d <= radius
        self._visit(inner, active[near])
        self._visit(outer, active[~near])
        reach = np.sqrt(np.maximum(0, 2 - 2 * (self.best[active, -1] - self.slack))) / self.factor + self.reach_slack
        self._visit(outer, active[near & (radius - d <= reach)])
        self._visit(inner, active[~near & (d - radius <= reach)])


class Shard:
    """The distinct vectors of a shard, their ids and the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        groups: dict[bytes, list[int]] = {}
        for i in order:
            held = groups.setdefault(vectors[i].tobytes(), [])
            if len(held) <= k and (not held or ids[i] != ids[held[-1]]):
                held.append(i)
        self.groups = [np.array(g) for g in groups.values()]
        first = np.array([g[0] for g in self.groups])
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt(dots(vectors, vectors))
        single = np.array([len(g) == 1 for g in self.groups])
        self.own = ids[first], single
        self.tree = VantageTree(vectors[first] / self.norm[first][:, None])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, factor: float) -> Iterator[tuple[int, int, float]]:
        norms = np.sqrt(dots(queries, queries))
        found = self.tree.search(queries / norms[:, None], self.k, factor, query_ids, *self.own)
        for q, (name, near) in enumerate(zip(query_ids, found, strict=True)):
            rows = np.concatenate([self.groups[g] for g in near]) if len(near) else near
            rows = rows[self.ids[rows] != name]
            score = dots(self.vectors[rows], queries[q : q + 1]) / (norms[q] * self.norm[rows])
            for at in np.lexsort((self.ids[rows], -score))[: self.k]:
                yield int(name), int(self.ids[rows[at]]), float(score[at])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def slacks(dim: int) -> tuple[float, float]:
    """Twice what the cosine of two unit vectors and the score of their originals may differ by, and what that makes of distances."""
    slack = 8 * (dim + 8) * np.finfo(float).eps
    return slack, 4 * np.sqrt(2 * slack)


class Cells:
    """The pivots by dimension; a dimension without one is a cell of its own, of unbounded radius."""

    def __init__(self, vectors: list[list[float]]):
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, v in enumerate(vectors):
            unit = np.array(v) / np.sqrt(np.dot(v, v))
            by_dim.setdefault(len(v), []).append((i, unit))
        self.of = {dim: (np.array([i for i, _ in found]), np.array([u for _, u in found])) for dim, found in by_dim.items()}

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the dimension and the chord distance of each vector to their pivots."""
        dim = vectors.shape[1]
        if dim not in self.of:
            return np.array([-dim]), np.zeros((len(vectors), 1))
        cells, pivots = self.of[dim]
        unit = vectors / np.sqrt(dots(vectors, vectors))[:, None]
        return cells, np.sqrt(np.maximum(0, 2 - 2 * (unit @ pivots.T)))


def _by_dim(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a batch's lists, for each of their dimensions."""
    sizes = np.diff(values.offsets.to_numpy())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_DEALT = "shard int, dim int, asks int, vec_id bigint, v array<double>"


def _search(data: DataFrame, asked: DataFrame, shards: int, k: int, factor: float, block: int) -> DataFrame:
    """(query_id, vec_id, score) that each shard finds; both tables: the columns of ``_DEALT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            names, values = batch.column(3).to_numpy(), batch.column(4)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                place, dim = keys[a][:2], keys[a][1]
                if place != at:
                    at, shard, ids, parts = place, None, [], []
                block_v = values.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if not keys[a][2]:
                    ids.append(names[a:b])
                    parts.append(block_v)
                    continue
                if not ids:
                    continue
                shard = shard or Shard(np.concatenate(ids), np.vstack(parts), k)
                for c in range(0, b - a, block):
                    got = list(shard.nearest(names[a + c : min(b, a + c + block)], block_v[c : c + block], factor))
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    dealt = data.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "asks", "vec_id", "v")
    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double").distinct()


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, factor: float = 1.0, shard_rows: int = 8192, block: int = 256, pivots: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``, against all rows."""
    rows = usable(vectors, id_col, vector_col)
    spark, total = vectors.sparkSession, rows.count()
    first = rows.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id", "v").limit(min(pivots, -(-total // shard_rows))).collect() if total else []
    cells = Cells([r.v for r in first])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, v in _by_dim(batch.column(1)):
                names, d = cells.distances(v)
                best = d.argmin(1)
                cell[at], far[at] = names[best], d[np.arange(len(at)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    known = stored(rows.mapInArrow(assign, "vec_id bigint, v array<double>, cell int, far double"), "cells")
    stats = known.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()  # a row a pivot or dimension
    ball: dict[int, tuple[int, int, float]] = {}  # cell -> first shard, shards, radius
    shards = 0
    for r in stats:
        pieces = -(-r.n // shard_rows)
        ball[r.cell] = shards, pieces, r.radius if r.cell >= 0 else np.inf
        shards += pieces
    if not shards:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    place = F.create_map(*(F.lit(x) for c, (at, _, _) in ball.items() for x in (c, at)))
    pieces = F.create_map(*(F.lit(x) for c, (_, n, _) in ball.items() for x in (c, n)))
    data = known.select((place[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), pieces[F.col("cell")]).cast("int")).alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("asks"), "vec_id", "v")
    queries = known.where(F.col("vec_id") % every == 0)
    home = queries.select(F.explode(F.sequence(place[F.col("cell")], place[F.col("cell")] + pieces[F.col("cell")] - 1)).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("asks"), "vec_id", "v")
    near = stored(_best(_search(data, home, shards, k, factor, block), k), "near")
    if len(ball) == 1:
        return near
    reach = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of other cells that a query may have a nearer vector in."""
        for batch in batches:
            least = batch.column(3).to_numpy(zero_copy_only=False)
            own = batch.column(2).to_numpy()
            for at, v in _by_dim(batch.column(1)):
                names, d = cells.distances(v)
                slack, more = slacks(v.shape[1])
                radius = np.array([ball[c][2] if c in ball else -np.inf for c in names.tolist()])
                score = np.nan_to_num(least[at].astype(float), nan=-np.inf)
                go = (d - radius <= (np.sqrt(np.maximum(0, 2 - 2 * (score - slack))) / factor + more)[:, None]) & (names[None, :] != own[at][:, None])
                q, c = np.nonzero(go)
                for i, cell in zip(q, names[c].tolist(), strict=True):
                    start, n, _ = ball[cell]
                    some = batch.slice(int(at[i]), 1)
                    one = pa.array(range(start, start + n), pa.int32())
                    yield pa.RecordBatch.from_arrays([one, pa.array([v.shape[1]] * n, pa.int32()), pa.array([1] * n, pa.int32()), *(pa.concat_arrays([some.column(j)] * n) for j in (0, 1))], ["shard", "dim", "asks", "vec_id", "v"])

    away = queries.join(reach, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "cell", "least").mapInArrow(visit, _DEALT)
    return _best(near.select("query_id", "vec_id", "score").union(_search(data, away, shards, k, factor, block)).distinct(), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
