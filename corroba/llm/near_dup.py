"""Near duplicates: bottom-k sketches, inverted lists, union-sketch filter, exact Jaccard.

1. Every text becomes its set of 5-word shingle hashes (one hash function); its
   bottom-k sketch are the ``deep_k`` smallest of them, of which every row keeps
   the first ``k``. Equal sets form one class.
2. The ``index_k`` smallest values of every class go to inverted lists. A pair
   at the threshold shares at least ``chance_floor`` of them but for a chance
   under 1e-9 (sets that fit in the sketch have the exact floor), so a class
   that shares fewer values with the whole corpus leaves at once. Only classes
   that are left have the rest of their sketch made.
3. The retained values of these classes (most sets whole) go to inverted lists,
   again with a floor; by the prefix principle a class needs only its rarest
   values, as many as lie beyond the floor, and one with more values of its own
   than that leaves. Lists are cut into cells of two length bands each, as wide
   as the threshold allows lengths to differ. A cell with over a thousandth of
   all entries (there are under a thousand of them) is not dealt by its key: what
   is known of it is broadcast to its entries.
4. A star round: in each cell the most central class is compared with all the
   others, linear in the cell. Pairs pass a length bound, the Jaccard estimate
   of the bottom-k of the union of both sketches, then the exact Jaccard of the
   full sets. Linked classes merge.
5. Cells that still hold two components are joined to clusters. Clusters are
   range-sorted with their classes by length and cut into blocks of at most
   ``block`` classes and ``block_shingles`` shingles, a larger class alone; pairs of
   blocks whose lengths can match and that hold two components are a task each.
   It counts the overlaps of sketches through the lists of their values, keeps
   pairs that reach the floor of step 2 for the union of both, verifies these on
   their full sets, and returns only links that join two components. So no pair
   is capped or emitted without need, and no task holds over two blocks.

A component is therefore the same as with all pairs compared, and a group of m
near copies costs about m comparisons.

Null and empty texts have no shingles and link with nothing. Texts of any length
are read whole; a class's text is one value of a task. Repeated rows are rows
like any others and share their class; rows with one doc_id and different texts
keep their own component each, and rows with a null id link others like any row.
An empty table gives no rows. Only the id and text columns are read, so that
other names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroba.llm.common import discard, stored
from corroba.llm.components import connected_components
from corroba.llm.shingles import common, set_digest, shingle_set

_BIAS = np.uint64(1 << 63)
#: Chances that a pair at the threshold shares fewer values than the floors of the index and of the deep lists.
INDEX_MISS, DEEP_MISS = 5e-10, 1.5e-11


def chance_floor(k: int, percent: int, miss: float) -> int:
    """The most values that two bottom-k sketches of a pair at the threshold share but for a chance under ``miss``: a binomial quantile, as each of the k smallest values of the union lies in both sets with the chance of the Jaccard."""
    p, below = percent / 100, 0.0
    if p >= 1:
        return k
    for shared in range(k + 1):
        below += math.exp(math.lgamma(k + 1) - math.lgamma(shared + 1) - math.lgamma(k - shared + 1) + shared * math.log(p) + (k - shared) * math.log1p(-p))
        if below >= miss:
            break
    if shared < 1:
        raise ValueError(f"sketches of {k} values are too small for a Jaccard of {percent} hundredths")
    return shared


def _signed(values: np.ndarray) -> np.ndarray:
    """Unsigned values as signed ones of the same order."""
    return (values ^ _BIAS).view(np.int64)


def text_hash(text_col: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, sketch), one row a row of ``docs``."""
    doc_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, values, ends = [], [], [], [0]
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                digests.append(set_digest(s))
                values.append(_signed(s[:k]))
                ends.append(ends[-1] + len(values[-1]))
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sketch], ["doc_id", "text_hash", "n_shingles", "digest", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {doc_type}, text_hash bigint, n_shingles bigint, digest binary, sketch array<bigint>")


def _floor(n: str, k: int, floor: int, percent: int) -> str:
    """Values of its k smallest that a class must share with any partner: a small set's whole share, else the floor of the sketch."""
    return f"case when {n} <= {k * percent // 100} then cast(ceil({percent} * {n} / 100) as int) else {floor} end"


def _deep_values(texts: DataFrame, words: int, k: int) -> DataFrame:
    """(digest, n, v): the k smallest values of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), words)
                v = _signed(s[:k])
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(v), pa.binary()), pa.array(np.full(len(v), len(s))), pa.array(v)], ["digest", "n", "v"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n bigint, v bigint")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int, block: int = 256) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold. b is read once for every ``block`` of its partners."""
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    salted = pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / block)).alias("salt"))
    pivots = salted.select("b", "salt").distinct().join(texts.withColumnRenamed("digest", "b"), "b").select("b", "salt", F.lit(None).cast("binary").alias("a"), "text")
    others = salted.join(texts.withColumnRenamed("digest", "a"), "a").select("b", "salt", "a", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pivots.union(others).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = shingle_set(text.as_py(), words)
                if a is None:
                    pivot = s
                    continue
                both = common(pivot, s)
                if both and 100 * both >= percent * (len(pivot) + len(s) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each left set shares with each right one, through the lists of values that two sets hold."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keep = counts[inverse] > 1
    column = np.cumsum(counts > 1)[inverse[keep]] - 1
    owner, width = owner[keep], int((counts > 1).sum())
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 4096
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part[left] @ part[right].T
    return both


def _block_links(rows: DataFrame, words: int, percent: int, k: int, floor: int) -> DataFrame:
    """Links between components inside each (cluster, i, j); rows: cluster, i, j, side, digest, component, text."""

    def links(held: list[tuple]) -> list[tuple]:
        sets = [shingle_set(r[3], words) for r in held]
        sizes = np.array([len(x) for x in sets])
        left = np.array([i for i, r in enumerate(held) if r[0] == 0])
        right = np.array([i for i, r in enumerate(held) if r[0] == 1])
        right = left if not len(right) else right
        least = np.where(sizes <= k * percent // 100, -(-percent * sizes // 100), floor)
        near = _overlaps([x[:k] for x in sets], left, right) >= np.maximum(least[left][:, None], least[right][None, :])
        left, right = left[near.any(1)], right[near.any(0)]
        if not len(left):
            return []
        near = near[near.any(1)][:, near.any(0)]
        both = _overlaps(sets, left, right)
        near = np.argwhere(near & (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)))
        root: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for x, y in near:
            p, q = held[left[x]], held[right[y]]
            m, n = top(p[2]), top(q[2])
            if m != n:
                root[m] = n
                out.append((p[1], q[1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []
        for batch in batches:
            for c, i, j, *row in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
                if (c, i, j) != key:
                    out += links(held) if held else []
                    key, held = (c, i, j), []
                held.append(tuple(row))
        out += links(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _blocks(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """The members, range-sorted by cluster and length, with the number of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, cluster, rows, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            out = []
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != cluster or rows >= block or size + n > block_shingles:
                    number, cluster, rows, size = number + 1, c, 0, 0
                rows, size = rows + 1, size + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["cluster", "n", "digest", "component", "block"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = members.select("cluster", "n", "digest", "component").repartitionByRange(parts, "cluster", "n", "digest").sortWithinPartitions("cluster", "n", "digest")
    return sorted_rows.mapInArrow(run, "cluster binary, n bigint, digest binary, component binary, block bigint")


def _within_clusters(mixed: DataFrame, texts: DataFrame, words: int, percent: int, block: int, block_shingles: int, k: int, floor: int, held: list[DataFrame]) -> DataFrame:
    """All links between components of classes that share a mixed cell; ``mixed``: v, band, digest, n, component. ``held`` gets the stored tables that the result reads."""
    heads = mixed.groupBy("v", "band").agg(F.min("digest").alias("head"), F.count("*").alias("entries"))
    clusters = connected_components(_at_cells(mixed, heads, held=held).where("digest <> head").select("digest", "head").distinct(), "digest", "head", held=held)
    members = mixed.select("digest", "n", "component").distinct().join(clusters.select(F.col("node").alias("digest"), F.col("component").alias("cluster")), "digest")
    blocks = stored(_blocks(members, block, block_shingles), "blocks")
    held.append(blocks)
    span = blocks.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    i = span.select("cluster", F.col("block").alias("i"), F.col("hi").alias("hi"), "c0", "c1")
    j = span.select("cluster", F.col("block").alias("j"), F.col("lo").alias("lo"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    tasks = i.join(j, "cluster").where(f"i <= j and 100 * hi >= {percent} * lo and not (c0 = c1 and d0 = d1 and c0 = d0)").select("cluster", "i", "j")
    first = tasks.join(blocks.withColumnRenamed("block", "i"), ["cluster", "i"]).select("cluster", "i", "j", F.lit(0).alias("side"), "digest", "component")
    second = tasks.where("i < j").join(blocks.withColumnRenamed("block", "j"), ["cluster", "j"]).select("cluster", "i", "j", F.lit(1).alias("side"), "digest", "component")
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = first.union(second).join(texts, "digest").select("cluster", "i", "j", "side", "digest", "component", "text")
    return _block_links(rows.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "digest"), words, percent, k, floor)


def _at_cells(entries: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("v", "band"), *, held: list[DataFrame]) -> DataFrame:
    """Entries with what ``cells`` says of their key; keys without a row there are left out. ``cells`` has ``entries``, their number: keys with over a thousandth of all are broadcast to their entries, so that no task gets a hot one. ``held`` gets the stored table that the result reads."""
    total, keys = entries.count(), list(keys)
    cells = stored(cells, "cells")
    held.append(cells)
    hot = cells.where(F.col("entries") > total // 1000)  # under a thousand
    cold = entries.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cells.where(F.col("entries") <= total // 1000), keys)
    return entries.join(F.broadcast(hot), keys).select(cold.columns).union(cold).drop("entries")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 85,
    k: int = 64,
    index_k: int = 32,
    deep_k: int = 1024,
    block: int = 512,
    block_shingles: int = 1 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash), one row a row of ``docs``.

    ``percent``: least Jaccard, in hundredths; all floors follow from it, and a
    threshold that the sketches are too small for is an error. ``block``,
    ``block_shingles``: classes and shingles of a block; a task holds the sets of two.
    """
    floor_shared, deep_floor = chance_floor(index_k, percent, INDEX_MISS), chance_floor(deep_k, percent, DEEP_MISS)
    held: list[DataFrame] = []  # stored tables that nothing reads once the ids are there

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(stored(df, name))
        return held[-1]

    rows = stored(sketches(docs, id_col, text_col, words, k), "sketches")
    classes = keep(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")

    values = classes.select("digest", "n", F.explode(F.slice("sketch", 1, index_k)).alias("v"))
    frequent = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    shared = values.join(frequent, "v").groupBy("digest").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    alive = keep(shared.where(f"shared >= {_floor('n', index_k, floor_shared, percent)}").select("digest"), "alive")

    need_text = classes.select("digest", "rep").join(alive, "digest", "left_semi")
    reps = need_text.select(F.col("rep").alias("need")).distinct()  # a class whose rows all have a null id has a null one
    found = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text")).join(reps, F.col("rep").eqNullSafe(F.col("need")), "left_semi")
    texts = keep(_class_texts(found, words).join(alive, "digest", "left_semi").dropDuplicates(["digest"]), "texts")
    sketch = classes.select("digest", "sketch").join(alive, "digest", "left_semi")

    deep = keep(_deep_values(texts, words, deep_k), "deep")
    common_values = deep.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    every = Window.partitionBy("digest")
    band = (F.floor(F.log("n") / -np.log(percent / 100)) if percent < 100 else F.col("n")).cast("int")
    lists = (
        deep.join(common_values, "v")
        .withColumn("at", F.row_number().over(every.orderBy("df", "v")))
        .withColumn("shared", F.count("*").over(every))
        .withColumn("central", F.sum("df").over(every))
        .where(f"at <= shared - {_floor('n', deep_k, deep_floor, percent)} + 1")
        .select("v", F.explode(F.array(band - 1, band)).alias("band"), "digest", "n", "central")
    )
    lists = keep(lists, "lists")

    first = lists.groupBy("v", "band").agg(F.max(F.struct("central", "digest", "n")).alias("top"), F.count("*").alias("entries")).where("entries > 1")
    pairs = _at_cells(lists, first, held=held).select(F.col("digest").alias("a"), F.col("top.digest").alias("b"), "n", F.col("top.n").alias("m"))
    near = pairs.where(f"a <> b and 100 * least(n, m) >= {percent} * greatest(n, m)").select("a", "b").distinct()
    close = near.join(sketch.select(F.col("digest").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("digest").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    # A union of fewer values than the sketch holds is whole, and its share exact.
    enough = F.when(F.size(union) < k, 100 * both >= percent * F.size(union)).otherwise(both >= chance_floor(k, percent, INDEX_MISS))
    close = keep(close.where(enough).select("a", "b"), "close")
    links = keep(_verify(close, texts, words, percent), "links")
    together = keep(connected_components(links, held=held), "components") if not links.isEmpty() else None

    def with_component(df: DataFrame) -> DataFrame:
        if together is None:
            return df.withColumn("component", F.col("digest"))
        return df.join(together.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))

    known = with_component(lists.select("v", "band", "digest", "n"))
    open_cells = known.groupBy("v", "band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("entries")).where("c0 < c1").select("v", "band", "entries")
    mixed = keep(_at_cells(known, open_cells, held=held), "mixed")
    if not mixed.isEmpty():
        more = keep(_within_clusters(mixed, texts, words, percent, block, block_shingles, deep_k, deep_floor, held), "more")
        if not more.isEmpty():
            together = keep(connected_components(links.union(more), held=held), "components")

    named = classes.select("digest", "rep", "copies", "n")
    named = with_component(named)
    # Components of several rows; others stand for themselves.
    several = F.max(F.col("component") != F.col("digest")) | (F.max("copies") > 1)
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("entries"), several.alias("several")).where("several").drop("several")
    ids = stored(_at_cells(named, smallest, ("component",), held=held).select("digest", "component_id"), "ids")
    discard(docs.sparkSession, *held)
    return (
        rows.select("doc_id", "n_shingles", "digest", "text_hash")
        .join(ids, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
    )


def _class_texts(found: DataFrame, words: int) -> DataFrame:
    """(digest, text) of rows that hold a needed id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [set_digest(shingle_set(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0)], ["digest", "text"])

    return found.select("text").mapInArrow(run, "digest binary, text string")
