"""Dense features of whole texts for the trained classifiers: hashed byte trigrams and surface shares.

``BUCKETS`` square roots of hashed trigram shares, then ``SHAPE`` surface
measures. A null or empty text has zeros only. Everything is numpy or C-level
string work over the whole text; long texts are read in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroba.llm.common import stored

BUCKETS = 2048
#: log of bytes; shares of upper case, digits, other ASCII signs, white space, line feeds, bytes beyond ASCII; share of distinct words, of distinct pairs, of distinct lines; mean word length; share of the most common word; words that end in a sign.
SHAPE = 13
WIDTH = BUCKETS + SHAPE
_PIECE = 1 << 20
#: Texts of so many words have their pairs counted by numbers.
LONG_WORDS = 20_000

_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 4
_KIND[128:] = 5


def _distinct_pairs(words: list[str], seen: Counter) -> int:
    """Distinct pairs of neighbouring words; those of a long text are counted by numbers, which take a tenth of the memory of tuples."""
    if len(words) < LONG_WORDS:
        return len(set(zip(words, words[1:], strict=False)))
    number = {w: i for i, w in enumerate(seen)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return len(np.unique(ids[:-1] * len(seen) + ids[1:]))


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "replace")
    grams, kinds = np.zeros(BUCKETS, np.int64), np.zeros(6, np.int64)
    for at in range(0, len(data), _PIECE):
        raw = np.frombuffer(data[at : at + _PIECE + 2], np.uint8)
        kinds += np.bincount(_KIND[raw[:_PIECE]], minlength=6)
        if len(raw) > 2:
            x = raw.astype(np.uint32)
            code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
            grams += np.bincount((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21), minlength=BUCKETS)
    total = max(1, grams.sum())
    out[:BUCKETS] = np.sqrt(grams / total)
    n, words = len(data), text.split()
    lines = text.split("\n")
    shape = [np.log1p(n) / 10, *(kinds[1:5] / n), data.count(b"\n") / n * 10, kinds[5] / n]
    if words:
        seen = Counter(words)
        pairs = _distinct_pairs(words, seen)
        signs = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,")
        shape += [len(seen) / len(words), pairs / max(1, len(words) - 1), len(set(lines)) / len(lines), n / len(words) / 20, max(seen.values()) / len(words), signs / len(words)]
    else:
        shape += [0.0] * 6
    out[BUCKETS:] = shape
    return out


def feature_rows(rows: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` of the rows and ``x``, the features of the text as float32 bytes."""
    kept = rows.select(*columns, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema) + ", x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t.as_py()).tobytes() for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.binary())], [*columns, "x"])

    return kept.mapInArrow(run, schema)


def smallest_hashes(named: DataFrame, n: int, seed: int) -> DataFrame:
    """(__id, __by) of at most ``n`` ids for each value of ``__by``, those with the smallest hash; ``named``: __id, __by, few values of ``__by``.

    Only ids under a cut of their hash are ranked, about ``4 * n`` of each value
    however many there are; a cut that leaves too few is raised and tried again.
    """
    at = F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1 << 40))
    sizes = {r[0]: r[1] for r in named.groupBy("__by").agg(F.count("*")).collect()}
    cut = {by: min(1.0, 4 * n / size) for by, size in sizes.items()}
    found = None
    while cut:
        limits = F.create_map(*(F.lit(x) for by, share in cut.items() for x in (by, int(share * (1 << 40)))))
        some = stored(named.withColumn("__at", at).where(F.col("__at") < limits[F.col("__by")]).distinct(), "cut")
        counts = {r[0]: r[1] for r in some.groupBy("__by").agg(F.count("*")).collect()}
        short = {by: min(1.0, 16 * share) for by, share in cut.items() if share < 1 and counts.get(by, 0) < n}
        fine = [by for by in cut if by not in short]
        kept = some.where(F.col("__by").isin(fine))
        found = kept if found is None else found.union(kept)
        cut = short
    if found is None:
        return named.limit(0)
    first = Window.partitionBy("__by").orderBy("__at", "__id")
    return found.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).select("__id", "__by")


def small_sample(rows: DataFrame, id_col: str, text_col: str, n: int, seed: int, ids: DataFrame | None = None, by: str | None = None) -> tuple[np.ndarray, list]:
    """Features of the whole texts of at most ``n`` ids, those with the smallest hash, and their values of ``by``; in id order, so that fits repeat.

    ``ids``: the ids to choose from, else those of ``rows``. ``by``: at most ``n``
    ids of each of its values, all chosen in one pass. An id gives one row, the one
    with the smallest hash of its text. Texts are not shuffled, only the ids and
    the features of what is chosen.
    """
    pool = (rows if ids is None else ids).where(F.col(id_col).isNotNull())
    if by is None:
        chosen = pool.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(n).distinct()
        kept, columns = rows.select(F.col(id_col).alias("__id"), F.lit("").alias("__by"), F.col(text_col).alias("__text")), ["__id"]
    else:
        chosen = smallest_hashes(pool.select(F.col(id_col).alias("__id"), F.col(by).cast("string").alias("__by")).where("__by is not null"), n, seed)
        kept, columns = rows.select(F.col(id_col).alias("__id"), F.col(by).cast("string").alias("__by"), F.col(text_col).alias("__text")), ["__id", "__by"]
    found = feature_rows(kept.join(F.broadcast(chosen), columns, "left_semi"), ["__id", "__by"], "__text")
    once = found.groupBy("__id", "__by").agg(F.min("x").alias("x"))
    parts: list[np.ndarray] = []
    keys: list[tuple] = []
    for r in once.repartition(max(1, n // 500)).toLocalIterator():  # parts of a few MB: the driver holds one beside the features
        keys.append((r[1], r[0], len(parts)))
        parts.append(np.frombuffer(r[2], np.float32))
    rows.sparkSession._jvm.System.gc()
    keys.sort()
    x = np.empty((len(keys), WIDTH), np.float32)
    for at, (_, _, i) in enumerate(keys):
        x[at] = parts[i]
        parts[i] = None
    return x, [k[0] for k in keys]


class Scale:
    """Centres and scales features in place; the shape columns get unit variance."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
        self.by = np.full(WIDTH, 10, np.float32)
        if len(x):
            self.by[BUCKETS:] = 1 / np.maximum(x[:, BUCKETS:].std(0), 1e-3)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x -= self.mean
        x *= self.by
        return np.clip(x, -8, 8, out=x)
