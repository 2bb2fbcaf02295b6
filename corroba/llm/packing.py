"""Best-fit packing of token pieces: bulk-synchronous sweeps over range-sorted pieces and gaps.

1. Documents are tokenised and only those over the capacity are cut, into full
   pieces and a last one. Pieces (with length and checksum) are stored.
2. Pieces are packed in classes of length, longest first, each down to half the
   length of the one before (the last takes all the rest). Pieces over half the
   capacity open a sequence each; every sequence with room left is a gap.
3. A superstep of a class: its pieces and all gaps that could hold its shortest
   are range-sorted together by size, the larger first, and dealt to tasks of about
   ``range_rows`` rows; a hot length spreads over tasks. Each task sweeps its
   range downwards: gaps that the sweep has passed lie on a stack, and a piece
   takes its successor, the smallest of them; what is left of that gap stays in
   the sweep, at its new size. A task ends with pieces that found no gap and gaps
   that found no piece, both in order.
4. Conflicts between tasks are resolved by rank. For each range only the number
   of its open pieces and gaps and a bound of their sizes reach the driver; from
   these, pieces of a range get the gaps that the ranges before it left, the
   nearest range first, rank by rank, as many pieces a gap as surely fit. Tasks
   then place the pieces so matched, and gaps are updated.
5. This repeats ``sweeps`` times a class, or until a superstep places nothing; then
   pieces that are left open new sequences, again as many in one as surely fit.

The driver holds a few numbers a range, never pieces, gaps or lengths. A
superstep moves the class's open pieces and gaps once, and there are at most
``sweeps`` supersteps for each of ``classes`` classes, whatever the corpus.
Sequences are few: tests/llm compares them with plain best-fit decreasing.

Null text is empty: the end id alone. Repeated rows are documents of their own,
as are rows with a null id. Ties have ranks by id, piece and checksum. Texts of
any length are cut whole. An empty table gives no rows. Other columns than id
and text are not read, so that their names cannot clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroba.llm.common import stored
from corroba.llm.tokens import encoder

WORD_BPE = "word_bpe_49k.json"
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: A row of a sweep: a piece (its columns) or a gap (its sequence), its size, and what became of it.
_SWEPT = f"{_PIECES}, sequence_id bigint, offset bigint, size bigint, state int, part int, rank bigint"
#: Fixed values of ``state``.
PLACED, OPEN_PIECE, OPEN_GAP, PASSED_GAP = 0, 1, 2, 3


def token_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, _KINDS, strict=True)], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _PIECES)


class Sweep:
    """Best fit over one range: sizes come in descending order, gaps before pieces of their size."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, int]] = []  # (size, sequence) of gaps passed, the smallest on top
        self.later: list[tuple[int, int]] = []  # (-size, sequence) of gaps that the sweep has yet to reach

    def gap(self, size: int, sequence: int) -> None:
        heapq.heappush(self.later, (-size, sequence))

    def piece(self, length: int) -> tuple[int, int] | None:
        """The (size, sequence) of the gap that the piece takes."""
        while self.later and -self.later[0][0] >= length:
            size, sequence = heapq.heappop(self.later)
            self.stack.append((-size, sequence))
        if not self.stack:
            return None
        size, sequence = self.stack.pop()
        if size > length:
            self.gap(size - length, sequence)
        return size, sequence


def sweep_ranges(rows: DataFrame, ranges: int, capacity: int) -> DataFrame:
    """One sweep of every range; ``rows``: the columns of pieces, sequence_id (null for pieces) and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sweep, rank, last = TaskContext.get().partitionId(), Sweep(), 0, None
        kinds = [*_KINDS, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = [*_NAMES, "sequence_id", "offset", "size", "state", "part", "rank"]
        for batch in batches:
            sequences, sizes = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            at, sequence_id, offset, state, ranks = [], [], [], [], []
            for i, (sequence, size) in enumerate(zip(sequences, sizes, strict=True)):
                if sequence is not None:
                    sweep.gap(size, sequence)
                    continue
                last, taken = size, sweep.piece(size)
                at.append(i)
                sequence_id.append(taken[1] if taken else None)
                offset.append(capacity - taken[0] if taken else None)
                state.append(PLACED if taken else OPEN_PIECE)
                ranks.append(None if taken else rank)
                rank += not taken
            held = batch.take(pa.array(at, pa.int64()))
            more = [pa.array(c, t) for c, t in zip((sequence_id, offset, np.array(sizes, np.int64)[at] if at else [], state, [part] * len(at), ranks), kinds[5:], strict=True)]
            yield pa.RecordBatch.from_arrays([*held.columns[:5], *more], names)
        # Gaps over the last piece are on the stack; a range without pieces has passed none, but all its gaps are over the pieces to come.
        while sweep.later and (last is None or -sweep.later[0][0] >= last):
            size, sequence = heapq.heappop(sweep.later)
            sweep.stack.append((-size, sequence))
        left = [(s, g, OPEN_GAP, r) for r, (g, s) in enumerate(reversed(sweep.stack))] + [(s, -g, PASSED_GAP, None) for g, s in sweep.later]
        for a in range(0, len(left), 10_000):
            some = left[a : a + 10_000]
            none = [pa.nulls(len(some), t) for t in _KINDS]
            more = [[x[0] for x in some], [None] * len(some), [x[1] for x in some], [x[2] for x in some], [part] * len(some), [x[3] for x in some]]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, t) for c, t in zip(more, kinds[5:], strict=True))], names)

    order = [F.desc("size"), F.col("sequence_id").isNull(), "sequence_id", "doc_id", "piece", "ids_crc32"]
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


def resolve(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(piece range, first and last rank, gap range, first gap, pieces a gap) by rank from (range, open pieces, longest, open gaps, smallest) in order; gap range -1 where none is left."""
    free: list[list[int]] = []  # [range, next gap, gaps left, smallest], the nearest range on top
    out = []
    for part, pieces, longest, gaps, smallest in found:
        rank = 0
        while rank < pieces and free:
            top = free[-1]
            each = top[3] // longest
            use = min(top[2], -(-(pieces - rank) // each))
            end = min(pieces, rank + use * each)
            out.append((part, rank, end, top[0], top[1], each))
            top[1], top[2], rank = top[1] + use, top[2] - use, end
            if not top[2]:
                free.pop()
        if rank < pieces:
            out.append((part, rank, pieces, -1, 0, 0))
        if gaps:
            free.append([part, 0, gaps, smallest])
    return out


def _matched(swept: DataFrame, matches: list[tuple], capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The open pieces that ranks give a gap (with sequence and offset), all gaps as they are then, and pieces still open."""
    spark = swept.sparkSession
    table = spark.createDataFrame(matches, "part int, low long, high long, gap_part int, first long, each long")  # at most two rows a range
    pieces = swept.where(f"state = {OPEN_PIECE}").join(F.broadcast(table), "part").where("rank >= low and rank < high")
    hit = pieces.where("gap_part >= 0").withColumn("gap_rank", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    gaps = swept.where(f"state = {OPEN_GAP}").select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("sequence_id").alias("sequence"), F.col("size").alias("gap"))
    order = Window.partitionBy("gap_part", "gap_rank").orderBy("part", "rank")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hit.drop("sequence_id", "offset").join(gaps, ["gap_part", "gap_rank"]).withColumn("offset", F.lit(capacity) - F.col("gap") + before)
    placed = placed.select(*_NAMES, F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    used = hit.groupBy("gap_part", "gap_rank").agg(F.sum("length").alias("used"))
    after = gaps.join(used, ["gap_part", "gap_rank"], "left").select(F.col("sequence").alias("sequence_id"), (F.col("gap") - F.coalesce("used", F.lit(0))).alias("size"))
    passed = swept.where(f"state = {PASSED_GAP}").select("sequence_id", "size")
    return placed, after.union(passed).where("size > 0"), pieces.where("gap_part < 0").select(*_NAMES)


def _opened(pieces: DataFrame, first: int, capacity: int, ranges: int) -> tuple[DataFrame, int]:
    """All pieces in new sequences, numbered from ``first``; as many in one as the longest of its range allows. Also the number after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, each, n, used = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            local, offset = [], []
            for length in batch.column(3).to_pylist():
                if not n or used + length > capacity:  # in descending order, so that one more always fits as long as the last one did
                    n, used = n + 1, 0
                local.append(n - 1)
                offset.append(used)
                used += length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array(offset, pa.int64()), pa.array([part] * len(local), pa.int32())], [*_NAMES, "local", "offset", "part"])

    order = [F.desc("length"), "doc_id", "piece", "ids_crc32"]
    rows = stored(pieces.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(run, f"{_PIECES}, local bigint, offset bigint, part int"), "opened")
    bases = []
    for r in sorted(rows.groupBy("part").agg((F.max("local") + 1).alias("n")).collect()):  # a row a range
        bases.append((r.part, first))
        first += r.n
    table = pieces.sparkSession.createDataFrame(bases, "part int, base long")
    return rows.join(F.broadcast(table), "part").select(*_NAMES, (F.col("base") + F.col("local")).alias("sequence_id"), "offset"), first


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def pack_pieces(pieces: DataFrame, capacity: int, sweeps: int = 1, range_rows: int = 100_000, classes: int = 5) -> DataFrame:
    """The pieces (stored) with sequence_id and offset."""
    cuts = [capacity >> i for i in range(1, classes) if capacity >> i > 1] + [0]
    counts = {r[0]: r[1] for r in pieces.groupBy(_class("length", cuts).alias("c")).agg(F.count("*").alias("n")).collect()}  # a row a class

    def ranges(rows: int) -> int:
        return max(1, -(-rows // range_rows))

    done: list[DataFrame] = []
    gaps: DataFrame | None = None
    opened = n_gaps = 0
    for c, low in enumerate(cuts):
        left_n = counts.get(c, 0)
        if not left_n:
            continue
        left = pieces.where(_class("length", cuts) == c)
        if c and gaps is not None:
            for _ in range(sweeps):
                at = F.col("size") > low
                rows = left.select(*_NAMES, F.lit(None).cast("long").alias("sequence_id"), F.col("length").alias("size"))
                rows = rows.union(gaps.where(at).select(*(F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in _PIECES.split(", "))), "sequence_id", "size"))
                swept = stored(sweep_ranges(rows, ranges(left_n + n_gaps), capacity), "swept")
                found = swept.groupBy("part").agg(
                    F.count_if(F.col("state") == OPEN_PIECE).alias("pieces"),
                    F.max(F.when(F.col("state") == OPEN_PIECE, F.col("length"))).alias("longest"),
                    F.count_if(F.col("state") == OPEN_GAP).alias("gaps"),
                    F.min(F.when(F.col("state") == OPEN_GAP, F.col("size"))).alias("smallest"),
                    F.count_if(F.col("state") == PLACED).alias("placed"),
                )
                found = sorted(found.collect())  # a row a range
                matches = resolve([tuple(r)[:5] for r in found])
                placed, after, open_pieces = _matched(swept, matches, capacity)
                done += [swept.where(f"state = {PLACED}").select(*_NAMES, "sequence_id", "offset"), placed]
                gaps = gaps.where(~at).union(after)
                before, left_n = left_n, sum(hi - lo for _, lo, hi, part, *_ in matches if part < 0)
                left = open_pieces
                if not left_n or left_n == before:
                    break
        if left_n:
            fresh, opened = _opened(left, opened, capacity, ranges(left_n))
            done.append(fresh)
            room = fresh.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("size")).where("size > 0")
            gaps = room if gaps is None else gaps.union(room)
        if gaps is not None and low:
            gaps = stored(gaps, "gaps")
            n_gaps = gaps.count()
    if not done:
        return pieces.select(*_NAMES, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return _union(done)


def _class(column: str, cuts: list[int]):
    """The number of the first cut below the length."""
    out = F.lit(len(cuts) - 1)
    for i in range(len(cuts) - 2, -1, -1):
        out = F.when(F.col(column) > cuts[i], i).otherwise(out)
    return out


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = WORD_BPE, end_id: int = 0, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece; ``how``: of ``pack_pieces``."""
    return pack_pieces(stored(token_pieces(docs, id_col, text_col, vocabulary, end_id, capacity), "pieces"), capacity, **how)
