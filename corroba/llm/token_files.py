"""Token-id files: one zstandard frame a document, a shared dictionary, an offset index.

A dataset is a folder with

* ``dictionary``: the shared zstandard dictionary, its SHA-256 and the width of
  an id, one row;
* ``data``: one row a block of about ``block_bytes``: ``shard``, ``block``,
  ``min_id`` and ``max_id`` (a reader of few documents skips other blocks by
  the files' own statistics), ``payload`` (the frames of consecutive documents)
  and ``docs``, the offset index of the block (doc_id, start in the shard,
  n_tokens, offset, length);
* ``shards``: ids before each shard, at most ``MAX_SHARDS`` rows.

Shards are ranges of doc_id and blocks are in order inside a shard, so the files
hold all ids in ascending doc_id order. They are written by Spark's own writers
and so by its commit protocol: a lost executor's task is done again and leaves
nothing twice. A frame is opened only with the dictionary whose hash the block
names, and one document is read by its block and its frame alone.

The dictionary is trained on the id arrays of ``sample_docs`` documents, those
with the smallest hash of their id; with too few of them it is empty. Everything
else covers all documents. A null text is an empty one and has the end id alone.
Null ids come first. Repeated rows are documents of their own, in any order
among equal ids. Very long texts are encoded whole; a document's frame is one
value and so at most 2 GB. An empty table gives no rows. Other columns are not
read, so that their names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.llm.tokens import encoder

BYTE_BPE = "byte_bpe_50k.json"
#: More shards than this are not made; a shard then holds more documents, which a task streams. Bounds the cuts and the offsets of shards that the driver holds.
MAX_SHARDS = 10_000
_DOCS = "array<struct<doc_id:bigint,start:bigint,n_tokens:bigint,offset:bigint,length:bigint>>"
_DOC_TYPE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, dtype: str, sample_docs: int, size: int) -> bytes:
    import zstandard

    rows = _rows(docs, id_col, text_col)
    chosen = rows.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, False)
        for batch in batches:
            out = [np.append(np.frombuffer(b, "<u4"), end_id).astype(dtype).tobytes() for b in enc.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    # Of rows that share an id the smallest ids array is taken, so that the same rows train the same dictionary.
    once = sample.mapInArrow(run, "doc_id bigint, ids binary").groupBy("doc_id").agg(F.min("ids").alias("ids"))
    ids = [bytes(r.ids) for r in once.orderBy("doc_id").toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = BYTE_BPE,
    end_id: int = 0,
    sample_docs: int = 400,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
    shard_rows: int = 10_000,
    block_bytes: int = 1 << 20,
    dtype: str = "<u2",
) -> None:
    """Writes the dataset. ``dtype`` has to hold every id of the vocabulary, else this raises."""
    spark = docs.sparkSession
    if max(encoder(vocabulary, False).tokenizer.get_vocab_size() - 1, end_id) > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} does not hold every id of {vocabulary}")
    rows = _rows(docs, id_col, text_col)
    known = train_dictionary(docs, id_col, text_col, vocabulary, end_id, dtype, sample_docs, dictionary_bytes)
    mark = hashlib.sha256(known).hexdigest()
    spark.createDataFrame([(mark, bytearray(known), dtype)], "dict_sha256 string, dictionary binary, dtype string").coalesce(1).write.parquet(f"{path}/dictionary")

    total = rows.count()
    shards = min(MAX_SHARDS, max(1, -(-total // shard_rows)))
    cuts = np.zeros(0, np.int64)
    if shards > 1:
        at = [i / shards for i in range(1, shards)]
        found = rows.agg(F.percentile_approx("doc_id", at, 100 * shards)).first()[0]
        cuts = np.unique(np.array(found or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(vocabulary, False)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known) if known else None, write_content_size=True)
        for batch in batches:
            sizes, frames = [], []
            for b in enc.encode(batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(b, "<u4"), end_id).astype(dtype)
                sizes.append(len(ids))
                frames.append(packer.compress(ids.tobytes()))
            keys = np.array([-(1 << 63) if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(cuts, keys, "right"), pa.int32()), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "shard", "n_tokens", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, payload, index = None, 0, 0, bytearray(), []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([mark]), pa.array([index[0]["doc_id"]], pa.int64()), pa.array([index[-1]["doc_id"]], pa.int64()), pa.array([bytes(payload)], pa.binary()), pa.array([index], pa.list_(_DOC_TYPE))], ["shard", "block", "dict_sha256", "min_id", "max_id", "payload", "docs"])

        for batch in batches:
            for doc_id, of, n, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if index and (of != shard or len(payload) + len(frame) > block_bytes):
                    yield full()
                    block, payload, index = block + 1, bytearray(), []
                if of != shard:
                    shard, block, start = of, 0, 0
                index.append({"doc_id": doc_id, "start": start, "n_tokens": n, "offset": len(payload), "length": len(frame)})
                payload += frame
                start += n
        if index:
            yield full()

    frames = rows.mapInArrow(encode, "doc_id bigint, shard int, n_tokens bigint, frame binary")
    ranged = frames.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
    ranged.mapInArrow(pack, f"shard int, block int, dict_sha256 string, min_id bigint, max_id bigint, payload binary, docs {_DOCS}").write.option("compression", "none").parquet(f"{path}/data")

    totals = spark.read.parquet(f"{path}/data").select("shard", F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["n_tokens"]).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    bases, base = [], 0
    for r in totals.orderBy("shard").collect():  # at most MAX_SHARDS rows
        bases.append((r.shard, base))
        base += r.n
    spark.createDataFrame(bases, "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document's ids (little-endian unsigned 32-bit) from the files; ``doc_ids``: of these alone."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    known, mark, dtype = bytes(head.dictionary), head.dict_sha256, head.dtype
    only = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        if hashlib.sha256(known).hexdigest() != mark:
            raise ValueError("the dictionary does not have its hash")
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() != mark:
                    raise ValueError("a block was written with another dictionary")
                payload = memoryview(batch.column(2)[i].as_buffer())
                out: list[tuple] = []
                for d in batch.column(3)[i].as_py():
                    if only is None or d["doc_id"] in only:
                        ids = np.frombuffer(opener.decompress(payload[d["offset"] : d["offset"] + d["length"]]), dtype).astype("<u4").tobytes()
                        out.append((d["doc_id"], batch.column(0)[i].as_py(), d["start"], len(ids) // 4, zlib.crc32(ids), ids))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "shard", "local", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{path}/data")
    if only is not None:
        wanted = sorted(only)
        hits = [(F.col("max_id") >= x) & (F.col("min_id").isNull() | (F.col("min_id") <= x)) for x in wanted]
        blocks = blocks.where(reduce(Column.__or__, hits, F.lit(False)))
    docs = blocks.select("shard", "dict_sha256", "payload", "docs").mapInArrow(run, "doc_id bigint, shard int, local bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return docs.join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")
