r"""WARC archives with revisit records and a globally ordered index by external merge.

1. Every page's payload (html as UTF-8) gets its SHA-256 and size. Of records
   with equal payloads of at least ``min_bytes`` the one with the largest page
   id is the response, the others revisit it; smaller ones are all responses.
2. Records are written as WARC/1.1 text by Spark's own writer, the record
   separator being its line separator, so every part file is a valid archive and
   a lost task is written again by the commit protocol.
3. Every archive is read back, parsed by Content-Length, its payload digests are
   computed again and compared, and its entries are sorted by URL key, timestamp
   and page id: one sorted capture run an archive, stored.
4. Runs are cut at common key ranges (URL key, timestamp, page id, so a hot host
   or URL is cut too) and each range is merged from its run slices by a k-way
   loser tree. ``range`` and ``place`` give the global order of the captures.

The timestamp of a capture is ``captured_col`` (epoch seconds) or, without one,
the page id in seconds after 2000-01-01. Null html is empty; a null URL has an
empty key. A null page id is smaller than all others. Repeated rows are records
of their own; those that hold the largest id of equal payloads are all
responses. An empty table gives no rows. Other columns are not read. An archive
holds about ``archive_records`` records at most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroba.llm.common import new_path, stored

CRLF = "\r\n"
SEPARATOR = "\r\n\r\n"
EPOCH_2000 = 946_684_800
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id bigint, url string, urlkey string, ts bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, offset bigint, run string"


def url_key(url: str | None) -> str:
    """Host parts in reverse order, then port and the path in lower case, without scheme, user and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, ts: int, payload: str, refers_to: int | None, revisit: bool) -> str:
    """One WARC record without the separator after it."""
    data = payload.encode("utf-8")
    digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(data)}{SEPARATOR}"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    stamp = np.datetime_as_string(np.datetime64(ts, "s"))
    head += [f"WARC-Date: {stamp}Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode('utf-8'))}"]
    return CRLF.join(head) + SEPARATOR + block


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, in order; raises where one breaks the format or its digest."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:])["Content-Length"])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload at byte {at} does not have its digest")
        url = head.get("WARC-Target-URI")
        url = None if url is None else unquote(url)
        yield {
            "page_id": _page_id(head["WARC-Record-ID"]),
            "url": url,
            "urlkey": url_key(url),
            "ts": int(np.datetime64(head["WARC-Date"][:-1], "s").astype(np.int64)),
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": head["WARC-Type"],
            "refers_to": _page_id(head["WARC-Refers-To"]) if revisit else None,
            "offset": at,
            "payload": None if revisit else payload,
        }
        at = end + 4 + len(block) + len(SEPARATOR)


class LoserTree:
    """Merges sorted sequences: an inner node keeps the loser of its match, so the next smallest costs one path of comparisons."""

    def __init__(self, runs: list[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._pull(i)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._climb(i)

    def _pull(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        """An exhausted run loses to all; equal keys go by run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _climb(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # while the tree is built, the first to come waits
                self.tree[node] = i
                return
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.keys[w := self.tree[0]] is not None:
            yield self.heads[w]
            self._pull(w)
            self._climb(w)


def write_archives(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured_col: str | None = None, min_bytes: int = 0, archive_records: int = 20_000) -> None:
    captured = F.col(captured_col).cast("long") if captured_col else F.coalesce(F.col(page_col), F.lit(0)).cast("long") + EPOCH_2000
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), captured.alias("ts"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))))
    groups = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stored(groups, "payload-groups")  # with its size known, Spark broadcasts it if it is small and sorts both sides if not
    typed = rows.join(groups, "key", "left").withColumn("revisit", F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array([record(*x) for x in zip(*lists, strict=True)], pa.string())], ["value"])

    records = typed.select("page_id", "url", "ts", "payload", "response", "revisit").mapInArrow(run, "value string")
    records.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", archive_records).text(path)


def read_runs(spark, path: str) -> DataFrame:
    """The sorted capture run of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sorted(parse_archive(content.as_py()), key=capture_key)
                for r in found:
                    r["run"] = name.rsplit("/", 1)[-1]
                    del r["payload"]
                for a in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist(found[a : a + 10_000], schema=_arrow_index())

    # one archive a row
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _INDEX)


def _arrow_index() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in _INDEX.split(", "))])


def capture_key(r: dict) -> tuple:
    return (r["urlkey"].encode(), r["ts"], -(1 << 63) if r["page_id"] is None else r["page_id"])


def merge_runs(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """Captures in global order: (range, place) ascends with (urlkey, ts, page_id)."""
    parts = max(1, -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        slices: list[list[dict]] = []
        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["run"] != last:
                    slices.append([])
                    last = r["run"]
                slices[-1].append(r)
        schema = _arrow_index().append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))
        out: list[dict] = []
        for place, r in enumerate(LoserTree(slices, capture_key)):
            out.append(r | {"range": part, "place": place})
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    keys = ["urlkey", "ts", F.col("page_id").asc_nulls_first()]
    return runs.repartitionByRange(parts, *keys).sortWithinPartitions("run", *keys).mapInArrow(run, f"{_INDEX}, range int, place bigint")


def capture_histories(pages: DataFrame, path: str | None = None, range_rows: int = 50_000, **how) -> DataFrame:
    """Writes the archives, reads them back and returns the merged index, one row a record."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **how)
    return merge_runs(stored(read_runs(spark, path), "runs"), range_rows)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top, sha1(h) AS x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a,
    list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(h), (5 * i + 1)::INT, 5))::INT) AS g
  FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(g, lambda v: a[(v >> 15) + 1] || a[((v >> 10) & 31) + 1] || a[((v >> 5) & 31) + 1] || a[(v & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM w
"""
