"""Exact duplicates: local combining, salted merging, a global merge of the salt winners, on full content.

Texts are equal when they are identical after every run of white space
``[\\x20\\x09-\\x0D]`` became one space. All steps are DataFrame functions.

1. Every row gets the SHA-256 of its normalised text; id and digest are stored.
2. Digests that hold over a thousandth of all rows are hot; there can be no
   more than a thousand of them, so they are broadcast.
3. Rows are grouped by digest, salt and the normalised text itself. Spark
   combines inside each partition first, so a partition sends a text once. Hot
   groups carry a salt by partition, others the salt 0.
4. The salt winners of hot groups meet in a second grouping, again by digest
   and full text. Each text so crosses the network once a partition at most.
5. Rows find their winner by digest. If one digest ever stands for two texts,
   the rows of that digest are matched by digest and full text instead.

Null text counts as empty, and all empty texts are one group. Among equal texts
the rows that hold the smallest id stay (repeated rows with one id all do; null
ids come last, and a group of null ids keeps all its rows). An empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroba.llm.common import SPACE, discard, stored


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot_part: int = 1000, hot_rows: int = 1000, digest=sha256_digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row a row of ``docs``.

    ``hot_part``: a digest is hot with over one ``hot_part``-th of all rows and over ``hot_rows``. ``digest``: from normalised text to a key.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("content"))
    keyed = rows.withColumn("digest", digest(F.col("content")))
    narrow = stored(keyed.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256")) if digest is not sha256_digest else keyed.select("doc_id", "digest"), "digests")
    counts = narrow.groupBy("digest").agg(F.count("*").alias("n"))
    total = narrow.count()
    hot = stored(counts.where(F.col("n") > max(hot_rows, total // hot_part)).select("digest"), "hot")  # at most hot_part rows

    salted = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(-1))
    merged = salted.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = stored(merged.select("digest", "salt", F.when(F.col("salt") >= 0, F.col("content")).alias("content"), "keep_id", "n"), "merged")
    cold = merged.where("salt < 0").select("digest", "keep_id", F.col("n").alias("group_size"))
    winners = cold.union(merged.where("salt >= 0").groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).select("digest", "keep_id", "group_size"))

    shared = stored(winners.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "shared")
    if shared.isEmpty():
        discard(docs.sparkSession, shared)
        out = narrow.join(winners, "digest")
    else:
        doubtful = keyed.join(shared, "digest", "left_semi")
        exact = doubtful.groupBy("digest", "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        sure = narrow.join(shared, "digest", "left_anti").join(winners, "digest")
        rest = doubtful.withColumn("text_sha256", F.sha2("content", 256)).join(exact, ["digest", "content"]).select(sure.columns)
        out = sure.union(rest)
    sha = F.col("text_sha256") if "text_sha256" in out.columns else F.lower(F.hex("digest"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
