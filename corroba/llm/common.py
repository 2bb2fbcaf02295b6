"""What the operators of this package share: the shared folder, stored tables, mixing functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's regular expression for the white space that the text contracts name.
SPACE = r"[\x20\x09-\x0D]+"

BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Where it is unset, a local master, as in tests, gets a folder of its own and a cluster an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corroba-"))
        given = spark.sparkContext.getCheckpointDir()
    return str(given).rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corroba/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors. Batches to Python hold at most ``BATCH_ROWS`` rows meanwhile, as texts can be long. The driver then collects its garbage, on which Spark's cleaner drops the shuffle files and broadcasts that the table no longer needs."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, str(before))
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/corroba/" in folder:
                path = hadoop(folder)
                path.getFileSystem(conf).delete(path, True)


def crc32_fold(column: str, modulo: int) -> Column:
    """crc32(id as text) mod ``modulo``; a null id falls in fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulo)).cast("int"), F.lit(-1))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits, so that sums of powers spread over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_batches(texts: list, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``max_bytes`` each, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= max_bytes:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
