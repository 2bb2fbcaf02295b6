"""Reports and dumps as text: JSON with a fixed order of keys, canonical rendering of ordered children, a canonical sort at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_json(sections: dict[str, DataFrame], optional: set[str] = frozenset(), order: dict[str, list[str]] | None = None) -> DataFrame:
    """(json): one object of all sections in order, each an array of its rows sorted by all columns (or ``order``), optional ones left out when empty. Sections are summaries: each is one value."""
    out = None
    for name, df in sections.items():
        by = (order or {}).get(name, df.columns)
        row = F.struct(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.struct(*df.columns).alias("row"))
        rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
        one = df.agg(rows.alias("rows")).select(F.lit(1).alias("one"), F.when(F.lit(name in optional) & (F.size("rows") == 0), F.lit(None)).otherwise(F.concat(F.lit(f'"{name}":'), F.to_json("rows"))).alias(name))
        out = one if out is None else out.join(one, "one")
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *(F.col(n) for n in sections)), F.lit("}")).alias("json"))


def canonical_text(children: DataFrame, key: str, order: list[str], text: Column, separator: str = "\n") -> DataFrame:
    """(key, text): the texts of a row's children in order, as what is hashed or printed."""
    each = F.struct(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(order)), text.alias("text"))
    return children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda r: r["text"]), separator).alias("text"))


def multi_file(sizes: DataFrame, key: str, size: str, most: int, files: int = 1, max_rounds: int = 20) -> DataFrame:
    """(key, file): contiguous chunks of the sorted keys, as few as keep every chunk's sum of sizes within ``most``; more files are tried until all fit. One key beyond ``most`` is an error."""
    from pyspark.sql import Window

    total, largest = sizes.agg(F.sum(size), F.max(size)).first()
    if largest is not None and largest > most:
        raise ValueError(f"one item of {largest} is over {most}")
    ranged = sizes.select(key, size).repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    before = {}
    at = 0
    for r in ranged.groupBy("__part").agg(F.sum(size).alias("s")).orderBy("__part").collect():  # a row a range
        before[r[0]] = at
        at += r.s
    files = max(files, -(-int(total or 0) // most))
    base = sizes.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __base long")
    run = F.sum(size).over(Window.partitionBy("__part").orderBy(key))
    placed = ranged.join(F.broadcast(base), "__part").withColumn("__end", F.col("__base") + run)
    for _ in range(max_rounds):
        chunk = -(-int(total or 0) // files) or 1
        out = placed.select(key, size, F.floor((F.col("__end") - 1) / chunk).cast("int").alias("file"))
        if (out.groupBy("file").agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0) <= most:
            return out.select(key, "file")
        files += max(1, files // 4)
    raise RuntimeError("no number of files fits")
