"""Votes, lattice aggregates, bit masks and agreement tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vote(rows: DataFrame, key: str, choice: str, weight: Column | None = None) -> DataFrame:
    """(key, choice, n, second, total): winner, its votes, the runner-up's and all; ties go to the smaller choice."""
    counts = rows.groupBy(key, choice).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), choice)
    ranked = counts.withColumn("__r", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return ranked.where("__r = 1").drop("__r")


def argmax_ties(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """All rows that hold the greatest score of their keys."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score)))).where("__r = 1").drop("__r")


def lattice_min(rows: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """The least rank of each key and its one value; two different values are an error."""
    out = rows.groupBy(*keys).agg(F.min(rank).alias(rank), F.count_distinct(value).alias("__n"), F.min(value).alias(value))
    clash = F.raise_error(F.concat_ws(" ", F.lit("two values for"), *keys)).cast(out.schema[value].dataType)
    return out.withColumn(value, F.when(F.col("__n") > 1, clash).otherwise(F.col(value))).drop("__n")


def mask_union(rows: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """The bits of equal records, united."""
    return rows.groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit).cast("int"))).alias("mask"))


def unique_holder(rows: DataFrame, value: str, holder: str) -> DataFrame:
    """Rows with ``is_unique``: the value belongs to one holder."""
    one = rows.groupBy(value).agg((F.count_distinct(holder) == 1).alias("is_unique"))
    return rows.join(one, value)


def without_bit(masks: DataFrame, bit: int) -> DataFrame:
    """Leave-one-out: the bit cleared, records without any bit dropped."""
    return masks.withColumn("mask", F.col("mask").bitwiseAND(~(1 << bit))).where("mask <> 0")


def all_agree(value: Column) -> Column:
    """Every row has a value and all are equal."""
    return (F.count(F.lit(1)) == F.count(value)) & (F.min(value) == F.max(value))
