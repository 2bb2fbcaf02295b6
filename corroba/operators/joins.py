"""Joins: two-sided unique, range, as-of, positional, set equality and containment.

Null keys never match. No operator relies on row order; ties are broken by the
columns that the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(key, left_id, right_id) where the key has exactly one left and one right holder."""

    def alone(df: DataFrame, ident: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(ident).alias("__n"), F.min(ident).alias(ident)).where("__n = 1").drop("__n")

    return alone(left, left_id).join(alone(right, right_id), key)


def conflict_free(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of which neither side has another distinct partner."""
    l1 = pairs.groupBy(left).agg(F.count_distinct(right).alias("__n")).where("__n = 1").select(left)
    r1 = pairs.groupBy(right).agg(F.count_distinct(left).alias("__n")).where("__n = 1").select(right)
    return pairs.join(l1, left, "left_semi").join(r1, right, "left_semi")


def range_first(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: str, ident: list[str], bucket: float, small: int = 10_000) -> DataFrame:
    """Each row with the first range (by ``order``, one range each) that holds its value, both ends included; rows without one are left out.

    Ranges are cut into buckets of the given width, and a bucket's ranges are kept
    in one array in order. At most ``small`` buckets are broadcast, so that the rows
    stay where they are and none is grouped again; more are joined by the bucket.
    """
    cells = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket).cast("long"), F.floor(F.col(high) / bucket).cast("long"))))
    held = cells.groupBy("__b").agg(F.array_sort(F.collect_list(F.struct(order, low, high, *(c for c in ranges.columns if c not in (order, low, high))))).alias("__ranges"))
    if held.count() <= small:
        held = F.broadcast(held)
    hit = rows.withColumn("__b", F.floor(F.col(value) / bucket).cast("long")).join(held, "__b")
    first = F.get(F.filter("__ranges", lambda r: F.col(value).between(r[low], r[high])), F.lit(0))
    return hit.withColumn("__hit", first).where("__hit is not null").select(*rows.columns, "__hit.*")


def first_along(items: DataFrame, path: DataFrame, table: DataFrame, item: str, owner: str, rank: str) -> DataFrame:
    """Member resolution: each item with the row of ``table`` of the first owner along its path that has the member. items: item and the table's other key columns; path: item's start, owner, rank."""
    keys = [c for c in items.columns if c in table.columns and c != owner]
    found = items.join(path, [c for c in items.columns if c in path.columns]).join(table, [owner, *keys])
    first = Window.partitionBy(item).orderBy(rank, owner)
    return found.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def interval_stab(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, keys: list[str], bucket: int) -> DataFrame:
    """Points with every interval of their keys that covers them: low <= point < high."""
    cells = intervals.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket).cast("long"), F.floor((F.col(high) - 1) / bucket).cast("long"))))
    return points.withColumn("__b", F.floor(F.col(point) / bucket).cast("long")).join(cells, [*keys, "__b"]).where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("__b")


def suppressed_union(own: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """Own rows, and embedded ones whose key the own rows do not cover."""
    return own.unionByName(embedded.join(own.select(key).distinct(), key, "left_anti"))


def first_per_key(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each left row with the first matching right row in a total order."""
    first = right.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
    return left.join(first, key)


def pairs_within(rows: DataFrame, keys: list[str], ident: str, columns: list[str]) -> DataFrame:
    """Self join: pairs of rows of one group, the smaller id first; keys and ``columns`` with suffix 1 and 2."""
    one, two = (rows.select(*keys, *(F.col(c).alias(f"{c}{i}") for c in [ident, *columns])) for i in (1, 2))
    return one.join(two, keys).where(F.col(f"{ident}1") < F.col(f"{ident}2"))


def last_before(column: Column, partition: list[str], order: list[str], inclusive: bool = False) -> Column:
    """As-of: the last non-null value before a row (or at it)."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.last_value(column, F.lit(True)).over(frame)


def zip_join(left: DataFrame, right: DataFrame, key: str, position: str, length: str) -> DataFrame:
    """Positional join of two sequences under one key; only pairs of equal length."""
    return left.join(right, [key, length, position])


def set_key(values: Column) -> Column:
    """A canonical key of a set, for joins on set equality."""
    return F.array_join(F.array_sort(F.collect_set(values)), "\u0001")
