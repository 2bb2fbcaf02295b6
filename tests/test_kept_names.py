"""Kept names against their SQL where classes hang below key 0, a parent is missing, and numbers or keys are null."""

import duckdb

from corroba.plans import names
from corroba.plans.queries import ORACLE_SQL


def test_field_bounds_count_every_class_above(spark, tmp_path):
    rows = [(0, 3), (1, 2), (2, None), (4, 7), (5, 6), (8, 1), (9, 50), (17, 10), (21, 11), (23, 12), (33, 13), (70, 14), (None, 5), (-1, 3), (-7, 9)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    bounds = con.sql(ORACLE_SQL["kept_names"]).select("id, field_bound").fetchall()
    got = names.kept_names(spark, str(tmp_path))
    assert sorted((r.id, r.field_bound) for r in got.collect()) == sorted(bounds)
