"""What keeps the matcher small: methods made once, pairs that stay where the class join put them, one pass over both sides; and elements that are null."""

from pyspark.sql import functions as F

from corroba.operators import matching
from corroba.plans import matching as plans

DIR = "/root/testdata/sf0.001"


def test_methods_are_made_once_and_pairs_stay(spark):
    app, db = plans._methods(spark, DIR)
    assert not [f for df in (app, db) for f in df.inputFiles() if "lineitem" in f]
    classes = spark.createDataFrame([(1_000_001, 1, True)], "class long, db_class long, strong boolean")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = matching.scored_pairs(app, db, classes)
        for found in (matching.unique_protos(pairs), matching.mutual_best(pairs.where("strong"))):
            plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.count("Exchange hashpartitioning") == 4  # both sides of the joins by class and by db_class
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_lines_are_dealt_once(spark):
    sketches = plans._sketches(plans._lines(spark, DIR))
    assert sketches._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_null_element_is_none(spark):
    rows = spark.createDataFrame([(1, None, 2), (2, "a", 1), (3, "a", 1), (3, None, 1)], "k int, e string, n int")
    got = {r.k: r.sketch for r in matching.weighted_sketch(rows, "k", "e", "n").collect()}
    assert got[1] == [None] * 16 and got[2] == got[3] and None not in got[2]


def test_exact_pairs_of_several_records(spark):
    kind = "id long, class long, kind int, informative boolean, all_h string, strings_h string"
    app = spark.createDataFrame([(1, 10, 0, True, "a", None), (2, 10, 0, True, "b", "s"), (3, 10, 1, True, "c", None), (4, 11, 0, True, "d", "t"), (5, 11, 0, True, None, "u"), (6, 11, 0, False, "f", "v")], kind)
    db = spark.createDataFrame([(101, 20, 0, True, "a", "s"), (101, 20, 0, True, "a", "s"), (102, 20, 0, True, "x", "s"), (103, 20, 0, True, "c", None), (104, 21, 0, True, "d", None), (105, 21, 0, True, None, "u"), (106, 21, 0, True, "f", "v")], kind).withColumn("bridge", F.col("id") == 104)
    got = matching.exact_stages(app, db).select("app", "key", "via", "class", "db_class").collect()
    assert sorted(map(tuple, got)) == [(1, 101, "exact:all", 10, 20), (5, 105, "exact:strings", 11, 21)]
