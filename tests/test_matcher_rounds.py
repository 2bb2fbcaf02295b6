"""The matcher runs until nothing is left to accept, however many rounds and cells that takes."""

import random

import test_matching
from pyspark.sql import functions as F
from test_matching import plain_align, plain_match

from corroba.operators import matching
from corroba.plans import matching as plans


def test_a_chain_of_calls_is_followed_to_its_end(spark, tmp_path):
    ids = [o for o in range(1, 15) if o % 13]  # a library body whose number 13 divides is a bridge and would end the chain
    orders = [(o, 7, "1-URGENT") for o in ids]
    lines = [(ids[0], 1, 50, 5), (ids[0], 2, 60, 6), *((o, 1, 20, 3) for o in ids[1:])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, 1, 1.0, "A")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.app - plans.APP, r.key): r.via for r in plans.matcher_fixpoint(spark, str(tmp_path)).collect()}
    assert set(got) == {(o, o) for o in ids}
    assert sum(via == "callgraph" for via in got.values()) > 8


def test_random_programs_equal_the_plain_loop_without_a_bound(spark, monkeypatch):
    monkeypatch.setattr(test_matching, "range", lambda *a: range(10_000) if a == (8,) else range(*a), raising=False)
    rng = random.Random(0)
    app, db = [], []
    for c in range(12):
        for m in range(14):
            i = 14 * c + m
            base = [rng.randrange(50) for _ in range(16)]
            kind, proto = int(m % 7 == 6), rng.choice("pqrst")
            calls = [("a", i + 1), ("b", (i * 5) % 168)] if m % 3 else [("a", i + 1)]
            home = c if rng.random() < 0.9 else rng.randrange(12)
            db.append((i, c, True, kind, f"h{i}", None, proto, base, [(t, j) for t, j in calls if j < 168], m == 5, m == 9, 0))
            changed = [x if rng.random() < 0.3 else rng.randrange(50) for x in base]
            app.append((i + 1000, home + 100, True, kind, f"h{i}" if m == 0 and c % 4 == 0 else f"x{i}", None, proto if rng.random() < 0.8 else "z", changed, [(t, j + 1000) for t, j in calls if j < 168 and rng.random() < 0.95], m == 5))
    fields = "id long, class long, informative boolean, kind int, all_h string, strings_h string, proto_h string, sketch array<int>, callees array<struct<token:string,id:long>>, is_init boolean"
    app, db = spark.createDataFrame(app, fields), spark.createDataFrame(db, fields + ", bridge boolean, record int")
    shapes = spark.createDataFrame([(c, f"s{c % 9}", f"t{c}") for c in range(1)], "class long, c2 string, c3 string")
    mine = shapes.withColumn("class", F.col("class") + 100).withColumn("trivial", F.col("class") % 4 == 3)
    tables = app, db, mine, shapes
    rounds, kept = [], matching.kept
    monkeypatch.setattr(matching, "kept", lambda df: ("same" in df.columns and rounds.append(df)) or kept(df))
    got = {tuple(r) for r in matching.match(*tables).collect()}
    assert got == plain_match(*(x.collect() for x in tables))
    assert {v for *_, v in got} == {"exact:all", "callgraph", "class:proto", "mutual-best"}
    assert len(rounds) > 9


def test_large_tables_are_aligned_by_blocks(spark):
    rng = random.Random(2)
    for n, m in ((600, 600), (3, 100_000), (100_000, 3), (711, 523)):
        a, b = ([rng.choice([None, "a", "b", "c"]) for _ in range(k)] for k in (n, m))
        assert matching.align(a, b) == [] and matching.align(a, b, None) == plain_align(a, b)
    calls = [("t", 1)] * 600
    one = lambda i, c: spark.createDataFrame([(i, [0] * 16, c, 0)], "id long, sketch array<int>, callees array<struct<token:string,id:long>>, record int")
    pair = spark.createDataFrame([(9, 8)], "app long, key long")
    assert [tuple(r) for r in matching.call_graph(one(9, calls), one(8, calls), pair).collect()] == [(1, 1)]
