"""Iterative operators on small graphs with known answers, and their refusals."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corroba.operators import graphs, joins, votes
from corroba.plans.queries import closure_depth, highest_version_select, short_unique_names, topo_layers


def sequential(items, taken=()):
    """Names of (digest, hint, key, space) items in order; ties are numbered."""
    taken, out, items = set(taken), {}, sorted(items)
    for digest, hint, key, space in items:
        run = [k for d, h, k, _ in items if (d, h) == (digest, hint)]
        suffix = f"_{run.index(key) + 1}" if len(run) > 1 else ""
        head = f"{hint}_" if hint else ""
        n = next((n for n in range(4, len(digest) + 1) if (space, f"{head}{digest[:n]}{suffix}") not in taken), len(digest))
        out[key] = f"{head}{digest[:n]}{suffix}"
        taken.add((space, out[key]))
    return out


@pytest.mark.parametrize("hinted", [False, True])
def test_prefixes_equal_the_sequential_rule(spark, hinted):
    rows = spark.range(1500).select(F.col("id").alias("k"), F.sha2((F.col("id") % 1400).cast("string"), 256).alias("h")).withColumn("h", F.concat(F.substring("h", 1, 2), F.substring("h", 10, 6)))
    hint, space = (F.when(F.col("k") % 2 == 0, "a").otherwise("b"), (F.col("k") % 3).cast("string")) if hinted else (None, None)
    items = [(r.h, ("a" if r.k % 2 == 0 else "b") if hinted else None, r.k, str(r.k % 3) if hinted else "") for r in rows.collect()]
    items = [(h, x or "", k, s) for h, x, k, s in items]
    taken = [(s, f"{x}_{h[:4]}" if x else h[:4]) for h, x, k, s in items if k % 40 == 0]
    used = spark.createDataFrame(taken, "space string, name string")
    got = graphs.assign_names(rows, "k", "h", hint, space, used).collect()
    assert {r.k: r.name for r in got} == sequential(items, taken)


def test_prefix_query(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    want = sequential([(hashlib.sha256(r.p_name.encode()).hexdigest(), r.p_brand[:3].lower(), r.p_partkey, str(r.p_size % 3)) for r in part])
    assert {r.p_partkey: r.name for r in short_unique_names(spark, "/root/testdata/sf0.001").collect()} == want


def sequential_selection(requests, pins, constraints=()):
    """The rule one module at a time, as a plain loop."""
    want = dict(pins)
    for _ in range(64):
        at, new, walked = dict(pins), {}, None
        while walked != at:
            walked, new = at, {}
            for m, v, needs, asked in requests:
                if walked.get(m) == v and needs not in pins:
                    new[needs] = max(new.get(needs, asked), asked)
            at = dict(pins) | {k: want.get(k, v) for k, v in new.items()}
        chosen = dict(pins) | {k: max(v, want.get(k, v)) for k, v in new.items()}
        for m, v, needs, asked in constraints:
            if at.get(m) == v and needs in at and needs not in pins:
                chosen[needs] = max(chosen[needs], asked)
        if chosen == want:
            return want
        want = chosen
    raise RuntimeError


@pytest.mark.parametrize(
    ("requests", "pins", "constraints", "want"),
    [
        # a1 asks b1, c asks b2; b1's d leaves with b1
        ([("a", 1, "b", 1), ("a", 1, "c", 1), ("b", 1, "d", 1), ("c", 1, "b", 2), ("b", 2, "e", 1)], {"a": 1}, [], {"a": 1, "b": 2, "c": 1, "e": 1}),
        # b and c upgrade each other
        ([("a", 1, "b", 1), ("a", 1, "c", 1), ("b", 1, "c", 2), ("c", 2, "b", 2), ("b", 2, "c", 2)], {"a": 1}, [], {"a": 1, "b": 2, "c": 2}),
        # a pin blocks an upgrade, a constraint raises what is there and adds nothing
        ([("a", 1, "b", 3), ("a", 1, "c", 1)], {"a": 1, "b": 1}, [("a", 1, "c", 5), ("a", 1, "x", 1)], {"a": 1, "b": 1, "c": 5}),
        ([], {"a": 1}, [], {"a": 1}),
    ],
)
def test_selection_follows_the_rule(spark, requests, pins, constraints, want):
    schema = "module string, version int, needs string, needs_version int"
    got = graphs.select_versions(spark.createDataFrame(requests, schema), spark.createDataFrame(list(pins.items()), "module string, version int"), spark.createDataFrame(constraints, schema))
    assert {r.module: r.version for r in got.collect()} == want == sequential_selection(requests, pins, constraints)


def test_selection_query(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    requests = {(r.p_partkey % 200, r.p_size % 6, (r.p_partkey * 7 + 3) % 200, (r.p_size * 5 + r.p_partkey) % 6) for r in part if r.p_partkey % 3 > 0}
    rules = {(r.p_partkey % 200, r.p_size % 6, (r.p_partkey * 11 + 1) % 200, 6) for r in part if r.p_partkey % 17 == 0}
    pins = {}
    for r in part:
        if r.p_partkey % 200 < 5:
            pins[r.p_partkey % 200] = min(pins.get(r.p_partkey % 200, 9), r.p_size % 6)
    got = highest_version_select(spark, "/root/testdata/sf0.001").collect()
    assert {r.module: r.version for r in got} == sequential_selection(requests, pins, rules)


def test_redirected_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = graphs.redirected(e, spark.createDataFrame([("b", "c")], "src string, dst string"), spark.createDataFrame([("a",)], "node string"))
    assert sorted(r.node for r in got.collect()) == ["a", "b", "c", "d"]


def test_closure_of_a_cycle_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "s int, d int")
    got = {(r.src, r.dst): r.depth for r in graphs.closure(e, "s", "d", 10).collect()}
    assert got == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (4, 4): 1, (1, 3): 2, (2, 1): 2, (3, 2): 2, (1, 1): 3, (2, 2): 3, (3, 3): 3}


def test_deep_keys_are_not_left_out(spark, tmp_path):
    """Chains of 13 and 14 steps: a part table with large keys, beyond the rounds that the SQL is unrolled to."""
    def chain(key, by):
        return [key // by**i for i in range(20) if key // by**i]

    deep, long = chain(4**13 + 1, 4), chain(3**13, 3)
    for name, keys in (("deep", deep), ("long", long)):
        spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / name / "part.parquet"))
    assert {r.node: r.layer for r in topo_layers(spark, str(tmp_path / "deep")).collect()} == {k: i for i, k in enumerate([0, *deep[::-1]])}
    want = {(a, b): j - i for i, a in enumerate(long) for j, b in enumerate(long) if i < j}
    assert {(r.src, r.dst): r.depth for r in closure_depth(spark, str(tmp_path / "long")).collect()} == want


def test_layers_and_closure_refuse_to_stop_early(spark):
    e = graphs.cut(spark.createDataFrame([(i + 1, i) for i in range(5)], "src int, dst int"))
    assert graphs.layers(e, 5).count() == 6 and graphs.closure(e, "src", "dst", 5).count() == 15
    with pytest.raises(RuntimeError, match="layers"):
        graphs.layers(e, 4)
    with pytest.raises(RuntimeError, match="closure"):
        graphs.closure(e, "src", "dst", 4)


def test_components_of_a_long_path_and_alone(spark):
    nodes = spark.range(40).select(F.col("id").alias("n"))
    edges = spark.range(30).selectExpr("id + 1 a", "id b")
    got = {r.node: r.component for r in graphs.components(nodes, "n", edges, "a", "b").collect()}
    assert got == {i: 0 if i <= 30 else i for i in range(40)}


def test_two_values_of_one_key_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k int, rank int, v string")
    with pytest.raises(Exception, match="two values"):
        votes.lattice_min(rows, ["k"], "rank", "v").collect()


@pytest.mark.parametrize("parts", [1, 7])
def test_unique_join_refuses_shared_keys(spark, parts):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "h string, l int").repartition(parts)
    right = spark.createDataFrame([("a", 9), ("b", 8), (None, 7)], "h string, r int").repartition(parts)
    assert [tuple(r) for r in joins.unique_join(left, right, "h", "l", "r").collect()] == [("a", 1, 9)]
