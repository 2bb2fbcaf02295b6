"""What loops leave on disk and how many tasks they start: on many partitions both cost more than the rows."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroba.llm import mixing, near_dup
from corroba.llm.common import shared_dir, stored
from corroba.llm.components import connected_components


@pytest.fixture
def tasks(spark):
    """Runs a function with 37 shuffle partitions that are not merged; gives its result and the tasks it started."""
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}

    def run(f):
        group, tracker = f"tasks-{random.random()}", spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(group, "")
        out = f()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))

    for k, v in conf.items():
        spark.conf.set(k, v)
    yield run
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_near_duplicates_keep_only_what_their_result_reads(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "corroba"
    before = set(folder.glob("*")) if folder.exists() else set()
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(40)) for _ in range(80)) for _ in range(6)]
    rows = [(10 * i + j, t + f" end{j}") for i, t in enumerate(texts) for j in range(3)] + [(100, texts[0] + " end0"), (101, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before}
    assert left == {"sketches", "ids"}
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: 0 if d == 100 else d if d == 101 else d - d % 10 for d, _ in rows}


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_few_edges_have_the_components_of_the_rounds(spark, kind):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 3), (7, 7), (200, 100), (100, 3)]
    df = spark.createDataFrame(edges, "a long, b long").select(F.col("a").cast("string").cast(kind).alias("a"), F.col("b").cast("string").cast(kind).alias("b"))
    one, rounds = connected_components(df).collect(), connected_components(df, few=0).collect()
    assert len(one) == len({r.node for r in one}) and sorted(one) == sorted(rounds)


def test_few_edges_take_no_rounds(spark, tasks):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1)
    got, n = tasks(lambda: connected_components(edges).collect())
    assert {r.component for r in got} == {0} and len(got) == 41
    assert n < 3 * 37


def test_a_step_of_mixing_is_no_shuffle_over_all_partitions(spark, tasks):
    known = stored(spark.createDataFrame([(i, [0.25, 0.75]) for i in range(50)], "n_tokens long, posterior array<double>").coalesce(2), "known")
    got, n = tasks(lambda: mixing._sums(known, 2, lambda n, p: n @ p, 2))
    assert np.allclose(got, [1225 * 0.25, 1225 * 0.75]) and n <= 4
