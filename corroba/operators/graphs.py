"""Iterative operators: closure, components, label refinement, layers, cancelling, version selection, unique prefixes.

Every loop stops when nothing changes. Bounds are part of the meaning of
``refine`` and of prefixes; elsewhere reaching one is an error. Rounds are cut by ``checkpoint`` in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> None:
    """Sets the shared folder that ``spark.checkpoint.dir`` names; where it is unset, a local master, as in tests, gets one of its own and a cluster an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="corroba-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows checkpointed in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The rows as compressed columns in the shared folder, for tables that are read often or in parts. The driver then collects its garbage, on which Spark's cleaner drops the shuffle files behind them."""
    spark = df.sparkSession
    _shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/corroba/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, src: str, dst: str, max_depth: int = 64) -> DataFrame:
    """(src, dst, depth): the least number of steps; more than ``max_depth`` are an error. Cycles end by the seen set."""
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    seen = frontier = cut(step.withColumn("depth", F.lit(1)))
    for depth in range(2, max_depth + 2):
        nxt = frontier.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = cut(nxt.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"closure has paths of more than {max_depth} steps")


def components(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that is reachable; nodes without edges are their own."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct()
    both = cut(both)
    label = cut(nodes.select(F.col(node).alias("node"), F.col(node).alias("component")).distinct())
    for _ in range(max_rounds):
        heard = both.join(label, both.v == label.node).groupBy("u").agg(F.min("component").alias("m"))
        nxt = label.join(heard, label.node == heard.u, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = nxt.select(F.col("node").alias("component"), F.col("component").alias("up"))
        nxt = cut(nxt.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        moved = nxt.join(label.withColumnRenamed("component", "old"), "node").where("component <> old")
        done = moved.isEmpty()
        label = nxt
        if done:
            return label
    raise RuntimeError("components did not settle")


def refine(nodes: DataFrame, edges: DataFrame, rounds: int, name: Column) -> DataFrame:
    """Label refinement: (node, label) after so many rounds. nodes: node; edges: src, dst.

    A label hashes the own label and, for both directions, the multiset of the
    neighbours' labels. The multiset is given by the sum of 31-bit hashes of its
    members at two seeds and their number, so that a node of any degree costs a
    few numbers and not a list of its neighbours.
    """
    label = nodes.withColumn("label", name)

    def piece(seed: int) -> Column:
        return F.sum(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "label")), 1, 8), 16, 10).cast("long"))

    def summary(by: str, other: str) -> DataFrame:
        near = edges.join(label.withColumnRenamed("node", other), other)
        return near.groupBy(F.col(by).alias("node")).agg(F.concat_ws(",", F.count("*").cast("string"), piece(1).cast("string"), piece(2).cast("string")).alias(by))

    for _ in range(rounds):
        joined = label.join(summary("src", "dst"), "node", "left").join(summary("dst", "src"), "node", "left")
        text = F.concat_ws("|", "label", F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit("")))
        label = cut(joined.select("node", F.substring(F.sha2(text, 256), 1, 16).alias("label")))
    return label


def layers(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, layer): nodes whose targets all lie in earlier layers; nodes on or before a cycle are left out. More than ``max_rounds`` layers are an error. edges: src, dst."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    placed = cut(nodes.join(edges, nodes.node == edges.src, "left_anti").withColumn("layer", F.lit(0)))
    for k in range(1, max_rounds + 2):
        waiting = edges.join(placed.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("src").alias("node"))
        fresh = nodes.join(placed, "node", "left_anti").join(waiting, "node", "left_anti")
        fresh = cut(fresh.withColumn("layer", F.lit(k)))
        if fresh.isEmpty():
            return placed
        placed = placed.unionByName(fresh)
    raise RuntimeError(f"more than {max_rounds} layers")


def cancel(moves: DataFrame, constraints: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Moves (item, target) that remain when both ends of every violated constraint (a, b: same target) are cancelled, again and again."""
    left = cut(moves)
    for _ in range(max_rounds):
        pair = constraints.join(left.select(F.col("item").alias("a"), F.col("target").alias("ta")), "a", "left").join(left.select(F.col("item").alias("b"), F.col("target").alias("tb")), "b", "left")
        broken = pair.where("not (ta <=> tb)")
        out = broken.select(F.col("a").alias("item")).union(broken.select("b")).distinct()
        nxt = cut(left.join(out, "item", "left_anti"))
        if nxt.count() == left.count():
            return nxt
        left = nxt
    raise RuntimeError("cancelling did not settle")


def select_versions(requests: DataFrame, pins: DataFrame, constraints: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """(module, version): a highest-version selection, to a fixpoint.

    requests, constraints: module, version, needs, needs_version; pins: module,
    version (one each), which stay as they are. Every round walks what the pins
    reach under the selection of the round before; a module that the walk meets
    gets the greatest version that walked modules ask for, never less than it had,
    and what only an evicted version asked for is not met and leaves. Constraints
    raise modules that the walk met and add none. Versions are compared as they
    sort. Without an end after ``max_rounds`` this raises.
    """
    pins = cut(pins.select("module", "version").distinct())
    want = pins
    for _ in range(max_rounds):
        met = pins
        while True:  # one step of the walk at a time, in the old selection or, for new modules, by the greatest request so far
            asked = requests.join(met, ["module", "version"]).select(F.col("needs").alias("module"), F.col("needs_version").alias("version"))
            fresh = asked.join(pins.select("module"), "module", "left_anti").groupBy("module").agg(F.max("version").alias("asked"))
            old = want.select("module", F.col("version").alias("old"))
            nxt = fresh.join(old, "module", "left").select("module", F.coalesce("old", "asked").alias("version"), F.greatest("asked", F.coalesce("old", "asked")).alias("next"))
            walked = cut(pins.withColumn("next", F.col("version")).union(nxt.select("module", "version", "next")))
            same = walked.select("module", "version").exceptAll(met.select("module", "version")).isEmpty() and met.select("module", "version").exceptAll(walked.select("module", "version")).isEmpty()
            met = walked.select("module", "version")
            if same:
                break
        chosen = walked.select("module", F.col("next").alias("version"))
        if constraints is not None:
            raised = constraints.join(met, ["module", "version"]).select(F.col("needs").alias("module"), F.col("needs_version").alias("version")).join(chosen.select("module"), "module", "left_semi").join(pins.select("module"), "module", "left_anti")
            chosen = chosen.union(raised).groupBy("module").agg(F.max("version").alias("version"))
        chosen = cut(chosen)
        if chosen.exceptAll(want).isEmpty() and want.exceptAll(chosen).isEmpty():
            return chosen
        want = chosen
    raise RuntimeError(f"version selection did not converge in {max_rounds} rounds")


def redirected(edges: DataFrame, redirects: DataFrame, starts: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node): what the starts declare, through redirects (src, dst: a module that only points to another). edges: src, dst; starts: node."""
    every = edges.select("src", "dst").union(redirects.select("src", "dst")).distinct()
    seen = frontier = cut(starts.select("node").distinct())
    for _ in range(max_depth + 1):
        frontier = cut(frontier.join(every, frontier.node == every.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"more than {max_depth} steps")


def assign_names(items: DataFrame, key: str, digest: str, hint: Column | None = None, space: Column | None = None, taken: DataFrame | None = None, shortest: int = 4) -> DataFrame:
    """(key, digest, name, tied): ``hint_prefix`` names as if items came in (digest, hint, key) order.

    Each gets the shortest prefix of its digest, of ``shortest`` at least, that is
    not taken in its namespace; a name once given makes later ones grow. Items of
    one digest and hint cannot be told apart: all of them are numbered ``_1``,
    ``_2`` and so on, by key, and ``tied``. Where the whole digest is taken the name is
    given all the same, as nothing longer is left. taken: space, name.
    """
    hint, space = hint if hint is not None else F.lit(None).cast("string"), space if space is not None else F.lit("")
    all_of = Window.partitionBy("hint", "digest")
    left = items.select(F.col(key).alias("key"), F.col(digest).alias("digest"), hint.alias("hint"), space.alias("space"))
    left = left.withColumn("tied", F.count("*").over(all_of) > 1).withColumn("n", F.row_number().over(all_of.orderBy("key")))
    left = left.withColumn("suffix", F.when(F.col("tied"), F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""))
    left = cut(left.withColumn("head", F.coalesce(F.concat("hint", F.lit("_")), F.lit(""))))
    longest = left.agg(F.max(F.length("digest"))).first()[0] or shortest
    used = taken.select("space", "name") if taken is not None else items.sparkSession.createDataFrame([], "space string, name string")
    named: DataFrame | None = None
    for n in range(shortest, max(longest, shortest) + 1):
        last = n >= max(longest, shortest)
        first = Window.partitionBy("space", "name").orderBy("digest", "hint", "key")
        tried = left.withColumn("name", F.concat("head", F.substring("digest", 1, n), "suffix"))
        tried = tried.join(used.withColumn("used", F.lit(True)).distinct(), ["space", "name"], "left").withColumn("r", F.row_number().over(first))
        tried = cut(tried)
        won = tried.where("r = 1 and used is null" if not last else "true")
        named = won.select("key", "digest", "name", "tied", "space") if named is None else named.unionByName(won.select("key", "digest", "name", "tied", "space"))
        left = tried.where("not (r = 1 and used is null)").drop("name", "used", "r")
        used = used.unionByName(won.select("space", "name"))
        if last or left.isEmpty():
            break
    return named.select(F.col("key").alias(key), F.col("digest").alias(digest), "name", "tied")
