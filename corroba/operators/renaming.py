"""References of a program: edges, resolution, renaming, hints and safety of new names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroba.operators.graphs import cut


def references(tables: list[tuple[DataFrame, str, Column]]) -> DataFrame:
    """(src, dst): what rows refer to, distinct and without self edges; each table with its owner column and an expression for the references, one or an array."""
    out = None
    for df, owner, to in tables:
        rows = df.select(F.col(owner).alias("src"), to.alias("dst"))
        if rows.schema["dst"].dataType.typeName() == "array":
            rows = rows.select("src", F.explode("dst").alias("dst"))
        out = rows if out is None else out.union(rows)
    return out.where("dst is not null and src <> dst").distinct()


def renamed(df: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Every given reference column with its new name; names: old, new (one row an old name). Spark broadcasts a table of names that is small."""
    for i, c in enumerate(columns):
        mine = names.select(F.col("old").alias(f"__old{i}"), F.col("new").alias(f"__new{i}"))
        df = df.join(mine, df[c] == F.col(f"__old{i}"), "left").withColumn(c, F.coalesce(F.col(f"__new{i}"), F.col(c))).drop(f"__old{i}", f"__new{i}")
    return df


def usage_fingerprints(uses: DataFrame, item: str, site: Column) -> DataFrame:
    """(item, usage): a hash of all sites that use it, repeats kept, in an order that no name decides."""
    return uses.groupBy(item).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(site)), "\u0001"), 256), 1, 16).alias("usage"))


def hint_choice(items: DataFrame, evidence: DataFrame, own: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(item, hint): from evidence, else the own name where it is none of the generator's, else the nearest stable ancestor's, else the kind. items: item, kind; evidence, own: item, hint; ancestors: item, hint, depth."""
    first = lambda df, *by: df.groupBy("item").agg(F.min_by("hint", F.struct(*by)).alias("hint"))
    a, b, c = first(evidence, "hint"), first(own, "hint"), first(ancestors, "depth", "hint")
    out = items.join(a.withColumnRenamed("hint", "a"), "item", "left").join(b.withColumnRenamed("hint", "b"), "item", "left").join(c.withColumnRenamed("hint", "c"), "item", "left")
    return out.select("item", F.coalesce("a", "b", "c", "kind").alias("hint"))


def safe_groups(members: DataFrame, platform_supers: DataFrame, platform_methods: DataFrame, longest: int = 6) -> DataFrame:
    """(grp): override groups that may be renamed: all library supertypes are known platform classes, the name is short and no platform method has it with that descriptor. members: grp, class, name, desc; platform_supers: class, library, known."""
    strange = members.join(platform_supers.where("not known"), "class", "left_semi").select("grp")
    long = members.where(F.length("name") > longest).select("grp")
    clash = members.join(platform_methods.select("name", "desc"), ["name", "desc"], "left_semi").select("grp")
    return members.select("grp").distinct().join(strange.union(long).union(clash).distinct(), "grp", "left_anti")


def apply_names(items: DataFrame, recovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, refused): recovered names that are unique in their space and no other item's final name. items: item, space, name; recovered: item, name."""
    want = recovered.select("item", F.col("name").alias("new")).join(items, "item")
    alone = Window.partitionBy("space", "new")
    want = want.withColumn("__n", F.count("*").over(alone))
    others = items.join(recovered.select("item"), "item", "left_anti").select("space", F.col("name").alias("new")).distinct().withColumn("__used", F.lit(True))
    judged = want.join(others, ["space", "new"], "left").withColumn("fine", (F.col("__n") == 1) & F.col("__used").isNull())
    final = items.join(judged.where("fine").select("item", "new"), "item", "left").select("item", "space", F.coalesce("new", "name").alias("name"))
    return final, judged.where("not fine").select("item", "space", "new")


def rewrite_rounds(state: DataFrame, rewrite: Callable[[DataFrame], tuple[DataFrame, DataFrame]], signature: list[Column], most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(state, records): the rewrite applied until the signature stays, at most ``most`` times; of records (rule, item, detail) the latest of each rule and item counts."""
    mark, records = None, None
    state = cut(state)
    for k in range(most):
        state, done = rewrite(state)
        state = cut(state)
        rows = cut(done.select("rule", "item", "detail").withColumn("round", F.lit(k)))
        records = rows if records is None else records.union(rows)
        now = tuple(state.agg(*signature).first())
        if now == mark:
            break
        mark = now
    latest = records.groupBy("rule", "item").agg(F.max_by("detail", "round").alias("detail"), F.max("round").alias("round"))
    return state, latest
