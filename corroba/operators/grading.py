"""Grades of results against the truth: exactness, precision and recall by stage, lift and coverage, packs, ratchets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.round(a / F.greatest(b, F.lit(1)), 3).cast("double")


def exactness(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(attribute, labelled, exact, wrong, ungradable, ok): labels of class S against the truth; fewer than one in 20 may be without one, and none wrong. labels: item, attribute, class, value; truth: item, attribute, original."""
    rows = labels.where("class = 'S'").join(truth, ["item", "attribute"], "left")
    out = rows.groupBy("attribute").agg(F.count("*").alias("labelled"), F.count_if(F.col("value") == F.col("original")).alias("exact"), F.count_if(F.col("value") != F.col("original")).alias("wrong"), F.count_if(F.col("original").isNull()).alias("ungradable"))
    return out.withColumn("ok", F.expr("wrong = 0 and ungradable * 20 < labelled"))


def confirmed(labels: DataFrame, second: DataFrame) -> DataFrame:
    """Labels that an independent second truth (item, attribute, original) has too."""
    return labels.join(second.select("item", "attribute", F.col("original").alias("value")), ["item", "attribute", "value"], "left_semi")


def by_stage(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """(via, matches, right, precision, recall), and a row with a null stage for all. matches: app, key, via; truth: app, original."""
    total = truth.agg(F.count("*")).scalar()
    rows = matches.join(truth, "app", "left").withColumn("hit", (F.col("key") == F.col("original")).cast("int"))
    out = rows.groupingSets([["via"], []], "via").agg(F.count("*").alias("matches"), F.coalesce(F.sum("hit"), F.lit(0)).alias("right"))
    return out.select("via", "matches", "right", _share(F.col("right"), F.col("matches")).alias("precision"), _share(F.col("right"), total).alias("recall"))


def lift(hints: DataFrame, base: DataFrame) -> DataFrame:
    """(kind, version, hints, precision, base_rate, lift): overall (null version) and by version. hints: kind, version, hit; base: version, hits, total."""
    rows = hints.groupingSets([["kind"], ["kind", "version"]], "kind", "version").agg(F.count("*").alias("hints"), F.count_if("hit").alias("tp"))
    out = rows.join(F.broadcast(base), "version", "left").withColumn("rate", F.col("hits") / F.greatest("total", F.lit(1)))  # a row a version
    precision = F.col("tp") / F.col("hints")
    return out.select("kind", "version", "hints", F.round(precision, 3).cast("double").alias("precision"), F.round("rate", 3).cast("double").alias("base_rate"), F.round(precision / F.greatest("rate", F.lit(1e-9)), 3).cast("double").alias("lift"))


def coverage(occurrences: DataFrame, hints: DataFrame, keys: list[str], low: str, high: str, at: str, reach: int = 2) -> DataFrame:
    """(touched, occurrences, recall): occurrences that a hint of their keys lies in, or up to ``reach`` before."""
    touched = occurrences.join(hints, keys).where((F.col(low) <= F.col(at) + reach) & (F.col(at) <= F.col(high))).select(occurrences.columns).distinct()
    n, total = touched.agg(F.count("*")).scalar(), F.count("*")
    return occurrences.distinct().agg(total.alias("occurrences")).select(n.alias("touched"), "occurrences", _share(n, F.col("occurrences")).alias("recall"))


def pack_grade(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(records, same_key, same_frames, bridged, wrong): records of a pack against the truth; a key that differs by a bridge of the same name counts as right. found, truth: body, key, frames."""
    t = truth.select("body", F.col("key").alias("true_key"), F.col("frames").alias("true_frames"))
    rows = found.join(t, "body", "left")
    bridge = F.regexp_replace("key", r"\$default$", "") == F.regexp_replace("true_key", r"\$default$", "")
    same = F.col("key") == F.col("true_key")
    return rows.agg(F.count("*").alias("records"), F.count_if(same).alias("same_key"), F.count_if(same & F.col("frames").eqNullSafe(F.col("true_frames"))).alias("same_frames"), F.count_if(~same & bridge).alias("bridged"), F.count_if(F.coalesce(~same & ~bridge, F.lit(True))).alias("wrong"))
