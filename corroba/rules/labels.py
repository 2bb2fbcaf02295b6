"""The rule registry, labels composed from rule applications, and the order of passes.

An application is a row (item, attribute, rule, seq, value, candidates); a label
is what all applications on one (item, attribute) make: the least class, N < D < S,
the one value, the rules in order of application, and the candidates of N rules.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of faithfulness, from the least; what the transformations are, in the order in which they are undone; what labels are about.
CLASSES = ["N", "D", "S"]
SOURCES = ["core", "r8", "desugar", "compose", "kotlinx_serialization", "parcelize", "kotlinc", "javac"]
ATTRIBUTES = ["Package", "ClassName", "MemberName", "Signature", "Body", "Lines", "SourceFile", "ParamNames"]
#: The rules by id, with their class and the attributes that they may label.
RULES = {
    "compose/lib-key": ("S", ["MemberName"]),
    "compose/lib-key-hint": ("D", ["MemberName"]),
    "compose/runtime-api": ("S", ["MemberName"]),
    "compose/singletons": ("D", ["MemberName"]),
    "compose/synthetic-params": ("D", ["ParamNames"]),
    "core/identity": ("D", ATTRIBUTES),
    "core/structural-name": ("D", ["ClassName", "MemberName"]),
    "core/structural-tie": ("N", ["ClassName", "MemberName"]),
    "kotlinc/data-class-name": ("S", ["ClassName"]),
    "kotlinc/data-class-property": ("S", ["MemberName"]),
    "kotlinc/data-class-property-hint": ("D", ["MemberName"]),
    "kotlinc/lateinit-field-name": ("S", ["MemberName"]),
    "r8/annotation-member-name": ("S", ["MemberName"]),
    "r8/bu-outline-inline": ("D", ["Body"]),
    "r8/enum-unboxing-utility": ("S", ["MemberName"]),
    "r8/kept-name": ("S", ["Package", "ClassName", "MemberName"]),
    "r8/libdb-class-name": ("S", ["Package", "ClassName"]),
    "r8/libdb-field-hint": ("D", ["MemberName"]),
    "r8/libdb-field-name": ("S", ["MemberName"]),
    "r8/libdb-method-name": ("S", ["MemberName"]),
    "r8/library-override-name": ("S", ["MemberName"]),
    "r8/outline-inline": ("D", ["Body"]),
    "r8/protobuf-message-name": ("S", ["ClassName"]),
    "r8/rebox-enum": ("D", ["Body"]),
    "r8/sigdb-method-name": ("D", ["MemberName"]),
    "r8/split-merged-class": ("D", ["Body"]),
}


def registry(spark: SparkSession) -> DataFrame:
    """(rule, class, rank, attributes), one row a rule."""
    return spark.createDataFrame([(r, c, CLASSES.index(c), a) for r, (c, a) in sorted(RULES.items())], "rule string, class string, rank int, attributes array<string>")


def labels(applications: DataFrame) -> DataFrame:
    """(item, attribute, class, value, rules, candidates). An unknown rule, an attribute that it does not declare, an N rule without candidates, another with some, and two values are errors."""
    known = F.broadcast(registry(applications.sparkSession))  # 26 rows
    rows = applications.join(known, "rule", "left")
    some = F.coalesce(F.size("candidates") > 0, F.lit(False))
    given = F.col("candidates").isNotNull()
    fault = (
        F.when(F.col("class").isNull(), "not in the registry")
        .when(~F.array_contains("attributes", F.col("attribute")), "does not declare the attribute")
        .when((F.col("class") == "N") & ~some, "an N rule has to give candidates")
        .when((F.col("class") != "N") & given, "only N rules give candidates")
    )
    fail = F.raise_error(F.concat(F.lit("rule "), "rule", F.lit(": "), fault)).cast("int")
    rows = rows.withColumn("rank", F.when(fault.isNotNull(), fail).otherwise(F.col("rank")))
    out = rows.groupBy("item", "attribute").agg(
        F.min("rank").alias("rank"), F.count_distinct("value").alias("__values"), F.min("value").alias("value"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "rule"))), lambda x: x["rule"]).alias("rules"),
        F.max_by("candidates", F.when(given, F.col("seq"))).alias("candidates"),
    )
    clash = F.raise_error(F.concat(F.lit("two values for "), F.col("item").cast("string"), F.lit(" "), "attribute")).cast("string")
    names = F.array(*map(F.lit, CLASSES))
    return out.select("item", "attribute", F.get(names, F.col("rank")).alias("class"), F.when(F.col("__values") > 1, clash).otherwise(F.col("value")).alias("value"), "rules", F.array_sort(F.array_distinct("candidates")).alias("candidates"))


def summary(items: DataFrame, found: DataFrame) -> DataFrame:
    """(attribute, S, D, N, untouched): all items count for each attribute."""
    attributes = items.sparkSession.createDataFrame([(a,) for a in ATTRIBUTES], "attribute string")
    counts = found.groupBy("attribute").pivot("class", CLASSES).agg(F.count(F.lit(1)))
    total = items.select("item").distinct().agg(F.count("*")).scalar()
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in "SDN"}
    return attributes.join(counts, "attribute", "left").select("attribute", *(zero[c].alias(c) for c in "SDN"), (total - zero["S"] - zero["D"] - zero["N"]).alias("untouched"))


def rule_usage(applications: DataFrame) -> DataFrame:
    """(rule, class, applications), zero for rules that were not applied."""
    used = applications.groupBy("rule").agg(F.count("*").alias("n"))
    return registry(applications.sparkSession).join(used, "rule", "left").select("rule", "class", F.coalesce("n", F.lit(0)).alias("applications"))


class Pass(NamedTuple):
    """A pass reads the tables and the labels so far and gives applications without ``seq``."""

    name: str
    source: str
    run: Callable[[dict[str, DataFrame], DataFrame | None], DataFrame]


def schedule(passes: list[Pass]) -> list[Pass]:
    """By source, in the order of undoing, then by name."""
    return sorted(passes, key=lambda p: (SOURCES.index(p.source), p.name))


def run_passes(passes: list[Pass], tables: dict[str, DataFrame]) -> DataFrame:
    """All applications, with the number of their pass as ``seq``."""
    out = None
    for seq, p in enumerate(schedule(passes)):
        rows = p.run(tables, labels(out) if out is not None else None)
        rows = rows.select("item", "attribute", "rule", F.lit(seq).alias("seq"), "value", "candidates")
        out = rows if out is None else out.unionByName(rows)
    return out


def findings(*tables: DataFrame) -> DataFrame:
    """(severity, message), distinct and in order."""
    out = tables[0].select("severity", "message")
    for df in tables[1:]:
        out = out.union(df.select("severity", "message"))
    return out.distinct().orderBy("severity", "message")


def applied(rows: DataFrame, item: str, attribute: str, rule: str, value: str | None = None) -> DataFrame:
    """Applications of one rule."""
    found = F.col(value) if value else F.lit(None).cast("string")
    return rows.select(F.col(item).alias("item"), F.lit(attribute).alias("attribute"), F.lit(rule).alias("rule"), found.alias("value"), F.lit(None).cast("array<string>").alias("candidates"))
