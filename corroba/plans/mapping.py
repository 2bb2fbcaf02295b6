"""Queries of mapping text: lines made from the tables are parsed again, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroba.plans.queries import query, t
from corroba.sources import mapping

# A class an order, a method a line of it, two frames where the quantity is over 25, a residual signature after the first.
_LINE = "l_orderkey * 100 + l_linenumber * 10"


def _lines(spark, d):
    """(file, line, text): the mapping of all orders, a file for each priority."""
    orders = t(spark, d, "orders").selectExpr("o_orderpriority file", "o_orderkey k")
    first = orders.select("file").distinct().selectExpr("file", "explode(array(-4L, -3L, -2L, -1L)) line").withColumn("text", F.expr("case line when -4 then '# compiler: made' when -3 then concat('# priority:  ', file) when -2 then '# {\"id\":\"com.android.tools.r8.mapping\",\"version\":\"2.2\"}' else '# compiler: again' end"))
    classes = orders.selectExpr("file", "k * 100 line", "concat('com.app', k % 7, '.Order', k, ' -> a.b', k, ':') text").union(orders.selectExpr("file", "k * 100 + 1 line", "concat('# {id: ''sourceFile'', fileName: ''Order', k, '.java''}') text"))
    items = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q")).join(orders, F.col("k") == F.col("l_orderkey"))
    outer = items.selectExpr("file", f"{_LINE} + 5 line", "concat('    ', p, ':', p + 9, ':int Helper.run', l_linenumber, '(java.lang.String,Item', p % 5, '):', p + 100, ':', p + 109, ' -> m', l_linenumber) text")
    inner = items.where("q > 25").selectExpr("file", f"{_LINE} + 4 line", "concat('    ', p, ':', p + 9, ':void inlined():', p % 50, ' -> m', l_linenumber) text")
    residual = items.where("l_linenumber = 1").selectExpr("file", f"{_LINE} + 6 line", "concat('      # {\"id\":\"com.android.tools.r8.residualsignature\",\"signature\":\"(I)', p, '\"}') text")
    field = items.where("p % 3 = 0").selectExpr("file", f"{_LINE} + 7 line", "concat('    long total', l_linenumber, ' -> f', l_linenumber) text")
    return first.union(classes).union(outer).union(inner).union(residual).union(field)


_ITEMS = f"i AS (SELECT o_orderpriority AS file, l_orderkey AS k, l_linenumber AS n, {_LINE} AS line, min(l_partkey) AS p, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"""
WITH {_ITEMS} SELECT file, k * 100 AS class_line, line + 5 AS line, 'm' || n AS obfuscated, 'run' || n AS original, 'Helper' AS owner, 'java.lang.String,Item' || (p % 5) AS params, p AS minified_from, p + 9 AS minified_to, p + 100 AS orig_from, p + 109 AS orig_to FROM i
UNION ALL SELECT file, k * 100, line + 4, 'm' || n, 'inlined', NULL, '', p, p + 9, p % 50, NULL FROM i WHERE q > 25
""")
def mapping_methods(spark, d):
    m = mapping.strict(mapping.read_mapping(_lines(spark, d))).where("kind = 'method'")
    return m.select("file", "class_line", "line", "obfuscated", "original", "owner", F.array_join("params", ",").alias("params"), "minified_from", "minified_to", "orig_from", "orig_to")


@query("SELECT DISTINCT o_orderpriority AS file, unnest(['compiler', 'priority']) AS key, unnest(['made', o_orderpriority]) AS value FROM orders")
def mapping_header(spark, d):
    return mapping.header(mapping.read_mapping(_lines(spark, d)))


@query(f"""
WITH {_ITEMS} SELECT file, 'sourceFile' AS metadata, count(*) AS n, min('Order' || k || '.java') AS least FROM (SELECT DISTINCT o_orderpriority AS file, o_orderkey AS k FROM orders) GROUP BY file
UNION ALL SELECT file, 'com.android.tools.r8.residualsignature', count(*), NULL FROM i WHERE n = 1 GROUP BY file
UNION ALL SELECT DISTINCT o_orderpriority, 'com.android.tools.r8.mapping', 1, NULL FROM orders
""")
def mapping_metadata(spark, d):
    """Strict JSON, and JSON with bare keys and single quotes."""
    m = mapping.read_mapping(_lines(spark, d)).where("metadata is not null")
    return m.groupBy("file", "metadata").agg(F.count("*").alias("n"), F.min(F.get_json_object("payload", "$.fileName")).alias("least"))


@query(f"""
WITH {_ITEMS}, m AS (SELECT file, k, line + 5 AS line, 'com.app' || (k % 7) || '.Helper' AS owner, 'java.lang.String,com.app' || (k % 7) || '.Item' || (p % 5) AS params, n, p FROM i)
SELECT file, line, owner, params, CASE WHEN n = 1 THEN '(I)' || p END AS residual FROM m
""")
def mapping_normalised(spark, d):
    m = mapping.normalise(mapping.read_mapping(_lines(spark, d))).where("original like 'run%'")
    return m.select("file", "line", "owner", F.array_join("params", ",").alias("params"), "residual")


@query(f"""
WITH {_ITEMS} SELECT file, 'a.b' || k AS class, 'm' || n AS obfuscated, p + 3 AS residual, 0::INTEGER AS depth, 'com.app' || (k % 7) || '.Order' || k AS class_name, 'inlined' AS method, p % 50 AS original FROM i WHERE q > 25
UNION ALL SELECT file, 'a.b' || k, 'm' || n, p + 3, (q > 25)::INTEGER, 'Helper', 'run' || n, p + 103 FROM i
""")
def mapping_frames(spark, d):
    """The inline stack at the fourth residual line of every method."""
    m = mapping.read_mapping(_lines(spark, d))
    outer = m.where("original like 'run%'").select("file", "class_line", "obfuscated", (F.col("minified_from") + 3).alias("residual"))
    at = outer.join(m.where("kind = 'class'").select("file", F.col("line").alias("class_line"), F.col("obfuscated").alias("class")), ["file", "class_line"])
    return mapping.retrace(m, at.select("file", "class", "obfuscated", "residual")).select("file", "class", "obfuscated", "residual", F.col("depth").cast("int").alias("depth"), "class_name", "method", "original")


@query(f"WITH {_ITEMS} SELECT DISTINCT file, 'a.b' || k AS class, 'm' || n AS obfuscated, 'run' || n AS original FROM i")
def residual_names(spark, d):
    return mapping.residual_names(mapping.read_mapping(_lines(spark, d))).select("file", "class", "obfuscated", "original")


@query("SELECT 0::BIGINT AS lost, 0::BIGINT AS changed")
def mapping_round_trip(spark, d):
    """Lines that the printer does not give back as they were read; the lenient JSON is a comment and kept as written."""
    lines = _lines(spark, d)
    again = mapping.print_mapping(mapping.read_mapping(lines)).withColumnRenamed("text", "again")
    return lines.join(again, ["file", "line"], "left").agg(F.count_if(F.col("again").isNull()).alias("lost"), F.count_if(F.col("again") != F.col("text")).alias("changed"))


@query(f"""
WITH {_ITEMS}, r AS (SELECT k, string_agg('    ' || 'total' || n || ' -> f' || n, chr(10) ORDER BY n) AS body FROM i WHERE p % 3 = 0 GROUP BY k)
SELECT 'com.Order' || o_orderkey AS class, 'com.Order' || o_orderkey || ' -> a.b' || o_orderkey || ':' || coalesce(chr(10) || body, '') AS text FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN r ON k = o_orderkey
""")
def mapping_writer(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey").distinct().selectExpr("concat('com.Order', o_orderkey) original", "concat('a.b', o_orderkey) obfuscated")
    p = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).where("p % 3 = 0").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey")
    return mapping.renamed_lines(orders, p.selectExpr("concat('com.Order', l_orderkey) class", "l_linenumber rank", "concat('total', l_linenumber, ' -> f', l_linenumber) text"))
