"""Queries of rules, labels, references, names and grades: proxies of a program made from the tables, with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroba.operators import grading, joins, renaming
from corroba.plans.queries import query, t
from corroba.rules import labels, passes

_RULE_VALUES = ", ".join(f"('{r}', '{c}', {labels.CLASSES.index(c)})" for r, (c, _) in sorted(labels.RULES.items()))
_NAMED = [r for r, (c, a) in sorted(labels.RULES.items()) if "MemberName" in a and c != "N"]
_NAMED_SQL = "[" + ", ".join(f"'{r}'" for r in _NAMED) + "]"


@query(f"SELECT * FROM (VALUES {_RULE_VALUES}) v(rule, class, rank)")
def rule_registry(spark, d):
    return labels.registry(spark).select("rule", "class", "rank")


def _applications(spark, d):
    """Lines apply rules to the name of their part; every 40th part is a structural tie."""
    line = t(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), (F.col("l_suppkey") % len(_NAMED)).cast("int").alias("k"), F.col("l_orderkey").alias("seq")).distinct()
    ruled = line.select(F.col("p").alias("item"), F.lit("MemberName").alias("attribute"), F.element_at(F.array(*map(F.lit, _NAMED)), F.col("k") + 1).alias("rule"), "seq", F.when(F.col("p") % 3 == 0, F.concat(F.lit("name"), "p")).alias("value"), F.lit(None).cast("array<string>").alias("candidates"))
    ties = t(spark, d, "part").where("p_partkey % 40 = 0").selectExpr("p_partkey item", "'MemberName' attribute", "'core/structural-tie' rule", "0L seq", "cast(null as string) value", "array(concat('b', p_size), 'a', concat('b', p_size)) candidates")
    return ruled.unionByName(ties)


_APPLIED = f"""r(rule, class, rank) AS (VALUES {_RULE_VALUES}), ap AS (SELECT DISTINCT l_partkey AS item, {_NAMED_SQL}[(l_suppkey % {len(_NAMED)})::INT + 1] AS rule, l_orderkey AS seq, CASE WHEN l_partkey % 3 = 0 THEN 'name' || l_partkey END AS value, NULL AS candidates FROM lineitem
UNION ALL SELECT p_partkey, 'core/structural-tie', 0, NULL, 'a,b' || p_size FROM part WHERE p_partkey % 40 = 0),
lb AS (SELECT item, ['N', 'D', 'S'][min(rank) + 1] AS class, min(value) AS value, string_agg(rule, ',' ORDER BY seq, rule) AS rules, max(candidates) AS candidates FROM ap JOIN r USING (rule) GROUP BY item)"""


@query(f"WITH {_APPLIED} SELECT * FROM lb")
def composed_labels(spark, d):
    """Labels: the least class, the one value, rules in order, candidates of ties."""
    return labels.labels(_applications(spark, d)).select("item", "class", "value", F.array_join("rules", ",").alias("rules"), F.array_join("candidates", ",").alias("candidates"))


@query(f"""
WITH {_APPLIED}, a AS (SELECT unnest(['Package', 'ClassName', 'MemberName', 'Signature', 'Body', 'Lines', 'SourceFile', 'ParamNames']) AS attribute), n AS (SELECT count(DISTINCT p_partkey) AS n FROM part)
SELECT attribute, CASE attribute WHEN 'MemberName' THEN (SELECT count(*) FROM lb WHERE class = 'S') ELSE 0 END AS S, CASE attribute WHEN 'MemberName' THEN (SELECT count(*) FROM lb WHERE class = 'D') ELSE 0 END AS D, CASE attribute WHEN 'MemberName' THEN (SELECT count(*) FROM lb WHERE class = 'N') ELSE 0 END AS N,
  (SELECT n FROM n) - CASE attribute WHEN 'MemberName' THEN (SELECT count(*) FROM lb) ELSE 0 END AS untouched FROM a
""")
def label_summary(spark, d):
    return labels.summary(t(spark, d, "part").select(F.col("p_partkey").alias("item")), labels.labels(_applications(spark, d)))


@query(f"WITH {_APPLIED} SELECT r.rule, r.class, count(ap.rule) AS applications FROM r LEFT JOIN ap USING (rule) GROUP BY ALL")
def rule_usage(spark, d):
    return labels.rule_usage(_applications(spark, d))


# A program: customers are classes (an annotation now and then), under one another; nations are library classes; orders are methods.


def _program(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    classes = c.selectExpr("concat('C', c_custkey) class", "if(c_custkey % 10 = 0, 8192, 0) access")
    supers = c.selectExpr("concat('C', c_custkey) class", "if(c_custkey >= 8, concat('C', c_custkey div 8), concat('L', c_nationkey)) super").union(c.where("c_custkey % 5 = 0").selectExpr("concat('C', c_custkey)", "concat('I', c_nationkey % 3)"))
    methods = o.selectExpr("o_orderkey item", "concat('C', o_custkey) class", "concat('m', o_orderkey % 12) name", "substring(o_orderpriority, 1, 1) proto", "case o_orderstatus when 'F' then 8 when 'P' then 2 else 1 end access")
    refs = t(spark, d, "lineitem").selectExpr("if(l_partkey % 4 = 0, concat('C', l_suppkey), if(l_partkey % 4 = 1, concat('I', l_suppkey % 3), concat('L', l_suppkey % 25))) owner", "concat('m', l_partkey % 12) name", "cast(l_quantity % 6 as int) proto").withColumn("proto", F.col("proto").cast("string")).distinct()
    return classes, supers, methods, refs


_PROGRAM = """cl AS (SELECT DISTINCT 'C' || c_custkey AS class, CASE WHEN c_custkey % 10 = 0 THEN 8192 ELSE 0 END AS access FROM customer),
su AS (SELECT 'C' || c_custkey AS class, CASE WHEN c_custkey >= 8 THEN 'C' || (c_custkey // 8) ELSE 'L' || c_nationkey END AS super FROM customer UNION SELECT 'C' || c_custkey, 'I' || (c_nationkey % 3) FROM customer WHERE c_custkey % 5 = 0),
me AS (SELECT o_orderkey AS item, 'C' || o_custkey AS class, 'm' || (o_orderkey % 12) AS name, substr(o_orderpriority, 1, 1) AS proto, CASE o_orderstatus WHEN 'F' THEN 8 WHEN 'P' THEN 2 ELSE 1 END AS access FROM orders),
re AS (SELECT DISTINCT CASE l_partkey % 4 WHEN 0 THEN 'C' || l_suppkey WHEN 1 THEN 'I' || (l_suppkey % 3) ELSE 'L' || (l_suppkey % 25) END AS owner, 'm' || (l_partkey % 12) AS name, (l_quantity % 6)::INT::VARCHAR AS proto FROM lineitem),
up AS (SELECT class, class AS via FROM cl UNION SELECT up.class, super FROM up JOIN su ON su.class = via WHERE super IN (SELECT class FROM cl))"""


@query(f"WITH RECURSIVE {_PROGRAM} SELECT item, 'r8/annotation-member-name' AS rule FROM me JOIN cl USING (class) WHERE cl.access = 8192")
def annotation_members(spark, d):
    classes, _, methods, _ = _program(spark, d)
    return passes.annotation_members(classes, methods).select("item", "rule")


@query(f"WITH RECURSIVE {_PROGRAM} SELECT DISTINCT up.class, super AS library FROM up JOIN su ON su.class = via WHERE super NOT IN (SELECT class FROM cl)")
def library_supers(spark, d):
    classes, supers, _, _ = _program(spark, d)
    return passes.library_supers(classes, supers)


@query(f"""
WITH RECURSIVE {_PROGRAM}, ls AS (SELECT DISTINCT up.class, super AS library FROM up JOIN su ON su.class = via WHERE super NOT IN (SELECT class FROM cl))
SELECT DISTINCT item FROM me JOIN ls USING (class) JOIN re ON re.owner = library AND re.name = me.name AND re.proto = me.proto WHERE access = 1
""")
def library_overrides(spark, d):
    return passes.library_overrides(*_program(spark, d)).select("item")


@query(f"""
WITH RECURSIVE {_PROGRAM}, above AS (SELECT DISTINCT class, via FROM up WHERE via <> class UNION SELECT DISTINCT up.class, super FROM up JOIN su ON su.class = via)
SELECT item, EXISTS (SELECT 1 FROM above a JOIN me o ON o.class = a.via WHERE a.class = me.class AND o.name = me.name AND o.proto = me.proto) AS declared FROM me
""")
def declared_above(spark, d):
    _, supers, methods, _ = _program(spark, d)
    return passes.declared_above(methods, supers)


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS o, 'f_' || l_linenumber || 'x' || (l_orderkey // 4) AS name, l_linenumber AS number FROM lineitem),
m AS (SELECT o, list_sort(list(upper(name) || '=' || number)) AS k, count(*) AS n, CASE WHEN o % 3 = 0 THEN 'Message' || (o // 8) || 'q' ELSE 'Order' || o || 'q' END AS name FROM f WHERE o % 2 = 0 GROUP BY o),
b AS (SELECT k, count(*) AS messages, min(name) AS found FROM m GROUP BY k HAVING count(DISTINCT name) = 1),
c AS (SELECT o, list_sort(list(upper(name) || '=' || number)) AS k FROM f WHERE o % 3 < 2 GROUP BY o)
SELECT o AS class, found, messages = 1 AND len(k) >= 3 AND count(*) OVER (PARTITION BY o % 10, found) = 1 AS proven FROM c JOIN b USING (k)
""")
def message_names(spark, d):
    """Definitions from even orders, classes from others: sets of field numbers that one message name has."""
    f = t(spark, d, "lineitem").selectExpr("l_orderkey o", "concat('f_', l_linenumber, 'x', l_orderkey div 4) name", "cast(l_linenumber as bigint) number").distinct()
    m = f.where("o % 2 = 0").groupBy("o").agg(F.collect_list(F.struct("name", "number")).alias("fields"))
    m = m.selectExpr("concat('p.', o) full_name", "if(o % 3 = 0, concat('Message', o div 8, 'q'), concat('Order', o, 'q')) name", "fields")
    constants = f.where("o % 3 < 2").select(F.col("o").alias("class"), (F.col("o") % 10).cast("string").alias("package"), F.concat(F.lit("a"), "o").alias("simple"), F.upper("name").alias("stem"), "number")
    sure, hints = passes.message_names(m, constants, constants.select("package", "simple").distinct(), 4)
    return sure.select(F.col("item").alias("class"), F.col("value").alias("found"), F.lit(True).alias("proven")).union(hints.select("class", "name", F.lit(False)))


@query("""
WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), k AS (SELECT o, count(*) AS n, max(p % 50 = 0) AS bad, count(DISTINCT p) AS kinds FROM i GROUP BY o)
SELECT o AS method, 'Order' || (o % 7) AS name, string_agg('p' || n || ':' || p, ',' ORDER BY n) AS props FROM i WHERE o IN (SELECT o FROM k WHERE NOT bad AND kinds = n) GROUP BY o
""")
def data_class_templates(spark, d):
    """Pieces of ``Order3(p1=`` field ``, p2=`` field ``)``; a piece that is no field spoils the template, as does a field twice."""
    from pyspark.sql import Window

    i = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    first = F.row_number().over(Window.partitionBy("o").orderBy("n")) == 1
    lits = i.select("o", (F.col("n") * 2).alias("pos"), F.when(first, F.concat(F.lit("Order"), F.col("o") % 7, F.lit("(p"), "n", F.lit("="))).otherwise(F.concat(F.lit(", p"), "n", F.lit("="))).alias("literal"), F.lit(None).cast("string").alias("field"))
    fields = i.select("o", F.col("n") * 2 + 1, F.when(F.col("p") % 50 == 0, "text"), F.when(F.col("p") % 50 != 0, F.col("p").cast("string")))
    ends = i.select("o").distinct().select("o", F.lit(1000), F.lit(")"), F.lit(None).cast("string"))
    found = passes.data_class_template(lits.union(fields).union(ends).withColumnRenamed("o", "method"))
    return found.select("method", "name", F.array_join(F.transform("props", lambda x: F.concat(x["property"], F.lit(":"), x["field"])), ",").alias("props"))


_EV = """SELECT user_id AS method, event_id AS idx, CASE event_type WHEN 'click' THEN 'invoke-virtual' WHEN 'view' THEN 'move-result' WHEN 'purchase' THEN 'instance-of' ELSE 'iget' END AS op, event_id % 3 AS r, user_id % 2 = 0 AS is_param, event_id % 4 AS v, ts FROM events"""


@query(f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ts, idx) AS k FROM ({_EV})),
f AS (SELECT *, op = 'invoke-virtual' AND v < 2 AS getter, op = 'invoke-virtual' AND v = 2 AS equals, op = 'invoke-virtual' AND v = 3 AS sizes FROM e),
g AS (SELECT *, lead(op) OVER w = 'move-result' AS used, coalesce(bool_and(getter AND is_param) OVER (PARTITION BY method ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS pro,
  list(CASE WHEN op IN ('iget', 'invoke-virtual') THEN r END) OVER (PARTITION BY method ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS later, count(*) FILTER (sizes) OVER (PARTITION BY method ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS sized FROM f WINDOW w AS (PARTITION BY method ORDER BY k)),
h AS (SELECT method, k::INTEGER AS idx, unnest([CASE WHEN getter AND NOT coalesce(used, false) AND is_param AND pro THEN 'param-null-check' END, CASE WHEN getter AND NOT coalesce(used, false) AND NOT (is_param AND pro) THEN 'discarded-getclass' END,
  CASE WHEN getter AND NOT coalesce(used, false) AND NOT (is_param AND pro) AND list_contains(later, r) THEN 'inlined-instance-call' END, CASE WHEN equals THEN 'idiom:areEqual' END, CASE WHEN op = 'instance-of' AND sized > 0 THEN 'idiom:collectionSizeOrDefault' END]) AS kind FROM g)
SELECT * FROM h WHERE kind IS NOT NULL
""")
def inlining_hints(spark, d):
    """The five kinds of hints over events as instructions."""
    from pyspark.sql import Window

    e = t(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    v = F.col("event_id") % 4
    op = F.when(F.col("event_type") == "click", "invoke-virtual").when(F.col("event_type") == "view", "move-result").when(F.col("event_type") == "purchase", "instance-of").otherwise("iget")
    insns = e.select(F.col("user_id").alias("method"), F.col("k").alias("idx"), op.alias("op"), F.when(v < 2, "getClass").when(v == 2, "equals").otherwise("size").alias("name"), F.when(v < 2, "()Ljava/lang/Class;").when(v == 2, "(Ljava/lang/Object;)Z").otherwise("()I").alias("proto"), F.when(op == "instance-of", "Ljava/util/Collection;").otherwise("Ljava/lang/Object;").alias("owner"), (F.col("event_id") % 3).alias("obj"), F.when(v == 2, 2).otherwise(1).alias("args"), (F.col("user_id") % 2 == 0).alias("is_param"))
    return passes.inlining_hints(insns)


@query("""
WITH s AS (SELECT s_nationkey AS build, 'k' || (s_suppkey % 20) AS key, max(s_suppkey)::VARCHAR AS value FROM supplier GROUP BY ALL), j AS (SELECT build, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS json FROM s GROUP BY build)
SELECT build, json, substr(sha256(json), 1, 16) AS key FROM j
""")
def build_profiles(spark, d):
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("build"), F.concat(F.lit("k"), F.col("s_suppkey") % 20).alias("key")).agg(F.max("s_suppkey").cast("string").alias("value"))
    return passes.profile_key(s, "build", "key", "value")


@query("SELECT severity, message FROM (SELECT 'info' AS severity, 'user ' || user_id || ' did ' || event_type AS message FROM events UNION SELECT 'warn', 'no value of ' || event_type FROM events WHERE value IS NULL OR value < 1)")
def all_findings(spark, d):
    e = t(spark, d, "events")
    return labels.findings(e.selectExpr("'info' severity", "concat('user ', user_id, ' did ', event_type) message"), e.where("value is null or value < 1").selectExpr("'warn' severity", "concat('no value of ', event_type) message"))


# References and names


@query("""
SELECT DISTINCT src, dst FROM (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'p' || p_partkey, unnest(['p' || (p_partkey // 2), 'p' || (p_partkey // 3)]) FROM part) WHERE src <> dst
""")
def reference_edges(spark, d):
    line, orders, part = (t(spark, d, n) for n in ("lineitem", "orders", "part"))
    return renaming.references([
        (line.selectExpr("concat('o', l_orderkey) o", "concat('p', l_partkey) p"), "o", F.col("p")), (orders.selectExpr("concat('o', o_orderkey) o", "concat('c', o_custkey) c"), "o", F.col("c")),
        (part.selectExpr("concat('p', p_partkey) p", "array(concat('p', p_partkey div 2), concat('p', p_partkey div 3)) up"), "p", F.col("up")),
    ])


@query("""
WITH n AS (SELECT p_partkey AS old, p_partkey + 5000000 AS new FROM part WHERE p_size > 25)
SELECT l_orderkey, l_linenumber, coalesce(a.new, l_partkey) AS l_partkey, coalesce(b.new, l_suppkey) AS l_suppkey, count(*) AS n FROM lineitem LEFT JOIN n a ON a.old = l_partkey LEFT JOIN n b ON b.old = l_suppkey GROUP BY ALL
""")
def renamed_references(spark, d):
    n = t(spark, d, "part").where("p_size > 25").selectExpr("p_partkey old", "p_partkey + 5000000 new")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return renaming.renamed(rows, ["l_partkey", "l_suppkey"], n).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS part, substr(sha256(string_agg(l_returnflag || l_linestatus || l_linenumber, chr(1) ORDER BY l_returnflag || l_linestatus || l_linenumber)), 1, 16) AS usage FROM lineitem GROUP BY 1")
def usage_fingerprints(spark, d):
    site = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return renaming.usage_fingerprints(t(spark, d, "lineitem").withColumnRenamed("l_partkey", "part"), "part", site)


@query("""
SELECT c_custkey AS item, coalesce((SELECT min('n' || o_orderstatus) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0), CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) END, CASE WHEN c_custkey >= 40 THEN CASE WHEN c_custkey // 5 % 2 = 0 THEN 'up' || (c_custkey // 5) WHEN c_custkey // 10 % 2 = 0 THEN 'up' || (c_custkey // 10) END END, 'cls') AS hint FROM customer
""")
def name_hints(spark, d):
    """Evidence, own name, nearest stable ancestor, kind."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    evidence = o.where("o_orderkey % 9 = 0").selectExpr("o_custkey item", "concat('n', o_orderstatus) hint")
    own = c.where("c_custkey % 4 = 0").selectExpr("c_custkey item", "lower(c_mktsegment) hint")
    up = c.where("c_custkey >= 40").selectExpr("c_custkey item", "explode(array(struct(c_custkey div 5 a, 1 depth), struct(c_custkey div 10 a, 2 depth))) u").where("u.a % 2 = 0").selectExpr("item", "concat('up', u.a) hint", "u.depth depth")
    return renaming.hint_choice(c.selectExpr("c_custkey item", "'cls' kind"), evidence, own, up)


@query("""
WITH m AS (SELECT o_orderkey % 500 AS grp, 'C' || o_custkey AS class, substr(lower(o_orderpriority), 3, 2 + (o_orderkey % 500 % 7)::INT) AS name, substr(o_orderstatus, 1, 1) AS d FROM orders),
s AS (SELECT 'C' || c_custkey AS class FROM customer WHERE c_custkey % 200 = 0), p AS (SELECT 'hi' AS name, 'F' AS d UNION ALL SELECT 'low', 'O')
SELECT DISTINCT grp FROM m WHERE grp NOT IN (SELECT grp FROM m WHERE class IN (SELECT class FROM s) OR length(name) > 6 OR (name, d) IN (SELECT (name, d) FROM p))
""")
def safe_groups(spark, d):
    m = t(spark, d, "orders").selectExpr("o_orderkey % 500 grp", "concat('C', o_custkey) class", "substring(lower(o_orderpriority), 3, cast(2 + o_orderkey % 500 % 7 as int)) name", "substring(o_orderstatus, 1, 1) desc")
    supers = t(spark, d, "customer").selectExpr("concat('C', c_custkey) class", "'L' library", "c_custkey % 200 <> 0 known")
    return renaming.safe_groups(m, supers, spark.createDataFrame([("hi", "F"), ("low", "O")], "name string, desc string"))


_RECOVER = "r AS (SELECT p_partkey AS item, 'x' || (p_partkey % 300) AS new FROM part WHERE p_partkey % 3 = 0), i AS (SELECT p_partkey AS item, p_size % 5 AS space, 'x' || (p_partkey % 700) AS name FROM part), j AS (SELECT r.item, i.space, r.new, count(*) OVER (PARTITION BY space, new) = 1 AND (space, new) NOT IN (SELECT (space, name) FROM i WHERE item NOT IN (SELECT item FROM r)) AS fine FROM r JOIN i USING (item))"


@query(f"WITH {_RECOVER} SELECT i.item, i.space, coalesce(j.new, i.name) AS name FROM i LEFT JOIN j ON j.item = i.item AND j.fine")
def recovered_names(spark, d):
    """Names that are unique in their space are applied, others refused."""
    p = t(spark, d, "part")
    return renaming.apply_names(p.selectExpr("p_partkey item", "p_size % 5 space", "concat('x', p_partkey % 700) name"), p.where("p_partkey % 3 = 0").selectExpr("p_partkey item", "concat('x', p_partkey % 300) name"))[0]


# Joins


@query("""
WITH p AS (SELECT c_custkey AS start, c_custkey AS owner, 0 AS rank FROM customer UNION ALL SELECT c_custkey, c_custkey // 2, 1 FROM customer UNION ALL SELECT c_custkey, c_custkey // 4, 2 FROM customer), tb AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS member FROM orders)
SELECT start, member, owner FROM (SELECT i.c_custkey AS start, m.member, p.owner, row_number() OVER (PARTITION BY i.c_custkey, m.member ORDER BY rank, p.owner) AS r FROM customer i JOIN (SELECT DISTINCT o_orderpriority AS member FROM orders) m ON true JOIN p ON p.start = i.c_custkey JOIN tb ON tb.owner = p.owner AND tb.member = m.member) WHERE r = 1
""")
def member_resolution(spark, d):
    """Each priority of a customer: the first of its path (itself, its half, its quarter) that has such an order."""
    c = t(spark, d, "customer")
    table = t(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("member")).distinct()
    kinds = table.agg(F.array_sort(F.collect_set("member")).alias("all"))
    items = c.select(F.col("c_custkey").alias("start"), F.explode(kinds.scalar()).alias("member")).withColumn("item", F.struct("start", "member"))
    path = c.selectExpr("c_custkey start", "explode(array(struct(c_custkey owner, 0 rank), struct(c_custkey div 2 owner, 1 rank), struct(c_custkey div 4 owner, 2 rank))) x").select("start", "x.*")
    return joins.first_along(items, path, table, "item", "owner", "rank").select("start", "member", "owner")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.l_linenumber AS low FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL) r ON l.l_orderkey = r.l_orderkey AND r.l_linenumber <= l.l_linenumber AND l.l_linenumber < r.l_linenumber + floor(q / 12)
""")
def interval_stab(spark, d):
    """Lines and the ranges of their order that cover them; a range is as long as its quantity has dozens."""
    line = t(spark, d, "lineitem")
    ranges = line.groupBy("l_orderkey", F.col("l_linenumber").alias("low")).agg(F.min("l_quantity").alias("q")).select("l_orderkey", "low", (F.col("low") + F.floor(F.col("q") / 12)).cast("int").alias("high"))
    return joins.interval_stab(line.select("l_orderkey", "l_linenumber", "l_partkey"), "l_linenumber", ranges, "low", "high", ["l_orderkey"], 4).select("l_orderkey", "l_linenumber", "l_partkey", "low")


@query("SELECT s_nationkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)")
def suppressed_union(spark, d):
    """Own rows, and embedded ones whose key they do not cover."""
    own, other = t(spark, d, "supplier").selectExpr("s_nationkey key", "s_name name"), t(spark, d, "customer").selectExpr("c_nationkey key", "c_name name")
    return joins.suppressed_union(own, other, "key")


@query("""
SELECT s_suppkey, c_custkey FROM supplier JOIN (SELECT c_nationkey AS k, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) = 1) ON k = s_nationkey
""")
def first_match(spark, d):
    """Each supplier with the first customer of its nation in a total order."""
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment", "c_custkey")
    return joins.first_per_key(t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), c, ["k"], ["c_mktsegment", "c_custkey"]).select("s_suppkey", "c_custkey")


@query("SELECT a.l_orderkey, a.l_linenumber AS one, b.l_linenumber AS two FROM (SELECT l_orderkey, l_linenumber, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY ALL) a JOIN (SELECT l_orderkey, l_linenumber, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE NOT list_has_any(a.f, b.f)")
def disjoint_pairs(spark, d):
    """Lines of one order whose sets of flags have nothing in common."""
    sets = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_set("l_returnflag").alias("f"))
    pairs = joins.pairs_within(sets, ["l_orderkey"], "l_linenumber", ["f"])
    return pairs.where(~F.arrays_overlap("f1", "f2")).select("l_orderkey", F.col("l_linenumber1").alias("one"), F.col("l_linenumber2").alias("two"))


# Grades


@query("""
WITH l AS (SELECT doc_id AS item, lang AS attribute, CASE WHEN doc_id % 50 = 1 THEN 'D' ELSE 'S' END AS class, 'q' || (doc_id % 2) AS value FROM documents WHERE lang IS NOT NULL), tr AS (SELECT doc_id AS item, max('q' || (doc_id % 2)) AS original FROM labels GROUP BY 1)
SELECT attribute, count(*) AS labelled, count(*) FILTER (value = original) AS exact, count(*) FILTER (value <> original) AS wrong, count(*) FILTER (original IS NULL) AS ungradable, count(*) FILTER (value <> original) = 0 AND count(*) FILTER (original IS NULL) * 20 < count(*) AS ok FROM l LEFT JOIN tr USING (item) WHERE class = 'S' GROUP BY attribute
""")
def label_exactness(spark, d):
    docs = t(spark, d, "documents").where("lang is not null")
    found = docs.selectExpr("doc_id item", "lang attribute", "if(doc_id % 50 = 1, 'D', 'S') class", "concat('q', doc_id % 2) value")
    truth = t(spark, d, "labels").select("doc_id").distinct().join(docs.select("doc_id", "lang").distinct(), "doc_id").selectExpr("doc_id item", "lang attribute", "concat('q', doc_id % 2) original")
    return grading.exactness(found, truth)


@query("""
WITH m AS (SELECT o_orderkey AS app, o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS key, o_orderpriority AS via FROM orders WHERE o_orderkey % 5 > 0), tr AS (SELECT o_orderkey AS app, o_orderkey AS original FROM orders)
SELECT via, count(*) AS matches, coalesce(sum((key = original)::INT), 0)::BIGINT AS "right", round(coalesce(sum((key = original)::INT), 0) / count(*), 3) AS precision, round(coalesce(sum((key = original)::INT), 0) / (SELECT count(*) FROM tr), 3) AS recall FROM m LEFT JOIN tr USING (app) GROUP BY GROUPING SETS ((via), ())
""")
def stage_grades(spark, d):
    o = t(spark, d, "orders")
    m = o.where("o_orderkey % 5 > 0").selectExpr("o_orderkey app", "o_orderkey + if(o_orderkey % 7 = 0, 1, 0) key", "o_orderpriority via")
    return grading.by_stage(m, o.selectExpr("o_orderkey app", "o_orderkey original"))


@query("""
WITH h AS (SELECT event_type AS kind, (user_id % 2)::VARCHAR AS version, value > 40 AS hit FROM events), b AS (SELECT (o_custkey % 2)::VARCHAR AS version, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS total FROM orders GROUP BY 1),
g AS (SELECT kind, version, count(*) AS hints, count(*) FILTER (hit) AS tp FROM h GROUP BY GROUPING SETS ((kind), (kind, version)))
SELECT kind, g.version, hints, round(tp / hints, 3) AS precision, round(hits / total, 3) AS base_rate, round((tp / hints) / greatest(hits / total, 1e-9), 3) AS lift FROM g LEFT JOIN b ON g.version = b.version
""")
def hint_lift(spark, d):
    h = t(spark, d, "events").selectExpr("event_type kind", "cast(user_id % 2 as string) version", "value > 40 hit")
    b = t(spark, d, "orders").groupBy((F.col("o_custkey") % 2).cast("string").alias("version")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("total"))
    return grading.lift(h, b)


@query("""
WITH oc AS (SELECT DISTINCT l_orderkey, l_linenumber AS low, l_linenumber + 1 AS high FROM lineitem), h AS (SELECT DISTINCT l_orderkey, l_linenumber AS pos FROM lineitem WHERE l_partkey % 5 = 0),
x AS (SELECT DISTINCT oc.* FROM oc JOIN h ON oc.l_orderkey = h.l_orderkey AND low <= pos + 2 AND pos <= high)
SELECT (SELECT count(*) FROM x) AS touched, (SELECT count(*) FROM oc) AS occurrences, round((SELECT count(*) FROM x) / (SELECT count(*) FROM oc), 3) AS recall
""")
def hint_coverage(spark, d):
    line = t(spark, d, "lineitem")
    oc = line.selectExpr("l_orderkey", "l_linenumber low", "l_linenumber + 1 high").distinct()
    return grading.coverage(oc, line.where("l_partkey % 5 = 0").selectExpr("l_orderkey", "l_linenumber pos").distinct(), ["l_orderkey"], "low", "high", "pos")


@query("""
WITH f AS (SELECT o_orderkey AS body, 'm' || (o_orderkey % 9) || CASE WHEN o_orderkey % 4 = 0 THEN '$default' ELSE '' END AS key, o_orderstatus AS frames FROM orders), tr AS (SELECT o_orderkey AS body, 'm' || ((o_orderkey + CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END) % 9) AS key, substr(o_orderpriority, 1, 1) AS frames FROM orders WHERE o_orderkey % 12 > 0)
SELECT count(*) AS records, count(*) FILTER (f.key = tr.key) AS same_key, count(*) FILTER (f.key = tr.key AND f.frames = tr.frames) AS same_frames, count(*) FILTER (f.key <> tr.key AND replace(f.key, '$default', '') = tr.key) AS bridged, count(*) FILTER (coalesce(f.key <> tr.key AND replace(f.key, '$default', '') <> tr.key, true)) AS wrong FROM f LEFT JOIN tr USING (body)
""")
def pack_grades(spark, d):
    o = t(spark, d, "orders")
    f = o.selectExpr("o_orderkey body", "concat('m', o_orderkey % 9, if(o_orderkey % 4 = 0, '$default', '')) key", "o_orderstatus frames")
    return grading.pack_grade(f, o.where("o_orderkey % 12 > 0").selectExpr("o_orderkey body", "concat('m', (o_orderkey + if(o_orderkey % 10 = 3, 1, 0)) % 9) key", "substring(o_orderpriority, 1, 1) frames"))


@query("SELECT l.item, l.value FROM (SELECT doc_id AS item, 'q' || (doc_id % 3) AS value FROM documents) l SEMI JOIN (SELECT doc_id AS item, 'q' || quality AS value FROM labels) s ON l.item = s.item AND l.value = s.value")
def confirmed_labels(spark, d):
    found = t(spark, d, "documents").selectExpr("doc_id item", "'Body' attribute", "concat('q', doc_id % 3) value")
    return grading.confirmed(found, t(spark, d, "labels").selectExpr("doc_id item", "'Body' attribute", "concat('q', quality) original")).select("item", "value")
