"""Queries of control flow and dataflow: every order is a body, its lines are instructions over four registers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corroba.flow import tables
from corroba.plans.queries import query, t


def _insns(spark, d):
    items = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("method"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    w = Window.partitionBy("method")
    x = items.withColumn("idx", F.row_number().over(w.orderBy("n")) - 1).withColumn("len", F.count("*").over(w))
    return x.selectExpr(
        "method", "idx", "element_at(array('const', 'move', 'add', 'if', 'goto', 'const'), cast(p % 6 + 1 as int)) op", "if(p % 6 in (3, 4), null, cast(s % 4 as int)) dst",
        "case when p % 6 in (1, 3) then array(cast(p div 6 % 4 as int)) when p % 6 = 2 then array(cast(p div 6 % 4 as int), cast((s + 1) % 4 as int)) else cast(array() as array<int>) end args",
        "if(p % 6 in (3, 4), array(cast(s % len as int)), cast(array() as array<int>)) targets", "p % 6 <> 4 falls", "cast(array() as array<int>) handlers", "if(p % 6 in (0, 5), s % 3, null) lit",
    )


_BODY = """x AS (SELECT l_orderkey AS method, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
b AS (SELECT method, (row_number() OVER (PARTITION BY method ORDER BY n) - 1)::INTEGER AS idx, count(*) OVER (PARTITION BY method) AS len, p, s FROM x),
i AS (SELECT method, idx, len, p % 6 AS k, CASE WHEN p % 6 NOT IN (3, 4) THEN (s % 4)::INTEGER END AS dst, CASE WHEN p % 6 IN (1, 3) THEN [(p // 6 % 4)::INTEGER] WHEN p % 6 = 2 THEN [(p // 6 % 4)::INTEGER, ((s + 1) % 4)::INTEGER] ELSE [] END AS args, CASE WHEN p % 6 IN (3, 4) THEN (s % len)::INTEGER END AS target, CASE WHEN p % 6 IN (0, 5) THEN s % 3 END AS lit FROM b),
e AS (SELECT method, idx AS f, idx + 1 AS t FROM i WHERE k <> 4 AND idx + 1 < len UNION SELECT method, idx, target FROM i WHERE target IS NOT NULL),
reads AS (SELECT DISTINCT method, idx, unnest(args) AS reg FROM i)"""


@query(f"WITH RECURSIVE {_BODY}, r AS (SELECT DISTINCT method, 0 AS idx FROM i UNION SELECT method, t FROM r JOIN e USING (method) WHERE e.f = r.idx) SELECT method, idx FROM r")
def reachable_code(spark, d):
    return tables.reachable(_insns(spark, d))


@query(f"WITH RECURSIVE {_BODY}, r AS (SELECT method, idx FROM i WHERE idx = 0 AND k <> 2 UNION SELECT r.method, t FROM r JOIN e ON e.method = r.method AND e.f = r.idx JOIN i ON i.method = e.method AND i.idx = t WHERE i.k <> 2) SELECT method, idx FROM r")
def reachable_before_sums(spark, d):
    """Code that is reached without passing an addition."""
    return tables.reachable(_insns(spark, d), lambda x: x.op == "add")


@query(f"""
WITH RECURSIVE {_BODY}, l AS (SELECT method, idx, reg FROM reads UNION SELECT l.method, e.f, l.reg FROM l JOIN e ON e.method = l.method AND e.t = l.idx JOIN i ON i.method = e.method AND i.idx = e.f WHERE i.dst IS DISTINCT FROM l.reg) SELECT method, idx, reg FROM l
""")
def live_registers(spark, d):
    return tables.live(_insns(spark, d))


_REACHING = f"""{_BODY}, here AS (SELECT DISTINCT method, 0 AS idx FROM i UNION SELECT here.method, t FROM here JOIN e ON e.method = here.method AND e.f = here.idx),
d AS (SELECT i.method, t AS idx, dst AS reg, i.idx AS def FROM i JOIN e ON e.method = i.method AND e.f = i.idx JOIN here ON here.method = i.method AND here.idx = i.idx WHERE dst IS NOT NULL
  UNION SELECT d.method, t, reg, def FROM d JOIN e ON e.method = d.method AND e.f = d.idx JOIN i ON i.method = d.method AND i.idx = d.idx WHERE i.dst IS DISTINCT FROM reg),
u AS (SELECT method, idx, reg, def FROM d JOIN reads USING (method, idx, reg))"""


@query(f"WITH RECURSIVE {_REACHING} SELECT * FROM u")
def reaching_definitions(spark, d):
    return tables.uses(_insns(spark, d))


@query(f"""
WITH RECURSIVE {_BODY}, r AS (SELECT DISTINCT method, 0 AS idx FROM i UNION SELECT r.method, t FROM r JOIN e ON e.method = r.method AND e.f = r.idx),
w AS (SELECT r.method, r.idx AS out, 0 AS idx FROM r WHERE r.idx <> 0 UNION SELECT w.method, w.out, t FROM w JOIN e ON e.method = w.method AND e.f = w.idx WHERE t <> w.out),
dom AS (SELECT a.method, a.idx AS a, b.idx AS b FROM r a JOIN r b ON a.method = b.method AND a.idx <> b.idx WHERE a.idx = 0 OR NOT EXISTS (SELECT 1 FROM w WHERE w.method = a.method AND w.out = a.idx AND w.idx = b.idx)),
depth AS (SELECT method, b, count(*) AS n FROM dom GROUP BY ALL)
SELECT r.method, r.idx, max_by(dom.a, coalesce(depth.n, 0)) AS idom FROM r LEFT JOIN dom ON dom.method = r.method AND dom.b = r.idx LEFT JOIN depth ON depth.method = r.method AND depth.b = dom.a GROUP BY ALL
""")
def dominator_tree(spark, d):
    return tables.dominators(_insns(spark, d))


@query(f"""
WITH {_BODY}, dl AS (SELECT method, idx, dst AS reg, lit FROM i WHERE dst IS NOT NULL)
SELECT r.method, r.idx, r.reg, (SELECT lit FROM dl WHERE dl.method = r.method AND dl.reg = r.reg AND dl.idx < r.idx ORDER BY dl.idx DESC LIMIT 1) AS value FROM reads r
""")
def register_state(spark, d):
    """The last constant of each register that is read; another definition clears it."""
    return tables.register_state(_insns(spark, d), F.col("lit"))


@query(f"""
WITH RECURSIVE {_REACHING}, g AS (SELECT a.method, a.def AS x, b.def AS y FROM u a JOIN u b USING (method, idx, reg) UNION SELECT u.method, u.idx, u.def FROM u JOIN i USING (method, idx) WHERE i.k = 1 UNION SELECT u.method, u.def, u.idx FROM u JOIN i USING (method, idx) WHERE i.k = 1),
c AS (SELECT method, idx AS def, idx AS near FROM i WHERE dst IS NOT NULL UNION SELECT c.method, c.def, g.y FROM c JOIN g ON g.method = c.method AND g.x = c.near)
SELECT method, def, min(near) AS web FROM c GROUP BY ALL
""")
def value_webs(spark, d):
    insns = _insns(spark, d)
    return tables.webs(insns, tables.uses(insns))


@query(None)
def control_flow_edges(spark, d):
    """Typed edges of basic blocks; tests/test_flow.py compares them with paths."""
    return tables.control_flow(_insns(spark, d))


@query(None)
def register_kinds(spark, d):
    """Kinds of registers; tests/test_flow.py compares them with all paths of small bodies."""
    return tables.kinds(_insns(spark, d))


@query(None)
def path_constants(spark, d):
    """Literals that reads may see; tests/test_flow.py compares them with all paths."""
    return tables.known_constants(_insns(spark, d))


@query("""
WITH p AS (SELECT user_id AS method, event_id AS idx, CASE WHEN event_id % 5 < 2 THEN event_id % 5 + 1 ELSE 10 + event_id % 240 END AS code, event_id % 9 - 3 AS arg, ts FROM events),
s AS (SELECT *, sum(CASE WHEN code >= 10 THEN (code - 10) // 15 WHEN code = 1 THEN abs(arg) ELSE 0 END) OVER w AS address, sum(CASE WHEN code >= 10 THEN -4 + (code - 10) % 15 WHEN code = 2 THEN arg ELSE 0 END) OVER w AS moved FROM p WINDOW w AS (PARTITION BY method ORDER BY idx))
SELECT method, address::BIGINT AS address, (100 + moved)::BIGINT AS line FROM s WHERE code >= 10
""")
def line_positions(spark, d):
    """Events of a user as a debug line program that starts at line 100."""
    e = t(spark, d, "events")
    p = e.selectExpr("user_id method", "event_id idx", "if(event_id % 5 < 2, event_id % 5 + 1, 10 + event_id % 240) code", "if(event_id % 5 = 0, abs(event_id % 9 - 3), event_id % 9 - 3) arg")
    return tables.line_positions(p, e.selectExpr("user_id method", "100L line").distinct()).select("method", "address", "line")
