"""Queries of the evidence operators over the relational tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.functions import names
from corroba.operators import graphs, joins, votes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Joins


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL),
l AS (SELECT h, min(doc_id) AS left_id FROM h WHERE doc_id % 2 = 0 GROUP BY h HAVING count(DISTINCT doc_id) = 1),
r AS (SELECT h, min(doc_id) AS right_id FROM h WHERE doc_id % 2 = 1 GROUP BY h HAVING count(DISTINCT doc_id) = 1)
SELECT left_id, right_id, 'all' AS via FROM l JOIN r USING (h)
""")
def unique_body_match(spark, d):
    h = t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    left = h.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id")
    right = h.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    return joins.conflict_free(joins.unique_join(left, right, "h", "left_id", "right_id"), "left_id", "right_id").select("left_id", "right_id", F.lit("all").alias("via"))


_LINES = "array_sort(array_distinct(filter(split(text, '\n'), x -> x <> '')))"


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS a, sha256(array_to_string(list_sort(list_distinct(list_filter(string_split(text, chr(10)), lambda x: x <> ''))), chr(10))) AS s FROM documents WHERE text IS NOT NULL),
one AS (SELECT l, r, 'all' AS via FROM
  (SELECT a, min(doc_id) AS l FROM d WHERE doc_id % 2 = 0 GROUP BY a HAVING count(*) = 1) JOIN (SELECT a, min(doc_id) AS r FROM d WHERE doc_id % 2 = 1 GROUP BY a HAVING count(*) = 1) USING (a)),
two AS (SELECT l, r, 'lines' AS via FROM
  (SELECT s, min(doc_id) AS l FROM d WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT l FROM one) GROUP BY s HAVING count(*) = 1) JOIN (SELECT s, min(doc_id) AS r FROM d WHERE doc_id % 2 = 1 AND doc_id NOT IN (SELECT r FROM one) GROUP BY s HAVING count(*) = 1) USING (s))
SELECT * FROM one UNION ALL SELECT * FROM two
""")
def exact_cascade(spark, d):
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("a"), F.sha2(F.array_join(F.expr(_LINES), "\n"), 256).alias("s"))
    left, right = docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "l"), docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "r")
    one = joins.unique_join(left, right, "a", "l", "r").select("l", "r", F.lit("all").alias("via"))
    two = joins.unique_join(left.join(one, "l", "left_anti"), right.join(one, "r", "left_anti"), "s", "l", "r").select("l", "r", F.lit("lines").alias("via"))
    return one.union(two)


@query("""
SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(' ' || regexp_replace(d.text, '\\s+', ' ', 'g') || ' ', ' ' || regexp_replace(b.text, '\\s+', ' ', 'g') || ' ')
""".replace("\\\\", "\\"))
def passage_containment(spark, d):
    """Inverted lists of the first four words of an item (all of a shorter one), then the passage itself.

    A document's windows are hashed inside its row and only those that start an
    item leave it; at most 100,000 items are kept as one array for that, more are
    joined with all windows.
    """
    norm = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\s+", " "), F.lit(" "))
    words = F.split(F.trim(F.col("n")), " ")

    def key(i, size):
        return F.xxhash64(F.lit(size), *(F.get("w", i + j) for j in range(size)))

    items = t(spark, d, "benchmark").select("item_id", norm("text").alias("n")).withColumn("w", words).withColumn("k", F.least(F.size("w"), F.lit(4)))
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", norm("text").alias("n")).withColumn("w", words)
    out = None
    few = items.count() <= 100_000
    for size in sorted(r.k for r in items.select("k").distinct().collect()):  # at most four
        mine = items.where(F.col("k") == size).select("item_id", F.col("n").alias("item"), key(F.lit(0), size).alias("key"))
        windows = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size)), lambda i: key(i, size)))
        found = F.array_intersect(windows, mine.agg(F.collect_set("key")).scalar()) if few else F.array_distinct(windows)
        hits = docs.select("doc_id", "n", F.explode(found).alias("key")).join(mine, "key").where(F.contains("n", "item")).select("item_id", "doc_id")
        out = hits if out is None else out.union(hits)
    return out.distinct() if out is not None else spark.createDataFrame([], "item_id long, doc_id long")


@query("""
SELECT lang, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang
""")
def library_anti_join(spark, d):
    docs, labels = t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels").select("doc_id")
    out, inside = docs.join(labels, "doc_id", "left_anti").withColumn("k", F.lit(0)), docs.join(labels, "doc_id", "left_semi").withColumn("k", F.lit(1))
    return out.union(inside).groupBy("lang").agg(F.count_if(F.col("k") == 0).alias("unlabelled"), F.count_if(F.col("k") == 1).alias("labelled"))


@query("""
WITH s AS (SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey::VARCHAR AS p FROM lineitem) GROUP BY l_orderkey)
SELECT min(l_orderkey) AS first_order, count(*) AS orders, length(k)::BIGINT AS key_length FROM s GROUP BY k HAVING count(*) > 1
""")
def set_equality_match(spark, d):
    sets = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("k"))
    return sets.groupBy("k").agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("orders")).where("orders > 1").select("first_order", "orders", F.length("k").cast("long").alias("key_length"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS supp, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity < 4),
b AS (SELECT DISTINCT s_nationkey AS nation, p_brand AS brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49),
n AS (SELECT supp, count(*) AS size FROM s GROUP BY supp), h AS (SELECT supp, nation, count(*) AS n FROM s JOIN b USING (brand) GROUP BY ALL)
SELECT supp, nation FROM h JOIN n USING (supp) WHERE h.n = n.size
""")
def set_containment(spark, d):
    """Suppliers whose early brands are a subset of a nation's brands, by counting matches."""
    line, part, supp = t(spark, d, "lineitem"), t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    a = line.where("l_shipdate < timestamp_ntz'1996-01-01' and l_quantity < 4").join(part, "l_partkey").select(F.col("l_suppkey").alias("supp"), "brand").distinct()
    b = line.where("l_quantity > 49").join(supp, "l_suppkey").join(part, "l_partkey").select("nation", "brand").distinct()
    return a.join(b, "brand").groupBy("supp", "nation").agg(F.count("*").alias("n")).join(a.groupBy("supp").agg(F.count("*").alias("size")), "supp").where("n = size").select("supp", "nation")


_BANDS = [(1, 0.0, 12.0), (2, 10.0, 20.0), (3, 20.0, 30.0), (4, 35.0, 50.0)]


@query("""
WITH b(band, lo, hi) AS (VALUES (1, 0.0, 12.0), (2, 10.0, 20.0), (3, 20.0, 30.0), (4, 35.0, 50.0)),
h AS (SELECT l_orderkey, l_linenumber, min(band) AS band FROM lineitem JOIN b ON l_quantity BETWEEN lo AND hi GROUP BY ALL)
SELECT band, count(*) AS n, min(l_orderkey) AS first_order FROM h GROUP BY band
""")
def range_lookup_first(spark, d):
    bands = spark.createDataFrame(_BANDS, "band int, lo double, hi double")
    hit = joins.range_first(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", bands, "lo", "hi", "band", ["l_orderkey", "l_linenumber"], 5.0)
    first = hit.groupBy("l_orderkey", "l_linenumber").agg(F.min("band").alias("band"))  # lines that bear one number twice count once
    return first.groupBy("band").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events
""")
def asof_last_position(spark, d):
    return t(spark, d, "events").select("event_id", joins.last_before(F.when(F.col("event_type") == "click", F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("last_click"))


@query("""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS len, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS pos FROM conversations)
SELECT u.conv_id, u.pos, length(u.text)::BIGINT AS asked, length(a.text)::BIGINT AS said
FROM n u JOIN n a ON u.conv_id = a.conv_id AND u.pos = a.pos AND u.len = a.len WHERE u.role = 'user' AND a.role = 'assistant'
""")
def zip_align(spark, d):
    w = Window.partitionBy("conv_id", "role")
    n = t(spark, d, "conversations").withColumn("len", F.count("*").over(w)).withColumn("pos", F.row_number().over(w.orderBy("turn", "text")).cast("long"))
    side = lambda role, name: n.where(F.col("role") == role).select("conv_id", "len", "pos", F.length("text").cast("long").alias(name))
    return joins.zip_join(side("user", "asked"), side("assistant", "said"), "conv_id", "pos", "len").select("conv_id", "pos", "asked", "said")


# Aggregates


@query("""
WITH d AS (SELECT doc_id, lang FROM documents), l AS (SELECT doc_id, min(least(quality, 1 - toxic)) AS rank FROM labels GROUP BY doc_id)
SELECT lang, coalesce(CASE rank WHEN 0 THEN 'N' WHEN 1 THEN 'S' END, 'untouched') AS class, count(*) AS n FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL
""")
def label_lattice(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    low = t(spark, d, "labels").groupBy("doc_id").agg(F.min(F.least("quality", 1 - F.col("toxic"))).alias("rank"))
    name = F.coalesce(F.when(F.col("rank") == 0, "N").when(F.col("rank") == 1, "S"), F.lit("untouched")).alias("class")
    return docs.join(low, "doc_id", "left").groupBy("lang", name).agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT o_orderkey, min(o_totalprice) AS x FROM orders GROUP BY 1), r(rule) AS (VALUES ('large'), ('middle'), ('none'), ('small'))
SELECT rule, count(o_orderkey) AS n FROM r LEFT JOIN (SELECT o_orderkey, CASE WHEN x > 200000 THEN 'large' WHEN x > 50000 THEN 'middle' ELSE 'small' END AS rule FROM l) USING (rule) GROUP BY rule
""")
def rule_applications(spark, d):
    """Counts by rule, zero-filled from the registry."""
    registry = spark.createDataFrame([("large",), ("middle",), ("none",), ("small",)], "rule string")
    got = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "middle").otherwise("small").alias("rule"))
    return registry.join(got.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH v AS (SELECT c_nationkey AS nation, o_orderpriority AS choice, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS second, sum(n) OVER (PARTITION BY nation)::BIGINT AS total FROM v WINDOW w AS (PARTITION BY nation ORDER BY n DESC, choice))
SELECT nation, choice, n, second, total, n >= 5 AND n * 10 >= 11 * second AS clear FROM r WHERE k = 1
""")
def vote_with_margin(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("choice"))
    return votes.vote(rows, "nation", "choice").withColumn("clear", F.expr("n >= 5 and n * 10 >= 11 * second"))


@query("""
WITH v AS (SELECT event_type AS kind, user_id, sum(CASE WHEN value > 50 THEN 3 ELSE 2 END)::BIGINT AS w FROM events GROUP BY ALL)
SELECT kind, user_id, w FROM v QUALIFY rank() OVER (PARTITION BY kind ORDER BY w DESC) = 1
""")
def weighted_majority(spark, d):
    w = t(spark, d, "events").groupBy(F.col("event_type").alias("kind"), "user_id").agg(F.sum(F.when(F.col("value") > 50, 3).otherwise(2)).cast("long").alias("w"))
    return votes.argmax_ties(w, ["kind"], "w")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, n FROM c QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY n DESC) = 1
""")
def argmax_ties(spark, d):
    return votes.argmax_ties(t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), ["p_brand"], "n")


_MASK_SQL = "SELECT l_suppkey AS supp, l_returnflag AS flag, l_linestatus AS status, bit_or(1::BIGINT << (year(l_shipdate) - 1990)::INT) AS mask FROM lineitem GROUP BY ALL"


def _masks(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.year("l_shipdate") - 1990).alias("bit"))
    return votes.mask_union(rows, ["supp", "flag", "status"], "bit")


@query(_MASK_SQL)
def bitmask_merge(spark, d):
    return _masks(spark, d)


@query(f"""
WITH m AS ({_MASK_SQL}), x AS (SELECT supp, flag, status, mask & ~(1::BIGINT << 3) AS mask FROM m WHERE mask & ~(1::BIGINT << 3) <> 0)
SELECT supp, flag, status, x.mask, u.n = 1 AS is_unique FROM x JOIN (SELECT mask, count(DISTINCT supp) AS n FROM x GROUP BY mask) u ON x.mask = u.mask
""")
def leave_one_out(spark, d):
    return votes.unique_holder(votes.without_bit(_masks(spark, d), 3), "mask", "supp").select("supp", "flag", "status", "mask", "is_unique")


@query("""
SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)
""")
def intersection_over_sites(spark, d):
    e = t(spark, d, "events")
    every = e.agg(F.count_distinct("event_type").alias("all"))
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).join(F.broadcast(every), F.col("kinds") == F.col("all")).select("user_id", "kinds")


@query("""
SELECT l_orderkey, min(l_returnflag) AS flag, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(*) = count(l_returnflag) AND min(l_returnflag) = max(l_returnflag)
""")
def all_agree(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.count("*").alias("lines"), votes.all_agree(F.col("l_returnflag")).alias("ok")).where("ok").drop("ok")


@query("""
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AND count(DISTINCT l_partkey) = count(*)
""")
def complete_table(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.count_distinct("l_linenumber").alias("k"), F.count_distinct("l_partkey").alias("p"))
    return g.where("lo = 1 and hi = n and k = n and p = n").select("l_orderkey", "n")


@query("SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(*) AS parts FROM part")
def name_statistics(spark, d):
    return t(spark, d, "part").agg(F.count_distinct("p_name").alias("names"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.count("*").alias("parts"))


@query("""
SELECT lang, source, count(*) AS labelled, sum(quality)::BIGINT AS good, round(sum(quality) * 1.0 / count(*), 3) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))
""")
def rollup_precision(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id")
    out = rows.groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("labelled"), F.sum("quality").alias("good"))
    return out.select("lang", "source", "labelled", "good", F.round(F.col("good") * 1.0 / F.col("labelled"), 3).cast("double").alias("precision"))


@query("""
WITH c AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS clones FROM c JOIN (SELECT h, count(DISTINCT doc_id) AS n FROM c GROUP BY h HAVING count(DISTINCT doc_id) > 1) USING (h)
""")
def clone_classes(spark, d):
    c = t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return c.join(c.groupBy("h").agg(F.count_distinct("doc_id").alias("clones")).where("clones > 1"), "h").select("doc_id", "clones")


@query("""
SELECT p_brand, p_partkey FROM part WHERE p_size > 25 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 8
""")
def capped_samples(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return t(spark, d, "part").where("p_size > 25").withColumn("r", F.row_number().over(w)).where("r <= 8").select("p_brand", "p_partkey")


# Windows


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS a, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS trigrams, count(DISTINCT a || chr(1) || b || chr(1) || c) AS kinds FROM g WHERE c IS NOT NULL GROUP BY doc_id
""")
def trigram_windows(spark, d):
    """Windows of three words inside the row's own array: no exchange of words."""
    w = t(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w")).where("size(w) >= 3")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice(F.col("w"), i, 3), "\u0001"))
    return w.select("doc_id", (F.size("w") - 2).cast("long").alias("trigrams"), F.size(F.array_distinct(grams)).cast("long").alias("kinds"))


@query("""
WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run HAVING count(*) > 1
""")
def run_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = t(spark, d, "events").withColumn("turn", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)).withColumn("run", F.sum("turn").over(w))
    return f.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n")).where("n > 1")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (a = 'purchase') AS next_purchase, count(*) FILTER (soon > 0) AS purchase_within_7 FROM (
  SELECT event_type, lead(event_type) OVER w AS a, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS soon
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY event_type
""")
def look_ahead_hints(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events").select("event_type", F.lead("event_type").over(w).alias("a"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w.rowsBetween(1, 7)).alias("soon"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("a") == "purchase").alias("next_purchase"), F.count_if(F.col("soon") > 0).alias("purchase_within_7"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_record(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)::INTEGER AS occurrence FROM lineitem
""")
def occurrence_number(spark, d):
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(w).alias("occurrence"))


# Fingerprints


# Graphs


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 3 AS d FROM part WHERE p_partkey // 3 > 0),
c AS (SELECT s, d, 1 AS depth FROM e UNION SELECT c.s, e.d, c.depth + 1 FROM c JOIN e ON c.d = e.s WHERE c.depth < 12)
SELECT s AS src, d AS dst, min(depth) AS depth FROM c GROUP BY ALL
""")
def closure_depth(spark, d):
    e = t(spark, d, "part").selectExpr("p_partkey s", "p_partkey div 3 d").where("d > 0")
    return graphs.closure(e, "s", "d")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - 7 * (p_size % 5 + 1) AS b FROM part WHERE p_partkey - 7 * (p_size % 5 + 1) > 0),
b AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r AS (SELECT p_partkey AS u, p_partkey AS v FROM part UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u)
SELECT u AS node, min(v) AS component FROM r GROUP BY u
""")
def components_min_label(spark, d):
    part = t(spark, d, "part")
    e = part.selectExpr("p_partkey a", "p_partkey - 7 * (p_size % 5 + 1) b").where("b > 0")
    return graphs.components(part, "p_partkey", e, "a", "b")


def _wl_sql(rounds: int) -> str:
    steps = ["e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || o_orderpriority AS dst FROM orders UNION SELECT DISTINCT 'n' || c_nationkey, 'c' || c_custkey FROM customer)", "l0 AS (SELECT n AS node, substr(sha256(substr(n, 1, 1)), 1, 16) AS label FROM (SELECT src AS n FROM e UNION SELECT dst FROM e))"]
    part = "sum(('0x' || substr(md5('{0}|' || label), 1, 8))::BIGINT)::VARCHAR"
    side = "(SELECT {0} AS node, concat_ws(',', count(*)::VARCHAR, " + part.format(1) + ", " + part.format(2) + ") AS s FROM e JOIN l{2} x ON x.node = e.{1} GROUP BY {0})"
    for i in range(rounds):
        steps.append(f"l{i + 1} AS (SELECT node, substr(sha256(label || '|' || coalesce(u.s, '') || '|' || coalesce(v.s, '')), 1, 16) AS label FROM l{i} LEFT JOIN {side.format('src', 'dst', i)} u USING (node) LEFT JOIN {side.format('dst', 'src', i)} v USING (node))")
    return f"WITH {', '.join(steps)} SELECT node, label FROM l{rounds}"


@query(_wl_sql(4))
def wl_labels_4(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    e = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "o_orderpriority").alias("dst")).union(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"))).distinct()
    e = graphs.cut(e)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graphs.refine(nodes, e, 4, F.substring(F.sha2(F.substring("node", 1, 1), 256), 1, 16))


def _layers_sql(rounds: int) -> str:
    steps = ["e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 50 = 49 THEN p_partkey ELSE p_partkey // 4 END AS dst FROM part WHERE p_partkey > 0)", "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "l0 AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT src FROM e))"]
    for i in range(1, rounds + 1):
        steps.append(f"l{i} AS (SELECT * FROM l{i - 1} UNION ALL SELECT node, {i} FROM n WHERE node NOT IN (SELECT node FROM l{i - 1}) AND node NOT IN (SELECT src FROM e WHERE dst NOT IN (SELECT node FROM l{i - 1})))")
    return f"WITH {', '.join(steps)} SELECT node, layer FROM l{rounds}"


@query(_layers_sql(10))
def topo_layers(spark, d):
    e = graphs.cut(t(spark, d, "part").where("p_partkey > 0").selectExpr("p_partkey src", "case when p_partkey % 50 = 49 then p_partkey else p_partkey div 4 end dst"))
    return graphs.layers(e)


@query(None)
def highest_version_select(spark, d):
    """Pins, requests and constraints made from parts; what only evicted versions asked for is not selected. tests/test_graphs.py compares it with the sequential rule."""
    part = t(spark, d, "part")
    q = part.where("p_partkey % 3 > 0").selectExpr("p_partkey % 200 module", "cast(p_size % 6 as bigint) version", "(p_partkey * 7 + 3) % 200 needs", "cast((p_size * 5 + p_partkey) % 6 as bigint) needs_version").distinct()
    k = part.where("p_partkey % 17 = 0").selectExpr("p_partkey % 200 module", "cast(p_size % 6 as bigint) version", "(p_partkey * 11 + 1) % 200 needs", "6L needs_version").distinct()
    pins = part.where("p_partkey % 200 < 5").groupBy(F.expr("p_partkey % 200").alias("module")).agg(F.min(F.expr("cast(p_size % 6 as bigint)")).alias("version"))
    return graphs.select_versions(graphs.cut(q), pins, graphs.cut(k))


def _cancel_sql(rounds: int) -> str:
    steps = ["m0 AS (SELECT c_custkey AS item, c_nationkey % 3 AS target FROM customer WHERE c_custkey % 5 < 4)", "k AS (SELECT c_custkey AS a, c_custkey - 40 AS b FROM customer WHERE c_custkey > 40 AND c_custkey % 6 = 1)"]
    for i in range(1, rounds + 1):
        steps.append(f"x{i} AS (SELECT a, b FROM k LEFT JOIN m{i - 1} p ON p.item = a LEFT JOIN m{i - 1} q ON q.item = b WHERE p.target IS DISTINCT FROM q.target), m{i} AS (SELECT * FROM m{i - 1} WHERE item NOT IN (SELECT a FROM x{i}) AND item NOT IN (SELECT b FROM x{i}))")
    return f"WITH {', '.join(steps)} SELECT item, target FROM m{rounds}"


@query(_cancel_sql(12))
def constraint_cancel(spark, d):
    c = t(spark, d, "customer")
    moves = c.where("c_custkey % 5 < 4").selectExpr("c_custkey item", "c_nationkey % 3 target")
    return graphs.cancel(moves, c.where("c_custkey > 40 and c_custkey % 6 = 1").selectExpr("c_custkey a", "c_custkey - 40 b"))


@query("""
WITH h AS (SELECT p_partkey, sha256(p_partkey::VARCHAR) AS h FROM part)
SELECT p_partkey, substr(h, 1, 4) AS p4, row_number() OVER (PARTITION BY substr(h, 1, 4) ORDER BY h, p_partkey) = 1 AS first FROM h
""")
def prefix_owners(spark, d):
    h = t(spark, d, "part").select("p_partkey", F.sha2(F.col("p_partkey").cast("string"), 256).alias("h"))
    return h.select("p_partkey", F.substring("h", 1, 4).alias("p4"), (F.row_number().over(Window.partitionBy(F.substring("h", 1, 4)).orderBy("h", "p_partkey")) == 1).alias("first"))


@query(None)
def short_unique_names(spark, d):
    """Order-dependent prefixes with hints, a namespace by size and ties by name; tests/test_graphs.py compares them with the sequential rule."""
    h = t(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("h"), F.lower(F.substring("p_brand", 1, 3)).alias("hint"), (F.col("p_size") % 3).cast("string").alias("space"))
    return graphs.assign_names(h, "p_partkey", "h", F.col("hint"), F.col("space")).select("p_partkey", "name", "tied")


# Sources, scalars, sets, grading


@query("""
SELECT page_id, regexp_extract(html, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1) AS version FROM pages WHERE regexp_matches(html, '[0-9]+\\.[0-9]+\\.[0-9]+')
""".replace("\\\\", "\\"))
def version_strings(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", r"([0-9]+\.[0-9]+\.[0-9]+)", 1).alias("version")).where("version <> ''")


@query("SELECT event_type, (props::JSON->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def marker_json(spark, d):
    return t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""
WITH p(kind, prefix) AS (VALUES ('plain', 'http://'), ('secure', 'https://'), ('mobile', 'https://m.'))
SELECT kind, page_id FROM pages JOIN p ON starts_with(url, prefix) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY page_id) <= 8
""")
def source_detect(spark, d):
    """A fixed prefix table; the first 8 pieces of evidence for each kind."""
    table = [("plain", "http://"), ("secure", "https://"), ("mobile", "https://m.")]
    kinds = F.filter(F.array(*(F.when(F.startswith("url", F.lit(p)), F.lit(k)) for k, p in table)), lambda x: x.isNotNull())
    rows = t(spark, d, "pages").select("page_id", F.explode(kinds).alias("kind"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("page_id"))).where("r <= 8").select("kind", "page_id")


@query("""
SELECT o_orderkey, (('0x' || substr(sha256('seed1|' || o_orderkey), 1, 12))::BIGINT % 1000000) AS bucket FROM orders WHERE ('0x' || substr(sha256('seed1|' || o_orderkey), 1, 12))::BIGINT % 1000000 < 100000
""")
def hash_sample(spark, d):
    return t(spark, d, "orders").select("o_orderkey", names.hash_permille(F.col("o_orderkey").cast("string"), "seed1").alias("bucket")).where("bucket < 100000")


@query("""
WITH n AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)
SELECT length(w)::BIGINT AS len, count(*) AS n FROM n WHERE regexp_full_match(w, '[a-zA-Z][0-9a-zA-Z]*') AND length(w) <= 4 AND w NOT IN ('it', 'by', 'do') GROUP BY 1
""")
def generated_names(spark, d):
    w = t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return w.where(names.maybe_generated(F.col("w"), 4)).groupBy(F.length("w").cast("long").alias("len")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey <= 26 THEN 1 WHEN c_custkey <= 962 THEN 2 WHEN c_custkey <= 34658 THEN 3 WHEN c_custkey <= 1247714 THEN 4 ELSE 5 END AS len FROM customer
""")
def capacity_lengths(spark, d):
    return t(spark, d, "customer").select("c_custkey", names.capacity_length(F.col("c_custkey")).alias("len"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'O')
SELECT 'intersect' AS op, count(*) AS n, min(c) AS lo FROM (SELECT c FROM a INTERSECT SELECT c FROM b)
UNION ALL SELECT 'except', count(*), min(c) FROM (SELECT c FROM a EXCEPT SELECT c FROM b)
UNION ALL SELECT 'union', count(*), min(c) FROM (SELECT c FROM a UNION SELECT c FROM b)
""")
def set_operations(spark, d):
    o = t(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c")).distinct() for s in "FO")
    out = [x.agg(F.count("*").alias("n"), F.min("c").alias("lo")).select(F.lit(k).alias("op"), "n", "lo") for k, x in (("intersect", a.intersect(b)), ("except", a.exceptAll(b)), ("union", a.union(b).distinct()))]
    return out[0].union(out[1]).union(out[2])


@query("""
WITH m AS (SELECT l_orderkey AS o, map_from_entries(list((l_returnflag, n))) AS x FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT a.o AS small, b.o AS large FROM m a JOIN m b ON b.o = a.o + 1 WHERE len(list_filter(map_entries(a.x), lambda e: coalesce(element_at(b.x, e.key)[1], 0) < e.value)) = 0
""")
def multiset_inclusion(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), "l_returnflag").agg(F.count("*").alias("n"))
    m = n.groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("x"))
    pair = m.select(F.col("o").alias("small"), F.col("x").alias("a"), (F.col("o") + 1).alias("large")).join(m.select(F.col("o").alias("large"), F.col("x").alias("b")), "large")
    return pair.where(F.forall(F.map_keys("a"), lambda k: F.coalesce(F.try_element_at("b", k), F.lit(0)) >= F.element_at("a", k))).select("small", "large")


@query("""
WITH old AS (SELECT lang, source, sum(quality) AS s FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 0 GROUP BY ALL), new AS (SELECT lang, source, sum(quality) AS s FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT old.lang, old.source, old.s::BIGINT AS old_value, new.s::BIGINT AS new_value FROM old LEFT JOIN new ON old.lang = new.lang AND old.source = new.source WHERE new.s IS NULL OR new.s < old.s
""")
def ratchet_check(spark, d):
    """Metrics that dropped or vanished."""
    rows = t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id")
    old, new = (rows.where(f"doc_id % 2 = {k}").groupBy("lang", "source").agg(F.sum("quality").alias(name)) for k, name in ((0, "old_value"), (1, "new_value")))
    return old.join(new, ["lang", "source"], "left").where("new_value is null or new_value < old_value")


@query("""
WITH a AS (SELECT event_type AS k, count(*) AS a FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS k, count(*) AS b FROM events WHERE user_id % 3 = 0 GROUP BY 1)
SELECT k, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(b, 0) - coalesce(a, 0) AS diff FROM a FULL JOIN b USING (k)
""")
def failure_diff(spark, d):
    e = t(spark, d, "events")
    a, b = (e.where(f"user_id % {m} = 0").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias(n)) for m, n in ((2, "a"), (3, "b")))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).withColumn("diff", F.col("b") - F.col("a"))
