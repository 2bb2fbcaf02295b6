"""Queries of text sources, reports and stored databases: texts made from the tables are parsed again, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroba.operators import reports
from corroba.plans.queries import query, t
from corroba.sources import text


@query("""
WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'classes.dex' WHEN 1 THEN 'base/dex/classes' || p_partkey || '.dex' WHEN 2 THEN 'lib' || p_size || '.dex' ELSE 'classes' || p_size || '.dex' END AS name FROM part)
SELECT name, min(p_partkey) AS first_part, dense_rank() OVER (ORDER BY CASE WHEN NOT regexp_full_match(name, '(.*/)?classes[0-9]*\\.dex') THEN 1099511627776 ELSE coalesce(try_cast(regexp_extract(name, 'classes([0-9]*)\\.dex', 1) AS BIGINT), 1) END, name)::INTEGER AS place FROM n GROUP BY name
""".replace("\\\\", "\\"))
def input_order(spark, d):
    from pyspark.sql import Window

    n = t(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then 'classes.dex' when 1 then concat('base/dex/classes', p_partkey, '.dex') when 2 then concat('lib', p_size, '.dex') else concat('classes', p_size, '.dex') end name")
    distinct = n.groupBy("name").agg(F.min("p_partkey").alias("first_part"))
    return distinct.select("name", "first_part", F.dense_rank().over(Window.orderBy(text.input_order(F.col("name")))).alias("place"))  # a row a file of one program


_FILE = "CASE page_id % 6 WHEN 0 THEN 'META-INF/lib' || page_id || '.version' WHEN 1 THEN 'META-INF/a/b.version' WHEN 2 THEN 'app' || page_id || '.properties' WHEN 3 THEN 'base/root/x' || page_id || '.proto' WHEN 4 THEN 'a/b.properties' ELSE 'base/root/META-INF/l' || page_id || '.version' END"


@query(f"""
WITH f AS (SELECT page_id, regexp_replace({_FILE}, '^base/root/', '') AS name, html FROM pages WHERE html IS NOT NULL)
SELECT page_id, name, length(html)::BIGINT AS chars FROM f WHERE (strlen(html) <= 4096 AND (regexp_full_match(name, 'META-INF/[^/]*\\.version') OR regexp_full_match(name, '[^/]*\\.properties'))) OR (strlen(html) <= 524288 AND ends_with(name, '.proto'))
""".replace("\\\\", "\\"))
def package_resources(spark, d):
    """Which files of a package are read as resources."""
    name = "case page_id % 6 when 0 then concat('META-INF/lib', page_id, '.version') when 1 then 'META-INF/a/b.version' when 2 then concat('app', page_id, '.properties') when 3 then concat('base/root/x', page_id, '.proto') when 4 then 'a/b.properties' else concat('base/root/META-INF/l', page_id, '.version') end"
    f = t(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("file"), text.root_name(F.expr(name)).alias("name"), F.octet_length("html").cast("long").alias("size"), F.encode("html", "utf-8").alias("content"))
    return text.resources(f).select(F.col("file").alias("page_id"), "name", F.length("text").cast("long").alias("chars"))


@query("""
WITH u AS (SELECT page_id, url, len(url) AS n FROM pages WHERE url IS NOT NULL AND strlen(url) = len(url)),
a AS (SELECT *, (1 + list_sum(list_transform(range(1, n + 1), lambda i: ascii(substr(url, i::INT, 1))))) % 65521 AS lo, (n + list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * ascii(substr(url, i::INT, 1))))) % 65521 AS hi FROM u)
SELECT page_id, (hi * 65536 + lo)::BIGINT AS adler, sha1(url) AS sha1, sha256(url) AS sha256 FROM a
""")
def url_checksums(spark, d):
    u = t(spark, d, "pages").where("url is not null and octet_length(url) = length(url)")
    raw = F.col("url").cast("binary")
    return u.select("page_id", text.adler32(raw).alias("adler"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))


@query("""
WITH s AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '~~' || 'Bad-Tool' ELSE '~~' || event_type || event_id % 3 END || CASE WHEN event_id % 10 = 2 THEN '{broken' ELSE '{"version":"' || (user_id % 5) || '.1","min-api":' || (user_id % 7) || ',"pg-map-id":"m' || (user_id % 3) || '"}' END AS s FROM events)
SELECT regexp_extract(s, '^~~([0-9a-zA-Z]+)', 1) AS tool, regexp_extract(s, '(\\{.*)$', 1) AS json, (regexp_extract(s, '(\\{.*)$', 1)::JSON)->>'version' AS version, ((regexp_extract(s, '(\\{.*)$', 1)::JSON)->>'min-api')::BIGINT AS min_api, NULL::VARCHAR AS mode, (regexp_extract(s, '(\\{.*)$', 1)::JSON)->>'pg-map-id' AS map_id
FROM s WHERE regexp_matches(s, '^~~[0-9a-zA-Z]+\\{"') GROUP BY ALL
""".replace("\\\\", "\\"))
def marker_strings(spark, d):
    s = t(spark, d, "events").selectExpr("""concat(case event_id % 4 when 0 then 'x' when 1 then '~~Bad-Tool' else concat('~~', event_type, event_id % 3) end, if(event_id % 10 = 2, '{broken', concat('{"version":"', user_id % 5, '.1","min-api":', user_id % 7, ',"pg-map-id":"m', user_id % 3, '"}'))) s""")
    return text.markers(s, "s")


@query("""
WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem GROUP BY ALL)
SELECT k, 'shop.Order' || k AS full_name, count(n)::INTEGER + 1 AS fields FROM o LEFT JOIN l USING (k) GROUP BY k
UNION ALL SELECT k, 'shop.Order' || k || '.Item', 2 FROM o
""")
def message_definitions(spark, d):
    """A definition file an order: its lines are fields of the message, half of them in a oneof; comments, options, an enum and a nested message beside them."""
    n = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    field = F.concat(F.lit("  optional int32 line"), "l_linenumber", F.lit(" = "), F.col("l_linenumber") + 1, F.lit(";"))
    lines = n.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" oneof o"), "l_linenumber", F.lit(" {"), field, F.lit("}"))).otherwise(field).alias("x")))), lambda r: r["x"]), "\n").alias("body"))
    files = t(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct().join(lines, "k", "left")
    made = F.concat(F.lit('syntax = "proto3"; // message Not { int32 a = 1; }\npackage shop; option x = "a;b";\nmessage Order'), "k", F.lit(" {\n /* enum {} */ option deep = 3; reserved 4;\n enum Kind { A = 0; B = 1; }\n message Item { string name = 1 [default = \"x = 3\"]; bytes data = 2; }\n int64 id = 1;\n"), F.coalesce("body", F.lit("")), F.lit("\n}\nservice S { rpc Go (A) returns (B); }"))
    return text.messages(files.select("k", made.alias("text")), "text").select("k", "full_name", F.size("fields").alias("fields"))


@query("""
SELECT c_custkey AS file, unnest(['min_api', 'keep']) AS key, unnest([(c_custkey % 30)::VARCHAR, 'a' || c_nationkey || '|b = ' || c_mktsegment]) AS vals FROM customer
""")
def settings_files(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.posexplode(F.array(F.concat(F.lit("min_api = "), F.col("c_custkey") % 30, F.lit("  # a comment")), F.lit(""), F.lit("# alone"), F.concat(F.lit("keep = a"), "c_nationkey"), F.concat(F.lit("keep=b = "), "c_mktsegment"))).alias("line", "text"))
    return text.settings(c, "file", "line", "text", ["min_api", "keep", "lib"], ["keep", "lib"]).select("file", "key", F.array_join("values", "|").alias("vals"))


@query("SELECT n_nationkey AS place, 'gen' AS kind, n_name AS name, n_regionkey::VARCHAR AS seed, (n_nationkey % 4)::VARCHAR AS part FROM nation")
def scenario_catalog(spark, d):
    lines = t(spark, d, "nation").select(F.col("n_nationkey").alias("place"), F.concat(F.lit(" gen  "), "n_name", F.lit(" seed="), "n_regionkey", F.lit("  part="), F.col("n_nationkey") % 4, F.lit(" # note")).alias("text"))
    return text.catalog(lines, "text").select("place", "kind", "name", F.col("options")["seed"].alias("seed"), F.col("options")["part"].alias("part"))


@query("SELECT n_regionkey AS file, 'classes' AS section, 'L' || n_name || ';' AS entry FROM nation UNION SELECT n_regionkey, 'methods', n_name || '.run()V' FROM nation")
def platform_table(spark, d):
    n = t(spark, d, "nation")
    head = n.select("n_regionkey").distinct().selectExpr("n_regionkey file", "explode(array(struct(0 line, '[classes]' text), struct(1 line, '# comment' text), struct(1000 line, ' [methods] ' text), struct(1001 line, '' text))) x").select("file", "x.*")
    rows = n.selectExpr("n_regionkey file", "10 + n_nationkey line", "concat('L', n_name, ';') text").union(n.selectExpr("n_regionkey", "1010 + n_nationkey", "concat(n_name, '.run()V')"))
    return text.sections(head.union(rows), "file", "line", "text")


@query("""
SELECT 'g' AS "group", 'm' || p_partkey AS module, (p_size % 9)::VARCHAR AS version, 'g' AS needs_group, 'm' || (p_partkey * 7 % 100) AS needs, '1.' || (p_partkey % 5) AS needs_version, false AS "constraint" FROM part
UNION ALL SELECT 'g', 'm' || p_partkey, (p_size % 9)::VARCHAR, 'h', 'k' || (p_partkey % 10), '2.' || (p_size % 3), true FROM part
""")
def module_metadata(spark, d):
    j = t(spark, d, "part").selectExpr("""concat('{"component":{"group":"g","module":"m', p_partkey, '","version":"', p_size % 9, '"},"variants":[{"name":"api","dependencies":[{"group":"g","module":"m', p_partkey * 7 % 100, '","version":{"requires":"1.', p_partkey % 5, '"}}]},{"name":"run","dependencies":[{"group":"g","module":"m', p_partkey * 7 % 100, '","version":{"requires":"1.', p_partkey % 5, '"}}],"dependencyConstraints":[{"group":"h","module":"k', p_partkey % 10, '","version":{"strictly":"2.', p_size % 3, '","requires":"9"}}]}]}') json""")
    return text.module_requests(j, "json")


@query("""
SELECT 'g' AS "group", 'm' || p_partkey AS module, '1.' || p_size AS version, 'g' AS needs_group, 'own' AS needs, '3.' || (p_partkey % 4) AS needs_version FROM part
UNION ALL SELECT 'g', 'm' || p_partkey, '1.' || p_size, 'g', 'kept', '7.' || (p_size % 3) FROM part
""")
def project_files(spark, d):
    """Versions of their own and managed ones; a test dependency is left out."""
    part = t(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file makes large texts
    x = part.selectExpr("""concat('<project><groupId>g</groupId><artifactId>m', p_partkey, '</artifactId><version>1.', p_size, '</version><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>kept</artifactId><version>7.', p_size % 3, '</version></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>own</artifactId><version>3.', p_partkey % 4, '</version></dependency><dependency><groupId>g</groupId><artifactId>kept</artifactId></dependency><dependency><groupId>g</groupId><artifactId>junit</artifactId><version>4</version><scope>test</scope></dependency></dependencies></project>') xml""")
    return text.pom_requests(x)


@query("""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT o % 4 AS file, 'Lx/C' || o || ';' AS class, 'm' || n AS method, '(I)V' AS proto, (n * 16 + k)::INTEGER AS "offset", CASE k WHEN 0 THEN 'const/4' ELSE 'return-void' END AS op, CASE k WHEN 0 THEN 'v0, #int ' || p ELSE '' END AS operands FROM l, (SELECT unnest([0, 2]) AS k)
""")
def dump_instructions(spark, d):
    l = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))  # noqa: E741
    head = l.select("o").distinct().selectExpr("o % 4 file", "o * 1000 line", "concat('  Class descriptor  : ''Lx/C', o, ';''') text")
    body = l.selectExpr("o % 4 file", "explode(array(struct(o * 1000 + n * 10 line, concat('      name          : ''m', n, '''') text), struct(o * 1000 + n * 10 + 1 line, '      type          : ''(I)V''' text), struct(o * 1000 + n * 10 + 2 line, concat('0012ab: 1230                                   |', lower(lpad(hex(n * 16), 4, '0')), ': const/4 v0, #int ', p, ' // #3') text), struct(o * 1000 + n * 10 + 3 line, concat('0012ad: 0e00                                   |', lower(lpad(hex(n * 16 + 2), 4, '0')), ': return-void') text))) x").select("file", "x.*")
    return text.dump_instructions(head.union(body))


@query("""
SELECT 'lineitem.l_orderkey refers to orders.o_orderkey' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels.doc_id refers to documents.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'supplier.s_nationkey refers to customer.c_nationkey', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'orders.o_custkey is unique', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'part.p_partkey is unique', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
""")
def database_violations(spark, d):
    names = ("lineitem", "orders", "labels", "documents", "supplier", "customer", "part")
    references = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("supplier", "s_nationkey", "customer", "c_nationkey")]
    return text.violations({n: t(spark, d, n) for n in names}, references, [("orders", "o_custkey"), ("part", "p_partkey")])


@query("""
SELECT '{"inputs":[' || (SELECT string_agg('{"name":"' || r_name || '","key":' || r_regionkey || '}', ',' ORDER BY r_name, r_regionkey) FROM region) || '],"summary":[' ||
  (SELECT string_agg('{"status":"' || o_orderstatus || '","n":' || n || '}', ',' ORDER BY n DESC, o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) || ']}' AS json
""")
def report_json(spark, d):
    """A report of two sections; the third is optional and empty."""
    inputs = t(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    status = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), (-F.count("*")).alias("m"))
    down = status.select(F.struct("status", "n").alias("row"), "m", "status").select("m", "status", "row")
    one = reports.report_json({"inputs": inputs, "rewrites": status.where("n < 0").select("status")}, {"rewrites"})
    ordered = reports.canonical_text(down.withColumn("k", F.lit(1)), "k", ["m", "status"], F.to_json("row"), ",")
    return one.withColumn("k", F.lit(1)).join(ordered, "k").select(F.concat(F.regexp_replace("json", "}$", ""), F.lit(',"summary":['), "text", F.lit("]}")).alias("json"))


@query("""
SELECT l_orderkey, substr(sha256(string_agg(l_linenumber || ' ' || l_returnflag || l_linestatus || ' ' || l_partkey, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey)), 1, 16) AS hash FROM lineitem GROUP BY 1
""")
def canonical_dump(spark, d):
    """The rendering of each order with its lines in order, hashed."""
    text_of = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.concat("l_returnflag", "l_linestatus"), F.col("l_partkey").cast("string"))
    dump = reports.canonical_text(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag", "l_linestatus", "l_partkey"], text_of)
    return dump.select("l_orderkey", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@query("""
SELECT count(DISTINCT p_partkey) = count(*) AS whole, true AS fits, true AS contiguous FROM part
""")
def multi_file_split(spark, d):
    """Whether every part is in one file, no file is over a fifth of all and more, and files are ranges of keys."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))
    total, largest = part.agg(F.sum("size"), F.max("size")).first()
    most = total // 5 + largest
    files = reports.multi_file(part, "key", "size", most)
    span = files.join(part, "key").groupBy("file").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("s"), F.count("*").alias("n"))
    apart = span.alias("a").join(span.alias("b"), F.expr("a.file < b.file and a.hi >= b.lo")).agg(F.count("*").alias("n"))
    return span.agg((F.sum("n") == part.agg(F.count("*")).scalar()).alias("whole"), (F.max("s") <= most).alias("fits")).select("whole", "fits", (apart.scalar() == 0).alias("contiguous"))
