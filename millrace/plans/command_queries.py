"""Queries of commands and aggregates and their options, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions import aggregates, bins
from millrace.operators import combine, learn, rows, shape, stats, templates
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import tables
from millrace.streaming import windows

c = F.col


# Sources


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def source_several(spark, d):
    a = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("name"))
    return combine.union(a, table(spark, d, "supplier").select(c("s_suppkey").alias("k"), c("s_name").alias("name")))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 AND event_type IN ('click', 'view') OR user_id BETWEEN 10 AND 20 GROUP BY 1")
def search_expression(spark, d):
    return tables.source(spark, d, "events").where((c("value") > 50) & c("event_type").isin("click", "view") | c("user_id").between(10, 20)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('ann', '3', NULL), ('bo', '5', 'x')) AS t(name, size, note)")
def makeresults_csv(spark, d):
    return tables.makeresults(spark, data="name,size,note\nann,3,\nbo,5,x", form="csv")


@query("SELECT * FROM (VALUES ('ann', 3), ('bo', NULL)) AS t(name, size)")
def makeresults_json(spark, d):
    return tables.makeresults(spark, data='[{"name": "ann", "size": 3}, {"name": "bo", "size": null}]')


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)")
def values_rows(spark, d):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")


@query("SELECT 3 AS n, true AS recent")
def makeresults_count(spark, d):
    return tables.makeresults(spark, 3).agg(F.count("*").alias("n"), (F.min("@timestamp") <= F.current_timestamp()).alias("recent"))


@query("SELECT * FROM (VALUES ('mill_nation', 'VIEW'), ('mill_region', 'VIEW')) AS t(TABLE_NAME, TABLE_TYPE)")
def show_tables_like(spark, d):
    for n in ("nation", "region"):
        table(spark, d, n).createOrReplaceTempView(f"mill_{n}")
    return tables.show_tables(spark, "mill\\_%")


@query("SELECT * FROM (VALUES ('mill_nation', 'n_name', 2), ('mill_region', 'r_name', 2)) AS t(TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION)")
def describe_columns_like(spark, d):
    for n in ("nation", "region"):
        table(spark, d, n).createOrReplaceTempView(f"mill_{n}")
    return tables.describe_tables(spark, "mill\\_%", "%\\_name").select("TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION")


@query("SELECT vec_id, _score FROM (SELECT vec_id, (1 + list_sum([x * 0.1 FOR x IN embedding::DOUBLE[]]) / (sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) * sqrt(len(embedding) * 0.01))) / 2 AS _score FROM embeddings) ORDER BY _score DESC LIMIT 10")
def vector_search_cosine(spark, d):
    e = table(spark, d, "embeddings")
    size = e.select(F.size("embedding")).first()[0]
    return tables.nearest(e, [0.1] * size, 10, metric="cosine").select("vec_id", "_score")


# Shaping


@query("SELECT p_partkey, p_size + 1 AS p_size_more, p_retailprice + 1 AS p_retailprice_more FROM part")
def foreach_segments(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    for pattern in ("p_s*e", "p_re*ice"):
        df = shape.foreach(df, pattern, "`<<FIELD>>` + 1", "<<FIELD>>_more")
    return df.drop("p_size", "p_retailprice")


@query("SELECT conv_id, CAST(sum(turn * 2) AS BIGINT) AS total FROM conversations GROUP BY 1")
def foreach_multivalue(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    return shape.foreach_items(g, "turns", "0L", "<<VALUE>> + <<ITEM>> * 2", "total").drop("turns")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 7 AS total, '0:' || json_extract_string(props, '$.k') || ';1:7;' AS told FROM events")
def foreach_json_array(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", 7]")).alias("a"))
    e = shape.foreach_items(e, "a", "0L", "<<VALUE>> + cast(<<ITEM>> AS bigint)", "total", from_json=True)
    return shape.foreach_items(e, "a", "''", "concat(<<VALUE>>, <<ITER>>, ':', <<ITEM>>, ';')", "told", from_json=True).drop("a")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def spath_all(spark, d):
    e = shape.spath(table(spark, d, "events").select("event_id", "props"), "props", output="m")
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


@query("SELECT event_id, '[1, ' || json_extract_string(props, '$.k') || ']' AS seen FROM events")
def spath_array(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"a":{"seen":[1,'), F.get_json_object("props", "$.k"), F.lit("]}}")).alias("props"))
    return shape.spath(e, "props", output="m").select("event_id", F.try_element_at("m", F.lit("a.seen{}")).alias("seen"))


@query("SELECT regexp_replace(url, '[a-zA-Z0-9]+', '<*>', 'g') AS patterns_field, count(*) AS pattern_count, list_sort(list(DISTINCT url))[1:2] AS sample_logs FROM pages GROUP BY 1")
def patterns_samples(spark, d):
    return shape.patterns(table(spark, d, "pages"), "url", samples=2, aggregate=True).select("patterns_field", "pattern_count", "sample_logs")


@query("SELECT p_partkey, 'Brand#' AS a, '<token1>#<token2>' AS patterns_field, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1) AS t1, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS t2 FROM part")
def patterns_tokens(spark, d):
    p = shape.patterns(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", numbered_tokens=True)
    return p.select("p_partkey", F.lit("Brand#").alias("a"), "patterns_field", F.try_element_at("tokens", F.lit("<token1>")).alias("t1"), F.try_element_at("tokens", F.lit("<token2>")).alias("t2"))


@query("""SELECT event_id, 'event <*IP*> took ' || CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END || ' of <*>' AS patterns_field
FROM (SELECT event_id FROM events)""")
def patterns_brain(spark, d):
    text = F.concat(F.lit("event 10.0.0."), (c("event_id") % 200).cast("string"), F.lit(" took "), F.when(c("event_id") % 2 == 0, "long").otherwise("short"), F.lit(" of "), (c("event_id") + 1000).cast("string"))
    return templates.label(table(spark, d, "events").select("event_id", text.alias("m")), "m").select("event_id", "patterns_field")


@query("SELECT 'event <*IP*> took ' || CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END || ' of <*>' AS patterns_field, count(*) AS pattern_count FROM events GROUP BY 1")
def patterns_brain_count(spark, d):
    text = F.concat(F.lit("event 10.0.0."), (c("event_id") % 200).cast("string"), F.lit(" took "), F.when(c("event_id") % 2 == 0, "long").otherwise("short"), F.lit(" of "), (c("event_id") + 1000).cast("string"))
    return templates.counted(table(spark, d, "events").select(text.alias("m")), "m").select("patterns_field", "pattern_count")


@query("SELECT c_custkey, translate(c_name, 'abc', 'xyz') AS c_name FROM customer")
def rex_translate(spark, d):
    return shape.sed(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "y/abc/xyz/")


@query("SELECT page_id, nullif(regexp_extract(url, '://([a-z]+)[.]([a-z]+)', 1), '') AS host, nullif(regexp_extract(url, '://([a-z]+)[.]([a-z]+)', 2), '') AS domain, CASE WHEN regexp_matches(url, '://([a-z]+)[.]([a-z]+)') THEN strpos(url, '://') - 1 END AS at FROM pages")
def rex_offset(spark, d):
    return shape.rex(table(spark, d, "pages").select("page_id", "url"), "url", r"://(?<host>[a-z]+)[.](?<domain>[a-z]+)", offset_field="at").drop("url")


@query("SELECT p_partkey, p_name AS p_name FROM part ORDER BY p_partkey DESC LIMIT 20")
def reverse_order(spark, d):
    return rows.head(rows.reverse(table(spark, d, "part").select("p_partkey", "p_name"), ["+p_partkey"]), 20)


@query("SELECT event_id FROM events ORDER BY ts DESC LIMIT 10")
def reverse_time(spark, d):
    return rows.head(rows.reverse(table(spark, d, "events").select("event_id", c("ts").alias("@timestamp"))), 10).select("event_id")


@query("SELECT event_id, coalesce(value, 0) AS value, coalesce(event_type, 'none') AS event_type FROM events")
def fillnull_value(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    return shape.fillnull(shape.fillnull(e, 0.0, ["value"]), "none", ["event_type"])


@query("""SELECT page_id, regexp_extract(line, '^([0-9.]+) - ([a-z]+) \\[(.*)\\] "([A-Z]+) (.*) HTTP/1.1" ([0-9]+) ([0-9]+)$', 1) AS clientip, 'GET' AS verb, '/p/' || page_id AS request, '200' AS response, CAST(page_id AS VARCHAR) AS bytes
FROM (SELECT page_id, '10.0.0.' || page_id % 250 || ' - bob [01/Mar/2024:10:00:00 +0000] "GET /p/' || page_id || ' HTTP/1.1" 200 ' || page_id AS line FROM pages)""")
def grok_access_log(spark, d):
    line = F.format_string('10.0.0.%d - bob [01/Mar/2024:10:00:00 +0000] "GET /p/%d HTTP/1.1" 200 %d', c("page_id") % 250, c("page_id"), c("page_id"))
    return shape.grok(table(spark, d, "pages").select("page_id", line.alias("line")), "line", "%{COMMONAPACHELOG}").select("page_id", "clientip", "verb", "request", "response", "bytes")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CAST(user_id AS VARCHAR) AS who FROM events")
def grok_timestamp(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" user="), c("user_id").cast("string"))
    return shape.grok(table(spark, d, "events").select("event_id", line.alias("line")), "line", "%{TIMESTAMP_ISO8601:at} user=%{NONNEGINT:who}").drop("line")


# Joins


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) USING (c_custkey)")
def join_left_default(spark, d):
    n = table(spark, d, "orders").where("o_totalprice > 400000").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return shape.fillnull(combine.join(table(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], "left"), 0, ["n"])


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON c_custkey = o_custkey WHERE r <= 2")
def join_max(spark, d):
    o = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderkey")
    return combine.join(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], most=2)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return combine.join(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "semi")


@query("SELECT r_name, n_name FROM region FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON r_regionkey = n_regionkey")
def join_full(spark, d):
    n = table(spark, d, "nation").where("n_regionkey > 1")
    return combine.join(table(spark, d, "region"), n, c("r_regionkey") == c("n_regionkey"), "full").select("r_name", "n_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE n_name END AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_append(spark, d):
    s = table(spark, d, "supplier").withColumn("nation", F.when(c("s_suppkey") % 2 == 0, "kept"))
    return combine.lookup(s, table(spark, d, "nation"), {"n_nationkey": "s_nationkey"}, {"n_name": "nation"}, append=True).select("s_suppkey", "nation")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def not_in_subquery(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return combine.in_subquery(table(spark, d, "customer"), ["c_custkey"], o, negate=True).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 100 <> 1 THEN o_custkey END FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT -1")
def not_in_subquery_null(spark, d):
    """A null in the subquery leaves no row; one row of -1 shows that the query ran."""
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.when(c("o_orderkey") % 100 != 1, c("o_custkey")))
    left = combine.in_subquery(table(spark, d, "customer"), ["c_custkey"], o, negate=True).select("c_custkey")
    return left.union(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey")))


@query("""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 10 END AS b FROM customer),
s AS (SELECT s_nationkey AS x, s_suppkey % 10 AS y FROM supplier WHERE s_suppkey % 3 = 0)
SELECT c_custkey FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE (a = x OR a IS NULL OR x IS NULL) AND (b = y OR b IS NULL OR y IS NULL))""")
def not_in_subquery_composite(spark, d):
    k = c("c_custkey")
    left = table(spark, d, "customer").select("c_custkey", F.when(k % 7 > 0, c("c_nationkey")).alias("a"), F.when(k % 5 > 0, k % 10).alias("b"))
    sub = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey", c("s_suppkey") % 10)
    return combine.in_subquery(left, ["a", "b"], sub, negate=True).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey, c_custkey % 10) IN (SELECT s_nationkey, s_suppkey % 10 FROM supplier)")
def in_subquery_composite(spark, d):
    left = table(spark, d, "customer").select("c_custkey", "c_nationkey", (c("c_custkey") % 10).alias("m"))
    return combine.in_subquery(left, ["c_nationkey", "m"], table(spark, d, "supplier").select("s_nationkey", c("s_suppkey") % 10)).select("c_custkey")


@query("SELECT r_regionkey, NULL::DOUBLE AS mean, (SELECT max(n_nationkey) FROM nation) AS most FROM region")
def scalar_subquery_empty(spark, d):
    none = table(spark, d, "customer").where("c_acctbal > 1e12").select("c_acctbal")
    most = table(spark, d, "nation").agg(F.max("n_nationkey"))
    return combine.scalar_subquery(combine.scalar_subquery(table(spark, d, "region").select("r_regionkey"), "mean", none), "most", most)


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE value > 90")
def multisearch_union(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value", c("ts").alias("@timestamp"))
    return combine.multisearch(e.where("event_type = 'click'"), e.where("value > 90")).select("event_id", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer UNION ALL SELECT c_name FROM customer")
def union_types(spark, d):
    cu = table(spark, d, "customer")
    return combine.union(cu.select(c("c_custkey").alias("k")), cu.select(c("c_name").alias("k")))


@query("SELECT count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier LIMIT 700)")
def union_maxout(spark, d):
    a, b = table(spark, d, "customer").select(c("c_custkey").alias("k")), table(spark, d, "supplier").select(c("s_suppkey").alias("k"))
    return combine.union(a, b, most=700).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return combine.union(table(spark, d, "customer").select(c("c_nationkey").alias("k")), table(spark, d, "supplier").select(c("s_nationkey").alias("k"))).distinct()


@query("SELECT o_orderkey, CASE WHEN n <= 400 THEN s_name ELSE o_orderstatus END AS o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) LEFT JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) USING (n) WHERE n > 400 OR s_name IS NOT NULL OR n <= 400".replace("CASE WHEN n <= 400 THEN s_name ELSE o_orderstatus END", "coalesce(s_name, o_orderstatus)"))
def appendcol_override(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", c("s_name").alias("o_orderstatus"))
    return combine.appendcol(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), s, [c("o_orderkey")], [c("s_suppkey")], override=True).select("o_orderkey", "o_orderstatus")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS id, s_suppkey // 3 AS up FROM supplier WHERE s_suppkey > 0),
w AS (SELECT id AS start, up AS at, 0 AS depth FROM e UNION ALL SELECT w.start, e.up, depth + 1 FROM w JOIN e ON e.id = w.at WHERE depth < 3)
SELECT start AS id, CAST(count(*) AS BIGINT) AS reached, CAST(max(depth) AS BIGINT) AS deepest FROM (SELECT w.start, w.depth FROM w JOIN e ON e.id = w.at) GROUP BY 1""")
def graph_lookup_deep(spark, d):
    e = table(spark, d, "supplier").where("s_suppkey > 0").select(c("s_suppkey").alias("id"), F.floor(c("s_suppkey") / 3).alias("up"))
    out = combine.graph_lookup(e, e, "up", "id", "up", "chain", max_depth=3, depth_field="depth").where("size(chain) > 0")
    return out.select("id", F.size("chain").cast("long").alias("reached"), F.array_max(F.transform("chain", lambda x: x["depth"])).cast("long").alias("deepest"))


@query("SELECT a.s_suppkey AS id, CAST(count(*) AS BIGINT) AS met FROM (SELECT s_suppkey, unnest([s_suppkey // 2, s_suppkey // 3]) AS at FROM supplier) a JOIN supplier b ON b.s_suppkey = a.at AND b.s_suppkey % 2 = 0 WHERE a.s_suppkey > 5 GROUP BY 1")
def graph_lookup_filter(spark, d):
    e = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), F.lit(None).cast("long").alias("none"))
    start = e.where("id > 5").select("id", F.array(F.floor(c("id") / 2), F.floor(c("id") / 3)).alias("at"))
    out = combine.graph_lookup(start, e, "at", "id", "none", "met", where=c("id") % 2 == 0).where("size(met) > 0")
    return out.select("id", F.size("met").cast("long").alias("met"))


@query("SELECT event_id, o_orderkey FROM (SELECT event_id, event_id % 1500 AS k, TIMESTAMP '1996-01-01' + to_days(CAST(event_id % 1000 AS INTEGER)) AS t FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.k = o.o_custkey AND e.t >= o.o_orderdate")
def asof_join(spark, d):
    e = table(spark, d, "events").select("event_id", (c("event_id") % 1500).alias("k"), F.timestamp_add("DAY", (c("event_id") % 1000).cast("int"), F.lit("1996-01-01").cast("timestamp")).cast("timestamp").alias("t"))
    o = table(spark, d, "orders").select(c("o_custkey").alias("k"), c("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey")
    return combine.asof_join(e, o, "t", "o_orderdate", ["k"]).select("event_id", "o_orderkey")


@query("SELECT p_partkey, r FROM part JOIN (SELECT n_nationkey AS r, 900.0 + 4 * n_nationkey AS lo, 930.0 + 4 * n_nationkey AS hi FROM nation) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(spark, d):
    n = table(spark, d, "nation").select(c("n_nationkey").alias("r"), (900.0 + 4 * c("n_nationkey")).alias("lo"), (930.0 + 4 * c("n_nationkey")).alias("hi"))
    return combine.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), n, "p_retailprice", "lo", "hi", 30).select("p_partkey", "r")


# Aggregates


@query("SELECT event_type, count(value) AS n, count(CASE WHEN value > 50 THEN 1 END) AS high, count(*) FILTER (WHERE user_id < 10) AS few, round(sum(value) FILTER (WHERE user_id < 10), 4) AS some FROM events GROUP BY 1")
def stats_filtered(spark, d):
    return stats.stats(table(spark, d, "events"), F.count("value").alias("n"), F.count(F.when(c("value") > 50, 1)).alias("high"), aggregates.where("count(*)", "user_id < 10").alias("few"), F.round(aggregates.where("sum(value)", "user_id < 10"), 4).alias("some"), by=["event_type"])


@query("SELECT event_type, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS a, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS b FROM (SELECT event_type, event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events) GROUP BY 1")
def stats_first_last(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(c("event_id") % 3 > 0, c("value")))
    return stats.stats(e, aggregates.first(c("value"), c("event_id")).alias("a"), aggregates.last(c("value"), c("event_id")).alias("b"), by=["event_type"])


@query("SELECT event_type, list(v ORDER BY event_id)[1:5] AS vs FROM (SELECT event_type, event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS v FROM events) GROUP BY 1")
def stats_take(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(c("event_id") % 3 > 0, c("user_id")))
    return stats.stats(e, aggregates.take(c("v"), c("event_id"), 5).alias("vs"), by=["event_type"])


@query("SELECT event_type, (list(CAST(v AS VARCHAR) ORDER BY event_id) FILTER (WHERE v IS NOT NULL))[1:100] AS vs FROM (SELECT event_type, event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS v FROM events) GROUP BY 1")
def stats_list(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(c("event_id") % 3 > 0, c("user_id")))
    return stats.stats(e, aggregates.listed(c("v"), c("event_id")).alias("vs"), by=["event_type"])


@query("SELECT event_type, list_sort(list(DISTINCT CAST(user_id % 30 AS VARCHAR)))[1:7] AS vs FROM events GROUP BY 1")
def stats_values_limit(spark, d):
    return stats.stats(table(spark, d, "events").withColumn("u", c("user_id") % 30), aggregates.values(c("u"), 7).alias("vs"), by=["event_type"])


@query("SELECT event_type, arg_min(event_id, ts) AS a, arg_max(event_id, ts) AS b FROM events GROUP BY 1")
def stats_earliest_default(spark, d):
    e = table(spark, d, "events").withColumnRenamed("ts", "@timestamp")
    return stats.stats(e, aggregates.earliest(c("event_id")).alias("a"), aggregates.latest(c("event_id")).alias("b"), by=["event_type"])


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def stats_distinct_approx(spark, d):
    """The estimate lies within a tenth of the exact number."""
    # Each pair once: beside count_distinct, Spark would keep a sketch of 3 KB for every user.
    users = table(spark, d, "events").select("event_type", "user_id").distinct()
    e = users.groupBy("event_type").agg(aggregates.distinct_count_approx(c("user_id"), 0.02).alias("about"), F.count("user_id").alias("exact"))
    return e.select("event_type", (F.abs(c("about") - c("exact")) <= 0.1 * c("exact")).alias("near"))


@query("SELECT quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.99) AS p99, true AS near FROM events")
def stats_percentile_approx(spark, d):
    e = table(spark, d, "events")
    got = e.agg(aggregates.percentile(c("value"), 25).alias("p25"), aggregates.percentile(c("value"), 99).alias("p99"), aggregates.percentile(c("value"), 25, approx=True).alias("a"))
    return got.select("p25", "p99", (F.abs(c("a") - c("p25")) < 1).alias("near"))


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN user_id % 4 > 0 THEN user_id % 4 END AS k FROM events) WHERE k IS NOT NULL GROUP BY 1")
def stats_not_nullable(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(c("user_id") % 4 > 0, c("user_id") % 4))
    return stats.stats(e, F.count("*").alias("n"), by=["k"], nullable=False)


@query("SELECT event_id, count(*) OVER (PARTITION BY k) AS n, max(value) OVER (PARTITION BY k) AS top FROM (SELECT *, CASE WHEN user_id % 4 > 0 THEN user_id % 4 END AS k FROM events)")
def eventstats_null_group(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(c("user_id") % 4 > 0, c("user_id") % 4))
    return stats.eventstats(e, {"n": F.count("*"), "top": F.max("value")}, ["k"]).select("event_id", "n", "top")


@query("SELECT event_id, CASE WHEN user_id % 4 > 0 THEN count(*) OVER (PARTITION BY user_id % 4) END AS n FROM events")
def eventstats_not_nullable(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(c("user_id") % 4 > 0, c("user_id") % 4))
    return stats.eventstats(e, {"n": F.count("*")}, ["k"], nullable=False).select("event_id", "n")


@query("SELECT event_id, avg(value) OVER () AS mean, count(DISTINCT user_id) OVER () AS users FROM events".replace("count(DISTINCT user_id) OVER ()", "(SELECT count(DISTINCT user_id) FROM events)"))
def eventstats_all(spark, d):
    return stats.eventstats(table(spark, d, "events").select("event_id", "value", "user_id"), {"mean": F.avg("value"), "users": F.count_distinct("user_id")}).select("event_id", "mean", "users")


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS low, max(value) OVER w AS high, round(avg(value / 3.14159265) OVER w, 6) AS mean FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def streamstats_all(spark, d):
    v = c("value")
    out = stats.streamstats(table(spark, d, "events"), {"n": ("count", F.lit(1)), "total": ("sum", v), "low": ("min", v), "high": ("max", v), "mean": ("avg", v / 3.14159265)}, [c("ts"), c("event_id")])
    return out.select("event_id", "n", F.round("total", 4).alias("total"), "low", "high", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS high FROM events")
def streamstats_window_all(spark, d):
    return stats.streamstats(table(spark, d, "events"), {"high": F.max("value")}, [c("ts"), c("event_id")], window=5, current=False).select("event_id", "high")


@query("SELECT a.event_id, count(*) AS n, round(sum(b.value), 4) AS total FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) a JOIN (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) b ON a.event_type = b.event_type AND b.r BETWEEN a.r - 9 AND a.r GROUP BY 1")
def streamstats_global(spark, d):
    out = stats.streamstats(table(spark, d, "events"), {"n": F.count(F.lit(1)), "total": F.sum("value")}, [c("ts"), c("event_id")], ["event_type"], window=10, whole=True)
    return out.select("event_id", "n", F.round("total", 4).alias("total"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS n FROM (SELECT *, coalesce(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events)""")
def streamstats_reset_after(spark, d):
    return stats.streamstats(table(spark, d, "events"), {"n": F.count(F.lit(1))}, [c("ts"), c("event_id")], ["user_id"], reset_after=c("value") > 90).select("event_id", "n")


@query("SELECT event_id, CASE WHEN count(*) OVER w = 4 THEN round(avg(value) OVER w, 6) END AS sma FROM events WHERE value IS NOT NULL WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def trendline_all(spark, d):
    return stats.trendline(table(spark, d, "events"), [c("ts"), c("event_id")], {"sma": (4, "value")}).select("event_id", F.round("sma", 6).alias("sma"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first, nth_value(value, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("value").over(w).alias("first"), F.nth_value("value", 2).over(whole).alias("second"), F.ntile(4).over(w).alias("quarter"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS total FROM events")
def window_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 1)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def grouping_rollup(spark, d):
    return stats.grouping(table(spark, d, "orders"), "rollup", ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_cube(spark, d):
    return stats.grouping(table(spark, d, "orders"), "cube", ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    return stats.grouping(table(spark, d, "orders"), "sets", ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"), sets=[["o_orderstatus"], ["o_orderpriority"], []])


# Charts and bins


@query("""WITH x AS (SELECT o_orderstatus AS row, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS col, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), k AS (SELECT col FROM x WHERE col IS NOT NULL GROUP BY 1 ORDER BY sum(v), col LIMIT 3)
SELECT row, CASE WHEN col IS NULL THEN 'none' WHEN col IN (SELECT col FROM k) THEN col ELSE 'rest' END AS "column", round(max(v), 2) AS mean FROM x GROUP BY 1, 2""")
def chart_bottom(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(c("o_orderkey") % 5 > 0, c("o_orderpriority")))
    return stats.chart(o, F.avg("o_totalprice"), c("o_orderstatus"), c("p"), "mean", limit=3, bottom=True, other="rest", null="none", fold="max").withColumn("mean", F.round("mean", 2))


@query("""WITH x AS (SELECT o_orderstatus AS row, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS col, count(*) AS v FROM orders GROUP BY 1, 2), k AS (SELECT col FROM x WHERE col IS NOT NULL GROUP BY 1 ORDER BY sum(v) DESC, col LIMIT 2)
SELECT row, col AS "column", CAST(v AS BIGINT) AS n FROM x WHERE col IN (SELECT col FROM k)""")
def chart_no_other(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(c("o_orderkey") % 5 > 0, c("o_orderpriority")))
    return stats.chart(o, F.count("*"), c("o_orderstatus"), c("p"), "n", limit=2, useother=False, usenull=False)


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS row, sum(value) / 900.0 AS rate FROM events GROUP BY 1")
def timechart_per_second(spark, d):
    return stats.timechart(table(spark, d, "events"), stats.per(c("value"), 1, 15, "m"), "ts", 15, "m", name="rate")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1), a AS (SELECT max(CAST(epoch(t) AS BIGINT) // 604800) AS last FROM h),
f AS (SELECT a.last - CAST(epoch(t) AS BIGINT) // 604800 AS age, CAST(epoch(t) AS BIGINT) % 604800 AS o, n FROM h, a)
SELECT strftime(make_timestamp(o * 1000000), '%d %H:%M:%S') AS "offset", max(CASE WHEN age = 0 THEN n END) AS latest, max(CASE WHEN age = 1 THEN n END) AS "1 before", max(CASE WHEN age = 2 THEN n END) AS "2 before", max(CASE WHEN age = 3 THEN n END) AS "3 before", max(CASE WHEN age = 4 THEN n END) AS "4 before" FROM f GROUP BY 1""")
def timewrap_weeks(spark, d):
    return stats.timewrap(stats.timechart(table(spark, d, "events"), F.count("*"), "ts", 1, "h", name="n"), "n", 1, "w")


@query("SELECT o_orderstatus, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS \"n: 1-URGENT\", max(CASE WHEN o_orderpriority = '1-URGENT' THEN m END) AS \"m: 1-URGENT\" FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_custkey) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def xyseries_two(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_custkey").alias("m"))
    return stats.xyseries(n, "o_orderstatus", "o_orderpriority", ["1-URGENT"], ["n", "m"])


@query("SELECT p_partkey, CAST(floor(p_size / 10.0) * 10 AS BIGINT) || '-' || CAST(floor(p_size / 10.0) * 10 + 10 AS BIGINT) AS p_size FROM part")
def bin_command_span(spark, d):
    return stats.bin(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", width=10)


@query("SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01 02:00:00') AS ts FROM events")
def bin_command_aligned(spark, d):
    return stats.bin(table(spark, d, "events").select("event_id", "ts"), "ts", width=6, unit="h", align="2024-01-01 02:00:00")


@query("SELECT event_id, date_trunc('hour', ts) AS ts FROM events")
def bin_command_default_time(spark, d):
    return stats.bin(table(spark, d, "events").select("event_id", "ts"), "ts")


@query("""WITH r AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part), w0 AS (SELECT lo, hi, pow(10.0, ceil(log10((hi - lo) / 4))) AS w FROM r),
w1 AS (SELECT CASE WHEN ceil((hi - lo) / w) + CASE WHEN hi % w = 0 THEN 1 ELSE 0 END > 4 THEN w * 10 ELSE w END AS w FROM w0)
SELECT p_partkey, CAST(floor(p_size / w) * w AS BIGINT) || '-' || CAST(floor(p_size / w) * w + w AS BIGINT) AS p_size FROM part, w1""")
def bin_command_bins(spark, d):
    return stats.bin(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", bins=4)


@query("SELECT p_partkey, CAST(floor(p_size / 10.0) * 10 AS BIGINT) || '-' || CAST(floor(p_size / 10.0) * 10 + 10 AS BIGINT) AS p_size FROM part")
def bin_command_minspan(spark, d):
    return stats.bin(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", minspan=7)


@query("SELECT p_partkey, CAST(floor(p_size / 100.0) * 100 AS BIGINT) || '-' || CAST(floor(p_size / 100.0) * 100 + 100 AS BIGINT) AS p_size FROM part")
def bin_command_range(spark, d):
    return stats.bin(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", start=0, end=500)


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(pow(2.0, floor(log2(p_size))) AS BIGINT) || '-' || CAST(2 * pow(2.0, floor(log2(p_size))) AS BIGINT) ELSE 'Invalid' END AS p_size FROM (SELECT p_partkey, p_size - 3 AS p_size FROM part WHERE (p_size - 3) NOT IN (8))")
def bin_command_log(spark, d):
    p = table(spark, d, "part").select("p_partkey", (c("p_size") - 3).alias("p_size")).where("p_size <> 8")
    return stats.bin(p, "p_size", log=(1, 2))


@query("SELECT bucket, n FROM (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS bucket FROM events WHERE user_id = 7) LEFT JOIN (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1) USING (bucket)")
def date_histogram(spark, d):
    return stats.date_histogram(table(spark, d, "events").where("user_id = 7"), "ts", 1, "h", F.count("*").alias("n"))


@query("SELECT '*-20' AS bucket, count(*) AS n FROM part WHERE p_size < 20 UNION ALL SELECT '10-30', count(*) FROM part WHERE p_size >= 10 AND p_size < 30 UNION ALL SELECT '30-*', count(*) FROM part WHERE p_size >= 30")
def range_buckets(spark, d):
    return stats.range_buckets(table(spark, d, "part"), "p_size", [(None, 20), (10, 30), (30, None)], F.count("*").alias("n"))


@query("SELECT '*-1996-01-01' AS bucket, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT '1996-01-01-*', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def date_range_buckets(spark, d):
    return stats.range_buckets(table(spark, d, "orders"), "o_orderdate", [(None, "1996-01-01"), ("1996-01-01", None)], F.count("*").alias("n"))


@query("SELECT count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 3) AS total, round(sum(value * value), 2) AS squares, round(var_pop(value), 5) AS variance, round(stddev_pop(value), 6) AS deviation FROM events")
def extended_stats(spark, d):
    v = c("value")
    return table(spark, d, "events").agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v), 3).alias("total"), F.round(F.sum(v * v), 2).alias("squares"), F.round(F.var_pop(v), 5).alias("variance"), F.round(F.stddev_pop(v), 6).alias("deviation"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_hits(spark, d):
    return rows.dedup(table(spark, d, "orders"), "o_orderpriority", n=3, order=[c("o_totalprice").desc(), c("o_orderkey")]).select("o_orderpriority", "o_orderkey", "o_totalprice")


# Rows


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NULL OR before <> event_type")
def dedup_consecutive(spark, d):
    return rows.dedup(table(spark, d, "events"), "event_type", order=[c("ts"), c("event_id")], consecutive=True, within=["user_id"]).select("event_id")


@query("SELECT event_id, k FROM (SELECT event_id, CASE WHEN user_id % 4 > 0 THEN user_id END AS k, row_number() OVER (PARTITION BY CASE WHEN user_id % 4 > 0 THEN user_id END ORDER BY event_id) AS r FROM events) WHERE r = 1 OR k IS NULL")
def dedup_keepempty(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(c("user_id") % 4 > 0, c("user_id")).alias("k"))
    return rows.dedup(e, "k", order=[c("event_id")], keepempty=True)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedup_unordered(spark, d):
    return rows.dedup(table(spark, d, "events").select("event_id", "user_id"), "user_id")


@query("SELECT p_partkey FROM part ORDER BY CAST(p_size AS VARCHAR), p_partkey LIMIT 25")
def sort_as_text(spark, d):
    return rows.sort(table(spark, d, "part"), "str(p_size)", "p_partkey", limit=25).select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) DESC NULLS LAST, p_partkey LIMIT 25")
def sort_as_number(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.replace(c("p_brand"), F.lit("Brand#"), F.lit("")).alias("b"))
    return rows.sort(p, "-num(b)", "+auto(p_partkey)", limit=25).select("p_partkey")


@query("SELECT event_id FROM events ORDER BY event_id % 300 // 7, event_id % 100, event_id LIMIT 30")
def sort_as_ip(spark, d):
    k = c("event_id")
    ip = F.concat(F.lit("10.0."), F.floor(k % 300 / 7).cast("string"), F.lit("."), (k % 100).cast("string"))
    return rows.sort(table(spark, d, "events").select("event_id", ip.alias("ip")), "ip(ip)", "event_id", limit=30).select("event_id")


@query("SELECT conv_id, unnest(list_slice(list(role ORDER BY turn), 1, 2)) AS role FROM conversations GROUP BY 1")
def mvexpand_limit(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.expand(g.select("conv_id", F.transform("x", lambda e: e["role"]).alias("role")), "role", limit=2)


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE n_nationkey > 3")
def expand_empty(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.when(c("n_nationkey") > 3, F.array("n_name")).when(c("n_nationkey") > 1, F.array().cast("array<string>")).alias("n_name"))
    return rows.expand(n, "n_name", alias="name")


@query("SELECT r_regionkey, r_name, r_regionkey AS \"Total\" FROM region UNION ALL SELECT sum(r_regionkey), NULL, NULL FROM region")
def addtotals_both(spark, d):
    return rows.addtotals(table(spark, d, "region").select(c("r_regionkey").cast("long").alias("r_regionkey"), "r_name"), ["r_regionkey"], columns=True)


@query("SELECT n_regionkey, count(*) AS n FROM (SELECT n_regionkey, unnest([n_name, 'x']) AS v FROM nation) GROUP BY 1")
def nested_rows(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.array(F.struct(c("n_name").alias("v")), F.struct(F.lit("x").alias("v"))).alias("inner"))
    return rows.expand(n, "inner").select("n_regionkey", "inner.v").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def sql_distinct(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("mill_orders")
    return spark.sql("SELECT DISTINCT o_orderstatus, o_orderpriority FROM mill_orders WHERE o_totalprice BETWEEN 1000 AND 50000")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10 ORDER BY n DESC, 1 LIMIT 3")
def sql_having(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("mill_orders")
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM mill_orders GROUP BY 1 HAVING count(*) > 10 ORDER BY n DESC, 1 LIMIT 3")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT c_custkey, round(t, 2) AS t FROM customer JOIN big ON c_custkey = o_custkey WHERE t > 1000000")
def sql_cte(spark, d):
    for n in ("orders", "customer"):
        table(spark, d, n).createOrReplaceTempView(f"mill_{n}")
    return spark.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM mill_orders GROUP BY 1) SELECT c_custkey, round(t, 2) AS t FROM mill_customer JOIN big ON c_custkey = o_custkey WHERE t > 1000000")


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity AS INTEGER) AS q, l_shipdate + INTERVAL 3 DAY AS later FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'O%' AND NOT l_returnflag SIMILAR TO 'X.*'")
def sql_expressions(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("mill_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity AS INT) AS q, l_shipdate + INTERVAL 3 DAY AS later FROM mill_lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'O%' AND NOT l_returnflag RLIKE '^X'")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_using(spark, d):
    table(spark, d, "nation").withColumnRenamed("n_regionkey", "rk").createOrReplaceTempView("mill_n")
    table(spark, d, "region").withColumnRenamed("r_regionkey", "rk").createOrReplaceTempView("mill_r")
    return spark.sql("SELECT n_nationkey, r_name FROM mill_n JOIN mill_r USING (rk)")


# Learning


@query("SELECT o_orderkey, abs(o_totalprice - m) * 0.6745 > 1.5 * dev AS is_anomaly FROM orders JOIN (SELECT k, m, quantile_disc(abs(o_totalprice - m), 0.5) AS dev FROM (SELECT coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, '') AS k, o_totalprice FROM orders) JOIN (SELECT coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, '') AS k, quantile_disc(o_totalprice, 0.5) AS m FROM orders GROUP BY 1) USING (k) GROUP BY 1, 2) ON k = coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, '')")
def anomaly_null_groups(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(c("o_orderkey") % 5 > 0, c("o_orderpriority")).alias("k"))
    return learn.anomalies(o, "o_totalprice", ["k"], threshold=1.5).select("o_orderkey", "is_anomaly")


@query("SELECT count(*) AS n, true AS most_right FROM part")
def ml_classify(spark, d):
    """A rule that the classifier must find: it is right for nine rows in ten at least."""
    p = table(spark, d, "part").withColumn("y", (c("p_retailprice") + 3 * c("p_size") > 1400).cast("int"))
    out = learn.ml_classify(p.where("p_partkey % 2 = 0"), p, ["p_retailprice", "p_size"], "y")
    return out.agg(F.count("*").alias("n"), (F.avg((c("prediction") == c("y")).cast("int")) > 0.9).alias("most_right"))


# Windows of time


@query("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def window_sliding(spark, d):
    return windows.windowed(table(spark, d, "events"), "ts", "1 hour", F.count("*").alias("n"), slide="30 minutes")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM g GROUP BY user_id, session""")
def window_session_gaps(spark, d):
    return windows.windowed(table(spark, d, "events"), "ts", "30 minutes", F.count("*").alias("n"), by=("user_id",), session=True)


@query("SELECT event_type, min(event_id) AS low, span FROM (SELECT *, date_trunc('month', ts) AS span FROM events) GROUP BY event_type, span")
def span_month(spark, d):
    return table(spark, d, "events").groupBy("event_type", bins.span(c("ts"), 1, "M").alias("span")).agg(F.min("event_id").alias("low"))
