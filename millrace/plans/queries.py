"""The registered queries of the library and their DuckDB twins, one for each operator or family."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.functions import bins, convert, json_edit, scalar, times
from millrace.operators import combine, learn, rows, shape, stats, templates
from millrace.plans.registry import ORACLES, QUERIES, query
from millrace.session import table
from millrace.sources import tables
from millrace.streaming import windows
__all__ = ["ORACLES", "QUERIES"]

c = F.col

# TPC-H shapes


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_q1(spark, d):
    li = table(spark, d, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = c("l_extendedprice") * (1 - c("l_discount"))
    return stats.stats(
        li, F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(net), 2).alias("sum_disc_price"), F.round(F.sum(net * (1 + c("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"), by=["l_returnflag", "l_linestatus"],
    )


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_q3(spark, d):
    cu, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    day = F.lit("1995-03-15").cast("timestamp")
    j = cu.where("c_mktsegment = 'BUILDING'").join(o.where(c("o_orderdate") < day), c("c_custkey") == c("o_custkey")).join(li.where(c("l_shipdate") > day), c("l_orderkey") == c("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue")).orderBy(c("revenue").desc(), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) GROUP BY 1")
def tpch_q4_exists(spark, d):
    o = table(spark, d, "orders").where(c("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    li = table(spark, d, "lineitem").where("l_discount > 0.05")
    return combine.exists_subquery(o, li, c("l_orderkey") == c("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def tpch_q5(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    nations = t["nation"].join(t["region"].where("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    sup = t["supplier"].join(nations, c("s_nationkey") == c("n_nationkey"))
    j = t["lineitem"].join(sup, c("l_suppkey") == c("s_suppkey")).join(t["orders"], c("l_orderkey") == c("o_orderkey")).join(t["customer"], (c("c_custkey") == c("o_custkey")) & (c("c_nationkey") == c("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate >= timestamp'1994-01-01' AND l_shipdate < timestamp'1995-01-01' AND l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24")
    return li.agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("revenue"))


@query("""SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY 1, 2, 4 ORDER BY revenue DESC, c_custkey LIMIT 20""")
def tpch_q10(spark, d):
    cu, o, li, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation"))
    j = li.where("l_returnflag = 'R'").join(o, c("l_orderkey") == c("o_orderkey")).join(cu, c("c_custkey") == c("o_custkey")).join(n, c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("c_custkey", "c_name", "n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue")).orderBy(c("revenue").desc(), "c_custkey").limit(20)


@query("SELECT o_orderpriority, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS other FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def tpch_q12_case(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.sum(F.when(c("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.sum(F.when(c("l_returnflag") != "R", 1).otherwise(0)).alias("other"))


@query("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1")
def tpch_q13(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count")).groupBy("c_count").agg(F.count("*").alias("custdist"))


@query("SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey")
def tpch_q14(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    net = c("l_extendedprice") * (1 - c("l_discount"))
    return j.agg(F.round(100.0 * F.sum(F.when(c("p_type").like("PROMO%"), net).otherwise(0)) / F.sum(net), 6).alias("promo_revenue"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200)")
def tpch_q18_in(spark, d):
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 200").select("l_orderkey")
    return combine.in_subquery(table(spark, d, "orders"), ["o_orderkey"], big).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def tpch_q22(spark, d):
    cu = table(spark, d, "customer")
    out = combine.scalar_subquery(cu, "mean", cu.where("c_acctbal > 0").agg(F.avg("c_acctbal"))).where("c_acctbal > mean")
    big = table(spark, d, "orders").where("o_totalprice > 400000")
    return combine.exists_subquery(out, big, c("o_custkey") == c("c_custkey"), negate=True).select("c_custkey", "c_acctbal")


# Shaping


@query("SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
def rename_wildcard(spark, d):
    return shape.rename(table(spark, d, "region"), {"r_*key": "*_key", "r_name": "region_name"})


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def fields_where(spark, d):
    return shape.fields(table(spark, d, "customer").where("c_acctbal < 0"), "c_custk*", "c_name", "c_name")


@query("SELECT p_partkey, p_name, p_type, p_size FROM part")
def fields_exclude(spark, d):
    return shape.fields(table(spark, d, "part"), "p_brand", "p_retail*", exclude=True)


@query("SELECT event_id, value * 2 AS double_value, value * 2 + 1 AS more, CASE WHEN value * 2 > 100 THEN 'high' ELSE 'low' END AS level FROM events")
def eval_chain(spark, d):
    return shape.evaluate(table(spark, d, "events"), double_value="value * 2", more="double_value + 1", level="if(double_value > 100, 'high', 'low')").select("event_id", "double_value", "more", "level")


@query("SELECT p_partkey, concat('#', CAST(p_size AS VARCHAR), ' units') AS size_text FROM part")
def fieldformat_affixes(spark, d):
    return shape.fieldformat(table(spark, d, "part"), "size_text", c("p_size"), "#", " units").select("p_partkey", "size_text")


@query("SELECT l_orderkey, l_linenumber, l_discount * 100 AS l_discount, l_tax * 100 AS l_tax FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem)")
def foreach_columns(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return shape.foreach(shape.foreach(df, "l_disc*", "`<<FIELD>>` * 100"), "l_ta*", "`<<FIELD>>` * 100")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def fillnull_using(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return shape.fillnull(j, using={"quality": -1, "toxic": 0})


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'first ' || substr(o_orderpriority, 3) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def replace_wildcard(spark, d):
    return shape.replace(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), {"1-*": "first *"}, ["o_orderpriority"])


@query("SELECT p_partkey, regexp_extract(p_brand, '^Brand#([0-9])([0-9])$', 1) AS maker, regexp_extract(p_brand, '^Brand#([0-9])([0-9])$', 2) AS line FROM part")
def parse_groups(spark, d):
    return shape.parse(table(spark, d, "part"), "p_brand", r"Brand#(?<maker>[0-9])(?<line>[0-9])").select("p_partkey", "maker", "line")


@query("SELECT page_id, regexp_extract(url, '([a-z]+)://([^/]+)', 1) AS scheme, regexp_extract(url, '([a-z]+)://([^/]+)', 2) AS host FROM pages")
def grok_url(spark, d):
    return shape.grok(table(spark, d, "pages"), "url", r"%{PROTO:scheme}://%{HOST:host}", {"PROTO": "[a-z]+", "HOST": "[^/]+"}).select("page_id", "scheme", "host")


@query("SELECT page_id, regexp_extract_all(url, '[a-z]+')[1:3] AS w FROM pages")
def rex_multi(spark, d):
    return shape.rex(table(spark, d, "pages"), "url", "(?<w>[a-z]+)", max_match=3).select("page_id", "w")


@query("SELECT page_id, regexp_replace(url, '[0-9]+', 'N', 'g') AS url FROM pages")
def rex_sed(spark, d):
    return shape.sed(table(spark, d, "pages").select("page_id", "url"), "url", "s/[0-9]+/N/g")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https')")
def regex_filter(spark, d):
    return shape.regex(table(spark, d, "pages").select("page_id", "url"), "url", "^https", negate=True)


@query("SELECT regexp_replace(url, '[a-zA-Z0-9]+', '<*>', 'g') AS patterns_field, count(*) AS pattern_count, min(url) AS sample_log FROM pages GROUP BY 1")
def patterns_simple(spark, d):
    return shape.patterns(table(spark, d, "pages"), "url", aggregate=True).drop("sample_logs")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def spath_props(spark, d):
    return shape.spath(table(spark, d, "events"), "props", "k").select("event_id", "k")


@query("SELECT s.n_nationkey AS n_nationkey, s.n_name AS n_name FROM (SELECT n_nationkey, n_name FROM nation) s")
def flatten_struct(spark, d):
    packed = table(spark, d, "nation").select(F.struct("n_nationkey", "n_name").alias("s"))
    return shape.flatten(packed, "s").drop("s")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * 1024 AS kb, CAST(p_size AS DOUBLE) AS plain, CAST(p_size AS DOUBLE) AS units FROM part")
def convert_units(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(c("p_size").cast("string"), F.lit("m")).alias("a"), F.concat(c("p_size").cast("string"), F.lit(" pcs")).alias("b"))
    return p.select("p_partkey", convert.memk(c("a")).alias("kb"), convert.num(c("b")).alias("plain"), convert.rmunit(c("b")).alias("units"))


@query()
def patterns_templates(spark, d):
    return templates.counted(table(spark, d, "pages").select("url"), "url")


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"seen\":[1,2]}' AS props FROM events")
def json_edits(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", json_edit.json_extend(json_edit.json_set(c("props"), ("seen", [1])), ("seen", "[2]")).alias("props"))


# Joins and lookups


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_condition(spark, d):
    return combine.join(table(spark, d, "customer"), table(spark, d, "orders"), c("c_custkey") == c("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_fields(spark, d):
    return combine.join(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], "left").select("doc_id", "lang", "toxic")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_anti(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return combine.join(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "anti")


@query("SELECT s_suppkey, s_nationkey, n_name AS nation, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_output(spark, d):
    return combine.lookup(table(spark, d, "supplier"), table(spark, d, "nation"), {"n_nationkey": "s_nationkey"}, {"n_name": "nation", "n_regionkey": "n_regionkey"}).select("s_suppkey", "s_nationkey", "nation", "n_regionkey")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT NULL, r_name FROM region")
def append_rows(spark, d):
    a = combine.lookup(table(spark, d, "nation"), table(spark, d, "region"), {"r_regionkey": "n_regionkey"}).select("n_name", "r_name")
    return combine.append(a, table(spark, d, "region").select("r_name"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', sum(n) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def appendpipe_total(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return combine.appendpipe(counted, lambda x: x.agg(F.sum("n").alias("n")).select(F.lit("all").alias("event_type"), "n"))


@query("SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_tables(spark, d):
    return combine.union(table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("bal")), table(spark, d, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("bal")))


@query("SELECT a.c_name, b.s_name FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) b USING (n)")
def appendcol_numbered(spark, d):
    cu, s = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    return combine.appendcol(cu, s, [c("c_custkey")], [c("s_suppkey")]).select("c_name", "s_name")


@query("SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def minus_sets(spark, d):
    return combine.minus(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_sets(spark, d):
    return combine.intersect(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("""WITH e AS (SELECT n_nationkey AS id, n_regionkey AS boss FROM nation), x AS (SELECT a.id AS start, b.id FROM e a JOIN e b ON b.id = a.boss), y AS (SELECT start, id FROM x UNION SELECT x.start, b.id FROM x JOIN e b ON b.id = (SELECT boss FROM e WHERE e.id = x.id))
SELECT start AS id, count(*) AS reached FROM y GROUP BY 1""")
def graph_lookup_chain(spark, d):
    e = table(spark, d, "nation").select(c("n_nationkey").alias("id"), c("n_regionkey").alias("boss"))
    out = combine.graph_lookup(e, e, "boss", "id", "boss", "chain", max_depth=1)
    return out.select("id", F.size("chain").cast("long").alias("reached"))


# Aggregation


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, sum(value) AS total, min(value) AS low, max(value) AS high, event_type FROM events GROUP BY event_type")
def stats_by(spark, d):
    return stats.stats(table(spark, d, "events"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), by=["event_type"])


@query("SELECT var_samp(value) AS vs, var_pop(value) AS vp, stddev_samp(value) AS ss, stddev_pop(value) AS sp, event_type FROM events GROUP BY event_type")
def stats_spread(spark, d):
    return stats.stats(table(spark, d, "events"), F.var_samp("value").alias("vs"), F.var_pop("value").alias("vp"), F.stddev_samp("value").alias("ss"), F.stddev_pop("value").alias("sp"), by=["event_type"])


@query("SELECT quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) AS p90, event_type FROM events GROUP BY event_type")
def stats_percentiles(spark, d):
    return stats.stats(table(spark, d, "events"), F.median("value").alias("med"), F.percentile("value", 0.9).alias("p90"), by=["event_type"])


@query("SELECT arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, event_type FROM events GROUP BY event_type")
def stats_earliest_latest(spark, d):
    return stats.stats(table(spark, d, "events"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), by=["event_type"])


@query("SELECT list_sort(list(DISTINCT c_mktsegment)) AS segments, c_nationkey FROM customer GROUP BY c_nationkey")
def stats_values(spark, d):
    return stats.stats(table(spark, d, "customer"), F.array_sort(F.collect_set(c("c_mktsegment").cast("string"))).alias("segments"), by=["c_nationkey"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
def stats_span(spark, d):
    return stats.stats(table(spark, d, "events"), F.count("*").alias("n"), F.avg("value").alias("mean"), by=[bins.span(c("ts"), 1, "h").alias("hour")])


@query("SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS mean, count(*) OVER (PARTITION BY event_type) AS n FROM events")
def eventstats_by(spark, d):
    return stats.eventstats(table(spark, d, "events").select("event_id", "event_type", "value"), {"mean": F.avg("value"), "n": F.count("*")}, ["event_type"]).drop("event_type")


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS lately FROM events")
def streamstats_by(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    order = [c("ts"), c("event_id")]
    out = stats.streamstats(e, {"running": F.sum("value")}, order, ["user_id"])
    return stats.streamstats(out, {"lately": F.count(F.lit(1))}, order, ["user_id"], window=3).select("event_id", "running", "lately")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS n FROM (SELECT *, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events)""")
def streamstats_reset(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return stats.streamstats(e, {"n": F.count(F.lit(1))}, [c("ts"), c("event_id")], ["user_id"], reset_before=c("value") > 90).select("event_id", "n")


@query("SELECT event_type, user_id, n AS count FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY 1, 2) WHERE r <= 3")
def top_by(spark, d):
    return stats.top(table(spark, d, "events"), ["user_id"], 3, ["event_type"])


@query("SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def rare_values(spark, d):
    return stats.top(table(spark, d, "part"), ["p_brand"], 5, rare=True)


@query("""WITH x AS (SELECT o_orderstatus AS row, o_orderpriority AS col, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), k AS (SELECT col FROM x GROUP BY 1 ORDER BY sum(v) DESC, col LIMIT 2)
SELECT CASE WHEN col IN (SELECT col FROM k) THEN col ELSE 'OTHER' END AS "column", row, round(sum(v), 2) AS total FROM x GROUP BY 1, 2""")
def chart_other(spark, d):
    out = stats.chart(table(spark, d, "orders"), F.sum("o_totalprice"), c("o_orderstatus"), c("o_orderpriority"), "total", limit=2)
    return out.withColumn("total", F.round("total", 2))


@query("SELECT date_trunc('day', ts) AS row, event_type AS \"column\", count(*) AS n FROM events GROUP BY 1, 2")
def timechart_day(spark, d):
    return stats.timechart(table(spark, d, "events"), F.count("*"), "ts", 1, "d", c("event_type"), name="n")


@query("SELECT date_trunc('hour', ts) AS row, sum(value) / 60.0 AS rate FROM events GROUP BY 1")
def timechart_per_minute(spark, d):
    return stats.timechart(table(spark, d, "events"), stats.per(c("value"), 60, 1, "h"), "ts", 1, "h", name="rate")


#: The events span thirty days.
WRAPPED = ", ".join(f"max(CASE WHEN age = {k} THEN n END) AS \"{f'{k} before' if k else 'latest'}\"" for k in range(30))


@query(f"""WITH h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1), l AS (SELECT max(CAST(epoch(t) AS BIGINT) // 86400) AS last FROM h),
f AS (SELECT l.last - CAST(epoch(t) AS BIGINT) // 86400 AS age, strftime(t, '%H:%M:%S') AS o, n FROM h, l)
SELECT o AS "offset", {WRAPPED} FROM f GROUP BY 1""")
def timewrap_days(spark, d):
    return stats.timewrap(stats.timechart(table(spark, d, "events"), F.count("*"), "ts", 1, "h", name="n"), "n", 1, "d")


@query("""SELECT event_id, CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w END AS sma, (3 * value + 2 * lag(value, 1) OVER o + lag(value, 2) OVER o) / 6.0 AS wma
FROM events WHERE value IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def trendline_averages(spark, d):
    return stats.trendline(table(spark, d, "events"), [c("ts"), c("event_id")], {"sma": (3, "value")}, {"wma": (3, "value")}, ["user_id"]).select("event_id", "sma", "wma")


@query("SELECT o_orderstatus, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS \"1-URGENT\", max(CASE WHEN o_orderpriority = '5-LOW' THEN n END) AS \"5-LOW\" FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def xyseries_pivot(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return stats.xyseries(n, "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"], ["n"])


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_discount + l_tax AS \"Total\" FROM lineitem")
def addtotals_row(spark, d):
    return rows.addtotals(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS k, s_acctbal FROM supplier UNION ALL SELECT 'Total', round(sum(s_acctbal), 6) FROM supplier")
def addcoltotals_row(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("k"), "s_acctbal")
    return rows.addcoltotals(s, ["s_acctbal"], "k").withColumn("s_acctbal", F.round("s_acctbal", 6))


@query("SELECT col AS \"column\", max(CASE WHEN k = 0 THEN v END) AS \"row 1\", max(CASE WHEN k = 1 THEN v END) AS \"row 2\" FROM (SELECT r_regionkey AS k, unnest(['r_regionkey', 'r_name']) AS col, unnest([CAST(r_regionkey AS VARCHAR), r_name]) AS v FROM region) GROUP BY 1")
def transpose_rows(spark, d):
    return rows.transpose(table(spark, d, "region"), 2, order=[c("r_regionkey")])


@query("SELECT p_partkey, CAST(floor(p_retailprice / 100) * 100 AS BIGINT)::VARCHAR || '-' || (CAST(floor(p_retailprice / 100) * 100 AS BIGINT) + 100)::VARCHAR AS bucket FROM part")
def bin_span(spark, d):
    return table(spark, d, "part").select("p_partkey", bins.span_bucket(c("p_retailprice"), 100).alias("bucket"))


@query("SELECT event_id, floor((value - 50) / 25) * 25 AS low, CAST(trunc((event_id % 21 - 10) / 5) * 5 AS BIGINT) AS whole, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter FROM events")
def bin_time(spark, d):
    return table(spark, d, "events").select("event_id", bins.span(c("value") - 50, 25.0).alias("low"), bins.span(c("event_id") % 21 - 10, 5).alias("whole"), bins.span(c("ts"), 15, "m").alias("quarter"))


# Rows and arrays


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
def sort_head(spark, d):
    return rows.head(rows.sort(table(spark, d, "orders"), "-o_totalprice", "+o_orderkey"), 15, 5).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL) WHERE r <= 2")
def dedup_first(spark, d):
    return rows.dedup(table(spark, d, "events"), "user_id", n=2, order=[c("ts"), c("event_id")]).select("event_id", "user_id")


@query("SELECT doc_id, unnest(string_split(lang || ',' || source, ',')) AS part FROM documents")
def expand_array(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("part"))
    return rows.expand(df, "part")


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS head, embedding[-1] AS tail FROM embeddings")
def array_access(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), scalar.mvindex(c("embedding"), 0).alias("head"), scalar.mvindex(c("embedding"), -1).alias("tail"))


@query("SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def nomv_roles(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.nomv(g.select("conv_id", F.transform("x", lambda e: e["role"]).alias("roles")), "roles")


@query("SELECT n_regionkey, list_sort(list(n_name)) AS n_name FROM nation GROUP BY 1")
def mvcombine_names(spark, d):
    return rows.mvcombine(table(spark, d, "nation").select("n_regionkey", "n_name"), "n_name")


@query("SELECT vec_id, _score FROM (SELECT vec_id, 1 / (1 + list_sum([(x - 0.1) * (x - 0.1) FOR x IN embedding::DOUBLE[]])) AS _score FROM embeddings) ORDER BY _score DESC LIMIT 10")
def vector_search(spark, d):
    e = table(spark, d, "embeddings")
    size = e.select(F.size("embedding")).first()[0]
    return tables.nearest(e, [0.1] * size, 10).select("vec_id", "_score")


# Windows, functions, text


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def window_ranks(spark, d):
    w, w2 = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w2).alias("rk"), F.dense_rank().over(w2).alias("dr"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_suppkey // nullif(l_linenumber - 1, 0) AS BIGINT) AS q, l_suppkey % nullif(l_linenumber - 1, 0) AS m, CASE WHEN l_linenumber > 3 THEN 1 WHEN l_linenumber < 3 THEN -1 ELSE 0 END AS s FROM lineitem")
def math_functions(spark, d):
    k = c("l_linenumber") - 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.divide(c("l_suppkey"), k, whole=True).alias("q"), scalar.modulus(c("l_suppkey"), k).alias("m"), F.sign(c("l_linenumber") - 3).cast("int").alias("s"))


@query("SELECT c_custkey, left(c_name, 4) AS l, right(c_name, 3) AS r, md5(c_name) AS h, strpos(c_name, '#') AS p, CASE WHEN c_mktsegment < 'F' THEN -1 WHEN c_mktsegment > 'F' THEN 1 ELSE 0 END AS s FROM customer")
def string_functions(spark, d):
    n = c("c_name")
    return table(spark, d, "customer").select("c_custkey", scalar.left(n, 4).alias("l"), scalar.right(n, 3).alias("r"), F.md5(n).alias("h"), scalar.locate("#", n).alias("p"), scalar.strcmp(c("c_mktsegment"), F.lit("F")).alias("s"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, dayofweek(o_orderdate) + 1 AS dw, dayname(o_orderdate) AS dn, last_day(o_orderdate) AS ld,
date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) + 719528 AS td, CAST(strftime(o_orderdate, '%U') AS INTEGER) AS wk, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders""")
def date_functions(spark, d):
    t = c("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.quarter(t).alias("q"), F.dayofyear(t).alias("dy"), F.dayofweek(t).alias("dw"), times.dayname(t).alias("dn"), F.last_day(t).alias("ld"), times.to_days(t).cast("long").alias("td"), times.week(t, 0).alias("wk"), times.date_format(t, "%Y/%m/%d").alias("f"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%G%V') AS INTEGER) AS yw FROM orders")
def yearweek_iso(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.yearweek(c("o_orderdate"), 1).cast("int").alias("yw"))


@query("SELECT event_id, ts + INTERVAL 90 MINUTE AS later, date_trunc('day', ts) - INTERVAL 1 DAY AS yesterday, date_diff('hour', TIMESTAMP '2020-01-01', date_trunc('hour', ts)) AS hours FROM events")
def time_arithmetic(spark, d):
    t = c("ts")
    return table(spark, d, "events").select("event_id", times.addtime(t, F.lit("01:30:00")).alias("later"), times.relative_time(t, "-1d@d").cast("timestamp_ntz").alias("yesterday"), times.timestampdiff("hour", F.lit("2020-01-01").cast("timestamp"), F.date_trunc("hour", t)).alias("hours"))


@query("SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['idiot', 'scum'])) > 0")
def text_match(spark, d):
    return table(spark, d, "documents").where(scalar.match(c("text"), "idiot scum")).select("doc_id")


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http://%.com/%'")
def text_wildcard(spark, d):
    return table(spark, d, "pages").where(scalar.wildcard_query(c("url"), "http://*.com/*")).select("page_id", "url")


@query("SELECT user_id, ip FROM (SELECT user_id, concat('10.', (user_id // 256) % 256, '.', user_id % 256, '.7') AS ip FROM (SELECT DISTINCT user_id FROM events)) WHERE ip LIKE '10.0.%' AND CAST(split_part(ip, '.', 3) AS INTEGER) < 64")
def cidr_match(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    ip = F.concat(F.lit("10."), (F.floor(c("user_id") / 256) % 256).cast("string"), F.lit("."), (c("user_id") % 256).cast("string"), F.lit(".7"))
    return u.select("user_id", ip.alias("ip")).where(scalar.cidrmatch(c("ip"), "10.0.0.0/18"))


@query("SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def sql_surface(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def window_tumbling(spark, d):
    return windows.windowed(table(spark, d, "events"), "ts", "1 hour", F.count("*").alias("n"), by=("event_type",))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM g GROUP BY user_id, session""")
def window_session(spark, d):
    return windows.windowed(table(spark, d, "events"), "ts", "30 minutes", F.count("*").alias("n"), by=("user_id",), session=True)


@query()
def kmeans_clusters(spark, d):
    return learn.kmeans(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], 3).select("c_custkey", "ClusterID")


@query("""WITH m AS (SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS mid FROM orders GROUP BY 1),
x AS (SELECT o.*, mid, abs(o_totalprice - mid) AS off FROM orders o JOIN m USING (o_orderpriority)), s AS (SELECT o_orderpriority, quantile_disc(off, 0.5) AS dev FROM x GROUP BY 1)
SELECT o_orderkey, o_orderpriority, o_totalprice, off * 0.6745 / dev AS score, off * 0.6745 / dev > 3.5 AS is_anomaly FROM x JOIN s USING (o_orderpriority)""")
def anomaly_scores(spark, d):
    return learn.anomalies(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"])


@query("SELECT 'r_regionkey' AS column_name, 1 AS ordinal_position UNION ALL SELECT 'r_name', 2")
def describe_table(spark, d):
    return tables.describe(table(spark, d, "region")).select("column_name", "ordinal_position")


from millrace.plans import command_queries, function_queries  # noqa: E402, F401  they register themselves
