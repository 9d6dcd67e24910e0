"""Queries of scalar functions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import bins, convert, json_edit, scalar, times
from millrace.operators import shape
from millrace.plans.registry import query
from millrace.session import table

c = F.col


# Predicates


@query("SELECT event_id, (value > 50) <> (user_id > 20) AS x, value IS NULL AS n, NOT (event_type = 'click') AS other, coalesce(nullif(event_type, 'view'), 'seen') AS seen, value BETWEEN 10 AND 20 AS mid FROM events")
def predicates_logic(spark, d):
    v, t = c("value"), c("event_type")
    return table(spark, d, "events").select("event_id", ((v > 50) != (c("user_id") > 20)).alias("x"), v.isNull().alias("n"), (~(t == "click")).alias("other"), F.coalesce(F.nullif(t, F.lit("view")), F.lit("seen")).alias("seen"), v.between(10, 20).alias("mid"))


@query("SELECT c_custkey, c_name LIKE 'Customer#0000000_1' AS l, c_name ILIKE 'CUSTOMER#%7' AS i, regexp_matches(c_name, '0[13]$') AS r, regexp_full_match(c_name, 'Customer#[0-9]+') AS w FROM customer")
def predicates_like(spark, d):
    n = c("c_name")
    return table(spark, d, "customer").select("c_custkey", n.like("Customer#0000000_1").alias("l"), n.ilike("CUSTOMER#%7").alias("i"), n.rlike("0[13]$").alias("r"), n.rlike("^(?:Customer#[0-9]+)$").alias("w"))


@query("SELECT p_partkey, coalesce(t, '') = '' AS e, trim(coalesce(t, '')) = '' AS b, coalesce(t, 'none') AS i FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END AS t FROM part)")
def predicates_empty(spark, d):
    k = c("p_partkey") % 4
    t = F.when(k == 1, "").when(k == 2, "  ").when(k == 3, c("p_name"))
    return table(spark, d, "part").select("p_partkey", scalar.is_empty(t).alias("e"), scalar.is_blank(t).alias("b"), F.ifnull(t, F.lit("none")).alias("i"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-14 00:00:00' AS e, ts <= TIMESTAMP '2024-01-15 06:30:00' - INTERVAL 2 HOUR AS l FROM events")
def predicates_relative_time(spark, d):
    now = F.lit("2024-01-15 06:30:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", times.earliest("-1d@d", c("ts"), now).alias("e"), times.latest("-2h", c("ts"), now).alias("l"))


@query("SELECT event_id, event_id % 3 = 0 AS inside FROM events")
def cidr_match_v6(spark, d):
    ip = F.when(c("event_id") % 3 == 0, F.concat(F.lit("2001:db8::"), (c("event_id") % 1000).cast("string"))).when(c("event_id") % 3 == 1, "2001:db9::1").otherwise("10.0.0.1")
    return table(spark, d, "events").select("event_id", scalar.cidrmatch(ip, "2001:db8::/32").alias("inside"))


@query("SELECT 'BIGINT' AS k, 'STRING' AS n, 'DOUBLE' AS b, 'INT' AS i, 'TIMESTAMP' AS t, 'ARRAY' AS a, 'STRUCT' AS s, 'BOOLEAN' AS f FROM region LIMIT 1")
def type_names(spark, d):
    o = table(spark, d, "orders").limit(1)
    return o.select(*[scalar.typeof(x).alias(n) for n, x in {"k": c("o_orderkey"), "n": c("o_orderstatus"), "b": c("o_totalprice"), "i": F.lit(1), "t": c("o_orderdate"), "a": F.array(F.lit(1)), "s": F.struct("o_orderkey"), "f": F.lit(True)}.items()])


# Mathematics


@query("SELECT event_id, exp(v / 50) AS e, ln(v + 1) AS l, log10(v + 1) AS l10, log2(v + 1) AS l2, ln(v + 1) / ln(3) AS l3, sqrt(v) AS s, cbrt(v) AS cb, pow(v, 1.5) AS p, exp(v / 50) - 1 AS m FROM (SELECT event_id, abs(value) AS v FROM events)")
def math_powers(spark, d):
    v = F.abs(c("value"))
    return table(spark, d, "events").select("event_id", F.exp(v / 50).alias("e"), scalar.log(v + 1).alias("l"), F.log10(v + 1).alias("l10"), F.log2(v + 1).alias("l2"), scalar.log(v + 1, F.lit(3.0)).alias("l3"), scalar.root(v).alias("s"), F.cbrt(v).alias("cb"), scalar.power(v, F.lit(1.5)).alias("p"), F.expm1(v / 50).alias("m"))


@query("SELECT event_id, sin(v) AS s, cos(v) AS co, 1 / tan(v + 0.5) AS ct, atan(v) AS a, atan2(v, 2.0) AS a2, (exp(v) - exp(-v)) / 2 AS sh, (exp(v) + exp(-v)) / 2 AS ch, degrees(v) AS d, radians(v) AS r, CASE WHEN v <= 1 THEN acos(v) END AS ac, CASE WHEN v <= 1 THEN asin(v) END AS si FROM (SELECT event_id, abs(value) / 60 AS v FROM events)")
def math_angles(spark, d):
    v = F.abs(c("value")) / 60
    return table(spark, d, "events").select("event_id", F.sin(v).alias("s"), F.cos(v).alias("co"), F.cot(v + 0.5).alias("ct"), F.atan(v).alias("a"), F.atan2(v, F.lit(2.0)).alias("a2"), F.sinh(v).alias("sh"), F.cosh(v).alias("ch"), F.degrees(v).alias("d"), F.radians(v).alias("r"), scalar.arc(F.acos, v).alias("ac"), scalar.arc(F.asin, v).alias("si"))


@query("SELECT p_partkey, abs(v) AS a, sign(v) AS s, CAST(ceil(v) AS BIGINT) AS c, floor(v) AS f, round(v, 1) AS r, trunc(CAST(v AS DECIMAL(18, 2)) * 10) / 10 AS t, CAST(trunc(v / 100) * 100 AS DOUBLE) AS h, round_even(v, 0) AS i FROM (SELECT p_partkey, p_retailprice - 950 AS v FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS DOUBLE) AS p_retailprice FROM part))")
def math_rounding(spark, d):
    v = F.round(c("p_retailprice") - 950, 2)
    return table(spark, d, "part").select("p_partkey", F.abs(v).alias("a"), F.signum(v).alias("s"), F.ceil(v).alias("c"), F.floor(v).alias("f"), F.round(v, 1).alias("r"), scalar.truncate(v, 1).alias("t"), scalar.truncate(v, -2).alias("h"), F.rint(v).alias("i"))


@query("SELECT * FROM (VALUES (1.15, 1.15, 1.1, 1.0), (-1.15, -1.15, -1.1, -1.0), (4.35, 4.35, 4.3, 4.0), (0.29, 0.29, 0.2, 0.0), (1e15, 1e15, 1e15, 1e15)) AS t(v, two, one, none)")
def math_truncate_exact(spark, d):
    rows = spark.createDataFrame([(1.15,), (-1.15,), (4.35,), (0.29,), (1e15,)], "v double")
    return rows.select("v", scalar.truncate(c("v"), 2).alias("two"), scalar.truncate(c("v"), 1).alias("one"), scalar.truncate(c("v")).alias("none"))


@query("SELECT p_partkey, hex(p_size) AS h, CAST(printf('%o', p_size) AS VARCHAR) AS o, greatest(p_size, p_partkey) AS g, least(p_size, p_partkey) AS l, p_size + 1 AS a, p_size - 1 AS s, p_size * 2 AS m, round(pi(), 6) AS pi, round(exp(1), 6) AS e FROM part".replace("hex(p_size)", "lower(to_base(p_size, 16))").replace("CAST(printf('%o', p_size) AS VARCHAR)", "to_base(p_size, 8)"))
def math_bases(spark, d):
    s, k = c("p_size"), c("p_partkey")
    return table(spark, d, "part").select("p_partkey", scalar.conv(s, 10, 16).alias("h"), scalar.conv(s, 10, 8).alias("o"), F.greatest(s, k).alias("g"), F.least(s, k).alias("l"), (s + 1).alias("a"), (s - 1).alias("s"), (s * 2).alias("m"), F.round(F.pi(), 6).alias("pi"), F.round(F.e(), 6).alias("e"))


@query("SELECT p_partkey, p_name AS most, CAST(p_size AS VARCHAR) AS least FROM part")
def math_extremes_mixed(spark, d):
    """Text ranks above numbers."""
    parts, text = [c("p_size"), c("p_name"), c("p_size") + 5], [False, True, False]
    return table(spark, d, "part").select("p_partkey", scalar.scalar_extreme(parts, text).alias("most"), scalar.scalar_extreme(parts, text, largest=False).alias("least"))


@query("SELECT count(*) AS n, true AS inside, true AS same FROM part")
def math_random(spark, d):
    p = table(spark, d, "part").select(F.rand().alias("r"), (F.rand(7) >= 0).alias("s"))
    return p.agg(F.count("*").alias("n"), F.bool_and(c("r").between(0, 1)).alias("inside"), F.bool_and("s").alias("same"))


# Text


@query("SELECT c_custkey, length(c_name) AS n, ascii(c_name) AS a, lower(c_name) AS l, upper(c_name) AS u, reverse(c_name) AS r, substr(c_name, 3, 4) AS s, substr(c_name, -3) AS t, concat_ws('-', c_mktsegment, NULL, c_name) AS w, concat(c_name, '!') AS c FROM customer")
def string_basic(spark, d):
    n = c("c_name")
    return table(spark, d, "customer").select("c_custkey", F.length(n).alias("n"), F.ascii(n).alias("a"), F.lower(n).alias("l"), F.upper(n).alias("u"), F.reverse(n).alias("r"), F.substring(n, 3, 4).alias("s"), F.substring(n, -3, 3).alias("t"), F.concat_ws("-", "c_mktsegment", F.lit(None).cast("string"), n).alias("w"), F.concat(n, F.lit("!")).alias("c"))


@query("SELECT c_custkey, trim('  ' || c_mktsegment || ' ') || '|' AS t, ltrim('  ' || c_mktsegment || ' ') || '|' AS l, rtrim('  ' || c_mktsegment || ' ') || '|' AS r, sha1(c_name) AS s1, sha256(c_name) AS s2, md5(c_name) AS m FROM customer")
def string_trim_hash(spark, d):
    t = F.concat(F.lit("  "), c("c_mktsegment"), F.lit(" "))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.trim(t), F.lit("|")).alias("t"), F.concat(F.ltrim(t), F.lit("|")).alias("l"), F.concat(F.rtrim(t), F.lit("|")).alias("r"), F.sha1("c_name").alias("s1"), F.sha2("c_name", 256).alias("s2"), F.md5("c_name").alias("m"))


@query("SELECT c_custkey, regexp_replace(c_name, '([A-Z])([a-z]+)', '\\2-\\1', 'g') AS r FROM customer")
def string_replace_groups(spark, d):
    return shape.sed(table(spark, d, "customer").select("c_custkey", c("c_name").alias("r")), "r", r"s/([A-Z])([a-z]+)/\2-\1/g")


@query("SELECT p_partkey, bin(p_size) AS b, lower(hex(p_size)) AS h, printf('%02d:%02d:%02d', p_partkey // 3600, p_partkey // 60 % 60, p_partkey % 60) AS du, CAST(p_size AS VARCHAR) AS p FROM part".replace("lower(hex(p_size))", "lower(to_base(p_size, 16))").replace("bin(p_size)", "to_base(p_size, 2)"))
def convert_tostring(spark, d):
    s, k = c("p_size"), c("p_partkey")
    return table(spark, d, "part").select("p_partkey", scalar.tostring(s, "binary").alias("b"), scalar.tostring(s, "hex").alias("h"), scalar.tostring(k, "duration").alias("du"), scalar.tostring(s).alias("p"))


@query("SELECT * FROM (VALUES ('1234567.891', '1,234,567.89'), ('12', '12'), ('-1000.5', '-1,000.5')) AS t(v, told)")
def convert_commas(spark, d):
    rows = spark.createDataFrame([("1234567.891",), ("12",), ("-1000.5",)], "v string")
    return rows.select("v", scalar.tostring(c("v"), "commas").alias("told"))


@query("SELECT * FROM (VALUES ('12', 12.0, 18.0, 10.0), ('ff', NULL, 255.0, NULL), ('-7', -7.0, -7.0, -7.0), ('1.5', 1.5, NULL, NULL), ('x', NULL, NULL, NULL)) AS t(v, ten, sixteen, eight)")
def convert_tonumber(spark, d):
    rows = spark.createDataFrame([("12",), ("ff",), ("-7",), ("1.5",), ("x",)], "v string")
    return rows.select("v", scalar.tonumber(c("v")).alias("ten"), scalar.tonumber(c("v"), 16).alias("sixteen"), scalar.tonumber(c("v"), 8).alias("eight"))


@query("SELECT * FROM (VALUES ('1,234.5', 1234.5, NULL, 1234.5), ('12k', 12.0, 12.0, NULL), ('2m', 2.0, 2048.0, NULL), ('3g', 3.0, 3145728.0, NULL), ('7 apples', 7.0, NULL, NULL), ('abc', NULL, NULL, NULL), ('', NULL, NULL, NULL)) AS t(v, n, k, r)")
def convert_numbers(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("1,234.5", "12k", "2m", "3g", "7 apples", "abc", "")], "v string")
    return shape.convert(rows, n=("num", "v"), k=("memk", "v"), r=("rmcomma", "v"))


@query("SELECT * FROM (VALUES ('12k', 12.0, 12.0), ('1,234', 1234.0, 1.0), ('5.5 kg', 5.5, 5.5), ('none', NULL, NULL)) AS t(v, a, u)")
def convert_auto(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("12k", "1,234", "5.5 kg", "none")], "v string")
    return shape.convert(rows, a=("auto", "v"), u=("rmunit", "v"))


@query("SELECT * FROM (VALUES ('03:05.5', 185.5, NULL), ('45.25', 45.25, 45.25), ('1+02:03:04', NULL, 93784.0), ('00:10:00', NULL, 600.0), ('99:99', NULL, NULL), ('bad', NULL, NULL)) AS t(v, m, s)")
def convert_durations(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("03:05.5", "45.25", "1+02:03:04", "00:10:00", "99:99", "bad")], "v string")
    return shape.convert(rows, m=("mstime", "v"), s=("dur2sec", "v"))


@query("SELECT event_id, strftime(make_timestamp(event_id * 86399000000), '%m/%d/%Y %H:%M:%S') AS t, strftime(make_timestamp(event_id * 86399000000), '%Y-%m-%d') AS f, CAST(event_id * 86399 AS DOUBLE) AS back FROM events")
def convert_times(spark, d):
    e = table(spark, d, "events").select("event_id", (c("event_id") * 86399).alias("s"))
    return shape.convert(e, t=("ctime", "s"), f=("ctime", "s", "%Y-%m-%d"), back=("mktime", "t")).drop("s")


# Dates


@query("SELECT o_orderkey, hour(t) AS h, minute(t) AS m, second(t) AS s, hour(t) * 60 + minute(t) AS md, isodow(t) - 1 AS wd, monthname(t) AS mn, microsecond(t) % 1000000 AS us, month(t) AS mo, day(t) AS dm FROM (SELECT o_orderkey, o_orderdate + to_microseconds(o_orderkey * 7654321) AS t FROM orders)")
def date_parts(spark, d):
    t = F.timestamp_micros(F.unix_micros(c("o_orderdate").cast("timestamp")) + c("o_orderkey") * 7654321)
    return table(spark, d, "orders").select("o_orderkey", F.hour(t).alias("h"), F.minute(t).alias("m"), F.second(t).alias("s"), times.minute_of_day(t).alias("md"), F.weekday(t).alias("wd"), times.monthname(t).alias("mn"), times.microsecond(t).alias("us"), F.month(t).alias("mo"), F.dayofmonth(t).alias("dm"))


@query("SELECT o_orderkey, CAST(strftime(t, '%d%H') AS BIGINT) AS dh, CAST(strftime(t, '%H%M%S') AS BIGINT) AS hs, CAST(strftime(t, '%Y%m') AS BIGINT) AS ym, CAST(strftime(t, '%S%f') AS BIGINT) AS su, CAST(quarter(t) AS BIGINT) AS q, CAST(strftime(t, '%d%H%M%S%f') AS BIGINT) AS du FROM (SELECT o_orderkey, o_orderdate + to_microseconds(o_orderkey * 7654321) AS t FROM orders)")
def date_extract(spark, d):
    t = F.timestamp_micros(F.unix_micros(c("o_orderdate").cast("timestamp")) + c("o_orderkey") * 7654321)
    units = {"dh": "DAY_HOUR", "hs": "HOUR_SECOND", "ym": "YEAR_MONTH", "su": "SECOND_MICROSECOND", "q": "QUARTER", "du": "DAY_MICROSECOND"}
    return table(spark, d, "orders").select("o_orderkey", *[times.extract(u, t).alias(n) for n, u in units.items()])


#: Weeks by their definition, independent of the library's arithmetic: the year's day 1, and where its first week begins.
WEEKS = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders),
y AS (SELECT DISTINCT year(t) + k AS yr FROM o, (SELECT unnest([-1, 0, 1]) AS k)),
f AS (SELECT yr, make_date(yr, 1, 1) AS jan1, dayofweek(make_date(yr, 1, 1)) AS sun, isodow(make_date(yr, 1, 1)) - 1 AS mon FROM y),
w AS (SELECT yr, jan1 + CAST((7 - sun) % 7 AS INTEGER) AS m0, jan1 + CAST(CASE WHEN mon <= 3 THEN -mon ELSE 7 - mon END AS INTEGER) AS m1, jan1 + CAST(CASE WHEN sun <= 3 THEN -sun ELSE 7 - sun END AS INTEGER) AS m4, jan1 + CAST((7 - mon) % 7 AS INTEGER) AS m5 FROM f)
SELECT o_orderkey,
  CAST(CASE WHEN t < a.m0 THEN 0 ELSE (t - a.m0) // 7 + 1 END AS INTEGER) AS w0, CAST(CASE WHEN t < a.m1 THEN 0 ELSE (t - a.m1) // 7 + 1 END AS INTEGER) AS w1,
  CAST(CASE WHEN t < a.m0 THEN (t - b.m0) // 7 + 1 WHEN t >= n.m0 THEN 1 ELSE (t - a.m0) // 7 + 1 END AS INTEGER) AS w2, CAST(week(t) AS INTEGER) AS w3,
  CAST(CASE WHEN t < a.m4 THEN 0 ELSE (t - a.m4) // 7 + 1 END AS INTEGER) AS w4, CAST(CASE WHEN t < a.m5 THEN 0 ELSE (t - a.m5) // 7 + 1 END AS INTEGER) AS w5,
  CAST(CASE WHEN t < a.m4 THEN (t - b.m4) // 7 + 1 WHEN t >= n.m4 THEN 1 ELSE (t - a.m4) // 7 + 1 END AS INTEGER) AS w6,
  CAST(CASE WHEN t < a.m5 THEN (t - b.m5) // 7 + 1 WHEN t >= n.m5 THEN 1 ELSE (t - a.m5) // 7 + 1 END AS INTEGER) AS w7
FROM o JOIN w a ON a.yr = year(t) JOIN w b ON b.yr = year(t) - 1 JOIN w n ON n.yr = year(t) + 1
"""


@query(WEEKS)
def date_week_modes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[times.week(c("o_orderdate"), m).cast("int").alias(f"w{m}") for m in range(8)])


@query("SELECT o_orderkey, strftime(t, '%a %b %d %H %I %M %S %p %y %j') AS a, strftime(t, '%A, %B %Y') AS b, day(t) || CASE WHEN day(t) IN (11, 12, 13) THEN 'th' WHEN day(t) % 10 = 1 THEN 'st' WHEN day(t) % 10 = 2 THEN 'nd' WHEN day(t) % 10 = 3 THEN 'rd' ELSE 'th' END AS c, strftime(t, '%H:%M:%S') || '|' || strftime(t, '%f') AS e, CAST(dayofweek(t) AS VARCHAR) AS w FROM (SELECT o_orderkey, o_orderdate + to_microseconds(o_orderkey * 7654321) AS t FROM orders)")
def date_format_letters(spark, d):
    t = F.timestamp_micros(F.unix_micros(c("o_orderdate").cast("timestamp")) + c("o_orderkey") * 7654321)
    return table(spark, d, "orders").select("o_orderkey", times.date_format(t, "%a %b %d %H %I %i %S %p %y %j").alias("a"), times.date_format(t, "%W, %M %Y").alias("b"), times.date_format(t, "%D").alias("c"), times.date_format(t, "%T|%f").alias("e"), times.date_format(t, "%w").alias("w"))


@query("SELECT o_orderkey, '00 ' || strftime(t, '%H.%M.%S') || ' 0000' AS f FROM (SELECT o_orderkey, o_orderdate + to_microseconds(o_orderkey * 7654321) AS t FROM orders)")
def time_format_letters(spark, d):
    t = F.timestamp_micros(F.unix_micros(c("o_orderdate").cast("timestamp")) + c("o_orderkey") * 7654321)
    return table(spark, d, "orders").select("o_orderkey", times.time_format(t, "%d %H.%i.%s %Y").alias("f"))


@query("SELECT o_orderkey, o_orderdate AS a, NULL::TIMESTAMP AS b FROM orders")
def date_parse(spark, d):
    told = times.date_format(c("o_orderdate"), "%d/%m/%Y %H:%i:%s")
    return table(spark, d, "orders").select("o_orderkey", times.str_to_date(told, "%d/%m/%Y %H:%i:%s").cast("timestamp_ntz").alias("a"), times.str_to_date(told, "%Y-%m-%d").cast("timestamp_ntz").alias("b"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS a, o_orderdate - INTERVAL 36 HOUR AS b, CAST(o_orderdate AS DATE) + 10 AS c, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS e, strftime(o_orderdate - INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS f FROM orders")
def date_arithmetic(spark, d):
    t = c("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", times.date_add(t, 3, "month").alias("a"), times.date_sub(t, 36, "hour").alias("b"), times.adddate(t, 10).alias("c"), F.datediff(t, F.lit("1995-01-01").cast("date")).alias("e"), F.date_format(times.subtime(t, F.lit("00:01:30")), "yyyy-MM-dd HH:mm:ss").alias("f"))


@query("SELECT o_orderkey, date_diff('month', TIMESTAMP '1990-01-01', date_trunc('month', o_orderdate)) AS m, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS dd, o_orderdate + INTERVAL 2 WEEK AS w, epoch(o_orderdate) + 719528 * 86400.0 AS ts FROM orders")
def date_differences(spark, d):
    t = c("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", times.timestampdiff("month", F.lit("1990-01-01").cast("timestamp"), F.date_trunc("month", t)).alias("m"), times.timestampdiff("day", t, F.lit("2000-01-01").cast("timestamp")).alias("dd"), times.timestampadd("week", 2, t).cast("timestamp_ntz").alias("w"), times.to_seconds(t).cast("double").alias("ts"))


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS a, s AS b, CASE WHEN s < 36000 THEN '-' ELSE '' END || printf('%02d:%02d:%02d', abs(s - 36000) // 3600, abs(s - 36000) // 60 % 60, abs(s - 36000) % 60) AS c FROM (SELECT event_id, event_id * 37 % 86400 AS s FROM events)")
def time_seconds(spark, d):
    s = c("event_id") * 37 % 86400
    told = times.sec_to_time(s)
    return table(spark, d, "events").select("event_id", told.alias("a"), times.time_to_sec(F.concat(F.lit("2024-01-01 "), told)).cast("long").alias("b"), times.timediff(told, F.lit("10:00:00")).alias("c"))


@query("SELECT event_id, make_timestamp(event_id * 1000003) AS t, strftime(make_timestamp(event_id * 1000003), '%Y-%m-%d %H:%M:%S') AS f, CAST(event_id * 86400 + 0.25 AS DOUBLE) AS u FROM events")
def date_unix(spark, d):
    k = c("event_id")
    back = F.concat(F.date_format(F.timestamp_seconds(k * 86400), "yyyy-MM-dd HH:mm:ss"), F.lit(".25"))
    return table(spark, d, "events").select("event_id", times.from_unixtime((k * 1000003).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).alias("t"), times.from_unixtime(F.floor(k * 1000003 / 1_000_000), "%Y-%m-%d %T").alias("f"), times.unix_timestamp(back).alias("u"))


@query("SELECT * FROM (VALUES (691231, -86400.0 + 3155760000.0 - 0), (20240229, 1709164800.0), (240229123456, 1709210096.0), (20240229123456, 1709210096.0), (700101, 0.0)) AS t(n, u)".replace("-86400.0 + 3155760000.0 - 0", "epoch(TIMESTAMP '2069-12-31 00:00:00')"))
def date_unix_numbers(spark, d):
    rows = spark.createDataFrame([(x,) for x in (691231, 20240229, 240229123456, 20240229123456, 700101)], "n long")
    return rows.select("n", times.unix_timestamp(c("n"), numeric=True).alias("u"))


@query("SELECT event_id, make_date(2020, 1, 1) + CAST(event_id % 700 - 1 AS INTEGER) AS d, CASE WHEN event_id % 70 < 60 THEN printf('%02d:%02d:%02d', event_id % 24, event_id % 70, event_id % 60) END AS t, (DATE '0001-01-01' + CAST(event_id AS INTEGER)) AS fd FROM events WHERE event_id % 700 > 0")
def date_make(spark, d):
    k = c("event_id")
    return table(spark, d, "events").where(k % 700 > 0).select("event_id", times.makedate(F.lit(2020), k % 700).alias("d"), times.maketime(k % 24, k % 70, k % 60).alias("t"), times.from_days(k + 366).alias("fd"))


@query("SELECT event_id, CAST(strftime(DATE '2019-03-01' + to_months(CAST(event_id % 50 AS INTEGER)), '%Y%m') AS BIGINT) AS a, event_id % 50 - 12 AS b FROM events")
def date_periods(spark, d):
    n = (c("event_id") % 50).cast("int")
    later = times.period_add(F.lit(201903), n)
    return table(spark, d, "events").select("event_id", later.cast("long").alias("a"), times.period_diff(later, F.lit(202003)).alias("b"))


@query("SELECT event_id, ts + INTERVAL 9 HOUR AS t, ts - INTERVAL 330 MINUTE AS k FROM events")
def date_zones(spark, d):
    return table(spark, d, "events").select("event_id", times.convert_tz(c("ts").cast("timestamp"), "UTC", "Asia/Tokyo").cast("timestamp_ntz").alias("t"), times.convert_tz(c("ts").cast("timestamp"), "+05:30", "UTC").cast("timestamp_ntz").alias("k"))


@query("SELECT * FROM (VALUES ('2024-03-01 10:00:00', TIMESTAMP '2024-03-01 10:00:00', TIMESTAMP '2024-03-01 11:00:00', TIMESTAMP '2024-03-01 12:30:00', DATE '2024-03-01', '10:00:00'), ('2024-03-01 10:00:00.5+02:00', TIMESTAMP '2024-03-01 08:00:00.5', TIMESTAMP '2024-03-01 09:00:00.5', TIMESTAMP '2024-03-01 10:30:00.5', DATE '2024-03-01', '08:00:00.5'), ('no time', NULL, NULL, NULL, NULL, NULL)) AS t(v, a, b, p, d, h)")
def date_read(spark, d):
    rows = spark.createDataFrame([("2024-03-01 10:00:00",), ("2024-03-01 10:00:00.5+02:00",), ("no time",)], "v string")
    v = c("v")
    return rows.select("v", times.datetime(v).alias("a"), times.datetime(v, "Europe/Paris").alias("b"), times.timestamp(v, F.lit("02:30:00")).alias("p"), times.moment(v).cast("date").alias("d"), times.time(v).alias("h"))


@query("SELECT * FROM (VALUES ('DATE', 'USA', '%m.%d.%Y'), ('TIME', 'EUR', '%H.%i.%s'), ('TIMESTAMP', 'INTERNAL', '%Y%m%d%H%i%s'), ('DATE', 'XX', NULL)) AS t(k, p, f)")
def date_formats_named(spark, d):
    asked = [("DATE", "USA"), ("TIME", "EUR"), ("TIMESTAMP", "INTERNAL"), ("DATE", "XX")]
    return spark.createDataFrame([(k, p, times.get_format(k, p)) for k, p in asked], "k string, p string, f string")


@query("SELECT true AS a, true AS b, true AS c, true AS d FROM region LIMIT 1")
def date_now(spark, d):
    now = F.current_timestamp()
    row = table(spark, d, "region").limit(1)
    return row.select((F.localtimestamp() == now.cast("timestamp_ntz")).alias("a"), (F.current_date() == now.cast("date")).alias("b"), times.time(now).rlike(r"^\d\d:\d\d:\d\d").alias("c"), (F.unix_seconds(now) > 1_700_000_000).alias("d"))


@query("SELECT o_orderkey, date_trunc('week', o_orderdate) AS w, date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS m, date_trunc('year', o_orderdate) AS y, date_trunc('quarter', o_orderdate) AS q FROM orders")
def date_relative(spark, d):
    t = c("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", times.relative_time(t, "@w1").cast("timestamp_ntz").alias("w"), times.relative_time(t, "-1mon@mon").cast("timestamp_ntz").alias("m"), times.relative_time(t, "@y").cast("timestamp_ntz").alias("y"), times.relative_time(t, "@q").cast("timestamp_ntz").alias("q"))


@query("SELECT o_orderkey, make_date(1970 + (year(o_orderdate) - 1970) // 5 * 5, 1, 1)::TIMESTAMP AS y5, date_trunc('quarter', o_orderdate) AS q, time_bucket(INTERVAL 2 WEEK, o_orderdate, TIMESTAMP '1970-01-05') AS w2 FROM orders")
def span_calendar(spark, d):
    t = c("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", bins.span(t, 5, "y").alias("y5"), bins.span(t, 1, "q").alias("q"), bins.span(t, 2, "w").alias("w2"))


# Arrays and maps


ARRAYS = "(SELECT conv_id, list(role ORDER BY turn) AS r, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1)"


def arrays(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", F.transform("x", lambda e: e["role"]).alias("r"), F.transform("x", lambda e: e["turn"]).alias("t"))


@query(f"SELECT conv_id, len(r) AS n, r[2:3] AS s, array_to_string(r, '+') AS j, list_distinct(r)[1] AS d1, CASE WHEN len(r) > 1 THEN r[-2:] ELSE r END AS last, list_position(r, 'assistant') - 1 AS f FROM {ARRAYS}".replace("list_distinct(r)[1] AS d1", "r[1] AS d1"))
def array_multivalue(spark, d):
    r = c("r")
    return arrays(spark, d).select("conv_id", F.size(r).cast("long").alias("n"), scalar.mvindex(r, 1, 2).alias("s"), scalar.mvjoin(r, "+").alias("j"), scalar.mvindex(scalar.mvdedup(r), 0).alias("d1"), scalar.mvindex(r, -2, -1).alias("last"), scalar.mvfind(r, "^assist").alias("f"))


@query(f"SELECT conv_id, list_transform(t, lambda x: x * 2) AS m, list_filter(t, lambda x: x > 1) AS f, CAST(list_sum(t) AS BIGINT) AS s, len(list_filter(t, lambda x: x >= 0)) = len(t) AS every_one, len(list_filter(t, lambda x: x = 2)) > 0 AS any_one FROM {ARRAYS}")
def array_lambdas(spark, d):
    t = c("t")
    return arrays(spark, d).select("conv_id", F.transform(t, lambda x: x * 2).alias("m"), F.filter(t, lambda x: x > 1).alias("f"), F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x).alias("s"), F.forall(t, lambda x: x >= 0).alias("every_one"), F.exists(t, lambda x: x == 2).alias("any_one"))


@query(f"SELECT conv_id, list_transform(generate_series(1, len(r)), lambda i: r[i] || ',' || t[i]) AS z, list_concat(r, ['end']) AS a FROM {ARRAYS}")
def array_zip(spark, d):
    return arrays(spark, d).select("conv_id", scalar.mvzip(c("r"), c("t")).alias("z"), scalar.mvappend(c("r"), F.lit(None).cast("array<string>"), F.array(F.lit("end"), F.lit(None).cast("string"))).alias("a"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_brand, '') AS l, [CAST(p_size AS VARCHAR), p_brand] AS m FROM part")
def array_split(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.split(c("p_name"), " ").alias("w"), scalar.split(c("p_brand"), "").alias("l"), scalar.array(c("p_size"), c("p_brand"), mixed=True).alias("m"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, p_brand AS b, CAST(p_size AS VARCHAR) || ',' || p_name AS both, 'new' AS won, 1 AS left_over FROM part")
def map_functions(spark, d):
    one = F.create_map(F.lit("a"), c("p_size").cast("string"), F.lit("b"), c("p_brand"))
    two = F.create_map(F.lit("a"), c("p_name"), F.lit("c"), F.lit("new"))
    merged, joined, fewer = scalar.map_append(one, two), scalar.map_concat(one, two), scalar.map_remove(one, ["a"])
    return table(spark, d, "part").select("p_partkey", F.try_element_at(one, F.lit("a")).alias("a"), F.try_element_at(fewer, F.lit("b")).alias("b"), F.array_join(F.try_element_at(merged, F.lit("a")), ",").alias("both"), F.try_element_at(joined, F.lit("c")).alias("won"), F.size(fewer).alias("left_over"))


# JSON


@query("SELECT event_id, json_valid(props) AS v, '[\"k\"]' AS keys, json_extract_string(props, '$.k') AS k, false AS bad, NULL::VARCHAR AS none FROM events")
def json_read(spark, d):
    p = c("props")
    return table(spark, d, "events").select("event_id", scalar.json_valid(p).alias("v"), F.to_json(scalar.json_keys(p)).alias("keys"), scalar.json_extract(p, "k").alias("k"), scalar.json_valid(F.concat(p, F.lit("}"))).alias("bad"), scalar.json(F.concat(p, F.lit("}"))).alias("none"))


@query("SELECT p_partkey, '{\"size\":' || p_size || ',\"brand\":\"' || p_brand || '\",\"none\":null}' AS o, '[' || p_size || ',\"' || p_brand || '\",null]' AS a, 3 AS n, '[\"' || p_brand || '\",\"' || p_size || '\"]' AS e FROM part")
def json_build(spark, d):
    o = scalar.json_object(size=c("p_size"), brand=c("p_brand"), none=F.lit(None).cast("string"))
    a = scalar.json_array(c("p_size"), c("p_brand"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", o.alias("o"), a.alias("a"), scalar.json_array_length(a).alias("n"), scalar.json_extract(o, "brand", "size").alias("e"))


@query("SELECT p_partkey, '{\"a\":[{\"n\":1},{\"n\":' || p_size || '}]}' AS t, CAST(p_size AS VARCHAR) AS second, '[1,' || p_size || ']' AS each FROM part")
def json_paths(spark, d):
    t = F.format_string('{"a":[{"n":1},{"n":%d}]}', c("p_size"))
    return table(spark, d, "part").select("p_partkey", t.alias("t"), scalar.json_extract(t, "a{1}.n").alias("second"), scalar.json_extract(t, "a{}.n").alias("each"))


@query("SELECT p_partkey, '{\"a\":{\"b\":[1,2]}}' AS del, '{\"a\":{\"b\":[1,2,9]},\"s\":' || p_size || '}' AS app, '{\"a\":{\"b\":[1,2]},\"s\":\"x\"}' AS put FROM part")
def json_change(spark, d):
    t = F.format_string('{"a":{"b":[1,2]},"s":%d}', c("p_size"))
    return table(spark, d, "part").select("p_partkey", json_edit.json_delete(t, "s").alias("del"), json_edit.json_append(t, ("a.b", 9)).alias("app"), json_edit.json_set(t, ("s", "x")).alias("put"))


# Full text: a token is a run of letters and digits.


TOKENS = "string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'that'])".replace("'the', 'that'", "'en', 'le'"))
def text_match_all(spark, d):
    return table(spark, d, "documents").where(scalar.match(c("text"), "le en", every=True)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' en le ')")
def text_phrase(spark, d):
    return table(spark, d, "documents").where(scalar.match_phrase(c("text"), "EN le")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string({TOKENS}, ' ') || ' ', ' en ([^ ]+ )?le ')")
def text_phrase_slop(spark, d):
    return table(spark, d, "documents").where(scalar.match_phrase(c("text"), "en le", slop=1)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' en l')")
def text_phrase_prefix(spark, d):
    return table(spark, d, "documents").where(scalar.match_phrase(c("text"), "en l", prefix=True)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'und') OR regexp_matches(' ' || array_to_string({TOKENS}, ' '), ' unt')")
def text_bool_prefix(spark, d):
    return table(spark, d, "documents").where(scalar.match_bool_prefix(c("text"), "und unt")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), 'hot') OR list_contains(string_split_regex(lower(p_type), '[^a-z0-9]+'), 'promo') OR list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), 'promo') OR list_contains(string_split_regex(lower(p_type), '[^a-z0-9]+'), 'hot')")
def text_multi_match(spark, d):
    return table(spark, d, "part").where(scalar.multi_match([c("p_name"), c("p_type")], "hot promo")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_name LIKE 'hot %' AND NOT p_type LIKE 'PROMO%') OR p_name LIKE 'c%' OR p_name LIKE '% c%'".replace("p_name LIKE 'hot %'", "regexp_matches(lower(p_name), '\\bhot\\b')").replace("p_name LIKE 'c%' OR p_name LIKE '% c%'", "regexp_matches(lower(p_name), '\\bc[a-z]*r\\b')"))
def text_query_string(spark, d):
    return table(spark, d, "part").where(scalar.query_string({"name": c("p_name"), "type": c("p_type")}, "(name:hot AND NOT type:promo) OR name:c*r")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '\\beconomy\\b') AND NOT regexp_matches(lower(p_name), '\\bhot\\b')")
def text_query_signs(spark, d):
    return table(spark, d, "part").where(scalar.query_string({"name": c("p_name"), "type": c("p_type")}, "+type:economy -name:hot")).select("p_partkey")


@query("SELECT k FROM (VALUES ('a*b'), ('a%b')) AS t(k) WHERE k = 'a*b' UNION ALL SELECT 'axxb'")
def text_wildcard_escape(spark, d):
    rows = spark.createDataFrame([("a*b",), ("a%b",), ("axxb",)], "k string")
    return rows.where(scalar.wildcard_query(c("k"), "a\\*b")).union(rows.where(scalar.wildcard_query(c("k"), "a?xb")))


# Buckets


@query("SELECT p_partkey, CAST(floor(p_retailprice / 1000) * 1000 AS BIGINT) || '-' || CAST(floor(p_retailprice / 1000) * 1000 + 1000 AS BIGINT) AS w, CAST(floor(p_retailprice / 100) * 100 AS BIGINT) || '-' || CAST(floor(p_retailprice / 100) * 100 + 100 AS BIGINT) AS m, CAST(floor(p_retailprice / 1000) * 1000 AS BIGINT) || '-' || CAST(floor(p_retailprice / 1000) * 1000 + 1000 AS BIGINT) AS r, NULL::VARCHAR AS n FROM part")
def bucket_functions(spark, d):
    v, low, high = c("p_retailprice"), F.lit(900.0), F.lit(1100.0)
    return table(spark, d, "part").select("p_partkey", bins.width_bucket(v, 2, low, F.lit(2900.0)).alias("w"), bins.minspan_bucket(v, 50, low, high).alias("m"), bins.range_bucket(v, low, high, 0, 5000).alias("r"), bins.span_bucket(v, 0).alias("n"))


@query("SELECT event_id, regexp_replace(strftime(ts, '%d.%m.%Y'), '0', 'o', 'g') AS f, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS g FROM events")
def strftime_letters(spark, d):
    s = F.unix_seconds(c("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.regexp_replace(convert.ctime(s, "%d.%m.%Y"), "0", "o").alias("f"), convert.ctime(s, "%FT%T").alias("g"))
