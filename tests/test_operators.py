"""Edge rows of the operators and functions: nulls, zero divisors, names, empties, week ends."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import bins, convert, scalar, times
from millrace.operators import combine, learn, rows, shape, stats
from millrace.sources import tables
from millrace.streaming import windows


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a_x int, b_x int, c int")
    assert shape.rename(df, {"*_x": "new_*"}).columns == ["new_a", "new_b", "c"]
    assert shape.rename(df, {"a_x": "c"}).columns == ["c", "b_x"] and shape.rename(df, {"none": "c"}).columns == ["a_x", "b_x"] and shape.rename(df, {"none": "d"}).columns == df.columns
    with pytest.raises(ValueError):
        shape.rename(df, {"*_x": "y"})


def test_dotted_names_and_fields(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c"])
    assert shape.fields(df, "a.*").columns == ["a.b"] and shape.fields(df, "a.b", exclude=True).columns == ["c"]


def test_fillnull_and_replace(spark):
    df = spark.createDataFrame([(None, None), ("x1y", 2)], "s string, n int")
    assert [tuple(r) for r in shape.fillnull(df, 0).collect()] == [(None, 0), ("x1y", 2)]
    with pytest.raises(TypeError):
        shape.fillnull(df, 0, ["s"])
    assert [r.s for r in shape.replace(df, {"x*y": "<*>$"}, ["s"]).collect()] == [None, "<1>$"]


def test_parse_rex_grok(spark):
    df = spark.createDataFrame([("ab 12",), ("none",), (None,)], "s string")
    assert [tuple(r)[1:] for r in shape.parse(df, "s", r"(?<w>[a-z]+) (?<n>\d+)").collect()] == [("ab", "12"), ("", ""), ("", "")]
    assert [r.n for r in shape.rex(df, "s", r"(?<n>\d)").collect()] == ["1", None, None]
    assert [r.n for r in shape.rex(df, "s", r"(?<n>\d)", max_match=0).collect()] == [["1", "2"], None, None]
    line = '10.9.8.7 - mira [02/Feb/2022:22:20:02 +0100] "PUT /mill/wheel HTTP/1.1" 204 31'
    got = shape.grok(spark.createDataFrame([(line,)], "m string"), "m", "%{COMMONAPACHELOG}").first()
    assert (got.clientip, got.auth, got.verb, got.request, got.response, got.bytes) == ("10.9.8.7", "mira", "PUT", "/mill/wheel", "204", "31")
    assert shape.sed(df, "s", r"s/([a-z])(\d| )/\2\1/").first().s.startswith("a b")


def test_conversions(spark):
    lit = F.lit
    assert one(spark, convert.memk(lit("2m")), convert.memk(lit("x")), convert.num(lit("1,234")), convert.num(lit("12 pcs")), convert.num(lit("pcs")), convert.rmcomma(lit("1,2a")), convert.rmunit(lit("-3.5ms"))) == [2048.0, None, 1234.0, 12.0, None, None, -3.5]
    assert one(spark, convert.mstime(lit("01:02.5")), convert.mstime(lit("99:99")), convert.dur2sec(lit("1+02:03:04")), convert.dur2sec(lit("25:00:00")), convert.ctime(lit("0")), convert.mktime(lit("01/02/1970 00:00:00"))) == [62.5, None, 93784.0, None, "01/01/1970 00:00:00", 86400.0]


def test_joins(spark):
    a = spark.createDataFrame([(1, "a", "l"), (2, "b", "l"), (None, "c", "l")], "k int, x string, y string")
    b = spark.createDataFrame([(1, "r1"), (1, "r2"), (None, "r3")], "k int, y string")
    assert sorted((r.k, r.y) for r in combine.join(a, b, ["k"]).collect()) == [(1, "r1"), (1, "r2")]
    assert [r.y for r in combine.join(a, b, ["k"], overwrite=False, most=1).collect()] == ["l"]
    assert sorted(((r.x, r.y) for r in combine.lookup(a, b, ["k"], append=True).collect())) == [("a", "l"), ("a", "l"), ("b", "l"), ("c", "l")]
    assert sorted(((r.x, r.y or "") for r in combine.lookup(a, b, ["k"]).collect())) == [("a", "r1"), ("a", "r2"), ("b", ""), ("c", "")]
    assert combine.in_subquery(a, ["k"], b.select("k"), negate=True).count() == 0
    assert combine.in_subquery(a, ["k"], b.where("k = 1").select("k"), negate=True).count() == 1
    with pytest.raises(TypeError):
        combine.append(a, spark.createDataFrame([("1",)], "k string"))
    assert combine.union(a.select("k"), spark.createDataFrame([("z",)], "k string")).count() == 4


def test_graph_lookup(spark):
    stations = spark.createDataFrame([("mill", "weir"), ("weir", "lock"), ("lock", None), ("barn", "weir"), ("yard", "barn")], "name string, next string")
    got = {r.name: [(x.name, x.depth) for x in r.way] for r in combine.graph_lookup(stations, stations, "next", "name", "next", "way", max_depth=3, depth_field="depth").collect()}
    assert got["yard"] == [("barn", 0), ("weir", 1), ("lock", 2)] and got["lock"] == [] and got["mill"] == [("weir", 0), ("lock", 1)]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    assert {r.a: len(r.all) for r in combine.graph_lookup(ring, ring, "a", "a", "b", "all", max_depth=10).collect()} == {1: 3, 2: 3, 3: 3}


def test_appendcol_keeps_the_longer_side(spark):
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.range(3).withColumnRenamed("id", "y")
    got = combine.appendcol(a, b, [F.col("x")], [F.col("y").desc()]).collect()
    assert sorted((r.x, r.y) for r in got if r.y is not None) == [(0, 2), (1, 1), (2, 0)] and len(got) == 5


def test_stats_nulls_and_windows(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, None), (None, 3, 5), ("b", 4, 2), ("a", 5, 4)], "k string, t int, v int")
    assert {r.k: r.n for r in stats.stats(df, F.count("v").alias("n"), by=["k"]).collect()} == {"a": 2, None: 1, "b": 1}
    assert {r.k for r in stats.stats(df, F.count("v").alias("n"), by=["k"], nullable=False).collect()} == {"a", "b"}
    assert {r.t: r.s for r in stats.eventstats(df, {"s": F.sum("v")}, ["k"]).collect()} == {1: 5, 2: 5, 3: 5, 4: 2, 5: 5}
    assert {r.t: r.s for r in stats.eventstats(df, {"s": F.sum("v")}, ["k"], nullable=False).collect()}[3] is None
    run = stats.streamstats(df, {"s": F.sum("v")}, [F.col("t")], ["k"], window=1, current=False)
    assert {r.t: r.s for r in run.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    reset = stats.streamstats(df, {"n": F.count(F.lit(1))}, [F.col("t")], reset_after=F.col("t") == 2)
    assert {r.t: r.n for r in reset.collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3}
    t = stats.trendline(df, [F.col("t")], {"s": (2, "v")}, {"w": (2, "v")}).collect()
    assert [(r.s, r.w) for r in sorted(t, key=lambda r: r.t)] == [(None, None), (3.0, pytest.approx(11 / 3)), (3.5, 3.0), (3.0, pytest.approx(10 / 3))]


def test_chart_folds_and_keeps_nulls(spark):
    df = spark.createDataFrame([("r", "a", 5), ("r", "b", 3), ("r", "c", 1), ("r", None, 9), (None, "a", 1)], "r string, c string, v int")
    got = {r.column: r.value for r in stats.chart(df, F.sum("v"), F.col("r"), F.col("c"), limit=1).collect()}
    assert got == {"a": 5, "OTHER": 4, "NULL": 9}


def test_rows(spark):
    df = spark.createDataFrame([(1, [1, None, 2]), (2, []), (3, None)], "k int, a array<int>")
    assert [tuple(r) for r in rows.expand(df, "a").collect()] == [(1, 1), (1, None), (1, 2)] and rows.expand(df, "a", limit=1).count() == 1
    assert [r.a for r in rows.nomv(df, "a").collect()] == ["1\n2", "", ""]
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, t int")
    assert [r.t for r in rows.dedup(d, "k", order=[F.col("t")]).collect()] == [1] and rows.dedup(d, "k", order=[F.col("t")], keepempty=True).count() == 2
    assert [r.k for r in rows.sort(d, "-k").collect()][-1] is None and [r.k for r in rows.sort(d, "k").collect()][0] is None
    assert [tuple(r) for r in rows.addtotals(d, columns=True, labelfield="k").collect()][-1] == ("Total", 6, None)
    assert {tuple(r) for r in rows.transpose(d, 3, order=[F.col("t")]).collect()} == {("k", "a", "a", None), ("t", "1", "2", "3")}


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalar.divide(lit(7), lit(2), True), scalar.divide(lit(-7), lit(2), True), scalar.divide(lit(7), lit(0), True), scalar.divide(lit(7.0), lit(0)), scalar.modulus(lit(-7), lit(3)), scalar.truncate(lit(-1.25), 1), scalar.root(lit(-1.0)), scalar.log(lit(0.0))) == [3, -3, None, None, -1, -1.2, None, None]
    assert one(spark, scalar.tostring(lit(255), "hex"), scalar.tostring(lit(6523), "duration"), scalar.tonumber(lit("ff"), 16), scalar.tonumber(lit("zz")), scalar.is_blank(lit("  ")), scalar.strcmp(lit("a"), lit("b"))) == ["ff", "01:48:43", 255.0, None, True, -1]
    a = F.array(lit("a"), lit("b"), lit("c"))
    assert one(spark, scalar.mvindex(a, -1), scalar.mvindex(a, 0, 1), scalar.mvindex(a, 5), scalar.mvfind(a, "c"), scalar.mvfind(a, "z"), scalar.mvzip(a, a, "-"), scalar.mvappend(a, lit(None).cast("array<string>"))) == ["c", ["a", "b"], None, 2, None, ["a-a", "b-b", "c-c"], ["a", "b", "c"]]
    assert one(spark, scalar.cidrmatch(lit("10.1.2.3"), "10.1.0.0/16"), scalar.cidrmatch(lit("bad"), "10.1.0.0/16"), scalar.cidrmatch(lit("2001:db8::1"), "2001:db8::/32")) == [True, None, True]
    j = lit('{"a": {"b": [{"c": 1}, {"c": 2}]}}')
    assert one(spark, scalar.json_extract(j, "a.b{1}.c"), scalar.json_keys(j), scalar.json_valid(lit("{x")), scalar.json_array_length(lit("[1,2]"))) == ["2", ["a"], False, 2]
    assert one(spark, scalar.match(lit("The Quick fox"), "quick zebra"), scalar.match(lit("a b"), "a c", every=True), scalar.match_phrase(lit("the quick fox"), "Quick fo", prefix=True), scalar.match_phrase(lit("the quick fox"), "quick fo")) == [True, False, True, False]
    assert one(spark, *[F.size(scalar.split(lit("abc"), "")), F.size(scalar.split(lit("a.b"), "."))]) == [3, 2]


def test_bins(spark):
    lit = F.lit
    assert one(spark, bins.span_bucket(lit(27), 10), bins.span_bucket(lit(27), 0), bins.width_bucket(lit(27), 10, lit(0), lit(99)), bins.minspan_bucket(lit(27), 5, lit(0), lit(90)), bins.range_bucket(lit(27), lit(0), lit(50))) == ["20-30", None, "20-30", "20-30", "20-30"]
    t = lit("2024-03-15 13:47:10").cast("timestamp")
    assert one(spark, bins.span(t, 1, "w"), bins.span(t, 2, "M"), bins.span(t, 1, "y"), bins.span(t, 15, "m")) == [dt.datetime(2024, 3, 11), dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 15, 13, 45)]


def test_times(spark):
    lit = F.lit
    day = lambda s: lit(s).cast("date")
    for text in ("2011-05-17", "2016-01-03", "2017-12-31", "2021-01-01", "2024-12-30"):
        d = dt.date.fromisoformat(text)
        iso = d.isocalendar()
        assert one(spark, times.week(day(text), 0), times.week(day(text), 5), times.week(day(text), 3), times.yearweek(day(text), 3)) == [int(d.strftime("%U")), int(d.strftime("%W")), iso[1], iso[0] * 100 + iso[1]]
    at = dt.datetime(2013, 7, 22, 5, 9, 41)
    t = lit(str(at)).cast("timestamp")
    assert one(spark, times.date_format(t, "%W %M %Y"), times.date_format(t, "%y %a %d %m %b %j"), times.date_format(t, "%H %I %T %S %w")) == [at.strftime(f) for f in ("%A %B %Y", "%y %a %d %m %b %j", "%H %I %H:%M:%S %S %w")]
    assert one(spark, times.date_format(t, "%D|%k|%l|%e|%f")) == ["22nd|5|5|22|000000"]
    assert one(spark, times.to_days(day("2013-07-22")), times.period_add(lit(201311), 3), times.period_diff(lit(201402), lit(201311)), times.makedate(lit(2013), lit(60)), times.timediff(lit("05:09:41"), lit("06:00:00"))) == [dt.date(2013, 7, 22).toordinal() + 365, 201402, 3, dt.date(2013, 3, 1), "-00:50:19"]
    assert one(spark, times.relative_time(t, "-1d@d").cast("string"), times.relative_time(t, "+1mon@mon").cast("string"), times.relative_time(t, "@w1").cast("string")) == ["2013-07-21 00:00:00", "2013-08-01 00:00:00", "2013-07-22 00:00:00"]


def test_learn(spark):
    df = spark.createDataFrame([(i, float(i % 5) if i < 50 else 1000.0) for i in range(51)], "i int, v double")
    assert [r.i for r in learn.anomalies(df, "v").where("is_anomaly").collect()] == [50]
    assert learn.kmeans(df, ["v"]).groupBy("ClusterID").count().count() == 2


def test_stream_equals_table(spark, tmp_path):
    src = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), h) for h in range(3) for m in (5, 50)], "ts timestamp, v int")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windows.to_files(windows.windowed(stream, "ts", "1 hour", F.sum("v").alias("s")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    got = {(r.window_start, r.s) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.window_start, r.s) for r in windows.windowed(src, "ts", "1 hour", F.sum("v").alias("s")).collect()}
    assert got and got <= whole and len(whole) == 3


def test_sources(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, s string")
    assert tables.formatted(df, "csv") == 'k,s\n1,"a,b"\n2,\n' and tables.formatted(df, "raw").startswith("k|s\n1|a,b")
    assert [len(p) for p in tables.pages_of(spark.range(5), 2)] == [2, 2, 1]
    assert tables.makeresults(spark, 3).count() == 3 and tables.describe(df).count() == 2


def test_json_edits(spark):
    from millrace.functions import json_edit as j

    a = F.lit('{"crates": [{"kg": 7}, {"kg": 8}], "dock": "east"}')
    assert one(
        spark, j.json_delete(a, "crates{1}.kg", "dock"), j.json_delete(a, "crates{5}.kg"), j.json_set(a, ("crates{}.kg", 0), ("dock", None)), j.json_append(a, ("crates", 9), ("dock", 1)),
        j.json_append(a, ("crates", "[1,2]")), j.json_extend(a, ("crates", "[1,2]")), j.json_set(F.lit("{x"), ("a", 1)), j.json_extract_all(a),
    ) == [
        '{"crates":[{"kg":7},{}]}', '{"crates":[{"kg":7},{"kg":8}],"dock":"east"}', '{"crates":[{"kg":0},{"kg":0}],"dock":null}', '{"crates":[{"kg":7},{"kg":8},9],"dock":"east"}',
        '{"crates":[{"kg":7},{"kg":8},"[1,2]"],"dock":"east"}', '{"crates":[{"kg":7},{"kg":8},1,2],"dock":"east"}', None, {"crates{}.kg": "[7, 8]", "dock": "east"},
    ]


def test_templates(spark):
    from millrace.operators import templates

    logs = [f"Sluice opened by keeper_{k} gate west{k}x" for k in range(8)] + [f"Reading level from /10.0.0.{k}:80 now" for k in range(4)] + [None]
    got = {r.patterns_field: r.pattern_count for r in templates.counted(spark.createDataFrame([(x,) for x in logs], "m string"), "m").collect()}
    assert got["Reading level from <*IP*> now"] == 4 and got[""] == 1
    assert sum(n for p, n in got.items() if p.startswith("Sluice opened by")) == 8
