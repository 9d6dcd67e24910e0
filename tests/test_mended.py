"""Cases that once gave wrong rows: numbering large tables, NOT IN, scalar subqueries, null groups, signs and escapes."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace import session as ses
from millrace.functions import bins, convert, scalar
from millrace.operators import combine, learn, rows, shape, stats, templates
from millrace.plans import queries  # noqa: F401
from millrace.plans import command_queries
from millrace.streaming import state, windows


def test_numbering_three_million_rows(spark):
    df = spark.range(3_000_000).select((F.xxhash64("id") % 1000).alias("k"), "id")
    got = combine.numbered(df, [F.col("k")], "n").agg(F.count_distinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert tuple(got) == (3_000_000, 1, 3_000_000)
    a = combine.appendcol(df, df.select("k", F.col("id").alias("other")), [F.col("k"), F.col("id")], [F.col("k"), F.col("other")])
    assert tuple(a.agg(F.count("*"), F.count(F.when(F.col("id") == F.col("other"), 1))).first()) == (3_000_000, 3_000_000)


def test_not_in(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (3, "z")], "k int, s string")
    none = a.where("k > 9").select("k")
    assert combine.in_subquery(a, ["k"], none, negate=True).count() == 4
    assert [r.k for r in combine.in_subquery(a, ["k"], a.where("k = 1").select("k"), negate=True).orderBy("k").collect()] == [2, 3]
    assert combine.in_subquery(a, ["k"], a.where("k = 1 OR k IS NULL").select("k"), negate=True).count() == 0
    pairs = spark.createDataFrame([(1, "x"), (2, "q"), (None, "z")], "p int, q string")
    # (2, null) may be (2, q); (null, y) surely differs from all; (3, z) may be (null, z).
    assert [tuple(r) for r in combine.in_subquery(a, ["k", "s"], pairs, negate=True).collect()] == [(None, "y")]
    plan = combine.in_subquery(a, ["k", "s"], pairs, negate=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scalar_subquery_of_two_rows(spark):
    df = spark.range(2)
    with pytest.raises(PySparkException):
        combine.scalar_subquery(df, "v", df).collect()
    assert [r.v for r in combine.scalar_subquery(df, "v", df.limit(0)).collect()] == [None, None]


def test_anomalies_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 1.0), (None, None)], "k string, v double")
    assert learn.anomalies(df, "v", ["k"]).count() == 4


def test_signs_and_escapes(spark):
    got = spark.createDataFrame([(-7, -7.0, "a*b"), (7, 7.0, "a\\b")], "i int, x double, s string").select(bins.span(F.col("i"), 5), bins.span(F.col("x"), 5), scalar.truncate(F.col("x") / 7 * 1.15, 2), scalar.wildcard_query(F.col("s"), "a\\*b"), scalar.wildcard_query(F.col("s"), "a\\\\?")).collect()
    assert [tuple(r) for r in got] == [(-5, -10, -1.15, True, False), (5, 5, 1.15, False, True)]


def test_running_without_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(stats, "CHUNK", 7)
    df = spark.range(50).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") * 37 % 11).cast("double")).alias("v"))
    v = [None if i % 4 == 0 else float(i * 37 % 11) for i in range(50)]
    got = stats.streamstats(df, {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "low": ("min", F.col("v")), "m": ("avg", F.col("v"))}, [F.col("id")], current=False).orderBy("id").collect()
    for i, r in enumerate(got):
        seen = [x for x in v[:i] if x is not None]
        assert (r.s, r.n, r.low, r.m) == ((sum(seen), len(seen), min(seen), pytest.approx(sum(seen) / len(seen))) if seen else (None, 0, None, None))
    slid = stats.streamstats(df, {"s": F.max("v")}, [F.col("id")], window=20).orderBy("id").collect()
    assert [r.s for r in slid] == [max([x for x in v[max(0, i - 19) : i + 1] if x is not None], default=None) for i in range(50)]
    with pytest.raises(ValueError):
        stats.streamstats(df, {"s": F.sum("v")}, [F.col("id")])


def test_dedup_consecutive_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "a"), (6, None), (7, "a")], "t int, k string")
    assert sorted(r.t for r in rows.dedup(df, "k", n=2, order=[F.col("t")], consecutive=True).collect()) == [1, 2, 4, 5, 7]


def test_asof_and_range_edges(spark):
    a = spark.createDataFrame([(1, 5), (1, None), (None, 5), (2, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 3, "x"), (1, 5, "y"), (1, 9, "z"), (1, None, "w"), (None, 1, "n")], "k int, u int, v string")
    got = combine.asof_join(a, b, "t", "u", ["k"]).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 5, 5, "y"), (1, None, None, None), (None, 5, None, None), (2, 5, None, None)]))
    i = spark.createDataFrame([(-15.0, 15.0), (3.0, 3.0), (None, 4.0)], "lo double, hi double")
    p = spark.createDataFrame([(-15.0,), (0.0,), (15.0,), (None,)], "v double")
    assert sorted(r.v for r in combine.range_join(p, i, "v", "lo", "hi", 10).collect()) == [-15.0, 0.0]


def test_keyed_state(spark, tmp_path):
    def put(name, found):
        spark.createDataFrame(found, "k string, v double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    t = dt.datetime(2024, 1, 1, 10)
    put("a", [("x", 1.0, t), ("x", 2.0, t), ("y", None, t), (None, 1.0, t)])
    seen = []
    stream = spark.readStream.schema("k string, v double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def run():
        q = state.each_batch(state.running_totals(stream, "k", "v", "ts"), lambda df, n: seen.extend((r.key, r.n, r.total, r.closed) for r in df.collect()), str(tmp_path / "check"))
        q.awaitTermination(120)

    run()
    assert sorted(seen) == [("x", 2, 3.0, False), ("y", 1, 0.0, False)]
    put("b", [("x", 5.0, t + dt.timedelta(hours=3))])
    run()
    assert ("x", 3, 8.0, False) in seen
    put("c", [("z", 1.0, t + dt.timedelta(hours=4))])
    run()
    assert ("y", 1, 0.0, True) in seen


def test_session_and_sliding_windows(spark):
    src = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m),) for m in (0, 10, 40, 45)], "ts timestamp")
    assert sorted(r.n for r in windows.windowed(src, "ts", "20 minutes", F.count("*").alias("n"), session=True).collect()) == [2, 2]
    assert sum(r.n for r in windows.windowed(src, "ts", "20 minutes", F.count("*").alias("n"), slide="10 minutes").collect()) == 8


def test_shared_folder(spark, monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: None)
            set = staticmethod(lambda k, v: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        ses.shared_dir(Fake)
    with ses.scratch(spark):
        kept = ses.materialize(spark.range(3), "thing")
        assert kept.count() == 3
        path = kept.inputFiles()[0]
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_anomalies_by_exact_medians(spark):
    df = spark.range(200_001).select((F.col("id") % 2).alias("k"), (F.col("id") * F.col("id") * 1.25).alias("v"), F.lit(None).cast("double").alias("none"))
    for by in ([], ["k"]):
        got = {tuple(r)[:-1]: r.m for r in learn.medians(df, F.col("v"), by, "m").collect()}
        want = {}
        for i in range(200_001):
            want.setdefault((i % 2,) if by else (), []).append(i * i * 1.25)
        assert got == {k: v[(len(v) + 1) // 2 - 1] for k, v in want.items()}
    assert learn.anomalies(df.limit(5), "none", ["k"]).where("score IS NULL AND NOT is_anomaly").count() == 5


def test_times_beyond_the_year_9999(spark):
    seconds = [0, 253402300799, 253402300800, 518394000000, 600000000001, -62167219201, 8_700_000_000_001]
    df = spark.createDataFrame([(s,) for s in seconds], "s long")
    got = shape.convert(df, t=("ctime", "s"), f=("ctime", "s", "%F"), back=("mktime", "t")).collect()
    import duckdb

    assert [(r.t, r.f) for r in got] == [duckdb.sql(f"SELECT strftime(t, '%m/%d/%Y %H:%M:%S'), strftime(t, '%Y-%m-%d') FROM (SELECT make_timestamp({s} * 1000000::BIGINT) AS t)").fetchall()[0] for s in seconds]
    assert [r.back for r in got] == seconds
    assert spark.range(1).select(convert.mktime(F.lit("20240102"), "%Y%m%d").alias("a"), convert.mktime(F.lit("240102"), "%Y%m%d").alias("b"), convert.ctime(F.lit("8.7"), "%S")).first()[:2] == (1704153600.0, 240102.0)


def test_distinct_users_once(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 1500).alias("user_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("event_type"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = command_queries.stats_distinct_approx(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(f"Row(event_type={k!r}, near=True)" for k in (None, "t1", "t2"))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()  # no sketch for each user


def test_templates_of_frequent_messages(spark, monkeypatch):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, "g").alias("k"), F.when(F.col("id") % 50 > 0, "user logged in").otherwise(F.concat(F.lit("odd "), F.col("id") % 4)).alias("m"))
    plain = {b: sorted(map(str, templates.label(df, "m", b).select("id", "patterns_field").collect())) for b in ((), ("k",))}
    monkeypatch.setattr(templates, "FREQUENT", 20)
    for b, want in plain.items():
        assert sorted(map(str, templates.label(df, "m", b).select("id", "patterns_field").collect())) == want
    # The row count reaches no join: messages are counted first.
    plan = templates.counted(df, "m")
    assert {r.pattern_count for r in plan.collect() if r.patterns_field == "user logged in"} == {294}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("sum(__n") < text.index("Join LeftOuter") < text.index("count(1) AS __n")
