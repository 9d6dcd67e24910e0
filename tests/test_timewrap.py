"""Time charts folded into many periods."""

from pyspark.sql import functions as F

from millrace.operators import stats


def test_timewrap_over_many_periods(spark):
    days = 250
    rows = spark.range(days * 2).select(F.timestamp_seconds(F.col("id") * 43200 + 1_700_006_400).alias("row"), F.col("id").alias("n"))
    out = stats.timewrap(rows.union(spark.sql("SELECT cast(null AS timestamp), 1L")), "n", 1, "d")
    assert out.columns == ["offset", "latest", *[f"{a} before" for a in range(1, days)]]
    got = {r.offset: list(r)[1:] for r in out.collect()}
    assert set(got) == {"00:00:00", "12:00:00"} and sorted(v for r in got.values() for v in r) == list(range(days * 2))
    assert got["00:00:00"][-1] == 0 and got["12:00:00"][0] == days * 2 - 1
