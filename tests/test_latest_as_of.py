import datetime as dt

from pyspark.sql import functions as F

from asofkit.operators import joins as J


def test_latest_as_of_ties_ages_and_nulls(spark):
    d = lambda m, n: dt.date(2020, m, n)
    facts = spark.createDataFrame([("a", "p", d(1, 1), 1), ("a", "p", d(1, 5), 2), ("a", "p", d(1, 5), 3), ("a", None, d(1, 2), 4), ("a", "q", None, 5), ("b", "p", d(1, 1), 6), (None, "p", d(1, 1), 7)], "k string, period string, accepted date, id int")
    grid = spark.createDataFrame([("a", d(1, 4)), ("a", d(1, 5)), ("a", d(1, 5)), ("a", d(3, 1)), ("c", d(1, 5)), (None, d(1, 5)), ("b", None)], "k string, as_of date")
    got = J.latest_as_of(facts, grid, ["k"], "period", "accepted", "as_of", [F.col("id")], max_age=30)
    assert got.columns == ["k", "as_of", "period", "accepted", "id"]
    assert sorted((r.as_of, str(r.period), r.id) for r in got.collect()) == [(d(1, 4), "None", 4), (d(1, 4), "p", 1), (d(1, 5), "None", 4), (d(1, 5), "p", 3)]
