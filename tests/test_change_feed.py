from asofkit.operators import ledger as L


def test_cursors_between_and_beyond_the_newest_changes(spark):
    obs = spark.createDataFrame([(e, f"2020-01-0{d}", d % 2) for e in "ab" for d in range(1, 6)], "entity string, date string, v int")
    cursors = spark.createDataFrame([(1, "2019-01-01"), (2, "2020-01-04"), (3, "2020-01-05"), (4, None)], "reader int, cursor string")
    got = sorted((r.reader, r.n, r.entity, r.date[-1]) for r in L.change_feed(obs, cursors, "v", 3).collect())
    assert got == [(1, 1, "a", "5"), (1, 2, "b", "5"), (1, 3, "a", "4"), (2, 1, "a", "5"), (2, 2, "b", "5")]
