"""Steps whose rows must not grow with versions, copies or groups: the rows that the plan's own operators put out are counted."""

import datetime as dt

from pyspark.sql import functions as F

from asofkit.operators import bars as B
from asofkit.operators import business as BU
from asofkit.operators import ledger as L
from asofkit.operators import ranks as R
from asofkit.operators import stats as ST


def most_rows(df, counter="numOutputRows"):
    """(rows of df, most rows that any operator of its executed plan put out, or another counter's most)."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        metric = plan.metrics().get(counter)
        below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return max([metric.get().value() if metric.isDefined() else 0, *map(walk, below)])

    rows = df.collect()
    return rows, walk(df._jdf.queryExecution().executedPlan())


def many_versions(spark):
    """Two quarters a year apart, each with 20,000 versions filed on 400 days, and a date of the grid for each such day."""
    day = F.date_add(F.lit(dt.date(2021, 1, 1)), (F.col("id") % 400).cast("int"))
    end = F.when(F.col("id") < 20000, dt.date(2019, 12, 31)).otherwise(dt.date(2020, 12, 31))
    facts = spark.range(40000).select(
        F.lit(1).alias("entity"), F.lit("revenue").alias("group"), F.lit(0).alias("concept_priority"), F.date_sub(end, 90).alias("period_start"), end.alias("period_end"), day.alias("accepted_at"),
        F.col("id").alias("accession"), (F.lit(1000.0) + F.col("id") % 20000 / 100).alias("value"),
    )
    return facts, facts.select("entity", F.col("accepted_at").alias("as_of")).distinct()


def test_dilution_meets_a_version_for_each_date_at_most(spark):
    facts, grid = many_versions(spark)
    known = facts.select("entity", F.lit("shares").alias("concept"), F.col("concept_priority").alias("priority"), "period_end", "accepted_at", "value")
    splits = spark.createDataFrame([(1, dt.date(2020, 6, 1), 2.0)], "entity int, date date, ratio double")
    rows, most = most_rows(BU.dilution(known, splits, grid))
    # The largest version of a day d is 1000 + (19600 + d) / 100 in both years; the split doubles the older count.
    assert len(rows) == 400 and all(abs(r.dilution + 0.5) < 1e-12 for r in rows)
    assert most <= 100_000  # 400 dates x 400 versions x half; all versions would give 8,000,000


def test_facts_as_filed_meets_a_version_for_each_date_at_most(spark):
    facts, grid = many_versions(spark)
    rows, most = most_rows(BU.facts_as_filed(facts, grid))
    got = {r.as_of: sorted((f.period_end, f.accepted_at, f.value, f.days) for f in r.facts) for r in rows}
    for d in range(400):
        day = dt.date(2021, 1, 1) + dt.timedelta(d)  # the last accession of the day is the newest version
        assert got[day] == [(dt.date(y, 12, 31), day, 1000 + (19600 + d) / 100, 90) for y in (2019, 2020)]
    assert most <= 200_000  # all versions would give 8,000,000


def test_shares_shuffle_days_and_not_versions(spark):
    facts, grid = many_versions(spark)
    known = facts.select("entity", F.col("concept_priority").alias("priority"), "period_end", F.col("accepted_at").alias("accepted"), "value")
    rows, most = most_rows(BU.shares_as_of(known, grid.withColumnRenamed("as_of", "date")), "shuffleRecordsWritten")
    assert {r.date: r.shares for r in rows} == {dt.date(2021, 1, 1) + dt.timedelta(d): 1000 + (19600 + d) / 100 for d in range(400)}
    assert most <= 4000  # 400 days from each of 4 tasks, and the grid; all versions are 40,000


def overlapping(spark):
    """20,000 events (date, outcome_end, x), null dates and values among them, and 30 folds whose training sets are nested."""
    date = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 400).cast("int"))
    ev = spark.range(20000).select("id", F.when(F.col("id") % 97 > 0, date).alias("date"), F.date_add(date, 9).alias("outcome_end"), F.when(F.col("id") % 89 > 0, F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double")).alias("x"))
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    folds = [(i, day(0), day(90 + 10 * i), day(95 + 10 * i), day(110 + 10 * i)) for i in range(30)]
    return ev, spark.createDataFrame(folds, "fold long, train_start date, train_end date, test_start date, test_end date")


def test_events_are_counted_once_for_all_folds(spark):
    ev, folds = overlapping(spark)
    rows, most = most_rows(ST.robust_scores(ev, folds, "x"), "shuffleRecordsWritten")
    apart = ST.robust_scores(B.assign_folds(ev, folds), None, "x").collect()
    key = lambda r: (r.fold, r.id, r.score)
    assert sorted(map(key, rows), key=str) == sorted(map(key, apart), key=str) and len({r.fold for r in rows}) == 30
    assert most <= 20_000  # each event for each fold gives about 240,000


def test_unions_of_parts_have_the_quantiles_of_their_rows(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("p"), F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(2500))).cast("double").alias("x"))
    members = spark.createDataFrame([(g, p) for g, ps in (("a", [0]), ("b", [0, 1]), ("c", [0, 1, 2]), ("none", [7])) for p in ps], "g string, p long")
    points = {"lo": 0.0, "q": 0.37, "hi": 1.0, "near": 0.5}
    want = R.quantiles(df.join(members, "p"), ["g"], "x", points, ("near",), 64).collect()
    got = R.union_quantiles(df, ["p"], members, "g", "x", points, ("near",), 64).collect()
    assert sorted(got) == sorted(want) and len(got) == 3
    assert sorted(R.union_quantiles(df, ["p"], members, "g", "x", points, ("near",)).collect()) == sorted(want)


def test_quantile_groups_count_events_once_for_all_folds(spark):
    ev, folds = overlapping(spark)
    ev = ev.withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    rows, most = most_rows(ST.quantile_groups(ev, "x", "y", folds=folds), "shuffleRecordsWritten")
    assert sorted(rows) == sorted(ST.quantile_groups(B.assign_folds(ev, folds), "x", "y").collect()) and len(rows) == 30
    assert most <= 20_000


def test_lots_take_one_shuffle(spark):
    """Entries cross the network once, for lots and totals alike."""
    df = spark.range(1000).selectExpr("id % 7 AS account", "id % 3 AS symbol", "id AS seq", "CASE WHEN id % 4 = 3 THEN 'SELL' ELSE 'BUY' END AS type", "1.0D AS quantity", "cast(id AS double) AS price", "cast(null AS double) AS ratio")
    lots = L.fifo_lots(df.repartition(3))
    assert lots._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert lots.where("not oversold").count() > 0


def test_ledger_prices_are_summed_up_before_they_are_shuffled(spark):
    from asofkit.plans import registry

    plan = registry.QUERIES["l3_value_ledger"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "partial_max(struct(l_shipdate" in plan
