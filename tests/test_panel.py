"""Fixtures that pin single jobs, and the rule that the future may not move the past."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofkit.functions import scalars as S
from asofkit.operators import bars as B
from asofkit.operators import joins as J
from asofkit.operators import ledger as L
from asofkit.operators import membership as U
from asofkit.operators import outcomes as O
from asofkit.operators import stats as ST
from asofkit.operators import windows as W


def days(n, start="2020-01-01"):
    d = dt.date.fromisoformat(start)
    return [d + dt.timedelta(i) for i in range(n)]


@pytest.fixture(scope="module")
def series(spark):
    rows = [("a", d, 10.0 + i % 7, 12.0 + i % 7, 9.0 + i % 7, 11.0 + (i * 5) % 7, 1.0, float(i)) for i, d in enumerate(days(80))]
    return spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")


def test_stage_bounds(spark):
    values = [0, 14.99, 15.0, 39.99, 40.0, 59.99, 60.0, 74.99, 75.0, 100.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "s double")
    got = [tuple(r) for r in df.select(S.stage(F.col("s")), S.stage(F.col("s"), "legacy")).collect()]
    half = [S.STAGES[i] for i in (0, 0, 1, 1, 2, 2, 3, 3, 4, 4)]
    legacy = [S.STAGES[i] for i in (0, 0, 0, 1, 1, 2, 3, 3, 4, 4)]
    assert got == [*zip(half, legacy), (None, None)]


def test_weekly_bars_skip_nulls_and_hide_the_open_week(spark):
    rows = [("a", d, 1.0, 2.0, 0.5, float(i) if i != 3 else None, 1.0, 1.0) for i, d in enumerate(days(10, "2024-01-01"))]
    df = spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")
    week = B.weekly_bars(df.where("date <= '2024-01-04'")).first()
    assert week.week == dt.date(2024, 1, 5) and week.close == 2.0 and week.last_session == dt.date(2024, 1, 4)
    assert B.weekly_bars(df, F.lit("2024-01-10").cast("date")).count() == 1


@pytest.mark.parametrize("job", [
    lambda b: W.window_ranks(b.select("entity", "date", "close"), {"x": "close"}, 20, 5),
    lambda b: W.window_ranks(b.select("entity", "date", "close"), {"x": "close"}, 20, 5, prior=True),
    lambda b: W.rolling_trend(b, "close", 10).select("entity", "date", F.round("slope", 9)),
    lambda b: W.wilder_rsi(b, "close", 14).select("entity", "date", "rsi"),
    lambda b: W.expanding_pct_rank(b, "close").select("entity", "date", "pct"),
    lambda b: W.expanding_pct_rank(b, "close", prior=True).select("entity", "date", "pct"),
])
def test_the_future_does_not_move_the_past(series, job):
    cut = F.lit("2020-02-20").cast("date")
    late, early = job(series).where(F.col("date") <= cut), job(series.where(F.col("date") <= cut))
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))


def test_asof_strict_inclusive_and_age(spark):
    left = spark.createDataFrame([("a", dt.date(2020, 1, 5), 1), ("a", dt.date(2020, 3, 1), 2), ("b", dt.date(2020, 1, 1), 3)], "k string, t date, id int")
    right = spark.createDataFrame([("a", dt.date(2020, 1, 5), 10.0), ("a", dt.date(2020, 1, 5), 20.0), ("a", dt.date(2020, 1, 2), 5.0)], "k string, t date, v double")
    pick = lambda **o: {r.id: r.v for r in J.asof_join(left, right, ["k"], "t", ["v"], **o).collect()}
    assert pick() == {1: 20.0, 2: 20.0, 3: None}
    assert pick(strict=True) == {1: 5.0, 2: 20.0, 3: None}
    assert pick(max_age=10) == {1: 20.0, 2: None, 3: None}


def test_checked_join_refuses_repeated_keys(spark):
    one, two = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, b string")
    with pytest.raises(ValueError):
        J.checked_join(one, two, ["k"])
    assert J.checked_join(two, one, ["k"]).count() == 2


def test_collapse_depends_on_the_last_kept(spark):
    df = spark.createDataFrame([("a", d) for d in (dt.date(2020, 1, 1), dt.date(2020, 1, 4), dt.date(2020, 1, 5), dt.date(2020, 1, 9))], "k string, date date")
    assert [r.date.day for r in W.collapse(df, ["k"], 3).orderBy("date").collect()] == [1, 5, 9]
    reasons = {r.date.day: r.reason for r in W.budget(df, ["k"], 3, 2).collect()}
    assert reasons == {1: "kept", 4: "cooldown", 5: "kept", 9: "budget"}


def test_outcomes_enter_at_the_next_open(spark):
    rows = [("a", d, 100.0, 105.0, 95.0, 102.0, 102.0, 1.0) for d in days(30)]
    bars = spark.createDataFrame(rows, "entity string, date date, open double, high double, low double, close double, adj_close double, volume double")
    events = spark.createDataFrame([("a", days(30)[0]), ("a", days(30)[27])], "entity string, date date")
    got = O.replay_outcomes(events, bars, (5,)).collect()
    assert len(got) == 1 and got[0].ret == pytest.approx(0.02) and got[0].mfe == pytest.approx(0.05) and got[0].mae == pytest.approx(-0.05)


def test_membership_is_end_exclusive(spark):
    snap = spark.createDataFrame([(dt.date(2020, 1, 1), "a"), (dt.date(2020, 1, 1), "b"), (dt.date(2020, 1, 2), "a"), (dt.date(2020, 1, 3), "a"), (dt.date(2020, 1, 3), "b")], "date date, entity string")
    got = {(r.entity, r.valid_from.day, r.valid_to and r.valid_to.day) for r in U.membership_intervals(snap).collect()}
    assert got == {("a", 1, None), ("b", 1, 2), ("b", 3, None)}
    assert {r.entity for r in U.members_at(U.membership_intervals(snap), F.lit("2020-01-02").cast("date")).collect()} == {"a"}


def test_effective_holdings_after_amendments(spark):
    filings = spark.createDataFrame([(1, "m", 1, 1, "SNAPSHOT"), (2, "m", 1, 2, "ADD"), (3, "m", 1, 3, "EXCLUDE"), (4, "m", 1, 4, "REPLACE"), (5, "m", 1, 5, "REPLACE")], "filing int, manager string, period int, seq int, operation string")
    holdings = spark.createDataFrame([(1, "x", 10.0), (2, "x", 99.0), (2, "y", 5.0), (3, "z", 1.0), (4, "y", 7.0)], "filing int, security string, value double")
    got = {(r.filing, r.security, r.value) for r in U.effective_holdings(filings, holdings).collect()}
    assert got == {(1, "x", 10.0), (2, "x", 10.0), (2, "y", 5.0), (4, "y", 7.0)}


def test_fifo_lots_with_a_split_and_an_oversell(spark):
    rows = [("a", "s", 1, "BUY", 10.0, 100.0, None), ("a", "s", 2, "SPLIT", None, None, 2.0), ("a", "s", 3, "BUY", 10.0, 60.0, None), ("a", "s", 4, "SELL", 25.0, 70.0, None), ("b", "s", 1, "SELL", 1.0, 5.0, None)]
    df = spark.createDataFrame(rows, "account string, symbol string, seq int, type string, quantity double, price double, ratio double")
    got = {r.account: r for r in L.fifo_lots(df).collect()}
    assert got["a"].realised == pytest.approx(20 * 20 + 5 * 10) and got["a"].open_quantity == pytest.approx(5) and got["a"].cost == pytest.approx(300)
    assert got["b"].oversold and got["b"].realised is None


def test_auc_and_effect_agree(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "y int, s double").withColumn("g", F.lit("a"))
    assert ST.binary_metrics(df.withColumn("s", F.col("s") / 4), ["g"], "s", "y").first().auc == pytest.approx(0.875)
    assert ST.rank_biserial(df, ["s"], "y").first().effect == pytest.approx(0.75)


def test_valid_cusip(spark):
    df = spark.createDataFrame([("037833100",), ("037833101",), ("38259P508",), ("bad",), (None,)], "c string")
    assert [r[0] for r in df.select(S.valid_cusip(F.col("c"))).collect()] == [True, False, True, False, False]
