"""Forward joins, reactions, intervals, positions and coverage by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators import aggregates as A
from asofkit.operators import identity as I
from asofkit.operators import joins as J
from asofkit.operators import membership as U
from asofkit.operators import windows as W
from asofkit.sources import readers as R

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_forward_asof(spark):
    left = spark.createDataFrame([("a", DAY(1), 1), ("a", DAY(5), 2), ("a", DAY(9), 3), ("b", DAY(1), 4), (None, DAY(1), 5)], "k string, date date, id int")
    right = spark.createDataFrame([("a", DAY(5), 10), ("a", DAY(5), 11), ("a", DAY(8), 12), (None, DAY(2), 13)], "k string, date date, v int")
    got = {r.id: (r.matched_on, r.v) for r in J.asof_forward(left, right, ["k"], "date", ["v"]).collect()}
    assert got == {1: (DAY(5), 11), 2: (DAY(5), 11), 3: (None, None), 4: (None, None), 5: (DAY(2), 13)}
    near = {r.id: r.v for r in J.asof_forward(left, right, ["k"], "date", ["v"], max_ahead=3).collect()}
    assert near[1] is None and near[2] == 11


@pytest.mark.parametrize("strict", [True, False])
def test_spans_of_a_long_key_give_the_same_rows(spark, strict):
    rnd = random.Random(8)
    key = lambda: rnd.choice(["hot", "hot", "hot", "b", None])
    left = spark.createDataFrame([(key(), DAY(rnd.randint(0, 400)), i) for i in range(400)] + [("hot", None, 900)], "k string, date date, id int")
    right = spark.createDataFrame([(key(), DAY(rnd.randint(0, 300)), rnd.randint(0, 9)) for _ in range(80)], "k string, date date, v int")
    rows = lambda days, age: sorted((tuple(r) for r in J.asof_join(left, right, ["k"], "date", ["v"], strict, age, days).collect()), key=lambda r: r[2])
    for age in (None, 40):
        want = rows(None, age)
        assert rows(7, age) == want == rows(1000, age) and sum(r[-1] is not None for r in want) > 100


def test_reactions_before_and_after_the_open(spark):
    sessions = [DAY(k) for k in range(0, 20) if DAY(k).weekday() < 5]
    bars = spark.createDataFrame([("a", d) for d in sessions], "entity string, date date")
    at = lambda *x: dt.datetime(*x)
    events = [(1, at(2024, 1, 3, 14, 29)), (2, at(2024, 1, 3, 14, 30)), (3, at(2024, 1, 5, 23, 0)), (4, at(2024, 1, 6, 15, 0)), (5, at(2024, 1, 4, 3, 0)), (6, at(2024, 1, 1, 6, 0)), (7, at(2024, 1, 18, 15, 0)), (8, None)]
    df = spark.createDataFrame([(i, "a", t) for i, t in events], "id int, entity string, t timestamp")
    got = {r.id: (r.base and r.base.day, r.end and r.end.day) for r in J.reaction_sessions(df, bars, "t").collect()}
    # 14:29 UTC is 09:29 in New York; 03:00 UTC is the evening before, after that day's open.
    assert got == {1: (2, 5), 2: (3, 8), 3: (5, 10), 4: (5, 10), 5: (3, 8), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_days_within_intervals_of_any_length(spark):
    rnd = random.Random(1)
    iv = [(rnd.randint(0, 3), DAY(a), DAY(a + rnd.choice([0, 3, 63, 64, 65, 300, 5000, 40_000])), n) for n in range(80) for a in [rnd.randint(-3000, 3000)]] + [(0, DAY(5), DAY(4), 900), (0, None, DAY(4), 901)]
    ev = [(i, rnd.randint(0, 4), DAY(rnd.randint(-3000, 9000))) for i in range(300)] + [(301, 0, None)]
    e, v = spark.createDataFrame(ev, "id int, k int, d date"), spark.createDataFrame(iv, "k int, valid_from date, valid_to date, v int")
    for closed in (True, False):
        got = sorted((r.id, r.v) for r in J.within_intervals(e, v, "k", "d", ["v"], closed).collect())
        want = sorted((i, n) for i, k, d in ev if d for kk, a, b, n in iv if a and k == kk and a <= d and (d <= b if closed else d < b))
        assert got == want


def test_position_starts_with_the_fold(spark):
    closes = [10, 20, 12, 15, 9, 30, 6, 8]
    bars = spark.createDataFrame([("a", DAY(k), float(c)) for k, c in enumerate(closes)], "entity string, date date, close double")
    folds = spark.createDataFrame([(1, DAY(2), DAY(4)), (2, DAY(5), DAY(9))], "fold int, test_start date, test_end date")
    seen = spark.createDataFrame([("a", DAY(k), "RUSH" if k == 3 else "CALM") for k in (0, 2, 3, 4, 6, 7)], "entity string, date date, stage string")
    got = {r.date: (r.fold, round(r.gain, 4), round(r.peak_gain, 4), round(r.drawdown, 4), round(r.given_back, 4), r.recent_rush) for r in W.giveback(seen, bars, folds, "close", "stage", rows=2).collect()}
    assert got == {
        DAY(2): (1, 0.0, 0.0, 0.0, 0.0, False), DAY(3): (1, 0.25, 0.25, 0.0, 0.0, True), DAY(4): (1, -0.25, 0.25, -0.4, 2.0, True),
        DAY(6): (2, -0.8, -0.8, 0.0, 0.0, False), DAY(7): (2, round(8 / 30 - 1, 4), round(8 / 30 - 1, 4), 0.0, 0.0, False),
    }
    late = spark.createDataFrame([("a", DAY(9), "CALM")], "entity string, date date, stage string")
    with pytest.raises(Exception, match="lacks a bar"):
        W.giveback(late, bars, folds, "close").collect()


def test_changes_of_holders_and_concentration(spark):
    rows = [("s", 1, "x", 6.0), ("s", 1, "y", 2.0), ("s", 2, "x", 4.0), ("s", 2, "z", 4.0), ("s", 4, "x", 1.0), ("t", 2, "x", 1.0)]
    got = {(r.sec, r.p): tuple(r)[2:] for r in A.slow_context(spark.createDataFrame(rows, "sec string, p long, h string, v double"), "sec", "p", "h", "v").collect()}
    assert got["s", 1] == (2, None, None, None, None, None) and got["t", 2] == (1, None, None, None, None, None)
    assert got["s", 2][:5] == (2, 1, 1, 0.0, 0.0) and got["s", 2][5] == pytest.approx(0.5 - 40 / 64)
    assert got["s", 4] == (1, 1, 0, None, None, None)  # nobody held it in the period before


def test_variants_are_merged_before_the_pick(spark):
    obs = [("i", "AAA", 1, "F1", 1, 10), ("i", "AAA", 1, "", 1, 11), ("i", "AAA", 2, "F1", 1, 12), ("i", "AAA", 2, "F2", 1, 13), ("i", "AAA", 2, "F2", 2, 14), ("j", "BBB", 5, "", 1, 15), ("j", "BBB", 7, "", 1, 16)]
    df = spark.createDataFrame(obs, "issuer string, symbol string, number int, code string, period int, filing int")
    got = {(r.symbol, r.period): (r.number, r.code, r.filings, r.rows) for r in I.primary_security(df, "symbol", "period", "issuer", "number", "code", "filing").collect()}
    assert got == {("AAA", 1): (2, "", 2, 3), ("AAA", 2): (2, "", 1, 3), ("BBB", 1): (7, "", 1, 1)}


def test_survivorship(spark):
    schema = "entity string, exit_reason string, source string, sector string"
    rows = [("a", "active", "s", "t"), ("b", "merged", "s", "t"), ("b", "merged", "s", "t"), ("c", "bankrupt", "s", "t")]
    fixed = spark.createDataFrame([("a",), ("d",), ("a",)], "entity string")
    r = U.survivorship_coverage(spark.createDataFrame(rows, schema), fixed, least_gone=2).first()
    assert (r.fixed, r.records, r.historical, r.gone, r.coverage, r.status) == (2, 4, 3, 2, 1.5, "POINT_IN_TIME_READY")
    assert [tuple(e) for e in r.exits] == [("bankrupt", 1), ("merged", 2)]
    assert U.survivorship_coverage(spark.createDataFrame([*rows, ("e", "merged", None, "t")], schema), fixed, 2).first().status == "SURVIVORSHIP_BIAS_REMAINS"
    assert U.survivorship_coverage(spark.createDataFrame([], schema), fixed).first().status == "SURVIVORSHIP_BIAS_REMAINS"


def test_digest_follows_rows_not_their_order(spark):
    rows = [("k", i, i % 5) for i in range(3000)]
    one = lambda r: R.fingerprint(spark.createDataFrame(r, "k string, at int, v int"), ["k"], ["at", "v"], "at", F.lit(2500)).first()
    a, b, c = one(rows), one(rows[::-1]), one([*rows[:-1000], ("k", 2000, 4), *rows[-999:]])
    assert a == b and a.rows == 2501 and a.digest != c.digest


def test_outcomes_that_must_not_overlap(spark):
    rnd = random.Random(4)
    rows = [(k, DAY(s), DAY(s + rnd.randint(0, 9))) for k in "ab" for s in [rnd.randint(0, 80) for _ in range(60)]] + [("a", None, DAY(3))]
    got = sorted(tuple(r) for r in I.non_overlapping(spark.createDataFrame(rows, "k string, s date, e date"), ["k"], "s", "e").collect())
    want = []
    for k in "ab":
        last = None
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k and s):
            if last is None or s > last:
                want.append((k, s, e))
                last = e
    assert got == want
