"""Matched controls against the definition, and batches of matured outcomes."""

import datetime as dt
import random
from collections import defaultdict


from asofkit.operators import joins as J
from asofkit.operators import membership as U
from asofkit.streaming import jobs as SS


def test_controls_are_the_nearest_unused_ones(spark):
    rnd = random.Random(2)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    treated = [(i, i % 3, day(rnd.randint(0, 300)), rnd.random()) for i in range(30)]
    pool = [(100 + i, i % 4, day(rnd.randint(0, 300)), rnd.random()) for i in range(80)]
    schema = "id long, g long, date date, x double"
    got = {(r.g, r.id): (r.control_id, r.gap) for r in J.match_controls(spark.createDataFrame(treated, schema), spark.createDataFrame(pool, schema), ["g"], "x", 0.2, 14).collect()}
    want, used = {}, defaultdict(set)
    for i, g, d, x in sorted(treated, key=lambda t: (t[1], t[2], t[0])):
        free = [(abs(cx - x), cd, c) for c, cg, cd, cx in pool if cg == g and c not in used[g] and not any(0 <= (cd - td).days <= 14 for _, tg, td, _ in treated if tg == g)]
        if free and min(free)[0] <= 0.2:
            gap, _, c = min(free)
            used[g].add(c)
            want[g, i] = (c, gap)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    # Treated and controls may be parts of one table.
    both = spark.createDataFrame(treated, schema)
    assert J.match_controls(both.where("id % 2 = 0"), both.where("id % 2 = 1"), ["g"], "x", 1.0, -1).count() > 0


def test_matured_outcomes_are_appended_once(spark, tmp_path):
    bar = lambda n: spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=k), 100.0 + k, 101.0 + k, 99.0 + k, 100.5 + k) for k in range(n)], "entity string, date date, open double, high double, low double, close double")
    seen = [spark.createDataFrame([(k, "a", dt.date(2020, 1, 1 + k))], "id long, entity string, date date") for k in range(3)]
    now = [8]
    step = SS.mature_stream(seen[0], lambda: bar(now[0]), str(tmp_path), (5,))
    for number, n in enumerate((5, 8, 9)):
        now[0] = n
        step(seen[number], number)
        step(seen[number], number)  # a batch that runs again changes nothing
    out = spark.read.parquet(str(tmp_path / "outcomes")).orderBy("id").collect()
    assert [(r.id, r.batch, r.entry) for r in out] == [(0, 1, 101.0), (1, 1, 102.0), (2, 2, 103.0)]


def test_transitions_move_both_boundaries(spark):
    d = dt.date
    iv = spark.createDataFrame([(1, "A", d(2020, 1, 1), d(2020, 3, 1)), (1, "B", d(2020, 5, 1), d(2021, 1, 1)), (2, "A", d(2020, 1, 1), d(2020, 2, 1))], "id long, symbol string, valid_from date, valid_to date")
    t = spark.createDataFrame([(1, "A", "B", d(2020, 4, 10)), (2, "A", "C", d(2020, 4, 10))], "id long, old string, new string, effective date")
    got = {(r.id, r.symbol): (r.valid_from, r.valid_to, r.repairs) for r in U.apply_transitions(iv, t).collect()}
    assert got == {(1, "A"): (d(2020, 1, 1), d(2020, 4, 9), 1), (1, "B"): (d(2020, 4, 10), d(2021, 1, 1), 1), (2, "A"): (d(2020, 1, 1), d(2020, 2, 1), 0)}
