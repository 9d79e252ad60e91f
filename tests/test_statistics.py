"""Statistics that SQL cannot express, against their definitions."""

import math
import random

import numpy as np

from asofkit.operators import stats as ST


def test_p_values_are_the_normal_tail_of_u(spark):
    rnd = random.Random(1)
    rows = [(rnd.gauss(0.3 * (i % 2), 1), i % 2) for i in range(200)]
    got = ST.with_p_values(ST.rank_biserial(spark.createDataFrame(rows, "x double, g int"), ["x"], "g")).first()
    one, zero = ([x for x, g in rows if g == k] for k in (1, 0))
    u = sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
    z = abs(u - len(one) * len(zero) / 2) / math.sqrt(len(one) * len(zero) * (len(rows) + 1) / 12)
    assert abs(got.u - u) < 1e-9 and abs(got.p - math.erfc(z / math.sqrt(2))) < 1e-12


def logistic(x, y, l2):
    """Newton's method for the sum of losses plus l2 / 2 of the squared weights, the intercept being free."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = l2 * np.diag([0.0, *[1.0] * (len(w) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
    return lambda v: 1 / (1 + np.exp(-np.column_stack([np.ones(len(v)), v]) @ w))


def test_fold_logistic_with_interaction_and_dropped_block(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((300, 2))
    y = (rnd.random(300) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] + x[:, 0] * x[:, 1])))).astype(int)
    rows = [(i, i % 2, "train" if i % 3 else "test", float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, fold int, role string, a double, b double, y int")
    whole, alone = ST.fold_logistic(df, ["a", "b"], "y", 1.0, interaction=("a", "b")), ST.fold_logistic(df, ["a", "b"], "y", 1.0, drop=("b",))
    for got, columns in ((whole, lambda v: np.column_stack([v, v[:, 0] * v[:, 1]])), (alone, lambda v: v[:, :1])):
        found = {r.id: r.score for r in got.collect()}
        for fold in (0, 1):
            train = np.array([i for i, f, role, *_ in rows if f == fold and role == "train"])
            test = np.array([i for i, f, role, *_ in rows if f == fold and role == "test"])
            want = logistic(columns(x[train]), y[train], 1.0)(columns(x[test]))
            assert max(abs(found[int(i)] - w) for i, w in zip(test, want)) < 1e-3


def test_quantiles_interpolate(spark):
    rows = [(k % 3, random.Random(k).randint(0, 20) / 4) for k in range(100)] + [(5, 1.0), (6, None)]
    got = {r.g: r for r in ST.quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    assert got.keys() == {0, 1, 2, 5}
    for g, r in got.items():
        values = [x for k, x in rows if k == g]
        assert np.allclose([r.a, r.m, r.z], np.quantile(values, [0.1, 0.5, 0.99]))


def test_bootstrap_weights_are_poisson_and_repeat(spark):
    entities = spark.range(2000).withColumnRenamed("id", "e")
    one, again = (ST.bootstrap_weights(entities.repartition(n), "e", 5, 7) for n in (1, 9))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, again.collect()))
    weights = [r[2] for r in rows]
    assert abs(sum(weights) / 10_000 - 1) < 0.05 and abs(1 - len(weights) / 10_000 - math.exp(-1)) < 0.03
