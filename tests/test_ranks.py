import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.operators import ranks as R
from asofkit.operators import stats as ST


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    out = [("big", None if rnd.random() < 0.03 else round(rnd.lognormvariate(0, 2), 3), rnd.random()) for _ in range(3000)]
    out += [("big", 7.0, rnd.random()) for _ in range(1500)]  # a third of the group is one value
    out += [(None, float(rnd.randint(-5, 5)), rnd.random()) for _ in range(200)]
    return out + [("one", 3.0, 0.5), ("none", None, 0.1), ("pair", 1.0, None), ("pair", 2.0, 0.2)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(5)


@pytest.mark.parametrize("sample", [R.SAMPLE, 100, 7])
def test_ranks_and_quantiles_by_definition(df, rows, sample):
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    pdf["g"] = pdf.g.fillna("null")
    pdf["rank"] = pdf.groupby("g").x.rank()
    want = {(g, x): (r, n) for (g, x), r, n in zip(*(lambda d: (d.index, d["min"], d["count"]))(pdf.dropna(subset=["x"]).groupby(["g", "x"])["rank"].agg(["min", "count"])))}
    got = {(r.g or "null", r.value): (r["rank"], r.n) for r in R.average_ranks(R.count_values(df, ["g"], "x"), ["g"], sample).collect()}
    assert got == want
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    for r in R.quantiles(df, ["g"], "x", points, sample=sample).collect():
        mine = pdf[pdf.g == (r.g or "null")].x.dropna()
        assert [r[k] for k in points] == pytest.approx([mine.quantile(q) for q in points.values()])
    near = {r.g or "null": r.p for r in R.quantiles(df, ["g"], "x", {"p": 0.95}, ("p",), sample).collect()}
    assert near == {g: np.sort(d.x.dropna())[max(0, int(np.ceil(0.95 * d.x.count())) - 1)] for g, d in pdf.dropna(subset=["x"]).groupby("g")}


def test_all_columns_and_no_groups(df, rows):
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    got = R.quantile_columns(df, [], {"m x": (F.col("x"), 0.5), "m.y": (F.col("y"), 0.9)}, sample=50).collect()
    assert [got[0]["m x"], got[0]["m.y"]] == pytest.approx([pdf.x.median(), pdf.y.quantile(0.9)])
    assert R.quantiles(df.where("false"), ["g"], "x", {"m": 0.5}).collect() == [] and R.average_ranks(R.count_values(df.where("false"), [], "x"), []).collect() == []
    both = R.with_columns(df.groupBy("g").agg(F.count("*").alias("n")), R.quantiles(df, ["g"], "x", {"m": 0.5}), ["g"])
    assert {r.g: r.m for r in both.collect()}[None] == pdf[pdf.g.isna()].x.median() and {r.g: r.m for r in both.collect()}["none"] is None


def test_rank_correlation(df, rows):
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    got = {(r.g, r["left"], r["right"]): (r.n, r.rho) for r in ST.spearman_matrix(df, ["x", "y"], ["g"]).collect()}
    big = pdf[pdf.g == "big"].dropna()
    assert got["big", "x", "y"][0] == len(big) and got["big", "x", "y"][1] == pytest.approx(big.x.rank().corr(big.y.rank()))
    assert got["one", "x", "y"] == (1, None)


def test_halves_of_an_effect(spark):
    rnd = random.Random(2)
    rows = [(rnd.gauss(0.8 * t * (1 if i < 200 else -1), 1), t, i >= 200) for i in range(400) for t in (i % 2,)]
    r = ST.half_effects(spark.createDataFrame(rows, "x double, t int, late boolean"), ["x"], "t", "late").first()
    assert r.first_half > 0.2 and r.second_half < -0.2 and r.same_direction == 1 and (r.n1, r.n0) == (200, 200)
    few = ST.half_effects(spark.createDataFrame(rows[:6], "x double, t int, late boolean"), ["x"], "t", "late").first()
    assert few.first_half is None and few.second_half is None and few.same_direction == 0


def test_lots_of_one_account_take_linear_time(spark):
    """A frame that reaches to the end would be evaluated anew for each row."""
    import time

    from asofkit.operators import ledger as L

    n = 30_000
    df = spark.range(n).selectExpr("1 AS account", "'a' AS symbol", "id AS seq", "CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS type", "1.0D AS quantity", "cast(id AS double) AS price", "cast(null AS double) AS ratio")
    began = time.time()
    row = L.fifo_lots(df).first()
    assert time.time() - began < 60 and row.realised == pytest.approx(n / 2) and row.open_quantity == 0


def test_a_large_group_stays_spread_over_tasks(spark):
    """Its values get their ranges where they are; values of small groups are shuffled by group."""
    df = spark.range(40000).selectExpr("CASE WHEN id < 20000 THEN 'big' WHEN id < 39990 THEN NULL ELSE concat('g', id) END AS g", "cast(pmod(xxhash64(id), 1000003) AS double) AS x")
    counts = R.count_values(df, ["g"], "x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = R._located(counts, ["g"], 1000).withColumn("task", F.spark_partition_id()).groupBy("g", "task").agg(F.count("*").alias("n"), F.countDistinct("_b").alias("b")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("big", None):
        mine = [r for r in rows if r.g == g]
        assert sum(r.n for r in mine) > 19000 and max(r.n for r in mine) < 8000 and max(r.b for r in mine) > 200
    assert sum(r.n for r in rows if r.g not in ("big", None)) == 10
