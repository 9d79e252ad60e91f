import os

import pytest

from asofkit.operators import stats as ST
from asofkit.plans import registry, studies

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_every_fold_is_fitted_and_scored(spark):
    tests = {tuple(r) for r in studies.fold_events(spark, DATA).where("role = 'test'").select("fold", "o_orderkey").collect()}
    got = [(r.fold, r.o_orderkey) for r in registry.QUERIES["st8_fold_logistic"](spark, DATA).collect()]
    assert sorted(got) == sorted(tests) and len({f for f, _ in got}) > 3


def test_newton_steps_reach_the_optimum_of_each_fold(spark):
    """As Spark's own optimiser finds it, one fold at a time."""
    import random

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rnd = random.Random(6)
    rows = [(f, "train" if rnd.random() < 0.7 else "test", i, rnd.gauss(f, 2), rnd.random(), int(rnd.random() < 0.3 + 0.1 * f)) for f in range(3) for i in range(200)]
    rows += [(0, "train", 900, None, 0.1, 1), (2, "test", 901, 1.0, None, 0), (0, "train", 902, 50.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "fold long, role string, id long, x double, z double, y int")
    got = {(r.fold, r.id): r.score for r in ST.fold_logistic(df, ["x", "z"], "y", 1.0, interaction=("x", "z")).collect()}
    ready = VectorAssembler(inputCols=["x", "z", "xz"], outputCol="f").transform(df.dropna().withColumn("xz", df.x * df.z))
    want = {}
    for fold in range(3):
        train = ready.where(f"fold = {fold} and role = 'train'")
        model = LogisticRegression(featuresCol="f", labelCol="y", regParam=1.0 / train.count(), standardization=False, maxIter=200, tol=1e-12).fit(train)
        want |= {(fold, r.id): r.s for r in model.transform(ready.where(f"fold = {fold} and role = 'test'")).select("id", vector_to_array("probability")[1].alias("s")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert ST.fold_logistic(df.where("false"), ["x"], "y", 1.0).collect() == []
