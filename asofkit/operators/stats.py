"""Statistics on panels: rank tests, binary metrics, bootstrap, folds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks as R
from .bars import assign_folds
from .ranks import quantiles  # noqa: F401  (its home until now)


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.unpivot(keys, features, "feature", "x")


def rank_biserial(panel: DataFrame, features: list[str], group: str, by: list[str] = ()) -> DataFrame:
    """Mann-Whitney U of the rows where group is 1, and the rank-biserial effect, per feature (and per value of by)."""
    by = [*by, "feature"]
    each = unpivot(panel.select(group, *by[:-1], *(F.col(f).cast("double").alias(f) for f in features)), [group, *by[:-1]], features).where("x is not null")
    counts = each.groupBy(*by, F.col("x").alias("value")).agg(F.sum((F.col(group) == 1).cast("long")).alias("n1"), F.count("*").alias("n"))
    ranked = R.with_columns(counts, R.average_ranks(counts.select(*by, "value", "n"), by).select(*by, "value", "rank"), [*by, "value"])
    sums = ranked.groupBy(*by).agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n0"), F.sum(F.col("n1") * F.col("rank")).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select(*by, "n1", "n0", u.alias("u"), (F.try_divide(2 * u, F.col("n1") * F.col("n0")) - 1).alias("effect"))


def half_effects(panel: DataFrame, features: list[str], group: str, second: str, least: int = 5) -> DataFrame:
    """rank_biserial of all rows with the effects of both halves (second: whether a row lies in the later one; null with
    fewer than `least` rows on either side) and how many halves have the whole's direction."""
    whole = rank_biserial(panel, features, group)
    half = rank_biserial(panel.where(F.col(second).isNotNull()), features, group, [second])
    effect = lambda later: F.max(F.when((F.col(second) == later) & (F.least("n1", "n0") >= least), F.col("effect")))
    halves = half.groupBy("feature").agg(effect(False).alias("first_half"), effect(True).alias("second_half"))
    same = lambda c: F.coalesce(F.signum(c) == F.signum("effect"), F.lit(False)).cast("int")
    return whole.join(halves, "feature", "left").withColumn("same_direction", same("first_half") + same("second_half"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Two-sided normal tail of U (columns n1, n0, u); a vectorised helper over one row per test."""
    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        z = (u - n1 * n0 / 2).abs() / (n1 * n0 * (n1 + n0 + 1) / 12) ** 0.5
        return z.map(lambda x: math.erfc(x / math.sqrt(2)))

    return tests.withColumn("p", tail(F.col("u").cast("double"), F.col("n1").cast("double"), F.col("n0").cast("double")))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Holm's step-down adjustment of one p-value per row."""
    order = Window.orderBy(p, "feature")
    m = F.count("*").over(Window.partitionBy())
    raised = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("raised", raised).withColumn("adjusted", F.max("raised").over(order)).drop("raised")


def binary_metrics(preds: DataFrame, by: list[str], score: str, target: str) -> DataFrame:
    """ROC-AUC by average ranks, Brier score, log-loss and balanced accuracy at 0.5, from counts of distinct scores."""
    counts = preds.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("value")).agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    ranked = R.with_columns(counts, R.average_ranks(counts.select(*by, "value", "n"), by).select(*by, "value", "rank"), [*by, "value"])
    v, neg = F.col("value"), F.col("n") - F.col("pos")
    s = F.least(F.greatest(v, F.lit(1e-12)), F.lit(1 - 1e-12))
    out = ranked.groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum(neg).alias("q"), F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum(F.col("pos") * F.pow(1 - v, F.lit(2)) + neg * F.pow(v, F.lit(2))).alias("sq"),
        F.sum(-F.col("pos") * F.log(s) - neg * F.log(1 - s)).alias("ll"), F.sum(F.when(v >= 0.5, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(v < 0.5, neg).otherwise(0)).alias("tn"),
    )
    n = F.col("p") + F.col("q")
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return out.select(*by, n.alias("n"), auc.alias("auc"), (F.col("sq") / n).alias("brier"), (F.col("ll") / n).alias("log_loss"), ((F.try_divide("tp", "p") + F.try_divide("tn", "q")) / 2).alias("balanced"))


def exposure_effect(panel: DataFrame, by: list[str], exposed: str, target: str) -> DataFrame:
    """Rates of the target among exposed and other rows, their difference and ratio, and the exact chance that as many
    of the exposed are hit by lot (hypergeometric tail; a small helper over one row per group)."""
    rate = lambda e: F.avg(F.when(F.col(exposed) == e, F.col(target).cast("double")))
    both = lambda e: F.count_if((F.col(exposed) == e) & F.col(target).isNotNull())
    hits = lambda e: F.count_if((F.col(exposed) == e) & (F.col(target) == 1))
    out = panel.groupBy(*by).agg(F.count("*").alias("n"), rate(1).alias("exposed_rate"), rate(0).alias("control_rate"), both(1).alias("_n1"), both(0).alias("_n0"), hits(1).alias("_h1"), hits(0).alias("_h0"))

    @F.pandas_udf("double")
    def tail(n1: pd.Series, n0: pd.Series, h1: pd.Series, h0: pd.Series) -> pd.Series:
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        chance = lambda a, b, h, k: math.fsum(math.exp(choose(a, i) + choose(b, h - i) - choose(a + b, h)) for i in range(k, min(a, h) + 1) if h - i <= b)
        return pd.Series([min(1.0, chance(a, b, x + y, x)) if a and b else None for a, b, x, y in zip(n1, n0, h1, h0)])

    out = out.withColumn("difference", F.col("exposed_rate") - F.col("control_rate")).withColumn("ratio", F.try_divide("exposed_rate", "control_rate"))
    return out.withColumn("tail", tail("_n1", "_n0", "_h1", "_h0")).drop("_n1", "_n0", "_h1", "_h0")


def bootstrap_weights(entities: DataFrame, entity: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, entity, weight) of the entities that a replicate draws: Poisson(1) numbers by a hash of seed, replicate
    and entity, so they repeat on any cluster and need no numbering. The usual stand-in for drawing with replacement
    where entities are many."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(13):
        total += p
        steps.append(total)
        p /= k + 1
    each = entities.select(entity).where(F.col(entity).isNotNull()).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "replicate", F.col(entity).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    weight = sum(((F.col("u") >= t).cast("int") for t in steps[1:]), (F.col("u") >= steps[0]).cast("int"))
    return each.withColumn("u", u).withColumn("weight", weight).where("weight > 0").drop("u")


def cluster_bootstrap(panel: DataFrame, entity: str, exposed: str, target: str, replicates: int, seed: int, value: str | None = None, scores: tuple[str, str] | None = None) -> DataFrame:
    """Replicates over whole entities: the risk difference of exposed and other rows; with a value, the difference of its
    (lower) medians; with two scores, how far the AUC of the first exceeds that of the second.

    Rows are summed up by entity, or by entity and value, before they meet their weights.
    """
    weights = bootstrap_weights(panel, entity, replicates, seed)
    each = panel.groupBy(entity).agg(*(F.sum(F.when(F.col(exposed) == e, c)).alias(f"{name}{e}") for e in (0, 1) for name, c in (("n", F.lit(1)), ("t", F.col(target)))))
    s = weights.join(each, entity).groupBy("replicate").agg(*(F.sum(F.col("weight") * F.coalesce(c, F.lit(0))).alias(c) for c in ("n0", "t0", "n1", "t1")))
    out = s.select("replicate", (F.try_divide("t1", "n1") - F.try_divide("t0", "n0")).alias("difference"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if value:
        counts = panel.where(F.col(value).isNotNull() & F.col(exposed).isNotNull()).groupBy(entity, F.col(exposed).alias("_e"), F.col(value).alias("_v")).count()
        drawn = weights.join(counts, entity).groupBy("replicate", "_e", "_v").agg(F.sum(F.col("weight") * F.col("count")).alias("w"))
        group = Window.partitionBy("replicate", "_e")
        upto = F.sum("w").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        medians = drawn.withColumn("to", upto).withColumn("all", F.sum("w").over(group)).where("2 * to >= all").groupBy("replicate", "_e").agg(F.min("_v").alias("m"))
        gap = medians.groupBy("replicate").agg((F.max(F.when(F.col("_e") == 1, F.col("m"))) - F.max(F.when(F.col("_e") == 0, F.col("m")))).alias("median_gap"))
        out = out.join(gap, "replicate", "left")
    if scores:
        edge = None
        for name, score in zip(("a", "b"), scores):
            counts = panel.where(F.col(score).isNotNull() & F.col(target).isNotNull()).groupBy(entity, F.col(score).alias("_s")).agg(F.sum(F.col(target)).alias("p"), F.sum(1 - F.col(target)).alias("q"))
            drawn = weights.join(counts, entity).groupBy("replicate", "_s").agg(F.sum(F.col("weight") * F.col("p")).alias("p"), F.sum(F.col("weight") * F.col("q")).alias("q"))
            below = F.coalesce(F.sum("q").over(before(Window.partitionBy("replicate").orderBy("_s"))), F.lit(0))
            one = drawn.withColumn("below", below).groupBy("replicate").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias(name))
            edge = one if edge is None else edge.join(one, "replicate")
        out = out.join(edge.select("replicate", (F.col("a") - F.col("b")).alias("auc_edge")), "replicate", "left")
    return out


def percentile_interval(replicates: DataFrame, col: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return replicates.agg(F.count(col).alias("replicates"), F.percentile(col, F.lit(a)).alias("low"), F.percentile(col, F.lit(0.5)).alias("median"), F.percentile(col, F.lit(1 - a)).alias("high"))


def rank_ic(scores: DataFrame, by: list[str], score: str, forward: str, top: float = 0.8, bottom: float = 0.2) -> DataFrame:
    """Spearman correlation of a score with a forward outcome, and mean outcome of high minus low scores."""
    ranked = R.rank_correlation(scores.select(*by, F.col(score).alias("a"), F.col(forward).alias("b")), by)
    share, n = F.col("rank_a") / F.col("total"), F.col("n")
    mean = lambda on: F.try_divide(F.sum(F.when(on, n * F.col("b"))), F.sum(F.when(on, n)))
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), R.spearman().alias("ic"), (mean(share > top) - mean(share <= bottom)).alias("spread"))


def redundant(matrix: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """A Spearman matrix with, per pair, whether its rho reaches the threshold either way."""
    return matrix.withColumn("redundant", F.coalesce(F.abs("rho") >= threshold, F.lit(False)))


def spearman_matrix(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """(by, left, right, n, rho) of each pair of columns over rows where both exist; all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    each = df.select(*by, F.inline(F.array(*(F.struct(F.lit(i).alias("_pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for i, (a, b) in enumerate(pairs)))))
    rho = R.rank_correlation(each, [*by, "_pair"]).groupBy(*by, "_pair").agg(F.sum("n").alias("n"), R.spearman().alias("rho"))
    name = lambda side: F.get(F.array(*(F.lit(p[side]) for p in pairs)), F.col("_pair"))
    return rho.select(*by, name(0).alias("left"), name(1).alias("right"), "n", "rho")


def training_quantiles(events: DataFrame, folds: DataFrame | None, col: str, points: dict[str, float]) -> DataFrame:
    """(fold, points): quantiles of each fold's training rows, of events (date, outcome_end) that are in no fold yet, or of
    events (fold, role) without folds.

    Training sets of folds share most rows, so events are not copied for each fold: days are moved to the nearest edge of
    a fold that compares with all folds as they do, and the events between the same edges are one part of the folds.
    """
    if folds is None:
        return R.quantiles(events.where("role = 'train'"), ["fold"], col, points)
    edges = folds.agg(*(F.array_union(F.collect_set(a), F.collect_set(b)).alias(n) for n, a, b in (("_starts", "train_start", "test_start"), ("_ends", "train_end", "test_end"))))
    start = F.array_max(F.filter("_starts", lambda s: s <= F.col("date"))).alias("date")
    end = F.array_min(F.filter("_ends", lambda e: e >= F.col("outcome_end"))).alias("outcome_end")
    moved = events.select("date", "outcome_end", F.col(col).alias("_x")).join(F.broadcast(edges)).select(start, end, "_x").where("date is not null and outcome_end is not null")
    spans = edges.select(F.explode("_starts").alias("date"), "_ends").select("date", F.explode("_ends").alias("outcome_end"))
    members = assign_folds(spans, folds).where("role = 'train'").select("fold", "date", "outcome_end")
    return R.union_quantiles(moved, ["date", "outcome_end"], members, "fold", "_x", points)


def _test_rows(events: DataFrame, folds: DataFrame | None) -> DataFrame:
    return (events if folds is None else assign_folds(events, folds)).where("role = 'test'")


def robust_scores(events: DataFrame, folds: DataFrame | None, col: str, winsor: float = 0.01) -> DataFrame:
    """Test rows' values scaled by their fold's training rows: clipped at training quantiles, minus median, over IQR.
    events hold (date, outcome_end, col), or without folds (fold, role, col), as assign_folds gives them."""
    train = training_quantiles(events, folds, col, {"lo": winsor, "q1": 0.25, "med": 0.5, "q3": 0.75, "hi": 1 - winsor})
    clipped = F.least(F.greatest(F.col(col), F.col("lo")), F.col("hi"))
    return _test_rows(events, folds).join(F.broadcast(train), "fold").withColumn("score", F.try_divide(clipped - F.col("med"), F.col("q3") - F.col("q1"))).drop("lo", "q1", "med", "q3", "hi")


def quantile_groups(events: DataFrame, col: str, target: str, q: float = 0.8, block: str = "quarter", folds: DataFrame | None = None) -> DataFrame:
    """Per fold, rates of the target among test rows above and not above the training quantile, and the gap; and over
    the blocks of dates in which both groups occur, the mean of their gaps and how many are positive and negative.
    events as in robust_scores."""
    cut = training_quantiles(events, folds, col, {"cut": q})
    test = _test_rows(events, folds).join(F.broadcast(cut), "fold").withColumn("block", F.date_trunc(block, "date"))
    y = F.col(target).cast("double")
    sums = {"n1": F.count(F.when(F.col(col) > F.col("cut"), y)), "y1": F.sum(F.when(F.col(col) > F.col("cut"), y)), "n0": F.count(F.when(F.col(col) <= F.col("cut"), y)), "y0": F.sum(F.when(F.col(col) <= F.col("cut"), y)), "n": F.count("*")}
    blocks = test.groupBy("fold", "block").agg(*(c.alias(k) for k, c in sums.items())).withColumn("d", F.try_divide("y1", "n1") - F.try_divide("y0", "n0"))
    rate = lambda k: F.try_divide(F.sum(f"y{k}"), F.sum(f"n{k}"))
    out = blocks.groupBy("fold").agg(F.sum("n").alias("n"), rate(1).alias("treated"), rate(0).alias("control"), F.avg("d").alias("block_gap"), F.count_if(F.col("d") > 0).alias("positive_blocks"), F.count_if(F.col("d") < 0).alias("negative_blocks"))
    return out.withColumn("gap", F.col("treated") - F.col("control"))


def fold_logistic(events: DataFrame, features: list[str], target: str, l2: float, interaction: tuple[str, str] | None = None, drop: tuple[str, ...] = (), rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """Scores of each fold's test rows by an L2 logistic model (with an intercept that is not shrunk) of its training rows.

    All folds are fitted at once by Newton steps: a round is one aggregation of loss, gradient and k x k curvature sums by
    fold, and the small systems are solved on the driver; a step that raises the loss is halved. Training rows are kept
    (spilling to disk) until the fit ends. interaction adds the product of two features; drop leaves a block of features
    out, for ablations. Rows with a null feature are left out; a fold without training rows gives none.
    """
    import numpy as np

    inputs = [f for f in features if f not in drop]
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in inputs)]
    if interaction and not set(interaction) & set(drop):
        x.append(F.col(interaction[0]).cast("double") * F.col(interaction[1]).cast("double"))
    k, whole = len(x), F.lit(True)
    for c in x:
        whole = whole & c.isNotNull()
    ready = events.where(whole)
    train = ready.where("role = 'train'").where(F.col(target).isNotNull()).select("fold", F.col(target).cast("double").alias("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(x))).persist()
    spark, kind = events.sparkSession, events.schema["fold"].dataType.simpleString()
    names = [f"_w{i}" for i in range(k)]
    table = lambda w: F.broadcast(spark.createDataFrame([(f, *map(float, v)) for f, v in w.items()], f"fold {kind}, " + ", ".join(f"{n} double" for n in names)))
    linear = lambda columns: sum((F.col(n) * c for n, c in zip(names[1:], columns[1:])), F.col(names[0]) * columns[0])
    xs = [F.col(f"_x{i}") for i in range(k)]
    shrink = np.full(k, float(l2))
    shrink[0] = 0.0
    weights = {r.fold: np.zeros(k) for r in train.select("fold").distinct().collect()}
    before: dict = {f: (np.inf, w, np.zeros(k)) for f, w in weights.items()}
    open_ = set(weights)
    for _ in range(rounds if weights else 0):
        z = linear(xs)
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(F.exp(-F.abs(z)))
        sums = [F.sum(loss).alias("loss"), *(F.sum((p - F.col("_y")) * a).alias(f"g{i}") for i, a in enumerate(xs)), *(F.sum(p * (1 - p) * xs[i] * xs[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1))]
        for r in train.join(table({f: weights[f] for f in open_}), "fold").groupBy("fold").agg(*sums).collect():
            w = weights[r.fold]
            value = r["loss"] + 0.5 * float(shrink @ (w * w))
            last, start, step = before[r.fold]
            if value > last + 1e-12 * abs(last):
                step = step / 2
            else:
                h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(shrink) + 1e-12 * np.eye(k)
                start, step = w, -np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]) + shrink * w)
                before[r.fold] = (value, start, step)
            before[r.fold] = (before[r.fold][0], start, step)
            weights[r.fold] = start + step
            if np.abs(step).max() < tolerance:
                open_.discard(r.fold)
        if not open_:
            break
    train.unpersist()
    if not weights:
        return ready.where("false").withColumn("score", F.lit(None).cast("double"))
    scored = ready.where("role = 'test'").join(table(weights), "fold")
    return scored.withColumn("score", 1 / (1 + F.exp(-linear(x)))).drop(*names)


def cscv_pbo(history: DataFrame, splits: int = 6) -> DataFrame:
    """Probability of backtest overfitting over (candidate, block, score): for each choice of half the blocks as in-sample,
    the out-of-sample rank of the in-sample best; the choices are few and made as a table."""
    from itertools import combinations

    spark = history.sparkSession
    picks = [(k, b) for k, c in enumerate(combinations(range(splits), splits // 2)) for b in c]
    chosen = spark.createDataFrame(picks, "split int, block int").withColumn("inside", F.lit(1))
    every = spark.range(picks[-1][0] + 1).select(F.col("id").cast("int").alias("split"))
    both = history.crossJoin(F.broadcast(every)).join(F.broadcast(chosen), ["split", "block"], "left").groupBy("split", "candidate").agg(F.avg(F.when(F.col("inside") == 1, F.col("score"))).alias("is_score"), F.avg(F.when(F.col("inside").isNull(), F.col("score"))).alias("oos_score"))
    w = Window.partitionBy("split")
    best = both.withColumn("n", F.count("*").over(w)).withColumn("turn", F.row_number().over(w.orderBy(F.desc("is_score"), "candidate"))).withColumn("rank", F.rank().over(w.orderBy("oos_score"))).where("turn = 1")
    return best.agg(F.count("*").alias("splits"), F.avg((F.col("rank") / (F.col("n") + 1) <= 0.5).cast("double")).alias("pbo"))


def deflated_sharpe(returns: DataFrame, by: list[str], col: str, trials: int) -> DataFrame:
    """By group: observations, Sharpe ratio, the largest one expected of so many trials, and the probability that the
    ratio exceeds it, given skew and kurtosis. Null without three values or without spread. One row per group reaches
    the normal distribution's helper."""
    from statistics import NormalDist

    gamma, normal = 0.5772156649015329, NormalDist()
    expected = 0.0 if trials <= 1 else (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))
    m = returns.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd"), F.skewness(col).alias("skew"), (F.kurtosis(col) + 3).alias("kurt"))
    sharpe = F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("mean") / F.col("sd"))
    m = m.withColumn("sharpe", sharpe)
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) * F.col("sharpe") * F.col("sharpe") / 4))
    m = m.withColumn("z", (F.col("sharpe") - expected) * F.sqrt(F.col("n") - 1) / spread)

    @F.pandas_udf("double")
    def below(z: pd.Series) -> pd.Series:
        return z.map(lambda x: normal.cdf(x) if x == x else None)

    return m.select(*by, "n", "sharpe", F.lit(expected).alias("expected_max"), "z", below("z").alias("probability"))


def vif_pca(panel: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation and the first component's share from the correlation matrix, which Spark sums up; the k x k
    matrix is inverted on the driver."""
    import numpy as np

    clean = panel.select(*cols).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = clean.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()
    c = np.eye(len(cols))
    for a, b in pairs:
        c[cols.index(a), cols.index(b)] = c[cols.index(b), cols.index(a)] = row[f"{a}|{b}"]
    values = np.linalg.eigvalsh(c)
    vif = np.diag(np.linalg.inv(c))
    return panel.sparkSession.createDataFrame([(x, float(v), float(values[-1] / values.sum())) for x, v in zip(cols, vif)], "feature string, vif double, first_share double")
