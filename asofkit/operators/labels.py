"""Scores, states and transition labels of weekly panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stage
from .bars import week_label
from .windows import change, cross_rank, rolling, series, window_ranks


def row_median(a: Column, b: Column) -> Column:
    """Median of two columns that skips nulls."""
    return F.coalesce((a + b) / 2, a, b)


#: Transition labels in the order of their rules, and the direction of those that have one (fixed values).
TRANSITIONS = ("BREAKING", "RECOVERING", "COOLING", "EXTENDING", "FALLING", "STABILIZING", "PLATEAU", "NEUTRAL", "UNKNOWN")
POSITIVE = ("EXTENDING", "RECOVERING")
NEGATIVE = ("COOLING", "BREAKING", "FALLING")
HIGHLIGHTED = ("COOLING", "BREAKING", "RECOVERING")
FAMILIES = ("extension", "trend", "relative", "participation")


def state_measures(bars: DataFrame, context: DataFrame) -> DataFrame:
    """(entity, date) with nine raw measures: two each of extension, trend, relative position and participation, and
    downside risk. context (entity, date, sector_close, market_close, breadth) is aligned to the entity's own dates."""
    own = bars.select("entity", "date", "close", "volume").join(context.select("entity", "date", "sector_close", "market_close", "breadth"), ["entity", "date"], "left")
    step = own.withColumn("ret", change("close", 1))
    step = step.withColumn("signed", F.coalesce(F.signum("ret"), F.lit(0.0)) * F.col("volume")).withColumn("loss", F.when(F.col("ret") < 0, F.col("ret")))
    year = 252**0.5
    deviation = rolling("ret", 63, 63, "std") * year
    calm = F.when(deviation.isNotNull(), F.greatest(deviation, F.lit(0.05)))
    high, low = rolling("close", 252, 252, "max"), rolling("close", 252, 252, "min")
    log = lambda x, y: F.when(F.try_divide(x, y) > 0, F.log(F.try_divide(x, y)))
    past = lambda c, k: F.lag(c, k).over(series())
    gain = lambda c: log(F.col(c), past(c, 126))
    return step.select(
        "entity", "date",
        (log(F.col("close"), rolling("close", 200, 200, "mean")) / calm).alias("x1"),
        F.try_divide(F.col("close") - low, high - low).alias("x2"),
        (log(F.col("close"), past("close", 126)) / calm).alias("t1"), (log(F.col("close"), past("close", 252)) / calm).alias("t2"),
        (gain("close") - gain("sector_close")).alias("r1"), (gain("sector_close") - gain("market_close")).alias("r2"),
        F.try_divide(rolling("signed", 63, 63, "sum"), rolling("volume", 63, 63, "sum")).alias("p1"), F.col("breadth").alias("p2"),
        F.round(rolling("loss", 63, 20, "std") * year, 12).alias("d1"),
    )


def state_panel(bars: DataFrame, context: DataFrame, n: int, least: int) -> DataFrame:
    """Weekly state: each raw measure's trailing percentile (0-100) among the last n rows, medians by family, the mean of
    the four families as score, its stage, and downside risk as context. Weeks that lack a family are left out."""
    names = ("x1", "x2", "t1", "t2", "r1", "r2", "p1", "p2", "d1")
    ranked = window_ranks(state_measures(bars, context), {f"q{c}": c for c in names}, n, least)
    pair = lambda a: F.round(100 * row_median(F.col(f"q{a}1"), F.col(f"q{a}2")), 9)
    daily = ranked.select("entity", "date", pair("x").alias("extension"), pair("t").alias("trend"), pair("r").alias("relative"), pair("p").alias("participation"), (100 * F.col("qd1")).alias("risk"))
    weekly = daily.groupBy("entity", week_label(F.col("date")).alias("week")).agg(*(F.expr(f"max_by({c}, date) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in (*FAMILIES, "risk")), F.max("date").alias("last_session"))
    score = sum((F.col(c) for c in FAMILIES[1:]), F.col(FAMILIES[0])) / len(FAMILIES)
    return weekly.withColumn("score", F.round(score, 9)).where("score is not null").withColumn("stage", stage(F.col("score")))


def transition_raw(panel: DataFrame, short: int = 4, memory: int = 13, moderate: float = 5, severe: float = 10, family: float = 5, moderate_votes: int = 2, severe_votes: int = 3) -> DataFrame:
    """Raw label of each week by eight ordered rules over the score, its change over `short` weeks, the families that
    rose or fell by `family`, and the extremes of the last `memory` weeks; UNKNOWN until all of these are observed."""
    w = Window.partitionBy("entity").orderBy("week")
    delta = lambda c: F.round(F.col(c) - F.lag(c, short).over(w), 9)
    recent, full = w.rowsBetween(-(memory - 1), 0), F.count("score").over(w.rowsBetween(-(memory - 1), 0)) >= memory
    votes = lambda hit: sum((F.coalesce(hit(F.col(f"d_{c}")), F.lit(False)).cast("int") for c in FAMILIES[1:]), F.coalesce(hit(F.col(f"d_{FAMILIES[0]}")), F.lit(False)).cast("int"))
    out = panel.withColumn("delta", delta("score")).withColumns({f"d_{c}": delta(c) for c in FAMILIES})
    out = out.withColumn("up", votes(lambda d: d >= family)).withColumn("down", votes(lambda d: d <= -family))
    out = out.withColumn("peak", F.when(full, F.max("score").over(recent))).withColumn("floor", F.when(full, F.min("score").over(recent)))
    seen = F.col("peak").isNotNull()
    for c in ("delta", *(f"d_{f}" for f in FAMILIES)):
        seen = seen & F.col(c).isNotNull()
    rise, score, still = F.col("delta"), F.col("score"), F.abs("delta") < moderate
    rules = [
        (F.col("peak") >= 75) & (rise <= -severe) & (F.col("down") >= severe_votes),
        (F.col("floor") <= 40) & (rise >= severe) & (F.col("up") >= severe_votes),
        (score >= 60) & (rise <= -moderate) & (F.col("down") >= moderate_votes),
        (score >= 60) & (rise >= moderate) & (F.col("up") >= moderate_votes),
        (score <= 40) & (rise <= -moderate) & (F.col("down") >= moderate_votes),
        (score <= 40) & still,
        (score >= 60) & still,
    ]
    label = F.when(~seen, "UNKNOWN")
    for name, rule in zip(TRANSITIONS, rules):
        label = label.when(rule, name)
    return out.withColumn("raw", label.otherwise("NEUTRAL")).drop(*(f"d_{c}" for c in FAMILIES))


def stabilise(labels: list[str], confirm: int, cooldown: int, state: tuple | None = None) -> tuple[list[str], list[bool], tuple]:
    """Stable labels, whether a direction was suppressed, and the state to go on from.

    A label without direction passes. One with a direction counts once it came `confirm` times on end, and not within
    `cooldown` rows after the last one of the opposite direction that counted; else it reads NEUTRAL. The state is (rows
    seen, last label, times on end, last direction, its row).
    """
    i, before, run, way, at = state or (0, None, 0, None, -1)
    out, held_back = [], []
    for label in labels:
        run, before = run + 1 if label == before else 1, label
        now = 1 if label in POSITIVE else -1 if label in NEGATIVE else None
        blocked = now is not None and run >= confirm and way is not None and now != way and i - at <= cooldown
        counts = now is not None and run >= confirm and not blocked
        if counts:
            way, at = now, i
        out.append(label if now is None or counts else "NEUTRAL")
        held_back.append(blocked)
        i += 1
    return out, held_back, (i, before, run, way, at)


def stabilize_labels(panel: DataFrame, confirm: int = 2, cooldown: int = 4) -> DataFrame:
    """(entity, week, raw) with the stabilised label, whether a direction was suppressed, and whether a highlighted label
    begins. Sequential, so one small pass per entity."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("week")
        label, suppressed, _ = stabilise(part["raw"].tolist(), confirm, cooldown)
        return part.assign(label=label, suppressed=suppressed)

    done = panel.select("entity", "week", "raw").groupBy("entity").applyInPandas(run, "entity string, week date, raw string, label string, suppressed boolean")
    before = F.lag("label").over(Window.partitionBy("entity").orderBy("week"))
    return done.withColumn("event", F.col("label").isin(*HIGHLIGHTED) & ~F.col("label").eqNullSafe(before))


def evidence_scores(bars: DataFrame, carry: int = 3) -> DataFrame:
    """entity, month, participation, trend_relative_strength, risk: three monthly scores of 0 to 100, null while a part is.

    All entities stand on one calendar (every day with a bar of any), closes carried over at most `carry` days without
    one and volumes 0. participation: 0.4 x rank of the month's mean of short over long volume, signed by the day's move,
    and 0.6 x the market's breadth (entities above their 200-row mean, and up over 63 rows). trend_relative_strength:
    halves of the rank of the return from 12 months to 1 month ago and of the distance from the 200-row mean. risk:
    halves of the reversed rank of downside volatility and of the distance from the 252-row high.
    """
    calendar = bars.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row a day
    entities = bars.select("entity").distinct()
    own = Window.partitionBy("entity").orderBy("date")
    # The calendar is one row a day, so every entity's rows are spelt out beside it.
    days = calendar.agg(F.sort_array(F.collect_list("date")).alias("_days"))
    grid = entities.join(F.broadcast(days)).select("entity", F.explode("_days").alias("date")).join(bars.select("entity", "date", "close", "volume"), ["entity", "date"], "left")
    grid = grid.withColumn("close", F.last("close", ignorenulls=True).over(own.rowsBetween(-carry, 0))).withColumn("volume", F.coalesce(F.col("volume").cast("double"), F.lit(0.0)))
    mean200 = rolling("close", 200, 200, "mean", own)
    move = change("close", 1, own)
    daily = grid.select(
        "entity", "date", "close",
        (F.coalesce((F.col("close") > mean200).cast("int"), F.lit(0)) + F.coalesce((change("close", 63, own) > 0).cast("int"), F.lit(0))).alias("votes"),
        (F.try_divide(rolling("volume", 20, 20, "mean", own), rolling("volume", 120, 120, "mean", own)) * F.when(move != 0, F.signum(move))).alias("confirmed"),
        (F.try_divide(F.col("close"), mean200) - 1).alias("own_trend"),
        F.when(move < 0, move).otherwise(0.0).alias("fall"),
        (F.try_divide(F.col("close"), rolling("close", 252, 126, "max", own)) - 1).alias("drawdown"),
    )
    daily = daily.withColumn("downside", rolling("fall", 63, 40, "std", own))
    market = daily.groupBy("date").agg((50 * F.avg("votes")).alias("breadth")).groupBy(F.last_day("date").alias("month")).agg(F.max_by("breadth", "date").alias("breadth"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)
    month = daily.groupBy("entity", F.last_day("date").alias("month")).agg(*(last(c) for c in ("close", "own_trend", "downside", "drawdown")), F.avg("confirmed").alias("confirmed"))
    ordinal = Window.partitionBy("entity").orderBy(F.year("month") * 12 + F.month("month"))
    before = lambda k: F.max("close").over(ordinal.rangeBetween(-k, -k))
    month = month.withColumn("momentum", F.try_divide(before(1), before(12)) - 1)
    rank = lambda c: 100 * cross_rank(c, ["month"])
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)))
    ranked = month.select("entity", "month", "own_trend", "drawdown", rank("confirmed").alias("confirmed"), rank("momentum").alias("momentum"), rank("downside").alias("downside")).join(F.broadcast(market), "month")
    return ranked.select(
        "entity", "month", clip(0.4 * F.col("confirmed") + 0.6 * F.col("breadth")).alias("participation"),
        (0.5 * F.col("momentum") + 0.5 * clip(50 + 250 * F.col("own_trend"))).alias("trend_relative_strength"),
        (0.5 * (100 - F.col("downside")) + 0.5 * clip(100 + 250 * F.col("drawdown"))).alias("risk"),
    )


def market_context(bench: DataFrame, n: int = 63, least: int = 756, lag: int = 21, stress: float = -0.10) -> DataFrame:
    """(date, close) of a benchmark with the share of its past volatilities (given `least` of them) that are at most the
    present one, the drawdown from the n-row high, whether it rose over `lag` rows from a drawdown of `stress` or deeper,
    and its n-row return. The benchmark is one series, calendar-sized."""
    from .windows import expanding_pct_rank

    one = bench.select(F.lit("market").alias("entity"), "date", F.col("close").cast("double").alias("close"))
    out = one.withColumn("ret", change("close", 1)).withColumn("vol", rolling("ret", n, n, "std") * F.sqrt(F.lit(252.0))).withColumn("drawdown", F.try_divide(F.col("close"), rolling("close", n, n, "max")) - 1)
    out = out.withColumn("rebound", F.coalesce((change("close", lag) > 0) & (F.lag("drawdown", lag).over(series()) <= stress), F.lit(False))).withColumn("return", change("close", n))
    ranked = expanding_pct_rank(out.select("entity", "date", "vol"), "vol", least, prior=True).select("date", F.nanvl("pct", F.lit(None)).alias("volatility_percentile"))
    return out.join(ranked, "date").select("date", "close", "volatility_percentile", "drawdown", "rebound", "return")


def event_flags(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Month-end flags by entity and month: trend resumption after a shallow fall, dislocation with a falling market,
    extension of three average true ranges above the 200-row mean, and the month in which the quarter's return falls
    behind the year's pace. bench: date, close. Rates and spans are fixed values."""
    before = F.lag("close").over(series())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    daily = bars.withColumn("tr", F.coalesce(tr, F.col("high") - F.col("low"))).select(
        "entity", "date", change("close", 21).alias("r21"), change("close", 63).alias("r63"), change("close", 252).alias("r252"), (F.try_divide("close", rolling("close", 21, 21, "max")) - 1).alias("fall"),
        F.try_divide(F.col("close") - rolling("close", 200, 200, "mean"), rolling("tr", 63, 40, "mean")).alias("reach"),
    )
    last = lambda c: F.expr(f"max_by({c}, date) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    month = daily.groupBy("entity", F.last_day("date").alias("month")).agg(*map(last, ("r21", "r63", "r252", "fall", "reach")))
    market = bench.select("date", (F.try_divide("close", F.lag("close", 21).over(Window.orderBy("date"))) - 1).alias("m21"))  # one series, calendar-sized
    x = month.join(market.groupBy(F.last_day("date").alias("month")).agg(last("m21")), "month", "left")
    w = Window.partitionBy("entity").orderBy("month")
    x = x.withColumn("pace", F.col("r63") - F.col("r252") / 4)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return x.select(
        "entity", "month", flag((F.col("r252") > 0) & F.col("fall").between(-0.20, -0.05) & (F.col("r21") > 0) & (F.lag("r21").over(w) <= 0)).alias("resumption"),
        flag(F.col("fall").between(-0.25, -0.08) & (F.col("m21") < 0) & (F.col("r21") - F.col("m21") > -0.10)).alias("dislocation"), flag(F.col("reach") >= 3).alias("extended"),
        flag((F.col("pace") < 0) & (F.lag("pace").over(w) >= 0)).alias("decelerated"),
    )


def factor_residuals(bars: DataFrame, context: DataFrame, n: int, month: int = 21) -> DataFrame:
    """Residual of an entity's return on the market's and the sector's excess return by least squares over the n rows
    before the current one: closed form from windowed sums (context: entity, date, market, sector_excess). Also the parts
    of the return that the factors explain, and over the last `month` rows the sum of residuals and their volatility
    against the return's."""
    r = bars.select("entity", "date", change("close", 1).alias("y")).join(context, ["entity", "date"]).where("y is not null and market is not null and sector_excess is not null").withColumnRenamed("market", "a").withColumnRenamed("sector_excess", "b")
    w = series().rowsBetween(-n, -1)
    s = lambda x, y: F.covar_pop(x, y).over(w)
    m = lambda x: F.avg(x).over(w)
    moments = r.select("*", F.count("y").over(w).alias("n"), *(s(x, y).alias(f"s{x}{y}") for x, y in (("a", "a"), ("b", "b"), ("a", "b"), ("a", "y"), ("b", "y"))), *(m(x).alias(f"m{x}") for x in "aby"))
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    beta = F.try_divide(F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab"), F.when(F.abs(det) > 1e-18, det))
    gamma = F.try_divide(F.col("sby") * F.col("saa") - F.col("say") * F.col("sab"), F.when(F.abs(det) > 1e-18, det))
    fitted = F.col("my") + F.col("beta") * (F.col("a") - F.col("ma")) + F.col("gamma") * (F.col("b") - F.col("mb"))
    return moments.withColumn("beta", F.when(F.col("n") >= n, beta)).withColumn("gamma", F.when(F.col("n") >= n, gamma)).withColumn("residual", F.col("y") - fitted).withColumn("market_part", F.col("beta") * F.col("a")).withColumn("sector_part", F.col("gamma") * F.col("b")).select(
        "entity", "date", "beta", "gamma", "residual", "market_part", "sector_part",
        rolling("residual", month, month, "sum").alias("residual_sum"), F.try_divide(rolling("residual", month, month, "std"), rolling("y", month, month, "std")).alias("volatility_ratio"),
    )


def feature_deltas(events: DataFrame, weekly: DataFrame, cols: list[str], k: int) -> DataFrame:
    """events (entity, week) with the k-week change of weekly features."""
    w = Window.partitionBy("entity").orderBy("week")
    changes = weekly.select("entity", "week", *((F.col(c) - F.lag(c, k).over(w)).alias(f"{c}_delta") for c in cols))
    return events.join(changes, ["entity", "week"], "left")


def rsi_events(weekly: DataFrame, high: float = 70, higher: float = 80, low: float = 60, weeks: int = 4) -> DataFrame:
    """(entity, date, rsi) as events of overheating episodes: ENTRY on a crossing of `high` from below, ESCALATION on one
    of `higher`, PERSISTENCE once the episode has `weeks` rows and stands at its level, DECELERATION at the first two
    falls on end, COOLING on a crossing of `low` from above, which ends it. One small state machine per entity."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, x) for d, x in part.sort_values("date")[["date", "rsi"]].itertuples(index=False) if x is not None and x == x]
        level, since, told, out, episode = None, 0, set(), [], 0
        for i in range(1, len(rows)):
            (d, x), y = rows[i], rows[i - 1][1]
            events = []
            if level is None:
                if y < high <= x:
                    level, since, told, episode = high, i, set(), episode + 1
                    events.append("ENTRY")
            else:
                if level < higher and y < higher <= x:
                    level = higher
                    events.append("ESCALATION")
                if i - since + 1 >= weeks and x >= level:
                    events.append("PERSISTENCE")
                if i >= 2 and x < y < rows[i - 2][1]:
                    events.append("DECELERATION")
                if y >= low > x:
                    level = None
                    events.append("COOLING")
            for e in events:
                if e not in ("PERSISTENCE", "DECELERATION") or e not in told:
                    told.add(e)
                    out.append((d, e, episode))
        return pd.DataFrame(out, columns=["date", "event", "episode"]).assign(entity=part["entity"].iloc[0])[["entity", "date", "event", "episode"]]

    return weekly.select("entity", "date", "rsi").groupBy("entity").applyInPandas(run, "entity string, date date, event string, episode long")


def vote_episodes(votes: DataFrame, enter: int = 2, leave: int = 1, patience: int = 4) -> DataFrame:
    """(entity, date, votes) to episodes: `enter` votes open one, `patience` rows on end of at most `leave` close it."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        start, calm, out, last = None, 0, [], None
        for d, v in part.sort_values("date")[["date", "votes"]].itertuples(index=False):
            last = d
            if start is None:
                if v >= enter:
                    start, calm = d, 0
                continue
            calm = calm + 1 if v <= leave else 0
            if calm == patience:
                out.append((start, d, True))
                start = None
        if start is not None:
            out.append((start, last, False))
        return pd.DataFrame(out, columns=["start", "end", "closed"]).assign(entity=part["entity"].iloc[0])[["entity", "start", "end", "closed"]]

    return votes.groupBy("entity").applyInPandas(run, "entity string, start date, end date, closed boolean")
