"""Composite measures of price series: indicator history, timing scores, life-cycle states, event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join
from .paths import path_rows
from .windows import change, cross_rank, expanding_pct_rank, rolling, series, wilder_rsi


def week_end(d: Column) -> Column:
    """The Sunday that ends a date's week."""
    return F.date_add(d, F.pmod(7 - F.weekday(d) - 1, F.lit(7)).cast("int"))


def indicator_frame(bars: DataFrame, least: int = 20, rsi: int = 14, week_mean: int = 200) -> DataFrame:
    """(entity, date) with six indicators as percentiles (0-100) of their own history so far: weekly and monthly RSI and
    the weekly mean ratio, carried forward from the end of their week or month; position in the 52-week range, distance
    from the 200-row mean, and short over long volume."""
    year_low = rolling("low", 252, 252, "min")
    daily = bars.select(
        "entity", "date", F.try_divide(F.col("close") - year_low, rolling("high", 252, 252, "max") - year_low).alias("position_52w"),
        (F.try_divide("close", rolling("close", 200, 200, "mean")) - 1).alias("ma200_deviation"), F.try_divide(rolling("volume", 5, 5, "mean"), rolling("volume", 20, 20, "mean")).alias("volume_strength"),
    )
    last = lambda label: bars.where("close is not null").groupBy("entity", label.alias("date")).agg(F.max_by("close", "date").alias("close"))
    weekly, monthly = last(week_end(F.col("date"))), last(F.last_day("date"))
    ratio = weekly.select("entity", "date", F.try_divide("close", rolling("close", week_mean, week_mean, "mean")).alias("x"))
    out = daily.select("entity", "date")
    for name, source, n in (
        ("position_52w", daily, least), ("ma200_deviation", daily, least), ("volume_strength", daily, least),
        ("weekly_rsi", wilder_rsi(weekly, "close", rsi).withColumn("weekly_rsi", F.nanvl("rsi", F.lit(None))), 14), ("monthly_rsi", wilder_rsi(monthly, "close", rsi).withColumn("monthly_rsi", F.nanvl("rsi", F.lit(None))), 14),
        ("ma200_weekly", ratio.withColumn("ma200_weekly", F.col("x")), least),
    ):
        ranked = expanding_pct_rank(source, name, n).select("entity", "date", (100 * F.nanvl("pct", F.lit(None))).alias(name))
        if name in ("weekly_rsi", "monthly_rsi", "ma200_weekly"):
            out = asof_join(out, ranked.where(F.col(name).isNotNull()), ["entity"], "date", [name]).drop("matched_on")
        else:
            out = out.join(ranked, ["entity", "date"])
    return out


def timing_scores(bars: DataFrame, bench: DataFrame, rsi: int = 14) -> DataFrame:
    """Monthly scores (0-100) of price extension, trend maturity, relative overheat, participation and market risk, each
    the mean of cross-sectional ranks of measures at the last session of the month; bench (date, close) is one series.
    Also the month's close, 50-row mean and returns that the life-cycle states need."""
    daily = bars.select("entity", "date", "close", "volume").withColumn("ret", change("close", 1))
    daily = daily.withColumn("vol", F.when(rolling("ret", 63, 40, "std") > 0, rolling("ret", 63, 40, "std"))).withColumn("ma50", rolling("close", 50, 50, "mean")).withColumn("ma200", rolling("close", 200, 200, "mean"))
    low, high = rolling("close", 252, 126, "min"), rolling("close", 252, 126, "max")
    signed = F.when(F.col("ret") > 0, F.col("volume")).when(F.col("ret") < 0, -F.col("volume")).otherwise(F.lit(0.0))
    daily = daily.withColumn("signed", signed).withColumn("loss", F.when(F.col("ret").isNotNull(), F.least(F.col("ret"), F.lit(0.0))))
    each = daily.select(
        "entity", "date", "close", "ma50",
        ((F.try_divide("close", "ma50") - 1) / F.col("vol")).alias("d50"), ((F.try_divide("close", "ma200") - 1) / F.col("vol")).alias("d200"), F.try_divide(F.col("close") - low, high - low).alias("spot"),
        change("ma50", 63).alias("s50"), change("ma200", 63).alias("s200"),
        F.try_divide(rolling("signed", 63, 40, "sum"), rolling("volume", 63, 40, "sum")).alias("flow"), F.try_divide(rolling("volume", 20, 20, "mean"), rolling("volume", 120, 80, "mean")).alias("pace"),
        (F.col("close") > F.col("ma200")).cast("double").alias("above"), rolling("loss", 63, 40, "std").alias("loss_vol"), (F.try_divide("close", high) - 1).alias("drawdown"),
    )
    names = [c for c in each.columns if c not in ("entity", "date")]
    month = each.groupBy("entity", F.last_day("date").alias("month")).agg(*(F.expr(f"max_by(`{c}`, date) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in names))
    market = bench.groupBy(F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("m"))
    own, whole = Window.partitionBy("entity").orderBy("month"), Window.orderBy("month")  # the benchmark is calendar-sized
    past = lambda c, k, w: F.try_divide(F.col(c), F.lag(c, k).over(w)) - 1
    market = market.select("month", past("m", 3, whole).alias("m3"), past("m", 6, whole).alias("m6"), past("m", 12, whole).alias("m12"))
    strength = wilder_rsi(month.select("entity", F.col("month").alias("date"), "close"), "close", rsi, "ewm")
    steps = F.row_number().over(series()) - 1
    strength = strength.select("entity", F.col("date").alias("month"), F.when(steps >= rsi, F.nanvl("rsi", F.lit(None))).alias("rsi"))
    month = month.select("*", past("close", 3, own).alias("r3"), past("close", 6, own).alias("r6"), past("close", 12, own).alias("r12"), (F.try_divide(F.lag("close", 1).over(own), F.lag("close", 12).over(own)) - 1).alias("r12_1"))
    x = month.join(strength, ["entity", "month"]).join(market, "month", "left")
    x = x.withColumn("accel", F.col("r3") - F.col("r12") / 4).withColumn("rel6", F.col("r6") - F.col("m6")).withColumn("cooling", -(F.col("r3") - F.col("m3") - F.col("rel6") / 2)).withColumn("fall", -F.col("drawdown"))
    x = x.withColumn("breadth", F.avg("above").over(Window.partitionBy("month")))
    mean = lambda *cs: 100 * sum((cross_rank(c, ["month"]) for c in cs[1:]), cross_rank(cs[0], ["month"])) / len(cs)
    return x.select(
        "entity", "month", "close", "ma50", "r3", "r12", "m3", "m12",
        mean("d50", "d200", "rsi", "spot").alias("extension"), mean("r6", "r12_1", "s50", "s200", "accel").alias("trend"), mean("rel6", "cooling").alias("overheat"),
        (100 * (cross_rank("flow", ["month"]) + cross_rank("pace", ["month"]) + F.col("breadth")) / 3).alias("participation"), mean("loss_vol", "fall").alias("risk"),
    )


def rush_states(scores: DataFrame, least_extension: float = 75, least_slow: float = 0.2) -> DataFrame:
    """Life-cycle state per entity and month of timing_scores: NONE, HEALTHY_RUSH, EXTENDING_RUSH, EXHAUSTED_RUSH or
    BREAKING_RUSH, later rules winning (fixed values)."""
    w = Window.partitionBy("entity").orderBy("month")
    x = scores.withColumn("gap", F.col("r3") / 3 - F.col("r12") / 12).withColumn("ahead", F.col("r3") - F.col("m3")).withColumn("relative_gap", F.col("r3") - F.col("m3") - (F.col("r12") - F.col("m12")) / 4)
    x = x.withColumn("change", F.col("participation") - F.lag("participation", 3).over(w)).withColumn("gap_change", F.col("gap") - F.lag("gap").over(w))
    x = x.withColumn("eligible", F.coalesce((F.col("extension") >= least_extension) & (F.col("r12") > least_slow), F.lit(False)))
    x = x.withColumn("prior", F.coalesce(F.max("eligible").over(w.rowsBetween(-3, -1)), F.lit(False)))
    state = (
        F.when(F.col("prior") & (F.col("r3") < 0) & (F.col("close") < F.col("ma50")) & (F.col("ahead") < 0), "BREAKING_RUSH")
        .when(F.col("eligible") & (F.col("gap") < 0) & (F.col("gap_change") < 0) & (F.col("change") < 0) & (F.col("relative_gap") < 0), "EXHAUSTED_RUSH")
        .when(F.col("eligible") & (F.col("gap") >= 0) & (F.col("change") >= 0) & (F.col("relative_gap") >= 0), "EXTENDING_RUSH")
        .when(F.col("eligible"), "HEALTHY_RUSH")
        .otherwise("NONE")
    )
    return x.withColumn("state", state)


def path_measures(bars: DataFrame, context: DataFrame) -> DataFrame:
    """(entity, date) with relative extension over a year, trend deceleration (21 against 63 rows, only where the 126-row
    slope is positive), break of relative strength, and expansion of downside volatility. context: entity, date,
    sector_close."""
    own = bars.select("entity", "date", "close").join(context.select("entity", "date", "sector_close"), ["entity", "date"]).where("close > 0 and sector_close > 0")
    own = own.withColumn("ret", change("close", 1)).withColumn("_i", F.row_number().over(series()).cast("double")).withColumn("_y", F.log("close")).withColumn("loss", F.least("ret", F.lit(0.0)))
    own = own.withColumn("loss", F.when(F.col("ret").isNotNull(), F.col("loss")))
    slope = lambda n: F.when(F.count("_y").over(series().rowsBetween(-(n - 1), 0)) == n, F.regr_slope("_y", "_i").over(series().rowsBetween(-(n - 1), 0)))
    rel = lambda n: change("close", n) - change("sector_close", n)
    return own.select(
        "entity", "date", rel(252).alias("relative_extension"), F.when(slope(126) > 0, slope(63) - slope(21)).alias("trend_deceleration"), (rel(126) / 6 - rel(21)).alias("relative_break"),
        F.try_divide(rolling("loss", 20, 20, "std"), rolling("loss", 63, 63, "std")).alias("downside_expansion"),
    )


def event_price_features(events: DataFrame, bars: DataFrame, context: DataFrame) -> DataFrame:
    """By event (id, entity, date) with 127 bars behind it: share of the largest five gains in all gains, share of moves
    within and between sessions, close over volume-weighted price, trend quality (R-squared of a rising log line), and
    correlation with the sector. Computed on the events' own rows. bars: open, close, adj_close, volume; context: entity,
    date, sector_close."""
    factor = F.try_divide("adj_close", "close")
    rows = bars.join(context.select("entity", "date", "sector_close"), ["entity", "date"], "left").select(
        "entity", "date", "adj_close", "volume", change("adj_close", 1).alias("ret"), change("sector_close", 1).alias("sector_ret"), F.log(F.try_divide("adj_close", F.col("open") * factor)).alias("intraday"),
        F.log(F.try_divide(F.col("open") * factor, F.lag("adj_close").over(series()))).alias("overnight"), F.log("adj_close").alias("y"),
    )
    cols = ["adj_close", "volume", "ret", "sector_ret", "intraday", "overnight", "y"]
    path = path_rows(events.select("id", "entity", "date"), rows, -126, 0, cols)
    whole = Window.partitionBy("id")
    path = path.withColumn("rows", F.count(F.lit(1)).over(whole)).where("rows = 127")
    half, most = F.col("k") > -63, F.col("k") > -126
    total = lambda c, ok: F.sum(F.when(ok, c))
    moves = total(F.abs("intraday"), half) + total(F.abs("overnight"), half)
    path = path.withColumn("up", F.when(most & F.col("ret").isNotNull(), F.greatest("ret", F.lit(0.0)))).withColumn("place", F.row_number().over(whole.orderBy(F.desc_nulls_last("up"))))
    vwap = F.try_divide(total(F.col("adj_close") * F.col("volume"), most), total(F.col("volume"), most))
    slope, fit = F.regr_slope(F.when(most, F.col("y")), F.col("k")), F.regr_r2(F.when(most, F.col("y")), F.col("k"))
    both = F.when(half & F.col("ret").isNotNull() & F.col("sector_ret").isNotNull(), F.lit(1))
    return path.groupBy("id").agg(
        F.try_divide(F.sum(F.when(F.col("place") <= 5, F.col("up"))), F.sum("up")).alias("gain_concentration"), F.try_divide(total(F.col("intraday"), half), moves).alias("intraday_share"), F.try_divide(total(F.col("overnight"), half), moves).alias("overnight_share"),
        (F.max(F.when(F.col("k") == 0, F.col("adj_close"))) / vwap - 1).alias("overhang"), F.when(slope > 0, fit).otherwise(F.lit(0.0)).alias("trend_quality"),
        F.when(F.count(both) >= 40, F.corr(F.when(both == 1, F.col("ret")), F.when(both == 1, F.col("sector_ret")))).alias("sector_alignment"),
    )
