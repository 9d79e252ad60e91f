"""Outcomes that follow an event's own path. An event's rows are numbered and fetched by equality of entity and row
number, so only the paths of events are made, not those of all bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import change, rolling, series


def numbered_rows(bars: DataFrame, by: str = "date") -> DataFrame:
    """bars with _i, the row's number in its entity's series."""
    return bars.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy(by)))


def path_rows(events: DataFrame, bars: DataFrame, first: int, last: int, cols: list[str]) -> DataFrame:
    """events (id, entity, date, ...) x k = first ... last: columns of the entity's bar k rows after the event's own one
    (its date must be a session). Rows beyond the series are missing."""
    rows = numbered_rows(bars)
    at = events.join(rows.select("entity", "date", F.col("_i").alias("_at")), ["entity", "date"])
    each = at.withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("_i", F.col("_at") + F.col("k"))
    return each.join(rows.select("entity", "_i", *cols), ["entity", "_i"]).drop("_i", "_at")


def label_competing(events: DataFrame, bars: DataFrame, horizon: int = 126, history: int = 63, recovery_floor: float = -0.02, terminal_ceiling: float = -0.10) -> DataFrame:
    """By event (id, entity, date): which of two barriers, scaled by the volatility before the event, its closes touch
    first, and the kind of path that follows. RIGHT_CENSORED where the horizon has not passed; events without volatility
    are left out.

    Barriers are at least 5, 8 and 15 percent: 1.5 deviations over 21 rows below, 1.5 over 63 above, 2.5 over 63 for a
    structural break (fixed values).
    """
    vol = F.when(F.count("ret").over(series().rowsBetween(-(history - 1), 0)) >= history, F.stddev_samp("ret").over(series().rowsBetween(-(history - 1), 0)) * math.sqrt(252))
    priced = bars.select("entity", "date", "close").withColumn("ret", change("close", 1)).withColumn("vol", vol)
    ahead = series().rowsBetween(1, horizon)
    start = priced.withColumn("rows", F.count(F.lit(1)).over(ahead)).select("entity", "date", F.col("close").alias("base"), "vol", "rows")
    known = events.select("id", "entity", "date").join(start, ["entity", "date"]).where("vol > 0")
    barrier = lambda least, k, rows: F.greatest(F.lit(least), k * F.col("vol") * math.sqrt(rows / 252))
    known = known.withColumn("pullback", barrier(0.05, 1.5, 21)).withColumn("rise", barrier(0.08, 1.5, 63)).withColumn("structural", barrier(0.15, 2.5, 63))
    path = path_rows(known.where(F.col("rows") == horizon), bars, 1, horizon, [F.col("close").alias("c"), F.col("date").alias("d")])
    path = path.withColumn("rel", F.col("c") / F.col("base") - 1).withColumn("later", F.max("rel").over(Window.partitionBy("id").orderBy(F.desc("k"))))
    told = path.groupBy("id").agg(
        F.min(F.when(F.col("rel") <= -F.col("pullback"), F.col("d"))).alias("down"), F.min(F.when(F.col("rel") >= F.col("rise"), F.col("d"))).alias("up"),
        F.min("rel").alias("mae"), F.max("rel").alias("mfe"), F.max_by("rel", "k").alias("terminal"), F.max("d").alias("outcome_end"),
        F.min_by("later", F.struct("rel", "k")).alias("after_low"),
    )
    out = known.join(told, "id", "left")
    upside = F.col("up").isNotNull() & (F.col("down").isNull() | (F.col("up") < F.col("down")))
    censored = F.col("rows") < horizon
    first = F.when(censored, "RIGHT_CENSORED").when(upside, "UPSIDE_CONTINUATION").when(F.col("down").isNotNull(), "DOWNSIDE_PULLBACK").otherwise("NO_BOUNDARY")
    kind = (
        F.when(censored, "RIGHT_CENSORED")
        .when((F.col("mae") <= -F.col("structural")) & (F.col("terminal") <= terminal_ceiling), "STRUCTURAL_BREAK")
        .when(F.col("mae") <= -F.greatest(F.lit(0.10), F.col("pullback")), "LARGE_PULLBACK")
        .when((F.col("mae") <= -F.col("pullback")) & (F.col("after_low") >= recovery_floor), "TRADABLE_PULLBACK")
        .when(upside & (F.col("terminal") > 0), "CONTINUATION")
        .otherwise("UNRESOLVED")
    )
    return out.select("id", "entity", "date", first.alias("first_boundary"), F.when(upside, F.col("up")).otherwise(F.col("down")).alias("boundary_date"), kind.alias("terminal_path"), "mfe", "mae", "terminal", "outcome_end")


def weekly_path(events: DataFrame, weekly: DataFrame, horizons: tuple[int, ...] = (4, 8, 13, 26), falls: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """By event (id, entity, date on a weekly bar) and horizon: forward return, largest advance and decline, deepest
    drawdown on the way, weeks below the start, and whether the decline reached each of `falls` percent. Events whose
    longest horizon has not passed are left out."""
    longest = max(horizons)
    own = weekly.select("entity", F.col("date"), F.col("close").alias("base"))
    path = path_rows(events.select("id", "entity", "date").join(own, ["entity", "date"]), weekly, 1, longest, [F.col("close").alias("c")])
    upto = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("rel", F.col("c") / F.col("base") - 1).withColumn("drop", F.col("c") / F.greatest(F.col("base"), F.max("c").over(upto)) - 1)
    path = path.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("id"))).where(F.col("length") == longest)
    each = path.withColumn("horizon", F.explode(F.filter(F.array(*map(F.lit, horizons)), lambda h: h >= F.col("k"))))
    out = each.groupBy("id", "horizon").agg(F.max_by("rel", "k").alias("forward_return"), F.max("rel").alias("advance"), F.min("rel").alias("decline"), F.min("drop").alias("drawdown"), F.count_if(F.col("rel") < 0).alias("weeks_below"))
    return out.select("*", *((F.col("decline") <= -x / 100).alias(f"fell_{x}") for x in falls))


def reentry_ceiling(events: DataFrame, bars: DataFrame, horizon: int, fee: float, slippage: float, least_gain: float, least_run: int, most_advance: float) -> DataFrame:
    """By event (id, entity, date): the best gain in shares that selling at the next open and buying back at one of the
    `horizon` opens after it could give, net of costs; at any of them, and at one that begins a run of least_run opens of
    at least least_gain before which the price never rose above most_advance. Events short of opens are left out."""
    path = path_rows(events.select("id", "entity", "date"), bars, 1, horizon + 1, [F.col("open").alias("o")])
    whole = Window.partitionBy("id")
    in_order = whole.orderBy("k")
    path = path.withColumn("length", F.count(F.lit(1)).over(whole)).where(F.col("length") == horizon + 1).withColumn("sale", F.first("o").over(in_order)).where("k > 1")
    gain = F.col("sale") * (1 - slippage) * (1 - fee) / (F.col("o") * (1 + slippage) * (1 + fee)) - 1
    path = path.withColumn("wait", F.col("k") - 1).withColumn("gain", gain).withColumn("advance", F.max(F.col("o") / F.col("sale") - 1).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    run = in_order.rowsBetween(0, least_run - 1)
    path = path.withColumn("start", (F.count(F.lit(1)).over(run) == least_run) & (F.min("gain").over(run) >= least_gain) & (F.col("advance") <= most_advance))
    first_best = F.struct("gain", (-F.col("wait")).alias("w"))
    out = path.groupBy("id").agg(F.max(first_best).alias("best"), F.max(F.when(F.col("start"), first_best)).alias("bound"), F.count_if(F.col("gain") >= least_gain).alias("days"))
    return out.select(
        "id", (F.col("best.gain") > 0).alias("available"), F.greatest(F.col("best.gain"), F.lit(0.0)).alias("gain"), (-F.col("best.w")).alias("wait"),
        F.col("bound").isNotNull().alias("bound_available"), F.coalesce("bound.gain", F.lit(0.0)).alias("bound_gain"), (-F.col("bound.w")).alias("bound_wait"), "days",
    )


def first_damage(events: DataFrame, bars: DataFrame, context: DataFrame, low: int, mean: int, back: int, wait: int) -> DataFrame:
    """By event (id, entity, date): the first later session, at most `wait` rows on and with a session after it, that
    closes below the lowest of the `low` closes before and below its `mean`-row average, with a `back`-row return behind
    market and sector (context: entity, date, sector_close, market_close). Null where none does."""
    own = bars.select("entity", "date", "close").join(context.select("entity", "date", "sector_close", "market_close"), ["entity", "date"])
    past = F.min("close").over(series().rowsBetween(-low, -1))
    hit = (F.col("close") < past) & (F.col("close") < rolling("close", mean, mean, "mean")) & (change("close", back) < change("market_close", back)) & (change("close", back) < change("sector_close", back))
    flagged = own.withColumn("i", F.row_number().over(series())).withColumn("hit", hit & F.lead("close").over(series()).isNotNull())
    ahead = series().rowsBetween(1, wait)
    found = flagged.withColumn("at", F.min(F.when(F.col("hit"), F.struct("i", "date"))).over(ahead)).where(F.col("i") > max(low, mean, back))
    each = found.select("entity", "date", F.col("at.date").alias("damage_date"), (F.col("at.i") - F.col("i")).alias("wait"))
    return events.select("id", "entity", "date").join(each, ["entity", "date"], "left").select("id", "damage_date", "wait")


def success_label(opportunity: Column, terminal_path: Column) -> Column:
    """Economic label of an event from the path it took and whether buying back would have paid (fixed values)."""
    return F.when(terminal_path == "STRUCTURAL_BREAK", "STRUCTURAL_DAMAGE").when(F.coalesce(opportunity, F.lit(False)), "ECONOMIC_REBUY_OPPORTUNITY").when(terminal_path == "CONTINUATION", "HEALTHY_CONTINUATION").otherwise("NO_ECONOMIC_EDGE")
