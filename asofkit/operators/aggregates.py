"""Grouped summaries of holdings, episodes, quality and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks as R


def aggregate_holdings(info: DataFrame, filing: str, security: str, value: str, identifier: str) -> DataFrame:
    """Holdings summed by filing and security, with the sorted distinct identifiers they were reported under."""
    return info.groupBy(filing, security).agg(F.sum(value).alias("value"), F.count("*").alias("rows"), F.array_sort(F.collect_set(identifier)).alias("identifiers"))


def concentration(positions: DataFrame, by: list[str], holder: str, value: str) -> DataFrame:
    """Breadth, shares of the largest one and five holders, and the sum of squared shares.

    Shares come from totals by group and a rank; the ranked rows of a group are cut to five before they are summed.
    """
    held = positions.groupBy(*by, holder).agg(F.sum(value).alias("v"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("v"), holder))
    top = held.withColumn("rank", rank).where("rank <= 5").groupBy(*by).agg(F.max("v").alias("top1"), F.sum("v").alias("top5"))
    total = held.groupBy(*by).agg(F.count("*").alias("breadth"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    return total.join(top, by).select(*by, "breadth", (F.col("top1") / F.col("total")).alias("top1_share"), (F.col("top5") / F.col("total")).alias("top5_share"), (F.col("squares") / (F.col("total") * F.col("total"))).alias("hhi"))


def slow_context(positions: DataFrame, security: str, period: str, holder: str, value: str) -> DataFrame:
    """By security and period ordinal: holders, and against the period before: new and exited ones, change of their
    number as a share, and change of the top-5 share and of the sum of squared shares.

    A security's first period has no changes. A later one whose forerunner had no holders counts all of its own as new
    and has no other change.
    """
    held = positions.select(security, period, holder).distinct()
    before = held.withColumn(period, F.col(period) + 1).withColumn("was", F.lit(1))
    both = held.withColumn("now", F.lit(1)).join(before, [security, period, holder], "full_outer")
    new, exited = F.count_if(F.col("was").isNull()), F.count_if(F.col("now").isNull())
    counts = both.groupBy(security, period).agg(F.count("now").alias("holders"), new.alias("new"), exited.alias("exited"), F.count("was").alias("before")).where("holders > 0")
    w = Window.partitionBy(security).orderBy(period)
    shares = concentration(positions, [security, period], holder, value).select(security, period, "top5_share", "hhi")
    out = counts.join(shares, [security, period]).withColumn("_first", F.lag(period).over(w).isNull())
    prior = lambda c: F.max(c).over(w.rangeBetween(-1, -1))
    known = lambda c: F.when(~F.col("_first"), c)
    return out.select(
        security, period, "holders", known(F.col("new")).alias("new"), known(F.col("exited")).alias("exited"), F.try_divide(F.col("holders") - F.col("before"), F.col("before")).alias("breadth_change"),
        (F.col("top5_share") - prior("top5_share")).alias("top5_change"), (F.col("hhi") - prior("hhi")).alias("hhi_change"),
    )


def dominant_owner(obs: DataFrame, identifier: str, owner: str, least: int = 20, share: float = 0.95, ratio: float = 10) -> DataFrame:
    """Identifiers that one owner holds with enough rows, share and distance to the second."""
    counts = obs.groupBy(identifier, owner).agg(F.count("*").alias("n"))
    w = Window.partitionBy(identifier)
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), owner))).withColumn("total", F.sum("n").over(w)).withColumn("second", F.lead("n").over(w.orderBy(F.desc("n"), owner)))
    return ranked.where((F.col("rank") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total")) & (F.col("n") >= ratio * F.coalesce("second", F.lit(0)))).select(identifier, owner, "n", "total")


def routine_status(events: DataFrame, actor: str, date: str) -> DataFrame:
    """Actor-months as ROUTINE (active in the same month of each of the three years before), NONROUTINE, or WARMUP
    (not active for three years yet)."""
    months = events.select(actor, F.year(date).alias("year"), F.month(date).alias("month")).distinct()
    first = events.groupBy(actor).agg(F.min(F.year(date)).alias("first_year"))
    w = Window.partitionBy(actor, "month").orderBy("year").rangeBetween(-3, -1)
    counted = months.withColumn("prior", F.count("*").over(w)).join(first, actor)
    status = F.when(F.col("year") - F.col("first_year") < 3, "WARMUP").when(F.col("prior") == 3, "ROUTINE").otherwise("NONROUTINE")
    return counted.select(actor, "year", "month", status.alias("status"))


def dependency_summary(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Episodes, entities, weeks, median outcomes and share of gains of a replay ledger by context."""
    sums = ledger.groupBy(*by).agg(F.count_distinct("entity", "date").alias("episodes"), F.count_distinct("entity").alias("entities"), F.count_distinct(F.date_trunc("week", "date")).alias("weeks"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"))
    medians = R.quantile_columns(ledger, by, {f"median_{c}": (F.col(c), 0.5) for c in ("ret", "mfe", "mae")})
    return R.with_columns(sums, medians, by)


def stage_context(ledger: DataFrame) -> DataFrame:
    """Summaries for all entities and for each, in one pass over the ledger."""
    sets = ledger.groupingSets([["stage", "horizon"], ["entity", "stage", "horizon"]], "entity", "stage", "horizon")
    return sets.agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"))


def cluster_concentration(episodes: DataFrame, top: int = 10) -> DataFrame:
    """Largest share of one week's episodes, and the share of the top weeks."""
    weeks = episodes.groupBy(F.date_trunc("week", "date").alias("week")).agg(F.count("*").alias("n"))
    total = weeks.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    best = weeks.orderBy(F.desc("n"), "week").limit(top).agg(F.sum("n").alias("top"))
    return total.join(best).select("total", (F.col("most") / F.col("total")).alias("max_share"), (F.col("top") / F.col("total")).alias("top_share"))


def audit_bars(bars: DataFrame, as_of, max_gap: int = 10, stale: int = 10) -> DataFrame:
    """Quality of each entity's bars: repeats, nulls, non-positive prices, broken bounds, largest gap, days since the
    last, and whether all is well."""
    w = Window.partitionBy("entity").orderBy("date")
    flagged = bars.withColumn("gap", F.date_diff("date", F.lag("date").over(w)))
    bad = F.col("low") > F.least("open", "close")
    bad = bad | (F.col("high") < F.greatest("open", "close"))
    count = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name)
    out = flagged.groupBy("entity").agg(
        F.count("*").alias("rows"), count(F.col("gap") == 0, "repeats"), count(F.col("close").isNull() | F.col("open").isNull(), "nulls"), count(F.least("open", "low", "close") <= 0, "nonpositive"),
        count(bad, "broken"), F.max("gap").alias("largest_gap"), F.date_diff(as_of, F.max("date")).alias("age"),
    )
    ok = (F.col("repeats") + F.col("nulls") + F.col("nonpositive") + F.col("broken") == 0) & (F.col("largest_gap") <= max_gap) & (F.col("age") <= stale)
    return out.withColumn("passed", ok)


def portfolio_daily(returns: DataFrame, by: list[str]) -> DataFrame:
    """Equal-weight return and members per portfolio and day."""
    return returns.groupBy(*by, "date").agg(F.avg("ret").alias("ret"), F.count_distinct("entity").alias("members"))


def return_metrics(returns: DataFrame, by: list[str], days: int = 252, benchmark: DataFrame | None = None) -> DataFrame:
    """Total and yearly return, deepest drawdown, and Sortino and Calmar ratios of daily returns (date, ret); with a
    benchmark (date, bench_ret), mean return over its mean on its rising and falling days.

    Wealth runs over one series per group; downside deviation is over all days (ddof 0).
    """
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    both = returns.withColumn("bench_ret", F.lit(None).cast("double")) if benchmark is None else returns.join(benchmark.select("date", "bench_ret"), "date", "left")
    wealth = both.withColumn("w", F.exp(F.sum(F.log1p("ret")).over(w))).withColumn("dd", F.col("w") / F.greatest(F.max("w").over(w), F.lit(1.0)) - 1)
    capture = lambda on: F.try_divide(F.avg(F.when(on, F.col("ret"))), F.avg(F.when(on, F.col("bench_ret"))))
    out = wealth.groupBy(*by).agg(
        F.count("*").alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"), F.min("dd").alias("drawdown"), F.avg("ret").alias("mean"), F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2)))).alias("down"),
        capture(F.col("bench_ret") > 0).alias("up_capture"), capture(F.col("bench_ret") < 0).alias("down_capture"),
    )
    yearly = F.pow(1 + F.col("total"), F.lit(float(days)) / F.col("n")) - 1
    return out.select(*by, "n", "total", yearly.alias("yearly"), "drawdown", F.try_divide(F.col("mean") * F.sqrt(F.lit(float(days))), F.col("down")).alias("sortino"), F.try_divide(yearly, F.abs("drawdown")).alias("calmar"), "up_capture", "down_capture")


def policy_summary(outcomes: DataFrame, by: list[str], col: str, cost: str) -> DataFrame:
    """By policy: events, median and mean of its delta, share of positive ones, and the 95th percentile of its cost."""
    sums = outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.avg((F.col(col) > 0).cast("double")).alias("positive"))
    return R.with_columns(sums, R.quantile_columns(outcomes, by, {"median": (F.col(col), 0.5), "p95_cost": (F.col(cost), 0.95)}), by)


def annual_rates(events: DataFrame, spans: DataFrame, limit: int) -> DataFrame:
    """Events per entity-year (years without any included): median, largest, and entity-years above the limit."""
    years = spans.select("entity", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year"))
    counts = years.join(events.groupBy("entity", F.year("date").alias("year")).agg(F.count("*").alias("n")), ["entity", "year"], "left")
    counts = counts.select(F.coalesce("n", F.lit(0)).alias("n"))
    sums = counts.agg(F.count("*").alias("entity_years"), F.max("n").alias("most"), F.sum((F.col("n") > limit).cast("int")).alias("above"))
    return R.with_columns(sums, R.quantile_columns(counts, [], {"median": (F.col("n"), 0.5)}), [])


def regime_context(panel: DataFrame, col: str, sector: str) -> DataFrame:
    """Median of a score by date over all entities and over each sector."""
    market = panel.groupBy("date").agg(F.percentile(col, F.lit(0.5)).alias("market"))
    return panel.groupBy("date", sector).agg(F.percentile(col, F.lit(0.5)).alias("sector_median")).join(market, "date")


def drift_metrics(pairs: DataFrame, by: list[str], shadow: str, live: str, tolerance: float) -> DataFrame:
    """Coverage, median and nearest-rank 95th percentile of the absolute error, and share beyond the tolerance."""
    err = F.abs(F.col(shadow) - F.col(live))
    sums = pairs.withColumn("err", err).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("err").isNotNull().cast("double")).alias("coverage"), F.avg((F.col("err") > tolerance).cast("double")).alias("beyond"))
    return R.with_columns(sums, R.quantile_columns(pairs, by, {"median_err": (err, 0.5), "p95_err": (err, 0.95)}, nearest=("p95_err",)), by)


def pivot_costs(outcomes: DataFrame, keys: list[str], cost: str, values: list[float], col: str) -> DataFrame:
    """One column per cost; the costs are given, so no extra pass finds them."""
    return outcomes.groupBy(*keys).pivot(cost, values).agg(F.first(col))
