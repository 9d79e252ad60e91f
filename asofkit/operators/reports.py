"""Reports over events, panels and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks as R
from .joins import within_intervals
from .stats import spearman_matrix


def accuracy_report(events: DataFrame, axes: list[str], horizons: list[str]) -> DataFrame:
    """By axis, its value and horizon: completed samples, hit rate in percent, means of return, drawdown and delta; the
    axis `all` sums up everything. events hold hit_<h>, return_<h>, drawdown_<h> and delta_<h>, null while open."""
    sides = F.array(F.struct(F.lit("all").alias("axis"), F.lit("all").alias("value")), *(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))
    spans = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"hit_{h}").cast("double").alias("hit"), F.col(f"return_{h}").alias("ret"), F.col(f"drawdown_{h}").alias("drawdown"), F.col(f"delta_{h}").alias("delta")) for h in horizons))
    each = events.select(F.explode(sides).alias("s"), spans.alias("spans")).select("s.axis", "s.value", F.inline("spans"))
    done = F.col("hit").isNotNull()
    mean = lambda c: F.avg(F.when(done, F.col(c)))
    return each.groupBy("axis", "value", "horizon").agg(F.count("hit").alias("samples"), (100 * mean("hit")).alias("hit_rate"), mean("ret").alias("return_mean"), mean("drawdown").alias("drawdown_mean"), mean("delta").alias("delta_mean"))


def stability_summary(panel: DataFrame, families: list[str], gates: dict[str, float]) -> DataFrame:
    """One row over a panel (entity, sector, week, score, stage, families): its measures, and for each gate whether it
    holds. Gates: least_entities, least_rows, least_span, least_flee, least_rush, most_jumps, most_spearman,
    most_sector_spread."""
    jumps = panel.withColumn("jump", F.round(F.abs(F.col("score") - F.lag("score").over(Window.partitionBy("entity").orderBy("week"))), 9))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    whole = jumps.agg(
        F.count("*").alias("rows"), share(F.col("stage") == "FLEE").alias("flee"), share(F.col("stage") == "RUSH").alias("rush"), share(F.col("jump") >= 25).alias("jumps")
    )
    span = R.quantiles(panel, [], "score", {"low": 0.01, "high": 0.99}).select((F.col("high") - F.col("low")).alias("span"))
    rows = panel.groupBy("entity").count()
    per_entity = R.with_columns(rows.agg(F.count("*").alias("entities")), R.quantiles(rows, [], "count", {"median_rows": 0.5}), [])
    per_sector = R.quantiles(panel, ["sector"], "score", {"m": 0.5}).agg((F.max("m") - F.min("m")).alias("sector_spread"))
    rho = spearman_matrix(panel, families, []).where(F.col("left") != F.col("right")).agg(F.max(F.abs("rho")).alias("spearman"))
    one = R.with_columns(whole, span, []).crossJoin(per_entity).crossJoin(per_sector).crossJoin(rho)  # one row each
    tests = {
        "least_entities": F.col("entities") >= gates["least_entities"], "least_rows": F.col("median_rows") >= gates["least_rows"], "least_span": F.col("span") >= gates["least_span"], "least_flee": F.col("flee") >= gates["least_flee"],
        "least_rush": F.col("rush") >= gates["least_rush"], "most_jumps": F.col("jumps") <= gates["most_jumps"], "most_spearman": F.col("spearman") <= gates["most_spearman"], "most_sector_spread": F.col("sector_spread") <= gates["most_sector_spread"],
    }
    passed = F.lit(True)
    for t in tests.values():
        passed = passed & F.coalesce(t, F.lit(False))
    return one.select("*", *(t.alias(f"ok_{name}") for name, t in tests.items()), passed.alias("passed"))


def coverage_audit(obs: DataFrame, cohort: DataFrame, dates: DataFrame, intervals: DataFrame) -> DataFrame:
    """By entity of a cohort (entity, symbol): expected dates, those on which one of its symbols was observed, those
    linked to exactly one id by an interval (symbol, id, valid_from, valid_to), coverages and status. Symbols that
    several entities claim count for none. No grid of entities and dates is made."""
    expected = dates.select("date").distinct()
    n = expected.agg(F.count("*").alias("expected"))
    owned = cohort.select("entity", "symbol").distinct().withColumn("owners", F.count("*").over(Window.partitionBy("symbol"))).where("owners = 1").drop("owners")
    seen = obs.select("symbol", "date").distinct().join(expected, "date", "left_semi").join(owned, "symbol")
    linked = within_intervals(seen, intervals, "symbol", "date", ["id"]).groupBy("entity", "date").agg(F.count_distinct("id").alias("ids")).where("ids = 1")
    observed = seen.groupBy("entity").agg(F.count_distinct("date").alias("observed"), F.min("date").alias("first"), F.max("date").alias("last"))
    verified = linked.groupBy("entity").agg(F.count("*").alias("linked"))
    out = cohort.select("entity").distinct().join(observed, "entity", "left").join(verified, "entity", "left").crossJoin(F.broadcast(n)).fillna(0, ["observed", "linked"])  # n is one row
    status = F.when(F.col("observed") == 0, "NEVER_OBSERVED").when(F.col("linked") == F.col("observed"), "VERIFIED").when(F.col("linked") > 0, "PARTIAL").otherwise("UNLINKED")
    return out.select("entity", "expected", "observed", "linked", "first", "last", F.try_divide("observed", "expected").alias("coverage"), F.try_divide("linked", "expected").alias("link_coverage"), status.alias("status"))


def compare_runs(rows: DataFrame, materiality: float = 0.5, codes: tuple[str, str, str, str] = ("lower_return", "deeper_drawdown", "bear_market_defence", "bull_market_capture")) -> DataFrame:
    """rows (buyhold_return, base_return, base_mdd, new_return, new_mdd, all in percent) with the market's regime, both
    deltas, their status (improved, worse, equal within materiality), severity and the reasons of failure, by their codes:
    a lower return, a deeper drawdown, the latter in a bear market, the former in a bull market."""
    status = lambda d: F.when(d > materiality, "improved").when(d < -materiality, "worse").otherwise("equal")
    x = rows.withColumn("regime", F.when(F.col("buyhold_return") >= 20, "bull").when(F.col("buyhold_return") <= -20, "bear").otherwise("sideways"))
    x = x.withColumn("return_delta", F.col("new_return") - F.col("base_return")).withColumn("mdd_delta", F.col("new_mdd") - F.col("base_mdd"))
    x = x.withColumn("return_status", status(F.col("return_delta"))).withColumn("mdd_status", status(F.col("mdd_delta")))
    worse, deeper = F.col("return_status") == "worse", F.col("mdd_status") == "worse"
    reasons = F.array(*(F.when(hit, code) for code, hit in zip(codes, (worse, deeper, deeper & (F.col("regime") == "bear"), worse & (F.col("regime") == "bull")), strict=True)))
    severity = F.abs(F.least(F.lit(0.0), F.col("return_delta"))) + 2 * F.abs(F.least(F.lit(0.0), F.col("mdd_delta")))
    return x.withColumn("severity", severity).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def diagnose(compared: DataFrame, key: str) -> DataFrame:
    """By value of key over compare_runs: samples, rates in percent, median deltas, and whether the value fails again and
    again (fewer than half improved, or fewer than 40 percent pass both)."""
    rate = lambda c: 100 * F.avg(c.cast("double"))
    good, safe = F.col("return_status") != "worse", F.col("mdd_status") != "worse"
    out = compared.groupBy(F.col(key)).agg(
        F.count("*").alias("samples"), rate(F.col("return_status") == "improved").alias("return_improved"), rate(F.col("mdd_status") == "improved").alias("mdd_improved"), rate(good & safe).alias("joint_pass"),
        rate(~good).alias("return_worse"), rate(~safe).alias("mdd_worse"),
    )
    out = R.with_columns(out, R.quantile_columns(compared, [key], {f"median_{c}": (F.col(c), 0.5) for c in ("return_delta", "mdd_delta")}), [key])
    return out.withColumn("repeated", (F.col("return_improved") < 50) | (F.col("joint_pass") < 40))


def failure_reasons(compared: DataFrame) -> DataFrame:
    """How often each reason of failure was given."""
    return compared.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def worst_runs(compared: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The n rows of largest severity, ties by the keys."""
    return compared.orderBy(F.desc("severity"), *keys).limit(n)


def issuer_effects(panel: DataFrame, issuer: list[str], direction: str, treated: str, control: str, values: list[str]) -> DataFrame:
    """By issuer with events of both directions: their numbers, and the difference of the means of each value."""
    is_t, is_c = F.col(direction) == treated, F.col(direction) == control
    out = panel.groupBy(*issuer).agg(
        F.count_if(is_t).alias("treated_events"), F.count_if(is_c).alias("control_events"), *((F.avg(F.when(is_t, F.col(v))) - F.avg(F.when(is_c, F.col(v)))).alias(f"{v}_effect") for v in values)
    )
    return out.where("treated_events > 0 and control_events > 0")


def fold_effects(panel: DataFrame, fold: str, direction: str, treated: str, control: str, values: list[str]) -> DataFrame:
    """By fold: events, and the difference of the medians of each value (null without both directions)."""
    side = lambda v, d: (F.when(F.col(direction) == d, F.col(v)), 0.5)
    medians = R.quantile_columns(panel, [fold], {f"{v}|{d}": side(v, d) for v in values for d in (treated, control)})
    gaps = medians.select(fold, *((F.col(f"`{v}|{treated}`") - F.col(f"`{v}|{control}`")).alias(f"{v}_effect") for v in values))
    return R.with_columns(panel.groupBy(fold).agg(F.count("*").alias("events")), gaps, [fold])
