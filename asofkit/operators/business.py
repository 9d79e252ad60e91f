"""Fundamentals as known at a date: guards, dilution, valuation, earnings streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_forward, asof_join
from .windows import window_ranks

#: Multipliers by direction and length of a streak of earnings surprises (fixed values).
STREAKS = {"beat_4": 0.85, "beat_3": 0.90, "beat_2": 0.95, "neutral": 1.00, "miss_2": 1.05, "miss_3": 1.10, "miss_4": 1.15}
#: Sources whose announcement dates are trusted (fixed values).
TRUSTED = ("sec_filing", "company_ir", "exchange_release", "licensed_earnings_feed")


def _best(rows: Column, where_, order) -> Column:
    """The largest of an array's rows that pass, by `order` (a struct of a row); null if none does."""
    return F.array_max(F.transform(F.filter(rows, where_), order))


def known_states(grid: DataFrame, changes: DataFrame) -> DataFrame:
    """grid (entity, as_of) with state: the entity's last change (entity, at) by then, null before the first.

    What is known at a date is what was known at that change, so it need be worked out once for each change that any date
    of the grid sees, however dense the grid is.
    """
    moment = lambda c: F.col(c).cast("timestamp").alias("_t")
    return asof_join(grid.select("entity", "as_of", moment("as_of")), changes.select("entity", moment("at"), F.col("at").alias("state")).distinct(), ["entity"], "_t", ["state"]).drop("_t", "matched_on")


def _by_state(rows: DataFrame, states: DataFrame, keys: list[str], at: str, best: Column) -> DataFrame:
    """(entity, keys, state, best): the largest `best` of rows of one key that the same state (entity, as_of) is the first
    to know; rows are known from `at` on. The rows of one moment are summed up before they meet the states, so however
    many versions a key has, no more than one for each state goes on."""
    moment = F.col(at).cast("timestamp").alias("_t")
    each = rows.where(F.col(at).isNotNull()).groupBy("entity", *keys, moment).agg(F.max(best).alias("best"))
    first = asof_forward(each, states.select("entity", F.col("as_of").cast("timestamp").alias("_t"), F.col("as_of").alias("state")), ["entity"], "_t", ["state"])
    return first.where("state is not null").groupBy("entity", *keys, "state").agg(F.max("best").alias("best"))


def facts_as_filed(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """grid (entity, as_of) with `facts`: by group and period the newest version accepted by then, as one array. A period
    has one version at most for each date that is the first to see it, and these few meet the entity's dates in one join."""
    period = ["group", "period_start", "period_end"]
    version = F.struct("accepted_at", F.col("concept_priority").isNull().alias("first"), (-F.col("concept_priority")).alias("priority"), "accession", "value")
    new = _by_state(facts, grid, period, "accepted_at", version)
    kept = grid.distinct().join(new, "entity").where("state <= as_of").groupBy("entity", "as_of", *period).agg(F.max("best").alias("best"))
    days = F.coalesce(F.date_diff("period_end", "period_start"), F.lit(0)).alias("days")
    rows = kept.groupBy("entity", "as_of").agg(F.collect_list(F.struct("group", "period_end", days, F.col("best.accepted_at"), F.col("best.value"))).alias("facts"))
    return grid.join(rows, ["entity", "as_of"], "left")


def business_guard(facts: DataFrame, grid: DataFrame, quarter: tuple[int, int] = (80, 100), year: tuple[int, int] = (350, 380), most_age: int = 550) -> DataFrame:
    """By entity and as_of: PASS, VETO or UNKNOWN from revenue, earnings, operating cash flow and debt against the year
    before (330-400 days), with the flags raised. UNKNOWN if a comparison is missing or all facts are older than most_age
    days. Liabilities may follow from assets less equity. Rates are fixed values.

    facts: entity, group (revenue, earnings, operating_cash_flow, assets, liabilities, equity), concept_priority,
    period_start, period_end, accepted_at, accession, value.
    """
    known = known_states(grid, facts.select("entity", F.col("accepted_at").alias("at")))
    x = facts_as_filed(facts, known.where("state is not null").select("entity", F.col("state").alias("as_of")).distinct())
    f = F.col("facts")
    row = lambda r: F.struct(r["period_end"].alias("end"), r["accepted_at"].alias("at"), r["value"].alias("v"))
    late = lambda r: F.struct(r["accepted_at"].alias("at"), r["value"].alias("v"))
    span = lambda g, days: lambda r: (r["group"] == g) & (r["days"].between(*days) if days else F.lit(True))
    before = lambda g, days, now: lambda r: span(g, days)(r) & F.date_diff(now["end"], r["period_end"]).between(330, 400)
    at = lambda g, days, now: lambda r: span(g, days)(r) & (r["period_end"] == now["end"])
    for name, g, days in (("rev", "revenue", quarter), ("cash", "operating_cash_flow", year), ("ast", "assets", None)):
        x = x.withColumn(name, _best(f, span(g, days), row))
        x = x.withColumn(f"{name}0", _best(f, before(g, days, F.col(name)), row))
    for name, g, days, now in (("earn", "earnings", quarter, "rev"), ("liab", "liabilities", None, "ast"), ("eq", "equity", None, "ast")):
        x = x.withColumn(name, _best(f, at(g, days, F.col(now)), late)).withColumn(f"{name}0", _best(f, at(g, days, F.col(f"{now}0")), late))
    for k in ("", "0"):
        derived = F.when(F.col(f"eq{k}").isNotNull(), F.struct(F.greatest(F.col(f"ast{k}.at"), F.col(f"eq{k}.at")).alias("at"), (F.col(f"ast{k}.v") - F.col(f"eq{k}.v")).alias("v")))
        x = x.withColumn(f"liab{k}", F.coalesce(f"liab{k}", derived))
    need = [f"{n}{k}" for n in ("rev", "earn", "cash", "ast", "liab") for k in ("", "0")]
    x = known.join(x.select("entity", F.col("as_of").alias("state"), *need), ["entity", "state"], "left")
    x = x.withColumn("newest", F.greatest(*(F.col(f"{n}.at") for n in need)))
    missing = F.lit(False)
    for n in need:
        missing = missing | F.col(n).isNull()
    stale = F.col("newest").isNull() | (F.date_diff("as_of", "newest") > most_age)
    v = lambda n: F.col(f"{n}.v")
    growth = lambda n: F.try_divide(v(n), v(f"{n}0")) - 1
    margin, margin0 = F.try_divide(v("earn"), v("rev")), F.try_divide(v("earn0"), v("rev0"))
    debt, debt0 = F.try_divide(v("liab"), v("ast")), F.try_divide(v("liab0"), v("ast0"))
    loss, no_cash = v("earn") < 0, v("cash") <= 0
    flags = [
        ("REVENUE", growth("rev") <= -0.10), ("EARNINGS", loss | (margin - margin0 <= -0.05)),
        ("OPERATING_CASH_FLOW", no_cash | F.coalesce(growth("cash") <= -0.30, F.lit(False))), ("DEBT_BURDEN", (debt >= 0.60) & (debt - debt0 >= 0.10)),
    ]
    raised = F.filter(F.array(*(F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in flags)), lambda n: n.isNotNull())
    unknown = missing | stale
    veto = (F.size(raised) >= 2) | (loss & no_cash)
    shown = lambda c: F.when(~unknown, c)
    return x.select(
        "entity", "as_of", F.when(unknown, "UNKNOWN").when(veto, "VETO").otherwise("PASS").alias("guard"), F.when(unknown, F.lit("")).otherwise(F.array_join(raised, "|")).alias("flags"),
        shown(growth("rev")).alias("revenue_yoy"), shown(margin).alias("net_margin"), shown(growth("cash")).alias("cash_flow_yoy"), shown(v("cash")).alias("cash_flow"), shown(debt).alias("debt_ratio"),
        F.when(stale, "STALE_FACTS").when(missing, "MISSING_COMPARABLE_FACTS").otherwise("").alias("reason"),
    )


def dilution(facts: DataFrame, splits: DataFrame, grid: DataFrame) -> DataFrame:
    """By entity and as_of: change of the share count against the year before (330-400 days, same concept), restated by
    the splits between the two periods; null without a pair or beyond +-100 percent. facts: entity, concept, priority,
    period_end, accepted_at, value; splits: entity, date, ratio."""
    counts = facts.where("value > 0 and accepted_at is not null and period_end is not null").withColumn("at", F.greatest("accepted_at", "period_end"))
    known = known_states(grid, counts.select("entity", "at"))
    states = known.where("state is not null").select("entity", F.col("state").alias("as_of")).distinct()
    new = _by_state(counts, states, ["concept", "period_end"], "at", F.struct((-F.col("priority")).alias("first"), "accepted_at", "value"))
    row = F.struct("period_end", "best.first", "best.accepted_at", "concept", "best.value")
    upto = Window.partitionBy("entity").orderBy("state").rowsBetween(Window.unboundedPreceding, 0)
    last = new.groupBy("entity", "state").agg(F.max(row).alias("last")).withColumn("last", F.max("last").over(upto))
    # The year before is met by entity and concept, at each of its periods' few versions.
    older = new.select(F.col("entity").alias("_e"), F.col("concept").alias("_c"), F.col("state").alias("_s"), row.alias("_r"))
    near = F.date_diff(F.col("last.period_end"), F.col("_r.period_end")).between(330, 400)
    prior = last.join(older, (F.col("entity") == F.col("_e")) & (F.col("last.concept") == F.col("_c")) & (F.col("_s") <= F.col("state")) & near, "left").groupBy("entity", "state").agg(F.max("last").alias("last"), F.max("_r").alias("prior"))
    ratios = splits.groupBy("entity").agg(F.collect_list(F.struct("date", "ratio")).alias("splits"))
    each = prior.join(ratios, "entity", "left")
    between = F.filter(F.coalesce("splits", F.array().cast("array<struct<date:date,ratio:double>>")), lambda s: (s["date"] > F.col("prior.period_end")) & (s["date"] <= F.col("last.period_end")))
    factor = F.aggregate(between, F.lit(1.0), lambda a, s: a * s["ratio"])
    change = F.try_divide(F.col("last.value"), F.col("prior.value") * factor) - 1
    found = each.select("entity", "state", F.when(F.abs(change) <= 1, change).alias("dilution"))
    return known.join(found, ["entity", "state"], "left").select("entity", "as_of", "dilution")


def shares_as_of(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """grid (entity, date) with the share count of the latest period accepted by then. facts: entity, priority,
    period_end, accepted (a date not before the period's end), value. The latest of each day, and of those so far, runs along."""
    upto = Window.partitionBy("entity").orderBy("accepted").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.struct("period_end", (-F.col("priority")).alias("first"), "accepted", "value")
    daily = facts.where("period_end <= accepted").groupBy("entity", "accepted").agg(F.max(row).alias("latest"))
    known = daily.withColumn("latest", F.max("latest").over(upto)).select("entity", F.col("accepted").alias("date"), F.col("latest.value").alias("shares"))
    return asof_join(grid, known, ["entity"], "date", ["shares"]).drop("matched_on")


def valuation_features(monthly: DataFrame, facts: DataFrame, business: DataFrame, window: int = 60, least: int = 36) -> DataFrame:
    """(entity, date = month end, close, adj_close) with market value over operating cash flow, 12-month return less
    revenue growth, and each one's share of its own last `window` months that it reaches. business: entity, date,
    cash_flow, revenue_yoy."""
    x = shares_as_of(facts, monthly).join(business, ["entity", "date"], "left")
    year = F.try_divide("adj_close", F.lag("adj_close", 12).over(Window.partitionBy("entity").orderBy("date"))) - 1
    x = x.withColumn("price_to_cash", F.when(F.col("cash_flow") > 0, F.col("close") * F.col("shares") / F.col("cash_flow"))).withColumn("gap", year - F.col("revenue_yoy"))
    return window_ranks(x.select("entity", "date", "shares", "price_to_cash", "gap"), {"price_to_cash_pct": "price_to_cash", "gap_pct": "gap"}, window, least, prior=True)


def eps_streak(announcements: DataFrame, grid: DataFrame) -> DataFrame:
    """grid (entity, date) with a multiplier from the streak among the last four trusted announcements by then; neutral
    without two of one direction. announcements: entity, date, actual, estimate, source; of several on one day the one
    of the largest actual counts last."""
    known = announcements.where(F.col("source").isin(*TRUSTED) & F.col("date").isNotNull() & F.col("actual").isNotNull() & (F.col("estimate") != 0))
    w = Window.partitionBy("entity").orderBy("date", "actual")
    way = F.signum(F.col("actual") / F.col("estimate") - 1)
    s = known.withColumn("s0", way)
    s = s.withColumns({f"s{k}": F.lag("s0", k).over(w) for k in (1, 2, 3)})
    same = lambda k: F.coalesce(F.col(f"s{k}") == F.col("s0"), F.lit(False))
    run = F.when(same(1) & same(2) & same(3), 4).when(same(1) & same(2), 3).when(same(1), 2).otherwise(1)
    factor = F.lit(STREAKS["neutral"])
    for k in (2, 3, 4):
        for name, sign in (("beat", 1), ("miss", -1)):
            factor = F.when((F.col("s0") == sign) & (run == k), STREAKS[f"{name}_{k}"]).otherwise(factor)
    last = F.row_number().over(Window.partitionBy("entity", "date").orderBy(F.desc("actual")))
    each = s.withColumn("multiplier", factor).withColumn("n", last).where("n = 1").select("entity", "date", "multiplier")
    return asof_join(grid, each, ["entity"], "date", ["multiplier"]).drop("matched_on").withColumn("multiplier", F.coalesce("multiplier", F.lit(STREAKS["neutral"])))
