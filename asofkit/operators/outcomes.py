"""Forward outcomes: windows over following rows. Rows whose horizon has not passed are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import series


def with_forward(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """bars with the next open as entry, and per horizon the close at its end and the extremes on the way (c<h>, h<h>,
    l<h>): window frames over each entity's series, so no path is copied."""
    cols = {"entry": F.lead("open", 1).over(series())}
    for h in horizons:
        ahead = series().rowsBetween(1, h)
        cols |= {f"c{h}": F.lead("close", h).over(series()), f"h{h}": F.max("high").over(ahead), f"l{h}": F.min("low").over(ahead)}
    return bars.withColumns(cols)


def outcome_rows(events: DataFrame, keep: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Events that carry the columns of with_forward x horizon: return to the close of the horizon's last session, and
    largest rise and fall on the way; horizons that have not passed are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"c{h}").alias("c"), F.col(f"h{h}").alias("h"), F.col(f"l{h}").alias("l")) for h in horizons)))
    rel = lambda c: F.try_divide(F.col(f"o.{c}"), F.col("entry")) - 1
    return events.select(*keep, "entry", each.alias("o")).where("o.c is not null").select(*keep, "entry", "o.horizon", rel("c").alias("ret"), rel("h").alias("mfe"), rel("l").alias("mae"))


def replay_outcomes(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """events (entity, date on a session, ...) x horizon: entry at the next session's open, return to the close of the
    horizon's last session, largest rise and fall of high and low on the way.

    Every bar's forward extremes are computed once, so events join by equality. Events that are rows of the bars
    themselves need no join: with_forward and outcome_rows serve them in one pass.
    """
    forward = with_forward(bars, horizons).drop(*(c for c in bars.columns if c not in ("entity", "date")))
    return outcome_rows(events.join(forward, ["entity", "date"]), events.columns, horizons)


def forward_metrics(bars: DataFrame, h: int) -> DataFrame:
    """Close-to-close return after h rows, deepest fall on the way, and whether it rose."""
    ahead = series().rowsBetween(1, h)
    ret = F.try_divide(F.lead("close", h).over(series()), F.col("close")) - 1
    return bars.select("entity", "date", ret.alias("ret"), (F.try_divide(F.min("close").over(ahead), F.col("close")) - 1).alias("worst")).where("ret is not null").withColumn("hit", F.col("ret") > 0)


def label_fixed(events: DataFrame, bars: DataFrame, h: int, break_at: float, large_at: float, temporary_at: float, rise_at: float) -> DataFrame:
    """Path label over the h sessions after an event: the fall that its path reaches, else a rise, else UNRESOLVED; an
    event whose path is shorter is CENSORED. A temporary fall must have recovered by the end. Only events' own paths are
    made."""
    from .paths import path_rows

    keys = events.select("entity", "date").distinct()
    start = bars.select("entity", "date", F.col("close").alias("base"), F.count(F.lit(1)).over(series().rowsBetween(1, h)).alias("rows"))
    own = keys.join(start, ["entity", "date"])
    path = path_rows(own, bars, 1, h, [F.col("close").alias("c")]).withColumn("rel", F.col("c") / F.col("base") - 1)
    told = path.groupBy("entity", "date").agg(F.min("rel").alias("low"), F.max("rel").alias("high"), F.max_by("rel", "k").alias("end"), F.min(F.when(F.col("rel") <= temporary_at, F.col("k"))).alias("first_fall"))
    joined = events.join(own.join(told, ["entity", "date"], "left"), ["entity", "date"])
    label = (
        F.when(F.col("rows") < h, "CENSORED").when(F.col("low") <= break_at, "BREAK").when(F.col("low") <= large_at, "LARGE")
        .when((F.col("low") <= temporary_at) & (F.col("end") >= 0), "TEMPORARY").when(F.col("high") >= rise_at, "CONTINUATION").otherwise("UNRESOLVED")
    )
    return joined.select(*events.columns, label.alias("label"), F.col("first_fall").cast("long").alias("first_fall"))


def calendar_outcome(events: DataFrame, bars: DataFrame, months: int, tolerance: int, as_of) -> DataFrame:
    """events (id, entity, date) with the first close within tolerance days after date + months: AVAILABLE, PENDING
    where the time has not come, UNAVAILABLE where no close exists. An entity's bars and due days meet in one sort."""
    from .joins import asof_forward

    due = events.select("id", "entity", F.add_months("date", months).alias("date"))
    known = bars.where((F.col("date") <= as_of) & F.col("close").isNotNull()).select("entity", "date", "close")
    found = asof_forward(due, known, ["entity"], "date", ["close"], tolerance).withColumnRenamed("date", "due")
    status = F.when(F.col("close").isNotNull(), "AVAILABLE").when(F.date_add("due", tolerance) > as_of, "PENDING").otherwise("UNAVAILABLE")
    return found.select("id", "due", F.col("matched_on").alias("outcome_date"), "close", status.alias("status"))


def policy_counterfactual(events: DataFrame, bars: DataFrame, h: int, trim: float, waits: tuple[int, ...], costs: tuple[tuple[float, float], ...]) -> DataFrame:
    """Wealth after h sessions of trimming a share at the next open and buying back after each wait (0: never), against
    holding, for each (fee, slippage); and the change in shares. Slippage moves the price, the fee is paid on the amount
    traded; cost is their sum. Closed form on the open of a few later sessions."""
    lead = lambda c, k: F.lead(c, k).over(series())
    prices = bars.select("entity", "date", lead("open", 1).alias("out"), lead("close", h).alias("end"), *(lead("open", 1 + w).alias(f"in{w}") for w in waits if w))
    joined = events.join(prices, ["entity", "date"]).where("end is not null and out > 0")
    rows = []
    for w in waits:
        for fee, slip in costs:
            c = fee + slip
            cash = F.lit(trim) * F.col("out") * (1 - slip) * (1 - fee)
            shares = F.lit(1 - trim) + (F.lit(0.0) if not w else cash / (F.col(f"in{w}") * (1 + slip) * (1 + fee)))
            wealth = shares * F.col("end") + (cash if not w else F.lit(0.0))
            rows.append(F.struct(F.lit(w).alias("wait"), F.lit(c).alias("cost"), (wealth / F.col("end") - 1).alias("wealth_delta"), (shares - 1).alias("share_delta")))
    return joined.select(*events.columns, F.inline(F.array(*rows)))


def policy_paths(events: DataFrame, bars: DataFrame, bench: DataFrame, h: int, trim: float, waits: tuple[int, ...], costs: tuple[tuple[float, float], ...]) -> DataFrame:
    """Each event (id, entity, date), policy and (fee, slippage), summed as cost: terminal wealth against holding, over the wealth at the start
    (delta), the upside missed, and how much shallower the deepest drawdown of the policy's daily wealth is than that of
    holding. Policies sell `trim` of the share at the next open and keep the cash (keep_cash), buy back after each wait
    (reenter_<n>), or hold the benchmark instead (benchmark; bench: date, open, close). Events whose h sessions have not
    passed, or lack a benchmark price, are left out. Only events' own rows are made."""
    from .paths import path_rows

    b = bars.select("entity", "date", "open", "close").join(bench.select("date", F.col("open").alias("bo"), F.col("close").alias("bc")), "date", "left")
    path = path_rows(events.select("id", "entity", "date"), b, 0, h, ["open", "close", "bo", "bc"])
    whole = Window.partitionBy("id")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).over(whole)
    path = path.withColumn("n", F.count(F.lit(1)).over(whole)).where(F.col("n") == h + 1)
    path = path.withColumn("base", at("close", 0)).withColumn("out", at("open", 1)).withColumn("bout", at("bo", 1)).withColumn("end", at("close", h)).withColumns({f"in{w}": at("open", 1 + w) for w in waits})
    path = path.where("out > 0 and bout > 0")
    sold, kinds = F.col("k") >= 1, []
    for fee, slip in costs:
        c, dearer = fee + slip, (1 + slip) * (1 + fee)
        cash = F.lit(trim) * F.col("out") * (1 - slip) * (1 - fee)
        kept = F.when(sold, 1 - trim).otherwise(1.0) * F.col("close")
        kinds.append(F.struct(F.lit("keep_cash").alias("policy"), F.lit(c).alias("cost"), (kept + F.when(sold, cash).otherwise(0.0)).alias("wealth")))
        kinds.append(F.struct(F.lit("benchmark").alias("policy"), F.lit(c).alias("cost"), (kept + F.when(sold, cash / (F.col("bout") * dearer) * F.col("bc")).otherwise(0.0)).alias("wealth")))
        for w in waits:
            back = F.col("k") >= 1 + w
            wealth = kept + F.when(back, cash / (F.col(f"in{w}") * dearer) * F.col("close")).when(sold, cash).otherwise(0.0)
            kinds.append(F.struct(F.lit(f"reenter_{w}").alias("policy"), F.lit(c).alias("cost"), wealth.alias("wealth")))
    each = path.select("id", "k", "base", "close", "end", F.inline(F.array(*kinds)))
    upto = Window.partitionBy("id", "policy", "cost").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("fall", F.col("wealth") / F.max("wealth").over(upto) - 1).withColumn("hold_fall", F.col("close") / F.max("close").over(upto) - 1)
    out = each.groupBy("id", "policy", "cost").agg(((F.max_by("wealth", "k") - F.max("end")) / F.max("base")).alias("delta"), F.greatest(F.lit(0.0), F.abs(F.min("hold_fall")) - F.abs(F.min("fall"))).alias("drawdown_avoided"))
    return out.withColumn("missed_upside", F.greatest(F.lit(0.0), -F.col("delta")))


def monthly_forward(monthly: DataFrame, h: int) -> DataFrame:
    """(entity, month, close) with the return and the trough of the h following months."""
    w = Window.partitionBy("entity").orderBy("month")
    ret = F.lead("close", h).over(w) / F.col("close") - 1
    return monthly.select("entity", "month", ret.alias("ret"), (F.min("close").over(w.rowsBetween(1, h)) / F.col("close") - 1).alias("trough")).where("ret is not null")
