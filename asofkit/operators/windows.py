"""Window jobs over series (entity, date, ...). Frames with a minimum count non-null values and give null below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def series():
    """A series in time; made when asked for, as a session must exist by then."""
    return Window.partitionBy("entity").orderBy("date")


def trailing(n: int, w=None):
    return (w or series()).rowsBetween(-(n - 1), 0)


def change(col: str, n: int, w=None) -> Column:
    """Relative change against n rows before; null at zero."""
    return F.try_divide(F.col(col), F.lag(col, n).over(w or series())) - 1


def log_change(col: str, n: int, w=None) -> Column:
    ratio = F.try_divide(F.col(col), F.lag(col, n).over(w or series()))
    return F.when(ratio > 0, F.log(ratio))


def rolling(col: str, n: int, least: int, agg: str, w=None) -> Column:
    """mean, min, max, sum, std (ddof 1) of the last n rows, given `least` non-null ones."""
    f = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}[agg]
    frame = trailing(n, w)
    return F.when(F.count(col).over(frame) >= least, f(col).over(frame))


def window_ranks(df: DataFrame, cols: dict[str, str], n: int, least: int, prior: bool = False) -> DataFrame:
    """df with a percentile for each of cols (new name: column), given at least `least` values in the window.

    Among the last n rows: the current value's average rank, (less + (equal + 1) / 2) / count. prior: among the n rows
    before the current one, the share that is at most the current value. One vectorised pass over an entity's series,
    in pieces, so that memory grows with n and not with the series' square.
    """
    import numpy as np
    import pandas as pd

    def ranks(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        ahead = np.full(n if prior else n - 1, np.nan)
        frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([ahead, x]), n)[: len(x)]
        step = max(1, (1 << 21) // n)
        for a in range(0, len(x), step):
            f, v = frames[a : a + step], x[a : a + step]
            less, same, held = (f < v[:, None]).sum(1), (f == v[:, None]).sum(1), (~np.isnan(f)).sum(1)
            ok = (held >= least) & ~np.isnan(v)
            share = (less + (same if prior else (same + 1) / 2)) / np.maximum(held, 1)
            out[a : a + step] = np.where(ok, share, np.nan)
        return out

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        return part.assign(**{new: ranks(part[old].to_numpy(float)) for new, old in cols.items()})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{c}` double" for c in cols])
    done = df.groupBy("entity").applyInPandas(run, schema)
    return done.select(*df.columns, *(F.nanvl(c, F.lit(None)).alias(c) for c in cols))


def pct_of_latest(df: DataFrame, col: str) -> DataFrame:
    """By entity the latest value and the share of its whole history that is at most that value."""
    latest = df.where(F.col(col).isNotNull()).groupBy("entity").agg(F.max_by(col, "date").alias("latest"))
    return df.join(latest, "entity").groupBy("entity", "latest").agg(F.avg(F.when(F.col(col).isNotNull(), (F.col(col) <= F.col("latest")).cast("double"))).alias("pct"))


def expanding_pct_rank(df: DataFrame, col: str, least: int = 1, prior: bool = False) -> DataFrame:
    """df with pct: average rank of each value within its entity's history so far (of at least `least` values), as a
    share; prior: the share of the values before it that are at most the value. One vectorised pass per entity; a group
    holds one series."""
    import numpy as np
    import pandas as pd

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x = part[col].to_numpy(float)
        out, held = np.full(len(x), np.nan), np.zeros(0)
        for a in range(0, len(x), 1024):  # against the sorted values before the piece, and within it
            v = x[a : a + 1024]
            known, upto = ~np.isnan(v), np.tril(np.ones((len(v), len(v)), bool), -1 if prior else 0)
            low, high = np.searchsorted(held, v), np.searchsorted(held, v, side="right")
            less, same = low + ((v[None, :] < v[:, None]) & upto).sum(1), high - low + ((v[None, :] == v[:, None]) & upto).sum(1)
            count = len(held) + known.cumsum() - (known if prior else 0)
            out[a : a + 1024] = np.where(known & (count >= least), (less + (same if prior else (same + 1) / 2)) / np.maximum(count, 1), np.nan)
            held = np.sort(np.concatenate([held, v[known]]))
        return part.assign(pct=out)

    return df.select("entity", "date", col).groupBy("entity").applyInPandas(rank, f"entity string, date date, {col} double, pct double")


def indicators(bars: DataFrame) -> DataFrame:
    """Band position, 52-week position, distance from the long mean, short over long volume, and the last ended week's
    close over its 200-week mean; shorter windows serve while a series is young."""
    mean, std = rolling("close", 20, 20, "mean"), rolling("close", 20, 20, "std")
    high, low = rolling("close", 252, 20, "max"), rolling("close", 252, 20, "min")
    from .bars import weekly_bars
    from .joins import asof_join

    own = Window.partitionBy("entity").orderBy("week")
    weekly = weekly_bars(bars).withColumn("week_ratio", F.try_divide("close", rolling("close", 200, 20, "mean", own))).where("week_ratio is not null")
    daily = bars.select(
        "entity", "date",
        F.try_divide(F.col("close") - (mean - 2 * std), 4 * std).alias("band"),
        F.try_divide(F.col("close") - low, high - low).alias("position"),
        (F.try_divide(F.col("close"), rolling("close", 200, 20, "mean")) - 1).alias("ma_gap"),
        F.try_divide(rolling("volume", 5, 5, "mean"), rolling("volume", 20, 20, "mean")).alias("volume_ratio"),
    )
    return asof_join(daily, weekly.select("entity", F.col("week").alias("date"), "week_ratio"), ["entity"], "date", ["week_ratio"]).drop("matched_on")


def wilder_rsi(df: DataFrame, col: str, n: int, variant: str = "seeded") -> DataFrame:
    """df with rsi. ewm: smoothing from the first change; seeded: a plain mean of the first n changes, then smoothing,
    100 without losses and 50 without any move. Recursive, so one vectorised pass per entity."""
    import numpy as np
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        step = np.diff(part[col].to_numpy(float))
        up, down = np.maximum(step, 0), np.maximum(-step, 0)
        out = np.full(len(part), np.nan)
        if len(step) and (variant == "ewm" or len(step) >= n):
            first = 1 if variant == "ewm" else n
            g, l = up[:first].mean(), down[:first].mean()
            for i in range(first, len(step) + 1):
                if i > first:
                    g, l = g + (up[i - 1] - g) / n, l + (down[i - 1] - l) / n
                out[i] = 50.0 if g == 0 and l == 0 else 100.0 if l == 0 else 100 - 100 / (1 + g / l)
        return part.assign(rsi=out)

    return df.select("entity", "date", col).where(F.col(col).isNotNull()).groupBy("entity").applyInPandas(run, f"entity string, date date, {col} double, rsi double")


def peer_breadth(bars: DataFrame, sectors: DataFrame, gain: int = 63, mean: int = 200, least: int = 3) -> DataFrame:
    """By sector and date the shares of members above their value `gain` rows ago, above their long mean, and both."""
    own = bars.select("entity", "date", (change("close", gain) > 0).alias("up"), (F.col("close") > rolling("close", mean, mean, "mean")).alias("above"))
    both = own.where("up is not null and above is not null").join(sectors, "entity")
    return both.groupBy("sector", "date").agg(F.avg(F.col("up").cast("double")).alias("gaining"), F.avg(F.col("above").cast("double")).alias("above_mean"), F.avg((F.col("up") & F.col("above")).cast("double")).alias("positive"), F.count("*").alias("members")).where(F.col("members") >= least)


def loo_share(df: DataFrame, flag: str, by: list[str], least: int = 2) -> Column:
    """Share of the others in the group whose flag is set."""
    w = Window.partitionBy(*by)
    n = F.count(flag).over(w) - F.col(flag).isNotNull().cast("int")
    return F.when(n >= least, (F.sum(F.col(flag).cast("int")).over(w) - F.coalesce(F.col(flag).cast("int"), F.lit(0))) / n)


def cross_rank(col: str, by: list[str]) -> Column:
    """Average rank of a value among the group's, as a share of them."""
    w = Window.partitionBy(*by)
    ordered = w.orderBy(col)
    same = F.count(col).over(Window.partitionBy(*by, col))
    nulls = F.sum(F.col(col).isNull().cast("int")).over(w)
    return F.when(F.col(col).isNotNull(), (F.rank().over(ordered) - nulls + (same - 1) / 2) / F.count(col).over(w))


def flip_fraction(df: DataFrame, sign: str, k: int) -> DataFrame:
    """By entity the share of signed rows that an opposite sign precedes within k rows."""
    w = series().rowsBetween(-k, -1)
    opposite = F.when(F.col(sign) > 0, F.min(sign).over(w) < 0).when(F.col(sign) < 0, F.max(sign).over(w) > 0)
    return df.withColumn("flip", opposite).where(F.col(sign) != 0).groupBy("entity").agg(F.avg(F.coalesce("flip", F.lit(False)).cast("double")).alias("flips"), F.count("*").alias("n"))


def entries(df: DataFrame, col: str, values: list[str] | None = None) -> DataFrame:
    """Rows where the value differs from the entity's row before (the first row is none)."""
    before = F.lag(col).over(series())
    found = df.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col(col) != F.col("previous")))
    return found.where(F.col(col).isin(values)) if values else found


def run_length(df: DataFrame, col: str) -> DataFrame:
    """By entity its latest run of equal values: value, start, rows."""
    new = F.coalesce(F.col(col) != F.lag(col).over(series()), F.lit(True)).cast("int")
    runs = df.withColumn("new", new).withColumn("run", F.sum("new").over(series()))
    each = runs.groupBy("entity", "run", col).agg(F.min("date").alias("start"), F.count("*").alias("rows"))
    return each.withColumn("last", F.max("run").over(Window.partitionBy("entity"))).where("run = last").select("entity", col, "start", "rows")


def greedy(events: DataFrame, keys: list[str], gap: int, per_year: int | None = None) -> DataFrame:
    """Each key's distinct dates with a reason: kept, cooldown (at most `gap` days after the last one kept), budget (its
    calendar year has per_year kept ones). One pass over each key's sorted dates."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        dates, reasons, last, year, n = sorted(set(part["date"].dropna())), [], None, None, 0
        for d in dates:
            n = n if d.year == year else 0
            year = d.year
            if last is not None and (d - last).days <= gap:
                reasons.append("cooldown")
            elif per_year is not None and n >= per_year:
                reasons.append("budget")
            else:
                reasons.append("kept")
                last, n = d, n + 1
        first = {k: [part[k].iloc[0]] * len(dates) for k in keys}
        return pd.DataFrame({**first, "date": dates, "reason": reasons})

    schema = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys) + ", date date, reason string"
    return events.select(*keys, "date").distinct().groupBy(*keys).applyInPandas(run, schema)


def collapse(events: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Events of a key that lie more than `gap` days after the last one kept."""
    return greedy(events, keys, gap).where("reason = 'kept'").select(*keys, "date")


def budget(events: DataFrame, keys: list[str], gap: int, per_year: int) -> DataFrame:
    """Like collapse, with at most per_year kept events in a calendar year; returns every event with a reason."""
    return greedy(events, keys, gap, per_year)


def rolling_trend(df: DataFrame, col: str, n: int) -> DataFrame:
    """Slope and R-squared of the log of a value against the row number over the last n rows."""
    numbered = df.withColumn("_i", F.row_number().over(series()).cast("double")).withColumn("_y", F.when(F.col(col) > 0, F.log(col)))
    w = trailing(n)
    full = F.count("_y").over(w) == n
    return numbered.withColumn("slope", F.when(full, F.regr_slope("_y", "_i").over(w))).withColumn("r2", F.when(full, F.regr_r2("_y", "_i").over(w))).drop("_i", "_y")


def rows_since_max(df: DataFrame, col: str, n: int) -> DataFrame:
    """df with since: rows since the (first) highest value of the last n rows."""
    numbered = df.withColumn("_i", F.row_number().over(series()))
    top = F.max(F.struct(F.col(col).alias("v"), (-F.col("_i")).alias("i"))).over(trailing(n))
    return numbered.withColumn("since", (F.col("_i") + top["i"]).cast("long")).drop("_i")


def giveback(observations: DataFrame, bars: DataFrame, folds: DataFrame, col: str, stage: str | None = None, rows: int = 13) -> DataFrame:
    """observations (entity, date, ...) that lie within a fold's test span, with the position that starts at the
    entity's first bar of the span: its gain, the highest gain seen so far, the drawdown from the highest observed value
    and the share of the profit given back (0 without one). With a stage, recent_rush says whether one of the last rows
    was RUSH.

    Only observed rows count for peaks; an observation without a bar of its own day fails when it is read. folds (fold,
    test_start, test_end) is a table of fixed size whose spans don't overlap.
    """
    spans = F.broadcast(folds.select("fold", "test_start", "test_end"))
    within = lambda d: F.col(d).between(F.col("test_start"), F.col("test_end"))
    prices = bars.select("entity", F.col("date").alias("_d"), F.col(col).alias("_price")).where("_price is not null")
    entry = prices.join(spans, within("_d")).groupBy("entity", "fold").agg(F.min("_d").alias("entry_date"), F.min_by("_price", "_d").alias("entry"))
    seen = observations.join(spans, within("date")).drop("test_start", "test_end").join(entry, ["entity", "fold"]).where("date >= entry_date")
    own = prices.select("entity", F.col("_d").alias("date"), "_price")
    value = F.coalesce("_price", F.raise_error(F.lit("an observation lacks a bar of its day")).cast("double"))
    w = Window.partitionBy("entity", "fold").orderBy("date")
    out = seen.join(own, ["entity", "date"], "left").withColumn("_v", value).withColumn("_top", F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    profit = F.col("_top") - F.col("entry")
    out = out.withColumn("gain", F.try_divide("_v", "entry") - 1).withColumn("peak_gain", F.try_divide("_top", "entry") - 1).withColumn("drawdown", F.try_divide("_v", "_top") - 1)
    out = out.withColumn("given_back", F.when(profit > 0, (F.col("_top") - F.col("_v")) / profit).otherwise(0.0))
    if stage:
        out = out.withColumn("recent_rush", F.max(F.coalesce(F.col(stage) == "RUSH", F.lit(False))).over(w.rowsBetween(-(rows - 1), 0)))
    return out.drop("_v", "_top", "_price")


def rising_runs(df: DataFrame, col: str, ordinal: str) -> DataFrame:
    """Rows whose value rose over each of the last two settlements, their ordinals being consecutive."""
    l1, l2 = F.lag(col, 1).over(series()), F.lag(col, 2).over(series())
    near = (F.col(ordinal) - F.lag(ordinal, 1).over(series()) == 1) & (F.lag(ordinal, 1).over(series()) - F.lag(ordinal, 2).over(series()) == 1)
    return df.withColumn("rising", (F.col(col) > l1) & (l1 > l2) & near)
