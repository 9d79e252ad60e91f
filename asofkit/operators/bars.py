"""Resampling and calendar jobs over bars (entity, date, open, high, low, close, adj_close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjust_bars(bars: DataFrame) -> DataFrame:
    """Open, high, low and close times adj_close / close; null where close is zero."""
    factor = F.try_divide("adj_close", "close")
    return bars.select("entity", "date", *((F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")), "volume")


def drop_incomplete_session(bars: DataFrame, now: Column, zone: str = "America/New_York", complete: str = "16:30") -> DataFrame:
    """Without the bars of the day that is still open at the instant `now` (UTC) in the market's zone."""
    local = F.from_utc_timestamp(now, zone)
    last = F.when(F.date_format(local, "HH:mm") >= complete, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return bars.where(F.col("date") <= last)


def week_label(d: Column) -> Column:
    """The Friday that ends a day's week (Saturday to Friday)."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def _last(c: str) -> Column:
    """The last non-null value of a column: resampling skips nulls column by column."""
    return F.expr(f"max_by({c}, date) FILTER (WHERE {c} IS NOT NULL)").alias(c)


def weekly_bars(bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One bar per entity and Friday-ended week, with its last real session; weeks that end after as_of are left out."""
    weekly = bars.groupBy("entity", week_label(F.col("date")).alias("week")).agg(
        F.expr("min_by(open, date) FILTER (WHERE open IS NOT NULL)").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        _last("close"), _last("adj_close"), F.sum("volume").alias("volume"), F.max("date").alias("last_session"),
    )
    return weekly if as_of is None else weekly.where(F.col("week") <= as_of)


def month_end_bars(bars: DataFrame) -> DataFrame:
    """The last close and session of each entity's calendar months."""
    return bars.groupBy("entity", F.last_day("date").alias("month")).agg(_last("close"), F.max("date").alias("last_session"))


def observation_dates(bars: DataFrame, freq: str, as_of: Column) -> DataFrame:
    """The last real session of each completed day, week or month of an entity."""
    label = {"daily": F.col("date"), "weekly": week_label(F.col("date")), "monthly": F.last_day("date")}[freq]
    return bars.groupBy("entity", label.alias("bucket")).agg(F.max("date").alias("observed")).where(F.col("bucket") <= as_of)


def align_to(left: DataFrame, right: DataFrame, value: str, limit: int) -> DataFrame:
    """left (entity, date) with right's value on its date, carried forward over at most `limit` of the entity's rows."""
    w = Window.partitionBy("entity").orderBy("date").rowsBetween(-limit, 0)
    joined = left.join(right.select("date", F.col(value).alias("_v")), "date", "left")
    return joined.withColumn(value, F.last("_v", ignorenulls=True).over(w)).drop("_v")


def anchored_folds(calendar: DataFrame, train: int, test: int, step: int, purge: int, embargo: int) -> DataFrame:
    """Walk-forward folds (fold, train_start, train_end, test_start, test_end) from a session calendar (date): training
    starts at the first session, test windows follow purge sessions later, folds are `step` sessions apart, and training
    of a later fold may not use the embargo sessions before its purge. The calendar is one row per session: small."""
    numbered = calendar.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    ends = numbered.agg(F.max("i").alias("last"), F.min("date").alias("first"))
    folds = ends.withColumn("fold", F.explode(F.expr(f"filter(sequence(0, last), f -> {train} + {purge} + f * {step} + {test} - 1 <= last)")))
    out = folds
    for name, i in (("train_end", F.col("fold") * step + train - 1 - embargo), ("test_start", F.col("fold") * step + train + purge), ("test_end", F.col("fold") * step + train + purge + test - 1)):
        out = out.join(numbered.select(F.col("i").alias("_i"), F.col("date").alias(name)), i == F.col("_i")).drop("_i")
    return out.select("fold", F.col("first").alias("train_start"), "train_end", "test_start", "test_end")


def assign_folds(events: DataFrame, folds: DataFrame) -> DataFrame:
    """events (date, outcome_end) with a role in each fold: test if the whole outcome lies in its test window, train if
    it ends by the end of training; folds are few, so they are joined by range."""
    test = (F.col("date") >= F.col("test_start")) & (F.col("outcome_end") <= F.col("test_end"))
    train = (F.col("date") >= F.col("train_start")) & (F.col("outcome_end") <= F.col("train_end"))
    return events.join(F.broadcast(folds), test | train).withColumn("role", F.when(test, "test").otherwise("train")).drop("train_start", "train_end", "test_start", "test_end")


def assign_era(events: DataFrame, eras: list[tuple[str, int, int]]) -> DataFrame:
    """events (date) with the era whose years, both included, hold the date; null outside all."""
    year = F.year("date")
    era = F.coalesce(*(F.when(year.between(a, b), name) for name, a, b in eras))
    return events.withColumn("era", era)
