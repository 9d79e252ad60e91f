"""Account ledgers: totals, FIFO lots, valuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger_totals(entries: DataFrame) -> DataFrame:
    """Per account from (account, type, gross, fee): cash, dividends, fees and net contributions. Types are DEPOSIT,
    WITHDRAWAL, BUY, SELL, DIVIDEND; decimals stay decimals."""
    is_ = lambda *t: F.col("type").isin(*t)
    cash = F.when(is_("DEPOSIT", "SELL", "DIVIDEND"), F.col("gross")).when(is_("WITHDRAWAL", "BUY"), -F.col("gross")).otherwise(0) - F.col("fee")
    pick = lambda *t: F.sum(F.when(is_(*t), F.col("gross")).otherwise(0))
    return entries.groupBy("account").agg(F.sum(cash).alias("cash"), pick("DIVIDEND").alias("dividends"), F.sum("fee").alias("fees"), (pick("DEPOSIT") - pick("WITHDRAWAL")).alias("contributions"))


def fifo_lots(entries: DataFrame) -> DataFrame:
    """Per account and symbol from (account, symbol, seq, type BUY / SELL / SPLIT, quantity, price, ratio): realised
    profit, open quantity, cost of the open lots, and whether it was oversold (such rows have no figures).

    Quantities are restated by the splits that follow them. Buys and sells then cover intervals of cumulative quantity,
    and a sale takes from the buys whose intervals it overlaps. One shuffle by account and symbol serves all steps.
    """
    by = ["account", "symbol"]
    # What follows a row is read backwards: a frame that starts at the beginning grows row by row.
    later = Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    factor = F.exp(F.coalesce(F.sum(F.when(F.col("type") == "SPLIT", F.log("ratio"))).over(later), F.lit(0.0)))
    e = entries.withColumn("f", factor).where("type <> 'SPLIT'").withColumn("q", F.col("quantity") * F.col("f")).withColumn("p", F.col("price") / F.col("f"))
    run = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda kind: F.col("type") == kind
    upto = lambda kind: F.sum(F.when(is_(kind), F.col("q"))).over(run)
    held = F.sum(F.when(is_("BUY"), F.col("q")).otherwise(-F.col("q"))).over(run)
    e = e.select(*by, "seq", "type", "q", "p", held.alias("held"), F.when(is_("BUY"), upto("BUY")).otherwise(upto("SELL")).alias("upto"))
    # Both lists of cumulative bounds are merged by one sort, read from its end; the part before a bound belongs to the
    # next buy and sale, and is still open if no sale follows.
    order = Window.partitionBy(*by).orderBy(F.desc("upto"), F.desc("type"), F.desc("seq"))
    owner = lambda kind: F.last(F.when(is_(kind), F.col("p")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = e.select("*", (F.col("upto") - F.coalesce(F.lead("upto").over(order), F.lit(0.0))).alias("part"), owner("BUY").alias("bp"), owner("SELL").alias("sp"))
    sum_of = lambda on, c: F.coalesce(F.sum(F.when(on, c)), F.lit(0.0))
    bought, sold = F.col("bp").isNotNull(), F.col("sp").isNotNull()
    out = parts.groupBy(*by).agg(
        (F.min("held") < -1e-9).alias("oversold"),
        sum_of(bought & sold, F.col("part") * (F.col("sp") - F.col("bp"))).alias("realised"),
        (sum_of(is_("BUY"), F.col("q")) - sum_of(is_("SELL"), F.col("q"))).alias("open_quantity"),
        sum_of(bought & ~sold, F.col("part") * F.col("bp")).alias("cost"),
    )
    return out.select(*by, "oversold", *(F.when(~F.col("oversold"), F.col(c)).alias(c) for c in ("realised", "open_quantity", "cost")))


def value_holdings(holdings: DataFrame, bars: DataFrame) -> DataFrame:
    """(account, entity, quantity, cost) with the latest close and the one before: value, gain, day change."""
    w = Window.partitionBy("entity").orderBy(F.desc("date"))
    last = bars.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("entity").agg(F.max(F.when(F.col("n") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("n") == 2, F.col("close"))).alias("before"))
    v = holdings.join(last, "entity", "left")
    return v.select("account", "entity", (F.col("quantity") * F.col("close")).alias("value"), (F.try_divide(F.col("quantity") * F.col("close"), F.col("cost")) - 1).alias("gain"), (F.try_divide("close", "before") - 1).alias("day_change"), F.col("close").isNull().alias("incomplete"))


def value_ledger(positions: DataFrame, cash: DataFrame, bars: DataFrame) -> DataFrame:
    """Per account from open positions (account, symbol, quantity, cost), cash (account, cash) and bars (entity, date,
    close): status LEDGER_READY, or PRICE_INCOMPLETE where a position has no price (then it has no values), market and
    account value, cost, unrealised profit, the oldest price date, and whether cash is negative."""
    last = bars.where("close is not null").groupBy("entity").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("priced"))
    held = positions.where("quantity > 0").join(last, F.col("symbol") == F.col("entity"), "left")
    sums = held.groupBy("account").agg(F.every(F.col("price").isNotNull()).alias("complete"), F.sum(F.col("quantity") * F.col("price")).alias("market"), F.sum("cost").alias("cost"), F.min("priced").alias("price_as_of"), F.count("*").alias("positions"))
    out = cash.join(sums, "account", "left").withColumn("complete", F.coalesce("complete", F.lit(True))).fillna(0, ["market", "cost", "positions"])
    whole = lambda c: F.when(F.col("complete"), c)
    return out.select(
        "account", F.when(F.col("complete"), "LEDGER_READY").otherwise("PRICE_INCOMPLETE").alias("status"), "positions", "cash", whole(F.col("market")).alias("market_value"), whole(F.col("cash") + F.col("market")).alias("account_value"), "cost",
        whole(F.col("market") - F.col("cost")).alias("unrealised"), "price_as_of", (F.col("cash") < 0).alias("cash_negative"),
    )


def twr(values: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """Time-weighted return per account from daily (account, date, value, flow), flows arriving at the day's end: each
    day's growth is (value - flow) over the value before; a value of zero or less ends in -1, and days after it, which
    have no growth, do not count. With a benchmark (date, close), its return from the account's first day to its last."""
    w = Window.partitionBy("account").orderBy("date")
    before = F.lag("value").over(w)
    growth = F.when(before > 0, F.greatest(F.col("value") - F.col("flow"), F.lit(0.0)) / before)
    daily = values.withColumn("growth", growth)
    gone = F.coalesce(F.bool_or(F.col("growth") == 0), F.lit(False))
    each = daily.groupBy("account").agg(F.count("growth").alias("days"), F.when(gone, F.lit(-1.0)).otherwise(F.exp(F.sum(F.when(F.col("growth") > 0, F.log("growth")))) - 1).alias("twr"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    if benchmark is None:
        return each.drop("_a", "_b")
    price = benchmark.select(F.col("date").alias("_d"), F.col("close").alias("_c"))
    first, last = (price.withColumnsRenamed({"_d": d, "_c": c}) for d, c in (("_a", "_first"), ("_b", "_last")))
    out = each.join(first, "_a", "left").join(last, "_b", "left").withColumn("benchmark", F.try_divide("_last", "_first") - 1)
    return out.select("account", "days", "twr", "benchmark", (F.col("twr") - F.col("benchmark")).alias("excess"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, salt: str) -> DataFrame:
    """n rows of each stratum by the order of a salted hash of the key: the same rows on any cluster."""
    order = F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256)
    return df.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key))).where(F.col("_n") <= n).drop("_o", "_n")


def change_feed(obs: DataFrame, cursors: DataFrame, col: str, limit: int) -> DataFrame:
    """Each reader's unseen changes (reader, cursor) of a value, newest first, at most `limit`. cursors hold one row per
    reader. The changes after a cursor come first among all, so only the `limit` newest are broadcast to the readers."""
    w = Window.partitionBy("entity").orderBy("date")
    changed = obs.withColumn("previous", F.lag(col).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(col)))
    newest = changed.orderBy(F.desc("date"), "entity").limit(limit)
    ranked = newest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("date"), "entity")))  # at most `limit` rows
    return cursors.join(F.broadcast(ranked), F.col("date") > F.col("cursor"))
