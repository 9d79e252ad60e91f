"""Linking of names and identifiers, scenario membership, and further summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_alias(names: DataFrame, name: str, owner: str) -> DataFrame:
    """(alias, owner) of aliases that name one owner only."""
    return names.groupBy(F.col(name).alias("alias")).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias("owner")).where("n = 1").select("alias", "owner")


def link_names(events: DataFrame, names: DataFrame, name: str, owner: str, strip: str) -> DataFrame:
    """events (id, name) with the owner of the exact name, else of the name without the suffix pattern; unique only."""
    bare = lambda c: F.trim(F.regexp_replace(c, strip, ""))
    exact = unique_alias(names, name, owner).select(F.col("alias").alias("_a"), F.col("owner").alias("_x"))
    short = unique_alias(names.withColumn("_s", bare(F.col(name))), "_s", owner).select(F.col("alias").alias("_b"), F.col("owner").alias("_y"))
    out = events.join(exact, F.col(name) == F.col("_a"), "left").join(short, bare(F.col(name)) == F.col("_b"), "left")
    how = F.when(F.col("_x").isNotNull(), "EXACT").when(F.col("_y").isNotNull(), "STRIPPED").otherwise("NONE")
    return out.select("id", F.coalesce("_x", "_y").alias("owner"), how.alias("how"))


def resolve_identity(rows: DataFrame, by_name: DataFrame, by_signature: DataFrame, by_number: DataFrame) -> DataFrame:
    """rows (id, name, signature, number) with the owner by name, else signature, else number; a name and a number that
    disagree are a conflict without owner. The maps are (alias, owner)."""
    pick = lambda m, key, out: m.select(F.col("alias").alias(f"_{key}"), F.col("owner").alias(out))
    joined = rows
    for m, key, out in ((by_name, "name", "o1"), (by_signature, "signature", "o2"), (by_number, "number", "o3")):
        joined = joined.join(pick(m, key, out), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    named = F.coalesce("o1", "o2")
    conflict = named.isNotNull() & F.col("o3").isNotNull() & (named != F.col("o3"))
    how = F.when(conflict, "CONFLICT").when(F.col("o1").isNotNull(), "NAME").when(F.col("o2").isNotNull(), "SIGNATURE").when(F.col("o3").isNotNull(), "NUMBER").otherwise("NONE")
    return joined.select("id", F.when(~conflict, F.coalesce("o1", "o2", "o3")).alias("owner"), how.alias("how"))


def identifier_intervals(obs: DataFrame, identifier: str, owner: str, date: str) -> DataFrame:
    """First and last quarter end of each identifier of an owner, quarters seen, and the share of the span they cover."""
    q = F.last_day(F.add_months(F.date_trunc("quarter", date).cast("date"), 2))
    out = obs.groupBy(owner, identifier).agg(F.min(q).alias("first"), F.max(q).alias("last"), F.count_distinct(q).alias("quarters"))
    span = (F.year("last") * 4 + F.quarter("last")) - (F.year("first") * 4 + F.quarter("first")) + 1
    return out.withColumn("coverage", F.col("quarters") / span)


def primary_security(obs: DataFrame, entity: str, period: str, issuer: str, number: str, code: str, filing: str) -> DataFrame:
    """The security of each entity and period after its identifier variants are merged: entity, period, issuer, number,
    code, filings, rows.

    Rows of one issuer, entity and number are one security, whatever code they carry; it keeps the code if there is just
    one, else none (empty). Of an entity's securities in a period the one with the most filings there wins, then the one
    with the most rows in all periods, then the largest number, then the largest issuer.
    """
    own = [issuer, entity, number]
    given = F.when(F.col(code) != "", F.col(code))
    each = obs.groupBy(*own, period).agg(F.count_distinct(filing).alias("filings"), F.count("*").alias("_n"), F.min(given).alias("_least"), F.max(given).alias("_most"))
    whole = each.groupBy(*own).agg(F.sum("_n").alias("rows"), F.min("_least").alias("_a"), F.max("_most").alias("_b"))
    merged = whole.select(*own, "rows", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("").alias(code))
    turn = F.row_number().over(Window.partitionBy(entity, period).orderBy(F.desc("filings"), F.desc("rows"), F.desc(number), F.desc(issuer)))
    return each.join(merged, own).withColumn("_turn", turn).where("_turn = 1").select(entity, period, issuer, number, code, "filings", "rows")


def revision_pairs(ranges: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Consecutive ranges (low, high) of one identity with the change of their midpoints."""
    w = Window.partitionBy(*keys).orderBy(*at)
    mid = (F.col("low") + F.col("high")) / 2
    out = ranges.withColumn("mid", mid).withColumn("before", F.lag("mid").over(w)).where("before is not null")
    return out.withColumn("delta", F.col("mid") - F.col("before")).withColumn("ratio", F.try_divide(F.col("mid"), F.col("before")) - 1)


def disclosure_change(panel: DataFrame, col: str) -> DataFrame:
    """(entity, date, accepted_at, col) with the change between successive disclosures, carried forward over dates that
    repeat one."""
    first = panel.groupBy("entity", "accepted_at").agg(F.min_by(col, "date").alias("_v"))
    changed = first.withColumn("change", F.col("_v") - F.lag("_v").over(Window.partitionBy("entity").orderBy("accepted_at"))).drop("_v")
    return panel.join(changed, ["entity", "accepted_at"], "left")


def scenario_membership(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Baseline members (scenario, entity) from a start date and changes (scenario, entity, date, action ADD or REMOVE)
    to end-exclusive intervals per scenario."""
    events = base.select("scenario", "entity", F.col("start").alias("date"), F.lit("ADD").alias("action")).unionByName(changes.select("scenario", "entity", "date", "action"))
    w = Window.partitionBy("scenario", "entity").orderBy("date", "action")
    return events.withColumn("valid_to", F.lead("date").over(w)).where("action = 'ADD' and (valid_to is null or valid_to > date)").select("scenario", "entity", F.col("date").alias("valid_from"), "valid_to")


def closed_loops(events: DataFrame, gap: int = 7) -> DataFrame:
    """Clusters of an entity's signed events (date, step), gaps of at most `gap` days, whose steps add up to zero."""
    w = Window.partitionBy("entity").orderBy("date", "step")
    new = F.coalesce(F.date_diff("date", F.lag("date").over(w)) > gap, F.lit(True)).cast("int")
    islands = events.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    return islands.groupBy("entity", "g").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("events"), F.sum("step").alias("net")).where("events > 1 and net = 0").drop("g")


def selection_stability(history: DataFrame, by: list[str], fold: str, choice: str) -> DataFrame:
    """Per group the folds, distinct choices, most frequent choice's share, and share of folds that repeat the last."""
    w = Window.partitionBy(*by).orderBy(fold)
    repeated = history.withColumn("again", (F.col(choice) == F.lag(choice).over(w)).cast("double"))
    counts = repeated.groupBy(*by, choice).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("most"), F.count("*").alias("choices"), F.sum("n").alias("folds"))
    return counts.join(repeated.groupBy(*by).agg(F.avg("again").alias("repeat_rate")), by).select(*by, "folds", "choices", (F.col("most") / F.col("folds")).alias("top_share"), "repeat_rate")


def non_overlapping(events: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Events of a key whose outcome starts after the last kept one's ends. Of events that start on one day only the first
    to end can be kept, so a key has a row a day at most; one pass over each key's days."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s").reset_index(drop=True)
        kept, last = [], None
        for i, (s, e) in enumerate(zip(part["s"], part["e"])):
            if last is None or s > last:
                kept.append(i)
                last = e
        return part.loc[kept]

    days = events.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, F.col(start).alias("s")).agg(F.min(end).alias("e"))
    return days.groupBy(*keys).applyInPandas(run, days.schema).withColumnsRenamed({"s": start, "e": end})


def rank_gaps(coverage: DataFrame, owner: str, symbol: str, gap: str, limit: int) -> DataFrame:
    """Owners by their largest unresolved gap: best symbol, all symbols, total gap; the top of a work queue."""
    best = coverage.groupBy(owner).agg(F.max_by(symbol, F.struct(gap, symbol)).alias("best"), F.array_sort(F.collect_set(symbol)).alias("symbols"), F.max(gap).alias("largest"), F.sum(gap).alias("total"))
    return best.orderBy(F.desc("largest"), F.desc("total"), owner).limit(limit)
