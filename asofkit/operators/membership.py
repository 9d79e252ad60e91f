"""Membership intervals and reconciliations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def membership_intervals(snapshots: DataFrame) -> DataFrame:
    """Member rows (date, entity) on snapshot dates to end-exclusive intervals (entity, valid_from, valid_to); the last
    interval stays open (null). A member missing from a snapshot ends there."""
    days = snapshots.select("date").distinct()
    order = Window.orderBy("date")  # one row per snapshot date
    days = days.withColumn("i", F.row_number().over(order)).withColumn("following", F.lead("date").over(order))
    rows = snapshots.select("date", "entity").distinct().join(days, "date")
    island = F.col("i") - F.row_number().over(Window.partitionBy("entity").orderBy("i"))
    return rows.withColumn("g", island).groupBy("entity", "g").agg(F.min("date").alias("valid_from"), F.max_by("following", "i").alias("valid_to")).drop("g")


def validate_intervals(iv: DataFrame) -> DataFrame:
    """Intervals that overlap the entity's next one, or stay open before it."""
    w = Window.partitionBy("entity").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    nxt = iv.withColumn("next_from", F.lead("valid_from").over(w)).where("next_from is not null")
    problem = F.when(F.col("valid_to").isNull(), "OPEN_BEFORE_NEXT").when(F.col("valid_to") > F.col("next_from"), "OVERLAP")
    return nxt.withColumn("problem", problem).where("problem is not null")


def members_at(iv: DataFrame, day) -> DataFrame:
    return iv.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))).select("entity").distinct()


def survivorship_coverage(records: DataFrame, fixed: DataFrame, least_gone: int = 10, least_coverage: float = 0.5) -> DataFrame:
    """One row over membership records (entity, exit_reason, source, sector) and today's entities (entity): how many of
    each there are, entities that did not survive, historical over present entities, records by exit reason (the reason
    `active` aside, as a sorted array of pairs), and whether the records are ready for point-in-time use: each with
    source and sector, enough that did not survive, and enough coverage."""
    now = fixed.select("entity").where("entity is not null").distinct()
    past = records.select("entity").where("entity is not null").distinct()
    gone = past.join(now, "entity", "left_anti").agg(F.count("*").alias("gone"))
    told = records.agg(F.count("*").alias("records"), F.coalesce(F.every((F.coalesce("source", F.lit("")) != "") & (F.coalesce("sector", F.lit("")) != "")), F.lit(False)).alias("dated"))
    exits = records.where("exit_reason <> 'active'").groupBy("exit_reason").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("exit_reason", "n"))).alias("exits"))
    counts = past.agg(F.count("*").alias("historical")).join(now.agg(F.count("*").alias("fixed"))).join(gone).join(told).join(exits)  # one row each
    share = F.coalesce(F.try_divide(F.col("historical").cast("double"), F.col("fixed")), F.lit(0.0))
    ready = F.col("dated") & (F.col("gone") >= least_gone) & (share >= least_coverage)
    return counts.select("fixed", "records", "historical", "gone", share.alias("coverage"), "exits", F.when(ready, "POINT_IN_TIME_READY").otherwise("SURVIVORSHIP_BIAS_REMAINS").alias("status"))


def drop_windows(df: DataFrame, centres: DataFrame, before: int, after: int) -> DataFrame:
    """df without each entity's rows from `before` rows before a centre to `after` rows after it."""
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("date")))
    around = numbered.join(centres.select("entity", "date"), ["entity", "date"], "left_semi").select("entity", F.explode(F.sequence(F.col("_i") - before, F.col("_i") + after)).alias("_i")).distinct()
    return numbered.join(around, ["entity", "_i"], "left_anti").drop("_i")


def replay_membership(base: DataFrame, ledger: DataFrame) -> DataFrame:
    """A ledger (entity, date, action ADD or REMOVE) over base members: running state, and anomalies where an absent
    member is removed or a present one added."""
    w = Window.partitionBy("entity").orderBy("date", "action").rowsBetween(Window.unboundedPreceding, -1)
    signed = ledger.join(base.select("entity", F.lit(1).alias("_base")), "entity", "left").withColumn("step", F.when(F.col("action") == "ADD", 1).otherwise(-1))
    state = F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum("step").over(w), F.lit(0))
    anomaly = F.when((F.col("action") == "ADD") & (F.col("before") >= 1), "ADD_EXISTING").when((F.col("action") == "REMOVE") & (F.col("before") <= 0), "REMOVE_ABSENT")
    return signed.withColumn("before", state).withColumn("anomaly", anomaly).drop("_base", "step")


def observation_intervals(anchors: DataFrame, keys: list[str], gap: int, least: int) -> DataFrame:
    """Clusters of a key's dates (gaps of more than `gap` days split) with at least `least` anchors."""
    w = Window.partitionBy(*keys).orderBy("date")
    new = F.coalesce(F.date_diff("date", F.lag("date").over(w)) > gap, F.lit(True)).cast("int")
    islands = anchors.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    return islands.groupBy(*keys, "g").agg(F.min("date").alias("valid_from"), F.max("date").alias("valid_to"), F.count("*").alias("anchors")).where(F.col("anchors") >= least).drop("g")


def mark_conflicts(iv: DataFrame, symbol: str, owner: str) -> DataFrame:
    """Intervals that overlap one of another owner of the same symbol are conflicting."""
    bucket = lambda c: F.floor(F.unix_date(c) / 64)
    # Intervals meet by the buckets of 64 days that both touch.
    own = iv.select(symbol, owner, "valid_from", "valid_to").distinct().withColumn("_b", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(F.col("valid_to")))))
    other = own.select(F.col(symbol).alias("_s"), F.col(owner).alias("_o"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"), F.col("_b").alias("_c"))
    hit = (F.col(symbol) == F.col("_s")) & (F.col("_b") == F.col("_c")) & (F.col(owner) != F.col("_o")) & (F.col("valid_from") <= F.col("_t")) & (F.col("_f") <= F.col("valid_to"))
    keys = [symbol, owner, "valid_from", "valid_to"]
    bad = own.join(other, hit, "left_semi").select(*keys).distinct().withColumn("conflict", F.lit(True))
    return iv.join(bad, keys, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False))).select(*iv.columns, "conflict")


def effective_holdings(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """Holdings (filing, security, value) in force after each filing (filing, manager, period, seq, operation) of a
    manager and period: a snapshot replaces what was, an ADD supplies securities that are absent. Filings without
    holdings change nothing. A security's earliest row since the last snapshot counts."""
    events = filings.where("operation <> 'EXCLUDE'").join(holdings.select("filing").distinct(), "filing", "left_semi")
    w = Window.partitionBy("manager", "period").orderBy("seq")
    grouped = events.withColumn("grp", F.sum((F.col("operation") != "ADD").cast("int")).over(w))
    rows = holdings.join(grouped, "filing")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("manager", "period", "grp", "security").orderBy("seq"))).where("n = 1").select("manager", "period", "grp", "security", "value", F.col("seq").alias("since"))
    return grouped.select("filing", "manager", "period", "seq", "grp").join(first, ["manager", "period", "grp"]).where("since <= seq").drop("grp", "since")


def reconcile_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of two ledgers as VERIFIED (both), MISSING (only in b) or EXTRA (only in a), counted."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full_outer")
    status = F.when(F.col("_a").isNull(), "MISSING").when(F.col("_b").isNull(), "EXTRA").otherwise("VERIFIED")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def apply_transitions(intervals: DataFrame, transitions: DataFrame) -> DataFrame:
    """intervals (id, symbol, valid_from, valid_to) repaired at verified changes of symbol (id, old, new, effective): the
    old symbol's latest interval that began by then reaches the day before, and the new one's earliest interval that had
    not ended begins on the day. Changes apply where both exist, each to the intervals as given. Adds how many did."""
    t = transitions.where("old <> new").select("id", "old", "new", "effective").distinct()
    iv = intervals.select("id", "symbol", "valid_from", "valid_to").distinct()
    old = t.join(iv.withColumnRenamed("symbol", "old"), ["id", "old"]).where("valid_from <= effective").groupBy("id", "old", "new", "effective").agg(F.max(F.struct("valid_to", "valid_from")).alias("o"))
    new = t.join(iv.withColumnRenamed("symbol", "new"), ["id", "new"]).where("valid_to >= effective").groupBy("id", "old", "new", "effective").agg(F.min(F.struct("valid_from", "valid_to")).alias("n"))
    both = old.join(new, ["id", "old", "new", "effective"])
    ends = both.select("id", F.col("old").alias("symbol"), F.col("o.valid_from").alias("valid_from"), F.col("o.valid_to").alias("valid_to"), F.date_sub("effective", 1).alias("end"), F.lit(None).cast("date").alias("begin"))
    begins = both.select("id", F.col("new").alias("symbol"), F.col("n.valid_from").alias("valid_from"), F.col("n.valid_to").alias("valid_to"), F.lit(None).cast("date").alias("end"), F.col("effective").alias("begin"))
    changes = ends.unionByName(begins).groupBy("id", "symbol", "valid_from", "valid_to").agg(F.max("end").alias("end"), F.min("begin").alias("begin"), F.count("*").alias("repairs"))
    out = intervals.join(changes, ["id", "symbol", "valid_from", "valid_to"], "left")
    return out.select("id", "symbol", F.least("valid_from", F.coalesce("begin", "valid_from")).alias("valid_from"), F.greatest("valid_to", F.coalesce("end", "valid_to")).alias("valid_to"), F.coalesce("repairs", F.lit(0)).alias("repairs"))


def positions_at(holdings: DataFrame, filings: DataFrame, waves: DataFrame) -> DataFrame:
    """Positions known at each wave (period, available): by holder its newest usable filing of the period that was
    available by then (by availability, filing date, filing), summed by security and holder where positive. filings:
    filing, holder, period, available, filed; holdings: filing, security, value."""
    w = waves.select("period", F.col("available").alias("wave"))
    seen = w.join(filings, "period").where("available <= wave")
    newest = F.row_number().over(Window.partitionBy("period", "wave", "holder").orderBy(F.desc("available"), F.desc("filed"), F.desc("filing")))
    kept = seen.withColumn("n", newest).where("n = 1").select("period", "wave", "holder", "filing")
    return kept.join(holdings, "filing").groupBy("period", "wave", "security", "holder").agg(F.sum("value").alias("value")).where("value > 0")
