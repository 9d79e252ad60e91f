"""Point-in-time joins. A row may only use what was known at its own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False, max_age: int | None = None, split_days: int | None = None) -> DataFrame:
    """left with the values of right's newest row of the same key whose `on` is not later (strict: earlier), and its
    `on` as matched_on; null beyond max_age days.

    One shuffle on the key: both sides are stacked and the last right row is carried forward. Of right rows with one
    time the largest by value wins. A key's rows are one sort run, which spills. Where single keys are too long for that,
    split_days cuts each key into spans of so many days, which are sorted apart; the last right row before a span comes
    from the spans' own last rows, one each.
    """
    packed = F.struct(F.col(on).alias("matched_on"), *(F.col(v) for v in values))
    r = right.groupBy(*by, on).agg(F.max(packed).alias("_r")).withColumn("_side", F.lit(1 if strict else 0))
    extra = [c for c in left.columns if c not in (*by, on)]
    l = left.select(*by, on, F.struct(*extra).alias("_l") if extra else F.lit(None).cast("struct<_:int>").alias("_l")).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_left", F.lit(True))
    keys = list(by)
    if split_days:
        span = F.floor(F.unix_date(F.to_date(on)) / split_days).alias("_span")
        l, r, keys = l.select("*", span), r.select("*", span), [*by, "_span"]
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_left")
    if split_days:
        ends = r.groupBy(*keys).agg(F.max_by("_r", on).alias("_end"))
        carried = asof_join(l.select(*keys).distinct(), ends, by, "_span", ["_end"], strict=True)
        carried = carried.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col("_span").alias("_s"), "_end")
        same = F.col("_span").eqNullSafe(F.col("_s"))
        for i, k in enumerate(by):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        both = both.join(carried, same, "left").withColumn("_m", F.coalesce("_m", "_end"))
    fresh = F.lit(True) if max_age is None else F.date_diff(F.col(on), F.col("_m.matched_on")) <= max_age
    return both.select(*by, on, *(F.col("_l")[c].alias(c) for c in extra), *(F.when(fresh, F.col("_m")[v]).alias(v) for v in ("matched_on", *values)))


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], max_ahead: int | None = None) -> DataFrame:
    """left with the values of right's oldest row of the same key whose `on` is not earlier, and its `on` as matched_on;
    null where it lies more than max_ahead days ahead. Of right rows with one time the largest by value wins.

    One shuffle on the key: both sides are stacked, newest first, and the last right row is carried towards the past.
    """
    packed = F.struct(F.col(on).alias("matched_on"), *(F.col(v) for v in values))
    r = right.groupBy(*by, on).agg(F.max(packed).alias("_r")).withColumn("_side", F.lit(0))
    extra = [c for c in left.columns if c not in (*by, on)]
    l = left.select(*by, on, F.struct(*extra).alias("_l") if extra else F.lit(None).cast("struct<_:int>").alias("_l")).withColumn("_side", F.lit(1)).withColumn("_left", F.lit(True))
    w = Window.partitionBy(*by).orderBy(F.desc(on), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_left")
    near = F.lit(True) if max_ahead is None else F.date_diff(F.col("_m.matched_on"), F.col(on)) <= max_ahead
    return both.select(*by, on, *(F.col("_l")[c].alias(c) for c in extra), *(F.when(near, F.col("_m")[v]).alias(v) for v in ("matched_on", *values)))


def within_intervals(events: DataFrame, intervals: DataFrame, key: str, at: str, values: list[str], closed: bool = True) -> DataFrame:
    """events with the values of each interval (key, valid_from, valid_to) of their key that holds their day.

    An interval goes to the one or two buckets that it touches of the narrowest width (64 days, 256, ...) not below its
    length, and an event looks into its bucket of each width, so neither long intervals nor hot keys multiply.
    """
    widths = [64, 256, 1024, 4096, 1 << 40]
    length = F.date_diff("valid_to", "valid_from")
    width = F.coalesce(*(F.when(length <= w, F.lit(w)) for w in widths))
    day = lambda c: F.unix_date(c).cast("long")
    spread = intervals.where("valid_from <= valid_to").select(F.col(key).alias("_k"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)), width.cast("long").alias("_w"), F.sequence(F.floor(day("valid_from") / width), F.floor(day("valid_to") / width)).alias("_bs"))
    spread = spread.withColumn("_b", F.explode("_bs")).drop("_bs").distinct()
    asked = events.withColumn("_x", F.explode(F.array(*(F.struct(F.lit(w).cast("long").alias("w"), F.floor(day(at) / w).alias("b")) for w in widths))))
    inside = (F.col(at) >= F.col("_from")) & ((F.col(at) <= F.col("_to")) if closed else (F.col(at) < F.col("_to")))
    found = asked.join(spread, (F.col(key) == F.col("_k")) & (F.col("_x.w") == F.col("_w")) & (F.col("_x.b") == F.col("_b")) & inside)
    return found.select(*events.columns, *(F.col(f"_v{i}").alias(v) for i, v in enumerate(values)))


def latest_as_of(facts: DataFrame, grid: DataFrame, keys: list[str], period: str, accepted: str, as_of: str, order: list[Column], max_age: int | None = None) -> DataFrame:
    """For each grid row (keys, as_of) and period the newest fact accepted by then; ties by `order`, last one largest.
    Facts older than max_age days at the grid's time are left out.

    A key's grid rows meet each of its periods once; facts are stacked with them and the last one is carried forward.
    """
    ties = [f"_o{i}" for i in range(len(order))]
    side = facts.where(F.col(accepted).isNotNull()).select(*keys, period, F.col(accepted).alias("_t"), F.lit(0).alias("_side"), *(c.alias(t) for c, t in zip(order, ties, strict=True)), F.struct(*(c for c in facts.columns if c not in keys)).alias("_f"))
    cells = grid.where(F.col(as_of).isNotNull()).select(*keys, as_of).distinct().join(facts.select(*keys, period).distinct(), keys)
    both = side.unionByName(cells.select(*keys, period, F.col(as_of).alias("_t"), F.lit(1).alias("_side"), F.col(as_of).alias("_as_of")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, period).orderBy("_t", "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_f", ignorenulls=True).over(w)).where("_side = 1 and _m is not null")
    fresh = F.lit(True) if max_age is None else F.date_diff("_as_of", F.to_date(F.col("_m")[accepted])) <= max_age
    return found.where(fresh).select(*keys, F.col("_as_of").alias(as_of), *(F.col("_m")[c].alias(c) for c in facts.columns if c not in keys))


def interval_lookup(events: DataFrame, intervals: DataFrame, key: str, at: str, event_id: str, value: str, closed: bool = True) -> DataFrame:
    """(event_id, status, value): the value valid at the event's day, MAPPED, or UNMAPPED (none) or AMBIGUOUS (several)."""
    inside = within_intervals(events.select(event_id, key, at), intervals, key, at, [value], closed).groupBy(event_id).agg(F.collect_set(value).alias("_v"))
    found = events.select(event_id).distinct().join(inside, event_id, "left").withColumn("_v", F.coalesce("_v", F.array()))
    status = F.when(F.size("_v") == 0, "UNMAPPED").when(F.size("_v") == 1, "MAPPED").otherwise("AMBIGUOUS")
    return found.select(event_id, status.alias("status"), F.when(F.size("_v") == 1, F.element_at("_v", 1)).alias(value))


def event_window_features(signals: DataFrame, events: DataFrame, key: str, days: int, actor: str) -> DataFrame:
    """signals (key, signal_date) with the events of [signal - days, signal): any, number, distinct actors, latest.

    Days are dealt to buckets of the window's width, and each signal meets two of them, so the join is an equi-join.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / days)
    s = signals.select(key, "signal_date").distinct().withColumn("_b", F.explode(F.array(bucket(F.col("signal_date")), bucket(F.col("signal_date")) - 1)))
    e = events.select(key, F.col("date").alias("_d"), F.col(actor).alias("_a")).withColumn("_b", bucket(F.col("_d")))
    near = (F.col("_d") < F.col("signal_date")) & (F.col("_d") >= F.date_sub("signal_date", days))
    found = s.join(e, [key, "_b"]).where(near).groupBy(key, "signal_date").agg(F.count("*").alias("n"), F.count_distinct("_a").alias("actors"), F.max("_d").alias("latest"))
    return signals.join(found, [key, "signal_date"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("actors", F.coalesce("actors", F.lit(0))).withColumn("seen", F.col("n") > 0)


def session_offset(events: DataFrame, bars: DataFrame, k: int, values: list[str]) -> DataFrame:
    """events (entity, date) with the k-th session after their day: entry k = 1 is the next session."""
    pos = bars.select("entity", F.col("date").alias("session"), *values).withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("session")))
    last = pos.select("entity", F.col("session").alias("date"), F.col("_i").alias("_p"))
    placed = asof_join(events, last, ["entity"], "date", ["_p"]).withColumn("_i", F.coalesce("_p", F.lit(0)) + k)
    return placed.drop("matched_on", "_p").join(pos, ["entity", "_i"], "left").drop("_i")


def reaction_sessions(events: DataFrame, bars: DataFrame, at: str, before: int = 1, after: int = 2, zone: str = "America/New_York", opens: str = "09:30") -> DataFrame:
    """events (entity, instant) with the sessions around their reaction: base, `before` sessions earlier, and end,
    `after` sessions later; none of both where either lies outside the entity's bars.

    The reaction starts with the session of the instant's day in the exchange's zone if it came before the open, else
    with the next one; on days without a session with the next one as well.
    """
    local = F.from_utc_timestamp(F.col(at), zone)
    late = F.date_format(local, "HH:mm") >= opens
    first = F.date_add(F.to_date(local), F.when(late, 1).otherwise(0))
    pos = bars.select("entity", "date").distinct().withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("date")))
    placed = asof_forward(events.withColumn("date", first), pos, ["entity"], "date", ["_i"]).drop("date", "matched_on")
    session = lambda name, k: pos.select("entity", (F.col("_i") + k).alias("_i"), F.col("date").alias(name))
    out = placed.join(session("base", before), ["entity", "_i"], "left").join(session("end", -after), ["entity", "_i"], "left").drop("_i")
    both = F.col("base").isNotNull() & F.col("end").isNotNull()
    return out.withColumn("base", F.when(both, F.col("base"))).withColumn("end", F.when(both, F.col("end")))


def prior_year_match(facts: DataFrame, keys: list[str], period: str, value: str, low: int = 330, high: int = 400) -> DataFrame:
    """facts with the latest value of the same key whose period ended low to high days earlier."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(period)).rangeBetween(-high, -low)
    return facts.withColumn("prior", F.max_by(value, period).over(w))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join that fails on repeated keys: of the right side for m:1, of both for 1:1."""
    for side, name in ((right, "right"), *([(left, "left")] if validate == "1:1" else [])):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated {on} on the {name} side")
    return left.join(right, on, how)


def restrict(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent.select(*on), on, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def pair_within_days(adds: DataFrame, removes: DataFrame, key: str, days: int) -> DataFrame:
    """Pairs of an addition and a removal of one key at most `days` apart; days are bucketed for an equi-join."""
    bucket = lambda d: F.floor(F.unix_date(d) / (days + 1))
    a = adds.select(key, F.col("date").alias("added"), F.col("id").alias("add_id")).withColumn("_b", F.explode(F.array(*(bucket(F.col("added")) + o for o in (-1, 0, 1)))))
    r = removes.select(key, F.col("date").alias("removed"), F.col("id").alias("remove_id")).withColumn("_b", bucket(F.col("removed")))
    return a.join(r, [key, "_b"]).where(F.abs(F.date_diff("added", "removed")) <= days).drop("_b")


def match_evidence(events: DataFrame, filings: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """events (id, key, date) with the number of filings within -before .. +after days and UNIQUE / MULTIPLE / NONE."""
    width = before + after + 1
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    near = F.col("filed").between(F.date_sub("date", before), F.date_add("date", after))
    f = filings.select(F.col(key).alias("_k"), F.col("date").alias("filed"), F.col("id").alias("filing")).withColumn("_b", bucket(F.col("filed")))
    spread = events.select("id", key, "date").withColumn("_e", F.explode_outer(F.array_distinct(F.array(bucket(F.date_sub("date", before)), bucket(F.date_add("date", after))))))
    found = spread.join(f, (F.col(key) == F.col("_k")) & (F.col("_e") == F.col("_b")) & near, "left").groupBy("id").agg(F.count("filing").alias("n"), F.min("filing").alias("filing"))
    return found.select("id", "n", F.when(F.col("n") == 1, F.col("filing")).alias("filing"), F.when(F.col("n") == 0, "NONE").when(F.col("n") == 1, "UNIQUE").otherwise("MULTIPLE").alias("status"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both sides' rows, the newest version of each key winning."""
    return latest(target.unionByName(updates), keys, [F.desc(version)])


def pit_panel(sources: dict[str, DataFrame], cutoff: Column) -> DataFrame:
    """One long panel (source, entity, field, observed, available_at, value) of several sources' rows, cut at what was
    available, keeping each observation's newest version."""
    stacked = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), "entity", "field", "observed", "available_at", "value")
        stacked = one if stacked is None else stacked.unionByName(one)
    return latest(stacked.where(F.col("available_at") <= cutoff), ["source", "entity", "field", "observed"], [F.desc("available_at"), F.desc("value")])


def reconcile(cands: DataFrame, first: DataFrame, second: DataFrame, days: int = 7) -> DataFrame:
    """cands (id, date, action, symbol) resolved by the first source that fits: the same event in `first` (date, action,
    symbol), the same in `second`, the only event of that action and symbol in `first` within `days` days; else a
    distant event needs review, or nothing is known. Adds status and resolved_date.

    Nearby events are met by day buckets, so that a hot symbol does not meet all of its candidates.
    """
    key = ["action", "symbol"]
    a = first.select("date", *key).distinct()
    b = second.select("date", *key).distinct()
    bucket = lambda c: F.floor(F.unix_date(c) / days).cast("long")
    spread = cands.select("id", F.col("date").alias("_d"), *key).withColumn("_b", F.explode(F.array(*(bucket(F.col("_d")) + k for k in (-1, 0, 1)))))
    near = spread.join(a.withColumn("_b", bucket(F.col("date"))), [*key, "_b"]).where(F.abs(F.date_diff("date", "_d")) <= days).groupBy("id").agg(F.count("*").alias("near"), F.min("date").alias("near_date"))
    known = a.select(*key).distinct().withColumn("known", F.lit(True))
    out = cands.join(a.withColumn("in_first", F.lit(True)), ["date", *key], "left").join(b.withColumn("in_second", F.lit(True)), ["date", *key], "left").join(near, "id", "left").join(known, key, "left")
    one = F.col("near") == 1
    status = F.when(F.col("in_first"), "FIRST_EXACT").when(F.col("in_second"), "SECOND_EXACT").when(one, "DATE_CORRECTED").when(F.col("known"), "DISTANT_REVIEW").otherwise("UNRESOLVED")
    resolved = F.when(F.col("in_first") | F.col("in_second"), F.col("date")).when(one, F.col("near_date"))
    return out.select("id", "date", *key, status.alias("status"), resolved.alias("resolved_date"))


def match_controls(treated: DataFrame, pool: DataFrame, by: list[str], covariate: str, caliper: float, forbidden: int) -> DataFrame:
    """Each treated row (id, date, covariate) with its nearest unused control of the same group, in order of date: no
    control within `forbidden` days after any treated row of the group, gap at most caliper, ties to the earlier date.

    Greedy without replacement, so one pass per group (a fold of one entity); both sides of a group lie in one task.
    Controls stand sorted by covariate, and used ones are skipped by pointers to the next free one on either side, so a
    group of n rows takes about n log n steps.
    """
    import numpy as np
    import pandas as pd

    class Free:
        """The nearest free place at or beyond a place, in one direction; used places point past themselves."""

        def __init__(self, free: np.ndarray, step: int) -> None:
            self.step = step
            self.next = np.arange(len(free) + 2)  # places 1 .. n; 0 and n + 1 are the ends
            self.next[1:-1][~free] += step

        def find(self, i: int) -> int:
            root = i
            while self.next[root] != root:
                root = int(self.next[root])
            while self.next[i] != root:
                self.next[i], i = root, int(self.next[i])
            return root

        def use(self, i: int) -> None:
            self.next[i] = i + self.step

    def run(key: tuple, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.dropna(subset=[covariate])
        if t.empty or c.empty:
            return pd.DataFrame([], columns=[*by, "id", "control_id", "gap"])
        t, c = t.sort_values(["date", "id"]), c.sort_values([covariate, "date", "id"]).reset_index(drop=True)
        at, starts = pd.to_datetime(c["date"]).to_numpy(), pd.to_datetime(t["date"]).to_numpy()
        last = np.searchsorted(starts, at, side="right") - 1  # the treated row before a control decides
        age = np.where(last >= 0, (at - starts[np.maximum(last, 0)]) / np.timedelta64(1, "D"), np.inf)
        free, x, ids, out = age > forbidden, c[covariate].to_numpy(float), c["id"].to_numpy(), []
        block = np.searchsorted(x, x) + 1  # the first place of each value
        up, down = Free(free, 1), Free(free, -1)
        for row in t.itertuples(index=False):
            v = getattr(row, covariate)
            if v is None or v != v:
                continue
            p, best = int(np.searchsorted(x, v)) + 1, None
            right, left = up.find(p), down.find(p - 1)
            for i in (right if right <= len(x) else None, up.find(int(block[left - 1])) if left else None):
                if i is not None:  # of equal values the first free place is the earliest
                    best = min(best or (np.inf,), (abs(x[i - 1] - v), at[i - 1], ids[i - 1], i))
            if best and best[0] <= caliper:
                up.use(best[3])
                down.use(best[3])
                out.append((*key, row.id, best[2], float(best[0])))
        return pd.DataFrame(out, columns=[*by, "id", "control_id", "gap"])

    kinds = ", ".join(f"`{k}` {treated.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{kinds}, id {treated.schema['id'].dataType.simpleString()}, control_id {pool.schema['id'].dataType.simpleString()}, gap double"
    cols = [*by, "id", "date", covariate]
    return treated.select(*cols).groupBy(*by).cogroup(pool.select(*(F.col(c).alias(c) for c in cols)).groupBy(*by)).applyInPandas(run, schema)
