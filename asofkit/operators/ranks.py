"""Ranks and quantiles of groups of any size.

Equal values are counted first. A group with many distinct values is cut into ranges at the quantiles of a sample that a
hash of the value picks, so that it is the same wherever it is taken; counts per range give each range its offset, and
only a range's own values meet in a window. No window, buffer or task holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that make a group worth cutting, and about as many as its sample has.
SAMPLE = 4096
_RANGES = 256  # found by halving, so a power of two
#: Groups with more than this share of all distinct values are broadcast; there are no more than its inverse.
_HEAVY = 1 / 2000


def count_values(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by, value, n) of the values other than null."""
    return df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("n"))


def _same(by: list[str], side: str) -> Column:
    """The groups are equal, null being a group of its own."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{side}{i}")) for i, k in enumerate(by)), F.lit(True))


def _named(df: DataFrame, by: list[str], side: str, *rest) -> DataFrame:
    return df.select(*(F.col(k).alias(f"{side}{i}") for i, k in enumerate(by)), *rest)


def _by_group(rows: DataFrame, groups: DataFrame, by: list[str], *wanted: str) -> DataFrame:
    """rows with the wanted columns of their group; groups holds each once, with its number of rows _d; other rows go.

    Rows of large groups stay where they are, so that no group lands in one task.
    """
    if not by:
        return rows.join(F.broadcast(groups.select(*wanted)))
    marked = groups.crossJoin(F.broadcast(groups.agg((F.sum("_d") * _HEAVY).alias("_limit"))))
    heavy, light = (_named(marked.where(on), by, "_g", *wanted) for on in (F.col("_d") > F.col("_limit"), F.col("_d") <= F.col("_limit")))
    large = rows.join(F.broadcast(heavy), _same(by, "_g"))
    small = rows.join(F.broadcast(heavy), _same(by, "_g"), "left_anti").join(light, _same(by, "_g"))
    return large.unionByName(small).select(*rows.columns, *wanted)


def _located(counts: DataFrame, by: list[str], sample: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """counts with total (rows of the group) and the range of each value; further columns of counts that are kept may
    tell rows of one value apart."""
    groups = counts.groupBy(*by).agg(F.count("*").alias("_d"), F.sum("n").alias("total"))
    large = _by_group(counts, groups.where(F.col("_d") > sample).withColumn("_every", F.ceil(F.col("_d") / sample)), by, "_every")
    picked = large.where(F.pmod(F.xxhash64("value"), F.col("_every")) == 0).groupBy(*by).agg(F.sort_array(F.collect_list("value")).alias("_p"))
    cut = lambda i: F.get("_p", F.floor(i * F.size("_p") / _RANGES).cast("int"))
    edges = picked.select(*by, F.transform(F.sequence(F.lit(1), F.lit(_RANGES - 1)), cut).alias("_e"))
    groups = groups.join(_named(edges, by, "_s", "_e"), _same(by, "_s"), "left")
    each = _by_group(counts, groups, by, "total", "_e").withColumn("_b", F.lit(0))
    step = _RANGES
    while step > 1:  # a value's range is the number of edges below it; without edges there is one
        step //= 2
        each = each.withColumn("_b", F.col("_b") + F.when(F.get("_e", F.col("_b") + (step - 1)) < F.col("value"), step).otherwise(0))
    return each.select(*by, *keep, "value", "n", "total", "_b")


def _offsets(located: DataFrame, by: list[str]) -> DataFrame:
    """Rows before and up to the end of each range; a group has 256 at most."""
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranges = located.groupBy(*by, "_b").agg(F.sum("n").alias("_m"), F.max("total").alias("_t")).withColumn("_to", F.sum("_m").over(upto))
    return ranges.withColumn("_from", F.col("_to") - F.col("_m"))


def _within(located: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, n, total, below): rows of the group with a smaller value, for the ranges that offsets names."""
    both = located.join(_named(offsets, by, "_o", F.col("_b").alias("_ob"), "_from"), _same(by, "_o") & (F.col("_b") == F.col("_ob")))
    before = Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("below", F.col("_from") + F.coalesce(F.sum("n").over(before), F.lit(0))).select(*by, "value", "n", "total", "below")


def placed(counts: DataFrame, by: list[str], sample: int = SAMPLE) -> DataFrame:
    """(by, value, n, total, below) of counts (by, value, n), which holds each value of a group once and no null value."""
    located = _located(counts, by, sample)
    return _within(located, _offsets(located, by), by)


def average_ranks(counts: DataFrame, by: list[str], sample: int = SAMPLE) -> DataFrame:
    """(by, value, n, total, rank): 1-based ranks, equal values sharing their mean."""
    return placed(counts, by, sample).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2).drop("below")


def _places(points: dict[str, float], nearest: tuple[str, ...]):
    """The place (from 0) of each point among a group's `total` rows, and by name the whole places around it."""
    place = lambda name, total: F.greatest(F.ceil(total * points[name]) - 1, F.lit(0)) if name in nearest else (total - 1) * F.lit(float(points[name]))
    return place, {f"{name}|{s}": (lambda t, name=name, f=f: f(place(name, t))) for name in points for s, f in (("a", F.floor), ("b", F.ceil))}


def _wanted(offsets: DataFrame, points: dict[str, float], nearest: tuple[str, ...]) -> DataFrame:
    """The ranges that hold a wanted rank."""
    sides = _places(points, nearest)[1].values()
    return offsets.where(reduce(lambda a, b: a | b, ((F.col("_from") <= k(F.col("_t"))) & (k(F.col("_t")) < F.col("_to")) for k in sides)))


def _values_at(found: DataFrame, by: list[str], points: dict[str, float], nearest: tuple[str, ...]) -> DataFrame:
    """(by, points) from placed values that hold all wanted ranks."""
    place, sides = _places(points, nearest)
    held = lambda k: F.max(F.when((F.col("below") <= k(F.col("total"))) & (k(F.col("total")) < F.col("below") + F.col("n")), F.col("value")))
    out = found.groupBy(*by).agg(F.max("total").alias("total"), *(held(k).alias(name) for name, k in sides.items()))
    at = {name: place(name, F.col("total")) for name in points}
    between = lambda n: F.col(f"`{n}|a`") + (F.col(f"`{n}|b`") - F.col(f"`{n}|a`")) * (at[n] - F.floor(at[n]))
    return out.select(*by, *((F.col(f"`{n}|a`") if n in nearest else between(n)).alias(n) for n in points))


def quantiles(df: DataFrame, by: list[str], col: str, points: dict[str, float], nearest: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """(by, points): exact quantiles of the values other than null, linear between neighbours; those named in nearest are
    the smallest value that at least such a share doesn't exceed. Groups without values are absent.

    Only ranges that hold a wanted rank are sorted.
    """
    located = _located(count_values(df, by, col), by, sample)
    return _values_at(_within(located, _wanted(_offsets(located, by), points, nearest), by), by, points, nearest)


def union_quantiles(df: DataFrame, part: list[str], members: DataFrame, group: str, col: str, points: dict[str, float], nearest: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """(group, points): quantiles of groups that share rows. Each row lies in one part (columns other than null), and
    members (group, part) say once which parts a group consists of.

    A row is counted once, however many groups hold it: all parts are cut at the same values, a group's counts by range
    are sums over its parts, and only values of ranges with a wanted rank of a group are copied for it.
    """
    counts = count_values(df, part, col)
    located = _located(counts, [], sample, tuple(part)).drop("total")
    inside = located.groupBy(*part, "_b").agg(F.sum("n").alias("_m")).join(members, part)
    upto, whole = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group)
    ranges = inside.groupBy(group, "_b").agg(F.sum("_m").alias("_m")).withColumn("_to", F.sum("_m").over(upto)).withColumn("_t", F.sum("_m").over(whole)).withColumn("_from", F.col("_to") - F.col("_m"))
    asked = _wanted(ranges, points, nearest).select(group, "_b", "_from", F.col("_t").alias("total")).join(members, group)
    mine = located.join(asked, [*part, "_b"]).groupBy(group, "_b", "value").agg(F.sum("n").alias("n"), F.max("_from").alias("_from"), F.max("total").alias("total"))
    before = Window.partitionBy(group, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return _values_at(mine.withColumn("below", F.col("_from") + F.coalesce(F.sum("n").over(before), F.lit(0))), [group], points, nearest)


def quantile_columns(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], nearest: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """(by, wanted) from one pass over all wanted quantiles, each given as name: (value, share); null where a group has no
    value. Values count as doubles."""
    each = df.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("_f"), c.cast("double").alias("_v")) for n, (c, _) in wanted.items()))))
    shares: dict[tuple, list[str]] = {}
    for n, (_, q) in wanted.items():
        shares.setdefault((q, n in nearest), []).append(n)
    points = {f"p{i}": q for i, (q, _) in enumerate(shares)}
    found = quantiles(each, [*by, "_f"], "_v", points, tuple(f"p{i}" for i, (_, near) in enumerate(shares) if near), sample)
    of = {n: f"p{i}" for i, names in enumerate(shares.values()) for n in names}
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_f") == n, F.col(of[n]))).alias(n) for n in wanted))


def with_columns(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with right's columns by group, null groups matching each other; groups that right lacks get nulls."""
    rest = [c for c in right.columns if c not in by]
    if not by:
        return left.join(right, how="left")  # one row each
    return left.join(_named(right, by, "_r", *rest), _same(by, "_r"), "left").select(*left.columns, *rest)


def rank_correlation(pairs: DataFrame, by: list[str], sample: int = SAMPLE) -> DataFrame:
    """(by, a, b, n, rank_a, rank_b, total) of the distinct pairs of values (a, b), rows with a null in either aside."""
    both = pairs.where("a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    out = both
    for c in ("a", "b"):
        ranks = average_ranks(both.groupBy(*by, F.col(c).alias("value")).agg(F.sum("n").alias("n")), by, sample)
        mine = _named(ranks, by, f"_{c}", F.col("value").alias(f"_v{c}"), F.col("rank").alias(f"rank_{c}"), *([F.col("total")] if c == "a" else []))
        out = out.join(mine, _same(by, f"_{c}") & (F.col(c) == F.col(f"_v{c}")))
    return out.select(*by, "a", "b", "n", "rank_a", "rank_b", "total")


def spearman() -> Column:
    """Over rows of rank_correlation: the correlation of ranks, null where either side has one value."""
    mid = (F.col("total") + 1) / 2
    x, y, n = F.col("rank_a") - mid, F.col("rank_b") - mid, F.col("n")
    return F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y)))
