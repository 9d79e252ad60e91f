"""Mixing sources to target weights by a time-varying curriculum; DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]: linear from a start to an end factor, scaled so that
its integral is the source's target. Documents stand in a hashed order within their source; a document's place in the
source's cumulative words, against the target, is inverted through the integrated schedule to a training position.
Sources whose target exceeds their size are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Hex digits of the order hash that split a source into groups for its prefix sums: 4096 groups of any source.
_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets per source from (source, source_size): shares by weight, capped, the excess reshared by weight.

    Sources take the weights in turn by code point, null last. The fixed point of capping and resharing is the level
    at which every source takes least(cap * size, weight * level) and the whole adds up.
    """
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda c, start: F.sum(c).over(whole) - F.coalesce(F.sum(start).over(before), F.lit(0.0))
    ranked = sizes.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    limited = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(cap))
    # The level if exactly the sources before this one, by limit over weight, stop at their limits.
    levels = limited.withColumn("turn", F.row_number().over(by_limit)).withColumn("level", rest("source_size", "limit") / rest("weight", "weight"))
    first = F.min(F.when(F.col("limit") >= F.col("weight") * F.col("level"), F.struct("turn", "level"))).over(whole)
    return levels.withColumn("level", first["level"]).select("source", "source_size", "rank", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def position_of(share: Column, slope: Column) -> Column:
    """The time by which a schedule 1 + slope * (1 - 2t) has demanded this share of its target."""
    root = F.sqrt((1 + slope) * (1 + slope) - 4 * slope * share)
    return F.when(slope == 0, share).otherwise(2 * share / (1 + slope + root))


def curriculum_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, schedules: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5)), seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position, copies, and kept (the columns in keep, as
    a struct).

    size counts the words of the whole text (null: 0). taken counts words the mix takes of the document over all
    epochs; copies holds (epoch, words, position) of each epoch that takes some, position the first of them (null if
    none). The copy at which a source reaches its target gives its first words only, so sources meet their targets to
    the word. Rows of equal or null keys are documents of their own; ties in the order are broken by size
    and, where columns are kept, by text. A null source is a source. Other columns, whatever their names, play no part.
    An empty table gives no rows. The targets come from one row per source in one task, which serves thousands of
    sources.
    """
    place = {name: F.col(f"c{i}") for i, name in enumerate(docs.columns)}
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(place[key].cast("string"), F.lit(""))))
    # A source's group is never null, so that the join below goes by the very columns that the window has shuffled the texts by.
    group = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    sized = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(
        place[key].alias("doc_id"),
        group(place[source].cast("string")).alias("group"),
        F.coalesce(F.regexp_count(place[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("o"),
        F.struct(*(place[c].alias(c) for c in keep)).alias("kept") if keep else F.lit(None).cast("boolean").alias("kept"),
        (F.xxhash64(place[text].cast("string")) if keep else F.lit(0)).alias("tie"),
    ).withColumn("part", F.substring("o", 1, _DIGITS))
    # Words by source and group of the order: the one pass over the texts that the targets need.
    parts = sized.groupBy("group", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("group", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"), F.sum("words").over(Window.partitionBy("group")).alias("source_size"))
    totals = parts.groupBy("group").agg(F.max("source_size").alias("source_size")).select(F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias("source"), "source_size")
    slope = F.element_at(
        F.array(*(F.lit((a - b) / (a + b)) for a, b in schedules)), ((F.col("rank") - 1) % len(schedules) + 1).cast("int")
    )
    targets = source_targets(totals, weights, cap).select(group(F.col("source")).alias("s"), "target", slope.alias("slope"))
    plan = parts.join(targets, F.col("group") == F.col("s")).drop("s")
    plan = plan.select(F.col("group").alias("s"), F.col("part").alias("p"), "before", "source_size", "target", "slope")
    within = Window.partitionBy("group", "part").orderBy("o", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(plan, (F.col("group") == F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("at", F.col("at") + F.col("before"))
        .withColumn("goal", F.floor("target").cast("long"))
    )

    def copy(epoch: int) -> Column:
        start = F.col("at") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start)).cast("long")
        place = F.when(words > 0, position_of(start / F.col("goal"), F.col("slope")))
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), place.alias("position"))

    copies = F.filter(F.array(*(copy(e) for e in range(cap))), lambda c: c["words"] > 0)
    return placed.withColumn("copies", copies).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"),
        F.get("copies", F.lit(0))["position"].alias("position"),
        "copies",
        *(["kept"] if keep else []),
    )


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sort documents by training position (those that are never taken come last)."""
    return mixed.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by position: the columns of the mix, epoch, words, position.

    Documents of which nothing is taken (empty or null texts, for one) give no row; ties go by doc_id, then epoch;
    repeated rows give rows of their own; an empty mix gives no rows.
    """
    columns = [c for c in mixed.columns if c not in ("position", "copies")]
    each = mixed.select(*columns, F.explode("copies").alias("copy")).select(*columns, "copy.epoch", "copy.words", "copy.position")
    return each.repartitionByRange("position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")


def first_words(text: Column, words: Column) -> Column:
    """The first words of a text, joined by single spaces; all of them if there are fewer; null for a null text."""
    return F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, words.cast("int")), " ")
