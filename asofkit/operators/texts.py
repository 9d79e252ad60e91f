"""Text jobs: classification by markers, item typing, signals of HTML parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_text(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with, per class, the sorted distinct matches of its pattern, and the first class that matched (else OTHER)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    out, label = df, F.lit(None).cast("string")
    for name, pattern in patterns.items():
        out = out.withColumn(f"{name}_markers", F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), 0))))
        label = F.coalesce(label, F.when(F.size(f"{name}_markers") > 0, name))
    return out.withColumn("label", F.coalesce(label, F.lit("OTHER")))


def classify_transactions(df: DataFrame, code: str, groups: dict[str, str]) -> DataFrame:
    """df with the economic group of its code (UNMAPPED if unknown)."""
    table = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair))
    return df.withColumn("group", F.coalesce(F.try_element_at(table, F.col(code)), F.lit("UNMAPPED")))


def amendment_operation(kind: str, amended: str):
    """Column: what a filing does to earlier ones of its period."""
    k = F.upper(F.trim(F.col(kind)))
    return F.when(~F.col(amended), "SNAPSHOT").when(k == "RESTATEMENT", "REPLACE").when(k == "NEW HOLDINGS", "ADD").otherwise("EXCLUDE")


def explode_classes(df: DataFrame, symbol: str, keys: list[str]) -> DataFrame:
    """One row per class of a symbol cell such as A/B; a key that would then repeat fails when the rows are read."""
    from pyspark.sql import Window

    out = df.withColumn(symbol, F.explode(F.filter(F.transform(F.split(symbol, "/"), lambda s: F.trim(s)), lambda s: s != "")))
    once = F.count("*").over(Window.partitionBy(*keys, symbol)) == 1
    return out.withColumn("_once", once).where(F.assert_true("_once", "class expansion repeats an event key").isNull()).drop("_once")


def item_events(filings: DataFrame, items: str, wanted: dict[str, str]) -> DataFrame:
    """Filings whose comma list of items holds wanted ones: one row per kind."""
    tokens = F.transform(F.split(F.coalesce(F.col(items), F.lit("")), ","), lambda s: F.trim(s))
    table = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
    kinds = F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda k: k.isNotNull()))
    return filings.withColumn("kind", F.explode(kinds))


def text_signals(parts: DataFrame, key: str, html: str, patterns: dict[str, str]) -> DataFrame:
    """Length of a key's HTML parts as plain text, one line each, and one flag per pattern, which no match of may span
    parts. Parts are summed up one by one, so a key may have any number of them."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>", " "), r"<[^>]*>", " "), r"\s+", " "))
    each = parts.select(key, plain.alias("_t")).select(key, F.length("_t").cast("long").alias("_n"), *(F.regexp_like(F.lower("_t"), F.lit(p)).alias(name) for name, p in patterns.items()))
    return each.groupBy(key).agg((F.sum("_n") + F.count("*") - 1).alias("chars"), *(F.bool_or(name).alias(name) for name in patterns))
