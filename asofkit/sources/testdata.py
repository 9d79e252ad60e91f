"""Adapters that give the driver's tables the shapes of the library's inputs, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by supplier nation: (entity, date, open, high, low, close, adj_close, volume).

    Suppliers and nations are dimension tables; Spark broadcasts them where their size allows.
    """
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_discount", ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("turn"))
    nation = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    close = F.max_by("price", "turn")
    return (
        line.join(nation, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("n_name").alias("entity"), "date")
        .agg(
            F.min_by("price", "turn").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            close.alias("close"),
            (close * (1 - F.max_by("l_discount", "turn"))).alias("adj_close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, sector): nation and region names."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("sector"))


#: The same as CTEs; every SQL below starts with it.
CTES = """
WITH bars AS (
  SELECT n_name AS entity, l_shipdate::DATE AS date,
         arg_min(l_extendedprice / l_quantity, (l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey) AS close,
         arg_max(l_extendedprice / l_quantity, (l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey) * (1 - arg_max(l_discount, (l_orderkey * 100 + l_linenumber) * 1000000 + l_partkey)) AS adj_close,
         sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
), sectors AS (
  SELECT n_name AS entity, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey
)"""
