"""Readers and writers of the file formats that panel jobs start from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; only a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_bars(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Many (compressed) CSV files by an explicit schema, with the file each row came from."""
    return spark.read.schema(schema).option("header", True).csv(paths).withColumn("file", F.col("_metadata.file_path"))


def read_short_interest(spark: SparkSession, path: str, schema: str, calendar: DataFrame) -> DataFrame:
    """Pipe-delimited settlement files; the calendar (settlement, published) gives publication dates and ordinals."""
    rows = spark.read.schema(schema).option("header", True).option("sep", "|").csv(path)
    order = calendar.select("settlement", "published").distinct().withColumn("ordinal", F.dense_rank().over(_by("settlement")))
    return rows.join(order, "settlement")


def _by(col: str):
    from pyspark.sql import Window

    return Window.orderBy(col)  # one row per settlement date


def read_tsv(spark: SparkSession, path: str, numeric: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated table with a header, all text; numbers and dd-MON-yyyy dates are cast, bad ones become null."""
    rows = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
    for c in numeric:
        rows = rows.withColumn(c, F.col(c).try_cast("double"))
    for c in dates:
        rows = rows.withColumn(c, F.to_date(F.try_to_timestamp(F.initcap(F.lower(c)), F.lit("dd-MMM-yyyy"))))
    return rows


def read_13f(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Filings (accession, manager, filed, period, form, amended, amendment) and holdings (accession, cusip, value, shares)
    from the members SUBMISSION, COVERPAGE and INFOTABLE below path. Holdings are shares, no options, and whole numbers
    (an empty one is 0, a bad one fails); identifiers are upper-cased without other marks."""
    sub = read_tsv(spark, f"{path}/SUBMISSION.tsv", dates=("FILING_DATE", "PERIODOFREPORT"))
    cover = read_tsv(spark, f"{path}/COVERPAGE.tsv")
    info = read_tsv(spark, f"{path}/INFOTABLE.tsv")
    text = lambda c: F.upper(F.trim(c))
    covers = cover.select(F.trim("ACCESSION_NUMBER").alias("accession"), text("ISAMENDMENT").alias("amended"), F.regexp_replace(text("AMENDMENTTYPE"), r"\s+", " ").alias("amendment"))
    filings = sub.select(F.trim("ACCESSION_NUMBER").alias("accession"), F.lpad(F.trim("CIK"), 10, "0").alias("manager"), F.col("FILING_DATE").alias("filed"), F.col("PERIODOFREPORT").alias("period"), text("SUBMISSIONTYPE").alias("form")).join(covers, "accession")
    whole = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0)).otherwise(F.col(c).cast("double").cast("long"))
    shares = (F.coalesce(F.trim("PUTCALL"), F.lit("")) == "") & (text("SSHPRNAMTTYPE") == "SH")
    holdings = info.where(shares).select(F.trim("ACCESSION_NUMBER").alias("accession"), F.regexp_replace(F.upper("CUSIP"), "[^A-Z0-9]", "").alias("cusip"), whole("VALUE").alias("value"), whole("SSHPRNAMT").alias("shares"))
    return filings, holdings


def read_form4(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of a quarter of ownership filings as filings, owners, footnotes and transactions; the last stacks
    both transaction members with their kind. Bad numbers and dates become null."""
    sub = read_tsv(spark, f"{path}/SUBMISSION.tsv", dates=("FILING_DATE",))
    key = F.trim("ACCESSION_NUMBER").alias("accession")
    moves = []
    for kind in ("NONDERIV", "DERIV"):
        rows = read_tsv(spark, f"{path}/{kind}_TRANS.tsv", numeric=("TRANS_SHARES", "TRANS_PRICEPERSHARE"), dates=("TRANS_DATE",))
        moves.append(rows.select(key, F.lit(kind).alias("kind"), F.col(f"{kind}_TRANS_SK").alias("line"), F.col("TRANS_DATE").alias("date"), F.trim("TRANS_CODE").alias("code"), F.col("TRANS_SHARES").alias("shares"), F.col("TRANS_PRICEPERSHARE").alias("price")))
    return {
        "filings": sub.select(key, F.col("FILING_DATE").alias("filed"), F.trim("DOCUMENT_TYPE").alias("form")),
        "owners": read_tsv(spark, f"{path}/REPORTINGOWNER.tsv").select(key, F.trim("RPTOWNERCIK").alias("owner")),
        "footnotes": read_tsv(spark, f"{path}/FOOTNOTES.tsv").select(key, F.col("FOOTNOTE_ID").alias("footnote"), F.col("FOOTNOTE_TXT").alias("text")),
        "transactions": moves[0].unionByName(moves[1]),
    }


def flatten_company_facts(facts: DataFrame, acceptance: DataFrame) -> DataFrame:
    """facts (cik, facts map<taxonomy, map<concept, struct<units map<unit, array<obs>>>>>) to rows with the acceptance
    time of their accession; observations without one are dropped."""
    one = facts.select("cik", F.explode("facts").alias("taxonomy", "concepts"))
    two = one.select("cik", "taxonomy", F.explode("concepts").alias("concept", "c"))
    three = two.select("cik", "taxonomy", "concept", F.explode("c.units").alias("unit", "obs"))
    rows = three.select("cik", "taxonomy", "concept", "unit", F.inline("obs"))
    return rows.join(acceptance.select(F.col("accession").alias("accn"), "accepted_at"), "accn")


def zip_columnar(df: DataFrame, cols: list[str]) -> DataFrame:
    """Parallel arrays to rows; arrays of unlike lengths fail."""
    even = F.assert_true(F.array_max(F.array(*(F.size(c) for c in cols))) == F.array_min(F.array(*(F.size(c) for c in cols))), "arrays of unlike lengths")
    rest = [c for c in df.columns if c not in cols]
    checked = df.where(even.isNull())
    return checked.select(*rest, F.inline(F.arrays_zip(*cols)))


def read_master_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of five |-separated parts below a free-text header: cik, name, form, filed, file."""
    parts = F.split("value", r"\|")
    rows = spark.read.text(path).where((F.size(parts) == 5) & F.regexp_like(F.element_at(parts, 1), F.lit("^[0-9]+$")))
    return rows.select(*(F.element_at(parts, i + 1).alias(n) for i, n in enumerate(("cik", "name", "form", "filed", "file")))).withColumn("filed", F.try_to_date("filed"))


def write_panel(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Partitioned Parquet; only partitions that df holds are replaced."""
    df.repartition(*partition_cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)


def fingerprint(df: DataFrame, keys: list[str], cols: list[str], at: str, cutoff: Column) -> DataFrame:
    """Rows, first and last time, and a digest of each key's slice up to the cutoff.

    The digest is a tree: sorted row digests that share their first three hexadecimal digits are hashed together, and the
    at most 4096 hashes of a key in order once more, so no row holds all digests of a key.
    """
    row = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in cols)), 256)
    kept = df.where(F.col(at) <= cutoff).withColumn("_h", row)
    leaf = F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256)
    leaves = kept.groupBy(*keys, F.substring("_h", 1, 3).alias("_p")).agg(F.count("*").alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"), leaf.alias("_d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"])
    return leaves.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.min("_first").alias("first"), F.max("_last").alias("last"), F.sha2(F.array_join(ordered, ""), 256).alias("digest"))
