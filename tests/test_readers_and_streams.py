"""Readers on small files, and streams against their batch meaning."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from asofkit.operators import identity as I
from asofkit.operators import labels as LB
from asofkit.operators import texts as T
from asofkit.sources import readers as R
from asofkit.streaming import jobs as SS


def test_read_bars_takes_compressed_files(spark, tmp_path):
    for name, value in (("a", 1.5), ("b", 2.5)):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(f"date,close\n2020-01-01,{value}\n")
    rows = R.read_bars(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.csv.gz")], "date date, close double").collect()
    assert sorted((r.close, r.file[-8:]) for r in rows) == [(1.5, "a.csv.gz"), (2.5, "b.csv.gz")]


def test_read_tsv_casts_and_nulls(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("ACCESSION\tFILING_DATE\tVALUE\nx\t14-FEB-2020\t12.5\ny\tbad\tn/a\n")
    rows = {r.ACCESSION: r for r in R.read_tsv(spark, str(tmp_path / "t.tsv"), ("VALUE",), ("FILING_DATE",)).collect()}
    assert rows["x"].FILING_DATE == dt.date(2020, 2, 14) and rows["x"].VALUE == 12.5
    assert rows["y"].FILING_DATE is None and rows["y"].VALUE is None


def test_short_interest_gets_ordinals(spark, tmp_path):
    (tmp_path / "s.txt").write_text("symbol|settlement|shares\nA|2020-01-15|5\nA|2020-01-31|7\n")
    calendar = spark.createDataFrame([(dt.date(2020, 1, d), dt.date(2020, 2, d)) for d in (15, 31) if d < 30] + [(dt.date(2020, 1, 31), dt.date(2020, 2, 12))], "settlement date, published date")
    rows = R.read_short_interest(spark, str(tmp_path / "s.txt"), "symbol string, settlement date, shares long", calendar).collect()
    assert sorted((r.ordinal, r.shares) for r in rows) == [(1, 5), (2, 7)]


def test_company_facts_need_an_acceptance_time(spark):
    schema = "cik string, facts map<string,map<string,struct<label:string,units:map<string,array<struct<accn:string,end:string,val:double>>>>>>"
    facts = spark.createDataFrame([("1", {"gaap": {"Revenue": ("r", {"USD": [("a1", "2020-12-31", 5.0), ("a2", "2021-12-31", 6.0)]})}})], schema)
    accepted = spark.createDataFrame([("a1", dt.datetime(2021, 2, 1, 21))], "accession string, accepted_at timestamp")
    rows = R.flatten_company_facts(facts, accepted).collect()
    assert [(r.concept, r.unit, r.accn, r.val) for r in rows] == [("Revenue", "USD", "a1", 5.0)]


def test_zip_columnar_refuses_unlike_lengths(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"])], "id int, x array<int>, y array<string>")
    assert sorted(map(tuple, R.zip_columnar(df, ["x", "y"]).collect())) == [(1, 1, "a"), (1, 2, "b")]
    bad = spark.createDataFrame([(1, [1], ["a", "b"])], "id int, x array<int>, y array<string>")
    with pytest.raises(Exception, match="unlike"):
        R.zip_columnar(bad, ["x", "y"]).collect()


def test_master_index_skips_its_header(spark, tmp_path):
    (tmp_path / "m.idx").write_text("Description: index\n\nCIK|Company|Form|Date|File\n-----\n7|Acme|10-K|2020-03-01|f.txt\n")
    rows = R.read_master_index(spark, str(tmp_path / "m.idx")).collect()
    assert [(r.cik, r.form, r.filed) for r in rows] == [("7", "10-K", dt.date(2020, 3, 1))]


def test_write_panel_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "panel")
    R.write_panel(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, y int"), path, ["y"])
    R.write_panel(spark.createDataFrame([(3, 2021)], "v int, y int"), path, ["y"])
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "y").collect())) == [(1, 2020), (3, 2021)]


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_stream_bars_hide_the_open_week(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d, 12), float(d), 1) for d in (1, 3, 5, 6, 20)]
    df = SS.stream_bars(stream(spark, tmp_path, rows, "entity string, ts timestamp, price double, volume int"), "1 day")
    got = SS.run_available(df, str(tmp_path / "o"), str(tmp_path / "c")).orderBy("week").collect()
    assert [(r.week.day, r.open, r.close, r.volume) for r in got] == [(5, 1.0, 5.0, 3), (12, 6.0, 6.0, 1)]


def test_repeats_conflicts_and_gate(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    df = SS.append_unique(stream(spark, tmp_path, [(1, t, 5), (1, t, 5), (2, t, None)], "id int, ts timestamp, v int"), "id", "ts")
    got = SS.run_available(df, str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r.id for r in got.collect()) == [1, 2]
    batch = spark.createDataFrame([(1, t, 6), (2, t, None)], "id int, ts timestamp, v int")
    assert [r.id for r in SS.conflicts(got, batch, "id", ["v"]).collect()] == [1]
    good, bad = SS.gate(F.col("v") > 0)(batch)
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]


def test_confirmed_labels_match_the_batch_kernel(spark, tmp_path):
    labels = ["EXTENDING", "COOLING", "COOLING", "PLATEAU", "EXTENDING", "EXTENDING", "EXTENDING", "EXTENDING"]
    rows = [("e", dt.datetime(2024, 1, i + 1), i, x) for i, x in enumerate(labels)]
    df = SS.confirm_labels(stream(spark, tmp_path, rows, "entity string, ts timestamp, id long, label string"))
    got = [r.confirmed for r in SS.run_available(df, str(tmp_path / "o"), str(tmp_path / "c")).orderBy("ts").collect()]
    # Unconfirmed directions read NEUTRAL, and so does the opposite one for four rows after COOLING counted.
    assert got == ["NEUTRAL", "NEUTRAL", "COOLING", "PLATEAU", "NEUTRAL", "NEUTRAL", "NEUTRAL", "EXTENDING"]
    assert LB.stabilise(labels, 2, 4)[0] == got
    first, _, state = LB.stabilise(labels[:3], 2, 4)
    assert first + LB.stabilise(labels[3:], 2, 4, state)[0] == got


def test_cooldown_lies_between_opposite_directions_only():
    label, suppressed, _ = LB.stabilise(["BREAKING"] * 2 + ["COOLING"] * 2 + ["RECOVERING"] * 7, 2, 4)
    assert label == ["NEUTRAL", "BREAKING", "NEUTRAL", "COOLING"] + ["NEUTRAL"] * 4 + ["RECOVERING"] * 3
    assert suppressed == [False] * 5 + [True] * 3 + [False] * 3


def test_share_classes_and_scenarios(spark):
    df = spark.createDataFrame([(1, "A/B"), (2, "C")], "id int, s string")
    assert sorted(map(tuple, T.explode_classes(df, "s", ["id"]).collect())) == [(1, "A"), (1, "B"), (2, "C")]
    base = spark.createDataFrame([("x", "a", dt.date(2020, 1, 1))], "scenario string, entity string, start date")
    changes = spark.createDataFrame([("x", "a", dt.date(2020, 5, 1), "REMOVE"), ("x", "b", dt.date(2020, 5, 1), "ADD")], "scenario string, entity string, date date, action string")
    got = {(r.entity, r.valid_from.month, r.valid_to and r.valid_to.month) for r in I.scenario_membership(base, changes).collect()}
    assert got == {("a", 1, 5), ("b", 5, None)}
