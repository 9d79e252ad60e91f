"""Queries of scalars, resampling and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import windows as W
from ..sources.testdata import CTES, bars, sectors, table
from .registry import query


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def off_tie(c: str):
    """Rounded off the half-way values that engines round apart."""
    return F.round(F.col(c) + 1e-8, 6).alias(c)


@query(CTES + """
SELECT entity, date, round(open * (adj_close / nullif(close, 0)) + 1e-8, 6) AS open, round(high * (adj_close / nullif(close, 0)) + 1e-8, 6) AS high,
       round(low * (adj_close / nullif(close, 0)) + 1e-8, 6) AS low, round(close * (adj_close / nullif(close, 0)) + 1e-8, 6) AS close, volume FROM bars""")
def p1_adjust_bars(spark, sf):
    return B.adjust_bars(bars(spark, sf)).select("entity", "date", *(off_tie(c) for c in ("open", "high", "low", "close")), "volume")


@query(CTES + " SELECT entity, count(*) AS n, max(date) AS last FROM bars WHERE date <= DATE '1997-06-02' GROUP BY entity")
def p2_drop_incomplete_session(spark, sf):
    now = F.lit("1997-06-03 19:00:00").cast("timestamp")
    return B.drop_incomplete_session(bars(spark, sf), now).groupBy("entity").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query("""
SELECT o_orderkey, CASE WHEN s < 15 THEN 'FLEE' WHEN s < 40 THEN 'SCATTER' WHEN s < 60 THEN 'CALM' WHEN s < 75 THEN 'DRIFT' ELSE 'RUSH' END AS stage,
       CASE WHEN s <= 15 THEN 'FLEE' WHEN s <= 40 THEN 'SCATTER' WHEN s < 60 THEN 'CALM' WHEN s < 75 THEN 'DRIFT' ELSE 'RUSH' END AS legacy
FROM (SELECT o_orderkey, (o_orderkey % 101)::DOUBLE AS s FROM orders)""")
def p3_stage(spark, sf):
    s = (F.col("o_orderkey") % 101).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", S.stage(s).alias("stage"), S.stage(s, "legacy").alias("legacy"))


@query("""
SELECT p_partkey, base, round_even(greatest(0, least(100, base * CASE WHEN p_size < 10 THEN 0.875 WHEN p_size < 40 THEN 1.0 ELSE 1.125 END::DOUBLE)), 2) AS adjusted
FROM (SELECT p_partkey, p_size, round_even(greatest(0, least(100, p_size::DOUBLE * 1.25::DOUBLE + (p_partkey % 100)::DOUBLE * 0.5::DOUBLE)), 2) AS base FROM part)""")
def p4_composite_score(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 100).cast("double").alias("b"))
    both = S.composite_score({"a": 1.25, "b": 0.5}, sector=S.ladder(F.col("a"), [(10, 0.875), (40, 1.0)], 1.125))
    return part.select("p_partkey", both["base"].alias("base"), both["adjusted"].alias("adjusted"))


@query(CTES + """, lagged AS (
  SELECT b.entity, b.date, sector, close, lag(close, 90) OVER (PARTITION BY b.entity ORDER BY b.date) AS before FROM bars b JOIN sectors s ON s.entity = b.entity
), rs AS (
  SELECT entity, date, (close / before - 1) * 100 - avg((close / before - 1) * 100) OVER (PARTITION BY sector, date) AS x FROM lagged WHERE before IS NOT NULL
)
SELECT entity, date, CASE WHEN x < -15 THEN 0.9 WHEN x < -5 THEN 0.95 WHEN x < 5 THEN 1.0 WHEN x < 15 THEN 1.05 ELSE 1.1 END::DOUBLE AS multiplier FROM rs""")
def p5_sector_multiplier(spark, sf):
    own = bars(spark, sf).withColumn("x", W.change("close", 90) * 100).where("x is not null").join(sectors(spark, sf), "entity")
    rs = F.col("x") - F.avg("x").over(W.Window.partitionBy("sector", "date"))
    return own.select("entity", "date", S.ladder(rs, [(-15, 0.9), (-5, 0.95), (5, 1.0), (15, 1.05)], 1.1).alias("multiplier"))


@query("SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' WHEN c_acctbal < 5000 THEN 'SMALL' ELSE 'LARGE' END AS bucket, count(*) AS n FROM customer GROUP BY ALL")
def p6_bucketize(spark, sf):
    bucket = S.bucketize(F.col("c_acctbal"), [0.0, 5000.0], ["NEGATIVE", "SMALL", "LARGE"])
    return table(spark, sf, "customer").groupBy("c_mktsegment", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(r"""
SELECT c_custkey, nullif(regexp_replace(regexp_replace(regexp_replace(upper(trim(c_name)), '[./ _#-]+', '-', 'g'), '[^A-Z0-9-]', '', 'g'), '^-+|-+$', '', 'g'), '') AS symbol FROM customer""")
def p7_canonical_symbol(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.canonical_symbol(F.col("c_name")).alias("symbol"))


@query(r"""SELECT c_custkey, list_sort(list_distinct([replace(upper(c_mktsegment), ' ', '-'), 'CUST-' || (c_custkey % 50)])) AS symbols FROM customer""")
def p7_reported_symbols(spark, sf):
    """Cells that list several symbols, with repeats, empty parts and marks."""
    cell = F.concat(F.lower("c_mktsegment"), F.lit("; , cust."), (F.col("c_custkey") % 50).cast("string"), F.lit(" |"), F.col("c_mktsegment"), F.lit(","))
    return table(spark, sf, "customer").select("c_custkey", S.reported_symbols(cell).alias("symbols"))


@query(r"""
SELECT p_partkey, array_to_string(toks, ' ') AS name, array_to_string(list_sort(list_filter(toks, lambda t: t <> 'STEEL')), ' ') AS signature FROM (
  SELECT p_partkey, list_filter(list_transform(regexp_extract_all(upper(p_name), '[A-Z0-9]+'), lambda t: CASE t WHEN 'PART' THEN 'PRT' ELSE t END), lambda t: t NOT IN ('THE', 'OF')) AS toks FROM part)""")
def p8_normalize_name(spark, sf):
    name = S.normalize_name(F.col("p_name"), {"PART": "PRT"}, ("THE", "OF"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("signature", S.token_signature(F.col("name"), ("STEEL",)))


@query("""
WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '0') || (o_orderkey % 10)::VARCHAR AS cusip FROM orders),
d AS (SELECT o_orderkey, cusip, list_sum(list_transform(range(1, 9), lambda i: (cusip[i]::INT * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) // 10 + (cusip[i]::INT * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 10)) AS s FROM c)
SELECT o_orderkey, cusip, (10 - s % 10) % 10 = cusip[9]::INT AND cusip <> repeat(cusip[1], 9) AS valid FROM d""")
def p9_valid_cusip(spark, sf):
    cusip = F.concat(F.lpad((F.col("o_orderkey") * 7919 % 100000000).cast("string"), 8, "0"), (F.col("o_orderkey") % 10).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", cusip.alias("cusip")).withColumn("valid", S.valid_cusip(F.col("cusip")))


@query("SELECT event_id, substr(sha256(user_id::VARCHAR || '|' || event_type), 1, 24) AS id FROM events")
def p17_stable_id(spark, sf):
    return table(spark, sf, "events").select("event_id", S.stable_id(F.col("user_id"), F.col("event_type")).alias("id"))


@query("""
SELECT o_orderkey, (timezone('America/New_York', (o_orderdate::DATE + 1)::TIMESTAMP) AT TIME ZONE 'UTC') AS available, o_orderdate::DATE + 45 AS due FROM orders""")
def p18_availability(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", S.next_midnight_utc(d).cast("timestamp_ntz").alias("available"), S.statutory_wave(d).alias("due"))


WEEK = "date + ((5 - isodow(date) + 7) % 7)::INT"


@query(CTES + f"""
SELECT entity, {WEEK} AS week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, arg_max(adj_close, date) AS adj_close,
       sum(volume) AS volume, max(date) AS last_session FROM bars WHERE {WEEK} <= DATE '1999-12-31' GROUP BY ALL""")
def b1_weekly_bars(spark, sf):
    return B.weekly_bars(bars(spark, sf), F.lit("1999-12-31").cast("date"))


@query(CTES + " SELECT entity, last_day(date) AS month, arg_max(close, date) AS close, max(date) AS last_session FROM bars GROUP BY ALL")
def b2_month_end_bars(spark, sf):
    return B.month_end_bars(bars(spark, sf))


@query(CTES + f"""
SELECT 'weekly' AS freq, entity, {WEEK} AS bucket, max(date) AS observed FROM bars WHERE {WEEK} <= DATE '1998-01-15' GROUP BY ALL
UNION ALL SELECT 'monthly', entity, last_day(date) AS bucket, max(date) FROM bars WHERE last_day(date) <= DATE '1998-01-15' GROUP BY ALL""")
def b3_observation_dates(spark, sf):
    cut, b = F.lit("1998-01-15").cast("date"), bars(spark, sf)
    return B.observation_dates(b, "weekly", cut).select(F.lit("weekly").alias("freq"), "*").unionByName(B.observation_dates(b, "monthly", cut).select(F.lit("monthly").alias("freq"), "*"))


@query(CTES + """, bench AS (SELECT date, avg(close) AS bench FROM bars WHERE day(date) % 3 = 0 GROUP BY date), j AS (
  SELECT entity, date, bench, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars LEFT JOIN bench USING (date))
SELECT entity, date, round(last_value(bench IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5) AS bench FROM j""")
def b4_align_to(spark, sf):
    b = bars(spark, sf)
    bench = b.where(F.day("date") % 3 == 0).groupBy("date").agg(F.avg("close").alias("bench"))
    return B.align_to(b.select("entity", "date"), bench, "bench", 3).select("entity", "date", r("bench", 5))


FOLDS = """, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)),
folds AS (SELECT f AS fold, (SELECT min(date) FROM cal) AS train_start, (SELECT date FROM cal WHERE i = f * 126 + 252 - 1 - 5) AS train_end,
  (SELECT date FROM cal WHERE i = f * 126 + 252 + 10) AS test_start, (SELECT date FROM cal WHERE i = f * 126 + 252 + 10 + 126 - 1) AS test_end
  FROM range(0, 1000) t(f) WHERE 252 + 10 + f * 126 + 126 - 1 <= (SELECT max(i) FROM cal))"""


@query(CTES + FOLDS + " SELECT fold, train_start, train_end, test_start, test_end FROM folds")
def b5_anchored_folds(spark, sf):
    return B.anchored_folds(bars(spark, sf), 252, 126, 126, 10, 5).withColumn("fold", F.col("fold").cast("long"))


@query(CTES + FOLDS + """, ev AS (SELECT o_orderkey, o_orderdate::DATE AS date, o_orderdate::DATE + 30 AS outcome_end FROM orders)
SELECT fold, CASE WHEN date >= test_start AND outcome_end <= test_end THEN 'test' ELSE 'train' END AS role, count(*) AS n, min(date) AS first, max(outcome_end) AS last
FROM ev JOIN folds ON (date >= test_start AND outcome_end <= test_end) OR (date >= train_start AND outcome_end <= train_end) GROUP BY ALL""")
def b6_assign_folds(spark, sf):
    d = F.to_date("o_orderdate")
    ev = table(spark, sf, "orders").select("o_orderkey", d.alias("date"), F.date_add(d, 30).alias("outcome_end"))
    folds = B.anchored_folds(bars(spark, sf), 252, 126, 126, 10, 5).withColumn("fold", F.col("fold").cast("long"))
    return B.assign_folds(ev, folds).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("outcome_end").alias("last"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'early' WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN 'middle' END AS era FROM orders")
def b7_assign_era(spark, sf):
    ev = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return B.assign_era(ev, [("early", 1995, 1996), ("middle", 1997, 1999)]).drop("date")


@query(CTES + """ SELECT entity, date, round(close / nullif(lag(close, 5) OVER w, 0) - 1, 6) AS r5, round(ln(close / lag(close, 1) OVER w), 6) AS l1 FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def w1_returns(spark, sf):
    return bars(spark, sf).select("entity", "date", F.round(W.change("close", 5), 6).alias("r5"), F.round(W.log_change("close", 1), 6).alias("l1"))


@query(CTES + """ SELECT entity, date, round(CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END, 5) AS mean, CASE WHEN count(close) OVER w >= 10 THEN max(close) OVER w END AS high,
  round(CASE WHEN count(close) OVER w >= 10 THEN stddev_samp(close) OVER w END, 5) AS std FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING)""")
def w2_rolling(spark, sf):
    return bars(spark, sf).select("entity", "date", F.round(W.rolling("close", 20, 10, "mean"), 5).alias("mean"), W.rolling("close", 20, 10, "max").alias("high"), F.round(W.rolling("close", 20, 10, "std"), 5).alias("std"))


@query(CTES + """, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars)
SELECT a.entity, a.date, CASE WHEN count(*) >= 10 THEN round((count(*) FILTER (WHERE b.close < a.close) + (count(*) FILTER (WHERE b.close = a.close) + 1) / 2) / count(*), 6) END AS pct
FROM i a JOIN i b ON a.entity = b.entity AND b.i BETWEEN a.i - 51 AND a.i GROUP BY a.entity, a.date, a.close""")
def w3_rolling_pct_rank(spark, sf):
    return W.window_ranks(bars(spark, sf).select("entity", "date", "close"), {"pct": "close"}, 52, 10).select("entity", "date", r("pct"))


@query(CTES + """, l AS (SELECT entity, arg_max(close, date) AS latest FROM bars GROUP BY entity) SELECT b.entity, latest, round(avg((close <= latest)::INT), 6) AS pct FROM bars b JOIN l USING (entity) GROUP BY ALL""")
def w4_pct_of_latest(spark, sf):
    return W.pct_of_latest(bars(spark, sf), "close").select("entity", "latest", r("pct"))


@query(CTES + """, m AS (SELECT entity, last_day(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL)
SELECT a.entity, a.date, a.close, round((count(*) FILTER (WHERE b.close < a.close) + (count(*) FILTER (WHERE b.close = a.close) + 1) / 2) / count(*), 6) AS pct FROM m a JOIN m b ON a.entity = b.entity AND b.date <= a.date GROUP BY ALL""")
def w5_expanding_pct_rank(spark, sf):
    m = B.month_end_bars(bars(spark, sf)).select("entity", F.col("month").alias("date"), "close")
    return W.expanding_pct_rank(m, "close").select("entity", "date", "close", r("pct"))


@query(CTES + """, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars)
SELECT a.entity, a.date, CASE WHEN count(b.i) >= 20 THEN round(count(*) FILTER (WHERE b.close <= a.close) / count(b.i), 6) END AS pct FROM i a LEFT JOIN i b ON a.entity = b.entity AND b.i BETWEEN a.i - 60 AND a.i - 1 GROUP BY a.entity, a.date, a.close""")
def w6_prior_pct(spark, sf):
    return W.window_ranks(bars(spark, sf).select("entity", "date", "close"), {"pct": "close"}, 60, 20, prior=True).select("entity", "date", r("pct"))


def guarded(f: str, n: int, k: int) -> str:
    w = f"OVER (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING)"
    c = f[f.index("(") + 1 : -1]
    return f"CASE WHEN count({c}) {w} >= {k} THEN {f} {w} END"


@query(CTES + f""", wk AS (SELECT entity, {WEEK} AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL), wr AS (SELECT entity, date, close / {guarded('avg(close)', 200, 20)} AS week_ratio FROM wk),
x AS (SELECT entity, date, round((close - ({guarded('avg(close)', 20, 20)} - 2 * {guarded('stddev_samp(close)', 20, 20)})) / nullif(4 * {guarded('stddev_samp(close)', 20, 20)}, 0), 4) AS band,
  round((close - {guarded('min(close)', 252, 20)}) / nullif({guarded('max(close)', 252, 20)} - {guarded('min(close)', 252, 20)}, 0), 6) AS position,
  round(close / {guarded('avg(close)', 200, 20)} - 1, 5) AS ma_gap, round({guarded('avg(volume)', 5, 5)} / {guarded('avg(volume)', 20, 20)}, 6) AS volume_ratio FROM bars)
SELECT x.*, round(w.week_ratio, 5) AS week_ratio FROM x ASOF LEFT JOIN (SELECT * FROM wr WHERE week_ratio IS NOT NULL) w ON w.entity = x.entity AND w.date <= x.date""")
def w7_indicators(spark, sf):
    return W.indicators(bars(spark, sf)).select("entity", "date", r("band", 4), r("position"), r("ma_gap", 5), r("volume_ratio"), r("week_ratio", 5))


def rsi_sql(rows: str, n: int = 14) -> str:
    """Seeded Wilder RSI of rows (entity, date, close) as CTEs ending in `rsi` (entity, date, i, rsi): smoothing is a sum
    of geometrically weighted changes."""
    d = f"(1 - 1.0::DOUBLE / {n})"
    part = lambda c: f"pow({d}, i) * sum(CASE WHEN i = {n} THEN m{c} * pow({d}, -i) WHEN i > {n} THEN {c} / {n} * pow({d}, -i) ELSE 0 END) OVER w"
    return f"""ch AS (SELECT entity, date, row_number() OVER w - 1 AS i, greatest(close - lag(close) OVER w, 0) AS u, greatest(lag(close) OVER w - close, 0) AS l FROM {rows} WHERE close IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY date)),
sd AS (SELECT *, avg(u) OVER f AS mu, avg(l) OVER f AS ml FROM ch WINDOW f AS (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING)), sm AS (SELECT entity, date, i, {part('u')} AS g, {part('l')} AS b FROM sd WINDOW w AS (PARTITION BY entity ORDER BY date)),
rsi AS (SELECT entity, date, i, CASE WHEN i >= {n} THEN CASE WHEN g = 0 AND b = 0 THEN 50 WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + g / b) END END AS rsi FROM sm)"""


@query(CTES + f""", wk AS (SELECT entity, {WEEK} AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL), {rsi_sql('wk')},
ew AS (SELECT *, pow(13.0::DOUBLE / 14, i) * sum(CASE WHEN i = 1 THEN u * 14.0::DOUBLE / 13 WHEN i > 1 THEN u / 14 * pow(13.0::DOUBLE / 14, -i) ELSE 0 END) OVER w AS eg, pow(13.0::DOUBLE / 14, i) * sum(CASE WHEN i = 1 THEN l * 14.0::DOUBLE / 13 WHEN i > 1 THEN l / 14 * pow(13.0::DOUBLE / 14, -i) ELSE 0 END) OVER w AS el FROM ch WINDOW w AS (PARTITION BY entity ORDER BY date))
SELECT entity, date, round(rsi, 5) AS rsi, CASE WHEN i >= 1 THEN round(CASE WHEN eg = 0 AND el = 0 THEN 50 WHEN el = 0 THEN 100 ELSE 100 - 100 / (1 + eg / el) END, 5) END AS ewm FROM ew JOIN rsi USING (entity, date, i)""")
def w8_wilder_rsi(spark, sf):
    weekly = B.weekly_bars(bars(spark, sf)).select("entity", F.col("week").alias("date"), "close")
    ewm = W.wilder_rsi(weekly, "close", 14, "ewm").withColumnRenamed("rsi", "ewm").drop("close")
    return W.wilder_rsi(weekly, "close", 14).join(ewm, ["entity", "date"]).select("entity", "date", F.round(F.nanvl("rsi", F.lit(None)), 5).alias("rsi"), F.round(F.nanvl("ewm", F.lit(None)), 5).alias("ewm"))


@query(CTES + """, own AS (SELECT entity, date, close / lag(close, 63) OVER w - 1 > 0 AS up, CASE WHEN count(*) OVER (w ROWS 199 PRECEDING) >= 200 THEN close > avg(close) OVER (w ROWS 199 PRECEDING) END AS above FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date))
SELECT sector, date, round(avg(up::INT), 6) AS gaining, round(avg(above::INT), 6) AS above_mean, count(*) AS members FROM own JOIN sectors USING (entity) WHERE up IS NOT NULL AND above IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""")
def w11_peer_breadth(spark, sf):
    return W.peer_breadth(bars(spark, sf), sectors(spark, sf)).select("sector", "date", r("gaining"), r("above_mean"), "members")


@query(CTES + f""", wk AS (SELECT entity, {WEEK} AS date, arg_max(close, date) > arg_min(open, date) AS up FROM bars GROUP BY ALL),
s AS (SELECT w.entity, w.date, sector, up, count(up) OVER p - 1 AS n, sum(up::INT) OVER p - up::INT AS k FROM wk w JOIN sectors USING (entity) WINDOW p AS (PARTITION BY date, sector))
SELECT entity, date, share, round(share - lag(share, 4) OVER (PARTITION BY entity ORDER BY date), 6) AS change FROM (SELECT entity, date, CASE WHEN n >= 2 THEN round(k / n, 6) END AS share FROM s)""")
def w12_loo_share(spark, sf):
    wk = B.weekly_bars(bars(spark, sf)).select("entity", F.col("week").alias("date"), (F.col("close") > F.col("open")).alias("up")).join(sectors(spark, sf), "entity")
    share = wk.select("entity", "date", F.round(W.loo_share(wk, "up", ["date", "sector"]), 6).alias("share"))
    return share.withColumn("change", F.round(F.col("share") - F.lag("share", 4).over(W.series()), 6))


@query(CTES + """, m AS (SELECT entity, last_day(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL)
SELECT entity, m.date, round((rank() OVER (PARTITION BY m.date ORDER BY close) + (count(*) OVER (PARTITION BY m.date, close) - 1) / 2) / count(*) OVER (PARTITION BY m.date), 6) AS overall,
  round((rank() OVER (PARTITION BY m.date, sector ORDER BY close) + (count(*) OVER (PARTITION BY m.date, sector, close) - 1) / 2) / count(*) OVER (PARTITION BY m.date, sector), 6) AS within_sector FROM m JOIN sectors USING (entity)""")
def w13_cross_rank(spark, sf):
    m = B.month_end_bars(bars(spark, sf)).select("entity", F.col("month").alias("date"), "close").join(sectors(spark, sf), "entity")
    return m.select("entity", "date", F.round(W.cross_rank("close", ["date"]), 6).alias("overall"), F.round(W.cross_rank("close", ["date", "sector"]), 6).alias("within_sector"))


SIGN = "(CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END)"


@query(CTES + f""", s AS (SELECT entity, date, {SIGN} AS s, min({SIGN}) OVER w AS lo, max({SIGN}) OVER w AS hi FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT entity, round(avg(coalesce(CASE WHEN s > 0 THEN lo < 0 ELSE hi > 0 END, false)::INT), 6) AS flips, count(*) AS n FROM s WHERE s <> 0 GROUP BY entity""")
def w18_flip_fraction(spark, sf):
    signed = bars(spark, sf).select("entity", "date", F.signum(F.col("close") - F.col("open")).alias("s"))
    return W.flip_fraction(signed, "s", 4).select("entity", r("flips"), "n")


STAGED = """, pos AS (SELECT entity, date, close, CASE WHEN count(close) OVER w >= 20 THEN (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) * 100 END AS score
  FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 251 PRECEDING)),
staged AS (SELECT entity, date, close, CASE WHEN score < 15 THEN 'FLEE' WHEN score < 40 THEN 'SCATTER' WHEN score < 60 THEN 'CALM' WHEN score < 75 THEN 'DRIFT' ELSE 'RUSH' END AS stage FROM pos WHERE score IS NOT NULL)"""


def staged(spark, sf, b=None):
    """Bars with a 52-week position and its stage."""
    b = bars(spark, sf) if b is None else b
    high, low = W.rolling("close", 252, 20, "max"), W.rolling("close", 252, 20, "min")
    scored = b.withColumn("score", F.try_divide(F.col("close") - low, high - low) * 100).where("score is not null")
    return scored.withColumn("stage", S.stage(F.col("score")))


@query(CTES + STAGED + """ SELECT entity, date, stage, previous FROM (SELECT *, lag(stage) OVER (PARTITION BY entity ORDER BY date) AS previous FROM staged) WHERE stage <> previous AND stage IN ('RUSH', 'FLEE')""")
def w19_entries(spark, sf):
    return W.entries(staged(spark, sf), "stage", ["RUSH", "FLEE"]).select("entity", "date", "stage", "previous")


@query(CTES + STAGED + """, g AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) - row_number() OVER (PARTITION BY entity, stage ORDER BY date) AS g FROM staged)
SELECT entity, stage, start, rows FROM (SELECT entity, stage, min(date) AS start, count(*) AS rows, max(date) AS last FROM g GROUP BY entity, stage, g) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last DESC) = 1""")
def w20_run_length(spark, sf):
    return W.run_length(staged(spark, sf), "stage").select("entity", "stage", "start", "rows")


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT user_id, ts::DATE AS date FROM events), kept AS (
  SELECT user_id, min(date) AS date FROM d GROUP BY user_id
  UNION ALL
  SELECT k.user_id, (SELECT min(d.date) FROM d WHERE d.user_id = k.user_id AND d.date > k.date + 3) AS date FROM kept k WHERE EXISTS (SELECT 1 FROM d WHERE d.user_id = k.user_id AND d.date > k.date + 3)
) SELECT user_id, date FROM kept""")
def w21_collapse(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"))
    return W.collapse(ev, ["user_id"], 3)


@query("""
WITH RECURSIVE d AS (SELECT user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date) AS i FROM (SELECT DISTINCT user_id, ts::DATE AS date FROM events)), s AS (
  SELECT user_id, date, i, 'kept' AS reason, date AS last, 1 AS n FROM d WHERE i = 1
  UNION ALL
  SELECT d.user_id, d.date, d.i, x.reason, CASE WHEN x.reason = 'kept' THEN d.date ELSE s.last END AS last, x.held + (x.reason = 'kept')::INT AS n
  FROM s JOIN d ON d.user_id = s.user_id AND d.i = s.i + 1,
  LATERAL (SELECT held, CASE WHEN d.date - s.last <= 3 THEN 'cooldown' WHEN held >= 4 THEN 'budget' ELSE 'kept' END AS reason FROM (SELECT CASE WHEN year(d.date) = year(s.date) THEN s.n ELSE 0 END AS held)) x
) SELECT user_id, date, reason FROM s""")
def w22_budget(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"))
    return W.budget(ev, ["user_id"], 3, 4)


@query(CTES + """, i AS (SELECT entity, date, ln(close) AS y, row_number() OVER (PARTITION BY entity ORDER BY date)::DOUBLE AS i FROM bars)
SELECT entity, date, CASE WHEN count(*) OVER w = 21 THEN round(regr_slope(y, i) OVER w, 5) END AS slope, CASE WHEN count(*) OVER w = 21 THEN round(regr_r2(y, i) OVER w, 4) END AS r2 FROM i WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING)""")
def w26_rolling_trend(spark, sf):
    return W.rolling_trend(bars(spark, sf), "close", 21).select("entity", "date", r("slope", 5), r("r2", 4))


@query(CTES + """, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars)
SELECT a.entity, a.date, a.i - min(b.i) FILTER (WHERE b.close = m.hi) AS since FROM i a JOIN (SELECT entity, date, max(close) OVER (PARTITION BY entity ORDER BY date ROWS 62 PRECEDING) AS hi FROM bars) m ON m.entity = a.entity AND m.date = a.date
JOIN i b ON a.entity = b.entity AND b.i BETWEEN a.i - 62 AND a.i GROUP BY a.entity, a.date, a.i""")
def w31_rows_since_max(spark, sf):
    return W.rows_since_max(bars(spark, sf).select("entity", "date", "close"), "close", 63).select("entity", "date", "since")


@query(CTES + FOLDS + f""", o AS (SELECT entity, max(date) AS date, CASE WHEN day(max(date)) % 4 = 0 THEN 'RUSH' ELSE 'CALM' END AS stage FROM bars GROUP BY entity, {WEEK}),
en AS (SELECT entity, fold, min(date) AS entry_date, arg_min(close, date) AS entry FROM bars JOIN folds ON date BETWEEN test_start AND test_end GROUP BY ALL),
x AS (SELECT o.entity, fold, o.date, stage, close, entry, max(close) OVER (PARTITION BY o.entity, fold ORDER BY o.date) AS top FROM o JOIN folds ON o.date BETWEEN test_start AND test_end JOIN en USING (entity, fold) JOIN bars ON bars.entity = o.entity AND bars.date = o.date WHERE o.date >= entry_date)
SELECT entity, fold, date, round(close / entry - 1, 6) AS gain, round(top / entry - 1, 6) AS peak_gain, round(close / top - 1, 6) AS drawdown, CASE WHEN top > entry THEN round((top - close) / (top - entry), 6) ELSE 0 END AS given_back, bool_or(stage = 'RUSH') OVER (PARTITION BY entity, fold ORDER BY date ROWS 12 PRECEDING) AS recent_rush FROM x""")
def w33_giveback(spark, sf):
    """Weekly observations at each week's last session, in the positions that each fold's test span opens."""
    b = bars(spark, sf)
    seen = B.weekly_bars(b).select("entity", F.col("last_session").alias("date")).withColumn("stage", F.when(F.dayofmonth("date") % 4 == 0, "RUSH").otherwise("CALM"))
    folds = B.anchored_folds(b, 252, 126, 126, 10, 5).withColumn("fold", F.col("fold").cast("long"))
    return W.giveback(seen, b, folds, "close", "stage").select("entity", "fold", "date", r("gain"), r("peak_gain"), r("drawdown"), r("given_back"), "recent_rush")


@query(CTES + """, m AS (SELECT entity, last_day(date) AS date, sum(volume) AS v, year(last_day(date)) * 12 + month(last_day(date)) AS o FROM bars GROUP BY ALL)
SELECT entity, date, v > lag(v, 1) OVER w AND lag(v, 1) OVER w > lag(v, 2) OVER w AND o - lag(o, 1) OVER w = 1 AND lag(o, 1) OVER w - lag(o, 2) OVER w = 1 AS rising FROM m WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def w36_rising_runs(spark, sf):
    m = bars(spark, sf).groupBy("entity", F.last_day("date").alias("date")).agg(F.sum("volume").alias("v")).withColumn("o", F.year("date") * 12 + F.month("date"))
    return W.rising_runs(m, "v", "o").select("entity", "date", "rising")
