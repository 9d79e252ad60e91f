"""Queries of joins, outcomes, aggregates and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import bars as B
from ..operators import joins as J
from ..operators import membership as U
from ..operators import outcomes as O
from ..operators import windows as W
from ..sources.testdata import CTES, bars, sectors, table
from .panel import STAGED, off_tie, r, staged
from .registry import query


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderpriority", "o_orderstatus")


def day(text: str):
    return F.lit(text).cast("date")


@query("""
WITH e AS (SELECT event_id, user_id, ts::DATE AS date FROM events), o AS (SELECT o_custkey AS user_id, o_orderdate::DATE AS date, max((o_totalprice, o_orderkey)) AS m FROM orders GROUP BY ALL)
SELECT e.event_id, e.user_id, e.date, CASE WHEN e.date - o.date <= 400 THEN o.date END AS matched_on, CASE WHEN e.date - o.date <= 400 THEN m[1] END AS o_totalprice
FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.date > o.date""")
def j1_asof_join(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("date"))
    o = orders(spark, sf).select(F.col("o_custkey").alias("user_id"), "date", "o_totalprice")
    return J.asof_join(e, o, ["user_id"], "date", ["o_totalprice"], strict=True, max_age=400)


@query("""
WITH g AS (SELECT DISTINCT o_custkey, last_day(o_orderdate::DATE) AS as_of FROM orders),
f AS (SELECT o_custkey, o_orderpriority, o_orderdate::DATE AS accepted, o_orderkey, o_totalprice FROM orders)
SELECT g.o_custkey, as_of, o_orderpriority, accepted, o_orderkey, o_totalprice FROM g JOIN f ON g.o_custkey = f.o_custkey AND accepted <= as_of AND as_of - accepted <= 700
QUALIFY row_number() OVER (PARTITION BY g.o_custkey, as_of, o_orderpriority ORDER BY accepted DESC, o_orderkey DESC) = 1""")
def j2_latest_as_of(spark, sf):
    o = orders(spark, sf)
    grid = o.select("o_custkey", F.last_day("date").alias("as_of")).distinct()
    facts = o.select("o_custkey", "o_orderpriority", F.col("date").alias("accepted"), "o_orderkey", "o_totalprice")
    return J.latest_as_of(facts, grid, ["o_custkey"], "o_orderpriority", "accepted", "as_of", [F.col("o_orderkey")], max_age=700)


@query("""
WITH iv AS (SELECT o_custkey, o_orderpriority, min(o_orderdate::DATE) AS valid_from, max(o_orderdate::DATE) AS valid_to FROM orders GROUP BY ALL),
e AS (SELECT event_id, user_id, DATE '1995-01-01' + (event_id % 2400)::INT AS date FROM events)
SELECT event_id, CASE count(DISTINCT o_orderpriority) WHEN 0 THEN 'UNMAPPED' WHEN 1 THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority
FROM e LEFT JOIN iv ON user_id = o_custkey AND date BETWEEN valid_from AND valid_to GROUP BY event_id""")
def j3_interval_lookup(spark, sf):
    iv = orders(spark, sf).groupBy("o_custkey", "o_orderpriority").agg(F.min("date").alias("valid_from"), F.max("date").alias("valid_to"))
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.date_add(day("1995-01-01"), (F.col("event_id") % 2400).cast("int")).alias("date"))
    return J.interval_lookup(e, iv, "o_custkey", "date", "event_id", "o_orderpriority")


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS signal_date FROM orders WHERE o_orderstatus = 'F'), e AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, o_orderpriority AS a FROM orders)
SELECT o_orderkey, o_custkey, signal_date, count(d) AS n, count(DISTINCT a) AS actors, max(d) AS latest, count(d) > 0 AS seen FROM s LEFT JOIN e ON k = o_custkey AND d < signal_date AND d >= signal_date - 180 GROUP BY ALL""")
def j4_event_window(spark, sf):
    o = orders(spark, sf)
    s = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.col("date").alias("signal_date"))
    return J.event_window_features(s, o, "o_custkey", 180, "o_orderpriority")


@query(CTES + """, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars), e AS (SELECT n_name AS entity, DATE '1995-01-03' + (g * 31)::INT AS date FROM nation, range(0, 60) t(g)),
p AS (SELECT e.entity, e.date, coalesce(max(i), 0) + 2 AS i FROM e LEFT JOIN i ON e.entity = i.entity AND i.date <= e.date GROUP BY ALL)
SELECT p.entity, p.date, i.date AS session, i.open FROM p LEFT JOIN i ON p.entity = i.entity AND p.i = i.i""")
def j5_session_offset(spark, sf):
    e = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("g")).select("entity", F.date_add(day("1995-01-03"), F.col("g") * 31).alias("date"))
    return J.session_offset(e, bars(spark, sf), 2, ["open"])


@query(CTES + """, i AS (SELECT entity, date, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars), e AS (SELECT o_orderkey, n_name AS entity, o_orderdate::TIMESTAMP + to_minutes((o_orderkey * 7 % 1440)::BIGINT) AS accepted FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey),
l AS (SELECT *, timezone('America/New_York', timezone('UTC', accepted)) AS local FROM e), d AS (SELECT *, local::DATE + (CASE WHEN strftime(local, '%H:%M') >= '09:30' THEN 1 ELSE 0 END) AS first FROM l),
p AS (SELECT d.o_orderkey, d.entity, accepted, i.i FROM d ASOF LEFT JOIN i ON d.entity = i.entity AND d.first <= i.date)
SELECT o_orderkey, CASE WHEN b.date IS NOT NULL AND e.date IS NOT NULL THEN b.date END AS base, CASE WHEN b.date IS NOT NULL AND e.date IS NOT NULL THEN e.date END AS "end" FROM p LEFT JOIN i b ON b.entity = p.entity AND b.i = p.i - 1 LEFT JOIN i e ON e.entity = p.entity AND e.i = p.i + 2""".replace('"end"', "finish"))
def j5_reaction_sessions(spark, sf):
    """Instants all over the day (UTC), placed before or after the open."""
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), "n_nationkey")
    minutes = (F.col("o_orderkey") * 7 % 1440) * 60
    e = orders(spark, sf).join(nation, F.col("o_orderkey") % 25 == F.col("n_nationkey")).select("o_orderkey", "entity", F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + minutes).alias("accepted"))
    return J.reaction_sessions(e, bars(spark, sf), "accepted").select("o_orderkey", "base", F.col("end").alias("finish"))


@query("""
WITH f AS (SELECT DISTINCT o_custkey, last_day(o_orderdate::DATE) AS period, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.period, round(a.v, 2) AS v, round(arg_max(b.v, b.period), 2) AS prior FROM f a LEFT JOIN f b ON a.o_custkey = b.o_custkey AND a.period - b.period BETWEEN 330 AND 400 GROUP BY a.o_custkey, a.period, a.v""")
def j7_prior_year_match(spark, sf):
    f = orders(spark, sf).groupBy("o_custkey", F.last_day("date").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    return J.prior_year_match(f, ["o_custkey"], "period", "v").select("o_custkey", "period", r("v", 2), r("prior", 2))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j8_checked_join(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.checked_join(orders(spark, sf).select("o_orderkey", "o_custkey"), c, ["o_custkey"]).drop("o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def j9_restrict(spark, sf):
    parent = orders(spark, sf).where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.restrict(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), parent, ["l_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j10_exclude(spark, sf):
    gone = orders(spark, sf).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.exclude(table(spark, sf, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("""
SELECT l_suppkey, o_custkey, o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'
QUALIFY row_number() OVER (PARTITION BY l_suppkey, o_custkey, o_orderkey ORDER BY l_linenumber) = 1""")
def j11_owner_events(spark, sf):
    both = orders(spark, sf).where("o_orderstatus <> 'P'").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return J.latest(both.select("l_suppkey", "o_custkey", "o_orderkey", "l_linenumber"), ["l_suppkey", "o_custkey", "o_orderkey"], [F.col("l_linenumber")])


@query("""
SELECT a.o_custkey, a.o_orderdate::DATE AS added, a.o_orderkey AS add_id, b.o_orderdate::DATE AS removed, b.o_orderkey AS remove_id
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' AND abs(a.o_orderdate::DATE - b.o_orderdate::DATE) <= 20""")
def j12_pair_within_days(spark, sf):
    o = orders(spark, sf).withColumnRenamed("o_orderkey", "id")
    return J.pair_within_days(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", 20)


@query("""
WITH e AS (SELECT o_orderkey AS id, o_custkey, o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT o_orderkey AS filing, o_custkey, o_orderdate::DATE AS filed FROM orders WHERE o_orderstatus = 'O')
SELECT id, count(filing) AS n, CASE WHEN count(filing) = 1 THEN min(filing) END AS filing, CASE count(filing) WHEN 0 THEN 'NONE' WHEN 1 THEN 'UNIQUE' ELSE 'MULTIPLE' END AS status
FROM e LEFT JOIN f ON e.o_custkey = f.o_custkey AND filed BETWEEN date - 60 AND date + 30 GROUP BY id""")
def j13_match_evidence(spark, sf):
    o = orders(spark, sf).withColumnRenamed("o_orderkey", "id")
    return J.match_evidence(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", 60, 30)


@query(CTES + """, bench AS (SELECT date, avg(close) AS bench FROM bars GROUP BY date), sec AS (SELECT sector, date, avg(close) AS sector_close FROM bars JOIN sectors USING (entity) GROUP BY ALL)
SELECT entity, date, sector, close, round(sector_close + 1e-8, 6) AS sector_close, round(bench + 1e-8, 6) AS bench FROM bars JOIN sectors USING (entity) JOIN sec USING (sector, date) JOIN bench USING (date)""")
def j18_with_context(spark, sf):
    b = bars(spark, sf).join(sectors(spark, sf), "entity")
    bench = b.groupBy("date").agg(F.avg("close").alias("bench"))
    sec = b.groupBy("sector", "date").agg(F.avg("close").alias("sector_close"))
    return b.join(sec, ["sector", "date"]).join(bench, "date").select("entity", "date", "sector", "close", off_tie("sector_close"), off_tie("bench"))


@query("""
WITH x AS (SELECT 'orders' AS source, o_custkey::VARCHAR AS entity, o_orderpriority AS field, o_orderdate::DATE AS observed, o_orderdate::DATE + 1 AS available_at, o_totalprice AS value FROM orders
 UNION ALL SELECT 'events', user_id::VARCHAR, event_type, ts::DATE, ts::DATE, value FROM events)
SELECT source, entity, field, observed, available_at, value FROM x WHERE available_at <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY source, entity, field, observed ORDER BY available_at DESC, value DESC) = 1""")
def j19_pit_panel(spark, sf):
    o = orders(spark, sf).select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("field"), F.col("date").alias("observed"), F.date_add("date", 1).alias("available_at"), F.col("o_totalprice").alias("value"))
    d = F.to_date("ts")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("field"), d.alias("observed"), d.alias("available_at"), "value")
    return J.pit_panel({"orders": o, "events": e}, day("2024-01-20"))


REPLAY = STAGED + """, starts AS (SELECT entity, date, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY entity ORDER BY date) AS previous FROM staged) WHERE stage <> previous),
fwd AS (SELECT entity, date, lead(open, 1) OVER w AS entry, h, CASE h WHEN 5 THEN lead(close, 5) OVER w ELSE lead(close, 21) OVER w END AS c,
  CASE h WHEN 5 THEN max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) ELSE max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) END AS hi,
  CASE h WHEN 5 THEN min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) ELSE min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) END AS lo
  FROM bars, (VALUES (5), (21)) v(h) WINDOW w AS (PARTITION BY entity, h ORDER BY date)),
replay AS (SELECT entity, date, stage, h AS horizon, c / entry - 1 AS ret, hi / entry - 1 AS mfe, lo / entry - 1 AS mae FROM starts JOIN fwd USING (entity, date) WHERE c IS NOT NULL)"""


def replay(spark, sf):
    # Stages and outcomes are windows over the same series: one scan and one shuffle of the bars.
    starts = W.entries(staged(spark, sf, O.with_forward(bars(spark, sf), (5, 21))), "stage")
    return O.outcome_rows(starts, ["entity", "date", "stage"], (5, 21))


@query(CTES + REPLAY + " SELECT entity, date, stage, horizon, round(ret, 6) AS ret, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM replay")
def f1_replay_outcomes(spark, sf):
    return replay(spark, sf).select("entity", "date", "stage", "horizon", r("ret"), r("mfe"), r("mae"))


SUMMARY = """ SELECT stage, horizon, count(DISTINCT (entity, date)) AS episodes, count(DISTINCT entity) AS entities, count(DISTINCT date_trunc('week', date)) AS weeks, round(quantile_cont(ret, 0.5), 6) AS median_ret,
 round(quantile_cont(mfe, 0.5), 6) AS median_mfe, round(quantile_cont(mae, 0.5), 6) AS median_mae, round(avg((ret > 0)::INT), 6) AS positive FROM replay GROUP BY ALL"""


@query(CTES + REPLAY + SUMMARY)
def flagship_replay(spark, sf):
    """Bars to stages to entries to forward outcomes, summed up by stage and horizon."""
    return A.dependency_summary(replay(spark, sf), ["stage", "horizon"]).select("stage", "horizon", "episodes", "entities", "weeks", r("median_ret"), r("median_mfe"), r("median_mae"), r("positive"))


@query(CTES + REPLAY + SUMMARY.replace("stage, horizon,", "sector, horizon,", 1).replace("FROM replay", "FROM replay JOIN sectors USING (entity)"))
def a7_dependency_summary(spark, sf):
    return A.dependency_summary(replay(spark, sf).join(sectors(spark, sf), "entity"), ["sector", "horizon"]).select("sector", "horizon", "episodes", "entities", "weeks", r("median_ret"), r("median_mfe"), r("median_mae"), r("positive"))


@query(CTES + REPLAY + " SELECT entity, stage, horizon, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg((ret > 0)::INT), 6) AS positive FROM replay GROUP BY GROUPING SETS ((stage, horizon), (entity, stage, horizon))")
def a8_stage_context(spark, sf):
    return A.stage_context(replay(spark, sf)).select("entity", "stage", "horizon", "n", r("mean_ret"), r("positive"))


@query(CTES + REPLAY + """, wk AS (SELECT date_trunc('week', date) AS week, count(*) AS n FROM starts GROUP BY ALL)
SELECT sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS max_share, round((SELECT sum(n) FROM (SELECT n FROM wk ORDER BY n DESC, week LIMIT 10)) / sum(n), 6) AS top_share FROM wk""")
def a10_cluster_concentration(spark, sf):
    starts = W.entries(staged(spark, sf).select("entity", "date", "stage"), "stage")
    return A.cluster_concentration(starts).select("total", r("max_share"), r("top_share"))


@query(CTES + """ SELECT entity, date, round(ret, 6) AS ret, round(worst, 6) AS worst, ret > 0 AS hit FROM (SELECT entity, date, lead(close, 10) OVER w / close - 1 AS ret, min(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) / close - 1 AS worst FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE ret IS NOT NULL""")
def f2_forward_metrics(spark, sf):
    return O.forward_metrics(bars(spark, sf), 10).select("entity", "date", r("ret"), r("worst"), "hit")


@query(CTES + REPLAY + """, i AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars),
p AS (SELECT s.entity, s.date, s.stage, count(b.i) AS n, min(b.close) / a.close - 1 AS lo, max(b.close) / a.close - 1 AS hi, arg_max(b.close, b.i) / a.close - 1 AS fin, min(b.i - a.i) FILTER (WHERE b.close / a.close - 1 <= -0.2) AS first_fall
 FROM starts s JOIN i a USING (entity, date) LEFT JOIN i b ON b.entity = a.entity AND b.i BETWEEN a.i + 1 AND a.i + 21 GROUP BY s.entity, s.date, s.stage, a.close)
SELECT entity, date, stage, CASE WHEN n < 21 THEN 'CENSORED' WHEN lo <= -0.6 THEN 'BREAK' WHEN lo <= -0.4 THEN 'LARGE' WHEN lo <= -0.2 AND fin >= 0 THEN 'TEMPORARY' WHEN hi >= 0.5 THEN 'CONTINUATION' ELSE 'UNRESOLVED' END AS label, first_fall FROM p""")
def f3_label_fixed(spark, sf):
    starts = W.entries(staged(spark, sf).select("entity", "date", "stage"), "stage").select("entity", "date", "stage")
    return O.label_fixed(starts, bars(spark, sf), 21, -0.6, -0.4, -0.2, 0.5).withColumn("first_fall", F.col("first_fall").cast("long"))


@query(CTES + """, e AS (SELECT o_orderkey AS id, n_name AS entity, (o_orderdate::DATE + INTERVAL 6 MONTH)::DATE AS due FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey WHERE o_orderstatus = 'P'),
f AS (SELECT id, due, min(b.date) AS outcome_date, arg_min(b.close, b.date) AS close FROM e LEFT JOIN bars b ON b.entity = e.entity AND b.date BETWEEN due AND due + 7 AND b.date <= DATE '2001-10-01' GROUP BY ALL)
SELECT *, CASE WHEN close IS NOT NULL THEN 'AVAILABLE' WHEN due + 7 > DATE '2001-10-01' THEN 'PENDING' ELSE 'UNAVAILABLE' END AS status FROM f""")
def f7_calendar_outcome(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), "n_nationkey")
    e = orders(spark, sf).where("o_orderstatus = 'P'").join(nation, F.col("o_orderkey") % 25 == F.col("n_nationkey")).select(F.col("o_orderkey").alias("id"), "entity", "date")
    return O.calendar_outcome(e, bars(spark, sf), 6, 7, day("2001-10-01"))


@query(CTES + """, m AS (SELECT entity, last_day(date) AS month, arg_max(close, date) AS close FROM bars GROUP BY ALL)
SELECT entity, month, round(ret, 6) AS ret, round(trough, 6) AS trough FROM (SELECT entity, month, lead(close, 6) OVER w / close - 1 AS ret, min(close) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) / close - 1 AS trough FROM m WINDOW w AS (PARTITION BY entity ORDER BY month)) WHERE ret IS NOT NULL""")
def f8_monthly_forward(spark, sf):
    return O.monthly_forward(B.month_end_bars(bars(spark, sf)), 6).select("entity", "month", r("ret"), r("trough"))


POLICY = REPLAY + """, px AS (SELECT entity, date, lead(open, 1) OVER w AS x, lead(close, 63) OVER w AS fin, lead(open, 22) OVER w AS in21 FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
pol AS (SELECT s.entity, s.date, wait, fee + slip AS cost, CASE WHEN wait = 0 THEN 0.95 ELSE 0.95 + 0.05 * x * (1 - slip) * (1 - fee) / (in21 * (1 + slip) * (1 + fee)) END AS shares, CASE WHEN wait = 0 THEN 0.05 * x * (1 - slip) * (1 - fee) ELSE 0 END AS cash, fin
 FROM starts s JOIN px USING (entity, date), (VALUES (0), (21)) v(wait), (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.001::DOUBLE, 0.0005::DOUBLE)) c(fee, slip) WHERE s.stage = 'RUSH' AND fin IS NOT NULL AND x > 0)"""


def policy(spark, sf):
    starts = W.entries(staged(spark, sf).select("entity", "date", "stage"), "stage", ["RUSH"]).select("entity", "date")
    return O.policy_counterfactual(starts, bars(spark, sf), 63, 0.05, (0, 21), ((0.0, 0.0), (0.001, 0.0005)))


@query(CTES + POLICY + " SELECT entity, date, wait, cost, round((shares * fin + cash) / fin - 1, 6) AS wealth_delta, round(shares - 1, 6) AS share_delta FROM pol")
def f9_policy_counterfactual(spark, sf):
    return policy(spark, sf).select("entity", "date", "wait", "cost", r("wealth_delta"), r("share_delta"))


@query(CTES + REPLAY + """, mk AS (SELECT date, avg(open) AS bo, avg(close) AS bc FROM bars GROUP BY date), nb AS (SELECT bars.*, bo, bc, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars JOIN mk USING (date)),
p AS (SELECT e.entity || '|' || e.date::VARCHAR AS id, b.i - e.i AS k, b.open, b.close, b.bo, b.bc, e.close AS base FROM nb e JOIN starts s ON s.entity = e.entity AND s.date = e.date AND s.stage = 'RUSH' JOIN nb b ON b.entity = e.entity AND b.i BETWEEN e.i AND e.i + 63),
q AS (SELECT *, count(*) OVER w AS n, max(open) FILTER (WHERE k = 1) OVER w AS out, max(bo) FILTER (WHERE k = 1) OVER w AS bout, max(open) FILTER (WHERE k = 22) OVER w AS in21, max(close) FILTER (WHERE k = 63) OVER w AS fin FROM p WINDOW w AS (PARTITION BY id)),
x AS (SELECT id, k, close, base, fin, policy, fee + slip AS cost, CASE WHEN k >= 1 THEN 0.95 ELSE 1 END * close + CASE WHEN k < 1 THEN 0 WHEN policy = 'keep_cash' OR (policy = 'reenter_21' AND k < 22) THEN 0.05 * out * (1 - slip) * (1 - fee) WHEN policy = 'benchmark' THEN 0.05 * out * (1 - slip) * (1 - fee) / (bout * (1 + slip) * (1 + fee)) * bc ELSE 0.05 * out * (1 - slip) * (1 - fee) / (in21 * (1 + slip) * (1 + fee)) * close END AS wealth
 FROM q, (VALUES ('keep_cash'), ('reenter_21'), ('benchmark')) v(policy), (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.001::DOUBLE, 0.0005::DOUBLE)) c(fee, slip) WHERE n = 64 AND out > 0 AND bout > 0),
y AS (SELECT *, wealth / max(wealth) OVER w - 1 AS fall, close / max(close) OVER w - 1 AS hold_fall FROM x WINDOW w AS (PARTITION BY id, policy, cost ORDER BY k))
SELECT id, policy, cost, round((arg_max(wealth, k) - max(fin)) / max(base), 6) AS delta, round(greatest(0, abs(min(hold_fall)) - abs(min(fall))), 6) AS drawdown_avoided, round(greatest(0, -(arg_max(wealth, k) - max(fin)) / max(base)), 6) AS missed_upside FROM y GROUP BY id, policy, cost""")
def f9_policy_paths(spark, sf):
    b = bars(spark, sf)
    starts = W.entries(staged(spark, sf).select("entity", "date", "stage"), "stage", ["RUSH"]).select(F.concat_ws("|", "entity", F.col("date").cast("string")).alias("id"), "entity", "date")
    bench = b.groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return O.policy_paths(starts, b, bench, 63, 0.05, (21,), ((0.0, 0.0), (0.001, 0.0005))).select("id", "policy", "cost", r("delta"), r("drawdown_avoided"), r("missed_upside"))


@query(CTES + POLICY + " SELECT entity, date, max(CASE WHEN cost = 0 THEN round((shares * fin + cash) / fin - 1, 6) END) AS free, max(CASE WHEN cost > 0 THEN round((shares * fin + cash) / fin - 1, 6) END) AS charged FROM pol WHERE wait = 21 GROUP BY ALL")
def a29_pivot_costs(spark, sf):
    wide = A.pivot_costs(policy(spark, sf).where("wait = 21").withColumn("wealth_delta", F.round("wealth_delta", 6)), ["entity", "date"], "cost", [0.0, 0.001 + 0.0005], "wealth_delta")
    return wide.toDF("entity", "date", "free", "charged")


@query(CTES + POLICY + " SELECT wait, cost, count(*) AS n, round(quantile_cont((shares * fin + cash) / fin - 1, 0.5), 6) AS median, round(avg((shares * fin + cash) / fin - 1), 6) AS mean, round(avg(((shares * fin + cash) / fin - 1 > 0)::INT), 6) AS positive, round(quantile_cont(cost * 0.05 * (1 + (wait > 0)::INT), 0.95), 8) AS p95_cost FROM pol GROUP BY ALL")
def a21_policy_summary(spark, sf):
    paid = policy(spark, sf).withColumn("paid", F.col("cost") * 0.05 * (1 + (F.col("wait") > 0).cast("int")))
    return A.policy_summary(paid, ["wait", "cost"], "wealth_delta", "paid").select("wait", "cost", "n", r("median"), r("mean"), r("positive"), r("p95_cost", 8))


@query("SELECT l_orderkey, l_suppkey, sum(l_quantity) AS value, count(*) AS rows, list_sort(list(DISTINCT l_returnflag)) AS identifiers FROM lineitem GROUP BY ALL")
def a1_aggregate_holdings(spark, sf):
    return A.aggregate_holdings(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")


@query("""
WITH h AS (SELECT l_suppkey, year(l_shipdate) AS period, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, period ORDER BY v DESC, l_partkey) AS n FROM h)
SELECT l_suppkey, period, count(*) AS breadth, round(max(v) / sum(v), 6) AS top1_share, round(sum(v) FILTER (WHERE n <= 5) / sum(v), 6) AS top5_share, round(sum(v * v) / (sum(v) * sum(v)), 6) AS hhi FROM k GROUP BY ALL""")
def a2_concentration(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("period", F.year("l_shipdate").cast("long"))
    return A.concentration(li, ["l_suppkey", "period"], "l_partkey", "l_quantity").select("l_suppkey", "period", "breadth", r("top1_share"), r("top5_share"), r("hhi"))


@query("""
WITH v AS (SELECT l_suppkey, year(o_orderdate) AS period, o_custkey, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_suppkey + year(o_orderdate)) % 9 > 0 GROUP BY ALL), h AS (SELECT l_suppkey, period, o_custkey FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, period ORDER BY v DESC, o_custkey) AS n FROM v), s AS (SELECT l_suppkey, period, sum(v) FILTER (WHERE n <= 5) / sum(v) AS top5, sum(v * v) / (sum(v) * sum(v)) AS hhi FROM n GROUP BY ALL),
b AS (SELECT l_suppkey, min(period) AS born FROM h GROUP BY ALL), c AS (SELECT l_suppkey, period, count(*) AS holders FROM h GROUP BY ALL), k AS (SELECT a.l_suppkey, a.period, count(*) AS kept FROM h a JOIN h b ON a.l_suppkey = b.l_suppkey AND a.o_custkey = b.o_custkey AND b.period = a.period - 1 GROUP BY ALL)
SELECT c.l_suppkey, c.period, c.holders, CASE WHEN c.period > born THEN c.holders - coalesce(kept, 0) END AS new, CASE WHEN c.period > born THEN coalesce(p.holders, 0) - coalesce(kept, 0) END AS exited, round((c.holders - p.holders) / p.holders, 6) AS breadth_change, round(s.top5 - q.top5, 6) AS top5_change, round(s.hhi - q.hhi, 6) AS hhi_change
FROM c LEFT JOIN k USING (l_suppkey, period) LEFT JOIN c p ON p.l_suppkey = c.l_suppkey AND p.period = c.period - 1 JOIN b ON b.l_suppkey = c.l_suppkey JOIN s ON s.l_suppkey = c.l_suppkey AND s.period = c.period LEFT JOIN s q ON q.l_suppkey = c.l_suppkey AND q.period = c.period - 1""")
def a3_slow_context(spark, sf):
    """Each supplier reports nothing in some years, so that holders come back."""
    o = orders(spark, sf).select("o_orderkey", "o_custkey", F.year("date").cast("long").alias("period"))
    held = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).where((F.col("l_suppkey") + F.col("period")) % 9 > 0)
    return A.slow_context(held, "l_suppkey", "period", "o_custkey", "l_quantity").select("l_suppkey", "period", "holders", "new", "exited", r("breadth_change"), r("top5_change"), r("hhi_change"))


@query("""
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS rank, sum(n) OVER (PARTITION BY l_partkey) AS total, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag))
SELECT l_partkey, l_returnflag, n, total::BIGINT AS total FROM k WHERE rank = 1 AND n >= 3 AND n >= 0.5 * total AND n >= 2 * coalesce(second, 0)""")
def a4_dominant_owner(spark, sf):
    return A.dominant_owner(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag", 3, 0.5, 2)


@query("""
WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders), f AS (SELECT o_custkey, min(year) AS y0 FROM m GROUP BY 1)
SELECT m.o_custkey, m.year, m.month, CASE WHEN m.year - y0 < 3 THEN 'WARMUP' WHEN (SELECT count(*) FROM m p WHERE p.o_custkey = m.o_custkey AND p.month = m.month AND p.year BETWEEN m.year - 3 AND m.year - 1) = 3 THEN 'ROUTINE' ELSE 'NONROUTINE' END AS status FROM m JOIN f USING (o_custkey)""")
def a6_routine_status(spark, sf):
    return A.routine_status(orders(spark, sf), "o_custkey", "date").withColumn("year", F.col("year").cast("long")).withColumn("month", F.col("month").cast("long"))


@query(CTES + """, g AS (SELECT *, date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS gap FROM bars)
SELECT entity, count(*) AS rows, sum((gap = 0)::INT)::BIGINT AS repeats, sum((close IS NULL)::INT)::BIGINT AS nulls, sum((least(open, low, close) <= 0)::INT)::BIGINT AS nonpositive, sum((low > least(open, close) OR high < greatest(open, close))::INT)::BIGINT AS broken,
 max(gap) AS largest_gap, DATE '2001-12-31' - max(date) AS age, max(gap) <= 10 AND DATE '2001-12-31' - max(date) <= 60 AS passed FROM g GROUP BY entity""")
def a13_audit_bars(spark, sf):
    return A.audit_bars(bars(spark, sf), day("2001-12-31"), 10, 60).withColumn("largest_gap", F.col("largest_gap").cast("long")).withColumn("age", F.col("age").cast("long")).withColumn("repeats", F.coalesce("repeats", F.lit(0)))


@query(CTES + STAGED.replace("close, CASE WHEN score < 15", "score, CASE WHEN score < 15") + """, m AS (SELECT date, quantile_cont(score, 0.5) AS market FROM staged GROUP BY date)
SELECT date, sector, round(quantile_cont(score, 0.5), 5) AS sector_median, round(any_value(market), 5) AS market FROM staged JOIN sectors USING (entity) JOIN m USING (date) GROUP BY ALL""")
def a15_regime_context(spark, sf):
    return A.regime_context(staged(spark, sf).join(sectors(spark, sf), "entity"), "score", "sector").select("date", "sector", r("sector_median", 5), r("market", 5))


DAILY = """, rets AS (SELECT entity, date, least(greatest(close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1, -0.5), 0.5) AS ret FROM bars),
pd AS (SELECT sector, date, avg(ret) AS ret, count(DISTINCT entity) AS members FROM rets JOIN sectors USING (entity) WHERE ret IS NOT NULL GROUP BY ALL)"""


def daily(spark, sf):
    ret = F.least(F.greatest(W.change("close", 1), F.lit(-0.5)), F.lit(0.5))
    return A.portfolio_daily(bars(spark, sf).withColumn("ret", ret).where("ret is not null").join(sectors(spark, sf), "entity"), ["sector"])


@query(CTES + DAILY + " SELECT sector, date, round(ret, 6) AS ret, members FROM pd")
def a16_portfolio_daily(spark, sf):
    return daily(spark, sf).select("sector", "date", r("ret"), "members")


@query(CTES + DAILY + """, be AS (SELECT date, avg(ret) * 0.01 AS b FROM pd GROUP BY date), half AS (SELECT sector, date, ret * 0.01 AS ret, b FROM pd JOIN be USING (date)), w AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY sector ORDER BY date)) AS w FROM half), d AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY sector ORDER BY date), 1) - 1 AS dd FROM w)
SELECT sector, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1, 6) AS yearly, round(min(dd), 6) AS drawdown, round(avg(ret) * sqrt(252) / sqrt(avg(pow(least(ret, 0), 2))), 4) AS sortino, round((pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1) / abs(min(dd)), 4) AS calmar,
 round(avg(ret) FILTER (WHERE b > 0) / avg(b) FILTER (WHERE b > 0), 5) AS up_capture, round(avg(ret) FILTER (WHERE b < 0) / avg(b) FILTER (WHERE b < 0), 5) AS down_capture FROM d GROUP BY sector""")
def a17_return_metrics(spark, sf):
    half = daily(spark, sf).withColumn("ret", F.col("ret") * 0.01)
    bench = half.groupBy("date").agg(F.avg("ret").alias("bench_ret"))
    return A.return_metrics(half, ["sector"], benchmark=bench).select("sector", "n", r("total"), r("yearly"), r("drawdown"), r("sortino", 4), r("calmar", 4), r("up_capture", 5), r("down_capture", 5))


@query(CTES + REPLAY + """, y AS (SELECT entity, unnest(range(year(min(date)), year(max(date)) + 1)) AS year FROM bars GROUP BY entity), c AS (SELECT y.entity, y.year, count(s.date) AS n FROM y LEFT JOIN starts s ON s.entity = y.entity AND year(s.date) = y.year GROUP BY ALL)
SELECT count(*) AS entity_years, quantile_cont(n, 0.5) AS median, max(n) AS most, sum((n > 20)::INT)::BIGINT AS above FROM c""")
def a22_annual_rates(spark, sf):
    spans = bars(spark, sf).groupBy("entity").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return A.annual_rates(W.entries(staged(spark, sf).select("entity", "date", "stage"), "stage"), spans, 20)


@query("SELECT l_returnflag, count(*) AS n, round(avg((l_tax IS NOT NULL)::INT), 6) AS coverage, round(quantile_cont(abs(l_tax - l_discount), 0.5), 6) AS median_err, round(quantile_disc(abs(l_tax - l_discount), 0.95), 6) AS p95_err, round(avg((abs(l_tax - l_discount) > 0.045)::INT), 6) AS beyond FROM lineitem GROUP BY ALL")
def a18_drift_metrics(spark, sf):
    return A.drift_metrics(table(spark, sf, "lineitem"), ["l_returnflag"], "l_tax", "l_discount", 0.045).select("l_returnflag", "n", r("coverage"), r("median_err"), r("p95_err"), r("beyond"))


SNAP = """WITH s AS (SELECT DISTINCT last_day(o_orderdate::DATE) AS date, o_custkey AS entity FROM orders), d AS (SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM s)),
j AS (SELECT s.*, i, nxt, i - row_number() OVER (PARTITION BY entity ORDER BY i) AS g FROM s JOIN d USING (date)), iv AS (SELECT entity, min(date) AS valid_from, arg_max_null(nxt, i) AS valid_to FROM j GROUP BY entity, g)"""


def snapshots(spark, sf):
    return orders(spark, sf).select(F.last_day("date").alias("date"), F.col("o_custkey").alias("entity")).distinct()


@query(SNAP + " SELECT * FROM iv")
def u1_membership_intervals(spark, sf):
    return U.membership_intervals(snapshots(spark, sf))


@query("""WITH iv AS (SELECT o_custkey AS entity, o_orderdate::DATE AS valid_from, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate::DATE + 100 END AS valid_to FROM orders),
n AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity ORDER BY valid_from, valid_to NULLS LAST) AS next_from FROM iv)
SELECT *, CASE WHEN valid_to IS NULL THEN 'OPEN_BEFORE_NEXT' ELSE 'OVERLAP' END AS problem FROM n WHERE next_from IS NOT NULL AND (valid_to IS NULL OR valid_to > next_from)""")
def u2_validate_intervals(spark, sf):
    iv = orders(spark, sf).select(F.col("o_custkey").alias("entity"), F.col("date").alias("valid_from"), F.when(F.col("o_orderkey") % 10 > 0, F.date_add("date", 100)).alias("valid_to"))
    return U.validate_intervals(iv)


@query(SNAP + " SELECT DISTINCT entity FROM iv WHERE valid_from <= DATE '1998-03-15' AND (valid_to IS NULL OR valid_to > DATE '1998-03-15')")
def u3_members_at(spark, sf):
    return U.members_at(U.membership_intervals(snapshots(spark, sf)), day("1998-03-15"))


@query("""WITH x AS (SELECT c_custkey AS entity, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' ELSE lower(c_mktsegment) END AS exit_reason FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey), f AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderdate >= DATE '2000-06-01')
SELECT (SELECT count(*) FROM f) AS fixed, count(*) AS records, count(DISTINCT entity) AS historical, (SELECT count(*) FROM (SELECT entity FROM x EXCEPT SELECT entity FROM f)) AS gone, round(count(DISTINCT entity) / (SELECT count(*) FROM f), 6) AS coverage, (SELECT string_agg(exit_reason || '=' || n, ',' ORDER BY exit_reason) FROM (SELECT exit_reason, count(*) AS n FROM x WHERE exit_reason <> 'active' GROUP BY ALL)) AS exits,
 CASE WHEN (SELECT count(*) FROM (SELECT entity FROM x EXCEPT SELECT entity FROM f)) >= 10 AND count(DISTINCT entity) / (SELECT count(*) FROM f) >= 0.5 THEN 'POINT_IN_TIME_READY' ELSE 'SURVIVORSHIP_BIAS_REMAINS' END AS status FROM x""")
def u3_survivorship_coverage(spark, sf):
    c = table(spark, sf, "customer").join(orders(spark, sf).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    records = c.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise(F.lower("c_mktsegment")).alias("exit_reason"), F.lit("orders").alias("source"), F.col("c_mktsegment").alias("sector"))
    out = U.survivorship_coverage(records, orders(spark, sf).where(F.col("date") >= day("2000-06-01")).select(F.col("o_custkey").alias("entity")))
    return out.withColumn("exits", F.array_join(F.transform("exits", lambda e: F.concat_ws("=", e["exit_reason"], e["n"].cast("string"))), ",")).withColumn("coverage", F.round("coverage", 6))


@query(CTES + REPLAY + """, i AS (SELECT entity, date, close, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM bars), c AS (SELECT entity, i FROM i JOIN starts USING (entity, date) WHERE stage = 'RUSH')
SELECT entity, date, close FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.entity = i.entity AND i.i BETWEEN c.i - 3 AND c.i + 5)""")
def u5_drop_windows(spark, sf):
    centres = W.entries(staged(spark, sf).select("entity", "date", "stage"), "stage", ["RUSH"])
    return U.drop_windows(bars(spark, sf).select("entity", "date", "close"), centres, 3, 5)


@query("""WITH l AS (SELECT o_custkey AS entity, o_orderdate::DATE AS date, CASE WHEN o_orderstatus = 'F' THEN 'ADD' ELSE 'REMOVE' END AS action FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) = 1),
s AS (SELECT *, CASE WHEN entity % 2 = 1 THEN 1 ELSE 0 END + coalesce(sum(CASE action WHEN 'ADD' THEN 1 ELSE -1 END) OVER (PARTITION BY entity ORDER BY date, action ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT entity, date, action, before::BIGINT AS before, CASE WHEN action = 'ADD' AND before >= 1 THEN 'ADD_EXISTING' WHEN action = 'REMOVE' AND before <= 0 THEN 'REMOVE_ABSENT' END AS anomaly FROM s""")
def u6_replay_membership(spark, sf):
    o = J.latest(orders(spark, sf), ["o_custkey", "date"], [F.col("o_orderkey")])
    ledger = o.select(F.col("o_custkey").alias("entity"), "date", F.when(F.col("o_orderstatus") == "F", "ADD").otherwise("REMOVE").alias("action"))
    return U.replay_membership(ledger.where("entity % 2 = 1").select("entity").distinct(), ledger)


ANCHOR = """WITH g AS (SELECT *, coalesce(date - lag(date) OVER w > 200, true)::INT AS new FROM (SELECT o_custkey, o_orderdate::DATE AS date FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY date)),
k AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY date) AS g FROM g)"""


@query(ANCHOR + " SELECT o_custkey, min(date) AS valid_from, max(date) AS valid_to, count(*) AS anchors FROM k GROUP BY o_custkey, g HAVING count(*) >= 2")
def u7_observation_intervals(spark, sf):
    return U.observation_intervals(orders(spark, sf).select("o_custkey", "date"), ["o_custkey"], 200, 2)


@query("""WITH iv AS (SELECT o_custkey % 40 AS symbol, o_custkey AS owner, min(o_orderdate::DATE) AS valid_from, min(o_orderdate::DATE) + 200 AS valid_to FROM orders GROUP BY ALL)
SELECT *, EXISTS (SELECT 1 FROM iv b WHERE b.symbol = iv.symbol AND b.owner <> iv.owner AND iv.valid_from <= b.valid_to AND b.valid_from <= iv.valid_to) AS conflict FROM iv""")
def u8_mark_conflicts(spark, sf):
    iv = orders(spark, sf).groupBy((F.col("o_custkey") % 40).alias("symbol"), F.col("o_custkey").alias("owner")).agg(F.min("date").alias("valid_from")).withColumn("valid_to", F.date_add("valid_from", 200))
    return U.mark_conflicts(iv, "symbol", "owner")


HOLD = """WITH f AS (SELECT o_orderkey AS filing, o_custkey AS manager, year(o_orderdate) AS period, o_orderkey AS seq, CASE left(o_orderpriority, 1) WHEN '1' THEN 'SNAPSHOT' WHEN '2' THEN 'REPLACE' WHEN '5' THEN 'EXCLUDE' ELSE 'ADD' END AS operation FROM orders),
h AS (SELECT l_orderkey AS filing, l_suppkey AS security, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
g AS (SELECT *, sum((operation <> 'ADD')::INT) OVER (PARTITION BY manager, period ORDER BY seq) AS grp FROM f WHERE operation <> 'EXCLUDE' AND filing IN (SELECT filing FROM h)),
first AS (SELECT manager, period, grp, security, value, seq AS since FROM g JOIN h USING (filing) QUALIFY row_number() OVER (PARTITION BY manager, period, grp, security ORDER BY seq) = 1)"""


@query(HOLD + " SELECT manager, period, filing, seq, security, value FROM g JOIN first USING (manager, period, grp) WHERE since <= seq")
def u12_effective_holdings(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    op = F.when(p == "1", "SNAPSHOT").when(p == "2", "REPLACE").when(p == "5", "EXCLUDE").otherwise("ADD")
    f = orders(spark, sf).select(F.col("o_orderkey").alias("filing"), F.col("o_custkey").alias("manager"), F.year("date").cast("long").alias("period"), F.col("o_orderkey").alias("seq"), op.alias("operation"))
    h = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("filing"), F.col("l_suppkey").alias("security")).agg(F.sum("l_quantity").alias("value"))
    return U.effective_holdings(f, h)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT CASE WHEN a.k IS NULL THEN 'MISSING' WHEN b.k IS NULL THEN 'EXTRA' ELSE 'VERIFIED' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY ALL""")
def u14_reconcile_sets(spark, sf):
    o = orders(spark, sf)
    return U.reconcile_sets(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def k1_latest(spark, sf):
    return J.latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
