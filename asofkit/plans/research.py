"""Queries of states, labels, texts and further summaries."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import labels as LB
from ..operators import spans as S
from ..operators import texts as T
from ..operators import windows as W
from ..sources.testdata import CTES, bars, sectors, table
from .events import orders
from .panel import WEEK, guarded, r, rsi_sql
from .registry import query


def state(spark, sf):
    b, s = bars(spark, sf), sectors(spark, sf)
    own = b.join(s, "entity")
    sector = own.groupBy("sector", "date").agg(F.avg("close").alias("sector_close"))
    market = own.groupBy("date").agg(F.avg("close").alias("market_close"))
    breadth = W.peer_breadth(b, s, 63, 200, 3).select("sector", "date", F.col("positive").alias("breadth"))
    context = own.select("entity", "sector", "date").join(sector, ["sector", "date"]).join(market, "date").join(breadth, ["sector", "date"], "left")
    return LB.state_panel(b, context, 252, 60)


def ranked(c: str) -> str:
    return f"CASE WHEN count(b.{c}) >= 60 AND a.{c} IS NOT NULL THEN (count(*) FILTER (WHERE b.{c} < a.{c}) + (count(*) FILTER (WHERE b.{c} = a.{c}) + 1) / 2) / count(b.{c}) END AS q{c}"


def median(a: str) -> str:
    return f"round(100 * coalesce((q{a}1 + q{a}2) / 2, q{a}1, q{a}2), 9)"


MEASURES = ("x1", "x2", "t1", "t2", "r1", "r2", "p1", "p2", "d1")
STATE = CTES.replace("WITH", "WITH RECURSIVE", 1) + f""", w AS (SELECT entity, sector, date, close, volume, close / lag(close, 63) OVER s - 1 AS g63, close / lag(close) OVER s - 1 AS ret, {guarded('avg(close)', 200, 200)} AS m200 FROM bars JOIN sectors USING (entity) WINDOW s AS (PARTITION BY entity ORDER BY date)),
br AS (SELECT sector, date, avg((g63 > 0 AND close > m200)::INT) AS breadth FROM w WHERE g63 IS NOT NULL AND m200 IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT w.*, sc.sector_close, mk.market_close, breadth, coalesce(sign(ret), 0) * volume AS signed, CASE WHEN ret < 0 THEN ret END AS loss FROM w JOIN (SELECT sector, date, avg(close) AS sector_close FROM w GROUP BY ALL) sc USING (sector, date) JOIN (SELECT date, avg(close) AS market_close FROM w GROUP BY ALL) mk USING (date) LEFT JOIN br USING (sector, date)),
v AS (SELECT *, CASE WHEN count(ret) OVER f63 >= 63 THEN greatest(stddev_samp(ret) OVER f63 * sqrt(252), 0.05) END AS calm, CASE WHEN count(close) OVER f252 >= 252 THEN max(close) OVER f252 END AS hi, CASE WHEN count(close) OVER f252 >= 252 THEN min(close) OVER f252 END AS lo FROM c
  WINDOW f63 AS (PARTITION BY entity ORDER BY date ROWS 62 PRECEDING), f252 AS (PARTITION BY entity ORDER BY date ROWS 251 PRECEDING)),
m AS (SELECT entity, date, row_number() OVER s AS i, ln(close / m200) / calm AS x1, (close - lo) / nullif(hi - lo, 0) AS x2, ln(close / lag(close, 126) OVER s) / calm AS t1, ln(close / lag(close, 252) OVER s) / calm AS t2,
  ln(close / lag(close, 126) OVER s) - ln(sector_close / lag(sector_close, 126) OVER s) AS r1, ln(sector_close / lag(sector_close, 126) OVER s) - ln(market_close / lag(market_close, 126) OVER s) AS r2,
  CASE WHEN count(signed) OVER f63 >= 63 THEN sum(signed) OVER f63 / sum(volume) OVER f63 END AS p1, breadth AS p2, CASE WHEN count(loss) OVER f63 >= 20 THEN round(stddev_samp(loss) OVER f63 * sqrt(252), 12) END AS d1
  FROM v WINDOW s AS (PARTITION BY entity ORDER BY date), f63 AS (PARTITION BY entity ORDER BY date ROWS 62 PRECEDING)),
q AS (SELECT a.entity, a.date, {', '.join(ranked(c) for c in MEASURES)} FROM m a JOIN m b ON a.entity = b.entity AND b.i BETWEEN a.i - 251 AND a.i GROUP BY a.entity, a.date, {', '.join('a.' + c for c in MEASURES)}),
d AS (SELECT entity, date, {median('x')} AS extension, {median('t')} AS trend, {median('r')} AS relative, {median('p')} AS participation, 100 * qd1 AS risk FROM q),
wk AS (SELECT entity, {WEEK} AS week, max(date) AS last_session, {', '.join(f'arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('extension', 'trend', 'relative', 'participation', 'risk'))} FROM d GROUP BY ALL),
panel AS (SELECT *, round((extension + trend + relative + participation) / 4, 9) AS score FROM wk WHERE extension + trend + relative + participation IS NOT NULL)"""
RAW = STATE + f""", dl AS (SELECT *, round(score - lag(score, 4) OVER w, 9) AS delta, {', '.join(f'round({c} - lag({c}, 4) OVER w, 9) AS d_{c}' for c in LB.FAMILIES)}, CASE WHEN count(score) OVER m >= 13 THEN max(score) OVER m END AS peak, CASE WHEN count(score) OVER m >= 13 THEN min(score) OVER m END AS floor
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY week), m AS (PARTITION BY entity ORDER BY week ROWS 12 PRECEDING)),
vt AS (SELECT *, {' + '.join(f'coalesce(d_{c} >= 5, false)::INT' for c in LB.FAMILIES)} AS up, {' + '.join(f'coalesce(d_{c} <= -5, false)::INT' for c in LB.FAMILIES)} AS down FROM dl),
rw AS (SELECT *, CASE WHEN delta IS NULL OR peak IS NULL OR {' OR '.join(f'd_{c} IS NULL' for c in LB.FAMILIES)} THEN 'UNKNOWN' WHEN peak >= 75 AND delta <= -10 AND down >= 3 THEN 'BREAKING' WHEN floor <= 40 AND delta >= 10 AND up >= 3 THEN 'RECOVERING'
  WHEN score >= 60 AND delta <= -5 AND down >= 2 THEN 'COOLING' WHEN score >= 60 AND delta >= 5 AND up >= 2 THEN 'EXTENDING' WHEN score <= 40 AND delta <= -5 AND down >= 2 THEN 'FALLING' WHEN score <= 40 AND abs(delta) < 5 THEN 'STABILIZING' WHEN score >= 60 AND abs(delta) < 5 THEN 'PLATEAU' ELSE 'NEUTRAL' END AS raw FROM vt)"""


def stable_sql(rows: str, cooldown: int = 4) -> str:
    """The stabiliser over rows (entity, i from 1, raw, ...), confirming after two rows, as a recursive CTE `st`."""
    return f"""dr AS (SELECT *, CASE WHEN raw IN ('EXTENDING', 'RECOVERING') THEN 1 WHEN raw IN ('COOLING', 'BREAKING', 'FALLING') THEN -1 END AS way, coalesce(raw = lag(raw) OVER (PARTITION BY entity ORDER BY i), false) AS again FROM {rows}),
st AS (SELECT entity, i, raw, way, again, CASE WHEN way IS NULL THEN raw ELSE 'NEUTRAL' END AS label, false AS suppressed, NULL::INT AS held, NULL::BIGINT AS at FROM dr WHERE i = 1
  UNION ALL SELECT d.entity, d.i, d.raw, d.way, d.again, CASE WHEN d.way IS NULL OR (d.again AND NOT x.blocked) THEN d.raw ELSE 'NEUTRAL' END, x.blocked, CASE WHEN d.way IS NOT NULL AND d.again AND NOT x.blocked THEN d.way ELSE s.held END, CASE WHEN d.way IS NOT NULL AND d.again AND NOT x.blocked THEN d.i ELSE s.at END
  FROM st s JOIN dr d ON d.entity = s.entity AND d.i = s.i + 1, LATERAL (SELECT coalesce(d.way IS NOT NULL AND d.again AND s.held <> d.way AND d.i - s.at <= {cooldown}, false) AS blocked) x)"""


@query(STATE + " SELECT entity, week, last_session, round(extension, 4) AS extension, round(trend, 4) AS trend, round(relative, 4) AS relative, round(participation, 4) AS participation, round(risk, 4) AS risk, round(score, 4) AS score, CASE WHEN score < 15 THEN 'FLEE' WHEN score < 40 THEN 'SCATTER' WHEN score < 60 THEN 'CALM' WHEN score < 75 THEN 'DRIFT' ELSE 'RUSH' END AS stage FROM panel")
def w10_state_panel(spark, sf):
    return state(spark, sf).select("entity", "week", "last_session", *(r(c, 4) for c in (*LB.FAMILIES, "risk", "score")), "stage")


@query(RAW + " SELECT entity, week, raw, up, down, round(delta, 4) AS delta FROM rw")
def w16_transition_raw(spark, sf):
    return LB.transition_raw(state(spark, sf)).select("entity", "week", "raw", "up", "down", r("delta", 4))


@query(RAW + ", nr AS (SELECT entity, week, raw, row_number() OVER (PARTITION BY entity ORDER BY week) AS i FROM rw), " + stable_sql("nr") + """
SELECT st.entity, week, st.raw, label, suppressed, label IN ('COOLING', 'BREAKING', 'RECOVERING') AND label IS DISTINCT FROM lag(label) OVER (PARTITION BY st.entity ORDER BY st.i) AS event FROM st JOIN nr ON nr.entity = st.entity AND nr.i = st.i""")
def w17_stabilize_labels(spark, sf):
    return LB.stabilize_labels(LB.transition_raw(state(spark, sf)))


@query(CTES + f""", g AS (SELECT e.entity, c.date, b.close, coalesce(b.volume, 0)::DOUBLE AS volume FROM (SELECT DISTINCT entity FROM bars) e, (SELECT DISTINCT date FROM bars) c LEFT JOIN bars b ON b.entity = e.entity AND b.date = c.date),
h AS (SELECT entity, date, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS 3 PRECEDING) AS close FROM g),
i AS (SELECT *, close / lag(close) OVER w - 1 AS move, close / lag(close, 63) OVER w - 1 AS r63, {guarded('avg(close)', 200, 200)} AS m200, {guarded('max(close)', 252, 126)} AS top, {guarded('avg(volume)', 20, 20)} / nullif({guarded('avg(volume)', 120, 120)}, 0) AS vr FROM h WINDOW w AS (PARTITION BY entity ORDER BY date)),
d AS (SELECT entity, date, close, coalesce((close > m200)::INT, 0) + coalesce((r63 > 0)::INT, 0) AS votes, vr * CASE WHEN move <> 0 THEN sign(move) END AS confirmed, close / m200 - 1 AS own_trend, CASE WHEN move < 0 THEN move ELSE 0 END AS fall, close / top - 1 AS drawdown FROM i),
f AS (SELECT *, {guarded('stddev_samp(fall)', 63, 40)} AS downside FROM d),
mk AS (SELECT last_day(date) AS month, arg_max(breadth, date) AS breadth FROM (SELECT date, 50 * avg(votes) AS breadth FROM d GROUP BY date) GROUP BY ALL),
mo AS (SELECT entity, last_day(date) AS month, {', '.join(f'arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('close', 'own_trend', 'downside', 'drawdown'))}, avg(confirmed) AS confirmed FROM f GROUP BY ALL),
mm AS (SELECT a.*, b.close / c.close - 1 AS momentum FROM mo a LEFT JOIN mo b ON b.entity = a.entity AND b.month = last_day(a.month - INTERVAL 1 MONTH) LEFT JOIN mo c ON c.entity = a.entity AND c.month = last_day(a.month - INTERVAL 12 MONTH)),
k AS (SELECT entity, month, own_trend, drawdown, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN 100 * (rank() OVER (PARTITION BY month ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY month, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY month) END AS {c}' for c in ('confirmed', 'momentum', 'downside'))} FROM mm)
SELECT entity, month, round(CASE WHEN confirmed IS NOT NULL THEN least(100, greatest(0, 0.4 * confirmed + 0.6 * breadth)) END, 5) AS participation, round(0.5 * momentum + 0.5 * CASE WHEN own_trend IS NOT NULL THEN least(100, greatest(0, 50 + 250 * own_trend)) END, 5) AS trend_relative_strength, round(0.5 * (100 - downside) + 0.5 * CASE WHEN drawdown IS NOT NULL THEN least(100, greatest(0, 100 + 250 * drawdown)) END, 5) AS risk FROM k JOIN mk USING (month)""")
def w14_evidence_scores(spark, sf):
    return LB.evidence_scores(bars(spark, sf)).select("entity", "month", r("participation", 5), r("trend_relative_strength", 5), r("risk", 5))


@query(CTES + f""", b AS (SELECT 'market' AS entity, date, avg(close) AS close FROM bars GROUP BY date), x AS (SELECT *, row_number() OVER (ORDER BY date) AS i, close / lag(close) OVER (ORDER BY date) - 1 AS ret, close / {guarded('max(close)', 63, 63)} - 1 AS drawdown FROM b),
v AS (SELECT *, {guarded('stddev_samp(ret)', 63, 63)} * sqrt(252) AS vol FROM x), p AS (SELECT a.date, count(b.vol) AS n, avg((b.vol <= a.vol)::INT) AS pct FROM v a JOIN v b ON b.i < a.i AND b.vol IS NOT NULL WHERE a.vol IS NOT NULL GROUP BY a.date)
SELECT v.date, CASE WHEN n >= 252 THEN round(pct, 6) END AS volatility_percentile, round(drawdown, 6) AS drawdown, coalesce(close / lag(close, 21) OVER (ORDER BY v.date) - 1 > 0 AND lag(drawdown, 21) OVER (ORDER BY v.date) <= -0.10, false) AS rebound, round(close / lag(close, 63) OVER (ORDER BY v.date) - 1, 6) AS "return" FROM v LEFT JOIN p ON p.date = v.date""".replace('"return"', "gain"))
def w30_market_context(spark, sf):
    bench = bars(spark, sf).groupBy("date").agg(F.avg("close").alias("close"))
    return LB.market_context(bench, least=252).select("date", r("volatility_percentile"), r("drawdown"), "rebound", F.round("return", 6).alias("gain"))


@query(CTES + f""", t AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
d AS (SELECT entity, date, close / lag(close, 21) OVER w - 1 AS r21, close / lag(close, 63) OVER w - 1 AS r63, close / lag(close, 252) OVER w - 1 AS r252, close / {guarded('max(close)', 21, 21)} - 1 AS fall, (close - {guarded('avg(close)', 200, 200)}) / {guarded('avg(tr)', 63, 40)} AS reach FROM t WINDOW w AS (PARTITION BY entity ORDER BY date)),
m AS (SELECT entity, last_day(date) AS month, {', '.join(f'arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in ('r21', 'r63', 'r252', 'fall', 'reach'))} FROM d GROUP BY ALL), b AS (SELECT date, c / lag(c, 21) OVER (ORDER BY date) - 1 AS m21 FROM (SELECT date, avg(close) AS c FROM bars GROUP BY date)), bm AS (SELECT last_day(date) AS month, arg_max(m21, date) FILTER (WHERE m21 IS NOT NULL) AS m21 FROM b GROUP BY ALL)
SELECT entity, month, coalesce(r252 > 0 AND fall BETWEEN -0.20 AND -0.05 AND r21 > 0 AND lag(r21) OVER w <= 0, false) AS resumption, coalesce(fall BETWEEN -0.25 AND -0.08 AND m21 < 0 AND r21 - m21 > -0.10, false) AS dislocation, coalesce(reach >= 3, false) AS extended, coalesce(r63 - r252 / 4 < 0 AND lag(r63 - r252 / 4) OVER w >= 0, false) AS decelerated FROM m LEFT JOIN bm USING (month) WINDOW w AS (PARTITION BY entity ORDER BY month)""")
def w37_event_flags(spark, sf):
    b = bars(spark, sf)
    return LB.event_flags(b, b.groupBy("date").agg(F.avg("close").alias("close")))


@query(CTES + """, x AS (SELECT entity, sector, date, close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1 AS y FROM bars JOIN sectors USING (entity)), y AS (SELECT *, avg(y) OVER (PARTITION BY date) AS a, avg(y) OVER (PARTITION BY date, sector) - avg(y) OVER (PARTITION BY date) AS b FROM x WHERE y IS NOT NULL),
mo AS (SELECT *, count(*) OVER w AS n, covar_pop(a, a) OVER w AS saa, covar_pop(b, b) OVER w AS sbb, covar_pop(a, b) OVER w AS sab, covar_pop(a, y) OVER w AS say, covar_pop(b, y) OVER w AS sby, avg(a) OVER w AS ma, avg(b) OVER w AS mb, avg(y) OVER w AS my FROM y WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
be AS (SELECT *, CASE WHEN n >= 60 AND abs(saa * sbb - sab * sab) > 1e-18 THEN (say * sbb - sby * sab) / (saa * sbb - sab * sab) END AS beta, CASE WHEN n >= 60 AND abs(saa * sbb - sab * sab) > 1e-18 THEN (sby * saa - say * sab) / (saa * sbb - sab * sab) END AS gamma FROM mo),
re AS (SELECT *, y - (my + beta * (a - ma) + gamma * (b - mb)) AS residual FROM be)
SELECT entity, date, round(beta, 3) AS beta, round(gamma, 3) AS gamma, round(residual, 4) AS residual, round(beta * a, 4) AS market_part, round(gamma * b, 4) AS sector_part, CASE WHEN count(residual) OVER f >= 21 THEN round(sum(residual) OVER f, 3) END AS residual_sum, CASE WHEN count(residual) OVER f >= 21 THEN round(stddev_samp(residual) OVER f / nullif(stddev_samp(y) OVER f, 0), 3) END AS volatility_ratio FROM re WINDOW f AS (PARTITION BY entity ORDER BY date ROWS 20 PRECEDING)""")
def w28_factor_residuals(spark, sf):
    b = bars(spark, sf).join(sectors(spark, sf), "entity").withColumn("ret", W.change("close", 1)).where("ret is not null")
    market = F.avg("ret").over(Window.partitionBy("date"))
    context = b.select("entity", "date", market.alias("market"), (F.avg("ret").over(Window.partitionBy("date", "sector")) - market).alias("sector_excess"))
    return LB.factor_residuals(bars(spark, sf), context, 60).select("entity", "date", r("beta", 3), r("gamma", 3), r("residual", 4), r("market_part", 4), r("sector_part", 4), r("residual_sum", 3), r("volatility_ratio", 3))


@query(CTES.replace("WITH", "WITH RECURSIVE", 1) + f""", wk AS (SELECT entity, {WEEK} AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL), {rsi_sql('wk')},
rs AS (SELECT entity, date, rsi, lag(rsi) OVER w AS y, lag(rsi, 2) OVER w AS z, row_number() OVER w AS i FROM rsi WHERE rsi IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY date)),
ep AS (SELECT entity, i, date, NULL::INT AS level, 0::BIGINT AS since, false AS p, false AS q, 0 AS episode, NULL::VARCHAR[] AS events FROM rs WHERE i = 1
  UNION ALL SELECT r.entity, r.i, r.date, CASE WHEN e.level IS NULL THEN CASE WHEN enters THEN 55 END WHEN cools THEN NULL ELSE now END, CASE WHEN e.level IS NULL AND enters THEN r.i ELSE e.since END, e.level IS NOT NULL AND (e.p OR lasts), e.level IS NOT NULL AND (e.q OR slows), e.episode + (e.level IS NULL AND enters)::INT,
    CASE WHEN e.level IS NULL THEN CASE WHEN enters THEN ['ENTRY'] END ELSE list_filter([CASE WHEN rises THEN 'ESCALATION' END, CASE WHEN lasts AND NOT e.p THEN 'PERSISTENCE' END, CASE WHEN slows AND NOT e.q THEN 'DECELERATION' END, CASE WHEN cools THEN 'COOLING' END], lambda v: v IS NOT NULL) END
  FROM ep e JOIN rs r ON r.entity = e.entity AND r.i = e.i + 1, LATERAL (SELECT r.y < 55 AND r.rsi >= 55 AS enters, e.level < 60 AND r.y < 60 AND r.rsi >= 60 AS rises, r.y >= 48 AND r.rsi < 48 AS cools, coalesce(r.rsi < r.y AND r.y < r.z, false) AS slows) t, LATERAL (SELECT CASE WHEN t.rises THEN 60 ELSE e.level END AS now) u, LATERAL (SELECT r.i - e.since + 1 >= 4 AND r.rsi >= u.now AS lasts) v)
SELECT entity, date, unnest(events) AS event, episode FROM ep WHERE events IS NOT NULL""")
def w24_rsi_events(spark, sf):
    weekly = B.weekly_bars(bars(spark, sf)).select("entity", F.col("week").alias("date"), "close")
    return LB.rsi_events(W.wilder_rsi(weekly, "close", 14), 55, 60, 48).withColumn("episode", F.col("episode").cast("int"))


@query(CTES.replace("WITH", "WITH RECURSIVE", 1) + f""", vt AS (SELECT entity, date, row_number() OVER w AS i, coalesce((close / lag(close, 5) OVER w - 1 > 0)::INT + (close / lag(close, 21) OVER w - 1 > 0)::INT + (volume / lag(volume, 5) OVER w - 1 > 0)::INT + (close > {guarded('avg(close)', 20, 5)})::INT, 0) AS votes FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date)),
en AS (SELECT entity, max(i) AS last FROM vt GROUP BY entity),
ep AS (SELECT entity, i, date, CASE WHEN votes >= 3 THEN date END AS start, 0 AS calm, NULL::DATE AS done FROM vt WHERE i = 1
  UNION ALL SELECT v.entity, v.i, v.date, CASE WHEN e.start IS NULL OR e.done IS NOT NULL THEN CASE WHEN v.votes >= 3 THEN v.date END ELSE e.start END, CASE WHEN e.start IS NULL OR e.done IS NOT NULL OR v.votes > 1 THEN 0 ELSE e.calm + 1 END, CASE WHEN e.start IS NOT NULL AND e.done IS NULL AND v.votes <= 1 AND e.calm = 1 THEN v.date END
  FROM ep e JOIN vt v ON v.entity = e.entity AND v.i = e.i + 1)
SELECT entity, start, date AS end, done IS NOT NULL AS closed FROM ep JOIN en USING (entity) WHERE start IS NOT NULL AND (done IS NOT NULL OR i = last)""".replace("date AS end", 'date AS "end"'))
def w25_vote_episodes(spark, sf):
    b = bars(spark, sf)
    votes = (W.change("close", 5) > 0).cast("int") + (W.change("close", 21) > 0).cast("int") + (W.change("volume", 5) > 0).cast("int") + (F.col("close") > W.rolling("close", 20, 5, "mean")).cast("int")
    return LB.vote_episodes(b.select("entity", "date", F.coalesce(votes, F.lit(0)).alias("votes")), 3, 1, 2)


@query(CTES + f""", wk AS (SELECT entity, {WEEK} AS week, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY ALL), d AS (SELECT entity, week, volume - lag(volume, 4) OVER (PARTITION BY entity ORDER BY week) AS volume_delta FROM wk)
SELECT entity, week, volume_delta FROM d WHERE day(week) <= 7""")
def w34_feature_deltas(spark, sf):
    weekly = B.weekly_bars(bars(spark, sf)).select("entity", "week", "close", "volume")
    return LB.feature_deltas(weekly.where(F.day("week") <= 7).select("entity", "week"), weekly, ["volume"], 4)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'SNAPSHOT' WHEN left(o_orderpriority, 1) = '1' THEN 'REPLACE' WHEN left(o_orderpriority, 1) = '2' THEN 'ADD' ELSE 'EXCLUDE' END AS operation FROM orders")
def p11_amendment_operation(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    o = orders(spark, sf).withColumn("kind", F.when(p == "1", "Restatement").when(p == "2", "New Holdings").otherwise("?")).withColumn("amended", F.col("o_orderkey") % 3 == 0)
    return o.select("o_orderkey", T.amendment_operation("kind", "amended").alias("operation"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'ENGAGE' WHEN 'purchase' THEN 'BUY' ELSE 'UNMAPPED' END AS \"group\" FROM events".replace('"group"', "economic"))
def p12_classify_transactions(spark, sf):
    return T.classify_transactions(table(spark, sf, "events"), "event_type", {"click": "ENGAGE", "purchase": "BUY"}).select("event_id", F.col("group").alias("economic"))


@query("""WITH m AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), 'http[a-z]*'))) AS link_markers, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9.]+@[a-z0-9.]+'))) AS mail_markers FROM documents)
SELECT doc_id, link_markers, mail_markers, CASE WHEN len(link_markers) > 0 THEN 'link' WHEN len(mail_markers) > 0 THEN 'mail' ELSE 'OTHER' END AS label FROM m""")
def p13_classify_text(spark, sf):
    return T.classify_text(table(spark, sf, "documents"), "text", {"link": "http[a-z]*", "mail": "[a-z0-9.]+@[a-z0-9.]+"}).select("doc_id", "link_markers", "mail_markers", "label")


@query("""WITH x AS (SELECT o_orderkey, unnest(list_distinct(CASE WHEN o_orderkey % 2 = 0 THEN ['results'] ELSE [] END || CASE WHEN o_orderkey % 3 = 0 THEN ['guidance'] ELSE [] END)) AS kind FROM orders) SELECT o_orderkey, kind FROM x""")
def p14_item_events(spark, sf):
    items = F.concat_ws(", ", F.when(F.col("o_orderkey") % 2 == 0, "2.02"), F.when(F.col("o_orderkey") % 3 == 0, "7.01"), F.lit("9.01"))
    return T.item_events(orders(spark, sf).withColumn("items", items), "items", {"2.02": "results", "7.01": "guidance"}).select("o_orderkey", "kind")


@query("SELECT p_partkey, unnest(list_distinct(['A' || (p_partkey % 5)::VARCHAR, 'B' || (p_size % 3)::VARCHAR])) AS symbol FROM part")
def p10_explode_classes(spark, sf):
    cell = F.concat(F.lit("A"), (F.col("p_partkey") % 5).cast("string"), F.lit("/B"), (F.col("p_size") % 3).cast("string"))
    return T.explode_classes(table(spark, sf, "part").select("p_partkey", cell.alias("symbol")), "symbol", ["p_partkey"])


PLANTED = """CASE doc_id % 5
  WHEN 0 THEN 'For Q' || (n_chars % 4 + 1)::VARCHAR || ' 2024 we expect revenue of $1,' || (n_chars % 900 + 100)::VARCHAR || ' million to $2,' || (n_chars % 800 + 100)::VARCHAR || ' million. '
  WHEN 1 THEN 'For FY 2026, the company expects adjusted EPS in the range of (' || (n_chars % 50)::VARCHAR || '.20) to (' || (n_chars % 70)::VARCHAR || '.10) per share. '
  WHEN 2 THEN 'Third quarter of 2025 outlook: net sales ' || (n_chars % 97)::VARCHAR || ' to ' || (n_chars % 89)::VARCHAR || ' thousand; gross margin ' || (n_chars % 31)::VARCHAR || '% - ' || (n_chars % 37)::VARCHAR || '%. '
  WHEN 3 THEN '2024 fiscal year forecast of capex between ' || (n_chars % 13)::VARCHAR || ' and ' || (n_chars % 17)::VARCHAR || ' billion, GAAP. ' ELSE '' END || coalesce(text, '')"""


def ranges_sql() -> str:
    """The rule of ranges by joins of all spans of a text."""
    kinds = {"range": rf"{S.NUMBER}{S._GAP}(?:{S.SCALE})?{S._GAP}(?:{S.JOINT}){S._GAP}{S.NUMBER}(?:{S._GAP}(?:{S.SCALE}))?", "cue": S.GUIDANCE, "period": S.PERIOD, **{f"metric {m}": p for m, (p, _) in S.METRICS.items()}, **S.FLAGS}
    marked = " UNION ALL ".join(f"SELECT key, '{k}' AS kind, string_split(regexp_replace(t, '(?i)(?:{p})', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM d" for k, p in kinds.items())
    shape = rf"(?i)^({S.NUMBER}){S._GAP}({S.SCALE})?{S._GAP}(?:{S.JOINT}){S._GAP}({S.NUMBER})(?:{S._GAP}({S.SCALE}))?$"
    unit = " ".join(f"WHEN '{m}' THEN '{u}'" for m, (_, u) in S.METRICS.items())
    year, quarter = "regexp_extract(lower(value), '20[0-9]{2}')", "regexp_extract(lower(value), '^q([1-4])', 1)"
    named = " ".join(f"WHEN lower(value) LIKE '{w}%' THEN 'Q{i}-' || {year}" for i, w in enumerate(S.QUARTERS, 1))
    number = lambda g: f"(CASE WHEN {g} LIKE '%-%' OR ({g} LIKE '(%' AND {g} LIKE '%)') THEN -1 ELSE 1 END * regexp_replace({g}, '[^0-9.]', '', 'g')::DOUBLE)"
    scaled = lambda own, other: f"coalesce(nullif({own}, ''), {other})"
    factor = lambda s: f"(CASE WHEN unit = 'USD_PER_SHARE' THEN CASE WHEN {s} = 'cents' THEN 0.01 ELSE 1 END WHEN unit = 'PERCENT' THEN 1 ELSE CASE {s} WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 END END)"
    has = lambda f: f"EXISTS (SELECT 1 FROM s f WHERE f.key = q.key AND f.kind = '{f}' AND f.start >= least(q.start, q.m_start) - 220 AND f.stop <= greatest(q.stop, q.m_stop) + 220)"
    return f"""WITH d AS (SELECT doc_id AS key, {PLANTED} AS t FROM documents), k AS ({marked}), i AS (SELECT key, kind, parts, unnest(range(2, len(parts) + 1, 2)) AS i FROM k WHERE len(parts) > 1),
    s AS (SELECT key, kind, parts[i] AS value, length(array_to_string(parts[1:i - 1], '')) AS start, length(array_to_string(parts[1:i], '')) AS stop, (start + stop) // 2 AS mid, CASE {named} WHEN {quarter} <> '' THEN 'Q' || {quarter} || '-' || {year} ELSE 'FY' || {year} END AS period FROM i),
    m AS (SELECT r.*, kind_m AS metric, m_start, m_stop FROM (SELECT * FROM s WHERE kind = 'range') r JOIN (SELECT key, kind[8:] AS kind_m, start AS m_start, stop AS m_stop, mid AS m_mid FROM s WHERE kind LIKE 'metric %') m ON r.key = m.key AND abs(m_mid - r.mid) <= 120 QUALIFY row_number() OVER (PARTITION BY r.key, r.start ORDER BY abs(m_mid - r.mid), kind_m, m_start, m_stop) = 1),
    p AS (SELECT m.* EXCLUDE (period), p.period FROM m JOIN s p ON p.key = m.key AND p.kind = 'period' AND abs(p.mid - m.mid) <= 350 QUALIFY row_number() OVER (PARTITION BY m.key, m.start ORDER BY abs(p.mid - m.mid), p.period) = 1),
    q AS (SELECT *, CASE metric {unit} END AS unit, lower(regexp_extract(value, '{shape}', 1)) AS a, lower(regexp_extract(value, '{shape}', 2)) AS sa, lower(regexp_extract(value, '{shape}', 3)) AS b, lower(regexp_extract(value, '{shape}', 4)) AS sb FROM p WHERE EXISTS (SELECT 1 FROM s c WHERE c.key = p.key AND c.kind = 'cue' AND abs(c.mid - p.mid) <= 500)),
    f AS (SELECT *, {number("a")} AS x, {number("b")} AS y, {scaled("sa", "sb")} AS fa, {scaled("sb", "sa")} AS fb, {has("non_gaap")} AS non_gaap, {has("gaap")} AS gaap, {has("money")} AS money, {has("percent")} AS pct FROM q),
    v AS (SELECT *, x * {factor("fa")} AS v1, y * {factor("fb")} AS v2 FROM f WHERE CASE unit WHEN 'USD_PER_SHARE' THEN greatest(abs(x), abs(y)) <= 100 AND money WHEN 'PERCENT' THEN fb LIKE 'percent%' OR pct ELSE true END)
    SELECT DISTINCT key, metric, period, CASE WHEN non_gaap THEN 'NON_GAAP' WHEN gaap THEN 'GAAP' ELSE 'UNSPECIFIED' END AS basis, unit, least(v1, v2) AS low, greatest(v1, v2) AS high FROM v WHERE v1 IS NOT NULL AND v2 IS NOT NULL"""


@query(ranges_sql())
def p15_extract_ranges(spark, sf):
    """Whole texts as they are, most behind a planted sentence of guidance."""
    docs = table(spark, sf, "documents").select("doc_id", F.expr(re.sub(r"::VARCHAR", "", PLANTED)).alias("text"))
    return S.extract_ranges(docs, "doc_id", "text")


TOPICS = {"THE": ["the", "the in", "that"], "DER": ["der", "der die", "die"], "LES": ["les", "el"]}
CUES = {"AND": ["and", "and the", "und"], "IN": ["in", "in the", "en"], "OF": ["of"]}
COMPARED, NEGATIONS = ["as", "is", "mit"], ["on", "his", "zu", "de"]


def facts_sql() -> str:
    listed = [(p, k, n) for k, group in (("topic", TOPICS), ("cue", CUES), ("comparison", {"": COMPARED})) for n, ps in group.items() for p in ps]
    fold = "translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    negations = ", ".join(f"'{w}'" for w in NEGATIONS)
    return rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f]+', ' ', 'g'), ' '), '([.!?]) ([\"''“‘(]*(?:[A-Z][A-Za-z]|[0-9]{{4}}\b))', '\1' || chr(2) || '\2', 'g'), chr(2)) AS parts FROM documents),
    s AS (SELECT doc_id, unnest(parts) AS sentence, (generate_subscripts(parts, 1) - 1)::INT AS n FROM c),
    k AS (SELECT *, {fold} AS low FROM s WHERE length(sentence) BETWEEN 20 AND 400 AND length(regexp_replace(sentence, '[^0-9]', '', 'g')) <= 0.3 * length(replace(sentence, ' ', '')) AND len(regexp_extract_all(sentence, '[A-Za-z][A-Za-z''-]*')) >= 4 AND NOT contains({fold}, 'license') AND NOT contains({fold}, 'all rights')),
    m AS (SELECT doc_id, n, low, string_split(regexp_replace(low, '[a-z]+|[^a-z -]', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS parts FROM k), i AS (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM m),
    t AS (SELECT doc_id, n, low, i // 2 AS i, parts[i] AS value, length(array_to_string(parts[1:i - 1], '')) AS start, length(array_to_string(parts[1:i], '')) AS stop FROM i),
    r AS (SELECT doc_id, n, low, start, unnest([stop, lead(stop) OVER w]) AS stop, unnest([value, value || ' ' || lead(value) OVER w]) AS phrase FROM t WINDOW w AS (PARTITION BY doc_id, n ORDER BY i)),
    p(phrase, kind, name) AS (VALUES {", ".join(str(x) for x in listed)}),
    h AS (SELECT r.*, kind, name, coalesce(list_has_any((regexp_extract_all(left(low, start), '[a-z'']+'))[-3:], [{negations}]), false) AS negated FROM r JOIN p USING (phrase) WHERE stop IS NOT NULL),
    w AS (SELECT doc_id, n, name AS topic, list_sort(list(DISTINCT phrase)) AS topic_phrases FROM h WHERE kind = 'topic' GROUP BY ALL)
    SELECT w.*, list_sort(list(DISTINCT c.name)) AS families, list_sort(list(DISTINCT c.phrase)) AS cue_phrases, bool_or(c.negated) AS negated, EXISTS (SELECT 1 FROM h x WHERE x.doc_id = w.doc_id AND x.n = w.n AND x.kind = 'comparison') AS compared
    FROM w JOIN h c ON c.doc_id = w.doc_id AND c.n = w.n AND c.kind = 'cue' AND EXISTS (SELECT 1 FROM h t WHERE t.doc_id = w.doc_id AND t.n = w.n AND t.kind = 'topic' AND t.name = w.topic AND greatest(t.start - c.stop, c.start - t.stop, 0) <= 30) GROUP BY ALL"""


@query(facts_sql())
def p16_sentence_facts(spark, sf):
    return S.sentence_facts(table(spark, sf, "documents"), "doc_id", "text", TOPICS, CUES, COMPARED, NEGATIONS, lookback=3, within=30, most=400, boilerplate=["license", "all rights"])


@query(r"""WITH t AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS site, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script>|<style\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM pages)
SELECT site, sum(length(t))::BIGINT + count(*) - 1 AS chars, bool_or(regexp_matches(lower(t), '[0-9]{3}')) AS has_number, bool_or(regexp_matches(lower(t), 'nicht')) AS has_ad FROM t GROUP BY site""")
def p19_text_signals(spark, sf):
    pages = table(spark, sf, "pages").withColumn("site", F.regexp_extract("url", "//([^/]+)", 1))
    return T.text_signals(pages, "site", "html", {"has_number": "[0-9]{3}", "has_ad": "nicht"})
