"""Queries of event paths and composite measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import measures as M
from ..operators import paths as P
from ..operators import windows as W
from ..sources.testdata import CTES, bars, sectors
from .panel import WEEK, guarded, r, rsi_sql
from .registry import query

#: Events: bars on which the close is the highest of 63 rows, numbered by entity and date.
EVENTS = """, nb AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i, count(*) OVER (PARTITION BY entity) AS len FROM bars),
ev AS (SELECT entity || '|' || date::VARCHAR AS id, entity, date, i, len, close AS base FROM (SELECT *, max(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS before FROM nb) WHERE close > before)"""


def numbered(spark, sf):
    return bars(spark, sf).withColumn("i", F.row_number().over(W.series()))


def path_events(b):
    before = F.max("close").over(W.series().rowsBetween(-63, -1))
    return b.withColumn("before", before).where("close > before").select(F.concat_ws("|", "entity", F.col("date").cast("string")).alias("id"), "entity", "date")


def context(spark, sf):
    own = bars(spark, sf).join(sectors(spark, sf), "entity")
    sector = own.groupBy("sector", "date").agg(F.avg("close").alias("sector_close"))
    market = own.groupBy("date").agg(F.avg("close").alias("market_close"))
    return own.select("entity", "sector", "date").join(sector, ["sector", "date"]).join(market, "date")


CONTEXT = """, cx AS (SELECT entity, sector, date, sector_close, market_close FROM bars JOIN sectors USING (entity) JOIN (SELECT sector, date, avg(close) AS sector_close FROM bars JOIN sectors USING (entity) GROUP BY ALL) USING (sector, date) JOIN (SELECT date, avg(close) AS market_close FROM bars GROUP BY ALL) USING (date))"""

COMPETING = """, vo AS (SELECT entity, date, CASE WHEN count(ret) OVER w >= 63 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM (SELECT entity, date, close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret FROM bars) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 62 PRECEDING)),
ke AS (SELECT ev.*, greatest(0.05, 1.5 * vol * sqrt(21 / 252)) AS pb, greatest(0.08, 1.5 * vol * sqrt(63 / 252)) AS up, greatest(0.15, 2.5 * vol * sqrt(63 / 252)) AS st, len - i < 126 AS censored FROM ev JOIN vo USING (entity, date) WHERE vol > 0),
pa AS (SELECT ke.id, b.date AS d, b.i - ke.i AS k, b.close / base - 1 AS rel, pb, up FROM ke JOIN nb b ON b.entity = ke.entity AND b.i BETWEEN ke.i + 1 AND ke.i + 126 WHERE NOT censored),
la AS (SELECT *, max(rel) OVER (PARTITION BY id ORDER BY k DESC) AS later FROM pa),
ag AS (SELECT id, min(d) FILTER (WHERE rel <= -pb) AS down, min(d) FILTER (WHERE rel >= up) AS rise, min(rel) AS mae, max(rel) AS mfe, arg_max(rel, k) AS terminal, max(d) AS outcome_end, arg_min(later, (rel, k)) AS after_low FROM la GROUP BY id),
co AS (SELECT ke.id, entity, date, CASE WHEN censored THEN 'RIGHT_CENSORED' WHEN rise IS NOT NULL AND (down IS NULL OR rise < down) THEN 'UPSIDE_CONTINUATION' WHEN down IS NOT NULL THEN 'DOWNSIDE_PULLBACK' ELSE 'NO_BOUNDARY' END AS first_boundary,
  CASE WHEN rise IS NOT NULL AND (down IS NULL OR rise < down) THEN rise ELSE down END AS boundary_date,
  CASE WHEN censored THEN 'RIGHT_CENSORED' WHEN mae <= -st AND terminal <= -0.10 THEN 'STRUCTURAL_BREAK' WHEN mae <= -greatest(0.10, pb) THEN 'LARGE_PULLBACK' WHEN mae <= -pb AND after_low >= -0.02 THEN 'TRADABLE_PULLBACK' WHEN rise IS NOT NULL AND (down IS NULL OR rise < down) AND terminal > 0 THEN 'CONTINUATION' ELSE 'UNRESOLVED' END AS terminal_path,
  mfe, mae, terminal, outcome_end FROM ke LEFT JOIN ag USING (id))"""


@query(CTES + EVENTS + COMPETING + " SELECT id, entity, date, first_boundary, boundary_date, terminal_path, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(terminal, 6) AS terminal, outcome_end FROM co")
def f4_label_competing(spark, sf):
    b = numbered(spark, sf)
    return P.label_competing(path_events(b), b).select("id", "entity", "date", "first_boundary", "boundary_date", "terminal_path", r("mfe"), r("mae"), r("terminal"), "outcome_end")


@query(CTES + f""", wk AS (SELECT entity, {WEEK} AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL), nw AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity) AS len, close > max(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS hit FROM wk WINDOW w AS (PARTITION BY entity ORDER BY date)),
pa AS (SELECT e.entity || '|' || e.date::VARCHAR AS id, b.i - e.i AS k, b.close / e.close - 1 AS rel, b.close / greatest(e.close, max(b.close) OVER (PARTITION BY e.entity, e.date ORDER BY b.i)) - 1 AS drop FROM nw e JOIN nw b ON b.entity = e.entity AND b.i BETWEEN e.i + 1 AND e.i + 26 WHERE e.hit AND e.len - e.i >= 26)
SELECT id, h::INT AS horizon, round(arg_max(rel, k), 6) AS forward_return, round(max(rel), 6) AS advance, round(min(rel), 6) AS decline, round(min("drop"), 6) AS drawdown, count(*) FILTER (WHERE rel < 0) AS weeks_below, min(rel) <= -0.02 AS fell_2, min(rel) <= -0.05 AS fell_5, min(rel) <= -0.1 AS fell_10
FROM pa, (SELECT unnest([4, 8, 13, 26]) AS h) WHERE k <= h GROUP BY id, h""".replace("AS drop FROM", 'AS "drop" FROM'))
def f6_weekly_path(spark, sf):
    weekly = B.weekly_bars(bars(spark, sf)).select("entity", F.col("week").alias("date"), "close")
    hit = weekly.withColumn("before", F.max("close").over(W.series().rowsBetween(-13, -1))).where("close > before")
    events = hit.select(F.concat_ws("|", "entity", F.col("date").cast("string")).alias("id"), "entity", "date")
    return P.weekly_path(events, weekly).select("id", "horizon", r("forward_return"), r("advance"), r("decline"), r("drawdown"), "weeks_below", "fell_2", "fell_5", "fell_10")


CEILING = """, sa AS (SELECT ev.id, s.open AS sale, ev.i FROM ev JOIN nb s ON s.entity = ev.entity AND s.i = ev.i + 1 WHERE ev.len - ev.i >= 64),
op AS (SELECT sa.id, b.i - sa.i - 1 AS wait, sale * (1 - 0.001) * (1 - 0.001) / (b.open * (1 + 0.001) * (1 + 0.001)) - 1 AS gain, max(b.open / sale - 1) OVER (PARTITION BY sa.id ORDER BY b.i) AS advance FROM sa JOIN ev USING (id) JOIN nb b ON b.entity = ev.entity AND b.i BETWEEN sa.i + 2 AND sa.i + 64),
rn AS (SELECT *, count(*) OVER w = 3 AND min(gain) OVER w >= 0.02 AND advance <= 0.5 AS start FROM op WINDOW w AS (PARTITION BY id ORDER BY wait ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
ce AS (SELECT id, max((gain, -wait)) AS best, max((gain, -wait)) FILTER (WHERE start) AS bound, count(*) FILTER (WHERE gain >= 0.02) AS days FROM rn GROUP BY id)"""


def ceiling(b):
    return P.reentry_ceiling(path_events(b), b, 63, 0.001, 0.001, 0.02, 3, 0.5)


@query(CTES + EVENTS + CEILING + " SELECT id, best[1] > 0 AS available, round(greatest(best[1], 0), 6) AS gain, -best[2] AS wait, bound IS NOT NULL AS bound_available, round(coalesce(bound[1], 0), 6) AS bound_gain, -bound[2] AS bound_wait, days FROM ce")
def f10_reentry_ceiling(spark, sf):
    return ceiling(numbered(spark, sf)).select("id", "available", r("gain"), "wait", "bound_available", r("bound_gain"), "bound_wait", "days")


@query(CTES + EVENTS + CONTEXT + """, fl AS (SELECT nb.entity, nb.date, nb.i, close < min(close) OVER (PARTITION BY nb.entity ORDER BY nb.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND close < CASE WHEN count(close) OVER m >= 50 THEN avg(close) OVER m END AND close / lag(close, 21) OVER s < market_close / lag(market_close, 21) OVER s AND close / lag(close, 21) OVER s < sector_close / lag(sector_close, 21) OVER s AND lead(close) OVER s IS NOT NULL AS hit
  FROM nb JOIN cx ON cx.entity = nb.entity AND cx.date = nb.date WINDOW s AS (PARTITION BY nb.entity ORDER BY nb.date), m AS (PARTITION BY nb.entity ORDER BY nb.date ROWS 49 PRECEDING))
SELECT ev.id, min(fl.date) AS damage_date, min(fl.i) - ev.i AS wait FROM ev LEFT JOIN fl ON fl.entity = ev.entity AND fl.i BETWEEN ev.i + 1 AND ev.i + 40 AND hit AND ev.i > 50 GROUP BY ev.id, ev.i""")
def f11_first_damage(spark, sf):
    b = numbered(spark, sf)
    return P.first_damage(path_events(b), b, context(spark, sf), 20, 50, 21, 40)


@query(CTES + EVENTS + COMPETING + CEILING + """ SELECT id, CASE WHEN terminal_path = 'STRUCTURAL_BREAK' THEN 'STRUCTURAL_DAMAGE' WHEN bound IS NOT NULL THEN 'ECONOMIC_REBUY_OPPORTUNITY' WHEN terminal_path = 'CONTINUATION' THEN 'HEALTHY_CONTINUATION' ELSE 'NO_ECONOMIC_EDGE' END AS label FROM co JOIN ce USING (id) WHERE terminal_path <> 'RIGHT_CENSORED'""")
def f12_success_label(spark, sf):
    b = numbered(spark, sf)
    both = P.label_competing(path_events(b), b).where("terminal_path <> 'RIGHT_CENSORED'").join(ceiling(b), "id")
    return both.select("id", P.success_label(F.col("bound_available"), F.col("terminal_path")).alias("label"))


def expanding(c: str, rows: str, least: int) -> str:
    return f"(SELECT a.entity, a.date, CASE WHEN count(b.{c}) >= {least} THEN 100 * (count(*) FILTER (WHERE b.{c} < a.{c}) + (count(*) FILTER (WHERE b.{c} = a.{c}) + 1) / 2) / count(b.{c}) END AS {c} FROM {rows} a JOIN {rows} b ON a.entity = b.entity AND b.date <= a.date WHERE a.{c} IS NOT NULL GROUP BY a.entity, a.date, a.{c})"


@query(CTES + f""", da AS (SELECT entity, date, (close - {guarded('min(low)', 252, 252)}) / nullif({guarded('max(high)', 252, 252)} - {guarded('min(low)', 252, 252)}, 0) AS position_52w, close / {guarded('avg(close)', 200, 200)} - 1 AS ma200_deviation, {guarded('avg(volume)', 5, 5)} / {guarded('avg(volume)', 20, 20)} AS volume_strength FROM bars),
wk AS (SELECT entity, date + (7 - isodow(date))::INT AS date, arg_max(close, bars.date) AS close FROM bars GROUP BY entity, date + (7 - isodow(date))::INT), mo AS (SELECT entity, last_day(bars.date) AS date, arg_max(close, bars.date) AS close FROM bars GROUP BY entity, last_day(bars.date)),
{rsi_sql('wk')}, wr AS (SELECT entity, date, rsi AS weekly_rsi FROM rsi), {rsi_sql('mo').replace('ch AS', 'ch2 AS').replace('FROM ch ', 'FROM ch2 ').replace('sd AS', 'sd2 AS').replace('FROM sd ', 'FROM sd2 ').replace('sm AS', 'sm2 AS').replace('FROM sm)', 'FROM sm2)').replace('rsi AS (', 'rsi2 AS (')}, mr AS (SELECT entity, date, rsi AS monthly_rsi FROM rsi2),
ww AS (SELECT entity, date, close / {guarded('avg(close)', 200, 200)} AS ma200_weekly FROM wk),
e1 AS {expanding('position_52w', 'da', 20)}, e2 AS {expanding('ma200_deviation', 'da', 20)}, e3 AS {expanding('volume_strength', 'da', 20)}, e4 AS {expanding('weekly_rsi', 'wr', 14)}, e5 AS {expanding('monthly_rsi', 'mr', 14)}, e6 AS {expanding('ma200_weekly', 'ww', 20)}
SELECT d.entity, d.date, round(e1.position_52w + 1e-7, 4) AS position_52w, round(e2.ma200_deviation + 1e-7, 3) AS ma200_deviation, round(e3.volume_strength + 1e-7, 4) AS volume_strength, round(x4.weekly_rsi + 1e-7, 2) AS weekly_rsi, round(x5.monthly_rsi + 1e-7, 2) AS monthly_rsi, round(x6.ma200_weekly + 1e-7, 3) AS ma200_weekly FROM da d LEFT JOIN e1 USING (entity, date) LEFT JOIN e2 USING (entity, date) LEFT JOIN e3 USING (entity, date)
ASOF LEFT JOIN (SELECT * FROM e4 WHERE weekly_rsi IS NOT NULL) x4 ON x4.entity = d.entity AND x4.date <= d.date ASOF LEFT JOIN (SELECT * FROM e5 WHERE monthly_rsi IS NOT NULL) x5 ON x5.entity = d.entity AND x5.date <= d.date ASOF LEFT JOIN (SELECT * FROM e6 WHERE ma200_weekly IS NOT NULL) x6 ON x6.entity = d.entity AND x6.date <= d.date""")
def w9_indicator_frame(spark, sf):
    digits = {"position_52w": 4, "ma200_deviation": 3, "volume_strength": 4, "weekly_rsi": 2, "monthly_rsi": 2, "ma200_weekly": 3}
    return M.indicator_frame(bars(spark, sf)).select("entity", "date", *(F.round(F.col(c) + 1e-7, n).alias(c) for c, n in digits.items()))


def rank_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY month ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY month, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY month) END"


SCORE_COLUMNS = ("close", "ma50", "d50", "d200", "spot", "s50", "s200", "flow", "pace", "above", "loss_vol", "drawdown")
TIMING = CTES + f""", t1 AS (SELECT *, close / lag(close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret, {guarded('avg(close)', 50, 50)} AS ma50, {guarded('avg(close)', 200, 200)} AS ma200, {guarded('min(close)', 252, 126)} AS lo, {guarded('max(close)', 252, 126)} AS hi FROM bars),
t2 AS (SELECT *, CASE WHEN ret > 0 THEN volume WHEN ret < 0 THEN -volume ELSE 0 END AS signed, least(ret, 0) AS loss, nullif({guarded('stddev_samp(ret)', 63, 40)}, 0) AS vol FROM (SELECT * FROM t1)),
t3 AS (SELECT entity, date, close, ma50, (close / ma50 - 1) / vol AS d50, (close / ma200 - 1) / vol AS d200, (close - lo) / nullif(hi - lo, 0) AS spot, ma50 / lag(ma50, 63) OVER s - 1 AS s50, ma200 / lag(ma200, 63) OVER s - 1 AS s200, {guarded('sum(signed)', 63, 40)} / {guarded('sum(volume)', 63, 40)} AS flow, {guarded('avg(volume)', 20, 20)} / {guarded('avg(volume)', 120, 80)} AS pace, (close > ma200)::INT AS above, {guarded('stddev_samp(loss)', 63, 40)} AS loss_vol, close / hi - 1 AS drawdown
  FROM (SELECT * REPLACE (CASE WHEN ret IS NULL THEN NULL ELSE loss END AS loss) FROM t2) WINDOW s AS (PARTITION BY entity ORDER BY date)),
t4 AS (SELECT entity, last_day(date) AS month, {', '.join(f'arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in SCORE_COLUMNS)} FROM t3 GROUP BY ALL),
mk AS (SELECT month, m / lag(m, 3) OVER w - 1 AS m3, m / lag(m, 6) OVER w - 1 AS m6, m / lag(m, 12) OVER w - 1 AS m12 FROM (SELECT last_day(date) AS month, arg_max(c, date) AS m FROM (SELECT date, avg(close) AS c FROM bars GROUP BY date) GROUP BY ALL) WINDOW w AS (ORDER BY month)),
u1 AS (SELECT entity, month, row_number() OVER w - 1 AS i, greatest(close - lag(close) OVER w, 0) AS u, greatest(lag(close) OVER w - close, 0) AS l FROM t4 WINDOW w AS (PARTITION BY entity ORDER BY month)),
u2 AS (SELECT *, sum(CASE WHEN i = 1 THEN u * 14.0::DOUBLE / 13 WHEN i > 1 THEN u / 14 * pow(13.0::DOUBLE / 14, -i) ELSE 0 END) OVER w AS g, sum(CASE WHEN i = 1 THEN l * 14.0::DOUBLE / 13 WHEN i > 1 THEN l / 14 * pow(13.0::DOUBLE / 14, -i) ELSE 0 END) OVER w AS b FROM u1 WINDOW w AS (PARTITION BY entity ORDER BY month)),
t5 AS (SELECT t4.*, m3, m6, m12, CASE WHEN i >= 14 THEN CASE WHEN g = 0 AND b = 0 THEN 50 WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + g / b) END END AS rsi, close / lag(close, 3) OVER w - 1 AS r3, close / lag(close, 6) OVER w - 1 AS r6, close / lag(close, 12) OVER w - 1 AS r12, lag(close) OVER w / lag(close, 12) OVER w - 1 AS r12_1, -drawdown AS fall, avg(above) OVER (PARTITION BY month) AS breadth
  FROM t4 JOIN u2 USING (entity, month) LEFT JOIN mk USING (month) WINDOW w AS (PARTITION BY entity ORDER BY month)),
t6 AS (SELECT *, r3 - r12 / 4 AS accel, r6 - m6 AS rel6, -(r3 - m3 - (r6 - m6) / 2) AS cooling FROM t5),
ts AS (SELECT entity, month, close, ma50, r3, r12, m3, m12, 100 * ({rank_sql('d50')} + {rank_sql('d200')} + {rank_sql('rsi')} + {rank_sql('spot')}) / 4 AS extension, 100 * ({rank_sql('r6')} + {rank_sql('r12_1')} + {rank_sql('s50')} + {rank_sql('s200')} + {rank_sql('accel')}) / 5 AS trend,
  100 * ({rank_sql('rel6')} + {rank_sql('cooling')}) / 2 AS overheat, 100 * ({rank_sql('flow')} + {rank_sql('pace')} + breadth) / 3 AS participation, 100 * ({rank_sql('loss_vol')} + {rank_sql('fall')}) / 2 AS risk FROM t6)"""


def timing(spark, sf):
    b = bars(spark, sf)
    return M.timing_scores(b, b.groupBy("date").agg(F.avg("close").alias("close")))


@query(TIMING + " SELECT entity, month, round(extension, 4) AS extension, round(trend, 4) AS trend, round(overheat, 4) AS overheat, round(participation, 4) AS participation, round(risk, 4) AS risk FROM ts")
def w15_timing_scores(spark, sf):
    return timing(spark, sf).select("entity", "month", *(r(c, 4) for c in ("extension", "trend", "overheat", "participation", "risk")))


@query(TIMING + """, g1 AS (SELECT *, r3 / 3 - r12 / 12 AS gap, r3 - m3 AS ahead, r3 - m3 - (r12 - m12) / 4 AS relative_gap, participation - lag(participation, 3) OVER w AS change, coalesce(extension >= 55 AND r12 > 0.05, false) AS eligible FROM ts WINDOW w AS (PARTITION BY entity ORDER BY month)),
g2 AS (SELECT *, gap - lag(gap) OVER w AS gap_change, coalesce(max(eligible::INT) OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS prior FROM g1 WINDOW w AS (PARTITION BY entity ORDER BY month))
SELECT entity, month, CASE WHEN prior AND r3 < 0 AND close < ma50 AND ahead < 0 THEN 'BREAKING_RUSH' WHEN eligible AND gap < 0 AND gap_change < 0 AND change < 0 AND relative_gap < 0 THEN 'EXHAUSTED_RUSH' WHEN eligible AND gap >= 0 AND change >= 0 AND relative_gap >= 0 THEN 'EXTENDING_RUSH' WHEN eligible THEN 'HEALTHY_RUSH' ELSE 'NONE' END AS state FROM g2""")
def w32_rush_states(spark, sf):
    return M.rush_states(timing(spark, sf), 55, 0.05).select("entity", "month", "state")


def slope_sql(n: int) -> str:
    return f"CASE WHEN count(y) OVER (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN regr_slope(y, i) OVER (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING) END"


@query(CTES + CONTEXT + f""", o AS (SELECT entity, date, close, sector_close, ln(close) AS y, row_number() OVER w::DOUBLE AS i, close / lag(close) OVER w - 1 AS ret FROM bars JOIN cx USING (entity, date) WINDOW w AS (PARTITION BY entity ORDER BY date)), o2 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN least(ret, 0) END AS loss FROM o),
o3 AS (SELECT entity, date, (close / lag(close, 252) OVER w - 1) - (sector_close / lag(sector_close, 252) OVER w - 1) AS relative_extension, CASE WHEN {slope_sql(126)} > 0 THEN {slope_sql(63)} - {slope_sql(21)} END AS trend_deceleration, ((close / lag(close, 126) OVER w - 1) - (sector_close / lag(sector_close, 126) OVER w - 1)) / 6 - ((close / lag(close, 21) OVER w - 1) - (sector_close / lag(sector_close, 21) OVER w - 1)) AS relative_break, {guarded('stddev_samp(loss)', 20, 20)} / nullif({guarded('stddev_samp(loss)', 63, 63)}, 0) AS downside_expansion FROM o2 WINDOW w AS (PARTITION BY entity ORDER BY date)),
q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM o3)
SELECT a.entity, a.date, round(a.relative_extension, 5) AS relative_extension, round(a.trend_deceleration, 5) AS trend_deceleration, round(a.relative_break, 5) AS relative_break, round(a.downside_expansion, 4) AS downside_expansion, CASE WHEN count(b.relative_extension) >= 252 AND a.relative_extension IS NOT NULL THEN round(count(*) FILTER (WHERE b.relative_extension <= a.relative_extension) / count(b.relative_extension), 5) END AS extension_pct, CASE WHEN count(b.relative_break) >= 252 AND a.relative_break IS NOT NULL THEN round(count(*) FILTER (WHERE b.relative_break <= a.relative_break) / count(b.relative_break), 5) END AS break_pct
FROM q a LEFT JOIN q b ON a.entity = b.entity AND b.i BETWEEN a.i - 756 AND a.i - 1 GROUP BY a.entity, a.date, a.relative_extension, a.trend_deceleration, a.relative_break, a.downside_expansion""")
def w27_path_measures(spark, sf):
    m = M.path_measures(bars(spark, sf), context(spark, sf))
    ranked = W.window_ranks(m, {"extension_pct": "relative_extension", "break_pct": "relative_break"}, 756, 252, prior=True)
    return ranked.select("entity", "date", r("relative_extension", 5), r("trend_deceleration", 5), r("relative_break", 5), r("downside_expansion", 4), r("extension_pct", 5), r("break_pct", 5))


@query(CTES + EVENTS + CONTEXT + """, ro AS (SELECT nb.entity, nb.i, adj_close, volume, adj_close / lag(adj_close) OVER w - 1 AS ret, sector_close / lag(sector_close) OVER w - 1 AS sret, ln(adj_close / (open * adj_close / close)) AS intraday, ln(open * adj_close / close / lag(adj_close) OVER w) AS overnight, ln(adj_close) AS y FROM nb JOIN cx ON cx.entity = nb.entity AND cx.date = nb.date WINDOW w AS (PARTITION BY nb.entity ORDER BY nb.date)),
p AS (SELECT ev.id, ro.*, ro.i - ev.i AS k, CASE WHEN ro.i - ev.i > -126 THEN greatest(ret, 0) END AS up FROM ev JOIN ro ON ro.entity = ev.entity AND ro.i BETWEEN ev.i - 126 AND ev.i WHERE ev.i > 126), p2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY up DESC NULLS LAST) AS place FROM p)
SELECT id, round(sum(up) FILTER (WHERE place <= 5) / nullif(sum(up), 0), 5) AS gain_concentration, round(sum(intraday) FILTER (WHERE k > -63) / nullif(sum(abs(intraday)) FILTER (WHERE k > -63) + sum(abs(overnight)) FILTER (WHERE k > -63), 0), 5) AS intraday_share, round(sum(overnight) FILTER (WHERE k > -63) / nullif(sum(abs(intraday)) FILTER (WHERE k > -63) + sum(abs(overnight)) FILTER (WHERE k > -63), 0), 5) AS overnight_share,
 round(max(adj_close) FILTER (WHERE k = 0) / (sum(adj_close * volume) FILTER (WHERE k > -126) / sum(volume) FILTER (WHERE k > -126)) - 1, 5) AS overhang, round(CASE WHEN regr_slope(y, k) FILTER (WHERE k > -126) > 0 THEN regr_r2(y, k) FILTER (WHERE k > -126) ELSE 0 END, 4) AS trend_quality, CASE WHEN count(*) FILTER (WHERE k > -63 AND ret IS NOT NULL AND sret IS NOT NULL) >= 40 THEN round(corr(ret, sret) FILTER (WHERE k > -63 AND ret IS NOT NULL AND sret IS NOT NULL), 5) END AS sector_alignment FROM p2 GROUP BY id""")
def w29_event_price_features(spark, sf):
    b = numbered(spark, sf)
    f = M.event_price_features(path_events(b), b, context(spark, sf))
    return f.select("id", r("gain_concentration", 5), r("intraday_share", 5), r("overnight_share", 5), r("overhang", 5), r("trend_quality", 4), r("sector_alignment", 5))
