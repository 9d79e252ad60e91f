"""Queries of reports over events, panels and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import reports as R
from ..operators import windows as W
from ..sources.testdata import CTES, bars, sectors, table
from .events import orders
from .panel import WEEK, r
from .registry import query


@query(CTES + """, b AS (SELECT entity, date, close, open, sector, lead(close, 21) OVER w / close - 1 AS r21, lead(close, 63) OVER w / close - 1 AS r63, min(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) / close - 1 AS d21, min(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) / close - 1 AS d63 FROM bars JOIN sectors USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY date)),
e AS (SELECT *, CASE WHEN close < open THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN abs(close / open - 1) < 0.2 THEN 'small' ELSE 'large' END AS ratio FROM b),
l AS (SELECT side, ratio, sector, h, CASE WHEN h = '21' THEN r21 ELSE r63 END AS ret, CASE WHEN h = '21' THEN CASE WHEN r21 IS NOT NULL THEN d21 END ELSE CASE WHEN r63 IS NOT NULL THEN d63 END END AS dd FROM e, (SELECT unnest(['21', '63']) AS h)),
x AS (SELECT unnest([{'axis': 'all', 'value': 'all'}, {'axis': 'side', 'value': side}, {'axis': 'ratio', 'value': ratio}, {'axis': 'sector', 'value': sector}]) AS s, h, (CASE side WHEN 'BUY' THEN ret > 0 ELSE ret < 0 END)::INT AS hit, ret, dd, CASE side WHEN 'BUY' THEN ret ELSE -ret END * 0.1 AS delta FROM l)
SELECT s.axis AS axis, s.value AS value, h AS horizon, count(hit) AS samples, round(100 * avg(hit), 5) AS hit_rate, round(avg(ret), 6) AS return_mean, round(avg(dd), 6) AS drawdown_mean, round(avg(delta), 6) AS delta_mean FROM x GROUP BY ALL""")
def a9_accuracy_report(spark, sf):
    e = bars(spark, sf).join(sectors(spark, sf), "entity").withColumn("side", F.when(F.col("close") < F.col("open"), "BUY").otherwise("SELL")).withColumn("ratio", F.when(F.abs(F.col("close") / F.col("open") - 1) < 0.2, "small").otherwise("large"))
    for h in (21, 63):
        ret = F.lead("close", h).over(W.series()) / F.col("close") - 1
        gain = F.when(F.col("side") == "BUY", F.col(f"return_{h}")).otherwise(-F.col(f"return_{h}"))
        worst = F.min("close").over(W.series().rowsBetween(1, h)) / F.col("close") - 1
        e = e.withColumn(f"return_{h}", ret).withColumn(f"drawdown_{h}", F.when(F.col(f"return_{h}").isNotNull(), worst)).withColumn(f"hit_{h}", gain > 0).withColumn(f"delta_{h}", gain * 0.1)
    return R.accuracy_report(e, ["side", "ratio", "sector"], ["21", "63"]).select("axis", "value", "horizon", "samples", r("hit_rate", 5), r("return_mean"), r("drawdown_mean"), r("delta_mean"))


@query(CTES + f""", wk AS (SELECT entity, {WEEK} AS week, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY ALL), p AS (SELECT entity, sector, week, 100 * (rank() OVER (PARTITION BY week ORDER BY close) + (count(*) OVER (PARTITION BY week, close) - 1) / 2) / count(*) OVER (PARTITION BY week) AS score, volume, close FROM wk JOIN sectors USING (entity)),
j AS (SELECT *, round(abs(score - lag(score) OVER (PARTITION BY entity ORDER BY week)), 9) AS jump FROM p), a AS (SELECT count(*) AS rows, quantile_cont(score, 0.99) - quantile_cont(score, 0.01) AS span, avg((score < 15)::INT) AS flee, avg((score >= 75)::INT) AS rush, avg(coalesce(jump >= 25, false)::INT) AS jumps FROM j), e AS (SELECT count(*) AS entities, quantile_cont(n, 0.5) AS median_rows FROM (SELECT count(*) AS n FROM p GROUP BY entity)),
s AS (SELECT max(m) - min(m) AS spread FROM (SELECT quantile_cont(score, 0.5) AS m FROM p GROUP BY sector)), k AS (SELECT abs(corr(a, b)) AS rho FROM (SELECT rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2 AS a, rank() OVER (ORDER BY close) + (count(*) OVER (PARTITION BY close) - 1) / 2 AS b FROM p))
SELECT rows, entities, round(median_rows, 1) AS median_rows, round(span, 4) AS span, round(flee, 6) AS flee, round(rush, 6) AS rush, round(jumps, 6) AS jumps, round(spread, 4) AS sector_spread, round(rho, 6) AS spearman, span >= 60 AS ok_least_span, jumps <= 0.05 AS ok_most_jumps, entities >= 20 AND median_rows >= 100 AND span >= 60 AND flee >= 0.01 AND rush >= 0.01 AND jumps <= 0.05 AND rho <= 0.9 AND spread <= 30 AS passed FROM a, e, s, k""")
def a11_stability_summary(spark, sf):
    from ..functions.scalars import stage

    weekly = B.weekly_bars(bars(spark, sf)).join(sectors(spark, sf), "entity")
    p = weekly.select("entity", "sector", "week", (100 * W.cross_rank("close", ["week"])).alias("score"), "volume", "close").withColumn("stage", stage(F.col("score")))
    gates = {"least_entities": 20, "least_rows": 100, "least_span": 60, "least_flee": 0.01, "least_rush": 0.01, "most_jumps": 0.05, "most_spearman": 0.9, "most_sector_spread": 30}
    s = R.stability_summary(p, ["volume", "close"], gates)
    return s.select("rows", "entities", r("median_rows", 1), r("span", 4), r("flee"), r("rush"), r("jumps"), r("sector_spread", 4), r("spearman"), "ok_least_span", "ok_most_jumps", "passed")


@query("""WITH ob AS (SELECT DISTINCT o_custkey % 300 AS symbol, date_trunc('month', o_orderdate)::DATE AS date FROM orders WHERE o_orderkey % 5 < 3), co AS (SELECT DISTINCT c_custkey % 250 AS entity, c_custkey % 400 AS symbol FROM customer), ex AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS date FROM orders WHERE month(o_orderdate) <> 2),
iv AS (SELECT o_custkey % 300 AS symbol, o_custkey % 2 AS id, min(o_orderdate::DATE) AS valid_from, max(o_orderdate::DATE) - 700 AS valid_to FROM orders GROUP BY ALL), ow AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS owners FROM co),
se AS (SELECT ob.symbol, ob.date, entity FROM ob JOIN ex USING (date) JOIN ow USING (symbol) WHERE owners = 1), li AS (SELECT entity, date FROM se JOIN iv USING (symbol) WHERE date BETWEEN valid_from AND valid_to GROUP BY ALL HAVING count(DISTINCT id) = 1), a AS (SELECT entity, count(DISTINCT date) AS observed, min(date) AS first, max(date) AS last FROM se GROUP BY entity), v AS (SELECT entity, count(*) AS linked FROM li GROUP BY entity)
SELECT entity, n AS expected, coalesce(observed, 0) AS observed, coalesce(linked, 0) AS linked, first, last, round(coalesce(observed, 0) / n, 6) AS coverage, round(coalesce(linked, 0) / n, 6) AS link_coverage, CASE WHEN observed IS NULL THEN 'NEVER_OBSERVED' WHEN coalesce(linked, 0) = observed THEN 'VERIFIED' WHEN linked > 0 THEN 'PARTIAL' ELSE 'UNLINKED' END AS status FROM (SELECT DISTINCT entity FROM co) LEFT JOIN a USING (entity) LEFT JOIN v USING (entity), (SELECT count(*) AS n FROM ex)""")
def a14_coverage_audit(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_custkey", "date", F.to_date(F.trunc("date", "month")).alias("m"))
    obs = o.where("o_orderkey % 5 < 3").select((F.col("o_custkey") % 300).alias("symbol"), F.col("m").alias("date"))
    cohort = table(spark, sf, "customer").select((F.col("c_custkey") % 250).alias("entity"), (F.col("c_custkey") % 400).alias("symbol"))
    iv = o.groupBy((F.col("o_custkey") % 300).alias("symbol"), (F.col("o_custkey") % 2).alias("id")).agg(F.min("date").alias("valid_from"), F.date_sub(F.max("date"), 700).alias("valid_to"))
    out = R.coverage_audit(obs, cohort, o.where(F.month("date") != 2).select(F.col("m").alias("date")), iv)
    return out.select("entity", "expected", "observed", "linked", "first", "last", r("coverage"), r("link_coverage"), "status")


RUNS = CTES + """, y AS (SELECT entity, sector, year(date) AS y, 100 * (arg_max(close, date) / arg_min(close, date) - 1) AS buyhold_return, 100 * (arg_max(open, date) / arg_min(open, date) - 1) AS base_return, 100 * (min(low) / max(high) - 1) AS base_mdd, 100 * (arg_max(adj_close, date) / arg_min(adj_close, date) - 1) AS new_return, 100 * (min(adj_close) / max(adj_close) - 1) AS new_mdd FROM bars JOIN sectors USING (entity) GROUP BY ALL),
d AS (SELECT *, CASE WHEN buyhold_return >= 20 THEN 'bull' WHEN buyhold_return <= -20 THEN 'bear' ELSE 'sideways' END AS regime, new_return - base_return AS rd, new_mdd - base_mdd AS md FROM y), c AS (SELECT *, CASE WHEN rd > 0.5 THEN 'improved' WHEN rd < -0.5 THEN 'worse' ELSE 'equal' END AS rs, CASE WHEN md > 0.5 THEN 'improved' WHEN md < -0.5 THEN 'worse' ELSE 'equal' END AS ms FROM d)"""


def runs(spark, sf):
    b = bars(spark, sf).join(sectors(spark, sf), "entity")
    change = lambda c: 100 * (F.max_by(c, "date") / F.min_by(c, "date") - 1)
    y = b.groupBy("entity", "sector", F.year("date").alias("y")).agg(change("close").alias("buyhold_return"), change("open").alias("base_return"), (100 * (F.min("low") / F.max("high") - 1)).alias("base_mdd"), change("adj_close").alias("new_return"), (100 * (F.min("adj_close") / F.max("adj_close") - 1)).alias("new_mdd"))
    return R.compare_runs(y)


@query(RUNS + """ SELECT sector, count(*) AS samples, round(100 * avg((rs = 'improved')::INT), 5) AS return_improved, round(100 * avg((ms = 'improved')::INT), 5) AS mdd_improved, round(100 * avg((rs <> 'worse' AND ms <> 'worse')::INT), 5) AS joint_pass, round(100 * avg((rs = 'worse')::INT), 5) AS return_worse, round(100 * avg((ms = 'worse')::INT), 5) AS mdd_worse,
 round(median(rd), 5) AS median_return_delta, round(median(md), 5) AS median_mdd_delta, avg((rs = 'improved')::INT) < 0.5 OR avg((rs <> 'worse' AND ms <> 'worse')::INT) < 0.4 AS repeated FROM c GROUP BY sector""")
def a20_diagnose(spark, sf):
    d = R.diagnose(runs(spark, sf), "sector")
    return d.select("sector", "samples", *(r(c, 5) for c in ("return_improved", "mdd_improved", "joint_pass", "return_worse", "mdd_worse", "median_return_delta", "median_mdd_delta")), "repeated")


@query(RUNS + """, x AS (SELECT unnest(list_filter([CASE WHEN rs = 'worse' THEN 'lower_return' END, CASE WHEN ms = 'worse' THEN 'deeper_drawdown' END, CASE WHEN ms = 'worse' AND regime = 'bear' THEN 'bear_market_defence' END, CASE WHEN rs = 'worse' AND regime = 'bull' THEN 'bull_market_capture' END], lambda v: v IS NOT NULL)) AS reason FROM c) SELECT reason, count(*) AS n FROM x GROUP BY reason""")
def a20_failure_reasons(spark, sf):
    return R.failure_reasons(runs(spark, sf))


@query(RUNS + " SELECT entity, y, regime, round(abs(least(0, rd)) + 2 * abs(least(0, md)), 4) AS severity FROM c ORDER BY abs(least(0, rd)) + 2 * abs(least(0, md)) DESC, entity, y LIMIT 20")
def a20_worst_runs(spark, sf):
    return R.worst_runs(runs(spark, sf), ["entity", "y"], 20).select("entity", "y", "regime", r("severity", 4))


GUIDANCE = CTES + """, f AS (SELECT entity, sector, date, close, open, lead(close, 21) OVER w / lead(open) OVER w - 1 AS ret, least(0, min(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) / close - 1) AS drawdown FROM bars JOIN sectors USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY date)), s AS (SELECT sector, date, avg(ret) AS sret FROM f WHERE ret IS NOT NULL GROUP BY ALL),
p AS (SELECT entity, date, CASE WHEN close < open THEN 'LOWER' ELSE 'NON_LOWER' END AS direction, ret - sret AS residual, drawdown, year(date) AS fold FROM f JOIN s USING (sector, date) WHERE ret IS NOT NULL AND open <> close)"""


def guidance(spark, sf):
    w = W.series()
    f = bars(spark, sf).join(sectors(spark, sf), "entity").withColumn("ret", F.lead("close", 21).over(w) / F.lead("open").over(w) - 1).withColumn("drawdown", F.least(F.lit(0.0), F.min("close").over(w.rowsBetween(1, 21)) / F.col("close") - 1)).where("ret is not null")
    residual = F.col("ret") - F.avg("ret").over(Window.partitionBy("sector", "date"))
    return f.withColumn("residual", residual).where("open <> close").select("entity", F.year("date").alias("fold"), F.when(F.col("close") < F.col("open"), "LOWER").otherwise("NON_LOWER").alias("direction"), "residual", "drawdown")


@query(GUIDANCE + """ SELECT entity, count(*) FILTER (WHERE direction = 'LOWER') AS treated_events, count(*) FILTER (WHERE direction <> 'LOWER') AS control_events, round(avg(residual) FILTER (WHERE direction = 'LOWER') - avg(residual) FILTER (WHERE direction <> 'LOWER'), 6) AS residual_effect, round(avg(drawdown) FILTER (WHERE direction = 'LOWER') - avg(drawdown) FILTER (WHERE direction <> 'LOWER'), 6) AS drawdown_effect
FROM p GROUP BY entity HAVING count(*) FILTER (WHERE direction = 'LOWER') > 0 AND count(*) FILTER (WHERE direction <> 'LOWER') > 0""")
def st12_issuer_effects(spark, sf):
    e = R.issuer_effects(guidance(spark, sf), ["entity"], "direction", "LOWER", "NON_LOWER", ["residual", "drawdown"])
    return e.select("entity", "treated_events", "control_events", r("residual_effect"), r("drawdown_effect"))


@query(GUIDANCE + " SELECT fold, count(*) AS events, round(median(residual) FILTER (WHERE direction = 'LOWER') - median(residual) FILTER (WHERE direction <> 'LOWER'), 6) AS residual_effect, round(median(drawdown) FILTER (WHERE direction = 'LOWER') - median(drawdown) FILTER (WHERE direction <> 'LOWER'), 6) AS drawdown_effect FROM p GROUP BY fold")
def st12_fold_effects(spark, sf):
    e = R.fold_effects(guidance(spark, sf), "fold", "direction", "LOWER", "NON_LOWER", ["residual", "drawdown"])
    return e.select("fold", "events", r("residual_effect"), r("drawdown_effect"))
