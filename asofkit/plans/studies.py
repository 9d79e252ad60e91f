"""Queries of statistics, ledgers, sources and streams."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import ledger as L
from ..operators import stats as ST
from ..operators import windows as W
from ..sources import readers as R
from ..sources.testdata import CTES, bars, sectors, table
from ..streaming import jobs as SS
from .events import day, orders
from .panel import FOLDS, off_tie, r
from .registry import query
from .research import stable_sql

LABELLED = "SELECT d.doc_id, n_chars, length(source) AS s, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang").join(table(spark, sf, "labels"), "doc_id")


@query("""WITH x AS (SELECT toxic, 'n_chars' AS feature, n_chars::DOUBLE AS x, doc_id % 1000 >= 400 AS late FROM documents JOIN labels USING (doc_id) UNION ALL SELECT toxic, 'quality', quality, doc_id % 1000 >= 400 FROM labels JOIN documents USING (doc_id)),
y AS (SELECT *, 'all' AS part FROM x UNION ALL SELECT *, late::VARCHAR FROM x), k AS (SELECT *, rank() OVER (PARTITION BY feature, part ORDER BY x) + (count(*) OVER (PARTITION BY feature, part, x) - 1) / 2 AS rank FROM y),
s AS (SELECT feature, part, sum((toxic = 1)::INT)::BIGINT AS n1, sum((toxic <> 1)::INT)::BIGINT AS n0, sum(rank) FILTER (WHERE toxic = 1) AS r1 FROM k GROUP BY ALL), e AS (SELECT *, 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1 AS effect FROM s),
h AS (SELECT feature, max(effect) FILTER (WHERE part = 'false' AND least(n1, n0) >= 5) AS first_half, max(effect) FILTER (WHERE part = 'true' AND least(n1, n0) >= 5) AS second_half FROM e GROUP BY feature)
SELECT feature, n1, n0, round(r1 - n1 * (n1 + 1) / 2, 4) AS u, round(effect, 6) AS effect, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, coalesce((sign(first_half) = sign(effect))::INT, 0) + coalesce((sign(second_half) = sign(effect))::INT, 0) AS same_direction FROM e JOIN h USING (feature) WHERE part = 'all'""")
def st1_rank_biserial(spark, sf):
    panel = labelled(spark, sf).withColumn("late", F.col("doc_id") % 1000 >= 400)
    return ST.half_effects(panel, ["n_chars", "quality"], "toxic", "late").select("feature", "n1", "n0", r("u", 4), r("effect"), r("first_half"), r("second_half"), "same_direction")


@query()
def st1_p_values(spark, sf):
    return ST.holm(ST.with_p_values(ST.rank_biserial(labelled(spark, sf), ["n_chars", "quality"], "toxic"))).select("feature", r("u", 4), r("p", 8), r("adjusted", 8))


@query("""WITH t AS (SELECT event_type AS feature, count(*)::DOUBLE / (SELECT count(*) FROM events) AS p FROM events GROUP BY ALL), a AS (SELECT feature, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, feature) + 1) * p) AS raised FROM t)
SELECT feature, round(p, 8) AS p, round(max(raised) OVER (ORDER BY p, feature), 8) AS adjusted FROM a""")
def st2_holm(spark, sf):
    e = table(spark, sf, "events")
    t = e.groupBy(F.col("event_type").alias("feature")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return ST.holm(t).select("feature", r("p", 8), r("adjusted", 8))


PRED = "p AS (SELECT l_returnflag AS g, (l_discount * 10)::DOUBLE AS s, (l_linestatus = 'F')::INT AS y FROM lineitem)"


@query(f"""WITH {PRED}, k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2 AS rank, greatest(1e-12, least(1 - 1e-12, s)) AS c FROM p)
SELECT g, count(*) AS n, round((sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(-y * ln(c) - (1 - y) * ln(1 - c)), 6) AS log_loss,
 round((sum((s >= 0.5 AND y = 1)::INT) / nullif(sum(y), 0) + sum((s < 0.5 AND y = 0)::INT) / nullif(count(*) - sum(y), 0)) / 2, 6) AS balanced FROM k GROUP BY g""")
def st3_binary_metrics(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") * 10).alias("s"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return ST.binary_metrics(p, ["g"], "s", "y").select("g", "n", r("auc"), r("brier"), r("log_loss"), r("balanced"))


@query("""WITH g AS (SELECT lang, count(*) AS n, avg(toxic) FILTER (WHERE quality = 1) AS a, avg(toxic) FILTER (WHERE quality = 0) AS b, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS h1, sum(toxic) AS h FROM documents JOIN labels USING (doc_id) GROUP BY lang),
t AS (SELECT lang, sum(exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + lgamma(n0 + 1) - lgamma(h - i + 1) - lgamma(n0 - h + i + 1) - lgamma(n1 + n0 + 1) + lgamma(h + 1) + lgamma(n1 + n0 - h + 1))) AS tail FROM (SELECT *, unnest(range(h1, least(n1, h)::BIGINT + 1)) AS i FROM g) WHERE h - i <= n0 GROUP BY lang)
SELECT lang, n, round(a, 6) AS exposed_rate, round(b, 6) AS control_rate, round(a - b, 6) AS difference, round(a / nullif(b, 0), 6) AS ratio, round(least(1, tail), 6) AS tail FROM g LEFT JOIN t USING (lang)""")
def st4_exposure_effect(spark, sf):
    return ST.exposure_effect(labelled(spark, sf), ["lang"], "quality", "toxic").select("lang", "n", r("exposed_rate"), r("control_rate"), r("difference"), r("ratio"), r("tail"))


POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


@query(f"""WITH d AS (SELECT source, quality AS e, toxic AS t, n_chars, length(lang) + quality AS s2 FROM documents JOIN labels USING (doc_id)), u AS (SELECT r, source, ('0x' || substr(md5('11|' || r || '|' || source), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT source FROM d WHERE source IS NOT NULL), range(0, 200) x(r)),
w AS (SELECT r, source, {' + '.join(f'(u >= {t!r}::DOUBLE)::INT' for t in POISSON)} AS w FROM u), j AS (SELECT r, w, d.* FROM w JOIN d USING (source) WHERE w > 0), a AS (SELECT r, sum(w * t) FILTER (WHERE e = 1) / sum(w) FILTER (WHERE e = 1) - sum(w * t) FILTER (WHERE e = 0) / sum(w) FILTER (WHERE e = 0) AS difference FROM j GROUP BY r),
v AS (SELECT r, e, n_chars, sum(w) AS w FROM j GROUP BY ALL), v2 AS (SELECT *, sum(w) OVER (PARTITION BY r, e ORDER BY n_chars) AS upto, sum(w) OVER (PARTITION BY r, e) AS total FROM v), v3 AS (SELECT r, e, min(n_chars) AS m FROM v2 WHERE 2 * upto >= total GROUP BY ALL), g AS (SELECT r, max(m) FILTER (WHERE e = 1) - max(m) FILTER (WHERE e = 0) AS median_gap FROM v3 GROUP BY r),
s1 AS (SELECT r, n_chars AS s, sum(w * t) AS p, sum(w * (1 - t)) AS q FROM j GROUP BY ALL), s2 AS (SELECT r, s2 AS s, sum(w * t) AS p, sum(w * (1 - t)) AS q FROM j GROUP BY ALL), c1 AS (SELECT r, sum(p * (b + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s1) GROUP BY r), c2 AS (SELECT r, sum(p * (b + q / 2)) / (sum(p) * sum(q)) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s2) GROUP BY r)
SELECT count(*) AS replicates, round(quantile_cont(difference, 0.025), 5) AS low, round(quantile_cont(difference, 0.5), 5) AS median, round(quantile_cont(difference, 0.975), 5) AS high, round(quantile_cont(median_gap, 0.5), 3) AS median_gap, round(quantile_cont(c1.auc - c2.auc, 0.5), 5) AS auc_edge FROM a JOIN g USING (r) JOIN c1 USING (r) JOIN c2 USING (r)""")
def st5_cluster_bootstrap(spark, sf):
    panel = labelled(spark, sf).withColumn("s2", F.length("lang") + F.col("quality"))
    reps = ST.cluster_bootstrap(panel, "source", "quality", "toxic", 200, 11, "n_chars", ("n_chars", "s2"))
    point = lambda c, q: F.percentile(c, F.lit(q))
    return reps.agg(F.count("*").alias("replicates"), *(F.round(point(c, q), n).alias(name) for name, c, q, n in (("low", "difference", 0.025, 5), ("median", "difference", 0.5, 5), ("high", "difference", 0.975, 5), ("median_gap", "median_gap", 0.5, 3), ("auc_edge", "auc_edge", 0.5, 5))))


MONTHLY = """, m AS (SELECT entity, last_day(date) AS month, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY ALL), f AS (SELECT *, lead(close, 3) OVER (PARTITION BY entity ORDER BY month) / close - 1 AS fwd FROM m)"""


def monthly(spark, sf):
    m = bars(spark, sf).groupBy("entity", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    return m.withColumn("fwd", F.lead("close", 3).over(Window.partitionBy("entity").orderBy("month")) / F.col("close") - 1)


@query(CTES + MONTHLY + """, k AS (SELECT entity, fwd, count(*) OVER e AS n, rank() OVER (PARTITION BY entity ORDER BY close) + (count(*) OVER (PARTITION BY entity, close) - 1) / 2 AS a, rank() OVER (PARTITION BY entity ORDER BY fwd) + (count(*) OVER (PARTITION BY entity, fwd) - 1) / 2 AS b FROM f WHERE fwd IS NOT NULL WINDOW e AS (PARTITION BY entity))
SELECT entity, count(*) AS n, round(corr(a, b), 6) AS ic, round(avg(fwd) FILTER (WHERE a / n > 0.8) - avg(fwd) FILTER (WHERE a / n <= 0.2), 5) AS spread FROM k GROUP BY entity""")
def st6_rank_ic(spark, sf):
    return ST.rank_ic(monthly(spark, sf), ["entity"], "close", "fwd").select("entity", "n", r("ic"), r("spread", 5))


EVENTS = FOLDS + """, ev AS (SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS date, o_orderdate::DATE + 30 AS outcome_end FROM orders),
af AS (SELECT fold, o_orderkey, o_totalprice, CASE WHEN date >= test_start AND outcome_end <= test_end THEN 'test' ELSE 'train' END AS role FROM ev JOIN folds ON (date >= test_start AND outcome_end <= test_end) OR (date >= train_start AND outcome_end <= train_end))"""


def events_and_folds(spark, sf):
    ev = orders(spark, sf).withColumn("outcome_end", F.date_add("date", 30))
    return ev, B.anchored_folds(bars(spark, sf), 252, 126, 126, 10, 5).withColumn("fold", F.col("fold").cast("long"))


def fold_events(spark, sf):
    return B.assign_folds(*events_and_folds(spark, sf))


@query(CTES + EVENTS + """, t AS (SELECT fold, quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3, quantile_cont(o_totalprice, 0.99) AS hi FROM af WHERE role = 'train' GROUP BY fold)
SELECT fold, o_orderkey, round((least(greatest(o_totalprice, lo), hi) - med) / nullif(q3 - q1, 0), 6) AS score FROM af JOIN t USING (fold) WHERE role = 'test'""")
def st7_robust_scores(spark, sf):
    return ST.robust_scores(*events_and_folds(spark, sf), "o_totalprice").select("fold", "o_orderkey", r("score"))


@query()
def st8_fold_logistic(spark, sf):
    ev = fold_events(spark, sf).withColumn("x", F.col("o_totalprice") / 100000).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    ev = ev.withColumn("z", (F.col("o_orderkey") % 7) / 7)
    return ST.fold_logistic(ev, ["x", "z"], "y", 1.0, interaction=("x", "z")).select("fold", "o_orderkey", r("score", 4))


@query(CTES + EVENTS + """, t AS (SELECT fold, quantile_cont(o_totalprice, 0.8) AS cut FROM af WHERE role = 'train' GROUP BY fold), g AS (SELECT fold, af.o_totalprice > cut AS high, (af.o_orderkey % 3 = 0)::INT AS y, date_trunc('quarter', ev.date) AS block FROM af JOIN t USING (fold) JOIN ev USING (o_orderkey) WHERE role = 'test'),
b AS (SELECT fold, block, avg(y) FILTER (WHERE high) - avg(y) FILTER (WHERE NOT high) AS d FROM g GROUP BY ALL), k AS (SELECT fold, avg(d) AS block_gap, count(*) FILTER (WHERE d > 0) AS positive_blocks, count(*) FILTER (WHERE d < 0) AS negative_blocks FROM b GROUP BY fold)
SELECT fold, count(*) AS n, round(avg(y) FILTER (WHERE high), 6) AS treated, round(avg(y) FILTER (WHERE NOT high), 6) AS control, round(avg(y) FILTER (WHERE high) - avg(y) FILTER (WHERE NOT high), 6) AS gap, round(any_value(block_gap), 6) AS block_gap, any_value(positive_blocks) AS positive_blocks, any_value(negative_blocks) AS negative_blocks FROM g JOIN k USING (fold) GROUP BY fold""")
def st11_quantile_groups(spark, sf):
    ev, folds = events_and_folds(spark, sf)
    return ST.quantile_groups(ev.withColumn("y", (F.col("o_orderkey") % 3 == 0).cast("int")), "o_totalprice", "y", folds=folds).select("fold", "n", r("treated"), r("control"), r("gap"), r("block_gap"), "positive_blocks", "negative_blocks")


@query("""WITH h AS (SELECT l_returnflag || l_linestatus AS candidate, (l_orderkey % 6)::INT AS block, avg(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
picks AS (SELECT row_number() OVER () - 1 AS split, m FROM (SELECT m FROM range(0, 64) t(m) WHERE bit_count(m) = 3 ORDER BY m)),
b AS (SELECT split, candidate, avg(score) FILTER (WHERE (m >> block) & 1 = 1) AS i, avg(score) FILTER (WHERE (m >> block) & 1 = 0) AS o FROM h, picks GROUP BY ALL),
k AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY split ORDER BY i DESC, candidate) AS turn, rank() OVER (PARTITION BY split ORDER BY o) AS rank FROM b WINDOW w AS (PARTITION BY split))
SELECT count(*) AS splits, round(avg((rank / (n + 1) <= 0.5)::INT), 6) AS pbo FROM k WHERE turn = 1""")
def st9_cscv_pbo(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("candidate"), (F.col("l_orderkey") % 6).cast("int").alias("block")).agg(F.avg("l_extendedprice").alias("score"))
    return ST.cscv_pbo(h).select("splits", r("pbo"))


@query("""WITH m AS (SELECT lower(l_returnflag) AS g, avg(l_discount) AS a, var_pop(l_discount) AS v, skewness(l_discount) AS s, kurtosis_pop(l_discount) + 3 AS k, count(l_discount) AS n FROM (SELECT l_returnflag, l_discount - 0.05 + l_tax / 100 AS l_discount FROM lineitem) GROUP BY ALL),
c AS (SELECT lower(l_returnflag) AS g, avg(pow((l_discount - 0.05 + l_tax / 100 - a) / sqrt(v), 3)) AS skew FROM lineitem JOIN m ON g = lower(l_returnflag) GROUP BY ALL)
SELECT g, n, round(a / sqrt(v), 5) AS sharpe, round((a / sqrt(v) - 2.5306028932016846) * sqrt(n - 1) / sqrt(1 - skew * a / sqrt(v) + (k - 1) * a * a / v / 4), 2) AS z FROM m JOIN c USING (g)""")
def st9_deflated_sharpe(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lower("l_returnflag").alias("g"), (F.col("l_discount") - 0.05 + F.col("l_tax") / 100).alias("ret"))
    return ST.deflated_sharpe(rows, ["g"], "ret", 100).select("g", "n", r("sharpe", 5), r("z", 2))


@query("""WITH r AS (SELECT corr(l_discount, l_tax) AS ab, corr(l_discount, l_quantity) AS ac, corr(l_tax, l_quantity) AS bc FROM lineitem), d AS (SELECT *, 1 - ab * ab - ac * ac - bc * bc + 2 * ab * ac * bc AS det FROM r)
SELECT 'l_discount' AS feature, round((1 - bc * bc) / det, 5) AS vif FROM d UNION ALL SELECT 'l_tax', round((1 - ac * ac) / det, 5) FROM d UNION ALL SELECT 'l_quantity', round((1 - ab * ab) / det, 5) FROM d""")
def st10_vif_pca(spark, sf):
    return ST.vif_pca(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"]).select("feature", r("vif", 5))


@query("""WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, 'l_quantity' AS "left", 'l_extendedprice' AS "right", count(*) AS n, round(corr(a, b), 6) AS rho, abs(corr(a, b)) >= 0.5 AS redundant FROM k GROUP BY ALL""".replace('"left"', "left_col").replace('"right"', "right_col"))
def a12_spearman_matrix(spark, sf):
    m = ST.redundant(ST.spearman_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]), ["l_returnflag"], 0.5)
    return m.select("l_returnflag", F.col("left").alias("left_col"), F.col("right").alias("right_col"), "n", r("rho"), "redundant")


ENTRIES = "e AS (SELECT user_id AS account, CASE event_type WHEN 'click' THEN 'DEPOSIT' WHEN 'view' THEN 'BUY' WHEN 'purchase' THEN 'SELL' ELSE 'DIVIDEND' END AS type, round(value, 2) AS gross, value / 100 AS fee FROM events)"


@query(f"""WITH {ENTRIES} SELECT account, round(sum(CASE WHEN type IN ('DEPOSIT', 'SELL', 'DIVIDEND') THEN gross WHEN type = 'BUY' THEN -gross ELSE 0 END - fee), 6) AS cash, round(sum(CASE WHEN type = 'DIVIDEND' THEN gross ELSE 0 END), 2) AS dividends,
 round(sum(fee), 6) AS fees, round(sum(CASE WHEN type = 'DEPOSIT' THEN gross ELSE 0 END), 2) AS contributions FROM e GROUP BY account""")
def l1_ledger_totals(spark, sf):
    t = F.when(F.col("event_type") == "click", "DEPOSIT").when(F.col("event_type") == "view", "BUY").when(F.col("event_type") == "purchase", "SELL").otherwise("DIVIDEND")
    e = table(spark, sf, "events").select(F.col("user_id").alias("account"), t.alias("type"), F.round("value", 2).alias("gross"), (F.col("value") / 100).alias("fee"))
    return L.ledger_totals(e).select("account", r("cash"), r("dividends", 2), r("fees"), r("contributions", 2))


LOTS = """WITH t AS (SELECT o_custkey AS account, l_suppkey AS symbol, (o_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_linenumber % 4 = 3 THEN 'SELL' ELSE 'BUY' END AS type, CASE WHEN l_linenumber % 4 = 3 THEN l_quantity / 50 ELSE l_quantity END AS q, l_extendedprice / l_quantity AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT *, sum(CASE type WHEN 'BUY' THEN q ELSE -q END) OVER (PARTITION BY account, symbol ORDER BY seq) AS held, sum(q) OVER (PARTITION BY account, symbol, type ORDER BY seq) AS upto FROM t),
g AS (SELECT account, symbol, min(held) < -1e-9 AS oversold, coalesce(sum(q) FILTER (WHERE type = 'SELL'), 0) AS sold, coalesce(sum(q) FILTER (WHERE type = 'BUY'), 0) AS bought FROM c GROUP BY ALL),
x AS (SELECT b.account, b.symbol, sum((least(b.upto, s.upto) - greatest(b.upto - b.q, s.upto - s.q)) * (s.p - b.p)) AS realised FROM c b JOIN c s ON b.account = s.account AND b.symbol = s.symbol AND b.type = 'BUY' AND s.type = 'SELL' AND least(b.upto, s.upto) > greatest(b.upto - b.q, s.upto - s.q) GROUP BY ALL),
k AS (SELECT c.account, c.symbol, sum(greatest(0, upto - greatest(upto - q, sold)) * p) AS cost FROM c JOIN g USING (account, symbol) WHERE type = 'BUY' GROUP BY ALL)"""


def trades(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_custkey")
    sell = F.col("l_linenumber") % 4 == 3
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("symbol"), ((F.col("o_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), F.when(sell, "SELL").otherwise("BUY").alias("type"), F.when(sell, F.col("l_quantity") / 50).otherwise(F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(None).cast("double").alias("ratio"))


@query(LOTS + """
SELECT account, symbol, oversold, CASE WHEN NOT oversold THEN round(coalesce(realised, 0) + 1e-8, 6) END AS realised, CASE WHEN NOT oversold THEN round(bought - sold, 6) END AS open_quantity, CASE WHEN NOT oversold THEN round(coalesce(cost, 0) + 1e-8, 6) END AS cost FROM g LEFT JOIN x USING (account, symbol) LEFT JOIN k USING (account, symbol)""")
def l2_fifo_lots(spark, sf):
    return L.fifo_lots(trades(spark, sf)).select("account", "symbol", "oversold", off_tie("realised"), r("open_quantity"), off_tie("cost"))


@query(CTES + """, h AS (SELECT c_custkey AS account, n_name AS entity, 10 + c_custkey % 7 AS quantity, 5000.0::DOUBLE AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT entity, arg_max(close, date) AS close, arg_max(prev, date) AS before FROM (SELECT entity, date, close, lag(close) OVER (PARTITION BY entity ORDER BY date) AS prev FROM bars) GROUP BY entity)
SELECT account, h.entity, round(quantity * close, 6) AS value, round(quantity * close / cost - 1, 6) AS gain, round(close / before - 1, 6) AS day_change, close IS NULL AS incomplete FROM h LEFT JOIN l ON h.entity = l.entity""")
def k2_value_holdings(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    h = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("account"), "entity", (10 + F.col("c_custkey") % 7).alias("quantity"), F.lit(5000.0).alias("cost"))
    return L.value_holdings(h, bars(spark, sf)).select("account", "entity", r("value"), r("gain"), r("day_change"), "incomplete")


@query(CTES + """, v AS (SELECT entity AS account, date, CASE WHEN entity = 'NATION_3' AND date >= DATE '1999-01-01' THEN 0 ELSE close * 10 + CASE WHEN day(date) = 15 THEN 100 ELSE 0 END END AS value, CASE WHEN day(date) = 15 AND NOT (entity = 'NATION_3' AND date >= DATE '1999-01-01') THEN 100 ELSE 0 END AS flow FROM bars),
g AS (SELECT account, date, CASE WHEN lag(value) OVER w > 0 THEN greatest(value - flow, 0) / lag(value) OVER w END AS g FROM v WINDOW w AS (PARTITION BY account ORDER BY date)), m AS (SELECT date, avg(close) AS c FROM bars GROUP BY date),
t AS (SELECT account, count(g) AS days, CASE WHEN coalesce(bool_or(g = 0), false) THEN -1 ELSE exp(sum(ln(g)) FILTER (WHERE g > 0)) - 1 END AS twr, min(date) AS a, max(date) AS b FROM g GROUP BY account)
SELECT account, days, round(twr, 5) AS twr, round(n.c / f.c - 1, 5) AS benchmark, round(twr - (n.c / f.c - 1), 5) AS excess FROM t JOIN m f ON f.date = t.a JOIN m n ON n.date = t.b""")
def l4_twr(spark, sf):
    gone = (F.col("entity") == "NATION_3") & (F.col("date") >= day("1999-01-01"))  # an account that loses everything
    flow = F.when((F.day("date") == 15) & ~gone, 100.0).otherwise(0.0)
    b = bars(spark, sf)
    v = b.select(F.col("entity").alias("account"), "date", F.when(gone, 0.0).otherwise(F.col("close") * 10 + flow).alias("value"), flow.alias("flow"))
    return L.twr(v, b.groupBy("date").agg(F.avg("close").alias("close"))).select("account", "days", r("twr", 5), r("benchmark", 5), r("excess", 5))


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY sha256('review|' || doc_id::VARCHAR), doc_id) <= 3")
def k4_stratified_sample(spark, sf):
    return L.stratified_sample(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 3, "review")


@query("SELECT user_id AS entity, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def io8_upsert(spark, sf):
    from ..operators.joins import upsert

    e = table(spark, sf, "events")
    old = e.withColumn("event_type", F.lit("stale")).withColumn("version", F.lit(1))
    return upsert(old, e.withColumn("version", F.lit(2)), ["event_id"], "version").select(F.col("user_id").alias("entity"), "event_type", "ts")


@query(CTES + """, h AS (SELECT entity, date, sha256(date::VARCHAR || '|' || volume::BIGINT::VARCHAR) AS h FROM bars WHERE date <= DATE '1999-12-31'), l AS (SELECT entity, left(h, 3) AS p, count(*) AS n, min(date) AS first, max(date) AS last, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT entity, sum(n)::BIGINT AS rows, min(first) AS first, max(last) AS last, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM l GROUP BY entity""")
def io10_fingerprint(spark, sf):
    b = bars(spark, sf).withColumn("volume", F.col("volume").cast("long"))
    return R.fingerprint(b, ["entity"], ["date", "volume"], "date", day("1999-12-31"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def io1_csv_round_trip(spark, sf):
    """Bars-like rows written as compressed CSV and read back by an explicit schema."""
    path = R.scratch(spark, "csv")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    return R.read_bars(spark, [path], "o_orderkey long, o_custkey long, o_totalprice double").drop("file")


@query("""SELECT user_id AS entity, date_trunc('day', ts)::DATE AS d, count(*) AS n FROM events GROUP BY ALL""")
def ss2_append_unique(spark, sf):
    out = R.scratch(spark, "stream")
    e = SS.append_unique(SS.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts")
    got = SS.run_available(e, f"{out}/o", f"{out}/c")
    return got.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 = 0 AND event_type <> 'click'")
def ss2_conflicts(spark, sf):
    """A later delivery that repeats ids: equal payloads pass in silence, others are rejected and shown."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    again = e.where("event_id % 10 = 0").withColumn("event_type", F.lit("click"))
    held = SS.conflicts(e, again, "event_id", ["event_type"]).select("event_id")
    return e.join(held, "event_id", "left_semi")


@query("""WITH e AS (SELECT event_type AS entity, ts, value, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-03') AS w FROM events), m AS (SELECT max(ts) - INTERVAL 3 DAY AS mark FROM events)
SELECT entity, (w + INTERVAL 6 DAY)::DATE AS week, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM e, m WHERE w + INTERVAL 7 DAY <= mark GROUP BY ALL""")
def ss1_stream_bars(spark, sf):
    out = R.scratch(spark, "stream")
    e = SS.stream_table(spark, sf, "events").select(F.col("event_type").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("volume"))
    return SS.run_available(SS.stream_bars(e), f"{out}/o", f"{out}/c")


@query("WITH RECURSIVE ev AS (SELECT user_id::VARCHAR AS entity, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'click' THEN 'EXTENDING' WHEN 'view' THEN 'COOLING' ELSE 'PLATEAU' END AS raw FROM events), " + stable_sql("ev") + " SELECT st.entity, id, label AS confirmed FROM st JOIN ev ON ev.entity = st.entity AND ev.i = st.i")
def ss4_confirm_labels(spark, sf):
    out = R.scratch(spark, "stream")
    label = F.when(F.col("event_type") == "click", "EXTENDING").when(F.col("event_type") == "view", "COOLING").otherwise("PLATEAU")
    e = SS.stream_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), label.alias("label"))
    return SS.run_available(SS.confirm_labels(e), f"{out}/o", f"{out}/c").select("entity", "id", "confirmed")


@query("""WITH e AS (SELECT user_id AS entity, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 12 HOUR AS cut FROM events), g AS (SELECT *, sum(coalesce(cut, true)::INT) OVER (PARTITION BY entity ORDER BY ts) AS n FROM e), s AS (SELECT entity, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM g GROUP BY entity, g.n)
SELECT entity, start, stop AS "end", n FROM s WHERE stop <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def ss7_sessionize(spark, sf):
    out = R.scratch(spark, "stream")
    e = SS.stream_table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"))
    got = SS.run_available(SS.sessionize(e, "12 hours"), f"{out}/o", f"{out}/c")
    return got.select("entity", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@query("""WITH n AS (SELECT o_orderkey AS id, n_name AS entity, o_orderdate::DATE AS date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1998-01-01')""" + CTES.replace("WITH", ",", 1) + """, b AS (SELECT entity, date, lead(open) OVER w AS entry, lead(close, 5) OVER w AS c5, max(high) OVER f5 AS h5, min(low) OVER f5 AS l5, lead(close, 21) OVER w AS c21, max(high) OVER f21 AS h21, min(low) OVER f21 AS l21 FROM bars WINDOW w AS (PARTITION BY entity ORDER BY date), f5 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), f21 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)),
o AS (SELECT id, 5 AS horizon, c5 / entry - 1 AS ret, h5 / entry - 1 AS mfe, l5 / entry - 1 AS mae FROM n JOIN b USING (entity, date) WHERE c5 IS NOT NULL UNION ALL SELECT id, 21, c21 / entry - 1, h21 / entry - 1, l21 / entry - 1 FROM n JOIN b USING (entity, date) WHERE c21 IS NOT NULL)
SELECT id, horizon, round(ret, 6) AS ret, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM o""")
def ss3_mature_outcomes(spark, sf):
    """Observations arrive as a stream; each batch appends the outcomes that have matured and are not stored."""
    out = R.scratch(spark, "stream")
    home = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"))
    seen = SS.stream_table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).join(home, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "entity", F.to_date("o_orderdate").alias("date")).dropDuplicates(["id"])
    SS.run_batches(seen, SS.mature_stream(seen, lambda: bars(spark, sf), out, (5, 21)), f"{out}/c")
    return spark.read.parquet(f"{out}/outcomes").select("id", "horizon", r("ret"), r("mfe"), r("mae"))


@query("SELECT CASE WHEN coalesce(l_discount <= 0.08 AND l_quantity > 2 AND l_extendedprice > 0, false) THEN 'good' ELSE 'quarantine' END AS sink, l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ALL")
def ss6_gate(spark, sf):
    out = R.scratch(spark, "stream")
    rows = SS.stream_table(spark, sf, "lineitem")
    SS.run_batches(rows, SS.gate_stream((F.col("l_discount") <= 0.08) & (F.col("l_quantity") > 2) & (F.col("l_extendedprice") > 0), out), f"{out}/c")
    read = lambda name: spark.read.parquet(f"{out}/{name}").withColumn("sink", F.lit(name))
    return read("good").unionByName(read("quarantine")).groupBy("sink", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("SELECT o_orderkey, o_custkey, o_orderdate::DATE AS settlement, o_orderdate::DATE + 10 AS published, dense_rank() OVER (ORDER BY o_orderdate::DATE) AS ordinal, o_totalprice FROM orders")
def io2_short_interest(spark, sf):
    path = R.scratch(spark, "psv")
    o = orders(spark, sf).select("o_orderkey", "o_custkey", F.col("date").alias("settlement"), "o_totalprice")
    o.write.option("header", True).option("sep", "|").csv(path)
    calendar = o.select("settlement").distinct().withColumn("published", F.date_add("settlement", 10))
    return R.read_short_interest(spark, path, "o_orderkey long, o_custkey long, settlement date, o_totalprice double", calendar)


@query("""SELECT o_orderkey::VARCHAR AS accession, lpad(o_custkey::VARCHAR, 10, '0') AS manager, o_orderdate::DATE AS filed, CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS amended, 'CUSIP' || l_suppkey AS cusip, (l_extendedprice::BIGINT) AS value, l_quantity::BIGINT AS shares
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'""")
def io3_read_13f(spark, sf):
    """Three members of an archive as TSV: submissions, cover pages, holdings; options and bad numbers are left out."""
    path = R.scratch(spark, "13f")
    o = orders(spark, sf)
    tsv = lambda df, name: df.write.option("header", True).option("sep", "\t").csv(f"{path}/{name}.tsv")
    tsv(o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.upper(F.date_format("date", "dd-MMM-yyyy")).alias("FILING_DATE"), F.lit("13F-HR").alias("SUBMISSIONTYPE"), F.col("o_custkey").alias("CIK"), F.upper(F.date_format("date", "dd-MMM-yyyy")).alias("PERIODOFREPORT")), "SUBMISSION")
    tsv(o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.when(F.col("o_orderkey") % 3 == 0, "y").otherwise("n").alias("ISAMENDMENT"), F.lit(" new   holdings ").alias("AMENDMENTTYPE")), "COVERPAGE")
    line = table(spark, sf, "lineitem")
    tsv(line.select(F.col("l_orderkey").alias("ACCESSION_NUMBER"), F.concat(F.lit("cusip"), "l_suppkey").alias("CUSIP"), F.bround("l_extendedprice").cast("long").alias("VALUE"), F.col("l_quantity").alias("SSHPRNAMT"), F.lit("SH").alias("SSHPRNAMTTYPE"), F.when(F.col("l_returnflag") == "R", "CALL").alias("PUTCALL")), "INFOTABLE")
    filings, holdings = R.read_13f(spark, path)
    return holdings.join(filings, "accession").select("accession", "manager", "filed", "amended", "cusip", "value", "shares")


@query("""SELECT o_orderkey::VARCHAR AS accession, o_orderdate::DATE AS filed, o_custkey::VARCHAR AS owner, l_linenumber AS line, CASE WHEN l_linestatus = 'F' THEN 'NONDERIV' ELSE 'DERIV' END AS kind, l_returnflag AS code, l_quantity::DOUBLE AS shares, round(l_extendedprice, 2) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def io4_read_form4(spark, sf):
    path = R.scratch(spark, "form4")
    o, line = orders(spark, sf), table(spark, sf, "lineitem")
    tsv = lambda df, name: df.write.option("header", True).option("sep", "\t").csv(f"{path}/{name}.tsv")
    tsv(o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.upper(F.date_format("date", "dd-MMM-yyyy")).alias("FILING_DATE"), F.lit("4").alias("DOCUMENT_TYPE")), "SUBMISSION")
    tsv(o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.col("o_custkey").alias("RPTOWNERCIK")), "REPORTINGOWNER")
    tsv(o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.lit("F1").alias("FOOTNOTE_ID"), F.lit("plan").alias("FOOTNOTE_TXT")), "FOOTNOTES")
    for name, status in (("NONDERIV", "F"), ("DERIV", "O")):
        rows = line.where(F.col("l_linestatus") == status).select(F.col("l_orderkey").alias("ACCESSION_NUMBER"), F.col("l_linenumber").alias(f"{name}_TRANS_SK"), F.lit("01-JAN-2020").alias("TRANS_DATE"), F.col("l_returnflag").alias("TRANS_CODE"), F.col("l_quantity").alias("TRANS_SHARES"), F.round("l_extendedprice", 2).alias("TRANS_PRICEPERSHARE"))
        tsv(rows, f"{name}_TRANS")
    t = R.read_form4(spark, path)
    moved = t["transactions"].join(t["filings"], "accession").join(t["owners"], "accession")
    return moved.select("accession", "filed", "owner", F.col("line").cast("int").alias("line"), "kind", "code", "shares", "price")


@query("SELECT l_suppkey AS cik, 'us-gaap' AS taxonomy, CASE WHEN l_linestatus = 'F' THEN 'Assets' ELSE 'Revenues' END AS concept, 'USD' AS unit, l_orderkey::VARCHAR AS accn, round(l_extendedprice, 2) AS val, o_orderdate::DATE AS accepted_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> 0")
def io5_company_facts(spark, sf):
    """Nested facts written as JSON, read back and flattened; those of an accession without acceptance are dropped."""
    path = R.scratch(spark, "facts")
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cik"), F.when(F.col("l_linestatus") == "F", "Assets").otherwise("Revenues").alias("concept"), F.col("l_orderkey").cast("string").alias("accn"), F.round("l_extendedprice", 2).alias("val"))
    obs = line.groupBy("cik", "concept").agg(F.collect_list(F.struct("accn", "val")).alias("obs")).withColumn("c", F.struct(F.create_map(F.lit("USD"), "obs").alias("units")))
    obs.groupBy("cik").agg(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("concept", "c")))).alias("facts")).write.json(path)
    schema = "cik long, facts map<string, map<string, struct<units: map<string, array<struct<accn: string, val: double>>>>>>"
    acceptance = orders(spark, sf).where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("accession"), F.col("date").alias("accepted_at"))
    return R.flatten_company_facts(spark.read.schema(schema).json(path), acceptance).select("cik", "taxonomy", "concept", "unit", "accn", "val", "accepted_at")


@query("SELECT l_orderkey AS id, l_suppkey AS supplier, l_quantity AS quantity FROM lineitem")
def io6_zip_columnar(spark, sf):
    path = R.scratch(spark, "columnar")
    one = F.struct("l_suppkey", "l_quantity")
    arrays = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("x")).select(F.col("l_orderkey").alias("id"), F.col("x.l_suppkey").alias("supplier"), F.col("x.l_quantity").alias("quantity"))
    arrays.write.json(path)
    return R.zip_columnar(spark.read.schema("id long, supplier array<long>, quantity array<double>").json(path), ["supplier", "quantity"])


@query("SELECT c_custkey::VARCHAR AS cik, upper(c_name) AS name, '10-K' AS form, DATE '2020-01-01' + (c_custkey % 90)::INT AS filed, 'edgar/' || c_custkey AS file FROM customer")
def io7_master_index(spark, sf):
    path = R.scratch(spark, "index")
    c = table(spark, sf, "customer").select(F.concat_ws("|", "c_custkey", F.upper("c_name"), F.lit("10-K"), F.date_add(day("2020-01-01"), (F.col("c_custkey") % 90).cast("int")), F.concat(F.lit("edgar/"), "c_custkey")).alias("value"))
    head = spark.createDataFrame([("Description: master index",), ("CIK|Company Name|Form Type|Date Filed|Filename",), ("-" * 20,)], "value string")
    head.unionByName(c).write.text(path)
    return R.read_master_index(spark, path)


@query("SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS y, CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders")
def io9_write_panel(spark, sf):
    """A partitioned panel, then one year of it replaced; the other years stay."""
    path = R.scratch(spark, "panel")
    o = orders(spark, sf).select("o_orderkey", "o_orderpriority", F.year("date").alias("y"), F.col("o_totalprice").alias("price"))
    R.write_panel(o, path, ["y"])
    R.write_panel(o.where("y = 1997").withColumn("price", F.col("price") + 1), path, ["y"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority", "y", "price")
