"""Queries of fundamentals, ledgers, identity joins and membership repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import business as BU
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import membership as U
from ..sources.testdata import CTES, bars, table
from .events import orders
from .panel import r
from .registry import query
from .studies import LOTS, trades

#: Facts of forty issuers by quarter, from orders; every order is a version of its quarter's fact.
FACTS = """f AS (SELECT o_custkey % 40 AS entity, ['revenue', 'earnings', 'operating_cash_flow', 'assets', 'liabilities'][left(o_orderpriority, 1)::INT] AS grp, o_orderkey % 2 AS concept_priority,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE - 1 AS period_end, o_orderdate::DATE + 120 AS accepted_at, o_orderkey AS accession, CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice END AS value FROM orders),
f2 AS (SELECT *, CASE grp WHEN 'revenue' THEN period_end - 90 WHEN 'earnings' THEN period_end - 90 WHEN 'operating_cash_flow' THEN period_end - 364 END AS period_start FROM f),
g AS (SELECT DISTINCT entity, last_day(accepted_at) AS as_of FROM f)"""


def facts(spark, sf):
    group = F.element_at(F.array(*map(F.lit, ("revenue", "earnings", "operating_cash_flow", "assets", "liabilities"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    end = F.date_sub(F.add_months(F.trunc("date", "quarter"), 3), 1)
    f = orders(spark, sf).select(
        (F.col("o_custkey") % 40).alias("entity"), group.alias("group"), (F.col("o_orderkey") % 2).alias("concept_priority"), end.alias("period_end"), F.date_add("date", 120).alias("accepted_at"), F.col("o_orderkey").alias("accession"),
        F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("value"),
    )
    start = F.when(F.col("group").isin("revenue", "earnings"), F.date_sub("period_end", 90)).when(F.col("group") == "operating_cash_flow", F.date_sub("period_end", 364))
    return f.withColumn("period_start", start)


def month_grid(f):
    return f.select("entity", F.last_day("accepted_at").alias("as_of")).distinct()


GUARD = f"""WITH {FACTS}, af AS (SELECT g.entity, g.as_of, f2.* EXCLUDE (entity), coalesce(period_end - period_start, 0) AS days FROM g JOIN f2 ON f2.entity = g.entity AND accepted_at <= as_of QUALIFY row_number() OVER (PARTITION BY g.entity, as_of, grp, period_start, period_end ORDER BY accepted_at DESC, concept_priority, accession DESC) = 1),
n AS (SELECT entity, as_of, max((period_end, accepted_at, value)) FILTER (WHERE grp = 'revenue' AND days BETWEEN 80 AND 100) AS rev, max((period_end, accepted_at, value)) FILTER (WHERE grp = 'operating_cash_flow' AND days BETWEEN 350 AND 380) AS cash, max((period_end, accepted_at, value)) FILTER (WHERE grp = 'assets') AS ast FROM af GROUP BY ALL),
p AS (SELECT n.entity, n.as_of, max((period_end, accepted_at, value)) FILTER (WHERE grp = 'revenue' AND days BETWEEN 80 AND 100 AND rev[1] - period_end BETWEEN 330 AND 400) AS rev0, max((period_end, accepted_at, value)) FILTER (WHERE grp = 'operating_cash_flow' AND days BETWEEN 350 AND 380 AND cash[1] - period_end BETWEEN 330 AND 400) AS cash0, max((period_end, accepted_at, value)) FILTER (WHERE grp = 'assets' AND ast[1] - period_end BETWEEN 330 AND 400) AS ast0 FROM n JOIN af USING (entity, as_of) GROUP BY ALL),
e AS (SELECT n.entity, n.as_of, max((accepted_at, value)) FILTER (WHERE grp = 'earnings' AND days BETWEEN 80 AND 100 AND period_end = rev[1]) AS earn, max((accepted_at, value)) FILTER (WHERE grp = 'earnings' AND days BETWEEN 80 AND 100 AND period_end = rev0[1]) AS earn0, max((accepted_at, value)) FILTER (WHERE grp = 'liabilities' AND period_end = ast[1]) AS liab, max((accepted_at, value)) FILTER (WHERE grp = 'liabilities' AND period_end = ast0[1]) AS liab0 FROM n JOIN p USING (entity, as_of) JOIN af USING (entity, as_of) GROUP BY ALL),
a AS (SELECT g.*, rev, rev0, cash, cash0, ast, ast0, earn, earn0, liab, liab0, greatest(rev[2], rev0[2], cash[2], cash0[2], ast[2], ast0[2], earn[1], earn0[1], liab[1], liab0[1]) AS newest, rev IS NULL OR rev0 IS NULL OR cash IS NULL OR cash0 IS NULL OR ast IS NULL OR ast0 IS NULL OR earn IS NULL OR earn0 IS NULL OR liab IS NULL OR liab0 IS NULL AS missing FROM g LEFT JOIN n USING (entity, as_of) LEFT JOIN p USING (entity, as_of) LEFT JOIN e USING (entity, as_of)),
b AS (SELECT *, newest IS NULL OR as_of - newest > 550 AS stale, rev[3] / nullif(rev0[3], 0) - 1 AS ry, earn[2] / nullif(rev[3], 0) AS mg, earn0[2] / nullif(rev0[3], 0) AS mg0, cash[3] / nullif(cash0[3], 0) - 1 AS cy, liab[2] / nullif(ast[3], 0) AS dr, liab0[2] / nullif(ast0[3], 0) AS dr0 FROM a),
c AS (SELECT *, list_filter([CASE WHEN ry <= -0.1 THEN 'REVENUE' END, CASE WHEN earn[2] < 0 OR mg - mg0 <= -0.05 THEN 'EARNINGS' END, CASE WHEN cash[3] <= 0 OR cy <= -0.3 THEN 'OPERATING_CASH_FLOW' END, CASE WHEN dr >= 0.6 AND dr - dr0 >= 0.1 THEN 'DEBT_BURDEN' END], lambda x: x IS NOT NULL) AS fl FROM b),
gd AS (SELECT entity, as_of, CASE WHEN missing OR stale THEN 'UNKNOWN' WHEN len(fl) >= 2 OR (earn[2] < 0 AND cash[3] <= 0) THEN 'VETO' ELSE 'PASS' END AS guard, CASE WHEN missing OR stale THEN '' ELSE array_to_string(fl, '|') END AS flags, CASE WHEN NOT (missing OR stale) THEN ry END AS revenue_yoy, CASE WHEN NOT (missing OR stale) THEN cash[3] END AS cash_flow, CASE WHEN NOT (missing OR stale) THEN dr END AS debt_ratio, CASE WHEN stale THEN 'STALE_FACTS' WHEN missing THEN 'MISSING_COMPARABLE_FACTS' ELSE '' END AS reason FROM c)"""


@query(GUARD + " SELECT entity, as_of, guard, flags, round(revenue_yoy, 6) AS revenue_yoy, round(cash_flow, 2) AS cash_flow, round(debt_ratio, 6) AS debt_ratio, reason FROM gd")
def a23_business_guard(spark, sf):
    f = facts(spark, sf)
    return BU.business_guard(f, month_grid(f)).select("entity", "as_of", "guard", "flags", r("revenue_yoy"), r("cash_flow", 2), r("debt_ratio"), "reason")


@query(f"""WITH {FACTS}, s AS (SELECT DISTINCT o_custkey % 40 AS entity, o_orderdate::DATE AS date, 2.0::DOUBLE AS ratio FROM orders WHERE o_orderkey % 397 = 0),
v AS (SELECT g.entity, as_of, grp AS concept, period_end, -concept_priority AS first, accepted_at, value FROM g JOIN f2 ON f2.entity = g.entity AND accepted_at <= as_of AND period_end <= as_of AND value > 0),
l AS (SELECT entity, as_of, max((period_end, first, accepted_at, concept, value)) AS last FROM v GROUP BY ALL), p AS (SELECT l.entity, l.as_of, last, max((period_end, first, accepted_at, v.concept, value)) FILTER (WHERE v.concept = last[4] AND last[1] - period_end BETWEEN 330 AND 400) AS prior FROM l JOIN v USING (entity, as_of) GROUP BY ALL),
k AS (SELECT entity, as_of, last[5] / nullif(prior[5] * coalesce((SELECT product(ratio) FROM s WHERE s.entity = p.entity AND s.date > prior[1] AND s.date <= last[1]), 1), 0) - 1 AS d FROM p)
SELECT g.entity, g.as_of, CASE WHEN abs(d) <= 1 THEN round(d, 6) END AS dilution FROM g LEFT JOIN k USING (entity, as_of)""")
def a25_dilution(spark, sf):
    f = facts(spark, sf)
    splits = orders(spark, sf).where("o_orderkey % 397 = 0").select((F.col("o_custkey") % 40).alias("entity"), "date", F.lit(2.0).alias("ratio")).distinct()
    known = f.select("entity", F.col("group").alias("concept"), F.col("concept_priority").alias("priority"), "period_end", "accepted_at", "value")
    return BU.dilution(known, splits, month_grid(f)).select("entity", "as_of", r("dilution"))


@query(GUARD.replace("WITH", CTES + ",", 1) + """, nt AS (SELECT n_nationkey, n_name FROM nation), mo AS (SELECT n_nationkey AS entity, last_day(date) AS date, arg_max(close, date) AS close, arg_max(adj_close, date) AS adj_close FROM bars JOIN nt ON n_name = bars.entity GROUP BY ALL),
sh AS (SELECT entity, accepted_at AS accepted, period_end, -concept_priority AS first, value FROM f2 WHERE grp = 'assets' AND value > 0 AND period_end <= accepted_at),
x AS (SELECT mo.entity, mo.date, close, adj_close, max((period_end, first, accepted, value))[4] AS shares FROM mo LEFT JOIN sh ON sh.entity = mo.entity AND accepted <= date GROUP BY ALL),
y AS (SELECT x.*, CASE WHEN cash_flow > 0 THEN close * shares / cash_flow END AS price_to_cash, adj_close / lag(adj_close, 12) OVER (PARTITION BY x.entity ORDER BY x.date) - 1 - revenue_yoy AS gap, row_number() OVER (PARTITION BY x.entity ORDER BY x.date) AS i FROM x LEFT JOIN gd ON gd.entity = x.entity AND gd.as_of = x.date)
SELECT a.entity, a.date, round(a.shares, 2) AS shares, round(a.price_to_cash, 5) AS price_to_cash, round(a.gap, 6) AS gap, CASE WHEN count(b.price_to_cash) >= 6 AND a.price_to_cash IS NOT NULL THEN round(count(*) FILTER (WHERE b.price_to_cash <= a.price_to_cash) / count(b.price_to_cash), 6) END AS price_to_cash_pct, CASE WHEN count(b.gap) >= 6 AND a.gap IS NOT NULL THEN round(count(*) FILTER (WHERE b.gap <= a.gap) / count(b.gap), 6) END AS gap_pct
FROM y a LEFT JOIN y b ON b.entity = a.entity AND b.i BETWEEN a.i - 60 AND a.i - 1 GROUP BY a.entity, a.date, a.shares, a.price_to_cash, a.gap""")
def a26_valuation_features(spark, sf):
    f, nation = facts(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name")
    b = bars(spark, sf).join(nation, F.col("entity") == F.col("n_name"))
    monthly = b.groupBy(F.col("key").alias("entity"), F.last_day("date").alias("date")).agg(F.max_by("close", "date").alias("close"), F.max_by("adj_close", "date").alias("adj_close"))
    guard = BU.business_guard(f, month_grid(f)).select("entity", F.col("as_of").alias("date"), "cash_flow", "revenue_yoy")
    shares = f.where("`group` = 'assets' and value > 0").select("entity", F.col("concept_priority").alias("priority"), "period_end", F.col("accepted_at").alias("accepted"), "value")
    return BU.valuation_features(monthly, shares, guard, 60, 6).select("entity", "date", r("shares", 2), r("price_to_cash", 5), r("gap"), r("price_to_cash_pct"), r("gap_pct"))


@query("""WITH a AS (SELECT o_custkey AS entity, o_orderdate::DATE AS date, o_totalprice AS actual, 150000.0 AS estimate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_totalprice) AS i, sign(o_totalprice - 150000.0) AS s FROM orders WHERE o_orderkey % 7 <> 0),
m AS (SELECT *, lag(s, 1) OVER w = s AS s1, lag(s, 2) OVER w = s AS s2, lag(s, 3) OVER w = s AS s3 FROM a WINDOW w AS (PARTITION BY entity ORDER BY i)), k AS (SELECT *, CASE WHEN s1 AND s2 AND s3 THEN 4 WHEN s1 AND s2 THEN 3 WHEN s1 THEN 2 ELSE 1 END AS run FROM m),
x AS (SELECT entity, date, arg_max(CASE WHEN s > 0 THEN CASE run WHEN 4 THEN 0.85 WHEN 3 THEN 0.90 WHEN 2 THEN 0.95 ELSE 1 END WHEN s < 0 THEN CASE run WHEN 4 THEN 1.15 WHEN 3 THEN 1.10 WHEN 2 THEN 1.05 ELSE 1 END ELSE 1 END, actual) AS mu FROM k GROUP BY ALL), g AS (SELECT DISTINCT o_custkey AS entity, last_day(o_orderdate::DATE) AS date FROM orders)
SELECT g.entity, g.date, coalesce(x.mu, 1)::DOUBLE AS multiplier FROM g ASOF LEFT JOIN x ON x.entity = g.entity AND x.date <= g.date""")
def a27_eps_streak(spark, sf):
    o = orders(spark, sf)
    source = F.when(F.col("o_orderkey") % 7 == 0, "rumour").otherwise("company_ir")
    said = o.select(F.col("o_custkey").alias("entity"), "date", F.col("o_totalprice").alias("actual"), F.lit(150000.0).alias("estimate"), source.alias("source"))
    return BU.eps_streak(said, o.select(F.col("o_custkey").alias("entity"), F.last_day("date").alias("date")).distinct())


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderdate::DATE AS date, o_orderstatus AS action, o_custkey AS symbol FROM orders), a AS (SELECT DISTINCT o_orderdate::DATE + (o_orderkey % 9)::INT AS date, o_orderstatus AS action, o_custkey AS symbol FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_orderdate::DATE AS date, o_orderstatus AS action, o_custkey AS symbol FROM orders WHERE o_orderkey % 5 = 0),
n AS (SELECT c.id, count(*) AS near, min(a.date) AS near_date FROM c JOIN a ON a.action = c.action AND a.symbol = c.symbol AND abs(a.date - c.date) <= 7 GROUP BY c.id)
SELECT c.id, c.date, c.action, c.symbol, CASE WHEN a.date IS NOT NULL THEN 'FIRST_EXACT' WHEN b.date IS NOT NULL THEN 'SECOND_EXACT' WHEN near = 1 THEN 'DATE_CORRECTED' WHEN EXISTS (SELECT 1 FROM a k WHERE k.action = c.action AND k.symbol = c.symbol) THEN 'DISTANT_REVIEW' ELSE 'UNRESOLVED' END AS status, CASE WHEN a.date IS NOT NULL OR b.date IS NOT NULL THEN c.date WHEN near = 1 THEN near_date END AS resolved_date
FROM c LEFT JOIN a ON a.date = c.date AND a.action = c.action AND a.symbol = c.symbol LEFT JOIN b ON b.date = c.date AND b.action = c.action AND b.symbol = c.symbol LEFT JOIN n ON n.id = c.id""")
def j14_reconcile(spark, sf):
    o = orders(spark, sf).select(F.col("o_orderkey").alias("id"), "date", F.col("o_orderstatus").alias("action"), F.col("o_custkey").alias("symbol"))
    first = o.where("id % 3 = 0").withColumn("date", F.date_add("date", (F.col("id") % 9).cast("int")))
    return J.reconcile(o, first, o.where("id % 5 = 0"))


@query()
def j17_match_controls(spark, sf):
    """Greedy without replacement, so no SQL; a test compares it with the definition."""
    o = orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.year("date").alias("fold"), (F.col("o_custkey") % 100).alias("entity"), "date", F.col("o_totalprice").alias("x"), "o_orderstatus")
    return J.match_controls(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["fold", "entity"], "x", 20000.0, 7).select("fold", "entity", "id", "control_id", r("gap", 4))


@query("""WITH iv AS (SELECT c % 50 AS id, p AS symbol, min(d) AS valid_from, max(d) AS valid_to FROM (SELECT o_custkey AS c, left(o_orderpriority, 1) AS p, year(o_orderdate) AS y, o_orderdate::DATE AS d FROM orders) GROUP BY c % 50, p, y),
t AS (SELECT DISTINCT o_custkey % 50 AS id, left(o_orderpriority, 1) AS old, (left(o_orderpriority, 1)::INT % 5 + 1)::VARCHAR AS new, o_orderdate::DATE + 20 AS effective FROM orders WHERE o_orderkey % 211 = 0),
o AS (SELECT t.*, max((valid_to, valid_from)) AS o FROM t JOIN iv ON iv.id = t.id AND iv.symbol = old AND valid_from <= effective GROUP BY ALL), n AS (SELECT t.*, min((valid_from, valid_to)) AS n FROM t JOIN iv ON iv.id = t.id AND iv.symbol = new AND valid_to >= effective GROUP BY ALL), b AS (SELECT * FROM o JOIN n USING (id, old, new, effective)),
ch AS (SELECT id, symbol, valid_from, valid_to, max(e) AS e, min(s) AS s, count(*) AS repairs FROM (SELECT id, old AS symbol, o[2] AS valid_from, o[1] AS valid_to, effective - 1 AS e, NULL::DATE AS s FROM b UNION ALL SELECT id, new, n[1], n[2], NULL, effective FROM b) GROUP BY ALL)
SELECT iv.id, iv.symbol, least(iv.valid_from, coalesce(s, iv.valid_from)) AS valid_from, greatest(iv.valid_to, coalesce(e, iv.valid_to)) AS valid_to, coalesce(repairs, 0) AS repairs FROM iv LEFT JOIN ch USING (id, symbol, valid_from, valid_to)""")
def u9_apply_transitions(spark, sf):
    o = orders(spark, sf).select((F.col("o_custkey") % 50).alias("id"), F.substring("o_orderpriority", 1, 1).alias("symbol"), "date", "o_orderkey")
    iv = o.groupBy("id", "symbol", F.year("date").alias("y")).agg(F.min("date").alias("valid_from"), F.max("date").alias("valid_to")).drop("y")
    t = o.where("o_orderkey % 211 = 0").select("id", F.col("symbol").alias("old"), (F.col("symbol").cast("int") % 5 + 1).cast("string").alias("new"), F.date_add("date", 20).alias("effective")).distinct()
    return U.apply_transitions(iv, t)


@query("""WITH fl AS (SELECT o_orderkey AS filing, o_custkey % 200 AS holder, date_trunc('quarter', o_orderdate)::DATE AS period, o_orderdate::DATE AS filed, o_orderdate::DATE + (o_orderkey % 60)::INT AS available FROM orders), w AS (SELECT DISTINCT period, (period + INTERVAL 3 MONTH)::DATE + 10 AS wave FROM fl),
k AS (SELECT w.period, wave, holder, filing FROM w JOIN fl ON fl.period = w.period AND available <= wave QUALIFY row_number() OVER (PARTITION BY w.period, wave, holder ORDER BY available DESC, filed DESC, filing DESC) = 1)
SELECT period, wave, l_suppkey AS security, holder, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS value FROM k JOIN lineitem ON l_orderkey = filing GROUP BY ALL HAVING sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) > 0""")
def u13_positions_at(spark, sf):
    f = orders(spark, sf).select(F.col("o_orderkey").alias("filing"), (F.col("o_custkey") % 200).alias("holder"), F.to_date(F.trunc("date", "quarter")).alias("period"), F.col("date").alias("filed"), F.date_add("date", (F.col("o_orderkey") % 60).cast("int")).alias("available"))
    waves = f.select("period").distinct().withColumn("available", F.date_add(F.add_months("period", 3), 10))
    value = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filing"), F.col("l_suppkey").alias("security"), value.alias("value"))
    return U.positions_at(held, f, waves)


@query(f"""{LOTS}, ps AS (SELECT account, symbol, bought - sold AS quantity, coalesce(cost, 0) AS cost FROM g LEFT JOIN k USING (account, symbol) WHERE NOT oversold AND bought - sold > 0),
pr AS (SELECT l_suppkey AS symbol, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS price, max(l_shipdate)::DATE AS priced FROM lineitem WHERE l_suppkey % 50 <> 0 GROUP BY l_suppkey),
ca AS (SELECT c_custkey AS account, round(c_acctbal, 2) AS cash FROM customer), v AS (SELECT account, bool_and(price IS NOT NULL) AS complete, sum(quantity * price) AS market, sum(cost) AS cost, min(priced) AS price_as_of, count(*) AS positions FROM ps LEFT JOIN pr USING (symbol) GROUP BY account)
SELECT account, CASE WHEN coalesce(complete, true) THEN 'LEDGER_READY' ELSE 'PRICE_INCOMPLETE' END AS status, coalesce(positions, 0) AS positions, cash, CASE WHEN coalesce(complete, true) THEN round(coalesce(market, 0) + 1e-8, 4) END AS market_value, round(coalesce(cost, 0) + 1e-8, 4) AS cost, CASE WHEN coalesce(complete, true) THEN round(coalesce(market, 0) - coalesce(cost, 0) + 1e-8, 4) END AS unrealised, price_as_of, cash < 0 AS cash_negative FROM ca LEFT JOIN v USING (account)""")
def l3_value_ledger(spark, sf):
    lots = L.fifo_lots(trades(spark, sf)).where("not oversold").select("account", "symbol", F.col("open_quantity").alias("quantity"), "cost")
    line = table(spark, sf, "lineitem").where("l_suppkey % 50 <> 0").withColumn("date", F.to_date("l_shipdate"))
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("close")
    # The ledger reads an entity's last price alone, so each task hands on one row of it.
    latest = F.max(F.struct("l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("turn"), "date", price)).alias("last")
    price = line.where(price.isNotNull()).groupBy(F.col("l_suppkey").alias("entity")).agg(latest).select("entity", "last.date", "last.close")
    cash = table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.round("c_acctbal", 2).alias("cash"))
    v = L.value_ledger(lots, cash, price)
    off = lambda c: F.round(F.col(c) + 1e-8, 4).alias(c)
    return v.select("account", "status", "positions", "cash", off("market_value"), off("cost"), off("unrealised"), "price_as_of", "cash_negative")
