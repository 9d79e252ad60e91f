"""Queries of identity, disclosure and selection jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import ledger as L
from ..sources.testdata import CTES, table
from .events import day, orders
from .panel import STAGED, r, staged
from .registry import query


@query(r"""WITH n AS (SELECT s_suppkey AS owner, 'Firm ' || (s_suppkey % 40)::VARCHAR || CASE WHEN s_suppkey % 3 = 0 THEN ' INC' ELSE '' END AS name FROM supplier), e AS (SELECT c_custkey AS id, 'Firm ' || (c_custkey % 50)::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN ' INC' ELSE '' END AS name FROM customer),
x AS (SELECT name AS alias, min(owner) AS owner FROM n GROUP BY 1 HAVING count(DISTINCT owner) = 1), y AS (SELECT trim(regexp_replace(name, ' INC$', '')) AS alias, min(owner) AS owner FROM n GROUP BY 1 HAVING count(DISTINCT owner) = 1)
SELECT id, coalesce(x.owner, y.owner) AS owner, CASE WHEN x.owner IS NOT NULL THEN 'EXACT' WHEN y.owner IS NOT NULL THEN 'STRIPPED' ELSE 'NONE' END AS how FROM e LEFT JOIN x ON e.name = x.alias LEFT JOIN y ON trim(regexp_replace(e.name, ' INC$', '')) = y.alias""")
def j15_link_names(spark, sf):
    name = lambda k, m, d: F.concat(F.lit("Firm "), (F.col(k) % m).cast("string"), F.when(F.col(k) % d == 0, " INC").otherwise(""))
    n = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner"), name("s_suppkey", 40, 3).alias("name"))
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), name("c_custkey", 50, 2).alias("name"))
    return I.link_names(e, n, "name", "owner", " INC$")


@query("""WITH m AS (SELECT s_suppkey AS owner, s_name AS name, s_suppkey::VARCHAR AS number FROM supplier), rws AS (SELECT c_custkey AS id, 'Supplier#' || lpad((c_custkey % 30)::VARCHAR, 9, '0') AS name, 'x' AS signature, (c_custkey % 31)::VARCHAR AS number FROM customer),
a AS (SELECT name, min(owner) AS o FROM m GROUP BY 1 HAVING count(DISTINCT owner) = 1), b AS (SELECT number, min(owner) AS o FROM m GROUP BY 1 HAVING count(DISTINCT owner) = 1)
SELECT id, CASE WHEN NOT (a.o IS NOT NULL AND b.o IS NOT NULL AND a.o <> b.o) THEN coalesce(a.o, b.o) END AS owner, CASE WHEN a.o IS NOT NULL AND b.o IS NOT NULL AND a.o <> b.o THEN 'CONFLICT' WHEN a.o IS NOT NULL THEN 'NAME' WHEN b.o IS NOT NULL THEN 'NUMBER' ELSE 'NONE' END AS how
FROM rws LEFT JOIN a ON rws.name = a.name LEFT JOIN b ON rws.number = b.number""")
def j16_resolve_identity(spark, sf):
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("number"))
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("Supplier#"), F.lpad((k % 30).cast("string"), 9, "0")).alias("name"), F.lit("x").alias("signature"), (k % 31).cast("string").alias("number"))
    names = I.unique_alias(m, "name", "owner")
    return I.resolve_identity(rows, names, names.where("false"), I.unique_alias(m, "number", "owner"))


@query("""WITH q AS (SELECT o_custkey, o_orderpriority, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS q FROM orders)
SELECT o_custkey, o_orderpriority, min(q) AS first, max(q) AS last, count(DISTINCT q) AS quarters, round(count(DISTINCT q) / ((year(max(q)) * 4 + quarter(max(q))) - (year(min(q)) * 4 + quarter(min(q))) + 1), 6) AS coverage FROM q GROUP BY ALL""")
def a5_identifier_intervals(spark, sf):
    return I.identifier_intervals(orders(spark, sf), "o_orderpriority", "o_custkey", "date").select("o_custkey", "o_orderpriority", "first", "last", "quarters", r("coverage"))


@query("""WITH o AS (SELECT l_suppkey AS symbol, l_partkey % 40 AS number, l_linenumber % 2 AS issuer, CASE WHEN l_partkey % 40 = 7 THEN l_returnflag WHEN l_linestatus = 'F' THEN '' ELSE 'C' || (l_partkey % 40) END AS code, year(l_shipdate) AS period, l_orderkey FROM lineitem),
w AS (SELECT issuer, symbol, number, count(*) AS rows, CASE WHEN count(DISTINCT nullif(code, '')) = 1 THEN max(nullif(code, '')) ELSE '' END AS code FROM o GROUP BY ALL), p AS (SELECT issuer, symbol, number, period, count(DISTINCT l_orderkey) AS filings FROM o GROUP BY ALL)
SELECT symbol, period, issuer::INT AS issuer, number, code, filings, rows FROM p JOIN w USING (issuer, symbol, number) QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY filings DESC, rows DESC, number DESC, issuer DESC) = 1""")
def a30_primary_security(spark, sf):
    number = F.col("l_partkey") % 40
    code = F.when(number == 7, F.col("l_returnflag")).when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("C"), number.cast("string")))
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), number.alias("number"), (F.col("l_linenumber") % 2).cast("int").alias("issuer"), code.alias("code"), F.year("l_shipdate").cast("long").alias("period"), "l_orderkey")
    return I.primary_security(li, "symbol", "period", "issuer", "number", "code", "l_orderkey")


@query("""WITH x AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice AS low, o_totalprice * 1.5 AS high, o_orderdate::DATE AS date FROM orders), m AS (SELECT *, (low + high) / 2 AS mid, lag((low + high) / 2) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY date, o_orderkey) AS before FROM x)
SELECT o_orderkey, round(mid - before + 1e-8, 5) AS delta, round(mid / before - 1, 6) AS ratio FROM m WHERE before IS NOT NULL""")
def a28_revision_pairs(spark, sf):
    x = orders(spark, sf).select("o_custkey", "o_orderpriority", "o_orderkey", "date", F.col("o_totalprice").alias("low"), (F.col("o_totalprice") * 1.5).alias("high"))
    return I.revision_pairs(x, ["o_custkey", "o_orderpriority"], ["date", "o_orderkey"]).select("o_orderkey", F.round(F.col("delta") + 1e-8, 5).alias("delta"), r("ratio"))


@query("""WITH p AS (SELECT o_custkey AS entity, o_orderdate::DATE AS date, date_trunc('year', o_orderdate)::DATE AS accepted_at, max(o_totalprice) AS v FROM orders GROUP BY ALL), f AS (SELECT entity, accepted_at, arg_min(v, date) AS v FROM p GROUP BY ALL), c AS (SELECT entity, accepted_at, v - lag(v) OVER (PARTITION BY entity ORDER BY accepted_at) AS change FROM f)
SELECT entity, date, round(change + 1e-8, 5) AS change FROM p JOIN c USING (entity, accepted_at)""")
def a24_disclosure_change(spark, sf):
    p = orders(spark, sf).groupBy(F.col("o_custkey").alias("entity"), "date", F.date_trunc("year", "date").cast("date").alias("accepted_at")).agg(F.max("o_totalprice").alias("v"))
    return I.disclosure_change(p, "v").select("entity", "date", F.round(F.col("change") + 1e-8, 5).alias("change"))


@query("""WITH c AS (SELECT DISTINCT o_orderpriority AS scenario, o_custkey AS entity, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'ADD' ELSE 'REMOVE' END AS action FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey, o_orderdate::DATE ORDER BY o_orderkey) = 1),
e AS (SELECT scenario, entity, DATE '1990-01-01' AS date, 'ADD' AS action FROM (SELECT DISTINCT scenario, entity FROM c WHERE entity % 2 = 1) UNION ALL SELECT * FROM c)
SELECT scenario, entity, date AS valid_from, valid_to FROM (SELECT *, lead(date) OVER (PARTITION BY scenario, entity ORDER BY date, action) AS valid_to FROM e) WHERE action = 'ADD' AND (valid_to IS NULL OR valid_to > date)""")
def u4_scenario_membership(spark, sf):
    from ..operators.joins import latest

    c = latest(orders(spark, sf), ["o_orderpriority", "o_custkey", "date"], [F.col("o_orderkey")]).select(F.col("o_orderpriority").alias("scenario"), F.col("o_custkey").alias("entity"), "date", F.when(F.col("o_orderkey") % 2 == 0, "ADD").otherwise("REMOVE").alias("action"))
    base = c.where("entity % 2 = 1").select("scenario", "entity").distinct().withColumn("start", day("1990-01-01"))
    return I.scenario_membership(base, c)


@query("""WITH s AS (SELECT o_custkey AS entity, o_orderdate::DATE AS date, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS step FROM orders), g AS (SELECT *, coalesce(date - lag(date) OVER w > 60, true)::INT AS new FROM s WINDOW w AS (PARTITION BY entity ORDER BY date, step)), k AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY date, step ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT entity, min(date) AS first, max(date) AS last, count(*) AS events, sum(step)::BIGINT AS net FROM k GROUP BY entity, g HAVING count(*) > 1 AND sum(step) = 0""")
def u10_closed_loops(spark, sf):
    return I.closed_loops(orders(spark, sf).select(F.col("o_custkey").alias("entity"), "date", F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("step")), 60)


@query("""WITH h AS (SELECT o_orderstatus AS g, year(o_orderdate) AS fold, o_orderpriority AS choice FROM orders GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY g, fold ORDER BY count(*) DESC, choice) = 1), a AS (SELECT *, (choice = lag(choice) OVER (PARTITION BY g ORDER BY fold))::INT AS again FROM h), c AS (SELECT g, choice, count(*) AS n FROM h GROUP BY ALL)
SELECT g, (SELECT count(*) FROM h WHERE h.g = a.g) AS folds, (SELECT count(*) FROM c WHERE c.g = a.g) AS choices, round((SELECT max(n) FROM c WHERE c.g = a.g) / (SELECT count(*) FROM h WHERE h.g = a.g), 6) AS top_share, round(avg(again), 6) AS repeat_rate FROM a GROUP BY g""")
def a19_selection_stability(spark, sf):
    from ..operators.joins import latest

    counts = orders(spark, sf).groupBy(F.col("o_orderstatus").alias("g"), F.year("date").alias("fold"), F.col("o_orderpriority").alias("choice")).agg(F.count("*").alias("n"))
    h = latest(counts, ["g", "fold"], [F.desc("n"), F.col("choice")]).drop("n")
    return I.selection_stability(h, ["g"], "fold", "choice").select("g", "folds", "choices", r("top_share"), r("repeat_rate"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT user_id, ts::DATE AS s, ts::DATE + 5 AS e FROM events), kept AS (
  SELECT user_id, min(s) AS s, min(e) AS e FROM d GROUP BY user_id
  UNION ALL SELECT k.user_id, (SELECT min(d.s) FROM d WHERE d.user_id = k.user_id AND d.s > k.e) AS s, (SELECT min(d.s) FROM d WHERE d.user_id = k.user_id AND d.s > k.e) + 5 AS e FROM kept k WHERE EXISTS (SELECT 1 FROM d WHERE d.user_id = k.user_id AND d.s > k.e)
) SELECT user_id, s AS start, e AS "end" FROM kept""".replace('"end"', "until"))
def w23_non_overlapping(spark, sf):
    d = F.to_date("ts")
    ev = table(spark, sf, "events").select("user_id", d.alias("start"), F.date_add(d, 5).alias("until"))
    return I.non_overlapping(ev, ["user_id"], "start", "until")


@query("""SELECT l_suppkey, arg_max(l_partkey, (l_quantity, l_partkey)) AS best, list_sort(list(DISTINCT l_partkey)) AS symbols, max(l_quantity) AS largest, sum(l_quantity) AS total FROM lineitem GROUP BY 1 ORDER BY largest DESC, total DESC, l_suppkey LIMIT 20""")
def k7_rank_gaps(spark, sf):
    return I.rank_gaps(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", 20)


@query(CTES + STAGED + """, c AS (SELECT entity, date, stage, lag(stage) OVER (PARTITION BY entity ORDER BY date) AS previous FROM staged), u AS (SELECT c_custkey AS reader, DATE '2000-01-01' + (c_custkey % 300)::INT AS cur FROM customer)
SELECT reader, entity, date, previous, stage FROM c JOIN u ON date > cur WHERE previous <> stage QUALIFY row_number() OVER (PARTITION BY reader ORDER BY date DESC, entity) <= 10""")
def k6_change_feed(spark, sf):
    readers = table(spark, sf, "customer").select(F.col("c_custkey").alias("reader"), F.date_add(day("2000-01-01"), (F.col("c_custkey") % 300).cast("int")).alias("cursor"))
    return L.change_feed(staged(spark, sf).select("entity", "date", "stage"), readers, "stage", 10).select("reader", "entity", "date", "previous", "stage")
