"""The same queries as SQL, for a check by another engine. Queries without a SQL form are absent."""

from __future__ import annotations

LINES = "(SELECT *, l_shipdate::DATE AS ship_date, year(l_shipdate)::INT AS ship_year FROM lineitem)"
READINGS = (
    "(SELECT event_type, user_id, ts::DATE AS day, value, round(value * 100)::BIGINT AS cents FROM events)"
)
BOUNDS = "round(av, 8) AS av, round(sd, 8) AS sd, round(se, 8) AS se, round(av - se, 8) AS lo, round(av + se, 8) AS hi"
BOUNDS_CENTS = (
    "round(av / 100, 8) AS av, round(sd / 100, 8) AS sd, round(se / 100, 8) AS se,"
    " round((av - se) / 100, 8) AS lo, round((av + se) / 100, 8) AS hi"
)
RESIDUALS = f"""
cells AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY ALL),
res AS (SELECT l.l_returnflag, l.l_linestatus, l.ship_date, l.ship_year, l.l_quantity - c.m AS r
        FROM {LINES} l JOIN cells c ON l.l_returnflag = c.l_returnflag AND l.l_linestatus = c.l_linestatus)
"""
SUMMARY = "count(*) AS n, avg({0}) AS av, stddev_samp({0}) AS sd, stddev_samp({0}) / sqrt(count(*)) AS se"
CURVE_WEIGHT = "exp(1.55 * ln(p_size) + -6.5)"
LOGIT = f"""
scaled AS (SELECT *, l_discount * 1000 AS cover FROM {LINES}),
lim AS (SELECT min(cover) AS lo, max(cover) AS hi, CASE WHEN max(cover) > 1 THEN 100.0 ELSE 1.0 END AS s FROM scaled),
prop AS (SELECT scaled.*, CASE WHEN lim.lo <= 0 OR lim.hi >= lim.s THEN 0.025 + 0.95 * (cover / lim.s)
                               ELSE cover / lim.s END AS p FROM scaled, lim),
logits AS (SELECT *, ln(p / (1 - p)) AS y FROM prop)
"""


def saturated(source: str, response: str, link: str, variance: str, free: bool, prelude: str = "", alpha: bool = False) -> str:
    """Estimates of y ~ flag * status from cell moments, with standard errors by the delta method."""
    value, slope = ("ln(m)", "m") if link == "log" else ("m", "1.0")
    theta = (
        "theta AS (SELECT greatest((sum(ss) * sum(n) / (sum(n) - 6) - sum(n * m)) / sum(n * m * m), 1e-8) AS a FROM c0),"
        if alpha
        else "theta AS (SELECT 0.0 AS a),"
    )
    parts = {
        "intercept": {"AF": 1},
        "l_returnflag_N": {"NF": 1, "AF": -1},
        "l_returnflag_R": {"RF": 1, "AF": -1},
        "l_linestatus_O": {"AO": 1, "AF": -1},
        "l_returnflag_N_x_l_linestatus_O": {"NO": 1, "NF": -1, "AO": -1, "AF": 1},
        "l_returnflag_R_x_l_linestatus_O": {"RO": 1, "RF": -1, "AO": -1, "AF": 1},
    }
    rows = ", ".join(f"('{t}', '{c}', {s})" for t, cs in parts.items() for c, s in cs.items())
    scale = "phi.f" if free else "1.0"
    return f"""
WITH {prelude + ',' if prelude else ''}
c0 AS (SELECT l_returnflag || l_linestatus AS cell, count(*)::DOUBLE AS n, avg({response}) AS m,
              var_pop({response}) * count(*) AS ss FROM {source} GROUP BY 1),
{theta}
c AS (SELECT cell, n, m, ss, {variance} AS v FROM c0, theta),
phi AS (SELECT sum(ss / v) / (sum(n) - 6) AS f FROM c),
contrast(term, cell, sign) AS (VALUES {rows}),
est AS (SELECT term, sum(sign * {value}) AS estimate,
               sqrt(any_value({scale}) * sum(v / (n * {slope} * {slope}))) AS se
        FROM contrast JOIN c USING (cell), phi GROUP BY term)
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 6) AS statistic FROM est
"""


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["scan"] = f"""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, ship_date FROM {LINES}"""

    sql["sink_roundtrip"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus, ship_date FROM {LINES}"""

    sql["csv_roundtrip"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 7 THEN l_quantity::INT END AS quantity,
       nullif(l_tax, 0.08) AS tax, CASE WHEN l_linenumber <> 6 THEN ship_date END AS ship_date, l_returnflag,
       CASE l_linenumber WHEN 7 THEN 'quantity=' || l_quantity::INT || 'x'
                         WHEN 6 THEN 'ship_date=' || strftime(ship_date, '%d.%m.%Y') ELSE '' END AS unreadable
FROM {LINES}"""

    sql["quality_codes"] = f"""
WITH l AS (SELECT * REPLACE (nullif(l_tax, 0.08) AS l_tax) FROM {LINES})
SELECT l_orderkey, l_linenumber, l_partkey, 'l_returnflag' AS field, 'code' AS rule, l_returnflag AS value
FROM l WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_linestatus', 'code', l_linestatus
FROM l WHERE l_linestatus NOT IN ('F', 'O')
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity', 'range', l_quantity::VARCHAR
FROM l WHERE NOT l_quantity BETWEEN 1 AND 45
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', 'range', l_discount::VARCHAR
FROM l WHERE NOT l_discount BETWEEN 0 AND 0.09::DOUBLE
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', 'required', NULL FROM l WHERE l_tax IS NULL
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, '', 'shipped late', NULL FROM l WHERE ship_year > 2000"""

    sql["quality_dictionary"] = f"""
WITH l AS (SELECT * FROM {LINES}),
ends AS (SELECT min(l_quantity) AS low, avg(l_quantity) AS high FROM l WHERE l_returnflag < 'R')
SELECT l_orderkey, l_linenumber, l_partkey, 'l_returnflag' AS field, 'code' AS rule, l_returnflag AS value
FROM l WHERE l_returnflag NOT IN (SELECT l_returnflag FROM l WHERE l_returnflag < 'R')
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_linestatus', 'code', l_linestatus
FROM l WHERE l_linestatus NOT IN (SELECT l_linestatus FROM l WHERE l_quantity < 2)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity', 'range', l_quantity::BIGINT::VARCHAR
FROM l, ends WHERE NOT l_quantity BETWEEN low AND high"""

    sql["unpivot_fill"] = """
SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, coalesce(nullif(l_discount, 0.05), 0) AS amount FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 'l_tax', coalesce(nullif(l_tax, 0.02), 0) FROM lineitem"""

    sql["unpivot_prefix_date"] = """
WITH o AS (SELECT o_orderpriority, o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month,
                  round(o_totalprice * 100)::BIGINT AS c FROM orders),
groups AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM o),
months AS (SELECT unnest(generate_series((SELECT min(month) FROM o)::TIMESTAMP, (SELECT max(month) FROM o)::TIMESTAMP,
                                         INTERVAL 1 MONTH))::DATE AS month),
sums AS (SELECT o_orderpriority, o_orderstatus, month, sum(c) AS c FROM o GROUP BY ALL)
SELECT g.o_orderpriority, g.o_orderstatus, m.month, s.c::DOUBLE AS cents
FROM groups g CROSS JOIN months m
LEFT JOIN sums s ON s.o_orderpriority = g.o_orderpriority AND s.o_orderstatus = g.o_orderstatus AND s.month = m.month"""

    family = "SELECT l_orderkey, l_linenumber, l_returnflag, "
    sql["two_family_union"] = f"""
{family} 'l_quantity' AS measure, l_quantity AS count, NULL::DOUBLE AS rate FROM lineitem
UNION ALL {family} 'l_linenumber', l_linenumber::DOUBLE, NULL FROM lineitem
UNION ALL {family} 'l_discount', NULL, l_discount FROM lineitem
UNION ALL {family} 'l_tax', NULL, l_tax FROM lineitem"""

    sql["pivot_wide"] = f"PIVOT (SELECT user_id, coalesce(event_type, 'NA') AS event_type, cents FROM {READINGS}) ON event_type USING round(avg(cents) / 100, 8) GROUP BY user_id"
    sql["pivot_wide_map"] = """
WITH c AS (SELECT p_brand, coalesce(p_size::VARCHAR, 'NA') AS size, max(p_partkey) AS k FROM part GROUP BY ALL)
SELECT p_brand, string_agg(size || '=' || k, ',' ORDER BY size) AS sizes FROM c GROUP BY 1"""

    sql["relabel_ordered"] = """
SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  o_orderpriority, 'URGENT', 'HIGH', 'g'), 'HIGH', 'Top', 'g'), '[0-9]-', '', 'g'), 'NOT SPECIFIED', 'None', 'g') AS label
FROM orders"""

    sql["relabel_map"] = """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Control' WHEN 'SMALL' THEN 'Inclusion' WHEN 'LARGE' THEN 'Exclusion'
                  ELSE p_type END AS label FROM part"""

    sql["composite_key"] = """
SELECT p_partkey, coalesce(nullif(p_size, 1)::VARCHAR, 'NA') || '_' || p_brand AS key,
       p_type || ' ' || coalesce(nullif(p_size, 1)::VARCHAR, 'NA') AS label FROM part"""

    sql["ordered_levels"] = f"""
SELECT CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag END AS flag, ship_year, count(*) AS n,
       sum(l_quantity) AS total, CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END::INT AS place
FROM {LINES} GROUP BY flag, ship_year"""

    sql["distinct_levels"] = "SELECT DISTINCT p_type, p_brand FROM part"

    sql["exclude_keep_null"] = """
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS notes FROM orders
WHERE NOT coalesce(contains(nullif(o_orderpriority, '5-LOW'), 'URGENT'), false)"""

    sql["conditional_exclude"] = """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem
WHERE NOT (l_returnflag = 'R' AND l_linestatus <> 'O')"""

    sql["date_set_subset"] = f"""
SELECT l_orderkey, l_linenumber, l_linestatus, ship_date, l_quantity FROM {LINES}
WHERE (l_linestatus = 'F' AND month(ship_date) IN (3, 9)) OR (l_linestatus = 'O' AND month(ship_date) IN (4, 10))"""

    sql["drop_any_null"] = """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem
WHERE nullif(l_discount, 0) IS NOT NULL AND nullif(l_tax, 0) IS NOT NULL"""

    sql["distinct_rows"] = f"""
SELECT DISTINCT l_returnflag, l_linestatus, nullif(l_linenumber, 7) AS line, l_suppkey, ship_year FROM {LINES}"""

    sql["weeks_since_start"] = f"""
WITH s AS (SELECT l_returnflag, min(ship_date) AS d0 FROM {LINES} GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, date_diff('day', d0, ship_date)::INT AS days,
       date_diff('day', d0, ship_date) / 7.0::DOUBLE AS timediff
FROM {LINES} JOIN s USING (l_returnflag)"""

    sql["days_to_anchor"] = f"""
SELECT l_orderkey, l_linenumber, date_diff('day', CASE l_returnflag WHEN 'A' THEN DATE '1998-06-21'
  WHEN 'N' THEN DATE '1997-12-21' WHEN 'R' THEN DATE '1999-03-20' END, ship_date)::INT AS days FROM {LINES}"""

    sql["parse_us_date"] = """
SELECT o_orderkey, strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y')::DATE AS order_date FROM orders"""

    sql["monthly_mean_range"] = """
SELECT o_orderstatus, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
       round(avg(round(o_totalprice * 100)::BIGINT) / 100, 6) AS price
FROM orders WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) < 2001 GROUP BY ALL"""

    sql["cell_mean_se"] = f"""
WITH c AS (SELECT l_returnflag, l_linestatus, ship_year, {SUMMARY.format('l_quantity')} FROM {LINES} GROUP BY ALL)
SELECT l_returnflag, l_linestatus, ship_year, n, {BOUNDS}, l_returnflag || ' ' || l_linestatus AS label FROM c"""

    sql["cell_mean_missing"] = """
WITH l AS (SELECT l_returnflag, l_linestatus, CASE WHEN NOT (l_quantity = 50 AND l_returnflag = 'R') THEN l_quantity END AS q
           FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n,
       round(CASE WHEN count(q) = count(*) THEN avg(q) END, 8) AS av,
       round(CASE WHEN count(q) = count(*) THEN stddev_samp(q) / sqrt(count(*)) END, 8) AS se,
       round(avg(q), 8) AS rm_av, round(stddev_samp(q) / sqrt(count(q)), 8) AS rm_se
FROM l GROUP BY ALL"""

    peaks = f"SELECT event_type, user_id, day, max(cents) AS dm FROM {READINGS} GROUP BY ALL"
    adm = f"SELECT event_type, user_id, round(avg(dm) / 100, 8) AS adm FROM ({peaks}) GROUP BY ALL"
    p99 = f"SELECT event_type, user_id, round(quantile_cont(cents::DOUBLE, 0.99) / 100, 8) AS p99 FROM {READINGS} GROUP BY ALL"
    sql["daily_max_mean"] = adm
    sql["daily_series_band"] = f"""
WITH c AS (SELECT event_type, day, {SUMMARY.format('dm')} FROM ({peaks}) GROUP BY ALL)
SELECT event_type, day, n, {BOUNDS_CENTS} FROM c"""
    sql["p99_by_group"] = p99

    fences = f"""
q AS (SELECT event_type, quantile_cont(cents::DOUBLE, 0.25) AS q1, quantile_cont(cents::DOUBLE, 0.5) AS median,
             quantile_cont(cents::DOUBLE, 0.75) AS q3 FROM {READINGS} GROUP BY 1),
f AS (SELECT r.*, q.q1, q.median, q.q3,
             r.cents BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM {READINGS} r JOIN q USING (event_type))"""
    sql["box_summary"] = f"""
WITH {fences}
SELECT event_type, count(*) AS n, round(any_value(q1) / 100, 8) AS q1, round(any_value(median) / 100, 8) AS median,
       round(any_value(q3) / 100, 8) AS q3, round(min(cents) FILTER (inside) / 100, 8) AS whisker_low,
       round(max(cents) FILTER (inside) / 100, 8) AS whisker_high,
       count(*) FILTER (NOT inside) AS outliers
FROM f GROUP BY 1"""
    sql["box_outliers"] = f"WITH {fences} SELECT event_type, user_id, day, value, cents FROM f WHERE NOT inside"

    sql["histogram_fixed"] = """
SELECT event_type, ceil(value / 10.0::DOUBLE - 0.5)::BIGINT AS bin, count(*) AS n,
       ceil(value / 10.0::DOUBLE - 0.5)::BIGINT * 10.0::DOUBLE AS centre
FROM events GROUP BY ALL"""

    sql["logit_summary"] = f"""
WITH {LOGIT}, c AS (SELECT l_returnflag, l_linestatus, ship_year, {SUMMARY.format('y')} FROM logits GROUP BY ALL)
SELECT l_returnflag, l_linestatus, ship_year, n, {BOUNDS} FROM c"""

    sql["full_join_summaries"] = f"""
SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.user_id, b.user_id) AS user_id, a.p99, b.adm
FROM ({p99}) a FULL JOIN ({adm}) b ON a.event_type = b.event_type AND a.user_id = b.user_id"""

    sql["full_join_nullsafe"] = """
WITH a AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority, count(*) AS open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
b AS (SELECT nullif(o_orderpriority, '1-URGENT') AS priority, count(*) AS closed FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT coalesce(a.priority, b.priority) AS priority, open, closed
FROM a FULL JOIN b ON a.priority IS NOT DISTINCT FROM b.priority"""

    monthly = f"""
WITH l AS (SELECT *, date_trunc('month', ship_date)::DATE AS ship_month FROM {LINES}),
c AS (SELECT l_returnflag, l_linestatus, ship_month, count(*) AS n, round(avg(l_quantity), 8) AS av FROM l GROUP BY ALL),
m AS (SELECT DISTINCT ship_month FROM l WHERE month(ship_date) IN (3, 9))
SELECT * FROM c WHERE ship_month """
    sql["analysed_semi"] = monthly + "IN (SELECT ship_month FROM m)"
    sql["nonanalysed_anti"] = monthly + "NOT IN (SELECT ship_month FROM m)"

    logfit = "regr_slope(ln(l_extendedprice), ln(l_quantity)) AS slope, regr_intercept(ln(l_extendedprice), ln(l_quantity)) AS intercept"
    sql["loglog_fit"] = f"""
WITH f AS (SELECT l_returnflag, count(*) AS n, {logfit}, regr_r2(ln(l_extendedprice), ln(l_quantity)) AS r2 FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(slope, 8) AS slope, round(intercept, 8) AS intercept, round(r2, 8) AS r2 FROM f"""
    sql["loglog_predict"] = f"""
WITH f AS (SELECT l_returnflag, {logfit} FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, round(exp(slope * ln(l_quantity) + intercept), 2) AS price
FROM lineitem JOIN f USING (l_returnflag)"""
    sql["regression_band"] = """
WITH l AS (SELECT l_returnflag, ln(l_quantity) AS x, ln(l_extendedprice) AS y FROM lineitem),
f AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
             regr_sxy(y, x) AS sxy, min(x) AS x0, max(x) AS x1 FROM l GROUP BY 1),
g AS (SELECT *, sxy / sxx AS b, sqrt((syy - sxy / sxx * sxy) / (n - 2)) AS s, unnest(range(80))::INT AS step FROM f),
h AS (SELECT *, x0 + (x1 - x0) * step / 79.0::DOUBLE AS "at" FROM g),
k AS (SELECT *, my + b * ("at" - mx) AS fit, s * sqrt(1.0::DOUBLE / n + ("at" - mx) * ("at" - mx) / sxx) AS se FROM h)
SELECT l_returnflag, step, round("at", 8) AS "at", round(fit, 8) AS fit, round(se, 8) AS se,
       round(fit - 1.96::DOUBLE * se, 8) AS lo, round(fit + 1.96::DOUBLE * se, 8) AS hi FROM k"""

    sql["expected_total"] = f"""
WITH m AS (SELECT p_brand, avg({CURVE_WEIGHT}) AS w FROM part GROUP BY 1)
SELECT p_brand, l_returnflag, sum(l_quantity)::BIGINT AS animals, round(sum(l_quantity * w), 6) AS expected
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN m USING (p_brand) GROUP BY ALL"""

    seeds = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT % 2147483647 AS c{i}" for i in range(8))
    cubics = [f"((((c{k + 3} * d + c{k + 2}) % 2147483647 * d + c{k + 1}) % 2147483647 * d + c{k}) % 2147483647)" for k in (0, 4)]
    sql["bootstrap_total"] = f"""
WITH pool AS (SELECT p_brand, {CURVE_WEIGHT} AS weight, count(*) OVER (PARTITION BY p_brand) AS pool_n,
                     row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR), p_partkey) - 1 AS slot FROM part),
sizes AS (SELECT p_brand, count(*) AS pool_n FROM part GROUP BY 1),
rows AS (SELECT l.*, p.p_brand, s.pool_n, sha256(concat_ws('|', '26', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                ship_date, p.p_brand)) AS h
         FROM {LINES} l JOIN part p ON p.p_partkey = l.l_partkey JOIN sizes s ON s.p_brand = p.p_brand),
draws AS (SELECT p_brand, l_returnflag, pool_n, {seeds}, unnest(range(1, l_quantity::BIGINT + 1)) AS d FROM rows),
keyed AS (SELECT p_brand, l_returnflag, ({cubics[0]} * 2147483647 + {cubics[1]}) % pool_n AS slot FROM draws),
sums AS (SELECT k.p_brand, k.l_returnflag, sum(weight) AS total
         FROM keyed k JOIN pool ON pool.p_brand = k.p_brand AND pool.slot = k.slot GROUP BY ALL),
sizes2 AS (SELECT p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_brand, l_returnflag, n, round(total, 6) AS total FROM sums JOIN sizes2 USING (p_brand, l_returnflag)"""

    sql["oneway_ols"] = f"""
WITH c AS (SELECT event_type, count(*) AS n, avg(cents) AS m, var_pop(cents) * count(*) AS ss FROM {READINGS} GROUP BY 1),
g AS (SELECT sum(n * m) / sum(n) AS grand FROM c),
t AS (SELECT (sum(n) - count(*))::BIGINT AS df, sum(ss) AS w, sum(n * (m - grand) * (m - grand)) AS b FROM c, g),
z AS (SELECT n AS n0, m AS m0 FROM c WHERE event_type = 'click'),
e AS (SELECT CASE WHEN event_type = 'click' THEN 'intercept' ELSE event_type END AS term,
             CASE WHEN event_type = 'click' THEN m ELSE m - m0 END AS estimate,
             sqrt(w / df * (1.0::DOUBLE / n + CASE WHEN event_type = 'click' THEN 0 ELSE 1.0::DOUBLE / n0 END)) AS se,
             df, b / (b + w) AS r2 FROM c, t, z)
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 6) AS t_value, df, round(r2, 6) AS r2 FROM e"""

    sql["anova_oneway"] = """
WITH c AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY 1),
g AS (SELECT sum(n * m) / sum(n) AS grand FROM c),
t AS (SELECT (count(*) - 1)::BIGINT AS df_between, (sum(n) - count(*))::BIGINT AS df_within,
             sum(n * (m - grand) * (m - grand)) AS ss_between, sum(ss) AS ss_within FROM c, g)
SELECT df_between, df_within, round(ss_between, 3) AS ss_between, round(ss_within, 3) AS ss_within,
       round(ss_between / df_between, 3) AS ms_between, round(ss_within / df_within, 3) AS ms_within,
       round((ss_between / df_between) / (ss_within / df_within), 8) AS f_value,
       round(ss_between / (ss_between + ss_within), 8) AS r2 FROM t"""

    n, r, o, q = "(l_returnflag = 'N')::DOUBLE", "(l_returnflag = 'R')::DOUBLE", "(l_linestatus = 'O')::DOUBLE", "l_quantity"
    sql["design_matrix"] = f"""
SELECT l_orderkey, l_linenumber, {n} AS "l_returnflag_N", {r} AS "l_returnflag_R", {o} AS "l_linestatus_O", {q} AS quantity,
  {n} * {o} AS "l_returnflag_N_x_l_linestatus_O", {r} * {o} AS "l_returnflag_R_x_l_linestatus_O",
  {n} * {q} AS "l_returnflag_N_x_quantity", {r} * {q} AS "l_returnflag_R_x_quantity", {o} * {q} AS "l_linestatus_O_x_quantity",
  {n} * {o} * {q} AS "l_returnflag_N_x_l_linestatus_O_x_quantity", {r} * {o} * {q} AS "l_returnflag_R_x_l_linestatus_O_x_quantity"
FROM lineitem"""

    sql["coef_table"] = saturated("lineitem", "l_quantity", "identity", "1.0", True)
    sql["glm_tweedie_cells"] = saturated("lineitem", "l_discount", "log", "pow(m, 1.5)", True)
    sql["glm_quasipoisson_cells"] = saturated("lineitem", "l_quantity", "log", "m", True)
    sql["glm_negbin2_cells"] = saturated("lineitem", "l_quantity", "log", "m + a * m * m", False, alpha=True)
    sql["glm_logit_gaussian_cells"] = saturated("logits", "y", "identity", "1.0", True, prelude=LOGIT)

    sql["glm_gaussian_slopes"] = f"""
WITH l AS (SELECT l_returnflag AS k, l_quantity AS y,
                  (date_diff('day', DATE '1995-01-01', ship_date) // 91) / 4.0::DOUBLE AS x FROM {LINES}),
f AS (SELECT k, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
             regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) AS rss FROM l GROUP BY 1),
s AS (SELECT sum(rss) / (sum(n) - 6) AS s2 FROM f),
g AS (SELECT f.*, s2 * (1.0::DOUBLE / n + mx * mx / sxx) AS va, s2 / sxx AS vb FROM f, s),
z AS (SELECT a AS a0, b AS b0, va AS va0, vb AS vb0 FROM g WHERE k = 'A'),
e AS (SELECT 'intercept' AS term, a0 AS estimate, sqrt(va0) AS se FROM z
      UNION ALL SELECT 'years', b0, sqrt(vb0) FROM z
      UNION ALL SELECT 'l_returnflag_' || k, a - a0, sqrt(va + va0) FROM g, z WHERE k <> 'A'
      UNION ALL SELECT 'l_returnflag_' || k || '_x_years', b - b0, sqrt(vb + vb0) FROM g, z WHERE k <> 'A')
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 6) AS statistic FROM e"""

    sql["wald_tests"] = """
WITH c AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*)::DOUBLE AS n, avg(l_quantity) AS m,
                  var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY ALL),
phi AS (SELECT sum(ss / m) / (sum(n) - 6) AS phi FROM c),
w AS (SELECT f, s, ln(m) AS y, n * m / phi AS w FROM c, phi),
gap AS (SELECT o.f, o.y - a.y AS d, 1 / (1 / o.w + 1 / a.w) AS w FROM w o JOIN w a ON a.f = o.f AND a.s = 'F' WHERE o.s = 'O'),
middle AS (SELECT sum(w * d) / sum(w) AS d, sum(w) AS w FROM gap),
crossing AS (SELECT sum(g.w * (g.d - middle.d) * (g.d - middle.d)) AS x FROM gap g, middle),
status AS (SELECT s, sum(w * y) / sum(w) AS y FROM w GROUP BY 1),
flags AS (SELECT sum(w.w * (w.y - status.y) * (w.y - status.y)) AS x FROM w JOIN status USING (s))
SELECT 'l_returnflag' AS term, 2 AS df, round(flags.x - crossing.x, 6) AS statistic FROM flags, crossing
UNION ALL SELECT 'l_linestatus', 1, round(w * d * d, 6) FROM middle
UNION ALL SELECT 'l_returnflag:l_linestatus', 2, round(x, 6) FROM crossing"""

    sql["glm_negbin2_likelihood"] = """
WITH RECURSIVE c AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
lattice AS (SELECT unnest(range((SELECT max(l_quantity)::BIGINT FROM lineitem))) AS k),
above AS (SELECT k, count(*)::DOUBLE AS n FROM lattice JOIN lineitem ON l_quantity > k GROUP BY 1),
halves(step, low, high) AS (
  SELECT 0, ln(1e-3::DOUBLE), ln(1e6::DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN score > 0 THEN t ELSE low END, CASE WHEN score > 0 THEN high ELSE t END
  FROM (SELECT *, (low + high) / 2 AS t,
               (SELECT sum(n / (exp((low + high) / 2) + k)) FROM above)
               - (SELECT sum(n * ln(1 + m / exp((low + high) / 2))) FROM c) AS score FROM halves WHERE step < 60)),
size AS (SELECT exp((low + high) / 2) AS theta FROM halves WHERE step = 60),
cells AS (SELECT f, ln(m) AS y, (1 / m + 1 / theta) / n AS v, theta FROM c, size),
e AS (SELECT CASE WHEN f = 'A' THEN 'intercept' ELSE 'l_returnflag_' || f END AS term,
             CASE WHEN f = 'A' THEN y ELSE y - (SELECT y FROM cells WHERE f = 'A') END AS estimate,
             sqrt(v + CASE WHEN f = 'A' THEN 0 ELSE (SELECT v FROM cells WHERE f = 'A') END) AS se, theta FROM cells)
SELECT term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 6) AS statistic, round(theta, 6) AS theta FROM e"""

    sql["dispersion_cells"] = """
WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss
           FROM lineitem GROUP BY ALL)
SELECT l_linestatus, sum(n)::BIGINT AS rows, round(sum(ss / m) / sum(n), 6) AS dispersion FROM c GROUP BY 1"""

    sql["dispersion_by_level"] = f"""
WITH {RESIDUALS} SELECT l_returnflag, ship_year, count(*) AS rows, round(avg(r * r), 8) AS dispersion FROM res GROUP BY ALL"""

    sql["durbin_watson"] = f"""
WITH {RESIDUALS},
t AS (SELECT l_returnflag, ship_date, avg(r) AS r FROM res GROUP BY ALL),
c AS (SELECT l_returnflag, ship_date, r - avg(r) OVER (PARTITION BY l_returnflag) AS r FROM t),
g AS (SELECT *, r - lag(r) OVER (PARTITION BY l_returnflag ORDER BY ship_date) AS gap FROM c),
d AS (SELECT l_returnflag, count(*) AS n_times, sum(gap * gap) / sum(r * r) AS dw FROM g GROUP BY 1)
SELECT l_returnflag, n_times, round(dw, 8) AS dw, round(1 - dw / 2, 8) AS r1,
       round((dw - 2) / sqrt(4.0::DOUBLE * (n_times - 2) / ((n_times - 1) * (n_times + 1.0::DOUBLE))), 8) AS z FROM d"""

    sql["residual_summary"] = f"""
WITH {RESIDUALS},
q AS (SELECT l_returnflag, ship_year, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median,
             quantile_cont(r, 0.75) AS q3 FROM res GROUP BY ALL),
f AS (SELECT res.*, q1, median, q3, r BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM res JOIN q USING (l_returnflag, ship_year))
SELECT l_returnflag, ship_year, count(*) AS n, round(any_value(q1), 8) AS q1, round(any_value(median), 8) AS median,
       round(any_value(q3), 8) AS q3, round(min(r) FILTER (inside), 8) AS whisker_low,
       round(max(r) FILTER (inside), 8) AS whisker_high, count(*) FILTER (NOT inside) AS outliers,
       round(avg(r), 8) AS av, round(stddev_samp(r), 8) AS sd
FROM f GROUP BY ALL"""
    placed = """
WITH RECURSIVE c AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n, avg(l_quantity) AS mu, var_pop(l_quantity) * count(*) AS ss, max(l_quantity)::BIGINT AS top
  FROM lineitem GROUP BY ALL),
d AS (SELECT sum(ss / mu) / (sum(n) - count(*)) AS phi FROM c),
s AS (SELECT l_returnflag, l_linestatus, mu, top, mu / (phi - 1) AS size FROM c, d),
lattice AS (SELECT *, unnest(range(top + 1)) AS k FROM s),
steps AS (SELECT *, CASE WHEN k = 0 THEN -size * ln(1 + mu / size) ELSE ln((k - 1 + size) / k) + ln(mu / (mu + size)) END AS step FROM lattice),
masses AS (SELECT *, exp(sum(step) OVER w) AS mass FROM steps WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY k ROWS UNBOUNDED PRECEDING)),
tails AS (SELECT *, sum(mass) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM masses),
placed AS (SELECT l.l_returnflag, l.l_linestatus, upto - mass
    + (('0x' || substr(sha256(concat_ws('|', '26', l_orderkey, l_linenumber, l_partkey)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE * mass AS scaled
  FROM lineitem l JOIN tails t ON t.l_returnflag = l.l_returnflag AND t.l_linestatus = l.l_linestatus AND t.k = l.l_quantity)"""
    sql["sim_residuals_cells"] = f"""{placed}
SELECT l_returnflag, l_linestatus, least(floor(scaled * 10), 9)::INT AS tenth, count(*) AS n, round(avg(scaled), 6) AS av FROM placed GROUP BY ALL"""
    sql["residual_uniformity"] = f"""{placed},
ranked AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS size FROM placed
           WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY scaled)),
k AS (SELECT l_returnflag, l_linestatus, count(*) AS n, max(greatest(r / size::DOUBLE - scaled, scaled - (r - 1) / size::DOUBLE)) AS ks,
             count(*) FILTER (scaled < 1 / 251.0::DOUBLE) AS low_outliers, count(*) FILTER (scaled > 1 - 1 / 251.0::DOUBLE) AS high_outliers,
             12 * var_pop(scaled) AS spread FROM ranked GROUP BY ALL),
x AS (SELECT *, ks * (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) AS x FROM k)
SELECT l_returnflag, l_linestatus, n, round(ks, 6) AS ks,
       round(CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(
         (SELECT sum(CASE WHEN i % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * i * i * x * x)) FROM range(1, 101) t(i)), 0), 1) END, 6) AS p_value,
       low_outliers, high_outliers, round(n * 2 / 251.0::DOUBLE, 6) AS expected_outliers, round(spread, 6) AS spread FROM x"""
    sql["lm_diagnostics"] = f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity,
                  (date_diff('day', DATE '1995-01-01', ship_date) // 91) / 4.0::DOUBLE AS x FROM {LINES}),
f AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mx, regr_sxx(l_quantity, x) AS sxx, regr_slope(l_quantity, x) AS b,
             regr_intercept(l_quantity, x) AS a,
             regr_syy(l_quantity, x) - regr_sxy(l_quantity, x) * regr_sxy(l_quantity, x) / regr_sxx(l_quantity, x) AS rss FROM l GROUP BY 1),
s AS (SELECT sum(rss) / (sum(n) - 6) AS s2 FROM f),
d AS (SELECT l.*, a + b * x AS mu, l_quantity - a - b * x AS residual, 1.0::DOUBLE / n + (x - mx) * (x - mx) / sxx AS h, s2
      FROM l JOIN f USING (l_returnflag), s)
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, round(mu, 6) AS mu, round(residual, 6) AS residual,
       round(h * 1000, 6) AS leverage, round(residual / sqrt(s2 * (1 - h)), 6) AS standardised,
       round(residual * residual / (s2 * (1 - h)) * h / (1 - h) / 6 * 1000, 6) AS cook FROM d"""
    return sql
