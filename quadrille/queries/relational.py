"""Scans, projections, filters, joins, aggregates, windows, set operations, subqueries and scalar functions.

Each is SQL text run by the engine's own front end over views of the tables; where the oracle needs other words for the
same rows, the second text is DuckDB's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quadrille.plans.literals import demote, dialect, fold_casts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: FLOAT columns of the views below.
FLOATS = {"bal_f"}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Views of the tables that ``text`` names; a lazy registration without any scan."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(demote(fold_casts(dialect(text)), FLOATS))

    return run


#: name -> (text, DuckDB text where it differs)
TEXTS: dict[str, tuple[str, str | None]] = {
    # scans and projection
    "scan_count": ("SELECT count(*) AS n FROM lineitem", None),
    "project_columns": ("SELECT o_orderkey, o_totalprice, o_orderkey AS again FROM orders", None),
    "project_expressions": ("SELECT c_custkey, c_acctbal * 2 + 1 AS twice, -c_acctbal AS minus FROM customer", None),
    "project_filter_cte": ("WITH rich AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal > 5000) SELECT c_custkey, c_acctbal FROM rich WHERE c_nationkey < 10", None),
    # filters
    "filter_and_or": ("SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000 AND o_orderstatus = 'F') OR o_orderpriority = '1-URGENT'", None),
    "filter_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000)", None),
    "filter_equals_flipped": ("SELECT p_partkey FROM part WHERE 10 = p_size", None),
    "filter_is_null": ("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer) x WHERE n IS NULL", None),
    "filter_is_not_null": ("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer) x WHERE n IS NOT NULL AND n <> 4", None),
    "filter_comparisons": ("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_size <> 15 AND p_retailprice <= 1500", None),
    "filter_like": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_mktsegment LIKE 'B%'", None),
    "filter_like_escape": (r"SELECT c_custkey FROM (SELECT c_custkey, concat(c_name, '_%') AS s FROM customer) x WHERE s LIKE '%!_!%' ESCAPE '!'", None),
    "filter_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 5, 9, 100, 111)", None),
    "filter_not_in": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)", None),
    "filter_not_in_null": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, NULL)", None),
    "filter_in_or_null": ("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer) x WHERE n IN (1, 2) OR n IS NULL", None),
    "filter_between": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08", None),
    "filter_range_union": ("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size BETWEEN 20 AND 25 OR p_size > 45", None),
    "filter_timestamp": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'", None),
    "filter_timestamp_string": ("SELECT o_orderkey FROM orders WHERE o_orderdate > '1997-06-01 00:00:00'", None),
    "filter_number_string": ("SELECT p_partkey FROM part WHERE p_size > '40'", None),
    "filter_residual": ("SELECT c_custkey FROM customer WHERE cos(c_acctbal) > 0 AND c_acctbal > 100", None),
    "filter_fid": ("SELECT fid, c_name FROM (SELECT concat('#', c_custkey) AS fid, c_name FROM customer) x WHERE fid = '#17' OR fid IN ('#3', '#8', '#99999999')", None),
    "filter_float_literal": (
        "SELECT c_custkey FROM (SELECT c_custkey, CAST(c_custkey / 10.0D AS FLOAT) AS bal_f FROM customer) x WHERE bal_f = 2.6 OR bal_f IN (0.1, 0.7) OR bal_f BETWEEN 3.1 AND 3.3",
        "SELECT c_custkey FROM (SELECT c_custkey, CAST(c_custkey / CAST(10 AS DOUBLE) AS FLOAT) AS bal_f FROM customer) x WHERE bal_f = CAST(2.6 AS FLOAT) OR bal_f IN (CAST(0.1 AS FLOAT), CAST(0.7 AS FLOAT)) OR bal_f BETWEEN CAST(3.1 AS FLOAT) AND CAST(3.3 AS FLOAT)",
    ),
    "filter_cast_decimal": ("SELECT c_custkey FROM customer WHERE c_custkey / 10.0D = CAST(2.6 AS DECIMAL) OR c_custkey / 10.0D = CAST(0.7 AS REAL)", "SELECT c_custkey FROM customer WHERE c_custkey IN (26, 7)"),
    "filter_distinct_from": ("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer) x WHERE n IS DISTINCT FROM 4", None),
    "filter_similar": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*')"),
    "filter_truth": ("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) < 5 AS t FROM customer) x WHERE t IS TRUE OR t IS UNKNOWN", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) < 5 AS t FROM customer) x WHERE t IS NOT FALSE"),
    # joins
    "join_lookup": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 300000", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", None),
    "join_right": ("SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", None),
    "join_full": ("SELECT a.c_custkey AS a, b.c_custkey AS b FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_nationkey > 8) b ON a.c_custkey = b.c_custkey", None),
    "join_computed_key": ("SELECT a.p_partkey AS a, b.s_suppkey AS b FROM part a JOIN supplier b ON a.p_size * 2 = b.s_suppkey * 4", None),
    "join_residual": ("SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity > 48", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 3", None),
    "join_using": ("SELECT k, v, w FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b USING (k)", None),
    "join_natural": ("SELECT k, v, w FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) b", None),
    "join_semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "join_semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", None),
    "join_anti_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "join_anti_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "join_limited_side": ("SELECT x.o_orderkey, c.c_name FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) x JOIN customer c ON x.o_custkey = c.c_custkey", None),
    "join_lateral": ("SELECT n.n_name, t.top FROM nation n, LATERAL (SELECT max(s_acctbal) AS top FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t", None),
    # aggregates
    "agg_count_min_max": ("SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day FROM orders", None),
    "agg_group_one": ("SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey", None),
    "agg_distinct_column": ("SELECT DISTINCT o_orderpriority FROM orders", None),
    "agg_distinct_many": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "agg_group_many": ("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_group_boolean": ("SELECT c_acctbal > 0 AS pos, count(*) AS n, max(c_nationkey = 3) AS any3 FROM customer GROUP BY c_acctbal > 0", None),
    "agg_nested": ("SELECT max(n) AS most, count(*) AS keys FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) x", None),
    "agg_filtered_limit": ("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20", None),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND o_custkey > 10", None),
    "agg_empty": ("SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_orderkey < 0", None),
    "agg_null_group": ("SELECT n, count(*) AS rows_in FROM (SELECT nullif(c_nationkey, 3) AS n FROM customer) x GROUP BY n", None),
    "agg_sum_avg": ("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS mean, count(l_tax) AS n FROM lineitem GROUP BY l_returnflag", None),
    "agg_count_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus", None),
    "agg_deviation": ("SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY l_linestatus", None),
    "agg_covariance": ("SELECT round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, regr_count(l_quantity, l_tax) AS n FROM lineitem", None),
    "agg_every_some": ("SELECT c_nationkey, every(c_acctbal > -900) AS all_ok, some(c_acctbal > 9900) AS any_rich FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, bool_and(c_acctbal > -900) AS all_ok, bool_or(c_acctbal > 9900) AS any_rich FROM customer GROUP BY c_nationkey"),
    "agg_bits": ("SELECT c_nationkey, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x FROM customer GROUP BY c_nationkey", None),
    "agg_listagg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_collect": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_percentile": ("SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM lineitem GROUP BY l_returnflag", None),
    "agg_filter_clause": ("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) AS n FROM orders GROUP BY o_orderstatus", None),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "agg_approx_distinct": ("SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS close FROM orders", "SELECT true AS close"),
    "agg_any_value": ("SELECT c_nationkey, any_value(c_nationkey) AS v FROM customer GROUP BY c_nationkey", None),
    # sort, limit
    "limit_offset_fetch": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 ROWS FETCH NEXT 10 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "limit_offset_only": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20 ROWS", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "limit_fetch_zero": ("SELECT n_nationkey FROM nation OFFSET 2 ROWS FETCH NEXT 0 ROWS ONLY", "SELECT n_nationkey FROM nation LIMIT 0"),
    "limit_top_k": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 15", None),
    "limit_over_residual": ("SELECT c_custkey FROM customer WHERE cos(c_acctbal) > 0 ORDER BY c_custkey LIMIT 7", None),
    "sort_nulls": ("SELECT c_custkey, n FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer) x ORDER BY n ASC NULLS FIRST, c_custkey", None),
    # set operations, CTE, values, subqueries
    "set_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "set_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", None),
    "set_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "set_except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "set_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "set_minus": ("SELECT c_custkey AS k FROM customer MINUS SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "cte_two": ("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey FROM a WHERE s > 1500000) SELECT c_name FROM customer JOIN b ON c_custkey = o_custkey", None),
    "values_rows": ("SELECT * FROM (VALUES (1, 'a', TIMESTAMP '2022-05-01 12:10:23'), (2, NULL, NULL)) AS t(i, s, ts)", None),
    "subquery_scalar": ("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "subquery_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "subquery_all": ("SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)", None),
    "subquery_any": ("SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier)", None),
    # windows
    "window_ranks": ("SELECT c_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, ntile(4) OVER w AS nt FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)", None),
    "window_offsets": ("SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0.0D) OVER w AS nxt, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0.0) OVER w AS nxt, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "window_last_value": ("SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders", None),
    "window_rows_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders", None),
    "window_range_frame": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part", None),
    "window_relative": ("SELECT c_custkey, percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS pr, cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS cd FROM customer", None),
    "window_qualify": ("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer QUALIFY rn <= 2", None),
    "window_tumble": ("SELECT w.start AS window_start, event_type, n FROM (SELECT window(ts, '1 hour') AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type) x", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "window_hop": ("SELECT w.start AS window_start, count(*) AS n FROM (SELECT window(ts, '2 hours', '1 hour') AS w FROM events) x GROUP BY w.start", "SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s"),
    "window_session": (
        "SELECT user_id, w.start AS session_start, n FROM (SELECT user_id, session_window(ts, '30 minutes') AS w, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')) x",
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
    ),
    # scalar functions
    "fn_math": ("SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, sign(c_acctbal) AS s, round(sqrt(abs(c_acctbal)), 6) AS q, round(cbrt(c_acctbal), 6) AS cb, round(power(c_custkey, 2), 2) AS p, round(ln(c_custkey + 1), 8) AS l, round(log10(c_custkey + 1), 8) AS l10, round(exp(c_nationkey / 10.0D), 6) AS e, mod(c_custkey, 7) AS m FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS DOUBLE) AS s, round(sqrt(abs(c_acctbal)), 6) AS q, round(cbrt(c_acctbal), 6) AS cb, round(power(c_custkey, 2), 2) AS p, round(ln(c_custkey + 1), 8) AS l, round(log10(c_custkey + 1), 8) AS l10, round(exp(c_nationkey / CAST(10 AS DOUBLE)), 6) AS e, mod(c_custkey, 7) AS m FROM customer"),
    "fn_trigonometry": ("SELECT c_custkey, round(sin(c_custkey), 8) AS s, round(cos(c_custkey), 8) AS c, round(tan(c_nationkey), 6) AS t, round(cot(c_nationkey + 1), 6) AS ct, round(asin(c_nationkey / 25.0D), 8) AS a1, round(acos(c_nationkey / 25.0D), 8) AS a2, round(atan(c_custkey), 8) AS a3, round(atan2(c_custkey, 3), 8) AS a4, round(degrees(c_nationkey), 6) AS d, round(radians(c_nationkey), 8) AS r, round(pi(), 8) AS p FROM customer", "SELECT c_custkey, round(sin(c_custkey), 8) AS s, round(cos(c_custkey), 8) AS c, round(tan(c_nationkey), 6) AS t, round(cot(c_nationkey + 1), 6) AS ct, round(asin(c_nationkey / CAST(25 AS DOUBLE)), 8) AS a1, round(acos(c_nationkey / CAST(25 AS DOUBLE)), 8) AS a2, round(atan(c_custkey), 8) AS a3, round(atan2(c_custkey, 3), 8) AS a4, round(degrees(c_nationkey), 6) AS d, round(radians(c_nationkey), 8) AS r, round(pi(), 8) AS p FROM customer"),
    "fn_truncate": ("SELECT c_custkey, CAST(TRUNCATE(c_acctbal) AS BIGINT) AS t FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS t FROM customer"),
    "fn_string": ("SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, initcap(lower(c_mktsegment)) AS i, trim(concat('  ', c_name, ' ')) AS t, substring(c_name, 2, 5) AS s, replace(c_name, '0', 'o') AS r, char_length(c_name) AS n, position('#' IN c_name) AS p, c_name || '-' || c_mktsegment AS j FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i, trim(concat('  ', c_name, ' ')) AS t, substring(c_name, 2, 5) AS s, replace(c_name, '0', 'o') AS r, length(c_name) AS n, position('#' IN c_name) AS p, c_name || '-' || c_mktsegment AS j FROM customer"),
    "fn_trim_overlay": ("SELECT n_nationkey, ltrim(concat('  ', n_name)) AS l, rtrim(concat(n_name, '  ')) AS r, overlay(n_name PLACING 'XX' FROM 2 FOR 1) AS o FROM nation", "SELECT n_nationkey, ltrim(concat('  ', n_name)) AS l, rtrim(concat(n_name, '  ')) AS r, n_name[1] || 'XX' || n_name[3:] AS o FROM nation"),
    "fn_date": ("SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, date_trunc('MONTH', o_orderdate) AS mm, quarter(o_orderdate) AS q FROM orders", None),
    "fn_date_arithmetic": ("SELECT o_orderkey, timestampadd(DAY, 10, o_orderdate) AS later, o_orderdate + INTERVAL 2 HOUR AS two, timestampdiff(DAY, o_orderdate, TIMESTAMP_NTZ '2000-01-01 00:00:00') AS days FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS later, o_orderdate + INTERVAL 2 HOUR AS two, CAST(floor(epoch(TIMESTAMP '2000-01-01 00:00:00' - o_orderdate) / 86400) AS BIGINT) AS days FROM orders"),
    "fn_current": ("SELECT current_date() IS NOT NULL AS d, current_timestamp() IS NOT NULL AS t, localtimestamp() IS NOT NULL AS l", "SELECT true AS d, true AS t, true AS l"),
    "fn_conditional": ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS k, coalesce(nullif(c_nationkey, 3), -1) AS n, greatest(c_nationkey, 5) AS g, least(c_nationkey, 5) AS l FROM customer", None),
    "fn_cast_literals": ("SELECT CAST('12' AS INT) AS i, CAST(3.7 AS DOUBLE) AS d, CAST('2022-05-01 00:00:01' AS TIMESTAMP_NTZ) AS t, hex(X'00010203') AS b, CAST(NULL AS STRING) AS s", "SELECT 12 AS i, CAST(3.7 AS DOUBLE) AS d, TIMESTAMP '2022-05-01 00:00:01' AS t, '00010203' AS b, CAST(NULL AS VARCHAR) AS s"),
    "fn_collections": ("SELECT n_nationkey, size(array(n_nationkey, n_regionkey)) AS n, array(n_nationkey, n_regionkey)[1] AS second, map('a', n_regionkey)['a'] AS m, named_struct('x', n_name).x AS x FROM nation", "SELECT n_nationkey, 2 AS n, n_regionkey AS second, n_regionkey AS m, n_name AS x FROM nation"),
    "fn_unnest": ("SELECT n_nationkey, e FROM nation LATERAL VIEW explode(array(n_regionkey, n_nationkey)) t AS e", "SELECT n_nationkey, unnest([n_regionkey, n_nationkey]) AS e FROM nation"),
    "fn_json": ("SELECT event_id, props IS NOT NULL AS has, to_json(named_struct('id', event_id)) AS o, to_json(array(event_id, 1)) AS a, JSON_VALUE(concat('{\"v\":', event_id, '}'), 'lax $.v') AS v FROM events", "SELECT event_id, props IS NOT NULL AS has, '{\"id\":' || event_id || '}' AS o, '[' || event_id || ',1]' AS a, CAST(event_id AS VARCHAR) AS v FROM events"),
    "fn_random": ("SELECT count(*) AS n FROM orders WHERE rand() BETWEEN 0 AND 1", "SELECT count(*) AS n FROM orders"),
    "sample_rows": ("SELECT count(*) <= (SELECT count(*) FROM orders) AS ok FROM orders TABLESAMPLE (50 PERCENT)", "SELECT true AS ok"),
}

QUERIES = {name: _query(text) for name, (text, _) in TEXTS.items()}
ORACLES = {name: other or text for name, (text, other) in TEXTS.items()}
