"""The registered queries of the dialect over the Parquet tables, and the DuckDB SQL each is held against."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import uuid
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from veldt import sinks
from veldt.session import Engine
from veldt.sources import files
from veldt.sources.snapshots import folder

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

QUERIES: dict[str, tuple[str, str]] = {
    # Projection, filters, predicates
    "scan_project": (
        "SELECT l_orderkey AS okey, l_partkey AS pkey, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS status, l_discount AS disc FROM lineitem",
        "SELECT l_orderkey AS okey, l_partkey AS pkey, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS status, l_discount AS disc FROM lineitem",
    ),
    "project_star": ("FROM nation", "SELECT * FROM nation"),
    "project_qualified_star": ("FROM nation AS n, region AS r ON n.n_regionkey = r.r_regionkey SELECT r.*, n_name", "SELECT r.*, n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "clause_order": ("FROM nation WHERE n_regionkey = 1 SELECT n_name, n_nationkey ORDER BY n_name LIMIT 3", "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 3"),
    "filter_compare": (
        "FROM orders WHERE o_totalprice > 150000 AND o_orderstatus != 'F' AND o_orderdate >= '1995-06-01' SELECT o_orderkey, o_custkey",
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus != 'F' AND o_orderdate >= DATE '1995-06-01'",
    ),
    "filter_flipped": ("SELECT o_orderkey FROM orders WHERE '1996-01-01' < o_orderdate AND 100 >= o_custkey", "SELECT o_orderkey FROM orders WHERE o_orderdate > DATE '1996-01-01' AND o_custkey <= 100"),
    "filter_between": ("FROM part WHERE p_size BETWEEN 10 AND 20 SELECT p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20"),
    "filter_between_exclusive": (
        "FROM orders WHERE o_orderdate BETWEEN '1995-01-01' ANDX '1995-02-01' SELECT o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-02-01'",
    ),
    "filter_in": ("FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13) SELECT o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13)"),
    "filter_like_prefix": ("FROM part WHERE p_type LIKE 'S%' SELECT p_partkey, p_type", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')"),
    "filter_like_exact": ("FROM nation WHERE n_name LIKE 'NATION_3' SELECT n_nationkey", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'"),
    "filter_is": ("FROM customer WHERE c_mktsegment IS 'BUILDING' AND c_nationkey IS NOT 7 SELECT c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey != 7"),
    "filter_null": (
        "FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE s_suppkey IS NULL SELECT n_name",
        "SELECT n_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE s_suppkey IS NULL",
    ),
    "filter_alias": ("SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE twice > 90", "SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity * 2 > 90"),
    "predicate_value": ("SELECT o_orderkey, o_totalprice > 100000 AS big, o_orderstatus = 'O' AS is_open FROM orders", "SELECT o_orderkey, (o_totalprice > 100000)::INT AS big, (o_orderstatus = 'O')::INT AS is_open FROM orders"),
    "constants_and_comments": (
        "SELECT 'it''s' AS quoted, 0x1F AS hex, NULL AS nothing -- a remark\n, 1 + 2 * 3 AS seven /* and more */",
        "SELECT 'it''s' AS quoted, 31 AS hex, NULL::VARCHAR AS nothing, 7 AS seven",
    ),
    "star_function": ("FROM region SELECT LENGTH(*) AS len_", "SELECT strlen(r_regionkey::VARCHAR) AS len_r_regionkey, strlen(r_name) AS len_r_name FROM region"),
    # Joins
    "join_inner_equi": (
        "FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' SELECT o_orderkey, c_name, o_totalprice",
        "SELECT o_orderkey, c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "join_left": ("FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 SELECT c_custkey, o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"),
    "join_left_where": ("FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' SELECT c_custkey, o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'"),
    "join_theta": ("FROM nation AS a, nation AS b ON a.n_nationkey < b.n_nationkey SELECT a.n_name AS low, b.n_name AS high", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "join_cross": ("FROM region, nation SELECT r_name || '/' || n_name AS pair", "SELECT r_name || '/' || n_name AS pair FROM region, nation"),
    "join_constant": ("FROM region LEFT JOIN nation ON n_regionkey = 2 SELECT r_name, n_name", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = 2"),
    "join_using": ("FROM labels AS a JOIN labels AS b USING doc_id SELECT a.doc_id AS doc_id, b.quality AS quality", "SELECT a.doc_id, b.quality FROM labels a JOIN labels b ON a.doc_id = b.doc_id"),
    "join_using_function": ("FROM region AS a JOIN region AS b USING LENGTH(r_name) SELECT a.r_name AS x, b.r_name AS y", "SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON strlen(a.r_name) = strlen(b.r_name)"),
    "join_self": ("FROM supplier AS s1, supplier AS s2 ON s1.s_nationkey = s2.s_nationkey WHERE s1.s_suppkey < s2.s_suppkey SELECT s1.s_suppkey AS a, s2.s_suppkey AS b", "SELECT s1.s_suppkey AS a, s2.s_suppkey AS b FROM supplier s1 JOIN supplier s2 ON s1.s_nationkey = s2.s_nationkey WHERE s1.s_suppkey < s2.s_suppkey"),
    "join_multi": (
        "FROM customer, orders ON c_custkey = o_custkey, nation ON c_nationkey = n_nationkey, region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name SELECT n_name, COUNT(*) AS n",
        "SELECT n_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    ),
    "join_expression": ("FROM nation JOIN region ON n_regionkey + 1 = r_regionkey SELECT n_name, r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 1 = r_regionkey"),
    "join_range": (
        "FROM part AS p JOIN nation AS n ON p.p_size > n.n_nationkey AND p.p_size <= n.n_nationkey + 2 SELECT p_partkey, n_nationkey",
        "SELECT p_partkey, n_nationkey FROM part p JOIN nation n ON p.p_size > n.n_nationkey AND p.p_size <= n.n_nationkey + 2",
    ),
    # Aggregation
    "agg_global": (
        "FROM lineitem SELECT COUNT(*) AS n, COUNT(l_returnflag) AS flags, MIN(l_quantity) AS low, MAX(l_quantity) AS high, SUM(l_quantity) AS total, AVG(l_quantity) AS mean",
        "SELECT count(*) AS n, count(l_returnflag) AS flags, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_quantity) AS total, avg(l_quantity) AS mean FROM lineitem",
    ),
    "agg_group": (
        "FROM lineitem GROUP BY l_returnflag SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS qty, SUM(CAST(l_extendedprice AS INT)) AS price",
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty, sum(trunc(l_extendedprice)::BIGINT)::BIGINT AS price FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_group_alias": ("SELECT EXTRACT(WEEKDAY FROM o_orderdate) AS day, COUNT(*) AS n FROM orders GROUP BY day", "SELECT isodow(o_orderdate) AS day, count(*) AS n FROM orders GROUP BY 1"),
    "agg_group_expr": ("FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate) SELECT EXTRACT(YEAR FROM o_orderdate) AS year, COUNT(*) AS n", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1"),
    "agg_multi_key": ("FROM lineitem GROUP BY l_returnflag, l_linestatus SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"),
    "agg_filter": (
        "FROM orders SELECT COUNT(*) AS every, COUNT(*) FILTER (WHERE o_custkey % 2 = 0) AS even, SUM(o_custkey) FILTER(WHERE o_orderstatus = 'F') AS f, MAX(o_custkey) FILTER (WHERE o_totalprice > 250000) AS big",
        "SELECT count(*) AS every, count(*) FILTER (o_custkey % 2 = 0) AS even, sum(o_custkey) FILTER (o_orderstatus = 'F')::BIGINT AS f, max(o_custkey) FILTER (o_totalprice > 250000) AS big FROM orders",
    ),
    "agg_listagg": ("FROM nation GROUP BY n_regionkey SELECT n_regionkey, LISTAGG(n_name) AS names", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "agg_star": ("FROM region SELECT MAX(*) AS max_", "SELECT max(r_regionkey) AS max_r_regionkey, max(r_name) AS max_r_name FROM region"),
    "agg_dates": ("FROM orders SELECT MIN(o_orderdate) AS first, MAX(o_orderdate) AS last, MIN(o_orderpriority) AS p", "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_orderpriority) AS p FROM orders"),
    "agg_nested": ("FROM part GROUP BY p_brand SELECT p_brand, SUM(p_size) * 2 + COUNT(*) AS score", "SELECT p_brand, (sum(p_size) * 2 + count(*))::BIGINT AS score FROM part GROUP BY 1"),
    "agg_group_order_limit": (
        "FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey SELECT o_custkey, COUNT(*) AS n LIMIT 10",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10",
    ),
    "agg_like_group_order": ("FROM customer WHERE c_name LIKE 'Customer#0000000%' GROUP BY c_mktsegment ORDER BY total DESC SELECT c_mktsegment, COUNT(*) AS n, SUM(c_nationkey) AS total", "SELECT c_mktsegment, count(*) AS n, sum(c_nationkey)::BIGINT AS total FROM customer WHERE starts_with(c_name, 'Customer#0000000') GROUP BY 1"),
    # Sort, limit, row numbers
    "sort_multi": ("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey ASC", "SELECT c_mktsegment, c_custkey FROM customer"),
    "sort_expression": ("SELECT n_name FROM nation ORDER BY LENGTH(n_name), n_name DESC FETCH FIRST 7 ROWS ONLY", "SELECT n_name FROM nation ORDER BY strlen(n_name), n_name DESC LIMIT 7"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 40 ROWS FETCH NEXT 15 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 40"),
    "fetch_first_row": ("SELECT r_name FROM region ORDER BY r_name FETCH FIRST ROW ONLY", "SELECT r_name FROM region ORDER BY r_name LIMIT 1"),
    "row_number": ("SELECT ROW_NUMBER() AS rn, n_name FROM nation ORDER BY n_name DESC OFFSET 2 ROWS LIMIT 9", "SELECT row_number() OVER (ORDER BY n_name DESC) AS rn, n_name FROM (SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 9 OFFSET 2)"),
    "row_number_all": ("SELECT ROW_NUMBER() AS rn, o_orderkey FROM orders ORDER BY o_orderkey", "SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_orderkey FROM orders"),
    "rowid": ("SELECT rowid AS id, r_name FROM region WHERE rowid > 1", "SELECT file_row_number AS id, r_name FROM (SELECT row_number() OVER () - 1 AS file_row_number, r_name FROM region) WHERE file_row_number > 1"),
    # Functions
    "fn_string": ("SELECT LEFT(p_name, 5) AS l, RIGHT(p_name, 4) AS r, LENGTH(p_name) AS n, p_partkey FROM part", "SELECT left(p_name, 5) AS l, right(p_name, 4) AS r, strlen(p_name) AS n, p_partkey FROM part"),
    "fn_bytes": ("SELECT doc_id, LENGTH(text) AS bytes FROM documents", "SELECT doc_id, strlen(text) AS bytes FROM documents"),
    "fn_hex": ("SELECT n_nationkey, TO_HEX(n_nationkey * 40) AS h, HEX(n_name) AS raw FROM nation", "SELECT n_nationkey, '0x' || lpad(lower(to_hex(n_nationkey * 40)), CASE WHEN n_nationkey * 40 < 256 THEN 2 ELSE 4 END, '0') AS h, hex(n_name) AS raw FROM nation"),
    "fn_codepoint": ("SELECT doc_id, CODEPOINT(text) AS c, CHR(CODEPOINT(text)) AS ch FROM documents", "SELECT doc_id, ord(text) AS c, left(text, 1) AS ch FROM documents"),
    "fn_concat": ("SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority || 7 AS tag FROM orders", "SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority || '7' AS tag FROM orders"),
    "fn_arith": (
        "SELECT p_partkey, p_size + 3 AS a, p_size - 9 AS s, p_size * 4 AS m, ADD(p_size, 1, 2) AS add3, 2 + p_size * 3 AS prec, (2 + p_size) * 3 AS paren FROM part",
        "SELECT p_partkey, p_size + 3 AS a, p_size - 9 AS s, p_size * 4 AS m, p_size + 3 AS add3, 2 + p_size * 3 AS prec, (2 + p_size) * 3 AS paren FROM part",
    ),
    "fn_functions_arith": ("SELECT p_partkey, SUB(p_size, 3) AS s, MUL(p_size, 4) AS m, DIV(360, p_size) AS d, MOD(19, p_size) AS r FROM part", "SELECT p_partkey, p_size - 3 AS s, p_size * 4 AS m, 360 // p_size AS d, 19 % p_size AS r FROM part"),
    "fn_int_div_mod": ("SELECT p_partkey, (p_size - 25) / 7 AS q, (p_size - 25) % 7 AS r FROM part", "SELECT p_partkey, trunc((p_size - 25) / 7)::BIGINT AS q, (p_size - 25) % 7 AS r FROM part"),
    "fn_pow": ("SELECT p_partkey, POW(p_size, 3) AS cube, POW(2, 0 - p_size) AS none FROM part", "SELECT p_partkey, (p_size * p_size * p_size)::BIGINT AS cube, 0 AS none FROM part"),
    "fn_div_zero": ("SELECT n_nationkey, 100 / (n_nationkey - 3) AS q, 100 % (n_nationkey - 3) AS r FROM nation", "SELECT n_nationkey, trunc(100 / nullif(n_nationkey - 3, 0))::BIGINT AS q, 100 % nullif(n_nationkey - 3, 0) AS r FROM nation"),
    "fn_cast": ("SELECT CAST('99' AS INT) AS a, CAST('00:15:00' AS INTERVAL) AS b, CAST(900 AS DURATION) AS c, INTERVAL('123:00:01') AS d, CAST('12abc' AS INT) AS e", "SELECT 99 AS a, 900 AS b, '00:15:00' AS c, 442801 AS d, 12 AS e"),
    "fn_duration": ("SELECT l_orderkey, CAST(l_quantity * 100 AS DURATION) AS t FROM lineitem", "SELECT l_orderkey, lpad((q // 3600)::VARCHAR, 2, '0') || ':' || lpad((q // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((q % 60)::VARCHAR, 2, '0') AS t FROM (SELECT l_orderkey, (l_quantity * 100)::BIGINT AS q FROM lineitem)"),
    "fn_w1252": ("SELECT W1252('cafÃ©') AS a, W1252('plain') AS b, W1252('â‚¬ 5') AS c", "SELECT 'café' AS a, 'plain' AS b, '€ 5' AS c"),
    "fn_random": ("SELECT r_regionkey, RANDOM() >= 0 AS ok FROM region", "SELECT r_regionkey, 1 AS ok FROM region"),
    # Dates
    "fn_extract": (
        "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d, EXTRACT(QUARTER FROM o_orderdate) AS q, EXTRACT(YEARDAY FROM o_orderdate) AS yd FROM orders",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS yd FROM orders",
    ),
    "fn_iso_week": (
        "SELECT o_orderkey, EXTRACT(WEEK FROM o_orderdate) AS w, EXTRACT(WEEKYEAR FROM o_orderdate) AS wy, EXTRACT(WEEKDAY FROM o_orderdate) AS wd FROM orders",
        "SELECT o_orderkey, week(o_orderdate) AS w, isoyear(o_orderdate) AS wy, isodow(o_orderdate) AS wd FROM orders",
    ),
    "fn_eras": (
        "SELECT o_orderkey, EXTRACT(MILLENNIUM FROM o_orderdate) AS mi, EXTRACT(CENTURY FROM o_orderdate) AS ce, EXTRACT(DECADE FROM o_orderdate) AS de, EXTRACT(HEYEAR FROM o_orderdate) AS he FROM orders",
        "SELECT o_orderkey, year(o_orderdate) // 1000 AS mi, year(o_orderdate) // 100 AS ce, year(o_orderdate) // 10 AS de, year(o_orderdate) + 10000 AS he FROM orders",
    ),
    "fn_julian": ("SELECT o_orderkey, EXTRACT(JULIAN FROM o_orderdate) AS j FROM orders", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 2440587 AS j FROM orders"),
    "fn_date_strings": (
        "SELECT o_orderkey, EXTRACT(DATE FROM o_orderdate) AS d, EXTRACT(DATETIME FROM o_orderdate) AS dt, EXTRACT(MONTH_STRING FROM o_orderdate) AS ms, EXTRACT(WEEK_STRING FROM o_orderdate) AS ws, EXTRACT(YEARDAY_STRING FROM o_orderdate) AS ys FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS dt, strftime(o_orderdate, '%Y-%m') AS ms, strftime(o_orderdate, '%G-W%V') AS ws, strftime(o_orderdate, '%Y-%j') AS ys FROM orders",
    ),
    "fn_date_arith": (
        "SELECT l_orderkey, DATE_ADD(l_shipdate, 30) AS a, DATE_SUB(l_shipdate, 7) AS s, DATE(l_shipdate) + 5 AS p FROM lineitem",
        "SELECT l_orderkey, l_shipdate::DATE + 30 AS a, l_shipdate::DATE - 7 AS s, l_shipdate::DATE + 5 AS p FROM lineitem",
    ),
    "fn_date_diff": ("SELECT o_orderkey, DATE_DIFF(o_orderdate, '1992-01-01') AS d, DATE(o_orderdate) - '1995-01-01' AS e FROM orders", "SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS e FROM orders"),
    "fn_datetime_diff": (
        "SELECT event_id, ts - '2024-01-01T00:00:00' AS secs, DATE(ts) AS d, TIME(ts) AS t FROM events",
        "SELECT event_id, floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT AS secs, ts::DATE AS d, strftime(ts, '%H:%M:%S') AS t FROM events",
    ),
    "fn_datetime_add": ("SELECT o_orderkey, o_orderdate + 3600 AS later, o_orderdate - 60 AS before FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR AS later, o_orderdate - INTERVAL 1 MINUTE AS before FROM orders"),
    "fn_make": (
        "SELECT n_nationkey, MAKE_DATE(2000 + n_nationkey, 2, 29) AS d, MAKE_DATE(1990 + n_nationkey) AS y, MAKE_TIME(n_nationkey, 5) AS t, MAKE_DATETIME(2020, 1, 1 + n_nationkey, 10, 30) AS dt FROM nation",
        "SELECT n_nationkey, try_cast((2000 + n_nationkey) || '-02-29' AS DATE) AS d, make_date(1990 + n_nationkey, 1, 1) AS y, lpad(n_nationkey::VARCHAR, 2, '0') || ':05:00' AS t, make_timestamp(2020, 1, 1 + n_nationkey, 10, 30, 0) AS dt FROM nation",
    ),
    "fn_date_spellings": (
        "SELECT DATE_ADD('2024-02-28', 1) AS a, DATE_ADD('28-FEB-2024', 1) AS b, DATE_ADD('28 feb 2024', 1) AS c, DATE_ADD('2024-059', 1) AS d, DATE_ADD('2024-W09-3', 1) AS e, DATE_ADD('2024W093', 1) AS f, '2024-01-18T10:00:00' + 9000 AS g, '01:30:00' + '00:45:00' AS h",
        "SELECT DATE '2024-02-29' AS a, DATE '2024-02-29' AS b, DATE '2024-02-29' AS c, DATE '2024-02-29' AS d, DATE '2024-02-29' AS e, DATE '2024-02-29' AS f, TIMESTAMP '2024-01-18 12:30:00' AS g, '02:15:00' AS h",
    ),
    "fn_today": ("SELECT CURRENT_DATE = TODAY() AS same, DATE(NOW()) = TODAY() AS now_too, LENGTH(CLOCK()) AS clock, LENGTH(CURRENT_TIME) AS t", "SELECT 1 AS same, 1 AS now_too, 8 AS clock, 8 AS t"),
    # Generated tables
    "calendar_range": (
        "FROM CALENDAR WHERE year = 2024 SELECT julian, date, weekyear, week, weekday, yearday, quarter, firstOfQuarter, lastOfQuarter, firstOfMonth, lastOfMonth, firstOfWeek, lastOfWeek, firstOfYear, lastOfYear, isLeapYear, weekdayInMonth, isWeekend, monthString, ordinalDate, weekString, weekDate, millenium, century, decade",
        "SELECT date_diff('day', DATE '1970-01-01', d) + 2440587 AS julian, d AS date, isoyear(d) AS weekyear, week(d) AS week, isodow(d) AS weekday, dayofyear(d) AS yearday, quarter(d) AS quarter, date_trunc('quarter', d)::DATE AS \"firstOfQuarter\", (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS \"lastOfQuarter\", date_trunc('month', d)::DATE AS \"firstOfMonth\", last_day(d) AS \"lastOfMonth\", date_trunc('week', d)::DATE AS \"firstOfWeek\", (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS \"lastOfWeek\", DATE '2024-01-01' AS \"firstOfYear\", DATE '2024-12-31' AS \"lastOfYear\", 1 AS \"isLeapYear\", (day(d) - 1) // 7 + 1 AS \"weekdayInMonth\", (isodow(d) >= 6)::INT AS \"isWeekend\", strftime(d, '%Y-%m') AS \"monthString\", strftime(d, '%Y-%j') AS \"ordinalDate\", strftime(d, '%G-W%V') AS \"weekString\", strftime(d, '%G-W%V-%u') AS \"weekDate\", 2 AS millenium, 20 AS century, 202 AS decade FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS d)",
    ),
    "calendar_bounds": (
        "FROM CALENDAR WHERE date BETWEEN '1999-12-30' AND '2000-01-03' AND weekday < 6 SELECT date, weekDate",
        "SELECT d AS date, strftime(d, '%G-W%V-%u') AS \"weekDate\" FROM (SELECT unnest(generate_series(DATE '1999-12-30', DATE '2000-01-03', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6",
    ),
    "calendar_join": (
        "FROM orders JOIN CALENDAR ON date = o_orderdate WHERE isWeekend = 1 GROUP BY year SELECT year, COUNT(*) AS n",
        "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE isodow(o_orderdate) >= 6 GROUP BY 1",
    ),
    "calendar_left_join": (
        "FROM CALENDAR LEFT JOIN orders ON o_orderdate = date AND o_custkey < 50 WHERE year = 1995 AND month = 3 SELECT date, o_orderkey",
        "SELECT d AS date, o_orderkey FROM (SELECT unnest(generate_series(DATE '1995-03-01', DATE '1995-03-31', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN orders ON o_orderdate::DATE = d AND o_custkey < 50",
    ),
    "sequence_range": ("FROM SEQUENCE WHERE value >= 5 AND value < 40 SELECT value, value * value AS square", "SELECT value, value * value AS square FROM (SELECT unnest(range(5, 40)) AS value)"),
    "sequence_mod": ("FROM SEQUENCE WHERE value % 7 = 3 AND value <= 100", "SELECT unnest(range(3, 101, 7)) AS value"),
    "sequence_cross": ("FROM SEQUENCE AS t(i), SEQUENCE AS s(j) WHERE t.i < 5 AND s.j < 3 SELECT t.i * 10 + s.j AS n", "SELECT i * 10 + j AS n FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(3)) AS j)"),
    "sequence_join": ("FROM SEQUENCE LEFT JOIN nation ON n_nationkey - 2 = value WHERE value < 30 SELECT value, n_name", "SELECT value, n_name FROM (SELECT unnest(range(30)) AS value) LEFT JOIN nation ON n_nationkey - 2 = value"),
    "sequence_limit": ("FROM SEQUENCE OFFSET 5 ROWS LIMIT 10", "SELECT unnest(range(5, 15)) AS value"),
    # Sub-queries and inline data
    "values_inline": ("FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) AS v(letter, number) WHERE number < 3 SELECT letter, number", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) v(letter, number) WHERE number < 3"),
    "values_top": ("VALUES ('a', 1), ('b', 2)", "SELECT * FROM (VALUES ('a', 1), ('b', 2)) v(col1, col2)"),
    "table_clause": ("TABLE region", "SELECT * FROM region"),
    "cte": ("WITH big AS (FROM orders WHERE o_totalprice > 200000 SELECT o_custkey, o_orderkey) FROM big, customer ON c_custkey = o_custkey SELECT c_name, o_orderkey", "WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) SELECT c_name, o_orderkey FROM big JOIN customer ON c_custkey = o_custkey"),
    "cte_self_join": ("WITH r AS (FROM region WHERE r_regionkey < 3) FROM r, r AS s SELECT r.r_name AS x, s.r_name AS y", "WITH r AS (SELECT * FROM region WHERE r_regionkey < 3) SELECT r.r_name AS x, s.r_name AS y FROM r, r s"),
    "from_subquery": ("FROM (FROM orders GROUP BY o_custkey SELECT o_custkey AS k, COUNT(*) AS n) WHERE n > 12 SELECT k, n", "SELECT * FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE n > 12"),
    "scalar_subquery": ("SELECT n_name, (SELECT MAX(r_regionkey) FROM region) - n_regionkey AS behind FROM nation WHERE n_nationkey > (SELECT COUNT(*) FROM region)", "SELECT n_name, (SELECT max(r_regionkey) FROM region) - n_regionkey AS behind FROM nation WHERE n_nationkey > (SELECT count(*) FROM region)"),
    "scalar_subquery_empty": ("SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey = 999) AS nobody FROM region", "SELECT r_name, NULL::VARCHAR AS nobody FROM region"),
    "column_alias_list": ("FROM region AS r(k, name) SELECT name, k ORDER BY k DESC", "SELECT r_name AS name, r_regionkey AS k FROM region"),
    "no_table": ("SELECT 6 * 7 AS answer, 'x' || 'y' AS xy", "SELECT 42 AS answer, 'xy' AS xy"),
    "primary_key": ("SELECT o_orderkey, o_custkey FROM orders WHERE PK(o_orderkey) < 51", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 51"),
    # Statements
    "temp_table": ("CREATE TEMP TABLE t AS FROM nation WHERE n_regionkey < 2; FROM t GROUP BY n_regionkey SELECT n_regionkey, COUNT(*) AS n", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey < 2 GROUP BY 1"),
    "insert_into": ("CREATE TEMP TABLE t AS FROM SEQUENCE LIMIT 2; INSERT INTO t VALUES (14), (15), (16); TABLE t", "SELECT unnest([0, 1, 14, 15, 16]) AS value"),
    "view_query": ("CREATE VIEW v AS FROM supplier WHERE s_acctbal > 5000 SELECT s_suppkey, s_nationkey; FROM v, nation ON s_nationkey = n_nationkey SELECT s_suppkey, n_name", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000"),
    "explicit_index": ("CREATE INDEX ON customer (c_mktsegment, c_custkey); FROM customer WHERE INDEX('customer__c_mktsegment__c_custkey.index') = 'BUILDING' SELECT c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "information": (
        "FROM INFORMATION WHERE name = 'nation'",
        "SELECT 'nation' AS \"table\", (SELECT count(*) FROM nation) AS records, 3 AS fields, position, field, kind FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int')) v(position, field, kind)",
    ),
    "drop": ("CREATE TEMP TABLE t AS FROM region; DROP t; LOCK t; CREATE TEMP TABLE t AS FROM nation WHERE n_regionkey = 1; FROM t SELECT n_name", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "sample_shape": ("FROM SAMPLE SELECT COUNT(*) AS n, MIN(score) AS low, MAX(score) AS high, MIN(id) AS first", "SELECT 1000 AS n, 0 AS low, 99 AS high, 0 AS first"),
    "insert_twice": (
        "CREATE TEMP TABLE t AS FROM region SELECT r_regionkey AS k; INSERT INTO t VALUES (70), (60); INSERT INTO t VALUES (50); FROM t SELECT rowid AS r, k",
        "SELECT r_regionkey AS r, r_regionkey AS k FROM region UNION ALL SELECT * FROM (VALUES (5, 70), (6, 60), (7, 50))",
    ),
    "index_copy_rowid": (
        "CREATE INDEX ON nation (n_regionkey); FROM nation WHERE INDEX('nation__n_regionkey.index') = 2 SELECT rowid AS r, n_name",
        "SELECT n_nationkey AS r, n_name FROM nation WHERE n_regionkey = 2",
    ),
    "row_number_large_limit": ("FROM lineitem ORDER BY l_orderkey LIMIT 200000000 SELECT ROW_NUMBER() AS r, l_orderkey", "SELECT row_number() OVER (ORDER BY l_orderkey) AS r, l_orderkey FROM lineitem"),
    "values_digits": ("VALUES (1234567.25, 0.1234567), (2.0, 1.5)", "SELECT * FROM (VALUES ('1234567.25', '0.1234567'), ('2', '1.5')) v(col1, col2)"),
    "fn_bytes_left_right": ("SELECT HEX(LEFT('née', 2)) AS l, HEX(RIGHT('née', 2)) AS r, HEX(LEFT('abc', 1)) AS a, RIGHT('abc', 9) AS whole", "SELECT '6EC3' AS l, 'A965' AS r, '61' AS a, 'abc' AS whole"),
    "fn_pow_large": (
        "SELECT POW(1, 400000000) AS one, POW(2, 62) AS big, POW(3, 64) AS beyond, POW(0 - 1, 7) AS odd, POW(0, 0) AS zero, POW(n_nationkey, 3) AS cube FROM nation",
        "SELECT 1 AS one, 4611686018427387904 AS big, NULL::BIGINT AS beyond, -1 AS odd, 1 AS zero, n_nationkey::BIGINT * n_nationkey * n_nationkey AS cube FROM nation",
    ),
    "fn_hex_large": ("SELECT TO_HEX('9007199254740993') AS hex, CAST('9007199254740993' AS INT) + 0 AS n", "SELECT '0x20000000000001' AS hex, 9007199254740993 AS n"),
    "fn_signed_years": (
        "SELECT DATE_ADD('-0044-03-15', 1) || '' AS next, EXTRACT(YEAR FROM '-0044-03-15') AS y, EXTRACT(YEAR FROM '+12024-01-02') AS far, DATE_DIFF('0001-01-01', '-0001-01-01') AS days",
        "SELECT '-0044-03-16' AS next, -44 AS y, 12024 AS far, 731 AS days",
    ),
    "unique_index": ("CREATE UNIQUE INDEX ON orders (o_orderkey); FROM orders WHERE UNIQUE('orders__o_orderkey.unique') >= 100 SELECT o_orderkey LIMIT 5", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 5"),
}

#: Queries that first write files of some kind and then read them: name -> (statements, DuckDB SQL).
FILE_QUERIES: dict[str, tuple[str, str]] = {
    "source_csv": ("CREATE TABLE n AS FROM nation; FROM n.csv WHERE n_regionkey > 2 AND n_name LIKE 'N%' SELECT n_name, n_nationkey + 1 AS next", "SELECT n_name, (n_nationkey + 1)::VARCHAR AS next FROM nation WHERE n_regionkey > 2 AND starts_with(n_name, 'N')"),
    "source_tsv": ("CREATE TABLE p.tsv AS FROM part WHERE p_size < 5; FROM p.tsv GROUP BY p_size SELECT p_size, COUNT(*) AS n, SUM(p_size) AS total", "SELECT p_size::VARCHAR AS p_size, count(*) AS n, sum(p_size)::BIGINT::VARCHAR AS total FROM part WHERE p_size < 5 GROUP BY p_size"),
    "source_view_file": ("CREATE VIEW asia.sql AS FROM region WHERE r_regionkey < 2 SELECT r_name; FROM asia", "SELECT r_name FROM region WHERE r_regionkey < 2"),
    "source_parquet": ("CREATE TABLE o.parquet AS FROM orders WHERE o_custkey < 20; FROM o.parquet SELECT o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 20"),
    "text_dates": (
        "CREATE TABLE d AS FROM orders SELECT o_orderkey, DATE(o_orderdate) AS day; FROM d WHERE day >= '1997-01-01' SELECT CAST(o_orderkey AS INT) AS k, day + 1 AS next, EXTRACT(WEEK FROM day) AS w",
        "SELECT o_orderkey AS k, strftime(o_orderdate::DATE + 1, '%Y-%m-%d') AS next, week(o_orderdate) AS w FROM orders WHERE o_orderdate >= DATE '1997-01-01'",
    ),
    "create_with_columns": ("CREATE TABLE c (key, label) AS FROM region SELECT r_regionkey, r_name; INSERT INTO c VALUES (9, 'MOON'); FROM c", "SELECT r_regionkey::VARCHAR AS key, r_name AS label FROM region UNION ALL SELECT '9', 'MOON'"),
}


def _nations(engine: Engine) -> list:
    return engine.relation("nation").df.orderBy("n_nationkey").collect()


def _wsv(engine: Engine) -> None:
    """White-space separated nations, and a row that reads as the header does."""
    lines = ["k  name\tregion", *[f" {r[0]}   {r[1]} \t{r[2]}" for r in _nations(engine)], "k name region"]
    files.write_text(engine.spark, engine.path("n.wsv"), "\n".join(lines))


def _col(engine: Engine) -> None:
    """Fixed widths, and a row that is the header line again."""
    head = f"{'k':<5}{'name':<24}region"
    lines = [head, *[f"{r[0]:<5}{r[1]:<24}{r[2]}" for r in _nations(engine)], head]
    files.write_text(engine.spark, engine.path("n.col"), "\r\n".join(lines))


def _stdin(engine: Engine) -> None:
    engine.stdin = engine.path("input.txt")
    files.write_text(engine.spark, engine.stdin, "k,name\n" + "".join(f'{r[0]},"{r[1]}, {r[2]}"\n' for r in _nations(engine)))


def _two_files(engine: Engine) -> None:
    """A table of two Parquet files, of which Spark reads the second first, since it is larger."""
    fs, table = files.hadoop_path(engine.spark, engine.path("two.parquet"))
    fs.mkdirs(table)
    for name, low, high in (("a", 0, 3), ("b", 3, 3000)):
        engine.spark.range(low, high).coalesce(1).selectExpr("id AS v").write.parquet(engine.path(f"one-{name}"))
        _, written = files.hadoop_path(engine.spark, engine.path(f"one-{name}"))
        part = next(x.getPath() for x in fs.listStatus(written) if x.getPath().getName().startswith("part"))
        fs.rename(part, files.hadoop_path(engine.spark, engine.path(f"two.parquet/{name}.parquet"))[1])


def _listed(engine: Engine) -> None:
    for name, text in (("x.txt", "abc"), ("y.csv", "a\n1\n"), ("z.txt", "")):
        files.write_text(engine.spark, engine.path(f"listed/{name}"), text)


NATION_TEXT_SQL = "SELECT n_nationkey::VARCHAR AS k, n_name AS name, n_regionkey::VARCHAR AS region FROM nation UNION ALL SELECT 'k', 'name', 'region'"
#: Queries over files that are prepared first: name -> (preparation, query, DuckDB SQL).
PREPARED_QUERIES: dict[str, tuple[Callable[[Engine], None], str, str]] = {
    "source_wsv": (_wsv, "FROM n.wsv", NATION_TEXT_SQL),
    "source_col": (_col, "FROM n.col", NATION_TEXT_SQL),
    "source_stdin": (_stdin, "FROM stdin WHERE k > 20 SELECT name, k + 1 AS next", "SELECT n_name || ', ' || n_regionkey AS name, (n_nationkey + 1)::VARCHAR AS next FROM nation WHERE n_nationkey > 20"),
    "rowid_two_files": (_two_files, "FROM two.parquet SELECT rowid AS r, v", "SELECT unnest(range(3000)) AS r, unnest(range(3000)) AS v"),
    "row_number_two_files": (_two_files, "FROM two.parquet ORDER BY v DESC SELECT ROW_NUMBER() AS r, v", "SELECT 3000 - unnest(range(3000)) AS r, unnest(range(3000)) AS v"),
    "dir_listing": (_listed, "FROM DIR('listed') SELECT name, size", "SELECT * FROM (VALUES ('x.txt', 3), ('y.csv', 4), ('z.txt', 0)) v(name, size)"),
}

#: What the sinks are held against: labels with the signs that formats must care for.
SINK_QUERY = "FROM nation SELECT n_nationkey AS k, n_name || ', \"a|b\" <&> it''s ' || n_regionkey AS label"
SINK_SQL = "SELECT n_nationkey::VARCHAR AS k, n_name || ', \"a|b\" <&> it''s ' || n_regionkey AS label FROM nation"


def _sql_rows(text: str) -> list[list[str]]:
    return [[k, label.replace("''", "'")] for k, label in re.findall(r"\((\d+),'((?:[^']|'')*)'\)", text)]


def _lines(text: str, first: int, last: int | None = None) -> list[str]:
    return text.splitlines()[first:last]


#: Output formats, and how their text is read back.
SINK_READERS: dict[str, Callable[[str], list[list[str]]]] = {
    "csv": lambda t: list(csv.reader(io.StringIO(t)))[1:],
    "csv:excel": lambda t: list(csv.reader(io.StringIO(t.removeprefix("﻿"))))[1:],
    "tsv": lambda t: [x.split("\t") for x in _lines(t, 1)],
    "table": lambda t: [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x)[1:-1]] for x in _lines(t, 2)],
    "box": lambda t: [[c.strip() for c in x.split("│")[1:-1]] for x in _lines(t, 3, -1)],
    "html": lambda t: [[html.unescape(c) for c in re.findall(r"<td[^>]*>(.*?)</td>", x)] for x in _lines(t, 0) if "<td" in x],
    "json:object": lambda t: [[str(x["k"]), x["label"]] for x in json.loads(t)],
    "json:array": lambda t: [[str(k), label] for k, label in json.loads(t)[1:]],
    "xml": lambda t: [[x.get("k"), x.get("label")] for x in ElementTree.fromstring(t)],
    "sql:insert": _sql_rows,
    "sql:values": _sql_rows,
    "sql:create": _sql_rows,
    "record": lambda t: [x.split("\x1f") for x in t.partition("\x02")[2].split("\x1e")[:-1]],
}


def _sink(form: str) -> Callable[[SparkSession, str], DataFrame]:
    """The text of a result in some format, written to a file and read back as rows of text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.over_parquet(spark, sf_dir, TABLES)
        path = f"{folder(spark)}/sink-{uuid.uuid4().hex}"
        files.write_text(spark, path, "".join(sinks.render(engine.run(SINK_QUERY), form)))
        return spark.createDataFrame(SINK_READERS[form](files.read_text(spark, path)), "k string, label string")

    return run


def _sink_sql(form: str) -> str:
    """box cuts what is wider than its cells."""
    cut = f"CASE WHEN length(label) > {sinks.WIDTH} THEN left(label, {sinks.WIDTH - 1}) || '…' ELSE label END"
    return SINK_SQL if form != "box" else f"SELECT k, trim({cut}) AS label FROM ({SINK_SQL})"


#: Queries without a counterpart in SQL.
OTHER_QUERIES: dict[str, str] = {
    "explain": "EXPLAIN FROM orders, customer ON o_custkey = c_custkey WHERE c_nationkey = 3 SELECT c_name, o_totalprice",
    "sample_table": "FROM SAMPLE WHERE score < 50 SELECT id, name, birth_date, score",
    "dir_table": "FROM DIR('region.parquet') SELECT name, size > 0 AS filled",
}


def _typed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.over_parquet(spark, sf_dir, TABLES).sql(text)


def _over_files(text: str, prepare: Callable[[Engine], None] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.over_parquet(spark, sf_dir, TABLES)
        engine.base = f"{folder(spark)}/files-{uuid.uuid4().hex}"
        if prepare:
            prepare(engine)
        return engine.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    typed = {n: _typed(q) for n, (q, _) in QUERIES.items()}
    typed |= {n: _over_files(q) for n, (q, _) in FILE_QUERIES.items()} | {n: _typed(q) for n, q in OTHER_QUERIES.items()}
    typed |= {n: _over_files(q, prepare) for n, (prepare, q, _) in PREPARED_QUERIES.items()}
    return typed | {f"sink_{form.replace(':', '_')}": _sink(form) for form in SINK_READERS}


def oracle_sql() -> dict[str, str]:
    found = {n: sql for n, (_, sql) in (QUERIES | FILE_QUERIES).items()} | {n: sql for n, (_, _, sql) in PREPARED_QUERIES.items()}
    return found | {f"sink_{form.replace(':', '_')}": _sink_sql(form) for form in SINK_READERS}
