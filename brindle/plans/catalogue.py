"""Catalogue of the engine's queries by operator, in the dialect, with DuckDB SQL for the same rows.

A text serves both where the engines agree. Where they differ (rounding casts, day of week, order of nulls,
result types) the oracle has its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.client import connect
from brindle.plans.lexer import SqlError
from brindle.session import Session
from brindle.sources.keyvalue import KeyValue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = """
SELECT c.c_mktsegment AS segment, COUNT(*) AS n_lines,
       CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM customer c
JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'
GROUP BY c.c_mktsegment
HAVING COUNT(*) > 1
ORDER BY segment LIMIT 10
"""

#: Nations with some names taken away, for queries about nulls.
SOME = "(SELECT n_nationkey AS k, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS r, n_name AS s FROM nation)"

#: Name: (text, oracle; None: the same text).
QUERIES: dict[str, tuple[str, str | None]] = {
    "s1_scan_project": ("SELECT n_nationkey AS k, n_name AS name FROM nation", None),
    "s2_eq_lookup": ("SELECT o_orderkey AS k, o_totalprice AS t FROM orders WHERE o_custkey = 42", None),
    "s3_alias_scan": ("SELECT q.k, q.s FROM (SELECT n_nationkey AS k, n_name AS s FROM nation) q".replace("q.k, q.s", "q.k AS k, q.s AS s"), None),
    "s4_values": ("SELECT v.column_0 AS a, v.column_1 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v", "SELECT col0 AS a, col1 AS b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v"),
    "p1_project_expr": ("SELECT l_orderkey AS k, l_quantity * 2 AS q2, l_linenumber + 1 AS n FROM lineitem", None),
    "p2_star": ("SELECT * FROM region", None),
    "p3_implicit_alias": ("SELECT c_custkey k, c_name nm FROM customer", None),
    "p4_qualified": ("SELECT n.n_name AS a, r.r_name AS b FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "p5_filter": ("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'", None),
    "p7_and_or": ("SELECT p_partkey AS k FROM part WHERE (p_size < 10 OR p_size > 40) AND p_brand <> 'Brand#11' OR p_partkey = 3", None),
    "p8_arith_add": ("SELECT l_orderkey AS k, l_linenumber + l_suppkey AS v FROM lineitem", None),
    "p8_arith_sub": ("SELECT l_orderkey AS k, l_quantity - 3 AS v FROM lineitem", None),
    "p8_arith_mul": ("SELECT l_orderkey AS k, ROUND(l_quantity * l_tax * 10000) AS v FROM lineitem", None),
    "p8_div": ("SELECT n_nationkey AS k, n_nationkey / 4 AS d, -n_regionkey AS neg FROM nation", None),
    "p9_like": ("SELECT p_partkey AS k FROM part WHERE p_name LIKE '%widget' OR p_name LIKE '_o%'", None),
    "p10_ilike": ("SELECT p_partkey AS k FROM part WHERE p_name ILIKE 'COLD%'", None),
    "p11_between": ("SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 10 AND 20", None),
    "p12_is_null": (f"SELECT t.k AS k, (t.r IS NULL) AS n, (t.r IS NOT NULL) AS o FROM {SOME} t", None),
    "p13_in_list": ("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", None),
    "p14_in_subquery": ("SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "p14_not_in": ("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "p15_exists_corr": ("SELECT c.c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", None),
    "p15_not_exists": ("SELECT c.c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", None),
    "p18_scalar_select": ("SELECT n.n_name AS n, (SELECT r.r_name FROM region r WHERE r.r_regionkey = n.n_regionkey) AS r FROM nation n",
                          "SELECT n.n_name AS n, r.r_name AS r FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"),
    "p18_scalar_where": ("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "p19_correlated": ("SELECT c.c_custkey AS k, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS mx FROM customer c", None),
    "p20_case": ("SELECT p_partkey AS k, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'mid' ELSE 'large' END AS band FROM part", None),
    "p20_case_no_else": ("SELECT p_partkey AS k, CASE WHEN p_size < 15 THEN 'small' END AS band FROM part", None),
    "p21_cast_int": ("SELECT l_orderkey AS k, CAST(l_quantity AS SMALLINT) AS s, CAST(l_extendedprice AS INTEGER) AS i, CAST(l_extendedprice AS BIGINT) AS b FROM lineitem",
                     "SELECT l_orderkey AS k, CAST(trunc(l_quantity) AS SMALLINT) AS s, CAST(trunc(l_extendedprice) AS INTEGER) AS i, CAST(trunc(l_extendedprice) AS BIGINT) AS b FROM lineitem"),
    "p21_cast_float": ("SELECT l_orderkey AS k, CAST(l_linenumber AS REAL) AS r, CAST(l_linenumber AS DOUBLE PRECISION) AS d FROM lineitem", None),
    "p21_cast_numeric": ("SELECT l_orderkey AS k, CAST(l_quantity AS NUMERIC(12,1)) AS d FROM lineitem", None),
    "p21_cast_text": ("SELECT l_orderkey AS k, CAST(l_linenumber AS TEXT) AS t, CAST(l_returnflag AS CHAR(4)) AS c, CAST(l_linestatus AS VARCHAR(5)) AS v FROM lineitem",
                      "SELECT l_orderkey AS k, CAST(l_linenumber AS TEXT) AS t, rpad(l_returnflag, 4, ' ') AS c, l_linestatus AS v FROM lineitem"),
    "p21_cast_bool": ("SELECT n_nationkey AS k, CAST(CASE WHEN n_regionkey > 2 THEN 'yes' ELSE 'f' END AS BOOLEAN) AS b FROM nation", "SELECT n_nationkey AS k, n_regionkey > 2 AS b FROM nation"),
    "p21_cast_date": ("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders", None),
    "p21_cast_array": ("SELECT n_nationkey AS k, size(CAST('{1,2,3}' AS INTEGER[])) AS n FROM nation", "SELECT n_nationkey AS k, CAST(3 AS INTEGER) AS n FROM nation"),
    "p21_cast_uuid": ("SELECT n_nationkey AS k, CAST('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11' AS UUID) AS u FROM nation", "SELECT n_nationkey AS k, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS u FROM nation"),
    "p21_cast_bytea": ("SELECT n_nationkey AS k, lower(hex(CAST('\\xDEAD' AS BYTEA))) AS b FROM nation", "SELECT n_nationkey AS k, 'dead' AS b FROM nation"),
    "p22_derived": ("SELECT d.f AS f, d.n AS n FROM (SELECT l_returnflag AS f, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag) AS d WHERE d.n > 10", None),
    "j1_inner": ("SELECT o.o_orderkey AS k, c.c_name AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "j2_left": ("SELECT n.n_nationkey AS k, s.s_suppkey AS s FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", None),
    "j3_right": ("SELECT s.s_suppkey AS s, n.n_nationkey AS k FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", None),
    "j4_full": ("SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey", None),
    "j5_cross": ("SELECT r.r_name AS r, n.n_name AS n FROM region r CROSS JOIN nation n", None),
    "j6_theta": ("SELECT COUNT(*) AS c FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", None),
    "j7_multiway": ("SELECT r.r_name AS r, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name", None),
    "j8_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "a1_count": ("SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "a2_count_null": ("SELECT n.n_regionkey AS r, COUNT(*) AS all_rows, COUNT(s.s_suppkey) AS non_null FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_regionkey", None),
    "a3_count_distinct": ("SELECT l_returnflag AS f, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", None),
    "a4_sum": ("SELECT l_returnflag AS f, SUM(l_quantity) AS q, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY l_returnflag", None),
    "a5_avg": ("SELECT l_linestatus AS s, ROUND(AVG(l_quantity), 6) AS a FROM lineitem GROUP BY l_linestatus", None),
    "a6_min_a7_max": ("SELECT c_mktsegment AS s, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, MIN(c_name) AS a, MAX(c_name) AS z FROM customer GROUP BY c_mktsegment", None),
    "a8_null_group": (f"SELECT t.r AS r, COUNT(*) AS n FROM {SOME} t GROUP BY t.r", None),
    "a9_group_expr": ("SELECT o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10", None),
    "a10_group_only": ("SELECT o_orderstatus AS s, o_orderpriority AS p FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "a11_global": ("SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders", None),
    "a11_global_empty": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem WHERE l_quantity < 0", None),
    "a12_having": ("SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "a13_order_by_agg": ("SELECT p_type AS t, COUNT(*) AS n FROM part GROUP BY p_type ORDER BY COUNT(*) DESC, t LIMIT 3", None),
    "o1_sort_limit": ("SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "o1_null_order": (f"SELECT t.k AS k, t.r AS r FROM {SOME} t ORDER BY t.r, t.k LIMIT 8", f"SELECT t.k AS k, t.r AS r FROM {SOME} t ORDER BY t.r NULLS FIRST, t.k LIMIT 8"),
    "o2_sort_expr": ("SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey * -1 LIMIT 7", None),
    "o3_limit_zero": ("SELECT n_nationkey AS k FROM nation LIMIT 0", None),
    "o4_offset": ("SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 10", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "o5_distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_orderkey AS k, o_orderdate AS d FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey", None),
    "o6_distinct": ("SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem", None),
    "u1_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "u2_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "u3_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000", None),
    "u4_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000", None),
    "u5_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "u5_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "u6_order_before": ("SELECT n_nationkey AS k FROM nation ORDER BY k DESC LIMIT 6 UNION SELECT s_nationkey FROM supplier", "SELECT * FROM (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier) ORDER BY k DESC LIMIT 6"),
    "u7_chained": ("SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey + 20 FROM supplier", None),
    "u7_chained_first": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000 UNION SELECT r_regionkey + 100 FROM region EXCEPT SELECT 3", None),
    "c1_cte": ("WITH big AS (SELECT o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT cu.c_name AS name, b.n AS n FROM big b JOIN customer cu ON cu.c_custkey = b.c WHERE b.n > 10", None),
    "c1_chained": ("WITH a AS (SELECT n_regionkey AS r, n_nationkey AS k FROM nation), b AS (SELECT r, COUNT(*) AS n FROM a GROUP BY r) SELECT r, n FROM b WHERE r > 0", None),
    "c2_recursive_all": ("WITH RECURSIVE c(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c WHERE n < 120) SELECT n, n * n AS sq FROM c", None),
    "c3_recursive_union": ("WITH RECURSIVE c(n) AS (SELECT 0 AS n UNION SELECT (n * 7 + 1) % 25 FROM c) SELECT n FROM c", None),
    "c4_columns": ("WITH c(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM c WHERE a > 20", None),
    "f1_lower_f2_upper": ("SELECT c_custkey AS k, LOWER(c_name) AS lo, UPPER(c_mktsegment) AS up FROM customer", None),
    "f3_length": ("SELECT p_partkey AS k, CAST(LENGTH(p_name) AS BIGINT) AS n FROM part", None),
    "f4_trim": ("SELECT n_nationkey AS k, TRIM('  ' || n_name || ' ') AS t FROM nation", None),
    "f5_substring": ("SELECT p_partkey AS k, SUBSTRING(p_name, 2, 3) AS a, SUBSTRING(p_name, 4) AS b, SUBSTRING(p_name, 0, 2) AS c FROM part", "SELECT p_partkey AS k, substring(p_name, 2, 3) AS a, substring(p_name, 4) AS b, substring(p_name, 1, 2) AS c FROM part"),
    "f6_abs": ("SELECT c_custkey AS k, ABS(c_acctbal) AS a FROM customer", None),
    "f7_round": ("SELECT l_orderkey AS k, ROUND(l_extendedprice) AS r FROM lineitem", None),
    "f8_ceil_f9_floor": ("SELECT l_orderkey AS k, CEIL(l_extendedprice) AS c, FLOOR(l_extendedprice) AS f FROM lineitem", "SELECT l_orderkey AS k, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, CAST(floor(l_extendedprice) AS DOUBLE) AS f FROM lineitem"),
    "f10_now": ("SELECT n_nationkey AS k, (NOW() IS NOT NULL) AS ok FROM nation", None),
    "f11_date_part": ("SELECT event_id AS k, DATE_PART('year', ts) AS y, DATE_PART('month', ts) AS m, DATE_PART('day', ts) AS d, DATE_PART('hour', ts) AS h, DATE_PART('minute', ts) AS mi, DATE_PART('dow', ts) AS dow, DATE_PART('doy', ts) AS doy, DATE_PART('second', ts) AS s FROM events",
                      "SELECT event_id AS k, date_part('year', ts) AS y, date_part('month', ts) AS m, date_part('day', ts) AS d, date_part('hour', ts) AS h, date_part('minute', ts) AS mi, date_part('dow', ts) + 1 AS dow, date_part('doy', ts) AS doy, date_part('second', ts) AS s FROM events"),
    "f12_is_null": (f"SELECT t.k AS k, IS_NULL(t.r) AS n, IS_NOT_NULL(t.r) AS o FROM {SOME} t", f"SELECT t.k AS k, t.r IS NULL AS n, t.r IS NOT NULL AS o FROM {SOME} t"),
}

_INNER = {"plain": "SELECT n_regionkey FROM nation WHERE n_nationkey IN (3, 7)", "nulls": f"SELECT t.r FROM {SOME} t WHERE t.k < 8", "empty": "SELECT n_regionkey FROM nation WHERE n_nationkey < 0"}
for _word in ("any", "all"):
    for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
        _shown = ", ".join(f"t.r {_op} {_word.upper()} ({_sub}) AS {_kind}" for _kind, _sub in _INNER.items())
        QUERIES[f"p1{6 if _word == 'any' else 7}_{_word}_{_name}"] = (f"SELECT t.k AS k, {_shown} FROM {SOME} t", None)
for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    QUERIES[f"p6_compare_{_name}"] = (f"SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity {_op} 25", None)


def _session(spark: SparkSession, sf_dir: str) -> Session:
    db = Session(spark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return db


def _nations(db: Session, definition: str = "") -> None:
    db.execute(f"CREATE TABLE nations (k INTEGER PRIMARY KEY, v TEXT, r INTEGER{definition})")
    db.execute("INSERT INTO nations SELECT n_nationkey, n_name, n_regionkey FROM nation")


#: Changes of a table of nations (k, v, r): statements, then a query; and the oracle.
CHANGES: dict[str, tuple[list[str], str, str]] = {
    "d1_insert": (["INSERT INTO nations VALUES (100, 'A', 9), (101, NULL, 8)"], "SELECT k, v, r FROM nations",
                  "SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation UNION ALL SELECT 100, 'A', 9 UNION ALL SELECT 101, NULL, 8"),
    "d3_insert_select": (["INSERT INTO nations (k, v) SELECT n_nationkey + 200, n_name FROM nation WHERE n_regionkey = 1"], "SELECT k, v, r FROM nations",
                         "SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation UNION ALL SELECT n_nationkey + 200, n_name, NULL FROM nation WHERE n_regionkey = 1"),
    "d4_default": (["ALTER TABLE nations ALTER COLUMN v SET DEFAULT 'none'", "INSERT INTO nations (k) VALUES (77)"], "SELECT k, v FROM nations WHERE k > 70", "SELECT 77 AS k, 'none' AS v"),
    "d5_do_nothing": (["INSERT INTO nations (k, v) VALUES (3, 'X'), (99, 'NEW') ON CONFLICT (k) DO NOTHING"], "SELECT k, v FROM nations",
                      "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT 99, 'NEW'"),
    "d6_do_update": (["INSERT INTO nations (k, v) VALUES (3, 'X'), (99, 'NEW') ON CONFLICT (k) DO UPDATE SET v = excluded.v || v"], "SELECT k, v FROM nations",
                     "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'X' || n_name ELSE n_name END AS v FROM nation UNION ALL SELECT 99, 'NEW'"),
    "d8_update_ties": (["UPDATE nations SET v = s.s_name FROM supplier s WHERE nations.k = s.s_nationkey"], "SELECT k, v FROM nations",
                       "SELECT n_nationkey AS k, coalesce(least_name, n_name) AS v FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS least_name FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"),
    "d1_insert_many": (["INSERT INTO nations VALUES " + ", ".join(f"({i}, 'row {i}', {i % 7})" for i in range(1000, 1400))], "SELECT k, v, r FROM nations",
                       "SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation UNION ALL SELECT i, 'row ' || i, i % 7 FROM (SELECT CAST(unnest(range(1000, 1400)) AS INTEGER) AS i)"),
    "d7_update": (["UPDATE nations SET v = UPPER(v) || '!' WHERE r = 1"], "SELECT k, v FROM nations", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS v FROM nation"),
    "d8_update_from": (["UPDATE nations SET v = q.r_name FROM region q WHERE nations.r = q.r_regionkey AND q.r_regionkey > 2"], "SELECT k, v FROM nations",
                       "SELECT n_nationkey AS k, CASE WHEN n_regionkey > 2 THEN r_name ELSE n_name END AS v FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "d9_delete": (["DELETE FROM nations WHERE r = 2 OR k > 20"], "SELECT k FROM nations", "SELECT n_nationkey AS k FROM nation WHERE NOT (n_regionkey = 2 OR n_nationkey > 20)"),
    "d10_delete_using": (["DELETE FROM nations USING region q WHERE nations.r = q.r_regionkey AND q.r_regionkey = 0"], "SELECT k FROM nations", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 0"),
    "d11_truncate": (["TRUNCATE TABLE nations"], "SELECT k FROM nations", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 0"),
    "l9_on_delete": (["CREATE TABLE c (id INTEGER, n INTEGER REFERENCES nations(k) ON DELETE SET NULL)", "INSERT INTO c SELECT s_suppkey, s_nationkey FROM supplier", "DELETE FROM nations WHERE r = 4"],
                     "SELECT id, n FROM c", "SELECT CAST(s_suppkey AS INTEGER) AS id, CASE WHEN n_regionkey <> 4 THEN s_nationkey END AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "l10_on_update": (["CREATE TABLE c (id INTEGER, n INTEGER REFERENCES nations(k) ON UPDATE CASCADE)", "INSERT INTO c SELECT s_suppkey, s_nationkey FROM supplier", "UPDATE nations SET k = k + 500 WHERE r = 1"],
                      "SELECT id, n FROM c", "SELECT CAST(s_suppkey AS INTEGER) AS id, CASE WHEN n_regionkey = 1 THEN s_nationkey + 500 ELSE s_nationkey END AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "l12_view": (["CREATE VIEW low AS SELECT k, v FROM nations WHERE r < 2"], "SELECT k, v FROM low WHERE k > 3", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey < 2 AND n_nationkey > 3"),
    "l15_rename_column": (["ALTER TABLE nations RENAME COLUMN v TO label"], "SELECT label FROM nations", "SELECT n_name AS label FROM nation"),
    "l16_add_l17_drop": (["ALTER TABLE nations ADD COLUMN note TEXT", "ALTER TABLE nations DROP COLUMN v"], "SELECT k, note, r FROM nations", "SELECT n_nationkey AS k, CAST(NULL AS VARCHAR) AS note, n_regionkey AS r FROM nation"),
    "l22_alter_type": (["ALTER TABLE nations ALTER COLUMN r TYPE TEXT"], "SELECT k, r FROM nations", "SELECT n_nationkey AS k, CAST(n_regionkey AS VARCHAR) AS r FROM nation"),
    # Statements with ! are refused and leave everything as it was.
    "l1_create_table": (["CREATE TABLE IF NOT EXISTS nations (x INTEGER)", "!CREATE TABLE nations (x INTEGER)", "CREATE TABLE made (a INTEGER, b TEXT)", "INSERT INTO made SELECT k, v FROM nations"], "SELECT a, b FROM made", "SELECT n_nationkey AS a, n_name AS b FROM nation"),
    "l2_primary_key": (["!INSERT INTO nations VALUES (3, 'again', 0)", "!INSERT INTO nations VALUES (NULL, 'none', 0)", "!INSERT INTO nations VALUES (90, 'a', 0), (90, 'b', 0)", "!UPDATE nations SET k = 1 WHERE r = 2", "!INSERT INTO nations SELECT n_nationkey, n_name, 0 FROM nation"],
                       "SELECT k, v, r FROM nations", "SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation"),
    "l3_unique": (["CREATE TABLE u (id INTEGER, code TEXT UNIQUE)", "INSERT INTO u SELECT k, v FROM nations", "!INSERT INTO u VALUES (1, 'NATION_3')", "INSERT INTO u VALUES (101, NULL), (102, NULL)"], "SELECT id, code FROM u", "SELECT n_nationkey AS id, n_name AS code FROM nation UNION ALL SELECT 101, NULL UNION ALL SELECT 102, NULL"),
    "l4_not_null": (["CREATE TABLE n (id INTEGER NOT NULL, x TEXT)", "INSERT INTO n SELECT k, v FROM nations", "!INSERT INTO n VALUES (NULL, 'x')", "!INSERT INTO n SELECT CASE WHEN k <> 4 THEN k END, v FROM nations", "!UPDATE n SET id = NULL"], "SELECT id, x FROM n", "SELECT n_nationkey AS id, n_name AS x FROM nation"),
    "l5_check": (["CREATE TABLE q (id INTEGER, size INTEGER CHECK (size > 5))", "INSERT INTO q SELECT p_partkey, p_size FROM part WHERE p_size > 5", "!INSERT INTO q SELECT p_partkey, p_size FROM part", "!INSERT INTO q VALUES (1, 5)", "!UPDATE q SET size = size - 40"],
                 "SELECT id, size FROM q", "SELECT CAST(p_partkey AS INTEGER) AS id, p_size AS size FROM part WHERE p_size > 5"),
    "l6_default": (["CREATE TABLE f (id INTEGER, s TEXT DEFAULT 'new', n INTEGER DEFAULT 7)", "INSERT INTO f (id) SELECT k FROM nations", "INSERT INTO f (id, s) VALUES (500, NULL)"], "SELECT id, s, n FROM f", "SELECT n_nationkey AS id, 'new' AS s, 7 AS n FROM nation UNION ALL SELECT 500, NULL, 7"),
    "l7_foreign_key": (["!CREATE TABLE bad (x TEXT REFERENCES nations(v))", "!CREATE TABLE bad (x INTEGER REFERENCES nowhere(k))", "CREATE TABLE tree (id INTEGER PRIMARY KEY, up INTEGER REFERENCES tree(id))", "INSERT INTO tree SELECT k, CASE WHEN k > 0 THEN k - 1 END FROM nations"], "SELECT id, up FROM tree", "SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN n_nationkey - 1 END AS up FROM nation"),
    "l8_foreign_key_insert": (["CREATE TABLE c (id INTEGER, n INTEGER REFERENCES nations(k))", "INSERT INTO c SELECT s_suppkey, s_nationkey FROM supplier", "!INSERT INTO c SELECT s_suppkey, s_nationkey + 20 FROM supplier", "!INSERT INTO c VALUES (1, 77)", "INSERT INTO c VALUES (-1, NULL)", "!DELETE FROM nations"],
                              "SELECT id, n FROM c", "SELECT CAST(s_suppkey AS INTEGER) AS id, s_nationkey AS n FROM supplier UNION ALL SELECT -1, NULL"),
    "l11_drop_table": (["CREATE TABLE c (n INTEGER REFERENCES nations(k))", "INSERT INTO c SELECT s_nationkey FROM supplier", "!DROP TABLE nations", "DROP TABLE nations CASCADE", "!SELECT k FROM nations", "INSERT INTO c VALUES (999)", "DROP TABLE IF EXISTS nations"], "SELECT n FROM c", "SELECT s_nationkey AS n FROM supplier UNION ALL SELECT 999"),
    "l13_schema": (["CREATE SCHEMA other", "!CREATE SCHEMA other", "!CREATE TABLE nowhere.t (x INTEGER)", "CREATE TABLE other.nations (k INTEGER)", "INSERT INTO other.nations SELECT k * 2 FROM nations"], "SELECT k FROM other.nations", "SELECT n_nationkey * 2 AS k FROM nation"),
    "l14_rename_table": (["ALTER TABLE nations RENAME TO lands", "!SELECT k FROM nations"], "SELECT k, v FROM lands", "SELECT n_nationkey AS k, n_name AS v FROM nation"),
    "l17_drop_and_add": (["ALTER TABLE nations DROP COLUMN v", "ALTER TABLE nations ADD COLUMN v TEXT", "INSERT INTO nations (k, v) VALUES (70, 'seen')"], "SELECT k, v FROM nations", "SELECT n_nationkey AS k, NULL AS v FROM nation UNION ALL SELECT 70, 'seen'"),
    "l18_add_constraint": (["ALTER TABLE nations ADD CONSTRAINT low CHECK (r < 5)", "!INSERT INTO nations VALUES (71, 'x', 5)", "ALTER TABLE nations ADD CONSTRAINT one UNIQUE (v)", "!INSERT INTO nations VALUES (71, 'NATION_1', 1)", "INSERT INTO nations VALUES (72, 'y', 4)"], "SELECT k, r FROM nations", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation UNION ALL SELECT 72, 4"),
    "l19_drop_constraint": (["ALTER TABLE nations ADD CONSTRAINT low CHECK (r < 5)", "!ALTER TABLE nations DROP CONSTRAINT nope", "ALTER TABLE nations DROP CONSTRAINT low", "INSERT INTO nations VALUES (71, 'x', 5)"], "SELECT k, r FROM nations", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation UNION ALL SELECT 71, 5"),
    "l21_not_null": (["ALTER TABLE nations ALTER COLUMN r SET NOT NULL", "!INSERT INTO nations (k) VALUES (71)", "ALTER TABLE nations ALTER COLUMN r DROP NOT NULL", "INSERT INTO nations (k) VALUES (72)", "!ALTER TABLE nations ALTER COLUMN r SET NOT NULL"], "SELECT k, r FROM nations", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation UNION ALL SELECT 72, NULL"),
    "l23_create_index": (["CREATE INDEX by_r ON nations (r)", "!CREATE INDEX by_r ON nations (v)", "!CREATE UNIQUE INDEX one_r ON nations (r)", "CREATE UNIQUE INDEX one_v ON nations (v)", "!INSERT INTO nations VALUES (71, 'NATION_1', 1)", "INSERT INTO nations VALUES (72, 'y', 2)"],
                         "SELECT k, v FROM nations WHERE r = 2", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 72, 'y'"),
    "p23_unknown_column": (["!SELECT nope FROM nations", "!SELECT nations.nope FROM nations", "!SELECT k FROM nations a JOIN nations b ON a.k = b.k", "!INSERT INTO nations (nope) VALUES (1)", "!UPDATE nations SET nope = 1"], "SELECT k FROM nations", "SELECT n_nationkey AS k FROM nation"),
    "a14_group_by": (["!SELECT v, COUNT(*) FROM nations GROUP BY r", "!SELECT r FROM nations HAVING v = 'x'", "!SELECT k FROM nations WHERE COUNT(*) > 1"], "SELECT r, COUNT(*) AS n FROM nations GROUP BY r", "SELECT n_regionkey AS r, COUNT(*) AS n FROM nation GROUP BY 1"),
    "k24_rollback": (["BEGIN", "DELETE FROM nations WHERE k < 5", "ROLLBACK", "BEGIN", "DELETE FROM nations WHERE k > 20", "SAVEPOINT a", "DELETE FROM nations", "ROLLBACK TO SAVEPOINT a", "COMMIT"],
                     "SELECT k FROM nations", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey <= 20"),
}


def _refused(db: Session, statement: str) -> None:
    try:
        rows = db.execute(statement).rows
    except (SqlError, PySparkException):
        return
    raise AssertionError(f"not refused: {statement} ({rows})")


def _changed(statements: list[str], text: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _session(spark, sf_dir)
        _nations(db)
        for statement in statements:
            if statement.startswith("!"):
                _refused(db, statement[1:])
            else:
                db.execute(statement)
        return db.sql(text)

    return run


def _returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _session(spark, sf_dir)
    _nations(db)
    return db.sql("UPDATE nations SET v = LOWER(v) WHERE r = 3 RETURNING k, v")


# Commands over whole tables: lists and sets of each user's events, through the engine's forms for many keys.


def _keyed(make: Callable[[KeyValue, DataFrame], DataFrame], kind: str) -> Callable:
    """make gets the commands and (key, values), all users' lists or sets, which the store holds by then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kv = _session(spark, sf_dir).kv
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        key = F.concat(F.lit(f"{kind}:"), F.col("user_id").cast("string")).alias("key")
        if kind == "list":
            values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
        else:
            values = F.collect_set("event_type")
        given = events.groupBy(key).agg(values.alias("values"))
        (kv.push_many if kind == "list" else kv.add_many)(given)
        return make(kv, given)

    return run


def _with(given: DataFrame, *values: str) -> DataFrame:
    return given.select("key", F.array(*map(F.lit, values)).alias("values"))


def _after(kv: KeyValue, replies: DataFrame) -> DataFrame:
    """Replies beside what each key holds then, item by item."""
    held = kv.rows().select("key", F.posexplode_outer("items").alias("place", "item"))
    return replies.join(held, "key", "left").select(F.col("key").alias("k"), "reply", "place", "item")


_LISTS = "SELECT 'list:' || user_id AS k, list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id) AS items FROM events GROUP BY user_id"
_SETS = "SELECT 'set:' || user_id AS k, list(DISTINCT event_type ORDER BY event_type) AS members FROM events GROUP BY user_id"


def _list_oracle(reply: str, after: str) -> str:
    return f"SELECT k, reply, CAST(place AS INTEGER) AS place, after[place + 1] AS item FROM (SELECT k, {reply} AS reply, {after} AS after FROM ({_LISTS})), LATERAL (SELECT unnest(range(len(after))) AS place)"


def _set_rows(kv: KeyValue, replies: DataFrame) -> DataFrame:
    return replies.join(kv.members("set:*").withColumnRenamed("reply", "item"), "key", "left").select(F.col("key").alias("k"), "reply", "item")


def _popped(left: bool) -> Callable:
    def make(kv: KeyValue, given: DataFrame) -> DataFrame:
        replies = kv.pop_many(given, 2, left)
        rest = kv.sizes("list:*", "list").withColumnRenamed("reply", "rest")
        return replies.join(rest, "key", "left").select(F.col("key").alias("k"), F.posexplode("reply").alias("place", "v"), F.coalesce("rest", F.lit(0)).alias("rest"))

    return make


def _pop_oracle(items: str) -> str:
    return f"SELECT k, CAST(place AS INTEGER) AS place, popped[place + 1] AS v, rest FROM (SELECT k, {items}[1:2] AS popped, CAST(greatest(0, len(items) - 2) AS BIGINT) AS rest FROM ({_LISTS})), LATERAL (SELECT unnest(range(len(popped))) AS place)"


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("k"), F.col("reply").alias("v"))


KEYED: dict[str, tuple[Callable, str]] = {
    "k8_lpush": (_keyed(lambda kv, g: _after(kv, kv.push_many(_with(g, "a", "b"), left=True)), "list"), _list_oracle("CAST(len(items) + 2 AS BIGINT)", "list_concat(['b', 'a'], items)")),
    "k9_rpush": (_keyed(lambda kv, g: _after(kv, kv.push_many(_with(g, "a", "b"))), "list"), _list_oracle("CAST(len(items) + 2 AS BIGINT)", "list_concat(items, ['a', 'b'])")),
    "k10_lpop": (_keyed(_popped(True), "list"), _pop_oracle("items")),
    "k11_rpop": (_keyed(_popped(False), "list"), _pop_oracle("list_reverse(items)")),
    "k12_llen": (_keyed(lambda kv, g: _named(kv.sizes("list:*", "list")), "list"), f"SELECT k, len(items) AS v FROM ({_LISTS})"),
    "k13_lrange": (_keyed(lambda kv, g: _named(kv.range_many("list:*", -3, -1).select("key", F.explode("reply").alias("reply"))), "list"), f"SELECT k, unnest(items[greatest(1, len(items) - 2):]) AS v FROM ({_LISTS})"),
    "k14_sadd": (_keyed(lambda kv, g: _set_rows(kv, kv.add_many(_with(g, "new", "click"))), "set"),
                 f"SELECT k, CAST(1 + (NOT list_contains(members, 'click'))::INT AS BIGINT) AS reply, unnest(list_distinct(list_concat(members, ['new', 'click']))) AS item FROM ({_SETS})"),
    "k15_srem": (_keyed(lambda kv, g: _set_rows(kv, kv.remove_many(_with(g, "click", "none"))), "set"),
                 f"SELECT k, CAST(list_contains(members, 'click')::INT AS BIGINT) AS reply, item FROM ({_SETS}) LEFT JOIN (SELECT k AS j, unnest(members) AS item FROM ({_SETS})) ON j = k AND item <> 'click'"),
    "k16_smembers": (_keyed(lambda kv, g: _named(kv.members("set:*")), "set"), f"SELECT k, unnest(members) AS v FROM ({_SETS})"),
    "k17_scard": (_keyed(lambda kv, g: _named(kv.sizes("set:*", "set")), "set"), f"SELECT k, len(members) AS v FROM ({_SETS})"),
    "k18_sismember": (_keyed(lambda kv, g: _named(kv.is_member("set:*", "click")), "set"), f"SELECT k, list_contains(members, 'click') AS v FROM ({_SETS})"),
}


def _customers(spark: SparkSession, sf_dir: str) -> Session:
    """A store with customers as bytes and their JSON."""
    db = _session(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.kv.set_many(customers.select(F.concat(F.lit("name:"), "c_custkey").alias("key"), F.col("c_name").alias("value")))
    fields = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")))
    db.kv.set_many(customers.select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), fields.alias("value")), "json")
    return db


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).kv.keys("na?e:*1*").select(F.col("key").alias("k"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sql("SELECT id AS k, segment AS s, nation AS n FROM cust")


#: Commands, each with its reply.
SCRIPTS: dict[str, list[tuple[str, object]]] = {
    "k1_get_k2_set_k3_delete": [("GET city", None), ("SET city Oslo", "OK"), ("SET city Bergen", "OK"), ("GET city", "Bergen"), ("DELETE city nothing", 1), ("GET city", None)],
    "k5_json_set_k6_get_k7_del": [
        ("JSON.SET ship:9 '{\"name\": \"Ran\", \"crew\": {\"cook\": 1}}'", "OK"), ("JSON.SET ship:9.crew.mate 4", "OK"), ("JSON.GET ship:9.crew.mate", "4"), ("JSON.DEL ship:9.crew.cook", 1),
        ("JSON.DEL ship:9.crew.cook", 0), ("JSON.GET ship:9.crew", '{"mate": 4}'), ("JSON.DEL ship:9", 1), ("JSON.GET ship:9", None)],
    "k8_k13_one_list": [("LPUSH dock p q", 2), ("RPUSH dock r", 3), ("LLEN dock", 3), ("LPOP dock", "q"), ("RPOP dock", "r"), ("LPOP dock", "p"), ("LPOP dock", None), ("LLEN dock", 0)],
    "k14_k18_one_set": [("SADD flags red blue red", 2), ("SADD flags blue white", 1), ("SCARD flags", 3), ("SISMEMBER flags white", 1), ("SREM flags red green", 1), ("SISMEMBER flags red", 0), ("SCARD flags", 2)],
    "k19_ping_k20_flush": [("PING", "PONG"), ("SET x 1", "OK"), ("FLUSHDB", "OK"), ("GET x", None), ("WIPEDB", "OK")],
    "k21_save_k23_vacuum": [("SET x 1", "OK"), ("SET x 2", "OK"), ("SAVE", "OK"), ("VACUUM", 0), ("DELETE x", 1), ("GET x", None)],
    "k24_k25_transaction": [("BEGIN", "OK"), ("SET x 1", "OK"), ("SAVEPOINT a", "OK"), ("SET x 2", "OK"), ("ROLLBACK_TO_SAVEPOINT a", "OK"), ("GET x", "1"), ("RELEASE_SAVEPOINT a", "OK"), ("COMMIT", "OK"), ("BEGIN", "OK"), ("DELETE x", 1), ("ROLLBACK", "OK"), ("GET x", "1")],
    "l24_path_index": [("IDX.CREATE by_age user: age", 1), ("IDX.CREATE by_age user: age", 0), ("IDX.DROP by_age", 1), ("IDX.DROP by_age", 0), ("IDX.LIST", "{}")],
}


def _script(commands: list[tuple[str, object]]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cursor = connect(spark).cursor()
        replies = [(i, text, None if (row := cursor.execute(text).fetchone()) is None or row[0] is None else str(row[0])) for i, (text, _) in enumerate(commands)]
        return spark.createDataFrame(replies, "step int, command string, reply string")

    return run


def _script_oracle(commands: list[tuple[str, object]]) -> str:
    shown = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {shown(text)}, {shown(reply)})" for i, (text, reply) in enumerate(commands))
    return f"SELECT CAST(a AS INTEGER) AS step, b AS command, CAST(c AS VARCHAR) AS reply FROM (VALUES {rows}) t(a, b, c)"


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the store before and after a table is written."""
    db = _session(spark, sf_dir)
    before = db.size()
    _nations(db)
    return spark.createDataFrame([(before == 0, db.size() > before)], "empty boolean, larger boolean")


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store as another session finds it."""
    db = _session(spark, sf_dir)
    _nations(db)
    db.execute("DELETE FROM nations WHERE r = 1")
    return Session(spark, db.store.root).sql("SELECT k, v FROM nations")


def _isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session sees while another changes the table, and after it; the later of two committers fails."""
    db = _session(spark, sf_dir)
    _nations(db)
    other = Session(spark, db.store.root)
    count = lambda s, name: s.sql(f"SELECT '{name}' AS step, COUNT(*) AS n FROM nations")
    other.execute("BEGIN")
    steps = [count(other, "begun")]
    db.execute("DELETE FROM nations WHERE r = 0")
    steps += [count(db, "deleted"), count(other, "snapshot")]
    other.execute("DELETE FROM nations WHERE r = 1")
    _refused(other, "COMMIT")
    steps.append(count(other, "after"))
    return functools.reduce(DataFrame.unionByName, steps)


def _client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a connection, fetched one by one."""
    con = connect(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    with con:
        cursor = con.cursor()
        cursor.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        cursor.execute("INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= ?", [5])
        rows = list(cursor.execute("SELECT k, v FROM t"))
    return spark.createDataFrame(rows, "k int, v string")


OTHERS: dict[str, tuple[Callable, str]] = {
    "k4_keys": (_keys, "SELECT 'name:' || c_custkey AS k FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '%1%'"),
    "k6_json_documents": (_json, "SELECT c_custkey AS k, c_mktsegment AS s, CAST(c_nationkey AS BIGINT) AS n FROM customer"),
    "k22_memusage": (_memory, "SELECT true AS empty, true AS larger"),
    "k26_isolation": (_isolated, "SELECT * FROM (SELECT unnest(['begun', 'snapshot']) AS step, (SELECT COUNT(*) FROM nation) AS n UNION ALL SELECT unnest(['deleted', 'after']), (SELECT COUNT(*) FROM nation WHERE n_regionkey <> 0))"),
    "s8_s9_reopened": (_reopened, "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey <> 1"),
    "s11_client": (_client, "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey >= 5"),
}


def _query(text: str) -> Callable:
    return lambda spark, sf_dir: _session(spark, sf_dir).sql(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).sql(FLAGSHIP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "flagship": flagship,
        **{name: _query(text) for name, (text, _) in QUERIES.items()},
        **{name: _changed(statements, text) for name, (statements, text, _) in CHANGES.items()},
        "d12_returning": _returning,
        **{name: make for name, (make, _) in {**KEYED, **OTHERS}.items()},
        **{name: _script(commands) for name, commands in SCRIPTS.items()},
    }


def oracle_sql() -> dict[str, str]:
    return {
        "flagship": FLAGSHIP,
        **{name: oracle or text for name, (text, oracle) in QUERIES.items()},
        **{name: oracle for name, (_, _, oracle) in CHANGES.items()},
        "d12_returning": "SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_regionkey = 3",
        **{name: oracle for name, (_, oracle) in {**KEYED, **OTHERS}.items()},
        **{name: _script_oracle(commands) for name, commands in SCRIPTS.items()},
    }
