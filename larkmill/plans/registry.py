"""Queries of the engine with their DuckDB SQL, by name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.errors import PlanProblem
from larkmill.functions.kinds import Typed
from larkmill.models.runtime import split
from larkmill.operators.quality import Check, violations
from larkmill.plans.select import SelectPlanner
from larkmill.session import Engine
from larkmill.sources.connectors import ConnectorProblem
from larkmill.sql.parser import parse

FLAGSHIP = """
SELECT n.n_name, COUNT(*) AS orders, {revenue} AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_totalprice > 1000 GROUP BY n.n_name HAVING {having} > 1 ORDER BY revenue DESC, n_name LIMIT 10"""


def planner(spark: SparkSession, sf_dir: str) -> SelectPlanner:
    """Plans SELECTs over the Parquet tables of a folder."""

    def table(_: str | None, name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def connected(*_) -> DataFrame:
        raise ConnectorProblem("No connectors here")

    return SelectPlanner(spark, table, connected, {})


#: Name to the statement in the dialect and in DuckDB's SQL (None: the same text).
STATEMENTS: dict[str, tuple[str, str | None]] = {
    # projection and expressions
    "scan_region": ("SELECT * FROM region", None),
    "project_nation": ("SELECT n_name, n_regionkey FROM nation", None),
    "project_expr_lineitem": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", None),
    "alias_default_name": ("SELECT l_orderkey o, (l_quantity * 2) FROM lineitem", 'SELECT l_orderkey AS o, l_quantity * 2 AS "(l_quantity * 2)" FROM lineitem'),
    "unary_minus": ("SELECT l_orderkey, -l_linenumber AS neg FROM lineitem", None),
    "int_mod": ("SELECT l_orderkey % 7 AS m, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey % 7", None),
    "div_fractional": ("SELECT l_orderkey, l_linenumber / 2 AS half FROM lineitem", None),
    "literal_precedence": ("SELECT n_nationkey, 2 + 3 * 4 AS a, (2 + 3) * 4 AS b FROM nation", "SELECT n_nationkey, CAST(14 AS BIGINT) AS a, CAST(20 AS BIGINT) AS b FROM nation"),
    "bool_projection": ("SELECT p_partkey, p_size > 25 AS large FROM part", "SELECT p_partkey, CAST(p_size > 25 AS BIGINT) AS large FROM part"),
    "alias_in_projection": ("SELECT p_partkey, p_size * 2 AS twice, twice + 1 AS more FROM part", "SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS twice, CAST(p_size * 2 + 1 AS BIGINT) AS more FROM part"),
    # predicates
    "filter_eq_string": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", None),
    "filter_range_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.02", None),
    "filter_or_precedence": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 200000", None),
    "filter_arith": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 > 90", None),
    "filter_alias_in_where": ("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE net > 50000", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000"),
    "filter_mixed_type_false": ("SELECT c_custkey FROM customer WHERE c_name = 5 OR c_custkey < 10", "SELECT c_custkey FROM customer WHERE c_custkey < 10"),
    "filter_truthy": ("SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "filter_not_in_list": ("SELECT n_name FROM nation WHERE NOT n_regionkey IN (0, 1)", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 1)"),
    "filter_like_between": ("SELECT p_partkey FROM part WHERE p_type LIKE '%E%' AND p_size BETWEEN 5 AND 20", None),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", None),
    "scalar_subquery_avg": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "scalar_subquery_empty_zero": ("SELECT n_nationkey, (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS z FROM nation", "SELECT n_nationkey, CAST(0 AS INTEGER) AS z FROM nation"),
    # joins
    "join_inner": ("SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_three_way": ("SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_theta": ("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", None),
    "join_self_nation": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_right": ("SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey", None),
    "join_unaliased": ("SELECT n_name, r_name FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey", None),
    "join_filter_both_sides": ("SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_totalprice > 300000 AND l.l_quantity > 45", None),
    "join_full": ("SELECT s.s_suppkey, n.n_name FROM supplier s FULL OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", None),
    "join_full_bare": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_regionkey", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_regionkey >= r.r_regionkey", None),
    "join_semi": ("SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000", "SELECT c.c_custkey FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000"),
    "join_anti": ("SELECT c.c_custkey, c.c_name FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c.c_custkey, c.c_name FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey"),
    # several queries
    "union_all": ("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", None),
    "union_distinct": ("SELECT o_orderstatus AS s FROM orders UNION SELECT l_linestatus FROM lineitem", None),
    "intersect_rows": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0", None),
    "except_rows": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "set_precedence": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT c_nationkey FROM customer", None),
    "set_order_limit": ("SELECT n_name AS name, 1 AS kind FROM nation UNION ALL SELECT r_name, 2 FROM region ORDER BY name DESC LIMIT 12", "SELECT n_name AS name, CAST(1 AS BIGINT) AS kind FROM nation UNION ALL SELECT r_name, 2 FROM region ORDER BY name DESC LIMIT 12"),
    "named_query": ("WITH rich AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_acctbal > 5000) SELECT n, COUNT(*) AS c FROM rich GROUP BY n", "WITH rich AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_acctbal > 5000) SELECT n, COUNT(*) AS c FROM rich GROUP BY n"),
    "named_queries_chained": ("WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS m FROM a GROUP BY n) SELECT b.n, b.m, x.k FROM b JOIN a x ON x.n = b.n WHERE b.m < 5", None),
    # built-in functions in expressions
    "builtin_arithmetic": ("SELECT n_nationkey, length(n_name) + 1 AS a, -length(n_name) AS b, length(n_name) * 2 % 5 AS c FROM nation", "SELECT n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS a, CAST(-length(n_name) AS INTEGER) AS b, CAST(length(n_name) * 2 % 5 AS BIGINT) AS c FROM nation"),
    "builtin_filter": ("SELECT upper(c_name) AS u FROM customer WHERE length(c_name) > 3 AND substring(c_mktsegment, 1, 1) = 'B'", None),
    "builtin_aggregate": ("SELECT SUM(length(p_name)) AS s, AVG(abs(p_size - 25)) AS a FROM part", "SELECT CAST(SUM(length(p_name)) AS BIGINT) AS s, AVG(abs(p_size - 25)) AS a FROM part"),
    "no_from": ("SELECT 1 + 2 AS three, 'x' AS t", "SELECT CAST(3 AS BIGINT) AS three, 'x' AS t"),
    "comments": ("SELECT n_name // the name\n FROM nation /* of all */ WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "division_by_zero": ("SELECT n_nationkey, n_nationkey / (n_regionkey - n_regionkey) AS v FROM nation WHERE n_nationkey > 0", "SELECT n_nationkey, CAST('Infinity' AS DOUBLE) AS v FROM nation WHERE n_nationkey > 0"),
    # aggregation
    "group_rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", None),
    "group_cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", None),
    "sum_distinct": ("SELECT SUM(DISTINCT l_linenumber) AS s, COUNT(DISTINCT l_returnflag) AS n FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, COUNT(DISTINCT l_returnflag) AS n FROM lineitem"),
    "agg_global": ("SELECT COUNT(*) AS n, ROUND_2(SUM(l_quantity)) AS q, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem"),
    "agg_default_name": ("SELECT COUNT(*) FROM nation", 'SELECT COUNT(*) AS "COUNT(*)" FROM nation'),
    "agg_empty_input": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem WHERE l_quantity < 0", "SELECT COUNT(*) AS n, CAST(COALESCE(SUM(l_linenumber), 0) AS BIGINT) AS s FROM lineitem WHERE l_quantity < 0"),
    "count_expr": ("SELECT COUNT(c_name) AS n FROM customer", None),
    "min_max_string": ("SELECT MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer", None),
    "agg_expr_ratio": ("SELECT l_returnflag, ROUND_6(SUM(l_extendedprice) / COUNT(*)) AS mean FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 6) AS mean FROM lineitem GROUP BY l_returnflag"),
    "agg_of_expression": ("SELECT ROUND_2(SUM(l_extendedprice * (1 - l_discount))) AS revenue FROM lineitem", "SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem"),
    "count_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS n FROM orders", None),
    "group_string": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", None),
    "group_two_keys": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_expr": ("SELECT p_size > 25 AS large, COUNT(*) AS n FROM part GROUP BY p_size > 25", "SELECT CAST(p_size > 25 AS BIGINT) AS large, COUNT(*) AS n FROM part GROUP BY 1"),
    "group_alias": ("SELECT o_orderkey % 10 AS d, COUNT(*) AS n FROM orders GROUP BY d", None),
    "group_float_key": ("SELECT l_discount, COUNT(*) AS n FROM lineitem GROUP BY l_discount", None),
    "group_join": ("SELECT n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    "group_order_reversed": ("SELECT COUNT(*) AS n, o_orderpriority FROM orders GROUP BY o_orderpriority", None),
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "having_aggregate": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 2000000", None),
    "having_no_group": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10", None),
    "quantile_param": ("SELECT quantile(0.9)(o_totalprice) AS q FROM orders", "SELECT quantile_cont(o_totalprice, 0.9) AS q FROM orders"),
    "quantile_two_arg": ("SELECT QUANTILE(o_totalprice, 0.25) AS q FROM orders", "SELECT quantile_cont(o_totalprice, 0.25) AS q FROM orders"),
    "median": ("SELECT median(l_quantity) AS m FROM lineitem", "SELECT median(l_quantity) AS m FROM lineitem"),
    "percentile": ("SELECT PERCENTILE(p_retailprice, 90) AS p FROM part", "SELECT quantile_cont(p_retailprice, 0.9) AS p FROM part"),
    "quantile_by_group": ("SELECT o_orderstatus, quantile(0.5)(o_totalprice) AS q FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS q FROM orders GROUP BY o_orderstatus"),
    # windows
    "ntile_global": ("SELECT s_suppkey, NTILE(4) OVER (ORDER BY s_suppkey) AS b FROM supplier", "SELECT s_suppkey, CAST(NTILE(4) OVER (ORDER BY s_suppkey) AS BIGINT) AS b FROM supplier"),
    "ntile_global_text": ("SELECT c_custkey, NTILE(7) OVER (ORDER BY c_mktsegment DESC, c_custkey) AS b FROM customer", "SELECT c_custkey, CAST(NTILE(7) OVER (ORDER BY c_mktsegment DESC, c_custkey) AS BIGINT) AS b FROM customer"),
    "ntile_partitioned": ("SELECT o_orderkey, NTILE(3) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders", "SELECT o_orderkey, CAST(NTILE(3) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS b FROM orders"),
    "win_sum_partition": ("SELECT l_orderkey, l_linenumber, SUM(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(SUM(l_linenumber) OVER (PARTITION BY l_orderkey) AS BIGINT) AS s FROM lineitem"),
    "win_minmax": ("SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders", None),
    "win_quantile": ("SELECT o_orderkey, quantile(0.5)(o_totalprice) OVER (PARTITION BY o_custkey) AS q FROM orders", "SELECT o_orderkey, quantile_cont(o_totalprice, 0.5) OVER (PARTITION BY o_custkey) AS q FROM orders"),
    "win_whole_table": ("SELECT s_suppkey, COUNT(*) OVER () AS n, SUM(s_nationkey) OVER () AS t, MAX(s_name) OVER () AS m FROM supplier", "SELECT s_suppkey, COUNT(*) OVER () AS n, CAST(SUM(s_nationkey) OVER () AS BIGINT) AS t, MAX(s_name) OVER () AS m FROM supplier"),
    "win_sum_bool": ("SELECT o_orderkey, SUM(o_totalprice > 150000) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice > 150000 AS BIGINT)) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders"),
    "win_distinct": ("SELECT o_orderkey, COUNT(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders", None),
    # order and limit
    "order_multi": ("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 50", None),
    "order_hidden_column": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None),
    "order_desc_string": ("SELECT c_name FROM customer ORDER BY c_name DESC LIMIT 10", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "limit_n": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7", None),
    "limit_mysql": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7"),
    "limit_zero": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0", None),
    "offset_past_end": ("SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 100", None),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "from_subquery": ("SELECT q.s, COUNT(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 100000) q GROUP BY q.s", None),
    # tables that the dialect has no functions of their own for
    "documents_by_source": ("SELECT source, COUNT(*) AS n, SUM(n_chars) AS chars FROM documents GROUP BY source", "SELECT source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source"),
    "conversation_roles": ("SELECT role, COUNT(*) AS n, MAX(turn) AS last FROM conversations GROUP BY role", None),
    "labelled_documents": ("SELECT d.lang, l.quality, COUNT(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality", None),
    "events_by_type": ("SELECT event_type, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY event_type", None),
    "star_join_group_having_order": (FLAGSHIP.format(revenue="ROUND_2(SUM(l.l_extendedprice * (1 - l.l_discount)))", having="orders"), FLAGSHIP.format(revenue="ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2)", having="COUNT(*)")),
}

for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*")):
    STATEMENTS[f"fn_{_name}"] = (f"SELECT p_partkey, {_name}(p_size, p_retailprice) AS v FROM part", f"SELECT p_partkey, CAST(p_size AS DOUBLE) {_op} p_retailprice AS v FROM part")
STATEMENTS["fn_div"] = ("SELECT p_partkey, div(p_retailprice, p_size % 5) AS v FROM part", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 5) END AS v FROM part")
STATEMENTS["fn_mod"] = ("SELECT p_partkey, mod(p_size, p_size % 3) AS v FROM part", "SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size % (p_size % 3) END AS DOUBLE) AS v FROM part")
for _name, _op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    STATEMENTS[f"fn_{_name}"] = (f"SELECT p_partkey, {_name}(p_size, 25) AS v FROM part", f"SELECT p_partkey, CAST(p_size {_op} 25 AS INTEGER) AS v FROM part")


def _statement(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUND_n(x) in the texts above is x rounded to n digits, which keeps float sums comparable between engines."""
    plan = planner(spark, sf_dir)
    for n in set(re.findall(r"ROUND_(\d)", text)):
        plan.functions[f"ROUND_{n}"] = lambda x, n=int(n): Typed(F.round(x.col, n), "float")
    return plan.plan(parse(text))


# statements that need a catalog: each runs in an engine of its own


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    e = Engine(spark)
    e.register_parquet(sf_dir, *tables)
    return e


def view_simple(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.sql("CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
    return e.sql("SELECT * FROM rich")


def view_chained(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.sql("CREATE VIEW rich AS SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal > 5000")
    e.sql("CREATE VIEW richest AS SELECT c_custkey, c_nationkey FROM rich WHERE c_acctbal > 9000")
    return e.sql("SELECT c_nationkey, COUNT(*) AS n FROM richest GROUP BY c_nationkey")


def view_aggregate(spark, sf_dir):
    e = _engine(spark, sf_dir, "orders")
    e.sql("CREATE VIEW per_customer AS SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
    return e.sql("SELECT n, COUNT(*) AS customers FROM per_customer GROUP BY n")


def mv_refresh(spark, sf_dir):
    """Filled when made, stale after an insert, and full again after the refresh."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE copy (k Int32, name String)")
    e.sql("INSERT INTO copy SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    e.sql("CREATE MATERIALIZED VIEW counted AS SELECT COUNT(*) AS n FROM copy")
    before = e.sql("SELECT n FROM counted").first().n
    e.sql("INSERT INTO copy SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
    stale = e.sql("SELECT n FROM counted").first().n
    e.sql("REFRESH MATERIALIZED VIEW counted")
    return e.sql("SELECT n FROM counted").select(F.lit(before).cast("long").alias("before"), F.lit(stale).cast("long").alias("stale"), F.col("n").alias("fresh"))


def insert_select_roundtrip(spark, sf_dir):
    e = _engine(spark, sf_dir, "part")
    e.sql("CREATE TABLE copy (k Int64, name String, price Float64)")
    e.sql("INSERT INTO copy SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size < 25")
    e.sql("INSERT INTO copy (name, k) SELECT p_name, p_partkey FROM part WHERE p_size >= 25")
    return e.sql("SELECT k, name, price FROM copy")


def insert_select_text(spark, sf_dir):
    """Text converts when all of it does."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE raw (k String)")
    e.sql("INSERT INTO raw VALUES (' 7 '), ('12'), ('-3')")
    e.sql("CREATE TABLE typed (n Int64)")
    e.sql("INSERT INTO typed SELECT k FROM raw")
    return e.sql("SELECT n FROM typed")


def dictionary_engine(spark, sf_dir):
    """The last value of a key counts."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE names (k Int64, v String) ENGINE = Dictionary")
    e.sql("INSERT INTO names SELECT n_nationkey, n_name FROM nation")
    e.sql("INSERT INTO names SELECT n_regionkey, n_name FROM nation WHERE n_nationkey = 0")
    return e.sql("SELECT k, v FROM names")


def alter_table_columns(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (k Int32, name String, extra Int64)")
    e.sql("INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    e.sql("ALTER TABLE t DROP COLUMN extra, MODIFY COLUMN k Int64, ADD COLUMN note String")
    return e.sql("SELECT k, name, note FROM t")


def alter_dictionary(spark, sf_dir):
    """Another type for the value keeps every value; a third column is refused."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE names (k Int64, v Int64) ENGINE = Dictionary")
    e.sql("INSERT INTO names SELECT n_nationkey, n_regionkey FROM nation")
    e.sql("INSERT INTO names VALUES (3, 77)")
    e.sql("ALTER TABLE names MODIFY COLUMN v String")
    for change in ("ADD COLUMN w String", "DROP COLUMN v"):
        try:
            e.sql(f"ALTER TABLE names {change}")
        except PlanProblem:
            e.sql("INSERT INTO names VALUES (99, 'refused')")
    e.sql("INSERT INTO names VALUES (4, 'later')")
    return e.sql("SELECT k, v FROM names")


def alter_refused(spark, sf_dir):
    """A type that a value does not convert to changes nothing."""
    e = _engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (k Int64, name String)")
    e.sql("INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    try:
        e.sql("ALTER TABLE t MODIFY COLUMN name Int64")
    except PlanProblem:
        e.sql("ALTER TABLE t MODIFY COLUMN k String")
    return e.sql("SELECT k, name FROM t")


def insert_refused(spark, sf_dir):
    """All rows or none."""
    e = _engine(spark, sf_dir, "customer")
    e.sql("CREATE TABLE t (v Int64)")
    e.sql("INSERT INTO t SELECT c_custkey FROM customer WHERE c_custkey < 20")
    try:
        e.sql("INSERT INTO t SELECT c_name FROM customer")
    except PlanProblem:
        return e.sql("SELECT v FROM t")


def tables_listed(spark, sf_dir):
    """What is there after CREATE, DROP, DETACH and TRUNCATE in two databases."""
    e = _engine(spark, sf_dir, "region")
    for s in ("CREATE DATABASE d", "USE d", "CREATE TABLE a (k Int64)", "CREATE TABLE b (k Int64) ENGINE = Memory", "CREATE TABLE c (k Int64)", "INSERT INTO a SELECT r_regionkey FROM region", "INSERT INTO b SELECT r_regionkey FROM region", "TRUNCATE TABLE a", "DROP TABLE c"):
        e.sql(s)
    rows = e.sql("SELECT COUNT(*) AS n FROM a").withColumn("t", F.lit("a")).union(e.sql("SELECT COUNT(*) AS n FROM b").withColumn("t", F.lit("b")))
    names = sorted(r[0] for r in e.sql("SHOW TABLES").collect())
    return rows.select("t", "n", F.lit(",".join(names)).alias("tables"))


def view_altered(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    for s in ("CREATE VIEW v AS SELECT n_name FROM nation WHERE n_regionkey = 0", "CREATE VIEW w AS SELECT n_name FROM nation", "ALTER VIEW v AS SELECT n_name FROM nation WHERE n_regionkey = 3 UNION SELECT n_name FROM nation WHERE n_nationkey = 0", "DROP VIEW w"):
        e.sql(s)
    return e.sql("SELECT n_name FROM v").withColumn("views", F.lit(e.sql("SHOW VIEWS").count()))


def mv_schedule(spark, sf_dir):
    """Refreshed when its time has come, not before."""
    e = _engine(spark, sf_dir, "nation")
    for s in ("CREATE TABLE t (k Int64)", "CREATE MATERIALIZED VIEW m AS SELECT COUNT(*) AS n FROM t", "ALTER MATERIALIZED VIEW m SET REFRESH EVERY 1 HOUR", "INSERT INTO t SELECT n_nationkey FROM nation"):
        e.sql(s)
    now = datetime.now(UTC)
    early = [e.tick(now), e.sql("SELECT n FROM m").first().n]
    late = [e.tick(now + timedelta(hours=2)), e.sql("SELECT n FROM m").first().n]
    return e.rows(["early", "late", "state"], [[early[1], late[1], late[0][0][1]]])


def data_types_described(spark, sf_dir):
    e = _engine(spark, sf_dir, "part")
    e.sql("CREATE TABLE t (a Int64, b String, c Float64, d Date, e Bool, f Int32)")
    return e.sql("DESCRIBE TABLE t")


def parquet_roundtrip(spark, sf_dir):
    path = f"{Engine(spark).root}/orders"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def shown_text(spark, sf_dir):
    """The result sink's two forms of one result."""
    e = _engine(spark, sf_dir, "region")
    q = e.sql("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 2")
    return e.rows(["rows", "lines"], [[len(json.loads(e.shown(q))), len(e.shown(q, "TSV").split("\n"))]])


def explained(spark, sf_dir):
    """Whether the filter reaches the scan, and the membership is a semi join."""
    e = _engine(spark, sf_dir, "orders", "customer")
    text = "\n".join(r.plan for r in e.sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)").collect())
    return e.rows(["pushed", "semi", "existence"], [["GreaterThan(o_totalprice" in text, "LeftSemi" in text, "ExistenceJoin" in text]])


def registered_function(spark, sf_dir):
    e = _engine(spark, sf_dir, "part")
    e.register_function("taxed", lambda price, rate: price * (1 + rate))
    return e.sql("SELECT p_partkey, taxed(p_retailprice, 0.5) AS t FROM part WHERE taxed(p_retailprice, 0.5) > 1500")


def topology_listed(spark, sf_dir):
    e = Engine(spark)
    for s in ("CREATE NODE a TYPE COMPUTE ROLE WORKER", "REGISTER NODE b HOST '127.0.0.1' PORT 9001", "CREATE CLUSTER c", "ALTER CLUSTER c ADD NODE a, ADD NODE b", "CREATE SHARD_GROUP g TYPE HASH KEY k SHARDS 4"):
        e.sql(s)
    status = e.sql("SHOW CLUSTER STATUS c").first()
    shards = e.sql("SHOW SHARDS g").count()
    return e.rows(["cluster", "state", "shards", "nodes"], [[status[0], status[1], shards, e.sql("SHOW NODES").count()]])


def storage_units(spark, sf_dir):
    e = _engine(spark, sf_dir, "region")
    e.sql(f"CREATE STORAGE_UNIT fast TYPE LOCAL PATH '{e.root}/fast'")
    e.sql("CREATE TABLE t (k Int64) STORAGE_UNIT fast")
    e.sql("INSERT INTO t SELECT r_regionkey FROM region")
    there = all(f"{e.root}/fast" in p for p in e.tables.need("default", "t")["parts"])
    return e.sql("SELECT k FROM t").withColumn("there", F.lit(there))


def quality_listed(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.sql("CREATE DATA_QUALITY_RULE a ON customer UNIQUE c_custkey")
    e.sql("CREATE DATA_QUALITY_RULE b ON customer MIN_ROWS 1 ACTION WARN")
    for r in ("a", "b"):
        e.sql(f"RUN DATA_QUALITY_RULE {r}")
    shown = e.sql("SHOW DATA_QUALITY_RULES")
    return shown.select(F.col(shown.columns[0]).alias("rule"))


def pipeline_failure(spark, sf_dir):
    """A task that Spark ends, one whose SELECT runs, and those that come after a failure."""
    e = _engine(spark, sf_dir, "nation")
    for s in (
        "CREATE PIPELINE p OWNER 'me'", "CREATE STAGE s IN PIPELINE p ORDER 1", "CREATE TASK a IN STAGE s IN PIPELINE p TYPE SQL BODY 'SELECT n_name FROM nation'",
        "CREATE TASK b IN STAGE s IN PIPELINE p TYPE SQL BODY 'SELECT n_nationkey % (n_regionkey - n_regionkey) AS x FROM nation' DEPENDS ON a", "CREATE TASK c IN STAGE s IN PIPELINE p TYPE BUILT_IN DEPENDS ON b", "RUN PIPELINE p",
    ):
        e.sql(s)
    return e.sql("SHOW TASK_RUNS FOR PIPELINE p").select("task", "status", (F.length("error") > 0).alias("said_why"))


def pipeline_triggers(spark, sf_dir):
    """A schedule, an insert and a web call each make the pipeline run once."""
    e = _engine(spark, sf_dir, "nation")
    for s in (
        "CREATE TABLE t (k Int64)", "CREATE TABLE log (k Int64)", "CREATE PIPELINE p OWNER 'me'", "CREATE STAGE s IN PIPELINE p ORDER 1", "CREATE TASK a IN STAGE s IN PIPELINE p TYPE SQL BODY 'INSERT INTO log VALUES (1)'",
        "CREATE TRIGGER at ON PIPELINE p SCHEDULE '5 * * * *'", "CREATE TRIGGER into ON PIPELINE p ON INSERT INTO t", "CREATE TRIGGER hook ON PIPELINE p WEBHOOK SECRET 'x'",
    ):
        e.sql(s)
    e.pipelines.tick(datetime(2026, 1, 1, 0, 5, tzinfo=UTC))
    e.sql("INSERT INTO t SELECT n_nationkey FROM nation")
    e.pipelines.tick(datetime(2026, 1, 1, 0, 6, tzinfo=UTC))
    refused, queued = e.pipelines.webhook("p", "hook", "y"), e.pipelines.webhook("p", "hook", "x")
    e.pipelines.tick(datetime(2026, 1, 1, 0, 7, tzinfo=UTC))
    return e.sql("SELECT COUNT(*) AS runs FROM log").select("runs", F.lit(refused).alias("refused"), F.lit(queued).alias("queued"))


def stream_retention(spark, sf_dir):
    """Events past their stream's days go; offsets go on from where they were."""
    e = Engine(spark)
    for s in ("CREATE STREAM s RETAIN 7 DAYS", "INSERT INTO s VALUES ('a'), ('b')"):
        e.sql(s)
    e.purge(datetime.now(UTC) + timedelta(days=9))
    e.sql("INSERT INTO s VALUES ('c')")
    return e.sql("SUBSCRIBE s")


def _trained(spark, sf_dir) -> Engine:
    e = _engine(spark, sf_dir, "customer")
    e.sql("CREATE VIEW known AS SELECT c_custkey AS k, c_acctbal AS bal, c_nationkey AS nation, c_acctbal > 4000 AS rich FROM customer")
    for s in (
        "CREATE FEATURE_SET f FROM known ENTITY_KEY(k) FEATURES(bal, nation) TARGET rich", "CREATE MODEL m TYPE CLASSIFICATION",
        "CREATE TRAINING_JOB j MODEL m FEATURE_SET f FRAMEWORK SKLEARN ALGORITHM DecisionTreeClassifier OBJECTIVE ACCURACY", "RUN TRAINING_JOB j",
    ):
        e.sql(s)
    return e


def model_predictions(spark, sf_dir):
    """The predictions of a table, as they were kept, right by the rule that the labels follow but next to its border."""
    e = _trained(spark, sf_dir)
    e.sql("PREDICT MODEL m:1 FROM known")
    kept = e.sql("SELECT p.entity_key, p.prediction, k.bal FROM m_predictions p JOIN known k ON CAST(k.k AS String) = p.entity_key")
    return kept.select("entity_key", ((F.col("prediction") == (F.col("bal") > 4000).cast("int").cast("string")) | (F.abs(F.col("bal") - 4000) < 500)).alias("fits"))


def model_explained(spark, sf_dir):
    shares = _trained(spark, sf_dir).sql("EXPLAIN MODEL m:1")
    return shares.select("feature", (F.col("importance") > 0.9).alias("main"))


def model_split(spark, sf_dir):
    """Each label has its three quarters in the training part, a row or a five-thousandth more or less."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    train, held = split(df, "c_custkey", "c_mktsegment")
    share = train.groupBy("c_mktsegment").agg(F.count("*").alias("a")).join(df.groupBy("c_mktsegment").agg(F.count("*").alias("b")), "c_mktsegment")
    return share.select("c_mktsegment", (F.abs(F.col("a") - 0.75 * F.col("b")) <= 1 + F.col("b") / 5000).alias("even"), F.lit(train.count() + held.count()).alias("rows"))


def csv_roundtrip(spark, sf_dir):
    from larkmill.sources.formats import read_csv, write_csv

    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_retailprice")
    path = f"{Engine(spark).root}/part.csv"
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def binary_backup_roundtrip(spark, sf_dir):
    from larkmill.sources.formats import backup, restore

    folder = f"{Engine(spark).root}/backups"
    backup(spark.read.parquet(f"{sf_dir}/nation.parquet"), folder, "nation")
    return restore(spark, folder, "nation")


def stream_publish_subscribe(spark, sf_dir):
    """Two reads of a group follow on each other."""
    e = Engine(spark)
    for s in ("CREATE TOPIC t PARTITIONS 4", "CREATE STREAM s TOPIC t RETAIN 7 DAYS", "CREATE CONSUMER_GROUP g", "PUBLISH t VALUES ('a'), ('b'), ('c')"):
        e.sql(s)
    first = e.sql("SUBSCRIBE s CONSUMER_GROUP g LIMIT 2")
    return first.withColumn("round", F.lit("1")).union(e.sql("SUBSCRIBE s CONSUMER_GROUP g LIMIT 2").withColumn("round", F.lit("2")))


def consumer_lag(spark, sf_dir):
    e = Engine(spark)
    for s in ("CREATE STREAM s", "CREATE CONSUMER_GROUP g", "INSERT INTO s VALUES ('a'), ('b'), ('c')"):
        e.sql(s)
    e.sql("SUBSCRIBE s CONSUMER_GROUP g LIMIT 2")
    return e.sql("SHOW STREAM_METRICS")


def stream_events(spark, sf_dir):
    """All events through a stream's log, then by offset: dense offsets in the order of event_id."""
    e = Engine(spark)
    e.sql("CREATE STREAM s")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.append_stream("s", events.select("event_id", F.col("event_type").alias("payload")), ["event_id"])
    from larkmill.streaming import log

    return log.read(spark, e.root, "s").select("offset", "payload")


def stream_windows(spark, sf_dir):
    from larkmill.streaming.log import windowed_counts

    counted = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "10 minutes", "ts", "event_type")
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events")


def stream_windows_sliding(spark, sf_dir):
    from larkmill.streaming.log import windowed_counts

    counted = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "3 hours", "10 minutes", "ts", "event_type", slide="1 hour")
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events")


def stream_sessions(spark, sf_dir):
    from larkmill.streaming.log import session_counts

    counted = session_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "10 minutes", "ts", "user_id")
    return counted.select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "events")


def dq_checks(spark, sf_dir):
    """Four checks on one table; RANGE and EXPRESSION in one pass."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    checks = [Check("UNIQUE", "o_custkey"), Check("RANGE", "o_totalprice", low=1000, high=200000), Check("EXPRESSION", condition=F.col("o_orderstatus") != "F"), Check("MIN_ROWS", min_rows=10**7)]
    return spark.createDataFrame(list(zip([c.kind for c in checks], violations(df, checks), strict=True)), "kind string, violations long")


def dq_rule(check: str, spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.sql(f"CREATE DATA_QUALITY_RULE r ON customer {check} ACTION WARN")
    return e.sql("RUN DATA_QUALITY_RULE r").select("rule", "status", "violations")


def pipeline_run(spark, sf_dir):
    """Three tasks in the order of their dependencies, with what each run left."""
    e = _engine(spark, sf_dir, "nation")
    for s in (
        "CREATE TABLE out (k Int64)", "CREATE DATA_QUALITY_RULE full ON out MIN_ROWS 25", "CREATE PIPELINE p OWNER 'me'", "CREATE STAGE s IN PIPELINE p ORDER 1",
        "CREATE TASK a_check IN STAGE s IN PIPELINE p TYPE QUALITY BODY 'full' DEPENDS ON load", "CREATE TASK load IN STAGE s IN PIPELINE p TYPE SQL BODY 'INSERT INTO out SELECT n_nationkey FROM nation'",
        "CREATE TASK z IN STAGE s IN PIPELINE p TYPE BUILT_IN DEPENDS ON a_check", "RUN PIPELINE p",
    ):
        e.sql(s)
    return e.sql("SHOW TASK_RUNS FOR PIPELINE p").select("stage", "task", "status")


def feature_set_projection(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.sql("CREATE FEATURE_SET f FROM customer ENTITY_KEY(c_custkey) FEATURES(c_acctbal, c_nationkey) TARGET c_mktsegment")
    return e.feature_rows("f")


def model_train_metrics(spark, sf_dir):
    """Metric names and whether each is between 0 and 1."""
    e = _engine(spark, sf_dir, "documents", "labels")
    e.sql("CREATE VIEW labelled AS SELECT d.doc_id AS doc_id, d.n_chars AS n_chars, d.lang AS lang, l.toxic AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    for s in ("CREATE FEATURE_SET f FROM labelled ENTITY_KEY(doc_id) FEATURES(n_chars, lang) TARGET toxic", "CREATE MODEL m TYPE CLASSIFICATION", "CREATE TRAINING_JOB j MODEL m FEATURE_SET f FRAMEWORK SKLEARN ALGORITHM LogisticRegression OBJECTIVE ACCURACY", "RUN TRAINING_JOB j"):
        e.sql(s)
    return e.sql("COMPARE MODELS m:1").select("model", "version", "metric", F.col("value").between(0, 1).alias("sane"))


def shard_layout(spark, sf_dir):
    """Rows by shard of a shard group's hash: Spark's partitioning stands for the shards."""
    e = _engine(spark, sf_dir, "orders")
    e.sql("CREATE SHARD_GROUP g TYPE HASH KEY o_custkey SHARDS 8")
    e.sql("CREATE TABLE o (o_orderkey Int64, o_custkey Int64) SHARD_GROUP g")
    e.sql("INSERT INTO o SELECT o_orderkey, o_custkey FROM orders")
    return e.tables.sharded("default", "o", "o_custkey", 8).groupBy("o_custkey").agg(F.count("*").alias("n"))


#: Name to (query, SQL or None).
PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "view_simple": (view_simple, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000"),
    "view_chained": (view_chained, "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey"),
    "view_aggregate": (view_aggregate, "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "mv_refresh": (mv_refresh, "SELECT COUNT(*) FILTER (n_regionkey = 1) AS before, COUNT(*) FILTER (n_regionkey = 1) AS stale, COUNT(*) FILTER (n_regionkey IN (1, 2)) AS fresh FROM nation"),
    "insert_select_roundtrip": (insert_select_roundtrip, "SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size < 25 THEN p_retailprice END AS price FROM part"),
    "insert_select_text": (insert_select_text, "SELECT CAST(n AS BIGINT) AS n FROM (VALUES (7), (12), (-3)) t(n)"),
    "dictionary_engine": (dictionary_engine, "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) THEN (SELECT n_name FROM nation WHERE n_nationkey = 0) ELSE n_name END AS v FROM nation"),
    "alter_table_columns": (alter_table_columns, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation"),
    "alter_dictionary": (alter_dictionary, "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE n_nationkey WHEN 3 THEN '77' WHEN 4 THEN 'later' ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation UNION ALL SELECT 99, 'refused'"),
    "alter_refused": (alter_refused, "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation"),
    "insert_refused": (insert_refused, "SELECT CAST(c_custkey AS BIGINT) AS v FROM customer WHERE c_custkey < 20"),
    "tables_listed": (tables_listed, "SELECT 'a' AS t, CAST(0 AS BIGINT) AS n, 'a,b' AS tables UNION ALL SELECT 'b', COUNT(*), 'a,b' FROM region"),
    "view_altered": (view_altered, "SELECT n_name, 1 AS views FROM nation WHERE n_regionkey = 3 OR n_nationkey = 0"),
    "mv_schedule": (mv_schedule, "SELECT '0' AS early, CAST(COUNT(*) AS VARCHAR) AS late, 'READY' AS state FROM nation"),
    "data_types_described": (data_types_described, "SELECT * FROM (VALUES ('a', 'Int64'), ('b', 'String'), ('c', 'Float64'), ('d', 'Date'), ('e', 'Bool'), ('f', 'Int32')) t(name, type)"),
    "parquet_roundtrip": (parquet_roundtrip, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "shown_text": (shown_text, "SELECT '2' AS rows, '3' AS lines"),
    "explained": (explained, "SELECT 'True' AS pushed, 'True' AS semi, 'False' AS existence"),
    "registered_function": (registered_function, "SELECT p_partkey, p_retailprice * 1.5::DOUBLE AS t FROM part WHERE p_retailprice * 1.5::DOUBLE > 1500"),
    "topology_listed": (topology_listed, "SELECT 'c' AS cluster, 'DEGRADED' AS state, '4' AS shards, '2' AS nodes"),
    "storage_units": (storage_units, "SELECT CAST(r_regionkey AS BIGINT) AS k, TRUE AS there FROM region"),
    "quality_listed": (quality_listed, "SELECT * FROM (VALUES ('a'), ('b')) t(rule)"),
    "pipeline_failure": (pipeline_failure, "SELECT * FROM (VALUES ('a', 'SUCCESS', FALSE), ('b', 'FAILED', TRUE), ('c', 'SKIPPED', FALSE)) t(task, status, said_why)"),
    "pipeline_triggers": (pipeline_triggers, "SELECT CAST(3 AS BIGINT) AS runs, 401 AS refused, 202 AS queued"),
    "stream_retention": (stream_retention, "SELECT '2' AS \"offset\", 'c' AS payload"),
    "model_predictions": (model_predictions, "SELECT CAST(c_custkey AS VARCHAR) AS entity_key, TRUE AS fits FROM customer"),
    "model_explained": (model_explained, "SELECT * FROM (VALUES ('bal', TRUE), ('nation', FALSE)) t(feature, main)"),
    "model_split": (model_split, "SELECT DISTINCT c_mktsegment, TRUE AS even, (SELECT CAST(COUNT(*) AS INTEGER) FROM customer) AS rows FROM customer"),
    "csv_roundtrip": (csv_roundtrip, "SELECT p_partkey, p_name, p_retailprice FROM part"),
    "binary_backup_roundtrip": (binary_backup_roundtrip, "SELECT * FROM nation"),
    "stream_publish_subscribe": (stream_publish_subscribe, "SELECT * FROM (VALUES ('0', 'a', '1'), ('1', 'b', '1'), ('2', 'c', '2')) t(\"offset\", payload, round)"),
    "consumer_lag": (consumer_lag, "SELECT 's' AS stream, '3' AS event_count, '1' AS consumer_lag"),
    "stream_events": (stream_events, 'SELECT ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS "offset", event_type AS payload FROM events'),
    "stream_windows": (stream_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS events FROM events GROUP BY 1, 2"),
    "stream_windows_sliding": (stream_windows_sliding, "SELECT strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS events FROM events, (VALUES (0), (1), (2)) t(k) GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, "SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, COUNT(*) AS events FROM (SELECT ts, user_id, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT ts, user_id, CASE WHEN ts > LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, session"),
    "dq_checks": (dq_checks, "SELECT 'UNIQUE' AS kind, CAST((SELECT SUM(n) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 1) AS BIGINT) AS violations UNION ALL SELECT 'RANGE', COUNT(*) FILTER (NOT (o_totalprice >= 1000 AND o_totalprice <= 200000)) FROM orders UNION ALL SELECT 'EXPRESSION', COUNT(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'MIN_ROWS', 10000000 - COUNT(*) FROM orders"),
    "dq_unique": (partial(dq_rule, "UNIQUE c_nationkey"), "SELECT 'r' AS rule, 'WARNED' AS status, CAST(SUM(n) AS BIGINT) AS violations FROM (SELECT COUNT(*) AS n FROM customer GROUP BY c_nationkey) WHERE n > 1"),
    "dq_range": (partial(dq_rule, "RANGE c_acctbal MIN 0"), "SELECT 'r' AS rule, 'WARNED' AS status, COUNT(*) AS violations FROM customer WHERE NOT c_acctbal >= 0"),
    "dq_expression": (partial(dq_rule, "EXPRESSION 'c_custkey > 10'"), "SELECT 'r' AS rule, 'WARNED' AS status, COUNT(*) AS violations FROM customer WHERE NOT c_custkey > 10"),
    "dq_min_rows": (partial(dq_rule, "MIN_ROWS 9000000"), "SELECT 'r' AS rule, 'WARNED' AS status, 9000000 - COUNT(*) AS violations FROM customer"),
    "pipeline_run": (pipeline_run, "SELECT * FROM (VALUES ('s', 'load', 'SUCCESS'), ('s', 'a_check', 'SUCCESS'), ('s', 'z', 'SUCCESS')) t(stage, task, status)"),
    "feature_set_projection": (feature_set_projection, "SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer"),
    "model_train_metrics": (model_train_metrics, None),
    "shard_layout": (shard_layout, "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey"),
}

STATEMENTS["win_avg_count"] = ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, AVG(o_orderkey) OVER (PARTITION BY o_custkey) AS a FROM orders", None)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(_statement, text) for name, (text, _) in STATEMENTS.items()} | {name: f for name, (f, _) in PROGRAMS.items()}
ORACLES: dict[str, str] = {name: sql or text for name, (text, sql) in STATEMENTS.items()} | {name: sql for name, (_, sql) in PROGRAMS.items() if sql}
