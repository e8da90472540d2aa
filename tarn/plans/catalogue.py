"""Named queries over the TPC-H-like tables through the DataFrame operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import expressions as X
from tarn.functions.types import cast, sql_type
from tarn.operators import changes as C
from tarn.operators import relational as R
from tarn.operators.constraints import check, duplicates
from tarn.operators.definition import ColumnDefinition, TableDefinition
from tarn.operators.render import json_cells
from tarn.sources.catalog import drop_table, list_tables, register, rename_table
from tarn.sources.tables import load, one_row, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str | None) -> Callable:
    """Register a function of a table loader under its name, with the same query in SQL."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(partial(load, spark, sf_dir))
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


col, lit = F.col, F.lit
_N = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 10 END AS k FROM orders) t"


def with_nulls(t: Tables) -> DataFrame:
    """The order keys, and a column k that is null in a third of the rows."""
    return t("orders").select("o_orderkey", F.when(col("o_orderkey") % 3 != 0, col("o_orderkey") % 10).alias("k"))


# scans and projections


@query("SELECT * FROM nation")
def seq_scan(t):
    return t("nation")


@query("SELECT n_name, n_nationkey FROM nation")
def project_reorder(t):
    return t("nation").select("n_name", "n_nationkey")


@query("SELECT c.c_custkey AS id, c.c_name AS nm FROM customer c")
def alias(t):
    return t("customer").alias("c").select(col("c.c_custkey").alias("id"), col("c.c_name").alias("nm"))


@query("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def qualified_wildcard(t):
    return R.join(t("nation").alias("n"), t("region").alias("r"), col("n.n_regionkey") == col("r.r_regionkey")).select("n.*")


@query("SELECT id FROM (SELECT c_custkey AS id FROM customer) AS s WHERE id > 1400")
def derived_table(t):
    return R.where(t("customer").select(col("c_custkey").alias("id")), col("id") > 1400)


@query("SELECT 42 AS answer, 'x' AS word")
def select_without_from(t):
    return one_row(t("region").sparkSession).select(lit(42).alias("answer"), lit("x").alias("word"))


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(id, name)")
def values_rows(t):
    return values(t("region").sparkSession, [(1, "one"), (2, "two"), (3, None)], "id int, name string")


@query("SELECT n_nationkey, 42 AS i, CAST(3.14 AS DOUBLE) AS f, 'it''s' AS s, TRUE AS t, X'00FF' AS b FROM nation")
def literals(t):
    return t("nation").select("n_nationkey", lit(42).alias("i"), lit(3.14).alias("f"), lit("it's").alias("s"), lit(True).alias("t"), lit(bytearray(b"\x00\xff")).alias("b"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


# filters


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t):
    return R.where(t("orders"), col("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def filter_noteq(t):
    return R.where(t("orders"), col("o_orderstatus") != "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def filter_range(t):
    return R.where(t("orders"), (col("o_orderkey") >= 100) & (col("o_orderkey") < 200)).select("o_orderkey")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def index_point(t):
    return R.where(t("customer"), col("c_custkey") == 42)


@query("SELECT c_custkey FROM customer WHERE 42 > c_custkey")
def index_flipped(t):
    return R.where(t("customer"), lit(42) > col("c_custkey")).select("c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 30 ORDER BY c_custkey")
def index_range(t):
    return R.sort(R.where(t("customer"), X.between(col("c_custkey"), lit(10), lit(30))).select("c_custkey", "c_acctbal"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def between(t):
    return R.where(t("lineitem"), X.between(col("l_quantity"), lit(10), lit(12))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def not_between(t):
    return R.where(t("part"), X.between(col("p_size"), lit(5), lit(45), negated=True)).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY')")
def in_list(t):
    return R.where(t("customer"), X.in_list(col("c_mktsegment"), ["BUILDING", "MACHINERY"])).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING','MACHINERY')")
def not_in_list(t):
    return R.where(t("customer"), X.in_list(col("c_mktsegment"), ["BUILDING", "MACHINERY"], negated=True)).select("c_custkey")


@query(f"SELECT o_orderkey, k IN (1, NULL) AS r FROM {_N}")
def in_null(t):
    return with_nulls(t).select("o_orderkey", X.in_list(col("k"), [1, None]).alias("r"))


@query(f"SELECT o_orderkey FROM {_N} WHERE k NOT IN (1, NULL)")
def not_in_null(t):
    return R.where(with_nulls(t), X.in_list(col("k"), [1, None], negated=True)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_N} WHERE k IS NULL")
def is_null(t):
    return R.where(with_nulls(t), col("k").isNull()).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_N} WHERE k IS NOT NULL")
def is_not_null(t):
    return R.where(with_nulls(t), col("k").isNotNull()).select("o_orderkey")


@query(f"SELECT o_orderkey, (k > 5 AND o_orderkey > 100) AS a, (k > 5 OR o_orderkey > 100) AS b, NOT (k > 5) AS n FROM {_N}")
def bool_3vl(t):
    k, key = col("k") > 5, col("o_orderkey") > 100
    return with_nulls(t).select("o_orderkey", (k & key).alias("a"), (k | key).alias("b"), (~k).alias("n"))


@query(f"SELECT o_orderkey, k BETWEEN 2 AND 5 AS r, k NOT BETWEEN 2 AND 5 AS nr FROM {_N}")
def between_null(t):
    args = col("k"), lit(2), lit(5)
    return with_nulls(t).select("o_orderkey", X.between(*args).alias("r"), X.between(*args, negated=True).alias("nr"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%an%'")
def like(t):
    return R.where(t("part"), X.like(col("p_name"), "%an%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE 'b___ %'")
def not_like(t):
    return R.where(t("part"), X.like(col("p_name"), "b___ %", negated=True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name || chr(92) || 'x' LIKE '%\\x'")
def like_backslash(t):
    return R.where(t("part"), X.like(X.concat(col("p_name"), lit("\\x")), "%\\x")).select("p_partkey")


# scalar expressions


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS neg, +l_quantity AS pos FROM lineitem")
def arith(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net"), (-col("l_quantity")).alias("neg"), F.positive("l_quantity").alias("pos"))


@query("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 7 AS b, o_orderkey * 3 AS m FROM orders")
def int_arith(t):
    k = col("o_orderkey")
    return t("orders").select(k, (k + 1).alias("a"), (k - 7).alias("b"), (k * 3).alias("m"))


@query("SELECT o_orderkey, o_orderkey / 7 AS d FROM orders")
def divide(t):
    return t("orders").select("o_orderkey", (col("o_orderkey") / 7).alias("d"))


@query("SELECT o_orderkey, o_orderkey % 7 AS m, (o_orderkey - 5000) % 7 AS nm FROM orders")
def modulo(t):
    k = col("o_orderkey")
    return t("orders").select(k, (k % 7).alias("m"), ((k - 5000) % 7).alias("nm"))


@query("SELECT o_orderkey, o_orderstatus || '-' || o_orderkey AS s, o_orderstatus || CAST(NULL AS VARCHAR) AS z FROM orders")
def concat(t):
    return t("orders").select("o_orderkey", X.concat(col("o_orderstatus"), lit("-"), col("o_orderkey")).alias("s"), X.concat(col("o_orderstatus"), lit(None)).alias("z"))


@query("SELECT l_orderkey, l_linenumber, CAST(TRUNC(l_extendedprice) AS BIGINT) AS i FROM lineitem")
def cast_int(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", cast(col("l_extendedprice"), "BIGINT").alias("i"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey > 5 AS VARCHAR) AS b FROM orders")
def cast_text(t):
    return t("orders").select("o_orderkey", cast(col("o_orderkey"), "TEXT").alias("s"), cast(col("o_orderkey") > 5, "TEXT").alias("b"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST('2.5' AS DOUBLE) AS e FROM orders")
def cast_real(t):
    return t("orders").select("o_orderkey", cast(col("o_orderkey"), "REAL").alias("d"), cast(lit("2.5"), "FLOAT").alias("e"))


@query("SELECT o_orderkey, CAST(o_orderkey % 2 AS BOOLEAN) AS b FROM orders")
def cast_bool(t):
    return t("orders").select("o_orderkey", cast(col("o_orderkey") % 2, "BOOLEAN").alias("b"))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return R.join(t("orders"), t("customer"), col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def join_theta(t):
    return R.join(t("nation").alias("a"), t("nation").alias("b"), col("a.n_nationkey") < col("b.n_nationkey")).select(col("a.n_nationkey").alias("x"), col("b.n_nationkey").alias("y"))


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t):
    return R.join(t("nation").alias("a"), t("nation").alias("b"), col("a.n_regionkey") == col("b.n_regionkey")).select(col("a.n_nationkey").alias("x"), col("b.n_nationkey").alias("y"))


@query("SELECT c_custkey, n_name, r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_multi(t):
    nations = R.join(t("customer"), t("nation"), col("c_nationkey") == col("n_nationkey"))
    return R.join(nations, t("region"), col("n_regionkey") == col("r_regionkey")).select("c_custkey", "n_name", "r_name")


def _orders_lines(t: Tables, how: str) -> DataFrame:
    sides = (t("orders"), t("lineitem")) if how == "left" else (t("lineitem"), t("orders"))
    return R.join(*sides, col("o_orderkey") == col("l_orderkey"), how)


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(t):
    return _orders_lines(t, "left").select("o_orderkey", "l_linenumber")


@query("SELECT o_orderkey, l_linenumber FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey")
def join_right(t):
    return _orders_lines(t, "right").select("o_orderkey", "l_linenumber")


@query("SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a FULL OUTER JOIN supplier b ON a.c_custkey = b.s_suppkey + 1450")
def join_full(t):
    return R.join(t("customer"), t("supplier"), col("c_custkey") == col("s_suppkey") + 1450, "full").select(col("c_custkey").alias("a"), col("s_suppkey").alias("b"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return R.join(t("nation"), t("region"), how="cross").select("n_name", "r_name")


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def left_join_null(t):
    return R.where(_orders_lines(t, "left"), col("l_orderkey").isNull()).select("o_orderkey")


# aggregates


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_sum(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(X.exact_sum(col("l_quantity")).alias("q"))


@query("SELECT l_returnflag, AVG(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
def group_avg(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.avg("l_linenumber").alias("a"))


@query("SELECT c_mktsegment, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment")
def group_minmax(t):
    return t("customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("SELECT o_orderkey % 7 AS bucket, COUNT(*) AS n, CAST(SUM(o_custkey) + 1 AS BIGINT) AS s FROM orders GROUP BY o_orderkey % 7")
def group_expression(t):
    return t("orders").groupBy((col("o_orderkey") % 7).alias("bucket")).agg(F.count("*").alias("n"), (F.sum("o_custkey") + 1).alias("s"))


@query(f"SELECT COUNT(k) AS nn, COUNT(*) AS n FROM {_N}")
def count_col(t):
    return with_nulls(t).agg(F.count("k").alias("nn"), F.count("*").alias("n"))


@query("SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders")
def agg_global(t):
    return t("orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT COUNT(*) AS n, MAX(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    return R.where(t("orders"), col("o_orderkey") < 0).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("hi"))


@query("SELECT CAST(SUM(o_orderkey) AS BIGINT) AS s FROM orders")
def sum_int(t):
    return t("orders").agg(F.sum("o_orderkey").alias("s"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
def having(t):
    return R.where(t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")), col("n") > 12)


# ordering and paging


@query("SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus ASC, o_orderkey DESC")
def sort_multi(t):
    return R.sort(t("orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", ("o_orderkey", "desc"))


@query(f"SELECT o_orderkey, k FROM {_N} ORDER BY k NULLS LAST, o_orderkey")
def sort_nulls_last(t):
    return R.sort(with_nulls(t), "k", "o_orderkey")


@query(f"SELECT o_orderkey, k FROM {_N} ORDER BY k DESC NULLS FIRST, o_orderkey")
def sort_nulls_first(t):
    return R.sort(with_nulls(t), ("k", "desc", "first"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return R.limit(R.sort(t("orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", "desc"), "o_orderkey"), 10)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 15")
def limit_offset(t):
    return R.limit(R.sort(t("customer").select("c_custkey"), "c_custkey"), 5, 15)


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
def offset_only(t):
    return R.limit(R.sort(t("nation").select("n_nationkey"), "n_nationkey"), offset=20)


# application queries


@query("""SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber, p.p_name AS pn, o.o_orderstatus AS st, c.c_name AS cn
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey = 42""")
def ticket_detail(t):
    found = R.join(R.join(R.join(t("lineitem"), t("part"), col("l_partkey") == col("p_partkey")), t("orders"), col("l_orderkey") == col("o_orderkey")), t("customer"), col("o_custkey") == col("c_custkey"))
    return R.where(found, col("c_custkey") == 42).select("l_orderkey", "l_linenumber", col("p_name").alias("pn"), col("o_orderstatus").alias("st"), col("c_name").alias("cn"))


@query("""SELECT c.c_custkey AS c_custkey, c.c_name AS c_name, COUNT(o.o_orderkey) AS order_count, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS total_spent
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_custkey, c.c_name ORDER BY total_spent DESC, c_custkey LIMIT 10""")
def customer_summary(t):
    # sums are taken by order key before the join: it then meets one row for each customer
    spent = R.where(t("orders"), col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.count("o_orderkey").alias("order_count"), X.exact_sum(col("o_totalprice")).alias("total_spent"))
    named = R.join(t("customer"), spent, col("c_custkey") == col("o_custkey")).select("c_custkey", "c_name", "order_count", "total_spent")
    return R.limit(R.sort(named, ("total_spent", "desc"), "c_custkey"), 10)


@query("""SELECT o.o_orderkey AS o_orderkey, COUNT(l.l_orderkey) AS n_lines, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS revenue
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def event_summary(t):
    return _orders_lines(t, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"), X.exact_sum(col("l_extendedprice")).alias("revenue"))


@query("""SELECT o.o_orderkey AS o_orderkey, CAST(COALESCE(SUM(CAST(l.l_quantity AS DECIMAL(28,6))), 0) AS DOUBLE) AS sold,
COALESCE(STRING_AGG(CAST(l.l_linenumber AS VARCHAR) || ':' || CAST(l.l_partkey AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS types
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def event_listing(t):
    # the lines of an order, as the ticket types of an event: a list of structs, shown as text
    lines = F.array_sort(F.collect_list(F.when(col("l_linenumber").isNotNull(), F.struct("l_linenumber", "l_partkey"))))
    found = _orders_lines(t, "left").groupBy("o_orderkey").agg(F.coalesce(X.exact_sum(col("l_quantity")), lit(0.0)).alias("sold"), lines.alias("lines"))
    shown = F.transform("lines", lambda x: X.concat(x["l_linenumber"], lit(":"), x["l_partkey"]))
    return found.select("o_orderkey", "sold", F.array_join(shown, ",").alias("types"))


@query("SELECT p_partkey, p_name FROM part WHERE 1 = 1 AND p_size >= 10 AND (p_name LIKE '%an%' OR p_type LIKE '%AN%') ORDER BY p_partkey LIMIT 50 OFFSET 50")
def page_listing(t):
    found = R.where(t("part"), (col("p_size") >= 10) & (X.like(col("p_name"), "%an%") | X.like(col("p_type"), "%AN%"))).select("p_partkey", "p_name")
    return R.page(found, ["p_partkey"], 2)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate DESC, o_orderkey DESC")
def orders_of_customer(t):
    return R.sort(R.where(t("orders"), col("o_custkey") == 42).select("o_orderkey", "o_orderdate"), ("o_orderdate", "desc"), ("o_orderkey", "desc"))


@query("SELECT COUNT(*) AS sold FROM lineitem WHERE l_partkey = 7 AND l_linestatus IN ('O', 'F')")
def sold_count(t):
    return R.where(t("lineitem"), (col("l_partkey") == 7) & X.in_list(col("l_linestatus"), ["O", "F"])).agg(F.count("*").alias("sold"))


# changes of tables


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'NOWHERE' UNION ALL SELECT 101, NULL")
def insert_rows(t):
    return C.insert(t("region"), [(100, "NOWHERE"), (101, None)], ["r_regionkey", "r_name"])


@query("SELECT r_regionkey, COALESCE(CAST(NULL AS VARCHAR), 'DRAFT') AS status FROM region")
def insert_default(t):
    empty = values(t("region").sparkSession, [], "r_regionkey int, status string")
    return C.insert(empty, t("region").select("r_regionkey"), ["r_regionkey"], {"status": lit("DRAFT")})


@query("SELECT CAST(ROW_NUMBER() OVER (ORDER BY n_nationkey) AS BIGINT) AS id, n_name FROM nation")
def auto_increment(t):
    return C.number(t("nation").select("n_nationkey", "n_name"), "id", by=["n_nationkey"]).select("id", "n_name")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(t):
    return C.update(t("customer"), {"c_acctbal": col("c_acctbal") * 2}, col("c_mktsegment") == "BUILDING").select("c_custkey", "c_acctbal")


@query("SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")
def update_swap(t):
    return C.update(t("nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_nationkey": col("n_regionkey"), "n_regionkey": col("n_nationkey")})


@query("SELECT * FROM customer WHERE (c_acctbal < 0) IS NOT TRUE")
def delete_rows(t):
    return C.delete(t("customer"), col("c_acctbal") < 0)


@query(f"SELECT o_orderkey, k FROM {_N} WHERE (k > 4) IS NOT TRUE")
def delete_null(t):
    return C.delete(with_nulls(t), col("k") > 4)


@query("SELECT COUNT(*) AS n FROM customer WHERE c_acctbal < 0")
def rows_affected(t):
    return values(t("region").sparkSession, [(C.affected(t("customer"), col("c_acctbal") < 0),)], "n long")


@query("SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS VARCHAR) AS note FROM nation")
def add_column(t):
    return C.add_column(t("nation"), "note", sql_type("TEXT"))


@query("SELECT n_nationkey, n_regionkey FROM nation")
def drop_column(t):
    return C.drop_column(t("nation"), "n_name")


@query("SELECT n_nationkey, n_name AS label, n_regionkey FROM nation")
def rename_column(t):
    return C.rename_column(t("nation"), "n_name", "label")


@query("SELECT * FROM (VALUES ('n_nationkey', 'int', TRUE), ('n_name', 'string', TRUE), ('n_regionkey', 'int', TRUE)) AS v(column_name, data_type, nullable)")
def describe_table(t):
    return C.describe(t("nation"))


PARTS = TableDefinition(
    [
        ColumnDefinition("id", "BIGINT", primary_key=True, auto=True),
        ColumnDefinition("name", "TEXT", not_null=True, unique=True),
        ColumnDefinition("size", "INT", default=7),
        ColumnDefinition("status", "TEXT", default="DRAFT"),
    ]
)


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, 7 AS size, 'DRAFT' AS status FROM nation WHERE n_nationkey < 1 UNION ALL SELECT 40, 'north', 9, 'DRAFT' UNION ALL SELECT 41, 'south', NULL, 'DRAFT'")
def defined_insert(t):
    spark = t("region").sparkSession
    first = PARTS.insert(PARTS.empty(spark), R.where(t("nation"), col("n_nationkey") < 1).select("n_name"), ["name"])
    return PARTS.insert(first, [(40, "north", 9), (None, "south", None)], ["id", "name", "size"])


@query("SELECT CAST(n_nationkey AS BIGINT) + CASE WHEN n_nationkey < 24 THEN 1 ELSE -24 END AS id, n_name AS name, CASE WHEN n_regionkey = 2 THEN 0 ELSE 7 END AS size, 'DRAFT' AS status FROM nation")
def defined_update(t):
    # each key takes the next one's place: only the outcome has to be unique
    rows = t("nation").select(col("n_nationkey").cast("long").alias("id"), col("n_name").alias("name"), lit(7).alias("size"), lit("DRAFT").alias("status"), "n_regionkey")
    to = {"id": col("id") + F.when(col("id") < 24, 1).otherwise(-24), "size": F.when(col("n_regionkey") == 2, 0).otherwise(col("size"))}
    return PARTS.update(rows, to).drop("n_regionkey")


@query("SELECT * FROM (VALUES ('tarn_lands', 25), ('tarn_regions', 5)) AS v(table_name, n)")
def table_names(t):
    spark = t("region").sparkSession
    for name in ("tarn_lands", "tarn_nations", "tarn_regions", "tarn_gone"):
        drop_table(spark, name, if_exists=True)
    register(t("nation"), "tarn_nations")
    register(t("region"), "tarn_regions")
    register(t("region"), "tarn_gone")
    rename_table(spark, "tarn_nations", "tarn_lands")
    drop_table(spark, "tarn_gone")
    found = [(name, spark.table(name).count()) for name in list_tables(spark) if name.startswith("tarn_")]
    for name, _ in found:
        drop_table(spark, name)
    return values(spark, found, "table_name string, n int")


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
def unique_violations(t):
    return duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name FROM customer")
def primary_key_check(t):
    return check(t("customer").select("c_custkey", "c_name"), primary_key=["c_custkey"])


@query("""SELECT '[{"type":"int","value":' || r_regionkey || '},{"type":"text","value":"' || r_name || '"}]' AS cells FROM region""")
def json_cells_of(t):
    return json_cells(t("region").select("r_regionkey", "r_name"))
