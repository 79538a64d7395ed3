"""Queries over the test tables: a plan text each, and the same in SQL.

Sums of products of two-decimal columns are exact in decimals on both sides and then cast to double; other sums are
rounded at their scale. The heads Exact (amounts), Rate (values under 100) and Float are registered for that, as any
session may register functions. With exact=False the same plans compute in doubles, as the benchmark times them.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import Expr
from .operators.sliding import below
from .reader import read_all
from .session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")


def open_session(spark: SparkSession, sf_dir: str, text: str = " ".join(TABLES), exact: bool = True, **options) -> Session:
    """A session that knows the tables that the text names."""
    session = Session(spark, **options)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            session.register_table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    session.register_scalar("Exact", lambda c: c.cast("decimal(12,2)" if exact else "double"))
    # narrow rates keep products within 18 digits, which Spark computes as plain longs
    session.register_scalar("Rate", lambda c: c.cast("decimal(4,2)" if exact else "double"))
    session.register_scalar("Float", lambda c: c.cast("double"))
    session.register_scalar("Text", lambda c: c.cast("string"))
    return session


def run(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """Evaluates all expressions of the text but the last, and gives the last one's DataFrame. $SF stands for the data's folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = open_session(spark, sf_dir, text, **options)
        *first, last = read_all(text.replace("$SF", sf_dir))
        for x in first:
            if isinstance(x, Expr) and str(x.head) == "Name":
                session.relation(x)  # binding runs nothing
            else:
                session.evaluate(x)
        return session.dataframe(last)

    return query


PLANS: dict[str, str] = {}
SQL: dict[str, str] = {}


def query(name: str, plan: str, sql: str) -> None:
    PLANS[name], SQL[name] = plan, sql


# -- the benchmark queries, by the catalogue's vocabulary ------------------------------------------------------------
query(
    "q1",
    """(OrderBy (Project (GroupBy (Project (Filter lineitem (Less l_shipdate "1998-08-31")) l_returnflag l_linestatus
          (As (Exact l_quantity) q) (As (Exact l_extendedprice) p) (As (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) d)
          (As (Multiply (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) (Add (Rate 1) (Rate l_tax))) c) (As l_discount x))
        (Sum q) (Sum p) (Sum d) (Sum c) (Avg x) (CountAll) l_returnflag l_linestatus)
      l_returnflag l_linestatus (As (Float |sum(q)|) sum_qty) (As (Float |sum(p)|) sum_base_price) (As (Float |sum(d)|) sum_disc_price) (As (Float |sum(c)|) sum_charge)
      (As (Round |mean(x)| 6) avg_disc) (As |count_all()| count_order)) (keys l_returnflag l_linestatus))""",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS sum_disc_price,
        CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) AS DECIMAL(18,4)) * (1 + CAST(l_tax AS DECIMAL(12,2)))) AS DOUBLE) AS sum_charge,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate < DATE '1998-08-31' GROUP BY 1, 2""",
)
query(
    "q6",
    """(Project (GroupBy (Project (Filter lineitem (And (Greater l_quantity 25) (And (Greater l_discount 0.03) (Less l_discount 0.10)) (Greater l_shipdate "1996-03-08") (Less l_shipdate "1998-01-01")))
          (As (Multiply (Exact l_extendedprice) (Rate l_discount)) r)) (Sum r)) (As (Float |sum(r)|) revenue))""",
    "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_quantity > 25 AND l_discount > 0.03 AND l_discount < 0.10 AND l_shipdate > DATE '1996-03-08' AND l_shipdate < DATE '1998-01-01'",
)
Q3_SQL = """SELECT l_orderkey, o_orderdate, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
query(
    "q3",
    """(Slice (OrderBy (Project (GroupBy (Project (Join (Join (Project (Filter customer (Equal c_mktsegment "BUILDING")) c_custkey)
          (Project (Filter orders (Less o_orderdate "1998-03-15")) o_orderkey o_custkey o_orderdate) (Equal c_custkey o_custkey))
          (Project (Filter lineitem (Greater l_shipdate "1998-03-15")) l_orderkey l_extendedprice l_discount) (Equal o_orderkey l_orderkey))
        l_orderkey o_orderdate (As (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) r)) (Sum r) l_orderkey o_orderdate)
      l_orderkey o_orderdate (As (Float |sum(r)|) revenue)) (keys (Desc revenue) o_orderdate l_orderkey)) 0 10)""",
    Q3_SQL,
)
query(
    "q8",
    """(Project (GroupBy (Project (Join (Join (Join (Join (Join (Join (Project (Filter part (Equal p_type "ECONOMY")) p_partkey)
            (Project lineitem l_partkey l_suppkey l_orderkey l_extendedprice l_discount) (Equal p_partkey l_partkey))
            (Project (Filter orders (Between o_orderdate "1997-01-01" "1998-12-31")) o_orderkey o_custkey o_orderdate) (Equal l_orderkey o_orderkey))
            (Project customer c_custkey c_nationkey) (Equal o_custkey c_custkey))
            (Project (Join nation (Filter region (Equal r_name "AMERICA")) (Equal n_regionkey r_regionkey)) (As n_nationkey an_nationkey)) (Equal c_nationkey an_nationkey))
            (Project supplier s_suppkey s_nationkey) (Equal l_suppkey s_suppkey))
            (Project nation n_nationkey n_name) (Equal s_nationkey n_nationkey))
          (As (Year o_orderdate) o_year) (As (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) v)
          (As (IfElse (Equal n_name "NATION_3") (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) (Multiply (Exact 0) (Exact 0))) w)) (Sum w) (Sum v) o_year)
      o_year (As (Round (Divide (Float |sum(w)|) (Float |sum(v)|)) 6) mkt_share))""",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, round(CAST(sum(CASE WHEN n2.n_name = 'NATION_3' THEN CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE), 6) AS mkt_share
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
    WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND p_type = 'ECONOMY' GROUP BY 1""",
)
query(
    "q9",
    """(Project (GroupBy (Project (Join (Join (Join (Join (Project (Filter part (StringContains p_name "widget")) p_partkey p_retailprice)
            (Project lineitem l_partkey l_suppkey l_orderkey l_quantity l_extendedprice l_discount) (Equal p_partkey l_partkey))
            (Project supplier s_suppkey s_nationkey) (Equal l_suppkey s_suppkey)) (Project orders o_orderkey o_orderdate) (Equal l_orderkey o_orderkey)) (Project nation n_nationkey n_name) (Equal s_nationkey n_nationkey))
          n_name (As (Year o_orderdate) o_year) (As (Subtract (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) (Multiply (Exact p_retailprice) (Exact l_quantity))) a)) (Sum a) n_name o_year)
      n_name o_year (As (Float |sum(a)|) sum_profit))""",
    """SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS o_year, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2))) - CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_profit
    FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE contains(p_name, 'widget') GROUP BY 1, 2""",
)
query(
    "q10",
    """(Slice (OrderBy (Project (GroupBy (Project (Join (Join (Join (Project customer c_custkey c_name c_acctbal c_nationkey)
            (Project (Filter orders (And (GreaterEqual o_orderdate "1996-10-01") (Less o_orderdate "1997-01-01"))) o_orderkey o_custkey) (Equal c_custkey o_custkey))
            (Project (Filter lineitem (Equal l_returnflag "R")) l_orderkey l_extendedprice l_discount) (Equal o_orderkey l_orderkey)) (Project nation n_nationkey n_name) (Equal c_nationkey n_nationkey))
          c_custkey c_name c_acctbal n_name (As (Multiply (Exact l_extendedprice) (Subtract (Rate 1) (Rate l_discount))) r)) (Sum r) c_custkey c_name c_acctbal n_name)
      c_custkey c_name c_acctbal n_name (As (Float |sum(r)|) revenue)) (keys (Desc revenue) c_custkey)) 0 20)""",
    """SELECT c_custkey, c_name, c_acctbal, n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' GROUP BY 1, 2, 3, 4 ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
Q18_SQL = """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, q AS sum_qty FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"""
query(
    "q18",
    """(Slice (OrderBy (Project (Join (Join (Filter (GroupBy lineitem (Sum l_quantity) l_orderkey) (Greater |sum(l_quantity)| 300))
          (Project orders o_orderkey o_custkey o_orderdate o_totalprice) (Equal l_orderkey o_orderkey)) (Project customer c_custkey c_name) (Equal o_custkey c_custkey))
        c_name c_custkey o_orderkey o_orderdate o_totalprice (As |sum(l_quantity)| sum_qty)) (keys (Desc o_totalprice) o_orderdate o_orderkey)) 0 100)""",
    Q18_SQL,
)
# -- the same by the relational vocabulary ---------------------------------------------------------------------------
query(
    "q1_relational",
    """(Order (Project (Group (Project (Select lineitem (Where (Greater (DateObject "1998-08-31") L_SHIPDATE_)))
          (As l_returnflag l_returnflag l_linestatus l_linestatus q l_quantity d (Times (Exact l_extendedprice) (Minus (Rate 1) (Rate l_discount)))))
        (By l_returnflag l_linestatus) (As sum_qty (Sum Q) sum_disc_price (Sum d) count_order (Count *)))
      (As l_returnflag l_returnflag l_linestatus l_linestatus sum_qty sum_qty sum_disc_price (Float sum_disc_price) count_order count_order)) (By l_returnflag desc l_linestatus))""".replace("L_SHIPDATE_", "l_shipdate"),
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate < DATE '1998-08-31' GROUP BY 1, 2""",
)
query(
    "q6_relational",
    """(Project (Group (Project (Select lineitem (Where (And (Greater l_quantity 25) (Greater l_discount 0.03) (Greater 0.10 l_discount) (Greater l_shipdate (DateObject "1996-03-08")) (Greater (DateObject "1998-01-01") l_shipdate))))
          (As revenue (Times (Exact l_extendedprice) (Rate l_discount)))) (Sum revenue)) (As revenue (Float revenue)))""",
    SQL["q6"],
)
query(
    "q3_relational",
    """(Top (Project (Group (Project (Join (Join (Project (Select customer (Where (Equal c_mktsegment "BUILDING"))) (As c_custkey c_custkey))
          (Project (Select orders (Where (Greater (DateObject "1998-03-15") o_orderdate))) (As o_orderkey o_orderkey o_custkey o_custkey o_orderdate o_orderdate)) (Where (Equal o_custkey c_custkey)))
          (Project (Select lineitem (Where (Greater l_shipdate (DateObject "1998-03-15")))) (As l_orderkey l_orderkey l_extendedprice l_extendedprice l_discount l_discount)) (Where (Equal l_orderkey o_orderkey)))
        (As l_orderkey l_orderkey o_orderdate o_orderdate revenue (Times (Exact l_extendedprice) (Minus (Rate 1) (Rate l_discount))))) (By l_orderkey o_orderdate) (Sum revenue))
      (As l_orderkey l_orderkey o_orderdate o_orderdate revenue (Float revenue))) (By revenue desc o_orderdate l_orderkey) 10)""",
    Q3_SQL,
)
query(
    "q18_relational",
    """(Top (Project (Join (Join (Select (Group lineitem (By l_orderkey) (As sum_qty (Sum l_quantity))) (Where (Greater sum_qty 300))) (Project orders (As o_orderkey o_orderkey o_custkey o_custkey o_orderdate o_orderdate o_totalprice o_totalprice)) (Where (Equal o_orderkey l_orderkey)))
          (Project customer (As c_custkey c_custkey c_name c_name)) (Where (Equal o_custkey c_custkey)))
        (As c_name c_name c_custkey c_custkey o_orderkey o_orderkey o_orderdate o_orderdate o_totalprice o_totalprice sum_qty sum_qty)) (By o_totalprice desc o_orderdate o_orderkey) 100)""",
    Q18_SQL,
)
# -- one operator each -----------------------------------------------------------------------------------------------
query("load_columns", '(Load "$SF/customer.parquet" c_custkey c_mktsegment)', "SELECT c_custkey, c_mktsegment FROM customer")
query("load_bind", '(Load r "$SF/region.parquet") (Project r r_regionkey r_name)', "SELECT r_regionkey, r_name FROM region")
query("table_literal", '(Table (id 1 2 3) (price 4.5 NULL 6.25) (name "a" "b" NULL) (flag #t NULL #f))', "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(4.5 AS DOUBLE), 'a', true), (2, NULL, 'b', NULL), (3, 6.25, NULL, false)) AS t(id, price, name, flag)")
query("table_lists", '(Table (x (List 1 2)) (y (List "a" "b")))', "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b')) AS t(x, y)")
query("table_symbols", "(Filter (Table (game Chess Go) (players 2 3)) (Equal game Go))", "SELECT 'Go' AS game, CAST(3 AS BIGINT) AS players")
query("create_insert", "(CreateTable t id:INTEGER name:VARCHAR:10) (InsertInto t 1 \"a\") (InsertInto t 2 \"b\") (Project t id name)", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b')) AS t(id, name)")
query("insert_interpolate", "(CreateTable t x y) (InsertInto t 1 10) (InsertInto t 2 (Interpolate x)) (InsertInto t 9 20) (Project t x y)", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(10 AS BIGINT)), (2, 15), (9, 20)) AS t(x, y)")
query("interpolate", "(Project (Table (x (List 1 3 5)) (y (List 7 (Interpolate x) 9))) (As x x y y))", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT)), (3, 8), (5, 9)) AS t(x, y)")
query("project_bare", "(Project customer c_name c_custkey)", "SELECT c_name, c_custkey FROM customer")
query("project_as", "(Project orders o_orderkey (As (Multiply o_totalprice 2.0) doubled) (As (Year o_orderdate) y) (As (Month o_orderdate) m) (As (Day o_orderdate) d))", "SELECT o_orderkey, o_totalprice * 2.0 AS doubled, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders")
query("project_text_name", "(Project nation n_name (Add n_nationkey n_regionkey))", 'SELECT n_name, n_nationkey + n_regionkey AS "(Add n_nationkey n_regionkey)" FROM nation')
query("project_pairs", '(Project nation (As name n_name twice (Plus n_nationkey n_nationkey n_regionkey) high (Greater n_nationkey 12)))', "SELECT n_name AS name, n_nationkey + n_nationkey + n_regionkey AS twice, n_nationkey > 12 AS high FROM nation")
query("project_all", "(Select (ProjectAll nation N2) (Where (Equal N2.n_regionkey 1)))", 'SELECT n_nationkey AS "N2.n_nationkey", n_name AS "N2.n_name", n_regionkey AS "N2.n_regionkey" FROM nation WHERE n_regionkey = 1')
query("filter_and_or_not", '(Filter customer (And (Or (Equal c_mktsegment "BUILDING") (Equal c_mktsegment "MACHINERY")) (Not (Less c_acctbal 0.0)) (NotEqual c_nationkey 3)))', "SELECT * FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') AND NOT c_acctbal < 0 AND c_nationkey <> 3")
query("filter_between_dates", '(Filter orders (Between o_orderdate "1996-01-01" "1996-12-31"))', "SELECT * FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
query("filter_between_numbers", "(Filter part (Between p_size 10 20))", "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
query("filter_like", '(Filter part (Like p_name "%ring%"))', "SELECT * FROM part WHERE p_name LIKE '%ring%'")
query("filter_contains", '(Select part (Where (StringContainsQ p_name "bolt")))', "SELECT * FROM part WHERE contains(p_name, 'bolt')")
query("filter_literal_left", "(Select nation (Where (Greater 20 n_nationkey)))", "SELECT * FROM nation WHERE 20 > n_nationkey")
query("filter_less_equal", "(Filter nation (And (LessEqual n_nationkey 20) (GreaterEqual n_nationkey 5)))", "SELECT * FROM nation WHERE n_nationkey <= 20 AND n_nationkey >= 5")
query("filter_symbol_literal", "(Filter customer (Equal c_mktsegment BUILDING))", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
query("select_true", "(Select region (Function #t))", "SELECT * FROM region")
query("select_false", "(Select region (Function #f))", "SELECT * FROM region WHERE false")
query("is_valid", "(Filter (Table (a 1 NULL 3) (b NULL 2 3)) (IsValid a))", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS BIGINT)), (3, 3)) AS t(a, b)")
query("kleene", "(Filter (Table (a #t NULL #f) (b NULL #t #t)) (Or a b))", "SELECT * FROM (VALUES (true, CAST(NULL AS BOOLEAN)), (NULL, true), (false, true)) AS t(a, b)")
query("casts", '(Project (Table (s "12" "7") (d "1996-02-29" "2001-12-31") (n 0 1)) (As (Int s) i) (As (Date d) day) (As (Bool n) flag) (As (Timestamp d) stamp))', "SELECT * FROM (VALUES (CAST(12 AS BIGINT), DATE '1996-02-29', false, TIMESTAMPTZ '1996-02-29 00:00:00+00'), (7, DATE '2001-12-31', true, TIMESTAMPTZ '2001-12-31 00:00:00+00')) AS t(i, day, flag, stamp)")
query("if_else", '(Project part p_partkey (As (IfElse (Greater p_size 25) "big" "small") size) (As (Divide p_retailprice 2.0) half))', "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, p_retailprice / 2.0 AS half FROM part")
query("string_join", '(Project nation (As label (StringJoin n_name " / " (Text n_regionkey))))', "SELECT n_name || ' / ' || CAST(n_regionkey AS VARCHAR) AS label FROM nation")
query("slice", "(Slice (OrderBy part (keys p_retailprice p_partkey)) 5 10)", "SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 5")
query("order_by_desc", "(Slice (OrderBy events (keys event_type (Desc value) event_id)) 0 25)", "SELECT * FROM events ORDER BY event_type, value DESC, event_id LIMIT 25")
query("order_postfix_desc", "(Order customer (By c_nationkey c_acctbal desc c_custkey))", "SELECT * FROM customer")
query("sort_asc", "(Sort supplier (By s_name))", "SELECT * FROM supplier")
query("top", "(Top customer (By c_acctbal desc c_custkey) 12)", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
query("nulls_last", "(Slice (OrderBy (Table (a 3 NULL 1 2)) (keys (Desc a))) 0 3)", "SELECT * FROM (VALUES (CAST(3 AS BIGINT)), (2), (1)) AS t(a)")
query("group_by_all", "(Project (GroupBy customer (Sum c_custkey) (Min c_acctbal) (Max c_acctbal) (Count c_name) (CountAll) c_mktsegment) c_mktsegment (As |sum(c_custkey)| s) (As |min(c_acctbal)| lo) (As |max(c_acctbal)| hi) (As |count(c_name)| n) (As |count_all()| rows))", "SELECT c_mktsegment, CAST(sum(c_custkey) AS BIGINT) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(c_name) AS n, count(*) AS rows FROM customer GROUP BY 1")
query("group_names", "(GroupBy customer (Min c_acctbal) (CountAll) c_nationkey)", 'SELECT c_nationkey, min(c_acctbal) AS "min(c_acctbal)", count(*) AS "count_all()" FROM customer GROUP BY 1')
query("group_mean", "(Project (GroupBy lineitem (Avg l_quantity) (Mean l_linenumber) l_returnflag) l_returnflag (As (Round |mean(l_quantity)| 6) q) (As (Round |mean(l_linenumber)| 6) n))", "SELECT l_returnflag, round(avg(l_quantity), 6) AS q, round(avg(l_linenumber), 6) AS n FROM lineitem GROUP BY 1")
query("group_global", "(Project (GroupBy orders (Min o_orderkey) (Max o_orderkey) (CountAll)) (As |min(o_orderkey)| lo) (As |max(o_orderkey)| hi) (As |count_all()| n))", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders")
query("group_distinct", "(GroupBy lineitem l_returnflag l_linestatus)", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
query("group_constant", "(Project (Group nation (Function 0) Count) (As n Count k Function))", "SELECT count(*) AS n, CAST(0 AS INTEGER) AS k FROM nation")
query("group_as", "(Group orders (By o_orderstatus) (As n (Count *) least (Min o_totalprice)))", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY 1")
query("group_unnamed", "(Group events (By event_type) (Max value))", "SELECT event_type, max(value) AS value FROM events GROUP BY 1")
query("group_null_key", "(GroupBy (Table (k 1 NULL 1 NULL) (v 1 2 3 NULL)) (Count v) k)", 'SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS BIGINT)), (NULL, 1)) AS t(k, "count(v)")')
query("having", "(Filter (GroupBy lineitem (Sum l_quantity) l_orderkey) (Greater |sum(l_quantity)| 250))", 'SELECT l_orderkey, sum(l_quantity) AS "sum(l_quantity)" FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250')
query("join_inner", "(Project (Join orders customer (Equal o_custkey c_custkey)) o_orderkey c_name)", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
query("join_swapped_keys", "(Project (Join orders customer (Where (Equal c_custkey o_custkey))) (As k o_orderkey n c_name))", "SELECT o_orderkey AS k, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey")
query("join_multi_key", "(Group (Join (Project lineitem (As a l_orderkey b l_linenumber q l_quantity)) (Project lineitem (As c l_orderkey d l_linenumber)) (Where (Equal (List a b) (List c d)))) (Function 1) Count)", 'SELECT count(*) AS "Count", CAST(1 AS INTEGER) AS "Function" FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber')
query("join_suffixes", "(Join nation (Project nation n_nationkey n_regionkey) (Equal n_nationkey n_nationkey))", "SELECT a.n_nationkey AS n_nationkey_l, a.n_name, a.n_regionkey AS n_regionkey_l, b.n_nationkey AS n_nationkey_r, b.n_regionkey AS n_regionkey_r FROM nation a JOIN nation b USING (n_nationkey)")
query("join_residual", "(Project (Join lineitem part (Equal l_partkey p_partkey) (Greater l_quantity p_size)) l_orderkey l_linenumber p_partkey p_size l_quantity)", "SELECT l_orderkey, l_linenumber, p_partkey, p_size, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > p_size")
BRACKETS = '(Table (bracket "low" "mid" "high") (low 0 15 35) (high 14 34 60))'
BRACKETS_SQL = "(VALUES ('low', 0, 14), ('mid', 15, 34), ('high', 35, 60)) AS b(bracket, low, high)"
query("join_range", f"(Project (Join part {BRACKETS} (Between p_size low high)) p_partkey p_size bracket)", f"SELECT p_partkey, p_size, bracket FROM part JOIN {BRACKETS_SQL} ON p_size BETWEEN low AND high")
SEASONS = '(Table (season "long" "mid" "day" "none") (first (DateObject "1992-01-01") (DateObject "1995-03-01") (DateObject "1996-07-04") (DateObject "1999-01-01")) (last (DateObject "1998-12-31") (DateObject "1995-03-31") (DateObject "1996-07-04") (DateObject "1998-01-01")))'
SEASONS_SQL = "(VALUES ('long', DATE '1992-01-01', DATE '1998-12-31'), ('mid', DATE '1995-03-01', DATE '1995-03-31'), ('day', DATE '1996-07-04', DATE '1996-07-04'), ('none', DATE '1999-01-01', DATE '1998-01-01')) AS s(season, first, last)"
DAYS = "(Project orders (As (Date o_orderdate) day) o_orderkey)"
query("join_range_dates", f"(Project (Join {DAYS} {SEASONS} (Between day first last)) o_orderkey season)", f"SELECT o_orderkey, season FROM orders JOIN {SEASONS_SQL} ON CAST(o_orderdate AS DATE) BETWEEN first AND last")
query("join_range_spans", f"(Project (Join {SEASONS} {DAYS} (Between day first last)) o_orderkey season)", f"SELECT o_orderkey, season FROM orders JOIN {SEASONS_SQL} ON CAST(o_orderdate AS DATE) BETWEEN first AND last")
query("join_left_range", f"(Project (LeftJoin {DAYS} (Filter {SEASONS} (Unequal season \"long\")) (Between day first last)) o_orderkey season)".replace("(Unequal", "(NotEqual"), f"SELECT o_orderkey, season FROM orders LEFT JOIN {SEASONS_SQL} ON CAST(o_orderdate AS DATE) BETWEEN first AND last AND season <> 'long'")
query("join_anti_range", f"(AntiJoin {DAYS} (Filter {SEASONS} (NotEqual season \"long\")) (Between day first last))", f"SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM {SEASONS_SQL} WHERE CAST(o_orderdate AS DATE) BETWEEN first AND last AND season <> 'long')")
query("join_left_spans", f"(Project (LeftJoin {SEASONS} (Filter {DAYS} (Less o_orderkey 400)) (Between day first last)) o_orderkey season)", f"SELECT o_orderkey, season FROM {SEASONS_SQL} LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN first AND last AND o_orderkey < 400")
query("join_anti_spans", f"(Project (AntiJoin {SEASONS} (Filter {DAYS} (Less o_orderkey 400)) (Between day first last)) season)", f"SELECT season FROM {SEASONS_SQL} WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN first AND last AND o_orderkey < 400)")
query("join_left_condition", "(Project (LeftJoin nation supplier (Greater n_nationkey s_suppkey) (Less s_acctbal 0.0)) n_nationkey s_suppkey)", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey > s_suppkey AND s_acctbal < 0")
query("join_anti_condition", "(AntiJoin nation supplier (Greater n_nationkey s_suppkey) (Less s_acctbal 0.0))", "SELECT * FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE n_nationkey > s_suppkey AND s_acctbal < 0)")
query("join_left", "(Project (GroupBy (LeftJoin customer (Filter orders (Greater o_totalprice 400000.0)) (Equal c_custkey o_custkey)) (Count o_orderkey) c_custkey) c_custkey (As |count(o_orderkey)| n))", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY 1")
query("join_left_residual", "(Project (LeftJoin nation supplier (Equal n_nationkey s_nationkey) (Greater s_acctbal 5000.0)) n_name s_name)", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
query("join_anti", "(AntiJoin customer (Filter orders (Greater o_totalprice 400000.0)) (Equal c_custkey o_custkey))", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
query("join_anti_nulls", "(AntiJoin (Table (a 1 NULL 3)) (Table (b 1 NULL)) (Equal a b))", "SELECT * FROM (VALUES (CAST(NULL AS BIGINT)), (3)) AS t(a)")
query("union_bag", '(Union (Filter nation (Equal n_regionkey 1)) (Filter nation (Less n_nationkey 8)))', "SELECT * FROM nation WHERE n_regionkey = 1 UNION ALL SELECT * FROM nation WHERE n_nationkey < 8")
query("union_null_fill", "(Union (Project nation n_name) (Project region (As r_name n_name) r_regionkey))", "SELECT n_name, CAST(NULL AS INTEGER) AS r_regionkey FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
query("union_distinct", "(GroupBy (Union (Project orders (As o_custkey k)) (Project customer (As c_custkey k))) k)", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
query("cumulate", "(Project (Cumulate (OrderBy events (keys ts event_id)) (Sum value)) event_id (As (Round |sum(value)| 2) total))", "SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM events")
query("cumulate_max", "(Project (Cumulate (OrderBy events (keys ts event_id)) (Max value)) event_id (As |max(value)| top))", "SELECT event_id, max(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events")
query("cumulate_count", "(Project (Cumulate (OrderBy events (keys ts event_id)) (Count value)) event_id (As |count(value)| n))", "SELECT event_id, count(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
query("pairwise", "(Project (Pairwise (OrderBy events (keys ts event_id)) change value 7) event_id (As (Round change 6) change))", "SELECT event_id, round(value - lag(value, 7) OVER (ORDER BY ts, event_id), 6) AS change FROM events")
query("pairwise_of_cumulate", "(Project (Pairwise (Cumulate (OrderBy events (keys ts event_id)) (Sum value)) smoothed |sum(value)| 7) event_id (As (Round smoothed 2) smoothed))", "SELECT event_id, round(s - lag(s, 7) OVER (ORDER BY ts, event_id), 2) AS smoothed FROM (SELECT *, sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)")
query("name_by_name", "(Name (Filter nation (Less n_nationkey 10)) few) (Join (ByName few) (Project (ByName few) (As n_nationkey k)) (Equal n_nationkey k))", "SELECT *, n_nationkey AS k FROM nation WHERE n_nationkey < 10")
query("scalar_by_name", "(Name (GroupBy lineitem (Min l_extendedprice)) cheapest) (Project (Filter lineitem (Equal l_extendedprice (ByName cheapest))) l_orderkey l_extendedprice)", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice = (SELECT min(l_extendedprice) FROM lineitem)")
query("hotspot", "(Name (Project events (As (Date ts) day) value event_id) daily) (Project (Join (GroupBy (ByName daily) (Max value) day) (ByName daily) (Equal day day) (Equal |max(value)| value)) (As day_l day) event_id (As value top))", "SELECT CAST(ts AS DATE) AS day, event_id, value AS top FROM events JOIN (SELECT CAST(ts AS DATE) AS d, max(value) AS m FROM events GROUP BY 1) ON CAST(ts AS DATE) = d AND value = m")
query("materialize", "(Name (Materialize (Filter part (Greater p_size 45))) large) (GroupBy (ByName large) (CountAll) p_type)", 'SELECT p_type, count(*) AS "count_all()" FROM part WHERE p_size > 45 GROUP BY 1')
query("text_functions", '(Project customer c_custkey (As (Utf8Trim (StringJoin "  " c_mktsegment " ")) a) (As (Replace c_name "#" "-") b) (As (Substring c_name 2 5) c) (As (FindSubstring c_name "0") d) (As (LPad c_mktsegment 12 ".") e) (As (Utf8Reverse c_mktsegment) f))', "SELECT c_custkey, c_mktsegment AS a, replace(c_name, '#', '-') AS b, substr(c_name, 3, 5) AS c, CAST(instr(c_name, '0') - 1 AS BIGINT) AS d, lpad(c_mktsegment, 12, '.') AS e, reverse(c_mktsegment) AS f FROM customer")
query("number_functions", "(Project part p_partkey (As (Modulo p_partkey 7) a) (As (IntegerDivide p_partkey 7) b) (As (BitAnd p_partkey 12) c) (As (MaxElementWise p_size 20 30) d) (As (IsIn p_size 1 2 3) e) (As (Trunc (Divide (Subtract 25 p_size) 4.0)) f))", "SELECT p_partkey, p_partkey % 7 AS a, p_partkey // 7 AS b, p_partkey & 12 AS c, CAST(greatest(p_size, 20, 30) AS BIGINT) AS d, p_size IN (1, 2, 3) AS e, CAST(trunc((25 - p_size) / 4.0) AS BIGINT) AS f FROM part")
query("date_functions", '(Project orders o_orderkey (As (DayOfYear o_orderdate) a) (As (AddDays (Date o_orderdate) 30) b) (As (DaysBetween (DateObject "1995-01-01") (Date o_orderdate)) c))', "SELECT o_orderkey, dayofyear(o_orderdate) AS a, CAST(o_orderdate AS DATE) + 30 AS b, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS c FROM orders")
query("schema", "(Schema customer)", "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS \"Columns\"")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = open_session(spark, sf_dir)
    return spark.createDataFrame([(session.evaluate("(ToStatus (Filter orders (Greater o_totalprice 1000.0)))"),)], "status string")


def symbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar expressions and what stays of unknown ones."""
    session = Session(spark)
    texts = ["(Plus 5 2 2)", "(Greater 5 2)", '(StringJoin "howdie" " " "world")', '(Symbol "x")', "(Undefined (Plus 1 2))", "(Assuming t a)"]
    return spark.createDataFrame([(t, repr(session.call(t))) for t in texts], "query string, result string")


def pairwise_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged differences over ranges, more rows back than some ranges have."""
    session = open_session(spark, sf_dir)
    session.window_ranges = 64
    return session.dataframe(PLANS["pairwise"].replace("value 7", "value 300"))


def cumulate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum cut into ranges, as a large table takes it."""
    session = open_session(spark, sf_dir)
    session.window_ranges = 16
    return session.dataframe(PLANS["cumulate"])


def large(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A join as two large sides take it: nothing is broadcast for its size."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators import joins

        kept, joins.SMALL = joins.SMALL, -1
        try:
            return run(PLANS[name])(spark, sf_dir)
        finally:
            joins.SMALL = kept

    return query


def scratch(spark: SparkSession) -> str:
    """A new folder for files of a query's own, under the one that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillon-")
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, lines: list[str]) -> str:
    """A small text file, wherever the path lies; it goes with the driver."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(p)
    out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    out.close()
    fs.deleteOnExit(p.getParent())
    return path


def nations(spark: SparkSession, sf_dir: str) -> list:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()


def on_files(plan: str, write: Callable[[SparkSession, str, str], None]) -> Callable[[SparkSession, str], DataFrame]:
    """A plan over files that write(spark, sf_dir, folder) makes of the tables. $DIR stands for the folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark)
        write(spark, sf_dir, folder)
        return run(plan.replace("$DIR", folder))(spark, sf_dir)

    return query


def directory(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Two files with other columns in other order, and one of no known kind."""
    rows = nations(spark, sf_dir)
    put(spark, f"{folder}/a b.csv", ["n_nationkey,n_name", *[f"{r.n_nationkey},{r.n_name}" for r in rows if r.n_regionkey == 0]])
    put(spark, f"{folder}/c.csv", ["n_name,n_nationkey,n_regionkey", *[f"{r.n_name},{r.n_nationkey},{r.n_regionkey}" for r in rows if r.n_regionkey == 1]])
    put(spark, f"{folder}/d.txt", ["n_nationkey,n_name", "99,none"])


def bars(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A file without a header, by the benchmark's columns, and one with a header."""
    rows = nations(spark, sf_dir)
    put(spark, f"{folder}/nation.tbl", [f"{r.n_nationkey}|{r.n_name}|{r.n_regionkey}|none|" for r in rows])
    put(spark, f"{folder}/named.tbl", ["key|label|", *[f"{r.n_nationkey}|{r.n_name}|" for r in rows]])


def flagged(spark: SparkSession, sf_dir: str, folder: str) -> None:
    put(spark, f"{folder}/n.csv", [f"{r.n_nationkey};{r.n_name}" for r in nations(spark, sf_dir)])


def uneven(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Rows with fewer fields than the header has, and objects in which fields appear late."""
    rows = nations(spark, sf_dir)
    put(spark, f"{folder}/short.csv", ["n_nationkey,n_name,n_regionkey", *[f"{r.n_nationkey},{r.n_name}" + (f",{r.n_regionkey}" if r.n_nationkey % 2 else "") for r in rows]])
    put(spark, f"{folder}/late.json", [f'{{"n_nationkey": {r.n_nationkey}' + (f', "n_name": "{r.n_name}"' if r.n_nationkey > 4 else "") + (f', "n_regionkey": {r.n_regionkey}' if r.n_nationkey < 20 else "") + "}" for r in rows])


#: Rows that a file of pieces() has at most, about.
PIECE = 250_000


def pieces(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """events in order in files of very different sizes, the small ones between large ones: shares of the rows, and the
    middle row alone. Large shares take more files, so that each is sorted by itself; null ids stand last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    n = max(1, events.count())
    small = min(0.02, 0.1 * PIECE / n)
    shares, ends = [0, small, 0.5, 0.75, 0.75 + small, 1], []
    for a, b in zip(shares, shares[1:]):
        files = math.ceil((b - a) * n / PIECE)
        ends += [a + (b - a) * i / files for i in range(1, files + 1)]
    middle, *cuts = events.agg(F.percentile_approx("event_id", [0.5, *ends[:-1]], max(10000, 20 * len(ends)))).first()[0] or [0]
    cuts = sorted({*cuts, middle - 1, middle})
    at = F.coalesce(below(F.col("event_id"), cuts).cast("int"), F.lit(len(cuts)))
    events.repartitionById(len(cuts) + 1, at).sortWithinPartitions(F.col("event_id").asc_nulls_last()).write.parquet(f"{folder}/events.parquet")


def kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel's operators, errors as data, and the pipeline of stages."""
    session = open_session(spark, sf_dir)
    session.register_stage("twice", lambda x: Expr("Plus", x, x))
    texts = [
        '(EvaluateInEngines (List "spark") (Plus 1 2))', '(EvaluateInEngines (List "twice" "spark") 21)', "(EvaluateInEngines (List 7) 1)", "(Minus 9 4)", "(- 9 4)",
        "(Equals 3 3)", "(GetEngineDescription)", '(SetDefaultEnginePipeline "twice" "spark")', "4", "(ResetEngines)", "5",
    ]
    def shown(x) -> str:
        if isinstance(x, Expr) and str(x.head) == "ErrorWhenEvaluatingExpression":
            return f"{x.head}: {x.args[1]}"
        return x.split("\n")[0] if isinstance(x, str) else repr(x)

    return spark.createDataFrame([(t, shown(session.call(t))) for t in texts], "query string, result string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(text) for name, text in PLANS.items()}
FILES: dict[str, tuple[str, Callable[[SparkSession, str, str], None], str]] = {
    "load_directory": ('(Load "$DIR")', directory, "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey END AS n_regionkey, CASE n_regionkey WHEN 0 THEN 'a b.csv' ELSE 'c.csv' END AS \"file name\" FROM nation WHERE n_regionkey < 2"),
    "load_directory_columns": ('(Load "$DIR" n_name n_regionkey)', directory, "SELECT n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey END AS n_regionkey, CASE n_regionkey WHEN 0 THEN 'a b.csv' ELSE 'c.csv' END AS \"file name\" FROM nation WHERE n_regionkey < 2"),
    "load_tbl": ('(Load "$DIR/nation.tbl")', bars, "SELECT n_nationkey, n_name, n_regionkey, 'none' AS n_comment FROM nation"),
    "load_tbl_header": ('(Load "$DIR/named.tbl" label key)', bars, "SELECT n_name AS label, n_nationkey AS key FROM nation"),
    "load_flags": ('(Project (Load "$DIR/n.csv" (header 0) (separator ";")) (As _c0 k) (As _c1 n))', flagged, "SELECT n_nationkey AS k, n_name AS n FROM nation"),
    "load_schema": ('(Load "$DIR/n.csv" (header 0) (separator ";") (schema "k bigint, n string"))', flagged, "SELECT n_nationkey AS k, n_name AS n FROM nation"),
    "load_ragged": ('(Load "$DIR/short.csv")', uneven, "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey END AS n_regionkey FROM nation"),
    "load_padded_before": ('(Load "$DIR/late.json")', uneven, "SELECT n_nationkey, CASE WHEN n_nationkey > 4 THEN n_name END AS n_name, CASE WHEN n_nationkey < 20 THEN n_regionkey END AS n_regionkey FROM nation"),
    "slice_files": ('(Slice (Load "$DIR/events.parquet") 1234 3456)', pieces, "SELECT event_id, value FROM events ORDER BY event_id LIMIT 3456 OFFSET 1234"),
    "cumulate_files": ('(Project (Cumulate (Load "$DIR/events.parquet") (Sum value)) event_id (As (Round |sum(value)| 2) total))', pieces, "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM events"),
    "pairwise_files": ('(Project (Pairwise (Load "$DIR/events.parquet") change value 9) event_id (As (Round change 6) change))', pieces, "SELECT event_id, round(value - lag(value, 9) OVER (ORDER BY event_id), 6) AS change FROM events"),
}
QUERIES |= {name: on_files(plan, write) for name, (plan, write, _) in FILES.items()}
SQL |= {name: sql for name, (_, _, sql) in FILES.items()}
QUERIES |= {f"{name}_large": large(name) for name in ("join_range_dates", "join_range_spans", "join_left_range", "join_anti_range", "join_left_spans", "join_anti_spans", "join_left_condition", "join_anti_condition")}
SQL |= {name: SQL[name.removesuffix("_large")] for name in QUERIES if name.endswith("_large")}
QUERIES |= {"kernel": kernel, "to_status": status, "symbolic": symbolic, "join_range_buckets": large("join_range"), "cumulate_ranges": cumulate_ranges, "pairwise_ranges": pairwise_ranges}
SQL |= {
    "to_status": "SELECT 'OK' AS status",
    "symbolic": "SELECT * FROM (VALUES ('(Plus 5 2 2)', '9'), ('(Greater 5 2)', 'True'), ('(StringJoin \"howdie\" \" \" \"world\")', '''howdie world'''), ('(Symbol \"x\")', 'x'), ('(Undefined (Plus 1 2))', '(Undefined 3)'), ('(Assuming t a)', '(Assuming t a)')) AS t(query, result)",
    "join_range_buckets": SQL["join_range"],
    "cumulate_ranges": SQL["cumulate"],
    "pairwise_ranges": SQL["pairwise"].replace("lag(value, 7)", "lag(value, 300)"),
    "kernel": """SELECT * FROM (VALUES ('(EvaluateInEngines (List "spark") (Plus 1 2))', '3'), ('(EvaluateInEngines (List "twice" "spark") 21)', '42'),
        ('(EvaluateInEngines (List 7) 1)', 'ErrorWhenEvaluatingExpression: expected and actual type mismatch in expression "7", expected string'),
        ('(Minus 9 4)', '5'), ('(- 9 4)', '5'), ('(Equals 3 3)', 'True'), ('(GetEngineDescription)', 'Operators:'),
        ('(SetDefaultEnginePipeline "twice" "spark")', 'okay'), ('4', '8'), ('(ResetEngines)', 'okay'), ('5', '10')) AS t(query, result)""",
}
