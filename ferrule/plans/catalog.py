"""Every query by name: what Spark runs, and the SQL that an independent engine answers the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import semantics
from ferrule.functions.typed import constant
from ferrule.functions.typed import field as typed_field
from ferrule.operators import access, relational, statistics
from ferrule.plans import tpch
from ferrule.plans.read_plan import ReadPlan, Table
from ferrule.sources import ddl
from ferrule.sources.scratch import scratch
from ferrule.sources.tables import oracle, run_sql, scan, typed
from ferrule.streaming import versions

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a DataFrame function with its oracle text (over the typed views)."""

    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def shared(name: str, sql: str) -> None:
    """Register a text that both engines read alike."""
    QUERIES[name] = lambda spark, d, text=sql: run_sql(spark, d, text)
    ORACLE[name] = oracle(sql)


for _name, _text in tpch.QUERIES.items():
    shared(_name, _text)

# -- scans and access paths ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM ord WHERE o_orderdate >= DATE '2001-01-01'")
def scan_project(s, d):
    return scan(s, d, "orders").where(F.col("o_orderdate") >= F.lit(date(2001, 1, 1))).select("o_orderkey", "o_orderstatus")


@query("SELECT * FROM cust")
def full_scan(s, d):
    return typed(s, d, "cust")


@query("SELECT * FROM ord WHERE o_orderkey = 100")
def point_read(s, d):
    return access.point(typed(s, d, "ord"), ["o_orderkey"], [100])


@query("SELECT * FROM ord WHERE o_orderkey IN (1, 5, 9, 700, 12000, 999999999)")
def batch_point_read(s, d):
    return access.points(typed(s, d, "ord"), "o_orderkey", [1, 5, 9, 700, 12000, 999999999])


@query("SELECT * FROM ord WHERE o_orderkey IN (SELECT l_orderkey FROM li WHERE l_quantity > 49)")
def batch_point_read_many(s, d):
    return access.points(typed(s, d, "ord"), "o_orderkey", typed(s, d, "li").where("l_quantity > 49").select("l_orderkey"))


@query("SELECT * FROM ord WHERE o_orderkey >= 1000 AND o_orderkey < 1100")
def range_scan_fwd(s, d):
    return access.key_range(typed(s, d, "ord"), ["o_orderkey"], [1000], [1100])


@query("SELECT * FROM ord WHERE o_orderkey >= 1000 AND o_orderkey < 1100 ORDER BY o_orderkey DESC LIMIT 7")
def range_scan_rev_limit(s, d):
    return access.key_range(typed(s, d, "ord"), ["o_orderkey"], [1000], [1100], limit=7, reverse=True)


@query("SELECT o_orderkey FROM ord WHERE o_orderkey >= 2000 AND o_orderkey < 2500")
def range_keys_only(s, d):
    return access.key_range(scan(s, d, "orders"), ["o_orderkey"], [2000], [2500], keys_only=True)


@query("SELECT * FROM ord WHERE o_custkey >= 10 AND o_custkey < 20 ORDER BY o_custkey, o_orderkey LIMIT 50")
def secondary_range(s, d):
    return access.secondary_range(typed(s, d, "ord"), ["o_custkey"], ["o_orderkey"], [10], [20], limit=50)


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM li WHERE l_orderkey = 7")
def prefix_equality(s, d):
    return access.prefix(scan(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"], [7])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM li WHERE l_orderkey = 7 ORDER BY l_linenumber, l_partkey, l_suppkey LIMIT 1")
def prefix_first(s, d):
    return access.prefix(scan(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [7], limit=1).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT * FROM cust WHERE c_name = 'Customer#000000042'")
def unique_point(s, d):
    return access.point(typed(s, d, "cust"), ["c_name"], ["Customer#000000042"])


@query("SELECT o_custkey, o_orderkey FROM ord ORDER BY o_custkey, o_orderkey LIMIT 1")
def cursor_first(s, d):
    return access.first(scan(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM ord ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")
def cursor_last(s, d):
    return access.tail(scan(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM ord WHERE o_custkey = 20 AND o_orderkey > 40 ORDER BY o_orderkey LIMIT 1")
def cursor_next_same(s, d):
    return access.next_same(scan(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], [20, 40])


@query("SELECT o_orderkey, o_custkey FROM ord WHERE o_orderkey >= 100 AND o_orderkey < 9000")
def parallel_range_scan(s, d):
    return access.parallel_range(scan(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 9000, 7)


@query("SELECT o_custkey, o_orderkey FROM ord WHERE o_custkey > 50 OR (o_custkey = 50 AND o_orderkey > 3000) ORDER BY o_custkey, o_orderkey LIMIT 40")
def exclusive_start(s, d):
    return access.key_range(scan(s, d, "orders"), ["o_custkey", "o_orderkey"], [50, 3000], limit=40, keys_only=True, after=True)


@query("SELECT o_custkey, o_orderkey FROM ord WHERE o_custkey > 50 ORDER BY o_custkey, o_orderkey LIMIT 40")
def exclusive_prefix(s, d):
    return access.key_range(scan(s, d, "orders"), ["o_custkey", "o_orderkey"], [50], limit=40, keys_only=True, after=True)


@query("SELECT * FROM ord WHERE o_orderkey <= 777 ORDER BY o_orderkey DESC LIMIT 1")
def prev_key(s, d):
    return access.previous(typed(s, d, "ord"), ["o_orderkey"], [777])


@query("SELECT * FROM ord WHERE o_orderkey < 777 ORDER BY o_orderkey DESC LIMIT 1")
def prev_key_exclusive(s, d):
    return access.previous(typed(s, d, "ord"), ["o_orderkey"], [777], inclusive=False)


@query("SELECT o_custkey, o_orderkey FROM ord WHERE o_custkey = 42 ORDER BY o_orderkey DESC LIMIT 1")
def prefix_last(s, d):
    return access.prefix_last(scan(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [42])


@query("SELECT o_custkey, o_orderkey FROM ord WHERE o_custkey <= 999999999 ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")
def prefix_last_or_previous(s, d):
    return access.prefix_last(scan(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [999999999], or_previous=True)


@query("SELECT * FROM cust ORDER BY c_custkey LIMIT 1")
def index_first(s, d):
    return access.first(typed(s, d, "cust"), ["c_custkey"])


@query("SELECT * FROM ord ORDER BY o_orderkey DESC LIMIT 5")
def index_tail(s, d):
    return access.tail(typed(s, d, "ord"), ["o_orderkey"], 5)


@query("SELECT MAX(o_orderkey) AS max_key FROM ord")
def index_tail_max(s, d):
    return scan(s, d, "orders").agg(F.max("o_orderkey").alias("max_key"))


@query("SELECT COUNT(*) AS n FROM li")
def unqualified_count(s, d):
    return scan(s, d, "lineitem").agg(F.count("*").alias("n"))


@query(
    "SELECT o_custkey, o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, "
    "LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following FROM ord"
)
def cursor_steps(s, d):
    return access.neighbours(scan(s, d, "orders"), "o_orderkey", "o_custkey", [])


@query("SELECT o.* FROM ord o JOIN (SELECT DISTINCT o_orderkey AS k FROM ord WHERE o_orderstatus = 'P') i ON i.k = o.o_orderkey")
def rowid_reread(s, d):
    rows = typed(s, d, "ord")
    return access.reread(rows.where("o_orderstatus = 'P'"), rows, ["o_orderkey"])


def _tables(s, d) -> dict[str, Table]:
    return {
        "customer": Table(scan(s, d, "customer"), ["c_custkey"], {"by_nation": ["c_nationkey"]}),
        "orders": Table(scan(s, d, "orders"), ["o_orderkey"], {"by_customer": ["o_custkey"]}),
        "nation": Table(scan(s, d, "nation"), ["n_nationkey"]),
        "lines": Table(scan(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"]),
    }


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM ord WHERE o_custkey >= 10 AND o_custkey < 20)")
def read_plan_for_each(s, d):
    return ReadPlan(_tables(s, d)).run("SI:orders:by_customer:10:E:20;FE:lines:B0.CI0")[1]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nat WHERE n_nationkey = (SELECT c_nationkey FROM cust WHERE c_custkey = 77)")
def read_plan_dependent(s, d):
    return ReadPlan(_tables(s, d)).run("R:customer:77;R:nation:B0.CI2")[1]


@query(
    "SELECT c_custkey, c_name FROM cust WHERE c_nationkey = 3 AND c_custkey >= (SELECT c_custkey FROM (SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS r, "
    "COUNT(*) OVER () AS n FROM cust WHERE c_custkey >= 0 AND c_custkey < 500) x WHERE r = (n - 1) // 2 + 1) + 1 AND c_custkey < 2000"
)
def read_plan_midpoint(s, d):
    rows = ReadPlan(_tables(s, d)).run("S:customer:0:E:500;S:customer:B0.MCI0+1:E:2000")[1]
    return rows.where("c_nationkey = 3").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_nationkey FROM cust WHERE c_nationkey = 4 ORDER BY c_custkey DESC LIMIT 6")
def read_plan_index_reverse(s, d):
    return ReadPlan(_tables(s, d)).run("SI:customer:by_nation:4:limit=6:reverse=1")[0].select("c_custkey", "c_nationkey")


shared("derived_table", "SELECT _c0, COUNT(*) AS n FROM (SELECT o_orderstatus AS _c0, o_orderkey FROM ord WHERE o_totalprice > 1000) _r1 GROUP BY _c0")

# -- predicates ---------------------------------------------------------------------------------------------------

shared("and_or_not", "SELECT p_partkey FROM prt WHERE NOT (p_size < 10 OR p_size > 40) AND (p_type = 'PROMO' OR p_brand = 'Brand#3')")
shared("is_null", "SELECT k, k IS NULL AS is_null, k IS NOT NULL AS is_not_null, n FROM (SELECT CASE WHEN c_custkey < 100 THEN c_custkey END AS k, COUNT(*) AS n FROM cust GROUP BY 1) x")
shared("null_safe_equal", "SELECT COUNT(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS b FROM cust) x WHERE a IS NOT DISTINCT FROM b")
shared("empty_is_not_null", "SELECT x, COUNT(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS x FROM cust) y GROUP BY x")


@query("SELECT p_partkey FROM prt WHERE CAST(p_retailprice AS DECIMAL(21,2)) > CAST(p_size * 30 AS DECIMAL(21,2))")
def compare_decimal_int(s, d):
    p = typed(s, d, "prt")
    return p.where(typed_field(p, "p_retailprice").compare(">", typed_field(p, "p_size") * constant(30)).column).select("p_partkey")


@query("SELECT o_orderkey FROM ord WHERE o_orderdate < TIMESTAMP '1996-01-02 12:00:00'")
def compare_date_string(s, d):
    o = typed(s, d, "ord").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.where(typed_field(o, "day").compare("<", constant("1996-01-02 12:00:00")).column).select("o_orderkey")


@query("SELECT o_orderkey FROM ord WHERE o_totalprice BETWEEN 1000.50 AND 20000")
def between_decimal(s, d):
    o = typed(s, d, "ord")
    return o.where(typed_field(o, "o_totalprice").compare("between", constant(Decimal("1000.50")), constant(20000)).column).select("o_orderkey")


shared("not_between", "SELECT p_partkey FROM prt WHERE p_size NOT BETWEEN 5 AND 45")
shared("in_list", "SELECT p_partkey FROM prt WHERE p_brand IN ('Brand#1', 'Brand#7', 'none') AND p_size NOT IN (1, 2, 3)")


@query("SELECT p_partkey, p_name FROM prt WHERE p_name LIKE 's%_r%g'")
def like(s, d):
    return typed(s, d, "prt").where(semantics.like(F.col("p_name"), "s%_r%g")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM cust WHERE c_name NOT LIKE '%!_1%' ESCAPE '!'")
def not_like_escape(s, d):
    return typed(s, d, "cust").where(~semantics.like(F.col("c_name"), "%!_!1%", "!")).select("c_custkey")


shared("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS bucket FROM ord")

_MAYBE = "(SELECT CASE WHEN s_suppkey % 10 <> 3 THEN s_suppkey END AS y FROM supp)"
_LEFT = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS x FROM cust)"


def _in_sides(s, d, nulls: bool) -> tuple[DataFrame, DataFrame]:
    left = run_sql(s, d, f"SELECT * FROM {_LEFT}")
    right = run_sql(s, d, f"SELECT * FROM {_MAYBE}")
    return left, right if nulls else right.where("y IS NOT NULL")


@query(f"SELECT c_custkey, x IN {_MAYBE} AS found FROM {_LEFT} l")
def in_3vl_projection(s, d):
    left, right = _in_sides(s, d, True)
    return relational.in_subquery(left, "x", right, "y", "found").select("c_custkey", "found")


@query(f"SELECT c_custkey, x NOT IN (SELECT y FROM {_MAYBE} m WHERE y IS NOT NULL) AS missing FROM {_LEFT} l")
def not_in_3vl_projection(s, d):
    left, right = _in_sides(s, d, False)
    return relational.in_subquery(left, "x", right, "y", "missing", negated=True).select("c_custkey", "missing")


@query(f"SELECT c_custkey, COALESCE(x IN {_MAYBE}, FALSE) AS found FROM {_LEFT} l")
def in_is_true(s, d):
    left, right = _in_sides(s, d, True)
    return relational.in_subquery(left, "x", right, "y", "found").select("c_custkey", relational.is_true(F.col("found")).alias("found"))


@query(f"SELECT c_custkey, NOT COALESCE(x IN {_MAYBE}, TRUE) AS missing FROM {_LEFT} l")
def in_is_false(s, d):
    left, right = _in_sides(s, d, True)
    found = relational.in_subquery(left, "x", right, "y", "found")
    return found.select("c_custkey", (~F.coalesce("found", F.lit(True))).alias("missing"))


@query(f"SELECT c_custkey FROM {_LEFT} l WHERE x NOT IN (SELECT y FROM {_MAYBE} m WHERE y IS NOT NULL)")
def not_in_null_aware(s, d):
    left, right = _in_sides(s, d, False)
    return relational.anti_in(left, "x", right, "y").select("c_custkey")


@query(f"SELECT c_custkey FROM {_LEFT} l WHERE x NOT IN {_MAYBE}")
def not_in_with_nulls(s, d):
    left, right = _in_sides(s, d, True)
    return relational.anti_in(left, "x", right, "y").select("c_custkey")


@query("SELECT c_custkey FROM cust WHERE EXISTS (SELECT 1 FROM ord WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def exists_corr(s, d):
    big = typed(s, d, "ord").where("o_totalprice > 150000")
    return relational.exists(typed(s, d, "cust"), big, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM cust WHERE NOT EXISTS (SELECT 1 FROM ord WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_corr(s, d):
    open_ = typed(s, d, "ord").where("o_orderstatus = 'P'")
    return relational.exists(typed(s, d, "cust"), open_, F.col("o_custkey") == F.col("c_custkey"), negated=True).select("c_custkey")


shared("scalar_corr", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM ord WHERE o_custkey = c_custkey) AS top FROM cust")
shared("scalar_uncorr", "SELECT o_orderkey FROM ord WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM ord)")
shared("quantified_all", "SELECT s_suppkey FROM supp WHERE s_acctbal >= (SELECT MAX(s_acctbal) FROM supp)")

_SOME = "(SELECT s_nationkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS v FROM supp WHERE s_nationkey % 3 > 0)"


# nothing to compare with, or a null among it, decides as three-valued logic has it
@query(f"SELECT c_custkey, c_acctbal > ANY (SELECT v FROM {_SOME} m WHERE k = c_nationkey) AS some, c_acctbal > ALL (SELECT v FROM {_SOME} m WHERE k = c_nationkey) AS every FROM cust")
def quantified_any_all(s, d):
    right = run_sql(s, d, f"SELECT * FROM {_SOME} m")
    some = relational.quantified(typed(s, d, "cust"), "c_acctbal", ">", right, "v", "some", all_of=False, on=("c_nationkey", "k"))
    every = relational.quantified(some, "c_acctbal", ">", right, "v", "every", all_of=True, on=("c_nationkey", "k"))
    return every.select("c_custkey", "some", "every")


# -- joins --------------------------------------------------------------------------------------------------------

shared("join_inner", "SELECT o_orderkey, c_name FROM ord JOIN cust ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")


@query(
    "SELECT p_partkey, lo FROM prt JOIN (SELECT DISTINCT p_size AS lo, p_size + 3 AS hi FROM prt) r "
    "ON p_size >= lo AND p_size < hi"
)
def join_theta(s, d):
    p = typed(s, d, "prt").select("p_partkey", "p_size")
    r = p.select(F.col("p_size").alias("lo"), (F.col("p_size") + 3).alias("hi")).distinct()
    return relational.theta(p, r, ("p_size", "lo"), ("p_size", "hi"), 3).select("p_partkey", "lo")


shared("join_cross_where", "SELECT n_name, r_name FROM nat, reg WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
shared("join_left", "SELECT c_custkey, o_orderkey FROM cust LEFT JOIN ord ON c_custkey = o_custkey AND o_totalprice > 200000")
shared("join_right", "SELECT c_custkey, n_name FROM cust RIGHT JOIN nat ON c_nationkey = n_nationkey AND c_acctbal > 9000")
shared("join_full", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT * FROM nat WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nat WHERE n_nationkey > 5) b ON a.n_nationkey = b.n_nationkey")


@query("SELECT s_suppkey FROM supp WHERE s_suppkey IN (SELECT l_suppkey FROM li WHERE l_quantity >= 50)")
def join_semi(s, d):
    return typed(s, d, "supp").join(typed(s, d, "li").where("l_quantity >= 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT o_orderkey FROM ord WHERE NOT EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey)")
def join_anti(s, d):
    return typed(s, d, "ord").join(scan(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


shared("join_self", "SELECT a.n_name AS n1, b.n_name AS n2 FROM nat a JOIN nat b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
shared("join_nested", "SELECT c_custkey, n_name FROM cust LEFT JOIN (nat JOIN reg ON n_regionkey = r_regionkey AND r_name = 'AFRICA') ON c_nationkey = n_nationkey")

# -- aggregates ---------------------------------------------------------------------------------------------------

shared("agg_global", "SELECT COUNT(*) AS n, CAST(SUM(l_quantity) AS DECIMAL(38,2)) AS q, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM li")
shared("group_by_expr", "SELECT l_linenumber % 3 AS g, COUNT(*) AS n, CAST(SUM(l_extendedprice * l_quantity) AS DECIMAL(38,4)) AS worth FROM li GROUP BY l_linenumber % 3")
shared("count_forms", "SELECT COUNT(*) AS a, COUNT(1) AS b, COUNT(x) AS c FROM (SELECT CASE WHEN c_custkey % 5 > 0 THEN 1 END AS x FROM cust) y")
shared("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM li GROUP BY l_returnflag")
shared("sum_distinct", "SELECT CAST(SUM(DISTINCT l_quantity) AS DECIMAL(38,2)) AS q, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS n FROM li")


# a mean with six digits, exactly and half up, in whole numbers
@query("SELECT l_returnflag, CAST((CAST(SUM(l_extendedprice) * 100 AS HUGEINT) * 20000 + COUNT(*)) // (2 * COUNT(*)) AS BIGINT) AS mean_e6 FROM li GROUP BY l_returnflag")
def avg_exact(s, d):
    li = typed(s, d, "li")
    mean = typed_field(li, "l_extendedprice").avg().column.alias("mean")
    return li.groupBy("l_returnflag").agg(mean).select("l_returnflag", (F.col("mean") * 1000000).cast("long").alias("mean_e6"))


shared("min_max_string", "SELECT MIN(p_name) AS lo, MAX(p_name) AS hi, MIN(p_brand) AS b FROM prt")
shared("having", "SELECT o_custkey, COUNT(*) AS n FROM ord GROUP BY o_custkey HAVING COUNT(*) > 15")
shared("having_scalar", "SELECT l_suppkey, CAST(SUM(l_quantity) AS DECIMAL(38,2)) AS q FROM li GROUP BY l_suppkey HAVING SUM(l_quantity) > (SELECT SUM(l_quantity) / 100 FROM li)")
shared("distinct", "SELECT DISTINCT p_type, p_brand FROM prt")
shared("rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM li GROUP BY ROLLUP (l_returnflag, l_linestatus)")
shared("grouping_sets", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g1, GROUPING(l_linestatus) AS g2, COUNT(*) AS n FROM li GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
# a mean of distinct values with six digits, half up
shared("avg_distinct", "SELECT l_returnflag, CAST(FLOOR(CAST(SUM(DISTINCT l_quantity) AS DECIMAL(20,2)) * 1000000 / COUNT(DISTINCT l_quantity) + 0.5) AS BIGINT) AS mean_e6 FROM li GROUP BY l_returnflag")
shared("bit_aggregates", "SELECT o_orderstatus, BIT_AND(o_custkey) AS a, BIT_OR(o_custkey) AS o, BIT_XOR(o_custkey) AS x FROM ord GROUP BY o_orderstatus")
# variance from whole sums, so that no order of rows shows
shared("variance_exact", "SELECT l_returnflag, CAST(FLOOR((CAST(COUNT(*) AS DECIMAL(12,0)) * SUM(CAST(l_linenumber * l_linenumber AS DECIMAL(8,0))) - CAST(SUM(l_linenumber) AS DECIMAL(14,0)) * CAST(SUM(l_linenumber) AS DECIMAL(14,0))) / COUNT(*)) AS BIGINT) AS n_times_var FROM li GROUP BY l_returnflag")


@query("SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nat GROUP BY n_regionkey")
def group_concat(s, d):
    return typed(s, d, "nat").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


shared("cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM li GROUP BY CUBE (l_returnflag, l_linestatus)")

# -- order and limits ---------------------------------------------------------------------------------------------

_NULLS = "(SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS k FROM cust)"
shared("order_nulls", f"SELECT c_custkey, k FROM {_NULLS} x ORDER BY k ASC NULLS FIRST, c_custkey")
shared("order_nulls_desc", f"SELECT c_custkey, k FROM {_NULLS} x ORDER BY k DESC NULLS LAST, c_custkey")
shared("topk", "SELECT o_orderkey, o_totalprice FROM ord ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
shared("limit_offset", "SELECT o_orderkey FROM ord ORDER BY o_orderkey LIMIT 20 OFFSET 100")
shared("limit_in_subquery", "SELECT COUNT(*) AS n FROM li WHERE l_orderkey IN (SELECT o_orderkey FROM ord ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")


@query("SELECT n_nationkey FROM nat ORDER BY n_nationkey")
def limit_unbounded(s, d):
    return access.bounded(scan(s, d, "nation").select("n_nationkey"), 2**64 - 1)


# -- scalars ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST((CAST(o_totalprice * 100 AS BIGINT) * 20000 + o_custkey % 5) // (2 * (o_custkey % 5)) AS BIGINT) END AS q_e6 FROM ord")
def div_null(s, d):
    o = typed(s, d, "ord")
    q = (typed_field(o, "o_totalprice") / (typed_field(o, "o_custkey") % constant(5))).column
    return o.select("o_orderkey", (q * 1000000).cast("long").alias("q_e6"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey % (p_size % 4) END AS m FROM prt")
def mod_null(s, d):
    p = typed(s, d, "prt")
    return p.select("p_partkey", semantics.remainder(F.col("p_partkey"), (F.col("p_size") % 4).cast("long")).alias("m"))


shared(
    "arithmetic",
    "SELECT p_partkey, CAST(p_retailprice + p_size AS DECIMAL(20,2)) AS a, CAST(p_retailprice - p_size AS DECIMAL(20,2)) AS b, CAST(p_retailprice * p_size AS DECIMAL(25,2)) AS c FROM prt",
)
shared("year", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM ord GROUP BY 1")
shared("substring", "SELECT c_custkey, SUBSTRING(c_name, 1, 4) AS a, SUBSTRING(c_name, 3, 0) AS b, SUBSTRING(c_name, 5, 100) AS c FROM cust")


@query("SELECT n_nationkey, CAST(ASCII(n_name) AS BIGINT) AS a, CAST(0 AS BIGINT) AS e FROM nat")
def ascii_byte(s, d):
    return scan(s, d, "nation").select("n_nationkey", semantics.ascii_byte(F.col("n_name")).alias("a"), semantics.ascii_byte(F.lit("")).alias("e"))


shared("date_interval", "SELECT COUNT(*) AS n FROM ord WHERE o_orderdate >= DATE '1998-12-01' - INTERVAL '90' DAY AND o_orderdate < DATE '1998-12-01' + INTERVAL '1' MONTH")


@query("SELECT l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM li WHERE CAST(l_extendedprice AS DOUBLE) * 2.0 > 50000.0 GROUP BY l_linenumber")
def double_checked(s, d):
    li = scan(s, d, "lineitem")
    x = typed_field(li, "l_extendedprice") * constant(2.0)
    return li.where(x.compare(">", constant(50000.0)).column).groupBy("l_linenumber").agg(F.count("*").alias("n"))


# -- collation ----------------------------------------------------------------------------------------------------

_MIXED = "(SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN UPPER(p_type) ELSE LOWER(p_type) END AS t FROM prt)"


def _mixed(s, d) -> DataFrame:
    return run_sql(s, d, f"SELECT p_partkey, t FROM {_MIXED} x")


@query(f"SELECT LOWER(t) AS t, COUNT(*) AS n FROM {_MIXED} x GROUP BY LOWER(t)")
def ai_ci_group(s, d):
    return _mixed(s, d).groupBy(semantics.ai_ci(F.col("t")).alias("k")).agg(F.count("*").alias("n")).select(F.lower(F.collate("k", "UTF8_BINARY")).alias("t"), "n")


@query(f"SELECT COUNT(DISTINCT LOWER(t)) AS n FROM {_MIXED} x")
def ai_ci_count_distinct(s, d):
    return _mixed(s, d).agg(F.countDistinct(semantics.ai_ci(F.col("t"))).alias("n"))


@query(f"SELECT MIN(LOWER(t)) AS lo, MAX(LOWER(t)) AS hi FROM {_MIXED} x")
def ai_ci_order_minmax(s, d):
    m = _mixed(s, d).agg(F.min(semantics.ai_ci(F.col("t"))).alias("lo"), F.max(semantics.ai_ci(F.col("t"))).alias("hi"))
    return m.select(*[F.lower(F.collate(c, "UTF8_BINARY")).alias(c) for c in ("lo", "hi")])


@query(f"SELECT p_partkey FROM {_MIXED} x WHERE LOWER(t) = 'promo'")
def ai_ci_equal(s, d):
    return _mixed(s, d).where(semantics.ai_ci(F.col("t")) == semantics.ai_ci(F.lit("PrömÓ"))).select("p_partkey")


@query(f"SELECT p_partkey FROM {_MIXED} x WHERE LOWER(t) LIKE 's_a%d'")
def ai_ci_like(s, d):
    return _mixed(s, d).where(semantics.like_ai_ci(F.col("t"), "S_Á%D")).select("p_partkey")


# -- statistics ---------------------------------------------------------------------------------------------------


@query(
    "SELECT 1 AS n_parts, COUNT(DISTINCT l_orderkey) AS ndv FROM li UNION ALL "
    "SELECT 2, COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM li) x"
)
def ndv_prefix(s, d):
    return statistics.prefix_ndv(scan(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT COUNT(*) AS n_rows FROM ord")
def row_count(s, d):
    return statistics.row_count(scan(s, d, "orders"))


@query(
    "SELECT value, CAST(cum AS BIGINT) AS cum FROM (SELECT value, w, SUM(w) OVER (ORDER BY value) AS cum, SUM(w) OVER () AS total FROM "
    "(SELECT l_orderkey AS value, COUNT(*) AS w FROM li GROUP BY l_orderkey) a) b "
    "WHERE FLOOR(cum / GREATEST(1, FLOOR(total / 64))) > FLOOR((cum - w) / GREATEST(1, FLOOR(total / 64))) OR cum = total"
)
def histogram_equi_height(s, d):
    return statistics.equi_height(scan(s, d, "lineitem"), "l_orderkey")


@query(
    "SELECT 'o_orderkey' AS column_name, CAST(MIN(o_orderkey) AS VARCHAR) AS low, CAST(MAX(o_orderkey) AS VARCHAR) AS high FROM ord UNION ALL "
    "SELECT 'o_orderstatus', MIN(o_orderstatus), MAX(o_orderstatus) FROM ord"
)
def column_range(s, d):
    return statistics.column_range(scan(s, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query(None)
def hll_ndv(s, d):
    return statistics.hll(scan(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query(
    "SELECT 1 AS n_parts, CAST(FLOOR(COUNT(*) * 10000.0 / COUNT(DISTINCT l_orderkey)) AS BIGINT) AS rec_e4 FROM li UNION ALL "
    "SELECT 2, CAST(FLOOR(SUM(n) * 10000.0 / COUNT(*)) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM li GROUP BY l_orderkey, l_linenumber) x"
)
def rec_per_key(s, d):
    one = statistics.records_per_key(scan(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    # from the counts: the average is rounded, and what is rounded up cannot be cut any more
    return one.select("n_parts", F.expr("CAST(n_rows AS DECIMAL(20,0)) * 10000 div NULLIF(ndv, 0)").alias("rec_e4"))


@query("SELECT 'orders' AS t, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE o_orderkey % 4 = 0) > COUNT(*) * 0.2 AS stale FROM ord")
def drift(s, d):
    o = scan(s, d, "orders")
    n, changed = o.agg(F.count("*"), F.count_if(F.col("o_orderkey") % 4 == 0)).first()
    return s.createDataFrame([("orders", n, statistics.stale(n, changed))], "t string, n_rows long, stale boolean")


@query("SELECT COUNT(*) AS n_rows FROM ord WHERE o_custkey >= 5 AND o_custkey < 90")
def records_in_range(s, d):
    return statistics.records_in_range(scan(s, d, "orders"), "o_custkey", 5, 90)


# -- versions -----------------------------------------------------------------------------------------------------

_LOG = (
    "(SELECT user_id AS k, event_id AS tid, CAST(FLOOR(event_id / 500) AS BIGINT) AS epoch, "
    "CASE WHEN event_id % 11 = 0 THEN 'del' ELSE 'put' END AS op, event_type AS v FROM ev)"
)
_SNAP = "SELECT k, v FROM (SELECT k, v, op, ROW_NUMBER() OVER (PARTITION BY k ORDER BY epoch DESC, tid DESC) AS r FROM {log} l WHERE epoch <= {at}) x WHERE r = 1 AND op = 'put'"


def _log(s, d) -> DataFrame:
    return run_sql(s, d, f"SELECT k, tid, epoch, op, v FROM {_LOG} l")


@query(_SNAP.format(log=_LOG, at=9))
def snapshot_at_epoch(s, d):
    return versions.snapshot(_log(s, d), ["k"], 9)


@query(_SNAP.format(log=_LOG, at=1000000))
def snapshot_with_deletes(s, d):
    return versions.snapshot(_log(s, d), ["k"])


_PENDING = "(SELECT o_orderkey, o_orderstatus, tid, op FROM (SELECT o_orderkey + (CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END) AS o_orderkey, 'W' AS o_orderstatus, o_orderkey AS tid, CASE WHEN o_orderkey % 3 = 1 THEN 'del' ELSE 'put' END AS op FROM ord) y)"


@query(
    f"SELECT o_orderkey, o_orderstatus FROM ord WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_PENDING} p) UNION ALL "
    f"SELECT o_orderkey, o_orderstatus FROM {_PENDING} p WHERE op = 'put'"
)
def own_writes_merge(s, d):
    base = scan(s, d, "orders").select("o_orderkey", "o_orderstatus")
    pending = run_sql(s, d, f"SELECT * FROM {_PENDING} p")
    return versions.own_writes(base, pending, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows FROM li GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1")
def unique_violation(s, d):
    return versions.unique_violations(scan(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def _live(s, d, epoch: int) -> DataFrame:
    newest = _log(s, d).where(F.col("epoch") <= epoch).groupBy("k").agg(F.max_by(F.struct("op", "tid"), F.struct("epoch", "tid")).alias("v"))
    return newest.where("v.op = 'put'").select("k", F.col("v.tid").alias("tid"))


_LIVE = "(SELECT k, tid FROM (SELECT k, tid, op, ROW_NUMBER() OVER (PARTITION BY k ORDER BY epoch DESC, tid DESC) AS r FROM {log} l WHERE epoch <= {at}) x WHERE r = 1 AND op = 'put')"


@query(
    f"SELECT COALESCE(a.k, b.k) AS k FROM (SELECT * FROM {_LIVE.format(log=_LOG, at=5)} q WHERE k < 200) a "
    f"FULL JOIN (SELECT * FROM {_LIVE.format(log=_LOG, at=7)} q WHERE k < 200) b ON a.k = b.k WHERE a.tid IS DISTINCT FROM b.tid"
)
def range_validation(s, d):
    cut = F.col("k") < 200
    return versions.changed_range(_live(s, d, 5).where(cut), _live(s, d, 7).where(cut), ["k"])


@query(f"SELECT a.k FROM {_LIVE.format(log=_LOG, at=5)} a LEFT JOIN {_LIVE.format(log=_LOG, at=7)} b ON a.k = b.k WHERE a.tid IS DISTINCT FROM b.tid")
def read_validation(s, d):
    return versions.changed_reads(_live(s, d, 5), _live(s, d, 7), ["k"])


_BATCH = "(SELECT l_orderkey * 2 AS k, MOD(l_partkey, 97) AS seq, l_partkey, l_suppkey AS v FROM li)"
_HAVE = "(SELECT o_orderkey AS k, o_custkey AS v FROM ord)"
_ORDER = ("seq", "l_partkey")


def _base_and_batch(s, d) -> tuple[DataFrame, DataFrame]:
    return run_sql(s, d, f"SELECT * FROM {_HAVE} x"), run_sql(s, d, f"SELECT * FROM {_BATCH} x")


@query(f"SELECT k FROM {_BATCH} b GROUP BY k HAVING COUNT(*) > 1 OR k IN (SELECT k FROM {_HAVE} h)")
def insert_duplicate(s, d):
    return versions.duplicate_keys(*_base_and_batch(s, d), ["k"])


_FIRST = "SELECT k, v FROM (SELECT k, v, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {by}) AS r FROM {batch} b) x WHERE r = 1"


@query(_FIRST.format(by="seq, l_partkey, v", batch=_BATCH) + f" AND k NOT IN (SELECT k FROM {_HAVE} h) UNION ALL SELECT k, v FROM {_HAVE} h")
def insert_ignore(s, d):
    base, batch = _base_and_batch(s, d)
    return versions.insert_ignored(base, batch, ["k"], _ORDER).unionByName(base)


_REPLACED = _FIRST.format(by="seq DESC, l_partkey DESC, v DESC", batch=_BATCH)


@query(f"{_REPLACED} UNION ALL SELECT k, v FROM {_HAVE} h WHERE k NOT IN (SELECT k FROM {_BATCH} b)")
def replace_row(s, d):
    base, batch = _base_and_batch(s, d)
    put = versions.replaced(batch, ["k"], _ORDER).select("k", "v", F.lit(0).cast("long").alias("tid"), F.lit(versions.PUT).alias("op"))
    return versions.own_writes(base, put, ["k"])


# every duplicate adds what it was to insert
@query(f"SELECT k, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT k, v FROM {_BATCH} b UNION ALL SELECT k, v FROM {_HAVE} h) x GROUP BY k")
def on_duplicate_key_update(s, d):
    base, batch = _base_and_batch(s, d)
    put = versions.upserted(base, batch, ["k"], _ORDER, lambda old, new: {"v": old["v"] + new["v"]})
    return versions.own_writes(base, put.select("k", "v", F.lit(0).cast("long").alias("tid"), F.lit(versions.PUT).alias("op")), ["k"])


# two transactions insert; the second one to commit has read keys as absent that are there now
@query(f"SELECT DISTINCT k FROM {_BATCH} b WHERE MOD(l_partkey, 2) = 0 AND k IN (SELECT k FROM {_BATCH} c WHERE MOD(l_partkey, 2) = 1)")
def insert_conflict(s, d):
    batch = run_sql(s, d, f"SELECT * FROM {_BATCH} x")
    reads = batch.where("l_partkey % 2 = 0").select("k", F.lit(None).cast("long").alias("tid")).distinct()
    now = batch.where("l_partkey % 2 = 1").select("k", F.lit(1).cast("long").alias("tid")).distinct()
    return versions.changed_reads(reads, now, ["k"])


_COMMITTED = (
    "(SELECT CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, "
    "CASE WHEN o_orderkey % 10 = 2 THEN o_custkey + 1 ELSE o_custkey END AS c FROM ord WHERE o_orderkey % 10 <> 3)"
)


def _committed(s, d, index: bool = False) -> versions.ChangeLog:
    """Orders in a change log: loaded, then keys moved, rows changed and deleted in a second commit."""
    log = versions.ChangeLog(s, scratch(s, "orders"), {"k": "long"}, {"c": "long"})
    rows = scan(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    t = log.begin()
    t.writes.append(rows.withColumn("op", F.lit(versions.PUT)))  # a load: nothing to be checked against
    log.commit(t)
    if index:
        log.add_index("by_c", ["c"])
    t, moved = log.begin(), rows.where("k % 10 = 1")
    log.update(t, moved.select((F.col("k") + 10_000_000).alias("k"), "c"), moved.select("k"))
    log.update(t, rows.where("k % 10 = 2").select("k", (F.col("c") + 1).alias("c")))
    log.delete(t, rows.where("k % 10 = 3").select("k"))
    log.commit(t)
    return log


@query(f"SELECT k, c FROM {_COMMITTED} x")
def log_commits(s, d):
    return _committed(s, d).read()


@query("SELECT o_orderkey AS k, o_custkey AS c FROM ord")
def log_as_of_first_commit(s, d):
    return _committed(s, d).read(1)


@query(f"SELECT k, c FROM {_COMMITTED} x")
def log_checkpoint(s, d):
    log = _committed(s, d)
    log.checkpoint()
    return versions.ChangeLog(s, log.path, {"k": "long"}, {"c": "long"}).read()  # as another reader finds it


@query(f"SELECT k, c FROM {_COMMITTED} x WHERE c >= 40 AND c < 90")
def index_read(s, d):
    return _committed(s, d, index=True).read_index("by_c", (F.col("c") >= 40) & (F.col("c") < 90))


# only a change of the columns that were read is a conflict: epochs 5 and 7 of the log, and the type of event alone
_VALUES = "(SELECT k, tid, v FROM (SELECT k, tid, v, op, ROW_NUMBER() OVER (PARTITION BY k ORDER BY epoch DESC, tid DESC) AS r FROM {log} l WHERE epoch <= {at}) x WHERE r = 1 AND op = 'put')"


@query(f"SELECT a.k FROM {_VALUES.format(log=_LOG, at=5)} a LEFT JOIN {_VALUES.format(log=_LOG, at=7)} b ON a.k = b.k WHERE b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def column_read_validation(s, d):
    at = lambda epoch: versions.snapshot(_log(s, d), ["k"], epoch)
    return versions.changed_columns(at(5), at(7), ["k"], ["v"])


# -- definitions --------------------------------------------------------------------------------------------------


@query("SELECT COUNT(*) AS n, COUNT(*) AS keys, TRUE AS above FROM li")
def hidden_key(s, d):
    rows = ddl.with_hidden_key(scan(s, d, "lineitem").select("l_orderkey"), watermark=41)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("hidden_key").alias("keys"), (F.min("hidden_key") > 41).alias("above"))


@query("SELECT * FROM (VALUES ('a', 'decimal(20,0)', FALSE), ('b', 'decimal(15,2)', TRUE), ('c', 'string', TRUE), ('d', 'timestamp_ntz', TRUE), ('e', 'binary', TRUE)) t(name, kind, nullable)")
def create_table(s, d):
    table = ddl.Definition("t", {"a": "BIGINT UNSIGNED", "b": "DECIMAL(15,2)", "c": "VARCHAR(32)", "d": "DATETIME", "e": "VARBINARY(16)"}, key=["a"])
    return s.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in table.schema()], "name string, kind string, nullable boolean")


@query("SELECT n_regionkey, COUNT(*) AS n FROM nat GROUP BY n_regionkey")
def load_and_view(s, d):
    tables = ddl.Catalog(s)
    tables.create(ddl.Definition("loaded_nation", {"n_nationkey": "INT", "n_name": "VARCHAR(25)", "n_regionkey": "INT"}, key=["n_nationkey"]))
    tables.load("loaded_nation", scan(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    s.sql("CREATE OR REPLACE TEMPORARY VIEW nations_by_region AS SELECT n_regionkey, COUNT(*) AS n FROM loaded_nation GROUP BY n_regionkey")
    return s.table("nations_by_region")


# -- windows and set operations -----------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr FROM ord WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey)")
def window_rank(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderstatus", "o_orderkey")
    return scan(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


shared("window_running_sum", "SELECT o_custkey, o_orderkey, CAST(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DECIMAL(38,2)) AS running FROM ord")
shared("union_all", "SELECT c_nationkey AS k FROM cust UNION ALL SELECT s_nationkey FROM supp")
shared("union_distinct", "SELECT c_nationkey AS k FROM cust UNION SELECT s_nationkey FROM supp")
shared("intersect", "SELECT o_custkey AS k FROM ord INTERSECT SELECT s_suppkey FROM supp")
shared("except", "SELECT c_custkey AS k FROM cust EXCEPT SELECT o_custkey FROM ord WHERE o_totalprice > 100000")
