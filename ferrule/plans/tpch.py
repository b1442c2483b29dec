"""The 22 decision-support queries, in the shapes that the tables at hand allow.

One text serves Spark and the oracle.  Dates are compared as timestamps against date literals, so that filters reach
the scan.  Sums of money are exact decimals, ratios whole millionths.  Where the standard schema
has supplier stock, line items stand in; columns that do not exist are left out.
"""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"


def money(expr: str, scale: int = 4) -> str:
    return f"CAST(SUM({expr}) AS DECIMAL(38,{scale}))"


def share(part: str, whole: str, times: int = 1) -> str:
    """A ratio of sums in whole millionths."""
    return f"CAST(FLOOR(CAST(SUM({part}) AS DECIMAL(20,4)) * {1_000_000 * times} / CAST(SUM({whole}) AS DECIMAL(20,4))) AS BIGINT)"


def year(expr: str) -> str:
    return f"CAST(EXTRACT(YEAR FROM {expr}) AS BIGINT)"


QUERIES = {
    "tpch_q01": f"""
        SELECT l_returnflag, l_linestatus, {money("l_quantity", 2)} AS sum_qty, {money("l_extendedprice", 2)} AS sum_base_price,
               {money(REVENUE)} AS sum_disc_price, {money(REVENUE + " * (1 + l_tax)", 6)} AS sum_charge,
               CAST(CAST(SUM(l_quantity) AS DECIMAL(25,2)) / COUNT(*) AS DECIMAL(19,6)) AS avg_qty, COUNT(*) AS count_order
        FROM li WHERE l_shipdate <= DATE '2001-09-02'
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q02": """
        WITH offer AS (
            SELECT s_acctbal, s_name, n_name, p_partkey, s_suppkey, MIN(l_extendedprice) AS cost
            FROM li JOIN prt ON l_partkey = p_partkey JOIN supp ON l_suppkey = s_suppkey
            JOIN nat ON s_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey
            WHERE p_size < 15 AND p_type LIKE '%AR%' AND r_name = 'EUROPE'
            GROUP BY s_acctbal, s_name, n_name, p_partkey, s_suppkey)
        SELECT s_acctbal, s_name, n_name, p_partkey, cost
        FROM (SELECT o.*, MIN(cost) OVER (PARTITION BY p_partkey) AS least FROM offer o) offers
        WHERE cost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""
        SELECT l_orderkey, {money(REVENUE)} AS revenue, CAST(o_orderdate AS DATE) AS o_date
        FROM cust JOIN ord ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_date, l_orderkey LIMIT 10""",
    "tpch_q04": """
        SELECT o_orderpriority, COUNT(*) AS order_count FROM ord
        WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1997-07-01'
          AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": f"""
        SELECT n_name, {money(REVENUE)} AS revenue
        FROM cust JOIN ord ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey
        JOIN supp ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey
        WHERE c_nationkey = s_nationkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'
        GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q06": f"""
        SELECT {money("l_extendedprice * l_discount")} AS revenue FROM li
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
          AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": f"""
        SELECT supp_nation, cust_nation, l_year, {money("volume")} AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {year("l_shipdate")} AS l_year, {REVENUE} AS volume
            FROM supp JOIN li ON s_suppkey = l_suppkey JOIN ord ON o_orderkey = l_orderkey JOIN cust ON c_custkey = o_custkey
            JOIN nat n1 ON s_nationkey = n1.n_nationkey JOIN nat n2 ON c_nationkey = n2.n_nationkey
            WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
              AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": f"""
        SELECT o_year, {share("CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END", "volume")} AS mkt_share_e6 FROM (
            SELECT {year("o_orderdate")} AS o_year, {REVENUE} AS volume, n2.n_name AS nation
            FROM prt JOIN li ON p_partkey = l_partkey JOIN supp ON s_suppkey = l_suppkey JOIN ord ON l_orderkey = o_orderkey
            JOIN cust ON o_custkey = c_custkey JOIN nat n1 ON c_nationkey = n1.n_nationkey JOIN reg ON n1.n_regionkey = r_regionkey
            JOIN nat n2 ON s_nationkey = n2.n_nationkey
            WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') all_nations
        GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""
        SELECT nation, o_year, {money("amount")} AS sum_profit FROM (
            SELECT n_name AS nation, {year("o_orderdate")} AS o_year, {REVENUE} - p_retailprice * l_quantity / 100 AS amount
            FROM prt JOIN li ON p_partkey = l_partkey JOIN supp ON s_suppkey = l_suppkey
            JOIN ord ON o_orderkey = l_orderkey JOIN nat ON s_nationkey = n_nationkey
            WHERE p_name LIKE '%ring%') profit
        GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, {money(REVENUE)} AS revenue, c_acctbal, n_name
        FROM cust JOIN ord ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey JOIN nat ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-10-01' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        WITH held AS (
            SELECT l_partkey, {money("l_extendedprice * l_quantity")} AS worth
            FROM li JOIN supp ON l_suppkey = s_suppkey JOIN nat ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY l_partkey)
        SELECT l_partkey, worth FROM held WHERE worth * 500 > (SELECT SUM(worth) FROM held) ORDER BY worth DESC, l_partkey""",
    "tpch_q12": """
        SELECT l_returnflag, SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high,
               SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low
        FROM ord JOIN li ON o_orderkey = l_orderkey
        WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
        GROUP BY l_returnflag ORDER BY l_returnflag""",
    "tpch_q13": """
        SELECT c_count, COUNT(*) AS custdist FROM (
            SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM cust
            LEFT JOIN ord ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%NOT%SPEC%' GROUP BY c_custkey) c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
        SELECT {share("CASE WHEN p_type LIKE 'PROMO%' THEN " + REVENUE + " ELSE 0 END", REVENUE, 100)} AS promo_revenue_e6
        FROM li JOIN prt ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "tpch_q15": f"""
        WITH revenue AS (
            SELECT l_suppkey AS supplier_no, {money(REVENUE)} AS total FROM li
            WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM supp JOIN revenue ON s_suppkey = supplier_no
        WHERE total = (SELECT MAX(total) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": """
        SELECT p_brand, p_type, p_size, COUNT(DISTINCT l_suppkey) AS supplier_cnt
        FROM li JOIN prt ON p_partkey = l_partkey
        WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MED%' AND p_size IN (1, 9, 14, 19, 23, 36, 45, 49)
          AND l_suppkey NOT IN (SELECT s_suppkey FROM supp WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
        SELECT CAST(SUM(l_extendedprice) AS DECIMAL(38,2)) AS total FROM li JOIN prt ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#12' AND l_quantity * 5 < (
            SELECT CAST(CAST(SUM(i.l_quantity) AS DECIMAL(25,2)) / COUNT(*) AS DECIMAL(19,6)) FROM li i WHERE i.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_date, o_totalprice, CAST(SUM(l_quantity) AS DECIMAL(38,2)) AS qty
        FROM cust JOIN ord ON c_custkey = o_custkey JOIN li ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM li GROUP BY l_orderkey HAVING SUM(l_quantity) > 200)
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_date, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT {money(REVENUE)} AS revenue FROM li JOIN prt ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
           OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
           OR (p_brand = 'Brand#14' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""",
    "tpch_q20": """
        SELECT s_name, s_suppkey FROM supp JOIN nat ON s_nationkey = n_nationkey
        WHERE s_suppkey IN (
            SELECT o.l_suppkey FROM li o
            WHERE o.l_partkey IN (SELECT p_partkey FROM prt WHERE p_name LIKE 'small%')
              AND o.l_quantity * 2 > (SELECT SUM(i.l_quantity) FROM li i WHERE i.l_partkey = o.l_partkey AND i.l_suppkey = o.l_suppkey
                                      AND i.l_shipdate >= DATE '1997-01-01' AND i.l_shipdate < DATE '1998-01-01'))
          AND n_regionkey = 1
        ORDER BY s_name, s_suppkey""",
    # a line waits if its order has other suppliers, none of them late: facts of an order, so lines are read once
    "tpch_q21": """
        SELECT s_name, CAST(SUM(n_late) AS BIGINT) AS numwait FROM (
            SELECT l_orderkey, MIN(l_suppkey) AS lo, MAX(l_suppkey) AS hi, MIN(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS late,
                   MAX(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS last_late, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_late
            FROM li GROUP BY l_orderkey) facts
        JOIN ord ON o_orderkey = l_orderkey JOIN supp ON s_suppkey = late JOIN nat ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND lo < hi AND late = last_late
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        SELECT cntrycode, COUNT(*) AS numcust, CAST(SUM(c_acctbal) AS DECIMAL(38,2)) AS totacctbal FROM (
            SELECT SUBSTRING(c_name, 18, 1) AS cntrycode, c_acctbal FROM cust
            WHERE SUBSTRING(c_name, 18, 1) IN ('1', '3', '2', '9', '0', '8', '7')
              AND c_acctbal > (SELECT CAST(CAST(SUM(c_acctbal) AS DECIMAL(25,2)) / COUNT(*) AS DECIMAL(19,6)) FROM cust
                               WHERE c_acctbal > 0 AND SUBSTRING(c_name, 18, 1) IN ('1', '3', '2', '9', '0', '8', '7'))
              AND NOT EXISTS (SELECT 1 FROM ord WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) custsale
        GROUP BY cntrycode ORDER BY cntrycode""",
}
