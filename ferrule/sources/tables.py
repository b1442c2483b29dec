"""Tables: explicit schemas, Parquet scans, and the typed view of each that queries are written against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Columns of each table as stored.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

#: Primary keys; lineitem's rows repeat theirs, so it has a hidden one.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"],
}

#: Typed views: money is exact.  Good in Spark and in the oracle alike.
VIEWS = {
    "reg": "SELECT r_regionkey, r_name FROM {region}",
    "nat": "SELECT n_nationkey, n_name, n_regionkey FROM {nation}",
    "cust": "SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, c_mktsegment FROM {customer}",
    "supp": "SELECT s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal FROM {supplier}",
    "prt": "SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice AS DECIMAL(15,2)) AS p_retailprice FROM {part}",
    "ord": "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice, o_orderdate, o_orderpriority FROM {orders}",
    "li": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(15,2)) AS l_quantity, "
    "CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(15,2)) AS l_discount, "
    "CAST(l_tax AS DECIMAL(15,2)) AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM {lineitem}",
    "ev": "SELECT event_id, ts, user_id, event_type, value FROM {events}",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Columnar scan of a table under its declared schema: no inference, columns and filters pushed down."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def prelude(text: str) -> str:
    """The WITH clause of the typed views that a query's text names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not used:
        return text
    own = re.match(r"\s*WITH\s+", text, re.IGNORECASE)
    return f"WITH {views}, {text[own.end():]}" if own else f"WITH {views} {text}"


def typed(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One typed view as a DataFrame."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {view}")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the typed views, or over stored tables named in braces."""
    full = prelude(text)
    names = set(re.findall(r"\{(\w+)\}", full))
    return spark.sql(full, **{n: scan(spark, sf_dir, n) for n in names})


def oracle(text: str) -> str:
    """The same text for an engine that knows the stored tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", prelude(text))
