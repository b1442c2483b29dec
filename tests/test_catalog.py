"""Every query against an independent engine, on the smallest tables."""

import oracle
import pytest

from ferrule.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_oracle(name, spark, sf_dir, con):
    ok, said = oracle.same(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE[name])
    assert ok, said


def test_sketch_is_near(spark, sf_dir):
    rows = {r.column_name: r.ndv for r in catalog.QUERIES["hll_ndv"](spark, sf_dir).collect()}
    true = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("count(distinct l_partkey) p", "count(distinct l_suppkey) s").first()
    assert abs(rows["l_partkey"] / true.p - 1) < 0.15
    assert abs(rows["l_suppkey"] / true.s - 1) < 0.15


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # or the plan's text is cut
    plan = catalog.QUERIES["tpch_q06"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate" in plan
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in scan and "l_orderkey" not in scan


def test_quantified_comparisons_are_three_valued(spark):
    from ferrule.operators import relational

    left = spark.createDataFrame([(1, 5), (1, None), (2, 5), (3, 5), (4, 5)], "g int, x int")
    right = spark.createDataFrame([(1, 4), (1, 6), (2, None), (3, 4), (3, None)], "k int, y int")
    every = relational.quantified(left, "x", ">", right, "y", "a", all_of=True, on=("g", "k"))
    some = relational.quantified(every, "x", ">", right, "y", "b", all_of=False, on=("g", "k"))
    assert sorted(map(tuple, some.collect()), key=str) == sorted([(1, 5, False, True), (1, None, None, None), (2, 5, None, None), (3, 5, None, True), (4, 5, True, False)], key=str)


@pytest.mark.parametrize(
    "keys",
    [
        [(1, 1), (1, 1), (1, 2), (2, 1), (3, 1)],  # 5 / 3 and 5 / 4: cut, not rounded
        [(1, 1), (1, None), (None, 1), (None, None), (None, None), (2, 1), (3, 1), (3, 1)],  # nulls are values of longer prefixes only
    ],
)
def test_records_per_key_are_cut_and_count_nulls_as_sql(spark, sf_dir, tmp_path, keys):
    values = ", ".join(f"({k}, {n})" for k, n in keys).replace("None", "NULL")
    row = f"(SELECT * FROM '{sf_dir}/lineitem.parquet' LIMIT 1)"
    columns = "* EXCLUDE (k, n) REPLACE (CAST(k AS BIGINT) AS l_orderkey, CAST(n AS INTEGER) AS l_linenumber)"
    oracle.duckdb.sql(f"COPY (SELECT {columns} FROM {row} l, (VALUES {values}) v(k, n)) TO '{tmp_path}/lineitem.parquet' (FORMAT PARQUET)")
    con = oracle.connect(str(tmp_path))
    for name in ("rec_per_key", "ndv_prefix"):
        ok, said = oracle.same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLE[name])
        assert ok, f"{name}: {said}"


def test_records_per_key_of_no_rows(spark, sf_dir, tmp_path):
    oracle.duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/lineitem.parquet' LIMIT 0) TO '{tmp_path}/lineitem.parquet' (FORMAT PARQUET)")
    assert sorted(map(tuple, catalog.QUERIES["rec_per_key"](spark, str(tmp_path)).collect())) == [(1, None), (2, None)]
