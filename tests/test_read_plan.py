import pytest

from ferrule.functions.typed import Refused
from ferrule.plans.read_plan import ReadPlan, Table, parse


@pytest.fixture(scope="module")
def plan(spark):
    stock = spark.createDataFrame([(w, i, 10 * i + w) for w in (1, 2) for i in (5, 10, 15)], "w_id int, i_id int, quantity int")
    orders = spark.createDataFrame([(1, 5), (2, 10), (3, 99), (4, 5)], "o_id int, i_id int")
    return ReadPlan({"stock": Table(stock, ["w_id", "i_id"]), "orders": Table(orders, ["o_id"], {"by_item": ["i_id"]})})


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_point_range_and_limits(plan):
    a, b, c = plan.run("R:stock:1:10;S:stock:1:10:E:2:10;S:orders:2:E:9:limit=2:reverse=1")
    assert rows(a) == [(1, 10, 101)]
    assert rows(b) == [(1, 10, 101), (1, 15, 151), (2, 5, 52)]
    assert rows(c) == [(4, 5), (3, 99)]


def test_for_each_takes_distinct_keys(plan):
    _, got = plan.run("S:orders:0:E:100;FE:stock:1:B0.CI1")
    assert sorted(rows(got)) == [(1, 5, 51), (1, 10, 101)]


def test_bound_rows(plan):
    _, first, middle = plan.run("S:orders:1:E:4;R:orders:B0.CI0+1;R:orders:B0.MCI0")
    assert rows(first) == [(2, 10)]
    assert rows(middle) == [(2, 10)]
    assert rows(plan.run("R:orders:77;R:stock:1:B0.CI1")[1]) == []


def test_secondary_index(plan):
    assert rows(plan.run("SI:orders:by_item:5")[0]) == [(1, 5), (4, 5)]


@pytest.mark.parametrize("text", ["X:orders:1", "R:orders:B0.V.0.4", "R:nowhere:1", "SI:orders:none:1", "R:orders:B3.CI0"])
def test_refused(plan, text):
    with pytest.raises(Refused):
        plan.run(text)


def test_parse_keeps_order():
    s = parse("SI:t:i:1:2t:E:3:limit=0:reverse=0;")
    assert (s[0].index, s[0].start, s[0].end, s[0].limit, s[0].reverse) == ("i", ["1", "2t"], ["3"], None, False)
