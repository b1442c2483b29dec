"""Rules whose plain Spark meaning differs, at their boundaries."""

from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.functions import semantics
from ferrule.functions.typed import Refused, constant, field
from ferrule.operators import access, relational

WORDS = ["abc", "ABC", "Abc", "ábc", "abd", "ABD", "b", "ab", "abc ", "aBc", ""]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "id int, v string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_collation_equality_and_groups(words):
    v = semantics.ai_ci(F.col("v"))
    assert ids(words.where(v == "abc")) == [0, 1, 2, 3, 9]
    assert words.select(v.alias("v")).distinct().count() == 6  # trailing spaces count
    assert words.agg(F.countDistinct(v).alias("n")).first().n == 6


def test_like_insensitive(words):
    assert ids(words.where(semantics.like_ai_ci(F.col("v"), "A_c"))) == [0, 1, 2, 3, 9]
    assert ids(words.where(semantics.like_ai_ci(F.col("v"), "áB%"))) == [0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert ids(words.where(semantics.like(F.col("v"), "A_c"))) == [2]


def test_like_escapes(spark):
    df = spark.createDataFrame([(0, "a%b"), (1, "axb"), (2, "a\\b"), (3, "ab!")], "id int, v string")
    assert ids(df.where(semantics.like(F.col("v"), "a!%b", "!"))) == [0]
    assert ids(df.where(semantics.like(F.col("v"), "a!x!b", "!"))) == [1]  # before an ordinary character
    assert ids(df.where(semantics.like(F.col("v"), "ab!", "!"))) == [3]  # a last escape is literal
    assert ids(df.where(semantics.like(F.col("v"), "a\\\\b"))) == [2]


def test_ascii_is_a_byte(spark):
    df = spark.createDataFrame([("A",), ("Á",), ("",), (None,)], "v string")
    assert [r.x for r in df.select(semantics.ascii_byte(F.col("v")).alias("x")).collect()] == [65, 195, 0, None]


def test_zero_divisors(spark):
    df = spark.sql("select cast(1.50 as decimal(15,2)) a, 0 b, 7 c, 2 d")
    r = df.select((field(df, "a") / field(df, "b")).column.alias("x"), (field(df, "c") % field(df, "b")).column.alias("y"), (field(df, "c") / field(df, "d")).column.alias("z")).first()
    assert (r.x, r.y, r.z) == (None, None, Decimal("3.5000"))


@settings(max_examples=25, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(-(10**12), 10**12), st.integers(-(10**8), 10**8).filter(bool)), min_size=20, max_size=20))
def test_quotients_are_half_up(spark, pairs):
    df = spark.createDataFrame([(Decimal(a).scaleb(-2), Decimal(b).scaleb(-2)) for a, b in pairs], "a decimal(15,2), b decimal(15,2)")
    got = [r.q for r in df.select((field(df, "a") / field(df, "b")).column.alias("q")).collect()]
    for (a, b), q in zip(pairs, got):
        exact = Fraction(a, b) * 10**6
        rounded = int(abs(exact) + Fraction(1, 2)) * (1 if exact >= 0 else -1)
        assert q == Decimal(rounded).scaleb(-6)


def test_double_overflow_raises(spark):
    df = spark.sql("select cast(1e308 as double) x")
    with pytest.raises(Exception, match="out of range"):
        df.select((field(df, "x") * constant(10.0)).column).collect()


def test_refusals(spark):
    df = spark.sql("select cast(1 as decimal(20,2)) w, cast(1 as decimal(15,2)) d, 1.5D x, 2L b, date'2020-01-01' t, 's' s")
    f = {c: field(df, c) for c in df.columns}
    for bad in (
        lambda: f["x"].sum(), lambda: f["x"].avg(), lambda: f["w"].compare("<", f["x"]), lambda: f["b"].compare("=", f["x"]),
        lambda: (f["d"] / f["d"]).compare("<", f["x"]), lambda: f["s"] + f["s"], lambda: f["s"].compare("=", f["b"]),
    ):
        with pytest.raises(Refused):
            bad()
    assert f["d"].compare("<", f["x"]).kind == "bool"


def test_dates_meet_strings_as_moments(spark):
    df = spark.sql("select date'1996-01-02' t")
    t = field(df, "t")
    r = df.select(t.compare("<", constant("1996-01-02 12:00:00")).column.alias("a"), t.compare("=", constant("1996-01-02 12:00:00")).column.alias("b")).first()
    assert (r.a, r.b) == (True, False)


@pytest.mark.parametrize("sub", [[1, 3, None], [1, 3], []])
def test_in_is_three_valued(spark, sub):
    left = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, None])], "id int, x int")
    right = spark.createDataFrame([(v,) for v in sub], "y int")

    def expected(x):
        if not sub:
            return False
        if x is None:
            return None
        return True if x in sub else (None if None in sub else False)

    got = {r.id: (r.a, r.b) for r in relational.in_subquery(relational.in_subquery(left, "x", right, "y", "a"), "x", right, "y", "b", negated=True).collect()}
    for i, x in enumerate([1, 2, None]):
        e = expected(x)
        assert got[i] == (e, None if e is None else not e)


def test_empty_and_null_differ(spark):
    df = spark.createDataFrame([("",), (None,), ("",), ("x",)], "v string")
    assert {(r.v, r["count"]) for r in df.groupBy("v").count().collect()} == {("", 2), (None, 1), ("x", 1)}


def test_key_ranges(spark):
    rows = [(a, b) for a in range(4) for b in range(4)]
    df = spark.createDataFrame(rows, "a int, b int")
    key = ["a", "b"]
    got = lambda d: [tuple(r) for r in d.collect()]
    assert got(access.key_range(df, key, [1, 2], [3])) == [r for r in rows if (1, 2) <= r and r[0] < 3]
    assert got(access.key_range(df, key, [1], after=True)) == [r for r in rows if r[0] > 1]
    assert got(access.key_range(df, key, [1, 2], after=True, limit=2)) == [(1, 3), (2, 0)]
    assert got(access.previous(df, key, [2, 0], inclusive=False)) == [(1, 3)]
    assert got(access.prefix_last(df, key, [9], or_previous=True)) == [(3, 3)]
    assert got(access.prefix_last(df, key, [9])) == []
    assert access.key_range(df, key, limit=2**64 - 1).count() == 16


def test_many_keys_become_a_semi_join(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert access.points(df, "k", list(range(0, 9000, 2))).count() == 2500
