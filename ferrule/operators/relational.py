"""Relational operators whose three-valued logic plain Spark does not keep in projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_subquery(df: DataFrame, x: str, sub: DataFrame, y: str, name: str, negated: bool = False) -> DataFrame:
    """df with the column ``name``: x [NOT] IN (sub.y), true, false or unknown.

    Unknown when x is null and the subquery has rows, or x is not found and it has a null.  The subquery is reduced
    to its distinct keys and two counts of one row, so neither side is multiplied.
    """
    keys = sub.select(F.col(y).alias("__k")).where("__k is not null").distinct().withColumn("__hit", F.lit(True))
    facts = sub.agg(F.count("*").alias("__n"), F.count_if(F.col(y).isNull()).alias("__nulls"))
    both = df.join(keys, F.col(x) == F.col("__k"), "left").join(F.broadcast(facts))  # a row of two counts
    unknown = (F.col(x).isNull() & (F.col("__n") > 0)) | (F.col("__nulls") > 0)
    found: Column = F.when(F.col("__hit"), True).when(unknown, None).otherwise(False)
    return both.withColumn(name, ~found if negated else found).drop("__k", "__hit", "__n", "__nulls")


def is_true(c: Column) -> Column:
    """IS TRUE: unknown is false."""
    return F.coalesce(c, F.lit(False))


def exists(df: DataFrame, sub: DataFrame, on, negated: bool = False) -> DataFrame:
    """Rows with, or without, a match."""
    return df.join(sub, on, "left_anti" if negated else "left_semi")


def anti_in(df: DataFrame, x: str, sub: DataFrame, y: str) -> DataFrame:
    """Rows where x NOT IN (sub.y) is true: none if the subquery has a null, all if it is empty."""
    marked = in_subquery(df, x, sub, y, "__in", negated=True)
    return marked.where("__in").drop("__in")


def theta(left: DataFrame, right: DataFrame, low: tuple[str, str], high: tuple[str, str], width: int) -> DataFrame:
    """left.a >= right.low and left.a < right.high over whole numbers, where high - low is at most ``width``.

    A range join by buckets: an interval meets two buckets of its greatest width at most, so rows are joined by
    equality and no side is paired with all of the other.
    """
    (a, lo), (_, hi) = low, high
    slot = lambda c: F.floor(c / F.lit(width)).cast("long")
    wide = right.withColumn("__b", F.explode(F.sequence(slot(F.col(lo)), slot(F.col(hi)))))
    return left.withColumn("__b", slot(F.col(a))).join(wide, "__b").where((F.col(a) >= F.col(lo)) & (F.col(a) < F.col(hi))).drop("__b")


_OPPOSITE = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "=": "<>", "<>": "="}


def quantified(left: DataFrame, x: str, op: str, right: DataFrame, y: str, out: str, all_of: bool, on: tuple[str, str] | None = None) -> DataFrame:
    """``left`` with ``out``: x op ANY (y) or x op ALL (y) over the rows of ``right`` (of one key if ``on`` names columns of both).

    Three-valued: nothing to compare with makes ANY false and ALL true; a null, where no other value decides, null.
    Only extremes and counts of the right side meet the left one, so no pairs are made.
    """
    facts = [F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.count("*").alias("_n"), F.count(y).alias("_known")]
    sums = right.groupBy(F.col(on[1]).alias("_k")).agg(*facts) if on else right.agg(*facts)
    both = left.join(sums, left[on[0]] == sums["_k"], "left").drop("_k") if on else left.crossJoin(sums)
    c, lo, hi, known = F.col(x), F.col("_lo"), F.col("_hi"), F.coalesce("_known", F.lit(0))

    def some(o: str):  # whether any known value compares so
        one = {">": c > lo, ">=": c >= lo, "<": c < hi, "<=": c <= hi, "<>": (c != lo) | (c != hi)}
        if o not in one:
            raise ValueError("= ANY is IN, <> ALL is NOT IN")
        return one[o]

    wanted = some(_OPPOSITE[op] if all_of else op)
    decided, otherwise = (F.lit(False), F.lit(True)) if all_of else (F.lit(True), F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    value = F.when(n == 0, otherwise).when((known > 0) & wanted, decided).when(c.isNull() | (known < n), F.lit(None)).otherwise(otherwise)
    return both.withColumn(out, value).drop("_lo", "_hi", "_n", "_known")
