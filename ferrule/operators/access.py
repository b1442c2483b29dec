"""Key and range access, as filters that reach the scan, ordered limits and semi joins.

A key is a tuple of typed columns and compares as one: nothing is encoded.  Nulls sort first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys up to this many go into the filter as literals; more of them become a semi join.
LITERAL_KEYS = 1000


def _equal(columns: Sequence[str], values: Sequence) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(columns, values)), F.lit(True))


def _beyond(columns: Sequence[str], values: Sequence, up: bool, inclusive: bool) -> Column:
    """(columns) > (values), or < them: column by column, so that the first column's bound reaches the scan."""
    c, v = F.col(columns[0]), F.lit(values[0])
    if len(values) == 1:
        return {(True, True): c >= v, (True, False): c > v, (False, True): c <= v, (False, False): c < v}[(up, inclusive)]
    outer = c >= v if up else c <= v
    return outer & ((c > v if up else c < v) | _beyond(columns[1:], values[1:], up, inclusive))


def _sorted(df: DataFrame, key: Sequence[str], reverse: bool) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in key])


def point(df: DataFrame, key: Sequence[str], values: Sequence) -> DataFrame:
    """The rows of one full key."""
    return df.where(_equal(key, values))


def points(df: DataFrame, key: str, values: Sequence | DataFrame) -> DataFrame:
    """The rows of many keys at once: literals while they are few, else a semi join; never one read a key."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(key)).distinct(), key, "left_semi")
    if len(values) <= LITERAL_KEYS:
        return df.where(F.col(key).isin(list(values)))
    keys = df.sparkSession.createDataFrame([(v,) for v in set(values)], df.select(key).schema)
    return df.join(keys, key, "left_semi")


def key_range(
    df: DataFrame, key: Sequence[str], start: Sequence | None = None, end: Sequence | None = None, limit: int | None = None,
    reverse: bool = False, keys_only: bool = False, after: bool = False,
) -> DataFrame:
    """Rows of start <= key < end in key order, or the reverse, at most ``limit`` of them.

    ``after`` leaves out every key that begins with ``start``.  ``keys_only`` reads no other column.
    """
    if start is not None:
        df = df.where(_beyond(key, start, up=True, inclusive=not after))
    if end is not None:
        df = df.where(_beyond(key, end, up=False, inclusive=False))
    df = _sorted(df.select(*key) if keys_only else df, key, reverse)
    return bounded(df, limit)


def bounded(df: DataFrame, limit: int | None) -> DataFrame:
    """LIMIT; counts beyond what Spark can express are no limit."""
    return df if limit is None or limit > 2**31 - 1 else df.limit(limit)


def secondary_range(df: DataFrame, index: Sequence[str], key: Sequence[str], start: Sequence, end: Sequence, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Rows of a range of a secondary index, by index, then by primary key."""
    return bounded(_sorted(df.where(_beyond(index, start, True, True)).where(_beyond(index, end, False, False)), [*index, *key], reverse), limit)


def prefix(df: DataFrame, key: Sequence[str], values: Sequence, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows whose key begins with ``values``, in key order."""
    return bounded(_sorted(df.where(_equal(key, values)), key, reverse), limit)


def previous(df: DataFrame, key: Sequence[str], values: Sequence, inclusive: bool = True) -> DataFrame:
    """The last row at or below a key."""
    return _sorted(df.where(_beyond(key, values, up=False, inclusive=inclusive)), key, True).limit(1)


def prefix_last(df: DataFrame, key: Sequence[str], values: Sequence, or_previous: bool = False) -> DataFrame:
    """The last row whose key begins with ``values``; with ``or_previous`` the last one below if there is none."""
    if not or_previous:
        return _sorted(df.where(_equal(key, values)), key, True).limit(1)
    return _sorted(df.where(_beyond(key, values, up=False, inclusive=True)), key, True).limit(1)


def first(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return _sorted(df, key, False).limit(1)


def tail(df: DataFrame, key: Sequence[str], n: int = 1) -> DataFrame:
    """The last n rows by key: a bounded top-n in every task, never a sort of the table."""
    return _sorted(df, key, True).limit(n)


def neighbours(df: DataFrame, key: str, partition: str, carry: Sequence[str]) -> DataFrame:
    """Cursor steps: each row's previous and next key among the rows of its partition."""
    from pyspark.sql import Window

    w = Window.partitionBy(partition).orderBy(key)
    return df.select(partition, key, *carry, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("following"))


def parallel_range(df: DataFrame, key: str, start: int, end: int, parts: int) -> DataFrame:
    """Rows of start <= key < end as ``parts`` scans of ranges of their own, each with its bounds pushed down."""
    cuts = [start + (end - start) * i // parts for i in range(parts + 1)]
    scans = [df.where((F.col(key) >= a) & (F.col(key) < b)) for a, b in zip(cuts, cuts[1:]) if a < b]
    return reduce(DataFrame.unionAll, scans) if scans else df.limit(0)


def next_same(df: DataFrame, index: Sequence[str], key: Sequence[str], at: Sequence) -> DataFrame:
    """The row after a cursor that stands at (index values, key), among those of the same index values."""
    same = df.where(_equal(index, at[: len(index)])).where(_beyond(key, at[len(index) :], up=True, inclusive=False))
    return _sorted(same, key, False).limit(1)


def reread(ids: DataFrame, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full rows of remembered keys, once for each."""
    return ids.select(*key).join(df, list(key))
