"""Column plumbing shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Exactly the named columns, cast, whatever else the table carries.

    Names are taken as written (dots and case do not matter), so extra columns with clashing names inside an
    operator cannot shadow its own.
    """
    return df.select(*[df[f"`{name}`"].cast(kind).alias(name) for name, kind in kinds.items()])


def text_of(c: Column) -> Column:
    """Null text is empty text."""
    return F.coalesce(c, F.lit(""))
