"""Table definitions: column types, hidden keys, secondary indexes, loading for analysis."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.typed import Refused

#: Widest cell of a text or binary column, in bytes.
CELL = 2048
_INTS = {"tinyint": 1, "smallint": 2, "mediumint": 4, "int": 4, "integer": 4, "bigint": 8}


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared column type; unsigned and text-like numbers keep their full range."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*(unsigned|zerofill)?.*", declared.strip().lower())
    if not m:
        raise Refused(f"type {declared}")
    name, args, sign = m[1], [a.strip() for a in (m[2] or "").split(",") if a.strip()], m[3]
    if name in _INTS:
        if sign:
            return T.DecimalType(20, 0) if name == "bigint" else T.LongType()
        return T.LongType() if name == "bigint" else T.IntegerType()
    if name in ("decimal", "numeric"):
        digits, scale = int(args[0]) if args else 10, int(args[1]) if len(args) > 1 else 0
        return T.DecimalType(min(digits, 38), min(scale, 38))
    if name in ("double", "float", "real"):
        return T.FloatType() if name == "float" else T.DoubleType()
    if name in ("char", "varchar", "text", "tinytext", "enum", "set", "time", "year", "json"):
        return T.StringType()
    if name in ("binary", "varbinary", "blob", "tinyblob"):
        return T.BinaryType()
    if name == "date":
        return T.DateType()
    if name in ("datetime", "timestamp"):
        return T.TimestampNTZType()
    if name in ("bool", "boolean"):
        return T.BooleanType()
    raise Refused(f"type {declared}")


def width(declared: str) -> int:
    """Bytes that a cell may take."""
    m = re.match(r"\s*(\w+)\s*(?:\((\d+))?", declared.lower())
    name, n = m[1], int(m[2] or 1)
    if name in _INTS:
        return _INTS[name]
    if name in ("char", "varchar", "enum", "set"):
        return 4 * n
    return {"tinytext": 255, "tinyblob": 255, "text": 65_535, "blob": 65_535, "json": 65_535}.get(name, n if name in ("binary", "varbinary") else 16)


@dataclass
class Definition:
    """A table as declared; a definition never changes."""

    name: str
    columns: dict[str, str]
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)

    def __post_init__(self):
        wide = [c for c, t in self.columns.items() if width(t) > CELL]
        if wide:
            raise Refused("cells wider than %d bytes: %s" % (CELL, ", ".join(wide)))
        missing = [c for c in [*self.key, *sum(self.unique, [])] if c not in self.columns]
        if missing:
            raise Refused("keys over unknown columns: " + ", ".join(missing))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, spark_type(t), c not in self.key) for c, t in self.columns.items()])


class Catalog:
    """Definitions by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def create(self, d: Definition) -> None:
        """Creating a table again is fine, as long as nothing about it differs."""
        if self.tables.setdefault(d.name, d) != d:
            raise Refused(f"table {d.name} exists with another definition")

    def load(self, name: str, rows: DataFrame) -> None:
        """Make a table's rows known to SQL under its name; nothing is copied."""
        expected = {f.name: f.dataType for f in self.tables[name].schema()}
        found = {f.name: f.dataType for f in rows.schema}
        if expected != found:
            raise Refused(f"rows of table {name} have other columns than declared")
        rows.createOrReplaceTempView(name)

    def unload(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)


def with_hidden_key(rows: DataFrame, watermark: int = -1, name: str = "hidden_key") -> DataFrame:
    """Unique ids above a watermark, without a global order: each task numbers its rows in a range of its own.

    Write the result before using it twice: ids are made when it is computed.
    """
    return rows.withColumn(name, F.monotonically_increasing_id() + F.lit(watermark + 1))


def index(rows: DataFrame, columns: Sequence[str], key: Sequence[str], partitions: int | None = None) -> DataFrame:
    """A secondary index as a table of (columns, key), in ranges of the columns and sorted inside each."""
    keys = rows.select(*columns, *key)
    dealt = keys.repartitionByRange(partitions, *columns) if partitions else keys.repartitionByRange(*columns)
    return dealt.sortWithinPartitions(*columns, *key)
