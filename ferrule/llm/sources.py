"""Where the queries find their tables and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; read by Spark only, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)
