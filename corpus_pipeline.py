"""A corpus pipeline: quality, near duplicates, repeated passages, packing.

Every stage takes what the one before kept and returns the columns of documents, but for the last, which returns
packed pieces.  Between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.near_dup import deduplicated
from ferrule.llm.packing import pack
from ferrule.llm.quality import accepted
from ferrule.llm.sources import table, vocabulary
from ferrule.llm.store import keep
from ferrule.llm.suffix_dedup import remove_repeats

#: Stages learn, hash and pack: SQL cannot express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class of near duplicates."""
    return deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what is covered by strings of 200 bytes that start anywhere else too, by whole characters.

    Every row and every column stays; n_chars, where there is one, counts what is left.
    """
    own = {c.lower(): c for c in docs.columns}
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_chars")]
    more = "c" + "_" * max(map(len, docs.columns))  # a name that no column has
    d = docs.select("doc_id", "text", F.struct(F.lit(0).alias("no"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)]).alias(more))
    cut = remove_repeats(d, carry=(more,))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    made = {own[k]: c for k, c in made.items() if k in own} | {c: F.col(more)[f"c{i}"] for i, c in enumerate(others)}
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 4,096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
