"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, token files.

Every stage takes null in any column, empty and very long texts, repeated rows and tables without rows; what it
does with them is said at each. Columns other than ``COLUMNS`` are not passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.decontaminate import drop_leaks
from loomgrid.llm.mixing import mixed_rows
from loomgrid.llm.queries import MIX_SEED, SOURCE_CAP, SOURCE_WEIGHTS, TOKENIZER, TOXIC_FROM, table, tokenizer_path
from loomgrid.llm.simhash import drop_near_duplicates
from loomgrid.llm.token_files import token_table
from loomgrid.llm.toxicity import drop_toxic
from loomgrid.scratch import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of ``labels`` rates toxic go.

    Null texts are rated like empty ones, repeated rows alike, rows without an id like others.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"), TOXIC_FROM).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles are 0.8 similar or more to a document that stays go.

    Null texts equal empty ones. Rows without an id stay. ``doc_id`` is the key of ``documents``: where ids repeat all
    the same, one row of each stays in the end, that whose text sorts first.
    """
    kept = drop_near_duplicates(docs.select(*COLUMNS), width=5, similarity=0.8)
    ids = docs.select("doc_id").filter("doc_id is not null")
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), "lang", "source", "n_chars"))
    named = kept.filter("doc_id is not null").withColumn("__place", first).filter("__place = 1").select(*COLUMNS)
    return named.unionByName(kept.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go; null and empty texts stay, repeated rows share their fate."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; one taken twice has two rows.

    A null source is a source of its own; documents without words weigh nothing.
    """
    return mixed_rows(docs, SOURCE_WEIGHTS, SOURCE_CAP, MIX_SEED).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; the result has one row a document, read back from the files.

    Null and empty texts are the end id alone; rows without an id come first.
    """
    return token_table(docs, tokenizer_path(TOKENIZER)).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token files", token_stage),
]

#: Trained classifiers, components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
