"""Corpus pipeline: toxicity, exact deduplication, near deduplication, packing.

Each stage works on all rows its predecessor kept. A stage is a function (spark, docs, sf_dir) -> DataFrame; all but
the last return the columns of docs. Decisions are joined to the rows by a row number written with them, so null and
repeated doc_ids are told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Tables, table, tokenizer_file
from corvane.llm.exact_dedup import exact_survivors
from corvane.llm.minhash import near_survivors
from corvane.llm.packing import pack
from corvane.llm.toxicity import score, train

TOKENIZER = "byte_bpe_50k.json"
ROW = "corvane_row"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model calls toxic go. One pass, no shuffle of texts."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, docs.columns, prefix="corvane_").filter(~F.col("corvane_toxic")).select(*(F.col(f"`{c}`") for c in docs.columns))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row. Written, so that every later read finds the same numbers."""
    return Tables(docs.sparkSession, "pipeline").write(docs.withColumn(ROW, F.monotonically_increasing_id()), f"{name}-rows")


def keep_rows(rows: DataFrame, survivors: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The numbered rows whose number is among the survivors' (row), without the number.

    The numbers of the others are counted: while they are few they are broadcast (8 bytes each) and the texts stay where
    they are; beyond that, rows and survivors meet by a shuffle."""
    kept = survivors.select(F.col("row").alias(ROW))
    gone = Tables(rows.sparkSession, "pipeline").write(rows.select(ROW).join(kept, ROW, "left_anti"), "gone")
    if gone.count() <= few:
        return rows.join(F.broadcast(gone), ROW, "left_anti").drop(ROW)
    return rows.join(kept, ROW, "left_semi").drop(ROW)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text the one with the largest doc_id stays, of several the first by row number."""
    rows = numbered(docs, "exact")
    return keep_rows(rows, exact_survivors(rows, ROW))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    rows = numbered(docs, "near")
    return keep_rows(rows, near_survivors(rows, ROW, k=5, num=80, den=100, bands=28, rows=5))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Executors that run all stages keep fewer pre-tokens, and none between tasks."""
    return pack(docs, tokenizer_file(TOKENIZER), 1024, 2, words=200_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained model, near duplicates and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
