"""Queries op1 to op13 and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import table, tokenizer_file


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.collision import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.line_dedup import removed_lines

    return removed_lines(table(spark, sf_dir, "documents"), 80, 100)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024, 2)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.sentencepieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.records import token_records

    return token_records(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.minhash import minhash_dedup

    return minhash_dedup(table(spark, sf_dir, "documents"), k=3, num=85, den=100, bands=24, rows=6)


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document, placed by its id: a word put in, seven characters taken out, four replaced."""
    from pyspark.sql import functions as F

    from corvane.llm.edit_counts import edited_counts

    docs = table(spark, sf_dir, "documents")
    place = "cast(pmod(xxhash64(coalesce(doc_id, 0), {}), length(coalesce(text, '')) + 1) as int)"
    edit = "named_struct('at', {}, 'cut', {}, 'text', '{}')"
    edits = ", ".join(edit.format(place.format(k), cut, text) for k, (cut, text) in enumerate(((0, " anew"), (7, ""), (4, "12 x"))))
    return edited_counts(docs.withColumn("edits", F.expr(f"array({edits})")), tokenizer_file("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.language import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.periodic import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), repeat=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
