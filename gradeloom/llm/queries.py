"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import labels, mixing, noise, packing, pairs, quality, spam, splitting, tokens, truncation
from gradeloom.session import checkpointed
from gradeloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.page_kinds(table(spark, folder, "ocr_lines"))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.page_scores(checkpointed(quality.page_statistics(table(spark, folder, "ocr_lines"))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.find_truncated(table(spark, folder, "ocr_lines"), table(spark, folder, "parsed_questions")).select("rec_table", "rec_id")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    lines, answers = table(spark, folder, "ocr_lines"), table(spark, folder, "parsed_questions")
    return truncation.truncation_rates(truncation.find_truncated(lines, answers), lines, answers)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return noise.find_noise(table(spark, folder, "ocr_lines"), table(spark, folder, "parsed_questions"))


def p3_pages(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "ocr_lines")
    return noise.repair_lines(lines, noise.noise_details(lines, table(spark, folder, "parsed_questions")))


def p3_answers(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "parsed_questions")
    return noise.repair_answers(answers, noise.noise_details(table(spark, folder, "ocr_lines"), answers))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return labels.resolve_labels(table(spark, folder, "parsed_questions"), table(spark, folder, "exam_questions"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "ocr_lines").select(F.lit("ocr_lines").alias("rec_table"), F.col("line_uid").alias("rec_id"), "text")
    chunks = table(spark, folder, "reference_chunks").select(F.lit("reference_chunks").alias("rec_table"), F.col("ref_id").alias("rec_id"), "text")
    return lines.unionByName(chunks)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(_items(spark, folder), table(spark, folder, "piece_limits")).select("rec_table", "rec_id", "fit").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(_items(spark, folder), table(spark, folder, "piece_limits"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "parsed_questions")
    exams = table(spark, folder, "exams").select("exam_id", "lang")
    counts = truncation.line_counts(table(spark, folder, "ocr_lines"))
    cut = truncation.find_truncated_answers(answers, counts).select(F.col("rec_id").alias("block_id"))
    return pairs.find_defects(answers.join(exams, "exam_id", "left").select("block_id", "question_text", "answer_text", "lang"), cut)


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    # Kept: the sizes are read more than once, and tokenizing is the cost.
    return checkpointed(tokens.document_sizes(table(spark, folder, "documents")))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    items = _sizes(spark, folder).select(F.col("doc_id").alias("item_id"), "n_tokens")
    return packing.pack_items(items, table(spark, folder, "container_specs"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder), table(spark, folder, "container_specs"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_shares(p8_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_rates, p3_found, p3_pages, p3_answers, p4_found, p5_found, p5_pieces, p6_found, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that plain SQL can express."""
    return {
        # The fit of an oversized record follows from its longest run alone, however the pieces are cut.
        "p5_found": r"""
            WITH items AS (
                SELECT DISTINCT 'ocr_lines' AS rec_table, line_uid AS rec_id, text FROM ocr_lines
                UNION ALL SELECT DISTINCT 'reference_chunks', ref_id, text FROM reference_chunks)
            SELECT DISTINCT rec_table, rec_id,
                   CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s.!?。।]+'), lambda x: length(x))) > max_chars
                        THEN 'forced' ELSE 'natural' END AS fit
            FROM items JOIN piece_limits USING (rec_table) WHERE length(text) > max_chars""",
    }
