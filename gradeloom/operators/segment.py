"""Question blocks of a document: written labels as heads, and the lines between them as bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.labels import LABEL_WORDS, canonical_label, label_parts
from gradeloom.functions.marks import extract_marks, looks_like_question, strip_marks
from gradeloom.functions.scans import label_of
from gradeloom.functions.text import normalize_text

#: Normalised characters under which a question with parts has no answer of its own.
LEAST_OWN_ANSWER = 12


def question_heads(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, line_index, page, kind, label, raw, main, rest: the lines that open with a question label.

    lines: doc_id, line_index, page, text. known: doc_id, keys (label keys that
    the document's exam has). kind is main for a number, sub for another single
    level and combined for more than one.
    """
    with_keys = lines.join(known.select("doc_id", "keys"), "doc_id", "left") if known is not None else lines.withColumn("keys", F.lit(None).cast("array<string>"))
    # A label opens with a bracket, a digit, a lead word, or a Roman numeral or letter of its own; the scanner sees no other lines.
    opened = with_keys.where(F.col("text").rlike(rf"(?i)^\s*(?:[\(\[]|\d|(?:{'|'.join(LABEL_WORDS)}|[ivx]{{1,6}}|[a-z])(?![A-Za-z]))"))
    read = opened.withColumn("hit", label_of(F.col("text"), F.col("keys"))).where("hit is not null")
    parts = label_parts(F.col("hit.label"))
    first = F.try_element_at(parts, F.lit(1))
    numeric = first.rlike(r"^\d+$")
    kind = F.when(F.size(parts) > 1, "combined").when(numeric, "main").otherwise("sub")
    return read.where(F.size(parts) > 0).select(
        "doc_id", "line_index", "page", kind.alias("kind"), canonical_label(F.col("hit.label")).alias("label"),
        F.col("hit.label").alias("raw"), F.when(numeric, first).alias("main"), F.col("hit.rest").alias("rest"),
    )


def _strip_label(text: Column, label: Column) -> Column:
    quoted = F.regexp_replace(label, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)^\s*\(?"), quoted, F.lit(r"\)?\s*[.)-]?\s*")), F.lit(""))


def question_blocks(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, head_index, question_number, question_text, answer_text, answer_line_ids, max_marks, page_start, page_end, parent_number.

    A block runs from its head to the line before the next one. A head that
    reads like a question is the question, else the text behind the label opens
    the answer. A bare part takes the number of the last head that had one. A
    question with parts and next to no answer of its own is left out.
    """
    heads = question_heads(lines, known)
    by_place = Window.partitionBy("doc_id").orderBy("line_index")
    until_here = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.join(heads.drop("page"), ["doc_id", "line_index"], "left").withColumn("head_index", F.max(F.when(F.col("kind").isNotNull(), F.col("line_index"))).over(until_here))
    body = marked.where("head_index is not null")
    is_head = F.col("line_index") == F.col("head_index")
    asks = looks_like_question(F.col("rest"))
    kept = body.withColumn("asks", F.max(F.when(is_head, asks)).over(Window.partitionBy("doc_id", "head_index")))
    in_answer = ~(is_head & F.col("asks"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(in_answer, F.struct("line_index", F.col(c).alias("v"))))), lambda x: x["v"])
    blocks = kept.groupBy("doc_id", "head_index").agg(
        *(F.max(F.when(is_head, F.col(c))).alias(c) for c in ("kind", "label", "raw", "main", "rest", "asks")),
        F.max(F.when(is_head, F.col("text"))).alias("head_text"),
        F.array_join(ordered("text"), "\n").alias("body"), ordered("line_id").alias("answer_line_ids"),
        F.min("page").alias("page_start"), F.max_by("page", "line_index").alias("page_end"),
    )
    by_head = Window.partitionBy("doc_id").orderBy("head_index").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.last("main", ignorenulls=True).over(by_head)).withColumn("main_label", F.last(F.when(F.col("kind") == "main", F.col("label")), ignorenulls=True).over(by_head))
    is_part = (F.col("kind") == "sub") & F.col("carried").isNotNull()
    number = F.when(is_part, F.concat("carried", F.lit("("), "label", F.lit(")"))).otherwise(F.col("label"))
    answer = F.when(F.col("asks"), F.col("body")).otherwise(_strip_label(F.col("body"), F.col("raw")))
    result = carried.select(
        "doc_id", "head_index", number.alias("question_number"), F.when(F.col("asks"), strip_marks(F.col("rest"))).otherwise("").alias("question_text"),
        answer.alias("answer_text"), "answer_line_ids", F.coalesce(extract_marks(F.col("rest")), extract_marks(F.col("head_text"))).alias("max_marks"),
        "page_start", "page_end", F.when(is_part, F.col("main_label")).alias("parent_number"), "kind", "label",
    )
    # A main head stays the parent until the next one, so its parts are the blocks between.
    with_parts = result.withColumn("owner", F.last(F.when(F.col("kind") == "main", F.col("head_index")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("head_index")))
    family = with_parts.withColumn("n_parts", F.count("parent_number").over(Window.partitionBy("doc_id", "owner")))
    empty_parent = (F.col("kind") == "main") & (F.col("n_parts") > 0) & (F.char_length(normalize_text(F.col("answer_text"))) < LEAST_OWN_ANSWER)
    return family.where(~empty_parent).drop("kind", "label", "owner", "n_parts")


def structural_marks(blocks: DataFrame) -> DataFrame:
    """doc_id, question_number, marks: printed marks of each block, the last of a number counting."""
    marks = F.coalesce("max_marks", extract_marks(F.col("question_text")), extract_marks(F.col("answer_text")))
    return blocks.withColumn("m", marks).where("m is not null").groupBy("doc_id", "question_number").agg(F.max_by("m", "head_index").alias("marks"))


def numbered_sections(blocks: DataFrame) -> DataFrame:
    """doc_id, head_index, label, text: each block of a reference text as a section; sections without text are left out."""
    text = F.trim(F.concat_ws("\n", "question_text", "answer_text"))
    return blocks.select("doc_id", "head_index", F.col("question_number").alias("label"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")).where("text <> '' and label <> ''")
