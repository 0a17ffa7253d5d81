"""The queries of the engine by name: each applies operators to whole tables.

The tables of papers serve where they have what an operator reads; order lines
stand in for marked questions, events for requests, embeddings for vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import labels, marks, scans, text
from gradeloom.operators import align, assess, budget, choice, exam, images, lines, match, model, placement, replies, report, retrieval, review, segment, stages
from gradeloom.plans import oracle
from gradeloom.session import checkpointed, shared_folder
from gradeloom.sources import files
from gradeloom.sources.tables import table
from gradeloom.streaming import trace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    """All queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}


# ---- inputs -----------------------------------------------------------------


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """exam_id, question_id, ord, number, text, max_marks of every printed question."""
    q = table(spark, folder, "exam_questions")
    return q.select("exam_id", "question_id", F.substring("question_id", 2, 9).cast("int").alias("ord"), F.col("q_number").alias("number"), F.col("q_text").alias("text"), "max_marks")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, query: the different texts of questions."""
    return table(spark, folder, "exam_questions").where("q_text is not null").groupBy(F.col("q_text").alias("query")).agg(F.min(F.struct("exam_id", F.substring("question_id", 2, 9).cast("int").alias("o"))).alias("m")).select((F.col("m.exam_id") * 1000 + F.col("m.o")).alias("query_id"), "query")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id, text of the reference passages."""
    return table(spark, folder, "reference_chunks").where("text is not null").select(F.col("chunk_key").alias("chunk_id"), "text")


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines once each: paper_id, exam_id, source, line_id, page, line_index, text, start_char, end_char, confidence, bbox."""
    return table(spark, folder, "ocr_lines").dropDuplicates(["line_uid"])


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks once each."""
    return table(spark, folder, "parsed_questions").dropDuplicates(["block_id"])


def mark_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as marked questions: paper_id, question_id, ord, number, max_marks, marks_awarded, skipped, failed, confidence, group_id."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    skipped = F.col("l_discount") == 0
    return l.withColumn("ord", F.row_number().over(order)).select(
        F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("q"), "ord").alias("question_id"), "ord", F.col("ord").cast("string").alias("number"),
        F.lit(40.0).alias("max_marks"), F.when(F.col("l_tax") != F.lit(0.08), F.col("l_quantity")).alias("marks_awarded"), skipped.alias("skipped"),
        (~skipped & (F.col("l_tax") == 0)).alias("failed"), F.round(F.col("l_tax") * 1000 + 25, 0).alias("confidence"), F.col("l_linestatus").alias("group_id"),
    )


def choice_groups(rows: DataFrame, required: int = 2) -> DataFrame:
    """Any two of each status of a paper."""
    return rows.select("paper_id", "group_id", F.lit(required).alias("required"), "number", F.col("ord").alias("member_ord"))


def counted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """mark_rows, clamped, with `counted`."""
    # Kept: the marks are read as rows, as members of their groups, and to be ranked.
    rows = checkpointed(assess.clamped_marks(mark_rows(spark, folder)))
    return choice.counted_marks(rows, choice.rank_choice(rows, choice_groups(rows)))


def status_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with the status of their answers; a paper with unclaimed writing may hold undetected ones."""
    b = blocks(spark, folder)
    writing = unassigned_writing(spark, folder).select("paper_id", "has_unassigned_writing")
    joined = b.join(writing, "paper_id", "left").withColumn("confidence", F.pmod(F.col("block_id") * 37, F.lit(101)).cast("double"))
    failed = F.pmod("block_id", F.lit(97)) == 0
    skipped = marks.is_too_short(F.col("answer_text"), F.col("max_marks"))
    status = marks.answer_status(failed, skipped, F.col("answer_text"), F.col("confidence"), F.coalesce("has_unassigned_writing", F.lit(False)))
    return joined.select("paper_id", "block_id", status.alias("status"), skipped.alias("skipped"), failed.alias("failed"), "confidence", (F.pmod("block_id", F.lit(5)) != 0).alias("counted"))


# ---- text -------------------------------------------------------------------


@query
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.bm25_top(asked(spark, folder), passages(spark, folder), 3)
    return found.select("query_id", "rk", "chunk_id", F.round("score", 6).alias("score"))


@query
def retrieval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    q, p = asked(spark, folder), passages(spark, folder)
    return retrieval.evidence_coverage(q, retrieval.bm25_top(q, p, 3), p).withColumn("coverage", F.round("coverage", 9))


@query
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query
def tokenize_stem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.tokenize(F.col("text")), " ").alias("stems"))


@query
def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.term_frequencies(passages(spark, folder))


@query
def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.document_frequencies(table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@query
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("block_id", F.round(text.token_overlap(F.col("question_text"), F.col("answer_text")), 9).alias("overlap"))


@query
def djb2_hash(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", text.djb2(F.col("query")).alias("hash"))


@query
def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query
def prefix_candidates(spark: SparkSession, folder: str) -> DataFrame:
    each = asked(spark, folder).select("query_id", F.posexplode(text.prefix_candidates(text.normalize_text(F.col("query")))).alias("place", "candidate"))
    return each.select("query_id", "place", "candidate")


@query
def split_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_chunks").select("ref_id", F.inline(scans.sentences(F.col("text"))))


@query
def span_exact(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder).where("question_text is not null and answer_text is not null and question_text <> ''")
    at = F.position(F.col("question_text"), F.col("answer_text"))
    return b.where(at > 0).select("block_id", (at - 1).cast("int").alias("start"), (at - 1 + F.char_length("question_text")).cast("int").alias("end"))


@query
def find_spans(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("block_id", scans.span_of(F.col("answer_text"), F.col("question_text")).alias("s")).where("s is not null").select("block_id", "s.*")


@query
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.chunk_documents(table(spark, folder, "documents").select("doc_id", "source", "text"))


# ---- labels and marks -------------------------------------------------------


@query
def label_keys(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("block_id", labels.label_key(F.col("question_number")).alias("key"), labels.canonical_label(F.col("question_number")).alias("shown"))


@query
def exam_label_keys(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("exam_id", "question_id", labels.label_key(F.col("number")).alias("key"), labels.canonical_label(F.col("number")).alias("shown"))


@query
def extract_marks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("block_id", marks.extract_marks(F.col("question_text")).alias("marks"))


@query
def strip_marks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("block_id", marks.strip_marks(F.col("question_text")).alias("stripped"))


@query
def question_type(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("exam_id", "question_id", marks.classify_question(F.col("text"), F.col("max_marks")).alias("type"))


@query
def marks_fallback_type(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", marks.classify_question(F.col("p_name"), F.col("p_size").cast("double")).alias("type"))


@query
def question_criteria(spark: SparkSession, folder: str) -> DataFrame:
    typed = questions(spark, folder).select("exam_id", "question_id", marks.classify_question(F.col("text"), F.col("max_marks")).alias("type"))
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", "n", F.size(marks.criteria_for(F.col("type"))).alias("n_criteria"), F.array_join(marks.criteria_for(F.col("type")), "; ").alias("criteria"))


@query
def question_shape(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("block_id", marks.looks_like_question(F.col("question_text")).alias("asks"), marks.is_too_short(F.col("answer_text"), F.col("max_marks")).alias("too_short"))


@query
def json_number_coerce(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", marks.coerce_number(F.col("props")).alias("strict"), marks.coerce_number(F.col("event_type"), strict=False).alias("loose"))


# ---- lines ------------------------------------------------------------------


@query
def structure_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = page_lines(spark, folder).groupBy(F.col("paper_id").alias("doc_id"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return lines.structure_pages(pages).withColumn("confidence", F.round("confidence", 6))


@query
def line_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return page_lines(spark, folder).select("line_uid", F.round(marks.line_confidence(F.col("text")), 6).alias("confidence"))


@query
def paper_quality(spark: SparkSession, folder: str) -> DataFrame:
    q = lines.document_quality(page_lines(spark, folder), "paper_id")
    return q.select("paper_id", F.round("score", 10).alias("score"), F.round("illegible_ratio", 10).alias("illegible_ratio"), F.round("short_line_ratio", 10).alias("short_line_ratio"), F.array_join("flags", ",").alias("flags"))


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select(F.col("block_id").alias("answer_id"), "paper_id", F.explode("answer_line_ids").alias("line_id"))


@query
def lines_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return lines.lines_to_text(_wanted(spark, folder), page_lines(spark, folder), ["paper_id"])


@query
def span_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = _wanted(spark, folder).join(page_lines(spark, folder).select("paper_id", "line_id", "start_char", "end_char"), ["paper_id", "line_id"])
    spans = found.groupBy("answer_id", "paper_id").agg(F.min("start_char").alias("span_start"), F.max("end_char").alias("span_end"))
    return lines.lines_for_span(spans, page_lines(spark, folder).select("paper_id", "line_uid", "start_char", "end_char"), "paper_id").select("answer_id", "line_uid")


@query
def answer_line_offsets(spark: SparkSession, folder: str) -> DataFrame:
    answer_lines = _wanted(spark, folder).distinct().join(page_lines(spark, folder).select("paper_id", "line_id", "line_index", "text"), ["paper_id", "line_id"])
    return lines.answer_line_offsets(answer_lines).select("answer_id", "line_id", "line_start", "line_end")


@query
def unclaimed_lines(spark: SparkSession, folder: str) -> DataFrame:
    free = lines.unclaimed_lines(page_lines(spark, folder), _wanted(spark, folder).select("paper_id", "line_id"), ["paper_id"])
    return free.select("line_uid", "paper_id", "line_id")


@query
def unassigned_writing(spark: SparkSession, folder: str) -> DataFrame:
    free = lines.unclaimed_lines(page_lines(spark, folder), _wanted(spark, folder).select("paper_id", "line_id"), ["paper_id"])
    return lines.unassigned_writing(free, "paper_id")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return page_lines(spark, folder).select(F.col("paper_id").alias("doc_id"), "line_id", "line_index", "page", "text")


@query
def question_heads(spark: SparkSession, folder: str) -> DataFrame:
    keys = questions(spark, folder).groupBy("exam_id").agg(F.array_sort(F.collect_set(labels.label_key(F.col("number")))).alias("keys"))
    known = table(spark, folder, "papers").select(F.col("paper_id").alias("doc_id"), "exam_id").distinct().join(keys, "exam_id").select("doc_id", "keys")
    return segment.question_heads(_docs(spark, folder), known)


@query
def question_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = segment.question_blocks(_docs(spark, folder))
    return b.withColumn("answer_line_ids", F.array_join("answer_line_ids", ","))


@query
def structural_marks(spark: SparkSession, folder: str) -> DataFrame:
    return segment.structural_marks(segment.question_blocks(_docs(spark, folder)))


# ---- exams ------------------------------------------------------------------


def _rule_choice(q: DataFrame) -> DataFrame:
    """Any half of the parts of a question, rounded up: a choice of its own for each exam."""
    parts = q.withColumn("head", F.regexp_extract("number", r"^\d+", 0)).where("head <> '' and head <> number")
    members = parts.groupBy("exam_id", "head").agg(F.count_distinct("number").alias("n"))
    return parts.select("exam_id", "head", "number").distinct().join(members, ["exam_id", "head"]).select("exam_id", F.col("head").alias("group_id"), F.ceil(F.col("n") / 2).cast("int").alias("required"), "number")


@query
def exam_derived_marks(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder)
    return exam.derive_marks(q, _rule_choice(q), table(spark, folder, "exams").select("exam_id", "declared_total"))


@query
def exam_duplicate_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return exam.duplicate_numbers(questions(spark, folder))


@query
def exam_validated(spark: SparkSession, folder: str) -> DataFrame:
    printed = questions(spark, folder).where("ord % 3 = 0").groupBy("exam_id", "number").agg(F.max("ord").cast("double").alias("marks"))
    return exam.validated_questions(questions(spark, folder), printed).drop("read", "printed")


@query
def allocate_marks(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "exams").select("exam_id", F.floor("declared_total").cast("bigint").alias("total"))
    return exam.allocate_marks(questions(spark, folder).join(totals, "exam_id").select("exam_id", "question_id", "ord", "max_marks", "total"))


# ---- choice and totals ------------------------------------------------------


@query
def choice_best_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    return choice.rank_choice(rows, choice_groups(rows)).select("paper_id", "question_id", "group_id", "rank", "kept")


@query
def choice_first_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    return choice.rank_choice(rows, choice_groups(rows), prefer="first").select("paper_id", "question_id", "group_id", "rank", "kept")


@query
def choice_dropped(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    return choice.dropped_questions(choice.rank_choice(rows, choice_groups(rows)))


@query
def choice_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    return choice.choice_totals(choice.counted_marks(rows, choice.rank_choice(rows, choice_groups(rows))))


@query
def paper_totals(spark: SparkSession, folder: str) -> DataFrame:
    return assess.paper_totals(counted_rows(spark, folder)).withColumn("percentage", F.round("percentage", 6))


@query
def grade_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return assess.paper_totals(counted_rows(spark, folder)).groupBy("grade").agg(F.count(F.lit(1)).alias("n_papers"), F.round(F.avg("percentage"), 4).alias("mean_percentage"))


@query
def point_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = assess.clamped_marks(mark_rows(spark, folder))
    return rows.groupBy("paper_id", marks.point_quality(F.col("marks_awarded"), F.col("max_marks")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query
def pending_marks(spark: SparkSession, folder: str) -> DataFrame:
    return assess.pending_marks(counted_rows(spark, folder).withColumn("overridden", F.col("ord") % 4 == 0))


@query
def answer_status(spark: SparkSession, folder: str) -> DataFrame:
    return status_rows(spark, folder).select("block_id", "status")


@query
def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return assess.coverage_summary(status_rows(spark, folder))


@query
def attention_list(spark: SparkSession, folder: str) -> DataFrame:
    return assess.attention_list(status_rows(spark, folder)).select("paper_id", "block_id", "status")


@query
def review_issues(spark: SparkSession, folder: str) -> DataFrame:
    return assess.review_issues(status_rows(spark, folder))


@query
def collect_points(spark: SparkSession, folder: str) -> DataFrame:
    return assess.collect_points(blocks(spark, folder).select("paper_id", F.col("block_id").alias("ord"), F.col("question_text").alias("point")))


def _annotations(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    kind = F.element_at(F.array(*map(F.lit, ("correct", "partial", "wrong", "missing"))), (F.col("ord") % 4 + 1).cast("int"))
    return rows.select(F.col("paper_id").alias("question_key"), F.col("ord").alias("ann_ord"), kind.alias("type"), F.when(F.col("skipped"), F.col("marks_awarded")).alias("marks"), F.lit(30.0).alias("awarded"), F.when(~F.col("failed"), F.col("confidence")).alias("confidence"))


@query
def annotation_marks(spark: SparkSession, folder: str) -> DataFrame:
    return assess.consistent_annotation_marks(_annotations(spark, folder)).select("question_key", "ann_ord", "fixed_marks")


@query
def question_confidence(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    asked_of = o.select(F.col("o_orderkey").alias("question_key"), F.when(F.col("o_orderstatus") != "P", F.lit(70.0)).alias("detection"), F.when(F.col("o_orderstatus") == "F", "INSUFFICIENT").otherwise("REFERENCE").alias("grounding"), (F.col("o_orderkey") % 7 != 0).alias("relevant"))
    return assess.question_confidence(_annotations(spark, folder), asked_of)


def _cited(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # Kept: it is cited from, and what is cited is held against it.
    evidence = checkpointed(bm25_topk(spark, folder).select(F.col("query_id").alias("question_key"), "chunk_id", "rk"))
    odd = F.when(F.col("question_key") % 3 == 0, F.concat("chunk_id", F.lit("?"))).otherwise(F.col("chunk_id"))
    return evidence, evidence.where("rk <= 2").select("question_key", F.col("rk").alias("ann_ord"), odd.alias("evidence_id"))


@query
def citation_check(spark: SparkSession, folder: str) -> DataFrame:
    evidence, annotations = _cited(spark, folder)
    return assess.checked_citations(annotations, evidence)


@query
def grounding(spark: SparkSession, folder: str) -> DataFrame:
    evidence, annotations = _cited(spark, folder)
    reported = asked(spark, folder).select(F.col("query_id").alias("question_key"), F.when(F.col("query_id") % 2 == 0, "REFERENCE").otherwise("GENERAL").alias("reported"))
    return assess.resolved_grounding(reported, assess.checked_citations(annotations, evidence), evidence)


@query
def evidence_with_pair(spark: SparkSession, folder: str) -> DataFrame:
    evidence = bm25_topk(spark, folder)
    paired = evidence.where("rk = 2").select("query_id", "chunk_id")
    return retrieval.prepend_paired(evidence, paired).withColumn("score", F.round("score", 6))


# ---- review -----------------------------------------------------------------


@query
def override_effective_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = assess.clamped_marks(mark_rows(spark, folder))
    typed = rows.where("ord % 3 = 0").select("paper_id", "question_id", F.when(F.col("ord") % 2 == 0, F.col("marks_awarded")).otherwise(F.lit(99.0)).alias("marks"))
    final = review.apply_overrides(rows, typed)
    totals = choice.choice_totals(choice.counted_marks(final, choice.rank_choice(final, choice_groups(final))))
    n = final.groupBy("paper_id").agg(F.count_if("overridden").alias("n_overridden"))
    return totals.join(n, "paper_id")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_custkey").alias("student_id"), F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("taken_at"), F.round(F.col("o_totalprice") % 100, 4).alias("percentage"))


@query
def student_trend(spark: SparkSession, folder: str) -> DataFrame:
    return review.student_trend(_history(spark, folder)).select("student_id", "paper_id", "previous", "trend")


@query
def recent_five(spark: SparkSession, folder: str) -> DataFrame:
    return review.newest(_history(spark, folder), "student_id", "taken_at", "paper_id").select("student_id", "paper_id", "rank")


@query
def pages_cut(spark: SparkSession, folder: str) -> DataFrame:
    kept, dropped = review.capped(page_lines(spark, folder).select("paper_id", "page").distinct(), "paper_id", ["page"], 4)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


# ---- places -----------------------------------------------------------------


def _bands(spark: SparkSession, folder: str) -> DataFrame:
    b = page_lines(spark, folder).where("bbox is not null")
    return b.select(F.col("paper_id").alias("doc_id"), "page", F.col("bbox.y").alias("top"), (F.col("bbox.y") + F.col("bbox.height")).alias("bottom"), F.col("bbox.x").alias("left"), (F.col("bbox.x") + F.col("bbox.width")).alias("right"))


@query
def align_bands(spark: SparkSession, folder: str) -> DataFrame:
    placed = placement.align_bands(_docs(spark, folder), _bands(spark, folder))
    return placed.select("doc_id", "page", "line_id", "tier", F.round("bbox.y", 6).alias("y"), F.round("bbox.height", 6).alias("height"))


@query
def worst_geometry(spark: SparkSession, folder: str) -> DataFrame:
    placed = placement.align_bands(_docs(spark, folder), _bands(spark, folder))
    return placement.worst_tier(placement.page_tiers(placed), ["doc_id"])


@query
def union_boxes_by_page(spark: SparkSession, folder: str) -> DataFrame:
    u = placement.union_boxes(page_lines(spark, folder), ["paper_id", "page"])
    return u.select("paper_id", "page", *(F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")))


@query
def span_boxes(spark: SparkSession, folder: str) -> DataFrame:
    own = page_lines(spark, folder)
    found = _wanted(spark, folder).join(own.select("paper_id", "line_id", "start_char", "end_char"), ["paper_id", "line_id"])
    spans = found.groupBy("paper_id", F.col("answer_id").alias("span_id")).agg(F.min("start_char").alias("span_start"), F.max("end_char").alias("span_end"))
    u = placement.span_boxes(spans, own, "paper_id")
    return u.select("paper_id", "span_id", "page", *(F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")))


@query
def padded_boxes(spark: SparkSession, folder: str) -> DataFrame:
    b = page_lines(spark, folder).where("bbox is not null").select("line_uid", marks.padded_box(F.col("bbox")).alias("b"))
    return b.select("line_uid", *(F.round(f"b.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


def _quotes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    b = blocks(spark, folder).where("answer_text is not null")
    answers = b.select(F.col("block_id").alias("answer_id"), F.col("answer_text").alias("text"))
    sentence = scans.sentences(F.col("text"))
    each = answers.select("answer_id", F.posexplode(sentence).alias("ann_ord", "s"))
    kind = F.when(F.col("ann_ord") % 5 == 4, "missing").otherwise("correct")
    return answers, each.select("answer_id", "ann_ord", F.upper("s.text").alias("quote"), kind.alias("type"))


@query
def anchor_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return placement.anchor_annotations(*_quotes(spark, folder))


@query
def text_segments(spark: SparkSession, folder: str) -> DataFrame:
    answers = blocks(spark, folder).where("answer_text is not null").select(F.col("block_id").alias("answer_id"), F.col("answer_text").alias("text"))
    spans = span_exact(spark, folder).select(F.col("block_id").alias("answer_id"), F.lit(0).alias("ann_ord"), "start", "end")
    return placement.text_segments(answers, spans)


@query
def placed_counts(spark: SparkSession, folder: str) -> DataFrame:
    tiers = placement.page_tiers(placement.align_bands(_docs(spark, folder), _bands(spark, folder))).withColumnRenamed("doc_id", "paper_id")
    return placement.placed_counts(span_boxes(spark, folder), tiers, "paper_id")


@query
def range_geometry(spark: SparkSession, folder: str) -> DataFrame:
    tiers = placement.page_tiers(placement.align_bands(_docs(spark, folder), _bands(spark, folder))).withColumnRenamed("doc_id", "paper_id")
    ranges = blocks(spark, folder).select("paper_id", F.col("block_id").alias("range_id"), "page_start", "page_end")
    return placement.range_tier(ranges, tiers, "paper_id")


# ---- alignment and matching -------------------------------------------------


def _label_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("paper_id", "exam_id", F.col("block_id").alias("block_ord"), F.col("question_number").alias("label"), F.col("answer_text").alias("text"))


@query
def align_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_by_label(_label_blocks(spark, folder), questions(spark, folder))


@query
def align_questions(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_questions(_label_blocks(spark, folder), questions(spark, folder))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    """An answer key for each exam: its questions, numbered or, in every third, as running text, as model answers."""
    head = F.when(F.col("exam_id") % 3 == 0, "").otherwise(F.concat("number", F.lit(") "), "text", F.lit("\n")))
    q = questions(spark, folder).withColumn("line", F.concat(head, F.lit("It is known that "), F.lower("text")))
    return q.groupBy("exam_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    pages = _keys(spark, folder).select(F.col("exam_id").alias("doc_id"), F.lit(1).alias("page"), "text")
    keys = questions(spark, folder).groupBy(F.col("exam_id").alias("doc_id")).agg(F.array_sort(F.collect_set(labels.label_key(F.col("number")))).alias("keys"))
    found = segment.numbered_sections(segment.question_blocks(lines.structure_pages(pages), keys))
    return found.withColumn("exam_id", F.col("doc_id"))


@query
def pair_reference(spark: SparkSession, folder: str) -> DataFrame:
    return align.pair_reference(_sections(spark, folder), questions(spark, folder))


@query
def answer_key_sections(spark: SparkSession, folder: str) -> DataFrame:
    return align.answer_key_sections(_keys(spark, folder), _sections(spark, folder), questions(spark, folder))


def _line_span(spark: SparkSession, folder: str) -> DataFrame:
    found = _wanted(spark, folder).join(page_lines(spark, folder).select("paper_id", "line_id", "line_index"), ["paper_id", "line_id"])
    spans = found.groupBy("answer_id").agg(F.min("line_index").alias("first_index"), F.max("line_index").alias("last_index"))
    own = blocks(spark, folder).select("paper_id", F.col("block_id").alias("ord"), F.col("block_id").cast("string").alias("question_id"), F.col("block_id").alias("answer_id"))
    return own.join(spans, "answer_id", "left").withColumn("matched", F.col("answer_id") % 3 != 0).drop("answer_id")


@query
def unmatched_runs(spark: SparkSession, folder: str) -> DataFrame:
    return match.unmatched_runs(_line_span(spark, folder))


@query
def gap_candidates(spark: SparkSession, folder: str) -> DataFrame:
    free = lines.unclaimed_lines(page_lines(spark, folder), _wanted(spark, folder).where("answer_id % 3 <> 0").select("paper_id", "line_id"), ["paper_id"])
    return match.gap_candidates(match.unmatched_runs(_line_span(spark, folder)), free)


@query
def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    return match.chunk_lines(page_lines(spark, folder))


@query
def chunk_questions(spark: SparkSession, folder: str) -> DataFrame:
    return match.chunk_questions(questions(spark, folder))


@query
def apply_proposals(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder)
    claimed = _wanted(spark, folder).where("answer_id % 2 = 0").select("paper_id", "line_id")
    proposals = b.where("question_number is not null").select("paper_id", "exam_id", F.col("block_id").alias("prop_ord"), "question_number", F.col("answer_line_ids").alias("line_ids"))
    taken = b.where("block_id % 5 = 0").select("paper_id", F.concat(F.lit("q"), F.col("block_id") % 7 + 1).alias("question_id"))
    found = match.apply_proposals(proposals, questions(spark, folder), page_lines(spark, folder), claimed, taken)
    return found.withColumn("line_ids", F.array_join("line_ids", ","))


@query
def assembled_answers(spark: SparkSession, folder: str) -> DataFrame:
    short, confidence = match.assembled_answer(F.col("answer_text"), F.col("max_marks"), F.lit(align.LABEL))
    return blocks(spark, folder).select("block_id", short.alias("skipped"), confidence.alias("confidence"))


# ---- choice rules on lines --------------------------------------------------


def _papers_with_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Question papers as lines, each headed by a rule that offers a choice among its first questions."""
    q = questions(spark, folder).where("number is not null")
    rule = F.element_at(F.array(*map(F.lit, ("Answer any THREE of the following five questions.", "Attempt any 2 questions", "All questions are compulsory.", "Do any four, of the following 6"))), (F.col("exam_id") % 4 + 1).cast("int"))
    heads = q.select(F.col("exam_id").alias("doc_id"), F.col("ord").alias("line_index"), F.concat("number", F.lit(". "), "text").alias("text"))
    rules = q.select(F.col("exam_id").alias("doc_id"), F.lit(0).alias("line_index"), rule.alias("text")).distinct()
    return rules.unionByName(heads).withColumn("line_id", F.concat(F.lit("L"), F.col("line_index") + 1)).withColumn("page", F.lit(1))


@query
def attempt_rules(spark: SparkSession, folder: str) -> DataFrame:
    return choice.attempt_rules(_papers_with_rules(spark, folder))


@query
def all_compulsory(spark: SparkSession, folder: str) -> DataFrame:
    return choice.says_all_compulsory(_papers_with_rules(spark, folder))


@query
def detect_choice(spark: SparkSession, folder: str) -> DataFrame:
    own = _papers_with_rules(spark, folder)
    return choice.detect_choice(choice.attempt_rules(own), segment.question_blocks(own))


@query
def describe_choice(spark: SparkSession, folder: str) -> DataFrame:
    own = _papers_with_rules(spark, folder)
    return choice.describe_choice(choice.detect_choice(choice.attempt_rules(own), segment.question_blocks(own)))


# ---- replies, budgets, images, streams --------------------------------------

REPLY_SCHEMA = {
    "type": "object", "required": ["k"],
    "props": {"k": {"type": "number", "min": 0, "max": 50}, "note": {"type": "string", "max": 20, "default": ""}},
}


@query
def recover_replies(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return replies.recover_replies(e.select("event_id", raw.alias("raw")), REPLY_SCHEMA).drop("raw")


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder).where("question_text is not null and answer_text is not null")
    message = F.struct(F.lit("user").alias("role"), F.concat_ws("\n", "question_text", "answer_text").alias("content"))
    body = F.to_json(F.struct(F.array(message).alias("messages"), F.when(F.col("block_id") % 2 == 0, F.lit(600)).alias("max_tokens")))
    return b.select("block_id", F.when(F.col("block_id") % 11 == 0, F.lit("{cut")).otherwise(body).alias("body"))


@query
def request_cost(spark: SparkSession, folder: str) -> DataFrame:
    return _bodies(spark, folder).select("block_id", budget.request_cost(F.col("body")).alias("cost"))


@query
def parse_reset(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("event_id") % 500
    raw = F.when(v % 4 == 0, F.concat(v, F.lit("ms"))).when(v % 4 == 1, F.concat(v, F.lit(".5s"))).when(v % 4 == 2, F.concat(F.lit("1m"), v, F.lit("s"))).otherwise(v.cast("string"))
    return table(spark, folder, "events").select("event_id", marks.parse_reset(raw).alias("ms"))


@query
def retry_delay(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("event_id") % 90
    header = F.when(v % 3 == 0, v.cast("string"))
    message = F.when(v % 3 == 1, F.concat(F.lit("Please try again in "), v, F.lit(".2s."))).otherwise(F.lit("busy"))
    return table(spark, folder, "events").select("event_id", marks.retry_delay(header, message).alias("seconds"))


@query
def rate_limit_windows(spark: SparkSession, folder: str) -> DataFrame:
    return budget.rate_limited(table(spark, folder, "events").withColumn("client", F.col("user_id") % 4), "client", "ts", most=1, seconds=600)


@query
def key_list(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "nation").select(F.col("n_nationkey").alias("rank"), F.concat_ws(",", "n_name", F.concat(F.lit(" "), F.col("n_regionkey")), F.lit("")).alias("value"))
    return budget.key_list(e)


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as keys of a pool."""
    n = table(spark, folder, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("key_id"), F.lit(8000).alias("token_limit"), (k * 331).alias("remaining"), F.when(k % 2 == 0, F.lit(1000) * k).alias("reset_at"), (k * 7).alias("reserved"), (k % 4).alias("in_flight"), (k % 9 == 0).alias("dead"))


@query
def pick_key(spark: SparkSession, folder: str) -> DataFrame:
    return budget.pick_key(request_cost(spark, folder).select(F.col("block_id").alias("request_id"), "cost"), budget.available(_pool(spark, folder), F.lit(9000)))


@query
def otsu_threshold(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("label", F.explode("embedding").alias("v"))
    grey = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(F.col("v").cast("double"), 5) * 40 + 128))).cast("int")
    return images.otsu_threshold(e.groupBy("label", grey.alias("value")).agg(F.count(F.lit(1)).alias("n")), ["label"])


@query
def page_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Pages drawn from the boxes of their lines, measured again."""
    width, height = 120, 160

    def draw(batch):
        import numpy as np

        white, dark = np.array([[255] * 4, [20, 20, 20, 255]], dtype=np.uint8).view(np.uint32).ravel()
        boxes = batch.column("boxes")
        each = boxes.flatten()
        places = zip(*(each.field(k).to_pylist() for k in ("x", "y", "width")))
        for n in boxes.value_lengths().to_pylist():
            page = np.full((height, width), white)
            for bx, by, wide in islice(places, n):
                x, y = int(bx * width), int(by * height)
                page[y : y + 2, x : x + max(4, int(wide * width))] = dark
            yield page.view(np.uint8).reshape(height, width, 4)

    own = page_lines(spark, folder).where("bbox is not null").groupBy(F.col("paper_id").alias("doc_id"), "page").agg(F.collect_list(F.struct("bbox.x", "bbox.y", "bbox.width")).alias("boxes"))
    return images.page_bands(own, draw)


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """A stream run to its end, into files of its own under the shared folder."""
    return trace.run_to_files(stream, f"{shared_folder(spark)}/streams/{uuid4().hex}")


@query
def stream_trace_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = trace.trace_windows(trace.event_stream(spark, f"{folder}/events.parquet*"))
    return _streamed(spark, stream).withColumns({"sum_value": F.round("sum_value", 4), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query
def stream_budget(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, trace.budget_stream(trace.event_stream(spark, f"{folder}/events.parquet*"), limit=150))


@query
def stream_key_states(spark: SparkSession, folder: str) -> DataFrame:
    e = trace.event_stream(spark, f"{folder}/events.parquet*")
    n = F.col("event_id")
    status = F.when(n % 41 == 0, 429).when(n % 997 == 0, 401).otherwise(200)
    kind = F.when(n % 3 == 0, "reserve").when(n % 3 == 1, "reply").otherwise("look")
    calls = e.select((F.col("user_id") % 8).alias("key_id"), "event_id", "ts", kind.alias("kind"), F.lit(300).alias("cost"), status.alias("status"))
    return _streamed(spark, trace.key_state_stream(calls))


@query
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.char_length(files.document_text(F.col("text"))).alias("n_chars"), files.has_text_layer(F.col("text")).alias("has_text"))


@query
def accepted_uploads(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "reference_chunks").select("ref_id", F.col("source").alias("path"))
    return files.with_acceptance(c).select("ref_id", "suffix", "accepted")


@query
def elapsed_clock(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", marks.elapsed_clock(F.col("value") * 37).alias("clock"))


@query
def model_groups(spark: SparkSession, folder: str) -> DataFrame:
    b = blocks(spark, folder)
    proposed = b.select(F.col("paper_id").alias("doc_id"), F.col("block_id").alias("group_ord"), "question_number", F.concat("answer_line_ids", F.array(F.lit("L0"))).alias("line_ids"))
    found = model.grouped_by_model(proposed, _docs(spark, folder))
    return found.withColumn("answer_line_ids", F.array_join("answer_line_ids", ","))


def echo_model(prompt: str) -> str:
    """A stand-in for a model: it counts the prompt's words."""
    return f'Here you are: {{"n": {len(prompt.split())}, "kind": "count"'


@query
def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    schema = {"type": "object", "required": ["n"], "props": {"n": {"type": "number", "min": 0, "max": 12, "integer": True}, "kind": {"type": "string", "default": ""}}}
    asked_of = questions(spark, folder).select("exam_id", "question_id", F.col("text").alias("prompt"))
    return model.ask_for(asked_of, echo_model, schema).drop("prompt")


# ---- reports and whole stages -----------------------------------------------


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return assess.paper_totals(counted_rows(spark, folder))


def _labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Marked questions with a status of their own and how well they were covered."""
    rows = counted_rows(spark, folder)
    status = F.when(F.col("failed"), "evaluation_failed").when(F.col("skipped") & (F.col("ord") % 2 == 0), "not_detected").when(F.col("skipped"), "unanswered").when(F.col("confidence") < 60, "uncertain").otherwise("detected")
    return rows.withColumns({"status": status, "quality": marks.point_quality(F.col("marks_awarded"), F.col("max_marks"))})


@query
def paper_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = counted_rows(spark, folder).withColumn("overridden", F.col("ord") % 4 == 0)
    both = assess.paper_totals(rows).join(assess.pending_marks(rows), "paper_id")
    awarded, total = F.col("total_marks"), F.col("maximum_marks")
    return both.select("paper_id", report.verdict(awarded, total, F.col("pending")).alias("verdict"), report.score_band(awarded, total).alias("band"))


@query
def question_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled_rows(spark, folder)
    return rows.select("paper_id", "question_id", report.report_label(F.col("counted"), F.col("status"), F.col("quality")).alias("report_label"), report.examiner_label(F.col("status"), F.col("marks_awarded"), F.col("max_marks")).alias("examiner_label"))


@query
def annotation_badges(spark: SparkSession, folder: str) -> DataFrame:
    a = _annotations(spark, folder)
    return a.select("question_key", "ann_ord", report.badge(F.col("type"), F.col("marks")).alias("badge"), report.has_marks(F.col("marks")).alias("has_marks"), report.is_low(F.col("confidence")).alias("low"))


@query
def unpinned_notes(spark: SparkSession, folder: str) -> DataFrame:
    notes = blocks(spark, folder).select("paper_id", F.col("block_id").alias("span_id"), F.col("answer_text").alias("quote"))
    tiers = placement.page_tiers(placement.align_bands(_docs(spark, folder), _bands(spark, folder))).withColumnRenamed("doc_id", "paper_id")
    shown = placement.trusted(span_boxes(spark, folder).join(tiers, ["paper_id", "page"]))
    return report.unpinned_notes(notes, shown, ["paper_id", "span_id"]).select("paper_id", "span_id", "shown")


@query
def transcript_edits(spark: SparkSession, folder: str) -> DataFrame:
    edited = F.when(F.col("block_id") % 3 == 0, text.trimmed(F.col("answer_text"))).when(F.col("block_id") % 3 == 1, F.concat("answer_text", F.lit("!"))).otherwise(F.col("answer_text"))
    return blocks(spark, folder).select("block_id", report.is_dirty(edited, F.col("answer_text")).alias("dirty"), text.word_count(edited).alias("n_words"))


@query
def effective_grades(spark: SparkSession, folder: str) -> DataFrame:
    return report.effective_grades(_totals(spark, folder).select("paper_id", "grade"), override_effective_score(spark, folder))


@query
def closing_remarks(spark: SparkSession, folder: str) -> DataFrame:
    totals = _totals(spark, folder)
    replies_ = totals.where("paper_id % 4 = 0").select("paper_id", F.when(F.col("paper_id") % 8 == 0, F.concat(F.lit("Well done, paper "), "paper_id")).otherwise(F.lit("  ")).alias("remark"))
    return report.closing_remarks(totals, replies_)


@query
def printed_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled_rows(spark, folder).withColumn("label", report.report_label(F.col("counted"), F.col("status"), F.col("quality")))
    return report.printed_report(_totals(spark, folder), rows)


@query
def paper_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled_rows(spark, folder).withColumn("label", F.col("status"))
    return report.report_json(_totals(spark, folder), rows)


@query
def exam_warnings(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder)
    printed = q.where("ord % 3 = 0").groupBy("exam_id", "number").agg(F.max("ord").cast("double").alias("marks"))
    own = _papers_with_rules(spark, folder)
    offered = choice.describe_choice(choice.detect_choice(choice.attempt_rules(own), segment.question_blocks(own))).select(F.col("doc_id").alias("exam_id"), "description")
    return stages.exam_warnings(q, exam.validated_questions(q, printed), offered)


@query
def coverage_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return assess.coverage_buckets(status_rows(spark, folder))


@query
def review_issues_with_warnings(spark: SparkSession, folder: str) -> DataFrame:
    warnings = status_rows(spark, folder).where("failed").select("paper_id")
    return assess.review_issues(status_rows(spark, folder), warnings=warnings)


@query
def paired_evidence(spark: SparkSession, folder: str) -> DataFrame:
    sections = _sections(spark, folder)
    return align.paired_evidence(align.pair_reference(sections, questions(spark, folder)), sections, questions(spark, folder))


@query
def paired_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval_coverage(spark, folder)
    return retrieval.paired_coverage(found, found.where("query_id % 3 = 0").select("query_id"))


@query
def pool_stats(spark: SparkSession, folder: str) -> DataFrame:
    return budget.pool_stats(budget.available(_pool(spark, folder), F.lit(9000)))


@query
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    asked_of = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.VectorRetriever(e.select(F.col("vec_id").alias("chunk_id"), "embedding")).search(asked_of, 5)
    return found.withColumn("score", F.round("score", 6))


@query
def reference_passages(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "reference_chunks").select(F.col("ref_id").alias("doc_id"), "source", "page", "text")
    return retrieval.chunk_documents(pages, kept=["page"])


@query
def uploads_decided(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "papers").groupBy("paper_id").agg(F.min("student_id").alias("student_id"), F.min("source").alias("source"), F.min("uploaded_at").alias("uploaded_at"), F.min("page_count").alias("page_count"))
    kind = F.element_at(F.array(*map(F.lit, (".docx", ".pdf", ".doc", ".JPG", ".txt"))), (F.col("paper_id") % 5 + 1).cast("int"))
    named = p.select(F.pmod(F.coalesce("student_id", F.lit(0)), F.lit(40)).alias("owner"), F.concat("source", F.lit("_"), F.col("paper_id").cast("string"), kind).alias("path"), F.col("uploaded_at").alias("modificationTime"), F.col("page_count").alias("n_pages"))
    return files.decided_uploads(named, "owner")


@query
def extracted_exams(spark: SparkSession, folder: str) -> DataFrame:
    """Exams as a model would read them off the paper, some of the replies cut short."""
    q = questions(spark, folder).where("text is not null")
    each = F.transform(F.array_sort(F.collect_list(F.struct("ord", "number", "text", "max_marks"))), lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"), x["max_marks"].alias("maxMarks")))
    body = F.to_json(F.struct(F.lit("Paper").alias("title"), F.array().cast("array<string>").alias("notes"), each.alias("questions")))
    raw = q.groupBy("exam_id").agg(body.alias("body")).select("exam_id", F.when(F.col("exam_id") % 5 == 0, F.lit("I can't read it.")).otherwise(F.concat(F.lit("Sure:\n```json\n"), "body", F.lit("\n```"))).alias("raw"))
    exams_, read = stages.read_exams(raw)
    return exams_.select("exam_id", "title", F.col("error").isNotNull().alias("unread")).join(read, "exam_id", "left")


@query
def assessed_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Replies on the questions that have evidence, with citations, some of them of evidence that isn't there."""
    evidence, cited = _cited(spark, folder)
    note = F.to_json(F.struct(F.lit("It holds.").alias("text"), F.lit("correct").alias("type"), (F.col("question_key") % 60 + 30).cast("string").alias("confidence"), F.col("evidence_id").alias("evidenceId")))
    notes = cited.groupBy("question_key").agg(F.array_join(F.array_sort(F.collect_list(note)), ",").alias("n"))
    k = F.col("question_key")
    raw = notes.select(k, F.when(k % 11 == 0, "no idea").otherwise(F.concat(F.lit('{"marksAwarded": '), (k % 9).cast("string"), F.lit(', "grounding": "reference", "relevant": '), F.when(k % 7 == 0, "false").otherwise("true"), F.lit(', "annotations": ['), "n", F.lit("]}"))).alias("raw"))
    asked_of = asked(spark, folder).select(F.col("query_id").alias("question_key"), F.lit(5.0).alias("max_marks"), F.when(F.col("query_id") % 2 == 0, 70.0).alias("detection"))
    return stages.assess_questions(raw, asked_of, evidence).drop("error")


@query
def segmented_papers(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    totals = docs.select("doc_id").distinct().withColumn("total", (F.col("doc_id") % 40 + 20).cast("bigint"))
    return stages.segment_papers(docs, totals).drop("question_text")


@query
def matched_answers(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers").select("paper_id", "exam_id").distinct()
    b = blocks(spark, folder)
    proposals = b.where("question_number is not null").select("paper_id", "exam_id", F.col("block_id").alias("prop_ord"), "question_number", F.col("answer_line_ids").alias("line_ids"))
    found = stages.match_answers(page_lines(spark, folder), questions(spark, folder), papers, proposals)
    return found.withColumn("line_ids", F.array_join("line_ids", ","))


@query
def assessed_papers(spark: SparkSession, folder: str) -> DataFrame:
    rows = mark_rows(spark, folder)
    grounds = rows.select("paper_id", "question_id", F.when(F.col("paper_id") % 3 == 0, "GENERAL").otherwise("REFERENCE").alias("grounding"))
    found = stages.assess_papers(rows, choice_groups(rows), grounds)
    n = found["warnings"].groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    return found["totals"].join(n, "paper_id", "left").select("paper_id", "total_marks", "maximum_marks", "grade", "passed", "overall_confidence", F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))


@query
def paper_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: marks, choices, answers and statuses to the rows of a report."""
    rows = mark_rows(spark, folder)
    answers = rows.where("ord % 3 <> 0").select("paper_id", "question_id", F.concat(F.lit("It is "), "number").alias("answer_text"), (F.col("paper_id") % 2 == 0).alias("has_unassigned_writing"))
    return stages.evaluations(stages.assess_papers(rows, choice_groups(rows))["questions"], answers)


# ---- extensions: classic operators beyond the assessment ones ---------------


@query
def ext_rollup_marks(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "papers").groupBy("paper_id").agg(F.min("source").alias("source"), F.min("exam_id").alias("exam_id"))
    e = table(spark, folder, "exams").select("exam_id", "subject", "lang")
    return p.join(e, "exam_id").rollup("subject", "source").agg(F.count(F.lit(1)).alias("n_papers"), F.grouping_id().cast("int").alias("level"))


@query
def ext_cube_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.cube("event_type", F.dayofweek("ts").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))
