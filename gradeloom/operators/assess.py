"""Marks and what supports them: replies checked against limits and evidence, sums over papers, and coverage of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.marks import clamp, grade_for

# Share of a maximum that passes, and ceilings on confidence for weak grounds.
PASS_PERCENTAGE, CEILING_INSUFFICIENT, CEILING_IRRELEVANT = 33.0, 65, 55
REFERENCE, GENERAL, INSUFFICIENT = "REFERENCE", "GENERAL", "INSUFFICIENT"


def checked_citations(annotations: DataFrame, evidence: DataFrame) -> DataFrame:
    """annotations with cited_id: the evidence id if the question's evidence really holds it, else null.

    annotations: question_key, evidence_id and others. evidence: question_key,
    chunk_id. A left join on both, so a citation can't multiply rows.
    """
    held = evidence.select("question_key", F.col("chunk_id").alias("evidence_id")).distinct().withColumn("cited_id", F.col("evidence_id"))
    return annotations.join(held, ["question_key", "evidence_id"], "left")


def resolved_grounding(questions: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_key, n_evidence, n_cited, grounding: what a mark rests on, as reported but verified.

    Without evidence it is INSUFFICIENT; a REFERENCE without a real citation is GENERAL.
    """
    n_evidence = evidence.groupBy("question_key").agg(F.count(F.lit(1)).alias("n_evidence"))
    n_cited = citations.groupBy("question_key").agg(F.count("cited_id").alias("n_cited"))
    joined = questions.join(n_evidence, "question_key", "left").join(n_cited, "question_key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_evidence", "n_cited")})
    grounding = F.when(F.col("n_evidence") == 0, INSUFFICIENT).when((F.col("reported") == REFERENCE) & (F.col("n_cited") == 0), GENERAL).otherwise(F.col("reported"))
    return joined.select("question_key", "n_evidence", "n_cited", grounding.alias("grounding"))


def consistent_annotation_marks(annotations: DataFrame) -> DataFrame:
    """annotations with fixed_marks: marks of single remarks, kept only where they can be true.

    annotations: question_key, ann_ord, type, marks, awarded. If the positive
    marks of a question exceed what it was awarded, all of them go. If none are
    given and exactly one remark is correct or partial, that one has earned the
    award.
    """
    of_question = Window.partitionBy("question_key")
    earner = F.col("type").isin("correct", "partial")
    claimed = F.sum(F.when(F.col("marks") > 0, F.col("marks")).otherwise(0.0)).over(of_question)
    reported = F.count("marks").over(of_question)
    earners = F.count_if(earner).over(of_question)
    fixed = (
        F.when(claimed > F.col("awarded") + 1e-9, F.lit(None).cast("double"))
        .when((reported == 0) & (F.col("awarded") > 0) & (earners == 1) & earner, F.col("awarded"))
        .otherwise(F.col("marks"))
    )
    return annotations.withColumn("fixed_marks", fixed)


def question_confidence(annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """question_key, confidence: the mean of the reported confidences, rounded, but no more than detection allows.

    questions: question_key, detection (null: 100), grounding, relevant. Without
    a reported confidence the detection stands. Weak grounds and irrelevant
    answers have their ceilings.
    """
    reported = annotations.groupBy("question_key").agg(F.floor(F.avg("confidence") + 0.5).cast("double").alias("model"))
    detection = F.coalesce("detection", F.lit(100.0))
    joined = questions.join(reported, "question_key", "left").withColumn("c", F.least(F.coalesce("model", detection), detection))
    limited = F.least("c", F.when(F.col("grounding") == INSUFFICIENT, F.lit(float(CEILING_INSUFFICIENT))), F.when(~F.col("relevant"), F.lit(float(CEILING_IRRELEVANT))))
    return joined.select("question_key", limited.alias("confidence"))


def clamped_marks(marks: DataFrame) -> DataFrame:
    """marks with marks_awarded within 0 and max_marks; null and NaN count as 0."""
    return marks.withColumn("marks_awarded", clamp(F.col("marks_awarded"), 0.0, F.coalesce("max_marks", F.lit(0.0))))


def paper_totals(counted: DataFrame) -> DataFrame:
    """paper_id, total_marks, maximum_marks, printed_marks, percentage, grade, passed, overall_confidence of each paper.

    counted: paper_id, marks_awarded, max_marks, counted, skipped, failed,
    confidence. Confidence is the rounded mean over counted questions that were
    neither skipped nor failed; 0 without any.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    only = lambda c, on: F.sum(F.when(on, zero(c)).otherwise(0.0))
    marked = F.col("counted") & ~F.col("skipped") & ~F.col("failed")
    sums = counted.groupBy("paper_id").agg(
        only("marks_awarded", F.col("counted")).alias("total_marks"), only("max_marks", F.col("counted")).alias("maximum_marks"), only("max_marks", F.lit(True)).alias("printed_marks"),
        F.coalesce(F.floor(F.avg(F.when(marked, zero("confidence"))) + 0.5), F.lit(0)).cast("bigint").alias("overall_confidence"),
    )
    percentage = F.when(F.col("maximum_marks") > 0, F.col("total_marks") / F.col("maximum_marks") * 100).otherwise(0.0)
    return sums.withColumn("percentage", percentage).select(
        "paper_id", "total_marks", "maximum_marks", "printed_marks", "percentage", grade_for(F.col("percentage")).alias("grade"),
        ((F.col("maximum_marks") > 0) & (F.col("percentage") >= PASS_PERCENTAGE)).alias("passed"), "overall_confidence",
    )


def coverage_summary(statuses: DataFrame) -> DataFrame:
    """paper_id, detected, verify, unanswered, failed, n_questions: answers of a paper by what is known of them."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    return statuses.groupBy("paper_id").agg(
        count("detected").alias("detected"), count("uncertain", "not_detected").alias("verify"), count("unanswered").alias("unanswered"),
        count("evaluation_failed").alias("failed"), F.count(F.lit(1)).alias("n_questions"),
    )


def coverage_buckets(statuses: DataFrame) -> DataFrame:
    """paper_id, and how many of its questions have each status: detected, uncertain, not_detected, unanswered, evaluation_failed."""
    names = ("detected", "uncertain", "not_detected", "unanswered", "evaluation_failed")
    return statuses.groupBy("paper_id").agg(*(F.count_if(F.col("status") == name).alias(name) for name in names))


def attention_list(statuses: DataFrame) -> DataFrame:
    """The counted questions whose status asks for a look: neither detected nor unanswered."""
    return statuses.where(F.col("counted") & ~F.col("status").isin("detected", "unanswered"))


def review_issues(statuses: DataFrame, low: int = 60, warnings: DataFrame | None = None) -> DataFrame:
    """paper_id, n_issues: questions that were skipped, failed or read with low confidence, and the warnings of a paper (paper_id, one row each)."""
    issues = statuses.select("paper_id", (F.col("skipped") | F.col("failed") | F.coalesce(F.col("confidence") < low, F.lit(False))).alias("issue"))
    if warnings is not None:
        issues = issues.unionByName(warnings.select("paper_id", F.lit(True).alias("issue")))
    return issues.groupBy("paper_id").agg(F.count_if("issue").alias("n_issues"))


def collect_points(points: DataFrame, most: int = 8) -> DataFrame:
    """paper_id, rank, point: distinct points of a paper by first place, whatever their case, up to `most`.

    points: paper_id, ord, point. Blank points are dropped.
    """
    clean = points.withColumn("point", F.trim("point")).where("point is not null and point <> ''")
    firsts = clean.groupBy("paper_id", F.lower("point").alias("k")).agg(F.min(F.struct("ord", "point")).alias("f")).select("paper_id", "f.ord", "f.point")
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "point")))
    return ranked.where(F.col("rank") <= most).select("paper_id", "rank", "point")


def pending_marks(counted: DataFrame) -> DataFrame:
    """paper_id, pending: marks of counted questions whose evaluation failed and that nobody overrode."""
    return counted.groupBy("paper_id").agg(F.sum(F.when(F.col("counted") & F.col("failed") & ~F.col("overridden"), F.coalesce("max_marks", F.lit(0.0))).otherwise(0.0)).alias("pending"))
