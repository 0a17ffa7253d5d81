"""What a marked paper looks like to its readers: verdicts, labels, badges, notes and printable rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.marks import LOW_CONFIDENCE, grade_for

# Share of the total that passes, and least percentages of the bands of a score.
PASS_SHARE = 0.40
BANDS = [(75, "high"), (50, "good"), (35, "fair")]
LOWEST_BAND = "low"
# Icon and sign of a remark by its type; unknown types are partial.
TYPE_MARKS = {"correct": ("✓", "+"), "partial": ("~", "~"), "wrong": ("✗", "✗"), "missing": ("!", "!")}
# Labels of a question on the report and for the examiner.
REPORT_LABELS = {"evaluation_failed": "Eval. unavailable", "not_detected": "Answer not detected", "unanswered": "Unanswered", "uncertain": "Verify"}
EXAMINER_LABELS = {"evaluation_failed": "Evaluation unavailable", "not_detected": "Answer not detected", "unanswered": "Confirmed unanswered", "uncertain": "Uncertain — verify"}
#: Characters of a quote that a note without a place shows.
QUOTE_CHARS = 90


def verdict(awarded: Column, total: Column, pending: Column) -> Column:
    """pass, pending or fail: pending if the marks that are still open could make it pass. A total of null or zero fails."""
    share = lambda marks: F.coalesce(marks / F.when(total > 0, total) >= PASS_SHARE, F.lit(False))
    return F.when(share(awarded), "pass").when((pending > 0) & share(awarded + pending), "pending").otherwise("fail")


def score_band(awarded: Column, total: Column) -> Column:
    """high, good, fair or low, by the percentage; a total of null or zero is low."""
    percentage = F.when(total > 0, awarded / total * 100).otherwise(0.0)
    return reduce(lambda rest, band: F.when(percentage >= band[0], band[1]).otherwise(rest), reversed(BANDS), F.lit(LOWEST_BAND))


def _by_status(status: Column, labels: dict[str, str], otherwise: Column) -> Column:
    return reduce(lambda rest, pair: F.when(status == pair[0], pair[1]).otherwise(rest), reversed(labels.items()), otherwise)


def report_label(counted: Column, status: Column, quality: Column) -> Column:
    """The label of a question on the report: what doesn't count first, then its status, then how well it was covered."""
    covered = F.when(quality == "well", "Covered well").when(quality == "partially", "Partial").otherwise("Not covered")
    return F.when(~counted, "Not counted").otherwise(_by_status(status, REPORT_LABELS, covered))


def examiner_label(status: Column, awarded: Column, maximum: Column) -> Column:
    """The label of a question for the examiner: its status, else whether it has full, some or no marks."""
    marks = F.when((maximum > 0) & (awarded >= maximum), "Full marks").when(awarded > 0, "Partial").otherwise("Zero")
    return _by_status(status, EXAMINER_LABELS, marks)


def number_text(value: Column) -> Column:
    """A number without a point where it is whole."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def badge(kind: Column, marks: Column) -> Column:
    """The badge of a remark: sign and marks where it has any, else the icon of its type."""
    icon, sign = (reduce(lambda rest, t: F.when(kind == t, TYPE_MARKS[t][i]).otherwise(rest), TYPE_MARKS, F.lit(TYPE_MARKS["partial"][i])) for i in (0, 1))
    return F.when(has_marks(marks), F.concat(sign, number_text(F.abs(marks)))).otherwise(icon)


def has_marks(marks: Column) -> Column:
    """True for marks that are a number other than 0."""
    return marks.isNotNull() & ~F.isnan(marks.cast("double")) & (marks != 0)


def is_low(confidence: Column) -> Column:
    """True for a confidence that is known and low."""
    return F.coalesce((confidence < LOW_CONFIDENCE) & ~F.isnan(confidence.cast("double")), F.lit(False))


def is_dirty(edited: Column, marked: Column) -> Column:
    """True if the text on the screen is no longer the one that was marked; null equals null alone."""
    return ~edited.eqNullSafe(marked)


def unpinned_notes(annotations: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The annotations without a box on any trusted page, with `shown`: the head of their quote.

    annotations: the keys, quote and others. boxes: the keys; only trusted ones.
    """
    quote = F.coalesce("quote", F.lit(""))
    shown = F.concat(F.substring(quote, 1, QUOTE_CHARS), F.when(F.char_length(quote) > QUOTE_CHARS, "…").otherwise(""))
    return annotations.join(boxes.select(*keys).distinct(), keys, "left_anti").withColumn("shown", shown)


def effective_grades(original: DataFrame, final: DataFrame) -> DataFrame:
    """paper_id, total_marks, maximum_marks, n_overridden, grade: totals after overrides.

    original: paper_id, grade. final: paper_id, total_marks, maximum_marks,
    n_overridden. A paper that nobody touched keeps its grade; else it is graded
    anew, if there is a maximum.
    """
    again = grade_for(F.col("total_marks") / F.when(F.col("maximum_marks") > 0, F.col("maximum_marks")) * 100)
    changed = (F.col("n_overridden") > 0) & (F.col("maximum_marks") > 0)
    joined = final.join(original.select("paper_id", F.col("grade").alias("first_grade")), "paper_id", "left")
    return joined.select("paper_id", "total_marks", "maximum_marks", "n_overridden", F.when(changed, again).otherwise(F.col("first_grade")).alias("grade"))


def closing_remarks(totals: DataFrame, replies: DataFrame | None = None, most: int = 900) -> DataFrame:
    """paper_id, remark, from_model: the remark of a model where there is one, else a plain sentence on the score.

    totals: see assess.paper_totals. replies: paper_id, remark; nulls and blanks
    are no remarks.
    """
    # Fixed value: the remark of a paper that no model has one for.
    plain = F.concat(F.lit("Scored "), number_text(F.col("total_marks")), F.lit(" out of "), number_text(F.col("maximum_marks")), F.lit(" ("), F.floor(F.col("percentage") + 0.5).cast("string"), F.lit("%), grade "), "grade", F.lit(". See the per-question feedback for detail."))
    if replies is None:
        return totals.select("paper_id", plain.alias("remark"), F.lit(False).alias("from_model"))
    given = replies.where(F.trim("remark") != "").groupBy("paper_id").agg(F.substring(F.min("remark"), 1, most).alias("given"))
    return totals.join(given, "paper_id", "left").select("paper_id", F.coalesce("given", plain).alias("remark"), F.col("given").isNotNull().alias("from_model"))


def printed_report(totals: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id, header, body, n_lines: a paper's report as text, one line a question in order.

    questions: paper_id, ord, number, marks_awarded, max_marks, label. Papers
    without questions have an empty body.
    """
    line = F.concat(F.lit("Q"), F.coalesce("number", F.lit("?")), F.lit(" "), number_text(F.coalesce("marks_awarded", F.lit(0.0))), F.lit("/"), number_text(F.coalesce("max_marks", F.lit(0.0))), F.lit(" "), F.coalesce("label", F.lit("")))
    lines = questions.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    header = F.concat(number_text(F.col("total_marks")), F.lit(" / "), number_text(F.col("maximum_marks")), F.lit(" "), "grade")
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return totals.join(lines, "paper_id", "left").select("paper_id", header.alias("header"), F.coalesce(body, F.lit("")).alias("body"), F.coalesce(F.size("l"), F.lit(0)).alias("n_lines"))


def report_json(totals: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id, json: a paper with its questions in order as one JSON object. Inputs as in printed_report."""
    each = F.struct("ord", "number", "marks_awarded", "max_marks", "label")
    lists = questions.groupBy("paper_id").agg(F.array_sort(F.collect_list(each)).alias("questions"))
    return totals.join(lists, "paper_id", "left").select("paper_id", F.to_json(F.struct("paper_id", "total_marks", "maximum_marks", "percentage", "grade", "questions")).alias("json"))
