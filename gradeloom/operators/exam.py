"""Question papers: checks of numbers and marks, and the apportionment of a total over questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.marks import classify_question
from gradeloom.functions.text import normalize_text


def validated_questions(raw: DataFrame, printed: DataFrame) -> DataFrame:
    """exam_id, ord, number, text, max_marks, type, mark_conflict, read, printed: questions with the marks printed on the paper winning.

    raw: exam_id, ord, number, text, max_marks. printed: exam_id, number, marks.
    Rows with neither text nor number are dropped; a null number is the
    question's place. Marks that are null or not positive are missing.
    """
    kept = raw.where((normalize_text(F.col("text")) != "") | (F.trim(F.coalesce("number", F.lit(""))) != ""))
    place = F.row_number().over(Window.partitionBy("exam_id").orderBy("ord"))
    named = kept.withColumn("number", F.trim(F.coalesce("number", place.cast("string")))).withColumn("read", F.when(F.col("max_marks") > 0, F.col("max_marks")))
    joined = named.join(printed.where("marks > 0").select("exam_id", "number", F.col("marks").cast("double").alias("printed")), ["exam_id", "number"], "left")
    marks = F.coalesce("printed", "read")
    return joined.select(
        "exam_id", "ord", "number", F.trim(F.coalesce("text", F.lit(""))).alias("text"), marks.alias("max_marks"), classify_question(F.col("text"), marks).alias("type"),
        (F.col("read").isNotNull() & F.col("printed").isNotNull() & (F.col("read") != F.col("printed"))).alias("mark_conflict"), "read", "printed",
    )


def duplicate_numbers(questions: DataFrame) -> DataFrame:
    """exam_id, number, n: numbers that an exam prints more than once."""
    return questions.where("number is not null").groupBy("exam_id", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def derive_marks(questions: DataFrame, choice: DataFrame, declared: DataFrame) -> DataFrame:
    """exam_id, n_missing, printed_marks, total_marks, declared_total, mismatch, blocking for each exam.

    questions: exam_id, question_id, ord, max_marks, number. choice: exam_id,
    group_id, required, number, one row per member. A group counts its
    `required` members with the most marks; a question that any group drops is
    out. Missing marks count 0 and block; with them no mismatch is claimed.
    """
    first = Window.partitionBy("exam_id", "number").orderBy("ord")
    members = choice.join(questions.withColumn("k", F.row_number().over(first)).where("k = 1"), ["exam_id", "number"])
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("exam_id", "group_id").orderBy(F.coalesce("max_marks", F.lit(0.0)).desc(), "ord")))
    dropped = ranked.where("rank > required").select("exam_id", "question_id").distinct().withColumn("out", F.lit(True))
    marks = F.coalesce("max_marks", F.lit(0.0))
    sums = questions.join(dropped, ["exam_id", "question_id"], "left").groupBy("exam_id").agg(
        F.count_if(F.col("max_marks").isNull()).alias("n_missing"),
        F.sum(marks).alias("printed_marks"),
        F.sum(F.when(F.col("out"), 0.0).otherwise(marks)).alias("total_marks"),
    )
    joined = sums.join(declared.select("exam_id", F.when(F.col("declared_total") > 0, F.col("declared_total")).alias("declared_total")), "exam_id", "left")
    mismatch = F.coalesce((F.col("n_missing") == 0) & (F.col("total_marks") != F.col("declared_total")), F.lit(False))
    return joined.select("exam_id", "n_missing", "printed_marks", "total_marks", "declared_total", mismatch.alias("mismatch"), (F.col("n_missing") > 0).alias("blocking"))


def allocate_marks(questions: DataFrame) -> DataFrame:
    """exam_id, question_id, ord, marks: whole marks that add up to each exam's total, by largest remainders.

    questions: exam_id, question_id, ord, max_marks, total. Printed marks stand,
    the rest of the total is shared equally among the others; if all are
    printed but miss the total, they are scaled. No question has less than 1: a
    surplus that this causes is taken from the last questions that have more, in
    rounds; where all are at 1 it stays. Without a positive total, marks stay
    and missing ones are 10.
    """
    of_exam = Window.partitionBy("exam_id")
    printed = F.when(F.col("max_marks") > 0, F.col("max_marks").cast("double"))
    base = questions.withColumn("printed", printed).withColumns({
        "n_open": F.count_if(F.col("printed").isNull()).over(of_exam),
        "sum_printed": F.coalesce(F.sum("printed").over(of_exam), F.lit(0.0)),
    })
    share = F.greatest(F.lit(0.0), F.col("total") - F.col("sum_printed")) / F.col("n_open")
    scaled = F.when((F.col("n_open") == 0) & (F.col("sum_printed") != F.col("total")), F.col("printed") * (F.col("total") / F.col("sum_printed"))).otherwise(F.coalesce("printed", share))
    exact = base.withColumn("exact", scaled).withColumn("floor", F.greatest(F.lit(1.0), F.floor("exact").cast("double"))).withColumns({
        "n": F.count(F.lit(1)).over(of_exam),
        "gap": (F.col("total") - F.sum("floor").over(of_exam)).cast("bigint"),
        "rank": F.row_number().over(of_exam.orderBy((F.col("exact") - F.floor("exact")).desc(), "ord")) - 1,
    })
    more = F.floor(F.col("gap") / F.col("n")) + (F.col("rank") < F.col("gap") % F.col("n")).cast("bigint")
    # A surplus goes round from the last question to the first, one mark a turn: turn t takes from
    # each question with more than t marks to spare. The marks taken before a question's t-th turn
    # are those of all earlier turns and of the later questions in this turn.
    spare = (F.col("floor") - 1).cast("bigint")
    turns = exact.where("gap < 0").withColumn("turn", F.explode(F.when(spare > 0, F.sequence(F.lit(1).cast("bigint"), F.least(spare, -F.col("gap")))).otherwise(F.array().cast("array<bigint>"))))
    taken = turns.withColumn("k", F.row_number().over(of_exam.orderBy("turn", F.col("ord").desc()))).where("k <= -gap").groupBy("exam_id", "question_id", "ord").agg(F.count(F.lit(1)).alias("less"))
    joined = exact.join(taken, ["exam_id", "question_id", "ord"], "left")
    unchanged = (F.col("n_open") == 0) & (F.col("sum_printed") == F.col("total"))
    marks = (
        F.when(F.col("total").isNull() | (F.col("total") <= 0), F.coalesce("max_marks", F.lit(10.0)))
        .when(unchanged, F.col("printed"))
        .when(F.col("gap") > 0, F.col("floor") + more)
        .otherwise(F.col("floor") - F.coalesce("less", F.lit(0)))
    )
    return joined.select("exam_id", "question_id", "ord", marks.cast("double").alias("marks"))
