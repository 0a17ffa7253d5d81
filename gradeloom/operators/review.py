"""What examiners and students see over time: overrides, trends, newest papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.marks import clamp


def apply_overrides(marks: DataFrame, overrides: DataFrame) -> DataFrame:
    """marks with ai_marks (the proposal), marks_awarded (the override, clamped, where there is one) and overridden.

    overrides: paper_id, question_id, marks. Typing the proposal again is no
    override; a null override is none.
    """
    joined = marks.join(overrides.select("paper_id", "question_id", F.col("marks").cast("double").alias("typed")), ["paper_id", "question_id"], "left")
    valid = F.when(F.col("typed").isNotNull() & ~F.isnan("typed"), clamp(F.col("typed"), 0.0, F.coalesce("max_marks", F.lit(0.0))))
    changed = F.coalesce(valid != F.col("marks_awarded"), valid.isNotNull())
    return joined.withColumns({"ai_marks": F.col("marks_awarded"), "overridden": changed, "marks_awarded": F.when(changed, valid).otherwise(F.col("marks_awarded"))}).drop("typed")


def student_trend(papers: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """papers with previous (percentage of the student's paper before) and trend: up, down, level or none.

    papers: student_id, paper_id, taken_at, percentage. Ties in time go by paper_id.
    """
    before = F.lag("percentage").over(Window.partitionBy("student_id").orderBy("taken_at", "paper_id"))
    delta = F.col("percentage") - F.col("previous")
    trend = F.when(F.col("previous").isNull(), "none").when(delta > tolerance, "up").when(delta < -tolerance, "down").otherwise("level")
    return papers.withColumn("previous", before).withColumn("trend", trend)


def newest(rows: DataFrame, key: str, time: str, tie: str, most: int = 5) -> DataFrame:
    """The newest rows of each key with their rank; ties by the higher tie column."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def append_history(rows: DataFrame, path: str, ai_score: str = "ai_score", score: str = "score") -> None:
    """Append papers with the score proposed and the one that counts to a history of parquet files: student_id, paper_id, taken_at and both."""
    rows.select("student_id", "paper_id", "taken_at", F.col(ai_score).cast("double").alias("ai_score"), F.col(score).cast("double").alias("score")).write.mode("append").parquet(path)


def recent_history(history: DataFrame, most: int = 5) -> DataFrame:
    """The newest papers of each student with their rank; of a paper recorded twice the last row in time counts, then the higher score."""
    latest = Window.partitionBy("student_id", "paper_id").orderBy(F.col("taken_at").desc(), F.col("score").desc_nulls_last())
    once = history.withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")
    return newest(once, "student_id", "taken_at", "paper_id", most)


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first `most` rows of each key, and a relation of the rest; nothing is cut silently."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("place") <= most), ranked.where(F.col("place") > most)
