"""Rules like "answer any three": read from lines, scoped to questions, and applied to marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.labels import NUMBER_WORDS, canonical_label

_COUNT = r"\d{1,2}|" + "|".join(NUMBER_WORDS)
# How papers word a choice, and that there is none.
ANY_RULE = rf"(?i)\b(?:answer|attempt|do|solve|write|complete)\b[^.\n]{{0,30}}?\bany\b\s*(?:{_COUNT})\b"
ANY_COUNT = rf"(?i)\bany\b\s*({_COUNT})\b"
OF_COUNT = rf"(?i)\bof\b(?:[^.\n]{{0,25}}?)\b({_COUNT})\b"
ALL_COMPULSORY = r"(?i)\b(?:all|every)\b[^.\n]{0,30}\b(?:compulsory|mandatory|required)\b|\banswer\s+all\b"


def count_from_word(word: Column) -> Column:
    """A positive number of one or two digits, or a number word; null for anything else."""
    w = F.lower(F.trim(word))
    table = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    digits = F.when(w.rlike(r"^\d{1,2}$"), w.try_cast("int"))
    return F.coalesce(F.when(digits > 0, digits), F.try_element_at(table, w))


def attempt_rules(lines: DataFrame) -> DataFrame:
    """doc_id, line_index, required, of, text: the lines that offer a choice. The group's size is read behind the count."""
    hit = F.regexp_extract("text", ANY_COUNT, 0)
    tail = F.substring("text", F.position(hit, "text") + F.char_length(hit), F.char_length("text"))
    of = F.regexp_extract(tail, OF_COUNT, 1)
    return lines.where(F.col("text").rlike(ANY_RULE)).select(
        "doc_id", "line_index", count_from_word(F.regexp_extract("text", ANY_COUNT, 1)).alias("required"), F.when(of != "", count_from_word(of)).alias("of"), F.trim("text").alias("text")
    ).where("required is not null")


def says_all_compulsory(lines: DataFrame) -> DataFrame:
    """doc_id, all_compulsory: whether any line of a document says so."""
    return lines.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("text").rlike(ALL_COMPULSORY)), F.lit(False)).alias("all_compulsory"))


def detect_choice(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, group_id, required, number, member_ord: the questions that each rule governs, one row a member.

    A rule governs the heads between it and the next rule, up to its stated
    size; it is dropped if these are no more than it requires.
    """
    next_rule = F.lead("line_index").over(Window.partitionBy("doc_id").orderBy("line_index"))
    scoped = rules.withColumn("until", next_rule).withColumnRenamed("line_index", "group_id")
    heads = blocks.select("doc_id", "head_index", canonical_label(F.col("question_number")).alias("number")).where("number <> ''")
    within = (F.col("head_index") > F.col("group_id")) & (F.col("until").isNull() | (F.col("head_index") < F.col("until")))
    of_group = Window.partitionBy("doc_id", "group_id")
    ranked = scoped.join(heads, "doc_id").where(within).withColumn("member_ord", F.row_number().over(of_group.orderBy("head_index")))
    sized = ranked.where("of is null or member_ord <= of").withColumn("n", F.count(F.lit(1)).over(of_group))
    return sized.where("n > required and required > 0").select("doc_id", "group_id", "required", "number", "member_ord")


def rank_choice(marks: DataFrame, groups: DataFrame, prefer: str = "best") -> DataFrame:
    """paper_id, question_id, group_id, rank, kept: the place of each member in its group.

    marks: paper_id, question_id, ord, number, max_marks, marks_awarded,
    skipped, failed. groups: paper_id, group_id, required, number, member_ord.
    Attempts come first: the best marks, then those that failed to be
    evaluated, then the larger maxima (prefer="first": the order of the group).
    Groups with no more members than required are left alone.
    """
    key = lambda c: canonical_label(F.col(c))
    last = Window.partitionBy("paper_id", "label").orderBy(F.col("ord").desc())
    narrow = marks.select("paper_id", "question_id", "ord", "number", "max_marks", "marks_awarded", "skipped", "failed")
    known = narrow.withColumn("label", key("number")).withColumn("k", F.row_number().over(last)).where("k = 1").drop("ord", "k")
    members = groups.select("paper_id", "group_id", "required", key("number").alias("label"), "member_ord").join(known, ["paper_id", "label"])
    of_group = Window.partitionBy("paper_id", "group_id")
    attempted = ~F.col("skipped")
    order = [F.col("skipped").cast("int")]
    if prefer == "best":
        order += [
            F.when(attempted, F.coalesce("marks_awarded", F.lit(0.0))).desc_nulls_last(),
            F.when(attempted, F.col("failed").cast("int")).desc_nulls_last(),
            F.when(attempted, F.coalesce("max_marks", F.lit(0.0))).desc_nulls_last(),
        ]
    ranked = members.withColumns({"rank": F.row_number().over(of_group.orderBy(*order, "member_ord")), "n": F.count(F.lit(1)).over(of_group)})
    return ranked.where("n > required").select("paper_id", "question_id", "number", "group_id", "required", "rank", "skipped", (F.col("rank") <= F.col("required")).alias("kept"))


def dropped_questions(ranked: DataFrame) -> DataFrame:
    """paper_id, question_id, number, reason: the members that do not count."""
    reason = F.when(F.col("skipped"), "not attempted, and not required").otherwise("an extra attempt beyond the choice")
    return ranked.where(~F.col("kept")).select("paper_id", "question_id", "number", reason.alias("reason")).distinct()


def counted_marks(marks: DataFrame, ranked: DataFrame) -> DataFrame:
    """marks with `counted`: false for a question that any of its groups drops."""
    out = ranked.where(~F.col("kept")).select("paper_id", "question_id").distinct().withColumn("out", F.lit(True))
    return marks.join(out, ["paper_id", "question_id"], "left").withColumn("counted", F.col("out").isNull()).drop("out")


def choice_totals(counted: DataFrame) -> DataFrame:
    """paper_id, maximum_marks, total_marks, printed_marks: sums over what counts, and over all."""
    sums = lambda c, on: F.sum(F.when(on, F.coalesce(c, F.lit(0.0))).otherwise(0.0))
    return counted.groupBy("paper_id").agg(
        sums("max_marks", F.col("counted")).alias("maximum_marks"), sums("marks_awarded", F.col("counted")).alias("total_marks"), sums("max_marks", F.lit(True)).alias("printed_marks")
    )


def describe_choice(groups: DataFrame) -> DataFrame:
    """doc_id, description: "answer any N of K (Q1, Q2); ..." with the groups in order."""
    members = groups.groupBy("doc_id", "group_id", "required").agg(F.array_sort(F.collect_list(F.struct("member_ord", "number"))).alias("m"))
    one = F.concat(F.lit("answer any "), "required", F.lit(" of "), F.size("m"), F.lit(" ("), F.array_join(F.transform("m", lambda x: F.concat(F.lit("Q"), x["number"])), ", "), F.lit(")"))
    ordered = members.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group_id", one.alias("text")))).alias("g"))
    return ordered.select("doc_id", F.array_join(F.transform("g", lambda x: x["text"]), "; ").alias("description"))
