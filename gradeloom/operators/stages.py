"""Whole stages composed of the operators: a paper segmented, its answers matched, its questions marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.labels import label_key
from gradeloom.functions.marks import answer_status, clamp, is_too_short, point_quality
from gradeloom.functions.text import normalize_text, token_overlap
from gradeloom.operators import align, assess, choice, exam, lines, match, model, replies, segment
from gradeloom.session import checkpointed

# Confidence of an answer that the model placed but shares no words with its question, under this overlap and from this length on.
WEAK, LEAST_OVERLAP, OVERLAP_CHARS = 40, 0.04, 40


def segment_papers(doc_lines: DataFrame, totals: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """doc_id, head_index, question_number, question_text, answer_text, max_marks: each document as questions whose marks add up to its total.

    doc_lines: doc_id, line_id, line_index, page, text. totals: doc_id, total.
    groups: groups of lines proposed by a model (see model.grouped_by_model),
    which stand in where no label was found. A document without either is one
    question, number 1, with the whole text as its answer.
    """
    found = checkpointed(segment.question_blocks(doc_lines).select("doc_id", "head_index", "question_number", "question_text", "answer_text", F.col("max_marks").cast("double").alias("max_marks")))
    if groups is not None:
        proposed = model.grouped_by_model(groups, doc_lines).join(found.select("doc_id").distinct(), "doc_id", "left_anti")
        found = found.unionByName(proposed.select("doc_id", F.col("group_ord").cast("int").alias("head_index"), "question_number", F.lit("").alias("question_text"), "answer_text", F.lit(None).cast("double").alias("max_marks")))
    rest = doc_lines.join(found.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("l"))
    whole = rest.select(
        "doc_id", F.lit(0).alias("head_index"), F.lit("1").alias("question_number"), F.lit("").alias("question_text"),
        F.array_join(F.transform("l", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("answer_text"), F.lit(None).cast("double").alias("max_marks"),
    )
    questions = found.unionByName(whole)
    shares = exam.allocate_marks(questions.join(totals.select("doc_id", "total"), "doc_id", "left").select(F.col("doc_id").alias("exam_id"), F.col("head_index").cast("string").alias("question_id"), F.col("head_index").alias("ord"), "max_marks", "total"))
    marks = shares.select(F.col("exam_id").alias("doc_id"), F.col("ord").alias("head_index"), F.col("marks").alias("max_marks"))
    return questions.drop("max_marks").join(marks, ["doc_id", "head_index"])


EXAM_SCHEMA = {
    "type": "object", "required": ["questions"],
    "props": {
        "title": {"type": "string", "max": 200, "default": ""}, "subject": {"type": "string", "max": 120, "default": ""}, "totalMarks": {"type": "number", "min": 0, "default": 0},
        "questions": {"type": "array", "max": 80, "of": {"type": "object", "required": ["text"], "props": {"number": {"type": "string", "max": 20, "default": ""}, "text": {"type": "string", "max": 2000}, "maxMarks": {"type": "number", "min": 0, "max": 200, "default": 0}}}},
    },
}
_EXAM = "title string, subject string, totalMarks double, questions array<struct<number:string,text:string,maxMarks:double>>"


def read_exams(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exams, questions) from a model's readings of question papers.

    found: exam_id, raw. exams: exam_id, title, subject, declared_total (null
    unless positive), error (why nothing could be read, or null). questions:
    exam_id, ord, number, text, max_marks, ready for exam.validated_questions;
    marks of 0 and blank numbers are missing.
    """
    read = checkpointed(replies.recover_replies(found.select("exam_id", "raw"), EXAM_SCHEMA).select("exam_id", F.from_json("value", _EXAM).alias("e"), "error"))
    exams = read.select("exam_id", "e.title", "e.subject", F.when(F.col("e.totalMarks") > 0, F.col("e.totalMarks")).alias("declared_total"), "error")
    each = read.select("exam_id", F.posexplode("e.questions").alias("pos", "q"))
    number = F.when(F.trim("q.number") != "", F.trim("q.number"))
    return exams, each.select("exam_id", (F.col("pos") + 1).alias("ord"), number.alias("number"), F.col("q.text").alias("text"), F.when(F.col("q.maxMarks") > 0, F.col("q.maxMarks")).alias("max_marks"))


REPLY_SCHEMA = {
    "type": "object", "required": ["marksAwarded"],
    "props": {
        "marksAwarded": {"type": "number", "min": 0}, "grounding": {"type": "string", "enum": [assess.REFERENCE, assess.GENERAL, assess.INSUFFICIENT], "default": assess.GENERAL}, "relevant": {"type": "boolean", "default": True},
        "annotations": {"type": "array", "max": 12, "of": {"type": "object", "required": ["text"], "props": {
            "text": {"type": "string", "max": 400}, "type": {"type": "string", "enum": ["correct", "partial", "wrong", "missing"], "default": "partial"},
            "marks": {"type": "string", "default": ""}, "confidence": {"type": "string", "default": ""}, "evidenceId": {"type": "string", "default": ""}}}},
    },
}
_REPLY = "marksAwarded double, grounding string, relevant boolean, annotations array<struct<text:string,type:string,marks:string,confidence:string,evidenceId:string>>"


def assess_questions(found: DataFrame, questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_key, marks_awarded, grounding, n_cited, confidence, failed, error: a model's replies held against limits and evidence.

    found: question_key, raw. questions: question_key, max_marks, detection.
    evidence: question_key, chunk_id. A question without a readable reply has
    failed, with 0 marks, no confidence and nothing to rest on. Marks are
    clamped, citations of evidence that isn't there count for nothing.
    """
    read = checkpointed(replies.recover_replies(found.select("question_key", "raw"), REPLY_SCHEMA).select("question_key", F.from_json("value", _REPLY).alias("e"), "error"))
    notes = read.select("question_key", F.posexplode("e.annotations").alias("ann_ord", "a")).select(
        "question_key", "ann_ord", F.col("a.type").alias("type"), F.col("a.marks").try_cast("double").alias("marks"), F.col("a.confidence").try_cast("double").alias("confidence"), F.col("a.evidenceId").alias("evidence_id")
    )
    known = questions.join(read, "question_key", "left")
    failed = F.col("e").isNull()
    marks = known.select("question_key", F.when(failed, 0.0).otherwise(clamp(F.col("e.marksAwarded"), 0.0, F.coalesce("max_marks", F.lit(0.0)))).alias("marks_awarded"), failed.alias("failed"), F.when(failed, F.coalesce("error", F.lit("no reply"))).alias("error"))
    reported = known.select("question_key", F.coalesce("e.grounding", F.lit(assess.INSUFFICIENT)).alias("reported"))
    grounds = assess.resolved_grounding(reported, assess.checked_citations(notes, evidence), evidence)
    asked = known.join(grounds.select("question_key", "grounding"), "question_key").select("question_key", "detection", "grounding", F.coalesce("e.relevant", F.lit(True)).alias("relevant"))
    confidence = assess.question_confidence(notes, asked)
    joined = marks.join(grounds.select("question_key", "grounding", "n_cited"), "question_key").join(confidence, "question_key")
    return joined.select("question_key", "marks_awarded", "grounding", "n_cited", F.when(F.col("failed"), 0.0).otherwise(F.col("confidence")).alias("confidence"), "failed", "error")


def match_answers(doc_lines: DataFrame, questions: DataFrame, papers: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """paper_id, question_id, number, answer_text, line_ids, confidence, method, skipped: an answer, found or not, for every question of every paper.

    doc_lines: paper_id, line_id, line_index, page, text. questions: exam_id,
    question_id, ord, number, text, max_marks. papers: paper_id, exam_id.
    proposals: paper_id, exam_id, prop_ord, question_number, line_ids, of a
    model, for questions without an answer. Labels and contents come first, then
    proposals of lines that nobody claimed. A question without an answer is
    skipped, with confidence 0. An answer too short for its marks is skipped,
    and one that a model placed but that shares no words with its question is
    little trusted.
    """
    once = papers.select("paper_id", "exam_id").distinct()
    docs = doc_lines.select(F.col("paper_id").alias("doc_id"), "line_id", "line_index", "page", "text")
    keys = questions.groupBy("exam_id").agg(F.array_sort(F.collect_set(label_key(F.col("number")))).alias("keys"))
    blocks = checkpointed(segment.question_blocks(docs, once.join(keys, "exam_id").select(F.col("paper_id").alias("doc_id"), "keys")))
    own = blocks.join(once.withColumnRenamed("paper_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("paper_id"), "exam_id", F.col("head_index").alias("block_ord"), F.col("question_number").alias("label"), F.col("answer_text").alias("text"))
    placed = checkpointed(align.align_questions(own, questions).join(blocks.select(F.col("doc_id").alias("paper_id"), F.col("head_index").alias("block_ord"), F.col("answer_line_ids").alias("line_ids")), ["paper_id", "block_ord"]).where(F.size("line_ids") > 0))
    taken = placed.select("paper_id", "question_id", "line_ids", "confidence", "method")
    if proposals is not None:
        claimed = placed.select("paper_id", F.explode("line_ids").alias("line_id"))
        taken = taken.unionByName(match.apply_proposals(proposals, questions, doc_lines, claimed, placed.select("paper_id", "question_id")))
    taken = checkpointed(taken)
    wanted = taken.select(F.struct("paper_id", "question_id").alias("answer_id"), "paper_id", F.explode("line_ids").alias("line_id"))
    texts = lines.lines_to_text(wanted, doc_lines, ["paper_id"]).select("answer_id.paper_id", "answer_id.question_id", F.col("text").alias("answer_text"))
    asked = once.join(questions.select("exam_id", "question_id", "number", F.col("text").alias("question_text"), "max_marks"), "exam_id")
    joined = asked.join(taken, ["paper_id", "question_id"], "left").join(texts, ["paper_id", "question_id"], "left")
    answer = F.coalesce("answer_text", F.lit(""))
    found = F.col("method").isNotNull()
    short = ~found | is_too_short(answer, F.col("max_marks"))
    foreign = (F.col("method") == "model") & (F.char_length(normalize_text(answer)) >= OVERLAP_CHARS) & (token_overlap(F.col("question_text"), answer) < LEAST_OVERLAP)
    confidence = F.when(~found, 0).when(short | foreign, F.least("confidence", F.lit(WEAK))).otherwise(F.col("confidence"))
    return joined.select(
        "paper_id", "question_id", "number", answer.alias("answer_text"), F.coalesce("line_ids", F.array().cast("array<string>")).alias("line_ids"),
        confidence.cast("int").alias("confidence"), F.coalesce("method", F.lit("none")).alias("method"), short.alias("skipped"),
    )


def assess_papers(marks: DataFrame, groups: DataFrame, evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """questions, totals and warnings of marked papers: marks clamped, choices applied, sums taken; never a total that a model gave.

    marks: paper_id, question_id, ord, number, max_marks, marks_awarded,
    skipped, failed, confidence. groups: see choice.rank_choice. evidence:
    paper_id, question_id, grounding. `warnings` has a row per question that
    failed (failed) or does not count (dropped), and per paper whose questions
    all miss the reference (no_reference): paper_id, kind, question_id, detail.
    """
    clean = assess.clamped_marks(marks)
    ranked = choice.rank_choice(clean, groups)
    counted = checkpointed(choice.counted_marks(clean, ranked))
    failed = counted.where("failed").select("paper_id", F.lit("failed").alias("kind"), "question_id", F.lit("left unmarked, enter a mark by hand").alias("detail"))
    dropped = choice.dropped_questions(ranked).select("paper_id", F.lit("dropped").alias("kind"), "question_id", F.col("reason").alias("detail"))
    warnings = failed.unionByName(dropped)
    if evidence is not None:
        used = evidence.groupBy("paper_id").agg(F.count_if(F.col("grounding") == assess.REFERENCE).alias("n")).where("n = 0")
        warnings = warnings.unionByName(used.select("paper_id", F.lit("no_reference").alias("kind"), F.lit(None).cast("string").alias("question_id"), F.lit("no question was settled by the reference").alias("detail")))
    return {"questions": counted, "totals": assess.paper_totals(counted), "warnings": warnings}


def evaluations(counted: DataFrame, answers: DataFrame) -> DataFrame:
    """paper_id, question_id, ord, marks_awarded, max_marks, counted, status, quality: marked questions as the report reads them.

    counted: see assess_papers. answers: paper_id, question_id, answer_text,
    has_unassigned_writing; a question without a row has an empty answer.
    """
    joined = counted.join(answers.select("paper_id", "question_id", "answer_text", "has_unassigned_writing"), ["paper_id", "question_id"], "left")
    status = answer_status(F.col("failed"), F.col("skipped"), F.col("answer_text"), F.col("confidence"), F.coalesce("has_unassigned_writing", F.lit(False)))
    return joined.select("paper_id", "question_id", "ord", "marks_awarded", "max_marks", "counted", status.alias("status"), point_quality(F.col("marks_awarded"), F.col("max_marks")).alias("quality"))


def exam_warnings(questions: DataFrame, validated: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """exam_id, kind, number, detail, blocking: what is odd about how an exam was read, one row each.

    questions: exam_id, ord, number, text, max_marks. validated: see
    exam.validated_questions, with `read` and `printed`. choices: exam_id,
    description. Kinds: mark_conflict, duplicate_number, missing_marks (blocks),
    choice, no_questions (blocks).
    """
    row = lambda df, kind, number, detail, blocking=False: df.select("exam_id", F.lit(kind).alias("kind"), number.alias("number"), detail.alias("detail"), F.lit(blocking).alias("blocking"))
    nothing = F.lit(None).cast("string")
    conflicts = row(validated.where("mark_conflict"), "mark_conflict", F.col("number"), F.concat(F.col("read").cast("string"), F.lit(" read, "), F.col("printed").cast("string"), F.lit(" printed")))
    seen = Window.partitionBy("exam_id", "number").orderBy("ord")
    again = validated.withColumn("k", F.row_number().over(seen)).where("k = 2")
    found = conflicts.unionByName(row(again, "duplicate_number", F.col("number"), nothing))
    missing = validated.where("max_marks is null").groupBy("exam_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    found = found.unionByName(row(missing, "missing_marks", nothing, F.col("n"), True))
    empty = questions.select("exam_id").distinct().join(validated.select("exam_id").distinct(), "exam_id", "left_anti")
    found = found.unionByName(row(empty, "no_questions", nothing, nothing, True))
    return found if choices is None else found.unionByName(row(choices, "choice", nothing, F.col("description")))
