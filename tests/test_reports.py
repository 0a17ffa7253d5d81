"""Reports, whole stages, retrieval of the best passages, key states, uploads and histories."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text
from gradeloom.operators import align, budget, match, model, report, retrieval, review, stages
from gradeloom.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_verdicts_and_bands(spark):
    given = [(40.0, 100.0, 0.0), (39.0, 100.0, 1.0), (39.0, 100.0, 0.5), (0.0, 0.0, 9.0), (None, 10.0, 4.0), (80.0, 100.0, 0.0), (35.0, 100.0, 0.0)]
    found = spark.createDataFrame(given, "a double, t double, p double").select(report.verdict(F.col("a"), F.col("t"), F.col("p")), report.score_band(F.col("a"), F.col("t")))
    assert [tuple(r) for r in found.collect()] == [("pass", "fair"), ("pending", "fair"), ("fail", "fair"), ("fail", "low"), ("fail", "low"), ("pass", "high"), ("fail", "fair")]


def test_badges_and_low_confidence(spark):
    given = [("correct", 2.0, 50.0), ("wrong", 0.0, 60.0), ("odd", -1.5, None), ("missing", None, float("nan")), (None, float("nan"), 1.0)]
    found = spark.createDataFrame(given, "k string, m double, c double").select(report.badge(F.col("k"), F.col("m")), report.is_low(F.col("c")))
    assert [tuple(r) for r in found.collect()] == [("+2", True), ("✗", False), ("~1.5", False), ("!", False), ("~", True)]


def test_reports_of_papers_without_questions(spark):
    totals = spark.createDataFrame([(1, 7.5, 10.0, 75.0, "A"), (2, 0.0, 0.0, 0.0, "F")], "paper_id bigint, total_marks double, maximum_marks double, percentage double, grade string")
    questions = spark.createDataFrame([(1, 2, None, None, 5.0, None), (1, 1, "1", 7.5, 5.0, "Covered well")], "paper_id bigint, ord int, number string, marks_awarded double, max_marks double, label string")
    assert rows(report.printed_report(totals, questions)) == [(1, "7.5 / 10 A", "Q1 7.5/5 Covered well\nQ? 0/5 ", 2), (2, "0 / 0 F", "", 0)]
    assert rows(report.closing_remarks(totals))[0][1].startswith("Scored 7.5 out of 10 (75%), grade A.")
    assert {r.paper_id for r in report.report_json(totals, questions).collect()} == {1, 2}


def test_notes_without_a_place_show_the_head_of_their_quote(spark):
    notes = spark.createDataFrame([(1, 1, "x" * 95), (1, 2, None), (1, 3, "short")], "paper_id int, span_id int, quote string")
    boxes = spark.createDataFrame([(1, 3), (1, 3)], "paper_id int, span_id int")
    assert rows(report.unpinned_notes(notes, boxes, ["paper_id", "span_id"]).select("span_id", "shown")) == [(1, "x" * 90 + "…"), (2, "")]


def test_the_best_passages_are_those_of_all_scores(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    pick = lambda n: " ".join(random.choices(words, weights=[1 / (i + 1) for i in range(40)], k=n))
    chunks = spark.createDataFrame([(f"c{i}", pick(random.randint(0, 30)) if i else None) for i in range(150)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, pick(random.randint(0, 7))) for i in range(60)] + [(90, None), (91, "nothing known")], "query_id int, query string")
    whole = retrieval.top_evidence(retrieval.bm25_scores(queries, chunks), 3)
    best = retrieval.bm25_top(queries, chunks, 3)
    key = lambda df: sorted((r.query_id, r.rk, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(whole) == key(best) and whole.count() > 100
    assert retrieval.bm25_top(queries, chunks.where("false"), 3).count() == 0


def test_scopes_are_corpora_of_their_own(spark):
    chunks = spark.createDataFrame([(1, "a", "light heat"), (1, "b", "heat heat"), (2, "a", "light")], "exam int, chunk_id string, text string")
    queries = spark.createDataFrame([(1, "q", "light"), (2, "q", "heat"), (3, "q", "light")], "exam int, query_id string, query string")
    assert [(r.exam, r.chunk_id) for r in retrieval.bm25_within(queries, chunks, "exam", 2).collect()] == [(1, "a")]


@pytest.mark.parametrize("block", [3, 100])
def test_vectors_agree_with_brute_force(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (40, 4)).astype(float)
    given = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(90, None), (91, []), (92, [1.0]), (93, [0.0] * 4)]
    table = spark.createDataFrame(given, "chunk_id bigint, embedding array<double>")
    queries = table.where("chunk_id < 10 or chunk_id >= 90").withColumnRenamed("chunk_id", "query_id")
    found = {}
    for r in retrieval.VectorRetriever(table, block).search(queries, 3).orderBy("query_id", "rk").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    length = np.linalg.norm(vectors, axis=1)
    for q in range(10):
        if length[q]:
            scores = [(-round(float(vectors[q] @ v / length[q] / n), 12), i) for i, (v, n) in enumerate(zip(vectors, length)) if n]
            assert found[q] == [i for _, i in sorted(scores)[:3]]
    assert set(found) == {q for q in range(10) if length[q]}


def test_key_states_follow_events():
    k = budget.after(budget.KeyState(), budget.KeyEvent("reserve", 0, 3000))
    assert budget.room(k) == 5000 and k.in_flight == k.calls == 1
    assert budget.after(k, budget.KeyEvent("reply", 1, 3000, 200)) == budget.KeyState(remaining=5000, calls=1)
    refused = budget.after(k, budget.KeyEvent("reply", 1, 3000, 429))
    assert (refused.remaining, refused.reset_at, refused.refusals) == (0, 1 + budget.DEFAULT_WAIT_MS, 1)
    assert budget.after(refused, budget.KeyEvent("look", refused.reset_at)).remaining == 8000
    told = budget.after(k, budget.KeyEvent("reply", 1, 3000, 429, remaining=70, reset_ms=9, retry_ms=500))
    assert (told.remaining, told.reset_at) == (70, 501)
    assert budget.after(k, budget.KeyEvent("reply", 1, 3000, 401)).dead and budget.room(budget.KeyState(dead=True)) == 0
    assert budget.after(k, budget.KeyEvent("reply", 1, 3000, 500)).remaining == 8000
    assert budget.decide([], 1, 0, 9).value == 500 and budget.decide([budget.KeyState()], 9000, 0, 9).value == 413


def test_models_are_asked_again_when_busy_only(spark):
    def moody(prompt):
        raise model.Busy(0.01) if prompt == "busy" else ValueError("bad")

    prompts = spark.createDataFrame([(1, "busy"), (2, "x"), (3, None)], "id int, prompt string")
    found = {r.id: (r.raw, r.failure) for r in model.ask(prompts, moody, attempts=2).collect()}
    assert found == {1: (None, "Busy: busy, again in 0.01 s"), 2: (None, "ValueError: bad"), 3: (None, None)}


def test_uploads_are_decided(spark):
    given = [(1, "a.pdf", "2024-01-01", 20), (1, "b.PDF", "2024-01-02", 20), (1, "c.docx", "2024-01-01", 9), (1, "d.docx", "2024-01-03", 9), (1, "e.doc", "2024-01-01", 1), (1, "f.xyz", "2024-01-01", 1), (1, "g", None, None)]
    found = files.decided_uploads(spark.createDataFrame(given, "owner int, path string, modificationTime string, n_pages int"), "owner")
    assert {r.path: (r.decision, r.pages_kept, r.pages_cut) for r in found.collect()} == {
        "a.pdf": ("read", 20, 0), "b.PDF": ("read", 10, 10), "c.docx": ("replaced", 0, 0), "d.docx": ("read", 0, 0), "e.doc": ("legacy", 0, 0), "f.xyz": ("unsupported", 0, 0), "g": ("unsupported", 0, 0),
    }


def test_histories_are_appended(spark, tmp_path):
    path = str(tmp_path / "history")
    row = lambda p, t, s: [(7, p, t, 1.0, s)]
    for p, t, s in [(1, 1, 5.0), (2, 2, 6.0), (1, 9, 8.0), (3, 3, None)]:
        review.append_history(spark.createDataFrame(row(p, t, s), "student_id int, paper_id int, taken_at int, ai_score double, score double"), path)
    assert [(r.paper_id, r.rank, r.score) for r in review.recent_history(spark.read.parquet(path), 2).orderBy("rank").collect()] == [(1, 1, 8.0), (3, 2, None)]


LINES = "paper_id bigint, line_id string, line_index int, page int, text string"


def test_answers_are_matched_from_labels_and_proposals(spark):
    own = spark.createDataFrame([(1, "L1", 0, 1, "1. Heat moves from the warm body"), (1, "L2", 1, 1, "to the cold one."), (1, "L3", 2, 1, "3) Ice"), (1, "L4", 3, 1, "is water that froze."), (2, "L1", 0, 1, "The leaf makes food from the light of day.")], LINES)
    questions = spark.createDataFrame([(5, "q1", 1, "1", "What is heat?", 4.0), (5, "q2", 2, "2", "Define osmosis.", 2.0), (5, "q3", 3, "3", "What is ice?", None)], "exam_id int, question_id string, ord int, number string, text string, max_marks double")
    papers = spark.createDataFrame([(1, 5), (2, 5), (2, 5)], "paper_id bigint, exam_id int")
    proposals = spark.createDataFrame([(2, 5, 1, "Q2", ["L1", "L9"]), (1, 5, 1, "Q1", ["L1"])], "paper_id bigint, exam_id int, prop_ord bigint, question_number string, line_ids array<string>")
    found = {(r.paper_id, r.question_id): (r.method, r.confidence, r.skipped, r.line_ids) for r in stages.match_answers(own, questions, papers, proposals).collect()}
    assert found[1, "q1"] == ("label", 95, False, ["L1", "L2"]) and found[1, "q3"] == ("label", 95, False, ["L3", "L4"])
    assert found[1, "q2"] == ("none", 0, True, []) and found[2, "q2"] == ("model", 40, False, ["L1"]) and len(found) == 6


def test_documents_without_labels_are_one_question(spark):
    docs = spark.createDataFrame([("a", "L1", 0, 1, "Heat moves."), ("a", "L2", 1, 1, None), ("b", "L1", 0, 1, "1. What is ice? (3 marks)"), ("b", "L2", 1, 1, "It is water."), ("b", "L3", 2, 1, "2. What is heat?"), ("b", "L4", 3, 1, "Energy.")], "doc_id string, line_id string, line_index int, page int, text string")
    totals = spark.createDataFrame([("a", 10), ("b", 10)], "doc_id string, total bigint")
    found = {(r.doc_id, r.question_number): (r.answer_text, r.max_marks) for r in stages.segment_papers(docs, totals).collect()}
    assert found == {("a", "1"): ("Heat moves.\n", 10.0), ("b", "1"): ("It is water.", 3.0), ("b", "2"): ("Energy.", 7.0)}


def test_warnings_of_exams_and_papers(spark):
    marks = spark.createDataFrame([(1, "q1", 1, "1", 5.0, 9.0, False, False, 80.0), (1, "q2", 2, "2", 5.0, 1.0, False, True, 80.0), (1, "q3", 3, "3", 5.0, 2.0, True, False, None)], "paper_id int, question_id string, ord int, number string, max_marks double, marks_awarded double, skipped boolean, failed boolean, confidence double")
    groups = spark.createDataFrame([(1, 1, 1, n, i) for i, n in enumerate("12")], "paper_id int, group_id int, required int, number string, member_ord int")
    grounds = spark.createDataFrame([(1, "q1", "GENERAL")], "paper_id int, question_id string, grounding string")
    found = stages.assess_papers(marks, groups, grounds)
    assert rows(found["warnings"].select("kind", "question_id")) == [("dropped", "q2"), ("failed", "q2"), ("no_reference", None)]
    assert found["totals"].first().total_marks == 7.0 and found["totals"].first().maximum_marks == 10.0


def test_keys_without_numbers_are_searched(spark):
    body = " ".join(f"Passage {i} tells of {w}, and it goes on for a while so that the key is long enough to be cut into parts by sentences." for i, w in enumerate(["osmosis", "glaciers", "magnets", "photosynthesis"] * 6))
    keys = spark.createDataFrame([(1, body), (2, "short"), (3, " ")], "exam_id int, text string")
    sections = spark.createDataFrame([], "exam_id int, head_index int, label string, text string")
    questions = spark.createDataFrame([(e, "q1", 1, "1", "What do magnets do?") for e in (1, 2, 3)] + [(1, "q2", 2, "2", "zzz")], "exam_id int, question_id string, ord int, number string, text string")
    found = {(r.exam_id, r.question_id): r for r in align.answer_key_sections(keys, sections, questions).collect()}
    assert found[1, "q1"].scope == "retrieved" and "magnets" in found[1, "q1"].text and len(found[1, "q1"].text) <= 1800
    assert (found[2, "q1"].scope, found[2, "q1"].text, found[3, "q1"].scope) == ("whole", "short", "none")


def test_the_last_of_equal_questions_has_the_key(spark):
    questions = spark.createDataFrame([(1, f"q{i}", "4", i) for i in (2, 9, 10)], "exam_id int, question_id string, number string, ord int")
    lines = spark.createDataFrame([(1, "L1", 0)], "paper_id bigint, line_id string, line_index int")
    proposals = spark.createDataFrame([(1, 1, 1, "Q4", ["L1"])], "paper_id bigint, exam_id int, prop_ord int, question_number string, line_ids array<string>")
    none, assigned = spark.createDataFrame([], "paper_id bigint, line_id string"), spark.createDataFrame([], "paper_id bigint, question_id string")
    assert [r.question_id for r in match.apply_proposals(proposals, questions, lines, none, assigned).collect()] == ["q10"]
    taken = spark.createDataFrame([(1, "q10")], "paper_id bigint, question_id string")
    assert match.apply_proposals(proposals, questions, lines, none, taken).count() == 0


def test_white_space_and_hashes(spark):
    found = spark.createDataFrame([("  a　﻿",), (" ",), ("x\U0001f600",)], "t string").select(text.trimmed(F.col("t")), text.word_count(F.col("t")), text.djb2(F.col("t"))).collect()
    assert [r[0] for r in found] == ["a", "", "x\U0001f600"] and [r[1] for r in found] == [1, 0, 1]
    h = 5381
    for unit in (0x78, 0xD83D, 0xDE00):
        h = (h * 33 + unit) % 2**32
    assert found[2][2] == h


def test_exams_are_read_from_replies(spark):
    raw = [(1, '{"title": "T", "totalMarks": "20", "questions": [{"number": " 1 ", "text": "What?", "maxMarks": 5}, {"text": "Why?"}, {"number": "3"}]}'), (2, "no"), (3, None)]
    exams, questions = stages.read_exams(spark.createDataFrame(raw, "exam_id int, raw string"))
    assert [(r.exam_id, r.declared_total, r.error is None) for r in exams.orderBy("exam_id").collect()] == [(1, 20.0, True), (2, None, False), (3, None, False)]
    assert rows(questions) == [(1, 1, "1", "What?", 5.0), (1, 2, None, "Why?", None)]


def test_replies_are_held_against_limits_and_evidence(spark):
    raw = [("a", '{"marksAwarded": 999, "grounding": "REFERENCE", "annotations": [{"text": "x", "evidenceId": "c9", "confidence": 40}, {"text": "y", "confidence": "60"}]}'), ("b", "?"), ("z", "{}")]
    questions = spark.createDataFrame([("a", 2.0, None), ("b", 3.0, 80.0), ("c", 4.0, 80.0)], "question_key string, max_marks double, detection double")
    evidence = spark.createDataFrame([("a", "c1")], "question_key string, chunk_id string")
    found = {r.question_key: (r.marks_awarded, r.grounding, r.n_cited, r.confidence, r.failed) for r in stages.assess_questions(spark.createDataFrame(raw, "question_key string, raw string"), questions, evidence).collect()}
    assert found == {"a": (2.0, "GENERAL", 0, 50.0, False), "b": (0.0, "INSUFFICIENT", 0, 0.0, True), "c": (0.0, "INSUFFICIENT", 0, 0.0, True)}
