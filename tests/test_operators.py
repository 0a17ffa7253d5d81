import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import align, assess, budget, choice, exam, images, lines, match, placement, replies, retrieval, review, segment
from gradeloom.plans import catalog


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_offsets_point_into_the_joined_document(spark):
    pages = [(1, 1, "  First line\n\n second\r\nthird "), (1, 2, None), (1, 3, "last"), (2, 1, " \n ")]
    found = lines.structure_pages(spark.createDataFrame(pages, "doc_id int, page int, text string")).collect()
    joined = "First line\n\n second\nthird" + "\n\n" + "" + "\n\n" + "last"
    assert [r.text for r in sorted(found, key=lambda r: r.line_index)] == ["First line", "second", "third", "last"]
    assert all(joined[r.start_char : r.end_char] == r.text and r.line_id == f"L{r.line_index + 1}" for r in found)


def test_quality_flags(spark):
    given = [(1, "[illegible] x", 0.4), (1, "ok", None), (2, "a clean and long line of text", 0.9), (2, "another clean and long line", 0.9), (2, "and a third clean long line", 0.9)]
    found = {r.doc_id: r for r in lines.document_quality(spark.createDataFrame(given, "doc_id int, text string, confidence double")).collect()}
    assert found[1].flags == ["illegible_regions", "fragmented_lines", "low_ocr_quality", "very_short_document"] and found[2].flags == []
    assert round(found[1].score, 6) == 0.4 and round(found[2].score, 6) == 0.9


def test_text_of_wanted_lines(spark):
    own = spark.createDataFrame([(1, "L1", 0, "one"), (1, "L2", 1, "two"), (1, "L3", 2, None)], "p int, line_id string, line_index int, text string")
    wanted = spark.createDataFrame([(7, 1, "L3"), (7, 1, "L2"), (7, 1, "L2"), (8, 1, "L9")], "answer_id int, p int, line_id string")
    assert rows(lines.lines_to_text(wanted, own, ["p"])) == [(7, "two\n")]


def test_blocks_carry_numbers_and_parents(spark):
    script = ["1. What is a cell?", "It is the unit of life.", "2.", "(a) A leaf makes food by light", "and water.", "(b) Roots take in water", "Q. 3(a) Explain the stem. (4 marks)", "It carries water up."]
    own = spark.createDataFrame([(1, f"L{i + 1}", i, 1, t) for i, t in enumerate(script)], "doc_id int, line_id string, line_index int, page int, text string")
    found = {r.question_number: r for r in segment.question_blocks(own).collect()}
    assert set(found) == {"1", "2(a)", "2(b)", "3(a)"}
    assert found["1"].question_text == "What is a cell?" and found["1"].answer_text == "It is the unit of life."
    assert found["2(a)"].answer_text == "A leaf makes food by light\nand water." and found["2(a)"].parent_number == "2"
    assert found["3(a)"].max_marks == 4 and found["3(a)"].question_text == "Explain the stem." and found["3(a)"].answer_line_ids == ["L8"]


RULES = [
    ("Answer any THREE of the following five questions.", 3, 5), ("Attempt any 5", 5, None), ("Do any two questions from Section B", 2, None), ("Attempt any 3 of the following 5", 3, 5), ("any time now", None, None), ("Answer all", None, None),
]


@pytest.mark.parametrize("text, required, of", RULES)
def test_attempt_rules(spark, text, required, of):
    found = choice.attempt_rules(spark.createDataFrame([(1, 0, text)], "doc_id int, line_index int, text string")).collect()
    assert [(r.required, r.of) for r in found] == ([(required, of)] if required else [])


def marks_of(spark, awarded, failed=()):
    given = [(1, f"q{i}", i, str(i), 5.0, a, a is None, i in failed, "clash") for i, a in enumerate(awarded, 1)]
    return spark.createDataFrame(given, "paper_id int, question_id string, ord int, number string, max_marks double, marks_awarded double, skipped boolean, failed boolean, group_id string")


def groups_of(spark, required, n):
    return spark.createDataFrame([(1, 9, required, f"Q. {i}", i) for i in range(1, n + 1)], "paper_id int, group_id int, required int, number string, member_ord int")


@pytest.mark.parametrize("awarded, failed, required, total", [([5.0, 4.0, 3.0, 2.0, 1.0], (), 3, (12, 15)), ([5.0, 4.0, None, None, None], (), 3, (9, 15)), ([5.0, 4.0, 3.0, 2.0, 1.0], (), 5, (15, 25))])
def test_best_of_a_group(spark, awarded, failed, required, total):
    m = marks_of(spark, awarded, failed)
    sums = choice.choice_totals(choice.counted_marks(m, choice.rank_choice(m, groups_of(spark, required, 5)))).first()
    assert (sums.total_marks, sums.maximum_marks, sums.printed_marks) == (*total, 25)


def test_a_failed_attempt_outranks_a_zero_and_first_keeps_the_order(spark):
    m = marks_of(spark, [0.0, 0.0, 2.0], failed=(2,))
    kept = lambda prefer: {r.question_id for r in choice.rank_choice(m, groups_of(spark, 2, 3), prefer).where("kept").collect()}
    assert kept("best") == {"q2", "q3"} and kept("first") == {"q1", "q2"}


def allocate(marks, total):
    """Brute force of the largest remainders."""
    if not total or total <= 0:
        return [10.0 if m is None else m for m in marks]
    known = [m for m in marks if m and m > 0]
    if len(known) == len(marks):
        if sum(known) == total:
            return [float(m) for m in marks]
        exact = [m * (total / sum(known)) for m in marks]
    else:
        share = max(0, total - sum(known)) / (len(marks) - len(known))
        exact = [m if m and m > 0 else share for m in marks]
    out = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(marks)), key=lambda i: (-(exact[i] - math.floor(exact[i])), i))
    k = 0
    while sum(out) < total:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out) > total and max(out) > 1:
        for i in reversed(range(len(out))):
            if out[i] > 1:
                out[i] -= 1
                if sum(out) == total:
                    break
    return [float(x) for x in out]


def test_allocation_agrees_with_brute_force(spark):
    random.seed(5)
    cases = [([random.choice([None, 1.0, 2.0, 3.0, 7.0]) for _ in range(random.randint(1, 7))], random.choice([None, 0, 3, 5, 12, 40])) for _ in range(60)]
    given = [(e, f"q{i}", i, m, t) for e, (ms, t) in enumerate(cases) for i, m in enumerate(ms)]
    found = exam.allocate_marks(spark.createDataFrame(given, "exam_id int, question_id string, ord int, max_marks double, total bigint"))
    by_exam: dict = {}
    for r in found.orderBy("exam_id", "ord").collect():
        by_exam.setdefault(r.exam_id, []).append(r.marks)
    assert [by_exam[e] for e in range(len(cases))] == [allocate(ms, t) for ms, t in cases]


def test_bm25_agrees_with_brute_force(spark):
    texts = ["cells divide and grow", "plants grow by light", "the light of stars", "", "cells cells cells", "roots of plants hold water"]
    queries = ["how do cells grow", "light for plants", "unknown words only", ""]
    chunks = spark.createDataFrame([(f"c{i}", t, i) for i, t in enumerate(texts)], "chunk_id string, text string, query_id int")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    stems = [[align.stem_of(w) for w in t.split() if w not in align._STOP and len(w) > 1] for t in texts]
    mean, n = sum(map(len, stems)) / len(stems), len(texts)
    expected = {}
    for q, text in enumerate(queries):
        for term in align.stems_of(text):
            df = sum(term in s for s in stems)
            for c, s in enumerate(stems):
                f = s.count(term)
                if f:
                    expected[q, f"c{c}"] = expected.get((q, f"c{c}"), 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(s) / mean))
    found = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25_scores(asked, chunks).collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    top = retrieval.Bm25Retriever(chunks).search(asked, 1)
    assert {r.query_id for r in top.collect()} == {0, 1}


def test_passages_repeat_one_sentence():
    text = " ".join(f"Sentence {i} has exactly seven words here." for i in range(40))
    found = retrieval.cut_passages(text)
    assert [k for k, _ in found] == list(range(1, len(found) + 1))
    assert all(b.startswith(a[a.rindex("Sentence") :]) for (_, a), (_, b) in zip(found, found[1:]))
    assert retrieval.cut_passages("One short line") == [(1, "One short line")] and retrieval.cut_passages(None) == []


QUESTIONS = [("q1", "1", "define the cell and its parts"), ("q2", "2(a)", "explain how light makes food"), ("q3", "2(b)", "describe the flow of water in roots"), ("q4", "3", "name two stars")]


def test_alignment_by_every_route(spark):
    questions = spark.createDataFrame([(5, q, i, n, t) for i, (q, n, t) in enumerate(QUESTIONS)], "exam_id int, question_id string, ord int, number string, text string")
    given = [(1, "Q.1", "a"), (2, "2 a", "b"), (3, "Q 3(a)", "c"), (4, None, "water flows up in the roots of plants and is described here"), (5, "Q1", "again"), (6, "??", None)]
    own = spark.createDataFrame([(9, 5, o, x, t, 0) for o, x, t in given], "paper_id bigint, exam_id int, block_ord int, label string, text string, ord int")
    found = {r.block_ord: (r.question_id, r.confidence) for r in align.align_questions(own, questions).collect()}
    assert found == {1: ("q1", 95), 2: ("q2", 95), 3: ("q4", 88), 4: ("q3", 62)}
    assert {r.block_ord for r in align.align_questions(own, questions, least_content=2.0).collect()} == {1, 2, 3}


def test_runs_of_unmatched_questions(spark):
    given = [(1, 1, "a", None, None, False), (1, 2, "b", 4, 6, True), (1, 3, "c", None, None, False), (1, 4, "d", None, None, False), (1, 5, "e", 9, 9, True), (1, 6, "f", None, None, False)]
    runs = match.unmatched_runs(spark.createDataFrame(given, "paper_id int, ord int, question_id string, first_index int, last_index int, matched boolean"))
    assert sorted((r.question_ids, r.after_index, r.before_index) for r in runs.collect()) == [("a", -1, 4), ("c,d", 6, 9), ("f", 9, None)]
    free = spark.createDataFrame([(1, f"L{i}", i) for i in (0, 7, 8)], "paper_id int, line_id string, line_index int")
    found = Counter(r.run_id for r in match.gap_candidates(runs, free).collect())
    assert found == {0: 1, 1: 2, 2: 3}


def test_windows_stay_within_their_budget():
    random.seed(1)
    costs = [random.randint(13, 400) for _ in range(300)]
    windows = list(match.line_windows(costs, 2000))
    assert sorted({i for w in windows for i in w}) == list(range(300))
    assert all(sum(costs[i] for i in w) <= 2000 for w in windows) and all(a[-1] in b for a, b in zip(windows, windows[1:]))
    batches = list(match.question_batches(costs, 800))
    assert [i for b in batches for i in b] == list(range(300)) and all(len(b) <= 8 for b in batches)
    assert list(match.line_windows([])) == []


def test_proposals_claim_in_order(spark):
    questions = spark.createDataFrame([(5, "q9", "1", 8), (5, "q1", "1", 9), (5, "q2", "2", 10)], "exam_id int, question_id string, number string, ord int")
    own = spark.createDataFrame([(9, f"L{i}", i) for i in range(4)], "paper_id bigint, line_id string, line_index int")
    proposals = spark.createDataFrame([(9, 5, 1, "Q1", ["L2", "L1", "L8"]), (9, 5, 2, "Q2", ["L1"]), (9, 5, 3, "Q2", ["L1", "L3"]), (9, 5, 4, "Q7", ["L3"])], "paper_id bigint, exam_id int, prop_ord int, question_number string, line_ids array<string>")
    claimed = spark.createDataFrame([(9, "L0")], "paper_id bigint, line_id string")
    none = spark.createDataFrame([], "paper_id bigint, question_id string")
    assert rows(match.apply_proposals(proposals, questions, own, claimed, none).select("question_id", "line_ids")) == [("q1", ["L1", "L2"]), ("q2", ["L3"])]


def test_annotation_marks_must_be_possible(spark):
    given = [(1, 1, "correct", 3.0, 2.0), (1, 2, "wrong", None, 2.0), (2, 1, "correct", None, 2.0), (2, 2, "wrong", None, 2.0), (3, 1, "correct", None, 2.0), (3, 2, "partial", None, 2.0)]
    found = assess.consistent_annotation_marks(spark.createDataFrame(given, "question_key int, ann_ord int, type string, marks double, awarded double"))
    assert [r.fixed_marks for r in found.orderBy("question_key", "ann_ord").collect()] == [None, None, 2.0, None, None, None]


def test_confidence_is_the_weakest_link(spark):
    notes = spark.createDataFrame([(1, 40.0), (1, 60.0), (2, None), (3, 90.0)], "question_key int, confidence double")
    asked = spark.createDataFrame([(1, 95.0, "REFERENCE", True), (2, 70.0, "GENERAL", True), (3, None, "INSUFFICIENT", True), (4, None, "GENERAL", False)], "question_key int, detection double, grounding string, relevant boolean")
    assert rows(assess.question_confidence(notes, asked)) == [(1, 50.0), (2, 70.0), (3, 65.0), (4, 55.0)]


def test_annotations_keep_their_places(spark):
    text = "Plants make food. Plants make food. Roots drink."
    answers = spark.createDataFrame([(1, text), (2, None)], "answer_id int, text string")
    notes = spark.createDataFrame([(1, 0, "Plants make food", "correct"), (1, 1, "plants make food", "wrong"), (1, 2, "x", "correct"), (1, 3, "Roots drink", "missing"), (2, 0, "Plants", "correct")], "answer_id int, ann_ord int, quote string, type string")
    found = placement.anchor_annotations(answers, notes)
    assert rows(found) == [(1, 0, 0, 16, True), (1, 1, 18, 34, False)]
    pieces = placement.text_segments(answers.where("answer_id = 1"), found).orderBy("seg_start").collect()
    assert "".join(p.text for p in pieces) == text and [p.ann_ord for p in pieces] == [0, None, 1, None]


def test_bands_meet_lines_by_place(spark):
    own = spark.createDataFrame([(1, p, f"L{p}{i}", i) for p, n in ((1, 2), (2, 5), (3, 6), (4, 1)) for i in range(n)], "doc_id int, page int, line_id string, line_index int")
    bands = spark.createDataFrame([(1, p, i / 10, i / 10 + 0.05, 0.1, 0.9) for p, n in ((1, 2), (2, 4), (3, 2)) for i in range(n)], "doc_id int, page int, top double, bottom double, left double, right double")
    placed = placement.align_bands(own, bands)
    assert {r.page: r.tier for r in placed.collect()} == {1: "high", 2: "medium", 3: "low", 4: "none"}
    assert [round(r.bbox.y * 10) for r in placed.where("page = 2").orderBy("line_id").collect()] == [0, 0, 1, 2, 3]
    assert placement.worst_tier(placement.page_tiers(placed), ["doc_id"]).first().tier == "none"


def test_overrides_clamp_and_do_not_repeat_the_proposal(spark):
    m = marks_of(spark, [2.0, 3.0, None])
    typed = spark.createDataFrame([(1, "q1", 99.0), (1, "q2", 3.0), (1, "q3", None)], "paper_id int, question_id string, marks double")
    found = {r.question_id: (r.marks_awarded, r.ai_marks, r.overridden) for r in review.apply_overrides(m, typed).collect()}
    assert found == {"q1": (5.0, 2.0, True), "q2": (3.0, 3.0, False), "q3": (None, None, False)}


REPLIES = [
    ('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ('noise {"a": "}"} more', {"a": "}"}), ('{"a": [1, 2, {"b": 3', {"a": [1, 2]}), ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1]}), ('[1, 2', [1]), ('{"x": [', {"x": []}),
]


@pytest.mark.parametrize("raw, value", REPLIES)
def test_json_is_recovered(raw, value):
    assert replies.extract_json(raw) == value


@pytest.mark.parametrize("raw", ["", None, "no value", "{]"])
def test_no_json(raw):
    with pytest.raises(ValueError):
        replies.extract_json(raw)


def test_coercion():
    schema = {"type": "object", "required": ["n"], "props": {"n": {"type": "number", "min": 0, "max": 5}, "kind": {"type": "string", "enum": ["Good", "Bad"], "default": "Bad"}, "list": {"type": "array", "of": {"type": "number"}, "max": 2, "default": []}}}
    assert replies.coerce({"n": "7 marks", "kind": "good", "list": ["1", "x", 2, 3], "odd": 1}, schema) == {"n": 5, "kind": "Good", "list": [1.0, 2.0]}
    assert replies.coerce({"n": "1e3"}, schema)["n"] == 5 and replies.coerce({"n": "abc"}, schema, strict=False)["n"] == 0.0
    for bad in ({"n": "abc"}, {}, []):
        with pytest.raises(ValueError):
            replies.coerce(bad, schema)


def test_requests_are_priced(spark):
    bodies = ['{"messages": [{"role": "u", "content": "12345678"}], "max_completion_tokens": 3000}', '{"messages": [{"content": [{"type": "text", "text": "1234"}, {"type": "image_url"}]}]}', "{cut", None, "{}"]
    found = spark.createDataFrame([(b,) for b in bodies], "b string").select(budget.request_cost(F.col("b")))
    assert [r[0] for r in found.collect()] == [2 + 3000 + 200, 1 + 1900 + 1000 + 200, 2000, 2000, 1200]


def test_a_request_moves_to_another_key_and_waits_for_a_refill():
    keys = [budget.KeyState(), budget.KeyState()]
    answers = iter([(429, {"reset_ms": 5000}), (200, {})])
    assert budget.replay(keys, 4900, lambda i, now: next(answers)) == (200, 0, [0, 1])
    assert budget.replay(keys, 9000, None) == (413, 0, []) and budget.replay([], 1, None) == (500, 0, [])
    status, waited, used = budget.replay(keys, 4900, lambda i, now: (200, {}))
    assert (status, used) == (200, [0]) and waited == 5150
    dead = [budget.KeyState(dead=True, limit=8000, remaining=0)]
    assert budget.replay(dead, 10, None)[0] == 429


def page(np, width=400, height=560, lines_=12, slope=0.0, ink=30):
    rgba = np.full((height, width, 4), 245, dtype=np.uint8)
    for k in range(lines_):
        for x in range(30, width - 30):
            if (x // 7) % 5:
                y = int(40 + k * 40 + round(slope * (x - width / 2)))
                rgba[y : y + 12, x, :3] = ink
    return rgba


@pytest.mark.parametrize("slope, ink", [(0.0, 30), (0.0, 150), (0.02, 30), (-0.03, 60)])
def test_lines_of_a_page_are_found(slope, ink):
    import numpy as np

    _, skew, bands = images.find_bands(page(np, slope=slope, ink=ink))
    assert len(bands) == 12 and skew == round(math.degrees(math.atan(slope)), 1)


def plain_bands(np, rgba):
    """find_bands pixel by pixel: each slope, each row and each band on its own."""
    height, width = rgba.shape[:2]
    x0, x1, y0, y1 = math.floor(width * 0.015), math.ceil(width * 0.985), math.floor(height * 0.015), math.ceil(height * 0.985)
    grey = (rgba[y0:y1, x0:x1, :3].astype(np.int64) @ np.array([299, 587, 114])) // 1000
    threshold = images.threshold_of(np.bincount(grey.ravel(), minlength=256)[:256])
    ys, xs = np.nonzero(grey <= threshold)
    ys, xs = ys + y0, xs + x0

    def middle(values):
        return float(np.sort(values)[len(values) // 2]) if len(values) else 0.0

    def sheared(slope):
        return ys - np.floor(slope * (xs - (x0 + x1) / 2) + 0.5).astype(np.int64)

    def profile(rows):
        return np.bincount(rows[(rows >= 0) & (rows < height)], minlength=height)

    slope, best = 0.0, -1.0
    for candidate in images.SLOPES if len(xs) >= 100 else ():
        score = float((profile(sheared(candidate)).astype(float) ** 2).sum())
        if score > best * 1.002:
            slope, best = candidate, score
    rows = sheared(slope)
    ink = profile(rows)[y0:y1]
    enough = [int(n >= max(2.0, middle(ink[ink > 0]) * 0.3)) for n in ink]
    starts = [y0 + k for k, n in enumerate(enough) if n and not (k and enough[k - 1])]
    ends = [y0 + k for k, n in enumerate(enough) if n and not (k + 1 < len(enough) and enough[k + 1])]
    usual = middle([b - a + 1 for a, b in zip(starts, ends)]) or max(1.0, height * 0.02)
    merged, bands = [], []
    for a, b in zip(starts, ends):
        if merged and a - merged[-1][1] - 1 <= max(1.0, usual * 0.3):
            merged[-1][1] = b
        else:
            merged.append([a, b])
    for top, bottom in merged:
        mine = (rows >= top) & (rows <= bottom)
        if bottom - top + 1 >= max(1.0, height * 0.006) and mine.any():
            bands.append((ys[mine].min() / height, (ys[mine].max() + 1) / height, xs[mine].min() / width, (xs[mine].max() + 1) / width, int(mine.sum())))
    return threshold, round(math.degrees(math.atan(slope)), 1), bands


def test_bands_of_pages_agree_with_the_plain_form():
    import numpy as np

    rng = np.random.default_rng(7)
    for trial in range(150):
        height, width = (int(v) for v in rng.integers(1, 200, 2))
        some = rng.integers(0, 256, (3, height, width, 4), dtype=np.uint8)
        if trial % 3:
            some[..., :3] = 240
            for k in range(3):
                for _ in range(int(rng.integers(0, 9))):
                    y, x, tilt = int(rng.integers(0, height)), int(rng.integers(0, width)), float(rng.choice([0.0, 0.03, -0.05]))
                    for c in range(x, width):
                        some[k, max(0, int(y + tilt * (c - x))) :, c, :3][: int(rng.integers(1, 4))] = rng.integers(0, 200)
        if trial % 5 == 0:
            some[:, height // 2 : height // 2 + 2] = 9
        assert images.bands_of_pages(some) == [plain_bands(np, rgba) for rgba in some]


def test_page_images_of_any_size_and_broken_ones(spark):
    import numpy as np

    given = [page(np), page(np, width=120, height=160, lines_=3), page(np, slope=0.02), page(np, lines_=0), page(np, lines_=5)]
    rows = [(k, k, rgba.shape[1], rgba.shape[0], rgba.tobytes()) for k, rgba in enumerate(given)] + [(7, 1, 10, 10, b"abc"), (8, 1, None, 10, b""), (9, 1, 0, 0, b""), (10, 1, 10, 10, None), (None, None, 120, 160, given[1].tobytes())]
    table = spark.createDataFrame(rows, "doc_id bigint, page int, width int, height int, pixels binary").coalesce(1)
    found = images.page_bands(table).collect()
    expected = [(k, k, t, s, i, *b) for k, (t, s, bands) in [*enumerate(map(images.find_bands, given)), (None, images.find_bands(given[1]))] for i, b in enumerate(bands)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected)) and len(found) > 30


def test_few_drawn_pages_are_held_as_pixels(spark, data):
    def read(batch):
        import weakref

        import numpy as np

        alive = []
        for _ in range(batch.num_rows):
            rgba = np.full((160, 120, 4), 255, dtype=np.uint8)
            rgba[40:44, 10:100, :3] = 20
            alive = [r for r in alive if r() is not None] + [weakref.ref(rgba)]
            assert len(alive) < 60
            yield rgba

    own = spark.range(2000).selectExpr("id as doc_id", "1 as page").coalesce(1)
    assert images.page_bands(own, read).where("ink = 360").count() == 2000
    plan = catalog.queries()["page_bands"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_threshold_agrees_with_the_plain_form(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    grey = np.concatenate([rng.normal(60, 9, 900), rng.normal(190, 20, 1500)]).clip(0, 255).astype(int)
    histogram = spark.createDataFrame([(1, int(v), int(n)) for v, n in Counter(grey.tolist()).items()], "k int, value int, n bigint")
    assert images.otsu_threshold(histogram, ["k"]).first().threshold == images.threshold_of(np.bincount(grey, minlength=256))


def test_replies_of_a_model(spark):
    from gradeloom.operators import model

    def reply(prompt):
        if prompt == "fail":
            raise RuntimeError
        return '```json\n{"n": "%d marks"}\n```' % len(prompt)

    schema = {"type": "object", "required": ["n"], "props": {"n": {"type": "number", "max": 5}}}
    found = model.ask_for(spark.createDataFrame([(1, "ab"), (2, "abcdefgh"), (3, "fail"), (4, None)], "id int, prompt string"), reply, schema, in_flight=2)
    assert {r.id: r.value for r in found.collect()} == {1: '{"n": 2}', 2: '{"n": 5}', 3: None, 4: None}


def test_groups_proposed_by_a_model(spark):
    from gradeloom.operators import model

    own = spark.createDataFrame([(1, f"L{i}", i, 1 + i // 2, f"t{i}") for i in range(4)], "doc_id int, line_id string, line_index int, page int, text string")
    groups = spark.createDataFrame([(1, 1, "Q1", ["L3", "L1", "L1", "L9"]), (1, 2, None, ["L8"]), (1, 3, None, ["L0"])], "doc_id int, group_ord int, question_number string, line_ids array<string>")
    assert rows(model.grouped_by_model(groups, own)) == [(1, 1, "Q1", ["L1", "L3"], "t1\nt3", 1, 2), (1, 3, "3", ["L0"], "t0", 1, 1)]


def test_uploads(spark, tmp_path):
    from gradeloom.sources import files

    for name in ("a.PDF", "b.doc", "c.png", "d"):
        (tmp_path / name).write_bytes(b"x" * 3)
    found = {r.path.rpartition("/")[2]: (r.accepted, r.length) for r in files.uploaded_files(spark, str(tmp_path)).collect()}
    assert found == {"a.PDF": (True, 3), "b.doc": (False, 3), "c.png": (True, 3), "d": (False, 3)}
    kept, dropped = files.page_cut(spark.createDataFrame([(1, i) for i in range(40)], "u int, page int"), "u", ["page"])
    assert (kept.count(), dropped.count()) == (30, 10)
    text = spark.createDataFrame([(" a\r\n\r\n\r\n\r\nb ",), (None,)], "t string").select(files.document_text(F.col("t")))
    assert [r[0] for r in text.collect()] == ["a\n\nb", ""]


def test_geometry_over_page_ranges(spark):
    tiers = spark.createDataFrame([(1, 1, "high"), (1, 2, "low")], "d int, page int, tier string")
    ranges = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 2, 3), (1, 4, 3, 2)], "d int, range_id int, page_start int, page_end int")
    assert rows(placement.range_tier(ranges, tiers, "d")) == [(1, 1, "high"), (1, 2, "low"), (1, 3, "none")]
    boxes = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 5, 2)], "d int, span_id int, page int")
    assert rows(placement.placed_counts(boxes, tiers, "d")) == [(1, 1)]


def test_keys_and_rates(spark):
    env = spark.createDataFrame([(0, "b, a,,b"), (1, "c"), (2, "a"), (3, None)], "rank int, value string")
    assert [r.key for r in budget.key_list(env).orderBy("key_ord").collect()] == ["b", "a", "c"]
    asked = spark.createDataFrame([(1, 100), (2, 9000), (3, 4000)], "request_id int, cost int")
    keys = spark.createDataFrame([(1, 8000, 8000, None, 0, 2, False), (2, 8000, 7000, None, 0, 0, False), (3, 8000, 100, 5000, 0, 0, False), (4, 99999, 99999, None, 0, 0, True)], "key_id int, token_limit int, remaining int, reset_at int, reserved int, in_flight int, dead boolean")
    assert rows(budget.pick_key(asked, budget.available(keys, F.lit(0))).select("request_id", "key_id", "wait_ms")) == [(1, 2, 0), (2, None, None), (3, 2, 0)]
