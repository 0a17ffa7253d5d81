import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import labels, marks, scans, text
from gradeloom.operators.align import stem_of, stems_of


def values(spark, rows, expression, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(expression).collect()]


def test_normalized_text_keeps_ascii_letters_and_digits(spark):
    given = ["  Hello, World! ", None, "", "é-tude No. 5", "KELVIN \u212a", "a_b"]
    assert values(spark, given, text.normalize_text(F.col("x"))) == ["hello world", "", "", "tude no 5", "kelvin", "a b"]


def test_stems_agree_with_the_plain_form(spark):
    words = ["berries", "dies", "classes", "boxes", "houses", "cats", "class", "growing", "sing", "planted", "red", "as", "ties", "passes"]
    assert values(spark, words, text.stem(F.col("x"))) == [stem_of(w) for w in words]


def test_tokens_drop_stopwords_then_short_words(spark):
    assert values(spark, ["The cells of a plant are growing, x", None], text.tokenize(F.col("x"))) == [["cell", "plant", "grow"], []]


def test_overlap_of_texts_without_stems_is_zero(spark):
    rows = spark.createDataFrame([("red cells", "white cells"), ("the", "cells"), (None, None)], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(text.token_overlap(F.col("a"), F.col("b"))).collect()] == [round(1 / 3, 6), 0.0, 0.0]


def test_hash_follows_its_recurrence(spark):
    given = ["", "a", "photosynthesis and respiration", None]

    def expected(s):
        h = 5381
        for c in s or "":
            h = (h * 33 + ord(c)) % 2**32
        return h

    assert values(spark, given, text.djb2(F.col("x"))) == [expected(s) for s in given]
    assert values(spark, ["a"], text.hash_string(F.col("x"))) == ["3t3a"]


def test_prefixes_agree_with_the_plain_form(spark):
    given = ["plants make food from light and water", "one two", "", "a b c d e f"]
    assert values(spark, given, text.prefix_candidates(F.col("x"))) == [scans.candidates(g) if g else [""] for g in given]


SENTENCES = [
    ("Water boils. It turns to steam!", ["Water boils.", "It turns to steam!"]),
    ("pH is 6.5 here. Next", ["pH is 6.5 here.", "Next"]),
    ("See e.g. the leaf. Done", ["See e.g. the leaf.", "Done"]),
    ('He said "stop." Then left\nnew line', ['He said "stop."', "Then left", "new line"]),
    ("This is plan B. Next we go on.", ["This is plan B.", "Next we go on."]),
    ("Vitamin C. elegans stays whole.", ["Vitamin C. elegans stays whole."]),
    ("... !!", []),
    (None, []),
]


@pytest.mark.parametrize("given, expected", SENTENCES)
def test_sentences(given, expected):
    found = scans.split_sentences(given)
    assert [t for t, _, _ in found] == expected
    assert all(given[a:b].strip() == t for t, a, b in found)


def test_spans_are_found_verbatim_then_normalised_then_by_prefix():
    hay = "The leaf makes food.\nThe  LEAF makes food in light."
    assert scans.find_span(hay, "makes food") == (9, 19, True)
    start, end, exact = scans.find_span(hay, "the leaf makes food in light")
    assert not exact and hay[start:end] == "The  LEAF makes food in light"
    assert scans.find_span(hay, "leaf makes food in light every single day of the year") == (26, 50, False)
    assert scans.find_span(hay, "leaf makes nothing in light every single day of the year") is None
    assert scans.find_span(hay, "the leaf makes food in light each day")[2] is False
    assert scans.find_span(hay, "makes food", [(9, 19)]) == (31, 41, False)
    assert scans.find_span(hay, "makes food", start=10) == (31, 41, True)
    assert scans.find_span(hay, "") is None and scans.find_span(None, "leaf") is None


READABLE = [
    ("1. A cell", "1"), ("Q1 text", "1"), ("Q. 2 text", "2"), ("Q. No. 7 it", "7"), ("Ans 3a the", "3.a"), ("Answer to Question 3: it", "3"), ("(a) osmosis", "a"), ("3(a) it", "3.a"), ("3 (a) it", "3.a"),
    ("3.(a) it", "3.a"), ("ii. Second point", "r2"), ("(iv) it", "r4"), ("2 a) it", "2.a"), ("[5] it", "5"), ("3(a)(ii) it", "3.a.r2"), ("Answer Two: it", "2"), ("Sol 4 - it", "4"), ("03) it", "3"), ("Q3a it", "3.a"), ("1.1) it", "1.1"),
]


@pytest.mark.parametrize("line, key", READABLE)
def test_labels_are_read(line, key):
    assert labels.label_key_of(scans.read_label(line)[0]) == key


@pytest.mark.parametrize("line, label, rest", [("Q3.5 kg", "Q3.5", "kg"), ("4 ( water", "4 (", "water"), ("2 : b) heat", "2 :", "b) heat"), ("(ii)(a) salt", "(ii)(a)", "salt"), ("Answer Two Three", "Answer Two", "Three")])
def test_labels_end_where_no_level_follows(line, label, rest):
    assert scans.read_label(line)[:2] == (label, rest)


@pytest.mark.parametrize("line", ["A cell divides", "Five plants were grown", "3.5 kg of water", "particle physics", "", None, "12 apples fell", "1.1 water"])
def test_prose_is_no_label(line):
    assert scans.read_label(line) is None


def test_known_keys_settle_doubtful_labels():
    assert scans.read_label("1.1 water", frozenset({"1.1"}))[0] == "1.1"
    assert scans.read_label("7", frozenset({"7"}))[0] == "7"


LABELS = ["Q. 3(a)", "question two", "Ans. to 3", "part b", "particle", "3ii", "(iv)", "Section 2 - 1", "x", "XX", "", None, "Q1 Q2", "sol. 04 . ii", "fifth", "0", "12(b)(i)", "?!", "Q١", "\u00a0Q. 7 "]


def test_label_columns_agree_with_the_plain_form(spark):
    assert values(spark, LABELS, labels.label_key(F.col("x"))) == [labels.label_key_of(s) for s in LABELS]
    assert values(spark, ["3 (a) (ii)", "03", "(b)", None], labels.canonical_label(F.col("x"))) == ["3(a)(ii)", "3", "b", ""]


def test_letters_never_equal_numbers(spark):
    pairs = [("2", "ii"), ("b", "2"), ("b", "b"), ("x", "10"), ("07", "7")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(labels.same_part(F.col("a"), F.col("b")))
    assert [r[0] for r in rows.collect()] == [True, False, True, True, True] == [labels.same_part_of(*p) for p in pairs]


def test_printed_marks(spark):
    given = ["Define it. (5 marks)", "[3] it", "it 12 marks", "it (5m)", "it 5 M", "[0]", "(250 marks)", None, "12 apples"]
    assert values(spark, given, marks.extract_marks(F.col("x"))) == [5, 3, 12, 5, None, None, None, None, None]
    assert values(spark, ["Define  it. (5 marks)", None], marks.strip_marks(F.col("x"))) == ["Define it.", ""]


def test_question_types_by_verb_then_marks(spark):
    rows = [("Compare and define", 1.0), ("Why is it so?", 9.0), ("The leaf", None), ("The leaf", 4.0), ("The leaf", 8.0), ("The leaf", 20.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "t string, m double").select(marks.classify_question(F.col("t"), F.col("m")))
    assert [r[0] for r in df.collect()] == ["compare", "cause_effect", "definition", "explain", "long_answer", "essay", "definition"]


def test_clamp_sends_null_and_nan_to_the_low_end(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (9.0,), (2.5,)], "x double").select(marks.clamp(F.col("x"), 0, 5))
    assert [r[0] for r in df.collect()] == [0.0, 0.0, 0.0, 5.0, 2.5]


def test_durations(spark):
    given = ["1m2.5s", "500ms", "7.66s", "3", "", "soon", None]
    assert values(spark, given, marks.parse_reset(F.col("x"))) == [62500, 500, 7660, 3000, None, None, None]


def test_line_confidence_marks_down(spark):
    given = ["A clean line of text", "[illegible] part", "--//--", "ab", "", None, "strngthsbcdf x"]
    assert [round(v, 2) for v in values(spark, given, marks.line_confidence(F.col("x")))] == [0.95, 0.5, 0.7, 0.8, 0.0, 0.0, 0.8]


def test_stems_of_agrees_with_columns(spark):
    random.seed(2)
    pool = "The cells are growing in boxes; glasses, berries! of 12 x flies passing red".split()
    given = [" ".join(random.choices(pool, k=random.randint(0, 9))) for _ in range(40)]
    assert [set(v) for v in values(spark, given, F.array_distinct(text.tokenize(F.col("x"))))] == [stems_of(g) for g in given]
