import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import automaton, labels, lines, mixing, noise, packing, pages, pairs, quality, spam, splitting, tokens, truncation, vocabulary


def rows(df):
    return sorted(tuple(r) for r in df.collect())


PROSE = [
    "The root system takes in water from the soil, and it", "sends the water up to the leaves of the plant. When", "the leaves are in the light, they make food that the", "plant can use or store. This is why the plant has to",
    "stay in the sun for most of the day, as the book", "shows. The food is then moved to the roots, where it", "is kept until the plant needs it.",
]
LIST = ["Key words", "- osmosis", "- root hairs", "- cell wall, nucleus", "- chlorophyll", "- enzymes", "- guard cells"]
TABLE = ["Cells | Count | Size", "roots | 12 | 4.5 cm", "stems | 18 | 2.5 cm", "leaves | nil | 7 cm", "1904 | 20 | 11 cm"]
JUNK = ["#~*^ =+|.", "eht fo toor eht ni retaw eht", "lllllllllllllllll", "[illegible] ??", "x7Kq93LmZ0pR", "tr asoi hofn nhcu sent oaio"]

LINE_SCHEMA = "line_uid bigint, paper_id bigint, page int, line_index int, source string, text string, confidence double, kind string"


def line_table(spark, *page_texts, source="flatbed_a"):
    given, uid = [], 0
    for page, texts in enumerate(page_texts, 1):
        for text in texts:
            uid += 1
            given.append((uid, 1, page, uid, source, text, None if uid % 3 else 0.5, "clash"))
    return spark.createDataFrame(given, LINE_SCHEMA)


# ---- automata ----------------------------------------------------------------


def test_repeats_agree_with_brute_force():
    random.seed(4)
    for _ in range(60):
        s = [random.choice("abc") for _ in range(random.randint(0, 14))]

        def longest(i, least):
            return max((n for n in range(1, i + 2) if sum(s[j : j + n] == s[i + 1 - n : i + 1] for j in range(len(s))) >= least), default=0)

        assert automaton.SuffixAutomaton(s).repeated_suffixes(s) == [longest(i, 2) for i in range(len(s))]


def test_matches_agree_with_brute_force():
    random.seed(6)
    for _ in range(60):
        s = [random.choice("ab") for _ in range(random.randint(0, 9))]
        t = [random.choice("abc") for _ in range(random.randint(0, 9))]
        parts = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        assert automaton.SuffixAutomaton(s).matched_suffixes(t) == [max((n for n in range(1, i + 2) if tuple(t[i + 1 - n : i + 1]) in parts), default=0) for i in range(len(t))]


def test_cover_and_stack():
    assert automaton.covered([0, 1, 2, 0, 1], 2) == [False, True, True, False, False] and automaton.covered([]) == []
    assert automaton.open_at_end('a) see (the "leaf" [and') == ["(", "["] and automaton.open_at_end('he said "no') == ['"'] and automaton.open_at_end("") == []


# ---- problem 1 ---------------------------------------------------------------


def test_pages_that_are_no_prose(spark):
    long_prose = [PROSE] * 12
    found = quality.page_kinds(line_table(spark, *long_prose, LIST, TABLE, JUNK, [None, "", "  "]))
    assert rows(found) == [(1, 13, "list"), (1, 14, "table"), (1, 15, "junk")]


@pytest.mark.parametrize("prose, tables", [(12, 8), (132, 88), (90, 130), (60, 240)])
def test_pages_of_a_language_that_is_often_no_prose(spark, prose, tables):
    english = ["The part | of the plant | 4.5", *TABLE]
    found = quality.page_kinds(line_table(spark, *[PROSE] * prose, *[english] * tables))
    assert rows(found) == [(1, prose + i, "table") for i in range(1, tables + 1)]


def test_the_tails_of_the_sketches_decide(spark, monkeypatch):
    own = line_table(spark, *[PROSE] * 250, *[TABLE] * 3)
    scored = quality.page_scores(quality.page_statistics(own))
    assert {r.page for r in scored.where(quality.in_tail()).collect()} == {251, 252, 253}
    flat = {s: f"0.0 as z_{s}" for s in quality.STATISTICS}
    monkeypatch.setattr(quality, "page_scores", lambda pages: pages.selectExpr("*", *flat.values()))
    assert quality.page_kinds(own).count() == 0


#: Wrapped sentences of which half the lines look like entries, and entries outweighed by what introduces them.
WRAPPED = ["distillation.", "2(iii) In addition, whenever alkalis meet", "neutralisation, the balance steadily shifts.", "Earlier writers at Ulmeimarch believed that", "a saturated solution was caused by", "hydrocarbons."]
INTRODUCED = ["According to the passage on page 12, the depth of the soil", "and the cost of the work both matter to the people of it.", "erosion", "water cycle", "tides", "rivers", "birth rate", "glaciers", "monsoon", "plateaus", "settlements", "farmers"]
MARKED = ["The first thing that we can see in the table is that it has the", *(f"[ ] {x};" for x in ("rivers", "tides", "farmers", "glaciers", "plateaus"))]


def test_the_sketches_decide_near_the_half(spark, monkeypatch):
    own = line_table(spark, *[PROSE] * 250, WRAPPED, INTRODUCED, MARKED)
    shares = {r.page: r.running_share for r in quality.page_statistics(own).where("page > 250").collect()}
    assert 0.4 < shares[251] < 0.5 < shares[252] < 0.6 and 0.5 < shares[253] < 0.6
    assert rows(quality.page_kinds(own)) == [(1, 252, "list"), (1, 253, "list")]
    scores = quality.page_scores
    monkeypatch.setattr(quality, "page_scores", lambda pages: scores(pages).withColumns({f"z_{s}": F.lit(0.0) for s in ("ended_share", "symbol_ratio", "digit_ratio")}))
    assert rows(quality.page_kinds(own)) == [(1, 251, "list")]


def test_second_deliveries_and_empty_tables(spark):
    own = line_table(spark, PROSE, LIST)
    once, twice = quality.page_statistics(own), quality.page_statistics(own.unionByName(own))
    assert rows(once) == rows(twice)
    assert quality.page_kinds(own.where("false")).count() == 0


def test_sketches_merge_per_language(spark):
    found = {r.lang: r.n_pages for r in quality.language_sketches(quality.page_statistics(line_table(spark, PROSE, PROSE, TABLE))).collect()}
    assert found["en"] == 2 and found["all"] == 3


@pytest.mark.parametrize("text, kind", [("Wenn die Dichte steigt, reagieren die Bauern langsam.", lines.PROSE), ("- 3 -", lines.FURNITURE), ("1900 | 12 | 4.5", lines.TABLE), ("• cell wall", lines.LIST), ("", lines.BLANK), (None, lines.BLANK), (".swohs koob eht sa", lines.JUNK), ("पौधे को जल की आवश्यकता होती है।", lines.PROSE)])
def test_line_classes(text, kind):
    assert lines.classify_line(text) == kind


# ---- problems 2 and 3 --------------------------------------------------------

WORDS = "The plants need light because the leaves make food with it. After the light is gone the plants store the temperature of the day. Many plants have strong roots."


def scanned(spark, extra):
    """Enough clean text to know its words, on typed and scanned pages, and the lines in question on a page of their own."""
    clean = [WORDS.replace(". ", ".\n").split("\n") for _ in range(8)]
    typed = line_table(spark, *[[WORDS] for _ in range(8)], source="pdf_text").withColumn("line_uid", F.col("line_uid") + 10_000).withColumn("paper_id", F.lit(2).cast("bigint"))
    return line_table(spark, *clean, extra).unionByName(typed)


def answers_of(spark, *texts):
    return spark.createDataFrame([(i, "flatbed_a", "Why is it so?", t, 0) for i, t in enumerate(texts, 1)], "block_id bigint, source string, question_text string, answer_text string, rec_id int")


BASE = 25  # the first line of the ninth page


def test_cut_lines_and_answers(spark):
    page = ["The plants need light because the leaves make fo", "it. After the light is gone the plants store the", "temperature of the day. Many plants have strong", "roots. The plants need light because the lea�", "plants store the temperature of the day and the food", "Many plants have strong roots. Many plants have strong"]
    found = {tuple(r)[:2] for r in truncation.find_truncated(scanned(spark, page), answers_of(spark, WORDS, "The plants need light because the leaves make fo", None, "", "roots", "The plants store the temperature of the day", "I do not know the answer", "The plants need light beca�")).collect()}
    assert {r for t, r in found if t == "parsed_questions"} == {2, 8}
    ids = {r for t, r in found if t == "ocr_lines"}
    assert BASE + 3 in ids and BASE + 1 not in ids and BASE + 2 not in ids


def test_lines_left_open(spark):
    start = "Many plants have strong roots. The plants need light because the leaves make food with it"
    typed = [
        f"{start} (after the light is gone the plants store the temperature of the day", f"{start}. “The plants store the temperature of the day", f"{start}. <b>The plants store the temperature of the day", f"{start} &am", f"{start}\\",
        f"{start} (after the light). The plants store the temperature of the day", f"Q11(d. {start}. The plants store the temperature of the day", f"{start} (the light is gone, the leaves make food with it).", f"{start}. „Many plants“ and 5\" roots store the temperature of the day", f"{start}. The plants need light of R&D",
    ]
    extra = line_table(spark, typed, source="pdf_text").withColumn("line_uid", F.col("line_uid") + 20_000).withColumn("paper_id", F.lit(4).cast("bigint"))
    scan = ["The plants need light because the leaves (the light is", "food of the plant) make the food with it. After the", "light is gone “the plants store the", "temperature of the day. Many plants have strong roots.", "The plants need the light because the leaves make it."]
    found = {r.rec_id: r.reason for r in truncation.find_truncated(scanned(spark, scan).unionByName(extra), answers_of(spark, WORDS, f"{start}. <b>The plants store the temperature of the day")).where("rec_table = 'ocr_lines'").collect()}
    assert {i - 20_000: r for i, r in found.items() if i > 20_000} == {1: "open", 2: "open", 3: "open", 4: "broken", 5: "broken"}
    assert {i - BASE for i in found if i < 10_000} == {2}


@pytest.mark.parametrize("second, cut", [(["plants” and the leaves make food with it.", "Many plants have strong roots."], False), (["The leaves make food with it.", "Many plants have strong roots."], True), ([], True)])
def test_signs_left_open_over_pages(spark, second, cut):
    pages = [["The plants need light because the leaves make food", "with it. The plants store the temperature of the day.", "After the light is gone “the day"], second]
    extra = line_table(spark, *pages).withColumn("line_uid", F.col("line_uid") + 20_000).withColumn("paper_id", F.lit(4).cast("bigint"))
    found = truncation.find_truncated(scanned(spark, []).unionByName(extra), answers_of(spark, WORDS))
    assert found.where("rec_id = 20003").count() == cut


@pytest.mark.parametrize("text, left", [("a <b>c", True), ("a <b>c</b>", False), ("see <a href=", True), ("x < y and 3<4", False), ("**Q 1** and", False), ("and **bold", True), ("2**3 is", False), ("a<br>b <p>c", False), ("```x", True)])
def test_open_markup(text, left):
    assert automaton.open_markup(text) == left


def test_long_repeated_questions_are_not_cut(spark):
    question = "Explain why the plants need light because the leaves make food with the"
    answers = spark.createDataFrame([(1, "flatbed_a", question, " ".join([question] * 9)), (2, "flatbed_a", "Why?", " ".join([question] * 9))], "block_id bigint, source string, question_text string, answer_text string")
    found = truncation.find_truncated_answers(answers, truncation.line_counts(scanned(spark, [])))
    assert [r.rec_id for r in found.collect()] == [2]


def test_rates_count_second_deliveries_once(spark):
    own, answers = scanned(spark, ["The plants need light because the lea�"]), answers_of(spark, WORDS)
    found = truncation.find_truncated(own.unionByName(own), answers)
    rates = {(r.rec_table, r.source): (r.n_cut, r.n_records) for r in truncation.truncation_rates(found, own.unionByName(own), answers).collect()}
    assert rates["ocr_lines", "flatbed_a"] == (1, BASE) and rates["parsed_questions", "flatbed_a"] == (0, 1)


def test_rare_words_are_no_fragments(spark):
    counts = spark.createDataFrame([("c", "plan", 9), ("c", "leav", 20), ("c", "tem", 3), ("w", "tem", 90)], "kind string, word string, n bigint")
    judged = [(1, "fragment", "plan"), (2, "fragment", "tem"), (3, "open", "plan"), (4, "fragment", None), *((i, "fragment", "leav") for i in range(10, 17))]
    kept = truncation.without_words(spark.createDataFrame(judged, "rec_id bigint, reason string, core string"), counts)
    assert {r.rec_id for r in kept.collect()} == {2, 3, 4, *range(10, 17)}


def test_typed_words_are_told_by_their_share(spark):
    given = [("w", "light", 900), ("c", "light", 300), ("w", "tbe", 1000), ("c", "tbe", 2), ("w", "rare", 4), ("c", "rare", 2), ("w", "once", 1), ("c", "once", 1)]
    assert {r.word for r in noise.typed_words(spark.createDataFrame(given, "kind string, word string, n bigint")).collect()} == {"light", "rare"}


def test_words_without_a_broadcast_place_are_corrected(spark, monkeypatch):
    # Of 3 million tokens, a word that comes 9 times is under the share that is broadcast.
    counts = spark.createDataFrame([("n", "", 9_000_000), ("w", "the", 100_000), ("w", "stomata", 9)], "kind string, word string, n bigint")
    frequent, common = noise.known_words(counts)
    assert set(frequent) == {"the"} and {r.word for r in common.collect()} == {"the", "stomata"}
    odd = spark.createDataFrame([("st0mata", 1)], "word string, n bigint")
    assert rows(noise.corrections(odd, common)) == [("st0mata", "stomata")]


def test_findings_hold_when_the_corpus_is_repeated(spark):
    own = scanned(spark, ["The plants need light because", "the leaves make temp", "The p1ants need tbe light."])
    answers = answers_of(spark, "The plants need light because the lea")
    copies = own
    for k in range(1, 30):
        copies = copies.unionByName(own.withColumn("paper_id", F.col("paper_id") + 10 * k).withColumn("line_uid", F.col("line_uid") + 100_000 * k))
    shape = lambda df: {(r.rec_id % 100_000, r.noise, r.fixed) for r in df.where("rec_table = 'ocr_lines'").collect()}
    assert shape(noise.find_noise(own, answers)) == shape(noise.find_noise(copies, answers))
    cut = lambda df: {r.rec_id % 100_000 for r in df.where("rec_table = 'ocr_lines'").collect()}
    assert cut(truncation.find_truncated(own, answers)) == cut(truncation.find_truncated(copies, answers))


def test_lines_without_a_place_stand_alone(spark):
    own = spark.createDataFrame([(i, None, None, None, "flatbed_a", f"The plants need light and water {i}.", 0.9, "x") for i in range(50)] + [(90, 1, 1, 25_000, "flatbed_a", "- 7 -", 0.9, "x")], LINE_SCHEMA)
    found = noise.find_noise(own, answers_of(spark, "It is so."))
    assert rows(found) == [("ocr_lines", 90, "page_number", "")]


@pytest.mark.parametrize("pages_", [[1, 2, 3], [1, 5, 1023, 1024, 1030, 5000], [7]])
def test_next_pages_over_spans(spark, pages_):
    given = [("opening", p, n, "a", "b", 0) for p in (1, 2) for n in pages_] + [("tail", 1, 4, "a", "b", 0)]
    found = pages.page_openings(spark.createDataFrame(given, "what string, paper_id bigint, page int, a string, b string, x int"))
    assert rows(found.select("paper_id", "page", "next_page")) == sorted((p, a, b) for p in (1, 2) for a, b in zip(pages_, pages_[1:]))


@pytest.mark.parametrize("text, state", [("It ends.", "ended"), ("It ends.)", "ended"), ("It en�", "broken"), ("It is &am", "broken"), ("the profit from R&D", "bare"), ("AT&T", "bare"), ('He said "it was done.', "ended"), ("It goes on", "bare"), ("", "bare"), ("x\\", "broken")])
def test_ends_of_texts(text, state):
    assert truncation.tail_state(text) == state


def test_field_limits(spark):
    lengths = [("t", "fax", 640, False)] * 30 + [("t", "fax", n, True) for n in range(100, 700, 7)] + [("t", "web", n, n % 2 == 0) for n in range(100, 400, 3)]
    assert rows(truncation.field_limits(spark.createDataFrame(lengths, "rec_table string, source string, length int, ended boolean"))) == [("t", "fax", 640)]


def test_noise_is_found_and_repaired(spark):
    page = ["Term Test Biology Set B", "The plants need light because the lea-", "ves make food with it. Bccause the light is gone the", "plants store the tempera¬", "ture of the day.", "Page 3 of 9"]
    heads = [["Term Test Biology Set B", *WORDS.replace(". ", ".\n").split("\n"), f"- {i} -"] for i in range(5)]
    extra = line_table(spark, *heads).withColumn("line_uid", F.col("line_uid") + 5_000).withColumn("paper_id", F.lit(3).cast("bigint"))
    answers = answers_of(spark, "The plants need light because the lea-\nPage 4\nves make food", "Many p1ants have strong roots", None, "")
    own = scanned(spark, page).unionByName(extra)
    found = {tuple(r) for r in noise.find_noise(own.unionByName(own), answers).collect()}
    mine = {(t, r - BASE + 1 if t == "ocr_lines" else r, n, f) for t, r, n, f in found if t != "ocr_lines" or r < 5_000}
    assert mine == {
        ("ocr_lines", 1, "header", ""), ("ocr_lines", 2, "hyphen", "leaves"), ("ocr_lines", 3, "misread", "because"), ("ocr_lines", 4, "hyphen", "temperature"), ("ocr_lines", 6, "page_number", ""),
        ("parsed_questions", 1, "hyphen", "leaves"), ("parsed_questions", 1, "page_number", ""), ("parsed_questions", 2, "misread", "plants"),
    }
    assert sum(n == "header" for _, _, n, _ in found) == 6


def test_noise_over_pages_and_on_other_pages(spark):
    own = scanned(spark, []).unionByName(line_table(spark, PROSE[:-1] + ["Many plants store the tempera-"], ["ture of the day. " + WORDS[:60]], ["- the p1ants", *LIST[1:], "7"]).withColumn("line_uid", F.col("line_uid") + 900).withColumn("paper_id", F.lit(4).cast("bigint")))
    found = {tuple(r)[1:] for r in noise.find_noise(own, answers_of(spark)).collect() if 900 < r.rec_id < 5_000}
    assert (907, "hyphen", "temperature") in found and (916, "page_number", "") in found
    assert not [f for f in found if f[1] == "misread"]


def test_corrections_by_anagram_hash(spark):
    common = spark.createDataFrame([("distillation", 900), ("summer", 400), ("process", 800), ("those", 100)], "word string, n bigint")
    odd = spark.createDataFrame([("clistillation", 2), ("sumrner", 1), ("pr0ce55", 3), ("theso", 90), ("xyz", 1), ("abc", None)], "word string, n bigint")
    assert rows(noise.corrections(odd, common)) == [("clistillation", "distillation"), ("pr0ce55", "process"), ("sumrner", "summer")]
    assert noise.anagram_hash("listen") == noise.anagram_hash("silent")


def test_repair_gives_continuous_text(spark):
    plain = [("Head", True, None, {}), ("When it is light the lea-", False, "leaves", {}), ("ves of the plant can rnake", False, None, {"rnake": "make"}), ("food and store the rest of it in the roots.", False, None, {}), ("Roots.", False, None, {}), ("Next Bccause", False, None, {"bccause": "because"})]
    assert noise.join_lines(plain) == "When it is light the leaves of the plant can make food and store the rest of it in the roots. Roots.\n\nNext Because"
    assert noise.join_lines([(t, False, None, {}) for t in LIST]) == "\n".join(LIST)
    assert noise.join_lines([]) == "" and noise.join_lines([("it is tempera¬", False, "temperature", {}), ("ture.", False, None, {})]) == "it is temperature."
    page = ["Term Test Biology Set B", "Plants need light because the lea-", "ves make food with it. Bccause the light is gone the", "plants store the tempera¬"]
    heads = [["Term Test Biology Set B", *WORDS.replace(". ", ".\n").split("\n")] for _ in range(5)]
    own = scanned(spark, page).unionByName(line_table(spark, *heads, ["ture of the day."]).withColumn("line_uid", F.col("line_uid") + 5_000).withColumn("paper_id", F.lit(3).cast("bigint")))
    own = own.unionByName(line_table(spark, *([["."]] * 9), ["ture of the day. After the light is gone the plants store it."]).where("page = 10").withColumn("line_uid", F.col("line_uid") + 900))
    answers = answers_of(spark, "The plants need light because the lea-\nPage 4\nves make food", "Many p1ants have strong roots", None, "")
    details = noise.noise_details(own.unionByName(own), answers.unionByName(answers))
    texts = {(r.paper_id, r.page): r.text for r in noise.repair_lines(own.unionByName(own), details).collect()}
    assert texts[1, 9] == "Plants need light because the leaves make food with it. Because the light is gone the plants store the temperature"
    assert texts[1, 10] == "of the day. After the light is gone the plants store it." and texts[3, 1].startswith("The plants need light")
    assert {r.block_id: r.text for r in noise.repair_answers(answers.unionByName(answers), details).collect()} == {1: "The plants need light because the leaves make food", 2: "Many plants have strong roots", 3: None, 4: ""}


def test_counts_of_words(spark):
    texts = spark.createDataFrame([("a plant has a root. Next", True), ("a plant, in light", False), (None, True), ("", False)], "t string, typed boolean")
    found = {(r.kind, r.word): r.n for r in vocabulary.corpus_counts(texts, ends=True).collect()}
    assert found["w", "plant"] == 2 and found["c", "plant"] == 1 and found["e2", "a root"] == 1 and ("w", "next") not in found


@pytest.mark.parametrize("text, number", [("Page 3 of 9", True), ("P a g e | 7", True), ("- 3 -", True), ("[13]", True), ("5/7", True), ("xiv", True), ("3.", False), ("(iv)", False), ("3 cells", False), ("= 396", False)])
def test_page_numbers(text, number):
    assert bool(pages.PAGE_NUMBER.match(text)) is number


# ---- problem 4 ---------------------------------------------------------------


def test_labels_are_resolved(spark):
    entries = [(1, n) for n in ("1", "2", "2(a)", "2(b)", "5", "11")] + [(2, n) for n in ("1", "4", "4(i)", "4(ii)")] + [(3, n) for n in ("6", "6.1", "6.2")] + [(1, "5"), (3, None)]
    labels_ = [
        (1, 1, "Qestion 2 part b", None, "2(b)"), (2, 1, "Q2", None, "2"), (3, 1, "(A)", 2, "2(a)"), (4, 1, "Ans to Q.S.", None, "5"), (5, 1, "Il)", None, "11"), (6, 1, "part c", 2, "unmatched"), (7, 2, "soln 4 (II)", None, "4(ii)"),
        (8, 2, "4(2)", None, "4(ii)"), (9, 3, "Q６·2.", None, "6.2"), (10, 3, "Roll no.", None, "unmatched"), (11, 1, "Q. 63", None, "unmatched"), (12, 2, "Prgeunta one", None, "1"), (13, 9, "1", None, "unmatched"), (14, 1, "fifth", None, "unmatched"),
        (15, 1, "x" * 5000, None, "unmatched"),
    ]
    left_out = [(20, 1, "2(a)", None), (21, 1, None, None), (22, 1, " ​ ", None)]
    given = [(b, e, x, p, "clash") for b, e, x, p, _ in labels_ if b != 14] + [(b, e, x, p, "clash") for b, e, x, p in left_out]
    own = spark.createDataFrame(given + given[:3], "block_id bigint, exam_id bigint, question_number string, parent_block_id bigint, label string")
    found = labels.resolve_labels(own, spark.createDataFrame(entries, "exam_id bigint, q_number string"))
    assert rows(found) == sorted((b, q) for b, _, _, _, q in labels_ if b != 14)


def test_labels_of_other_lists(spark):
    lists = {1: ["3", "3(a)", "3(a)(i)", "3(a)(ii)", "3(b)"], 2: ["I", "II", "III"], 3: ["A1", "A2", "B1", "B2"], 4: ["3.2.1", "3.2.2"], 5: ["Section A", "Section B"], 6: ["Essay", "Letter"], 7: ["1", "2", "3"], 8: ["Q1", "Q2", "Q3a"], 9: ["7(a)", "7(b)"]}
    cases = [
        (1, 1, "Ans 3 a ii", "3(a)(ii)"), (2, 1, "Q3(b)", "3(b)"), (3, 1, "3 (a) (iii)", "unmatched"), (4, 2, "Q. 3", "III"), (5, 2, "two", "II"), (6, 3, "B-2", "B2"), (7, 3, "ans a1", "A1"), (8, 3, "b2.", "B2"), (9, 4, "Q 3-2-1", "3.2.1"),
        (10, 5, "sec. b", "Section B"), (11, 6, "Esay", "Essay"), (12, 7, "drei", "3"), (13, 7, "Pregunta dos", "2"), (14, 7, "trois", "3"), (15, 8, "3(a)", "Q3a"), (16, 8, "question 2", "Q2"), (17, 9, "Vll (b)", "unmatched"), (18, 9, "VII b", "7(b)"), (19, 6, "Sonnet", "unmatched"), (20, 9, "7 parte b", "7(b)"), (21, 9, "Aufgabe 7 Teil a", "7(a)"),
    ]
    own = spark.createDataFrame([(b, e, x, None) for b, e, x, _ in cases], "block_id bigint, exam_id bigint, question_number string, parent_block_id bigint")
    found = labels.resolve_labels(own, spark.createDataFrame([(e, n) for e, ns in lists.items() for n in ns], "exam_id bigint, q_number string"))
    assert rows(found) == sorted((b, q) for b, _, _, q in cases)


def test_soft_tf_idf_ranks_the_entries(spark):
    entries = spark.createDataFrame([(1, n) for n in ("4(i)", "4(ii)", "4.1", "4.2")], "exam_id bigint, q_number string")
    own = spark.createDataFrame([(1, 1, "Q4 (i)", None), (2, 1, "Q4 . 1", None), (3, 1, "Q4 l", None)], "block_id bigint, exam_id bigint, question_number string, parent_block_id bigint")
    # "l" is as near to the Roman one as to the digit: ties go to the last entry in order.
    assert rows(labels.resolve_labels(own, entries)) == [(1, "4(i)"), (2, "4.1"), (3, "4.1")]


def test_edit_distance_agrees_with_deletion_keys():
    random.seed(3)
    pool = ["".join(random.choice("abcd") for _ in range(random.randint(3, 6))) for _ in range(60)]
    for a, b in combinations(pool, 2):
        if labels.osa_distance(a, b, 1) <= 1:
            assert labels.deletion_keys(a, 1) & labels.deletion_keys(b, 1)
    assert labels.osa_distance("question", "qusetion", 2) == 1 and labels.osa_distance("abc", "xyz", 2) == 3


def test_labels_of_empty_tables(spark):
    own = spark.createDataFrame([], "block_id bigint, exam_id bigint, question_number string, parent_block_id bigint")
    assert labels.resolve_labels(own, spark.createDataFrame([], "exam_id bigint, q_number string")).count() == 0


# ---- problem 5 ---------------------------------------------------------------


def texts_to_split():
    random.seed(9)
    for _ in range(80):
        parts = [random.choice(["word", "longer words here", "x" * random.randint(1, 90), "End.", "\n\n", "\n", " ", "; ", "च।"]) for _ in range(random.randint(0, 120))]
        yield random.choice(["", " "]).join(parts)


def test_pieces_make_the_text_again():
    for text in texts_to_split():
        cuts = splitting.cut_points(text, 60, 12)
        edges = [0, *(c for c, _ in cuts), len(text)]
        assert edges == sorted(set(edges)) or not text
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            assert b - (a - 12 if i else a) <= 60
        assert "".join(text[a:b] for a, b in zip(edges, edges[1:])) == text
        assert (len(text) <= 60) == (not cuts)
        assert all(kind != "forced" or splitting.longest_run(text) > 10 for _, kind in cuts)


def test_split_table(spark):
    long_run = "y" * 130
    items = spark.createDataFrame([("a", 1, "One two. " * 20, 0), ("a", 2, long_run, 0), ("a", 3, "short", 0), ("a", 4, None, 0), ("b", 5, long_run, 0), ("a", 6, "", 0)], "rec_table string, rec_id int, text string, max_chars int")
    limits = spark.createDataFrame([("a", 60, 12), ("c", 5, 1)], "rec_table string, max_chars int, overlap_chars int")
    found = splitting.split_items(items, limits)
    assert rows(found.select("rec_id", "fit").distinct()) == [(1, "natural"), (2, "forced")]
    assert rows(splitting.split_items(items.unionByName(items), limits)) == rows(found)
    nameless = items.withColumn("rec_id", F.lit(None).cast("int"))
    assert rows(splitting.split_items(nameless, limits).select("rec_id", "fit").distinct()) == [(None, "forced"), (None, "natural")]
    for rec, text in ((1, "One two. " * 20), (2, long_run)):
        own = sorted(found.where(f"rec_id = {rec}").collect(), key=lambda r: r.piece)
        assert all(len(r.text) <= 60 and r.text == text[r.start : r.end] for r in own)
        assert all(b.start == a.end - 12 for a, b in zip(own, own[1:])) and own[-1].end == len(text)
    with pytest.raises(ValueError):
        splitting.cut_points("x" * 10, 5, 5)


# ---- problem 6 ---------------------------------------------------------------

PAIRS = [
    ("Define osmosis.", None, "en", "empty"), ("Define osmosis.", " ​", "en", "empty"), ("Define osmosis.", "[no answer]", "en", "empty"), ("Define osmosis.", "____", "en", "empty"), ("Define osmosis.", "True", "en", None),
    ("Define osmosis.", "Sir, I do not know this one, maybe next time", "en", "refusal"), ("¿Qué es?", "Lo siento, no puedo\nresponder a esto.", "es", "refusal"), ("Define it.", "Ich weiß die Antwort auf diese Frage nicht.", "de", "refusal"),
    ("Define it.", "I don't know of any exception, therefore the nucleus always holds the genes of a cell.", "en", None), ("Define it.", "Scientists do not know the exact cause of it.", "en", None),
    ("Define the letter form.", "Ans: Define the letter\nform.", "en", "copied"), ("List three effects of an acid on metals. (5 marks)", "WRITE THREE EFFECTS OF AN\nACID ON METALS", "en", "copied"), ("Define the letter form.", "The letter form is a symbol of speech.", "en", None),
    ("Give reasons why heat is important for ice.", "Give reasons why heat is useful for ice.", "en", "copied"), ("Define radioactive decay.", "radioactive decay define", "en", "copied"),
    ("Explain the leaf with an example.", "We have to explain the leaf. It makes food from light and gives it to the roots.", "en", None),
    ("What is light?", "Die Pflanzen sind viele Jahre lang davon abhängig, weil sich das ändert.", "en", "other_language"), ("Write three sentences in German.", "Die Pflanzen sind viele Jahre lang davon abhängig.", "en", None),
    ("What is light?", "पौधे को जल की आवश्यकता होती है।", "en", "other_language"), ("What is it?", "The book says “Die Pflanzen sind davon abhängig”, which is true of the leaves and it is also what we were told.", "en", None), (None, "It is the nucleus.", "en", None), ("What?", "It is the light of the sun.", None, None),
]


@pytest.mark.parametrize("question, answer, language, defect", PAIRS)
def test_defects(question, answer, language, defect):
    assert pairs.defect_of(question, answer, language) == defect


@pytest.mark.parametrize("answer", ["We simply couldn't solve this one.", "I have never studied it, because the class was away at the lake.", "Yo no entiendo este tema.", "Je ne peux pas expliquer.", "Ich konnte das nicht lösen."])
def test_refusals_in_words_of_their_own(answer):
    assert pairs.is_refusal(answer)


def test_the_automaton_of_the_prompt_decides_copies(monkeypatch):
    question = "Describe the role of heat in the growth of plants."
    assert pairs.copied_shares(["heat", "in", "the", "sea"], ["heat", "in", "the", "growth"]) == (9 / 12, 9 / 15)
    assert pairs.is_copied("The role of heat in the growth of plants.", question) and not pairs.is_copied("heat", question)
    monkeypatch.setattr(automaton.SuffixAutomaton, "matches", lambda self, symbols: ((0, -1) for _ in symbols))
    assert not pairs.is_copied(question, question)


def test_one_defect_a_pair(spark):
    own = spark.createDataFrame([(i, q, a, x, "clash") for i, (q, a, x, _) in enumerate(PAIRS)] * 2, "block_id bigint, question_text string, answer_text string, lang string, defect string")
    cut = spark.createDataFrame([(0,), (4,), (16,), (4,)], "block_id bigint")
    expected = {i: d for i, (_, _, _, d) in enumerate(PAIRS) if d} | {4: "truncated", 16: "truncated"}
    assert dict(tuple(r) for r in pairs.find_defects(own, cut).collect()) == expected


def test_long_answers_are_read_whole():
    assert pairs.defect_of("Define it.", "the cell is big " * 50_000, "en") is None


# ---- problems 7 and 8 --------------------------------------------------------


def test_packing_keeps_everything(spark):
    random.seed(8)
    sizes = [random.choice([random.randint(1, 40), random.randint(60, 100), random.randint(101, 350)]) for _ in range(900)]
    items = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(2000, None, "x"), (2001, 0, "x")], "item_id bigint, n_tokens bigint, piece string")
    specs = spark.createDataFrame([("s", 100), ("m", 256), ("none", None)], "spec_name string, capacity_tokens int")
    packed = packing.pack_items(items, specs)
    found = packed.collect()
    for name, capacity in (("s", 100), ("m", 256)):
        own = [r for r in found if r.spec_name == name]
        fill: dict = {}
        pieces: dict = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.item_id, []).append((r.start_token, r.n_tokens))
        assert max(fill.values()) <= capacity
        assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: n for i, n in enumerate(sizes)}
        assert all(len(p) == -(-sizes[i] // capacity) for i, p in pieces.items())
        assert sum(fill.values()) / (len(fill) * capacity) > 0.95
    report = {r.spec_name: r for r in packing.fill_report(packed, specs).collect()}
    assert report["s"].n_tokens == sum(sizes) and report["s"].n_divided == sum(n > 100 for n in sizes)
    assert packing.pack_items(items.where("false"), specs).count() == 0


def test_lanes_follow_the_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 20)
    items = spark.createDataFrame([(i, 30 + i % 50) for i in range(1200)], "item_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([("s", 100)], "spec_name string, capacity_tokens int")
    packed = packing.pack_items(items, specs)
    assert packed.agg(F.count_distinct("item_id")).first()[0] == 1200 == packed.count()
    fill = packing.fill_report(packed, specs).first()
    assert fill.n_tokens == sum(30 + i % 50 for i in range(1200)) and packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).where("n > 100").count() == 0


def test_best_fit_takes_the_tightest_place():
    assert [f for f, _ in packing.best_fit([(7,), (6,), (3,), (4,)], 10)] == [0, 0] and packing.best_fit([], 10) == []


def test_seats_agree_with_highest_quotients():
    random.seed(7)
    for _ in range(50):
        weights = {c: random.choice([0, 0.1, 0.35, 1, 2.5]) for c in "abcde"[: random.randint(1, 5)]}
        seats = random.randint(0, 60)
        given = dict.fromkeys(weights, 0)
        for _ in range(seats if any(weights.values()) else 0):
            best = max(sorted(weights), key=lambda k: (weights[k] / (2 * given[k] + 1)))
            given[best] += 1
        assert mixing.sainte_lague(weights, seats) == given


@pytest.mark.parametrize("n", [1, 300, 50_000])
def test_plans_of_many_shards_lose_nothing(n):
    targets = [("m", s, share, 2) for s, share in zip("abcde", (0.1, 0.3, 0.2, 0.2, 0.2))]
    held = {(s, k): 900 + (k * 37) % 200 for s in "abcde" for k in range(n)}
    given = dict.fromkeys("abcde", 0)
    for _, source, shard, passes, rest in mixing.plan_mixes(held, targets):
        assert passes * held[source, shard] + rest <= 2 * held[source, shard]
        given[source] += passes * held[source, shard] + rest
    whole = sum(given.values())
    assert all(abs(given[s] / whole - share) < 0.001 for _, s, share, _ in targets)
    assert abs(whole - 2 * sum(n for (s, _), n in held.items() if s == "b") / 0.3) < 10


def test_shards_take_over_what_others_cannot_give():
    assert mixing.shard_quotas({"a": 10, "b": 10, "c": 1}, 21, 1, 5) == {"a": 10, "b": 10, "c": 1}
    assert mixing.shard_quotas({"a": 10}, 30, 2, 7) == {"a": 20}


def test_mixes_reach_their_shares(spark):
    random.seed(1)
    given = [(i, "big" if i % 10 else "small", random.randint(5, 60), 0.5) for i in range(4000)] + [(9001, None, 5, 0.5), (9002, "big", 0, 0.5), (9003, "big", None, 0.5)]
    records = spark.createDataFrame(given, "doc_id bigint, source string, n_tokens bigint, target_share double")
    targets = spark.createDataFrame([("m", "big", 0.8, 2), ("m", "small", 0.2, 3), ("o", "absent", 1.0, 2), ("m", "none", None, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mix_sources(records, targets)
    shares = {(r.mix_name, r.source): r for r in mixing.mix_shares(mixed, targets).collect()}
    assert abs(shares["m", "big"].actual_share - 0.8) < 0.01 and abs(shares["m", "small"].actual_share - 0.2) < 0.01
    assert shares["m", "small"].most_repeats <= 3 and shares["m", "big"].most_repeats <= 2 and shares["o", "absent"].n_tokens == 0
    assert rows(mixed) == rows(mixing.mix_sources(records.repartition(3), targets))


def test_tokens_are_counted(spark):
    import os

    if not os.path.isdir(tokens.FOLDER):
        pytest.skip("no tokenizer here")
    import base64

    import tiktoken

    given = ["Plants make food.", "", None, "é " * 50]
    with open(f"{tokens.FOLDER}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("x", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})
    found = tokens.document_sizes(spark.createDataFrame([(i, "s", t) for i, t in enumerate(given)], "doc_id bigint, source string, text string"))
    assert [r.n_tokens for r in found.orderBy("doc_id").collect()] == [len(encoding.encode_ordinary(t or "")) for t in given]


# ---- problem 9 ---------------------------------------------------------------

SPAM = [
    "gravity pdf, gravity mock test, gravity notes, gravity pdf, gravity cheap, gravity notes, gravity mock test",
    "https://a.example/gravity/1\nhttps://b.example/gravity/2\nwww.c.test/notes\nhttps://d.example/x",
    "#gravity #gravitynotes #force #gravity #notes #force #gravitynotes", "g r a v i t y notes / gr4vity notes / gravity notes / g-r-a-v-i-t-y notes / gravitys notes",
    "Get gravity notes gravity notes now! Our gravity notes is gravity notes for gravity notes. Gravity notes gravity notes!",
    "Gel pen blue gravity | SKU 123 | 4.50 | buy now\nGel pen red gravity | SKU 456 | 3.20 | buy now\nGel pen XL gravity | SKU 7 | 1.20 | in stock",
]
HONEST = [
    WORDS, "1. b\n2. c (gravity)\n3. a\n4. d (force)\n5. b (gravity)\n6. b", "Gravity\t12\t3.5\nForce\t14\t2.5\nGravity\t9\t1.5\nMass\t3\t0.5", "Unit 1: gravity, force and mass (3 periods)\nUnit 2: force, light and gravity (4 periods)",
    "1) Define gravity. (2 marks)\n2) Define force. (2 marks)\n3) Compare gravity and force. (5 marks)", WORDS * 3 + "\n#gravity #force\nhttps://a.example/x", "", None, "gravity",
]


def test_spam_pages(spark):
    given = [(i, t, "clash") for i, t in enumerate(SPAM + HONEST)]
    found = spam.spam_pages(spark.createDataFrame(given + given[:1], "doc_id bigint, text string, spam_share string"))
    assert [r.doc_id for r in found.orderBy("doc_id").collect()] == [0, *range(len(SPAM))]


def test_a_very_long_page():
    total, _, loose, repeated = spam.spam_measures("gravity notes " * 30_000)
    assert total == loose == repeated == 12 * 30_000


HINDI = "इसलिए पौधे को चुंबकीय क्षेत्र की आवश्यकता होती है। किसान कई वर्षों तक भूमि सुधार पर निर्भर रहते हैं। उदाहरण के लिए जीवाणु में बदलाव देखा गया। "


def test_spam_behind_filler_prose(spark):
    english = " ".join(WORDS.split() * 20).split()[:100]
    links = "\n".join(f"https://shop.example/gravity/notes/page/{i:03d}" for i in range(20))
    spam_texts = [" ".join(english) + "\n" + links, HINDI * 4 + "\n" + links, HINDI * 2 + "\n" + "सस्ते नोट्स गुरुत्वाकर्षण, नोट्स डाउनलोड गुरुत्वाकर्षण, " * 12, "#गुरुत्वाकर्षण #नोट्स #विज्ञान " * 12 + HINDI]
    honest = [HINDI * 8, HINDI * 8 + "\n" + links[:80], "इसका मुख्य कारण जल चक्र है।"]
    found = spam.spam_pages(spark.createDataFrame(list(enumerate(spam_texts + honest)), "doc_id bigint, text string"))
    assert [r.doc_id for r in found.orderBy("doc_id").collect()] == [0, 1, 2, 3]
    assert spam._TOKEN.findall("होती हैं।") == ["होती", "हैं"]


NUMBERED = "\n".join(f"{i}. cheap shoes online best cheap shoes store" for i in range(59))
NUMBERED_ONCE = "\n".join(f"{i}. {w} cheap shoes {v}" for i, (w, v) in enumerate([("buy", "online"), ("best", "now"), ("store", "sale"), ("discount", "women")] * 4))
ANSWER_KEY = "\n".join(f"{i}. {'abcd'[i * 7 % 4]}" + (" (food chain)" if i % 6 == 0 else "") for i in range(60))
QUESTIONS = "\n".join(f"{i}) Give reasons why {x} is important for seedlings. ({i % 5 + 1} marks)" for i, x in enumerate(["light", "water", "the root", "heat", "the leaf", "air", "soil", "the stem"]))


@pytest.mark.parametrize("text, spam_page", [(NUMBERED, True), (NUMBERED_ONCE, True), (ANSWER_KEY, False), (QUESTIONS, False), ("buy the best cheap shoes for you and your family if you want to buy it now because " * 20, True)])
def test_numbered_keywords(text, spam_page):
    assert (spam.spam_share(spam.spam_measures(text, 0.5), 0.25) > 0.5) == spam_page
