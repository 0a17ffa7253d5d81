"""Nulls in any column, empty tables, repeated rows, ties and very long texts."""

from pyspark.sql import functions as F

from gradeloom.llm import labels, mixing, noise, packing, pairs, quality, spam, splitting, tokens, truncation

LINES = "line_uid bigint, paper_id bigint, page int, line_index int, source string, text string, confidence double, what string, a string, length int"
ANSWERS = "block_id bigint, exam_id bigint, source string, question_number string, parent_block_id bigint, question_text string, answer_text string, lang string, rec_id bigint, state string"


def lines(spark, rows=()):
    return spark.createDataFrame(list(rows), LINES)


def answers(spark, rows=()):
    return spark.createDataFrame(list(rows), ANSWERS)


NULL_LINES = [(None,) * 10, (1, None, None, None, None, "text of a line without a page or a paper, which is long", None, "x", "x", 1), (2, 1, 1, 0, "flatbed_a", None, None, "x", "x", 1), (2, 1, 1, 0, "flatbed_a", None, None, "x", "x", 1)]
NULL_ANSWERS = [(None,) * 10, (1, None, None, None, None, None, None, None, None, None), (2, 1, "fax", "Q9", 99, "Why?", "Because it is so.", None, 1, "x"), (2, 1, "fax", "Q9", 99, "Why?", "Because it is so.", None, 1, "x")]


def test_empty_tables(spark):
    own, written = lines(spark), answers(spark)
    entries = spark.createDataFrame([], "exam_id bigint, q_number string")
    assert quality.page_kinds(own).count() == 0
    assert truncation.find_truncated(own, written).count() == 0
    assert truncation.truncation_rates(truncation.find_truncated(own, written), own, written).count() == 0
    assert noise.find_noise(own, written).count() == 0
    assert labels.resolve_labels(written, entries).count() == 0
    limits = spark.createDataFrame([], "rec_table string, max_chars int, overlap_chars int")
    assert splitting.split_items(own.select(F.lit("t").alias("rec_table"), F.col("line_uid").alias("rec_id"), "text"), limits).count() == 0
    assert pairs.find_defects(written, written.select("block_id")).count() == 0
    items = spark.createDataFrame([], "item_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([], "spec_name string, capacity_tokens int")
    assert packing.pack_items(items, specs).count() == 0 and packing.fill_report(packing.pack_items(items, specs), specs).count() == 0
    records = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([], "mix_name string, source string, target_share double, max_repeats int")
    assert mixing.mix_sources(records, targets).count() == 0 and mixing.mix_shares(mixing.mix_sources(records, targets), targets).count() == 0
    documents = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert spam.spam_pages(documents).count() == 0 and tokens.document_sizes(documents).count() == 0


def test_nulls_and_repeated_rows(spark):
    own, written = lines(spark, NULL_LINES), answers(spark, NULL_ANSWERS)
    entries = spark.createDataFrame([(1, None), (None, "1"), (1, "1")], "exam_id bigint, q_number string")
    assert quality.page_kinds(own).count() == 0
    assert truncation.find_truncated(own, written).count() == 0
    assert noise.find_noise(own, written).count() == 0
    assert [tuple(r) for r in labels.resolve_labels(written, entries).collect()] == [(2, "unmatched")]
    assert sorted(tuple(r) for r in pairs.find_defects(written, written.select("block_id").where("false")).where("block_id is not null").collect()) == [(1, "empty")]


def test_ties_have_one_result(spark):
    items = spark.createDataFrame([(i, 50) for i in range(8)] * 2, "item_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([("s", 100)] * 2, "spec_name string, capacity_tokens int")
    assert packing.fill_report(packing.pack_items(items, specs), specs).first().n_containers == 8
    common = spark.createDataFrame([("house", 90), ("mouse", 90), ("horse", 90)], "word string, n bigint")
    odd = spark.createDataFrame([("h0use", 1)], "word string, n bigint")
    assert noise.corrections(odd, common).collect()[0].fixed == "house"
    assert mixing.sainte_lague({"a": 1.0, "b": 1.0}, 3) == {"a": 2, "b": 1}


def test_very_long_texts(spark):
    long = "The plants need light because the leaves make food. " * 20_000
    own = lines(spark, [(1, 1, 1, 0, "pdf_text", long, 0.9, "x", "x", 1), (2, 1, 2, 1, "pdf_text", "y" * 300_000, 0.9, "x", "x", 1)])
    written = answers(spark, [(1, 1, "fax", "Q1" * 5000, None, "Why?", long, "en", 1, "x")])
    assert [tuple(r) for r in quality.page_kinds(own).collect()] in ([], [(1, 2, "junk")])
    assert truncation.find_truncated(own, written).where("rec_id = 1").count() == 0
    assert noise.find_noise(own, written).count() == 0
    pieces = splitting.split_items(own.select(F.lit("t").alias("rec_table"), F.col("line_uid").alias("rec_id"), "text"), spark.createDataFrame([("t", 600, 60)], "rec_table string, max_chars int, overlap_chars int"))
    assert pieces.groupBy("rec_id").agg(F.max("end").alias("e")).where("rec_id = 1").first().e == len(long)
    assert spam.spam_pages(own.select(F.col("line_uid").alias("doc_id"), "text")).count() == 0
