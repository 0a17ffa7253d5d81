"""Page text as addressable lines: structure, quality, and joins between lines, spans and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.marks import ILLEGIBLE, line_confidence
from gradeloom.functions.text import normalize_text, trimmed

#: Characters between two pages of a joined document.
PAGE_GAP = 2


def structure_pages(pages: DataFrame) -> DataFrame:
    """doc_id, line_id, page, line_index, text, start_char, end_char, confidence: the lines of each document.

    pages: doc_id, page, text. Blank lines have no row but keep their place in
    the offsets, which are half-open and count from the start of the document,
    its trimmed pages joined by two line breaks. Null texts are empty pages.
    Offsets of a page come from the lengths of the pages before it; only those,
    one row a page, are ordered by document.
    """
    clean = pages.select("doc_id", "page", trimmed(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")).alias("raw"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    filled = lambda piece: trimmed(piece) != ""
    counted = clean.withColumns({
        "base": F.coalesce(F.sum(F.char_length("raw") + PAGE_GAP).over(before), F.lit(0)),
        "first": F.coalesce(F.sum(F.size(F.filter(F.split("raw", "\n"), filled))).over(before), F.lit(0)),
    })
    # A page's pieces stay in the partition of its document, so that their running sums need no further shuffle.
    pieces = counted.select("doc_id", "page", "base", "first", F.posexplode(F.split("raw", "\n")).alias("pos", "piece"))
    earlier = Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = pieces.withColumns({
        "at": F.coalesce(F.sum(F.char_length("piece") + 1).over(earlier), F.lit(0)),
        "n": F.coalesce(F.sum(filled(F.col("piece")).cast("int")).over(earlier), F.lit(0)),
    }).where(filled(F.col("piece")))
    text, lead = trimmed(F.col("piece")), F.char_length("piece") - F.char_length(F.regexp_replace("piece", r"^\s+", ""))
    start = F.col("base") + F.col("at") + lead
    index = (F.col("first") + F.col("n")).cast("int")
    return lines.select(
        "doc_id", F.concat(F.lit("L"), index + 1).alias("line_id"), "page", index.alias("line_index"), text.alias("text"),
        start.cast("int").alias("start_char"), (start + F.char_length(text)).cast("int").alias("end_char"), line_confidence(F.col("piece")).alias("confidence"),
    )


def document_quality(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """score, illegible_ratio, short_line_ratio, flags of each document; a null confidence counts as 0.9.

    Documents without lines have no row. Flags, in order: illegible_regions,
    fragmented_lines, low_ocr_quality, very_short_document.
    """
    sums = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce("confidence", F.lit(0.9))).alias("mean"),
        F.avg(F.col("text").rlike(ILLEGIBLE).cast("double")).alias("illegible_ratio"),
        F.avg((F.char_length(normalize_text(F.col("text"))) < 12).cast("double")).alias("short_line_ratio"),
    )
    illegible, fragmented = F.col("illegible_ratio") > 0.1, F.col("short_line_ratio") > 0.6
    score = F.col("mean") - F.when(illegible, 0.15).otherwise(0.0) - F.when(fragmented, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    flags = F.array_compact(F.array(
        F.when(illegible, F.lit("illegible_regions")), F.when(fragmented, F.lit("fragmented_lines")),
        F.when(score < 0.6, F.lit("low_ocr_quality")), F.when(F.col("n") < 3, F.lit("very_short_document")),
    ))
    return sums.select(key, score.alias("score"), F.coalesce("illegible_ratio", F.lit(0.0)).alias("illegible_ratio"), "short_line_ratio", flags.alias("flags"))


def lines_to_text(wanted: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """answer_id, text: the wanted lines of each answer in reading order, joined by line breaks.

    wanted: answer_id, the keys, line_id. lines: the keys, line_id, line_index,
    text. A line wanted twice counts once; ids without a line are dropped, and
    answers without any line have no row.
    """
    found = wanted.select("answer_id", *keys, "line_id").distinct().join(lines.select(*keys, "line_id", "line_index", "text").distinct(), [*keys, "line_id"])
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    return found.groupBy("answer_id").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def lines_for_span(spans: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Each span with every line it overlaps: half-open offsets, joined within a document.

    spans: key, span_start, span_end and others. lines: key, start_char,
    end_char and others. The key is an equality, so the range is only tested
    within a document. Null offsets meet nothing.
    """
    return spans.join(lines, key).where((F.col("span_start") < F.col("end_char")) & (F.col("span_end") > F.col("start_char")))


def answer_line_offsets(answer_lines: DataFrame) -> DataFrame:
    """answer_id, line_id, line_index, line_start, line_end: where each line stands in its answer's joined text."""
    before = Window.partitionBy("answer_id").orderBy("line_index", "line_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0))
    return answer_lines.select("answer_id", "line_id", "line_index", start.alias("line_start"), (start + F.char_length("text")).alias("line_end"))


def unclaimed_lines(lines: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """The lines that no answer claims: a left anti join on the document and the line id."""
    return lines.join(claimed.select(*keys, "line_id").distinct(), [*keys, "line_id"], "left_anti")


def unassigned_writing(unclaimed: DataFrame, key: str, least: int = 40) -> DataFrame:
    """key, n_lines, n_chars, has_unassigned_writing: how much normalised text of a document nobody claimed.

    Lines are counted as if joined by spaces: the normalised form of the joined
    text is the joined normalised forms.
    """
    length = F.char_length(normalize_text(F.col("text")))
    sums = unclaimed.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(length > 0, length + 1).otherwise(0)).alias("joined"))
    chars = F.greatest(F.col("joined") - 1, F.lit(0)).cast("bigint")
    return sums.select(key, "n_lines", chars.alias("n_chars"), (chars >= least).alias("has_unassigned_writing"))
