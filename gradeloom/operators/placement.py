"""Places on pages: bands of writing met with lines, boxes of spans, and how far a page's geometry is trusted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scans import find_span
from gradeloom.operators.lines import lines_for_span
from gradeloom.session import prepare

# Geometry from worst to best, and the drift up to which it is medium.
TIERS = ["none", "low", "medium", "high"]
MEDIUM_DRIFT = 0.2


def tier_rank(tier: Column) -> Column:
    """0 for none up to 3 for high; null counts as none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.coalesce(tier, F.lit("none"))), F.lit(1)) - 1


def tier_name(rank: Column) -> Column:
    """The tier of a rank."""
    return F.element_at(F.array(*map(F.lit, TIERS)), rank.cast("int") + 1)


def align_bands(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """doc_id, page, line_id, tier, bbox: every line of a page with the band at its place.

    lines: doc_id, page, line_id, line_index. bands: doc_id, page, top, bottom,
    left, right. Equal counts pair one to one; else line i of L takes band
    floor(i B / L). A page without bands has tier none and null boxes.
    """
    page = Window.partitionBy("doc_id", "page")
    ranked = lines.select("doc_id", "page", "line_id", (F.row_number().over(page.orderBy("line_index")) - 1).alias("i"), F.count(F.lit(1)).over(page).alias("n_lines"))
    placed = bands.select("doc_id", "page", "top", "bottom", "left", "right", (F.row_number().over(page.orderBy("top", "bottom", "left", "right")) - 1).alias("place"))
    counts = bands.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_bands"))
    b, n = F.col("n_bands"), F.col("n_lines")
    joined = ranked.join(counts, ["doc_id", "page"], "left").withColumn("place", F.when(b == n, F.col("i")).otherwise(F.least(b - 1, F.floor(F.col("i") * b / n))).cast("int"))
    drift = F.abs(b - n) / F.greatest(b, n)
    tier = F.when(b.isNull(), "none").when(b == n, "high").when(drift <= MEDIUM_DRIFT, "medium").otherwise("low")
    box = F.struct(F.col("left").alias("x"), F.col("top").alias("y"), F.greatest(F.lit(0.0), F.col("right") - F.col("left")).alias("width"), F.greatest(F.lit(0.0), F.col("bottom") - F.col("top")).alias("height"))
    return joined.join(placed, ["doc_id", "page", "place"], "left").select("doc_id", "page", "line_id", tier.alias("tier"), F.when(F.col("top").isNotNull(), box).alias("bbox"))


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, width, height: the smallest box round all boxes of a key; null boxes are left out."""
    return (
        boxes.where("bbox is not null").groupBy(*keys)
        .agg(F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"), F.max(F.col("bbox.x") + F.col("bbox.width")).alias("r"), F.max(F.col("bbox.y") + F.col("bbox.height")).alias("b"))
        .select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"))
    )


def span_boxes(spans: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, span_id, page, x, y, width, height: the boxes that a span covers, one a page.

    spans: key, span_id, span_start, span_end. lines: key, page, start_char,
    end_char, bbox. A range join within the document, then a union per page.
    """
    hits = lines_for_span(spans, lines.select(key, "page", "start_char", "end_char", "bbox"), key)
    return union_boxes(hits, [key, "span_id", "page"])


def worst_tier(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tier: the worst geometry among the pages of a key."""
    return pages.groupBy(*keys).agg(F.min(tier_rank(F.col("tier"))).alias("r")).select(*keys, tier_name(F.col("r")).alias("tier"))


def trusted(boxes: DataFrame) -> DataFrame:
    """The boxes on pages whose geometry is good enough to show: medium or high."""
    return boxes.where(tier_rank(F.col("tier")) >= TIERS.index("medium"))


def anchor(answer: str | None, annotations: Iterable[tuple[int, str | None, str | None]], least: int = 3) -> list[tuple[int, int, int, bool]]:
    """(ord, start, end, exact) of each annotation (ord, quote, type) that has a place of its own in an answer.

    Earlier annotations keep their spans from later ones. Quotes of what is
    missing, or under three characters, have no place.
    """
    spans: list[tuple[int, int]] = []
    found = []
    for order, quote, kind in annotations:
        text = (quote or "").strip()
        hit = find_span(answer, text, spans) if kind != "missing" and len(text) >= least else None
        if hit:
            spans.append(hit[:2])
            found.append((order, *hit))
    return found


def anchor_annotations(answers: DataFrame, annotations: DataFrame) -> DataFrame:
    """answer_id, ann_ord, start, end, exact: where each annotation stands in its answer; those without a place have no row.

    answers: answer_id, text. annotations: answer_id, ann_ord, quote, type. An
    answer's annotations come together with it in one row, no wider than the
    answer.
    """
    prepare(answers.sparkSession)
    schema = "array<struct<ann_ord:int,start:int,end:int,exact:boolean>>"

    @F.udf(returnType=schema, useArrow=True)
    def place(text, rows):
        return anchor(text, ((r["ann_ord"], r["quote"], r["type"]) for r in rows))

    lists = annotations.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ann_ord").cast("int").alias("ann_ord"), "quote", "type"))).alias("rows"))
    return lists.join(answers.select("answer_id", "text"), "answer_id").select("answer_id", F.inline(place("text", "rows")))


def text_segments(answers: DataFrame, anchored: DataFrame) -> DataFrame:
    """answer_id, seg_start, seg_end, ann_ord, text: an answer cut at its anchored spans; ann_ord is null between them."""
    order = Window.partitionBy("answer_id").orderBy("start")
    spans = anchored.select("answer_id", "ann_ord", "start", "end", F.coalesce(F.lag("end").over(order), F.lit(0)).alias("gap_start"))
    last = answers.select("answer_id", F.char_length("text").alias("n")).join(anchored.groupBy("answer_id").agg(F.max("end").alias("gap_start")), "answer_id", "left")
    none = F.lit(None).cast("int").alias("ann_ord")
    cuts = (
        spans.select("answer_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "ann_ord")
        .unionByName(spans.where("start > gap_start").select("answer_id", F.col("gap_start").alias("seg_start"), F.col("start").alias("seg_end"), none))
        .unionByName(last.where("n > coalesce(gap_start, 0)").select("answer_id", F.coalesce("gap_start", F.lit(0)).alias("seg_start"), F.col("n").alias("seg_end"), none))
    )
    return cuts.join(answers.select("answer_id", "text"), "answer_id").select("answer_id", "seg_start", "seg_end", "ann_ord", F.substring("text", F.col("seg_start") + 1, F.col("seg_end") - F.col("seg_start")).alias("text"))


def page_tiers(aligned: DataFrame) -> DataFrame:
    """doc_id, page, tier of each page."""
    return aligned.groupBy("doc_id", "page").agg(F.max("tier").alias("tier"))


def placed_counts(boxes: DataFrame, tiers: DataFrame, key: str) -> DataFrame:
    """key, n_placed: spans of a document with a box on at least one trusted page.

    boxes: key, span_id, page. tiers: key, page, tier.
    """
    shown = trusted(boxes.join(tiers.select(key, "page", "tier"), [key, "page"]))
    return shown.groupBy(key).agg(F.count_distinct("span_id").alias("n_placed"))


def range_tier(ranges: DataFrame, tiers: DataFrame, key: str) -> DataFrame:
    """key, range_id, tier: the worst geometry over each page range; a page without a measure counts as none.

    ranges: key, range_id, page_start, page_end. The pages of a range meet
    their measures by equality.
    """
    pages = ranges.where("page_start <= page_end").select(key, "range_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    joined = pages.join(tiers.select(key, "page", "tier"), [key, "page"], "left")
    return worst_tier(joined, [key, "range_id"])
