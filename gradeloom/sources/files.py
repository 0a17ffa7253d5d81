"""Uploaded files as tables: what is accepted, what is cut, and the text of a document in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import trimmed
from gradeloom.operators.review import capped

# File types that are read, one that is refused by name, and the most pages of an upload.
ACCEPTED = ("pdf", "docx", "jpeg", "jpg", "png", "gif", "webp")
LEGACY = "doc"
MOST_PAGES = 30
#: Characters from which a page counts as having a text layer.
LEAST_TEXT = 40


def uploaded_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, content, suffix, accepted of every file under a path, read in place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_acceptance(files)


def with_acceptance(files: DataFrame) -> DataFrame:
    """files with suffix and accepted, by the name in `path`."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("accepted", F.col("suffix").isin(*ACCEPTED))


def decided_uploads(uploads: DataFrame, key: str, most: int = MOST_PAGES) -> DataFrame:
    """key, path, decision, pages_kept, pages_cut of every upload of an owner.

    uploads: key, path, modificationTime, n_pages. decision: `read`, `replaced`
    (by a newer Word document: one is the whole paper), `legacy` (the old binary
    format, to be saved anew) or `unsupported`. Pages beyond `most` for an owner,
    in order of upload, are cut, and told; a Word document has no pages to cut.
    """
    typed = with_acceptance(uploads)
    is_word = F.col("suffix") == "docx"
    newest = Window.partitionBy(key, is_word).orderBy(F.col("modificationTime").desc(), F.col("path").desc())
    decision = F.when(F.col("suffix") == LEGACY, "legacy").when(~F.col("accepted"), "unsupported").when(is_word & (F.row_number().over(newest) > 1), "replaced").otherwise("read")
    decided = typed.withColumn("decision", decision).withColumn("paged", F.when((F.col("decision") == "read") & ~is_word, F.coalesce("n_pages", F.lit(0))).otherwise(0))
    earlier = Window.partitionBy(key).orderBy("modificationTime", "path").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(most) - F.coalesce(F.sum("paged").over(earlier), F.lit(0)))
    kept = F.least(F.col("paged"), left)
    return decided.select(key, "path", "decision", kept.cast("int").alias("pages_kept"), (F.col("paged") - kept).cast("int").alias("pages_cut"))


def page_cut(pages: DataFrame, key: str, order: list[str], most: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) pages of each upload; the dropped ones are a relation to report, not a silence."""
    return capped(pages, key, order, most)


def document_text(text: Column) -> Column:
    """A document's text with one kind of line break, no more than two in a row, and no white space at its ends."""
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return trimmed(F.regexp_replace(unix, r"\n{3,}", "\n\n"))


def has_text_layer(text: Column) -> Column:
    """True if a page holds enough text to need no reading of its image."""
    return F.char_length(document_text(text)) > LEAST_TEXT
