"""Passages of reference material and their retrieval by BM25, as joins over an inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradeloom.functions.scans import split_sentences
from gradeloom.functions.text import hash_string, normalize_text, tokenize
from gradeloom.session import checkpointed, prepare

# Term saturation and length normalisation of the ranking, and the coverage under which it is weak.
K1, B, WEAK_COVERAGE = 1.5, 0.75, 0.45
#: What sums of floating-point numbers may differ by, on the safe side.
NEARLY = 1e-6
#: Words after which a passage is closed, and sentences that the next one repeats.
PASSAGE_WORDS, OVERLAP = 110, 1

_PASSAGE = ArrayType(StructType([StructField("ord", IntegerType()), StructField("text", StringType())]))


def cut_passages(text: str | None, target: int = PASSAGE_WORDS, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(ord, text) of each passage: whole sentences up to `target` words, each opening with the last sentence before it.

    The end makes a passage of its own only if it has more than the repeated
    sentence, or is all there is.
    """
    found: list[tuple[int, str]] = []
    held: list[str] = []
    words = 0
    fresh = 0
    for sentence, _, _ in split_sentences(text):
        held.append(sentence)
        words += len(sentence.split())
        fresh += 1
        if words >= target:
            found.append((len(found) + 1, " ".join(held)))
            held = held[-overlap:] if overlap else []
            words = sum(len(s.split()) for s in held)
            fresh = 0
    if held and (len(held) > overlap or not found):
        found.append((len(found) + 1, " ".join(held)))
    return found


@F.udf(returnType=_PASSAGE, useArrow=True)
def passages_of(text):
    """Column form of cut_passages."""
    return cut_passages(text)


def chunk_documents(documents: DataFrame, kept: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, source, the kept columns, ord, chunk_id, text: the passages of each document; null and empty texts have none.

    documents: doc_id, source, text; a page of a source may be a document, with
    its page kept. The id names source, place and hash.
    """
    cut = documents.select("doc_id", "source", *kept, F.inline(passages_of(F.col("text")))).where(normalize_text(F.col("text")) != "")
    return cut.select("doc_id", "source", *kept, "ord", F.concat(F.coalesce("source", F.lit("ref")), F.lit("#"), "ord", F.lit("-"), hash_string(F.col("text"))).alias("chunk_id"), "text")


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf: stems of each passage. chunks: chunk_id, text."""
    return chunks.select("chunk_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, n_terms: the length of each passage in stems; passages without any have 0."""
    return chunks.select("chunk_id", F.size(tokenize(F.col("text"))).alias("n_terms"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """term, df: passages that hold each stem."""
    return chunks.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, term_ord: distinct stems of each query, by first place."""
    return queries.select("query_id", F.posexplode(F.array_distinct(tokenize(F.col("query")))).alias("term_ord", "term"))


def _index(chunks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequencies, df, sizes) of passages, tokenised once: terms with their passages, in how many passages they are, and count and mean length of the passages."""
    tokens = chunks.select(*keys, "chunk_id", tokenize(F.col("text")).alias("terms"))
    frequencies = checkpointed(tokens.select(*keys, "chunk_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy(*keys, "chunk_id", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf")))
    # Passages without a stem count too; their number needs no text.
    counted = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chunks"))
    summed = frequencies.groupBy(*keys).agg(F.sum("tf").alias("n_stems"))
    mean = (F.coalesce("n_stems", F.lit(0)) / F.col("n_chunks")).alias("mean")
    sizes = counted.join(summed, keys, "left").select(*keys, "n_chunks", mean) if keys else counted.select("n_chunks", F.coalesce(summed.select("n_stems").scalar() / F.col("n_chunks"), F.lit(0.0)).alias("mean"))
    return frequencies, frequencies.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df")), sizes


def _gain(mean: Column) -> Column:
    norm = 1 - B + B * F.col("n_terms") / F.when(mean == 0, 1.0).otherwise(mean)
    return (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("gain")


def _idf(n: Column) -> Column:
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")


def bm25_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, first_term: every passage that shares a stem with a query.

    queries: query_id, query. chunks: chunk_id, text, ids unique. Each term
    meets its postings by an equality join, and the products are summed per
    query and passage on the map side first. This is the whole result: for the
    best passages alone, see bm25_top.
    """
    frequencies, df, sizes = _index(chunks, [])
    whole = sizes.first()
    postings = frequencies.select("chunk_id", "term", _gain(F.lit(whole["mean"])))
    wanted = query_terms(queries).join(df.select("term", _idf(F.lit(whole["n_chunks"]))), "term")
    return postings.join(wanted, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("gain")).alias("score"), F.min("term_ord").alias("first_term"))


def bm25_top(queries: DataFrame, chunks: DataFrame, top_k: int = 3, first_postings: int = 12) -> DataFrame:
    """query_id, rk, chunk_id, score: the best passages of each query, the same as of all scores, with far fewer of them taken.

    The rarest terms of a query, with `first_postings` postings between them,
    give a bound: the top_k-th best sum over these alone. A query's most common
    terms whose greatest gains together stay under the bound can't bring in a
    passage; only those found by the other terms, and within reach of the bound
    with all the rest, are scored to the end.
    """
    frequencies, df, sizes = _index(chunks, [])
    whole = sizes.first()
    postings = frequencies.select("chunk_id", "term", _gain(F.lit(whole["mean"])))
    peaks = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("gain").alias("peak"))
    weights = peaks.select("term", "df", _idf(F.lit(whole["n_chunks"])), "peak").withColumn("most", F.col("idf") * F.col("peak"))
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    wanted = query_terms(queries).join(weights, "term").withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0)))
    gained = F.sum(F.col("idf") * F.col("gain"))
    leading = wanted.where(F.col("before") < first_postings).join(postings, "term").groupBy("query_id", "chunk_id").agg(gained.alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc()))
    bounds = leading.withColumn("place", place).where(F.col("place") == top_k).select("query_id", F.col("s").alias("bound"))
    cheapest = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = wanted.join(bounds, "query_id", "left").withColumn("reach", F.sum("most").over(cheapest)).withColumn("optional", F.coalesce(F.col("reach") < F.col("bound") - NEARLY, F.lit(False)))
    split = checkpointed(split.select("query_id", "term", "term_ord", "idf", "most", "bound", "optional"))
    spare = split.groupBy("query_id").agg(F.coalesce(F.max("bound"), F.lit(0.0)).alias("bound"), F.sum(F.when(F.col("optional"), F.col("most")).otherwise(0.0)).alias("spare"))
    found = split.where("not optional").join(postings, "term").groupBy("query_id", "chunk_id").agg(gained.alias("score"), F.min("term_ord").alias("first_term"))
    near = checkpointed(found.join(spare, "query_id").where(F.col("score") + F.col("spare") >= F.col("bound") - NEARLY).drop("bound", "spare"))
    rest = near.select("query_id", "chunk_id").join(split.where("optional").select("query_id", "term", "term_ord", "idf"), "query_id").join(postings, ["term", "chunk_id"])
    more = rest.select("query_id", "chunk_id", (F.col("idf") * F.col("gain")).alias("score"), F.col("term_ord").alias("first_term"))
    scores = near.select("query_id", "chunk_id", "score", "first_term").unionByName(more).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"), F.min("first_term").alias("first_term"))
    return top_evidence(scores, top_k)


def bm25_within(queries: DataFrame, chunks: DataFrame, scope: str, top_k: int = 2) -> DataFrame:
    """scope, query_id, rk, chunk_id, score: the best passages of each query among those of its own scope, each scope a corpus of its own."""
    frequencies, df, sizes = _index(chunks, [scope])
    postings = frequencies.join(sizes, scope).select(scope, "chunk_id", "term", _gain(F.col("mean")))
    weights = df.join(sizes, scope).select(scope, "term", _idf(F.col("n_chunks")))
    terms = queries.select(scope, "query_id", F.posexplode(F.array_distinct(tokenize(F.col("query")))).alias("term_ord", "term")).join(weights, [scope, "term"])
    scores = terms.join(postings, [scope, "term"]).groupBy(scope, "query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("gain")).alias("score"), F.min("term_ord").alias("first_term"))
    order = Window.partitionBy(scope, "query_id").orderBy(F.round("score", 9).desc(), "first_term", "chunk_id")
    return scores.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top_k).select(scope, "query_id", "rk", "chunk_id", "score")


def top_evidence(scores: DataFrame, top_k: int = 3) -> DataFrame:
    """query_id, rk, chunk_id, score: the best passages of each query; ties by first matching term, then id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_term", "chunk_id")
    return scores.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top_k).select("query_id", "rk", "chunk_id", "score")


def evidence_coverage(queries: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, n_terms, n_hit, coverage, weak: the share of a query's stems that its evidence holds."""
    wanted = query_terms(queries).select("query_id", "term")
    held = evidence.select("query_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).distinct()
    joined = wanted.join(held.withColumn("hit", F.lit(1)), ["query_id", "term"], "left")
    sums = joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count("hit").alias("n_hit"))
    coverage = F.col("n_hit") / F.col("n_terms")
    return sums.select("query_id", "n_terms", "n_hit", coverage.alias("coverage"), (coverage < WEAK_COVERAGE).alias("weak"))


def prepend_paired(evidence: DataFrame, paired: DataFrame, most: int = 4) -> DataFrame:
    """query_id, rk, chunk_id, score: evidence with a paired model answer first, each id once, up to `most` a query.

    paired: query_id, chunk_id; its score is 1.
    """
    first = paired.select("query_id", F.lit(0).alias("rk"), "chunk_id", F.lit(1.0).alias("score"))
    once = first.unionByName(evidence.select("query_id", "rk", "chunk_id", "score")).groupBy("query_id", "chunk_id").agg(F.min_by("score", "rk").alias("score"), F.min("rk").alias("rk"))
    ranked = once.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("rk", "chunk_id")))
    return ranked.where(F.col("rk") <= most).select("query_id", "rk", "chunk_id", "score")


def paired_coverage(coverage: DataFrame, paired: DataFrame) -> DataFrame:
    """coverage (query_id, coverage, weak and others) where a query with a paired model answer is covered in full."""
    held = paired.select("query_id").distinct().withColumn("paired", F.lit(True))
    joined = coverage.join(held, "query_id", "left")
    full = F.col("paired").isNotNull()
    return joined.withColumns({"coverage": F.when(full, 1.0).otherwise(F.col("coverage")), "weak": ~full & F.col("weak")}).drop("paired")


class Retriever(Protocol):
    """What the operators ask of a source of evidence; BM25 and vector search both offer it."""

    def search(self, queries: DataFrame, top_k: int = 3) -> DataFrame:
        """query_id, rk, chunk_id, score for queries."""


class Bm25Retriever:
    """Evidence by BM25 over passages (chunk_id, text), for queries (query_id, query)."""

    def __init__(self, chunks: DataFrame) -> None:
        self.chunks = chunks

    def search(self, queries: DataFrame, top_k: int = 3) -> DataFrame:
        """See Retriever."""
        return bm25_top(queries, self.chunks, top_k)


class VectorRetriever:
    """Evidence by cosine similarity over embedded passages (chunk_id, embedding), for queries (query_id, embedding).

    Every query is held against every passage, in blocks of `block` queries that
    travel to the partitions of the passages, which hand on their best top_k:
    what is broadcast is one block, whatever the number of queries. Null, empty
    and zero vectors, and those of another length, match nothing.
    """

    def __init__(self, chunks: DataFrame, block: int = 4096) -> None:
        self.chunks, self.block = chunks, block

    def search(self, queries: DataFrame, top_k: int = 3) -> DataFrame:
        """See Retriever; ties go to the first id."""
        spark = prepare(queries.sparkSession)
        kind = dict(self.chunks.dtypes)["chunk_id"]
        query_kind = dict(queries.dtypes)["query_id"]
        schema = f"query_id {query_kind}, chunk_id {kind}, score double"
        narrow = self.chunks.where("embedding is not null").select("chunk_id", "embedding")
        found = spark.createDataFrame([], schema)
        held: list = []

        def best_of(block: Broadcast) -> DataFrame:
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                ids, matrix = block.value
                for frame in frames:
                    rows = frame[[len(e) == matrix.shape[1] for e in frame["embedding"]]]
                    if not len(rows):
                        continue
                    vectors = np.array(rows["embedding"].tolist(), dtype=np.float64)
                    lengths = np.linalg.norm(vectors, axis=1)
                    rows, vectors = rows[lengths > 0], vectors[lengths > 0] / lengths[lengths > 0][:, None]
                    order = np.argsort(rows["chunk_id"].to_numpy(), kind="stable")
                    names, scores = rows["chunk_id"].to_numpy()[order], np.round(matrix @ vectors[order].T, 12)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :top_k]
                    yield pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "chunk_id": names[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()})

            return narrow.mapInPandas(run, schema)

        def block_of(rows: list) -> Broadcast:
            matrix = np.array([v for _, v in rows], dtype=np.float64)
            return spark.sparkContext.broadcast((np.array([i for i, _ in rows]), matrix / np.linalg.norm(matrix, axis=1)[:, None]))

        width = None
        for row in queries.select("query_id", "embedding").where("embedding is not null and size(embedding) > 0").toLocalIterator():
            width = width or len(row["embedding"])
            if len(row["embedding"]) == width and any(row["embedding"]):
                held.append((row["query_id"], row["embedding"]))
            if len(held) == self.block:
                found, held = found.unionByName(checkpointed(_top(best_of(block_of(held)), top_k))), []
        if held:
            found = found.unionByName(best_of(block_of(held)))
        return _top(found, top_k).withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).select("query_id", "rk", "chunk_id", "score")


def _top(scores: DataFrame, top_k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return scores.withColumn("place", place).where(F.col("place") <= top_k).drop("place")
