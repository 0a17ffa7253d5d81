"""Blocks of writing aligned with the questions of an exam: by label, by looser readings of it, and by content.

The first route, equal keys, is a join. The later ones depend on what earlier
blocks of the same paper have claimed, so they run per paper, on the blocks and
questions that the join left over.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.labels import label_key, label_parts_of, same_part_of
from gradeloom.functions.text import STOPWORDS
from gradeloom.operators.retrieval import bm25_within, chunk_documents
from gradeloom.session import checkpointed, prepare

# What each route is worth, of a hundred.
LABEL, LOOSE, PARTIAL, CONTENT = 95, 88, 76, 62
ALIGNED = "paper_id bigint, block_ord bigint, question_id string, confidence int, method string"
_STOP = frozenset(STOPWORDS)


def align_by_label(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id, block_ord, question_id, confidence, method: the earliest block whose key is a question's.

    blocks: paper_id, exam_id, block_ord, label, text. questions: exam_id,
    question_id, ord, number, text. Of questions with equal keys the first has
    it; every question and every block is claimed once.
    """
    first = Window.partitionBy("exam_id", "key").orderBy("ord")
    keyed = questions.select("exam_id", "question_id", "ord", label_key(F.col("number")).alias("key")).where("key <> ''")
    owners = keyed.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "ord")
    named = blocks.select("paper_id", "exam_id", "block_ord", label_key(F.col("label")).alias("key")).where("key <> ''")
    claims = named.join(owners, ["exam_id", "key"]).groupBy("paper_id", "question_id").agg(F.min("block_ord").alias("block_ord"))
    return claims.select("paper_id", "block_ord", "question_id", F.lit(LABEL).alias("confidence"), F.lit("label").alias("method"))


def stem_of(w: str) -> str:
    """Plain form of functions.text.stem."""
    for least, end, cut, add in ((4, "ies", 3, "y"), (4, "sses", 2, "")):
        if len(w) > least and w.endswith(end):
            return w[:-cut] + add
    if len(w) > 3 and w.endswith("es") and w[-3] not in "aeiou":
        return w[:-2]
    if len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    for end in ("ing", "ed"):
        if len(w) > 5 and w.endswith(end):
            return w[: -len(end)]
    return w


def stems_of(text: str | None) -> set[str]:
    """Distinct stems of a text; plain form of functions.text.tokenize."""
    words = re.findall("[a-z0-9]+", re.sub("[^A-Za-z0-9]+", " ", text or "").lower())
    return {stem_of(w) for w in words if w not in _STOP and len(w) > 1}


def claim_rest(blocks: list[tuple[int, str | None, str | None]], questions: list[tuple[str, str | None, str | None]], least: float, margin: float) -> list[tuple[int, str, int, str]]:
    """(block_ord, question_id, confidence, method) for one paper's blocks (ord, label, text) and free questions (id, number, text).

    Routes in turn: labels that agree as far as the shorter goes; labels with
    the same first level; the one question whose stems overlap clearly most. A
    label route needs exactly one free candidate.
    """
    free = {qid: (label_parts_of(number), stems_of(text)) for qid, number, text in questions}
    open_blocks = {order: (label_parts_of(label), text) for order, label, text in blocks}
    claims: list[tuple[int, str, int, str]] = []

    def claim(order: int, qid: str, confidence: int, method: str) -> None:
        claims.append((order, qid, confidence, method))
        del free[qid], open_blocks[order]

    def agrees(a: list[str], b: list[str]) -> bool:
        return bool(a) and all(same_part_of(x, y) for x, y in zip(a, b))

    for confidence, method, fits in ((LOOSE, "label-loose", agrees), (PARTIAL, "label-partial", lambda a, b: bool(a) and same_part_of(a[0], b[0]))):
        for order in sorted(open_blocks):
            parts = open_blocks[order][0]
            if parts:
                able = [qid for qid, (own, _) in free.items() if fits(own, parts)]
                if len(able) == 1:
                    claim(order, able[0], confidence, method)
    for order in sorted(open_blocks):
        text = open_blocks[order][1]
        stems = stems_of(text)
        if len(" ".join(re.findall("[A-Za-z0-9]+", text or ""))) < 20 or not stems:
            continue
        scored = sorted(((len(stems & own) / len(stems | own), -i, qid) for i, (qid, (_, own)) in enumerate(free.items()) if own and stems & own), reverse=True)
        if scored and scored[0][0] >= least and (len(scored) < 2 or scored[0][0] >= scored[1][0] * margin):
            claim(order, scored[0][2], CONTENT, "content")
    return claims


def align_questions(blocks: DataFrame, questions: DataFrame, least_content: float = 0.12, margin: float = 1.4) -> DataFrame:
    """paper_id, block_ord, question_id, confidence, method: all routes; see align_by_label for the columns.

    least_content over 1 turns the content route off. Blocks that no route
    places have no row. Null labels and texts place nothing.
    """
    prepare(blocks.sparkSession)
    # Read three times: as a result, and to leave out the blocks and the questions that it settles.
    by_label = checkpointed(align_by_label(blocks, questions))
    own = blocks.select("paper_id", "exam_id", "block_ord", "label", "text")
    left_blocks = checkpointed(own.join(by_label.select("paper_id", "block_ord"), ["paper_id", "block_ord"], "left_anti"))
    papers = left_blocks.select("paper_id", "exam_id").distinct()
    asked = questions.select("exam_id", "question_id", "ord", "number", F.col("text").alias("q_text"))
    left_questions = papers.join(asked, "exam_id").join(by_label.select("paper_id", "question_id"), ["paper_id", "question_id"], "left_anti").select(F.col("paper_id").alias("q_paper"), "question_id", "ord", "number", "q_text")

    # Papers without a question left need no pass.
    open_blocks = left_blocks.join(left_questions.select(F.col("q_paper").alias("paper_id")).distinct(), "paper_id", "left_semi")

    def place(block_rows: pd.DataFrame, question_rows: pd.DataFrame) -> pd.DataFrame:
        own = [(int(o), x, t) for o, x, t in block_rows.sort_values("block_ord")[["block_ord", "label", "text"]].itertuples(index=False)]
        asked = list(question_rows.sort_values("ord")[["question_id", "number", "q_text"]].itertuples(index=False, name=None))
        paper = block_rows["paper_id"].iloc[0] if len(block_rows) else None
        claims = claim_rest(own, asked, least_content, margin) if own and asked else []
        return pd.DataFrame([(paper, *c) for c in claims], columns=["paper_id", "block_ord", "question_id", "confidence", "method"])

    rest = open_blocks.select("paper_id", "block_ord", "label", "text").groupBy("paper_id").cogroup(left_questions.groupBy("q_paper")).applyInPandas(place, ALIGNED)
    return by_label.select(F.col("paper_id").cast("bigint"), F.col("block_ord").cast("bigint").alias("block_ord"), "question_id", "confidence", "method").unionByName(rest)


# Characters of a model answer that serve as evidence.
PAIRED_CHARS = 2000


def pair_reference(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id, question_id, section_ord, confidence, method: model answers paired with questions, by labels alone.

    sections: doc_id, exam_id, head_index, label, text; the result names the
    document as paper_id.
    """
    blocks = sections.select(F.col("doc_id").alias("paper_id"), "exam_id", F.col("head_index").alias("block_ord"), "label", "text")
    return align_questions(blocks, questions, least_content=2.0).withColumnRenamed("block_ord", "section_ord")


def paired_evidence(pairs: DataFrame, sections: DataFrame, questions: DataFrame) -> DataFrame:
    """paper_id, question_id, chunk_id, text, score: each paired model answer as evidence, with an id of its own and full score.

    pairs: see pair_reference. sections: doc_id, exam_id, head_index, text.
    questions: exam_id, question_id, number. Blank model answers are none.
    """
    own = sections.where(F.trim("text") != "").select(F.col("doc_id").alias("paper_id"), "exam_id", F.col("head_index").alias("section_ord"), "text")
    named = questions.select("exam_id", "question_id", label_key(F.col("number")).alias("key"))
    joined = pairs.join(own, ["paper_id", "section_ord"]).join(named, ["exam_id", "question_id"])
    name = F.when(F.col("key") != "", F.col("key")).otherwise(F.col("question_id"))
    return joined.select("paper_id", "question_id", F.concat(F.lit("refq-"), name).alias("chunk_id"), F.substring("text", 1, PAIRED_CHARS).alias("text"), F.lit(1.0).alias("score"))


def answer_key_sections(keys: DataFrame, sections: DataFrame, questions: DataFrame, whole: int = 1500, cut: int = 1800, asked: int = 800) -> DataFrame:
    """exam_id, question_id, scope, text: the part of an exam's answer key for each question.

    keys: exam_id, text. sections: exam_id, head_index, label, text. questions:
    exam_id, question_id, number, text. A short key is given whole; else the
    first section with the question's key; else the two passages of the key
    that fit number and text of the question best (retrieved); else the head of
    the key; each up to `cut` characters. Exams without a key have scope none.
    """
    first = Window.partitionBy("exam_id", "key").orderBy("head_index")
    keyed = sections.select("exam_id", "head_index", label_key(F.col("label")).alias("key"), F.col("text").alias("section")).where("key <> ''")
    own = keyed.withColumn("k", F.row_number().over(first)).where("k = 1").select("exam_id", "key", "section")
    wanted = questions.select("exam_id", "question_id", label_key(F.col("number")).alias("key"), F.substring(F.concat_ws(" ", F.coalesce("number", F.lit("")), F.coalesce("text", F.lit(""))), 1, asked).alias("query"))
    joined = wanted.join(keys.select("exam_id", F.trim("text").alias("body")), "exam_id", "left").join(own, ["exam_id", "key"], "left")
    body = F.coalesce("body", F.lit(""))
    scoped = checkpointed(joined.withColumn("scope", F.when(body == "", "none").when(F.char_length(body) <= whole, "whole").when(F.coalesce("section", F.lit("")) != "", "section").otherwise("open")))
    left = scoped.where("scope = 'open'")
    long_keys = keys.join(left.select("exam_id").distinct(), "exam_id", "left_semi").select(F.col("exam_id").alias("doc_id"), F.lit("answer key").alias("source"), "text")
    passages = checkpointed(chunk_documents(long_keys).select(F.col("doc_id").alias("exam_id"), F.col("ord").alias("chunk_id"), "text"))
    best = bm25_within(left.select("exam_id", F.col("question_id").alias("query_id"), "query"), passages, "exam_id", 2)
    texts = best.join(passages, ["exam_id", "chunk_id"]).groupBy("exam_id", F.col("query_id").alias("question_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "text"))), lambda x: x["text"]), "\n\n").alias("retrieved"))
    all_scopes = scoped.join(texts, ["exam_id", "question_id"], "left")
    scope = F.when(F.col("scope") != "open", F.col("scope")).when(F.trim("retrieved") != "", "retrieved").otherwise("whole")
    text = F.when(F.col("scope") == "section", F.col("section")).when(scope == "retrieved", F.col("retrieved")).otherwise(body)
    return all_scopes.select("exam_id", "question_id", scope.alias("scope"), F.substring(text, 1, cut).alias("text"))
