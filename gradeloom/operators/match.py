"""Answers assembled from claimed lines: proposals applied, gaps bounded, listings cut to a budget."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.labels import label_key
from gradeloom.functions.marks import is_too_short
from gradeloom.session import prepare

#: Confidence of a proposal taken from a model, and the most for an answer that is too short.
PROPOSED, TOO_SHORT = 70, 40


def apply_proposals(proposals: DataFrame, questions: DataFrame, lines: DataFrame, claimed: DataFrame, assigned: DataFrame) -> DataFrame:
    """paper_id, question_id, line_ids, confidence, method: proposed lines that exist and that nobody claimed before.

    proposals: paper_id, exam_id, prop_ord, question_number, line_ids.
    questions: exam_id, question_id, ord, number; of equal keys the last has the key. lines: paper_id, line_id,
    line_index. claimed: paper_id, line_id. assigned: paper_id, question_id.
    Within a paper the first proposal takes a question, and then its lines; a
    proposal whose lines are all gone takes nothing, and leaves its question to
    the next. Hence a pass per paper, in order.
    """
    prepare(proposals.sparkSession)
    keyed = questions.select("exam_id", "question_id", "ord", label_key(F.col("number")).alias("key")).where("key <> ''").groupBy("exam_id", "key").agg(F.max_by("question_id", "ord").alias("question_id"))
    named = proposals.select("paper_id", "exam_id", "prop_ord", label_key(F.col("question_number")).alias("key"), F.posexplode("line_ids").alias("pos", "line_id"))
    free = lines.select("paper_id", "line_id", "line_index").join(claimed.select("paper_id", "line_id").distinct(), ["paper_id", "line_id"], "left_anti")
    usable = named.join(keyed, ["exam_id", "key"]).join(assigned.select("paper_id", "question_id").distinct(), ["paper_id", "question_id"], "left_anti").join(free, ["paper_id", "line_id"])

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        questions_done: set[str] = set()
        lines_done: set[str] = set()
        out = []
        for _, own in rows.sort_values(["prop_ord", "line_index"]).groupby("prop_ord", sort=True):
            qid = own["question_id"].iloc[0]
            ids = [x for x in dict.fromkeys(own["line_id"]) if x not in lines_done]
            if qid in questions_done or not ids:
                continue
            questions_done.add(qid)
            lines_done.update(ids)
            out.append((own["paper_id"].iloc[0], qid, ids, PROPOSED, "model"))
        return pd.DataFrame(out, columns=["paper_id", "question_id", "line_ids", "confidence", "method"])

    return usable.groupBy("paper_id").applyInPandas(take, "paper_id bigint, question_id string, line_ids array<string>, confidence int, method string")


def unmatched_runs(questions: DataFrame) -> DataFrame:
    """paper_id, run_id, n_questions, question_ids, after_index, before_index: islands of questions without an answer.

    questions: paper_id, ord, question_id, first_index, last_index, matched. The
    bounds are the last line of the nearest matched question before and the
    first line of the nearest after that have lines; -1 and null where there is
    none.
    """
    order = Window.partitionBy("paper_id").orderBy("ord")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    bounded = questions.withColumns({
        "run_id": F.sum(F.col("matched").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "after_index": F.last(F.when(F.col("matched"), F.col("last_index")), ignorenulls=True).over(before),
        "before_index": F.first(F.when(F.col("matched"), F.col("first_index")), ignorenulls=True).over(after),
    })
    return bounded.where(~F.col("matched")).groupBy("paper_id", F.coalesce("run_id", F.lit(0)).alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "question_id"))), lambda x: x["question_id"]), ",").alias("question_ids"),
        F.coalesce(F.max("after_index"), F.lit(-1)).alias("after_index"), F.max("before_index").alias("before_index"),
    )


def gap_candidates(runs: DataFrame, free_lines: DataFrame) -> DataFrame:
    """paper_id, run_id, line_id: the free lines between the bounds of each run; all free lines of the paper for a run with an empty gap."""
    within = (F.col("line_index") > F.col("after_index")) & (F.col("before_index").isNull() | (F.col("line_index") < F.col("before_index")))
    joined = runs.join(free_lines.select("paper_id", "line_id", "line_index"), "paper_id").withColumn("within", within)
    some = F.max("within").over(Window.partitionBy("paper_id", "run_id"))
    return joined.withColumn("some", some).where("within or not some").select("paper_id", "run_id", "line_id")


def line_windows(costs: Iterable[int], budget: int = 6000, overlap: float = 0.1) -> Iterator[list[int]]:
    """Places of consecutive items in windows within a budget, each opening with the last tenth of the one before, one at least."""
    window: list[int] = []
    spent = 0
    held: dict[int, int] = {}
    for place, cost in enumerate(costs):
        held[place] = cost
        if window and spent + cost > budget:
            yield window
            window = window[-max(1, int(len(window) * overlap + 0.5)) :]
            spent = sum(held[p] for p in window)
        window.append(place)
        spent += cost
    if window:
        yield window


def question_batches(costs: Iterable[int], budget: int = 2000, most: int = 8) -> Iterator[list[int]]:
    """Places of consecutive items in batches within a budget and a number."""
    batch: list[int] = []
    spent = 0
    for place, cost in enumerate(costs):
        if batch and (spent + cost > budget or len(batch) >= most):
            yield batch
            batch, spent = [], 0
        batch.append(place)
        spent += cost
    if batch:
        yield batch


def chunk_lines(lines: DataFrame, budget: int = 6000) -> DataFrame:
    """paper_id, window_ord, n_lines, first_line, last_line, n_chars: listings of a paper's lines within a budget. An accumulator that resets, hence a pass per paper."""
    prepare(lines.sparkSession)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(["line_index", "line_id"])
        ids, costs = list(own["line_id"]), [len(t or "") + 12 for t in own["text"]]
        out = [(rows["paper_id"].iloc[0], k, len(w), ids[w[0]], ids[w[-1]], sum(costs[i] for i in w)) for k, w in enumerate(line_windows(costs, budget))]
        return pd.DataFrame(out, columns=["paper_id", "window_ord", "n_lines", "first_line", "last_line", "n_chars"])

    return lines.select("paper_id", "line_index", "line_id", "text").groupBy("paper_id").applyInPandas(cut, "paper_id bigint, window_ord int, n_lines int, first_line string, last_line string, n_chars int")


def chunk_questions(questions: DataFrame, budget: int = 2000, most: int = 8) -> DataFrame:
    """exam_id, batch_ord, n_questions, n_chars: batches of an exam's questions within a budget."""
    prepare(questions.sparkSession)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("ord")
        costs = [min(240, len(f"{n}. {t}")) + 1 for n, t in own[["number", "text"]].itertuples(index=False)]
        out = [(rows["exam_id"].iloc[0], k, len(b), sum(costs[i] for i in b)) for k, b in enumerate(question_batches(costs, budget, most))]
        return pd.DataFrame(out, columns=["exam_id", "batch_ord", "n_questions", "n_chars"])

    return questions.select("exam_id", "ord", "number", "text").groupBy("exam_id").applyInPandas(cut, "exam_id bigint, batch_ord int, n_questions int, n_chars int")


def assembled_answer(answer: Column, max_marks: Column, confidence: Column) -> tuple[Column, Column]:
    """(skipped, confidence) of an answer: too short for its marks means skipped, with little confidence; the text stays."""
    short = is_too_short(answer, max_marks)
    return short, F.when(short, F.least(confidence, F.lit(TOO_SHORT))).otherwise(confidence)
