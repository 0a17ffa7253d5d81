"""The seam to a language model: prompts in, replies out, everything after it deterministic.

A model is a plain function from prompt to reply. It runs in Arrow batches on
the executors; as many requests are in flight as the stage has tasks. Replies
are untrusted and go through operators.replies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.replies import recover_replies
from gradeloom.session import prepare

#: A tab and a line break beside each listed line, and a name for it.
LISTING_COST = 12


#: Times that a failing request is tried, and seconds before the second try; each further wait is twice as long.
ATTEMPTS, FIRST_WAIT = 3, 0.5


class Busy(Exception):
    """What a model raises when it may be asked again later, after so many seconds if it says so."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__(f"busy, again in {seconds} s" if seconds else "busy")
        self.seconds = seconds


def ask(prompts: DataFrame, model: Callable[[str], str], in_flight: int | None = None, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> DataFrame:
    """prompts with raw (the reply) and failure (why there is none): a null prompt has neither.

    in_flight bounds the requests at a time, by partitions. A model that raises
    Busy is asked again, up to `attempts` times; any other failure costs its own
    row only, and can be told from an empty reply.
    """
    prepare(prompts.sparkSession)

    @F.udf(returnType="struct<raw:string,failure:string>", useArrow=True)
    def reply(prompt):
        import time

        wait = first_wait
        for turn in range(attempts):
            try:
                return None if prompt is None else (model(prompt), None)
            except Exception as e:  # noqa: BLE001
                failure = f"{type(e).__name__}: {e}"
                if not hasattr(e, "seconds") or turn + 1 == attempts:
                    break
                time.sleep(e.seconds or wait)
                wait *= 2
        return None, failure

    spread = prompts.repartition(in_flight) if in_flight else prompts
    return spread.withColumn("reply", reply("prompt")).withColumns({"raw": F.col("reply.raw"), "failure": F.col("reply.failure")}).drop("reply")


def ask_for(prompts: DataFrame, model: Callable[[str], str], schema: dict, in_flight: int | None = None) -> DataFrame:
    """prompts with value (coerced JSON) and error: that of the model, else that of its reply."""
    read = recover_replies(ask(prompts, model, in_flight), schema).drop("raw")
    return read.withColumn("error", F.coalesce("failure", "error")).drop("failure")


def grouped_by_model(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, group_ord, question_number, answer_line_ids, answer_text, page_start, page_end: proposed groups of lines that exist.

    groups: doc_id, group_ord, question_number, line_ids. lines: doc_id,
    line_id, line_index, page, text. Ids that no line has are dropped, and
    groups without any; lines come in reading order. A group without a number
    has its place as its number.
    """
    named = groups.select("doc_id", "group_ord", F.coalesce("question_number", F.col("group_ord").cast("string")).alias("question_number"), F.explode(F.array_distinct("line_ids")).alias("line_id"))
    found = named.join(lines.select("doc_id", "line_id", "line_index", "page", "text"), ["doc_id", "line_id"])
    own = found.groupBy("doc_id", "group_ord", "question_number").agg(F.array_sort(F.collect_list(F.struct("line_index", "line_id", "text", "page"))).alias("l"))
    return own.select(
        "doc_id", "group_ord", "question_number", F.transform("l", lambda x: x["line_id"]).alias("answer_line_ids"),
        F.array_join(F.transform("l", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("answer_text"),
        F.element_at("l", 1)["page"].alias("page_start"), F.element_at("l", -1)["page"].alias("page_end"),
    )
