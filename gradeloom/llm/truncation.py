"""Text that lost its end: structural completeness of each value, and the share of cut values per source.

A stack automaton looks for quotes, brackets and escapes left open and for a
broken character at the end. A value without a terminator is then held
against what the corpus says of its last words: words that end sentences
elsewhere complete a text that merely lacks its full stop; a fragment that is
no word, or words that always go on, were cut. A scanned line is a case only
if its next word would have fitted on it, so wrapped lines are none. Lengths at
which the values of a source pile up are its field limits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows
from gradeloom.llm.automaton import half_escape, open_at_end, open_markup
from gradeloom.llm.pages import DIGITAL, HYPHENS, LEAST_SLACK, SIGNS, page_openings, scan_pages
from gradeloom.llm.pairs import ends_in_excuse, is_copied, is_refusal, plain_answer
from gradeloom.llm.vocabulary import CLEAN, END_ONE, END_TWO, NAME, PAIR, STRIP, TERMINATORS, bare, corpus_counts, frequent_keys, frequent_words, masked
from gradeloom.session import checkpointed, prepare

BROKEN = "�"
# Words that a writer ends on with an ellipsis.
OWN_ELLIPSIS = re.compile(r"(?:\b(?:etc|etcétera|usw|more|and so on|so on|on and on|and so forth|und so weiter|así sucesivamente|ainsi de suite)|वगैरह)\W*$")
#: Words that an answer needs before it counts as sentences; a shorter one is a phrase and needs no terminator.
SENTENCE_WORDS = 5
#: Room, in characters, that the end of a paper leaves beside a line.
MOST_SLACK = 10_000


def tail_state(text: str) -> str:
    """How a text ends: `broken` (a broken character or escape), `dots` (an ellipsis), `ended` (by a terminator or closing sign), or `bare`.

    A terminator ends a text even where a quote or bracket is still open:
    writers forget to close these. "R&D" is whole, "&am" is not.
    """
    s = text.rstrip()
    if s.endswith(BROKEN) or half_escape(s):
        return "broken"
    if s.endswith(("...", "…")):
        return "dots"
    closers = s.rstrip("\"'”»)]*_")
    if closers[-1:] in TERMINATORS + ":;" and closers:
        return "ended"
    return "bare"


def is_word(core: str) -> bool:
    """True for letters of any script with their marks, and compounds of them."""
    return bool(core) and core[0] not in "-'’" and all(c.isalpha() or c in "-'’" or "ऀ" <= c <= "ॿ" for c in core)


def breaks_off(tail: str, words: dict[str, int], one: dict[str, int], two: dict[str, int]) -> bool:
    """True if an ellipsis stands where a text was cut: in the middle of a word, or behind words that go on.

    An ellipsis behind "etc", "and so on" and the like is the writer's own, as
    is one behind words that end sentences elsewhere.
    """
    raw = tail.split()
    tokens = [t for t in (x.rstrip(".…") for x in raw) if t]
    # A cut leaves its dots on the word; dots of their own are a placeholder or the writer's.
    if not tokens or not raw[-1].strip(".…") or OWN_ELLIPSIS.search(" ".join(tokens).lower()) or not is_word(bare(tokens[-1])):
        return False
    if bare(tokens[-1]) not in words:
        return not tokens[-1][:1].isupper() or len(tokens) > 1
    return len(tokens) > 1 and not completes(tokens[-2], tokens[-1], words, one, two)


def completes(before: str, last: str, words: dict[str, int], one: dict[str, int], two: dict[str, int]) -> bool:
    """True if a text may well end on these last two tokens, by the corpus."""
    core = last.strip(STRIP)
    if not core:
        return True
    if any(map(str.isdigit, core)) or before.strip(STRIP).isdigit():
        return True
    key = masked(last)
    if masked(before) + " " + key in two:
        return True
    if bare(before) not in words:
        # A misread word before it says nothing.
        return one.get(key, 0) > 0
    if key == NAME:
        # A name that the corpus does not know may be the head of a longer one.
        return bare(last) in words and one.get(bare(last), 0) > 0
    n = words.get(core.lower(), 0)
    return bool(n) and one.get(key, 0) * 4 >= n


def field_limits(lengths: DataFrame, least: int = 5, factor: int = 8, cliff: float = 0.03) -> DataFrame:
    """rec_table, source, length: the lengths at which unterminated values pile up.

    lengths: rec_table, source, length, ended. A limit has at least `least`
    unterminated values of exactly that length, as half of all of it or more.
    They are `factor` times the mean of the lengths within ten characters, or
    nothing is longer in that source, and the share `cliff` of it ends there.
    """
    counted = lengths.groupBy("rec_table", "source", "length").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("ended")).cast("int")).alias("bare"))
    near = counted.select("rec_table", "source", F.explode(F.array(*(F.col("length") + d for d in range(-10, 11) if d))).alias("length"), F.col("n").alias("other")).groupBy("rec_table", "source", "length").agg((F.sum("other") / 20).alias("around"))
    whole = counted.groupBy("rec_table", "source").agg(F.sum("n").alias("total"), F.max("length").alias("longest"))
    joined = counted.join(near, ["rec_table", "source", "length"], "left").join(whole, ["rec_table", "source"])
    piled = F.col("n") >= factor * F.coalesce("around", F.lit(0.0))
    ends_here = (F.col("length") == F.col("longest")) & (F.col("n") >= cliff * F.col("total"))
    return joined.where((F.col("bare") >= least) & (F.col("bare") * 2 >= F.col("n")) & (F.col("length") >= 30) & (piled | ends_here)).select("rec_table", "source", "length")


def _answer_tails(answers: DataFrame) -> DataFrame:
    def tails(rows: Iterable[tuple]) -> Iterator[tuple]:
        for block, source, question, text in rows:
            if not text or not text.strip():
                continue
            state = tail_state(text)
            tokens = text.split()
            if state in ("bare", "dots"):
                plain = plain_answer(text)
                if is_refusal(plain, question) or (question and is_copied(plain, question)):
                    state = "ended"
            left_open = state == "bare" and (bool(open_at_end(text)) or open_markup(text.rstrip()))
            yield block, source, len(text), state, " ".join(tokens[-4:] if state == "dots" else tokens[-2:]), len(tokens), left_open

    schema = "rec_id bigint, source string, length int, state string, tail string, n_words int, left_open boolean"
    return map_rows(answers.select(F.col("block_id").cast("bigint"), F.col("source").cast("string"), F.col("question_text").cast("string"), F.col("answer_text").cast("string")), schema, tails)


def without_words(judged: DataFrame, counts: DataFrame, least: int = 5, times: float = 3.0) -> DataFrame:
    """judged without the fragments that are words after all, though not frequent ones.

    judged: rec_id, reason, core (the last token, bare) and others; kept in the
    checkpoint folder, as it is read twice. A word stands within typed texts,
    `least` times and `times` as often as values end on it so; a fragment
    stands at ends, and else only among the scattered letters of junk.
    """
    kept = checkpointed(judged)
    ends = kept.where("reason = 'fragment'").groupBy("core").agg(F.count(F.lit(1)).alias("n_ends"))
    inner = counts.where((F.col("kind") == CLEAN) & (F.col("n") >= least)).select(F.col("word").alias("core"), F.col("n").alias("n_inner"))
    words = ends.join(inner, "core").where(F.col("n_inner") >= times * F.col("n_ends")).select("core", F.lit("fragment").alias("reason"))
    return kept.join(words, ["core", "reason"], "left_anti").drop("core")


def line_counts(lines: DataFrame) -> DataFrame:
    """corpus_counts of page lines, with sentence ends and pairs, checkpointed."""
    return checkpointed(corpus_counts(lines.select("text", F.coalesce(F.col("source").isin(*DIGITAL), F.lit(False))), ends=True))


def _share(spark: SparkSession, counts: DataFrame) -> tuple[Broadcast, Broadcast]:
    ends = frequent_keys(counts, END_ONE), frequent_keys(counts, END_TWO), frequent_keys(counts, PAIR, least=2)
    return spark.sparkContext.broadcast(frequent_words(counts)), spark.sparkContext.broadcast(ends)


def find_truncated_answers(answers: DataFrame, counts: DataFrame) -> DataFrame:
    """rec_id, source, reason: the answers whose own end is lost, each once.

    answers: block_id, source, question_text, answer_text. counts: see
    line_counts. Refusals, repeated questions and phrases of a few words need no full stop. See
    find_truncated for the reasons and for nulls and repeated rows.
    """
    known, ends = _share(prepare(answers.sparkSession), counts)
    tails = checkpointed(_answer_tails(answers).distinct())
    limits = field_limits(tails.select(F.lit("parsed_questions").alias("rec_table"), "source", "length", (F.col("state") == "ended").alias("ended")))
    judged = _judge_answers(tails, known, ends).join(F.broadcast(limits.drop("rec_table").withColumn("limit", F.lit(True))), ["source", "length"], "left")
    reason = F.when(F.col("limit") & (F.col("state") == "bare"), "limit").otherwise(F.col("verdict"))
    cut = without_words(judged.withColumn("reason", reason).where("reason is not null").select("rec_id", "source", "reason", "core"), counts)
    return cut.groupBy("rec_id").agg(F.max("source").alias("source"), F.min("reason").alias("reason"))


def find_truncated(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """rec_table, rec_id, source, reason: each value that lost its end, once.

    lines: line_uid, paper_id, page, line_index, source, text. answers: see
    find_truncated_answers. reason is `broken` (character or escape), `limit`
    (cut at a field limit of its source), `fragment` (the last word is none)
    or `open` (the last words never end a sentence, or a bracket, quote or
    markup stays open). Null and empty texts are
    no cases; rows repeated or delivered twice count once; other columns are
    ignored. Lines of list, table and junk pages can only be `broken`.
    """
    spark: SparkSession = prepare(lines.sparkSession)
    counts = line_counts(lines)
    known, ends = _share(spark, counts)
    scanned = checkpointed(scan_pages(lines, known, noise=False, cuts=True))

    # Lines that end on a number are labels and furniture more than text.
    measured = scanned.where("what = 'unread' or (what in ('tail', 'last_tail') and not a rlike '[0-9][^ ]*$')")
    limits = field_limits(measured.select(F.lit("ocr_lines").alias("rec_table"), "source", F.col("x").alias("length"), (F.col("what") == "unread").alias("ended")))
    broken = lines.where(F.col("text").rlike(BROKEN + r"\s*$")).select(F.col("line_uid").cast("bigint").alias("rec_id"), "source", F.lit("broken").alias("reason"))
    openings = page_openings(scanned).select("paper_id", "page", F.concat_ws("\t", "b", "a").alias("opening"))
    tail_rows = scanned.where("what like '%tail%' or what = 'dots'").join(openings, ["paper_id", "page"], "left")
    limit_lines = limits.select("source", F.col("length").alias("x"), F.lit(True).alias("at_limit"))
    tail_rows = tail_rows.join(F.broadcast(limit_lines), ["source", "x"], "left").select("line_uid", "source", "what", "a", "b", "x", "y", "opening", F.coalesce("at_limit", F.lit(False)))
    cut_lines = _open_lines(scanned).unionByName(without_words(_judge_lines(tail_rows, known, ends).where("reason is not null"), counts))
    cut_answers = find_truncated_answers(answers, counts).select(F.lit("parsed_questions").alias("rec_table"), "rec_id", "source", "reason")
    found = broken.unionByName(cut_lines).select(F.lit("ocr_lines").alias("rec_table"), "rec_id", "source", "reason").unionByName(cut_answers)
    return found.groupBy("rec_table", "rec_id").agg(F.max("source").alias("source"), F.min("reason").alias("reason"))


def _open_lines(scanned: DataFrame) -> DataFrame:
    """Lines that end in an escape, or in an open bracket, quote or markup, the latter with the next page looked at for its closing sign."""
    ends = scanned.where("what in ('escape', 'left_open', 'last_open')").select("paper_id", "page", "what", "line_uid", "source", "b", "y")
    openings = page_openings(scanned).select("paper_id", "page", F.col("b").alias("following"), F.col("x").alias("closes"))
    closed = reduce(lambda rest, k: rest | (F.col("b").contains(SIGNS[k]) & (F.col("closes").bitwiseAND(1 << k) > 0)), range(len(SIGNS)), F.col("b").contains("„"))
    # At the end of a paper nothing can close it.
    cut = (F.col("what") != "last_open") | F.col("following").isNull() | (~closed & (F.col("y") - F.length("following") > LEAST_SLACK))
    reason = F.when(F.col("what") == "escape", "broken").otherwise("open")
    return ends.join(openings, ["paper_id", "page"], "left").where(cut).select(F.col("line_uid").alias("rec_id"), "source", reason.alias("reason"))


def truncation_rates(found: DataFrame, lines: DataFrame, answers: DataFrame) -> DataFrame:
    """rec_table, source, n_records, n_cut, share_cut: how often each source truncates; second deliveries count once."""
    records = lines.select(F.lit("ocr_lines").alias("rec_table"), F.col("line_uid").alias("rec_id"), "source").unionByName(
        answers.select(F.lit("parsed_questions").alias("rec_table"), F.col("block_id").alias("rec_id"), "source")
    )
    total = records.groupBy("rec_table", "source").agg(F.count_distinct("rec_id").alias("n_records"))
    cut = found.groupBy("rec_table", "source").agg(F.count(F.lit(1)).alias("n_cut"))
    joined = total.join(cut, ["rec_table", "source"], "left").withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    return joined.withColumn("share_cut", F.col("n_cut") / F.col("n_records"))


def _judge_lines(tails: DataFrame, known: Broadcast, ends: Broadcast) -> DataFrame:
    def judge(rows: Iterable[tuple]) -> Iterator[tuple]:
        words, (one, two, pairs) = known.value, ends.value
        ordered = sorted(words)

        def begins_word(core: str) -> bool:
            i = bisect_right(ordered, core)
            return i < len(ordered) and ordered[i].startswith(core)

        for line, source, what, tail, following, length, slack, opening, at_limit in rows:
            if what == "dots":
                yield line, source, "open" if breaks_off(tail, words, one, two) and not ends_in_excuse(tail) and not is_refusal(tail) else None, None
                continue
            tokens = tail.split()
            last, before = tokens[-1], tokens[-2] if len(tokens) > 1 else ""
            core = bare(last)
            if what.startswith("last"):
                # The next line stands on the next page, or nowhere.
                openings = (opening or "").split("\t")
                following = openings[0]
                slack = slack - len(following) if following else MOST_SLACK
            else:
                openings = [following]
            after = bare(following)
            digital = source in DIGITAL
            verdict = None
            if last.endswith(BROKEN):
                verdict = "broken"
            elif not is_word(core) or last[-1] == ",":
                pass
            elif core not in words and begins_word(core) and core + after not in words:
                verdict = "fragment" if last[:1].islower() or digital or slack > LEAST_SLACK or at_limit else None
            elif not what.endswith("loose") and len(tokens) >= SENTENCE_WORDS and not completes(before, last, words, one, two) and not ends_in_excuse(tail):
                nexts = (NAME if x[:1].isupper() and len(x) > 1 or bare(x) not in words else bare(x) for x in openings)
                goes_on = any(f"{core} {x}" in pairs for x in nexts)
                if digital:
                    verdict = "limit" if at_limit else "open"
                elif not goes_on and after and at_limit and begins_word(core):
                    verdict = "limit"
                elif not goes_on and after and slack > LEAST_SLACK:
                    verdict = "open"
            elif digital and at_limit:
                verdict = "limit"
            yield line, source, verdict, core

    return map_rows(tails, "rec_id bigint, source string, reason string, core string", judge)


def _judge_answers(tails: DataFrame, known: Broadcast, ends: Broadcast) -> DataFrame:
    def judge(rows: Iterable[tuple]) -> Iterator[tuple]:
        words, (one, two, _) = known.value, ends.value
        for rec, source, length, state, tail, n_words, left_open in rows:
            tokens = tail.split()
            verdict = None
            if state == "broken":
                verdict = "broken"
            elif state == "dots":
                verdict = "open" if n_words >= SENTENCE_WORDS and breaks_off(tail, words, one, two) else None
            elif state == "bare" and tokens[-1][-1] in HYPHENS and n_words >= SENTENCE_WORDS:
                verdict = "fragment"
            elif state == "bare" and n_words >= SENTENCE_WORDS and not completes(tokens[-2], tokens[-1], words, one, two):
                verdict = "open" if bare(tokens[-1]) in words else "fragment"
            yield rec, source, length, state, verdict or ("open" if left_open else None), bare(tokens[-1]) if tokens and verdict == "fragment" and tokens[-1][-1] not in HYPHENS else None

    return map_rows(tails.select("rec_id", "source", "length", "state", "tail", "n_words", "left_open"), "rec_id bigint, source string, length int, state string, verdict string, core string", judge)
