"""Scan noise in text: broken words, misread letters, running headers and page numbers, found and repaired.

Rare words meet the frequent words that they may be misread from by the
difference of their anagram hashes: the hash of a word is the sum of a value
per letter, so a confusion of letters shifts it by a constant, and the pairs
come from an equality join. What follows ranks the corrections.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from zlib import crc32

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows
from gradeloom.llm.lines import JUNK, LIST, TABLE, classify_line
from gradeloom.llm.pages import DIGITAL, HYPHENS, PAGE_NUMBER, REACH, broken_end, first_word, header_keys, join_halves, page_openings, scan_pages
from gradeloom.llm.vocabulary import CLEAN, STRIP, WORD, corpus_counts, frequent_words
from gradeloom.llm.wordlists import ALL_FUNCTION_WORDS
from gradeloom.session import checkpointed, prepare

# The letters that a digit or sign may stand for.
DIGIT_LETTERS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq", "|": "il"}
# What scanning makes of letters, as (seen, meant).
CONFUSIONS = [
    ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("a", "o"), ("o", "a"), ("f", "t"), ("t", "f"), ("n", "u"), ("u", "n"), ("i", "l"), ("l", "i"), ("v", "y"), ("y", "v"), ("q", "g"), ("g", "q"), ("l", "t"),
    ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("nn", "m"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("in", "m"), ("iii", "m"), ("é", "e"), ("e", "é"), ("ó", "o"), ("o", "ó"),
]


def letter_forms(word: str) -> list[str]:
    """word with every digit, bar and ligature read as letters, in each way up to sixteen; word alone if it has none."""
    forms = [""]
    for c in unicodedata.normalize("NFKC", word):
        options = DIGIT_LETTERS.get(c, c)
        forms = [f + o for f in forms for o in options] if len(forms) < 16 else [f + options[0] for f in forms]
    return forms


def anagram_hash(word: str) -> int:
    """The sum of a fixed value per letter: equal for anagrams, and shifted by a constant when one letter stands for another."""
    return sum(crc32(c.encode()) for c in word)


_SHIFTS = [(seen, meant, anagram_hash(meant) - anagram_hash(seen)) for seen, meant in CONFUSIONS]


def corrections(odd: DataFrame, common: DataFrame, ratio: float = 0.05, digit_ratio: float = 0.5, least_length: int = 4) -> DataFrame:
    """word, fixed: odd words that come from a common one by one confusion of letters; ties go to the more frequent, then by the word.

    odd, common: word, n. A word counts as misread if it is at most `ratio`
    times as frequent as its correction, or `digit_ratio` if a digit or bar
    stands for a letter. Function words, words shorter than least_length, which
    are near too many others, and words with a null count are never misread.
    """

    def shifted(rows: Iterable[tuple]) -> Iterator[tuple]:
        for word, n in rows:
            if len(word) < least_length or word in ALL_FUNCTION_WORDS:
                continue
            for form in letter_forms(word):
                own = anagram_hash(form)
                enough = n / (ratio if form == word else digit_ratio)
                if form != word:
                    yield own, word, form, "", "", enough
                for seen, meant, shift in _SHIFTS:
                    if seen in form:
                        yield own + shift, word, form, seen, meant, enough

    hashed = map_rows(common.select("word", "n").where(~F.col("word").rlike("[0-9|]")), "hash bigint, fixed string, n_fixed bigint", lambda rows: ((anagram_hash(w), w, n) for w, n in rows))
    near = map_rows(odd.select("word", "n").where("n is not null"), "hash bigint, word string, form string, seen string, meant string, least double", shifted)
    placed = "form = fixed or exists(sequence(1, char_length(form)), p -> substr(form, p, char_length(seen)) = seen and concat(substr(form, 1, p - 1), meant, substr(form, p + char_length(seen))) = fixed)"
    met = near.join(hashed, "hash").where((F.col("n_fixed") >= F.col("least")) & F.expr(placed))
    return met.groupBy("word").agg(F.max_by("fixed", F.struct("n_fixed", "fixed")).alias("fixed"))


def typed_words(counts: DataFrame, least: int = 2, share: float = 0.25) -> DataFrame:
    """word: words that belong to the language because typed texts hold them, too.

    They come `least` times in typed texts and make up at least `share` of what
    a word as frequent would there: in a large corpus any slip is typed now and
    then, but far more rarely than it is misread.
    """
    own = counts.where(F.col("kind").isin(WORD, CLEAN))
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    sums = own.agg(n(WORD).alias("all"), n(CLEAN).alias("typed")).first()
    typed_share = (sums["typed"] or 0) / (sums["all"] or 1)
    words = own.groupBy("word").agg(n(WORD).alias("all"), n(CLEAN).alias("typed"))
    return words.where((F.col("typed") >= least) & (F.col("typed") >= share * typed_share * F.col("all"))).select("word")


def known_words(counts: DataFrame, least: int = 5) -> tuple[dict[str, int], DataFrame]:
    """The frequent words that are no misreading of another one, bounded as frequent_words is; and all words that come `least` times and are none, as a table of word, n."""
    counted = counts.where((F.col("kind") == WORD) & (F.col("n") >= least)).select("word", "n")
    bad = checkpointed(corrections(counted.join(typed_words(counts), "word", "left_anti"), counted).select("word"))
    frequent = frequent_words(counts, least=least)
    # Of the misread words only those that are frequent come to the driver.
    misread = {r["word"] for r in counts.sparkSession.createDataFrame([(w,) for w in frequent], "word string").join(bad, "word").collect()}
    return {w: n for w, n in frequent.items() if w not in misread}, counted.join(bad, "word", "left_anti")


def scan_answers(answers: DataFrame, known: Broadcast) -> DataFrame:
    """The noise findings of texts made of lines: what, rec_id, at (line ordinal), a; `what` as in pages.scan_pages."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        words = known.value
        for block, text in rows:
            lines = (text or "").split("\n")
            body = []
            for i, line in enumerate(lines):
                if len(lines) > 1 and PAGE_NUMBER.match(line):
                    yield "page_number", block, i, None
                else:
                    body.append(i)
            for i in body:
                keys = header_keys(lines[i]) if lines[i][:1].isupper() and len(lines) > 1 else []
                if keys:
                    yield "head_line", block, i, "\t".join(keys)
            broken = [broken_end(lines[i]) for i in body]
            for p, i in enumerate(body):
                tokens = lines[i].split()
                if broken[p]:
                    tokens.pop()
                if tokens and p and broken[p - 1]:
                    tokens.pop(0)
                for token in tokens:
                    w = token.strip(STRIP).lower()
                    if w not in words and 1 < len(w) <= 40:
                        yield "rare", block, i, w
                half = broken[p]
                if half:
                    seconds = [first_word(lines[j]) for j in body[p + 1 : p + 1 + REACH]]
                    whole = join_halves(half, seconds[:1], words)
                    if whole not in words:
                        whole = join_halves(half, seconds, words) or whole
                    if whole:
                        yield "hyphen", block, i, whole

    narrow = answers.select(F.col("block_id").cast("bigint"), F.col("answer_text").cast("string"))
    return map_rows(narrow, "what string, rec_id bigint, at int, a string", run)


def header_templates(scanned: DataFrame, least: int = 3, share: float = 0.9) -> DataFrame:
    """key: folded line templates that come at page edges at least `least` times, and nearly only there."""
    summed = scanned.where("what = 'head_key'").groupBy(F.col("a").alias("key")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return summed.where((F.col("x") >= least) & (F.col("x") >= share * (F.col("x") + F.col("y")))).select("key")


def running_headers(scanned: DataFrame, a_paper: float = 1.3) -> tuple[DataFrame, DataFrame]:
    """(lines, keys): the running headers among the edge lines of pages (line_uid, paper_id, page), and their templates.

    A template must also return within papers, `a_paper` times in each that has
    it, on average: in a large corpus any line opens three pages, but not two of
    the same paper.
    """
    hits = checkpointed(_head_keys(scanned, "line_uid", "paper_id", "page").join(header_templates(scanned), "key", "left_semi"))
    sums = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("n_papers"))
    keys = checkpointed(sums.where(F.col("n") >= a_paper * F.col("n_papers")).select("key"))
    return hits.join(keys, "key", "left_semi").select("line_uid", "paper_id", "page").distinct(), keys


def _head_keys(rows: DataFrame, *ids: str) -> DataFrame:
    return rows.where("what = 'head_line'").select(*ids, F.explode(F.split("a", "\t")).alias("key"))


def over_pages(scanned: DataFrame, known: Broadcast) -> DataFrame:
    """line_uid, paper_id, page, next_page, fixed, sure: words broken over the end of a page, joined to the first lines of the paper's next page of running text."""
    halves = scanned.where("what = 'half'").select("paper_id", "page", "line_uid", F.col("a").alias("half"), F.col("x").alias("within"))
    openings = page_openings(scanned).select("paper_id", "page", "next_page", F.col("a").alias("opening"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        words = known.value
        for paper, page, line, half, within, following, opening in rows:
            seconds = opening.split("\t")
            first = join_halves(half, seconds[:1], words)
            whole = first if first in words else join_halves(half, seconds, words)
            if whole and (whole in words or not within):
                yield line, paper, page, following, whole, whole in words

    met = halves.join(openings, ["paper_id", "page"]).select("paper_id", "page", "line_uid", "half", "within", "next_page", "opening")
    return map_rows(met, "line_uid bigint, paper_id bigint, page int, next_page int, fixed string, sure boolean", run)


def noise_details(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """rec_table, rec_id, at, paper_id, page, noise, word, fixed: every noise with its place.

    `at` is the ordinal of the line in an answer, paper_id and page are those of
    a page line; `word` is the misread word as it stands, bare. A noise `rest`
    without a record names the page that opens with the rest of a word broken
    over the page before, `listed` one that may be set as entries. See find_noise for what else holds.
    """
    spark: SparkSession = prepare(lines.sparkSession)
    counts = checkpointed(corpus_counts(lines.select("text", F.coalesce(F.col("source").isin(*DIGITAL), F.lit(False)))))
    frequent, common = known_words(counts)
    known = spark.sparkContext.broadcast(frequent)
    scanned = checkpointed(scan_pages(lines, known, noise=True, cuts=False))
    written = checkpointed(scan_answers(answers, known))
    line_heads, head_keys = running_headers(scanned)
    rare = scanned.where("what = 'rare'").select("a").union(written.where("what = 'rare'").select("a")).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    # Corrections come from all words, not from the frequent ones alone: an equality join, whatever their number.
    fixes = checkpointed(corrections(rare.join(typed_words(counts), "word", "left_anti"), common))

    def misread(rows: DataFrame, heads: DataFrame, *ids: str) -> DataFrame:
        return rows.where("what = 'rare'").select(*ids, F.col("a").alias("word")).join(heads, list(ids)[:1] if ids[0] == "line_uid" else list(ids), "left_anti").join(fixes, "word")

    place = ("line_uid", "paper_id", "page")
    answer_heads = _head_keys(written, "rec_id", "at").join(head_keys, "key", "left_semi").select("rec_id", "at").distinct()
    across = checkpointed(over_pages(scanned, known))
    within = scanned.where("what = 'hyphen'").select(*place, F.col("a").alias("fixed"))
    # A half at the foot of a page may meet a wrong line on it: the next page wins if it gives a known word.
    hyphens = within.join(across.where("sure").select("line_uid"), "line_uid", "left_anti").union(across.select(*place, "fixed")).join(line_heads, "line_uid", "left_anti")

    def row(df: DataFrame, table: str, noise: str) -> DataFrame:
        on_page = table == "ocr_lines"
        at = F.lit(None).cast("int") if on_page else F.col("at")
        word = F.col("word") if noise == "misread" else F.lit(None).cast("string")
        fixed = F.col("fixed") if noise in ("hyphen", "misread", "rest") else F.lit("")
        where = [F.col(c) if on_page else F.lit(None).cast(t).alias(c) for c, t in (("paper_id", "bigint"), ("page", "int"))]
        return df.select(F.lit(table).alias("rec_table"), F.col("line_uid" if on_page else "rec_id").cast("bigint").alias("rec_id"), at.alias("at"), *where, F.lit(noise).alias("noise"), word.alias("word"), fixed.alias("fixed"))

    found = [
        row(hyphens, "ocr_lines", "hyphen"),
        row(misread(scanned, line_heads, *place), "ocr_lines", "misread"),
        row(line_heads, "ocr_lines", "header"),
        row(scanned.where("what = 'page_number'"), "ocr_lines", "page_number"),
        row(across.select(F.lit(None).alias("line_uid"), "paper_id", F.col("next_page").alias("page"), "fixed"), "ocr_lines", "rest"),
        row(scanned.where("what = 'listed'"), "ocr_lines", "listed"),
        row(written.where("what = 'hyphen'").withColumn("fixed", F.col("a")), "parsed_questions", "hyphen"),
        row(misread(written, answer_heads, "rec_id", "at"), "parsed_questions", "misread"),
        row(answer_heads, "parsed_questions", "header"),
        row(written.where("what = 'page_number'"), "parsed_questions", "page_number"),
    ]
    return reduce(DataFrame.unionByName, found)


def find_noise(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """rec_table, rec_id, noise, fixed: every noise of every line and answer, once.

    lines: line_uid, paper_id, page, line_index, source, text. answers:
    block_id, answer_text. `fixed` is the repaired word of a hyphen or
    misread, empty for a header or page_number. Null and empty texts have no
    noise; repeated rows and second deliveries count once; other columns are
    ignored. Pages of lists, tables and junk report headers and page numbers
    alone.
    """
    return noise_details(lines, answers).where("noise not in ('rest', 'listed')").select("rec_table", "rec_id", "noise", "fixed").distinct()


def in_case(fixed: str, seen: str) -> str:
    """fixed in the case that seen has."""
    return fixed.upper() if seen.isupper() and len(seen) > 1 else fixed[:1].upper() + fixed[1:] if seen[:1].isupper() else fixed


def set_right(line: str, fixes: dict[str, str]) -> str:
    """A line with its misread words exchanged, punctuation and case kept."""
    if not fixes:
        return line

    def right(m: re.Match) -> str:
        core = m[0].strip(STRIP)
        fixed = fixes.get(core.lower()) if core else None
        return m[0] if fixed is None else m[0].replace(core, in_case(fixed, core))

    return re.sub(r"\S+", right, line)


def join_lines(lines: list[tuple[str, bool, str | None, dict[str, str]]], may_list: bool = True) -> str:
    """Paragraphs from (text, furniture, whole word broken at its end, corrections) of lines in order.

    Furniture is left out. A broken word is set whole on the line of its first
    half, and its second half goes. Lines run on with a space; a paragraph ends
    behind a line that ends a sentence and is clearly shorter than the longest.
    Where most lines are entries, these stay apart; without may_list it is known
    that they are not, and no line is classed again.
    """
    body = [(set_right(t.strip(), fixes), whole) for t, furniture, whole, fixes in lines if not furniture and t and t.strip()]
    width = max((len(t) for t, _ in body), default=0)
    # Short lines of running text look like entries: only where these prevail are they any.
    entries = [classify_line(t) in (LIST, TABLE, JUNK) for t, _ in body] if may_list else [False] * len(body)
    listed = sum(entries) * 5 > len(entries) * 3 and len(entries) > 3
    out: list[str] = []
    owed = False
    paragraph = True
    apart = False
    for (text, whole), entry in zip(body, entries):
        entry = entry and listed
        parts = text.split()
        if owed and parts:
            # What follows the second half's letters, such as a full stop, stays.
            tail = re.match(r"^[\w'’-]*(.*)$", parts[0])
            out[-1] += tail[1] if tail else ""
            parts = parts[1:]
        owed = whole is not None
        if owed and parts:
            lead = re.match(r"^\W*", parts[-1])[0]
            parts[-1] = lead + in_case(whole, parts[-1].strip(STRIP))
        line = " ".join(parts)
        if line:
            if out and not paragraph:
                out[-1] += ("\n" if entry and apart else " ") + line
            else:
                out.append(line)
            apart = entry
            paragraph = not owed and not entry and text[-1:] in ".!?।" and len(text) * 5 < width * 4
    return "\n\n".join(out)


def repair_lines(lines: DataFrame, details: DataFrame) -> DataFrame:
    """paper_id, page, text: each page as readable paragraphs, without furniture, with whole and corrected words.

    details: see noise_details. The lines of a page come together in one row; a
    word broken over pages stands whole on the first, and its rest is dropped
    from the second where it opens that page. Lines without a paper or page are
    left out, pages without a word are empty.
    """
    prepare(lines.sparkSession)
    found = details.where("rec_table = 'ocr_lines'").groupBy("paper_id", "page").agg(F.collect_set(F.struct("rec_id", "noise", "word", "fixed")).alias("found"))
    # The text is shuffled once, by page; equal rows of a line fall together in the set.
    keys = F.col("paper_id").cast("bigint").alias("paper_id"), F.col("page").cast("int").alias("page")
    own = lines.where("paper_id is not null and page is not null").select(*keys, "line_index", F.col("line_uid").cast("bigint").alias("line_uid"), "text")
    pages = own.groupBy("paper_id", "page").agg(F.array_sort(F.collect_set(F.struct("line_index", "line_uid", "text"))).alias("rows"))

    def repair(rows: Iterable[tuple]) -> Iterator[tuple]:
        for paper, page, own_rows, own_found in rows:
            of_line: dict[int, list] = {}
            for f in own_found or ():
                of_line.setdefault(f["rec_id"], []).append(f)
            given = [_marked(r["text"] or "", of_line.get(r["line_uid"], ())) for r in own_rows]
            first = next((i for i, g in enumerate(given) if not g[1] and g[0].strip()), None)
            rest = next((f["fixed"] for f in of_line.get(None, ()) if f["noise"] == "rest"), None)
            if rest and first is not None:
                opening = given[first][0].split(None, 1)
                if rest.endswith(opening[0].strip(STRIP).lower()):
                    given[first] = (opening[1] if len(opening) > 1 else "", *given[first][1:])
            yield paper, page, join_lines(given, any(f["noise"] == "listed" for f in of_line.get(None, ())))

    return map_rows(pages.join(found, ["paper_id", "page"], "left").select("paper_id", "page", "rows", "found"), "paper_id bigint, page int, text string", repair)


def _marked(text: str, found: Iterable[dict]) -> tuple[str, bool, str | None, dict[str, str]]:
    """A line as join_lines takes it, from the noises found in it."""
    whole = max((f["fixed"] for f in found if f["noise"] == "hyphen"), default=None)
    return text, any(f["noise"] in ("header", "page_number") for f in found), whole, {f["word"]: f["fixed"] for f in found if f["noise"] == "misread"}


def repair_answers(answers: DataFrame, details: DataFrame) -> DataFrame:
    """block_id, text: each answer as readable paragraphs; null answers stay null. See repair_lines."""
    prepare(answers.sparkSession)
    own = details.where("rec_table = 'parsed_questions'").groupBy(F.col("rec_id").alias("block_id")).agg(F.collect_set(F.struct("at", "noise", "word", "fixed")).alias("found"))
    once = answers.select("block_id", "answer_text").distinct().join(own, "block_id", "left")

    def repair(rows: Iterable[tuple]) -> Iterator[tuple]:
        for block, text, found in rows:
            if text is None:
                yield block, None
                continue
            places: dict[int, list] = {}
            for f in found or ():
                places.setdefault(f["at"], []).append(f)
            given = [_marked(line, places.get(i, ())) for i, line in enumerate(text.split("\n"))]
            yield block, join_lines(given)

    return map_rows(once.select(F.col("block_id").cast("bigint"), "answer_text", "found"), "block_id bigint, text string", repair)
