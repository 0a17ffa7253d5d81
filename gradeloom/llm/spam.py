"""Pages stuffed with keywords, links or product tags: repeated substrings without clauses.

Each page is judged on its own where it is read, so nothing is shuffled. Words
are folded first, so that spelled-out, hyphenated and digit-for-letter variants
of a keyword meet. The suffix automaton of the words outside clauses gives the
maximal substrings that repeat; their characters, and those of links and tags,
are set against all of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows
from gradeloom.llm.automaton import SuffixAutomaton, covered
from gradeloom.llm.lines import CLAUSE_WORDS
from gradeloom.llm.wordlists import ALL_FUNCTION_WORDS

_WRAPPED = re.compile(r"(?<=[^\s.!?।:;|])\n(?=[^\W\d_A-Z])")
_SENTENCE = re.compile(r"(?<=[^\d\s][.!?।])\s+")
_LINK = re.compile(r"<a\s[^>]*>|</a>|\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?:/\S*)?|\(click here\)", re.IGNORECASE)
# Every link has one of these; most pages have none.
_LINK_SIGN = re.compile(r"\.[a-z]{2}|</?a|\]\(|://|www\.|\(click", re.IGNORECASE)
_TAG = re.compile(r"#[\wऀ-ॣ]+|\b(?:tags?|labels?|etiquetas?|étiquettes?|schlagwort)\s*:", re.IGNORECASE)
_ENUMERATED = re.compile(r"^\s*(?:\(?(?:\d{1,3}|[a-zA-Z])[.):]\s|[A-Z]\w+\s\d{1,3}\s*:)")
_NUMBER_ROW = re.compile(r"^[^\t|;]*(?:[\t|;]\s*[\d.,%-]+\s*){2,}$")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ -]){3,}[^\W\d_](?![^\W_]|[ऀ-ः\u093a-\u094f])")
_LEET = str.maketrans("013457@$", "oieastas")
_RANK = re.compile(r"\bno\.\s*\d+", re.IGNORECASE)
# Devanagari words are taken with their marks, which are no letters to Python.
_TOKEN = re.compile(r"(?:[^\W_]|[ऀ-ॣ])+")
# The same for texts without them, faster.
_PLAIN_TOKEN = re.compile(r"[^\W_]+")
_DEVANAGARI = re.compile("[ऀ-ॿ]")
# Every word spelled out has one of these, and every rank one of those.
_SPELLED_SIGN = re.compile(r"[ -][^\W\d_][ -][^\W\d_][ -]")
_RANK_SIGNS = ("no.", "No.", "NO.", "nO.")

#: Numbered lines that a page needs before what they share tells anything.
LEAST_LINES = 6


def is_clause(words: list[str], sentence: bool = False) -> bool:
    """True if the words of a unit read as a clause.

    It needs enough grammar, with a word of the clause or the form of a
    sentence (seven words, a capital first, a terminator last), and content
    words that hardly repeat within it.
    """
    grammar = sum(map(ALL_FUNCTION_WORDS.__contains__, words))
    if len(words) < 4 or grammar < 2 or grammar * 6 < len(words) or not ((sentence and len(words) > 6) or any(map(CLAUSE_WORDS.__contains__, words))):
        return False
    content = [w for w in words if w not in ALL_FUNCTION_WORDS]
    return len(content) < 3 or len(set(content)) * 3 >= len(content) * 2


def fold_word(word: str) -> str:
    """A keyword's common form: digits set for letters undone, a plural s dropped."""
    if not word.isdigit() and not word.isalpha():
        word = word.translate(_LEET)
    return word[:-1] if len(word) > 3 and word[-1] == "s" else word


def _solid(text: str) -> int:
    return len("".join(text.split()))


def _cut(pattern: re.Pattern, text: str) -> tuple[str, int]:
    """The text with a space for each match, and the characters of the matches."""
    found: list[str] = []

    def keep(match: re.Match) -> str:
        found.append(match[0])
        return " "

    return pattern.sub(keep, text), _solid(" ".join(found))


def keyword_lines(listed: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """Of the numbered lines and rows of a page, given with their words, those that are keywords and not a list.

    A question, an entry or a row of figures names a thing once. Keywords
    return: within a line, or as the same two words of content in more than
    two thirds of LEAST_LINES lines or more. Clauses are never keywords.
    """
    pairs: Counter = Counter()
    loose = [(line, words) for line, words in listed if not is_clause(words)]
    repeating = []
    for line, words in loose:
        content = [fold_word(w) for w in words if len(w) > 2 and w not in ALL_FUNCTION_WORDS and not w.isdigit()]
        pairs.update(set(zip(content, content[1:])))
        if content and len(set(content)) * 4 <= len(content) * 3:
            repeating.append((line, words))
    most = max(pairs.values(), default=0)
    return loose if len(loose) >= LEAST_LINES and most * 3 > len(listed) * 2 else repeating


def spam_measures(text: str | None, most: float = 0.0) -> tuple[int, int, int, int]:
    """Characters of a text, white space apart: all, in links and tags, outside clauses, and of these in repeated substrings.

    The last is taken over words and carried over to the signs and numbers
    between them. Null and empty texts measure 0. The whole text is read,
    however long. Where links, tags and all outside clauses make up no more than
    the share `most`, repeats can't change that and are given as 0.
    """
    if not text:
        return 0, 0, 0, 0
    rest, marked = _cut(_LINK, text) if _LINK_SIGN.search(text) else (text, 0)
    if "#" in rest or ":" in rest:
        rest, tags = _cut(_TAG, rest)
        marked += tags
    total = _solid(rest) + marked
    if any(sign in rest for sign in _RANK_SIGNS):
        rest = _RANK.sub(" ", rest)
    if _SPELLED_SIGN.search(rest):
        rest = _SPELLED.sub(lambda m: m[0].replace(" ", "").replace("-", ""), rest)
    words_in = (_TOKEN if not rest.isascii() and _DEVANAGARI.search(rest) else _PLAIN_TOKEN).findall
    units: list[tuple[str, list[str]]] = []
    listed: list[tuple[str, list[str]]] = []
    for line in _WRAPPED.sub(" ", rest).split("\n"):
        if _ENUMERATED.match(line) or _NUMBER_ROW.match(line.strip()) or ("(a)" in line and "(b)" in line):
            listed.append((line, words_in(line.lower())))
            continue
        for unit in _SENTENCE.split(line):
            words = words_in(unit.lower())
            if words and not is_clause(words, unit[:1].isupper() and unit.rstrip()[-1:] in ".!?।"):
                units.append((unit, words))
    units += keyword_lines(listed)
    sequence: list[str] = []
    sizes: list[int] = []
    loose = 0
    for unit, words in units:
        loose += _solid(unit)
        for word in words:
            if not word.isdigit():
                sequence.append(fold_word(word))
                sizes.append(len(word))
    if marked + loose <= most * total:
        return total, marked, loose, 0
    automaton = SuffixAutomaton(sequence)
    suffixes = automaton.repeated_suffixes(sequence)
    # A single short word that returns says nothing; a phrase or a longer word does.
    suffixes = [n if n > 1 or len(w) > 2 else 0 for n, w in zip(suffixes, sequence)]
    hit = sum(n for n, in_repeat in zip(sizes, covered(suffixes)) if in_repeat)
    return total, marked, loose, loose * hit // sum(sizes) if hit else 0


def spam_share(measures: tuple[int, int, int, int], least: float) -> float:
    """The share of links, tags and keywords in a page's characters.

    What stands outside clauses counts as keywords if at least the share
    `least` of it lies in repeated substrings: names that vary between the
    repetitions, as in lists of one keyword with many towns, belong to it.
    """
    total, marked, loose, repeated = measures
    return (marked + (loose if loose and repeated >= least * loose else 0)) / total if total else 0.0


def spam_pages(documents: DataFrame, most: float = 0.5, least: float = 0.25) -> DataFrame:
    """doc_id and measures of each document in which keywords, links or tags make up more than `most` of the characters.

    documents: doc_id, text; other columns are ignored. Null and empty texts
    are no cases; a repeated row stays repeated. Every document is measured.
    """

    def measure(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, text in rows:
            measures = spam_measures(text, most)
            share = spam_share(measures, least)
            if share > most:
                yield doc, *measures, share

    schema = "doc_id bigint, characters bigint, marked bigint, loose bigint, repeated bigint, spam_share double"
    return map_rows(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), schema, measure)
