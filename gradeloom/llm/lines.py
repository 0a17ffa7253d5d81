"""Line classes: what a single line of page text looks like, judged from the line alone.

The classes are additive: a page's kind follows from the summed characters of
its lines by class, so no page has to be gathered into one task.
"""

from __future__ import annotations

import re

from gradeloom.llm.wordlists import ALL_FUNCTION_WORDS, NOMINAL_WORDS

PROSE, LIST, TABLE, JUNK, FURNITURE, BLANK = range(6)

CLAUSE_WORDS = ALL_FUNCTION_WORDS - NOMINAL_WORDS
_REVERSED = frozenset(w[::-1] for w in ALL_FUNCTION_WORDS if len(w) >= 3) - ALL_FUNCTION_WORDS

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_DEVANAGARI = re.compile("[ऀ-ॿ]+")
PAGE_NUMBER = re.compile(
    r"^[\W_]*(?:(?:p\s?a\s?g\s?e|pg|seite|p[áa]gina)\W*)?(?:\d{1,4}|[ivxl1]{1,6})(?:\s*(?:/|of|de|von|sur)\s*[\dl]{1,4})?[\W_]*$",
    re.IGNORECASE,
)
_NUMBER_CELL = re.compile(r"^[\W_]*(?:\d[\d.,]*\s*(?:%|°?[a-zA-Z]{1,2}|units)?|nil|n\.a\.|n/a|-)[\W_]*$")
_CELLS = re.compile(r"\t|\s{2,}|[|;/]|,\s|:\s")
_BULLET = re.compile(r"^\s*(?:[•*·▪–—-]|\[\s?[xX]?\s?\]|\(?\w{1,3}[.)])\s+")
_LEADER = re.compile(r"\.{4,}\s*(?:p\.?\s*)?\d+\s*$")
_RULE = re.compile(r"[\s|:+=-]+")
_MARKER = re.compile(r"\[(?:illegible|unclear|unreadable)\]|\?\?|xxx+|___")
_RUN = re.compile(r"([^.\s_-])\1{5,}")
_DIGIT = re.compile(r"\d")
_MIXED = re.compile(r"[A-Za-z]\d|\d[A-Za-z]")
_VOWEL = re.compile("[aeiouyäöüáéíóúèêàâîôûœऀ-ॿ]")
_SEGMENT = re.compile(r"[,;|/\t]|\s{2,}|\.{3,}|:\s")

# Words of one letter are told apart before words of grammar.
_is_grammar = frozenset(w for w in ALL_FUNCTION_WORDS if len(w) > 1).__contains__
_is_clause_word = frozenset(w for w in CLAUSE_WORDS if len(w) > 1).__contains__


def _cells(body: str) -> list[str]:
    return [c for c in map(str.strip, _CELLS.split(body)) if c]


def _has_marker(s: str) -> bool:
    # Most lines have none of what every marker holds.
    return ("[" in s or "?" in s or "x" in s or "_" in s) and bool(_MARKER.search(s))


def words_of(text: str) -> list[str]:
    """Lower-cased words of a line; Devanagari words are split at white space and danda."""
    if not text.isascii() and _DEVANAGARI.search(text):
        return [w for w in re.split(r"[\s।,.!?;:()]+", text.lower()) if w]
    return _WORD.findall(text.lower())


def classify_line(text: str | None) -> int:
    """The class of one line. Null, empty and white-space lines are BLANK."""
    s = (text or "").strip()
    if not s:
        return BLANK
    if s[0] == "." and s[1:2].isalpha():
        return JUNK
    ws = words_of(s)
    n = len(ws)
    single = [*map(len, ws)].count(1)
    fw, clause = sum(map(_is_grammar, ws)), sum(map(_is_clause_word, ws))
    # The common case first: a running line has several words, one of them a clause word.
    if n >= 4 and clause and fw >= 2 and fw * 6 >= n and single * 2 < n and not _has_marker(s):
        return PROSE
    if PAGE_NUMBER.match(s):
        return FURNITURE
    body = _BULLET.sub("", s, count=1)
    # Most lines have none of the signs that a rule looks for: these are asked for first.
    digit = bool(_DIGIT.search(s))
    cells: list[str] = []
    numeric = 0
    if digit or "-" in s or "n" in s or "N" in s:
        cells = _cells(body)
        numeric = sum(1 for c in cells if _NUMBER_CELL.match(c))
        if len(cells) >= 2 and numeric and numeric >= len(cells) - 1 - (len(cells) > 4) and not (n >= 4 and len(cells) == 2):
            return TABLE
    if "-" in s and ("|" in s or "+" in s) and _RULE.fullmatch(s):
        return TABLE
    if "...." in s and _LEADER.search(s):
        return LIST
    real = n - single
    if fw < 3 and real < 6 and _has_marker(s):
        return JUNK
    if n < 4:
        dense = s.replace(" ", "")
        if sum(c.isalpha() or "ऀ" <= c <= "ॿ" for c in dense) < 0.55 * len(dense) or _RUN.search(s):
            return JUNK
    rev = sum(map(_REVERSED.__contains__, ws))
    if rev >= 2 and rev > clause:
        return JUNK
    parts = s.split()
    if digit and sum(1 for w in parts if len(w) > 5 and _MIXED.search(w)) * 2 >= len(parts):
        return JUNK
    if n >= 4 and real * 2 <= n and fw * 2 <= n:
        return JUNK
    long = [w for w in ws if len(w) > 3]
    if long and len(list(filter(_VOWEL.search, long))) * 2 <= len(long):
        return JUNK
    if clause and n >= 3 and real * 2 > n:
        return PROSE
    segments = [x.split() for x in _SEGMENT.split(body)]
    longest = max(map(len, segments), default=0)
    if longest >= 5:
        if fw * 10 < n and not s[0].isupper() and n >= 6:
            return JUNK
        return PROSE if body == s or clause else LIST
    if body == s and len(segments) == 1 and n >= 3 and len(s) >= 28 and fw and not all(p[:1].isupper() for p in parts if p.isalpha()):
        return PROSE
    if body == s and n >= 3 and all(p[:1].isupper() or not p[:1].isalpha() or len(p) < 3 for p in parts):
        cells = cells or _cells(body)
        if len(cells) <= 3 and numeric != len(cells):
            return FURNITURE
    return LIST
