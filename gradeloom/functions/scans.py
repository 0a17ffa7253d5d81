"""Scanners over text that need look-ahead and state: sentences, spans of quotes, written labels.

They run in Arrow batches; each takes one value at a time and keeps nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

import gradeloom.session  # noqa: F401  (makes the functions below travel by value)
from gradeloom.functions.labels import LABEL_WORDS, NUMBER_WORDS, label_key_of

SENTENCE = StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("exact", BooleanType())])
LABEL = StructType([StructField("label", StringType()), StructField("rest", StringType()), StructField("bracketed", BooleanType()), StructField("lead", BooleanType())])

_STOP = re.compile(r"[.!?\n]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_AFTER = frozenset(" \t\r\f\v\"')]") - {"'"}


def split_sentences(text: str | None) -> list[tuple[str, int, int]]:
    """(text, start, end) of each sentence; offsets are characters.

    A full stop between digits does not end one, nor one behind a lone letter
    with a lower-case letter to follow. Space, quotes and brackets behind the
    terminator belong to the sentence, line breaks do not. Pieces without a
    letter or digit are left out.
    """
    s = text or ""
    pieces: list[tuple[int, int]] = []
    start = 0
    for m in _STOP.finditer(s):
        i = m.start()
        if i < start:
            continue
        if m[0] == ".":
            before, after = s[i - 1 : i], s[i + 1 : i + 2]
            if before.isdecimal() and after.isdecimal():
                continue
            lone = before.isascii() and before.isalpha() and not (i > 1 and re.match(r"\w", s[i - 2]))
            if lone and re.match(r"\s*[a-z]", s[i + 1 : i + 3]):
                continue
        end = i + 1
        while end < len(s) and s[end] != "\n" and (s[end] in _AFTER or s[end].isspace()):
            end += 1
        pieces.append((start, end))
        start = end
    pieces.append((start, len(s)))
    return [(s[a:b].strip(), a, b) for a, b in pieces if _ALNUM.search(s[a:b])]


def prefix_counts(words: list[str]) -> list[int]:
    """How many words of a normalised phrase may stand for it, the most first; see functions.text.prefix_candidates."""
    floor = max(3, -(-len(words) * 2 // 5))
    return [len(words), *(n for n in range(len(words) - 1, floor - 1, -1) if len(" ".join(words[:n])) >= 10)]


def candidates(target: str) -> list[str]:
    """Plain form of functions.text.prefix_candidates."""
    words = target.split()
    return [" ".join(words[:n]) for n in prefix_counts(words)]


_ALNUMS, _GAP = re.compile("[A-Za-z0-9]+"), "[^A-Za-z0-9]+"


def find_span(text: str | None, quote: str | None, taken: Iterable[tuple[int, int]] = (), start: int = 0) -> tuple[int, int, bool] | None:
    """(start, end, exact) of a quote in a text from `start` on that overlaps no taken span, or None.

    Only the first verbatim place is tried. Then the words of the quote are
    sought with anything but letters and digits between them: where its
    shortest allowed prefix stands, the words that follow tell how much of it
    does. Most words win, then the earliest place.
    """
    hay, raw = text or "", quote or ""
    if not raw.strip():
        return None
    spans = list(taken)
    is_free = lambda a, b: not any(a < y and b > x for x, y in spans)
    first = hay.find(raw, start)
    if first >= 0 and is_free(first, first + len(raw)):
        return first, first + len(raw), True
    words = _ALNUMS.findall(raw.lower())
    if len(" ".join(words)) < 3:
        return None
    counts = prefix_counts(words)
    least = min(counts)
    flags = re.IGNORECASE | re.ASCII
    places = re.compile(f"(?=({_GAP.join(words[:least])}))", flags)
    following = [re.compile(_GAP + w, flags) for w in words[least:]]
    found: list[tuple[int, int, int]] = []
    for place in places.finditer(hay, start):
        a, b = place.span(1)
        found.append((-least, a, b))
        for n, word in enumerate(following, least + 1):
            more = word.match(hay, b)
            if not more:
                break
            b = more.end()
            found.append((-n, a, b))
    return next(((a, b, False) for n, a, b in sorted(found) if -n in counts and is_free(a, b)), None)


# The grammar of a written label. A level is a number, a Roman numeral or a letter; levels are joined by a bracket, by a
# separator before a digit or bracket, or by a space before a letter that is closed. A separator with nothing to join, or
# a closing bracket, ends the label; a bracket or separator that opens no level is read over.
_LEVEL = r"(?:\d{1,3}|[ivx]{1,6}|[a-z])(?![a-z])"
_LEADING = rf"(?:(?:{'|'.join(LABEL_WORDS)})(?![A-Za-z])\s*[.\-:)]?\s*)"
_JOIN = r"(?:\s*[)\]]\s*[(\[]\s*|\s*[.:\-]\s*(?:(?=\d)|[(\[]\s*)|\s*[(\[]\s*|\s+(?=(?:[a-z]|[ivx]{1,6})\s*[).\]]))"
_LABEL = re.compile(
    rf"""\s*(?P<lead>{_LEADING}++)?+
    (?P<body>(?:\s*[(\[]\s*)?
        (?:(?P<pair>\d{{1,3}}(?:[ivx]{{1,6}}|[a-z])(?![a-z]))|(?(lead)(?P<spelled>(?:{'|'.join(NUMBER_WORDS)})(?![a-z]))|(?!))|{_LEVEL})
        (?:{_JOIN}{_LEVEL}){{0,3}})
    (?:(?P<over>\s*[)\]]\s*[(\[]\s*|\s*[.:\-]\s*[(\[]\s*|\s*[(\[]\s*|\s*[.:\-]\s*+(?=\d))|(?P<end>\s*[)\]]\s*|\s*[.:\-]\s*))?""",
    re.IGNORECASE | re.VERBOSE,
)
_PIECES = re.compile(r"\d+|[a-z]+", re.IGNORECASE)


def read_label(line: str | None, known: frozenset[str] = frozenset()) -> tuple[str, str, bool, bool] | None:
    """(label, rest, bracketed, lead) of a line that opens with a question label, or None.

    A label has up to four levels. It needs a mark of its own: a lead word, a
    bracket or a terminator, a place among the known keys of the exam, or a
    letter level behind a number.
    """
    s = line or ""
    found = _LABEL.match(s)
    if not found:
        return None
    label, rest = s[: found.end()].strip(), s[found.end() :].strip()
    lead = found["lead"] is not None
    bracketed = any(c in "()[]" for part in ("body", "over", "end") for c in found[part] or "")
    pieces = _PIECES.findall(found["body"])
    mixed = len(pieces) > 1 and not all(p.isdecimal() or p.lower() in NUMBER_WORDS for p in pieces)
    if lead or bracketed or found["end"]:
        return label, rest, bracketed, lead
    if label_key_of(label) in known or (mixed and rest):
        return label, rest, bracketed, lead
    return None


@F.udf(returnType=ArrayType(SENTENCE), useArrow=True)
def sentences(text):
    """Column form of split_sentences."""
    return split_sentences(text)


@F.udf(returnType=SPAN, useArrow=True)
def span_of(text, quote):
    """Column form of find_span, without taken spans."""
    return find_span(text, quote)


@F.udf(returnType=LABEL, useArrow=True)
def label_of(line, known):
    """Column form of read_label; known is an array of keys or null."""
    return read_label(line, frozenset(known or ()))
