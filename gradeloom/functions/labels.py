"""Question labels in one key space: parts, key and display form of however a label is written.

The column forms serve tables; the plain forms serve the scanners, and the two
agree on every label.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import trimmed

# Spelled-out numbers.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
}
# Roman numerals from one to twenty.
ROMAN = {r: i + 1 for i, r in enumerate("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split())}
# Words that stand before a label, as patterns; the first list also when a label is taken apart.
LEAD_PATTERNS = ["q(?:ue?s(?:tion)?)?", "ans(?:wer)?", "sol(?:ution)?", "part", "sec(?:tion)?"]
LABEL_WORDS = [*LEAD_PATTERNS, "n(?:o|um(?:ber)?)?", "to"]

#: Lead words at the front, however many; a keyword must not run on into a longer word.
LEADS = rf"^(?:(?:{'|'.join(LEAD_PATTERNS)})(?![a-z])[\s.\-:)]*)+"
_LEADS = re.compile(LEADS)
_LEVEL = re.compile(rf"\d+|{'|'.join(ROMAN)}|[a-z]")


def label_parts_of(raw: str | None) -> list[str]:
    """The levels of a label: numbers, Roman numerals and single letters, in order."""
    text = _LEADS.sub("", (raw or "").strip().lower())
    text = re.sub(r"\b[a-z]+\b", lambda m: str(NUMBER_WORDS.get(m[0], m[0])), text, flags=re.ASCII)
    flat: list[str] = []
    for run in re.findall("[a-z0-9]+", text):
        pair = re.fullmatch(r"(\d+)([a-z]+)", run)
        flat += pair.groups() if pair else [run]
    return [p for p in flat if _LEVEL.fullmatch(p)]


def label_key_of(raw: str | None) -> str:
    """The key of a label: its parts, numbers without leading zeros, Roman numerals as r and their value."""
    return ".".join(str(int(p)) if p.isdecimal() else f"r{ROMAN[p]}" if p in ROMAN else p for p in label_parts_of(raw))


def label_parts(raw: Column) -> Column:
    """Column form of label_parts_of."""
    text = F.regexp_replace(F.lower(trimmed(F.coalesce(raw, F.lit("")))), LEADS, "")
    # A word is spelled out only as a whole: split where words end, exchange, and join again.
    numbers = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], str(pair[1]))))
    runs = F.filter(F.split(F.regexp_replace(text, r"(?<![a-z0-9_])([a-z]+)(?![a-z0-9_])", " $1 "), "[^a-z0-9]+"), lambda w: w != "")
    spelled = F.transform(runs, lambda w: F.coalesce(F.try_element_at(numbers, w), w))
    apart = F.flatten(F.transform(spelled, lambda w: F.when(w.rlike(r"^\d+[a-z]+$"), F.array(F.regexp_extract(w, r"^\d+", 0), F.regexp_extract(w, "[a-z]+$", 0))).otherwise(F.array(w))))
    return F.filter(apart, lambda p: p.rlike(r"^\d+$") | p.isin(list(ROMAN)) | p.rlike("^[a-z]$"))


def _number(part: Column) -> Column:
    return F.regexp_replace(part, "^0+(?=.)", "")


def _roman_value(part: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair)), part)


def label_key(raw: Column) -> Column:
    """Column form of label_key_of."""
    key = lambda p: F.when(p.rlike(r"^\d+$"), _number(p)).when(p.isin(list(ROMAN)), F.concat(F.lit("r"), _roman_value(p).cast("string"))).otherwise(p)
    return F.array_join(F.transform(label_parts(raw), key), ".")


def canonical_label(raw: Column) -> Column:
    """The display form of a label: 3, 3(a), 3(a)(ii); empty without a level."""
    shown = F.transform(label_parts(raw), lambda p: F.when(p.rlike(r"^\d+$"), _number(p)).otherwise(p))
    rest = F.transform(F.slice(shown, F.lit(2), F.greatest(F.size(shown), F.lit(1))), lambda p: F.concat(F.lit("("), p, F.lit(")")))
    return F.when(F.size(shown) == 0, F.lit("")).otherwise(F.concat(F.try_element_at(shown, F.lit(1)), F.array_join(rest, "")))


def same_part(a: Column, b: Column) -> Column:
    """True if two levels name the same: equal, or numbers of equal value, Roman or not. A letter equals no number."""
    value = lambda p: F.coalesce(_roman_value(p), F.when(p.rlike(r"^\d+$"), p.try_cast("int")))
    return (a == b) | F.coalesce(value(a) == value(b), F.lit(False))


def same_part_of(a: str, b: str) -> bool:
    """Plain form of same_part."""
    value = lambda p: ROMAN.get(p) or (int(p) if p.isdecimal() else None)
    return a == b or (value(a) is not None and value(a) == value(b))
