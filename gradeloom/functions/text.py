"""Text primitives as column expressions: normalised form, content tokens, similarity, hashes, prefixes.

All of them run inside the JVM. Classes of characters are ASCII, as the label
and retrieval rules count only those as letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to carry a signal for retrieval.
STOPWORDS = (
    "a an the and or but if then than that this these those of in on at to for from by with without is are was were be been being it its as such into over under about above below"
    " can could should would will shall may might must do does did done have has had not no nor so very also which who whom whose what when where why how there here their they them"
    " he she his her you your we our i"
).split()

#: White space of any kind, as a pattern for Java.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else as single spaces. Null gives an empty text.

    Other signs go before the case is changed, so that letters which only
    become ASCII in lower case stay out.
    """
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")))


def stem(word: Column) -> Column:
    """A careful suffix trim; the first rule that fits counts."""
    n = F.char_length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & word.endswith("sses"), cut(2))
        .when((n > 3) & word.endswith("es") & ~word.rlike("[aeiou]es$"), cut(2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .when((n > 5) & word.endswith("ing"), cut(3))
        .when((n > 5) & word.endswith("ed"), cut(2))
        .otherwise(word)
    )


def tokenize(text: Column, keep_stopwords: bool = False) -> Column:
    """The stems of a text's words in order, with repetitions; stopwords go first, then single letters."""
    words = F.split(normalize_text(text), " ")
    kept = F.filter(words, lambda w: (F.char_length(w) >= 2) & (F.lit(True) if keep_stopwords else ~w.isin(STOPWORDS)))
    return F.transform(kept, stem)


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct stems of two texts; 0 if either has none."""
    left, right = F.array_distinct(tokenize(a)), F.array_distinct(tokenize(b))
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / (F.size(left) + F.size(right) - shared))


def djb2(text: Column) -> Column:
    """The djb2 hash of a text, modulo 2^32, as a bigint; a character beyond U+FFFF counts as its two surrogates."""
    letters = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    step = lambda h, unit: F.pmod(h * 33 + unit, F.lit(4294967296))
    wide = lambda h, code: step(step(h, 0xD800 + F.floor((code - 0x10000) / 0x400)), 0xDC00 + F.pmod(code - 0x10000, F.lit(0x400)))
    return F.aggregate(letters, F.lit(5381).cast("bigint"), lambda h, c: F.when(F.ascii(c) > 0xFFFF, wide(h, F.ascii(c))).otherwise(step(h, F.ascii(c))))


def hash_string(text: Column) -> Column:
    """djb2 in base 36, lower case."""
    return F.lower(F.conv(djb2(text).cast("string"), 10, 36))


def word_count(text: Column) -> Column:
    """Words of a text as white space parts it; 0 for null and blank texts."""
    inner = trimmed(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, rf"{SPACE}+")))


def prefix_candidates(needle: Column) -> Column:
    """A normalised phrase and its word prefixes, longest first: down to two fifths of the words and three at least, each of ten letters or more."""
    words = F.split(needle, " ")
    n = F.size(words)
    floor = F.greatest(F.lit(3), F.ceil(n * F.lit(0.4)).cast("int"))
    counts = F.when(n - 1 >= floor, F.sequence(n - 1, floor, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    shorter = F.filter(F.transform(counts, lambda k: F.array_join(F.slice(words, F.lit(1), k), " ")), lambda p: F.char_length(p) >= 10)
    return F.concat(F.array(needle), shorter)
