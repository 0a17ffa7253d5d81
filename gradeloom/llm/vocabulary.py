"""Word counts of a corpus, and how often words end its sentences.

Counts are gathered where the text is read and only their sums are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows

STRIP = ".,;:!?()[]{}\"'“”«»*|…।"
TERMINATORS = ".!?।"
NAME = "<name>"
#: Distinct counters held by a task before they are handed on.
HELD = 300_000
WORD, CLEAN, END_ONE, END_TWO, PAIR, TOTAL = "w", "c", "e1", "e2", "b", "n"


def bare(token: str) -> str:
    """A token without the punctuation round it, in lower case."""
    return token.strip(STRIP).lower()


def masked(token: str) -> str:
    """bare(token), or NAME for a capitalised word."""
    core = token.strip(STRIP)
    return NAME if core[:1].isupper() and len(core) > 1 else core.lower()


def _count(rows: Iterable[tuple], ends: bool) -> Iterator[tuple]:
    words, clean, pairs, one, two = (Counter() for _ in range(5))
    strip = STRIP
    for text, typed in rows:
        if not text:
            continue
        tokens = text.split()
        bares = [t.strip(strip).lower() for t in tokens]
        # What stands at the edge of a line may be half a word, or cut.
        inner = bares[1:-1]
        words.update(inner)
        if typed:
            clean.update(inner)
        if ends:
            # The last word of a text is out of pairs, too: it may be a piece.
            seconds = inner if text.islower() else [NAME if t[0].isupper() and len(t) > 1 else w for t, w in zip(tokens[1:-1], inner)]
            pairs.update(map("%s %s".__mod__, zip(bares, seconds)))
            if "." in text or "?" in text or "!" in text or "।" in text:
                for i, token in enumerate(tokens):
                    # Dots in a row mark a break as often as an end.
                    if token[-1] in TERMINATORS and i and len(token) > 1 and token[-2] not in TERMINATORS:
                        last = masked(token)
                        one[last] += 1
                        two[masked(tokens[i - 1]) + " " + last] += 1
        if len(words) + len(pairs) + len(two) > HELD:
            yield from _rows(words, clean, pairs, one, two)
            for counter in (words, clean, pairs, one, two):
                counter.clear()
    yield from _rows(words, clean, pairs, one, two)


def _rows(words: Counter, clean: Counter, pairs: Counter, one: Counter, two: Counter) -> Iterator[tuple]:
    for kind, counter in ((PAIR, pairs), (END_ONE, one), (END_TWO, two)):
        for key, n in counter.items():
            yield kind, key, n
    del words[""]
    for key, n in words.items():
        if len(key) <= 40 and any(map(str.isalpha, key)):
            yield WORD, key, n
            if key in clean:
                yield CLEAN, key, clean[key]
    yield TOTAL, "", sum(words.values())


def corpus_counts(texts: DataFrame, ends: bool = False) -> DataFrame:
    """kind, word, n: words (w), words in typed texts (c), with `ends` also sentence ends of one (e1) and two words (e2) and word pairs (b), and the token total (n).

    The first and the last token of a text are left out of words, the last out
    of pairs: in a line of a page they may be pieces.

    texts has a string and a boolean column, the latter true for texts that
    were typed, not scanned. Nulls and empty texts add nothing; tokens over 40
    characters, or without a letter, count in the total alone. Repeated rows
    count as often as they come.
    """
    return map_rows(texts, "kind string, word string, n bigint", lambda rows: _count(rows, ends)).groupBy("kind", "word").agg(F.sum("n").alias("n"))


def frequent_keys(counts: DataFrame, kind: str, share: float = 2e-6, least: int = 1) -> dict[str, int]:
    """The keys of a kind that make up at least `share` of it and come `least` times: at most 1/share entries."""
    own = counts.where(F.col("kind") == kind)
    total = own.agg(F.sum("n").alias("t")).first()["t"] or 0
    return {r["word"]: r["n"] for r in own.where(F.col("n") >= max(least, share * total)).select("word", "n").collect()}


def frequent_words(counts: DataFrame, share: float = 2e-6, least: int = 5) -> dict[str, int]:
    """The words that make up at least `share` of all tokens and come `least` times, with their counts.

    At most 1/share words can do so (500,000 at the default), whatever the
    size of the corpus: that bounds what the driver holds and broadcasts.
    """
    total = counts.where(F.col("kind") == TOTAL).agg(F.sum("n").alias("t")).first()["t"] or 0
    rows = counts.where((F.col("kind") == WORD) & (F.col("n") >= max(least, share * total))).select("word", "n").collect()
    return {r["word"]: r["n"] for r in rows}
