"""Free-hand question labels mapped to the entries of their exam's list.

Every distinct token of every distinct label is repaired once: it is joined to
the reference vocabulary by edit distance, over deletion keys, so that no pair
of far strings ever meets. The repaired tokens become tagged parts of an entry
(a number, letter, Roman numeral or word for each level), and the entries of
the exam are ranked by soft TF-IDF over these tags, each level counting with
the similarity of its reading. Labels repeat a lot, so everything runs on distinct labels and
the blocks join in last; a label that fills a third of all blocks is one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows

# Words that lead a label, in the languages of the exams.
LEAD_WORDS = (
    "ans answer antwort aufg aufgabe frage n no nr nro num number numero número part preg pregunta q qn que ques quesion quest"
    " question rep reponse resp respuesta rép réponse sol soln solution to"
).split()
# Words that lead a section, and those that lead a part.
SECTION_WORDS = "section sec sección seccion abschnitt".split()
PARTS = ["part", "parte", "partie", "teil"]
# Number words of the languages of the exams, from one on.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
    "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte",
    "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt",
    "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig",
)
LEAD_WORDS += SECTION_WORDS + PARTS[1:]
# Roman numerals from one to twenty.
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
# Letters and signs that are read in place of a digit.
DIGIT_LOOKALIKES = {"|": "1", "b": "8", "g": "9", "i": "1", "l": "1", "o": "0", "q": "9", "s": "5", "z": "2"}

_ROMAN_VALUE = {r: i + 1 for i, r in enumerate(ROMAN)}
_NUMBER_VALUE = {w: i + 1 for words in NUMBER_WORDS for i, w in enumerate(words.split()) if "-" not in w}
_LOOK = str.maketrans(DIGIT_LOOKALIKES)
_TOKEN = re.compile(r"[^\W_|]*\|[^\W_]*\|*[^\W_]*|[^\W_]+")
_NUMERO = re.compile(r"\bn\s*\.?\s*[º°]|\bn\s?\.\s?o\b(?=\W)")
_INITIALS = re.compile(r"\b(?:[a-z]\.){3,}")
_GLUED = re.compile(r"(q|qn|ans|no)([\dsilo|]+.*)")
_NUMBER_PART = re.compile(r"(\d+)([a-hivx]+)")
#: Levels that a label may have.
MOST_LEVELS = 4


def tokens_of(label: str) -> list[str]:
    """The tokens of a label: letters and digits after compatibility folding, glued leads and parts taken apart."""
    text = unicodedata.normalize("NFKC", label.replace("º", "°")).lower()
    text = _INITIALS.sub(lambda m: m[0].replace(".", ""), text)
    found: list[str] = []
    for token in _TOKEN.findall(_NUMERO.sub(" no ", text)):
        glued = _GLUED.fullmatch(token)
        if glued and token not in LEAD_WORDS and not token.isalpha():
            found.append(glued[1])
            token = glued[2]
        split = _NUMBER_PART.fullmatch(token)
        if split and (len(split[2]) == 1 or split[2] in _ROMAN_VALUE):
            found += [split[1], split[2]]
        else:
            found.append(token)
    return found


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits from a to b with neighbouring letters swapped as one edit; most + 1 if more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        before = last
        if min(row) > most:
            return most + 1
    return row[-1]


def edits_allowed(token: str) -> int:
    """None below three letters or with digits, one up to five letters, two beyond."""
    return 0 if len(token) < 3 or not token.isalpha() else 1 if len(token) < 6 else 2


def deletion_keys(token: str, edits: int) -> set[str]:
    """token and what is left of it after up to `edits` deletions: tokens within that distance share a key."""
    keys = level = {token}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        keys = keys | level
    return keys


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token -> word, similarity: the nearest vocabulary word, ties by the word; only tokens with one.

    tokens: distinct `token`. vocabulary: distinct `word`. Tokens longer than 40
    characters repair only to themselves: no vocabulary word comes near them.
    """

    def keys(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (word,) in rows:
            if word:
                yield from ((key, word) for key in deletion_keys(word, edits_allowed(word) if len(word) <= 40 else 0))

    def score(rows: Iterable[tuple]) -> Iterator[tuple]:
        for token, word in rows:
            most = min(edits_allowed(token), edits_allowed(word))
            distance = osa_distance(token, word, most)
            if distance <= most:
                yield token, word, 1.0 - distance / max(len(token), len(word))

    left = map_rows(tokens.select(F.col("token").cast("string")), "key string, token string", keys)
    right = map_rows(vocabulary.select(F.col("word").cast("string")), "key string, word string", keys)
    near = map_rows(left.join(right, "key").select("token", "word").distinct(), "token string, word string, similarity double", score)
    best = F.max_by(F.struct("word", "similarity"), F.struct(F.col("similarity"), F.col("word")))
    return near.groupBy("token").agg(best.alias("b")).select("token", "b.word", "b.similarity")


def read_number(token: str, word: str | None) -> int | None:
    """The question number that a token names: digits, ordinal, number word, Roman numeral, or misread digits."""
    plain = re.fullmatch(r"0*(\d{1,6})(?:st|nd|rd|th)?", token)
    if plain:
        return int(plain[1])
    for w in (token, word):
        if w in _NUMBER_VALUE:
            return _NUMBER_VALUE[w]
    if token in _ROMAN_VALUE:
        return _ROMAN_VALUE[token]
    digits = token.translate(_LOOK)
    return int(digits) if digits.isdigit() and len(digits) <= 2 else None


def read_part(token: str) -> dict[str, float]:
    """The tags that a token behind the first level may stand for, with their similarity. Letters never equal numbers."""
    tags: dict[str, float] = {}
    if token.isdigit():
        tags[f"s:{int(token[:9])}"] = 1.0
        tags[f"r:{int(token[:9])}"] = 0.95
    elif re.fullmatch("[a-z]{1,5}|[il|]{1,4}", token):
        roman = _ROMAN_VALUE.get(token) or _ROMAN_VALUE.get(token.replace("l", "i").replace("|", "i"))
        if roman:
            tags[f"r:{roman}"] = 1.0 if token in _ROMAN_VALUE else 0.9
            tags[f"s:{roman}"] = 0.9
        if len(token) == 1 and token.isalpha():
            tags[f"l:{token}"] = 1.0
        digits = token.translate(_LOOK)
        if digits.isdigit():
            tags.setdefault(f"s:{int(digits)}", 0.8)
    return tags


def apart(token: str) -> list[str]:
    """A letter with digits behind it as two tokens, anything else as it is."""
    return list(re.fullmatch(r"([a-z])(\d{1,3})", token).groups()) if re.fullmatch(r"[a-z]\d{1,3}", token) else [token]


def read_first(token: str, word: str | None, similarity: float = 1.0) -> list[dict[str, float]]:
    """The tags of the first level that a token may stand for: its number, its letter, or the word it was repaired to."""
    number = read_number(token, word)
    tags = {} if number is None else {f"n:{number}": 1.0}
    if len(token) == 1 and token.isalpha():
        tags[f"l:{token}"] = 1.0
    if tags:
        return [tags]
    return [{f"w:{word}": similarity}] if word and word not in LEAD_WORDS else []


def read_label(tokens: list[str], repaired: list[str | None], has_parent: bool, similar: list[float | None] = ()) -> tuple[list[dict[str, float]], bool] | None:
    """(levels, bare) of a label, or None if it names nothing: the tags that each of its levels may stand for.

    bare: the label is a part alone and takes the first level of its parent.
    """
    levels: list[dict[str, float]] = []
    lead = said_part = bare = False
    for token, word, near in zip(tokens, repaired, [*similar, *[None] * len(tokens)]):
        if not levels and word in LEAD_WORDS and word not in PARTS and token not in _ROMAN_VALUE:
            lead = True
        elif word in PARTS and len(levels) < 2 and not bare:
            said_part = True
        elif levels:
            levels.append(read_part(token))
        elif said_part or (has_parent and not lead and (token in _ROMAN_VALUE or (len(token) == 1 and token.isalpha()))):
            bare = True
            levels.append(read_part(token))
        else:
            levels += read_first(token, word, near or 1.0)
        if (not levels and not (lead or said_part)) or (levels and not levels[-1]) or len(levels) > MOST_LEVELS:
            return None
    return (levels, bare) if levels else None


def entry_levels(entry: str | None) -> list[list[str]]:
    """The tags of each level of a list entry: 3, 3.1, 3(a), 3(a)(ii), Q3, III, A1, Section B or a plain word."""
    tokens = [t for token in tokens_of(entry or "") for t in apart(token) if t not in LEAD_WORDS or t in _ROMAN_VALUE]
    found: list[list[str]] = []
    for token in tokens:
        if not found:
            value = int(token[:9]) if token.isdigit() else _ROMAN_VALUE.get(token) or _NUMBER_VALUE.get(token)
            found.append(([f"n:{value}"] if value else []) + ([f"l:{token}"] if len(token) == 1 and token.isalpha() else []) or [f"w:{token}"])
        elif token.isdigit():
            found.append([f"s:{int(token[:9])}"])
        else:
            found.append(([f"r:{_ROMAN_VALUE[token]}"] if token in _ROMAN_VALUE else []) + ([f"l:{token}"] if len(token) == 1 and token not in _ROMAN_VALUE else []) or [f"w:{token}"])
    return found


def _visible(label: Column) -> Column:
    """True if the label has a character besides white space and marks of no width."""
    return label.rlike(r"[^\s  -‏ ⁠　﻿]")


def resolve_labels(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """block_id, q_number: the entry that each free-hand label means, or `unmatched`.

    blocks: block_id, exam_id, question_number, parent_block_id. entries:
    exam_id, q_number. Left out are null and blank labels and labels that are
    literally an entry. Second deliveries of a block, repeated entries and
    extra columns change nothing; a block of an exam without a list is unmatched.
    """
    own = blocks.select("block_id", "exam_id", F.col("question_number").alias("label"), "parent_block_id").distinct()
    listed = entries.select("exam_id", F.col("q_number").alias("label")).where(F.col("label").isNotNull()).distinct()
    cases = own.where(F.col("label").isNotNull() & _visible(F.col("label"))).join(listed, ["exam_id", "label"], "left_anti")
    parents = own.groupBy(F.col("block_id").alias("up")).agg(F.min("label").alias("parent_label")).withColumn("has_parent", F.lit(True))
    # Main questions have no parent: their null key is spread over the tasks, and the flag keeps it from meeting a block.
    keyed = cases.withColumns({"up": F.coalesce("parent_block_id", F.xxhash64("block_id")), "has_parent": F.col("parent_block_id").isNotNull()})
    met_parents = parents.withColumn("found", F.lit(True))
    cases = keyed.join(met_parents, ["up", "has_parent"], "left").withColumn("has_parent", F.coalesce("found", F.lit(False))).drop("up", "found")

    questions = cases.select("exam_id", "label", "has_parent", "parent_label").distinct()
    strings = questions.select("label").union(questions.where(F.col("parent_label").isNotNull()).select("parent_label")).distinct()
    tokenized = map_rows(strings, "label string, tokens array<string>", lambda rows: ((label, tokens_of(label)) for (label,) in rows))
    vocabulary = blocks.sparkSession.createDataFrame([(w,) for w in sorted({*LEAD_WORDS, *_NUMBER_VALUE})], "word string")
    listed_words = map_rows(listed.select("label"), "word string", lambda rows: ((t,) for (label,) in rows for t in tokens_of(label)))
    repaired = repair_tokens(tokenized.select(F.explode("tokens").alias("token")).distinct(), vocabulary.union(listed_words).distinct())
    placed = tokenized.select("label", F.posexplode("tokens").alias("pos", "token")).join(repaired, "token", "left")
    words = placed.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "word", "similarity"))).alias("w"))
    words = words.select("label", F.col("w.token").alias("tokens"), F.col("w.word").alias("words"), F.col("w.similarity").alias("similar"))

    parent_words = words.select(F.col("label").alias("parent_label"), F.col("tokens").alias("parent_tokens"), F.col("words").alias("parent_words"))
    known = questions.join(words, "label", "left").join(parent_words, "parent_label", "left")

    def tags(rows: Iterable[tuple]) -> Iterator[tuple]:
        for exam, label, parent, has_parent, own_tokens, own_words, similar, up_tokens, up_words in rows:
            read = [(t, w, s) for t, w, s in zip(own_tokens or (), own_words or (), similar or ())]
            # "B2" may be a misread 82, or the second part of B.
            split = [(x, w if x == t else None, s) for t, w, s in read for x in apart(t)]
            for tokens in (read, split) if len(split) > len(read) else (read,):
                found = read_label([t for t, _, _ in tokens], [w for _, w, _ in tokens], has_parent, [s for _, _, s in tokens])
                if found is None:
                    continue
                levels, bare = found
                if bare:
                    up = read_label(up_tokens or [], up_words or [], False)
                    if up is None or up[1]:
                        continue
                    levels = [up[0][0], *levels]
                for level, options in enumerate(levels):
                    for tag, similarity in options.items():
                        yield exam, label, parent, has_parent, len(levels), level, f"{level}{tag}", similarity

    label_tags = map_rows(
        known.select("exam_id", "label", "parent_label", "has_parent", "tokens", "words", "similar", "parent_tokens", "parent_words"),
        "exam_id bigint, label string, parent_label string, has_parent boolean, depth int, level int, tag string, similarity double",
        tags,
    )

    def entry_tags(rows: Iterable[tuple]) -> Iterator[tuple]:
        for exam, entry in rows:
            levels = entry_levels(entry)
            for level, options in enumerate(levels):
                yield from ((exam, entry, len(levels), f"{level}{tag}") for tag in options)

    entry_rows = map_rows(listed, "exam_id bigint, q_number string, entry_depth int, tag string", entry_tags)
    counted = entry_rows.groupBy("exam_id", "tag").agg(F.count(F.lit(1)).alias("df"))
    sizes = listed.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n_entries"))
    weights = counted.join(sizes, "exam_id").select("exam_id", "tag", F.log(1 + F.col("n_entries") / F.col("df")).alias("weight"))
    weighted = entry_rows.join(weights, ["exam_id", "tag"]).withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("exam_id", "q_number"))))

    # Soft TF-IDF: each level counts with its best reading, as similar as it is and as rare as its tag.
    key = ["exam_id", "label", "parent_label", "has_parent"]
    met = label_tags.join(weighted, ["exam_id", "tag"])
    best_readings = met.groupBy(*key, "q_number", "depth", "level").agg(F.max(F.struct("similarity", "weight", "norm")).alias("m"), F.max("entry_depth").alias("entry_depth"))
    ranked = best_readings.groupBy(*key, "q_number", "depth").agg(
        F.count(F.lit(1)).alias("n_levels"), F.max("entry_depth").alias("entry_depth"),
        (F.sum(F.col("m.similarity") * F.col("m.weight") * F.col("m.weight")) / (F.max("m.norm") * F.max("m.norm"))).alias("score"),
    )
    # An exact check of the ranked entries: every level of the label must be met, and the entry have no more.
    whole = (F.col("n_levels") == F.col("depth")) & (F.col("n_levels") == F.col("entry_depth"))
    best = ranked.where(whole).groupBy(*key).agg(F.max_by("q_number", F.struct(F.col("score"), F.col("q_number"))).alias("q_number"))
    joined = cases.join(best, cases.label.eqNullSafe(best.label) & (cases.exam_id == best.exam_id) & cases.parent_label.eqNullSafe(best.parent_label) & (cases.has_parent == best.has_parent), "left")
    return joined.select(cases.block_id, F.coalesce(best.q_number, F.lit("unmatched")).alias("q_number")).distinct()
