"""One pass over the lines of each page in reading order: what the operators on cut and noisy text need of them.

Lines are brought together by page, a key of a few dozen rows; what reaches
from one page to the next travels as a few words of its edge lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows
from gradeloom.llm.automaton import PAIRS, OpenSigns, half_escape, open_at_end, open_markup
from gradeloom.llm.lines import BLANK, FURNITURE, JUNK, LIST, PROSE, TABLE, classify_line
from gradeloom.llm.vocabulary import STRIP, bare

HYPHENS = "-‐‑¬\xad"
#: Lines at the top and at the foot of a page where a running header, footer or page number may stand.
EDGE = 2
#: Lines looked at for the second half of a broken word.
REACH = 4
#: Places in the reading order that one block of a page may span: a longer page is spread over tasks, block by block.
MOST_LINES = 20_000
#: Pages of a paper that are put in order together.
PAGE_SPAN = 1024

_PAGE_WORD = r"p\s?[ao0]\s?g\s?[ec]|pg|seite|p[áa]gina"
PAGE_NUMBER = re.compile(
    rf"^\s*(?:(?:{_PAGE_WORD})\s*[.:|]?\s*[\dl]{{1,4}}(?:\s+(?:of|de|von|sur)\s+[\dl]{{1,4}})?|[-–—]\s*[\dl]{{1,4}}\s*[-–—]|\[\s*[\dl]{{1,4}}\s*\]|[\dl]{{1,4}}\s*/\s*[\dl]{{1,4}}|\d{{1,4}}|[ivxl]{{1,7}})\s*$",
    re.IGNORECASE,
)
_PAGE_TAIL = re.compile(rf"\s+(?:{_PAGE_WORD})\s*[.:|]?\s*[\dl]{{1,4}}(?:\s+of\s+[\dl]{{1,4}})?\s*$", re.IGNORECASE)
# Letters and signs that scanning confuses, each class under one sign, applied in this order.
_FOLDS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "n"), ("u", "n"), ("0", "o"), ("a", "o"), ("c", "e"), ("e", "o"), ("1", "l"), ("i", "l"), ("|", "l"), ("5", "s"), ("f", "t"), ("9", "g"), ("h", "b"))
_WORDS = re.compile(r"[^\W_]+")
_COUNTED = re.compile(r"\d{3,}'?\s*$")
_PARTS = re.compile(r"\s+[-|]\s+")
_NUMBER = re.compile(r"^\d+'?$|^[\dlO]{3,}$")
# A label before a text whose own bracket may stay open, as in "Q11(d. " or "13 (ii ".
_LABEL = re.compile(r"^\W*(?:(?:\w+\W{1,3})?(?:[\w|]+|[\w|]*[\d|]\s)|(?<![\w ]))[(\[]\s*(?:[a-zA-Z]|[ivxlIVXL]{1,5}|\d{1,2})(?=[\s.:,;*)\]-])")
# The sources whose text was typed, not scanned; a line of theirs is a whole paragraph.
DIGITAL = ("docx_upload", "pdf_text")
#: Signs that a page may close for the page before, by their bits in the opening of a page.
SIGNS = "([{«“\""
_ENDS = ".!?।:;"
#: Words of a sentence that are kept where it ends in dots.
SENTENCE_TAIL = 30
#: Room, in characters, that must be left beside the next word before a line counts as short.
LEAST_SLACK = 2


def fold_scan(text: str) -> str:
    """text with letters that scanning confuses under one sign each."""
    for seen, sign in _FOLDS:
        text = text.replace(seen, sign)
    return text


def header_keys(text: str) -> list[str]:
    """Keys under which a line may be a known header: its folded words without numbers, whole, shortened, and with one word left open.

    Empty for lines that do not look like one: a header starts with a capital,
    ends without punctuation of a sentence, has no comma, and up to a dozen words.
    """
    s = text.strip()
    if len(s) > 90 or not s[:1].isupper() or s[-1] in ",;:?!" + HYPHENS:
        return []
    parts = s.split()
    if ", " in s or (s[-1] == "." and (len(parts) < 3 or sum(p[:1].isupper() for p in parts) * 2 <= len(parts))):
        return []
    s = _PAGE_TAIL.sub("", s)
    words = _folded(s)
    if not 2 <= len(words) <= 12 or sum(map(len, words)) < 8:
        return []
    keys = [" ".join(words)]
    if len(words) > 2:
        keys += [" ".join([*words[:i], "~", *words[i + 1 :]]) for i in range(len(words))]
    if len(words[-1]) == 1:
        keys.append(" ".join(words[:-1]))
    parts = _PARTS.split(s)
    if len(parts) > 1:
        for part in map(_folded, parts):
            if len(part) > 1 and sum(map(len, part)) >= 8:
                keys.append(" ".join(part))
    if len(words[-1]) > 3:
        keys.append(" ".join([*words[:-1], words[-1][:-1] + "…"]))
        keys.append(" ".join([*words[:-1], words[-1] + "…"]))
    return keys


def _folded(text: str) -> list[str]:
    # No fold reaches over a space.
    return fold_scan(" ".join([w for w in _WORDS.findall(text.lower()) if not _NUMBER.match(w)])).split()


def page_kind(lines: list[tuple[int, int]]) -> int:
    """PROSE, LIST, TABLE or JUNK from (class, length) of a page's lines: the largest, where running text has less than half."""
    sums = [0] * 6
    for kind, n in lines:
        sums[kind] += n
    if sums[PROSE] * 2 >= sum(sums[:4]):
        return PROSE
    return max((JUNK, TABLE, LIST), key=sums.__getitem__)


def first_word(text: str) -> str:
    """The first token of a line, bare."""
    parts = text.split(None, 1)
    return bare(parts[0]) if parts else ""


def broken_end(text: str) -> str | None:
    """The first half of a word broken at the end of a line, or None."""
    s = text.rstrip()
    if len(s) > 1 and s[-1] in HYPHENS and s[-2].isalpha():
        return s[:-1].split()[-1].lstrip(STRIP).lower()
    return None


def join_halves(half: str, seconds: list[str], known: dict[str, int] | frozenset) -> str | None:
    """The whole word of a half and one of the possible second halves, by what is known; else by the nearest."""
    for second in seconds:
        if second and second[0].isalpha():
            plain, compound = half + second, f"{half}-{second}"
            if plain in known and (compound not in known or known[plain] >= known[compound]):
                return plain
            if compound in known:
                return compound
    for second in seconds:
        if second and second[0].isalpha():
            return half + second
    return None


RECORD = "what string, paper_id bigint, page int, line_uid bigint, line_index int, source string, a string, b string, x int, y int"


def scan_pages(lines: DataFrame, known: Broadcast, noise: bool, cuts: bool) -> DataFrame:
    """The findings of one pass over the pages, one row each (`what` tells which; see below).

    lines: paper_id, page, line_uid, line_index, source, text. known: a
    broadcast dict of frequent words. Rows with equal line_uid in a page count
    once; null and blank texts count as lines without anything in them. A line
    without a paper, page or place stands alone, as a page of its own. Blocks of
    MOST_LINES places are read apart, as if each were a page.

    noise: listed, for pages that may be set as entries; page_number; head_key (a: key, x: at page edges, y: elsewhere,
    summed over many lines); head_line (a: keys of an edge line, tab
    separated); rare (a: token that isn't known); hyphen (a: whole word); and,
    for breaks over pages, half (a: first half) and opening (a: first words of
    a page's first lines, tab separated).
    cuts: tail (a: last five words, b: first token of the next line, x:
    characters, y: room left on the line beside that word, by the longest
    running line of the page), last_tail (the same for the last line, without
    a next word), both with _loose behind for lines outside running text,
    dots (a: last words, from the lines before too, back to a terminator) for lines that end in dots, and unread (x: characters) for ended lines of at least 500 characters.
    escape for paragraphs that end within an escape; left_open (a: last token, y: room left beside the next word, if any) for
    paragraphs that end in an open bracket, quote or markup, and for the first
    scanned line with room left after a sign that its page never closes;
    last_open (the same for the last line of a page, b: the open signs).
    Both: opening (a: first words of a page's first lines, tab separated, b:
    the first token as it stands, x, for cuts: bits of SIGNS closed but not opened).
    """
    narrow = lines.select(F.col("paper_id").cast("bigint"), F.col("page").cast("int"), F.col("line_uid").cast("bigint"), F.col("line_index").cast("int"), F.col("source").cast("string"), F.col("text").cast("string"))
    homeless = F.col("paper_id").isNull() | F.col("page").isNull() | F.col("line_index").isNull()
    placed = narrow.withColumn("part", F.when(homeless, F.xxhash64("line_uid", "text")).otherwise((F.col("line_index") / MOST_LINES).cast("bigint")))
    ordered = placed.repartition("paper_id", "page", "part").sortWithinPartitions("paper_id", "page", "part", "line_index", "line_uid")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        words = known.value
        keys: Counter = Counter()
        for paper, page, block in _pages(rows):
            yield from scan_page(paper, page, block, words, noise, cuts, keys)
            if len(keys) > 200_000:
                yield from _key_rows(keys)
                keys.clear()
        yield from _key_rows(keys)

    return map_rows(ordered, RECORD, run)


def page_openings(scanned: DataFrame) -> DataFrame:
    """paper_id, page, next_page, a, b, x: for each page of running text, how the next such page of its paper opens.

    Pages of lists, tables and junk between them are passed over. One row a page
    is put in order, in spans of PAGE_SPAN pages, so that a paper of any length
    is spread over the tasks; between spans only their last pages are.
    """
    spans = scanned.where("what = 'opening'").select("paper_id", "page", (F.col("page") / PAGE_SPAN).cast("int").alias("span"), "a", "b", "x")
    within = Window.partitionBy("paper_id", "span").orderBy("page")
    known = spans.withColumn("before", F.lag("page").over(within))
    ends = spans.groupBy("paper_id", "span").agg(F.max("page").alias("last"))
    crossing = ends.select("paper_id", "span", F.lag("last").over(Window.partitionBy("paper_id").orderBy("span")).alias("crossed")).where("crossed is not null")
    columns = ["paper_id", F.col("before").alias("page"), F.col("page").alias("next_page"), "a", "b", "x"]
    first = known.where("before is null").join(crossing, ["paper_id", "span"]).withColumn("before", F.col("crossed"))
    return known.where("before is not null").select(*columns).unionByName(first.select(*columns))


def _pages(rows: Iterable[tuple]) -> Iterator[tuple]:
    at, block, last = None, [], None
    for paper, page, line, index, source, text, part in rows:
        if (paper, page, part) != at:
            if block:
                yield *at[:2], block
            at, block, last = (paper, page, part), [], None
        if line != last or line is None:
            block.append((line, index, source, text or ""))
            last = line
    if block:
        yield *at[:2], block


def _key_rows(keys: Counter) -> Iterator[tuple]:
    merged: dict[str, list[int]] = {}
    for (key, edge), n in keys.items():
        merged.setdefault(key, [0, 0])[not edge] += n
    for key, (edge, inner) in merged.items():
        yield "head_key", None, None, None, None, None, key, None, edge, inner


def scan_page(paper: int, page: int, block: list[tuple], words: dict[str, int], noise: bool, cuts: bool, keys: Counter) -> Iterator[tuple]:
    """The findings of one page; see scan_pages."""
    classes = [classify_line(text) for _, _, _, text in block]
    prose = page_kind([(k, len(t)) for k, (_, _, _, t) in zip(classes, block)]) == PROSE
    n = len(block)
    # Lines that may be furniture: at an edge, and a number or a possible header.
    loose = [False] * n
    edge_lines = {*range(min(EDGE, n)), *range(max(0, n - EDGE), n)}
    for i, (line, index, source, text) in enumerate(block):
        edge = i in edge_lines
        if edge and PAGE_NUMBER.match(text):
            loose[i] = True
            if noise:
                yield "page_number", paper, page, line, index, source, None, None, None, None
            continue
        if edge or (noise and text[:1].isupper()):
            found = header_keys(text)
            if found:
                if edge:
                    loose[i] = classes[i] != PROSE or bool(_COUNTED.search(text)) or sum(w[:1].isupper() for w in text.split()) * 2 > len(text.split())
                if noise:
                    if prose:  # the captions of lists and tables recur at edges too
                        for key in found:
                            keys[key, edge] += 1
                    if edge:
                        yield "head_line", paper, page, line, index, source, "\t".join(found), None, None, None
    if noise:
        entries, filled = sum(k in (LIST, TABLE, JUNK) for k in classes), n - classes.count(BLANK)
        if entries * 5 > (filled - sum(loose)) * 3:
            yield "listed", paper, page, None, None, None, None, None, None, None
    if not prose:
        return
    body = [i for i in range(n) if not loose[i] and classes[i] != BLANK]
    place = {i: p for p, i in enumerate(body)}
    broken = [broken_end(block[i][3]) if i in place else None for i in range(n)]
    # Labels and hyphens are set besides the wrapped text: lines that run on in lower case tell its width.
    running = [block[i][3].rstrip() for i in body if classes[i] == PROSE]
    width = max((len(s) for s in running if s[0].islower() and s[-1] not in HYPHENS), default=0) or max(map(len, running), default=0)
    for i, (line, index, source, text) in enumerate(block):
        if noise:
            if classes[i] not in (FURNITURE, BLANK, JUNK) or (classes[i] == JUNK and i in place):
                tokens = text.split()
                # The halves of a broken word are no words.
                if broken[i]:
                    tokens.pop()
                if tokens and place.get(i) and broken[body[place[i] - 1]]:
                    tokens.pop(0)
                for token in tokens:
                    w = token.strip(STRIP).lower()
                    if w not in words and len(w) > 1 and len(w) <= 40:
                        yield "rare", paper, page, line, index, source, w, None, None, None
            half = broken[i]
            if half:
                seconds = [first_word(block[j][3]) for j in body[place[i] + 1 : place[i] + 1 + REACH]]
                if seconds:
                    whole = join_halves(half, seconds[:1], words)
                    best = whole if whole in words else join_halves(half, seconds, words)
                    yield "hyphen", paper, page, line, index, source, best if best in words else whole or best, None, None, None
                if place[i] >= len(body) - 2:
                    yield "half", paper, page, line, index, source, half, None, int(bool(seconds)), None
        if cuts and i in place:
            s = text.rstrip()
            if s.endswith(("...", "…")):
                yield "dots", paper, page, line, index, source, " ".join(_sentence_before(block, body, place[i]).split()[-SENTENCE_TAIL:]), None, len(text), None
            elif s and s[-1] not in ".!?।:;" + HYPHENS and s[-1] not in "\"')]”»":
                parts = s.split()
                after = body[place[i] + 1 : place[i] + 2]
                following = block[after[0]][3].split(None, 1)[:1] if after else []
                slack = width - len(s) - 1 - (len(following[0]) if following else 0)
                what = "tail" if after else "last_tail"
                flows = classes[i] == PROSE or (place[i] > 0 and classes[body[place[i] - 1]] == PROSE and block[body[place[i] - 1]][3].rstrip()[-1:] not in ".!?।:")
                yield what + ("" if flows else "_loose"), paper, page, line, index, source, " ".join(parts[-5:]), following[0] if following else "", len(text), slack
            elif len(text) >= 500:
                yield "unread", paper, page, line, index, source, None, None, len(text), None
    closes = None
    if cuts:
        closes = 0
        if block and block[0][2] in DIGITAL:
            yield from _open_paragraphs(paper, page, [block[i] for i in body if classes[i] == PROSE])
        else:
            signs = OpenSigns()
            for i in body:
                signs.read(_LABEL.sub("", block[i][3], count=1), i)
            closes = sum(1 << k for k, sign in enumerate(SIGNS) if any(sign == {**PAIRS, '"': '"'}[c] for c in signs.unopened))
            if signs.stack:
                yield from _open_lines(paper, page, block, classes, body, width, signs.stack)
    if body:
        yield "opening", paper, page, None, None, None, "\t".join(first_word(block[j][3]) for j in body[:REACH]), (block[body[0]][3].split(None, 1) or [""])[0], closes, None


def _sentence_before(block: list[tuple], body: list[int], place: int) -> str:
    """A line behind up to two lines of its sentence."""
    first = place
    while first > max(0, place - 2) and block[body[first - 1]][3].rstrip()[-1:] not in _ENDS:
        first -= 1
    return " ".join(block[i][3] for i in body[first : place + 1])


def _open_paragraphs(paper: int, page: int, lines: list[tuple]) -> Iterator[tuple]:
    for line, index, source, text in lines:
        s = text.rstrip()
        if half_escape(s):
            yield "escape", paper, page, line, index, source, None, None, len(text), None
        elif s.rstrip("\"'”»)]*_")[-1:] not in _ENDS and not s.endswith(("...", "…")):
            plain = _LABEL.sub("", s, count=1)
            if open_at_end(plain) or open_markup(plain):
                yield "left_open", paper, page, line, index, source, s.split()[-1], None, len(text), None


def _open_lines(paper: int, page: int, block: list[tuple], classes: list[int], body: list[int], width: int, stack: list[tuple[str, int]]) -> Iterator[tuple]:
    """The scanned line at which a sign that the page never closes was cut off: the first behind it that had room for the next word, if it has no end."""
    done: set[int] = set()
    for _, opened in stack:
        for p in range(body.index(opened), len(body)):
            i = body[p]
            line, index, source, text = block[i]
            s = text.rstrip()
            following = (block[body[p + 1]][3].split(None, 1) or [""])[0] if p + 1 < len(body) else ""
            slack = width - len(s) - 1 - len(following)
            last = p + 1 == len(body)
            if not last and slack <= LEAST_SLACK:
                continue
            core = s.rstrip("\"'”»)]*_")
            if i not in done and classes[i] == PROSE and core and core[-1] not in _ENDS + HYPHENS and not s.endswith(("...", "…")):
                done.add(i)
                still = "".join(sign for sign, n in stack if n <= i)
                yield "last_open" if last else "left_open", paper, page, line, index, source, s.split()[-1], still, len(text), slack
            break
