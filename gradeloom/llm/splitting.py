"""Items over a size limit cut into pieces at natural boundaries, with an exact overlap.

Recursive bisection: an item is cut at the strongest boundary near its middle
and each half that is still too long is cut again; then every piece but the
first takes the last `overlap` characters before it in front. Lengths are
characters as SQL counts them (code points).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows

#: Boundaries by strength, strongest first; a cut falls behind the match. The last class cuts only where nothing else is left.
BOUNDARIES = ("paragraph", "line", "sentence", "clause", "space", "stop")
_BOUNDARY = re.compile(r"(\n\s*\n\s*)|(\n\s*)|([.!?。।][\"'”’)\]]*\s+|[。।])|([;:,]\s+)|(\s+)|([.!?])")
_BREAKING = re.compile(r"[\s.!?。।]+")


def longest_run(text: str) -> int:
    """The most characters in a row without white space or a sentence terminator."""
    return max(map(len, _BREAKING.split(text)), default=0)


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Where to cut a text, ascending, and what each cut falls on (`forced` if on nothing).

    The first piece may have `limit` characters, every later one `limit - overlap`
    before its overlap is added.
    """
    room = limit - overlap
    if overlap < 0 or room <= 0:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return []
    places: list[list[int]] = [[] for _ in BOUNDARIES]
    for m in _BOUNDARY.finditer(text):
        places[m.lastindex - 1].append(m.end())

    def choose(start: int, end: int) -> tuple[int, str]:
        middle, reach = (start + end) // 2, (end - start) // 4
        # The strongest class wins, in the middle half first and then anywhere; then the place nearest to the middle.
        for low, high in ((middle - reach, middle + reach), (start + 1, end - 1)):
            for kind, at in enumerate(places):
                i, j = bisect_left(at, low), bisect_right(at, high)
                if i < j:
                    k = bisect_left(at, middle, i, j)
                    return min((at[x] for x in (k - 1, k) if i <= x < j), key=lambda p: abs(p - middle)), BOUNDARIES[kind]
        cut = middle
        while cut < end - 1 and unicodedata.category(text[cut]) in ("Mn", "Mc", "Me", "Cf"):
            cut += 1  # never between a letter and its marks
        return cut, "forced"

    cuts: list[tuple[int, str]] = []
    open_parts = [(0, len(text))]
    while open_parts:
        start, end = open_parts.pop()
        if end - start > (limit if start == 0 else room):
            cut, kind = choose(start, end)
            cuts.append((cut, kind))
            open_parts += [(start, cut), (cut, end)]
    return sorted(cuts)


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every item over its limit.

    items: rec_table, rec_id, text. limits: rec_table, max_chars,
    overlap_chars, a table of a few rows. Result: rec_table, rec_id, piece
    (from 0), start and end (half-open, in the item), text, cut (what the piece
    ends on; `end` for the last), n_pieces, fit (`forced` if the item has a run
    over the limit without white space or a terminator). Items within the
    limit, null and empty texts and tables without a limit give no rows; an
    item delivered twice counts once, by its rec_id and text.
    """
    known = limits.where("max_chars > 0").select("rec_table", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    over = items.select("rec_table", F.col("rec_id").cast("bigint"), "text").join(F.broadcast(known), "rec_table").where(F.char_length("text") > F.col("max_chars"))
    over = over.withColumn("h", F.xxhash64("text")).dropDuplicates(["rec_table", "rec_id", "h"])

    def pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
        for table, rec, text, limit, overlap in rows:
            cuts = cut_points(text, limit, overlap)
            fit = "forced" if longest_run(text) > limit else "natural"
            start = 0
            for i, (end, kind) in enumerate([*cuts, (len(text), "end")]):
                begin = max(0, start - overlap) if i else 0
                yield table, rec, i, begin, end, text[begin:end], kind, len(cuts) + 1, fit
                start = end

    schema = "rec_table string, rec_id bigint, piece int, start int, end int, text string, cut string, n_pieces int, fit string"
    return map_rows(over.select("rec_table", "rec_id", "text", F.col("max_chars").cast("int"), F.col("overlap_chars").cast("int")), schema, pieces)
