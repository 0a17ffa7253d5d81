"""A suffix automaton over any sequence of hashable symbols, and a stack automaton over brackets and quotes."""

from __future__ import annotations

import re
from collections.abc import Hashable, Iterable, Iterator, Sequence
from html.entities import html5


class SuffixAutomaton:
    """Recognises every substring of the sequences added; linear in their length."""

    def __init__(self, symbols: Iterable[Hashable] = ()) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        #: Where the first occurrence of a state's substrings ends.
        self.end = [-1]
        self.last = 0
        for symbol in symbols:
            self.add(symbol)

    def add(self, symbol: Hashable) -> None:
        """Append one symbol."""
        following, link, length, count = self.next, self.link, self.length, self.count
        new = len(following)
        following.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        count.append(1)
        self.end.append(length[new] - 1)
        at = self.last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if length[at] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(following)
                following.append(following[target].copy())
                length.append(length[at] + 1)
                link.append(link[target])
                count.append(0)
                self.end.append(self.end[target])
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        self.last = new

    def repeated_suffixes(self, symbols: Sequence[Hashable], least: int = 2) -> list[int]:
        """For each position of the one sequence added, the length of the longest substring ending there that occurs `least` times."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        total = self.count[:]
        for state in reversed(order):
            if self.link[state] > 0:
                total[self.link[state]] += total[state]
        longest = [0] * len(self.next)
        for state in order:
            longest[state] = self.length[state] if total[state] >= least else longest[self.link[state]]
        at, found = 0, []
        for symbol in symbols:
            at = self.next[at][symbol]
            found.append(longest[at])
        return found

    def matched_suffixes(self, symbols: Iterable[Hashable]) -> list[int]:
        """For each position of another sequence, the length of the longest substring ending there that was added."""
        return [size for size, _ in self.matches(symbols)]

    def matches(self, symbols: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """For each position of another sequence, the length of the longest substring ending there that was added, and where that ends first in what was added."""
        at = size = 0
        for symbol in symbols:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if symbol in self.next[at]:
                at = self.next[at][symbol]
                size += 1
            else:
                at = size = 0
            yield size, self.end[at]


def covered(suffixes: Sequence[int], least: int = 1) -> list[bool]:
    """Which positions lie in a substring whose length stands at its end in `suffixes` and is at least `least`."""
    marks = [False] * len(suffixes)
    reach = len(suffixes)
    for i in range(len(suffixes) - 1, -1, -1):
        if suffixes[i] >= least:
            reach = min(reach, i - suffixes[i] + 1)
        marks[i] = i >= reach
    return marks


# The pairs that open and close.
PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
_OPENING = frozenset(PAIRS.values())
_SIGNS = re.compile(r"[()\[\]{}«»„“”\"]")


class OpenSigns:
    """A stack automaton over the brackets and paired quotes of texts read one after the other.

    A closing sign without its opening one is ignored, so enumerators like
    "a)" leave the stack alone. Straight quotes pair up with themselves; one
    right behind a letter or digit only closes, as in inches. Low quotes are
    closed by either high one, and guillemets may point inwards.
    """

    def __init__(self) -> None:
        #: The open signs, outermost first, with the number of the text that opened each.
        self.stack: list[tuple[str, int]] = []
        self.unopened: list[str] = []

    def read(self, text: str, number: int = 0) -> None:
        """Carry the stack over one more text."""
        stack = self.stack
        for match in _SIGNS.finditer(text):
            c, at = match[0], match.start()
            if c == '"':
                if not self._close(c):
                    if at and text[at - 1].isalnum():
                        self.unopened.append(c)
                    else:
                        stack.append((c, number))
            elif c == "“" and self._close("„") or c == "”" and self._close("„"):
                pass
            elif c == "«" and "»" in self.unopened:
                self.unopened.remove("»")
            elif c in _OPENING or c == "„":
                stack.append((c, number))
            elif not self._close(PAIRS[c]):
                self.unopened.append(c)

    def _close(self, sign: str) -> bool:
        if all(s != sign for s, _ in self.stack):
            return False
        while self.stack.pop()[0] != sign:
            pass
        return True


def open_at_end(text: str) -> list[str]:
    """The brackets and paired quotes that a text opens and never closes, outermost first; see OpenSigns."""
    signs = OpenSigns()
    signs.read(text)
    return [sign for sign, _ in signs.stack]


# Elements that need no closing tag.
_SINGLE = frozenset("area base br col dd dt hr img input li link meta option p source td th tr wbr".split())
_TAGS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?(/?)>|(?<![*\w])\*\*(?=[^\s*])|(?<=[^\s*])\*\*(?!\*)|```")
_HALF_TAG = re.compile(r"<(?:/\w*|[a-zA-Z]\w+|[a-zA-Z]\w*\s+[\w-]+=[^<>]*)$")


def open_markup(text: str) -> bool:
    """True if a text ends inside a tag, an element, bold text or a code fence."""
    if "<" not in text and "**" not in text and "```" not in text:
        return False
    if _HALF_TAG.search(text):
        return True
    stack: list[str] = []
    for match in _TAGS.finditer(text):
        name = (match[2] or match[0]).lower()
        if match[3] or name in _SINGLE:
            continue
        if match[1] or (not match[2] and name in stack):
            if name in stack:
                while stack.pop() != name:
                    pass
        elif match[2] or not match.start() or not text[match.start() - 1].isalnum():
            stack.append(name)
    return bool(stack)


_ESCAPE = re.compile(r"(?:&#\w*|&([A-Za-z]?[a-z]+\d*)|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?)$")


def half_escape(text: str) -> bool:
    """True if a text ends on a backslash or within an escape or a character entity; "R&D" is none."""
    found = _ESCAPE.search(text)
    return bool(found) and (not found[1] or any(name.startswith(found[1]) and name != found[1] for name in html5))
