"""Where patterns may match in an ASCII text, told by its words in one pass.

Most patterns begin with one of a few words or with a number, and most hold one of a few
strings. So the runs of word characters say which patterns are to be tried, and where, and
nothing is tried anywhere else. What a run tells doesn't depend on the text, so it is worked
out once for a run that comes again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache, lru_cache
from itertools import accumulate, islice

from ..functions import patterns
from ..functions.dialect import compiled, for_ascii, held, may_match, of_words_only, opening, rest
from .rules import RULES

RUN = re.compile(r"[A-Za-z0-9_]+")
# Cuts a text into what is between runs and, at odd places, the runs.
APART = re.compile(r"([A-Za-z0-9_]+)")
LETTERS = re.compile(r"[a-z]+")
# Runs whose answer is kept, and their greatest length.
KEPT, LONGEST = 1 << 16, 32


class Kept(dict):
    """What a function tells of runs that begin with no digit, for as many as ``KEPT``."""

    def __init__(self, function: Callable[[str], object], number: object):
        super().__init__()
        self.function, self.number = function, number

    def __missing__(self, run: str):
        # Numbers seldom come again, and all tell the same.
        if run[0] <= "9":
            return self.number
        told = self.function(run)
        if len(run) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[run] = told
        return told


# What runs tell that begin with a digit.
NUMBER = ("number",)


class Sought:
    """A pattern to be sought in texts of any kind, and what words tell of it."""

    def __init__(self, source: str, flags: str):
        self.source, self.flags = source, flags
        self.wide, self.narrow = compiled(source, flags), for_ascii(source, flags)
        self.opening = opening(source)
        self.words_only = self.opening is None and of_words_only(source)
        # Whether words can tell where all matches begin, and whether ``WORDS`` does.
        self.placed = self.opening is not None or self.words_only
        self.by_words = False
        self.number = self.opening is not None and self.opening.digit
        self.blanks = self.opening is not None and self.opening.blanks
        self.held = held(source)
        self.rest = None if self.placed else rest(source, flags)
        # Of each string that matches hold, its letters that are one run's; none if some string has none.
        runs = [max(LETTERS.findall(h), key=len, default="") for h in self.held]
        self.needed = tuple(dict.fromkeys(runs)) if runs and all(len(r) > 1 for r in runs) else ()


@cache
def sought(source: str, flags: str = "") -> Sought:
    return Sought(source, flags)


class Words:
    """What the words of a text tell of some patterns."""

    def __init__(self, given: Iterable[Sought]):
        self.words: dict[str, list[Sought]] = {}
        self.leads: dict[str, list[Sought]] = {}
        self.needed: dict[str, list[tuple[str, Sought]]] = {}
        self.only: list[Sought] = []
        for one in given:
            if one.opening is not None:
                for words, by in ((one.opening.words, self.words), (one.opening.leads, self.leads)):
                    for w in words:
                        by.setdefault(w, []).append(one)
            elif one.words_only:
                self.only.append(one)
            for letters in one.needed:
                self.needed.setdefault(letters[:2], []).append((letters, one))
        self.lengths = sorted({len(w) for w in self.leads})
        self.kept = Kept(self.told, NUMBER)

    def told(self, run: str) -> tuple:
        """The patterns that may begin where a run does, and those of which it may hold what they need; an empty tuple for neither."""
        low = run.lower()
        begun = dict.fromkeys(self.words.get(low, ()))
        for n in self.lengths:
            begun.update(dict.fromkeys(self.leads.get(low[:n], ()) if n <= len(low) else ()))
        begun.update(dict.fromkeys(one for one in self.only if one.narrow.match(run)))
        possible = {one for i in range(len(low) - 1) for letters, one in self.needed.get(low[i : i + 2], ()) if low.startswith(letters, i)}
        return (tuple(begun), tuple(possible)) if begun or possible else ()

    def of(self, text: str) -> Told:
        words, numbers, possible = {}, [], set()
        parts = APART.split(text)
        runs = parts[1::2]
        for told, start, run in zip(map(self.kept.__getitem__, runs), islice(accumulate(map(len, parts)), 0, None, 2), runs):
            if not told:
                continue
            if told is NUMBER:
                numbers.append(start)
                if not run.isdigit() and (told := self.told(run)):
                    possible.update(told[1])
                continue
            for one in told[0]:
                if one in words:
                    words[one].append(start)
                else:
                    words[one] = [start]
            if told[1]:
                possible.update(told[1])
        return Told(text, words, numbers, possible)


class Told:
    """What the words of one text tell: places by pattern, places of numbers, and patterns whose needed words are there."""

    def __init__(self, text: str, words: dict[Sought, list[int]], numbers: list[int], possible: set[Sought]):
        self.text, self.words, self.numbers, self.possible = text, words, numbers, possible

    def may(self, one: Sought) -> bool:
        """Whether a pattern may match, as far as words tell where."""
        return not one.by_words or one in self.words or one.number and bool(self.numbers)

    def matches(self, one: Sought, free: str) -> Iterable[re.Match]:
        """All matches, in order, as ``finditer`` gives them; none if ``free``, what no region protects, folded, holds nothing that those outside the regions do."""
        places = self.words.get(one)
        if one.placed and not places and not (one.number and self.numbers):
            return ()
        if one.needed:
            # Words of regions are among the possible ones; numbers are too many to be tried for these.
            if one not in self.possible or one.number and not may_match(one.source, free):
                return ()
        elif one.held and not may_match(one.source, free):
            return ()
        if not one.placed:
            return one.narrow.finditer(self.text) if one.rest is None or one.rest.search(self.text) else ()
        if one.number and self.numbers:
            places = sorted(places + self.numbers) if places else self.numbers
        if one.blanks:
            places = self._with_blanks(places)
        out, end, match, text = [], 0, one.narrow.match, self.text
        for place in places:
            if place >= end and (m := match(text, place)):
                out.append(m)
                end = m.end()
        return out

    def _with_blanks(self, places: list[int]) -> list[int]:
        """The places of runs, and those of the blanks before them."""
        out, text = [], self.text
        for place in places:
            at = place
            while at and text[at - 1] in " \t\n\r\x0b\x0c":
                at -= 1
            if at < place:
                out.append(at)
            out.append(place)
        return out


FORMATS, QUANTITIES, ENTITIES = ([(label, sought(p, f)) for label, p, f in group] for group in (patterns.FORMATS, patterns.QUANTITIES, patterns.ENTITIES))
MARKS = {label: sought(p, f) for label, p, f in patterns.MARKERS[:3]}
FILLERS = [sought(p, f + "i") for _, p, f in patterns.FILLERS]
KNOWN = frozenset((*(one for _, one in (*FORMATS, *QUANTITIES, *ENTITIES)), *MARKS.values(), *FILLERS, *(sought(r[3], r[4]) for r in RULES)))
WORDS = Words(KNOWN)
for _one in KNOWN:
    _one.by_words = _one.placed


@lru_cache(maxsize=4)
def told(text: str) -> Told | None:
    """For all patterns of the inventory and the rules, each of which asks for the same prompt; None for texts that aren't ASCII."""
    return WORDS.of(text) if text.isascii() else None


def matches(text: str, one: Sought, free: str) -> Iterable:
    """All matches of a pattern, but none if none of them is outside the regions, as ``free``, which is folded, tells."""
    if one in KNOWN and (by_words := told(text)) is not None:
        return by_words.matches(one, free)
    if not may_match(one.source, free):
        return ()
    return (one.narrow if text.isascii() else one.wide).finditer(text)
