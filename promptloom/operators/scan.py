"""Protected regions, segments and sentences of one prompt.

All offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

from ..functions import patterns
from ..functions.dialect import WHITE, compiled, fold, for_ascii, held, may_match

# Which kind wins where regions overlap. Fixed values.
KINDS = ("code-fence", "example", "table", "json", "inline-code", "url", "email", "variable", "quoted-string")
RANK = {kind: i for i, kind in enumerate(KINDS)}
LINE = {label: compiled(p, f) for label, p, f in patterns.LINES}
LABEL = next(p for label, p, _ in patterns.LINES if label == "example label")
BLANK = "".join(chr(c) for c in range(0x3001) if compiled(rf"[{WHITE}]").fullmatch(chr(c))) + "﻿"
ASCII_BLANK = "".join(c for c in BLANK if c.isascii())


class Region(NamedTuple):
    start: int
    end: int
    kind: str


class Span(NamedTuple):
    text: str
    start: int
    end: int


class Cover:
    """Disjoint intervals, asked for overlaps by bisection."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.spans = sorted(spans)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.spans, (end, -1))
        return at > 0 and self.spans[at - 1][1] > start and self.spans[at - 1][0] < end

    def holds(self, point: int) -> bool:
        return self.meets(point, point + 1)


class Holders:
    """Intervals, which may overlap, asked whether one of them holds a span."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts, self.furthest = [], []
        for start, end in sorted(spans):
            self.starts.append(start)
            self.furthest.append(max(end, self.furthest[-1]) if self.furthest else end)

    def hold(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.furthest[at - 1] >= end


def open_text(text: str, found: list[Region]) -> str:
    """What no region protects, folded. A match outside the regions lies in it, and so does all that the match holds."""
    if not found:
        return fold(text)
    parts, at = [], 0
    for region in found:
        parts.append(text[at : region.start])
        at = region.end
    return fold("\0".join([*parts, text[at:]]))


def lines(text: str) -> list[Span]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append(Span(line, at, at + len(line)))
        at += len(line) + 1
    return out


def _fences(text: str, rows: list[Span]) -> list[Region]:
    out: list[Region] = []
    if "```" not in text and "~~~" not in text:
        return out
    opened: tuple[str, int] | None = None
    for row in rows:
        mark = LINE["fence"].match(row.text)
        if mark is None:
            continue
        if opened is None:
            opened = mark[1], row.start
        elif mark[1].startswith(opened[0]):
            out.append(Region(opened[1], row.end, "code-fence"))
            opened = None
    if opened is not None:
        out.append(Region(opened[1], len(text), "code-fence"))
    return out


def _examples(text: str, rows: list[Span]) -> list[Region]:
    out = [Region(m.start(), m.end(), "example") for m in LINE["example tag"].finditer(text)] if "<" in text else []
    if not may_match(LABEL, fold(text)) or not any(LINE["example label"].match(row.text) for row in rows if ":" in row.text or "：" in row.text):
        return out
    start = end = None
    waiting = False
    for row in rows:
        label, blank = bool(LINE["example label"].match(row.text)), not row.text.strip(BLANK)
        if start is not None and waiting and not blank and not label:
            out.append(Region(start, end, "example"))
            start, waiting = None, False
        if start is None:
            if label:
                start, end, waiting = row.start, row.end, False
        elif blank:
            waiting = True
        else:
            end, waiting = row.end, False
    if start is not None:
        out.append(Region(start, end, "example"))
    return out


def _tables(rows: list[Span]) -> list[Region]:
    """Runs of rows with a pipe that hold a rule under a piped row."""
    piped = ["|" in r.text for r in rows]
    out, done = [], 0
    for i in range(1, len(rows)):
        if i < done or not piped[i - 1] or not LINE["table rule"].match(rows[i].text):
            continue
        first, last = i - 1, i
        while first and piped[first - 1]:
            first -= 1
        while last + 1 < len(rows) and piped[last + 1]:
            last += 1
        out.append(Region(rows[first].start, rows[last].end, "table"))
        done = last + 1
    return out


# Brackets behind which a value may go on.
OPENS = re.compile(r'\{(?=[ \t\n\r]*["}])|\[(?=[ \t\n\r]*[\[\]{"tfn0-9-])')
BLANKS = re.compile(r"[ \t\n\r]*")
ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
IN_STRING = re.compile(r'["\\\x00-\x1f]')
ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})')
CLOSES = {"[": "]", "{": "}"}


class _Json:
    """Ends of the JSON values in a text. Each bracket and each escape is looked at once, whether it leads anywhere or not."""

    def __init__(self, text: str):
        self.text = text
        # Of brackets and backslashes: where the value or string that goes on there ends; 0 if it doesn't.
        self.values: dict[int, int] = {}
        self.escapes: dict[int, int] = {}

    def string_end(self, at: int) -> int:
        """Where the string that has begun before ``at`` ends; 0 if it doesn't."""
        met, end = [], 0
        while m := IN_STRING.search(self.text, at):
            if m[0] == '"':
                end = m.end()
                break
            if m[0] != "\\":
                break
            if m.start() in self.escapes:
                end = self.escapes[m.start()]
                break
            met.append(m.start())
            if (escape := ESCAPE.match(self.text, m.start())) is None:
                break
            at = escape.end()
        self.escapes.update(dict.fromkeys(met, end))
        return end

    def value_end(self, start: int) -> int:
        """Where the array or object at ``start`` ends; 0 if there is none."""
        text, done = self.text, self.values
        # Open brackets, and for each whether it has a member yet.
        stack: list[int] = [start]
        filled = [False]
        at = start + 1

        def past_blanks(at: int) -> int:
            return BLANKS.match(text, at).end() if text[at : at + 1].isspace() else at

        while stack:
            kind, at = text[stack[-1]], past_blanks(at)
            mark = text[at : at + 1]
            if mark == CLOSES[kind]:
                done[stack.pop()] = at = at + 1
                filled.pop()
                if filled:
                    filled[-1] = True
                continue
            if filled[-1]:
                if mark != ",":
                    break
                at = past_blanks(at + 1)
            if kind == "{":
                if text[at : at + 1] != '"' or not (at := self.string_end(at + 1)):
                    break
                at = past_blanks(at)
                if text[at : at + 1] != ":":
                    break
                at = past_blanks(at + 1)
            mark = text[at : at + 1]
            if mark == '"':
                at = self.string_end(at + 1)
            elif mark in CLOSES:
                if at not in done:
                    stack.append(at)
                    filled.append(False)
                    at += 1
                    continue
                at = done[at]
            else:
                m = ATOM.match(text, at)
                at = m.end() if m else 0
            if not at:
                break
            filled[-1] = True
        # What is still open leads nowhere, from whichever bracket one starts.
        done.update(dict.fromkeys(stack, 0))
        return done[start]


def _json(text: str) -> list[Region]:
    found, out, at = None, [], 0
    while m := OPENS.search(text, at):
        start = m.start()
        found = _Json(text) if found is None else found
        end = found.values[start] if start in found.values else found.value_end(start)
        at = start + 1
        if end - start >= 4:
            out.append(Region(start, end, "json"))
            at = end
    return out


URL_TAIL = ".,;:!?)]"
SIMPLE = [(kind, held(p), compiled(p, f), for_ascii(p, f)) for kind, p, f in patterns.REGIONS]
# So many regions are compared one by one.
FEW = 12


def regions(text: str) -> list[Region]:
    """The accepted regions, by start."""
    return list(_regions(text))


# One prompt's regions are asked for more than once, by its inventory, its sentences and its rewrites.
@lru_cache(maxsize=4)
def _regions(text: str) -> tuple[Region, ...]:
    folded, ascii_only, found = fold(text), text.isascii(), []
    labelled = ":" in text and may_match(LABEL, folded) or "：" in text
    if labelled or "|" in text or "<" in text or "```" in text or "~~~" in text:
        rows = lines(text)
        found += _fences(text, rows) + _examples(text, rows) + (_tables(rows) if "|" in text else [])
    if "{" in text or "[" in text:
        found += _json(text)
    for kind, needles, wide, narrow in SIMPLE:
        for needle in needles:
            if needle in folded:
                break
        else:
            if needles:
                continue
        for m in (narrow if ascii_only else wide).finditer(text):
            start, end = m.span()
            if kind == "url":
                end = start + len(m[0].rstrip(URL_TAIL))
            if end > start:
                found.append(Region(start, end, kind))
    return tuple(_accepted(found))


def _accepted(found: list[Region]) -> list[Region]:
    """Those that meet none of an earlier kind, and none of their own that begins before them or is longer."""
    if len(found) < 2:
        return found
    out: list[Region] = []
    if len(found) <= FEW:
        for region in sorted(found, key=lambda r: (RANK[r[2]], r[0], -r[1])):
            start, end, _ = region
            for taken in out:
                if taken[0] < end and start < taken[1]:
                    break
            else:
                out.append(region)
        return sorted(out)
    by_kind: dict[str, list[Region]] = {}
    for region in found:
        by_kind.setdefault(region.kind, []).append(region)
    for kind in KINDS:
        if kind not in by_kind:
            continue
        # Against earlier kinds by bisection, and against its own by the last one's end.
        taken, last = Cover([r[:2] for r in out]), 0
        for region in sorted(by_kind.get(kind, ()), key=lambda r: (r.start, -r.end)):
            if region.start >= last and not taken.meets(region.start, region.end):
                out.append(region)
                last = region.end
    return sorted(out)


def segments(text: str, found: list[Region] | None = None) -> list[tuple[str, str | None, int, int]]:
    """(text, kind or None, start, end) pieces that join to ``text``."""
    out, at = [], 0
    for region in regions(text) if found is None else found:
        if region.start > at:
            out.append((text[at : region.start], None, at, region.start))
        out.append((text[region.start : region.end], region.kind, region.start, region.end))
        at = region.end
    if at < len(text):
        out.append((text[at:], None, at, len(text)))
    return out


END, ASCII_END = compiled(patterns.SENTENCE_END), for_ascii(patterns.SENTENCE_END)
# Words before a full stop that don't end a sentence. Fixed values.
SHORT = frozenset("e.g i.e etc vs no fig approx cf al".split())
LONGEST_SHORT = max(map(len, SHORT))
SHORT_ENDS = tuple(s + dot for s in SHORT for dot in ("", "."))
LIST_NUMBER = compiled(r"\s*\d+")
ASCII_NUMBER = for_ascii(r"\s*\d+")
LETTER = compiled(r"\p{L}")


def _is_short(line: str, at: int, number_end: int) -> bool:
    """Whether the stop at ``at`` ends no sentence: after a list number or a short form, of which only so many characters matter."""
    if line[at] != ".":
        return False
    if at == number_end:
        return True
    if not line[max(0, at - LONGEST_SHORT - 2) : at].lower().endswith(SHORT_ENDS):
        return False
    start, least = at, max(0, at - LONGEST_SHORT - 2)
    while start > least and ((c := line[start - 1]) == "." or (c.isalpha() if c.isascii() else LETTER.match(c))):
        start -= 1
    return line[start:at].lower().removesuffix(".") in SHORT


def sentences(text: str, found: list[Region] | None = None, cover: Cover | None = None) -> list[Span]:
    """The pieces that rows and stops outside regions make; ``cover`` is that of the regions, for callers that have it."""
    blank, ends, numbers = (ASCII_BLANK, ASCII_END, ASCII_NUMBER) if text.isascii() else (BLANK, END, LIST_NUMBER)
    out, begin = [], 0
    for row in text.split("\n"):
        at = 0
        # A row that holds no stop is one piece.
        if "." in row or "!" in row or "?" in row:
            number_end = -1
            for i, m in enumerate(ends.finditer(row)):
                if not i:
                    number = numbers.match(row)
                    number_end = number.end() if number else -1
                c = m.start()
                if cover is None:
                    cover = Cover([r[:2] for r in (regions(text) if found is None else found)])
                if cover.holds(begin + c) or _is_short(row, c, number_end):
                    continue
                _add_sentence(out, row[at : c + 1], begin + at, blank)
                at = c + 1
        _add_sentence(out, row[at:] if at else row, begin + at, blank)
        begin += len(row) + 1
    return out


def _add_sentence(out: list[Span], piece: str, start: int, blank: str) -> None:
    if core := piece.strip(blank):
        if piece[0] != core[0]:
            start += len(piece) - len(piece.lstrip(blank))
        out.append(Span(core, start, start + len(core)))


def starts(all_of: list[Span]) -> list[int]:
    return [s.start for s in all_of]


def sentence_at(all_of: list[Span], point: int, begins: list[int] | None = None) -> Span | None:
    """The sentence at an offset; ``begins`` are the ``starts``, for callers that ask more than once."""
    at = bisect_right(starts(all_of) if begins is None else begins, point) - 1
    return all_of[at] if at >= 0 and point < all_of[at].end else None


SEPARATOR = re.compile(r"(?m)^[ \t\r\f]*---[ \t\r\f]*$")


def batch(text: str) -> list[str]:
    """The prompts that lines of three dashes separate, trimmed, empty ones dropped."""
    return [p for p in (part.strip(" \t\n\x0b\f\r") for part in SEPARATOR.split(text.replace("\r\n", "\n"))) if p]
