"""Patterns of the ECMAScript dialect, for Python's ``regex`` and for Java.

There ``\\b``, ``\\w`` and ``\\d`` are ASCII, ``\\s`` takes all Unicode white space,
and line anchors know four line ends.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import regex

WHITE = r"\t\n\x0b\f\r \xa0  -     　﻿"
WHITE_IN_LINE = WHITE.replace(r"\n", "", 1)
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
LINE_ENDS = r"\n\r  "


def _spell(pattern: str, multiline: bool) -> str:
    """The pattern with its classes, word edges and line anchors spelled out."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if pattern.startswith(r"[^\S\n]", at):
            out.append(f"[{WHITE_IN_LINE}]")
            at += 7
        elif pattern.startswith(r"[\s\S]", at):
            out.append(r"(?s:.)")
            at += 6
        elif two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
            at += 2
        elif two == r"\S":
            out.append(f"[^{WHITE}]")
            at += 2
        elif two == r"\b" and not inside:
            out.append(EDGE)
            at += 2
        elif two in (r"\w", r"\d"):
            own = "A-Za-z0-9_" if two == r"\w" else "0-9"
            out.append(own if inside else f"[{own}]")
            at += 2
        elif two[:1] == "\\":
            out.append(two)
            at += 2
        else:
            c = pattern[at]
            if c == "[" and not inside:
                inside = True
            elif c == "[":
                c = r"\["
            elif c == "]" and inside:
                inside = False
            elif not inside and multiline and c in "^$":
                c = rf"(?<![^{LINE_ENDS}])" if c == "^" else rf"(?![^{LINE_ENDS}])"
            elif not inside and c == "$":
                c = r"\Z"
            out.append(c)
            at += 1
    return "".join(out)


@cache
def compiled(pattern: str, flags: str = "") -> regex.Pattern:
    """For Python."""
    # Its own ASCII word edge lets the engine look for literals first.
    spelled = _spell(pattern, "m" in flags).replace(EDGE, r"(?a:\b)")
    return regex.compile(spelled, regex.V0 | (regex.IGNORECASE if "i" in flags else 0))


# Of the classes by property, what is ASCII.
_ASCII_CLASS = {"L": "A-Za-z", "Lu": "A-Z", "Ll": "a-z", "N": "0-9"}
_BEHIND = re.compile(r"\(\?<=\^\|\[((?:\\.|[^\\\]])*)\]\)")


@cache
def for_ascii(pattern: str, flags: str = "") -> re.Pattern | regex.Pattern:
    """The same matches in ASCII texts, by Python's own engine, which is faster there; ``compiled`` where it can't say the pattern."""
    # Behind the start or one of some characters is: not behind any other.
    plain = _BEHIND.sub(lambda m: f"(?<![^{m[1]}])", pattern)
    out, inside, at = [], False, 0
    while at < len(plain):
        if plain[at] == "\\":
            said = _ESCAPE.match(plain, at)[0]
            kind = _ASCII_CLASS.get(said[3:-1]) if said[:3] == r"\p{" else said
            if kind is None or said[:2] == r"\P":
                return compiled(pattern, flags)
            out.append(kind if kind is said or inside else f"[{kind}]")
            at += len(said)
            continue
        c = plain[at]
        if c == "[":
            c, inside = r"\[" if inside else c, True
        elif c == "]":
            inside = False
        elif not inside and "m" in flags and c in "^$":
            c = r"(?<![^\n\r])" if c == "^" else r"(?![^\n\r])"
        elif not inside and c == "$":
            c = r"\Z"
        out.append(c)
        at += 1
    try:
        return re.compile("".join(out), re.ASCII | (re.IGNORECASE if "i" in flags else 0))
    except re.error:
        return compiled(pattern, flags)


def for_java(pattern: str, flags: str = "") -> str:
    """For Spark's regular expression functions."""
    spelled = _spell(pattern, "m" in flags).replace(r"\Z", r"\z").replace(r"﻿", r"\x{feff}")
    return ("(?i)" if "i" in flags else "") + spelled


def needles(pattern: str) -> tuple[str, ...]:
    """Strings of which any match of a pattern of plain words and groups of them holds one.

    Of a sequence the longest word outside groups counts, or else each alternative of its
    first group.
    """
    # What may be missing holds nothing.
    plain = re.sub(r"\(\?:[^()]*\)\?|\w\?", " ", pattern.replace(r"\b", ""))
    flat, groups, depth = [], [], 0
    for i, c in enumerate(plain):
        depth += (c == "(") - (i > 0 and plain[i - 1] == ")")
        if depth == 0 and c != ")":
            flat.append(c)
        elif c == "(" and depth == 1:
            flat.append(" ? ")
            groups.append("")
        elif not (c == ")" and depth == 1) and depth:
            groups[-1] += c
    if "|" in flat or any(c in plain for c in "[]*+{}."):
        raise ValueError(f"no plain words: {pattern}")
    words = [w for w in "".join(flat).replace("?", " ? ").split() if w != "?"]
    best = max(words, key=len, default="")
    if len(best) >= 4 or not groups:
        return (best,)
    return tuple(max(a.replace("(", " ").replace("?", " ").split(), key=len) for a in groups[0].removeprefix("?:").split("|"))


# What matches an ASCII letter when case is ignored, besides its own two cases.
FOLDED = ("İıſ\u212a", "iisk")
_FOLDED = str.maketrans(*FOLDED)
_WIDEST = 64


def fold(text: str) -> str:
    """The text in lower case, with all that may match an ASCII letter as that letter."""
    return text.lower() if text.isascii() else text.translate(_FOLDED).lower()


def _class(inside: str) -> set[str] | None:
    """The characters of a class of a few plain ones; None for any other."""
    chars = {"\\t": "\t", "\\n": "\n", "\\r": "\r"}
    parts = re.findall(r"\\u[0-9a-f]{4}|\\.|.", inside, re.S)
    out = {chr(int(p[2:], 16)) if p[:2] == "\\u" else chars.get(p, p) for p in parts}
    fine = inside[:1] != "^" and "-" not in inside[1:] and all(len(c) == 1 for c in out) and len(out) <= 8
    return out if fine else None


def _closing(pattern: str, at: int) -> int:
    """Behind the bracket that closes the one at ``at``."""
    depth, inside = 0, False
    while True:
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        else:
            depth += (c == "(") - (c == ")")
        at += 1
        if not depth and not inside:
            return at


def _alternatives(pattern: str) -> list[str]:
    out, start, at = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            out.append(pattern[start:at])
            start = at = at + 1
        elif c in "([":
            at = _closing(pattern, at)
        else:
            at += 2 if c == "\\" else 1
    return [*out, pattern[start:]]


_QUANTIFIER = re.compile(r"([?*+]|\{(\d+)(,?)\d*\})\??")
_ESCAPE = re.compile(r"\\(?:u[0-9a-f]{4}|[pP]\{[^}]*\}|.)", re.S)


def _wholes(pattern: str) -> tuple[set[str] | None, set[str]]:
    """All strings that match, if these are few; and strings of which each match holds one, none if there are no such."""
    each = [_sequence(p) for p in _alternatives(pattern)]
    whole = set().union(*(w for w, _ in each)) if all(w is not None for w, _ in each) else None
    held = set().union(*(h for _, h in each)) if all(h for _, h in each) else set()
    return whole if whole is not None and len(whole) <= _WIDEST else None, held


def _sequence(pattern: str) -> tuple[set[str] | None, set[str]]:
    run: set[str] = {""}
    found: list[set[str]] = []
    at, unbroken = 0, True
    while at < len(pattern):
        c, inner = pattern[at], set()
        if c in "^$" or pattern.startswith(r"\b", at):
            at += 1 if c in "^$" else 2
            continue
        if c == "(":
            end = _closing(pattern, at)
            body = pattern[at + 1 : end - 1]
            if body.startswith(("?=", "?!", "?<")):
                at = end
                continue
            whole, inner = _wholes(body.removeprefix("?:"))
        elif c == "[":
            end = _closing(pattern, at)
            whole = _class(pattern[at + 1 : end - 1])
        elif c == "\\":
            said = _ESCAPE.match(pattern, at)
            end, name = said.end(), said[0][1:]
            plain = {"n": "\n", "t": "\t"}.get(name, None if name[0].isalnum() else name)
            whole = {chr(int(name[1:], 16))} if name[0] == "u" and len(name) == 5 else None if plain is None else {plain}
        else:
            end, whole = at + 1, None if c == "." else {c.lower()}
        least, goes_on = 1, False
        if m := _QUANTIFIER.match(pattern, end):
            least = {"?": 0, "*": 0, "+": 1}[m[1]] if m[2] is None else int(m[2])
            goes_on = m[2] is None or m[3] == ","
            end = m.end()
        at = end
        if whole is not None and m and m[1] == "?" and 2 * len(run) * len(whole) <= _WIDEST:
            run = {a + b for a in run for b in whole | {""}}
            continue
        if whole is not None and least:
            for _ in range(least):
                if len(run) * len(whole) > _WIDEST:
                    found.append(run)
                    run, unbroken = {""}, False
                run = {a + b for a in run for b in whole}
        elif least:
            found.append(inner)
        if whole is None or goes_on:
            found.append(run)
            # What comes next stands behind the last of the repeated ones.
            run, unbroken = (whole if whole and least else {""}), False
    found.append(run)
    # The longer the strings, the rarer; of equal ones the fewer.
    good = [f for f in found if f and "" not in f]
    best = max(good, key=lambda f: (min(4, min(map(len, f))), -len(f)), default=set())
    return run if unbroken else None, best


class Opening(NamedTuple):
    """What a match begins with: whole words, words that lead one, a digit, or blanks behind a word and then one of these."""

    words: frozenset[str]
    leads: frozenset[str]
    digit: bool
    blanks: bool

    def __or__(self, other: Opening) -> Opening:
        return Opening(self.words | other.words, self.leads | other.leads, self.digit or other.digit, self.blanks or other.blanks)


_NOTHING = Opening(frozenset(), frozenset(), False, False)
_WORDS_ONLY = re.compile(r"\\b(?:\w|\[[\w-]+\]|\\p\{L[ul]\}|\((?:\?:)?|[)?+*]|\{\d+,?\d*\})+\\b")
_PLAIN = re.compile(r"[A-Za-z0-9]+")
_BLANK_CLASS = re.compile(r"\\s|\[\^\\S\\n\]|[ ',:;-]")


def _body(pattern: str, at: int) -> tuple[str, int] | None:
    """The alternatives of the plain group at ``at``, and where it ends."""
    if pattern[at] != "(" or pattern.startswith("(?", at) and not pattern.startswith("(?:", at):
        return None
    end = _closing(pattern, at)
    return pattern[at + 1 : end - 1].removeprefix("?:"), end


def _ends_word(pattern: str, at: int, behind: bool) -> bool:
    """Whether what follows at ``at`` is no word character; ``behind`` says so of what follows the pattern."""
    while at < len(pattern):
        if pattern.startswith(r"\b", at):
            return True
        if m := _BLANK_CLASS.match(pattern, at):
            end, fine = m.end(), True
        elif group := _body(pattern, at):
            body, end = group
            fine = all(_ends_word(one, 0, False) for one in _alternatives(body))
        else:
            return False
        quantifier = _QUANTIFIER.match(pattern, end)
        if not fine or quantifier is None or quantifier[0][0] == "+":
            return fine
        if quantifier[0][0] == "{":
            return False
        at = quantifier.end()
    return behind


def _opened(pattern: str, behind: bool = False) -> Opening | None:
    """What a pattern without its edge begins with; None if that may be something else."""
    found, at = _NOTHING, 0
    while at < len(pattern):
        if m := _PLAIN.match(pattern, at):
            quantifier = _QUANTIFIER.match(pattern, m.end())
            if quantifier is None:
                word = frozenset((m[0].lower(),))
                return found | (Opening(word, *_NOTHING[1:]) if _ends_word(pattern, m.end(), behind) else _NOTHING._replace(leads=word))
            word = m[0][:-1].lower()
            if word or quantifier[0][0] == "+":
                return found | _NOTHING._replace(leads=frozenset((word or m[0].lower(),)))
            if quantifier[0][0] == "{":
                return None
            found |= _NOTHING._replace(leads=frozenset((m[0].lower(),)))
            at = quantifier.end()
            continue
        if pattern.startswith(r"\d", at):
            quantifier = _QUANTIFIER.match(pattern, at + 2)
            needed = quantifier is None or quantifier[0][0] in "+{" and not quantifier[0].startswith("{0")
            return found._replace(digit=True) if needed else None
        if (group := _body(pattern, at)) is None:
            return None
        body, end = group
        quantifier = _QUANTIFIER.match(pattern, end)
        closed = quantifier is None and _ends_word(pattern, end, behind)
        for one in _alternatives(body):
            if (inner := _opened(one, closed)) is None:
                return None
            found |= inner
        if quantifier is None or quantifier[0][0] == "+":
            return found
        if quantifier[0][0] != "?":
            return None
        at = quantifier.end()
        if pattern.startswith(r"\s*", at):
            at, found = at + 3, found._replace(blanks=True)
    return None


@cache
def opening(pattern: str) -> Opening | None:
    """How all matches of a pattern begin in an ASCII text, at an edge of a word; None if words and digits don't tell."""
    out = _NOTHING
    for one in _alternatives(pattern):
        edge = 2 if one.startswith(r"\b") else 1 if one.startswith("^") else 0
        found = _opened(one[edge:]) if edge else None
        # Behind the start of a line there is an edge only if a word begins there.
        if found is None or edge == 1 and found.blanks:
            return None
        out |= found
    return None if any(w[0].isdigit() for w in out.words | out.leads) else out


@cache
def rest(pattern: str, flags: str = "") -> re.Pattern | None:
    """What no match in an ASCII text goes without, of a pattern that begins with repeated characters; None for any other."""
    if "m" in flags and (m := re.fullmatch(r"(\[[^\]\\^]*(?:\\t)?\])\+\$", pattern)):
        return re.compile(rf"{m[1]}(?:[\n\r]|\Z)")
    m = re.match(r"(?:\\b)?\[(?:\\.|[^\]\\])+\]\+(?![?+])(?=[\\@])", pattern)
    found = for_ascii(pattern[m.end() :], flags) if m and len(_alternatives(pattern)) == 1 else None
    return found if isinstance(found, re.Pattern) else None


def of_words_only(pattern: str) -> bool:
    """Whether any match in an ASCII text is one whole run of word characters."""
    return _WORDS_ONLY.fullmatch(pattern) is not None


@cache
def held(pattern: str) -> tuple[str, ...]:
    """Strings of which the folded text of any match of ``pattern`` holds one; none where the pattern tells of no such strings."""
    some = {fold(h) for h in _wholes(pattern)[1]}
    return tuple(sorted(h for h in some if not any(o != h and o in h for o in some)))


def may_match(pattern: str, folded: str) -> bool:
    """Whether a text, folded, holds what any match of the pattern holds."""
    some = held(pattern)
    if not some:
        return True
    for h in some:
        if h in folded:
            return True
    return False
