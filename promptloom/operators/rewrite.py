"""Rule-based rewriting with offsets that can be undone."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from ..functions.dialect import compiled
from .rules import RULES
from .scan import Cover, Region, open_text, regions
from .words import Sought, matches, sought, told

LEVELS = ("light", "balanced", "aggressive")


@dataclass(frozen=True)
class Rule:
    id: str
    level: str
    lossy: bool
    pattern: str
    flags: str
    replacement: str | Callable[..., str]


def _stem(spec: str) -> Callable[..., str]:
    """``use:e|es|ed|ing``: the new stem without its own e, then the ending that matched."""
    word, _, _ = spec.partition(":")
    return lambda m: word.removesuffix("e") + m[1].lower()


SHIPPED = tuple(Rule(*r[:5], _stem(r[5]) if r[5].startswith("use:") else r[5]) for r in RULES)


@dataclass(frozen=True)
class Change:
    rule_id: str
    start: int
    end: int
    original: str
    replacement: str
    lossy: bool
    capitalised: bool | None = None
    constraint_ids: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.rule_id}:{self.start}:{self.end}"


def rules_for(level: str, rules: Iterable[Rule] = SHIPPED) -> list[Rule]:
    if rules is SHIPPED and level in _SHIPPED_FOR:
        return _SHIPPED_FOR[level]
    return [r for r in rules if LEVELS.index(r.level) <= LEVELS.index(level)]


_SHIPPED_FOR: dict[str, list[Rule]] = {}
_SHIPPED_FOR.update({level: rules_for(level) for level in LEVELS})


def _filled(rule: Rule, m) -> str:
    if callable(rule.replacement):
        return rule.replacement(m)
    parts = compiled(r"\$(\$|&|\d)").split(rule.replacement)
    names = {"$": "$", "&": m[0]}
    return "".join(p if i % 2 == 0 else names[p] if p in names else m[int(p)] or "" for i, p in enumerate(parts))


Placed = list[tuple[int, Rule, Sought]]
# Of rule sets in use, by identity, since rules are slow to compare; each with the set itself, which keeps it from going.
_ORDERED: dict[tuple[int, str], tuple[tuple[Rule, ...], Placed]] = {}


def _ordered(rules: Iterable[Rule], level: str) -> Placed:
    """The rules of a level with their places in the order and their patterns."""
    known = _ORDERED.get((id(rules), level))
    if known is not None and known[0] is rules:
        return known[1]
    made = [(i, r, sought(r.pattern, r.flags)) for i, r in enumerate(rules_for(level, rules))]
    if isinstance(rules, tuple):
        if len(_ORDERED) > 64:
            _ORDERED.clear()
        _ORDERED[id(rules), level] = rules, made
    return made


def select(text: str, level: str, found: list[Region], rules: Iterable[Rule] = SHIPPED, disabled: Iterable[str] = ()) -> list[Change]:
    """The changes that win: by start, then by rule, then the longest; matched on the whole original text."""
    off, cover, free = set(disabled), Cover([r[:2] for r in found]), open_text(text, found)
    hits: list[tuple[int, int, int, Change]] = []
    by_words = told(text)
    for order, rule, one in _ordered(rules, level):
        if rule.id in off or by_words is not None and not by_words.may(one):
            continue
        for m in matches(text, one, free):
            if m.end() > m.start() and not cover.meets(m.start(), m.end()) and (new := _filled(rule, m)) != m[0]:
                hits.append((m.start(), order, -m.end(), Change(rule.id, m.start(), m.end(), m[0], new, rule.lossy)))
    kept: list[Change] = []
    for start, _, _, change in sorted(hits, key=lambda h: h[:3]):
        if not kept or start >= kept[-1].end:
            kept.append(change)
    return kept


OPENING = compiled(r"(?:^|[\n.!?]|(?:^|\n)[ \t]*(?:[-*+]|\d+\)))[ \t]*$")
LETTER = compiled(r"\p{L}")
UPPER, LOWER = compiled(r"\p{Lu}"), compiled(r"\p{Ll}")


def _opens_sentence(text: str, at: int) -> bool:
    """Whether a sentence, list item or line begins at ``at``."""
    stop = at
    while stop and text[stop - 1] in " \t":
        stop -= 1
    if not stop or text[stop - 1] in "\n.!?":
        return True
    return bool(OPENING.search(text[text.rfind("\n", 0, at) + 1 : at]))


def capitalise(text: str, changes: list[Change], found: list[Region]) -> list[Change]:
    """Changes that took a sentence's capital give it to what follows."""
    cover, out, owed = Cover([r[:2] for r in found]), [], False
    for i, c in enumerate(changes):
        due = owed or (_opens_sentence(text, c.start) and UPPER.match(c.original) is not None)
        owed = False
        after = changes[i + 1].start if i + 1 < len(changes) else None
        if due and (m := LETTER.search(c.replacement)):
            if m[0].upper() != m[0] and m[0].lower() == m[0]:
                new = c.replacement[: m.start()] + m[0].upper() + c.replacement[m.end() :]
                c = replace(c, replacement=new, capitalised=True)
        elif due and not c.replacement.strip():
            following = text[c.end : c.end + 1]
            if after == c.end:
                owed = True
            elif LOWER.match(following) and not cover.holds(c.end) and (after is None or after > c.end):
                c = replace(
                    c,
                    end=c.end + 1,
                    original=c.original + following,
                    replacement=c.replacement + following.upper(),
                    capitalised=True,
                )
        out.append(c)
    return out


def apply(text: str, changes: Iterable[Change]) -> str:
    parts, at = [], 0
    for c in sorted(changes, key=lambda c: c.start):
        if c.start >= at:
            parts += [text[at : c.start], c.replacement]
            at = c.end
    return "".join([*parts, text[at:]])


def without(text: str, changes: Iterable[Change], disabled: Iterable[str]) -> str:
    """The output with the changes of some keys undone."""
    off = set(disabled)
    return apply(text, [c for c in changes if c.key not in off])


@dataclass
class Rewritten:
    output: str
    changes: list[Change]
    blocked: list[Change]
    constraints: list | None
    checks: list | None
    regions: list[Region]
    # Rounds in which the ledger took changes back.
    rounds: int = 0


ROUNDS = 5


def _overlapping(changes: list[Change], begins: list[int], start: int, end: int) -> list[Change]:
    """Of changes that are apart and in order, those that share a character with a stretch."""
    first = bisect_right(begins, start) - 1
    first = first if first >= 0 and changes[first].end > start else first + 1
    return changes[first : bisect_left(begins, end)] if start < end else []


def _blamed(changes: list[Change], lost: list) -> dict[Change, list[str]]:
    """The changes in each lost constraint's anchor, or else in its sentence, with the constraints' ids."""
    begins, blame = [c.start for c in changes], {}
    for c in lost:
        near = _overlapping(changes, begins, c.start, c.end) or _overlapping(changes, begins, c.sentence_start, c.sentence_end)
        for x in near:
            blame.setdefault(x, []).append(c.id)
    return blame


def rewrite(
    text: str,
    level: str,
    rules: Iterable[Rule] = SHIPPED,
    disabled: Iterable[str] = (),
    enforce: bool | None = None,
    constraints: list | None = None,
    found: list[Region] | None = None,
    ledger=None,
) -> Rewritten:
    """Rewrite one prompt; with ``enforce`` (by itself at aggressive), changes that lose a critical constraint go.

    ``found`` are its regions and ``ledger`` its constraints' ``Ledger``, for callers that
    rewrite it more than once.
    """
    from .ledger import Ledger, extract

    found = regions(text) if found is None else found
    kept = select(text, level, found, rules, disabled)
    if not (level == "aggressive" if enforce is None else enforce):
        changes = capitalise(text, kept, found)
        return Rewritten(apply(text, changes), changes, [], None, None, found)
    if ledger is None:
        ledger = Ledger(text, extract(text, found) if constraints is None else constraints)
    # The prompt's own tokens and the index of its anchors serve all rounds.
    inventory, kept_by = ledger.constraints, ledger
    blocked: list[Change] = []
    rounds = 0
    while True:
        changes = capitalise(text, kept, found)
        output = apply(text, changes)
        checks = kept_by.checks(output)
        lost = [k.constraint for k in checks if not k.preserved and k.constraint.severity == "critical"]
        blame = _blamed(kept, lost) if kept and rounds < ROUNDS else {}
        if not blame:
            return Rewritten(output, changes, sorted(blocked, key=lambda b: b.start), inventory, checks, found, rounds)
        rounds += 1
        blocked += [replace(x, constraint_ids=tuple(dict.fromkeys(ids))) for x, ids in blame.items()]
        kept = [x for x in kept if x not in blame]


def diff_items(text: str, changes: list[Change], blocked: list[Change] = (), disabled: Iterable[str] = ()) -> list[dict]:
    """Untouched text, changes and blocked changes in order, for a view."""
    off, out, at = set(disabled), [], 0
    marks = [("change", c, c.key, c.key not in off) for c in changes]
    marks += [("blocked", c, f"blocked:{c.key}", False) for c in blocked]
    for kind, c, key, active in sorted(marks, key=lambda m: m[1].start):
        if c.start > at:
            out.append({"kind": "text", "start": at, "end": c.start, "text": text[at : c.start], "key": None, "active": None})
        out.append({"kind": kind, "start": c.start, "end": c.end, "text": c.replacement, "key": key, "active": active})
        at = max(at, c.end)
    if at < len(text):
        out.append({"kind": "text", "start": at, "end": len(text), "text": text[at:], "key": None, "active": None})
    return out
