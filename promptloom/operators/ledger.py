"""The inventory of constraints a prompt states, and whether a rewrite kept them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, partial

from ..functions import patterns
from ..functions.dialect import compiled, fold, for_ascii, needles, opening
from ..functions.vocabulary import FORMAT_NAMES, MEASURES, NO_NAMES, NO_UNITS, VERBS
from .anchors import Anchors
from .rewrite import SHIPPED, _filled
from .scan import BLANK, Cover, Holders, Region, Span, open_text, regions, sentence_at, sentences, starts
from .words import ENTITIES, FILLERS, FORMATS, MARKS, QUANTITIES, RUN, Kept, Sought, matches, told

# Fixed values, in the order of reports.
TYPES = ("prohibition", "requirement", "format", "quantity", "literal", "variable", "entity", "example", "instruction")
CRITICAL = frozenset(("prohibition", "requirement", "format", "quantity", "literal", "variable"))
COMPARED = ("prohibition", "requirement", "format", "instruction")
LONGEST, CONTEXT, FEWEST_TOKENS, SIMILAR, SHORTEST_NEIGHBOUR = 220, 3, 3, 0.6, 8

ASCII = str.maketrans({**dict.fromkeys("‘’‛", "'"), **dict.fromkeys("“”‟", '"'), **dict.fromkeys("–—", "-"), **dict.fromkeys("   ", " ")})
# (pattern, words of which every match holds one, replacement) of canonical texts, which are in lower case.
EQUAL = [(r.pattern, partial(_filled, r)) for r in SHIPPED if r.id.startswith("sub.")] + [(p, " ") for _, p, _ in patterns.FILLERS]
REPLACED = [(compiled(p), needles(p), new) for p, new in EQUAL]
# The same for ASCII texts.
ASCII_REPLACED = [(for_ascii(p), needles(p), new) for p, new in EQUAL]
TOKEN = compiled(patterns.TOKEN)
# The same in ASCII texts of lower case.
ASCII_TOKEN = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)*|[%$#]")
# The characters of leading and trailing marks, which are classes at one end of a text.
LEADING, TRAILING = BLANK + "-*+#>|.)]", BLANK + ".,;:!?)]}\"'`|-"
# Protected regions that are constraints themselves. Fixed values.
REGION_TYPES = {
    "quoted-string": ("literal", "quoted literal"),
    "url": ("literal", "URL"),
    "email": ("literal", "email address"),
    "variable": ("variable", "template variable"),
    "example": ("example", "example block"),
    "inline-code": ("entity", "inline code"),
}
JSON_STRING = compiled(r'"(?:[^"\\\n]|\\.)*"')
ENDS = {"breaks": r";|,\s+(?:and|but|or|then)\b|\s[-–—]\s", "head": r"(\p{L}[\p{L}-]*)$", "unit": r"\s(\p{Ll}+)$"}
WIDE, NARROW = ({name: by(p) for name, p in ENDS.items()} for by in (compiled, for_ascii))


@dataclass(frozen=True)
class Constraint:
    id: str
    type: str
    severity: str
    anchor: str
    start: int
    end: int
    sentence: str
    sentence_start: int
    sentence_end: int
    label: str


@dataclass(frozen=True)
class Check:
    constraint: Constraint
    preserved: bool
    evidence: str | None
    before: int
    after: int


def _replaced(lowered: str) -> str:
    if lowered.isascii():
        return _ascii_replaced(lowered)
    for pattern, words, new in REPLACED:
        # A pattern is tried only where a word that all its matches hold stands.
        if any(w in lowered for w in words):
            lowered = pattern.sub(new, lowered)
    return lowered


def _begun(run: str) -> int:
    """Of which equivalents and fillers a word may be the first: a bit each."""
    out = 0
    for i, (p, _) in enumerate(EQUAL):
        found = opening(p)
        if found is None or run in found.words or run.startswith(tuple(found.leads)):
            out |= 1 << i
    return out


BEGUN = Kept(_begun, 0)


FIRST = re.compile(r"[^a-z0-9]*([a-z0-9]*)")


def _may_instruct(sentence: str) -> bool:
    """Whether the first word may be a verb: it is one, or begins what is left out or replaced, or the text isn't ASCII."""
    if not sentence.isascii():
        return True
    low = sentence.lower()
    return FIRST.match(low)[1] in VERBS or (run := RUN.search(low)) is not None and BEGUN[run[0]] != 0


def _may_replace(lowered: str) -> int:
    may = 0
    for run in RUN.findall(lowered):
        may |= BEGUN[run]
    return may


def _ascii_replaced(lowered: str) -> str:
    may = _may_replace(lowered)
    while may:
        first = may & -may
        may ^= first
        pattern, words, new = ASCII_REPLACED[first.bit_length() - 1]
        if any(w in lowered for w in words) and (other := pattern.sub(new, lowered)) != lowered:
            # What was put in may make a later one match.
            lowered, may = other, _may_replace(other) & -(first << 1)
    return lowered


def canonical(text: str) -> str:
    """Lower-cased ASCII quotes and dashes, equivalents replaced, fillers gone."""
    return _replaced(text.translate(ASCII).lower())


# No equivalent, filler or token holds one of these, so what stands between two of them is reduced by itself.
BARRIER = re.compile(r"[.,;:!?\n]+")


def _piece_tokens(lowered: str) -> tuple[str, ...]:
    said = _replaced(lowered)
    return tuple((ASCII_TOKEN if said.isascii() else TOKEN).findall(said))


_short_piece_tokens = lru_cache(maxsize=1 << 16)(_piece_tokens)


def tokens(text: str) -> list[str]:
    """What is compared: the words of the canonical text, and % $ # by themselves. Pieces that come again are not worked out again."""
    out: list[str] = []
    for piece in BARRIER.split((text if text.isascii() else text.translate(ASCII)).lower()):
        # Equivalents and fillers begin and end with words.
        if piece := piece.strip(" "):
            out += _short_piece_tokens(piece) if len(piece) <= LONGEST else _piece_tokens(piece)
    return out


def first_tokens(text: str, least: int) -> list[str]:
    """The first of the ``tokens``: those of as many pieces as make ``least``."""
    out: list[str] = []
    for piece in BARRIER.split((text if text.isascii() else text.translate(ASCII)).lower()):
        if piece := piece.strip(" "):
            out += _short_piece_tokens(piece) if len(piece) <= LONGEST else _piece_tokens(piece)
            if len(out) >= least:
                break
    return out


@lru_cache(maxsize=1 << 12)
def anchor_tokens(anchor: str) -> tuple[str, ...]:
    """``tokens`` of an anchor, which the inventory and the ledger ask for in turn."""
    return tuple(tokens(anchor))


def places(within: list[str], sought: list[str]) -> list[int]:
    """Where ``sought`` stands contiguously, overlaps counted."""
    n = len(sought)
    return [i for i in range(len(within) - n + 1) if within[i : i + n] == sought] if n else []


def similarity(a: Iterable[str], b: Iterable[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def _filled_in(kind: type, fields: dict):
    """A frozen object with all its fields; its own constructor sets them one by one, which takes longer than all else about it."""
    made = object.__new__(kind)
    made.__dict__.update(fields)
    return made


class _Inventory:
    """Collects candidates of one text, scanner by scanner, in the order that decides duplicates."""

    def __init__(self, text: str, found: list[Region]):
        self.text, self.regions = text, found
        self.cover = Cover([r[:2] for r in found])
        self.sentences = sentences(text, found, self.cover)
        self.begins = starts(self.sentences)
        self.free, folded = open_text(text, found), fold(text)
        self.told = told(text)
        framed = [m.span() for one in FILLERS if self.told is None or self.told.may(one) for m in matches(text, one, folded)]
        self.fillers = Holders(framed) if framed else None
        self.ends = NARROW if text.isascii() else WIDE
        self.out: list[tuple[str, int, int, str, bool]] = []
        self.named: set[str] = set()

    def hits(self, one: Sought) -> list:
        if self.told is None:
            found = matches(self.text, one, self.free)
        elif not self.told.may(one) or not (found := self.told.matches(one, self.free)):
            return []
        meets = self.cover.meets
        return [m for m in found if m.end() > m.start() and not meets(*m.span())]

    def framed(self, m) -> bool:
        return self.fillers is not None and self.fillers.hold(*m.span())

    def sentence_at(self, point: int) -> Span | None:
        return sentence_at(self.sentences, point, self.begins)

    def add(self, kind: str, start: int, end: int, label: str, trim: bool = True) -> None:
        self.out.append((kind, start, end, label, trim))

    def clause_end(self, start: int, sentence: Span) -> int:
        end = min(sentence.end, start + LONGEST)
        if m := self.ends["breaks"].search(self.text[start:end]):
            return start + m.start()
        if end < sentence.end and (cut := self.text.rfind(" ", 0, end + 1)) > start:
            return cut
        return end

    def demands(self) -> None:
        claimed = Cover()
        for kind in ("prohibition", "requirement"):
            taken = []
            for m in self.hits(MARKS[kind]):
                sentence = self.sentence_at(m.start())
                if sentence is None or self.framed(m) or claimed.meets(m.start(), m.end()):
                    continue
                taken.append(m.span())
                self.add(kind, m.start(), self.clause_end(m.start(), sentence), f'{kind} ("{m[0].lower()}")')
            if kind == "prohibition":
                claimed = Cover(taken)

    def formats_and_quantities(self, quantities: bool = True) -> None:
        shaped: list[tuple[int, int]] = []
        for label, one in FORMATS:
            if not (found := self.hits(one)):
                continue
            # One pattern's matches are apart, so only those of earlier ones can hold a match.
            earlier = Holders(shaped)
            for m in found:
                head = self.ends["head"].search(m[0]) if label == "output budget" else None
                measure = head is not None and head[1].lower() in MEASURES
                if not (earlier.hold(*m.span()) or self.framed(m) or measure):
                    shaped.append(m.span())
                    self.add("format", *m.span(), label)
        if not quantities:
            return
        within = Holders(shaped)
        for label, one in QUANTITIES:
            for m in self.hits(one):
                unit = self.ends["unit"].search(m[0]) if label == "count" else None
                if not (unit is not None and unit[1] in NO_UNITS or within.hold(*m.span()) or self.framed(m)):
                    self.add("quantity", *m.span(), label)

    def first_named(self, word: str) -> bool:
        key = word.lower()
        if key in self.named:
            return False
        self.named.add(key)
        return True

    def entities(self) -> None:
        for label, one in ENTITIES:
            for m in self.hits(one):
                if m[0] not in FORMAT_NAMES and self.first_named(m[0]):
                    self.add("entity", *m.span(), label)

    def protected(self) -> None:
        for r in self.regions:
            if r.kind in REGION_TYPES:
                kind, label = REGION_TYPES[r.kind]
                self.add(kind, r.start, r.end, label, trim=False)
        for r in self.regions:
            if r.kind == "json":
                for m in JSON_STRING.finditer(self.text[r.start : r.end]):
                    if len(m[0]) > 2:
                        self.add("literal", r.start + m.start(), r.start + m.end(), "JSON string", trim=False)

    def names(self) -> None:
        for m in self.hits(MARKS["proper noun"]):
            if m[0] in NO_NAMES or m[0].lower() in self.named:
                continue
            sentence = self.sentence_at(m.start())
            opens = sentence is not None and sentence.start + _lead(sentence.text) == m.start()
            if not opens and self.first_named(m[0]):
                self.add("entity", *m.span(), "proper noun")

    def instructions(self) -> None:
        for s in self.sentences:
            if not _may_instruct(s.text):
                continue
            first = first_tokens(s.text[_lead(s.text) :], 2)
            if len(first) >= 2 and first[0] in VERBS and first[1] != "of":
                self.add("instruction", s.start, min(s.end, s.start + LONGEST), "imperative instruction")

    def constraints(self, exclude: frozenset[str]) -> list[Constraint]:
        found: dict[str, Constraint] = {}
        for kind, start, end, label, trim in self.out:
            if kind in exclude:
                continue
            anchor = self.text[start:end]
            if trim:
                start += _lead(anchor)
                # No mark is a letter or a digit.
                anchor = self.text[start:end] if anchor[-1:].isalnum() else self.text[start:end].rstrip(TRAILING)
                end = start + len(anchor)
            name = f"{kind}:{start}-{end}"
            if end <= start or name in found or not anchor_tokens(anchor):
                continue
            s = self.sentence_at(start) or Span(anchor, start, end)
            severity = "critical" if kind in CRITICAL else "minor"
            found[name] = _filled_in(
                Constraint,
                {
                    "id": name, "type": kind, "severity": severity, "anchor": anchor, "start": start, "end": end,
                    "sentence": s.text, "sentence_start": s.start, "sentence_end": s.end, "label": label,
                },
            )
        return sorted(found.values(), key=lambda c: (c.start, c.end))


def _lead(text: str) -> int:
    return 0 if text[:1].isalnum() else len(text) - len(text.lstrip(LEADING))


def extract(text: str, found: list[Region] | None = None, exclude: frozenset[str] = frozenset()) -> list[Constraint]:
    """The inventory without ``exclude``; a scanner that finds only such types doesn't run."""
    one = _Inventory(text, regions(text) if found is None else found)
    scanners = (
        (("prohibition", "requirement"), one.demands),
        (("format", "quantity"), lambda: one.formats_and_quantities("quantity" not in exclude)),
        (("entity",), one.entities),
        (tuple(kind for kind, _ in REGION_TYPES.values()), one.protected),
        (("entity",), one.names),
        (("instruction",), one.instructions),
    )
    for types, scanner in scanners:
        if not exclude.issuperset(types):
            scanner()
    return one.constraints(exclude)


class Ledger:
    """The constraints of one prompt, ready to be checked against any number of rewrites of it."""

    def __init__(self, original: str, constraints: list[Constraint]):
        self.original, self.constraints = original, constraints
        self.sought = [anchor_tokens(c.anchor) for c in constraints]
        self.anchors = Anchors(self.sought)
        self.tokens = tokens(original)
        self.before = self.anchors.counts(self.tokens)
        # The rewrite that was checked last: a stricter level or a last look often asks for the same again.
        self.last: tuple[str, list[Check]] | None = None

    def checks(self, rewritten: str) -> list[Check]:
        if self.last is None or self.last[0] != rewritten:
            self.last = rewritten, self._checks(rewritten)
        return list(self.last[1])

    def _checks(self, rewritten: str) -> list[Check]:
        after = self.tokens if rewritten == self.original else tokens(rewritten)
        found, out = self.before if after is self.tokens else self.anchors.counts(after), []
        for c, anchor in zip(self.constraints, self.sought, strict=True):
            (was, _), (now, first) = (self.before[anchor], found[anchor]) if anchor else ((0, -1), (0, -1))
            kept = now >= max(was, 1)
            evidence = " ".join(after[max(0, first - CONTEXT) : first + len(anchor) + CONTEXT]) if kept else None
            out.append(_filled_in(Check, {"constraint": c, "preserved": kept, "evidence": evidence, "before": was, "after": now}))
        return out


def verify(original: str, rewritten: str, constraints: list[Constraint]) -> list[Check]:
    """A constraint is kept if its tokens stand at least as often as before, and at least once."""
    return Ledger(original, constraints).checks(rewritten)


def summary(checks: list[Check]) -> dict:
    critical = [k for k in checks if k.constraint.severity == "critical"]
    return {
        "total": len(checks),
        "preserved": sum(k.preserved for k in checks),
        "critical_total": len(critical),
        "critical_preserved": sum(k.preserved for k in critical),
        "lost": [k.constraint.id for k in checks if not k.preserved],
        "critical_lost": [k.constraint.id for k in critical if not k.preserved],
        "clean": all(k.preserved for k in checks),
    }


def by_type(checks: list[Check]) -> list[tuple[str, int, int]]:
    """(type, kept, total) in report order."""
    total, kept = Counter(k.constraint.type for k in checks), Counter(k.constraint.type for k in checks if k.preserved)
    return [(t, kept[t], total[t]) for t in TYPES if total[t]]


def _near(own: frozenset[str], held: dict[str, list[int]], sets: list[frozenset[str]], threshold: float) -> list[int]:
    """Items that may be as similar as ``threshold``: they share one of the rarest tokens of ``own``, of which too few are left otherwise."""
    if threshold <= 0:
        return list(range(len(sets)))
    by_rarity = sorted(own, key=lambda w: (len(held[w]), w))
    some = by_rarity[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]
    return sorted({i for w in some for i in held[w]})


def duplicates(constraints: list[Constraint], threshold: float = SIMILAR) -> list[dict]:
    """Groups of one type: each unclaimed seed takes later ones that are similar to it and don't overlap it."""
    groups = []
    for kind in COMPARED:
        pool = [(c, t) for c in constraints if c.type == kind and len(t := tokens(c.anchor)) >= FEWEST_TOKENS]
        sets = [frozenset(t) for _, t in pool]
        held: dict[str, list[int]] = {}
        for i, own in enumerate(sets):
            for w in own:
                held.setdefault(w, []).append(i)
        claimed = [False] * len(pool)
        near_to: dict[frozenset[str], list[int]] = {}
        for i, (seed, _) in enumerate(pool):
            if claimed[i]:
                continue
            claimed[i] = True
            near = []
            if sets[i] not in near_to:
                near_to[sets[i]] = [j for j in _near(sets[i], held, sets, threshold) if similarity(sets[i], sets[j]) >= threshold]
            for j in near_to[sets[i]]:
                c = pool[j][0]
                score = 0.0 if c.start < seed.end and seed.start < c.end else similarity(sets[i], sets[j])
                if j > i and not claimed[j] and score >= threshold:
                    claimed[j] = True
                    near.append((c, score))
            if near:
                members = [seed, *(c for c, _ in near)]
                groups.append(
                    {
                        "type": kind,
                        "members": [c.id for c in members],
                        "start": seed.start,
                        "similarity": min(s for _, s in near),
                        "suggestion": min((c.sentence for c in members), key=len),
                    }
                )
    return sorted(groups, key=lambda g: g["start"])


def build(original: str, rewritten: str, constraints: list[Constraint] | None = None, exclude: frozenset[str] = frozenset()) -> tuple[list[Constraint], list[Check], list[dict]]:
    """The constraints, their checks and the repeated ones, from one inventory."""
    found = extract(original, exclude=exclude) if constraints is None else constraints
    return found, verify(original, rewritten, found), duplicates(found)


def restore(original: str, rewritten: str, constraint: Constraint) -> str:
    """Put a lost constraint's sentence back next to the nearest neighbour that survived."""
    sentence = constraint.sentence.strip(BLANK)
    if not sentence or places(tokens(rewritten), tokens(sentence)):
        return rewritten
    all_of = sentences(original)
    index = next((i for i, s in enumerate(all_of) if s.start == constraint.sentence_start), None)
    line = original[original.rfind("\n", 0, constraint.sentence_start) + 1 : constraint.sentence_start]
    gap = " " if line.strip(" \t") else "\n"

    def survivor(neighbours: list[Span]) -> tuple[int, Span] | None:
        found = ((rewritten.find(s.text), s) for s in neighbours if len(s.text) >= SHORTEST_NEIGHBOUR)
        return next((f for f in found if f[0] >= 0), None)

    if index is not None:
        if near := survivor(all_of[:index][::-1]):
            cut = near[0] + len(near[1].text)
            return rewritten[:cut] + gap + sentence + rewritten[cut:]
        if near := survivor(all_of[index + 1 :]):
            return rewritten[: near[0]] + sentence + gap + rewritten[near[0] :]
    if not rewritten:
        return sentence
    return rewritten + ("" if rewritten.endswith("\n") else "\n" if "\n" in rewritten else " ") + sentence
