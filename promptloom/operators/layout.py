"""What of a prompt a provider's cache can hold, and the prompt laid out for it."""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

from ..functions import patterns
from ..functions.dialect import compiled, fold, may_match
from .scan import Cover, lines, regions

SIGN = {label: compiled(p, f) for label, p, f in patterns.DYNAMIC}
SOURCE = {label: p for label, p, _ in patterns.DYNAMIC}
ORDER = ("section", "date", "identifier", "variable")
SCANNED = (("section tag", "section"), ("date hint", "date"), ("iso date", "date"), ("id hint", "identifier"), ("uuid", "identifier"))
NOT_NAME = compiled(r"[^A-Za-z0-9_ .-]")


class Marker(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


class Layout(NamedTuple):
    boundary: int
    cacheable_end: int
    static_prefix: str
    dynamic_suffix: str
    reordered_prefix: str
    reordered_suffix: str
    markers: list[Marker]
    invalidators: list[Marker]
    moved_lines: list[str]


@lru_cache(maxsize=1 << 12)
def variable_kind(text: str) -> str:
    """What a template variable's name says it holds."""
    name = NOT_NAME.sub(" ", text).strip()
    return "date" if SIGN["date name"].search(name) else "identifier" if SIGN["id name"].search(name) else "variable"


def markers(text: str) -> list[Marker]:
    """What makes the text vary from call to call; the first of overlapping ones."""
    found = regions(text)
    skipped = Cover([r[:2] for r in found if r.kind in ("example", "code-fence")])
    raw = []
    rows = lines(text)
    starts = [row.start for row in rows]
    folded = fold(text)
    for row in rows:
        # A label ends in a colon.
        if ":" in row.text and (m := SIGN["section label"].match(row.text)):
            raw.append((row.start, row.start + m.end(), "section", m[0].strip()))
    for label, kind in SCANNED:
        if may_match(SOURCE[label], folded):
            raw += [(m.start(), m.end(), kind, m[0]) for m in SIGN[label].finditer(text)]
    raw += [(r.start, r.end, variable_kind(text[r.start : r.end]), text[r.start : r.end]) for r in found if r.kind == "variable"]
    last, out = 0, []
    for start, end, kind, said in sorted(raw, key=lambda x: (x[0], ORDER.index(x[2]))):
        if not skipped.holds(start) and start >= last:
            last = max(end, last)
            out.append(Marker(kind, said, start, end, bisect_right(starts, start) - 1))
    return out


def split(text: str) -> Layout:
    rows, found = lines(text), markers(text)
    section = next((m for m in found if m.kind == "section"), None)
    last = section.line if section else len(rows)
    boundary = rows[last].start if section else len(text)
    breaking = [m for m in found if m.kind != "section" and m.start < boundary]
    end = min([boundary, *(m.start for m in breaking)])
    moved = {m.line for m in breaking}
    above = rows[:last]
    below = [r.text for i, r in enumerate(above) if i in moved]
    suffix = [x for x in ("\n".join(below), text[boundary:] if section else "") if x]
    return Layout(
        boundary,
        end,
        text[:end],
        text[end:],
        "\n".join(r.text for i, r in enumerate(above) if i not in moved),
        "\n".join(suffix),
        found,
        breaking,
        [rows[i].text for i in sorted(moved)],
    )


# How each provider is told where the static part ends; {ttl} is filled in.
BREAKPOINTS = {
    "anthropic": '<!-- cache breakpoint: put cache_control {{"type": "ephemeral"{ttl}}} on the last content block above this line. -->',
    "openai": "<!-- cache breakpoint: everything above is reused automatically while it stays identical between calls. -->",
    "gemini": '<!-- cache breakpoint: create an explicit cache (ttl "{ttl}") of everything above this line. -->',
}


def breakpoint_for(provider: str, ttl_id: str | None = None, ttl_seconds: int | None = None) -> str:
    said = (', "ttl": "1h"' if ttl_id == "anthropic-1h" else "") if provider == "anthropic" else f"{ttl_seconds or 3600}s"
    return BREAKPOINTS[provider].format(ttl=said)


def cache_ready(text: str, provider: str, ttl_id: str | None = None, ttl_seconds: int | None = None) -> dict:
    """The static part, the provider's breakpoint and the rest, with notes."""
    laid = split(text)
    mark = breakpoint_for(provider, ttl_id, ttl_seconds)
    notes = []
    if n := len(laid.moved_lines):
        notes.append(f"Moved {n} per-request line{'s' * (n != 1)} below the breakpoint; they cut the cacheable prefix short.")
    if any(m.kind == "variable" for m in laid.invalidators):
        notes.append("Template variables count as per-request; inline one above the breakpoint if it never changes.")
    if not laid.reordered_prefix.strip():
        notes.append("No static block was found: the prompt is dynamic from its first line.")
    parts = [p for p in (laid.reordered_prefix, mark, laid.reordered_suffix) if p.strip()]
    return {"text": "\n\n".join(parts), "marker": mark, "moved_lines": laid.moved_lines, "notes": notes}
