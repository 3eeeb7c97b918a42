"""Where lists of tokens stand in a text: all of them in one pass.

The sought lists make a trie with links to the longest proper suffix that is also in it,
so that one walk over a text's tokens finds every list, however they overlap, in time in
proportion to the text and to the lists.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence


# So many lists are looked up one by one in a text of so many tokens; the trie pays beyond.
FEW_LISTS, FEW_TOKENS = 48, 256


class Anchors:
    """Distinct token lists, ready to be counted in any text."""

    def __init__(self, sought: Iterable[tuple[str, ...]]):
        self.sought = dict.fromkeys(s for s in sought if s)
        self.next: list[dict[str, int]] = []

    def _grow(self) -> None:
        self.next = [{}]
        self.of: dict[tuple[str, ...], int] = {}
        for tokens in self.sought:
            at = 0
            for token in tokens:
                onward = self.next[at].get(token)
                if onward is None:
                    onward = self.next[at][token] = len(self.next)
                    self.next.append({})
                at = onward
            self.of[tokens] = at
        self.link = [0] * len(self.next)
        # Nodes by depth, which is the order in which links can be found, and undone.
        self.order: list[int] = []
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            self.order.append(at)
            for token, onward in self.next[at].items():
                back = self.link[at]
                while back and token not in self.next[back]:
                    back = self.link[back]
                self.link[onward] = self.next[back].get(token, 0)
                queue.append(onward)

    def counts(self, tokens: Sequence[str]) -> dict[tuple[str, ...], tuple[int, int]]:
        """Of each sought list how often it stands in ``tokens``, overlaps counted, and the place of its first one (-1: none)."""
        if len(self.sought) <= FEW_LISTS and len(tokens) <= FEW_TOKENS:
            return self._looked_up(tuple(tokens))
        if not self.next:
            self._grow()
        seen, ends = [0] * len(self.next), [-1] * len(self.next)
        at, next_, link = 0, self.next, self.link
        for i, token in enumerate(tokens):
            while at and token not in next_[at]:
                at = link[at]
            at = next_[at].get(token, 0)
            if at:
                seen[at] += 1
                if ends[at] < 0:
                    ends[at] = i
        for node in reversed(self.order):
            back = link[node]
            if back and seen[node]:
                seen[back] += seen[node]
                if ends[back] < 0 or ends[node] < ends[back]:
                    ends[back] = ends[node]
        return {s: (seen[n], ends[n] - len(s) + 1 if seen[n] else -1) for s, n in self.of.items()}

    def _looked_up(self, tokens: tuple[str, ...]) -> dict[tuple[str, ...], tuple[int, int]]:
        places: dict[str, list[int]] = {}
        for i, token in enumerate(tokens):
            places.setdefault(token, []).append(i)
        out = {}
        for s in self.sought:
            at, n = places.get(s[0], ()), len(s)
            if n > 1 and at:
                at = [i for i in at if tokens[i : i + n] == s]
            out[s] = (len(at), at[0]) if at else (0, -1)
        return out
