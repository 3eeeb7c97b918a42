"""What a pattern's matches hold, which decides where it is tried, against trying it everywhere."""

import random

import regex

from promptloom.functions import dialect, patterns
from promptloom.operators import ledger, rewrite, scan
from promptloom.operators import anchors as trie
from promptloom.operators.rules import RULES

ALL = [(p, f) for g in ("REGIONS", "FORMATS", "QUANTITIES", "ENTITIES", "MARKERS", "FILLERS", "DYNAMIC") for _, p, f in getattr(patterns, g)]
ALL += [(r[3], r[4]) for r in RULES]
PARTS = """please|Kindly, |in order to|MUST NOT |don't|can’t|ſhould|Kilo|k|İN JSON|ın json|as JSON|yaml list|a.PY|x.yml|b.json5|5 ms|3 min|10 KB|5 %|$ 4|€9|exactly 3 bullet points|
at most 2 and 5 words|  |\t| ,|\n\n\n|1.  a|*\ta|\u00a0|\u202f|{{v}}|${v}|%(a)s|%d|“q”|‘q’|`c`|<a b>|[NAME]|a@b.co|www.x|HTTP://y|user id|the following is an |as an LLM |it's important to note that |
utilizing|takes into account|from 7|v1.2|2024-01-02|nothing else|without any preamble|In the user's language""".replace("\n", "").replace("\\n", "\n").replace("\\t", "\t").split("|")


def test_a_pattern_that_is_not_tried_has_no_match():
    rng = random.Random(7)
    skipped = 0
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) + rng.choice(["", " ", ". ", "\n"]) for _ in range(rng.randrange(1, 6)))
        folded = dialect.fold(text)
        for p, f in ALL:
            if not dialect.may_match(p, folded):
                skipped += 1
                assert dialect.compiled(p, f).search(text) is None, (p, text)
    assert skipped > 100_000


def test_folding_knows_all_that_matches_a_letter():
    letter = regex.compile("[a-z]", regex.V0 | regex.IGNORECASE)
    odd = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and letter.fullmatch(chr(c))]
    assert odd and all("a" <= dialect.fold(c) <= "z" for c in odd)


def test_marks_at_both_ends():
    lead, tail = (dialect.compiled(p, f) for label, p, f in patterns.MARKERS if "marks" in label)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a -*#>|.)]}\"'`,;!?\n\t\u00a0\u2028\ufeff\u0085\x1c") for _ in range(rng.randrange(0, 9)))
        m, n = lead.match(text), tail.search(text)
        assert ledger._lead(text) == (len(m[0]) if m else 0)
        assert len(text.rstrip(ledger.TRAILING)) == len(text) - (len(n[0]) if n else 0)


def test_few_lists_are_counted_as_many_are(monkeypatch):
    rng = random.Random(4)
    cases = [([rng.choice("abc") for _ in range(rng.randrange(0, 40))], [tuple(rng.choice("abc") for _ in range(rng.randrange(0, 5))) for _ in range(9)]) for _ in range(300)]
    quick = [trie.Anchors(s).counts(t) for t, s in cases]
    monkeypatch.setattr(trie, "FEW_LISTS", -1)
    assert quick == [trie.Anchors(s).counts(t) for t, s in cases]


def test_protected_text_makes_no_pattern_run(monkeypatch):
    text = 'Say "please" at https://example.org/very/5-words. Never exceed 5 retries.'
    tried = []
    real = dialect.compiled
    monkeypatch.setattr(rewrite, "compiled", lambda p, f="": tried.append(p) or real(p, f))
    assert rewrite.select(text, "aggressive", scan.regions(text)) == []
    # Before, each of the level's rules ran over the text.
    assert len(tried) <= 3


def test_fewer_than_half_of_the_patterns_run_over_a_plain_prompt():
    text = 'Please process event 7 in order to click. Never exceed 5 retries. You must answer in JSON for user_id 7.\nProps: {"k": 7}'
    free = scan.open_text(text, scan.regions(text))
    assert sum(dialect.may_match(p, free) for p, _ in ALL) < len(ALL) / 2
