import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptloom.operators import ledger, scan
from promptloom.operators.rewrite import LEVELS, SHIPPED, Rule, apply, diff_items, rewrite, rules_for, select, without

# (rule, input, output); an unchanged output means that the rule must not fire.
CASES = [
    ("politeness.please", "Please write it.", "Write it."),
    ("politeness.please", "You may do as you please.", "You may do as you please."),
    ("politeness.please", "Kindly, stop.", "Stop."),
    ("frame.polite-request", "Could you please list them?", "List them?"),
    ("frame.task-is-to", "Your task is to sort it.", "Sort it."),
    ("frame.you-are-asked-to", "You are asked to sort it.", "Sort it."),
    ("intensifier.degree", "It is very good.", "It is good."),
    ("intensifier.degree", "every day", "every day"),
    ("hedge.opinion", "I think, it works.", "It works."),
    ("frame.as-an-ai", "As an AI assistant, help.", "Help."),
    ("frame.important-to-note", "It is important to note that cats sleep.", "Cats sleep."),
    ("frame.in-this-task", "In this task, sort.", "Sort."),
    ("frame.the-following-is", "The following is a list.", "List."),
    ("sub.in-order-to", "in order to win", "to win"),
    ("sub.because", "due to the fact that it rains", "because it rains"),
    ("sub.utilize", "utilizing tools", "using tools"),
    ("sub.utilize", "It utilizes tools", "It uses tools"),
    ("sub.before", "Prior to that", "Before that"),
    ("ws.trailing-space", "a  \nb\t", "a\nb"),
    ("ws.repeated-space", "a    b", "a b"),
    ("ws.blank-lines", "a\n\n\n\nb", "a\n\nb"),
    ("ws.nbsp", "a b", "a b"),
    ("ws.space-before-punct", "a , b", "a, b"),
    ("md.bullet-marker", "* a", "- a"),
    ("md.bullet-space", "-   a", "- a"),
    ("md.ordered-space", "1.   a", "1. a"),
    ("punct.apostrophe", "don’t", "don't"),
]
PROMPTS = [
    "Please write `please` in JSON.\n\n```\nplease\n```\n{\"please\": [1, 2]} and \"please\" at https://x.org/please.",
    "# Rules\n- Please never exceed 5 retries;  always   answer.\n\n\n\nExample:\nplease do\n\n| a | b |\n|---|---|\n| please | c |",
    "User: could you please help {{name}}? Mail a@b.org. As an AI assistant, your task is to sort. 1.   one",
]


@pytest.mark.parametrize("rule,given_text,expected", CASES)
def test_rules(rule, given_text, expected):
    one = [r for r in SHIPPED if r.id == rule]
    assert rewrite(given_text, "aggressive", rules=one, enforce=False).output == expected


def test_levels_are_cumulative():
    assert [len(rules_for(level)) for level in LEVELS] == [9, 31, 37]


@pytest.mark.parametrize("phrase", ["step by step", "make sure to", "note that", "feel free to", "if possible", "Thank you.", "in a clear manner"])
def test_phrases_that_must_survive(phrase):
    text = f"Answer it {phrase} now."
    assert phrase in rewrite(text, "aggressive").output


@pytest.mark.parametrize("level", LEVELS)
@pytest.mark.parametrize("text", PROMPTS)
def test_properties_of_prompts(text, level):
    done = rewrite(text, level, enforce=True)
    assert without(text, done.changes, [c.key for c in done.changes]) == text
    assert apply(text, done.changes) == done.output
    assert all(a.end <= b.start for a, b in zip(done.changes, done.changes[1:], strict=False))
    assert all(r.end <= c.start or c.end <= r.start for r in scan.regions(text) for c in done.changes)
    for r in scan.regions(text):
        assert text[r.start : r.end] in done.output
    assert "".join(i["text"] if i["kind"] == "text" or i["active"] else "" for i in diff_items(text, done.changes)) == done.output


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aP `\"{}[]<>*-|:\n.,5e'pls_~#“”é", max_size=60))
def test_segments_join_to_any_text(text):
    assert "".join(s[0] for s in scan.segments(text)) == text
    assert without(text, (r := rewrite(text, "aggressive")).changes, [c.key for c in r.changes]) == text
    assert all(text[s.start : s.end] == s.text for s in scan.sentences(text))


def test_kinds_of_regions():
    kinds = {r.kind for p in PROMPTS for r in scan.regions(p)}
    assert kinds == {"code-fence", "json", "inline-code", "quoted-string", "url", "example", "table", "variable", "email"}
    assert [r.kind for r in scan.regions("~~~\nopen to the end")] == ["code-fence"]
    assert scan.regions("[1]") == []


def test_ledger_blocks_a_rule_that_loses_a_constraint():
    bad = Rule("bad", "light", True, r"[^\S\n]*never", "gi", "")
    done = rewrite("You should never share keys.", "light", rules=[bad], enforce=True)
    assert done.output == "You should never share keys." and [b.rule_id for b in done.blocked] == ["bad"]
    assert done.blocked[0].constraint_ids


def test_tokens_and_occurrences():
    assert ledger.tokens("50%") == ["50", "%"] and ledger.tokens("$5") == ["$", "5"]
    assert ledger.tokens("In order to utilize it, please.") == ["to", "use", "it"]
    assert ledger.places(["a", "a", "a"], ["a", "a"]) == [0, 1] and ledger.places(["a"], []) == []
    assert ledger.similarity(["a", "b"], ["b", "c"]) == 1 / 3 and ledger.similarity([], ["a"]) == 0


def test_a_demand_stated_twice_must_stay_twice():
    text = "Never share keys. Do it. Never share keys."
    check = next(k for k in ledger.verify(text, "Do it. Never share keys.", ledger.extract(text)) if k.constraint.type == "prohibition")
    assert (check.before, check.after, check.preserved) == (2, 1, False)


def test_every_lost_critical_sentence_is_reported():
    text = PROMPTS[1] + "\nYou must reply in English. Use at most 3 items."
    for c in ledger.extract(text):
        if c.severity == "critical":
            cut = text.replace(text[c.start : c.end], "")
            assert any(k.constraint.id == c.id and not k.preserved for k in ledger.verify(text, cut, [c])), c


def test_restore_puts_a_sentence_back_in_place():
    text = "First sentence here. Never share keys. Last sentence here."
    lost = next(c for c in ledger.extract(text) if c.type == "prohibition")
    assert ledger.restore(text, "First sentence here. Last sentence here.", lost) == text
    assert ledger.restore(text, text, lost) == text
    assert ledger.restore(text, "", lost) == "Never share keys."


def test_duplicates():
    found = ledger.duplicates(ledger.extract("Never exceed the limit of 5 calls.\nNever exceed the limit of 5 calls today."))
    assert [g["suggestion"] for g in found if g["type"] == "prohibition"] == ["Never exceed the limit of 5 calls."]
