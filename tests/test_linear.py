"""The region scan, the token index and the ledger against plain versions of themselves, and their growth with a prompt's length."""

import json
import random
import time

import pytest

from promptloom.operators import ledger, rewrite, scan
from promptloom.operators.anchors import Anchors

JSON_PARTS = ["[", "]", "{", "}", '"', "\\", '"a"', ":", ",", " ", "1", "-2.5e3", "01", "true", "null", "\n", '\\"', "\\u00e9", "\\\\", '"k": ', "[1, ", '{"a": [']
WORDS = ["Never exceed 5 retries", "do not open it", "You must answer in JSON", "please", "in order to", ". ", "\n", "; ", "e.g. ", "very big", "ΑΣ.Α", "utilize it", '"quoted x"', "it must not fail", "I think", "ensure that", " ", "at most 5 words", "Berlin", "{{v}}"]


def plain_json(text):
    def refuse(_):
        raise ValueError

    out, at, reader = [], 0, json.JSONDecoder(parse_constant=refuse)
    while at < len(text):
        if text[at] in "[{":
            try:
                _, end = reader.raw_decode(text, at)
            except ValueError:
                end = 0
            if end - at >= 4:
                out.append((at, end))
                at = end
                continue
        at += 1
    return out


def test_json_regions_equal_a_reader_at_every_bracket():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(JSON_PARTS) for _ in range(rng.randrange(1, 30)))
        assert [r[:2] for r in scan._json(text)] == plain_json(text), text


def test_deep_brackets_are_no_recursion():
    assert scan._json("[" * 50_000 + "]" * 50_000)[0][:2] == (0, 100_000)


def test_short_forms_and_list_numbers_end_no_sentence():
    text = "1. Use cats, e.g. tabbies vs. lions. Ask Dr.No etc. The xetc. end? 12.\nNext approx. here"
    assert [s.text for s in scan.sentences(text)] == ["1. Use cats, e.g. tabbies vs. lions.", "Ask Dr.No etc. The xetc.", "end?", "12.", "Next approx. here"]


def test_token_lists_are_counted_in_one_pass():
    rng = random.Random(2)
    for _ in range(500):
        text = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        sought = [tuple(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(12)]
        found = Anchors(sought).counts(text)
        for s in sought:
            at = ledger.places(text, list(s))
            assert found[s] == (len(at), at[0] if at else -1)


def plain_verify(before, after, constraints):
    was, now, out = ledger.tokens(before), ledger.tokens(after), []
    for c in constraints:
        anchor = ledger.tokens(c.anchor)
        a, b = ledger.places(was, anchor), ledger.places(now, anchor)
        kept = bool(anchor) and len(b) >= max(len(a), 1)
        out.append((kept, " ".join(now[max(0, b[0] - 3) : b[0] + len(anchor) + 3]) if kept else None, len(a), len(b)))
    return out


def plain_groups(constraints):
    groups = []
    for kind in ledger.COMPARED:
        pool = [c for c in constraints if c.type == kind and len(ledger.tokens(c.anchor)) >= 3]
        while pool:
            seed, *rest = pool
            near = [c for c in rest if (c.end <= seed.start or seed.end <= c.start) and ledger.similarity(ledger.tokens(seed.anchor), ledger.tokens(c.anchor)) >= 0.6]
            pool = [c for c in rest if c not in near]
            if near:
                groups.append([seed.id, *(c.id for c in near)])
    return sorted(groups)


def test_ledger_equals_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", ". ", "\n"]) for _ in range(rng.randrange(1, 14)))
        other = " ".join(w for w in text.split(" ") if rng.random() < 0.9)
        found = ledger.extract(text)
        assert [(k.preserved, k.evidence, k.before, k.after) for k in ledger.verify(text, other, found)] == plain_verify(text, other, found)
        assert sorted(g["members"] for g in ledger.duplicates(found)) == plain_groups(found)
        # Tokens of pieces are the tokens of the whole.
        assert ledger.tokens(text) == ledger.TOKEN.findall(ledger.canonical(text))


@pytest.mark.parametrize(
    "name,text,work",
    [
        ("brackets", "[1, ", scan._json),
        ("strings", '["a\\"', scan._json),
        ("stops", "a. e.g. b.c. ", scan.sentences),
        ("quotes", '"q" {x} ', scan.regions),
        ("demands", "Never exceed {} retries of job_{}. ", ledger.extract),
        ("rewrites", "Please never exceed {} retries of job_{}. ", lambda t: rewrite.rewrite(t, "aggressive")),
        ("groups", "Never exceed {} retries of job_{}. ", lambda t: ledger.duplicates(ledger.extract(t))),
    ],
)
def test_time_grows_in_proportion(name, text, work):
    def seconds(size):
        whole = "".join(text.replace("{}", str(i)) if "{}" in text else text for i in range(size // len(text)))
        began = time.process_time()
        work(whole)
        return time.process_time() - began

    seconds(2_000)
    # Sixteen times the text takes far less than the square of that.
    assert seconds(320_000) < 60 * max(seconds(20_000), 0.01)
