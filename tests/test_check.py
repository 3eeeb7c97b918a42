import json

import pytest

from promptloom.operators import ledger
from promptloom.plans import check, providers


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.md").write_text("Please write it in order to win. Never share keys.")
    (tmp_path / "two.md").write_text("Short.")
    return tmp_path


def test_check_command(spark, folder):
    run = lambda *extra: check.check(spark, check.parser().parse_args(["*.md", "--cwd", str(folder), "--no-base", *extra]))
    said, code = run("--budget", "5")
    assert code == 1 and "FAIL: 1 file over budget: one.md" in said
    said, code = run("--format", "json", "--out", str(folder / "out" / "r.json"))
    assert code == 0 and [f["path"] for f in json.loads(said)["files"]] == ["one.md", "two.md"] and (folder / "out" / "r.json").read_text() == said
    said, _ = run("--format", "markdown", "--write")
    assert said.startswith("| file |") and (folder / "one.md").read_text() == "Write it to win. Never share keys."


def test_exact_counts_are_told_from_estimates(spark, folder):
    import public_tokenizers

    run = lambda model: check.check(spark, check.parser().parse_args(["*.md", "--cwd", str(folder), "--no-base", "--model", model, "--vocabulary", public_tokenizers.path("word_bpe_49k.json"), "--format", "json"]))
    assert all(f["exact"] for f in json.loads(run("gpt-5")[0])["files"])
    assert not any(f["exact"] for f in json.loads(run("claude-opus-5")[0])["files"])


@pytest.mark.parametrize("args", [["x", "--budget", "0"], ["x", "--level", "none"], ["x", "--fail-on", "luck"], []])
def test_wrong_usage(args):
    with pytest.raises(SystemExit) as e:
        check.parser().parse_args(args)
    assert e.value.code == 2


def test_providers():
    found = ledger.extract("Never share keys. Answer in JSON.")
    assert "- [prohibition:0-16] (prohibition, CRITICAL) Never share keys" in providers.inventory(found)
    assert "additionalProperties" not in json.dumps(providers.without_key(providers.VERIFY)) and "additionalProperties" in json.dumps(providers.VERIFY)
    assert providers.ordered_models(["z", "a-2-x", "a", "b-1"], ["a", "b"]) == ["a", "a-2-x", "b-1", "z"] and providers.ordered_models([], ["a"]) == ["a"]
    assert providers.failure([("a", "no"), ("b", "no")]) == "no" and providers.failure([("a", "x"), ("b", "y")]) == "a: x | b: y"
    assert providers.retry_after("1.2") == 2 and providers.retry_after("-1") is None and providers.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 0) == 60
    assert providers.status_message("P", 429, None, 3) == "P rate limit reached. Retry in 3s." and providers.status_message("P", 418, "x") == "P API error 418. x"
    assert providers.short_detail(" a \n b ") == "a b" and providers.short_detail("") is None and len(providers.short_detail("x" * 300)) == 200
    cost = providers.estimated_cost("Never share keys.", "balanced", found, "gpt-5", "gpt-5-mini")
    assert 0 < cost["min_usd"] < cost["max_usd"] and providers.estimated_cost(" ", "light", [], "gpt-5", "gpt-5") is None
    with pytest.raises(ValueError, match="empty"):
        providers.payload("P", " ")
