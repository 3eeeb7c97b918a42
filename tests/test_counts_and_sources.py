"""Token counts, corpora, links, references, batches and the reports over them."""

import json
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from promptloom.functions import counting, data, patterns, pricing
from promptloom.functions import text as T
from promptloom.functions.dialect import compiled, needles
from promptloom.operators import frames, ledger
from promptloom.operators.rules import RULES
from promptloom.plans import cases, relations, reports
from promptloom.plans import queries as library
from promptloom.sources import corpora, files, share

TEXTS = ["Never exceed 5 retries.", "", None, "in order to go", "é猫 x" * 50]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def said(frame, column):
    return [tuple(r["c"]) for r in frame.select("i", column.alias("c")).orderBy("i").collect()]


def estimates(texts):
    return [r["n"] for r in texts.orderBy("i").select(T.estimated_tokens(F.coalesce("t", F.lit(""))).alias("n")).collect()]


def test_exact_counts_by_a_vocabulary(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = said(texts, counting.counted(F.col("t"), "gpt-5", vocabulary=path))
    assert got == [(len(own.encode(t or "", add_special_tokens=False).ids), True) for t in TEXTS]
    assert said(texts, counting.counted(F.col("t"), "gpt-5")) == [(n, False) for n in estimates(texts)]


def test_counts_by_a_service_fall_back(texts):
    want = estimates(texts)
    for model in ("claude-opus-5", "gemini-2.5-pro"):
        got = said(texts, counting.counted(F.col("t"), model, service=lambda batch: [len(t) * 3 for t in batch]))
        assert got == [(len(t) * 3, True) if t else (0, False) for t in TEXTS]
        for broken in (lambda batch: 1 / 0, lambda batch: [1] * (len(batch) + 1), lambda batch: [None] * len(batch), lambda batch: ["x"] * len(batch)):
            assert said(texts, counting.counted(F.col("t"), model, service=broken)) == [(n, False) for n in want]
    with pytest.raises(KeyError):
        counting.counted(F.col("t"), "no such model")


def test_links_are_the_public_format():
    assert share.pack("hello, i am a 猫") == "BYUwNmD2A0AECWsCGBbZtDUzkA" and share.pack("") == "Q"
    random.seed(3)
    for n in [*range(30), 500, 3000]:
        text = "".join(random.choice("abcé猫😀\n \"\\") for _ in range(n))
        assert share.unpack(share.pack(text)) == text and share.decode(share.encode(text, "light")) == (text, "light")
    for bad in ("", "#s=", "#s=!!", "#x=Q", "#s=" + share.pack("{}"), "#s=" + share.pack(json.dumps({"v": 2, "input": "a", "level": "light"})), share.encode("a", "light")[:-4]):
        assert share.decode(bad) is None


def test_corpora_and_accuracy(spark, tmp_path):
    for name, text in (("01-a.md", "Never open it. It must be short."), ("02-b.md", "Pay $40 for it."), ("README.md", "no prompt")):
        (tmp_path / name).write_text(text)
    gold = {"01-a": [("prohibition", "Never open it"), ("requirement", "must be short"), ("quantity", "40 times")], "02-b": [("quantity", "$40")]}
    for name, found in gold.items():
        body = {"id": name, "category": "c", "source": "s", "constraints": [{"type": t, "anchor": a} for t, a in found]}
        (tmp_path / f"{name}.constraints.json").write_text(json.dumps(body, indent=1))
    prompts, marks = corpora.read_numbered(spark, str(tmp_path)), corpora.read_annotations(spark, str(tmp_path))
    assert {r["id"] for r in prompts.collect()} == set(gold) and marks.count() == 4
    assert [r["anchor"] for r in corpora.misplaced(prompts, marks).collect()] == ["40 times"]
    found = frames.with_constraints(prompts).select("id", F.explode("constraints").alias("c")).select("id", "c.type", "c.anchor")
    got = {r["type"]: (r["recall"], r["precision"]) for r in reports.accuracy(marks, found).collect() if r["gold"]}
    assert got == {"prohibition": (1.0, 1.0), "requirement": (1.0, 1.0), "quantity": (0.5, 1.0)}


def test_references_and_keys(tmp_path):
    run = lambda *words: subprocess.run(["git", "-C", str(tmp_path), *words], check=True, capture_output=True)
    assert not files.is_repository(str(tmp_path))
    run("init", "-q")
    (tmp_path / "a.md").write_text("one")
    run("add", "a.md")
    run("-c", "user.name=n", "-c", "user.email=e@example.org", "commit", "-qm", "m")
    assert files.is_repository(str(tmp_path)) and files.base_ref(str(tmp_path), "HEAD")[0] == "HEAD"
    assert files.base_ref(str(tmp_path), "gone") is None and files.at_ref(str(tmp_path), "HEAD", "a.md") == "one" and files.at_ref(str(tmp_path), "HEAD", "b.md") is None
    assert data.key_name("gpt-5") == "OPENAI_API_KEY" and data.KEEP_RATE["balanced"] == 0.65
    assert T.export_name("json") == "prompt.json" and T.MIME["md"] == "text/markdown"


def test_intervals_and_batches(spark):
    given = [(5.0, "5 s"), (89.4, "89 s"), (90.0, "2 min"), (5399.0, "90 min"), (5400.0, "1.5 h"), (float("inf"), "a very long time")]
    rows = spark.createDataFrame(given, "s double, want string").select(pricing.interval(F.col("s")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)
    frame = spark.createDataFrame([("a\n---\nb",), ("a",), ("---\na",), ("",)], "t string")
    assert [r["x"] for r in frame.select(T.is_batch(F.col("t")).alias("x")).collect()] == [True, False, False, False]
    rows = reports.batch_rows(spark.createDataFrame([("Please stop.\n---\nNever exceed 5 retries.", 7)], "text string, output int")).orderBy("index").collect()
    assert [(r["index"], r["preview"], r["output"], r["critical_kept"], r["critical_total"]) for r in rows] == [(1, "Please stop.", "Stop.", 0, 0), (2, "Never exceed 5 retries.", "Never exceed 5 retries.", 2, 2)]


def test_one_ledger_and_verdicts(spark):
    a, b = "Never open it. Never open it now. Pay $40.", "Never open it. Pay."
    found, checks, groups = ledger.build(a, b)
    assert found == ledger.extract(a) and checks == ledger.verify(a, b, found) and groups == ledger.duplicates(found)
    row = frames.with_ledger(spark.createDataFrame([(a, b, 1)], "text string, output string, checks int"))
    assert row.columns == ["text", "output", "constraints", "checks", "duplicates"]
    names = {k.constraint.id: k.preserved for k in checks}
    told = F.create_map(*[x for n, kept in list(names.items())[:2] for x in (F.lit(n), F.lit(not kept))])
    got = row.select(F.size(reports.disagreements(F.col("checks"), told)).alias("n"), F.size(reports.critical_lost(F.col("checks"))).alias("lost")).first()
    assert got["n"] == 2 and got["lost"] == sum(not k.preserved and k.constraint.severity == "critical" for k in checks)


def test_every_match_holds_a_needle():
    given = [p for _, p, _ in cases.RULES] + [t.format(x) for t in ("so {} it", "{}", "A {}.") for _, p, _ in patterns.FILLERS for x in p.replace(r"\b", "").strip("()?:").split("|")]
    given += ["it's important to note that", "it is important to note that", "as an llm", "as a language model", "i'd like you to", "can you please", "the following is an"]
    plain = [(r[3], needles(r[3])) for r in RULES if r[0].startswith("sub.")] + [(p, needles(p)) for _, p, _ in patterns.FILLERS]
    hit = 0
    for pattern, words in plain:
        for text in given:
            if compiled(pattern).search(text.lower()):
                hit += 1
                assert any(w in text.lower() for w in words), (pattern, text)
    assert hit > 50
    with pytest.raises(ValueError):
        needles(r"[ab]+")


def test_cases_cover_all_rules_regions_and_markers():
    assert [c[0] for c in cases.RULES] == [r[0] for r in RULES]
    assert {k for k, _ in cases.REGIONS} == {"code-fence", "example", "table", "json", "inline-code", "url", "email", "variable", "quoted-string"}
    assert {t for t, *_ in cases.CONSTRAINTS} == set(ledger.TYPES)
    assert relations.annotated_corpus is library.QUERIES["annotated_corpus"] and set(library.QUERIES) == set(library.SQL)


def test_packing_takes_time_in_proportion_to_a_text():
    text = "a" * 2_000_000
    began = time.process_time()
    packed = share.pack(text)
    assert time.process_time() - began < 8 and share.unpack(packed) == text


def test_the_letter_of_filling_stands_for_zeros():
    packed = share.pack("abcabc")
    assert "A" in packed and share.unpack(packed.replace("A", "$")) == "abcabc"
