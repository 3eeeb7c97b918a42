"""Near-duplicate groups, native rewriting, undoing by keys, as-of joins and table functions against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from promptloom.functions import tables
from promptloom.operators import frames, native, rewrite, scan
from promptloom.plans import asof, cases, similar


def plain_groups(items, threshold):
    sets = sorted({(k, tuple(sorted(set(w)))) for k, w in items if w}, key=str)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (kind, own) in enumerate(sets):
        for j, (other_kind, other) in enumerate(sets[:i]):
            if kind == other_kind and len(set(own) & set(other)) >= threshold * len(set(own) | set(other)) - 1e-9:
                parent[find(i)] = find(j)
    members = {}
    for i, s in enumerate(sets):
        members.setdefault(find(i), []).append(s)
    return {s: min(x[1] for x in some) for some in members.values() for s in some}


@pytest.mark.parametrize("words,threshold,hot", [(8, 0.6, 200), (15, 0.6, 3), (40, 0.3, 3), (15, 0.9, 5)])
def test_groups_equal_all_pairs(spark, words, threshold, hot):
    rng = random.Random(words)
    some = [f"w{i}" for i in range(words)]
    # Every third set has a token that no other has, as slots of templates are filled.
    items = [(rng.choice(["a", "b", None]), [rng.choice(some) for _ in range(rng.randrange(9))] + ([f"u{i}"] if i % 3 == 0 else [])) for i in range(300)]
    items += [("a", ["one", "two", "three", "four", f"slot{i}"]) for i in range(60)] + [("a", None), ("a", [None, "w1"])]
    found = similar.near_groups(spark.createDataFrame(items, "k string, t array<string>"), "k", "t", threshold, hot).collect()
    want = plain_groups([(k, [w for w in t or () if w]) for k, t in items], threshold)
    assert {(r["kind"], tuple(r["set"])): tuple(r["group"]) for r in found} == want
    assert sum(r["n"] for r in found) == sum(bool([w for w in t or () if w]) for _, t in items)


def test_long_chains_are_one_group(spark):
    chain = [("c", [f"x{j}" for j in range(i, i + 6)]) for i in range(90)]
    found = similar.near_groups(spark.createDataFrame(chain, "k string, t array<string>"), "k", "t").collect()
    assert len({tuple(r["group"]) for r in found}) == 1
    assert similar.near_groups(spark.createDataFrame([], "k string, t array<string>"), "k", "t").count() == 0


WORDS = ["Never exceed 5", "please ", "Please ", "in order to", ". ", "\n", "very ", "utilize it", '"quoted please x"', "`in order to`", "{{please x}}", "a@b.org", "https://a.b/please ,", "  ", "\t", "* ", "1.   ", "2)  ", "Don’t", "é’É", "  , ", "\n\n\n", " ", "Could you please ", "Your task is to ", "the", "prior to ", "<b>", "[UPPER X]", "${v} ", "%s ", "‘q’ ", "“please do”", "'please y'", "```\nplease\n```\n", '{"a": "please"}', "[1, 2]", "| a | b |\n|---|---|\n", "Example: please\n"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    own = [c[1].replace("◊", "x") for c in cases.RULES] + ["".join(cases.parts(p)) for _, p in cases.REGIONS]
    return ["", None, *own, *("".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for _ in range(400))]


def test_native_regions_and_segments_equal_the_scanner(spark, texts):
    given = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    text = F.coalesce("text", F.lit(""))
    rows = given.select("text", native.covers(text).alias("ok"), native.regions(text).alias("r"), native.segments(text, native.regions(text)).alias("s")).collect()
    assert 100 < sum(r["ok"] for r in rows) < len(rows)
    for r in rows:
        if r["ok"]:
            assert [tuple(x) for x in r["r"]] == scan.regions(r["text"] or "")
            assert [tuple(x) for x in r["s"]] == scan.segments(r["text"] or "")
        else:
            assert r["text"]


@pytest.mark.parametrize("level", ["light", "balanced"])
def test_native_rewriting_equals_the_scanner(spark, texts, level):
    given = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    for r in native.with_rewrite(given, level).collect():
        want = rewrite.rewrite(r["text"] or "", level)
        assert r["output"] == want.output
        assert [tuple(c)[:7] for c in r["changes"]] == [(c.rule_id, c.start, c.end, c.original, c.replacement, c.lossy, c.capitalised) for c in want.changes]
    plan = native.with_native_rewrite(given, level)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        native.with_rewrite(given, "aggressive")


def test_choices_undo_none_some_and_all(spark):
    text = "Please go in order to win. Please stop prior to noon."
    given = spark.createDataFrame([(i, text if i else None) for i in (0, 1, 2, 3, 3)], "i int, text string").withColumn("undone", F.lit(1))
    out = frames.with_rewrite(given, "balanced")
    changes = rewrite.rewrite(text, "balanced").changes
    off = [(2, changes[0].key), (2, changes[0].key), (2, "none:0:1")] + [(3, c.key) for c in changes] + [(None, "x"), (9, changes[0].key)]
    found = native.with_choices(out, spark.createDataFrame(off, "i int, change string"), "i").collect()
    by = {r["i"]: r for r in found}
    assert len(found) == 5 and by[1]["projected"] == rewrite.apply(text, changes) == by[1]["output"]
    assert by[2]["projected"] == rewrite.without(text, changes, [changes[0].key]) and by[2]["undone"] == [changes[0].key]
    assert by[3]["projected"] == text and len(by[3]["undone"]) == len(changes) and by[1]["undone"] == []


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_asof_joins_equal_bisection(spark, width):
    rng = random.Random(width)
    starts = {k: sorted(rng.sample(range(500), n)) for k, n in ((1, 40), (2, 1), (3, 0))}
    spans = [(k, s, s + 4) for k, some in starts.items() for s in some]
    points = [(k, rng.randrange(-5, 520)) for k in (1, 2, 3, 4) for _ in range(60)] + [(1, 3), (1, 3), (None, 3), (1, None)]
    p, s = spark.createDataFrame(points, "k int, at int"), spark.createDataFrame([*spans, (None, 1, 9)], "k int, start int, end int")

    def want(k, at):
        some = starts.get(k, [])
        i = bisect.bisect_right(some, at) - 1 if at is not None else -1
        return some[i] if i >= 0 else None

    rows = asof.last_before(p, s, "k", width=width).collect()
    assert len(rows) == len(points) and all((r["span"]["start"] if r["span"] else None) == want(r["k"], r["at"]) for r in rows)
    held = asof.holder(p, s, "k", width=width).collect()
    assert all((r["span"] is not None) == (want(r["k"], r["at"]) is not None and r["at"] < want(r["k"], r["at"]) + 4) for r in held)


def test_table_functions(spark):
    tables.register(spark)
    one = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert one("SELECT kind, text FROM segments('a {{x}} b')") == [(None, "a "), ("variable", "{{x}}"), (None, " b")]
    assert one("SELECT type FROM constraints('Never open 5 doors.', 'quantity')") == [("prohibition",)]
    assert one("SELECT * FROM batch('a\n---\nb')") == [(0, "a"), (1, "b")] and one("SELECT * FROM prompt_sentences('A b. C')") == [("A b.", 0, 4), ("C", 5, 6)]
    assert one("SELECT * FROM segments(CAST(NULL AS STRING))") == []
    with pytest.raises(Exception, match="must be a string"):
        one("SELECT * FROM segments(1)")


def test_decimals_round_by_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from promptloom.functions import pricing

    rng = random.Random(1)
    values = [round(rng.random() * 10 ** rng.randrange(-4, 5), rng.randrange(1, 7)) for _ in range(2000)] + [0.125, 4.305, 1.15, 0.00005, 9.995, 1024.05, 16.0]
    given = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4):
        for r in given.select("v", pricing.fixed(F.col("v"), digits).alias("s")).collect():
            assert r["s"] == str(Decimal(r["v"]).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
