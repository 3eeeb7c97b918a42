"""What the third round's findings asked for: work and rows whose size doesn't grow faster than the input."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from promptloom.functions import dialect, patterns
from promptloom.functions import text as T
from promptloom.operators import layout, ledger, native
from promptloom.operators.rewrite import SHIPPED, rules_for
from promptloom.operators.rules import RULES
from promptloom.plans import prompts, relations, reports, similar


def test_only_the_scanners_of_what_is_compared_run(monkeypatch):
    text = 'Never exceed 5 retries. Reply in JSON to `a` at https://a.b/c for user_id 7. Open Berlin now.\n{"k": "v"}'
    off = frozenset(ledger.TYPES) - frozenset(ledger.COMPARED)
    want = [c for c in ledger.extract(text) if c.type in ledger.COMPARED]
    ran = []
    for name in ("entities", "protected", "names"):
        monkeypatch.setattr(ledger._Inventory, name, lambda self, name=name: ran.append(name))
    assert want and ledger.extract(text, exclude=off) == want and not ran


def test_demands_are_the_inventory_s(spark):
    texts = ["Never exceed 5 retries. You must answer in JSON.", None, "Open the door. Always be kind; never shout.", 'Say "no" 5 times in 10 ms.']
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = reports.demands(docs, "i").withColumn("java", T.tokens(F.col("anchor"))).collect()
    want = [(i, c.type, c.anchor) for i, t in enumerate(texts) for c in ledger.extract(t or "") if c.type in ledger.COMPARED]
    assert sorted((r["id"], r["type"], r["anchor"]) for r in found) == sorted(want) and all(r["tokens"] == r["java"] for r in found)


def test_near_demands_tell_prompts_apart_once_per_group(spark):
    rows = [(i % 7, "requirement", f"must answer in JSON for user {i % 5}") for i in range(70)]
    rows += [(i, "prohibition", "never exceed 5 retries") for i in range(30)] + [(1, "requirement", "must go"), (None, "requirement", "must answer in json for user 0")]
    given = spark.createDataFrame(rows, "id int, type string, anchor string")
    found = similar.near_demands(given, ledger.COMPARED, T.tokens(F.col("anchor")))
    assert [tuple(r) for r in found.collect()] == [("requirement", 5, 7, "must answer in JSON for user 0")]
    # Ids are told apart by one aggregation over two columns; several distinct counts expand each row.
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_meets_is_numbers_of_one_width(spark):
    rng = random.Random(5)
    sets = [("a", sorted({rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)})) for _ in range(60)]
    given = spark.createDataFrame(sets, "kind string, set array<string>").withColumn("no", F.monotonically_increasing_id())
    nodes = similar.numbered(similar.classes(given))
    for hot in (2, 10_000):
        keys = similar._keys(nodes, 0.6, hot)
        # A row with the whole set for each key took the square of a set's length.
        assert not any(isinstance(f.dataType, (ArrayType, StringType)) for f in keys.schema.fields)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_bounds_drop_no_link(spark, hot):
    rng = random.Random(hot)
    base = [[f"w{rng.randrange(90)}" for _ in range(rng.randrange(20, 160))] for _ in range(12)]
    sets = sorted({tuple(sorted({w if rng.random() < 0.85 else f"w{rng.randrange(400)}" for w in b})) for b in base for _ in range(8)})
    given = spark.createDataFrame([("a", list(s)) for s in sets], "kind string, set array<string>").withColumn("no", F.monotonically_increasing_id())
    nodes = similar.staged(similar.numbered(similar.classes(given)), "nodes")
    cores = {r["node"]: (set(r["core"]), r["size"]) for r in nodes.collect()}
    want = {(a, b) for a, (x, m) in cores.items() for b, (y, n) in cores.items() if a < b and len(x & y) >= 0.6 * (m + n - len(x & y)) - 1e-9}
    found = [tuple(r) for r in similar.links(nodes, 0.6, hot).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_tasks_are_as_many_as_their_rows_ask_for(spark, tmp_path, monkeypatch):
    # One row group, cut into more splits than there are cores: all rows are in one of them.
    spark.range(9000).selectExpr("id", "repeat(md5(cast(id as string)), 20) AS t").coalesce(1).write.parquet(str(tmp_path / "one"))
    with_splits = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = spark.read.parquet(str(tmp_path / "one"))
        assert rows.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        sizes = [r["n"] for r in prompts.spread(rows, 500).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_splits)
    assert sum(sizes) == 9000 and len(sizes) == 18 and max(sizes) < 600


def test_a_document_is_one_row_whatever_its_id(spark, tmp_path):
    texts = ["Please go in order to win.", "```\nplease\n```", "Please see `x` at https://a.b.", None]
    spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = relations.native_documents(spark, str(tmp_path))
    # Joins by doc_id multiplied documents of one id.
    assert sorted((r["whole"], r["alike"]) for r in found.where("whole IS NOT NULL").collect()) == [(True, True)] * 3 and found.count() == 4
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_native_patterns_run_only_where_their_strings_stand(spark):
    rules = [r for r in RULES if r[0] in {x.id for x in rules_for("balanced", SHIPPED)}]
    sources = [p for _, p, _ in patterns.REGIONS] + [r[3] for r in rules]
    parts = ["please", "Kindly, ", "IN ORDER TO", "ſhould", "İn", "ı", "Kindly", "{{v}}", "${v}", "a@b.co", "`c`", "“q”", "  ", ". ", "\n", "utilizing", "HTTP://y", "'q' "]
    rng = random.Random(6)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(150)]
    given = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    may = F.array(*[native.may_match(p, native.folded(F.col("text"))) for p in sources])
    skipped = 0
    for r in given.select("text", may.alias("may")).collect():
        for p, m in zip(sources, r["may"], strict=True):
            skipped += not m
            # What Java's lower case adds to a letter is no ASCII letter.
            assert m == dialect.may_match(p, dialect.fold(r["text"]))
    assert skipped > len(texts) * len(sources) / 2


def test_signs_that_cannot_stand_are_not_sought(monkeypatch):
    plain = "Sort these words.\nBe brief, and be kind!\nWhat {{topic}} is it?"
    dated = "Sort. Today is Monday.\nUser: see 2024-01-02 for session id 5.\n<user_query>x</user_query>"
    sought = []

    class Spy:
        def __init__(self, label, sign):
            self.label, self.sign = label, sign

        def __getattr__(self, name):
            sought.append((self.label, name))
            return getattr(self.sign, name)

    want = layout.split(dated)
    monkeypatch.setattr(layout, "SIGN", {label: Spy(label, s) for label, s in layout.SIGN.items()})
    assert layout.split(dated) == want and [m.kind for m in want.markers][:2] == ["date", "section"]
    sought.clear()
    assert [m.kind for m in layout.markers(plain)] == ["variable"]
    # Before, each line and each sign was tried.
    assert not [s for s in sought if s[1] in ("match", "finditer")]
