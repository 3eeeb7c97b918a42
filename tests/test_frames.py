import json
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from promptloom.functions import data, pricing
from promptloom.functions import text as T
from promptloom.operators import frames, ledger
from promptloom.operators.layout import cache_ready, markers, split
from promptloom.plans import queries as library
from promptloom.plans import reports
from promptloom.sources import files, share
from promptloom.streaming import streams

SF = "/root/testdata/sf0.001"


def test_native_tokens_equal_the_ledgers(spark):
    texts = ["In order to UTILIZE “it”, please - café can't 50% $5", "", "It's important to note that x—y", "as an ai assistant it is able to do"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [ledger.tokens(t) for t in texts]


def test_occurrences_and_similarity(spark):
    rows = [(["a", "a", "a"], ["a", "a"]), (["a"], ["a", "b"]), ([], []), (["a"], [])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.occurrences(F.col("a"), F.col("b")).alias("n"), T.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["n"] for r in got] == [2, 0, 0, 0] and [r["s"] for r in got] == [1.0, 0.5, 0.0, 0.0]


def test_golden_economics(spark):
    one = spark.createDataFrame([(10_000, 8_000, 7_000, 2_400, 3_500, 10_000, None)], "original_tokens long, compressed_tokens long, prefix_tokens long, compressed_dynamic_tokens long, cacheable_today_tokens long, calls_per_day long, interval_seconds double")
    rows = pricing.recommend(pricing.advise(one.join(F.broadcast(data.models(spark))))).collect()
    best = {r["model_id"]: r for r in rows}
    opus = best["claude-opus-5"]
    assert math.isclose(opus["as_is"], 10_000 / 1e6 * 5 * 10_000 * 30) and opus["best"] == "cache" and opus["writes_per_day"] == 1
    assert opus["break_even_calls"] == 2 and best["gemini-3.8-flash"]["break_even_calls"] == math.inf
    assert opus["headline"].startswith("Cache the static prefix")
    gap = spark.createDataFrame([(g,) for g in (8.64, 300.0, 301.0, 3600.0, 3601.0)], "g double").join(F.broadcast(data.models(spark).where("model_id = 'claude-opus-5'")))
    chosen = {r["g"]: r["t"] for r in gap.select("g", pricing.shortest_ttl(F.col("g")).alias("t")).collect()}
    assert chosen == {8.64: "anthropic-5m", 300.0: "anthropic-5m", 301.0: "anthropic-1h", 3600.0: "anthropic-1h", 3601.0: None}


def test_null_prompts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "Please go.", "y"), (3, "", None)], "id int, text string, start string")
    got = {r["id"]: r for r in frames.with_undone(frames.with_rewrite(docs, "balanced")).collect()}
    assert got[2]["output"] == "Go." and got[2]["undone"] == "Please go." and got[1]["output"] == "" and got[3]["changes"] == []
    assert frames.with_segments(docs.limit(0)).count() == 0


def test_layout():
    text = "Be brief.\nToday is {{today}}.\nUser: hello\nid 5"
    laid = split(text)
    assert laid.reordered_prefix == "Be brief." and laid.reordered_suffix.startswith("Today is {{today}}.\nUser: hello")
    assert laid.cacheable_end == text.index("Today is") and [m.kind for m in markers(text)][:2] == ["date", "date"]
    ready = cache_ready(text, "gemini", ttl_seconds=300)
    assert '"300s"' in ready["marker"] and len(ready["notes"]) == 1 and ready["moved_lines"] == ["Today is {{today}}."]
    assert "dynamic from its first line" in cache_ready("User: x", "openai")["notes"][0]


def test_files_and_gates(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    for name, body in (("a/one.md", "Please write it in order to win."), ("a/two.txt", "x"), ("a/node_modules/no.md", "x"), ("a/p.json", json.dumps({"input": "from json"})), ("a/q.json", '{"input": 5}')):
        (tmp_path / name).write_text(body)
    assert files.expand(["a"], str(tmp_path)) == ["a/one.md", "a/two.txt"]
    assert files.expand(["**/*.{md,txt}", "a/one.md"], str(tmp_path)) == ["a/one.md", "a/two.txt"]
    assert files.matches("a/**/b", "a/b") and not files.matches("a/*", "a/b/c") and files.root_of("x/y/*.md") == "x/y"
    read = {r["path"].rsplit("/", 1)[-1]: r["content"] for r in files.read_prompts(spark, [str(tmp_path / "a" / n) for n in ("one.md", "p.json", "q.json")]).collect()}
    assert read == {"one.md": "Please write it in order to win.", "p.json": "from json", "q.json": '{"input": 5}'}
    given = spark.createDataFrame([("one.md", "Please write it in order to win.", "Write."), ("two.md", "Short.", None)], "path string, content string, base_content string")
    checked = reports.analyse(given, "claude-opus-5", budget=5).cache()
    assert reports.failures(checked, ["budget", "regression", "duplicates"]) == ["1 file over budget: one.md", "1 file grew against the base: one.md (+8)"]
    total = reports.totals(checked).first()
    assert total["files"] == 2 and total["saved_tokens"] > 0 and total["unverified"] == 0
    with pytest.raises(KeyError):
        data.model("none")


def test_share_round_trip():
    assert share.decode(share.encode("héllo\n", "light")) == ("héllo\n", "light")
    assert share.decode("#s=xx") is None and share.decode("x") is None


def test_model_pipeline(spark):
    docs = spark.createDataFrame([("First thing here. Never share keys. Third thing. You must reply.",), (None,)], "text string")
    rows = reports.model_pipeline(docs, reports.HalvingClient()).collect()
    assert rows[0]["lost"] == 0 and rows[0]["repairs"] == 1 and "Never share keys." in rows[0]["output"]
    assert rows[1]["error"] is not None and reports.output_budget(10) == 2053 and reports.output_budget(10**6) == 32_000


def test_accuracy(spark):
    gold = spark.createDataFrame([("a", "format", "in JSON"), ("a", "format", "two lines")], "id string, type string, anchor string")
    found = spark.createDataFrame([("a", "format", "respond in JSON"), ("b", "format", "two lines")], "id string, type string, anchor string")
    row = reports.accuracy(gold, found).first()
    assert (row["recall"], row["precision"]) == (0.5, 0.5)


def test_streams_match_tables(spark, tmp_path):
    docs = spark.createDataFrame([("Please go.", "2024-01-01 00:10:00"), ("Please stop now.", "2024-01-01 01:20:00")], "text string, ts string").select("text", F.to_timestamp("ts").alias("ts"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), "text string, ts timestamp")
    for name, out, mode in (("rewritten", streams.rewritten(stream).select("output"), "append"), ("spent", streams.spend(stream), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r["output"] for r in spark.table("rewritten").collect()} == {"Go.", "Stop now."}
    assert spark.table("spent").agg(F.sum("prompts")).first()[0] == 2


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "customer", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = library.QUERIES[name](spark, SF)
    want = con.execute(library.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    key = lambda r: str(r)
    left = sorted(([plain(v) for v in r] for r in found.select(columns).collect()), key=key)
    assert left == sorted(([plain(v) for v in r] for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_queries_without_sql_run(spark, name):
    found = library.QUERIES[name](spark, SF)
    row = found.first()
    assert row is not None
    if name == "segment_cover":
        assert found.where("NOT whole").count() == 0
    if name.startswith("compress"):
        assert found.where("NOT undoable OR critical_lost > 0").count() == 0
    if name == "restore":
        assert found.where("restored NOT LIKE '%Never exceed 5 retries.%'").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 48
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left_out", [("promptloom/llm", "corpus_pipeline.py"), ("promptloom/llm",), ("corpus_pipeline.py",)])
def test_entry_without_the_optional_parts(tmp_path, left_out):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "promptloom"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in left_out:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and 'extract_constraints' in q"
    # And one of the queries runs.
    code += "; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); assert q['prompt_files'](s, e.SMOKE).count() > 0 and e.entry(s).count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
